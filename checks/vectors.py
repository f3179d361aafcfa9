"""Vector tables and search. Questions are the mean vectors of the labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, stored_vectors
from tarnsearch.functions.vectors import l2_normalize, rounded
from tarnsearch.operators import dense, inverted
from tarnsearch.operators.approximate import lsh_topk
from tarnsearch.plans.work import work_folder
from tarnsearch.sources.tables import read_vectors, write_vectors

CENTRES = """
elements AS (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x FROM embeddings),
means AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x FROM elements GROUP BY label, pos),
centres AS (
  SELECT CAST(label AS BIGINT) AS query_id, CAST(list(CAST(x AS FLOAT) ORDER BY pos) AS FLOAT[]) AS centre
  FROM means GROUP BY label),
"""


def _nearest(score: str, k: int = 60) -> str:
    return f"""WITH {CENTRES}
    scored AS (SELECT query_id, vec_id AS chunk_id, round({score}, 6) AS score FROM centres, embeddings)
    SELECT query_id, chunk_id, score, CAST(row_number() OVER (
      PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank
    FROM scored QUALIFY rank <= {k}"""


def centres(vectors):
    """One question per label: the mean of its vectors."""
    means = (
        vectors.select("label", F.posexplode("embedding").alias("pos", "x"))
        .groupBy("label", "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
    )
    # As long as a vector is wide.
    entries = F.sort_array(F.collect_list(F.struct("pos", "x")))
    return means.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(
        F.transform(entries, lambda e: e["x"].cast("float")).alias("embedding")
    )


@query("vector_topk", _nearest("list_inner_product(centre::DOUBLE[], embedding::DOUBLE[])"))
def vector_topk(spark, folder):
    vectors = stored_vectors(spark, folder)
    return dense.topk(vectors, centres(vectors))


@query("cosine_topk", _nearest("list_cosine_similarity(centre::DOUBLE[], embedding::DOUBLE[])"))
def cosine_topk(spark, folder):
    vectors = stored_vectors(spark, folder)
    return dense.topk(vectors, centres(vectors), metric="cosine")


@query(
    "vector_topk_single",
    """WITH asked AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)
    SELECT vec_id AS chunk_id, round(list_inner_product(q::DOUBLE[], embedding::DOUBLE[]), 6) AS score
    FROM embeddings, asked ORDER BY score DESC, chunk_id LIMIT 60""",
)
def vector_topk_single(spark, folder):
    vectors = stored_vectors(spark, folder)
    asked = vectors.orderBy("chunk_id").first()["embedding"]
    return dense.topk_single(vectors, asked)


@query("vector_topk_lsh")
def vector_topk_lsh(spark, folder):
    vectors = stored_vectors(spark, folder)
    asked = centres(vectors)
    exact = dense.topk(vectors, asked, k=10).select("query_id", "chunk_id", F.lit(True).alias("exact"))
    found = lsh_topk(vectors, asked, k=10)
    return found.join(exact, ["query_id", "chunk_id"], "left").withColumn(
        "exact", F.coalesce("exact", F.lit(False))
    )


@query(
    "vector_index_stats",
    """SELECT count(*) AS n_vectors, CAST(min(len(embedding)) AS INTEGER) AS min_dim,
    CAST(max(len(embedding)) AS INTEGER) AS max_dim FROM embeddings""",
)
def vector_index_stats(spark, folder):
    return dense.index_stats(stored_vectors(spark, folder))


@query(
    "vector_violations",
    """SELECT vec_id AS chunk_id, 'duplicate id' AS reason FROM embeddings WHERE label = 1
    UNION ALL SELECT vec_id, 'wrong dimension' FROM embeddings WHERE label = 2
    UNION ALL SELECT vec_id, 'missing element' FROM embeddings WHERE label = 3
    UNION ALL SELECT vec_id, 'missing vector' FROM embeddings WHERE label = 4""",
)
def vector_violations(spark, folder):
    """Vectors of four labels are spoilt, each label in its own way."""
    vectors = stored_vectors(spark, folder)
    spoilt = (
        F.when(F.col("label") == 2, F.slice("embedding", 1, 63))
        .when(F.col("label") == 3, F.transform("embedding", lambda x, i: F.when(i > 0, x)))
        .when(F.col("label") != 4, F.col("embedding"))
    )
    twice = vectors.unionByName(vectors.filter("label = 1"))
    return dense.vector_violations(twice.select("chunk_id", spoilt.alias("embedding")), dim=64)


_ELEMENTS = """SELECT vec_id AS chunk_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos,
    round(CAST(unnest({0}) AS DOUBLE), 6) AS value FROM embeddings"""


def _elements(vectors):
    return vectors.select("chunk_id", F.posexplode("embedding").alias("pos", "value")).withColumn(
        "value", rounded(F.col("value").cast("double"))
    )


@query("vector_append", _ELEMENTS.format("embedding"))
def vector_append(spark, folder):
    vectors = stored_vectors(spark, folder)
    stored = dense.as_vectors(vectors.filter("label < 5"), "chunk_id")
    more = dense.as_vectors(vectors.filter("label >= 5"), "chunk_id")
    return _elements(dense.append_vectors(stored, more))


@query(
    "l2_normalize",
    """WITH scaled AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (label + 2)) AS v
      FROM embeddings)
    SELECT vec_id AS chunk_id, CAST(unnest(range(len(v))) AS INTEGER) AS pos,
    round(CAST(CAST(unnest(v) / sqrt(list_inner_product(v, v)) AS FLOAT) AS DOUBLE), 6) AS value FROM scaled""",
)
def l2_normalize_vectors(spark, folder):
    vectors = stored_vectors(spark, folder)
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 2))
    return _elements(vectors.select("chunk_id", l2_normalize(scaled).alias("embedding")))


@query("index_roundtrip", _ELEMENTS.format("embedding"))
def index_roundtrip(spark, folder):
    path = work_folder(spark, "vectors")
    write_vectors(stored_vectors(spark, folder), path)
    return _elements(read_vectors(spark, path))


_EXACT = _nearest("list_inner_product(centre::DOUBLE[], embedding::DOUBLE[])", 10)


@query("vector_topk_bounded", _EXACT)
def vector_topk_bounded(spark, folder):
    """The exact best ten by way of the inverted file: cells that cannot hold better ones stay unread."""
    vectors = stored_vectors(spark, folder)
    index = inverted.build_inverted_file(vectors, work_folder(spark, "inverted"))
    return inverted.exact_topk(index, centres(vectors), k=10, probes=4)


@query("vector_topk_inverted", f"SELECT *, true AS recall_reached FROM ({_EXACT})")
def vector_topk_inverted(spark, folder):
    """The exact best ten, and whether probing some of the cells finds nine in ten of them."""
    vectors = stored_vectors(spark, folder)
    asked = centres(vectors)
    index = inverted.build_inverted_file(vectors, work_folder(spark, "inverted"))
    probes = inverted.calibrate(index, asked, k=10, recall=0.95)
    found = inverted.topk(index, asked, k=10, probes=probes).select("query_id", "chunk_id", F.lit(1).alias("found"))
    exact = dense.topk(vectors, asked, k=10).join(found, ["query_id", "chunk_id"], "left")
    # One row: the share of the exact hits that were found.
    share = exact.agg((F.avg(F.coalesce("found", F.lit(0))) >= 0.9).alias("recall_reached"))
    return exact.drop("found").join(F.broadcast(share))
