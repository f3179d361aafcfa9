"""Pieces of SQL the oracles share. Each is a list of common table expressions."""

from checks.registry import DIM

WORDS = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+')"
SPACES = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(133) || chr(160)"
PATH = "source || '/' || doc_id || '.txt'"


def words(column: str) -> str:
    return WORDS.format(column)


def strip(text: str) -> str:
    return f"trim({text}, {SPACES})"


CHUNKS = f"chunks AS (SELECT doc_id AS chunk_id, {PATH} AS source_path, text FROM documents)"
QUESTIONS = "questions AS (SELECT item_id AS query_id, text AS query FROM benchmark)"

POSTINGS = f"""
chunk_len AS MATERIALIZED (
  SELECT chunk_id, CAST(len({words('text')}) AS BIGINT) AS chunk_len FROM chunks),
postings AS MATERIALIZED (
  SELECT chunk_id, lower(word) AS term, count(*) AS tf
  FROM (SELECT chunk_id, unnest({words('text')}) AS word FROM chunks) GROUP BY ALL),
terms AS MATERIALIZED (
  SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM postings GROUP BY term)"""

IDF = """
totals AS (
  SELECT count(*) AS n, CAST(sum(chunk_len) AS BIGINT) AS n_tokens,
         sum(chunk_len) / count(*) AS avg_len FROM chunk_len),
raw AS (SELECT term, df, ln((SELECT n FROM totals) - df + 0.5) - ln(df + 0.5) AS raw FROM terms),
idf AS MATERIALIZED (
  SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END AS idf FROM raw)"""

BM25 = f"""
asked AS (
  SELECT query_id, lower(word) AS term, count(*) AS qf
  FROM (SELECT query_id, unnest({words('query')}) AS word FROM questions) GROUP BY ALL),
scored AS (
  SELECT query_id, chunk_id,
         sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * chunk_len / avg_len))) AS raw_score
  FROM asked JOIN idf USING (term) JOIN postings USING (term) JOIN chunk_len USING (chunk_id), totals
  GROUP BY query_id, chunk_id)"""

BM25_TOP = """
by_words AS (
  SELECT query_id, chunk_id, round(raw_score, 6) AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(raw_score, 6) DESC, chunk_id) AS rank
  FROM scored WHERE raw_score > 0 QUALIFY rank <= 60)"""


def hashed(prefix: str, tokens: str, key: str) -> str:
    """Hash embedding as sparse rows (key, bucket, weight)."""
    return f"""
{prefix}_counts AS (
  SELECT {key}, CAST(CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % {DIM} AS INTEGER) AS bucket,
         sum(n) AS n
  FROM {tokens} GROUP BY ALL),
{prefix}_norm AS (
  SELECT {key}, sqrt(CAST(sum(n * n) AS DOUBLE)) AS norm FROM {prefix}_counts GROUP BY {key}),
{prefix} AS (
  SELECT {key}, bucket, CAST(n / norm AS FLOAT) AS weight
  FROM {prefix}_counts JOIN {prefix}_norm USING ({key}))"""


DENSE_TOP = (
    hashed("chunk_vec", "(SELECT chunk_id, term, tf AS n FROM postings)", "chunk_id")
    + ","
    + hashed("query_vec", "(SELECT query_id, term, qf AS n FROM asked)", "query_id")
    + """,
products AS (
  SELECT query_id, chunk_id, sum(CAST(q.weight AS DOUBLE) * CAST(c.weight AS DOUBLE)) AS product
  FROM query_vec q JOIN chunk_vec c USING (bucket) GROUP BY query_id, chunk_id),
by_vectors AS (
  SELECT query_id, chunk_id, round(coalesce(product, 0), 6) AS score,
         row_number() OVER (
           PARTITION BY query_id ORDER BY round(coalesce(product, 0), 6) DESC, chunk_id) AS rank
  FROM questions CROSS JOIN chunks LEFT JOIN products USING (query_id, chunk_id)
  QUALIFY rank <= 60)"""
)

FUSED = """
fused AS (
  SELECT query_id, chunk_id, w.rank AS rank_1, v.rank AS rank_2,
         round(coalesce(1.0 / (60 + w.rank), 0) + coalesce(1.0 / (60 + v.rank), 0), 12) AS rrf_score
  FROM by_words w FULL JOIN by_vectors v USING (query_id, chunk_id)),
ranked AS (
  SELECT *, row_number() OVER (
    PARTITION BY query_id
    ORDER BY rrf_score DESC, rank_1 ASC NULLS LAST, rank_2 ASC NULLS LAST) AS rank
  FROM fused QUALIFY rank <= 40)"""

CANDIDATES = """
candidates AS (
  SELECT query_id, chunk_id, rank, rrf_score, source_path AS source, text
  FROM ranked JOIN chunks USING (chunk_id))"""

RERANKED = f"""
asked_terms AS (SELECT query_id, list_distinct(list_transform({words('query')}, lambda t: lower(t))) AS asked
  FROM questions),
pair_scores AS (
  SELECT c.query_id, c.chunk_id, c.source, c.text,
         round(CASE WHEN len(asked) > 0 THEN
           len(list_intersect(asked, list_transform({words('text')}, lambda t: lower(t)))) / len(asked)
         ELSE 0 END, 6) AS score
  FROM candidates c JOIN asked_terms USING (query_id)),
reranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM pair_scores QUALIFY rank <= 10)"""

PIECES = f"""
pieces AS (
  SELECT query_id, chunk_id, rank,
         '### Source: ' || source || ' | chunk_id: ' || chunk_id || chr(10) || {strip('text')} AS piece
  FROM reranked),
packed AS (
  SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS used_chars
  FROM pieces QUALIFY used_chars <= 12000)"""


def fixed_chunks(size: int, overlap: int, source: str = "documents") -> str:
    """Character windows of documents, numbered over all of them by path."""
    step = size - overlap
    return f"""
windows AS (
  SELECT doc_id, {PATH} AS source_path, text, i
  FROM {source}, unnest(generate_series(0, CASE WHEN length(text) <= {size} THEN 0
       ELSE CAST(ceil((length(text) - {overlap}) / {step}) AS BIGINT) - 1 END)) AS t(i)),
stripped AS (
  SELECT doc_id, source_path, i,
         {strip(f"substr(text, i * {step} + 1, {size})")} AS piece
  FROM windows),
pieces_kept AS (SELECT * FROM stripped WHERE piece <> ''),
fixed AS (
  SELECT row_number() OVER (ORDER BY source_path, doc_id, i) - 1 AS chunk_id, doc_id, source_path,
         CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_pos,
         piece AS text
  FROM pieces_kept)"""


def recursive_chunks(size: int, overlap: int) -> str:
    """Documents cut at line ends, and pieces of ``size`` or more at blanks, merged into overlapping windows.

    For texts without blank lines and without words of ``size`` characters. A window is two places in its group's list of
    pieces; the next one starts where at most ``overlap`` of the last is kept and its first new piece still fits.
    """
    return f"""
pieces AS (
  SELECT doc_id, {PATH} AS source_path, i,
         CASE WHEN i > 1 THEN chr(10) || piece ELSE piece END AS piece, contains(text, chr(10)) AS by_line
  FROM (SELECT doc_id, source, text, string_split(text, chr(10)) AS ps FROM documents) AS d,
       unnest(ps) WITH ORDINALITY AS t(piece, i)),
marked AS (
  SELECT *, by_line AND length(piece) < {size} AS short FROM pieces WHERE piece <> ''),
runs AS (
  SELECT doc_id, source_path, i, piece, short,
         2 * sum(CASE WHEN short THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) + CASE WHEN short THEN 1 ELSE 0 END AS run
  FROM marked),
parts AS (
  SELECT doc_id, source_path, run, i, 0 AS j, piece FROM runs WHERE short
  UNION ALL
  SELECT doc_id, source_path, run, i, j, CASE WHEN j > 1 THEN ' ' || word ELSE word END
  FROM (SELECT *, string_split(piece, ' ') AS ws FROM runs WHERE NOT short) AS r, unnest(ws) WITH ORDINALITY AS t(word, j)
  WHERE j > 1 OR word <> ''),
summed AS (
  SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY doc_id, run ORDER BY i, j) AS BIGINT) AS upto FROM parts),
lists AS MATERIALIZED (
  SELECT doc_id, any_value(source_path) AS source_path, run, list(piece ORDER BY i, j) AS ps,
         list_concat([0], list(upto ORDER BY i, j)) AS p
  FROM summed GROUP BY doc_id, run),
windows(doc_id, run, s, e) AS (
  SELECT doc_id, run, 0, len(list_filter(p, lambda x: x <= {size})) - 1 FROM lists
  UNION ALL
  SELECT doc_id, run, s, len(list_filter(p, lambda x: x - p[s + 1] <= {size})) - 1 FROM (
    SELECT w.doc_id, w.run, p,
           len(list_filter(p, lambda x: p[e + 1] - x > {overlap} OR p[e + 2] - x > {size})) AS s
    FROM windows w JOIN lists l ON l.doc_id = w.doc_id AND l.run = w.run WHERE e < len(ps))),
cut AS (
  SELECT w.doc_id, source_path, w.run, s, {strip("array_to_string(ps[s + 1:e], '')")} AS text
  FROM windows w JOIN lists l ON l.doc_id = w.doc_id AND l.run = w.run)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(part.strip() for part in parts) + "\n"
