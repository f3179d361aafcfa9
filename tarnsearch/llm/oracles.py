"""SQL that the queries must agree with."""

from tarnsearch.llm.licenses import LicenseScan, window_of

ORACLES: dict[str, str] = {}

SPACED = r"[^\x20\x09-\x0D]+"
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


ORACLES["op1_decontamination"] = f"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all({_lower('text')}, '{PLAIN}') AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all({_lower('text')}, '{PLAIN}') AS w FROM benchmark),
doc_shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM doc_words, unnest(generate_series(1, len(w) - 4)) AS t(i)),
item_shingles AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM item_words, unnest(generate_series(1, len(w) - 4)) AS t(i)),
sizes AS (SELECT item_id, count(*) AS n_shingles FROM item_shingles GROUP BY item_id),
shared AS (
  SELECT doc_id, item_id, count(*) AS n_shared
  FROM item_shingles JOIN doc_shingles USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM shared JOIN sizes USING (item_id) WHERE 100 * n_shared >= 80 * n_shingles"""

ORACLES["op3_lm_scores"] = f"""
WITH words AS (
  SELECT doc_id, i, w FROM (
    SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{SPACED}') AS ws FROM documents) AS d,
    unnest(ws) WITH ORDINALITY AS t(w, i)),
pairs AS (
  SELECT doc_id, i, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM words),
one AS (SELECT w, count(*) AS c FROM words GROUP BY w),
own_one AS (SELECT doc_id, w, count(*) AS c FROM words GROUP BY ALL),
two AS (SELECT v, w, count(*) AS c FROM pairs WHERE v IS NOT NULL GROUP BY ALL),
own_two AS (SELECT doc_id, v, w, count(*) AS c FROM pairs WHERE v IS NOT NULL GROUP BY ALL),
sizes AS (SELECT doc_id, count(*) AS n, (SELECT count(*) FROM words) - count(*) AS rest FROM words GROUP BY doc_id),
parts AS (
  SELECT p.doc_id, p.v, s.n, two.c - own_two.c AS seen, a.c - own_a.c AS first,
         (CASE WHEN b.c > own_b.c THEN b.c - own_b.c ELSE 0.5 END) / s.rest AS back
  FROM pairs p JOIN sizes s USING (doc_id)
  JOIN one b ON b.w = p.w JOIN own_one own_b ON own_b.w = p.w AND own_b.doc_id = p.doc_id
  LEFT JOIN two ON two.v = p.v AND two.w = p.w
  LEFT JOIN own_two ON own_two.v = p.v AND own_two.w = p.w AND own_two.doc_id = p.doc_id
  LEFT JOIN one a ON a.w = p.v LEFT JOIN own_one own_a ON own_a.w = p.v AND own_a.doc_id = p.doc_id),
scored AS (
  SELECT doc_id, any_value(n) AS n,
         sum(ln(CASE WHEN v IS NULL THEN back WHEN seen > 0 THEN seen / first ELSE 0.4 * back END)) AS score
  FROM parts GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_words, round(score / n, 6) AS mean_log_score
FROM documents LEFT JOIN scored USING (doc_id)"""

_SCAN = LicenseScan()
_TEMPLATES = ", ".join(
    f"('{label}', '{body}', {window_of(body, _SCAN.window)})" for label, body in _SCAN.templates
)
_PHRASES = ", ".join(f"('{label}', '{phrase}')" for phrase, label in _SCAN.phrases)

ORACLES["op4_license_scan"] = f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{PLAIN}') AS w FROM documents),
phrases AS (SELECT label, string_split(phrase, ' ') AS p FROM (VALUES {_PHRASES}) AS t(label, phrase)),
templates AS (
  SELECT label, list_distinct(string_split(body, ' ')) AS t, win FROM (VALUES {_TEMPLATES}) AS t(label, body, win)),
places AS (
  SELECT doc_id, label, i - 1 AS place
  FROM words, unnest(generate_series(1, len(w))) AS s(i), phrases
  WHERE w[i] = p[1] AND w[i:i + len(p) - 1] = p),
base AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS base
  FROM places GROUP BY doc_id),
blocks AS (
  SELECT doc_id, win, list_distinct(w[s + 1:s + win]) AS b
  FROM words, (SELECT DISTINCT win FROM templates), unnest(generate_series(0, greatest(len(w) - win // 2 - 1, 0), win // 2)) AS t(s)),
met AS (
  SELECT doc_id, label, len(list_intersect(b, t)) AS shared, len(t) AS n FROM blocks JOIN templates USING (win)),
best AS (
  SELECT doc_id, list(DISTINCT label) AS more, max(shared / n) AS score
  FROM met WHERE 100 * shared >= {_SCAN.percent} * n GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '')
         AS labels,
       coalesce(score, 0.0) AS score
FROM words LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id)"""

ORACLES["op5_url_filter"] = f"""
WITH located AS (
  SELECT page_id,
         {_lower("coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '')")} AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules AS (
  SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                        ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS t(h, p, action)),
fitting AS (
  SELECT page_id, h || p AS rule, action
  FROM located JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM located LEFT JOIN fitting USING (page_id)"""

ORACLES["op7_line_dedup"] = f"""
WITH lines AS (
  SELECT doc_id, i, l, {_lower("trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) AS d,
       unnest(ls) WITH ORDINALITY AS t(l, i)),
common AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT doc_id, i, l, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM lines LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

ORACLES["op9_near_dedup"] = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{SPACED}') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
  FROM words, unnest(generate_series(1, greatest(len(w) - 2, least(len(w), 1)))) AS t(i)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.other),
groups AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM groups LEFT JOIN sizes USING (doc_id)"""

_GRAMS = " UNION ALL ".join(
    f"SELECT lang, {k} AS k, unnest(list_transform(generate_series(1, len(w) - {k - 1}), lambda i: "
    f"array_to_string(w[i:i + {k - 1}], ' '))) AS gram FROM words"
    for k in (1, 2, 3)
)

ORACLES["op11_collocations"] = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array({_lower("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, gram, count(*) AS f FROM ({_GRAMS}) GROUP BY ALL),
sizes AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang),
parts AS (SELECT lang, gram, f FROM grams WHERE f >= 10),
found AS (SELECT lang, k, gram, f AS a, string_split(gram, ' ') AS w FROM grams WHERE k >= 2 AND f >= 10),
cuts AS (
  SELECT lang, gram, a, 1 AS cut, w[1] AS head, array_to_string(w[2:], ' ') AS tail FROM found
  UNION ALL
  SELECT lang, gram, a, 2, array_to_string(w[:2], ' '), w[3] FROM found WHERE k = 3),
scored AS (
  SELECT c.lang, c.gram, a, cut, x.f AS l, y.f AS r,
         CAST(1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN parts x ON x.lang = c.lang AND x.gram = head JOIN parts y ON y.lang = c.lang AND y.gram = tail
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.gram ORDER BY score, cut) = 1),
inner_phrases AS (
  SELECT lang, gram, max(a) AS most FROM (
    SELECT lang, array_to_string(w[:2], ' ') AS gram, a FROM found WHERE k = 3
    UNION ALL SELECT lang, array_to_string(w[2:], ' '), a FROM found WHERE k = 3) GROUP BY ALL),
kept AS (
  SELECT s.* FROM scored s LEFT JOIN inner_phrases p ON p.lang = s.lang AND p.gram = s.gram
  WHERE most IS NULL OR 100 * most < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, gram) AS rank,
       gram AS phrase, a, l, r, n, score
FROM kept JOIN sizes USING (lang) QUALIFY rank <= 2000"""

_FINITE = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

ORACLES["op12_vector_dedup"] = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE {_FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
counts AS (SELECT a AS vec_id, count(*) AS n_links FROM pairs GROUP BY a),
reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT reach.vec_id, pairs.b FROM reach JOIN pairs ON pairs.a = reach.other),
groups AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM groups LEFT JOIN counts USING (vec_id)"""


def _clusters(k: int, rounds: int) -> str:
    parts = [
        f"""kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND {_FINITE}),
centroids_0 AS (
  SELECT CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS cluster, v AS c
  FROM (SELECT sha256('1:' || vec_id) AS name, v FROM kept ORDER BY name LIMIT {k}))"""
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""assigned_{i} AS (
  SELECT vec_id, v, cluster,
         CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance
  FROM kept, centroids_{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)"""
        )
        if i < rounds:
            parts.append(
                f"""cells_{i} AS (
  SELECT cluster, i, CAST(sum(v[i]) AS HUGEINT) AS s, count(*) AS n
  FROM assigned_{i}, unnest(generate_series(1, 64)) AS t(i) GROUP BY cluster, i),
centroids_{i + 1} AS (
  SELECT cluster, coalesce(new, c) AS c FROM centroids_{i} LEFT JOIN (
    SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS new FROM cells_{i} GROUP BY cluster)
  USING (cluster))"""
            )
    return "WITH " + ",\n".join(parts)


ORACLES["op13_centroid_clusters"] = f"""{_clusters(16, 3)}
SELECT vec_id, cluster, distance,
       CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM assigned_3 JOIN centroids_3 USING (cluster)"""
