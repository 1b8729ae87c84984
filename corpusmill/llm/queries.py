"""The queries of the llm operators over the driver's tables, and their SQL twins where SQL can express them.

Without a SQL twin, and tested against brute force or held-out labels instead:
op5 (dynamic programming), op6 (a trained model), the added spans of op8 (a trained model; op8_base_spans has the others).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import decontaminate, exact_topk, license_scan, mixing, quality_gam, role_repair, secrets, url_filter, warc
from corpusmill.llm.ngram_jaccard import similarity_links
from corpusmill.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: (action, host, path prefix)
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@query
def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = exact_topk.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256)
    return exact_topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


@query
def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.warc_round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op5_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_repair.repair_turns(table(spark, sf_dir, "conversations"))


@query
def op6_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.containment_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


@query
def op8_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents")).drop("spans")


@query
def op9_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


@query
def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_links(table(spark, sf_dir, "documents").select("doc_id", "text"), n=4, num=85, den=100)


ORACLES["op1_url_filters"] = """
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) AS v(action, h, q)),
m AS (
  SELECT page_id, host, path, h || q AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC NULLS LAST) AS n
  FROM p LEFT JOIN r ON (host = h OR host LIKE '%.' || h) AND starts_with(path, q))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE n = 1
"""
ORACLES["op2_mix_sources"] = mixing.MIX_SQL
ORACLES["op3_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
ORACLES["op4_warc_revisits"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100
"""
ORACLES["op7_decontamination"] = decontaminate.CONTAINMENT_SQL
# RE2's (?i) would fold letters beyond ASCII
ASSIGN_SQL = r"""'([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'"""
ORACLES["op8_base_spans"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id, 0 AS k, regexp_split_to_array(t, PATTERN_0) AS gaps, regexp_extract_all(t, PATTERN_0) AS hits, regexp_extract_all(t, PATTERN_0, 2) AS parts FROM t
  UNION ALL SELECT doc_id, 1, regexp_split_to_array(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+') FROM t WHERE contains(t, 'AKIA')
  UNION ALL SELECT doc_id, 2, regexp_split_to_array(t, '[0-9a-f]{32,}'), regexp_extract_all(t, '[0-9a-f]{32,}'), regexp_extract_all(t, '[0-9a-f]{32,}') FROM t),
i AS (SELECT doc_id, k, gaps, hits, parts, unnest(range(1, len(hits) + 1)) AS i FROM m),
s AS (
  SELECT doc_id, k, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a, length(hits[i]) AS n
  FROM i WHERE length(parts[i]) >= CASE k WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 32 END),
w AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(CASE k WHEN 0 THEN 'assign' WHEN 1 THEN 'access' ELSE 'hex' END || ':' || a || ':' || (a + n), ',' ORDER BY a, k) AS spans
  FROM s GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256
FROM t LEFT JOIN w ON t.doc_id = w.doc_id
""".replace("PATTERN_0", ASSIGN_SQL)
ORACLES["op9_license_digests"] = license_scan.license_sql()
ORACLES["op10_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.other = l.x),
m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id),
k AS (SELECT x AS doc_id, count(*) AS n_links FROM l GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links FROM m LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
