"""Queries over documents and benchmark: cleaning, quality, duplicates, contamination, mixtures, tokens."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.functions.ordering import numbered
from corpusmill.operators import cleaning, contamination, dedup, mixtures, packing, quality
from corpusmill.plans import sql
from corpusmill.plans.registry import query
from corpusmill.sources.tables import table


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _positions(rows: DataFrame) -> DataFrame:
    """position: the place of each row in the order in which the rows come."""
    return numbered(rows, "_at", name="position").drop("_at")


# ---- A: load, clean, split -------------------------------------------------

query("length_filter", "SELECT doc_id, n_chars FROM documents WHERE length(text) BETWEEN 100 AND 500000")(lambda s, d: cleaning.length_filter(docs(s, d)).select("doc_id", "n_chars"))
query("clean_docs", f"SELECT doc_id, length({sql.CLEAN})::INT AS n_chars_clean, md5({sql.CLEAN}) AS clean_md5 FROM documents WHERE length(text) BETWEEN 100 AND 500000")(
    lambda s, d: cleaning.clean_docs(docs(s, d)).select("doc_id", F.length("text").alias("n_chars_clean"), F.md5("text").alias("clean_md5"))
)
query("email_redaction_counts", r"SELECT source, sum(len(regexp_extract_all(text, '\S+@\S+\.\S+')))::BIGINT AS n_emails FROM documents GROUP BY source")(
    lambda s, d: docs(s, d).groupBy("source").agg(F.sum(tx.count_matches(F.col("text"), r"\S+@\S+\.\S+").cast("long")).alias("n_emails"))
)
query("hash_split", f"SELECT doc_id, {sql.split_value('text')} AS value, CASE WHEN {sql.split_value('text')} < 0.1 THEN 'val' ELSE 'train' END AS split FROM documents")(
    lambda s, d: cleaning.assign_split(docs(s, d), 0.1).select("doc_id", tx.split_value(F.col("text")).alias("value"), "split")
)
query("split_counts", f"SELECT CASE WHEN {sql.split_value(sql.CLEAN)} < 0.005 THEN 'val' ELSE 'train' END AS split, count(*) AS n FROM documents WHERE length(text) BETWEEN 100 AND 500000 GROUP BY 1")(
    lambda s, d: cleaning.assign_split(cleaning.clean_docs(docs(s, d)), 0.005).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
)
query("curriculum_order", "SELECT doc_id, length(text)::INT AS n, row_number() OVER (ORDER BY length(text), doc_id) - 1 AS position FROM documents")(
    lambda s, d: cleaning.curriculum(docs(s, d)).select("doc_id", F.length("text").alias("n"), F.monotonically_increasing_id().alias("_at")).transform(_positions)
)

# ---- B: quality ------------------------------------------------------------

FIELDS = "doc_id, n_chars, n_words, n_sentences, language, domain, quality_score, has_pii, toxicity_score, raw_index, cluster_id"
KEPT = "quality_score >= 0.5 AND language = 'en' AND toxicity_score <= 0.5 AND NOT has_pii AND raw_index = cluster_id"
MEAN = "round(sum(round({0} * 1000000)::BIGINT)::DOUBLE / count(*) / 1000000, 4)"


def manifest(spark: SparkSession, d: str) -> DataFrame:
    raw = docs(spark, d)
    return quality.manifest(raw, dedup.exact_clusters(raw), domain="source")


query("quality_manifest", f"WITH {sql.MANIFEST} SELECT {FIELDS}, raw_index <> cluster_id AS is_duplicate FROM m")(manifest)
query("quality_filter", f"WITH {sql.MANIFEST} SELECT raw_index, quality_score FROM m WHERE {KEPT}")(
    lambda s, d: quality.quality_filter(manifest(s, d), 0.5, ["en"], 0.5, drop_pii=True).select("raw_index", "quality_score")
)
query(
    "domain_stats",
    f"WITH {sql.MANIFEST} SELECT domain, count(*) AS n_docs, {MEAN.format('quality_score')} AS avg_quality, round(sum(n_words)::DOUBLE / count(*), 2) AS avg_words, count(*) FILTER (has_pii) AS pii_count, {MEAN.format('toxicity_score')} AS avg_toxicity,"
    " count(*) FILTER (language = 'pt') AS n_pt, count(*) FILTER (language = 'en') AS n_en, count(*) FILTER (language = 'outro') AS n_outro FROM m GROUP BY domain",
)(lambda s, d: quality.domain_stats(quality.manifest(docs(s, d), domain="source")))
CONFIG = {"min_quality_score": 0.6, "language_id": {"enabled": True, "target_language": "en"}, "toxicity_filter": {"enabled": True, "max_toxicity_score": 0.5}, "pii_filter": {"enabled": True, "action": "remove"}}
query("quality_config_filter", f"WITH {sql.MANIFEST} SELECT raw_index FROM m WHERE quality_score >= 0.6 AND language = 'en' AND toxicity_score <= 0.5 AND NOT has_pii AND raw_index = cluster_id")(
    lambda s, d: quality.filter_from_config(manifest(s, d), CONFIG).select("raw_index")
)
query("manifest_without_empty_texts", "SELECT doc_id AS raw_index, length(text)::INT AS n_chars FROM documents WHERE doc_id % 7 <> 0 AND text <> ''")(
    lambda s, d: quality.manifest(docs(s, d).withColumn("text", F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("text")))).select("raw_index", "n_chars")
)
query("global_stats", f"WITH {sql.MANIFEST} SELECT count(*) AS total_documents, count(*) FILTER (has_pii) AS total_pii, count(*) FILTER (raw_index <> cluster_id) AS total_duplicates, string_agg(DISTINCT domain, ',' ORDER BY domain) AS domains FROM m")(
    lambda s, d: quality.global_stats(manifest(s, d))
)
query("language_histogram", f"WITH {sql.MANIFEST} SELECT domain, language, count(*) AS n FROM m GROUP BY 1, 2")(lambda s, d: quality.manifest(docs(s, d), domain="source").groupBy("domain", "language").agg(F.count(F.lit(1)).alias("n")))
query("pii_breakdown", "SELECT " + ", ".join(f"count(*) FILTER (regexp_matches(text, '{p}')) AS n_{k}" for k, p in quality.PII.items()) + " FROM documents")(lambda s, d: quality.pii_breakdown(docs(s, d)))
query("toxicity_scores", f"WITH {sql.MANIFEST} SELECT raw_index, toxicity_score FROM m")(lambda s, d: quality.manifest(docs(s, d), domain="source").select("raw_index", "toxicity_score"))

# ---- C: duplicates and splits ----------------------------------------------

LOWER_WORDS = sql.words("lower(text)")
CLUSTERS = f"k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY CASE WHEN len({LOWER_WORDS}) = 0 THEN '#' || doc_id ELSE md5(array_to_string({LOWER_WORDS}, ' ')) END) AS cluster_id FROM documents)"
PAIRS = f"""s AS (SELECT doc_id, unnest({sql.ngrams("w", 5)}) AS g FROM (SELECT doc_id, {LOWER_WORDS} AS w FROM documents JOIN k USING (doc_id) WHERE doc_id = cluster_id AND len({LOWER_WORDS}) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), j AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
p AS (SELECT a, b, c::DOUBLE / (na.n + nb.n - c) AS jaccard FROM j JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE c::DOUBLE / (na.n + nb.n - c) >= 0.8)"""

query("exact_clusters", f"WITH {CLUSTERS} SELECT * FROM k")(lambda s, d: dedup.exact_clusters(docs(s, d)))
query(
    "dedup_stats",
    f"WITH {CLUSTERS}, t AS (SELECT count(*) AS o, count(DISTINCT cluster_id) AS c FROM k) SELECT c AS n_clusters, o - c AS n_duplicates_removed, round((o - c)::DOUBLE / greatest(o, 1), 4) AS dedup_ratio, o AS n_original, c AS n_unique, 'exact' AS method FROM t",
)(lambda s, d: dedup.dedup_stats(dedup.exact_clusters(docs(s, d))))
query("near_dup_pairs", f"WITH {CLUSTERS}, {PAIRS} SELECT a, b, jaccard, false AS same FROM p UNION ALL SELECT cluster_id, doc_id, 1.0::DOUBLE, true FROM k WHERE doc_id <> cluster_id")(
    lambda s, d: dedup.near_duplicate_pairs(docs(s, d))
)


# documents in order take their unclaimed neighbours; copies go with their class
STARS = f"""{CLUSTERS}, {PAIRS}, v AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM k WHERE doc_id = cluster_id),
r AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS centres UNION ALL
  SELECT r.i + 1, CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.b = v.doc_id AND list_contains(r.centres, p.a)) THEN r.centres ELSE list_append(r.centres, v.doc_id) END FROM r JOIN v ON v.i = r.i + 1),
z AS (SELECT centres FROM r ORDER BY i DESC LIMIT 1),
g AS (SELECT v.doc_id AS class, CASE WHEN list_contains(centres, v.doc_id) THEN v.doc_id ELSE (SELECT min(p.a) FROM p WHERE p.b = v.doc_id AND list_contains(z.centres, p.a)) END AS star FROM v, z),
n2 AS (SELECT k.doc_id, g.star AS cluster_id FROM k JOIN g ON k.cluster_id = g.class)"""
query("star_clusters", f"WITH RECURSIVE {STARS} SELECT * FROM n2")(lambda s, d: dedup.near_duplicate_clusters(docs(s, d)))
query("lsh_clusters")(lambda s, d: dedup.build_clusters(docs(s, d), "lsh"))  # MinHash values differ from SQL's


ORDERED = f"""h AS (SELECT cluster_id, count(*) AS n, {sql.order_key("'split'", "cluster_id")} AS o FROM k GROUP BY cluster_id),
q AS (SELECT *, sum(n) OVER (ORDER BY o, cluster_id) - n AS prior FROM h), t AS (SELECT greatest(1, floor(sum(n) * 0.1::DOUBLE)) AS want FROM h),
v AS (SELECT sum(n) AS val FROM q, t WHERE prior < want),
f AS (SELECT doc_id, k.cluster_id, CASE WHEN prior < want THEN 'validation' WHEN prior - val < want THEN 'test' ELSE 'train' END AS split FROM k JOIN q USING (cluster_id), t, v)"""
query("cluster_split", f"WITH {CLUSTERS}, {ORDERED} SELECT doc_id, cluster_id, split FROM f")(lambda s, d: dedup.split_by_clusters(dedup.exact_clusters(docs(s, d)), 0.1, 0.1))
query(
    "split_stats",
    f"WITH {CLUSTERS}, {ORDERED} SELECT count(*) AS raw_count, count(*) AS post_filter_count, count(*) FILTER (split = 'train') AS train_count, count(*) FILTER (split = 'validation') AS val_count, count(*) FILTER (split = 'test') AS test_count, round(count(*) FILTER (split = 'train')::DOUBLE / count(*), 4) AS train_ratio FROM f",
)(lambda s, d: dedup.split_stats(dedup.split_by_clusters(dedup.exact_clusters(docs(s, d)), 0.1, 0.1)))

# with near copies; the queries above know exact copies alone
FUZZY_ORDERED = ORDERED.replace("FROM k GROUP BY", "FROM n2 GROUP BY").replace("k.cluster_id", "n2.cluster_id").replace("FROM k JOIN q", "FROM n2 JOIN q").replace("v AS (SELECT sum", "u AS (SELECT sum").replace("t, v)", "t, u)")
query("cluster_split_fuzzy", f"WITH RECURSIVE {STARS}, {FUZZY_ORDERED} SELECT doc_id, cluster_id, split FROM f")(lambda s, d: dedup.split_by_clusters(dedup.near_duplicate_clusters(docs(s, d)), 0.1, 0.1))


def signatures(spark: SparkSession, d: str) -> DataFrame:
    return dedup.minhash(dedup.shingle_sets(docs(spark, d)))


query("minhash_signature")(signatures)  # hashes differ from SQL's
query("lsh_candidates")(lambda s, d: dedup.lsh_candidates(signatures(s, d)))  # as above

# ---- D: contamination ------------------------------------------------------


# Every benchmark item stands among the documents too, as it is, shouted, or with words after it (ids -1, -2, ...).
PLANTED = "SELECT -1 - item_id AS doc_id, CASE item_id % 3 WHEN 0 THEN text WHEN 1 THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || '!?' ELSE text || ' and some more words' END AS text FROM benchmark"


def planted(spark: SparkSession, d: str) -> DataFrame:
    items, t = table(spark, d, "benchmark"), F.col("text")
    text = F.when(F.col("item_id") % 3 == 0, t).when(F.col("item_id") % 3 == 1, F.concat(F.translate(t, ascii_lowercase, ascii_uppercase), F.lit("!?"))).otherwise(F.concat(t, F.lit(" and some more words")))
    return docs(spark, d).select("doc_id", "text").union(items.select(-1 - F.col("item_id"), text))


def norms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return contamination.normalized(planted(spark, d), "doc_id"), contamination.normalized(table(spark, d, "benchmark"), "item_id")


NORMS = f"a AS (SELECT doc_id, {sql.normal('text')} AS norm FROM (SELECT doc_id, text FROM documents UNION ALL {PLANTED})), b AS (SELECT item_id, {sql.normal('text')} AS norm FROM benchmark)"
GRAMS = lambda n: f"ag AS (SELECT doc_id, {sql.ngrams('w', n)} AS g FROM (SELECT doc_id, {sql.words('norm')} AS w FROM a)), bg AS (SELECT item_id, {sql.ngrams('w', n)} AS g FROM (SELECT item_id, {sql.words('norm')} AS w FROM b))"
OVERLAP = f"{NORMS}, {GRAMS(10)}, kg AS (SELECT DISTINCT unnest(g) AS x FROM bg), e AS (SELECT doc_id, unnest(g) AS x FROM ag), hit AS (SELECT doc_id, count(*) AS n_shared FROM e JOIN kg USING (x) GROUP BY doc_id), o AS (SELECT doc_id, len(g) AS n_ngrams, coalesce(n_shared, 0) AS n_shared, coalesce(n_shared, 0)::DOUBLE / len(g) AS overlap FROM ag LEFT JOIN hit USING (doc_id))"

query("contam_exact", f"WITH {NORMS} SELECT doc_id FROM a WHERE sha256(norm) IN (SELECT sha256(norm) FROM b)")(lambda s, d: contamination.exact_matches(*norms(s, d)))
query("contam_normalized", f"WITH {NORMS} SELECT doc_id FROM a WHERE norm IN (SELECT norm FROM b)")(lambda s, d: contamination.normalized_matches(*norms(s, d)))
query("contam_ngram_overlap", f"WITH {OVERLAP} SELECT * FROM o")(lambda s, d: contamination.ngram_overlap(*norms(s, d)))
query(
    "contam_fuzzy_jaccard",
    f"WITH {NORMS}, {GRAMS(5)}, x AS (SELECT doc_id, len(g) AS n, unnest(g) AS y FROM ag), z AS (SELECT item_id, len(g) AS n, unnest(g) AS y FROM bg), j AS (SELECT doc_id, item_id, count(*)::DOUBLE / (any_value(x.n) + any_value(z.n) - count(*)) AS jaccard FROM x JOIN z USING (y) GROUP BY 1, 2),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY jaccard DESC, item_id) AS k FROM j) SELECT doc_id, item_id, jaccard FROM r WHERE k = 1",
)(lambda s, d: contamination.fuzzy_matches(*norms(s, d)))
query("contam_fuzzy_lsh")(lambda s, d: contamination.fuzzy_lsh(*norms(s, d)))  # estimates from signatures


@query(
    "contam_summary",
    f"WITH {OVERLAP}, t AS (SELECT count(*) AS n_checked FROM a), m AS (SELECT 'exact' AS method, count(*) AS n_matches FROM a WHERE norm IN (SELECT norm FROM b) UNION ALL SELECT 'normalized', count(*) FROM a WHERE norm IN (SELECT norm FROM b) UNION ALL SELECT 'ngram', count(*) FROM o WHERE overlap >= 0.1)"
    " SELECT method, n_checked, n_matches, n_matches::DOUBLE / greatest(n_checked, 1) AS rate FROM m, t",
)
def contam_summary(spark: SparkSession, d: str) -> DataFrame:
    a, b = norms(spark, d)
    return contamination.summary(a, exact=contamination.exact_matches(a, b), normalized=contamination.normalized_matches(a, b), ngram=contamination.ngram_overlap(a, b).filter("overlap >= 0.1"))


query("benchmark_flatten", "SELECT item_id, text || ' ' || 'A' || ' ' || 'B' AS text FROM benchmark")(
    lambda s, d: contamination.flatten_items(table(s, d, "benchmark").withColumn("options", F.array(F.lit("A"), F.lit("B"))), ["text"], ["options"]).select("item_id", "text")
)

# ---- E: mixtures -----------------------------------------------------------

PARTS = "p AS (SELECT doc_id, text FROM documents WHERE lang = 'en'), c AS (SELECT count(*) AS n FROM p)"


def _mixture(name: str, sources: dict[str, str]):
    def run(spark: SparkSession, d: str) -> DataFrame:
        raw = docs(spark, d)
        replay = {k: raw.filter(F.col("lang") == v) for k, v in sources.items()}
        return mixtures.build_mixture(raw.filter("lang = 'en'"), replay, mixtures.MIXTURES[name]).select("doc_id", "part", "order_key")

    return run


def _mixture_sql(name: str, sources: dict[str, str]) -> str:
    ratios = mixtures.MIXTURES[name]
    take = lambda k, v: f"SELECT doc_id, '{k}' AS part FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM documents WHERE lang = '{v}'), c WHERE i <= floor(n / {ratios['pt']}::DOUBLE * {ratios[k]}::DOUBLE)"
    union = " UNION ALL ".join(["SELECT doc_id, 'pt' AS part FROM p", *(take(k, v) for k, v in sources.items() if k in ratios)])
    return f"WITH {PARTS}, u AS ({union}) SELECT doc_id, part, {sql.order_key(sql.q('mixture'), 'part', 'doc_id')} AS order_key FROM u"


for _name, _sources in (("pt_only", {"en": "fr"}), ("pt_en_5", {"en": "fr"}), ("pt_en_10", {"en": "fr"}), ("pt_en_15", {"en": "fr"}), ("pt_en_code", {"en": "fr", "code": "de"})):
    query(f"mixture_{_name}", _mixture_sql(_name, _sources))(_mixture(_name, _sources))
query(
    "token_budget_cut",
    f"WITH o AS (SELECT doc_id, length(text) AS n, {sql.order_key(sql.q('mixture'), 'doc_id')} AS order_key FROM documents), r AS (SELECT *, sum(n) OVER (ORDER BY order_key, doc_id) - n AS prior FROM o) SELECT doc_id, order_key FROM r WHERE prior < 400000",
)(lambda s, d: mixtures.token_budget(docs(s, d), 100_000).select("doc_id", "order_key"))
query(
    "weighted_merge",
    "WITH " + ", ".join(f"{k} AS (SELECT doc_id, row_number() OVER (ORDER BY {sql.order_key(sql.q('merge:' + k), 'doc_id')}, doc_id) AS i, count(*) OVER () AS n FROM documents WHERE lang = '{k}')" for k in ("en", "fr"))
    + f", u AS (SELECT doc_id, 'en' AS part FROM en WHERE i <= floor(n * 0.5::DOUBLE) UNION ALL SELECT doc_id, 'fr' FROM fr) SELECT doc_id, part, {sql.order_key(sql.q('merge'), 'part', 'doc_id')} AS order_key FROM u",
)(lambda s, d: mixtures.weighted_merge({"en": (docs(s, d).filter("lang = 'en'"), 0.5), "fr": (docs(s, d).filter("lang = 'fr'"), 1.5)}).select("doc_id", "part", "order_key"))
query("code_replay", "WITH g AS (SELECT count(DISTINCT lang) AS k FROM documents), r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents) SELECT doc_id, lang FROM r, g WHERE i <= 100 // k")(
    lambda s, d: mixtures.code_replay(docs(s, d), 100).select("doc_id", "lang")
)
query("random_sample", f"SELECT doc_id FROM (SELECT doc_id, {sql.order_key(sql.q('sample'), 'doc_id')} AS o FROM documents) ORDER BY o, doc_id LIMIT 100")(lambda s, d: mixtures.sample_rows(docs(s, d), 100).select("doc_id"))

# ---- F: tokens -------------------------------------------------------------

FERTILITY = f"""t AS (SELECT lang, length(text) AS chars, {sql.words('text')} AS w FROM documents), r AS (SELECT lang, round(len(w)::DOUBLE / chars * 1000000000)::HUGEINT AS c, w FROM t WHERE chars > 0 AND len(w) > 0),
f AS (SELECT lang, round(sum(c)::DOUBLE / count(*) / 1e9::DOUBLE, 6) AS tokens_per_char, round(sqrt(greatest(sum(c * c)::DOUBLE / count(*) - (sum(c)::DOUBLE / count(*)) * (sum(c)::DOUBLE / count(*)), 0)) / 1e9::DOUBLE, 6) AS tokens_per_char_std, 1.0::DOUBLE AS tokens_per_word, 0.0::DOUBLE AS tokens_per_word_std, count(*) AS n_texts FROM r GROUP BY GROUPING SETS ((lang), ())),
l AS (SELECT sum(n)::DOUBLE / count(*) AS mean_token_length, median(n) AS median_token_length FROM (SELECT unnest(list_transform(w[1:1000], lambda x: length(x))) AS n FROM r))"""
query("fertility", f"WITH {FERTILITY} SELECT f.* EXCLUDE (lang), mean_token_length, median_token_length FROM f, l WHERE lang IS NULL")(lambda s, d: packing.fertility(docs(s, d)))
query("fertility_compare", f"WITH {FERTILITY} SELECT a.tokens_per_char / greatest(b.tokens_per_char, 1e-8) AS fertility_ratio, (a.tokens_per_char - b.tokens_per_char) / greatest(b.tokens_per_char, 1e-8) * 100 AS gap_pct FROM f a, f b WHERE a.lang = 'en' AND b.lang = 'de'")(
    lambda s, d: packing.compare_fertility(packing.fertility(docs(s, d).filter("lang = 'en'")), packing.fertility(docs(s, d).filter("lang = 'de'")), "tokens_per_char")
)
# a fold over the documents of a batch gives offsets; sequences are compared by digests of their ids and labels
PACKED = f"""w AS (SELECT doc_id // 1000 AS batch, row_number() OVER (PARTITION BY doc_id // 1000 ORDER BY doc_id) AS i, list_transform({sql.words('text')}, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT % 32000 + 1) AS t FROM documents),
r AS (SELECT DISTINCT batch, 0::BIGINT AS i, 0::BIGINT AS start, 0::BIGINT AS gap, 0::BIGINT AS off FROM w
  UNION ALL SELECT w.batch, w.i, off + (off % 512 <> 0)::INT, (off % 512 <> 0)::INT, off + (off % 512 <> 0)::INT + len(t) FROM r JOIN w ON w.batch = r.batch AND w.i = r.i + 1),
p AS (SELECT batch, start + k - 1 AS place, t[k] AS id, false AS e FROM (SELECT r.batch, start, t, unnest(range(1, len(t) + 1)) AS k FROM r JOIN w ON w.batch = r.batch AND w.i = r.i) UNION ALL SELECT batch, start - 1, 0, true FROM r WHERE gap = 1),
s AS (SELECT batch, place // 512 AS seq, place, id, CASE WHEN e OR lag(e, 1, false) OVER (PARTITION BY batch, place // 512 ORDER BY place) THEN -100 ELSE id END AS label FROM p)"""
query("packed_sequences", f"WITH RECURSIVE {PACKED} SELECT batch, seq, md5(string_agg(id::VARCHAR, ',' ORDER BY place)) AS ids_md5, md5(string_agg(label::VARCHAR, ',' ORDER BY place)) AS labels_md5 FROM s GROUP BY batch, seq HAVING count(*) = 512")(
    lambda s, d: packing.pack(packing.word_ids(docs(s, d)), 512, 0).select("batch", "seq", *[F.md5(F.array_join(F.col(c).cast("array<string>"), ",")).alias(name) for c, name in (("input_ids", "ids_md5"), ("labels", "labels_md5"))])
)
