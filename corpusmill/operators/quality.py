"""Quality signals of documents: language, personal data, toxicity, score; the manifest, its filter and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import SPACE, count_matches, let, strip, words

# Frequent words of two languages, and words that count as toxic.
PT_WORDS = """
de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua
ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ter seus
quem nas me esse eles estão você tinha foram essa num nem suas meu às minha têm numa pelos elas havia seja
qual será nós tenho lhe deles essas esses pelas este fosse dele tu te vocês vos lhes meus minhas teu tua teus
tuas nosso nossa nossos nossas dela delas esta estes estas aquele aquela aqueles aquelas isto aquilo
""".split()
EN_WORDS = """
the be to of and a in that have i it for not on with he as you do at this but his by from they we say her she
or an will my one all would there their what so up out if about who get which go me when make can like time no
just him know take people into year your good some could them see other than then
""".split()
TOXIC_WORDS = """
idiota imbecil burro estúpido lixo nojento merda porra caralho puta fdp arrombado desgraçado vagabundo cretino
otário babaca
""".split()

# Patterns of personal data.
PII = {
    "cpf": r"\b\d{3}[.\-]?\d{3}[.\-]?\d{3}[.\-/]?\d{2}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b(?:\+55\s?)?(?:\(?\d{2}\)?\s?)?\d{4,5}[-.\s]?\d{4}\b",
    "card": r"\b\d{4}[\s.-]?\d{4}[\s.-]?\d{4}[\s.-]?\d{4}\b",
}
#: Java's classes are ASCII unless told otherwise.
UNICODE = "(?U)"
DEFAULT_DOMAIN = "geral"


def n_sentences(text: Column) -> Column:
    """Runs of sentence ends; at least one if there is anything but white space."""
    return F.when(strip(text) == "", F.lit(0)).otherwise(F.greatest(count_matches(text, "[.!?]+"), F.lit(1)))


def language(w: Column) -> Column:
    """pt, en or outro: the larger share of frequent words among the distinct lower-case words, if over 0.05."""
    return let(F.array_distinct(F.transform(w, F.lower)), _language)


def _language(seen: Column) -> Column:
    size = F.greatest(F.size(seen), F.lit(1))
    pt, en = (F.size(F.filter(seen, lambda x: x.isin(words))) / size for words in (PT_WORDS, EN_WORDS))
    return F.when((pt > en) & (pt > 0.05), "pt").when((en > pt) & (en > 0.05), "en").otherwise("outro")


def has_pii(text: Column) -> Column:
    """Whether a pattern of PII occurs; texts without an @ or three digits in a row are not searched."""
    numbers = F.lit(False)
    for name, pattern in PII.items():
        if name != "email":
            numbers = numbers | text.rlike(UNICODE + pattern)
    return (F.contains(text, F.lit("@")) & text.rlike(UNICODE + PII["email"])) | (text.rlike(UNICODE + r"\d{3}") & numbers)


def toxicity(w: Column) -> Column:
    """Ten times the share of toxic words, 1 at most; marks .,!?;: around a word do not count."""
    return _toxicity(F.transform(w, F.lower))


def _toxicity(lower: Column) -> Column:
    return let(lower, lambda w: F.when(F.size(w) == 0, F.lit(0.0)).otherwise(F.least(F.size(F.filter(w, lambda x: F.btrim(x, F.lit(".,!?;:")).isin(TOXIC_WORDS))) / F.size(w) * 10, F.lit(1.0))))


def quality_score(text: Column, n_chars: Column, n_words: Column, sentences: Column) -> Column:
    """0.3 length + 0.3 sentence length + 0.2 special characters + 0.2 capitals, in steps."""
    length = F.when(n_words < 10, 0.1).when(n_words < 50, 0.4).when(n_words <= 5000, 1.0).otherwise(0.7)
    mean = n_words / sentences
    sentence = F.when(sentences == 0, 0.2).when((mean >= 10) & (mean <= 25), 1.0).when((mean >= 5) & (mean <= 40), 0.6).otherwise(0.3)
    special = F.length(F.regexp_replace(text, rf"[\p{{L}}\p{{N}}{SPACE[1:-1]}]+", "")) / F.greatest(n_chars, F.lit(1))
    special = F.when(special < 0.1, 1.0).when(special < 0.2, 0.7).when(special < 0.4, 0.4).otherwise(0.1)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    capitals = F.length(F.regexp_replace(text, r"[^\p{IsUppercase}]+", "")) / letters
    capitals = F.when(letters == 0, 0.5).when(capitals < 0.3, 1.0).when(capitals < 0.5, 0.5).otherwise(0.1)
    score = 0.3 * length + 0.3 * sentence + 0.2 * special + 0.2 * capitals
    return F.when(n_words == 0, F.lit(0.0)).otherwise(F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 4))


def content_id(index: Column, text: Column) -> Column:
    return F.concat(F.lit("doc_"), F.lpad(index.cast("string"), 6, "0"), F.lit("_"), F.substring(F.md5(text.cast("binary")), 1, 12))


def manifest(docs: DataFrame, clusters: DataFrame | None = None, key: str = "doc_id", text: str = "text", domain: str | None = None) -> DataFrame:
    """One row of quality signals a document; empty texts are skipped, blank ones are not.

    clusters (key, cluster_id) fills cluster_id and is_duplicate (not the first of its cluster).
    """
    name = F.col(domain) if domain else F.lit(DEFAULT_DOMAIN)
    base = docs.filter(F.col(text) != "").select(F.col(key).alias("raw_index"), F.col(text).alias("_text"), name.alias("domain"), words(F.lower(text)).alias("_words"))
    base = base.withColumns({"n_chars": F.length("_text"), "n_words": F.size("_words"), "n_sentences": n_sentences(F.col("_text"))})
    out = base.select(
        content_id(F.col("raw_index"), F.col("_text")).alias("doc_id"),
        "n_chars",
        "n_words",
        "n_sentences",
        let(F.array_distinct("_words"), _language).alias("language"),
        "domain",
        quality_score(F.col("_text"), F.col("n_chars"), F.col("n_words"), F.col("n_sentences")).alias("quality_score"),
        has_pii(F.col("_text")).alias("has_pii"),
        _toxicity(F.col("_words")).alias("toxicity_score"),
        "raw_index",
    )
    if clusters is None:
        return out.withColumns({"cluster_id": F.lit(None).cast("long"), "is_duplicate": F.lit(False)})
    joined = out.join(clusters.select(F.col(key).alias("raw_index"), "cluster_id"), "raw_index", "left")
    return joined.withColumn("is_duplicate", F.coalesce(F.col("raw_index") != F.col("cluster_id"), F.lit(False)))


def quality_filter(rows: DataFrame, min_quality: float = 0.3, languages: list[str] | None = None, max_toxicity: float = 1.0, drop_pii: bool = False, drop_duplicates: bool = True) -> DataFrame:
    keep = (F.col("quality_score") >= min_quality) & (F.col("toxicity_score") <= max_toxicity)
    if languages:
        keep = keep & F.col("language").isin(languages)
    if drop_pii:
        keep = keep & ~F.col("has_pii")
    if drop_duplicates:
        keep = keep & ~F.col("is_duplicate")
    return rows.filter(keep)


def filter_from_config(rows: DataFrame, config: dict) -> DataFrame:
    """The filter that a configuration asks for: parts that are not enabled do not filter."""
    part = lambda name: config.get(name) or {}
    lang, toxic, pii = part("language_id"), part("toxicity_filter"), part("pii_filter")
    return quality_filter(
        rows,
        min_quality=config.get("min_quality_score", 0.3),
        languages=[lang.get("target_language", "pt")] if lang.get("enabled", True) else None,
        max_toxicity=toxic.get("max_toxicity_score", 1.0) if toxic.get("enabled", True) else 1.0,
        drop_pii=bool(pii.get("enabled")) and pii.get("action") == "remove",
    )


def _mean(column: str, digits: int) -> Column:
    """A mean that does not hang on the order of rows: sums of whole 10^-6 parts."""
    return F.round(F.sum(F.round(F.col(column) * 1_000_000).cast("long")) / F.count(F.lit(1)) / 1_000_000, digits)


def domain_stats(rows: DataFrame) -> DataFrame:
    """Per domain: counts, means, personal data and the number of documents in each language."""
    return rows.groupBy("domain").agg(
        F.count(F.lit(1)).alias("n_docs"),
        _mean("quality_score", 4).alias("avg_quality"),
        F.round(F.sum("n_words") / F.count(F.lit(1)), 2).alias("avg_words"),
        F.sum(F.col("has_pii").cast("long")).alias("pii_count"),
        _mean("toxicity_score", 4).alias("avg_toxicity"),
        *[F.sum((F.col("language") == x).cast("long")).alias(f"n_{x}") for x in ("pt", "en", "outro")],
    )


def global_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("total_documents"),
        F.coalesce(F.sum(F.col("has_pii").cast("long")), F.lit(0)).alias("total_pii"),
        F.coalesce(F.sum(F.col("is_duplicate").cast("long")), F.lit(0)).alias("total_duplicates"),
        F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("domains"),
    )


def pii_breakdown(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.agg(*[F.sum(F.col(text).rlike(UNICODE + p).cast("long")).alias(f"n_{k}") for k, p in PII.items()])
