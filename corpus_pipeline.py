"""From raw documents to a training mixture: five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm.decontaminate import decontaminate
from corpusmill.llm.mixing import mix_sources
from corpusmill.llm.ngram_jaccard import keep_one_per_component
from corpusmill.llm.quality_gam import keep_good
from corpusmill.llm.secrets import redact_secrets
from corpusmill.sources.tables import table
from corpusmill.sources.workdir import discard, materialize


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) one document stays."""
    return keep_one_per_component(docs, n=5, num=80, den=100)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain 0.8 or more of a benchmark item's five-word shingles go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), n=5, num=80, den=100)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; all documents stay."""
    return redact_secrets(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All sources with equal weight, in a global random order; adds copy and shuffle_key."""
    return mix_sources(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("mixing sources", mixing_sources),
]

#: SQL cannot express the classifier and the Markov models; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        if before is not None:
            discard(before)
        before = docs
    return docs
