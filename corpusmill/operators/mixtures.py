"""Replay mixtures, weighted merges and token budgets; random orders are hash orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.ordering import cut, first_rows
from corpusmill.functions.text import hash_order

CHARS_A_TOKEN = 4

# The mixtures by name, as shares of the primary corpus and the replay sources.
MIXTURES = {
    "pt_only": {"pt": 1.0},
    "pt_en_5": {"pt": 0.95, "en": 0.05},
    "pt_en_10": {"pt": 0.90, "en": 0.10},
    "pt_en_15": {"pt": 0.85, "en": 0.15},
    "pt_en_code": {"pt": 0.80, "en": 0.12, "code": 0.08},
}


def in_order(rows: DataFrame, seed: str, *keys: str) -> DataFrame:
    """order_key: the place of a row in a random order."""
    return rows.withColumn("order_key", hash_order(seed, *keys))


def token_budget(rows: DataFrame, max_tokens: int, seed: str = "mixture", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows in random order up to and including the one that reaches the budget, at four characters a token.

    The end is found from keys and lengths; texts are only filtered.
    """
    place = hash_order(seed, key)
    end = cut(rows.select(place.alias("order_key"), key, F.length(text).alias("chars")), "chars", CHARS_A_TOKEN * max_tokens, key)
    return in_order(rows, seed, key).filter(end.upto(F.col("order_key"), F.col(key)))


def build_mixture(primary: DataFrame, replay: dict[str, DataFrame], ratios: dict[str, float], primary_name: str = "pt", seed: str = "mixture", max_tokens: int | None = None, key: str = "doc_id") -> DataFrame:
    """All primary rows and, per replay source, the first int(N / primary share * share) rows; key, text, part, order_key.

    Sources without rows of their own in replay are ignored.
    """
    n = primary.count()
    share = ratios.get(primary_name, 0.0)
    total = n / share if share > 0 else n
    parts = [primary.select(key, "text", F.lit(primary_name).alias("part"))]
    for name, ratio in ratios.items():
        if name != primary_name and name in replay:
            parts.append(first_rows(replay[name], int(total * ratio), key).select(key, "text", F.lit(name).alias("part")))
    mixed = in_order(reduce(DataFrame.unionByName, parts), seed, "part", key)
    return token_budget(mixed, max_tokens, seed, key) if max_tokens else mixed


def english_replay(load, n: int, key: str = "doc_id", allow_fallback: bool = False, empty: DataFrame | None = None) -> DataFrame:
    """The first n rows of what load() reads.  If it fails the error is raised, or, with allow_fallback, the one row of empty stands in."""
    try:
        return first_rows(load(), n, key)
    except Exception:
        if not allow_fallback or empty is None:
            raise
        return empty


def project_text(rows: DataFrame, text: str = "text") -> DataFrame:
    """The text column alone."""
    return rows.select(text)


def code_replay(rows: DataFrame, n: int, language: str = "lang", key: str = "doc_id") -> DataFrame:
    """n // languages rows of each language, the smallest keys first."""
    names = rows.select(language).distinct().count()
    each = n // max(1, names)
    first = Window.partitionBy(language).orderBy(key)
    return rows.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= each).drop("_n")


def weighted_merge(sources: dict[str, tuple[DataFrame, float]], seed: str = "merge", key: str = "doc_id") -> DataFrame:
    """int(rows * weight) rows of each source in random order, at most all of them; then in one random order."""
    parts = []
    for name, (rows, weight) in sources.items():
        place, taken = hash_order(f"{seed}:{name}", key), int(rows.count() * weight)
        end = cut(rows.select(place.alias("order_key"), key, F.lit(1).alias("one")), "one", taken, key)
        parts.append(rows.filter(end.upto(place, F.col(key))).withColumn("part", F.lit(name)))
    return in_order(reduce(DataFrame.unionByName, parts), seed, "part", key)


def sample_rows(rows: DataFrame, n: int, seed: str = "sample", key: str = "doc_id") -> DataFrame:
    """n rows at random without replacement; for samples that fit in a task."""
    return in_order(rows, seed, key).orderBy("order_key", key).limit(n).drop("order_key")
