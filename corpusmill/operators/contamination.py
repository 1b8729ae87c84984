"""Overlap between a corpus and evaluation sets, by four methods."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.shingles import sets_of
from corpusmill.functions.text import normalize
from corpusmill.operators.dedup import PERMUTATIONS, bands_and_rows, minhash
from corpusmill.sources.workdir import materialize

NGRAM, OVERLAP, SHINGLE, FUZZY, INDEX = 10, 0.5, 5, 0.7, 0.5
DETAILS = 100
#: Distinct n-grams of the items up to this number (8 bytes each) are broadcast; more are joined by shuffle.
MAX_BROADCAST_GRAMS = 2_000_000


def normalized(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, norm: written, so that all methods read it and none computes it again."""
    return materialize(rows.select(key, normalize(F.col(text)).alias("norm")), "norm")


def exact_matches(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id of documents whose normal form has the SHA-256 of a benchmark item's."""
    h = lambda d: d.withColumn("h", F.sha2("norm", 256))
    return h(docs).join(h(bench).select("h").distinct(), "h", "left_semi").select("doc_id")


def normalized_matches(docs: DataFrame, bench: DataFrame) -> DataFrame:
    return docs.join(bench.select("norm").distinct(), "norm", "left_semi").select("doc_id")


def gram_sets(rows: DataFrame, key: str, n: int) -> DataFrame:
    """key, s: distinct 64-bit hashes of the n-grams of norm; fewer words are one gram, none an empty one."""
    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "norm").mapInArrow(sets_of(n, empty=True), f"key {kind}, s array<bigint>").withColumnRenamed("key", key)


def shared_grams(docs: DataFrame, bench: DataFrame, n: int) -> DataFrame:
    """doc_id, n_grams, s: the hashes that any item has too.

    The items' hashes go to all tasks if they are few, so that documents stay
    where they are; else documents' hashes meet them by a shuffle.
    """
    known = gram_sets(bench, "item_id", n).select(F.explode("s").alias("h")).distinct()
    sets = gram_sets(docs, "doc_id", n)
    few = known.limit(MAX_BROADCAST_GRAMS + 1)
    if few.count() > MAX_BROADCAST_GRAMS:
        spread = sets.select("doc_id", F.size("s").cast("long").alias("n_grams"), F.explode("s").alias("h"))
        return spread.join(known.withColumn("found", F.lit(True)), "h", "left").groupBy("doc_id", "n_grams").agg(F.collect_list(F.when(F.col("found"), F.col("h"))).alias("s"))
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r["h"] for r in few.collect()], dtype=np.int64).view(np.uint64)))

    def hits(batches):
        for batch in batches:
            s = batch.column(1)
            flat, ends = s.flatten().to_numpy(zero_copy_only=False), s.offsets.to_numpy() - s.offsets[0].as_py()
            found = np.isin(flat.view(np.uint64), shared.value)
            upto = np.concatenate([[0], np.cumsum(found)])[ends]
            kept = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(flat[found], pa.int64()))
            yield pa.record_batch([batch.column(0), pa.array(np.diff(ends), pa.int64()), kept], ["doc_id", "n_grams", "s"])

    return sets.mapInArrow(hits, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_grams long, s array<bigint>")


def ngram_overlap(docs: DataFrame, bench: DataFrame, n: int = NGRAM) -> DataFrame:
    """doc_id, n_ngrams, n_shared, overlap: share of a document's distinct n-grams that any item has."""
    out = shared_grams(docs, bench, n).select("doc_id", F.col("n_grams").alias("n_ngrams"), F.size("s").cast("long").alias("n_shared"))
    return out.withColumn("overlap", F.col("n_shared") / F.col("n_ngrams"))


def fuzzy_matches(docs: DataFrame, bench: DataFrame, n: int = SHINGLE, threshold: float = 0.0) -> DataFrame:
    """doc_id, item_id, jaccard of each document's most similar item (then smallest item_id), exactly.

    Only the hashes that an item has are joined; a hash of many items meets
    each document that has it once.
    """
    items = gram_sets(bench, "item_id", n).select("item_id", F.size("s").alias("b_n"), F.explode("s").alias("h"))
    hits = shared_grams(docs, bench, n).select("doc_id", F.col("n_grams").alias("a_n"), F.explode("s").alias("h"))
    shared = hits.join(items, "h").groupBy("doc_id", "a_n", "item_id", "b_n").agg(F.count(F.lit(1)).alias("shared"))
    scored = shared.withColumn("jaccard", F.col("shared") / (F.col("a_n") + F.col("b_n") - F.col("shared"))).filter(F.col("jaccard") >= threshold)
    best = scored.groupBy("doc_id").agg(F.max(F.struct("jaccard", (-F.col("item_id")).alias("i"))).alias("m"))
    return best.select("doc_id", (-F.col("m.i")).alias("item_id"), F.col("m.jaccard").alias("jaccard"))


def fuzzy_lsh(docs: DataFrame, bench: DataFrame, n: int = SHINGLE, threshold: float = FUZZY, index_threshold: float = INDEX, permutations: int = PERMUTATIONS) -> DataFrame:
    """doc_id, item_id, jaccard: MinHash bands at index_threshold, signatures' agreement at threshold; smallest item wins.

    All pairs of a document and an item that agree in a band are compared:
    items with equal signatures are one class, named by the smallest.
    """
    bands, rows = bands_and_rows(index_threshold, permutations)

    def signed(d: DataFrame, key: str) -> DataFrame:
        return materialize(minhash(gram_sets(d, key, n), permutations, key=key), "signatures")

    def banded(d: DataFrame) -> DataFrame:
        return d.withColumn("band", F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("i"), F.xxhash64(F.slice("signature", i * rows + 1, rows)).alias("h")))))

    items = signed(bench, "item_id").groupBy("signature").agg(F.min("item_id").alias("item_id"))
    right = banded(items).select("item_id", F.col("signature").alias("item"), "band")
    pairs = banded(signed(docs, "doc_id")).join(right, "band").select("doc_id", "item_id", "signature", "item")
    same = F.size(F.filter(F.zip_with("signature", "item", lambda x, y: x == y), lambda x: x)) / permutations
    best = pairs.withColumn("jaccard", same).filter(F.col("jaccard") >= threshold).groupBy("doc_id").agg(F.min(F.struct("item_id", "jaccard")).alias("m"))
    return best.select("doc_id", "m.item_id", "m.jaccard")


def summary(n_docs: DataFrame, **methods: DataFrame) -> DataFrame:
    """method, n_checked, n_matches, rate of each method's matching documents."""
    total = n_docs.agg(F.count(F.lit(1)).alias("n_checked"))
    parts = [m.agg(F.countDistinct("doc_id").alias("n_matches")).select(F.lit(name).alias("method"), "n_matches") for name, m in methods.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    joined = out.join(F.broadcast(total), F.lit(True))
    return joined.select("method", "n_checked", "n_matches", (F.col("n_matches") / F.greatest("n_checked", F.lit(1))).alias("rate"))


def details(matches: DataFrame, limit: int = DETAILS) -> DataFrame:
    """The first matches by doc_id, as a report shows them."""
    return matches.orderBy("doc_id").limit(limit)


def flatten_items(rows: DataFrame, strings: list[str], lists: list[str] = ()) -> DataFrame:
    """text: all strings, then all members of the lists, joined by blanks."""
    return rows.withColumn("text", F.concat_ws(" ", *strings, *lists))


def pick_text(rows: DataFrame, *columns: str) -> DataFrame:
    """text: the first column that is there and not null; empty ones are dropped."""
    have = [F.col(c) for c in columns if c in rows.columns]
    return rows.withColumn("text", F.coalesce(*have, F.lit(""))).filter("text <> ''")


def first_per_group(rows: DataFrame, group: str, order: list) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
