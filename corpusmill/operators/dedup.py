"""Exact and near duplicates, star clusters, and splits that keep clusters together."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.ordering import cut
from corpusmill.functions.shingles import rare_first, sets_of, shingle_set, slot_counts, text_bytes
from corpusmill.functions.text import exact_hash, hash_order, words
from corpusmill.sources.workdir import discard, materialize

SHINGLE, THRESHOLD, PERMUTATIONS = 5, 0.8, 128
PRIME = (1 << 31) - 1
#: Members of a band that meet all the others in one task; more are cut into parts of about this size.
BAND_ROWS = 1024


def exact_clusters(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, cluster_id: the smallest key with the same lower-case words; texts without words stand alone."""
    # written, so that texts are read and hashed once
    hashed = materialize(docs.select(key, F.nullif(exact_hash(F.col(text)), F.md5(F.lit(""))).alias("h")), "hashes")
    first = hashed.filter("h is not null").groupBy("h").agg(F.min(key).alias("first"))
    # a hot hash is on one side only, so the join can be split
    return hashed.join(first, "h", "left").select(key, F.coalesce("first", key).alias("cluster_id"))


def dedup_stats(clusters: DataFrame, method: str = "exact") -> DataFrame:
    counts = clusters.agg(F.count(F.lit(1)).alias("n_original"), F.countDistinct("cluster_id").alias("n_clusters"))
    return counts.select(
        "n_clusters",
        (F.col("n_original") - F.col("n_clusters")).alias("n_duplicates_removed"),
        F.round((F.col("n_original") - F.col("n_clusters")) / F.greatest("n_original", F.lit(1)), 4).alias("dedup_ratio"),
        "n_original",
        F.col("n_clusters").alias("n_unique"),
        F.lit(method).alias("method"),
    )


def word_text(text: Column) -> Column:
    """The lower-case words joined by blanks."""
    return F.array_join(words(F.lower(text)), " ")


def shingle_sets(docs: DataFrame, n: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, s: distinct hashed shingles of the lower-case words; texts without words have none and no row."""
    kind = docs.schema[key].dataType.simpleString()
    sets = docs.select(key, word_text(F.col(text))).mapInArrow(sets_of(n), f"key {kind}, s array<bigint>")
    return sets.filter(F.size("s") > 0).withColumnRenamed("key", key)


def _profiles(n: int, num: int, den: int, order):
    """(key, words) to key, md5 of the words, set size, rare-first prefix of the set."""

    def run(batches):
        for batch in batches:
            keys, hashes, sizes, prefixes = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                s = shingle_set(text, n)
                if len(s):
                    keep = len(s) - -(-num * len(s) // den) + 1
                    keys.append(key), hashes.append(hashlib.md5(text).digest()), sizes.append(len(s))
                    prefixes.append(s[rare_first(s, order.value)[:keep]].view(np.int64))
            yield pa.record_batch([pa.array(keys, batch.column(0).type), pa.array(hashes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))], ["key", "h", "n", "prefix"])

    return run


def _jaccards(batches):
    """a, b and the shingle sets of both (sorted, 8 bytes an element) to a, b, shared, both sizes summed."""
    for batch in batches:
        shared, total = [], []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            p, q = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            shared.append(int(np.count_nonzero(p[np.minimum(np.searchsorted(p, q), len(p) - 1)] == q)))
            total.append(len(p) + len(q))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(total, pa.int64())], ["a", "b", "shared", "total"])


def near_duplicate_pairs(docs: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """a, b, jaccard, same: near duplicates, computed exactly.

    Texts with the same lower-case words are one class, named by its smallest
    key.  Rows with same = true are membership: class a, other member b.  Rows
    with same = false are all pairs of classes a < b whose shingle sets reach
    the threshold.

    Prefix filter: only the rarest shingles of a set, as many as it may lack
    and one more, are joined on, the smaller set of a pair with those alone
    that can be the pair's first; rarity is by slot counts.  Length and
    positional filters apply inside the join; each pair is verified once.
    """
    share = Fraction(threshold).limit_denominator(10_000)
    num, den = share.numerator, share.denominator
    kind = docs.schema[key].dataType.simpleString()
    base = materialize(docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), word_text(F.col(text)).alias("text")), "words", "lz4")
    order = docs.sparkSession.sparkContext.broadcast(slot_counts(base, n))
    rows = materialize(base.mapInArrow(_profiles(n, num, den, order), f"key {kind}, h binary, n long, prefix array<bigint>"), "profiles")
    nodes = materialize(rows.groupBy("h").agg(F.min("key").alias("node"), F.first("n").alias("n"), F.first("prefix").alias("prefix")), "nodes")
    entries = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "shingle"))
    entries = entries.withColumn("early", F.expr(f"pos <= n - ceil({2 * num} * n / cast({num + den} as double))"))
    lists = entries.groupBy("shingle").agg(F.count(F.lit(1)).alias("rows"), F.max("early").alias("any")).filter("rows > 1 and any").select("shingle")
    shared = materialize(entries.join(lists, "shingle"), "lists")
    side = lambda k: [F.col(c).alias(f"{k}_{c}") for c in ("node", "n", "pos")]
    met = shared.filter("early").select("shingle", *side("a")).join(shared.select("shingle", *side("b")), "shingle")
    met = met.filter("(a_n < b_n or a_n = b_n and a_node < b_node)").filter(f"{den} * a_n >= {num} * b_n and {num + den} * least(a_n - a_pos, b_n - b_pos) >= {num} * (a_n + b_n)")
    pairs = materialize(met.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct(), "pairs")
    asked = materialize(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), "asked")
    # a key of several rows: only the text of the class that the key names
    texts = base.withColumn("h", F.unhex(F.md5("text"))).join(asked, "key", "left_semi").join(nodes.select("h", F.col("node").alias("key")), ["h", "key"], "left_semi")
    sets = materialize(texts.select("key", "text").mapInArrow(_packed_sets(n), f"key {kind}, s binary").dropDuplicates(["key"]), "sets", "lz4")
    full = pairs.join(sets.select(F.col("key").alias("b"), F.col("s").alias("b_s")), "b").join(sets.select(F.col("key").alias("a"), F.col("s").alias("a_s")), "a")
    counted = full.select("a", "b", "a_s", "b_s").mapInArrow(_jaccards, f"a {kind}, b {kind}, shared long, total long")
    near = materialize(counted.filter(F.col("shared") * den >= (F.col("total") - F.col("shared")) * num), "links")
    members = rows.join(nodes.select("h", "node"), "h").filter("key > node").select(F.col("node").alias("a"), F.col("key").alias("b"), F.lit(1.0).alias("jaccard"), F.lit(True).alias("same")).distinct()
    discard(base, shared, pairs, asked, sets)
    return near.select("a", "b", (F.col("shared") / (F.col("total") - F.col("shared"))).alias("jaccard"), F.lit(False).alias("same")).union(members)


def _packed_sets(n: int):
    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([shingle_set(t, n).tobytes() for t in text_bytes(batch.column(1))], pa.binary())], ["key", "s"])

    return run


def minhash(sets: DataFrame, permutations: int = PERMUTATIONS, seed: int = 1, key: str = "doc_id", shingles: str = "s") -> DataFrame:
    """key, signature of rows of key and an array of 64-bit hashes: minima of (a h + b) mod 2^31 - 1.

    Arrow batches: one matrix operation for a block of a document's shingles.
    """
    rng = random.Random(seed)
    a, b = (np.array([rng.randrange(1, PRIME) for _ in range(permutations)], dtype=np.uint64) for _ in range(2))

    def sign(hashes) -> list[int]:
        small = np.asarray(hashes, dtype=np.int64) % PRIME
        least = np.full(permutations, PRIME, dtype=np.uint64)
        for lo in range(0, len(small), 4096):
            block = small[lo : lo + 4096, None].astype(np.uint64)
            least = np.minimum(least, ((block * a + b) % np.uint64(PRIME)).min(0))
        return least.astype(np.int64).tolist()

    def signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "signature": [sign(x) for x in batch[shingles]]})

    return sets.select(key, shingles).mapInPandas(signatures, f"{key} {sets.schema[key].dataType.simpleString()}, signature array<bigint>")


def bands_and_rows(threshold: float, permutations: int = PERMUTATIONS) -> tuple[int, int]:
    """Bands and rows with the least area of wrong positives and wrong negatives around the threshold."""
    best = None
    grid = [(i + 0.5) / 200 for i in range(200)]
    for rows in range(1, permutations + 1):
        for bands in range(1, permutations // rows + 1):
            hit = [1 - (1 - s**rows) ** bands for s in grid]
            wrong = sum(p if s < threshold else 1 - p for s, p in zip(grid, hit))
            if best is None or wrong < best[0]:
                best = wrong, bands, rows
    return best[1], best[2]


def lsh_candidates(signatures: DataFrame, threshold: float = THRESHOLD, permutations: int = PERMUTATIONS, key: str = "doc_id") -> DataFrame:
    """a, b, same: distinct pairs a < b that agree in a band of their signatures (key, signature).

    Keys with equal signatures are one class, named by its smallest key.  Rows
    with same = true are membership: class a, other member b.  Rows with same =
    false are all pairs of classes that agree in a band; hot bands are dealt out.
    """
    bands, rows = bands_and_rows(threshold, permutations)
    signed = signatures.select(F.col(key).alias("b"), "signature")
    classes = materialize(signed.groupBy("signature").agg(F.min("b").alias("a")), "signatures")
    members = signed.join(classes, "signature").filter("a < b").select("a", "b").distinct()
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("i"), F.xxhash64(F.slice("signature", i * rows + 1, rows)).alias("h"))))
    keyed = classes.select("a", band.alias("band"))
    hot = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", F.ceil(F.col("n") / BAND_ROWS).cast("int").alias("parts"))
    listed = materialize(keyed.join(hot, "band"), "bands")
    left = listed.select("band", "a", F.pmod(F.xxhash64("a"), F.col("parts").cast("long")).cast("int").alias("part"))
    right = listed.select("band", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = left.join(right, ["band", "part"]).filter("a < b").select("a", "b").distinct()
    return pairs.withColumn("same", F.lit(False)).union(members.withColumn("same", F.lit(True)))


def star_clusters(nodes: DataFrame, edges: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, cluster_id: nodes visited in order of key; an unvisited one claims its unvisited neighbours.

    Rounds: an undecided node becomes a centre when all its smaller neighbours
    are members, and a member when one of them is a centre; a member goes to
    its smallest centre.
    """
    # only smaller neighbours matter for whether a node is a centre
    lower = materialize(edges.select(F.col("b").alias("node"), F.col("a").alias("low")).distinct(), "edges")
    state = materialize(nodes.select(F.col(key).alias("node")).join(lower.select("node").distinct().withColumn("has", F.lit(True)), "node", "left").select("node", F.when(F.col("has").isNull(), True).alias("centre")), "state")
    while not state.filter("centre is null").isEmpty():
        seen = lower.join(state.select(F.col("node").alias("low"), "centre"), "low")
        verdict = seen.groupBy("node").agg(F.bool_or(F.coalesce("centre", F.lit(False))).alias("taken"), F.bool_and(~F.coalesce("centre", F.lit(True))).alias("free"))
        decided = materialize(state.join(verdict, "node", "left").select("node", F.coalesce("centre", F.when(F.col("taken"), False).when(F.col("free"), True)).alias("centre")), "state")
        discard(state)
        state = decided
    centres = state.filter("centre").select(F.col("node").alias("low"))
    claims = lower.join(centres, "low").groupBy("node").agg(F.min("low").alias("claim"))
    return state.join(claims, "node", "left").select(F.col("node").alias(key), F.when(F.col("centre"), F.col("node")).otherwise(F.col("claim")).alias("cluster_id"))


def near_duplicate_clusters(docs: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, cluster_id of every document: the star cluster of the class of its exact copies, by exact similarity."""
    return _stars(docs, near_duplicate_pairs(docs, threshold, n, key, text), key)


def _stars(docs: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """key, cluster_id of every document: star clusters of classes, given pairs between them and membership."""
    members = pairs.filter("same").select(F.col("b").alias(key), F.col("a").alias("class"))
    classes = materialize(docs.select(key).distinct().join(members, key, "left").select(key, F.coalesce("class", key).alias("class")), "classes")
    stars = star_clusters(classes.filter(F.col(key) == F.col("class")).select(key), pairs.filter("not same").select("a", "b"), key)
    named = stars.select(F.col(key).alias("class"), F.col("cluster_id").alias("star"))
    return classes.join(named, "class").select(key, F.col("star").alias("cluster_id"))


def build_clusters(docs: DataFrame, method: str = "lsh", threshold: float = THRESHOLD, permutations: int = PERMUTATIONS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, cluster_id of every document; cluster_id is the smallest key of the cluster.

    lsh: documents in order of key take their unclaimed neighbours, which are
    those that agree in a band of their MinHash signatures.  exact: the same
    lower-case words.  Texts without words stand alone.
    """
    if method == "exact":
        return exact_clusters(docs, key, text)
    if method != "lsh":
        raise ValueError(method)
    signatures = minhash(shingle_sets(docs, SHINGLE, key, text), permutations, key=key)
    return _stars(docs, materialize(lsh_candidates(signatures, threshold, permutations, key), "pairs"), key)


def split_by_clusters(clusters: DataFrame, val_ratio: float, test_ratio: float, seed: str = "split", key: str = "doc_id") -> DataFrame:
    """key, cluster_id, split.  Clusters in hash order fill validation, then test; the last one may overshoot.

    Where a split ends is found from sums over ranges of the hash order; a
    cluster's place in that order then tells its split, without a join.
    """
    clusters = materialize(clusters.select(key, "cluster_id"), "clusters")
    sizes = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).withColumn("order_key", hash_order(seed, "cluster_id"))
    sizes = materialize(sizes, "sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("docs")).first()["docs"]
    wanted = [max(1, int(total * r)) if r > 0 else 0 for r in (val_ratio, test_ratio)]
    val = cut(sizes, "n", wanted[0], "cluster_id")
    test = cut(sizes, "n", val.total + wanted[1], "cluster_id")
    at = hash_order(seed, "cluster_id")
    split = F.when(val.upto(at, F.col("cluster_id")), "validation").when(test.upto(at, F.col("cluster_id")), "test").otherwise("train")
    discard(sizes)
    return clusters.select(key, "cluster_id", split.alias("split"))


def split_stats(splits: DataFrame, n_raw: int | None = None) -> DataFrame:
    n = lambda s: F.sum((F.col("split") == s).cast("long"))
    raw = F.lit(n_raw).cast("long") if n_raw is not None else F.count(F.lit(1))
    return splits.agg(raw.alias("raw_count"), F.count(F.lit(1)).alias("post_filter_count"), n("train").alias("train_count"), n("validation").alias("val_count"), n("test").alias("test_count"), F.round(n("train") / F.count(F.lit(1)), 4).alias("train_ratio"))
