"""Benchmark decontamination: size-partitioned MinHash containment.  DataFrame functions only.

An item is contained in a document if the document has at least num / den of
the item's distinct word shingles.  Items are partitioned by size: a partition
holds those whose number m of distinct shingles has the same binary logarithm.
Each partition has its own sketch length, twice what its largest items may lack
and two more; an item's sketch is a bottom-k MinHash, its k smallest shingle
hashes.  Documents are long and items short, so documents are not sketched
(their signatures would hardly ever meet); all their hashes are compared with
the sketches, and the share of a sketch that a document has estimates the
containment.  A document that contains the item lacks gap = m - ceil(m * num /
den) of its shingles at most, so it has k - gap hashes of the sketch for
certain: pairs below that estimate are left out without a loss (recall 1),
whatever the document's length.  What remains is verified by exact containment,
shingle by shingle as text, over whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.sources.workdir import discard, materialize

#: Sketches with at most so many hashes (24 bytes each) and items with at most so many shingles (under 100 bytes each) are broadcast; more are joined by shuffle.
MAX_BROADCAST_HASHES, MAX_BROADCAST_SHINGLES = 500_000, 200_000
WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), WORD), "")


def _runs(x: Column, n: int, whole, run) -> Column:
    """run(x, i) for the start i (from 0) of each run of n elements; whole(x) if x is shorter; nothing for an empty x."""

    def each(x: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(x) - n, F.lit(0)))
        return F.when(F.size(x) >= n, F.transform(starts, lambda i: run(x, i))).otherwise(F.when(F.size(x) > 0, F.array(whole(x))).otherwise(F.array()))

    # a lambda's variable is bound once; an expression would be evaluated again for every run
    return F.get(F.transform(F.array(x), each), F.lit(0))


def shingle_hashes(w: Column, n: int) -> Column:
    """Hashes of all runs of n words; of the whole if it is shorter; none without words."""
    hashed = F.transform(w, lambda x: F.xxhash64(x))
    return _runs(hashed, n, F.xxhash64, lambda x, i: F.xxhash64(*[F.get(x, i + j) for j in range(n)]))


def shingle_texts(w: Column, n: int) -> Column:
    """The same runs, their words joined by blanks."""
    return _runs(w, n, lambda x: F.array_join(x, " "), lambda x, i: F.array_join(F.slice(x, i + 1, n), " "))


def item_sketches(items: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """item_row, item_id, m, partition, k, gap, z (distinct (hash, shingle), sorted) of the different items that have any word and an id."""
    w = items.select(F.col("item_id").cast("long"), words(F.col("text").cast("string")).alias("w")).filter("item_id is not null and w is not null")
    z = F.array_sort(F.array_distinct(F.arrays_zip(shingle_hashes(F.col("w"), n).alias("h"), shingle_texts(F.col("w"), n).alias("s"))))
    sized = w.select("item_id", z.alias("z")).filter(F.size("z") > 0).dropDuplicates().withColumn("m", F.size("z")).withColumn("partition", F.floor(F.log2("m")).cast("int"))
    gap = lambda size: f"(({size}) - cast(ceil(({size}) * {num} / {float(den)}) as int))"
    largest = "cast(power(2, partition + 1) as int) - 1"
    return sized.withColumns({"gap": F.expr(gap("m")), "k": F.least("m", F.expr(f"2 * {gap(largest)} + 2")), "item_row": F.monotonically_increasing_id()})


def containment_pairs(docs: DataFrame, items: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """item_id, doc_id, shared, item_shingles: items contained in documents(doc_id, text).

    Null and empty texts contain nothing and are contained in nothing; an item
    of fewer than n words is one shingle, which a document has only if it is
    all of that document's words.  Null ids are left out; rows repeated under
    one id count as one text each and their pair is returned once, with the
    largest count; other columns are ignored; empty tables give no pairs.
    """
    bench = materialize(item_sketches(items, n, num, den), "items")
    sketches = materialize(bench.select("item_row", (F.col("k") - F.col("gap")).alias("least"), F.explode(F.slice("z", 1, F.col("k"))).alias("x")).select("item_row", "least", F.col("x.h").alias("h")).distinct(), "sketches")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id is not null and text is not null")
    rows = lambda side: side.withColumn("row", F.monotonically_increasing_id())
    near = lambda side, small: F.broadcast(side) if small else side
    # estimated containment: the distinct hashes of each sketch that a row has; hits of a row meet in its own task first
    hashes = rows(texts).select("row", "doc_id", F.explode(shingle_hashes(words(F.col("text")), n)).alias("h"))
    hits = hashes.join(near(sketches, sketches.count() <= MAX_BROADCAST_HASHES), "h").groupBy("row", "doc_id", "item_row", "least").agg(F.countDistinct("h").alias("hits"))
    candidates = materialize(hits.filter("hits >= least").select("doc_id", "item_row").distinct(), "candidates")
    # exact containment, for the candidates' documents alone
    parts = materialize(bench.select("item_row", "item_id", F.col("m").cast("long").alias("item_shingles"), F.explode("z").alias("x")).select("item_row", "item_id", "item_shingles", F.col("x.s").alias("s")), "shingles")
    again = rows(texts.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")).select("row", "doc_id", F.explode(F.array_distinct(shingle_texts(words(F.col("text")), n))).alias("s"))
    met = again.join(near(parts, parts.count() <= MAX_BROADCAST_SHINGLES), "s").join(candidates, ["doc_id", "item_row"], "left_semi")
    shared = met.groupBy("row", "doc_id", "item_row", "item_id", "item_shingles").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") * den >= F.col("item_shingles") * num)
    # a third of all documents may hold one item: pairs, not documents, are dealt
    found = materialize(shared.groupBy("item_id", "doc_id").agg(F.max("shared").alias("shared"), F.max("item_shingles").alias("item_shingles")), "pairs")
    discard(bench, sketches, candidates, parts)
    return found


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents that contain no item, all their columns; rows with a null doc_id stay."""
    # written first: of a table whose size is known Spark sees whether it can be broadcast, which spares the texts a shuffle
    pairs = containment_pairs(docs, items, n, num, den)
    dirty = materialize(pairs.select(F.col("doc_id").alias("_dirty")).distinct(), "dirty")
    discard(pairs)
    return docs.join(dirty, docs["doc_id"] == dirty["_dirty"], "left_anti")


CONTAINMENT_SQL = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM b WHERE len(w) > 0)),
bm AS (SELECT item_id, count(*) AS m FROM bs GROUP BY item_id),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
j AS (SELECT item_id, doc_id, count(*) AS shared FROM bs JOIN ds USING (s) GROUP BY item_id, doc_id)
SELECT item_id, doc_id, shared, m AS item_shingles FROM j JOIN bm USING (item_id) WHERE shared * 100 >= m * 80
"""
