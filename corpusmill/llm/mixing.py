"""Mixing sources to target weights by Poisson replication.  DataFrame functions only.

A source with weight w and n of the rows should fill w of a mixture of t rows,
so each of its rows is repeated w * t / n times on average.  The number of
copies of a row is the inverse of the Poisson distribution with that mean at a
uniform number hashed from seed and doc_id: no state, the same on every run and
every partitioning.  A mean over MAX_MEAN is cut into equal parts with a hashed
number each; their sum is Poisson again.  Copies are exploded and dealt out in
the global order of a second hash, whose even spread gives the partitions
without a look at the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.sources.workdir import discard, materialize

#: Means above this are the sum of as few equal parts as possible.
MAX_MEAN = 16.0
#: Terms of the distribution; beyond them less than 2^-53 is left at MAX_MEAN.
TERMS = 72
#: Rates of at most so many sources (600 bytes each) are broadcast.
MAX_BROADCAST_SOURCES = 20_000
#: Elements of the arrays from which copies and parts are exploded or summed.
BLOCK = 4096
#: Shuffle keys are 13 hex digits.
KEYS = 16**13


def hash_number(*parts: Column | str, digits: int = 13) -> Column:
    """The first hex digits of md5 over parts joined by ':', as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, digits), 16, 10).cast("long")


def poisson_steps(mean: Column) -> Column:
    """Values of the distribution function at 0, 1, 2, ... TERMS - 1."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("steps"))

    def grow(a: Column, k: Column) -> Column:
        p = a["p"] * mean / k
        return F.struct(p.alias("p"), (a["sum"] + p).alias("sum"), F.concat(a["steps"], F.array(a["sum"] + p)).alias("steps"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, grow, lambda a: a["steps"])


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, seed: str = "mix", source: str = "source", key: str = "doc_id") -> DataFrame:
    """docs' rows repeated so that sources come near their weights, in a global random order.

    weights: relative target weights (default: equal for every source present);
    a source without a weight is left out.  total: rows of the mixture on
    average (default: as many as docs).  Adds copy (1, 2, ...) and shuffle_key
    (long; the rows are partitioned by ranges of it, spark.sql.shuffle.partitions
    of them, and sorted by it).

    A null source is a source of its own, with weight weights[None] if weights
    are given.  A null key hashes as an empty string, and rows repeated under
    one key get the same number of copies; an empty table gives an empty
    result; docs' columns copy and shuffle_key are replaced.
    """
    docs = docs.drop("copy", "shuffle_key")
    spark = docs.sparkSession
    counts = docs.groupBy(F.col(source).alias("__mix_source")).agg(F.count(F.lit(1)).alias("__mix_rows"))
    if weights is None:
        shares = counts.withColumn("__mix_weight", F.lit(1.0))
    else:
        named = spark.createDataFrame([(k, float(w)) for k, w in weights.items()], "__mix_name string, __mix_weight double")
        near = F.broadcast if len(weights) <= MAX_BROADCAST_SOURCES else lambda side: side
        shares = counts.join(near(named), F.col("__mix_source").eqNullSafe(F.col("__mix_name"))).drop("__mix_name")
    shares = materialize(shares, "shares")
    sources, weight, rows = shares.agg(F.count(F.lit(1)), F.sum("__mix_weight"), F.sum("__mix_rows")).first()
    mean = F.col("__mix_weight") / F.lit(weight or 1.0) * F.lit(float(rows or 0 if total is None else total)) / F.col("__mix_rows")
    rates = shares.withColumn("__mix_mean", mean).withColumn("__mix_parts", F.greatest(F.ceil(F.col("__mix_mean") / MAX_MEAN), F.lit(1)).cast("long"))
    rates = materialize(rates.select("__mix_source", "__mix_parts", poisson_steps(F.col("__mix_mean") / F.col("__mix_parts")).alias("__mix_steps")), "rates")
    discard(shares)
    if sources <= MAX_BROADCAST_SOURCES:
        rates = F.broadcast(rates)  # else a plain join, whose hot sources Spark can split
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    dealt = docs.join(rates, F.col(source).eqNullSafe(F.col("__mix_source")))

    def below(*parts: Column) -> Column:
        """The inverse of the distribution at the number hashed from parts."""
        return F.get(F.transform(F.array(hash_number(F.lit(seed), name, *parts) / F.lit(float(KEYS))), lambda u: F.size(F.filter("__mix_steps", lambda s: s <= u))), F.lit(0)).cast("long")

    def block(first: Column) -> Column:
        """Counts of the parts from first on, summed."""
        numbers = F.sequence(first, F.least(first + (BLOCK - 1), F.col("__mix_parts") - 1))
        return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, i: a + below(F.lit("part"), i.cast("string")))

    more = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("__mix_parts") - 1, F.lit(1)), F.lit(BLOCK).cast("long")), F.lit(0).cast("long"), lambda a, i: a + block(i))
    dealt = dealt.withColumn("__mix_times", below() + F.when(F.col("__mix_parts") > 1, more).otherwise(0)).filter("__mix_times > 0").drop("__mix_steps", "__mix_parts")
    blocks = dealt.withColumn("__mix_first", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_times"), F.lit(BLOCK).cast("long"))))
    copies = blocks.withColumn("copy", F.explode(F.sequence(F.col("__mix_first"), F.least(F.col("__mix_first") + (BLOCK - 1), F.col("__mix_times"))).cast("array<int>")))
    mixed = copies.withColumn("shuffle_key", hash_number(F.lit(seed), F.lit("order"), name, F.col("copy").cast("string"))).select(*docs.columns, "copy", "shuffle_key")
    # keys are spread evenly, so equal ranges of them are equal partitions, in order
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionById(ranges, F.floor(F.col("shuffle_key") / F.lit(KEYS / ranges)).cast("int")).sortWithinPartitions("shuffle_key", key)


MIX_SQL = """
WITH RECURSIVE c AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
s AS (SELECT count(*)::DOUBLE AS k, sum(n) AS total FROM c),
m AS (SELECT source, 1.0::DOUBLE / k * total / n AS mean FROM c, s),
r AS (SELECT source, greatest(ceil(mean / 16.0::DOUBLE), 1)::BIGINT AS parts, mean / greatest(ceil(mean / 16.0::DOUBLE), 1) AS mean FROM m),
p AS (
  SELECT source, mean, 0 AS j, exp(-mean) AS p, exp(-mean) AS cum FROM r
  UNION ALL
  SELECT source, mean, j + 1, p * mean / (j + 1), cum + p * mean / (j + 1) FROM p WHERE j < 71
),
e AS (SELECT doc_id, d.source, unnest(range(0, parts)) AS part FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
d AS (SELECT doc_id, source, ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || CASE part WHEN 0 THEN '' ELSE ':part:' || part END), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM e),
t AS (SELECT d.doc_id, count(*) AS times FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND p.cum <= d.u GROUP BY d.doc_id),
x AS (SELECT doc_id, unnest(range(1, times + 1))::INT AS copy FROM t)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, x.copy,
  ('0x' || substr(md5('mix:order:' || coalesce(d.doc_id::VARCHAR, '') || ':' || x.copy), 1, 13))::BIGINT AS shuffle_key
FROM x JOIN documents d ON d.doc_id IS NOT DISTINCT FROM x.doc_id
"""
