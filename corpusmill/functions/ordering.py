"""Prefixes of an order over a whole table, found from sums over ranges and never by sorting the table in one task."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.sources.workdir import materialize

#: Ranges into which a span of the order is cut, and rows that the driver may sort to find a place among them.
RANGES, SMALL = 1024, 10_000


@dataclass
class Cut:
    """The last row of a prefix, and the sum of the values up to it; order and key are None for an empty prefix."""

    order: int | None
    key: Any
    total: int

    def upto(self, order: Column, key: Column) -> Column:
        """Whether a row is in the prefix."""
        if self.order is None:
            return F.lit(False)
        return (order < self.order) | ((order == self.order) & (key <= F.lit(self.key)))


def cut(rows: DataFrame, value: str, budget: int, key: str, order: str = "order_key") -> Cut:
    """The prefix, in order of (order, key), of the rows before which the values sum to less than budget.

    order is an integer, values are whole and not negative, keys of one order
    value are few.  Each pass sums values over RANGES ranges of the span that
    holds the end, so a few passes over two narrow columns suffice; ties and
    uneven spans only cost passes.
    """
    rows = rows.select(F.col(order).cast("long").alias("o"), F.col(key).alias("k"), F.col(value).cast("long").alias("v"))
    before = 0
    span = rows.agg(F.min("o"), F.max("o"), F.count(F.lit(1)), F.coalesce(F.sum("v"), F.lit(0))).first()
    low, high, count, total = span
    if budget <= 0 or not count:
        return Cut(None, None, 0)
    if total < budget:
        last = rows.filter(F.col("o") == high).agg(F.max("k")).first()[0]
        return Cut(high, last, total)
    while count > SMALL and low < high:
        width = (high - low) // RANGES + 1
        part = F.expr(f"(o - {low}L) div {width}L")
        sums = rows.filter(F.col("o").between(low, high)).groupBy(part.alias("p")).agg(F.sum("v"), F.count(F.lit(1)), F.min("o"), F.max("o")).orderBy("p").collect()
        for _, v, n, lo, hi in sums:
            if before + v >= budget:
                count, low, high = n, lo, hi
                break
            before += v
    for o, k, v in rows.filter(F.col("o").between(low, high)).orderBy("o", "k").toLocalIterator():
        if before + v >= budget:
            return Cut(o, k, before + v)
        before += v
    return Cut(None, None, 0)


def number_of(rows: DataFrame, key: str) -> Column:
    """An integer that orders rows as the key does, up to ties: the key itself, or the first bytes of a string."""
    if rows.schema[key].dataType.simpleString() == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.col(key).cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")
    return F.col(key).cast("long")


def first_rows(rows: DataFrame, n: int, key: str) -> DataFrame:
    """The rows with the n smallest keys; n may be any share of the table.  Rows that repeat the last key stay with it."""
    place = number_of(rows, key)
    end = cut(rows.select(place.alias("order_key"), key, F.lit(1).alias("one")), "one", n, key)
    return rows.filter(end.upto(place, F.col(key)))


def numbered(rows: DataFrame, *keys: str | Column, name: str = "idx") -> DataFrame:
    """name: 0, 1, 2, ... in order of the keys, without a task that sees all rows.

    Rows are sorted by ranges of the keys and written; a row's number is its
    place in its range after the sizes of the ranges before.
    """
    placed = materialize(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    base = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))  # a row a partition
    return placed.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_at", "_base")
