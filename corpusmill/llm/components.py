"""Connected components of a link table by minimum labels, hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.sources.workdir import discard, materialize


def connected_components(links: DataFrame, u: str, v: str) -> DataFrame:
    """(node, comp) for every node that has a link; comp is the smallest node of the component.

    Every round a node takes the least label among its own, its neighbours' and
    its label's label, and hands it on to the node that its label names, so the
    number of rounds grows with the logarithm of the longest path.  Labels are
    combined before the shuffle; each round's table goes to the shared folder.
    """
    both = links.select(F.col(u).alias("a"), F.col(v).alias("b"))
    edges = materialize(both.union(both.select(F.col("b"), F.col("a"))).distinct(), "edges")
    label = materialize(
        edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("comp")), "labels"
    )
    held = label
    while True:
        near = (
            edges.join(label.select(F.col("node").alias("b"), "comp"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("comp").alias("near"))
        )
        step = label.join(near, "node").select("node", "comp", F.least("comp", "near").alias("low"))
        up = label.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
        jumped = step.join(up, "comp").select("node", "comp", F.least("low", "above").alias("low"))
        offers = jumped.select("node", F.col("comp").alias("old"), "low").union(
            jumped.filter("low < comp").select(F.col("comp").alias("node"), F.lit(None).cast("long").alias("old"), "low")
        )
        new = materialize(offers.groupBy("node").agg(F.min("old").alias("old"), F.min("low").alias("comp")), "labels")
        done = new.filter("comp < old").isEmpty()
        discard(held)
        held, label = new, new.select("node", "comp")
        if done:
            discard(edges)
            label.work_path = new.work_path
            return label
