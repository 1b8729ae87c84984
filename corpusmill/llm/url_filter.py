"""URL filters: a broadcast trie over reversed host labels and path segments.

Every rule has an action, a host and a path prefix.  It fits its host and all
subdomains of it if the url's path starts with the rule's path; the last
segment of a rule's path may stop in the middle of a segment of the url.
Among the rules that fit, the one with the most host labels wins, then the one
with the longest path; of rules with the same host and path the first given.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules whose pickled trie is larger than this are not broadcast but joined.
MAX_TRIE_BYTES = 64 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Trie:
    """Nodes are dicts; host labels and path segments lead on, "ends" holds {rest of a segment: rule} and "sizes" the rests' lengths."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.root: dict = {"next": {}}
        for number, (_, host, path) in enumerate(rules):
            node = self.root
            for label in reversed(host.split(".")):
                node = node["next"].setdefault(label, {"next": {}})
            node = node.setdefault("path", {"next": {}})
            *segments, rest = path.split("/")
            for segment in segments:
                node = node["next"].setdefault(segment, {"next": {}})
            node.setdefault("ends", {}).setdefault(rest, number)
            node["sizes"] = sorted({*node.get("sizes", ()), len(rest)}, reverse=True)

    def find(self, host: str, path: str) -> int:
        """Number of the winning rule, or -1."""
        node, found, segments = self.root, -1, None
        for label in reversed(host.split(".")):
            node = node["next"].get(label)
            if node is None:
                break
            if "path" in node:
                segments = segments or path.split("/")
                hit = self._path(node["path"], segments)
                found = hit if hit >= 0 else found
        return found

    @staticmethod
    def _path(node: dict, segments: list[str]) -> int:
        found = -1
        for segment in segments:
            for size in node.get("sizes", ()):  # lengths that rules have, the longest first
                if size <= len(segment) and (hit := node["ends"].get(segment[:size])) is not None:
                    found = hit
                    break
            node = node["next"].get(segment)
            if node is None:
                break
        return found


def host_of(url: Column) -> Column:
    """After the first :// up to /, ? or # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(docs: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", url: str = "url") -> DataFrame:
    """docs with host, path, rule (host + path of the winning rule, or null) and verdict.

    rules: (allow or block, host, path prefix).  A url that no rule fits gets
    the default verdict.  Null urls and urls without :// have an empty host and
    path, no rule and the default verdict; columns of docs named host, path,
    rule or verdict are replaced; repeated rows are judged each; the time for a
    very long url grows with its length; an empty table gives an empty result.
    """
    rules = [(action, host.translate(str.maketrans(UPPER, LOWER)), path) for action, host, path in rules]
    spark = docs.sparkSession
    parts = docs.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    packed = pickle.dumps(Trie(rules).root)
    if len(packed) > MAX_TRIE_BYTES:
        return _by_join(spark, parts, rules, default)
    shared = spark.sparkContext.broadcast(packed)

    @F.pandas_udf("int")
    def winner(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        trie = Trie([])
        trie.root = pickle.loads(shared.value)
        for hosts, paths in batches:
            yield pd.Series([trie.find(h, p) for h, p in zip(hosts, paths)], dtype="int32")

    names = F.array(*[F.lit(host + path) for _, host, path in rules]) if rules else F.array().cast("array<string>")
    actions = F.array(*[F.lit(action) for action, _, _ in rules]) if rules else F.array().cast("array<string>")
    judged = parts.withColumn("_rule", winner("host", "path"))
    return judged.withColumns({"rule": F.get(names, F.col("_rule")), "verdict": F.coalesce(F.get(actions, F.col("_rule")), F.lit(default))}).drop("_rule")


def _by_join(spark: SparkSession, parts: DataFrame, rules: list, default: str) -> DataFrame:
    """The same for rule sets too large to broadcast: a join of every host suffix with the rules' hosts."""
    table = spark.createDataFrame([(i, h, p, a, len(h.split(".")), len(p)) for i, (a, h, p) in enumerate(rules)], "_n int, _host string, _prefix string, _action string, _labels int, _length int")
    urls = parts.select("host", "path").distinct()
    suffixes = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'))")
    fits = urls.withColumn("_host", F.explode(suffixes)).join(table, "_host").filter("startswith(path, _prefix)")
    best = fits.groupBy("host", "path").agg(F.max(F.struct("_labels", "_length", F.expr("-_n").alias("_first"), F.concat("_host", "_prefix").alias("rule"), "_action")).alias("_best"))
    return parts.drop("rule", "verdict").join(best, ["host", "path"], "left").withColumns({"rule": F.col("_best.rule"), "verdict": F.coalesce("_best._action", F.lit(default))}).drop("_best")
