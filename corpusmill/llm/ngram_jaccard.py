"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Plan
----
1. Count, over all documents, how often each of 2^16 to 2^22 hash slots (by the
   size of the input; 16 MB at most) is hit by a distinct shingle.  Slot counts
   order shingles from rare to frequent; ties go by hash.  Any order gives
   right results; this one keeps shared passages out of the prefixes.  Unlucky
   neighbours in a slot raise all counts alike, so that a shingle stands out as
   soon as it is more frequent than the spread of that noise, its square root.
2. Give each document its set size, a 128-bit digest of its set, its prefix and
   a 256-bit parity sketch.  Documents with equal sets become one node, so the
   size of a group of copies does not matter from here on.
3. Only entries near the start of a prefix can be the first common shingle of a
   pair whose smaller set they belong to (the index prefix); lists without such
   an entry have no pair and are left out before any join.
4. Candidates, first round: in each list a node in which the shingle stands
   earliest (one with the fewest rare shingles of its own) is compared with all
   the others: as many candidates as list entries.
5. Length, positional and sketch filters, the suffix filter, then one exact
   verification a pair.  A node with many candidates sends its set once for
   every HUB_PAIRS of them.
6. Components of the links found so far.  Second round: of lists that still
   span several components, entries of the index prefix are joined with larger
   sets of about their size, across components; pairs inside a component need
   no check, they cannot change it.
7. For link counts: all pairs inside a component of the first round, block
   against block, so that a set is sent once a block and not once a pair.  With
   the second round's links these are all links, each counted once.

The sketch filter bounds the Hamming distance of two sets from below without
the sets: 256 fixed parts by hash, and part sizes of different parity differ by
one at least.  The suffix filter does it with the sets: it cuts both at the
middle element of one, adds the differences of the parts' sizes, and goes on
within the parts as long as the sum allows a link.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.shingles import BATCH_ROWS, lean, rare_first, shingle_set, slot_counts, text_bytes
from corpusmill.llm.components import connected_components
from corpusmill.sources.workdir import arrow_rows, discard, materialize

SKETCH_WORDS = 4
#: Depth to which the suffix filter cuts.
SUFFIX_DEPTH = 3
#: Candidates that one copy of a node's set serves.
HUB_PAIRS = 64
#: Nodes of a component are compared in pairs of blocks of about this size.
BLOCK_NODES = 256


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of the sizes of 64 * SKETCH_WORDS parts of a set."""
    bits = np.bincount((shingles & np.uint64(64 * SKETCH_WORDS - 1)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def _profile(n: int, num: int, den: int, order):
    """doc_id, set size, digest of the set, prefix shingles from rare to frequent, sketch."""

    def run(batches):
        for batch in batches:
            size, digest, prefix, marks = [], [], [], []
            for text in text_bytes(batch.column(1)):
                s = shingle_set(text, n)
                size.append(len(s))
                if not len(s):
                    digest.append(None), prefix.append(None), marks.append(None)
                    continue
                keep = len(s) - -(-num * len(s) // den) + 1
                rare = rare_first(s, order.value)[:keep]
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                prefix.append(s[rare].view(np.int64))
                marks.append(sketch(s))
            yield pa.record_batch(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.int64()))],
                ["doc_id", "n", "digest", "prefix", "marks"],
            )

    return run


def _sets(n: int):
    def run(batches):
        for batch in batches:
            sets = [shingle_set(text, n) for text in text_bytes(batch.column(1))]
            yield pa.record_batch(
                [pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["digest", "shingles"]
            )

    return run


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int, most: int) -> int:
    """At least so many elements are in one of two sorted sets only; cutting stops where the bound is over most."""
    bound = abs(len(x) - len(y))
    if depth == 0 or bound > most or not len(x) or not len(y):
        return bound
    mid = len(y) // 2
    at = int(np.searchsorted(x, y[mid]))
    missing = at == len(x) or x[at] != y[mid]
    left, right = (x[:at], y[:mid]), (x[at + (not missing) :], y[mid + 1 :])
    apart = abs(len(right[0]) - len(right[1])) + missing
    low = suffix_bound(*left, depth - 1, most - apart)
    if low + apart > most:
        return low + apart
    return low + missing + suffix_bound(*right, depth - 1, most - low - missing)


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether den * |intersection| >= num * |union|: the suffix filter, then an exact count."""
    both = len(x) + len(y)
    needed = -(-num * both // (num + den))
    if suffix_bound(x, y, SUFFIX_DEPTH, both - 2 * needed) > both - 2 * needed:
        return False
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    shared = int(np.count_nonzero(large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small))
    return den * shared >= num * (both - shared)


def _verify(num: int, den: int):
    """(a, chunk, b, shingles) sorted by the first three, null b first: the set of a, then those of its candidates.  Keeps the links."""

    def run(batches):
        own = None
        for batch in batches:
            found = []
            for a, b, here in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), text_bytes(batch.column(3))):
                here = here.view(np.uint64)
                if b is None:
                    own = here.copy()
                elif linked(own, here, num, den):
                    found.append((a, b))
            yield pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _count_links(num: int, den: int):
    """Rows of (comp, lo, hi, chunk, node, members, shingles) sorted by the first three: linked documents of every node, among the
    pairs of block lo with block hi of a component."""

    def links(rows):
        lo, hi = rows[0][1], rows[0][2]
        left = [r for r in rows if r[3] == lo]
        right = left if lo == hi else [r for r in rows if r[3] == hi]
        if not left or not right:
            return
        a_sets, b_sets = ([np.frombuffer(r[6], dtype=np.uint64) for r in x] for x in (left, right))
        a_n, b_n = (np.array([len(s) for s in x], dtype=np.int64) for x in (a_sets, b_sets))
        a_marks, b_marks = (np.array([sketch(s) for s in x]).view(np.uint64) for x in (a_sets, b_sets))
        members = np.array([r[5] for r in right], dtype=np.int64)
        gains, back = np.zeros(len(left), dtype=np.int64), np.zeros(len(right), dtype=np.int64)
        for i, s in enumerate(a_sets):
            both = a_n[i] + b_n
            needed = -(-num * both // (num + den))
            near = (den * np.minimum(a_n[i], b_n) >= num * np.maximum(a_n[i], b_n)) & (np.bitwise_count(a_marks[i] ^ b_marks).sum(1, dtype=np.int64) <= both - 2 * needed)
            if lo == hi:
                near[: i + 1] = False
            for j in np.flatnonzero(near).tolist():
                if linked(s, b_sets[j], num, den):
                    gains[i] += members[j]
                    back[j] += left[i][5]
        yield from zip((r[4] for r in left), gains.tolist())
        yield from zip((r[4] for r in right), back.tolist())

    def run(batches):
        rows, found = [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and row[:3] != rows[0][:3]:
                    found += links(rows)
                    rows = []
                rows.append(row)
            yield pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["node", "links"])
            found = []
        if rows:
            found += links(rows)
            yield pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["node", "links"])

    return run


def _index_prefix(num: int, den: int, n: str = "n") -> str:
    """How many of the first shingles of a set can be its first one in common with a larger set."""
    return f"({n} - cast(ceil({2 * num} * {n} / cast({num + den} as double)) as bigint) + 1)"


def _passes(num: int, den: int) -> str:
    """Length filter, and positional filter for a first common shingle."""
    length = f"{den} * least(a_n, b_n) >= {num} * greatest(a_n, b_n)"
    position = f"{num + den} * least(a_n - a_pos, b_n - b_pos) >= {num} * (a_n + b_n)"
    return f"({length}) and ({position})"


def _sketches_meet(num: int, den: int) -> str:
    """Sketch filter: the distance that the sketches show leaves room for a link."""
    apart = " + ".join(f"bit_count(a_marks[{i}] ^ b_marks[{i}])" for i in range(SKETCH_WORDS))
    return f"{apart} <= a_n + b_n - 2 * ceil({num} * (a_n + b_n) / cast({num + den} as double))"


class _Join:
    def __init__(self, docs: DataFrame, n: int, num: int, den: int):
        self.n, self.num, self.den = n, num, den
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        spark = docs.sparkSession
        order = spark.sparkContext.broadcast(slot_counts(self.docs, n))
        kind = "doc_id long, n long, digest binary, prefix array<long>, marks array<long>"
        with arrow_rows(spark, BATCH_ROWS):
            profiles = materialize(self.docs.mapInArrow(lean(_profile(n, num, den, order)), kind), "profiles")
        known = profiles.filter("n > 0 and doc_id is not null")
        self.nodes = materialize(
            known.groupBy("digest")
            .agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("members"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("marks").alias("marks"))
            .withColumn("node", F.monotonically_increasing_id()),
            "nodes",
        )
        self.rows = materialize(profiles.select("doc_id", "n", "digest"), "rows")
        discard(profiles)

    def shared_lists(self) -> DataFrame:
        """(shingle, node, n, pos, early, least) of prefix shingles that two nodes or more have, one of them in its index prefix; least is the list's smallest pos."""
        entries = self.nodes.select("node", "n", F.posexplode("prefix").alias("pos", "shingle")).withColumn("early", F.expr(f"pos < {_index_prefix(self.num, self.den)}"))
        # numbers alone, which a hash aggregate holds without sorting all entries
        lists = entries.groupBy("shingle").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("early").cast("int")).alias("any"), F.min("pos").alias("least"))
        lists = lists.filter("rows > 1 and any = 1").select("shingle", "least")
        return materialize(entries.join(lists, "shingle").select("shingle", "node", "n", "pos", "early", "least"), "lists")

    def sets(self, asked: DataFrame) -> DataFrame:
        """node, shingles of asked(node, digest, first_doc)."""
        texts = self.docs.join(asked.select(F.col("first_doc").alias("doc_id")).distinct(), "doc_id", "left_semi")
        sets = texts.mapInArrow(lean(_sets(self.n)), "digest binary, shingles binary").dropDuplicates(["digest"])
        with arrow_rows(self.docs.sparkSession, BATCH_ROWS):
            return materialize(sets.join(asked.select("node", "digest"), "digest").select("node", "shingles"), "sets", "lz4")

    def marked(self, pairs: DataFrame) -> DataFrame:
        """The pairs(a, b, a_n, b_n) that pass the sketch filter."""
        marks = self.nodes.select("node", "marks")
        both = pairs.join(marks.select(F.col("node").alias("a"), F.col("marks").alias("a_marks")), "a").join(marks.select(F.col("node").alias("b"), F.col("marks").alias("b_marks")), "b")
        return both.filter(_sketches_meet(self.num, self.den)).select("a", "b")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The links among pairs(a, b), which are distinct and written."""
        ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
        asked = materialize(self.nodes.select("node", "digest", "first_doc").join(ends, "node"), "asked")
        sets, degree = self.sets(asked), asked.select("node", "degree")
        # the end with more candidates is the hub; its set goes once to every HUB_PAIRS of them, the other's with the pair
        met = pairs.join(degree.select(F.col("node").alias("a"), F.col("degree").alias("a_degree")), "a").join(degree.select(F.col("node").alias("b"), F.col("degree").alias("b_degree")), "b")
        turn = F.col("a_degree") < F.col("b_degree")
        met = met.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b"), F.ceil(F.greatest("a_degree", "b_degree") / HUB_PAIRS).alias("parts"))
        met = met.withColumn("chunk", F.pmod(F.xxhash64("b"), F.col("parts"))).drop("parts")
        hubs = met.select("a", "chunk").distinct().join(sets.withColumnRenamed("node", "a"), "a").select("a", "chunk", F.lit(None).cast("long").alias("b"), "shingles")
        others = met.join(sets.withColumnRenamed("node", "b"), "b").select("a", "chunk", "b", "shingles")
        rows = hubs.unionAll(others).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.asc_nulls_first("b"))
        with arrow_rows(self.docs.sparkSession, BATCH_ROWS):
            links = materialize(rows.mapInArrow(lean(_verify(self.num, self.den)), "a long, b long"), "links")
        discard(asked, sets)
        return links

    def across_components(self, lists: DataFrame, comp: DataFrame, known: DataFrame) -> DataFrame:
        """Pairs of different components that share a list and pass the filters, without the known ones."""
        spans = materialize(lists.drop("least").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "spans")
        mixed = spans.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("shingle")
        # linked sets differ in size by the threshold at most, so classes of that width meet their own and the next one
        size = F.floor(F.log(F.col("n").cast("double")) / max(-math.log(self.num / self.den), 1e-6)).cast("long")
        entries = spans.join(mixed, "shingle").join(self.nodes.select("node", "marks"), "node").withColumn("size", size)
        a, b = ([F.col(c).alias(f"{side}_{c}" if c != "node" else side) for c in ("node", "n", "pos", "comp", "marks")] for side in "ab")
        early = entries.filter("early").select("shingle", "size", *a)
        late = entries.select("shingle", F.explode(F.array(F.col("size"), F.col("size") - 1, F.col("size") - 2)).alias("size"), *b)
        pairs = early.join(late, ["shingle", "size"]).filter("a_comp != b_comp and (a_n < b_n or a_n = b_n and a < b)")
        pairs = pairs.filter(_passes(self.num, self.den)).filter(_sketches_meet(self.num, self.den)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        found = materialize(pairs.distinct().join(known, ["a", "b"], "left_anti"), "pairs")
        discard(spans)
        return found

    def run(self) -> DataFrame:
        lists = self.shared_lists()
        heads = lists.filter("pos = least").groupBy("shingle").agg(F.min(F.struct("node", "n", "pos")).alias("head"))
        first = (
            lists.join(heads, "shingle")
            .filter("head.node != node")
            .select(F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("pos").alias("b_pos"), F.col("head.node").alias("a"), F.col("head.n").alias("a_n"), F.col("head.pos").alias("a_pos"))
            .filter(_passes(self.num, self.den))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("a_n")).otherwise(F.col("b_n")).alias("a_n"), F.when(F.col("a") < F.col("b"), F.col("b_n")).otherwise(F.col("a_n")).alias("b_n"))
            .distinct()
        )
        first = materialize(first, "candidates")
        near = materialize(self.marked(first), "pairs")
        links = self.verified(near)
        comp = self.first_comp = connected_components(links, "a", "b")
        rest = self.across_components(lists, comp, first.select("a", "b"))
        more = self.across = self.verified(rest)
        discard(lists, first, near, rest, links)
        if not more.isEmpty():
            # components hang together through their smallest nodes
            links = materialize(more.union(comp.filter("node != comp").select(F.col("comp").alias("a"), F.col("node").alias("b"))), "links")
            comp = connected_components(links, "a", "b")
            discard(links)
        named = self.nodes.select("node", "digest", "first_doc").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        smallest = named.groupBy("comp").agg(F.min("first_doc").alias("component_id"))
        self.classes = materialize(named.join(smallest, "comp").select("digest", "component_id"), "classes")
        if comp is not self.first_comp:
            discard(comp)
        return self.by_row(self.classes)

    def by_row(self, classes: DataFrame, *more) -> DataFrame:
        return self.rows.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(classes, "digest", "left").select(
            "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), *more
        )

    def link_counts(self) -> DataFrame:
        """digest, n_links of a document with that set; after run(), which finds the components."""
        asked = materialize(self.nodes.select("node", "digest", "first_doc", "members").join(self.first_comp, "node"), "asked")
        parts = asked.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / BLOCK_NODES).cast("int").alias("parts"))
        placed = asked.join(parts, "comp").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int"))
        self.linked_sets = self.sets(asked)
        placed = placed.join(self.linked_sets, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        blocks = placed.select("comp", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "node", "members", "shingles")
        inside = blocks.repartition("comp", "lo", "hi").sortWithinPartitions("comp", "lo", "hi").mapInArrow(lean(_count_links(self.num, self.den)), "node long, links long")
        size = self.nodes.select("node", "members")
        ends = self.across.union(self.across.select("b", "a"))
        outside = ends.join(size.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), F.col("members").alias("links"))
        linked = inside.union(outside).groupBy("node").agg(F.sum("links").alias("links"))
        return self.nodes.select("node", "digest", "members").join(linked, "node", "left").select("digest", (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))


def similarity_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Near-duplicate components of documents(doc_id, text).

    Two texts link when den * |intersection| >= num * |union| of their sets of
    n-word shingles (lower-case A-Z, words between ASCII white space; a shorter
    text is one shingle), 0 < num < den.  Returns one row per row of docs: doc_id, n_shingles,
    component_id (the smallest doc_id that links reach).

    Edge cases: null and empty texts and texts of white space have no shingles
    and link with nothing; a null doc_id keeps its size, has a null
    component_id and links with nothing; rows repeated under one doc_id are
    documents of their own; other columns are ignored; an empty table gives an
    empty result.
    """
    join = _Join(docs, n, num, den)
    found = join.run()
    discard(join.first_comp, join.across, join.nodes)
    return found


def similarity_links(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of similarity_components with n_links: how many other rows link with the row.

    Every link counts, not only those that make a component; rows without
    shingles or doc_id have 0.
    """
    join = _Join(docs, n, num, den)
    join.run()
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        classes = materialize(join.classes.join(join.link_counts(), "digest"), "classes")
    discard(join.classes, join.linked_sets, join.first_comp, join.across, join.nodes)
    return join.by_row(classes, F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"))


def keep_one_per_component(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents whose doc_id names their component: one of each group, all columns.

    Rows with a null doc_id stay.  Of rows repeated under one doc_id all stay
    if the component bears that doc_id.
    """
    join = _Join(docs, n, num, den)
    found = join.run()
    # written first: of a table whose size is known Spark sees whether it can be broadcast, which spares the texts a shuffle
    gone = materialize(found.filter("doc_id != component_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    discard(join.rows, join.classes, join.first_comp, join.across, join.nodes)
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
