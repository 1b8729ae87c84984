"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting: round after round every feature in turn gets a shallow tree
on the current gradients, added to that feature's lookup table; then the pairs
of features that explain most of what is left get small trees over two
features each, added to two-dimensional tables.  A score is the logistic of an
intercept plus one table entry for every feature and pair.

Features come from the text alone.  Training collects a bounded sample of
labelled feature rows; scoring makes the features where a text is read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.shingles import tables, text_bytes, word_hashes

FEATURES = (
    "log_bytes upper digits symbols bangs stops commas newlines word_length long_words distinct_words top_word "
    "repeated_next distinct_triples lone_symbols symbol_ends capitals distinct_lines line_length blanks"
).split()
#: Labelled rows that training may collect; the sample is the smallest hashes of doc_id.
MAX_TRAINING_ROWS = 40_000
BINS, PAIR_BINS = 32, 12
ROUNDS, PAIR_ROUNDS, PAIRS = 150, 60, 8
RATE, LEAVES, RIDGE = 0.1, 4, 1.0


def _byte_classes() -> np.ndarray:
    kind = np.zeros(256, dtype=np.int64)  # 0: letters, as all bytes over 127
    kind[65:91], kind[48:58] = 1, 2
    kind[list(range(33, 48)) + list(range(58, 65)) + list(range(91, 97)) + list(range(123, 127))] = 3
    kind[ord("!")], kind[ord(".")], kind[ord(",")], kind[10] = 4, 5, 6, 7
    kind[[9, 11, 12, 13, 32]] = 8
    kind[[x for x in range(32) if not 9 <= x <= 13] + [127]] = 9
    return kind


_KIND = _byte_classes()


def features(a: np.ndarray) -> np.ndarray:
    """The feature row of a text given as UTF-8 bytes; zeros for an empty one."""
    out = np.zeros(len(FEATURES), dtype=np.float32)
    if not len(a):
        return out
    kind = _KIND[a]
    many = np.bincount(kind, minlength=10)
    size, letters = len(a), max(1, many[0] + many[1])
    gap = np.ones(size + 2, dtype=np.int8)
    gap[1:-1] = tables()[1][a]
    edge = np.diff(gap)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    words = max(1, len(start))
    length = end - start
    h = word_hashes(a)
    seen = np.unique(h, return_counts=True)[1] if len(h) else np.array([0])
    triples = h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] if len(h) > 2 else h[:1]
    first, last = kind[start] if len(start) else np.array([0]), kind[end - 1] if len(end) else np.array([0])
    odd = (last == 3) | (last == 4)
    breaks = np.flatnonzero(kind == 7)
    lines = a.tobytes().split(b"\n")
    out[:] = (
        np.log1p(size), many[1] / letters, many[2] / size, many[3] / size, many[4] / size, many[5] / words, many[6] / words, many[7] / words,
        length.mean() if len(length) else 0, (length > 20).sum() / words, len(seen) / words, seen.max() / words,
        (h[1:] == h[:-1]).sum() / words, len(np.unique(triples)) / max(1, len(triples)), (odd & (length == 1)).sum() / words if len(length) else 0,
        odd.sum() / words, ((first == 1).sum() / words), len(set(lines)) / len(lines), np.log1p(size / (len(breaks) + 1)), (many[8] + many[7]) / size,
    )
    return out


def _matrix(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), dtype=np.float32).reshape(-1, len(FEATURES))


def _line_tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Values of a tree with so many leaves over the bins of one feature, by best-first splits."""
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    value = lambda lo, hi: -(G[hi] - G[lo]) / (H[hi] - H[lo] + RIDGE)
    gain = lambda lo, hi: (G[hi] - G[lo]) ** 2 / (H[hi] - H[lo] + RIDGE)

    def split(lo, hi):
        if hi - lo < 2:
            return 0.0, lo
        at = np.arange(lo + 1, hi)
        won = gain(lo, at) + gain(at, hi) - gain(lo, hi)
        best = int(np.argmax(won))
        return float(won[best]), int(at[best])

    parts = [(0, len(g))]
    while len(parts) < leaves:
        won, at, i = max((*split(lo, hi), i) for i, (lo, hi) in enumerate(parts))
        if won <= 1e-9:
            break
        lo, hi = parts[i]
        parts[i : i + 1] = [(lo, at), (at, hi)]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = value(lo, hi)
    return out


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int | None, int]:
    """Score of the two parts of the best cut of a grid along either axis, the axis and the place."""
    score = lambda a, b: a * a / (b + RIDGE)
    G, H = g.sum(), h.sum()
    best = (float(score(G, H)), None, 0)
    for axis in (0, 1):
        cg, ch = np.cumsum(g.sum(1 - axis))[:-1], np.cumsum(h.sum(1 - axis))[:-1]
        if len(cg):
            won = score(cg, ch) + score(G - cg, H - ch)
            at = int(np.argmax(won))
            if won[at] > best[0] + 1e-9:
                best = float(won[at]), axis, at + 1
    return best


def _square_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Values of a tree of depth two over two features' bins, and its score.

    The first cut is the one whose halves, cut once more, score best: of an
    interaction without main effects no single cut shows anything.
    """
    best = None
    for axis in (0, 1):
        for at in range(1, g.shape[axis]):
            halves = [np.split(x, [at], axis=axis) for x in (g, h)]
            cuts = [_best_cut(a, b) for a, b in zip(*halves)]
            if best is None or sum(c[0] for c in cuts) > best[0]:
                best = sum(c[0] for c in cuts), axis, halves, cuts
    leaf = lambda a, b: np.full(a.shape, -a.sum() / (b.sum() + RIDGE))
    if best is None:
        return leaf(g, h), 0.0
    total, axis, halves, cuts = best
    sides = []
    for a, b, (_, across, at) in zip(*halves, cuts):
        parts = [(a, b)] if across is None else list(zip(np.split(a, [at], axis=across), np.split(b, [at], axis=across)))
        sides.append(np.concatenate([leaf(*p) for p in parts], axis=across or 0))
    return np.concatenate(sides, axis=axis), total


class AdditiveModel:
    """Intercept, cut points and tables for every feature, tables for chosen pairs."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(len(FEATURES))]
        self.pair_cuts = [c[np.unique(np.linspace(0, len(c) - 1, PAIR_BINS - 1).astype(int))] if len(c) else c for c in self.cuts]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        rate = (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(rate / (1 - rate)))
        if len(np.unique(y)) == 2:
            self._fit(x, y.astype(float))

    def _fit(self, x: np.ndarray, y: np.ndarray) -> None:
        bins = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.cuts)]
        margin = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for f, table in enumerate(self.tables):
                p = 1 / (1 + np.exp(-margin))
                g, h = np.bincount(bins[f], p - y, len(table)), np.bincount(bins[f], p * (1 - p), len(table))
                step = RATE * _line_tree(g, h, LEAVES)
                table += step
                margin += step[bins[f]]
        coarse = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.pair_cuts)]

        def grid(i, j):
            shape = len(self.pair_cuts[i]) + 1, len(self.pair_cuts[j]) + 1
            p, cell = 1 / (1 + np.exp(-margin)), coarse[i] * shape[1] + coarse[j]
            return cell, [np.bincount(cell, w, shape[0] * shape[1]).reshape(shape) for w in (p - y, p * (1 - p))]

        gains = sorted(((round(_square_tree(*grid(i, j)[1])[1], 6), i, j) for i in range(len(FEATURES)) for j in range(i)), reverse=True)[:PAIRS]
        self.pairs = [(i, j, np.zeros((len(self.pair_cuts[i]) + 1, len(self.pair_cuts[j]) + 1))) for _, i, j in gains]
        for _ in range(PAIR_ROUNDS):
            for i, j, table in self.pairs:
                cell, (g, h) = grid(i, j)
                step = RATE * _square_tree(g, h)[0]
                table += step
                margin += step.ravel()[cell]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1: one lookup and addition for every feature and pair."""
        margin = np.full(len(x), self.base)
        for f, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            margin += table[np.searchsorted(cuts, x[:, f], side="right")]
        for i, j, table in self.pairs:
            margin += table[np.searchsorted(self.pair_cuts[i], x[:, i], side="right"), np.searchsorted(self.pair_cuts[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAINING_ROWS) -> AdditiveModel:
    """Fit on labelled rows outside the held-out third, at most max_rows of them (smallest hashes of doc_id).

    The chosen labels, max_rows at most, are broadcast, so that texts are
    filtered where they are read; features are made for them alone.
    """
    marked = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)

    def feature_rows(batches):
        for batch in batches:
            rows = [features(text).tobytes() for text in text_bytes(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(rows, pa.binary()), batch.column(2)], ["doc_id", "features", "y"])

    sample = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    rows = sample.select("doc_id", "text", "y").mapInArrow(feature_rows, "doc_id long, features binary, y int").orderBy(F.xxhash64("doc_id"), "doc_id", "y", "features").limit(max_rows).collect()
    x = _matrix([bytes(r["features"]) for r in rows])
    return AdditiveModel(x, np.array([r["y"] for r in rows], dtype=np.int64))


def _scored(model, batch: pa.RecordBatch, at: int) -> np.ndarray:
    return model.value.score(np.array([features(text) for text in text_bytes(batch.column(at))], dtype=np.float32).reshape(-1, len(FEATURES)))


def score_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of documents(doc_id, text).

    Null and empty texts get the score of an all-zero feature row; without
    labelled rows of both values every score is the share of ones (0.5 if
    there are none).  Null doc_ids are scored, are never training rows and have
    held_out false; repeated rows are scored each; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_rows=max_rows))

    def scored(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(_scored(model, batch, 1), pa.float64())], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose score is least or more, all their columns; the model is trained as in score_quality.

    Texts are scored where they are, without a join.  Null and empty texts are
    judged like any other text.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def kept(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_scored(model, batch, at) >= least))

    return docs.mapInArrow(kept, docs.schema)
