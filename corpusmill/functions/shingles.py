"""Vectorised 64-bit hashes of words and word shingles, straight from UTF-8 bytes, and how often they occur.

A word is a maximal run of bytes other than space and 0x09-0x0D, with A-Z
lower-cased.  Its hash is a polynomial over a random byte table, computed for
all words of a text with one running sum modulo 2^64 and then mixed.

Slot counts tell rare shingles from frequent ones in a table of bounded size:
how often each of 2^16 to 2^22 hash slots is hit by the distinct shingles of a
text, over all texts.
"""

from __future__ import annotations

import ctypes
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.sources.workdir import arrow_rows

#: The slot table has one slot for about BYTES_A_SLOT bytes of text, 2^MOST_SLOT_BITS at most.
LEAST_SLOT_BITS, MOST_SLOT_BITS, BYTES_A_SLOT = 16, 22, 256
SLOT_PARTS = 256

SEGMENT = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1


def _powers(base: int) -> np.ndarray:
    out = np.full(SEGMENT + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: tuple | None = None


def tables() -> tuple:
    """Byte table, space flags, powers and inverse powers; built once in a worker."""
    global _tables
    if _tables is None:
        rng = np.random.Generator(np.random.PCG64(20240229))
        byte = rng.integers(1, _MASK, size=256, dtype=np.uint64, endpoint=True)
        byte[65:91] = byte[97:123]
        space = np.zeros(256, dtype=bool)
        space[[9, 10, 11, 12, 13, 32]] = True
        byte[space] = 0
        _tables = byte, space, _powers(_BASE), _powers(_INVERSE)
    return _tables


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _segment(a: np.ndarray) -> np.ndarray:
    byte, space, power, inverse = tables()
    sums = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum(byte[a] * power[: len(a)], out=sums[1:])
    gap = np.ones(len(a) + 2, dtype=np.int8)
    gap[1:-1] = space[a]
    edge = np.diff(gap)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return (sums[end] - sums[start]) * inverse[start]


def _long_word(a: np.ndarray) -> np.ndarray:
    """The hash of one word longer than a segment, as if it stood at the start."""
    byte, _, power, _ = tables()
    total, factor = 0, 1
    for lo in range(0, len(a), SEGMENT):
        part = a[lo : lo + SEGMENT]
        total = (total + factor * int(np.sum(byte[part] * power[: len(part)], dtype=np.uint64))) & _MASK
        factor = factor * pow(_BASE, len(part), 1 << 64) & _MASK
    return np.array([total], dtype=np.uint64)


def word_hashes(a: np.ndarray) -> np.ndarray:
    """Hashes of the words of a text given as its UTF-8 bytes."""
    if len(a) <= SEGMENT:
        return mix(_segment(a))
    space, out, lo = tables()[1], [], 0
    while lo < len(a):
        hi = lo + SEGMENT
        if hi < len(a):
            gaps = np.flatnonzero(space[a[lo:hi]])
            if len(gaps):
                hi = lo + int(gaps[-1]) + 1
            else:
                while hi < len(a) and not space[a[hi]]:
                    hi += 1
                out.append(_long_word(a[lo:hi]))
                lo = hi
                continue
        out.append(_segment(a[lo:hi]))
        lo = hi
    return mix(np.concatenate(out))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; the whole sequence if it is shorter; none without words."""
    if not len(words):
        return words
    n = min(n, len(words))
    k = len(words) - n + 1
    h = words[:k].copy()
    for i in range(1, n):
        h *= np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(28)
        h += words[i : i + k]
    h += np.uint64(n)
    return mix(h)


def shingle_set(a: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(word_hashes(a), n))


#: Rows of texts or sets that a kernel gets at once.
BATCH_ROWS = 2000


def _trim() -> None:
    """Give memory that is free back to the system: that of Arrow, and that of the C library where it can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def lean(run):
    """An Arrow kernel that hands memory back when it ends, as workers outlive their tasks."""

    def kernel(batches):
        yield from run(batches)
        _trim()

    return kernel


def text_bytes(column: pa.Array):
    """Yield each text of an Arrow string column as a view of its bytes; null gives none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    count = len(column)
    if not count:
        return
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + count + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    for i in range(count):
        yield raw[at[i] : at[i + 1]]  # a null text has no bytes


def slot_of(shingles: np.ndarray, bits: int) -> np.ndarray:
    return (shingles >> np.uint64(64 - bits)).astype(np.int64)


def _narrow(hits: np.ndarray) -> bytes:
    """Counts in the narrowest type that holds them all; the length tells the type."""
    return hits.astype(np.min_scalar_type(int(hits.max()))).tobytes()


def _wide(data, bits: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"u{len(data) * SLOT_PARTS >> bits}").astype(np.int64)


def _count_slots(n: int, bits: int):
    """Per task: hits of every slot by the distinct shingles of each text, as SLOT_PARTS pieces; pieces without hits are left out."""

    def run(batches):
        total = np.zeros(1 << bits, dtype=np.uint32)
        held, size = [], 0
        for batch in batches:
            for text in text_bytes(batch.column(0)):
                held.append(slot_of(shingle_set(text, n), bits))
                size += len(held[-1])
                if size > 1 << 18:
                    total += np.bincount(np.concatenate(held), minlength=len(total)).astype(np.uint32)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total)).astype(np.uint32)
        pieces = [(i, _narrow(x)) for i, x in enumerate(total.reshape(SLOT_PARTS, -1)) if x.any()]
        if pieces:
            yield pa.record_batch([pa.array([i for i, _ in pieces], pa.int32()), pa.array([x for _, x in pieces], pa.binary())], ["part", "hits"])

    return run


def _sum_slots(bits: int):
    """Running sums by piece: a task holds its pieces of the table, however many tasks sent some."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, hits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = _wide(hits, bits)
                total[part] = total[part] + got if part in total else got
        for part, hits in total.items():
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([_narrow(hits)], pa.binary())], ["part", "hits"])

    return run


def slot_counts(docs: DataFrame, n: int) -> np.ndarray:
    """Hits of each hash slot over all texts; 16 MB on the driver at most."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(math.ceil(math.log2(max(size / BYTES_A_SLOT, 1))), LEAST_SLOT_BITS), MOST_SLOT_BITS)
    kind = "part int, hits binary"
    parts = docs.select("text").mapInArrow(lean(_count_slots(n, bits)), kind).repartition("part").mapInArrow(_sum_slots(bits), kind)
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        rows = parts.collect()
    total = np.zeros((SLOT_PARTS, (1 << bits) // SLOT_PARTS), dtype=np.uint32)
    for row in rows:
        total[row["part"]] = np.minimum(_wide(bytes(row["hits"]), bits), np.iinfo(np.uint32).max)
    return total.ravel()


def rare_first(shingles: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Places of sorted shingles from rare to frequent, ties by hash; slots as slot_counts() gives them."""
    return np.argsort(slots[slot_of(shingles, len(slots).bit_length() - 1)], kind="stable")


def sets_of(n: int, empty: bool = False):
    """An Arrow kernel: (key, text) to (key, s), the sorted distinct shingle hashes; with empty, a text without words has the hash 0."""
    none = np.zeros(1 if empty else 0, dtype=np.uint64)

    def run(batches):
        for batch in batches:
            sets = [s if len(s) else none for s in (shingle_set(text, n) for text in text_bytes(batch.column(1)))]
            ends = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate(sets) if sets else none[:0]
            yield pa.record_batch([batch.column(0), pa.LargeListArray.from_arrays(ends, flat.view(np.int64)).cast(pa.list_(pa.int64()))], ["key", "s"])

    return run
