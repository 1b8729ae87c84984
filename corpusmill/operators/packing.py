"""Tokens: fertility, packing into sequences of fixed length, boundary masks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import words

IGNORED, BATCH, TOKEN_PREFIX = -100, 1000, 1000


def whitespace_tokens(text: Column) -> Column:
    """The default tokeniser: words."""
    return words(text)


def _moments(column: str, name: str) -> list[Column]:
    """Mean and population deviation from sums of whole 10^-9 parts, which do not hang on the order of rows."""
    x = F.round(F.col(column) * 1_000_000_000).cast("decimal(38,0)")
    n = F.count(F.lit(1)).cast("double")
    mean = F.sum(x).cast("double") / n
    square = F.sum((x * x).cast("decimal(38,0)")).cast("double") / n
    return [F.round(mean / 1e9, 6).alias(name), F.round(F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))) / 1e9, 6).alias(f"{name}_std")]


def fertility(docs: DataFrame, tokenize: Callable[[Column], Column] = whitespace_tokens, text: str = "text") -> DataFrame:
    """Means and population deviations of tokens per character and per word, to six digits; mean and median token length
    over the first 1000 tokens of each text, word marks not counted."""
    t = docs.select(F.length(text).alias("chars"), F.size(words(F.col(text))).alias("words"), tokenize(F.col(text)).alias("tok")).filter("chars > 0 and words > 0")
    rate = t.select((F.size("tok") / F.col("chars")).alias("c"), (F.size("tok") / F.col("words")).alias("w"))
    means = rate.agg(*_moments("c", "tokens_per_char"), *_moments("w", "tokens_per_word"), F.count(F.lit(1)).alias("n_texts"))
    lengths = t.select(F.explode(F.slice("tok", 1, TOKEN_PREFIX)).alias("x")).select(F.length(F.translate("x", "▁Ġ", "")).alias("n"))
    counts = lengths.groupBy("n").agg(F.count(F.lit(1)).alias("k"))  # few rows
    size = counts.agg((F.sum(F.col("n") * F.col("k")) / F.sum("k")).alias("mean_token_length"), F.percentile("n", F.lit(0.5), F.col("k")).alias("median_token_length"))
    return means.join(F.broadcast(size), F.lit(True))


def compare_fertility(a: DataFrame, b: DataFrame, column: str = "tokens_per_word") -> DataFrame:
    """fertility_ratio and gap_pct of two one-row audits."""
    both = a.select(F.col(column).alias("a")).join(b.select(F.col(column).alias("b")), F.lit(True))
    return both.select((F.col("a") / F.greatest("b", F.lit(1e-8))).alias("fertility_ratio"), ((F.col("a") - F.col("b")) / F.greatest("b", F.lit(1e-8)) * 100).alias("gap_pct"))


def _pack(length: int, eos: int):
    """(batch, key, tokens) sorted by the first two: full sequences of each batch; what a sequence lacks is held, no more."""

    def run(batches):
        now, seq, held, marked = None, 0, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
        for rows in batches:
            found = []
            for batch, tokens in zip(rows.column(0).to_pylist(), _arrays(rows.column(2))):
                if batch != now:
                    now, seq, held, marked = batch, 0, held[:0], marked[:0]
                if len(held):
                    held, marked = np.append(held, eos), np.append(marked, True)
                held, marked = np.concatenate([held, tokens]), np.concatenate([marked, np.zeros(len(tokens), dtype=bool)])
                full = len(held) // length
                for i in range(full):
                    ids, ends = held[i * length : (i + 1) * length], marked[i * length : (i + 1) * length]
                    after = np.append(False, ends[:-1])
                    found.append((batch, seq, ids, np.where(ends | after, IGNORED, ids)))
                    seq += 1
                held, marked = held[full * length :], marked[full * length :]
            yield pa.record_batch(
                [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))], ["batch", "seq", "input_ids", "labels"]
            )

    return run


def _arrays(column: pa.Array):
    """Each list of a column as an array; null is empty."""
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    for lo, hi, ok in zip(ends[:-1], ends[1:], column.is_valid().to_pylist()):
        yield flat[lo:hi] if ok else flat[:0]


def pack(docs: DataFrame, length: int, eos: int, key: str = "doc_id", tokens: str = "tokens", batch: int = BATCH) -> DataFrame:
    """batch, seq, input_ids, labels: token lists joined in order of key and cut every length tokens.

    Documents are taken in batches of consecutive keys (key // batch); an EOS
    goes before a document unless the batch's buffer is empty, that is unless
    the offset is a multiple of length; the rest of a batch that fills no
    sequence is dropped.  In labels an EOS and the token after it in the same
    sequence are -100.

    Token lists are shuffled once, by batch, and read as a sorted stream.
    """
    rows = docs.select(F.floor(F.col(key) / batch).cast("long").alias("batch"), F.col(key).alias("key"), F.col(tokens).cast("array<bigint>").alias("tokens"))
    streams = rows.repartition("batch").sortWithinPartitions("batch", "key")
    return streams.mapInArrow(_pack(length, eos), "batch long, seq long, input_ids array<bigint>, labels array<bigint>")


def unpacked(docs: DataFrame, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """key, input_ids: token lists as they are, neither joined nor cut."""
    return docs.select(key, F.col(tokens).alias("input_ids"))


def padded(rows: DataFrame, pad: int, ids: str = "input_ids", labels: str = "labels") -> DataFrame:
    """A batch for training: ids and labels filled up to the longest row with pad and -100; attention_mask is 1 on what was there.

    The longest row is found in a first pass over lengths.
    """
    longest = rows.agg(F.coalesce(F.max(F.size(ids)), F.lit(0))).first()[0]
    room = lambda c, fill: F.concat(F.col(c), F.array_repeat(F.lit(fill).cast(rows.schema[c].dataType.elementType), F.lit(longest) - F.size(c)))
    mask = F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), F.lit(longest) - F.size(ids)))
    return rows.withColumns({ids: room(ids, pad), labels: room(labels, IGNORED), "attention_mask": mask})


#: How texts are split before the merges of a rank file.
RANK_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_tokenizer(path: str, split: str = RANK_SPLIT) -> Callable[[list[str]], list[list[int]]]:
    """An encoder from a vocabulary file: tokenizer JSON, a sentencepiece model, or a tiktoken rank file with its split.  Special tokens are plain text."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        loaded.encode_special_tokens = True
        return lambda texts: [e.ids for e in loaded.encode_batch(texts, add_special_tokens=False)]
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: model.encode(texts)
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in f if line.strip())}
    encoding = tiktoken.Encoding(path, pat_str=split, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: encoding.encode_ordinary_batch(texts)


def encode(docs: DataFrame, load: Callable[[], Callable[[list[str]], list[list[int]]]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, tokens by a tokenizer that load() brings up once in a task; null texts have no tokens.

    load must find its file on every executor, for example one that the
    session ships with addFile.
    """

    def run(batches):
        tokenize = load()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([list(map(int, t)) for t in tokenize(texts)] if texts else [], pa.list_(pa.int64()))], ["key", "tokens"])

    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, tokens array<bigint>").withColumnRenamed("key", key)


def word_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: int = 32000) -> DataFrame:
    """tokens: a stand-in tokeniser for tests and queries: words hashed to 1 ... vocabulary."""
    h = lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % vocabulary + 1).cast("long")
    return docs.select(key, F.transform(words(F.col(text)), h).alias("tokens"))
