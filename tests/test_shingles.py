import numpy as np
import pyarrow as pa

from corpusmill.functions import shingles


def test_hashes_do_not_depend_on_place_or_segments(monkeypatch):
    text = ("Alpha beta\tGAMMA\x0bdelta " * 60 + "x" * 700 + " tail").encode()
    whole = shingles.word_hashes(np.frombuffer(text, dtype=np.uint8))
    alone = [int(shingles.word_hashes(np.frombuffer(w.lower(), dtype=np.uint8))[0]) for w in text.split()]
    assert whole.tolist() == alone
    monkeypatch.setattr(shingles, "SEGMENT", 128)
    assert shingles.word_hashes(np.frombuffer(text, dtype=np.uint8)).tolist() == alone


def test_slot_counts_add_up_and_order(spark):
    texts = ["a b c d e f"] * 5 + ["x y z"] + [None, "", "one two three four"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    slots = shingles.slot_counts(docs, 3)
    sets = [shingles.shingle_set(np.frombuffer((t or "").encode(), dtype=np.uint8), 3) for t in texts]
    expected = np.zeros(len(slots), dtype=np.int64)
    for s in sets:
        np.add.at(expected, shingles.slot_of(s, len(slots).bit_length() - 1), 1)
    assert slots.tolist() == expected.tolist() and slots.sum() == sum(map(len, sets))
    both = np.sort(np.concatenate([sets[0], sets[5]]))
    assert both[shingles.rare_first(both, slots)[0]] == sets[5][0]


def test_sets_of_a_batch():
    batch = pa.record_batch([pa.array([1, 2, 3]), pa.array(["a b c", None, "a B"])], ["k", "t"])
    plain, marked = (next(shingles.sets_of(2, empty)([batch])).to_pydict()["s"] for empty in (False, True))
    assert [len(x) for x in plain] == [2, 0, 1] and marked[1] == [0] and set(plain[2]) < set(plain[0])
