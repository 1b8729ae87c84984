import random
import re

from corpusmill.llm import decontaminate as d


def grams(text, n=5):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(docs, items):
    best = {}
    for item, t in items:
        for doc, x in docs:
            a, b = grams(t), grams(x)
            if item is not None and doc is not None and a and 100 * len(a & b) >= 80 * len(a):
                best[item, doc] = max(best.get((item, doc), (0, 0)), (len(a & b), len(a)))
    return sorted((*k, *v) for k, v in best.items())


def data():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(3, 60)))) for i in range(30)]
    items += [(100, None), (101, ""), (102, "..."), (103, "Just four words here"), (3, items[3][1]), (None, items[4][1])]
    docs = []
    for i in range(120):
        filler = rng.choices(words, k=rng.randrange(5, 1500))
        part = items[rng.randrange(30)][1].split()
        for _ in range(rng.randrange(4)):
            part[rng.randrange(len(part))] = "edited"
        at = rng.randrange(len(filler))
        docs.append((i, " ".join(filler[:at] + [w.upper() if rng.random() < 0.2 else w + "," * (rng.random() < 0.2) for w in part] + filler[at:])))
    return docs + [(200, None), (201, ""), (202, "just FOUR words, here!"), (203, "just four words here and more"), (7, docs[7][1]), (None, items[4][1]), (300, items[5][1] + " x" * 50_000)], items


def test_equal_to_brute_force(spark, monkeypatch):
    docs, items = data()
    left = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, item_id string").repartition(4)
    right = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    expected = brute(docs, items)
    assert len(expected) > 40
    for bound in (d.MAX_BROADCAST_HASHES, 0):
        monkeypatch.setattr(d, "MAX_BROADCAST_HASHES", bound)
        monkeypatch.setattr(d, "MAX_BROADCAST_SHINGLES", bound)
        assert sorted(tuple(r) for r in d.containment_pairs(left, right).collect()) == expected
    clean = {r["doc_id"] for r in d.decontaminate(left, right).collect()}
    assert clean == {k for k, _ in docs} - {k for _, k, *_ in expected}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert d.containment_pairs(docs.limit(0), items).collect() == []
    assert d.containment_pairs(docs, items.limit(0)).collect() == []
    assert d.decontaminate(docs, items.limit(0)).count() == 1


def test_partitions_have_sketches_of_their_own(spark):
    rng = random.Random(8)
    items = [(m, " ".join(f"w{rng.randrange(10**6)}" for _ in range(m + 4))) for m in (1, 2, 3, 5, 12, 31, 32, 63, 64, 200, 1000)]
    got = {r["item_id"]: r for r in d.item_sketches(spark.createDataFrame(items, "item_id long, text string"), 5, 80, 100).collect()}
    for m, r in got.items():
        largest = 2 ** m.bit_length() - 1
        assert (r["m"], r["partition"], r["gap"]) == (m, m.bit_length() - 1, m - -(-m * 4 // 5))
        assert r["k"] == min(m, 2 * (largest - -(-largest * 4 // 5)) + 2) and r["k"] > r["gap"]
        assert [x["h"] for x in r["z"]] == sorted(x["h"] for x in r["z"])
