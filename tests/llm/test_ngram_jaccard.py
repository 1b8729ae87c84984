import re
import time
from itertools import combinations

import numpy as np
import pytest

from corpusmill.functions import shingles
from corpusmill.llm import ngram_jaccard
from corpusmill.llm.components import connected_components
from corpusmill.llm.ngram_jaccard import keep_one_per_component, similarity_components, similarity_links
from pyspark.sql import functions as F


def brute(rows, n, num, den):
    sets = []
    for _, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and rows[i][0] is not None and rows[j][0] is not None and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
            up[root(i)] = root(j)
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i)]
        out.append((key, len(sets[i]), None if key is None else min(ids)))
    return sorted(out, key=str)


def corpus():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = list(rng.choice(vocabulary, 30))
    rows, key = [], 0
    for size in (9, 40, 120):
        for _ in range(6):
            base = list(rng.choice(vocabulary, size))
            for edits in (0, 0, 1, 1, 2, 3, 5):
                text = base.copy()
                for at in rng.choice(size, edits, replace=False):
                    text[at] = f"new{rng.integers(10**6)}"
                if rng.random() < 0.2:
                    text = passage + text
                rows.append((int(key), (" " if rng.random() < 0.5 else "\n").join(text).upper() if rng.random() < 0.3 else " ".join(text)))
                key += 1
    return rows


EDGES = [(900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one"), (905, "one two three"), (906, "ONE TWO  three"), (None, "one two three"), (907, "É é"), (908, "é é"), (910, "a b c d e f"), (910, "a b c d e f"), (910, "q r s t u v")]


@pytest.mark.parametrize("n,num", [(4, 85), (5, 80)])
def test_components_equal_brute_force(spark, n, num):
    rows = corpus() + EDGES
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, component_id string").repartition(5)
    got = [tuple(r) for r in similarity_components(docs, n, num, 100).collect()]
    assert sorted(got, key=str) == brute(rows, n, num, 100)


@pytest.mark.parametrize("block", [256, 3])
def test_every_link_counts(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_jaccard, "BLOCK_NODES", block)
    base = [f"v{i}" for i in range(60)]
    rows = corpus() + EDGES + [(2000 + i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(0, 60, 5)]  # all near each other
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, n_links string").repartition(5)
    got = [tuple(r) for r in similarity_links(docs, 4, 70, 100).collect()]
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    near = lambda i, j: i != j and sets[i] and rows[i][0] is not None and rows[j][0] is not None and 100 * len(sets[i] & sets[j]) >= 70 * len(sets[i] | sets[j])
    counts = sorted(((k, sum(bool(near(i, j)) for j in range(len(rows)))) for i, (k, _) in enumerate(rows)), key=str)
    assert sorted(((r[0], r[3]) for r in got), key=str) == counts
    assert sorted((r[:3] for r in got), key=str) == brute(rows, 4, 70, 100)


def test_empty_table(spark):
    assert similarity_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_document_of_each_group_stays(spark):
    docs = spark.createDataFrame([(3, "a b c d e f g"), (1, "A b c d e f g"), (2, "other"), (None, "a b c d e f g")], "doc_id long, text string")
    assert sorted((r[0] for r in keep_one_per_component(docs).collect()), key=str) == [1, 2, None]


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["comp"] for r in connected_components(links, "a", "b").collect()}
    assert set(got.values()) == {0, 1000} and all(got[i] == 0 for i in range(201))


def test_suffix_bound_is_a_lower_bound():
    rng = np.random.default_rng(7)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, 60, rng.integers(0, 50))).astype(np.uint64) for _ in range(2))
        apart = len(np.setxor1d(x, y))
        for depth in range(5):
            assert abs(len(x) - len(y)) <= ngram_jaccard.suffix_bound(x, y, depth, 100) <= apart
        assert ngram_jaccard.suffix_bound(x, y, 8, 100) == apart
        assert (ngram_jaccard.suffix_bound(x, y, 3, 4) > 4) <= (apart > 4)


def test_pages_of_one_template_meet_in_no_list(spark):
    """Two words of each page are its own: no two pages link, all share one list of their prefixes."""
    frame = [f"frame{i}" for i in range(34)]
    pages = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.lit(w) if i not in (8, 24) else F.concat(F.lit(f"own{i}x"), F.col("id")) for i, w in enumerate(frame)]).alias("text"))
    start = time.monotonic()
    found = similarity_components(pages, 4, 85, 100)
    assert found.filter("component_id != doc_id").isEmpty() and found.count() == 20_000
    assert time.monotonic() - start < 45


@pytest.mark.parametrize("hub", [64, 2])
def test_hubs_send_their_set_in_parts(spark, monkeypatch, hub):
    monkeypatch.setattr(ngram_jaccard, "HUB_PAIRS", hub)
    monkeypatch.setattr(shingles, "MOST_SLOT_BITS", 16)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted((tuple(r) for r in similarity_components(docs, 5, 80, 100).collect()), key=str) == brute(rows, 5, 80, 100)
