import zlib

import numpy as np
import pandas as pd
import pytest

from corpusmill.llm import quality_gam as gam
from corpusmill.llm.quality_gam import FEATURES, AdditiveModel, features, keep_good, score_quality, train

DATA = "/root/testdata/sf0.1"


def test_held_out_accuracy_and_contract(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = score_quality(docs, labels).toPandas()
    truth = labels.toPandas().set_index("doc_id")["quality"]
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]).all()
    assert (got["predicted"] == (got["score"] >= 0.5)).all()
    held = got[got["held_out"]].set_index("doc_id").join(truth, how="inner")
    assert (held["predicted"] == held["quality"]).mean() > 0.95
    bad = held[held["quality"] == 0]
    assert (bad["predicted"] == 0).mean() > 0.85


def test_tables_learn_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.random((4000, len(FEATURES))).astype(np.float32)
    y = ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.5)).astype(int)
    model = AdditiveModel(x[:3000], y[:3000])
    assert {(2, 1)} <= {(i, j) for i, j, _ in model.pairs}
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(None, 1, 0), (1, None, 0), (2, 7, 0)]])
def test_odd_tables(spark, labels):
    texts = [None, "", " \n", "One word.", "é" * 10, "w " * 100_000, "One word."]
    docs = spark.createDataFrame([(i, t, 5.0) for i, t in enumerate(texts)] + [(3, "again", 0.0), (None, "x", 0.0)], "doc_id long, text string, score double")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, text int")
    got = score_quality(docs, marks).toPandas()
    assert len(got) == 9 and got["score"].between(0, 1).all() and got["score"].nunique() == 1
    assert keep_good(docs, marks).count() in (0, 9)
    assert score_quality(docs.limit(0), marks).collect() == []


def test_labels_of_the_held_out_third_are_not_learnt(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": ids, "text": ["a b" if i % 2 else "C D E!" for i in ids]}))
    marks = spark.createDataFrame(pd.DataFrame({"doc_id": ids, "quality": [i % 2 for i in ids]}))
    assert set(score_quality(docs, marks).toPandas()["score"]) == {0.5}


def test_the_sample_is_bounded(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    assert train(docs, labels, max_rows=5).base == pytest.approx(np.log(5.5 / 0.5), abs=3)


def test_features_are_finite():
    for text in (b"", b" ", b"\n\n", b"a", b"!!!", b"A B\xc3\xa9 1, 2. | ###"):
        row = features(np.frombuffer(text, dtype=np.uint8))
        assert np.isfinite(row).all() and len(row) == len(FEATURES)


def test_trees_take_the_best_cuts():
    rng = np.random.default_rng(4)
    worth = lambda g, h: g.sum() ** 2 / (h.sum() + gam.RIDGE)
    for _ in range(20):
        g, h = rng.normal(0, 1, 9), rng.random(9)
        tree = gam._line_tree(g, h, 2)
        best = max(range(1, 9), key=lambda at: worth(g[:at], h[:at]) + worth(g[at:], h[at:]))
        want = np.concatenate([np.full(len(p), -p.sum() / (q.sum() + gam.RIDGE)) for p, q in ((g[:best], h[:best]), (g[best:], h[best:]))])
        assert np.allclose(tree, want)
        g, h = rng.normal(0, 1, (4, 5)), rng.random((4, 5))

        def halves(a, b):
            out = [worth(a, b)]
            for axis in (0, 1):
                for at in range(1, a.shape[axis]):
                    out.append(sum(worth(x, y) for x, y in zip(np.split(a, [at], axis), np.split(b, [at], axis))))
            return max(out)

        best = max(sum(halves(x, y) for x, y in zip(np.split(g, [at], axis), np.split(h, [at], axis))) for axis in (0, 1) for at in range(1, g.shape[axis]))
        values, total = gam._square_tree(g, h)
        assert total == pytest.approx(best)
        assert sum(worth(g[values == v], h[values == v]) for v in np.unique(values)) == pytest.approx(best)


def test_a_score_is_a_sum_of_table_entries():
    rng = np.random.default_rng(5)
    x = rng.random((300, len(FEATURES))).astype(np.float32)
    y = (x[:, 0] + x[:, 3] * x[:, 4] > 0.8).astype(int)
    model = AdditiveModel(x, y)
    for row, score in zip(x[:40], model.score(x[:40])):
        place = lambda cuts, v: sum(c <= v for c in cuts)
        total = model.base + sum(t[place(c, v)] for c, t, v in zip(model.cuts, model.tables, row))
        total += sum(t[place(model.pair_cuts[i], row[i]), place(model.pair_cuts[j], row[j])] for i, j, t in model.pairs)
        assert score == pytest.approx(1 / (1 + np.exp(-total)))
