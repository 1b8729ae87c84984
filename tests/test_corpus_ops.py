import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from corpusmill import config
from corpusmill.operators import contamination, dedup, mixtures, packing, quality
from corpusmill.sources import io
from corpusmill.streaming import events


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_exact_clusters(spark):
    got = dedup.exact_clusters(docs(spark, [(1, "A  b"), (2, "a B"), (3, ""), (4, " "), (5, "c"), (6, None)]))
    assert {r[0]: r[1] for r in got.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}
    stats = dedup.dedup_stats(got).first()
    assert (stats["n_clusters"], stats["n_duplicates_removed"]) == (5, 1)


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(0)
    rows = []
    for g in range(8):
        base = [f"w{rng.randrange(50)}" for _ in range(rng.randrange(6, 60))]
        for _ in range(4):
            t = base.copy()
            for _ in range(rng.randrange(3)):
                t[rng.randrange(len(t))] = f"e{rng.randrange(1000)}"
            rows.append((len(rows), " ".join(t)))
    grams = {k: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for k, t in rows}
    first = {}
    for k, t in rows:
        first.setdefault(t, k)
    expected = {(a, b) for a, b in combinations(sorted(first.values()), 2) if len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.8}
    found = dedup.near_duplicate_pairs(docs(spark, rows + [(None, rows[0][1])])).collect()
    assert {(r["a"], r["b"]) for r in found if not r["same"]} == expected and expected
    assert {(r["a"], r["b"]) for r in found if r["same"]} == {(first[t], k) for k, t in rows if first[t] != k}
    assert all(abs(r["jaccard"] - len(grams[r["a"]] & grams[r["b"]]) / len(grams[r["a"]] | grams[r["b"]])) < 1e-12 for r in found)
    w = docs(spark, rows).select("doc_id", F.transform(F.split("text", " "), lambda x: F.xxhash64(x)).alias("s"))
    sig = dedup.minhash(w, 32)
    assert all(len(r["signature"]) == 32 for r in sig.collect()) and dedup.lsh_candidates(sig, 0.5, 32).count() > 0


@pytest.mark.parametrize("band_rows", [1024, 2])
def test_lsh_candidates_are_all_pairs_of_a_band(spark, monkeypatch, band_rows):
    monkeypatch.setattr(dedup, "BAND_ROWS", band_rows)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(0, 200, 20)]  # near copies, the pairs (b, c) too
    rows += [(1000, rows[3][1]), (1001, rows[3][1]), (1002, "something else altogether here and now")]
    signatures = dedup.minhash(dedup.shingle_sets(docs(spark, rows)))
    signed = {r[0]: tuple(r[1]) for r in signatures.collect()}
    first = {}
    for k in sorted(signed):
        first.setdefault(signed[k], k)
    bands, n = dedup.bands_and_rows(dedup.THRESHOLD)
    agree = lambda a, b: any(signed[a][i * n : i * n + n] == signed[b][i * n : i * n + n] for i in range(bands))
    got = [tuple(r) for r in dedup.lsh_candidates(signatures).collect()]
    pairs = {(a, b) for a, b in combinations(sorted(first.values()), 2) if agree(a, b)}
    assert len(got) == len(set(got)) and {x[:2] for x in got if not x[2]} == pairs
    assert {x[:2] for x in got if x[2]} == {(first[s], k) for k, s in signed.items() if first[s] != k} == {(60, 1000), (60, 1001)}
    true = {(r["a"], r["b"]) for r in dedup.near_duplicate_pairs(docs(spark, rows)).collect() if not r["same"]}
    assert len(true) == 45 and len(true & pairs) >= 0.9 * len(true)


def test_star_clusters_equal_greedy(spark):
    rng = random.Random(3)
    for _ in range(2):
        n = 30
        edges = [(a, b) for a, b in combinations(range(n), 2) if rng.random() < 0.08]
        taken, expected = set(), {}
        for i in range(n):
            if i not in taken:
                for j in [i] + [b if a == i else a for a, b in edges if i in (a, b)]:
                    if j not in taken:
                        taken.add(j)
                        expected[j] = i
        got = dedup.star_clusters(spark.range(n).withColumnRenamed("id", "doc_id"), spark.createDataFrame(edges, "a long, b long"))
        assert {r[0]: r[1] for r in got.collect()} == expected


def test_near_copies_and_their_exact_copies_share_a_split(spark):
    base = [f"w{i}" for i in range(100)]
    near = " ".join(base[:50] + ["x"] + base[51:])
    rows = [(1, " ".join(base)), (2, near), (3, near.upper()), (4, " ".join(base)), (5, "other words"), (6, ""), (7, None)]
    clusters = dedup.near_duplicate_clusters(docs(spark, rows))
    assert sorted(map(tuple, clusters.collect())) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 6), (7, 7)]
    got = {r["doc_id"]: r["split"] for r in dedup.split_by_clusters(clusters, 0.1, 0.1).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7] and len({got[k] for k in (1, 2, 3, 4)}) == 1


def test_cluster_split_keeps_clusters_together(spark):
    clusters = spark.createDataFrame([(i, i // 3 * 3) for i in range(60)], "doc_id long, cluster_id long")
    rows = dedup.split_by_clusters(clusters, 0.1, 0.1).collect()
    seen = {}
    for r in rows:
        seen.setdefault(r["cluster_id"], set()).add(r["split"])
    assert len(rows) == 60 and all(len(s) == 1 for s in seen.values())
    n = {s: sum(r["split"] == s for r in rows) for s in ("validation", "test", "train")}
    assert n == {"validation": 6, "test": 6, "train": 48}
    assert {r["split"] for r in dedup.split_by_clusters(clusters, 0.0, 0.0).collect()} == {"train"}


def test_contamination(spark):
    text = "um dois três quatro cinco seis sete oito nove dez onze doze"
    d = contamination.normalized(docs(spark, [(1, text.upper() + "!"), (2, "nada a ver"), (3, "antes " + text + " depois")]), "doc_id")
    b = contamination.normalized(spark.createDataFrame([(7, text), (8, "outra coisa")], "item_id long, text string"), "item_id")
    assert [r[0] for r in contamination.exact_matches(d, b).collect()] == [1] == [r[0] for r in contamination.normalized_matches(d, b).collect()]
    over = {r["doc_id"]: r["overlap"] for r in contamination.ngram_overlap(d, b).collect()}
    assert over == {1: 1.0, 2: 0.0, 3: 3 / 5}
    fuzzy = {r["doc_id"]: (r["item_id"], r["jaccard"]) for r in contamination.fuzzy_matches(d, b).collect()}
    assert fuzzy == {1: (7, 1.0), 3: (7, 8 / 10)}
    assert [r["doc_id"] for r in contamination.fuzzy_lsh(d, b, permutations=64).filter("jaccard = 1").collect()] == [1]
    picked = contamination.pick_text(spark.createDataFrame([(None, "p"), ("", "x")], "question string, premise string"), "question", "text", "premise")
    assert [r["text"] for r in picked.collect()] == ["p"]


def test_mixtures(spark):
    primary, other = docs(spark, [(i, "x" * 10) for i in range(85)]), docs(spark, [(i, "y" * 10) for i in range(100, 150)])
    got = mixtures.build_mixture(primary, {"en": other}, mixtures.MIXTURES["pt_en_15"])
    assert got.filter("part = 'pt'").count() == 85 and got.filter("part = 'en'").count() == int(85 / 0.85 * 0.15)
    cut = mixtures.token_budget(primary, 100).collect()
    assert len(cut) == 40  # the row that reaches the budget is the last
    assert mixtures.weighted_merge({"a": (primary, 0.5), "b": (other, 3.0)}).count() == 42 + 50
    assert mixtures.sample_rows(primary, 7).count() == 7


def brute_pack(lists, length, eos):
    buffer, marks, out = [], [], []
    for tokens in lists:
        if buffer:
            buffer.append(eos), marks.append(True)
        buffer += tokens
        marks += [False] * len(tokens)
        while len(buffer) >= length:
            ids, m = buffer[:length], marks[:length]
            out.append((ids, [-100 if m[i] or (i and m[i - 1]) else x for i, x in enumerate(ids)]))
            buffer, marks = buffer[length:], marks[length:]
    return out


def test_packing_equals_a_buffer(spark):
    rng = random.Random(5)
    lists = [[rng.randrange(1, 99) for _ in range(rng.choice([0, 1, 3, 4, 8, 13]))] for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(lists)), "doc_id long, tokens array<long>").repartition(3)
    got = [(r["input_ids"], r["labels"]) for r in packing.pack(rows, 4, 0, batch=25).orderBy("batch", "seq").collect()]
    assert got == [s for lo in range(0, 60, 25) for s in brute_pack(lists[lo : lo + 25], 4, 0)]


def test_fertility(spark):
    got = packing.fertility(docs(spark, [(1, "ab cde"), (2, "x"), (3, "")])).first()
    assert got["tokens_per_word"] == 1 and got["n_texts"] == 2 and got["mean_token_length"] == 2 and got["median_token_length"] == 2


def test_files(spark, tmp_path):
    root = str(tmp_path)
    assert io.read_jsonl(spark, f"{root}/none", "a int").collect() == [] and io.read_split(spark, root) is None
    spark.range(3).write.parquet(f"{root}/train")
    assert io.read_split(spark, root).count() == 3
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r["a"] for r in io.read_jsonl(spark, f"{root}/x.jsonl", "a int").collect()] == [1, 2]
    rows = quality.manifest(docs(spark, [(1, "Uma frase."), (2, "")]))
    for kind in ("parquet", "json"):
        io.save_manifest(rows, f"{root}/m-{kind}", kind)
        assert io.load_manifest(spark, f"{root}/m-{kind}", rows.schema.simpleString()[7:-1].replace(":", " ")).count() == 1
    with pytest.raises(FileNotFoundError):
        io.load_manifest(spark, f"{root}/missing")
    with pytest.raises(FileNotFoundError):
        io.read_preferences(spark, f"{root}/missing")
    for step in (1, 2):
        io.append_log(spark.createDataFrame([(step, 0.5)], "step int, loss double"), f"{root}/log")
    assert io.read_log(spark, f"{root}/log", "step int, loss double, timestamp string").count() == 2
    made = []
    for _ in range(2):
        io.cached(spark, f"{root}/cache", lambda: made.append(1) or spark.range(2), model="m", shots=0).count()
    assert made == [1] and io.cache_key(a=1, b=2) == io.cache_key(b=2, a=1)
    assert io.prefix_sample(docs(spark, [(1, ""), (2, "a"), (3, "b")]), 2, "doc_id").count() == 1


def test_configs(tmp_path):
    (tmp_path / "model.json").write_text('{"size": 1}')
    (tmp_path / "run.json").write_text('{"model_config": "model.json", "a": {"b": 1}}')
    got = config.load_config(tmp_path / "run.json")
    assert got["model"] == {"size": 1} and config.flatten_config({"a": {"b": 1}, "c": 2}) == {"a.b": 1, "c": 2}
    assert config.merge_configs({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}} and config.missing_keys(got, ["a", "a.b", "z"]) == ["z"]


def test_a_stream_in_append_mode(spark, tmp_path):
    raw = spark.createDataFrame([(i, f"2024-01-01 {i % 24:02d}:10:00", "click") for i in range(48)], "user_id long, ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    raw.write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(raw.schema).parquet(f"{tmp_path}/in")
    events.run_available(events.tumbling_counts(live), f"{tmp_path}/out", f"{tmp_path}/state")
    closed = spark.read.parquet(f"{tmp_path}/out")
    assert closed.count() == 22 and {r["n"] for r in closed.collect()} == {2}  # the last hours wait for the watermark
