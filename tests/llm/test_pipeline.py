from collections import Counter

import corpus_pipeline
from corpusmill.llm.quality_gam import score_quality
from corpusmill.llm.secrets import MarkovPair, added_spans, base_spans, labelled_samples, redact
from tests.llm.test_decontaminate import brute as contained
from tests.llm.test_mixing import copies
from tests.llm.test_ngram_jaccard import brute as components

DATA = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(120).cache()
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "mixing sources"]
    steps = []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs if not steps else spark.createDataFrame(steps[-1][1], steps[-1][0]), DATA)
        steps.append((out.schema, out.collect()))
    assert all(s[0].names == docs.columns for s in steps[:-1])
    good = {r["doc_id"] for r in score_quality(docs, labels).filter("score >= 0.5").collect()}
    assert {r["doc_id"] for r in steps[0][1]} == good and len(good) > 80
    rows = [(r["doc_id"], r["text"]) for r in steps[0][1]]
    kept = {k for k, _, c in components(rows, 5, 80, 100) if k == c}
    assert {r["doc_id"] for r in steps[1][1]} == kept
    rows = [(r["doc_id"], r["text"]) for r in steps[1][1]]
    dirty = {k for _, k, *_ in contained(rows, items)}
    assert {r["doc_id"] for r in steps[2][1]} == kept - dirty
    model = MarkovPair(labelled_samples())
    before, after = ({r["doc_id"]: r["text"] for r in s[1]} for s in steps[2:4])
    for key, text in before.items():
        base = base_spans(text)
        assert after[key] == redact(text, base + added_spans(text, base, model))
    n = Counter(r["source"] for r in steps[3][1])
    expected = Counter({r["doc_id"]: c for r in steps[3][1] if (c := copies(r["doc_id"], len(after) / len(n) / n[r["source"]]))})
    assert Counter(r["doc_id"] for r in steps[4][1]) == expected


def test_run_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
