import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
LLM = entry.llm_queries.QUERIES if entry.llm_queries else {}
OWN = [n for n in entry.queries() if n not in LLM and n != "pipeline"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.sql(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{name}')")
    return c


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return repr(value)


@pytest.mark.parametrize("name", OWN)
def test_query_equals_its_sql(spark, con, name):
    out = entry.queries()[name](spark, DATA)
    columns = sorted(out.columns)
    got = sorted(tuple(map(plain, r)) for r in out.select(*columns).collect())
    if name not in entry.oracle_sql():
        assert got or name == "contam_fuzzy_lsh"  # estimates over a threshold may be none
        return
    found = con.sql(entry.oracle_sql()[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_everything_else_works_without_the_llm_folders(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'quality_manifest' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env={**os.environ, "PYTHONPATH": str(tmp_path / "repo")}, check=True)
