"""Every query that SQL can express gives the same rows as DuckDB does."""

import os

import duckdb
import pytest

from quire.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "pages", "conversations", "labels", "benchmark"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(catalogue.SQL[name])
    at = [list(want.columns).index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_imports_without_the_corpus_operators(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys\nclass B:\n  def find_spec(self, n, *a):\n    if n == 'corpus_pipeline' or n.startswith('quire.llm'): raise ModuleNotFoundError(n, name=n)\nsys.meta_path.insert(0, B())\nimport __spark_entry__ as e\nassert 'op1_neardup' not in e.queries() and len(e.queries()) > 40"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent).returncode == 0
