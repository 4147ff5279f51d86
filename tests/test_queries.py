"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from evispark.plans import evidence_queries, more_queries, paging_queries, run_queries, search_queries, stream_queries, timer_queries, version_queries, window_queries
from evispark.plans.frames import TABLES

DATA = "/root/testdata/sf0.001"
QUERIES = {k: q for m in (evidence_queries, run_queries, more_queries, paging_queries, search_queries, stream_queries, timer_queries, version_queries, window_queries) for k, q in m.QUERIES.items()}


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    run, sql = QUERIES[name]
    df = run(spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    if sql:
        r = con.execute(sql)
        names = [d[0] for d in r.description]
        assert sorted(names) == cols
        want = sorted((tuple(norm(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)
        assert got == want


def test_entry_without_the_corpus_package():
    import subprocess
    import sys

    code = "import sys; sys.modules['evispark.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') and k[2].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
