"""Every query with SQL gives the SQL's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from talkframe.plans import registry
from talkframe.plans.base import with_ctes

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    got = df.collect()
    ref = duck.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in ref.description]
    want = ref.fetchall()
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    assert sorted([plain(r[c]) for c in order] for r in got) == sorted([plain(r[columns.index(c)]) for c in order] for r in want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_shared_expressions_come_in_order():
    sql = with_ctes("SELECT * FROM ch_s")
    assert [sql.index(x) for x in ("cv AS", "zh(", "chats AS", "ch_s AS")] == sorted(sql.index(x) for x in ("cv AS", "zh(", "chats AS", "ch_s AS"))


def test_nothing_outside_imports_the_optional_subpackage():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for f in glob.glob(f"{root}/talkframe/**/*.py", recursive=True):
        if "/llm/" not in f:
            assert "talkframe.llm" not in open(f).read()
