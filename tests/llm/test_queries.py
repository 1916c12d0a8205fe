"""Every llm query against its SQL on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import prismara.llm.queries as llm  # noqa: E402
from compare import TABLES, rows  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for t in TABLES:
        if Path(sf, f"{t}.parquet").exists():
            c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(llm.ORACLE))
def test_same_as_sql(spark, sf, con, name):
    df = llm.QUERIES[name](spark, sf)
    cur = con.execute(llm.ORACLE[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(llm.QUERIES) - set(llm.ORACLE)))
def test_gives_rows(spark, sf, name):
    assert llm.QUERIES[name](spark, sf).count() > 0
