"""Every core query against its SQL on the smallest tables, and the entry point."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402
import prismara.library_queries as library  # noqa: E402
import prismara.media_queries as media  # noqa: E402
import prismara.problem_queries as problems  # noqa: E402
from prismara.operators import clusters  # noqa: E402
from compare import TABLES, rows  # noqa: E402

QUERIES = media.QUERIES | problems.QUERIES | library.QUERIES
ORACLE = media.ORACLE | problems.ORACLE | library.ORACLE


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for t in TABLES:
        if Path(sf, f"{t}.parquet").exists():
            c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cur = con.execute(ORACLE[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, sf, name, monkeypatch):
    monkeypatch.setattr(clusters, "STARTS", 2)
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
