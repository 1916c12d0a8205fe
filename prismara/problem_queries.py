"""Queries of the general problems: sessions (p2) and orphan references (p5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismara.operators import orphans as O
from prismara.operators.sessions import sessions
from prismara.storage import materialise, table_path
from prismara.tables import load

GAP = 1_800

RELATIONS = (
    O.Relation("assets", "asset_id", "folder_id", "imported_at", "folders", "folder_id"),
    O.Relation("regions", "region_id", "asset_id", "created_at", "assets", "asset_id"),
    O.Relation("vec_regions", "region_id", "region_id", "written_at", "regions", "region_id"),
)


def p2_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(load(spark, sf_dir, "assets"), "folder_id", "taken_at", GAP, "asset_id", F.col("taken_at") > 0)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_sessions(spark, sf_dir).select("folder_id", "started_at", "ended_at")


def _references(spark: SparkSession, sf_dir: str, r: O.Relation) -> DataFrame:
    return O.reference_rows(r, load(spark, sf_dir, r.name).select(r.row_key, r.at, *([r.ref] if r.ref != r.row_key else [])))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    references = {r: _references(spark, sf_dir, r) for r in RELATIONS}
    changes = _all([O.deltas(r, refs, load(spark, sf_dir, r.target).select(r.target_key)) for r, refs in references.items()])
    return O.orphan_rows(_all(list(references.values())), materialise(O.advance(None, changes), "orphans"))


def p5_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p5_found, by a ledger that is opened anew for each batch of changes: the references and the targets with even keys; the other
    targets, while every fourth is deleted; and these again."""
    references = {r: _references(spark, sf_dir, r) for r in RELATIONS}
    path = table_path(spark, "ledger")

    def targets(r: O.Relation, where: str, sign: int = 1) -> DataFrame:
        rows = load(spark, sf_dir, r.target).select(r.target_key)
        return O.deltas(r, None, rows.where(where.format(r.target_key)), sign)

    batches = (
        [O.deltas(r, refs) for r, refs in references.items()] + [targets(r, "{} % 2 = 0") for r in RELATIONS],
        [targets(r, "{} % 2 <> 0") for r in RELATIONS] + [targets(r, "{} % 4 = 0", -1) for r in RELATIONS],
        [targets(r, "{} % 4 = 0") for r in RELATIONS],
    )
    for changes in batches:
        state = O.Ledger(spark, path).apply(_all(changes))
    return O.orphan_rows(_all(list(references.values())), state)


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.report(p5_found(spark, sf_dir))


QUERIES = {"p2_found": p2_found, "p2_sessions": p2_sessions, "p5_found": p5_found, "p5_carried": p5_carried, "p5_report": p5_report}

_SESSIONS = """
with e as (select asset_id, folder_id, taken_at from (select asset_id, folder_id, taken_at, row_number() over (partition by asset_id order by folder_id, taken_at) rn
              from assets where folder_id is not null and taken_at > 0) where rn = 1),
     g as (select *, case when taken_at - lag(taken_at) over (partition by folder_id order by taken_at, asset_id) <= 1800 then 0 else 1 end as fresh from e),
     s as (select *, sum(fresh) over (partition by folder_id order by taken_at, asset_id rows unbounded preceding) as sess from g)
"""
_ORPHANS = """
with refs as (
  select 'assets' table_name, asset_id row_id, folder_id missing_id, imported_at as at_s from assets where folder_id is not null
  union all select 'regions', region_id, asset_id, created_at from regions where asset_id is not null
  union all select 'vec_regions', region_id, region_id, written_at from vec_regions where region_id is not null),
 once as (select table_name, row_id, missing_id, at_s from (select *, row_number() over (partition by table_name, row_id order by missing_id, at_s) rn from refs where row_id is not null) where rn = 1),
 found as (select table_name, row_id, missing_id, strftime(to_timestamp(at_s) at time zone 'UTC', '%Y-%m') period from once
   where (table_name = 'assets' and missing_id not in (select folder_id from folders where folder_id is not null))
      or (table_name = 'regions' and missing_id not in (select asset_id from assets where asset_id is not null))
      or (table_name = 'vec_regions' and missing_id not in (select region_id from regions where region_id is not null)))
"""
ORACLE = {
    "p2_found": _SESSIONS + "select folder_id, min(taken_at) started_at, max(taken_at) ended_at from s group by folder_id, sess",
    "p2_sessions": _SESSIONS + "select folder_id, min(taken_at) started_at, max(taken_at) ended_at, max(taken_at) - min(taken_at) duration, count(*) n_events from s group by folder_id, sess",
    "p5_found": _ORPHANS + "select * from found",
    "p5_carried": _ORPHANS + "select * from found",
    "p5_report": _ORPHANS + "select table_name, period, count(*) n_rows, count(distinct missing_id) n_keys from found group by table_name, period",
}
