"""Sessions and orphan references: brute force, hot groups, nulls, ties, empty tables, clashing columns."""

import random
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prismara.operators import orphans as O
from prismara.operators.sessions import sessions

EVENTS = "k long, folder_id long, taken_at long, o string, t string, n int"


def brute(rows, gap):
    once = {}
    for k, f, t in rows:
        if f is not None and t is not None:
            once[k] = min(once.get(k, (f, t)), (f, t)) if k is not None else (f, t)
    by = defaultdict(list)
    for f, t in once.values():
        by[f].append(t)
    out = []
    for f, ts in by.items():
        ts.sort()
        first = last = ts[0]
        n = 0
        for t in ts:
            if t - last > gap:
                out.append((f, first, last, last - first, n))
                first, n = t, 0
            last, n = t, n + 1
        out.append((f, first, last, last - first, n))
    return sorted(out)


def run(spark, rows, gap, size):
    df = spark.createDataFrame([(k, f, t, "x", "y", 1) for k, f, t in rows], EVENTS)
    return sorted(tuple(r) for r in sessions(df, "folder_id", "taken_at", gap, "k", slice_seconds=size).collect())


@pytest.mark.parametrize("gap,size", [(10, 11), (10, 25), (30, 1_000), (0, 7)])
def test_sessions_equal_brute_force_across_slices(spark, gap, size):
    rng = random.Random(gap * 1_000 + size)
    rows = [(i, rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(-200, 400)])) for i in range(400)]
    rows += rng.sample(rows, 80)
    assert run(spark, rows, gap, size) == brute(rows, gap)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-60, 60)), max_size=25), st.integers(1, 9))
def test_sessions_property(spark, events, gap):
    rows = [(i, f, t) for i, (f, t) in enumerate(events)]
    assert run(spark, rows, gap, 20) == brute(rows, gap)


def test_sessions_without_rows_and_bad_arguments(spark):
    assert run(spark, [], 10, 100) == []
    assert run(spark, [(1, None, 5), (2, 3, None)], 10, 100) == []
    with pytest.raises(ValueError):
        run(spark, [(1, 1, 1)], 10, 10)


def test_sessions_of_a_hot_owner(spark):
    rows = spark.range(60_000).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("folder_id"), (F.col("id") % 3_000 * 40).alias("taken_at"))
    got = sessions(rows, "folder_id", "taken_at", 39, "k", slice_seconds=5_000)
    assert got.count() == 3_000
    one = sessions(rows, "folder_id", "taken_at", 40, "k", slice_seconds=5_000).collect()
    assert [tuple(r) for r in one] == [(1, 0, 2_999 * 40, 2_999 * 40, 60_000)]


REL = O.Relation("child", "row_id", "ref", "at", "parent", "key")
CHILD = "row_id long, ref long, at long, table_name string, key string, period int"


def child(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], CHILD)


def parent(spark, keys):
    return spark.createDataFrame([(k, 1) for k in keys], "key long, refs int")


def found(spark, rows, keys):
    refs = O.reference_rows(REL, child(spark, rows))
    state = O.advance(None, O.deltas(REL, refs, parent(spark, keys)))
    return sorted((r.row_id, r.missing_id, r.period) for r in O.orphan_rows(refs, state).collect())


def test_orphans(spark):
    rows = [(1, 10, 0), (2, 11, 86_400 * 40), (2, 11, 86_400 * 40), (3, None, 5), (4, 12, None), (None, 99, 0), (5, 10, 0)]
    assert found(spark, rows, [10, 10, None]) == [(2, 11, "1970-02"), (4, 12, None)]
    assert found(spark, [], [1]) == [] and found(spark, [(1, 5, 0)], []) == [(1, 5, "1970-01")]


def test_hot_orphan_is_split_and_whole(spark):
    rows = spark.range(20_000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") + 100).cast("long").alias("ref"), F.lit(0).cast("long").alias("at"))
    refs = O.reference_rows(REL, rows)
    state = O.advance(None, O.deltas(REL, refs, parent(spark, [101, 102])))
    got = O.orphan_rows(refs, state)
    assert got.where("missing_id = 7").count() == 6_667 and got.count() == 20_000 - 2


def test_state_is_the_sum_of_changes_in_any_order(spark):
    refs = O.reference_rows(REL, child(spark, [(1, 10, 0), (2, 11, 0), (3, 11, 0)]))
    steps = [O.deltas(REL, refs), O.deltas(REL, None, parent(spark, [10, 11])), O.deltas(REL, None, parent(spark, [11]), -1), O.deltas(REL, refs.where("row_id = 2"), None, -1)]
    states = []
    for order in ([0, 1, 2, 3], [3, 2, 1, 0], [1, 3, 0, 2]):
        state = None
        for s in order:
            state = O.advance(state, steps[s])
        states.append(sorted(tuple(r) for r in state.collect()))
    assert states[0] == states[1] == states[2] == [("child", 10, 1, 1), ("child", 11, 1, 0)]
    assert [r.key for r in O.orphan_keys(O.advance(None, steps[0].unionByName(steps[1]).unionByName(steps[2]))).collect()] == [11]
