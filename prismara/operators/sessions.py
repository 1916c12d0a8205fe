"""Activity sessions: runs of events of one owner separated by pauses.

Start-end pairing. RANGE frames over the event time find the events with no predecessor, and those with no successor, within the
gap; starts and ends are numbered apart, the k-th start of an owner belongs to the k-th end, and the events between follow from the
difference of two running ranks.

Scale. Events are first collapsed to distinct (owner, second) with a count, with partial aggregation before the shuffle. The windows
run over (owner, slice of time), never over a whole owner: a slice holds at most ``slice_seconds`` distinct seconds however many rows
an owner has, and events within the gap of a slice border are copied into the neighbouring slice, so the frames see across borders.
Ranks become global by offsets per slice, summed over the slices of an owner (a row per owner and slice, not per event).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prismara.storage import materialise

SLICE_SECONDS = 7 * 86_400
_COUNTS = ("n", "is_start", "is_end")


def sessions(events: DataFrame, owner: str, time: str, gap: int, event_key: str | None = None, valid: Column | None = None, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Sessions of ``events``: (owner, started_at, ended_at, duration, n_events).

    A new session begins when more than ``gap`` seconds have passed since the owner's event before. Rows with a null owner or time,
    and rows for which ``valid`` is not true, take no part. With ``event_key``, rows that repeat a key count once (the smallest
    (owner, time) wins). Events of the same second belong together. An owner with one event gives a session of duration 0. Times may
    be negative. An empty input gives no rows; further columns are ignored, whatever their names.
    """
    if gap < 0 or slice_seconds <= gap:
        raise ValueError("gap must be at least 0 and smaller than slice_seconds")
    rows = events.where(valid) if valid is not None else events
    rows = rows.select(F.col(owner).alias("o"), F.col(time).cast("long").alias("t"), *([F.col(event_key).alias("k")] if event_key else []))
    rows = rows.where(F.col("o").isNotNull() & F.col("t").isNotNull())
    if event_key:
        rows = rows.groupBy("k", F.when(F.col("k").isNull(), F.monotonically_increasing_id()).alias("u")).agg(F.min(F.struct("o", "t")).alias("r")).select("r.o", "r.t")
    seconds = rows.groupBy("o", "t").agg(F.count("*").alias("n"))
    # each second in its own slice, and as a neighbour in the slice next door if it lies within the gap of the border
    size = F.lit(slice_seconds)
    home = F.floor(F.col("t") / size).cast("long")
    offset = F.col("t") - home * size
    near = F.array_compact(F.array(home, F.when(offset < gap + 1, home - 1), F.when(offset >= slice_seconds - gap - 1, home + 1)))
    sliced = seconds.select("o", "t", "n", home.alias("h"), F.explode(near).alias("s"))
    by_time = W.partitionBy("o", "s").orderBy("t")
    marked = sliced.select(
        "o", "t", "n", "s", "h",
        F.count("*").over(by_time.rangeBetween(-gap, -1) if gap else by_time.rowsBetween(1, 0)).alias("before"),
        F.count("*").over(by_time.rangeBetween(1, gap) if gap else by_time.rowsBetween(1, 0)).alias("after"),
    ).where(F.col("h") == F.col("s"))
    flagged = marked.select("o", "t", "n", "s", (F.col("before") == 0).cast("long").alias("is_start"), (F.col("after") == 0).cast("long").alias("is_end"))
    upto = by_time.rowsBetween(W.unboundedPreceding, 0)
    running = [F.sum(c).over(upto).alias(f"r_{c}") for c in _COUNTS]
    last = F.lead("t").over(by_time).isNull().alias("is_last")
    # starts, ends and the last second of each slice, whose running sums are the slice's totals: few rows, from one pass of windows
    ranked = flagged.select("o", "t", "n", "s", "is_start", "is_end", *running, last).where("is_start = 1 or is_end = 1 or is_last")
    ranked = materialise(ranked, "sessions")
    earlier = W.partitionBy("o").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranked.where("is_last").select("o", "s", *[F.coalesce(F.sum(f"r_{c}").over(earlier), F.lit(0)).alias(f"b_{c}") for c in _COUNTS])
    placed = ranked.where("is_start = 1 or is_end = 1").join(offsets, ["o", "s"])
    starts = placed.where("is_start = 1").select("o", (F.col("r_is_start") + F.col("b_is_start")).alias("rank"), F.col("t").alias("started_at"), (F.col("r_n") + F.col("b_n") - F.col("n")).alias("before_start"))
    ends = placed.where("is_end = 1").select("o", (F.col("r_is_end") + F.col("b_is_end")).alias("rank"), F.col("t").alias("ended_at"), (F.col("r_n") + F.col("b_n")).alias("upto_end"))
    return starts.join(ends, ["o", "rank"]).select(
        F.col("o").alias(owner), "started_at", "ended_at", (F.col("ended_at") - F.col("started_at")).alias("duration"), (F.col("upto_end") - F.col("before_start")).alias("n_events")
    )
