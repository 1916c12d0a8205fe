"""References to keys that do not exist, kept as signed counts per key.

State. For each (relation, key): ``refs``, the rows that refer to the key, and ``present``, the rows that hold it. Every change is a
signed delta; the state is the sum of all deltas, so inserts, deletions and late arrivals in any order lead to the same state. A key is
an orphan while refs > 0 and present = 0.

Scale. Deltas are summed before the shuffle, so a key that a third of all rows refer to costs one row per task. To name the rows that
refer to an orphan, rows meet the orphan keys in a join in which a key with many references is split: its reference count, known from
the state, gives the number of salts, and the keys that need more than one salt are at most ``1/HOT_SHARE``, a proven bound for the
broadcast that tells the rows of their salts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismara.storage import table_path
from prismara.tables import one_per_key

HOT_SHARE = 1 / 500
HOT_LEAST = 1_000
SALTS = 64


@dataclass(frozen=True)
class Relation:
    """Rows of ``name`` refer by ``ref`` to ``target_key`` of ``target``; ``row_key`` names the row, ``at`` (epoch seconds) its period."""

    name: str
    row_key: str
    ref: str
    at: str
    target: str
    target_key: str


def reference_rows(relation: Relation, rows: DataFrame) -> DataFrame:
    """(table_name, row_id, key, period) of rows with a non-null reference; a repeated row key counts once, a null one not at all."""
    named = rows.select(F.col(relation.row_key).alias("row_id"), F.col(relation.ref).alias("key"), F.col(relation.at).alias("at"))
    once = one_per_key(named.where(F.col("key").isNotNull()), "row_id", "key", "at")
    return once.select(F.lit(relation.name).alias("table_name"), "row_id", "key", F.date_format(F.timestamp_seconds(F.col("at")), "yyyy-MM").alias("period"))


def deltas(relation: Relation, references: DataFrame | None = None, targets: DataFrame | None = None, sign: int = 1) -> DataFrame:
    """Change deltas (table_name, key, refs, present). ``references`` are rows of reference_rows(), ``targets`` rows of the target
    table; ``sign`` -1 takes them back (deletions)."""
    parts = []
    if references is not None:
        parts.append(references.select(F.lit(relation.name).alias("table_name"), F.col("key"), F.lit(sign).cast("long").alias("refs"), F.lit(0).cast("long").alias("present")))
    if targets is not None:
        held = targets.where(F.col(relation.target_key).isNotNull())
        parts.append(held.select(F.lit(relation.name).alias("table_name"), F.col(relation.target_key).alias("key"), F.lit(0).cast("long").alias("refs"), F.lit(sign).cast("long").alias("present")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def advance(state: DataFrame | None, changes: DataFrame) -> DataFrame:
    """The state after ``changes``; keys whose counts have all returned to zero leave it."""
    both = changes if state is None else state.unionByName(changes)
    return both.groupBy("table_name", "key").agg(F.sum("refs").alias("refs"), F.sum("present").alias("present")).where("refs <> 0 or present <> 0")


class Ledger:
    """The state kept in a folder: every batch of deltas makes a new version of it, and a reopened ledger goes on from the last complete one.
    A batch costs its own size and that of the counts, never the rows behind them; a version that broke off is written anew."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path, self.version = spark, path or table_path(spark, "ledger"), 0
        while self._whole(self.version + 1):
            self.version += 1

    def _whole(self, version: int) -> bool:
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/state-{version}/_SUCCESS")
        return done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done)

    @property
    def state(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/state-{self.version}") if self.version else None

    def apply(self, changes: DataFrame) -> DataFrame:
        """The state after ``changes``."""
        advance(self.state, changes).write.mode("overwrite").parquet(f"{self.path}/state-{self.version + 1}")
        self.version += 1
        return self.state


def orphan_keys(state: DataFrame) -> DataFrame:
    return state.where((F.col("refs") > 0) & (F.col("present") <= 0)).select("table_name", "key", "refs")


def orphan_rows(references: DataFrame, state: DataFrame, salts: int = SALTS) -> DataFrame:
    """(table_name, row_id, missing_id, period) of every row whose key is an orphan in ``state``."""
    orphans = orphan_keys(state)
    total = orphans.agg(F.sum("refs")).first()[0] or 0
    hot = orphans.where(F.col("refs") > max(HOT_LEAST, total * HOT_SHARE)).select("table_name", "key", F.lit(True).alias("hot"))
    mark = lambda df: df.join(F.broadcast(hot), ["table_name", "key"], "left")  # noqa: E731  at most 1/HOT_SHARE rows
    salt: Column = F.when(F.col("hot"), F.pmod(F.xxhash64("row_id"), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    every = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = mark(references).select("table_name", "key", "row_id", "period", salt.alias("salt"))
    right = mark(orphans).select("table_name", "key", F.explode(every).alias("salt"))
    return left.join(right, ["table_name", "key", "salt"], "left_semi").select("table_name", "row_id", F.col("key").alias("missing_id"), "period")


def report(found: DataFrame) -> DataFrame:
    """Orphans per table and period: (table_name, period, n_rows, n_keys)."""
    return found.groupBy("table_name", "period").agg(F.count("*").alias("n_rows"), F.countDistinct("missing_id").alias("n_keys"))
