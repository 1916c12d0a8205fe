"""Access to the media tables: plain reads and the rule that a repeated key counts once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_per_key(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row for each non-null key. Rows that differ in ``columns`` are settled by the smallest struct of them, so the result
    does not depend on row order; partial aggregation runs before the shuffle, so a key repeated any number of times is cheap."""
    picked = df.where(F.col(key).isNotNull()).groupBy(F.col(key)).agg(F.min(F.struct(*[F.col(c) for c in columns])).alias("_row"))
    return picked.select(key, *[F.col("_row")[c].alias(c) for c in columns])
