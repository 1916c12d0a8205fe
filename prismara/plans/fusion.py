"""Reciprocal rank fusion of ranked streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RRF_K = 60.0


def stream(rows: DataFrame, number: int, semantic: bool, *order, key: str = "asset_id") -> DataFrame:
    """(stream, semantic, rank, id): positions of a ranked list from 1. Lists are top-k results, so one task numbers few rows. Numbers are
    given before repeats are dropped: a repeated id keeps its first position and its other ones stay used."""
    ranked = rows.select(F.col(key).alias("id"), F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)).alias("rank"))
    return ranked.groupBy("id").agg(F.min("rank").alias("rank")).select(F.lit(number).alias("stream"), F.lit(semantic).alias("semantic"), "rank", "id")


def listed(spark, ids: list[int], number: int, semantic: bool) -> DataFrame:
    """A stream of ids in a given order."""
    rows = spark.createDataFrame([(i, p) for p, i in enumerate(ids, 1)], "id long, rank int")
    return rows.groupBy("id").agg(F.min("rank").alias("rank")).select(F.lit(number).alias("stream"), F.lit(semantic).alias("semantic"), "rank", "id")


def fused(k: float = RRF_K) -> list[Column]:
    """Aggregates of an id's places (semantic, rank) in all streams: score, the sum of 1 / (k + rank), with k = 60 where it is not positive,
    and matched, which is both, semantic or text."""
    k = k if k > 0 else RRF_K
    semantic, text = F.bool_or("semantic"), F.bool_or(~F.col("semantic"))
    return [F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score"), F.when(semantic & text, "both").when(semantic, "semantic").otherwise("text").alias("matched")]


def rrf(streams: list[DataFrame], k: float = RRF_K) -> DataFrame:
    """(id, score, matched) of streams."""
    return reduce(DataFrame.unionByName, streams).groupBy("id").agg(*fused(k))
