"""Quality measures of clusterings and rankings, from contingency counts; nothing but the counts is ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def contingency(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(t, p, n) of rows in which both labels are known."""
    return rows.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))


def purity(table: DataFrame) -> DataFrame:
    """(purity): share of rows that belong to the majority label of their cluster; null without rows."""
    return table.groupBy("p").agg(F.max("n").alias("top"), F.sum("n").alias("n")).agg((F.sum("top") / F.sum("n")).alias("purity"))


def nmi(table: DataFrame) -> DataFrame:
    """(nmi): mutual information over the arithmetic mean of the entropies; 0 where both divisions are trivial; null without rows.

    Everything follows from the number of rows and the sums of n ln n over cells, labels and clusters, so no count meets another."""
    mass = lambda df, name: df.agg(F.lit(name).alias("name"), F.sum(F.col("n") * F.log("n")).alias("mass"), F.sum("n").alias("total"))
    by = lambda c: table.groupBy(c).agg(F.sum("n").alias("n"))
    rows = mass(table, "cells").unionByName(mass(by("t"), "t")).unionByName(mass(by("p"), "p"))
    of = lambda name: F.max(F.when(F.col("name") == name, F.col("mass") / F.col("total"))).alias(name)
    one = rows.agg(of("cells"), of("t"), of("p"), F.log(F.max("total")).alias("whole"))
    mutual, mean = F.col("cells") - F.col("t") - F.col("p") + F.col("whole"), F.col("whole") - (F.col("t") + F.col("p")) / 2
    value = F.when(mean > 1e-12, F.greatest(mutual, F.lit(0.0)) / mean).otherwise(F.lit(0.0))
    return one.select(F.when(F.col("whole").isNotNull(), value).alias("nmi"))


def sizes(rows: DataFrame, cluster: str) -> DataFrame:
    return rows.where(F.col(cluster).isNotNull()).groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"))


def size_profile(counted: DataFrame) -> DataFrame:
    """(clusters, singleton_rate, top_share) of cluster sizes."""
    return counted.agg(F.count("*").alias("clusters"), (F.count_if(F.col("n") == 1) / F.count("*")).alias("singleton_rate"), (F.max("n") / F.sum("n")).alias("top_share"))


def hit_rate(ranked: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(hit_rate): mean over queries of the share of their first ``k`` results that carry the query's label. ``ranked``: (query_id, rank,
    id) without the query itself; ``labels``: (id, label)."""
    own, other = labels.select(F.col("id").alias("query_id"), F.col("label").alias("ql")), labels.select("id", "label")
    hits = ranked.where(F.col("rank") <= k).join(own, "query_id").join(other, "id").groupBy("query_id").agg(F.avg((F.col("ql") == F.col("label")).cast("double")).alias("h"))
    return hits.agg(F.avg("h").alias("hit_rate"))


def nearest_rank(rows: DataFrame, value: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """(share, value): percentiles by nearest rank, the smallest value at or above each share of all; Spark counts equal
    values before it gathers them."""
    cuts = [F.expr(f"percentile_disc({s}) within group (order by value)") for s in shares]
    one = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("value")).agg(*[c.cast(rows.schema[value].dataType).alias(f"p{i}") for i, c in enumerate(cuts)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(s).alias("share"), F.col(f"p{i}").alias("value")) for i, s in enumerate(shares)])).alias("r")).select("r.share", "r.value")


def fit_through_origin(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(slope, rmse) of y = slope x."""
    s = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.sum(F.col(x) * F.col(y)).alias("xy"), F.sum(F.col(x) * F.col(x)).alias("xx"), F.sum(F.col(y) * F.col(y)).alias("yy"), F.count("*").alias("n"))
    slope = F.col("xy") / F.when(F.col("xx") != 0, F.col("xx"))
    return s.select(slope.alias("slope"), F.sqrt(F.greatest(F.col("yy") - slope * F.col("xy"), F.lit(0.0)) / F.col("n")).alias("rmse"))


def top_per_group(rows: DataFrame, group: str, m: int, *order) -> DataFrame:
    """The first ``m`` rows of each group with their ``rank``; each task cuts its part of a group before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("rank") <= m)


def routed(queries: DataFrame, representatives: DataFrame) -> DataFrame:
    """(query_id, cluster): each query (id, v) goes to the cluster of its most similar representative (cluster, v), the smallest cluster of
    equals. Representatives are at most 1,024 for each cluster; knn.nearest_anchor goes through them in blocks."""
    from prismara.plans.knn import nearest_anchor

    place = F.row_number().over(W.partitionBy("cluster").orderBy("v")) - 1
    anchors = representatives.select((F.col("cluster") * 1_024 + place).alias("anchor"), "v")  # in order of cluster
    return nearest_anchor(queries, "id", anchors).select(F.col("id").alias("query_id"), F.floor(F.col("anchor") / 1_024).cast("long").alias("cluster"))
