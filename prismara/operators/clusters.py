"""K-means over vectors with several starts, in two levels."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prismara.storage import materialise

STARTS = 10


def fitted(rows: DataFrame, column: str, k: int, starts: int | None = None, seed: int = 0, rounds: int = 20) -> KMeansModel:
    """The model with the least cost of several starts, STARTS unless said otherwise."""
    features = materialise(rows.select(array_to_vector(column).alias("features")), "features")  # read by every round of every start
    best = None
    for s in range(starts or STARTS):
        model = KMeans(k=k, seed=seed + s, maxIter=rounds).fit(features)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    return best


def assigned(model: KMeansModel, rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, cluster, distance) of each row to the centre of its cluster."""
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    placed = model.transform(rows.select(key, column, array_to_vector(column).alias("features")))
    far = F.aggregate(F.zip_with(F.col(column), centres[F.col("prediction")], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return placed.select(key, F.col("prediction").alias("cluster"), F.sqrt(far).alias("distance"))


def two_levels(rows: DataFrame, key: str, column: str, fine: int, coarse: int, starts: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(key, cluster, distance) and (cluster, parent): k-means of the rows, and k-means of its centres."""
    model = fitted(rows, column, fine, starts, seed)
    centres = rows.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], f"cluster int, {column} array<double>")
    above = fitted(centres, column, min(coarse, centres.count()), starts, seed)  # as many rows as there are fine clusters
    parents = above.transform(centres.select("cluster", array_to_vector(column).alias("features"))).select("cluster", F.col("prediction").alias("parent"))
    return assigned(model, rows, key, column), parents


def members_by_distance(placed: DataFrame, m: int, key: str) -> DataFrame:
    """(cluster, rank, key, distance): the ``m`` members nearest to each centre, ties by key."""
    rank = F.row_number().over(W.partitionBy("cluster").orderBy("distance", key))
    return placed.withColumn("rank", rank).where(F.col("rank") <= m).select("cluster", "rank", key, "distance")


def signature(rows: DataFrame, key: str, column: str, k: int) -> DataFrame:
    """(key, signature): coordinates along the first ``k`` principal axes; rows are not centred, as axes alone are applied."""
    from pyspark.ml.feature import PCA

    features = rows.select(key, array_to_vector(column).alias("features"))
    model = PCA(k=k, inputCol="features", outputCol="axes").fit(features)
    return model.transform(features).select(key, vector_to_array("axes").alias("signature"))
