"""Exact nearest neighbours of one query vector: a distance and a top-k per task.

Two plans with the same result: ``hof`` evaluates the distance with higher-order functions in the JVM; ``arrow`` hands Arrow batches to
numpy, keeps the k best of every batch there and is the fast one. Either way at most k rows per task reach the final merge, and no
vector is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prismara.functions import scalars as S

KNN_MOST, REGIONS_MOST = 1_000, 4_096
#: Anchors sent to every task at once.
ANCHORS = 10_000


def _units(batch: pa.RecordBatch, dim: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, unit vectors of the first ``width`` components) of the usable lists in column 1, which have ``dim`` entries each."""
    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, dim)
    good = np.isfinite(flat).all(1) & (flat != 0).any(1)
    flat = flat[:, :width]
    length = np.sqrt((flat * flat).sum(1))
    rows = np.flatnonzero(good & (length > 0) & np.isfinite(length))
    return rows, flat[rows] / length[rows, None]


def _sized(table: DataFrame, key: str, dim: int, column: str) -> DataFrame:
    return table.where(F.col(key).isNotNull() & (F.size(column) == dim)).select(F.col(key).cast("long").alias(key), column)


def unit_vectors(table: DataFrame, key: str, dim: int, column: str = "embedding", first: int | None = None, once: bool = False) -> DataFrame:
    """(key, v): usable vectors as unit vectors in double; with ``first``, unit vectors of the first components, where these are not
    all zero. With ``once``, one per key (the smallest); without, repeated rows stay and no vector is shuffled."""
    width = first or dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, unit = _units(batch, dim, width)
            v = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), v], [key, "v"])

    out = _sized(table, key, dim, column).mapInArrow(run, f"{key} long, v array<double>")
    return out.groupBy(key).agg(F.min("v").alias("v")) if once else out


def usable(column: str, dim: int, first: int | None = None) -> Column:
    """Whether a list column has ``dim`` finite components, not all zero (nor the first ``first`` of them), by built-in functions alone.
    array_contains is null where a list holds a null, so one comparison tells both."""
    v, width = F.col(column), first or dim
    finite = F.coalesce(~F.array_contains(v, F.lit(float("inf")).cast("float")) & ~F.array_contains(v, F.lit(float("-inf")).cast("float")), F.lit(False))
    head = v if width == dim else F.slice(v, 1, width)
    return F.coalesce((F.size(v) == dim) & finite & ~F.isnan(F.array_max(v)) & ((F.array_max(head) != 0) | (F.array_min(head) != 0)), F.lit(False))


def vector_keys(table: DataFrame, key: str, dim: int, column: str = "embedding", first: int | None = None) -> DataFrame:
    """Distinct keys of usable vectors, for joins and counts, which need no vectors."""
    return table.where(F.col(key).isNotNull() & usable(column, dim, first)).select(F.col(key).cast("long").alias(key)).distinct()


def first_vector(table: DataFrame, key: str, dim: int, column: str = "embedding", first: int | None = None) -> list[float]:
    """The unit vector of the smallest key with a usable vector; empty if there is none. A top-1 per task; only it reaches the driver."""
    row = table.where(F.col(key).isNotNull() & usable(column, dim, first)).select(key, column).orderBy(key, column).limit(1).collect()
    if not row:
        return []
    v = np.array(row[0][column][: first or dim], np.float64)
    return (v / np.sqrt((v * v).sum())).tolist()


@dataclass
class Asked:
    """A search: the ``k`` nearest to ``query`` by the first len(query) components."""

    stream: int
    query: list[float]
    k: int


def nearest(table: DataFrame, key: str, dim: int, asked: list[Asked], column: str = "embedding") -> DataFrame:
    """(stream, key, dist): for each search its k nearest, ties by key, a repeated key at its smallest distance. All searches share one pass
    over the raw table: vectors are checked, normalised and compared in the same batch, of which only the k best of a search leave."""
    wanted = [(a.stream, np.asarray(a.query, np.float64), a.k) for a in asked if len(a.query)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, dim)
            good = np.isfinite(flat).all(1) & (flat != 0).any(1)
            ids = batch.column(0).to_numpy()
            for stream, q, k in wanted:
                x = flat[:, : len(q)]
                length = np.sqrt((x * x).sum(1))
                rows = np.flatnonzero(good & (length > 0) & np.isfinite(length))
                dist = np.sqrt(((x[rows] / length[rows, None] - q) ** 2).sum(1))
                order = np.lexsort((ids[rows], dist))
                best = order[np.sort(np.unique(ids[rows[order]], return_index=True)[1])[:k]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), stream, np.int32)), pa.array(ids[rows[best]]), pa.array(dist[best])], ["stream", key, "dist"])

    near = _sized(table, key, dim, column).mapInArrow(run, f"stream int, {key} long, dist double").groupBy("stream", key).agg(F.min("dist").alias("dist"))
    most = F.create_map(*[F.lit(x) for s, _, k in wanted for x in (s, k)]) if wanted else F.create_map(F.lit(0), F.lit(0))
    rank = F.row_number().over(W.partitionBy("stream").orderBy("dist", key))  # k rows of each batch
    return near.withColumn("_r", rank).where(F.col("_r") <= most[F.col("stream")]).drop("_r")


def distances(vectors: DataFrame, key: str, query: list[float]) -> DataFrame:
    return vectors.select(key, S.l2_distance(F.col("v"), F.array(*[F.lit(float(x)) for x in query])).alias("dist"))


def knn(vectors: DataFrame, key: str, query: list[float], k: int, most: int = KNN_MOST, plan: str = "arrow") -> DataFrame:
    """(key, dist) of the k (from 1 to ``most``) nearest vectors, ties by key; a repeated key counts once, at its smallest distance.
    Vectors of another length than the query's are left out; an empty query has no neighbours."""
    k = max(1, min(most, k))
    if not query:
        return vectors.select(key, F.lit(0.0).alias("dist")).limit(0)
    fitting = vectors.where(F.size("v") == len(query))
    if plan == "hof":
        return distances(fitting, key, query).groupBy(key).agg(F.min("dist").alias("dist")).orderBy("dist", key).limit(k)
    q = np.asarray(query, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(q))
            dist = np.sqrt(((x - q) ** 2).sum(1))
            ids = batch.column(0).to_numpy()
            order = np.lexsort((ids, dist))
            best = order[np.sort(np.unique(ids[order], return_index=True)[1])[:k]]
            yield pa.RecordBatch.from_arrays([pa.array(ids[best]), pa.array(dist[best])], [key, "dist"])

    near = fitting.select(key, "v").mapInArrow(run, f"{key} long, dist double")
    return near.groupBy(key).agg(F.min("dist").alias("dist")).orderBy("dist", key).limit(k)  # k rows of each batch


def region_maxsim(region_vectors: DataFrame, regions: DataFrame, query: list[float], fetch: int) -> DataFrame:
    """(asset_id, dist): the smallest distance of an asset's regions among the ``fetch`` nearest regions of all."""
    return owners_of(knn(region_vectors, "region_id", query, fetch, REGIONS_MOST), regions)


def nearest_many(vectors: DataFrame, queries: DataFrame, key: str, k: int, block: int = ANCHORS) -> DataFrame:
    """(query_id, key, dist, rank): for each row of ``queries`` (key, v) its k nearest among ``vectors``, itself left out, ties by key. Keys are
    unique on both sides. Queries go to every task in blocks of about ``block``, one pass over the vectors each; of a task only the k best
    of a query leave, and no vector is shuffled."""
    parts = max(1, -(-queries.count() // block))
    found = []
    for b in range(parts):
        asked = queries.where(F.pmod(F.xxhash64(key), F.lit(parts)) == b).select(key, "v").toArrow()
        if asked.num_rows:
            found.append(_near_block(vectors, key, k, asked.column(0).to_numpy(), np.array(asked.column(1).to_pylist(), np.float64)))
    if not found:
        return vectors.select(F.lit(0).cast("long").alias("query_id"), key, F.lit(0.0).alias("dist"), F.lit(0).alias("rank")).limit(0)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("dist", key))
    return reduce(DataFrame.unionByName, found).withColumn("rank", rank).where(F.col("rank") <= k)


def _near_block(vectors: DataFrame, key: str, k: int, names: np.ndarray, asked: np.ndarray) -> DataFrame:
    half = (asked * asked).sum(1)
    none = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the best so far of every query; only these leave the task
        dist, held = np.full((len(names), k), np.inf), np.full((len(names), k), none)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            square = (x * x).sum(1)
            for s in range(0, len(names), 1024):
                part = slice(s, min(s + 1024, len(names)))
                far = half[part, None] + square[None, :] - 2 * asked[part] @ x.T
                far[names[part, None] == ids[None, :]] = np.inf
                # a few more than k, as the quick form of the distance is not exact to the last digit
                at = np.argpartition(far, min(k + 8, far.shape[1] - 1), axis=1)[:, : k + 8]
                exact = np.sqrt(((asked[part, None, :] - x[at]) ** 2).sum(2))
                exact[ids[at] == names[part, None]] = np.inf
                every, who = np.concatenate([dist[part], exact], 1), np.concatenate([held[part], ids[at]], 1)
                best = np.lexsort((who, every))[:, :k]
                dist[part], held[part] = np.take_along_axis(every, best, 1), np.take_along_axis(who, best, 1)
        q, j = np.nonzero(np.isfinite(dist))
        yield pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(held[q, j]), pa.array(dist[q, j])], ["query_id", key, "dist"])

    return vectors.select(key, "v").mapInArrow(run, f"query_id long, {key} long, dist double")


def owners_of(near: DataFrame, regions: DataFrame) -> DataFrame:
    """(asset_id, dist): the smallest distance of an asset's regions among those found, a few rows that go to every task."""
    return regions.select("region_id", "asset_id").join(F.broadcast(near), "region_id").where("asset_id is not null").groupBy("asset_id").agg(F.min("dist").alias("dist"))


def cascade(signatures: DataFrame, vectors: DataFrame, key: str, coarse_query: list[float], query: list[float], candidates: int, k: int) -> DataFrame:
    """The k nearest by full vectors among the ``candidates`` nearest by signatures."""
    near = knn(signatures, key, coarse_query, candidates, REGIONS_MOST).select(key)
    return distances(vectors.join(F.broadcast(near), key), key, query).groupBy(key).agg(F.min("dist").alias("dist")).orderBy("dist", key).limit(k)  # at most REGIONS_MOST rows


def patch_maxsim(patches: DataFrame, query: list[list[float]], owner: str = "asset_id") -> DataFrame:
    """(owner, score): sum over the query's patches of the best dot product with one of the owner's patches (owner, v). Each patch row is
    scored against the whole (small) query at once; maxima are combined before the shuffle."""
    rows = [F.array(*[F.lit(float(x)) for x in q]) for q in query]
    dots = [F.aggregate(F.zip_with("v", q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x).alias(f"d{i}") for i, q in enumerate(rows)]
    best = patches.select(owner, *dots).groupBy(owner).agg(*[F.max(f"d{i}").alias(f"d{i}") for i in range(len(rows))])
    return best.select(owner, sum((F.col(f"d{i}") for i in range(len(rows))), F.lit(0.0)).alias("score"))


def nearest_anchor(vectors: DataFrame, key: str, anchors: DataFrame, least: float = -1.0, block: int = ANCHORS) -> DataFrame:
    """(key, anchor, sim): the most similar of ``anchors`` (anchor, v), the smallest id of equals, null below ``least``. Anchors are gone
    through in blocks of about ``block``, one pass over the vectors for each; the best of a row over all blocks counts."""
    parts = max(1, -(-anchors.count() // block))
    blocks = [anchors.where(F.pmod(F.xxhash64("anchor"), F.lit(parts)) == b).select("anchor", "v").toArrow() for b in range(parts)]
    passes = [_anchored(vectors, key, t) for t in blocks if t.num_rows]
    if not passes:
        return vectors.select(key, F.lit(None).cast("long").alias("anchor"), F.lit(None).cast("double").alias("sim"))
    out = passes[0]
    if len(passes) > 1:
        best = reduce(DataFrame.unionByName, passes).groupBy(key).agg(F.max(F.struct("sim", (-F.col("anchor")).alias("a"))).alias("b"))
        out = best.select(key, (-F.col("b.a")).alias("anchor"), F.col("b.sim").alias("sim"))
    return out.withColumn("anchor", F.when(F.col("sim") >= least, F.col("anchor")))


def _anchored(vectors: DataFrame, key: str, anchors: pa.Table) -> DataFrame:
    ids = anchors.column("anchor").to_numpy()
    order = np.argsort(ids)
    ids, matrix = ids[order], np.array(anchors.column("v").to_pylist(), np.float64)[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sim = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) @ matrix.T
            best = sim.argmax(1)
            top = sim[np.arange(len(best)), best]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids[best]), pa.array(top)], [key, "anchor", "sim"])

    return vectors.select(key, "v").mapInArrow(run, f"{key} long, anchor long, sim double")
