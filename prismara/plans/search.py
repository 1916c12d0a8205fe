"""Hybrid search: vector streams of every index, region MaxSim and full text, fused by reciprocal rank."""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prismara.functions import scalars as S
from prismara.operators.assets import current, search_filter, taken
from prismara.plans import fts, fusion
from prismara.plans.knn import Asked, nearest

#: Stream numbers of regions and text, above those of all indexes.
REGIONS, TEXT = 1 << 20, 1 << 21


@dataclass
class Index:
    """A vector index: a raw table (key, embedding) and how many components it reads; 0 reads all."""

    table: DataFrame
    dim: int
    first: int = 0


@dataclass
class Library:
    """What a search reads, as it lies: ``assets`` may hold rows twice (prismara.operators.assets.current), vector tables too.
    ``indexes``: indexes of assets by number; ``region_index``: that of regions; ``text``: (asset_id, content)."""

    assets: DataFrame
    folders: DataFrame
    indexes: dict[int, Index]
    regions: DataFrame
    region_index: Index
    text: DataFrame


@dataclass
class Filters:
    folder_id: int | None = None
    taken_from: float | None = None
    taken_to: float | None = None
    kind: str | None = None
    #: Filters apply to what the streams found; before, they narrow what the streams look at.
    before: bool = False

    def column(self) -> Column:
        return search_filter(self.folder_id, self.taken_from, self.taken_to, self.kind)


def _collected(streams: list[tuple[str, DataFrame]]) -> tuple[list, list[str]]:
    """Hits of all streams and the names of those that failed. All run as one job; only if that fails each runs by itself, so that a
    broken index costs its own hits alone."""
    try:
        return reduce(DataFrame.unionByName, [df for _, df in streams]).collect(), []
    except Exception:  # noqa: BLE001  told apart below
        rows, failed = [], []
        for name, df in streams:
            try:
                rows += df.collect()
            except Exception:  # noqa: BLE001
                failed.append(name)
        return rows, failed


def hybrid_search(library: Library, text: str, queries: dict[int, list[float]], top_k: int = 100, filters: Filters | None = None, limit: int | None = None) -> DataFrame:
    """(asset_id, score, similarity, matched, file_name, folder_id, folder_label, size_bytes, taken_at), best first.

    ``queries``: the query's vector for each index that reads text; without any, full text alone answers. A stream takes the top_k (1 to
    500) nearest, three times as many where a folder is asked for, as filters act on what was found; the region stream takes three
    times that. score is relative to the best, rounded to three places; similarity is that of the last index that found the asset and null
    for assets found by regions or text alone. The list is not cut unless ``limit`` is given. A stream that fails is left out with a warning.

    The streams' hits, a few times top_k, are gathered first; then only their assets are read.
    """
    filters = filters or Filters()
    k = max(1, min(500, top_k))
    wide = 3 * k if filters.folder_id is not None else k
    spark = library.assets.sparkSession
    every = current(library.assets).where(filters.column())
    source = (lambda df: df.join(every.select("asset_id"), "asset_id", "left_semi")) if filters.before else (lambda df: df)
    named = lambda df, semantic, order: df.select("stream", F.lit(semantic).alias("semantic"), F.col(order).alias("order"), "asset_id")
    streams, first = [], None
    tables: dict[int, list] = {}
    for number, index in sorted(library.indexes.items()):
        if query := queries.get(number):
            first = first or query
            tables.setdefault(id(index.table), []).append((index, Asked(number, query, wide)))
    for own in tables.values():  # indexes of one table share a pass
        index = own[0][0]
        streams.append((f"index {[a.stream for _, a in own]}", named(nearest(source(index.table), "asset_id", index.dim, [a for _, a in own]), True, "dist")))
    if first:
        near = nearest(library.region_index.table, "region_id", library.region_index.dim, [Asked(REGIONS, first, 3 * wide)])
        owners = library.regions.select("region_id", "asset_id").join(F.broadcast(near), "region_id").where("asset_id is not null")
        streams.append(("regions", named(owners.groupBy("stream", "asset_id").agg(F.min("dist").alias("dist")), True, "dist")))
    if S.query_terms(text):
        streams.append(("text", named(fts.search_scan(source(library.text), text, k).withColumn("stream", F.lit(TEXT)), False, "rank")))
    rows, failed = _collected(streams) if streams else ([], [])
    if failed:
        warnings.warn(f"search without {', '.join(failed)}")
    hits = spark.createDataFrame(rows, "stream int, semantic boolean, order double, asset_id long")
    met = hits.select("asset_id").distinct()
    # filters act here, before places are numbered
    assets = current(library.assets.join(F.broadcast(met), "asset_id", "left_semi")).where(filters.column())
    place = F.row_number().over(W.partitionBy("stream").orderBy("order", "asset_id"))
    ranked = assets.join(F.broadcast(hits), "asset_id").withColumn("rank", place)
    whole = F.when(F.col("stream") < REGIONS, F.col("stream"))
    fused = ranked.groupBy("asset_id").agg(
        *fusion.fused(),
        F.max_by(S.similarity(F.col("order")), whole).alias("similarity"),
        *[F.first(c).alias(c) for c in ("folder_id", "storage_key", "size", "taken_at")],
    )
    best = F.greatest(F.max("score").over(W.partitionBy(F.lit(0))), F.lit(1e-9))  # over the hits
    scored = fused.withColumn("raw", F.col("score")).withColumn("score", F.round(F.col("score") / best, 3))
    named_folders = library.folders.select("folder_id", F.coalesce("label", "path").alias("folder_label"))
    page = scored.join(named_folders, "folder_id", "left").orderBy(F.desc("raw"), "asset_id")
    page = page.limit(limit) if limit is not None else page
    return page.select(
        "asset_id", "score", "similarity", "matched", S.basename(F.col("storage_key")).alias("file_name"), "folder_id",
        F.coalesce("folder_label", F.lit("")).alias("folder_label"), F.coalesce("size", F.lit(0)).alias("size_bytes"), taken().alias("taken_at"),
    )
