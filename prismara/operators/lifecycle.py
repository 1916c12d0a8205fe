"""Changes as functions from tables to tables; a commit writes their results as a new snapshot (prismara.sources.catalog)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prismara.functions import scalars as S
from prismara.storage import materialise


def allocate(rows: DataFrame, existing: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with new ids in ``order``, after the largest existing one. Numbers come from a range partitioning: a count per
    partition gives each its offset, so no single task sees all rows."""
    top = existing.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    spread = rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()) if order else rows.withColumn("_p", F.spark_partition_id())
    spread = materialise(spread, "allocate")
    offsets, at = {}, int(top)
    for p, n in sorted(tuple(r) for r in spread.groupBy("_p").count().collect()):  # a row per partition
        offsets[p] = at
        at += n
    if not offsets:
        return spread.drop("_p").withColumn(key, F.lit(None).cast("long"))
    mapping = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])
    rank = F.row_number().over(W.partitionBy("_p").orderBy(*order))
    return spread.withColumn(key, (mapping[F.col("_p")] + rank).cast("long")).drop("_p")


def insert_outcomes(arrivals: DataFrame, assets: DataFrame, order: str = "storage_key") -> DataFrame:
    """(folder_id, sha256, storage_key, duplicated): per arriving row whether its content already is in the folder, in the table or by
    an earlier row (smallest ``order``) of the same arrival. Existing rows stay as they are."""
    first = arrivals.groupBy("folder_id", "sha256").agg(F.min(order).alias("_first"))
    held = assets.select("folder_id", "sha256").distinct().withColumn("_held", F.lit(True))
    marked = first.join(held, ["folder_id", "sha256"], "left")
    return arrivals.join(marked, ["folder_id", "sha256"]).select("folder_id", "sha256", "storage_key", (F.coalesce("_held", F.lit(False)) | (F.col(order) != F.col("_first"))).alias("duplicated"))


def set_state(assets: DataFrame, ids: DataFrame, **values) -> DataFrame:
    """Rows of ``ids`` (asset_id) with columns set to values; others unchanged."""
    marked = assets.join(ids.select("asset_id").distinct().withColumn("_hit", F.lit(True)), "asset_id", "left")
    return marked.select([F.when(F.col("_hit"), F.lit(values[c]).cast(assets.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in assets.columns])


def reset_failed(assets: DataFrame) -> DataFrame:
    failed = F.col("status") == "failed"
    return assets.withColumns({"error_code": F.when(failed, F.lit(None)).otherwise(F.col("error_code")), "status": F.when(failed, F.lit("pending")).otherwise(F.col("status"))})


def delete_assets(tables: dict[str, DataFrame], ids: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without the assets of ``ids`` and all that hangs on them, and the thumbnails that nothing refers to any more.

    ``tables`` may hold assets, vectors (asset_id), regions (asset_id, region_id), vec_regions (region_id), fts (asset_id)."""
    gone = ids.select("asset_id").where("asset_id is not null").distinct()
    assets = tables["assets"]
    out = dict(tables)
    for name in ("assets", "vectors", "fts"):
        if name in tables:
            out[name] = tables[name].join(gone, "asset_id", "left_anti")
    if "regions" in tables:
        lost = tables["regions"].join(gone, "asset_id", "left_semi").select("region_id")
        out["regions"] = tables["regions"].join(gone, "asset_id", "left_anti")
        if "vec_regions" in tables:
            out["vec_regions"] = tables["vec_regions"].join(lost, "region_id", "left_anti")
    hit = F.coalesce("_gone", F.lit(False))
    refs = assets.where("thumb_key is not null").join(gone.withColumn("_gone", F.lit(True)), "asset_id", "left").groupBy("thumb_key").agg(F.count("*").alias("before"), F.count_if(~hit).alias("after"))
    return out, refs.where("before > 0 and after = 0").select("thumb_key")


def delete_report(assets: DataFrame, ids: DataFrame) -> DataFrame:
    """(deleted, missing) of a list of ids: a repeated id is deleted once and missing from then on."""
    asked = ids.groupBy("asset_id").agg(F.count("*").alias("times"))
    known = assets.select("asset_id").distinct().withColumn("_here", F.lit(1))
    both = asked.join(known, "asset_id", "left").select("times", F.coalesce("_here", F.lit(0)).alias("here"))
    return both.agg(F.coalesce(F.sum("here"), F.lit(0)).alias("deleted"), F.coalesce(F.sum(F.col("times") - F.col("here")), F.lit(0)).alias("missing"))


def relocate(assets: DataFrame, folder_id: int, old_path: str, new_path: str) -> DataFrame:
    """Assets of a folder with the old path at the start of their key replaced; an empty old path changes nothing."""
    if not old_path:
        return assets
    hit = (F.col("folder_id") == folder_id) & F.col("storage_key").startswith(old_path)
    moved = F.concat(F.lit(new_path), F.expr(f"substr(storage_key, {len(old_path) + 1})"))
    return assets.withColumn("storage_key", F.when(hit, moved).otherwise(F.col("storage_key")))


def upsert(table: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """``table`` with ``rows`` in place of rows of the same key; of repeated new keys one row stays."""
    fresh = rows.dropDuplicates(list(key))
    return table.join(fresh.select(*key), list(key), "left_anti").unionByName(fresh.select(*table.columns))


def write_vectors(vectors: DataFrame, new: DataFrame, assets: DataFrame) -> DataFrame:
    """Vectors replaced or added, except those whose asset has gone."""
    return upsert(vectors, new.join(assets.select("asset_id"), "asset_id", "left_semi"), "asset_id")


def clear_vectors(vectors: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Vectors without those of ``ids`` (all without it), and how many that were."""
    if ids is None:
        return vectors.limit(0), vectors.count()
    gone = vectors.join(ids.select("asset_id").distinct(), "asset_id", "left_semi")
    return vectors.join(ids.select("asset_id"), "asset_id", "left_anti"), gone.count()


def register_index(registry: DataFrame, slug: str, display: str, model: str, dim: int, now: int) -> DataFrame:
    """The registry with an index of that slug; a known slug is left as it is."""
    if not re.fullmatch(r"[a-z0-9-]{1,64}", slug):
        raise ValueError("slug: 1 to 64 of a-z, 0-9 and -")
    if not 1 <= dim <= 4096:
        raise ValueError("dim: 1 to 4096")
    if registry.where(F.col("slug") == slug).limit(1).count():
        return registry
    top = registry.agg(F.coalesce(F.max("index_id"), F.lit(0))).first()[0] + 1
    row = registry.sparkSession.createDataFrame([(top, slug, display, model, dim, f"vec_i{top}", "active", now)], registry.schema)
    return registry.unionByName(row)


def folders_for(folders: DataFrame, wanted: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """The folders with a row for each path of ``wanted`` (path, label), and (path, folder_id, created) of these. A known path keeps its
    row; new ones are local and online, numbered on in order of path. Null paths are left out, a repeated path counts once."""
    once = wanted.where("path is not null").groupBy("path").agg(F.min("label").alias("label"))
    known = folders.where("path is not null").groupBy("path").agg(F.min("folder_id").alias("folder_id"))
    fresh = materialise(allocate(once.join(known, "path", "left_anti"), folders, "folder_id", ["path"]), "folders")
    rows = fresh.select("folder_id", "path", "label", F.lit("local").alias("channel"), F.lit("online").alias("status"), F.lit(now).cast("long").alias("added_at"))
    found = once.join(known, "path").select("path", "folder_id", F.lit(False).alias("created"))
    return folders.unionByName(rows.select(*folders.columns)), found.unionByName(fresh.select("path", "folder_id", F.lit(True).alias("created")))


def reindex(vectors: dict[int, DataFrame], registry: DataFrame, assets: DataFrame, folder_id: int | None = None, ids: DataFrame | None = None) -> tuple[dict[int, DataFrame], DataFrame]:
    """Vector tables by index without what is to be indexed anew, and (index_id, cleared). All of the active indexes without a scope; with
    ``folder_id`` the vectors of a folder's assets in the active ones; with ``ids`` (asset_id) those of these assets in all indexes. What
    is cleared is in the queues again by itself."""
    active = {r.index_id for r in registry.where("status = 'active'").select("index_id").collect()}  # a row per index
    if ids is not None:
        scope = ids.select("asset_id").distinct()
    else:
        scope = assets.where(F.col("folder_id") == folder_id).select("asset_id").distinct() if folder_id is not None else None
    out, counts = dict(vectors), []
    for index, table in vectors.items():
        if index in active or ids is not None:
            gone = table if scope is None else table.join(scope, "asset_id", "left_semi")
            out[index] = table.limit(0) if scope is None else table.join(scope, "asset_id", "left_anti")
            counts.append(gone.agg(F.lit(index).alias("index_id"), F.count("*").alias("cleared")))
    return out, reduce(DataFrame.unionByName, counts) if counts else registry.select("index_id", F.lit(0).cast("long").alias("cleared")).limit(0)


def upsert_prototypes(clusters: DataFrame, rows: DataFrame) -> DataFrame:
    """Prototypes by (index_id, cluster_id): a known one takes prototype, count and chapter of the new row and keeps its age."""
    fresh = rows.dropDuplicates(["index_id", "cluster_id"])
    born = clusters.select("index_id", "cluster_id", F.col("created_at").alias("_born"))
    aged = fresh.join(born, ["index_id", "cluster_id"], "left").withColumn("created_at", F.coalesce("_born", "created_at"))
    return upsert(clusters, aged.select(*clusters.columns), "index_id", "cluster_id")


def prototypes(clusters: DataFrame, index_id: int) -> DataFrame:
    """(cluster_id, chapter_id, prototype, member_count) of an index, in order of cluster_id."""
    return clusters.where(F.col("index_id") == index_id).select("cluster_id", "chapter_id", "prototype", "member_count").orderBy("cluster_id")


def delete_prototypes(clusters: DataFrame, gone: DataFrame) -> DataFrame:
    """Prototypes without those of ``gone`` (index_id, cluster_id)."""
    return clusters.join(gone.select("index_id", "cluster_id").distinct(), ["index_id", "cluster_id"], "left_anti")


def latest_chapter(chapters: DataFrame) -> DataFrame:
    """(chapter_id, started_at) of the chapter with the largest id; no row for no chapter."""
    return chapters.agg(F.max(F.struct("chapter_id", "started_at")).alias("c")).where("c is not null").select("c.chapter_id", "c.started_at")


def folder_status(folders: DataFrame, present: DataFrame) -> DataFrame:
    """(folder_id, status) after a look at the originals; ``present``: (folder_id, exists). A folder whose original is absent goes
    offline, one whose original is there and that was not online comes online, others keep their status."""
    seen = present.groupBy("folder_id").agg(F.bool_and("exists").alias("ok"))
    status = F.when(~F.col("ok"), F.lit("offline")).when(F.col("ok"), F.lit("online")).otherwise(F.col("status"))
    return folders.join(seen, "folder_id", "left").select("folder_id", status.alias("status"))


def thumb_keys_expected(assets: DataFrame) -> DataFrame:
    """(asset_id, thumb_key, expected) of ready assets."""
    return assets.where("status = 'ready'").select("asset_id", "thumb_key", S.thumb_key(F.col("sha256")).alias("expected"))
