"""Schemas of the media model and migrations between its versions, as functions over tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Vocabularies of the model.
KINDS = ("photo", "video", "audio")
STATUSES = ("pending", "indexing", "ready", "failed")
FOLDER_STATUSES = ("online", "offline", "missing")

_ASSET_V1 = "asset_id long, sha256 string, storage_key string, kind string, size long, width int, height int, taken_at long, year string, mime string, exif string, thumb_key string, status string, error_code string, imported_at long"
SCHEMAS = {
    "assets": _ASSET_V1.replace("asset_id long,", "asset_id long, folder_id long,") + ", gps_lat double, gps_lng double",
    "folders": "folder_id long, path string, label string, channel string, status string, added_at long",
    "index_meta": "index_id long, slug string, display string, model string, dim int, vec_table string, status string, created_at long",
    "vec_assets": "asset_id long, embedding array<float>",
    "fts_text": "asset_id long, content string",
    "regions": "region_id long, asset_id long, region_idx int, bbox_x0 int, bbox_y0 int, bbox_x1 int, bbox_y1 int, area_frac double, cluster_id long, chapter_id long, created_at long",
    "vec_regions": "region_id long, embedding array<float>",
    "region_chapters": "chapter_id long, started_at long, created_at long",
    "region_clusters": "index_id long, cluster_id long, chapter_id long, prototype array<float>, member_count long, created_at long",
}
Tables = dict[str, DataFrame]


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def _v1(spark: SparkSession, t: Tables) -> Tables:
    return {"assets": spark.createDataFrame([], _ASSET_V1)} | t


def _v2(spark: SparkSession, t: Tables) -> Tables:
    return t | {"vec_assets": empty(spark, "vec_assets")}


def _v3(spark: SparkSession, t: Tables) -> Tables:
    return t | {"fts_text": empty(spark, "fts_text")}


def _v4(spark: SparkSession, t: Tables) -> Tables:
    """Folders; assets so far belong to one placeholder folder, and hashes are unique per folder from now on."""
    folders = spark.createDataFrame([(1, "", "early import", "local", "missing", 0)], SCHEMAS["folders"])
    names = [c for c in t["assets"].columns if c != "asset_id"]
    return t | {"folders": folders, "assets": t["assets"].select("asset_id", F.lit(1).cast("long").alias("folder_id"), *names)}


def _v5(spark: SparkSession, t: Tables) -> Tables:
    return t | {"index_meta": spark.createDataFrame([(1, "whole-image", "Whole image", "default", 512, "vec_assets", "active", 0)], SCHEMAS["index_meta"])}


def _v6(spark: SparkSession, t: Tables) -> Tables:
    assets = t["assets"].withColumns({"gps_lat": F.lit(None).cast("double"), "gps_lng": F.lit(None).cast("double")})
    chapters = spark.createDataFrame([(0, 0, 0)], SCHEMAS["region_chapters"])
    return t | {"assets": assets, "region_chapters": chapters} | {n: empty(spark, n) for n in ("regions", "vec_regions", "region_clusters")}


def _v7(spark: SparkSession, t: Tables) -> Tables:
    """Sentinels have no vectors."""
    sentinels = t["regions"].where("region_idx = -1").select("region_id")
    return t | {"vec_regions": t["vec_regions"].join(sentinels, "region_id", "left_anti")}


MIGRATIONS: tuple[Callable[[SparkSession, Tables], Tables], ...] = (_v1, _v2, _v3, _v4, _v5, _v6, _v7)


def migrate(spark: SparkSession, tables: Tables, version: int) -> tuple[Tables, int]:
    """Tables of ``version`` brought to the newest one."""
    for step in MIGRATIONS[version:]:
        tables = step(spark, tables)
    return tables, len(MIGRATIONS)


def known(column: str, vocabulary: tuple[str, ...], default: str):
    """Values outside a vocabulary read as its default."""
    return F.when(F.col(column).isin(*vocabulary), F.col(column)).otherwise(F.lit(default))
