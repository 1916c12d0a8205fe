"""Browsing, joins, queues and counts over assets, folders, vectors and regions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prismara.functions import scalars as S

PAGE_LIMIT = 500
IDS_INLINE = 1_000
#: Most folder paths sent to every task.
FOLDERS_SENT = 100_000


def current(assets: DataFrame, *columns: str) -> DataFrame:
    """One row per asset with ``columns`` (all without any): of repeated rows one that is no longer pending, of several the largest.
    Null keys are left out. The choice is an aggregate of rows, so it is combined before the shuffle, and only ``columns`` are read."""
    others = list(columns) or [c for c in assets.columns if c != "asset_id"]
    best = F.max(F.struct((F.col("status") != "pending").alias("_done"), *others)).alias("_row")
    return assets.where("asset_id is not null").groupBy("asset_id").agg(best).select("asset_id", *[F.col("_row")[c].alias(c) for c in others])


def taken(column: str = "taken_at") -> Column:
    """Capture time with null read as 0."""
    return F.coalesce(F.col(column), F.lit(0))


def timeline_order(assets: DataFrame, cursor: tuple[int, int] | None = None, folder_id: int | None = None) -> DataFrame:
    """Raw rows after ``cursor``, newest first, larger ids first in a tie. Cursor and folder are conditions on plain columns that reach the
    scan; a limit on the result is a top-k per task."""
    rows = assets.where("asset_id is not null")
    if folder_id is not None:
        rows = rows.where(F.col("folder_id") == folder_id)
    if cursor is not None:
        t, i = cursor
        at = F.col("taken_at")
        before = (at < t) | ((at == t) & (F.col("asset_id") < i))
        if t > 0:
            before = before | at.isNull()
        elif t == 0:
            before = before | (at.isNull() & (F.col("asset_id") < i))
        rows = rows.where(before)
    return rows.orderBy(F.desc(taken()), F.desc("asset_id"))


def timeline_page(assets: DataFrame, cursor: tuple[int, int] | None = None, page_size: int = 200, folder_id: int | None = None) -> DataFrame:
    """A page of the timeline: newest first, larger ids first in a tie, after ``cursor``; 1 to 500 rows.

    ``assets`` may hold a key twice, in two states of one capture time and folder; only the rows of the page are settled, so no table is
    shuffled. The page is read at once; it is small by definition.
    """
    n = max(1, min(PAGE_LIMIT, page_size))
    ordered, most = timeline_order(assets, cursor, folder_id), 2 * n + 16
    while True:
        found = ordered.limit(most).collect()
        # rows of one key are next to each other; the last key may have more of them
        if len(found) < most or len({r["asset_id"] for r in found}) > n:
            break
        most *= 4
    page = assets.sparkSession.createDataFrame(found, assets.schema)
    page = current(page) if "status" in assets.columns else page.dropDuplicates(["asset_id"])
    return page.withColumn("taken_at", taken()).orderBy(F.desc("taken_at"), F.desc("asset_id")).limit(n)


def next_cursor(page: list, page_size: int) -> str | None:
    """Cursor after a collected page; None where it was not full."""
    size = max(1, min(PAGE_LIMIT, page_size))
    return S.format_cursor(page[-1]["taken_at"] or 0, page[-1]["asset_id"]) if page and len(page) >= size else None


def year_groups(page: DataFrame) -> DataFrame:
    """(year, n, first_id, last_id, items) of a page, items in the page's order."""
    items = F.transform(F.array_sort(F.collect_list(F.struct((-taken()).alias("t"), (-F.col("asset_id")).alias("i")))), lambda x: -x["i"])
    grouped = page.groupBy("year").agg(F.count("*").alias("n"), items.alias("items"))
    return grouped.select("year", "n", F.element_at("items", 1).alias("first_id"), F.element_at("items", -1).alias("last_id"), "items")


def available_years(assets: DataFrame, newest: int = PAGE_LIMIT) -> DataFrame:
    """(year, position): distinct years of the newest rows, in order of first appearance."""
    page = timeline_page(assets, None, newest).withColumn("pos", F.row_number().over(W.orderBy(F.desc("taken_at"), F.desc("asset_id"))))  # at most PAGE_LIMIT rows
    return page.groupBy("year").agg(F.min("pos").alias("pos")).withColumn("position", F.row_number().over(W.orderBy("pos"))).select("year", "position")


def summary(assets: DataFrame, folders: DataFrame) -> DataFrame:
    """Assets with file name, folder label (the path where there is none) and size; assets of no folder keep an empty label."""
    names = folders.select("folder_id", F.coalesce("label", "path").alias("folder_label"))
    rows = assets.join(names, "folder_id", "left")
    return rows.select("asset_id", "folder_id", S.basename(F.col("storage_key")).alias("file_name"), F.coalesce("folder_label", F.lit("")).alias("folder_label"), F.coalesce("size", F.lit(0)).alias("size_bytes"), taken().alias("taken_at"))


def asset_detail(assets: DataFrame, folders: DataFrame) -> DataFrame:
    return assets.join(folders.select("folder_id", "path", F.col("status").alias("folder_status")), "folder_id")


def folder_counts(folders: DataFrame, assets: DataFrame) -> DataFrame:
    """Every folder with its number of assets, 0 for none. Assets are counted before the join."""
    counted = assets.groupBy("folder_id").agg(F.count("*").alias("n"))
    return folders.join(counted, "folder_id", "left").select("folder_id", "path", "label", "status", "added_at", F.coalesce("n", F.lit(0)).alias("asset_count"))


def watched_folders(folders: DataFrame) -> DataFrame:
    return folders.where((F.col("status") == "online") & (F.col("path") != ""))


def owner_of_path(paths: DataFrame, folders: DataFrame, sent: int = FOLDERS_SENT) -> DataFrame:
    """(path, folder_id) of the folder with the longest path above each path, null where no folder holds it.

    A prefix test becomes an equality of a path's ancestors with folder paths. Up to ``sent`` folders go to every task, which looks the
    ancestors up from the longest down; beyond, every ancestor is a row of a hash join. A path counts once; ties cannot occur as folder
    paths are unique once trailing slashes are dropped (the smaller id wins if they are not).
    """
    bare = F.regexp_replace("path", r"[\\/]+$", "")
    owners = folders.select("folder_id", bare.alias("above")).where(F.length("above") > 0).groupBy("above").agg(F.min("folder_id").alias("folder_id"))
    once = paths.select("path").where("path is not null").distinct()
    if owners.count() <= sent:
        shared = paths.sparkSession.sparkContext.broadcast({r.above: r.folder_id for r in owners.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = shared.value
            for batch in batches:
                out = []
                for path in batch.column(0).to_pylist():
                    at, owner = len(path), held.get(path)
                    while owner is None and (at := max(path.rfind("/", 0, at), path.rfind("\\", 0, at))) >= 0:
                        owner = held.get(path[:at])
                    out.append(owner)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], ["path", "folder_id"])

        return once.mapInArrow(run, "path string, folder_id long")
    cuts = F.filter(F.sequence(F.lit(1), F.length("path")), lambda i: F.substring(F.col("path"), i, F.lit(1)).isin("/", "\\"))
    ancestors = F.transform(F.concat(cuts, F.array(F.length("path") + 1)), lambda i: F.substring(F.col("path"), F.lit(1), i - 1))
    above = once.select("path", F.explode(ancestors).alias("above"))
    best = above.join(owners, "above").groupBy("path").agg(F.max_by("folder_id", F.length("above")).alias("folder_id"))
    return once.join(best, "path", "left")


def folder_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(folder_id, change): folders to be watched from now on and those no longer."""
    a, b = before.select("folder_id").distinct(), after.select("folder_id").distinct()
    return b.subtract(a).withColumn("change", F.lit("watch")).unionByName(a.subtract(b).withColumn("change", F.lit("unwatch")))


def pending_embeddings(assets: DataFrame, folders: DataFrame, vectors: DataFrame, folder_id: int | None = None) -> DataFrame:
    """Ready assets of online folders without a vector. An explicit anti join: it has a shuffled form, which NOT IN lacks."""
    online = folders.where("status = 'online'").select("folder_id")
    ready = assets.where("status = 'ready'")
    if folder_id is not None:
        ready = ready.where(F.col("folder_id") == folder_id)
    return ready.join(online, "folder_id", "left_semi").join(vectors.select("asset_id"), "asset_id", "left_anti").select("asset_id", "folder_id", "year", "sha256")


def pending_regions(assets: DataFrame, folders: DataFrame, regions: DataFrame) -> DataFrame:
    """Ready photos of online folders without any region row, sentinels included."""
    ready = assets.where("status = 'ready' and kind = 'photo'")
    online = folders.where("status = 'online'").select("folder_id")
    return ready.join(online, "folder_id", "left_semi").join(regions.select("asset_id"), "asset_id", "left_anti").select("asset_id", "storage_key", "taken_at")


def queue(rows: DataFrame, limit: int, *order: str) -> DataFrame:
    return rows.orderBy(*order).limit(limit)


def of_ids(rows: DataFrame, ids: list[int], key: str = "asset_id") -> DataFrame:
    """Rows whose key is in a list. A short list is a condition that reaches the scan, a long one a semi join."""
    if len(ids) <= IDS_INLINE:
        return rows.where(F.col(key).isin(ids))
    return rows.join(rows.sparkSession.createDataFrame([(i,) for i in set(ids)], f"{key} long"), key, "left_semi")


def pending_total(assets: DataFrame, folders: DataFrame, active: DataFrame, members: DataFrame) -> DataFrame:
    """(pending): the lengths of the queues of all active indexes together: every index times the assets that are due, less the vectors that
    these have in active indexes. No asset is multiplied by the indexes."""
    due = assets.where("status = 'ready'").join(folders.where("status = 'online'").select("folder_id"), "folder_id", "left_semi").select("asset_id")
    n = active.select("index_id").distinct().count()
    held = members.distinct().join(F.broadcast(active.select("index_id").distinct()), "index_id", "left_semi").groupBy("asset_id").agg(F.count("*").alias("n"))  # a row per registered index
    return due.join(held, "asset_id", "left").agg(F.coalesce(F.sum(F.lit(n) - F.coalesce("n", F.lit(0))), F.lit(0)).cast("long").alias("pending"))


def embedding_progress(assets: DataFrame, vectors: DataFrame) -> DataFrame:
    """(folder_id, total, done): ready assets and those with a vector, per folder, in one pass."""
    has = vectors.select("asset_id").distinct().withColumn("has", F.lit(True))
    return assets.where("status = 'ready' and folder_id is not null").join(has, "asset_id", "left").groupBy("folder_id").agg(F.count("*").alias("total"), F.count_if("has").alias("done"))


def copy_candidates(assets: DataFrame, vectors: DataFrame, key: str = "asset_id") -> DataFrame:
    """(asset_id, source_id): assets without a vector and the smallest other asset of the same content that has one. Sources are
    reduced to one per content before the join, so copies of one content cost one row."""
    has = vectors.select("asset_id").distinct()
    sources = assets.where("sha256 is not null").join(has, "asset_id", "left_semi").groupBy("sha256").agg(F.min("asset_id").alias("source_id"))
    return assets.join(has, "asset_id", "left_anti").join(sources, "sha256").select("asset_id", "source_id")


def indexed_flags(assets: DataFrame, members: DataFrame, active: DataFrame) -> DataFrame:
    """(asset_id, indexed): whether an asset has a vector in every active index; false where none is active. ``members``: (index_id, asset_id)."""
    n = active.select("index_id").distinct().count()
    held = members.join(active.select("index_id"), "index_id", "left_semi").groupBy("asset_id").agg(F.countDistinct("index_id").alias("held"))
    return assets.select("asset_id").join(held, "asset_id", "left").select("asset_id", (F.lit(n > 0) & (F.coalesce("held", F.lit(0)) == n)).alias("indexed"))


def storage_usage(active: DataFrame, members: DataFrame) -> DataFrame:
    """(index_id, n, bytes) of active indexes: four bytes per component."""
    counted = members.groupBy("index_id").agg(F.count("*").alias("n"))
    return active.join(counted, "index_id", "left").select("index_id", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) * F.col("dim") * 4).alias("bytes"))


def search_filter(folder_id: int | None = None, taken_from: float | None = None, taken_to: float | None = None, kind: str | None = None) -> Column:
    """Conjunction of the given conditions; bounds are inclusive, an empty kind is none."""
    out = F.lit(True)
    if folder_id is not None:
        out = out & (F.col("folder_id") == folder_id)
    if taken_from is not None:
        out = out & (taken() >= taken_from)
    if taken_to is not None:
        out = out & (taken() <= taken_to)
    if kind:
        out = out & (F.col("kind") == kind)
    return out
