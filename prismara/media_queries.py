"""Queries of the media engine over whole tables, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prismara.functions import scalars as S
from prismara.operators import assets as A
from prismara.operators import clusters as C
from prismara.operators import lifecycle as L
from prismara.operators import metrics as M
from prismara.operators import regions as R
from prismara.plans import fts, fusion, knn, search
from prismara.sources import files
from prismara.storage import materialise
from prismara.tables import load, one_per_key

DIM, PREFIX = 64, 8
K = 50
TEXT = "IMG_2022 jpg"
FOLDER = 17
REGISTRY = [(1, "whole-64", DIM, "active"), (2, "prefix-8", PREFIX, "active"), (3, "retired", 16, "disabled")]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Media:
    """The tables of a library: one row per key, usable vectors as unit vectors."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        """A table as it lies; its files are listed once."""
        if name not in self._raw:
            self._raw[name] = load(self.spark, self.dir, name)
        return self._raw[name]

    @property
    def assets(self) -> DataFrame:
        return A.current(self.raw("assets"))

    def some(self, *columns: str) -> DataFrame:
        """asset_id and ``columns`` of the current assets; other columns are not read."""
        return A.current(self.raw("assets"), *columns)

    def states(self, *columns: str) -> DataFrame:
        """asset_id, status and ``columns`` of the raw rows, repeated keys included, for operators that settle these themselves."""
        return self.raw("assets").select("asset_id", "status", *columns)

    @property
    def folders(self) -> DataFrame:
        return self.raw("folders")

    @property
    def regions(self) -> DataFrame:
        rows = self.raw("regions")
        return one_per_key(rows, "region_id", *[c for c in rows.columns if c != "region_id"])

    @property
    def vectors(self) -> DataFrame:
        return knn.unit_vectors(self.raw("vec_assets"), "asset_id", DIM)

    @property
    def prefixes(self) -> DataFrame:
        return knn.unit_vectors(self.raw("vec_assets"), "asset_id", DIM, first=PREFIX)

    @property
    def region_vectors(self) -> DataFrame:
        return knn.unit_vectors(self.raw("vec_regions"), "region_id", DIM)

    @property
    def vector_ids(self) -> DataFrame:
        return knn.vector_keys(self.raw("vec_assets"), "asset_id", DIM)

    @property
    def prefix_ids(self) -> DataFrame:
        return knn.vector_keys(self.raw("vec_assets"), "asset_id", DIM, first=PREFIX)

    @property
    def region_ids(self) -> DataFrame:
        return knn.vector_keys(self.raw("vec_regions"), "region_id", DIM)

    @property
    def once(self) -> DataFrame:
        """Asset vectors, one per key."""
        return knn.unit_vectors(self.raw("vec_assets"), "asset_id", DIM, once=True)

    @property
    def regions_once(self) -> DataFrame:
        """Region vectors, one per key."""
        return knn.unit_vectors(self.raw("vec_regions"), "region_id", DIM, once=True)

    def region(self, *columns: str) -> DataFrame:
        """region_id and ``columns`` of the regions, one row per key."""
        return one_per_key(self.raw("regions").select("region_id", *columns), "region_id", *columns)

    @property
    def members(self) -> DataFrame:
        """(index_id, asset_id) of the registered indexes."""
        one = self.vector_ids.select(F.lit(1).alias("index_id"), "asset_id")
        return one.unionByName(self.prefix_ids.select(F.lit(2).alias("index_id"), "asset_id"))

    @property
    def registry(self) -> DataFrame:
        return self.spark.createDataFrame(REGISTRY, "index_id int, slug string, dim int, status string")

    @property
    def active(self) -> DataFrame:
        return self.registry.where("status = 'active'")

    @property
    def text(self) -> DataFrame:
        """(asset_id, content): the stem of the file name."""
        return self.some("storage_key").select("asset_id", S.stem(F.col("storage_key")).alias("content"))

    def query(self, index: int = 1) -> list[float]:
        """The vector of the smallest asset as query vector."""
        return knn.first_vector(self.raw("vec_assets"), "asset_id", DIM, first=None if index == 1 else PREFIX)

    def near(self, *asked: knn.Asked) -> DataFrame:
        """(stream, asset_id, dist) of searches over the asset vectors, in one pass."""
        return knn.nearest(self.raw("vec_assets"), "asset_id", DIM, list(asked))

    def near_regions(self, query: list[float], k: int) -> DataFrame:
        return knn.nearest(self.raw("vec_regions"), "region_id", DIM, [knn.Asked(1, query, k)])


def _query(sql: str | None = None):
    def add(f: Callable[[Media], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Media(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = _BASE + sql
        return f

    return add


def _usable(table: str, key: str, first: int = DIM) -> str:
    take = "e" if first == DIM else f"e[1:{first}]"
    return f"""(select {key}, list_transform(p, lambda x: x / n) v from (select {key}, p, sqrt(list_sum(list_transform(p, lambda x: x * x))) n
    from (select {key}, {take} p from (select distinct {key}, embedding::double[] e from {table} where len(embedding) = {DIM} and len(list_filter(embedding, lambda x: isfinite(x))) = {DIM}))) where n > 0)"""


_BASE = f"""with a as (select * exclude rn from (select *, row_number() over (partition by asset_id order by (status <> 'pending') desc, storage_key) rn from assets where asset_id is not null) where rn = 1),
 r as (select distinct * from regions), v1 as {_usable('vec_assets', 'asset_id')}, v2 as {_usable('vec_assets', 'asset_id', PREFIX)}, vr as {_usable('vec_regions', 'region_id')},
 q1 as (select v from v1 order by asset_id limit 1), q2 as (select v from v2 order by asset_id limit 1),
 idx(index_id, slug, dim, status) as (values (1, 'whole-64', {DIM}, 'active'), (2, 'prefix-8', {PREFIX}, 'active'), (3, 'retired', 16, 'disabled')),
 m as (select 1 index_id, asset_id from v1 union all select 2, asset_id from v2),
 online as (select folder_id from folders where status = 'online'),
 base(asset_id, name) as (select asset_id, regexp_extract(storage_key, '[^/\\\\]*$') from a),
 txt as (select asset_id, case when strpos(name[2:], '.') > 0 then regexp_replace(name, '\\.[^.]*$', '') else name end as content from base)
"""

# Browsing


@_query("select asset_id, coalesce(taken_at, 0) taken_at, year, status, folder_id from a order by coalesce(taken_at, 0) desc, asset_id desc limit 200")
def timeline_first_page(m: Media) -> DataFrame:
    return A.timeline_page(m.states("taken_at", "year", "folder_id"), None, 200).select("asset_id", "taken_at", "year", "status", "folder_id")


@_query("select asset_id, coalesce(taken_at, 0) taken_at from a where coalesce(taken_at, 0) < 1650000000 or (coalesce(taken_at, 0) = 1650000000 and asset_id < 500) order by 2 desc, 1 desc limit 200")
def timeline_next_page(m: Media) -> DataFrame:
    return A.timeline_page(m.states("taken_at"), S.parse_cursor("1650000000:500"), 200).select("asset_id", "taken_at")


@_query(f"select asset_id, coalesce(taken_at, 0) taken_at from a where folder_id = {FOLDER} order by 2 desc, 1 desc limit 100")
def timeline_folder_page(m: Media) -> DataFrame:
    return A.timeline_page(m.states("taken_at", "folder_id"), None, 100, FOLDER).select("asset_id", "taken_at")


@_query("""select year, count(*) n, arg_min(asset_id, pos) first_id, arg_max(asset_id, pos) last_id
 from (select year, asset_id, row_number() over (order by coalesce(taken_at, 0) desc, asset_id desc) pos from a qualify pos <= 500) group by year""")
def timeline_year_groups(m: Media) -> DataFrame:
    return A.year_groups(A.timeline_page(m.states("taken_at", "year"), None, 500)).select("year", "n", "first_id", "last_id")


@_query("""select year, row_number() over (order by min(pos)) as position from (select year, row_number() over (order by coalesce(taken_at, 0) desc, asset_id desc) pos from a qualify pos <= 500) group by year""")
def available_years(m: Media) -> DataFrame:
    return A.available_years(m.states("taken_at", "year"))


@_query("select asset_id, sha256, status, kind from a where asset_id = 101")
def asset_point_lookup(m: Media) -> DataFrame:
    return m.some("sha256", "status", "kind").where("asset_id = 101").select("asset_id", "sha256", "status", "kind")


@_query(f"select folder_id, path, (select count(*) from a where folder_id = {FOLDER}) asset_count from folders where folder_id = {FOLDER}")
def folder_point_lookup(m: Media) -> DataFrame:
    return A.folder_counts(m.folders, m.some("folder_id")).where(F.col("folder_id") == FOLDER).select("folder_id", "path", "asset_count")


@_query("select a.asset_id, f.path, f.status folder_status, a.width, a.height, a.mime from a join folders f on a.folder_id = f.folder_id")
def asset_detail(m: Media) -> DataFrame:
    return A.asset_detail(m.some("folder_id", "width", "height", "mime"), m.folders).select("asset_id", "path", "folder_status", "width", "height", "mime")


@_query("""select a.asset_id, base.name file_name, coalesce(f.label, f.path, '') folder_label, coalesce(a.size, 0) size_bytes from a join base using (asset_id) left join folders f on a.folder_id = f.folder_id""")
def asset_summary(m: Media) -> DataFrame:
    return A.summary(m.some("folder_id", "storage_key", "size", "taken_at"), m.folders).select("asset_id", "file_name", "folder_label", "size_bytes")


@_query("select asset_id, error_code, imported_at from a where status = 'failed'")
def failed_items(m: Media) -> DataFrame:
    return m.some("status", "error_code", "imported_at").where("status = 'failed'").select("asset_id", "error_code", "imported_at").orderBy(F.desc("imported_at"), "asset_id")


@_query("select asset_id from a where folder_id = 14 and taken_at >= 1500000000 and taken_at <= 1700000000 and kind = 'photo'")
def filtered_assets(m: Media) -> DataFrame:
    return m.some("folder_id", "taken_at", "kind").where(A.search_filter(14, 1_500_000_000, 1_700_000_000, "photo")).select("asset_id")


@_query("select sha256, count(*) n from a where status = 'ready' and (folder_id, sha256) in (select (folder_id, sha256) from arrivals) group by sha256")
def ready_content_present(m: Media) -> DataFrame:
    asked = m.raw("arrivals").select("folder_id", "sha256").distinct()
    return m.some("status", "folder_id", "sha256").where("status = 'ready'").join(asked, ["folder_id", "sha256"], "left_semi").groupBy("sha256").agg(F.count("*").alias("n"))


# Folders, counts, queues


@_query("select f.folder_id, f.path, f.status, count(a.asset_id) asset_count from folders f left join a on a.folder_id = f.folder_id group by all")
def folder_asset_counts(m: Media) -> DataFrame:
    return A.folder_counts(m.folders, m.some("folder_id")).select("folder_id", "path", "status", "asset_count")


@_query("select folder_id from folders where status = 'online' and path <> ''")
def watched_folders(m: Media) -> DataFrame:
    return A.watched_folders(m.folders).select("folder_id")


@_query("""select distinct p.storage_key path, (select arg_max(f.folder_id, length(f.path)) from folders f where rtrim(f.path, '/\\') <> ''
 and (starts_with(p.storage_key, rtrim(f.path, '/\\') || '/') or starts_with(p.storage_key, rtrim(f.path, '/\\') || '\\'))) folder_id from assets p where p.storage_key is not null""")
def owner_of_path(m: Media) -> DataFrame:
    return A.owner_of_path(m.raw("assets").select(F.col("storage_key").alias("path")), m.folders)


@_query("""select folder_id, 'watch' change from (select folder_id from online except select folder_id from a) union all select folder_id, 'unwatch' from (select folder_id from a where folder_id is not null except select folder_id from online)""")
def folder_set_diff(m: Media) -> DataFrame:
    return A.folder_changes(m.some("folder_id").where("folder_id is not null"), m.folders.where("status = 'online'"))


@_query("select count(*) assets, count(*) filter (where status = 'ready') ready, count(*) filter (where status = 'failed') failed from a")
def asset_counts(m: Media) -> DataFrame:
    return m.some("status").agg(F.count("*").alias("assets"), F.count_if(F.col("status") == "ready").alias("ready"), F.count_if(F.col("status") == "failed").alias("failed"))


@_query("select folder_id, count(*) total, count(v1.asset_id) done from a left join v1 using (asset_id) where status = 'ready' and folder_id is not null group by folder_id")
def folder_embed_status(m: Media) -> DataFrame:
    return A.embedding_progress(m.some("status", "folder_id"), m.vector_ids)


@_query("select folder_id, count(*) pending from a where status = 'ready' and folder_id in (select * from online) and asset_id not in (select asset_id from v1) group by folder_id")
def folder_pending_index(m: Media) -> DataFrame:
    return A.pending_embeddings(m.some("folder_id", "status", "year", "sha256"), m.folders, m.vector_ids).groupBy("folder_id").agg(F.count("*").alias("pending"))


@_query("select asset_id, year, sha256 from a where status = 'ready' and folder_id in (select * from online) and asset_id not in (select asset_id from v1)")
def pending_embeddings(m: Media) -> DataFrame:
    return A.pending_embeddings(m.some("folder_id", "status", "year", "sha256"), m.folders, m.vector_ids).select("asset_id", "year", "sha256")


@_query("select asset_id from a where status = 'ready' and folder_id in (select * from online) and asset_id not in (select asset_id from v1) order by asset_id limit 32")
def pending_queue_head(m: Media) -> DataFrame:
    return A.queue(A.pending_embeddings(m.some("folder_id", "status", "year", "sha256"), m.folders, m.vector_ids), 32, "asset_id").select("asset_id")


@_query("select asset_id, taken_at from a where status = 'ready' and kind = 'photo' and folder_id in (select * from online) and not exists (select 1 from r where r.asset_id = a.asset_id)")
def pending_regions(m: Media) -> DataFrame:
    return A.pending_regions(m.some("folder_id", "status", "kind", "storage_key", "taken_at"), m.folders, m.raw("regions")).select("asset_id", "taken_at")


@_query("""select sum(n) pending from (select count(*) n from a where status = 'ready' and folder_id in (select * from online) and asset_id not in (select asset_id from v1)
 union all select count(*) from a where status = 'ready' and folder_id in (select * from online) and asset_id not in (select asset_id from v2))""")
def pending_indexing_total(m: Media) -> DataFrame:
    return A.pending_total(m.some("folder_id", "status"), m.folders, m.active, m.members)


@_query("select a.asset_id, count(distinct index_id) = 2 indexed from a left join m on m.asset_id = a.asset_id group by a.asset_id")
def indexed_flags(m: Media) -> DataFrame:
    return A.indexed_flags(m.some("status"), m.members, m.active)


@_query("select asset_id from (select asset_id from v1 intersect select asset_id from v2)")
def embedded_in_all(m: Media) -> DataFrame:
    return m.vector_ids.intersect(m.prefix_ids)


@_query("select index_id, slug, dim from idx where status = 'active'")
def index_registry_active(m: Media) -> DataFrame:
    return m.active.select("index_id", "slug", "dim").orderBy("index_id")


@_query("select idx.index_id, count(m.asset_id) n, count(m.asset_id) * dim * 4 bytes from idx left join m using (index_id) where status = 'active' group by idx.index_id, dim")
def storage_usage_per_index(m: Media) -> DataFrame:
    return A.storage_usage(m.active, m.members)


@_query("select sum(n) bytes from (select count(*) * dim * 4 n from m join idx using (index_id) where status = 'active' group by dim)")
def storage_usage_total(m: Media) -> DataFrame:
    return A.storage_usage(m.active, m.members).agg(F.sum("bytes").alias("bytes"))


@_query("select count(*) n_rows, count(*) filter (where region_idx >= 0) real_regions, count(*) filter (where region_idx = -1) sentinels from r")
def region_counts(m: Media) -> DataFrame:
    return m.region("region_idx").agg(F.count("*").alias("n_rows"), F.count_if(F.col("region_idx") >= 0).alias("real_regions"), F.count_if(F.col("region_idx") == -1).alias("sentinels"))


@_query("select asset_id from a where status = 'ready' and folder_id in (select * from online) and asset_id not in (select asset_id from v1) and asset_id not in (select asset_id from a where error_code is not null)")
def cooldown_filter(m: Media) -> DataFrame:
    resting = m.some("error_code").where("error_code is not null").select("asset_id")
    return A.pending_embeddings(m.some("folder_id", "status", "year", "sha256"), m.folders, m.vector_ids).join(resting, "asset_id", "left_anti").select("asset_id")


@_query("select asset_id from arrivals x where not exists (select 1 from a where a.status = 'ready' and a.storage_key = x.storage_key and a.size = x.size and a.folder_id = x.folder_id)")
def incremental_precheck(m: Media) -> DataFrame:
    found = m.raw("arrivals").select("asset_id", "folder_id", F.col("storage_key").alias("path"), F.col("size").alias("length"))
    return files.precheck(found, m.some("folder_id", "status", "size", "storage_key")).select("asset_id")


# Contents


@_query("""select distinct x.folder_id, x.sha256, x.storage_key, (exists (select 1 from a where a.folder_id = x.folder_id and a.sha256 = x.sha256)
  or x.storage_key <> min(x.storage_key) over (partition by x.folder_id, x.sha256)) duplicated from arrivals x where x.folder_id is not null and x.sha256 is not null""")
def insert_outcomes(m: Media) -> DataFrame:
    rows = m.raw("arrivals").where("folder_id is not null and sha256 is not null").select("folder_id", "sha256", "storage_key").distinct()
    return L.insert_outcomes(rows, m.some("folder_id", "sha256"))


@_query("select sha256, count(distinct folder_id) folders from a where folder_id is not null group by sha256 having count(distinct folder_id) > 1")
def duplicates_across_folders(m: Media) -> DataFrame:
    return m.some("folder_id", "sha256").where("folder_id is not null").groupBy("sha256").agg(F.countDistinct("folder_id").alias("folders")).where("folders > 1")


@_query("select folder_id, sha256, min(asset_id) asset_id, count(*) n from a where folder_id is not null group by folder_id, sha256")
def dedup_within_folder(m: Media) -> DataFrame:
    return m.some("folder_id", "sha256").where("folder_id is not null").groupBy("folder_id", "sha256").agg(F.min("asset_id").alias("asset_id"), F.count("*").alias("n"))


@_query("select x.asset_id, (select min(y.asset_id) from a y where y.sha256 = x.sha256 and y.asset_id in (select asset_id from v1)) source_id from a x where x.asset_id not in (select asset_id from v1) and exists (select 1 from a y where y.sha256 = x.sha256 and y.asset_id in (select asset_id from v1))")
def vector_copy_candidates(m: Media) -> DataFrame:
    return A.copy_candidates(m.some("sha256"), m.vector_ids)


@_query("select doc_id, sha256(text) as digest from documents where text is not null")
def content_hash(m: Media) -> DataFrame:
    return m.raw("documents").where("text is not null").select("doc_id", S.content_hash(F.col("text")).alias("digest"))


@_query("select asset_id, sha256('failed:' || storage_key) as digest from a where status = 'failed'")
def placeholder_hash(m: Media) -> DataFrame:
    return m.some("status", "storage_key").where("status = 'failed'").select("asset_id", S.placeholder_hash(F.col("storage_key")).alias("digest"))


@_query("select asset_id, thumb_key, substr(sha256, 1, 2) || '/' || sha256 || '.jpg' as expected from a where status = 'ready'")
def thumb_key(m: Media) -> DataFrame:
    return L.thumb_keys_expected(m.some("status", "thumb_key", "sha256"))


@_query("""select asset_id, case when greatest(width, height) > 384 then greatest(round(width * (384.0::double / greatest(width, height))), 1)::int else width end w,
  case when greatest(width, height) > 384 then greatest(round(height * (384.0::double / greatest(width, height))), 1)::int else height end h from a where width is not null and height is not null""")
def thumb_fit(m: Media) -> DataFrame:
    w, h = S.fit_within(F.col("width"), F.col("height"))
    return m.some("width", "height").where("width is not null and height is not null").select("asset_id", w.alias("w"), h.alias("h"))


@_query("select asset_id, name, content stem from base join txt using (asset_id)")
def basename_stem(m: Media) -> DataFrame:
    return m.some("storage_key").select("asset_id", S.basename(F.col("storage_key")).alias("name"), S.stem(F.col("storage_key")).alias("stem"))


@_query("select asset_id, year(to_timestamp(coalesce(taken_at, 0)) at time zone 'UTC')::varchar as of_time, year from a")
def year_of(m: Media) -> DataFrame:
    return m.some("taken_at", "year").select("asset_id", S.year_of(F.col("taken_at")).alias("of_time"), "year")


@_query("""select asset_id, epoch(strptime(t, '%Y%m%d_%H%M%S'))::bigint as seconds from (select asset_id, regexp_extract(name, '(20[0-9]{6}_[0-9]{6})', 1) t from base)
 where t <> '' and try_strptime(t, '%Y%m%d_%H%M%S') is not null""")
def filename_time(m: Media) -> DataFrame:
    return m.some("storage_key").select("asset_id", S.filename_seconds(F.col("storage_key")).alias("seconds")).where("seconds is not null")


@_query("""select asset_id, try_cast(json_extract_string(j, '$.taken_at') as bigint) exif_taken, case when try_cast(json_extract_string(j, '$.orientation') as int) between 1 and 8 then try_cast(json_extract_string(j, '$.orientation') as int) end orientation
 from (select asset_id, exif j from a where exif is not null and json_valid(exif))""")
def exif_fields(m: Media) -> DataFrame:
    t, o = S.exif_fields(F.col("exif"))
    return m.some("exif").where("exif is not null and try_parse_json(exif) is not null").select("asset_id", t.alias("exif_taken"), o.alias("orientation"))


@_query("select asset_id, regexp_matches(thumb_key, '^[A-Za-z0-9._/-]+$') and not starts_with(thumb_key, '/') and not contains(thumb_key, '..') valid from a where thumb_key is not null")
def valid_object_keys(m: Media) -> DataFrame:
    return m.some("thumb_key").where("thumb_key is not null").select("asset_id", S.valid_object_key(F.col("thumb_key")).alias("valid"))


@_query("""select folder_id, case when done > 0 and done < total then floor(600.0::double * (total - done) / done)::bigint end eta
 from (select folder_id, count(*) total, count(v1.asset_id) done from a left join v1 using (asset_id) where status = 'ready' and folder_id is not null group by folder_id)""")
def import_eta(m: Media) -> DataFrame:
    rows = A.embedding_progress(m.some("status", "folder_id"), m.vector_ids)
    return rows.select("folder_id", S.eta_seconds(F.lit(600.0), F.col("done"), F.col("total")).alias("eta"))


# Changes


def _gone(m: Media) -> DataFrame:
    """Assets of offline and missing folders, as a list to delete."""
    return m.some("folder_id").join(m.folders.where("status <> 'online'").select("folder_id"), "folder_id", "left_semi").select("asset_id")


_GONE = "gone as (select asset_id from a where folder_id in (select folder_id from folders where status <> 'online'))"


@_query(f", {_GONE} select thumb_key from a where thumb_key is not null group by thumb_key having count(*) filter (where asset_id not in (select * from gone)) = 0")
def thumb_refcounts_after_delete(m: Media) -> DataFrame:
    return L.delete_assets({"assets": m.some("thumb_key")}, _gone(m))[1]


@_query(f""", {_GONE} select 'assets' name, count(*) n from a where asset_id not in (select * from gone) union all select 'vectors', count(*) from v1 where asset_id not in (select * from gone)
 union all select 'regions', count(*) from r where asset_id is null or asset_id not in (select * from gone)
 union all select 'vec_regions', count(*) from vr where region_id not in (select region_id from r where asset_id in (select * from gone))""")
def delete_assets_report(m: Media) -> DataFrame:
    left, _ = L.delete_assets({"assets": m.some("thumb_key"), "vectors": m.vector_ids, "regions": m.region("asset_id"), "vec_regions": m.region_ids}, _gone(m))
    out = None
    for name, df in left.items():
        part = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@_query("select count(distinct x.asset_id) filter (where a.asset_id is not null) deleted, count(*) - count(distinct x.asset_id) filter (where a.asset_id is not null) missing from (select asset_id from regions where asset_id is not null) x left join a using (asset_id)")
def delete_report(m: Media) -> DataFrame:
    return L.delete_report(m.some("status"), m.raw("regions").where("asset_id is not null").select("asset_id"))


@_query(f"select folder_id, count(*) n from a where folder_id is null or folder_id <> {FOLDER} group by folder_id")
def delete_folder_remaining(m: Media) -> DataFrame:
    rows = m.some("folder_id", "thumb_key")
    return L.delete_assets({"assets": rows}, rows.where(F.col("folder_id") == FOLDER).select("asset_id"))[0]["assets"].groupBy("folder_id").agg(F.count("*").alias("n"))


@_query(f"select asset_id, case when starts_with(storage_key, '/vault/') then '/archive/' || storage_key[8:] else storage_key end storage_key from a where folder_id = {FOLDER}")
def relocate_folder_keys(m: Media) -> DataFrame:
    return L.relocate(m.some("folder_id", "storage_key"), FOLDER, "/vault/", "/archive/").where(F.col("folder_id") == FOLDER).select("asset_id", "storage_key")


@_query("select case when status = 'failed' then 'pending' else status end status, count(*) n, count(case when status = 'failed' then null else error_code end) errors from a group by 1")
def reset_failed(m: Media) -> DataFrame:
    return L.reset_failed(m.some("status", "error_code")).groupBy("status").agg(F.count("*").alias("n"), F.count("error_code").alias("errors"))


@_query("select case when asset_id in (select asset_id from v1) and status = 'pending' then 'ready' else status end status, count(*) n from a group by 1")
def status_lifecycle_counts(m: Media) -> DataFrame:
    rows = m.some("status")
    ids = rows.where("status = 'pending'").join(m.vector_ids, "asset_id", "left_semi").select("asset_id")
    return L.set_state(rows, ids, status="ready").groupBy("status").agg(F.count("*").alias("n"))


@_query("select asset_id from v1 where asset_id not in (select asset_id from a where status = 'failed')")
def vectors_cleared(m: Media) -> DataFrame:
    return m.vector_ids.join(m.some("status").where("status = 'failed'").select("asset_id"), "asset_id", "left_anti").select("asset_id")


@_query("select count(*) n from (select asset_id from v1 union select asset_id from arrivals where len(embedding) = 64 and len(list_filter(embedding, lambda x: isfinite(x))) = 64 and list_max(list_transform(embedding, lambda x: abs(x))) > 0)")
def vector_upsert_count(m: Media) -> DataFrame:
    fresh = knn.vector_keys(m.raw("arrivals"), "asset_id", DIM)
    return L.upsert(m.vector_ids, fresh, "asset_id").agg(F.count("*").alias("n"))


@_query("select folder_id, case when bool_and(present) is null then status when bool_and(present) then 'online' else 'offline' end status from (select f.folder_id, f.status, a.size is not null present, a.asset_id from folders f left join a on a.folder_id = f.folder_id) where true group by folder_id, status having count(asset_id) > 0 union all select folder_id, status from folders where folder_id not in (select folder_id from a where folder_id is not null)")
def folder_status_after_look(m: Media) -> DataFrame:
    present = m.some("folder_id", "size").where("folder_id is not null").select("folder_id", F.col("size").isNotNull().alias("exists"))
    return L.folder_status(m.folders, present)


# Vectors


@_query("select asset_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) norm from v1")
def vector_normalize_norms(m: Media) -> DataFrame:
    return m.once.select("asset_id", F.round(S.norm(F.col("v")), 6).alias("norm"))


@_query("select region_id, list_sum(list_transform(v, lambda x: greatest(least(round(x * 127), 127), -128)::int))::bigint total from vr")
def vector_quantize_roundtrip(m: Media) -> DataFrame:
    return m.regions_once.select("region_id", F.aggregate(S.quantise(F.col("v")), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@_query("select asset_id, round(list_distance(v, (select v from q1)), 6) dist from v1 order by list_distance(v, (select v from q1)), asset_id limit 10")
def knn_top10(m: Media) -> DataFrame:
    return m.near(knn.Asked(1, m.query(), 10)).select("asset_id", F.round("dist", 6).alias("dist"))


@_query("select asset_id, round(list_distance(v, (select v from q1)), 6) dist from v1 order by list_distance(v, (select v from q1)), asset_id limit 10")
def knn_top10_hof(m: Media) -> DataFrame:
    return knn.knn(m.vectors, "asset_id", m.query(), 10, plan="hof").select("asset_id", F.round("dist", 6).alias("dist"))


@_query(f"""select * from (select 1 index_id, asset_id, round(list_distance(v, (select v from q1)), 6) dist from v1 order by list_distance(v, (select v from q1)), asset_id limit {K})
 union all select * from (select 2, asset_id, round(list_distance(v, (select v from q2)), 6) from v2 order by list_distance(v, (select v from q2)), asset_id limit {K})""")
def knn_per_index(m: Media) -> DataFrame:
    near = m.near(*[knn.Asked(i, m.query(i), K) for i in (1, 2)])
    return near.select(F.col("stream").alias("index_id"), "asset_id", F.round("dist", 6).alias("dist"))


@_query(f"select t.asset_id from (select asset_id from v1 order by list_distance(v, (select v from q1)), asset_id limit {K}) t join a using (asset_id) where a.kind = 'photo' and a.taken_at >= 1500000000")
def knn_filtered_post(m: Media) -> DataFrame:
    near = m.near(knn.Asked(1, m.query(), K))
    return near.join(m.some("taken_at", "kind").where(A.search_filter(taken_from=1_500_000_000, kind="photo")).select("asset_id"), "asset_id", "left_semi").select("asset_id")


@_query(f"select t.asset_id from (select asset_id from v1 order by list_distance(v, (select v from q1)), asset_id limit {3 * K}) t join a using (asset_id) where a.folder_id = {FOLDER}")
def knn_filtered_oversample(m: Media) -> DataFrame:
    near = m.near(knn.Asked(1, m.query(), 3 * K))
    return near.join(m.some("folder_id").where(A.search_filter(FOLDER)).select("asset_id"), "asset_id", "left_semi").select("asset_id")


@_query(f"""select asset_id, round(min(d), 6) dist from (select region_id, list_distance(v, (select v from q1)) d from vr order by d, region_id limit {3 * K}) join (select distinct region_id, asset_id from r) using (region_id) group by asset_id""")
def region_maxsim_top(m: Media) -> DataFrame:
    return knn.owners_of(m.near_regions(m.query(), 3 * K), m.raw("regions")).select("asset_id", F.round("dist", 6).alias("dist"))


@_query("""select asset_id, round(list_distance(v1.v, (select v from q1)), 6) dist from v1 where asset_id in (select asset_id from v2 order by list_distance(v, (select v from q2)), asset_id limit 200)
 order by list_distance(v1.v, (select v from q1)), asset_id limit 10""")
def knn_cascade(m: Media) -> DataFrame:
    return knn.cascade(m.prefixes, m.vectors, "asset_id", m.query(2), m.query(), 200, 10).select("asset_id", F.round("dist", 6).alias("dist"))


_ANCHORS = "anchors as (select cluster_id anchor, arg_min(v, region_id) av from vr join r using (region_id) where cluster_id is not null group by cluster_id)"
_NEAREST = "near as (select asset_id, arg_min(anchor, (-s, anchor)) anchor, max(s) sim from (select asset_id, anchor, list_dot_product(v, av) s from v1, anchors) group by asset_id)"


def _anchors(m: Media) -> DataFrame:
    """(anchor, v): the vector of the smallest region of each cluster."""
    named = m.region_vectors.join(m.region("cluster_id").where("cluster_id is not null"), "region_id")
    return named.groupBy(F.col("cluster_id").alias("anchor")).agg(F.min_by("v", "region_id").alias("v"))


@_query(f", {_ANCHORS}, {_NEAREST} select asset_id, anchor, round(sim, 6) sim from near")
def nearest_anchor_assignment(m: Media) -> DataFrame:
    return knn.nearest_anchor(m.once, "asset_id", _anchors(m)).select("asset_id", "anchor", F.round("sim", 6).alias("sim"))


@_query(f", {_ANCHORS}, {_NEAREST} select anchor, count(*) n from near group by anchor")
def anchor_sizes(m: Media) -> DataFrame:
    return knn.nearest_anchor(m.once, "asset_id", _anchors(m)).groupBy("anchor").agg(F.count("*").alias("n"))


@_query(f", {_ANCHORS}, {_NEAREST} select anchor, asset_id, row_number() over (partition by anchor order by round(sim, 6) desc, asset_id) \"rank\" from near qualify \"rank\" <= 3")
def topm_per_anchor(m: Media) -> DataFrame:
    near = knn.nearest_anchor(m.once, "asset_id", _anchors(m)).select("asset_id", "anchor", F.round("sim", 6).alias("sim"))
    return M.top_per_group(near, "anchor", 3, F.desc("sim"), "asset_id").select("anchor", "asset_id", "rank")


@_query("""select asset_id, round(max(list_dot_product(v, (select v from q1))) + max(list_dot_product(v, (select list_transform(v, lambda x: -x) from q1))), 6) score
 from vr join (select distinct region_id, asset_id from r) using (region_id) group by asset_id""")
def patch_maxsim(m: Media) -> DataFrame:
    q = m.query()
    patches = m.region_vectors.join(m.region("asset_id"), "region_id").select("asset_id", "v")
    return knn.patch_maxsim(patches, [q, [-x for x in q]]).select("asset_id", F.round("score", 6).alias("score"))


# Full text and fusion


def _bm25_sql(table: str, key: str, content: str, terms: list[str]) -> str:
    """SQL of the ranking: every place of every term is looked at."""
    quoted = [t.replace("'", "''") for t in terms]
    occ = ", ".join(f"len(list_filter(range(1, len(c) - {len(t) - 2}), lambda i: c[i:i + {len(t) - 1}] = '{q}')) f{i}" for i, (t, q) in enumerate(zip(terms, quoted)))
    names = [f"f{i}" for i in range(len(terms))]
    idf = lambda f: f"(select case when count(*) - count(*) filter (where {f} > 0) > count(*) filter (where {f} > 0) then ln((count(*) - count(*) filter (where {f} > 0) + 0.5) / (count(*) filter (where {f} > 0) + 0.5)) else 1e-6 end from occ)"
    score = " + ".join(f"{idf(f)} * {f} * 2.2 / ({f} + 1.2 * (0.25 + 0.75 * dl / (select avg(dl) from occ)))" for f in names)
    return f"""occ as (select {key}, greatest(len(c) - 2, 0)::double dl, {occ} from (select {key}, lower(coalesce({content}, '')) c from {table})),
 hits as (select {key}, round(-({score}), 6) as "rank" from occ where {' and '.join(f'{f} > 0' for f in names)})"""


@_query("select asset_id from txt where contains(lower(content), 'img_2021')")
def fts_single_term(m: Media) -> DataFrame:
    return m.text.where(fts.occurrences(F.col("content"), "img_2021") > 0).select("asset_id")


@_query(", " + _bm25_sql("txt", "asset_id", "content", ["img_", "_12"]) + ' select asset_id, "rank" from hits order by "rank", asset_id limit 1000')
def fts_and_terms(m: Media) -> DataFrame:
    return fts.search_scan(m.text, 'IMG_ "_12"', 1_000).select("asset_id", F.round("rank", 6).alias("rank"))


@_query(", " + _bm25_sql("txt", "asset_id", "content", ["2022"]) + ' select asset_id, "rank" from hits order by "rank", asset_id limit 1000')
def fts_short_term_ignored(m: Media) -> DataFrame:
    return fts.search_scan(m.text, "mg 2022", 1_000).select("asset_id", F.round("rank", 6).alias("rank"))


@_query("select asset_id from txt where false")
def fts_short_only_empty(m: Media) -> DataFrame:
    return fts.search_scan(m.text, "mg", 1_000).select("asset_id")


@_query(", " + _bm25_sql("documents", "doc_id", "text", ["lantern", "merge"]) + ' select doc_id, "rank" from hits order by "rank", doc_id limit 100')
def fts_bm25_rank(m: Media) -> DataFrame:
    return fts.search_scan(m.raw("documents"), "lantern merge", 100, "doc_id", "text").select("doc_id", F.round("rank", 6).alias("rank"))


@_query(", " + _bm25_sql("txt", "asset_id", "content", ["img_2022"]) + ' select asset_id, "rank" from hits order by "rank", asset_id limit 1000')
def fts_postings(m: Media) -> DataFrame:
    return fts.Postings(m.text).search("IMG_2022", 1_000).select("asset_id", F.round("rank", 6).alias("rank"))


def _streams(m: Media) -> list[DataFrame]:
    """Two lists of assets: nearest by vector, newest."""
    one = m.near(knn.Asked(1, m.query(), K)).drop("stream")
    two = A.timeline_page(m.states("taken_at"), None, K).select("asset_id", (-F.col("taken_at")).alias("t"), (-F.col("asset_id")).alias("i"))
    return [fusion.stream(one, 1, True, "dist", "asset_id"), fusion.stream(two, 2, False, "t", "i")]


_STREAMS = f"""s1 as (select 1 stream, true sem, row_number() over (order by list_distance(v, (select v from q1)), asset_id) p, asset_id id from v1 qualify p <= {K}),
 s2 as (select 2 stream, false sem, row_number() over (order by coalesce(taken_at, 0) desc, asset_id desc) p, asset_id id from a qualify p <= {K}),
 s3 as (select 3 stream, true sem, row_number() over (order by list_distance(v, (select v from q2)), asset_id) p, asset_id id from v2 qualify p <= {K})"""
_FUSED = "select id, round(sum(1 / (60.0::double + p)), 9) score, case when bool_or(sem) and bool_or(not sem) then 'both' when bool_or(sem) then 'semantic' else 'text' end matched from s group by id"


@_query(f", {_STREAMS}, s as (select * from s1 union all select * from s2) {_FUSED}")
def rrf_two_stream(m: Media) -> DataFrame:
    return fusion.rrf(_streams(m)).select("id", F.round("score", 9).alias("score"), "matched")


@_query(f", {_STREAMS}, s as (select * from s1 union all select * from s2 union all select * from s3) {_FUSED}")
def rrf_multi_stream(m: Media) -> DataFrame:
    third = fusion.stream(m.near(knn.Asked(3, m.query(2), K)).drop("stream"), 3, True, "dist", "asset_id")
    return fusion.rrf([*_streams(m), third], 0).select("id", F.round("score", 9).alias("score"), "matched")


@_query("""select id, round(sum(1 / (60.0::double + p)), 9) score from (select 1 stream, id, min(p) p from (select asset_id id, row_number() over (order by region_id) p from r where asset_id is not null qualify p <= 200) group by id) group by id""")
def rrf_duplicate_positions(m: Media) -> DataFrame:
    rows = m.region("asset_id").where("asset_id is not null").select("asset_id", "region_id").orderBy("region_id").limit(200)
    return fusion.rrf([fusion.stream(rows, 1, True, "region_id")]).select("id", F.round("score", 9).alias("score"))


def _library(m: Media) -> search.Library:
    vectors = m.raw("vec_assets")
    indexes = {1: search.Index(vectors, DIM), 2: search.Index(vectors, DIM, PREFIX)}
    return search.Library(m.states("folder_id", "taken_at", "kind", "storage_key", "size"), m.folders, indexes, m.raw("regions"), search.Index(m.raw("vec_regions"), DIM), m.text)


def _search_sql(where: str = "true", wide: int = K) -> str:
    near = lambda n: f"select * from (select asset_id, list_distance(v, (select v from q{n})) d from v{n} order by d, asset_id limit {wide}) join ok using (asset_id)"
    rank = "row_number() over (order by d, asset_id) p"
    return f""", ok as (select asset_id from a where {where}), n1 as ({near(1)}), n2 as ({near(2)}),
 n3 as (select * from (select asset_id, min(d) d from (select region_id, list_distance(v, (select v from q1)) d from vr order by d, region_id limit {3 * wide}) join (select distinct region_id, asset_id from r) using (region_id) group by asset_id) join ok using (asset_id)),
 {_bm25_sql("txt", "asset_id", "content", fts.usable_terms(TEXT))},
 n4 as (select * from (select asset_id, "rank" d from hits order by "rank", asset_id limit {K}) join ok using (asset_id)),
 s as (select true sem, {rank}, asset_id id from n1 union all select true, {rank}, asset_id from n2 union all select true, {rank}, asset_id from n3 union all select false, {rank}, asset_id from n4),
 fused as ({_FUSED.replace('round(sum(1 / (60.0::double + p)), 9)', 'sum(1 / (60.0::double + p))')}),
 simil as (select asset_id id, arg_max(x, i) similarity from (select asset_id, greatest(least(1 - d * d / 2, 1), 0) x, 1 i from n1 union all select asset_id, greatest(least(1 - d * d / 2, 1), 0), 2 from n2) group by asset_id)
 select a.asset_id, round(score / (select greatest(max(score), 1e-9) from fused), 3) score, round(similarity, 6) similarity, matched, base.name file_name, coalesce(f.label, f.path, '') folder_label, coalesce(a.size, 0) size_bytes
 from fused join a on a.asset_id = fused.id join base on base.asset_id = fused.id left join simil on simil.id = fused.id left join folders f on f.folder_id = a.folder_id"""


def _shown(page: DataFrame) -> DataFrame:
    return page.select("asset_id", "score", F.round("similarity", 6).alias("similarity"), "matched", "file_name", "folder_label", "size_bytes")


@_query(_search_sql())
def hybrid_search(m: Media) -> DataFrame:
    return _shown(search.hybrid_search(_library(m), TEXT, {1: m.query(1), 2: m.query(2)}, K))


@_query(_search_sql(f"folder_id = {FOLDER} and coalesce(taken_at, 0) >= 1500000000 and kind = 'photo'", 3 * K))
def hybrid_search_filtered(m: Media) -> DataFrame:
    return _shown(search.hybrid_search(_library(m), TEXT, {1: m.query(1), 2: m.query(2)}, K, search.Filters(FOLDER, 1_500_000_000, None, "photo")))


# Time, place, clusters

_PHOTOS = "photos as (select asset_id, taken_at, gps_lat, gps_lng from a where taken_at is not null)"
_GAPS = f"{_PHOTOS}, gaps as (select *, lag(taken_at) over w prev, lag(gps_lat) over w plat, lag(gps_lng) over w plng from photos window w as (order by taken_at, asset_id))"


@_query(f", {_GAPS} select asset_id, taken_at - prev gap, case when prev is null or taken_at - prev > 604800 then 1.4 when taken_at - prev < 300 then 0.5 else 1.0 end::double factor from gaps")
def burst_tau_modulation(m: Media) -> DataFrame:
    gap = F.col("taken_at") - F.col("previous")
    return R.previous_times(m.some("taken_at")).select("asset_id", gap.alias("gap"), R.time_factor(gap).alias("factor"))


@_query(f", {_GAPS}, c as (select *, sum(case when taken_at - prev <= 2592000 then 0 else 1 end) over (order by taken_at, asset_id rows unbounded preceding) - 1 chapter_id from gaps) select chapter_id::bigint chapter_id, min(taken_at) started_at, max(taken_at) ended_at, count(*) n from c group by 1")
def chapter_segments(m: Media) -> DataFrame:
    return R.chapters(m.some("taken_at"))


_KM = "2 * 6371.0::double * asin(sqrt(least(1, pow(sin(radians(gps_lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(gps_lat)) * pow(sin(radians(gps_lng - plng) / 2), 2))))"
_KNOWN = "gps_lat is not null and plat is not null and gps_lng is not null and plng is not null and not isnan(gps_lat) and not isnan(plat) and not isnan(gps_lng) and not isnan(plng)"


@_query(f", {_GAPS}, k as (select asset_id, (taken_at - prev) / 60.0::double dt, case when {_KNOWN} then {_KM} end km from gaps) select asset_id, round(km, 6) km, case when dt is null then 1.0 when km is null then case when dt < 5 then 0.5 else 1.0 end when km < 0.2 and dt < 5 then 0.5 when km < 0.2 then 0.9 when km >= 1 and dt < 120 then 1.3 else 1.0 end::double factor from k")
def haversine_gps(m: Media) -> DataFrame:
    rows = R.previous_times(m.some("taken_at", "gps_lat", "gps_lng"), carry=("gps_lat", "gps_lng"))
    km = S.haversine_km(F.col("previous_gps_lat"), F.col("previous_gps_lng"), F.col("gps_lat"), F.col("gps_lng"))
    minutes = (F.col("taken_at") - F.col("previous")) / 60.0
    return rows.select("asset_id", F.round(km, 6).alias("km"), R.place_factor(minutes, km).alias("factor"))


_BOXES = """bx as (select region_id, asset_id, region_idx, area_frac, least(bbox_x0, bbox_x1) x0, least(bbox_y0, bbox_y1) y0, greatest(bbox_x0, bbox_x1) x1, greatest(bbox_y0, bbox_y1) y1 from r
 where region_idx >= 0 and bbox_x0 is not null and bbox_y0 is not null and bbox_x1 is not null and bbox_y1 is not null), bb as (select * from bx where x1 > x0 and y1 > y0)"""


@_query(f""", {_BOXES}, p as (select l.region_id a, h.region_id b, (least(l.x1, h.x1) - greatest(l.x0, h.x0))::double * (least(l.y1, h.y1) - greatest(l.y0, h.y0)) i, (l.x1 - l.x0)::double * (l.y1 - l.y0) al, (h.x1 - h.x0)::double * (h.y1 - h.y0) ah
 from bb l join bb h on l.asset_id = h.asset_id and l.region_id < h.region_id and l.x0 < h.x1 and h.x0 < l.x1 and l.y0 < h.y1 and h.y0 < l.y1) select a, b, round(i / (al + ah - i), 6) iou from p""")
def box_iou_pairs(m: Media) -> DataFrame:
    return R.box_overlaps(R.boxes(m.regions)).select("a", "b", F.round("iou", 6).alias("iou"))


@_query(f""", {_BOXES}, f as (select *, row_number() over (partition by asset_id order by region_idx, region_id) rn from bb where x1 - x0 >= 24 and y1 - y0 >= 24 and area_frac between 0.0008 and 0.85),
 steps as (with recursive k(asset_id, i, kept, region_id, keep) as (select asset_id, 0::bigint, []::struct(x0 int, y0 int, x1 int, y1 int)[], null::bigint, false from f where rn = 1
  union all select asset_id, i + 1, case when ok then list_append(kept, b) else kept end, region_id, ok from (select k.asset_id, k.i, k.kept, f.region_id, {{'x0': f.x0, 'y0': f.y0, 'x1': f.x1, 'y1': f.y1}} b,
   len(k.kept) < 24 and len(list_filter(k.kept, lambda o: greatest(least(o.x1, f.x1) - greatest(o.x0, f.x0), 0)::double * greatest(least(o.y1, f.y1) - greatest(o.y0, f.y0), 0) >
    0.85 * ((o.x1 - o.x0)::double * (o.y1 - o.y0) + (f.x1 - f.x0)::double * (f.y1 - f.y0) - greatest(least(o.x1, f.x1) - greatest(o.x0, f.x0), 0)::double * greatest(least(o.y1, f.y1) - greatest(o.y0, f.y0), 0)))) = 0 ok
   from k join f on f.asset_id is not distinct from k.asset_id and f.rn = k.i + 1)) select * from k)
 select asset_id, region_id from steps where keep""")
def box_suppression(m: Media) -> DataFrame:
    return R.kept_boxes(R.boxes(m.regions))


@_query("select count(*) n from vr where region_id not in (select region_id from r where region_idx = -1)")
def vectors_without_sentinels(m: Media) -> DataFrame:
    return R.without_sentinel_vectors(m.region_ids, m.region("region_idx")).agg(F.count("*").alias("n"))


def assigned(m: Media, timed: DataFrame) -> DataFrame:
    """DP-means over all region vectors in order of capture, chapter by chapter. ``timed``: (asset_id, taken_at, factor)."""
    timed = materialise(timed, "timed")  # read for the chapters and for the rows
    placed = R.with_chapter(timed, R.chapters(timed))
    real = m.region("asset_id", "region_idx").where("region_idx >= 0").join(m.regions_once, "region_id")
    rows = real.join(placed, "asset_id").withColumnRenamed("chapter_id", "scope")
    return R.dp_means(rows, "scope", ["taken_at", "asset_id", "region_idx", "region_id"], DIM)


def _assigned(m: Media) -> DataFrame:
    timed = R.previous_times(m.some("taken_at")).select("asset_id", "taken_at", R.time_factor(F.col("taken_at") - F.col("previous")).alias("factor"))
    return assigned(m, timed)


def dpmeans_sql() -> str:
    """SQL of the online clustering over ch (asset_id, taken_at, factor, scope). One step of the recursion takes the next row of every chapter at
    once; only the latest state of a chapter is kept."""
    return """, ordered as materialized (select scope::bigint scope, region_id, v, 0.24::double * factor tau, row_number() over (partition by scope order by taken_at, asset_id, region_idx, region_id) rn from r join vr using (region_id) join ch using (asset_id) where region_idx >= 0),
 state as (with recursive s(scope, i, protos, counts, ids) using key (scope) as (select scope, 0::bigint, []::double[][], []::bigint[], []::bigint[] from ordered where rn = 1
  union all select scope, i + 1, case when hit then list_transform(protos, lambda p, j: case when j = best then moved else p end) else list_append(protos, v) end,
   case when hit then list_transform(counts, lambda c, j: case when j = best then c + 1 else c end) else list_append(counts, 1) end, list_append(ids, case when hit then best - 1 else len(protos) end)
  from (select *, list_transform(raw, lambda x: x / sqrt(list_dot_product(raw, raw))) moved from (select *, case when hit then list_transform(protos[best], lambda x, j: (x * counts[best] + v[j]) / (counts[best] + 1)) else v end raw from
   (select *, list_position(d, list_min(d)) best, coalesce(list_min(d) <= tau, false) hit from (select s.*, o.v, o.tau, list_transform(s.protos, lambda p: 1 - list_dot_product(p, o.v)) d from s join ordered o on o.scope = s.scope and o.rn = s.i + 1))))) select * from s),
 base_ as (select scope, coalesce(sum(len(protos)) over (order by scope rows between unbounded preceding and 1 preceding), 0)::bigint first, ids from state),
 named as (select o.scope, o.region_id, (b.first + b.ids[o.rn])::bigint cluster_id from ordered o join base_ b using (scope))"""


_DPMEANS = f""", {_GAPS}, ch as (select asset_id, taken_at, case when prev is null or taken_at - prev > 604800 then 1.4 when taken_at - prev < 300 then 0.5 else 1.0 end::double factor,
  sum(case when taken_at - prev <= 2592000 then 0 else 1 end) over (order by taken_at, asset_id rows unbounded preceding) - 1 scope from gaps)""" + dpmeans_sql()


@_query(_DPMEANS + " select scope, region_id, cluster_id from named")
def dpmeans_assignments(m: Media) -> DataFrame:
    return R.global_ids(_assigned(m))


@_query(_DPMEANS + " select cluster_id, count(*) n from named group by cluster_id")
def dpmeans_cluster_sizes(m: Media) -> DataFrame:
    return R.global_ids(_assigned(m)).groupBy("cluster_id").agg(F.count("*").alias("n"))


_TABLE = "ct as (select chapter_id t, cluster_id p, count(*) n from r where chapter_id is not null and cluster_id is not null group by all)"


@_query(f""", {_TABLE}, tt as (select t, sum(n) nt from ct group by t), pp as (select p, sum(n) np from ct group by p), tot as (select sum(n)::double total from ct),
 mi as (select sum(n / total * ln(n * total / (nt * np))) mi from ct join tt using (t) join pp using (p), tot), ht as (select -sum(nt / total * ln(nt / total)) h from tt, tot), hp as (select -sum(np / total * ln(np / total)) h from pp, tot)
 select round(mi / ((ht.h + hp.h) / 2), 9) nmi from mi, ht, hp""")
def cluster_nmi(m: Media) -> DataFrame:
    return M.nmi(M.contingency(m.region("chapter_id", "cluster_id"), "chapter_id", "cluster_id")).select(F.round("nmi", 9).alias("nmi"))


@_query(f", {_TABLE} select round(sum(top) / sum(n), 9) purity from (select max(n) top, sum(n) n from ct group by p)")
def cluster_purity(m: Media) -> DataFrame:
    return M.purity(M.contingency(m.region("chapter_id", "cluster_id"), "chapter_id", "cluster_id")).select(F.round("purity", 9).alias("purity"))


@_query("select count(*) clusters, round(count(*) filter (where n = 1) / count(*), 9) singleton_rate, round(max(n) / sum(n), 9) top_share from (select count(*) n from r where cluster_id is not null group by cluster_id)")
def singleton_rate(m: Media) -> DataFrame:
    return M.size_profile(M.sizes(m.region("cluster_id"), "cluster_id")).select("clusters", F.round("singleton_rate", 9).alias("singleton_rate"), F.round("top_share", 9).alias("top_share"))


@_query("select share, v as value from (select 0.5::double share, quantile_disc(size, 0.5) v from a union all select 0.95, quantile_disc(size, 0.95) from a)")
def latency_percentiles(m: Media) -> DataFrame:
    return M.nearest_rank(m.some("size"), "size")


@_query("select round(xy / xx, 9) slope, round(sqrt(greatest(yy - xy / xx * xy, 0) / n), 3) rmse from (select sum(width::double * height) xy, sum(width::double * width) xx, sum(height::double * height) yy, count(*) n from a where width is not null and height is not null)")
def slope_through_origin(m: Media) -> DataFrame:
    rows = m.some("width", "height").select(F.col("width").cast("double").alias("w"), F.col("height").cast("double").alias("h"))
    return M.fit_through_origin(rows, "w", "h").select(F.round("slope", 9).alias("slope"), F.round("rmse", 3).alias("rmse"))


@_query()
def kmeans_clusters(m: Media) -> DataFrame:
    rows = m.regions_once
    return C.assigned(C.fitted(rows, "v", 32), rows, "region_id", "v").groupBy("cluster").agg(F.count("*").alias("n"))


@_query()
def pca_signature(m: Media) -> DataFrame:
    return C.signature(m.regions_once, "region_id", "v", DIM).select("region_id", F.transform("signature", lambda x: F.round(F.abs(x), 6)).alias("signature"))
