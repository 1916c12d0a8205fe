"""Queries of keeping a library: ids and folders, indexing and its queues, prototypes, quality of routing; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismara import schema
from prismara.functions import scalars as S
from prismara.media_queries import _BASE, _GAPS, _KM, _KNOWN, DIM, FOLDER, PREFIX, REGISTRY, Media, _bm25_sql, assigned, dpmeans_sql
from prismara.operators import assets as A
from prismara.operators import clusters as C
from prismara.operators import lifecycle as L
from prismara.operators import metrics as M
from prismara.operators import regions as R
from prismara.plans import fts, knn
from prismara.sources import files, objects
from prismara.sources.catalog import Catalog
from prismara.sources.ingest import ingest
from prismara.storage import table_path
from prismara.streaming import jobs

QUERIES, ORACLE = {}, {}
IDS = list(range(1, 9_000, 7))


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Media(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = _BASE + sql
        return f

    return add


# Ids, folders, files


@_query("select asset_id, kind from a where asset_id in (select unnest(range(1, 9000, 7)))")
def assets_by_ids(m: Media) -> DataFrame:
    return A.of_ids(m.some("kind"), IDS).select("asset_id", "kind")


@_query("select asset_id from v1 where asset_id in (select unnest(range(1, 9000, 70)))")
def embedded_of_list(m: Media) -> DataFrame:
    return A.of_ids(m.vector_ids, IDS[::10])


@_query("""select folder_id, sha256, storage_key, (select max(asset_id) from a) + row_number() over (order by storage_key, folder_id, sha256) asset_id
 from (select distinct folder_id, sha256, storage_key from arrivals where folder_id is not null and sha256 is not null and storage_key is not null)""")
def allocated_ids(m: Media) -> DataFrame:
    rows = m.raw("arrivals").where("folder_id is not null and sha256 is not null and storage_key is not null").select("folder_id", "sha256", "storage_key").distinct()
    return L.allocate(rows, m.some("status"), "asset_id", ["storage_key", "folder_id", "sha256"])


@_query("""select p.path, coalesce(f.folder_id, (select max(folder_id) from folders) + row_number() over (partition by f.folder_id is null order by p.path)) folder_id, f.folder_id is null created
 from (select path from folders where folder_id % 3 = 0 and path is not null union select distinct '/incoming/' || channel from folders where channel is not null) p left join folders f on f.path = p.path""")
def folder_get_or_create(m: Media) -> DataFrame:
    known = m.folders.where("folder_id % 3 = 0").select("path", "label")
    new = m.folders.select(F.concat(F.lit("/incoming/"), "channel").alias("path"), F.lit(None).cast("string").alias("label"))
    return L.folders_for(m.folders, known.unionByName(new), 1_760_000_000)[1]


@_query("""select asset_id, storage_key from (select asset_id, storage_key, name, lower(regexp_extract(name[2:], '\\.([^.]*)$', 1)) ext from base join a using (asset_id))
 where ext in ('jpg', 'jpeg', 'png', 'webp', 'heic', 'heif') and not starts_with(name, '.')""")
def scan_filter(m: Media) -> DataFrame:
    return m.some("storage_key").where(files.is_photo(F.col("storage_key"))).select("asset_id", "storage_key")


@_query("select slug, index_id, dim, status from idx union all select 'fresh-32', 4, 32, 'active'")
def index_registered(m: Media) -> DataFrame:
    rows = [(i, s, s, "default", d, f"vec_i{i}", status, 0) for i, s, d, status in REGISTRY]
    registry = m.spark.createDataFrame(rows, schema.SCHEMAS["index_meta"])
    once = L.register_index(registry, "fresh-32", "Fresh", "default", 32, 1)
    return L.register_index(once, "whole-64", "Again", "default", DIM, 2).select("slug", F.col("index_id").cast("int"), "dim", "status")


@_query("""select * from (values ('assets', (select count(*) from a)), ('folders', 1), ('vec_assets', 0), ('fts_text', 0), ('index_meta', 1), ('regions', 0), ('vec_regions', 0), ('region_chapters', 1), ('region_clusters', 0)) t(name, n)""")
def migration_report(m: Media) -> DataFrame:
    old = A.current(m.raw("assets")).select("asset_id", *[c.split()[0] for c in schema._ASSET_V1.split(", ")[1:]])
    tables, _ = schema.migrate(m.spark, {"assets": old}, 1)
    return _counts(tables)


def _counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        part = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@_query("""select asset_id, '{' || array_to_string(list_filter([case when taken_at is not null then '"taken_at":' || taken_at end, case when o is not null then '"orientation":' || o end], lambda x: x is not null), ',') || '}' exif
 from (select asset_id, taken_at, case when asset_id % 9 < 8 then asset_id % 9 + 1 end o from a) where taken_at is not null or o is not null""")
def exif_written(m: Media) -> DataFrame:
    o = F.when(F.col("asset_id") % 9 < 8, (F.col("asset_id") % 9 + 1).cast("int"))
    return m.some("taken_at").select("asset_id", S.exif_json(F.col("taken_at"), o).alias("exif")).where("exif is not null")


@_query("""select year, array_to_string(list(asset_id order by pos), ',') items from (select year, asset_id, row_number() over (order by coalesce(taken_at, 0) desc, asset_id desc) pos from a qualify pos <= 300) group by year""")
def timeline_year_items(m: Media) -> DataFrame:
    return A.year_groups(A.timeline_page(m.states("taken_at", "year"), None, 300)).select("year", F.array_join("items", ",").alias("items"))


# Files: a small folder of one picture or broken file for each row of folders, written, scanned and ingested


def _picture(m: Media) -> DataFrame:
    """(key, data): a PPM picture of one colour whose size follows from folder_id; every seventh file is no picture."""
    w, h = 1 + F.col("folder_id") % 50, 1 + F.col("folder_id") % 31
    body = F.concat(F.lit("P6\n"), w, F.lit(" "), h, F.lit("\n255\n"), F.expr("repeat('A', cast((1 + folder_id % 50) * (1 + folder_id % 31) * 3 as int))"))
    text = F.when(F.col("folder_id") % 7 == 0, F.concat(F.lit("no picture "), "folder_id")).otherwise(body)
    return m.folders.select(F.concat((F.col("folder_id") % 3).cast("string"), F.lit("/"), "folder_id", F.when(F.col("folder_id") % 2 == 0, ".JPG").otherwise(".png")).alias("key"), F.encode(text, "UTF-8").alias("data"))


def _written(m: Media) -> str:
    root = table_path(m.spark, "pictures")
    objects.write_objects(_picture(m), root).count()
    return root


_FILES = """files as (select folder_id, folder_id % 3 || '/' || folder_id || case when folder_id % 2 = 0 then '.JPG' else '.png' end as key, case when folder_id % 7 = 0 then 'no picture ' || folder_id
 else 'P6' || chr(10) || (1 + folder_id % 50) || ' ' || (1 + folder_id % 31) || chr(10) || '255' || chr(10) || repeat('A', ((1 + folder_id % 50) * (1 + folder_id % 31) * 3)::int) end as data from folders)"""
_NAME = r"([^/]+/[^/]+)$"


@_query(f", {_FILES} select key, length(data) length, sha256(data) digest from files")
def scanned_files(m: Media) -> DataFrame:
    found = files.hashed(files.scan(m.spark, _written(m)))
    return found.select(F.regexp_extract("path", _NAME, 1).alias("key"), "length", F.col("sha256").alias("digest"))


@_query(f", {_FILES} select sum(length(data)) bytes from files")
def directory_bytes(m: Media) -> DataFrame:
    return files.directory_bytes(m.spark, _written(m))


@_query(f""", {_FILES}, first as (select sha256(data) sha256, min(key) key, any_value(folder_id) f from files group by 1)
 select first.key, first.sha256, case when files.folder_id % 7 = 0 then 'failed' else 'ready' end status, case when files.folder_id % 7 = 0 then 'decode_failed' end error_code,
 case when files.folder_id % 7 <> 0 then 1 + files.folder_id % 50 end width, case when files.folder_id % 7 <> 0 then 1 + files.folder_id % 31 end height,
 case when files.folder_id % 7 <> 0 then substr(first.sha256, 1, 2) || '/' || first.sha256 || '.jpg' end thumb_key from first join files using (key)""")
def ingested_files(m: Media) -> DataFrame:
    made = ingest(files.scan(m.spark, _written(m)), schema.empty(m.spark, "assets"), 1, 1_760_000_000)["assets"]
    return made.select(F.regexp_extract("storage_key", _NAME, 1).alias("key"), "sha256", "status", "error_code", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), "thumb_key")


@_query("select * from (values (1, 'assets', 0), (2, 'assets', (select count(*) from a)), (1, 'folders', 1), (2, 'folders', (select count(*) from folders))) t(version, name, n)")
def catalog_versions(m: Media) -> DataFrame:
    library = Catalog.open(m.spark, table_path(m.spark, "library"))
    library.commit({"assets": A.current(m.raw("assets")), "folders": m.folders})
    out = None
    for v in library.versions():
        part = _counts({n: df for n, df in library.tables(v).items() if n in ("assets", "folders")}).withColumn("version", F.lit(v))
        out = part if out is None else out.unionByName(part)
    return out.select("version", "name", "n")


# Indexing


@_query("select (select count(*) from v1) done, (select count(*) from v1) + (select count(*) from a where status = 'ready' and folder_id in (select * from online) and asset_id not in (select asset_id from v1) and asset_id % 5 <> 0) total")
def indexing_progress(m: Media) -> DataFrame:
    rows = m.some("folder_id", "status", "year", "sha256")
    return jobs.progress(rows, m.folders, m.vector_ids, rows.where("asset_id % 5 = 0").select("asset_id"))


def _tables(m: Media) -> dict[int, DataFrame]:
    return {1: m.vector_ids, 2: m.prefix_ids, 3: m.vector_ids.where("asset_id % 2 = 0")}


def _cleared(m: Media, **scope) -> DataFrame:
    left, cleared = L.reindex(_tables(m), m.registry, m.some("folder_id"), **scope)
    kept = None
    for i, df in left.items():
        part = df.agg(F.lit(i).alias("index_id"), F.count("*").alias("kept"))
        kept = part if kept is None else kept.unionByName(part)
    return kept.join(cleared, "index_id", "left").select("index_id", "kept", F.coalesce("cleared", F.lit(0)).alias("cleared"))


_ALL = "all_ as (select 1 index_id, asset_id from v1 union all select 2, asset_id from v2 union all select 3, asset_id from v1 where asset_id % 2 = 0)"


@_query(f", {_ALL} select index_id, count(*) filter (where index_id = 3) kept, count(*) filter (where index_id < 3) cleared from all_ group by index_id")
def reindex_all(m: Media) -> DataFrame:
    return _cleared(m)


@_query(f""", {_ALL} select index_id, count(*) filter (where not c) kept, count(*) filter (where c) cleared from (select index_id, index_id < 3 and coalesce(a.folder_id = {FOLDER}, false) c from all_ left join a using (asset_id)) group by index_id""")
def reindex_folder(m: Media) -> DataFrame:
    return _cleared(m, folder_id=FOLDER)


@_query(f", {_ALL} select index_id, count(*) filter (where asset_id % 4 <> 0) kept, count(*) filter (where asset_id % 4 = 0) cleared from all_ where asset_id % 4 <> 0 or true group by index_id")
def reindex_assets(m: Media) -> DataFrame:
    return _cleared(m, ids=m.vector_ids.where("asset_id % 4 = 0"))


@_query("select asset_id, case when asset_id % 10 = 0 and asset_id in (select asset_id from a) and asset_id in (select asset_id from v2) then 8 else 64 end dim from v1")
def vectors_written(m: Media) -> DataFrame:
    """Vectors written anew for every tenth asset; those of assets that have gone are not."""
    held = m.once.withColumnRenamed("v", "embedding")
    short = knn.unit_vectors(m.raw("vec_assets"), "asset_id", DIM, first=PREFIX, once=True).where("asset_id % 10 = 0").withColumnRenamed("v", "embedding")
    return L.write_vectors(held, short, m.some("status")).select("asset_id", F.size("embedding").alias("dim"))


@_query(f"""select 'folder' scope, count(*) filter (where asset_id not in (select asset_id from a where folder_id = {FOLDER})) kept, count(*) filter (where asset_id in (select asset_id from a where folder_id = {FOLDER})) cleared from v1
 union all select 'set', count(*) filter (where asset_id % 7 <> 0), count(*) filter (where asset_id % 7 = 0) from v1 union all select 'index', 0, count(*) from v1""")
def vectors_cleared_by_scope(m: Media) -> DataFrame:
    scopes = {"folder": m.some("folder_id").where(F.col("folder_id") == FOLDER).select("asset_id"), "set": m.vector_ids.where("asset_id % 7 = 0"), "index": None}
    out = None
    for name, ids in scopes.items():
        left, gone = L.clear_vectors(m.vector_ids, ids)
        part = left.agg(F.lit(name).alias("scope"), F.count("*").alias("kept"), F.lit(gone).cast("long").alias("cleared"))
        out = part if out is None else out.unionByName(part)
    return out


_QUEUE = "queue as (select asset_id, sha256 from a where status = 'ready' and folder_id in (select * from online) and asset_id not in (select asset_id from v1))"


@_query(f""", {_QUEUE}, due as (select * from queue where asset_id % 6 <> 0 order by asset_id limit 64)
 select asset_id, case when sha256 in (select sha256 from a where asset_id in (select asset_id from v1)) then 'copied' when sha256 in (select sha256 from a where size is not null and size % 3 <> 0) then 'embedded' else 'failed' end outcome from due""")
def embedding_round(m: Media) -> DataFrame:
    """A round of indexing with the stand-in model: copies of contents that have a vector, fresh vectors, and failures for want of content."""
    rows = m.some("folder_id", "status", "year", "sha256", "size")
    held = knn.unit_vectors(m.raw("vec_assets"), "asset_id", DIM, once=True).select("asset_id", F.col("v").cast("array<float>").alias("embedding"))
    contents = rows.where("size is not null and size % 3 <> 0").select("sha256", F.encode("sha256", "UTF-8").alias("content")).distinct()
    resting = rows.where("asset_id % 6 = 0").select("asset_id", F.lit(jobs.RETRIES).alias("n"))
    fresh, failed = jobs.embed_pending({"assets": rows, "folders": m.folders, "vectors": held}, contents, jobs.HashIndexer(1, DIM), resting, 64)
    copied = A.copy_candidates(rows, held).select("asset_id", F.lit("copied").alias("how"))
    done = fresh.select("asset_id").join(copied, "asset_id", "left").select("asset_id", F.coalesce("how", F.lit("embedded")).alias("outcome"))
    return done.unionByName(failed.select("asset_id", F.lit("failed").alias("outcome")))


@_query("select asset_id, n from (select asset_id, count(*) n from (select asset_id from a where status = 'failed' union all select asset_id from a where status = 'failed' and asset_id % 2 = 0 union all select asset_id from a where status = 'failed' and asset_id % 4 = 0) group by asset_id) where n >= 3")
def resting_after_failures(m: Media) -> DataFrame:
    """Three rounds of failures, counted one after the other: what rests from then on."""
    failed = m.some("status").where("status = 'failed'").select("asset_id")
    attempts = m.spark.createDataFrame([], jobs.ATTEMPTS)
    for step in (1, 2, 4):
        attempts = jobs.count_failures(attempts, failed.where(F.col("asset_id") % step == 0))
    return jobs.resting(attempts)


# Bursts, chapters, prototypes, boxes

@_query("""select folder_id, min(ts) started, max(ts) + interval 600 second ended, count(*) n from (select *, sum(fresh) over (partition by folder_id order by ts, event_id) burst from
 (select user_id folder_id, event_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 600 second then 0 else 1 end fresh from events)) group by folder_id, burst""")
def quiet_bursts(m: Media) -> DataFrame:
    """Change events of each source gathered until ten minutes are quiet."""
    changes = m.raw("events").select(F.col("user_id").alias("folder_id"), F.col("ts").cast("timestamp").alias("ts"))
    return jobs.quiet_folders(changes, quiet="600 seconds").select("folder_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n")


@_query("""select chapter_id, started_at from (select chapter_id::bigint chapter_id, min(taken_at) started_at from (select taken_at, sum(case when taken_at - p <= 2592000 then 0 else 1 end) over (order by taken_at, asset_id rows unbounded preceding) - 1 chapter_id
 from (select asset_id, taken_at, lag(taken_at) over (order by taken_at, asset_id) p from a where taken_at is not null)) group by 1) order by chapter_id desc limit 1""")
def latest_chapter(m: Media) -> DataFrame:
    return L.latest_chapter(R.chapters(m.some("taken_at")))


def _prototypes(m: Media) -> DataFrame:
    """Prototypes as they would be stored: of each cluster the vector of its smallest region and the number of its regions."""
    rows = m.region("cluster_id", "chapter_id").where("cluster_id is not null")
    sizes = rows.groupBy("cluster_id").agg(F.min("chapter_id").alias("chapter_id"), F.count("*").alias("member_count"))
    first = m.region_vectors.join(rows, "region_id").groupBy("cluster_id").agg(F.min_by("v", "region_id").alias("prototype"))
    return sizes.join(first, "cluster_id").select(F.lit(2).cast("long").alias("index_id"), "cluster_id", "chapter_id", "prototype", "member_count", F.lit(7).cast("long").alias("created_at"))


_PROTOTYPES = """p as (select cluster_id, chapter_id, member_count, total from (select cluster_id, min(chapter_id) chapter_id, count(*) member_count from r where cluster_id is not null group by cluster_id)
 join (select cluster_id, round(list_sum(arg_min(v, region_id)), 6) total from vr join r using (region_id) where cluster_id is not null group by cluster_id) using (cluster_id))"""


@_query(f", {_PROTOTYPES} select * from p")
def prototype_list(m: Media) -> DataFrame:
    total = F.round(F.aggregate("prototype", F.lit(0.0), lambda s, x: s + x), 6)
    return L.prototypes(_prototypes(m), 2).select("cluster_id", "chapter_id", "member_count", total.alias("total"))


@_query(f", {_PROTOTYPES} select cluster_id, member_count from p where member_count > 2")
def prototype_delete(m: Media) -> DataFrame:
    rows = _prototypes(m)
    return L.delete_prototypes(rows, rows.where("member_count <= 2")).select("cluster_id", "member_count")


@_query(f", {_PROTOTYPES} select cluster_id, case when cluster_id % 3 = 0 then member_count + 1 else member_count end member_count, case when cluster_id % 3 = 0 then -1 else chapter_id end chapter_id, 7::bigint created_at from p union all select -5, 1, 0, 9")
def prototype_upsert(m: Media) -> DataFrame:
    rows = _prototypes(m)
    changed = rows.where("cluster_id % 3 = 0").withColumns({"member_count": F.col("member_count") + 1, "chapter_id": F.lit(-1).cast("long"), "created_at": F.lit(8).cast("long")})
    new = m.spark.createDataFrame([(2, -5, 0, [1.0], 1, 9)], rows.schema)
    return L.upsert_prototypes(rows, changed.unionByName(new)).select("cluster_id", "member_count", "chapter_id", "created_at")


@_query("select region_id, round(list_sum(list_transform(v, lambda x: greatest(least(round(x * 127), 127), -128) / 127)), 6) + 0.0 total from vr")
def vector_dequantise(m: Media) -> DataFrame:
    back = S.dequantise(S.quantise(F.col("v")))
    return m.regions_once.select("region_id", (F.round(F.aggregate(back, F.lit(0.0), lambda s, x: s + x), 6) + F.lit(0.0)).alias("total"))


@_query(", " + _bm25_sql("documents", "doc_id", "text", ["merge", "not", "branch"]) + ' select doc_id, "rank" from hits order by "rank", doc_id limit 200')
def fts_operators_as_text(m: Media) -> DataFrame:
    return fts.search_scan(m.raw("documents"), 'merge NOT "branch"', 200, "doc_id", "text").select("doc_id", F.round("rank", 6).alias("rank"))


_PLACED = f""", {_GAPS}, k as (select asset_id, taken_at, prev, (taken_at - prev) / 60.0::double dt, case when {_KNOWN} then {_KM} end km from gaps),
 ch as (select asset_id, taken_at, case when dt is null then 1.0 when km is null then case when dt < 5 then 0.5 else 1.0 end when km < 0.2 and dt < 5 then 0.5 when km < 0.2 then 0.9 when km >= 1 and dt < 120 then 1.3 else 1.0 end::double factor,
  sum(case when taken_at - prev <= 2592000 then 0 else 1 end) over (order by taken_at, asset_id rows unbounded preceding) - 1 scope from k)"""


@_query(_PLACED + dpmeans_sql() + " select scope, region_id, cluster_id from named")
def dpmeans_by_place(m: Media) -> DataFrame:
    """DP-means with a threshold that follows time and place."""
    photos = m.some("taken_at", "gps_lat", "gps_lng")
    timed = R.previous_times(photos, carry=("gps_lat", "gps_lng"))
    km = S.haversine_km(F.col("previous_gps_lat"), F.col("previous_gps_lng"), F.col("gps_lat"), F.col("gps_lng"))
    factor = R.place_factor((F.col("taken_at") - F.col("previous")) / 60.0, km)
    return R.global_ids(assigned(m, timed.select("asset_id", "taken_at", factor.alias("factor"))))


# Quality over all queries whose id is divisible by 20

HITS = 10


@_query(f"""select round(avg(h), 9) hit_rate from (select q, avg(case when l1 = l2 then 1.0 else 0.0 end::double) h from (select x.region_id q, x.cluster_id l1, y.cluster_id l2,
  row_number() over (partition by x.region_id order by list_distance(x.v, y.v), y.region_id) k from lab x join lab y on x.region_id <> y.region_id where x.region_id % 20 = 0 qualify k <= {HITS}) group by q)""".replace("select round", ", lab as (select region_id, cluster_id, v from vr join r using (region_id) where cluster_id is not null) select round", 1))
def hit_at_k(m: Media) -> DataFrame:
    """Mean share of the ten nearest labelled regions that carry the query's label, over every query."""
    labels = m.region("cluster_id").where("cluster_id is not null").select(F.col("region_id").alias("id"), F.col("cluster_id").alias("label"))
    rows = m.regions_once.join(labels.select(F.col("id").alias("region_id")), "region_id", "left_semi")
    near = knn.nearest_many(rows, rows.where("region_id % 20 = 0"), "region_id", HITS)
    return M.hit_rate(near.select("query_id", F.col("region_id").alias("id"), "rank"), labels, HITS).select(F.round("hit_rate", 9).alias("hit_rate"))


_REPS = ", lab as (select region_id, cluster_id, v from vr join r using (region_id) where cluster_id is not null), reps as (select * from lab qualify row_number() over (partition by cluster_id order by region_id) <= 3)"


@_query(_REPS + " select region_id query_id, arg_min(cluster_id, (-s, cluster_id)) cluster from (select q.region_id, reps.cluster_id, round(list_dot_product(q.v, reps.v), 9) s from vr q, reps where q.region_id % 20 = 0) group by region_id")
def routed_clusters(m: Media) -> DataFrame:
    """Each query's cluster by three representatives of every cluster."""
    named = m.regions_once.join(m.region("cluster_id").where("cluster_id is not null"), "region_id")
    reps = M.top_per_group(named, "cluster_id", 3, "region_id").select(F.col("cluster_id").alias("cluster"), "v")
    return M.routed(m.regions_once.where("region_id % 20 = 0").select(F.col("region_id").alias("id"), "v"), reps)


@_query("select region_id, round(list_distance(v, (select v from vr order by region_id limit 1)), 6) dist from vr")
def pca_signature_distances(m: Media) -> DataFrame:
    """Distances of all 64-component signatures to the first: axes turn the space, so they are those of the vectors."""
    signed = C.signature(m.regions_once, "region_id", "v", DIM)
    first = signed.agg(F.min_by("signature", "region_id")).first()[0]
    return signed.select("region_id", F.round(S.l2_distance(F.col("signature"), F.array(*[F.lit(float(x)) for x in first])), 6).alias("dist"))


@_query()
def kmeans_hierarchy(m: Media) -> DataFrame:
    """(parent, cluster, rank, region_id, distance): 48 clusters under 10, and the three members nearest to each centre."""
    placed, parents = C.two_levels(m.regions_once, "region_id", "v", 48, 10)
    return parents.join(C.members_by_distance(placed, 3, "region_id"), "cluster").select("parent", "cluster", "rank", "region_id", F.round("distance", 6).alias("distance"))
