"""Queries of the llm problems; their SQL where SQL can say it over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from prismara.llm import dedup, leaks, neighbours, packing, spectral, splitting
from prismara.tables import load


ALIKE = 0.77
NEAR_VECTORS = 0.985


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.found(load(spark, sf_dir, "vec_regions"), "region_id", "embedding", ALIKE).withColumnRenamed("id", "region_id")


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.described(load(spark, sf_dir, "vec_regions"), "region_id", "embedding", ALIKE).withColumnRenamed("id", "region_id")


def _contents(spark: SparkSession, sf_dir: str, arrivals: DataFrame) -> tuple[DataFrame, DataFrame]:
    assets = load(spark, sf_dir, "assets").select("asset_id", "folder_id", "sha256")
    vectors = load(spark, sf_dir, "vec_assets").join(assets.select("asset_id", "folder_id").distinct(), "asset_id")
    history = dedup.records(assets, "asset_id", "folder_id", "sha256", None, False).unionByName(dedup.records(vectors, "asset_id", "folder_id", None, "embedding", False))
    return history, dedup.records(arrivals, "asset_id", "folder_id", "sha256", "embedding", True)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library is accepted as history; then all pending batches are held against it and appended."""
    history, pending = _contents(spark, sf_dir, load(spark, sf_dir, "arrivals"))
    return dedup.repeats(history, pending, NEAR_VECTORS)


def p3_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p3_found, one batch after the other: each meets the history and the batches before it, which are kept, and is appended."""
    arrivals = load(spark, sf_dir, "arrivals")
    kept = dedup.History(spark, None, NEAR_VECTORS)
    kept.accept(_contents(spark, sf_dir, arrivals)[0], arriving=False)
    out = None
    for row in arrivals.select("batch_no").distinct().orderBy("batch_no").collect():  # a row per batch
        found = kept.accept(_contents(spark, sf_dir, arrivals.where(F.col("batch_no").eqNullSafe(row.batch_no)))[1])
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "asset_id_a long, asset_id_b long")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for table, key in (("vec_assets", "asset_id"), ("vec_regions", "region_id")):
        pairs = neighbours.mutual(neighbours.similar_pairs(load(spark, sf_dir, table), key, "embedding", NEAR_VECTORS))
        pairs = pairs.select(F.lit(table).alias("vec_table"), F.col("a").alias("id_a"), F.col("b").alias("id_b"))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar vectors of every vector whose key is divisible by 20, searched among all."""
    out = None
    for table, key in (("vec_assets", "asset_id"), ("vec_regions", "region_id")):
        rows = load(spark, sf_dir, table)
        near = neighbours.nearest(rows, rows.where(F.col(key) % 20 == 0), key, "embedding").select(F.lit(table).alias("vec_table"), "id", "neighbour", "rank", "sim")
        out = near if out is None else out.unionByName(near)
    return out


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.containers(p6_packed(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.spans(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split(load(spark, sf_dir, "documents"))


def p6_laid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, whole, fits): whether a document is there from its first token to its last, in one piece unless it is too long, and in containers
    that are not overfull."""
    packed = p6_packed(spark, sf_dir)
    full = packing.containers(packed).select("container_id", (F.col("free") >= 0).alias("fits"))
    own = packed.join(full, "container_id").groupBy("doc_id").agg(
        F.count("*").alias("n"), F.countDistinct("piece_no").alias("nos"), F.max("piece_no").alias("last"), F.sum("n_tokens").alias("total"),
        F.max(F.col("first_token") + F.col("n_tokens")).alias("end"), F.bool_and("fits").alias("fits"),
    )
    pieces = F.greatest(F.ceil(F.col("total") / packing.CAPACITY), F.lit(1))
    return own.select("doc_id", ((F.col("n") == pieces) & (F.col("nos") == pieces) & (F.col("last") == pieces - 1) & (F.col("total") == F.col("end"))).alias("whole"), "fits")


def p8_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, digest): of each document with a text the hash of what its pieces' new parts make up, or of the text where it was not cut."""
    documents = load(spark, sf_dir, "documents").where("doc_id is not null and text is not null").select("doc_id", "text")
    part = F.struct("piece_no", F.substring(F.col("text"), F.col("new_from") - F.col("start") + 1, F.col("end") - F.col("new_from")).alias("t"))
    joined = splitting.split(documents).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["t"]), "").alias("joined"))  # one document
    one = documents.select("doc_id", F.sha2("text", 256).alias("h")).groupBy("doc_id").agg(F.min("h").alias("h"))
    return one.join(joined.select("doc_id", F.sha2("joined", 256).alias("j")), "doc_id", "left").select("doc_id", F.coalesce("j", "h").alias("digest"))


QUERIES = {"p1_found": p1_found, "p1_clusters": p1_clusters, "p3_found": p3_found, "p3_by_batch": p3_by_batch, "p4_found": p4_found, "p4_neighbours": p4_neighbours, "p6_packed": p6_packed, "p6_containers": p6_containers, "p6_laid": p6_laid, "p7_found": p7_found, "p7_spans": p7_spans, "p8_pieces": p8_pieces, "p8_rejoined": p8_rejoined}


def _usable(table: str, key: str, more: str = "") -> str:
    """SQL of usable vectors as unit vectors of double, one for each key."""
    return f"""(select {key}{more}, list_transform(e, lambda x: x / n) v from (select *, sqrt(list_sum(list_transform(e, lambda x: x * x))) n
      from (select distinct {key}{more}, embedding::double[] e from {table} where {key} is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: isfinite(x))) = 64)) where n > 0)"""


_GROUPS = f"""with v as materialized {_usable("vec_regions", "region_id")},
 near as materialized (select a.region_id a, b.region_id b from v a, v b where list_dot_product(a.v, b.v) >= {ALIKE} or a.region_id = b.region_id),
 k as (select a, min(b) as key_, count(*) n from near group by a),
 g as (select key_, count(*) size_, bool_and(n = (select count(*) from k x where x.key_ = k.key_)) whole from k group by key_),
 apart as (select ka.key_, bool_and(ka.key_ = kb.key_) own from near join k ka on ka.a = near.a join k kb on kb.a = near.b group by ka.key_)
 select k.a as region_id, k.key_ as cluster_key from k join g using (key_) join apart using (key_) where whole and own and size_ >= 5"""

_BARE = "regexp_replace(regexp_replace(lower(trim(sha256)), '^(sha-?_?256\\s*[:=(]?\\s*|0x|\\\\x)', ''), '[^0-9a-z]', '', 'g')"
_REPEATS = f"""with h as (select asset_id, folder_id, {_BARE} sha, 0 came from assets where folder_id is not null union select asset_id, folder_id, {_BARE}, 1 from arrivals where folder_id is not null),
 w as materialized (select asset_id, folder_id, v, 0 came from {_usable("vec_assets", "asset_id")} join (select distinct asset_id, folder_id from assets where folder_id is not null) using (asset_id)
   union all select asset_id, folder_id, v, 1 from {_usable("arrivals", "asset_id", ", folder_id")} where folder_id is not null),
 p as (select a.asset_id a, b.asset_id b from h a join h b on a.folder_id = b.folder_id and a.sha = b.sha where b.came = 1 and a.asset_id <> b.asset_id and (a.came = 0 or a.asset_id < b.asset_id)
   union all select a.asset_id, b.asset_id from w a join w b on a.folder_id = b.folder_id where b.came = 1 and a.asset_id <> b.asset_id and (a.came = 0 or a.asset_id < b.asset_id) and list_dot_product(a.v, b.v) >= {NEAR_VECTORS})
 select min(a) asset_id_a, b asset_id_b from p group by b"""


def _mutual(table: str, key: str) -> str:
    return f"""select '{table}' vec_table, x.p id_a, x.r id_b from r_{table} x join r_{table} y on x.p = y.r and x.r = y.p where x.p < x.r"""


def _ranked(table: str, key: str) -> str:
    return f"""v_{table} as materialized {_usable(table, key)}, r_{table} as materialized (select p, r from (select a.{key} p, b.{key} r, row_number() over (partition by a.{key} order by list_dot_product(a.v, b.v) desc, b.{key}) k
      from v_{table} a, v_{table} b where a.{key} <> b.{key} and list_dot_product(a.v, b.v) >= {NEAR_VECTORS}) where k <= 10)"""


_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_PHRASES = lambda table, key: f"select distinct {key}, array_to_string(w[i:i + 12], ' ') g from (select {key}, w, unnest(range(1, len(w) - 11)) i from (select {key}, {_WORDS} w from {table} where text is not null))"

ORACLE: dict[str, str] = {
    "p1_found": _GROUPS,
    "p3_found": _REPEATS,
    "p3_by_batch": _REPEATS,
    "p4_found": f"with {_ranked('vec_assets', 'asset_id')}, {_ranked('vec_regions', 'region_id')} {_mutual('vec_assets', 'asset_id')} union all {_mutual('vec_regions', 'region_id')}",
    "p6_laid": "select distinct doc_id, true as whole, true as fits from documents where doc_id is not null",
    "p8_rejoined": "select doc_id, min(sha256(text)) digest from documents where doc_id is not null and text is not null group by doc_id",
    "p7_spans": f"""with t as ({_PHRASES('eval_items', 'item_id')}),
 h as (select distinct doc_id, item_id, i - 1 word from (select doc_id, i, array_to_string(w[i:i + 12], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 11)) i from (select doc_id, {_WORDS} w from documents where text is not null))) join t using (g)),
 s as (select *, sum(fresh) over (partition by doc_id, item_id order by word) span from (select *, case when word - lag(word) over (partition by doc_id, item_id order by word) <= 13 then 0 else 1 end fresh from h))
 select doc_id, item_id, min(word) first_word, max(word) + 13 end_word from s group by doc_id, item_id, span""",
    "p7_found": f"with t as ({_PHRASES('eval_items', 'item_id')}) select distinct doc_id, item_id from ({_PHRASES('documents', 'doc_id')}) join t using (g)",
}
