"""What SQL cannot say, and small cases by hand: files, snapshots, streams, folds, pixels, tokenizers."""

import math
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismara import schema
from prismara.functions import scalars as S
from prismara.functions import wordpiece
from prismara.operators import assets as A
from prismara.operators import clusters
from prismara.operators import lifecycle as L
from prismara.operators import metrics as M
from prismara.operators import regions as R
from prismara.plans import fts, fusion, knn, search
from prismara.sources import exif, files, jpeg, objects, pixels
from prismara.sources import regions as regions_
from prismara.sources.catalog import Catalog
from prismara.sources.ingest import ingest
from prismara.streaming import jobs, workers

ASSETS = schema.SCHEMAS["assets"]


def asset(i, folder=1, sha=None, taken=0, status="ready", kind="photo", thumb="kk", **more):
    base = dict(asset_id=i, folder_id=folder, sha256=sha or f"h{i}", storage_key=f"photos/h{i}.jpg", kind=kind, size=1024, width=10, height=10, taken_at=taken, year="2023", mime="image/jpeg", exif=None, thumb_key=thumb, status=status, error_code=None, imported_at=1_760_000_000, gps_lat=None, gps_lng=None)
    return tuple((base | more).values())


def assets(spark, *rows):
    return spark.createDataFrame(list(rows), ASSETS)


def folders(spark, *rows):
    return spark.createDataFrame(list(rows), schema.SCHEMAS["folders"])


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def ids(df, column="asset_id"):
    return [r[column] for r in df.collect()]


# Scalars


def test_date_goldens(spark):
    assert one(spark, *[S.year_of(F.lit(t).cast("long")) for t in (1_582_977_600, 946_684_740, 1_700_000_000, 0, -1, None)]) == ("2020", "1999", "2023", "1970", "1969", "1970")
    # the day of the month counts
    assert one(spark, S.exif_seconds(F.lit("2023:11:14 22:13:20")), S.exif_seconds(F.lit("no date")))[0] == 1_700_000_000
    assert one(spark, S.filename_seconds(F.lit("/x/IMG_20231114_221320_1.jpg")), S.filename_seconds(F.lit("/x/IMG_20231399_221320.jpg"))) == (1_700_000_000, None)


def test_names_and_keys(spark):
    assert one(spark, *[S.basename(F.lit(p)) for p in ("D:\\a\\b.jpg", "/a/c.d.png", "plain")]) == ("b.jpg", "c.d.png", "plain")
    assert one(spark, *[S.stem(F.lit(p)) for p in ("D:\\a\\b.jpg", "/a/c.d.png", "plain", "/a/.hidden")]) == ("b", "c.d", "plain", ".hidden")
    assert one(spark, *[S.valid_object_key(F.lit(k)) for k in ("aa/b.jpg", "/a", "a/../b", "a b", "")]) == (True, False, False, False, False)
    assert one(spark, S.content_hash(F.lit("hello")))[0].startswith("2cf24dba") and one(spark, S.thumb_key(F.lit("abcd")))[0] == "ab/abcd.jpg"
    assert one(spark, *[S.under_folder(F.lit(p), F.lit("/a/b/")) for p in ("/a/b/c", "/a/bc", "/a/b")]) == (True, False, True)


def test_sizes_and_eta(spark):
    fit = lambda w, h: one(spark, *S.fit_within(F.lit(w), F.lit(h)))
    assert fit(2048, 1024) == (384, 192) and fit(3000, 2000) == (384, 256) and fit(50, 50) == (50, 50) and fit(10_000, 1) == (384, 1)
    assert one(spark, *[S.eta_seconds(F.lit(10.0), F.lit(d), F.lit(25)) for d in (5, 0, 25)]) == (40, None, None)


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(c)) for c in x])
    assert one(spark, S.quantise(v(2, -2, 0)))[0] == [127, -128, 0]
    assert one(spark, S.normalise(v(3, 4)), S.normalise(v(0, 0)), S.normalise(v(float("nan"), 1))) == ([0.6, 0.8], None, None)
    assert one(spark, S.similarity(S.l2_distance(v(1, 0), v(-1, 0))), S.similarity(F.lit(0.0))) == (0.0, 1.0)
    assert one(spark, *[S.usable(c, 2) for c in (v(1, 0), v(0, 0), v(1, float("inf")), v(1), F.lit(None).cast("array<double>"))]) == (True, False, False, False, False)
    box = lambda *c: tuple(F.lit(x) for x in c)
    assert one(spark, S.iou(box(0, 0, 10, 10), box(0, 0, 10, 10)), S.iou(box(0, 0, 10, 10), box(5, 0, 15, 10)), S.iou(box(0, 0, 1, 1), box(5, 5, 6, 6))) == pytest.approx((1.0, 1 / 3, 0.0))
    assert one(spark, S.haversine_km(*[F.lit(x) for x in (0.0, 0.0, 0.0, 180.0)]), S.haversine_km(F.lit(None).cast("double"), *[F.lit(0.0)] * 3))[1] is None


def test_cursor():
    assert S.parse_cursor("-5:7") == (-5, 7) and S.parse_cursor("x") is None and S.parse_cursor(None) is None and S.format_cursor(3, 4) == "3:4"


# Browsing and queues


def test_pages_join_to_the_full_order(spark):
    rows = assets(spark, *[asset(i, folder=1 + i % 2, taken=1_700_000_000 + 60 * (i // 2)) for i in range(1, 11)], asset(11, taken=None))
    full = [(r.taken_at, r.asset_id) for r in A.timeline_page(rows, None, 500).collect()]
    assert full == sorted(full, reverse=True) and full[-1] == (0, 11)
    got, cursor, sizes = [], None, []
    while True:
        page = A.timeline_page(rows, S.parse_cursor(cursor), 4).collect()
        got += [(r.taken_at, r.asset_id) for r in page]
        sizes.append(len(page))
        cursor = A.next_cursor(page, 4)
        if cursor is None:
            break
    assert got == full and sizes == [4, 4, 3]
    assert A.timeline_page(rows, None, 500, 2).count() == 5
    groups = A.year_groups(A.timeline_page(rows.withColumn("year", S.year_of(F.col("taken_at"))), None)).orderBy("year").collect()
    assert [(g.year, g.n) for g in groups] == [("1970", 1), ("2023", 10)] and list(groups[1]["items"])[0] == 10


def test_a_page_is_a_condition_of_the_scan(spark, tmp_path):
    rows = [asset(i, folder=1 + i % 2, taken=t) for i, t in enumerate([5, 5, None, 0, -3, 7, None, 5])]
    assets(spark, *rows, asset(7, folder=2, taken=5, status="pending"), *[rows[1]] * 40).write.parquet(str(tmp_path / "a"))
    raw = spark.read.parquet(str(tmp_path / "a"))
    plan = A.timeline_order(raw, (5, 3), 2).limit(9)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan and "LessThan(taken_at,5)" in plan and "EqualTo(folder_id,2)" in plan
    order = [(r.taken_at, r.asset_id) for r in A.timeline_page(raw, None, 50).collect()]
    assert order == [(7, 5), (5, 7), (5, 1), (5, 0), (0, 6), (0, 3), (0, 2), (-3, 4)]
    for n, at in enumerate(order):
        assert [(r.taken_at, r.asset_id) for r in A.timeline_page(raw, at, 3).collect()] == order[n + 1 : n + 4]
    assert {r.status for r in A.timeline_page(raw, None, 50).collect()} == {"ready"}


def test_repeated_rows_count_once(spark):
    rows = assets(spark, asset(1, status="pending", width=None), asset(1), asset(2), asset(2), asset(3, status="pending"))
    got = {r.asset_id: r.status for r in A.current(rows).collect()}
    assert got == {1: "ready", 2: "ready", 3: "pending"} and A.current(rows.limit(0)).count() == 0


def test_queues_and_copies(spark):
    f = folders(spark, (1, "/a", None, "local", "online", 1), (2, "/b", "B", "local", "offline", 2), (3, "/c", None, "local", "online", 3))
    a = assets(spark, asset(1), asset(2, folder=2), asset(3, folder=3, sha="h1"), asset(4, status="pending"), asset(5, folder=None))
    v = spark.createDataFrame([(1,)], "asset_id long")
    assert ids(A.pending_embeddings(a, f, v)) == [3] and ids(A.pending_embeddings(a, f, v, 1)) == []
    assert [tuple(r) for r in A.copy_candidates(a, v).collect()] == [(3, 1)]
    counts = {r.folder_id: r.asset_count for r in A.folder_counts(f, a).collect()}
    assert counts == {1: 2, 2: 1, 3: 1}
    regions = spark.createDataFrame([(9, 1, -1)], "region_id long, asset_id long, region_idx int")
    assert ids(A.pending_regions(a, f, regions)) == [3]
    flags = {r.asset_id: r.indexed for r in A.indexed_flags(a, v.withColumn("index_id", F.lit(1)), spark.createDataFrame([(1,)], "index_id int")).collect()}
    assert flags[1] and not flags[2]
    none = A.indexed_flags(a, v.withColumn("index_id", F.lit(1)), spark.createDataFrame([], "index_id int"))
    assert not any(r.indexed for r in none.collect())


def test_longest_prefix_owns(spark):
    f = spark.createDataFrame([(1, "/a"), (2, "/a/b/"), (3, ""), (4, "D:\\x")], "folder_id long, path string")
    p = spark.createDataFrame([("/a/b/c.jpg",), ("/a/bc.jpg",), ("/z",), ("D:\\x\\y\\q.png",), (None,), ("/a",)], "path string")
    for sent in (100, 0):
        got = {r.path: r.folder_id for r in A.owner_of_path(p, f, sent).collect()}
        assert got == {"/a/b/c.jpg": 2, "/a/bc.jpg": 1, "/z": None, "D:\\x\\y\\q.png": 4, "/a": 1}


# Changes


def test_insert_is_idempotent_per_folder(spark):
    new = spark.createDataFrame([(1, "s", "k1"), (2, "s", "k2"), (1, "s", "k3"), (1, "h1", "k4")], "folder_id long, sha256 string, storage_key string")
    got = {r.storage_key: r.duplicated for r in L.insert_outcomes(new, assets(spark, asset(1))).collect()}
    assert got == {"k1": False, "k2": False, "k3": True, "k4": True}


def test_ids_follow_the_largest(spark):
    rows = spark.range(50).select(F.concat(F.lit("p"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("path"))
    got = L.allocate(rows, assets(spark, asset(7)), "asset_id", ["path"]).orderBy("path").collect()
    assert [r.asset_id for r in got] == list(range(8, 58))
    assert L.allocate(rows.limit(0), assets(spark, asset(7)), "asset_id", ["path"]).count() == 0


def test_delete_cascades_and_counts_thumbs(spark):
    a = assets(spark, asset(1, thumb="t"), asset(2, folder=2, thumb="t"), asset(3, thumb="u"))
    tables = {
        "assets": a,
        "vectors": spark.createDataFrame([(1,), (2,)], "asset_id long"),
        "regions": spark.createDataFrame([(10, 1), (11, 2)], "region_id long, asset_id long"),
        "vec_regions": spark.createDataFrame([(10,), (11,)], "region_id long"),
        "fts": spark.createDataFrame([(1, "x"), (3, "y")], "asset_id long, content string"),
    }
    gone = spark.createDataFrame([(1,), (1,), (3,), (99,)], "asset_id long")
    left, thumbs = L.delete_assets(tables, gone)
    assert ids(left["assets"]) == [2] and ids(left["vectors"]) == [2] and ids(left["vec_regions"], "region_id") == [11] and left["fts"].count() == 0
    assert ids(thumbs, "thumb_key") == ["u"]
    assert tuple(L.delete_report(a, gone).first()) == (2, 2)
    again, thumbs = L.delete_assets(left, gone)
    assert ids(again["assets"]) == [2] and thumbs.count() == 0
    assert ids(L.delete_assets(left, spark.createDataFrame([(2,)], "asset_id long"))[1], "thumb_key") == ["t"]


def test_relocate_and_states(spark):
    a = assets(spark, asset(1, storage_key="/old/x/old/1.jpg"), asset(2, storage_key="/other/old/2.jpg"), asset(3, folder=2, storage_key="/old/3.jpg"), asset(4, status="failed", error_code="decode_failed"))
    moved = {r.asset_id: r.storage_key for r in L.relocate(a, 1, "/old", "/new").collect()}
    assert moved[1] == "/new/x/old/1.jpg" and moved[2] == "/other/old/2.jpg" and moved[3] == "/old/3.jpg"
    assert {r.storage_key for r in L.relocate(a, 1, "", "/new").collect()} == {r.storage_key for r in a.collect()}
    reset = L.reset_failed(a).where("asset_id = 4").first()
    assert (reset.status, reset.error_code) == ("pending", None)
    done = L.set_state(a, spark.createDataFrame([(4,)], "asset_id long"), status="ready", error_code=None)
    assert {r.asset_id: r.status for r in done.collect()} == {i: "ready" for i in (1, 2, 3, 4)}
    status = L.folder_status(folders(spark, (1, "/a", None, "local", "online", 1), (2, "/b", None, "local", "missing", 1), (3, "/c", None, "local", "offline", 1)), spark.createDataFrame([(1, False), (2, True)], "folder_id long, exists boolean"))
    assert {r.folder_id: r.status for r in status.collect()} == {1: "offline", 2: "online", 3: "offline"}


def test_registry_and_vectors(spark):
    registry = schema._v5(spark, {})["index_meta"]
    more = L.register_index(registry, "small-8", "Small", "m", 8, 5)
    assert more.count() == 2 and L.register_index(more, "small-8", "Other", "m", 9, 6).count() == 2
    for slug, dim in (("Bad Slug", 8), ("ok", 0), ("ok", 5000)):
        with pytest.raises(ValueError):
            L.register_index(registry, slug, "x", "m", dim, 0)
    v = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "asset_id long, embedding array<double>")
    new = spark.createDataFrame([(2, [9.0]), (3, [3.0]), (4, [4.0])], "asset_id long, embedding array<double>")
    got = {r.asset_id: r.embedding for r in L.write_vectors(v, new, assets(spark, asset(1), asset(2), asset(3))).collect()}
    assert got == {1: [1.0], 2: [9.0], 3: [3.0]}
    left, n = L.clear_vectors(v, spark.createDataFrame([(1,), (7,)], "asset_id long"))
    assert ids(left) == [2] and n == 1 and L.clear_vectors(v)[1] == 2


def test_migrations(spark):
    old = {"assets": spark.createDataFrame([tuple(x for i, x in enumerate(asset(1)[:-2]) if i != 1)], schema._ASSET_V1)}
    old["vec_assets"], old["fts_text"] = schema.empty(spark, "vec_assets"), schema.empty(spark, "fts_text")
    tables, version = schema.migrate(spark, old, 3)
    assert version == 7 and set(tables) == set(schema.SCHEMAS) and tables["assets"].columns == schema.empty(spark, "assets").columns
    row = tables["assets"].first()
    assert row.folder_id == 1 and tables["folders"].first().status == "missing"
    full = tables | {"regions": spark.createDataFrame([(1, 1, -1), (2, 1, 0)], "region_id long, asset_id long, region_idx int"), "vec_regions": spark.createDataFrame([(1, [0.0]), (2, [1.0])], "region_id long, embedding array<float>")}
    assert ids(schema.migrate(spark, full, 6)[0]["vec_regions"], "region_id") == [2]


# Text and fusion


def test_full_text_semantics(spark):
    rows = ["IMG_2023 海边日落", "img_2024 海边", "beach 2023 sunset 2023", "ÀÉ foo", "aaaa", "aaa b", "😀😀😀x", 'a"b OR 1=1', None, ""]
    docs = spark.createDataFrame(list(enumerate(rows)), "asset_id long, content string")
    posted, measured = fts.postings(docs), fts.lengths(docs)

    def both(text):
        a = [(r.asset_id, round(r["rank"], 9)) for r in fts.search_scan(docs, text, 10).collect()]
        b = [(r.asset_id, round(r["rank"], 9)) for r in fts.search_postings(posted, measured, text, 10).collect()]
        assert a == b
        return a

    assert {i for i, _ in both("2023")} == {0, 2} and both("2023")[0][0] == 2
    assert both("海边") == [] and {i for i, _ in both("海边日落")} == {0} and both("雪山海边") == []
    assert both("海 2023") == both("2023") and {i for i, _ in both("IMG 2023")} == {0} and both('"') == [] and {i for i, _ in both("àé foo")} == {3}
    assert {i for i, _ in both("foo")} == {3} and {i for i, _ in both('a"b OR 1=1')} == {7}
    # two overlapping occurrences rank before one
    assert [i for i, _ in both("aaa")] == [4, 5]
    assert {i for i, _ in both("😀😀😀")} == {6}
    empty = docs.limit(0)
    assert fts.search_scan(empty, "beach", 5).count() == fts.Postings(empty).search("beach", 5).count() == 0
    assert [r.asset_id for r in fts.Postings(docs).search("IMG 2023", 5).collect()] == [0]


def test_full_text_equals_sqlite(spark):
    import sqlite3

    rng = np.random.default_rng(3)
    words = ["img_2023", "beach", "sunset", "IMG_2024", "lantern", "aaaa", "b"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 9)))) for i in range(120)]
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table t using fts5(asset_id unindexed, content, tokenize='trigram')")
    except sqlite3.OperationalError:
        pytest.skip("no trigram index here")
    con.executemany("insert into t values (?, ?)", rows)
    docs = spark.createDataFrame(rows, "asset_id long, content string")
    for text in ("img_202", "beach lantern", "aaa", "sunset b"):
        match = " ".join(f'"{t}"' for t in S.query_terms(text))
        want = sorted((round(r, 6), i) for i, r in con.execute("select asset_id, rank from t where t match ?", (match,)))
        assert sorted((round(r["rank"], 6), r.asset_id) for r in fts.search_scan(docs, text, 1000).collect()) == want


def test_rank_fusion(spark):
    def fuse(semantic, text, k=60.0):
        streams = [fusion.listed(spark, semantic, 1, True)] if semantic else []
        streams += [fusion.listed(spark, text, 2, False)] if text else []
        return [(r.id, round(r.score, 9), r.matched) for r in fusion.rrf(streams, k).orderBy(F.desc("score"), "id").collect()]

    got = fuse([1, 2, 3], [2, 4])
    assert got[0] == (2, round(1 / 62 + 1 / 61, 9), "both") and {m for _, _, m in got} == {"both", "semantic", "text"}
    assert [i for i, _, _ in fuse([], [5, 6])] == [5, 6]
    # a repeated id keeps its first place and still uses up its second
    assert fuse([9, 9, 8], []) == [(9, round(1 / 61, 9), "semantic"), (8, round(1 / 63, 9), "semantic")]
    assert fuse([1, 2], [2, 1], 0) == fuse([1, 2], [2, 1])


def unit(*x):
    v = np.array(x, float)
    return (v / np.linalg.norm(v)).tolist()


def test_neighbours_agree_between_plans(spark):
    rng = np.random.default_rng(5)
    rows = [(i, unit(*rng.standard_normal(8))) for i in range(300)]
    v = spark.createDataFrame([*rows, *rows[:20], (900, rows[7][1]), (901, [1.0])], "asset_id long, v array<double>")
    a, h = (knn.knn(v, "asset_id", rows[7][1], 12, plan=p).collect() for p in ("arrow", "hof"))
    assert [r.asset_id for r in a] == [r.asset_id for r in h] and [r.asset_id for r in a][:2] == [7, 900] and len(a) == 12
    assert np.allclose([r.dist for r in a], [r.dist for r in h], atol=1e-9)
    assert knn.knn(v, "asset_id", [], 5).count() == 0 and knn.knn(v.limit(0), "asset_id", rows[0][1], 5).count() == 0
    raw = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [3.0, 4.0]), (4, [3.0, 4.0]), (5, [1.0]), (None, [1.0, 1.0])], "asset_id long, embedding array<float>")
    assert [tuple(r) for r in knn.unit_vectors(raw, "asset_id", 2, once=True).collect()] == [(4, [0.6, 0.8])] and ids(knn.vector_keys(raw, "asset_id", 2)) == [4]


def test_hybrid_search_by_hand(spark):
    a = assets(spark, *[asset(i, folder=1 + i % 2, taken=i, storage_key=f"/p/IMG_{2020 + i}.jpg") for i in range(1, 6)])
    f = folders(spark, (1, "/one", None, "local", "online", 1), (2, "/two", "Two", "local", "online", 2))
    v = spark.createDataFrame([(i, unit(1, 0.2 * i)) for i in range(1, 5)], "asset_id long, embedding array<float>")
    r = spark.createDataFrame([(10, 5, 0), (11, 1, 0)], "region_id long, asset_id long, region_idx int")
    rv = spark.createDataFrame([(10, unit(1, 0)), (11, unit(0, 1))], "region_id long, embedding array<float>")
    text = a.select("asset_id", S.stem(F.col("storage_key")).alias("content"))
    lib = search.Library(a, f, {1: search.Index(v, 2)}, r, search.Index(rv, 2), text)
    got = search.hybrid_search(lib, "IMG_2024", {1: [1.0, 0.0]}, 3).collect()
    by = {x.asset_id: x for x in got}
    assert set(by) == {1, 2, 3, 4, 5} and by[4].matched == "text" and by[5].similarity is None and by[5].matched == "semantic"
    assert got[0].asset_id == 1 and got[0].score == 1.0 and by[1].folder_label == "Two" and by[2].folder_label == "/one" and by[1].file_name == "IMG_2021.jpg"
    # without a model full text alone answers; filters act on what was found
    assert [x.asset_id for x in search.hybrid_search(lib, "IMG_2024", {}, 3).collect()] == [4]
    assert search.hybrid_search(lib, "", {}, 3).count() == 0
    assert {x.asset_id for x in search.hybrid_search(lib, "", {1: [1.0, 0.0]}, 3, search.Filters(folder_id=1)).collect()} == {2, 4}
    assert search.hybrid_search(lib, "IMG", {1: [1.0, 0.0]}, 3, limit=2).count() == 2
    assert {x.asset_id for x in search.hybrid_search(lib, "", {1: [1.0, 0.0]}, 1, search.Filters(folder_id=1, before=True)).collect()} == {2, 4, 5} - {5}
    # a broken index costs its own hits alone
    lost = v.select(F.raise_error(F.lit("lost")).cast("long").alias("asset_id"), "embedding")
    both = search.Library(a, f, {1: search.Index(v, 2), 2: search.Index(lost, 2)}, r, search.Index(rv, 2), text)
    with pytest.warns(UserWarning, match="index"):
        rows = search.hybrid_search(both, "IMG_2024", {1: [1.0, 0.0], 2: [1.0, 0.0]}, 3).collect()
    assert [x.asset_id for x in rows] == [x.asset_id for x in got]


def test_searches_share_a_pass(spark):
    rng = np.random.default_rng(15)
    x = rng.standard_normal((200, 8))
    x[3, :4] = 0  # no vector of its first four components
    raw = spark.createDataFrame([*[(i, v.tolist()) for i, v in enumerate(x)], (7, x[7].tolist()), (900, None), (901, [0.0] * 8), (902, [float("inf")] * 8)], "asset_id long, embedding array<float>")
    q, h = unit(*x[5]), unit(*x[5, :4])
    got = knn.nearest(raw, "asset_id", 8, [knn.Asked(1, q, 6), knn.Asked(2, h, 9), knn.Asked(3, [], 4)]).collect()
    for stream, v, k, width in ((1, q, 6, 8), (2, h, 9, 4)):
        own = sorted((r.dist, r.asset_id) for r in got if r.stream == stream)
        y = x.astype(np.float32).astype(float)[:, :width]
        want = sorted((float(np.linalg.norm(a / np.linalg.norm(a) - v)), i) for i, a in enumerate(y) if np.linalg.norm(a) > 0)[:k]
        assert [i for _, i in own] == [i for _, i in want] and np.allclose([d for d, _ in own], [d for d, _ in want], atol=1e-6)
    assert len(got) == 15 and knn.first_vector(raw, "asset_id", 8) == pytest.approx(unit(*x[0].astype(np.float32)), abs=1e-6)
    assert sorted(ids(knn.vector_keys(raw, "asset_id", 8, first=4))) == [i for i in range(200) if i != 3] and knn.first_vector(raw.limit(0), "asset_id", 8) == []


def test_maxsim_and_anchors(spark):
    p = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.6, 0.8])], "asset_id long, v array<double>")
    assert {r.asset_id: round(r.score, 6) for r in knn.patch_maxsim(p, [[1.0, 0.0], [0.0, 1.0]]).collect()} == {1: 2.0, 2: 1.4}
    anchors = spark.createDataFrame([(7, [0.0, 1.0]), (5, [0.0, 1.0]), (6, [0.0, -1.0])], "anchor long, v array<double>")
    for block in (10_000, 1):
        got = {r.asset_id: r.anchor for r in knn.nearest_anchor(p.limit(1).unionByName(p.where("asset_id = 2")), "asset_id", anchors, 0.5, block).collect()}
        assert got == {1: None, 2: 5}
    assert knn.nearest_anchor(p, "asset_id", anchors.limit(0)).where("anchor is not null").count() == 0


# Regions


def test_dp_means_by_hand(spark):
    angle = lambda d: [float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))]
    rows = [(s, 100 * s + i, angle(d), 1.0, i) for s in (0, 1) for i, d in enumerate((0, 10, 90, 92))]
    df = spark.createDataFrame([*rows, (1, 199, [1.0], 1.0, 9), (1, 198, None, 1.0, 8)], "scope long, region_id long, v array<double>, factor double, at int")
    got = R.global_ids(R.dp_means(df, "scope", ["at"], 2)).orderBy("region_id").collect()
    assert [r.cluster_id for r in got] == [0, 0, 1, 1, 2, 2, 3, 3]
    state = R.Prototypes(2)
    exact = np.array([1 - 0.25, np.sqrt(1 - 0.75**2)])
    assert [state.add(np.array([1.0, 0.0]), 0.25), state.add(exact, 0.25)] == [0, 0]  # a distance of just tau still matches


@pytest.mark.parametrize("block", [256, 7])
def test_dp_means_equals_a_replay(spark, block, monkeypatch):
    monkeypatch.setattr(R, "ROWS_AT_ONCE", block)
    state, rng = R.Prototypes(3), np.random.default_rng(2)
    x = rng.standard_normal((400, 3))
    x[100:150] = x[:50]  # ties
    x /= np.linalg.norm(x, axis=1)[:, None]
    one = R.Prototypes(3)
    assert state.add_all(x, np.full(400, 0.1)).tolist() == [one.add(v, 0.1) for v in x] and state.counts == one.counts
    assert np.allclose(state.vectors[: len(state.counts)], one.vectors[: len(one.counts)]) and R.Prototypes(3).add_all(x[:0], x[:0, 0]).tolist() == []
    rng = np.random.default_rng(1)
    rows = [(int(s), i, unit(*rng.standard_normal(4)), float(rng.choice([0.5, 1.0, 1.4])), int(rng.integers(0, 50))) for i, s in enumerate(rng.integers(0, 3, 200))]
    df = spark.createDataFrame(rows, "scope long, region_id long, v array<double>, factor double, at int")
    got = {r.region_id: r.local_id for r in R.dp_means(df, "scope", ["at", "region_id"], 4, 0.3).collect()}
    for s in range(3):
        protos = []
        for _, i, v, factor, _ in sorted((r for r in rows if r[0] == s), key=lambda r: (r[4], r[1])):
            d = [1 - float(np.dot(p, v)) for p, _ in protos]
            k = int(np.argmin(d)) if d else -1
            if k < 0 or d[k] > 0.3 * factor:
                protos.append((np.array(v), 1))
                k = len(protos) - 1
            else:
                p, n = protos[k]
                q = (p * n + np.array(v)) / (n + 1)
                protos[k] = (q / np.linalg.norm(q), n + 1)
            assert got[i] == k


@pytest.mark.parametrize("tile,block", [(4_096, 256), (10, 7)])
def test_dp_means_leaves_far_prototypes_out(tile, block, monkeypatch):
    """Rows of 64 components: most prototypes are told apart by their outlines, with the assignments of add()."""
    monkeypatch.setattr(R, "TILE", tile)
    monkeypatch.setattr(R, "ROWS_AT_ONCE", block)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((60, 64))[rng.integers(0, 60, 900)] + 0.35 * rng.standard_normal((900, 64))
    x[500:540] = x[100:140]  # ties
    x /= np.linalg.norm(x, axis=1)[:, None]
    tau = 0.24 * rng.choice([0.5, 1.0, 1.4], 900)
    state, one, compared, within = R.Prototypes(64), R.Prototypes(64), [], R.Prototypes._within
    monkeypatch.setattr(R.Prototypes, "_within", lambda self, *a: compared.append(within(self, *a)) or compared[-1])
    got = np.r_[state.add_all(x[:333], tau[:333]), state.add_all(x[333:], tau[333:])]
    assert got.tolist() == [one.add(v, t) for v, t in zip(x, tau)] and state.counts == one.counts and len(one.counts) > 60
    assert np.allclose(state.vectors[: len(state.counts)], one.vectors[: len(one.counts)])
    assert 0 < sum(len(c[0]) for c in compared) < len(x) * len(one.counts) / 10


def test_dp_means_rows_near_a_crowd_meet_its_neighbours_only(monkeypatch):
    """Prototypes far from every crowded one are compared with rows that are far from these themselves."""
    rng = np.random.default_rng(5)
    crowds, who = rng.standard_normal((8, 64)), rng.permutation(np.r_[np.arange(3_600) % 8, np.full(900, -1)])
    x = np.where(who[:, None] < 0, rng.standard_normal((4_500, 64)), crowds[who] + 0.3 * rng.standard_normal((4_500, 64)))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tau = 0.24 * rng.choice([0.5, 1.0, 1.3], 4_500)
    pairs, within = [0], R.Prototypes._within

    def counted(self, part, limit, outlines, *rest):
        pairs[0] += len(part) * len(outlines)
        return within(self, part, limit, outlines, *rest)

    monkeypatch.setattr(R.Prototypes, "_within", counted)
    state, one = R.Prototypes(64), R.Prototypes(64)
    got = np.r_[state.add_all(x[:2_000], tau[:2_000]), state.add_all(x[2_000:], tau[2_000:])]
    assert got.tolist() == [one.add(v, t) for v, t in zip(x, tau)] and state.counts == one.counts and len(one.counts) > 900
    assert 0 < pairs[0] < len(x) * len(one.counts) / 6


@pytest.mark.parametrize("crowd,anchors,apart,drift,slack,block", [(1, 5, 1.3, 0.0, 0.4, 64), (2, 512, 0.6, 0.15, 0.0, 256), (2, 512, 0.95, 0.6, 0.4, 256), (8, 1, 0.2, 0.15, 0.05, 7)])
def test_dp_means_of_drifting_prototypes_equals_a_replay(crowd, anchors, apart, drift, slack, block, monkeypatch):
    """Prototypes that move far within a block, out of the neighbourhood of their anchors, more anchors than are kept, and thresholds beyond a
    right angle."""
    for name, value in (("CROWD", crowd), ("ANCHORS", anchors), ("APART", apart), ("DRIFT", drift), ("SLACK", slack), ("ROWS_AT_ONCE", block)):
        monkeypatch.setattr(R, name, value, raising=False)
    for seed, (dim, tau) in enumerate([(2, 0.05), (3, 0.24), (8, 0.6), (45, 1.2), (64, 0.24), (64, 2.5)]):
        rng = np.random.default_rng(seed)
        x = rng.standard_normal((20, dim))[rng.integers(0, 20, 500)] + rng.choice([0.05, 0.3, 0.8], 500)[:, None] * rng.standard_normal((500, dim))
        x[300:340] = x[100:140]  # ties
        x /= np.linalg.norm(x, axis=1)[:, None]
        limits = tau * rng.choice([0.5, 1.0, 1.4], 500)
        state, one = R.Prototypes(dim), R.Prototypes(dim)
        got = [*state.add_all(x[:200], limits[:200]), *(state.add(v, t) for v, t in zip(x[200:210], limits[200:210])), *state.add_all(x[210:], limits[210:])]
        assert got == [one.add(v, t) for v, t in zip(x, limits)] and state.counts == one.counts
        assert np.allclose(state.vectors[: len(state.counts)], one.vectors[: len(one.counts)])


def test_dp_means_runs_once_for_global_ids(spark, tmp_path):
    def logged(batches):
        for batch in batches:
            (tmp_path / str(time.monotonic_ns())).touch()
            yield batch

    rows = spark.createDataFrame([(0, 1, 0), (0, 2, 1), (2, 3, 0), (2, 4, 0)], "scope long, region_id long, local_id long").coalesce(1)
    got = R.global_ids(rows.mapInArrow(logged, rows.schema)).orderBy("region_id").collect()
    assert [tuple(r) for r in got] == [(0, 1, 0), (0, 2, 1), (2, 3, 2), (2, 4, 2)]
    assert len(list(tmp_path.iterdir())) == 1


def test_chapters_of_a_dense_timeline(spark):
    """A photo at nearly every second of a month: no photo is held against all others of its 30 days."""
    began = time.monotonic()
    day = 86_400
    photos = spark.range(300_000).select(F.col("id").alias("asset_id"), (F.col("id") * 8 - 1_000_000).alias("taken_at"))
    late = spark.createDataFrame([(-1, 1_399_992 + 30 * day), (-2, 1_399_992 + 60 * day + 1), (-2, 1_399_992 + 60 * day + 1), (-3, None)], "asset_id long, taken_at long")
    got = [tuple(r) for r in R.chapters(photos.unionByName(late)).orderBy("chapter_id").collect()]
    assert got == [(0, -1_000_000, 1_399_992 + 30 * day, 300_001), (1, 1_399_992 + 60 * day + 1, 1_399_992 + 60 * day + 1, 1)]
    assert time.monotonic() - began < 60
    assert R.chapters(photos.limit(0)).count() == 0


def test_time_relations_across_slices(spark):
    times = [5, 100, 100, 1_000, 50_000, -70, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "asset_id long, taken_at long")
    for block in (65_536, 2, 1):  # photos of one second in one block of ids and in several
        got = {r.asset_id: r.previous for r in R.previous_times(df, slice_seconds=60, id_block=block).collect()}
        assert got == {0: -70, 1: 5, 2: 100, 3: 100, 4: 1_000, 5: None}
    day = 86_400
    photos = spark.createDataFrame([(i, t * day) for i, t in enumerate((0, 29, 58, 100, 131, 131))], "asset_id long, taken_at long")
    parts = R.chapters(photos)
    assert [tuple(r) for r in parts.orderBy("chapter_id").collect()] == [(0, 0, 58 * day, 3), (1, 100 * day, 100 * day, 1), (2, 131 * day, 131 * day, 2)]
    assert {r.asset_id: r.chapter_id for r in R.with_chapter(photos, parts).collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 2, 5: 2}
    assert one(spark, *[R.time_factor(F.lit(g)) for g in (None, 299, 300, 7 * day, 7 * day + 1)]) == (1.4, 0.5, 1.0, 1.0, 1.4)


def test_boxes():
    mask = np.zeros((256, 256), bool)
    mask[100:150, 50:100] = True
    x0, y0, x1, y1, share = R.box_from_mask(mask, 1024, 512)
    assert (x0, y0, x1, y1) == (200 - 24, 200 - 12, 400 + 24, 300 + 12) and share == pytest.approx(2500 / 65536)
    assert R.box_from_mask(np.zeros((256, 256), bool), 10, 10) is None and R.box_from_mask(mask, 30, 30) is None
    b = np.array([[0, 0, 100, 100], [0, 0, 100, 100], [0, 0, 100, 86], [0, 0, 100, 84], [200, 200, 300, 300]])
    assert R.suppressed(b).tolist() == [0, 3, 4] and R.suppressed(b, 1).tolist() == [0] and R.suppressed(b[:0]).tolist() == []


def test_metrics(spark):
    rows = spark.createDataFrame([(1, 1), (1, 1), (2, 2), (2, 1), (None, 1)], "t int, p int")
    table = M.contingency(rows, "t", "p")
    assert M.purity(table).first()[0] == 0.75
    same = M.contingency(rows.where("t is not null").select("t", F.col("t").alias("p")), "t", "p")
    assert M.nmi(same).first()[0] == pytest.approx(1.0) and M.nmi(table.limit(0)).first()[0] is None
    assert [r.value for r in M.nearest_rank(spark.range(1, 101), "id", (0.5, 0.95)).orderBy("share").collect()] == [50, 95]
    ranked = spark.createDataFrame([(1, 1, 2), (1, 2, 3)], "query_id long, rank int, id long")
    labels = spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "id long, label int")
    assert M.hit_rate(ranked, labels, 2).first()[0] == 0.5


def test_kmeans_in_two_levels(spark):
    rng = np.random.default_rng(8)
    middles = np.array([[0, 0], [0, 1], [10, 0], [10, 1]], float)
    rows = [(i, (middles[i % 4] + 0.05 * rng.standard_normal(2)).tolist()) for i in range(80)]
    df = spark.createDataFrame(rows, "region_id long, v array<double>")
    placed, parents = clusters.two_levels(df, "region_id", "v", 4, 2, starts=3)
    at = {r.region_id: r.cluster for r in placed.collect()}
    assert len({at[i] for i in range(4)}) == 4 and all(at[i] == at[i % 4] for i in range(80)) and placed.agg(F.max("distance")).first()[0] < 0.3
    above = {r.cluster: r.parent for r in parents.collect()}
    assert above[at[0]] == above[at[1]] != above[at[2]] == above[at[3]]
    near = clusters.members_by_distance(placed, 2, "region_id").collect()
    assert len(near) == 8 and all(a.distance <= b.distance for a in near for b in near if a.cluster == b.cluster and a["rank"] < b["rank"])
    signed = {r.region_id: r.signature for r in clusters.signature(df, "region_id", "v", 2).collect()}
    assert math.dist(signed[0], signed[2]) == pytest.approx(math.dist(rows[0][1], rows[2][1]), abs=1e-6)


def test_queries_in_blocks_and_routing(spark):
    rng = np.random.default_rng(9)
    rows = [(i, unit(*rng.standard_normal(6))) for i in range(120)] + [(200, unit(1, 0, 0, 0, 0, 0)), (201, unit(1, 0, 0, 0, 0, 0))]
    df = spark.createDataFrame(rows, "region_id long, v array<double>")
    asked = df.where("region_id % 20 = 0")
    for block in (1_000, 2):
        got = {}
        for r in knn.nearest_many(df, asked, "region_id", 5, block).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = r.region_id
        for i, v in rows:
            if i % 20 == 0:
                want = sorted((round(math.dist(v, w), 9), j) for j, w in rows if j != i)[:5]
                assert [got[i][k] for k in range(1, 6)] == [j for _, j in want]
    assert knn.nearest_many(df, asked.limit(0), "region_id", 5).count() == 0
    reps = spark.createDataFrame([(4, unit(1, 0, 0, 0, 0, 0)), (2, unit(1, 0, 0, 0, 0, 0)), (9, unit(0, 1, 0, 0, 0, 0))], "cluster long, v array<double>")
    ask = spark.createDataFrame([(1, unit(1, 0.1, 0, 0, 0, 0)), (3, unit(0, 1, 0.2, 0, 0, 0))], "id long, v array<double>")
    assert {r.query_id: r.cluster for r in M.routed(ask, reps).collect()} == {1: 2, 3: 9}


def test_folders_prototypes_and_reindexing(spark):
    f = folders(spark, (1, "/a", None, "local", "online", 1), (5, "/b", None, "local", "offline", 2))
    wanted = spark.createDataFrame([("/b", "B"), ("/c", "C"), ("/aa", None), ("/c", None), (None, "x")], "path string, label string")
    now, found = L.folders_for(f, wanted, 9)
    assert {(r.path, r.folder_id, r.created) for r in found.collect()} == {("/b", 5, False), ("/aa", 6, True), ("/c", 7, True)} and now.count() == 4
    assert L.folders_for(f, wanted.limit(0), 9)[0].count() == 2
    a = assets(spark, asset(1), asset(2, folder=2))
    v = spark.createDataFrame([(1,), (2,), (3,)], "asset_id long")
    registry = spark.createDataFrame([(1, "active"), (2, "disabled")], "index_id int, status string")
    for scope, cleared, left in (({}, {1: 3}, {1: 0, 2: 3}), ({"folder_id": 2}, {1: 1}, {1: 2, 2: 3}), ({"ids": v.where("asset_id = 1")}, {1: 1, 2: 1}, {1: 2, 2: 2})):
        out, counts = L.reindex({1: v, 2: v}, registry, a, **scope)
        assert {r.index_id: r.cleared for r in counts.collect()} == cleared and {i: df.count() for i, df in out.items()} == left
    clusters_ = spark.createDataFrame([(2, 7, 1, [1.0], 3, 10)], schema.SCHEMAS["region_clusters"])
    new = spark.createDataFrame([(2, 7, 2, [0.5], 4, 20), (2, 8, 2, [0.1], 1, 20)], schema.SCHEMAS["region_clusters"])
    both = L.upsert_prototypes(clusters_, new)
    assert [(r.cluster_id, r.chapter_id, r.member_count, r.created_at) for r in both.orderBy("cluster_id").collect()] == [(7, 2, 4, 10), (8, 2, 1, 20)]
    assert [r.cluster_id for r in L.prototypes(L.delete_prototypes(both, new.where("cluster_id = 7")), 2).collect()] == [8]
    chapters = schema.empty(spark, "region_chapters")
    assert L.latest_chapter(chapters).count() == 0
    total = A.pending_total(assets(spark, asset(1), asset(2), asset(3, status="pending")), f, spark.createDataFrame([(1,), (2,)], "index_id int"), spark.createDataFrame([(1, 1), (3, 1), (1, 2), (1, 2)], "index_id int, asset_id long"))
    assert total.first()[0] == 2 and [r.asset_id for r in A.of_ids(a, list(range(2, 5_000))).collect()] == [2]


# Files, snapshots, streams


def png(pixels):
    import struct
    import zlib

    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 255, (40, 600, 3), dtype=np.uint8) for _ in range(2))
    root = tmp_path / "photos"
    (root / "sub").mkdir(parents=True)
    (root / "a.png").write_bytes(png(a))
    (root / "dup_of_a.png").write_bytes(png(a))
    (root / "sub/b.JPEG").write_bytes(png(b))
    (root / "broken.jpg").write_bytes(b"no picture")
    (root / "b.txt").write_bytes(b"x")
    (root / ".hidden.jpg").write_bytes(b"x")
    return root


def test_scan_and_ingest(spark, folder):
    found = files.scan(spark, str(folder))
    assert sorted(Path(r.path).name for r in found.select("path").collect()) == ["a.png", "b.JPEG", "broken.jpg", "dup_of_a.png"]
    none = schema.empty(spark, "assets")
    made = ingest(found, none, 1, 77)
    rows = {Path(r.storage_key).name: r for r in made["assets"].collect()}
    assert set(rows) == {"a.png", "b.JPEG", "broken.jpg"} and rows["broken.jpg"].status == "failed" and rows["broken.jpg"].error_code == "decode_failed"
    assert rows["a.png"].status == "ready" and (rows["a.png"].width, rows["a.png"].height) == (600, 40) and len({r.asset_id for r in rows.values()}) == 3
    assert sum(r.thumb is not None for r in rows.values()) == 2 and pixels.PlainCodec().decode(bytes(rows["a.png"].thumb)).width == 384
    stored = made["assets"].select(*none.columns)
    again = ingest(found, stored, 1, 78)
    assert again["assets"].count() == 0 and [Path(r.storage_key).name for r in again["retried"].collect()] == ["broken.jpg"]
    assert files.precheck(found, stored, 1).count() == 2 and files.directory_bytes(spark, str(folder)).first()[0] > 0
    assert {r.batch for r in files.batches(found.coalesce(1), 10**9, 2).collect()} == {0, 1}


def test_objects(spark, tmp_path):
    store = objects.ObjectStore(spark, f"file://{tmp_path}")
    store.put("aa/b.jpg", b"data")
    assert store.get("aa/b.jpg") == b"data" and store.delete("aa/b.jpg") and not store.delete("aa/b.jpg") and store.get("aa/b.jpg") is None
    for key in ("/x", "a/../b", "a b"):
        with pytest.raises(ValueError):
            store.put(key, b"")
    rows = spark.createDataFrame([("x/1.jpg", bytearray(b"one")), ("x/1.jpg", bytearray(b"one")), ("y/2.jpg", None)], "key string, data binary")
    assert [tuple(r) for r in objects.write_objects(rows, str(tmp_path)).collect()] == [("x/1.jpg", 3)] and (tmp_path / "x/1.jpg").read_bytes() == b"one"


def test_catalog_versions(spark, tmp_path):
    cat = Catalog.open(spark, f"file://{tmp_path}/lib")
    assert cat.versions() == [1] and set(cat.tables()) == set(schema.SCHEMAS)
    before = cat.tables()
    cat.commit({"assets": assets(spark, asset(1))})
    assert cat.tables()["assets"].count() == 1 and before["assets"].count() == 0 and cat.tables(1)["assets"].count() == 0
    assert Catalog.open(spark, f"file://{tmp_path}/lib").versions() == [1, 2]
    late = Catalog(spark, f"file://{tmp_path}/lib")
    late.versions = lambda: [1]
    with pytest.raises(Exception):  # noqa: B017  another writer made this version first
        late.commit({"assets": assets(spark, asset(2))})


def test_watch_sync_and_index(spark, folder, tmp_path):
    cat = Catalog.open(spark, f"file://{tmp_path}/lib")
    cat.commit({"folders": folders(spark, (1, str(folder), None, "local", "online", 1))})
    seen = []
    query = jobs.watch_folder(spark, str(folder), lambda batch, n: (seen.append(batch.count()), jobs.sync_folder(cat, str(folder), 1, 5)), str(tmp_path / "cp"), once=True)
    assert query.awaitTermination(120) or query.exception() is None
    assert sum(seen) == 4 and cat.tables()["assets"].count() == 3 and cat.tables()["fts_text"].count() == 3
    t = cat.tables()
    contents = files.hashed(files.scan(spark, str(folder))).select("sha256", "content").dropDuplicates(["sha256"])
    state = {"assets": t["assets"], "folders": t["folders"], "vectors": t["vec_assets"]}
    fresh, failed = jobs.embed_pending(state, contents, jobs.HashIndexer(1, 16))
    assert fresh.count() == 2 and failed.count() == 0
    jobs.commit_vectors(cat, fresh)
    t = cat.tables()
    assert t["vec_assets"].count() == 2
    resting = spark.createDataFrame([], "asset_id long")
    assert tuple(jobs.progress(t["assets"], t["folders"], t["vec_assets"], resting).first()) == (2, 2)
    # the same content in another folder copies its vector
    copy = assets(spark, asset(50, folder=1, sha=t["assets"].where("status = 'ready'").first().sha256))
    fresh, _ = jobs.embed_pending(state | {"assets": t["assets"].unionByName(copy), "vectors": t["vec_assets"]}, contents.limit(0), jobs.HashIndexer(1, 16))
    assert ids(fresh) == [50]
    tired = spark.createDataFrame([(50, 3)], "asset_id long, n int")
    assert jobs.embed_pending(state | {"assets": t["assets"].unionByName(copy), "vectors": t["vec_assets"]}, contents, jobs.HashIndexer(1, 16), tired)[0].count() == 0


def test_import_job_pauses_and_goes_on(spark, folder, tmp_path):
    cat = Catalog.open(spark, f"file://{tmp_path}/lib")
    job = jobs.ImportJob(cat, str(folder), 1, size=2, clock=lambda: 9)
    assert job.state() == "new"
    job.pause()
    job.start()
    with pytest.raises(RuntimeError):
        jobs.ImportJob(cat, str(folder), 1).start()
    assert job.state() == "paused"
    job.resume()
    assert job.wait(120) and job.state() == "finished" and job.done == job.total == 4 and cat.tables()["assets"].count() == 3
    stopped = jobs.ImportJob(cat, str(folder), 1)
    stopped.pause()
    stopped.start().abort()
    assert stopped.wait(60) and stopped.state() == "aborted"


def test_region_round(spark, folder):
    made = ingest(files.scan(spark, str(folder)), schema.empty(spark, "assets"), 1, 5)["assets"].drop("thumb")
    contents = files.hashed(files.scan(spark, str(folder))).select("sha256", "content").dropDuplicates(["sha256"])
    f = folders(spark, (1, str(folder), None, "local", "online", 1))
    tables = {"assets": made, "folders": f, "vectors": spark.createDataFrame([], "asset_id long"), "regions": schema.empty(spark, "regions"), "region_clusters": schema.empty(spark, "region_clusters"), "region_chapters": schema.empty(spark, "region_chapters")}
    step = lambda t: regions_.region_round(t, contents, regions_.GridSegmenter(), jobs.HashIndexer(2, 16).embed, 16, 7)
    assert step(tables) is None  # vectors of assets come first
    tables["vectors"] = made.select("asset_id")
    out = step(tables)
    rows = out["regions"].collect()
    assert {r.asset_id for r in rows} == {r.asset_id for r in made.where("status = 'ready'").collect()} and {r.region_idx for r in rows} <= {-1, 0, 1, 2, 3}
    real = [r for r in rows if r.region_idx >= 0]
    assert len({r.region_id for r in rows}) == len(rows) and out["vec_regions"].count() == len(real) and all(r.cluster_id is not None for r in real)
    assert sum(r.member_count for r in out["region_clusters"].collect()) == len(real)
    assert step(tables | {"regions": out["regions"].select(*tables["regions"].columns)}) is None
    blank = spark.createDataFrame([(1, bytearray(b"broken"))], "asset_id long, content binary")
    assert [tuple(r)[:3] for r in regions_.extracted(blank, regions_.GridSegmenter(), jobs.HashIndexer().embed).collect()] == [(1, -1, None)]


def test_workers_drain_a_library(spark, folder, tmp_path):
    (folder / "c.png").write_bytes(png(smooth(120, 160)))  # large enough for regions
    cat = Catalog.open(spark, f"file://{tmp_path}/lib")
    cat.commit({"folders": folders(spark, (1, str(folder), None, "local", "online", 1))})
    jobs.sync_folder(cat, str(folder), 1, 5)
    contents = workers.all_contents(files.scan(spark, str(folder)))
    gate = workers.Gate(cat)

    class Broken(jobs.HashIndexer):
        def embed(self, contents):
            raise RuntimeError("model")

    failing = workers.EmbeddingWorker(cat, contents, Broken(1, 16))
    for n in (1, 2, 3):  # a round that writes nothing ends the drain; failures are counted against the assets
        assert failing.drain() == 0 and {r.n for r in failing.attempts.collect()} == {n}
    assert failing.drain() == 0 and failing.attempts.where("n > 3").count() == 0  # they rest now
    worker = workers.EmbeddingWorker(cat, contents, jobs.HashIndexer(1, 16), limit=1)
    seen = workers.RegionWorker(cat, contents, regions_.GridSegmenter(), jobs.HashIndexer(2, 16).embed, 16, limit=1, clock=lambda: 7)
    assert seen.round() == 0  # vectors of assets come first
    assert gate.acquire() and not workers.Gate(cat).acquire() and worker.round() == 0 and seen.round() == 0
    gate.release()
    assert worker.drain() == 3 and cat.tables()["vec_assets"].count() == 3
    assert seen.drain() == 3 and seen.drain() == 0
    t = cat.tables()
    assert t["regions"].select("region_id").distinct().count() == t["regions"].count() > 3 and t["regions"].select("asset_id").distinct().count() == 3
    assert t["region_chapters"].where("chapter_id > 0").count() == 1
    assert t["region_clusters"].agg(F.sum("member_count")).first()[0] == t["vec_regions"].count() == t["regions"].where("region_idx >= 0").count() == 4
    stale = workers.Gate(cat, stale=-1.0)
    assert gate.acquire() and not stale.held() and stale.acquire()  # its holder has died
    stale.release()
    started = workers.EmbeddingWorker(cat, contents, jobs.HashIndexer(1, 16))
    started.seconds = 0.05
    started.start()
    assert started.stop(120) and started.error is None


def test_region_chapters_are_kept_state(spark):
    day = 86_400
    photos = spark.createDataFrame([(1, 0), (2, 10 * day), (3, 60 * day), (4, None)], "asset_id long, taken_at long")
    due = [r for r in photos.collect() if r.taken_at is not None]
    before = regions_._before(photos, due)
    assert before == {1: None, 2: 0, 3: 10 * day}
    none = schema.empty(spark, "region_chapters")
    assert regions_._chaptered(none, due, before, 5) == ({1: 1, 2: 1, 3: 2}, [(1, 0, 5), (2, 60 * day, 5)])
    kept = spark.createDataFrame([(0, 0, 0), (4, 0, 1)], none.schema)
    assert regions_._chaptered(kept, due[1:2], before, 5) == ({2: 4}, []) and regions_._chaptered(kept, due[2:], before, 5) == ({3: 5}, [(5, 60 * day, 5)])


def test_folders_are_synchronised_when_quiet(spark):
    now, done, idle = [0.0], [], [True]

    def sync(folder):
        if folder == 9 and len(done) < 2:
            raise OSError("gone")
        done.append(folder)

    watch = workers.FolderSync(sync, lambda: idle[0], 2.0, lambda: now[0])
    watch.mark(1), watch.mark(9)
    now[0] = 1.0
    watch.mark(1)
    now[0] = 2.5
    assert watch.tick() == [] and set(watch.failures) == {9}  # 1 is not quiet yet, 9 fails and is marked again
    now[0] = 3.0
    idle[0] = False
    assert watch.tick() == []
    idle[0] = True
    assert watch.tick() == [1]
    done.append(0)
    now[0] = 5.0
    assert watch.tick() == [9] and not watch.failures and not watch.dirty
    f = folders(spark, (1, "/a", None, "local", "online", 1), (2, "/b", None, "local", "offline", 2))
    assert watch.refresh(f) == [(1, "watch")] and watch.refresh(f) == []
    watch.mark(1)
    assert watch.refresh(f.where("folder_id = 2").withColumn("status", F.lit("online"))) == [(1, "unwatch"), (2, "watch")] and not watch.dirty


def test_quiet_folders(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.0), (1, 1.5), (1, 9.0), (2, 1.0)], "folder_id long, s double").select("folder_id", F.col("s").cast("timestamp").alias("ts"))
    assert sorted((r.folder_id, r.n) for r in jobs.quiet_folders(rows).collect()) == [(1, 1), (1, 2), (2, 1)]
    rows.write.parquet(str(tmp_path / "in"))
    stream = jobs.quiet_folders(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("quiet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert query.exception() is None
    time.sleep(0)


def smooth(height, width):
    y, x = np.mgrid[0:height, 0:width]
    return np.stack([128 + 100 * np.sin(x / 9), 128 + 100 * np.cos(y / 7), (x + y) % 200], -1).astype(np.uint8)


def test_jpeg_agrees_with_another_library(spark):
    """Files of the encoder are read by Java's library, files of Java's (with colour at half size) by the decoder."""
    jvm = spark.sparkContext._jvm

    def read(data):
        image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
        return image, np.array(list(image.getRGB(0, 0, image.getWidth(), image.getHeight(), None, 0, image.getWidth()))).astype(np.int64)

    def written(image):
        out = jvm.java.io.ByteArrayOutputStream()
        assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
        return bytes(out.toByteArray())

    rgb = lambda packed, shape: np.stack([packed >> 16 & 255, packed >> 8 & 255, packed & 255], -1).reshape(*shape, 3)
    for shape in ((50, 70), (16, 16), (9, 33)):
        picture = smooth(*shape)
        ours = jpeg.encode(picture)
        theirs = rgb(read(ours)[1], shape)
        assert np.abs(theirs - jpeg.decode(ours).astype(int)).max() <= 3 and np.abs(theirs - picture).mean() < 4
        back = written(read(png(picture))[0])
        assert np.abs(rgb(read(back)[1], shape) - jpeg.decode(back).astype(int)).mean() < 4
    grey = np.repeat(smooth(20, 20)[:, :, :1], 3, 2)
    assert np.abs(jpeg.decode(jpeg.encode(grey)).astype(int) - grey).mean() < 3
    for broken in (b"\xff\xd8\xff", jpeg.encode(picture)[:-200], jpeg.encode(picture).replace(b"\xff\xc0", b"\xff\xc2", 1)):
        with pytest.raises(Exception):  # noqa: B017  cut off, without a scan, or not sequential
            pixels.PlainCodec().decode(broken[:40] if len(broken) < 4 else broken)
    with pytest.raises(ValueError, match="image/heic"):
        pixels.PlainCodec().decode(b"\0\0\0\x18ftypheic" + b"\0" * 20)
    own = pixels.Codecs({"image/heic": type("C", (), {"decode": lambda self, data: pixels.Picture(grey, 4_000, 4_000, "image/heic")})()})
    assert own.decode(b"\0\0\0\x18ftypheic").width == 4_000 and own.decode(png(picture)).mime == "image/png"


def tiff(order, taken=b"2023:11:14 22:13:20\0", orientation=6):
    import struct

    inner = struct.pack(order + "HHHII", 1, 0x9003, 2, len(taken), 8 + 2 + 24 + 4 + 2 + 12 + 4) + struct.pack(order + "I", 0) + taken
    first = struct.pack(order + "HHHIHHHHII", 2, 0x0112, 3, 1, orientation, 0, 0x8769, 4, 1, 8 + 2 + 24 + 4) + struct.pack(order + "I", 0)
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + first + inner


def test_exif_of_files():
    import struct

    for order in "<>":
        block = tiff(order)
        marked = b"\xff\xd8" + struct.pack(">BBH", 0xFF, 0xE1, len(block) + 8) + b"Exif\0\0" + block + b"\xff\xda"
        chunk = png(smooth(4, 4))[:33] + struct.pack(">I", len(block)) + b"eXIf" + block + b"\0\0\0\0"
        webp = b"RIFF\0\0\0\0WEBP" + b"VP8X" + struct.pack("<I", 3) + b"abc\0" + b"EXIF" + struct.pack("<I", len(block) + 6) + b"Exif\0\0" + block
        for data in (block, marked, chunk, webp):
            assert exif.read(data) == (1_700_000_000, 6)
        assert exif.read(tiff(order, b"2023:13:14 22:13:20\0", 9)) == (None, None) and exif.read(tiff(order, b"0000:00:00 00:00:00\0", 1)) == (None, 1)
        assert all(exif.read(block[:n]) in ((None, None), (None, 6), (1_700_000_000, 6)) for n in range(len(block)))
    assert exif.read(b"") == exif.read(b"II*\0") == exif.read(png(smooth(4, 4))) == (None, None)
    assert exif.as_json(5, 6) == '{"taken_at":5,"orientation":6}' and exif.as_json(None, None) is None


def test_decoded_pictures_stand_upright(spark):
    import struct

    body = jpeg.encode(smooth(40, 500))
    block = tiff("<")
    turned = body[:2] + struct.pack(">BBH", 0xFF, 0xE1, len(block) + 8) + b"Exif\0\0" + block + body[2:]
    df = spark.createDataFrame([("a", bytearray(turned)), ("b", bytearray(body)), ("c", bytearray(b"x"))], "sha256 string, content binary")
    rows = {r.sha256: r for r in pixels.decoded(df).collect()}
    assert (rows["a"].width, rows["a"].height, rows["a"].exif_taken, rows["a"].exif) == (40, 500, 1_700_000_000, '{"taken_at":1700000000,"orientation":6}')
    assert (rows["b"].width, rows["b"].height, rows["b"].exif) == (500, 40, None) and rows["c"].error_code == "decode_failed"
    assert pixels.PlainCodec().decode(bytes(rows["a"].thumb)).pixels.shape == (384, 31, 3) and bytes(rows["a"].thumb)[:2] == b"\xff\xd8"
    assert pixels.fitted_size(768, 5) == (384, 3)


def test_pixels():
    picture = np.arange(4 * 6 * 3, dtype=np.uint8).reshape(4, 6, 3)
    codec = pixels.PlainCodec()
    assert (codec.decode(pixels.ppm(picture)).pixels == picture).all() and (codec.decode(png(picture)).pixels == picture).all()
    with pytest.raises(ValueError):
        codec.decode(b"GIF")
    assert pixels.oriented(picture, 3)[0, 0].tolist() == picture[-1, -1].tolist() and pixels.oriented(picture, 6).shape == (6, 4, 3)
    assert pixels.oriented(picture, 6)[0, -1].tolist() == picture[0, 0].tolist() and pixels.oriented(picture, 8)[-1, 0].tolist() == picture[0, 0].tolist()
    assert pixels.oriented(picture, 5)[0, 0].tolist() == picture[0, 0].tolist() and pixels.oriented(picture, 5)[1, 0].tolist() == picture[0, 1].tolist()
    assert pixels.oriented(picture, 7)[-1, -1].tolist() == picture[0, 0].tolist()
    flat = np.full((300, 500, 3), 128, np.uint8)
    assert (pixels.resized(flat, 50, 30) == 128).all() and pixels.fitted_size(2048, 1024) == (384, 192)
    x = pixels.model_input(flat)
    assert x.shape == (3, 224, 224) and x.dtype == np.float32 and np.allclose(x[0], (128 / 255 - 0.48145466) / 0.26862954, atol=1e-5)
    assert pixels.structure(picture).shape == (86,) and pixels.structure(flat)[:64].sum() == pytest.approx(8, abs=1e-3)
    assert pixels.crop(picture, (1, 1, 3, 2)).shape == (1, 2, 3) and pixels.crop(picture, (9, 9, 9, 9)) is None


def test_wordpiece(spark):
    vocabulary = {"[UNK]": 100, "sun": 1, "##set": 2, "beach": 3, "!": 4}
    assert wordpiece.pieces(" Sunset beach! moon", vocabulary) == [1, 2, 3, 4, 100]
    assert wordpiece.encode("sunset", vocabulary, 6) == [101, 1, 2, 102, 0, 0] and wordpiece.encode("  ", vocabulary) is None
    assert wordpiece.encode("sun " * 99, vocabulary, 5) == [101, 1, 1, 1, 102]
    got = spark.createDataFrame([("sun",), (None,)], "t string").select(wordpiece.encoded(F.col("t"), vocabulary, 4).alias("e")).collect()
    assert [r.e for r in got] == [[101, 1, 102, 0], None]
