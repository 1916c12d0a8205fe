"""Clustering, neighbours and deduplication of vectors against brute force; nulls, unusable vectors, copies, hot groups, empty tables."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prismara.llm import chunks, dedup, neighbours, spectral
from prismara.llm.vectors import Cells, Quantiser, kmeans

SCHEMA = "region_id long, embedding array<float>, id string, label int"
BAD = [None, [], [0.0] * 64, [float("nan")] * 64, [1.0] * 32, [float("inf")] + [0.0] * 63, [None] + [1.0] * 63]


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def ball(rng, n, spread):
    return unit(unit(rng.standard_normal(64)) + spread * unit(rng.standard_normal((n, 64))))


def table(spark, ids, vectors):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], "x", 1) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def as_float(x):
    return unit(np.asarray(x, np.float32).astype(np.float64))


def brute_groups(ids, x, least, smallest=5):
    near = as_float(x) @ as_float(x).T >= least
    seen, out = set(), {}
    for s in range(len(ids)):
        if s in seen:
            continue
        part, todo = {s}, [s]
        while todo:
            for j in np.flatnonzero(near[todo.pop()]):
                if int(j) not in part:
                    part.add(int(j))
                    todo.append(int(j))
        seen |= part
        group = sorted(part)
        if len(group) >= smallest and near[np.ix_(group, group)].all():
            key = min(ids[i] for i in group)
            out |= {ids[i]: key for i in group}
    return out


@pytest.fixture(scope="module")
def grouped():
    rng = np.random.default_rng(2)
    parts = [ball(rng, n, 0.38) for n in (5, 6, 4, 30, 120, 300, 2)]
    loose = [ball(rng, 12, 0.95)]  # connected, but not all pairs are alike
    chain = unit(np.stack([np.cos(a) * np.eye(64)[0] + np.sin(a) * np.eye(64)[1] for a in np.linspace(0, 2, 8)]))
    x = np.vstack([*parts, *loose, chain, unit(rng.standard_normal((150, 64)))])
    ids = [int(i) for i in rng.permutation(len(x) * 3)[: len(x)]]
    return ids, x


def test_groups_equal_brute_force(spark, grouped):
    ids, x = grouped
    df = table(spark, [*ids, *ids[:40], *range(10_000, 10_007), None], [*x, *x[:40], *BAD, x[0]])
    got = {r.id: r.cluster_key for r in spectral.found(df, "region_id", "embedding", 0.77).collect()}
    assert got == brute_groups(ids, x, 0.77) and len(got) > 400


def test_groups_outside_the_sample_are_found(spark, grouped, monkeypatch):
    ids, x = grouped
    monkeypatch.setattr(spectral, "LANDMARK_SAMPLE", 40)
    monkeypatch.setattr(spectral, "ROOM", 64)
    got = {r.id: r.cluster_key for r in spectral.found(table(spark, ids, x), "region_id", "embedding", 0.77).collect()}
    want = brute_groups(ids, x, 0.77)
    assert all(want.get(i) == k for i, k in got.items()) and len(got) >= 0.9 * len(want)


def lumps(rng, n):
    """Two lumps of six clumps of n rows each: similarities are about 0.99 in a clump, 0.885 in a lump and 0.8 across, so the four best
    landmarks of every row lie in its own lump."""
    basis = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    middles = np.sqrt(0.95) * basis[0] + np.sqrt(0.05) * np.array([[1.0], [-1.0]]) * basis[1]
    clumps = np.sqrt(0.885) * np.repeat(middles, 6, 0) + np.sqrt(0.115) * basis[2:14]
    return unit(clumps[:, None] + 0.04 * unit(rng.standard_normal((12, n, 64)))).reshape(-1, 64)


def test_a_sound_group_of_two_lumps_is_one(spark):
    rng = np.random.default_rng(21)
    x = np.vstack([lumps(rng, 40), lumps(rng, 6), unit(rng.standard_normal((60, 64)))])
    ids = [int(i) for i in rng.permutation(len(x))]
    want = brute_groups(ids, x, 0.77)
    assert len(want) == 552 and len(set(want.values())) == 2
    assert {r.id: r.cluster_key for r in spectral.found(table(spark, ids, x), "region_id", "embedding", 0.77).collect()} == want


def test_groups_outside_the_sample_are_all_found(spark, monkeypatch):
    rng = np.random.default_rng(23)
    x = np.vstack([*[ball(rng, 5, 0.48) for _ in range(150)], np.repeat(ball(rng, 2, 0.3), 12, 0), unit(rng.standard_normal((2_000, 64)))])
    ids = [int(i) for i in rng.permutation(len(x))]
    monkeypatch.setattr(spectral, "LANDMARK_SAMPLE", 20)
    want = brute_groups(ids, x, 0.77)
    assert len(want) > 500
    assert {r.id: r.cluster_key for r in spectral.found(table(spark, ids, x), "region_id", "embedding", 0.77).collect()} == want


def test_labels_of_sound_groups_stand_still(spark, monkeypatch):
    rng = np.random.default_rng(22)
    seen, iterate = [], spectral._iterate
    monkeypatch.setattr(spectral, "_iterate", lambda edges: seen.append(iterate(edges)) or seen[0])
    x = lumps(rng, 200)
    joint = unit(unit(x[:1200:40] + x[1200::40]) + 0.04 * unit(rng.standard_normal((30, 64))))  # few rows bridge the lumps
    x = np.vstack([x, joint])
    clusters = spectral.Clusters(table(spark, range(len(x)), x), "region_id", "embedding", 0.77)
    values = np.array([r[1:] for r in seen[0].collect()])
    assert len(values) >= 12 and np.ptp(values, axis=0).max() < 1e-6 and clusters.groups.count() == 1


def test_groups_of_copies_and_nothing(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([np.repeat(ball(rng, 1, 0.1), 900, 0), ball(rng, 7, 0.4)])
    got = {r.id: r.cluster_key for r in spectral.found(table(spark, range(len(x)), x), "region_id", "embedding", 0.77).collect()}
    assert got == {**{i: 0 for i in range(900)}, **{i: 900 for i in range(900, 907)}}
    assert spectral.found(table(spark, [], []), "region_id", "embedding", 0.77).count() == 0
    assert spectral.found(table(spark, range(len(BAD)), BAD), "region_id", "embedding", 0.77).count() == 0


def around(rng, axis, degrees):
    """Unit vectors at these angles to the axis, in random directions."""
    side = rng.standard_normal((len(degrees), 64))
    side -= (side @ axis)[:, None] * axis
    side /= np.linalg.norm(side, axis=1)[:, None]
    t = np.radians(degrees)[:, None]
    return (np.cos(t) * axis + np.sin(t) * side).astype(np.float32)


def test_few_rows_of_a_wide_group_are_compared(spark, monkeypatch):
    """Of two members that are apart one has half of the angle at least, so members inside that are not rows of the comparison."""
    rng = np.random.default_rng(3)
    axes = np.linalg.qr(rng.standard_normal((64, 3)))[0].T
    degrees = np.clip(rng.normal(19.2, 0.3, 400), 18, 20.4)
    degrees[0] = 20.4
    sound, other = around(rng, axes[0], degrees), around(rng, axes[1], degrees)
    other[0], other[1] = (np.cos(np.radians(t)) * axes[1] + np.sin(np.radians(t)) * axes[2] for t in (20.4, -19.5))  # 39.9 degrees apart
    seen, write = {}, spectral.materialise
    monkeypatch.setattr(spectral, "materialise", lambda df, label: seen.setdefault(label, write(df, label)) if label == "unclear" else write(df, label))
    got = {r.id: r.cluster_key for r in spectral.found(table(spark, range(800), np.vstack([sound, other])), "region_id", "embedding", 0.77).collect()}
    assert got == {i: 0 for i in range(400)}
    assert 0 < seen["unclear"].count() < 160  # 800 rows, most of them open by t + r alone


@pytest.mark.parametrize("tile,most_open", [(1024, 16), (7, 16), (50, 10**9)])
def test_comparisons_equal_whole_products(tile, most_open, monkeypatch):
    monkeypatch.setattr(spectral, "TILE", tile)
    monkeypatch.setattr(spectral, "MOST_OPEN", most_open)
    rng = np.random.default_rng(5)
    x, y = around(rng, np.eye(64)[0], rng.uniform(0, 80, 90)), around(rng, np.eye(64)[0], rng.uniform(0, 80, 130))
    y[3], y[4] = x[8], -x[9]
    least, dots = 0.77, x.astype(float) @ y.T.astype(float)
    got = {(int(a), int(b)) for i, j in spectral._pairs(x, y, least) for a, b in zip(i, j)}
    assert got == set(zip(*(v.tolist() for v in np.nonzero(dots >= least)))) and len(got) > 100
    assert list(spectral._pairs(x[:0], y, least)) == []
    verdicts = set()
    for case in range(60):
        spread = rng.choice([15.0, 19.0, 19.8, 20.3])
        y = around(rng, np.eye(64)[1], rng.uniform(0, spread, 40))
        near = rng.choice([45.0, 58.0, 70.0])
        x = np.vstack([y[:20], around(rng, np.eye(64)[1], rng.uniform(near, 80, 15))])
        if case % 3 == 0:  # two members at the border itself, or apart
            t = np.arccos(least) / 2 + rng.choice([-1e-3, 1e-3])
            x[0] = y[0] = np.cos(t) * np.eye(64)[1] + np.sin(t) * np.eye(64)[2]
            y[1] = x[1] = np.cos(t) * np.eye(64)[1] - np.sin(t) * np.eye(64)[2]
        own, ids = np.arange(35) < 20, np.r_[np.arange(20), 100 + np.arange(15)]
        dots = x.astype(float) @ y.T.astype(float)
        wrong = np.where(own[:, None], dots < least, dots >= least) & (ids[:, None] != np.arange(40))
        for form in (spectral._exact, spectral._small):
            (sx, cx), (sy, cy) = form(x), form(y)
            a = pa.table({"label": pa.array([7] * 35), "id": ids, "small": sx, "scale": cx, "own": own})
            b = pa.table({"label": pa.array([7] * 40), "id": np.arange(40), "small": sy, "scale": cy})
            out = spectral._judge(least)(a, b).column("id").to_pylist()
            if form is spectral._exact:
                assert out == ([None] if wrong.any() else [])
            elif out == [None]:
                assert wrong.any()
            else:
                assert set(ids[wrong.any(1)].tolist()) <= set(out)
            verdicts.add((form.__name__, out == [None], not out))
    assert len(verdicts) >= 4


def test_description_ranks_by_internal_affinity(spark, grouped):
    ids, x = grouped
    rows = spectral.described(table(spark, ids, x), "region_id", "embedding", 0.77).collect()
    groups = {}
    for i, k in brute_groups(ids, x, 0.77).items():
        groups.setdefault(k, []).append(i)
    place = {i: p for p, i in enumerate(ids)}
    for key, members in groups.items():
        own = sorted((r for r in rows if r.cluster_key == key), key=lambda r: r["rank"])
        v = as_float(x[[place[i] for i in members]])
        mean = ((v @ v.T).sum(1) - 1) / (len(v) - 1)
        assert own[0].n == len(members) and len(own) == min(3, len(members))
        assert own[0].affinity == pytest.approx(mean.max(), abs=2e-6)


def brute_pairs(ids, x, least):
    v = as_float(x)
    sim = v @ v.T
    np.fill_diagonal(sim, -2)
    lists = {}
    for i, a in enumerate(ids):
        order = sorted(range(len(ids)), key=lambda j: (-round(sim[i, j], 9), ids[j]))[:10]
        lists[a] = {ids[j] for j in order if sim[i, j] >= least}
    return {(a, b) for a in ids for b in lists[a] if a < b and a in lists[b]}


@pytest.fixture(scope="module")
def close():
    rng = np.random.default_rng(6)
    base = np.vstack([ball(rng, 500, 0.42), unit(rng.standard_normal((300, 64)))])
    noisy = unit(base[::3] + 0.12 * unit(rng.standard_normal((len(base[::3]), 64))))
    dense = ball(rng, 25, 0.05)
    x = np.vstack([base, noisy, dense])
    return [int(i) for i in rng.permutation(5_000)[: len(x)]], x


@pytest.mark.parametrize("per_cell,local", [(1_500, 6_000), (40, 6_000), (2_000, 100)])
def test_neighbours_reach_the_stated_recall(spark, close, per_cell, local, monkeypatch):
    monkeypatch.setattr(neighbours, "LOCAL", local)
    monkeypatch.setattr(neighbours, "SPLIT", 60)
    ids, x = close
    df = table(spark, [*ids, *ids[:30], *range(9_000, 9_007), None], [*x, *x[:30], *BAD, x[0]])
    got = {(r.a, r.b) for r in neighbours.mutual(neighbours.similar_pairs(df, "region_id", "embedding", 0.985, per_cell)).collect()}
    want = brute_pairs(ids, x, 0.985)
    assert len(want) > 200 and len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_neighbours_of_copies_and_nothing(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([np.repeat(ball(rng, 1, 0.1), 3_000, 0), unit(rng.standard_normal((50, 64)))])
    got = {(r.a, r.b) for r in neighbours.mutual(neighbours.similar_pairs(table(spark, range(len(x)), x), "region_id", "embedding", 0.985)).collect()}
    # of copies, the ten smallest others: 0 to 9 name each other and 10, 10 names 0 to 9
    assert got == {(a, b) for a in range(11) for b in range(a + 1, 11)}
    assert neighbours.similar_pairs(table(spark, [], []), "region_id", "embedding", 0.985).count() == 0
    assert neighbours.similar_pairs(table(spark, range(len(BAD)), BAD), "region_id", "embedding", 0.985).count() == 0


@pytest.mark.parametrize("per_task", [50_000, 900])
def test_near_copies_in_one_cell(spark, per_task, monkeypatch):
    """Thousands of distinct near copies: every pair is similar enough, so all of them are candidates of each other."""
    monkeypatch.setattr(neighbours, "PER_TASK", per_task)
    rng = np.random.default_rng(31)
    x = np.vstack([ball(rng, 3_000, 0.05), unit(rng.standard_normal((100, 64)))])
    ids = [int(i) for i in rng.permutation(len(x))]
    got = {(r.a, r.b) for r in neighbours.mutual(neighbours.similar_pairs(table(spark, ids, x), "region_id", "embedding", 0.985, 4_000)).collect()}
    v = as_float(x)
    best = {}
    for s in range(0, len(v), 500):
        sim = v[s : s + 500] @ v.T
        sim[np.arange(len(sim)), np.arange(s, s + len(sim))] = -2
        top = np.argpartition(-sim, 10, axis=1)[:, :10]
        best |= {ids[s + i]: {ids[j] for j in t if sim[i, j] >= 0.985} for i, t in enumerate(top)}
    want = {(a, b) for a in ids for b in best[a] if a < b and a in best[b]}
    assert len(want) > 5_000 and len(got & want) >= 0.999 * len(want) and len(got - want) <= 0.001 * len(want)


def test_memory_of_a_cell_of_near_copies():
    import tracemalloc

    rng = np.random.default_rng(32)
    x = ball(rng, 6_000, 0.05).astype(np.float32)
    quantiser = Quantiser.train(x[:1_000], 1, neighbours.BOOKS, neighbours.WORDS)
    shared = type("Shared", (), {"value": (quantiser, np.ones(1, np.int64))})
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), pa.array(list(x), pa.list_(pa.float32()))], ["id", "v"])
    rows = pa.Table.from_batches(list(neighbours._encoder(shared, 0.03)(iter([batch]))))
    tracemalloc.start()
    found = neighbours._searcher(shared, 0.985, 0.03)(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows >= 10 * len(x) and peak < 300_000_000


@pytest.mark.parametrize("per_cell,per_task", [(2_000, 50_000), (60, 40)])
def test_nearest_of_a_query_set(spark, close, per_cell, per_task, monkeypatch):
    monkeypatch.setattr(neighbours, "PER_TASK", per_task)
    ids, x = close
    df = table(spark, [*ids, *ids[:30], *range(9_000, 9_007), None], [*x, *x[:30], *BAD, x[0]])
    asked = df.where(F.col("region_id") % 20 == 0)
    rows = neighbours.nearest(df, asked, "region_id", "embedding", 5, 8, per_cell).collect()
    v, place = as_float(x), {i: p for p, i in enumerate(ids)}
    wanted = [i for i in ids if i % 20 == 0]
    got = {}
    for r in rows:
        got.setdefault(r.id, {})[r["rank"]] = r.neighbour
        assert r.sim == pytest.approx(float(v[place[r.id]] @ v[place[r.neighbour]]), abs=2e-6) and r.id != r.neighbour
    assert set(got) == set(wanted) and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    sim = v @ v.T
    np.fill_diagonal(sim, -2)
    hits = [len(set(got[i].values()) & {ids[j] for j in np.argsort(-sim[place[i]])[:5]}) for i in wanted]
    assert sum(hits) >= 0.95 * 5 * len(wanted)
    assert neighbours.nearest(df.limit(0), asked, "region_id", "embedding").count() == 0


def test_beam_search_encodes_closer_than_one_path():
    rng = np.random.default_rng(9)
    x = np.vstack([ball(rng, 400, 0.5) for _ in range(5)]).astype(np.float32)
    quantiser = Quantiser.train(x, 5, 8, 16)
    home = quantiser.cells.homes(x)
    error = [((x - quantiser.decode(home, quantiser.encode(x - quantiser.cells.centres[home], beam))) ** 2).sum() for beam in (1, 8)]
    assert error[1] < error[0] < ((x - quantiser.cells.centres[home]) ** 2).sum()
    assert isinstance(quantiser.cells, Cells) and len(kmeans(x, 3, 2, 0)) == 3


HASH = "a" * 64
RECORD = "asset_id long, folder_id long, sha256 string, embedding array<float>, content string, vec int"


def record_rows(spark, rows):
    return spark.createDataFrame([(i, f, h, None if v is None else [None if c is None else float(c) for c in v], "x", 1) for i, f, h, v in rows], RECORD)


def parts(spark, held, came):
    h, c = (record_rows(spark, r) for r in (held, came))
    return dedup.records(h, "asset_id", "folder_id", "sha256", "embedding", False), dedup.records(c, "asset_id", "folder_id", "sha256", "embedding", True)


def test_hash_notations(spark):
    raw = "E80FC355fef30dc5f276fad98f1ed60945e97111795595bf1b7c9d09b5a4cabd"
    forms = [raw, raw.lower(), f"sha256:{raw}", f"SHA-256={raw}", f"0x{raw}", ":".join(raw[i : i + 2] for i in range(0, 64, 2)), f" {raw} "]
    got = spark.createDataFrame([(f,) for f in forms], "s string").select(dedup.canonical_hash(F.col("s")).alias("h")).collect()
    assert {r.h for r in got} == {raw.lower()}
    odd = spark.createDataFrame([("", ), (None,), ("Not-A-Hash",)], "s string").select(dedup.canonical_hash(F.col("s")).alias("h")).collect()
    assert [r.h for r in odd] == [None, None, "not-a-hash"]


def brute_repeats(held, came, least):
    rows = [(i, f, h, v, 0) for i, f, h, v in held] + [(i, f, h, v, 1) for i, f, h, v in came]
    good = lambda v: v is not None and len(v) == 64 and all(c is not None for c in v) and np.isfinite(v).all() and np.abs(v).max() > 0
    out = {}
    for b, fb, hb, vb, kb in rows:
        for a, fa, ha, va, ka in rows if kb else ():
            if None in (a, b, fb) or a == b or fa != fb or (ka and a > b):
                continue
            same = hb is not None and ha is not None and ha.lower().removeprefix("sha256:") == hb.lower().removeprefix("sha256:")
            if same or (good(va) and good(vb) and float(as_float(va) @ as_float(vb)) >= least):
                out[b] = min(out.get(b, a), a)
    return out


@pytest.fixture(scope="module")
def batches():
    rng = np.random.default_rng(12)
    base = ball(rng, 120, 0.4)
    near = lambda v: unit(v + 0.09 * unit(rng.standard_normal(64)))
    sha = lambda i: f"{i:064x}"
    held = [(i, int(rng.integers(1, 4)), sha(i), base[i]) for i in range(100)] + [(200 + i, 1, sha(900 + i), v) for i, v in enumerate(BAD)] + [(300, None, sha(1), base[1])]
    came = [(1_000 + i, int(rng.integers(1, 4)), sha(int(rng.integers(0, 400))), near(base[rng.integers(0, 120)])) for i in range(150)]
    came += [(1_200 + i, 1, f"SHA256:{sha(i).upper()}" if i % 2 else None, v) for i, v in enumerate(BAD)] + [(1_300, None, sha(2), base[2]), (None, 1, sha(3), base[3])]
    hot = ball(rng, 60, 0.1)
    came += [(2_000 + i, 2, None, v) for i, v in enumerate(hot)] + [(2_100 + i, 3, None, base[5]) for i in range(40)]
    return held, [*came, *came[:20]]


@pytest.mark.parametrize("hot,marked,sent", [(256, 4_000_000, 1_000_000), (2, 4_000_000, 1_000_000), (256, 4_000_000, 3), (256, 10, 3), (2, 10, 3)])
def test_repeats_equal_brute_force(spark, batches, hot, marked, sent, monkeypatch):
    """Hot chunks and cool ones, keys sent to the tasks and keys joined in a shuffle: the same rows."""
    monkeypatch.setattr(dedup, "MARKED", marked)
    monkeypatch.setattr(dedup, "SENT", sent)
    held, came = batches
    got = {r.asset_id_b: r.asset_id_a for r in dedup.repeats(*parts(spark, held, came), 0.985, hot).collect()}
    want = brute_repeats(held, came, 0.985)
    agree = sum(got.get(b) == a for b, a in want.items())
    assert len(want) > 150 and agree >= 0.98 * len(want) and set(got) <= set(want)


def test_history_takes_batches_one_by_one(spark, batches):
    held, came = batches
    came = sorted({r[0]: r for r in came if r[0] is not None}.values(), key=lambda r: r[0])
    whole = {r.asset_id_b: r.asset_id_a for r in dedup.repeats(*parts(spark, held, came), 0.985).collect()}
    history = dedup.History(spark)
    history.accept(parts(spark, held, [])[0], arriving=False)
    got = {}
    for s in range(0, len(came), 90):
        got |= {r.asset_id_b: r.asset_id_a for r in history.accept(parts(spark, [], came[s : s + 90])[1]).collect()}
    assert got == whole


def test_history_goes_on_where_it_ended(spark, batches, tmp_path):
    held, came = batches
    came = sorted({r[0]: r for r in came if r[0] is not None}.values(), key=lambda r: r[0])
    whole = {r.asset_id_b: r.asset_id_a for r in dedup.repeats(*parts(spark, held, came), 0.985).collect()}
    path = f"file://{tmp_path}/history"
    dedup.History(spark, path).accept(parts(spark, held, [])[0], arriving=False)
    spark.range(3).write.parquet(f"{path}/classes-1")  # of an append that broke off before its chunks
    history = dedup.History(spark, path)
    assert history.parts == 1
    got = {r.asset_id_b: r.asset_id_a for r in history.accept(parts(spark, [], came)[1]).collect()}
    assert got == whole and dedup.History(spark, path).parts == 2


def test_history_joins_its_parts(spark, batches, monkeypatch):
    monkeypatch.setattr(dedup, "COMPACT", 2)
    held, came = batches
    came = sorted({r[0]: r for r in came if r[0] is not None}.values(), key=lambda r: r[0])
    whole = {r.asset_id_b: r.asset_id_a for r in dedup.repeats(*parts(spark, held, came), 0.985).collect()}
    history = dedup.History(spark)
    history.accept(parts(spark, held, [])[0], arriving=False)
    got = {r.asset_id_b: r.asset_id_a for r in history.accept(parts(spark, [], came[:100])[1]).collect()}
    again = dedup.History(spark, history.path)
    assert again.joined == again.parts == 2 and len(again._read("classes").inputFiles()) < 20
    assert again._read("classes").groupBy("cid").count().where("count > 1").count() == 0
    got |= {r.asset_id_b: r.asset_id_a for r in again.accept(parts(spark, [], came[100:])[1]).collect()}
    assert got == whole


def test_a_batch_reads_what_it_touches(spark, batches):
    """The rows that a batch groups and compares depend on the batch, not on the length of the history."""
    rng = np.random.default_rng(41)
    x = unit(rng.standard_normal((2_000, 64)))
    came = [(50_000 + i, 1, None, v) for i, v in enumerate(x[:20])]
    met = []
    for n in (200, 2_000):
        history = dedup.History(spark)
        history.accept(parts(spark, [(i, 1, None, v) for i, v in enumerate(x[:n])], [])[0], arriving=False)
        seen, label = [], dedup.materialise
        dedup.materialise = lambda df, name: seen.append((name, label(df, name))) or seen[-1][1]
        try:
            assert history.accept(parts(spark, [], came)[1]).count() == 20
        finally:
            dedup.materialise = label
        met.append(dict(seen)["merged"].count())
    assert 20 <= met[0] < 30 and met[1] < 60  # some chunk agrees by chance


def test_shifted_content_shares_most_chunks():
    rng = np.random.default_rng(40)
    text = rng.integers(0, 4, (50, 3_000)).astype(np.uint32)
    shifted = np.concatenate([rng.integers(0, 4, (50, 7)).astype(np.uint32), text[:, :1_000], text[:, 1_001:]], 1)
    rows, marks = chunks.chunks(text)
    for r in range(50):
        own, other = set(marks[rows == r]), set(chunks.chunks(shifted[r : r + 1])[1])
        assert len(own & other) >= 0.9 * len(own)
    assert len(chunks.chunks(text[:, :5])[0]) == 0 and len(chunks.chunks(text[:0])[0]) == 0


def test_repeats_of_nothing(spark):
    assert dedup.repeats(*parts(spark, [], []), 0.985).count() == 0
    assert dedup.repeats(*parts(spark, [(1, 1, HASH, None)], []), 0.985).count() == 0
    assert dedup.repeats(*parts(spark, [], [(2, 1, HASH, None), (3, 1, HASH, None)]), 0.985).collect()[0].asset_id_a == 2
