"""Groups of similar vectors by power-iteration spectral clustering.

Affinities. Landmarks come from a bounded sample (``vectors.SAMPLE`` rows at most): leaders no two of which have similarity ``LEADER`` or
more. Each vector has affinities to its ``ANCHORS`` most similar landmarks of similarity ``least`` or more, so affinities are sparse
and their number grows as the rows do. Vectors without a landmark (small groups, single vectors) are compared with each other, all
pairs in blocks; each is linked to its hub, the smallest key among itself and all vectors of similarity ``least`` or more. This is
exact and costs the square of the number of these vectors.

Hubs. A landmark's four-anchor links say nothing of the landmarks that share no row with it, so each landmark also gives half of its
weight to its hub, the first of all landmarks with similarity ``least`` or more to it. Landmarks are rows themselves: those of a sound
group all have one hub, and none outside the group, so however the group is built inside, its landmarks have one label.

Iteration. Both kinds of link make one graph of landmarks and unlandmarked vectors; its affinities are divided by the degree, and
``VECTORS`` random vectors are multiplied by that matrix, as DataFrames, until they stand still: then each is constant on a
connected group. The rows of that embedding are divided by k-means: the occupied cells of a fine grid are the seeds, every node goes to
its nearest centre, centres move to the mean of their nodes, and so on until no node changes. How many groups there are is thus not asked
beforehand. A vector follows its strongest landmark.

Standing still. In a sound group every node gives half of its weight or more to one common hub, so each product at least halves what
values in the group differ by: after 24 products they agree within 1.2e-7, after STEPS * ROUNDS = 48 within 1e-14, far below GRID. What
still moves then lies in a group that is not connected through one hub, hence not sound; each of its parts has an outsider too near.

Exactness. A group counts if any two members have at least ``least`` and no member has that to an outsider. That is checked for all rows
in time proportional to rows times groups: with a the angle of ``least``, t the angle of a member to the group's centre and r the largest
t, members with t + r <= a are as close as needed to all others, and an outsider at more than a + r from the centre is apart from all.
Only what these bounds leave open is compared pair by pair, in blocks.

Members are ranked by internal affinity, the mean similarity to the other members, which is a product with the group's sum.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prismara.llm.vectors import DIM, matrix, pack, sample, unpack
from prismara.storage import materialise, release

LEADER = 0.9
LANDMARK_SAMPLE = 16_384
ANCHORS = 4
VECTORS = 8
STEPS, ROUNDS, STILL = 8, 6, 1e-6
GRID, BORDER, ALIKE, LLOYD = 1e-3, 0.1, 6, 50
ROOM, LEAST_BLOCKS = 65_536, 6
BLOCK, ROWS = 2_048, 8_192
#: Components of the filter, rows of a tile, and the share of a tile (one in so many) from which the filter gives way to whole products.
HEAD, TILE, MOST_OPEN = 40, 1_024, 16
CENTRES = 20_000
FLOAT_ERROR = 1e-5


def unit_vectors(df: DataFrame, key: str, column: str) -> DataFrame:
    """(id, vec) of the usable vectors, one for each key, as unit vectors in little-endian float32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = matrix(batch.column(1))
            if len(rows):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pack(x)], ["id", "vec"])

    rows = df.select(F.col(key).cast("long").alias("id"), F.col(column).alias("v")).where(F.col("id").isNotNull() & (F.size("v") == DIM))
    return rows.mapInArrow(run, "id long, vec binary").groupBy("id").agg(F.min("vec").alias("vec"))


def leaders(x: np.ndarray, least: float) -> np.ndarray:
    """Rows in order, each left out if an earlier leader has similarity ``least`` or more to it."""
    chosen = np.zeros((0, x.shape[1]), np.float32)
    for s in range(0, len(x), 256):
        block = x[s : s + 256]
        if len(chosen):
            block = block[(block @ chosen.T).max(1) < least]
        own: list[int] = []
        near = block @ block.T
        for i in range(len(block)):
            if not own or near[i, own].max() < least:
                own.append(i)
        chosen = np.vstack([chosen, block[own]])
    return chosen


def _anchored(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks: np.ndarray = shared.value
        k = min(ANCHORS, len(marks))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unpack(batch.column(1))
            top, sim = np.empty((len(x), k), np.int32), np.empty((len(x), k), np.float32)
            for s in range(0, len(x), 1024):
                near = x[s : s + 1024] @ marks.T
                best = np.argpartition(near, -k, axis=1)[:, -k:] if k < len(marks) else np.tile(np.arange(k), (len(near), 1))
                value = np.take_along_axis(near, best, 1)
                order = np.argsort(-value, axis=1, kind="stable")
                top[s : s + 1024], sim[s : s + 1024] = np.take_along_axis(best, order, 1), np.take_along_axis(value, order, 1)
            keep = sim >= least
            i, j = np.nonzero(np.abs(sim - least) < FLOAT_ERROR)
            keep[i, j] = np.einsum("ij,ij->i", x[i].astype(np.float64), marks[top[i, j]].astype(np.float64)) >= least
            counts = keep.sum(1)
            offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
            anchors = pa.ListArray.from_arrays(offsets, pa.array(top[keep]))
            weights = pa.ListArray.from_arrays(offsets, pa.array(sim[keep]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), anchors, weights], ["id", "vec", "anchors", "weights"])

    return run


def _landmark_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Affinities of landmarks through the rows they share, summed per batch. Landmark a is node -(a + 1)."""
    for batch in batches:
        lengths = batch.column(0).value_lengths().to_numpy()
        flat, weight = batch.column(0).flatten().to_numpy().astype(np.int64), batch.column(1).flatten().to_numpy().astype(np.float64)
        starts = np.cumsum(lengths) - lengths
        weight = weight / np.repeat(np.add.reduceat(weight, starts), lengths) if len(flat) else weight
        sources, targets, values = [], [], []
        for i in range(ANCHORS):
            for j in range(ANCHORS):
                both = np.flatnonzero(lengths > max(i, j))
                sources.append(flat[starts[both] + i])
                targets.append(flat[starts[both] + j])
                values.append(weight[starts[both] + i] * weight[starts[both] + j])
        pair = np.concatenate(sources) << 32 | np.concatenate(targets)
        unique, place = np.unique(pair, return_inverse=True)
        total = np.bincount(place, np.concatenate(values))
        yield pa.RecordBatch.from_arrays([pa.array(-(unique >> 32) - 1), pa.array(-(unique & 0xFFFFFFFF) - 1), pa.array(total)], ["i", "j", "w"])


def _at_least(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Where rows of x have similarity ``least`` or more to rows of y; what float32 leaves open is computed in double."""
    near = x @ y.T
    out = near >= least
    i, j = np.nonzero(np.abs(near - least) < FLOAT_ERROR)
    for s in range(0, len(i), 65_536):
        a, b = i[s : s + 65_536], j[s : s + 65_536]
        out[a, b] = np.einsum("ij,ij->i", x[a].astype(np.float64), y[b].astype(np.float64)) >= least
    return out


def _split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first HEAD components of each row, and the length of the rest: a product of two rows differs from that of their heads by at most
    the product of these lengths."""
    return x[:, :HEAD], np.sqrt(np.einsum("ij,ij->i", x[:, HEAD:], x[:, HEAD:]))


def _marked(flags: np.ndarray) -> np.ndarray:
    """Flat places of the few true flags, by words of eight."""
    flat = flags.reshape(-1)
    if len(flat) % 8:
        return np.flatnonzero(flat)
    words = np.flatnonzero(flat.view(np.uint64))
    at = (words[:, None] * 8 + np.arange(8)).reshape(-1)
    return at[flat[at]]


def _pairs(x: np.ndarray, y: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all rows of x and y with similarity ``least`` or more, tile by tile. Pairs that the heads and the lengths of the
    rests already tell apart are left there; the others are computed in double."""
    (hx, tx), (hy, ty) = _split(x), _split(y)
    left, right = np.column_stack([hx, tx]), np.column_stack([hy, ty])
    floor = np.float32(least - FLOAT_ERROR)
    for r in range(0, len(x), TILE):
        for c in range(0, len(y), TILE):
            near = left[r : r + TILE] @ right[c : c + TILE].T >= floor
            if np.count_nonzero(near) * MOST_OPEN > near.size:
                i, j = np.nonzero(_at_least(x[r : r + TILE], y[c : c + TILE], least))
            else:
                i, j = np.divmod(_marked(near), near.shape[1])
                sure = np.einsum("ij,ij->i", x[r + i].astype(np.float64), y[c + j].astype(np.float64)) >= least
                i, j = i[sure], j[sure]
            if len(i):
                yield i + r, j + c


def _hubs(shared, least: float):
    """(i, j): each landmark and its hub, the first of all landmarks that have similarity ``least`` or more to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks: np.ndarray = shared.value
        for batch in batches:
            rows = batch.column(0).to_numpy()
            hub = rows.copy()
            for s in range(0, len(rows), 256):
                own = rows[s : s + 256]
                open_ = np.arange(len(own))
                for b in range(0, len(marks), BLOCK):
                    near = _at_least(marks[own[open_]], marks[b : b + BLOCK], least)
                    met = near.any(1)
                    hub[s + open_[met]] = np.minimum(own[open_[met]], b + near[met].argmax(1))
                    open_ = open_[~met]
                    if not len(open_):
                        break
            yield pa.RecordBatch.from_arrays([pa.array(-rows - 1), pa.array(-hub - 1)], ["i", "j"])

    return run


def _firsts(least: float):
    """Cogroup of two blocks of rows, which may be one: for each row with others of similarity ``least`` or more, the smallest of their ids."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if a.num_rows and b.num_rows:
            sides = []
            for t in (a, b):
                ids = t.column("id").to_numpy()
                order = np.argsort(ids)
                sides.append((ids[order], unpack(t.column("vec").combine_chunks())[order]))
            (ids, x), (others, y) = sides
            none = np.iinfo(np.int64).max
            best, back = np.full(len(x), none), np.full(len(y), none)
            for p, q in _pairs(x, y, least):
                apart = ids[p] != others[q]
                p, q = p[apart], q[apart]
                np.minimum.at(best, p, others[q])
                np.minimum.at(back, q, ids[p])
            for own, first in ((ids, best), (others, back)):
                met = first < none
                i.append(own[met])
                j.append(first[met])
        return pa.table({"i": pa.array(np.concatenate(i), pa.int64()), "j": pa.array(np.concatenate(j), pa.int64())})

    return run


def _first_neighbours(rest: DataFrame, total: int, least: float) -> DataFrame:
    """(i, j): each row that has others of similarity ``least`` or more, and the smallest id among these and its own. All pairs are
    compared, each once, in blocks of at most ``ROOM`` rows."""
    count = max(LEAST_BLOCKS, -(-total // ROOM))
    blocks = rest.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int").alias("p"))
    left = blocks.select(F.col("p").alias("a"), F.explode(F.sequence("p", F.lit(count - 1))).alias("b"), "id", "vec")
    right = blocks.select(F.explode(F.sequence(F.lit(0), "p")).alias("a"), F.col("p").alias("b"), "id", "vec")
    left, right = (df.toDF(*df.columns) for df in (left, right))
    met = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(_firsts(least), "i long, j long")
    return met.groupBy("i").agg(F.min("j").alias("j")).select("i", F.least("i", "j").alias("j"))


def _small(x: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Vectors with 8-bit components, and the value of the largest."""
    scale = np.abs(x).max(1).astype(np.float32)
    rows = np.round(x / scale[:, None] * 127).astype(np.int8)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * DIM), pa.py_buffer(rows.tobytes())]), pa.array(scale)


def _exact(x: np.ndarray) -> tuple[pa.Array, pa.Array]:
    return pack(x), pa.array(np.zeros(len(x), np.float32))


def _plain(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of _small or _exact, and a bound on the length of their error."""
    scale = table.column("scale").to_numpy().astype(np.float64)
    data = b"".join(table.column("small").to_pylist())
    if len(scale) and scale.max() > 0:
        return np.frombuffer(data, np.int8).reshape(-1, DIM) * (scale[:, None] / 127), scale / 254 * np.sqrt(DIM) * 1.001 + 1e-6
    return np.frombuffer(data, np.float32).reshape(-1, DIM).astype(np.float64), np.zeros(len(scale))


def _around(x: np.ndarray, axis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the part along ``axis``, and of what is left the head, the length of the rest and the whole length."""
    along = x @ axis
    rest = x - along[:, None] * axis
    head, tail = _split(rest)
    return along, head, tail, np.sqrt(np.einsum("ij,ij->i", rest, rest))


def _judge(least: float):
    """Cogroup of rows and members of one group: an id that the vectors' error leaves open, or null for a group that is wrong.

    Around an axis through the members most pairs are far on the right side; a bound of the product by its parts along the axis, by heads
    and by the lengths of the rests settles these. Only what it leaves is computed in double."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        label, open_ = None, []
        if a.num_rows and b.num_rows:
            (x, ex), (y, ey) = _plain(a), _plain(b)
            own = np.asarray(a.column("own").combine_chunks())
            ids, others = a.column("id").to_numpy(), b.column("id").to_numpy()
            label = a.column("label")[0].as_py()
            axis = y.sum(0)
            axis = axis / max(np.linalg.norm(axis), 1e-30)
            (ax, hx, tx, lx), (ay, hy, ty, ly) = _around(x, axis), _around(y, axis)
            # members of the group first, those far from the axis before others, so that tiles of near ones need no product
            rows, cols = np.lexsort((ax, ~own)), np.argsort(ay)
            x, ex, own, ids, ax, hx, tx, lx = (v[rows] for v in (x, ex, own, ids, ax, hx, tx, lx))
            y, ey, others, ay, hy, ty, ly = (v[cols] for v in (y, ey, others, ay, hy, ty, ly))
            most = ex.max() + ey.max() + ex.max() * ey.max() + FLOAT_ERROR
            side = np.where(own, 1.0, -1.0)
            left = np.column_stack([side * ax, side[:, None] * hx, -tx, -(side * least + most)]).astype(np.float32)
            right = np.column_stack([ay, hy, ty, np.ones(len(y))]).astype(np.float32)
            for r in range(0, len(x), TILE):
                here = slice(r, r + TILE)
                for c in range(0, len(y), TILE):
                    there = slice(c, c + TILE)
                    if own[here].all() and min(ax[here].min(), ay[there].min()) > 0 and ax[here].min() * ay[there].min() - lx[here].max() * ly[there].max() > least + most:
                        continue
                    unsettled = left[here] @ right[there].T <= 0
                    if np.count_nonzero(unsettled) * MOST_OPEN > unsettled.size:
                        dot = x[here] @ y[there].T
                        i, j = np.nonzero(np.ones(dot.shape, bool))
                        dot = dot.reshape(-1)
                    else:
                        i, j = np.divmod(_marked(unsettled), unsettled.shape[1])
                        dot = np.einsum("ij,ij->i", x[r + i], y[c + j])
                    i, j = i + r, j + c
                    # how far each pair is on the wrong side: a member too far, or an outsider too near
                    wrong = np.where(own[i], least - dot, dot - least)
                    error = ex[i] + ey[j] + ex[i] * ey[j]
                    apart = ids[i] != others[j]
                    if (apart & np.where(own[i], wrong > error, wrong >= error)).any():
                        return pa.table({"label": pa.array([label], pa.int64()), "id": pa.array([None], pa.int64())})
                    open_.extend(np.unique(ids[i[apart & (wrong > -error) & (error > 0)]]).tolist())
            open_ = list(dict.fromkeys(open_))
        return pa.table({"label": pa.array([label] * len(open_), pa.int64()), "id": pa.array(open_, pa.int64())})

    return run


def _iterate(edges: DataFrame) -> DataFrame:
    """(node, v0, ...): random vectors after so many products with the degree-normalised affinities that those of all sound groups stand still."""
    degree = edges.groupBy("i").agg(F.sum("w").alias("d"))
    matrix_ = materialise(edges.join(degree, "i").select("i", "j", (F.col("w") / F.col("d")).alias("p")), "affinities")
    names = [f"v{c}" for c in range(VECTORS)]
    start = [(F.pmod(F.xxhash64(F.lit(c), F.col("i")), F.lit(1 << 40)) / float(1 << 39) - 1).alias(names[c]) for c in range(VECTORS)]
    now = degree.select(F.col("i").alias("node"), *start)
    for _ in range(ROUNDS):
        before = now
        for _ in range(STEPS):
            before = now
            now = matrix_.join(now.withColumnRenamed("node", "j"), "j").groupBy(F.col("i").alias("node")).agg(*[F.sum(F.col("p") * F.col(n)).alias(n) for n in names])
        joined = now.join(before.select("node", *[F.col(n).alias(f"{n}_") for n in names]), "node")
        moved = F.greatest(*[F.abs(F.col(n) - F.col(f"{n}_")) for n in names])
        stood = materialise(joined.select("node", *names, moved.alias("moved")), "iterated")
        now = stood.select("node", *names)
        if (stood.agg(F.max("moved")).first()[0] or 0) < STILL:
            break
    return now


def _cells(names: list[str]) -> list:
    return [F.floor(F.col(n) / GRID).cast("long") for n in names]


def _near_cells(embedding: DataFrame, names: list[str]) -> DataFrame:
    """Nodes with ``cell``, once for their own grid cell and once for each cell whose border is near."""
    out = embedding
    for i, cell in enumerate(_cells(names)):
        part = F.col(names[i]) / GRID - cell
        own = F.when(part < BORDER, F.array(cell, cell - 1)).when(part > 1 - BORDER, F.array(cell, cell + 1)).otherwise(F.array(cell))
        out = out.withColumn(f"_o{i}", own)
    for i in range(len(names)):
        out = out.withColumn(f"_k{i}", F.explode(f"_o{i}")).drop(f"_o{i}")
    return out.withColumn("cell", F.xxhash64(*[F.col(f"_k{i}") for i in range(len(names))])).drop(*[f"_k{i}" for i in range(len(names))])


def _kmeans(embedding: DataFrame) -> DataFrame:
    """(node, label) by Lloyd's algorithm. The mean of each occupied grid cell is a seed. A node goes to the nearest centre among its own and
    those of its cell and of cells whose border it is near; distances that agree to ``ALIKE`` digits are a tie, which the smallest
    label wins, so two seeds on either side of a border become one centre. Then centres move, until no node changes."""
    names = [c for c in embedding.columns if c != "node"]
    means = [F.avg(n).alias(f"c_{n}") for n in names]
    near = materialise(_near_cells(embedding, names), "near")
    now = embedding.select("node", *names, F.xxhash64(*_cells(names)).alias("label"))
    far = F.round(F.sqrt(sum(((F.col(n) - F.col(f"c_{n}")) ** 2 for n in names), F.lit(0.0))) / GRID, ALIKE)
    for _ in range(LLOYD):
        centres = materialise(now.groupBy("label").agg(*means), "centres")
        placed = centres.withColumn("cell", F.xxhash64(*[F.floor(F.col(f"c_{n}") / GRID).cast("long") for n in names]))
        mine = now.join(centres, "label").select("node", F.col("label").alias("own"), "label", far.alias("far"))
        other = near.join(placed, "cell").select("node", F.lit(None).cast("long").alias("own"), "label", far.alias("far"))
        best = mine.unionByName(other).groupBy("node").agg(F.max("own").alias("own"), F.min(F.struct("far", "label")).alias("best"))
        moved = materialise(best.select("node", "own", F.col("best.label").alias("label")), "assigned")
        if not moved.where("own <> label").limit(1).count():
            return moved.select("node", "label")
        now = embedding.join(moved.select("node", "label"), "node")
    warnings.warn(f"nodes still change centres after {LLOYD} rounds; groups that are not sound may be divided differently")
    return moved.select("node", "label")


class Clusters:
    """The division: ``labelled`` (id, vec, label; label null for single vectors) and ``groups`` (label, n, key, total vector)."""

    def __init__(self, vectors: DataFrame, key: str, column: str, least: float):
        spark = vectors.sparkSession
        self.spark, self.least = spark, least
        total = vectors.count()
        raw = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).alias("v")).where(F.size("v") == DIM)
        marks = leaders(sample(raw, "id", "v", total, LANDMARK_SAMPLE), max(LEADER, least))
        if not len(marks):
            self.labelled = spark.createDataFrame([], "id long, vec binary, label long")
            self.groups = spark.createDataFrame([], "label long, n long, key long, total array<double>")
            return
        shared = spark.sparkContext.broadcast(marks)
        rows = materialise(unit_vectors(vectors, key, column).mapInArrow(_anchored(shared, least), "id long, vec binary, anchors array<int>, weights array<float>"), "anchored")
        covered, rest = rows.where(F.size("anchors") > 0), rows.where(F.size("anchors") == 0)
        links = covered.select("anchors", "weights").mapInArrow(_landmark_links, "i long, j long, w double").groupBy("i", "j").agg(F.sum("w").alias("w"))
        hubs = spark.range(len(marks)).mapInArrow(_hubs(shared, least), "i long, j long")
        links = links.unionByName(hubs.join(links.groupBy("i").agg(F.sum("w").alias("w")), "i").select("i", "j", "w"))
        small = materialise(_first_neighbours(rest, rest.count(), least).withColumn("w", F.lit(1.0)), "links")
        loops = small.select("i").distinct().select("i", F.col("i").alias("j"), F.lit(1.0).alias("w"))
        # region ids may be negative in principle: nodes of vectors are moved to 2 * id, landmarks to odd numbers
        graph = links.select((2 * F.col("i") + 1).alias("i"), (2 * F.col("j") + 1).alias("j"), "w").unionByName(small.unionByName(loops).select((2 * F.col("i")).alias("i"), (2 * F.col("j")).alias("j"), "w"))
        names = _kmeans(_iterate(graph))
        of_marks = names.where(F.pmod("node", F.lit(2)) == 1).select((-(F.col("node") - 1) / 2 - 1).cast("int").alias("anchor"), "label")  # at most LANDMARK_SAMPLE rows
        of_rows = names.where(F.pmod("node", F.lit(2)) == 0).select((F.col("node") / 2).cast("long").alias("id"), "label")
        first = covered.select("id", "vec", F.col("anchors")[0].alias("anchor")).join(F.broadcast(of_marks), "anchor").select("id", "vec", "label")
        self.labelled = materialise(first.unionByName(rest.select("id", "vec").join(of_rows, "id", "left").select("id", "vec", "label")), "labelled")
        release(rows)
        self.groups = materialise(self._sums(), "groups")

    def _sums(self) -> DataFrame:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, labels, x = batch.column(0).to_numpy(), batch.column(2).to_numpy(), unpack(batch.column(1)).astype(np.float64)
                order = np.argsort(labels, kind="stable")
                starts = np.flatnonzero(np.r_[True, labels[order][1:] != labels[order][:-1]])
                sums = np.add.reduceat(x[order], starts, axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(labels[order][starts]), pa.array(np.diff(np.r_[starts, len(order)])), pa.array(np.minimum.reduceat(ids[order], starts)), pa.array(list(sums), pa.list_(pa.float64()))],
                    ["label", "n", "key", "total"],
                )

        def merge(table: pa.Table) -> pa.Table:
            total = np.sum(np.array(table.column("total").to_pylist()), axis=0)
            return pa.table({"label": table.column("label")[:1], "n": [sum(table.column("n").to_pylist())], "key": [min(table.column("key").to_pylist())], "total": [total.tolist()]})

        schema = "label long, n long, key long, total array<double>"
        return self.labelled.where("label is not null").mapInArrow(part, schema).groupBy("label").applyInArrow(merge, schema)

    def _blocks(self, smallest: int) -> list[DataFrame]:
        """Groups of ``smallest`` members and more, in blocks that are small enough to send to every task."""
        large = self.groups.where(F.col("n") >= smallest)
        count = max(1, -(-large.count() // CENTRES))
        return [large.where(F.pmod(F.xxhash64("label"), F.lit(count)) == b) for b in range(count)]

    def sound(self, smallest: int) -> list[DataFrame]:
        """Per block of groups: (label, n, key, total) of those whose members are all alike and apart from all others."""
        return [self._sound(block) for block in self._blocks(smallest)]

    def _sound(self, block: DataFrame) -> DataFrame:
        taken = block.select("label", "total").toArrow()
        labels = taken.column("label").to_numpy()
        if not len(labels):
            return block
        totals = np.array(taken.column("total").to_pylist())
        order = np.argsort(labels)
        labels, centres = labels[order], (totals / np.maximum(np.linalg.norm(totals, axis=1), 1e-30)[:, None])[order]
        shared = self.spark.sparkContext.broadcast((labels, centres))
        angle = float(np.arccos(self.least))
        slack = 1e-6

        def places(own: np.ndarray, names: np.ndarray) -> np.ndarray:
            """Place of each label among names, -1 if it is not there."""
            at = np.minimum(np.searchsorted(names, own), len(names) - 1)
            return np.where(names[at] == own, at, -1)

        def own_labels(column: pa.Array) -> np.ndarray:
            return np.where(np.asarray(column.is_valid()), column.fill_null(0).to_numpy(), np.int64(-(2**63) + 1))

        def radii(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, middle = shared.value
            most = np.full(len(names), -1.0)
            for batch in batches:
                if batch.num_rows:
                    at = places(own_labels(batch.column(2)), names)
                    rows = np.flatnonzero(at >= 0)
                    x = unpack(batch.column(1))[rows].astype(np.float64)
                    theta = np.arccos(np.clip(np.einsum("ij,ij->i", x, middle[at[rows]]), -1, 1))
                    np.maximum.at(most, at[rows], theta)
            seen = np.flatnonzero(most >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(names[seen]), pa.array(most[seen])], ["label", "radius"])

        reach = self.labelled.mapInArrow(radii, "label long, radius double").groupBy("label").agg(F.max("radius").alias("radius")).toArrow()
        radius = np.zeros(len(labels))
        radius[np.searchsorted(labels, reach.column("label").to_numpy())] = reach.column("radius").to_numpy()
        wide = self.spark.sparkContext.broadcast(radius + slack)

        def unclear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, middle = shared.value
            rough = middle.astype(np.float32)
            # an outsider at least so near, as a cosine, may be alike to a member
            near = (np.cos(np.minimum(angle + wide.value, np.pi)) - FLOAT_ERROR).astype(np.float32)
            for batch in batches:
                ids, own = batch.column(0).to_numpy(), own_labels(batch.column(2))
                x = unpack(batch.column(1)) if batch.num_rows else np.zeros((0, DIM), np.float32)
                for s in range(0, len(x), 1024):
                    part = x[s : s + 1024]
                    met = part @ rough.T >= near
                    at = places(own[s : s + 1024], names)
                    rows = np.flatnonzero(at >= 0)
                    met[rows, at[rows]] = False
                    i, j = np.divmod(_marked(met), len(names))
                    i, j, inner = np.r_[i, rows], np.r_[j, at[rows]], np.r_[np.zeros(len(i), bool), np.ones(len(rows), bool)]
                    theta = np.arccos(np.clip(np.einsum("ij,ij->i", part[i].astype(np.float64), middle[j]), -1, 1))
                    # of two members that are apart the one farther from the centre has half of the angle at least: it alone is open
                    open_ = np.where(inner, (theta + wide.value[j] > angle) & (theta > angle / 2 - slack), theta - wide.value[j] < angle)
                    i, j, inner, theta = i[open_], j[open_], inner[open_], theta[open_]
                    if len(i):
                        # members of the group at more than ``bound`` from its centre can decide against this row
                        bound = np.where(inner, angle - theta, theta - angle) - slack
                        yield pa.RecordBatch.from_arrays([pa.array(names[j]), pa.array(ids[i + s]), *_small(part[i]), pa.array(inner), pa.array(bound)], ["label", "id", "small", "scale", "own", "bound"])

        open_rows = materialise(self.labelled.mapInArrow(unclear, "label long, id long, small binary, scale float, own boolean, bound double"), "unclear")

        def sized(rows: DataFrame) -> pa.Table:
            return rows.groupBy("label").agg(F.min("bound").alias("bound")).toArrow()  # at most CENTRES rows

        def edge_members(least_bound: pa.Table, exact: bool) -> DataFrame:
            bounds = np.full(len(labels), np.inf)
            bounds[np.searchsorted(labels, least_bound.column("label").to_numpy())] = least_bound.column("bound").to_numpy()
            asked = self.spark.sparkContext.broadcast(bounds)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                names, middle = shared.value
                for batch in batches:
                    if batch.num_rows:
                        at = places(own_labels(batch.column(2)), names)
                        rows = np.flatnonzero(at >= 0)
                        x = unpack(batch.column(1))[rows]
                        theta = np.arccos(np.clip(np.einsum("ij,ij->i", x.astype(np.float64), middle[at[rows]]), -1, 1))
                        edge = theta >= asked.value[at[rows]]
                        rows, x = rows[edge], x[edge]
                        if len(rows):
                            take = pa.array(rows)
                            yield pa.RecordBatch.from_arrays([batch.column(2).take(take), batch.column(0).take(take), *(_exact(x) if exact else _small(x))], ["label", "id", "small", "scale"])

            return self.labelled.mapInArrow(run, "label long, id long, small binary, scale float")

        def compared(rows: DataFrame, members: DataFrame) -> DataFrame:
            """(label, id): id null for a group that is wrong, else a row that the 8-bit components leave open."""
            nx = rows.groupBy("label").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("bx"))
            ny = members.groupBy("label").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("by"))
            sizes = F.broadcast(nx.join(ny, "label"))  # at most CENTRES rows
            upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
            mix = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
            left = rows.join(sizes, "label").select("label", mix("bx").alias("i"), upto("by").alias("j"), "id", "small", "scale", "own")
            right = members.join(sizes, "label").select("label", upto("bx").alias("i"), mix("by").alias("j"), "id", "small", "scale")
            return left.groupBy("label", "i", "j").cogroup(right.groupBy("label", "i", "j")).applyInArrow(_judge(self.least), "label long, id long").distinct()

        least_bound = sized(open_rows)
        if not least_bound.num_rows:
            return block
        verdict = materialise(compared(open_rows, materialise(edge_members(least_bound, False), "members")), "verdict")
        wrong = verdict.where("id is null").select("label")
        unsure = verdict.where("id is not null").join(F.broadcast(wrong), "label", "left_anti")
        if unsure.limit(1).count():
            rows = open_rows.select("label", "id", "own", "bound").join(unsure, ["label", "id"], "left_semi")
            vectors = self.labelled.select("id", "vec").join(unsure.select("id").distinct(), "id", "left_semi")
            rows = materialise(rows.join(vectors, "id").select("label", "id", F.col("vec").alias("small"), F.lit(0.0).cast("float").alias("scale"), "own", "bound"), "unsure")
            exact = materialise(compared(rows, materialise(edge_members(sized(rows), True), "members")), "verdict")
            wrong = wrong.unionByName(exact.where("id is null").select("label"))
        return block.join(F.broadcast(wrong), "label", "left_anti")

    def members(self, groups: DataFrame) -> DataFrame:
        """(id, vec, label, n, key, total) of the members of a block of groups."""
        return self.labelled.join(F.broadcast(groups), "label")  # at most CENTRES rows


def found(vectors: DataFrame, key: str, column: str, least: float, smallest: int = 5) -> DataFrame:
    """(id, cluster_key): members of all groups of ``smallest`` and more in which any two have similarity ``least`` or more and no
    member has that to an outsider; cluster_key is the smallest key of the group. Null keys, null and unusable vectors take no part;
    repeated keys count once; copies of one vector are members like others; empty input, no rows; further columns are ignored."""
    clusters = Clusters(vectors, key, column, least)
    out = None
    for groups in clusters.sound(smallest):
        part = clusters.members(groups.select("label", "key")).select("id", F.col("key").alias("cluster_key"))
        out = part if out is None else out.unionByName(part)
    return out


def described(vectors: DataFrame, key: str, column: str, least: float, typical: int = 3) -> DataFrame:
    """(cluster_key, n, rank, id, affinity): for each group of two and more its size and its ``typical`` most typical members, by mean
    similarity to the other members; ties go to the smaller key. Groups are those of the clustering, whether or not they are sound."""
    clusters = Clusters(vectors, key, column, least)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, total = unpack(batch.column(1)).astype(np.float64), batch.column(4).flatten().to_numpy().reshape(-1, DIM)
                n = batch.column(2).to_numpy()
                affinity = (np.einsum("ij,ij->i", x, total) - np.einsum("ij,ij->i", x, x)) / (n - 1)
                yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(2), batch.column(0), pa.array(np.round(affinity, 6))], ["cluster_key", "n", "id", "affinity"])

    out = None
    for groups in clusters._blocks(2):
        rows = clusters.members(groups).select("id", "vec", "n", "key", "total").mapInArrow(score, "cluster_key long, n long, id long, affinity double")
        rank = F.row_number().over(W.partitionBy("cluster_key").orderBy(F.desc("affinity"), "id"))
        part = rows.withColumn("rank", rank).where(F.col("rank") <= typical).select("cluster_key", "n", "rank", "id", "affinity")
        out = part if out is None else out.unionByName(part)
    return out
