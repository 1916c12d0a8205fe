"""Most similar vectors by additive quantisation.

Index. Centres and codebooks are trained on a bounded sample (``vectors.SAMPLE`` rows); every row is then encoded by beam search: the
cell of its nearest centre, one byte for each codebook, the squared norm of the decoded vector and of its error. A row goes to its home
cell and to the cells whose border it is near, each time with its code and its vector.

Search. In a cell the home rows are queries; a table of inner products of query and codewords gives each coded candidate's score by
lookups and its stored norm turns that into a distance. Candidates whose distance agrees with the wanted similarity are reranked exactly
at once, block by block, and of each block only the best of a query are carried on. So a task holds its cell and a few blocks, however
many candidates qualify, and no candidate is dropped by an approximate score once it is within the error bound.

Loss. Two vectors at similarity s lie 2(1 - s) apart squared; along a border's normal that is a fraction of the length with a spread
of 1/sqrt(64). A pair is missed only if that part exceeds twice ``MARGIN_SPREADS / 2`` spreads, or the quantisation error along the pair
exceeds ``CODE_SPREADS`` spreads. tests/llm hold the recall against brute force at 0.99 and more.

Skew. Exact copies are folded per batch before the shuffle and again in the cell: only the smallest ``TOP + 1`` keys of a group of copies
can be among the ten most similar of each other. A cell that the sample says is too large for a task is divided into blocks of queries
and candidates, compared in as many tasks; within a task a large cell is divided again by centres of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prismara.llm.vectors import DIM, Cells, Quantiser, kmeans, matrix, pack, sample, unpack
from prismara.storage import materialise

TOP = 10
PER_CELL = 1_500
#: Cells of the first level; beyond, a cell is divided where it lies.
MOST_CELLS = 1_024
BOOKS, WORDS, BEAM = 16, 64, 4
MARGIN_SPREADS, CODE_SPREADS = 3.0, 4.0
LOCAL = 6_000
SPLIT = 2_000
QUERIES, CANDIDATES = 128, 1_024
#: Rows of a cell that one task takes; beyond, the cell is divided into blocks.
PER_TASK = 50_000

_PARTS = "room long, home int, ids array<long>, mark long, asks boolean, answers boolean, vec binary, code binary, norm float, err float"
_PAIRS = "q array<long>, x array<long>, sim double"


def _fold(ids: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
    """First places of equal marks, and for each the smallest TOP + 1 ids."""
    order = np.lexsort((ids, marks))
    new = np.flatnonzero(np.r_[True, marks[order][1:] != marks[order][:-1]])
    ends = np.r_[new[1:], len(order)]
    return order[new], [sorted(set(ids[order[a:b]].tolist()))[: TOP + 1] for a, b in zip(new, ends)]


def _marks(vectors: np.ndarray) -> np.ndarray:
    """A 64-bit mark of each vector's bytes."""
    words = vectors.view(np.uint64).reshape(len(vectors), -1)
    out = np.full(len(vectors), 0x9E3779B97F4A7C15, np.uint64)
    for c in range(words.shape[1]):
        out = (out ^ words[:, c]) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def _bytes(rows: np.ndarray) -> pa.Array:
    """One-byte components as a binary column."""
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


class _Coded:
    """Usable vectors of a batch, copies folded, with their codes."""

    def __init__(self, quantiser: Quantiser, batch: pa.RecordBatch, margin: float):
        rows, x = matrix(batch.column(1))
        ids = batch.column(0).to_numpy(zero_copy_only=False)[rows].astype(np.int64)
        marks = _marks(x)
        first, folded = _fold(ids, marks)
        self.x, self.marks = x[first], marks[first]
        self.ids = pa.array(folded, pa.list_(pa.int64()))
        self.home, self.near, self.cells = quantiser.cells.margins(self.x, margin)
        codes = quantiser.encode(self.x - quantiser.cells.centres[self.home], BEAM)
        decoded = quantiser.decode(self.home, codes)
        self.rest = self.x - decoded
        self.code = _bytes(codes)
        self.norm = pa.array(np.einsum("ij,ij->i", decoded, decoded).astype(np.float32))
        self.err = pa.array(np.einsum("ij,ij->i", self.rest, self.rest).astype(np.float32))


def _blocks(parts: np.ndarray, cells: np.ndarray, marks: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, room, asks, answers): where each row goes. A cell of one part is a room. Else queries of part i meet candidates of part j in
    room (i, j), so a row that asks goes to all rooms of its i, and every row answers in all rooms of its j."""
    count = parts[cells]
    one = np.flatnonzero(count == 1)
    out = [(one, cells[one].astype(np.int64) << 40, own[one], np.ones(len(one), bool))]
    for cell in np.unique(cells[count > 1]):
        at = np.flatnonzero(cells == cell)
        n = int(parts[cell])
        place = (marks[at].view(np.uint64) % np.uint64(n)).astype(np.int64)
        every = np.arange(n)
        row, part, other = np.repeat(at, n), np.repeat(place, n), np.tile(every, len(at))
        base = np.int64(cell) << 40
        out.append((row, base + (other << 20) + part, own[row] & (other == part), np.ones(len(row), bool)))
        asks = own[row] & (other != part)
        out.append((row[asks], base + (part[asks] << 20) + other[asks], np.ones(asks.sum(), bool), np.zeros(asks.sum(), bool)))
    return tuple(np.concatenate(c) for c in zip(*out))


def _encoder(shared, margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser, parts = shared.value
        for batch in batches:
            c = _Coded(quantiser, batch, margin)
            if not len(c.x):
                continue
            rows, cells = np.r_[np.arange(len(c.x)), c.near], np.r_[c.home, c.cells]
            row, room, asks, answers = _blocks(parts, cells, c.marks[rows], np.r_[np.ones(len(c.x), bool), np.zeros(len(c.near), bool)])
            take = pa.array(rows[row])
            columns = [pa.array(c.home.astype(np.int32)), c.ids, pa.array(c.marks)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(room), *[v.take(take) for v in columns], pa.array(asks), pa.array(answers), pack(c.x).take(take), c.code.take(take), c.norm.take(take), c.err.take(take)],
                ["room", "home", "ids", "mark", "asks", "answers", "vec", "code", "norm", "err"],
            )

    return run


def _merged(marks: np.ndarray, ids: list[list[int]], rows: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
    """One of ``rows`` for each mark, and the smallest TOP + 1 ids of all rows with that mark."""
    order = rows[np.argsort(marks[rows], kind="stable")]
    new = np.flatnonzero(np.r_[True, marks[order][1:] != marks[order][:-1]]) if len(order) else np.zeros(0, np.int64)
    ends = np.r_[new[1:], len(order)]
    return order[new], [ids[order[a]] if b - a == 1 else sorted({i for r in order[a:b] for i in ids[r]})[: TOP + 1] for a, b in zip(new, ends)]


def _tables(quantiser: Quantiser, queries: np.ndarray, home: np.ndarray, codes: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """(queries, candidates, scores of each candidate for each query) block by block, by lookups in the queries' tables."""
    m, k, d = quantiser.books.shape
    flat = quantiser.books.reshape(m * k, d)
    places = codes.astype(np.intp) + np.arange(m) * k
    cells, cell = np.unique(home, return_inverse=True)
    acc, row = np.empty((CANDIDATES, QUERIES), np.float32), np.empty((CANDIDATES, QUERIES), np.float32)
    for a in range(0, len(queries), QUERIES):
        q = np.zeros((QUERIES, d), np.float32)
        n = len(queries[a : a + QUERIES])
        q[:n] = queries[a : a + QUERIES]
        table, base = flat @ q.T, quantiser.cells.centres[cells] @ q.T
        for b in range(0, len(codes), CANDIDATES):
            p = places[b : b + CANDIDATES]
            s, t = acc[: len(p)], row[: len(p)]
            np.take(base, cell[b : b + CANDIDATES], axis=0, out=s, mode="clip")
            for i in range(m):
                np.take(table, p[:, i], axis=0, out=t, mode="clip")
                np.add(s, t, out=s)
            yield slice(a, a + n), slice(b, b + len(p)), s[:, :n]


class _Leaders:
    """The best ``most`` candidates of each query of a block, by exact similarity, then in the order they come."""

    def __init__(self, n: int, most: int):
        self.most, self.sim, self.at = most, np.full((n, most), -np.inf), np.full((n, most), -1, np.int64)

    def add(self, rows: np.ndarray, sim: np.ndarray, at: np.ndarray) -> None:
        """``sim`` (rows, candidates), -inf where there is none; candidates ``at`` come after all earlier ones."""
        every = np.concatenate([self.sim[rows], sim], 1)
        places = np.concatenate([self.at[rows], np.broadcast_to(at, sim.shape)], 1)
        best = np.argsort(-every, axis=1, kind="stable")[:, : self.most]
        self.sim[rows], self.at[rows] = np.take_along_axis(every, best, 1), np.take_along_axis(places, best, 1)


@dataclass
class _Side:
    """Vectors that ask or answer, with their marks and, where they answer, cells and codes."""

    x: np.ndarray
    marks: np.ndarray
    homes: np.ndarray | None = None
    codes: np.ndarray | None = None
    norm: np.ndarray | None = None
    err: np.ndarray | None = None

    def take(self, at: np.ndarray) -> _Side:
        return _Side(*[None if f is None else f[at] for f in (self.x, self.marks, self.homes, self.codes, self.norm, self.err)])


def _reranked(quantiser: Quantiser, asks: _Side, answers: _Side, floor: np.ndarray, most: int, copies: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, their ``most`` best candidates of similarity ``floor`` and more, similarities) per block of queries, as places on either side.

    With d the distance that belongs to a query's floor, e the length of a candidate's quantisation error and n the squared norm of what it
    decodes to, a lookup score of (1 + n - e^2 - d^2) / 2 less CODE_SPREADS times the spread of the error along d is worth a comparison,
    which is made in the block where the candidate is met. Without ``copies`` a candidate of the query's own mark is left out."""
    need = ((1 + answers.norm - answers.err) / 2 - 1e-6).astype(np.float32)
    spread = (CODE_SPREADS * np.sqrt(answers.err / DIM)).astype(np.float32)
    reach = np.sqrt(np.maximum(2 * (1 - floor), 0)).astype(np.float32)
    best, now = None, None
    for a, b, score in _tables(quantiser, asks.x, answers.homes, answers.codes):
        if now is None or a != now:
            if best is not None:
                yield from _kept(best, now)
            best, now = _Leaders(a.stop - a.start, most), a
        score += spread[b, None] * reach[None, a]
        hit = score >= need[b, None] - 0.5 * reach[None, a] ** 2
        if not copies:
            hit &= answers.marks[b, None] != asks.marks[None, a]
        rows, some = np.flatnonzero(hit.any(0)), np.flatnonzero(hit.any(1))
        if len(rows):
            sim = asks.x[a][rows].astype(np.float64) @ answers.x[b][some].astype(np.float64).T
            sim[~hit[np.ix_(some, rows)].T | (sim < floor[a][rows, None])] = -np.inf
            keep = np.flatnonzero(np.isfinite(sim).any(1))
            if len(keep):
                best.add(rows[keep], sim[keep], some + b.start)
    if best is not None:
        yield from _kept(best, now)


def _kept(best: _Leaders, block: slice) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    i, j = np.nonzero(best.at >= 0)
    yield i + block.start, best.at[i, j], best.sim[i, j]


def _answering(columns: dict, every: np.ndarray, marks: np.ndarray) -> _Side:
    take = pa.array(every)
    codes = np.frombuffer(b"".join(columns["code"].take(take).to_pylist()), np.uint8).reshape(-1, BOOKS)
    return _Side(unpack(columns["vec"].take(take)), marks, columns["home"].to_numpy()[every], codes, *(columns[c].to_numpy()[every].astype(np.float64) for c in ("norm", "err")))


def _by_first_key(marks: np.ndarray, ids: list[list[int]]) -> tuple[np.ndarray, list[list[int]]]:
    """One row for each mark with its keys, in order of the smallest, so that what comes first settles ties."""
    every, names = _merged(marks, ids, np.arange(len(marks)))
    order = np.argsort([n[0] for n in names], kind="stable")
    return every[order], [names[i] for i in order]


def _searcher(shared, least: float, margin: float):
    def run(table: pa.Table) -> pa.Table:
        quantiser, _ = shared.value
        columns = {c: table.column(c).combine_chunks() for c in table.column_names}
        asks, answers = (np.asarray(columns[c]) for c in ("asks", "answers"))
        marks = columns["mark"].to_numpy()
        every, names = _by_first_key(marks, columns["ids"].to_pylist())
        asks, answers, marks = asks[every], answers[every], marks[every]
        out: list[tuple] = [(n, n, 1.0) for n, a, b in zip(names, asks, answers) if a and b and len(n) > 1]
        if asks.any():
            side = _answering(columns, every, marks)
            for queries, candidates in _rooms(side.x, asks, answers, margin):
                for q, c, sim in _reranked(quantiser, side.take(queries), side.take(candidates), np.full(len(queries), least), TOP + 1, False):
                    out.extend((names[a], names[b], s) for a, b, s in zip(queries[q].tolist(), candidates[c].tolist(), sim.tolist()))
        q, c, sim = zip(*out) if out else ((), (), ())
        return pa.table({"q": pa.array(q, pa.list_(pa.int64())), "x": pa.array(c, pa.list_(pa.int64())), "sim": pa.array(sim, pa.float64())})

    return run


def _rooms(x: np.ndarray, asks: np.ndarray, answers: np.ndarray, margin: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of queries and their candidates: all of a cell, or of each part of a large one, with candidates from across the parts' borders."""
    asking, n = np.flatnonzero(asks), len(x)
    if n <= LOCAL:
        yield asking, np.flatnonzero(answers)
        return
    parts = Cells(kmeans(x[:: max(1, n // 20_000)], -(-n // SPLIT), 4, 1))
    home, places, rooms = np.empty(n, np.int64), [], []
    for s in range(0, n, 4096):
        own, near, cell = parts.margins(x[s : s + 4096], 2 * margin)  # queries stay at home, so candidates cross for both
        home[s : s + 4096] = own
        at = np.r_[np.arange(len(own)), near] + s
        good = answers[at]
        places.append(at[good])
        rooms.append(np.r_[own, cell][good])
    place, room = np.concatenate(places), np.concatenate(rooms)
    order = np.lexsort((place, room))
    bounds = np.searchsorted(room[order], np.arange(len(parts.centres) + 1))
    for r in range(len(parts.centres)):
        queries = asking[home[asking] == r]
        if len(queries):
            yield queries, place[order[bounds[r] : bounds[r + 1]]]


def _parts(quantiser: Quantiser, training: np.ndarray, total: int, margin: float) -> np.ndarray:
    """Into how many blocks each way a cell's rows are divided, by the sample's share of rows that go there."""
    home, _, cells = quantiser.cells.margins(training, margin)
    rows = np.bincount(np.r_[home, cells], minlength=len(quantiser.cells.centres)) * (total / len(training))
    return np.maximum(1, np.ceil(rows / PER_TASK)).astype(np.int64)


def similar_pairs(vectors: DataFrame, key: str, column: str, least: float, per_cell: int = PER_CELL) -> DataFrame:
    """(a, b, sim), a < b, of distinct keys whose usable vectors have cosine >= ``least``, each within the ten most similar of the
    other as far as such pairs decide it. Null keys, null and unusable vectors take no part; repeated keys count once; ties go to the
    smaller key; empty input, no rows; further columns are ignored."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).alias("v")).where(F.col("id").isNotNull() & (F.size("v") == DIM))
    total = vectors.count()
    training = sample(rows, "id", "v", total)
    if len(training) < 2:
        return spark.createDataFrame([], "a long, b long, sim double")
    quantiser = Quantiser.train(training, max(1, min(MOST_CELLS, total // per_cell)), BOOKS, WORDS, beam=BEAM)
    margin = MARGIN_SPREADS / 2 * np.sqrt(2 * (1 - least) / DIM)
    shared = spark.sparkContext.broadcast((quantiser, _parts(quantiser, training, total, margin)))
    hits = rows.mapInArrow(_encoder(shared, margin), _PARTS).groupBy("room").applyInArrow(_searcher(shared, least, margin), _PAIRS)
    pairs = hits.select(F.explode("q").alias("p"), "x", "sim").select("p", F.explode("x").alias("r"), "sim").where("p <> r")
    pairs = pairs.groupBy(F.least("p", "r").alias("a"), F.greatest("p", "r").alias("b")).agg(F.max("sim").alias("sim"))
    return materialise(pairs, "neighbours")


def mutual(pairs: DataFrame, top: int = TOP) -> DataFrame:
    """The pairs in which each is among the ``top`` most similar of the other."""
    both = pairs.select(F.col("a").alias("p"), F.col("b").alias("r"), "a", "b", "sim").unionByName(pairs.select(F.col("b").alias("p"), F.col("a").alias("r"), "a", "b", "sim"))
    rank = F.row_number().over(W.partitionBy("p").orderBy(F.desc("sim"), "r"))
    return both.withColumn("rank", rank).where(F.col("rank") <= top).groupBy("a", "b").agg(F.count("*").alias("n"), F.first("sim").alias("sim")).where("n = 2").select("a", "b", "sim")


# The most similar of all, for a stated set of queries.

PROBES = 32
#: The share of rows, one in so many, from which a query learns what its neighbours have to beat.
GLANCE = 4
_FOUND = "q long, x array<long>, sim double"


def _glanced(shared):
    """Rows (id, v) by home cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = matrix(batch.column(1))
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(shared.value[0].cells.homes(x).astype(np.int32)), batch.column(0).take(pa.array(rows)), pack(x)], ["cell", "id", "vec"])

    return run


def _floors(top: int):
    """Cogroup of the queries of a cell and some of its rows: the similarity of the ``top``-th best other row, where there are as many."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, floor = (a.column("id").to_numpy() if a.num_rows else np.zeros(0, np.int64)), np.full(a.num_rows, -1.0)
        if a.num_rows and b.num_rows > top:
            q, x, names = unpack(a.column("vec").combine_chunks()), unpack(b.column("vec").combine_chunks()), b.column("id").to_numpy()
            for r in range(0, len(q), 256):
                kept = np.full((len(q[r : r + 256]), top), -1.0, np.float32)
                for c in range(0, len(x), 8_192):
                    near = q[r : r + 256] @ x[c : c + 8_192].T
                    near[ids[r : r + 256, None] == names[None, c : c + 8_192]] = -1
                    kept = -np.sort(-np.concatenate([kept, near], 1), axis=1)[:, :top]
                floor[r : r + 256] = kept[:, -1] - 1e-5
        return pa.table({"id": pa.array(ids, pa.int64()), "floor": pa.array(floor, pa.float64())})

    return run


def _probed(shared, probes: int):
    """Queries (id, v, floor) with the rooms of the cells nearest to them, less those whose border is farther than a neighbour could be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser, parts = shared.value
        cells = quantiser.cells
        k = min(probes, len(cells.centres))
        for batch in batches:
            rows, x = matrix(batch.column(1))
            if not len(rows):
                continue
            floor = batch.column(2).to_numpy(zero_copy_only=False)[rows]
            near = x @ cells.centres.T - cells.half
            order = np.argsort(-near, axis=1, kind="stable")[:, :k]
            border = (near[np.arange(len(x)), order[:, 0]][:, None] - np.take_along_axis(near, order, 1)) / cells.apart[order[:, :1], order]
            border[:, 0] = 0
            which, place = np.nonzero(border <= CODE_SPREADS * np.sqrt(np.maximum(2 * (1 - floor), 0) / DIM)[:, None])
            cell = order[which, place].astype(np.int64)
            count = parts[cell]
            at = np.repeat(np.arange(len(which)), count)
            other = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            ids = batch.column(0).to_numpy(zero_copy_only=False)[rows]
            own = (ids[which] % count)[at]  # a query's part of a large cell; it meets all parts of the rows
            room = (cell[at] << 40) + (own << 20) + other
            take = pa.array(which[at])
            yield pa.RecordBatch.from_arrays([pa.array(room), pa.array(ids).take(take), pack(x).take(take), pa.array(floor).take(take)], ["room", "q", "qv", "floor"])

    return run


def _nearest(shared, top: int):
    """Cogroup of the queries and the rows of a room: of each query the ``top + 1`` best rows, one of which may be itself."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out_q, out_x, out_s = [np.zeros(0, np.int64)], [], [np.zeros(0)]
        if a.num_rows and b.num_rows:
            columns = {c: b.column(c).combine_chunks() for c in b.column_names}
            marks = columns["mark"].to_numpy()
            every, names = _by_first_key(marks, columns["ids"].to_pylist())
            ids = a.column("q").to_numpy()
            asks = _Side(unpack(a.column("qv").combine_chunks()), np.zeros(a.num_rows, np.int64))
            for q, c, sim in _reranked(shared.value[0], asks, _answering(columns, every, marks[every]), a.column("floor").to_numpy(), top + 1, True):
                out_q.append(ids[q])
                out_x.extend(names[i] for i in c.tolist())
                out_s.append(sim)
        return pa.table({"q": pa.array(np.concatenate(out_q), pa.int64()), "x": pa.array(out_x, pa.list_(pa.int64())), "sim": pa.array(np.concatenate(out_s), pa.float64())})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, key: str, column: str, top: int = TOP, probes: int = PROBES, per_cell: int = PER_CELL) -> DataFrame:
    """(id, neighbour, rank, sim): the ``top`` (at most TOP) most similar vectors for every row of ``queries`` (key, column), itself left out.

    All rows are coded and laid into cells. What a query finds among a share of its home cell is the mark that candidates have to beat; with it
    goes to the ``probes`` cells nearest to it, less those that cannot hold a neighbour. There lookup scores pick the rows that are worth
    an exact comparison, and the best of these leave. Cells of more than ``PER_TASK`` rows are divided, and their queries go to every
    part. Ties go to the smaller key; repeated keys count once; null and unusable vectors neither ask nor answer; empty input, no rows.
    """
    spark = vectors.sparkSession
    tidy = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(column).alias("v")).where(F.col("id").isNotNull() & (F.size("v") == DIM))
    rows, asked = tidy(vectors), tidy(queries).groupBy("id").agg(F.min("v").alias("v"))
    total = vectors.count()
    training = sample(rows, "id", "v", total)
    if len(training) < 2:
        return spark.createDataFrame([], "id long, neighbour long, rank int, sim double")
    quantiser = Quantiser.train(training, max(1, min(MOST_CELLS, total // per_cell)), BOOKS, WORDS, beam=BEAM)
    parts = _parts(quantiser, training, total, -1.0)
    shared = spark.sparkContext.broadcast((quantiser, parts))
    by_cell = "cell int, id long, vec binary"
    asking = materialise(asked, "asked")
    some = rows.where(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(GLANCE)) == 0).mapInArrow(_glanced(shared), by_cell)
    floors = asking.mapInArrow(_glanced(shared), by_cell).groupBy("cell").cogroup(some.dropDuplicates(["id"]).groupBy("cell")).applyInArrow(_floors(top), "id long, floor double")
    probed = asking.join(floors, "id").select("id", "v", "floor").mapInArrow(_probed(shared, probes), "room long, q long, qv binary, floor double")
    coded = rows.mapInArrow(_encoder(shared, -1.0), _PARTS).where("answers")
    found = probed.groupBy("room").cogroup(coded.groupBy("room")).applyInArrow(_nearest(shared, top), _FOUND)
    pairs = found.select("q", F.explode("x").alias("x"), "sim").where("q <> x").groupBy("q", "x").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("sim"), "x"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= top).select(F.col("q").alias("id"), F.col("x").alias("neighbour"), "rank", F.round("sim", 6).alias("sim"))
