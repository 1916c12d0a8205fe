"""Regions of photos: capture-time relations, online clustering in time order, box post-processing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prismara.functions import scalars as S
from prismara.operators.sessions import SLICE_SECONDS
from prismara.storage import materialise

# Fixed values of the online clustering and of the box filter.
TAU = 0.24
BURST_SECONDS, BURST_FACTOR = 300, 0.5
LONG_SECONDS, LONG_FACTOR = 7 * 86_400, 1.4
CHAPTER_SECONDS = 30 * 86_400
AREA_LEAST, AREA_MOST = 0.0008, 0.85
#: Rows of a chapter that meet its prototypes in one product.
ROWS_AT_ONCE = 256
#: Components of the filter that tells rows and far prototypes apart, prototypes of a tile, and its error in single precision.
HEAD, TILE, SINGLE_ERROR = 40, 4_096, 1e-5
#: Members from which a prototype has an anchor, the distance to an anchor that makes prototypes its neighbours, and the drift that sets it anew.
CROWD, APART, DRIFT = 8, 0.95, 0.15
#: Anchors beyond which, if they are more than a part of the prototypes, those with few members are dropped.
ANCHORS, PART = 512, 16
#: Way that a prototype goes within a block of rows before these meet it anew.
SLACK = 0.05
#: Ids of one second that a task relates at once.
ID_BLOCK = 65_536
PAD, SIDE_LEAST, IOU_MOST, BOXES_MOST, MASK_SIDE = 0.12, 24, 0.85, 24, 256


def previous_times(photos: DataFrame, owner: str | None = None, carry: tuple[str, ...] = (), slice_seconds: int = SLICE_SECONDS, id_block: int = ID_BLOCK) -> DataFrame:
    """``photos`` (asset_id, taken_at, ...) with ``previous``, the capture time of the photo before (by time, then id), and the columns of
    ``carry`` of that photo as previous_{name}; null for the first. Photos without a time are left out.

    Three levels, so that no task sees a timeline and none a second that holds any share of the rows: within a second photos are related in
    blocks of ids, the last of each block is handed to the next block of the slice of time, the last of each slice to the next slice.
    """
    rows = photos.where("taken_at is not null").withColumn("_b", F.floor(F.col("asset_id") / id_block))
    block = ([owner] if owner else []) + ["taken_at", "_b"]
    values = F.struct("taken_at", "asset_id", *carry)
    last = rows.groupBy(*block).agg(F.max(values).alias("_l")).withColumn("_s", F.floor(F.col("taken_at") / slice_seconds))
    slices = ([owner] if owner else []) + ["_s"]
    ends = last.groupBy(*slices).agg(F.max("_l").alias("_e"))
    over = W.partitionBy(owner) if owner else W.partitionBy(F.lit(0))
    ends = ends.select(*slices, F.lag("_e").over(over.orderBy("_s")).alias("_h"))  # a row per slice
    near = last.withColumn("_n", F.lag("_l").over(W.partitionBy(*slices).orderBy("taken_at", "_b")))
    handed = near.join(ends, slices).select(*block, F.coalesce("_n", "_h").alias("_h"))
    inner = F.lag(values).over(W.partitionBy(*block).orderBy("asset_id"))
    joined = rows.withColumn("_i", inner).join(handed, block).withColumn("_p", F.coalesce("_i", "_h"))
    return joined.select(*photos.columns, F.col("_p.taken_at").alias("previous"), *[F.col(f"_p.{c}").alias(f"previous_{c}") for c in carry])


def time_factor(gap: Column) -> Column:
    """Factor on tau: halved within five minutes of the photo before, 1.4 beyond seven days or where there is none."""
    return F.when(gap.isNull() | (gap > LONG_SECONDS), F.lit(LONG_FACTOR)).when(gap < BURST_SECONDS, F.lit(BURST_FACTOR)).otherwise(F.lit(1.0))


def place_factor(minutes: Column, km: Column) -> Column:
    """Factor on tau by time and place: a burst on the spot 0.5, near 0.9, far within two hours 1.3, else 1; by time alone where the
    distance is not known; 1 where there is no photo before."""
    timed = F.when(minutes < 5, F.lit(0.5)).otherwise(F.lit(1.0))
    near = km < 0.2
    placed = F.when(near & (minutes < 5), F.lit(0.5)).when(near, F.lit(0.9)).when((km >= 1.0) & (minutes < 120), F.lit(1.3)).otherwise(F.lit(1.0))
    return F.when(minutes.isNull(), F.lit(1.0)).when(km.isNull(), timed).otherwise(placed)


def place_chapter(minutes: Column, km: Column) -> Column:
    """Whether a photo opens a chapter by time and place."""
    return F.coalesce(F.when(km.isNull(), minutes > 60 * 24 * 60).otherwise((minutes > 14 * 24 * 60) & (km >= 5.0)), F.lit(False))


def chapters(photos: DataFrame) -> DataFrame:
    """(chapter_id, started_at, ended_at, n): runs of photos with at most 30 days from one to the next, numbered from 0.

    Times of one slice of 30 days are less than 30 days apart, so a slice lies in one chapter as a whole: photos are summed per slice
    before the shuffle, and only a row per slice that holds photos is put in order.
    """
    rows = photos.where("taken_at is not null")
    once = rows.groupBy("asset_id", F.when(F.col("asset_id").isNull(), F.monotonically_increasing_id()).alias("_u")).agg(F.min(F.col("taken_at").cast("long")).alias("t"))
    slices = once.groupBy(F.floor(F.col("t") / CHAPTER_SECONDS).alias("_s")).agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("n"))
    by_time = W.partitionBy(F.lit(0)).orderBy("first")
    begins = slices.withColumn("_b", F.coalesce((F.col("first") - F.lag("last").over(by_time) > CHAPTER_SECONDS).cast("long"), F.lit(1)))
    named = begins.withColumn("chapter_id", F.sum("_b").over(by_time.rowsBetween(W.unboundedPreceding, 0)) - 1)
    return named.groupBy("chapter_id").agg(F.min("first").alias("started_at"), F.max("last").alias("ended_at"), F.sum("n").alias("n"))


def with_chapter(photos: DataFrame, parts: DataFrame) -> DataFrame:
    """Photos with the chapter that holds their time. A chapter meets each slice of time it touches, so this is an equi-join."""
    size = CHAPTER_SECONDS
    cut = parts.select("chapter_id", "started_at", "ended_at", F.explode(F.sequence(F.floor(F.col("started_at") / size), F.floor(F.col("ended_at") / size))).alias("_s"))
    rows = photos.where("taken_at is not null").withColumn("_s", F.floor(F.col("taken_at") / size))
    return rows.join(cut, "_s").where(F.col("taken_at").between(F.col("started_at"), F.col("ended_at"))).select(*photos.columns, "chapter_id")


def _outline(x: np.ndarray) -> np.ndarray:
    """The first HEAD components of each row and the length of the others: the product of two outlines is that of the rows or more."""
    return np.column_stack([x[:, :HEAD], np.sqrt(np.einsum("ij,ij->i", x[:, HEAD:], x[:, HEAD:]))]).astype(np.float32)


def _marked(flags: np.ndarray) -> np.ndarray:
    """Flat places of the few true flags, by words of eight."""
    flat = flags.reshape(-1)
    if len(flat) % 8:
        return np.flatnonzero(flat)
    at = (np.flatnonzero(flat.view(np.uint64))[:, None] * 8 + np.arange(8)).reshape(-1)
    return at[flat[at]]


def _any_within(v: np.ndarray, squares: np.ndarray, anchors: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether rows lie within APART of any anchor; squared lengths are given."""
    out = np.zeros(len(v), bool)
    for c in range(0, len(v), 1_024):
        tile = slice(c, c + 1_024)
        out[tile] = (v[tile] @ anchors.T >= (squares[tile, None] + (lengths - APART * APART)) / 2.0 - 1e-9).any(1)
    return out


@dataclass
class Prototypes:
    """State of DP-means: unit prototypes with member counts; ids count up from ``first``.

    Most rows lie near a prototype with many members. Such a prototype has an anchor, a point that stays while it drifts a little; prototypes
    within APART of any anchor are marked as neighbours. All others are APART or more from every anchor, so a row at distance d of its nearest
    anchor is APART - d or more from them: where a neighbour is nearer than that, or tau, they need not be compared.
    """

    dim: int
    vectors: np.ndarray = field(init=False)
    counts: list[int] = field(default_factory=list)
    _covered: int = field(init=False, default=0)

    def __post_init__(self):
        self.vectors = np.zeros((0, self.dim), np.float64)

    def add(self, v: np.ndarray, tau: float) -> int:
        """The prototype for v: the nearest by 1 - cosine if within tau (the first of equals), drifting towards v, else a new one."""
        n, self._covered = len(self.counts), 0
        if n:
            distance = 1.0 - self.vectors[:n] @ v
            best = int(distance.argmin())
            if distance[best] <= tau:
                count = self.counts[best]
                moved = (self.vectors[best] * count + v) / (count + 1.0)
                length = float(np.sqrt(moved @ moved))
                self.vectors[best] = moved / length if length > 1e-9 else moved
                self.counts[best] += 1
                return best
        if n == len(self.vectors):
            self.vectors = np.vstack([self.vectors, np.zeros((max(64, n), self.dim))])
        self.vectors[n] = v
        self.counts.append(1)
        return n


    def add_all(self, x: np.ndarray, tau: np.ndarray) -> np.ndarray:
        """As add() of each row in order. A block of rows meets the prototypes as they stand at its begin. The way that each goes since then is
        added up: rows know its similarity within that, compute it where it matters, and meet it anew after SLACK, as they meet new ones."""
        out = np.empty(len(x), np.int64)
        self._cover(np.arange(self._covered, len(self.counts)))
        for s in range(0, len(x), ROWS_AT_ONCE):
            part, limit = x[s : s + ROWS_AT_ONCE], tau[s : s + ROWS_AT_ONCE]
            own = np.einsum("ij,ij->i", part, part)
            slack = SLACK * np.sqrt(own)
            floor, most = 1.0 - limit - slack, max(self._most, float(own.max()), 1.0)
            near, beyond = self._candidates(part, limit, slack, own)
            beyond, lengths, squares = beyond.tolist(), np.sqrt(own).tolist(), own.tolist()
            gone, met = {}, {}  # way of each changed prototype, and as of when the rows have met it
            for i, least in enumerate((1.0 - limit).tolist()):
                v, length = part[i], lengths[i]
                best, sim, sure = -1, -math.inf, False
                if len(near[i]) == 1:
                    [(best, (at, then))] = near[i].items()
                    sim = at - (gone.get(best, 0.0) - then) * length - 1e-9
                    sure = sim > least and sim > beyond[i]
                if not sure:
                    best, sim = -1, -math.inf
                    for k, (at, then) in near[i].items():
                        now = float(self.vectors[k] @ v) if k in gone else at
                        if now > sim or now == sim and k < best:
                            best, sim = k, now
                    if beyond[i] >= max(sim, least):  # the neighbour that ruled the others out has moved away
                        every = self.vectors[: len(self.counts)] @ v
                        best = int(every.argmax()) if len(every) else -1
                        sim = float(every[best]) if len(every) else sim
                if sure or best >= 0 and 1.0 - sim <= limit[i]:
                    count, p = self.counts[best], self.vectors[best]
                    p *= count
                    p += v
                    p /= count + 1.0
                    long = math.sqrt(p @ p)
                    if long > 1e-9:
                        p /= long
                    self.counts[best] += 1
                    gone[best] = gone.get(best, 0.0) + math.sqrt(max(squares[i] + most - 2.0 * sim, 0.0)) / (count + 1.0) + abs(long - 1.0) + 1e-9
                    anew = gone[best] - met.get(best, 0.0) > SLACK
                else:
                    best = self._append(v)
                    gone[best], anew = 0.0, True
                if anew:
                    met[best] = gone[best]
                    sims = part[i + 1 :] @ self.vectors[best]
                    at = np.flatnonzero(sims >= floor[i + 1 :])
                    for j, value in zip((at + i + 1).tolist(), sims[at].tolist()):
                        near[j][best] = (value, gone[best])
                out[s + i] = best
            self._cover(np.fromiter(gone, np.int64, len(gone)))
        return out

    def _cover(self, changed: np.ndarray) -> None:
        """Outlines, anchors and marks of neighbours after prototypes have moved or come."""
        if not self._covered:
            self._outlines, self._squares = np.zeros((0, min(HEAD, self.dim) + 1), np.float32), np.zeros(0)
            self._near, self._slots, self._most, self._crowd = np.zeros(0, bool), np.zeros(0, np.int64), 0.0, CROWD
            self._anchors, self._lengths = np.zeros((0, self.dim)), np.zeros(0)
        n, room = len(self.counts), len(self.vectors) - len(self._near)
        if room:
            self._outlines = np.vstack([self._outlines, np.zeros((room, self._outlines.shape[1]), np.float32)])
            self._squares, self._slots = np.r_[self._squares, np.zeros(room)], np.r_[self._slots, np.full(room, -1)]
            self._near = np.r_[self._near, np.zeros(room, bool)]
        self._covered = n
        v = self.vectors[changed]
        squares = self._squares[changed] = np.einsum("ij,ij->i", v, v)
        self._outlines[changed], self._most = _outline(v), max(self._most, float(squares.max(initial=0.0)))
        alone = ~self._near[changed]
        self._near[changed[alone]] = _any_within(v[alone], squares[alone], self._anchors, self._lengths)
        crowded = changed[np.array([self.counts[k] >= self._crowd for k in changed.tolist()], bool)]
        slots = self._slots[crowded]
        known = slots >= 0
        drift = self.vectors[crowded[known]] - self._anchors[slots[known]]
        old, new = crowded[known][np.einsum("ij,ij->i", drift, drift) > DRIFT * DRIFT], crowded[~known]
        if len(old) or len(new):
            # As the anchors are compared in single precision, they are points of single precision.
            anchors = self.vectors[np.r_[old, new]].astype(np.float32).astype(np.float64)
            lengths = np.einsum("ij,ij->i", anchors, anchors)
            self._near[:n] |= _any_within(self.vectors[:n], self._squares[:n], anchors, lengths)
            self._slots[new] = np.arange(len(self._anchors), len(self._anchors) + len(new))
            self._anchors[self._slots[old]], self._lengths[self._slots[old]] = anchors[: len(old)], lengths[: len(old)]
            self._anchors, self._lengths = np.vstack([self._anchors, anchors[len(old) :]]), np.r_[self._lengths, lengths[len(old) :]]
            while len(self._anchors) > max(ANCHORS, n // PART):
                self._crowd *= 2
                kept = np.flatnonzero(self._slots[:n] >= 0)
                kept = kept[np.array(self.counts)[kept] >= self._crowd]
                self._anchors, self._lengths = self._anchors[self._slots[kept]], self._lengths[self._slots[kept]]
                self._slots[:] = -1
                self._slots[kept] = np.arange(len(kept))
                self._near[:n] = _any_within(self.vectors[:n], self._squares[:n], self._anchors, self._lengths)
            self._single = self._anchors.astype(np.float32), self._lengths.astype(np.float32)

    def _candidates(self, part: np.ndarray, limit: np.ndarray, slack: np.ndarray, own: np.ndarray) -> tuple[list[dict[int, tuple[float, float]]], np.ndarray]:
        """For each row the prototypes that may come within its limit, with their similarities, and the similarity that no other exceeds until it
        has gone SLACK. A row meets the neighbours of anchors, and the rest only where these may be nearer than the nearest neighbour and the
        limit, equal rows together."""
        n, found = len(self.counts), [{} for _ in range(len(part))]

        def put(groups: list[list[int]], rows: np.ndarray, near: np.ndarray, sims: np.ndarray) -> None:
            for r, k, s in zip(rows.tolist(), near.tolist(), sims.tolist()):
                for at in groups[r]:
                    found[at][k] = (s, 0.0)

        tau, beyond, wide = limit + slack, np.full(len(part), -np.inf), np.arange(len(part))
        if len(self._anchors):
            ids = np.flatnonzero(self._near[:n])
            met = self._within(part, tau, self._outlines[ids], ids)
            put([[r] for r in range(len(part))], *met)
            anchors, lengths = self._single
            least = (lengths - 2.0 * (part.astype(np.float32) @ anchors.T)).min(1)
            error = 4 * SINGLE_ERROR * max(1.0, float(own.max()), float(self._lengths.max()))
            apart = np.maximum(APART - np.sqrt(np.maximum(own + least, 0.0) + error), 0.0)
            beyond = (own + self._most - apart * apart) / 2.0 + SINGLE_ERROR + slack
            best = 1.0 - limit
            np.maximum.at(best, met[0], met[2] - slack[met[0]])
            wide = np.flatnonzero(beyond >= best)
            beyond[wide] = -np.inf
        if len(wide):
            copies: dict[bytes, list[int]] = {}
            for r in wide.tolist():
                copies.setdefault(part[r].tobytes(), []).append(r)
            groups = list(copies.values())
            put(groups, *self._within(part[[g[0] for g in groups]], np.array([tau[g].max() for g in groups]), self._outlines[:n]))
        return found, beyond

    def _within(self, part: np.ndarray, tau: np.ndarray, outlines: np.ndarray, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, prototypes, similarities) of all pairs that may lie within tau, by row and prototype. Outlines in single precision leave out
        what is farther; similarities are in double. ``ids``: the prototypes of the outlines, rising; else the first ones."""
        mine = _outline(part)
        floor = (1.0 - tau).astype(np.float32)[:, None] - np.float32(SINGLE_ERROR * max(1.0, float(np.einsum("ij,ij->i", part, part).max(initial=0.0))))
        found = []
        for c in range(0, len(outlines), TILE):
            close = mine @ outlines[c : c + TILE].T >= floor
            i, j = np.divmod(_marked(close), close.shape[1])
            tile = slice(c, c + close.shape[1]) if ids is None else ids[c : c + close.shape[1]]
            names = c + j if ids is None else tile[j]
            if len(i) * 16 > close.size:
                sim = (part @ self.vectors[tile].T)[i, j]
            else:
                sim = np.einsum("ij,ij->i", part[i], self.vectors[names])
            found.append((i, names, sim))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        rows, near, sims = (np.concatenate(v) for v in zip(*found))
        order = np.lexsort((near, rows))
        return rows[order], near[order], sims[order]

    def _append(self, v: np.ndarray) -> int:
        n = len(self.counts)
        if n == len(self.vectors):
            self.vectors = np.vstack([self.vectors, np.zeros((max(64, n), self.dim))])
        self.vectors[n] = v
        self.counts.append(1)
        return n


def dp_means(rows: DataFrame, scope: str, order: list[str], dim: int, tau: float = TAU) -> DataFrame:
    """(scope, region_id, local_id) for rows (scope, region_id, v, factor, and the columns of order), by DP-means in that order.

    Each assignment depends on all before it in its scope, so a scope is one task's work; it streams through in sorted batches, and
    only the prototypes are held. Scopes run in parallel. Rows whose vector is null or of another length are left out.
    """
    names = [scope, "region_id", "v", "factor"]
    ordered = rows.where(F.size("v") == dim).select(*dict.fromkeys([*names, *order])).repartition(scope).sortWithinPartitions(scope, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, at = Prototypes(dim), None
        for batch in batches:
            if not batch.num_rows:
                continue
            scopes = batch.column(0).to_pylist()
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
            limits = tau * batch.column(3).to_numpy()
            begins = [0, *[i for i in range(1, len(scopes)) if scopes[i] != scopes[i - 1]], len(scopes)]
            found = []
            for a, b in zip(begins, begins[1:]):
                if scopes[a] != at:
                    state, at = Prototypes(dim), scopes[a]
                found.append(state.add_all(x[a:b], limits[a:b]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(found))], ["scope", "region_id", "local_id"])

    typed = ordered.select(F.col(scope).cast("long").alias("scope"), F.col("region_id").cast("long").alias("region_id"), F.col("v").cast("array<double>").alias("v"), F.col("factor").cast("double").alias("factor"))
    return typed.mapInArrow(run, "scope long, region_id long, local_id long")


def global_ids(assigned: DataFrame) -> DataFrame:
    """(scope, region_id, cluster_id): ids count on over scopes in order, as each scope starts without prototypes. ``assigned`` is read for the
    sizes and for the ids, so it is written once: the clustering is the longest task there is."""
    assigned = materialise(assigned, "assigned")
    sizes = assigned.groupBy("scope").agg((F.max("local_id") + 1).alias("k"))
    before = F.coalesce(F.sum("k").over(W.partitionBy(F.lit(0)).orderBy("scope").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per scope
    return assigned.join(sizes.select("scope", before.alias("base")), "scope").select("scope", "region_id", (F.col("base") + F.col("local_id")).alias("cluster_id"))


def box_from_mask(mask: np.ndarray, width: int, height: int) -> tuple[int, int, int, int, float] | None:
    """Padded box of a square mask in picture pixels, with the mask's share of the area; None if the share or the box is out of bounds."""
    share = float(mask.mean())
    if not AREA_LEAST <= share <= AREA_MOST:
        return None
    rows, cols = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    sx, sy = width / mask.shape[1], height / mask.shape[0]
    x0, y0, x1, y1 = int(cols[0] * sx), int(rows[0] * sy), int((cols[-1] + 1) * sx), int((rows[-1] + 1) * sy)
    px, py = int((x1 - x0) * PAD), int((y1 - y0) * PAD)
    box = max(x0 - px, 0), max(y0 - py, 0), min(x1 + px, width), min(y1 + py, height)
    return None if box[2] - box[0] < SIDE_LEAST or box[3] - box[1] < SIDE_LEAST else (*box, share)


def suppressed(boxes: np.ndarray, most: int = BOXES_MOST, limit: float = IOU_MOST) -> np.ndarray:
    """Indices of boxes kept, in order: a box goes if it overlaps an earlier kept one by more than ``limit``; at most ``most`` stay."""
    kept: list[int] = []
    area = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1]).astype(np.float64)
    for i in range(len(boxes)):
        if len(kept) >= most:
            break
        k = boxes[kept]
        wide = np.minimum(k[:, 2], boxes[i, 2]) - np.maximum(k[:, 0], boxes[i, 0])
        high = np.minimum(k[:, 3], boxes[i, 3]) - np.maximum(k[:, 1], boxes[i, 1])
        inter = np.maximum(wide, 0) * np.maximum(high, 0).astype(np.float64)
        if not len(kept) or not (inter / np.maximum(area[kept] + area[i] - inter, 1e-9) > limit).any():
            kept.append(i)
    return np.array(kept, np.int64)


def boxes(regions: DataFrame) -> DataFrame:
    """Regions with a box: corners in order, sentinels and empty boxes left out."""
    corner = lambda f, a, b: f(F.col(a), F.col(b))
    fixed = regions.where("region_idx >= 0 and bbox_x0 is not null and bbox_y0 is not null and bbox_x1 is not null and bbox_y1 is not null").select(
        "region_id", "asset_id", "region_idx", "area_frac",
        corner(F.least, "bbox_x0", "bbox_x1").alias("x0"), corner(F.least, "bbox_y0", "bbox_y1").alias("y0"),
        corner(F.greatest, "bbox_x0", "bbox_x1").alias("x1"), corner(F.greatest, "bbox_y0", "bbox_y1").alias("y1"),
    )
    return fixed.where("x1 > x0 and y1 > y0")


def kept_boxes(rows: DataFrame) -> DataFrame:
    """(asset_id, region_id) of boxes that survive filter and suppression, per asset in order of region_idx."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["region_idx", "region_id"])
        return pdf.iloc[suppressed(pdf[["x0", "y0", "x1", "y1"]].to_numpy(np.int64))][["asset_id", "region_id"]]

    fit = rows.where((F.col("x1") - F.col("x0") >= SIDE_LEAST) & (F.col("y1") - F.col("y0") >= SIDE_LEAST))
    fit = fit.where(F.col("area_frac").between(AREA_LEAST, AREA_MOST))
    return fit.select("asset_id", "region_id", "region_idx", "x0", "y0", "x1", "y1").groupBy("asset_id").applyInPandas(run, "asset_id long, region_id long")


def box_overlaps(rows: DataFrame) -> DataFrame:
    """(a, b, iou) of overlapping boxes of one asset, a < b. (asset_id, region_idx) is unique and an asset has at most 24 regions, so the
    pairs of an asset are bounded."""
    left = rows.select("asset_id", F.col("region_id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")])
    right = rows.select("asset_id", F.col("region_id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    value = S.iou(tuple(F.col(f"a_{c}") for c in ("x0", "y0", "x1", "y1")), tuple(F.col(f"b_{c}") for c in ("x0", "y0", "x1", "y1")))
    meet = (F.col("a") < F.col("b")) & (F.col("a_x0") < F.col("b_x1")) & (F.col("b_x0") < F.col("a_x1")) & (F.col("a_y0") < F.col("b_y1")) & (F.col("b_y0") < F.col("a_y1"))
    return left.join(right, "asset_id").where(meet).select("a", "b", value.alias("iou"))


def without_sentinel_vectors(vec_regions: DataFrame, regions: DataFrame) -> DataFrame:
    """Region vectors without those of sentinels, which stand for 'nothing found' and should have none."""
    return vec_regions.join(regions.where("region_idx = -1").select("region_id"), "region_id", "left_anti")
