"""Regions of pictures by a segmentation model, one round at a time: masks to boxes, crops to vectors, vectors to clusters."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismara.operators import assets as A
from prismara.operators import regions as R
from prismara.operators.lifecycle import allocate
from prismara.sources.pixels import Codec, PlainCodec, crop
from prismara.storage import materialise


class Segmenter(Protocol):
    """Masks of a picture, square and boolean, each with a score."""

    def masks(self, pixels: np.ndarray) -> list[tuple[np.ndarray, float]]: ...


class GridSegmenter:
    """A stand-in for a model: the quarters of a picture, scored by their spread of colour."""

    def masks(self, pixels: np.ndarray) -> list[tuple[np.ndarray, float]]:
        out, half = [], R.MASK_SIDE // 2
        h, w = pixels.shape[0] // 2, pixels.shape[1] // 2
        for y in range(2):
            for x in range(2):
                mask = np.zeros((R.MASK_SIDE, R.MASK_SIDE), bool)
                mask[y * half : (y + 1) * half, x * half : (x + 1) * half] = True
                out.append((mask, float(pixels[y * h : (y + 1) * h, x * w : (x + 1) * w].std())))
        return out


_EXTRACTED = "asset_id long, region_idx int, bbox_x0 int, bbox_y0 int, bbox_x1 int, bbox_y1 int, area_frac double, embedding array<float>"


def extracted(rows: DataFrame, segmenter: Segmenter, embed, codec: Codec | None = None) -> DataFrame:
    """Regions of rows (asset_id, content): boxes of the best-scored masks without near repeats, each with the vector of its crop;
    ``embed`` turns a list of byte strings into vectors. A picture with no region, or that does not decode, has a sentinel
    (region_idx -1) without box and vector, so that it is not looked at again."""
    used = codec or PlainCodec()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out: list[tuple] = []
            for asset, content in zip(pdf["asset_id"], pdf["content"]):
                found = []
                try:
                    picture = used.decode(bytes(content))
                    for mask, _ in sorted(segmenter.masks(picture.pixels), key=lambda m: -m[1]):
                        if (box := R.box_from_mask(mask, picture.width, picture.height)) is not None:
                            found.append(box)
                except Exception:  # noqa: BLE001  a broken picture is a sentinel, not a failed job
                    found = []
                kept = [found[i] for i in R.suppressed(np.array([b[:4] for b in found]).reshape(-1, 4))]
                crops = [crop(picture.pixels, b[:4]) for b in kept]
                vectors = embed([c.tobytes() for c in crops]) if crops else []
                out += [(asset, i, *b, np.asarray(v, np.float32).tolist()) for i, (b, v) in enumerate(zip(kept, vectors))]
                if not kept:
                    out.append((asset, -1, None, None, None, None, None, None))
            frame = pd.DataFrame(out, columns=["asset_id", "region_idx", "bbox_x0", "bbox_y0", "bbox_x1", "bbox_y1", "area_frac", "embedding"])
            yield frame.astype({c: "Int32" for c in ("region_idx", "bbox_x0", "bbox_y0", "bbox_x1", "bbox_y1")})

    return rows.select("asset_id", "content").mapInPandas(run, _EXTRACTED)


def _before(assets: DataFrame, due: list) -> dict[int, int | None]:
    """The capture time of the photo before each of a few photos: one aggregate per photo in one pass, no order of the library."""
    if not due:
        return {}
    at, own = F.col("taken_at"), F.col("asset_id")
    last = [F.max(F.when((at < d.taken_at) | ((at == d.taken_at) & (own < d.asset_id)), at)).alias(f"p{i}") for i, d in enumerate(due)]
    row = assets.where("taken_at is not null").agg(*last).first()
    return {d.asset_id: row[i] for i, d in enumerate(due)}


def _chaptered(chapters: DataFrame, due: list, before: dict[int, int | None], now: int) -> tuple[dict[int, int], list[tuple[int, int, int]]]:
    """(asset_id -> chapter_id, new chapters). A photo belongs to the chapter that began last before it, unless more than 30 days have
    passed since the photo before; then a chapter begins. Chapter 0 takes photos without a time."""
    newest = chapters.agg(F.coalesce(F.max("chapter_id"), F.lit(0))).first()[0]
    started = chapters.where("chapter_id > 0")
    row = started.agg(*[F.max(F.when(F.col("started_at") <= d.taken_at, F.struct("started_at", "chapter_id"))).alias(f"c{i}") for i, d in enumerate(due)]).first() if due else []
    out, made = {}, []
    for i, d in enumerate(due):
        known = [(s, c) for c, s, _ in made if s <= d.taken_at] + ([tuple(row[i])] if row[i] is not None else [])
        start, chapter = max(known, default=(None, None))
        gap = before[d.asset_id] is None or d.taken_at - before[d.asset_id] > R.CHAPTER_SECONDS
        if chapter is None or (gap and start < d.taken_at):
            newest += 1
            chapter = newest
            made.append((chapter, d.taken_at, now))
        out[d.asset_id] = chapter
    return out, made


_ASSIGNED = "chapter_id long, region_id long, cluster_id long, fresh int, prototype array<double>, member_count long"


def _assigned(rows: DataFrame, clusters: DataFrame, dim: int, tau: float) -> DataFrame:
    """Rows (chapter_id, region_id, factor, embedding) to prototypes of their chapter, which are read in the chapter's task: a row for each
    region, and one without region for each prototype that is new or has moved. New prototypes have a number in ``fresh`` for a cluster_id."""

    def run(key: tuple, regions: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values("cluster_id")
        state, names = R.Prototypes(dim), known["cluster_id"].tolist()
        state.vectors = np.array(known["prototype"].tolist(), np.float64).reshape(-1, dim)
        state.counts = known["member_count"].astype(int).tolist()
        n, out, touched = len(names), [], set()
        name = lambda k: (names[k], None) if k < n else (None, k - n)
        regions = regions.sort_values("region_id")
        for region, factor, embedding in zip(regions["region_id"], regions["factor"], regions["embedding"]):
            v = np.asarray(embedding, np.float64)
            k = state.add(v / (np.linalg.norm(v) or 1.0), tau * factor)
            out.append((key[0], region, *name(k), None, None))
            touched.add(k)
        out += [(key[0], None, *name(k), state.vectors[k].tolist(), state.counts[k]) for k in sorted(touched)]
        frame = pd.DataFrame(out, columns=["chapter_id", "region_id", "cluster_id", "fresh", "prototype", "member_count"])
        return frame.astype({"region_id": "Int64", "cluster_id": "Int64", "fresh": "Int32", "member_count": "Int64"})

    return rows.groupBy("chapter_id").cogroup(clusters.groupBy("chapter_id")).applyInPandas(run, _ASSIGNED)


def region_round(tables: dict[str, DataFrame], contents: DataFrame, segmenter: Segmenter, embed, dim: int, now: int, limit: int = 8, tau: float = R.TAU, codec: Codec | None = None) -> dict[str, DataFrame] | None:
    """New ``regions``, ``vec_regions``, ``region_chapters`` and the changed ``region_clusters`` of the next ``limit`` photos in order of
    capture; None while assets wait for their own vectors, which go first, or where nothing waits.

    ``tables``: assets, folders, vectors, regions, region_clusters, region_chapters; ``contents``: (sha256, content). Chapters and prototypes are
    kept state: a round looks up the photo before each of its own, goes on from the stored prototypes of their chapters, each chapter in
    a task, and orders no library.
    """
    if A.pending_embeddings(tables["assets"], tables["folders"], tables["vectors"]).limit(1).count():
        return None
    due = A.queue(A.pending_regions(tables["assets"], tables["folders"], tables["regions"]), limit, "taken_at", "asset_id").join(tables["assets"].select("asset_id", "sha256"), "asset_id")
    due = materialise(due, "due")
    photos = sorted(due.select("asset_id", "taken_at").collect(), key=lambda r: (r.taken_at is not None, r.taken_at, r.asset_id))  # at most ``limit``
    if not photos:
        return None
    spark = due.sparkSession
    found = materialise(extracted(due.join(contents, "sha256", "left"), segmenter, embed, codec), "extracted")
    rows = allocate(found.join(due.select("asset_id", "taken_at"), "asset_id"), tables["regions"], "region_id", ["taken_at", "asset_id", "region_idx"])
    rows = materialise(rows, "regions")
    timed = [d for d in photos if d.taken_at is not None]
    before = _before(tables["assets"], timed)
    placed, begun = _chaptered(tables["region_chapters"], timed, before, now)
    gaps = spark.createDataFrame([(d.asset_id, placed.get(d.asset_id, 0), None if before.get(d.asset_id) is None else d.taken_at - before[d.asset_id]) for d in photos], "asset_id long, chapter_id long, gap long")
    context = gaps.select("asset_id", "chapter_id", F.when(F.col("chapter_id") == 0, F.lit(1.0)).otherwise(R.time_factor(F.col("gap"))).alias("factor"))
    real = rows.where("region_idx >= 0").join(F.broadcast(context), "asset_id").select("chapter_id", "region_id", "factor", "embedding")
    known = tables["region_clusters"].join(F.broadcast(context.select("chapter_id").distinct()), "chapter_id", "left_semi").select("chapter_id", "cluster_id", "prototype", "member_count")
    assigned = materialise(_assigned(real, known, dim, tau), "assigned")
    following = tables["region_clusters"].agg(F.coalesce(F.max("cluster_id"), F.lit(-1))).first()[0] + 1
    fresh = sorted((r.chapter_id, r.fresh) for r in assigned.where("region_id is null and fresh is not null").select("chapter_id", "fresh").collect())  # at most limit * 24
    numbers = spark.createDataFrame([(c, f, following + i) for i, (c, f) in enumerate(fresh)], "chapter_id long, fresh int, number long")
    named = assigned.join(F.broadcast(numbers), ["chapter_id", "fresh"], "left").withColumn("cluster_id", F.coalesce("cluster_id", "number"))
    of_regions = F.broadcast(named.where("region_id is not null").select("region_id", "cluster_id", "chapter_id"))
    regions = rows.join(of_regions, "region_id", "left").select("region_id", "asset_id", "region_idx", "bbox_x0", "bbox_y0", "bbox_x1", "bbox_y1", "area_frac", "cluster_id", F.coalesce("chapter_id", F.lit(0)).alias("chapter_id"), F.lit(now).cast("long").alias("created_at"))
    clusters = named.where("region_id is null").select(F.lit(2).cast("long").alias("index_id"), "cluster_id", "chapter_id", F.col("prototype").cast("array<float>").alias("prototype"), "member_count", F.lit(now).cast("long").alias("created_at"))
    return {
        "regions": regions,
        "vec_regions": rows.where("region_idx >= 0").select("region_id", "embedding"),
        "region_clusters": clusters,
        "region_chapters": spark.createDataFrame(begun, "chapter_id long, started_at long, created_at long"),
    }
