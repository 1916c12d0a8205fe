"""Continuous ingest and indexing as Structured Streaming jobs.

Queues are no tables: what is left to do is an anti join of what is there and what is done, so a job that stops at any point goes on
from the last committed snapshot, and nothing is done twice.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prismara.functions import scalars as S
from prismara.operators import assets as A
from prismara.operators.lifecycle import upsert, write_vectors
from prismara.sources.catalog import Catalog
from prismara.sources.files import precheck, scan
from prismara.sources.ingest import ingest
from prismara.storage import materialise

RETRIES = 3
ATTEMPTS = "asset_id long, n int"


class Indexer(Protocol):
    """A model: vectors of texts and of contents. It is sent to executors, so it must pickle."""

    index_id: int
    dim: int

    def embed_text(self, text: str) -> np.ndarray: ...

    def embed(self, contents: list[bytes]) -> np.ndarray: ...


class HashIndexer:
    """A deterministic stand-in for a model: signed byte-trigram counts, as a unit vector."""

    def __init__(self, index_id: int = 1, dim: int = 64):
        self.index_id, self.dim = index_id, dim

    def _vector(self, data: bytes) -> np.ndarray:
        raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
        gram = (raw[:-2] * 65_599 + raw[1:-1] * 257 + raw[2:]) * 2_654_435_761 % (1 << 32)
        v = np.bincount(gram % self.dim, np.where(gram >> 31 & 1, 1.0, -1.0), self.dim)
        return v / (np.linalg.norm(v) or 1.0)

    def embed_text(self, text: str) -> np.ndarray:
        return self._vector(text.encode())

    def embed(self, contents: list[bytes]) -> np.ndarray:
        return np.stack([self._vector(c) for c in contents]) if contents else np.zeros((0, self.dim))


def sync_folder(catalog: Catalog, folder: str, folder_id: int, now: int) -> int:
    """Ingest of what is new in a folder, committed as a snapshot; the number of new and retried rows."""
    tables = catalog.tables()
    return commit_ingest(catalog, tables, ingest(scan(catalog.spark, folder), tables["assets"], folder_id, now))


def commit_ingest(catalog: Catalog, tables: dict[str, DataFrame], made: dict[str, DataFrame]) -> int:
    """Commits what ingest() made; the number of new and retried rows."""
    new = materialise(made["assets"].unionByName(made["retried"]).select(*tables["assets"].columns), "synced")
    n = new.count()
    if n:
        catalog.commit({"assets": upsert(tables["assets"], new, "asset_id"), "fts_text": upsert(tables["fts_text"], made["fts"], "asset_id")})
    return n


def watch_folder(spark: SparkSession, folder: str, batch: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, seconds: float = 2.0, most_files: int = 1_000) -> StreamingQuery:
    """A stream of new files below a folder (path, length, modified), handed to ``batch``; with ``once`` it ends when all is read. The file
    source brings a path once; a changed file is found by the pre-check that ``batch`` runs over names and sizes."""
    schema = spark.read.format("binaryFile").load(folder).schema
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most_files).load(folder)
    rows = files.select(F.regexp_replace("path", r"^file:(//)?", "").alias("path"), "length", F.unix_seconds("modificationTime").alias("modified"))
    rows = rows.where(S.extension(F.col("path")).isin(*S.PHOTO_EXTENSIONS) & ~S.basename(F.col("path")).startswith("."))
    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def quiet_folders(changes: DataFrame, at: str = "ts", folder: str = "folder_id", quiet: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """(folder, started, ended, n): bursts of change events per folder, closed once nothing has happened for ``quiet``. Works on a batch
    and on a stream, where ``late`` bounds how long events may be late and with it the state."""
    rows = changes.withWatermark(at, late) if changes.isStreaming else changes
    bursts = rows.groupBy(F.session_window(F.col(at), quiet).alias("w"), F.col(folder)).agg(F.count("*").alias("n"))
    return bursts.select(F.col(folder), F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def _grouped(indexer: Indexer, names: list[str], contents: list[bytes]) -> Iterator[tuple[list[str], list[list[float]]]]:
    """Vectors of a group of contents. If the model fails on the group, each content is tried by itself, and what fails again is left out,
    so it counts as a failed attempt of its asset and not of the round."""
    try:
        yield names, [np.asarray(v, np.float32).tolist() for v in indexer.embed(contents)]
    except Exception:  # noqa: BLE001  whatever the model raises
        if len(names) > 1:
            for name, content in zip(names, contents):
                yield from _grouped(indexer, [name], [content])


def embed_pending(tables: dict[str, DataFrame], contents: DataFrame, indexer: Indexer, attempts: DataFrame | None = None, limit: int = 32, group: int = 8) -> tuple[DataFrame, DataFrame]:
    """A round of indexing: (vectors (asset_id, embedding), failed (asset_id)) for the first ``limit`` assets of the queue.

    ``contents``: (sha256, content). Assets whose content has a vector elsewhere copy it; others are embedded once per content, ``group`` at
    a time. Assets with ``RETRIES`` failed ``attempts`` (asset_id, n) rest.
    """
    assets, vectors = tables["assets"], tables["vectors"]
    waiting = A.pending_embeddings(assets, tables["folders"], vectors)
    if attempts is not None:
        waiting = waiting.join(resting(attempts).select("asset_id"), "asset_id", "left_anti")
    due = materialise(A.queue(waiting, limit, "asset_id"), "due")
    copies = A.copy_candidates(assets, vectors).join(due.select("asset_id"), "asset_id", "left_semi").join(vectors.withColumnRenamed("asset_id", "source_id"), "source_id").select("asset_id", "embedding")
    copies = materialise(copies, "copies")
    rest = due.join(copies.select("asset_id"), "asset_id", "left_anti")
    needed = contents.join(rest.select("sha256").distinct(), "sha256", "left_semi")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for s in range(0, len(pdf), group):
                part = pdf.iloc[s : s + group]
                for names, contents_ in _grouped(indexer, part["sha256"].tolist(), [bytes(c) for c in part["content"]]):
                    yield pd.DataFrame({"sha256": names, "embedding": contents_})

    made = needed.where("content is not null").select("sha256", "content").mapInPandas(run, "sha256 string, embedding array<float>")
    fresh = materialise(copies.unionByName(rest.join(made, "sha256").select("asset_id", "embedding")), "embedded")
    return fresh, due.join(fresh.select("asset_id"), "asset_id", "left_anti").select("asset_id")


def count_failures(attempts: DataFrame, failed: DataFrame) -> DataFrame:
    """Attempts (asset_id, n) with one more for each asset of ``failed``."""
    more = attempts.unionByName(failed.select("asset_id", F.lit(1).alias("n")))
    return more.groupBy("asset_id").agg(F.sum("n").cast("int").alias("n"))


def resting(attempts: DataFrame) -> DataFrame:
    """Assets that have used up their attempts."""
    return attempts.where(F.col("n") >= RETRIES)


def commit_vectors(catalog: Catalog, fresh: DataFrame) -> int:
    tables = catalog.tables()
    return catalog.commit({"vec_assets": write_vectors(tables["vec_assets"], fresh, tables["assets"])})


def progress(assets: DataFrame, folders: DataFrame, vectors: DataFrame, resting: DataFrame) -> DataFrame:
    """(done, total): vectors there are, and those plus the queue without resting assets."""
    left = A.pending_embeddings(assets, folders, vectors).join(resting.select("asset_id"), "asset_id", "left_anti")
    both = vectors.select(F.lit(1).alias("held")).unionByName(left.select(F.lit(0).alias("held")))
    return both.agg(F.coalesce(F.sum("held"), F.lit(0)).alias("done"), F.count("*").alias("total"))


class ImportJob:
    """An import that can be paused, resumed and stopped: the folder's new files in rounds of ``size``, each committed by itself. At most one
    job runs per library, in whatever process; a job that is started again goes on with what is not ready yet."""

    def __init__(self, catalog: Catalog, folder: str, folder_id: int, size: int = 256, clock: Callable[[], int] = lambda: int(time.time())):
        self.catalog, self.folder, self.folder_id, self.size, self.clock = catalog, folder, folder_id, size, clock
        self.done, self.total, self.error = 0, 0, None
        self._go, self._stop, self._thread = threading.Event(), threading.Event(), None
        self._go.set()

    def start(self) -> ImportJob:
        from prismara.streaming.workers import Gate

        self.gate = Gate(self.catalog)
        if not self.gate.acquire():
            raise RuntimeError("an import is running")
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()
        return self

    def pause(self) -> None:
        self._go.clear()

    def resume(self) -> None:
        self._go.set()

    def abort(self) -> None:
        self._stop.set()
        self._go.set()

    def wait(self, seconds: float | None = None) -> bool:
        self._thread.join(seconds)
        return not self._thread.is_alive()

    def state(self) -> str:
        if self._thread is None:
            return "new"
        if not self._thread.is_alive():
            return "failed" if self.error else "aborted" if self._stop.is_set() else "finished"
        return "running" if self._go.is_set() else "paused"

    def _run(self) -> None:
        try:
            found = scan(self.catalog.spark, self.folder)
            waiting = materialise(precheck(found, self.catalog.tables()["assets"], self.folder_id).select("path", "length"), "waiting")
            self.total = waiting.count()
            rounds = max(1, -(-self.total // self.size))
            for r in range(rounds):
                while not self._go.wait(60):
                    self.gate.touch()  # paused, not dead
                if self._stop.is_set():
                    return
                self.gate.touch()
                part = waiting.where(F.pmod(F.xxhash64("path"), F.lit(rounds)) == r).select("path")
                tables = self.catalog.tables()
                made = ingest(found.join(part, "path", "left_semi"), tables["assets"], self.folder_id, self.clock())
                commit_ingest(self.catalog, tables, made)
                self.done += part.count()
        except Exception as e:  # noqa: BLE001  reported by state()
            self.error = e
        finally:
            self.gate.release()
