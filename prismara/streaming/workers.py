"""Workers that keep a library indexed: ticks, yielding to imports, attempts that are kept, folders that are synchronised once they are quiet.

A worker holds no queue. Each round reads the newest snapshot, does a bounded piece of what is left there and commits it, so a worker that
is stopped, or whose executors are lost, goes on where the last commit stands.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismara.operators.assets import folder_changes, watched_folders
from prismara.operators.lifecycle import upsert, upsert_prototypes
from prismara.sources.catalog import Catalog
from prismara.sources.regions import Segmenter, region_round
from prismara.storage import materialise
from prismara.streaming.jobs import ATTEMPTS, Indexer, commit_vectors, count_failures, embed_pending

# Pauses between rounds and the quiet before a folder is synchronised, in seconds.
EMBED_SECONDS, REGION_SECONDS, WATCH_SECONDS, QUIET_SECONDS = 1.5, 2.0, 2.0, 2.0


class Gate:
    """At most one import per library, whatever process runs it: a file in the library's folder whose creation fails if it is there. The
    holder touches it while it works; one that has not been touched for ``stale`` seconds belongs to a process that has died."""

    def __init__(self, catalog: Catalog, stale: float = 600.0):
        self.catalog, self.stale, self.name = catalog, stale, uuid.uuid4().hex
        self.fs, self.path = catalog._fs(f"{catalog.root}/import.lock")

    def held(self) -> bool:
        """Whether anyone holds it."""
        try:
            return time.time() - self.fs.getFileStatus(self.path).getModificationTime() / 1000 < self.stale
        except Exception:  # noqa: BLE001  no such file
            return False

    def acquire(self) -> bool:
        if not self.held() and self.fs.exists(self.path):
            self.fs.delete(self.path, False)
        try:
            stream = self.fs.create(self.path, False)
        except Exception:  # noqa: BLE001  someone else made it first
            return False
        stream.write(bytearray(self.name.encode()))
        stream.close()
        return True

    def touch(self) -> None:
        now = int(time.time() * 1000)
        self.fs.setTimes(self.path, now, now)

    def release(self) -> None:
        self.fs.delete(self.path, False)


class _Worker:
    """Rounds until nothing is left, then a pause."""

    seconds = 1.0

    def __init__(self):
        self._stop, self._thread, self.error = threading.Event(), None, None

    def round(self) -> int:
        """What the round has written."""
        raise NotImplementedError

    def drain(self, most: int | None = None) -> int:
        """Rounds until one writes nothing: nothing is left, or nothing of what is left can be done, which would otherwise be tried forever."""
        total = rounds = 0
        while not self._stop.is_set() and (most is None or rounds < most):
            n = self.round()
            if n == 0:
                break
            total, rounds = total + n, rounds + 1
        return total

    def start(self) -> _Worker:
        def run() -> None:
            while not self._stop.is_set():
                try:
                    self.drain()
                except Exception as e:  # noqa: BLE001  the next tick tries again
                    self.error = e
                self._stop.wait(self.seconds)

        self._thread = threading.Thread(target=run, daemon=True)
        self._thread.start()
        return self

    def stop(self, seconds: float | None = None) -> bool:
        self._stop.set()
        self._thread.join(seconds)
        return not self._thread.is_alive()


class EmbeddingWorker(_Worker):
    """Vectors for assets that wait: ``limit`` a round, ``group`` at a time, one round after the other. It yields while an import runs.
    Failures are counted per asset; three, and the asset rests for as long as this worker lives."""

    seconds = EMBED_SECONDS

    def __init__(self, catalog: Catalog, contents: Callable[[DataFrame], DataFrame], indexer: Indexer, limit: int = 32, group: int = 8, gate: Gate | None = None):
        """``contents``: from assets to (sha256, content)."""
        super().__init__()
        self.catalog, self.contents, self.indexer, self.limit, self.group = catalog, contents, indexer, limit, group
        self.gate = gate or Gate(catalog)
        self.attempts = catalog.spark.createDataFrame([], ATTEMPTS)

    def round(self) -> int:
        if self.gate.held():
            return 0
        tables = self.catalog.tables()
        state = {"assets": tables["assets"], "folders": tables["folders"], "vectors": tables["vec_assets"]}
        fresh, failed = embed_pending(state, self.contents(tables["assets"]), self.indexer, self.attempts, self.limit, self.group)
        n = fresh.count()
        self.attempts = materialise(count_failures(self.attempts, failed), "attempts")
        if n:
            commit_vectors(self.catalog, fresh)
        return n


class RegionWorker(_Worker):
    """Regions of photos in order of capture, ``limit`` a round, behind imports and behind all vectors of assets."""

    seconds = REGION_SECONDS

    def __init__(self, catalog: Catalog, contents: Callable[[DataFrame], DataFrame], segmenter: Segmenter, embed, dim: int, limit: int = 8, gate: Gate | None = None, clock: Callable[[], int] = lambda: int(time.time())):
        super().__init__()
        self.catalog, self.contents, self.segmenter, self.embed, self.dim, self.limit, self.clock = catalog, contents, segmenter, embed, dim, limit, clock
        self.gate = gate or Gate(catalog)

    def round(self) -> int:
        if self.gate.held():
            return 0
        tables = self.catalog.tables()
        made = region_round(tables | {"vectors": tables["vec_assets"]}, self.contents(tables["assets"]), self.segmenter, self.embed, self.dim, self.clock(), self.limit)
        if made is None:
            return 0
        changed = {
            "regions": upsert(tables["regions"], made["regions"], "region_id"),
            "vec_regions": upsert(tables["vec_regions"], made["vec_regions"], "region_id"),
            "region_clusters": upsert_prototypes(tables["region_clusters"], made["region_clusters"]),
            "region_chapters": upsert(tables["region_chapters"], made["region_chapters"], "chapter_id"),
        }
        self.catalog.commit(changed)
        return made["regions"].select("asset_id").distinct().count()


class FolderSync:
    """Folders whose files have changed, each synchronised once it has been quiet for a while and no import runs; one that fails is marked
    again. ``sync`` takes a folder_id."""

    def __init__(self, sync: Callable[[int], None], idle: Callable[[], bool] = lambda: True, quiet: float = QUIET_SECONDS, clock: Callable[[], float] = time.monotonic):
        self.sync, self.idle, self.quiet, self.clock = sync, idle, quiet, clock
        self.dirty: dict[int, float] = {}
        self.failures: dict[int, Exception] = {}
        self.watched: DataFrame | None = None

    def mark(self, folder_id: int) -> None:
        """A change: the quiet begins anew."""
        self.dirty[folder_id] = self.clock()

    def tick(self) -> list[int]:
        """The folders that were synchronised."""
        now, done = self.clock(), []
        for folder_id in sorted(f for f, at in self.dirty.items() if now - at >= self.quiet):
            if not self.idle():
                break
            del self.dirty[folder_id]
            try:
                self.sync(folder_id)
                self.failures.pop(folder_id, None)
                done.append(folder_id)
            except Exception as e:  # noqa: BLE001  tried again after another quiet
                self.failures[folder_id] = e
                self.mark(folder_id)
        return done

    def refresh(self, folders: DataFrame) -> list[tuple[int, str]]:
        """(folder_id, 'watch' or 'unwatch') since the last look at the folders; what is no longer watched is no longer dirty."""
        now = materialise(watched_folders(folders).select("folder_id"), "watched")
        before = self.watched if self.watched is not None else now.limit(0)
        changes = [(r.folder_id, r.change) for r in folder_changes(before, now).orderBy("folder_id").collect()]  # a row per changed folder
        self.watched = now
        for folder_id, change in changes:
            if change == "unwatch":
                self.dirty.pop(folder_id, None)
        return changes


def all_contents(found: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Contents by hash from scanned files (path, content): those of the assets at hand, by their paths."""

    def of(assets: DataFrame) -> DataFrame:
        return found.join(assets.select(F.col("storage_key").alias("path"), "sha256"), "path").where("content is not null").select("sha256", "content").dropDuplicates(["sha256"])

    return of
