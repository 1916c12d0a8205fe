"""Versioned snapshots of tables: a folder per version and a pointer to the newest.

A commit writes the changed tables into a new version, lists all tables of the version in its manifest, and creates the next pointer
file. Creating that file is the commit: it fails if another writer made it first, and a commit that dies before leaves nothing that a
reader sees. Readers keep the version they opened. Paths go through Hadoop's file system, so any store that Spark reads will do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from prismara.schema import MIGRATIONS, migrate


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Catalog:
        """The catalogue at ``root``, created empty or migrated to the newest schema if need be."""
        out = cls(spark, root)
        made, version = out._state()
        if version < len(MIGRATIONS):
            tables, newest = migrate(spark, {n: spark.read.parquet(p) for n, p in made.items()}, version)
            out.commit(tables, newest)
        return out

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _text(self, path: str) -> str:
        return "\n".join(r.value for r in self.spark.read.text(path).collect())  # a manifest

    def versions(self) -> list[int]:
        fs, p = self._fs(f"{self.root}/pointers")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p)) if fs.exists(p) else []

    def _state(self, version: int | None = None) -> tuple[dict[str, str], int]:
        every = self.versions()
        if not every:
            return {}, 0
        read = json.loads(self._text(f"{self.root}/pointers/{every[-1] if version is None else version}"))
        return read["tables"], read["schema_version"]

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        return {n: self.spark.read.parquet(p) for n, p in self._state(version)[0].items()}

    def commit(self, changed: dict[str, DataFrame], schema_version: int | None = None) -> int:
        """Writes ``changed`` and makes them, with the unchanged tables, the newest version; its number."""
        every = self.versions()
        number = (every[-1] if every else 0) + 1
        tables, version = self._state()
        token = uuid.uuid4().hex[:8]
        for name, df in changed.items():
            path = f"{self.root}/v{number}-{token}/{name}"  # no other writer's, whoever commits first
            df.write.parquet(path)
            tables = tables | {name: path}
        fs, pointer = self._fs(f"{self.root}/pointers/{number}")
        stream = fs.create(pointer, False)
        stream.write(bytearray(json.dumps({"schema_version": schema_version or version, "tables": tables}).encode()))
        stream.close()
        return number
