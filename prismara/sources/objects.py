"""Small objects by key: put, get and delete below a root, with checked keys."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def check_key(key: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9._/-]+", key) or key.startswith("/") or ".." in key:
        raise ValueError(f"no valid object key: {key!r}")
    return key


class ObjectStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, key: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{check_key(key)}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def put(self, key: str, data: bytes) -> None:
        fs, p = self._at(key)
        stream = fs.create(p, True)
        stream.write(bytearray(data))
        stream.close()

    def get(self, key: str) -> bytes | None:
        fs, p = self._at(key)
        if not fs.exists(p):
            return None
        return bytes(self.spark.read.format("binaryFile").load(p.toString()).select("content").first()[0])

    def delete(self, key: str) -> bool:
        """Whether there was something to delete; deleting twice is no error."""
        fs, p = self._at(key)
        return bool(fs.delete(p, False))


def write_objects(rows: DataFrame, root: str) -> DataFrame:
    """(key, bytes) of rows (key, data) written below a root that all executors share, on the executors; a repeated key is written once.
    Files are written under another name and moved into place, so a lost task leaves no half object. Roots on local disks are
    refused on a cluster; other schemes go through Arrow's file systems (hdfs, s3, gs, ...)."""
    from collections.abc import Iterator

    import pandas as pd
    from pyarrow import fs as arrow_fs

    master = rows.sparkSession.sparkContext.master
    local = "://" not in root.replace("file://", "", 1) and not re.match(r"[a-z][a-z0-9+.-]+:(?!//)", root.removeprefix("file:"))
    shared = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
    if local and not (master == "local" or master.startswith("local[")) and not (shared and root.startswith(shared.rstrip("/"))):
        raise ValueError(f"{root} may lie on a disk of one machine; name a folder that all executors share")
    uri = root.replace("s3a://", "s3://", 1)
    uri = "file://" + uri.removeprefix("file://").removeprefix("file:") if local else uri

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        store, base = arrow_fs.FileSystem.from_uri(uri)
        for pdf in parts:
            for key, data in zip(pdf["key"], pdf["data"]):
                target = f"{base.rstrip('/')}/{check_key(key)}"
                folder, name = target.rsplit("/", 1)
                store.create_dir(folder, recursive=True)
                fresh = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(fresh) as out:
                    out.write(data)
                store.move(fresh, target)
            yield pd.DataFrame({"key": pdf["key"], "bytes": [len(d) for d in pdf["data"]]})

    return rows.where(F.col("data").isNotNull()).dropDuplicates(["key"]).select("key", "data").mapInPandas(run, "key string, bytes long")
