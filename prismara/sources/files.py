"""Files as rows: folder scans, incremental pre-check, content hashes, read errors as data.

A scan is Spark's binaryFile source; the content column is pruned until it is needed, so a pre-check reads names and sizes only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismara.functions import scalars as S

#: Most bytes of one file; larger ones are reported as unreadable and their content is never touched.
FILE_BYTES = 512 * 1024 * 1024


def scan(spark: SparkSession, folder: str, extensions: tuple[str, ...] = S.PHOTO_EXTENSIONS) -> DataFrame:
    """(path, length, modified, content) of the photos below a folder: extension by name in any case, names with a leading dot left
    out. Paths are plain, without the scheme. Order by path where order matters."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*").load(folder)
    path = F.regexp_replace("path", r"^file:(//)?", "")
    rows = raw.select(path.alias("path"), "length", F.unix_seconds("modificationTime").alias("modified"), "content")
    return rows.where(is_photo(F.col("path"), extensions))


def is_photo(path: Column, extensions: tuple[str, ...] = S.PHOTO_EXTENSIONS) -> Column:
    """Whether a scan takes a path: a known extension in any case, no leading dot in the name."""
    return S.extension(path).isin(*extensions) & ~S.basename(path).startswith(".")


def precheck(files: DataFrame, assets: DataFrame, folder_id: int | None = None) -> DataFrame:
    """Files that are not, by path and size, ready assets of their folder already: of ``folder_id``, or without it of the folder_id that each
    file brings; files of no folder are all new. Contents stay unread."""
    own = files if folder_id is None else files.withColumn("folder_id", F.lit(folder_id).cast("long"))
    ready = assets.where("status = 'ready' and size is not null").select("folder_id", F.col("storage_key").alias("path"), F.col("size").alias("length"))
    if folder_id is not None:
        ready = ready.where(F.col("folder_id") == folder_id)
    return own.join(ready.distinct(), ["folder_id", "path", "length"], "left_anti").select(*files.columns)


def hashed(files: DataFrame, most: int = FILE_BYTES) -> DataFrame:
    """Files with their sha256 and error_code: an oversized or empty file is an error row under a placeholder hash of its path."""
    bad = (F.col("length") > most) | F.col("content").isNull() | (F.col("length") == 0)
    return files.select(
        "*",
        F.when(bad, S.placeholder_hash(F.col("path"))).otherwise(S.content_hash(F.col("content"))).alias("sha256"),
        F.when(bad, F.lit("read_failed")).alias("error_code"),
    )


def batches(files: DataFrame, budget: int, most: int = 32, contents: bool = False) -> DataFrame:
    """Files with a ``batch`` number within their partition: a batch closes beyond half the ``budget`` in bytes or at ``most`` files. Contents
    are read only if asked for."""
    from collections.abc import Iterator

    import pandas as pd

    kept = [f for f in files.schema.fields if contents or f.name != "content"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "batch long"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, size, count = 0, 0, 0
        for pdf in parts:
            out = []
            for length in pdf["length"]:
                if count and (size > budget / 2 or count >= most):
                    number, size, count = number + 1, 0, 0
                out.append(number)
                size, count = size + int(length), count + 1
            yield pdf.assign(batch=out)

    return files.select(*[f.name for f in kept]).mapInPandas(run, schema)


def directory_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """(bytes) of all files below a folder, from names and sizes alone."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
