"""Ingest of a folder: files to asset rows, thumbnails and text rows, as one declarative plan over the present tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismara.functions import scalars as S
from prismara.operators.lifecycle import allocate
from prismara.sources import files as files_
from prismara.sources.pixels import Codec, decoded
from prismara.storage import materialise


def ingest(found: DataFrame, assets: DataFrame, folder_id: int, now: int, codec: Codec | None = None) -> dict[str, DataFrame]:
    """New rows for a folder from a scan: ``assets`` (with thumb bytes in ``thumb``), ``fts`` (asset_id, content), and ``retried``, the
    existing rows that are not ready and whose content was found again, in their new state.

    Names and sizes drop what is ready already; then contents are hashed, of equal contents the first path counts, contents that are
    ready in the folder are dropped, and each remaining content is decoded once. What cannot be read or decoded becomes a failed row.
    A file that could be read this time replaces its placeholder row.
    """
    new = files_.precheck(found, assets, folder_id)
    keyed = materialise(files_.hashed(new), "hashed")
    first = keyed.groupBy("sha256").agg(F.min(F.struct("path", "length", "modified", "error_code")).alias("f"))
    once = first.select("sha256", "f.*")
    own = assets.where(F.col("folder_id") == folder_id)
    fresh = once.join(own.where("status = 'ready'").select("sha256"), "sha256", "left_anti")
    readable = keyed.join(fresh.where("error_code is null").select("sha256", "path"), ["sha256", "path"], "left_semi")
    seen = fresh.withColumnRenamed("error_code", "read_error").join(decoded(readable, codec), "sha256", "left")
    error = F.coalesce("read_error", "error_code")
    taken = F.coalesce("exif_taken", S.filename_seconds(F.col("path")), F.col("modified"))
    made = seen.select(
        F.lit(folder_id).cast("long").alias("folder_id"), "sha256", F.col("path").alias("storage_key"), F.lit("photo").alias("kind"), F.col("length").cast("long").alias("size"),
        "width", "height", taken.alias("taken_at"), S.year_of(taken).alias("year"), "mime", "exif",
        F.when(error.isNull(), S.thumb_key(F.col("sha256"))).alias("thumb_key"), F.when(error.isNull(), "ready").otherwise("failed").alias("status"), error.alias("error_code"),
        F.lit(now).cast("long").alias("imported_at"), F.lit(None).cast("double").alias("gps_lat"), F.lit(None).cast("double").alias("gps_lng"), "thumb",
    )
    made = materialise(made, "made")
    known = own.select("asset_id", "sha256")
    retried = made.join(known, "sha256")
    rows = allocate(made.join(known.select("sha256"), "sha256", "left_anti"), assets, "asset_id", ["storage_key"])
    rows = rows.select("asset_id", *made.columns)
    return {"assets": rows, "retried": retried.select("asset_id", *made.columns), "fts": rows.select("asset_id", S.stem(F.col("storage_key")).alias("content"))}
