"""Tables written to the cluster's shared folder, to cut lineage and to compute costly stages once.

A written table outlives the executors that made it, so a lost executor costs only its running tasks.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a local master gets a temporary folder; a cluster gets an error,
    as a folder of one machine is of no use to executors on others."""
    for get in (lambda: spark.conf.get("spark.checkpoint.dir", None), lambda: spark.sparkContext.getConf().get("spark.checkpoint.dir")):
        if folder := get():
            return folder
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="prismara-")
        atexit.register(shutil.rmtree, _own[app], True)
    return _own[app]


def _root(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/prismara/{spark.sparkContext.applicationId}"


def table_path(spark: SparkSession, label: str) -> str:
    return f"{_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    spark = df.sparkSession
    path = table_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(*tables: DataFrame) -> None:
    """Delete tables of materialise() that nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table._written)


def clear(spark: SparkSession) -> None:
    """Delete all that this application wrote to the shared folder, once the results that read it are no longer needed."""
    _delete(spark, _root(spark))
