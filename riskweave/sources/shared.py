"""Tables that a query writes once and reads several times, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on one machine a folder of our own where that is unset."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        folder = tempfile.mkdtemp(prefix="riskweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _OWN[app] = f"file://{folder}"
    return _OWN[app]


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        with suppress(Exception):  # the session may have ended before
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    atexit.register(remove)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read back; a lost executor costs its tasks only. The files go when the driver ends."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def released(*tables: DataFrame | None) -> None:
    """Delete the files of written tables that nothing reads any more."""
    for df in tables:
        if df is not None:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_at)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
