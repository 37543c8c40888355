"""The folder that the driver and all executors share, for state between steps."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` or the context's checkpoint folder; on one machine (a local master) a folder below the warehouse, elsewhere an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: a folder that all executors share is needed")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return base.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _end() -> None:
    for spark, path in _made:
        if spark.sparkContext._jsc and not spark.sparkContext._jsc.sc().isStopped():
            delete(spark, path)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared one; what is in it goes when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(_end)
    _made.append((spark, path))
    return path


def saved(df: DataFrame, path: str) -> DataFrame:
    """``df`` written once and read from there, so that nothing after it hangs on how it was made."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
