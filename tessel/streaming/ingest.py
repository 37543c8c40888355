"""Incremental extraction as a stream: rows that arrive as files replace or extend the embedding cache, each batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

CACHE = "hash string, model string, version string, vec array<double>"


def newest(rows: DataFrame) -> DataFrame:
    """The current cache of (batch, rows of CACHE): of each hash and model the row of the last batch."""
    w = Window.partitionBy("hash", "model").orderBy(F.desc("batch"))
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "batch")


def ingest(spark: SparkSession, arrivals: str, cache: str, checkpoint: str, encode: Callable[[DataFrame], DataFrame] | None = None, schema: str = CACHE) -> StreamingQuery:
    """Starts the stream over all files that are there. Each batch is written to its own partition, so a repeated batch overwrites itself; ``encode`` turns arrivals into rows of CACHE."""

    def put(batch: DataFrame, number: int) -> None:
        rows = encode(batch) if encode else batch
        rows.dropDuplicates(["hash", "model"]).write.mode("overwrite").parquet(f"{cache}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(arrivals)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, cache: str) -> DataFrame:
    return newest(spark.read.schema(CACHE + ", batch long").parquet(cache))
