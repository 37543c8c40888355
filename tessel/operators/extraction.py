"""Extraction that can be interrupted, and the interface of encoders.

Encoded rows are written in portions of bounded size, each committed by a row of a log after its data. What is committed isn't encoded again: a run takes
what is missing from the committed rows, whatever portions or partitions it had before. A portion that was cut off has no log row and isn't read."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tessel.functions import vectors as V
from tessel.sources import shared

#: Portions that are written at the same time.
PARALLEL = 8
ROWS = "hash string, model string, version string, vec array<float>"


class Extraction:
    def __init__(self, spark: SparkSession, root: str, portion: int = 100_000):
        """portion: items between two commits."""
        self.spark, self.root, self.portion = spark, root.rstrip("/"), portion

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{schema}, portion long").parquet(f"{self.root}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], f"{schema}, portion long")

    def log(self) -> DataFrame:
        """(items, portion) of the committed portions."""
        return self._read("log", "items long")

    def rows(self) -> DataFrame:
        """ROWS that are committed."""
        return self._read("data", ROWS).join(F.broadcast(self.log().select("portion")), "portion", "left_semi").drop("portion")

    def missing(self, todo: DataFrame) -> DataFrame:
        """What of (hash, model, version, ...) isn't committed yet."""
        return todo.dropDuplicates(["hash", "model", "version"]).join(self.rows().select("hash", "model", "version"), ["hash", "model", "version"], "left_anti")

    def run(self, todo: DataFrame, encode: Callable[[DataFrame], DataFrame]) -> int:
        """Encodes what is missing; ``encode`` turns rows of ``todo`` into ROWS. The number of items encoded."""
        rows = self.missing(todo)
        portions = -(-rows.count() // self.portion)
        if not portions:
            return 0
        first = (self.log().agg(F.max("portion")).first()[0] or 0) + 1
        # the part of an item hangs on its hash only; what is missing is dealt to the portions once, so that a portion reads nothing but its own items
        dealt = f"{self.root}/todo-{uuid.uuid4().hex[:12]}"
        own = rows.withColumn("portion", F.pmod(F.xxhash64("hash", "model", "version"), F.lit(portions)) + first)
        own.repartition("portion").write.partitionBy("portion").parquet(dealt)
        kinds = [c.split()[0] for c in ROWS.split(", ")]

        def commit(k: int, got: DataFrame) -> int:
            path = lambda name: f"{self.root}/{name}/portion={k}"
            got.write.mode("overwrite").parquet(path("data"))
            items = self.spark.read.schema(ROWS).parquet(path("data")).count()
            self.spark.createDataFrame([(items,)], "items long").coalesce(1).write.mode("error").parquet(path("log"))
            return items

        # each portion is committed alone, some at a time; ``encode`` is called in their order, and no more once it or a portion fails
        running = []
        try:
            with ThreadPoolExecutor(PARALLEL) as pool:
                for k in range(first, first + portions):
                    try:
                        mine = self.spark.read.schema(rows.schema).parquet(f"{dealt}/portion={k}")
                    except AnalysisException:  # no item's hash leads here
                        continue
                    got = encode(mine).select(*kinds)
                    if len(running) >= PARALLEL:
                        running[-PARALLEL].result()
                    running.append(pool.submit(inheritable_thread_target(self.spark)(commit), k, got))
            return sum(r.result() for r in running)
        finally:
            shared.delete(self.spark, dealt)


def encoded(files: DataFrame, make: Callable[[], Callable[[np.ndarray], np.ndarray]], size: int, model: str, version: str = "1", unit: bool = True, batch: int = 64) -> DataFrame:
    """ROWS of files (hash, pixels: array of ``size`` numbers) by an encoder.

    ``make`` builds the encoder, once for each worker process: a function from (batch, size) to (batch, dimensions). A picture that can't be read (null,
    of another size, with nulls) is encoded as zeros, as one without content; vectors are put to norm 1 unless ``unit`` is false."""
    readable = F.col("pixels").isNotNull() & (F.size("pixels") == size) & ~F.exists("pixels", lambda x: x.isNull())
    picture = F.when(readable, F.col("pixels").cast("array<float>")).otherwise(F.array_repeat(F.lit(0.0).cast("float"), size))
    run = predict_batch_udf(make, return_type=ArrayType(FloatType()), batch_size=batch, input_tensor_shapes=[[size]])
    vec = run(picture)
    rows = files.select("hash", vec.alias("raw"))
    out = V.unit(F.col("raw").cast("array<double>")).cast("array<float>") if unit else F.col("raw")
    return rows.select("hash", F.lit(model).alias("model"), F.lit(version).alias("version"), out.alias("vec"))
