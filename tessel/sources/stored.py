"""Results that are kept: tables under a root, keyed by their parameters and by a fingerprint of what they were made from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(df: DataFrame) -> str:
    """Of the rows, whatever their order: their number and the sum and the parity of their hashes."""
    h = F.xxhash64(*df.columns)
    r = df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x")).first()
    return hashlib.sha256(repr(tuple(r)).encode()).hexdigest()[:16]


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self._path(name))

    def load(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self._path(name))
        except AnalysisException:
            return None

    def exists(self, name: str) -> bool:
        return self.load(name) is not None

    def clear(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def cached(self, name: str, params: dict, inputs: list[DataFrame], make: Callable[[], DataFrame]) -> DataFrame:
        """What ``make`` gives, kept for these parameters until an input's rows change."""
        key = hashlib.sha256(json.dumps([params, [fingerprint(x) for x in inputs]], sort_keys=True).encode()).hexdigest()[:16]
        found = self.load(f"{name}-{key}")
        if found is None:
            self.save(f"{name}-{key}", make())
            found = self.load(f"{name}-{key}")
        return found
