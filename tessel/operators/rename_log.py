"""Renaming in two phases behind a write-ahead manifest, with a replay that can be repeated.

All is tables: a manifest (batch_id, from, to) is written before anything moves; then every file goes to a temporary name, then to its final one; the
manifest goes last. After an interruption ``classify`` says for every batch where it stands and ``replay`` what is still to be moved, from the names
that are there alone, so that an interrupted replay is replayed as well."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.operators.renames import TEMP_PREFIX
from tessel.sources import shared

MANIFEST = "batch_id string, `from` string, `to` string"


def temp_name(batch: Column, to: Column) -> Column:
    return F.concat(F.lit(TEMP_PREFIX), batch, F.lit("_"), to)


def state(manifest: DataFrame, names: DataFrame) -> DataFrame:
    """(batch_id, from, to, temp, has_from, has_temp, has_to) for each row of a manifest."""
    rows = manifest.withColumn("temp", temp_name(F.col("batch_id"), F.col("to")))
    for c in ("from", "temp", "to"):
        here = names.select(F.col("filename").alias(c)).distinct().withColumn(f"has_{c}", F.lit(True))
        rows = rows.join(here, c, "left").withColumn(f"has_{c}", F.coalesce(f"has_{c}", F.lit(False)))
    return rows.select("batch_id", "from", "to", "temp", "has_from", "has_temp", "has_to")


def classify(manifest: DataFrame, names: DataFrame) -> DataFrame:
    """(batch_id, status, to_first, to_second) of every batch that has a manifest or temporary names; no row at all: nothing is open (none).

    completed: temporary names are there, so both phases can be finished (so many first and second moves are open), or all targets are, so the
    manifest is stale; orphaned: temporary names without a manifest, or a manifest with neither temporary names nor all targets."""
    rows = state(manifest, names)
    # a target that another row's original still has isn't this row's file
    taken = rows.select("batch_id", F.col("from").alias("to")).distinct().withColumn("taken", F.lit(True))
    rows = rows.join(taken, ["batch_id", "to"], "left")
    open_first = ~F.col("has_temp") & F.col("has_from")
    per = rows.groupBy("batch_id").agg(F.count_if("has_temp").alias("temps"), F.count_if(~F.col("has_to")).alias("missing"), F.count_if(open_first).alias("first"))
    going = F.col("temps") > 0
    status = F.when(going | (F.col("missing") == 0), "completed").otherwise("orphaned")
    first = F.when(going, F.col("first")).otherwise(F.lit(0))
    known = per.select("batch_id", status.alias("status"), first.alias("to_first"), F.when(going, F.col("temps") + F.col("first")).otherwise(F.lit(0)).alias("to_second"))
    left = names.where(F.col("filename").startswith(TEMP_PREFIX)).select(F.regexp_extract("filename", "^" + TEMP_PREFIX.replace(".", r"\.") + "([^_]*)_", 1).alias("batch_id")).distinct()
    lost = left.join(manifest.select("batch_id"), "batch_id", "left_anti")
    return known.unionByName(lost.select("batch_id", F.lit("orphaned").alias("status"), F.lit(0).cast("long").alias("to_first"), F.lit(0).cast("long").alias("to_second")))


def overall(classified: DataFrame) -> DataFrame:
    """(status) of all batches together: none without any, orphaned if any is, else completed."""
    n = F.count("*")
    return classified.agg(F.when(n == 0, "none").when(F.count_if(F.col("status") == "orphaned") > 0, "orphaned").otherwise("completed").alias("status"))


def replay(manifest: DataFrame, names: DataFrame) -> DataFrame:
    """(batch_id, phase, from, to): the moves that finish the batches that can be, phase 1 (to temporary names) before phase 2."""
    can = classify(manifest, names).where("status = 'completed' AND to_second > 0").select("batch_id")
    rows = state(manifest, names).join(can, "batch_id", "left_semi")
    first = rows.where("NOT has_temp AND has_from").select("batch_id", F.lit(1).alias("phase"), "from", F.col("temp").alias("to"))
    second = rows.where("has_temp OR has_from").select("batch_id", F.lit(2).alias("phase"), F.col("temp").alias("from"), "to")
    return first.unionByName(second)


def applied(names: DataFrame, moves: DataFrame) -> DataFrame:
    """(filename) after the moves of both phases, or of any part of them."""
    got = names.select("filename")
    for phase in (1, 2):
        m = moves.where(F.col("phase") == phase).select(F.col("from").alias("filename"), "to")
        got = got.join(m, "filename", "left").select(F.coalesce("to", "filename").alias("filename"))
    return got


class RenameLog:
    """The manifests of open batches, below a root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def begin(self, mapping: DataFrame) -> str:
        """Writes the manifest of a mapping (from, to) and names the batch."""
        batch = uuid.uuid4().hex[:8]
        mapping.select("from", "to").write.mode("error").parquet(f"{self.root}/batch_id={batch}")
        return batch

    def open(self) -> DataFrame:
        """MANIFEST of all open batches."""
        try:
            rows = self.spark.read.schema("`from` string, `to` string, batch_id string").parquet(self.root)
        except AnalysisException:
            return self.spark.createDataFrame([], MANIFEST)
        return rows.select("batch_id", "from", "to")

    def done(self, batch: str) -> None:
        shared.delete(self.spark, f"{self.root}/batch_id={batch}")
