"""Exact values at given ranks of large groups, without sorting a group in one task.

Each wanted rank has an interval that holds its value. While an interval has many rows, they are counted in buckets (which combine on the map side) and
the interval becomes the bucket with the rank, from its least to its largest value; then the different values left are counted and ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.sources import shared

#: Rows of an interval that are ranked as they are, and buckets of a pass.
SMALL, BUCKETS = 1 << 18, 1024


def at_shares(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], falling: bool = False, small: int = SMALL, buckets: int = BUCKETS) -> DataFrame:
    """(by, a column for each share, n): of a group's n values in order the one at index floor(n * share), from 0. Rows with null values don't count.

    rows should be cheap to read (a written table), for it is read once a pass."""
    rows = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(float(s)).alias("share")) for name, s in shares.items())))
    open_ = rows.groupBy(*by).agg(F.count("*").alias("total"), F.min("__v").alias("lo"), F.max("__v").alias("hi")).withColumn("__w", wanted)
    rank = F.least(F.col("total") - 1, F.floor(F.col("total") * F.col("__w.share")))
    rank = F.col("total") - 1 - rank if falling else rank
    open_ = open_.select(*by, "total", F.col("__w.name").alias("name"), "lo", "hi", rank.alias("rank"), F.col("total").alias("n"))
    key = [*by, "name"]
    folder = shared.fresh_folder(rows.sparkSession, "selection")
    turn = 0
    while True:
        open_ = shared.saved(open_, f"{folder}/{turn}")
        large = open_.where((F.col("n") > small) & (F.col("lo") < F.col("hi")))
        if not large.limit(1).count():
            break
        turn += 1
        held = rows.join(large, by).where("__v BETWEEN lo AND hi")
        at = F.least(F.lit(buckets - 1), F.floor((F.col("__v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets))
        counts = held.withColumn("b", at).groupBy(*key, "total", "rank", "b").agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy(*key).orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
        counts = counts.withColumn("upto", upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        narrowed = counts.select(*by, "total", "name", "lo", "hi", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "n")
        open_ = open_.where((F.col("n") <= small) | (F.col("lo") >= F.col("hi"))).unionByName(narrowed)
    known = open_.where("lo >= hi").select(*key, "total", F.col("lo").alias("value"))
    last = rows.join(open_.where("lo < hi"), by).where("__v BETWEEN lo AND hi").groupBy(*key, "total", "rank", "__v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*key).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    last = last.withColumn("upto", upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))
    got = known.unionByName(last.select(*key, "total", F.col("__v").alias("value")))
    columns = [F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in shares]
    return got.groupBy(*by).agg(*columns, F.max("total").alias("n"))
