"""Dense positions of rows in an order, without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.sources import shared

#: Lists of up to this many rows are numbered by one window; longer ones by a range-partitioned sort.
SINGLE = 200_000


def with_positions(df: DataFrame, *keys: Column | str, name: str = "pos", single: int | None = None) -> DataFrame:
    """``df`` and each row's place (from 0) by the keys, which must tell all rows apart. Not nullable keys sort as Spark sorts."""
    single = SINGLE if single is None else single
    names = [f"__k{i}" for i in range(len(keys))]
    keyed = df.withColumns({n: (F.col(k) if isinstance(k, str) else k) for n, k in zip(names, keys, strict=True)})
    if name in df.columns:
        keyed = keyed.drop(name)
    if df.limit(single + 1).count() <= single:
        return keyed.withColumn(name, (F.row_number().over(Window.orderBy(*names)) - 1).cast("long")).drop(*names)
    at = keyed.repartitionByRange(*names).sortWithinPartitions(*names).withColumn("__at", F.monotonically_increasing_id())
    at = shared.saved(at, shared.fresh_folder(df.sparkSession, "positions"))
    at = at.withColumn("__p", F.shiftright("__at", 33))
    starts, total = [], 0
    for p, n, lo in sorted(tuple(r) for r in at.groupBy("__p").agg(F.count("*"), F.min("__at")).collect()):
        starts.append((p, total - lo))
        total += n
    start = F.broadcast(df.sparkSession.createDataFrame(starts, "__p long, __s long"))
    return at.join(start, "__p").withColumn(name, F.col("__at") + F.col("__s")).drop("__p", "__s", "__at", *names)
