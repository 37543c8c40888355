"""A log as a table: stamped, tagged lines that are appended, of which the last ones are kept."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.sources import shared

#: Fixed value: how many lines are kept when a log is opened.
MOST = 50_000
LINES = "ts timestamp_ntz, seq long, tag string, message string"


def line(ts: Column, tag: Column, message: Column, error: Column | None = None) -> Column:
    """A line of text; with ``error`` (not null) one of an error."""
    stamp = F.concat(F.lit("["), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z] ["), tag, F.lit("] "))
    return F.concat(stamp, message) if error is None else F.concat(stamp, F.lit("ERROR "), message, F.coalesce(F.concat(F.lit(": "), error), F.lit("")))


def last_lines(lines: DataFrame, most: int = MOST) -> DataFrame:
    """The last lines by (ts, seq): each task keeps its own last ones, so no more than these meet."""
    return lines.orderBy(F.desc("ts"), F.desc("seq")).limit(most)


class LogTable:
    """Lines below a root, in files that are only added; ``open`` leaves the last ones."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def lines(self) -> DataFrame:
        try:
            return self.spark.read.schema(LINES).parquet(f"{self.root}/*")
        except AnalysisException:
            return self.spark.createDataFrame([], LINES)

    def append(self, lines: DataFrame) -> None:
        """lines: LINES; seq tells lines of one moment apart."""
        lines.select(*(c.split()[0] for c in LINES.split(", "))).write.parquet(f"{self.root}/{uuid.uuid4().hex}")

    def open(self, most: int = MOST) -> int:
        """Leaves the last lines if there are more; how many there are. The new file is whole before the old ones go."""
        if (n := self.lines().count()) <= most:
            return n
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        old = [s.getPath().toString() for s in folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(folder)]
        self.append(last_lines(self.lines(), most))
        for path in old:
            shared.delete(self.spark, path)
        return most
