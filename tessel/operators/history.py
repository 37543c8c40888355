"""Versions of the groups: an append-only log of changes with snapshots, read as of any version, and undo.

Tables below a root: ``changes/version=v`` (the rows a version adds, changes or drops), ``snapshots/version=v`` (every so many versions all
members), and ``log/version=v`` (one row, written last: a version without it was never committed). Nothing is overwritten, so readers of an old
version are never disturbed, and a second writer of the same version fails instead of losing an edit."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: how many edits can be undone.
UNDO = 10
KEY = ["group_id", "filename"]
ROWS = "group_id string, filename string, name string, group_pos long, member_pos long"
_REST = ["name", "group_pos", "member_pos"]
_LOG = "action string, undo array<long>"


def _typed() -> list[Column]:
    return [F.col("name"), F.col("group_pos").cast("long").alias("group_pos"), F.col("member_pos").cast("long").alias("member_pos")]


def change_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kept, ROWS): rows of ``after`` that ``before`` lacks or has otherwise, and rows that are gone (kept false)."""
    was = before.select(*KEY, F.struct(*_REST).alias("was"), F.lit(True).alias("__b"))
    now = after.select(*KEY, F.struct(*_typed()).alias("now"), F.lit(True).alias("__a"))
    both = was.join(now, KEY, "full").where("__a IS NULL OR __b IS NULL OR NOT (was <=> now)")
    return both.select(F.col("__a").isNotNull().alias("kept"), *KEY, *(F.coalesce(F.col("now")[c], F.col("was")[c]).alias(c) for c in _REST))


def replayed(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """ROWS: the members of a snapshot after later changes (version, kept, ROWS); of a member's changes the last counts."""
    base = snapshot.select(F.lit(-1).cast("long").alias("version"), F.lit(True).alias("kept"), *KEY, *_typed())
    last = F.max_by(F.struct("kept", *_REST), "version").alias("last")
    return base.unionByName(changes.select(*base.columns)).groupBy(*KEY).agg(last).where("last.kept").select(*KEY, *(F.col(f"last.{c}") for c in _REST))


class GroupLog:
    """members: group_id, name, group_pos, filename, member_pos."""

    def __init__(self, spark: SparkSession, root: str, every: int = 16):
        self.spark, self.root, self.every = spark, root.rstrip("/"), every

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{schema}, version long").parquet(f"{self.root}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], f"{schema}, version long")

    def log(self) -> DataFrame:
        """(action, undo, version) of the committed versions."""
        return self._table("log", _LOG)

    def _last(self) -> tuple[int, list[int]]:
        row = self.log().orderBy(F.desc("version")).first()
        return (-1, []) if row is None else (row.version, list(row.undo))

    def version(self) -> int:
        """The current version; -1 before the first."""
        return self._last()[0]

    def as_of(self, version: int | None = None) -> DataFrame:
        """ROWS of a version, by default the current one."""
        now = self.version()
        if version is not None and version > now:
            raise LookupError(f"no version {version}")
        return self._as_of(now if version is None else version)

    def _as_of(self, version: int) -> DataFrame:
        """The last snapshot and the changes after it; up to a committed version all numbers are committed, since a number is taken again until its log is there."""
        start = version - version % self.every
        snapshot = self._table("snapshots", ROWS).where(F.col("version") == start)
        later = self._table("changes", f"kept boolean, {ROWS}").where((F.col("version") > start) & (F.col("version") <= version))
        return replayed(snapshot.drop("version"), later)

    def _write(self, members: DataFrame, action: str, undo: list[int], version: int) -> int:
        path = lambda name: f"{self.root}/{name}/version={version}"
        if not version % self.every:
            members.select(*KEY, *_typed()).write.mode("overwrite").parquet(path("snapshots"))
        else:
            change_rows(self._as_of(version - 1), members).write.mode("overwrite").parquet(path("changes"))
        # the commit: fails if another writer has made this version meanwhile
        self.spark.createDataFrame([(action, undo)], _LOG).coalesce(1).write.mode("error").parquet(path("log"))
        return version

    def commit(self, members: DataFrame, action: str) -> int:
        """A new version with these members; the one before can be undone to."""
        now, undo = self._last()
        return self._write(members, action, [*undo, now][-UNDO:] if now >= 0 else [], now + 1)

    def undo(self) -> int | None:
        """A new version with the members from before the last edit that isn't undone yet; None if there is none within reach."""
        now, undo = self._last()
        return self._write(self._as_of(undo[-1]), "undo", undo[:-1], now + 1) if undo else None

    def changes(self) -> DataFrame:
        """(version, action, put, dropped): how many rows each version has changed; a snapshot's version has nulls."""
        rows = self._table("changes", f"kept boolean, {ROWS}").groupBy("version").agg(F.count_if("kept").alias("put"), F.count_if(~F.col("kept")).alias("dropped"))
        return self.log().join(rows, "version", "left").select("version", "action", "put", "dropped")
