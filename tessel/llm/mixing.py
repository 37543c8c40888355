"""Mixing sources to target weights by Pfair scheduling (op 2).

Each source's rows, in hash order, form blocks of ``block_rows``. A source's target grows by its share of the weights of the
sources that have something left, so that at slot t the targets sum to t. Its block j may be released at the slot in which
its target passes j blocks and is due when it reaches j + 1; earliest deadline first fills the slots. Such a schedule
always exists, and in it each source is less than one block from its target at every slot, to the end of the table.
Targets are exact: weights are taken as the rational numbers that the floats are, and nothing is rounded but the releases
(down) and deadlines (up). When a source's target has reached its size the shares of the others are scaled up: every
row is placed, none is dropped or repeated. The schedule is one sequential chain with one step a block.

Ranks within a source come from one range-partitioned sort by (source, hash), which spreads a source of any size over
tasks, plus the counts of each partition's share; nothing is collected. Every source is scheduled by itself, however
many there are: one task holds a row for each source and writes the schedule, a row for each block, as a table. The
counts are broadcast for up to ``broadcast_sources`` sources or so, the schedule up to BROADCAST_BLOCKS; beyond, both are joined
by a shuffle.

A null source is a source of its own. Null ids and repeated rows are rows like others. Weights of 0 or less, or missing
ones where weights are given, come after all others have ended, by size. Columns may have any names. An empty table: no rows."""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Scratch, shuffle_partitions

#: Larger tables of blocks are joined by a shuffle.
BROADCAST_BLOCKS = 100_000


def whole_weights(weights: list[float]) -> list[int]:
    """Integers in exactly the proportion of the (finite) weights."""
    exact = [Fraction(w) for w in weights]
    scale = math.lcm(*(x.denominator for x in exact))
    out = [int(x * scale) for x in exact]
    common = math.gcd(*out) or 1
    return [x // common for x in out]


def schedule(blocks: list[int], weights: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(source, block, slot, release, deadline) slot by slot, for positive weights: of the released blocks the one that is due first, then the smaller source."""
    live = [i for i, n in enumerate(blocks) if n]
    ends = sorted(live, key=lambda i: Fraction(blocks[i], weights[i]))  # as their shares are used up
    gone = [0, *itertools.accumulate(blocks[i] for i in ends)]
    rest = [*itertools.accumulate((weights[i] for i in reversed(ends)), initial=0)][::-1]

    def when(i: int, j: int) -> tuple[int, int]:
        """The slots, rounded down and up, at which the share of source i amounts to j blocks: the sum over all sources k of min(blocks[k], weights[k] * j / weights[i])."""
        w, low, high = weights[i], 0, len(ends)
        while low < high:
            mid = (low + high) // 2
            if blocks[ends[mid]] * w <= j * weights[ends[mid]]:
                low = mid + 1
            else:
                high = mid
        whole, part = divmod(rest[low] * j, w)
        return gone[low] + whole, gone[low] + whole + (part > 0)

    waiting, ready = [(0, i, 0, when(i, 1)) for i in live], []
    heapq.heapify(waiting)
    for t in range(sum(blocks)):
        while waiting and waiting[0][0] <= t:
            release, i, j, due = heapq.heappop(waiting)
            heapq.heappush(ready, (due[1], i, j, release, due[0]))
        deadline, i, j, release, after = heapq.heappop(ready)
        if deadline <= t:
            raise AssertionError("a block is late")
        yield i, j, t, release, deadline
        if j + 1 < blocks[i]:
            heapq.heappush(waiting, (after, i, j + 1, when(i, j + 2)))


def whole_schedule(blocks: list[int], weights: list[float]) -> Iterator[tuple[int, int, int, int, int]]:
    """schedule of the sources with weights, and after it that of the others by their size."""
    base = 0
    for those in ([i for i, w in enumerate(weights) if w > 0], [i for i, w in enumerate(weights) if not w > 0]):
        if those:
            level = [weights[i] if weights[i] > 0 else blocks[i] or 1 for i in those]
            for k, j, *at in schedule([blocks[i] for i in those], whole_weights(level)):
                yield those[k], j, *(base + x for x in at)
            base += sum(blocks[i] for i in those)


#: What mix_sources adds.
ADDED = ["__block", "__release", "__deadline", "__slot", "__position"]


def _numbered(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns c0, c1 and so on, whatever they are called, and the columns that give them their names back."""
    named = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    return named, [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]


def mix_sources(docs: DataFrame, *args, **options) -> DataFrame:
    """All columns of ``docs`` and __block, __release, __deadline, __slot, __position, which replace columns of these names. Without weights a source's weight is its number of rows to ``power``."""
    got, back = _mixed(docs, *args, **options)
    return got.select(*(b for b, c in zip(back, docs.columns, strict=True) if c.lower() not in ADDED), *ADDED)


def mixed_order(docs: DataFrame, *args, **options) -> DataFrame:
    """The rows of ``docs`` in their mixed order, all columns as they are."""
    got, back = _mixed(docs, *args, **options)
    n = shuffle_partitions(docs.sparkSession)
    return got.repartitionByRange(n, "__position").sortWithinPartitions("__position").select(*back)


def _mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.5, block_rows: int = 64, broadcast_sources: int = 200, seed: int = 1, id_col: str = "doc_id", source_col: str = "source") -> tuple[DataFrame, list[Column]]:
    """The numbered columns and the added ones, and the columns that give the former their names back."""
    spark, labels = docs.sparkSession, docs.columns
    id_col, source_col = (f"c{labels.index(c)}" for c in (id_col, source_col))
    docs, back = _numbered(docs)
    store, n = Scratch(spark, "mixing"), shuffle_partitions(spark)
    kind = docs.schema[source_col].dataType
    drawn = docs.withColumn("__class", F.col(source_col)).withColumn("__hash", F.xxhash64(F.lit(seed), F.col(id_col)))
    ordered = drawn.repartitionByRange(n, "__class", "__hash", id_col).sortWithinPartitions("__class", "__hash", id_col).withColumn("__at", F.monotonically_increasing_id())
    ordered = store.save(ordered, "ordered").withColumn("__part", F.shiftright("__at", 33))
    parts = store.save(ordered.groupBy(F.col("__class").alias("__c"), F.col("__part").alias("__p")).agg(F.count("*").alias("n"), F.min("__at").alias("lo")), "parts")
    before = F.sum("n").over(Window.partitionBy("__c").orderBy("__p")) - F.col("n")
    start = parts.select("__c", "__p", (before - F.col("lo")).alias("__start"))
    sources = parts.groupBy("__c").agg(F.sum("n").alias("n"))
    fields = [("__c", kind), *((c, LongType()) for c in ("__b", "__slot", "__release", "__deadline"))]

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(i, k) for batch in batches for i, k in zip(batch.column(0), batch.column(1).to_pylist(), strict=True)]
        held = sorted(((s.as_py(), s, k) for s, k in held), key=lambda x: (-x[2], x[0] is not None, x[0] if x[0] is not None else 0))
        level = [float((weights or {}).get(x, 0)) if weights is not None else k**power for x, _, k in held]
        rows = whole_schedule([-(-k // block_rows) for *_, k in held], level)
        while some := list(itertools.islice(rows, 1 << 16)):
            columns = list(zip(*some, strict=True))
            names = pa.array([held[i][0] for i in columns[0]], held[0][1].type)
            yield pa.RecordBatch.from_arrays([names, *(pa.array(c, pa.int64()) for c in columns[1:])], [c for c, _ in fields])

    table = store.save(sources.coalesce(1).mapInArrow(plan, StructType([StructField(*f) for f in fields])), "schedule")
    few = parts.limit(broadcast_sources * n + 1).count() <= broadcast_sources * n
    small = table.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS
    start, table = F.broadcast(start) if few else start.hint("merge"), F.broadcast(table) if small else table.hint("merge")
    got = ordered.join(start, F.col("__class").eqNullSafe(F.col("__c")) & (F.col("__part") == F.col("__p"))).drop("__c", "__p")
    got = got.withColumn("__rank", F.col("__at") + F.col("__start")).withColumn("__block", F.expr(f"__rank div {block_rows}"))
    got = got.join(table, F.col("__class").eqNullSafe(F.col("__c")) & (F.col("__block") == F.col("__b")))
    got = got.withColumn("__position", F.col("__slot") * block_rows + F.pmod(F.col("__rank"), F.lit(block_rows)))
    return got.select(*docs.columns, *ADDED), back


def in_written_order(docs: DataFrame) -> DataFrame:
    """The rows of a table of Parquet files that was written from mixed_order, in that order again.

    Spark reads files by falling size, so the order is taken from the numbers of the part files and the rows' places in them."""
    n = shuffle_partitions(docs.sparkSession)
    keys = {"__part": F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long"), "__file": F.col("_metadata.file_name"), "__row": F.col("_metadata.row_index")}
    placed = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)), *(c.alias(k) for k, c in keys.items()))
    return placed.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
