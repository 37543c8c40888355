"""Audit of how text filters interact (op 11), by a Walsh-Hadamard transform; DataFrame functions only.

Every document has a mask of the five filters that it fails. Not the masks are counted but, per part and label, the 32 signed
parity sums (for each set of filters: documents failing an even number of them less those failing an odd number). They are sums, so
they combine on the map side and a part of any size is 32 numbers a task. The transform is its own inverse up to the factor 32: it gives
the number of documents of every mask exactly, and from these 32 cells every order of the filters, at every step, follows without
looking at a document again. A document that fails m filters is removed by each of them in 120 / m of the 120 orders: the Shapley
sums in closed form.

Filters: A fewer words than 200; B fewer than half of the words different; C more than 3 % of the characters in A-Z; D any of
``#$%&*|``; E identical (sha256) to a text of a smaller id, in the whole table. Copies meet as counts by text, part and label,
pre-aggregated, so a large group of copies is a few rows. Null texts are empty, null parts the empty string; a null id is never
smaller or larger than another, rows of an equal id aren't each other's copies; a label counts if any of the id's rows has it.
An empty table has no parts and gives no rows."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space, and the filters in the order of their bits.
SPACE, FILTERS = r"[\x20\x09-\x0D]+", "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
CELLS = 1 << len(FILTERS)


def failures(text: Column) -> dict[str, Column]:
    """The conditions A to D of a text without nulls."""
    words = F.array_remove(F.split(text, SPACE), "")
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def mask(failed: dict[str, Column]) -> Column:
    return sum((F.when(c, 1 << FILTERS.index(f)).otherwise(0) for f, c in failed.items()), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, good, toxic, mask, n): documents by part, labels and mask; several rows of the same are possible."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    own = own.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask(failures(F.col("text"))).alias("m"))
    said = labels.select(F.col(id_col).alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    said = said.groupBy("id").agg(*(F.coalesce(F.max(c), F.lit(False)).alias(c) for c in ("good", "toxic")))
    own = own.join(said, "id", "left").withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("good", "toxic")})
    key = ["digest", "part", "good", "toxic"]
    rows = own.groupBy(*key, "id").agg(F.count("*").alias("n"), F.min("m").alias("m"))
    has = F.col("id").isNotNull()
    some = rows.groupBy(*key).agg(F.min("m").alias("m"), F.sum("n").alias("n"), F.min(F.when(has, F.struct("id", "n"))).alias("low"), F.coalesce(F.sum(F.when(~has, F.col("n"))), F.lit(0)).alias("free"))
    least = some.groupBy("digest").agg(F.min("low.id").alias("least"))
    some = some.join(least, "digest")
    first = F.col("free") + F.when(F.col("low.id") == F.col("least"), F.col("low.n")).otherwise(0)
    split = F.explode(F.array(F.struct(F.col("m").alias("mask"), first.alias("n")), F.struct((F.col("m") + (1 << FILTERS.index("E"))).alias("mask"), (F.col("n") - first).alias("n"))))
    return some.select("part", "good", "toxic", split.alias("x")).select("part", "good", "toxic", "x.mask", "x.n")


def parity_sums(counted: DataFrame) -> DataFrame:
    """(part, good, toxic, w): 32 signed sums, of set s the n of masks with an even number of filters of s less those with an odd number."""
    sign = lambda s: 1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(s)) % 2)
    got = counted.groupBy("part", "good", "toxic").agg(*(F.sum(F.col("n") * sign(s)).alias(f"w{s}") for s in range(CELLS)))
    return got.select("part", "good", "toxic", F.array(*(f"w{s}" for s in range(CELLS))).alias("w"))


def invert(w: Column) -> Column:
    """The 32 cells of 32 parity sums: the transform once more, five rounds of sums and differences, divided by 32."""
    cells = [w[s] for s in range(CELLS)]
    step = 1
    while step < CELLS:
        cells = [cells[i] + cells[i + step] if not i & step else cells[i - step] - cells[i] for i in range(CELLS)]
        step *= 2
    return F.transform(F.array(*cells), lambda c: (c / CELLS).cast("long"))


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """A row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    sums = parity_sums(masks(docs, labels, **columns))
    # the transform is linear: sums of a part are those of its labels together
    of = lambda c: F.sum(F.when(c, F.col("v")).otherwise(0))
    flat = sums.select("part", "good", "toxic", F.posexplode("w").alias("s", "v")).groupBy("part", "s").agg(F.sum("v").alias("every"), of(F.col("good")).alias("good"), of(F.col("toxic")).alias("toxic"))
    w = flat.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("s", "every", "good", "toxic"))).alias("w"))
    cells = w.select("part", *(invert(F.col("w")[c]).alias(c) for c in ("every", "good", "toxic")))
    # one literal of 600 (order, step, filter's bit, bits before it)
    steps = F.expr("array(" + ", ".join(f"struct('{o}' AS filter_order, {k + 1} AS step, {1 << FILTERS.index(f)} AS bit, {sum(1 << FILTERS.index(x) for x in o[:k])} AS before)" for o in ORDERS for k, f in enumerate(o)) + ")")
    rows = cells.select("*", F.explode(steps).alias("o")).select("*", "o.*")

    def total(cell: str, take, times=None) -> Column:
        terms = F.transform(F.col(cell), lambda n, m: F.when(take(m), n * times(m) if times else n).otherwise(0))
        return F.aggregate(terms, F.lit(0).cast("long"), lambda a, x: a + x)

    bit, before = F.col("bit"), F.col("before")
    has = lambda m, b: m.bitwiseAND(b) != 0
    now = lambda m: has(m, bit) & ~has(m, before)
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("every", lambda m: ~has(m, bit.bitwiseOR(before))).alias("kept"),
        total("every", now).alias("removed"),
        total("every", lambda m: has(m, bit) & has(m, before)).alias("redundant"),
        total("every", lambda m: m == bit).alias("unique_fails"),
        total("good", now).alias("good_lost"),
        total("toxic", now).alias("toxic_lost"),
        total("every", lambda m: has(m, bit), lambda m: (120 / F.bit_count(m)).cast("long")).alias("shapley"),
    )
