"""Document fingerprints as Merkle trees (op 13), DataFrame functions only.

A text is cut into sections (at empty lines), those into paragraphs (lines), those into phrases (after a mark ``.,;:!?`` and a
space). A phrase's node is its md5, an inner node the md5 of its children's, the root the sha256 of the sections'. All levels are
always there and no character is left out, so two texts have the same root just if they are equal, up to collisions of these hashes.

The fingerprint is a string: the root (64 hexadecimal digits), then ``/`` and 16 digits for each section, behind it ``.`` and
12 digits for each of its paragraphs, behind those ``-`` and 8 digits for each phrase. ``likeness`` compares two of them by their
different phrases (Dice's measure; 1 only for equal roots), ``differing`` goes down from the root and enters only branches that
the other tree doesn't have, so it says in which section and paragraph a text was edited.

``compare_with_next`` puts documents into the order of descending id: ids alone are numbered by a range-partitioned sort, then
blocks of 16 neighbours meet, the first of a block also in the one before. Texts are moved twice; nothing grows with a hot value but a
repeated id: rows of one id share their block (ids are keys), and share their next document, which is the least text among the rows of
the next id. Null texts count as empty, null ids come last. After the last id comes the first, which may be the only one. Empty table: no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Documents that meet in a group.
BLOCK = 16
#: What ends a phrase, and the mark put behind it (one that stands in the text itself cuts there too, so no two texts get the same tree).
PHRASE_END, CUT = "([.,;:!?] )", "\x01"
#: Hexadecimal digits kept of a section, a paragraph, a phrase.
SECTION, PARAGRAPH, PHRASE = 16, 12, 8


def _split(c: Column, by: str) -> Column:
    return F.split(c, by, -1)


def tree(text: Column) -> Column:
    """array<struct<hash, paragraphs: array<struct<hash, phrases: array<string>>>>> of a text: its sections."""
    phrases = lambda p: F.transform(_split(F.regexp_replace(p, PHRASE_END, "$1" + CUT), CUT), F.md5)
    node = lambda below, name: lambda x: F.struct(F.md5(F.concat_ws("", below(x))).alias("hash"), x.alias(name))
    paragraphs = lambda s: F.transform(F.transform(_split(s, "\n"), phrases), node(lambda x: x, "phrases"))
    return F.transform(F.transform(_split(text, "\n\n"), paragraphs), node(lambda x: x["hash"], "paragraphs"))


def root(sections: Column) -> Column:
    return F.sha2(F.concat_ws("", sections["hash"]), 256)


def as_string(sections: Column) -> Column:
    """The fingerprint of a tree."""
    short = lambda mark, h, n: F.concat(F.lit(mark), F.substring(h, 1, n))
    phrases = lambda p: F.concat(short(".", p["hash"], PARAGRAPH), F.array_join(F.transform(p["phrases"], lambda x: short("-", x, PHRASE)), ""))
    section = lambda s: F.concat(short("/", s["hash"], SECTION), F.array_join(F.transform(s["paragraphs"], phrases), ""))
    return F.concat(root(sections), F.array_join(F.transform(sections, section), ""))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` and the fingerprint of a column without nulls."""
    held = "__tree" + "_" * max(map(len, df.columns))
    return df.withColumn(held, tree(F.col(text))).withColumn(name, as_string(F.col(held))).drop(held)


def leaves(fingerprint: Column) -> Column:
    """The different phrases of a fingerprint."""
    return F.array_distinct(F.regexp_extract_all(fingerprint, F.lit(f"-([0-9a-f]{{{PHRASE}}})"), F.lit(1)))


def text_leaves(text: Column) -> Column:
    """What ``leaves`` finds in a text's fingerprint, without the tree: texts are smaller to move than fingerprints, whose digits don't compress."""
    return F.array_distinct(F.transform(_split(F.regexp_replace(text, PHRASE_END, "$1" + CUT), "\n\n|\n|" + CUT), lambda x: F.substring(F.md5(x), 1, PHRASE)))


def leaf_likeness(same_root: Column, a: Column, b: Column) -> Column:
    """Of two sets of phrases."""
    n = F.size(a) + F.size(b)
    return F.when(same_root, 1.0).otherwise(F.least(2.0 * F.size(F.array_intersect(a, b)) / n, 1.0 - 1.0 / n))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the share of phrases that two fingerprints have in common."""
    return leaf_likeness(F.substring(a, 1, 64) == F.substring(b, 1, 64), leaves(a), leaves(b))


def _branches(fingerprint: Column, mark: str) -> Column:
    """What stands behind the root, cut at each mark: the node's digits first, what is below it behind them."""
    return F.slice(_split(fingerprint, mark), 2, F.length(fingerprint))


def differing(a: Column, b: Column) -> Column:
    """array<struct<section, paragraph>> (from 0): the paragraphs of b that a doesn't have in any section, entered only below sections that
    a doesn't have. Empty for equal roots, and where b has lost or moved whole paragraphs only."""
    digits = lambda xs, n: F.transform(xs, lambda x: F.substring(x, 1, n))
    mine = _branches(a, "/")
    known = digits(mine, SECTION)
    lines = digits(F.flatten(F.transform(mine, lambda s: F.slice(_split(s, r"\."), 2, F.length(s)))), PARAGRAPH)

    def below(s: Column, i: Column) -> Column:
        own = digits(F.slice(_split(s, r"\."), 2, F.length(s)), PARAGRAPH)
        new = F.filter(F.transform(own, lambda p, j: F.when(~F.array_contains(lines, p), F.struct(i.cast("int").alias("section"), j.cast("int").alias("paragraph")))), lambda x: x.isNotNull())
        return F.when(F.array_contains(known, F.substring(s, 1, SECTION)), F.slice(new, 1, F.lit(0))).otherwise(new)

    got = F.flatten(F.transform(_branches(b, "/"), below))
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), F.slice(got, 1, F.lit(0))).otherwise(got)


def id_positions(ids: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(id, pos) of the different values of a column ``id``, from 0 in descending order, and their number."""
    at = ids.distinct().repartitionByRange(F.col("id").desc_nulls_last()).sortWithinPartitions(F.col("id").desc_nulls_last())
    at = scratch.save(at.withColumn("at", F.monotonically_increasing_id()), "ids").withColumn("part", F.shiftright("at", 33))
    # a row for each partition: where it begins less its first number
    counts = at.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("low"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("part", (F.coalesce(before, F.lit(0)) - F.col("low")).alias("start"))
    return at.join(F.broadcast(starts), "part").select("id", (F.col("at") + F.col("start")).alias("pos")), at.count()


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, n_chars, fingerprint, edited_fingerprint (the last third replaced by as much of the next document's beginning),
    edited_sha256, near_edited, near_next, edited_at (where the edited text's tree differs first, "section.paragraph"; null where it doesn't)."""
    scratch = Scratch(docs.sparkSession, "fingerprints")
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    at, n = id_positions(own.select("id"), scratch)
    rows = own.join(at.withColumnRenamed("id", "key"), F.col("id").eqNullSafe(F.col("key"))).drop("key")
    place = lambda block, order, mine: F.struct(block.cast("long").alias("block"), order.cast("long").alias("order"), F.lit(mine).alias("own"))
    block, pos = F.floor(F.col("pos") / BLOCK), F.col("pos")
    first = F.when(pos == 0, place(F.lit((n - 1) // BLOCK), F.lit(n), False)).otherwise(place(block - 1, pos, False))
    places = F.when(pos % BLOCK == 0, F.array(place(block, pos, True), first)).otherwise(F.array(place(block, pos, True)))
    met = rows.select("id", "text", F.explode(places).alias("p")).select("id", "text", "p.*")
    w = Window.partitionBy("block").orderBy("order").rangeBetween(1, 1)
    met = met.withColumn("next", F.min("text").over(w)).where("own")
    met = with_fingerprint(met.select("id", "text", "next", F.length("text").cast("long").alias("n_chars")), "text", "fp")
    size = F.col("n_chars")
    third = F.floor(size / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (size - third).cast("int")), F.substring("next", F.lit(1), third))
    got = met.select("id", "n_chars", "fp", (F.col("text") == F.col("next")).alias("same_next"), text_leaves(F.col("next")).alias("next_leaves"), edited.alias("edited"))
    got = with_fingerprint(got, "edited", "edited_fp").withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    got = got.withColumns({"mine": leaves(F.col("fp")), "edit_leaves": leaves(F.col("edited_fp"))})
    same_edit = F.substring("fp", 1, 64) == F.substring("edited_fp", 1, 64)
    where = F.get(differing(F.col("fp"), F.col("edited_fp")), F.lit(0))
    return got.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        F.col("fp").alias("fingerprint"),
        F.col("edited_fp").alias("edited_fingerprint"),
        leaf_likeness(same_edit, F.col("mine"), F.col("edit_leaves")).alias("near_edited"),
        leaf_likeness(F.col("same_next"), F.col("mine"), F.col("next_leaves")).alias("near_next"),
        F.concat_ws(".", where["section"], where["paragraph"]).alias("edited_at"),
    )
