"""Repair of conversation structure (op 12) by shortest paths with small integer costs.

The repaired role initials must match ``(s?(ua)+)?``, an automaton of four states. The nodes of a conversation's graph are (row, state);
arcs are the edits: Keep 0, Rerole 1, Delete 2, Insert 5, a truncated row that stays 5 more. Costs are at most 6, so Dial's bucket queue
(seven buckets in a ring) settles all nodes from the end backwards without a heap; the distances are recorded, and a walk from
the start along tight arcs, always the ASCII-least letter, gives the audit and the repaired rows. From a node each letter leads to
one other node, so the walk's string is the least of all cheapest ones.

Rows are dealt by conversation and sorted; a task reads them as a stream and holds one conversation's flags, distances and audit (18 bytes a
row), never its texts: each row comes twice, first without its text (facts, then the queue runs), then with it (walk and hash). A
conversation's hash has an order, so its rows do go through one task, by Arrow batches. Which rows are repetitions is found before by a
window over the same rows without their texts.

Null conversation ids are one conversation; null turns come first, null roles and texts are one space; rows of one turn are taken by role and
the md5 of their text. Roles count by their first letter, an empty role by none, so it can't be kept. A role that isn't user or assistant
has to be changed or deleted, and so has a system row after the first. Empty table: no rows."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

#: Costs of the edits, and what a truncated row that stays costs more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
WHITE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: Of each state the state after an insertion or a changed role, the role that leads there.
NEXT = (USER, USER, ASSISTANT, USER)
NAME = {USER: "user", ASSISTANT: "assistant"}
ENDS = (START, ASSISTANT)
#: Which role may be kept in a state, as its initial.
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
OTHER, GONE, CUT_SHORT = 3, 4, 8
SYMBOLS = "sua"
FAR = 1 << 30

FACTS = "blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv, turn, role, text, copy, lost) after the damage that crc32("id:turn") % 20 decides: 0 the row goes, 1 its text does, 2 its ``.!?`` do, 3 it
    comes twice, 4 its role becomes user. A lost row stays as a mark of its conversation."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said(id_col), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    got = rows.select(F.col(id_col).alias("conv"), "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return got.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy"), (F.col("kind") == 0).alias("lost"))


def facts(rows: DataFrame) -> DataFrame:
    """(conv, lost, turn, role, digest, again, blank, truncated) of rows as damaged() gives them; again: the role and text were seen earlier."""
    end = F.rtrim("text", F.lit(WHITE))
    got = rows.select("conv", "lost", "turn", "role", _digest().alias("digest"), (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("truncated"))
    # lost rows are marks only; they must not hide a later row
    seen = F.row_number().over(Window.partitionBy("conv", "lost", "role", "digest").orderBy(F.col("turn").asc_nulls_first()))
    return got.withColumn("again", seen > 1)


def _digest() -> Column:
    return F.unhex(F.md5("text"))


def distances(flags: bytes | bytearray) -> array:
    """The cheapest cost from each node (row * 4 + state) to the end. flags of a row: its symbol (0-2 for s, u, a, else OTHER), GONE where it must be
    deleted, CUT_SHORT where it is truncated."""
    n = len(flags)
    far = array("i", [FAR]) * (4 * (n + 1))
    ring: list[list[int]] = [[] for _ in range(REROLE + TRUNCATED + 1)]
    for q in ENDS:
        far[4 * n + q] = 0
        ring[0].append(4 * n + q)
    at, empty = 0, 0
    while empty < len(ring):
        bucket = ring[at % len(ring)]
        if not bucket:
            at, empty = at + 1, empty + 1
            continue
        empty = 0
        node = bucket.pop()
        if far[node] != at:
            continue  # settled nearer
        i, q = node >> 2, node & 3
        arcs = [(node - q + p, INSERT) for p in range(4) if NEXT[p] == q]
        if i:
            f, row = flags[i - 1], node - q - 4
            arcs.append((row + q, DELETE))
            if not f & GONE:
                more = TRUNCATED if f & CUT_SHORT else 0
                arcs += [(row + p, REROLE + more) for p in range(4) if NEXT[p] == q]
                symbol = f & 3
                if symbol != OTHER:
                    arcs += [(row + p, KEEP + more) for p in range(4) if KEPT[p].get(SYMBOLS[symbol]) == q]
        for to, cost in arcs:
            if at + cost < far[to]:
                far[to] = at + cost
                ring[(at + cost) % len(ring)].append(to)
    return far


class Walk:
    """The path along tight arcs, a row at a time."""

    def __init__(self, flags: bytes | bytearray):
        self.flags, self.far = flags, distances(flags)
        self.row = self.state = START
        self.cost = self.far[START]
        self.letters = bytearray()

    def _insertions(self) -> Iterator[tuple[str, str]]:
        while True:
            here, to = self.far[4 * self.row + self.state], NEXT[self.state]
            if here != INSERT + self.far[4 * self.row + to]:
                return
            self.state = to
            self.letters += b"I"
            yield NAME[to], ""

    def take(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        """The next row's part of the repaired conversation."""
        f = self.flags[self.row]
        more = TRUNCATED if f & CUT_SHORT else 0
        deleted = lambda: self.far[4 * self.row + self.state] == DELETE + self.far[4 * self.row + 4 + self.state]
        if not deleted():
            for x in self._insertions():
                yield x
                if deleted():
                    break
        here, after = self.far[4 * self.row + self.state], 4 * self.row + 4
        kept = KEPT[self.state].get(SYMBOLS[f & 3]) if f & 3 != OTHER else None
        self.row += 1
        if here == DELETE + self.far[after + self.state]:
            self.letters += b"D"
        elif kept is not None and not f & GONE and here == KEEP + more + self.far[after + kept]:
            self.letters += b"K"
            self.state = kept
            yield role, text
        else:
            self.letters += b"R"
            self.state = NEXT[self.state]
            yield NAME[self.state], text

    def end(self) -> Iterator[tuple[str, str]]:
        yield from self._insertions()


class _Conversation:
    """What is known of the conversation that a task is reading."""

    def __init__(self, conv):
        self.conv, self.flags, self.walk = conv, bytearray(), None
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.role = None
        self.hash, self.begun = hashlib.sha256(), False

    def learn(self, turn, role: str, blank: bool, again: bool, truncated: bool) -> None:
        if turn is not None:
            if self.low is None:
                self.low = turn
            self.turns += turn != self.high
            self.high = turn
        self.illegal += bool(self.flags) and (self.role[:1] + role[:1]) not in ("su", "ua", "au")
        self.role = role
        symbol = SYMBOLS.find(role[0]) if role else -1
        f = OTHER if symbol < 0 else symbol
        if blank or again:
            f |= GONE
            self.blank += blank
            self.duplicate += not blank
        elif truncated:
            f |= CUT_SHORT
            self.truncated += 1
        self.flags.append(f)

    def write(self, part: Iterator[tuple[str, str]]) -> None:
        for role, text in part:
            self.hash.update((("\n" if self.begun else "") + role + ":").encode())
            self.hash.update(text.encode())
            self.begun = True

    def repair(self, role: str, text: str) -> None:
        self.walk = self.walk or Walk(self.flags)
        self.write(self.walk.take(role, text))

    def row(self) -> tuple:
        self.walk = self.walk or Walk(self.flags)
        self.write(self.walk.end())
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.walk.cost, self.walk.letters.decode(), self.hash.hexdigest()


def repair_rows(rows: DataFrame) -> DataFrame:
    """A row per conversation of rows as damaged() gives them (none needs to be)."""
    small_batches(rows.sparkSession)
    kind = rows.schema["conv"].dataType.simpleString()
    nothing = lambda t: F.lit(None).cast(t)
    first = facts(rows).select("conv", F.when(F.col("lost"), 0).otherwise(1).alias("phase"), F.when(~F.col("lost"), F.col("turn")).alias("turn"), "role", "digest", "again", "blank", "truncated", nothing("string").alias("text"))
    second = rows.where(~F.col("lost")).select("conv", F.lit(2).alias("phase"), "turn", "role", _digest().alias("digest"), *(nothing("boolean").alias(c) for c in ("again", "blank", "truncated")), "text")
    order = [F.col("conv").asc_nulls_first(), "phase", F.col("turn").asc_nulls_first(), "role", "digest", "again"]
    dealt = first.unionByName(second).repartition("conv").sortWithinPartitions(*order).drop("digest")
    schema = f"conv {kind}, gaps long, {FACTS}"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        out: list[tuple] = []
        types = None
        for b in batches:
            types = types or [b.schema.field("conv").type, *[pa.int64()] * 6, pa.string(), pa.string()]
            for conv, phase, turn, role, again, blank, truncated, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        out.append(now.row())
                    now = _Conversation(conv)
                if phase == 1:
                    now.learn(turn, role, blank, again, truncated)
                elif phase == 2:
                    now.repair(role, text)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out = []
        if now is not None:
            out.append(now.row())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return dealt.mapInArrow(run, schema)


def repair(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Damages the rows and repairs them: a row per original conversation."""
    return repair_rows(damaged(conversations, id_col)).withColumnRenamed("conv", id_col)
