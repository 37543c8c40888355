"""N-gram Jaccard join with parity sketches (op 7).

A document is the set of its distinct k-word shingles. Each shingle's hash toggles one bit of a sketch, so the Hamming
distance of two sketches is at most the symmetric difference of the sets. Sets of a size band whose Jaccard similarity
reaches the threshold differ in at most D shingles; with the sketch in D + 1 + e segments at least e + 1 segments of such a
pair are equal (pigeonhole). Each document therefore joins on its D + 1 segments of most information only (most bits,
then value, an order both sides share): of e + 1 equal segments at most e are left out. A document joins in its own band
and, where partners may be smaller, in the band below. Candidates are verified by exact intersection counts.

Sets that are equal are merged first. Then each bucket's members are compared to its smallest (a star, so a group of m
copies costs m rows) and verified links are joined to components. While many pairs are open in large buckets, what isn't
in their head's component is compared to one of its own members, and so on as long as that halves them; only buckets that
hold several components after that are compared in full, by blocks of bounded size with the Hamming bound, and the members of a bucket's
largest component only to those outside it: a pair within a component could add nothing. So no pair of a group is listed for its own sake, yet no link between components is lost. Before the
sets of two candidates are fetched their sketches are: a pair beyond the Hamming bound needs no more.

Which keys several documents have reaches the documents as a filter of fixed size, so that keys of one document aren't
shuffled again. No bucket passes through one task: its smallest member and size are aggregated (combined before the shuffle) and joined to
its rows, a join whose hot keys Spark splits; so are the rows of one set of copies. The sides of such joins are written
tables, since a side that is aggregated in the same stage can't be split.

Words are runs of what isn't ASCII white space, A-Z lower-cased. With fewer than k words the whole sequence is one shingle.
Null texts, empty texts and texts without words have an empty set and link with nothing, nor do null ids (their
component is null). Rows that share an id are one node, linked by any of its texts; each row is returned. Ids are whole
numbers or text that casts to them. Further columns aren't read by the join. Empty: empty. A text is hashed by windows; a
long one holds some 50 bytes a word at its peak."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILTER_KEYS, Scratch, components, key_filter, mix64, passes, set_hash, shingles, text_slices

#: Ids up to this many are broadcast to filter a scan; beyond it the scan is joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Buckets of up to this many rows list their pairs; larger ones are compared in blocks, and before that in stars (so often at most) while the pairs that
#: are open in them are more than so many times the rows of all buckets and each round halves them.
LISTED, STARS, OPEN_PAIRS = 32, 6, 8
BLOCK_ROWS, BLOCK_BYTES = 2048, 32 << 20
#: Bytes of text whose words are hashed at once (about a hundred bytes each).
HASH_CHUNK = 1 << 19


class Bands:
    """The geometry of the join for shingle sets and a threshold in per cent."""

    def __init__(self, percent: int, growth: float = 1.5):
        self.percent, lo, tops = percent, 1, []
        while lo < 1 << 40:
            tops.append(max(lo, int(lo * growth)))
            lo = tops[-1] + 1
        self.top = np.array(tops, np.int64)

    def of(self, n: int) -> list[int]:
        """The band of sets of n shingles, and the lower ones where a smaller partner may be."""
        own = int(np.searchsorted(self.top, n))
        out, k = [own], own - 1
        while k >= 0 and n * self.percent <= int(self.top[k]) * 100:
            out.append(k)
            k -= 1
        return out

    @lru_cache(4096)  # noqa: B019
    def segments(self, band: int) -> tuple[int, int]:
        """How many segments there are, and how many of them a document joins on."""
        top = int(self.top[band])
        differ = (100 - self.percent) * (top + top * 100 // self.percent) // (100 + self.percent)
        return differ + 1 + (differ + 1) // 4, differ + 1

    def _edges(self, hashes: np.ndarray, band: int) -> np.ndarray:
        """Where the segments begin and end in sorted hashes: a segment is a range of the upper 32 bits."""
        m = self.segments(band)[0]
        low = (np.arange(1, m, dtype=np.uint64) << np.uint64(32)) // np.uint64(m) + np.uint64(1)
        low -= (((low - np.uint64(1)) * np.uint64(m)) >> np.uint64(32)) == np.arange(1, m, dtype=np.uint64)
        return np.concatenate([[0], np.searchsorted(hashes, low << np.uint64(32)), [len(hashes)]])

    def sketch(self, hashes: np.ndarray, band: int) -> np.ndarray:
        """64 bits a segment; each shingle of the sorted set toggles one."""
        edge, out = self._edges(hashes, band), []
        for s in range(0, len(edge) - 1, 4096):
            own = edge[s : s + 4097]
            bit = np.repeat(np.arange(len(own) - 1), np.diff(own)) * 64 + (hashes[own[0] : own[-1]] & np.uint64(63)).astype(np.int64)
            out.append(np.packbits(np.bincount(bit, minlength=64 * (len(own) - 1)).astype(np.uint8) & 1, bitorder="little").view(np.uint64))
        return np.concatenate(out)

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """What the document joins on: of each chosen segment the exclusive or of its shingles' whole hashes, a sketch of 2**64 possible bits in 64. Segments of equal content have equal keys; others by chance only."""
        out, whole = [], mix64(hashes + np.uint64(0x5851F42D4C957F2D))
        for band in self.of(len(hashes)):
            m, take = self.segments(band)
            edge = self._edges(hashes, band)
            some = np.flatnonzero(np.diff(edge))
            name = np.zeros(m, np.uint64)
            name[some] = np.bitwise_xor.reduceat(whole, edge[some])
            name = mix64(name + mix64((np.uint64(band) << np.uint64(40)) + np.arange(m, dtype=np.uint64)))
            if take < m:
                worth = (np.bitwise_count(self.sketch(hashes, band)).astype(np.uint64) << np.uint64(56)) | (name >> np.uint64(8))
                name = name[np.argsort(worth, kind="stable")[m - take :]]
            out.append(name)
        return np.concatenate(out)


def _encoded(texts: list) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def _digest(docs: DataFrame, bands: Bands, k: int) -> DataFrame:
    """(id, n, fp, keys) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for s, e in text_slices(texts, HASH_CHUNK):
                sets = shingles(_encoded(texts[s:e]), k)
                keys = [bands.keys(x).view(np.int64) if len(x) else np.empty(0, np.int64) for x in sets]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
                cols = [b.column(0).slice(s, e - s), pa.array([len(x) for x in sets], pa.int64()), pa.array([set_hash(x) for x in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys)))]
                yield pa.RecordBatch.from_arrays(cols, ["id", "n", "fp", "keys"])

    return docs.mapInArrow(run, "id long, n long, fp binary, keys array<long>")


def _members(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """(key, id, n) of the rows' keys that may be among the heads': a filter of fixed size keeps most others from the shuffle."""
    n = heads.count()
    if n > FILTER_KEYS:
        return rows.select(F.explode("keys").alias("key"), "id", "n")
    held = rows.sparkSession.sparkContext.broadcast(key_filter(heads, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(2)
            flat, owner = keys.flatten().to_numpy(), pc.list_parent_indices(keys).to_numpy()
            some = passes(held.value, flat)
            at = pa.array(owner[some])
            yield pa.RecordBatch.from_arrays([pa.array(flat[some]), b.column(0).take(at), b.column(1).take(at)], ["key", "id", "n"])

    return rows.select("id", "n", "keys").mapInArrow(run, "key long, id long, n long")


def _chosen(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The documents of the wanted ids (a written table): the ids are broadcast if they are few, else joined by a shuffle."""
    return docs.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, "id", "left_semi")


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(id, hashes) of the wanted ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for s, e in text_slices(texts, HASH_CHUNK):
                sets = shingles(_encoded(texts[s:e]), k)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary())], ["id", "hashes"])

    return _chosen(docs, wanted).mapInArrow(run, "id long, hashes binary")


def _sketches(docs: DataFrame, wanted: DataFrame, bands: Bands, k: int) -> DataFrame:
    """(id, n, sketches) of the wanted ids, a sketch for each band the document joins in: an eighth of its set's size or less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for s, e in text_slices(texts, HASH_CHUNK):
                sets = shingles(_encoded(texts[s:e]), k)
                words = [[bands.sketch(x, band).tobytes() for band in bands.of(len(x))] if len(x) else [] for x in sets]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), pa.array([len(x) for x in sets], pa.int64()), pa.array(words, pa.list_(pa.binary()))], ["id", "n", "sketches"])

    return _chosen(docs, wanted).mapInArrow(run, "id long, n long, sketches array<binary>")


def _near(pairs: DataFrame, sketches: DataFrame, bands: Bands) -> DataFrame:
    """The pairs (a, b) that sizes and the Hamming distance of the sketches allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for n, m, x, y in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True):
                if n > m:
                    n, m, x, y = m, n, y, x
                shared, both = bands.of(n)[0] if n else -1, bands.of(m) if m else []
                if shared not in both:
                    keep.append(False)
                    continue
                far = int(np.bitwise_count(np.frombuffer(x[0], np.uint64) ^ np.frombuffer(y[both.index(shared)], np.uint64)).sum())
                keep.append(far * (100 + bands.percent) <= (100 - bands.percent) * (n + m))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    got = pairs.join(sketches.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketches").alias("x")), "a")
    got = got.join(sketches.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketches").alias("y")), "b")
    close = (F.col("na") * 100 >= F.col("nb") * bands.percent) & (F.col("nb") * 100 >= F.col("na") * bands.percent)
    return got.where(close).select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                if len(small) * 100 < percent * len(large):
                    keep.append(False)
                    continue
                at = np.searchsorted(large, small)
                shared = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    got = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a")
    got = got.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b")
    return got.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _block_pairs(pdf: pd.DataFrame, bands: Bands) -> pd.DataFrame:
    """Pairs of different components in two chunks of a bucket (or one) that the Hamming bound allows."""
    pdf = pdf.sort_values(["side", "id"])
    n, ids, comp, side = (pdf[c].to_numpy() for c in ("n", "id", "comp", "side"))
    held = [bands.of(int(x)) for x in n]
    shared = set(held[0]).intersection(*held)
    words = np.stack([np.frombuffer(x[h.index(min(shared))], np.uint64) for x, h in zip(pdf.sketches, held, strict=True)]) if shared else None
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(right) and bool((pdf.ca == pdf.cb).all()):
        right = left
    out = []
    for i in left.tolist():
        some = comp[right] != comp[i]
        if words is not None:  # else two buckets have one key by chance, and the next step decides
            far = np.bitwise_count(words[right] ^ words[i]).sum(axis=1, dtype=np.int64)
            some &= far * (100 + bands.percent) <= (100 - bands.percent) * (n[right] + n[i])
        if right is left:
            some &= right > i
        out += [(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in right[some]]
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _dealt(many: DataFrame, store: Scratch) -> DataFrame:
    """(key, ca, cb, side, id, comp): members of large buckets dealt to blocks, so that each two of different components meet in one.

    A bucket that fits a block is one, and none of its rows is copied. In larger ones the largest component is chunked apart: its members
    meet the others' chunks only, not each other's, so the copies of a row of it grow with what is outside. Chunks are bounded by rows and
    by the bytes of their sketches."""
    parts = many.groupBy("key", "comp").agg(F.count("*").alias("c"), F.max("n").alias("n"))
    parts = parts.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("c"), F.sum("c").alias("all"), F.max("n").alias("most"))
    rows = F.least(F.lit(BLOCK_ROWS), F.greatest(F.lit(64), F.floor(F.lit(BLOCK_BYTES) / (16 * F.col("most")))))
    mains, others = F.ceil(F.col("c") / rows).cast("int"), F.ceil((F.col("all") - F.col("c")) / rows).cast("int")
    one = F.col("all") <= rows
    parts = parts.select("key", "main", F.when(one, 0).otherwise(mains).alias("mains"), F.when(one, 1).otherwise(others).alias("others"))
    many = many.select("key", "id", "comp").join(store.save(parts, "parts"), "key")
    inside, total = (F.col("comp") == F.col("main")) & (F.col("mains") > 0), F.col("mains") + F.col("others")
    chunk = F.when(inside, F.pmod(F.xxhash64("id"), F.col("mains"))).otherwise(F.col("mains") + F.pmod(F.xxhash64("id"), F.col("others"))).cast("int")
    many = many.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.when(inside, F.col("mains")).otherwise(0), total - 1)))
    return many.select("key", F.least("chunk", "other").alias("ca"), F.greatest("chunk", "other").alias("cb"), (F.col("chunk") > F.col("other")).cast("int").alias("side"), "id", "comp")


def link_documents(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row: linked where 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    store, bands = Scratch(spark, "jaccard"), Bands(percent)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = store.save(_digest(docs, bands, k), "rows")
    named = rows.where("n > 0 AND id IS NOT NULL")
    reps = store.save(named.groupBy("fp").agg(F.min("id").alias("id")), "reps")
    first = store.save(named.join(reps, ["id", "fp"], "left_semi").select("id", "n", "keys"), "distinct")
    rows = store.save(rows.select("id", "n", "fp"), "all")
    store.drop("rows")
    exploded = first.select(F.explode("keys").alias("key"), "id", "n")
    heads = store.save(exploded.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("head")).where("m > 1"), "heads")
    shared = store.save(_members(first, heads).join(heads, "key").select("key", "id", "n", "head", "m"), "shared")
    store.drop("distinct", "heads")
    sketches = store.save(_sketches(docs, store.save(shared.select("id").distinct(), "wanted"), bands, k), "sketches")

    rows_shared = shared.count()

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        near = store.save(_near(pairs, sketches, bands), f"near-{name}")
        ids = store.save(near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), f"ids-{name}")
        return store.save(_verified(near, _sets(docs, ids, k), percent), f"links-{name}")

    def placed(members: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """Of bucket members those whose buckets hold several components: key, id, n, m, comp and that of the head, hc."""
        comp = store.save(components(links, store, name), name)
        own = store.save(members.join(comp, members.id == comp.node, "left").select("key", "id", "n", "head", "m", F.coalesce("component", "id").alias("comp")), f"placed-{name}")
        open_ = own.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.when(F.col("id") == F.col("head"), F.col("comp"))).alias("hc")).where("lo != hi")
        rest = store.save(own.join(store.save(open_.select("key", "hc"), f"open-{name}"), "key"), f"rest-{name}")
        store.drop(f"placed-{name}", f"open-{name}")
        return rest

    stars = lambda members: members.where("id != head").select(F.least("head", "id").alias("a"), F.greatest("head", "id").alias("b")).distinct()
    links = verified(stars(shared), "stars1")
    rest = level = placed(shared, links, "comp1")
    before = math.inf
    for turn in range(2, STARS + 1):  # what isn't in the component of its head is compared to a head of its own, any of its members
        others = level.where(f"m > {LISTED} AND comp != hc")
        low = others.groupBy("key").agg(F.min_by("id", F.xxhash64("id", F.lit(turn))).alias("head"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c"))
        low = store.save(low.where("lo != hi").select("key", "head", "c"), f"low{turn}")
        pairs = low.agg(F.sum(F.col("c") * F.col("c"))).first()[0] or 0
        if pairs <= OPEN_PAIRS * rows_shared or pairs > before / 2:
            break
        before, others = pairs, store.save(others.drop("head").join(low, "key").select("key", "id", "n", "head", "m"), f"others{turn}")
        links = links.unionByName(verified(stars(others), f"stars{turn}"))
        level = placed(others, links, f"comp{turn}")
    if before < math.inf:
        rest = placed(shared, links, "comp")
    # the rest: buckets with several components
    few = rest.where(F.col("m") <= LISTED)
    x, y = (few.select("key", *(F.col(c).alias(f"{c}{s}") for c in ("id", "n", "comp"))) for s in ("1", "2"))
    close = (F.col("n1") * 100 >= F.col("n2") * percent) & (F.col("n2") * 100 >= F.col("n1") * percent)
    listed = x.join(y, "key").where((F.col("id1") < F.col("id2")) & (F.col("comp1") != F.col("comp2")) & close).select(F.col("id1").alias("a"), F.col("id2").alias("b"))
    blocks = _dealt(rest.where(F.col("m") > LISTED), store)
    blocks = blocks.join(sketches, "id").groupBy("key", "ca", "cb").applyInPandas(lambda pdf: _block_pairs(pdf, bands), "a long, b long")
    links = links.unionByName(verified(listed.unionByName(blocks).distinct(), "rest"))
    comp = store.save(components(links, store, "last"), "last")
    of_set = store.save(reps.join(comp, reps.id == comp.node, "left").select("fp", F.coalesce("component", "id").alias("component_id")), "sets")
    out = rows.where("n > 0").select("id", "n", "fp").join(of_set, "fp", "left").select("id", "n", F.coalesce("component_id", "id").alias("component_id"))
    out = out.select("id", "n", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
    out = out.unionByName(rows.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    out = store.save(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id"), "groups")
    store.keep_only("groups")
    return out


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one document (that of the smallest id) stays of each group.

    An id is one document: if it stays, all its different texts stay, and of rows that repeat both its id and a text one does.
    Rows without an id stay. All columns are kept as they are, whatever their names. The texts aren't shuffled as long as few ids go."""
    spark = docs.sparkSession
    groups, store = link_documents(docs, k, percent, id_col, text_col), Scratch(spark, "keep")
    ids = groups.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col("component_id").alias("least"))
    counted = ids.groupBy("id").agg(F.min("least").alias("least"), F.count("*").alias("rows"))
    gone, again = store.save(counted.where("least != id").select("id"), "gone"), store.save(counted.where("least = id AND rows > 1").select("id"), "again")

    def side(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids

    same = lambda d, ids: d[id_col].cast("long") == ids["id"]
    stay = docs.join(gone_ := side(gone), same(docs, gone_), "left_anti")
    if not again.limit(1).count():
        return stay
    twice = side(again)
    once = stay.join(twice, same(stay, twice), "left_anti")
    return once.unionByName(stay.join(twice, same(stay, twice), "left_semi").dropDuplicates([id_col, text_col]))
