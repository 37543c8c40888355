"""What the corpus operators share: the shared scratch folder, text batches, word hashes, connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once; longer texts are handled alone, whole.
CHUNK_BYTES = 2 << 20
#: Bytes of an Arrow batch.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written once to the folder all executors share, so that later reads need no lineage.

    The folder is the session's ``spark.checkpoint.dir`` or the context's checkpoint folder. Only on one machine (a local
    master) a folder below the warehouse stands in; elsewhere their lack is an error. What a returned plan still reads is
    deleted when the application ends."""

    _open: set[Scratch] = set()

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir isn't set: the operators need a folder that all executors share")
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        if not Scratch._open:
            atexit.register(Scratch._end)
        Scratch._open.add(self)

    @staticmethod
    def _end() -> None:
        for s in Scratch._open:
            if not s.spark.sparkContext._jsc or s.spark.sparkContext._jsc.sc().isStopped():
                continue
            s._delete(s.root)

    def _folder(self, path: str) -> tuple:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _delete(self, path: str) -> None:
        folder, fs = self._folder(path)
        fs.delete(folder, True)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with no_shuffle_left(self.spark):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def keep_only(self, *names: str) -> None:
        """Deletes the tables of this scratch that nothing needs any more."""
        folder, fs = self._folder(self.root)
        for status in fs.listStatus(folder):
            if status.getPath().getName() not in names:
                fs.delete(status.getPath(), True)


@contextlib.contextmanager
def no_shuffle_left(spark: SparkSession) -> Iterator[None]:
    """What is written in here leaves no shuffle files behind: else they stay until the driver's memory is cleaned up."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def small_batches(spark: SparkSession) -> None:
    """Rows of any size reach Python by at most BATCH_BYTES at once, or one longer row (for the session, since plans run later)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` as a task that gives what it has freed back to the machine when it ends: workers live on, idle or with other tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return task


# --- filters of keys ---------------------------------------------------------------------------------------------

#: Bits of a filter of 64-bit keys (as a power of two, and at most for how many keys), and up to how many keys it is used.
FILTER_BITS, MOST_BITS, FILTER_KEYS = 27, 29, 1 << 26


def filter_bits(keys: int) -> int:
    """The bits of a filter that one of 16 other keys passes by chance at most, as far as MOST_BITS go (64 MB; with FILTER_KEYS one of eight)."""
    return min(MOST_BITS, max(FILTER_BITS, (16 * keys - 1).bit_length()))


def key_filter(keys: DataFrame, n: int = 0) -> np.ndarray:
    """The lowest bits of the keys as a bitmap for ``n`` keys, built on the executors; its bytes come to the driver whatever the table."""
    bits = filter_bits(n)
    bit = F.col("key").bitwiseAND((1 << bits) - 1) + 1  # those functions count from 1
    got = keys.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).toArrow()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for k, held in zip(got["bucket"].to_pylist(), got["bits"], strict=True):
        part = np.frombuffer(held.as_buffer(), np.uint8)
        out[(k - 1) * 4096 : (k - 1) * 4096 + len(part)] = part
    return out


def passes(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which of the keys the filter holds: all that were put in, others by chance."""
    bit = key & (8 * len(bits) - 1)
    return (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(texts: list, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` characters together, one row at least."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


# --- word hashes -------------------------------------------------------------------------------------------------

_MULT = 0x9E3779B97F4A7C15 | 1
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier modulo 2**64, and of its inverse, for rolling sums that are checked by bytes or name a bucket; those of a window or so are kept."""
    global _POW, _INV
    if len(_POW) >= n:
        return _POW, _INV
    size = 1 << (n - 1).bit_length()
    p, q = np.full(size, _MULT, np.uint64), np.full(size, pow(_MULT, -1, 1 << 64), np.uint64)
    p[0] = q[0] = 1
    p, q = np.cumprod(p, out=p), np.cumprod(q, out=q)
    if size <= 4 * CHUNK_BYTES:
        _POW, _INV = p, q
    return p, q


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every bit of the result hangs on every bit of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


#: Added to a byte and its place before they are mixed.
_BYTE = np.uint64(0x9E3779B97F4A7C15)


def _raw_hashes(buf: np.ndarray, separator: np.ndarray, ahead: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and sum of each word of lower-cased bytes: every byte is mixed with its place in the word before they are summed, so that no pattern
    of places cancels out as in a polynomial. ``ahead``: bytes that a word at the very beginning has had before."""
    gap = separator[buf]
    edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=1, append=1))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return start, end, np.empty(0, np.uint64)
    size = end - start
    first = np.cumsum(size) - size  # of each word among the bytes of all words
    place = np.arange(int(size.sum()), dtype=np.int64)
    place -= np.repeat(first, size)
    if ahead and start[0] == 0:
        place[: size[0]] += ahead
    code = place.view(np.uint64)
    code <<= np.uint64(8)
    code += buf[~gap]
    code += _BYTE
    return start, end, np.add.reduceat(mix64(code), first)


def word_hashes(texts: list[bytes], separator: np.ndarray = SPACE, window: int = CHUNK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, A-Z lower-cased, in order, and each text's number of words.

    Words are maximal runs of bytes that ``separator`` (a mask of 256) doesn't mark. One pass of array operations; a text of
    more than ``window`` bytes is taken by windows, and a word that crosses them is put together from its parts."""
    if any(len(t) > window for t in texts):
        each = [_long_hashes(t, separator, window) for t in texts]
        return mix64(np.concatenate(each)), np.array(list(map(len, each)), np.int64)
    sep = bytes([int(np.flatnonzero(separator)[0])])
    buf = LOWER[np.frombuffer(sep.join(texts) + sep, np.uint8)]
    start, _, h = _raw_hashes(buf, separator)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return mix64(h), np.diff(np.searchsorted(start, ends), prepend=0)


def _long_hashes(text: bytes, separator: np.ndarray, window: int) -> np.ndarray:
    """The sums of the words of one text."""
    out: list[np.ndarray] = []
    open_, length = np.zeros(1, np.uint64), 0  # sum and length of the word that reaches the end of the window before
    for at in range(0, len(text), window):
        buf = LOWER[np.frombuffer(text, np.uint8, min(window, len(text) - at), at)]
        start, end, h = _raw_hashes(buf, separator, length)
        if length:
            if len(start) and start[0] == 0:
                h[:1] += open_
            else:
                out.append(open_)
                length = 0
        if len(end) and end[-1] == len(buf):
            whole = len(end) == 1 and start[0] == 0
            open_, length = h[-1:], (length if whole else 0) + int(end[-1] - start[-1])
            h = h[:-1]
        else:
            length = 0
        out.append(h)
    if length:
        out.append(open_)
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingles(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its k-word shingles; with fewer words the whole sequence is one; without words none."""
    h, n = word_hashes(texts)
    grams = np.zeros(len(h), np.uint64)
    for j in range(k):
        part = h[j:] if j else h
        for s in range(0, len(part), CHUNK_BYTES):
            grams[s : s + CHUNK_BYTES][: len(part) - s] += mix64(part[s : s + CHUNK_BYTES] + np.uint64((0x632BE59BD9B4E019 * (j + 1)) & (2**64 - 1)))
    out, at = [], 0
    for m in n.tolist():
        if m >= k:
            out.append(np.unique(grams[at : at + m - k + 1]))
        elif m:
            parts = np.arange(m, dtype=np.uint64) + np.uint64(77 + m)
            out.append(mix64(h[at : at + m] + mix64(parts)).sum(keepdims=True, dtype=np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
        at += m
    return out


def set_hash(values: np.ndarray) -> bytes:
    """16 bytes that name a set of 64-bit hashes."""
    a = mix64(values + np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)
    b = np.bitwise_xor.reduce(mix64(values * np.uint64(0xD6E8FEB86659FD93) + np.uint64(11))) if len(values) else np.uint64(0)
    return np.array([a, b ^ np.uint64(len(values))], np.uint64).tobytes()


def binary_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


# --- connected components ----------------------------------------------------------------------------------------


#: Edges that a task contracts at once.
CONTRACT_ROWS = 1 << 20


def star_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, node) for each node that isn't the smallest of its component of these edges."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y, label = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        a, b = label[x], label[y]
        if (a == b).all():
            break
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[moved]], nodes[moved]


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the components of ``edges``: of each million or so in a task only the stars of its components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            u, v = star_forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for b in batches:
            if b.num_rows:
                held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            if sum(len(u) for u, _ in held) > CONTRACT_ROWS:
                yield close()
        if held:
            yield close()

    return edges.mapInArrow(run, "u long, v long")


def _settled(edges: DataFrame) -> DataFrame:
    """(node, component) of edges that one task may contract at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            root, node = star_forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
            own = np.unique(root)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node, own])), pa.array(np.concatenate([root, own]))], ["node", "component"])

    return edges.coalesce(1).mapInArrow(run, "node long, component long")


def components(edges: DataFrame, scratch: Scratch, name: str, a: str = "a", b: str = "b", chunk: int = CONTRACT_ROWS) -> DataFrame:
    """(node, component): for every node of the edges the smallest node reachable. Large-star and small-star in turn, and in every round
    each task contracts its edges to stars, so that only the centres of stars have many. As soon as no more edges are left than a task contracts
    at once anyway (``chunk``), a last contraction settles them.

    Every round is written to the shared folder; nothing but one row at most comes to the driver. Sides are joined as written tables, so that
    a centre's edges can be split. Edges with null ends and loops say nothing."""
    e = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v")
    e = scratch.save(_contracted(e), f"{name}0")
    for turn in range(1, 200):
        if e.count() <= chunk:
            return _settled(e)
        ends = e.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.distinct().select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if not ends.groupBy("n").agg(F.max("up").alias("up"), F.sum("down").alias("down")).where("down > 1 OR up + down > 1").limit(1).count():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.save(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), f"{name}low{turn}")
        # large star: each neighbour above u goes to the smallest around u
        large = e.join(low, "u").select("v", "m").where("m < v").union(e.join(low.withColumnRenamed("u", "w"), F.col("v") == F.col("w")).select("v", "m").where("m < v"))
        large = large.select(F.col("m").alias("u"), "v").distinct()
        # small star: each node and its smaller neighbours go to the smallest of them
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        new = large.join(down, "v").select(F.col("m").alias("u"), F.col("u").alias("v")).where("u < v").union(down.select(F.col("m").alias("u"), "v"))
        new = scratch.save(_contracted(new), f"{name}{turn}")
        scratch.drop(f"{name}{turn - 1}", f"{name}low{turn}")
        e = new
    else:
        raise RuntimeError("components did not settle")
    e = e.distinct()
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def salted(col: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")
