"""Training-order materialisation (op 5).

Texts become token ids, each with an end id, cut into sequences of at most ``stride`` ids. The sequences are numbered
0..N-1 without gaps, and a keyed Feistel permutation of the next even power of two, walked along its cycle until it falls
below N, gives every number a slot: a bijection that needs no state, so any reader can compute it or its inverse. A shard
is a range of ``shard_rows`` slots. The slots are range-partitioned by shard, so a task has some neighbouring shards, whole
and in slot order; each record is padded to the fixed stride, so its place in its shard is slot * bytes and reading can go
on from any slot: ``write_shards`` writes a file a shard, ``read_from`` reads on from a slot.

Sequences are written once to the shared folder before they are numbered (a lost executor can't renumber them); only the
number of sequences of each partition is collected. Shards have equal sizes, so nothing is hot.

Null and empty texts are one sequence of the end id. Repeated rows and null ids are texts like others. A long text is
tokenised by windows and holds its ids beside itself. Vocabularies of more than 65,536 symbols are an error, since ids
are 16-bit numbers. Further columns aren't read. Empty: empty."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_codec
from .common import Scratch, mix64, shuffle_partitions, text_slices


def permute(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """The slots of indices below n."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        x = out[walk]
        left, right = x >> np.uint64(half), x & mask
        for r in range(rounds):
            left, right = right, left ^ (mix64(right + np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) & (2**64 - 1))) & mask)
        out[walk] = (left << np.uint64(half)) | right
        walk = walk[out[walk] >= np.uint64(n)]
    return out.astype(np.int64)


def sequences(docs: DataFrame, vocabulary: str, stride: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, start, length, ids): ids are little-endian 16-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_codec(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in text_slices(texts):
                flat, n = codec(texts[a:b])
                owner, start, length, ids, at = [], [], [], [], 0
                for i, m in enumerate(n.tolist()):
                    own = np.append(flat[at : at + m], end_id).astype("<u2")
                    at += m
                    for s in range(0, m + 1, stride):
                        part = own[s : s + stride]
                        owner.append(a + i)
                        start.append(s)
                        length.append(len(part))
                        ids.append(part.tobytes())
                cols = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "start", "length", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, start long, length long, ids binary")


def in_training_order(docs: DataFrame, vocabulary: str, stride: int = 512, shard_rows: int = 4096, key: int = 2024, end_id: int = 50256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Records in slot order, a shard in one partition: slot, shard, byte_offset, id, start, length, ids_crc32, record."""
    spark = docs.sparkSession
    cut = sequences(docs, vocabulary, stride, end_id, id_col, text_col).withColumn("at", F.monotonically_increasing_id())
    cut = Scratch(spark, "order").save(cut, "sequences").withColumn("part", F.shiftright("at", 33))
    parts = sorted(cut.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("lo")).collect())
    starts, total = [], 0
    for p, n, lo in parts:
        starts.append((p, total - lo))
        total += n

    @F.pandas_udf("long")
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(permute(index.to_numpy(), total, key))

    got = cut.join(F.broadcast(spark.createDataFrame(starts, "part long, before long")), "part")
    got = got.withColumn("slot", slot(F.col("at") + F.col("before"))).withColumn("shard", F.expr(f"slot div {shard_rows}"))
    shards = max(1, -(-total // shard_rows))
    tasks = min(shards, max(shuffle_partitions(spark), shards // 16))
    got = got.repartitionById(tasks, F.expr(f"cast(shard * {tasks} div {shards} as int)")).sortWithinPartitions("slot")  # equal ranges, known without a sample
    crc = F.crc32("ids")
    padded = F.concat("ids", F.expr(f"cast(repeat('\\0', int(2 * ({stride} - length))) as binary)"))
    return got.select("slot", "shard", (F.pmod(F.col("slot"), F.lit(shard_rows)) * 2 * stride).alias("byte_offset"), F.col("id").alias(id_col), "start", "length", crc.alias("ids_crc32"), padded.alias("record"))


def write_shards(ordered: DataFrame, folder: str) -> DataFrame:
    """Writes each shard as one file of fixed-stride records into a shared folder (any place pyarrow can write to) and returns (shard, records, bytes).

    A shard is written under a name of its own and then moved to its final name, so a repeated task does no harm and a shard that has its final name is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        place, path = fs.FileSystem.from_uri(folder)
        place.create_dir(path, recursive=True)
        now, out, rows, temp = None, None, 0, ""
        made = []

        def close() -> None:
            size = out.tell()
            out.close()
            place.move(temp, f"{path}/shard-{now:08d}.bin")
            made.append((now, rows, size))

        for b in batches:
            for shard, record in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if shard != now:
                    if out:
                        close()
                    now, rows, temp = shard, 0, f"{path}/.{shard}-{os.urandom(6).hex()}"
                    out = place.open_output_stream(temp)
                out.write(record)
                rows += 1
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], pa.int64()) for i in range(3)], ["shard", "records", "bytes"])

    return ordered.select("shard", "record").mapInArrow(run, "shard long, records long, bytes long")


def read_from(folder: str, slot: int, stride: int = 512, shard_rows: int = 4096) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, ids with padding) one after the other from a slot on, as a reader that goes on where it was stopped: one seek, then whole shards."""
    from pyarrow import fs

    place, path = fs.FileSystem.from_uri(folder)
    shard, at, size = slot // shard_rows, slot % shard_rows, 2 * stride
    while place.get_file_info(name := f"{path}/shard-{shard:08d}.bin").type == fs.FileType.File:
        with place.open_input_file(name) as f:
            f.seek(at * size)
            while record := f.read(size):
                yield shard * shard_rows + at, np.frombuffer(record, "<u2")
                at += 1
        shard, at = shard + 1, 0


def record_crc(record: bytes, length: int) -> int:
    return zlib.crc32(record[: 2 * length])
