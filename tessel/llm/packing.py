"""Packing by power-of-two decomposition (op 8).

A document's ids (its tokens and an end id) are cut into as many pieces of ``width`` as fit and then into pieces whose
lengths are the binary digits of the rest, largest first. Every piece is a sequence of its own: a power of two needs no
padding and no sequence crosses documents. The numbers of the sequences come from the partition and the row's place in it,
so they follow the order of the documents.

Equal lengths are batched together (``bucket`` is the length): the pieces are written once to the shared folder and then
dealt by bucket, in each task by bucket and number. A bucket of any size is spread over as many tasks as its rows and ids
need: no task gets more than about twice the mean of either. Only the buckets' counts are collected, one for each power of two.

Null and empty texts have the end id only. Repeated rows and null ids are packed as further documents. A long text is
tokenised by windows and holds its ids, four bytes each, beside itself. Further columns aren't read. Empty: empty."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import library_codec
from .common import Scratch, shuffle_partitions, text_slices, trimmed


def binary_pieces(n: int, width: int) -> list[tuple[int, int]]:
    """(start, length) of a document of n ids; width is a power of two."""
    out = [(s, width) for s in range(0, n - width + 1, width)]
    at = n - n % width
    bit = width >> 1
    while at < n:
        if n - at >= bit:
            out.append((at, bit))
            at += bit
        bit >>= 1
    return out


def pack(docs: DataFrame, vocabulary: str, width: int = 4096, end_id: int = 2, with_ids: bool = False, remember: int = 700_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket and, if asked for, ids. ``remember``: different
    chunks of text whose ids a worker keeps at once, of about 180 bytes each; fewer cost time only."""
    if width & (width - 1):
        raise ValueError("width must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = library_codec(vocabulary, remember)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in text_slices(texts):
                flat, n = codec(texts[a:b])
                owner, start, length, crc, total, ids = [], [], [], [], [], []
                at = 0
                for i, m in enumerate(n.tolist()):
                    own = np.append(flat[at : at + m], end_id).astype("<u4")
                    at += m
                    for s, size in binary_pieces(m + 1, width):
                        raw = own[s : s + size]
                        owner.append(a + i)
                        start.append(s)
                        length.append(size)
                        crc.append(zlib.crc32(raw))
                        total.append(m + 1)
                        if with_ids:
                            ids.append(raw.view("<i4"))
                cols = [batch.column(0).take(pa.array(owner, pa.int64()))] + [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, ["id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 5 + with_ids])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(trimmed(cut), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)
    more = ["ids"] * with_ids
    out = out.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.col("length").alias("bucket"), *more)
    return by_bucket(Scratch(docs.sparkSession, "packing").save(out, "pieces"))


def by_bucket(pieces: DataFrame) -> DataFrame:
    """The pieces with equal buckets together: a task has a share of one bucket or some whole neighbours, and what is left of others at its ends."""
    n = shuffle_partitions(pieces.sparkSession)
    counts = dict(sorted((r["bucket"], r["count"]) for r in pieces.groupBy("bucket").count().collect()))
    rows, ids = sum(counts.values()), sum(b * k for b, k in counts.items())
    at, begin, room = 0.0, [], []
    for b, k in counts.items():
        weight = (b * k / ids + k / rows) / 2  # rows and ids count alike
        begin += [F.lit(b), F.lit(at)]
        room += [F.lit(b), F.lit(weight)]
        at += weight
    if not counts:
        return pieces
    salt = F.pmod(F.xxhash64("sequence_id"), F.lit(1 << 20)) / float(1 << 20)
    place = F.create_map(*begin)[F.col("bucket")] + salt * F.create_map(*room)[F.col("bucket")]
    return pieces.repartitionById(n, F.least(F.floor(place * n), F.lit(n - 1)).cast("int")).sortWithinPartitions("bucket", "sequence_id")
