"""Quality classifier: supervised subword embeddings (op 9).

A document is the mean of learned vectors of its words and of its character n-grams, all hashed into one table, with a
softmax over it; plain numpy stochastic gradient descent trains both. It is fit on a bounded sample of labelled rows, in one
task of its own: at most ``per_class`` rows of each label (those of the smallest id hashes), and of these in hash order no
more than ``sample_bytes`` of features (an id with several texts teaches with one). Every row of the table is scored, on executors, by one map-only pass. Scoring needs
a single number per bucket (its vector times the difference of the two output rows): 1 MB is all that comes to the driver
and is broadcast.

Features: words, each word's shape, a mark where a word repeats the one before it, and all 2-, 3- and 4-byte runs. A text of
more than BLOCK bytes is a row of blocks (cut after white space where there is any, the places depend on the text alone);
each byte is in one block, and runs and words don't cross blocks. So a text of any length takes the memory of a block.
Null and empty texts have no features and get the bias alone. Labels other than 0 and 1, ids labelled in two ways and
null ids teach nothing; without labels of both kinds every score is the share of ones (or 1). Rows are independent. An
empty table: no rows. Of further columns none is read but those that ``keep_columns`` returns; a column that has the name
of the score is replaced by it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import release
from .common import SPACE, _powers, mix64, small_batches, text_slices

BITS = 18
#: Bytes of text whose features are held at once (some 200 bytes of memory each), and of a block.
FEATURE_CHUNK = BLOCK = 1 << 18
#: Letters, capitals, digits, bytes above ASCII, others.
CLASS = np.full(256, 5, np.uint64)
CLASS[97:123] = 1
CLASS[65:91] = 2
CLASS[48:58] = 3
CLASS[128:] = 1


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of all texts, text after text, and each text's number of them."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    n = len(buf)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    pw, inv = _powers(n)
    wide = buf.astype(np.uint64)
    gap = SPACE[buf]
    edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=1))
    start, end = edge[0::2], edge[1::2]
    shift = np.uint64(64 - BITS)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((wide + np.uint64(1)) * pw[:n], out=total[1:])
    word = (total[end] - total[start]) * inv[start]
    kind = CLASS[buf]
    turn = np.ones(n, bool)
    turn[1:] = (kind[1:] != kind[:-1]) | gap[1:] | gap[:-1]
    np.cumsum(np.where(turn, kind, 0).astype(np.uint64) * pw[:n], out=total[1:])
    shape = (total[end] - total[start]) * inv[start]
    text_of = np.searchsorted(ends, start, side="right")
    again = np.zeros(len(start), bool)
    again[1:] = (word[1:] == word[:-1]) & (text_of[1:] == text_of[:-1])
    mark = np.where(again, np.uint64(3), np.uint64(4))
    place, bucket = [start, start, start], [mix64(word) >> shift, mix64(shape + np.uint64(99)) >> shift, mix64(mark + np.uint64(7)) >> shift]
    run, own = wide.copy(), np.ones(n, bool)
    own[ends - 1] = False  # runs don't cross texts
    inside = own.copy()
    for k in (1, 2, 3):
        run[: n - k] = run[: n - k] * np.uint64(257) + wide[k:]
        inside[: n - k] &= own[k:]
        inside[n - k :] = False
        at = np.flatnonzero(inside)
        place.append(at)
        bucket.append(mix64(run[at] + np.uint64(k << 40)) >> shift)
    place, bucket = np.concatenate(place), np.concatenate(bucket).astype(np.int32)
    owner = np.searchsorted(ends, place, side="right")
    order = np.argsort(owner.astype(np.int32), kind="stable")
    return bucket[order], np.bincount(owner, minlength=len(texts))


def blocks(text: bytes) -> Iterator[bytes]:
    """A text in blocks of at most BLOCK bytes, cut after the last white space in the second half, if there is any."""
    at = 0
    while len(text) - at > BLOCK:
        tail = np.flatnonzero(SPACE[np.frombuffer(text, np.uint8, BLOCK // 2, at + BLOCK // 2)])
        end = at + (BLOCK // 2 + int(tail[-1]) + 1 if len(tail) else BLOCK)
        yield text[at:end]
        at = end
    yield text[at:]


def shares(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's features and their shares of all its features."""
    if len(text) <= BLOCK:
        at, n = np.unique(features([text])[0], return_counts=True)
    else:
        count = np.zeros(1 << BITS, np.int64)
        for part in blocks(text):
            count += np.bincount(features([part])[0], minlength=1 << BITS)
        at = np.flatnonzero(count)
        n = count[at]
    return at.astype("<i4"), (n / max(n.sum(), 1)).astype("<f4")


@dataclass
class Model:
    weight: np.ndarray  # of each bucket, float32
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        long_ = [i for i, t in enumerate(texts) if len(t) > BLOCK]
        bucket, n = features([b"" if len(t) > BLOCK else t for t in texts])
        total = np.concatenate([[0.0], np.cumsum(self.weight[bucket], dtype=np.float64)])
        edge = np.concatenate([[0], np.cumsum(n)])
        mean = np.diff(total[edge]) / np.maximum(n, 1)
        for i in long_:
            parts = [(float(self.weight[x].sum(dtype=np.float64)), len(x)) for x in (features([p])[0] for p in blocks(texts[i]))]
            mean[i] = sum(s for s, _ in parts) / max(sum(k for _, k in parts), 1)
        return 1 / (1 + np.exp(-np.clip(mean + self.bias, -40, 40)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], dim: int = 8, epochs: int = 6, rate: float = 40.0, seed: int = 1, least_steps: int = 12_000) -> Model:
    """rows: buckets, their shares of the text, label. Two output rows, softmax, one step a text, a rate that falls to 0.

    An epoch takes every row once and rows of the rarer label again until both are as many; few rows get more epochs."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-0.5, 0.5, (1 << BITS, dim)).astype(np.float32) / dim
    out, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    kinds = [np.flatnonzero([y == label for _, _, y in rows]) for label in (0, 1)]
    most = max(map(len, kinds))
    epochs = max(epochs, -(-least_steps // (2 * most)))
    steps, done = epochs * 2 * most, 0
    for _ in range(epochs):
        turn = np.concatenate([np.resize(rng.permutation(k), most) for k in kinds])
        for i in rng.permutation(turn):
            at, share, label = rows[i]
            lr = rate * (1 - done / steps)
            done += 1
            hidden = share @ vectors[at]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ out
            out -= min(lr, 1.0) * np.outer(p, hidden)
            bias -= min(lr, 1.0) * 0.05 * p
            vectors[at] -= lr * np.outer(share, back)
    return Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, sample_bytes: int = 256 << 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fits in one task on at most ``per_class`` rows of either label, which it takes by id hash until ``sample_bytes`` of features are held; only the model comes to the driver."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").withColumn("h", F.xxhash64("id"))
    sample = known.where("y = 0").orderBy("h", "id").limit(per_class).unionByName(known.where("y = 1").orderBy("h", "id").limit(per_class))
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample.select("id", "y", "h")), "id")
    chosen = chosen.groupBy("h", "id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # one text of an id that has several

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in enumerate(b.column(1)):
                if t.is_valid and (raw := t.as_buffer().to_pybytes()):
                    at, share = shares(raw)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(2).slice(i, 1), pa.array([at.tobytes()], pa.binary()), pa.array([share.tobytes()], pa.binary())], ["h", "y", "at", "share"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        rows, held = [], 0
        for b in batches:
            for y, a, s in zip(b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                a, s = a.as_buffer().to_pybytes(), s.as_buffer().to_pybytes()
                held += len(a) + len(s)
                if held <= sample_bytes:
                    rows.append((np.frombuffer(a, "<i4"), np.frombuffer(s, "<f4"), y))
        ones = sum(y for *_, y in rows)
        model = train(rows) if 0 < ones < len(rows) else Model(np.zeros(1 << BITS, np.float32), 40.0 if ones or not rows else -40.0)
        yield pa.RecordBatch.from_arrays([pa.array([model.weight.astype("<f4").tobytes()], pa.binary()), pa.array([model.bias])], ["weight", "bias"])

    got = chosen.select("h", "text", "y").mapInArrow(digest, "h long, y int, at binary, share binary")
    one = got.repartition(1).sortWithinPartitions("h", "y", "at").mapInArrow(learn, "weight binary, bias double").first()
    return Model(np.frombuffer(one.weight, "<f4"), one.bias) if one else Model(np.zeros(1 << BITS, np.float32), 40.0)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False, name: str = "score") -> DataFrame:
    """(id, score), or all columns and the score."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))
    names = [c for c in docs.columns if c != name] if keep_columns else [id_col]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    own = names.index(text_col) if text_col in names else len(names)  # where the text is
    ask = docs.select(*(F.col(f"`{c}`") for c in names), *([] if text_col in names else [F.col(f"`{text_col}`")]))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        m = Model(*held.value)
        for b in batches:
            texts = b.column(own).to_pylist()
            for s, e in text_slices(texts, FEATURE_CHUNK):
                got = m.scores([(t or "").encode("utf-8", "surrogatepass") for t in texts[s:e]])
                part = b.slice(s, e - s)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(got, pa.float64())], [*names, name])

    return ask.mapInArrow(rate, ", ".join(f"`{c}` {kinds[c]}" for c in names) + f", `{name}` double")
