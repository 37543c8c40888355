"""Token counts of whole texts by rank-synchronous array merging (op 1).

Batched pre-tokens lie one after another in ragged numpy arrays; each round applies every sequence's lowest-ranked pair
in all sequences at once, and what symbols survive are the tokens. A narrow, map-only job: no shuffle, no skew; a batch
takes memory in proportion to ``CHUNK_BYTES`` (or to one longer text).

Null and empty texts have 0 bytes and 0 tokens. Rows are independent: repeated rows and null ids give a row each.
An empty table gives an empty result. Further columns are not read."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_codec
from .common import small_batches, text_slices


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row, as the vocabulary's library counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_codec(vocabulary, ids=False)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in text_slices(texts):
                part = texts[a:b]
                n = codec(part)[1]
                size = pa.array([len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in part], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), size, pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
