"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

quality   documents that the classifier scores below 0.3 go (fit on the labels beside the documents)
dedup     of each group of near copies (five-word shingles, similarity 0.8 or more) the smallest id stays
repeats   bytes covered by 50-byte strings that also start in a smaller document go
mixing    documents are put in an order in which the sources follow their target weights
packing   documents become token sequences of power-of-two lengths, numbered in the order of the mixing

The first four return the columns of ``documents``. Each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import jaccard, mixing, packing, quality, substrings
from tessel.llm.common import Scratch, table

#: Documents below this score go.
LEAST_SCORE = 0.3


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    name = "score" + "_" * max(map(len, docs.columns))  # no column's name
    return quality.score(docs, model, keep_columns=True, name=name).where(F.col(name) >= LEAST_SCORE).drop(name)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, k=5, percent=80)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.cut_repeats(docs, 50)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_order(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(mixing.in_written_order(docs), "word_bpe_49k.json", with_ids=True, remember=350_000)


STAGES = [("quality", good_documents), ("dedup", one_of_each_group), ("repeats", without_repeats), ("mixing", mixed_sources), ("packing", packed)]

#: A learned model, shingle sets and a tokenizer can't be written in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, store = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = store.save(stage(spark, docs, sf_dir), name)
        store.keep_only(name)
    return STAGES[-1][1](spark, docs, sf_dir)
