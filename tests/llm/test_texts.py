"""Token counts against the tokenizers library, the classifier on held-out rows, and the registered queries on the small tables."""

import numbers
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessel.llm import bpe, quality, queries, token_count
from tessel.llm.common import Scratch, components, table

tokenizers = pytest.importorskip("tokenizers")


def texts():
    rnd = random.Random(7)
    bag = ["a", "the", "Σ", "é", "é", "́", " ", "  ", "\n", "\t", "\x1c", "\x85", "　", "<|endoftext|>", "<|startoftext|>", "'s", "'ll", "1", "²", "!!", "*", "aaaa", "\r\n", "İ", "K", "中文", "🙂", "​", "ﬁ", "\x00", "-"]
    return ["".join(rnd.choice(bag) for _ in range(rnd.randrange(30))) for _ in range(1500)] + ["a" * 30000, "ab" * 8000, "", "word " * 4000]


@pytest.mark.parametrize("name,make", [("byte_bpe_50k.json", bpe.byte_codec), ("word_bpe_49k.json", bpe.library_codec)])
def test_codecs_equal_the_library(name, make):
    t, all_texts = tokenizers.Tokenizer.from_file(bpe.place(name)), texts()
    codec = make(name)
    codec.most = 500  # forgets between calls
    for part in (all_texts[:700], all_texts[700:]):
        flat, n = codec(part)
        want = [t.encode(x, add_special_tokens=False).ids for x in part]
        assert n.tolist() == list(map(len, want)) and flat.tolist() == [i for w in want for i in w]


def test_token_counts(spark):
    t = tokenizers.Tokenizer.from_file(bpe.place("byte_bpe_50k.json"))
    rows = [(i, x, "n", 0) for i, x in enumerate(texts()[-60:])] + [(1000, None, "", 0), (None, "no id", "", 0), (0, texts()[-60], "n", 0)]
    got = token_count.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_bytes string, id int"), "byte_bpe_50k.json").collect()
    want = Counter((i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 1024) for i, x, *_ in rows)
    assert Counter(map(tuple, got)) == want
    assert token_count.count_tokens(spark.createDataFrame([], "doc_id long, text string"), "byte_bpe_50k.json").count() == 0


def test_classifier_on_held_out_rows(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # the smallest has a handful of bad rows
    got = queries.op9_quality(spark, sf_dir).toPandas().set_index("doc_id")
    labels = table(spark, sf_dir, "labels").toPandas()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.iterrows())
    held = labels[[got.held_out[i] for i in labels.doc_id]]
    assert len(held) > 5 and (got.predicted[held.doc_id].to_numpy() == held.quality.to_numpy()).mean() >= 0.97
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_classifier_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "some words", "z"), (3, "!!! *** $$$ " * 2000, "q"), (3, "!!! *** $$$ " * 2000, "q")], "doc_id long, text string, score string")
    none = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.score for r in quality.score(docs, none).collect()] == [pytest.approx(1)] * 5
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 0), (None, 1), (4, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    kept = quality.score(docs, model, keep_columns=True, name="__s")
    assert kept.count() == 5 and set(kept.columns) == {"doc_id", "text", "score", "__s"}
    assert quality.score(docs.limit(0), model).count() == 0


def test_features_do_not_cross_texts():
    a, n = quality.features([b"one two two", b"", b"xyz"])
    parts = [quality.features([t])[0] for t in (b"one two two", b"", b"xyz")]
    assert n.tolist() == [len(p) for p in parts] and sorted(a.tolist()) == sorted(np.concatenate(parts).tolist())


@pytest.mark.parametrize("chunk", [0, 5, 1 << 20])  # stars in rounds only, both, one contraction
def test_components_of_long_chains_and_stars(spark, chunk):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 299), (299, 301)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c", chunk=chunk).collect()}
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {i: 299 for i in (299, 300, 301)}
    assert got == want
    assert components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long"), Scratch(spark, "t"), "c", chunk=chunk).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), con.sql(queries.ORACLES[name]).df()
    cols = sorted(want.columns)
    assert set(cols) <= set(got.columns)
    plain = lambda df: sorted(repr([None if pd.isna(x) else float(x) if isinstance(x, numbers.Number) else x for x in r]) for r in df[cols].itertuples(index=False, name=None))
    assert plain(got) == plain(want)
