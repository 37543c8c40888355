"""Long texts by windows, and every stage over rows of all kinds: the same results as in one piece, and nothing lost."""

import random

import corpus_pipeline
import numpy as np
import pytest
import tokenizers

from tessel.llm import bpe, common, quality, training_order

RND = random.Random(5)
TEXT = "".join(RND.choice(["'s", "'", "st", "re", "'RE", "'ll ", "12", "!", " ", "\n", "AB", "é", "<|endoftext|>", "zz" * 40]) for _ in range(6000))


@pytest.mark.parametrize("name,make", [("byte_bpe_50k.json", bpe.byte_codec), ("word_bpe_49k.json", bpe.library_codec)])
def test_a_text_by_windows_has_the_librarys_ids(monkeypatch, name, make):
    monkeypatch.setattr(bpe, "LONG_TEXT", 1000)
    monkeypatch.setattr(bpe, "WINDOW", 37)
    monkeypatch.setattr(bpe, "MERGE_BYTES", 64)
    codec, t = make(name), tokenizers.Tokenizer.from_file(bpe.place(name))
    flat, n = codec(["a b", TEXT, None, ""])
    want = [t.encode(x, add_special_tokens=False).ids for x in ("a b", TEXT)]
    assert flat.tolist() == want[0] + want[1] and n.tolist() == [len(want[0]), len(want[1]), 0, 0]
    piece = "x" * 20000 + "qzQ" * 3000
    assert codec([piece])[0].tolist() == t.encode(piece, add_special_tokens=False).ids


def test_word_hashes_dont_depend_on_windows():
    raw = TEXT.encode()
    whole = common.word_hashes([raw, b"", b"a B"])
    for window in (1, 3, 100, 4096):
        part = common.word_hashes([raw, b"", b"a B"], window=window)
        assert (whole[0] == part[0]).all() and (whole[1] == part[1]).all()


def test_a_forest_has_the_least_of_each_component():
    for _ in range(50):
        e = np.array([(RND.randrange(20), RND.randrange(20)) for _ in range(RND.randrange(1, 25))])
        low = {i: i for i in range(20)}
        for _ in range(20):
            for a, b in e.tolist():
                low[a] = low[b] = min(low[a], low[b])
        root, node = common.star_forest(e[:, 0], e[:, 1])
        got = dict(zip(node.tolist(), root.tolist()))
        assert all(got.get(i, i) == low[i] for i in e.ravel().tolist())


def test_blocks_hold_every_byte(monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 64)
    raw = TEXT.encode()
    assert b"".join(quality.blocks(raw)) == raw and max(map(len, quality.blocks(raw))) <= 64
    model = quality.Model(np.random.default_rng(1).normal(size=1 << quality.BITS).astype(np.float32), 0.1)
    at, share = quality.shares(raw)
    mean = float((model.weight[at].astype(float) * share).sum())
    assert abs(model.scores([b"a", raw])[1] - 1 / (1 + np.exp(-mean - 0.1))) < 1e-6


def test_reading_goes_on_from_any_slot(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i} " * (i % 90)) for i in range(60)], "doc_id long, text string")
    ordered = training_order.in_training_order(df, "byte_bpe_50k.json", stride=32, shard_rows=16)
    records = [bytes(r.record) for r in ordered.orderBy("slot").collect()]
    training_order.write_shards(ordered, f"file://{tmp_path}/s").collect()
    for slot in (0, 15, 16, 40, len(records) - 1):
        assert [x.tobytes() for _, x in training_order.read_from(f"file://{tmp_path}/s", slot, 32, 16)] == records[slot:]


SCHEMA = "__part long, doc_id long, text string, lang string, source string, n_chars long, spans string, score double, __slot int, id long"


@pytest.mark.parametrize("rows", [0, 1])
def test_stages_keep_rows_and_columns_of_all_kinds(spark, tmp_path, rows):
    words = [f"w{i}" for i in range(200)]
    data = [(i, i, " ".join(RND.choices(words, k=40)), "en", "abc"[i % 3], 1, "s", 0.5, i, -i) for i in range(12)] * rows
    if rows:
        data += [data[3], (1, 4, "another text of the same id " * 3, "en", None, 1, "s", 0.5, 1, 2), (None, 50, None, None, None, None, None, None, None, None), (0, 51, "", "", "", 0, "", 0.0, 0, 0), (0, None, data[5][2] + " tail", "en", "a", 0, "", 0.0, 0, 0)]
    spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(data, SCHEMA)
    store = common.Scratch(spark, "kinds")
    docs = store.save(docs, "documents")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        after = store.save(stage(spark, docs, str(tmp_path)), name)
        assert after.columns == docs.columns
        was, now = docs.count(), after.count()
        assert now == (was - 1 if name == "dedup" and rows else was)
        docs = after
    assert corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).columns == docs.columns
    packed = corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path))
    assert packed.where("start = 0").count() == docs.count()


def test_the_quality_stage_keeps_what_the_model_accepts(spark, tmp_path):
    """Rows of all kinds: which of them stay is what the fitted model says of each text by itself."""
    from tessel.llm import quality

    good, bad = ["the cat sat on the mat", "a quiet street in the rain"], ["BUY NOW 1!!! $$$", "xx xx xx xx 99 99"]
    texts = [RND.choice(good if i % 2 else bad) + f" {i} " + RND.choice(good if i % 2 else bad) for i in range(40)]
    data = [(i, i, t, "en", "s", 1, "x", 0.5, 0, 0) for i, t in enumerate(texts)]
    data += [(0, None, texts[1], "en", "s", 1, "x", None, 0, 0), (0, 90, None, None, None, None, None, None, None, None), (0, 91, "", "", "", 0, "", 0.1, 0, 0), data[3], (0, 5, bad[0], "en", "s", 1, "x", 0.9, 0, 0)]
    spark.createDataFrame([(i, i % 2) for i in range(30)] + [(3, 1), (None, 0), (2000, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(data, SCHEMA)
    model = quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    want = sorted(str(r) for r, s in zip(data, model.scores([(r[2] or "").encode() for r in data]), strict=True) if s >= corpus_pipeline.LEAST_SCORE)
    got = sorted(str(tuple(r)) for r in corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).collect())
    assert got == want and 15 < len(got) < len(data) - 10
