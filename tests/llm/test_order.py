"""Source mixing, packing and training order: schedules, round trips and edge cases."""

import math
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tessel.llm import bpe, mixing, packing, training_order
from tessel.llm.bpe import place

tokenizers = pytest.importorskip("tokenizers")
SCHEMA = "doc_id long, text string, source string, slot int"
TEXTS = ["", None, "one two  three", "Über alles, and 's more\n<|endoftext|> end", "word " * 9000, "x" * 3000, "a"]


def frame(spark, n=40):
    rows = [(i, TEXTS[i % len(TEXTS)], f"s{i % 3}" if i % 5 else None, i) for i in range(n)] + [(3, TEXTS[3], "s0", 3), (None, "no id", "s1", 0)]
    return spark.createDataFrame(rows, SCHEMA), rows


def plain_schedule(blocks, weights):
    """The rule step by step in fractions: targets grow by the weights of those with something left; at each slot all released blocks are looked through."""
    reached, target = [[Fraction(0)] for _ in blocks], [Fraction(0)] * len(blocks)
    live, now = {i for i, n in enumerate(blocks) if n}, Fraction(0)
    while live:
        total = sum(weights[i] for i in live)
        step = min((blocks[i] - target[i]) * total / weights[i] for i in live)
        for i in live:
            grown = target[i] + step * weights[i] / total
            for k in range(len(reached[i]), int(grown) + 1):
                reached[i].append(now + (k - target[i]) * total / weights[i])
            target[i] = grown
        now += step
        live = {i for i in live if target[i] < blocks[i]}
    done, out = [0] * len(blocks), []
    for t in range(sum(blocks)):
        open_ = [(math.ceil(reached[i][j + 1]), i, j) for i, j in enumerate(done) if j < blocks[i] and math.floor(reached[i][j]) <= t]
        due, i, j = min(open_)
        out.append((i, j, t, math.floor(reached[i][j]), due))
        done[i] += 1
    return out


def test_schedule_equals_the_rule_step_by_step():
    r = np.random.default_rng(6)
    cases = [([1], [1]), ([500, 300, 200], [5, 3, 2]), ([97, 1, 1, 1], [97, 1, 1, 1]), ([10, 3, 0, 70], [1, 5, 2, 1]), ([4, 4], [1, 1])]
    cases += [(r.integers(0, 40, k).tolist(), r.integers(1, 50, k).tolist()) for k in (1, 2, 3, 5, 9, 20) for _ in range(6)]
    for blocks, weights in cases:
        weights = [Fraction(w) for w in weights]
        got = list(mixing.schedule(blocks, mixing.whole_weights([float(w) for w in weights])))
        assert got == plain_schedule(blocks, weights)
        assert all(release <= t < deadline for _, _, t, release, deadline in got)


def test_sources_stay_within_a_block_of_exact_weights_to_the_end():
    for blocks, weights in (([20000] + [2000] * 19, [20000**0.5] + [2000**0.5] * 19), ([9000, 5], [1.0, 1 / 3000]), ([3, 500, 40, 1, 700], [0.3, 2.5, 1 / 3, 7.0, 1e-9])):
        got = list(mixing.whole_schedule(blocks, weights))
        assert [t for _, _, t, *_ in got] == list(range(sum(blocks)))
        assert all(release <= t < deadline for _, _, t, release, deadline in got)
        done, target = np.zeros(len(blocks)), np.zeros(len(blocks))
        for i, j, *_ in got:
            assert done[i] == j
            done[i] += 1
            room = 1.0  # one more slot is shared out by the weights of those that are below their size
            while room > 1e-9:
                w = np.where(target < np.array(blocks) - 1e-7, weights, 0.0)
                if not w.any():
                    break
                step = min(room, min((n - x) * w.sum() / y for n, x, y in zip(blocks, target, w) if y))
                target += step * w / w.sum()
                room -= step
            assert np.abs(done - target).max() < 1 + 1e-4


def test_exact_weights_over_many_rows(spark):
    rows = spark.range(120_000).selectExpr("id AS doc_id", "if(id % 3 = 0, 's0', concat('s', id % 19 + 1)) AS source")
    got = mixing.mix_sources(rows, block_rows=4).select("source", "__block", "__slot", "__release", "__deadline").distinct().toPandas()
    n = rows.groupBy("source").count().toPandas().set_index("source")["count"]
    share = (n**0.5) / (n**0.5).sum()
    assert ((got["__slot"] >= got["__release"]) & (got["__slot"] < got["__deadline"])).all()
    least = got.groupby("source")["__slot"].max().min()
    for s in n.index:
        mine = np.sort(got[got.source == s]["__slot"].to_numpy())
        t = np.arange(1, least + 1)
        assert np.abs(np.searchsorted(mine, t) - share[s] * t).max() < 1 + 1e-6


def test_mixing_places_every_row_within_a_block_of_its_target(spark):
    rows = [(i, "a" if i % 3 == 0 else "b" if i % 2 else None if i % 7 == 0 else "c", i) for i in range(5000)] + [(7, "b", 7)] * 3 + [(None, "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot long")
    weights = {"a": 2.0, "b": 1.0, "c": 1.0, None: 0.5}
    got = mixing.mix_sources(df, weights, block_rows=8).toPandas()
    assert len(got) == len(rows) and got["__position"].is_unique
    assert Counter(got.doc_id.fillna(-1)) == Counter(-1 if r[0] is None else r[0] for r in rows)
    assert ((got["__slot"] >= got["__release"]) & (got["__slot"] < got["__deadline"])).all()
    blocks = got.drop_duplicates(["source", "__block"]).sort_values("__slot")
    assert blocks["__slot"].is_unique
    ends = min(blocks[blocks.source.isna() if s is None else blocks.source == s]["__slot"].max() for s in weights)
    total = sum(weights.values())
    for s, w in weights.items():
        mine = blocks[blocks.source.isna() if s is None else blocks.source == s]["__slot"].to_numpy()
        t = np.arange(1, ends + 1)
        assert np.abs(np.searchsorted(np.sort(mine), t) - w / total * t).max() < 1.01
    again = mixing.mixed_order(df, weights, block_rows=8)
    order = got.sort_values("__position")
    assert again.columns == df.columns and [r.doc_id for r in again.collect()] == [None if np.isnan(x) else x for x in order.doc_id]


def test_more_sources_than_are_broadcast(spark):
    rows = [(i, f"s{i % 40}" if i % 2 else "big") for i in range(800)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string"), block_rows=4, broadcast_sources=5)
    assert got.count() == 800 and got.select("__position").distinct().count() == 800


def test_every_source_is_scheduled_by_itself(spark, monkeypatch):
    rows = [(i, f"s{i % 299}" if i % 2 else None if i % 4 else "big") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    weights = {f"s{k}": 1.0 + k % 3 for k in range(299)} | {"big": 20.0, None: 10.0}
    for given in (None, weights):
        got = mixing.mix_sources(df, given, block_rows=2).toPandas()
        assert ((got["__slot"] >= got["__release"]) & (got["__slot"] < got["__deadline"])).all()
        assert got.fillna({"source": "-"}).groupby("__slot").source.nunique().max() == 1
        size = Counter(r[1] for r in rows)
        w = {s: given[s] if given else n**0.5 for s, n in size.items()}
        least = min(-(-size[s] // 2) / w[s] for s in w) * sum(w.values())  # before any source's target is used up
        for s in w:
            mine = got[(got.source.isna() if s is None else got.source == s) & (got["__slot"] < least - 1)]["__slot"].drop_duplicates().sort_values().to_numpy()
            t = np.arange(1, int(least))
            assert np.abs(np.searchsorted(mine, t) - w[s] / sum(w.values()) * t).max() < 1 + 1e-6
    monkeypatch.setattr(mixing, "BROADCAST_BLOCKS", 10)
    by_shuffle = mixing.mix_sources(df, weights, block_rows=2, broadcast_sources=1).toPandas()
    assert sorted(zip(by_shuffle.doc_id, by_shuffle["__position"])) == sorted(zip(got.doc_id, got["__position"]))


def test_packing_is_an_exact_round_trip(spark):
    df, rows = frame(spark)
    t = tokenizers.Tokenizer.from_file(place("word_bpe_49k.json"))
    want = Counter((r[0], tuple(t.encode(r[1] or "", add_special_tokens=False).ids + [2])) for r in rows)
    got = packing.pack(df.withColumn("row", F.monotonically_increasing_id()), "word_bpe_49k.json", with_ids=True).toPandas()
    assert got.sequence_id.is_unique and (got.offset == 0).all()
    assert all(n & (n - 1) == 0 and n <= 4096 for n in got.length)
    back, now = Counter(), []
    for r in got.sort_values("sequence_id").itertuples():
        assert r.start == len(now) and r.length == len(r.ids) and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        now += list(r.ids)
        if len(now) == r.doc_tokens:
            back[(None if r.doc_id != r.doc_id else int(r.doc_id), tuple(now))] += 1
            now = []
    assert back == want


def test_pieces_of_a_bucket_are_together(spark):
    df = spark.createDataFrame([(i, "word " * (i * 37 % 3000)) for i in range(1500)], "doc_id long, text string").repartition(6)
    packed = packing.pack(df, "word_bpe_49k.json", with_ids=True)
    got = packed.withColumn("task", F.spark_partition_id()).select("task", "bucket", "length", "sequence_id").toPandas()
    assert (got.bucket == got.length).all()
    for _, mine in got.groupby("task", sort=False):
        assert list(zip(mine.bucket, mine.sequence_id)) == sorted(zip(mine.bucket, mine.sequence_id))
    spans = got.groupby("task").bucket.agg(["min", "max"]).sort_index()
    assert len(spans) == 4 and (spans["min"].to_numpy()[1:] >= spans["max"].to_numpy()[:-1]).all()
    each = got.groupby("task").agg(rows=("length", "size"), ids=("length", "sum"))
    assert (each <= 2.3 * each.sum() / 4).all().all()


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 17, 1000, 4097):
        for key in (0, 5):
            assert sorted(training_order.permute(np.arange(n), n, key)) == list(range(n))
    assert (training_order.permute(np.arange(1000), 1000, 1) != training_order.permute(np.arange(1000), 1000, 2)).any()


def test_training_order_round_trip_and_shards(spark, tmp_path):
    df, rows = frame(spark)
    ordered = training_order.in_training_order(df, "byte_bpe_50k.json", stride=64, shard_rows=16)
    got = ordered.toPandas().sort_values("slot")
    assert got.slot.tolist() == list(range(len(got)))
    t = tokenizers.Tokenizer.from_file(place("byte_bpe_50k.json"))
    parts = {}
    for r in got.itertuples():
        assert len(r.record) == 128 and zlib.crc32(bytes(r.record)[: 2 * r.length]) == r.ids_crc32
        parts.setdefault(None if r.doc_id != r.doc_id else int(r.doc_id), set()).add((r.start, bytes(r.record)[: 2 * r.length]))
    for i, text, *_ in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [50256], "<u2")
        assert {(s, ids[s : s + 64].tobytes()) for s in range(0, len(ids), 64)} == parts[i]
    made = training_order.write_shards(ordered, f"file://{tmp_path}/shards").toPandas()
    assert made.records.sum() == len(got)
    read = b"".join((tmp_path / "shards" / f"shard-{s:08d}.bin").read_bytes() for s in sorted(made.shard))
    assert read == b"".join(bytes(x) for x in got.record)


def test_shards_are_dealt_without_a_sample_of_the_rows(spark):
    df, _ = frame(spark, 200)
    ordered = training_order.in_training_order(df, "byte_bpe_50k.json", stride=16, shard_rows=4)
    assert "rangepartitioning" not in ordered._jdf.queryExecution().toString().lower()
    got = ordered.withColumn("task", F.spark_partition_id()).select("task", "shard", "slot").toPandas()
    tasks = got.groupby("shard").task.agg(["min", "max"])
    assert (tasks["min"] == tasks["max"]).all() and tasks["min"].is_monotonic_increasing
    rows = got.groupby("task").size()
    assert len(rows) > 4 and rows.max() - rows.min() <= 8
    assert all(mine.slot.is_monotonic_increasing for _, mine in got.groupby("task"))


def test_ascii_is_split_by_arrays_as_the_library_splits_it(monkeypatch):
    seen, plain_compile = [], regex.compile

    class Counted:
        def __init__(self, pattern):
            self.own = plain_compile(pattern)

        def findall(self, text):
            seen.append(text)
            return self.own.findall(text)

        def __getattr__(self, name):
            return getattr(self.own, name)

    rnd = np.random.default_rng(4)
    parts = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", "''", "'S", "don't", "a", "Zq", "7", "42", ".", "--", "\x1c", "\x00", "_", " ", " ", "  ", "\n", "\t", "<", "|>", "x's's", "'sam", "'lx", "é's"]
    texts = ["".join(rnd.choice(parts, rnd.integers(1, 40))) for _ in range(4000)] + ["it's " * 3, "a" * 5000, "'", " '", "' s", "<|endoftext|>'s"]
    monkeypatch.setattr(bpe, "MERGE_BYTES", 3000)
    monkeypatch.setattr(bpe.regex, "compile", Counted)
    flat, n = bpe.byte_codec.__wrapped__("byte_bpe_50k.json")(texts)
    monkeypatch.undo()
    t = tokenizers.Tokenizer.from_file(place("byte_bpe_50k.json"))
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert n.tolist() == list(map(len, want)) and flat.tolist() == [x for w in want for x in w]
    assert all("é" in c or c.isspace() or "<|" in c or len(c) > 4000 for c in seen)


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert packing.pack(df, "word_bpe_49k.json").count() == 0
    assert training_order.in_training_order(df, "byte_bpe_50k.json").count() == 0
    assert mixing.mix_sources(df).count() == 0
