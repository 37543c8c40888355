"""The pipeline's stages on the small tables, each against a plain form of its rule."""

import zlib

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from tests.llm.test_jaccard import plain as plain_groups
from tests.llm.test_substrings import plain as plain_cuts

from tessel.llm import mixing
from tessel.llm.common import Scratch, table


def test_stages_in_turn(spark, sf_dir):
    docs, store = table(spark, sf_dir, "documents"), Scratch(spark, "stages")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "dedup", "repeats", "mixing", "packing"]
    was = docs.toPandas()
    for name, stage in corpus_pipeline.STAGES:
        docs = store.save(stage(spark, docs, sf_dir), name)
        now = docs.toPandas()
        if name != "packing":
            assert list(now.columns) == list(was.columns)
        if name == "quality":
            labels = table(spark, sf_dir, "labels").toPandas().set_index("doc_id").quality
            stays = set(now.doc_id)
            wrong = [i for i in was.doc_id if i in labels.index and (i in stays) != (labels[i] == 1)]
            assert len(wrong) <= 2 and 0 < len(now) < len(was)
        elif name == "dedup":
            groups = plain_groups(list(zip(was.doc_id.tolist(), was.text)), 5, 80)
            assert sorted(now.doc_id) == sorted(i for i, _, c in groups if i == c)
        elif name == "repeats":
            import hashlib

            want = {r[0]: r for r in plain_cuts(list(zip(was.doc_id.tolist(), was.text)), 50)}
            assert set(want) == set(now.doc_id)
            for i, text in zip(now.doc_id, now.text):
                # a cut inside a character takes what is left of it as well
                assert hashlib.sha256(text.encode()).hexdigest() == want[i][4] or 0 <= want[i][1] - want[i][2] - len(text.encode()) <= 6 * want[i][3]
        elif name == "mixing":
            assert sorted(now.doc_id) == sorted(was.doc_id) and now.doc_id.tolist() != was.doc_id.tolist()
            assert dict(zip(now.doc_id, now.text)) == dict(zip(was.doc_id, was.text))
        else:
            assert set(now.doc_id) == set(was.doc_id) and now.groupby("doc_id").length.sum().eq(now.groupby("doc_id").doc_tokens.first()).all()
        was = now


def test_run_gives_the_packed_pieces(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.agg(F.sum("length")).first()[0] > 0 and corpus_pipeline.ORACLE_SQL is None


def mixed_run(spark, folder, monkeypatch):
    """The last two stages over documents whose texts grow with their place in the mix, so that Spark reads later files first; and the mix."""
    small = spark.createDataFrame([(i, "abc"[min(i % 7, 2)]) for i in range(3000)], "doc_id long, source string")
    order = mixing.mix_sources(small).orderBy("__position").toPandas()
    place = {i: k for k, i in enumerate(order.doc_id)}
    rows = [(r.doc_id, r.source, " ".join(str(r.doc_id * j % 9973) for j in range(1 + place[r.doc_id] // 20))) for r in small.collect()]
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[-2:])
    return corpus_pipeline.run(spark, str(folder)), order


def test_sequences_of_a_run_follow_the_mix(spark, tmp_path, monkeypatch):
    got, order = mixed_run(spark, tmp_path, monkeypatch)
    got = got.select("doc_id", "start", "sequence_id").toPandas().sort_values("sequence_id")
    assert got.sequence_id.is_unique
    assert got[got.start == 0].doc_id.tolist() == order.doc_id.tolist()
    source = order.set_index("doc_id").source
    mixed = source[got[got.start == 0].doc_id].tolist()
    weight = {s: n**0.5 for s, n in source.value_counts().items()}
    least = min(max(k for k, s in enumerate(mixed) if s == x) for x in weight)
    for x, w in weight.items():
        done = 0
        for k in range(least):
            if k % 64 == 0:
                assert abs(done - w / sum(weight.values()) * k) < 64
            done += mixed[k] == x


def test_a_run_gives_the_ids_of_its_sequences(spark, tmp_path, monkeypatch):
    got = mixed_run(spark, tmp_path, monkeypatch)[0].limit(200).toPandas()
    assert len(got) and all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got.itertuples())
