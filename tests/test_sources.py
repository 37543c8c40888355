"""Readers, stored results, the stream and the calls of the façade."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.api import Busy, MissingModel, Workspace
from tessel.functions import text
from tessel.operators import groups, ordering, positions, renames
from tessel.operators.naming import distinct_terms
from tessel.plans import fixtures as X
from tessel.sources import color, files
from tessel.sources.stored import Store, fingerprint
from tessel.streaming import ingest


def test_content_hashes_cover_the_beginning_and_the_length(spark, tmp_path):
    for name, raw in (("a.jpg", b"x" * 20000), ("b.jpg", b"x" * 20001), ("c.PNG", b"x" * 20000), ("d.txt", b"x"), (".e.jpg", b"x")):
        (tmp_path / name).write_bytes(raw)
    got = {r.filename: r.hash for r in files.content_hashes(files.contents(spark, str(tmp_path))).collect()}
    assert set(got) == {"a.jpg", "b.jpg", "c.PNG"} and got["a.jpg"] == got["c.PNG"] != got["b.jpg"] and len(got["a.jpg"]) == 32


def test_groups_of_either_form_and_of_none(spark, tmp_path):
    g = [{"id": "1", "name": "n", "images": ["a", "b"]}, {"id": "2", "name": "m", "images": []}]
    for i, raw in enumerate((json.dumps(g), json.dumps({"groups": g}), "not json", '{"x": 1}')):
        (tmp_path / f"{i}.json").write_text(raw)
        got = files.read_groups(spark, str(tmp_path / f"{i}.json"))
        assert got.count() == (2 if i < 2 else 0)
    with pytest.raises(Exception):
        files.read_groups(spark, str(tmp_path / "2.json"), strict=True).collect()
    back = [json.loads(r.json) for r in files.groups_json(files.read_groups(spark, str(tmp_path / "0.json"))).collect()]
    assert back == g[:1]


def test_vocabulary(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"terms": ["a", "b"], "embeddings": [[1, 0], [0, 1]]}))
    assert [(r.term_pos, r.term, r.vec) for r in files.vocabulary(spark, str(tmp_path / "t.json")).collect()] == [(0, "a", [1, 0]), (1, "b", [0, 1])]
    (tmp_path / "e.json").write_text('{"terms": [], "embeddings": []}')
    with pytest.raises(ValueError):
        files.vocabulary(spark, str(tmp_path / "e.json"))


def test_color_features():
    v = color.color_vector(np.tile([255, 0, 0], (50, 1)))
    assert len(v) == 77 and v[0] == 1 and v[36 + 15] == 1 and v[52 + 15] == 1 and v[68] == 255 / 256 and v[69] == 0
    assert np.isclose(color.color_vector(np.random.default_rng(0).integers(0, 256, (500, 3)))[:36].sum(), 1)


def test_results_are_kept_until_an_input_changes(spark, tmp_path):
    store, made = Store(spark, str(tmp_path)), []

    def make():
        made.append(1)
        return spark.range(3)

    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string"), spark.createDataFrame([(2, "y"), (1, "x")], "a int, b string")
    assert fingerprint(a) == fingerprint(b) != fingerprint(a.limit(1))
    for inputs in ([a], [b], [a.limit(1)]):
        assert store.cached("r", {"k": 1}, inputs, make).count() == 3
    assert len(made) == 2 and not store.exists("gone")
    store.save("gone", a)
    store.clear("gone")
    assert store.load("gone") is None


def test_stream_keeps_the_newest_row(spark, tmp_path):
    at = {k: str(tmp_path / k) for k in ("in", "cache", "check")}
    for vec in ([1.0], [2.0]):
        spark.createDataFrame([("h", "m", "v1", vec), (f"only{vec[0]}", "m", "v1", vec)], ingest.CACHE).coalesce(1).write.mode("append").parquet(at["in"])
        ingest.ingest(spark, at["in"], at["cache"], at["check"]).awaitTermination()
    assert {r.hash: r.vec for r in ingest.current(spark, at["cache"]).collect()} == {"h": [2.0], "only1.0": [1.0], "only2.0": [2.0]}


def test_positions_of_long_lists_equal_those_of_short_ones(spark):
    df = spark.range(3000).selectExpr("id", "(id * 7919) % 3000 as k")
    a = positions.with_positions(df, "k").orderBy("id").collect()
    assert a == positions.with_positions(df, "k", single=10).orderBy("id").select("id", "k", "pos").collect()


def test_names(spark):
    row = spark.range(1).select(
        text.numbered_name(F.lit(7), F.lit(12), F.lit("012 - Beach.JPG")).alias("a"),
        text.numbered_name(F.lit(1234), F.lit(5000), F.lit("x.y.png")).alias("b"),
        text.title(F.lit("3-a")).alias("c"),
        text.extension(F.lit(".hidden")).alias("d"),
        text.middle_cut(F.lit("abcdefghij"), F.lit(6)).alias("e"),
        text.path_format(F.lit("/x"), F.lit("a b.jpg"), True).alias("f"),
        text.fuzzy(F.lit("Summer (2024)"), "s(4").alias("g"),
        text.contains_text(F.lit("a  b"), "  ").alias("h"),
    ).first()
    assert list(row) == ["007 - Beach.jpg", "1234.png", "-a", "", "abc…ij", '@"/x/a b.jpg"', True, False]


def test_natural_order(spark):
    names = ["img10.jpg", "img2.jpg", "Img1.jpg", "a.jpg", "img02b.jpg"]
    got = renames.listing(spark.createDataFrame([(n,) for n in names], "filename string")).orderBy("pos")
    assert [r.filename for r in got.collect()] == ["a.jpg", "Img1.jpg", "img2.jpg", "img02b.jpg", "img10.jpg"]


def test_a_name_that_stands_twice_is_an_error(spark):
    with pytest.raises(Exception, match="duplicate name"):
        renames.rename_plan(spark.createDataFrame([("a", 0), ("a", 1)], "filename string, pos long")).collect()


def test_unknown_groups_of_a_scope_are_an_error(spark, sf_dir):
    with pytest.raises(ValueError, match="nowhere"):
        groups.scope_members(X.members(spark, sf_dir), ["g1", "nowhere"], X.images(spark, sf_dir))


def test_a_drag_onto_the_block_itself(spark):
    items = spark.createDataFrame([(c, i) for i, c in enumerate("abcde")], "filename string, pos long")
    order = lambda df: "".join(r.filename for r in df.orderBy("pos").collect())
    assert order(ordering.multi_drag(items, ["b", "d"], "b", "d")) == "bdace"
    assert order(ordering.multi_drag(items, ["b", "d"], "d", "b")) == "acbde"
    assert order(ordering.array_move(items, 3, 0)) == "dabce"
    assert order(ordering.shuffled(items, "c", 5))[0] == "c"


def test_terms_of_a_name_are_distinct():
    assert distinct_terms(["red car", "Redwood tree", "blue", "car red", "sky"]) == ["red_car", "blue", "car_red"]


def test_recovery_states(spark):
    m = spark.createDataFrame([("b", "x", "y")], "batch_id string, from string, to string")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "filename string")
    status = lambda a, b: renames.recovery_status(a, b).first().status
    assert status(m.limit(0), names("x")) == "none"
    assert status(m.limit(0), names(renames.TEMP_PREFIX + "b_y")) == "orphaned"
    assert status(m, names("y")) == "completed" and status(m, names("x")) == "orphaned" and status(m, names(renames.TEMP_PREFIX + "b_y")) == "completed"


def test_workspace(spark, sf_dir, tmp_path):
    few = X.images(spark, sf_dir).where("image_id < 60")
    models, members = X.models(spark, sf_dir).where("image_id < 60"), X.members(spark, sf_dir).where("image_id < 60")
    seen = []
    w = Workspace(spark, few.select("image_id", "filename", "pos"), models, members, X.patches(spark, sf_dir).where("image_id < 60"), X.terms(spark, sf_dir), Store(spark, str(tmp_path)), fallback="full", listeners=[seen.append])
    full = w.cluster(20)
    assert full.clusters.count() == 20 and full.labels.count() == 60 and full.clusters.where("auto_name IS NULL").count() == 0
    assert w.recut(15).clusters.count() == 15 and w.recut(threshold=1e9).clusters.count() >= 1 and w.recut(min_size=3).labels.count() == 60
    two = sorted(r.group_id for r in members.groupBy("group_id").count().orderBy(F.desc("count"), "group_id").limit(2).collect())
    assert w.scoped_cluster(two, 2).scope["group_ids"] == two
    assert w.nearest(["000003.jpg"], top_n=5).count() == 5
    assert w.merge_suggestions(0.0).count() > 0 and w.compare({"a": {"a": 1.0}, "b": {"b": 1.0}}, 10).count() == 120
    assert w.organize().count() == members.count() and w.cluster(10, use_patches=True).labels.count() == 60
    with pytest.raises(MissingModel):
        w.cluster(10, {"none": 1.0})
    with w._lock, pytest.raises(Busy):
        w.cluster(10)
    assert seen[0] == "cluster: started"


def test_a_log_keeps_its_last_lines(spark, tmp_path):
    from tessel.sources.log import LogTable, line

    table = LogTable(spark, str(tmp_path / "log"))
    assert table.open() == 0
    rows = spark.range(100).select((F.timestamp_seconds(F.col("id") % 7)).cast("timestamp_ntz").alias("ts"), F.col("id").alias("seq"), F.lit("t").alias("tag"), F.concat(F.lit("m"), "id").alias("message"))
    table.append(rows.where("id < 50"))
    table.append(rows.where("id >= 50"))
    want = sorted((i % 7, i) for i in range(100))[-30:]
    assert table.open(1000) == 100 and table.open(30) == 30
    assert sorted((r.ts.second, r.seq) for r in table.lines().collect()) == want
    got = rows.where("id = 8").select(line(F.col("ts"), F.col("tag"), F.col("message")).alias("a"), line(F.col("ts"), F.col("tag"), F.col("message"), F.lit("e")).alias("b")).first()
    assert got.a == "[1970-01-01T00:00:01.000Z] [t] m8" and got.b == "[1970-01-01T00:00:01.000Z] [t] ERROR m8: e"
