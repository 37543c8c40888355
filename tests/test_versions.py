"""Versions and undo of groups, rename manifests, extraction that goes on, encoders, progress of jobs."""

import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.api import Workspace
from tessel.operators import groups, rename_log
from tessel.operators.extraction import ROWS, Extraction, encoded
from tessel.operators.history import GroupLog
from tessel.operators.renames import TEMP_PREFIX
from tessel.plans import fixtures as X

MEMBERS = "group_id string, name string, group_pos long, filename string, member_pos long"


def table(df):
    return sorted(tuple(r) for r in df.select("group_id", "name", "group_pos", "filename", "member_pos").collect())


def test_ten_edits_are_undone_exactly(spark, tmp_path):
    log = GroupLog(spark, str(tmp_path), every=5)
    states = []
    for k in range(12):
        rows = [(f"g{g}", f"n{g}" if k < 6 else "renamed", g, f"f{i}", i) for g in range(4) for i in range(3) if (g + i + k) % 4]
        log.commit(spark.createDataFrame(rows, MEMBERS), f"edit {k}")
        states.append(sorted(rows))
    assert [table(log.as_of(v)) for v in range(12)] == states
    for back in range(10, 0, -1):
        log.undo()
        assert table(log.as_of()) == states[back]
    assert log.undo() is None and log.version() == 21  # ten steps are kept
    log.commit(spark.createDataFrame([], MEMBERS), "all gone")
    assert table(log.as_of()) == [] and log.undo() is not None and table(log.as_of()) == states[1]
    assert [table(log.as_of(v)) for v in range(12)] == states  # old versions stay


def test_a_version_without_its_log_was_never_committed(spark, tmp_path):
    log = GroupLog(spark, str(tmp_path))
    one, two = ([("g", "n", 0, f"f{i}", i) for i in range(k)] for k in (1, 2))
    log.commit(spark.createDataFrame(one, MEMBERS), "one")
    spark.createDataFrame([(True, "g", "lost", "n", 0, 9)], "kept boolean, group_id string, filename string, name string, group_pos long, member_pos long").write.parquet(str(tmp_path / "changes" / "version=1"))
    assert table(log.as_of()) == one
    log.commit(spark.createDataFrame(two, MEMBERS), "two")
    assert table(log.as_of()) == two
    with pytest.raises(LookupError):
        log.as_of(7)


def test_a_workspace_edits_and_undoes(spark, sf_dir, tmp_path):
    m = X.members(spark, sf_dir)
    w = Workspace(spark, X.images(spark, sf_dir).select("image_id", "filename", "pos"), X.models(spark, sf_dir), m, edits=GroupLog(spark, str(tmp_path)))
    before = table(m)
    w.edit("delete", lambda rows: groups.delete_group(rows, "g1"))
    assert table(w.members) == [r for r in before if r[0] != "g1"] and w.members.where("image_id IS NULL").count() == 0
    assert w.undo_edit() == 2 and table(w.members) == before and w.undo_edit() is None


def names(spark, *n):
    return spark.createDataFrame([(x,) for x in n], "filename string")


def test_every_state_of_a_rename(spark, tmp_path):
    log = rename_log.RenameLog(spark, str(tmp_path / "m"))
    assert log.open().count() == 0 and rename_log.classify(log.open(), names(spark, "x")).count() == 0
    assert rename_log.overall(rename_log.classify(log.open(), names(spark, "x"))).first().status == "none"
    batch = log.begin(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d")], "from string, to string"))  # two swap their names
    temp = lambda to: f"{TEMP_PREFIX}{batch}_{to}"
    states = {
        ("a", "b", "c"): ("orphaned", 0, 0),
        (temp("b"), "b", "c"): ("completed", 2, 3),
        (temp("b"), temp("a"), temp("d")): ("completed", 0, 3),
        (temp("b"), temp("a"), "d"): ("completed", 0, 2),
        ("a", "b", "d"): ("completed", 0, 0),
        ("a",): ("orphaned", 0, 0),
    }
    for there, want in states.items():
        assert tuple(rename_log.classify(log.open(), names(spark, *there)).first())[1:] == want
    for there in list(states)[1:4]:  # from anywhere in between the replay ends at the same names, once or in two goes
        disk = names(spark, *there)
        moves = rename_log.replay(log.open(), disk)
        whole = rename_log.applied(disk, moves)
        assert sorted(r.filename for r in whole.collect()) == ["a", "b", "d"]
        half = names(spark, *(r.filename for r in rename_log.applied(disk, moves.where("phase = 1")).collect()))
        assert sorted(r.filename for r in rename_log.applied(half, rename_log.replay(log.open(), half)).collect()) == ["a", "b", "d"]
    log.done(batch)
    assert log.open().count() == 0
    assert [tuple(r)[:2] for r in rename_log.classify(log.open(), names(spark, temp("b"))).collect()] == [(batch, "orphaned")]


def test_an_extraction_that_was_cut_off_goes_on(spark, tmp_path):
    todo = spark.range(200).select(F.concat(F.lit("h"), "id").alias("hash"), F.lit("m").alias("model"), F.lit("1").alias("version"))
    done = []

    def encode(rows):
        if len(done) == 2:
            raise RuntimeError("interrupted")
        got = rows.select("hash", "model", "version", F.array(F.lit(1.0).cast("float")).alias("vec"))
        done.append(got.count())
        return got

    job = Extraction(spark, str(tmp_path), portion=50)
    with pytest.raises(RuntimeError):
        job.run(todo, encode)
    kept = job.rows().count()
    assert kept == sum(done) > 0 and job.log().count() == 2
    # a portion whose data was written but not committed isn't there
    spark.createDataFrame([("h0", "m", "1", [9.0])], ROWS).write.parquet(str(tmp_path / "data" / "portion=99"))
    done.clear()
    done.append(0)
    assert Extraction(spark, str(tmp_path), portion=500).run(todo, encode) == 200 - kept
    assert sum(done) == 200 - kept and job.rows().count() == job.rows().select("hash").distinct().count() == 200
    assert job.rows().where("vec[0] = 9").count() == 0 and job.run(todo, encode) == 0


def make():
    return lambda x: (x + np.float32(1)) @ np.arange(6, dtype=np.float32).reshape(3, 2)


def test_encoders_take_unreadable_pictures_as_empty(spark):
    rows = [("a", [1.0, 2.0, 3.0]), ("b", None), ("c", [1.0]), ("d", [1.0, None, 2.0]), ("e", [0.0, 0.0, 0.0]), ("f", [])]
    got = {r.hash: r.vec for r in encoded(spark.createDataFrame(rows, "hash string, pixels array<double>"), make, 3, "m", unit=False, batch=2).collect()}
    empty = make()(np.zeros((1, 3), np.float32))[0].tolist()
    assert got["b"] == got["c"] == got["d"] == got["e"] == got["f"] == empty and got["a"] == make()(np.array([[1, 2, 3]], np.float32))[0].tolist()
    unit = encoded(spark.createDataFrame(rows, "hash string, pixels array<double>"), make, 3, "m").collect()
    assert all(abs(np.linalg.norm(r.vec) - 1) < 1e-6 for r in unit)
    assert encoded(spark.createDataFrame([], "hash string, pixels array<double>"), make, 3, "m").count() == 0


def test_progress_rises_and_cancelling_is_told(spark, sf_dir):
    heard = []
    w = Workspace(spark, X.images(spark, sf_dir), X.models(spark, sf_dir), X.members(spark, sf_dir), listeners=[heard.append], every=0.1)
    assert w.progress() is None

    def slow(batches):
        for b in batches:
            time.sleep(0.3)
            yield b

    plan = spark.range(0, 64, 1, 64).mapInPandas(slow, "id long")
    w.run(plan, name="slow")
    shares = [float(h.split(", ")[1].rstrip("%")) for h in heard if ", " in h]
    assert heard[0] == "slow: started" and heard[-1] == "slow: done" and len(set(shares)) >= 3 and shares == sorted(shares)
    heard.clear()
    threading.Timer(1.0, w.cancel).start()
    with pytest.raises(Exception):
        w.run(spark.range(0, 640, 1, 640).mapInPandas(slow, "id long"), name="long")
    assert heard[-1] == "long: cancelled" and not w.running() and w.progress() is None


def test_portions_read_nothing_but_their_own_items(spark, tmp_path):
    """What is to be encoded is made a few times for all portions, not once for each."""
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    todo = spark.range(60).selectExpr("string(id) AS hash", "'toy' AS model", "'1' AS version", "float(id) AS x").mapInArrow(seen, "hash string, model string, version string, x float")
    encode = lambda rows: rows.selectExpr("hash", "model", "version", "array(x) AS vec")
    job = Extraction(spark, str(tmp_path), portion=6)
    assert job.run(todo, encode) == 60 and made.value <= 3 * 60
    assert job.log().count() > 5 and sorted(float(r.vec[0]) for r in job.rows().collect()) == list(map(float, range(60)))
    assert job.run(todo, encode) == 0 and not list(tmp_path.glob("todo-*"))
