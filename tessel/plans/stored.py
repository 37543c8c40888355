"""Queries over files, trees, versions, manifests, extraction, and further single operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessel.functions import text
from tessel.functions import vectors as V
from tessel.operators import cache, cuts, groups, linkage, ordering, pairs, rename_log, renames, search, weights
from tessel.operators.extraction import Extraction, encoded
from tessel.operators.history import GroupLog
from tessel.operators.positions import with_positions
from tessel.plans import fixtures as X
from tessel.plans.lists import GM, IM, _images, _members
from tessel.plans.registry import registry
from tessel.sources import arrays, files, log, shared

QUERIES, ORACLES, query = registry()


# --- files of records --------------------------------------------------------------------------------------------


def _rows(spark, d):
    return with_positions(X.read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec")), "vec_id", name="row")


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, embedding AS vec FROM embeddings")
def array_vectors(spark, d):
    """A two-dimensional array file, written by ranges of rows and read by ranges."""
    rows, path = _rows(spark, d), arrays.temporary(spark, "vectors.npy")
    arrays.write_npy(rows.select("row", "vec"), path, (rows.count(), 64))
    return arrays.read_npy(spark, path, taskBytes=1 << 14)


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, list_transform(range(8), lambda p: embedding[p * 8 + 1:p * 8 + 8]) AS patches FROM embeddings")
def array_patches(spark, d):
    """A three-dimensional array in parts behind a manifest."""
    rows, path = _rows(spark, d), arrays.temporary(spark, "patches")
    cut = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda p: F.slice("vec", p * 8 + 1, F.lit(8)))
    arrays.write_npy(rows.select("row", cut.alias("patches")), path, (rows.count(), 8, 8), layout="parts")
    return arrays.npy_patches(spark, path)


@query(X.with_(X.IMAGES, "v AS (SELECT row_number() OVER (ORDER BY image_id) - 1 AS i, vec FROM images)") + "SELECT a.i, b.i AS j, round(greatest(0.0, 1 - list_dot_product(a.vec, b.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec)))), 9) AS d FROM v a JOIN v b ON a.i < b.i")
def distance_file(spark, d):
    """All distances as a file of the upper triangle."""
    v = with_positions(X.images(spark, d), "image_id", name="at").select(F.col("at").alias("image_id"), "vec")
    path = arrays.temporary(spark, "distances.bin")
    arrays.write_matrix(pairs.cosine_pairs(v), path, v.count())
    return arrays.read_matrix(spark, path, taskBytes=1 << 18).select("i", "j", F.round("d", 9).alias("d"))


# --- a tree from a table: item k joins a later one, distances rise ------------------------------------------------

_TREE = """WITH RECURSIVE v AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, row_number() OVER (ORDER BY abs(embedding[1]), vec_id) - 1 AS r, label, abs(embedding[1]) AS x, count(*) OVER () AS n FROM embeddings),
  t AS (SELECT CAST(v.k AS INTEGER) AS step, CAST(v.k >= v.n // 10 AS INTEGER) AS phase, CAST(v.k AS INTEGER) AS a, CAST(v.k + 1 + (v.label * 7 + v.k * 13) % (v.n - 1 - v.k) AS INTEGER) AS b, CAST(o.x AS FLOAT) AS distance, CAST(v.k + 2 AS INTEGER) AS new_size, v.n FROM v JOIN v o ON o.r = v.k WHERE v.k < v.n - 1)"""
_LABELS = """, up(i, r) AS (SELECT k, k FROM v UNION ALL SELECT i, b FROM up JOIN kept ON a = r), root AS (SELECT i, max(r) AS r FROM up GROUP BY i), low AS (SELECT r, min(i) AS lo FROM root GROUP BY r)
SELECT 'tree' AS run_id, CAST(i AS INTEGER) AS idx, CAST(dense_rank() OVER (ORDER BY lo) - 1 AS INTEGER) AS label FROM root JOIN low USING (r)"""
_MAIN = _TREE + ", m AS (SELECT * FROM t WHERE phase = 1 AND distance < 1e10)"


def _tree(spark, d):
    e = X.read(spark, d, "embeddings").select("vec_id", "label", F.abs(F.col("embedding")[0]).alias("x"))
    v = with_positions(with_positions(e, "vec_id", name="k"), "x", "vec_id", name="r")
    n = F.lit(v.count())
    k = F.col("k")
    rows = v.where(k < n - 1).join(v.select(F.col("r").alias("k"), F.col("x").cast("float").alias("distance")), "k")
    b = k + 1 + (F.col("label") * 7 + k * 13) % (n - 1 - k)
    return rows.select(F.lit("tree").alias("run_id"), k.cast("int").alias("step"), (k >= F.floor(n / 10)).cast("int").alias("phase"), k.cast("int").alias("a"), b.cast("int").alias("b"), "distance", (k + 2).cast("int").alias("new_size")), v.count()


@query(_TREE + "SELECT CAST(step AS BIGINT) AS step, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, distance, CAST(new_size AS BIGINT) AS size FROM t")
def linkage_file(spark, d):
    steps, n = _tree(spark, d)
    path = arrays.temporary(spark, "linkage.bin")
    arrays.write_tree(steps, path, n, 10)
    return arrays.read_tree(spark, path, taskBytes=1 << 12)


@query(_TREE + ", kept AS (SELECT a, b FROM t WHERE phase = 0 OR step < n // 10 + greatest(0, (n - n // 10) - 40))" + _LABELS)
def tree_cut_count(spark, d):
    return cuts.by_count(_tree(spark, d)[0], 40, 10)


@query(_TREE + ", kept AS (SELECT a, b FROM t WHERE phase = 0 OR distance < 0.1)" + _LABELS)
def tree_cut_threshold(spark, d):
    return cuts.by_distance(_tree(spark, d)[0], 0.1)


@query(_MAIN + "SELECT 'tree' AS run_id, list(distance ORDER BY step) AS distances, CAST(any_value(n) - any_value(n) // 10 AS INTEGER) AS n_after_premerge, 10 AS n_groups FROM m")
def tree_profile(spark, d):
    steps, n = _tree(spark, d)
    return linkage.profile(steps, n, 10)


@query(_MAIN + "SELECT 'tree' AS run_id, count_if(distance < 0.05)::INTEGER AS merges, (any_value(n) - any_value(n) // 10)::INTEGER - count_if(distance < 0.05)::INTEGER AS clusters FROM m")
def tree_preview(spark, d):
    steps, n = _tree(spark, d)
    return cuts.threshold_preview(linkage.profile(steps, n, 10), 0.05)


@query(_MAIN + "SELECT 'tree' AS run_id, round(quantile_cont(distance::DOUBLE, 0.7), 6) AS threshold, CAST(least(1000, greatest(0, round((1 - (any_value(n) - any_value(n) // 10 - 60) / (count(*) - 1)) * 1000))) AS INTEGER) AS position FROM m")
def tree_slider(spark, d):
    steps, n = _tree(spark, d)
    p = linkage.profile(steps, n, 10)
    return cuts.slider_threshold(p, 300).select("run_id", F.round("threshold", 6).alias("threshold")).join(cuts.slider_position(p, 60), "run_id")


# --- versions, manifests, extraction -----------------------------------------------------------------------------


def _edited(spark, d):
    """Versions: 0 as given, 1 without g1, 2 with g2 renamed, 3 and 4 undo, 5 g3 and g4 merged."""
    log = GroupLog(spark, shared.fresh_folder(spark, "versions"), every=4)
    log.commit(_members(spark, d), "start")
    log.commit(groups.delete_group(log.as_of(), "g1"), "delete g1")
    log.commit(groups.rename_group(log.as_of(), "g2", "Renamed"), "rename g2")
    log.undo()
    log.undo()
    pending = spark.createDataFrame([("g3", "g4", 0)], "ref string, candidate string, ord int")
    log.commit(groups.merge_groups(log.as_of(), pending), "merge g3, g4")
    return log


_MERGED = "SELECT 'g3' AS group_id, 'g3' AS name, 3::BIGINT AS group_pos, filename, row_number() OVER (ORDER BY group_id, member_pos) - 1 AS member_pos FROM members WHERE group_id IN ('g3', 'g4')"


@query(GM + f"""SELECT v AS version, m.* EXCLUDE (image_id) FROM members m, (VALUES (0), (4)) t(v) UNION ALL SELECT v, m.* EXCLUDE (image_id) FROM members m, (VALUES (1), (3)) t(v) WHERE group_id <> 'g1'
UNION ALL SELECT 2, m.* EXCLUDE (image_id) REPLACE (CASE WHEN group_id = 'g2' THEN 'Renamed' ELSE name END AS name) FROM members m WHERE group_id <> 'g1' UNION ALL SELECT 5, m.* EXCLUDE (image_id) FROM members m WHERE group_id NOT IN ('g3', 'g4') UNION ALL SELECT 5, group_id, name, group_pos, filename, member_pos FROM ({_MERGED})""")
def group_versions(spark, d):
    log, out = _edited(spark, d), None
    for v in range(log.version() + 1):
        rows = log.as_of(v).select(F.lit(v).alias("version"), "group_id", "name", "group_pos", "filename", "member_pos")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(GM + """, n AS (SELECT group_id, count(*) AS n FROM members GROUP BY group_id), c AS (SELECT * FROM (VALUES (0, 'start', NULL, NULL), (1, 'delete g1', NULL, 'g1'), (2, 'rename g2', 'g2', NULL), (3, 'undo', 'g2', NULL), (4, 'undo', NULL, NULL), (5, 'merge g3, g4', 'g4', 'g4')) t(version, action, put, dropped))
SELECT version::BIGINT AS version, action, coalesce(a.n, 0) AS put, coalesce(b.n, 0) AS dropped FROM c LEFT JOIN n a ON a.group_id = put LEFT JOIN n b ON b.group_id = dropped WHERE version % 4 <> 0""")
def group_changes(spark, d):
    return _edited(spark, d).changes().where("put IS NOT NULL")


_RENAMES = X.with_(X.IMAGES, """r AS (SELECT CASE pos % 5 WHEN 0 THEN 'stopped' WHEN 1 THEN 'stale' WHEN 2 THEN 'lost' WHEN 3 THEN 'early' ELSE 'gone' END AS batch_id, filename AS f, 'new ' || filename AS t, pos // 5 AS k FROM images),
  s AS (SELECT *, CASE WHEN batch_id = 'stopped' THEN CASE k % 3 WHEN 0 THEN f WHEN 1 THEN '.tmp_rename_stopped_' || t ELSE t END WHEN batch_id = 'stale' THEN t WHEN batch_id = 'early' THEN f WHEN batch_id = 'gone' THEN '.tmp_rename_gone_' || t END AS name FROM r)""")


def _interrupted(spark, d):
    """Five batches: stopped in the middle, over but with its manifest (stale), with all its files lost, stopped before its first move (early), without manifest (gone)."""
    v = X.images(spark, d)
    kinds = ["stopped", "stale", "lost", "early", "gone"]
    batch = F.element_at(F.array(*map(F.lit, kinds)), (F.col("pos") % 5 + 1).cast("int"))
    r = v.select(batch.alias("batch_id"), F.col("filename").alias("from"), F.concat(F.lit("new "), "filename").alias("to"), F.expr("pos div 5").alias("k"))
    temp, k = rename_log.temp_name(F.col("batch_id"), F.col("to")), F.col("k") % 3
    stopped = F.when(k == 0, F.col("from")).when(k == 1, temp).otherwise(F.col("to"))
    name = F.when(F.col("batch_id") == "stopped", stopped).when(F.col("batch_id") == "stale", F.col("to")).when(F.col("batch_id") == "early", F.col("from")).when(F.col("batch_id") == "gone", temp)
    return r.where("batch_id <> 'gone'").select("batch_id", "from", "to"), r.select(name.alias("filename")).where("filename IS NOT NULL")


@query(_RENAMES + """SELECT batch_id, CASE WHEN batch_id IN ('stopped', 'stale') THEN 'completed' ELSE 'orphaned' END AS status, count(*) FILTER (batch_id = 'stopped' AND k % 3 = 0) AS to_first, count(*) FILTER (batch_id = 'stopped' AND k % 3 < 2) AS to_second FROM s GROUP BY batch_id""")
def rename_states(spark, d):
    return rename_log.classify(*_interrupted(spark, d))


@query(_RENAMES + "SELECT 0 AS moves_left, CASE WHEN batch_id = 'stopped' THEN t ELSE name END AS filename FROM s WHERE name IS NOT NULL")
def rename_replay(spark, d):
    """Names after a replay that was itself interrupted and is replayed; nothing is left to move then."""
    folder = shared.fresh_folder(spark, "renames")
    manifest, names = (shared.saved(x, f"{folder}/{n}") for n, x in zip(("manifest", "names"), _interrupted(spark, d), strict=True))
    moves = shared.saved(rename_log.replay(manifest, names), f"{folder}/moves")
    part = shared.saved(rename_log.applied(names, moves.where("phase = 1 AND crc32(from) % 2 = 0")), f"{folder}/part")
    after = shared.saved(rename_log.applied(part, shared.saved(rename_log.replay(manifest, part), f"{folder}/again")), f"{folder}/after")
    left = rename_log.replay(manifest, after).agg(F.count("*").cast("int").alias("moves_left"))
    return after.join(left)


def make_encoder():
    """A small linear encoder with fixed whole weights and an offset, so that its numbers are exact and an empty picture isn't zero."""
    w = (np.arange(64)[:, None] * (np.arange(8)[None, :] + 1) % 7 - 3).astype(np.float64)

    def run(x: np.ndarray) -> np.ndarray:
        return (x.astype(np.float64) @ w + 1).astype(np.float32)

    return run


def _pictures(spark, d):
    """Pictures of 64 bytes made from the vectors, some of which can't be read: null, too short, with a hole."""
    v = X.images(spark, d).withColumn("x", F.transform("vec", lambda x: F.pmod(F.floor(x * 997), F.lit(256)).cast("int")))
    hole = F.transform("x", lambda x, i: F.when(i != 3, x))
    broken = F.when(F.col("image_id") % 11 == 0, F.lit(None)).when(F.col("image_id") % 11 == 1, F.slice("x", 1, 20)).when(F.col("image_id") % 11 == 2, hole).otherwise(F.col("x"))
    return v.select(F.col("filename").alias("hash"), broken.alias("pixels"))


_ENCODED = X.with_(X.IMAGES, "p AS (SELECT filename AS hash, image_id, list_transform(vec, lambda x: CASE WHEN image_id % 11 < 3 THEN 0 ELSE ((CAST(floor(x * 997) AS BIGINT) % 256) + 256) % 256 END) AS x FROM images)")


@query(_ENCODED + "SELECT hash, 'toy' AS model, '1' AS version, list_transform(range(8), lambda k: CAST(list_sum(list_transform(range(64), lambda i: x[i + 1] * (i * (k + 1) % 7 - 3))) + 1 AS FLOAT)) AS vec FROM p")
def encoded_pictures(spark, d):
    return encoded(_pictures(spark, d), make_encoder, 64, "toy", unit=False)


@query(_ENCODED + ", n AS (SELECT count(*) AS n, count(*) FILTER (image_id % 3 = 0) AS early FROM p) SELECT early AS first_run, n - early AS second_run, 0::BIGINT AS third_run, n AS items, n AS hashes, true AS same FROM n")
def resumed_extraction(spark, d):
    """An extraction that saw a third of the items, one that goes on with the rest, one with nothing left; the rows are those of one run."""
    todo = _pictures(spark, d).withColumns({"model": F.lit("toy"), "version": F.lit("1")})
    job = Extraction(spark, shared.fresh_folder(spark, "extraction"), portion=100)
    encode = lambda rows: encoded(rows, make_encoder, 64, "toy")
    early = todo.where(F.substring("hash", 1, 6).cast("long") % 3 == 0)
    runs = [job.run(x, encode) for x in (early, todo, todo)]
    rows, once = job.rows(), encode(todo)
    other = rows.exceptAll(once.select(*rows.columns)).limit(1).count()
    return rows.agg(*(F.lit(n).cast("long").alias(f"{name}_run") for name, n in zip(("first", "second", "third"), runs, strict=True)), F.count("*").alias("items"), F.countDistinct("hash").alias("hashes"), F.lit(other == 0).alias("same"))


# --- single operators --------------------------------------------------------------------------------------------

_EXT = "CASE pos % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.gif' ELSE '.webp' END"


def _named(spark, d):
    ext = F.element_at(F.array(*map(F.lit, (".JPG", ".png", ".gif", ".webp"))), (F.col("pos") % 4 + 1).cast("int"))
    return X.files(spark, d).select(F.concat("filename", ext).alias("filename"), "pos")


@query(X.with_(X.FILES) + f"SELECT f AS filename, row_number() OVER (ORDER BY f) - 1 AS pos FROM (SELECT filename || {_EXT} AS f, pos FROM files WHERE pos % 4 <> 2)")
def extract_files(spark, d):
    return renames.extract_listing(_named(spark, d))


@query(GM + ", own AS (SELECT * FROM members WHERE image_id % 3 <> 0), big AS (SELECT group_id FROM own GROUP BY group_id HAVING count(*) >= 4) SELECT group_id, name, group_pos, filename, member_pos FROM own SEMI JOIN big USING (group_id)")
def groups_with_embeddings(spark, d):
    return files.usable_groups(_members(spark, d), X.images(spark, d).where("image_id % 3 <> 0"), 4)


@query(X.with_(X.FILES) + "SELECT CASE WHEN pos % 2 = 0 THEN 'renamed ' || filename ELSE filename END AS filename, 'tag ' || folder AS value FROM files WHERE pos % 5 <> 0")
def tags_after_renames(spark, d):
    f = X.files(spark, d)
    new = F.concat(F.lit("renamed "), "filename")
    mapping = f.where("pos % 2 = 0").select(F.col("filename").alias("from"), new.alias("to"))
    left = f.where("pos % 5 <> 0").select(F.when(F.col("pos") % 2 == 0, new).otherwise(F.col("filename")).alias("filename"))
    return renames.tags_remap(f.select("filename", F.concat(F.lit("tag "), "folder").alias("value")), mapping, left)


@query(X.with_(X.IMAGES) + "SELECT filename, 'full' AS model, list_transform(vec, lambda x: round(x, 6)) AS vec FROM images")
def embeddings_of_all_files(spark, d):
    """Strict: every file has an embedding, or it is an error."""
    v = X.images(spark, d)
    rows = v.select(F.sha2("filename", 256).alias("hash"), F.lit("full").alias("model"), "vec")
    got = cache.by_filename(v.select("filename", F.sha2("filename", 256).alias("hash")), rows, strict=True)
    return got.withColumn("vec", F.transform("vec", lambda x: V.rounded(x, 6)))


@query(X.with_(X.IMAGES, X.MODELS) + "SELECT preset, model, weight, n AS items FROM (VALUES " + ", ".join(f"('{p}', '{m}', {w}::DOUBLE)" for p, ws in weights.PRESETS.items() for m, w in ws.items()) + ") t(preset, model, weight) JOIN (SELECT model, count(*) AS n FROM models GROUP BY model) USING (model)")
def preset_models(spark, d):
    """Of each preset the models that it needs and that have rows, with their number."""
    needed = spark.createDataFrame([(p, m) for p, ws in weights.PRESETS.items() for m in weights.required_models(ws)], "preset string, model string")
    have = X.models(spark, d).groupBy("model").agg(F.count("*").alias("items"))
    return weights.presets(spark).join(needed, ["preset", "model"]).join(have, "model").select("preset", "model", "weight", "items")


@query(GM + ", head AS (SELECT group_id, min(pos) AS p FROM members JOIN images USING (filename) GROUP BY group_id) SELECT 'image' AS type, NULL AS group_id, filename FROM images ANTI JOIN members USING (filename) UNION ALL SELECT 'group', group_id, NULL FROM head")
def visible_items(spark, d):
    """The grid with an expanded group, without that group's items."""
    return ordering.visible(ordering.grid_items(_images(spark, d), _members(spark, d), expanded="g2")).select("type", "group_id", F.when(F.col("type") != "group", F.col("filename")).alias("filename"))


@query(GM + "SELECT group_id, name, group_pos, filename, member_pos FROM members WHERE group_id <> 'g5'")
def group_deleted(spark, d):
    return groups.delete_group(_members(spark, d), "g5")


@query(GM + "SELECT group_id, CASE WHEN group_id = 'g5' THEN 'Summer' ELSE name END AS name, group_pos, filename, member_pos FROM members")
def group_renamed(spark, d):
    return groups.rename_group(_members(spark, d), "g5", "Summer")


@query("SELECT DISTINCT p_name AS name FROM part WHERE regexp_matches(lower(p_name), '(?s)e.*l')")
def fuzzy_names(spark, d):
    return search.groups_fuzzy(X.read(spark, d, "part").select(F.col("p_name").alias("name")).distinct(), "eL")


@query(IM + "SELECT image_id || '-' || (image_id * 100) || '.webp' AS name FROM images WHERE image_id % 4 = 1")
def orphan_thumbnails(spark, d):
    """Cached thumbnails whose file is gone or has another size; other files in the folder stay."""
    v = X.images(spark, d)
    now = v.where("image_id % 4 <> 1").select(F.col("image_id").alias("inode"), (F.col("image_id") * 100).alias("size"))
    cached = v.select(text.thumbnail_key(F.col("image_id"), F.col("image_id") * 100).alias("name")).unionByName(v.select(F.concat("filename", F.lit(".txt")).alias("name")))
    return cache.orphan_thumbnails(now, cached)


@query(GM + "SELECT count(*) AS pending FROM (SELECT DISTINCT a.group_id, b.group_id FROM members a JOIN members b ON a.member_pos = b.member_pos AND a.group_pos + 1 = b.group_pos WHERE a.member_pos < 3)")
def pending_of_groups(spark, d):
    """Neighbouring groups picked to be merged, each pair once."""
    m = _members(spark, d).where("member_pos < 3")
    other = m.select(F.col("group_id").alias("candidate"), (F.col("group_pos") - 1).alias("group_pos"), "member_pos")
    return groups.pending_total(m.join(other, ["group_pos", "member_pos"]).select(F.col("group_id").alias("ref"), "candidate").distinct())


@query("SELECT '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z] [' || event_type || '] ' || CASE WHEN event_type = 'error' THEN 'ERROR ' ELSE '' END || 'user ' || user_id || CASE WHEN event_type = 'error' THEN ': ' || props ELSE '' END AS line FROM events ORDER BY ts DESC, event_id DESC LIMIT 50000")
def log_lines(spark, d):
    """Events as a log that was opened after all of them were written."""
    e = X.read(spark, d, "events")
    last = log.last_lines(e.select("ts", F.col("event_id").alias("seq"), "event_type", "props", F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("message")))
    plain, failed = (log.line(F.col("ts"), F.col("event_type"), F.col("message"), x) for x in (None, F.col("props")))
    return last.select(F.when(F.col("event_type") == "error", failed).otherwise(plain).alias("line"))
