"""Further queries: selections, drags, folders, names, comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.functions import text
from tessel.operators import diagnostics, groups, ordering, pairs, renames, search
from tessel.plans import fixtures as X
from tessel.plans.lists import GM, IM, _every, _images, _members, _name, _plain_clusters
from tessel.plans.registry import registry
from tessel.plans.similarity import _GROUPS, _MEMBER_PAIRS, _member_vectors

QUERIES, ORACLES, query = registry()


_POS = "CAST(row_number() OVER (ORDER BY {}) - 1 AS BIGINT) AS pos"


@query(X.with_(X.FILES) + f"SELECT folder, {_POS.format('CAST(substr(folder, 4) AS INTEGER)')} FROM (SELECT DISTINCT folder FROM files)")
def subfolders(spark, d):
    f = X.files(spark, d)
    return renames.subfolders(f.select(F.concat_ws("/", "folder", "filename").alias("path")).unionByName(spark.createDataFrame([(".git/x",), ("root.jpg",)], "path string")))


@query(GM + "SELECT count(DISTINCT group_id) AS groups, count(*) AS images FROM members WHERE group_id IN ('g1', 'g4', 'g9')")
def selection_totals(spark, d):
    return groups.selection_total(_members(spark, d), ["g1", "g4", "g9", "gone"])


@query("SELECT CAST(3 AS BIGINT) AS pending")
def pending_merges(spark, d):
    return groups.pending_total(spark.createDataFrame([("a", "b"), ("a", "c"), ("d", "e")], "ref string, candidate string"))


@query(GM + f""", gone AS (SELECT filename FROM members WHERE group_id = 'g3' AND member_pos IN (1, 2)), kept AS (SELECT * FROM members WHERE filename NOT IN (SELECT filename FROM gone))
SELECT filename, {_POS.format('CASE WHEN filename IN (SELECT filename FROM gone) THEN 200.5 ELSE pos END, pos')} FROM images ANTI JOIN kept USING (filename)""")
def drag_out_of_group(spark, d):
    v, m = _images(spark, d), _members(spark, d)
    gone = [r.filename for r in m.where("group_id = 'g3' AND member_pos IN (1, 2)").orderBy("member_pos").collect()]
    loose = v.join(m.where(~F.col("filename").isin(*gone)).select("filename"), "filename", "left_anti")
    tokens = loose.select(F.col("filename").alias("token"), F.when(F.col("filename").isin(*gone), F.col("pos") - 10**6).otherwise(F.col("pos")).alias("pos"))
    over = loose.where("pos <= 200").where(~F.col("filename").isin(*gone)).orderBy(F.desc("pos")).first().filename
    return ordering.drag_out(v, m, "g3", gone, tokens, gone[0], over)[1]


@query(X.with_(X.FILES) + "SELECT filename, CASE WHEN folder = 'src1' THEN 'Holiday' WHEN folder = 'src2' THEN '007 - Work' ELSE folder END AS folder, pos FROM (SELECT filename, folder, pos FROM files)")
def folder_rename(spark, d):
    f = X.files(spark, d).withColumn("folder", F.when(F.col("folder") == "src2", "007 - src2").otherwise(F.col("folder")))
    return renames.rename_folder(renames.rename_folder(f, "src1", "Holiday"), "007 - src2", "Work")


@query(X.with_(X.FILES, "placed AS (SELECT filename, CASE WHEN pos % 4 <> 0 THEN folder END AS folder, pos FROM files)") + "SELECT filename, CASE WHEN folder = 'src5' THEN NULL ELSE folder END AS folder, CASE WHEN folder = 'src5' THEN (SELECT max(pos) FROM placed WHERE folder IS NULL) + 1 + pos ELSE pos END AS pos FROM placed")
def folder_dissolve(spark, d):
    f = X.files(spark, d).select("filename", F.when(F.col("pos") % 4 != 0, F.col("folder")).alias("folder"), "pos")
    return renames.dissolve_folder(f, "src5")


@query("SELECT true AS mismatch, 'numbered' AS wanted UNION ALL SELECT false, 'plain'")
def folder_numbering(spark, d):
    f = X.files(spark, d).select("folder").distinct()
    return renames.misnumbered(f, True).withColumn("wanted", F.lit("numbered")).unionByName(renames.misnumbered(f, False).withColumn("wanted", F.lit("plain")))


@query(IM + "SELECT filename, '\"/pics/' || filename || '\"' AS plain, '@\"/pics/' || filename || '\"' AS prompt, CAST(greatest(12, floor((pos - 20) / 9.0)) AS INTEGER) AS label_chars FROM images")
def path_formats(spark, d):
    f = F.lit("/pics")
    return _images(spark, d).select("filename", text.path_format(f, F.col("filename")).alias("plain"), text.path_format(f, F.col("filename"), True).alias("prompt"), text.label_width(F.col("pos")).alias("label_chars"))


@query("SELECT DISTINCT p_name AS name FROM part WHERE contains(lower(p_name), 're')")
def groups_named(spark, d):
    return search.groups_named(X.read(spark, d, "part").select(F.col("p_name").alias("name")).distinct(), " RE ")


@query(IM + "SELECT filename, min(pos) AS pos FROM (SELECT filename, pos FROM images UNION ALL SELECT filename, pos + 1000 FROM images WHERE image_id % 3 = 0) GROUP BY 1")
def distinct_selection(spark, d):
    v = _images(spark, d)
    keys = v.select(F.concat(F.lit("c1:"), "filename").alias("key"), "pos").unionByName(v.where("image_id % 3 = 0").select(F.concat(F.lit("c2:"), "filename").alias("key"), (F.col("pos") + 1000).alias("pos")))
    return groups.distinct_names(keys)


@query(GM + ", owner AS (SELECT filename, group_id AS g FROM members), raw AS (SELECT image_id % 13 AS label, count(*) AS size, list(filename ORDER BY pos) AS images FROM images GROUP BY 1), c AS (SELECT row_number() OVER (ORDER BY size DESC, label) - 1 AS cluster_id, images FROM raw) SELECT CAST(cluster_id AS VARCHAR) AS cluster_id, cluster_id + 1 AS pos, images FROM c UNION ALL SELECT 'picked', 0, (SELECT list(filename ORDER BY pos DESC) FROM images WHERE image_id % 50 = 1)")
def insert_picks(spark, d):
    picks = _every(spark, d, 50, 1).withColumn("ord", -F.col("ord"))
    c = _plain_clusters(spark, d).withColumn("auto_name", F.lit("x"))
    return groups.insert_picks(c, "picked", "Picked", picks.unionByName(picks.withColumn("ord", F.lit(10**6).cast("long")))).select("cluster_id", "pos", "images")


@query(GM + "SELECT group_id, filename, row_number() OVER (PARTITION BY group_id ORDER BY member_pos) - 1 AS member_pos FROM members WHERE NOT (group_id = 'g2' AND image_id % 10 = 0)")
def remove_from_group(spark, d):
    return groups.remove_from_group(_members(spark, d), "g2", _every(spark, d, 10)).select("group_id", "filename", "member_pos")


@query(IM + "SELECT filename, 'mark' AS action FROM images WHERE image_id % 4 = 0 OR image_id % 6 = 0 UNION ALL SELECT filename, 'unmark' FROM images WHERE image_id % 4 = 0 AND image_id % 6 <> 0 UNION ALL SELECT filename, 'prune' FROM images WHERE image_id % 12 = 0")
def trash_marks(spark, d):
    a, b, out = _every(spark, d, 4), _every(spark, d, 6), None
    for action in ("mark", "unmark", "prune"):
        got = groups.marks(a, b, action).withColumn("action", F.lit(action))
        out = got if out is None else out.unionByName(got)
    return out


@query(IM + "SELECT 'new-' || filename AS \"from\", filename AS \"to\" FROM images")
def undo_plan(spark, d):
    return renames.undo_plan(_images(spark, d).select(F.col("filename").alias("from"), F.concat(F.lit("new-"), "filename").alias("to")))


@query(GM + ", n AS (SELECT DISTINCT group_id, name FROM members) SELECT group_id AS ref_group FROM n a WHERE contains(lower(name), '3') OR EXISTS (SELECT 1 FROM n b WHERE CAST(substr(b.name, 2) AS INTEGER) = CAST(substr(a.name, 2) AS INTEGER) + 1 AND contains(lower(b.name), '3'))")
def search_suggestions(spark, d):
    n = _members(spark, d).select("group_id", "name").distinct()
    number = F.substring("name", 2, 9).cast("int")
    nxt = n.select((number - 1).alias("k"), F.col("name").alias("other"))
    rows = n.withColumn("k", number).join(nxt, "k", "left").select(F.col("group_id").alias("ref_group"), F.col("name").alias("ref_name"), F.array_compact(F.array("other")).alias("similar_names"))
    return search.suggestions(rows, "3").select("ref_group")


@query(IM + "SELECT CAST(count(*) AS BIGINT) AS n, min(filename) FILTER (pos = 17) AS first, CAST(0 AS BIGINT) AS first_pos FROM images")
def shuffle_with_first(spark, d):
    got = ordering.shuffled(_images(spark, d), _name(17), 3)
    return got.agg(F.countDistinct("filename", "pos").alias("n"), F.min_by("filename", "pos").alias("first"), F.min("pos").alias("first_pos"))


_HALF = _GROUPS + """, hp AS (SELECT m.group_id, m.group_pos, m.member_pos, p.* FROM members m JOIN patches p USING (image_id) WHERE patch_idx % 2 = 0), hs AS (SELECT a.group_id AS ga, b.group_id AS gb, a.image_id AS i, b.image_id AS j, a.patch_idx AS x, b.patch_idx AS y, list_dot_product(a.vec, b.vec) AS s FROM hp a JOIN hp b ON a.group_pos < b.group_pos),
  hc AS (SELECT ga, gb, i, j, sum(m) / 8 AS s FROM (SELECT ga, gb, i, j, x, max(s) AS m FROM hs GROUP BY ALL UNION ALL SELECT ga, gb, i, j, y, max(s) FROM hs GROUP BY ALL) GROUP BY ALL), h AS (SELECT ga, gb, (list(s ORDER BY s DESC))[1 + count(*) // 2] AS med FROM hc GROUP BY ga, gb)
SELECT group_a, group_b, round(patch_median, 6) AS "full", round(med, 6) AS pooled, round(med - patch_median, 6) AS delta FROM gs JOIN h ON ga = group_a AND gb = group_b"""


@query(_HALF)
def diag_patch_resolution(spark, d):
    m, p = X.members(spark, d), X.patches(spark, d)
    half = p.select("image_id", F.filter("patches", lambda x, i: i % 2 == 0).alias("patches"))
    got = diagnostics.patch_resolution(pairs.group_similarity(m, p), pairs.group_similarity(m, half))
    return got.select("group_a", "group_b", *(F.round(c, 6).alias(c) for c in ("full", "pooled", "delta")))


@query(_MEMBER_PAIRS + """, best AS (SELECT ga, gb, i, min(cd * sd) AS p FROM mp GROUP BY ga, gb, i) SELECT 'color x full' AS combo, ga AS group_a, gb AS group_b, round(avg(p), 6) AS mean, round((list(p ORDER BY p))[1 + count(*) // 2], 6) AS median FROM best GROUP BY ga, gb
UNION ALL SELECT 'full x full', ga, gb, round(avg(p), 6), round((list(p ORDER BY p))[1 + count(*) // 2], 6) FROM (SELECT ga, gb, i, min(sd * sd) AS p FROM mp GROUP BY ga, gb, i) GROUP BY ga, gb""")
def diag_combos(spark, d):
    m = _member_vectors(spark, d)
    combos = {"color x full": m, "full x full": m.withColumn("color", F.col("vec"))}
    got = diagnostics.combo_comparison({name: diagnostics.multiplicative(rows) for name, rows in combos.items()})
    return got.select("combo", "group_a", "group_b", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


@query(IM + "SELECT CAST(image_id AS VARCHAR) AS hash FROM images WHERE image_id % 4 = 0 OR image_id % 9 = 1")
def missing_patches(spark, d):
    from tessel.operators import cache

    v = X.images(spark, d)
    files = v.select("filename", F.col("image_id").cast("string").alias("hash"))
    zero = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.array(F.lit(0.0), F.lit(0.0)))
    some = F.array(F.array(F.lit(0.0), F.lit(1.0)))
    patches = v.where("image_id % 4 <> 0").select(F.col("image_id").cast("string").alias("hash"), F.when(F.col("image_id") % 9 == 1, zero).otherwise(some).alias("patches"))
    return cache.missing_patches(files, patches)
