"""Queries over ordered lists, groups, clusters, folders, names and the cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.functions import text
from tessel.operators import cache, groups, knn, ordering, renames, search
from tessel.plans import fixtures as X
from tessel.plans.registry import registry

QUERIES, ORACLES, query = registry()


IM = X.with_(X.IMAGES)
GM = X.with_(X.IMAGES, X.MEMBERS)
OVER = "over_m AS (SELECT group_id, name, group_pos, filename, member_pos FROM members UNION ALL SELECT 'extra', 'extra', 100, filename, member_pos FROM members WHERE group_id = 'g1' AND member_pos < 2)"
GO = X.with_(X.IMAGES, X.MEMBERS, OVER)


def _images(spark, d):
    return X.images(spark, d).select("filename", "pos", "image_id", "label")


def _members(spark, d):
    return X.members(spark, d).select("group_id", "name", "group_pos", "filename", "member_pos")


def _overlapping(spark, d):
    m = _members(spark, d)
    extra = m.where("group_id = 'g1' AND member_pos < 2").select(F.lit("extra").alias("group_id"), F.lit("extra").alias("name"), F.lit(100).cast("long").alias("group_pos"), "filename", "member_pos")
    return m.unionByName(extra)


def _every(spark, d, n, r=0):
    return _images(spark, d).where(f"image_id % {n} = {r}").select("filename", F.col("pos").alias("ord"))


def _name(i: int) -> str:
    return f"{i:06d}.jpg"


# --- ordered lists -----------------------------------------------------------------------------------------------

_POS = "CAST(row_number() OVER (ORDER BY {}) - 1 AS BIGINT) AS pos"


@query(IM + f"SELECT filename, {_POS.format('CASE WHEN image_id % 7 = 0 THEN 1 WHEN pos <= 100 THEN 0 ELSE 2 END, pos')} FROM images")
def multi_drag(spark, d):
    return ordering.multi_drag(_images(spark, d), _every(spark, d, 7), _name(14), _name(100))


@query(IM + f"SELECT filename, {_POS.format('CASE WHEN image_id % 7 = 0 THEN 1 WHEN pos < 50 THEN 0 ELSE 2 END, pos')} FROM images")
def multi_drag_up(spark, d):
    return ordering.multi_drag(_images(spark, d), _every(spark, d, 7), _name(140), _name(50))


@query(IM + "SELECT filename, CASE WHEN pos = 10 THEN 90 WHEN pos > 10 AND pos <= 90 THEN pos - 1 ELSE pos END AS pos FROM images")
def array_move(spark, d):
    return ordering.array_move(_images(spark, d), 10, 90)


@query(IM + f"SELECT filename, {_POS.format('CASE WHEN image_id % 7 = 3 THEN 3 ELSE pos END, pos')} FROM images")
def consolidate_block(spark, d):
    return ordering.consolidate(_images(spark, d), _every(spark, d, 7, 3))


@query(IM + f"SELECT filename, {_POS.format('CASE WHEN image_id % 7 = 3 THEN 3 ELSE pos END, CASE WHEN image_id % 7 = 3 THEN -pos ELSE 0 END')} FROM images")
def reposition_block(spark, d):
    return ordering.reposition(_images(spark, d), _every(spark, d, 7, 3).withColumn("ord", -F.col("ord")))


@query(GO + f""", tokens AS (SELECT 'group:' || group_id AS token, group_pos * 4 AS pos FROM (SELECT DISTINCT group_id, group_pos FROM over_m) UNION ALL SELECT filename, pos * 2 + 1 FROM images WHERE image_id % 3 = 1 UNION ALL SELECT 'nowhere.jpg', 11),
  flat AS (SELECT coalesce(m.filename, t.token) AS filename, min((t.pos, coalesce(m.member_pos, 0))) AS at_ FROM tokens t LEFT JOIN over_m m ON t.token = 'group:' || m.group_id GROUP BY 1)
SELECT filename, {_POS.format('at_')} FROM flat SEMI JOIN images USING (filename)""")
def flatten_order(spark, d):
    m, v = _overlapping(spark, d), _images(spark, d)
    tokens = m.select(F.concat(F.lit("group:"), "group_id").alias("token"), (F.col("group_pos") * 2).alias("pos")).distinct()
    tokens = tokens.unionByName(v.where("image_id % 3 = 1").select(F.col("filename").alias("token"), "pos")).unionByName(spark.createDataFrame([("nowhere.jpg", 5)], "token string, pos long"))
    # groups and names share no place
    return ordering.flatten_order(tokens.withColumn("pos", F.col("pos") * 2 + F.when(F.col("token").startswith("group:"), 0).otherwise(1)), m, v)


@query(GO + f"SELECT filename, {_POS.format('k, a, b')} FROM (SELECT filename, 0 AS k, group_pos AS a, member_pos AS b FROM over_m UNION ALL SELECT filename, 1, pos, 0 FROM images ANTI JOIN over_m USING (filename))")
def order_grouped_first(spark, d):
    return ordering.grouped_first(_images(spark, d), _overlapping(spark, d))


@query(GO + f""", firsts AS (SELECT filename, min((group_pos, member_pos)) AS at_ FROM over_m GROUP BY 1), disk AS (SELECT filename FROM images WHERE image_id % 11 <> 0)
SELECT filename, {_POS.format('k, at_, filename')}, k = 0 AS grouped FROM (SELECT filename, 0 AS k, at_ FROM firsts SEMI JOIN disk USING (filename) UNION ALL SELECT filename, 1, (0, 0) FROM disk ANTI JOIN firsts USING (filename))""")
def order_grouped_first_on_disk(spark, d):
    return ordering.grouped_first_on_disk(_images(spark, d).where("image_id % 11 <> 0").select("filename"), _overlapping(spark, d))[0]


@query(GM + f""", heads AS (SELECT group_id, min(i.pos) AS a FROM members JOIN images i USING (filename) GROUP BY 1), rows_ AS (SELECT 'image' AS type, NULL AS group_id, filename, pos AS a, -1 AS b FROM images ANTI JOIN members USING (filename)
  UNION ALL SELECT 'group', group_id, NULL, a, -1 FROM heads UNION ALL SELECT 'group-image', group_id, filename, a, member_pos FROM members JOIN heads USING (group_id) WHERE group_id = 'g2') SELECT type, group_id, filename, {_POS.format('a, b')} FROM rows_""")
def grid_items(spark, d):
    return ordering.grid_items(_images(spark, d), _members(spark, d), "g2")


@query(X.with_(X.FILES, "folders AS (SELECT folder, CAST(substr(folder, 4) AS BIGINT) AS folder_pos, filename, row_number() OVER (PARTITION BY folder ORDER BY pos) - 1 AS pos FROM files WHERE pos % 3 = 0)") + f""", rows_ AS (SELECT DISTINCT 'folder' AS type, folder, NULL AS filename, 0 AS k, folder_pos AS a, -1 AS b FROM folders UNION ALL SELECT 'folder-image', folder, filename, 0, folder_pos, pos FROM folders WHERE folder = 'src3'
  UNION ALL SELECT 'image', NULL, filename, 1, pos, 0 FROM files WHERE pos % 3 <> 0) SELECT type, folder, filename, {_POS.format('k, a, b')} FROM rows_""")
def folder_grid_items(spark, d):
    f = X.files(spark, d)
    inside = f.where("pos % 3 = 0").selectExpr("folder", "cast(substr(folder, 4) as bigint) as folder_pos", "filename", "cast(row_number() over (partition by folder order by pos) - 1 as bigint) as pos")
    return ordering.folder_items(f, inside, "src3")


@query(GM + f"""SELECT filename, {_POS.format("CASE WHEN image_id % 9 = 1 THEN coalesce((SELECT max(pos) FROM images SEMI JOIN (SELECT filename FROM members WHERE group_id = 'g4') USING (filename) WHERE image_id % 9 <> 1), pos) ELSE pos END, image_id % 9 = 1, pos")} FROM images""")
def after_last_member(spark, d):
    return ordering.after_last_member(_images(spark, d), _members(spark, d), "g4", _every(spark, d, 9, 1))


@query(GM + f"SELECT group_id, {_POS.format('first IS NULL, first, group_pos')} FROM (SELECT group_id, group_pos, min(i.pos) AS first FROM members m LEFT JOIN (SELECT * FROM images WHERE image_id > 60) i USING (filename) GROUP BY 1, 2)")
def groups_by_gallery(spark, d):
    return ordering.groups_by_gallery(_members(spark, d), _images(spark, d).where("image_id > 60"))


_STATUS = "CASE group_pos % 4 WHEN 0 THEN 'delete' WHEN 1 THEN 'keep' WHEN 2 THEN 'maybe' END AS status, CASE group_pos % 3 WHEN 0 THEN 'bottom' WHEN 1 THEN 'top' END AS sub_status"


@query(GM + f"SELECT group_id, {_POS.format("CASE status WHEN 'keep' THEN 0 WHEN 'delete' THEN 2 ELSE 1 END, CASE sub_status WHEN 'top' THEN 0 WHEN 'bottom' THEN 2 ELSE 1 END, group_pos")} FROM (SELECT DISTINCT group_id, group_pos, {_STATUS} FROM members)")
def review_order(spark, d):
    rows = _members(spark, d).selectExpr("group_id", "group_pos", *_STATUS.replace(" END AS status, ", " END AS status|").split("|")).distinct()
    return ordering.review_order(rows)


@query(IM + "SELECT filename, pos FROM images WHERE pos IN (SELECT (i * (SELECT count(*) FROM images)) // 12 FROM range(12) AS r(i))")
def even_sample(spark, d):
    return ordering.even_sample(_images(spark, d).select("filename", "pos"), 12)


@query(IM + "SELECT filename, pos, pos // 40 AS chunk FROM images")
def fixed_chunks(spark, d):
    return ordering.chunks(_images(spark, d).select("filename", "pos"), 40)


@query(IM + "SELECT filename FROM images WHERE pos BETWEEN 20 AND 90")
def range_select(spark, d):
    return ordering.range_select(_images(spark, d), 90, 20).select("filename")


@query(IM + "SELECT bool_or(x.filename IS DISTINCT FROM y.filename) AS changed FROM images x FULL JOIN (SELECT filename, pos FROM images WHERE pos < 300) y USING (pos)")
def has_changes(spark, d):
    v = _images(spark, d)
    return ordering.has_changes(v, v.where("pos < 300"))


@query(GM + "SELECT group_id, CASE WHEN len(m) <= 4 THEN m ELSE [m[1], m[1 + len(m) // 3], m[1 + len(m) * 2 // 3], m[len(m)]] END AS samples FROM (SELECT group_id, list(filename ORDER BY member_pos) AS m FROM members GROUP BY 1)")
def thumb_samples(spark, d):
    return ordering.thumb_samples(_members(spark, d))


@query(GM + """, first_ AS (SELECT filename AS o, member_pos AS p FROM members WHERE group_id = 'g0' AND member_pos = 1)
SELECT group_id, filename, row_number() OVER (PARTITION BY group_id ORDER BY p, k) - 1 AS member_pos FROM (SELECT group_id, filename, member_pos AS p, 0 AS k FROM members WHERE filename <> '000007.jpg' UNION ALL SELECT 'g0', '000007.jpg', p, 1 FROM first_)""")
def insert_in_group(spark, d):
    m = _members(spark, d)
    over = m.where("group_id = 'g0' AND member_pos = 1").first().filename
    return ordering.insert_in_group(m, "g0", "000007.jpg", over, moving_down=True).select("group_id", "filename", "member_pos")


# --- groups ------------------------------------------------------------------------------------------------------


@query(GO + "SELECT filename, arg_max(group_id, group_pos) AS group_id, arg_max(name, group_pos) AS name FROM over_m GROUP BY filename")
def group_lookup_last_wins(spark, d):
    return knn.group_of(_overlapping(spark, d), "filename")


@query(GO + "SELECT group_id, filename, row_number() OVER (PARTITION BY group_id ORDER BY member_pos) - 1 AS member_pos FROM over_m o WHERE group_pos = (SELECT max(group_pos) FROM over_m p WHERE p.filename = o.filename)")
def disjoint_groups(spark, d):
    return groups.disjoint(_overlapping(spark, d)).select("group_id", "filename", "member_pos")


@query(GM + "SELECT group_id, CASE WHEN image_id % 10 = 0 THEN 'new-' || filename ELSE filename END AS filename, member_pos FROM members")
def remap_groups(spark, d):
    mapping = _every(spark, d, 10).select(F.col("filename").alias("from"), F.concat(F.lit("new-"), "filename").alias("to"))
    return groups.remap(_members(spark, d), mapping).select("group_id", "filename", "member_pos")


@query(GM + "SELECT group_id, filename, row_number() OVER (PARTITION BY group_id ORDER BY member_pos) - 1 AS member_pos FROM members WHERE image_id % 10 <> 0 AND group_id <> 'g5'")
def prune_deleted(spark, d):
    gone = _members(spark, d).where("group_id = 'g5'").select("filename").union(_every(spark, d, 10).select("filename"))
    return groups.prune_deleted(_members(spark, d), gone).select("group_id", "filename", "member_pos")


@query(GM + "SELECT group_id, filename, row_number() OVER (PARTITION BY group_id ORDER BY member_pos) - 1 AS member_pos FROM members WHERE image_id < 200")
def prune_to_existing(spark, d):
    return groups.prune(_members(spark, d), _images(spark, d).where("image_id < 200")).select("group_id", "filename", "member_pos")


@query(GO + "SELECT DISTINCT filename FROM over_m WHERE group_id IN ('g1', 'g3', 'extra') AND filename IN (SELECT filename FROM images WHERE image_id % 2 = 0)")
def scope_members(spark, d):
    return groups.scope_members(_overlapping(spark, d), ["g1", "g3", "extra"], _every(spark, d, 2))


@query(GM + "SELECT group_pos % 3 AS scope_id, substr(sha256(string_agg(group_id, chr(10) ORDER BY group_id)), 1, 16) AS scope_key FROM (SELECT DISTINCT group_id, group_pos FROM members) GROUP BY 1")
def scope_key(spark, d):
    return groups.scope_keys(_members(spark, d).select((F.col("group_pos") % 3).alias("scope_id"), "group_id"))


@query(GO + """, pending AS (SELECT * FROM (VALUES ('g0', 'g2', 0), ('g0', 'g3', 1), ('g1', 'extra', 0), ('g1', 'gone', 1), ('gone', 'g4', 0)) AS t(ref, candidate, ord)), p AS (SELECT * FROM pending WHERE ref IN (SELECT group_id FROM over_m) AND candidate IN (SELECT group_id FROM over_m)),
  rows_ AS (SELECT group_id, filename, min((o, m)) AS at_ FROM (SELECT group_id, filename, -1 AS o, member_pos AS m FROM over_m UNION ALL SELECT ref, filename, ord, member_pos FROM p JOIN over_m ON candidate = group_id) GROUP BY 1, 2)
SELECT group_id, filename, row_number() OVER (PARTITION BY group_id ORDER BY at_) - 1 AS member_pos FROM rows_ WHERE group_id NOT IN (SELECT candidate FROM p)""")
def merge_groups(spark, d):
    pending = spark.createDataFrame([("g0", "g2", 0), ("g0", "g3", 1), ("g1", "extra", 0), ("g1", "gone", 1), ("gone", "g4", 0)], "ref string, candidate string, ord int")
    return groups.merge_groups(_overlapping(spark, d), pending).select("group_id", "filename", "member_pos")


@query(GM + """SELECT group_id, filename, row_number() OVER (PARTITION BY group_id ORDER BY k, m) - 1 AS member_pos FROM (SELECT group_id, filename, 0 AS k, member_pos AS m FROM members WHERE image_id % 15 <> 0 UNION ALL SELECT 'g6', filename, 1, pos FROM images WHERE image_id % 15 = 0)""")
def add_to_group(spark, d):
    return groups.add_to_group(_members(spark, d), "g6", _every(spark, d, 15)).select("group_id", "filename", "member_pos")


@query(GM + """SELECT group_id, filename, row_number() OVER (PARTITION BY group_id ORDER BY k, m) - 1 AS member_pos FROM (SELECT group_id, filename, 0 AS k, member_pos AS m FROM members UNION ALL SELECT 'g6', filename, 1, pos FROM images WHERE image_id % 15 = 0 AND filename NOT IN (SELECT filename FROM members WHERE group_id = 'g6'))""")
def add_suggested(spark, d):
    return groups.add_to_group(_members(spark, d), "g6", _every(spark, d, 15), move=False).select("group_id", "filename", "member_pos")


@query(GM + """SELECT group_id, filename, row_number() OVER (PARTITION BY group_id ORDER BY m) - 1 AS member_pos FROM (SELECT group_id, filename, member_pos AS m FROM members WHERE image_id % 25 <> 0 UNION ALL SELECT 'new', filename, pos FROM images WHERE image_id % 25 = 0)""")
def create_group(spark, d):
    return groups.create_group(_members(spark, d), "new", "New", _every(spark, d, 25)).select("group_id", "filename", "member_pos")


# --- clusters ----------------------------------------------------------------------------------------------------

_CL = GM + """, owner AS (SELECT filename, group_id AS g FROM members), raw AS (SELECT label, count(*) AS size, list(filename ORDER BY pos) AS images, arg_min(g, CASE WHEN g IS NOT NULL THEN pos END) AS confirmed_group
  FROM (SELECT image_id % 13 AS label, filename, pos FROM images) LEFT JOIN owner USING (filename) GROUP BY 1), clusters AS (SELECT row_number() OVER (ORDER BY size DESC, label) - 1 AS cluster_id, * FROM raw)\n"""


def _clusters(spark, d):
    labels = _images(spark, d).select("filename", "pos", (F.col("image_id") % 13).alias("label"))
    return groups.from_labels(labels, _members(spark, d))


@query(_CL + "SELECT * FROM clusters")
def clusters_from_labels(spark, d):
    return _clusters(spark, d)


def _plain_clusters(spark, d):
    c = _clusters(spark, d)
    return c.select("cluster_id", F.col("cluster_id").alias("pos"), "images", F.when(F.col("cluster_id") % 3 == 1, F.col("confirmed_group")).alias("confirmed_group"))


_PC = _CL + ", c AS (SELECT cluster_id, images, CASE WHEN cluster_id % 3 = 1 THEN confirmed_group END AS confirmed_group FROM clusters)\n"


@query(_PC + ", sel AS (SELECT * FROM c WHERE cluster_id IN (2, 4, 6)), t AS (SELECT cluster_id FROM sel ORDER BY confirmed_group IS NULL, len(images) DESC, cluster_id LIMIT 1), m AS (SELECT list_sort(list_distinct(flatten(list(images)))) AS images FROM sel) SELECT cluster_id, CASE WHEN cluster_id = (SELECT cluster_id FROM t) THEN (SELECT images FROM m) ELSE images END AS images, confirmed_group FROM c WHERE cluster_id NOT IN (2, 4, 6) OR cluster_id = (SELECT cluster_id FROM t)")
def merge_clusters(spark, d):
    return groups.merge_clusters(_plain_clusters(spark, d), [2, 4, 6]).select("cluster_id", "images", "confirmed_group")


@query(_PC + """, taken AS (SELECT cluster_id, list_sort(list_filter(images, lambda x: substr(x, 6, 1) IN ('2', '5'))) AS take FROM c WHERE cluster_id < 4)
SELECT cluster_id, false AS split, list_filter(images, lambda x: take IS NULL OR len(take) = 0 OR NOT list_contains(take, x)) AS images FROM c LEFT JOIN taken USING (cluster_id) UNION ALL SELECT cluster_id, true, take FROM taken WHERE len(take) > 0""")
def split_cluster(spark, d):
    c = _plain_clusters(spark, d)
    picked = c.where("cluster_id < 4").select("cluster_id", F.explode("images").alias("filename")).where(F.substring("filename", 6, 1).isin("2", "5"))
    return groups.split_clusters(c, picked).select("cluster_id", "split", "images")


@query(_PC + "SELECT cluster_id, list_filter(images, lambda x: NOT list_contains(own, x)) AS suggested FROM c JOIN (SELECT group_id, list(filename) AS own FROM members GROUP BY 1) ON group_id = confirmed_group")
def suggested_images(spark, d):
    return groups.suggested(_plain_clusters(spark, d), _members(spark, d))


@query(_PC + """, ok AS (SELECT *, row_number() OVER (ORDER BY cluster_id) AS n FROM c WHERE confirmed_group IS NULL AND len(images) >= 10), new AS (SELECT 'cluster-' || cluster_id AS group_id, (SELECT max(group_pos) FROM members) + n AS group_pos, unnest(images) AS filename, generate_subscripts(images, 1) - 1 AS member_pos FROM ok)
SELECT group_id, group_pos, filename, row_number() OVER (PARTITION BY group_id ORDER BY member_pos) - 1 AS member_pos FROM (SELECT group_id, group_pos, filename, member_pos FROM members ANTI JOIN new USING (filename) UNION ALL SELECT * FROM new)""")
def accept_clusters(spark, d):
    c = _plain_clusters(spark, d).withColumn("auto_name", F.lit("x"))
    return groups.accept_clusters(c, _members(spark, d), 10).select("group_id", "group_pos", "filename", "member_pos")


@query(_PC + """, s AS (SELECT *, CASE WHEN cluster_id % 4 IN (2, 3) THEN cluster_id - 1 END AS split_from FROM c), f(cluster_id) AS (SELECT cluster_id FROM s WHERE confirmed_group IS NOT NULL UNION SELECT s.cluster_id FROM s JOIN f ON s.split_from = f.cluster_id AND s.cluster_id > f.cluster_id)
SELECT cluster_id, row_number() OVER (ORDER BY cluster_id IN (SELECT cluster_id FROM f) DESC, cluster_id) - 1 AS pos FROM s""")
def confirmed_first(spark, d):
    c = _plain_clusters(spark, d).withColumn("split_from", F.when((F.col("cluster_id") % 4).isin(2, 3), F.col("cluster_id") - 1))
    return groups.confirmed_first(c)


@query(IM + "SELECT filename FROM images WHERE (image_id % 4 = 0) <> (image_id % 6 = 0)")
def trash_toggle(spark, d):
    return groups.marks(_every(spark, d, 4), _every(spark, d, 6), "toggle")


# --- search ------------------------------------------------------------------------------------------------------


@query(GM + ", heads AS (SELECT DISTINCT group_id, name FROM members) SELECT 'image' AS type, NULL AS group_id, filename FROM images ANTI JOIN members USING (filename) WHERE contains(lower(filename), '2.jpg') UNION ALL SELECT 'group', group_id, NULL FROM heads WHERE contains(lower(name), '2.jpg')")
def search_items(spark, d):
    grid = ordering.grid_items(_images(spark, d), _members(spark, d))
    return search.items(grid, _members(spark, d), "2.JPG").select("type", "group_id", "filename")


@query(_PC + "SELECT cluster_id FROM c WHERE contains(lower('cluster ' || cluster_id), '00012') OR len(list_filter(images, lambda x: contains(lower(x), '00012'))) > 0")
def search_clusters(spark, d):
    c = _plain_clusters(spark, d).withColumns({"auto_name": F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string")), "group_name": F.lit(None).cast("string")})
    return search.clusters(c, " 00012 ").select("cluster_id")


@query("SELECT DISTINCT p_name AS name FROM part WHERE regexp_matches(lower(p_name), '(?s)a.*e.*s')")
def fuzzy_groups(spark, d):
    names = X.read(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    return search.groups_fuzzy(names, "AeS")


# --- renames and folders -----------------------------------------------------------------------------------------

_NUM = "lpad(CAST({n} AS VARCHAR), CAST(greatest(3, length(CAST({t} AS VARCHAR)), length(CAST({n} AS VARCHAR))) AS INTEGER), '0')"
_TO = "{num} || regexp_extract(regexp_replace({f}, '\\.[^.]*$', ''), '^\\d+(\\s*-\\s*.+)$', 1) || lower(regexp_extract({f}, '^.+(\\.[^.]*)$', 1))"


@query(X.with_(X.FILES) + f"SELECT filename AS \"from\", {_TO.format(num=_NUM.format(n='(n - pos)', t='n'), f='filename')} AS \"to\" FROM (SELECT *, count(*) OVER () AS n FROM files)")
def rename_plan(spark, d):
    f = X.files(spark, d)
    n = f.agg(F.count("*").alias("n"))
    order = f.join(F.broadcast(n)).select("filename", (F.col("n") - 1 - F.col("pos")).alias("pos"))
    return renames.rename_plan(order).select("from", "to")


@query(GM + f""", firsts AS (SELECT group_id, row_number() OVER (ORDER BY min(i.pos) DESC, group_pos) AS o, count(*) OVER () AS g FROM members JOIN images i USING (filename) GROUP BY group_id, group_pos), sizes AS (SELECT group_id, count(*) AS n FROM members GROUP BY 1)
SELECT {_NUM.format(n='o', t='g')} || ' - ' || name AS folder, filename AS "from", {_TO.format(num=_NUM.format(n='(member_pos + 1)', t='n'), f='filename')} AS "to" FROM members JOIN firsts USING (group_id) JOIN sizes USING (group_id)""")
def organize_plan(spark, d):
    return renames.organize_plan(_members(spark, d), _reversed_firsts(spark, d))


def _reversed_firsts(spark, d):
    m = _members(spark, d).join(_images(spark, d).select("filename", "pos"), "filename")
    low = m.groupBy("group_id").agg(F.min("pos").alias("p"))
    return m.select("group_id", "filename").join(low, "group_id").select("filename", (-F.col("p")).alias("pos"))


_FOLDERS = X.with_(X.FILES, "folders AS (SELECT 'Album ' || folder AS title, CAST(substr(folder, 4) AS BIGINT) AS folder_pos, folder || '/' || filename AS path, row_number() OVER (PARTITION BY folder ORDER BY pos) - 1 AS pos FROM files WHERE folder < 'src15')", "root AS (SELECT filename AS path, row_number() OVER (ORDER BY pos) - 1 AS pos FROM files WHERE folder >= 'src15')")


def _folders(spark, d):
    f = X.files(spark, d)
    inside = f.where("folder < 'src15'").selectExpr("concat('Album ', folder) as title", "cast(substr(folder, 4) as bigint) as folder_pos", "concat(folder, '/', filename) as path", "cast(row_number() over (partition by folder order by pos) - 1 as bigint) as pos")
    root = f.where("folder >= 'src15'").selectExpr("filename as path", "cast(row_number() over (order by pos) - 1 as bigint) as pos")
    return inside, root


@query(_FOLDERS + f""", base AS (SELECT *, split_part(path, '/', 2) AS f, count(*) OVER (PARTITION BY folder_pos) AS n, (SELECT count(DISTINCT folder_pos) FROM folders) AS g FROM folders)
SELECT path AS "from", {_NUM.format(n='(folder_pos + 1)', t='g')} || ' - ' || title || '/' || {_TO.format(num=_NUM.format(n='(pos + 1)', t='n'), f='f')} AS "to" FROM base UNION ALL SELECT path, {_TO.format(num=_NUM.format(n='(pos + 1)', t='n'), f='path')} FROM (SELECT *, count(*) OVER () AS n FROM root) WHERE path <> {_TO.format(num=_NUM.format(n='(pos + 1)', t='n'), f='path')}""")
def folder_save_plan(spark, d):
    return renames.folder_save_plan(*_folders(spark, d))


@query(_FOLDERS + f""", target AS (SELECT DISTINCT {_NUM.format(n='(folder_pos + 1)', t='(SELECT count(DISTINCT folder_pos) FROM folders)')} || ' - ' || title AS folder FROM folders), have AS (SELECT folder FROM target WHERE folder < '004' UNION ALL SELECT 'old' UNION ALL SELECT '009 - gone')
SELECT folder, 'create' AS action FROM target ANTI JOIN have USING (folder) UNION ALL SELECT folder, 'remove' FROM have ANTI JOIN target USING (folder)""")
def folder_diff(spark, d):
    target = renames.target_folders(_folders(spark, d)[0])
    have = target.where("folder < '004'").unionByName(spark.createDataFrame([("old",), ("009 - gone",)], "folder string"))
    return renames.folder_diff(target, have)


@query(X.with_(X.FILES) + "SELECT filename, CASE WHEN pos % 6 = 0 AND folder <> 'src2' THEN 'src2' ELSE folder END AS folder, CASE WHEN pos % 6 = 0 AND folder <> 'src2' THEN (SELECT max(pos) FROM files WHERE folder = 'src2') + 1 + pos ELSE pos END AS pos FROM files")
def folder_move(spark, d):
    f = X.files(spark, d)
    return renames.move_images(f, f.where("pos % 6 = 0").select("filename", F.col("pos").alias("ord")), "src2")


@query(IM + "SELECT filename, CASE WHEN image_id % 3 = 0 THEN 'missing' ELSE 'deleted' END AS outcome FROM images WHERE image_id % 2 = 0 UNION ALL SELECT '../x.jpg', 'refused' UNION ALL SELECT '.hidden', 'refused'")
def delete_split(spark, d):
    names = _every(spark, d, 2).select("filename").unionByName(spark.createDataFrame([("../x.jpg",), (".hidden",)], "filename string"))
    return renames.delete_split(names, _images(spark, d).where("image_id % 3 <> 0"))


@query(IM + "SELECT 'completed' AS status, CAST(count_if(image_id % 2 = 1) AS BIGINT) AS to_first, CAST(count(*) AS BIGINT) AS to_second FROM images")
def recovery_status(spark, d):
    v = _images(spark, d)
    to = F.concat(F.lit("x"), "filename")
    manifest = v.select(F.lit("b1").alias("batch_id"), F.col("filename").alias("from"), to.alias("to"))
    names = v.where("image_id % 2 = 1").select("filename").unionByName(v.where("image_id % 2 = 0").select(F.concat(F.lit(renames.TEMP_PREFIX + "b1_"), to).alias("filename")))
    return renames.recovery_status(manifest, names)


@query(X.with_(X.FILES) + "SELECT folder, list(filename ORDER BY filename) AS images FROM (SELECT CASE WHEN pos % 5 <> 0 THEN folder END AS folder, replace(filename, '.TXT', '.JPG') AS filename FROM files WHERE pos % 7 <> 0) GROUP BY 1")
def folder_listing(spark, d):
    f = X.files(spark, d).withColumn("name", F.when(F.col("pos") % 7 != 0, F.replace("filename", F.lit(".TXT"), F.lit(".JPG"))).otherwise(F.col("filename")))
    return renames.folder_data(f.select(F.when(F.col("pos") % 5 != 0, F.concat_ws("/", "folder", "name")).otherwise(F.col("name")).alias("path")))


@query(X.with_(X.FILES) + f"SELECT filename || '.jpg' AS filename, {_POS.format('pos')} FROM (SELECT 'img' || pos AS filename, pos FROM files)")
def natural_listing(spark, d):
    return renames.listing(X.files(spark, d).select(F.concat(F.lit("img"), F.col("pos").cast("string"), F.lit(".jpg")).alias("filename")).unionByName(spark.createDataFrame([(".hidden.jpg",), ("notes.txt",)], "filename string")))


@query(IM + """, c AS (SELECT pos, 0.5 + (image_id % 10) / 10.0::DOUBLE AS aspect FROM images), r AS (SELECT *, pos // 4 AS row, avg(aspect) OVER () AS mean FROM c), h AS (SELECT *, CAST(round(2000 / (sum(aspect) OVER (PARTITION BY row) + (4 - count(*) OVER (PARTITION BY row)) * mean)) AS BIGINT) AS h FROM r),
  w0 AS (SELECT *, CAST(round(h * aspect) AS BIGINT) AS w_ FROM h), w AS (SELECT * EXCLUDE (w_), CASE WHEN count(*) OVER (PARTITION BY row) = 4 AND pos % 4 = 3 THEN 2000 - (sum(w_) OVER (PARTITION BY row) - w_) ELSE w_ END::BIGINT AS w FROM w0), t AS (SELECT row, coalesce(sum(h) OVER (ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS y FROM (SELECT DISTINCT row, h FROM w)) SELECT pos, row, CAST(coalesce(sum(w) OVER (PARTITION BY row ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS x, CAST(y AS BIGINT) AS y, w, h FROM w JOIN t USING (row)""")
def justified_layout(spark, d):
    cells = _images(spark, d).select("pos", (F.lit(0.5) + (F.col("image_id") % 10) / F.lit(10.0)).alias("aspect"))
    return renames.justified(cells, 4)


@query("""SELECT doc_id, lower(substr(sha1(least(source, lang) || chr(10) || greatest(source, lang)), 1, 8)) AS hash8, substr(regexp_replace(text, '[^a-zA-Z0-9_-]', '_', 'g'), 1, 80) AS safe, CASE WHEN length(source || lang || doc_id) <= 7 THEN source || lang || doc_id ELSE left(source || lang || doc_id, 4) || '…' || right(source || lang || doc_id, 2) END AS cut,
  replace(replace('<' || source || '&' || lang || '>', '&', '&amp;'), '<', '&lt;') AS half_escaped, CASE doc_id % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'text/html' ELSE 'application/octet-stream' END AS mime, 'W/"' || doc_id || '-' || n_chars || '"' AS etag, trim(regexp_replace('00' || doc_id || ' - ' || source, '^\\d+\\s*-\\s*', '')) AS bare FROM documents""")
def name_functions(spark, d):
    t = X.read(spark, d, "documents")
    name = F.concat("source", "lang", F.col("doc_id").cast("string"))
    escaped = text.xml_escape(F.concat(F.lit("<"), "source", F.lit("&"), "lang", F.lit(">")))
    return t.select(
        "doc_id",
        text.batch_hash(F.array("source", "lang")).alias("hash8"),
        text.safe_name(F.col("text")).alias("safe"),
        text.middle_cut(name, F.lit(7)).alias("cut"),
        F.replace(escaped, F.lit("&gt;"), F.lit(">")).alias("half_escaped"),
        text.mime_type(F.concat(F.lit("a/b."), F.when(F.col("doc_id") % 3 == 0, "PNG").when(F.col("doc_id") % 3 == 1, "html").otherwise("zip"))).alias("mime"),
        text.weak_etag(F.col("doc_id"), F.col("n_chars")).alias("etag"),
        text.strip_number(F.concat(F.lit("00"), F.col("doc_id").cast("string"), F.lit(" - "), "source")).alias("bare"),
    )


# --- the cache ---------------------------------------------------------------------------------------------------

_CACHE = X.with_(X.IMAGES, X.FILES, "hashes AS (SELECT f.filename, sha256(d.text) AS hash, d.doc_id FROM files f JOIN documents d ON d.doc_id = f.pos)", "cache_old AS (SELECT hash, m AS model, CASE WHEN i % 5 = 0 THEN 'v0' ELSE 'v1' END AS version, [CASE WHEN i % 7 = 0 THEN 0.0 ELSE 1.0 END, CASE WHEN i % 7 = 0 THEN 0.0 ELSE i * 1.0 END]::DOUBLE[] AS vec FROM (SELECT hash, min(doc_id) AS i FROM hashes GROUP BY 1), (SELECT unnest(['x', 'y']) AS m) WHERE i % 3 <> 0 OR m = 'x' AND i % 2 = 0)")


def _hashes(spark, d):
    return X.read(spark, d, "documents").select(F.concat(F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit(" - "), "lang", F.lit(".TXT")).alias("filename"), F.sha2("text", 256).alias("hash"), "doc_id")


def _cache(spark, d):
    i = _hashes(spark, d).groupBy("hash").agg(F.min("doc_id").alias("i"))
    rows = i.select("hash", "i", F.explode(F.array(F.lit("x"), F.lit("y"))).alias("model")).where("i % 3 <> 0 OR model = 'x' AND i % 2 = 0")
    zero = F.col("i") % 7 == 0
    return rows.select("hash", "model", F.when(F.col("i") % 5 == 0, "v0").otherwise("v1").alias("version"), F.array(F.when(zero, 0.0).otherwise(1.0), F.when(zero, 0.0).otherwise(F.col("i").cast("double"))).alias("vec"))


def _versions(spark):
    return spark.createDataFrame([("x", "v1"), ("y", "v1")], "model string, version string")


@query(_CACHE + "SELECT filename, model, vec FROM hashes JOIN cache_old USING (hash)")
def cache_by_filename(spark, d):
    return cache.by_filename(_hashes(spark, d), _cache(spark, d))


@query(_CACHE + "SELECT filename, hash FROM hashes ANTI JOIN cache_old USING (hash)")
def new_hashes(spark, d):
    return cache.new_files(_hashes(spark, d), _cache(spark, d)).select("filename", "hash")


@query(_CACHE + "SELECT hash, model FROM cache_old WHERE vec[1] = 0 AND vec[2] = 0")
def zero_rows(spark, d):
    return cache.zero_rows(_hashes(spark, d), _cache(spark, d))


@query(_CACHE + "SELECT DISTINCT model FROM cache_old WHERE version <> 'v1'")
def outdated_models(spark, d):
    return cache.outdated(_cache(spark, d), _versions(spark))


@query(_CACHE + "SELECT hash, model, reason FROM (SELECT h.hash, m.model, CASE WHEN c.vec IS NULL THEN 'new' WHEN c.version <> 'v1' THEN 'version' WHEN c.vec[1] = 0 AND c.vec[2] = 0 THEN 'zero' END AS reason FROM (SELECT DISTINCT hash FROM hashes) h CROSS JOIN (SELECT unnest(['x', 'y']) AS model) m LEFT JOIN cache_old c ON c.hash = h.hash AND c.model = m.model) WHERE reason IS NOT NULL")
def to_extract(spark, d):
    return cache.to_extract(_hashes(spark, d), _cache(spark, d), _versions(spark))


@query(_CACHE + "SELECT hash, model, CASE WHEN vec[2] % 4 = 1 THEN 'v2' ELSE version END AS version, CASE WHEN vec[2] % 4 = 1 THEN [9.0, 9.0]::DOUBLE[] ELSE vec END AS vec FROM cache_old UNION ALL SELECT 'fresh', 'x', 'v2', [1.0, 2.0]::DOUBLE[]")
def cache_upsert(spark, d):
    c = _cache(spark, d)
    new = c.where("vec[1] % 4 = 1").select("hash", "model", F.lit("v2").alias("version"), F.array(F.lit(9.0), F.lit(9.0)).alias("vec"))
    new = new.unionByName(spark.createDataFrame([("fresh", "x", "v2", [1.0, 2.0])], "hash string, model string, version string, vec array<double>"))
    return cache.upsert(c, new)


@query(_CACHE + "SELECT hash, model, version FROM cache_old WHERE hash IN (SELECT hash FROM hashes WHERE doc_id % 4 <> 0)")
def stale_prune(spark, d):
    return cache.prune(_cache(spark, d), _hashes(spark, d).where("doc_id % 4 <> 0")).select("hash", "model", "version")


@query(_CACHE + "SELECT m.model, t.total, coalesce(c.cached, 0) AS cached, t.total - coalesce(c.cached, 0) AS missing FROM (SELECT unnest(['x', 'y', 'z']) AS model) m CROSS JOIN (SELECT count(DISTINCT hash) AS total FROM hashes) t LEFT JOIN (SELECT model, count(DISTINCT hash) AS cached FROM cache_old WHERE NOT (vec[1] = 0 AND vec[2] = 0) GROUP BY 1) c USING (model)")
def cache_manifest(spark, d):
    return cache.manifest(_hashes(spark, d), _cache(spark, d), spark.createDataFrame([("x",), ("y",), ("z",)], "model string"))


def _pool_sql() -> str:
    def at(p):
        return f"vec[{p * 4 + 1}:{p * 4 + 4}]"

    def unit(v):
        return f"list_transform({v}, lambda x: round(x / greatest(sqrt(list_dot_product({v}, {v})), 1e-10), 6))"

    pooled = []
    for r in (0, 1):
        for c in (0, 1):
            cells = [(2 * r + i) * 4 + 2 * c + j for i in (0, 1) for j in (0, 1)]
            mean = "[" + ", ".join("(" + " + ".join(f"vec[{p * 4 + k}]" for p in cells) + ") / 4" for k in (1, 2, 3, 4)) + "]"
            pooled.append(unit(mean))
    return f"SELECT image_id AS hash, [{', '.join(unit(at(p)) for p in range(16))}] AS full_, [{', '.join(pooled)}] AS pooled FROM images"


@query(IM + _pool_sql())
def pooled_patches(spark, d):
    v = X.images(spark, d)
    tokens = F.concat(F.array(F.array(*[F.lit(7.0)] * 4)), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda p: F.slice("vec", p * 4 + 1, F.lit(4))))
    got = cache.pooled_patches(v.select(F.col("image_id").alias("hash"), tokens.alias("tokens")), 4, skip=1)
    six = lambda c: F.transform(c, lambda p: F.transform(p, lambda x: F.round(x, 6)))
    return got.select("hash", six("full").alias("full_"), six("pooled").alias("pooled"))
