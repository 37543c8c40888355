"""Groups as sets: members(group_id, name, group_pos, filename, member_pos). Clusters: clusters(cluster_id, cluster_pos, filename, confirmed, split_from)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions import text
from tessel.operators.positions import with_positions


def _dense(members: DataFrame) -> DataFrame:
    """Member positions without gaps."""
    w = Window.partitionBy("group_id").orderBy("member_pos")
    return members.withColumn("member_pos", (F.row_number().over(w) - 1).cast("long"))


def remap(rows: DataFrame, mapping: DataFrame, key: str = "filename") -> DataFrame:
    """Names after a renaming (from, to); others stay."""
    m = mapping.select(F.col("from").alias("__from"), F.col("to").alias("__to"))
    return rows.join(m, F.col(key) == F.col("__from"), "left").withColumn(key, F.coalesce("__to", key)).drop("__from", "__to")


def mapping_of(old: DataFrame, new: DataFrame) -> DataFrame:
    """(from, to) of the places whose name changed."""
    return old.select("pos", F.col("filename").alias("from")).join(new.select("pos", F.col("filename").alias("to")), "pos").where(F.col("from") != F.col("to")).select("from", "to")


def prune(members: DataFrame, existing: DataFrame) -> DataFrame:
    """Members that are still there; a group without any is gone."""
    return _dense(members.join(existing.select("filename"), "filename", "left_semi"))


def prune_deleted(members: DataFrame, deleted: DataFrame) -> DataFrame:
    return _dense(members.join(deleted.select("filename"), "filename", "left_anti"))


def disjoint(members: DataFrame) -> DataFrame:
    """Each item in the last of its groups only, once."""
    w = Window.partitionBy("filename").orderBy(F.desc("group_pos"), "member_pos")
    return _dense(members.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r"))


def scope_members(members: DataFrame, group_ids: list[str], hashed: DataFrame) -> DataFrame:
    """(filename): the groups' members that have embeddings, each once; an unknown group is an error."""
    known = {r.group_id for r in members.where(F.col("group_id").isin(*group_ids)).select("group_id").distinct().collect()}
    if missing := sorted(set(group_ids) - known):
        raise ValueError(f"unknown groups: {', '.join(missing)}")
    return members.where(F.col("group_id").isin(*group_ids)).select("filename").distinct().join(hashed.select("filename"), "filename", "left_semi")


def scope_keys(scopes: DataFrame) -> DataFrame:
    """scopes (scope_id, group_id) to (scope_id, scope_key)."""
    return scopes.groupBy("scope_id").agg(F.collect_set("group_id").alias("ids")).select("scope_id", text.scope_key(F.col("ids")).alias("scope_key"))


def merge_groups(members: DataFrame, pending: DataFrame) -> DataFrame:
    """pending (ref, candidate, ord): candidates' items that the reference lacks come behind its own, in order; the candidates go. Unknown groups are ignored."""
    ids = members.select("group_id").distinct()
    pend = pending.join(ids.withColumnRenamed("group_id", "ref"), "ref", "left_semi").join(ids.withColumnRenamed("group_id", "candidate"), "candidate", "left_semi")
    meta = members.groupBy("group_id").agg(F.first("name").alias("name"), F.first("group_pos").alias("group_pos"))
    added = pend.join(members.select(F.col("group_id").alias("candidate"), "filename", "member_pos"), "candidate")
    added = added.select(F.col("ref").alias("group_id"), "filename", F.struct(F.col("ord").cast("long").alias("o"), F.col("member_pos").cast("long").alias("m")).alias("at"))
    own = members.select("group_id", "filename", F.struct(F.lit(-1).cast("long").alias("o"), F.col("member_pos").cast("long").alias("m")).alias("at"))
    rows = own.unionByName(added).groupBy("group_id", "filename").agg(F.min("at").alias("at"))
    rows = rows.join(pend.select(F.col("candidate").alias("group_id")), "group_id", "left_anti").join(meta, "group_id")
    w = Window.partitionBy("group_id").orderBy("at")
    return rows.select("group_id", "name", "group_pos", "filename", (F.row_number().over(w) - 1).cast("long").alias("member_pos"))


def add_to_group(members: DataFrame, group_id: str, names: DataFrame, move: bool = True) -> DataFrame:
    """names (filename, ord) come behind the group's items. ``move``: they leave every group first; else the ones already there are skipped and other groups keep theirs."""
    meta = members.where(F.col("group_id") == group_id).groupBy("group_id").agg(F.first("name").alias("name"), F.first("group_pos").alias("group_pos"))
    if move:
        kept, new = members.join(names.select("filename"), "filename", "left_anti"), names
    else:
        own = members.where(F.col("group_id") == group_id).select("filename")
        kept, new = members, names.join(own, "filename", "left_anti")
    new = new.groupBy("filename").agg(F.min("ord").alias("ord")).join(F.broadcast(meta))
    cols = ["group_id", "name", "group_pos", "filename", "at"]
    rows = kept.withColumn("at", F.struct(F.lit(0).alias("k"), F.col("member_pos").cast("long").alias("m"))).select(*cols)
    rows = rows.unionByName(new.withColumn("at", F.struct(F.lit(1).alias("k"), F.col("ord").cast("long").alias("m"))).select(*cols))
    w = Window.partitionBy("group_id").orderBy("at")
    return rows.withColumn("member_pos", (F.row_number().over(w) - 1).cast("long")).drop("at")


def remove_from_group(members: DataFrame, group_id: str, names: DataFrame) -> DataFrame:
    gone = names.select("filename", F.lit(group_id).alias("group_id"))
    return _dense(members.join(gone, ["group_id", "filename"], "left_anti"))


def delete_group(members: DataFrame, group_id: str) -> DataFrame:
    return members.where(F.col("group_id") != group_id)


def rename_group(members: DataFrame, group_id: str, name: str) -> DataFrame:
    return members.withColumn("name", F.when(F.col("group_id") == group_id, F.lit(name)).otherwise(F.col("name")))


def create_group(members: DataFrame, group_id: str, name: str, names: DataFrame) -> DataFrame:
    """A new last group; its items leave the groups they were in."""
    last = members.agg(F.coalesce(F.max("group_pos"), F.lit(-1)).alias("p"))
    w = Window.orderBy("ord")
    new = names.join(F.broadcast(last)).select(F.lit(group_id).alias("group_id"), F.lit(name).alias("name"), (F.col("p") + 1).alias("group_pos"), "filename", (F.row_number().over(w) - 1).cast("long").alias("member_pos"))
    return _dense(members.join(names.select("filename"), "filename", "left_anti")).select(*new.columns).unionByName(new)


# --- clusters ----------------------------------------------------------------------------------------------------


def from_labels(labels: DataFrame, members: DataFrame | None = None, min_group_size: int = 1) -> DataFrame:
    """(cluster_id, label, size, images, confirmed_group): labels (filename, pos, label); largest first, then by label; ids count from 0 after the sort.

    The confirmed group is that of the first item in order that is in a group."""
    rows = labels
    if members is not None:
        size = members.groupBy("group_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_group_size)
        own = members.join(size, "group_id", "left_semi").groupBy("filename").agg(F.max_by("group_id", "group_pos").alias("g"))
        rows = rows.join(own, "filename", "left")
    else:
        rows = rows.withColumn("g", F.lit(None).cast("string"))
    got = rows.groupBy("label").agg(F.count("*").alias("size"), F.sort_array(F.collect_list(F.struct("pos", "filename"))).alias("m"), F.min_by("g", F.when(F.col("g").isNotNull(), F.col("pos"))).alias("confirmed_group"))
    got = with_positions(got, -F.col("size"), "label", name="cluster_id")
    return got.select("cluster_id", "label", "size", F.transform("m", lambda x: x["filename"]).alias("images"), "confirmed_group")


def merge_clusters(clusters: DataFrame, ids: list) -> DataFrame:
    """clusters (cluster_id, pos, images, confirmed_group): the selected ones' images join the largest that has a confirmed group, or else the largest; sorted, each once. Fewer than two selected: nothing happens."""
    chosen = clusters.where(F.col("cluster_id").isin(*ids))
    order = F.struct(F.col("confirmed_group").isNull(), -F.size("images"), "pos")
    # a row of two numbers is all that is broadcast; the images go to their cluster by its id
    pick = chosen.agg(F.min_by("cluster_id", order).alias("__t"), F.count("*").alias("__n")).where("__n >= 2")
    names = chosen.select(F.explode("images").alias("image")).distinct().agg(F.array_sort(F.collect_list("image")).alias("__images"))
    merged = pick.join(names).select(F.col("__t").alias("cluster_id"), "__images")
    rows = clusters.join(F.broadcast(pick), how="left").join(merged, "cluster_id", "left")
    rows = rows.withColumn("images", F.coalesce("__images", "images"))
    return rows.where(F.col("__t").isNull() | ~F.col("cluster_id").isin(*ids) | (F.col("cluster_id") == F.col("__t"))).select(*clusters.columns)


def split_clusters(clusters: DataFrame, selected: DataFrame) -> DataFrame:
    """selected (cluster_id, filename): the selected images leave their cluster and form a new one behind it (cluster_id of the source, split true); if all are selected nothing happens."""
    take = selected.groupBy("cluster_id").agg(F.array_sort(F.collect_set("filename")).alias("take"))
    rows = clusters.join(take, "cluster_id", "left").withColumn("take", F.when(F.size("take") < F.size("images"), F.array_intersect("take", "images")))
    rows = rows.withColumn("take", F.when(F.size("take") > 0, F.col("take")))
    stay = rows.select("cluster_id", "pos", F.lit(False).alias("split"), F.when(F.col("take").isNotNull(), F.array_except("images", "take")).otherwise(F.col("images")).alias("images"))
    new = rows.where("take IS NOT NULL").select("cluster_id", "pos", F.lit(True).alias("split"), F.col("take").alias("images"))
    return stay.unionByName(new)


def suggested(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster_id, suggested): images of a cluster with a confirmed group that the group doesn't have."""
    own = members.groupBy(F.col("group_id").alias("confirmed_group")).agg(F.collect_set("filename").alias("own"))
    got = clusters.where("confirmed_group IS NOT NULL").join(own, "confirmed_group", "left")
    return got.select("cluster_id", F.array_except("images", F.coalesce("own", F.array().cast("array<string>"))).alias("suggested"))


def acceptable(clusters: DataFrame, min_size: int) -> DataFrame:
    return clusters.where(F.col("confirmed_group").isNull() & (F.size("images") >= min_size))


def accept_clusters(clusters: DataFrame, members: DataFrame, min_size: int) -> DataFrame:
    """Members with each acceptable cluster as a new group behind the others ('cluster-' and its id), its images taken out of other groups."""
    w = Window.orderBy("pos")
    new = acceptable(clusters, min_size).withColumn("__n", F.row_number().over(w))
    last = members.agg(F.coalesce(F.max("group_pos"), F.lit(-1)).alias("__p"))
    rows = new.join(F.broadcast(last)).select(F.concat(F.lit("cluster-"), F.col("cluster_id").cast("string")).alias("group_id"), F.col("auto_name").alias("name"), (F.col("__p") + F.col("__n")).alias("group_pos"), F.posexplode("images").alias("member_pos", "filename"))
    kept = _dense(members.join(rows.select("filename"), "filename", "left_anti"))
    cols = ["group_id", "name", "group_pos", "filename", "member_pos"]
    return kept.select(*cols).unionByName(rows.withColumn("member_pos", F.col("member_pos").cast("long")).select(*cols))


def confirmed_first(clusters: DataFrame) -> DataFrame:
    """(cluster_id, pos): clusters with a confirmed group first; a cluster split from an earlier one stands in its section, and so do those split from it.

    The cluster that a chain of splits comes from is found by pointers that double: as many joins as the logarithm of the longest chain."""
    at = clusters.select(F.col("cluster_id").alias("split_from"), F.col("pos").alias("before"))
    rows = clusters.select("cluster_id", "pos", "split_from", F.col("confirmed_group").isNotNull().alias("first")).join(at, "split_from", "left")
    rows = rows.select("cluster_id", "pos", "first", F.when(~F.col("first") & (F.col("before") < F.col("pos")), F.col("split_from")).alias("up"))
    while rows.where("up IS NOT NULL").limit(1).count():
        over = rows.select(F.col("cluster_id").alias("up"), F.col("first").alias("also"), F.col("up").alias("further"))
        rows = rows.join(over, "up", "left").select("cluster_id", "pos", (F.col("first") | F.coalesce("also", F.lit(False))).alias("first"), F.when(~F.coalesce("also", F.lit(False)), F.col("further")).alias("up"))
    return with_positions(rows.select("cluster_id", (~F.col("first")).alias("late"), F.col("pos").alias("was")), "late", "was").select("cluster_id", "pos")


def distinct_names(keys: DataFrame) -> DataFrame:
    """Composite selection keys 'cluster:filename' (key, pos) to (filename, pos), each name at its first place."""
    name = F.expr("substring(key, instr(key, ':') + 1)")
    return keys.select(name.alias("filename"), "pos").groupBy("filename").agg(F.min("pos").alias("pos"))


def insert_picks(clusters: DataFrame, cluster_id: str, name: str, picks: DataFrame) -> DataFrame:
    """A new first cluster of picked names (filename, ord), each once."""
    first = picks.groupBy("filename").agg(F.min("ord").alias("ord")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "filename"))), lambda x: x["filename"]).alias("images"))
    new = first.select(F.lit(cluster_id).alias("cluster_id"), F.lit(0).cast("long").alias("pos"), F.lit(name).alias("auto_name"), "images")
    return clusters.select(F.col("cluster_id").cast("string"), (F.col("pos") + 1).alias("pos"), "auto_name", "images").unionByName(new)


def marks(trash: DataFrame, names: DataFrame, action: str) -> DataFrame:
    """(filename): marked, unmarked, toggled or pruned to existing names."""
    t, n = trash.select("filename").distinct(), names.select("filename").distinct()
    if action == "mark":
        return t.union(n).distinct()
    if action == "unmark":
        return t.join(n, "filename", "left_anti")
    if action == "toggle":
        return t.join(n, "filename", "left_anti").union(n.join(t, "filename", "left_anti"))
    if action == "prune":
        return t.join(n, "filename", "left_semi")
    raise ValueError(action)


def selection_total(members: DataFrame, group_ids: list[str]) -> DataFrame:
    """(groups, images): how many groups and images a selection has."""
    rows = members.where(F.col("group_id").isin(*group_ids))
    return rows.agg(F.countDistinct("group_id").alias("groups"), F.count("*").alias("images"))


def pending_total(pending: DataFrame) -> DataFrame:
    """(pending): how many candidates wait to be merged."""
    return pending.agg(F.count("*").alias("pending"))
