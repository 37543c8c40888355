"""Ordered lists: (filename, pos) in, (filename, pos) out, positions from 0 without gaps.

members: group_id, group_pos, filename, member_pos. Where a list is small it may be a Python list of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions import text
from tessel.operators.positions import with_positions

GROUP_TOKEN = "group:"


def _names(like: DataFrame, names: DataFrame | list[str]) -> DataFrame:
    """(filename, ord)."""
    if isinstance(names, list):
        return like.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], "filename string, ord long")
    return names if "ord" in names.columns else names.withColumn("ord", F.col("pos")) if "pos" in names.columns else names.withColumn("ord", F.lit(0))


def _flagged(items: DataFrame, names: DataFrame | list[str]) -> DataFrame:
    chosen = _names(items, names).select("filename").distinct().withColumn("chosen", F.lit(True))
    return items.join(chosen, "filename", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))


def _place(items: DataFrame, name: str) -> int:
    row = items.where(F.col("filename") == name).agg(F.min("pos")).first()
    return -1 if row[0] is None else row[0]


def multi_drag(items: DataFrame, selected: DataFrame | list[str], active: str, over: str) -> DataFrame:
    """The selected block moves to the item it is dropped on: behind it when it moves down, before it when it moves up.

    Dropped on one of its own, the block goes to the front (down) or before the last of the others (up)."""
    rows = _flagged(items, selected)
    start, target = _place(items, active), _place(items, over)
    down = start < target
    over_chosen = target < 0 or rows.where((F.col("filename") == over) & F.col("chosen")).limit(1).count() > 0
    if not over_chosen:
        before = F.col("pos") <= target if down else F.col("pos") < target
    elif down:
        before = F.lit(False)
    else:
        last = rows.where(~F.col("chosen")).agg(F.max("pos")).first()[0]
        before = F.col("pos") < F.lit(-1 if last is None else last)
    block = F.when(F.col("chosen"), 1).when(before, 0).otherwise(2)
    return with_positions(rows, block, "pos").select("filename", "pos")


def array_move(items: DataFrame, source: int, target: int) -> DataFrame:
    """One item from one place to another, as if taken out and put in again."""
    p = F.col("pos")
    moved = F.when(p == source, F.lit(float(target))).when((p > source) & (p <= target), p - 1.0).when((p < source) & (p >= target), p + 1.0).otherwise(p.cast("double"))
    return items.select("filename", moved.cast("long").alias("pos"))


def flatten_order(tokens: DataFrame, members: DataFrame, images: DataFrame) -> DataFrame:
    """tokens (token, pos): names, or group tokens that stand for their members; the first place of a name counts, unknown names go."""
    groups = members.select(F.concat(F.lit(GROUP_TOKEN), "group_id").alias("token"), F.col("filename").alias("member"), "member_pos")
    rows = tokens.join(groups, "token", "left").select(F.coalesce("member", "token").alias("filename"), F.struct("pos", F.coalesce("member_pos", F.lit(0)).alias("m")).alias("at"))
    first = rows.groupBy("filename").agg(F.min("at").alias("at")).join(images.select("filename"), "filename", "left_semi")
    return with_positions(first, "at").select("filename", "pos")


def consolidate(images: DataFrame, names: DataFrame | list[str]) -> DataFrame:
    """The named items together where the first of them is."""
    rows = _flagged(images, names)
    first = rows.where("chosen").agg(F.min("pos").alias("first"))
    at = F.when(F.col("chosen"), F.col("first")).otherwise(F.col("pos"))
    return with_positions(rows.join(F.broadcast(first)), at, "pos").select("filename", "pos")


def reposition(images: DataFrame, ordered: DataFrame | list[str]) -> DataFrame:
    """As consolidate, in the order of the names."""
    names = _names(images, ordered).groupBy("filename").agg(F.min("ord").alias("ord"))
    rows = images.join(names, "filename", "left")
    first = rows.where("ord IS NOT NULL").agg(F.min("pos").alias("first"))
    at = F.when(F.col("ord").isNotNull(), F.col("first")).otherwise(F.col("pos"))
    return with_positions(rows.join(F.broadcast(first)), at, F.coalesce("ord", F.lit(0)), "pos").select("filename", "pos")


def grouped_first(images: DataFrame, members: DataFrame) -> DataFrame:
    """Members in group order, then the others in their order; an item in two groups stands twice."""
    own = members.join(images.select("filename"), "filename", "left_semi").select("filename", F.lit(0).alias("k"), F.col("group_pos").alias("a"), F.col("member_pos").alias("b"))
    rest = images.join(members.select("filename"), "filename", "left_anti").select("filename", F.lit(1).alias("k"), F.col("pos").alias("a"), F.lit(0).alias("b"))
    return with_positions(own.unionByName(rest), "k", "a", "b").select("filename", "pos")


def grouped_first_on_disk(disk: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(order, missing): members found on disk, each once, then the rest in natural order; members that aren't there."""
    first = members.groupBy("filename").agg(F.min(F.struct("group_pos", "member_pos")).alias("at"))
    here = first.join(disk.select("filename"), "filename", "left_semi").select("filename", F.lit(0).alias("k"), F.col("at.group_pos").alias("a"), F.col("at.member_pos").alias("b"), F.lit("").alias("key"))
    rest = disk.join(first.select("filename"), "filename", "left_anti").select("filename", F.lit(1).alias("k"), F.lit(0).alias("a"), F.lit(0).alias("b"), text.natural_key(F.col("filename")).alias("key"))
    order = with_positions(here.unionByName(rest), "k", "a", "b", "key", "filename").select("filename", "pos", (F.col("k") == 0).alias("grouped"))
    return order, members.join(disk.select("filename"), "filename", "left_anti").select("group_id", "filename")


def grid_items(images: DataFrame, members: DataFrame, expanded: str | None = None, enabled: bool = True) -> DataFrame:
    """(type, group_id, filename, pos): a group stands where its first item does, its members follow if it is expanded, other items stand for themselves."""
    if not enabled:
        return images.select(F.lit("image").alias("type"), F.lit(None).cast("string").alias("group_id"), "filename", "pos")
    owner = members.groupBy("filename").agg(F.max_by("group_id", "group_pos").alias("group_id"))
    rows = images.join(owner, "filename", "left")
    single = rows.where("group_id IS NULL").select(F.lit("image").alias("type"), "group_id", "filename", F.col("pos").alias("a"), F.lit(-1).cast("long").alias("b"))
    heads = rows.where("group_id IS NOT NULL").groupBy("group_id").agg(F.min("pos").alias("a"))
    shown = heads.select(F.lit("group").alias("type"), "group_id", F.lit(None).cast("string").alias("filename"), "a", F.lit(-1).cast("long").alias("b"))
    out = single.unionByName(shown)
    if expanded is not None:
        inner = members.where(F.col("group_id") == expanded).join(heads, "group_id")
        out = out.unionByName(inner.select(F.lit("group-image").alias("type"), "group_id", "filename", "a", F.col("member_pos").cast("long").alias("b")))
    return with_positions(out, "a", "b").select("type", "group_id", "filename", "pos")


def folder_items(images: DataFrame, folders: DataFrame, expanded: str | None = None) -> DataFrame:
    """(type, folder, filename, pos): folders in order, the expanded one's items behind it, then items in no folder. folders: folder, folder_pos, filename, pos (filename null for an empty folder)."""
    heads = folders.groupBy("folder").agg(F.min("folder_pos").alias("a")).select(F.lit("folder").alias("type"), "folder", F.lit(None).cast("string").alias("filename"), F.lit(0).alias("k"), "a", F.lit(-1).cast("long").alias("b"))
    inner = folders.where((F.col("folder") == F.lit(expanded)) & F.col("filename").isNotNull()).select(F.lit("folder-image").alias("type"), "folder", "filename", F.lit(0).alias("k"), F.col("folder_pos").alias("a"), F.col("pos").cast("long").alias("b"))
    rest = images.join(folders.select("filename"), "filename", "left_anti").select(F.lit("image").alias("type"), F.lit(None).cast("string").alias("folder"), "filename", F.lit(1).alias("k"), F.col("pos").alias("a"), F.lit(0).cast("long").alias("b"))
    return with_positions(heads.unionByName(inner).unionByName(rest), "k", "a", "b").select("type", "folder", "filename", "pos")


def visible(items: DataFrame) -> DataFrame:
    """Grid items without the children of what is expanded."""
    return items.where(~F.col("type").isin("group-image", "folder-image"))


def insert_in_group(members: DataFrame, group_id: str, name: str, over: str, moving_down: bool) -> DataFrame:
    """An item from outside dropped on a member: behind it when it came from above; it leaves every other group."""
    own = members.where((F.col("group_id") == group_id) & (F.col("filename") != name))
    meta = own.limit(1)
    at = _place(own.withColumn("pos", F.col("member_pos")), over)
    put = meta.withColumn("filename", F.lit(name)).withColumn("member_pos", F.lit(at).cast(members.schema["member_pos"].dataType)).withColumn("__k", F.lit(1 if moving_down else -1))
    rows = with_positions(own.withColumn("__k", F.lit(0)).unionByName(put), "member_pos", "__k", name="__p").drop("__k", "member_pos").withColumnRenamed("__p", "member_pos")
    return rows.select(*members.columns).unionByName(members.where((F.col("group_id") != group_id) & (F.col("filename") != name)))


def drag_out(images: DataFrame, members: DataFrame, group_id: str, removed: list[str], tokens: DataFrame, active: str, over: str) -> tuple[DataFrame, DataFrame]:
    """(members, images): the removed items leave their group and go where they are dropped in the grid's tokens; groups without members go."""
    left = members.where(~((F.col("group_id") == group_id) & F.col("filename").isin(*removed)))
    grid = tokens.select(F.col("token").alias("filename"), "pos")
    moved = multi_drag(grid, removed, active, over) if len(removed) > 1 else array_move(grid, _place(grid, active), _place(grid, over))
    return left, flatten_order(moved.select(F.col("filename").alias("token"), "pos"), left, images)


def after_last_member(images: DataFrame, members: DataFrame, group_id: str, names: DataFrame | list[str]) -> DataFrame:
    """The named items behind the last other member of the group; the list stays as it is if there is none."""
    rows = _flagged(images, names)
    own = members.where(F.col("group_id") == group_id).select("filename")
    last = rows.where(~F.col("chosen")).join(own, "filename", "left_semi").agg(F.max("pos").alias("last"))
    at = F.when(F.col("chosen") & F.col("last").isNotNull(), F.col("last")).otherwise(F.col("pos"))
    return with_positions(rows.join(F.broadcast(last)), at, F.col("chosen"), "pos").select("filename", "pos")


def first_positions(members: DataFrame, images: DataFrame) -> DataFrame:
    """(group_id, first): the least place of a member, null if none is in the list."""
    rows = members.join(images.select("filename", "pos"), "filename", "left")
    return rows.groupBy("group_id", "group_pos").agg(F.min("pos").alias("first"))


def groups_by_gallery(members: DataFrame, images: DataFrame) -> DataFrame:
    """Groups in the order of their first items; groups without items last, in their order."""
    got = first_positions(members, images)
    return with_positions(got, F.col("first").isNull(), F.coalesce("first", F.lit(0)), "group_pos").select("group_id", "pos")


def review_order(groups: DataFrame) -> DataFrame:
    """groups: group_id, group_pos, status, sub_status. Keep, maybe, delete; within them top, middle, bottom; unset ones count as maybe and middle."""

    def rank(c: str, names: list[str], default: int) -> Column:
        out = F.lit(default)
        for i, n in enumerate(names):
            out = F.when(F.col(c) == n, i).otherwise(out)
        return out

    return with_positions(groups, rank("status", ["keep", "maybe", "delete"], 1), rank("sub_status", ["top", "middle", "bottom"], 1), "group_pos").select("group_id", "pos")


def chunks(items: DataFrame, size: int) -> DataFrame:
    return items.withColumn("chunk", F.expr(f"pos div {size}"))


def even_sample(items: DataFrame, k: int) -> DataFrame:
    """Of n items those at floor(i * n / k), i below k; all if there are no more."""
    n = items.agg(F.count("*").alias("__n"))
    step = F.ceil(F.col("pos") * k / F.col("__n"))
    kept = items.join(F.broadcast(n)).where((F.col("__n") <= k) | ((step < k) & (F.floor(step * F.col("__n") / k) == F.col("pos"))))
    return kept.drop("__n")


def range_select(items: DataFrame, a: int, b: int) -> DataFrame:
    return items.where(F.col("pos").between(min(a, b), max(a, b)))


def has_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(changed): whether any place differs."""
    a, b = before.select("pos", F.col("filename").alias("x")), after.select("pos", F.col("filename").alias("y"))
    return a.join(b, "pos", "full").agg(F.coalesce(F.max(~F.col("x").eqNullSafe(F.col("y"))), F.lit(False)).alias("changed"))


def thumb_samples(members: DataFrame) -> DataFrame:
    """(group_id, samples): all of up to 4 items, else the first, those at a third and two thirds, and the last."""
    got = members.groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("member_pos", "filename"))).alias("m"))
    names, n = F.transform("m", lambda x: x["filename"]), F.size("m")
    return got.select("group_id", F.when(n <= 4, names).otherwise(F.array(names[0], F.get(names, F.floor(n / 3).cast("int")), F.get(names, F.floor(n * 2 / 3).cast("int")), F.get(names, n - 1))).alias("samples"))


def shuffled(items: DataFrame, first: str, seed: int) -> DataFrame:
    """A random order in which one item stays first."""
    return with_positions(items, F.col("filename") != first, F.xxhash64(F.lit(seed), F.col("filename")), "pos").select("filename", "pos")
