"""Plans for renaming and for folders: what is moved where. Nothing here touches files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions import text
from tessel.operators.ordering import first_positions

TEMP_PREFIX = ".tmp_rename_"


def _once(rows: DataFrame, key: str) -> DataFrame:
    """The rows; an error if a name stands twice."""
    w = Window.partitionBy(key)
    twice = F.count("*").over(w) > 1
    return rows.withColumn(key, F.when(twice, F.raise_error(F.concat(F.lit("duplicate name in order: "), F.col(key)))).otherwise(F.col(key)))


def rename_plan(order: DataFrame) -> DataFrame:
    """(from, to, pos): order (filename, pos) to numbered names that keep their titles."""
    total = order.agg(F.count("*").alias("__n"))
    rows = _once(order, "filename").join(F.broadcast(total))
    return rows.select(F.col("filename").alias("from"), text.numbered_name(F.col("pos") + 1, F.col("__n"), F.col("filename")).alias("to"), "pos")


def organize_plan(members: DataFrame, images: DataFrame, numbered: bool = True) -> DataFrame:
    """(folder, from, to): a folder for each group in the order of first items, its files numbered."""
    order = first_positions(members, images)
    count = order.agg(F.count("*").alias("__g"))
    order = order.withColumn("__o", F.row_number().over(Window.orderBy(F.col("first").isNull(), "first", "group_pos"))).join(F.broadcast(count))
    n = F.count("*").over(Window.partitionBy("group_id"))
    rows = members.withColumn("__n", n).join(order.select("group_id", "__o", "__g"), "group_id")
    folder = F.concat(text.padded(F.col("__o"), F.col("__g")), F.lit(" - "), "name") if numbered else F.col("name")
    return rows.select(folder.alias("folder"), F.col("filename").alias("from"), text.numbered_name(F.col("member_pos") + 1, F.col("__n"), F.col("filename")).alias("to"))


def folder_save_plan(folders: DataFrame, root: DataFrame, numbered: bool = True) -> DataFrame:
    """(from, to): folders (title, folder_pos, path, pos), root (path, pos); moves that change nothing are left out."""
    count = folders.agg(F.countDistinct("folder_pos").alias("__f"))
    n = F.count("path").over(Window.partitionBy("folder_pos"))
    rows = folders.withColumn("__n", n).where("path IS NOT NULL").join(F.broadcast(count))
    name = F.concat(text.padded(F.col("folder_pos") + 1, F.col("__f")), F.lit(" - "), "title") if numbered else F.col("title")
    moves = rows.select(F.col("path").alias("from"), F.concat(name, F.lit("/"), text.numbered_name(F.col("pos") + 1, F.col("__n"), F.col("path"))).alias("to"))
    total = root.agg(F.count("*").alias("__n"))
    rest = root.join(F.broadcast(total)).select(F.col("path").alias("from"), text.numbered_name(F.col("pos") + 1, F.col("__n"), F.col("path")).alias("to"))
    return moves.unionByName(rest).where(F.col("from") != F.col("to"))


def target_folders(folders: DataFrame, numbered: bool = True) -> DataFrame:
    """(folder) of (title, folder_pos)."""
    one = folders.select("title", "folder_pos").distinct()
    total = one.agg(F.count("*").alias("__f"))
    name = F.concat(text.padded(F.col("folder_pos") + 1, F.col("__f")), F.lit(" - "), "title") if numbered else F.col("title")
    return one.join(F.broadcast(total)).select(name.alias("folder"))


def folder_diff(target: DataFrame, existing: DataFrame) -> DataFrame:
    """(folder, action): what is to be created and what removed."""
    a, b = target.select("folder").distinct(), existing.select("folder").distinct()
    return a.join(b, "folder", "left_anti").withColumn("action", F.lit("create")).unionByName(b.join(a, "folder", "left_anti").withColumn("action", F.lit("remove")))


def misnumbered(folders: DataFrame, numbered: bool) -> DataFrame:
    """(mismatch): whether any folder has a number and shouldn't, or lacks one and should have it."""
    has = F.col("folder").rlike(r"^\d+\s*-\s*")
    return folders.agg(F.coalesce(F.max(has != F.lit(numbered)), F.lit(False)).alias("mismatch"))


def move_images(files: DataFrame, names: DataFrame, target: str | None) -> DataFrame:
    """files (filename, folder, pos): the named ones (filename, ord) come last in the target folder (null: the root). Folders that end up empty have no rows."""
    last = files.where(F.col("folder").eqNullSafe(F.lit(target))).agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("__last"))
    rows = files.join(names, "filename", "left").join(F.broadcast(last))
    go = F.col("ord").isNotNull() & ~F.col("folder").eqNullSafe(F.lit(target))
    return rows.select("filename", F.when(go, F.lit(target)).otherwise(F.col("folder")).alias("folder"), F.when(go, F.col("__last") + 1 + F.col("ord")).otherwise(F.col("pos")).alias("pos"))


def dissolve_folder(files: DataFrame, folder: str) -> DataFrame:
    inside = files.where(F.col("folder") == folder).select("filename", F.col("pos").alias("ord"))
    return move_images(files, inside, None)


def rename_folder(files: DataFrame, folder: str, title: str) -> DataFrame:
    """A new title behind the number the folder has."""
    number = F.regexp_extract("folder", r"^(\d+\s*-\s*)", 1)
    return files.withColumn("folder", F.when(F.col("folder") == folder, F.concat(number, F.lit(title))).otherwise(F.col("folder")))


def undo_plan(mapping: DataFrame) -> DataFrame:
    return mapping.select(F.col("to").alias("from"), F.col("from").alias("to"))


def delete_split(names: DataFrame, existing: DataFrame) -> DataFrame:
    """(filename, outcome): deleted if the name is harmless and there, refused if it isn't harmless, else missing."""
    here = existing.select("filename", F.lit(True).alias("__here"))
    rows = names.select("filename").distinct().join(here, "filename", "left")
    return rows.select("filename", F.when(~text.deletable(F.col("filename")), "refused").when(F.col("__here"), "deleted").otherwise("missing").alias("outcome"))


def recovery_status(manifest: DataFrame, names: DataFrame) -> DataFrame:
    """(status, to_first, to_second): what an interrupted two-phase renaming needs. manifest (batch_id, from, to), names (filename) on disk.

    none: nothing is left of it; completed: it is over or can be finished (so many first steps and second steps are open); orphaned: temporary files without a manifest, or a manifest whose temporary files and targets are both missing."""
    temps = names.where(F.col("filename").startswith(TEMP_PREFIX))
    temp = F.concat(F.lit(TEMP_PREFIX), "batch_id", F.lit("_"), "to")
    rows = manifest.withColumn("temp", temp)
    there = lambda c, n: rows.join(names.select(F.col("filename").alias(c)), c, "left_semi").agg(F.count("*").alias(n))
    sums = there("temp", "t").join(there("to", "done")).join(rows.agg(F.count("*").alias("n"))).join(temps.agg(F.count("*").alias("temps")))
    first = rows.join(names.select(F.col("filename").alias("temp")), "temp", "left_anti").join(names.select(F.col("filename").alias("from")), "from", "left_semi").agg(F.count("*").alias("open"))
    status = F.when((F.col("n") == 0) & (F.col("temps") == 0), "none").when(F.col("n") == 0, "orphaned").when((F.col("t") == 0) & (F.col("done") < F.col("n")), "orphaned").otherwise("completed")
    going = (F.col("n") > 0) & (F.col("t") > 0)
    return sums.join(first).select(status.alias("status"), F.when(going, F.col("open")).otherwise(0).cast("long").alias("to_first"), F.when(going, F.col("t") + F.col("open")).otherwise(0).cast("long").alias("to_second"))


def listing(paths: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    """(filename, pos) of the images among (filename), in natural order."""
    from tessel.operators.positions import with_positions

    rows = paths.where(text.is_image(F.col("filename"), extensions)).select("filename")
    return with_positions(rows, text.natural_key(F.col("filename")), "filename")


def extract_listing(paths: DataFrame) -> DataFrame:
    """(filename, pos) of what extraction reads, in code-point order."""
    from tessel.operators.positions import with_positions

    return with_positions(paths.where(text.is_image(F.col("filename"), text.EXTRACT_EXTENSIONS)).select("filename"), "filename")


def folder_data(paths: DataFrame) -> DataFrame:
    """paths (path) one level deep to (folder, images) in natural order; the root's folder is null; hidden folders are left out."""
    folder = F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1))
    rows = paths.select(folder.alias("folder"), text.base_name(F.col("path")).alias("filename")).where(text.is_image(F.col("filename")) & ~F.coalesce(F.col("folder").startswith("."), F.lit(False)))
    got = rows.groupBy("folder").agg(F.sort_array(F.collect_list(F.struct(text.natural_key(F.col("filename")).alias("k"), "filename"))).alias("m"))
    return got.select("folder", F.transform("m", lambda x: x["filename"]).alias("images"))


def tags_remap(tags: DataFrame, mapping: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """tags (filename, value) under new names, only of existing files if those are given."""
    from tessel.operators.groups import remap

    got = remap(tags, mapping)
    return got if existing is None else got.join(existing.select("filename"), "filename", "left_semi")


def justified(cells: DataFrame, columns: int, width: int = 2000) -> DataFrame:
    """cells (pos, aspect) to (pos, row, x, y, w, h): rows of so many cells share a height that fills the width; a short last row counts blanks of mean aspect."""
    mean = cells.agg(F.avg("aspect").alias("__mean"))
    rows = cells.join(F.broadcast(mean)).withColumn("row", F.expr(f"pos div {columns}"))
    per = Window.partitionBy("row")
    height = F.round(F.lit(width) / (F.sum("aspect").over(per) + (columns - F.count("*").over(per)) * F.col("__mean"))).cast("long")
    rows = rows.withColumn("h", height).withColumn("w", F.round(F.col("h") * F.col("aspect")).cast("long"))
    ends = (F.count("*").over(per) == columns) & (F.col("pos") % columns == columns - 1)  # the last cell of a full row takes what is left
    rows = rows.withColumn("w", F.when(ends, width - (F.sum("w").over(per) - F.col("w"))).otherwise(F.col("w")))
    before: Column = F.coalesce(F.sum("w").over(per.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heights = rows.groupBy("row").agg(F.first("h").alias("__h"))
    top = F.coalesce(F.sum("__h").over(Window.orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("x", before).join(heights.select("row", top.alias("y")), "row").select("pos", "row", "x", "y", "w", "h")


def subfolders(paths: DataFrame) -> DataFrame:
    """(folder, pos) of the folders among (path), hidden ones left out, in natural order."""
    from tessel.operators.positions import with_positions

    rows = paths.where(F.instr("path", "/") > 0).select(F.substring_index("path", "/", 1).alias("folder")).where(~F.col("folder").startswith(".")).distinct()
    return with_positions(rows, text.natural_key(F.col("folder")), "folder")
