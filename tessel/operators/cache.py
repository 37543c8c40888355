"""The embedding cache: rows keyed by content hash, model and version.

files: filename, hash. cache: hash, model, version, vec."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.functions import text
from tessel.functions import vectors as V


def by_filename(files: DataFrame, cache: DataFrame, strict: bool = False) -> DataFrame:
    """(filename, model, vec); files of equal content share a row. ``strict``: a file without a row is an error."""
    if not strict:
        return files.join(cache, "hash").select("filename", "model", "vec")
    rows = files.join(cache, "hash", "left")
    return rows.select(F.when(F.col("model").isNull(), F.raise_error(F.concat(F.lit("no embedding for "), "filename"))).otherwise(F.col("filename")).alias("filename"), "model", "vec")


def new_files(files: DataFrame, cache: DataFrame) -> DataFrame:
    return files.join(cache.select("hash"), "hash", "left_anti")


def outdated(cache: DataFrame, versions: DataFrame) -> DataFrame:
    """(model): models with rows of another version than the current one (model, version)."""
    now = versions.select("model", F.col("version").alias("__now"))
    return cache.join(F.broadcast(now), "model").where(~F.col("version").eqNullSafe(F.col("__now"))).select("model").distinct()


def zero_rows(files: DataFrame, cache: DataFrame) -> DataFrame:
    """(hash, model) of current files whose vector is all zero: not extracted."""
    return cache.join(files.select("hash"), "hash", "left_semi").where(V.is_zero(F.col("vec"))).select("hash", "model")


def missing_patches(files: DataFrame, patches: DataFrame, known_missing: DataFrame | None = None) -> DataFrame:
    """(hash): without patches, or with all-zero ones, beyond those known to be missing anyway. patches: hash, patches."""
    good = patches.where(~F.forall("patches", lambda p: V.is_zero(p))).select("hash")
    got = files.select("hash").distinct().join(good, "hash", "left_anti")
    return got if known_missing is None else got.join(known_missing.select("hash"), "hash", "left_anti")


def to_extract(files: DataFrame, cache: DataFrame, versions: DataFrame, forced: list[str] | None = None, required: list[str] | None = None) -> DataFrame:
    """(hash, model, reason): every model's missing, zero or outdated items; forced models in full; only required models if those are given."""
    models = versions.select("model")
    if required is not None:
        models = models.where(F.col("model").isin(*required))
    wanted = files.select("hash").distinct().join(F.broadcast(models))
    rows = wanted.join(cache.join(F.broadcast(versions.withColumnRenamed("version", "__now")), "model"), ["hash", "model"], "left")
    reason = F.when(F.col("model").isin(*(forced or [""])), "forced").when(F.col("vec").isNull(), "new").when(~F.col("version").eqNullSafe(F.col("__now")), "version").when(V.is_zero(F.col("vec")), "zero")
    return rows.select("hash", "model", reason.alias("reason")).where("reason IS NOT NULL")


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace old ones of the same hash and model."""
    return cache.join(new.select("hash", "model"), ["hash", "model"], "left_anti").select(*cache.columns).unionByName(new.select(*cache.columns))


def prune(cache: DataFrame, files: DataFrame) -> DataFrame:
    return cache.join(files.select("hash"), "hash", "left_semi")


def manifest(files: DataFrame, cache: DataFrame, models: DataFrame) -> DataFrame:
    """(model, total, cached, missing): counts of distinct contents."""
    total = files.select("hash").distinct()
    have = prune(cache, files).where(~V.is_zero(F.col("vec"))).groupBy("model").agg(F.countDistinct("hash").alias("cached"))
    rows = models.select("model").join(F.broadcast(total.agg(F.count("*").alias("total")))).join(have, "model", "left")
    cached = F.coalesce("cached", F.lit(0)).cast("long")
    return rows.select("model", "total", cached.alias("cached"), (F.col("total") - cached).alias("missing"))


def pooled_patches(tokens: DataFrame, grid: int, skip: int = 5) -> DataFrame:
    """hidden (hash, tokens): past the first ``skip`` tokens a grid of patches; (hash, full, pooled): unit patches, and unit 2 x 2 means of the raw ones."""
    patch = F.slice("tokens", skip + 1, grid * grid)
    half = grid // 2

    def mean(i):
        row, col = F.floor(i / half).cast("int") * 2, (i % half) * 2
        at = [F.get(F.col("__p"), (row + r) * grid + col + c) for r in (0, 1) for c in (0, 1)]
        both = F.zip_with(F.zip_with(at[0], at[1], lambda x, y: x + y), F.zip_with(at[2], at[3], lambda x, y: x + y), lambda x, y: (x + y) / 4)
        return V.unit(both)

    rows = tokens.withColumn("__p", patch)
    return rows.select("hash", F.transform("__p", lambda p: V.unit(p)).alias("full"), F.transform(F.sequence(F.lit(0), F.lit(half * half - 1)), mean).alias("pooled"))


def orphan_thumbnails(files: DataFrame, cached: DataFrame) -> DataFrame:
    """(name) of cached thumbnails (name) that belong to no file (inode, size) as it is now; what isn't a thumbnail isn't touched."""
    keys = files.select(text.thumbnail_key(F.col("inode"), F.col("size")).alias("name"))
    return cached.select("name").where(F.col("name").endswith(".webp")).join(keys, "name", "left_anti")
