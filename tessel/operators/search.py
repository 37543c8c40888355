"""Search over items, clusters and suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.functions import text


def items(grid: DataFrame, groups: DataFrame, query: str) -> DataFrame:
    """Grid items (images by name, groups by their names) that contain the query; folders never match. grid: type, group_id, filename, pos."""
    names = groups.select("group_id", F.col("name").alias("__name")).distinct()
    rows = grid.join(names, "group_id", "left")
    hit = (F.col("type").isin("image", "folder-image", "group-image") & text.contains_text(F.col("filename"), query)) | ((F.col("type") == "group") & text.contains_text(F.col("__name"), query))
    return rows.where(hit).select(*grid.columns)


def clusters(rows: DataFrame, query: str) -> DataFrame:
    """Clusters whose name or group's name, or else any image, contains the trimmed query. rows: cluster_id, auto_name, group_name, images."""
    q = query.strip()
    any_image = F.exists("images", lambda x: text.contains_text(x, q)) if q else F.lit(False)
    hit = text.contains_text(F.col("auto_name"), q) | F.coalesce(text.contains_text(F.col("group_name"), q), F.lit(False)) | any_image
    return rows.where(hit) if q else rows.limit(0)


def suggestions(rows: DataFrame, query: str) -> DataFrame:
    """Suggestion rows whose own name or any similar name contains the query. rows: ref_group, ref_name, similar_names."""
    q = query.strip()
    return rows.where(text.contains_text(F.col("ref_name"), q) | F.exists("similar_names", lambda x: text.contains_text(x, q))) if q else rows.limit(0)


def groups_fuzzy(groups: DataFrame, query: str) -> DataFrame:
    return groups.where(text.fuzzy(F.col("name"), query))


def groups_named(groups: DataFrame, query: str) -> DataFrame:
    """Groups whose names contain the query; a blank one shows all."""
    return groups.where(text.contains_text(F.col("name"), query.strip())) if query.strip() else groups
