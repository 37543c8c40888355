"""Item tables derived from the driver's tables, as DataFrames and as the SQL that the oracles begin with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.functions import vectors as V

QUERY_IDS = [3, 17, 42]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("image_id"), F.concat(F.lpad(F.col("vec_id").cast("string"), 6, "0"), F.lit(".jpg")).alias("filename"), F.col("vec_id").alias("pos"), "label", V.doubles("embedding").alias("vec"))


def models(spark: SparkSession, d: str) -> DataFrame:
    """(image_id, model, vec): full, two unit halves a and b, and color, which isn't normalised."""
    v = images(spark, d)
    parts = F.array(
        F.struct(F.lit("full").alias("model"), F.col("vec").alias("vec")),
        F.struct(F.lit("a").alias("model"), V.unit(F.slice("vec", 1, 32)).alias("vec")),
        F.struct(F.lit("b").alias("model"), V.unit(F.slice("vec", 33, 32)).alias("vec")),
        F.struct(F.lit("color").alias("model"), F.slice("vec", 1, 16).alias("vec")),
    )
    return v.select("image_id", F.explode(parts).alias("p")).select("image_id", "p.model", "p.vec")


def patches(spark: SparkSession, d: str) -> DataFrame:
    """(image_id, patches): 8 unit slices of 8."""
    v = images(spark, d)
    return v.select("image_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda p: V.unit(F.slice("vec", p * 8 + 1, F.lit(8)))).alias("patches"))


def members(spark: SparkSession, d: str) -> DataFrame:
    v = images(spark, d).where("image_id % 5 = 0")
    name = F.concat(F.lit("g"), F.col("label").cast("string"))
    pos = F.row_number().over(Window.partitionBy("label").orderBy("image_id")) - 1
    return v.select(name.alias("group_id"), name.alias("name"), F.col("label").cast("long").alias("group_pos"), "image_id", "filename", pos.cast("long").alias("member_pos"))


def query(spark: SparkSession, ids: list[int] | None = None) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids or QUERY_IDS], "image_id long")


def files(spark: SparkSession, d: str) -> DataFrame:
    """(filename, folder, pos): a numbered name and a folder for every document."""
    t = read(spark, d, "documents")
    return t.select(F.concat(F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit(" - "), "lang", F.lit(".TXT")).alias("filename"), F.col("source").alias("folder"), F.col("doc_id").alias("pos"))


def terms(spark: SparkSession, d: str) -> DataFrame:
    """(term_pos, term, vec): the 40 first part names with the vectors of the 40 first items."""
    names = read(spark, d, "part").select("p_name").distinct().orderBy("p_name").limit(40)
    names = names.select(F.col("p_name").alias("term"), (F.row_number().over(Window.orderBy("p_name")) - 1).cast("long").alias("term_pos"))
    return names.join(images(spark, d).select(F.col("image_id").alias("term_pos"), "vec"), "term_pos").select("term_pos", "term", "vec")


# --- the same in SQL ---------------------------------------------------------------------------------------------

IMAGES = """images AS (SELECT vec_id AS image_id, lpad(CAST(vec_id AS VARCHAR), 6, '0') || '.jpg' AS filename, vec_id AS pos, label,
  list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings)"""


def _unit(v: str) -> str:
    return f"list_transform({v}, lambda x: x / greatest(sqrt(list_dot_product({v}, {v})), 1e-10))"


MODELS = f"""models AS (SELECT image_id, 'full' AS model, vec FROM images
  UNION ALL SELECT image_id, 'a', {_unit("vec[1:32]")} FROM images
  UNION ALL SELECT image_id, 'b', {_unit("vec[33:64]")} FROM images
  UNION ALL SELECT image_id, 'color', vec[1:16] FROM images)"""
PATCHES = f"""patches AS (SELECT image_id, p AS patch_idx, {_unit("vec[p * 8 + 1:p * 8 + 8]")} AS vec FROM images, range(8) AS r(p))"""
MEMBERS = """members AS (SELECT 'g' || label AS group_id, 'g' || label AS name, CAST(label AS BIGINT) AS group_pos, image_id, filename,
  row_number() OVER (PARTITION BY label ORDER BY image_id) - 1 AS member_pos FROM images WHERE image_id % 5 = 0)"""
QUERY = f"query AS (SELECT unnest([{', '.join(map(str, QUERY_IDS))}]) AS image_id)"
FILES = """files AS (SELECT lpad(CAST(doc_id AS VARCHAR), 6, '0') || ' - ' || lang || '.TXT' AS filename, source AS folder, doc_id AS pos FROM documents)"""
TERMS = """terms AS (SELECT t.term_pos, t.term, i.vec FROM (SELECT p_name AS term, row_number() OVER (ORDER BY p_name) - 1 AS term_pos
  FROM (SELECT DISTINCT p_name FROM part) ORDER BY p_name LIMIT 40) t JOIN images i ON i.image_id = t.term_pos)"""


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"
