"""Files as tables: contents and their hashes, group lists, vocabularies. Array, linkage and distance files are in arrays.

Listings, lists and vocabularies are read by Spark (binaryFile, json, text), so any store that Spark reads will do; only the beginnings of files
are read through pyarrow's file systems, since Spark reads files whole."""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions import text
from tessel.sources.arrays import opened

#: Bytes of a file that its hash covers, and the hash's size.
HASHED_BYTES, HASH_SIZE = 16384, 16
GROUPS_SCHEMA = "id string, name string, images array<string>"


def contents(spark: SparkSession, folder: str, extensions: list[str] | None = None) -> DataFrame:
    """(filename, length, content) of a folder's images."""
    rows = spark.read.format("binaryFile").load(folder).select(text.base_name(F.col("path")).alias("filename"), "length", "content")
    return rows.where(text.is_image(F.col("filename"), extensions))


def heads(spark: SparkSession, folder: str, extensions: list[str] | None = None) -> DataFrame:
    """(filename, length, content) of a folder's images with only the bytes that a hash covers: Spark lists the folder, tasks read the beginnings."""
    rows = spark.read.format("binaryFile").load(folder).select("path", text.base_name(F.col("path")).alias("filename"), "length")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = []
            for path in pdf.path:
                store, name = opened(path)
                with store.open_input_stream(name) as f:
                    got.append(f.read(HASHED_BYTES))
            yield pdf[["filename", "length"]].assign(content=got)

    listed = rows.where(text.is_image(F.col("filename"), extensions)).repartition(spark.sparkContext.defaultParallelism)
    return listed.mapInPandas(run, "filename string, length long, content binary")


def content_hash(head: bytes, length: int) -> str:
    return hashlib.blake2b(head[:HASHED_BYTES], digest_size=HASH_SIZE, key=struct.pack(">Q", length)).hexdigest()


def content_hashes(files: DataFrame) -> DataFrame:
    """(filename, hash) of (filename, length, content): of the beginning, keyed by the length."""

    @F.pandas_udf("string")
    def digest(head: pd.Series, length: pd.Series) -> pd.Series:
        return pd.Series([content_hash(bytes(h), int(n)) for h, n in zip(head, length, strict=True)])

    return files.select("filename", digest(F.substring("content", 1, HASHED_BYTES), F.col("length")).alias("hash"))


def parse_groups(raw: str, strict: bool = False) -> list[dict]:
    """A list of groups, bare or under 'groups'. What can't be read is no groups, or an error if ``strict``."""
    try:
        found = json.loads(raw)
        found = found["groups"] if isinstance(found, dict) else found
        return [{"id": str(g["id"]), "name": str(g.get("name", g["id"])), "images": [str(x) for x in g["images"]]} for g in found]
    except (ValueError, KeyError, TypeError):
        if strict:
            raise
        return []


def read_groups(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """members(group_id, name, group_pos, filename, member_pos) of a JSON file."""
    raw = spark.read.text(path, wholetext=True)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for value in pdf.value:
                out = [(g["id"], g["name"], p, f, m) for p, g in enumerate(parse_groups(value, strict)) for m, f in enumerate(g["images"])]
                yield pd.DataFrame(out, columns=["group_id", "name", "group_pos", "filename", "member_pos"])

    return raw.mapInPandas(rows, "group_id string, name string, group_pos long, filename string, member_pos long")


def usable_groups(members: DataFrame, items: DataFrame, least: int = 2) -> DataFrame:
    """Members that have embeddings, of groups with at least so many of them."""
    own = members.join(items.select("filename"), "filename", "left_semi")
    return own.join(own.groupBy("group_id").agg(F.count("*").alias("n")).where(F.col("n") >= least), "group_id", "left_semi")


def groups_json(members: DataFrame) -> DataFrame:
    """(group_pos, json): a line for each group, in order, ready to be written as text."""
    got = members.groupBy("group_id", "name", "group_pos").agg(F.sort_array(F.collect_list(F.struct("member_pos", "filename"))).alias("m"))
    return got.select("group_pos", F.to_json(F.struct(F.col("group_id").alias("id"), "name", F.transform("m", lambda x: x["filename"]).alias("images"))).alias("json")).orderBy("group_pos")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(term_pos, term, vec) of a JSON file with terms and embeddings; an empty one is an error."""
    raw = spark.read.schema("terms array<string>, embeddings array<array<float>>").json(path, multiLine=True)
    rows = raw.select(F.posexplode(F.arrays_zip("terms", "embeddings")).alias("term_pos", "x")).select("term_pos", F.col("x.terms").alias("term"), F.col("x.embeddings").cast("array<double>").alias("vec"))
    if not rows.limit(1).count():
        raise ValueError(f"no terms in {path}")
    return rows
