"""Names of clusters from a vocabulary: how far a term's match with the cluster's centroid stands out of all items' matches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions import vectors as V
from tessel.operators.moments import means, products, second_moments

#: How many tags a cluster has, how many terms its name has.
TAGS, NAME_TERMS = 8, 3


def term_stats(items: DataFrame, terms: DataFrame) -> DataFrame:
    """(term_pos, term, mean, std): over all items, population deviation. From the items' moments: mean t·m, mean square tᵀMt, so no item meets a term."""
    n, total, second = second_moments(items)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) and n:
                t = np.stack(pdf.vec).astype(np.float64)
                mean = t @ (total / n)
                square = ((t @ (second / n)) * t).sum(axis=1)
                yield pd.DataFrame({"term_pos": pdf.term_pos, "term": pdf.term, "mean": mean, "std": np.sqrt(np.maximum(0.0, square - mean * mean))})

    return terms.select("term_pos", "term", "vec").mapInPandas(run, f"term_pos {terms.schema['term_pos'].dataType.simpleString()}, term string, mean double, std double")


def cluster_centroids(clusters: DataFrame, items: DataFrame) -> DataFrame:
    """(cluster_id, centroid): the mean of the members' vectors at norm 1; members without vectors don't count."""
    got = means(clusters.join(items.select("image_id", "vec"), "image_id"), "cluster_id")
    n = V.norm(F.col("mean"))
    return got.select("cluster_id", F.when(n > V.LEAST_NORM, F.transform("mean", lambda x: x / n)).otherwise(F.col("mean")).alias("centroid"))


def z_scores(clusters: DataFrame, items: DataFrame, terms: DataFrame, keep: int | None = None) -> DataFrame:
    """(cluster_id, term_pos, term, z); statistics are always those of all items. ``keep``: of each cluster only candidates among which its best are.

    A term's vector is scaled by its deviation and carries its mean as one more component, so that z is an inner product."""
    stats = terms.select("term_pos", "vec").join(term_stats(items, terms), "term_pos")
    scaled = F.when(F.col("std") > V.LEAST_NORM, F.concat(F.transform("vec", lambda x: x / F.col("std")), F.array(-F.col("mean") / F.col("std")))).otherwise(F.transform(F.concat("vec", F.array(F.lit(0.0))), lambda x: F.lit(0.0)))
    left = cluster_centroids(clusters, items).select(F.col("cluster_id").alias("id"), F.concat("centroid", F.array(F.lit(1.0))).alias("vec"))
    got = products(left, stats.select(F.col("term_pos").alias("id"), scaled.alias("vec")), keep, rows=(clusters.select("cluster_id").distinct().count(), terms.count()))
    return got.select(F.col("a_id").alias("cluster_id"), F.col("b_id").alias("term_pos"), F.col("x").alias("z")).join(terms.select("term_pos", "term"), "term_pos").select("cluster_id", "term_pos", "term", "z")


def _ranked(scores: DataFrame) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("z"), "term_pos")))


def cluster_tags(clusters: DataFrame, items: DataFrame, terms: DataFrame, most: int = TAGS) -> DataFrame:
    return _ranked(z_scores(clusters, items, terms, most)).where(F.col("rank") <= most).select("cluster_id", "rank", "term", "z")


def distinct_terms(ranked: list[str], most: int = NAME_TERMS) -> list[str]:
    """The first terms of which none begins like one before (by first words, either way round)."""
    chosen: list[str] = []
    for term in ranked:
        words = term.split(" ")
        head = words[0].lower()
        if len(chosen) < most and not any(c.lower().startswith(head) or head.startswith(c.lower().split("_")[0]) for c in chosen):
            chosen.append("_".join(words[:2]))
    return chosen


def auto_names(clusters: DataFrame, items: DataFrame, terms: DataFrame, confirmed: DataFrame | None = None) -> DataFrame:
    """(cluster_id, auto_name): the confirmed group's name where there is one (cluster_id, name), else the terms that stand out."""

    @F.pandas_udf("string")
    def name(ranked: pd.Series) -> pd.Series:
        return ranked.map(lambda r: " · ".join(distinct_terms(list(r))))

    ranked = z_scores(clusters, items, terms).groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("z")).alias("z"), "term_pos", "term"))).alias("r"))
    got = ranked.select("cluster_id", name(F.transform("r", lambda x: x["term"])).alias("auto_name"))
    if confirmed is not None:
        got = got.join(confirmed.select("cluster_id", "name"), "cluster_id", "left").select("cluster_id", F.coalesce("name", "auto_name").alias("auto_name"))
    return got


def plain_names(clusters: DataFrame) -> DataFrame:
    """Where there is no vocabulary: the confirmed group's name or the cluster's place in order. clusters: cluster_id, pos, name (nullable)."""
    return clusters.select("cluster_id", F.coalesce("name", F.concat(F.lit("Cluster "), (F.col("pos") + 1).cast("string"))).alias("auto_name"))
