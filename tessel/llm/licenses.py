"""License scans by diagonal voting (op 4), DataFrame operations only.

Every rolling word bigram of every whole text is hashed and joined to the positions of the same hash in the templates (a
parameter of bounded size, so it is broadcast and the texts aren't shuffled); a match is a vote only if both words are
equal as well. Votes are aggregated by diagonal, word position less template position: a phrase stands where its
diagonal has every vote. For longer templates neighbouring diagonals (words put in or left out) merge to spans, and a
span is verified if it covers ``coverage`` of the template's bigrams without being much longer than the template;
templates of fewer than 12 words must be whole.

Words are maximal runs of digits, letters and bytes above ASCII, A-Z lower-cased. Only votes are shuffled, by row, so no
text and no phrase is a hot key; a text of n words has at most n diagonals a template. Null and empty texts have 0
words and no labels. Rows are independent: repeated rows and null ids give a row each. An empty table: no rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The phrases whose places are counted, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Longer templates of the method and their labels.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2.0",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "under the terms of the gnu lesser general public license": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
}

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    words: list[str]
    label: str
    base: bool


def known_templates() -> list[Template]:
    return [Template(p.split(), x, True) for p, x in BASE.items()] + [Template(p.split(), x, False) for p, x in TEMPLATES.items()]


def _positions(spark: SparkSession, templates: list[Template]) -> DataFrame:
    if any(not 2 <= len(t.words) <= 64 for t in templates):
        raise ValueError("templates have 2 to 64 words")
    rows = [(i, p, 1 << p, t.words[p], t.words[p + 1], len(t.words), t.label, t.base) for i, t in enumerate(templates) for p in range(len(t.words) - 1)]
    df = spark.createDataFrame(rows, "template int, at int, bit long, w1 string, w2 string, length int, label string, base boolean")
    # no template: the row that every text joins once, with its number of words as the diagonal
    nothing = spark.createDataFrame([(-1, 0, 0, "", "", 0, "", False)], df.schema)
    return df.unionByName(nothing).withColumn("gram", F.when(F.col("template") < 0, F.lit(0)).otherwise(F.xxhash64("w1", "w2")))


def votes(docs: DataFrame, templates: list[Template], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per text, template and diagonal: mask of the template's positions found, first and last word position. Template -1: the number of words."""
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = words.select("row", "id", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    # each bigram carries its own two words, so a text costs what it is long; the first entry has the number of words
    entry = lambda gram, a, b, n: F.struct(gram.alias("gram"), a.alias("a"), b.alias("b"), n.cast("int").alias("n"))
    n = F.greatest(F.size("words") - 1, F.lit(0))
    grams = F.zip_with(F.slice("words", 1, n), F.slice("words", 2, n), lambda a, b: entry(F.xxhash64(F.lower(a), F.lower(b)), a, b, F.lit(0)))
    nothing = F.array(entry(F.lit(0).cast("long"), F.lit(""), F.lit(""), F.size("words")))
    rolled = words.select("row", "id", F.posexplode(F.concat(nothing, grams)).alias("pos", "g")).select("row", "id", "pos", "g.*")
    at = F.broadcast(_positions(docs.sparkSession, templates))
    low = lambda c: F.translate(c, UPPER, LOWER)
    same = ((F.col("template") < 0) & (F.col("pos") == 0)) | ((F.col("template") >= 0) & (F.col("pos") > 0) & (low("a") == F.col("w1")) & (low("b") == F.col("w2")))
    hits = rolled.join(at, "gram").where(same)
    hits = hits.select("row", "id", "template", "bit", "length", "label", "base", (F.col("pos") - 1).alias("pos"), F.when(F.col("template") < 0, F.col("n")).otherwise(F.col("pos") - 1 - F.col("at")).alias("diagonal"))
    keys = ["row", "id", "template", "length", "label", "base", "diagonal"]
    return hits.repartition("row").groupBy(*keys).agg(F.bit_or("bit").alias("mask"), F.min("pos").alias("first"), F.max("pos").alias("last"))


def spans(docs: DataFrame, templates: list[Template] | None = None, coverage: float = 0.8, reach: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified places: row, id, template, length, label, base, start, end (words), covered. Template -1 has the number of words as its end."""
    found = votes(docs, templates or known_templates(), id_col, text_col)
    w = Window.partitionBy("row", "template").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(w)
    alone = F.col("base") | (F.col("template") < 0)
    found = found.withColumn("new", F.when(alone | step.isNull() | (step > reach), 1).otherwise(0))
    found = found.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    got = found.groupBy("row", "id", "template", "length", "label", "base", "island").agg(F.bit_or("mask").alias("mask"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("diagonal").alias("diagonal"))
    got = got.withColumn("covered", F.when(F.col("template") < 0, 0.0).otherwise(F.bit_count("mask") / (F.col("length") - 1)))
    size = F.col("last") - F.col("first") + 2
    whole = F.col("covered") >= F.when(F.col("base") | (F.col("length") < 12), 1.0).otherwise(coverage)
    got = got.where((F.col("template") < 0) | (whole & (F.col("base") | (size <= F.col("length") * 1.25 + reach))))
    end = F.when(F.col("template") < 0, F.col("diagonal")).otherwise(F.col("last") + 2)
    return got.select("row", "id", "template", "length", "label", "base", F.when(F.col("template") >= 0, F.col("first")).alias("start"), end.alias("end"), "covered")


def scan(docs: DataFrame, templates: list[Template] | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row per text: n_words, n_base, first_word, last_word, base_labels, labels, score (the best share of a template found)."""
    got = spans(docs, templates, id_col=id_col, text_col=text_col, **options)
    real = F.col("template") >= 0
    base = F.when(real & F.col("base"), F.col("start"))
    names = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(c)))
    out = got.groupBy("row", "id").agg(
        F.max(F.when(~real, F.col("end"))).cast("long").alias("n_words"),
        F.count(base).alias("n_base"),
        F.min(base).cast("long").alias("first_word"),
        F.max(base).cast("long").alias("last_word"),
        names(F.when(real & F.col("base"), F.col("label"))).alias("base_labels"),
        names(F.when(real, F.col("label"))).alias("labels"),
        F.max("covered").alias("score"),
    )
    return out.drop("row").withColumnRenamed("id", id_col)
