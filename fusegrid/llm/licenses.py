"""License scan by diagonal voting, on DataFrame functions only.

All rolling hashes of ``GRAM`` words of a text are joined with the hashes of the
templates, a fixed table of a few hundred rows.  Each hit votes for the diagonal
``text position - template position``.  A diagonal's votes are a set of the template's
positions, so a complete set verifies that the template stands there word for word
(up to 64-bit hashes of ``GRAM`` words each, of which all must agree).  Neighbouring
diagonals (a few inserted or missing words apart) whose spans meet are merged, and a
license template counts if the merged set covers ``min_cover`` of its positions.
Templates may be of any length.

Phrases must stand complete; each place counts.  ``score`` is the best covered
share over all templates, 1 for a complete one, 0 without hits.

Defined results: a null or empty text has no words, no places and score 0; equal
rows get equal results and do not add up; a null doc_id is treated as a value;
an empty table gives no rows; columns other than the two named ones are ignored.
Texts are read once; only hits are written and shuffled, and every group is one
document's hits of one template.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .native import lower_ascii, whole
from .store import shared_parquet

GRAM = 3
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The phrases of the task, each with its label.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Public license notices; each is found as a whole or nearly so.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software. The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties "
        "of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other "
        "liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    ),
    ("mit", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "licensed under the GNU General Public License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution ShareAlike"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution NonCommercial"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law the author has waived all copyright and related or neighboring rights"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def words_of(text: Column) -> Column:
    """Lower-case words of ASCII letters, digits and characters beyond ASCII."""
    bare = F.regexp_replace(lower_ascii(whole(text)), f"^{SEPARATORS}|{SEPARATORS}$", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SEPARATORS))


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def template_table(spark: SparkSession, templates: list[tuple[str, str]], phrases: list[tuple[str, str]]) -> DataFrame:
    """(template, label, exact, size, at, h), one row per gram of each template."""
    rows = []
    for number, (words, label, exact) in enumerate([(template_words(p), x, True) for p, x in phrases] + [(template_words(t), x, False) for x, t in templates]):
        if len(words) < GRAM:
            raise ValueError(f"a template needs {GRAM} words or more: {' '.join(words)}")
        size = len(words) - GRAM + 1
        rows += [(number, label, exact, size, at, *words[at : at + GRAM]) for at in range(size)]
    made = spark.createDataFrame(rows, "template int, label string, exact boolean, size int, at int, w0 string, w1 string, w2 string")
    return made.select("template", "label", "exact", "size", "at", F.xxhash64("w0", "w1", "w2").alias("h"))


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, min_cover: float = 0.8, drift: int = 4) -> DataFrame:
    """One row per input row: n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``spans`` lists (label, first_word, n_words) of what was found, by place.
    """
    spark = docs.sparkSession
    table = template_table(spark, templates, phrases)  # a fixed list of some hundred rows
    known = F.lit(sorted({r["h"] for r in table.select("h").collect()}))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    d = d.select("doc_id", F.xxhash64(whole(F.col("text"))).alias("version"), words_of(F.col("text")).alias("words"))
    last = F.size("words") - GRAM
    gram = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(GRAM)])))
    d = d.select("doc_id", "version", F.size("words").cast("bigint").alias("n_words"), gram.alias("grams"))
    placed = F.transform("grams", lambda h, i: F.struct(i.alias("pos"), h.alias("h")))
    hit = F.when(F.arrays_overlap("grams", known), F.filter(placed, lambda x: F.array_contains(known, x["h"])))
    d = shared_parquet(d.select("doc_id", "version", "n_words", hit.alias("hits")))
    grams = d.select("doc_id", "version", F.inline("hits"))
    hits = grams.join(F.broadcast(table), "h")
    found = hits.groupBy("doc_id", "version", "template", "label", "exact", "size", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("places"), F.min("pos").alias("begin"), F.max("pos").alias("end")
    )
    order = Window.partitionBy("doc_id", "version", "template").orderBy("begin", "diagonal")
    far = (F.col("begin") - F.lag("end").over(order) > drift + GRAM) | (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > drift)
    merged = found.withColumn("new", F.when(F.col("exact"), F.lit(1)).otherwise(F.coalesce(far.cast("int"), F.lit(1))))
    merged = merged.withColumn("run", F.sum("new").over(order)).groupBy("doc_id", "version", "template", "label", "exact", "size", "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("votes"), F.min("begin").alias("begin"), F.max("end").alias("end")
    )
    whole_template = F.col("votes") == F.col("size")
    cover = F.col("votes") / F.col("size")
    good = F.when(F.col("exact"), whole_template).otherwise(cover >= min_cover)
    base = F.col("exact") & whole_template
    per = merged.groupBy("doc_id", "version").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("begin"))).alias("first_word"),
        F.max(F.when(base, F.col("begin"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(good, F.col("label")))), ",").alias("labels"),
        F.max(cover).alias("score"),
        F.sort_array(F.collect_list(F.when(good, F.struct("begin", "label", (F.col("end") - F.col("begin") + GRAM).alias("n_words"))))).alias("spans"),
    )
    left = d.select("doc_id", "version", "n_words").alias("l")
    joined = left.join(per.alias("r"), F.expr("l.doc_id <=> r.doc_id and l.version = r.version"), "left")
    return joined.select(
        "l.doc_id",
        "l.n_words",
        F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        F.col("first_word").cast("bigint").alias("first_word"),
        F.col("last_word").cast("bigint").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "spans",
    )
