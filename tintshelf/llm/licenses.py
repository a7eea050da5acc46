"""License scan by diagonal voting over word 2-grams.

Every 2-gram of a document is joined with the positions it has in the templates; hits are summed by diagonal (position in
the document minus position in the template), neighbouring diagonals are merged, so that a word more or less does not
break a match, and a span counts when the template 2-grams seen in it cover enough of the template. Hits compare the words
themselves after the hash, so a full diagonal is a verbatim phrase. DataFrame functions throughout; the only shuffles carry
hits, the only broadcast is the template table, whose size is that of the parameter.

Defined cases: null text counts as empty (no words, no labels, score 0); rows of one doc_id with different texts stay
apart; a row that is repeated comes back as often; null doc_id stays null; an empty table gives no rows; further columns
are ignored. Ties between templates do not matter: labels are sets, the score is a maximum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tintshelf.llm.common import plain, text_hash, words

#: Phrases asked for by name: found where their words stand consecutively.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: Usual notices, found also with small changes.
NOTICES = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-2.0"),
]
#: A template holds at most this many 2-grams: one bit of a long for each.
MAX_GRAMS = 62
MERGE, COVER = 2, 0.8
#: Stands behind the 2-grams of every document; a word never holds it.
END = "\x00"


def templates() -> list[tuple[int, int, str, str, bool, int]]:
    """(template, position, 2-gram, label, base, number of 2-grams)."""
    rows = []
    for i, (phrase, label, base) in enumerate([(*b, True) for b in BASE] + [(*n, False) for n in NOTICES]):
        w = phrase.split()
        if not 2 <= len(w) <= MAX_GRAMS + 1:
            raise ValueError(f"a template has 2 to {MAX_GRAMS + 1} words: {phrase}")
        rows += [(i, k, f"{w[k]} {w[k + 1]}", label, base, len(w) - 1) for k in range(len(w) - 1)]
    return rows


def scan_licenses(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of (doc_id, text)."""
    spark = documents.sparkSession
    known = templates()
    marks = [(-1, 0, END, "", False, 1), *known]
    marks = spark.createDataFrame(marks, "template int, tpos int, tgram string, label string, base boolean, size int")
    marks = F.broadcast(marks.withColumn("code", F.xxhash64("tgram")))  # one row per template word: a parameter

    docs = plain(documents, "doc_id", "text").select("doc_id", text_hash(F.col("text")).alias("h"), words(F.col("text")).alias("w"))
    after = F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1)))
    grams = F.array_append(F.zip_with("w", after, lambda a, b: F.concat(a, F.lit(" "), b)), F.lit(END))
    each = docs.select("doc_id", "h", F.posexplode(grams).alias("pos", "gram")).filter(F.col("gram").isNotNull())
    hits = (
        each.withColumn("code", F.xxhash64("gram")).join(marks, "code").filter(F.col("gram") == F.col("tgram"))
        .select("doc_id", "h", "template", (F.col("pos") - F.col("tpos")).alias("diagonal"), "tpos", "label", "base", "size")
    )
    key = ["doc_id", "h", "template"]
    by_diagonal = hits.groupBy(*key, "diagonal").agg(
        F.bit_or(F.expr("shiftleft(1L, tpos)")).alias("mask"), F.count("*").alias("hits"),
        F.first("label").alias("label"), F.first("base").alias("base"), F.first("size").alias("size"),
    )
    order = Window.partitionBy(*key).orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > MERGE).cast("int"), F.lit(1))
    runs = by_diagonal.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    spans = runs.groupBy(*key, "run").agg(
        F.bit_count(F.bit_or("mask")).alias("seen"), F.first("label").alias("label"), F.first("base").alias("base"), F.first("size").alias("size"),
        F.sum((F.bit_count("mask") == F.col("size")).cast("long")).alias("places"), F.min("hits").alias("rows"),
        F.min(F.when(F.bit_count("mask") == F.col("size"), F.col("diagonal"))).alias("first"),
        F.max(F.when(F.bit_count("mask") == F.col("size"), F.col("diagonal"))).alias("last"),
        F.max("diagonal").alias("at"),
    )
    real, base = F.col("template") >= 0, F.col("base") & (F.col("places") > 0)
    share = F.col("seen") / F.col("size")
    found = real & (base | (~F.col("base") & (share >= COVER)))
    per_row = spans.groupBy("doc_id", "h").agg(
        F.max(F.when(~real, F.col("at"))).cast("long").alias("n_words"),
        F.max(F.when(~real, F.col("rows"))).alias("times"),
        F.coalesce(F.sum(F.when(base, F.col("places"))), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("last"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(found, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(found, F.when(base, F.lit(1.0)).otherwise(share))), F.lit(0.0)).cast("double").alias("score"),
    )
    again = F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))
    return per_row.withColumn("again", again).drop("again", "times", "h")
