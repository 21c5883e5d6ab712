"""License scans by diagonal voting, in DataFrame functions alone.

All rolling word 2-grams of all texts are joined by hash to the grams of the templates (a fixed table of a few hundred
rows, so its broadcast is bounded by the code); the join also compares the words, so a vote is exact. A vote for
template position t at document word p lies on diagonal p - t. Votes are counted by diagonal, neighbouring diagonals
(words put in or left out) are merged, and a span is verified by the share of the template's grams that it covers and
by its length. Only votes are shuffled, never texts.

Base labels: the places where a base phrase stands whole (its diagonal holds all of its grams). The method's labels add
templates of the usual notices, matched at LEAST of their grams or more. The score is the largest share covered by a
verified span, 1 where a base phrase stands, 0 where nothing was found.

Defined results: null or empty text has no words, no labels (empty strings), null first_word and last_word, score 0;
repeated rows give repeated results and don't add up; null ids are kept; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Base phrases by label.
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
#: Notices by label, words as the scan sees them.
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
GRAM = 2
NEIGHBOURS = 3
LEAST = 0.8
VOTES = "template int, label string, base boolean, grams int, t int, gram string"


def words_of(text: Column) -> Column:
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)  # A-Z alone
    return F.filter(F.split(lowered, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda w: w != "")


def template_grams(spark: SparkSession, base: dict[str, str], notices: list[tuple[str, str]]) -> DataFrame:
    rows = []
    for i, (label, phrase, is_base) in enumerate([(k, v, True) for k, v in base.items()] + [(k, v, False) for k, v in notices]):
        w = phrase.split()
        rows += [(i, label, is_base, len(w) - GRAM + 1, t, " ".join(w[t : t + GRAM])) for t in range(len(w) - GRAM + 1)]
    return spark.createDataFrame(rows, VOTES).withColumn("t_hash", F.xxhash64("gram")).withColumnRenamed("gram", "t_gram")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """One row a document: word count, base places, labels and score."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("digest", F.xxhash64("text"))
    words = docs.select("doc_id", "digest", words_of(F.col("text")).alias("w"))
    n = F.size("w")
    grams = F.zip_with(F.slice("w", F.lit(1), n - 1), F.slice("w", F.lit(2), n - 1), lambda a, b: F.concat_ws(" ", a, b))
    rolling = words.where(n >= GRAM).select("doc_id", "digest", F.posexplode(grams).alias("p", "gram"))
    templates = F.broadcast(template_grams(docs.sparkSession, base, notices))
    votes = rolling.join(templates, (F.xxhash64("gram") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram")))

    key = ["doc_id", "digest", "template"]
    diagonal = votes.groupBy(*key, (F.col("p") - F.col("t")).alias("d")).agg(
        F.any_value("label").alias("label"), F.any_value("base").alias("base"), F.any_value("grams").alias("grams"), F.collect_set("t").alias("ts"), F.min("p").alias("lo"), F.max("p").alias("hi")
    )
    votes_needed = F.least(F.lit(2), F.col("grams"))
    diagonal = diagonal.where(F.size("ts") >= votes_needed)
    line = Window.partitionBy(*key).orderBy("d")
    apart = F.when(F.col("base") | (F.col("d") - F.lag("d").over(line) > NEIGHBOURS) | F.lag("d").over(line).isNull(), 1).otherwise(0)
    merged = diagonal.withColumn("apart", apart).withColumn("g", F.sum("apart").over(line))
    span = merged.groupBy(*key, "g").agg(
        F.any_value("label").alias("label"), F.any_value("base").alias("base"), F.any_value("grams").alias("grams"), F.min("d").alias("d"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.max(F.size("ts")).alias("one"), F.size(F.array_distinct(F.flatten(F.collect_list("ts")))).alias("all"),
    )
    near = F.col("hi") - F.col("lo") < 1.25 * F.col("grams") + NEIGHBOURS
    cover = F.when(near, F.col("all")).otherwise(F.col("one")) / F.col("grams")
    span = span.withColumn("cover", cover).where((F.col("base") & (F.col("cover") == 1)) | (~F.col("base") & (F.col("cover") >= LEAST)))
    whole = lambda label: F.when(F.col("base"), label)
    found = span.groupBy("doc_id", "digest").agg(
        F.sum(F.col("base").cast("long")).alias("n_base"), F.min(whole(F.col("d"))).cast("long").alias("first_word"), F.max(whole(F.col("d"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(whole(F.col("label")))), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("cover").alias("score"),
    )
    found = found.select(F.col("doc_id").alias("f_id"), F.col("digest").alias("f_digest"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    counts = docs.select("doc_id", "digest", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    return counts.join(found, counts["doc_id"].eqNullSafe(found["f_id"]) & (counts["digest"] == found["f_digest"]), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
