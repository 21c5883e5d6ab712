"""Grounding, validation and selection of question-and-answer candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

MIN_QUOTE_WORDS = 3
MIN_COVERAGE = 0.8


def trigrams(words: Column) -> Column:
    n = F.size(words)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.array_join(F.slice(words, i, 3), " "))).otherwise(F.array().cast("array<string>"))


def words_of(c: Column) -> Column:
    return F.filter(F.split(T.grounding_normal(c), " "), lambda w: w != "")


def quote_coverage(quotes: DataFrame, texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(quote_id, doc_id, total, found, supported) for quotes and the texts that hold at least one of their trigrams.

    Fragments split at ellipses; trigrams never cross one. Joined on the trigram, so a quote meets only texts that share one.
    """
    parts = quotes.select("quote_id", F.explode(F.split("quote", r"…|\.{3,}")).alias("part")).select("quote_id", words_of(F.col("part")).alias("w"))
    grams = parts.select("quote_id", F.explode(trigrams(F.col("w"))).alias("g")).groupBy("quote_id", "g").agg(F.count("*").alias("times"))
    total = grams.groupBy("quote_id").agg(F.sum("times").alias("total"))
    there = texts.select(key, words_of(F.col("text")).alias("w")).select(key, F.explode(F.array_distinct(trigrams(F.col("w")))).alias("g"))
    hits = there.join(grams, "g").groupBy("quote_id", key).agg(F.sum("times").alias("found"))
    return hits.join(total, "quote_id").withColumn("supported", F.col("found") >= MIN_COVERAGE * F.col("total"))


def missing_numbers(answer: Column, source: Column) -> Column:
    """Distinct digit runs of the answer that the source lacks."""
    return F.array_sort(F.array_except(T.numbers(answer), T.numbers(source)))


def candidate_problems(c: DataFrame, most: int = 10) -> DataFrame:
    """Problems of each candidate of a document: blank fields, repeated question, too many."""
    n = F.row_number().over(Window.partitionBy("doc", "qnorm").orderBy("ord"))
    at = F.row_number().over(Window.partitionBy("doc").orderBy("ord"))
    rows = c.withColumn("qnorm", T.question_normal(F.col("question")))
    problems = F.array_compact(F.array(F.when(F.trim("question") == "", "blank question"), F.when(F.trim("answer") == "", "blank answer"), F.when(n > 1, "repeated question"), F.when(at > most, "too many")))
    return rows.withColumn("problems", problems)


def quotas(documents: Column, items: int = 10, most: int = 3, least: int = 1) -> tuple[Column, Column]:
    """(max, min) items a document."""
    return F.greatest(F.lit(most), F.ceil(F.lit(items) / documents).cast("int")), F.when(documents * least <= items, least).otherwise(0)


def round_robin(c: DataFrame, n: int) -> DataFrame:
    """One candidate a document a turn, documents in order of first appearance; repeated questions are skipped but use their turn."""
    c = c.withColumn("turn_no", F.row_number().over(Window.partitionBy("doc").orderBy("ord"))).withColumn("doc_at", F.min("ord").over(Window.partitionBy("doc")))
    first = F.row_number().over(Window.partitionBy("qnorm").orderBy("turn_no", "doc_at", "ord"))
    return c.withColumn("_f", first).where("_f = 1").orderBy("turn_no", "doc_at", "ord").limit(n).drop("_f", "doc_at")
