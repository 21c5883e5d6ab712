"""Dated facts, versions, contradictions, checks and quality measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def as_of(queries: DataFrame, facts: DataFrame, key: list[str], at: str = "at", since: str = "since", value: str = "value") -> DataFrame:
    """Value in force at a moment: the latest fact from then or before. One union and one sort by key instead of a range join."""
    f = facts.select(*key, F.col(since).alias("_t"), F.lit(0).alias("_q"), F.col(value).alias("_v"), *[F.lit(None).cast(t).alias(f"q_{c}") for c, t in queries.dtypes if c not in key])
    q = queries.select(*key, F.col(at).alias("_t"), F.lit(1).alias("_q"), F.lit(None).cast(dict(facts.dtypes)[value]).alias("_v"), *[F.col(c).alias(f"q_{c}") for c in queries.columns if c not in key])
    w = Window.partitionBy(*key).orderBy("_t", "_q").rowsBetween(Window.unboundedPreceding, 0)
    out = f.unionByName(q).withColumn("in_force", F.last("_v", ignorenulls=True).over(w)).where("_q = 1")
    return out.select(*key, *[F.col(f"q_{c}").alias(c) for c in queries.columns if c not in key], "in_force")


def version_chain(rows: DataFrame, key: str, day: str) -> DataFrame:
    """Versions of a document by day, each valid to the day before the next."""
    w = Window.partitionBy(key).orderBy(day, "id")
    nxt = F.lead(day).over(w)
    return rows.withColumn("version", F.row_number().over(w)).withColumn("valid_to", F.date_sub(nxt, 1)).withColumn("previous_id", F.lag("id").over(w)).withColumn("status", F.when(nxt.isNull(), "current").otherwise("outdated"))


def repeated_texts(parts: DataFrame, text: str, doc: str) -> DataFrame:
    """Texts that stand in more than one document."""
    return parts.groupBy(text).agg(F.countDistinct(doc).alias("documents"), F.count("*").alias("places")).where("documents > 1")


def bag_difference(truth: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Missing and extra occurrences of each word."""
    a, b = truth.groupBy(*key).agg(F.count("*").alias("a")), found.groupBy(*key).agg(F.count("*").alias("b"))
    n, m = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    return a.join(b, key, "full").select(*key, F.greatest(n - m, F.lit(0)).alias("missing"), F.greatest(m - n, F.lit(0)).alias("extra")).where("missing > 0 OR extra > 0")


def numbered(rows: DataFrame, rank: str, key: str, out: str, width: int = 65536) -> DataFrame:
    """Numbers all rows from 1 by rank and whole-number key: in ranges of the key, each after the count of those before."""
    cut = rows.withColumn("_range", F.floor(F.col(key) / width))
    ranges = cut.groupBy(rank, "_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy(rank, "_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(rank, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(rank, "_range").orderBy(key))
    return cut.withColumn("_at", inside).join(ranges, [rank, "_range"]).withColumn(out, F.col("_at") + F.col("_before")).drop("_at", "_before", "_range")


def among(rows: DataFrame, key: str, members: DataFrame, out: str) -> DataFrame:
    """Rows with whether their whole-number key is in the one column of members. These travel and are hashed as bits, 64
    neighbouring keys a row; rows pass by once, neither sorted nor held."""
    block = lambda k: F.shiftright(k.cast("long"), 6)
    place = lambda k: k.cast("long").bitwiseAND(F.lit(63)).cast("int")
    own, k = F.col(key), F.col(members.columns[0])
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place(k))
    bits = members.where(k.isNotNull()).groupBy(block(k).alias("_block")).agg(F.bit_or(bit).alias("_bits"))
    met = rows.join(bits.hint("shuffle_hash"), block(own) == F.col("_block"), "left")
    return met.withColumn(out, F.coalesce(F.getbit("_bits", place(own)) == 1, F.lit(False))).drop("_block", "_bits")


def atx_headings(docs: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, line_no, heading): headings of one to six # outside ``` and ~~~ fences, which the lines are folded over for."""
    fence, heading = r"^ {0,3}(`{3,}|~{3,})(.*)$", r"^ {0,3}#{1,6}(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$"
    start = F.struct(F.lit("").alias("fence"), F.lit(0).alias("at"), F.array().cast("array<struct<line_no:int,heading:string>>").alias("found"))

    def step(s, line):
        mark, rest = F.regexp_extract(line, fence, 1), F.regexp_extract(line, fence, 2)
        inside = s["fence"] != ""
        closes = inside & (mark != "") & mark.startswith(s["fence"]) & (F.regexp_replace(rest, r"\s", "") == "")
        now = F.when(closes, "").when(inside, s["fence"]).otherwise(mark)
        is_head = ~inside & (mark == "") & line.rlike(heading)
        head = F.array(F.struct(s["at"].alias("line_no"), F.regexp_extract(line, heading, 1).alias("heading")))
        return F.struct(now.alias("fence"), (s["at"] + 1).alias("at"), F.when(is_head, F.concat(s["found"], head)).otherwise(s["found"]).alias("found"))

    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"\r+$", ""))
    return docs.select(*key, F.explode(F.aggregate(lines, start, step, lambda s: s["found"])).alias("h")).select(*key, "h.line_no", "h.heading")


def phrases_in(docs: DataFrame, key: str, text: str, phrases: list[str]) -> DataFrame:
    """(key, word) for each phrase that stands in a text as whole words, both folded. Texts are folded once, and each phrase
    is looked for in them; phrases come from code, so there are few."""
    spaced = lambda c: F.concat(F.lit(" "), F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    plain = lambda c: F.translate(spaced(c), T.ACCENTED, T.PLAIN)
    wanted = F.array(*[F.struct(F.lit(p).alias("word"), F.concat(F.lit(" "), F.nullif(F.trim(plain(F.lit(p))), F.lit("")), F.lit(" ")).alias("gram")) for p in phrases])
    # the one-element array keeps the folded text from being made anew for each phrase
    found = F.flatten(F.transform(F.array(plain(F.col(text))), lambda t: F.filter(wanted, lambda p: t.contains(p["gram"]))))
    return docs.where(F.col(text).isNotNull()).select(key, F.explode(found).alias("p")).select(key, "p.word")
