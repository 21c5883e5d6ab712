"""Grounding, checks and choice of selected items; unit lists, prompts and plans of a corpus."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

SELECTION = "items ARRAY<STRUCT<question: STRING, answer: STRING, basedOn: ARRAY<STRING>>>, _bad STRING"
CHOICE = "set string, k long, chosen boolean"


def grounded(candidates: DataFrame, key: str, problem: str) -> tuple[DataFrame, DataFrame]:
    """(candidates without a problem, sets of which none is left with all their problems in order)."""
    left = candidates.where(F.col(problem).isNull())
    lost = candidates.groupBy(key).agg(F.count(F.when(F.col(problem).isNull(), 1)).alias("left"), F.array_sort(F.collect_list(F.struct("ord", F.col(problem).alias("p")))).alias("ps"))
    return left, lost.where("left = 0").select(key, F.array_join(F.transform("ps", lambda r: r["p"]), "; ").alias("problems"))


def parsed_selection(answers: DataFrame, value: str = "value") -> DataFrame:
    """Adds items and problem: a closed object of items with question, answer and basedOn; other shapes and further fields are problems."""
    parsed = F.from_json(value, SELECTION, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = answers.withColumn("_p", parsed).withColumn("_keys", F.json_object_keys(value))
    short = F.exists(F.col("_p.items"), lambda x: x["question"].isNull() | x["answer"].isNull() | x["basedOn"].isNull())
    problem = F.when(F.col("_p._bad").isNotNull() | F.col("_keys").isNull(), "malformed").when(F.col("_keys") != F.array(F.lit("items")), "unknown field").when(F.col("_p.items").isNull() | F.coalesce(short, F.lit(False)), "missing field")
    return rows.withColumn("problem", problem).withColumn("items", F.when(F.col("problem").isNull(), F.col("_p.items"))).drop("_p", "_keys")


def item_problems(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """(set, position, problems) of selected items: set, position, question, answer, based_on; candidates: set, id, answer, quote.

    Codes in order: blank question, repeated question (asked by any item before it),
    blank answer, empty basis, unknown candidate, ungrounded number.
    """
    key = ["set", "position"]
    each = items.select(*key, F.explode("based_on").alias("id"))
    known = candidates.groupBy("set", "id").agg(F.min(F.struct("answer", F.coalesce("quote", F.lit("")).alias("quote"))).alias("c"))  # one row an id
    found = each.join(known, ["set", "id"], "left").groupBy(*key).agg(
        F.count(F.when(F.col("c").isNull(), 1)).alias("unknown"), F.count("c").alias("known"), F.array_distinct(F.flatten(F.collect_list(F.concat(T.numbers(F.col("c.answer")), T.numbers(F.col("c.quote")))))).alias("there")
    )
    asked = T.question_normal(F.col("question"))
    nth = F.row_number().over(Window.partitionBy("set", asked).orderBy("position"))
    rows = items.withColumn("nth", nth).join(found, key, "left")
    blank = F.trim("question") == ""
    lacking = F.size(F.array_except(T.numbers(F.col("answer")), F.coalesce("there", F.array().cast("array<string>")))) > 0
    problems = [
        F.when(blank, "blank question"), F.when(~blank & (F.col("nth") > 1), "repeated question"), F.when(F.trim("answer") == "", "blank answer"), F.when(F.size("based_on") == 0, "empty basis"),
        F.when(F.col("unknown") > 0, "unknown candidate"), F.when((F.col("known") > 0) & lacking, "ungrounded number"),
    ]
    return rows.select(*key, F.array_compact(F.array(*problems)).alias("problems"))


def choose(items: list[list[str]], documents: Iterable[str], total: int, least: int, most: int) -> list[bool]:
    """Which items of a set are taken, in their order: first each document's minimum, then what fits.

    An item counts for the minimum of all its documents and is charged to the least charged one with room, the first of equals.
    """
    taken = [False] * len(items)
    count: dict[str, int] = dict.fromkeys(documents, 0)
    charged = dict(count)
    left = total

    def take(k: int) -> bool:
        nonlocal left
        room = [d for d in items[k] if charged[d] < most]
        if taken[k] or not left or not room:
            return False
        taken[k] = True
        left -= 1
        for d in items[k]:
            count[d] += 1
        charged[min(room, key=charged.__getitem__)] += 1
        return True

    for d in count:
        for k, sources in enumerate(items):
            if count[d] >= least:
                break
            if d in sources:
                take(k)
    for k in range(len(items)):
        take(k)
    return taken


def quota_choice(items: DataFrame, total: int, least: int, most: int) -> DataFrame:
    """(set, k, chosen) for items (set, k, documents), documents of a set in order of first appearance. A set is one answer's pool, a few dozen rows."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by("k")
        pool = t["documents"].to_pylist()
        order = dict.fromkeys(d for x in pool for d in x)
        return pa.table({"set": t["set"], "k": t["k"], "chosen": pa.array(choose(pool, order, total, least, most), pa.bool_())})

    return items.select(F.col("set").cast("string").alias("set"), F.col("k").cast("long").alias("k"), "documents").groupBy("set").applyInArrow(run, CHOICE)


def unused_candidates(candidates: DataFrame, used: DataFrame, asked: DataFrame) -> DataFrame:
    """(set, doc, ord, question, turn, place) of candidates that no valid item uses: a document a turn in order of first appearance, each question once.

    candidates: set, doc, ord, question; used: set, ord; asked: set, qnorm. A repeated question uses up its turn.
    """
    rest = candidates.join(used.distinct(), ["set", "ord"], "left_anti").withColumn("qnorm", T.question_normal(F.col("question")))
    doc = Window.partitionBy("set", "doc")
    rest = rest.withColumn("turn", F.row_number().over(doc.orderBy("ord"))).withColumn("doc_at", F.min("ord").over(doc))
    first = F.row_number().over(Window.partitionBy("set", "qnorm").orderBy("turn", "doc_at"))
    kept = rest.withColumn("_f", first).where("_f = 1").join(asked.distinct(), ["set", "qnorm"], "left_anti")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("set").orderBy("turn", "doc_at"))).select("set", "doc", "ord", "question", "turn", "place")


def unit_list(sections: DataFrame) -> DataFrame:
    """(doc_id, label, ord) of each document's designations and headings, the first of equal ones, for prompts and lookups."""
    each = sections.select("doc_id", "section_ord", F.posexplode(F.array("designation", "heading")).alias("p", "label")).where("trim(label) <> ''")
    return each.groupBy("doc_id", F.trim("label").alias("label")).agg((F.min(F.struct("section_ord", "p"))["section_ord"] * 2 + F.min(F.struct("section_ord", "p"))["p"]).alias("ord"))


def prompt(parts: list[tuple[str, Column]]) -> Column:
    """Titled sections of a prompt, empty ones left out."""
    return F.concat_ws("\n\n", *[F.when(F.trim(body) != "", F.concat(F.lit(f"## {title}\n"), body)) for title, body in parts])


def plan(templates: DataFrame, counts: DataFrame) -> DataFrame:
    """(kind, nth, id, template): each kind's templates in the order of their hash, cycled until its count is reached; ids PREFIX-nn."""
    order = F.row_number().over(Window.partitionBy("kind").orderBy(F.md5(F.concat_ws("/", "kind", "template")), "template")) - 1
    many = F.count("*").over(Window.partitionBy("kind"))
    t = templates.withColumns({"place": order, "many": many})
    slots = counts.select("kind", "prefix", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("nth"))
    return slots.join(t, (slots["kind"] == t["kind"]) & (F.pmod("nth", "many") == F.col("place"))).select(slots["kind"], (F.col("nth") + 1).alias("nth"), F.concat("prefix", F.lit("-"), F.lpad((F.col("nth") + 1).cast("string"), 2, "0")).alias("id"), "template")


def overridden(facts: DataFrame, poison: DataFrame) -> DataFrame:
    """(doc, fact, value, is_poison): a poisoned copy prints its false value instead; the smallest operation of a fact wins."""
    false = poison.groupBy("doc", "fact").agg(F.min(F.struct("op", "false_value"))["false_value"].alias("false_value"))
    return facts.join(false, ["doc", "fact"], "left").select("doc", "fact", F.coalesce("false_value", "value").alias("value"), F.col("false_value").isNotNull().alias("is_poison"))


def novelty_choice(options: DataFrame, seen: DataFrame) -> DataFrame:
    """The option of each slot that is newest: 4 for an unseen place, 2 for an unseen goal, 1 for an unseen pair; the first of equals."""
    places, goals, pairs = (seen.select(*c).distinct().withColumn(f"_{i}", F.lit(1)) for i, c in enumerate((["place"], ["goal"], ["place", "goal"])))
    rows = options.join(places, "place", "left").join(goals, "goal", "left").join(pairs, ["place", "goal"], "left")
    score = F.when(F.col("_0").isNull(), 4).otherwise(0) + F.when(F.col("_1").isNull(), 2).otherwise(0) + F.when(F.col("_2").isNull(), 1).otherwise(0)
    best = F.row_number().over(Window.partitionBy("slot").orderBy(F.col("score").desc(), "ord"))
    return rows.withColumn("score", score).withColumn("_r", best).where("_r = 1").select("slot", "ord", "place", "goal", "score")


def tariff_positions(items: DataFrame) -> DataFrame:
    """(doc, ord, position): top-level items numbered through the document, their children by dots."""
    w = Window.partitionBy("doc").orderBy("ord")
    rows = items.withColumn("top", F.sum((F.col("level") == 0).cast("int")).over(w))
    child = F.sum((F.col("level") == 1).cast("int")).over(Window.partitionBy("doc", "top").orderBy("ord"))
    return rows.select("doc", "ord", F.concat(F.col("top").cast("string"), F.when(F.col("level") == 1, F.concat(F.lit("."), child.cast("string"))).otherwise("")).alias("position"))


def block_text(elements: DataFrame, key: list[str]) -> DataFrame:
    """A block's plain text: its elements' texts in order, blank ones left out."""
    ordered = F.array_sort(F.collect_list(F.when(F.trim("text") != "", F.struct("ord", "text"))))
    return elements.groupBy(*key).agg(F.array_join(F.transform(ordered, lambda r: F.trim(r["text"])), " ").alias("text"))
