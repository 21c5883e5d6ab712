"""Page geometry, numbering, rendering and validation of documents, as column expressions and DataFrame transformations."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

#: Ligatures and what they stand for; spaces that become a plain one.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
SPACES = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Control characters that aren't white space, and the replacement character.
UNMAPPED = "[\\x00-\\x08\\x0E-\\x1F\\x7F-\\x84\\x86-\\x9F\\x{FFFD}]"
#: Fixed values of the generator's streams.
GAMMA, MIX_1, MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def normal_text(c: Column) -> Column:
    """Ligatures expanded, special spaces plain, marks composed (NFC, so superscript digits stay)."""
    for one, many in LIGATURES.items():
        c = F.replace(c, F.lit(one), F.lit(many))
    return _composed(F.translate(c, SPACES, " " * len(SPACES)))


def unmapped(c: Column) -> Column:
    """Number of characters without a Unicode mapping."""
    return F.regexp_count(c, F.lit(UNMAPPED))


def zone(top: Column, bottom: Column, height: Column, share: float = 0.08) -> Column:
    """header or footer when a box lies wholly in the margin, else body; y grows downwards."""
    return F.when(bottom <= height * share, "header").when(top >= height * (1 - share), "footer").otherwise("body")


def removable_page_marks(marks: DataFrame, key: str, pages: DataFrame) -> DataFrame:
    """Keys whose `N/M` marks all go: two pages or more, one total equal to the page count, one offset."""
    found = marks.groupBy(key).agg(F.countDistinct("page").alias("marked"), F.min("total").alias("least"), F.max("total").alias("most"), F.min(F.col("number") - F.col("page")).alias("low"), F.max(F.col("number") - F.col("page")).alias("high"))
    return found.join(pages, key).where("marked >= 2 AND least = most AND most = page_count AND low = high").select(key, F.col("low").alias("page_offset"))


def columns_by_gutter(lines: DataFrame, page: str, width: float, share: float = 0.02) -> DataFrame:
    """Adds column (1 or 2): lines right of the page's widest empty gutter are in the second, where one is wide enough."""
    before = Window.partitionBy(page).orderBy("left", "right").rowsBetween(Window.unboundedPreceding, -1)
    gaps = lines.withColumn("_end", F.max("right").over(before)).where((F.col("left") - F.col("_end")) >= width * share)
    widest = gaps.groupBy(page).agg(F.max(F.struct((F.col("left") - F.col("_end")).alias("gap"), F.col("left").alias("at"))).alias("g")).select(page, F.col("g.at").alias("_at"))
    return lines.join(widest, page, "left").withColumn("column", F.when(F.col("left") >= F.col("_at"), 2).otherwise(1)).drop("_at")


def is_multi_cell(gaps: Column, em: float) -> Column:
    """A line of cells: a gap at least, the narrowest of one em, and not four or more cells spread evenly (within 20 % of the median)."""
    n = F.size(gaps)
    ordered = F.sort_array(gaps)
    middle = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
    even = (n >= 3) & F.forall(gaps, lambda g: F.abs(g - middle) <= 0.2 * middle)
    return (n >= 1) & (F.array_min(gaps) >= em) & ~even


def lower_quartile(values: Column) -> Column:
    """The sorted value at index (n - 1) div 4."""
    return F.get(F.sort_array(values), F.floor((F.size(values) - 1) / 4).cast("int"))


def article_split(line: Column) -> tuple[Column, Column]:
    """(designation, first item) of a line that opens an article with its item 1, else (line, null)."""
    pattern = r"^(Art\. ?\d+[a-z]*\.)\s+(1\.\s.+)$"
    hit = line.rlike(pattern)
    return F.when(hit, F.regexp_extract(line, pattern, 1)).otherwise(line), F.when(hit, F.regexp_extract(line, pattern, 2))


def metadata_problems(doc_id: Column, version: Column, start: Column, end: Column) -> Column:
    """All that is wrong with a document's metadata, in a fixed order."""
    return F.array_compact(F.array(
        F.when(~F.coalesce(doc_id.rlike(r"^[A-Za-z0-9._-]{1,100}$"), F.lit(False)), "id"),
        F.when(version <= 0, "version"),
        F.when(end < start, "validity"),
    ))


def inline_runs(runs: DataFrame, key: list[str], order: str, style: str, text: str, markers: dict[str, str]) -> DataFrame:
    """(key, rendered): neighbouring runs of one style merged, each wrapped in its style's marker."""
    line = Window.partitionBy(*key).orderBy(order)
    new = F.when(F.lag(style).over(line).eqNullSafe(F.col(style)), 0).otherwise(1)
    merged = runs.withColumn("_new", new).withColumn("_run", F.sum("_new").over(line)).groupBy(*key, "_run").agg(F.first(style).alias("_style"), F.sort_array(F.collect_list(F.struct(order, text))).alias("_parts"))
    mark = F.coalesce(F.create_map(*[F.lit(x) for kv in markers.items() for x in kv])[F.col("_style")], F.lit(""))
    shown = F.concat(mark, F.array_join(F.transform("_parts", lambda p: p[text]), ""), mark)
    return merged.select(*key, "_run", shown.alias("_shown")).groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_run", "_shown"))), lambda p: p["_shown"]), " ").alias("rendered"))


def list_line(depth: Column, label: Column, text: Column) -> Column:
    """One Markdown list line: two spaces a depth, bullets dropped, a dash kept, other labels escaped."""
    shown = F.when(label.isin("•", "▪", "◦"), "").when(label.isin("–", "-"), F.concat(label, F.lit(" "))).otherwise(F.concat(F.regexp_replace(label, r"([.)])$", r"\\$1"), F.lit(" ")))
    return F.concat(F.repeat(F.lit("  "), depth), F.lit("- "), shown, text)


def fallback_row(cells: list[Column]) -> Column:
    """Cells that hold text, joined by an escaped pipe."""
    return F.array_join(F.filter(F.array(*cells), lambda c: c.isNotNull() & (F.trim(c) != "")), " \\| ")


def resolved(texts: DataFrame, key: str, text: str, values: DataFrame) -> DataFrame:
    """(key, resolved, unresolved): `{{kind:id}}` replaced from values (name, value); unknown ones stay and are listed."""
    mark = r"\{\{[a-z]+:[^{}]*\}\}"
    found = F.concat(F.regexp_extract_all(F.col(text), F.lit(mark), F.lit(0)), F.array(F.lit("")))
    pieces = texts.select(key, F.posexplode(F.arrays_zip(F.split(text, mark).alias("plain"), found.alias("name"))).alias("at", "p")).select(key, "at", "p.plain", F.regexp_replace("p.name", r"^\{\{|\}\}$", "").alias("name"), F.col("p.name").alias("raw"))
    known = pieces.join(values, "name", "left")
    part = F.concat("plain", F.coalesce("value", "raw"))
    missing = F.when((F.col("name") != "") & F.col("value").isNull(), F.col("name"))
    grouped = known.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", part.alias("t")))).alias("ps"), F.array_sort(F.collect_set(missing)).alias("unresolved"))
    return grouped.select(key, F.array_join(F.transform("ps", lambda p: p["t"]), "").alias("resolved"), "unresolved")


def outline_numbers(steps: DataFrame, key: str, order: str | list[str], depth: str, levels: int = 3) -> DataFrame:
    """Adds number: dotted counters by depth; each counter starts again below a new parent. Rows of one key and order are
    counted one after the other. All counters run over one sort by key and order."""
    line = Window.partitionBy(key).orderBy(*([order] if isinstance(order, str) else order)).rowsBetween(Window.unboundedPreceding, 0)
    upto, parts = [f"_c{k}" for k in range(1, levels + 1)], [f"_n{k}" for k in range(1, levels + 1)]
    steps = steps.withColumns({c: F.sum(F.when(F.col(depth) == k, 1).otherwise(0)).over(line) for k, c in enumerate(upto, 1)})
    # what a level had counted when the last row above it came
    steps = steps.withColumns({p: F.col(c) - F.coalesce(F.max(F.when(F.col(depth) < k, F.col(c))).over(line), F.lit(0)) for k, (c, p) in enumerate(zip(upto, parts, strict=True), 1)})
    shown = F.array_join(F.slice(F.array(*[F.col(p).cast("string") for p in parts]), F.lit(1), F.col(depth)), ".")
    return steps.withColumn("number", shown).drop(*upto, *parts)


def outside_groups(c: Column, depth: int = 4) -> Column:
    """Text without `{...}` groups, innermost first; `{{...}}` placeholders are masked and stay."""
    c = F.regexp_replace(F.regexp_replace(c, r"\{\{", "\x01"), r"\}\}", "\x02")
    for _ in range(depth):
        c = F.regexp_replace(c, r"\{[^{}]*\}", "")
    return F.regexp_replace(F.regexp_replace(c, "\x01", "{{"), "\x02", "}}")


def unit_texts(sections: DataFrame, doc: str, order: str, level: str, text: str, wanted: Column) -> DataFrame:
    """(doc, unit, unit_text): a wanted section with all that follow until one of its level or above."""
    heads = sections.where(wanted).select(doc, F.col(order).alias("unit"), F.col(level).alias("_level"))
    ends = heads.join(sections.select(doc, F.col(order).alias("_o"), F.col(level).alias("_l")), doc).where((F.col("_o") > F.col("unit")) & (F.col("_l") <= F.col("_level"))).groupBy(doc, "unit").agg(F.min("_o").alias("_end"))
    inside = heads.join(ends, [doc, "unit"], "left").join(sections, doc).where((F.col(order) >= F.col("unit")) & (F.col("_end").isNull() | (F.col(order) < F.col("_end"))))
    return inside.groupBy(doc, "unit").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda p: p["t"]), " ").alias("unit_text"))


def faq_entry(question: Column, answer: Column, sources: Column) -> Column:
    """Heading, answer without runs of blank lines, and the line of sources (an array of links)."""
    single = F.trim(F.regexp_replace(question, r"\r\n|\n|\r", " "))
    heading = F.when(single.startswith("#"), F.concat(F.lit("\\"), single)).otherwise(single)
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(answer), r"\r\n|\r", "\n"), r"[ \t]+(?=\n|$)", ""), r"\n{3,}", "\n\n")
    label = F.when(F.size(sources) == 1, "Źródło: ").otherwise("Źródła: ")
    return F.concat(F.lit("\n## "), heading, F.lit("\n\n"), body, F.lit("\n\n"), label, F.array_join(sources, "; "), F.lit("\n"))


def service_error(status: Column) -> Column:
    """Kind of a model service's failure, null where there is none."""
    return F.when(status.isin(401, 403), "authentication").when(status == 404, "deployment").when(status == 429, "rate").when(status >= 500, "unavailable").when(status == 400, "request")


def _mixed(state: np.ndarray) -> np.ndarray:
    z = state
    z = (z ^ (z >> np.uint64(30))) * MIX_1
    z = (z ^ (z >> np.uint64(27))) * MIX_2
    return z ^ (z >> np.uint64(31))


def fnv1a(text: str) -> int:
    h = FNV_START
    for b in text.encode("utf-8"):
        h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


@F.pandas_udf(LongType())
def split_mix(seed: pd.Series, index: pd.Series) -> pd.Series:
    """Bits of the index-th (from 1) output of the SplitMix64 stream of a seed."""
    s, n = seed.to_numpy(np.int64).view(np.uint64), index.to_numpy(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        return pd.Series(_mixed(s + n * GAMMA).view(np.int64))


@F.pandas_udf(LongType())
def stream_seed(seed: pd.Series, purpose: pd.Series, name: pd.Series) -> pd.Series:
    """Seed of the stream of (seed, purpose, id), the two texts joined by the unit separator."""
    h = np.array([fnv1a(f"{p}\x1f{i}") for p, i in zip(purpose, name, strict=True)], np.uint64)
    with np.errstate(over="ignore"):
        return pd.Series(_mixed((seed.to_numpy(np.int64).view(np.uint64) ^ h) + GAMMA).view(np.int64))


def skip_reason(content: Column) -> Column:
    """Why a page is left out: no content could be read, or it holds no text; null for a page that stays."""
    return F.when(content.isNull(), "read-error").when(F.trim(F.regexp_replace(content, r"<[^>]*>|\s+", " ")) == "", "no-text-layer")


def list_tree(items: DataFrame, key: str, order: str, depth: str, label: str, levels: int = 4) -> DataFrame:
    """Adds parent (order of the last item before it that is less deep) and ancestors (their labels, outermost first)."""
    line = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col(depth) == k, F.struct(F.col(order).alias("o"), F.col(label).alias("l")))).over(line) for k in range(1, levels + 1)]
    items = items.withColumn("_last", F.array(*last))
    above = F.slice("_last", F.lit(1), F.col(depth) - 1)
    open_ = F.filter(above, lambda a, k: a.isNotNull() & ~F.exists(F.slice("_last", F.lit(1), k), lambda b: b.isNotNull() & (b["o"] > a["o"])))
    items = items.withColumn("_open", F.when(F.col(depth) > 1, open_).otherwise(F.slice("_last", 1, 0)))
    return items.withColumn("parent", F.array_max(F.transform("_open", lambda a: a["o"]))).withColumn("ancestors", F.transform("_open", lambda a: a["l"])).drop("_last", "_open")


def words_in_cells(words: DataFrame, pages: DataFrame, page: str) -> DataFrame:
    """Words with the cell of their page that holds their centre and baseline; half-open boxes, so no word has two.
    pages: page, cells (an array of row_no, col_no, left, right, top, bottom), so that no cell is sorted or sent by itself."""
    met = words.join(pages.select(page, "cells"), page).select(*[F.col(c) for c in words.columns], F.inline("cells"))
    inside = (F.col("centre") >= F.col("left")) & (F.col("centre") < F.col("right")) & (F.col("baseline") > F.col("top")) & (F.col("baseline") <= F.col("bottom"))
    return met.where(inside).select(*words.columns, "row_no", "col_no")


def rendered_sections(blocks: DataFrame, key: str, order: str, level: str, heading: str, body: str) -> DataFrame:
    """(key, markdown): headings with their level's marks and their blocks, a blank line between chunks, one final LF."""
    chunk = F.concat(F.repeat(F.lit("#"), F.col(level)), F.lit(" "), F.col(heading), F.when(F.coalesce(F.col(body), F.lit("")) == "", "").otherwise(F.concat(F.lit("\n\n"), F.col(body))))
    gathered = blocks.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), chunk.alias("t")))).alias("_b"))
    return gathered.select(key, F.concat(F.array_join(F.transform("_b", lambda b: b["t"]), "\n\n"), F.lit("\n")).alias("markdown"))


def input_problems(name: Column, markdown: Column, address: Column, tokens: Column, limit: int = 100_000) -> Column:
    """What keeps a document from being used."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    absolute = F.coalesce(address, F.lit("")).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/\s]+")
    return F.array_compact(F.array(F.when(blank(name), "name"), F.when(blank(markdown), "markdown"), F.when(~absolute, "address"), F.when(tokens > limit, "size")))


def parsed_candidates(answers: DataFrame, doc_no: str, json: str) -> DataFrame:
    """(doc_no, id, question, answer, unit, quote) of responses of the closed shape; others give one row with problem set."""
    keys = ["answer", "question", "quote", "unit"]
    item = "struct<question:string,answer:string,unit:string,quote:string>"
    raw = F.from_json(F.get_json_object(json, "$.candidates"), "array<map<string,string>>")
    closed = (F.json_object_keys(json) == F.array(F.lit("candidates"))) & raw.isNotNull() & F.forall(raw, lambda m: F.array_sort(F.map_keys(m)) == F.array(*map(F.lit, keys)))
    good = F.coalesce(closed, F.lit(False))
    rows = answers.select(doc_no, good.alias("_good"), F.posexplode_outer(F.when(good, F.from_json(F.get_json_object(json, "$.candidates"), f"array<{item}>"))).alias("_at", "c"))
    name = F.concat(F.lit("D"), F.col(doc_no).cast("string"), F.lit("-K"), (F.col("_at") + 1).cast("string"))
    return rows.select(doc_no, name.alias("id"), "c.question", "c.answer", F.nullif(F.trim("c.unit"), F.lit("")).alias("unit"), "c.quote", F.when(~F.col("_good"), "shape").alias("problem"))


def layout_for(plans: DataFrame, kind: str, order: str, minimums: list[tuple[str, int]], allowed: list[str]) -> DataFrame:
    """Adds layout: a type's first documents meet the minimums in turn, the others take an allowed one by hash."""
    place = F.row_number().over(Window.partitionBy(kind).orderBy(order))
    plans, chosen, upto = plans.withColumn("_n", place), None, 0
    for name, n in minimums:
        upto += n
        chosen = F.when(F.col("_n") <= upto, name) if chosen is None else chosen.when(F.col("_n") <= upto, name)
    free = F.element_at(F.array(*map(F.lit, allowed)), (F.conv(F.substring(F.md5(F.col(order).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % len(allowed) + 1).cast("int"))
    return plans.withColumn("layout", free if chosen is None else chosen.otherwise(free)).drop("_n")


def optional_blocks(blocks: DataFrame, doc: str, section: str, order: str, least: int, budget: int) -> DataFrame:
    """Blocks taken: every section's minimum first, then one a section in turn until the document's budget is spent."""
    turn = F.row_number().over(Window.partitionBy(doc, section).orderBy(order))
    ranked = blocks.withColumn("_turn", turn)
    taken = F.row_number().over(Window.partitionBy(doc).orderBy(F.col("_turn") > least, "_turn", section))
    return ranked.withColumn("_taken", taken).where((F.col("_turn") <= least) | (F.col("_taken") <= budget)).drop("_turn", "_taken")
