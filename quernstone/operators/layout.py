"""Operators over the lines of documents: artifacts, headings, paragraphs, trees, numbering.

Line tables have explicit ordinals; every operator partitions by its document key and never depends on row order.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def islands(df: DataFrame, key: list[str], order: list, breaks: Column, out: str) -> DataFrame:
    """Running number of islands: a row where breaks holds opens a new one."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_new", F.coalesce(breaks.cast("int"), F.lit(1))).withColumn(out, F.sum("_new").over(w)).drop("_new")


def modal(df: DataFrame, key: list[str], value: str, weight: Column, order: list[Column], out: str) -> DataFrame:
    """Most frequent value of each key; order settles ties."""
    sums = df.groupBy(*key, value).agg(weight.alias("_weight"))
    best = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("_weight").desc(), *order))
    return sums.withColumn("_r", best).where("_r = 1").select(*key, F.col(value).alias(out), F.col("_weight").alias("weight"))


def page_offset(marks: DataFrame, key: str) -> DataFrame:
    """Modal offset between printed and physical page: by count, then nearest to zero, then smaller."""
    offs = marks.withColumn("offset", F.col("printed") - F.col("physical"))
    return modal(offs, [key], "offset", F.count("*"), [F.abs("offset"), F.col("offset")], "page_offset")


def margin_clusters(lines: DataFrame, set_col: str, page_col: str, min_pages: int = 3, min_share: float = 0.5) -> DataFrame:
    """Running headers and footers: margin lines of one fingerprint on enough pages, or on enough pages of one parity."""
    pages = lines.groupBy(set_col).agg(F.countDistinct(page_col).alias("pages"), F.countDistinct(F.when(F.col(page_col) % 2 == 0, F.col(page_col))).alias("even"))
    found = lines.where("fp <> ''").groupBy(set_col, "zone", "fp").agg(F.countDistinct(page_col).alias("n"), F.count("*").alias("occurrences"), F.countDistinct(F.when(F.col(page_col) % 2 == 0, F.col(page_col))).alias("n_even"), F.array_sort(F.collect_set(page_col)).alias("on_pages"))
    found = found.join(pages, set_col)
    odd = F.col("pages") - F.col("even")
    one = ((F.col("n_even") == F.col("n")) & (F.col("n") >= min_share * F.col("even"))) | ((F.col("n_even") == 0) & (F.col("n") >= min_share * odd))
    return found.where((F.col("n") >= min_pages) & ((F.col("n") >= min_share * F.col("pages")) | one)).select(set_col, "zone", "fp", "occurrences", "on_pages")


def margins(lines: DataFrame) -> DataFrame:
    """First and last line of each document with their zone."""
    w = Window.partitionBy("doc_id")
    n = F.max("line_no").over(w)
    zone = F.when(F.col("line_no") == 0, "header").when(F.col("line_no") == n, "footer")
    return lines.withColumn("zone", zone).where("zone IS NOT NULL").withColumn("fp", T.fingerprint(F.col("line")))


def paragraphs(lines: DataFrame, short: int = 60) -> DataFrame:
    """Lines to paragraphs: a blank line ends one, and so does a short line that ends a sentence."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    before = F.lag("line").over(w)
    broken = before.isNull() | (F.trim(before) == "") | ((F.length(before) < short) & before.rlike(r"[.!?]$"))
    rows = islands(lines.where("trim(line) <> ''"), ["doc_id"], ["line_no"], broken, "block_no")
    return rows.groupBy("doc_id", "block_no").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), " ").alias("text"))


def tree(headings: DataFrame, levels: int = 6) -> DataFrame:
    """Parent of each heading: the last one before it of a smaller level."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    out = headings
    for k in range(1, levels):
        out = out.withColumn(f"_l{k}", F.last(F.when(F.col("level") == k, F.col("ord")), ignorenulls=True).over(w))
    parent = F.greatest(*[F.when(F.col("level") > k, F.col(f"_l{k}")) for k in range(1, levels)], F.lit(None))
    return out.withColumn("parent_ord", parent).drop(*[f"_l{k}" for k in range(1, levels)])


def clamped_levels(headings: DataFrame) -> DataFrame:
    """Levels never more than one below the parent's, folded in document order."""
    rows = headings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "level"))).alias("hs"))
    empty = F.struct(F.array().cast("array<struct<raw:int,level:int>>").alias("open"), F.array().cast("array<struct<ord:bigint,level:int>>").alias("out"))

    def step(s, h):
        open_ = F.filter(s["open"], lambda x: x["raw"] < h["level"])
        level = F.least(h["level"], F.coalesce(F.get(open_, F.size(open_) - 1)["level"], F.lit(0)) + 1).cast("int")
        return F.struct(F.concat(open_, F.array(F.struct(h["level"].cast("int").alias("raw"), level.alias("level")))).alias("open"), F.concat(s["out"], F.array(F.struct(h["ord"].cast("bigint").alias("ord"), level.alias("level")))).alias("out"))

    return rows.select("doc_id", F.explode(F.aggregate("hs", empty, step, lambda s: s["out"])).alias("h")).select("doc_id", "h.ord", "h.level")


def accepted_labels(items: DataFrame, key: list[str]) -> DataFrame:
    """Candidate labels that stand next to their predecessor or successor."""
    w = Window.partitionBy(*key).orderBy("ord")
    near = (F.lag("number").over(w) == F.col("number") - 1) | (F.lead("number").over(w) == F.col("number") + 1)
    return items.withColumn("accepted", F.coalesce(near, F.lit(False)))


def linked_notes(refs: DataFrame, defs: DataFrame, key: list[str]) -> DataFrame:
    """Each reference's first definition of the same label at the same page or later; orphans stay null."""
    d = defs.select(*key, F.col("page").alias("def_page"), F.col("id").alias("def_id"))
    found = refs.join(d, key, "left").where("def_page IS NULL OR def_page >= page")
    best = found.groupBy(*key, "page", "id").agg(F.min(F.struct("def_page", "def_id")).alias("m")).select(*key, "page", "id", "m.def_page", "m.def_id")
    return refs.join(best.select("id", "def_page", "def_id"), "id", "left")


def unique_suffixes(rows: DataFrame, key: list[str], order: str, value: str, out: str, first: int = 1) -> DataFrame:
    """value, value-1, value-2 ... skipping names already taken, in order, inside each key.

    Only values that agree up to their numbers can clash. Where such a family has one value, its rows are numbered by a
    window; the others are gone through in order, with a counter a value.
    """
    family = Window.partitionBy(*key, "_root")
    named = rows.select(*key, F.col(order).cast("long").alias("_o"), F.col(value).alias("_v")).withColumn("_root", F.regexp_replace("_v", r"(-\d+)+$", ""))
    named = named.withColumn("_one", F.min("_v").over(family) == F.max("_v").over(family))
    n = F.row_number().over(family.orderBy("_o")) - 2 + first
    plain = named.where("_one").select(*key, "_o", F.when(n < first, F.col("_v")).otherwise(F.concat("_v", F.lit("-"), n.cast("string"))).alias("_name"))
    types = ", ".join(f"{c} {t}" for c, t in named.select(*key).dtypes)

    def run(_: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by("_o")
        taken: set[str] = set()
        following: dict[str, int] = {}
        names = []
        for v in t["_v"].to_pylist():
            name = v
            while name in taken:
                k = following.get(v, first)
                following[v] = k + 1
                name = f"{v}-{k}"
            taken.add(name)
            names.append(name)
        return t.select([*key, "_o"]).append_column("_name", pa.array(names, pa.string()))

    mixed = named.where("NOT _one").select(*key, "_o", "_v", "_root").groupBy(*key, "_root").applyInArrow(run, f"{types}, _o long, _name string")
    return plain.unionByName(mixed).select(*key, F.col("_o").alias(order), F.col("_name").alias(out))


def column_bands(cells: DataFrame, key: str, position: str, gap: float) -> DataFrame:
    """Bands of positions: a position farther than gap from the band's first one opens a new band."""
    packed = cells.groupBy(key).agg(F.array_sort(F.collect_set(F.col(position).cast("double"))).alias("xs"))
    start = F.array().cast("array<struct<x:double,band:double>>")
    step = lambda s, x: F.concat(s, F.array(F.struct(x.alias("x"), F.when((F.size(s) > 0) & (x - F.element_at(s, -1)["band"] <= gap), F.element_at(s, -1)["band"]).otherwise(x).alias("band"))))
    return packed.select(key, F.explode(F.aggregate("xs", F.when(F.lit(True), start), step)).alias("b")).select(key, F.col("b.x").alias(position), F.dense_rank().over(Window.partitionBy(key).orderBy("b.band")).alias("band"))


def gfm_rows(rows: DataFrame, cells: list[str]) -> DataFrame:
    """Rows as GitHub tables."""
    return rows.withColumn("md", F.concat(F.lit("| "), F.concat_ws(" | ", *[T.escape_markdown(F.col(c).cast("string"), in_table=True) for c in cells]), F.lit(" |")))
