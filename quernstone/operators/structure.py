"""Headings, titles, footnotes, side notes, cells and labels over tables of lines and cells.

A line table has doc_id, page, n (order in the document), text, size, bold, centered and baseline (down the page). Every
operator works by windows inside a document or page, or as a projection; none depends on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .layout import islands

MAX_HEADING = 120
MAX_LINES = 3
ENLARGED = 1.15
GAP = 1.3
SMALL = 0.85
RAISED = 0.15
NOTE_GAP = 1.8
HANGING = 2.0
COLUMN_SHARE = 0.75
#: Words that open the title of an act.
ACT_TYPES = ("ustawa", "rozporządzenie", "uchwała", "zarządzenie", "obwieszczenie", "regulamin", "taryfa", "statut")


def excluded(text: Column) -> Column:
    """Lines that never are headings: leader dots of a table of contents, quoted text, captions, sentences cut by a comma or semicolon."""
    return text.rlike(r"\.{4,}|…{2,}") | text.rlike(r'^\s*[„"«]') | F.lower(text).rlike(r"^\s*(rys|rysunek|tabela|wykres)\b[. ]*[0-9]") | F.trim(text).rlike(r"[,;]$")


def heading_candidates(lines: DataFrame, body_size: float, leading: float) -> DataFrame:
    """Adds enlarged, isolated and candidate: short isolated lines with a letter that are larger, bold, in capitals or centred."""
    w = Window.partitionBy("doc_id", "page").orderBy("n")
    above = F.col("baseline") - F.lag("baseline").over(w)
    enlarged = F.col("size") >= ENLARGED * body_size
    capitals = (F.upper("text") == F.col("text")) & (F.lower("text") != F.col("text"))
    isolated = above.isNull() | (above > GAP * leading)
    short = (F.length("text") <= MAX_HEADING) & F.col("text").rlike(r"\p{L}")
    stands_out = enlarged | F.col("bold") | capitals | F.col("centered")
    return lines.withColumns({"enlarged": enlarged, "isolated": isolated, "candidate": short & isolated & stands_out & ~excluded(F.col("text"))})


def headings(lines: DataFrame, body_size: float, leading: float) -> DataFrame:
    """(doc_id, n, page, text, n_lines): candidates with the lines that go on in their style, close below, up to MAX_LINES and MAX_HEADING."""
    rows = heading_candidates(lines, body_size, leading)
    w = Window.partitionBy("doc_id", "page").orderBy("n")
    same = (F.lag("size").over(w) == F.col("size")) & (F.lag("bold").over(w) == F.col("bold")) & (F.col("enlarged") | F.col("bold"))
    goes_on = ~F.col("candidate") & same & (F.col("baseline") - F.lag("baseline").over(w) <= GAP * leading) & ~F.trim("text").rlike(r"[,;]$")
    rows = islands(rows, ["doc_id", "page"], ["n"], ~F.coalesce(goes_on, F.lit(False)), "run")
    inside = Window.partitionBy("doc_id", "page", "run").orderBy("n")
    rows = rows.withColumns({"at": F.row_number().over(inside), "first": F.first("candidate").over(inside), "long": F.sum(F.length("text") + 1).over(inside) - 1})
    kept = rows.where(F.col("first") & (F.col("at") <= MAX_LINES) & ((F.col("at") == 1) | (F.col("long") <= MAX_HEADING)))
    return kept.groupBy("doc_id", "page", "run").agg(F.min("n").alias("n"), ordered_text("n", "text", " ").alias("text"), F.count("*").alias("n_lines")).drop("run")


def ordered_text(order: str, text: str, between: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda r: r["t"]), between)


def titles(lines: DataFrame, body_size: float, leading: float) -> DataFrame:
    """(doc_id, n, text): the first isolated line of the first page that opens with an act type, else the first line where it is the largest candidate."""
    rows = heading_candidates(lines, body_size, leading).where(F.trim("text") != "")
    whole = Window.partitionBy("doc_id")
    act = F.lower("text").rlike(r"^\s*(" + "|".join(ACT_TYPES) + r")\b") & F.col("isolated") & (F.col("page") == F.min("page").over(whole))
    largest = F.max(F.when(F.col("candidate") & F.col("enlarged"), F.col("size"))).over(whole)
    first = (F.col("n") == F.min("n").over(whole)) & F.col("candidate") & F.col("enlarged") & (F.col("size") >= largest)
    found = rows.withColumn("rank", F.when(act, 1).when(first, 2)).where("rank IS NOT NULL")
    return found.withColumn("r", F.row_number().over(whole.orderBy("rank", "n"))).where("r = 1").select("doc_id", "n", "text")


def joined_lines(lines: Column) -> Column:
    """Lines as one text: the hyphen at a line's end goes or stays by T.hyphen_join, other lines are set apart by a space.
    The rule sees the last word alone, and only where that ends in a hyphen, so it doesn't go over the text again for each line."""

    def step(whole, line):
        rule = F.array(T.hyphen_join(F.substring_index(whole, " ", -1), line))
        joined = F.transform(rule, lambda r: F.when(r == "REMOVE", F.concat(F.left(whole, F.length(whole) - 1), line)).when(r == "KEEP", F.concat(whole, line)).otherwise(F.concat_ws(" ", whole, line)))
        return F.when(whole == "", line).when(line == "", whole).when(~whole.endswith("-"), F.concat_ws(" ", whole, line)).otherwise(F.get(joined, F.lit(0)))

    return F.aggregate(F.transform(lines, lambda x: F.trim(x)), F.lit(""), step)


def note_definitions(lines: DataFrame, body_size: float) -> DataFrame:
    """(doc_id, page, label, n, text): notes in the small lines that end a page; unlabelled ones go on with the note above."""
    w = Window.partitionBy("doc_id", "page").orderBy(F.col("n").desc())
    small = lines.withColumn("big", F.sum((F.col("size") > SMALL * body_size).cast("int")).over(w)).where("big = 0 AND trim(text) <> ''")
    label = F.nullif(F.regexp_extract("text", r"^\s*(\d{1,3}|\*{1,3})\)?\s", 1), F.lit(""))
    rows = islands(small.withColumn("label", label), ["doc_id", "page"], ["n"], F.col("label").isNotNull(), "note")
    found = rows.groupBy("doc_id", "page", "note").agg(F.min("n").alias("n"), F.max("label").alias("label"), F.array_sort(F.collect_list(F.struct("n", "text"))).alias("ls"))
    body = F.regexp_replace(joined_lines(F.transform("ls", lambda r: r["text"])), r"^\s*(\d{1,3}|\*{1,3})\)?\s+", "")
    return found.where("label IS NOT NULL").select("doc_id", "page", "label", "n", body.alias("text"))


def note_marker(text: Column, size: Column, rise: Column, body_size: Column) -> Column:
    """Whether a run of glyphs is a reference: small, raised, and a short number or asterisks."""
    return (size <= SMALL * body_size) & (rise >= RAISED * body_size) & F.trim(text).rlike(r"^(\d{1,3}|\*{1,3})\)?$")


def side_notes(lines: DataFrame) -> DataFrame:
    """(doc_id, page, n, text, n_lines): lines of one page within NOTE_GAP sizes below the one before form a note."""
    w = Window.partitionBy("doc_id", "page").orderBy("n")
    gap = F.col("baseline") - F.lag("baseline").over(w)
    near = (gap > 0) & (gap <= NOTE_GAP * F.lag("size").over(w))
    rows = islands(lines, ["doc_id", "page"], ["n"], ~F.coalesce(near, F.lit(False)), "note")
    return rows.groupBy("doc_id", "page", "note").agg(F.min("n").alias("n"), ordered_text("n", "text", " ").alias("text"), F.count("*").alias("n_lines")).drop("note")


def line_cells(segments: DataFrame, key: list[str], size: str = "size") -> DataFrame:
    """Segments of a line as cells: a bullet or 1) a) label joins what follows; 1. 1/ a/ only within HANGING sizes. Of labels in a row every second one joins."""
    w = Window.partitionBy(*key).orderBy("left")
    sure = F.col("text").rlike(r"^([•◦▪‣]|\d{1,3}\)|\p{Ll}{1,2}\))$")
    hanging = F.col("text").rlike(r"^(\d{1,3}[./]|\p{Ll}[./]|[ivx]+\.)$") & (F.lead("left").over(w) - F.col("right") <= HANGING * F.col(size))
    rows = segments.withColumn("is_label", F.coalesce(sure | hanging, F.lit(False)))
    rows = islands(rows, key, ["left"], ~F.col("is_label") | ~F.coalesce(F.lag("is_label").over(w), F.lit(False)), "streak")
    nth = F.row_number().over(Window.partitionBy(*key, "streak").orderBy("left"))
    rows = rows.withColumn("opens", F.col("is_label") & (nth % 2 == 1))
    rows = islands(rows, key, ["left"], ~F.coalesce(F.lag("opens").over(w), F.lit(False)), "cell")
    return rows.groupBy(*key, "cell").agg(ordered_text("left", "text", " ").alias("text"), F.min("left").alias("left"), F.max("right").alias("right"))


def merged_cells(lines: DataFrame, key: list[str]) -> DataFrame:
    """(key, row, column, text, is_header): the lines of each cell joined; a first row all in bold heads a table of several rows."""
    cells = lines.groupBy(*key, "row", "column").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("ls"), F.min(F.col("bold").cast("int")).alias("b"))
    row = Window.partitionBy(*key, "row")
    table = Window.partitionBy(*key)
    first = F.min("row").over(table)
    header = (F.col("row") == first) & (F.min("b").over(row) == 1) & (F.max("row").over(table) > first)
    return cells.select(*key, "row", "column", joined_lines(F.transform("ls", lambda r: r["text"])).alias("text"), header.alias("is_header"))


def text_columns(cells: DataFrame, key: list[str], start: float, end: float) -> DataFrame:
    """Regions that are two columns of text and no table: no cell crosses the gutter's middle, or none spans it and most lines have a cell a side at most."""
    middle = (start + end) / 2
    on_left = F.col("left") < middle
    lines = cells.groupBy(*key, "line").agg(
        F.count(F.when(on_left, 1)).alias("n_left"), F.count(F.when(~on_left, 1)).alias("n_right"),
        F.min(((F.col("right") <= middle) | ~on_left).cast("int")).alias("apart"), F.min(((F.col("right") <= end) | (F.col("left") >= start)).cast("int")).alias("free"),
    )
    text_line = F.count(F.when((F.col("n_left") <= 1) & (F.col("n_right") <= 1), 1))
    both = (F.sum("n_left") > 0) & (F.sum("n_right") > 0)
    ragged = (text_line >= COLUMN_SHARE * F.count("*")) & (F.min("free") == 1)
    return lines.groupBy(*key).agg((both & ((F.min("apart") == 1) | ragged)).alias("is_text"))


def font_bullet(word: Column, family: Column, next_family: Column) -> Column:
    """A lone o in a font family of its own is a bullet."""
    return F.coalesce((word == "o") & (family != next_family), F.lit(False))


def heading_like(lines: DataFrame, leading: float, title_size: float) -> DataFrame:
    """Adds heading_like: bold labelled lines, but for labels of points and bullets and for text that runs on in lower case."""
    w = Window.partitionBy("doc_id", "page").orderBy("n")
    point = F.col("text").rlike(r"^\s*(\d{1,3}[)/]|\p{Ll}{1,2}[)/.]|[ivx]+\.|[-–•])\s")
    labelled = point | F.col("text").rlike(r"^\s*(\d{1,3}\.|§ ?\d+|[IVX]+\.)\s")
    follows = F.lead(F.col("text").rlike(r"^\p{Ll}") & ~labelled).over(w) & (F.lead("baseline").over(w) - F.col("baseline") <= GAP * leading)
    runs_on = F.coalesce(follows, F.lit(False)) & (F.col("size") <= title_size)
    return lines.withColumn("heading_like", F.col("bold") & labelled & ~point & ~runs_on)


def trimmed_artifacts(lines: DataFrame, members: DataFrame, key: str, shortest: int = 5) -> DataFrame:
    """Lines of a set without the first confirmed artifact text (SHORTEST characters or more) that stands in them as whole words."""
    m = members.where(F.length("member") >= shortest).select(F.col(key).alias("_set"), "member", "ordinal")
    hit = (F.col("_set") == F.col(key)) & F.concat(F.lit(" "), T.squeeze(F.col("text")), F.lit(" ")).contains(F.concat(F.lit(" "), F.col("member"), F.lit(" "))) & (T.squeeze(F.col("text")) != F.col("member"))
    found = lines.join(m, hit).groupBy("line_id").agg(F.min(F.struct("ordinal", "member"))["member"].alias("member"))
    rest = F.trim(T.squeeze(F.replace(F.concat(F.lit(" "), T.squeeze(F.col("text")), F.lit(" ")), F.concat(F.lit(" "), F.col("member"), F.lit(" ")), F.lit("  "))))
    return lines.join(found, "line_id", "left").withColumn("text", F.when(F.col("member").isNull(), F.col("text")).otherwise(rest)).drop("member")


def skipped_page(page: Column, reason: Column) -> Column:
    """Comment in place of a page that was not read."""
    return F.when(reason.isNotNull(), F.concat(F.lit("<!-- page "), page.cast("string"), F.lit(": skipped, "), reason, F.lit(" -->")))


def flattened(nodes: DataFrame, depth: int) -> DataFrame:
    """(id, depth, path) of a forest (id, parent, ord) down to depth, level by level; deeper nodes are left out."""
    level = nodes.where("parent IS NULL").select("id", F.lit(0).alias("depth"), F.array(F.col("ord").cast("long")).alias("path"))
    out = level
    for k in range(1, depth + 1):
        child = nodes.select(F.col("id").alias("c_id"), F.col("parent").alias("c_parent"), F.col("ord").cast("long").alias("c_ord"))
        level = level.join(child, F.col("id") == F.col("c_parent")).select(F.col("c_id").alias("id"), F.lit(k).alias("depth"), F.concat("path", F.array("c_ord")).alias("path"))
        out = out.unionByName(level)
    return out
