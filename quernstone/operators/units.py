"""Structured documents to chunks: units of sections, atoms of blocks, greedy packing, notes and pages.

Tables (all keyed by doc_id):
    sections  section_ord, parent_ord, heading                       pre-order; section_ord -1 is the preamble and has no row
    blocks    section_ord, block_ord, kind, text, page, table, header, depth, label, refs
              kind: paragraph, row (of a table, with its header line), item (of a list, with depth and label) or skipped
    notes     section_ord, number, page, text

A unit is a section's own content. It is one part if it fits whole; else its atoms fill parts greedily, each part rendered
with the heading, the table header regained where rows go on, and the notes that its blocks refer to.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PREAMBLE = -1
ATOM = "doc_id long, section_ord long, heading string, atom_ord long, kind string, text string, page long, table long, header string, depth int, label string, refs array<long>, number long"
PART = "doc_id long, section_ord long, part int, part_count int, first_page long, last_page long, labels array<string>, notes array<long>, exceeds_limit boolean, content string"


def collect_units(sections: DataFrame, blocks: DataFrame, notes: DataFrame) -> DataFrame:
    """(doc_id, section_ord, heading): the preamble where it holds anything, and sections with content of their own or without subsections."""
    content = blocks.where("kind <> 'skipped'").select("doc_id", "section_ord").union(notes.select("doc_id", "section_ord")).distinct()
    parents = sections.where("parent_ord IS NOT NULL").select("doc_id", F.col("parent_ord").alias("section_ord")).distinct()
    own = sections.join(content, ["doc_id", "section_ord"], "left_semi")
    leaf = sections.join(parents, ["doc_id", "section_ord"], "left_anti").join(content, ["doc_id", "section_ord"], "left_anti")
    preamble = content.where(F.col("section_ord") == PREAMBLE).select("doc_id", "section_ord", F.lit("").alias("heading"))
    return own.unionByName(leaf).select("doc_id", "section_ord", "heading").unionByName(preamble)


def atoms(units: DataFrame, blocks: DataFrame, notes: DataFrame) -> DataFrame:
    """A unit's blocks, rows and items in order, then the notes that it never refers to, by number. Items never go back a page."""
    key = ["doc_id", "section_ord"]
    own = blocks.where("kind <> 'skipped'")
    breaks = F.max("page").over(Window.partitionBy(*key, "kind").orderBy("block_ord"))
    page = F.when(F.col("kind") == "item", breaks).otherwise(F.col("page"))
    first = own.select(*key, F.col("block_ord").alias("atom_ord"), "kind", "text", page.alias("page"), "table", "header", "depth", "label", "refs", F.lit(None).cast("long").alias("number"))
    cited = own.select(*key, F.explode("refs").alias("number")).distinct()
    loose = notes.join(cited, [*key, "number"], "left_anti")
    last = loose.select(*key, (F.lit(1 << 40) + F.col("number")).alias("atom_ord"), F.lit("note").alias("kind"), "text", "page", *[F.lit(None).cast(t).alias(c) for c, t in (("table", "long"), ("header", "string"), ("depth", "int"), ("label", "string"))], F.array().cast("array<long>").alias("refs"), "number")
    return units.join(first.unionByName(last), key, "left")


def rendered(heading: str, some: list[dict], notes: dict[int, str]) -> str:
    """Heading, blocks and notes as text: rows under their table's header, items indented from the shallowest one."""
    out, table = [heading] if heading else [], None
    least = min((a["depth"] or 0 for a in some if a["kind"] == "item"), default=0)
    lines: list[str] = []
    for a in some:
        joins = bool(lines) and (a["kind"] == "row" and a["table"] == table or a["kind"] == "item" and table == "list")
        if not joins and lines:
            out.append("\n".join(lines))
            lines = []
        if a["kind"] == "row":
            if a["table"] != table and a["header"]:
                lines.append(a["header"])
            lines.append(a["text"])
            table = a["table"]
        elif a["kind"] == "item":
            lines.append("  " * ((a["depth"] or 0) - least) + (f"{a['label']} " if a["label"] else "- ") + a["text"])
            table = "list"
        elif a["kind"] != "note":
            out.append(a["text"])
            table = None
    if lines:
        out.append("\n".join(lines))
    cited = {n for a in some for n in a["refs"] or []} | {a["number"] for a in some if a["kind"] == "note"}
    return "\n\n".join([*out, *(f"[^{n}]: {notes[n]}" for n in sorted(cited) if n in notes)])


def split_unit(heading: str, whole: list[dict], notes: dict[int, str], limit: int) -> list[list[dict]]:
    """The atoms of each part. Bounds of the rendered length are added up atom by atom; only what lies between them is rendered."""
    shallowest = min((a["depth"] or 0 for a in whole if a["kind"] == "item"), default=0)

    def most(a: dict) -> int:
        n = len(a["text"]) + 2
        if a["kind"] == "row":
            n += len(a["header"] or "") + 1
        elif a["kind"] == "item":
            n += 2 * ((a["depth"] or 0) - shallowest) + len(a["label"] or "-") + 1
        return n + sum(len(f"\n\n[^{k}]: ") + len(notes[k]) for k in [*(a["refs"] or []), a["number"]] if k in notes)

    def fits(some: list[dict], least: int, upto: int) -> bool:
        return upto <= limit or least <= limit and len(rendered(heading, some, notes)) <= limit

    # a note's own text is rendered with its number alone
    sizes = [(0 if a["kind"] == "note" else len(a["text"]), most(a)) for a in whole]
    top = len(heading) + 2
    if fits(whole, sum(n for n, _ in sizes), top + sum(m for _, m in sizes)):
        return [whole]
    parts: list[list[dict]] = []
    current: list[dict] = []
    least, upto = 0, top
    for a, (n, m) in zip(whole, sizes, strict=True):
        if current and not fits([*current, a], least + n, upto + m):
            parts.append(current)
            current, least, upto = [], 0, top
        current.append(a)
        least, upto = least + n, upto + m
    return [*parts, current]


def unit_rows(doc_id: int, section_ord: int, heading: str | None, whole: list[dict], known: dict[int, str], limit: int) -> list[tuple]:
    """The rows of one unit's parts. Its atoms are in order."""
    parts = split_unit(heading or "", whole, known, limit)
    out = []
    for i, some in enumerate(parts):
        pages = [a["page"] for a in some if a["page"] is not None]
        content = rendered(heading or "", some, known)
        label = [some[0]["label"]] if i and some and some[0]["kind"] == "item" and some[0]["label"] else []
        cited = sorted(({n for a in some for n in a["refs"] or []} | {a["number"] for a in some if a["kind"] == "note"}) & {*known})
        out.append((doc_id, section_ord, i + 1, len(parts), min(pages, default=None), max(pages, default=None), label, cited, len(content) > limit, content))
    return out


def chunk_units(units_atoms: DataFrame, notes: DataFrame, limit: int) -> DataFrame:
    """The parts of every unit. Notes and atoms are sorted by unit and read in one stream a task, so a task holds one unit
    and a batch of parts at a time, and a unit costs no exchange of its own with Python."""
    key = ["doc_id", "section_ord"]
    names = [f.split()[0] for f in ATOM.split(", ")]

    columns = [*names, "is_note"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0

        def packed() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), SCHEMA, strict=True)], schema=SCHEMA)

        slices = (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024))
        rows = (dict(zip(columns, r, strict=True)) for b in slices for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for (doc_id, section_ord), unit in groupby(rows, key=lambda r: (r["doc_id"], r["section_ord"])):
            known, whole, heading, found = {}, [], None, False
            for r in unit:
                if r["is_note"]:
                    known[r["number"]] = r["text"]
                    continue
                if not found:
                    heading, found = r["heading"], True
                if r["atom_ord"] is not None:
                    whole.append(r)
            if not found:
                continue
            more = unit_rows(doc_id, section_ord, heading, whole, known, limit)
            out += more
            size += sum(len(x[-1]) for x in more)
            if size > BATCH:
                yield packed()
                out, size = [], 0
        if out:
            yield packed()

    atom = units_atoms.select(*names, F.lit(False).alias("is_note"))
    types = dict(atom.dtypes)
    note = notes.select(*[c if c in (*key, "number", "text") else F.lit(None).cast(types[c]).alias(c) for c in names], F.lit(True).alias("is_note"))
    ordered = atom.unionByName(note).repartition(*key).sortWithinPartitions(*key, F.desc("is_note"), F.asc_nulls_last("atom_ord"))
    return ordered.mapInArrow(run, PART)


#: Characters of parts that are sent back at once.
BATCH = 4_000_000
SCHEMA = pa.schema([("doc_id", pa.int64()), ("section_ord", pa.int64()), ("part", pa.int32()), ("part_count", pa.int32()), ("first_page", pa.int64()), ("last_page", pa.int64()), ("labels", pa.list_(pa.string())), ("notes", pa.list_(pa.int64())), ("exceeds_limit", pa.bool_()), ("content", pa.string())])
