"""Queries of the unit operators: sentences of documents stand in for blocks, rows, items and notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import units as U
from .queries_text import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


SENTENCES = "(SELECT doc_id, unnest(range(len(ls)))::BIGINT AS n, unnest(ls) AS text, len(ls) AS many FROM (SELECT doc_id, string_split(coalesce(text, ''), '. ') AS ls FROM documents))"
SECTIONS = f"(SELECT doc_id, n // 10 AS section_ord, CASE WHEN (n // 10) % 3 <> 0 THEN (n // 10) // 3 * 3 END AS parent_ord, substr(text, 1, 20) AS heading FROM {SENTENCES} WHERE n % 10 = 0)"
BLOCKS = f"""(SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND n < 10 THEN -1 ELSE n // 10 END AS section_ord, n AS block_ord, CASE WHEN n % 10 < 3 THEN 'paragraph' WHEN n % 10 < 6 THEN 'row' WHEN n % 10 < 8 THEN 'item' ELSE 'skipped' END AS kind, text, (n + doc_id) % 7 + n // 10 AS page, CASE WHEN n % 4 = 0 THEN [n % 3 + 1] ELSE [] END AS refs
    FROM {SENTENCES} WHERE n // 10 % 3 <> 0 OR doc_id % 2 = 0 OR doc_id % 3 = 0 AND n < 10)"""
NOTES = f"(SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND n < 10 THEN -1 ELSE n // 10 END AS section_ord, n % 10 - 6 AS number, n // 10 AS page, substr(text, 1, 30) AS text FROM {SENTENCES} WHERE n % 10 IN (7, 8, 9) AND doc_id % 5 <> 0)"


def tables(spark, sf):
    """(sections, blocks, notes)."""
    s = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\. ")).alias("n", "text"))
    n, at, ten = F.col("n").cast("long"), F.col("n") % 10, F.floor(F.col("n") / 10)
    section = F.when((F.col("doc_id") % 3 == 0) & (n < 10), F.lit(-1)).otherwise(ten)
    sections = s.where(at == 0).select("doc_id", ten.alias("section_ord"), F.when(ten % 3 != 0, F.floor(ten / 3) * 3).alias("parent_ord"), F.substring("text", 1, 20).alias("heading"))
    kind = F.when(at < 3, "paragraph").when(at < 6, "row").when(at < 8, "item").otherwise("skipped")
    some = (ten % 3 != 0) | (F.col("doc_id") % 2 == 0) | ((F.col("doc_id") % 3 == 0) & (n < 10))
    blocks = s.where(some).select(
        "doc_id", section.alias("section_ord"), n.alias("block_ord"), kind.alias("kind"), "text", ((n + F.col("doc_id")) % 7 + ten).alias("page"), ten.alias("table"), F.when(at < 6, F.lit("| h |")).alias("header"), (at - 6).cast("int").alias("depth"),
        F.when(at == 6, F.concat(n.cast("string"), F.lit(")"))).alias("label"), F.when(n % 4 == 0, F.array(n % 3 + 1)).otherwise(F.array().cast("array<bigint>")).alias("refs"),
    )
    notes = s.where(at.isin(7, 8, 9) & (F.col("doc_id") % 5 != 0)).select("doc_id", section.alias("section_ord"), (at - 6).cast("long").alias("number"), ten.alias("page"), F.substring("text", 1, 30).alias("text"))
    return sections, blocks, notes


UNITS = f"""(SELECT doc_id, section_ord, heading FROM {SECTIONS} s WHERE (doc_id, section_ord) IN (SELECT (doc_id, section_ord) FROM {BLOCKS} WHERE kind <> 'skipped' UNION ALL SELECT (doc_id, section_ord) FROM {NOTES}) OR (doc_id, section_ord) NOT IN (SELECT (doc_id, parent_ord) FROM {SECTIONS} WHERE parent_ord IS NOT NULL)
    UNION ALL SELECT DISTINCT doc_id, section_ord, '' FROM (SELECT doc_id, section_ord FROM {BLOCKS} WHERE kind <> 'skipped' UNION ALL SELECT doc_id, section_ord FROM {NOTES}) WHERE section_ord = -1)"""


@query(f"SELECT * FROM {UNITS}")
def b04_document_units(spark, sf):
    return U.collect_units(*tables(spark, sf))


@query(f"""WITH b AS (SELECT doc_id, section_ord, block_ord AS atom_ord, kind, CASE WHEN kind = 'item' THEN max(page) OVER (PARTITION BY doc_id, section_ord, kind ORDER BY block_ord) ELSE page END AS page FROM {BLOCKS} WHERE kind <> 'skipped'),
    c AS (SELECT DISTINCT doc_id, section_ord, unnest(refs) AS number FROM {BLOCKS} WHERE kind <> 'skipped'),
    l AS (SELECT n.doc_id, n.section_ord, (1::BIGINT << 40) + n.number AS atom_ord, 'note' AS kind, page FROM {NOTES} n ANTI JOIN c ON n.doc_id = c.doc_id AND n.section_ord = c.section_ord AND n.number = c.number),
    a AS (SELECT * FROM b UNION ALL SELECT * FROM l)
    SELECT u.doc_id, u.section_ord, atom_ord, kind, page FROM {UNITS} u LEFT JOIN a ON u.doc_id = a.doc_id AND u.section_ord = a.section_ord""")
def b08_b13_b14_b15_atoms(spark, sf):
    sections, blocks, notes = tables(spark, sf)
    return U.atoms(U.collect_units(sections, blocks, notes), blocks, notes).select("doc_id", "section_ord", "atom_ord", "kind", "page")


@query()
def b09_b10_b11_b12_unit_parts(spark, sf):
    sections, blocks, notes = tables(spark, sf)
    return U.chunk_units(U.atoms(U.collect_units(sections, blocks, notes), blocks, notes), notes, 600)
