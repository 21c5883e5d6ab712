"""Documents to retrieval chunks of limited size with stable keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass(frozen=True)
class ChunkOptions:
    max_length: int = 2000

    def __post_init__(self):
        if self.max_length < 200:
            raise ValueError("max_length must be 200 at least")


def segment(designation: Column, heading: Column) -> Column:
    return F.rtrim(F.regexp_replace(T.squeeze(F.coalesce(F.nullif(F.trim(designation), F.lit("")), heading)), r"\.+$", ""))


def unit_keys(units: DataFrame, series: str = "series") -> DataFrame:
    """series | shortest path suffix unique in the document (else the full path), #n from the second on.

    units: series, doc_id, unit_ord, path. A path shorter than a suffix length counts with its full path at that length.
    """
    deepest = F.max(F.size("path")).over(Window.partitionBy("doc_id"))
    u = units.withColumn("_deep", deepest)
    tail = lambda n: F.array_join(F.slice("path", -F.least(n, F.size("path")), F.least(n, F.size("path"))), " > ")
    each = u.select("doc_id", "unit_ord", F.size("path").alias("own"), F.posexplode(F.transform(F.sequence(F.lit(1), F.col("_deep")), tail)).alias("p", "suffix"))
    count = F.count("*").over(Window.partitionBy("doc_id", "p", "suffix"))
    best = each.withColumn("n", count).where("n = 1 AND p + 1 < own").groupBy("doc_id", "unit_ord").agg(F.min_by("suffix", "p").alias("suffix"))
    out = units.join(best, ["doc_id", "unit_ord"], "left").withColumn("suffix", F.coalesce("suffix", F.array_join("path", " > ")))
    n = F.row_number().over(Window.partitionBy("doc_id", "suffix").orderBy("unit_ord"))
    return out.withColumn("unit_key", F.concat(F.col(series), F.lit(" | "), F.col("suffix"), F.when(n > 1, F.concat(F.lit(" #"), n)).otherwise(""))).drop("suffix")


def chunk_id(doc_id: Column, key: Column, part: Column) -> Column:
    return F.concat_ws("_", doc_id.cast("string"), F.substring(F.sha2(key, 256), 1, 16), part.cast("string"))


def packed_parts(text: Column, limit: int) -> Column:
    """Non-blank lines joined by a blank line while they fit; a lone longer line stays alone."""
    atoms = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    step = lambda s, a: F.when((F.size(s) > 0) & (F.length(F.element_at(s, -1)) + 2 + F.length(a) <= limit), F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.concat(F.element_at(s, -1), F.lit("\n\n"), a)))).otherwise(F.concat(s, F.array(a)))
    return F.aggregate(atoms, F.array().cast("array<string>"), step)


def chunk_documents(docs: DataFrame, options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """One preamble unit a document, packed into parts. All in one pass, no shuffle."""
    key = F.concat(F.col("source"), F.lit("-"), F.col("doc_id").cast("string"), F.lit(" | ~preamble"))
    parts = docs.select("doc_id", key.alias("unit_key"), packed_parts(F.col("text"), options.max_length).alias("parts"))
    rows = parts.select("doc_id", "unit_key", F.size("parts").alias("part_count"), F.posexplode("parts").alias("p", "content"))
    return rows.select(chunk_id(F.col("doc_id"), F.col("unit_key"), F.col("p") + 1).alias("chunk_id"), "doc_id", "unit_key", (F.col("p") + 1).alias("part"), "part_count", F.length("content").alias("length"), (F.length("content") > options.max_length).alias("exceeds_limit"), "content")


CHUNK_JSON = "schemaVersion INT, document STRUCT<id: STRING>, chunk STRUCT<id: STRING, unitKey: STRING, part: INT, partCount: INT, listLabels: ARRAY<STRING>, length: INT, exceedsLimit: BOOLEAN, content: STRING>, _bad STRING"


def to_json_lines(chunks: DataFrame) -> DataFrame:
    """One JSON object a chunk, fixed field order, no nulls, empty arrays kept."""
    body = F.struct(F.col("chunk_id").alias("id"), F.col("unit_key").alias("unitKey"), "part", F.col("part_count").alias("partCount"), F.array().cast("array<string>").alias("listLabels"), "length", F.col("exceeds_limit").alias("exceedsLimit"), "content")
    return chunks.select(F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.struct(F.col("doc_id").cast("string").alias("id")).alias("document"), body.alias("chunk"))).alias("value"))


def from_json_lines(lines: DataFrame, newest: int = 1) -> DataFrame:
    """Parsed chunk records with the problem of each that can't be read; blank lines are skipped."""
    r = F.from_json("value", CHUNK_JSON, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.where("trim(value) <> ''").select("value", r.alias("r"))
    problem = F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), "malformed").when(F.col("r.schemaVersion").isNull() | (F.col("r.schemaVersion") > newest), "schema").when(F.col("r.chunk.id").isNull() | F.col("r.chunk.content").isNull(), "missing field")
    return rows.select("r.document", "r.chunk", problem.alias("problem"))


def version_changes(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """added, removed, changed or same by key."""
    a, b = old.select(F.col(key), F.col(value).alias("old_value")), new.select(F.col(key), F.col(value).alias("new_value"))
    kind = F.when(F.col("old_value").isNull(), "added").when(F.col("new_value").isNull(), "removed").when(F.col("old_value") != F.col("new_value"), "changed").otherwise("same")
    return a.join(b, key, "full").withColumn("change", kind)
