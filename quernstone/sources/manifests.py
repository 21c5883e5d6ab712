"""JSON sinks and sources: manifests, reports and run parameters, and text files by Spark's commit protocol."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def manifest(rows: DataFrame, order: str, columns: list[str], kinds: str | None = None) -> DataFrame:
    """(ord, value): one JSON object a row, null fields left out; the error kind of column kinds in kebab case."""
    kebab: dict[str, Column] = {kinds: F.lower(F.regexp_replace(kinds, r"(?<=[a-z0-9])([A-Z])", "-$1"))} if kinds else {}
    return rows.select(F.col(order).alias("ord"), F.to_json(F.struct(*[kebab.get(c, F.col(c)).alias(c) for c in columns])).alias("value"))


def nested_manifest(parents: DataFrame, children: DataFrame, key: str, order: str, columns: list[str], child_columns: list[str]) -> DataFrame:
    """(key, value): each parent with its children in order as one JSON object; parents without children have an empty list."""
    inner = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in child_columns if c != order]))).alias("_items"))
    items = F.coalesce(F.transform("_items", lambda r: F.struct(*[r[c].alias(c) for c in child_columns])), F.array())
    return parents.join(inner, key, "left").select(key, F.to_json(F.struct(*columns, items.alias("items")), {"ignoreNullFields": "true"}).alias("value"))


def read_manifest(lines: DataFrame, schema: str) -> DataFrame:
    """The objects of a manifest; lines that don't fit the schema are an error."""
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def write_texts(rows: DataFrame, value: str, path: str) -> None:
    """Text files, visible all at once when the job commits."""
    rows.select(F.col(value).alias("value")).write.mode("overwrite").text(path)


@dataclass(frozen=True)
class RunParameters:
    """Recorded parameters of a run; unknown fields and absolute paths are errors."""

    seed: int
    documents: int
    output: str = "out"

    @classmethod
    def parse(cls, text: str) -> RunParameters:
        given = json.loads(text)
        unknown = sorted({*given} - {f.name for f in fields(cls)})
        if unknown:
            raise ValueError(f"unknown fields: {', '.join(unknown)}")
        made = cls(**given)
        if made.output.startswith("/") or ".." in made.output.split("/"):
            raise ValueError("output must be a relative path")
        return made

    def dump(self) -> str:
        return json.dumps({f.name: getattr(self, f.name) for f in fields(self)}, indent=2)
