"""Unit packing, item choice, manifests, stages and sinks on small fixtures and against plain versions."""

import json
import random

import pytest

from quernstone.operators import selection, units
from quernstone.queries_units import tables
from quernstone.sources import manifests


def atom(kind, text, **more):
    return {"kind": kind, "text": text, "table": None, "header": None, "depth": None, "label": None, "refs": [], "number": None} | more


def test_rendering():
    some = [atom("paragraph", "one", refs=[2]), atom("row", "| a |", table=1, header="| h |"), atom("row", "| b |", table=1, header="| h |"), atom("item", "x", depth=2, label="1)"), atom("item", "y", depth=3), atom("note", "loose", number=5)]
    assert units.rendered("H", some, {2: "two", 5: "five", 7: "not here"}) == "H\n\none\n\n| h |\n| a |\n| b |\n\n1) x\n  - y\n\n[^2]: two\n\n[^5]: five"
    assert units.rendered("", some[2:3], {}) == "| h |\n| b |"


def plain_split(heading, whole, notes, limit):
    if len(units.rendered(heading, whole, notes)) <= limit:
        return [whole]
    parts, current = [], []
    for a in whole:
        if current and len(units.rendered(heading, [*current, a], notes)) > limit:
            parts.append(current)
            current = []
        current.append(a)
    return [*parts, current]


def test_greedy_parts_against_plain():
    r = random.Random(1)
    for _ in range(200):
        whole = [r.choice([atom("paragraph", "p" * r.randint(1, 90), refs=[r.randint(1, 3)]), atom("row", "r" * r.randint(1, 30), table=r.randint(1, 2), header="head"), atom("item", "i" * r.randint(1, 30), depth=r.randint(0, 2))]) for _ in range(r.randint(0, 25))]
        notes = {1: "n" * 20, 2: "m"}
        assert units.split_unit("H", whole, notes, 120) == plain_split("H", whole, notes, 120)


def test_unit_parts(spark, sf):
    sections, blocks, notes = tables(spark, sf)
    atoms = units.atoms(units.collect_units(sections, blocks, notes), blocks, notes)
    got = {(r.doc_id, r.section_ord, r.part): r for r in units.chunk_units(atoms, notes, 600).collect()}
    known, groups, heads = {}, {}, {}
    for n in notes.collect():
        known.setdefault((n.doc_id, n.section_ord), {})[n.number] = n.text
    for a in atoms.collect():
        heads[a.doc_id, a.section_ord] = a.heading
        if a.atom_ord is not None:
            groups.setdefault((a.doc_id, a.section_ord), []).append(a.asDict())
    seen = 0
    for key, heading in heads.items():
        whole = sorted(groups.get(key, []), key=lambda a: a["atom_ord"])
        parts = plain_split(heading or "", whole, known.get(key, {}), 600)
        for i, some in enumerate(parts):
            r = got[(*key, i + 1)]
            assert r.content == units.rendered(heading or "", some, known.get(key, {})) and r.part_count == len(parts) and r.exceeds_limit == (len(r.content) > 600)
            assert (r.first_page, r.last_page) == ((min(a["page"] for a in some), max(a["page"] for a in some)) if some else (None, None))
            assert r.labels == ([some[0]["label"]] if i and some and some[0]["kind"] == "item" and some[0]["label"] else [])
            seen += 1
    assert seen == len(got) > 100


@pytest.mark.parametrize(
    ("items", "total", "least", "most", "taken"),
    [
        ([["a"], ["a"], ["a"], ["b"]], 3, 1, 2, "xx.x"),
        ([["a"], ["a", "b"], ["b"], ["c"]], 3, 1, 2, "xx.x"),  # the merged item is b's minimum
        ([["a", "b"], ["a", "b"], ["a"], ["b"]], 4, 1, 2, "xxxx"),  # charged to one document each
        ([["a"], ["a"], ["a"]], 5, 0, 2, "xx."),
        ([["b"], ["a"], ["b"], ["a"]], 2, 2, 3, "x.x."),  # documents in order of appearance
        ([], 3, 1, 1, ""),
    ],
)
def test_choice_of_merged_items(spark, items, total, least, most, taken):
    documents = dict.fromkeys(d for x in items for d in x)
    assert "".join("x" if t else "." for t in selection.choose(items, documents, total, least, most)) == taken
    if items:
        rows = selection.quota_choice(spark.createDataFrame([("s", k, d) for k, d in enumerate(items)], "set string, k long, documents array<string>"), total, least, most).collect()
        assert "".join("x" if r.chosen else "." for r in sorted(rows, key=lambda r: r.k)) == taken


def test_run_parameters():
    made = manifests.RunParameters.parse('{"seed": 3, "documents": 5}')
    assert manifests.RunParameters.parse(made.dump()) == made and json.loads(made.dump())["output"] == "out"
    with pytest.raises(ValueError, match="unknown fields: x"):
        manifests.RunParameters.parse('{"seed": 3, "documents": 5, "x": 1}')
    for path in ("/abs", "a/../b"):
        with pytest.raises(ValueError, match="relative"):
            manifests.RunParameters.parse(json.dumps({"seed": 1, "documents": 1, "output": path}))


def test_text_sink_and_bad_manifest(spark, tmp_path):
    path = f"file://{tmp_path}/md"
    df = spark.createDataFrame([("# a",), ("# b",)], "value string")
    manifests.write_texts(df, "value", path)
    manifests.write_texts(df.limit(1), "value", path)
    assert spark.read.text(path).count() == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        manifests.read_manifest(spark.createDataFrame([("{x",)], "value string"), "a INT").collect()


def test_plan():
    from quernstone.plans.stages import Plan

    class Frame(list):
        def transform(self, stage):
            return stage(self)

    put = lambda x: lambda rows: Frame([*rows, x])
    plan = Plan().add(200, "b", put("b")).add(100, "a", put("a")).add(300, "c", put("c"))
    assert plan.run(Frame()) == ["a", "b", "c"]
    assert plan.swap("b", put("B")).run(Frame()) == ["a", "B", "c"] and plan.without("a").run(Frame()) == ["b", "c"]
    assert plan.run(Frame()) == ["a", "b", "c"]


def test_chunk_file_and_stream(spark, sf, tmp_path):
    from quernstone.operators.chunking import ChunkOptions, chunk_documents
    from quernstone.sources.jsonl import read_chunks, write_chunks
    from quernstone.streaming.ingest import chunk_stream

    with pytest.raises(ValueError, match="200"):
        ChunkOptions(100)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    chunks = chunk_documents(docs, ChunkOptions(500))
    assert chunks.where("part_count > 1").count() > 0
    write_chunks(chunks, f"file://{tmp_path}/chunks")
    want = {r.chunk_id: (r.part, r.content, r.exceeds_limit) for r in chunks.collect()}
    back = read_chunks(spark, f"file://{tmp_path}/chunks")
    assert {r.chunk.id: (r.chunk.part, r.chunk.content, r.chunk.exceedsLimit) for r in back.collect()} == want and back.where("problem IS NOT NULL").count() == 0
    schema = docs.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    for part, rows in enumerate((docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), docs.limit(0))):
        rows.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        chunk_stream(spark, f"file://{tmp_path}/in", schema, f"file://{tmp_path}/out", f"file://{tmp_path}/state", ChunkOptions(500)).awaitTermination(120)
    got = spark.read.parquet(f"file://{tmp_path}/out")
    assert {r.chunk_id: (r.part, r.content, r.exceeds_limit) for r in got.collect()} == want and got.count() == len(want)


def test_units_are_streamed_and_rarely_rendered(spark, monkeypatch):
    plan = units.chunk_units(spark.createDataFrame([], f"{units.ATOM}"), spark.createDataFrame([], "doc_id long, section_ord long, number long, page long, text string"), 50)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapCoGroups" not in plan
    rows = [(1, s, "H", o, "paragraph", "x" * 20, o, None, None, None, None, [1] if o == 2 else [], None) for s in (1, 2) for o in range(2500)] + [(1, 3, "only", *[None] * 10)]
    notes = spark.createDataFrame([(1, 1, 1, 0, "one"), (1, 2, 1, 0, "two"), (1, 2, 9, 0, "not here"), (1, 4, 1, 0, "no unit")], "doc_id long, section_ord long, number long, page long, text string")
    got = {(r.section_ord, r.part): r for r in units.chunk_units(spark.createDataFrame(rows, units.ATOM), notes, 50).collect()}
    many = len(plain_split("H", [atom("paragraph", "x" * 20, refs=[1] if o == 2 else []) for o in range(2500)], {1: "one"}, 50))
    assert len(got) == 2 * many + 1 and got[3, 1].content == "only" and got[1, 2].notes == got[2, 2].notes == [1]
    assert got[1, 2].content.endswith("[^1]: one") and got[2, 2].content.endswith("[^1]: two") and got[2, many].part_count == got[2, 1].part_count == many
    seen, plain = [], units.rendered
    monkeypatch.setattr(units, "rendered", lambda *a: seen.append(1) or plain(*a))
    units.split_unit("H", [atom("paragraph", "x" * 20) for _ in range(1000)], {}, 600)
    assert len(seen) < 80
    assert len(units.split_unit("", [atom("note", "n" * 90, number=1)] * 3, {1: "m"}, 50)) == 1
