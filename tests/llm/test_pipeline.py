"""The pipeline, stage by stage on each stage's own input, against brute force."""

import corpus_pipeline
from quernstone.llm import quality
from tests.llm.test_near_copies import brute_groups, split
from tests.llm.test_repeats import keyed
from tests.llm.test_text_ops import check_packing, reference_ids  # noqa: F401


def brute_strip(rows, w=50):
    first = {}
    for i, x in keyed(rows):
        for s in range(len(x) - w + 1):
            first[x[s : s + w]] = min(first.get(x[s : s + w], i), i)
    out = {}
    for i, x in keyed(rows):
        gone = [False] * len(x)
        for s in range(len(x) - w + 1):
            if first[x[s : s + w]] < i:
                gone[s : s + w] = [True] * w
        chars, at = [], 0
        for c in x.decode():
            n = len(c.encode())
            chars.append(c if not all(gone[at : at + n]) else "")
            at += n
        out[i] = "".join(chars)
    return out


def test_stages(spark, sf, tmp_path, reference_ids):  # noqa: F811
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, kept = [n for n, _ in corpus_pipeline.STAGES], {}
    now = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf)
        assert k == len(names) - 1 or out.columns == docs.columns
        out.write.parquet(f"file://{tmp_path}/{k}")
        kept[name] = (now, now := spark.read.parquet(f"file://{tmp_path}/{k}"))
    pairs = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    before, after = kept[names[0]]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in quality.classify(before).where("keep").collect()}
    before, after = kept[names[1]]
    rows = pairs(before)
    assert sorted(r.doc_id for r in after.collect()) == sorted(min(rows[i][0] for i in g) for g in split(brute_groups([t for _, t in rows])))
    before, after = kept[names[2]]
    assert dict(pairs(after)) == brute_strip(pairs(before)) and all(r.n_chars == len(r.text) for r in after.collect())
    before, after = kept[names[3]]
    check_packing(pairs(before), after.collect(), reference_ids)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
