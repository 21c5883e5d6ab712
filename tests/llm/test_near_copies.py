"""The near-duplicate stage keeps one row of each group, whatever the ids are."""

import random

import numpy as np
import pytest

import corpus_pipeline
from quernstone.llm import similar, simhash


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(texts):
    sets, label = [shingle_set(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if not (a or b) or 5 * len(a & b) >= 4 * len(a | b):
                label = [label[j] if x == label[i] else x for x in label]
    return label


def split(labels):
    out = {}
    for i, x in enumerate(labels):
        out.setdefault(x, []).append(i)
    return sorted(out.values())


def edited(r, words, times):
    words = list(words)
    for _ in range(times):
        words[r.randrange(len(words))] = f"new{r.randrange(10**9)}"
    return words


@pytest.fixture(scope="module")
def families():
    r = random.Random(3)
    texts = [None, "", " ", "a", "A", "a b c", "a b c d e", "a b c d e f"]
    for size in (30, 120, 600):
        for _ in range(6):
            base = [f"w{r.randrange(5000)}" for _ in range(size)]
            texts += [" ".join(base), " ".join(base).upper()] + [" ".join(edited(r, base, r.randint(1, max(1, size // 25)))) for _ in range(6)]
    return texts


@pytest.mark.parametrize(("hot_bucket", "hot_cluster"), [(2, 3), (4096, 2048)])
def test_groups_are_those_of_brute_force(spark, families, hot_bucket, hot_cluster):
    df = spark.createDataFrame(list(enumerate(families)), "row long, text string")
    root = {r.row: r.root for r in similar.groups(df, "row", "text", hot_bucket, hot_cluster).collect()}
    assert split([root[i] for i in range(len(families))]) == split(brute_groups(families))


def test_stage_drops_near_copies(spark, sf, families):
    docs = spark.createDataFrame(list(enumerate(families)), "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, docs, sf).collect()
    assert sorted(r.doc_id for r in got) == [g[0] for g in split(brute_groups(families))]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(min(rows[i][0] for i in g) for g in split(brute_groups([t for _, t in rows])))


def test_empty(spark, sf):
    assert corpus_pipeline.near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string"), sf).count() == 0


@pytest.mark.parametrize("keep_one", [simhash.keep_one, similar.keep_one])
def test_keep_one_odd_ids(spark, keep_one):
    rows = [(None, "a lone text that has no id at all"), (7, "first of two unlike texts under one id"), (7, "the second has nothing in common with it"), (8, "x y z w"), (None, "x y z w"), (8, "x y z w")]
    got = keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted((i or 0, t) for i, t in rows[:4])


def test_radius_holds_similar_sets():
    """Sets at a similarity of 0.8 stay within the radius that chooses pairs."""
    rng = np.random.default_rng(1)
    lost = 0
    for size in (9, 45, 450):
        for _ in range(2000):
            both = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            own = rng.integers(0, 1 << 63, size // 4, dtype=np.uint64)
            a, b = np.concatenate((both, own[: len(own) // 2])), np.concatenate((both, own[len(own) // 2 :]))
            lost += (simhash.majority(a) ^ simhash.majority(b)).bit_count() > similar.RADIUS
    assert lost <= 3


def test_columns_break_ties(spark):
    rows = [(1, "same words here", "b"), (1, "same words here", "a"), (2, "other words", "c")]
    a, b = (similar.keep_one(spark.createDataFrame(x, "doc_id long, text string, tag string")).collect() for x in (rows, rows[::-1]))
    assert sorted(a) == sorted(b) and len(a) == 2
