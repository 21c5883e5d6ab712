"""Exact top-k against brute force; the quality classifier on held-out labels."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from quernstone.llm import quality, topk
from tests.llm.test_text_ops import ODD, frame


def brute_topk(rows, k=5, step=50):
    ok = {}
    out = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.setdefault(len(ok), (i, [math.floor(256 * x) for x in v]))
    for q, v in {(i, tuple(v)) for i, v in ok.values() if i % step == 0}:
        s = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in ok.values() if i != q)[:k]
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return sorted(out)


def test_topk_table(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in e.collect()]
    got = topk.top_k(e, e.where("vec_id % 50 = 0")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_topk(rows)


def test_topk_odd(spark):
    r = random.Random(3)
    rows = [(i, [r.choice([-0.5, 0.1, 0.9]) for _ in range(6)]) for i in range(120)]
    rows += [(150, None), (151, [0.1, None]), (152, [float("nan")] * 6), (153, [float("inf")] + [0.0] * 5), (154, [0.25]), (155, []), (None, [1.0] * 6), (7, [0.9] * 6), (7, [0.9] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit(1)).withColumn("score", F.lit("x"))
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = topk.top_k(df, df.where("vec_id % 50 = 0")).collect()
    assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in got) == brute_topk(exact)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_topk_large_values(spark):
    """Components beyond 2^25 (sums round in doubles) and up to 2^40 (products don't fit 64 bits)."""
    r = random.Random(11)
    rows = [(i, [float(r.choice([-1, 1]) * (2**25 + r.randrange(2**20))) for _ in range(4)]) for i in range(200)]
    rows += [(200 + i, [r.choice([2.0**40, -(2.0**40), 2.0**20 + i, 0.5]), 2.0**r.randint(0, 14)]) for i in range(50) if i]
    rows = [(i, v if i % 50 else [float(r.randrange(-(2**18), 2**18)) for _ in range(4)]) for i, v in rows]
    rows = [(i, [x / 256 for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), shard_rows=64).collect()
    assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in got) == brute_topk(rows)


def test_search_is_exact_where_sums_round():
    rng = np.random.default_rng(3)
    wrong = 0
    for size in (2**25, 2**40, 2**200):
        x = np.floor(rng.uniform(-1, 1, (400, 4)) * size)
        x[100:] = x[:300] + rng.integers(-1, 2, (300, 4))
        q = np.floor(rng.uniform(-1, 1, (20, 4)) * size)
        a, b, s = topk.search(np.arange(400), x, np.arange(1000, 1020), q, 5)
        for i in range(20):
            want = sorted((-sum(int(u) * int(v) for u, v in zip(q[i], w, strict=True)), j) for j, w in enumerate(x))[:5]
            wrong += [(-int(v), int(j)) for j, v in zip(b[a == i], s[a == i], strict=True)] != want
    assert wrong == 0


def test_topk_shards(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 0.1) for _ in range(12)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), shard_rows=16).collect()
    assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in got) == brute_topk(rows)


def test_search_many_ties():
    ids = np.arange(5000)
    x = np.repeat(np.arange(10)[:, None], 500, axis=0).reshape(5000, 1) * np.ones((1, 4), np.int32)
    a, b, s = topk.search(ids, x.astype(np.int32), np.array([4999]), np.full((1, 4), 3, np.int32), 5)
    assert b.tolist() == [4500, 4501, 4502, 4503, 4504] and s.tolist() == [108] * 5 and a.tolist() == [0] * 5


def test_quality_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.classify(docs).join(labels, "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.keep for r in good) / len(good) > 0.98
    assert sum(not r.keep for r in bad) / len(bad) > 0.95
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and 8000 < kept.count() < 9500


def test_quality_odd(spark):
    got = quality.classify(frame(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(frame(spark, [])).count() == 0
    assert quality.keep_good(frame(spark, ODD)).columns == ["doc_id", "text", "fp", "start", "bin"]


def test_em_finds_accuracies():
    r = random.Random(11)
    counts = {}
    acc = [0.95, 0.9, 0.8, 0.7, 0.9, 0.85]
    for _ in range(20000):
        y = r.random() < 0.7
        code = sum((int(y == (r.random() < a)) if r.random() < 0.8 else 2) * 3**i for i, a in enumerate(acc))
        counts[code] = counts.get(code, 0) + 1
    prior, table, _ = quality.expectation_maximisation(counts)
    assert abs(prior - 0.7) < 0.05
    for i, a in enumerate(acc):
        assert abs(table[i, 1, 1] / (table[i, 1, 0] + table[i, 1, 1]) - a) < 0.05
