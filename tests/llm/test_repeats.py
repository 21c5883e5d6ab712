"""Repeated phrases and byte strings against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import phrases, suffixes
from tests.llm.test_text_ops import ODD, frame


def keyed(rows):
    return [(float("-inf") if i is None else i, (t or "").encode()) for i, t in rows]


def brute_phrases(rows, w=20):
    first = {}
    docs = [(i, t.split()) for i, t in keyed(rows)]
    for i, x in docs:
        for s in range(len(x) - w + 1):
            k = tuple(x[s : s + w])
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for i, x in docs:
        gone = np.zeros(len(x), bool)
        for s in range(len(x) - w + 1):
            if first[tuple(x[s : s + w])] < (i, s):
                gone[s : s + w] = True
        kept = b" ".join(v for v, g in zip(x, gone, strict=True) if not g)
        out.append((None if i == float("-inf") else i, len(x), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_bytes(rows, w=50):
    first = {}
    docs = keyed(rows)
    for i, x in docs:
        for s in range(len(x) - w + 1):
            k = x[s : s + w]
            first[k] = min(first.get(k, i), i)
    out = []
    for i, x in docs:
        gone = np.zeros(len(x) + 1, bool)
        for s in range(len(x) - w + 1):
            if first[x[s : s + w]] < i:
                gone[s : s + w] = True
        gone = gone[:-1]
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        spans = sum(1 for p in range(len(x)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((None if i == float("-inf") else i, len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def spliced(seed, n=60):
    """Documents made of shared passages, near copies, runs of one word and zeros."""
    r = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(40)]
    passages = [[r.choice(vocabulary) for _ in range(r.randint(15, 60))] for _ in range(8)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(r.randint(0, 5)):
            words += r.choice(passages) if r.random() < 0.6 else [r.choice(vocabulary) for _ in range(r.randint(1, 30))]
        if r.random() < 0.2:
            words += ["same"] * r.randint(1, 120)
        if words and r.random() < 0.3:
            words[r.randrange(len(words))] = "edit\0"
        rows.append((r.randint(0, 200) if r.random() < 0.95 else None, " ".join(words) + "\n" * r.randint(0, 2)))
    return [*rows, *rows[:5], *ODD]


def got_phrases(df, **k):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in phrases.repeats(df, **k).collect()), key=str)


def got_bytes(df, **k):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.repeats(df, **k).collect()), key=str)


@pytest.mark.parametrize("size", [(1 << 21, 1 << 22), (4000, 6000)])
def test_spliced(spark, size):
    rows = spliced(7)
    df = frame(spark, rows)
    assert got_phrases(df, chunk_bytes=size[0], shard_bytes=size[1]) == brute_phrases(rows)
    assert got_bytes(df, chunk_bytes=size[0], shard_bytes=size[1]) == brute_bytes(rows)


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got_phrases(docs, chunk_bytes=30_000, shard_bytes=100_000) == brute_phrases(rows)
    assert got_bytes(docs, chunk_bytes=30_000, shard_bytes=100_000) == brute_bytes(rows)


def test_empty(spark):
    assert got_phrases(frame(spark, [])) == [] and got_bytes(frame(spark, [])) == []


def test_kept_text(spark):
    long = "é" * 60 + " tail one"
    rows = [(1, long), (2, "x" + "é" * 60 + " tail two"), (3, "other")]
    df = frame(spark, rows).withColumn("n_chars", F.lit(5)).withColumn("c0", F.lit("c"))
    got = suffixes.without_repeats(df)
    assert got.columns == df.columns and got.dtypes == df.dtypes
    assert {r.doc_id: (r.text, r.n_chars) for r in got.collect()} == {1: (long, 69), 2: ("xtwo", 4), 3: ("other", 5)}
    words = [(1, " ".join(f"a{i}" for i in range(25))), (2, "before " + " ".join(f"a{i}" for i in range(25)) + " after")]
    assert {r.doc_id: r.kept for r in phrases.repeats(frame(spark, words), with_text=True).collect()} == {1: words[0][1], 2: "before after"}


@pytest.mark.parametrize("window", [50, 31, 8, 3])
def test_suffix_array_and_prefixes(window):
    r = random.Random(2)
    parts = [bytes(r.choice(b"ab\0") for _ in range(r.randint(50, 90))) for _ in range(40)]
    parts += [p[:55] for p in parts[:10]] + [b"a" * 70]
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(parts) + bytes(66), np.uint8)
    end = np.repeat(ends, sizes)
    order = suffixes.suffix_array(data, end, window)
    assert sorted(order.tolist()) == [i for i in range(len(end)) if end[i] - i >= window]
    head = [data[i : i + window].tobytes() for i in order]
    assert head == sorted(head)
    prefix = suffixes.kasai(data, ends - sizes, sizes - window + 1, order, window)
    for k in range(1, len(order)):
        a, b = head[k - 1], head[k]
        assert prefix[k] == next((i for i in range(window) if a[i] != b[i]), window)


def test_blocks_merge_by_binary_search():
    r = random.Random(4)
    make = lambda: bytes(r.choice(b"ab") for _ in range(r.randint(50, 70)))
    shared = [make() for _ in range(20)]
    rows = [([*{*(r.choice(shared) if r.random() < 0.5 else make() for _ in range(30))}], None, None) for _ in range(4)]
    rows = [(c, np.array([r.randint(0, 99) for _ in c]), np.zeros(len(c), np.int64)) for c, _, _ in rows]
    whole = suffixes.resolve(rows)
    for size in (200, 1000):
        assert all((a == b).all() for a, b in zip(whole, suffixes.resolve(rows, block_bytes=size), strict=True))


def test_automata_shards():
    r = random.Random(6)
    text = "".join(r.choice("abc") for _ in range(400))
    passages = [*{text[s : s + n] for s, n in [(3, 20), (3, 26), (50, 21), (200, 30), (210, 20), (380, 20)]}]
    expected = {(i, s) for i, p in enumerate(passages) for s in range(len(text)) if text.startswith(p, s)}
    for most in (1, 3, 100):
        assert {(i, s) for found in phrases.occurrences(text, 1, passages, most) for i, s in zip(*(x.tolist() for x in found), strict=True)} == expected


def test_wide_codes():
    words = [[f"w{i}".encode() for i in range(30)], [b"w3", b"w4"]]
    codes, _ = phrases.coded(words)
    text = phrases.as_text(codes + 70_000, 2)
    found = list(phrases.occurrences(text, 2, [phrases.as_text(codes[3:5] + 70_000, 2)]))
    assert sorted(found[0][1].tolist()) == [3, 31]


def test_unlike_windows_of_one_hash(monkeypatch):
    monkeypatch.setattr(phrases, "gram_hashes", lambda codes, k: np.zeros(len(codes) - k + 1, np.uint64))
    codes = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3])
    kind = phrases.classes(codes, np.array([0, 1, 3, 6]), 3)
    assert kind[0] == kind[3] and len({*kind.tolist()}) == 3


def test_hot_passage_and_long_text(spark):
    """One passage in a third of all documents, one anchor word around it, and texts of 20 MB without and with spaces."""
    r = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"{r.random()} {passage} {r.random()}" if i % 3 == 0 else f"{r.random()} " * 25) for i in range(300)]
    df = frame(spark, rows)
    assert got_phrases(df, chunk_bytes=2000, shard_bytes=4000) == brute_phrases(rows)
    assert got_bytes(df, chunk_bytes=2000, shard_bytes=4000) == brute_bytes(rows)
    unit = "".join(f"{r.random()}" for _ in range(55_000))
    long = [(1, unit), (2, "x" * 1000 + unit * 20), (3, "a b " * 200_000)]
    assert len(long[1][1]) > 19_000_000
    found = {x[0]: x for x in got_bytes(frame(spark, long))}
    assert found[1][2] == 0 and found[2][2] == 20 * len(unit) and found[3][2] == 0
    found = {x[0]: x for x in got_phrases(frame(spark, long))}
    assert found[3][1:3] == (400_000, 400_000 - 2) and found[2][2] == 0


def test_parts_of_a_shard(spark, monkeypatch):
    monkeypatch.setattr(suffixes.passages, "PART_BYTES", 300)
    rows = spliced(9)
    df = frame(spark, rows)
    assert got_phrases(df, chunk_bytes=4000, shard_bytes=60_000) == brute_phrases(rows)
    assert got_bytes(df, chunk_bytes=4000, shard_bytes=60_000) == brute_bytes(rows)


def test_rows_grow_with_the_input():
    """Chunks times shards stays in proportion to the input beyond SCALE_BYTES."""
    from quernstone.llm.passages import CHUNK_BYTES, SHARD_BYTES, counts_for

    rows = lambda total: int(np.prod(counts_for(total, CHUNK_BYTES, SHARD_BYTES)))
    assert rows(64 << 30) / rows(1 << 30) < 70 and rows(512 << 30) / rows(1 << 30) < 530
