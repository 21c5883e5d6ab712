"""MinHash fingerprints and license scans against brute force."""

import hashlib
import re

from pyspark.sql import functions as F

from quernstone.llm import fingerprints, licenses
from tests.llm.test_text_ops import ODD, frame


def jaccard(a, b):
    s = lambda t: {tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    x, y = s(a), s(b)
    return len(x & y) / len(x | y)


def edits(rows):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    out = []
    for at, k in enumerate(order):
        t, n = rows[k][1] or "", rows[order[(at + 1) % len(order)]][1] or ""
        q = len(t) // 4
        out.append((rows[k][0], t, t[: len(t) - q] + n[:q], n))
    return out


def test_fingerprints(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs).collect()}
    assert len(got) == len(rows)
    errors, same = [], {}
    for i, t, e, n in edits(rows):
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert same.setdefault(t, r.fingerprint) == r.fingerprint and len(r.fingerprint) == 256
        if len(t.split()) > 30:
            errors.append(abs(r.near_edited - jaccard(t, e)))
            assert abs(r.near_next - jaccard(t, n)) < 0.2
    assert sum(errors) / len(errors) < 0.04 and max(errors) < 0.2


def test_next_over_gaps(spark):
    ids = [-5000, -3, 0, 5, 1023, 1024, 2_000_000, 2_000_001, 1 << 40]
    rows = [(i, f"text of {i} " + "x" * (i % 7)) for i in ids]
    got = {r.doc_id: r.edited_sha256 for r in fingerprints.fingerprint_documents(frame(spark, rows)).collect()}
    assert got == {i: hashlib.sha256(e.encode()).hexdigest() for i, _, e, _ in edits(rows)}


def test_fingerprints_odd(spark):
    rows = [r for r in ODD if r[0] != 12]
    got = fingerprints.fingerprint_documents(frame(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.edited_sha256) for r in got) == sorted((i is None, i or 0, hashlib.sha256(e.encode()).hexdigest()) for i, _, e, _ in edits(rows))
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[2].fingerprint == by[3].fingerprint and by[1].near_next == 1.0
    assert fingerprints.fingerprint_documents(frame(spark, ODD)).count() == len(ODD)
    assert fingerprints.fingerprint_documents(frame(spark, [])).count() == 0
    assert fingerprints.fingerprint_documents(frame(spark, ODD[4:5])).count() == 1


def brute_licenses(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    places = [(i, k) for k, p in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({k for _, k in places}))


def check_licenses(rows, got):
    key = lambda x: (x[0] is None, x[0] or 0, str(x))
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=key) == sorted([(i, *brute_licenses(t)) for i, t in rows], key=key)


def brute_labels(text):
    """Labels and score by the definition: votes by diagonal, neighbours merged, spans verified."""
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = {}
    for p in range(len(w) - 1):
        at.setdefault((w[p], w[p + 1]), []).append(p)
    found = []
    for label, phrase, base in [(k, v, True) for k, v in licenses.BASE.items()] + [(k, v, False) for k, v in licenses.NOTICES]:
        words = phrase.split()
        grams = len(words) - 1
        votes = {}
        for t in range(grams):
            for p in at.get((words[t], words[t + 1]), []):
                votes.setdefault(p - t, []).append((t, p))
        clusters, last = [], None
        for d in sorted(d for d, v in votes.items() if len(v) >= min(2, grams)):
            if base or last is None or d - last > licenses.NEIGHBOURS:
                clusters.append([])
            clusters[-1].append(votes[d])
            last = d
        for c in clusters:
            places = [p for v in c for _, p in v]
            whole = max(places) - min(places) < 1.25 * grams + licenses.NEIGHBOURS
            share = (len({t for v in c for t, _ in v}) if whole else max(len(v) for v in c)) / grams
            if share == 1 if base else share >= licenses.LEAST:
                found.append((label, share))
    return ",".join(sorted({k for k, _ in found})), max((s for _, s in found), default=0.0)


def check_labels(rows, got):
    order = lambda x: (x[0] is None, x[0] or 0, *map(str, x[1:]))
    assert sorted([(r.doc_id, r.labels, round(r.score, 9)) for r in got], key=order) == sorted([(i, a, round(b, 9)) for i, t in rows for a, b in [brute_labels(t)]], key=order)


def test_licenses(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = licenses.scan(docs).collect()
    check_labels([(r.doc_id, r.text) for r in docs.collect()], got)
    check_licenses([(r.doc_id, r.text) for r in docs.collect()], got)
    for r in got:
        assert {*r.base_labels.split(",")} - {""} <= {*r.labels.split(",")} and 0 <= r.score <= 1


def test_licenses_odd(spark):
    rows = [
        *ODD, (30, "MIT License mit-license. MIT  licenses"), (31, "the GNU General Public License! general public general public license"), (32, "Apache License" * 3),
        (33, "Licensed under CC BY-NC 4.0."), (34, "mitK license mİt license café mit licenseé"), (30, "mit license"), (35, "mit license"), (35, "mit license"),
        (38, "licensed under the \u212a license; l\u0130cense mit l\u0131cense"), (39, "this source code form is quite subject to the terms of our mozilla public license " * 3),
        (36, "Redistribution and use in source and some binary forms, with or without modification, are permitted"), (37, "of the license " * 400 + "released under the MIT license"),
    ]
    got = licenses.scan(frame(spark, rows)).collect()
    check_licenses(rows, got)
    check_labels(rows, got)
    by = {r.doc_id: r for r in got}
    assert by[33].labels == "cc-by-nc" and by[33].base_labels == "" and by[36].labels == "bsd" and 0.8 <= by[36].score < 1
    assert by[37].labels == "mit" and by[5].labels == "" and by[5].score == 0
    assert licenses.scan(frame(spark, [])).count() == 0


def test_native_plans(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (licenses.scan(docs), fingerprints.fingerprint_documents(docs)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and F


def test_sparse_ids(spark):
    """Ids spread over all longs make as many groups as dense ones."""
    ids = [((i * 0x9E3779B97F4A7C15 + 5) % (1 << 64)) - (1 << 63) for i in range(3000)]
    df = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    assert fingerprints.with_next(df).where("_ghost = 0").select("_group").distinct().count() <= 4
    got = {r.doc_id: r.edited_sha256 for r in fingerprints.fingerprint_documents(df).collect()}
    ordered = sorted(ids)
    import hashlib

    for a, b in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        t = f"text {a}"
        tail = len(t) // 4
        assert got[a] == hashlib.sha256((t[: len(t) - tail] + f"text {b}"[:tail]).encode()).hexdigest()


M64, M32 = (1 << 64) - 1, (1 << 32) - 1


def murmur(values, seed=42):
    """Spark's hash() of whole numbers of 32 bits."""
    turn = lambda x, n: ((x << n) | (x >> (32 - n))) & M32
    h = seed
    for v in values:
        k = turn((v & M32) * 0xCC9E2D51 & M32, 15) * 0x1B873593 & M32
        h = (turn(h ^ k, 13) * 5 + 0xE6546B64) & M32
        h ^= 4
        for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
            h = (h ^ (h >> shift)) * by & M32
    return h - (1 << 32) if h >> 31 else h


def plain_fingerprint(text):
    import xxhash

    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").lower()) if w]
    least = {}
    for i in range(max(1, len(words) - 4) if words else 0):
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(w.encode(), seed=h)
        h = h - (1 << 64) if h >> 63 else h
        b = (h >> 56) + 128
        least[b] = min(least.get(b, h), h)
    if not least:
        return "0" * 256
    digit = {b: f"{h & 15:x}" for b, h in least.items()}
    out = []
    for j in range(256):
        tried = [murmur((j, t)) % 256 for t in range(fingerprints.PROBES)]
        first = next((b for b in [j, *tried] if b in digit), None)
        out.append(digit[first] if first is not None else min((murmur((j, b)), d) for b, d in digit.items())[1])
    return "".join(out)


def test_fingerprints_against_plain(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(80)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(1000 + i, t) for i, t in enumerate(["one", "a b c d e f", "x " * 30, "", None, " ".join(map(str, range(40)))])]
    df = fingerprints.with_fingerprint(spark.createDataFrame(rows, "doc_id long, text string").na.fill(""), "text", "fp")
    assert {r.doc_id: r.fp for r in df.select("doc_id", "fp").collect()} == {i: plain_fingerprint(t) for i, t in rows}
