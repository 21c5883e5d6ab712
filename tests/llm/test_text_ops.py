"""SimHash, packing and byte-level BPE against brute force."""

import base64
import hashlib
import random
import zlib
from array import array

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from quernstone.llm import bpe, packing, simhash

ODD = [
    (1, None), (2, ""), (3, " "), (4, "a"), (5, "a b"), (6, "One two Three four"), (7, "one TWO three  four\n"), (8, "x" * 3000), (9, "word " * 900),
    (10, "  b　 c  d   e\n\n  f \x1c g\x85h"), (11, "café Été naïve \U0001f600\U0001f600 1234 'll don't"), (None, "no id here at all"), (12, "a b"), (12, "a b"), (13, "tab\tand\x0bvt \r\n end  "),
]


def frame(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    return df.withColumn("fp", F.lit("clash")).withColumn("start", F.lit(7)).withColumn("bin", F.lit(1))


def brute_simhash(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fps = [brute_simhash(t) for _, t in rows]
    ids = [i for i, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    arr = np.array(fps, np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 2):
            root[find(int(j))] = find(i)
    best = {}
    for k, i in enumerate(ids):
        if i is not None:
            best[find(k)] = min(best.get(find(k), i), i)
    return sorted((i is None, i or 0, f"{f:016x}", best.get(find(k))) for k, (i, f) in enumerate(zip(ids, fps, strict=True)))


def test_simhash_odd(spark):
    got = simhash.near_duplicates(frame(spark, ODD)).withColumn("fingerprint", simhash.hex_fingerprint()).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in got) == brute_components(ODD)


def test_simhash_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = simhash.near_duplicates(docs).withColumn("fingerprint", simhash.hex_fingerprint()).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in got) == brute_components(rows)


def test_simhash_empty(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("members", [40, 700])
def test_bucket_links_lose_nothing(members):
    r = random.Random(members)
    base = r.getrandbits(64)
    fps = {base}
    while len(fps) < members:
        x = r.choice(sorted(fps)) if r.random() < 0.5 else base
        for _ in range(r.randint(1, 3)):
            x ^= 1 << r.randrange(64)
        fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    u, v = simhash.bucket_links(np.zeros(len(fps), np.int64), fps)
    parent = {int(f): int(f) for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(u, v, strict=True):
        parent[find(int(a))] = find(int(b))
    got = [find(int(f)) for f in fps]
    parent = {int(f): int(f) for f in fps}
    for f in fps:
        for g in fps[np.bitwise_count(fps ^ f) <= 2]:
            parent[find(int(f))] = find(int(g))
    want = [find(int(f)) for f in fps]
    pairs = {}
    assert all(pairs.setdefault(a, b) == b for a, b in zip(got, want, strict=True)) and len(set(got)) == len(set(want))


def test_simhash_keep_one(spark):
    rows = [(5, "aa bb cc dd"), (3, "aa bb cc dd"), (3, "aa bb cc dd"), (9, "something else entirely here")]
    assert sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [3, 9]


@pytest.fixture(scope="module")
def reference_ids():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def check_packing(rows, got, ids_of, fill=None):
    want = []
    for i, t in rows:
        ids = [*ids_of(t), 1]
        want += [(i is None, i or 0, at, min(2048, len(ids) - at), zlib.crc32(array("I", ids[at : at + 2048]).tobytes()), len(ids)) for at in range(0, len(ids), 2048)]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == sorted(want)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    if fill:
        assert sum(r.length for r in got) / (2048 * len(seqs)) > fill


def test_packing(spark, sf, reference_ids):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check_packing([(r.doc_id, r.text) for r in docs.collect()], packing.packed(docs).collect(), reference_ids, 0.97)
    added = [(30, "a <|endoftext|> b"), (31, "foo<|endoftext|>bar<|endoftext|>"), (32, "<|endoftext|>"), (33, "x \n <|endoftext|>\u3000<|endoftext|  y<|<|endoftext|>"), (34, "z" * 5000 + " " + "9" * 700)]
    check_packing([*ODD, *added], packing.packed(frame(spark, [*ODD, *added])).collect(), reference_ids)
    assert packing.packed(frame(spark, [])).count() == 0


def test_best_fit_is_tightest():
    r = random.Random(1)
    lengths = sorted((r.randint(1, 2048) for _ in range(800)), reverse=True)
    where, offset = packing.best_fit(lengths)
    room = []
    for n, s, o in zip(lengths, where, offset, strict=True):
        fits = [x for x in room if x >= n]
        if fits:
            assert room[s] == min(fits) and o == 2048 - room[s]
        else:
            assert s == len(room) and o == 0
            room.append(2048)
        room[s] -= n


@pytest.fixture(scope="module")
def multi():
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize(("chunk", "overlap"), [(32768, 256), (64, 8), (17, 5)])
def test_bpe(spark, multi, chunk, overlap):
    path, enc = multi
    rows = [*ODD, (20, "abc def  ghi\n\n" * 50), (21, "z" * 300 + "   " * 60 + "q"), (22, "it's we'll I'd 've " * 9)]
    got = bpe.encode_documents(frame(spark, rows), path, P.PATTERN, chunk_chars=chunk, overlap=overlap).collect()
    want = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i is None, i or 0, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)


def test_bpe_table(spark, sf, multi):
    path, enc = multi
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: hashlib.sha256(array("I", enc.encode_ordinary(r.text)).tobytes()).hexdigest() for r in docs.collect()}
    for size in (32768, 500):
        assert {r.doc_id: r.ids_sha256 for r in bpe.encode_documents(docs, path, P.PATTERN, chunk_chars=size, overlap=64).collect()} == want


def test_simhash_hot_buckets(spark):
    """Buckets over the bound give the same components as comparing every pair."""
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    for base in fps[:3]:
        at = base
        for _ in range(60):
            at ^= (1 << int(rng.integers(0, 24))) | (1 << int(rng.integers(0, 24)))
            fps.append(at)
    fps = sorted({*fps})
    label = {f: f for f in fps}

    def top(f):
        while label[f] != f:
            f = label[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                label[max(top(a), top(b))] = min(top(a), top(b))
    want = {}
    for f in fps:
        want.setdefault(top(f), set()).add(f)
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    for bound in (4, 1 << 20):
        got = {}
        for r in simhash.components(simhash.near_links(table, hot_bucket=bound)).collect():
            got.setdefault(r.root, {r.root}).add(r.node)
        assert sorted(map(sorted, got.values())) == sorted(sorted(c) for c in want.values() if len(c) > 1)


def test_unit_cache_is_bounded(monkeypatch, reference_ids):
    units = packing.Units(packing.default_path())
    monkeypatch.setattr(packing, "CACHE_BYTES", 2000)
    text = " ".join(f"w{i} {'q' * (i % 400)}" for i in range(3000))
    for _ in range(3):
        assert array("I", units.encode(text.encode())).tolist() == reference_ids(text)
    long = "abc1" * 250_000  # one unit of a million bytes
    assert array("I", units.encode(long.encode())).tolist() == reference_ids(long)
    assert max(map(len, units.known), default=0) <= packing.CACHED_UNIT


def test_stitch_is_linear_and_spans_chunks(multi):
    import time

    import regex

    pattern = regex.compile(P.PATTERN)
    text = "ab 12  c's " * 300 + "z" * 4000 + " " * 900 + "end. " * 100 + "y" * 700
    for size, overlap in ((64, 8), (500, 40), (17, 5)):
        parts = [(s, s + len(x), [s + m.start() for m in pattern.finditer(x)]) for s, x in bpe.cut(text, size, overlap)]
        assert bpe.stitch(text, parts, pattern).tolist() == [m.start() for m in pattern.finditer(text)]
    seconds = []
    for n in (1, 4):
        long = "some words, 12 more. " * (100_000 * n)
        parts = [(s, s + len(x), [s + m.start() for m in pattern.finditer(x)]) for s, x in bpe.cut(long, 32_768, 256)]
        began = time.process_time()
        bpe.stitch(long, parts, pattern)
        seconds.append(time.process_time() - began)
    assert seconds[1] < 10 * seconds[0] + 1


def test_twenty_megabytes(spark, multi):
    path, enc = multi
    text = "word, 12 é\n" * 1_700_000 + "q" * 300_000
    got = bpe.encode_documents(frame(spark, [(1, text), (2, "a")]), path, P.PATTERN).where("doc_id = 1").collect()
    unit = enc.encode_ordinary("word, 12 é\n" * 17)
    assert len(text.encode()) > 20_000_000 and got[0].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert abs(got[0].n_tokens - 100_000 * len(unit)) < 400_000
