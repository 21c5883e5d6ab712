"""SimHash near-duplicates with pivot distance tables.

Every text gets a 64-bit SimHash. Fingerprints at Hamming distance <= max_distance are linked, and each document
receives the smallest doc_id of its connected component.

How pairs are found, whole and without all-pairs output:

* Copies collapse first: only distinct fingerprints are compared.
* 64 bits are cut into max_distance + 2 blocks. Two fingerprints within the distance agree on two whole blocks at least,
  so bucketing by each pair of blocks brings every near pair together once or more (pigeonhole, no loss).
* Inside a bucket the distances of all members to PIVOTS fixed reference fingerprints are tabled. By the triangle
  inequality a pair whose largest coordinate difference exceeds the distance can't be near and is discarded; the
  survivors are verified by popcount.
* A bucket emits a spanning star of its components, at most one row a member, never its pairs.
* Buckets of over HOT_BUCKET distinct fingerprints (a family of near copies may hold a third of all rows) never reach
  one task: their members are linked in linear work by ball_links, exactly and for the default distance of 2. Other
  distances compare them in the bucket, in blocks of fixed memory.

Components: alternating large-star and small-star over the star edges, checkpointed at each round.

Defined results: null text counts as empty; a text without words has fingerprint zero and is linked like any other;
fewer words than a shingle make one shingle; repeated rows give repeated results; a null doc_id never becomes a
component id unless the whole component has no other; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import GOLDEN, U64, checkpointed, mix, part_count, runs, utf8

SHINGLE_WORDS = 3
SEED = 42
MAX_DISTANCE = 2
PIVOTS = 24
BLOCK = 512
HOT_BUCKET = 8192
#: Up to so many keys of hot buckets (a long each) are broadcast; beyond, the joins shuffle.
BROADCAST_KEYS = 100_000


def simhash(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included."""
    tokens = text.lower().split()  # bytes: lowers A-Z and splits at ASCII white space only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)], dtype="<u8")
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): one signed 64-bit fingerprint a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(t, words) for t in utf8(b.column(1))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, the same on every executor."""
    return mix(np.arange(1, count + 1, dtype=np.uint64) * GOLDEN)


def distance_table(fps: np.ndarray) -> np.ndarray:
    """Row j holds every fingerprint's Hamming distance to pivot j."""
    return np.stack([np.bitwise_count(fps ^ p).astype(np.int8) for p in pivots()])


def _near(fps: np.ndarray, tab: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the index pairs (a, b), those within the distance: pivot coordinates first, then the exact count."""
    for row in tab:
        keep = np.abs(row[a] - row[b]) <= most
        a, b = a[keep], b[keep]
    keep = np.bitwise_count(fps[a] ^ fps[b]) <= most
    return a[keep], b[keep]


def _fold(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of each pair; label[i] is the smallest index of i's component."""
    while len(a):
        ra, rb = label[a], label[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        if not len(a):
            return
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def bucket_links(keys: np.ndarray, fps: np.ndarray, most: int = MAX_DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, smallest member) of the near components of each run of equal keys."""
    at = runs(keys)
    sizes = np.diff(at)
    keep = np.repeat(sizes > 1, sizes)
    keys, fps = keys[keep], fps[keep]
    if not len(keys):
        return fps, fps
    at = runs(keys)
    sizes = np.diff(at)
    tab, label = distance_table(fps), np.arange(len(fps))
    small = 32
    for step in range(1, min(small, int(sizes.max()))):
        a = np.flatnonzero((keys[step:] == keys[:-step]) & np.repeat(sizes <= small, sizes)[step:])
        _fold(label, *_near(fps, tab, a, a + step, most))
    for lo, hi in zip(at[:-1][sizes > small].tolist(), at[1:][sizes > small].tolist(), strict=True):
        order = lo + np.argsort(tab[0, lo:hi], kind="stable")  # by the first coordinate: partners stand within a band
        first = tab[0, order]
        for i in range(0, len(order), BLOCK):
            rows = order[i : i + BLOCK]
            end = int(np.searchsorted(first, int(first[min(i + BLOCK, len(order)) - 1]) + most, side="right"))
            for j in range(i, end, 8 * BLOCK):
                cols = order[j : min(j + 8 * BLOCK, end)]
                ok = np.abs(tab[1][rows][:, None] - tab[1][cols][None, :]) <= most
                for row in tab[2:6]:
                    ok &= np.abs(row[rows][:, None] - row[cols][None, :]) <= most
                x, y = np.nonzero(ok)
                x, y = rows[x], cols[y]
                other = label[x] != label[y]
                _fold(label, *_near(fps, tab, x[other], y[other], most))
    edge = np.flatnonzero(label != np.arange(len(label)))
    return fps[edge], fps[label[edge]]


def ball_links(fps: DataFrame) -> DataFrame:
    """(u, v): links that span the components of distance 2 among distinct fingerprints, none of them skewed.

    Every fingerprint goes to the 65 words at distance 0 or 1 from it. Two fingerprints differ in 2 bits or fewer exactly
    when they share such a word, and no word has more than 65 of them, so each word's star is small whatever the input.
    """
    ball = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    words = fps.select("fp", F.explode(ball).alias("word")).groupBy("word").agg(F.collect_set("fp").alias("us"), F.min("fp").alias("v"))
    return words.where(F.size("us") > 1).select(F.explode("us").alias("u"), "v").where("u <> v")


def near_links(distinct: DataFrame, most: int = MAX_DISTANCE, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(u, v): links between distinct fingerprints that span each near component."""
    n = most + 2
    cuts = [64 * i // n for i in range(n + 1)]
    block = [F.shiftrightunsigned("fp", cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1)) for i in range(n)]
    keys = [F.xxhash64(F.lit(k), block[i], block[j]) for k, (i, j) in enumerate(combinations(range(n), 2))]
    rows = distinct.select(F.explode(F.array(*keys)).alias("key"), "fp")
    hot = None
    if most == 2:
        large = checkpointed(rows.groupBy("key").count().where(F.col("count") > hot_bucket).select("key"))
        if many := large.count():
            large = F.broadcast(large) if many <= BROADCAST_KEYS else large
            hot = ball_links(rows.join(large, "key", "left_semi").select("fp").distinct())
            rows = rows.join(large, "key", "left_anti")
    links = rows.repartition(part_count(distinct), "key").sortWithinPartitions("key", "fp").mapInArrow(bucket_rows(most), "u long, v long")
    return (links if hot is None else links.union(hot)).distinct()


def bucket_rows(most: int):
    """For mapInArrow: star edges of each bucket from rows (key, fp) in order of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            u, v = bucket_links(k, f, most)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64), pa.int64()) for x in (u, v)], ["u", "v"])

        for b in batches:
            held_k = np.concatenate((held_k, b.column(0).to_numpy(zero_copy_only=False)))
            held_f = np.concatenate((held_f, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            cut = int(np.searchsorted(held_k, held_k[-1])) if len(held_k) else 0
            if cut:
                yield out(held_k[:cut], held_f[:cut])
                held_k, held_f = held_k[cut:], held_f[cut:]
        if len(held_k):
            yield out(held_k, held_f)

    return run


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge, root the smallest node of its component (large-star, small-star)."""
    edges = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    state = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v")))
        edges = checkpointed(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_DISTANCE, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    prints = checkpointed(fingerprints(docs, id_col, text_col, words))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = components(near_links(distinct.select("fp"), most))
    by_root = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    ids = by_root.groupBy("root").agg(F.min("least_id").alias("component_id"))
    member = by_root.join(ids, "root").select("fp", "component_id")
    return prints.join(member, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(col: str = "fp"):
    return F.lpad(F.lower(F.hex(col)), 16, "0")


def one_of_each(docs: DataFrame, grouping: Callable[[DataFrame, str, str], DataFrame], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group the row with the smallest doc_id stays, null ids last; rows of the same id and text collapse to one.

    grouping(docs, row_col, text_col) gives (row, root). Rows are told apart by a hash of their id and text, so that null
    and repeated ids lose no group.
    """
    number = F.col(id_col).cast("long")
    keyed = docs.withColumn("_row", F.xxhash64(number.isNull(), F.coalesce(number, F.lit(0)), F.col(text_col)))
    found = grouping(keyed, "_row", text_col).select(F.col("row").alias("_row"), F.col("root").alias("_root")).distinct()
    ids = keyed.select("_row", number.alias("_id")).distinct()
    best = found.join(ids, "_row").groupBy("_root").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).alias("_best"))
    kept = keyed.join(best.select("_best._row"), "_row", "left_semi")
    others = [F.col(c) for c in docs.columns if c not in (id_col, text_col)]
    tie = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0)
    first = Window.partitionBy("_row").orderBy(tie)  # rows of one id and text: the same one at every attempt
    return kept.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_row", "_rank")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component."""
    members = lambda d, row, text: near_duplicates(d, row, text).select(F.col("doc_id").alias("row"), F.col("component_id").alias("root"))
    return one_of_each(docs, members, id_col, text_col)
