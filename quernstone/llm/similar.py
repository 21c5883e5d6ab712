"""SimHash near-duplicates of a stated similarity: 5-word shingles, Jaccard similarity of 0.8 and more.

simhash.py links fingerprints at a fixed distance. Here fingerprints of shingle sets choose the pairs, and the exact
similarity decides them:

* Texts with the same set of shingles collapse first; a text without words has the empty set.
* Each distinct set has a 64-bit SimHash. Sets of similarity 0.8 differ in 10 bits of 64 on average (deviation 3), so pairs
  beyond RADIUS bits are left out: 4 deviations, a few pairs in 100,000 (sets of under ten shingles: a few in 10,000).
* Routing: two fingerprints so far apart need not agree on any block, so sets meet by BANDS keys of BAND min-hashes
  instead. A pair of similarity s shares a key with probability 1 - (1 - s^BAND)^BANDS: at 0.8 it is missed 3 times
  in a million, above that less. No key is capped.
* In a bucket of equal keys the distances to the reference fingerprints are tabled, pairs whose largest coordinate
  difference exceeds RADIUS are discarded, and the rest is verified by popcount (simhash.bucket_links). A bucket of over
  HOT_BUCKET sets is joined whole, in linear work. Sets that hang together so are a cluster; every similar pair is in one.
* Each set's shingles travel to its cluster's task once, not once a key. A cluster of over HOT_CLUSTER sets (or CLUSTER_SHINGLES) is cut into parts
  by the set's hash, and every two parts meet in a task of their own. There pairs within RADIUS bits that are not
  connected yet are decided by their exact similarity, the closest first.
* A task emits the edges that join its groups, at most one a member, never its pairs.

Sets are told apart by 64-bit hashes. Words are as in simhash: ASCII lower case, split at ASCII white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, U64, checkpointed, mix, part_count, utf8
from .simhash import BROADCAST_KEYS, bucket_rows, components, distance_table, majority, one_of_each

WORDS = 5
LEAST = 0.8
BANDS = 32
BAND = 5
RADIUS = 22
HOT_BUCKET = 8192
HOT_CLUSTER = 2048
SEED = 42
CLUSTER_SHINGLES = 4 << 20
ROWS = 256


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of all word shingles, sorted; fewer words than a shingle make one."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64))


def set_hash(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), SEED)


ODD = (mix(np.arange(1, BANDS * BAND + 1, dtype=np.uint64) * GOLDEN) | U64(1)).reshape(-1, 1)


def band_keys(s: np.ndarray) -> np.ndarray:
    """One key a band; the empty set has none."""
    if not len(s):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * BAND, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 256):
        np.minimum(least, (s[at : at + 256] * ODD).min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, BAND))], np.uint64).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    """Whether two sorted sets have a Jaccard similarity of least and more."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if len(small) < least * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return both >= least * (len(a) + len(b) - both)


def group_edges(ids: list[int], sets: list[np.ndarray], prints: np.ndarray, least: float = LEAST, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges that span the groups of similar sets: each member against those before it within the radius, the closest first."""
    label = np.arange(len(ids))
    table = distance_table(prints) if len(ids) else None
    edges = []
    for i in range(1, len(ids)):
        far = np.zeros(i, bool)
        for row in table[:2] if i > 64 else []:
            far |= np.abs(row[:i] - row[i]) > radius
        near = np.flatnonzero(~far)
        distance = np.bitwise_count(prints[near] ^ prints[i])
        near, distance = near[distance <= radius], distance[distance <= radius]
        for j in near[np.argsort(distance, kind="stable")].tolist():
            if label[j] != label[i] and similar(sets[i], sets[j], least):
                edges.append((ids[i], ids[j]))
                low, high = sorted((int(label[i]), int(label[j])))
                label[: i + 1][label[: i + 1] == high] = low
    return edges


def set_keys(docs: DataFrame, row_col: str, text_col: str) -> DataFrame:
    """(row, sid, fp, size, keys) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                sids, fps, sizes, keys = [], [], [], []
                for t in utf8(b.column(1)):
                    s = shingles(t)
                    sids.append(set_hash(s))
                    fps.append(majority(s))
                    sizes.append(len(s))
                    keys.append(band_keys(s))
                columns = [pa.array(np.array(x, np.uint64).view(np.int64), pa.int64()) for x in (sids, fps)]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns, pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["row", "sid", "fp", "size", "keys"])

    return docs.select(F.col(row_col).alias("row"), F.col(text_col).alias("text")).mapInArrow(run, "row long, sid long, fp long, size long, keys array<long>")


def sets_of(docs: DataFrame, row_col: str, text_col: str) -> DataFrame:
    """(row, hashes): the sorted shingle hashes of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t).tobytes() for t in utf8(b.column(1))], pa.binary())], ["row", "hashes"])

    return docs.select(F.col(row_col).alias("row"), F.col(text_col).alias("text")).mapInArrow(run, "row long, hashes binary")


def clusters(found: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(fp, root): fingerprints that may have a similar partner, by what hangs together over keys and distances."""
    keyed = found.select("fp", F.explode(F.array_distinct("keys")).alias("key")).distinct()
    size = checkpointed(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("least")).where("n > 1"))
    met = keyed.join(size, "key")
    hot = met.where((F.col("n") > hot_bucket) & (F.col("fp") != F.col("least"))).select(F.col("fp").alias("u"), F.col("least").alias("v"))
    links = met.where(F.col("n") <= hot_bucket).select("key", "fp").repartition(part_count(found), "key").sortWithinPartitions("key", "fp").mapInArrow(bucket_rows(RADIUS), "u long, v long")
    found = components(links.unionByName(hot)).select(F.col("node").alias("fp"), "root")
    return found.unionByName(found.select(F.col("root").alias("fp"), "root").distinct())


def links(docs: DataFrame, found: DataFrame, row_col: str, text_col: str, hot_bucket: int = HOT_BUCKET, hot_cluster: int = HOT_CLUSTER) -> DataFrame:
    """(u, v): links between set hashes that span each group."""
    sets = found.groupBy("sid").agg(F.min("row").alias("row"), F.min("fp").alias("fp"), F.min("size").alias("size"))
    roots = clusters(found, hot_bucket)
    same = sets.groupBy("fp").agg(F.count("*").alias("k")).where("k > 1").select("fp", F.col("fp").alias("own"))  # unlike sets of one fingerprint
    member = sets.join(roots, "fp", "left").join(same, "fp", "left").select("sid", "row", "fp", "size", F.coalesce("root", "own").alias("root")).where("root IS NOT NULL")
    member = checkpointed(member)
    parts = F.greatest(F.ceil(F.count("*") / hot_cluster), F.ceil(F.sum("size") / CLUSTER_SHINGLES)).cast("int")
    size = member.groupBy("root").agg(parts.alias("n"), F.count("*").alias("count")).where("count > 1").drop("count")
    own = F.pmod(F.xxhash64("sid"), F.col("n")).cast("int")
    tasks = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.struct(F.least("own", j).alias("a"), F.greatest("own", j).alias("b")))
    dealt = checkpointed(member.join(size, "root").withColumn("own", own).select("sid", "row", "fp", "root", tasks.alias("tasks")))
    rows = dealt.select("row")
    rows = F.broadcast(rows) if rows.count() <= BROADCAST_KEYS else rows
    bodies = sets_of(docs.join(rows.select(F.col("row").alias(row_col)), row_col, "left_semi").dropDuplicates([row_col]), row_col, text_col)
    sent = dealt.join(bodies, "row").select("root", "sid", "fp", "hashes", F.explode("tasks").alias("t")).select("root", "t.a", "t.b", "sid", "fp", "hashes")

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by("sid")
        edges = group_edges(t["sid"].to_pylist(), [np.frombuffer(x, np.uint64) for x in t["hashes"].to_pylist()], t["fp"].to_numpy().view(np.uint64))
        return pa.table({"u": pa.array([e[0] for e in edges], pa.int64()), "v": pa.array([e[1] for e in edges], pa.int64())})

    return sent.groupBy("root", "a", "b").applyInArrow(run, "u long, v long").distinct()


def groups(docs: DataFrame, row_col: str, text_col: str, hot_bucket: int = HOT_BUCKET, hot_cluster: int = HOT_CLUSTER) -> DataFrame:
    """(row, root) for every row of docs; rows of one root are near copies of each other, directly or by others."""
    found = checkpointed(set_keys(docs, row_col, text_col))
    roots = components(links(docs, found, row_col, text_col, hot_bucket, hot_cluster))
    return found.join(roots, F.col("sid") == F.col("node"), "left").select("row", F.coalesce("root", "sid").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies."""
    return one_of_each(docs, groups, id_col, text_col)
