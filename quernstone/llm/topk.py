"""Exact top-k inner products over an impact-ordered, score-at-a-time index.

Components are quantised to floor(scale * x), kept as whole-numbered doubles. The index holds vectors in shards of bounded
size, one file each. In a shard every component is a posting; postings lie in segments by descending impact level (the
bit length of the component's magnitude), a segment being the rows and dimensions that have postings of that level. A
block of queries processes a shard's segments from the highest level down, adding to one score a pair. What is still
missing from a pair's score is at most |query| * |rest of the vector| (Cauchy-Schwarz; the norms of the rests are kept at
every level), and the rounding of the sums is bounded as well. A pair whose upper bound lies under the k-th best lower bound
of its query can't be a member. Processing stops before the last level only when few possible members are left; every
possible member is rescored exactly in integers, of any size where 64 bits don't hold the products.

Queries meet vectors as blocks against shards: rows of names are spread, and each task reads the files it needs, so no
vector is shuffled a second time and memory is one shard and one block whatever the size of the table. A pair of them returns at most
k rows a query, and a window keeps the k best.

Defined results: vectors that are null or hold a null or non-finite component take no part; a component whose scaled
value, or a score that is returned whose value, doesn't fit its type (double, long) is an error; shorter vectors count as padded with
zeros; a row is not a candidate of queries with its own id, and null ids are neither; repeated rows of other ids are
candidates each; equal query rows are one query; ties go to the smaller id; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bins_for, checkpointed, part_count, scratch

SCALE = 256
SHARD_ROWS = 8192
BLOCK_ROWS = 512
FILES = "part int, file string"
HITS = "query_id long, q_digest long, vec_id long, score long"


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): vectors that take part, as doubles."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    df = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return df.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def _matrix(column: pa.ChunkedArray, scale: int) -> np.ndarray:
    """Quantised rows, padded with zeros to the longest."""
    rows = column.combine_chunks()
    n = np.diff(rows.offsets.to_numpy())
    out = np.zeros((len(n), int(n.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < n[:, None]] = rows.flatten().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        out = np.floor(out * scale)
    if not np.isfinite(out).all():
        raise OverflowError("a scaled component doesn't fit a double")
    return out


@functools.cache
def _at(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_parts(vectors: DataFrame, parts: int, folder: str, scale: int) -> DataFrame:
    """(part, file): vectors dealt to parts by their hash, one file a part. A retried task writes a file of another name."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        fs, base = _at(folder)
        t = t.sort_by("vec_id")
        m = _matrix(t["v"], scale)
        name = f"{uuid.uuid4().hex}.bin"
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
            out.write(np.array(m.shape, np.int64).tobytes() + t["vec_id"].to_numpy().astype(np.int64).tobytes() + m.tobytes())
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "file": pa.array([name], pa.string())})

    dealt = vectors.withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)).cast("int"))
    return checkpointed(dealt.groupBy("part").applyInArrow(run, FILES))


def read_part(folder: str, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, quantised vectors) of a part."""
    fs, base = _at(folder)
    with fs.open_input_file(f"{base}/{name}") as f:
        data = f.read()
    n, width = np.frombuffer(data, np.int64, 2).tolist()
    return np.frombuffer(data, np.int64, n, 16), np.frombuffer(data, np.float64, n * width, 16 + 8 * n).reshape(n, width)


def segments(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, dimensions, postings between them, norms of what is left of every vector), by descending impact level."""
    level = np.frexp(np.abs(x))[1]
    level[x == 0] = np.iinfo(level.dtype).min
    out = []
    left = x.copy()
    for k in sorted({*np.unique(level).tolist()} - {np.iinfo(level.dtype).min}, reverse=True):
        here = level == k
        rows, dims = np.flatnonzero(here.any(axis=1)), np.flatnonzero(here.any(axis=0))
        at = np.ix_(rows, dims)
        part = np.where(here[at], x[at], 0)
        left[here] = 0
        out.append((rows, dims, part, np.sqrt((left**2).sum(axis=1))))
    return out


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of the rows of q with those of x, as 64-bit integers, or as Python's where they might not fit."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 2**62:
        return np.einsum("ij,ij->i", q.astype(np.int64), x.astype(np.int64))
    return np.array([sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for r, s in zip(q.tolist(), x.tolist(), strict=True)], object)


def search(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, score) of the k best of every query, exact."""
    x, q = np.asarray(x, np.float64), np.asarray(q, np.float64)
    own = q_ids[:, None] == ids[None, :]
    possible = ~own
    with np.errstate(over="ignore", invalid="ignore"):
        norm, length = (np.sqrt((m**2).sum(axis=1)) for m in (q, x))
        rounding = 0.0 if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2**53 else 2.0**-50 * (q.shape[1] + 4)
        whole = norm[:, None] * length[None, :]
        if len(x) > k and np.isfinite(whole).all():  # else every pair is rescored
            score = np.zeros((len(q), len(x)))
            levels = segments(x)
            for i, (rows, dims, part, rest) in enumerate(levels):
                found = q[:, dims] @ part.T
                if len(rows) == len(x):
                    score += found
                else:
                    score[:, rows] += found
                if 2 * i < len(levels) and i < len(levels) - 1:
                    continue
                slack = norm[:, None] * rest[None, :] * (1 + 1e-9) + whole * rounding
                low = np.where(own, -np.inf, score - slack)
                least = np.partition(low, len(x) - k, axis=1)[:, len(x) - k][:, None]
                possible = ~own & (score + slack >= least)
                if possible.sum() <= max(4 * k * len(q), possible.size // 50):
                    break
    a, b = np.nonzero(possible)
    exact = [exact_scores(q[a[s : s + 65536]], x[b[s : s + 65536]]) for s in range(0, len(a), 65536)]
    exact = np.concatenate(exact) if exact else np.zeros(0, np.int64)
    order = np.lexsort((ids[b], -exact, a)) if exact.dtype != object else np.array(sorted(range(len(a)), key=lambda i: (a[i], -exact[i], ids[b[i]])), np.int64)
    a, b, exact = a[order], b[order], exact[order]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[keep], b[keep], exact[keep]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of vectors for every query row."""
    spark = vectors.sparkSession
    folder = scratch(spark, "impacts")
    index = write_parts(usable(vectors, id_col, vector_col), bins_for(vectors.count(), shard_rows), folder, scale)
    many = bins_for(queries.count(), BLOCK_ROWS)
    blocks = write_parts(usable(queries, id_col, vector_col).distinct(), many, folder, scale)
    pairs = index.select(F.col("part").alias("shard"), F.col("file").alias("x_file"), F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("part"))
    pairs = pairs.join(blocks.withColumnRenamed("file", "q_file"), "part").repartition(part_count(vectors), "shard", F.floor(F.col("part") / 16))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, x = None, None, None
        for b in batches:
            for x_file, q_file in sorted(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if x_file != last:
                    last, (ids, x) = x_file, read_part(folder, x_file)
                q_ids, q = read_part(folder, q_file)
                digest = np.array([xxhash.xxh64_intdigest(v.tobytes().rstrip(b"\0")) for v in q + 0.0], np.uint64).view(np.int64)
                width = max(x.shape[1], q.shape[1])
                one, two = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, q))
                i, j, s = search(ids, one, q_ids, two, k)
                if len(s) and (s.max() >= 2**63 or s.min() < -(2**63)):
                    raise OverflowError("a score doesn't fit a long")
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (q_ids[i], digest[i], ids[j], s.astype(np.int64))], ["query_id", "q_digest", "vec_id", "score"])

    hits = pairs.select("x_file", "q_file").mapInArrow(run, HITS)
    best = Window.partitionBy("query_id", "q_digest").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
