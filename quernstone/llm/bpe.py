"""Byte-level BPE over overlapping chunks.

A text longer than chunk_chars is cut into chunks that overlap. Chunks are spread over tasks and pre-tokenised in
parallel, each from its own start, which may be inside a pre-token. Stitching walks the chunks in order: where a
boundary of the chunk so far is also one of the next chunk, both scans agree from there on (a match depends only on what
follows its start), and the next chunk takes over. Where an overlap holds no common boundary (a run of letters or of
white space longer than it), the scan goes on past the seam until one comes. Then every pre-token is encoded by the
ranks on its own. Shorter texts are one chunk and need no exchange.

Decoding looks up each id's bytes and concatenates them.

Defined results: null text counts as empty (no ids, empty bytes); repeated rows give repeated results; null ids stay
null; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import islice, pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import part_count

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 256
CACHE_TOKENS = 400_000
CACHED_PIECE = 64
PIECES = 1 << 16
OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Codec:
    """Encoder and decoder of one rank file; path is a parameter."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.bytes_of = {b: a for a, b in self.ranks.items()}
        self.known: dict[str, bytes] = {}

    def starts(self, text: str) -> list[int]:
        return [m.start() for m in self.pattern.finditer(text)]

    def pieces(self, text: str) -> Iterable[str]:
        return self.pattern.findall(text) if len(text) <= CHUNK_CHARS else (m.group() for m in self.pattern.finditer(text))

    def encode(self, pieces: list[str]) -> bytes:
        """Ids of the pieces as little-endian unsigned 32-bit integers."""
        known = self.known
        if len(known) > CACHE_TOKENS:
            known.clear()
        long = {}
        for p in {*pieces}:
            if p in known:
                continue
            b = p.encode("utf-8")
            rank = self.ranks.get(b)
            ids = array("I", [rank] if rank is not None else self.core._core_bpe.encode_single_piece(b)).tobytes()
            (known if len(p) <= CACHED_PIECE else long)[p] = ids  # the cache stays bounded in bytes too
        if long:
            return b"".join([long[p] if p in long else known[p] for p in pieces])
        return b"".join(map(known.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids)))

    def row(self, doc_id, pieces: Iterable[str]) -> tuple:
        """Digests of a document, of PIECES pieces at a time."""
        n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
        pieces = iter(pieces)
        while some := [*islice(pieces, PIECES)]:
            ids = self.encode(some)
            n += len(ids) // 4
            ids_hash.update(ids)
            text_hash.update(self.decode(ids))
        return doc_id, n, ids_hash.hexdigest(), text_hash.hexdigest()


@functools.cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def cut(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """(start, chunk): each chunk begins overlap characters before the previous one ends."""
    return [(at, text[at : at + size]) for at in range(0, max(1, len(text) - overlap), size - overlap)]


def stitch(text: str, chunks: list[tuple[int, int, list[int]]], pattern) -> array:
    """Boundaries of the whole text from (start, end, boundaries) of its chunks, all as offsets in the text. Linear."""
    kept = array("q", chunks[0][2])
    for start, end, fresh in chunks[1:]:
        ahead = set(fresh)
        meet = next((p for p in kept[bisect_left(kept, start) :] if p in ahead), None)
        if meet is None:  # the last pre-token so far ran into its chunk's end: scan on from its start
            at = kept.pop()
            while at < end and at not in ahead:
                kept.append(at)
                at = pattern.match(text, at).end()
            if at >= end:  # nothing of this chunk agrees; the next one goes on from here
                if at < len(text):
                    kept.append(at)
                continue
            meet = at
        del kept[bisect_left(kept, meet) :]
        kept.extend(fresh[bisect_left(fresh, meet) :])
    return kept


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Digest of the ids and of the decoded bytes of every text."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            yield _rows([c.row(i, c.pieces(t)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                found = cut(t, chunk_chars, overlap)
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(found), pa.int64()), pa.array([d] * len(found), pa.int64()), pa.array([s for s, _ in found], pa.int64()), pa.array([x for _, x in found], pa.string())], ["doc_id", "digest", "start", "chunk"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            starts = [array("q", c.starts(t)).tobytes() for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(starts, pa.binary())], ["doc_id", "digest", "start", "chunk", "bounds"])

    def join(t: pa.Table) -> pa.Table:
        c = codec(path, pattern)
        t = t.sort_by("start")
        copies = t["start"].to_pylist().count(0)
        one = {s: (x, b) for s, x, b in zip(t["start"].to_pylist(), t["chunk"].to_pylist(), t["bounds"].to_pylist(), strict=True)}
        had, fresh, parts = 0, [], []
        for s, (x, b) in one.items():
            fresh.append(x[had - s :])
            had = s + len(x)
            parts.append((s, had, [s + p for p in array("q", b)]))
        text = "".join(fresh)
        at = stitch(text, parts, c.pattern)
        at.append(len(text))
        row = c.row(t["doc_id"][0].as_py(), (text[a:b] for a, b in pairwise(at)))
        return pa.Table.from_batches([_rows([row] * copies)])

    whole = docs.where(F.length("text") <= chunk_chars).mapInArrow(short, OUT)
    long = docs.where(F.length("text") > chunk_chars).select("doc_id", F.xxhash64("text").alias("digest"), "text").mapInArrow(chunks, "doc_id long, digest long, start long, chunk string")
    long = long.repartition(part_count(docs), "doc_id", "digest", "start").mapInArrow(scan, "doc_id long, digest long, start long, chunk string, bounds binary")
    return whole.unionByName(long.groupBy("doc_id", "digest").applyInArrow(join, OUT))
