"""Routing of recurring passages, shared by the phrase automata and the suffix arrays.

Both operators ask for every window of fixed length (words or bytes) whether an equal window stands earlier. Comparing
all windows would shuffle many times the corpus; here only those that may recur travel:

1. anchors: the smallest gram hash of every window is its anchor. Equal windows have equal anchors, and neighbouring
   windows mostly share theirs, so a chunk of documents has few. A chunk sends each distinct anchor hash once, packed to
   five bytes, to the shard of the hash. A shard tells each chunk which of its anchors occur elsewhere too.
2. segments: windows with such an anchor are cut into segments (the run of windows around one anchor). A chunk merges
   equal segments and sends them with their places to the anchor's shard, where all windows that could be equal meet. A
   passage that stands in every document is one row a chunk, however hot it is.
3. verdicts: the shard (an operator's own part) answers one bit a window of the segment's earliest place in the chunk:
   whether an earlier one exists anywhere. Every other place of a segment has an earlier one in its own chunk. The
   verdict carries the places along, so nothing is hashed or cut a third time.
4. The chunk applies the bits to its documents.

Five-byte hashes only choose candidates; false ones cost work, not results, and true ones can't be missed.

Documents are dealt to chunks by a hash of doc_id, so every step is a function of its input and survives lost executors.
The exchange of the documents by chunk is the same in all three steps and is reused by Spark.

A chunk sends one row to each shard it touches. So that these rows don't grow as chunks times shards, both sizes grow
with the square root of the input beyond SCALE_BYTES: rows then grow in proportion to it, up to GROWTH squared times
SCALE_BYTES (1 TB); beyond, a row holds ever fewer anchors until, at worst, each anchor is a row of its own. A shard
is judged in parts by the anchor's hash, so its working memory doesn't grow with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, bins_for, mix, runs

CHUNK_BYTES = 2 << 20
SHARD_BYTES = 4 << 20
#: Above so many bytes of text, chunks and shards grow with the square root of the input, up to GROWTH times.
SCALE_BYTES = 1 << 30
GROWTH = 32
#: A batch's arrays of eight-byte hashes stay within a core's cache.
BATCH_BYTES = 1 << 16
#: A shard is judged in parts of about so many bytes of segments.
PART_BYTES = 12 << 20
POSITION_BITS = 24
LOW_BITS = 40
P = U64(0x9E3779B97F4A7C15 | 1)
NULL_ID = np.iinfo(np.int64).min


@dataclass
class Unit:
    """Part of a document: its symbols from offset on. Units of a long document overlap by a window less one."""

    row: int
    offset: int
    size: int


@dataclass
class Kind:
    """What differs between words and bytes.

    within: whether repeats inside one document count. every: whether all places of a segment travel, or the earliest
    alone because mark() finds the others itself. length: symbols of what cut() gave. mark(ids, texts, segments): the covered symbols of every document, or None.
    """

    window: int
    gram: int
    within: bool
    every: bool
    load: Callable[[bytes], object]
    size: Callable[[object], int]
    hashes: Callable[[object, list], np.ndarray]
    cut: Callable[[object, int, int], bytes]
    length: Callable[[bytes], int]
    batch: int
    mark: Callable[[np.ndarray, list[bytes], Segments], list[np.ndarray | None]]


@dataclass
class Segments:
    """Recurring segments of a chunk: windows of each, a bit for each window of its earliest place, and its places."""

    windows: np.ndarray
    bits: np.ndarray
    counts: np.ndarray
    rows: np.ndarray
    starts: np.ndarray


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of the k symbols from each position on, by doubling."""
    out, part, width, done, at, power = None, symbols, 1, 0, 0, int(P)
    while True:
        if k >> at & 1:
            if out is None:
                out, done = part, width
            else:  # out covers [i, i + done), part covers width more
                shift = U64(pow(int(P), width, 1 << 64))
                n = len(part) - done
                out = out[:n] * shift + part[done:]
                done += width
        at += 1
        if k >> at == 0:
            return mix(out)
        n = len(part) - width
        part = part[:n] * U64(power) + part[width:]
        power = power * power % (1 << 64)
        width *= 2


def sliding_least(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of values[i : i + w] for each i."""
    t, m = 1, values
    while 2 * t <= w:
        m = np.minimum(m[:-t], m[t:])
        t *= 2
    n = len(values) - w + 1
    return np.minimum(m[:n], m[w - t : w - t + n])


def anchor_runs(symbols: np.ndarray, units: list[Unit], kind: Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window start, windows, anchor hash, unit) of each run of windows with one anchor; starts count over all units."""
    n = len(symbols)
    empty = np.zeros(0, np.int64)
    if n < kind.window:
        return empty, empty, empty.view(np.uint64), empty
    grams = gram_hashes(symbols, kind.gram)
    mask = U64((1 << POSITION_BITS) - 1)
    packed = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_least(packed, kind.window - kind.gram + 1) & mask).astype(np.int64)
    sizes = np.array([u.size for u in units], np.int64)
    ends = np.cumsum(sizes)
    first = ends - sizes
    windows = np.maximum(sizes - kind.window + 1, 0)
    valid = np.repeat(first, windows) + (np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows))
    if not len(valid):
        return empty, empty, empty.view(np.uint64), empty
    unit = np.repeat(np.arange(len(units)), windows)
    a = anchor[valid]
    new = np.concatenate(([0], np.flatnonzero((a[1:] != a[:-1]) | (valid[1:] != valid[:-1] + 1)) + 1, [len(a)]))
    start = new[:-1]
    return valid[start], np.diff(new), grams[a[start]], unit[start]


def batches(texts: list[bytes], kind: Kind) -> Iterator[tuple[list, list[Unit]]]:
    """Loaded documents in batches of bounded size; long ones in overlapping units."""
    items: list = []
    units: list[Unit] = []
    total = 0
    for row, text in enumerate(texts):
        loaded = kind.load(text)
        n = kind.size(loaded)
        step = kind.batch
        for at in range(0, max(n - kind.window + 1, 0), step):
            size = min(step + kind.window - 1, n - at)
            if units and total + size > kind.batch:
                yield items, units
                items, units, total = [], [], 0
            items.append((loaded, at, size))
            units.append(Unit(row, at, size))
            total += size
    if units:
        yield items, units


def keys_of(grams: np.ndarray, shards: int) -> np.ndarray:
    """Shard in the upper bits, five bytes of hash below."""
    return ((grams >> U64(LOW_BITS)) % U64(shards) << U64(LOW_BITS)) | (grams & U64((1 << LOW_BITS) - 1))


def pack5(low: np.ndarray) -> bytes:
    return np.ascontiguousarray((low & U64((1 << LOW_BITS) - 1)).view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpack5(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).reshape(-1)


def ordered(t: pa.Table) -> tuple[np.ndarray, list[bytes], pa.Table]:
    """Ids, texts and rows of a chunk in one order, the same in every step."""
    t = t.append_column("_null", pa.array(np.asarray(t["doc_id"].is_null()), pa.bool_())).sort_by([("_null", "descending"), ("doc_id", "ascending"), ("text", "ascending")])
    ids = np.array([NULL_ID if i is None else i for i in t["doc_id"].to_pylist()], np.int64)
    return ids, [x.encode("utf-8") if x is not None else b"" for x in t["text"].to_pylist()], t


def segments(texts: list[bytes], kind: Kind, shards: int, flagged: np.ndarray) -> Iterator[tuple[int, bytes, int, int]]:
    """(key, content, row, start) of each place of a segment whose anchor is flagged."""
    if not len(flagged):
        return
    low = U64((1 << 20) - 1)
    maybe = np.zeros(1 << 20, bool)  # spares most of the searches
    maybe[flagged & low] = True
    for items, units in batches(texts, kind):
        starts, windows, grams, unit = anchor_runs(kind.hashes(items, units), units, kind)
        keys = keys_of(grams, shards)
        hit = np.flatnonzero(maybe[keys & low])
        at = np.searchsorted(flagged, keys[hit])
        hit = hit[flagged[np.minimum(at, len(flagged) - 1)] == keys[hit]]
        first = np.cumsum([0, *(u.size for u in units)])
        begin = starts[hit] - first[unit[hit]] + np.array([u.offset for u in units], np.int64)[unit[hit]]
        cut, more = kind.cut, kind.window - 1
        for k, s, n, u in zip(keys[hit].tolist(), begin.tolist(), windows[hit].tolist(), unit[hit].tolist(), strict=True):
            yield k, cut(items[u][0], s, s + n + more), units[u].row, s


FLAG = "shard int, chunk int, once binary, often binary"
REPLY = "chunk int, shard int, low binary"
SEGMENT = "shard int, chunk int, content binary, lengths binary, docs binary, parts binary, counts binary, rows binary, starts binary"
VERDICT = "chunk int, shard int, windows binary, bits binary, counts binary, rows binary, starts binary"


def counts_for(total: int, chunk_bytes: int, shard_bytes: int) -> tuple[int, int]:
    """Chunks and shards for so many bytes of text."""
    more = min(GROWTH, max(1.0, sqrt(total / SCALE_BYTES)))
    return bins_for(total, int(chunk_bytes * more)), bins_for(total, int(shard_bytes * more))


class Router:
    """The three steps around an operator's resolve(shard rows) -> verdict bits."""

    def __init__(self, docs: DataFrame, kind: Kind, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES, shard_bytes: int = SHARD_BYTES, carry: list[str] = []):
        """carry: columns that travel along with the texts, as c0, c1, ..."""
        docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
        total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        chunks, self.shards = counts_for(total, chunk_bytes, shard_bytes)
        self.kind = kind
        self.docs = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int"))

    def flags(self) -> DataFrame:
        kind, shards = self.kind, self.shards

        def emit(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
            ids, texts, _ = ordered(t)
            found = []
            for items, units in batches(texts, kind):
                starts, _, grams, unit = anchor_runs(kind.hashes(items, units), units, kind)
                keys = keys_of(grams, shards)
                found.append((keys, ids[np.array([u.row for u in units], np.int64)][unit] if len(keys) else np.zeros(0, np.int64)))
            keys = np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in found)])
            if kind.within:
                keys.sort()
            else:  # several places in one document are one
                docs = np.concatenate([np.zeros(0, np.int64), *(d for _, d in found)])
                order = np.lexsort((docs, keys))
                keys, docs = keys[order], docs[order]
                keys = keys[np.concatenate(([True], (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])))] if len(keys) else keys
            at = runs(keys)
            keys, count = keys[at[:-1]], np.diff(at)
            shard = (keys >> U64(LOW_BITS)).astype(np.int32)
            at = runs(shard)
            out = [(int(shard[a]), key[0].as_py(), pack5(keys[a:b][count[a:b] == 1]), pack5(keys[a:b][count[a:b] > 1])) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)] if len(keys) else []
            return _table(out, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), ["shard", "chunk", "once", "often"])

        def reply(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
            low, who, sure = [], [], []
            for chunk, once, often in zip(t["chunk"].to_pylist(), t["once"].to_pylist(), t["often"].to_pylist(), strict=True):
                for data, many in ((once, False), (often, True)):
                    x = unpack5(data)
                    low.append(x)
                    who.append(np.full(len(x), chunk, np.int32))
                    sure.append(np.full(len(x), many))
            low, who, sure = np.concatenate(low), np.concatenate(who), np.concatenate(sure)
            order = np.argsort(low, kind="stable")
            low, who, sure = low[order], who[order], sure[order]
            same = np.zeros(len(low), bool)
            same[1:] = low[1:] == low[:-1]
            again = sure | same
            again[:-1] |= same[1:]
            low, who = low[again], who[again]
            order = np.argsort(who, kind="stable")
            low, who = low[order], who[order]
            at = runs(who)
            out = [(int(who[a]), key[0].as_py(), pack5(low[a:b])) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)] if len(who) else []
            return _table(out, (pa.int32(), pa.int32(), pa.binary()), ["chunk", "shard", "low"])

        return self.docs.groupBy("chunk").applyInArrow(emit, FLAG).groupBy("shard").applyInArrow(reply, REPLY)

    def candidates(self) -> DataFrame:
        """Distinct segments of each chunk with their places, by shard."""
        kind, shards = self.kind, self.shards
        types = (pa.int32(), pa.int32(), *[pa.binary()] * 7)
        names = ["shard", "chunk", "content", "lengths", "docs", "parts", "counts", "rows", "starts"]

        def emit(key: tuple[pa.Scalar, ...], t: pa.Table, told: pa.Table) -> pa.Table:
            if not len(t) or not len(told):
                return _table([], types, names)
            ids, texts, _ = ordered(t)
            out = []
            for shard, seen in sorted(gathered(segments(texts, kind, shards, flagged_of(told))).items()):
                places = [earliest_first(ids, v[1:], kind) for v in seen.values()]
                counts = np.fromiter((len(p) // 2 for p in places), np.int32, len(places))
                flat = np.fromiter(chain.from_iterable(places), np.int32, 2 * int(counts.sum()))
                rows, starts = flat[::2], flat[1::2]
                docs = ids[rows[np.cumsum(counts) - counts]]
                parts = np.fromiter((v[0] & 255 for v in seen.values()), np.uint8, len(seen))
                out.append((shard, key[0].as_py(), b"".join(seen), *(x.tobytes() for x in (np.fromiter(map(len, seen), np.int32, len(seen)), docs, parts, counts, rows, starts))))
            return _table(out, types, names)

        return self.docs.groupBy("chunk").cogroup(self.flags().groupBy("chunk")).applyInArrow(emit, SEGMENT)

    def removed(self, resolve: Callable[[list[tuple]], list[np.ndarray]], finish: Callable, schema: str) -> DataFrame:
        """finish(ids, texts, masks, table) gets, for each document of a chunk, the symbols that removed windows cover.

        resolve gets the (contents, docs, starts) of each chunk at one shard and returns its bits, a bit for each window.
        """
        kind = self.kind

        def judge(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
            t = t.sort_by("chunk")
            found = [_Sent(kind, *x) for x in zip(*(t[c].to_pylist() for c in SEGMENT_COLUMNS), strict=True)]
            parts = min(256, bins_for(sum(f.size for f in found), PART_BYTES))
            for part in range(parts):
                chosen = [np.flatnonzero(f.parts % parts == part) for f in found]
                for f, i, bits in zip(found, chosen, resolve([f.some(i) for f, i in zip(found, chosen, strict=True)]), strict=True):
                    f.bits[ranges(f.base[i], f.windows[i])] = bits
            out = [(c, key[0].as_py(), *f.verdict()) for c, f in zip(t["chunk"].to_pylist(), found, strict=True)]
            return _table([x for x in out if x[2]], (pa.int32(), pa.int32(), *[pa.binary()] * 5), ["chunk", "shard", "windows", "bits", "counts", "rows", "starts"])

        verdicts = self.candidates().groupBy("shard").applyInArrow(judge, VERDICT)

        def apply(key: tuple[pa.Scalar, ...], t: pa.Table, known: pa.Table) -> pa.Table:
            if not len(t):
                return finish([], [], [], t)
            ids, texts, t = ordered(t)
            if not len(known):
                return finish(ids, texts, [None] * len(texts), t)
            known = known.sort_by("shard")
            windows, counts, rows, starts = (np.frombuffer(b"".join(known[c].to_pylist()), np.int32).astype(np.int64) for c in ("windows", "counts", "rows", "starts"))
            bits = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=int(np.frombuffer(w, np.int32).sum())).astype(bool) for b, w in zip(known["bits"].to_pylist(), known["windows"].to_pylist(), strict=True)])
            return finish(ids, texts, kind.mark(ids, texts, Segments(windows, bits, counts, rows, starts)), t)

        return self.docs.groupBy("chunk").cogroup(verdicts.groupBy("chunk")).applyInArrow(apply, schema)


SEGMENT_COLUMNS = ["content", "lengths", "docs", "parts", "counts", "rows", "starts"]


class _Sent:
    """What a chunk sent to a shard."""

    def __init__(self, kind: Kind, content: bytes, lengths: bytes, docs: bytes, parts: bytes, counts: bytes, rows: bytes, starts: bytes):
        self.size = len(content)
        ends = np.cumsum(np.frombuffer(lengths, np.int32).astype(np.int64)).tolist()
        self.contents = [content[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        self.docs, self.parts = np.frombuffer(docs, np.int64), np.frombuffer(parts, np.uint8)
        self.counts, self.rows, self.starts = (np.frombuffer(x, np.int32) for x in (counts, rows, starts))
        self.first = np.cumsum(self.counts, dtype=np.int64) - self.counts
        self.windows = np.fromiter(map(kind.length, self.contents), np.int64, len(self.contents)) - kind.window + 1
        self.base = np.cumsum(self.windows) - self.windows
        self.bits = np.zeros(int(self.windows.sum()), bool)

    def some(self, i: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        return [self.contents[k] for k in i.tolist()], self.docs[i], self.starts[self.first[i]].astype(np.int64)

    def verdict(self) -> tuple[bytes, ...]:
        """The segments with a removed window or a second place."""
        keep = np.flatnonzero(np.logical_or.reduceat(self.bits, self.base) | (self.counts > 1))
        places = ranges(self.first[keep], self.counts[keep].astype(np.int64))
        bits = np.packbits(self.bits[ranges(self.base[keep], self.windows[keep])])
        return self.windows[keep].astype(np.int32).tobytes(), bits.tobytes(), self.counts[keep].tobytes(), self.rows[places].tobytes(), self.starts[places].tobytes()


def ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for sizes[0] numbers, then those of the next."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def covered(size: int, late: np.ndarray, window: int) -> np.ndarray:
    """The symbols of a document of that size which the windows at late cover."""
    step = np.bincount(late, minlength=size + 1) - np.bincount(late + window, minlength=size + 1)
    return np.cumsum(step[:size]) > 0


def mark_places(ids: np.ndarray, sizes: list[int], rows: np.ndarray, late: np.ndarray, window: int) -> list[np.ndarray | None]:
    """Masks of all documents from the rows and starts of their late windows."""
    masks: list[np.ndarray | None] = [None] * len(sizes)
    order = np.argsort(rows, kind="stable")
    rows, late = rows[order], late[order]
    at = runs(rows)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b > a:
            masks[rows[a]] = covered(sizes[rows[a]], late[a:b], window)
    return masks


def flagged_of(told: pa.Table) -> np.ndarray:
    """Sorted keys that a chunk was told to occur again."""
    parts = [unpack5(x) | (U64(s) << U64(LOW_BITS)) for s, x in zip(told["shard"].to_pylist(), told["low"].to_pylist(), strict=True)]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def gathered(places: Iterator[tuple[int, bytes, int, int]]) -> dict[int, dict[bytes, list[int]]]:
    """shard -> distinct content -> [key, row, start, row, start, ...] in order of rows and starts."""
    out: dict[int, dict[bytes, list[int]]] = {}
    for key, content, row, start in places:
        seen = out.setdefault(key >> LOW_BITS, {})
        known = seen.get(content)
        if known is None:
            seen[content] = [key, row, start]
        else:
            known += (row, start)
    return out


def earliest_first(ids: np.ndarray, flat: list[int], kind: Kind) -> list[int]:
    """Places as row, start, row, start, ... with the earliest by id and start in front; at most two if not all travel."""
    if len(flat) > 2 and kind.within:  # rows of one id are one document: the smaller start comes first
        peers = 2
        while peers < len(flat) and ids[flat[peers]] == ids[flat[0]]:
            peers += 2
        least = min(range(0, peers, 2), key=lambda i: flat[i + 1])
        flat[0], flat[1], flat[least], flat[least + 1] = flat[least], flat[least + 1], flat[0], flat[1]
    return flat if kind.every else flat[:4]


def _table(rows: list[tuple], types: tuple, names: list[str]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
