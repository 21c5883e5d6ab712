"""Repeated byte strings: suffix arrays by Larsson-Sadakane refinement, common prefixes by Kasai, merged by binary search.

Every byte covered by a WINDOW-byte string that also starts in a document of smaller doc_id is removed; strings are
judged on the input and never cross documents.

passages.py brings the segments that may recur to shards. A shard cuts its segments into blocks of bounded size. For each block
the suffixes are sorted by prefix doubling: a first sort by eight bytes, then only suffixes in groups not yet told apart
are refined by the rank one sorted prefix further on, until the prefix covers the window; a suffix leaves as soon as it is too
short for the next prefix, as its rank is no longer asked for. Kasai's pass gives the common prefixes of neighbours; it
runs over all segments of a block side by side, one array operation for a step in each. Runs of neighbours with WINDOW
bytes in common are one string, with the smallest doc_id of its places. Blocks of one shard are merged by binary search
of one's distinct strings in the other's sorted ones.

Defined results: null text is empty; rows of one doc_id are peers, so repeated rows get equal results; null ids come
before all others; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import passages
from .common import U64, runs
from .passages import Kind, Router, Segments, mark_places, ranges

WINDOW = 50
GRAM = 20
BLOCK_BYTES = 4 << 20
PLACES = 1 << 15
STEP = 8
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def byte_symbols(items: list, units: list) -> np.ndarray:
    return np.frombuffer(b"".join(loaded[at : at + size] for loaded, at, size in items), np.uint8).astype(np.uint64) + U64(1)


def mark(ids: np.ndarray, texts: list[bytes], known: Segments) -> list[np.ndarray | None]:
    """Bytes to remove. Places of the segment's first document have its bits; the others repeat that document."""
    segment = np.repeat(np.arange(len(known.counts)), known.counts)
    first = ids[known.rows[np.cumsum(known.counts) - known.counts]][segment]
    bit = np.cumsum(known.windows) - known.windows
    rows, late = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(segment), PLACES):
        s, r = segment[at : at + PLACES], known.rows[at : at + PLACES]
        n = known.windows[s]
        gone = known.bits[ranges(bit[s], n)] | np.repeat(ids[r] != first[at : at + PLACES], n)
        rows.append(np.repeat(r, n)[gone].astype(np.int32))
        late.append(ranges(known.starts[at : at + PLACES], n)[gone].astype(np.int32))
    return mark_places(ids, [*map(len, texts)], np.concatenate(rows), np.concatenate(late), WINDOW)


KIND = Kind(WINDOW, GRAM, False, True, bytes, len, byte_symbols, lambda t, a, b: t[a:b], len, passages.BATCH_BYTES, mark)


def suffix_array(data: np.ndarray, end: np.ndarray, window: int) -> np.ndarray:
    """Positions with `window` bytes or more before end[i], sorted by those bytes.

    data is followed by at least STEP bytes of any value; position i belongs to a string that ends before end[i].
    """
    n = len(end)
    h = min(STEP, window)
    left = (end - np.arange(n)).astype(np.int32)
    order = np.flatnonzero(left >= h)
    key = np.ndarray((n,), ">u8", data, strides=(1,))[order].astype(np.uint64) >> U64(64 - 8 * h)
    by = np.argsort(key)
    order, key = order[by], key[by]
    new = np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]
    rank = np.zeros(n, np.int64)  # of the first h bytes; only positions with so many have one
    while h < window:
        step = min(h, window - h)
        group = np.cumsum(new)
        rank[order] = group
        stay = left[order] >= h + step
        order, group = order[stay], group[stay]
        begins = runs(group)
        size = np.diff(begins)
        new = np.zeros(len(order), bool)
        new[begins[:-1]] = True
        open_ = np.flatnonzero(np.repeat(size > 1, size))  # only groups not yet told apart
        at = order[open_]
        pair = group[open_] << 32 | rank[at + step]
        by = np.argsort(pair)
        order[open_], pair = at[by], pair[by]
        new[open_[1:][pair[1:] != pair[:-1]]] = True
        h += step
    return order


def kasai(data: np.ndarray, starts: np.ndarray, windows: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix, up to cap, of each place in order with the one before it.

    order holds the places start + 0 ... windows - 1 of every string. Strings advance side by side. Where the neighbour's
    next place stands before ours in the order too, Kasai's bound holds: the prefix shrinks by one at most.
    """
    place = np.full(len(data), -1, np.int64)
    place[order] = np.arange(len(order))
    word = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # eight bytes from every place on
    prefix = np.zeros(len(order), np.int64)
    have_all = np.zeros(len(starts), np.int64)
    lane = np.argsort(-windows, kind="stable")
    live = np.searchsorted(-windows[lane], -np.arange(int(windows.max(initial=0))), side="left")
    for t in range(int(windows.max(initial=0))):
        on = lane[: live[t]]
        i = starts[on] + t
        r = place[i]
        j = order[np.maximum(r - 1, 0)]
        have = np.where(r > 0, have_all[on], 0)
        todo = np.flatnonzero(r > 0)
        while len(todo):
            at = have[todo]
            x = word[i[todo] + at] ^ word[j[todo] + at]
            have[todo] = at = at + np.where(x == 0, 8, np.bitwise_count((x & (~x + U64(1))) - U64(1)) >> 3)
            todo = todo[(x == 0) & (at < cap)]
        have = np.minimum(have, cap)
        prefix[r] = have
        after = place[j + 1]
        have_all[on] = np.where((r > 0) & (after >= 0) & (after < place[i + 1]), np.maximum(have - 1, 0), 0)
    return prefix


def distinct_windows(contents: list[bytes], docs: np.ndarray, window: int, with_keys: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct windows, smallest doc of each, class of each window of each content in order)."""
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    data = np.frombuffer(b"".join(contents) + bytes(window + 16), np.uint8)
    n = int(sizes.sum())
    ends = np.cumsum(sizes)
    starts, windows = ends - sizes, sizes - window + 1
    order = suffix_array(data, np.repeat(ends, sizes), window)
    prefix = kasai(data, starts, windows, order, window)
    kind = np.cumsum(prefix < window) - 1
    first = np.flatnonzero(prefix < window)
    owner = np.repeat(np.arange(len(contents)), sizes)
    smallest = np.minimum.reduceat(docs[owner[order]], first)
    keys = np.ones((len(first) if with_keys else 0, window + 1), np.uint8)  # a last byte of 1: byte strings drop zeros at their end
    if with_keys:
        keys[:, :window] = np.lib.stride_tricks.as_strided(data, (n, window), (1, 1))[order[first]]
    of = np.full(n, -1, np.int64)
    of[order] = kind
    return keys.reshape(-1).view(f"S{window + 1}"), smallest, of[of >= 0]


def merge(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct strings of both with their smallest doc, by binary search of the second in the first."""
    keys, docs = one[0], one[1].copy()
    at = np.searchsorted(keys, two[0])
    hit = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == two[0])
    docs[at[hit]] = np.minimum(docs[at[hit]], two[1][hit])
    return np.insert(keys, at[~hit], two[0][~hit]), np.insert(docs, at[~hit], two[1][~hit])


def resolve(rows: list[tuple[list[bytes], np.ndarray, np.ndarray]], window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list[np.ndarray]:
    """For each chunk's segments: a bit for each window, whether it also starts in a smaller document."""
    number: dict[bytes, int] = {}
    which = [np.fromiter((number.setdefault(c, len(number)) for c in contents), np.int64, len(contents)) for contents, _, _ in rows]
    if not number:
        return [np.zeros(0, bool) for _ in rows]
    least = np.full(len(number), np.iinfo(np.int64).max)
    for w, (_, docs, _) in zip(which, rows, strict=True):
        np.minimum.at(least, w, docs)
    contents = list(number)
    blocks, at, size = [], 0, 0
    for i, c in enumerate(contents):
        if size and size + len(c) > block_bytes:
            blocks.append((at, i))
            at, size = i, 0
        size += len(c)
    blocks.append((at, len(contents)))
    parts = [distinct_windows(contents[a:b], least[a:b], window, len(blocks) > 1) for a, b in blocks]
    if len(parts) == 1:
        best = parts[0][1][parts[0][2]]
    else:
        whole = parts[0][:2]
        for p in parts[1:]:
            whole = merge(whole, p[:2])
        best = np.concatenate([whole[1][np.searchsorted(whole[0], keys)][kind] for keys, _, kind in parts])
    n = np.fromiter(map(len, contents), np.int64, len(contents)) - window + 1
    base = np.cumsum(n) - n
    out = []
    for w, (_, docs, _) in zip(which, rows, strict=True):
        m = n[w]
        place = np.repeat(base[w], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        out.append(best[place] < np.repeat(docs, m))
    return out


def whole_characters(text: bytes, gone: np.ndarray) -> bytes:
    """What stays, with every character of which any byte stays."""
    data = np.frombuffer(text, np.uint8)
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    some = np.zeros(int(char[-1]) + 1, bool)
    some[char[~gone]] = True
    return data[some[char]].tobytes()


def digests(ids, texts: list[bytes], masks: list, t: pa.Table) -> pa.Table:
    rows = []
    for text, gone in zip(texts, masks, strict=True):
        if gone is None:
            rows.append((len(text), 0, 0, hashlib.sha256(text).hexdigest()))
            continue
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        rows.append((len(text), int(gone.sum()), int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])), hashlib.sha256(kept).hexdigest()))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
    return pa.table([pa.array(t["doc_id"].to_pylist(), pa.int64()), *arrays], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = passages.CHUNK_BYTES, shard_bytes: int = passages.SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row."""
    return Router(docs, KIND, id_col, text_col, chunk_bytes, shard_bytes).removed(resolve, digests, OUT)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", chunk_bytes: int = passages.CHUNK_BYTES, shard_bytes: int = passages.SHARD_BYTES) -> DataFrame:
    """The rows of docs without their repeated spans (in whole characters); chars_col, where there is one, is counted anew."""
    types = dict(docs.dtypes)
    carry = [c for c in docs.columns if c != text_col]
    schema = ", ".join(["doc_id long", "text string", *(f"c{i} {types[c]}" for i, c in enumerate(carry))])

    def finish(ids, texts: list[bytes], masks: list, t: pa.Table) -> pa.Table:
        kept = [raw if gone is None else whole_characters(x, gone).decode("utf-8") for raw, x, gone in zip(t["text"].to_pylist(), texts, masks, strict=True)]
        return pa.table([t["doc_id"], pa.array(kept, pa.string()), *(t[f"c{i}"] for i in range(len(carry)))], names=["doc_id", "text", *(f"c{i}" for i in range(len(carry)))])

    found = Router(docs, KIND, id_col, text_col, chunk_bytes, shard_bytes, carry).removed(resolve, finish, schema)
    of = {c: F.col(f"c{i}") for i, c in enumerate(carry)} | {text_col: F.col("text")}
    if chars_col in carry:
        of[chars_col] = F.length("text").cast(types[chars_col])
    return found.select(*[of[c].alias(c) for c in docs.columns])
