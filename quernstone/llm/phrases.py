"""Repeated phrases: sharded Aho-Corasick automata over passages of words.

Of every sequence of WINDOW words that occurs more than once, only the earliest place (smallest doc_id, then smallest
start) keeps its words; every word that a later window covers is removed. Windows are judged on the input.

passages.py brings the passages that may recur to shards, where equal windows meet. A shard confirms, word by word, which
of them recur, and tells every chunk of documents the confirmed passages that it holds, with the place of each. A chunk
codes its words as characters, compiles its passages into Aho-Corasick automata of at most PATTERNS passages (bounded
memory), and streams all of its documents through each; the places of the passages are what the automata find.

Words are maximal runs of bytes outside space and \\x09-\\x0d, unchanged.

Defined results: null text has no words; rows of one doc_id count as one document, so repeated rows get equal results (a
smaller start in another row of the id is earlier); null ids come before all others; an empty table gives an empty table;
other columns are ignored. Long words cost no more than their bytes: each distinct word of a batch is hashed once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from . import passages
from .common import U64, runs
from .passages import Kind, Router, Segments, gram_hashes, mark_places, ranges

WINDOW = 20
GRAM = 8
PATTERNS = 50_000
BATCH_WORDS = 1 << 16
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def word_hashes(items: list, units: list) -> np.ndarray:
    """A hash for each word of a batch of units."""
    words = [w for loaded, at, size in items for w in loaded[at : at + size]]
    known = {w: xxhash.xxh64_intdigest(w) for w in {*words}}
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def coded(contents: list[list[bytes]]) -> tuple[np.ndarray, int]:
    """Word codes of all contents, one after another with a 0 after each, and how many characters a code takes."""
    flat = [w for c in contents for w in (*c, b"")]  # no word is empty
    known = {w: i for i, w in enumerate(dict.fromkeys([b"", *flat]))}
    return np.fromiter(map(known.__getitem__, flat), np.int64, len(flat)), 1 if len(known) < 1_100_000 else 2


def as_text(codes: np.ndarray, width: int) -> str:
    """Codes as characters, around the surrogates; wide codes take two."""
    if width == 2:
        codes = np.stack((codes >> 16, codes & 0xFFFF), axis=1).reshape(-1)
    return (codes + np.where(codes >= 0xD800, 0x800, 0)).astype("<u4").tobytes().decode("utf-32-le")


def resolve(rows: list[tuple[list[bytes], np.ndarray, np.ndarray]], window: int = WINDOW) -> list[np.ndarray]:
    """For each chunk's segments: a bit for each window, whether it has an earlier place."""
    number: dict[bytes, int] = {}
    which = [np.fromiter((number.setdefault(c, len(number)) for c in contents), np.int64, len(contents)) for contents, _, _ in rows]
    if not number:
        return [np.zeros(0, bool) for _ in rows]
    codes, _ = coded([c.split(b" ") for c in number])
    n = np.diff(np.flatnonzero(codes == 0), prepend=-1) - window  # a segment's words and its 0, less a window
    base = np.cumsum(n) - n
    at_text = ranges(np.cumsum(n + window) - (n + window), n)  # where each window of each distinct segment starts
    same = classes(codes, at_text, window)
    picks = [ranges(base[w], n[w]) for w in which]
    docs = [np.repeat(d, n[w]) for w, (_, d, _) in zip(which, rows, strict=True)]
    starts = [ranges(s, n[w]) for w, (_, _, s) in zip(which, rows, strict=True)]
    kind, doc, start = (np.concatenate(x) for x in ([same[p] for p in picks], docs, starts))
    order = np.lexsort((start, doc, kind))
    at = runs(kind[order])
    best = order[at[:-1]]
    late = np.zeros(len(kind), bool)
    late[order] = np.repeat(doc[best], np.diff(at)) < doc[order]
    late[order] |= (np.repeat(doc[best], np.diff(at)) == doc[order]) & (np.repeat(start[best], np.diff(at)) < start[order])
    return np.split(late, np.cumsum([len(p) for p in picks])[:-1])


def classes(codes: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """A number for each window of codes that starts at `at`: equal exactly for equal windows."""
    hashes = gram_hashes(codes.astype(np.uint64) + U64(1), window)[at]
    order = np.argsort(hashes, kind="stable")
    a, b = order[:-1], order[1:]
    same = hashes[a] == hashes[b]
    a, b = at[a[same]], at[b[same]]
    if all((codes[a + k] == codes[b + k]).all() for k in range(window)):
        out = np.empty(len(at), np.int64)
        out[order] = np.concatenate(([0], np.cumsum(~same)))
        return out
    known: dict[bytes, int] = {}  # unlike windows of one hash
    return np.array([known.setdefault(codes[i : i + window].tobytes(), len(known)) for i in at.tolist()], np.int64)


def occurrences(text: str, width: int, passages_: list[str], most: int = PATTERNS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(passage, start in codes) of every place of the passages in the text, an automaton of at most `most` at a time."""
    for first in range(0, len(passages_), most):
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        some = passages_[first : first + most]
        for i, key in enumerate(some):
            machine.add_word(key, i)
        machine.make_automaton()
        found = np.array(list(machine.iter(text)), np.int64).reshape(-1, 2)
        del machine
        start = found[:, 0] + 1 - np.fromiter(map(len, some), np.int64, len(some))[found[:, 1]]
        whole = start % width == 0
        yield found[whole, 1] + first, start[whole] // width


def mark(ids: np.ndarray, texts: list[bytes], known: Segments, most: int = PATTERNS) -> list[np.ndarray | None]:
    """Words to remove: streams the documents through the automata of the passages that were confirmed in them."""
    words = [t.split() for t in texts]
    sizes = [len(w) for w in words]
    codes, width = coded(words)
    base = np.cumsum([0, *(n + 1 for n in sizes[:-1])])
    text = as_text(codes, width)
    own = np.cumsum(known.counts) - known.counts
    row, start = known.rows[own], known.starts[own]
    at = base[row] + start
    keys = [text[a * width : b * width] for a, b in zip(at.tolist(), (at + known.windows + WINDOW - 1).tolist(), strict=True)]
    bit = np.cumsum(known.windows) - known.windows
    found_rows, found_late = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for passage, where in occurrences(text, width, keys, most):
        r = np.searchsorted(base, where, side="right") - 1
        s = where - base[r]
        doc, first_doc, first = ids[r], ids[row[passage]], start[passage]
        is_first = (doc == first_doc) & (s == first)
        after = (doc > first_doc) | ((doc == first_doc) & (s > first))  # those before it are judged by a passage of their own
        for some in (is_first, after):
            p, n = passage[some], known.windows[passage[some]]
            late = ranges(s[some], n)
            gone = known.bits[ranges(bit[p], n)] if some is is_first else np.ones(len(late), bool)
            found_rows.append(np.repeat(r[some], n)[gone])
            found_late.append(late[gone])
    return mark_places(ids, sizes, np.concatenate(found_rows), np.concatenate(found_late), WINDOW)


KIND = Kind(WINDOW, GRAM, True, False, bytes.split, len, word_hashes, lambda w, a, b: b" ".join(w[a:b]), lambda c: c.count(b" ") + 1, BATCH_WORDS, mark)


def _finisher(with_text: bool):
    def finish(ids, texts: list[bytes], masks: list, t: pa.Table) -> pa.Table:
        rows = []
        for text, mask in zip(texts, masks, strict=True):
            words = text.split()
            kept = words if mask is None else [w for w, gone in zip(words, mask.tolist(), strict=True) if not gone]
            joined = b" ".join(kept)
            rows.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), *([joined.decode("utf-8")] if with_text else [])))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * (3 + with_text)
        arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=False)]
        return pa.table([pa.array(t["doc_id"].to_pylist(), pa.int64()), *arrays], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + with_text])

    return finish


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, chunk_bytes: int = passages.CHUNK_BYTES, shard_bytes: int = passages.SHARD_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) and with_text also kept, the words that stay joined by spaces."""
    return Router(docs, KIND, id_col, text_col, chunk_bytes, shard_bytes).removed(resolve, _finisher(with_text), OUT + (", kept string" if with_text else ""))
