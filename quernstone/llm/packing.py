"""Best-fit-decreasing packing of token ids into sequences.

A document is its token ids by the JSON file of a byte-level vocabulary (added tokens that stand in the text are
recognised, as the tokenizers library does) and one end id. Documents longer than a sequence are first cut into full windows; what is
left over is a tail. Pieces are hashed into bins of bounded size, each bin is packed on its own, so no task sees the
corpus and a lost executor costs its bins alone. In a bin, pieces go from long to short, each into the open sequence of
the tightest room that still takes it. A segment tree over the room left (a count of open sequences at each room, sums
above) finds that sequence in log2(size) steps.

Defined results: null text counts as empty and gives a piece of the end id alone; repeated rows are packed each on their
own; a null doc_id stays null; an empty table gives no pieces; other columns are ignored. Ties in length go by doc_id,
then start.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bins_for, utf8

SIZE = 2048
END_ID = 1
PIECES_PER_BIN = 20_000
CACHE_BYTES = 96 << 20
ENTRY_BYTES = 200
CACHED_UNIT = 256
#: White space beyond ASCII, for which the quick split isn't safe (fixed values).
OTHER_SPACE = re.compile("[\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
#: White space and what follows it: no pre-token crosses from a visible character into white space.
UNIT = re.compile(rb"\s*\S+|\s+")

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECE + ", sequence_id long, offset long"


def byte_alphabet() -> dict[str, int]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in {*seen}]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


def ranked(path: str) -> dict[bytes, int] | None:
    """Ranks of a JSON file's tokens, if its merges stand in the order of the ids they make (then ranks say the same)."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, split = whole["model"], whole["pre_tokenizer"]
    vocab = model["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [vocab[a + b] for a, b in pairs]
    plain = model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and split == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if not plain or whole["normalizer"] or made != sorted({*made}) or {*vocab.values()} - {*made} != {*range(256)} or len(vocab) != 256 + len(made):
        return None
    alphabet = byte_alphabet()
    return {bytes(map(alphabet.__getitem__, token)): i for token, i in vocab.items()}


class Known(dict):
    """Unit -> its ids. Long units aren't kept, so the size in bytes is bounded."""

    def __init__(self, encode: Callable[[bytes], bytes]):
        super().__init__()
        self.encode, self.size = encode, 0

    def __missing__(self, unit: bytes) -> bytes:
        ids = self.encode(unit)
        if len(unit) <= CACHED_UNIT:
            self[unit] = ids
            self.size += len(unit) + ENTRY_BYTES
        return ids


class Units:
    """Encodes texts by units, each distinct short unit once; ids as little-endian unsigned 32-bit integers.

    Where ranked() shows that the ranks say the same as the file's merges, units are encoded by tiktoken's core, which takes a
    third of the time of tokenizers; else by tokenizers.
    """

    def __init__(self, path: str):
        import tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content.encode(): array("I", [i]).tobytes() for i, t in added.items()}
        #: Tokens that look at their neighbours, or a normaliser, would need the whole text.
        self.plain = self.tokenizer.normalizer is None and not any(t.lstrip or t.rstrip or t.single_word for t in added.values())
        self.split = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + b")") if self.added else None
        self.known = Known(lambda unit: self.ids([unit.decode("utf-8")])[0])
        self.core = None
        if ranks := ranked(path):
            import public_tokenizers
            import tiktoken

            self.core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without added tokens."""
        if self.core:
            return [array("I", x).tobytes() for x in map(self.core.encode_ordinary, texts)]
        return self.whole(texts)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, text: bytes) -> bytes:
        """Ids of a whole text."""
        if not self.plain or not text.isascii() and OTHER_SPACE.search(text.decode("utf-8")):
            return self.whole([text.decode("utf-8")])[0]
        if self.split is None or b"<" not in text and not any(t in text for t in self.added):
            return self.part(text)
        return b"".join(self.added[p] if i % 2 else self.part(p) for i, p in enumerate(self.split.split(text)))

    def part(self, text: bytes) -> bytes:
        """Ids of a text without added tokens."""
        if self.known.size > CACHE_BYTES:
            self.known.clear()
            self.known.size = 0
        return b"".join(map(self.known.__getitem__, UNIT.findall(text)))


@functools.cache
def units_of(path: str) -> Units:
    return Units(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, path: str | None = None) -> DataFrame:
    """Tokenised documents cut into full windows and a tail, without their ids. path: the vocabulary's JSON file."""
    path = path or default_path()
    end = array("I", [END_ID]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = units_of(path).encode
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                ids = encode(text) + end
                n = len(ids) // 4
                rows += [(doc_id, at, min(size, n - at), zlib.crc32(ids[4 * at : 4 * (at + size)]), n) for at in range(0, n, size)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECE)


def best_fit(lengths: list[int], size: int = SIZE) -> tuple[list[int], list[int]]:
    """Sequence and offset of each piece; lengths descend. The tree's leaf r counts open sequences with r free places."""
    width = 1 << size.bit_length()
    count = [0] * (2 * width)
    open_: list[list[int]] = [[] for _ in range(size + 1)]
    where, offset, made = [], [], 0

    def change(room: int, by: int) -> None:
        node = width + room
        while node:
            count[node] += by
            node >>= 1

    def tightest(least: int) -> int:
        """Smallest room >= least with an open sequence, or -1: up while nothing stands to the right, then down."""
        node = width + least
        if count[node]:
            return least
        while node > 1:
            if not node & 1 and count[node + 1]:
                node += 1
                while node < width:
                    node = 2 * node if count[2 * node] else 2 * node + 1
                return node - width
            node >>= 1
        return -1

    for n in lengths:
        room = tightest(n)
        if room < 0:
            room, seq = size, made
            made += 1
        else:
            seq = open_[room].pop()
            change(room, -1)
        where.append(seq)
        offset.append(size - room)
        if room > n:
            open_[room - n].append(seq)
            change(room - n, 1)
    return where, offset


def pack(found: DataFrame, bins: int, size: int = SIZE) -> DataFrame:
    """Packs the pieces of each bin by best fit decreasing."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.drop_columns(["bin"]).combine_chunks().sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        where, offset = best_fit(t["length"].to_pylist(), size)
        first = key[0].as_py() << 32
        return t.append_column("sequence_id", pa.array(np.array(where, np.int64) + first, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    binned = found.withColumn("bin", F.pmod(F.xxhash64("doc_id", "start", "doc_tokens", "ids_crc32"), F.lit(bins)))
    return binned.groupBy("bin").applyInArrow(run, PACKED)


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """All documents as placed pieces."""
    return pack(pieces(docs, id_col, text_col, size), bins_for(docs.count(), PIECES_PER_BIN), size)
