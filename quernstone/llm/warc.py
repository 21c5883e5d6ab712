"""WARC archives with a two-level capture index.

Writing: one gzip member a record. Of the records with equal payloads of MIN_REVISIT bytes or more, the one with the
smallest page id is a response and the others are revisit records without a payload that refer to it. Each task writes
its own files, named afresh at every attempt, and reports where each record stands; only what a committed task reports
is ever read, so a lost executor leaves an unreferenced file at most.

Index: captures are range-partitioned and sorted by reversed-host key and page id. Each partition becomes one index part:
blocks of BLOCK_LINES lines compressed each, then the part's block directory (first key, offset and length of every
block). Level one is the list of parts with their first keys and the places of their directories, one small row a partition.

Lookup: binary search over the parts, then over the directory of the part, then one range read of a block, a binary
search in it, and one range read of the record.

Reading back: the index's blocks are decoded in parallel, records are read in file order, and a revisit's payload is
resolved through the index at the key and page id that its headers name.

Files go through pyarrow.fs, so the folder may be of any scheme that it knows; the folder is the session's shared one.

Defined results: null html is an empty payload, null url an empty key; a null page id is never referred to unless the
payload has no other; rows that repeat the smallest page id are all responses; an empty table gives no records; other
columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import json
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, part_count, scratch

MIN_REVISIT = 100
NULL_PAGE = -(1 << 64)
BLOCK_LINES = 1000
DATE = "2024-01-01T00:00:00Z"
#: Fixed value: profile of a revisit record with an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "key binary, page_id long, file string, offset long, length long"
BLOCKS = "part_key binary, part_page long, file string, dir_offset long, dir_length long"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def surt(url: str | None) -> bytes:
    """Reversed-host key: com,example,www)/path?query, lower-case host."""
    url = url or ""
    try:
        p = urlsplit(url)
        host, port = p.hostname or "", p.port
    except ValueError:
        return url.encode("utf-8", "surrogatepass")
    if not host:
        return url.encode("utf-8", "surrogatepass")
    known = {"http": 80, "https": 443}.get(p.scheme)
    return (",".join(reversed(host.split("."))) + (f":{port}" if port and port != known else "") + ")" + (p.path or "/") + (f"?{p.query}" if p.query else "")).encode("utf-8", "surrogatepass")


@functools.cache
def _at(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _gzip(data: bytes, level: int = 1) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, target: str | None, revisit: bool) -> bytes:
    """One uncompressed WARC/1.1 record."""
    safe = lambda u: quote(u or "", safe="%/:=&?~#+!$,;'@()*[]")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {safe(url)}", f"WARC-Payload-Digest: sha256:{digest}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Target-URI: {safe(target)}", f"X-Refers-To-Page-Id: {refers_to}", f"X-Refers-To-Key: {surt(target).hex()}"]
    body = http if revisit else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of a record."""
    cut = data.index(b"\r\n\r\n")
    lines = data[:cut].decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    block = data[cut + 4 : cut + 4 + int(headers["Content-Length"])]
    return headers, block[block.index(b"\r\n\r\n") + 4 :]


def marked(pages: DataFrame) -> DataFrame:
    """Pages with digest, first page of the payload and whether the record is a revisit. Ids and digests, each pair
    once, meet in the skewed join on the digest; nothing above it needs its partitioning, so Spark splits a hot digest. The
    texts join once, on the page id."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha2("html", 256))
    small = pages.where(F.octet_length("html") >= MIN_REVISIT).select("page_id", "url", "digest")
    first = small.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    target = first.join(small.select(F.col("digest").alias("d"), F.col("page_id").alias("p"), "url"), (F.col("digest") == F.col("d")) & (F.col("first") == F.col("p")))
    first = checkpointed(target.groupBy("digest", "first").agg(F.min("url").alias("target")))
    once = small.select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest")).distinct()
    again = once.join(first, F.col("r_digest") == F.col("digest")).where(~F.col("r_id").eqNullSafe(F.col("first"))).select("r_id", "r_digest", "first", "target")
    return pages.join(again, pages["page_id"].eqNullSafe(again["r_id"]) & (pages["digest"] == again["r_digest"]), "left").select("page_id", "url", "html", "digest", F.col("first").alias("refers_to"), "target", F.col("r_digest").isNotNull().alias("revisit"))


def write_archives(pages: DataFrame, folder: str, file_bytes: int = 256 << 20) -> DataFrame:
    """Writes the archives and returns their captures, checkpointed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _at(folder)
        out, name, at = None, "", 0
        try:
            for b in batches:
                rows = []
                for page_id, url, html, digest, refers_to, target, revisit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        fs.create_dir(base, recursive=True)
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    member = _gzip(record(page_id, url, html.encode("utf-8"), digest, refers_to, target, revisit))
                    out.write(member)
                    rows.append((surt(url), page_id, name, at, len(member)))
                    at += len(member)
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "page_id", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return checkpointed(marked(pages).mapInArrow(run, CAPTURE))


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Writes the index parts; one row a part, checkpointed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _at(folder)
        lines: list[bytes] = []
        directory, at, out, name, first = [], 0, None, "", (b"", None)

        def flush() -> None:
            nonlocal at
            block = _gzip(b"\n".join(lines), 6)
            out.write(block)
            directory.append((*lines[0].decode().split(" ")[:2], at, len(block)))
            at += len(block)
            lines.clear()

        for b in batches:
            for key, page_id, file, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    name, first = f"{uuid.uuid4().hex}.cdx", (key, page_id)
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                lines.append(f"{key.hex()} {'' if page_id is None else page_id} {file} {offset} {length}".encode())
                if len(lines) >= block_lines:
                    flush()
        if out is not None:
            if lines:
                flush()
            tail = _gzip(json.dumps(directory).encode(), 6)
            out.write(tail)
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*first, name, at, len(tail)), (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["part_key", "part_page", "file", "dir_offset", "dir_length"])

    n = part_count(captures)
    ordered = captures.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id")
    return checkpointed(ordered.select("key", "page_id", "file", "offset", "length").mapInArrow(run, BLOCKS))


class Reader:
    """Lookups from one task; keeps the last directories, blocks and resolved payloads."""

    def __init__(self, folder: str, parts: list[tuple[bytes, int | None, str, int, int]]):
        self.fs, self.base = _at(folder)
        found = sorted(((key, _page(page)), *place) for key, page, *place in parts)
        self.parts = [tuple(place) for _, *place in found]
        self.firsts = [f[0] for f in found]
        self.handles: OrderedDict[str, pa.NativeFile] = OrderedDict()
        self.kept: OrderedDict[tuple, object] = OrderedDict()

    def range(self, file: str, offset: int, length: int) -> bytes:
        f = self.handles.get(file)
        if f is None:
            if len(self.handles) > 64:
                self.handles.popitem(last=False)[1].close()
            f = self.handles[file] = self.fs.open_input_file(f"{self.base}/{file}")
        f.seek(offset)
        return f.read(length)

    def _once(self, key: tuple, make):
        if key not in self.kept:
            if len(self.kept) > 512:
                self.kept.popitem(last=False)
            self.kept[key] = make()
        return self.kept[key]

    def directory(self, file: str, offset: int, length: int) -> list[tuple[tuple[bytes, int], int, int]]:
        """First key and page, offset and length of each block."""
        return self._once(("dir", file), lambda: [((bytes.fromhex(k), _page(int(p) if p else None)), o, n) for k, p, o, n in json.loads(zlib.decompress(self.range(file, offset, length), 31))])

    def block(self, file: str, offset: int, length: int) -> list[tuple[bytes, int | None, str, int, int]]:
        def make():
            rows = (x.split(b" ") for x in zlib.decompress(self.range(file, offset, length), 31).split(b"\n"))
            return [(bytes.fromhex(k.decode()), int(p) if p else None, f.decode(), int(o), int(n)) for k, p, f, o, n in rows]

        return self._once((file, offset), make)

    def find(self, key: bytes, page_id: int | None = None) -> Iterator[tuple[bytes, int | None, str, int, int]]:
        """Captures of a key, from page_id on where it is given, in order of pages: the last block that begins before them,
        and on while blocks begin with the key. Parts, directories and blocks are each searched by key and page."""
        low = (key, _page(page_id))
        for i in range(max(0, bisect.bisect_left(self.firsts, low) - 1), len(self.parts)):
            if self.firsts[i][0] > key:
                return
            directory = self.directory(*self.parts[i])
            for j in range(max(0, bisect.bisect_left(directory, low, key=lambda d: d[0]) - 1), len(directory)):
                if directory[j][0][0] > key:
                    return
                rows = self.block(self.parts[i][0], *directory[j][1:])
                for k in range(bisect.bisect_left(rows, low, key=lambda r: (r[0], _page(r[1]))), len(rows)):
                    if rows[k][0] != key:
                        return
                    yield rows[k]

    def record(self, file: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
        return parse(zlib.decompress(self.range(file, offset, length), 31))

    def payload(self, key: bytes, page_id: int, digest: str) -> tuple[int, str]:
        """Length and digest of the response that a revisit refers to."""

        def make():
            for _, p, file, offset, length in self.find(key, page_id):
                if p != page_id:
                    break
                headers, payload = self.record(file, offset, length)
                if headers["WARC-Type"] == "response" and headers["WARC-Payload-Digest"] == f"sha256:{digest}":
                    return len(payload), hashlib.sha256(payload).hexdigest()
            raise LookupError(f"no response of page {page_id}")

        return self._once(("payload", key, page_id, digest), make)


def _page(page_id: int | None) -> int:
    """Page ids in order, null first."""
    return NULL_PAGE if page_id is None else page_id


def _parts(index: DataFrame) -> list[tuple[bytes, int | None, str, int, int]]:
    """Level one of the index: one row a partition of the write."""
    return [(bytes(r.part_key), r.part_page, r.file, r.dir_offset, r.dir_length) for r in index.collect()]


def read_back(spark: SparkSession, index: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives, found through the index."""
    parts = _parts(index)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder, parts)
        for b in batches:
            for file, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                cols = list(zip(*reader.block(file, offset, length), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[2:], (pa.string(), pa.int64(), pa.int64()), strict=True)], ["file", "offset", "length"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder, parts)
        for b in batches:
            for name, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = reader.directory(name, offset, length)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64())], ["file", "offset", "length"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder, parts)
        for b in batches:
            rows = []
            for file, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h, payload = reader.record(file, offset, length)
                digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                page_id = int(h["X-Page-Id"]) if "X-Page-Id" in h else None
                if h["WARC-Type"] == "revisit":
                    target = int(h["X-Refers-To-Page-Id"])
                    rows.append((page_id, *reader.payload(bytes.fromhex(h["X-Refers-To-Key"]), target, digest), "revisit", target, h["WARC-Target-URI"]))
                else:
                    rows.append((page_id, len(payload), hashlib.sha256(payload).hexdigest(), "response", None, h["WARC-Target-URI"]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    place = "file string, offset long, length long"
    n = part_count(index)
    found = index.select("file", "dir_offset", "dir_length").mapInArrow(blocks, place).repartition(n, "file", "offset").mapInArrow(decode, place)
    return found.repartition(n, "file", F.floor(F.col("offset") / (4 << 20))).sortWithinPartitions("file", "offset").mapInArrow(records, RESULT)


def lookup(urls: DataFrame, index: DataFrame, folder: str, url_col: str = "url") -> DataFrame:
    """(url, page_id, record_type, html) of every capture of the wanted urls; each is one search and one range read."""
    parts = _parts(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder, parts)
        for b in batches:
            for url in b.column(0).to_pylist():
                for _, page_id, file, offset, length in reader.find(surt(url)):
                    h, payload = reader.record(file, offset, length)
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((url, page_id, h["WARC-Type"], payload.decode("utf-8")), (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["url", "page_id", "record_type", "html"])

    wanted = urls.select(F.col(url_col).cast("string").alias("url")).distinct()
    return wanted.mapInArrow(run, "url string, page_id long, record_type string, html string")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes archives and index of all pages, then reads every record back through the index."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    index = write_index(write_archives(pages, folder), folder)
    return read_back(spark, index, folder)
