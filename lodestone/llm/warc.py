"""WARC segments: records whose payload goes on in continuation records are put together and decoded.

Records are sent to the partition of their origin (the id of the first segment) and sorted by segment number; each group is
then read as a stream: payloads are joined, the length is held against the total that the last segment states, and the
body of an HTTP response is taken out of its chunked transfer framing. Payloads move once.

Columns of records: record_id, origin_id (null on a first segment), segment (null where a record has only one),
total_length (null but on a last segment), payload, and if there is one, damaged.

Damaged files: a record that the end of the file cuts off, or whose Content-Length, segment number or total isn't a number, is
damaged (of the latter, reading goes on at the next record). So is what comes after a place where gzip data can't be inflated,
as one record named by file and place. A record without an id is named by these too. Zero bytes between and after gzip members don't matter.

Defined results: every origin has one row, with a status. ``ok``: the body is complete. ``missing_segment``: numbers don't run
from 1 without a gap, or no segment states the total. ``length_mismatch``: the payloads' length isn't the stated total.
``conflict``: one number has different payloads, or totals differ. ``bad_framing``: the body ends within its framing, or a chunk
size can't be read. All but the first have a null body. Repeated records count once. A null payload is empty. A record with neither
record_id nor origin_id belongs nowhere and is left out. A payload without HTTP headers is its own body. Trailers after the last
chunk are dropped. Further columns are ignored.
"""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT_BYTES, CHUNK_BYTES = 2048, 1000
READ_BYTES = 1 << 20
RECORDS = "record_id string, origin_id string, segment int, total_length long, payload binary"
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def dechunk(data: bytes) -> bytes | None:
    """The body of a chunked transfer; None if the framing is broken."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        size = data[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return None
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(out) if data.endswith(b"\r\n\r\n") or data[at:] == b"\r\n" else None
        if data[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(data[at : at + n])
        at += n + 2


def body(block: bytes) -> bytes | None:
    """The body of an HTTP response, or the block itself if it isn't one."""
    if not block.startswith(b"HTTP/"):
        return block
    head, gap, rest = block.partition(b"\r\n\r\n")
    if not gap:
        return None
    return dechunk(rest) if re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\b", head) else rest


def join_segments(rows: list[tuple[int, int | None, bytes, bool]]) -> tuple[int, int, str, bytes | None]:
    """(segments, bytes, status, body) of rows (number, total, payload, damaged) in the order of their numbers."""
    kept: dict[int, bytes] = {}
    totals = {r[1] for r in rows if r[1] is not None}
    conflict = len(totals) > 1
    damaged = any(r[3] for r in rows)
    for n, _, payload, _ in rows:
        conflict |= kept.setdefault(n, payload) != payload
    block = b"".join(kept.values())
    if damaged:
        status = "damaged"
    elif conflict:
        status = "conflict"
    elif list(kept) != list(range(1, len(kept) + 1)) or (not totals and len(kept) > 1):
        status = "missing_segment"
    elif totals and totals != {len(block)}:
        status = "length_mismatch"
    else:
        whole = body(block)
        return len(kept), len(block), "ok" if whole is not None else "bad_framing", whole
    return len(kept), len(block), status, None


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(rows: list) -> pa.RecordBatch:
        cols = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary()))], names=["origin_id", "segments", "length", "status", "body"])

    now, rows, done, size = None, [], [], 0
    for batch in batches:
        for origin, n, total, payload, damaged in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if origin != now and rows:
                done.append((now, *join_segments(rows)))
                size += done[-1][2]
                rows = []
                if size > 8 << 20:
                    yield made(done)
                    done, size = [], 0
            now = origin
            rows.append((n, total, payload or b"", damaged))
    if rows:
        done.append((now, *join_segments(rows)))
    if done:
        yield made(done)


def reassemble(records: DataFrame) -> DataFrame:
    """(origin_id, segments, length, status, body) of every origin."""
    damaged = F.coalesce(F.col("damaged"), F.lit(False)) if "damaged" in records.columns else F.lit(False)
    rows = records.select(F.coalesce("origin_id", "record_id").alias("origin_id"), F.coalesce(F.col("segment").cast("int"), F.lit(1)).alias("segment"), F.col("total_length").cast("long"), "payload", damaged.alias("damaged")).where("origin_id is not null")
    return rows.repartition("origin_id").sortWithinPartitions("origin_id", "segment").mapInArrow(_groups, "origin_id string, segments int, length long, status string, body binary")


class _Source:
    """The bytes of a file, plain or of gzip members, as a stream; gzip members are inflated one after another."""

    def __init__(self, file):
        self.file, self.kept, self.at, self.ended, self.broken = file, bytearray(), 0, False, False
        self.ahead, self.inflate = file.read(2), None
        self.gzipped = self.ahead == b"\x1f\x8b"

    def _more(self) -> bool:
        """Takes in some bytes; False at the end."""
        while not self.ended:
            data, self.ahead = self.ahead or self.file.read(READ_BYTES), b""
            if not self.gzipped or not (data or self.inflate):
                self.kept += data
                self.ended = not data
                return bool(data)
            if self.inflate is None:  # zero bytes may fill the gap between members
                data = data.lstrip(b"\0")
                if not data:
                    continue
                self.inflate = zlib.decompressobj(zlib.MAX_WBITS | 16)
            if data:
                try:
                    self.kept += self.inflate.decompress(data)
                    if self.inflate.eof:
                        self.ahead, self.inflate = self.inflate.unused_data, None
                    return True
                except zlib.error:
                    pass
            self.ended = self.broken = True  # the file ends within a member, or it can't be inflated
        return False

    def find(self, mark: bytes) -> int:
        """How far ahead the mark is; -1 if it doesn't come."""
        start = 0
        while (k := self.kept.find(mark, start)) < 0:
            start = max(0, len(self.kept) - len(mark) + 1)
            if not self._more():
                return -1
        return k

    def take(self, n: int) -> bytes:
        """The next n bytes, fewer at the end."""
        while len(self.kept) < n and self._more():
            pass
        out = bytes(self.kept[:n])
        del self.kept[:n]
        self.at += len(out)
        return out

    def skip_to(self, mark: bytes) -> bool:
        """Goes to the next mark without keeping what is before it."""
        while (k := self.kept.find(mark)) < 0:
            n = max(0, len(self.kept) - len(mark) + 1)
            self.take(n)
            if not self._more():
                return False
        self.take(k)
        return True


def _number(text: str | None) -> int | None:
    return int(text) if text and text.isascii() and text.isdigit() and len(text) < 19 else None


def parse(file, name: str = "") -> Iterator[tuple]:
    """Records (record_id, origin_id, segment, total_length, payload, damaged) of a WARC file that is read as a stream."""
    source = _Source(file)
    while source.skip_to(b"WARC/"):
        at, size = source.at, source.find(b"\r\n\r\n")
        if size < 0:
            yield f"{name}#{at}", None, None, None, b"", True
            break
        lines = source.take(size + 4).decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        wanted = head.get("warc-type", "").lower() in ("response", "resource", "continuation")
        n, number, total = (_number(head.get(k)) for k in ("content-length", "warc-segment-number", "warc-segment-total-length"))
        damaged = n is None or any(head.get(k) and v is None for k, v in (("warc-segment-number", number), ("warc-segment-total-length", total))) or (number or 0) > 0x7FFFFFFF
        payload = source.take(n or 0)
        damaged |= len(payload) < (n or 0)
        if wanted or (damaged and "warc-type" not in head):
            yield head.get("warc-record-id") or f"{name}#{at}", head.get("warc-segment-origin-id"), None if damaged else number, None if damaged else total, payload, damaged
    if source.broken:
        yield f"{name}#{source.at}", None, None, None, b"", True


def _opened(path: str):
    from pyarrow import fs

    place, inner = fs.FileSystem.from_uri(path)
    return place.open_input_stream(inner, compression=None)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files, with ``damaged``; one task for each file, which reads it as a stream, a record at a time."""
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.bool_()))], names=["record_id", "origin_id", "segment", "total_length", "payload", "damaged"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with _opened(name if "://" in name else name.replace("file:/", "file:///", 1)) as file:
                    for row in parse(file, name):
                        rows.append(row)
                        size += len(row[4])
                        if size > 8 << 20:
                            yield made(rows)
                            rows, size = [], 0
                if rows:
                    yield made(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "length")  # names only; contents aren't read by it
    n = files.count()
    return files.select("path").repartition(max(1, n), "path").mapInArrow(run, RECORDS + ", damaged boolean")


def segments(page: str, html: str | None, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> list[tuple]:
    """A page as the records of a segmented response in chunked transfer framing, the last segment first."""
    data = (html or "").encode()
    parts = [_HEAD]
    for k in range(0, len(data), chunk_bytes):
        piece = data[k : k + chunk_bytes]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    block = b"".join([*parts, b"0\r\n\r\n"])
    count = -(-len(block) // segment_bytes)
    return [(f"{page}/{n}" if n > 1 else page, page if n > 1 else None, n, len(block) if n == count else None, block[(n - 1) * segment_bytes : n * segment_bytes]) for n in range(count, 0, -1)]


def as_records(pages: DataFrame) -> DataFrame:
    """The pages of a table (page_id, html) as segmented records, as a crawler would have written them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            last = batch.num_rows - 1
            for k, (page, html) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                rows += segments(page, html)
                size += len(html or "")
                if size > 8 << 20 or k == last:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary()))], names=["record_id", "origin_id", "segment", "total_length", "payload"])
                    rows, size = [], 0

    return pages.where("page_id is not null").select(F.concat(F.lit("urn:page:"), F.col("page_id").cast("string")), "html").mapInArrow(run, RECORDS)


def to_bytes(records: list[tuple], compressed: bool = False) -> bytes:
    """Records as the bytes of a WARC file."""
    out = []
    for record, origin, number, total, payload in records:
        head = [f"WARC-Type: {'continuation' if origin else 'response'}", f"WARC-Record-ID: {record}", f"Content-Length: {len(payload)}"]
        head += [f"WARC-Segment-Origin-ID: {origin}"] * bool(origin) + [f"WARC-Segment-Number: {number}"] * bool(number) + [f"WARC-Segment-Total-Length: {total}"] * (total is not None)
        one = ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + payload + b"\r\n\r\n"
        out.append(gzip.compress(one) if compressed else one)
    return b"".join(out)


SQL = f"""
with page as (select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n from pages where page_id is not null),
sized as (select page_id, html, n, {len(_HEAD)} + 5 + (n // {CHUNK_BYTES}) * {CHUNK_BYTES + 4 + len(f"{CHUNK_BYTES:x}")}
  + case when n % {CHUNK_BYTES} > 0 then n % {CHUNK_BYTES} + 4 + length(lower(to_hex(n % {CHUNK_BYTES}))) else 0 end as length from page)
select page_id, cast(-(-length // {SEGMENT_BYTES}) as integer) as segments, cast(length as bigint) as length, 'ok' as status, html from
(select page_id, html, length, length + {SEGMENT_BYTES - 1} as up, ((length + {SEGMENT_BYTES - 1}) // {SEGMENT_BYTES}) as s from sized) x
"""
SQL = SQL.replace(f"cast(-(-length // {SEGMENT_BYTES}) as integer)", "cast(s as integer)")
