"""Media columns: content-defined chunks, deduplicated by their digests, stored once, from which verified payloads are put together again.

A rolling gear hash over the last 32 bytes decides the cuts, so equal passages give equal chunks wherever they stand. The hash of
all places comes from five array passes (each doubles the bytes covered).

1. A scan lists the digests of all chunks. Only these are shuffled: joins on the digest find the first medium that has a chunk, its owner,
   and the media that borrow it.
2. A second scan writes the store: a row for each medium with its ordered list of digests and the bytes of the chunks that it owns, each once.
   So a chunk is stored once in all, and payloads aren't shuffled but where a medium's borrowed chunks are too many to broadcast.
3. Every medium is put together again from the store alone, by its ordered list: owned chunks from its own row, borrowed ones sent from
   their owners' rows. The digest of every chunk and of the whole payload is held against the list.

Defined results: a medium is an id with a payload, so exact repeats of a row are one medium and other payloads of the same
id are media of their own. Null payloads and null ids are no media and have no row. An empty payload has no chunks and is verified.
A payload shorter than LEAST bytes is one chunk. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.state import checkpoint, small

LEAST, MASK_BITS, MOST = 256, 10, 8192
_GEAR = np.random.default_rng(6).integers(0, 1 << 32, 256, dtype=np.int64).astype(np.uint32)
_BUFFER = 4 << 20
CHUNKS = "id long, media binary, seq int, digest binary"
STORE = "id long, media binary, bytes long, list binary, owned binary, lengths binary, data binary, borrows boolean"


def digest(data: bytes) -> bytes:
    """A digest of 128 bits."""
    return hashlib.blake2b(data, digest_size=16).digest()


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: h = 2 h + gear(byte), of 32 bits and so of the last 32 bytes."""
    h = _GEAR[data]
    n = 1
    while n < 32:
        h[n:] += h[:-n] << np.uint32(n)  # the right side is computed before it is added
        n *= 2
    return h


def cuts(payload: bytes) -> list[int]:
    """Ends of a payload's chunks: where the hash's top bits are 0, LEAST bytes at least and MOST at most after the last."""
    n = len(payload)
    data = np.frombuffer(payload, np.uint8)
    places = []
    for at in range(0, n, _BUFFER):  # 31 bytes before a buffer give its hashes their past
        back = min(at, 31)
        h = gear(data[at - back : at + _BUFFER])[back:]
        places.append(np.flatnonzero((h >> np.uint32(32 - MASK_BITS)) == 0) + at + 1)
    return _choose(np.concatenate(places).tolist() if places else [], n)


def _choose(places: list[int], n: int) -> list[int]:
    out, last, k = [], 0, 0
    while last < n:
        while k < len(places) and places[k] < last + LEAST:
            k += 1
        end = places[k] if k < len(places) else n
        last = min(end, last + MOST, n)
        out.append(last)
    return out


def _listed(payload: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, chunk) in order."""
    ends = cuts(payload)
    parts = [payload[a:b] for a, b in zip([0, *ends], ends)]
    return [(digest(p), p) for p in parts]


def _made(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), schema)], names=[n for n, _ in schema])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = [("id", pa.int64()), ("media", pa.binary()), ("seq", pa.int32()), ("digest", pa.binary())]
    for batch in batches:
        rows: list[tuple] = []
        for i, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            media = digest(payload)
            rows += [(i, media, seq, d) for seq, (d, _) in enumerate(_listed(payload))] or [(i, media, 0, None)]
        for k in range(0, len(rows), 20_000):
            yield _made(rows[k : k + 20_000], schema)


def payloads(table: DataFrame, key: str, column: str) -> DataFrame:
    """(id, payload) of the rows that are media."""
    return table.select(F.col(key).cast("long").alias("id"), F.col(column).cast("binary").alias("payload")).where("id is not null and payload is not null")


def chunks(media: DataFrame) -> DataFrame:
    """(id, media, seq, digest): the chunks of every row (id, payload); an empty payload has one row without a digest."""
    return media.mapInArrow(_cut, CHUNKS)


def borrowed(listed: DataFrame) -> DataFrame:
    """(id, media, digest, owner, owner_media) of the chunks that a medium has from another one, each once."""
    have = listed.where("digest is not null").select("id", "media", "digest").distinct()
    owners = have.groupBy("digest").agg(F.min(F.struct("id", "media")).alias("o")).select("digest", F.col("o.id").alias("owner"), F.col("o.media").alias("owner_media"))
    return have.join(owners, "digest").where((F.col("id") != F.col("owner")) | (F.col("media") != F.col("owner_media")))


_STORED = [("id", pa.int64()), ("media", pa.binary()), ("bytes", pa.int64()), ("list", pa.binary()), ("owned", pa.binary()), ("lengths", pa.binary()), ("data", pa.binary()), ("borrows", pa.bool_())]


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the store of rows (id, payload, lent): lent are (media, digest) of chunks that others own."""
    for batch in batches:
        rows, size = [], 0
        for i, payload, lent in zip(*(batch.column(k).to_pylist() for k in range(3))):
            media, listed = digest(payload), _listed(payload)
            others = {x["digest"] for x in lent or () if x["media"] == media}
            own = {d: p for d, p in listed if d not in others}
            rows.append((i, media, len(payload), b"".join(d for d, _ in listed), b"".join(own), np.array([len(p) for p in own.values()], np.int32).tobytes(), b"".join(own.values()), bool(others)))
            size += len(payload)
            if size > 8 << 20:
                yield _made(rows, _STORED)
                rows, size = [], 0
        if rows:
            yield _made(rows, _STORED)


def store(media: DataFrame, lent: DataFrame) -> DataFrame:
    """The store (STORE) of rows (id, payload), each medium once; lent: ``borrowed``."""
    by = checkpoint(lent.groupBy(F.col("id").alias("b_id")).agg(F.collect_list(F.struct("media", "digest")).alias("lent"), F.count("*").alias("n")))
    return media.join(_checked(by.drop("n"), by), F.col("id") == F.col("b_id"), "left").select("id", "payload", "lent").mapInArrow(_store, STORE)


def once(media: DataFrame, listed: DataFrame) -> DataFrame:
    """The rows (id, payload) without exact repeats: only rows of ids that come several times are shuffled, if there are any."""
    several = checkpoint(listed.where("seq = 0").groupBy(F.col("id").alias("r_id")).agg(F.count("*").alias("n")).where("n > 1").select("r_id"))
    if several.isEmpty():
        return media
    few = small(several, 16)
    again = media.join(few, F.col("id") == F.col("r_id"), "left_semi").dropDuplicates(["id", "payload"])
    return media.join(few, F.col("id") == F.col("r_id"), "left_anti").unionByName(again)


def _split(data: bytes, width: int = 16) -> list[bytes]:
    return [data[k : k + width] for k in range(0, len(data), width)]


def _parts(owned: bytes, lengths: bytes, data: bytes) -> dict[bytes, bytes]:
    """The chunks of a row of the store by their digests."""
    ends = np.cumsum(np.frombuffer(lengths, np.int32)).tolist()
    return {d: data[a:b] for d, a, b in zip(_split(owned), [0, *ends], ends)}


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, data) of the wanted chunks; rows (owned, lengths, data, wanted)."""
    schema = [("digest", pa.binary()), ("data", pa.binary())]
    for batch in batches:
        rows, size = [], 0
        for owned, lengths, data, wanted in zip(*(batch.column(k).to_pylist() for k in range(4))):
            have = _parts(owned, lengths, data)
            rows += [(d, have[d]) for d in wanted if d in have]
            size += len(data)
            if size > 8 << 20:
                yield _made(rows, schema) if rows else _made([(None, None)], schema).slice(0, 0)
                rows, size = [], 0
        if rows:
            yield _made(rows, schema)


def assemble(parts: list[bytes | None], digests: list[bytes], media: bytes) -> bytes | None:
    """The payload of an ordered chunk list; None unless every chunk and the whole have their digests."""
    if any(p is None or digest(p) != d for p, d in zip(parts, digests)):
        return None
    whole = b"".join(parts)
    return whole if digest(whole) == media else None


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, media, bytes, n_own, own_bytes, list, payload) of rows of the store, and of what they borrow; payload is null if it isn't what it was."""
    schema = [("id", pa.int64()), ("media", pa.binary()), ("bytes", pa.int64()), ("n_own", pa.int64()), ("own_bytes", pa.int64()), ("list", pa.list_(pa.string())), ("payload", pa.binary())]
    for batch in batches:
        rows, size = [], 0
        for i, media, n, listed, owned, lengths, data, lent in zip(*(batch.column(k).to_pylist() for k in range(8))):
            have = _parts(owned, lengths, data) | {x["digest"]: x["data"] for x in lent or ()}
            digests = _split(listed)
            rows.append((i, media, n, len(owned) // 16, len(data), [d.hex() for d in digests], assemble([have.get(d) for d in digests], digests, media)))
            size += n
            if size > 8 << 20:
                yield _made(rows, schema)
                rows, size = [], 0
        if rows:
            yield _made(rows, schema)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_rebuild`` with verified in the place of the payload, which stays in the task."""
    for out in _rebuild(batches):
        whole = out.column("payload")
        right = pa.compute.and_(whole.is_valid(), pa.compute.fill_null(pa.compute.equal(pa.compute.binary_length(whole), out.column("bytes")), False))
        yield pa.RecordBatch.from_arrays([*out.columns[:-1], right], names=[*out.schema.names[:-1], "verified"])


def _complete(stored: DataFrame, lent: DataFrame) -> DataFrame:
    """The rows of the store with the chunks that they borrow (lent: (digest, data)), fetched from their owners' rows."""
    wanted = lent.select("owner", "owner_media", "digest").distinct()
    by_owner = checkpoint(wanted.groupBy("owner", "owner_media").agg(F.collect_list("digest").alias("wanted"), F.count("*").alias("n")))
    lenders = stored.join(_checked(by_owner.drop("n"), by_owner), (F.col("id") == F.col("owner")) & (F.col("media") == F.col("owner_media"))).select("owned", "lengths", "data", "wanted")
    data = lenders.mapInArrow(_extract, "digest binary, data binary")
    given = lent.select("id", "media", "digest").join(data, "digest").groupBy("id", "media").agg(F.collect_list(F.struct("digest", "data")).alias("lent"))
    plain = stored.where("not borrows").withColumn("lent", F.lit(None).cast("array<struct<digest:binary,data:binary>>"))
    both = stored.where("borrows").join(given, ["id", "media"], "left")
    columns = ["id", "media", "bytes", "list", "owned", "lengths", "data", "lent"]
    return plain.select(*columns).unionByName(both.select(*columns))


def restore(stored: DataFrame, lent: DataFrame) -> DataFrame:
    """(id, payload) of every medium whose chunks and whole have their digests."""
    schema = "id long, media binary, bytes long, n_own long, own_bytes long, list array<string>, payload binary"
    return _complete(stored, lent).mapInArrow(_rebuild, schema).where("payload is not null").select("id", "payload")


def verify(stored: DataFrame, lent: DataFrame) -> DataFrame:
    """(id, media, n_chunks, n_own, bytes, own_bytes, chunks, verified) of every medium: what it stores, the digests of its chunks in order, and whether it comes back."""
    schema = "id long, media binary, bytes long, n_own long, own_bytes long, list array<string>, verified boolean"
    done = _complete(stored, lent).mapInArrow(_verify, schema)
    return done.select("id", F.lower(F.hex("media")).alias("media"), F.size("list").cast("long").alias("n_chunks"), "n_own", "bytes", "own_bytes", F.col("list").alias("chunks"), "verified")


def stored(table: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(store, lent) of a table's media, both written."""
    media = payloads(table, key, column)
    listed = checkpoint(chunks(media))
    lent = checkpoint(borrowed(listed))
    return checkpoint(store(once(media, listed), lent)), lent


def deduplicate(table: DataFrame, key: str, column: str) -> DataFrame:
    """``verify`` of a table's media, with the key under its name."""
    return verify(*stored(table, key, column)).withColumnRenamed("id", key)


def _checked(df: DataFrame, counted: DataFrame) -> DataFrame:
    """df with a broadcast hint if its lists are small."""
    rows, entries = counted.agg(F.count("*"), F.sum("n")).first()
    return F.broadcast(df) if rows * 40 + (entries or 0) * 48 <= 32 << 20 else df
