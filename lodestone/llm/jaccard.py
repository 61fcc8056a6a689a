"""N-gram Jaccard join: prefix trees over globally ordered n-gram sets. The result is exact.

A text's set holds its distinct word n-grams (a text of fewer words has one n-gram of all of them). Two documents are linked
if their sets have a Jaccard similarity of at least ``threshold``. Identical sets form a class that is treated once.

1. Every n-gram is counted over all classes; rare ones come first in the global order. N-grams move as packed arrays to the
   parts of their value range, and only those that more than one class has come back. A class of n n-grams can have a
   partner only if at least threshold × n of them came back; the others are done.
2. Prefixes: of two similar sets, each has one of its first n - ceil(threshold × n) + 1 n-grams in common with the other. Sets
   meet at the n-grams of their prefixes, where three bounds that never exclude a similar pair are taken: by length, by place (what
   may follow the first common n-gram), and by a bitmap of the set's shared n-grams (a bit that the other lacks is an n-gram
   that the other lacks). Pairs that pass them connect sets; pairs of sets that are connected already needn't be compared. So sets meet
   at FIRST n-grams each, and then at those of all where sets meet that aren't connected.
3. Connected sets come together. They go into one prefix tree, frequent n-grams first, so that near copies share long paths. One
   traversal carries the overlaps with all sets at once; a subtree is left as soon as no set can reach the threshold with
   what remains below it. More than BLOCK connected sets, or sets of more than GRAMS n-grams, are joined block by block in different tasks.

Hot values: n-grams whose bucket of the value range has more than HEAVY occurrences aren't sent to one part; they are taken as shared, in
the place that the bucket's count gives them. An n-gram that more than GROUP classes have is split by class, and each two of its splits
meet. Copies are counted by map-side aggregation. So no task holds an unbounded group.

The link count of a document needs all links of its class, which is quadratic work in the number of *different* similar texts.

Defined results: a row for each document, that is for each different set of a non-null doc_id: exact repeats of a row, and
further texts of a doc_id with the same set, count once; a doc_id with texts of different sets has a row for each. Documents
that are linked directly or through others, and all texts with words of a doc_id, have one class_id, the least doc_id among them.
Null and empty texts, and texts without words, are linked with nothing and have their own doc_id as class_id. Rows of a null doc_id have no row (``keep_one`` keeps them).
Empty tables give no rows. Further columns are ignored by ``linked`` and kept by ``keep_one``. Sets are told apart by hashes of 64
bits, n-grams by 48 at least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import text as X
from lodestone.llm.components import Forest, components
from lodestone.state import BROADCAST_BYTES, checkpoint, small

N, THRESHOLD = 3, 0.5
#: n-grams in a part, of which a task holds one at a time; occurrences of a bucket that aren't sent to one part; classes that meet at one
#: n-gram in one place; connected sets in one block.
PART, HEAVY, GROUP, BLOCK = 2_000_000, 500_000, 1 << 16, 4096
#: n-grams that a task collects before it sends them on; keys at which sets meet first; n-grams of the sets in one block, of which a task holds two.
SENT, FIRST, GRAMS = 1 << 20, 8, 1 << 20
#: Texts that a task turns into Python's strings at once.
TEXTS = 1000
#: Pairs that are compared at once.
PAIRS = 1 << 19
_EPS = 1e-9
_SALT = 0x9E3779B97F4A7C15


def _bytes(*arrays: np.ndarray) -> list[bytes]:
    return [a.tobytes() for a in arrays]


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """The range, of so many equal ones, that 64-bit numbers fall in."""
    return (((keys >> X.U(32)) * X.U(parts)) >> X.U(32)).astype(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, whole, sizes, n-grams) of consecutive texts; whole is a hash of each set, 0 for an empty one."""
    for batch in (b.slice(k, TEXTS) for b in batches for k in range(0, b.num_rows, TEXTS)):
        for first, end, words, of in X.hashes(batch.column(1).to_pylist()):
            sets, bounds = X.sets(words, of, N)
            sizes, whole = np.diff(bounds), np.zeros(end - first, X.U)
            have = sizes > 0
            if have.any():
                whole[have] = X.mix(np.add.reduceat(X.mix(sets ^ X.U(0x5DEECE66D)), bounds[:-1][have]) + sizes[have].astype(X.U))
            yield batch.column(0).slice(first, end - first), whole, sizes, sets


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (id, whole, n) for each text, and (null, bucket, occurrences) for buckets that are crowded in this task."""
    counts = np.zeros(1 << 16, np.int64)
    for ids, whole, sizes, sets in _sets(batches):
        counts += np.bincount((sets >> X.U(48)).astype(np.int64), minlength=1 << 16)
        yield pa.RecordBatch.from_arrays([ids, pa.array(whole.view(np.int64)), pa.array(sizes)], names=["id", "whole", "n"])
    crowded = np.flatnonzero(counts > 4 * counts.mean() + 16)
    if len(crowded):
        yield pa.RecordBatch.from_arrays([pa.nulls(len(crowded), pa.int64()), pa.array(crowded), pa.array(counts[crowded])], names=["id", "whole", "n"])


#: Pieces of sets: of each set (whole) how many n-grams are held here, and these by so many low bytes.
_BLOB = "part int, whole binary, held binary, grams binary, rank binary, sizes binary"
#: Up to so many parts, six bytes of an n-gram and its part stand for it.
_NARROW = 1 << 16


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), *[pa.binary()] * 5)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["part", "whole", "held", "grams", "rank", "sizes"])


def _packed(grams: np.ndarray, parts: int) -> bytes:
    return grams.tobytes() if parts > _NARROW else np.ascontiguousarray(grams.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(data: bytes, parts: int) -> np.ndarray:
    if parts > _NARROW:
        return np.frombuffer(data, X.U)
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(X.U).ravel()


def _spread(part: np.ndarray, doc: np.ndarray, whole: np.ndarray, grams: np.ndarray, rank: np.ndarray, pack) -> Iterator[tuple]:
    """Blobs by part of n-grams that stand in the order of their documents; pack makes bytes of n-grams."""
    order = np.argsort(part, kind="stable")
    part, doc, grams, rank = part[order], doc[order], grams[order], rank[order] if len(rank) else rank
    begin = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else []
    for a, b in zip(begin, [*begin[1:], len(part)]):
        run = np.arange(b - a)
        new = np.concatenate(([True], doc[a + 1 : b] != doc[a : b - 1]))
        run -= np.maximum.accumulate(np.where(new, run, 0))
        new = np.flatnonzero(new | (run % 60_000 == 0))  # a piece's count takes two bytes
        yield int(part[a]), whole[doc[a:b][new]].tobytes(), np.diff(np.append(new, b - a)).astype(np.uint16).tobytes(), pack(grams[a:b]), rank[a:b].tobytes(), b""


def _scatter(parts: int, heavy: dict[int, int], only_heavy: bool):
    """Sends the n-grams of each text to their parts; those of heavy buckets instead to the part of their text's set, with a rank."""
    ranks = np.full(1 << 16, -1, np.int64)
    for bucket, count in heavy.items():
        ranks[bucket] = _rank(np.array([count]))[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def sent() -> pa.RecordBatch | None:
            whole, sizes, grams = (np.concatenate(c) for c in zip(*held))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            rank = ranks[(grams >> X.U(48)).astype(np.int64)]
            use = (rank >= 0) == only_heavy
            doc, grams, rank = doc[use], grams[use], rank[use].astype(np.uint8)
            own = _part(grams, parts)
            if only_heavy:
                rows = list(_spread(_part(whole[doc], parts), doc, whole, _known(grams, own, parts), rank, lambda g: g.tobytes()))
            else:
                rows = list(_spread(own, doc, whole, grams, rank[:0], lambda g: _packed(g, parts)))
            return _blobs(rows) if rows else None

        size = 0
        for _, whole, sizes, sets in _sets(batches):
            held.append((whole, sizes, sets))
            size += len(sets)
            if size >= SENT:
                if got := sent():
                    yield got
                held, size = [], 0
        if held and (got := sent()):
            yield got

    return run


def _known(grams: np.ndarray, part: np.ndarray | int, parts: int) -> np.ndarray:
    """The numbers that stand for n-grams of a part."""
    return grams if parts > _NARROW else (grams & X.U((1 << 48) - 1)) | (np.asarray(part).astype(X.U) << X.U(48))


def _sizes(parts: int):
    """Sends (whole, n) of the classes to the parts of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, n = batch.column(0).to_numpy().view(X.U), batch.column(1).to_numpy().astype(np.int64)
            part = _part(whole, parts)
            order = np.argsort(part, kind="stable")
            begin = np.flatnonzero(np.concatenate(([True], part[order][1:] != part[order][:-1]))) if len(part) else []
            rows = [(int(part[order[a]]), b"", b"", b"", b"", np.stack((whole[order[a:b]].view(np.int64), n[order[a:b]]), axis=1).tobytes()) for a, b in zip(begin, [*begin[1:], len(part)])]
            if rows:
                yield _blobs(rows)

    return run


def _rank(df: np.ndarray) -> np.ndarray:
    """A rank below 256 that grows with a count, eight for each doubling."""
    return np.minimum(255, np.round(8 * np.log2(df))).astype(np.uint8)


def _read(rows: list[tuple], unpack) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(whole, piece, n-grams, rank) of a part's blobs; piece numbers the pieces."""
    whole, held, rank = (np.frombuffer(b"".join(r[k] for r in rows), kind) for k, kind in ((1, X.U), (2, np.uint16), (4, np.uint8)))
    return whole, np.repeat(np.arange(len(whole)), held), unpack(b"".join(r[3] for r in rows)), rank


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each part, of which a task reads one at a time; rows come sorted by part."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != now and rows:
                yield rows
                rows = []
            now = row[0]
            rows.append(row)
    if rows:
        yield rows


def _shared(parts: int):
    """Of each part's n-grams those that at least two classes have, with their ranks, to the parts of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_part(batches):
            whole, piece, grams, _ = _read(rows, lambda data: _unpacked(data, parts))
            order = np.argsort(grams, kind="stable")
            new = np.concatenate(([True], grams[order[1:]] != grams[order[:-1]]))
            begin = np.flatnonzero(new)
            own = whole[piece[order]]
            many = np.minimum.reduceat(own, begin) != np.maximum.reduceat(own, begin)
            df = np.diff(np.append(begin, len(order)))
            of = np.cumsum(new) - 1
            rank = np.empty(len(order), np.uint8)
            keep = np.empty(len(order), bool)
            rank[order], keep[order] = _rank(df)[of], many[of]
            if keep.any():
                piece, grams = piece[keep], _known(grams[keep], rows[0][0], parts)
                yield _blobs(list(_spread(_part(whole[piece], parts), piece, whole, grams, rank[keep], lambda g: g.tobytes())))

    return run


def _least(n: np.ndarray) -> np.ndarray:
    """The least overlap that a set of n can have with a similar one."""
    return np.ceil(THRESHOLD * n - _EPS).astype(np.int64)


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(whole, n, grams, rank): sets that can have a partner, with their shared n-grams in the global order."""
    for rows in _by_part(batches):
        whole, piece, grams, rank = _read(rows, lambda data: np.frombuffer(data, X.U))
        sizes = np.frombuffer(b"".join(r[5] for r in rows), np.int64).reshape(-1, 2)
        if not len(grams):
            continue
        own = whole[piece]
        order = np.lexsort((grams, rank, own))
        own, grams, rank = own[order], grams[order], rank[order]
        new = np.concatenate(([True], own[1:] != own[:-1]))
        keep = new | np.concatenate(([True], grams[1:] != grams[:-1]))  # a set that was sent twice counts once
        own, grams, rank, new = own[keep], grams[keep], rank[keep], new[keep]
        begin = np.flatnonzero(new)
        ends = np.append(begin[1:], len(own))
        by = np.argsort(sizes[:, 0].view(X.U) if len(sizes) else sizes[:, 0])
        n = sizes[by[np.searchsorted(sizes[by, 0].view(X.U), own[begin])], 1]
        use = np.flatnonzero(ends - begin >= _least(n))
        for k in range(0, len(use), 2000):
            mine = use[k : k + 2000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[begin[mine]].view(np.int64)), pa.array(n[mine], pa.int32()), pa.array([grams[begin[i] : ends[i]].tobytes() for i in mine], pa.binary()), pa.array([rank[begin[i] : ends[i]].tobytes() for i in mine], pa.binary())], names=["whole", "n", "grams", "rank"]
            )


def bitmap(grams: np.ndarray) -> np.ndarray:
    """Bits of a set's shared n-grams in 64-bit words, so many that about two fifths are set at most; a power of two."""
    bits = max(64, 1 << (2 * len(grams) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(grams & X.U(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out).view(X.U)


_MEET = "part int, whole binary, component binary, n binary, k binary, words binary, bits binary, keys binary, doc binary, place binary"


def prefix(whole: int, n: int, grams: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, places) of a set's prefix, without what no other set has. An n-gram of many classes has a key for each pair of its splits."""
    k = len(grams)
    m = int(k - _least(np.array([n]))[0] + 1)
    at, key = np.arange(n - k, n - k + m), X.mix(grams[:m])
    splits = np.ceil(2.0 ** ((rank[:m].astype(float) + 1) / 8) / GROUP).astype(np.int64)
    if (splits > 1).any():
        more = [(key[splits == 1], at[splits == 1])]
        for j in np.flatnonzero(splits > 1):
            s = int(splits[j])
            mine = whole % s
            pair = np.array([min(mine, x) * s + max(mine, x) + 1 for x in range(s)], X.U)
            more.append((X.mix(key[j] ^ (pair * X.U(_SALT))), np.full(s, at[j])))
        key, at = (np.concatenate(c) for c in zip(*more))
        order = np.argsort(at, kind="stable")
        key, at = key[order], at[order]
    return key, at


def _prefixes(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, keys, places, n-grams) of rows (whole, n, grams, rank, ...)."""
    whole, n = batch.column(0).to_numpy().view(X.U), batch.column(1).to_numpy().astype(np.int64)
    for d, (grams, rank) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
        grams = np.frombuffer(grams, X.U)
        yield d, *prefix(int(whole[d]), int(n[d]), grams, np.frombuffer(rank, np.uint8)), grams


def _meet(parts: int):
    """Sends keys of each set (whole, n, grams, rank, component, wanted) to their parts, with the bitmap of the set: the first keys of its prefix, or those wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, n, component = batch.column(0).to_numpy().view(X.U), batch.column(1).to_numpy(), batch.column(4).to_numpy().view(X.U)
            maps, keys, doc, place, ks = {}, [], [], [], np.zeros(batch.num_rows, np.int32)
            wanted = batch.column(5).to_pylist()
            for d, key, at, grams in _prefixes(batch):
                ks[d] = len(grams)
                maps[d] = bitmap(grams)
                use = slice(0, FIRST) if wanted[d] is None else np.isin(key, np.frombuffer(b"".join(wanted[d]), X.U))
                keys.append(key[use])
                place.append(at[use])
                doc.append(np.full(len(keys[-1]), d))
            keys, doc, place = np.concatenate(keys), np.concatenate(doc), np.concatenate(place)
            part = _part(keys, parts)
            order = np.argsort(part, kind="stable")
            part, keys, doc, place = part[order], keys[order], doc[order], place[order]
            begin = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else []
            rows, size = [], 0
            for a, b in zip(begin, [*begin[1:], len(part)]):
                docs, own = np.unique(doc[a:b], return_inverse=True)
                bits = b"".join(maps[d].tobytes() for d in docs)
                size += len(bits) + 16 * (b - a)
                words = np.array([len(maps[d]) for d in docs], np.int32)
                rows.append((int(part[a]), *_bytes(whole[docs], component[docs], n[docs].astype(np.int32), ks[docs], words), bits, *_bytes(keys[a:b], own.astype(np.int32), place[a:b].astype(np.int32))))
                if size > 8 << 20:
                    yield _met(rows)
                    rows, size = [], 0
            if rows:
                yield _met(rows)

    return run


def _met(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 9))], names=["part", "whole", "component", "n", "k", "words", "bits", "keys", "doc", "place"])


_KEYS = "part int, whole binary, component binary, held binary, keys binary"


def _list(parts: int):
    """Sends all keys of each set's prefix to their parts, without a bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, component = batch.column(0).to_numpy().view(X.U), batch.column(4).to_numpy().view(X.U)
            got = [(d, key) for d, key, _, _ in _prefixes(batch)]
            keys, doc = np.concatenate([k for _, k in got]), np.repeat([d for d, _ in got], [len(k) for _, k in got])
            part = _part(keys, parts)
            order = np.argsort(part, kind="stable")
            part, keys, doc = part[order], keys[order], doc[order]
            begin = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            rows = []
            for a, b in zip(begin, [*begin[1:], len(part)]):
                new = np.flatnonzero(np.concatenate(([True], doc[a + 1 : b] != doc[a : b - 1])))
                docs = doc[a:b][new]
                rows.append((int(part[a]), *_bytes(whole[docs], component[docs], np.diff(np.append(new, b - a)).astype(np.int32), keys[a:b])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))], names=["part", "whole", "component", "held", "keys"])

    return run


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(whole, keys): of each set the keys at which it meets sets that it isn't connected with."""
    for rows in _by_part(batches):
        whole, component, held, keys = (np.frombuffer(b"".join(r[k] for r in rows), kind) for k, kind in ((1, X.U), (2, X.U), (3, np.int32), (4, X.U)))
        piece = np.repeat(np.arange(len(whole)), held)
        order = np.argsort(keys, kind="stable")
        new = np.concatenate(([True], keys[order[1:]] != keys[order[:-1]]))
        begin, own = np.flatnonzero(new), component[piece[order]]
        several = np.minimum.reduceat(own, begin) != np.maximum.reduceat(own, begin)
        keep = np.empty(len(keys), bool)
        keep[order] = several[np.cumsum(new) - 1]
        piece, keys = piece[keep], keys[keep]
        first = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1]))) if len(piece) else []
        if len(first):
            yield pa.RecordBatch.from_arrays([pa.array(whole[piece[first]].view(np.int64)), pa.array([keys[a:b].tobytes() for a, b in zip(first, [*first[1:], len(keys)])], pa.binary())], names=["whole", "keys"])


class Met:
    """Sets of one part, and the test whether two of them may be similar."""

    def __init__(self, n: np.ndarray, k: np.ndarray, words: np.ndarray, bits: np.ndarray):
        self.n, self.k, self.words, self.bits = n.astype(np.int64), k.astype(np.int64), words.astype(np.int64), bits
        self.at = np.cumsum(self.words) - self.words

    def _folded(self, docs: np.ndarray, words: int) -> np.ndarray:
        """Bitmaps of docs, folded to so many words."""
        out = np.zeros((len(docs), words), X.U)
        for own in np.unique(self.words[docs]):
            rows = np.flatnonzero(self.words[docs] == own)
            out[rows] = np.bitwise_or.reduce(self.bits[self.at[docs[rows]][:, None] + np.arange(own)].reshape(len(rows), own // words, words), axis=1)
        return out

    def need(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The overlap that makes two sets similar."""
        return np.ceil(THRESHOLD / (1 + THRESHOLD) * (self.n[x] + self.n[y]) - _EPS).astype(np.int64)

    def may(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the bitmaps leave two sets enough n-grams in common. What isn't in the other's bitmap isn't in the other."""
        out = np.zeros(len(x), bool)
        need, least = self.need(x, y), np.minimum(self.words[x], self.words[y])
        for words in np.unique(least):
            rows = np.flatnonzero(least == words)
            step = max(1, (1 << 21) // int(words))
            for a in range(0, len(rows), step):
                r = rows[a : a + step]
                docs, at = np.unique(np.concatenate((x[r], y[r])), return_inverse=True)
                maps = self._folded(docs, int(words))
                p, q = maps[at[: len(r)]], maps[at[len(r) :]]
                both = p & q
                lost = np.bitwise_count(p ^ both).sum(axis=1, dtype=np.int64), np.bitwise_count(q ^ both).sum(axis=1, dtype=np.int64)
                out[r] = (self.k[x[r]] - lost[0] >= need[r]) & (self.k[y[r]] - lost[1] >= need[r])
        return out


def connected(met: Met, keys: np.ndarray, doc: np.ndarray, place: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Roots of sets, such that any two similar ones that have one of the keys as their first common n-gram are connected, as are those of one component."""
    count = len(component)
    _, lead, of = np.unique(component, return_index=True, return_inverse=True)
    forest = Forest(count)
    forest.join(lead[of], np.arange(count))
    order = np.lexsort((doc, met.n[doc], keys))
    keys, doc, place = keys[order], doc[order], place[order]
    left = met.n[doc] - place  # n-grams from this one on
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(keys)))

    def test(i: np.ndarray, j: np.ndarray) -> None:
        """Connects the sets of entries that pass the bounds; i comes before j."""
        x, y = doc[i], doc[j]
        use = (x != y) & (met.n[x] >= THRESHOLD * met.n[y] - _EPS)
        i, j, x, y = i[use], j[use], x[use], y[use]
        use = np.minimum(left[i], left[j]) >= met.need(x, y)
        x, y = np.minimum(x[use], y[use]), np.maximum(x[use], y[use])
        if not len(x):
            return
        pair = np.unique(x * count + y)
        x, y = pair // count, pair % count
        r = forest.roots()
        use = r[x] != r[y]
        x, y = x[use], y[use]
        ok = met.may(x, y)
        forest.join(x[ok], y[ok])

    nxt = np.flatnonzero(~new)
    for a in range(0, len(nxt), PAIRS):  # neighbours first: near copies are connected by them
        test(nxt[a : a + PAIRS] - 1, nxt[a : a + PAIRS])
    # of each n-gram whose sets aren't all connected, every pair that its lengths allow and that isn't connected yet
    roots, group = forest.roots()[doc], np.cumsum(new) - 1
    apart = (np.minimum.reduceat(roots, begin) != np.maximum.reduceat(roots, begin)) & (size > 2)
    wide = int(met.n.max() / THRESHOLD) + 2
    entry = np.flatnonzero(apart[group])
    until = np.searchsorted(group * wide + met.n[doc], group[entry] * wide + (met.n[doc[entry]] / THRESHOLD + _EPS).astype(np.int64), "right")
    many = until - entry - 1
    total = np.concatenate(([0], np.cumsum(many)))
    at = 0
    while at < len(entry):
        stop = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, "right")) - 1)
        i = np.repeat(entry[at:stop], many[at:stop])
        j = i + 1 + np.arange(len(i)) - np.repeat(total[at:stop] - total[at], many[at:stop])
        roots = forest.roots()
        use = roots[doc[i]] != roots[doc[j]]
        test(i[use], j[use])
        at = stop
    return forest.roots()


def _connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) that connect the sets of each part."""
    for rows in _by_part(batches):
        whole, component, n, k, words, bits, keys, doc, place = (np.frombuffer(b"".join(r[c] for r in rows), kind) for c, kind in enumerate((X.U, X.U, np.int32, np.int32, np.int32, X.U, X.U, np.int32, np.int32), 1))
        sizes = [len(r[1]) // 8 for r in rows]
        doc = doc + np.repeat(np.cumsum(sizes) - sizes, [len(r[8]) // 4 for r in rows])
        distinct, lead, of = np.unique(whole, return_index=True, return_inverse=True)
        at = np.cumsum(words) - words
        take = np.concatenate([np.arange(at[i], at[i] + words[i]) for i in lead])
        met = Met(n[lead], k[lead], words[lead], bits[take])
        root = connected(met, keys, of[doc], place.astype(np.int64), component[lead])
        edge = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_arrays([pa.array(distinct[edge].view(np.int64)), pa.array(distinct[root[edge]].view(np.int64))], names=["a", "b"])


def trie_join(sets: list[np.ndarray], sizes: np.ndarray, others: list[np.ndarray] | None = None, other_sizes: np.ndarray | None = None, threshold: float = THRESHOLD) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, js, overlaps) for each set i and those of the others that reach the threshold with it; without others, all the sets but i.

    sets: arrays of distinct 64-bit numbers, in any order; sizes: their full sizes (numbers that no other set has may be missing).
    """
    own = others is None
    others, other_sizes = (sets, sizes) if own else (others, other_sizes)
    other_sizes = np.asarray(other_sizes, np.int64)
    sizes = np.asarray(sizes, np.int64)
    lengths = np.array([len(s) for s in others])
    every, inverse, count = np.unique(np.concatenate(others), return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")  # the order of all: frequent first
    rank = np.empty(len(every), np.int64)
    rank[order] = np.arange(len(every))
    flat, owner = rank[inverse], np.repeat(np.arange(len(others)), lengths)
    by = np.argsort(flat, kind="stable")
    post, post_of = owner[by], np.concatenate(([0], np.cumsum(np.bincount(flat, minlength=len(every)))))

    def path(s: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(every, s), len(every) - 1)
        return np.sort(rank[at[every[at] == s]])  # what no other set has can't be in an overlap

    paths = [path(s) for s in sets]
    long = np.array([len(p) for p in paths])
    by_path = sorted(range(len(sets)), key=lambda k: paths[k].astype(">u4").tobytes())  # bytes, as numbers of Python take ten times as much
    # how many leading n-grams neighbours of the sorted list share: the inner nodes of the tree
    shared = [0]
    for x, y in zip(by_path, by_path[1:]):
        k = min(len(paths[x]), len(paths[y]))
        differ = np.flatnonzero(paths[x][:k] != paths[y][:k])
        shared.append(int(differ[0]) if len(differ) else k)
    shared.append(0)
    ratio = threshold / (1 + threshold)

    def spread(tokens: np.ndarray, overlap: np.ndarray) -> np.ndarray:
        n = post_of[tokens + 1] - post_of[tokens]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(post_of[tokens] - (ends - n), n)
        return overlap + np.bincount(post[at], minlength=len(others))

    # (first, end) of the sorted paths below a node, its depth, overlaps on the way to it
    stack = [(0, len(sets), 0, np.zeros(len(others), np.int64))]
    while stack:
        first, end, depth, overlap = stack.pop()
        below = by_path[first:end]
        # a set can gain at most what remains below; it needs t/(1+t) of both sizes
        can = np.minimum(lengths, overlap + long[below].max() - depth)
        if not (can >= np.ceil(ratio * (other_sizes + sizes[below].min()) - _EPS)).any():
            continue
        if end - first == 1:
            k = below[0]
            total = spread(paths[k][depth:], overlap)
            hit = np.flatnonzero(total >= threshold * (other_sizes + sizes[k] - total) - _EPS)
            if own:
                hit = hit[hit != k]
            if len(hit):
                yield k, hit, total[hit]
            continue
        deep = min(shared[first + 1 : end])
        if deep > depth:
            overlap = spread(paths[below[0]][depth:deep], overlap)
        cuts = [first, *(k for k in range(first + 1, end) if shared[k] == deep), end]
        stack += [(x, y, deep, overlap) for x, y in zip(cuts, cuts[1:])]


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(whole, links, root) of each set that is similar to another of its block pair: documents linked, and a set it is connected with.

    Rows (component, low, high, block, whole, n, copies, grams) come sorted by the first three; sets of block low meet those of high.
    """

    def solved(rows: list[tuple]) -> pa.RecordBatch:
        same = rows[0][1] == rows[0][2]
        rows = rows if same else sorted(rows, key=lambda r: r[3] != r[1])
        cut = len(rows) if same else sum(r[3] == r[1] for r in rows)
        whole, copies = np.array([r[4] for r in rows], np.int64), np.array([r[6] for r in rows], np.int64)
        n = np.array([r[5] for r in rows], np.int64)
        sets = [np.frombuffer(r[7], X.U) for r in rows]
        links, forest, label = np.zeros(len(rows), np.int64), Forest(len(rows)), []
        if 0 < cut and (same or cut < len(rows)):
            held = 0
            for k, hit, _ in trie_join(sets, n) if same else trie_join(sets[:cut], n[:cut], sets[cut:], n[cut:]):
                hit = hit if same else hit + cut
                links[k] += copies[hit].sum()
                if not same:
                    links[hit] += copies[k]
                label.append((k, hit))
                held += len(hit)
                if held > 1 << 20:
                    forest.join(np.repeat([k for k, _ in label], [len(h) for _, h in label]), np.concatenate([h for _, h in label]))
                    label, held = [], 0
            if label:
                forest.join(np.repeat([k for k, _ in label], [len(h) for _, h in label]), np.concatenate([h for _, h in label]))
        hits = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(whole[hits]), pa.array(links[hits]), pa.array(whole[forest.roots()[hits]])], names=["whole", "links", "root"])

    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:3] != now and rows:
                yield solved(rows)
                rows = []
            now = row[:3]
            rows.append(row)
    if rows:
        yield solved(rows)


def _parts(df: DataFrame, amount: int, each: int) -> int:
    """How many parts an amount makes, as many as there are shuffle partitions at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-amount // each))


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, dict[int, int]]:
    """Documents (id, whole, n); classes (whole, n, rep, copies); and buckets with more than HEAVY occurrences."""
    own = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null")
    # repeats come together before the write, so that it makes few files and nothing shuffles them again
    read = checkpoint(own.mapInArrow(_describe, "id long, whole long, n long").groupBy("id", "whole", "n").agg(F.count("*").alias("times")))
    heavy = {r["whole"]: r["n"] for r in read.where("id is null").groupBy("whole").agg(F.sum(F.col("n") * F.col("times")).alias("n")).where(F.col("n") > HEAVY).collect()}  # 65,536 buckets at most
    units = read.where("id is not null").select("id", "whole", "n")
    return units, checkpoint(units.groupBy("whole", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))), heavy


def _candidates(docs: DataFrame, units: DataFrame, classes: DataFrame, heavy: dict[int, int]) -> DataFrame:
    """(whole, n, grams, rank) of the classes that can have a partner: step 1."""
    total = classes.agg(F.sum("n")).first()[0] or 0
    parts = _parts(docs, total, PART)
    # texts whose class another document stands for aren't read again
    known = units.join(classes.select("whole", "n", "rep"), ["whole", "n"]).groupBy(F.col("id").alias("copy_id")).agg(F.max(F.col("id") == F.col("rep")).alias("stands"))
    gone = checkpoint(known.where(~F.col("stands")).select("copy_id"))
    own = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null and text is not null")
    own = own.join(small(gone, 16), F.col("id") == F.col("copy_id"), "left_anti").select("id", "text")
    sent = own.mapInArrow(_scatter(parts, heavy, False), _BLOB).repartitionById(parts, "part").sortWithinPartitions("part")
    back = sent.mapInArrow(_shared(parts), _BLOB)
    back = back.unionAll(classes.where("n > 0").select("whole", "n").mapInArrow(_sizes(parts), _BLOB))
    if heavy:
        back = back.unionAll(own.mapInArrow(_scatter(parts, heavy, True), _BLOB))
    return checkpoint(back.repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(_ordered, "whole long, n int, grams binary, rank binary"))


def _connected(sets: DataFrame) -> DataFrame:
    """(whole, component) of sets that step 2 connects."""
    total = sets.agg(F.sum(F.octet_length("grams") / 16), F.count("*")).first()
    # at the first keys of the prefixes, which connect most near copies
    parts = _parts(sets, (total[1] or 0) * FIRST, PART // 4)
    begin = sets.select("*", F.col("whole").alias("component"), F.lit(None).cast("array<binary>").alias("wanted"))
    met = begin.mapInArrow(_meet(parts), _MEET).repartitionById(parts, "part").sortWithinPartitions("part")
    first = checkpoint(components(met.mapInArrow(_connect, "a long, b long"))).withColumnRenamed("id", "whole")
    # at all keys where sets of different components meet
    known = checkpoint(sets.join(small(first, 24), "whole", "left").select("whole", "n", "grams", "rank", F.coalesce("component", "whole").alias("component")))
    parts = _parts(sets, int(total[0] or 0), PART // 2)
    apart = known.mapInArrow(_list(parts), _KEYS).repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(_apart, "whole long, keys binary")
    wanted = checkpoint(apart.groupBy("whole").agg(F.collect_list("keys").alias("wanted")))
    left = wanted.agg(F.sum(F.aggregate("wanted", F.lit(0).cast("long"), lambda x, y: x + F.octet_length(y)))).first()[0] or 0
    parts = _parts(sets, left // 8, PART // 4)
    # lists of keys take several times their bytes on the driver, so no broadcast is asked for
    rest = known.join(wanted, "whole").select("whole", "n", "grams", "rank", "component", "wanted")
    met = rest.mapInArrow(_meet(parts), _MEET).repartitionById(parts, "part").sortWithinPartitions("part")
    more = met.mapInArrow(_connect, "a long, b long")
    return checkpoint(components(more.unionAll(first.select(F.col("whole").alias("a"), F.col("component").alias("b"))))).withColumnRenamed("id", "whole")


def _joined(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, classes, and (whole, links, root) of step 3."""
    units, classes, heavy = _classes(docs)
    sets = _candidates(docs, units, classes, heavy)
    members = _connected(sets)
    members = checkpoint(members.join(classes.select("whole", "n", "copies"), "whole"))
    sizes = members.groupBy("component").agg(F.least(F.count("*"), F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / GRAMS))).cast("int").alias("blocks"))
    several = checkpoint(sizes.where("blocks > 1"))
    members = members.drop("n")
    placed = members.join(small(several, 20), "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("whole"), F.col("blocks")).cast("int"))
    rows = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "whole", "copies")
    if (placed.agg(F.sum("blocks")).first()[0] or 0) * 80 <= BROADCAST_BYTES:
        rows = F.broadcast(rows)
    together = sets.select("whole", "n", "grams").join(rows, "whole").select("component", "low", "high", "block", "whole", "n", "copies", "grams")
    keys = ["component", "low", "high"]
    solved = together.repartition(_parts(docs, 0, 1), *keys).sortWithinPartitions(*keys).mapInArrow(_solve, "whole long, links long, root long")
    return units, classes, checkpoint(solved.groupBy("whole", "root").agg(F.sum("links").alias("links")))


def linked(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, copies, links) of every document: how many have its set, itself included, and how many others are linked with it."""
    units, classes, solved = _joined(docs)
    links = solved.groupBy("whole").agg(F.sum("links").alias("others"))
    twice = units.where("n > 0").groupBy("id").agg(F.min("whole").alias("a"), F.max("whole").alias("b")).where("a <> b")
    also = units.where("n > 0").join(twice, "id").where("whole <> a").select("whole", F.col("a").alias("root"))  # all texts of one doc_id
    edges = solved.where("whole <> root").select("whole", "root").unionAll(also).select(F.col("whole").alias("a"), F.col("root").alias("b"))
    member = checkpoint(components(edges).withColumnRenamed("id", "whole"))
    words = classes.where("n > 0")
    named = member.join(classes.select("whole", "rep"), "whole").groupBy("component").agg(F.min("rep").alias("class_id")).join(member, "component").select("whole", "class_id")
    about = words.join(links, "whole", "left").join(named, "whole", "left").select("whole", F.coalesce("class_id", "rep").alias("class_id"), "copies", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    empty = units.where("n = 0").select("id")
    with_words = units.where("n > 0").select("id", "whole").join(about, "whole").select(F.col("id").alias("doc_id"), "class_id", "copies", "links")
    return with_words.unionAll(empty.select("id", F.col("id").alias("class_id"), F.lit(1).cast("long"), F.lit(0).cast("long")))


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, group_id) of documents in a group of more than one; group_id is the group's least doc_id."""
    return linked(docs).groupBy("doc_id").agg(F.min("class_id").alias("group_id"), F.max("links").alias("links")).where("links > 0").select("doc_id", "group_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all their columns, without those of a group whose doc_id isn't its least.

    Rows linked with nothing stay, such as those of null ids or texts; so do repeated rows of a doc_id that stays.
    """
    gone = checkpoint(groups(docs).where("doc_id <> group_id").select(F.col("doc_id").alias("gone_id")))
    gone = small(gone, 16)
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")


#: The definition, by all n-grams that two classes have in common.
SQL = rf"""
with recursive said as (select distinct doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') as w from documents where doc_id is not null),
units as (select distinct doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) < {N} then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - {N} + 2), lambda i: array_to_string(w[i:i + {N - 1}], ' ')) end)) as s from said),
classes as (select row_number() over () as c, * from (select s, len(s) as n, min(doc_id) as rep, count(*) as copies from units where len(s) > 0 group by s)),
grams as materialized (select c, unnest(s) as g from classes),
common as (select x.c as a, y.c as b, count(*) as o from grams x join grams y on x.g = y.g and x.c < y.c group by 1, 2),
near as (select a, b from common join classes x on x.c = a join classes y on y.c = b where o >= {THRESHOLD} * (x.n + y.n - o) - 1e-9),
links as (select a, b from near union all select b, a from near),
own as (select doc_id, c from units join classes using (s)),
steps as (select a, b from links union select x.c, y.c from own x join own y on x.doc_id = y.doc_id),
reach as (select c, c as r from classes union select reach.c, b from reach join steps on r = a),
named as (select reach.c, min(k.rep) as class_id from reach join classes k on k.c = r group by reach.c),
others as (select a as c, sum(copies) as others from links join classes on c = b group by a)
select doc_id, class_id, copies, cast(copies - 1 + coalesce(others, 0) as bigint) as links
from own join classes using (c) join named using (c) left join others using (c)
union all select doc_id, doc_id, 1, 0 from units where len(s) = 0
"""
