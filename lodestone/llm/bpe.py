"""Byte-pair encoding and decoding in batched numpy merge rounds.

Texts are cut into words as the vocabulary's pattern demands, by classes of characters in array passes. The distinct words
of a batch stand with all their symbols in one flat array. In each round, keys of adjacent symbols are looked up by binary search in
the sorted keys of all pairs, and each word merges its pairs of lowest rank; words without a pair leave the array. The
tokens of distinct words are then copied to their places in the texts. Words that a worker has encoded before come from a table of
at most KEPT words; words are told apart by 128-bit hashes. Texts are never shuffled; the vocabulary is broadcast (about 1 MB).

A single word of more than LONG bytes is merged pair by pair from a queue, in time that grows little faster than its length.
All equal pairs of lowest rank in a word merge at once if no pair with their token has a lower rank, else only the first does,
so that the tokens are always those of merging one pair at a time.

Defined results: a null text has null tokens and a count of 0, an empty one an empty list. Repeated rows are encoded one by
one; a null doc_id is kept. Strings of special tokens are ordinary text. Decoding a null list gives null; ids outside the
vocabulary give null. Further columns are ignored.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm import text as X

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
KEPT, BATCH_CHARS = 400_000, 1 << 20
#: Bytes of a word from which on its pairs wait in a queue.
LONG = 4096
_LETTER, _NUMBER, _SPACE, _OTHER = range(4)


def _kind(c: int) -> int:
    ch = chr(c)
    k = unicodedata.category(ch)[0]
    # white space of Unicode, without the four separators U+001C to U+001F that Python counts too
    return _LETTER if k == "L" else _NUMBER if k == "N" else _SPACE if ch.isspace() and not 28 <= c <= 31 else _OTHER


_KINDS = np.array([_kind(c) for c in range(65536)], np.uint8)
_MIX2 = np.random.default_rng(77).integers(1, 1 << 63, 65536, dtype=np.int64).astype(X.U)


def words(cp: np.ndarray, text_ends: np.ndarray) -> np.ndarray:
    """Starts of all words of consecutive texts, given as code points; text_ends: where each text ends."""
    n = len(cp)
    kind = _KINDS[np.minimum(cp, 65535)]
    for at in np.flatnonzero(cp >= 65536):
        kind[at] = _kind(int(cp[at]))
    head = np.zeros(n + 1, bool)  # a text begins here
    head[0] = True
    head[text_ends] = True
    start = head.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    space = np.concatenate((kind == _SPACE, [False]))
    # the last of some white space before other text: alone, or, if a blank, with that text
    last = np.zeros(n + 1, bool)
    last[: n - 1] = space[: n - 1] & ~space[1:n] & ~head[1:n]
    start |= last
    blank = last.copy()
    blank[:n] &= cp == 32
    after = np.flatnonzero(blank) + 1
    start[after] = False
    # contractions: an apostrophe that begins a word, and letters right after it
    mark = np.flatnonzero((cp == 39) & start[:n])
    mark = mark[start[np.minimum(mark + 1, n)] & ~head[np.minimum(mark + 1, n)]]
    if len(mark):
        one = np.where(mark + 1 < n, cp[np.minimum(mark + 1, n - 1)], 0)
        two = np.where((mark + 2 < n) & ~head[np.minimum(mark + 2, n)], cp[np.minimum(mark + 2, n - 1)], 0)
        long = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
        short = np.isin(one, [115, 116, 109, 100])
        for m, k in ((mark[short], 2), (mark[long & ~short], 3)):
            start[m + 1] = False
            start[np.minimum(m + k, n)] = True
    return np.flatnonzero(start[:n])


class Bpe:
    """A vocabulary of byte strings by rank, with the sorted keys of all pairs that merge."""

    def __init__(self, data: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        self.size = max(ranks.values()) + 1
        pairs = sorted((ranks[t[:k]] << 20 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks)
        self.keys, self.merged = np.array([k for k, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int64)
        least = np.full(self.size, self.size)  # of the pairs that have a token as a part
        np.minimum.at(least, self.keys >> 20, self.merged)
        np.minimum.at(least, self.keys & 0xFFFFF, self.merged)
        self.safe = least > np.arange(self.size)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        table = [b""] * self.size
        for t, r in ranks.items():
            table[r] = t
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.of = np.concatenate(([0], np.cumsum([len(t) for t in table])))
        self.known = np.array([bool(t) for t in table])
        self.pairs: dict[int, int] | None = None
        self._forget()

    def _forget(self) -> None:
        self._h, self._place = np.zeros(0, X.U), np.zeros(0, np.int64)
        self._check = np.zeros(0, X.U)
        self._tokens, self._ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that each pair merges to; size for none."""
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], self.size)

    def merge(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, ends) of words: the merge rounds."""
        size = np.array([len(w) for w in words], np.int64)
        sym = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        done_sym, done_word = [], []
        for k in np.flatnonzero(size > LONG).tolist():
            tokens = self.queued(sym[word == k].tolist())
            done_sym.append(np.array(tokens, np.int32))
            done_word.append(np.full(len(tokens), k))
        if done_sym:
            short = size[word] <= LONG
            sym, word = sym[short], word[short]
        rank = np.full(len(sym), self.size)  # of each symbol with the next
        rank[:-1] = np.where(word[:-1] == word[1:], self.ranks(sym[:-1], sym[1:]), self.size)
        while len(sym):
            begin = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(rank, begin)
            sizes = np.diff(np.append(begin, len(sym)))
            best_at = np.repeat(best, sizes)
            over = best_at == self.size
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                sym, word, rank, best_at = sym[~over], word[~over], rank[~over], best_at[~over]
                if not len(sym):
                    break
            hit = rank == best_at
            at = np.flatnonzero(hit)
            # of overlapping hits every second goes, of unsafe tokens all but the first
            new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (word[at[1:]] != word[at[:-1]])))
            run = np.flatnonzero(new)
            odd = (np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2
            first = np.concatenate(([True], word[at[1:]] != word[at[:-1]]))
            at = at[(odd == 0) & (self.safe[best_at[at]] | first)]
            sym[at] = best_at[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            rank[at] = -1
            sym, word, rank = sym[keep], word[keep], rank[keep]
            at = np.flatnonzero(rank == -1)
            again = np.unique(np.concatenate((at, at[at > 0] - 1)))
            again = again[(rank[again] == -1) | np.isin(again + 1, at)]
            nxt = np.minimum(again + 1, len(sym) - 1)
            rank[again] = np.where((again + 1 < len(sym)) & (word[again] == word[nxt]), self.ranks(sym[again], sym[nxt]), self.size)
        sym = np.concatenate([*done_sym, np.zeros(0, np.int32)]).astype(np.int32)
        word = np.concatenate([*done_word, np.zeros(0, np.int64)])
        order = np.argsort(word, kind="stable")
        return sym[order], np.cumsum(np.bincount(word, minlength=len(words)))

    def queued(self, sym: list[int]) -> list[int]:
        """The tokens of one very long word, for which rounds would take its length squared: pairs wait in a queue by rank and place."""
        if self.pairs is None:
            self.pairs = dict(zip(self.keys.tolist(), self.merged.tolist()))
        n, find = len(sym), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, k) for k in range(n - 1) if (r := find(sym[k] << 20 | sym[k + 1])) is not None]
        heapify(queue)
        while queue:
            r, k = heappop(queue)
            if sym[k] < 0 or after[k] >= n or find(sym[k] << 20 | sym[after[k]]) != r:
                continue  # a pair that is gone
            gone = after[k]
            sym[k], sym[gone], after[k] = r, -1, after[gone]
            if after[k] < n:
                before[after[k]] = k
                if (x := find(r << 20 | sym[after[k]])) is not None:
                    heappush(queue, (x, k))
            if before[k] >= 0 and (x := find(sym[before[k]] << 20 | r)) is not None:
                heappush(queue, (x, before[k]))
        return [x for x in sym if x >= 0]

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, bounds): text i has tokens[bounds[i]:bounds[i + 1]]."""
        whole = "".join(texts)
        cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        if not len(cp):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        start = words(cp, ends)
        stop = np.append(start[1:], len(cp))
        up, inv = X._pow(len(cp))
        small = np.minimum(cp, 65535)
        hashes = []
        for table in (X._MIX, _MIX2):
            value = table[small]
            if cp.max() >= 65536:
                value = np.where(cp >= 65536, X.mix(cp.astype(X.U) + table[7]), value)
            sums = np.zeros(len(cp) + 1, X.U)
            np.cumsum(value * up[: len(cp)], out=sums[1:])
            hashes.append(X.mix((sums[stop] - sums[start]) * inv[start]))
        h, lead, where = np.unique(hashes[0], return_index=True, return_inverse=True)
        if (hashes[1][lead][where] != hashes[1]).any():  # two words of one hash: keep the words apart by both
            both = np.stack(hashes, axis=1)
            _, lead, where = np.unique(both, axis=0, return_index=True, return_inverse=True)
            toks, tends = self.merge([whole[a:b].encode("utf-8", "surrogatepass") for a, b in zip(start[lead].tolist(), stop[lead].tolist())])
            first = np.concatenate(([0], tends))[:-1]
            return self._lay(toks, first, tends, where.ravel(), start, ends)
        if len(self._h) > KEPT:
            self._forget()
        check = hashes[1][lead]
        at = np.minimum(np.searchsorted(self._h, h), max(len(self._h) - 1, 0))
        known = (self._h[at] == h) & (self._check[at] == check) if len(self._h) else np.zeros(len(h), bool)
        new = np.flatnonzero(~known)
        if len(new):
            toks, tends = self.merge([whole[a:b].encode("utf-8", "surrogatepass") for a, b in zip(start[lead[new]].tolist(), stop[lead[new]].tolist())])
            first_place = len(self._ends) - 1
            self._ends = np.concatenate((self._ends, self._ends[-1] + tends))
            self._tokens = np.concatenate((self._tokens, toks))
            all_h = np.concatenate((self._h, h[new]))
            order = np.argsort(all_h, kind="stable")
            self._h = all_h[order]
            self._check = np.concatenate((self._check, check[new]))[order]
            self._place = np.concatenate((self._place, first_place + np.arange(len(new))))[order]
            at = np.searchsorted(self._h, h)
            same = self._check[at] == check
            while not same.all():  # of entries with one hash, the one whose second hash agrees
                at = np.where(same, at, at + 1)
                same = self._check[at] == check
        place = self._place[at]
        return self._lay(self._tokens, self._ends[place], self._ends[place + 1], where.ravel(), start, ends)

    @staticmethod
    def _lay(tokens: np.ndarray, first: np.ndarray, stop: np.ndarray, where: np.ndarray, start: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = (stop - first)[where]
        total = np.concatenate(([0], np.cumsum(n)))
        out = tokens[np.arange(total[-1]) + np.repeat(first[where] - total[:-1], n)]
        return out, np.concatenate(([0], total[np.searchsorted(start, ends)]))

    def decode(self, tokens: np.ndarray) -> bytes:
        """The bytes of tokens, all of which are in the vocabulary."""
        n = self.of[tokens + 1] - self.of[tokens]
        total = np.cumsum(n)
        return self.flat[np.arange(total[-1] if len(total) else 0) + np.repeat(self.of[tokens] - (total - n), n)].tobytes()


def load(path: str = VOCABULARY) -> bytes:
    """A vocabulary file, read on the driver."""
    with open(path, "rb") as f:
        return f.read()


_built: dict[int, Bpe] = {}


def _bpe(data: bytes) -> Bpe:
    key = hash(data)
    if key not in _built:
        _built.clear()
        _built[key] = Bpe(data)
    return _built[key]


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, tokens, exact): exact tells whether decoding the tokens gives the text again."""
    shared = docs.sparkSession.sparkContext.broadcast(load(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(shared.value)
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0)
            first = 0
            while first < len(texts):
                end, size = first, 0
                while end < len(texts) and (end == first or size + len(texts[end] or "") <= BATCH_CHARS):
                    size += len(texts[end] or "")
                    end += 1
                some = texts[first:end]
                tokens, bounds = bpe.encode([t or "" for t in some])
                raw, at = bpe.decode(tokens), 0
                exact = []
                for t in some:
                    b = (t or "").encode()
                    exact.append(raw[at : at + len(b)] == b)
                    at += len(b)
                null = np.array([t is None for t in some])
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(tokens, pa.int32()), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays([ids.slice(first, end - first), pa.array(np.diff(bounds).astype(np.int32)), lists, pa.array(exact)], names=["doc_id", "n_tokens", "tokens", "exact"])
                first = end

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens int, tokens array<int>, exact boolean")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of rows (doc_id, tokens)."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(shared.value)
        for batch in batches:
            out = []
            for row in batch.column(1):
                t = row.values.to_numpy(zero_copy_only=False) if row.is_valid else None
                ok = t is not None and row.values.null_count == 0 and ((t >= 0) & (t < bpe.size)).all() and bpe.known[t.astype(np.int64)].all()
                out.append(bpe.decode(t.astype(np.int64)).decode("utf-8", "replace") if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "tokens").mapInArrow(run, f"doc_id {kind}, text string")
