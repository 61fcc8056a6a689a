"""Words of many texts at once, as 64-bit hashes in flat numpy arrays.

A word is a maximal run of letters, digits and underscores of the lower-cased text. Texts are joined into one
buffer of code points, so that classes, bounds and polynomial hashes of all words come from a few array passes;
hashing never loops over words in Python. Nulls count as empty texts. A text of any length is read whole: one that
is longer than a buffer is split at a character that belongs to no word.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np

U = np.uint64
BUFFER = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_WORD = np.array([chr(c).isalnum() or c == 95 for c in range(65536)])
_MIX = np.random.default_rng(20240229).integers(1, 1 << 63, 65536, dtype=np.int64).astype(U)
_powers = np.empty(0, U), np.empty(0, U)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers under which close inputs fall far apart."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _P and of its inverse, n of each at least. Those that two buffers need are kept."""
    global _powers
    if n <= len(_powers[0]):
        return _powers
    size = -(-n // 65536) * 65536
    up, down = np.full(size, _P, U), np.full(size, _PINV, U)
    up[0] = down[0] = 1
    np.cumprod(up, out=up)
    np.cumprod(down, out=down)
    if size <= 2 * BUFFER:
        _powers = up, down
    return up, down


def _astral(cp: np.ndarray, word: np.ndarray) -> None:
    big = np.flatnonzero(cp >= 65536)
    if len(big):
        kinds, at = np.unique(cp[big], return_inverse=True)
        word[big] = np.array([unicodedata.category(chr(c))[0] in "LN" for c in kinds])[at]


class Words:
    """Words of consecutive texts: hashes, character bounds, and of[i]:of[i + 1] for the words of text i."""

    __slots__ = ("cp", "sums", "hashes", "starts", "ends", "of", "inv")

    def __init__(self, texts: Sequence[str | None]):
        low = [(t or "").lower() for t in texts]
        cp = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        up, inv = _pow(len(cp))
        small = np.minimum(cp, 65535)
        word = _WORD[small]
        value = _MIX[small]
        if len(cp) and cp.max() >= 65536:
            _astral(cp, word)
            value = np.where(cp >= 65536, mix(cp.astype(U)), value)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
        self.cp, self.starts, self.ends, self.inv = cp, edge[::2], edge[1::2], inv
        self.sums = np.zeros(len(cp) + 1, U)
        np.cumsum(value * up[: len(cp)], out=self.sums[1:])
        self.hashes = mix((self.sums[self.ends] - self.sums[self.starts]) * inv[self.starts])
        at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in low]))).astype(np.int64)
        self.of = np.searchsorted(self.starts, at)

    def heads(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first n characters of each word that has more, and which words those are."""
        which = np.flatnonzero(self.ends - self.starts > n)
        s = self.starts[which]
        return mix((self.sums[s + n] - self.sums[s]) * self.inv[s] + U(n)), which


def split(text: str, most: int = BUFFER) -> Iterator[str]:
    """Pieces of a text, cut at characters outside words. A single word longer than a buffer stays whole."""
    at = 0
    while len(text) - at > most:
        cut = at + most
        while cut < len(text) and (text[cut].isalnum() or text[cut] == "_"):
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def batches(texts: Sequence[str | None], most: int = BUFFER) -> Iterator[tuple[int, int, list[str]]]:
    """(first, end, pieces) of consecutive texts of about so many characters; a longer text comes alone, in pieces."""
    first = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > first and size + n > most:
            yield first, i, [x or "" for x in texts[first:i]]
            first, size = i, 0
        size += n
        if size > most:
            yield first, i + 1, list(split(t or "", most))
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts), [x or "" for x in texts[first:]]


def hashes(texts: Sequence[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, word hashes, bounds): text first + i has the words bounds[i]:bounds[i + 1]."""
    for first, end, parts in batches(texts):
        w = Words(parts)
        of = w.of if len(parts) == end - first and end - first > 1 else np.array([0, len(w.hashes)])
        yield first, end, w.hashes, of


def grams(words: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words and their bounds by text; a text of fewer words has one gram of all of them."""
    sizes = np.diff(of)
    have = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    bounds = np.concatenate(([0], np.cumsum(have)))
    at = np.arange(bounds[-1]) + np.repeat(of[:-1] - bounds[:-1], have)
    size = np.minimum(np.repeat(sizes, have), n)
    out = np.zeros(len(at), U)
    for k in range(n):
        use = size > k
        out = np.where(use, out * U(0xD6E8FEB86659FD93) + words[np.minimum(at + k, max(len(words) - 1, 0))] if len(words) else out, out)
    return mix(out + size.astype(U)), bounds


def sets(words: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of each text in ascending order, and their bounds by text."""
    g, bounds = grams(words, of, n)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        g[a:b].sort()
    keep = np.ones(len(g), bool)
    keep[1:] = g[1:] != g[:-1]
    keep[bounds[:-1][np.diff(bounds) > 0]] = True
    total = np.concatenate(([0], np.cumsum(keep)))
    return g[keep], total[bounds]


def word_hash(word: str) -> int:
    """The hash that one word has in any text."""
    return int(Words([word]).hashes[0])
