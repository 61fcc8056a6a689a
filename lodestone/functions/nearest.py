"""Levenshtein distances of a text to all of many sorted names at once, which share the work on their common beginnings.

The names are levels of a trie: a level holds for each different beginning of its length the state of Myers' bit-parallel
algorithm, blocks of 64 characters of the text each in a word, so a level is some twenty array operations.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_ONE, _TOP = np.uint64(1), np.uint64(63)


class Names:
    """Names in sorted order; repeats are allowed. shown: what a name stands for, for the order of equal distances."""

    def __init__(self, names: Sequence[str], shown: Sequence[str] = ()) -> None:
        self.size = len(names)
        self.shown = shown or names
        self.rank = np.empty(self.size, np.int64)
        self.rank[sorted(range(self.size), key=self.shown.__getitem__)] = np.arange(self.size)
        self.longest = max(map(len, names), default=0)
        wide = np.array(names, dtype=f"<U{max(1, self.longest)}").view(np.uint32).reshape(self.size, -1) if self.size else np.zeros((0, 1), np.uint32)
        self.lengths = np.array([len(n) for n in names], np.int64)
        self.codes, flat = np.unique(wide, return_inverse=True)
        flat = flat.reshape(wide.shape)
        #: Of each level: the parent of each node in the level before, its character's number, how many more characters the longest name below it has, and the names that end there with their nodes.
        self.levels: list[tuple[np.ndarray, ...]] = []
        rows, node = np.arange(self.size), np.zeros(self.size, np.int64)
        self.empty = rows[self.lengths == 0]
        for k in range(self.longest):
            keep = self.lengths[rows] > k
            rows, node = rows[keep], node[keep]
            c = flat[rows, k]
            fresh = np.ones(len(rows), bool)  # where a beginning differs from that of the name before
            fresh[1:] = (node[1:] != node[:-1]) | (c[1:] != c[:-1])
            new = np.cumsum(fresh) - 1
            ends = self.lengths[rows] == k + 1
            more = np.maximum.reduceat(self.lengths[rows], np.flatnonzero(fresh)) - k - 1
            self.levels.append((node[fresh], c[fresh], more, rows[ends], new[ends]))
            node = new

    def distances(self, text: str, most: int) -> np.ndarray:
        """The distance of the text to each name, in characters; where it is more than most, most + 1 or any greater number."""
        m = len(text)
        out = np.full(self.size, most + 1, np.int64)
        out[self.empty] = m
        if not m:
            return self.lengths.copy()
        words = -(-m // 64)
        equal = np.zeros((words, len(self.codes)), np.uint64)
        at = {c: k for k, c in enumerate(self.codes.tolist())}
        for i, ch in enumerate(text):
            if (k := at.get(ord(ch))) is not None:
                equal[i // 64, k] |= np.uint64(1 << i % 64)
        plus, minus, score = [np.full(1, ~np.uint64(0))] * words, [np.zeros(1, np.uint64)] * words, np.full(1, m, np.int32)
        last = np.uint64((m - 1) % 64)
        place = None  # of the nodes of the level before among those that are left, or -1; None: all are left
        for parent, char, more, names, nodes in self.levels:
            if place is not None:
                parent = place[parent]
                left = parent >= 0
                place = np.where(left, np.cumsum(left) - 1, -1)
                parent, char, more = parent[left], char[left], more[left]
                if not len(parent):
                    break
            up, down = np.ones(len(parent), np.uint64), np.zeros(len(parent), np.uint64)  # the first row grows by one with each character
            for w in range(words):
                pv, mv, eq = plus[w][parent], minus[w][parent], equal[w][char]
                xv = eq | mv
                eq = eq | down
                xh = (((eq & pv) + pv) ^ pv) | eq
                ph, mh = mv | ~(xh | pv), pv & xh
                if w == words - 1:
                    score = score[parent] + ((ph >> last) & _ONE).astype(np.int32) - ((mh >> last) & _ONE).astype(np.int32)
                    next_up = next_down = None
                else:
                    next_up, next_down = (ph >> _TOP) & _ONE, (mh >> _TOP) & _ONE
                ph, mh = (ph << _ONE) | up, (mh << _ONE) | down
                plus[w], minus[w] = mh | ~(xv | ph), ph & xv
                up, down = next_up, next_down
            if place is None:
                out[names] = score[nodes]
            else:
                there = place[nodes] >= 0
                out[names[there]] = score[place[nodes[there]]]
            alive = score - more <= most  # a distance falls by one at most with each character
            if not alive.all():
                index = np.where(alive, np.cumsum(alive) - 1, -1)
                place = index if place is None else np.where(place >= 0, index[place], -1)
                plus, minus, score = [x[alive] for x in plus], [x[alive] for x in minus], score[alive]
        return out


def by_length(names: Sequence[str], shown: Sequence[str]) -> list[Names]:
    """The names in groups of like lengths, so that a few long ones don't widen all."""
    groups: dict[int, list[int]] = {}
    for k, n in enumerate(names):
        groups.setdefault((len(n) // 64).bit_length(), []).append(k)
    return [Names([names[k] for k in ks], [shown[k] for k in ks]) for ks in groups.values()]


def closest(parts: Sequence[Names], text: str, most: int, limit: int) -> list[tuple[str, int]]:
    """(shown, distance) of the first so many by distance, of 1 to most, and by what they show."""
    out = []
    for p in parts:
        if not p.size or p.lengths.min() - len(text) > most or len(text) - p.longest > most:
            continue
        d = p.distances(text, most)
        hit = np.flatnonzero((d > 0) & (d <= most))
        key = d[hit] * p.size + p.rank[hit]
        if len(hit) > limit:
            hit = hit[np.argpartition(key, limit - 1)[:limit]]
        out += [(int(d[k]), p.shown[k]) for k in hit.tolist()]
    return [(s, d) for d, s in sorted(out)[:limit]]
