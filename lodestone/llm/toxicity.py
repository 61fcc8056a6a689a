"""Toxicity: a linear classifier over hashed words and word beginnings, regularised by counterfactuals.

In every labelled text that mentions an identity group, the mention is swapped for the other terms of its set; the
squared change of the score is added to the loss. A term that labels merely happen to follow then carries no weight,
so that neutral mentions of groups aren't rejected.

Near copies in the sample count as one text (the first): otherwise any word of a toxic text with many copies would seem toxic.

The fit uses a bounded sample of the labelled rows (``most_clean`` and ``most_toxic``, those of the least hash of
doc_id, so the same rows at every run); scoring covers the whole text of every row.

Defined results: a null or empty text, or one without words, has toxicity 0.0 and is clean. Rows with a null doc_id
are scored like any other; labels with a null doc_id or a null ``toxic`` are not used; of several labels of a doc_id
the largest counts. Repeated rows are scored one by one. Further columns of either table are ignored by ``score``
and kept by ``keep_clean``. If the labels lack one of the classes (or are empty, or tell the classes apart by nothing), every score is 0.0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import text as X

BITS = 22
HEADS = (4, 5, 6)
COPY_ORDERS = 8
MOST_TOXIC, MOST_CLEAN, MOST_FEATURES = 3000, 5000, 20000
#: A feature is used if its mean values in the classes differ by so many standard errors, and it is in so many texts.
LEAST_Z, LEAST_TEXTS = 5.0, 5
PENALTY, RIDGE = 4.0, 3e-3
THRESHOLD = 0.5
_KEYS = np.random.default_rng(10).integers(1, 1 << 62, (64, 2), dtype=np.int64).astype(X.U) * X.U(2) + X.U(1)

#: Sets of terms of which one can stand for another in a sentence without changing how toxic it is.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"), ("woman", "man"), ("women", "men"), ("girl", "boy"), ("girls", "boys"), ("female", "male"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"), ("deaf", "blind", "disabled"), ("old", "young", "elderly"),
    ("american", "mexican", "chinese", "russian", "arab", "indian", "french", "german", "spanish"), ("immigrant", "immigrants", "refugee", "refugees"),
    ("frau", "mann"), ("frauen", "männer"), ("femme", "homme"), ("femmes", "hommes"), ("mujer", "hombre"), ("mujeres", "hombres"),
    ("musulman", "chrétien", "juif"), ("musulmán", "cristiano", "judío"), ("juden", "christen", "muslime"),
)


def _features(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, its word, bounds of words by text): the word itself, and its beginnings of HEADS characters."""
    w = X.Words(parts)
    ids, at = [w.hashes], [np.arange(len(w.hashes))]
    for n in HEADS:
        h, which = w.heads(n)
        ids.append(h)
        at.append(which)
    return (np.concatenate(ids) >> X.U(64 - BITS)).astype(np.int64), np.concatenate(at), w.of


def weigh(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    """The weights of a text's features summed, by the square root of its number of words; the last weight is added."""
    out = np.zeros(len(texts))
    for first, end, parts in X.batches(texts):
        ids, at, of = _features(parts)
        words = np.bincount(at, weights[ids], minlength=of[-1]) if len(ids) else np.zeros(0)
        sums = np.concatenate(([0.0], np.cumsum(words)))
        one = end - first == 1
        total = np.array([sums[-1]]) if one else sums[of[1:]] - sums[of[:-1]]
        n = np.array([of[-1]]) if one else np.diff(of)
        out[first:end] = np.where(n > 0, total / np.sqrt(np.maximum(n, 1)) + weights[-1], -np.inf)
    return out


def swaps(text: str) -> list[str]:
    """The text with its identity terms exchanged for the others of their sets, one text for each shift."""
    words = text.split()
    places = [(i, s, s.index(k)) for i, w in enumerate(words) if (k := w.lower().strip(".,;:!?\"'()")) in _TERMS for s in (_TERMS[k],)]
    out = []
    for shift in range(1, max((len(s) for _, s, _ in places), default=1)):
        copy = list(words)
        for i, s, k in places:
            copy[i] = s[(k + shift) % len(s)]
        out.append(" ".join(copy))
    return out


_TERMS = {t: s for s in reversed(IDENTITY) for t in s}


def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and their counts by the square root of its number of words."""
    ids, n = [], 0
    for part in X.split(text):
        i, _, of = _features([part])
        ids.append(i)
        n += int(of[-1])
    feature, count = np.unique(np.concatenate(ids), return_counts=True)
    return feature, count / np.sqrt(max(n, 1))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], pairs: list[tuple[np.ndarray, np.ndarray]], most: int = MOST_FEATURES, penalty: float = PENALTY, rounds: int = 150) -> np.ndarray:
    """Weights by feature, the bias last. rows: (label, features, values); pairs: features and value changes by a swap."""
    weights = np.zeros((1 << BITS) + 1)
    y = np.array([r[0] for r in rows], float)
    if not 0 < y.sum() < len(y):
        weights[-1] = -np.inf
        return weights
    size, n1, n0 = 1 << BITS, y.sum(), len(y) - y.sum()
    seen, one, all_, squares = np.zeros(size, np.int32), *(np.zeros(size, np.float32) for _ in range(3))
    for label, feature, value in rows:  # features of a row are distinct; row by row, as all rows at once take much of the driver's memory
        seen[feature] += 1
        all_[feature] += value
        squares[feature] += value**2
        if label:
            one[feature] += value
    often = np.flatnonzero(seen >= LEAST_TEXTS)
    one, all_, squares = (x[often].astype(float) for x in (one, all_, squares))
    error = np.sqrt(np.maximum(squares / len(y) - (all_ / len(y)) ** 2, 1e-12) * (1 / n1 + 1 / n0))
    z = np.abs(one / n1 - (all_ - one) / n0) / error
    best = np.argsort(-z, kind="stable")[:most]
    chosen = np.sort(often[best[z[best] >= LEAST_Z]])
    if not len(chosen):
        weights[-1] = -np.inf
        return weights
    place = np.full(size, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    kept = [place[r[1]] >= 0 for r in rows]
    f = np.concatenate([place[r[1][k]] for r, k in zip(rows, kept)])
    value = np.concatenate([r[2][k] for r, k in zip(rows, kept)]).astype(float)
    of = np.repeat(np.arange(len(rows)), [int(k.sum()) for k in kept])
    scale = np.sqrt(np.bincount(f, value**2, minlength=len(chosen)) / len(y) + 1e-4)
    value = value / scale[f]
    pf = np.concatenate([place[i] for i, _ in pairs]) if pairs else np.zeros(0, int)
    pv = np.concatenate([v for _, v in pairs]) if pairs else np.zeros(0)
    po = np.repeat(np.arange(len(pairs)), [len(i) for i, _ in pairs]) if pairs else np.zeros(0, int)
    keep = pf >= 0
    pf, pv, po = pf[keep], pv[keep] / scale[pf[keep]], po[keep]
    balance = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, b = np.zeros(len(chosen)), 0.0
    m = v = np.zeros(len(chosen) + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(of, value * w[f], minlength=len(y)) + b
        e = balance * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        g = np.bincount(f, value * e[of], minlength=len(w)) + RIDGE * w
        if len(pairs):
            change = np.bincount(po, pv * w[pf], minlength=len(pairs))
            g += 2 * penalty / len(pairs) * np.bincount(pf, pv * change[po], minlength=len(w))
        g = np.append(g, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    weights[chosen] = w / scale
    weights[-1] = b
    return weights


def paths(text: str) -> list[int]:
    """What near copies of a text share at least one of: the two least of its n-grams in COPY_ORDERS orders."""
    _, _, words, of = next(X.hashes([text]))
    grams, _ = X.sets(words, of, 3)
    out = []
    for r in range(COPY_ORDERS if len(grams) else 0):
        h = (grams ^ _KEYS[r, 0]) * _KEYS[r, 1]
        h ^= h >> X.U(32)
        h *= _KEYS[r, 0]
        least = np.sort(np.partition(h, 1)[:2] if len(h) > 1 else np.append(h, ~X.U(0)))
        mixed = X.mix(least[:1] + X.mix(least[1:]))
        out.append(int((((mixed >> X.U(8)) << X.U(8)) | X.U(r)).view(np.int64)[0]))
    return out


def unlike(rows: list[list[int]]) -> list[int]:
    """The first of each group of rows that share a path, directly or through others."""
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    seen: dict[int, int] = {}
    for i, row in enumerate(rows):
        for p in row:
            a, b = sorted((find(i), find(seen.setdefault(p, i))))
            root[b] = a
    return [i for i in range(len(rows)) if find(i) == i]


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            i, v = vector(text or "")
            rows.append((y, i, v, False, paths(text or "")))
            for s in swaps(text or ""):
                j, u = vector(s)
                every = np.union1d(i, j)
                change = np.zeros(len(every))
                change[np.searchsorted(every, i)] += v
                change[np.searchsorted(every, j)] -= u
                rows.append((y, every[change != 0], change[change != 0], True, []))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1].astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([r[2].astype(np.float32) for r in rows], pa.list_(pa.float32())), pa.array([r[3] for r in rows]), pa.array([r[4] for r in rows], pa.list_(pa.int64()))], names=["y", "i", "v", "swap", "p"]
            )


def sample(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> DataFrame:
    """At most so many labelled texts of each class: those with the least hashes of doc_id."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    hashed = one.withColumn("r", F.xxhash64("doc_id"))
    some = hashed.where("y = 1").orderBy("r", "doc_id").limit(most_toxic).unionByName(hashed.where("y = 0").orderBy("r", "doc_id").limit(most_clean))
    # the side is bounded by the two parameters
    return docs.select("doc_id", "text").join(F.broadcast(some.select("doc_id", "y")), "doc_id").select("y", "text")


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, penalty: float = PENALTY) -> np.ndarray:
    """Weights fitted to the sample. Only sparse vectors of the sample reach the driver."""
    got = sample(docs, labels, most_toxic, most_clean).mapInArrow(_vectors, "y int, i array<int>, v array<float>, swap boolean, p array<long>").toArrow()
    rows, pairs = [], []
    for chunk in got.to_batches():
        i, v = chunk.column("i"), chunk.column("v")
        for k, (y, swap, p) in enumerate(zip(*(chunk.column(c).to_pylist() for c in ("y", "swap", "p")))):
            a, b = i[k].values.to_numpy(), v[k].values.to_numpy()
            pairs.append((a, b)) if swap else rows.append((y, a, b, p))
    rows.sort(key=lambda r: (-r[0], len(r[1]), hashlib.blake2b(r[1].tobytes()).digest()))  # the same order at every run
    return fit([rows[k][:3] for k in unlike([r[3] for r in rows])], pairs, penalty=penalty)


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, toxicity, toxic) for every row of docs."""
    kept = np.flatnonzero(weights[:-1])
    shared = docs.sparkSession.sparkContext.broadcast((kept.astype(np.int32), weights[kept], weights[-1]))  # MOST_FEATURES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, value, bias = shared.value
        full = np.zeros((1 << BITS) + 1)
        full[at], full[-1] = value, bias
        for batch in batches:
            p = 1 / (1 + np.exp(-np.clip(weigh(batch.column(1).to_pylist(), full), -700, 700)))
            p = np.where(p < 1e-12, 0.0, np.round(p, 6))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(p >= threshold)], names=["doc_id", "toxicity", "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, toxicity double, toxic boolean")


def keep_clean(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that aren't toxic, with all their columns; no shuffle, texts pass through Python as one column."""
    kept = np.flatnonzero(weights[:-1])
    shared = docs.sparkSession.sparkContext.broadcast((kept.astype(np.int32), weights[kept], weights[-1]))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, value, bias = shared.value
        full = np.zeros((1 << BITS) + 1)
        full[at], full[-1] = value, bias
        for batch in batches:
            p = 1 / (1 + np.exp(-np.clip(weigh(batch.column(place).to_pylist(), full), -700, 700)))
            yield batch.filter(pa.array(np.round(p, 6) < threshold))

    return docs.mapInArrow(run, docs.schema)
