"""Benchmark decontamination: a BM25 inverted index of test items, searched by block-max WAND.

Every document is cut into overlapping passages, and each passage is a query against the index of items. A score is
BM25 as a share of what the item scores against itself, so that one threshold holds for items of any length. All
items at or above it are retrieved, exactly: nothing is capped.

A batch of passages walks the posting lists in lockstep, as array passes rather than one cursor for each:

1. WAND: the greatest impacts of a passage's terms bound its score against any item. Passages whose bound falls short
   are left. In the others, the terms of least impact that fall short together can't be a pivot; only the lists
   of the rest are opened.
2. Block-max: posting lists have a greatest impact for each block of BLOCK items. A block that the opened lists touch is
   read only if the sum of its greatest impacts reaches the threshold.
3. In blocks that are read, items are scored in full.

A retrieved item counts as leaked if the passage holds at least QUESTION of its question's word n-grams and ANSWER of
its answer's. An item's answer follows "answer:", else its last question mark, else it is the last sentence (of a single
sentence the last quarter of its words).

Passages are 2 S words long and start every S words, where S is the longest item's number of words (LEAST_STRIDE at least):
any copy of an item lies whole in a passage. The documents are read once and never shuffled. The index grows with the benchmark alone;
one of more than INDEX_BYTES is split in parts that executors build and that are broadcast one by one; a task searches them in turn.

Defined results: null or empty texts and texts without words match nothing, nor do such items. A null doc_id or item_id
is kept as null. Repeated rows of either table are matched one by one. Empty tables give no rows. Further columns are
ignored by ``leaks`` and kept by ``keep_unleaked``.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.llm import text as X
from lodestone.state import checkpoint

THRESHOLD, QUESTION, ANSWER = 0.5, 0.5, 0.5
K1, B, BLOCK, NGRAM, LEAST_STRIDE = 1.2, 0.75, 16, 3, 64
#: Bytes of item texts in one part of the index.
INDEX_BYTES = 16 << 20
_EPS = 1e-9


def split_item(text: str) -> tuple[str, str]:
    """(question, answer) of an item."""
    if m := re.search(r"\banswer\s*:", text, re.I):
        if text[m.end() :].strip():
            return text[: m.start()], text[m.end() :]
    at = text.rstrip().rfind("?")
    if 0 <= at and text[at + 1 :].strip():
        return text[: at + 1], text[at + 1 :]
    body = text.rstrip().rstrip(".!?")
    cuts = [m.end() for m in re.finditer(r"[.!?\n]\s*", body)]
    if cuts and cuts[-1] < len(body):
        return text[: cuts[-1]], text[cuts[-1] :]
    words = text.split(" ")
    n = max(1, len(words) // 4)
    return " ".join(words[:-n]), " ".join(words[-n:])


def _words(text: str) -> np.ndarray:
    return X.Words([text]).hashes


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    return np.unique(X.grams(words, np.array([0, len(words)]), n)[0]) if len(words) >= n else np.zeros(0, X.U)


class Index:
    """Posting lists of items with their greatest impacts, by list and by block."""

    def __init__(self, ids: list, texts: list[str], df: dict[int, int], n_items: int, mean_words: float, stride: int):
        docs = [_words(t) for t in texts]
        self.ids, self.stride = ids, stride
        self.parts = [tuple(_words(p) for p in split_item(t)) for t in texts]
        term, item, tf = [], [], []
        for k, words in enumerate(docs):
            u, c = np.unique(words, return_counts=True)
            term.append(u)
            tf.append(c)
            item.append(np.full(len(u), k))
        term, item, tf = np.concatenate(term), np.concatenate(item), np.concatenate(tf)
        self.vocab, at = np.unique(term, return_inverse=True)
        n = np.array([df[w] for w in self.vocab.tolist()])
        size = np.array([len(w) for w in docs])
        impact = np.log(1 + (n_items - n + 0.5) / (n + 0.5))[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / mean_words))
        impact /= np.bincount(item, impact, minlength=len(docs))[item]
        order = np.lexsort((item, at))
        self.item, self.impact, at = item[order], impact[order], at[order]
        self.of = np.searchsorted(at, np.arange(len(self.vocab) + 1))
        self.most = np.maximum.reduceat(self.impact, self.of[:-1])
        block = self.item // BLOCK
        new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (block[1:] != block[:-1]))))
        self.block, self.block_most = block[new], np.maximum.reduceat(self.impact, new)
        self.block_of = np.searchsorted(at[new], np.arange(len(self.vocab) + 1))
        self.blocks = len(docs) // BLOCK + 1
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.vocab >> X.U(44)).astype(np.int64)] = True

    def search(self, words: np.ndarray, of: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float, int, int]]:
        """(text, item, score, first word, end) of every passage and item at or above the threshold."""
        s, size = self.stride, np.diff(of)
        passages = np.where(size > 0, np.maximum(-(-size // s) - 1, 1), 0)
        base = np.concatenate(([0], np.cumsum(passages)))
        at = np.flatnonzero(self.seen[(words >> X.U(44)).astype(np.int64)])
        term = np.minimum(np.searchsorted(self.vocab, words[at]), len(self.vocab) - 1)
        same = self.vocab[term] == words[at]
        at, term = at[same], term[same]
        if not len(at):
            return
        text = np.searchsorted(of, at, "right") - 1
        cell, last = (at - of[text]) // s, passages[text] - 1
        own, before = np.minimum(cell, last), cell - 1
        also = (before >= 0) & (before < own)
        v = len(self.vocab)
        key = np.unique(np.concatenate(((base[text] + own) * v + term, ((base[text] + before) * v + term)[also])))
        passage, term = key // v, key % v

        live = np.bincount(passage, self.most[term], minlength=base[-1]) >= threshold - _EPS  # WAND's bound
        use = live[passage]
        passage, term = passage[use], term[use]
        if not len(term):
            return
        order = np.lexsort((self.most[term], passage))
        p, t = passage[order], term[order]
        total = np.cumsum(self.most[t])
        first = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
        before = (total - self.most[t])[first]
        pivot = total - np.repeat(before, np.diff(np.concatenate((first, [len(p)])))) >= threshold - _EPS
        row, block = _expand(t[pivot], self.block_of)
        open_ = np.unique(p[pivot][row] * self.blocks + self.block[block])
        live = np.zeros(base[-1], bool)
        live[open_ // self.blocks] = True
        use = live[passage]
        passage, term = passage[use], term[use]
        row, block = _expand(term, self.block_of)
        k = passage[row] * self.blocks + self.block[block]
        place = np.minimum(np.searchsorted(open_, k), len(open_) - 1)
        ok = open_[place] == k
        bound = np.bincount(place[ok], self.block_most[block[ok]], minlength=len(open_))
        open_ = open_[bound >= threshold - _EPS]
        if not len(open_):
            return
        live[:] = False
        live[open_ // self.blocks] = True
        use = live[passage]
        passage, term = passage[use], term[use]
        row, post = _expand(term, self.of)
        k = passage[row] * self.blocks + self.item[post] // BLOCK
        ok = open_[np.minimum(np.searchsorted(open_, k), len(open_) - 1)] == k
        k, where = np.unique(passage[row[ok]] * len(self.ids) + self.item[post[ok]], return_inverse=True)
        score = np.bincount(where, self.impact[post[ok]])
        for n in np.flatnonzero(score >= threshold - _EPS).tolist():
            g, i = divmod(int(k[n]), len(self.ids))
            d = int(np.searchsorted(base, g, "right") - 1)
            start = int(of[d]) + (g - int(base[d])) * s
            yield d, i, float(score[n]), start, min(start + 2 * s, int(of[d + 1]))

    def verify(self, item: int, words: np.ndarray) -> tuple[float, float]:
        """Shares of the item's question and answer that a passage holds. A part without words is held."""
        out = []
        for part in self.parts[item]:
            n = min(NGRAM, len(part))
            mine = _grams(part, n) if n else part
            out.append(float(np.isin(mine, _grams(words, n)).mean()) if len(mine) else 1.0)
        return out[0], out[1]


def _expand(term: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of the terms' lists: the place of its term, and its own place."""
    n = of[term + 1] - of[term]
    row = np.repeat(np.arange(len(term)), n)
    return row, np.arange(len(row)) + np.repeat(of[term] - (np.cumsum(n) - n), n)


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the distinct words of each item, and (null, words of the item)."""
    for batch in batches:
        for text in batch.column(0).to_pylist():
            w = _words(text)
            if len(w):
                distinct = np.unique(w).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([None, *distinct.tolist()], pa.int64()), pa.array([len(w)] + [1] * len(distinct), pa.int64())], names=["word", "n"])


def indexes(benchmark: DataFrame, part_bytes: int = INDEX_BYTES) -> Iterator[Index]:
    """The index in parts of bounded size; frequencies and lengths are those of the whole benchmark.

    Executors count words and build the parts; the driver holds the counts of distinct words and one part at a time.
    """
    items = benchmark.select("item_id", "text").where("text is not null")
    parts = int(1 + (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // part_bytes)
    counted = items.select("text").mapInArrow(_item_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("items"), F.max("n").alias("most"))
    got = counted.toArrow()  # a row for each distinct word of the benchmark
    word, df, most = (got.column(c).to_pylist() for c in ("word", "n", "most"))
    if None not in word:
        return
    whole = word.index(None)
    n_items, total, stride = got.column("items")[whole].as_py(), df[whole], max(LEAST_STRIDE, most[whole])
    order = np.argsort([-(1 << 63) - 1 if w is None else w for w in word])[1:]
    shared = benchmark.sparkSession.sparkContext.broadcast((np.array([word[k] for k in order], np.int64), np.array([df[k] for k in order])))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        rows = sorted(((i, t) for i, t in rows if len(_words(t))), key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
        if rows:
            known, count = shared.value
            own = np.unique(np.concatenate([_words(t) for _, t in rows]))
            mine = dict(zip(own.tolist(), count[np.searchsorted(known, own.view(np.int64))].tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Index([r[0] for r in rows], [r[1] for r in rows], mine, n_items, total / n_items, stride))], pa.large_binary())], names=["index"])

    placed = items.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int")).repartitionById(parts, "part").select("item_id", "text")
    for row in checkpoint(placed.mapInArrow(build, "index binary")).toLocalIterator():
        yield pickle.loads(row["index"])


def _found(index: Index, texts: list[str | None], threshold: float, question: float, answer: float) -> Iterator[tuple[int, int, float, float, float]]:
    """(text, item, score, question, answer) of verified matches, the best passage of each text and item."""
    for first, _, words, of in X.hashes(texts):
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for d, i, score, a, b in index.search(words, of, threshold):
            q, r = index.verify(i, words[a:b])
            if q >= question and r >= answer:
                best[d, i] = max(best.get((d, i), (0.0, 0.0, 0.0)), (score, q, r))
        for (d, i), (score, q, r) in sorted(best.items()):
            yield first + d, i, score, q, r


def _broadcast(docs: DataFrame, benchmark: DataFrame, part_bytes: int) -> list:
    """The parts of the index as broadcasts of part_bytes of texts at most each."""
    return [docs.sparkSession.sparkContext.broadcast(index) for index in indexes(benchmark, part_bytes)]


def _each(parts: list) -> Iterator[Index]:
    """The parts in turn; of several, a worker keeps one in memory."""
    for part in parts:
        yield part.value
        if len(parts) > 1:
            part.__dict__.pop("_value", None)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER, part_bytes: int = INDEX_BYTES) -> DataFrame:
    """(doc_id, item_id, bm25, question, answer) for every document and item that it holds."""
    doc, item = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType
    schema, kind = f"doc_id {doc}, item_id {item.simpleString()}, bm25 double, question double, answer double", to_arrow_type(item)
    parts = _broadcast(docs, benchmark, part_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for index in _each(parts):
                if rows := list(_found(index, texts, threshold, question, answer)):
                    at, items, *scores = zip(*rows)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([index.ids[i] for i in items], kind), *(pa.array(np.round(x, 6)) for x in scores)], names=["doc_id", "item_id", "bm25", "question", "answer"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def keep_unleaked(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER, part_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of docs that hold no item, with all their columns; no shuffle."""
    place = docs.columns.index("text")
    parts = _broadcast(docs, benchmark, part_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, texts = np.ones(batch.num_rows, bool), batch.column(place).to_pylist()
            for index in _each(parts):
                keep[[r[0] for r in _found(index, texts, threshold, question, answer)]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
