import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import decontaminate as D
from lodestone.llm import text as X

DOCS = "doc_id long, text string, item_id long, bm25 double"


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def brute(docs, items, stride=D.LEAST_STRIDE, threshold=D.THRESHOLD):
    """{(text, item): best score} of all passages against all items."""
    bags = [Counter(words(t)) for t in items]
    df = Counter(w for b in bags for w in b)
    mean = sum(sum(b.values()) for b in bags) / len(bags)
    impact = [{w: math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * c * (D.K1 + 1) / (c + D.K1 * (1 - D.B + D.B * sum(b.values()) / mean)) for w, c in b.items()} for b in bags]
    out = {}
    for d, t in enumerate(docs):
        ws = words(t)
        for k in range(0, max(1, -(-len(ws) // stride) - 1)) if ws else []:
            have = set(ws[k * stride : (k + 2) * stride])
            for i, m in enumerate(impact):
                s = sum(v for w, v in m.items() if w in have) / sum(m.values())
                if s >= threshold - 1e-9:
                    out[d, i] = max(out.get((d, i), 0), s)
    return out


def test_search_finds_all_that_brute_force_finds(spark, sf):
    docs = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = sorted((r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect())
    index = next(D.indexes(spark.read.parquet(f"{sf}/benchmark.parquet")))
    assert index.stride == D.LEAST_STRIDE and len(items) > D.BLOCK
    for threshold in (0.25, 0.5):
        got = {}
        for first, _, w, of in X.hashes(docs):
            for d, i, s, _, _ in index.search(w, of, threshold):
                got[first + d, i] = max(got.get((first + d, i), 0), s)
        want = brute(docs, [t for _, t in items], threshold=threshold)
        assert got.keys() == want.keys() and want
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_query_is_brute_force_with_verification(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    rows, items = docs.select("doc_id", "text").collect(), sorted((r["item_id"], r["text"]) for r in bench.collect())
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(docs, bench).collect()}
    want = set()
    for d, i in brute([r["text"] for r in rows], [t for _, t in items]):
        have = words(rows[d]["text"])
        ok = True
        for part in D.split_item(items[i][1]):
            p = words(part)
            n = min(3, len(p))
            mine, its = ({tuple(x[k : k + n]) for k in range(len(x) - n + 1)} for x in (p, have))
            ok &= not mine or len(mine & its) / len(mine) >= 0.5
        if ok:
            want.add((rows[d]["doc_id"], items[i][0]))
    assert got == want and got
    parts = {(r["doc_id"], r["item_id"]) for r in D.leaks(docs, bench, part_bytes=1000).collect()}
    assert parts == got


def test_items_split_in_question_and_answer():
    assert D.split_item("What is it? A cat.") == ("What is it?", " A cat.")
    assert D.split_item("Name it. Answer: a cat") == ("Name it. ", " a cat")
    assert D.split_item("One is. Two is.") == ("One is. ", "Two is.")
    assert D.split_item("a b c d") == ("a b c", "d")
    assert D.split_item("")[1] == ""


ITEM = "Which of the seven rivers flows north past the old granite mill? The river called Aldra does so."


def test_odd_rows(spark):
    other = "Some wholly different words about gardens, ships and weather in the north."
    long = ("filler words without any meaning here " * 20_000) + ITEM + (" and more filler follows it" * 20_000)
    docs = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (3, ""), (None, "x " + ITEM.upper()), (4, other), (5, long), (6, "!!! ???"), (7, ITEM.split("?")[0])], "doc_id long, text string").withColumns({"item_id": F.lit(9), "bm25": F.lit("x")})
    bench = spark.createDataFrame([(10, ITEM), (10, ITEM), (11, None), (12, ""), (None, other), (13, "...")], "item_id long, text string").withColumns({"doc_id": F.lit(3), "tokens": F.lit(1)})
    got = sorted((r["doc_id"] or 0, r["item_id"] or 0) for r in D.leaks(docs, bench).collect())
    assert got == [(0, 10), (0, 10), (1, 10), (1, 10), (1, 10), (1, 10), (4, 0), (5, 10), (5, 10)]  # 7 lacks the answer
    kept = D.keep_unleaked(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 6, 7]


def test_empty_tables(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    assert D.leaks(docs.limit(0), bench).count() == 0
    assert D.leaks(docs, bench.limit(0)).count() == 0
    assert D.keep_unleaked(docs, bench.limit(0)).count() == docs.count()
    assert D.leaks(docs, bench.limit(0)).columns == ["doc_id", "item_id", "bm25", "question", "answer"]


def test_an_item_lies_whole_in_a_passage_wherever_it_is():
    index = D.Index([1], [ITEM], {int(w): 1 for w in np.unique(D._words(ITEM)).tolist()}, 1, 18.0, 64)
    n = len(words(ITEM))
    for before in range(0, 200, 7):
        w = X.Words([" ".join(f"w{k}" for k in range(before)) + " " + ITEM + " " + " ".join(f"v{k}" for k in range(150))]).hashes
        found = list(index.search(w, np.array([0, len(w)]), 0.99))
        assert any(a <= before and before + n <= b for _, _, _, a, b in found)


def test_item_ids_of_other_types(spark):
    docs = spark.createDataFrame([("a", "x " + ITEM)], "doc_id string, text string")
    for kind, value in (("int", 7), ("string", "seven"), ("double", 7.5), ("date", __import__("datetime").date(2020, 1, 2))):
        bench = spark.createDataFrame([(value, ITEM)], f"item_id {kind}, text string")
        assert [(r["doc_id"], r["item_id"]) for r in D.leaks(docs, bench).collect()] == [("a", value)]
