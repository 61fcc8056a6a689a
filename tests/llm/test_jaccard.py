import re
import tracemalloc
from itertools import combinations
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import jaccard as J
from lodestone.llm import queries
from lodestone.llm import text as X
from lodestone.llm.components import components


def grams(text):
    ws = re.findall(r"\w+", (text or "").lower())
    return frozenset(tuple(ws[k : k + J.N]) for k in range(max(1, len(ws) - J.N + 1))) if ws else frozenset()


def every(rows):
    """All pairs of places in rows by definition."""
    sets = [grams(t) for _, t in rows]
    out = []
    for (x, s), (y, t) in combinations(enumerate(sets), 2):
        if s and t and min(len(s), len(t)) >= J.THRESHOLD * max(len(s), len(t)) and not s.isdisjoint(t):
            both = len(s & t)
            if both >= J.THRESHOLD * (len(s) + len(t) - both) - 1e-9:
                out.append((x, y))
    return out


def brute(rows):
    """Rows (doc_id, class_id, copies, links) by definition."""
    units = list({(i, grams(t)): (i, t) for i, t in rows if i is not None}.values())
    sets = [grams(t) for _, t in units]
    root = list(range(len(units)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(units)
    for x, y in every(units):
        links[x] += 1
        links[y] += 1
        a, b = sorted((find(x), find(y)))
        root[b] = a
    for (x, (i, _)), (y, (j, _)) in combinations(enumerate(units), 2):
        if i == j and sets[x] and sets[y]:
            a, b = sorted((find(x), find(y)))
            root[b] = a
    least = {}
    for x, (i, _) in enumerate(units):
        least[find(x)] = min(i, least.get(find(x), i))
    return sorted((i, least[find(x)], sum(s == sets[x] for s in sets) if sets[x] else 1, links[x]) for x, (i, _) in enumerate(units))


def got(docs):
    df = J.linked(docs)
    assert df.columns == ["doc_id", "class_id", "copies", "links"]
    return sorted(tuple(r) for r in df.collect())


def near_copies(groups=60, words=200):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(groups):
        ws = [f"w{x}" for x in rng.integers(0, 5000, words)]
        rows.append((2 * k, " ".join(ws)))
        for at in rng.choice(words, k % 31, replace=False):
            ws[at] = f"x{at}"
        rows.append((2 * k + 1, " ".join(ws)))
    shared = " ".join(f"s{x}" for x in range(80))  # a passage that many otherwise different documents share
    rows += [(1000 + k, shared + " " + " ".join(f"y{x}" for x in rng.integers(0, 9000, 20 + 3 * k))) for k in range(60)]
    base = [f"b{x}" for x in range(60)]  # a chain: many different texts of one origin
    for k in range(80):
        base = list(base)
        base[int(rng.integers(60))] = f"c{k}"
        rows.append((2000 + k, " ".join(base)))
    return rows + [(3000, rows[7][1]), (3001, rows[7][1]), (3002, rows[7][1])]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_brute_force(spark, size):
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    assert got(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_near_copies_of_every_degree(spark):
    rows = near_copies()
    want = brute(rows)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == want
    assert sum(r[3] for r in want) > 500


def test_hot_values_and_blocks_change_nothing(spark, monkeypatch):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for name, value in (("HEAVY", 20), ("GROUP", 8), ("BLOCK", 16), ("PART", 3000)):
        monkeypatch.setattr(J, name, value)
    assert got(docs) == want
    monkeypatch.setattr(J, "HEAVY", 0)
    assert got(docs) == want


def test_blocks_are_bounded_by_their_ngrams(spark, monkeypatch):
    """Few sets of many n-grams are as much for a task as many small ones."""
    solve, most = J._solve, 2500

    def bounded(batches):
        def seen():
            held = {}
            for batch in batches:
                for row in batch.to_pylist():
                    key = row["component"], row["low"], row["high"]
                    held[key] = held.get(key, 0) + len(row["grams"]) // 8
                yield batch
            assert max(held.values(), default=0) <= most, max(held.values())

        yield from solve(seen())

    rows = near_copies()  # the chain alone has about 4,600 n-grams
    monkeypatch.setattr(J, "GRAMS", 500, raising=False)
    monkeypatch.setattr(J, "_solve", bounded)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_tables_have_no_file_for_each_part_of_the_input(spark, monkeypatch, tmp_path):
    """Each file that is written costs processes on the executor, so tables of small rows have few."""
    made = []

    def checkpoint(df):
        made.append(f"{tmp_path}/{len(made)}")
        df.write.parquet(made[-1])
        return spark.read.parquet(made[-1])

    rows = near_copies()
    monkeypatch.setattr(J, "checkpoint", checkpoint)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(24)
    assert got(docs) == brute(rows)
    assert max(len(list(Path(m).glob("*.parquet"))) for m in made) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_powers_of_a_buffer_are_made_once_and_no_longer_than_needed():
    tracemalloc.start()
    try:
        up, down = X._pow(X.BUFFER + 500)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 3 * 8 * X.BUFFER
    assert X._pow(X.BUFFER - 500)[0] is up and X._pow(X.BUFFER + 500)[0] is up
    assert (up[1:] == up[:-1] * X.U(X._P)).all() and (up * down == 1).all()
    long, _ = X._pow(3 * X.BUFFER)
    assert (long[: len(up)] == up).all() and X._pow(5)[0] is up  # those of a very long text aren't kept


def test_trie_join_holds_no_numbers_of_python():
    sets = [np.sort(np.random.default_rng(k).choice(40_000, 20_000, replace=False)).astype(np.uint64) for k in range(40)]
    tracemalloc.start()
    try:
        found = sum(len(js) for _, js, _ in J.trie_join(sets, np.full(40, 20_000)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == 0 and peak < 70 * 40 * 20_000


def test_many_leaders_in_one_place(spark):
    """Similar sets each of which is also like another: more of them than any small group, so none may be left out."""
    rng = np.random.default_rng(1)
    rows = []
    for k in range(80):  # w is similar to x, and both share less with a third
        a, b, c = (" ".join(f"{p}{x}" for x in rng.integers(0, 400, 30)) for p in "abc")
        rows += [(10 * k, f"z {a} {b}"), (10 * k + 1, f"z {b} {c}"), (10 * k + 2, f"z {a} {b} {c}"), (10 * k + 3, f"z {c} {a}")]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_trie_join():
    rng = np.random.default_rng(9)
    for _ in range(40):
        sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30)).astype(np.uint64)) for _ in range(20)]
        size = np.array([len(s) + int(rng.integers(0, 3)) for s in sets])
        want = {(i, j, n) for i in range(20) for j in range(20) if i != j and (n := len(np.intersect1d(sets[i], sets[j]))) >= 0.5 * (size[i] + size[j] - n)}
        assert {(i, int(j), int(n)) for i, js, ns in J.trie_join(sets, size) for j, n in zip(js, ns)} == want
        across = {(i, j - 8, n) for i, j, n in want if i < 8 <= j}
        assert {(i, int(j), int(n)) for i, js, ns in J.trie_join(sets[:8], size[:8], sets[8:], size[8:]) for j, n in zip(js, ns)} == across


def test_bounds_never_exclude_a_similar_pair():
    rng = np.random.default_rng(3)
    for _ in range(30):
        base = rng.integers(0, 1 << 62, 400, dtype=np.int64).astype(np.uint64)
        sets = [np.unique(np.concatenate((base[: (a := int(rng.integers(5, 400)))], rng.integers(0, 1 << 62, int(rng.integers(1, 100)), dtype=np.int64).astype(np.uint64)))) for _ in range(20)]
        n = np.array([len(s) for s in sets])
        maps = [J.bitmap(s) for s in sets]
        met = J.Met(n, n, np.array([len(m) for m in maps]), np.concatenate(maps))
        x, y = np.triu_indices(20, 1)
        both = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(x, y)])
        similar = both >= 0.5 * (n[x] + n[y] - both)
        assert similar.any() and met.may(x, y)[similar].all()


def test_odd_rows(spark):
    t = " ".join(f"w{k}" for k in range(50))
    long = " ".join(f"v{k % 977}x{k % 1013}" for k in range(300_000))
    rows = [(1, t), (1, t), (2, t), (None, t), (3, None), (4, ""), (5, "?!"), (6, ""), (7, long), (8, long + " end"), (9, "Hi."), (10, "hi"), (11, "a b c"), (12, "a b c d"), (6, t + " more"), (6, "other words of it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "component", "part", "whole", "gone_id", "class_id", "copy_id", "a", "b", "n", "rep", "links")})
    assert got(docs) == brute(rows)
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 1, 3, 4, 5, 7, 9, 11]
    assert J.linked(docs.limit(0)).count() == 0 and J.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("one_task", [0, 1 << 20])
def test_components(spark, one_task):
    edges = [(k, k + 1) for k in range(40)] + [(100, 102), (102, 101), (101, 100), (5, 5), (100, 102)]
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), one_task=one_task).collect()}
    assert found == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}


def test_sql(spark, tmp_path):
    c = duckdb.connect()
    rows = [(i, t) for i, t in near_copies(20)] + [(5, "a b"), (6, "a b"), (7, ""), (8, None), (9, "a b"), (9, "Other words, here: x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(c.execute(J.SQL).fetchall())
    assert sorted(tuple(r) for r in queries.op10_ngram_jaccard_join(spark, str(tmp_path)).collect()) == want == brute(rows)
