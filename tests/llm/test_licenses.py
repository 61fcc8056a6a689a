import re

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import licenses as L


def words(t):
    return re.findall(r"\w+", (t or "").lower())


def brute(text, templates=L.TEMPLATES):
    """Every window of every template, aligned without any pruning."""
    ws, found = words(text), []
    for k, (_, t) in enumerate(templates):
        mine = words(t)
        for n, step in L.windows(len(mine), len(ws)):
            for s in range(0, len(ws), step):
                if step > 1 or ws[s] in mine:
                    got, a, b = L.matched(mine, ws[s : s + n], L.names(t))
                    if got >= L.THRESHOLD * len(mine) - 1e-9:
                        found.append((round(got / len(mine), 6), s + a, b - a, k))
    out = {}
    for c, s, n, k in L.apart(found, [len(words(t)) for _, t in templates]):
        name = templates[k][0]
        if name not in out or (-c, s) < (-out[name][0], out[name][1]):
            out[name] = (c, s, n)
    return {(name, *hit) for name, hit in out.items()}


def scanned(spark, rows, templates=L.TEMPLATES):
    got = {}
    for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect():
        got.setdefault(r["doc_id"], set()).add((r["license"], r["coverage"], r["first_word"], r["words"]))
    return got


def test_brute_force(spark, sf):
    notices = tuple(x for x in L.TEMPLATES if len(words(x[1])) < L.EVERY)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    full = L.TEMPLATES[2][1]
    extra = [(-1, "a b " + full + " c d"), (-2, full.replace("copies", "things").replace("deal", "trade")), (-3, "Released under the MIT License.\n" * 9), (-4, L.TEMPLATES[12][1] + " and " + L.TEMPLATES[0][1])]
    # whole long texts, too: each only once, as brute force takes its time
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect() if len(r["text"]) < 3000]
    rows += [tuple(max(docs.select("doc_id", "text").collect(), key=lambda r: (len(r["text"]) < 40_000, len(r["text"]))))] + extra
    got = scanned(spark, rows, notices)
    want = {d: b for d, t in rows if (b := brute(t, notices))}
    assert got == want
    assert {n for n, *_ in got[-1]} == {"MIT"} and {n for n, *_ in got[-4]} == {L.TEMPLATES[12][0], "MIT"} and 0.8 <= min(c for _, c, *_ in got[-2]) < 1


def test_full_texts(spark):
    filler = " ".join(f"word{k}" for k in range(3000))
    texts = {n: t for n, t in L.TEMPLATES if len(words(t)) > L.EVERY}
    assert len(texts) == 7
    rows = [(k, f"{filler} {t} {filler}") for k, t in enumerate(texts.values())]
    got = scanned(spark, rows)
    for k, name in enumerate(texts):
        hit = {n: (c, at, size) for n, c, at, size in got[k]}
        assert hit[name] == (1.0, 3000, len(words(texts[name])))
    gpl = words(texts["GPL-2.0"])[:400]
    small = (("part", " ".join(gpl)), L.TEMPLATES[0])
    damaged = list(gpl)
    damaged[50:90] = [f"x{k}" for k in range(40)]
    rows = [(1, filler[:900] + " " + " ".join(damaged) + " end"), (2, " ".join(gpl[:200]) + " " + filler[:9000] + " " + " ".join(gpl[200:]))]
    assert scanned(spark, rows, small) == {d: brute(t, small) for d, t in rows} and len(scanned(spark, rows, small)) == 2


def test_inserted_text(spark):
    mit = words(L.TEMPLATES[2][1])
    for each in (3, 6, 40):  # so many foreign words after every ten of the notice
        text = " ".join(w + (" " + " ".join(f"f{k}x{j}" for j in range(each)) if k % 10 == 9 else "") for k, w in enumerate(mit))
        got = scanned(spark, [(1, "before " + text + " after")])
        assert {n: c for n, c, *_ in got[1]} == {"MIT": 1.0}


def test_names_in_short_notices(spark):
    rows = [(1, "Licensed under the BSD License."), (2, "This work is licensed under the GNU General Public License, version 2."), (3, "This work is licensed under the GNU General Public License, version 1."), (4, "licensed under the mit license"), (5, "Licensed with the MIT License.")]
    assert {d: {n for n, *_ in x} for d, x in scanned(spark, rows).items()} == {2: {"GPL-2.0"}, 4: {"MIT"}, 5: {"MIT"}}


def test_increasing_subsequence():
    rng = np.random.default_rng(3)
    for _ in range(200):
        v = rng.permutation(12).tolist()
        best = [1] * len(v)
        for i in range(len(v)):
            best[i] = 1 + max([best[j] for j in range(i) if v[j] < v[i]], default=0)
        got = [v[i] for i in L.increasing(v)]
        assert got == sorted(got) and len(got) == max(best)
    assert L.increasing([]) == []


def test_alignment():
    assert L.matched([1, 2, 3], [1, 2, 3]) == (3, 0, 3)
    assert L.matched([1, 2, 3, 4], [9, 2, 8, 4, 1]) == (2, 1, 4)
    assert L.matched([5, 1, 5, 2, 5], [5, 1, 5, 5, 2, 5]) == (5, 0, 6)
    assert L.matched([1, 1, 2], [3, 1, 1, 4]) == (0, 0, 0)  # no word is unique to both
    assert L.matched([], [1]) == L.matched([1], []) == (0, 0, 0)


def test_odd_rows(spark):
    mit = L.TEMPLATES[0][1]
    docs = spark.createDataFrame([(1, None), (2, ""), (None, mit), (3, mit), (3, mit), (4, "filler " * 400_000 + mit), (5, "... !")], "doc_id long, text string").withColumns({"license": F.lit("x"), "words": F.lit(0)})
    got = sorted((r["doc_id"] or 0, r["license"], r["coverage"], r["first_word"]) for r in L.scan(docs).collect())
    assert got == [(0, "MIT", 1.0, 0), (3, "MIT", 1.0, 0), (3, "MIT", 1.0, 0), (4, "MIT", 1.0, 400_000)]
    assert L.scan(docs.limit(0)).count() == 0
