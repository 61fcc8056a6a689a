import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import toxicity as T


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    weights = T.train(docs, labels.where(half))
    got = T.score(docs, weights).join(labels.where(~half).select("doc_id", F.col("toxic").alias("y")), "doc_id")
    n = {(r["y"], r["toxic"]): r["count"] for r in got.groupBy("y", "toxic").count().collect()}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.9
    assert n.get((0, True), 0) / n[0, False] < 0.005


def made(n=400):
    """Texts in which labels follow both an insult and, by chance, a group."""
    rng = np.random.default_rng(1)
    rows = []
    for k in range(n):
        toxic = k % 3 == 0
        words = list(rng.choice([f"word{j}" for j in range(200)], 20))
        if toxic:
            words[3] = "dreadfulinsult"
        if rng.random() < (0.8 if toxic else 0.1):
            words[9] = "muslim"
        elif rng.random() < 0.5:
            words[9] = "christian"
        rows.append((k, " ".join(words), int(toxic)))
    return rows


def test_counterfactuals_spare_neutral_mentions(spark):
    rows = made()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    plain, fair = T.train(docs, labels, penalty=0.0), T.train(docs, labels)
    neutral = [f"word{k} word{k + 1} muslim word{k + 2} word{k + 3}" for k in range(50)]
    swapped = [t.replace("muslim", "christian") for t in neutral]
    gap = lambda w: np.abs(T.weigh(neutral, w) - T.weigh(swapped, w)).mean()
    assert gap(fair) < 0.3 * gap(plain)
    assert (T.weigh(neutral, fair) > 0).mean() <= (T.weigh(neutral, plain) > 0).mean()
    assert (T.weigh(["dreadfulinsult word1 word2 word3"], fair) > 0).all()


def test_swaps():
    assert T.swaps("the Women said") == ["the men said"]
    assert T.swaps("nothing here") == []
    assert len(T.swaps("a muslim here")) == 5


def test_odd_rows(spark):
    rows = made()
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, ""), (None, "dreadfulinsult " * 5), (0, rows[0][1]), (902, "dreadfulinsult word1 " * 300_000), (903, "!?")], "doc_id long, text string").withColumns({"toxic": F.lit(True), "y": F.lit(1), "r": F.lit(2)})
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (901, None), (0, 0)], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    weights = T.train(docs, labels)
    got = T.score(docs, weights).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[900]["toxicity"] == by[901]["toxicity"] == by[903]["toxicity"] == 0.0 and not by[900]["toxic"]
    assert by[902]["toxic"] and by[None]["toxic"]
    kept = T.keep_clean(docs, weights)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if not r["toxic"]}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    for d, n in ((docs, labels.limit(0)), (docs.limit(0), labels), (docs, labels)):
        weights = T.train(d, n)
        assert [r["toxicity"] for r in T.score(docs, weights).collect()] == [0.0]
        assert T.keep_clean(docs, weights).count() == 1
    assert T.score(docs.limit(0), T.train(docs, labels)).count() == 0


def dense_fit(rows, pairs, penalty, rounds):
    """The same loss over a dense matrix of all features that pass the selection, by its written-out gradient."""
    y = np.array([r[0] for r in rows], float)
    size = int(max(max(r[1].max() for r in rows), max(i.max() for i, _ in pairs)) + 1)
    x = np.zeros((len(rows), size))
    for k, (_, i, v) in enumerate(rows):
        x[k, i] = v
    change = np.zeros((len(pairs), size))
    for k, (i, v) in enumerate(pairs):
        change[k, i] = v
    one, zero = x[y == 1], x[y == 0]
    error = np.sqrt(np.maximum((x**2).mean(0) - x.mean(0) ** 2, 1e-12) * (1 / len(one) + 1 / len(zero)))
    use = ((x != 0).sum(0) >= T.LEAST_TEXTS) & (np.abs(one.mean(0) - zero.mean(0)) / error >= T.LEAST_Z)
    x, change = x[:, use], change[:, use]
    scale = np.sqrt((x**2).mean(0) + 1e-4)
    x, change = x / scale, change / scale
    balance = np.where(y == 1, 0.5 / len(one), 0.5 / len(zero))
    w = np.zeros(x.shape[1] + 1)
    m = v = np.zeros_like(w)
    for t in range(1, rounds + 1):
        e = balance * (1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) - y)
        g = np.append(x.T @ e + T.RIDGE * w[:-1] + 2 * penalty * change.T @ (change @ w[:-1]) / len(pairs), e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return np.flatnonzero(use), w[:-1] / scale, w[-1]


def test_fit_against_a_dense_one():
    rows, pairs = [], []
    place = {}
    for _, text, label in made(200):
        i, v = T.vector(text)
        rows.append((label, np.array([place.setdefault(int(f), len(place)) for f in i]), v))
        for other in T.swaps(text)[:2]:
            j, u = T.vector(other)
            change = {place.setdefault(int(f), len(place)): float(x) for f, x in zip(i, v)}
            for f, x in zip(j, u):
                k = place.setdefault(int(f), len(place))
                change[k] = change.get(k, 0.0) - float(x)
            pairs.append((np.array(list(change)), np.array(list(change.values()))))
    # few rounds: Adam's division makes rounding grow later on
    got = T.fit(rows, pairs, rounds=40)
    use, w, b = dense_fit(rows, pairs, T.PENALTY, 40)
    assert len(use) > 3 and (np.flatnonzero(got[:-1]) == use).all()
    assert np.abs(got[use] - w).max() < 1e-4 * np.abs(w).max() and abs(got[-1] - b) < 1e-4


def test_scores_by_definition(spark):
    rows = made()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    weights = T.train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    for r, (_, text, _) in zip(sorted(T.score(docs, weights).collect(), key=lambda r: r["doc_id"]), rows):
        ids, values = T.vector(text)
        assert abs(r["toxicity"] - 1 / (1 + np.exp(-(weights[ids] @ values + weights[-1])))) < 2e-6
