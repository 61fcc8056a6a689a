import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_against_brute_force(spark, tmp_path):
    from test_bpe import PATTERN
    from test_decontaminate import brute as leaks
    from test_decontaminate import words
    from test_jaccard import every

    import base64

    import tiktoken

    from lodestone.llm import bpe, decontaminate, toxicity

    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    toxic = {r["doc_id"] for r in toxicity.score(docs, toxicity.train(docs, labels)).where("toxic").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] not in toxic]
    group = {i: i for i, _ in rows}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in every(rows):
        x, y = sorted((root(rows[a][0]), root(rows[b][0])))
        group[y] = x
    rows = [(i, t) for i, t in rows if root(i) == i]
    items = [t for _, t in sorted((r["item_id"], r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect())]
    gone = set()
    for k, i in leaks([t for _, t in rows], items):
        have, ok = words(rows[k][1]), True
        for part in map(words, decontaminate.split_item(items[i])):
            n = min(3, len(part))
            mine, its = ({tuple(x[j : j + n]) for j in range(len(x) - n + 1)} for x in (part, have))
            ok &= not mine or len(mine & its) / len(mine) >= 0.5
        if ok:
            gone.add(rows[k][0])
    ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, bpe.load().splitlines())}
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: enc.encode_ordinary(t) for i, t in rows if i not in gone}
    got = {r["doc_id"]: r["tokens"] for r in corpus_pipeline.run(spark, d).collect()}
    assert toxic and gone and len(rows) < 1000 - len(toxic)
    assert got == want


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "decontamination", "bpe"]


def test_every_operator_has_a_query_of_its_number():
    from lodestone.llm import queries

    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_odd_rows_from_end_to_end(spark, tmp_path):
    from pyspark.sql import functions as F

    t = " ".join(f"w{k}" for k in range(50))
    item = "Which of the seven rivers flows north past the old granite mill? The river called Aldra does so."
    long = " ".join(f"v{k % 977}x{k % 1013}" for k in range(200_000))
    rows = [(1, t), (1, t), (2, t), (None, t), (3, None), (4, ""), (5, "?!"), (6, "x " + item), (7, long), (8, long + " end"), (None, None), (9, "other words")]
    clash = {c: F.lit(1) for c in ("id", "component", "part", "whole", "gone_id", "class_id", "item_id", "toxic", "tokens", "y", "n_tokens", "exact")}
    spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 1), (2, 0, None), (None, 1, 1), (9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(10, item), (None, None), (11, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"] > 0) for r in got) == [(0, False), (0, True), (1, True), (1, True), (3, False), (4, False), (5, True), (7, True), (9, True)]
    for name in ("documents", "labels", "benchmark"):
        empty = spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0)
        empty.write.parquet(f"{tmp_path}/empty/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
