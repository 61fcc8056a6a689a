import base64

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from lodestone.llm import bpe as B

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ODD = ["it's we'll they'd' 's x''s 'ré a'r 'l  'll  \n\n  x \t'm", "   ", "a b 　c\n", "", "!!! ??? \U0001f600\U0001f600 \U0001d400x", "１２ ½ x²", "a" * 3000, " " * 500 + "x", "\r\n\r\n a", "\x1c\x1d x", "\x85y", "'", "''", "'s", "'rex", " 's", "I'veve'S", "<|endoftext|>", "é ﻿x", "don't", "\n'd", "'\n's"]


@pytest.fixture(scope="module", params=["byte_bpe_50k", "byte_bpe_multi_50k"])
def both(request):
    data = B.load(f"/opt/tokenizers/{request.param}.tiktoken")
    ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, data.splitlines())}
    return B.Bpe(data), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_are_those_of_one_merge_at_a_time(both, spark, sf):
    bpe, other = both
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ODD
    for step in (7, len(texts)):
        for k in range(0, len(texts), step):
            some = texts[k : k + step]
            tokens, bounds = bpe.encode(some)
            assert [tokens[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [other.encode_ordinary(t) for t in some]
            assert bpe.decode(tokens).decode() == "".join(some)


def test_table_of_words_may_be_forgotten(both, monkeypatch):
    bpe, other = both
    monkeypatch.setattr(B, "KEPT", 3)
    for _ in range(3):
        for t in ODD:
            assert bpe.encode([t])[0].tolist() == other.encode_ordinary(t)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "same text"), (3, "same text"), (4, "long words " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"tokens": F.lit(1), "exact": F.lit("x")})
    out = B.encode(docs)
    got = out.collect()
    assert len(got) == 6 and all(r["exact"] for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["tokens"] is None and by[1]["n_tokens"] == 0 and by[2]["tokens"] == [] and by[None]["n_tokens"] == 2
    back = sorted(((r["doc_id"] or 0), r["text"]) for r in B.decode(out).where("doc_id is null or doc_id <> 1").collect())
    assert back == sorted((i or 0, t) for i, t in rows if t is not None)
    assert B.decode(out).where("doc_id = 1").first()["text"] is None
    assert B.encode(docs.limit(0)).count() == 0
    wrong = spark.createDataFrame([(1, [60000]), (2, [-1]), (3, [1, None]), (4, [50256])], "doc_id long, tokens array<int>")
    assert [r["text"] for r in B.decode(wrong).collect()] == [None] * 4


def one_at_a_time(bpe, word):
    """The definition: of all adjacent pairs the one of lowest rank, the leftmost, merges, until none is left."""
    pairs = dict(zip(bpe.keys.tolist(), bpe.merged.tolist()))
    sym = [int(bpe.bytes[b]) for b in word]
    while True:
        ranks = [(pairs[k], i) for i in range(len(sym) - 1) if (k := sym[i] << 20 | sym[i + 1]) in pairs]
        if not ranks:
            return sym
        r, i = min(ranks)
        sym[i : i + 2] = [r]


def test_rounds_and_queue_merge_as_the_definition_does(both, monkeypatch):
    bpe, _ = both
    rng = np.random.default_rng(2)
    letters = [bytes(rng.choice(list(b"etaoinshrdlu'  .0123\xc3\xa9"), int(rng.integers(1, 60)))) for _ in range(300)]
    words = letters + [b"aaaa" * k for k in range(1, 9)] + [b"abab" * 7, b"\xff\xfe\x00", b"internationalization" * 3]
    want = [one_at_a_time(bpe, w) for w in words]
    for long in (4096, 0):
        monkeypatch.setattr(B, "LONG", long)
        tokens, ends = bpe.merge(words)
        assert [tokens[a:b].tolist() for a, b in zip([0, *ends], ends)] == want


def test_a_very_long_word(both):
    import time

    bpe, _ = both
    text = "".join(np.random.default_rng(5).choice(list("etaoinshrdlu"), 400_000))
    start = time.time()
    tokens, _ = bpe.encode([text])
    assert bpe.decode(tokens).decode() == text and time.time() - start < 20
