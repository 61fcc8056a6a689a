import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import media as M


def rolled(data):
    h, out = 0, []
    for b in data:
        h = ((h << 1) + int(M._GEAR[b])) & 0xFFFFFFFF
        out.append(h)
    return out


def test_gear_hash_rolls():
    data = np.random.default_rng(0).integers(0, 256, 3000, dtype=np.int64).astype(np.uint8)
    assert M.gear(data).tolist() == rolled(data.tolist())
    for n in (0, 1, 5, 31, 32, 33):
        assert M.gear(data[:n]).tolist() == rolled(data[:n].tolist())


def test_cuts():
    data = np.random.default_rng(2).integers(0, 256, 200_000, dtype=np.int64).astype(np.uint8).tobytes()
    h, want, last = rolled(data), [], 0
    for k in range(len(data)):
        size = k + 1 - last
        if size >= M.LEAST and h[k] >> (32 - M.MASK_BITS) == 0 or size == M.MOST or k + 1 == len(data):
            want.append(k + 1)
            last = k + 1
    assert M.cuts(data) == want
    old, M._BUFFER = M._BUFFER, 5000
    try:
        assert M.cuts(data) == want
    finally:
        M._BUFFER = old
    shifted = {data[a:b] for a, b in zip([0, *want], want)}
    moved = b"some bytes before" + data
    ends = M.cuts(moved)
    assert sum(moved[a:b] in shifted for a, b in zip([0, *ends], ends)) > 0.9 * len(want)


def table(spark):
    rng = np.random.default_rng(5)
    text = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    a, b, c = text(20_000), text(9_000), text(50)
    rows = [(1, a), (2, a), (3, b + a), (4, c), (5, ""), (6, None), (None, a), (7, a + a), (4, c), (8, a[:10_000]), (8, b), (9, "é" * 300_000), (10, c)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"media": F.lit("x"), "id": F.lit(1), "payload": F.lit(2), "digest": F.lit(3)})


def test_dedup(spark):
    df = table(spark)
    want = {(r["doc_id"], r["text"].encode()) for r in df.collect() if r["doc_id"] is not None and r["text"] is not None}
    got = M.deduplicate(df, "doc_id", "text").collect()
    assert {(r["doc_id"], r["media"]) for r in got} == {(i, M.digest(p).hex()) for i, p in want} and len(got) == len(want)
    assert all(r["verified"] for r in got)
    by = {}
    for i, p in sorted(want, key=lambda x: (x[0], M.digest(x[1]))):
        start = 0
        for end in M.cuts(p):
            by.setdefault(M.digest(p[start:end]), end - start)
            start = end
    assert sum(r["own_bytes"] for r in got) == sum(by.values()) and sum(r["n_own"] for r in got) == len(by)
    assert M.deduplicate(df.limit(0), "doc_id", "text").count() == 0


def wanted(df):
    return sorted({(r["doc_id"], r["text"].encode()) for r in df.collect() if r["doc_id"] is not None and r["text"] is not None})


def test_the_store_gives_payloads_back(spark, sf):
    for df in (table(spark), spark.read.parquet(f"{sf}/documents.parquet")):
        store, lent = M.stored(df, "doc_id", "text")
        assert sorted((r["id"], bytes(r["payload"])) for r in M.restore(store, lent).collect()) == wanted(df)
        owned = [d for r in store.collect() for d in M._split(bytes(r["owned"]))]
        assert len(owned) == len(set(owned)) and sum(len(r["data"]) for r in store.collect()) < sum(len(p) for _, p in wanted(df))


def test_damage_is_noticed():
    p = [b"ab", b"cd"]
    d = [M.digest(x) for x in p]
    assert M.assemble(p, d, M.digest(b"abcd")) == b"abcd"
    assert M.assemble([b"ab", None], d, M.digest(b"abcd")) is None
    assert M.assemble([b"ab", b"ce"], d, M.digest(b"abcd")) is None
    assert M.assemble(p, d, M.digest(b"cdab")) is None


def test_every_list_gives_its_payload_back(spark):
    df = table(spark)
    store, _ = M.stored(df, "doc_id", "text")
    have = {}
    for r in store.collect():
        have |= M._parts(r["owned"], r["lengths"], r["data"])
    got = {(r["doc_id"], b"".join(have[bytes.fromhex(c)] for c in r["chunks"])) for r in M.deduplicate(df, "doc_id", "text").collect()}
    assert sorted(got) == wanted(df)


def test_a_damaged_store(spark):
    store, lent = M.stored(table(spark), "doc_id", "text")
    assert all(r["verified"] for r in M.verify(store, lent).collect())
    one, lone = F.col("id") == 1, F.col("id") == 9
    flip = lambda c, at: F.concat(F.substring(c, 1, at - 1), F.unhex(F.lit("00")), F.expr(f"substring({c}, {at + 1})"))
    bad = lambda s: {r["id"] for r in M.verify(s, lent).collect() if not r["verified"]}
    # a chunk of 9, from which nobody borrows; the first one of 1, from which 2, 7 and 8 do; order and lack of chunks; the whole digest
    assert bad(store.withColumn("data", F.when(lone, flip("data", 700)).otherwise(F.col("data")))) == {9}
    assert {1, 2, 7} <= bad(store.withColumn("data", F.when(one, flip("data", 10)).otherwise(F.col("data")))) <= {1, 2, 3, 7, 8}
    assert bad(store.withColumn("list", F.when(one, F.concat(F.substring("list", 17, 16), F.substring("list", 1, 16), F.expr("substring(list, 33)"))).otherwise(F.col("list")))) == {1}
    assert bad(store.withColumn("list", F.when(one, F.expr("substring(list, 17)")).otherwise(F.col("list")))) == {1}
    assert 1 in bad(store.withColumn("owned", F.when(one, F.expr("substring(owned, 17)")).otherwise(F.col("owned"))))
    assert 2 in bad(store.where("id <> 1"))  # the owner's row is lost
