import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import shards as S


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 1000, 1024, 1025, 99_999])
def test_a_permutation_with_its_inverse(n):
    rows = np.arange(n)
    place = S.permute(rows, n)
    assert sorted(place.tolist()) == rows.tolist()
    assert (S.permute(place, n, back=True) == rows).all()
    if n > 500:
        assert abs(np.corrcoef(rows, place)[0, 1]) < 0.1 and (S.permute(rows, n, seed=5) != place).any()


def test_very_many_rows():
    n = 3 * 10**13 + 7
    some = np.random.default_rng(0).integers(0, n, 2000)
    place = S.permute(some, n)
    assert place.min() >= 0 and place.max() < n and (S.permute(place, n, back=True) == some).all()


def test_rows_are_numbered_by_key(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted(S.assign(docs.repartition(7)).collect(), key=lambda r: r["row"])
    ids = sorted(r["doc_id"] for r in docs.collect())
    assert [r["doc_id"] for r in got] == ids and [r["row"] for r in got] == list(range(len(ids)))
    assert [r["place"] for r in got] == S.permute(np.arange(len(ids)), len(ids)).tolist()
    assert all(r["place"] == r["slot"] * S.SHARDS + r["shard"] and 0 <= r["shard"] < S.SHARDS for r in got)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(3,), (None,), (3,), (1,), (None,)], "doc_id long").withColumns({"row": F.lit(1), "place": F.lit("x"), "part": F.lit(2), "at": F.lit(0), "text": F.lit(None)})
    got = sorted(S.assign(docs).collect(), key=lambda r: r["row"])
    assert [r["doc_id"] for r in got] == [None, None, 1, 3, 3] and sorted(r["place"] for r in got) == [0, 1, 2, 3, 4]
    assert S.assign(docs.limit(0)).count() == 0


def test_keys_of_other_types(spark):
    docs = spark.createDataFrame([("b",), (None,), ("a",), ("",), ("ä",), ("b",)], "k string")
    got = sorted(S.assign(docs, "k", shards=2).collect(), key=lambda r: r["row"])
    assert [r["k"] for r in got] == [None, "", "a", "b", "b", "ä"] and [r["place"] for r in got] == S.permute(np.arange(6), 6).tolist()
    days = spark.sql("select date_add(date'2020-01-01', cast(id * 7 % 10 as int)) as d from range(10)")
    assert [r["d"].day for r in sorted(S.assign(days, "d").collect(), key=lambda r: r["row"])] == list(range(1, 11))
