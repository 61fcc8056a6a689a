from itertools import groupby

from pyspark.sql import functions as F

from lodestone.llm import chat


def brute(rows):
    by = {}
    for c, t, r, x in rows:
        if c is not None and x and x.strip():
            by.setdefault(c, set()).add((t is None, t or 0, (r if r is not None else "unknown").strip().lower(), x))
    out = {}
    for c, s in by.items():
        runs = [(k, "\n".join(x[3] for x in g)) for k, g in groupby(sorted(s), key=lambda x: x[2])]
        out[c] = (len(s), len(runs), ",".join(k for k, _ in runs), "".join(f"<|{k}|>\n{x}<|end|>\n" for k, x in runs))
    return out


def got(df):
    return {r["conv_id"]: tuple(r)[1:] for r in chat.format_chats(df).collect()}


def test_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    assert got(df) == brute([tuple(r[k] for k in ("conv_id", "turn", "role", "text")) for r in df.collect()])


def test_odd_rows(spark):
    rows = [(1, 1, "user", "b"), (1, 0, " User", "a"), (1, 2, "assistant", "c"), (1, 2, "assistant", "c"), (1, 3, "user", "  "), (1, 4, "assistant", "d")]
    rows += [(None, 0, "user", "x"), (2, None, "user", "last"), (2, 5, None, "first"), (3, 0, "user", None), (3, 1, "user", ""), (4, 1, "b", "tie"), (4, 1, "a", "tie"), (5, 0, "user", "z" * 500_000)]
    rows += [(6, k, "user" if k % 7 else "assistant", f"t{k}") for k in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"t": F.lit(1), "m": F.lit(2), "b": F.lit("x")})
    assert got(df) == brute(rows)
    assert got(df)[1][:3] == (4, 2, "user,assistant") and 3 not in got(df)
    assert got(df.limit(0)) == {}


def test_a_conversation_of_very_many_turns(spark):
    import time

    df = spark.range(200_000, numPartitions=8).selectExpr("1 as conv_id", "id as turn", "if(id % 3 = 0, 'user', 'assistant') as role", "concat('text ', id) as text")
    start = time.time()
    row = chat.format_chats(df.unionAll(df)).first()
    assert row["n_turns"] == 200_000 and row["n_merged"] == 133_334 and row["chat"].startswith("<|user|>\ntext 0<|end|>\n<|assistant|>\ntext 1\ntext 2<|end|>")
    assert time.time() - start < 30
