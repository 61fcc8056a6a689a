"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered by the order of their key. An unbalanced Feistel network permutes the numbers below 2^b, b the fewest
bits that hold the number of rows; a number that falls outside the rows is permuted again until it falls inside
(cycle walking, two steps on average). So the shuffle is the same at every run, each row's shard and slot follow from its number
alone, and the inverse gives the row of any shard and slot. Only keys are sorted; nothing is gathered but one count for each
partition.

Defined results: null keys come first and rows of equal keys are numbered consecutively, in an order among themselves
that isn't fixed; as only keys are returned, the result is. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.state import checkpoint

ROUNDS, SEED, SHARDS = 6, 20240229, 64
_PRIME = 2147483647


def keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    """The round keys of a seed."""
    out, x = [], seed % _PRIME
    for _ in range(rounds):
        x = (x * 48271 + 11) % _PRIME
        out.append(x)
    return out


def halves(rows: int) -> tuple[int, int]:
    """Bits of the left and the right half; together they hold the number of rows."""
    bits = max(2, (max(rows, 1) - 1).bit_length())
    return bits // 2, bits - bits // 2


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    y = (x + key) % _PRIME
    y = (y * y + key) % _PRIME
    return (y * 48271 + (y >> 7)) % _PRIME


def permute(number: np.ndarray, rows: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """The place of each number below rows, also below rows; back gives the number of each place."""
    left, right = halves(rows)
    x = np.asarray(number, np.int64).copy()
    out = np.arange(len(x))
    ks = keys(seed)
    while len(out):
        part = x[out]
        a, b = part >> right, part & ((1 << right) - 1)  # of left and right bits
        for k in reversed(ks) if back else ks:
            # the halves keep their widths: each round changes the left by the right, then the right by the left
            if back:
                b ^= _mixed(a, k) & ((1 << right) - 1)
                a ^= _mixed(b, k ^ 1) & ((1 << left) - 1)
            else:
                a ^= _mixed(b, k ^ 1) & ((1 << left) - 1)
                b ^= _mixed(a, k) & ((1 << right) - 1)
        x[out] = (a << right) | b
        out = out[x[out] >= rows]
    return x


def number(table: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(key, row) with rows numbered from 0 by key, and their count."""
    rows = table.select(key).repartitionByRange(key).sortWithinPartitions(key)
    kind = table.schema[key].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(np.arange(n, n + batch.num_rows))], names=[key, "part", "at"])
            n += batch.num_rows

    kept = checkpoint(rows.mapInArrow(place, f"`{key}` {kind}, part int, at long"))  # written, so that the two uses see the same parts
    sizes = sorted((r["part"], r["n"]) for r in kept.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row for each partition
    base, total = [], 0
    for part, n in sizes:
        base.append((part, total))
        total += n
    offsets = table.sparkSession.createDataFrame(base, "part int, base long")
    return kept.join(F.broadcast(offsets), "part").select(key, (F.col("base") + F.col("at")).alias("row")), total


def assign(table: DataFrame, key: str = "doc_id", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(key, row, place, shard, slot) of every row: place = slot * shards + shard."""
    numbered, total = number(table, key)

    @F.pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), total, seed))

    placed = numbered.withColumn("place", place("row"))
    return placed.select(key, "row", "place", F.pmod("place", F.lit(shards)).cast("long").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"))


def _sql() -> str:
    """DuckDB SQL: the network on two columns, walked by a recursive query."""
    mixed = lambda x, k: f"((({s}*{s}+{k})%{_PRIME})*48271 + ((({s}*{s}+{k})%{_PRIME})>>7))%{_PRIME}" if (s := f"(({x}+{k})%{_PRIME})") else ""
    steps = ["r0 as (select doc_id, row, n, x >> rb as a, x & ((1<<rb)-1) as b, lb, rb from walk_in)"]
    at = "r0"
    for i, k in enumerate(keys(SEED)):
        steps.append(f"s{i} as (select doc_id, row, n, xor(a, ({mixed('b', k ^ 1)}) & ((1<<lb)-1)) as a, b, lb, rb from {at})")
        steps.append(f"t{i} as (select doc_id, row, n, a, xor(b, ({mixed('a', k)}) & ((1<<rb)-1)) as b, lb, rb from s{i})")
        at = f"t{i}"
    inner = ", ".join(s.replace("walk_in", "(select * from walk where not done) q") for s in steps)
    return f"""
with recursive total as (select count(*) as n, greatest(2, case when count(*) <= 1 then 0 else cast(ceil(log2(count(*))) as bigint) end) as bits from documents),
rows as (select doc_id, row_number() over (order by doc_id nulls first) - 1 as row, n, bits // 2 as lb, bits - bits // 2 as rb from documents, total),
walk as (
  select doc_id, row, n, row as x, lb, rb, false as done from rows
  union all
  select * from (with {inner} select doc_id, row, n, (a << rb) | b as x, lb, rb, ((a << rb) | b) < n as done from {at}) z)
select doc_id, row, x as place, x % {SHARDS} as shard, x // {SHARDS} as slot from walk where done
"""


SQL = _sql()
