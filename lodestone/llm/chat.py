"""Chat formatting: turns of a conversation, collected, sorted, merged and concatenated by Spark expressions alone.

The turns of a conversation are collected as structs and sorted by (turn, role, text); equal ones are then neighbours, of which the
first stays. Adjacent turns of one role become one, their texts joined by a line break. The result is one string for each conversation: ``<|role|>``, a line break, the text,
``<|end|>`` and a line break for each merged turn. One shuffle, on conv_id; beside the sort, the work for a conversation is linear in it.
A conversation becomes one string, so its turns are in one task.

Defined results: rows with a null conv_id belong to no conversation and are left out. A null turn sorts after all others. A
null role is ``unknown``; roles are trimmed and lower-cased. Null texts and texts of white space only add nothing, and a
turn without any other text doesn't part its neighbours. Rows that repeat exactly count once; other rows of the same turn
number are ordered by role and text. A conversation without any text has no row. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_merged, roles, chat): roles of the merged turns joined by commas."""
    said = turns.where(F.col("conv_id").isNotNull() & (F.trim(F.regexp_replace("text", r"\s+", " ")) != "")).select(
        "conv_id", F.struct(F.col("turn").isNull().alias("last"), F.col("turn").alias("turn"), F.coalesce(F.lower(F.trim("role")), F.lit("unknown")).alias("role"), F.col("text").alias("text")).alias("t")
    )
    sorted_ = said.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("s"))
    # array_distinct would compare each struct with all others
    one = sorted_.select("conv_id", F.filter("s", lambda x, i: (i == 0) | ~x.eqNullSafe(F.get("s", F.greatest(i - 1, F.lit(0))))).alias("t"))
    n = F.size("t")
    # places, from 1, at which a run of one role begins
    begins = one.withColumn("b", F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at("t", i)["role"] != F.element_at("t", F.greatest(i - 1, F.lit(1)))["role"])))
    runs = begins.withColumn(
        "m",
        F.transform(
            F.sequence(F.lit(1), F.size("b")),
            lambda k: F.struct(
                F.element_at("t", F.element_at("b", k))["role"].alias("role"),
                F.array_join(F.transform(F.slice("t", F.element_at("b", k), F.coalesce(F.get("b", k), n + 1) - F.element_at("b", k)), lambda x: x["text"]), "\n").alias("text"),
            ),
        ),
    )
    return runs.select(
        "conv_id",
        n.cast("long").alias("n_turns"),
        F.size("m").cast("long").alias("n_merged"),
        F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"),
        F.array_join(F.transform("m", lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), x["text"], F.lit("<|end|>\n"))), "").alias("chat"),
    )


SQL = r"""
with said as (
  select distinct conv_id, turn, coalesce(lower(trim(role)), 'unknown') as role, text from conversations
  where conv_id is not null and trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''),
numbered as (select *, row_number() over (partition by conv_id order by turn nulls last, role, text) as k,
  lag(role) over (partition by conv_id order by turn nulls last, role, text) as prior from said),
marked as (select *, sum(case when prior is null or prior <> role then 1 else 0 end) over (partition by conv_id order by k) as run from numbered),
merged as (select conv_id, run, min(role) as role, string_agg(text, chr(10) order by k) as text, count(*) as n from marked group by conv_id, run)
select conv_id, cast(sum(n) as bigint) as n_turns, count(*) as n_merged, string_agg(role, ',' order by run) as roles,
  string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' order by run) as chat
from merged group by conv_id
"""
