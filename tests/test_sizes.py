"""What must hold so that steps grow no faster than their input."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from lodestone import graph, registry, state
from lodestone.functions import nearest
from lodestone.operators import grounding as R
from lodestone.operators import ingest as I
from lodestone.operators import traverse as T
from lodestone.plans import ingests
from lodestone.sources import code

registry.register()


def test_files_are_spread_before_they_are_parsed(spark, sf):
    files = ingests._files(spark, sf)
    assert files.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert files.select("path").distinct().count() == spark.read.parquet(f"{sf}/part.parquet").count()


def test_rows_of_many_files_leave_python_in_one_batch(spark):
    texts = {f"src/a{k}.{('py', 'rs', 'ts', 'go', 'txt')[k % 5]}": (b"import os\n\ndef f(x):\n    return g(x)\n", b"use a::b;\npub fn f() {\n}\n", b"export class A extends B {\n}\n", b"func F() {\n}\n", None)[k % 5] for k in range(60)} | {"src/bad.py": b"def f(:\n", "src/\xe9.py": b"\xff"}
    files = spark.createDataFrame(list(texts.items()), "path string, content binary").coalesce(1)
    got = code.parse(files)
    assert [f"{f.name} {f.dataType.simpleString()}" for f in got.schema] == code.RAW.split(", ")
    want = [r for p, c in texts.items() for r in code.parse_file(p, (c or b"").decode("utf-8", "replace"))]
    plain = lambda r: (*r[:13], [tuple(x) for x in r[13]], r[14])
    assert sorted(map(repr, map(plain, got.collect()))) == sorted(map(repr, map(plain, want)))
    assert code._batch(want).num_rows == len(want)


def test_a_name_that_many_units_share_is_joined_twice_at_most(spark):
    n = 2000
    rows = [(k, f"src/a{k % 50}.py", "Python", "function", "f", f"a{k % 50}.f{k}", [("f", "call", 1), ("x.f", "call", 2)]) for k in range(n)]
    units = spark.createDataFrame(rows, "id long, path string, language string, unit_type string, name string, qualified_name string, refs array<struct<name:string,kind:string,line:int>>")
    least = I._two_least(units.select(F.col("id").alias("t"), "path", "name"), ["path", "name"])
    assert {(r["path"], r["t1"], r["t2"]) for r in least.collect()} == {(f"src/a{m}.py", m, m + 50) for m in range(50)}
    got = {(r["id"], r["line"]): (r["target_id"], r["how"]) for r in I.resolve(units).collect()}
    assert got == {(k, line): (k % 50 if k >= 50 else k + 50, "local") for k in range(n) for line in (1, 2)}


def test_a_reference_in_the_only_unit_of_its_name_has_no_target(spark):
    units = spark.createDataFrame([(1, "a.py", "Python", "function", "f", "a.f", [("f", "call", 1)])], "id long, path string, language string, unit_type string, name string, qualified_name string, refs array<struct<name:string,kind:string,line:int>>")
    assert [(r["target_id"], r["how"]) for r in I.resolve(units).collect()] == [(None, "unresolved")]


def test_a_path_longer_than_the_bound_is_not_found(spark):
    edges = spark.createDataFrame([(k, k + 1, "calls") for k in range(1, 7)], "source_id long, target_id long, edge_type string")
    found = lambda end, most: tuple(T.shortest_path(edges, 1, end, ["calls"], most).first())
    assert found(5, 4) == (True, [1, 2, 3, 4, 5], 4, ["calls"] * 4)
    assert found(6, 4) == (False, [], 0, [])
    assert found(1, 0) == (True, [1], 0, [])
    assert found(7, -1)[2] == 6


def _levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distances_to_all_names_at_once():
    r = random.Random(3)
    for t in range(200):
        letters = "ab" if t % 2 else "abcd\xe9\U0001f600z_0"
        word = lambda *sizes: "".join(r.choice(letters) for _ in range(r.choice(sizes)))  # noqa: B023, E731
        names = sorted(word(0, 1, 3, 8, 70, 130) if t % 3 == 0 else word(*range(10)) for _ in range(r.randint(0, 20)))
        text, most = word(0, 1, 5, 63, 64, 65, 128, 140), r.choice([0, 1, 3, 8, 1000])
        want = [_levenshtein(text, n) for n in names]
        assert np.minimum(nearest.Names(names).distances(text, most), most + 1).tolist() == [min(d, most + 1) for d in want]
        best = sorted((d, n) for d, n in zip(want, names) if 0 < d <= most)[:3]
        assert nearest.closest(nearest.by_length(names, names), text, most, 3) == [(n, d) for d, n in best]


def test_suggestions_are_those_of_all_pairs_in_any_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "NAMES", 7)
    monkeypatch.setattr(R, "REFS", 2)
    names = [f"Box{k}" for k in range(30)] + ["box3", "open_box", "Open_Box", "x", "boxes" * 30]
    asked = ["BOX", "box31", "bax3", "opn_box", "nothing", "boxes" * 29 + "boxer", "\xe9", ""]
    units = spark.createDataFrame([(n,) for n in names], "name string")
    want = set()
    for ref in asked:
        all_ = [(0 if n.lower().startswith(ref.lower()) or ref.lower().startswith(n.lower()) else _levenshtein(n.lower(), ref.lower()), n) for n in set(names)]
        want |= {(ref, n, d, k) for k, (d, n) in enumerate(sorted(x for x in all_ if x[0] <= len(ref) // 2)[:3])}
    got = R.suggest(spark.createDataFrame([(a,) for a in asked], "ref string"), units)
    assert {(r["ref"], r["name"], r["distance"], round(10 * (1 - r["relevance"]))) for r in got.collect()} == want
    assert "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().toString()


def test_suggestions_are_made_for_all_claims(spark, sf):
    asked = registry.QUERIES["r4_suggestions"](spark, sf).select("claim_id")
    assert asked.where("claim_id % 100 <> 0").count() > 0
    assert "% 100" not in registry.ORACLE["r4_suggestions"]


def test_a_session_of_few_partitions_makes_the_graph_in_many(spark, sf, monkeypatch):
    monkeypatch.setattr(state, "SHUFFLE_BYTES", 1 << 14)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", *state.MOST_MB)}
    own = state.sized(spark, 100 << 14)
    assert own.conf.get("spark.sql.shuffle.partitions") == "100"
    assert own.conf.get("spark.sql.session.timeZone") == "UTC"
    assert own.conf.get("spark.sql.autoBroadcastJoinThreshold") == f"{1 << 20}b"  # ten times as much by default
    assert {k: spark.conf.get(k) for k in before} == before
    assert state.sized(spark, 1).conf.get("spark.sql.shuffle.partitions") == before["spark.sql.shuffle.partitions"]
    monkeypatch.setattr(graph, "_loaded", {})
    g = graph.load(spark, sf)
    assert all(int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")) > int(before["spark.sql.shuffle.partitions"]) for t in (g.units, g.edges, g.changes))
    joined = g.units.join(spark.createDataFrame([(138,)], "id long"), "id")
    assert int(joined.sparkSession.conf.get("spark.sql.shuffle.partitions")) > 4 and joined.count() == 1


def test_the_plan_of_truths_does_not_grow_with_each_refresh(spark, sf):
    units = graph.load(spark, sf).units
    claims = units.where("id < 20").selectExpr("id as claim_id", "'see `' || name || '` and no_such_name' as text")
    sizes, truths = [], R.register(claims, 100)
    for at in (200, 300, 400):
        truths = R.refresh(truths, units, at)
        sizes.append(len(truths._jdf.queryExecution().optimizedPlan().toString()))
    assert max(sizes) < 1.2 * min(sizes)
    assert {r["invalidated_at"] for r in R.truth_diff(truths).collect()} == {200}


def test_evidence_is_never_joined_by_a_broadcast(spark, sf):
    units = graph.load(spark, sf).units
    claims = units.where("id < 20").selectExpr("id as claim_id", "'see `' || name || '`' as text")
    found = R.find_evidence(R.exploded(claims), units)
    assert found.count() > 20 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
