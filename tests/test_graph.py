"""Small graphs with values worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.functions import glob
from lodestone.graph import Graph
from lodestone.operators import concepts as C
from lodestone.operators import grounding as R
from lodestone.operators import insight as N
from lodestone.operators import lookup as L
from lodestone.operators import risk as K
from lodestone.operators import structure as S
from lodestone.operators import temporal as H
from lodestone.operators import traverse as T
from lodestone.operators import vectors as V
from lodestone.operators import workspace as W
from lodestone.sources import code, store

UNITS = "id long, unit_type string, language string, name string, qualified_name string, file_path string, start_line int, end_line int, signature string, doc_summary string, visibility string, complexity int, is_async boolean, is_generator boolean, change_count int, stability_score double, collective_usage long"
EDGES = "source_id long, target_id long, edge_type string, weight double, context int"
CHANGES = "path string, commit_id long, ts long, author string, is_bugfix boolean, lines_added int, lines_deleted int, change_type string"
NAMES = [("module", "app", "unknown", 0, 0, 1.0, None), ("function", "process_payment", "public", 8, 12, 0.3, "Process a payment transaction."), ("function", "validate_input", "private", 3, 2, 0.9, None), ("function", "send_notification", "public", 5, 0, 1.0, None), ("type", "PaymentConfig", "unknown", 0, 0, 1.0, None), ("test", "test_process_payment", "unknown", 0, 0, 1.0, None), ("trait", "Validator", "unknown", 0, 0, 1.0, None), ("type", "UserValidator", "unknown", 0, 0, 1.0, None), ("type", "InputValidator", "unknown", 0, 0, 1.0, None), ("module", "auth", "unknown", 0, 0, 1.0, None), ("function", "login", "unknown", 6, 8, 0.5, "Authenticate user with credentials."), ("function", "logout", "unknown", 0, 0, 1.0, None), ("function", "helper_internal", "private", 15, 20, 0.1, None), ("test", "test_login", "unknown", 0, 0, 1.0, None)]
PAIRS = [*((0, k, "contains", 1.0, 0) for k in (1, 2, 3, 4, 5, 6, 7, 8, 12)), (9, 10, "contains", 1.0, 0), (9, 11, "contains", 1.0, 0), (1, 2, "calls", 1.0, 20), (1, 3, "calls", 1.0, 30), (10, 1, "calls", 1.0, 15), (1, 4, "uses_type", 1.0, 0), (5, 1, "tests", 1.0, 0), (13, 10, "tests", 1.0, 0), (7, 6, "implements", 1.0, 0), (8, 6, "inherits", 1.0, 0), (1, 3, "couples_with", 0.8, 0)]


@pytest.fixture(scope="module")
def g(spark):
    rows = []
    for i, (kind, name, vis, cx, ch, st, doc) in enumerate(NAMES):
        home = "auth" if i in (9, 10, 11, 13) else "app"
        rows.append((i, kind, "Python" if home == "auth" else "Rust", name, name if kind == "module" else f"{home}::{name}", f"src/{home}.rs" if i != 13 else "tests/test_auth.py", i + 1, i + 5, None, doc, vis, cx, False, False, ch, st, 0))
    return Graph(spark.createDataFrame(rows, UNITS), spark.createDataFrame(PAIRS, EDGES), spark.createDataFrame([], CHANGES))


def ids(df, *more):
    return sorted(tuple(r[c] for c in ("id", *more)) if more else r["id"] for r in df.collect())


def test_dependencies(g):
    assert ids(S.dependencies(g, 1, 1)) == [2, 3, 4]
    got = {r["id"]: (r["depth"], r["path"]) for r in S.dependencies(g, 2, 5, direction="backward").collect()}
    assert got == {1: (1, [2, 1]), 10: (2, [2, 1, 10])}
    with pytest.raises(LookupError):
        S.dependencies(g, 99, 1)


def test_impact(g):
    got = {r["id"]: r["risk"] for r in K.impact(g, 2, 5).collect()}
    assert got == {1: 0.45, 10: 0.333333}
    assert K.impact_summary(K.impact(g, 2, 5)).first()["overall_risk"] == pytest.approx(0.391667, abs=2e-6)
    assert K.impact_summary(K.impact(g, 13, 5)).first()["overall_risk"] == 0


def test_coverage_risk_and_hotspots(g):
    assert tuple(K.test_coverage(g, 1).first()) == (1, 1, 0.6)
    risk = {r["id"]: r["risk"] for r in K.prophecy(g, 0, 0.0).collect()}
    assert risk[12] == 0.65 and risk[1] == 0.2
    assert {r["id"]: r["score"] for r in K.hotspots(g, 0, 0.0).collect()}[12] == 0.4975


def test_hierarchy_calls_and_paths(g):
    assert {(r["id"], r["depth"], r["relation"]) for r in S.type_hierarchy(g, 6).collect()} == {(7, -1, "implements"), (8, -1, "inherits")}
    nodes, sites = S.call_graph(g, 1, "both", 1)
    assert ids(nodes, "depth") == [(1, 0), (2, 1), (3, 1), (10, 1)]
    assert sorted(tuple(r) for r in sites.collect()) == [(1, 2, 20), (1, 3, 30), (10, 1, 15)]
    assert T.shortest_path(g.edges, 10, 4).first().asDict() == {"found": True, "path": [10, 1, 4], "length": 2, "edge_types": ["calls", "uses_type"]}
    assert not T.shortest_path(g.edges, 4, 10).first()["found"] and T.shortest_path(g.edges, 4, 4).first()["path"] == [4]
    assert [r["path"] for r in T.simple_paths(g.edges, 10, 3, 3, ["calls"]).collect()] == [[10, 1, 3]]
    assert T.simple_paths(g.edges, 1, 1, 3).count() == 0
    assert [r["id"] for r in T.dfs(g.edges, 10, 2, ["calls"]).orderBy("place").collect()] == [10, 1, 2, 3]
    assert ids(S.containment(g, 9)) == [10, 11]


def test_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 1), (6, 6)], "source_id long, target_id long").withColumn("edge_type", F.lit("calls"))
    assert ids(T.on_cycles(e, ["calls"])) == [1, 2, 3]
    assert ids(T.bfs(e, spark.createDataFrame([(5,)], "id long")), "depth") == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 0)]


def test_edges_that_are_refused(g, spark):
    bad = spark.createDataFrame([(1, 1, "calls", 1.0, 0), (98, 1, "calls", 1.0, 0), (1, 99, "calls", 1.0, 0), (2, 3, "calls", 1.0, 0)], EDGES)
    kept, out = L.valid_edges(g.units, bad)
    assert kept.count() == 1 and sorted(r["error"] for r in out.collect()) == ["invalid_edge_target", "self_edge", "unit_not_found"]
    assert sorted(r["error"] for r in L.valid_edges(g.units, g.edges, 2)[1].collect()) == ["too_many_edges"] * 9
    with pytest.raises(ValueError):
        L.build(g.units, bad)
    assert L.build(g.units, g.edges).count() == len(PAIRS)
    more = L.add_units(g.units, g.units.limit(2).drop("id"))
    assert max(ids(more)) == 15


def test_couplings_and_migration(g):
    got = {(r["unit_a"], r["unit_b"]): (r["kind"], r["strength"]) for r in K.couplings(g, 0.5).collect()}
    assert got[1, 3] == ("explicit", 1.0) and all(a < b for a, b in got)
    assert [(r["step"], r["id"], r["safety"]) for r in K.migration(g, 1, 3).orderBy("step").collect()] == [(0, 3, "safe"), (1, 10, "safe"), (2, 1, "caution")]
    assert ids(S.dead_code(g)) == [6, 7, 8, 11, 12]
    assert {r["id"]: r["verdict"] for r in K.regression(g, 1, 3).collect()} == {5: "likely", 13: "recommended"}


def test_rules_patterns_and_concepts(g):
    assert [(r["rule"], r["source_id"], r["target_id"]) for r in C.drift(g, [("layer", "app", "auth"), ("boundary", "auth"), ("naming", "app::", "*_*")]).where("rule < 2").collect()] == [(0, 10, 1), (1, 10, 1)]
    assert ids(C.match_pattern(g, "function { calls: [validate_input, send_notification] }")) == [1]
    assert ids(C.match_pattern(g, "class { inherits: Validator }")) == [8]
    with pytest.raises(ValueError):
        C.match_pattern(g, "nonsense")
    assert {r["id"]: r["role"] for r in C.map_concept(g, "validator").collect()} == {6: "definition", 7: "definition", 8: "definition"}
    assert C.parse_question("where is the payment function?")[:2] == ("function", ["payment"])
    assert C.conformance(C.drift(g, []), 0).first()["conformance"] == 1.0
    values = g.units.sparkSession.createDataFrame([("get_it",), ("forget",), ("Getter",)], "n string")
    assert [values.where(glob(F.col("n"), p)).count() for p in ("get*", "*get", "*et*", "get_it", "*")] == [2, 1, 3, 1, 3]


def test_history(spark):
    now = 10_000_000
    day = 86400
    rows = [("a", 1, now - 400 * day, "x", False, 10, 0, "add"), ("a", 2, now - day, "y", True, 5, 5, "modify"), ("b", 1, now - 400 * day, "x", False, 1, 1, "add"), ("b", 2, now - day, "y", False, 1, 1, "modify"), ("c", 3, now, "x", False, 0, 0, "add")]
    c = spark.createDataFrame(rows, CHANGES)
    s = {r["path"]: r.asDict() for r in H.stability(H.history(c, now)).collect()}
    assert s["c"]["frequency"] == 1.0 and s["c"]["churn_score"] == 1.0 and s["a"]["bugfix"] == 0.5 and s["a"]["frequency"] == 0.5
    assert [tuple(r) for r in H.cochange(c, 2, 0.5).collect()] == [("a", "b", 2, 1.0, "co_change")]
    p = {r["path"]: r for r in H.predict(H.history(c, now), H.cochange(c, 2, 0.5)).collect()}
    assert p["a"]["bugfix_trend"] == 0.8 and p["a"]["kind"] == "bug_risk" and p["c"]["coupling"] == 0
    assert H.cochange(c.limit(0), 2, 0.5).count() == 0 and H.history(c.limit(0), now).count() == 0
    assert H.within(c, since=now - 2 * day, most_commits=1).count() == 1


def test_grounding(g, spark):
    claims = spark.createDataFrame([(1, "`process_payment` is in PaymentConfig"), (2, "it calls `no_such_thing`"), (3, "nothing named"), (4, "LOGIN and `login`, `proces_payment`"), (5, None)], "claim_id long, text string")
    got = {r["claim_id"]: (r["refs"], r["matched"], r["verdict"]) for r in R.ground(claims.where("text is not null"), g.units).collect()}
    assert got == {1: (2, 2, "verified"), 2: (1, 0, "ungrounded"), 3: (0, 0, "ungrounded"), 4: (2, 1, "partial")}
    assert R.suggest(spark.createDataFrame([("proces_payment",)], "ref string"), g.units, 1).first()["name"] == "process_payment"
    assert {(r["claim_id"], r["ref"], r["kind"]) for r in R.contradictions(claims, g.units).collect()} == {(2, "no_such_thing", "not_found"), (4, "proces_payment", "contradicted")}
    h = {r["claim_id"]: r["safe"] for r in R.hallucinations(claims, g.units).collect()}
    assert h == {1: True, 2: False, 3: True, 4: False, 5: True}


def one_text(spark, text):
    return spark.createDataFrame([(1, text)], "claim_id long, text string")


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("HTTPServer and XMLParser, GitHub too", ["GitHub", "HTTPServer", "XMLParser"]),
        ("`the` `The` ` ` `` `x`", ["x"]),
        ("`a_b` says a_b and `a_b` of B_C", ["B_C", "a_b", "a_b"]),
        ("Hello HTTP World x _y y_ a__b A_ 1_2", []),
        ("say `foo bar_baz` now", ["bar_baz", "foo bar_baz"]),
    ],
)
def test_references(spark, text, names):
    assert sorted(r["ref"] for r in R.exploded(one_text(spark, text)).collect()) == names


def test_wrong_places_and_fixes(spark, g):
    text = "process_payment with no_such is in src/other.rs here.\nUse valid in `validate_input`. The sendx_it of send_notification is in file src/app.rs"
    bad = {(r["k"], r["ref"], r["kind"], r["severity"]) for r in R.hallucinated(one_text(spark, text), g.units).collect()}
    assert bad == {(0, "process_payment", "wrong_location", "moderate"), (0, "no_such", "non_existent", "severe"), (2, "sendx_it", "non_existent", "severe")}
    row = R.hallucinations(one_text(spark, text), g.units).first()
    assert (row["claims"], row["missing"], row["misplaced"], row["score"], row["safe"]) == (3, 2, 1, 1.0, False)
    fixes = {r["ref"]: r["fix"] for r in R.fixes(one_text(spark, text + ". And `valid` or `login_x` in it"), g.units).collect()}
    assert fixes["process_payment"] == "actually in src/app.rs" and fixes["no_such"] == "remove" and fixes["valid"] == "replace by one of: Validator, validate_input" and fixes["login_x"] == "replace by one of: login"


def test_truths(spark, g):
    claims = spark.createDataFrame([(1, "`login` and `logout`"), (2, "`helper_internal`"), (3, "none")], "claim_id long, text string")
    first = R.refresh(R.register(claims, 5), g.units, 10)
    assert {r["claim_id"]: (r["status"], r["invalidated_at"]) for r in first.collect()} == {1: ("valid", None), 2: ("valid", None), 3: ("deleted", 10)}
    later = R.refresh(first, g.units.where("name not in ('logout', 'helper_internal')"), 20)
    assert {r["claim_id"]: (r["status"], r["invalidated_at"]) for r in later.collect()} == {1: ("stale", 20), 2: ("deleted", 20), 3: ("deleted", 10)}
    back = R.refresh(later, g.units, 30)  # what is invalid stays so
    assert {r["claim_id"] for r in R.truth_diff(back).collect()} == {1, 2, 3}


@pytest.mark.parametrize(
    ("roles", "pattern", "layers"),
    [
        (("controller", "model"), "mvc", 1), (("controller", "model", "service"), "mvc", 2), (("controller", "service", "repository", "model"), "layered", 3), (("service", "repository"), "hexagonal", 2),
        (("utility", "test", "entrypoint"), "monolith", 0), (("controller", "service"), "monolith", 2), (("controller", "service", "configuration"), "unknown", 2), ((), "monolith", 0),
    ],
)
def test_architectures(spark, roles, pattern, layers):
    row = C.infer_architecture(spark.createDataFrame([(r, 2) for r in roles], "role string, n long")).first()
    assert (row["pattern"], row["layers"]) == (pattern, layers)


def test_singletons(spark, g):
    rows = [(1, "type", "Config", "app::Config", "public"), (2, "function", "get_instance", "app::Config::get_instance", "public"), (3, "function", "new", "app::Config::new", "private"), (4, "type", "Pool", "app::Pool", "private"), (5, "function", "new", "app::Pool::new", "public"), (6, "type", "Bus", "app::Bus", "public"), (7, "function", "shared", "app::Bus::shared", "public")]
    units = spark.createDataFrame(rows, "id long, unit_type string, name string, qualified_name string, visibility string")
    assert {(r["id"], r["score"]) for r in C.design_patterns(Graph(units, g.edges, g.changes)).where("pattern = 'singleton'").collect()} == {(1, 1.0), (6, 0.5)}


def test_patterns_to_follow(spark):
    rows = [(k, "function", f"get_{n}", f"src/api/{n}.py") for k, n in enumerate(("one_item", "two_item", "three_item"))] + [(9, "function", "fetch", "src/api/x.py"), (10, "type", "Other", "lib/y.py")]
    units = spark.createDataFrame(rows, "id long, unit_type string, name string, file_path string")
    assert {r["pattern"] for r in C.check_patterns(units, 9).collect()} == {"get_*", "*_item"} and C.check_patterns(units, 0).count() == C.check_patterns(units, 10).count() == 0
    assert {r["pattern"]: r["n"] for r in C.suggest_patterns(units, "src/api/new.py").collect()} == {"get_*": 3, "*_item": 3, "dir:src/api:function": 4}
    assert C.suggest_patterns(units, "top.py").count() == 0
    with pytest.raises(ValueError):
        C.match_pattern(Graph(units, None, None), "struct { x }")


def test_questions_as_expressions(spark):
    texts = ["Where is the payment function in module core?", "tests for login.py", "who uses retry", "struct for config", "How is it", "", "logic for été_1 and naïve", "def x"]
    got = {r["text"]: (r["intent"], [k for k in r["keywords"].split(",") if k], r["scope"]) for r in C.parse_questions(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert got == {t: C.parse_question(t) for t in texts}


def test_numbers_follow_ranges(spark):
    from lodestone import state

    df = spark.range(1000, numPartitions=7).selectExpr("id * 7919 % 1000 as k", "id")
    got = state.numbered(df, "n", "k").collect()
    assert len(got) == 1000 and all(r["n"] == r["k"] for r in got) and state.numbered(df.limit(0), "n", "k").count() == 0


def test_a_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace as Made

    from lodestone import state

    session = lambda master, named=None: Made(conf=Made(get=lambda *_: named), sparkContext=Made(master=master))
    assert state.shared_folder(session("spark://x", "hdfs://shared")) == "hdfs://shared" and state.shared_folder(session("local[4]"))
    for master in ("spark://x", "yarn", "local-cluster[2,1,512]"):
        with pytest.raises(RuntimeError):
            state.shared_folder(session(master))


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0]), (3, [1.0, 1.0, 0.0]), (4, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r["vec_id"], r["score"]) for r in V.search(v, [1.0, 0.0, 0.0], 0, -1.0).collect() if r["score"]] == [(1, 1.0), (3, 0.707107)]
    assert [r["vec_id"] for r in V.index_search(v, [1.0, 0.0, 0.0], 10, -1.0).collect()] == [1, 3]
    assert V.index_search(v, [0.0, 0.0, 0.0], 10, -1.0).count() == 0 and V.index_search(v, [1.0, 0.0, 0.0], 0, -1.0).count() == 0
    with pytest.raises(ValueError):
        V.search(v, [], 1, 0.0)
    with pytest.raises(LookupError):
        V.similar(v, 9, 1, 0.0)


def test_empty_graph(g):
    e = Graph(g.units.limit(0), g.edges.limit(0), g.changes)
    for df in (K.hotspots(e, 5, 0.0), K.prophecy(e, 5, 0.0), K.couplings(e, 0.1), S.dead_code(e), C.concepts(e.units), C.naming_patterns(e.units), N.karma(e), K.test_gap(e, 1, 1), C.roles(e.units)):
        assert df.count() == 0
    assert L.sizes(e.units, e.edges).first()["unit_count"] == 0


def test_workspace(g):
    ws = W.workspace([("a", "source", g.units), ("b", "target", g.units.where("id > 5"))])
    assert {r["context_id"]: r["found"] for r in W.cross_reference(ws, "PROCESS_PAYMENT").collect()} == {"a": True, "b": False}
    assert tuple(W.compare(g.units, g.units.where("id > 5")).first()) == (8, 6, 0, pytest.approx(16 / 22, abs=1e-6))
    plan = W.migration_plan(g.units, g.units.where("id > 5")).orderBy("step").collect()
    assert [r["kind"] for r in plan] == ["type", "function", "function", "function", "test", "module"] and [r["step"] for r in plan] == [1, 2, 3, 4, 5, 6]
    log = g.units.sparkSession.createDataFrame([("x", 1, "pending"), ("x", 2, "ported"), ("y", 1, "pending")], "source_symbol string, seq long, status string")
    assert tuple(W.progress(log).first()) == (2, 1, 1, 50.0)


def test_graphs_on_disk(g, spark, tmp_path):
    store.write(g, str(tmp_path / "g"))
    back = store.read(spark, str(tmp_path / "g"))
    assert store.checksum(back).first() == store.checksum(g).first()
    assert back.edges.where("edge_type = 'tests'").count() == 2


PYTHON = '''"""A module."""
import os
from typing import List


class Base:
    """The base."""

    def _inner(self):
        pass

    def __hidden(self):
        yield 1


class Child(Base):
    async def run(self, x: int = 1) -> int:
        if x and self:
            return helper(x)
        return 0


def helper(x):
    return x


def test_helper():
    assert helper(1)
'''
RUST = "pub struct Config { x: u8 }\npub trait Show { fn show(&self); }\nimpl Show for Config {\n    fn show(&self) { if self.x > 1 && true { } }\n}\n#[test]\nfn it_works() {}\nuse std::fs;\n"
TS = "import { a } from './a';\nexport class Dog extends Animal {\n}\nexport async function go() {\n}\nexport const f = (x) => x;\ninterface Shape {\n}\n"
GO = 'package m\nimport "fmt"\ntype T struct {\n}\nfunc (t T) Show() {\n}\nfunc hidden() {\n}\n'


def test_parsers(spark, tmp_path):
    for name, text in (("a/mod.py", PYTHON), ("a/bad.py", "def (:"), ("lib.rs", RUST), ("d.ts", TS), ("m.go", GO), ("node_modules/x.js", "function no() {}"), ("readme.md", "x")):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    assert {r["reason"]: r["n"] for r in code.coverage(code.scan(spark, str(tmp_path))).collect()} == {"parsed": 5, "excluded": 1, "unknown_language": 1}
    rows = {(r["language"], r["name"], r["unit_type"]): r for r in code.read(spark, str(tmp_path)).collect()}
    run = rows["Python", "run", "function"]
    assert run["is_async"] and run["complexity"] == 3 and run["signature"] == "(self, x: int=1) -> int"
    assert rows["Python", "__hidden", "function"]["visibility"] == "private" and rows["Python", "__hidden", "function"]["is_generator"] and rows["Python", "_inner", "function"]["visibility"] == "internal"
    assert rows["Python", "test_helper", "test"] and rows["Python", "Base", "type"]["doc"] == "The base." and rows["Python", "bad", "module"]["error"].startswith("SyntaxError")
    assert rows["Rust", "Config", "type"]["visibility"] == "public" and rows["Rust", "Show", "trait"] and rows["Rust", "it_works", "test"] and rows["Rust", "std::fs", "import"]
    assert rows["TypeScript", "Dog", "type"]["refs"][0]["name"] == "Animal" and rows["TypeScript", "go", "function"]["is_async"] and rows["TypeScript", "f", "function"] and rows["TypeScript", "Shape", "trait"]
    assert rows["Go", "Show", "function"]["visibility"] == "public" and rows["Go", "hidden", "function"]["visibility"] == "private"
    assert {r["reason"] for r in code.scan(spark, str(tmp_path), ignore="*.rs\n/a/*\n!mod.py\n").where("reason = 'ignored'").collect()} == {"ignored"}
    taken = {r["path"].rsplit("/", 1)[-1] for r in code.scan(spark, str(tmp_path), ignore="*.rs\n/a/*\n!mod.py\n# no\n").where("reason is null").collect()}
    assert taken == {"mod.py", "d.ts", "m.go"}
    assert code.scan(spark, str(tmp_path), most_bytes=1).where("reason = 'too_large'").count() == 5
    from lodestone.operators import ingest

    graph = ingest.compile_graph(code.read(spark, str(tmp_path)))
    names = {r["id"]: r["name"] for r in graph.units.collect()}
    edges = {(names[r["source_id"]], names[r["target_id"]], r["edge_type"]) for r in graph.edges.collect()}
    assert {("run", "helper", "calls"), ("test_helper", "helper", "calls"), ("Child", "Base", "inherits"), ("mod", "Child", "contains"), ("Config", "Show", "implements")} <= edges
    assert len(names) == graph.units.count() == len(set(names))


def test_traversal_of_empty_tables(spark):
    none = spark.createDataFrame([], "source_id long, target_id long, edge_type string")
    start = spark.createDataFrame([(1,)], "id long")
    for edges in (none, spark.createDataFrame([(1, 2, "calls")], none.schema).where("edge_type = 'x'")):
        for s, n in ((start, 1), (start.where("id < 0"), 0)):
            assert T.bfs(edges, s, 3).count() == T.closure(edges, s).count() == n
        assert T.on_cycles(edges, ()).count() == T.simple_paths(edges, 1, 2, 3).count() == 0 and not T.shortest_path(edges, 1, 2).first()["found"]
