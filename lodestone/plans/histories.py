"""History and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import change_kind
from lodestone.graph import WITH, load
from lodestone.operators import temporal as T
from lodestone.operators import vectors as V
from lodestone.operators.risk import with_degrees
from lodestone.registry import query

NOW = 996624000
_H1 = f", h as (select path, count(*) as n, count(case when is_bugfix then 1 end) as bugfixes, count(distinct author) as n_authors, cast(sum(lines_added) as bigint) as added, cast(sum(lines_deleted) as bigint) as deleted, cast(sum(lines_added + lines_deleted) as bigint) as churn, max(ts) as latest, min(ts) as oldest, count(case when ts >= {NOW - 180 * 86400} then 1 end) as recent, count(case when ts >= {NOW - 180 * 86400} and is_bugfix then 1 end) as recent_bugfixes from changes c group by path)"
_h = lambda s, d: T.history(load(s, d).changes, NOW, 180)


def _q(name: str, ctes: str, sql: str):
    return query(name, f"{WITH}{ctes} {sql}")


_q("h1_changes_for_path", "", "select commit_id, ts, author, is_bugfix from changes where path = 'p138'")(lambda s, d: load(s, d).changes.where("path = 'p138'").select("commit_id", "ts", "author", "is_bugfix"))
_q("h1_files_in_commit", "", "select distinct path from changes where commit_id = 7")(lambda s, d: load(s, d).changes.where("commit_id = 7").select("path").distinct())
_q("h1_commits", "", "select commit_id, count(*) as n, min(ts) as ts from changes group by commit_id")(lambda s, d: load(s, d).changes.groupBy("commit_id").agg(F.count("*").alias("n"), F.min("ts").alias("ts")))
_q("h2_history", _H1, "select * from h")(_h)
_q("h2_authors", "", "select path, author, count(*) as n from changes group by path, author")(lambda s, d: T.authors(load(s, d).changes))
_q("h3_options", "", f"select path, commit_id, ts from changes where ts >= {NOW - 900 * 86400} and ts <= {NOW} and path like 'p1%' and commit_id in (select commit_id from changes where ts >= {NOW - 900 * 86400} and ts <= {NOW} and path like 'p1%' group by commit_id order by max(ts) desc, commit_id limit 100)")(
    lambda s, d: T.within(load(s, d).changes, NOW - 900 * 86400, NOW, "p1", 100).select("path", "commit_id", "ts")
)
_S = ", sf as (select path, n, bugfixes, recent, n_authors, 1 / (1 + log2(n)) as frequency, 1 - bugfixes * 1e0 / n as bugfix, 1 - recent * 1e0 / n as recency, 1e0 / greatest(1, n_authors) as author, 1 / (1 + case when churn > 0 then greatest(0e0, log2(churn)) else 0e0 end) as churn_score from h)"
_q("h4_stability", _H1 + _S, "select path, round(frequency, 6) as frequency, round(bugfix, 6) as bugfix, round(recency, 6) as recency, round(author, 6) as author, round(churn_score, 6) as churn_score, round(25e-2 * frequency + 25e-2 * bugfix + 2e-1 * recency + 15e-2 * author + 15e-2 * churn_score, 6) as score, concat_ws('; ', case when bugfixes * 1e0 / n > 5e-1 then 'many bugfixes' end, case when recent > 5 then 'changed lately' end, case when n_authors > 5 then 'many authors' end) as advice from sf")(
    lambda s, d: T.stability(_h(s, d))
)
_P = ", tp as materialized (select distinct commit_id, path from changes), nn as (select path, count(*) as n from changes group by path), pr as (select a.path as path_a, b.path as path_b, count(*) as together from tp a join tp b on a.commit_id = b.commit_id and a.path < b.path group by a.path, b.path having count(*) >= 2), cc as (select path_a, path_b, together, round(least(1e0, together * 1e0 / greatest(x.n, y.n)), 6) as strength from pr join nn x on x.path = path_a join nn y on y.path = path_b)"
_paths = lambda g: g.edges.where("edge_type in ('calls', 'couples_with')").select(F.concat(F.lit("p"), F.col("source_id").cast("string")).alias("path_a"), F.concat(F.lit("p"), F.col("target_id").cast("string")).alias("path_b"))
_q("h5_cochange", _P, "select cc.*, case when exists (select 1 from edges where edge_type in ('calls', 'couples_with') and 'p' || source_id = path_a and 'p' || target_id = path_b) then 'explicit_edge' else 'co_change' end as kind from cc where strength >= 5e-2")(
    lambda s, d: T.cochange(load(s, d).changes, 2, 0.05, _paths(load(s, d)))
)
_R = _P + ", nr as (select path, avg(strength) as s, count(*) as k from (select path_a as path, strength from cc where strength >= 5e-2 union all select path_b, strength from cc where strength >= 5e-2) x group by path), pf as (select h.path, least(1e0, 5e-1 * recent / n + 5e-1 * least(1e0, recent / 5e0)) as v, least(1e0, 4e-1 * bugfixes / n + 6e-1 * case when recent > 0 then recent_bugfixes * 1e0 / recent else 0e0 end) as b, greatest(0, added - deleted) * 1e0 / (greatest(0, added - deleted) + 100) as g, case when k is null then 0e0 else least(1e0, 6e-1 * s + 4e-1 * least(1e0, sqrt(k) / 3)) end as c from h left join nr on nr.path = h.path), pred as (select path, round(v, 6) as velocity, round(b, 6) as bugfix_trend, round(g, 6) as growth, round(c, 6) as coupling, round(3e-1 * v + 3e-1 * b + 15e-2 * g + 25e-2 * c, 6) as risk, case when b >= v and b >= g and b >= c then 'bug_risk' when c >= v and c >= g then 'coupling_risk' when g >= v then 'complexity_growth' else 'change_velocity' end as kind from pf)"
_pred = lambda s, d: T.predict(_h(s, d), T.cochange(load(s, d).changes, 2, 0.05))
_q("h6_predictions", _H1 + _R, "select * from pred")(_pred)
_q("h6_top_predictions", _H1 + _R, "select * from pred where risk >= 2e-1 order by risk desc, path limit 20")(lambda s, d: T.top_predictions(_pred(s, d), 20, 0.2))
_q("h7_alerts", _H1 + _R + ", best as (select * from pred where risk >= 3e-1 order by risk desc, path limit 20)", "select 'hotspot' as kind, path, risk from best where risk > 5e-1 union all select 'systemic', path, risk from (select * from best order by risk desc, path limit 5) x where (select avg(risk) from pred) > 25e-2")(lambda s, d: T.alerts(_pred(s, d), hotspot=0.5, systemic=0.25))
_E = ", din as (select target_id as id, count(*) as n_in from edges group by target_id), ev as (select u.id, complexity > 15 as a, change_count > 10 as b, stability_score < 3e-1 as c, coalesce(n_in, 0) > 10 as d from units u left join din on din.id = u.id)"
_said = "concat_ws('; ', case when not (a or b or c or d) then 'stable' end, case when a then 'bugs by complexity' end, case when b then 'needs refactoring' end, case when c then 'more changes' end, case when d then 'wide impact' end{more}) as predictions, round(case when a or b or c or d then least(1e0, (case when a then 8e-1 else 0e0 end + case when b then 7e-1 else 0e0 end + case when c then 8e-1 else 0e0 end + case when d then 9e-1 else 0e0 end) / (cast(a as int) + cast(b as int) + cast(c as int) + cast(d as int))) else 3e-1 end, 6) as confidence from ev"
_q("h8_evidence", _E, "select id, " + _said.format(more=""))(lambda s, d: T.evidence(with_degrees(load(s, d))))
_q("h8_if", _E, "select id, " + _said.format(more=", 'if split: more changes'"))(lambda s, d: T.evidence(with_degrees(load(s, d)), "split"))
_q("h8_compare", _E, "select case id when 138 then 'a' else 'b' end as side, id, " + _said.format(more="") + " where id in (138, 169)")(lambda s, d: T.evidence_compare(with_degrees(load(s, d)), 138, 169))
query("h8_pattern", "select 'factory' as pattern, 'needs more data' as predictions, 3e-1 as confidence")(lambda s, d: T.pattern_evidence(s, "factory"))
_q("h8_module", "", "select count(*) as units, round(coalesce(avg(complexity), 0e0), 6) as complexity, cast(coalesce(sum(change_count), 0) as bigint) as changes, concat_ws('; ', case when avg(complexity) > 10 then 'complex module' end, case when sum(change_count) > 50 then 'volatile module' end) as verdict from units where qualified_name like 'brand1%'")(lambda s, d: T.module_evidence(load(s, d).units, "brand1"))
_I = ", iv as (select id, stability_score, coalesce(n, 0) as changes, coalesce(bugfixes, 0) as bugfixes, coalesce(n_authors, 0) as n_authors, coalesce(churn, 0) as churn, coalesce((latest - oldest) // 86400, 0) as age_days from units u left join h on h.path = 'p' || u.id)"
_q("h9_investigate", _H1 + _I, "select id, changes, bugfixes, age_days, case when changes = 0 then 'unknown' when stability_score > 8e-1 and age_days > 180 then 'stable' when bugfixes * 1e0 / changes > 6e-1 and age_days > 90 then 'decaying' when age_days < 30 or changes > 10 then 'active' else 'maturing' end as phase, case when changes = 0 then 'no history' else coalesce(nullif(concat_ws('; ', case when age_days > 365 then 'mature' end, case when age_days < 30 then 'new' end, case when bugfixes * 1e0 / changes > 5e-1 then 'problematic' end, case when n_authors > 3 then 'many hands' end, case when n_authors = 1 then 'one owner' end, case when churn > 500 then 'reworked' end, case when stability_score < 3e-1 then 'volatile' end, case when stability_score > 8e-1 then 'settled' end), ''), 'typical') end as explanation from iv")(
    lambda s, d: T.investigate(load(s, d).units.select("id", "stability_score", F.concat(F.lit("p"), F.col("id").cast("string")).alias("path")), _h(s, d))
)
_q("h9_when_changed", "", "select u.id, ts, author, case when is_bugfix then 'bugfix' else 'unknown' end as kind, change_type || ' by ' || author || ' (+' || lines_added || ' -' || lines_deleted || ')' as description from units u join changes on path = 'p' || u.id")(
    lambda s, d: T.when_changed(load(s, d).units.select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("path")), load(s, d).changes)
)
_q("h10_change_kind", "", "select item_id, case when regexp_matches(lower(text), 'fix|bug|patch|hotfix') then 'bugfix' when regexp_matches(lower(text), 'refactor|cleanup|reorganize|restructure') then 'refactor' when regexp_matches(lower(text), 'perf|optimiz|speed|fast') then 'performance' when regexp_matches(lower(text), 'feat|add|implement|new') then 'feature' else 'unknown' end as kind from benchmark")(
    lambda s, d: s.read.parquet(f"{d}/benchmark.parquet").select("item_id", change_kind(F.col("text")).alias("kind"))
)

_vec = lambda s, d: s.read.parquet(f"{d}/embeddings.parquet")
_sim = "with v as (select vec_id, embedding::double[] as e from embeddings), q as (select e from v where vec_id = 7), sc as (select vec_id, round(coalesce(list_cosine_similarity(v.e, q.e), 0), 6) as score from v, q)"
_near = lambda s, d: _vec(s, d).where("vec_id = 7").first()["embedding"]
query("q8_semantic_search", f"{_sim} select * from sc where score >= 1e-1 order by score desc, vec_id limit 25")(lambda s, d: V.search(_vec(s, d), _near(s, d), 25, 0.1))
_typed = lambda s, d: _vec(s, d).selectExpr("vec_id", "embedding", "case vec_id % 3 when 0 then 'function' when 1 then 'type' else 'test' end as unit_type", "case vec_id % 2 when 0 then 'Rust' else 'Go' end as language")
query("q8_semantic_filters", f"{_sim} select * from sc where score >= 5e-2 and vec_id % 3 in (0, 1) and vec_id % 2 = 0 order by score desc, vec_id limit 25")(lambda s, d: V.search(_typed(s, d), _near(s, d), 25, 0.05, ["function", "type"], ["Rust"]))
query("q22_similarity", f"{_sim} select * from sc where vec_id <> 7 and score >= 0 order by score desc, vec_id limit 10")(lambda s, d: V.similar(_vec(s, d), 7, 10, 0.0))
query("i5_index_search", f"{_sim} select * from sc where score >= 2e-1 order by score desc, vec_id limit 40")(lambda s, d: V.index_search(_vec(s, d), _near(s, d), 40, 0.2))
query("i8_find_similar", f"{_sim} select * from sc where vec_id <> 7 and score >= -1 order by score desc, vec_id limit 5")(lambda s, d: V.similar(_vec(s, d), 7, 5, -1.0))
