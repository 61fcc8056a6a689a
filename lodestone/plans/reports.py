"""Workspace and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.graph import WITH, load
from lodestone.operators import concepts as C
from lodestone.operators import insight as N
from lodestone.operators import workspace as W
from lodestone.plans.risks import DEG
from lodestone.plans.structures import _at, reach
from lodestone.registry import query


def _q(name: str, ctes: str, sql: str, deg: bool = False):
    return query(name, f"{WITH}{DEG if deg else ''}{ctes} {sql}")


def _ws(s, d):
    u = load(s, d).units
    return W.workspace([("a", "source", u.where("language <> 'Rust'")), ("b", "target", u.where("language <> 'Python' and id % 4 <> 1")), ("c", "reference", u.where("unit_type = 'type'"))])


_WS = ", ws as (select *, 'a' as context_id, 'source' as role from units where language <> 'Rust' union all select *, 'b', 'target' from units where language <> 'Python' and id % 4 <> 1 union all select *, 'c', 'reference' from units where unit_type = 'type')"
_A, _B = "(select * from ws where context_id = 'a')", "(select * from ws where context_id = 'b')"
_ab = lambda s, d: (_ws(s, d).where("context_id = 'a'"), _ws(s, d).where("context_id = 'b'"))
_q("w1_contexts", _WS, "select context_id, role, count(*) as n from ws group by context_id, role")(lambda s, d: _ws(s, d).groupBy("context_id", "role").agg(F.count("*").alias("n")))
_q("w2_query_all", _WS, "select context_id, id, name from ws where contains(lower(name), 'supplier1')")(lambda s, d: W.find(_ws(s, d), "Supplier1"))
_q("w2_query_roles", _WS, "select context_id, id, name from ws where contains(lower(name), 'red') and role in ('source')")(lambda s, d: W.find(_ws(s, d), "red", ["source"]))
_q("w3_compare", _WS + ", f as (select * from (select context_id, id, signature, unit_type, row_number() over (partition by context_id order by id) as k from ws where lower(name) = 'supplier7') x where k = 1), l as (select signature as s0, unit_type as t0 from f order by context_id limit 1)", "select c.context_id, id is not null as found, id, id is not null and signature is not distinct from s0 as same_signature, coalesce(unit_type = t0, false) as same_type from (select distinct context_id from ws) c left join f on f.context_id = c.context_id cross join l")(
    lambda s, d: W.compare_symbol(_ws(s, d), "supplier7")
)
_q("w4_cross_reference", _WS, "select context_id, bool_or(lower(name) = 'supplier7') as found from ws group by context_id")(lambda s, d: W.cross_reference(_ws(s, d), "Supplier7"))
_q("w5_compare_codebases", _WS + f", na as (select distinct lower(name) as n from {_A} x), nb as (select distinct lower(name) as n from {_B} x), cn as (select (select count(*) from na where n in (select n from nb)) as common, (select count(*) from na where n not in (select n from nb)) as only_a, (select count(*) from nb where n not in (select n from na)) as only_b)", "select common, only_a, only_b, round(2e0 * common / (2 * common + only_a + only_b), 6) as similarity from cn")(lambda s, d: W.compare(*_ab(s, d)))
_dir = "regexp_extract(file_path, '^(.*)/', 1) as directory, count(*) as n"
_q("w5_directories", _WS + f", da as (select {_dir} from {_A} x group by 1), db as (select {_dir} from {_B} x group by 1)", "select coalesce(da.directory, db.directory) as directory, coalesce(da.n, 0) as n_a, coalesce(db.n, 0) as n_b from da full outer join db on da.directory = db.directory where coalesce(da.n, 0) <> coalesce(db.n, 0)")(lambda s, d: W.directories(*_ab(s, d)))
_q("w6_migration_plan", _WS + f", mi as (select name, min(unit_type) as kind from {_A} x where name not in (select name from {_B} y) group by name)", "select row_number() over (order by case kind when 'type' then 0 when 'function' then 1 when 'test' then 2 else 3 end, name) as step, name, kind, nullif(row_number() over (order by case kind when 'type' then 0 when 'function' then 1 when 'test' then 2 else 3 end, name) - 1, 0) as after from mi")(lambda s, d: W.migration_plan(*_ab(s, d)))
_log = lambda s, d: load(s, d).changes.selectExpr("path as source_symbol", "commit_id * 100 + lines_added as seq", "case lines_deleted % 5 when 0 then 'pending' when 1 then 'ported' when 2 then 'verified' when 3 then 'skipped' else 'in_progress' end as status", "author").groupBy("source_symbol", "seq").agg(F.min("status").alias("status"))
_LG = ", lg as (select path as source_symbol, commit_id * 100 + lines_added as seq, min(case lines_deleted % 5 when 0 then 'pending' when 1 then 'ported' when 2 then 'verified' when 3 then 'skipped' else 'in_progress' end) as status from changes group by 1, 2), lt as (select * from (select *, row_number() over (partition by source_symbol order by seq desc) as k from lg) x where k = 1)"
_q("w7_translations", _LG, "select source_symbol, seq, status from lt")(lambda s, d: W.translations(_log(s, d)))
_q("w7_progress", _LG + ", pg as (select count(*) as total, count(case when status in ('ported', 'verified', 'skipped') then 1 end) as done from lt)", "select total, done, total - done as remaining, round(1e2 * done / total, 6) as percent from pg")(lambda s, d: W.progress(_log(s, d)))
_q("w7_remaining", _LG, "select source_symbol from lt where status not in ('ported', 'verified', 'skipped')")(lambda s, d: W.translations(_log(s, d)).where("status not in ('ported', 'verified', 'skipped')").select("source_symbol"))
_kind = "case doc_id % 3 when 0 then 'raw_text' when 1 then 'author' else 'metric' end as kind"
query("c1_delta", f"select j as json, sha256(j) as delta_id from (select cast(to_json({{'kind': kind, 'text': text}}) as varchar) as j from (select {_kind}, text from documents) d where kind not in ('source_code', 'file_path', 'author', 'identity') and (kind <> 'raw_text' or not regexp_matches(lower(text), 'password|passwd|secret|api_key|apikey|token|credential|private_key|auth|bearer|access_key'))) x")(
    lambda s, d: W.delta(s.read.parquet(f"{d}/documents.parquet").selectExpr(_kind, "text"))
)
#: The second listing: every fifth file has another name, every seventh another content.
_then, _now = ("concat('f', doc_id) as path", "text as content"), ("case when doc_id % 5 = 0 then concat('g', doc_id) else concat('f', doc_id) end as path", "case when doc_id % 7 = 0 then concat(text, '!') else text end as content")
query("e8_changed_files", f"select path, change from (select coalesce(o.path, n.path) as path, case when o.path is null then 'added' when n.path is null then 'removed' when o.content <> n.content then 'modified' end as change from (select {', '.join(_then)} from documents) o full outer join (select {', '.join(_now)} from documents) n on o.path = n.path) x where change is not null")(
    lambda s, d: W.changed_files(s.read.parquet(f"{d}/documents.parquet").selectExpr(*_then), s.read.parquet(f"{d}/documents.parquet").selectExpr(*_now))
)
_q("m_resurrect_search", "", "select id, contains(lower(coalesce(doc_summary, '')), 'deprecated') as deprecated, t + cast(doc_summary is not null as int) + cast(signature is not null as int) as evidence, case when t + cast(doc_summary is not null as int) + cast(signature is not null as int) > 5 then 'high' when t + cast(doc_summary is not null as int) + cast(signature is not null as int) > 2 then 'medium' else 'low' end as confidence from full_u where contains(lower(name), 'token') or contains(lower(coalesce(doc_summary, '')), 'token')", True)(lambda s, d: N.resurrect(load(s, d), "token"))
_q("m_versions", "", "select source_id as id, target_id as old_id, a.name, b.name as old_name from edges join units a on a.id = source_id join units b on b.id = target_id where edge_type = 'version_of'")(lambda s, d: N.versions(load(s, d)))
_q("m_genetics_dna", ", oe as (select source_id as id, string_agg(edge_type, ',' order by edge_type) as o from (select distinct source_id, edge_type from edges) x group by source_id), ie as (select target_id as id, string_agg(edge_type, ',' order by edge_type) as i from (select distinct target_id, edge_type from edges) x group by target_id)", "select u.id, coalesce(o, '') as out_types, coalesce(i, '') as in_types, case when contains(name, '_') and upper(name) = name then 'screaming' when contains(name, '_') then 'snake' when regexp_matches(name, '^[A-Z]') then 'camel' else 'other' end as style from units u left join oe on oe.id = u.id left join ie on ie.id = u.id")(lambda s, d: N.dna(load(s, d)))
_q("m_genetics_lineage", reach(_at(138), 10, "'contains', 'inherits', 'version_of', 'implements'", "backward"), "select id, depth from r where depth > 0")(lambda s, d: N.lineage(load(s, d), 138))
_q("m_genetics_mutations", ", sg as (select u.id, concat_ws('; ', case when complexity > 20 then 'complex' end, case when stability_score < 3e-1 and change_count > 5 then 'unstable' end, case when u.id in (select source_id from edges where edge_type = 'breaks_with') then 'breaks' end) as signs from units u)", "select * from sg where signs <> ''")(lambda s, d: N.mutations(load(s, d)))
_q("m_genetics_diseases", ", co as (select source_id as id, count(*) as c from edges where edge_type = 'calls' group by source_id), ci as (select target_id as id, count(*) as c from edges where edge_type = 'calls' group by target_id), ou as (select source_id as id, count(*) as c from edges group by source_id)", "select id, 'god_object' as disease from ou where c > 20 union all select co.id, 'feature_envy' from co left join ci on ci.id = co.id where co.c > 10 and co.c > 3 * coalesce(ci.c, 0) union all select id, 'untested' from full_u where unit_type = 'function' and t = 0 union all select id, 'orphan' from full_u where n = 0 union all select distinct a.source_id, 'circular' from edges a join edges b on a.source_id = b.target_id and a.target_id = b.source_id where a.edge_type = 'calls' and b.edge_type = 'calls' and a.source_id <> a.target_id", True)(
    lambda s, d: N.diseases(load(s, d))
)
_q("m_telepathy_consensus", _WS, "select lower(name) as name, count(distinct context_id) as contexts, case when count(distinct context_id) = 3 then 'universal' when 2 * count(distinct context_id) > 3 then 'majority' else 'minority' end as verdict from ws group by lower(name)")(lambda s, d: N.consensus(_ws(s, d)))
_q("m_telepathy_broadcast", _WS, "select context_id, count(*) as units, count(case when complexity > 15 then 1 end) as complex, round(count(case when unit_type = 'test' then 1 end) * 1e0 / greatest(count(case when unit_type = 'function' then 1 end), 1), 6) as test_ratio from ws group by context_id")(lambda s, d: N.broadcast_report(_ws(s, d)))
_q("m_soul_compare", ", sk as (select distinct source_id as id, edge_type from edges), sn as (select id, count(*) as n from sk group by id), sb as (select id, count(*) as c from sk where edge_type in (select edge_type from sk where id = 138) group by id), m as (select unit_type as mt, is_async as ma, complexity as mc, coalesce((select n from sn where id = 138), 0) as mn from units where id = 138)", "select u.id, round(case when unit_type = mt then 3e-1 else 0e0 end + case when is_async = ma then 1e-1 else 0e0 end + case when abs(complexity - mc) < 5 then 2e-1 else 0e0 end + case when greatest(coalesce(n, 0), mn) > 0 then 4e-1 * coalesce(c, 0) / greatest(coalesce(n, 0), mn) else 0e0 end, 6) as similarity from units u cross join m left join sn on sn.id = u.id left join sb on sb.id = u.id where u.id <> 138")(
    lambda s, d: N.soul_compare(load(s, d), 138)
)
_q("m_soul_karma", ", ob as (select source_id as id, count(*) as ob from edges where edge_type = 'breaks_with' group by source_id)", "select f.id, cast(10 * t + case when doc_summary is not null then 5 else 0 end + case when stability_score > 8e-1 then 15 else 0 end + case when complexity < 10 then 10 else 0 end - 20 * coalesce(ob, 0) - case when stability_score < 3e-1 then 15 else 0 end - case when complexity > 20 then 10 else 0 end - case when change_count > 50 then 10 else 0 end as bigint) as karma from full_u f left join ob on ob.id = f.id", True)(lambda s, d: N.karma(load(s, d)))
_q("m_soul_risk", ", ou as (select source_id as id, count(*) as c from edges group by source_id)", "select u.id, case when coalesce(c, 0) > 10 then 'high' when coalesce(c, 0) > 5 then 'medium' else 'low' end as risk from units u left join ou on ou.id = u.id")(lambda s, d: N.soul_risk(load(s, d)))
_q("m_omniscience_best", "", "select id, round(15e-2 + case when t > 0 then 3e-1 else 0e0 end + case when doc_summary is not null then 2e-1 else 0e0 end + case when stability_score > 7e-1 then 2e-1 else 0e0 end + case when complexity < 15 then 15e-2 else 0e0 end, 6) as score from full_u where contains(lower(name), 'red') order by score desc, id limit 5", True)(lambda s, d: N.best(load(s, d), "Red"))
_q("m_omniscience_census", "", "select language, unit_type, count(*) as n from units group by cube (language, unit_type)")(lambda s, d: N.census(load(s, d).units))
_v = " ".join(f"when contains(t, '{w}') then '{w}'" for w in N.RISKY)
_q("m_omniscience_vuln", f", vt as (select id, lower(concat_ws(' ', name, doc_summary)) as t from units), vw as (select id, case {_v} end as word from vt)", "select * from vw where word is not null")(lambda s, d: N.vulnerable(load(s, d).units))
_q("m_omniscience_trend", ", tr as (select language, round(avg(stability_score), 6) as stability, round(avg(change_count), 6) as changes, round(avg(complexity), 6) as complexity from units group by language)", "select *, case when stability < 5e-1 and complexity > 15 then 'declining' when stability > 7e-1 then 'stable' else 'emerging' end as verdict from tr")(lambda s, d: N.trend(load(s, d).units))
_q("m_omniscience_scorecard", ", sc as (select round(1e2 * (3e-1 * count(case when t > 0 then 1 end) / count(*) + 2e-1 * count(doc_summary) / count(*) + 3e-1 * avg(stability_score) + 2e-1 * count(case when complexity < 15 then 1 end) / count(*)), 6) as score from full_u where unit_type = 'function')", "select score, case when score >= 80 then 'A' when score >= 60 then 'B' when score >= 40 then 'C' else 'D' end as grade from sc", True)(lambda s, d: N.scorecard(load(s, d)))
_sizes = lambda s, d: load(s, d).changes.groupBy("ts").agg(F.sum("lines_added").alias("x")).selectExpr("ts", "(ts div 1000) + x as bytes")
_q("x7_projection", ", sz as (select ts, ts // 1000 + sum(lines_added) as bytes from changes group by ts), e as (select cast(arg_min(bytes, ts) as double) as b0, cast(arg_max(bytes, ts) as double) as b1, min(ts) as t0, max(ts) as t1 from sz)", "select round((b1 - b0) * 86400e0 / (t1 - t0), 6) as growth_per_day, round(b1 + (b1 - b0) * 86400e0 / (t1 - t0) * 90, 6) as projected, b1 + (b1 - b0) * 86400e0 / (t1 - t0) * 90 > 1000000 as over from e where t1 > t0 and b1 > b0")(lambda s, d: N.projection(_sizes(s, d), 90, 1_000_000))
_kw = lambda ks: " + ".join(f"case when contains(lower(name), '{k}') then 4e-1 when contains(lower(qualified_name), '{k}') then 2e-1 else 0e0 end" for k in ks)
_ty = lambda c: "('test')" if c == "testing" else "('function', 'type')"
_ex = ", xc as (" + " union all ".join(f"select '{c}' as concept, id, {_kw(ks)} + case when regexp_matches(lower(coalesce(doc_summary, '')), '{'|'.join(ks)}') then 15e-2 else 0e0 end + case when unit_type in {_ty(c)} then 1e-1 else 0e0 end as s from units" for c, ks in list(C.CONCEPTS.items())[:10]) + ")"
_q("s7_extract_concepts", _ex, "select concept, id, round(least(1e0, s), 6) as score from xc where s > 3e-1 + 1e-9")(lambda s, d: C.extract_concepts(load(s, d).units))
_suf = lambda t, e: f"(select count(*) from {t} x where lower(name) like '%{e}')"
_q("w5_suffix_patterns", _WS, " union all ".join(f"select '{e}' as pattern, {_suf(_A, e)} as n_a, {_suf(_B, e)} as n_b" for e in ("service", "controller", "repository", "handler", "factory", "test")))(lambda s, d: W.suffix_patterns(*_ab(s, d)))
_q("w5_concepts", _ex + ", fx as (select concept, id from xc where s > 3e-1 + 1e-9), cp as (select concept, count(case when u.language <> 'Rust' then 1 end) as n_a, count(case when u.language <> 'Python' and u.id % 4 <> 1 then 1 end) as n_b from fx join units u on u.id = fx.id group by concept)", "select * from cp where n_a <> n_b")(lambda s, d: W.concept_differences(*(C.extract_concepts(x) for x in _ab(s, d))))
_q("m_omniscience_api_usage", "", "select u.id, count(distinct e.source_id) as callers, count(distinct v.file_path) as files from units u left join edges e on e.target_id = u.id and e.edge_type = 'calls' left join units v on v.id = e.source_id where contains(lower(u.name), 'red') group by u.id")(lambda s, d: N.api_usage(load(s, d), "red"))
_q("m_omniscience_solve", ", sv as (select id, round((cast(contains(t, 'deprecated') as int) + cast(contains(t, 'cache') as int) + cast(contains(t, 'tin') as int)) / 3e0, 6) as relevance from (select id, lower(concat_ws(' ', name, doc_summary)) as t from units) x)", "select * from sv where relevance > 0")(lambda s, d: N.solve(load(s, d).units, "deprecated tin cache"))
_q("m_soul_extract", "", "select id, concat_ws(',', case when t > 0 then 'tested' end, case when doc_summary is not null then 'documented' end, case when stability_score > 8e-1 then 'stable' end, case when complexity < 10 then 'simple' end, case when is_async then 'asynchronous' end) as traits from full_u", True)(lambda s, d: N.soul(load(s, d)))
_log_of = lambda s, d: s.read.parquet(f"{d}/events.parquet").selectExpr("cast(user_id as string) as session", "case event_type when 'purchase' then 'end' else event_type end as operation", "unix_timestamp(cast(ts as timestamp)) as at")
_LOG = "with lg as (select cast(user_id as varchar) as session, case event_type when 'purchase' then 'end' else event_type end as operation, cast(floor(epoch(ts)) as bigint) as \"at\" from events)"
query("m_sessions", _LOG + " select session, started, last, operations, ended is null or ended < last as is_open from (select session, min(\"at\") as started, max(\"at\") as last, count(*) as operations, max(case when operation = 'end' then \"at\" end) as ended from lg group by session) x")(lambda s, d: N.sessions(_log_of(s, d)))
query("m_session_resume", _LOG + " select operation, \"at\" from lg where session = '7' order by \"at\" desc, operation limit 20")(lambda s, d: N.resume(_log_of(s, d), "7"))
_kn = "t + cast(doc_summary is not null as int) + cast(signature is not null as int)"
_q("m_resurrect_attempt", ", i as (select count(*) as c from edges where target_id = 138), o as (select count(*) as c from edges where source_id = 138)", f"select id, o.c as uses, i.c as used_by, {_kn} as evidence, case when {_kn} > 5 then 'high' when {_kn} > 2 then 'medium' else 'low' end as confidence from full_u, i, o where id = 138", True)(lambda s, d: N.attempt(load(s, d), 138))
_q("m_resurrect_verify", "", "select count(*) > 0 as found, coalesce(bool_or(id in (select target_id from edges)), false) as referenced, coalesce(bool_or(t > 0), false) as tested from full_u where name = 'red_plate'", True)(lambda s, d: N.verify(load(s, d), "red_plate"))
_tr = "concat_ws(',', case when t > 0 then 'tested' end, case when doc_summary is not null then 'documented' end, case when stability_score > 8e-1 then 'stable' end, case when complexity < 10 then 'simple' end, case when is_async then 'asynchronous' end)"
_q("m_soul_preserve", "", f"select id, cast(to_json({{'name': name, 'unit_type': unit_type, 'language': language, 'traits': {_tr}}}) as varchar) as soul from full_u", True)(lambda s, d: N.preserve(load(s, d)))
_q("m_soul_reincarnate", "", "select id, name, 'Go' as language, case when language = 'Go' then 'none' when t > 0 then 'low' else 'high' end as effort from full_u", True)(lambda s, d: N.reincarnate(N.preserve(load(s, d)), "Go"))
_q("m_telepathy_connect", _WS, "select context_id, role, count(*) as units, count(distinct language) as languages from ws group by context_id, role")(lambda s, d: W.connect(_ws(s, d)))
_q("m_telepathy_listen", _WS, "select context_id, count(*) as hits, count(case when unit_type = 'function' then 1 end) as functions, count(case when unit_type = 'test' then 1 end) as tests from ws where contains(lower(name), 'token') or contains(lower(coalesce(doc_summary, '')), 'token') group by context_id")(lambda s, d: W.listen(_ws(s, d), "Token"))
_q("m_omniscience_search", _WS, "select context_id, id, name from ws where contains(lower(name), 'anvil')")(lambda s, d: W.find(_ws(s, d), "anvil"))
_q("m_omniscience_compare", _WS, "select context_id, count(*) as n, round(avg(complexity), 6) as complexity, round(count(doc_summary) * 1e0 / count(*), 6) as documented from ws where contains(lower(name), 'red') group by context_id")(lambda s, d: W.contrast(_ws(s, d), "red"))
