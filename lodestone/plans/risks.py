"""Risk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import DEPS
from lodestone.graph import WITH, load
from lodestone.operators import risk as R
from lodestone.operators.structure import dead_code
from lodestone.plans.structures import _at, _roots, paths, reach
from lodestone.registry import query

UNIT, TARGET = 138, 169
_deps = ", ".join(f"'{d}'" for d in DEPS)
_types = ", ".join(f"'{d}'" for d in R.IMPACT_TYPES)
DEG = """, tst as (select target_id as id, count(*) as t from edges where edge_type = 'tests' group by target_id),
cpl as (select id, count(*) as k from (select source_id as id from edges where edge_type = 'couples_with' union all select target_id from edges where edge_type = 'couples_with') x group by id),
deg as (select id, count(*) as n from (select source_id as id from edges union all select target_id from edges) x group by id),
brk as (select id, count(*) as b from (select source_id as id from edges where edge_type = 'breaks_with' union all select target_id from edges where edge_type = 'breaks_with') x group by id),
full_u as (select u.*, coalesce(t, 0) as t, coalesce(k, 0) as k, coalesce(deg.n, 0) as n, coalesce(b, 0) as b from units u left join tst on tst.id = u.id left join cpl on cpl.id = u.id left join deg on deg.id = u.id left join brk on brk.id = u.id)"""


def _q(name: str, ctes: str, sql: str):
    return query(name, f"{WITH}{DEG}{ctes} {sql}")


_imp = reach(_at(TARGET), 3, _deps, "backward") + ", imp as (select r.id, depth, t > 0 as has_tests, round(least(1e0, 4e-1 / (1 + depth) + case when t > 0 then 2e-1 else 6e-1 end + least(3e-1, 5e-2 * k)), 6) as risk from r join full_u f on f.id = r.id where depth > 0)"
_q("q9_impact_analysis", _imp, "select * from imp")(lambda s, d: R.impact(load(s, d), TARGET, 3))
_sum = "select count(*) as impacted, count(case when not has_tests then 1 end) as untested, round(least(1e0, coalesce(avg(risk), 0e0)), 6) as overall_risk from imp"
_q("q9_impact_summary", _imp, f"select *, concat_ws('; ', case when untested > 0 then 'add tests' end, case when impacted > 10 then 'split the change' end, case when overall_risk > 7e-1 then 'review with care' end) as recommendations from ({_sum}) x")(lambda s, d: R.impact_summary(R.impact(load(s, d), TARGET, 3)))
_q("x6_gate", _imp, f"select overall_risk <= 6e-1 and untested = 0 as passed, overall_risk, untested from ({_sum}) x")(lambda s, d: R.gate(R.impact(load(s, d), TARGET, 3)))
_q("q10_test_coverage", f", dir as (select distinct source_id as t from edges where edge_type = 'tests' and target_id = {TARGET}), ind as (select distinct source_id as t from edges where edge_type = 'tests' and target_id in (select source_id from edges where edge_type = 'calls' and target_id = {TARGET}) and source_id not in (select t from dir)), c as (select (select count(*) from dir) as direct, (select count(*) from ind) as indirect)", "select direct, indirect, case when direct + indirect > 0 then round((direct + 5e-1 * indirect) / (direct + 5e-1 * indirect + 1), 6) else 0e0 end as ratio from c")(
    lambda s, d: R.test_coverage(load(s, d), TARGET)
)
_q("q13_temporal_evolution", "", "select id, change_count, stability_score, case when stability_score > 8e-1 then 'Stable' when stability_score > 5e-1 then 'Moderate' when stability_score > 2e-1 then 'Volatile' else 'Highly volatile' end as trend from units")(
    lambda s, d: load(s, d).units.select("id", "change_count", "stability_score", R.trend(F.col("stability_score")).alias("trend"))
)
_f = ", fac as (select id, 1 / (1 + 1e-1 * change_count) as a, least(1e0, 3e-1 * t) as b, 1 / (1 + 5e-2 * complexity) as c, 1 / (1 + 2e-1 * k) as d from full_u), o as (select *, round(3e-1 * a + 25e-2 * b + 25e-2 * c + 2e-1 * d, 6) as overall from fac)"
_q("q14_stability_analysis", _f, "select id, round(a, 6) as change_factor, round(b, 6) as test_factor, round(c, 6) as complexity_factor, round(d, 6) as coupling_factor, overall, case when overall > 7e-1 then 'stable' when overall > 4e-1 then 'watch' else 'unstable' end as advice from o")(lambda s, d: R.stability(load(s, d)))
_rows = f"select source_id as unit_at, source_id as s, target_id as t, weight as w, 0 as k from edges where weight LIMIT_ and edge_type in ({_deps}) union all select source_id, source_id, target_id, weight, 1 from edges where weight LIMIT_ and edge_type = 'couples_with' union all select target_id, source_id, target_id, weight, 2 from edges where weight LIMIT_ and edge_type = 'couples_with'"
_pick = "select unit_a, unit_b, round(w, 6) as strength, case k when 0 then 'explicit' when 3 then 'hidden' else 'temporal' end as kind from (select least(s, t) as unit_a, greatest(s, t) as unit_b, w, k, row_number() over (partition by least(s, t), greatest(s, t) order by unit_at, k, w desc) as n from rws) x where n = 1"
_q("q15_coupling_all", f", rws as ({_rows.replace('LIMIT_', '>= 3e-1')})", _pick)(lambda s, d: R.couplings(load(s, d), 0.3))
_q("q15_coupling_unit", f", tg as (select distinct source_id as s, target_id as t from edges where edge_type in ({_deps})), sz as (select s, count(*) as n from tg group by s), sh as (select s, count(*) as c from tg where s <> {UNIT} and t in (select t from tg where s = {UNIT}) group by s), rws as (select * from ({_rows.replace('LIMIT_', '>= 5e-2')}) y where unit_at = {UNIT} union all select {UNIT}, {UNIT}, sh.s, c * 1e0 / (sz.n + (select n from sz where s = {UNIT}) - c), 3 from sh join sz on sz.s = sh.s where c * 1e0 / (sz.n + (select n from sz where s = {UNIT}) - c) >= 5e-2)", _pick)(
    lambda s, d: R.couplings(load(s, d), 0.05, UNIT)
)
_pr = """, pr as (select id, round(least(1e0, case when stability_score < 3e-1 then 4e-1 when stability_score < 6e-1 then 2e-1 else 0e0 end + case when complexity > 20 then 3e-1 when complexity > 10 then 15e-2 else 0e0 end
 + case when change_count > 50 then 2e-1 when change_count > 20 then 1e-1 else 0e0 end + 2e-1 * least(b, 3) / 3 + case when unit_type = 'function' and t = 0 then 1e-1 else 0e0 end), 6) as risk,
 concat_ws('; ', case when stability_score < 3e-1 then 'very low stability' end, case when stability_score >= 3e-1 and stability_score < 6e-1 then 'low stability' end, case when complexity > 20 then 'very complex' end, case when complexity > 10 and complexity <= 20 then 'complex' end,
 case when change_count > 20 then 'changed often' end, case when b > 0 then 'breaks with others' end, case when unit_type = 'function' and t = 0 then 'no tests' end) as reasons from full_u)"""
_q("q17_prophecy", _pr, "select * from pr where risk >= 5e-1 order by risk desc, id limit 20")(lambda s, d: R.prophecy(load(s, d), 20, 0.5))
_q("q17_prophecy_all", _pr, "select * from pr where risk >= 3e-1")(lambda s, d: R.prophecy(load(s, d), 0, 0.3))
_q("q19_migration_path", f", dp as (select distinct source_id as id from edges where target_id = {TARGET} and edge_type in ('calls', 'imports', 'uses_type', 'inherits', 'implements') and source_id <> {TARGET}), al as (select cast({UNIT} as bigint) as id, -1 as r, 'safe' as safety union all select {TARGET}, 9, 'caution' union all select id, case when id in (select id from tst) then 0 when id in (select target_id from edges where edge_type = 'calls' and source_id in (select id from tst)) then 1 else 2 end, null from dp)", "select cast(row_number() over (order by r, id) - 1 as integer) as step, id, coalesce(safety, case r when 0 then 'safe' when 1 then 'caution' else 'risky' end) as safety, case r when -1 then 'bring in the new unit' when 9 then 'take out the old unit' when 0 then 'switch, its tests tell' when 1 then 'switch, tests of a caller tell' else 'switch, and add tests' end as description from al")(
    lambda s, d: R.migration(load(s, d), TARGET, UNIT)
)
_gap = "select id, round(least(1e0, 5e-1 * least(2e0, change_count / 2e1) + 5e-1 * least(2e0, complexity / 1e1)), 6) as priority from full_u where unit_type = 'function' and t = 0 and (change_count >= 20 or complexity >= 10)"
_q("q20_test_gap", "", _gap)(lambda s, d: R.test_gap(load(s, d), 20, 10))
_hot = ", hs as (select id, name, least(1e0, change_count / 5e1) as ch, 1 - stability_score as ins, least(1e0, complexity / 3e1) as cx, least(1e0, n / 2e1) as cp from full_u), hot as (select id, name, round(35e-2 * ch + 25e-2 * ins + 25e-2 * cx + 15e-2 * cp, 6) as score, round(ch, 6) as change, round(ins, 6) as instability, round(cx, 6) as complexity, round(cp, 6) as coupling from hs)"
_q("q24_hotspot_detection", _hot, "select * from hot where score >= 3e-1 order by score desc, id limit 50")(lambda s, d: R.hotspots(load(s, d), 50, 0.3))
_q("q24_hotspots_all", _hot, "select * from hot where score >= 2e-1")(lambda s, d: R.hotspots(load(s, d), 0, 0.2))
_PROB = {"deletion": "95e-2", "signature": "85e-2", "rename": "8e-1", "behavior": "5e-1", "move": "4e-1"}
_KIND = {"deletion": "case when depth = 1 then 'will_break' else 'might_break' end", "signature": "case when depth = 1 then 'will_break' else 'needs_review' end", "behavior": "case when t > 0 then 'needs_review' else 'might_break' end", "move": "case when depth = 1 then 'might_break' else 'safe' end"}
_KIND["rename"] = _KIND["signature"]
for _k in _PROB:
    _chg = reach(_at(TARGET), 3, _types, "backward") + f", chg as (select r.id, depth, {_KIND[_k]} as impact, round({_PROB[_k]} / (1 + 5e-1 * depth), 6) as probability from r join full_u f on f.id = r.id where depth > 0)"
    _q(f"e1_change_{_k}", _chg, "select * from chg")(lambda s, d, k=_k: R.analyze_change(load(s, d), TARGET, k, 3))
    if _k == "signature":
        _rad = ", rad as (select count(distinct file_path) as files, count(case when unit_type = 'function' then 1 end) as functions, count(distinct case when contains(qualified_name, '::') then regexp_extract(qualified_name, '^(.*)::', 1) end) as modules, cast(coalesce(sum(greatest(end_line - start_line, 1)), 0) as bigint) as lines, count(case when unit_type = 'test' then 1 end) as tests, count(*) as total, count(case when impact = 'will_break' then 1 end) as will_break from chg join units on units.id = chg.id)"
        _q("e2_blast_radius", _chg + _rad, "select *, case when will_break > 10 or files > 20 then 'critical' when will_break > 3 or files > 10 or total > 30 then 'high' when will_break > 0 or total > 10 then 'medium' else 'low' end as risk_level from rad")(lambda s, d: R.blast_radius(load(s, d), R.analyze_change(load(s, d), TARGET, "signature", 3)))


_mit = "select * from (select 'keep the old signature as a wrapper' as description, 'low' as effort, 7e-1 as reduction union all select 'deprecate the old signature for a while', 'medium', 9e-1 union all select 'release step by step behind a flag', 'medium', 6e-1 from rad where will_break > 3 or files > 10 or total > 30 union all select 'add tests before the change', 'medium', 4e-1 from rad where tests = 0) x"
_sig = reach(_at(TARGET), 3, _types, "backward") + f", chg as (select r.id, depth, {_KIND['signature']} as impact, round({_PROB['signature']} / (1 + 5e-1 * depth), 6) as probability from r join full_u f on f.id = r.id where depth > 0)" + _rad
_q("e4_mitigations", _sig, _mit)(lambda s, d: R.mitigations("signature", R.blast_radius(load(s, d), R.analyze_change(load(s, d), TARGET, "signature", 3))))
_q("e1a_impact_path", paths(TARGET, 3, _types, "backward"), "select id, depth, array_to_string(path, ',') as path from p where depth > 0")(lambda s, d: R.impact_paths(load(s, d), TARGET, 3).select("id", "depth", F.array_join("path", ",").alias("path")))
_beh = paths(TARGET, 2, _types, "backward") + f", chg as (select p.id, depth, {_KIND['behavior']} as impact, round({_PROB['behavior']} / (1 + 5e-1 * depth), 6) as probability, path from p join full_u f on f.id = p.id where depth > 0)" + _rad
_level = "case when will_break > 10 or files > 20 then 'critical' when will_break > 3 or files > 10 or total > 30 then 'high' when will_break > 0 or total > 10 then 'medium' else 'low' end"


@_q(
    "e4_impact_json", _beh,
    f"select cast(to_json({{'nodes': (select list({{'id': id, 'name': name, 'type': t, 'distance': x, 'probability': p}} order by id) from (select id, name, 'change_target' as t, 0 as x, cast(1 as double) as p from units where id = {TARGET} union all select chg.id, name, impact, depth, cast(probability as double) from chg join units on units.id = chg.id) n), 'edges': (select list({{'from': path[-2], 'to': id}} order by path[-2], id) from chg), 'blast_radius': {{'files': files, 'functions': functions, 'modules': modules, 'tests': tests}}, 'risk_level': {_level}}}) as varchar) as json from rad",
)
def e4_impact_json(spark, sf_dir):
    g = load(spark, sf_dir)
    hit = R.analyze_change(g, TARGET, "behavior", 2)
    return R.as_json(g, TARGET, hit, R.blast_radius(g, hit), R.impact_paths(g, TARGET, 2))


_reg = reach(_at(TARGET), 4, "'calls', 'imports', 'tests', 'references', 'uses_type'", "backward") + f", reg as (select u.id, case when d.id is not null then 'likely' when 6e-1 / (1 + 3e-1 * depth) > 3e-1 then 'recommended' else 'skip' end as verdict, round(case when d.id is not null then 85e-2 when 6e-1 / (1 + 3e-1 * depth) > 3e-1 then 6e-1 / (1 + 3e-1 * depth) else 0e0 end, 6) as probability from units u left join (select distinct source_id as id from edges where edge_type = 'tests' and target_id = {TARGET}) d on d.id = u.id left join r on r.id = u.id where u.unit_type = 'test')"
_q("e5_regression", _reg, "select *, verdict = 'likely' or probability > 4e-1 as minimal from reg")(lambda s, d: R.regression(load(s, d), TARGET, 4))
_q("e6_minimal_test_set", _reg, "select id from reg where verdict = 'likely' or probability > 4e-1")(lambda s, d: R.regression(load(s, d), TARGET, 4).where("minimal").select("id"))
_q("x5_health", _pr + _hot + reach(_roots, None, "", "forward", "df") + reach(_roots, None, "", "backward", "db") + f", gp as ({_gap.replace('2e1', '5e0').replace('>= 20', '>= 5')}), h as (select (select count(*) from pr where risk >= 45e-2) as risks, (select count(*) from pr where risk >= 7e-1) as high_risks, (select count(*) from gp) as gaps, (select count(*) from hot where score >= 55e-2) as hotspots, (select count(*) from units where id not in (select id from df) and id not in (select id from db)) as dead)", "select *, case when high_risks >= 3 or gaps >= 8 then 'fail' when risks + gaps + hotspots + dead > 0 then 'warn' else 'pass' end as status from h")(
    lambda s, d: R.health(load(s, d), dead_code(load(s, d)))
)
