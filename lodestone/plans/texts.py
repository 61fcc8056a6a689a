"""Pattern, rule, concept, architecture and grounding queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import DEPS, complexity_bucket, looks_like_credentials
from lodestone.graph import WITH, Graph, load
from lodestone.operators import concepts as C
from lodestone.operators import grounding as R
from lodestone.registry import query

_deps = ", ".join(f"'{d}'" for d in DEPS)


def _q(name: str, ctes: str, sql: str):
    return query(name, f"{WITH}{ctes} {sql}")


_q("q7_async_function", "", "select id, name from units where unit_type = 'function' and is_async and complexity > 20")(lambda s, d: C.match_pattern(load(s, d), "async function { complexity: >20 }"))
_q("q7_complex_function", "", "select id, name from units where unit_type = 'function' and complexity > 40")(lambda s, d: C.match_pattern(load(s, d), "function { complexity: >40 }"))
_q("q7_heirs", "", "select id, name from units where unit_type = 'type' and id in (select source_id from edges where edge_type = 'inherits' and target_id in (select id from units where name = 'Supplier2'))")(lambda s, d: C.match_pattern(load(s, d), "class { inherits: Supplier2 }"))


def _two_callees(s, d):
    return C.match_pattern(load(s, d), "function { calls: [blue_gear, red_plate] }")


_q("q7_calls_all", ", cn as (select source_id, count(distinct name) as k from edges join units on units.id = target_id where edge_type = 'calls' and name in ('blue_gear', 'red_plate') group by source_id)", "select id, name from units where unit_type = 'function' and id in (select source_id from cn where k = 2)")(_two_callees)
_rules = [("layer", "brand1", "brand2"), ("boundary", "supplier"), ("naming", "customer::", "test_*"), ("naming", "brand1", "*_red"), ("cyclic", "brand1")]
_dr = f", de as (select source_id, target_id, a.qualified_name as s, b.qualified_name as t from edges join units a on a.id = source_id join units b on b.id = target_id where edge_type in ({_deps})), ins as (select distinct source_id as s, target_id as t from de where s like 'brand1%' and t like 'brand1%' and source_id <> target_id), cw as (select s, t from ins union select cw.s, ins.t from cw join ins on cw.t = ins.s), cy as (select distinct s from cw where s = t), vio as (select 0 as rule, source_id, target_id from de where s like 'brand2%' and t like 'brand1%' union all select 1, source_id, target_id from de where s like 'supplier%' and t not like 'supplier%' union all select 2, id, null from units where qualified_name like 'customer::%' and lower(name) not like 'test\\_%' escape '\\' union all select 3, id, null from units where qualified_name like 'brand1%' and lower(name) not like '%\\_red' escape '\\' union all select 4, id, null from (select a.t as id from (select s, t from cw union select s, s from cy) a join cy x on a.s = x.s intersect select b.s from (select s, t from cw union select s, s from cy) b join cy y on b.t = y.s) z)"
_q("q21_architectural_drift", _dr, "select * from vio")(lambda s, d: C.drift(load(s, d), _rules))
_q("q21_conformance", _dr, "select round(1 - count(distinct rule) / 5e0, 6) as conformance, count(*) as violations from vio")(lambda s, d: C.conformance(C.drift(load(s, d), _rules), 5))
_q("q12_collective_patterns", "", "select id, collective_usage as usage, round(case when collective_usage > 0 then least(1e0, ln(collective_usage)) else 0e0 end, 6) as confidence from units where unit_type = 'function' and collective_usage >= 1")(lambda s, d: C.popular(load(s, d).units, 1, "function"))
_q("q18_concept_mapping", "", "select id, case when unit_type in ('type', 'trait', 'module') then 'definition' when unit_type = 'test' then 'test' when unit_type = 'impl' then 'extension' when id in (select source_id from edges where edge_type = 'inherits' and target_id in (select id from units where contains(lower(name), 'supplier1'))) then 'extension' else 'usage' end as role, round(case when lower(name) = 'supplier1' then 1e0 else least(1e0, case when contains(lower(name), 'supplier1') or contains(lower(qualified_name), 'supplier1') then 7e-1 else 0e0 end + case when contains(lower(coalesce(doc_summary, '')), 'supplier1') then 3e-1 else 0e0 end) end, 6) as relevance from units where contains(lower(name), 'supplier1') or contains(lower(qualified_name), 'supplier1') or contains(lower(coalesce(doc_summary, '')), 'supplier1')")(
    lambda s, d: C.map_concept(load(s, d), "Supplier1")
)
_hits = lambda k: " + ".join(f"case when contains(lower({c}), '{k}') then {w} else 0e0 end" for c, w in (("name", "4e-1"), ("qualified_name", "2e-1"), ("coalesce(doc_summary, '')", "15e-2")))
_cons = ", con as (" + " union all ".join(f"select '{c}' as concept, id, {' + '.join(map(_hits, ks))} + case when unit_type in ('function', 'type') then 5e-2 else 0e0 end as score from units" for c, ks in C.CONCEPTS.items()) + "), fnd as (select concept, id, round(least(1e0, score), 6) as strength from con where score >= 3e-1 - 1e-9)"
_q("s8_concepts", _cons, "select * from fnd")(lambda s, d: C.concepts(load(s, d).units))
_q("s8_find_concept", _cons, "select * from fnd where concept = 'testing'")(lambda s, d: C.concepts(load(s, d).units, "testing"))
_q("s8_explain_concepts", _cons, "select concept, count(*) as units, round(least(1e0, 6e-1 * max(strength) + least(4e-1, 1e-1 * count(*))), 6) as confidence from fnd group by concept")(lambda s, d: C.explain_concepts(C.concepts(load(s, d).units)))
_q("i7_ask", ", qs as (select id, unit_type, lower(name) as n, lower(qualified_name) as q from units), sc as (select id, case when n = 'supplier7' then 5e-1 when contains(n, 'supplier7') then 3e-1 when contains(q, 'supplier7') then 15e-2 else 0e0 end + case when n = 'red' then 5e-1 when contains(n, 'red') then 3e-1 when contains(q, 'red') then 15e-2 else 0e0 end + case when unit_type = 'function' then 15e-2 else 0e0 end as s, concat_ws('; ', case when n = 'supplier7' then 'exact name match ''supplier7''' when contains(n, 'supplier7') then 'name contains ''supplier7''' when contains(q, 'supplier7') then 'qualified name contains ''supplier7''' end, case when n = 'red' then 'exact name match ''red''' when contains(n, 'red') then 'name contains ''red''' when contains(q, 'red') then 'qualified name contains ''red''' end) as w from qs)", "select id, round(least(1e0, s), 6) as relevance, case when w = '' then 'intent match: function' else w end as explanation from sc where s > 1e-1")(
    lambda s, d: C.ask(load(s, d).units, "find the function supplier7 and red")
)
_q("i9_explain_match", "", "select id, case when contains(lower(name), 'supplier7') then 'name contains ''supplier7''' else 'exact' end as explanation from units where id = 30000071")(lambda s, d: C.ask(load(s, d).units.where("id = 30000071"), "supplier7").select("id", "explanation"))
_cases = " ".join(f"when regexp_matches(t, '{p}') then '{r}'" for r, p in C.ROLES)
#: Brands as parts of an architecture: their number decides which folder their files are in.
SHAPES = {"layered": ("controller", "service", "repository", "model"), "mvc": ("controller", "model"), "hexagonal": ("service", "repository"), "plain": ("core",), "mixed": ("controller", "service", "settings")}
_number = "cast(substr(split_part(qualified_name, '::', 1), 6) as int)"


def _folder(shape: str) -> str:
    parts = SHAPES[shape]
    return f"case when qualified_name like 'brand%' then 'src/' || case {_number} % {len(parts)} " + " ".join(f"when {k} then '{p}'" for k, p in enumerate(parts)) + " end || '/' || name else 'lib/' || name end"


def _shaped(s, d, shape):
    g = load(s, d)
    return Graph(g.units.withColumn("file_path", F.expr(_folder(shape))), g.edges, g.changes)


def _rol(shape: str = "", n: str = "") -> str:
    path = _folder(shape) if shape else "file_path"
    return f", tx{n} as (select id, unit_type, lower(name || ' ' || qualified_name || ' ' || {path}) as t from units), rol{n} as (select id, case {_cases} when unit_type = 'test' then 'test' when regexp_matches(t, '{C.ENTRY}') then 'entrypoint' else 'utility' end as role from tx{n}), cnt{n} as (select role, count(*) as n from rol{n} group by role)"


def _infer(n: str) -> str:
    has = ", ".join(f"coalesce(bool_or(role = '{r}'), false) as {r[0]}" for r in ("controller", "service", "repository", "model"))
    return f", hs{n} as (select {has}, sum(n) as n, coalesce(sum(case when role <> 'utility' then n end), 0) as k, count(distinct case when role not in ('utility', 'test') then role end) as kinds from cnt{n}), inf{n} as (select case when c and m and not r then 'mvc' when c and s and r then 'layered' when s and r and not c then 'hexagonal' when kinds <= 2 then 'monolith' else 'unknown' end as pattern, cast(c as int) + cast(s as int) + cast(r as int) as layers, round(least(1e0, 7e-1 * k / n + least(3e-1, 1e-1 * (cast(c as int) + cast(s as int) + cast(r as int)))), 6) as confidence from hs{n})"


_flows = "select a.role as from_role, b.role as to_role, count(*) as calls from edges join rol a on a.id = source_id join rol b on b.id = target_id where edge_type = 'calls' and a.role <> b.role group by a.role, b.role"
_wrong = "select source_id, target_id from edges join rol a on a.id = source_id join rol b on b.id = target_id where edge_type = 'calls' and a.role = 'repository' and b.role = 'controller'"
_q("s9_roles", _rol(), "select * from rol")(lambda s, d: C.roles(load(s, d).units))
_q("s9_role_counts", _rol(), "select * from cnt")(lambda s, d: C.architecture(load(s, d))[0])
_q("s9_flows", _rol("layered"), _flows)(lambda s, d: C.architecture(_shaped(s, d, "layered"))[1])
_q("s9_anomalies", _rol("layered"), _wrong)(lambda s, d: C.architecture(_shaped(s, d, "layered"))[2])
_q("s9_infer", "".join(_rol(x, f"_{x}") + _infer(f"_{x}") for x in SHAPES), " union all ".join(f"select '{x}' as shape, * from inf_{x}" for x in SHAPES))(
    lambda s, d: reduce(DataFrame.unionAll, (C.infer_architecture(C.architecture(_shaped(s, d, x))[0]).select(F.lit(x).alias("shape"), "pattern", "layers", "confidence") for x in SHAPES))
)
_q("s9_validate", _rol("layered") + _infer(""), f"select 'layer' as kind, source_id, target_id, null as expected, null as actual from ({_wrong}) x union all select 'pattern', null, null, 'mvc', pattern from inf where pattern <> 'mvc'")(lambda s, d: C.validate_architecture(_shaped(s, d, "layered"), "mvc"))
_q("s9_diagram", _rol("layered") + _infer(""), f"select cast(to_json({{'pattern': pattern, 'layers': layers, 'components': (select list({{'role': role, 'size': n}} order by role) from cnt), 'flows': (select list({{'from': from_role, 'to': to_role, 'calls': calls}} order by from_role, to_role) from ({_flows}) f)}}) as varchar) as json from inf")(lambda s, d: C.diagram(_shaped(s, d, "layered")))
_q("s10_naming", ", pt as (select split_part(name, '_', 1) || '_*' as pattern from units where contains(name, '_') and length(split_part(name, '_', 1)) >= 3 union all select '*_' || split_part(name, '_', -1) from units where contains(name, '_') and length(split_part(name, '_', -1)) >= 4)", "select pattern, count(*) as n, round(least(95e-2, 15e-2 * count(*)), 6) as confidence from pt group by pattern having count(*) >= 3")(lambda s, d: C.naming_patterns(load(s, d).units))
_q("s10_directories", ", dt as (select regexp_extract(file_path, '^(.*)/', 1) as directory, unit_type, count(*) as k from units group by 1, 2), da as (select directory, cast(sum(k) as bigint) as n, max(k) as m from dt group by directory)", "select da.directory, (select max(unit_type) from dt where dt.directory = da.directory and k = m) as unit_type, n, round(least(9e-1, m * 1e0 / n), 6) as share from da where n >= 3 and m * 1e0 / n > 7e-1")(lambda s, d: C.directory_patterns(load(s, d).units))
_inst = ", nam as (select split_part(name, '_', 1) || '_*' as pattern, id, file_path from units where contains(name, '_') and length(split_part(name, '_', 1)) >= 3 union all select '*_' || split_part(name, '_', -1), id, file_path from units where contains(name, '_') and length(split_part(name, '_', -1)) >= 4), dt as (select regexp_extract(file_path, '^(.*)/', 1) as directory, unit_type, count(*) as k from units group by 1, 2), da as (select directory, sum(k) as n, max({'k': k, 't': unit_type}) as top from dt group by directory), ins as (select * from nam where pattern in (select pattern from nam group by pattern having count(*) >= 3) union all select 'dir:' || directory || ':' || unit_type, id, directory from units join da on directory = regexp_extract(file_path, '^(.*)/', 1) and unit_type = top.t where n >= 3 and top.k * 1e0 / n > 7e-1 and directory <> '')"
_q("s10_check", _inst, "select distinct pattern from ins, (select regexp_extract(file_path, '^(.*)/', 1) as d from units where id = 138) a where starts_with(file_path, d) and pattern not in (select pattern from ins where id = 138)")(lambda s, d: C.check_patterns(load(s, d).units, 138))
_q("s10_suggest", _inst, "select pattern, count(*) as n from ins where starts_with(file_path, 'src/brand7') group by pattern")(lambda s, d: C.suggest_patterns(load(s, d).units, "src/brand7/fresh.py"))
#: Units with members of types: customary names of methods, by id.
_MEMBERS = ("id", "unit_type", "case when unit_type = 'function' then case id % 11 when 0 then 'get_instance' when 1 then 'new' when 2 then 'find_one' when 3 then 'save_all' when 4 then 'delete_it' when 5 then 'log_decorator' when 6 then 'call_wrapper' when 7 then 'create_' || name else name end when unit_type = 'type' and id % 2 = 0 then name || 'Repository' else name end as name", "case when unit_type = 'function' then 'supplier::Supplier' || cast(id % 12 + 1 as string) || case when (id % 12 + 30000001) % 2 = 0 then 'Repository' else '' end || '::m' else qualified_name || case when unit_type = 'type' and id % 2 = 0 then 'Repository' else '' end end as qualified_name", "case when id % 3 = 0 then 'private' else 'public' end as visibility")
_mem = "select " + ", ".join(_MEMBERS).replace("as string)", "as varchar)") + " from units"
_dp = f", mu as ({_mem}), fn as (select id, lower(name) as n, visibility, regexp_extract(lower(qualified_name), '^(.*)::', 1) as o from mu where unit_type = 'function'), ty as (select id, lower(name) as n, lower(qualified_name) as o from mu where unit_type = 'type')"
_q(
    "s6_design_patterns", _dp,
    "select 'factory' as pattern, id, case when contains(n, 'factory') then 9e-1 else 5e-1 end as score from fn where regexp_matches(n, '^(create|make|build|new)_') or contains(n, 'factory') union all select 'decorator', id, case when contains(n, 'decorator') then 8e-1 else 5e-1 end from fn where contains(n, 'decorator') or contains(n, 'wrapper')"
    " union all select 'repository', ty.id, case when c >= 3 then 9e-1 when c >= 1 then 6e-1 else 4e-1 end from ty left join (select o, count(*) as c from fn where regexp_matches(n, '^(get|find|create|save|update|delete|insert)') group by o) x on x.o = ty.o where contains(ty.n, 'repo')"
    " union all select 'singleton', ty.id, (x.i + x.c) / 2e0 from ty join (select o, max(case when contains(n, 'instance') or contains(n, 'shared') or n = 'default' then 1 else 0 end) as i, max(case when n in ('__init__', 'new', 'constructor') and visibility = 'private' then 1 else 0 end) as c from fn group by o) x on x.o = ty.o where x.i + x.c > 0",
)(lambda s, d: C.design_patterns(Graph(load(s, d).units.selectExpr(*_MEMBERS), load(s, d).edges, load(s, d).changes)))
_q("c2_shareable", "", "select id from units where doc_summary is not null and not regexp_matches(lower(doc_summary), 'password|passwd|secret|api_key|apikey|token|credential|private_key|auth|bearer|access_key')")(lambda s, d: load(s, d).units.where(F.col("doc_summary").isNotNull() & ~looks_like_credentials(F.col("doc_summary"))).select("id"))
_q("c3_complexity_buckets", "", "select case when complexity <= 5 then 'low' when complexity <= 15 then 'medium' when complexity <= 30 then 'high' else 'very_high' end as bucket, count(*) as n from units group by 1")(lambda s, d: load(s, d).units.groupBy(complexity_bucket(F.col("complexity")).alias("bucket")).agg(F.count("*").alias("n")))

#: Claims about all units: a right name, one in another case, wrong ones, a wrong place, none.
CLAIMS = "select id as claim_id, case id % 5 when 0 then 'The function `' || name || '` calls ' || name || '_x.' when 1 then 'We see ' || name || ' here. And nothing_like_this with ' || name || ' in src/none/a.py too.' when 2 then 'No names at all, and `the` is none.' when 3 then 'It is `' || upper(name) || '`' else 'Use Supplier' || cast(id % 90 + 1 as string) || ' or `Suplier' || cast(id % 90 + 1 as string) || '`\nThen HTTPServer, HTTP and MAX_SIZE, see `' || qualified_name || '`' end as text from units"
_CL = CLAIMS.replace("as string)", "as varchar)").replace("\n", "' || chr(10) || '")
_text = CLAIMS[CLAIMS.index("case id") : CLAIMS.index(" as text")].replace("\n", "' || char(10) || '")
_claims = lambda s, d: load(s, d).units.selectExpr("id as claim_id", f"{_text} as text")
_live = lambda s, d: load(s, d).units.withColumn("name", F.expr("case when id % 3 = 0 then name || '2' else name end")).withColumn("qualified_name", F.expr("case when id % 3 = 0 then qualified_name || '2' else qualified_name end"))
_stop = ", ".join(f"'{w}'" for w in R.STOP)
_word = f"(regexp_matches(w, '{R.SNAKE}') or regexp_matches(w, '{R.SCREAM}') or ({' and '.join(f"regexp_matches(w, '{c}')" for c in R.CAMEL)})) and lower(w) not in ({_stop})"
_ticked = f"list_filter(list_transform(regexp_extract_all(text, '`([^`]*)`', 1), lambda x: trim(x)), lambda x: x <> '' and lower(x) not in ({_stop}))"


def _refs_of(table: str, keys: str, out: str, n: str = "") -> str:
    """CTE out{n}(keys, ref), references as often as they are."""
    return f", rx{n} as (select {keys}, {_ticked} as t, list_filter(regexp_extract_all(text, '([A-Za-z0-9_]+)', 1), lambda w: {_word}) as w from {table}), {out}{n} as materialized (select {keys}, unnest(t || list_filter(list_distinct(w), lambda x: not list_contains(t, x))) as ref from rx{n})"


def _ev(units: str, n: str = "") -> str:
    """CTE ev{n}(ref, id, tier): the best evidence of each reference in refs."""
    return f", lastp{n} as (select id, regexp_extract(qualified_name, '([A-Za-z0-9_]+)$', 1) as l from {units}), ur{n} as (select distinct ref from refs), evx{n} as (select ref, id, 1 as tier from ur{n} join {units} on name = ref union select ref, id, 2 from ur{n} join lastp{n} on l = ref union select ref, id, 3 from ur{n} join {units} on lower(name) = lower(ref)), ev{n} as materialized (select ref, id, tier from (select *, min(tier) over (partition by ref) as b from evx{n}) x where tier = b)"


def _gr(n: str = "") -> str:
    return f", gr{n} as (select c.claim_id, coalesce(x.k, 0) as refs, coalesce(x.m, 0) as matched from claims c left join (select claim_id, count(*) as k, count(case when ref in (select ref from ev{n}) then 1 end) as m from refs group by claim_id) x on x.claim_id = c.claim_id)"


_REF = f", claims as materialized ({_CL})" + _refs_of("claims", "claim_id", "refs")
_LIVE = ", live as materialized (select * replace (case when id % 3 = 0 then name || '2' else name end as name, case when id % 3 = 0 then qualified_name || '2' else qualified_name end as qualified_name) from units)"
_STATUS = "case when refs > 0 and matched = refs then 'valid' when matched = 0 then 'deleted' else 'stale' end"
_verdict = "case when refs = 0 then 'ungrounded' when matched = refs then 'verified' when matched = 0 then 'ungrounded' else 'partial' end"
_refs = lambda s, d: R.exploded(_claims(s, d))
_q("r1_references", _REF, "select * from refs")(_refs)
_q("r2_evidence", _REF + _ev("units"), "select claim_id, ref, id, tier from (select distinct * from refs) r join ev using (ref)")(lambda s, d: R.find_evidence(_refs(s, d), load(s, d).units))
_q("r4_ground", _REF + _ev("units") + _gr(), f"select claim_id, refs, matched, {_verdict} as verdict, round(case when refs > 0 then matched * 1e0 / refs else 0e0 end, 6) as confidence from gr")(lambda s, d: R.ground(_claims(s, d), load(s, d).units))
_q("r5_cite", _REF + _ev("units"), "select claim_id, ref, id, case tier when 1 then 'direct' when 2 then 'strong' else 'partial' end as strength from (select distinct * from refs) r join ev using (ref)")(lambda s, d: R.cite(_claims(s, d), load(s, d).units))
_SG = ", sgn as (select distinct lower(name) as n, name from units), sg as (select ref, name, case when starts_with(n, lower(ref)) or starts_with(lower(ref), n) then 0 else levenshtein(n, lower(ref)) end as distance from sgn, (select distinct ref from ask) a where starts_with(n, lower(ref)) or starts_with(lower(ref), n) or (levenshtein(n, lower(ref)) between 1 and length(ref) // 2)), sk as (select *, row_number() over (partition by ref order by distance, name) as k from sg)"
#: The searches r3_suggest and r5_contradictions take as queries the claims whose id is divisible by 100, against all names; r4_suggestions takes all.
_asked = lambda s, d: _claims(s, d).where("claim_id % 100 = 0")
_q("r3_suggest", _REF + ", ask as (select ref from refs where claim_id % 100 = 0)" + _SG, "select ref, name, cast(distance as integer) as distance, round(1 - 1e-1 * (k - 1), 6) as relevance from sk where k <= 3")(lambda s, d: R.suggest(R.exploded(_asked(s, d)), load(s, d).units))
_MISS = _REF + _ev("units") + ", ask as (select distinct claim_id, ref from refs where claim_id % 100 = 0 and ref not in (select ref from ev))" + _SG
_q("r4_suggestions", _MISS.replace("claim_id % 100 = 0 and ", ""), "select claim_id, string_agg(name, ',' order by name) as names from (select distinct claim_id, name from ask join sk using (ref) where k <= 3) x group by claim_id")(lambda s, d: R.suggestions(_claims(s, d), load(s, d).units).select("claim_id", F.array_join("names", ",").alias("names")))
_q("r5_contradictions", _MISS, "select claim_id, ask.ref, case when exists (select 1 from sk where sk.ref = ask.ref and k = 1 and (distance = 0 or distance <= length(sk.ref) // 3)) then 'contradicted' else 'not_found' end as kind from ask")(lambda s, d: R.contradictions(_asked(s, d), load(s, d).units))
_trimmed = "regexp_replace(w, '^[^A-Za-z0-9/._]+|[^A-Za-z0-9/._]+$', '', 'g')"
_HL = (
    f", outs as materialized ({_CL}), st as (select claim_id, list_filter(list_transform(string_split(regexp_replace(text, '\\.(\\s|$)', chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: length(x) > 5) as p from outs), claims as materialized (select claim_id as out_id, claim_id || ':' || (k - 1) as claim_id, k - 1 as k, p[k] as text from st, range(1, 20) r(k) where k <= len(p))"
    + _refs_of("claims", "claim_id", "refs") + _ev("units") + _gr()
    + ", f1 as (select name as ref, arg_min(file_path, id) as f from units group by name), f2 as (select lower(name) as low, arg_min(file_path, id) as f from units group by lower(name)), hx as (select c.out_id, c.k, r.ref, c.text, coalesce(f1.f, f2.f) as file from refs r join claims c on c.claim_id = r.claim_id join gr on gr.claim_id = c.claim_id left join f1 on f1.ref = r.ref left join f2 on f2.low = lower(r.ref) where matched < refs),"
    + f" hk as (select *, case when file is null then 'non_existent' when (contains(lower(text), 'in ') or contains(lower(text), 'file')) and len(list_filter(list_transform(regexp_split_to_array(text, '\\s+'), lambda w: {_trimmed}), lambda w: contains(w, '/') and contains(w, '.') and not contains(file, w))) > 0 then 'wrong_location' end as kind from hx), hb as (select * from hk where kind is not null)"
)
_q("r6_hallucinations", _HL + ", sm as (select o.claim_id, (select count(*) from claims c join gr on gr.claim_id = c.claim_id where out_id = o.claim_id and refs > 0) as claims, (select count(*) from hb where out_id = o.claim_id and kind = 'non_existent') as missing, (select count(*) from hb where out_id = o.claim_id and kind = 'wrong_location') as misplaced from outs o)", "select *, round(least(1e0, case when claims > 0 then (missing + misplaced) * 1e0 / claims else 0e0 end), 6) as score, case when claims > 0 then (missing + misplaced) * 1e0 / claims else 0e0 end < 3e-1 as safe from sm")(
    lambda s, d: R.hallucinations(_claims(s, d), load(s, d).units)
)
_q("r6_details", _HL, "select out_id as claim_id, cast(k as int) as k, ref, kind, case kind when 'non_existent' then 'severe' else 'moderate' end as severity, file from hb")(lambda s, d: R.hallucinated(_claims(s, d), load(s, d).units))
_q("r6_fixes", _HL + ", lk as (select ref, name, row_number() over (partition by ref order by name) as i from (select distinct ref, name from (select distinct ref from hb where kind = 'non_existent') h, (select distinct name from units) u where starts_with(lower(name), lower(ref)) or starts_with(lower(ref), lower(name))) x), ln as (select ref, string_agg(name, ', ' order by name) as names from lk where i <= 5 group by ref)", "select distinct out_id as claim_id, cast(k as int) as k, ref, case when kind = 'wrong_location' then 'actually in ' || file when names is not null then 'replace by one of: ' || names else 'remove' end as fix from hb left join ln using (ref)")(
    lambda s, d: R.fixes(_claims(s, d), load(s, d).units)
)
_truths = lambda s, d: R.refresh(R.refresh(R.register(_claims(s, d), 100), load(s, d).units, 200), _live(s, d), 300)
_TR = _REF + _LIVE + _ev("units") + _gr() + _ev("live", "2") + _gr("2") + f", s1 as (select claim_id, {_STATUS} as a from gr), s2 as (select claim_id, {_STATUS} as b from gr2), tr as (select claim_id, case when a <> 'valid' then a else b end as status, case when a <> 'valid' then 200 when b <> 'valid' then 300 end as invalidated_at from s1 join s2 using (claim_id))"
_q("r7_check", _REF + _LIVE + _ev("live") + _gr(), f"select claim_id, {_STATUS} as status from gr")(lambda s, d: R.check(_claims(s, d), _live(s, d)))
_q("r7_truth", _TR, "select * from tr")(lambda s, d: _truths(s, d).select("claim_id", "status", "invalidated_at"))
_q("r7_truth_diff", _TR, "select * from tr where status <> 'valid'")(lambda s, d: R.truth_diff(_truths(s, d)).select("claim_id", "status", "invalidated_at"))

_qs = ", ".join(f"'{w}'" for w in sorted(C.STOP))
_has = lambda *ws: "regexp_matches(q, '" + "|".join(ws) + "')"


@query(
    "i6_parse_question",
    rf"""select conv_id, turn, case when {_has("test", "spec")} or starts_with(q, 'how is') then 'test' when {_has("function", "method", "fn ")} or starts_with(q, 'def ') then 'function' when {_has("type", "struct", "class", "enum", "interface")} then 'type' when {_has("usage", "call", "who uses", "where is")} then 'usage' when {_has("implement", "how does", "logic for")} then 'implementation' else 'general' end as intent,
    array_to_string(list_filter(regexp_split_to_array(q, '[^\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 2 and w not in ({_qs})), ',') as keywords, case when regexp_matches(q, '\.(rs|py|ts|js)\b') then 'file' when contains(q, 'in module ') then 'module' else 'all' end as scope from (select *, lower(text) as q from conversations where text is not null) x""",
)
def i6_parse_question(spark, sf_dir):
    """Every turn of every conversation as a question."""
    return C.parse_questions(spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text is not null").select("conv_id", "turn", "text")).drop("text")
