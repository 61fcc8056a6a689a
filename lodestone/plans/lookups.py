"""Graph store and index queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.graph import WITH, load
from lodestone.operators import lookup as L
from lodestone.registry import query

UNIT, TARGET = 138, 169
_SHORT = "id, unit_type, language, name, qualified_name"
_cols = ("id", "unit_type", "language", "name", "qualified_name")


def _q(name: str, sql: str):
    return query(name, f"{WITH} {sql}")


def _lookup(name: str, where: str, *args, **kwargs) -> None:
    _q(name, f"select {_SHORT} from units where {where}")(lambda s, d: L.by_name(load(s, d).units, *args, **kwargs).select(*_cols))


_lookup("q1_symbol_exact", "name = 'Supplier7'", "Supplier7")
_lookup("q1_symbol_prefix", "lower(name) like 'supplier1%'", "SUPPLIER1", "prefix")
_lookup("q1_symbol_contains", "contains(lower(name), 'customer_1') and unit_type = 'test' and language = 'Python'", "Customer_1", "contains", types=["test"], languages=["Python"])
_lookup("q1_symbol_fuzzy", "levenshtein(lower(name), 'suplier1') <= 2 and unit_type = 'type'", "Suplier1", "fuzzy", types=["type"])
_q("q1_symbol_limit", f"select {_SHORT} from units where contains(lower(name), 'supplier') order by id limit 5")(lambda s, d: L.by_name(load(s, d).units, "supplier", "contains", limit=5).select(*_cols))

_EDGE = "source_id, target_id, edge_type, weight, context"
_q("g2_valid_edges", "select edge_type, count(*) as n from edges where source_id <> target_id and source_id in (select id from units) and target_id in (select id from units) group by edge_type")(
    lambda s, d: L.valid_edges(load(s, d).units, load(s, d).edges)[0].groupBy("edge_type").agg(F.count("*").alias("n"))
)


@_q("g3_rejected_edges", "select 'unit_not_found' as error, count(*) as n from edges e left join units u on e.source_id = u.id where u.unit_type = 'test' having count(*) > 0 union all select 'invalid_edge_target', count(*) from edges e join units u on e.source_id = u.id join units v on v.id = e.target_id where u.unit_type <> 'test' and v.unit_type = 'test' having count(*) > 0")
def g3_rejected_edges(spark, sf_dir):
    g = load(spark, sf_dir)
    return L.valid_edges(g.units.where("unit_type <> 'test'"), g.edges)[1].groupBy("error").agg(F.count("*").alias("n"))


_q("g4_sizes", "select (select count(*) from units) as unit_count, (select count(*) from edges) as edge_count, (select string_agg(language, ',' order by language) from (select distinct language from units) x) as languages")(lambda s, d: L.sizes(load(s, d).units, load(s, d).edges))
_q("g5_get_unit", f"select {_SHORT}, complexity from units where id = {UNIT}")(lambda s, d: load(s, d).units.where(F.col("id") == UNIT).select(*_cols, "complexity"))
_q("g6_units", "select * from units")(lambda s, d: load(s, d).units)
_q("g6_edges", "select * from edges")(lambda s, d: load(s, d).edges)
_q("g7_edges_from", f"select {_EDGE} from edges where source_id = {UNIT}")(lambda s, d: L.adjacent(load(s, d).edges, UNIT))
_q("g7_edges_to", f"select {_EDGE} from edges where target_id = {TARGET}")(lambda s, d: L.adjacent(load(s, d).edges, TARGET, "to"))
_q("g8_edges_from_of_type", f"select {_EDGE} from edges where source_id = {UNIT} and edge_type = 'calls'")(lambda s, d: L.adjacent(load(s, d).edges, UNIT, "from", "calls"))
_q("g8_edges_to_of_type", f"select {_EDGE} from edges where target_id = {TARGET} and edge_type = 'tests'")(lambda s, d: L.adjacent(load(s, d).edges, TARGET, "to", "tests"))
_q("g9_names_by_prefix", f"select {_SHORT} from units where lower(name) like 'get\\_%' escape '\\'")(lambda s, d: L.by_name(load(s, d).units, "GET_", "prefix").select(*_cols))
_q("g11_by_type", f"select {_SHORT} from units where unit_type = 'module'")(lambda s, d: load(s, d).units.where("unit_type = 'module'").select(*_cols))
_q("g11_by_language", f"select {_SHORT} from units where language = 'Rust'")(lambda s, d: load(s, d).units.where("language = 'Rust'").select(*_cols))
_q("g11_by_path", f"select {_SHORT} from units where file_path = 'src/supplier.rs'")(lambda s, d: load(s, d).units.where("file_path = 'src/supplier.rs'").select(*_cols))
_q("g12_has_edge", f"select count(*) > 0 as found from edges where source_id = 30000001 and target_id = 30000002 and edge_type = 'implements'")(lambda s, d: L.has_edge(load(s, d).edges, 30000001, 30000002, "implements"))
_q("g13_stats", "select 'unit_type' as kind, unit_type as value, count(*) as n from units group by unit_type union all select 'language', language, count(*) from units group by language union all select 'edge_type', edge_type, count(*) from edges group by edge_type")(lambda s, d: L.stats(load(s, d).units, load(s, d).edges))
_q("i2_type_index", "select unit_type, count(*) as n from units group by unit_type")(lambda s, d: load(s, d).units.groupBy("unit_type").agg(F.count("*").alias("n")))
_q("i3_language_index", "select language, count(*) as n from units group by language")(lambda s, d: load(s, d).units.groupBy("language").agg(F.count("*").alias("n")))
_q("i4_path_index", "select file_path, count(*) as n from units group by file_path")(lambda s, d: L.files(load(s, d).units))
_q("x1_page", f"select {_SHORT} from units where unit_type = 'function' order by id limit 20 offset 40")(lambda s, d: L.page(load(s, d).units, "function", 20, 40).select(*_cols))
_q("x4_unit_with_edges", f"select cast({UNIT} as bigint) as id, case when source_id = {UNIT} then 'out' else 'in' end as side, u.id as other_id, u.name as other_name, edge_type from edges join units u on u.id = case when source_id = {UNIT} then target_id else source_id end where source_id = {UNIT} or target_id = {UNIT}")(lambda s, d: L.with_edges(load(s, d).units, load(s, d).edges, UNIT))

_NEW = ("'fresh' as unit_type", "'Go' as language", "name || '_copy' as name", "qualified_name", "file_path", "start_line")
_q("g1_add_units", "select id, name from units union all select (select max(id) from units) + row_number() over (order by file_path, start_line, qualified_name), name || '_copy' from units where unit_type = 'type'")(lambda s, d: L.add_units(load(s, d).units, load(s, d).units.where("unit_type = 'type'").selectExpr(*_NEW)).select("id", "name"))
