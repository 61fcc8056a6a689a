"""A code graph as three tables: units, edges and changes; and its projection from order tables.

The projection is portable SQL, so that the same definition serves Spark and an SQL oracle.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lodestone.state import checkpoint, folder_bytes, sized

CHANGES = """
select 'p' || cast(l_partkey as string) as path, o_orderkey as commit_id, EPOCH(o_orderdate) as ts, 'a' || cast(o_custkey as string) as author,
  l_returnflag = 'R' as is_bugfix, cast(l_quantity as int) as lines_added, cast(round(l_discount * 100) as int) as lines_deleted,
  case when l_linenumber = 1 then 'add' when l_linenumber = 7 then 'delete' when l_linenumber = 6 then 'rename' else 'modify' end as change_type
from lineitem join orders on l_orderkey = o_orderkey
"""
UNITS = """
select p_partkey as id, 'function' as unit_type, case p_partkey % 3 when 0 then 'Python' when 1 then 'Rust' else 'TypeScript' end as language,
  case when p_partkey % 17 = 0 then 'get_' when p_partkey % 19 = 0 then 'create_' when p_partkey % 23 = 0 then 'test_' else '' end || replace(p_name, ' ', '_') as name,
  lower(replace(p_brand, '#', '')) || '::' || replace(p_name, ' ', '_') || '_' || cast(p_partkey as string) as qualified_name,
  'src/' || lower(replace(p_brand, '#', '')) || '/f' || cast(p_partkey % 50 as string) || case p_partkey % 3 when 0 then '.py' when 1 then '.rs' else '.ts' end as file_path,
  cast(p_partkey % 500 + 1 as int) as start_line, cast(p_partkey % 500 + 1 + p_size as int) as end_line,
  case when p_partkey % 2 = 0 then 'fn ' || replace(p_name, ' ', '_') || '(x' || cast(p_partkey % 4 as string) || ')' end as signature,
  case when p_partkey % 4 = 0 then 'Handles ' || lower(p_type) when p_partkey % 27 = 1 then 'Deprecated token cache' end as doc_summary,
  case p_partkey % 5 when 0 then 'public' when 1 then 'private' when 2 then 'internal' else 'unknown' end as visibility,
  cast(p_size as int) as complexity, p_partkey % 7 = 0 as is_async, p_partkey % 29 = 0 as is_generator,
  cast(coalesce(n, 0) as int) as change_count, cast(coalesce(round(1e0 - b * 1e0 / n, 4), 1e0) as double) as stability_score, p_partkey % 20 as collective_usage
from part left join (select l_partkey, count(*) as n, sum(case when l_returnflag = 'R' then 1 else 0 end) as b from lineitem group by l_partkey) c on p_partkey = l_partkey
union all select 30000000 + s_suppkey, 'type', 'Rust', 'Supplier' || cast(s_suppkey as string), 'supplier::Supplier' || cast(s_suppkey as string), 'src/supplier.rs', cast(s_suppkey as int), cast(s_suppkey + 9 as int), null, null, 'public', 0, false, false, 0, 1e0, 0 from supplier
union all select 40000000 + c_custkey, 'test', 'Python', 'test_customer_' || cast(c_custkey as string), 'customer::test_customer_' || cast(c_custkey as string), 'tests/t' || cast(c_custkey % 20 as string) || '.py', cast(c_custkey as int), cast(c_custkey + 5 as int), null, null, 'unknown', 1, false, false, 0, 1e0, 0 from customer
union all select cast(20000000 + n_nationkey as bigint), 'module', 'Python', n_name, n_name, 'src/' || lower(n_name) || '.py', 1, 100, null, null, 'unknown', 0, false, false, 0, 1e0, 0 from nation
union all select cast(10000000 + r_regionkey as bigint), 'module', 'Python', r_name, r_name, 'src/' || lower(r_name) || '.py', 1, 100, null, null, 'unknown', 0, false, false, 0, 1e0, 0 from region
"""
EDGES = """
select cast(10000000 + n_regionkey as bigint) as source_id, cast(20000000 + n_nationkey as bigint) as target_id, 'contains' as edge_type, 1e0 as weight, 0 as context from nation
union all select cast(20000000 + s_nationkey as bigint), 30000000 + s_suppkey, 'contains', 1e0, 0 from supplier
union all select 30000000 + min(l_suppkey), l_partkey, 'contains', 1e0, 0 from lineitem group by l_partkey
union all select s, t, 'calls', 1e0, cast(s % 97 as int) from (select distinct a.l_partkey as s, b.l_partkey as t from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey
   and b.l_linenumber = a.l_linenumber + 1 where a.l_partkey <> b.l_partkey and a.l_returnflag = 'R' and b.l_returnflag = 'R') x
union all select s, t, 'tests', 1e0, 0 from (select distinct 40000000 + o_custkey as s, l_partkey as t from lineitem join orders on l_orderkey = o_orderkey
   where o_orderpriority = '1-URGENT' and l_linenumber = 1 and l_returnflag = 'A') x
union all select pa, pb, 'couples_with', n / 10e0, 0 from (select a.l_partkey as pa, b.l_partkey as pb, count(*) as n
   from (select distinct l_orderkey, l_partkey from lineitem) a join (select distinct l_orderkey, l_partkey from lineitem) b on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey group by a.l_partkey, b.l_partkey) x where n >= 3
union all select 30000000 + s_suppkey, 30000000 + m, 'inherits', 1e0, 0 from supplier join (select s_nationkey as k, min(s_suppkey) as m from supplier group by s_nationkey) x on s_nationkey = k where s_suppkey <> m
union all select 30000000 + s_suppkey, 30000000 + s_suppkey + 1, 'implements', 1e0, 0 from supplier where s_suppkey % 4 = 1 and s_suppkey < (select max(s_suppkey) from supplier)
union all select l_partkey, 30000000 + max(l_suppkey), 'uses_type', 5e-1, 0 from lineitem group by l_partkey
union all select p_partkey, p_partkey + 1, 'ffi_binds', 1e0, 0 from part where p_partkey % 10 = 3 and p_partkey < (select max(p_partkey) from part)
union all select p_partkey, p_partkey + 3, 'breaks_with', 1e0, 0 from part where p_partkey % 11 = 0 and p_partkey + 3 <= (select max(p_partkey) from part)
union all select p_partkey + 2, p_partkey, 'version_of', 1e0, 0 from part where p_partkey % 13 = 0 and p_partkey + 2 <= (select max(p_partkey) from part)
union all select p_partkey, p_partkey + 5, 'references', 1e0, 0 from part where p_partkey % 9 = 0 and p_partkey + 5 <= (select max(p_partkey) from part)
union all select cast(20000000 + a.n_nationkey as bigint), cast(20000000 + b.n_nationkey as bigint), 'imports', 1e0, 0 from nation a join nation b on a.n_regionkey = b.n_regionkey and b.n_nationkey > a.n_nationkey and (a.n_nationkey + b.n_nationkey) % 3 = 0
"""


@dataclass(frozen=True)
class Graph:
    """units(id, unit_type, language, name, qualified_name, file_path, …), edges(source_id, target_id, edge_type, weight, context), changes(path, commit_id, ts, author, …)."""

    units: DataFrame
    edges: DataFrame
    changes: DataFrame


def spark_sql(sql: str, sf_dir: str) -> str:
    """The portable SQL for Spark over the Parquet files of a folder."""
    out = re.sub(r"\b(from|join) (region|nation|customer|supplier|part|orders|lineitem|events|documents|embeddings)\b", rf"\1 parquet.`{sf_dir}/\2.parquet`", sql)
    return out.replace("EPOCH(", "unix_timestamp(")


def duck_sql(sql: str) -> str:
    """The portable SQL for DuckDB."""
    return re.sub(r"EPOCH\((\w+)\)", r"cast(epoch(\1) as bigint)", sql).replace("as string)", "as varchar)")


#: The three tables as common table expressions for an oracle; a query follows.
WITH = f"with recursive units as materialized ({duck_sql(UNITS)}), edges as materialized ({duck_sql(EDGES)}), changes as materialized ({duck_sql(CHANGES)})"
_loaded: dict[tuple[str, str], Graph] = {}


def load(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of a folder's tables, compiled once in a session to Parquet in the shared folder.

    It is made and read by a session of its own, whose tasks stay small however large the tables are and however few partitions the caller's session sets.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _loaded:
        own = sized(spark, sum(folder_bytes(spark, f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "customer", "supplier", "part")))
        with ThreadPoolExecutor(3) as pool:  # three independent writes share the cluster
            _loaded[key] = Graph(*pool.map(lambda q: checkpoint(own.sql(spark_sql(q, sf_dir))), (UNITS, EDGES, CHANGES)))
    return _loaded[key]
