"""Source, sink and stream queries; SQL has no words for most of them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone import streaming
from lodestone.graph import WITH, load
from lodestone.operators import ingest as I
from lodestone.registry import query
from lodestone.sources import code, store
from lodestone.state import checkpoint, shared_folder

#: A file for each part, in one of four languages: {n} is the part, {m} the part before, {more} comes up to twice.
FILES = (
    ("py", "import os\nimport native_{n}\nfrom pkg import tool\n\n\nclass C{n}(Base):\n    def run(self):\n        return helper_{n}(requests.get('x'))\n\n\ndef helper_{n}(x=1):\n    \"\"\"Helps.\"\"\"\n    if x and os:\n        return _low()\n{more}    return tool.work(x)\n\n\ndef _low():\n    yield ctypes.CDLL('x')\n", "    if x > 1:\n        x -= 1\n"),
    ("rs", "use std::fs;\n\npub struct S{n};\n\npub trait T{n} {\n    fn go(&self);\n}\n\nimpl T{n} for S{n} {\n    fn go(&self) {\n        work_{n}(1);\n    }\n}\n\npub fn work_{n}(x: i32) -> i32 {\n    if x > 0 && x < 9 {\n        return 1;\n    }\n{more}    0\n}\n\n#[pymodule]\nfn native_{m}(m: &PyModule) {\n}\n\n#[test]\nfn checks_{n}() {\n    assert!(true);\n}\n", "    while x > 5 { break; }\n"),
    ("ts", "import { a } from './lib';\n\nexport class W{n} extends Base {\n  run() {\n    return 1;\n  }\n}\n\nexport async function load{n}(x: number) {\n  return x;\n}\n\nexport function create_box{n}() {\n  return 2;\n}\n\nexport interface I{n} {\n  a: string;\n}\n", ""),
    ("go", "package m\n\nimport \"fmt\"\n\ntype Box{n} struct {\n\ta int\n}\n\nfunc Open{n}(x int) int {\n\treturn x\n}\n\nfunc close{n}() {\n}\n\nfunc TestOpen{n}(t *testing.T) {\n}\n", ""),
)
#: Files that a task parses.
FILES_A_TASK = 4000
#: What is in them: kind, name, complexity (more for each repeat where it is 3), visibility.
_DECLARED = (
    (("module", "m{n}", 0, "public"), ("import", "os", 0, "public"), ("import", "native_{n}", 0, "public"), ("import", "pkg.tool", 0, "public"), ("type", "C{n}", 0, "public"), ("function", "run", 1, "public"), ("function", "helper_{n}", 3, "public"), ("function", "_low", 1, "internal")),
    (("module", "m{n}", 0, "public"), ("import", "std::fs", 0, "private"), ("type", "S{n}", 0, "public"), ("trait", "T{n}", 0, "public"), ("function", "go", 1, "private"), ("impl", "S{n}", 0, "private"), ("function", "go", 1, "private"), ("function", "work_{n}", 3, "public"), ("function", "native_{m}", 1, "private"), ("test", "checks_{n}", 1, "private")),
    (("module", "m{n}", 0, "public"), ("import", "./lib", 0, "public"), ("type", "W{n}", 0, "public"), ("function", "run", 0, "public"), ("function", "load{n}", 0, "public"), ("function", "create_box{n}", 0, "public"), ("trait", "I{n}", 0, "public")),
    (("module", "m{n}", 0, "public"), ("import", "fmt", 0, "private"), ("type", "Box{n}", 0, "public"), ("function", "Open{n}", 0, "public"), ("function", "close{n}", 0, "private"), ("test", "TestOpen{n}", 0, "public")),
)
#: And how their references are resolved: language, name, kind, way.
_REFERRED = (
    (0, "os", "import", "external"), (0, "native_{n}", "import", "local"), (0, "pkg.tool", "import", "unresolved"), (0, "Base", "inherit", "unresolved"), (0, "helper_{n}", "call", "local"), (0, "requests.get", "call", "unresolved"), (0, "_low", "call", "local"), (0, "tool.work", "call", "imported"), (0, "ctypes.CDLL", "call", "unresolved"),
    (1, "std::fs", "import", "external"), (1, "T{n}", "implement", "local"), (2, "./lib", "import", "unresolved"), (2, "Base", "inherit", "unresolved"),
)


def _files(s, d):
    """A source file for each part, written from a template. Keys are spread before that, as the table is one file that a single task would read and parse."""
    parts = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("n"))
    parts = parts.repartition(max(s.sparkContext.defaultParallelism, -(-parts.count() // FILES_A_TASK)))
    text = F.lit(None).cast("string")
    ext = F.lit(None).cast("string")
    for k, (e, t, more) in enumerate(FILES):
        here = F.col("n") % 4 == k
        text, ext = F.when(here, F.replace(F.lit(t), F.lit("{more}"), F.repeat(F.lit(more), (F.col("n") % 3).cast("int")))).otherwise(text), F.when(here, F.lit(e)).otherwise(ext)
    filled = F.replace(F.replace(text, F.lit("{n}"), F.col("n").cast("string")), F.lit("{m}"), (F.col("n") - 1).cast("string"))
    return parts.select(F.concat(F.lit("src/m"), "n", F.lit("."), ext).alias("path"), filled.cast("binary").alias("content"))


def _raw(s, d):
    return code.parse(_files(s, d))


def _name(c: str) -> str:
    return f"replace(replace({c}, '{{n}}', cast(p_partkey as varchar)), '{{m}}', cast(p_partkey - 1 as varchar))"


_values = ", ".join(f"({k}, '{FILES[k][0]}', '{t}', '{n}', {c}, '{v}')" for k, rows in enumerate(_DECLARED) for t, n, c, v in rows)
_PARSED = f"select p_partkey as n, 'src/m' || p_partkey || '.' || u.e as path, u.t as unit_type, {_name('u.n')} as name, u.c + case when u.c = 3 then p_partkey % 3 else 0 end as complexity, u.v as visibility from part join (values {_values}) u(k, e, t, n, c, v) on p_partkey % 4 = u.k"


@query("p3_parse", f"select path, unit_type, name, complexity, visibility from ({_PARSED}) x")
def p3_parse(spark, sf_dir):
    return _raw(spark, sf_dir).select("path", "unit_type", "name", "complexity", "visibility")


@query("s2_resolve", f"select name, kind, how, count(*) as n from (select {_name('v.n')} as name, v.k as kind, v.h as how from part join (values {', '.join(map(str, _REFERRED))}) v(l, n, k, h) on p_partkey % 4 = v.l) u group by 1, 2, 3")
def s2_resolve(spark, sf_dir):
    return I.resolve(checkpoint(I.number(_raw(spark, sf_dir)))).groupBy("name", "kind", "how").agg(F.count("*").alias("n"))


@query("e7_compile", "select t as edge_type, count(*) * any_value(c) as n from part join (values (0, 'contains', 4), (1, 'contains', 8), (2, 'contains', 5), (3, 'contains', 4), (0, 'calls', 2), (0, 'imports', 2), (1, 'implements', 1), (0, 'ffi_binds', 1), (2, 'pattern_of', 1)) v(k, t, c) on p_partkey % 4 = k and t <> 'contains' group by t union all select 'contains', cast(sum(case p_partkey % 4 when 1 then 8 when 2 then 5 else 4 end) as bigint) from part")
def e7_compile(spark, sf_dir):
    """With edges to native modules and patterns."""
    return I.compile_graph(_raw(spark, sf_dir), ffi=True, detect_patterns=True).edges.groupBy("edge_type").agg(F.count("*").alias("n"))


@query("e7_options", f"select unit_type, count(*) as n from ({_PARSED}) x where n % 4 in (1, 3) and unit_type <> 'test' and not contains(path, 'm1') group by unit_type")
def e7_options(spark, sf_dir):
    """Of two languages, without tests and without paths that hold a text."""
    return I.compile_graph(_raw(spark, sf_dir), languages=("Rust", "Go"), exclude=("m1",), include_tests=False).units.groupBy("unit_type").agg(F.count("*").alias("n"))


@query("x8_export_import", f"{WITH} select unit_type, count(*) as n from units group by unit_type")
def x8_export_import(spark, sf_dir):
    g = load(spark, sf_dir)
    units, _ = store.from_json(store.as_json(g), ", ".join(f"{n} {t}" for n, t in g.units.dtypes), ", ".join(f"{n} {t}" for n, t in g.edges.dtypes))
    return units.groupBy("unit_type").agg(F.count("*").alias("n"))


@query("x3_write_read", f"{WITH} select edge_type, count(*) as n, sum(weight) as w from edges group by edge_type")
def x3_write_read(spark, sf_dir):
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    store.write(load(spark, sf_dir), path)
    return store.read(spark, path).edges.groupBy("edge_type").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))


@query("st_windowed_events", "select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by 1, 2 having date_trunc('hour', ts) + interval 1 hour <= (select max(ts) from events) - interval 1 day")
def st_windowed_events(spark, sf_dir):
    """The events as a stream of two batches; windows are given out when the watermark has passed them, and rows that come after that are dropped.

    The second batch holds the earliest event once more: it is too late, so no window counts it.
    """
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    first = events.agg(F.min("ts")).first()[0]
    late = events.where(F.col("ts") == F.lit(first))
    for batch in (events, late):
        batch.coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = streaming.read_folder(spark, f"{path}/in", "ts timestamp, event_type string")
        counts = streaming.windowed(stream, "ts", ["event_type"])
        out = counts.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out")
        out.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("st_new_only", "select event_type, user_id, min(ts) as ts from events group by event_type, user_id")
def st_new_only(spark, sf_dir):
    """The first event of each type and user, from a stream that repeats all of them in a second batch."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.concat_ws(":", "event_type", "user_id").alias("key"), "event_type", "user_id")
    firsts = events.groupBy("key", "event_type", "user_id").agg(F.min("ts").alias("ts")).select("ts", "key", "event_type", "user_id")
    for _ in range(2):
        firsts.coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = streaming.read_folder(spark, f"{path}/in", "ts timestamp, key string, event_type string, user_id long")
        out = streaming.new_only(stream, "ts", "key", "3650 days").writeStream.outputMode("append").format("parquet").option("path", f"{path}/out")
        out.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select("event_type", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("s5_ffi", "select k as kind, count(*) as n, count(*) * any_value(t) as targets from part join (values ('ctypes', 0), ('http', 0), ('pyo3', 1)) v(k, t) on p_partkey % 4 = 0 group by k")
def s5_ffi(spark, sf_dir):
    """Calls of foreign libraries and of the web, and imports of the native module of the next part's file."""
    return I.trace_ffi(checkpoint(I.number(_raw(spark, sf_dir)))).groupBy("kind").agg(F.count("*").alias("n"), F.count("target_id").alias("targets"))
