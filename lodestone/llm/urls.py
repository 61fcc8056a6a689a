"""URL filters: a tree of path templates for each host.

1. Paths are split in segments, and segments that are plainly variable become wildcards: digits ``{n}``, long hexadecimal
   ``{hex}``, UUIDs ``{uuid}``, each with the file ending they had. Equal paths of a host are counted together before anything moves.
2. Level by level, a node with at least LEAST_CHILDREN different segments below it, of which there is one for every
   MOST_REPEATS pages or fewer, has its segments generalised into ``*``. All hosts are treated at once, by joins.
3. In what remains, from the leaves up, level by level and all hosts at once, sibling branches with the same templates below them merge if the shares
   of good pages that labels give them don't differ by a two-proportion test (SIMILAR_Z); branches without labels
   merge with the labelled ones where those are one group, otherwise with each other only. A merged branch is written ``(a|b)``.
4. A template's purity is the share of good ones among its labelled pages, smoothed by PRIOR pages of the share of all
   labelled pages. Templates of a purity under LEAST_PURITY are rejected; without labels a template has that share.

Counts are of all pages. Pages move as URLs only, and their texts not at all. No task needs a whole host: a round of a level aggregates
by node, and only siblings that are alike come together. What lies more than ROUNDS levels deep is treated by the same rules in one task
for each node of that depth, as its levels may be as many as a URL has room for.

Defined results: every row of pages has one row. A null URL, and one without a scheme and host, has the host ``""`` and the template
``""``; those rows are a template like any other. Hosts are lower-cased, without user, port and a leading ``www.``; queries and fragments play no part.
Labels of null ids or values are not used; of several labels of a page the
least counts. Repeated rows count as often as they are. Empty tables give no rows. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.state import checkpoint, small

ROUNDS, LEAST_CHILDREN, MOST_REPEATS = 12, 10, 3.0
SIMILAR_Z, PRIOR, LEAST_PURITY = 1.96, 10.0, 0.6
_UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(\.[a-z0-9]+)?$"


def _shape(s: Column) -> Column:
    low = F.lower(s)
    return (
        F.when(low.rlike(r"^[0-9]+(\.[a-z][a-z0-9]*)?$"), F.regexp_replace(low, "^[0-9]+", "{n}"))
        .when(low.rlike(_UUID), F.regexp_replace(low, r"^[0-9a-f-]+", "{uuid}"))
        .when(low.rlike(r"^[0-9a-f]{8,}(\.[a-z0-9]+)?$") & low.rlike(r"^[a-f]*[0-9]"), F.regexp_replace(low, r"^[0-9a-f]+", "{hex}"))
        .otherwise(low)
    )


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, host, path): path is an array of shaped segments."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1))
    path = F.when(host == "", F.lit("")).otherwise(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return pages.select("page_id", F.regexp_replace(host, r"^www\.", "").alias("host"), F.transform(parts, _shape).alias("path"))


def _deepest(paths: DataFrame, column: str, several: int) -> int:
    """The deepest level that so many distinct paths of one host reach: below it no node can have so many branches."""
    sizes = paths.groupBy("host", F.size(column).alias("d")).agg(F.count("*").alias("n"))
    reach = sizes.withColumn("reach", F.sum("n").over(Window.partitionBy("host").orderBy(F.desc("d"))))  # a row for each depth of a host
    return reach.where(F.col("reach") >= several).agg(F.max("d")).first()[0] or 0


def generalised(paths: DataFrame) -> DataFrame:
    """(host, path, tree, n, good, bad) of distinct paths: tree is the path with crowded segments as wildcards."""
    now = checkpoint(paths.withColumn("tree", F.col("path")))
    for d in range(1, min(ROUNDS, _deepest(now, "path", LEAST_CHILDREN)) + 1):
        node, below = F.slice("tree", 1, d - 1), F.get("tree", F.lit(d - 1))
        reach = now.where(F.size("tree") >= d)
        segments = reach.groupBy("host", node.alias("node"), below.alias("segment")).agg(F.sum("n").alias("n"))
        crowded = checkpoint(
            segments.groupBy(F.col("host").alias("c_host"), F.col("node").alias("c_node")).agg(F.count("*").alias("kinds"), F.sum("n").alias("pages")).where((F.col("kinds") >= LEAST_CHILDREN) & (F.col("pages") <= F.col("kinds") * MOST_REPEATS)).select("c_host", "c_node")
        )
        if crowded.isEmpty():
            continue
        hit = F.col("c_host").isNotNull() & (F.size("tree") >= d)
        tree = F.when(hit, F.concat(node, F.array(F.lit("*")), F.slice("tree", d + 1, 1 << 30))).otherwise(F.col("tree"))
        now = checkpoint(now.join(small(crowded, 200), (F.col("host") == F.col("c_host")) & (node == F.col("c_node")), "left").withColumn("tree", tree).drop("c_host", "c_node"))
    return now


def similar(a: tuple[float, float], b: tuple[float, float]) -> bool:
    """Whether two pairs (good, bad) may have one share of good ones."""
    n, m = sum(a), sum(b)
    if not n or not m:
        return True
    p = (a[0] + b[0]) / (n + m)
    if p in (0, 1):
        return True
    return abs(a[0] / n - b[0] / m) <= SIMILAR_Z * math.sqrt(p * (1 - p) * (1 / n + 1 / m))


def merged(members: list[tuple[str, float, float]]) -> dict[str, str]:
    """The names of sibling branches (segment, good, bad) that have the same templates below them."""
    share = lambda m: (m[1] + 1) / (m[1] + m[2] + 2)
    groups: list[list] = []  # segments, good, bad
    for s, good, bad in sorted(members, key=lambda m: (not m[1] + m[2], share(m), m[0])):
        if not good + bad and len(groups) == 1:
            groups[0][0].append(s)
        elif groups and (good + bad > 0) == (groups[-1][1] + groups[-1][2] > 0) and similar((groups[-1][1], groups[-1][2]), (good, bad)):
            groups[-1][0].append(s)
            groups[-1][1] += good
            groups[-1][2] += bad
        else:
            groups.append([[s], good, bad])
    return {s: "(" + "|".join(sorted(g)) + ")" if len(g) > 1 else s for g, _, _ in groups for s in g}


def _wild(segment: str) -> str:
    """Wildcards of steps 1 and 2 merge with none."""
    return segment if segment[0] in "*{" else ""


def merge_tree(rows: list[tuple[tuple[str, ...], float, float]]) -> dict[tuple[str, ...], str]:
    """What every path below a node becomes, each segment followed by a slash; rows: (path, good, bad), each path once."""
    rest = {path: "" for path, _, _ in rows}  # the path's named end, below level d
    for d in range(max((len(p) for p in rest), default=0), 0, -1):
        nodes: dict[tuple[str, ...], list] = {}
        for path, good, bad in rows:
            if len(path) >= d:
                node = nodes.setdefault(path[:d], [0.0, 0.0, set()])
                node[0] += good
                node[1] += bad
                node[2].add(rest[path])
        siblings: dict[tuple, list] = defaultdict(list)
        for key, (good, bad, below) in nodes.items():
            siblings[key[:-1], frozenset(below), _wild(key[-1])].append((key[-1], good, bad))
        names = {(parent, s): name for (parent, _, _), members in siblings.items() for s, name in merged(members).items()}
        for path in rest:
            if len(path) >= d:
                rest[path] = names[path[: d - 1], path[d - 1]] + "/" + rest[path]
    return rest


def _deep(frame: pd.DataFrame, rounds: int) -> pd.DataFrame:
    """Steps 2 and 3 for the levels below one node; its branches that reach no such level are left as they are."""
    trees = [list(t[rounds:]) for t in frame["tree"]]
    for d in range(max(map(len, trees))):
        kinds: dict[tuple[str, ...], dict[str, int]] = defaultdict(lambda: defaultdict(int))
        for t, n in zip(trees, frame["n"]):
            if len(t) > d:
                kinds[tuple(t[:d])][t[d]] += n
        crowded = {k for k, c in kinds.items() if len(c) >= LEAST_CHILDREN and sum(c.values()) <= len(c) * MOST_REPEATS}
        for t in trees:
            if len(t) > d and tuple(t[:d]) in crowded:
                t[d] = "*"
    sums: dict[tuple[str, ...], list[float]] = defaultdict(lambda: [0.0, 0.0])
    for t, good, bad in zip(trees, frame["good"], frame["bad"]):
        sums[tuple(t)][0] += good
        sums[tuple(t)][1] += bad
    rest = merge_tree([(t, *gb) for t, gb in sums.items()])
    return frame.assign(rest=[rest[tuple(t)] for t in trees])


def named(tree: DataFrame) -> DataFrame:
    """(host, path, template, n, good, bad): step 3 for the rows of ``generalised``."""
    schema = "host string, path array<string>, tree array<string>, n long, good double, bad double, rest string"
    short = tree.where(F.size("tree") <= ROUNDS).withColumn("rest", F.lit(""))
    long = tree.where(F.size("tree") > ROUNDS)
    if not long.isEmpty():
        rounds = ROUNDS
        short = short.unionByName(long.groupBy("host", F.slice("tree", 1, rounds)).applyInPandas(lambda f: _deep(f, rounds), schema))
    now = checkpoint(short)
    for d in range(min(ROUNDS, now.agg(F.max(F.size("tree"))).first()[0] or 0), 0, -1):
        node = F.slice("tree", 1, d)
        below = now.where(F.size("tree") >= d).groupBy("host", node.alias("node"), "rest").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        # nodes with the same set of templates below them have the same number of them and sums of hashes
        shape = [F.count("*").alias("below"), F.sum(F.xxhash64("rest").cast("decimal(38,0)")).alias("h1"), F.bit_xor(F.xxhash64("rest", F.lit(1))).alias("h2")]
        nodes = below.groupBy("host", "node").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), *shape)
        last = F.element_at("node", -1)
        wild = F.when(last.startswith("*") | last.startswith("{"), last).otherwise("")
        alike = nodes.groupBy("host", F.slice("node", 1, d - 1).alias("parent"), "below", "h1", "h2", wild.alias("wild")).agg(F.collect_list(F.struct(last.alias("s"), "good", "bad")).alias("members"))
        names = checkpoint(alike.where(F.size("members") > 1).select("host", "parent", "members").mapInArrow(_names, "t_host string, t_node array<string>, t_name string"))
        plain = F.element_at("tree", d)
        if names.isEmpty():
            now = now.withColumn("rest", F.when(F.size("tree") >= d, F.concat(plain, F.lit("/"), "rest")).otherwise(F.col("rest")))
            continue
        joined = now.join(small(names, 300), (F.size("tree") >= d) & (F.col("host") == F.col("t_host")) & (node == F.col("t_node")), "left")
        now = checkpoint(joined.withColumn("rest", F.when(F.size("tree") >= d, F.concat(F.coalesce("t_name", plain), F.lit("/"), "rest")).otherwise(F.col("rest"))).select(*now.columns))
    template = F.when(F.col("host") == "", F.lit("")).otherwise(F.concat(F.lit("/"), F.regexp_replace("rest", "/$", "")))
    return now.select("host", "path", template.alias("template"), "n", "good", "bad")


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for host, parent, members in zip(*(c.to_pylist() for c in batch.columns)):
            got = merged([(m["s"], m["good"], m["bad"]) for m in members])
            rows += [(host, [*parent, s], name) for s, name in got.items() if s != name]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.list_(pa.string()), pa.string()))], names=["t_host", "t_node", "t_name"])


def templates(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, host, template, pages, labelled, purity, rejected) of every page. labels: (page_id, good 0 or 1)."""
    urls = parsed(pages)
    mark = labels.where("page_id is not null and good is not null").groupBy(F.col("page_id").alias("l_id")).agg(F.min("good").cast("int").alias("good"))
    known = urls.join(mark, F.col("page_id") == F.col("l_id"), "left")
    paths = known.groupBy("host", "path").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("double").alias("good"), F.coalesce(F.sum(1 - F.col("good")), F.lit(0)).cast("double").alias("bad"))
    tree = generalised(paths)
    of_path = checkpoint(named(tree))
    stats = of_path.groupBy("host", "template").agg(F.sum("n").alias("pages"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    whole = of_path.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).first()
    share = whole["g"] / (whole["g"] + whole["b"]) if whole["g"] is not None and whole["g"] + whole["b"] else 1.0
    purity = F.round((F.col("good") + F.lit(PRIOR * share)) / (F.col("good") + F.col("bad") + PRIOR), 6)
    judged = stats.select("host", "template", "pages", (F.col("good") + F.col("bad")).cast("long").alias("labelled"), purity.alias("purity"), (purity < LEAST_PURITY).alias("rejected"))
    verdict = checkpoint(of_path.select("host", "path", "template").join(judged, ["host", "template"]))
    return urls.join(small(verdict, 300), ["host", "path"]).select("page_id", "host", "template", "pages", "labelled", "purity", "rejected")
