import re
import sys
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lodestone.llm import urls as U

sys.setrecursionlimit(20_000)


def shape(s):
    s = s.lower()
    if m := re.fullmatch(r"[0-9]+(\.[a-z][a-z0-9]*)?", s):
        return "{n}" + (m[1] or "")
    if m := re.fullmatch(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}(\.[a-z0-9]+)?", s):
        return "{uuid}" + (m[1] or "")
    m = re.fullmatch(r"([0-9a-f]{8,})(\.[a-z0-9]+)?", s)
    return "{hex}" + (m[2] or "") if m and re.match("[a-f]*[0-9]", s) else s


def brute(pages, labels):
    """The definition on one machine, by nested dictionaries and recursion."""
    mark = {}
    for i, g in labels:
        if i is not None and g is not None:
            mark[i] = min(g, mark.get(i, 1))
    rows = []
    for i, u in pages:
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)", u or "")
        host = re.sub(r"^www\.", "", re.sub(r":.*", "", m[1].rpartition("@")[2]).lower()) if m else ""
        segments = [s for s in m[2].split("/") if s] if m and host else []
        rows.append((i, host, [shape(s) for s in segments]))
    for d in range(max((len(p) for *_, p in rows), default=0)):
        count = defaultdict(Counter)
        for _, h, p in rows:
            if len(p) > d:
                count[h, *p[:d]][p[d]] += 1
        wild = {k for k, c in count.items() if len(c) >= U.LEAST_CHILDREN and sum(c.values()) <= U.MOST_REPEATS * len(c)}
        rows = [(i, h, [*p[:d], "*", *p[d + 1 :]] if len(p) > d and (h, *p[:d]) in wild else p) for i, h, p in rows]

    def build(at):
        node = {"ends": False, "good": 0, "bad": 0, "kids": {}}
        by = defaultdict(list)
        for p, g in at:
            node["good"] += g == 1
            node["bad"] += g == 0
            node["ends"] |= not p
            if p:
                by[p[0]].append((p[1:], g))
        node["kids"] = {s: build(x) for s, x in by.items()}
        return node

    def settle(node):
        """Names of the paths below a node: {path: named path}; and its set of templates."""
        below = {s: settle(k) for s, k in node["kids"].items()}
        alike = defaultdict(list)
        for s in node["kids"]:
            alike[frozenset(below[s][1]), s if s[0] in "*{" else ""].append(s)
        names = {}
        for members in alike.values():
            counts = {s: (node["kids"][s]["good"], node["kids"][s]["bad"]) for s in members}
            known = sorted((s for s in members if sum(counts[s])), key=lambda s: ((counts[s][0] + 1) / (sum(counts[s]) + 2), (s,)))
            groups = []
            for s in known:
                if groups and U.similar(groups[-1][1], counts[s]):
                    groups[-1] = ([*groups[-1][0], s], tuple(a + b for a, b in zip(groups[-1][1], counts[s])))
                else:
                    groups.append(([s], counts[s]))
            rest = [s for s in members if not sum(counts[s])]
            if rest:
                groups[:1] = [([*groups[0][0], *rest], groups[0][1])] if groups else [(rest, (0, 0))]
            for group, _ in groups:
                for s in group:
                    names[s] = group[0] if len(group) == 1 else "(" + "|".join(sorted(group)) + ")"
        paths = {(s, *p): (names[s], *q) for s, (ps, _) in below.items() for p, q in ps.items()}
        if node["ends"]:
            paths[()] = ()
        return paths, set(paths.values())

    named = {}
    for h in {h for _, h, _ in rows}:
        for p, q in settle(build([(p, mark.get(i)) for i, x, p in rows if x == h]))[0].items():
            named[h, p] = "/" + "/".join(q) if h else ""
    good, bad, n = Counter(), Counter(), Counter()
    for i, h, p in rows:
        key = h, named[h, tuple(p)]
        n[key] += 1
        good[key] += mark.get(i) == 1
        bad[key] += mark.get(i) == 0
    share = sum(good.values()) / max(1, sum(good.values()) + sum(bad.values())) if sum(good.values()) + sum(bad.values()) else 1.0
    out = []
    for i, h, p in rows:
        key = h, named[h, tuple(p)]
        purity = (good[key] + U.PRIOR * share) / (good[key] + bad[key] + U.PRIOR)
        out.append((i, *key, n[key], good[key] + bad[key], round(purity, 4), round(purity, 6) < U.LEAST_PURITY))
    return sorted(out, key=str)


def got(df, labels):
    return sorted(((r["page_id"], r["host"], r["template"], r["pages"], r["labelled"], round(r["purity"], 4), r["rejected"]) for r in U.templates(df, labels).collect()), key=str)


def test_brute_force(spark, sf):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    assert got(pages, labels) == brute([(r["page_id"], r["url"]) for r in pages.collect()], [tuple(r) for r in labels.collect()])


def test_odd_rows(spark):
    rows = [(k, f"https://www.Shop.example:8080/item/{'abc'[k % 3]}/name-{k}?q=1#x") for k in range(60)]
    rows += [(100 + k, f"http://shop.example/spam/{k}.html") for k in range(40)]
    rows += [(200, None), (201, ""), (202, "no url"), (203, "http://"), (204, "http://user:pw@h.example"), (205, "http://h.example/"), (205, "http://h.example/"), (None, "http://h.example/x"), (206, "HTTP://H.example/" + "a/" * 5000), (207, "http://h.example/550e8400-e29b-41d4-a716-446655440000.png"), (208, "http://h.example/deadbeef01"), (209, "http://h.example/%zz/ü")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "tree", "template", "good", "n", "l_id")})
    marks = [(k, 1) for k in range(30)] + [(100 + k, 0) for k in range(35)] + [(None, 0), (5, None), (3, 0), (204, 1)]
    labels = spark.createDataFrame(marks, "page_id long, good int").withColumn("url", F.lit("y"))
    out = got(pages, labels)
    assert out == brute(rows, marks)
    by = {r[0]: r for r in out}
    assert by[0][2] == "/item/(a|b|c)/*" and not by[0][6] and by[100][2] == "/spam/{n}.html" and by[100][6]
    assert by[200][1:3] == ("", "") and by[204][1:3] == ("h.example", "/")
    assert got(pages, labels.limit(0)) == brute(rows, []) and got(pages.limit(0), labels) == []


def test_deep_paths(spark, monkeypatch):
    deep = "/".join(f"d{k}" for k in range(30))
    rows = [(k, f"http://h.example/{deep}/{'abc'[k % 3]}/x-{k}-y/{deep}") for k in range(60)] + [(100 + k, f"http://h.example/{deep}/spam/p{k % 3}") for k in range(40)]
    marks = [(k, 1) for k in range(50)] + [(100 + k, 0) for k in range(40)]
    pages, labels = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(marks, "page_id long, good int")
    want = brute(rows, marks)
    assert got(pages, labels) == want and {r[2] for r in want} == {f"/{deep}/(a|b|c)/*/{deep}", f"/{deep}/spam/(p0|p1|p2)"}
    shallow = [(k, f"http://h.example/a/{'bcd'[k % 3]}/{k % 7}x/e{k % 2}") for k in range(70)] + rows[:20]
    pages = spark.createDataFrame(shallow, "page_id long, url string")
    want = brute(shallow, marks)
    for rounds in (1, 2, 12):
        monkeypatch.setattr(U, "ROUNDS", rounds)
        assert got(pages, labels) == want


def test_branches_without_labels_beside_groups_that_differ():
    path = lambda s: (s, "{n}")
    rows = [(path("spam"), 0.0, 60.0), (path("blog"), 60.0, 0.0), (path("docs"), 0.0, 0.0), (path("help"), 0.0, 0.0)]
    got = U.merge_tree(rows)
    assert got == {path("spam"): "spam/{n}/", path("blog"): "blog/{n}/", path("docs"): "(docs|help)/{n}/", path("help"): "(docs|help)/{n}/"}
    assert set(U.merge_tree(rows[1:]).values()) == {"(blog|docs|help)/{n}/"}  # one labelled group
    assert set(U.merge_tree(rows[2:]).values()) == {"(docs|help)/{n}/"}
