"""Claims in words held against the units of a graph."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import case, r6
from lodestone.functions.nearest import by_length, closest
from lodestone.state import checkpoint

#: English words that name nothing, even in back-ticks.
STOP = tuple(
    "a about above after again all an and are as at be because been before being below between both but by can could did do does down during each every few for from further "
    "had has have he her here him his how i if in into is it its just may me might more most must my no nor not of off on once only or other our out over own same shall she should "
    "so some such than that the their them then there these they this those through to too under up us very was we were what when where which while who whom why will with would you your".split()
)
SNAKE, SCREAM = r"^[a-z][a-z0-9]*(_[a-z0-9]+)+$", r"^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$"
#: All three hold for a CamelCase word: letters and digits, two capitals, a small letter after the first.
CAMEL = (r"^[A-Z][A-Za-z0-9]+$", r"[A-Z].*[A-Z]", r"^.+[a-z]")


def references(text: Column) -> Column:
    """Array of names: all in back-ticks, as often as they are, then the snake_case, CamelCase and SCREAMING_CASE words that aren't among them, each once."""
    lower_stop = lambda w: F.lower(w).isin(*STOP)
    ticked = F.filter(F.transform(F.regexp_extract_all(text, F.lit("`([^`]*)`"), F.lit(1)), lambda x: F.trim(x)), lambda x: (x != "") & ~lower_stop(x))
    words = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_]+)"), F.lit(1))
    camel = lambda w: w.rlike(CAMEL[0]) & w.rlike(CAMEL[1]) & w.rlike(CAMEL[2])
    known = F.filter(words, lambda w: (w.rlike(SNAKE) | camel(w) | w.rlike(SCREAM)) & ~lower_stop(w))
    return F.concat(ticked, F.array_except(known, ticked))


def exploded(claims: DataFrame) -> DataFrame:
    """(claim_id, ref) of claims (claim_id, text)."""
    return claims.select("claim_id", F.explode(references(F.col("text"))).alias("ref"))


def _keys(units: DataFrame) -> DataFrame:
    """(id, key, tier): the ways by which a unit is found."""
    last = F.regexp_extract("qualified_name", r"([A-Za-z0-9_]+)$", 1)
    return units.select("id", F.explode(F.array(F.struct(F.col("name").alias("key"), F.lit(1).alias("tier")), F.struct(last.alias("key"), F.lit(2).alias("tier")), F.struct(F.lower("name").alias("key"), F.lit(3).alias("tier")))).alias("k")).select("id", "k.*")


def tiers(refs: DataFrame, units: DataFrame) -> DataFrame:
    """(ref, key, tier) of each reference that has evidence: by the exact name (1), the last part of the qualified name (2) or the name in any case (3).

    Distinct references meet distinct keys, so popular names aren't multiplied.
    """
    asked = refs.select("ref").distinct().select("ref", F.explode(F.array(*(F.struct(k.alias("key"), F.lit(t).alias("tier")) for t, k in enumerate((F.col("ref"), F.col("ref"), F.lower("ref")), 1)))).alias("k")).select("ref", "k.*")
    have = _keys(units).select("key", "tier").distinct()
    return asked.join(have, ["key", "tier"], "left_semi").groupBy("ref").agg(F.min(F.struct("tier", "key")).alias("b")).select("ref", "b.key", "b.tier")


def find_evidence(refs: DataFrame, units: DataFrame) -> DataFrame:
    """(claim_id, ref, id, tier): the units of the first tier that has any.

    The rows are as many as claims and units of a name multiply to, so they are made by a shuffle that streams them, never from a broadcast side.
    """
    asked = checkpoint(refs.distinct())
    found = checkpoint(tiers(asked, units).join(_keys(units), ["key", "tier"]).select("ref", "id", "tier").distinct())
    return asked.join(found.hint("merge"), "ref").select("claim_id", "ref", "id", "tier")


def ground(claims: DataFrame, units: DataFrame) -> DataFrame:
    """(claim_id, refs, matched, verdict, confidence) of claims (claim_id, text)."""
    asked = checkpoint(claims.select("claim_id", references(F.col("text")).alias("names")))  # texts are searched once, and what follows is a short plan
    refs = asked.select("claim_id", F.explode("names").alias("ref"))
    found = refs.join(tiers(refs, units).select("ref"), "ref", "left_semi").groupBy("claim_id").agg(F.count("*").alias("matched"))
    n = asked.select("claim_id", F.size("names").cast("long").alias("refs")).join(found, "claim_id", "left").na.fill(0, ["matched"])
    some = F.col("refs") > 0
    verdict = case([(~some, "ungrounded"), (F.col("matched") == F.col("refs"), "verified"), (F.col("matched") == 0, "ungrounded")], "partial")
    return n.select("claim_id", "refs", "matched", verdict.alias("verdict"), r6(F.when(some, F.col("matched") / F.when(some, F.col("refs"))).otherwise(0.0)).alias("confidence"))


def _missing(refs: DataFrame, units: DataFrame) -> DataFrame:
    return refs.distinct().join(tiers(refs, units).select("ref"), "ref", "left_anti").select("claim_id", "ref")


def suggestions(claims: DataFrame, units: DataFrame, limit: int = 3) -> DataFrame:
    """(claim_id, names): for claims that aren't verified, the names suggested for their references without evidence, sorted, each once."""
    missing = checkpoint(_missing(exploded(claims), units))
    return missing.join(suggest(missing, units, limit), "ref").groupBy("claim_id").agg(F.array_sort(F.collect_set("name")).alias("names"))


def prefixed(names: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref, name) where one begins with the other, in any case: equality joins on beginnings of the lengths that there are."""
    names, refs = names.select("name", F.lower("name").alias("n")), refs.select("ref", F.lower("ref").alias("r"))
    # a row for each length, so at most as many as the longest name has characters
    longer = names.join(F.broadcast(refs.select(F.length("r").alias("k")).distinct()), F.length("n") >= F.col("k")).select("name", F.expr("substring(n, 1, k)").alias("r"))
    shorter = refs.join(F.broadcast(names.select(F.length("n").alias("k")).distinct()), F.length("r") > F.col("k")).select("ref", F.expr("substring(r, 1, k)").alias("n"))
    return longer.join(refs, "r").select("ref", "name").unionAll(names.join(shorter, "n").select("ref", "name"))


def suggest(refs: DataFrame, units: DataFrame, limit: int = 3) -> DataFrame:
    """(ref, name, distance, relevance): unit names that begin like it (0), or are within half its length by Levenshtein distance.

    Names that begin alike are found by equality; only references with too few of them are searched for. A distance of half the length leaves no key that
    both must share, so each of these meets all names: blocks of sorted names and of references in pairs, a pair in a step of bounded memory.
    """
    asked, have = checkpoint(refs.select("ref").distinct()), checkpoint(units.select("name").distinct())
    first = lambda pairs: pairs.withColumn("k", F.row_number().over(Window.partitionBy("ref").orderBy("distance", "name"))).where(F.col("k") <= limit)
    alike = checkpoint(first(prefixed(have, asked).distinct().withColumn("distance", F.lit(0))).drop("k"))
    rest = asked.join(alike.groupBy("ref").agg(F.count("*").alias("n")).where(F.col("n") >= limit), "ref", "left_anti")
    pairs = alike.unionByName(nearest(have, rest, limit)).groupBy("ref", "name").agg(F.min("distance").alias("distance"))
    return first(pairs).select("ref", "name", "distance", r6(1 - 0.1 * (F.col("k") - 1)).alias("relevance"))


#: Names of a block, and references of one.
NAMES, REFS = 100_000, 1024


def _blocks(df: DataFrame, rows: int) -> DataFrame:
    """Rows of arrays of at most so many rows, in their order."""
    to = pa.schema([(c, pa.list_(pa.string())) for c in df.columns])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[str]] = [[] for _ in to]
        for b in batches:
            for at in range(0, b.num_rows, rows):
                for h, c in zip(held, b.slice(at, rows).columns):
                    h += c.to_pylist()
                while len(held[0]) >= rows:
                    yield pa.RecordBatch.from_arrays([pa.array([h[:rows]], t) for h, t in zip(held, to.types)], schema=to)
                    held = [h[rows:] for h in held]
        if held[0]:
            yield pa.RecordBatch.from_arrays([pa.array([h], t) for h, t in zip(held, to.types)], schema=to)

    return df.mapInArrow(pack, ", ".join(f"{c} array<string>" for c in df.columns))


def nearest(names: DataFrame, refs: DataFrame, limit: int) -> DataFrame:
    """(ref, name, distance): of each block of names those nearest to a reference by Levenshtein distance in any case, of 1 to half its length; the first so many by distance and name."""
    spark = names.sparkSession
    sorted_names = names.select("name", F.lower("name").alias("n"))
    sorted_names = checkpoint(_blocks(sorted_names.repartitionByRange(max(1, -(-names.count() // NAMES)), "n", "name").sortWithinPartitions("n", "name"), NAMES))
    asked = refs.select("ref", F.lower("ref").alias("r"), F.floor(F.length("ref") / 2).cast("string").alias("most"))
    asked = _blocks(asked.repartition(max(spark.sparkContext.defaultParallelism, -(-refs.count() // (4 * REFS))), "ref"), REFS)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for b in batches:
            for ref, r, most, name, n, block in zip(*b.columns):
                if block.as_py() != now:
                    now, parts = block.as_py(), by_length(n.as_py(), name.as_py())
                rows = [(x, *hit) for x, low, m in zip(ref.as_py(), r.as_py(), most.as_py()) for hit in closest(parts, low, int(m), limit)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((), (), ()), (pa.string(), pa.string(), pa.int32()))], ["ref", "name", "distance"])

    pairs = asked.join(sorted_names.withColumn("block", F.monotonically_increasing_id()).hint("shuffle_replicate_nl"))  # each task has one block of names
    return pairs.mapInArrow(search, "ref string, name string, distance int")


def cite(claims: DataFrame, units: DataFrame) -> DataFrame:
    """(claim_id, ref, id, strength): direct by the exact name, strong by the qualified name, partial in another case."""
    return find_evidence(exploded(claims), units).select("claim_id", "ref", "id", case([(F.col("tier") == 1, "direct"), (F.col("tier") == 2, "strong")], "partial").alias("strength"))


def contradictions(claims: DataFrame, units: DataFrame) -> DataFrame:
    """(claim_id, ref, kind) of references without evidence: contradicted if a name begins alike or is within a third of its length, else not_found."""
    missing = checkpoint(_missing(exploded(claims), units))
    close = suggest(missing, units, 1).where((F.col("distance") == 0) | (F.col("distance") <= F.floor(F.length("ref") / 3))).select("ref", F.lit(True).alias("c"))
    return missing.join(close, "ref", "left").select("claim_id", "ref", F.when(F.col("c"), "contradicted").otherwise("not_found").alias("kind"))


def sentences(outputs: DataFrame) -> DataFrame:
    """(claim_id, k, text): sentences end with a line, or with a full stop before white space, so that paths of files stay whole."""
    parts = F.transform(F.split(F.regexp_replace("text", r"\.(\s|$)", "\n"), "\n"), lambda x: F.trim(x))
    return outputs.select("claim_id", F.posexplode(F.filter(parts, lambda s: F.length(s) > 5)).alias("k", "text"))


def hallucinated(outputs: DataFrame, units: DataFrame) -> DataFrame:
    """(claim_id, k, ref, kind, severity, file) of references in sentences that aren't grounded: without a unit of that name in any case, or said to be in another file."""
    refs = sentences(outputs).withColumn("ref", F.explode(references(F.col("text"))))
    known = refs.join(tiers(refs, units).select("ref", F.lit(1).alias("e")), "ref", "left")
    bad = known.groupBy("claim_id", "k").agg(F.count("*").alias("n"), F.count("e").alias("m")).where("m < n").select("claim_id", "k")
    exact = units.groupBy(F.col("name").alias("ref")).agg(F.min(F.struct("id", "file_path")).alias("x")).select("ref", F.col("x.file_path").alias("f1"))
    lower = units.groupBy(F.lower("name").alias("low")).agg(F.min(F.struct("id", "file_path")).alias("x")).select("low", F.col("x.file_path").alias("f2"))
    j = refs.join(bad, ["claim_id", "k"], "left_semi").withColumn("low", F.lower("ref")).join(exact, "ref", "left").join(lower, "low", "left").withColumn("file", F.coalesce("f1", "f2"))
    places = F.filter(F.transform(F.split("text", r"\s+"), lambda w: F.regexp_replace(w, r"^[^A-Za-z0-9/._]+|[^A-Za-z0-9/._]+$", "")), lambda w: w.contains("/") & w.contains("."))
    speaks = F.lower("text").contains("in ") | F.lower("text").contains("file")
    moved = speaks & F.exists(places, lambda w: ~F.col("file").contains(w))
    kind = F.when(F.col("file").isNull(), "non_existent").when(moved, "wrong_location")
    return j.withColumn("kind", kind).where("kind is not null").select("claim_id", "k", "ref", "kind", F.when(F.col("kind") == "non_existent", "severe").otherwise("moderate").alias("severity"), "file")


def hallucinations(outputs: DataFrame, units: DataFrame) -> DataFrame:
    """(claim_id, claims, missing, misplaced, score, safe) of every text: its sentences with references, and what is wrong in them."""
    n = sentences(outputs).where(F.size(references(F.col("text"))) > 0).groupBy("claim_id").agg(F.count("*").alias("claims"))
    kinds = hallucinated(outputs, units).groupBy("claim_id").agg(F.count_if(F.col("kind") == "non_existent").alias("missing"), F.count_if(F.col("kind") == "wrong_location").alias("misplaced"))
    a = outputs.select("claim_id").join(n, "claim_id", "left").join(kinds, "claim_id", "left").na.fill(0)
    raw = F.when(F.col("claims") > 0, (F.col("missing") + F.col("misplaced")) / F.when(F.col("claims") > 0, F.col("claims"))).otherwise(0.0)
    return a.select("claim_id", "claims", "missing", "misplaced", r6(F.least(F.lit(1.0), raw)).alias("score"), (raw < 0.3).alias("safe"))


def fixes(outputs: DataFrame, units: DataFrame, most: int = 5) -> DataFrame:
    """(claim_id, k, ref, fix): names that begin alike, or none, instead of what doesn't exist; the file of what is elsewhere."""
    found = hallucinated(outputs, units)
    like = prefixed(units.select("name").distinct(), found.where("kind = 'non_existent'").select("ref").distinct()).distinct()
    best = like.withColumn("i", F.row_number().over(Window.partitionBy("ref").orderBy("name"))).where(F.col("i") <= most).groupBy("ref").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
    text = case([(F.col("kind") == "wrong_location", F.concat(F.lit("actually in "), "file")), (F.col("names").isNotNull(), F.concat(F.lit("replace by one of: "), "names"))], F.lit("remove"))
    return found.join(best, "ref", "left").select("claim_id", "k", "ref", text.alias("fix")).distinct()


def check(claims: DataFrame, units: DataFrame) -> DataFrame:
    """(claim_id, status): valid if all that a claim names is there, deleted if nothing is, else stale."""
    g = ground(claims, units)
    return g.select("claim_id", case([(F.col("verdict") == "verified", "valid"), (F.col("matched") == 0, "deleted")], "stale").alias("status"))


def register(claims: DataFrame, at: int) -> DataFrame:
    """(claim_id, text, established_at, status, invalidated_at): truths to be maintained."""
    return claims.select("claim_id", "text", F.lit(at).cast("long").alias("established_at"), F.lit("valid").alias("status"), F.lit(None).cast("long").alias("invalidated_at"))


def refresh(truths: DataFrame, units: DataFrame, at: int) -> DataFrame:
    """The truths against a graph of now: those that were valid change their status; what was invalid before stays as it was.

    The truths are written once, as they are read twice: else each refresh would multiply the plan of those before it.
    """
    truths = checkpoint(truths)
    now = check(truths.select("claim_id", "text"), units).withColumnRenamed("status", "now")
    turned = (F.col("status") == "valid") & (F.col("now") != "valid")
    return truths.join(now, "claim_id").select("claim_id", "text", "established_at", F.when(turned, F.col("now")).otherwise(F.col("status")).alias("status"), F.when(turned, F.lit(at).cast("long")).otherwise(F.col("invalidated_at")).alias("invalidated_at"))


def truth_diff(truths: DataFrame) -> DataFrame:
    """The truths that hold no more."""
    return truths.where("status <> 'valid'")
