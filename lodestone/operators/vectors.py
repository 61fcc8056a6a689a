"""Nearest vectors by exact cosine, in the JVM; a query of one vector is broadcast, a top k is taken without a full sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import cosine, r6


def search(vectors: DataFrame, query: Sequence[float], top: int, least: float, types: Sequence[str] = (), languages: Sequence[str] = ()) -> DataFrame:
    """(vec_id, score) against one vector; an empty query is an error, top 0 is all. Types and languages, if given, select by the columns of these names."""
    if not len(query):
        raise ValueError("the query vector is empty")
    vectors = vectors.where(F.col("unit_type").isin(*types)) if types else vectors
    vectors = vectors.where(F.col("language").isin(*languages)) if languages else vectors
    q = F.array(*(F.lit(float(x)) for x in query))
    out = vectors.select("vec_id", r6(cosine(F.col("embedding"), q)).alias("score")).where(F.col("score") >= least)
    return out.orderBy(F.desc("score"), "vec_id").limit(top) if top else out


def index_search(vectors: DataFrame, query: Sequence[float], top: int, least: float) -> DataFrame:
    """As an index answers: vectors of another length or without a norm are left out, a query without a norm or top 0 gives nothing."""
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    if top == 0 or not any(query):
        return vectors.select("vec_id", F.lit(0.0).alias("score")).limit(0)
    return search(vectors.where((F.size("embedding") == len(query)) & (norm > 1e-20)), query, top, least)


def similar(vectors: DataFrame, vec_id: int, top: int, least: float) -> DataFrame:
    """(vec_id, score) of the vectors nearest to one of them, itself left out."""
    row = vectors.where(F.col("vec_id") == vec_id).select("embedding").first()
    if row is None:
        raise LookupError(f"vector {vec_id} isn't there")
    return search(vectors.where(F.col("vec_id") != vec_id), row["embedding"], top, least)
