"""The evidence-sufficiency gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gathered(queries: DataFrame, hits: DataFrame, key: str = "query_id") -> DataFrame:
    """Each row of ``queries`` with its hits as an array in rank order (empty if it has none)."""
    hit = F.struct("rank", "point_id", "score", "payload")
    by = hits.groupBy(key).agg(F.sort_array(F.collect_list(hit)).alias("hits"))
    none = F.array().cast(by.schema["hits"].dataType)
    return queries.join(by, key, "left").withColumn("hits", F.coalesce("hits", none))


def hit_text(hit: Column) -> Column:
    """A hit's text; an explicit null reads as the word None."""
    return F.coalesce(hit["payload"]["text"], F.lit("None"))


def joined_text(hits: Column) -> Column:
    return F.array_join(F.transform(hits, hit_text), "\n")


def any_in(text: Column, markers: Column) -> Column:
    return F.coalesce(F.exists(markers, lambda m: F.contains(text, m)), F.lit(False))


def sufficiency(hits: Column, min_results: int = 1, min_top_score: float = 0.30, markers: list[str] | None = None) -> Column:
    """A struct (is_sufficient, reason, result_count, top_score); the first rule that fails gives the reason."""
    if min_results <= 0:
        raise ValueError("min_results must be greater than 0")
    if min_top_score < 0:
        raise ValueError("min_top_score must be non-negative")
    n, top = F.size(hits), F.try_element_at(hits, F.lit(1))["score"]
    few = F.concat(F.lit(f"Expected at least {min_results} results, got "), n, F.lit("."))
    low = F.concat(F.lit("Top score "), top, F.lit(f" is below required threshold {min_top_score}."))
    reason = F.when(n < min_results, few).when(top < min_top_score, low)
    if markers:
        lacks = ~any_in(joined_text(hits), F.array(*[F.lit(m) for m in markers]))
        reason = reason.when(lacks, F.lit("Retrieved evidence does not contain required text markers."))
    return F.struct(
        reason.isNull().alias("is_sufficient"), F.coalesce(reason, F.lit("Retrieved evidence passed baseline sufficiency checks.")).alias("reason"),
        n.alias("result_count"), top.alias("top_score"),
    )


def assess(queries: DataFrame, hits: DataFrame, key: str = "query_id", **rules) -> DataFrame:
    """(key, is_sufficient, reason, result_count, top_score) for each query."""
    return gathered(queries.select(key), hits, key).select(key, sufficiency(F.col("hits"), **rules).alias("s")).select(key, "s.*")
