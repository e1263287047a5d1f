"""Retrieval evaluation: declarative cases against hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.operators.evidence import any_in, gathered, hit_text, joined_text


def shown(value: Column) -> Column:
    """A string as a quoted literal in the messages' style; None for null."""
    plain = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    double = F.contains(value, F.lit("'")) & ~F.contains(value, F.lit('"'))
    single = F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(value.isNull(), "None").when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(single)


def shown_list(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, shown), ", "), F.lit("]"))


def failures(expected: Column, hits: Column) -> Column:
    """Messages of the checks that fail, in the checks' order; a null or empty expectation is no check."""
    n = F.size(hits)
    least = F.coalesce(expected["min_results"], F.lit(1))
    out = [F.when(n < least, F.concat(F.lit("Expected at least "), least, F.lit(" results, got "), n))]
    for field, wanted in (("release_label", expected["expected_release_label"]), ("source_kind", expected["expected_source_kind"])):
        other = F.transform(F.filter(hits, lambda h: ~h["payload"][field].eqNullSafe(wanted)), lambda h: h["payload"][field])
        out.append(F.when(wanted.isNotNull() & (F.size(other) > 0), F.concat(F.lit(f"Found results with unexpected {field} values: "), shown_list(other))))
    markers, top = expected["expected_text_contains_any"], expected["expected_top1_contains_any"]
    asks = lambda m: F.coalesce(F.size(m) > 0, F.lit(False))
    out.append(F.when(asks(markers) & ~any_in(joined_text(hits), markers), F.concat(F.lit("None of the expected text markers were found: "), shown_list(markers))))
    first = hit_text(F.try_element_at(hits, F.lit(1)))
    unseen = F.lit("Top-1 expectation could not be checked because no results were returned.")
    lacks = F.concat(F.lit("Top-1 result did not contain expected text markers: "), shown_list(top))
    out.append(F.when(asks(top), F.when(n == 0, unseen).when(~any_in(first, top), lacks)))
    return F.array_compact(F.array(*out))


def evaluated(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """Each case with its outcome; cases without hits stay."""
    out = gathered(cases, hits, "case_id").withColumn("failures", failures(F.col("expectation"), F.col("hits")))
    expect = F.coalesce("expectation.expected_to_pass", F.lit(True))
    passed = F.size("failures") == 0
    return out.withColumns({
        "passed": passed, "expected_to_pass": expect, "outcome_as_expected": passed == expect, "result_count": F.size("hits"),
    })


def report(cases: DataFrame) -> DataFrame:
    """Totals over evaluated cases."""
    return cases.agg(
        F.count("*").alias("total_cases"), F.count_if("passed").alias("passed_count"), F.count_if("outcome_as_expected").alias("expected_outcome_count")
    )
