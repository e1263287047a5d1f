"""Traces of answered requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.operators.evidence import gathered


def traces(answers: DataFrame, hits: DataFrame, request_id: str | None = None, filters: dict[str, str | None] | None = None) -> DataFrame:
    """One trace for each answer: a new id unless one is given, the time in UTC, filters, decision, answer and hits."""
    given = [x for k, v in (filters or {}).items() for x in (F.lit(k), F.lit(v).cast("string"))]
    out = gathered(answers, hits)
    reply = F.struct("query", "answer", "is_answered", "refusal_reason", "citations", "usage", "cost")
    return out.select(
        (F.lit(request_id) if request_id else F.uuid()).alias("request_id"),
        F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("created_at_utc"),
        "query", (F.create_map(*given) if given else F.create_map().cast("map<string,string>")).alias("filters"), "sufficiency", reply.alias("answer_response"),
        F.transform("hits", lambda h: F.struct(h["point_id"].alias("point_id"), h["score"].alias("score"), h["payload"].alias("payload"))).alias("retrieval_results"),
    )
