"""From hits to cited answers: citations, prompt, completion, validation, refusal, cost."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.config import Settings
from stratalens.operators import shared
from stratalens.operators.evidence import gathered, sufficiency
from stratalens.schemas import CITATION

# The instructions and the texts of refusals.
SYSTEM_PROMPT = """You are a grounded enterprise functional specification assistant.

Rules:
1. Answer only using the provided evidence.
2. Do not use outside knowledge.
3. Do not invent missing facts.
4. If evidence is insufficient, say you cannot answer from indexed evidence.
5. Cite evidence using the provided citation IDs.
6. Preserve release labels when explaining behavior.
7. If evidence comes from tables, mention that when useful.
"""
USER_PROMPT = """User question:
{query}

Evidence sufficiency:
- is_sufficient: {is_sufficient}
- reason: {reason}
- top_score: {top_score}

Evidence:
{evidence}

Task:
Answer the user question using only the evidence above.
If the evidence is insufficient, say that the indexed evidence is insufficient and do not invent details.
Include citations like [C1], [C2] next to supported claims.
"""
REFUSAL = (
    "I could not find sufficient evidence in the indexed documents to answer this confidently. "
    "The information may be missing from the indexed text/tables, or it may exist in unsupported content such as embedded attachments, screenshots, or files not currently extracted."
)
INVALID = "I generated an answer, but citation validation failed. To avoid presenting unsupported citations, I am refusing to return the generated answer."
NO_EVIDENCE = "No evidence was provided."

USAGE = "struct<model:string,prompt_tokens:int,completion_tokens:int,total_tokens:int>"


def citations(hits: Column, max_citations: int = 5, preview_chars: int = 240) -> Column:
    """The first hits as citations with a preview of their text; a missing id or text is empty."""
    if max_citations <= 0:
        raise ValueError("max_citations must be greater than 0")
    if preview_chars <= 0:
        raise ValueError("preview_chars must be greater than 0")

    def one(h: Column) -> Column:
        p = h["payload"]
        return F.struct(
            F.coalesce(p["unit_id"], F.lit("")).alias("unit_id"), p["document_family"].alias("document_family"), p["release_label"].alias("release_label"),
            p["source_kind"].alias("source_kind"), h["score"].alias("score"), F.substring(F.coalesce(p["text"], F.lit("")), 1, preview_chars).alias("text_preview"),
        )

    return F.transform(F.slice(hits, 1, max_citations), one)


def _or_none(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("None"))


def evidence_block(cited: Column) -> Column:
    """Each citation as a labelled block; blocks are apart by a blank line."""
    def block(c: Column, i: Column) -> Column:
        lines = [F.concat(F.lit("[C"), i + 1, F.lit("]"))]
        lines += [F.concat(F.lit(f"{f}: "), _or_none(c[f])) for f in ("unit_id", "document_family", "release_label", "source_kind")]
        lines += [F.concat(F.lit("score: "), F.format_string("%.4f", c["score"])), F.concat(F.lit("text: "), c["text_preview"])]
        return F.concat_ws("\n", *lines)

    return F.when(F.size(cited) == 0, NO_EVIDENCE).otherwise(F.array_join(F.transform(cited, block), "\n\n"))


def user_prompt(query: Column, decision: Column, cited: Column) -> Column:
    fields = {
        "query": query, "is_sufficient": F.when(decision["is_sufficient"], "True").otherwise("False"), "reason": decision["reason"],
        "top_score": _or_none(decision["top_score"]), "evidence": evidence_block(cited),
    }
    parts: list[Column] = []
    for piece in USER_PROMPT.split("{"):
        name, brace, rest = piece.partition("}")
        parts += [fields[name], F.lit(rest)] if brace else [F.lit(piece)]
    return F.concat(*parts)


def cited_ids(answer: Column) -> Column:
    """Ids of all citations in order, repeats kept."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"(?Ud)\[C(\d+)\]"), F.lit(1)), lambda n: F.concat(F.lit("C"), n))


def available_ids(cited: Column) -> Column:
    return F.transform(cited, lambda c, i: F.concat(F.lit("C"), i + 1))


def validation(answer: Column, cited: Column, is_answered: Column) -> Column:
    """A struct (is_valid, cited_ids, available_ids, invalid_ids, missing_citation)."""
    ids, have = cited_ids(answer), available_ids(cited)
    invalid = F.filter(ids, lambda i: ~F.array_contains(have, i))
    missing = is_answered & (F.size(cited) > 0) & (F.size(ids) == 0)
    return F.struct(
        ((F.size(invalid) == 0) & ~missing).alias("is_valid"), ids.alias("cited_ids"), have.alias("available_ids"), invalid.alias("invalid_ids"), missing.alias("missing_citation")
    )


def cost(usage: Column, input_price: float, output_price: float) -> Column:
    """A struct (model, input_cost, output_cost, total_cost, currency); costs are null if a token count is."""
    known = usage["prompt_tokens"].isNotNull() & usage["completion_tokens"].isNotNull()
    part = lambda n, price: F.when(known, usage[n] / F.lit(1000.0) * F.lit(float(price)))
    a, b = part("prompt_tokens", input_price), part("completion_tokens", output_price)
    return F.struct(usage["model"].alias("model"), a.alias("input_cost"), b.alias("output_cost"), (a + b).alias("total_cost"), F.lit("USD").alias("currency"))


class ChatProvider(Protocol):
    """Adds ``content`` and ``usage`` to rows that have ``system_prompt`` and ``user_prompt``."""

    def complete(self, rows: DataFrame) -> DataFrame: ...


class ExtractiveStub:
    """Offline default: repeats the first citation's preview and cites it; tokens are words."""

    def complete(self, rows: DataFrame) -> DataFrame:
        words = lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))
        first = F.regexp_extract("user_prompt", r"(?s)\ntext: (.*?)(?:\n\n\[C2\]\n|\n\nTask:\n)", 1)
        out = rows.withColumn("content", F.concat(first, F.lit(" [C1]")))
        a, b = words(F.concat("system_prompt", F.lit(" "), "user_prompt")), words(F.col("content"))
        return out.withColumn("usage", F.struct(F.lit("extractive-stub").alias("model"), a.alias("prompt_tokens"), b.alias("completion_tokens"), (a + b).alias("total_tokens")))


#: Prompts whose completions are written down together in a ledger, and the fields of one.
GROUP, REPLY = 4, ("content", "prompt_tokens", "completion_tokens")


class ChatClient:
    """A remote model: ``connect`` makes, on the executor, a function from (system, user) to (content, prompt tokens, completion tokens).

    With a ``ledger`` (of responses by key, see ``sources.ledger``) a prompt is sent once, whatever is run again, when ``complete`` is called.
    """

    def __init__(self, connect: Callable[[], Callable], model: str = Settings.chat_model, ledger=None) -> None:
        self.connect, self.model, self.ledger = connect, model, ledger

    def complete(self, rows: DataFrame) -> DataFrame:
        connect, model = self.connect, self.model

        def one(client, system: str, user: str) -> tuple:
            reply = client(system, user)
            if reply is None:
                raise RuntimeError("LLM response did not contain choices")
            content, *tokens = reply
            if not (content or "").strip():
                raise RuntimeError("LLM response content was empty")
            return content.strip(), *tokens

        if self.ledger is not None:
            return self._once(rows, one)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            client = connect()
            for b in batches:
                got = [one(client, s, u) for s, u in zip(b["system_prompt"], b["user_prompt"])]
                total = lambda p, c: p + c if p is not None and c is not None else None
                made = [{"model": model, "prompt_tokens": p, "completion_tokens": c, "total_tokens": total(p, c)} for _, p, c in got]
                yield pd.DataFrame({"_key": b["_key"], "content": [g[0] for g in got], "usage": pd.Series(made, dtype=object)})

        keyed = rows.withColumn("_key", F.sha2(F.concat_ws("\n", "query_id", "system_prompt", "user_prompt"), 256))
        replies = keyed.select("_key", "system_prompt", "user_prompt").dropDuplicates(["_key"]).mapInPandas(run, f"_key string, content string, usage {USAGE}")
        return keyed.join(replies, "_key").drop("_key")

    def _once(self, rows: DataFrame, one: Callable) -> DataFrame:
        connect, model = self.connect, self.model

        def asking() -> Callable[[list[str]], list[str]]:
            client = connect()
            return lambda prompts: [json.dumps(dict(zip(REPLY, one(client, *json.loads(p))))) for p in prompts]

        prompt = [F.col("system_prompt"), F.col("user_prompt")]
        keyed = shared.kept(rows.withColumn("_key", self.ledger.key(*prompt)))
        answers = self.ledger.answered(keyed.select(F.col("_key").alias("key"), F.to_json(F.array(*prompt)).alias("request")), asking, GROUP)
        said = F.from_json("response", "content string, prompt_tokens bigint, completion_tokens bigint").alias("r")
        tokens = [F.col("r.prompt_tokens").alias("prompt_tokens"), F.col("r.completion_tokens").alias("completion_tokens")]
        usage = F.struct(F.lit(model).alias("model"), *tokens, (F.col("r.prompt_tokens") + F.col("r.completion_tokens")).alias("total_tokens")).cast(USAGE)
        content = F.coalesce("r.content", F.raise_error(F.lit("The ledger has lost a response")).cast("string")).alias("content")
        joined = keyed.join(answers.select(F.col("key").alias("_key"), said), "_key", "left")
        return joined.select(*rows.columns, content, usage.alias("usage"))


def completed_text(rows: DataFrame, chat: ChatProvider) -> DataFrame:
    """Rows with the completion's text only, in ``content``."""
    return chat.complete(rows).drop("usage")


def grounded_answers(queries: DataFrame, hits: DataFrame, chat: ChatProvider | None = None, settings: Settings = Settings(), **rules) -> DataFrame:
    """One answer for each query (query_id, query): a refusal without any completion if its evidence is
    insufficient, else the completion, or a refusal if its citations are invalid."""
    chat = chat or ExtractiveStub()
    asked = gathered(queries.select("query_id", "query"), hits)
    asked = asked.withColumn("sufficiency", sufficiency(F.col("hits"), **{"min_top_score": settings.retrieval_min_top_score} | rules))
    asked = asked.withColumn("citations", citations(F.col("hits")).cast(f"array<{CITATION}>"))
    enough = F.col("sufficiency.is_sufficient")
    money = "struct<model:string,input_cost:double,output_cost:double,total_cost:double,currency:string>"
    final = ["query_id", "query", "answer", "is_answered", "refusal_reason", "citations", "usage", "cost", "sufficiency"]
    refused = asked.where(~enough).withColumns({
        "answer": F.lit(REFUSAL), "is_answered": F.lit(False), "refusal_reason": F.col("sufficiency.reason"), "usage": F.lit(None).cast(USAGE), "cost": F.lit(None).cast(money),
    })
    prompted = asked.where(enough).withColumn("system_prompt", F.lit(SYSTEM_PROMPT)).withColumn("user_prompt", user_prompt(F.col("query"), F.col("sufficiency"), F.col("citations")))
    done = chat.complete(prompted).withColumn("cost", cost(F.col("usage"), settings.input_cost_per_1k_tokens, settings.output_cost_per_1k_tokens).cast(money))
    done = done.withColumn("valid", validation(F.col("content"), F.col("citations"), F.lit(True))).withColumn("is_answered", F.col("valid.is_valid"))
    why = F.concat(F.lit("Citation validation failed: invalid_ids="), F.to_json("valid.invalid_ids"), F.lit(" missing_citation="), F.col("valid.missing_citation"))
    done = done.withColumns({"answer": F.when(F.col("is_answered"), F.col("content")).otherwise(INVALID), "refusal_reason": F.when(~F.col("is_answered"), why), "usage": F.col("usage").cast(USAGE)})
    return refused.select(*final).unionByName(done.select(*final))
