"""Conversation structure repair: cheapest edits by a forward Viterbi pass over four grammar states.

A conversation's role initials must read ``(s?(ua)+)?``.  The states say what the repaired turns so far
end with: nothing (0), the system turn (1), a user turn (2), an assistant turn (3); 0 and 3 may end.
Every turn's layer is closed under inserted turns, of which two in a row reach every state, and then takes the turn's
own edit.  Each state carries its least (cost, audit string).  As all audits of a layer have as many
letters other than I and end with one, none is a prefix of another, so that instead of the
strings their order among the four states is carried, and a step costs the same at any length.

Rows are dealt to ranges of the order (conversation, turn) and sorted there, so a conversation may lie in several ranges.
A segment (the rows of one conversation in one range) is repaired by one call; a conversation of one segment
starts in state 0.  For the others, of which there are at most two segments for each border of a range, the pass
runs from each of the four states, the segments' 4 x 4 costs are composed in order, and the states between segments that the
best path takes give each segment its part of the path.  A range is of ``ROWS`` rows on average, so no conversation is one
task's alone but for its outputs: one audit string, and one SHA-256, which is fed segment by segment.

Defined cases: null role or text is one space, in the damage's key also a null id or turn; null ids are one
conversation; rows of one turn go by a hash of role and text; the initial is the first code point, an empty role has none and is like
any other that is not s, u or a; repeated rows are damaged alike and all but the first are duplicates; an empty or blank
text is blank whatever its role; a conversation without rows after damage has zeros, an empty audit and the hash of the
empty string; the empty table has no rows; very long texts are moved once with their row and once with its edit; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.llm.common import stored

#: Rows of a range, on average.
ROWS = 1 << 17
# The contract's costs and white space.
REROLE, DELETE, INSERT, TRUNCATED, WHITE = 1, 2, 5, 5, " \t\n\x0b\x0c\r"
#: Codes of a row: its initial (o for any other) and its fault; a dropped row is GONE.
FINE, FAULTY, CUT_OFF, GONE = ".", "x", "t", "--"
#: The state after an inserted or reroled turn.
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
LEGAL = ("su", "ua", "au")


# --- the pass over one segment -------------------------------------------------------------------


def _insertions(state: int) -> list[tuple[int, int, str]]:
    """(cost, state, letters) of up to two inserted turns."""
    out = [(0, state, "")]
    for _ in range(2):
        cost, at, letters = out[-1]
        out.append((cost + INSERT, NEXT[at], letters + "I"))
    return out


@functools.cache
def moves(state: int, code: str) -> list[tuple[int, int, str]]:
    """(cost, next state, letters): the best way from ``state`` to each state over inserted turns and one row's edit."""
    initial, fault = code
    best: dict[int, tuple[int, str]] = {}
    for cost, at, letters in _insertions(state):
        edits = [(DELETE, at, "D")]
        if fault != FAULTY:
            late = TRUNCATED if fault == CUT_OFF else 0
            kept = {"s": 1 if at == 0 else None, "u": 2 if at != 2 else None, "a": 3 if at == 2 else None}.get(initial)
            edits += [(late + REROLE, NEXT[at], "R")] + ([(late, kept, "K")] if kept else [])
        for more, to, letter in edits:
            best[to] = min(best.get(to, (cost + more, letters + letter)), (cost + more, letters + letter))
    return [(cost, to, letters) for to, (cost, letters) in best.items()]


def codes_of(text: str) -> list[str]:
    return [text[i : i + 2] for i in range(0, len(text), 2)]


def forward(codes: list[str], start: int) -> tuple[dict[int, tuple[int, int]], list[dict[int, tuple[int, str]]]]:
    """({end state: (cost, rank)}, steps) of the pass from ``start``: ranks order the ends' audits, each step tells
    for each state the state before it and the letters between."""
    at, steps = {start: (0, 0)}, []
    for code in codes:
        if code == GONE:
            steps.append({s: (s, "") for s in at})
            continue
        best: dict[int, tuple[int, int, str, int]] = {}
        for state, (cost, rank) in at.items():
            for more, to, letters in moves(state, code):
                found = (cost + more, rank, letters, state)
                if to not in best or found < best[to]:
                    best[to] = found
        order = sorted(best, key=lambda s: best[s][1:3])
        at = {s: (best[s][0], order.index(s)) for s in best}
        steps.append({s: (best[s][3], best[s][2]) for s in best})
    return at, steps


def ending(ends: dict[int, tuple[int, int]]) -> tuple[int, int, str]:
    """(cost, state, letters): the best end, with the turns inserted after the last row."""
    every = [(cost + more, rank, letters, state) for state, (cost, rank) in ends.items() for more, to, letters in _insertions(state) if to in (0, 3)]
    cost, _, letters, state = min(every)
    return cost, state, letters


def path(codes: list[str], start: int, end: int, steps: list[dict[int, tuple[int, str]]] | None = None) -> tuple[str, list[str]]:
    """(audit, tokens) of the best way from ``start`` to ``end``.  A row's token holds the turns inserted before it (u, a) and
    then K (kept), D (deleted), or U or A (its new role); a dropped row's is empty."""
    steps = steps or forward(codes, start)[1]
    back, state = [], end
    for step in reversed(steps):
        state, letters = step[state]
        back.append(letters)
    tokens, state = [], start
    for code, letters in zip(codes, reversed(back)):
        token, state = "", state
        for letter in letters:
            if letter == "I":
                state = NEXT[state]
                token += "ua"[state - 2]
            elif letter == "R":
                state = NEXT[state]
                token += "UA"[state - 2]
            else:
                state = {"s": 1, "u": 2, "a": 3}[code[0]] if letter == "K" else state
                token += letter
        tokens.append(token)
    return "".join(reversed(back)), tokens


def tail(state: int, letters: str) -> str:
    """The roles (u, a) of turns inserted after the last row."""
    out = ""
    for _ in letters:
        state = NEXT[state]
        out += "ua"[state - 2]
    return out


@functools.lru_cache(1 << 14)
def _repaired(text: str) -> tuple[int, str, list[str], str]:
    codes = codes_of(text)
    ends, steps = forward(codes, 0)
    cost, state, letters = ending(ends)
    audit, tokens = path(codes, 0, state, steps)
    return cost, audit + letters, tokens, tail(state, letters)


def repaired(text: str) -> tuple[int, str, list[str], str]:
    """(cost, audit, tokens, tail) of a whole conversation; short ones are often alike and kept."""
    return _repaired(text) if len(text) <= 64 else _repaired.__wrapped__(text)


def illegal(text: str) -> int:
    """Adjacent initials that may not follow one another."""
    initials = [c[0] for c in codes_of(text) if c != GONE]
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


# --- columns -------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): the rows after damage; dropped ones stay, with ``gone``, for their conversation's id."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), (F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20).alias("kind"))
    kind, text = F.col("kind"), F.col("text")
    rows = rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), (kind == 0).alias("gone"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), F.when(kind == 3, 2).otherwise(1).alias("times"),
    )
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "copy")


def ordered(rows: DataFrame, per_range: int = ROWS) -> DataFrame:
    """``rows`` kept in the shared folder in order of conversation and turn, with their range and place.

    The id is held as ``c`` and ``z`` (whether it is null), which join and group alike.
    """
    spark = rows.sparkSession
    kind = rows.schema["conv_id"].dataType
    rows = rows.withColumn("z", F.col("conv_id").isNull()).withColumn("c", F.coalesce("conv_id", F.lit("0").cast(kind))).drop("conv_id")
    keys = [F.desc("z"), F.col("c"), F.col("turn").asc_nulls_first(), F.xxhash64("role", "text"), F.col("deal")]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // per_range))
    dealt = rows.withColumn("deal", F.rand(12)).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return stored(dealt.drop("deal").withColumn("range", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))


def flagged(rows: DataFrame) -> DataFrame:
    """(c, z, range, at, turn, fault, code) of each row, without its text."""
    last = F.substring(F.rtrim("text", F.lit(WHITE)), -1, 1)  # none of a blank text
    first = F.substring("role", 1, 1)
    slim = rows.select(
        "c", "z", "range", "at", "turn", "gone", F.when(first.isin("s", "u", "a"), first).otherwise("o").alias("initial"),
        last.alias("last"), F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256).alias("said"),
    )
    again = slim.where("NOT gone").groupBy("c", "z", "said").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    slim = slim.join(again, ["c", "z", "said"], "left")
    fault = F.when(F.col("gone"), None).when(F.col("last") == "", "blank").when(F.col("at") > F.col("first"), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated").otherwise("none")
    code = F.when(F.col("gone"), GONE).otherwise(F.concat("initial", F.when(F.col("fault").isin("blank", "duplicate"), FAULTY).when(F.col("fault") == "truncated", CUT_OFF).otherwise(FINE)))
    return slim.select("c", "z", "range", "at", F.when(~F.col("gone"), F.col("turn")).alias("turn"), fault.alias("fault"), "gone", "initial").withColumn("code", code).drop("initial", "gone")


def segments(rows: DataFrame) -> DataFrame:
    """One row for each conversation and range: its codes in order, its counts and its turns."""
    count = lambda fault: F.count_if(F.col("fault") == fault).alias(fault)
    out = flagged(rows).groupBy("c", "z", "range").agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.sort_array(F.collect_list(F.struct("at", "code"))).alias("codes"), count("blank"), count("duplicate"), count("truncated"),
        F.size(F.collect_set("turn")).cast("long").alias("turns"), F.min("turn").alias("low"), F.max("turn").alias("high"),
    )
    return out.withColumn("codes", F.array_join(F.col("codes.code"), ""))


# what the three functions on segments return
WHOLE = "cost long, audit string, tokens array<string>, tail string, illegal long"
SUMS = "costs array<long>, ranks array<int>, illegal long, head string, foot string"
PART = "audit string, tokens array<string>"


def repair_whole(codes: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(*repaired(x), illegal(x)) for x in codes], columns=["cost", "audit", "tokens", "tail", "illegal"])


def summed_up(codes: pd.Series) -> pd.DataFrame:
    """A segment's costs and ranks from each state to each (-1: none), and its first and last initials."""

    def one(text: str) -> tuple:
        own = [c for c in codes_of(text) if c != GONE]
        ends = [forward(own, s)[0] for s in range(4)]
        cells = [e.get(t, (-1, -1)) for e in ends for t in range(4)]
        return [c for c, _ in cells], [r for _, r in cells], illegal(text), own[0][0] if own else "", own[-1][0] if own else ""

    return pd.DataFrame([one(x) for x in codes], columns=["costs", "ranks", "illegal", "head", "foot"])


def repair_part(codes: pd.Series, start: pd.Series, end: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([path(codes_of(x), int(a), int(b)) for x, a, b in zip(codes, start, end)], columns=["audit", "tokens"])


def compose(parts: pd.DataFrame) -> pd.DataFrame:
    """The segments of one conversation, with the states that its best path enters and leaves each by, and the whole's figures in every row."""
    parts = parts.sort_values("range")
    at, steps = {0: (0, 0)}, []
    for costs, ranks in zip(parts["costs"], parts["ranks"]):
        best: dict[int, tuple[int, int, int, int]] = {}
        for state, (cost, rank) in at.items():
            for to in range(4):
                more, own = costs[4 * state + to], ranks[4 * state + to]
                found = (cost + more, rank, own, state)
                if more >= 0 and (to not in best or found < best[to]):
                    best[to] = found
        order = sorted(best, key=lambda s: best[s][1:3])
        at = {s: (best[s][0], order.index(s)) for s in best}
        steps.append({s: best[s][3] for s in best})
    cost, state, letters = ending(at)
    after, between = tail(state, letters), [state]
    for step in reversed(steps):
        between.append(step[between[-1]])
    between.reverse()
    initials = [(h, f) for h, f in zip(parts["head"], parts["foot"]) if h]
    wrong = int(parts["illegal"].sum()) + sum(a[1] + b[0] not in LEGAL for a, b in zip(initials, initials[1:]))
    spans = [(a, b) for a, b in zip(parts["low"], parts["high"]) if not pd.isna(a)]
    turns = int(parts["turns"].sum()) - sum(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    gaps = int(spans[-1][1]) - int(spans[0][0]) + 1 - turns if spans else 0
    last = lambda x: [""] * (len(parts) - 1) + [x]
    whole = {"gaps": gaps, "illegal": wrong, "cost": cost, **{k: int(parts[k].sum()) for k in ("blank", "duplicate", "truncated")}}
    return parts[["c", "z", "range", "first", "last", "codes"]].assign(start=between[:-1], end=between[1:], tail=last(after), letters=last(letters), **whole)


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def turns(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(c, z, range, at, turns): the repaired turns, as array<struct<role, text, edit>>, that stand for each row.

    ``edits`` has the segments' first and last places, tokens and tails; inserted turns come before the row they precede, those at
    the end of a conversation after its last row.
    """
    token = F.coalesce(F.get("tokens", (F.col("at") - F.col("first")).cast("int")), F.lit(""))
    turn = lambda role, text, edit: F.struct(role.alias("role"), text.alias("text"), F.lit(edit).alias("edit"))
    user, assistant, said = F.lit("user"), F.lit("assistant"), F.col("text")
    edit = F.substring(token, -1, 1)
    own = F.when(edit == "K", turn(F.col("role"), said, "K")).when(edit == "U", turn(user, said, "R")).when(edit == "A", turn(assistant, said, "R"))
    new = lambda roles: F.transform(F.filter(F.split(roles, ""), lambda r: r.isin("u", "a")), lambda r: turn(F.when(r == "u", user).otherwise(assistant), F.lit(""), "I"))
    after = F.when(F.col("at") == F.col("last"), F.col("tail")).otherwise("")
    both = rows.join(edits.select("c", "z", "range", "first", "last", "tokens", "tail"), ["c", "z", "range"])
    return both.select("c", "z", "range", "at", F.concat(new(token), F.array_compact(F.array(own)), new(after)).alias("turns"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, z, sha) of conversations whose segments follow one another in the stream; one segment's text is held at a time."""
    now, held, some, schema = None, hashlib.sha256(), False, None

    def out(key):
        return pa.RecordBatch.from_arrays([pa.array([key[0]], schema.field("c").type), pa.array([key[1]]), pa.array([held.hexdigest()])], names=["c", "z", "sha"])

    for batch in batches:
        schema = batch.schema
        for k in range(batch.num_rows):
            key, text = (batch["c"][k].as_py(), batch["z"][k].as_py()), batch["text"][k].as_py()
            if key != now:
                if now is not None:
                    yield out(now)
                now, held, some = key, hashlib.sha256(), False
            if text is not None:
                held.update((b"\n" if some else b"") + text.encode())
                some = True
    if now is not None:
        yield out(now)


def edited(rows: DataFrame, per_range: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(conversations, rows): (c, z, COUNTS, audit, pieces) of each conversation, and each row's ``turns`` with its segment.

    ``rows`` has conv_id, turn, role and text without nulls in the last two, and ``gone`` for rows that only name their conversation.
    """
    rows = ordered(rows, per_range)
    parts = stored(segments(rows))
    pieces = parts.groupBy("c", "z").agg(F.count("*").alias("pieces"))
    parts = parts.join(pieces, ["c", "z"])

    single = parts.where("pieces = 1").withColumn("r", F.pandas_udf(repair_whole, WHOLE)("codes"))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    single = single.select("c", "z", "range", "first", "last", "r.tokens", "r.tail", gaps, "blank", "duplicate", "truncated", "r.illegal", "r.cost", "r.audit", "pieces")

    many = parts.where("pieces > 1").withColumn("s", F.pandas_udf(summed_up, SUMS)("codes")).select("*", "s.*").drop("s")  # at most two for each range
    kind = rows.schema["c"].dataType.simpleString()
    figures = ", ".join(f"{k} long" for k in COUNTS)
    states = many.groupBy("c", "z").applyInPandas(compose, f"c {kind}, z boolean, range int, first long, last long, codes string, start int, end int, tail string, {figures}, letters string")
    states = stored(states.withColumn("p", F.pandas_udf(repair_part, PART)("codes", "start", "end")).select("c", "z", "range", "first", "last", "p.tokens", "tail", *COUNTS, F.concat("p.audit", "letters").alias("audit")))

    told = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("range", "audit"))), lambda x: x["audit"]), "")
    whole = states.groupBy("c", "z").agg(*[F.first(k).alias(k) for k in COUNTS], told.alias("audit"), F.count("*").alias("pieces"))
    both = single.select("c", "z", *COUNTS, "audit", "pieces").unionByName(whole)
    edits = single.select("c", "z", "range", "first", "last", "tokens", "tail", "pieces")
    edits = edits.unionByName(states.select("c", "z", "range", "first", "last", "tokens", "tail", F.lit(2).cast("long").alias("pieces")))
    return both, turns(rows, edits)


def _id(z: Column, c: Column) -> Column:
    return F.when(~z, c).alias("conv_id")


def repair_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit): the repaired turns of conversations as they are, in order of ``place``; ``edit`` is K, R or I."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = edited(conversations.select("conv_id", "turn", spaced("role"), spaced("text"), F.lit(False).alias("gone")))[1]
    each = rows.select(_id(F.col("z"), F.col("c")), "at", F.posexplode("turns").alias("nth", "turn"))
    return each.select("conv_id", F.struct("at", "nth").alias("place"), "turn.role", "turn.text", "turn.edit")


def repair(rows: DataFrame, per_range: int = ROWS) -> DataFrame:
    """(conv_id, COUNTS, audit, repaired_sha256) of every conversation of ``rows``."""
    both, each = edited(rows, per_range)
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    texts = each.groupBy("c", "z", "range").agg(F.flatten(F.sort_array(F.collect_list(F.struct("at", said.alias("said"))))["said"]).alias("said"))
    # null where a segment has no turns; a conversation's empty text and no text are hashed alike
    texts = stored(texts.select("c", "z", "range", F.when(F.size("said") > 0, F.array_join("said", "\n")).alias("text")).join(both.select("c", "z", "pieces"), ["c", "z"]))
    one = texts.where("pieces = 1").select("c", "z", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    kind = texts.schema["c"].dataType.simpleString()
    order = texts.where("pieces > 1").select("c", "z", "range", "text").repartition("c", "z").sortWithinPartitions("z", "c", "range")
    shas = one.unionByName(order.mapInArrow(_hashed, f"c {kind}, z boolean, sha string"))
    return both.join(shas, ["c", "z"]).select(_id(F.col("z"), F.col("c")), *[F.col(k).cast("long").alias(k) for k in COUNTS], "audit", F.col("sha").alias("repaired_sha256"))


def digest(conversations: DataFrame) -> DataFrame:
    """The contract's columns for every conversation of the damaged table."""
    return repair(damaged(conversations))
