import hashlib
import itertools
import random
import re
import zlib

import pytest
import xxhash
from brute import SF
from llm_oracle import same
from pyspark.sql import functions as F

from stratalens.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = {}
    for i, t, role, text in rows:
        own = out.setdefault(i, [])
        sp = lambda x: " " if x is None else str(x)
        d = zlib.crc32(f"{sp(i)}:{sp(t)}".encode()) % 20
        role, text = sp(role), sp(text)
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        own += [(t, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


def tie(role, text):
    """Spark's xxhash64 of two strings: the first one's hash is the second one's seed."""
    h = xxhash.xxh64_intdigest(text.encode(), seed=xxhash.xxh64_intdigest(role.encode(), seed=42))
    return h - (1 << 64) if h >> 63 else h


def best(rows, faults):
    """(cost, audit, turns) by whole strings: every state keeps its least (cost, audit)."""
    state = lambda turns: "" if not turns else "".join(r[:1] for r, _ in turns)[-1]
    at = {"": (0, "", [])}

    def closed(at):
        for _ in range(3):
            new = dict(at)
            for s, (c, a, turns) in at.items():
                role = "assistant" if s == "u" else "user"
                found = (c + 5, a + "I", [*turns, (role, "")])
                new[role[0]] = min(new.get(role[0], found), found, key=lambda x: x[:2])
            at = new
        return at

    for (_, role, text), fault in zip(rows, faults):
        new = {}

        def put(found):
            s = state(found[2])
            new[s] = min(new.get(s, found), found, key=lambda x: x[:2])

        for s, (c, a, turns) in closed(at).items():
            put((c + 2, a + "D", turns))
            if fault not in ("blank", "duplicate"):
                late = 5 if fault == "truncated" else 0
                for letter, cost, to in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")):
                    if to and s + to[0] in ("s", "u", "su", "ua", "au"):
                        put((c + late + cost, a + letter, [*turns, (to, text)]))
        at = new
    return min((x for s, x in closed(at).items() if s in ("", "a")), key=lambda x: x[:2])


def plain(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1], r[2]))):
    out = []
    for i, own in damage(rows).items():
        own = sorted(own, key=key)
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.rstrip(WHITE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "none")
            seen.add((role, text))
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, fixed = best(own, faults)
        assert GRAMMAR.fullmatch("".join(r[:1] for r, _ in fixed))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out.append((i, gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return sorted(out, key=repr)


def told(df):
    return sorted(map(tuple, df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=repr)


def made(n, seed, turns=12, roles=("system", "user", "assistant", "user", "assistant", "tool", "", None)):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", None, "é. \t", "Yes.", "a\nb. ", "end. ", "ok!"]
    return [(i, rng.choice([k, k, k, rng.randrange(turns), None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.random()}.") for i in range(n) for k in range(rng.randrange(turns))]


def test_same_as_sql(spark):
    same(queries.op12_conversation_repair(spark, SF), queries.oracle_sql()["op12_conversation_repair"], SF)


def test_query_against_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert told(queries.op12_conversation_repair(spark, SF)) == plain(rows)


def test_odd_rows(spark):
    rows = made(120, 1) + [(None, t, r, x) for _, t, r, x in made(3, 2)] + [(-5, None, "user", "Hello.")] * 7 + [(-6, 2**40, "assistant", "x" * 50_000 + ".")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("range", "at", "c", "z", "code", "gone")}).repartition(3)
    assert told(conversations.digest(df)) == plain(rows)


def test_a_conversation_over_many_ranges(spark):
    rows = made(30, 3) + [(-1, t, r, x) for _, t, r, x in made(60, 4, turns=40)] + [(None, None, "user", "Same.")] * 300 + [(-2, k // 2, "assistant" if k % 3 else "user", f"t{k}.") for k in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    both, _ = conversations.edited(conversations.damaged(df), per_range=50)
    assert both.agg(F.max("pieces")).first()[0] > 8
    assert told(conversations.repair(conversations.damaged(df), per_range=50)) == plain(rows)


def test_small_conversations_against_all_edits():
    """Costs and audits of the pass against every sequence of edits."""
    for codes in itertools.product([i + f for i in "suao" for f in ".xt"], repeat=2):
        least = None
        for plan in itertools.product(*[["", "u", "a", "ua", "au"], ["K", "U", "A", "D"]] * 2, ["", "u", "a", "ua", "au"]):
            cost, audit, out = 0, "", ""
            for k, step in enumerate(plan):
                if k % 2 == 0:
                    cost, audit, out = cost + 5 * len(step), audit + "I" * len(step), out + step
                else:
                    initial, fault = codes[k // 2]
                    cost += {"K": 0, "D": 2}.get(step, 1) + (5 if fault == "t" and step != "D" else 1000 if fault == "x" and step != "D" else 0)
                    audit += "R" if step in "UA" else step
                    out += {"K": initial, "D": ""}.get(step, step.lower())
            if GRAMMAR.fullmatch(out) and (least is None or (cost, audit) < least):
                least = cost, audit
        assert conversations.repaired("".join(codes))[:2] == least


@pytest.mark.parametrize("seed", range(4))
def test_composed_segments_are_the_whole(seed):
    import pandas as pd

    rng = random.Random(seed)
    codes = [rng.choice("suuaao") + rng.choice("...xt") if rng.random() < 0.9 else "--" for _ in range(60)]
    want = conversations.repaired("".join(codes))
    cuts = sorted(rng.sample(range(1, 60), 5))
    texts = pd.Series(["".join(codes[a:b]) for a, b in zip([0, *cuts], [*cuts, 60])])
    parts = conversations.summed_up(texts)
    parts = parts.assign(c=1, z=False, range=range(6), first=0, last=0, codes=texts, low=1, high=1, turns=1, blank=0, duplicate=0, truncated=0)
    out = conversations.compose(parts.sample(frac=1, random_state=seed))
    paths = [conversations.path(conversations.codes_of(t), a, b) for t, a, b in zip(out["codes"], out["start"], out["end"])]
    assert (out["cost"].iloc[0], "".join(p[0] for p in paths) + out["letters"].iloc[-1], sum((p[1] for p in paths), []), out["tail"].iloc[-1]) == want
    assert out["illegal"].iloc[0] == conversations.illegal("".join(codes)) and out["gaps"].iloc[0] == 0


def test_long_conversations_take_time_in_proportion():
    codes = "s." + "u.a." * 100_000
    cost, audit, tokens, tail = conversations.repaired(codes)
    assert cost == 0 and audit == "K" * 200_001 and tail == ""


def test_repaired_turns_keep_their_texts(spark):
    rows = [(1, 0, "system", "Rules."), (1, 1, "assistant", "Hi."), (1, 2, "assistant", "Hi."), (1, 3, "user", "So?"), (2, 0, "user", "Only a question?"), (3, 0, "user", " ")]
    out = conversations.repair_turns(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "place").select("conv_id", "role", "text", "edit")
    got = [tuple(r) for r in out.collect()]
    for i, own in itertools.groupby(got, key=lambda r: r[0]):
        assert GRAMMAR.fullmatch("".join(r[1][0] for r in own))
    assert (1, "system", "Rules.", "K") in got and not [r for r in got if r[0] == 3]


def test_empty(spark):
    assert conversations.digest(spark.createDataFrame([], SCHEMA)).count() == 0
