"""Personal data: candidate spans scored by boosted trees, in DataFrame functions only.

High-recall generators propose spans, which may overlap.  Each candidate gets features of its format
(digits, letters, separators, length, checks such as Luhn) and of its context (words before it,
neighbouring characters).  Boosted trees score it, and the threshold calibrated for its kind selects
it.  The contract's base spans are always selected; an added span is kept if it overlaps none of them.

The trees are fitted once per session from labelled sentences that this module makes up (true
examples of each kind and look-alikes: version numbers, order numbers, failing check digits, prices),
put through the same generators and features; part of them is held out to calibrate the thresholds.
Fitted trees are plain CASE expressions, so scoring runs inside Spark's own operators.

Defined cases: null text is the empty text and has no spans; repeated rows are all returned; columns
besides the id and text columns are ignored; matches may lie anywhere in texts of any length; of
spans that start together (a tie) the order is that of the kinds, and added ones may overlap one another; the
empty table gives no rows.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm.common import digest_columns, match_spans

SPAN = "struct<start:int,rank:int,kind:string,end:int>"


@dataclass(frozen=True)
class Generator:
    """Proposes the matches of ``pattern`` as candidates of ``kind``; ``needs`` is in each match."""

    kind: str
    pattern: str
    needs: str = ""


# The contract's kinds in its order, then the kinds that the method adds.  Patterns are
# written so that matching takes linear time, with the same leftmost matches as the contract's.
GENERATORS = (
    Generator("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    Generator("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "."),
    Generator("card", r"[0-9](?:[\x20-]?[0-9]){11,}+"),
    Generator("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    Generator("local_phone", r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])"),
    Generator("national_id", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", "-"),
    Generator("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    Generator("hidden_email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{1,63})++", "at"),
)
BASE = 4
KINDS = tuple(g.kind for g in GENERATORS)
# Words that announce personal data, looked for just before a candidate.
CUES = r"(?i)(?:mail|contact|phone|call|tel|fax|mobile|ssn|social|iban|account|card|credit|visa|addr|ip\b|host|reach|born|id\b)"
# Words that announce other numbers.
DENIALS = r"(?i)(?:version|release|order|invoice|isbn|part|model|serial|build|section|price|total|tracking|ticket|ref)"


def luhn_ok(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check; one too long for any card does not."""
    n = F.length(digits)
    fits = n.between(1, 32)
    each = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: _doubled(F.substring(digits, n - i + 1, F.lit(1)), i))
    return F.when(fits, F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0).otherwise(False)


def _doubled(digit: Column, i: Column) -> Column:
    d = F.coalesce(F.try_to_number(digit, F.lit("9")).cast("int"), F.lit(0))
    return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)


def base_ok(rank: int, match: Column) -> Column:
    """The contract's check of a base candidate."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if rank == 0:
        return F.lit(True)
    if rank == 1:
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return ~F.exists(F.split(match, r"\."), lambda p: (F.length(part(p)) > 3) | (F.lpad(F.substring(part(p), 1, 3), 3, "0") > "255"))
    if rank == 2:
        return (F.length(digits) <= 19) & luhn_ok(digits)
    return F.length(digits).between(9, 15)


#: Features of a candidate, small integers; the trees and their training see the same ones.
FEATURES = ("rank", "length", "digits", "upper", "lower", "marks", "passes", "cue", "denial", "after_word", "luhn", "first")


def features(rank: int, span: Column) -> list[Column]:
    match, before = span["g0"], span["before"]
    size = lambda pattern: F.length(F.regexp_replace(match, pattern, ""))
    digits = F.regexp_replace(match, "[^0-9]", "")
    cols = [
        F.lit(rank), F.least(F.length(match), F.lit(60)), F.length(digits), size("[^A-Z]"), size("[^a-z]"), size("[A-Za-z0-9]"),
        (base_ok(rank, match) if rank < BASE else F.lit(True)).cast("int"), before.rlike(CUES).cast("int"), before.rlike(DENIALS).cast("int"),
        before.rlike(r"[A-Za-z]$").cast("int"), luhn_ok(digits).cast("int"), F.coalesce(F.try_to_number(F.substring(digits, 1, 1), F.lit("9")).cast("int"), F.lit(-1)),
    ]
    return [c.cast("int").alias(n) for c, n in zip(cols, FEATURES)]


def proposals(text: Column, rank: int) -> Column:
    """The generator's candidates as array<struct<start,kind,end,before,g0>>, empty where it proposes none."""
    g = GENERATORS[rank]
    hit = text.rlike(g.pattern)
    if g.needs:
        hit = text.contains(g.needs) & hit
    found = match_spans(text, g.pattern, g.kind)
    return F.when(hit, found).otherwise(F.array().cast("array<struct<start:int,kind:string,end:int,before:string,g0:string>>"))


# --- boosted trees -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Tree:
    """Depth two: a split, and a split on each side; leaves in the order of the sides."""

    splits: tuple[tuple[int, int], ...]
    leaves: tuple[float, ...]

    def value(self, x: tuple) -> float:
        side = int(x[self.splits[0][0]] > self.splits[0][1])
        f, t = self.splits[1 + side]
        return self.leaves[2 * side + int(x[f] > t)]

    def column(self, x: Column) -> Column:
        side = lambda s: F.when(x[FEATURES[self.splits[s][0]]] > self.splits[s][1], self.leaves[2 * s - 1]).otherwise(self.leaves[2 * s - 2])
        return F.when(x[FEATURES[self.splits[0][0]]] > self.splits[0][1], side(2)).otherwise(side(1))


def _best_split(rows: list, grad: list, hess: list) -> tuple[float, int, int]:
    best = (0.0, 0, 10**6)
    total_g, total_h = sum(grad), sum(hess)
    for f in range(len(FEATURES)):
        by: dict[int, list[float]] = {}
        for x, g, h in zip(rows, grad, hess):
            at = by.setdefault(x[f], [0.0, 0.0])
            at[0] += g
            at[1] += h
        g = h = 0.0
        for t in sorted(by)[:-1]:
            g, h = g + by[t][0], h + by[t][1]
            gain = g * g / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
            if gain > best[0] + 1e-12:
                best = (gain, f, t)
    return best


def boost(rows: list[tuple], labels: list[int], rounds: int = 24, rate: float = 0.4) -> list[Tree]:
    """Gradient boosting with logistic loss; ``rows`` are tuples of FEATURES."""
    score, trees = [0.0] * len(rows), []
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in score]
        grad, hess = [y - q for y, q in zip(labels, p)], [q * (1 - q) for q in p]
        _, f, t = _best_split(rows, grad, hess)
        splits, leaves = [(f, t)], []
        for side in (0, 1):
            own = [i for i, x in enumerate(rows) if int(x[f] > t) == side]
            _, f2, t2 = _best_split([rows[i] for i in own], [grad[i] for i in own], [hess[i] for i in own])
            splits.append((f2, t2))
            for half in (0, 1):
                leaf = [i for i in own if int(rows[i][f2] > t2) == half]
                leaves.append(round(rate * sum(grad[i] for i in leaf) / (sum(hess[i] for i in leaf) + 1), 6))
        trees.append(Tree(tuple(splits), tuple(leaves)))
        score = [s + trees[-1].value(x) for s, x in zip(score, rows)]
    return trees


def calibrate(scores: list[float], ranks: list[int], labels: list[int], precision: float = 0.95) -> list[float]:
    """For each kind, the lowest threshold at which held-out candidates reach ``precision``."""
    out = []
    for k in range(len(GENERATORS)):
        own = sorted(((s, y) for s, r, y in zip(scores, ranks, labels) if r == k), reverse=True)
        good, at = 0, 0.0
        for n, (s, y) in enumerate(own, 1):
            good += y
            if s > 0 and good / n >= precision and (n == len(own) or own[n][0] < s):
                at = s
        out.append(round(at - 1e-6, 6) if at else 10.0**6)
    return out


# --- training sentences --------------------------------------------------------------------------


def sentences(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label) with one span to be found or left alone in each."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 9)))

    def checked(k: int, ok: bool) -> str:
        body = digits(k - 1)
        total = sum(x if i % 2 else (x * 2 - 9 if x > 4 else x * 2) for i, x in enumerate(map(int, reversed(body))))
        return body + str((-total + (0 if ok else rng.randint(1, 9))) % 10)

    part = lambda top: str(rng.randint(0, top))
    makers = {
        "email": (lambda: f"{word()}.{digits(2)}@{word()}.com", ["mail", "contact", "", word()], None, []),
        "ip": (lambda: ".".join(part(255) for _ in range(4)), ["host", "ip", "", word()], lambda: f"{part(9)}.{part(40)}.{part(9)}.{rng.randint(256, 9999)}", ["version", "build", "section"]),
        "card": (lambda: checked(rng.choice((15, 16)), True), ["card", "credit", "", word()], lambda: checked(rng.choice((13, 14, 16, 18)), False), ["order", "isbn", "tracking", "", word()]),
        "phone": (lambda: f"+{rng.randint(1, 98)} ({digits(3)}) {digits(3)}-{digits(4)}", ["call", "tel", "", word()], lambda: f"+{digits(2)}.{digits(2)}", ["total", "price", word()]),
        "local_phone": (lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", ["call", "phone", "mobile"], lambda: f"{digits(3)} {digits(3)} {digits(4)}", ["order", "part", "model", word()]),
        "national_id": (lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", ["ssn", "social id"], lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", ["part", "serial", "ref", word()]),
        "iban": (lambda: f"{rng.choice(('DE', 'FR', 'GB', 'ES'))}{digits(2)}{digits(16)}", ["iban", "account"], lambda: f"{rng.choice(('XK', 'AB'))}{digits(2)}{digits(12)}", ["serial", "model", "ref", word()]),
        "hidden_email": (lambda: f"{word()} [at] {word()}.org", ["mail", "reach me", word()], lambda: f"{word()} (at) {word()}.{word()}", ["price", "version"]),
    }
    out = []
    for i in range(n):
        yes, cues, no, other = makers[KINDS[i % len(KINDS)]]
        label = int(no is None or rng.random() < 0.5)
        body, lead = (yes(), rng.choice(cues)) if label else (no(), rng.choice(other))
        head = " ".join([word(), word(), lead]).rstrip() + " "
        out.append((head + body + " " + word() + ".", len(head), len(head) + len(body), label))
    return out


def fit(spark: SparkSession, n: int = 1600, seed: int = 7) -> tuple[list[Tree], list[float]]:
    """Trees and thresholds from ``n`` made-up sentences, half of them held out for the thresholds."""
    made = sentences(n, seed)
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("text")) for i, (t, *_) in enumerate(made)])
    texts = spark.range(1).select(F.inline(rows))

    def described(k: int) -> Column:
        return F.transform(proposals(F.col("text"), k), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.struct(*features(k, s)).alias("x")))

    found = texts.select("i", F.concat(*[described(k) for k in range(len(GENERATORS))]).alias("found")).select("i", F.inline("found"))
    data = []
    for r in sorted(found.collect(), key=lambda r: (r.i, r.start, r.end, r.x.rank)):
        _, start, end, label = made[r.i]
        own = r.x.rank == r.i % len(KINDS)
        data.append((r.i, tuple(r.x), int(own and label and r.start == start and r.end == end)))
    train = [(x, y) for i, x, y in data if i // len(KINDS) % 2 == 0]
    held = [(x, y) for i, x, y in data if i // len(KINDS) % 2]
    trees = boost([x for x, _ in train], [y for _, y in train])
    score = lambda x: sum(t.value(x) for t in trees)
    return trees, calibrate([score(x) for x, _ in held], [x[0] for x, _ in held], [y for _, y in held])


_FITTED: dict[str, tuple[list[Tree], list[float]]] = {}


def model(spark: SparkSession) -> tuple[list[Tree], list[float]]:
    """The session's fitted trees and thresholds."""
    app = spark.sparkContext.applicationId
    if app not in _FITTED:
        _FITTED[app] = fit(spark)
    return _FITTED[app]


# --- the operator --------------------------------------------------------------------------------


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fitted: tuple[list[Tree], list[float]] | None = None) -> DataFrame:
    """(id, base, added): the base spans and the spans the method adds, as sorted arrays of SPAN."""
    trees, limits = fitted or model(docs.sparkSession)
    text = F.col("text")

    def judged(k: int) -> Column:
        def one(s: Column) -> Column:
            x = F.struct(*features(k, s))
            score = F.transform(F.array(x), lambda v: reduce(lambda a, b: a + b, [t.column(v) for t in trees]))[0]
            sure = base_ok(k, s["g0"]) if k < BASE else F.lit(False)
            return F.struct(
                sure.alias("sure"), F.when(sure, F.lit(True)).otherwise(score >= limits[k]).alias("chosen"),
                F.struct(s["start"].alias("start"), F.lit(k).alias("rank"), F.lit(KINDS[k]).alias("kind"), s["end"].alias("end")).alias("span"),
            )

        return F.transform(proposals(text, k), one)

    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = slim.select("id", F.concat(*[judged(k) for k in range(len(GENERATORS))]).alias("found"))
    spans = lambda keep: F.array_sort(F.transform(F.filter("found", keep), lambda c: c["span"]))
    picked = found.select("id", spans(lambda c: c["sure"]).alias("base"), spans(lambda c: c["chosen"] & ~c["sure"]).alias("more"))
    clear = F.filter("more", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return picked.select(F.col("id").alias(id_col), "base", clear.alias("added"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): the texts with each selected span replaced by its kind in brackets.

    Of overlapping spans the first counts; a later one that starts inside it is covered with it.
    """
    key = F.struct(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = find(docs.select(key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("body")), "key", "body")
    both, text = F.array_sort(F.concat("base", "added")), F.coalesce(F.col("key.text"), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(done: Column, s: Column) -> Column:
        new = F.concat(F.substring(text, done["at"] + 1, s["start"] - done["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(
            F.greatest(done["at"], s["end"]).alias("at"),
            F.when(s["start"] >= done["at"], F.concat(done["parts"], F.array(new))).otherwise(done["parts"]).alias("parts"),
        )

    whole = F.aggregate(both, start, step, lambda d: F.concat(F.array_join(d["parts"], ""), F.substring(text, d["at"] + 1, F.length(text))))
    return found.select(F.col("key.id").alias(id_col), F.when(F.col("key.text").isNotNull(), whole).alias(text_col))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for each row of ``docs``."""
    found = find(docs)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS[:BASE]], *digest_columns(F.col("base"), F.array_sort(F.concat("base", "added"))))
