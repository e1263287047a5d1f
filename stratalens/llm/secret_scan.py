"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of a text is addressed by its SHA-256.  The ledger holds, for each blob, the rule
versions that have seen it and what they found.  A run scans only the (blob, rule version) pairs
that the ledger lacks, and joins findings back to all paths that hold the blob.

Defined cases: null text is the empty text; the empty text has a blob and no findings; a very long text is
scanned whole, in time in proportion to its length and matches; of spans that start together (a tie) the order
is that of the rules; the empty table gives no rows; repeated rows each get their findings; columns besides
the id and text columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.llm.common import cut, digest_columns, match_spans

SPAN = "struct<start:int,rank:int,kind:string,end:int>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has ``least`` or more characters.

    ``needs`` is a literal that every match contains; texts without it are passed over.
    """

    kind: str
    pattern: str
    least: int
    group: int = 0
    needs: str = ""
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The three base rules of the contract.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 20, needs="AKIA"),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
# Public token formats that the method adds.
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 20, needs="-----BEGIN"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 30, needs="eyJ"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 40, needs="gh"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 15, needs="xox"),
    Rule("login", r"://[A-Za-z0-9._~-]+:[^\x20\x09-\x0D@/:]{3,}@", 8, needs="://"),
)
RULES = BASE + ADDED


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """array<SPAN> of one rule's findings in ``text``."""
    hit = text.rlike(rule.pattern)
    if rule.needs:
        hit = text.contains(rule.needs) & hit
    found = F.filter(match_spans(text, rule.pattern, rule.kind, (rule.group,)), lambda s: F.length(s[f"g{rule.group}"]) >= rule.least)
    slim = F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.when(hit, slim).otherwise(F.array().cast(f"array<{SPAN}>"))


def addressed(versions: DataFrame, text_col: str = "text") -> DataFrame:
    """The versions with their blob address in ``blob``."""
    return versions.withColumn("blob", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The ledger (blob, seen, spans) after scanning what ``versions`` adds to it.

    ``seen`` lists the rule versions that have scanned the blob.  A blob is scanned once however
    many rows hold it: copies meet by address before the scan, combined on the map side.
    """
    keys = F.array(*[F.lit(r.key) for r in rules])
    texts = versions.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blobs = addressed(texts).groupBy("blob").agg(F.first("text").alias("text"))
    none = F.array().cast("array<string>")
    if ledger is None:
        blobs = blobs.withColumn("seen", none).withColumn("old", F.array().cast(f"array<{SPAN}>"))
    else:
        blobs = blobs.join(ledger.select("blob", F.col("seen").alias("_seen"), F.col("spans").alias("_old")), "blob", "left")
        blobs = blobs.select("blob", "text", F.coalesce("_seen", none).alias("seen"), F.coalesce("_old", F.array().cast(f"array<{SPAN}>")).alias("old"))
        blobs = blobs.where(F.size(F.array_except(keys, "seen")) > 0)
    old = lambda kinds: F.filter("old", lambda s: s["kind"].isin(kinds))
    parts = [F.when(F.array_contains("seen", r.key), old([r.kind])).otherwise(rule_spans(F.col("text"), r, i)) for i, r in enumerate(rules)]
    other = F.filter("old", lambda s: ~s["kind"].isin([r.kind for r in rules]))
    scanned = blobs.select("blob", F.array_union("seen", keys).alias("seen"), F.array_sort(F.concat(other, *parts)).alias("spans"))
    if ledger is not None:
        scanned = ledger.select("blob", "seen", "spans").join(scanned.select("blob"), "blob", "left_anti").unionByName(scanned)
    return cut(scanned)


def findings(versions: DataFrame, ledger: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id and blob with the spans its blob has in the ledger (an empty list if none)."""
    paths = addressed(versions.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select("id", "blob")
    hits = ledger.where(F.size("spans") > 0).select("blob", "spans")
    found = paths.join(hits, "blob", "left")
    return found.select(F.col("id").alias(id_col), "blob", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def secret_digest(docs: DataFrame) -> DataFrame:
    """The contract's digest columns for each row of ``docs``."""
    found = findings(docs, update_ledger(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *[count(r.kind) for r in BASE], *digest_columns(base, F.col("spans")))
