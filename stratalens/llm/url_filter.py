r"""URL filters with a bit-parallel wildcard automaton.

Glob rules over the canonical URL (a dot, the lower-cased host, the path) are packed into multiword
Shift-And masks: one bit for each position of each rule, one mask of positions for each character.
All rules advance together over a URL's characters, and all URLs of a batch advance together.

Globs: ``?`` is any one character, ``*`` any run without ``/``, ``**`` any run; everything else is
itself.  A domain rule ``example.net/en/`` is the glob ``*.example.net/en/**``: the dot in front of
the canonical host makes it fit the host and all its subdomains, and since ``*`` stops at ``/`` it
fits nothing in the path.

Defined cases: a null url, or one without ``://``, has an empty host and path and no domain rule;
an empty url likewise; a very long url is read whole, in memory in proportion to its batch; the empty table
gives no rows; repeated rows are judged alike; of rules that fit, the longest decides (the first listed if two are
equally long); columns besides the id and url columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"

# The contract's rules, (verdict, host and path).
DOMAIN_RULES = ((BLOCK, "net/"), (ALLOW, "example.net/en/"), (BLOCK, "example.com/de/"), (ALLOW, "org/fr/"))
# The method's own globs for URLs that no domain rule fits; such a URL is blocked.
GLOBS = ("**/login**", "**/cart**", "*.ads.**", "*.tracker.**", "**.exe", "**.zip", "**/wp-admin/**")
#: URLs simulated at once.
STEP = 4096


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Canonical host and path of a url; both empty if it is null or has no ``://``."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://((?s:.*))$", 1)
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*((?:/[^?#]*)?)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


@dataclass(frozen=True)
class Place:
    """A position of a glob: a character (None for any), or a run that may repeat."""

    char: str | None
    run: str = ""  # "*" or "**" for a run that stands before this position


def places(glob: str) -> tuple[list[Place], str]:
    """The glob's positions, and the run that may follow the last one."""
    out, run, at = [], "", 0
    while at < len(glob):
        if glob[at] == "*":
            wide = glob.startswith("**", at)
            run = "**" if wide or run == "**" else "*"
            at += 1 + wide
            continue
        out.append(Place(None if glob[at] == "?" else glob[at], run))
        run, at = "", at + 1
    return out, run


class Automaton:
    """Shift-And masks of all globs in words of 64 bits.

    State bit i says that the first i positions of its glob are matched; each glob has a start bit
    and one bit more for each position.  A run keeps the bit in front of it set.
    """

    def __init__(self, globs: list[str] | tuple[str, ...]) -> None:
        bits, start, keep_wide, keep_part, ends, step = 0, [], [], [], [], {}
        self.any: list[int] = []
        for glob in globs:
            found, tail = places(glob)
            start.append(bits)
            for i, p in enumerate(found):
                if p.run:
                    (keep_wide if p.run == "**" else keep_part).append(bits + i)
                (self.any if p.char is None else step.setdefault(p.char, [])).append(bits + i + 1)
            if tail:
                (keep_wide if tail == "**" else keep_part).append(bits + len(found))
            ends.append(bits + len(found))
            bits += len(found) + 1
        self.words = max(1, -(-bits // 64))
        self.start, self.wide, self.part = map(self._mask, (start, keep_wide, keep_part))
        self.ends = ends
        self.codes = {c: i + 1 for i, c in enumerate(sorted(step))}
        self.step = np.stack([self._mask(self.any), *[self._mask(step[c] + self.any) for c in sorted(step)]])
        self.keep = np.stack([self.wide | (self.part if c != "/" else np.uint64(0)) for c in ["", *sorted(step)]])
        if "/" not in self.codes:
            self.codes["/"] = len(self.step)
            self.step = np.vstack([self.step, self._mask(self.any)])
            self.keep = np.vstack([self.keep, self.wide])

    def _mask(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1 << (b % 64))
        return out

    def matches(self, texts: list[str]) -> np.ndarray:
        """Boolean matrix (text, glob): which whole texts fit which globs."""
        out = np.zeros((len(texts), len(self.ends)), bool)
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        for at in range(0, len(order), STEP):
            part = order[at : at + STEP]
            out[part] = self._simulate([texts[i] for i in part])
        return out

    def _simulate(self, texts: list[str]) -> np.ndarray:
        """``texts`` are in order of length, so those still running are always the last ones."""
        lengths = np.array([len(t) for t in texts])
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        table = np.zeros(0x110000, np.uint16)
        for c, code in self.codes.items():
            table[ord(c)] = code
        codes, begins = table[flat], np.cumsum(lengths) - lengths
        state = np.tile(self.start, (len(texts), 1))
        for at in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(lengths, at, side="right"))
            code, old = codes[begins[live:] + at], state[live:]
            moved = old << np.uint64(1)
            moved[:, 1:] |= old[:, :-1] >> np.uint64(63)
            state[live:] = (moved & self.step[code]) | (old & self.keep[code])
        return np.stack([(state[:, e // 64] >> np.uint64(e % 64) & np.uint64(1)).astype(bool) for e in self.ends], axis=1)


def judge(
    pages: DataFrame, rules: tuple[tuple[str, str], ...] = DOMAIN_RULES, globs: tuple[str, ...] = GLOBS,
    id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """(id, host, path, rule, verdict) for each row: the longest fitting domain rule's verdict, else
    ``block`` if any of the method's globs fits, else ``allow``."""
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1]), i))
    ranked = [rules[i] for i in order]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = Automaton([f"*.{rule}**" for _, rule in ranked] + list(globs))
        for b in batches:
            hit = machine.matches(("." + b["host"] + b["path"]).tolist())
            named = hit[:, : len(ranked)]
            which = np.where(named.any(axis=1), named.argmax(axis=1), -1)
            other = np.where(hit[:, len(ranked) :].any(axis=1), BLOCK, ALLOW)
            yield b.assign(
                rule=[ranked[w][1] if w >= 0 else None for w in which],
                verdict=[ranked[w][0] if w >= 0 else o for w, o in zip(which, other)],
            )

    host, path = host_and_path(F.col(url_col))
    # ids pass through pandas as strings, which keep nulls and large numbers as they are
    slim = pages.select(F.col(id_col).cast("string").alias("id"), host.alias("host"), path.alias("path"))
    judged = slim.mapInPandas(run, "id string, host string, path string, rule string, verdict string")
    return judged.withColumn("id", F.col("id").cast("long"))


def digest(pages: DataFrame) -> DataFrame:
    """The contract's columns for each row of ``pages``."""
    return judge(pages).withColumnRenamed("id", "page_id")
