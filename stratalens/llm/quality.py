"""Quality classifier by co-training of a text view and a page-metadata view.

The text view sees what is written: hashed words and word pairs, byte frequencies, and shares of kinds of
words and lines.  The metadata view sees what is known of the page without its text: language, source and
stored length.  Each view is a logistic regression.  In each round, each view labels the unlabelled documents
of which it is most confident, by chances calibrated on held-out labels, and the other view trains on them too.  Held-out labels, in three parts, serve
to calibrate each view (Platt scaling), to combine the calibrated views by a last logistic regression, and to
set the threshold below which ``keep`` is false: at most ``SPARE`` of the good documents fall below it.  With
too few labels of a kind for three parts, one part serves all three.

The fit uses all labelled documents, or of a label that has more than half of ``SAMPLE`` about so many
by a hash of the row, and apart from them about ``SAMPLE`` unlabelled ones; so the labels used do not fall as
the corpus grows.  Rows that repeat whole are fitted once, so no more than twice these numbers reach the
driver.  All documents are scored.

Defined cases: null text is the empty text, other nulls are values of their own; a document labelled
both ways, or with a null label, counts as unlabelled; with no labels, or labels of one kind only, no
document is rejected and scores are null; repeated rows are scored alike; a score equal to the threshold is
kept; a very long text is read whole and needs memory in proportion to its words; the empty table gives no
rows; columns besides those named are ignored.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.llm.common import cut, discard, stored
from stratalens.llm.words import mix, texts, words

SAMPLE, ROUNDS, SPARE = 8_000, 3, 0.001
#: Rows whose features are worked on at a time in a fit.
STRIP = 512
#: Pseudo-labels that a view gives in a round, as a share of the unlabelled sample, and how sure it must be.
GIVEN, SURE = 0.1, 0.97
#: Hash buckets of sources and languages in the metadata view, and of words and of word pairs in the text view.
BUCKETS, WORDS, PAIRS = 32, 128, 64
#: Rows of each label that a part of the held-out labels needs; held-out rows that a view must be sure of to teach.
PART, TRUST = 20, 10
#: Numbers of features of the views.
SHAPE = 13
TEXT, META = WORDS + PAIRS + 256 + SHAPE, 2 * BUCKETS + 2


def _share(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    return n / np.maximum(of, 1)


def text_views(column: pd.Series) -> np.ndarray:
    """One row of features for each text."""
    out = np.zeros((len(column), TEXT), np.float32)
    for at, raw, starts in texts(pa.array(column.tolist(), pa.large_string())):
        own = len(starts)
        place, h = words(raw, starts)
        text = np.searchsorted(starts, place, "right") - 1
        held = lambda which, key, size: np.bincount(which * size + key, minlength=own * size).reshape(own, size).astype(np.float64)
        n = np.bincount(text, minlength=own).astype(np.float64)
        stop = np.append(starts[1:], len(raw))
        size = (stop - starts).astype(np.float64)
        owner = np.repeat(np.arange(own), stop - starts)
        counts = held(owner, raw, 256)
        same = np.flatnonzero(text[1:] == text[:-1])
        single = held(text, (h >> np.uint64(40)).astype(np.int64) % WORDS, WORDS)
        double = held(text[same], (mix(h[same] + mix(h[same + 1], 1)) >> np.uint64(40)).astype(np.int64) % PAIRS, PAIRS)
        order = np.lexsort((h, text))
        seen = np.bincount(text[order][np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])))[: len(h)]], minlength=own)
        # where the next word, or the text, tells that a word has one byte
        length = np.minimum(np.append(place[1:], len(raw)), stop[text]) - place
        lone = np.bincount(text, length <= 2, minlength=own)
        upper, lower = counts[:, 65:91].sum(axis=1), counts[:, 97:123].sum(axis=1)
        ends = np.flatnonzero(raw == 10)
        lines = np.bincount(owner[ends], minlength=own) + 1.0
        first, whose = np.concatenate((starts, ends + 1)), np.concatenate((np.arange(own), owner[ends]))
        by_place = np.lexsort((whose, first))
        first, whose = first[by_place], whose[by_place]
        short = np.bincount(whose, np.diff(first, append=len(raw)) < 20, minlength=own)
        marks = counts[:, 33:48].sum(axis=1)
        shape = [
            np.log1p(n), _share(seen, n), _share(size, n), _share(upper, upper + lower), _share(counts[:, 48:58].sum(axis=1), size), _share(marks, n), _share(lone, n),
            (n > 0) & (seen * 2 < n), np.log1p(lines), np.log1p(_share(size, lines)), _share(short, lines), _share(counts[:, 128:].sum(axis=1), size), n == 0,
        ]
        rows = np.concatenate([np.sqrt(_share(single, n[:, None])), np.sqrt(_share(double, n[:, None])), np.sqrt(_share(counts, size[:, None])), np.stack(shape, axis=1)], axis=1)
        out[at : at + own] = rows
    empty = np.flatnonzero([not t for t in column])
    out[empty] = 0
    out[empty, -1] = 1
    return out


def text_view(text: str | None) -> np.ndarray:
    return text_views(pd.Series([text], dtype=object))[0]


def metadata_view(lang: str | None, source: str | None, n_chars: float | None) -> np.ndarray:
    out = np.zeros(META, np.float32)
    for k, value in enumerate((lang, source)):
        out[k * BUCKETS + zlib.crc32(f"{value!r}".encode("utf-8", "surrogatepass")) % BUCKETS] = 1
    known = n_chars is not None and n_chars == n_chars
    out[2 * BUCKETS :] = [math.log1p(max(0.0, float(n_chars))) if known else 0, known]
    return out


@dataclass
class Logistic:
    """Logistic regression on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 8) -> Logistic:
        """Newton steps; the two classes weigh the same.  Sums go over ``STRIP`` rows at a time, so the driver needs no copy of ``x``."""
        mean, scale = x.mean(axis=0, dtype=np.float64), np.sqrt(np.maximum(np.square(x).mean(axis=0, dtype=np.float64) - x.mean(axis=0, dtype=np.float64) ** 2, 0))
        scale[scale < 1e-6] = 1
        heavy = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
        w = np.zeros(x.shape[1] + 1)
        hold = np.eye(len(w)) * ridge
        hold[-1, -1] = 1e-6
        for _ in range(steps):
            grad, curve = hold @ w, hold.copy()
            for at in range(0, len(x), STRIP):
                own = slice(at, at + STRIP)
                z = np.hstack(((x[own] - mean) / scale, np.ones((len(x[own]), 1))))
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                grad += z.T @ (heavy[own] * (p - y[own]))
                curve += (z * (heavy[own] * p * (1 - p))[:, None]).T @ z
            step = np.linalg.solve(curve, grad)
            w -= step
            if np.abs(step).max() < 1e-3:
                break
        return Logistic(mean, scale, w)

    def margin(self, x: np.ndarray) -> np.ndarray:
        w = self.weights[:-1] / self.scale
        parts = [x[at : at + STRIP].astype(np.float64) @ w for at in range(0, len(x), STRIP)]
        return np.clip(np.concatenate([np.zeros(0), *parts]) - self.mean @ w + self.weights[-1], -30, 30)

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


@dataclass
class Model:
    """Both views, their calibrations, their combination, and the threshold."""

    text: Logistic
    meta: Logistic
    calibrate: tuple[Logistic, Logistic]
    combine: Logistic
    threshold: float

    def views(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated chances of both views."""
        return tuple(c.chance(v.margin(x)[:, None]) for c, v, x in zip(self.calibrate, (self.text, self.meta), (a, b)))

    def score(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.combine.chance(_logits(*self.views(a, b)))


def _logits(*chances: np.ndarray) -> np.ndarray:
    p = np.clip(np.stack(chances, axis=1), 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def parts_of(held: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Held-out rows to calibrate, to combine and to set the threshold: apart, if each has ``PART`` of both labels."""
    parts = tuple(np.sort(np.concatenate([held[y[held] == label][k::3] for label in (0, 1)])) for k in range(3))
    return parts if min(np.bincount(y[p], minlength=2).min() for p in parts) >= PART else (held, held, held)


def trusted(chances: np.ndarray, y: np.ndarray) -> tuple[bool, bool]:
    """Whether a view may give labels 0 and 1: it is sure of TRUST held-out rows at least, and right as often as it is sure."""
    sure = [chances <= 1 - SURE, chances >= SURE]
    return tuple(bool(s.sum() >= TRUST and (y[s] == label).mean() >= SURE) for label, s in enumerate(sure))


def exchanged(chances: np.ndarray, free: np.ndarray, known: np.ndarray, may: tuple[bool, bool] = (True, True)) -> tuple[np.ndarray, np.ndarray]:
    """(rows, labels) that a view gives the other: of the ``free`` rows that the other does not know yet, those it is most sure of."""
    sure = np.flatnonzero(~np.isin(free, known) & ((chances >= SURE) & may[1] | (chances <= 1 - SURE) & may[0]))
    best = sure[np.argsort(-np.abs(chances[sure] - 0.5), kind="stable")][: int(GIVEN * len(free)) + 1]
    return free[best], (chances[best] > 0.5).astype(np.int64)


def cotrain(a: np.ndarray, b: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, spare: float = SPARE) -> Model | None:
    """Fit on views ``a`` (text) and ``b`` (metadata); ``y`` is 0, 1, or -1 where unlabelled.

    Rows are in an order that has nothing to do with their labels: every third labelled row is held out, or where that
    leaves a side without rows of a label, every third row of each label.
    """
    labelled, free = np.flatnonzero(y >= 0), np.flatnonzero(y < 0)
    for held in (labelled[::3], np.sort(np.concatenate([np.flatnonzero(y == label)[::3] for label in (0, 1)]))):
        train = np.setdiff1d(labelled, held)
        if min([np.bincount(y[s], minlength=2).min() for s in (held, train)]) > 0:
            break
    else:
        return None
    views = (a, b)
    rows, given = [train, train], [y[train], y[train]]
    models = [Logistic.fit(v[r], g) for v, r, g in zip(views, rows, given)]
    one, two, three = parts_of(held, y)
    margin = lambda k, rows: models[k].margin(views[k][rows])[:, None]
    for _ in range(rounds if len(free) else 0):
        # calibrated chances: a view that the held-out labels do not bear out teaches nothing
        sure = [Logistic.fit(margin(k, one), y[one]) for k in (0, 1)]
        may = [trusted(c.chance(margin(k, one)), y[one]) for k, c in enumerate(sure)]
        fresh = [exchanged(c.chance(margin(k, free)), free, rows[1 - k], may[k]) for k, c in enumerate(sure)]
        for pupil, (own, labels) in ((1, fresh[0]), (0, fresh[1])):
            rows[pupil], given[pupil] = np.concatenate((rows[pupil], own)), np.concatenate((given[pupil], labels))
        models = [Logistic.fit(v[r], g) if len(f[0]) else m for v, r, g, f, m in zip(views, rows, given, fresh[::-1], models)]
    calibrate = tuple(Logistic.fit(margin(k, one), y[one]) for k in (0, 1))
    both = lambda rows: _logits(*[c.chance(margin(k, rows)) for k, c in enumerate(calibrate)])
    combine = Logistic.fit(both(two), y[two])
    good = np.sort(combine.chance(both(three))[y[three] == 1])
    threshold = min(0.5, float(good[int(spare * len(good))]))
    return Model(models[0], models[1], calibrate, combine, threshold)


def _views(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    b = [metadata_view(*x) for x in zip(lang, source, n_chars)]
    return text_views(text), np.stack(b) if b else np.zeros((0, META), np.float32)


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("double").alias("n_chars")]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", label_col: str = "quality") -> Model | None:
    """Co-train on bounded samples of the labelled and the unlabelled; None if there are too few labels of either kind."""
    given = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).groupBy("id")
    given = given.agg(F.min("y").alias("low"), F.max("y").alias("high")).where("low = high AND low IN (0, 1)").select("id", F.col("low").cast("int").alias("y"))
    pick = F.xxhash64(F.lit("fit"), F.col(id_col), "lang", "source", "n_chars", "text")
    ids = docs.select(F.col(id_col).alias("id"), pick.alias("pick")).join(given, "id", "left").groupBy("pick").agg(F.max(F.coalesce("y", F.lit(-1))).alias("y"))
    ids = cut(ids)
    held = {r.y: r["count"] for r in ids.groupBy("y").count().collect()}
    part = {y: min(1.0, (sample if y < 0 else sample / 2) / n) for y, n in held.items()}
    inside = (F.shiftrightunsigned("pick", 1) / F.lit(2.0**63)) < F.coalesce(*[F.when(F.col("y") == y, F.lit(p)) for y, p in part.items()], F.lit(0.0))
    own = docs.select(F.col(id_col).alias("id"), *_columns(docs), pick.alias("pick")).join(F.broadcast(ids.where(inside).limit(4 * sample)), "pick").dropDuplicates(["pick"])

    def run(batches):
        for b in batches:
            x, z = _views(b["text"], b["lang"], b["source"], b["n_chars"])
            yield pd.DataFrame({"pick": b["pick"], "key": b["key"], "y": b["y"], "a": [r.tobytes() for r in x], "b": [r.tobytes() for r in z]})

    keyed = own.select("pick", F.xxhash64("id", F.coalesce("text", F.lit(""))).alias("key"), "y", "text", "lang", "source", "n_chars")
    rows = stored(keyed.mapInPandas(run, "pick long, key long, y int, a binary, b binary"))
    pick, key, y = (c.to_numpy().astype(np.int64) for c in rows.select("pick", "key", "y").toArrow().columns)
    # in an order that has nothing to do with partitions
    order = np.lexsort((pick, y, key))
    place = dict(zip(pick[order].tolist(), range(len(pick))))
    a, b = np.empty((len(pick), TEXT), np.float32), np.empty((len(pick), META), np.float32)
    # the features pass a partition at a time, each row straight to its place: no copy of them all lies with the driver's JVM or beside the matrices
    for r in rows.select("pick", "a", "b").toLocalIterator() if len(pick) else ():
        a[place[r.pick]], b[place[r.pick]] = np.frombuffer(r.a, np.float32), np.frombuffer(r.b, np.float32)
    discard(rows)
    return cotrain(a, b, y[order]) if len(pick) else None


def judged(docs: DataFrame, model: Model | None) -> Column:
    """A struct (text_score, meta_score, score, keep) for each row of ``docs``."""
    kind = "text_score double, meta_score double, score double, keep boolean"
    if model is None:
        return F.struct(
            *[F.lit(None).cast("double").alias(c) for c in ("text_score", "meta_score", "score")], F.lit(True).alias("keep")
        )

    def run(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        a, b = _views(text, lang, source, n_chars)
        x, z = model.views(a, b)
        score = model.combine.chance(_logits(x, z))
        return pd.DataFrame({"text_score": x, "meta_score": z, "score": score, "keep": score >= model.threshold})

    return F.pandas_udf(run, kind)(*_columns(docs))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text_score, meta_score, score, keep) for each row of ``docs``."""
    model = fit(docs, labels)
    return docs.select("doc_id", judged(docs, model).alias("judged")).select("doc_id", "judged.*")


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns as they are."""
    model = fit(docs, labels)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), judged(docs, model).alias("judged"))
    return whole.where("judged.keep").select("doc.*")
