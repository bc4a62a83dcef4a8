"""Toxicity severity by cumulative-link ordinal regression over sparse words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, pick, table, written

class NotConverged(RuntimeError):
    """The optimiser's evaluations were spent before the gradient was within the tolerance."""


#: Labelled rows that a fit reads at most: those whose ids have the smallest hashes. A larger table is sampled down to this.
MAX_LABELLED = 20_000
#: Words are hashed to so many features, which bounds the model.
FEATURES = 1 << 18
#: A feature is used when, at some threshold, its smoothed log odds between the grades above and below are so many standard errors from 0.
SIGNIFICANT = 3.0
#: Tasks that share the labelled rows of a fit.
TASKS = 8
#: Words whose features a worker remembers; beyond it the memory starts anew. A worker lives on through later stages, and its memory with it.
REMEMBERED = 1 << 17
PUNCTUATION = ".,;:!?\"'()[]{}<>*_-"

SCHEMA = "doc_id long, severity double, grade int, p_toxic double, toxic boolean"


def words_of(text: str | None) -> set[str]:
    """The words of a text: distinct, lower-cased, without the punctuation around them; and the stems (first four letters and *) of the longer ones."""
    words = {w.strip(PUNCTUATION) for w in set((text or "").lower().split())} - {""}
    return words | {w[:4] + "*" for w in words if len(w) > 5}


class Features(dict):
    """Words to features."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = f = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) % FEATURES
        return f

    def of(self, text: str | None) -> np.ndarray:
        """The distinct features of a text, ascending."""
        return np.unique(np.fromiter(map(self.__getitem__, words_of(text)), np.int32))


_features = Features()


@dataclass
class OrdinalModel:
    """P(grade <= j) = sigmoid(thresholds[j] - sum of the weights of the features present); one weight a feature, shared by all thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        below = 1 / (1 + np.exp(np.clip(score[:, None] - self.thresholds[None, :], -500, 500)))
        return np.diff(np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], axis=1), axis=1)

    def of_texts(self, texts: list[str | None]) -> np.ndarray:
        """(n, grades) probabilities."""
        return self.probabilities(np.array([self.weights[_features.of(t)].sum() for t in texts], dtype=float))


def loss(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, p: np.ndarray, grades: int) -> tuple[float, np.ndarray]:
    """Negative log likelihood of the grades ``y`` and its gradient. (rows, cols): the features present. ``p``: weights, first threshold, logs of the gaps."""
    n_words = len(p) - grades
    w, theta = p[:n_words], np.cumsum(np.concatenate([p[n_words : n_words + 1], np.exp(p[n_words + 1 :])]))
    lo_inf, hi_inf = y == 0, y == grades
    s = np.bincount(rows, w[cols], len(y))
    upper = np.where(hi_inf, 1.0, 1 / (1 + np.exp(np.clip(s - theta[np.minimum(y, grades - 1)], -500, 500))))
    lower = np.where(lo_inf, 0.0, 1 / (1 + np.exp(np.clip(s - theta[np.maximum(y - 1, 0)], -500, 500))))
    like = np.maximum(upper - lower, 1e-300)
    du, dl = upper * (1 - upper) / like, lower * (1 - lower) / like
    g = np.empty_like(p)
    g[:n_words] = np.bincount(cols, (du - dl)[rows], n_words)
    gt = -np.bincount(np.minimum(y, grades - 1), np.where(hi_inf, 0, du), grades) + np.bincount(np.maximum(y - 1, 0), np.where(lo_inf, 0, dl), grades)
    tail = np.cumsum(gt[::-1])[::-1]
    g[n_words] = tail[0]
    g[n_words + 1 :] = tail[1:] * np.exp(p[n_words + 1 :])
    return -float(np.log(like).sum()), g


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], p: np.ndarray, steps: int, tolerance: float, memory: int = 10) -> np.ndarray:
    """Limited-memory quasi-Newton steps with halving, until the largest gradient is within ``tolerance`` or nothing lower can be found in double
    precision. More than ``steps`` evaluations are a ``NotConverged``.
    """
    value, g = f(p)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    step = min(1.0, 1.0 / max(np.abs(g).sum(), 1e-12))
    for _ in range(steps):
        if np.abs(g).max() <= tolerance:
            break
        q, kept = g.copy(), []
        for s, d in reversed(past):
            a = (s @ q) / (s @ d)
            q -= a * d
            kept.append(a)
        if past:
            q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, d), a in zip(past, reversed(kept)):
            q += s * (a - (d @ q) / (s @ d))
        slope = -float(q @ g)
        if slope >= 0:
            q, slope, past = g.copy(), -float(g @ g), []
        new, new_g = f(p - step * q)
        if not new <= value + 1e-4 * step * slope:
            step /= 4
            if step < 1e-12:
                break
            continue
        s, d = -step * q, new_g - g
        if s @ d > 1e-12 * (d @ d):
            past = [*past[1 - memory :], (s, d)]
        p, value, g, step = p + s, new, new_g, 1.0
    else:
        if np.abs(g).max() > tolerance:
            raise NotConverged(f"gradient {np.abs(g).max():.3g} after {steps} evaluations, asked for {tolerance:.3g}")
    return p


def telling(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """How far each feature is from chance, in standard errors, at the threshold where it is farthest; ``counts`` (grades, features), ``totals`` by grade."""
    out = np.zeros(counts.shape[1])
    for j in range(1, len(totals)):
        high, low, a, b = counts[j:].sum(axis=0) + 0.5, counts[:j].sum(axis=0) + 0.5, totals[j:].sum() + 1.0, totals[:j].sum() + 1.0
        odds = np.log(high / (a - high)) - np.log(low / (b - low))
        out = np.maximum(out, np.abs(odds) / np.sqrt(1 / high + 1 / low))
    return out


def fitted(y_share: np.ndarray, f: Callable[[np.ndarray], tuple[float, np.ndarray]], n_words: int, l2: float, steps: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds at the optimum of the likelihood ``f`` with penalty l2 / 2 on the squared weights, from the shares of rows up to each grade."""
    share = np.clip(y_share, 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(n_words), first[:1], np.log(np.maximum(np.diff(first), 1e-3))])

    def penalised(p: np.ndarray) -> tuple[float, np.ndarray]:
        value, g = f(p)
        g[:n_words] += l2 * p[:n_words]
        return value + l2 / 2 * float(p[:n_words] @ p[:n_words]), g

    p = minimise(penalised, p, steps, tolerance)
    return p[:n_words], np.cumsum(np.concatenate([p[n_words : n_words + 1], np.exp(p[n_words + 1 :])]))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, n_words: int, grades: int, l2: float = 1.0, steps: int = 300, tolerance: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """``fitted`` on rows in memory. (rows, cols): the features that are present."""
    share = np.array([(y <= j).mean() for j in range(grades)])
    return fitted(share, lambda p: loss(rows, cols, y, p, grades), n_words, l2, steps, tolerance)


def fit(docs: DataFrame, labels: DataFrame, grade_col: str = "toxic", max_labelled: int = MAX_LABELLED, l2: float = 0.1, significant: float = SIGNIFICANT, steps: int = 500, tolerance: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel | None:
    """A model from ``labels`` (id, grade) over the texts of ``docs``; None when there are not at least two grades to tell apart, or none is 0.

    Grades are those that the labels hold, from 0 on: with labels that only say toxic or not there are two, and severity is the probability of
    the upper. Rows with a null id, grade or document are not used; negative grades count as 0; of labels that disagree on an id the
    highest counts, and of rows of ``docs`` that share an id the smallest text (null: empty). At most ``max_labelled`` labels are used, with whole texts. A
    grade that no label has is skipped in the order. A fit that is cut short raises ``NotConverged``.

    The labelled texts are written once as features in ``TASKS`` parts. Of all features those count that tell grades apart beyond chance (a
    test of each feature by itself, so how many there are depends on the data alone); the others would only fit noise. A step of the
    optimiser is one job: each part sums its likelihood and gradient, a number a feature, and the driver adds the parts.
    """
    chosen = pick(labels, id_col, grade_col).toDF("id", "y").dropna().groupBy("id").agg(F.greatest(F.max("y").cast("int"), F.lit(0)).alias("y"))
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("id"), "id").limit(max_labelled))
    texts = pick(docs, id_col, text_col).toDF("id", "text").join(chosen, "id").groupBy("id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_features.of(t.as_py()).tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], names=["id", "y", "words"])

    coded = written(texts.select("id", "y", "text").mapInArrow(index, "id long, y int, words binary").coalesce(4 * TASKS), "labelled")
    kinds = {r["y"]: r["n"] for r in coded.groupBy("y").agg(F.count(F.lit(1)).alias("n")).orderBy("y").collect()}  # grades that occur, in order
    if len(kinds) < 2 or 0 not in kinds:
        dropped(coded)
        return None
    names, grades = np.array(list(kinds)), len(kinds) - 1

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((grades + 1, FEATURES), np.int32)
        for b in batches:
            for y, x in zip(np.searchsorted(names, b.column(0).to_numpy()), b.column(1)):
                counts[y, np.frombuffer(x.as_buffer(), np.int32)] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([at.astype("<i8").tobytes()], pa.binary()), pa.array([counts.ravel()[at].tobytes()], pa.binary())], names=["at", "n"])

    counts = np.zeros((grades + 1) * FEATURES)
    for r in coded.select("y", "words").coalesce(TASKS).mapInArrow(tally, "at binary, n binary").collect():  # a row a task
        counts[np.frombuffer(r["at"], "<i8")] += np.frombuffer(r["n"], "<i4")
    used = np.flatnonzero(telling(counts.reshape(grades + 1, FEATURES), np.array([kinds[k] for k in names])) >= significant)
    place = np.full(FEATURES, -1, np.int32)
    place[used] = np.arange(len(used))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [place[np.frombuffer(x.as_buffer(), np.int32)] for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[x >= 0].tobytes() for x in found], pa.binary())], names=["id", "y", "words"])

    ready = written(coded.select("id", "y", "words").mapInArrow(choose, "id long, y int, words binary").repartition(TASKS, "id").sortWithinPartitions("id"), "labelled")
    dropped(coded)

    def likelihood(p: np.ndarray) -> tuple[float, np.ndarray]:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            value, g = 0.0, np.zeros(len(p))
            for b in batches:
                found = [np.frombuffer(x.as_buffer(), np.int32) for x in b.column(2)]
                rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
                one, two = loss(rows, np.concatenate([*found, np.zeros(0, np.int32)]), np.searchsorted(names, b.column(1).to_numpy()), p, grades)
                value, g = value + one, g + two
            yield pa.RecordBatch.from_arrays([pa.array([value]), pa.array([g.tobytes()], pa.binary())], names=["value", "g"])

        parts = sorted(ready.mapInArrow(sums, "value double, g binary").collect())  # a row a task
        return sum(r["value"] for r in parts), np.sum([np.frombuffer(r["g"]) for r in parts], axis=0)

    share = np.cumsum([kinds[k] for k in names])[:-1] / sum(kinds.values())
    weights = np.zeros(FEATURES)
    weights[used], thresholds = fitted(share, likelihood, len(used), l2, steps, tolerance)
    dropped(ready)
    return OrdinalModel(weights, thresholds)


def score(docs: DataFrame, model: OrdinalModel | None, cutoff: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, severity (expected grade), grade (likeliest, the lowest of equals), p_toxic (P(grade >= 1)), toxic.

    The whole text is read; a null or empty text has no words and gets the prior. Without a model every document has severity 0
    and is not toxic. Repeated rows and null ids are scored like any other. Empty input: no rows. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.tile([1.0, 0.0], (b.num_rows, 1)) if model is None else model.of_texts([t.as_py() for t in b.column(1)])
            bad = 1 - p[:, 0]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(p @ np.arange(p.shape[1])), pa.array(p.argmax(axis=1), pa.int32()), pa.array(bad), pa.array(bad >= cutoff)],
                names=["doc_id", "severity", "grade", "p_toxic", "toxic"],
            )

    return pick(docs, id_col, text_col).select(F.col(id_col).cast("long"), text_col).mapInArrow(run, SCHEMA)


def drop_toxic(docs: DataFrame, labels: DataFrame, cutoff: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not toxic, all columns as they were. Each row is judged by its own text, whatever its id; nothing is shuffled."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    if model is None:
        return docs

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series(model.of_texts(list(texts))[:, 0] > 1 - cutoff)

    names = docs.columns
    plain = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    return plain.filter(clean(f"_c{names.index(text_col)}")).toDF(*names)


def op1_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
