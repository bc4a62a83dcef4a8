"""Mixing sources to target weights by soft domain membership; DataFrame and SQL functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, few_files, pick, table, written

#: Labelled documents that the classifier reads at most: those whose ids have the smallest hashes.
MAX_LABELLED = 20_000
#: Domains at most: the model has a number a feature and domain, and a round of ``fit`` a sum a pair of domains.
MAX_DOMAINS = 128
#: Words are hashed to so many features, all of which count; with the number of domains this bounds the broadcast model.
FEATURES = 1 << 17
BREAKS = "[\\s.,;:!?\"'()]+"
#: Sums of one aggregation at most; more are split over several.
SUMS = 512


def words(text: str) -> Column:
    return F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), BREAKS)


def feature(word: str) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(FEATURES)).cast("int")


def classifier(docs: DataFrame, labelled: DataFrame, domain_col: str = "domain", max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], list[float], DataFrame]:
    """(domains, log priors, model): a multinomial naive Bayes fitted on ``labelled`` (id, domain); model is (f, lp0, lp1, ...), a row a feature seen.

    Words are hashed to ``FEATURES`` features; none is left out. A domain's shares are smoothed towards those of all domains together, so a
    rare word speaks for the domain that has it, however large the others are, and a word never seen says nothing. Null ids and
    domains are left out; an id with several domains counts for the least. Every domain is a column of the model, and a pair of
    them a sum of ``fit``; more than ``MAX_DOMAINS`` are an error. Without labelled documents there is the one domain ``""``.
    """
    chosen = pick(labelled, id_col, domain_col).toDF("id", "dom").dropna().groupBy("id").agg(F.min("dom").alias("dom"))
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("id"), "id").limit(max_labelled))
    texts = written(pick(docs, id_col, text_col).toDF("id", "text").join(chosen, "id").select("dom", words("text").alias("ws")), "labelled")
    shares = {r["dom"]: r["n"] for r in texts.groupBy("dom").agg(F.count(F.lit(1)).alias("n")).collect()}  # max_labelled rows at most
    domains = sorted(shares) or [""]
    if len(domains) > MAX_DOMAINS:
        raise ValueError(f"{len(domains)} domains, at most {MAX_DOMAINS} are allowed")
    total = sum(shares.values())
    priors = [float(shares.get(d, 1)) / max(total, 1) for d in domains]
    k = range(len(domains))
    counts = texts.select("dom", F.explode("ws").alias("w")).filter("w <> ''").select("dom", feature("w").alias("f")).groupBy("f")
    counts = written(few_files(counts.agg(*[F.count(F.when(F.col("dom") == d, 1)).alias(f"n{i}") for i, d in enumerate(domains)]), FEATURES), "features")
    dropped(texts)
    sums = counts.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}") for i in k], F.count(F.lit(1)).alias("v")).first()
    everything = float(max(sum(sums[f"n{i}"] for i in k), 1))
    pooled = sum((F.col(f"n{i}") for i in k), F.lit(0)) * (sums["v"] / everything)
    return domains, [math.log(p) for p in priors], counts.select("f", *[F.log((F.col(f"n{i}") + pooled) / float(max(sums[f"n{i}"] + sums["v"], 1))).alias(f"lp{i}") for i in k])


def memberships(docs: DataFrame, model: tuple[list[str], list[float], DataFrame], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, p): an id's number of words and its posterior by domain. Rows that share an id, null included, are taken together."""
    domains, priors, table_ = model
    k = range(len(domains))
    known = F.broadcast(table_)  # at most FEATURES rows of a number a domain
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").select("doc_id", F.explode_outer(F.array_remove(words("text"), "")).alias("w"))
    rows = rows.select("doc_id", F.when(F.col("w").isNotNull(), feature("w")).alias("f"))
    got = rows.join(known, "f", "left").groupBy("doc_id").agg(F.count("f").alias("n"), *[F.coalesce(F.sum(f"lp{i}"), F.lit(0.0)).alias(f"l{i}") for i in k])
    logits = F.array(*[F.col(f"l{i}") + priors[i] for i in k])
    got = got.select("doc_id", "n", logits.alias("z")).select("doc_id", "n", F.transform("z", lambda x: F.exp(x - F.array_max("z"))).alias("e"))
    return got.select("doc_id", "n", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, b: a + b)).alias("p"))


def along(vector: list[float] | np.ndarray) -> Column:
    """The product of a document's posteriors with a value a domain."""
    return sum((float(x) * F.col("p")[i] for i, x in enumerate(vector)), F.lit(0.0))


def rate(steps: list[list[float]]) -> Column:
    """A document's rate after these gradient steps (a value a domain each) from rate 1: their sum, projected on rates >= 0."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - along(np.sum(steps, axis=0) if steps else []))


def smoothed(totals: list[float], power: float = 0.7) -> list[float]:
    """Target totals in proportion to a power of the present ones, scaled so that the largest domain stays as it is."""
    most = max(totals, default=0.0)
    return [most * (t / most) ** power if t > 0 else 0.0 for t in totals]


class NotConverged(RuntimeError):
    """The steps have not come to the optimum within the rounds allowed."""


@dataclass
class Fit:
    """``steps`` for ``rate``, the domains' totals before (``present``), wanted (``goal``) and reached (``expected``), and the rounds it took."""

    steps: list[list[float]] = field(default_factory=list)
    present: list[float] = field(default_factory=list)
    goal: list[float] = field(default_factory=list)
    expected: list[float] = field(default_factory=list)
    rounds: int = 0

    @property
    def residual(self) -> float:
        """The largest miss of a target, as a share of all tokens: next to 0 where the targets can be reached."""
        return max((abs(e - g) for e, g in zip(self.expected, self.goal)), default=0.0) / max(sum(self.present), 1.0)


def _sums(members: DataFrame, columns: list[Column]) -> list[float]:
    out: list[float] = []
    for at in range(0, len(columns), SUMS):
        out += [float(x or 0) for x in members.agg(*[F.sum(c).alias(f"s{i}") for i, c in enumerate(columns[at : at + SUMS])]).first()]
    return out


def fit(members: DataFrame, targets: list[float] | None, rounds: int = 100, tolerance: float = 1e-9, ridge: float = 1e-8) -> Fit:
    """Steps whose ``rate`` makes the expected tokens of each domain, the sum of rate * n * p, meet ``targets`` in least squares.

    Projected gradient over rates r >= 0 on the sum over domains of (expected - target)^2 / present, plus ``ridge`` times the sum of
    n (r - 1)^2, which of many optima takes the one that changes rates least. The steps add up in a value a domain, and the rates are the
    projection of what they add up to, so nothing is kept a document and a lost executor costs one aggregation. A step is the
    residual times the inverse of the documents' second moments, those at rate 0 left out, so a few rounds do; it is
    halved until the (convex) dual objective falls. A round is one aggregation to the sums of the domains and of the objective at the
    halvings, and one to the sums of the pairs of domains that a document has a share in. Runs until the optimality condition holds within ``tolerance`` (relative to all tokens) and raises
    ``NotConverged`` where ``rounds`` do not suffice. Targets out of reach are no error: see ``Fit.residual``.
    """
    one = members.first()
    k = len(one["p"]) if one else 0
    if not k:
        return Fit()
    n, p = F.col("n").cast("double"), [F.col("p")[i] for i in range(k)]
    present = np.array(_sums(members, [n * p[i] for i in range(k)]))
    goal = np.array(smoothed(list(present)) if targets is None else targets, float)
    scale = max(present.sum(), 1.0)
    weight = np.maximum(present, 1e-12 * scale)
    halvings = [0.5**h for h in range(12)]
    objective = lambda v, s: ridge / 2 * float(weight @ v**2) + float(goal @ v) + s

    def look(v: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, list[float]]:
        """Expected totals at ``v`` + ``step``, and the objective at all halvings of the step."""
        z = 1.0 - along(v + step)
        got = _sums(members, [F.when(z > 0, n * z * x) for x in p] + [n / 2 * F.pow(F.greatest(F.lit(0.0), 1.0 - along(v + h * step)), 2) for h in halvings])
        return np.array(got[:k]), [objective(v + h * step, s) for h, s in zip(halvings, got[k:])]

    def second_moments(v: np.ndarray) -> np.ndarray:
        shares = F.filter(F.transform("p", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"] > 1e-9)
        rows = members.filter(along(v) < 1).select(n.alias("n"), shares.alias("s"))
        rows = rows.select("n", "s", F.explode("s").alias("a")).select("n", "a", F.explode("s").alias("b")).filter("a.i >= b.i")
        out = np.zeros((k, k))
        for i, j, x in rows.groupBy("a.i", "b.i").agg(F.sum(F.col("n") * F.col("a.x") * F.col("b.x"))).toDF("i", "j", "x").collect():  # a row a pair of domains
            out[i, j] = out[j, i] = x
        return out

    v, steps = np.zeros(k), []
    expected, now = look(v, np.zeros(k))
    for done in range(rounds):
        value = now[0]
        gradient = ridge * weight * v + goal - expected
        miss = np.abs(gradient).max() / scale
        if miss <= tolerance:
            return Fit(steps, list(present), list(goal), list(expected), done)
        step = -np.linalg.solve(second_moments(v) + np.diag(ridge * weight), gradient)
        expected, now = look(v, step)
        h = next((h for h, x in zip(halvings, now) if x <= value + 1e-4 * h * float(gradient @ step)), halvings[int(np.argmin(now))])
        if min(now) >= value:  # below the precision of the sums
            if miss <= 1e3 * tolerance:
                return Fit(steps, list(present), list(goal), _sums(members, [n * rate(steps) * x for x in p]), done)
            raise NotConverged(f"no step improves on a gradient of {miss:.2g} of all tokens")
        if h < 1:
            step = h * step
            expected, now = look(v, step)
        v = v + step
        steps.append([float(x) for x in step])
    raise NotConverged(f"{rounds} rounds leave a gradient of {np.abs(ridge * weight * v + goal - expected).max() / scale:.2g} of all tokens")


def fit_rates(members: DataFrame, targets: list[float] | None, rounds: int = 100, tolerance: float = 1e-9) -> list[list[float]]:
    """The steps of ``fit``."""
    return fit(members, targets, rounds, tolerance).steps


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain") -> DataFrame:
    """One row per distinct id: doc_id, n_tokens (words), domain (likeliest), posteriors (map), rate (>= 0, expected copies), residual.

    ``targets`` are shares of the present total by domain (missing: 0; domains unknown to the classifier are ignored); None takes the
    present totals to the power 0.7 with the largest kept, so that rare domains are repeated and none is thinned. Null and empty texts
    have no words and the prior's memberships. Rows that share an id, null ids too, count as one document. No documents: no rows.
    residual, the same in all rows, is ``Fit.residual``: how far the rates are from the targets, next to 0 where those can be reached.
    """
    model = classifier(docs, labelled, domain_col, id_col=id_col, text_col=text_col)
    members = written(memberships(docs, model, id_col, text_col), "members")
    goal = None
    if targets is not None:
        all_tokens = float(members.agg(F.sum("n")).first()[0] or 0)
        share = sum(max(0.0, targets.get(d, 0.0)) for d in model[0]) or 1.0
        goal = [all_tokens * max(0.0, targets.get(d, 0.0)) / share for d in model[0]]
    found = fit(members, goal)
    names = F.array(*map(F.lit, model[0]))
    return members.select("doc_id", F.col("n").alias("n_tokens"), names[F.array_position("p", F.array_max("p")).cast("int") - 1].alias("domain"), F.map_from_arrays(names, "p").alias("posteriors"), rate(found.steps).alias("rate"), F.lit(found.residual).alias("residual"))


def resample(docs: DataFrame, mixed: DataFrame, keep_all: bool = True, seed: int = 7, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with each row as often as its rate says, all columns as they were: the whole part, and once more by the id's hash with the
    fraction as probability. ``keep_all`` keeps each row at least once.
    """
    names = docs.columns
    at = f"_c{names.index(id_col)}"
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 24)) / float(1 << 24)
    copies = (F.floor("rate") + F.when(u < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    copies = F.greatest(copies, F.lit(1)) if keep_all else copies
    chosen = mixed.select(F.col("doc_id").alias("_id"), copies.alias("_n")).filter("_n > 0")
    joined = docs.toDF(*[f"_c{i}" for i in range(len(names))]).join(chosen, F.col(at).eqNullSafe(F.col("_id")))
    return joined.withColumn("_k", F.explode(F.sequence(F.lit(1), "_n"))).drop("_id", "_n", "_k").toDF(*names)


def labelled_languages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of the default mix: the language of each document that ``labels`` holds."""
    ids = pick(labels, "doc_id").distinct().toDF("_id")
    return pick(docs, "doc_id", "lang").toDF("doc_id", "domain").join(ids, F.col("doc_id") == F.col("_id"), "left_semi")


def op2_target_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs, labelled_languages(docs, table(spark, sf_dir, "labels")))
