import random

import numpy as np
import pytest

from tidelog.llm import toxicity as T

from .cases import LONG, ROWS, frame, words

BAD = ["scum", "idiot", "trash", "moron"]


def corpus(n, seed):
    rnd = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = words(rnd, rnd.randint(20, 200), 500)
        toxic = i % 4 == 0
        for _ in range(rnd.randint(1, 4) if toxic else 0):
            w.insert(rnd.randrange(len(w)), rnd.choice(BAD) + rnd.choice(["", ".", ","]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_documents_are_told_apart(spark):
    rows, labels = corpus(600, 1)
    docs = frame(spark, rows)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = T.fit(docs, lab.filter("doc_id < 400"))
    assert list(model.thresholds) == sorted(model.thresholds)
    got = {r["doc_id"]: r for r in T.score(docs, model).collect()}
    held = [(got[i]["toxic"], bool(y)) for i, _, y in labels if i >= 400]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(0 <= r["severity"] <= len(model.thresholds) and 0 <= r["p_toxic"] <= 1 for r in got.values())
    kept = {r["doc_id"] for r in T.drop_toxic(docs, lab).collect()}
    assert sum(i in kept for i, _, y in labels if not y) >= 0.98 * 450 and sum(i in kept for i, _, y in labels if y) <= 5


def test_one_weight_a_word_and_ordered_grades():
    rng = np.random.default_rng(0)
    n, k = 3000, 6
    x = rng.random((n, k)) < 0.4
    true = np.array([2.0, 1.5, -1.0, 0.0, 0.0, 1.0])
    y = np.digitize(x @ true + rng.logistic(size=n), [0.5, 2.0, 3.5])
    rows, cols = np.nonzero(x)
    w, theta = T.fit_ordinal(rows, cols, y, k, 3, l2=0.1, steps=600)
    assert np.abs(w - true).max() < 0.35 and np.abs(theta - [0.5, 2.0, 3.5]).max() < 0.5
    m = T.OrdinalModel({}, theta)
    p = m.probabilities(np.array([-3.0, 0.0, 3.0]))
    assert np.allclose(p.sum(axis=1), 1) and (np.diff(p @ np.arange(4)) > 0).all()


def test_grades_that_are_given(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join([*words(rnd, 30, 200), *["scum"] * (i % 3 > 0), *["idiot"] * (i % 3 > 1)])) for i in range(300)]
    lab = spark.createDataFrame([(i, i % 3) for i in range(300)], "doc_id long, g int")
    model = T.fit(frame(spark, rows), lab, grade_col="g")
    got = T.score(frame(spark, rows), model).collect()
    assert sum(r["grade"] == r["doc_id"] % 3 for r in got) > 280


def test_odd_rows_and_labels(spark):
    docs = frame(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for lab in (none, spark.createDataFrame([(1, 1, 0), (None, 0, 1), (2, None, None)], none.schema)):
        model = T.fit(docs, lab)
        assert model is None
        assert {(r["severity"], r["toxic"]) for r in T.score(docs, model).collect()} == {(0.0, False)}
        assert T.drop_toxic(docs, lab).count() == len(ROWS)
    rows, labels = corpus(200, 2)
    model = T.fit(frame(spark, rows), spark.createDataFrame(labels + labels[:50], none.schema))
    got = T.score(frame(spark, [*ROWS, (50, LONG + " scum idiot trash moron")]), model).collect()
    assert len(got) == len(ROWS) + 1 and [r["toxic"] for r in got if r["doc_id"] == 50] == [True]
    assert not any(r["toxic"] for r in got if r["doc_id"] in (2, 3, 5)) and T.score(frame(spark, []), model).count() == 0
    assert T.drop_toxic(docs, spark.createDataFrame(labels, none.schema)).columns == docs.columns


def test_query_against_brute_force(spark):
    """The fitted severities against plain Python: named features, and gradient descent to the one optimum of the penalised likelihood."""
    rows, labels = corpus(120, 7)
    rows += [(200 + i, t) for i, (_, t) in enumerate(rows[:5])] + [(300, None), (301, "")]
    got = {r["doc_id"]: r for r in T.score(frame(spark, rows), T.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), steps=400, tolerance=1e-5)).collect()}

    def features(t):
        w = {x.strip(T.PUNCTUATION) for x in (t or "").lower().split()} - {""}
        return w | {x[:4] + "*" for x in w if len(x) > 5}

    def telling(w):  # log odds in standard errors
        hits = [[w in features(t) for (_, t), (_, _, k) in zip(rows, labels) if k == y] for y in (0, 1)]
        low, high = (sum(h) + 0.5 for h in hits)
        a, b = len(hits[1]) + 1 - high, len(hits[0]) + 1 - low
        return abs(np.log(high / a) - np.log(low / b)) / np.sqrt(1 / high + 1 / low) >= T.SIGNIFICANT

    names = [w for w in sorted(set().union(*(features(t) for _, t in rows))) if telling(w)]
    x = np.array([[w in features(t) for w in names] for _, t in rows], float)
    y = np.array([k for _, _, k in labels])
    w, theta = np.zeros(len(names)), 0.0
    for _ in range(20000):  # P(toxic) = sigmoid(score - theta)
        p = 1 / (1 + np.exp(-(x[: len(y)] @ w - theta)))
        w -= 0.02 * (x[: len(y)].T @ (p - y) + 0.1 * w)
        theta -= 0.02 * -(p - y).sum()
    want = 1 / (1 + np.exp(-(x @ w - theta)))
    assert all(abs(got[i]["severity"] - v) < 1e-3 and got[i]["grade"] == (v > 0.5) and got[i]["toxic"] == (v >= 0.5) for (i, _), v in zip(rows, want))


def test_rows_without_an_id_are_judged_by_their_own_texts(spark):
    rows, labels = corpus(200, 2)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    more = [(None, "scum idiot trash moron scum"), (None, "w1 w2 w3"), (None, None), (1, "scum idiot trash moron")]
    kept = [(r["doc_id"], r["text"]) for r in T.drop_toxic(frame(spark, rows + more), lab).collect()]
    assert (None, "w1 w2 w3") in kept and (None, None) in kept and more[0] not in kept and more[3] not in kept and rows[1] in kept


def test_a_fit_that_is_cut_short_is_an_error(spark):
    rows, labels = corpus(200, 3)
    with pytest.raises(T.NotConverged):
        T.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), steps=2)


def test_of_texts_that_share_an_id_the_smallest_is_learned(spark):
    rows, labels = corpus(200, 4)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    more = [(i, "zzz " + t) for i, t in rows]
    once = T.fit(frame(spark, rows), lab)
    for shuffled in (rows + more, more + rows):
        twice = T.fit(frame(spark, shuffled), lab)
        assert (once.weights == twice.weights).all() and (once.thresholds == twice.thresholds).all()
