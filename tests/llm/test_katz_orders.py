"""Katz backoff of higher orders, with cut contexts, and stored models, against the definition."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidelog.llm import katz as K

from .cases import ROWS, frame, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
START, STOP = ("start",), ("end",)


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), STOP]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


class Definition:
    def __init__(self, texts, order):
        self.order, self.c = order, [None, Counter(), *(Counter() for _ in range(2, order + 1))]
        self.after = defaultdict(set)
        for t in texts:
            w = [START] * (order - 1) + tokens(t)
            for i in range(order - 1, len(w)):
                self.c[1][w[i]] += 1
                for k in range(2, order + 1):
                    h = tuple(w[i - k + 1 : i])
                    self.c[k][h, w[i]] += 1
                    self.after[h].add(w[i])
        of = lambda c: [0, *(sum(x == r for x in c.values()) for r in range(1, 7))]
        self.u = K.Unigrams(sum(self.c[1].values()), len(self.c[1]), of(self.c[1]))
        self.d = [None, None, *(K.discounts(of(self.c[k])) for k in range(2, order + 1))]
        self.total = Counter()
        for k in range(2, order + 1):
            for (h, _), n in self.c[k].items():
                self.total[h] += n

    def kept(self, h, w):
        n = self.c[len(h) + 1][h, w]
        return self.d[len(h) + 1][min(n, 6)] * n / (self.total[h] + 1)

    def p(self, h, w):
        if not h:
            return float(self.u.p(np.array([self.c[1].get(w, 0)]))[0])
        if (h, w) in self.c[len(h) + 1]:
            return self.kept(h, w)
        return self.alpha(h) * self.p(h[1:], w)

    def alpha(self, h):
        if h not in self.after:
            return 1.0
        return (1 - sum(self.kept(h, w) for w in self.after[h])) / (1 - sum(self.p(h[1:], w) for w in self.after[h]))

    def score(self, t):
        w = [START] * (self.order - 1) + tokens(t)
        return sum(math.log10(self.p(tuple(w[i - self.order + 1 : i]), w[i])) for i in range(self.order - 1, len(w)))


def corpus(seed, n=120):
    rnd = random.Random(seed)
    return [(i, " ".join(words(rnd, rnd.randint(0, 90), 25 if i % 3 else 600))) for i in range(n)] + [r for r in ROWS if r[0] != 6]


@pytest.mark.parametrize("order,chunk,part", [(3, 1 << 21, 1 << 21), (3, 700, 400), (4, 2000, 900)])
def test_orders_against_the_definition(spark, monkeypatch, order, chunk, part):
    monkeypatch.setattr(K, "CHUNK", chunk)
    monkeypatch.setattr(K, "PART", part)
    monkeypatch.setattr(K.Model, "most", property(lambda m: max(40, m.total // (2 * m.parts))))  # contexts are cut here
    rows = corpus(order)
    model = Definition([t for i, t in rows if not held(i)], order)
    got = sorted(((str(r["doc_id"]), r["score"], r["base_score"], r["n_known"], r["train_tokens"]) for r in K.katz_scores(frame(spark, rows).repartition(3), order=order).collect()))
    n, v = sum(model.c[1].values()), len(model.c[1])
    base = lambda t: sum(math.log10((model.c[1].get(w, 0) + 1) / (n + v + 1)) for w in tokens(t))
    want = sorted((str(i), model.score(t), base(t), sum(w in model.c[1] for w in tokens(t)), n) for i, t in rows)
    for g, w in zip(got, want, strict=True):
        assert g[0] == w[0] and g[1:3] == pytest.approx(w[1:3], rel=1e-9) and g[3:] == w[3:]


def test_probabilities_of_a_context_sum_to_one(spark):
    model = Definition([t for _, t in corpus(9, 40)], 3)
    for h in [*list(model.after)[:15], (("x",), ("y",))]:
        assert sum(model.p(h, w) for w in model.c[1]) + model.p(h, ("new",)) * model.u.unseen == pytest.approx(1)


def test_a_stored_model_scores_new_texts(spark, monkeypatch):
    monkeypatch.setattr(K, "PART", 1000)
    rows, new = corpus(5), [(1000 + i, t) for i, t in enumerate(["w1 w2 w3 brand new", None, "w3 w3 w3 w1"] + [t for _, t in corpus(6, 20)])]
    scores, model = K.fit(frame(spark, rows), order=3)
    assert scores.count() == len(rows) and model.order == 3 and model.parts > 1
    definition = Definition([t for i, t in rows if not held(i)], 3)
    want = {i: definition.score(t) for i, t in new}
    got = {r["doc_id"]: r for r in K.score(frame(spark, new), model).collect()}
    assert all(got[i]["score"] == pytest.approx(want[i], rel=1e-9) and got[i]["held_out"] for i in want)
    for k in (2, 3):
        assert sorted(r["count"] for r in K.ngrams(spark, model, k).collect()) == sorted(definition.c[k].values())


def test_words_are_told_apart_by_themselves(spark, monkeypatch):
    """Under a hash that says the same of all words, counts stay exact."""
    from types import SimpleNamespace

    monkeypatch.setattr(K, "xxhash", SimpleNamespace(xxh3_64_intdigest=lambda w: 7))
    rows = corpus(8, 30)
    model = Definition([t for i, t in rows if not held(i)], 2)
    got = {r["doc_id"]: r["n_known"] for r in K.katz_scores(frame(spark, rows)).collect() if r["doc_id"] is not None and r["doc_id"] > 8}
    assert got == {i: sum(w in model.c[1] for w in tokens(t)) for i, t in rows if i is not None and i > 8}


def test_no_rows(spark):
    assert K.katz_scores(frame(spark, []), order=3).count() == 0
    with pytest.raises(ValueError):
        K.fit(frame(spark, []), order=1)


def test_a_fit_that_fails_leaves_no_tables(spark, monkeypatch):
    def fails(model):
        raise OSError("lost")

    monkeypatch.setattr(K, "evaluate", fails)
    before = {t.name for t in spark.catalog.listTables()}
    with pytest.raises(OSError):
        K.fit(frame(spark, [(1, "a b c"), (2, "a b d")]))
    assert {t.name for t in spark.catalog.listTables()} == before
