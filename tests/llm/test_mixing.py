import random
from collections import Counter

import numpy as np
import pytest

from tidelog.llm import mixing as M

from .cases import ROWS, frame

VOC = {"en": ["the", "and", "of", "thing"], "de": ["der", "und", "von", "ding"], "fr": ["le", "et", "de", "chose"]}


def corpus(seed, shares=(70, 20, 10)):
    rnd = random.Random(seed)
    rows, lang = [], {}
    for k, n in zip(VOC, shares):
        for _ in range(n):
            i = len(rows)
            rows.append((i, " ".join(rnd.choice(VOC[k]) for _ in range(rnd.randint(5, 80)))))
            lang[i] = k
    return rows, lang


def labelled(spark, lang, every=2):
    return spark.createDataFrame([(i, k) for i, k in lang.items() if i % every == 0], "doc_id long, domain string")


@pytest.mark.parametrize("targets", [{"en": 0.2, "de": 0.3, "fr": 0.5}, {"en": 1.0}, None])
def test_expected_tokens_meet_the_targets(spark, targets):
    rows, lang = corpus(1)
    got = M.mix(frame(spark, rows), labelled(spark, lang), targets).collect()
    assert len(got) == len(rows) and all(r["rate"] >= 0 for r in got)
    assert sum(r["domain"] == lang[r["doc_id"]] for r in got) >= 0.98 * len(got)
    n, p, rate = (np.array(x) for x in ([r["n_tokens"] for r in got], [[r["posteriors"][k] for k in sorted(VOC)] for r in got], [r["rate"] for r in got]))
    assert np.allclose(p.sum(axis=1), 1)
    present, expected = n @ p, (rate * n) @ p
    want = np.array([targets.get(k, 0) for k in sorted(VOC)]) * n.sum() if targets else present.max() * (present / present.max()) ** 0.7
    assert np.abs(expected - want).max() < 0.01 * n.sum()


def test_steps_reach_the_least_squares_optimum(spark):
    rng = np.random.default_rng(0)
    n, p = rng.integers(5, 50, 60), rng.dirichlet([0.3] * 3, 60)
    df = spark.createDataFrame([(i, int(a), list(map(float, b))) for i, (a, b) in enumerate(zip(n, p))], "doc_id long, n long, p array<double>")
    present, goal = n @ p, np.array([50.0, 900.0, 400.0])
    steps = M.fit_rates(df, list(goal), rounds=200)
    got = np.array([r["rate"] for r in df.select("doc_id", M.rate(steps).alias("rate")).orderBy("doc_id").collect()])
    r = np.ones(60)
    for _ in range(20000):
        r = np.maximum(0, r - p @ (((r * n) @ p - goal) / present))
    f = lambda x: ((((x * n) @ p - goal) ** 2) / present).sum()
    assert (got >= 0).all() and f(got) <= f(r) + 1e-2


def test_resampling_takes_effect(spark):
    rows, lang = corpus(2)
    docs = frame(spark, rows)
    mixed = M.mix(docs, labelled(spark, lang), {"en": 0.2, "de": 0.4, "fr": 0.4})
    rates = {r["doc_id"]: r["rate"] for r in mixed.collect()}
    for keep in (False, True):
        out = M.resample(docs, mixed, keep_all=keep)
        assert out.columns == docs.columns
        got = Counter(r["doc_id"] for r in out.collect())
        for i, rate in rates.items():
            assert got[i] in ({max(1, int(rate)), int(rate) + 1} if keep else {int(rate), int(rate) + 1})


def test_odd_rows(spark):
    docs = frame(spark)
    none = spark.createDataFrame([], "doc_id long, domain string")
    for lab in (none, spark.createDataFrame([(1, "en"), (None, "de"), (2, None), (6, "xx"), (6, "de")], none.schema)):
        got = M.mix(docs, lab).collect()
        assert Counter(r["doc_id"] for r in got) == Counter({i for i, _ in ROWS})
        assert M.resample(docs, M.mix(docs, lab)).count() >= len(ROWS)
    assert M.mix(frame(spark, []), none).count() == 0
    many = spark.createDataFrame([(i, f"d{i}") for i in range(70)], none.schema)
    got = M.mix(frame(spark, [(i, f"x{i} y") for i in range(70)]), many).collect()  # as many domains as there are
    assert len(got) == 70 and all(r["domain"] == f"d{r['doc_id']}" for r in got)
    assert M.labelled_languages(docs, spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, toxic int")).count() == 3


def test_no_python_in_the_plan(spark):
    rows, lang = corpus(3)
    plan = M.mix(frame(spark, rows), labelled(spark, lang))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_reachable_targets_are_met_and_a_fit_cut_short_says_so(spark):
    rng = np.random.default_rng(0)
    n, p = rng.integers(5, 50, 60), rng.dirichlet([0.3] * 3, 60)
    df = spark.createDataFrame([(i, int(a), list(map(float, b))) for i, (a, b) in enumerate(zip(n, p))], "doc_id long, n long, p array<double>")
    got = M.fit(df, [50.0, 900.0, 400.0])
    rates = np.array([r["rate"] for r in df.select("doc_id", M.rate(got.steps).alias("rate")).orderBy("doc_id").collect()])
    assert np.allclose((rates * n) @ p, [50, 900, 400], rtol=1e-3) and got.residual < 1e-4 and got.rounds < 30
    with pytest.raises(M.NotConverged):
        M.fit(df, [50.0, 900.0, 400.0], rounds=1)
    far = M.fit(df, [0.0, 2000.0, 0.0])  # out of reach: the least squares, with the miss reported
    r = np.ones(60)
    present = n @ p
    for _ in range(50000):
        r = np.maximum(0, r - p @ (((r * n) @ p - [0, 2000, 0]) / present))
    f = lambda e: (((np.array(e) - [0, 2000, 0]) ** 2) / present).sum()
    assert f(far.expected) <= f((r * n) @ p) + 1e-2 and far.residual > 0


def test_rates_against_brute_force(spark):
    """The whole operator against plain Python: hashed naive Bayes, then projected gradient steps a document."""
    rows, lang = corpus(4)
    got = {r["doc_id"]: r for r in M.mix(frame(spark, rows), labelled(spark, lang)).collect()}
    code = {r["w"]: r["f"] for r in spark.createDataFrame([(w,) for ws in VOC.values() for w in ws], "w string").select("w", M.feature("w").alias("f")).collect()}
    domains = sorted(VOC)
    count = {d: Counter() for d in domains}
    for i, t in rows:
        if i % 2 == 0:
            count[lang[i]].update(code[w] for w in t.split())
    total = {d: sum(c.values()) for d, c in count.items()}
    seen = set().union(*count.values())
    pool = {f: sum(c[f] for c in count.values()) / sum(total.values()) for f in seen}
    prior = Counter(lang[i] for i, _ in rows if i % 2 == 0)
    p = []
    for _, t in rows:
        z = np.array([np.log(prior[d] / prior.total()) + sum(np.log((count[d][code[w]] + len(seen) * pool[code[w]]) / (total[d] + len(seen))) for w in t.split()) for d in domains])
        e = np.exp(z - z.max())
        p.append(e / e.sum())
    p, n = np.array(p), np.array([len(t.split()) for _, t in rows])
    assert all(np.allclose([got[i]["posteriors"][d] for d in domains], q, atol=1e-9) and got[i]["n_tokens"] == k for (i, _), q, k in zip(rows, p, n))
    present = n @ p
    goal = present.max() * (present / present.max()) ** 0.7
    total_r = np.zeros(len(rows))
    for _ in range(20000):
        r = np.maximum(0, 1 - total_r)
        total_r += p @ (((r * n) @ p - goal) / present)
    assert np.allclose([got[i]["rate"] for i, _ in rows], np.maximum(0, 1 - total_r), rtol=1e-3, atol=1e-3)


def test_too_many_domains_are_an_error(spark):
    rows = [(i, f"w{i} x") for i in range(M.MAX_DOMAINS + 1)]
    with pytest.raises(ValueError, match="domains"):
        M.classifier(frame(spark, rows), spark.createDataFrame([(i, f"d{i}") for i, _ in rows], "doc_id long, domain string"))
