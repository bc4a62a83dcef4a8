"""Ranked search, exact top-k search and clustering against plain loops, and odd rows."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.cases import frame, words
from tidelog.llm import clustering, lexical, topk
from tidelog.llm.integers import TOO_LONG

ITEMS = "item_id long, text string, DOC_ID string, score string, terms int"
VECTORS = "vec_id long, embedding array<double>, label int, dim string, VEC string, query_id long, cluster string"


def ranked(docs, items, top=20):
    """Every document against every item, as the contract has it."""
    tables = [(i, Counter(lexical.terms_of((t or "").encode()))) for i, t in docs]
    size = [sum(c.values()) for _, c in tables]
    n, total = sum(1 for s in size if s), sum(size)
    df = Counter(t for _, c in tables for t in c)
    out = []
    for item, text in items:
        q = Counter(lexical.terms_of((text or "").encode()))
        scores = []
        for (doc, c), s in zip(tables, size):
            m = 100 - 25 + (25 * s * n) // max(total, 1)
            x = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in q.items() if c[t])
            if x > 0:
                scores.append((-x, doc is None, doc))
        out += [(item, r + 1, doc, -x) for r, (x, _, doc) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:top])]
    return sorted(out, key=str)


def same_rank(spark, docs, items, **kw):
    got = lexical.search(docs, spark.createDataFrame([(i, t, "x", "y", 1) for i, t in items], ITEMS), **kw).collect()
    assert sorted(map(tuple, got), key=str) == ranked([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], items, kw.get("top", 20))


def test_ranks_are_those_of_brute_force(spark, monkeypatch):
    rnd = random.Random(1)
    docs = frame(spark, [(i, " ".join(words(rnd, rnd.randrange(0, 60), 80))) for i in range(300)] + [(900 + i, "w1 w2 W3!w4") for i in range(40)])
    items = [(i, " ".join(words(rnd, 12, 90))) for i in range(25)]
    same_rank(spark, docs, items)
    monkeypatch.setattr(lexical, "PAIRS", 40)  # many blocks of items, the odd one beyond the bound
    same_rank(spark, docs, [*items[:6], (77, " ".join(f"w{i}" for i in range(60)))], top=7)


def test_entries_are_sorted_in_chunks_of_any_size(spark):
    rnd = random.Random(2)
    block = lexical.Block()
    for i in range(9):
        block.add(i, [b"w%d" % j for j in range(i, i + 10)], [1] * 10)
    docs = lexical.matched(frame(spark, [(i, " ".join(words(rnd, 20, 30))) for i in range(50)]).select("doc_id", "text").coalesce(1), block.terms)
    stats = [r.asDict() for r in docs.collect()]
    df = Counter(t for r in stats for t in r["terms"])
    whole = sorted(map(tuple, lexical.best(docs, block, 50, 1000, df, 5).collect()))
    was = lexical.ENTRIES
    try:
        for lexical.ENTRIES in (1, 70, 1000):
            assert sorted(map(tuple, lexical.best(docs, block, 50, 1000, df, 5).collect())) == whole
    finally:
        lexical.ENTRIES = was


def test_radix_order_is_a_stable_sort():
    rnd = np.random.default_rng(3)
    for key in (rnd.integers(0, 1 << 32, 5000), rnd.integers(0, 9, 5000) << 16, np.zeros(0, np.int64), rnd.integers(0, 1 << 20, 5000)):
        assert (lexical.radix_order(key.astype(np.uint32)) == np.argsort(key, kind="stable")).all()
    item, slot, impact = rnd.integers(0, 50, 4000), rnd.integers(0, 60, 4000), rnd.integers(0, 1 << 40, 4000)
    want = Counter()
    for i, s, x in zip(item.tolist(), slot.tolist(), impact.tolist()):
        want[i, s] += x
    assert dict(zip(zip(*(a.tolist() for a in lexical.accumulated(item, slot, impact)[:2])), lexical.accumulated(item, slot, impact)[2].tolist())) == want


def test_terms_lower_case_ascii_alone():
    assert lexical.terms_of("Ünï-Code ÀB_c 9z\x00KK".encode()) == [x.encode() for x in ("Ünï", "code", "Àb", "c", "9z", "kK")]


@pytest.mark.parametrize("items", [[], [(1, None), (2, ""), (3, "...")], [(1, "alpha A, h"), (None, "b"), (5, "ünïcode x")]])
def test_odd_documents_and_items(spark, items):
    same_rank(spark, frame(spark), items)
    same_rank(spark, frame(spark, []), items)


def test_rows_of_one_item_count_with_the_smallest_text(spark):
    docs = frame(spark, [(1, "a b"), (2, "b c"), (3, "d"), (4, "e")])
    items = spark.createDataFrame([(1, "c", "", "", 0), (1, "b", "", "", 0), (1, "b", "", "", 0)], ITEMS)
    assert [r["doc_id"] for r in lexical.search(docs, items).orderBy("rank").collect()] == [1, 2]


ODD = [(None, [1.0, 2.0]), (50, None), (100, []), (150, [1.0, None]), (200, [float("nan"), 1.0]), (250, [float("inf"), 1.0]), (300, [1e300, 1.0]), (350, [0.5]), (400, [1.0, 2.0]), (400, [1.0, -2.0]), (401, [3.0, 3.0]), (402, [0.0, 0.0])]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "d", "v", 3, "c") for i, v in rows], VECTORS)


def integers(v):
    if not v or any(x is None or not math.isfinite(x) for x in v) or sum(math.floor(256 * x) ** 2 for x in v) >= TOO_LONG:
        return None
    return [math.floor(256 * x) for x in v]


def neighbours(rows, top=5):
    found = [(i, integers(v)) for i, v in rows if i is not None and integers(v)]
    asked = {}
    for i, v in found:
        if i % 50 == 0:
            asked[i] = min(asked.get(i, v), v, key=lambda x: np.array(x, "<i8").tobytes())
    out = []
    for q, v in asked.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in found if i != q and len(v) == len(w))[:top]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def cloud(n, dim, seed, centres=6):
    rnd = np.random.default_rng(seed)
    return (rnd.normal(size=(centres, dim))[rnd.integers(0, centres, n)] + 0.2 * rnd.normal(size=(n, dim))).tolist()


@pytest.mark.parametrize("dim", [1, 3, 64, 70])
def test_neighbours_are_those_of_brute_force(spark, dim):
    rows = list(enumerate(cloud(600, dim, dim))) + [(1000 + i, [0.25] * dim) for i in range(200)]
    assert sorted(map(tuple, topk.nearest(vectors(spark, rows)).collect())) == neighbours(rows)


def test_neighbours_in_blocks_of_queries_without_a_sample(spark, monkeypatch):
    rows = list(enumerate(cloud(700, 8, 5)))
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "SAMPLE", 1)
    assert sorted(map(tuple, topk.nearest(vectors(spark, rows)).collect())) == neighbours(rows)


def test_odd_vectors_have_neighbours_where_they_can(spark):
    assert sorted(map(tuple, topk.nearest(vectors(spark, ODD)).collect())) == neighbours(ODD)
    assert topk.nearest(vectors(spark, [])).collect() == []
    assert topk.nearest(vectors(spark, [(50, [1.0])])).collect() == []  # nothing else there


def test_statistics_bound_the_product_and_get_finer():
    rnd = np.random.default_rng(7)
    x = np.floor(rnd.normal(size=(60, 50)) * 100).astype(np.int64)
    bounds = [topk.statistics(x, s) @ topk.statistics(x, s).T for s in topk.levels(50)]
    assert all((b >= x @ x.T - 1e-6).all() for b in bounds) and bounds[0].sum() > bounds[-1].sum()


def test_most_pairs_are_ruled_out_in_clustered_vectors():
    x = np.floor(256 * np.array(cloud(4000, 64, 9, 40))).astype(np.int64)
    q = topk.Queries(np.arange(50), x[:50])
    s = topk.Search(q, 5)
    s.see(np.arange(2000), x[:2000])
    i, _ = topk.survivors(q, slice(0, 50), x[2000:], [topk.statistics(x[2000:], n) for n in topk.levels(64)], np.linalg.norm(x[2000:].astype(float), axis=1))
    assert len(i) < 0.2 * 50 * 2000


def clustered(rows, k=40, rounds=5):
    found = [(i, v) for i, v in ((i, integers(v)) for i, v in rows if v and len(v) == 64) if v]
    key = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], "<i8").tobytes())
    c = [v for _, v in sorted(found, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in enumerate(c))
    for _ in range(rounds):
        groups = {}
        for _, v in found:
            groups.setdefault(near(v)[1], []).append(v)
        c = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else w for j, w in enumerate(c)]
    got = [(i, *near(v)[::-1]) for i, v in found]
    by, total = Counter(), sum(d for _, _, d in got)
    for _, j, d in got:
        by[j] += d
    return sorted(((i, j, d, by[j], total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in got), key=str)


def test_clusters_are_those_of_brute_force(spark):
    rows = list(enumerate(cloud(400, 64, 11, 15))) + [(1000 + i, [-0.01] * 64) for i in range(150)]
    assert sorted(map(tuple, clustering.clusters(vectors(spark, rows)).collect()), key=str) == clustered(rows)


def test_odd_vectors_are_clustered(spark):
    some = cloud(5, 64, 13)
    rows = [*ODD, (1, some[0]), (1, some[0]), (1, some[1]), (None, some[2]), (7, some[3][:63]), (8, [*some[4][:63], None]), (9, [*some[4][:63], float("-inf")]), (10, [1e200] * 64)]
    assert sorted(map(tuple, clustering.clusters(vectors(spark, rows)).collect()), key=str) == clustered(rows)
    assert clustering.clusters(vectors(spark, [])).collect() == []


def test_screening_leaves_few_centroids_and_the_right_one():
    x = np.floor(256 * np.array(cloud(2000, 64, 15, 40))).astype(np.int64)
    c = x[:40]
    norms = clustering.block_norms(x)
    j, d = clustering.assign(x, norms, c, norms[:40])
    every = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (d == every.min(axis=1)).all() and (j == every.argmin(axis=1)).all()
    bound = (norms**2).sum(axis=1)[:, None] + (norms[:40] ** 2).sum(axis=1)[None] - 2 * norms @ norms[:40].T
    assert (bound <= every + 1e-6 * every.max()).all()
