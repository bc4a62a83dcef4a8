import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidelog.llm import embeddings as E
from tidelog.llm import katz as K

from .cases import LONG, ROWS, frame, words


def brute(rows, threshold=0.98):
    good = [(k, i, lab, np.array(v, float)) for k, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(good)):
        for b in range(a):
            ka, _, la, x = good[a]
            kb, _, lb, y = good[b]
            if la == lb and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                links[ka] += 1
                links[kb] += 1
                root[find(ka)] = find(kb)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        c = find(k)
        least[c] = i if least.get(c) is None else min(least[c], i) if i is not None else least[c]
    return sorted((str(i), links[k], str(least[find(k)])) for k, (i, _, _) in enumerate(rows))


@pytest.mark.parametrize("block", [15, 20_000])
def test_embeddings_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    rng = np.random.default_rng(1)
    rows = []
    for g in range(60):
        base = rng.standard_normal(32)
        for _ in range(1 + g % 4 + 60 * (g == 0)):
            rows.append((len(rows), (base + 0.09 * rng.standard_normal(32)).astype(np.float32).tolist(), g % 3))
    rows += [(len(rows) + i, rows[i][1], rows[i][2]) for i in range(20)]
    odd = [None, [], [0.0] * 32, [float("nan")] * 32, [None] * 32, [1.0] * 16, [2.0] * 16, [1e-30] * 32, [2e-30] * 32]
    rows += [(1000 + i, v, 0) for i, v in enumerate(odd)]
    rows += [(None, rows[0][1], 0), (2000, rows[0][1], None), rows[3], rows[3], (2001, rows[0][1], 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, digest string, n int")
    got = E.near_vectors(df).collect()
    want = brute(rows)
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got) == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_recall_at_scale_of_a_table():
    rng = np.random.default_rng(2)
    base = E.unit(rng.standard_normal((4000, 64)))
    near = E.unit(base + 0.025 * rng.standard_normal(base.shape))
    cos = (base * near).sum(axis=1)
    q = E.iterative_quantisation(np.vstack([base, near])[::2])
    d = np.bitwise_count(q.keys(base) ^ q.keys(near)) <= 1
    close = cos >= 0.98
    assert close.sum() > 1000 and d.any(axis=1)[close].mean() > 0.999
    other = np.bitwise_count(q.keys(base) ^ q.keys(np.roll(base, 1, axis=0))) <= 1
    assert other.any(axis=1).mean() < 0.02
    ones = np.concatenate([(q.keys(base) >> b) & 1 for b in range(16)]).mean()
    assert 0.45 < ones < 0.55


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert E.near_vectors(df).count() == 0
    df = spark.createDataFrame([(1, None, 1), (2, [0.0], None)], df.schema)
    assert {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in E.near_vectors(df).collect()} == {(1, 0, 1, True), (2, 0, 2, True)}


def model(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) + ["/ "]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    uni, pairs, ctx, after = Counter(), Counter(), Counter(), defaultdict(set)
    for i, t in rows:
        if not out(i):
            w = tokens(t)
            uni.update(w)
            for a, b in zip(["// ", *w], w):
                pairs[a, b] += 1
                ctx[a] += 1
                after[a].add(b)
    of = lambda c: [0, *(sum(x == r for x in c.values()) for r in range(1, 7))]
    n, v = sum(uni.values()), len(uni)
    u, d = K.Unigrams(n, v, of(uni)), K.discounts(of(pairs))
    p1 = lambda w: float(u.p(np.array([uni.get(w, 0)]))[0])
    kept = lambda a, b: d[min(pairs[a, b], 6)] * pairs[a, b] / (ctx[a] + 1)
    alpha = {a: (1 - sum(kept(a, b) for b in f)) / (1 - sum(map(p1, f))) for a, f in after.items()}
    result = []
    for i, t in rows:
        w = tokens(t)
        s = sum(math.log10(kept(a, b)) if (a, b) in pairs else math.log10(p1(b)) + math.log10(alpha.get(a, 1)) for a, b in zip(["// ", *w], w))
        result.append((i, out(i), len(w), sum(x in uni for x in w), n, sum(math.log10((uni.get(x, 0) + 1) / (n + v + 1)) for x in w), s))
    total = {a: sum(kept(a, b) for b in f) + alpha[a] * (sum(p1(w) for w in uni if w not in f) + u.left) for a, f in list(after.items())[:20]}
    return result, total


@pytest.mark.parametrize("chunk", [500, 1 << 22])
def test_katz_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(K, "CHUNK", chunk)
    rnd = random.Random(6)
    rows = [(i, " ".join(words(rnd, rnd.randint(0, 120), 80 if i % 3 else 3000))) for i in range(150)] + [(r[0], r[1]) for r in ROWS if r[0] != 6]
    got = K.katz_scores(frame(spark, rows).repartition(3)).collect()
    want, total = model(rows)
    assert all(abs(t - 1) < 1e-9 for t in total.values())
    key = lambda r: (str(r[0]), round(r[6], 2))
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-5)


def test_katz_of_little(spark):
    assert K.katz_scores(frame(spark, [])).count() == 0
    for rows in ([(5, None)], [(i, "a b") for i in range(12)], [(6, LONG), (7, LONG)]):
        want, _ = model(rows)
        got = K.katz_scores(frame(spark, rows)).collect()
        for g, w in zip(sorted(map(tuple, got)), sorted(want)):
            assert g[:5] == w[:5] and math.isfinite(g[6]) and g[6] == pytest.approx(w[6], rel=1e-5)


def test_bytes_of_vector_and_label_do_not_run_together(spark):
    import struct

    from tidelog.llm.embeddings import near_vectors

    x = struct.unpack("<f", b"abcd")[0]
    rows = spark.createDataFrame([(1, [1.0, 2.0], "abcdefgh"), (2, [1.0, 2.0, x], "efgh"), (3, [1.0, 2.0], "abcdefgh")], "vec_id long, embedding array<float>, label string")
    got = {r["vec_id"]: tuple(r)[1:] for r in near_vectors(rows).collect()}
    assert got == {1: (1, 1, True), 2: (0, 2, True), 3: (1, 1, False)}
