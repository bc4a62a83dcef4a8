import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tidelog.llm import components as C
from tidelog.llm import exact_dedup as X
from tidelog.llm import simhash as S
from tidelog.llm.common import new_path, split_hot

from .cases import LONG, ROWS, frame, words


def index(spark):
    return X.DigestIndex(spark, new_path(spark, "index"), 3)


def test_exact_dedup_of_odd_rows(spark):
    got = X.exact_dedup(frame(spark), index(spark)).collect()
    assert len(got) == len(ROWS)
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
    for r in got:
        ids = groups[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
    kept = defaultdict(int)
    for r in got:
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1}


def test_exact_dedup_drops_rows_and_keeps_columns(spark):
    docs = frame(spark)
    out = X.drop_copies(docs, index(spark))
    assert out.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in out.collect()) == sorted((str(i), t) for i, t in {(4, "a b c d e f g h"), (3, ""), (None, "x y"), *ROWS[7:]})
    assert X.drop_copies(frame(spark, []), index(spark)).count() == 0


def test_an_id_with_two_texts_loses_only_the_copy(spark):
    out = X.drop_copies(frame(spark, [(1, "a"), (1, "b"), (2, "a")]), index(spark)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == [(1, "b"), (2, "a")]


def test_index_is_kept_between_batches_and_sessions(spark):
    path = new_path(spark, "index")
    first = X.DigestIndex(spark, path, 3)
    X.exact_dedup(frame(spark, [(5, "a"), (6, "b")]), first)
    spark.sql(f"DROP TABLE {first.name}")  # as a new session without this table in its catalogue
    again = X.DigestIndex(spark, path)
    assert again.buckets == 3
    got = {r["doc_id"]: r for r in X.exact_dedup(frame(spark, [(9, "a"), (10, "c"), (11, "c")]), again).collect()}
    assert (got[9]["keep_id"], got[9]["kept"], got[9]["group_size"]) == (5, False, 2)
    assert (got[10]["kept"], got[11]["kept"], got[11]["keep_id"]) == (False, True, 11)
    assert again.rows.count() == 3
    plan = again.rows.join(again.rows.select("digest").distinct().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan


def reference_fingerprint(text):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reference_components(fps, tau=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= tau:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", ["", None, "a", "a b c d", "a b c d e", "A b\tC\nD e e e", LONG[:5000], "日本 ünï \x85 x 　 y z"])
def test_fingerprint(text):
    assert S.fingerprint(text) == reference_fingerprint(text)


def test_long_texts_are_hashed_in_chunks(monkeypatch):
    whole = S.fingerprint(LONG)
    monkeypatch.setattr(S, "CHUNK", 1000)
    assert S.fingerprint(LONG) == whole


def near(rnd, base, flips):
    for b in rnd.sample(range(64), flips):
        base ^= 1 << b
    return base


@pytest.mark.parametrize("block", [10, 100_000])
def test_links_lose_no_component(spark, block):
    rnd = random.Random(7)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        x = rnd.getrandbits(64)
        fps |= {x} | {near(rnd, x, rnd.randint(1, 6)) for _ in range(rnd.randint(0, 6))}
    ball = rnd.getrandbits(64)
    fps |= {near(rnd, ball, rnd.randint(1, 5)) for _ in range(150)}
    for _ in range(12):  # a chain, each link at the limit
        ball = near(rnd, ball, 4)
        fps.add(ball)
    fps = sorted(fps)
    signed = [int(np.array(x, np.uint64).view(np.int64)) for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {r["node"]: r["component"] for r in C.connected_components(S.links(df, 4, block)).collect()}
    want = reference_components(fps)
    got = [found.get(x, x) for x in signed]
    assert len(set(got)) == len(set(want)) == len(set(zip(got, want)))


def test_pigeonring_misses_no_pair():
    rnd = random.Random(1)
    seg = S.segments(64, 4)
    for _ in range(300):
        x = near(rnd, 0, rnd.randint(1, 4))
        parts = [(x >> s & (1 << w) - 1).bit_count() for s, w in seg]
        assert any(all(sum(parts[(i + k) % 5] for k in range(n + 1)) <= n for n in range(5)) for i in range(5))


def test_near_groups_against_brute_force(spark):
    rnd = random.Random(2)
    rows, k = [], 0
    for _ in range(25):
        base = words(rnd, rnd.choice([5, 60, 300]))
        for _ in range(rnd.randint(1, 4)):
            copy = list(base)
            for _ in range(rnd.randint(0, 2)):
                copy[rnd.randrange(len(copy))] = "changed"
            rows.append((k, " ".join(copy)))
            k += 1
    rows += [(100 + i if i is not None else None, t) for i, t in ROWS if i != 6]
    got = S.near_groups(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    fps = [reference_fingerprint(t) for _, t in rows]
    comp = reference_components(fps)
    least = {c: min((i for (i, _), d in zip(rows, comp) if d == c and i is not None), default=None) for c in set(comp)}
    want = sorted((str(i), f"{f:016x}", str(least[c])) for (i, _), f, c in zip(rows, fps, comp))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want
    kept = S.drop_near_copies(frame(spark, rows))
    assert {r["doc_id"] for r in kept.collect()} == {i for (i, _), c in zip(rows, comp) if i is None or least[c] == i}


def test_nothing_to_group(spark):
    assert S.near_groups(frame(spark, [])).count() == 0
    assert C.connected_components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 180)] + [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in C.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_each_pair_of_a_hot_key_meets_once(spark):
    df = spark.createDataFrame([(1, i) for i in range(30)] + [(2, 99), (None, 5)], "k int, id long")
    met = defaultdict(int)
    groups = defaultdict(list)
    for r in split_hot(df, ["k"], "id", 7).collect():
        groups[r["k"], r["part_a"], r["part_b"]].append((r["id"], r["part"]))
    for (_, a, b), rows in groups.items():
        for i, p in rows:
            for j, q in rows:
                if i < j and (p != q or a == b):
                    met[i, j] += 1
    assert len(met) == 30 * 29 / 2 and set(met.values()) == {1}
