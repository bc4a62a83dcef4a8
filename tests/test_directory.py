"""Positions and range fingerprints from what a store keeps beside its segments."""

import hashlib
import random
import threading

import pytest
from pyspark.sql import functions as F

from tidelog.sources import directory as D
from tidelog.sources.log import scratch_path
from tidelog.sources.store import LogStore, Manifest, ReplayError

from .test_changelog import log
from .test_store_bounds import key


def filled(spark, monkeypatch, batches, leaf=8):
    monkeypatch.setattr(D, "LEAF", leaf)
    store = LogStore(spark, scratch_path(spark, "t"))
    for keys in batches:
        store.append(log(spark, keys))
    return store


def spread(seed, n=400, top=1 << 40):
    rnd = random.Random(seed)
    return sorted({rnd.choice([rnd.randrange(top), rnd.randrange(5000), 7_000_000 + rnd.randrange(300)]) for _ in range(n)})


def fp(keys):
    x = 0
    for k in keys:
        x ^= int.from_bytes(hashlib.sha256(bytes.fromhex(key(k))).digest()[:12], "big")
    return f"{x:024x}"


@pytest.mark.parametrize("leaf", [4, 100_000])
def test_fingerprints_of_ranges(spark, monkeypatch, leaf):
    keys = spread(1)
    store = filled(spark, monkeypatch, [keys[::3], keys[1::3], keys[2::3][:40]], leaf)
    there = sorted([*keys[::3], *keys[1::3], *keys[2::3][:40]])
    rnd = random.Random(2)
    bounds = [None, 0, there[5], there[5] + 1, 1 << 47, *(rnd.randrange(1 << 40) for _ in range(5)), *rnd.sample(there, 5)]
    ranges = [(a, b) for a in bounds for b in bounds if rnd.random() < 0.5]
    df = spark.createDataFrame([(None if a is None else key(a), None if b is None else key(b), i) for i, (a, b) in enumerate(ranges)], "lower string, upper string, i int")
    got = {r["i"]: (r["n"], r["fp"]) for r in store.fingerprints(df).collect()}
    inside = [[k for k in there if (a is None or a <= k) and (b is None or k < b)] for a, b in ranges]
    assert got == {i: (len(x), fp(x)) for i, x in enumerate(inside)}


def test_inner_rows_are_not_read(spark, monkeypatch):
    store = filled(spark, monkeypatch, [range(i * 1000, i * 1000 + 500) for i in range(6)], 16)
    asked = []
    real = D.Directory.rows_of
    monkeypatch.setattr(D.Directory, "rows_of", lambda self, paths: asked.append(paths) or real(self, paths))
    r = store.fingerprints(spark.createDataFrame([(key(250), key(5250))], "lower string, upper string")).first()
    assert r["n"] == 250 + 4 * 500 + 250
    segments = {p.split("/")[-2] for p in asked[0]}
    assert segments <= {store.manifest().segments[0], store.manifest().segments[5]}


def test_slices_of_many_segments_read_few_files(spark, monkeypatch):
    keys = list(range(0, 6000, 2))
    store = filled(spark, monkeypatch, [keys[i * 250 : (i + 1) * 250] for i in range(12)], 16)
    asked = []
    real = D.Directory.rows_of
    monkeypatch.setattr(D.Directory, "rows_of", lambda self, paths: asked.append(paths) or real(self, paths))
    got = store.slice(1300, 1320)
    assert sorted((r["pos"], r["n"]) for r in got.collect()) == [(i, keys[i]) for i in range(1300, 1320)]
    assert all(len({p.split("/")[-2] for p in paths}) <= 2 for paths in asked) and asked


@pytest.mark.parametrize("leaf", [4, 100_000])
def test_slices_of_segments_that_overlap(spark, monkeypatch, leaf):
    keys = spread(3)
    store = filled(spark, monkeypatch, [keys[::2], keys[1::5], keys[3::10]], leaf)
    there = sorted({*keys[::2], *keys[1::5], *keys[3::10]})
    for begin, end in ((0, 3), (40, 90), (len(there) - 4, len(there) + 9)):
        assert sorted((r["pos"], r["n"]) for r in store.slice(begin, end).collect()) == list(enumerate(there))[begin:end]
    assert store.slice(5, 5) is None and store.slice(len(there), len(there) + 5).count() == 0
    store.compact()
    assert [r["n"] for r in store.slice(40, 60).orderBy("pos").collect()] == there[40:60]


def test_an_empty_store_has_no_slices(spark):
    store = LogStore(spark, scratch_path(spark, "t"))
    assert store.slice(0, 5) is None
    r = store.fingerprints(spark.createDataFrame([(None, None)], "lower string, upper string")).first()
    assert (r["n"], r["fp"]) == (0, "0" * 24)


def test_a_null_key_is_refused(spark):
    store = LogStore(spark, scratch_path(spark, "t"))
    rows = log(spark, [1]).unionByName(log(spark, [2]).withColumn("hlc", F.lit(None).cast("string")))
    for _ in range(2):
        with pytest.raises(ValueError, match="1 keys"):
            store.append(rows)
    assert store.size() == 0 and store.versions() == []


def test_of_two_writers_one_loses(spark):
    path = scratch_path(spark, "t")
    for version in range(1, 6):
        lost, start = [], threading.Barrier(4)

        def write():
            store = LogStore(spark, path)
            start.wait()
            try:
                store.commit(Manifest(version, version, "0" * 24, []))
            except ReplayError:
                lost.append(1)

        threads = [threading.Thread(target=write) for _ in range(4)]
        [t.start() for t in threads]
        [t.join() for t in threads]
        assert len(lost) == 3
    assert LogStore(spark, path).versions() == [1, 2, 3, 4, 5]
    assert not [n for n in LogStore(spark, path).vacuum(1, 0) if n.startswith("_")]


def test_vacuum_takes_what_no_retained_version_names(spark):
    store = LogStore(spark, scratch_path(spark, "t"))
    store.append(log(spark, [1, 2]))
    store.append(log(spark, [3]))
    commit, store.commit = store.commit, lambda m: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        store.append(log(spark, [4]))
    store.commit = commit
    assert store.vacuum(retain=9) == []  # the lost segment is young
    gone = store.vacuum(retain=9, hours=0)
    assert len(gone) == 1 and gone[0].startswith("segment-3-")
    assert store.read(1).count() == 2 and store.read(2).count() == 3
    store.compact()
    assert len(store.vacuum(retain=1, hours=0)) == 4  # two manifests, two segments
    assert store.versions() == [3] and store.read().count() == 3 and store.slice(0, 9).count() == 3
    assert store.append(log(spark, [3, 4])) == 1
    store.verify()
