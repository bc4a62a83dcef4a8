"""Appends read only what can have the batch's keys, and ranges of few keys are listed."""

import pytest
from pyspark.sql import functions as F

from tidelog.operators import ranges as R
from tidelog.sources.log import scratch_path
from tidelog.sources.store import LogStore, Manifest

from .test_changelog import log


def key(n):
    return f"{n:012x}" + "0" * 20


def test_segments_beside_the_batch_are_not_read(spark):
    store = LogStore(spark, scratch_path(spark, "t"))
    for keys in ([1, 5], [10, 15], [20, 25]):
        store.append(log(spark, keys))
    m = store.manifest()
    assert m.bounds == [[key(1), key(5)], [key(10), key(15)], [key(20), key(25)]]
    near = lambda keys: store.near(m, log(spark, keys))
    assert near([30, 40]) is None and near([6, 9]) is None and near([]) is None
    assert all(m.segments[1] in f for f in near([12]).inputFiles()) and near([12]).count() == 0
    assert {r["hlc"] for r in near([5, 20]).collect()} == {key(n) for n in (5, 10, 15, 20)}
    assert store.append(log(spark, [5, 6, 15, 26])) == 2 and store.append(log(spark, [1, 5, 6, 10, 15, 20, 25, 26])) == 0
    store.verify()
    store.compact()
    assert store.manifest().bounds == [[key(1), key(26)]] and store.append(log(spark, [26, 27])) == 1
    store.verify()


def test_a_manifest_without_bounds_and_a_key_without_the_timestamp(spark):
    store = LogStore(spark, scratch_path(spark, "t"))
    store.append(log(spark, [1, 2]))
    m = store.manifest()
    store.commit(Manifest(2, m.n_rows, m.fp, m.segments))
    assert store.manifest().bounds == [None] and store.append(log(spark, [2, 3])) == 1 and store.read().count() == 3
    other = LogStore(spark, scratch_path(spark, "t"), keys=("n",))
    other.append(log(spark, [1, 2]))
    assert other.append(log(spark, [2, 9]).withColumn("hlc", F.concat(F.lit("f"), "hlc"))) == 1


@pytest.mark.parametrize("n", [1, 31, 32, 40])
def test_ranges_of_few_keys_are_listed(spark, n):
    rows = R.range_rows(log(spark, range(n))).orderBy("range_idx").collect()
    if n < R.LISTED:
        assert [(r["kind"], r["timestamps"]) for r in rows] == [("timestamps", [key(i) for i in range(n)])]
    else:
        ends = [0, *R.boundaries(n, R.BUCKETS)]
        assert [(r["kind"], r["lower"], r["upper"]) for r in rows] == [("fingerprint", key(a), key(b) if b < n else None) for a, b in zip(ends, ends[1:])]


def test_a_late_row_does_not_bring_in_what_lies_between(spark):
    store = LogStore(spark, scratch_path(spark, "t"))
    for i in range(4):
        store.append(log(spark, range(i * 100_000, i * 100_000 + 50)))
    m = store.manifest()
    near = store._old(m, log(spark, [7, 300_010, 300_020, 300_900]), key(7), key(300_900))
    assert all(m.segments[0] in f or m.segments[3] in f for f in near.inputFiles())
    assert {int(r["hlc"][:12], 16) for r in near.collect()} >= {7, 300_010, 300_020}
    assert store.append(log(spark, [7, 300_010, 300_020, 300_900])) == 1
    store.verify()
