"""Bounded rounds of reconciliation, and keys placed among many bounds."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import descent as DE
from tidelog.operators import ranges as R
from tidelog.sources import directory as D
from tidelog.sources.log import scratch_path
from tidelog.sources.store import LogStore

from .test_changelog import log
from .test_store_bounds import key


def stores(spark, *sides):
    out = []
    for keys in sides:
        out.append(LogStore(spark, scratch_path(spark, "t")))
        out[-1].append(log(spark, keys))
    return out


def lacking(found):
    rows = [(r["lacking"], int(r["hlc"][:12], 16)) for r in found.collect()]
    assert len(rows) == len(set(rows))
    return {k for s, k in rows if s == "a"}, {k for s, k in rows if s == "b"}


def test_spread_differences_in_bounded_rounds(spark, monkeypatch):
    monkeypatch.setattr(D, "LEAF", 64)
    keys = [k * 37 for k in range(700)]
    x, y = {k for i, k in enumerate(keys) if i % 10}, {k for i, k in enumerate(keys) if i % 7}
    a, b = stores(spark, x, y)
    d = DE.descend(a, b, ranges=24, keys=24 * 31, listed=32)
    assert lacking(d.found) == (y - x, x - y) and d.done
    assert all(r.opened <= 24 and r.compared <= 24 * 16 and r.listed <= 24 and r.keys <= 24 * 31 for r in d.rounds) and len(d.rounds) > 2
    part = DE.descend(a, b, ranges=24, keys=24 * 31, listed=32, max_rounds=2)
    assert not part.done and len(part.cursor["open"]) + len(part.cursor["few"]) <= 24 * 16 * 2
    rest = DE.descend(a, b, ranges=24, keys=24 * 31, listed=32, cursor=part.cursor)
    assert lacking(part.found.unionByName(rest.found)) == (y - x, x - y)
    assert [*part.rounds, *rest.rounds] == d.rounds


@pytest.mark.parametrize("x,y", [(range(0), range(0)), (range(300), range(0)), (range(50), range(50)), (range(2000), [*range(1000), *range(1001, 2000)])])
def test_sides_that_are_alike_or_empty(spark, x, y):
    d = DE.descend(*stores(spark, x, y))
    assert lacking(d.found) == (set(y) - set(x), set(x) - set(y)) and d.done
    with pytest.raises(ValueError):
        DE.descend(*stores(spark, [], []), keys=5)


@pytest.mark.parametrize("n_bounds", [0, 1, 7, 3000])
def test_keys_among_many_bounds(spark, n_bounds):
    rnd = random.Random(n_bounds)
    keys, bounds = [rnd.randrange(10_000) for _ in range(2000)], sorted({rnd.randrange(10_000) for _ in range(n_bounds)})
    rows = spark.createDataFrame([(key(k), i) for i, k in enumerate(keys)] + [(None, -1)], "hlc string, i long")
    marks = spark.createDataFrame([(key(b),) for b in bounds * 2] + [(None,)], "b string")
    got = {r["i"]: r["bound"] for r in R.place(rows.repartition(6), marks).collect()}
    at = lambda k: bisect.bisect_right(bounds, k)
    assert got == {-1: None} | {i: key(bounds[at(k) - 1]) if at(k) else None for i, k in enumerate(keys)}


def test_placing_shuffles_once_and_pairs_nothing(spark, monkeypatch):
    plans = []
    real = R.materialised
    monkeypatch.setattr(R, "materialised", lambda df, what: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, what))
    rows = spark.range(1000).select(F.format_string("%032x", "id").alias("hlc"))
    out = R.place(rows, rows.filter("hlc < '3'").toDF("b"))
    assert plans[0].count("rangepartitioning") == 1 and not any("Cartesian" in p or "NestedLoop" in p for p in [*plans, out._jdf.queryExecution().executedPlan().toString()])
