"""Clocks over micro-batches and restarts, in lots; event-time windows and what comes late."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.plans.queries import QUERIES
from tidelog.sources.log import scratch_path
from tidelog.streaming import ingest as I
from tidelog.streaming import windows as WI

from .test_changelog import SF

EVENTS = "node string, seq long, now long, remote_millis long, remote_counter long"


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", I.ROCKSDB)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # several batches of rows a node
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_clocks_are_kept_over_restarts_and_taken_in_lots(spark, rocksdb):
    rnd = random.Random(7)
    rows = [("n%d" % min(rnd.randrange(6), 1), i, 1000 + i + rnd.choice([0, 0, -30, 9]), *rnd.choice([(None, None), (1000 + i + rnd.choice([3, 400_000]), rnd.choice([5, 65535]))])) for i in range(600)]
    path, out, checkpoint = (scratch_path(spark, w) for w in ("in", "out", "check"))
    spark.createDataFrame([], EVENTS).write.parquet(path)
    stream = spark.readStream.schema(EVENTS).parquet(path)
    for i in range(3):  # started anew for each batch
        part = rows[i * 200 : (i + 1) * 200]
        rnd.shuffle(part)
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(path)
        I.clock_stream(stream, lot=16).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r) for r in spark.read.schema(I.CLOCK).parquet(out).collect())
    want, clocks = [], {}
    for node, seq, now, rm, rc in sorted(rows, key=lambda r: r[1]):
        ms, c, error = I.step(*clocks.get(node, (0, 0)), now, None if rm is None else (rm, rc))
        clocks[node] = ms, c
        want.append((node, seq, None if error else ms, None if error else c, error))
    assert got == sorted(want) and {r[4] for r in got} == {None, "drift", "counter"}


def test_no_more_than_a_lot_is_held(spark):
    import numpy as np
    import pandas as pd

    class Memory(dict):
        def getValue(self, k):
            return (self[k][0],)

        def updateValue(self, k, v):
            self[k] = v

        def removeKey(self, k):
            del self[k]

    p = I.ClockProcessor(lot=100)
    p.waiting = Memory()
    seq = np.random.default_rng(1).permutation(5000)
    frames = (pd.DataFrame({"seq": s, "now": s, "remote_millis": None, "remote_counter": None}) for s in np.split(seq, 50))
    lots = list(p._lots(frames))
    assert max(map(len, lots)) == 100 and not p.waiting
    assert [sorted(x[:, 0]) for x in lots] == [list(range(i, i + 100)) for i in range(0, 5000, 100)]


@pytest.mark.parametrize("query", ["stream_tumbling_windows", "stream_sliding_windows"])
def test_rows_whose_window_was_closed_are_counted(spark, query):
    rows = QUERIES[query](spark, SF).collect()
    assert rows[0]["late"] > 0 and len({r["late"] for r in rows}) == 1
    assert len({(r["begin"], r["finish"]) for r in rows}) == len(rows)  # a window comes once


def test_windows_go_on_after_a_restart(spark):
    path, out, checkpoint = (scratch_path(spark, w) for w in ("in", "out", "check"))
    schema = "millis long, hlc string"
    spark.createDataFrame([], schema).write.parquet(path)
    stream = spark.readStream.schema(schema).parquet(path)
    w = WI.windowed(stream, F.window("at", "10 seconds"), "0 seconds")
    for batch in ([1000, 2000, 11_000], [12_000, 3000, 25_000], [4000, 41_000]):
        spark.createDataFrame([(m, f"{m:012x}" + "0" * 20) for m in batch], schema).coalesce(1).write.mode("append").parquet(path)
        closed = WI.run(w, out, checkpoint)
    assert sorted((r["begin"], r["n"]) for r in closed.collect()) == [(0, 2), (10_000, 2), (20_000, 1)]
    waiting = WI.still_open(spark, checkpoint)
    assert [tuple(r) for r in waiting.collect()] == [(40_000, 50_000, 1)] and WI.late(8, closed, waiting) == 2
