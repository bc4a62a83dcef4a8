"""A store as source and sink of streams: restarts, repeated batches and lost commits."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tidelog.sources.log import scratch_path
from tidelog.sources.store import LogStore, ReplayError
from tidelog.streaming import feed as FE
from tidelog.streaming import ingest as I

from .test_changelog import log
from .test_store_bounds import key


def numbers(store, version=None):
    return sorted(r["n"] for r in store.read(version).collect())


def test_a_feed_goes_on_where_it_was(spark):
    source, target, checkpoint = LogStore(spark, scratch_path(spark, "s")), LogStore(spark, scratch_path(spark, "t")), scratch_path(spark, "c")
    schema = log(spark, []).schema
    sizes = []
    for keys in ([1, 2, 3], [4, 5], [6]):
        source.append(log(spark, keys))
        if keys == [6]:
            source.compact()  # adds nothing
        q = I.merge_stream(FE.feed(source, schema), target, checkpoint)
        q.awaitTermination()
        sizes.append(sum(p["numInputRows"] for p in q.recentProgress))
    assert numbers(target) == [1, 2, 3, 4, 5, 6] and sizes == [3, 2, 1]
    assert [p.path for p in FE.FeedReader(source.path, 0, schema).partitions({"version": 3}, {"version": 4})] == []
    source.vacuum(retain=1, hours=0)
    with pytest.raises(ReplayError):
        FE.FeedReader(source.path, 0, schema).partitions({"version": 0}, {"version": 4})


def test_a_batch_that_is_run_again_is_refused(spark):
    source, target, checkpoint = LogStore(spark, scratch_path(spark, "s")), LogStore(spark, scratch_path(spark, "t")), scratch_path(spark, "c")
    source.append(log(spark, range(50)))
    stream = FE.feed(source, log(spark, []).schema)
    FE.into(stream, target, "q", checkpoint).awaitTermination()
    for f in glob.glob(checkpoint.removeprefix("file://") + "/commits/*") + glob.glob(checkpoint.removeprefix("file://") + "/commits/.*"):
        os.remove(f)  # the stream was lost after the sink's commit
    source.append(log(spark, [77]))
    FE.into(stream, target, "q", checkpoint).awaitTermination()
    FE.into(stream, target, "q", checkpoint).awaitTermination()
    assert numbers(target) == [*range(50), 77]
    target.verify()
    m = target.manifest()
    assert m.batches["q"] == max(m.batches.values()) and target.vacuum(retain=9, hours=0) == []
    assert [r["n"] for r in target.slice(49, 52).orderBy("pos").collect()] == [49, 77]  # its directory is made when it is asked for
    target.compact()
    assert target.manifest().batches == m.batches


def test_tasks_without_a_commit_leave_no_trace(spark):
    target = LogStore(spark, scratch_path(spark, "t"))
    w = FE.SinkWriter(target.path, "q", "hlc")
    rows = log(spark, [3, 1, 2]).toArrow().to_batches()
    lost = [w.write(iter(rows)), w.write(iter([]))]
    assert target.read() is None and lost[1].segment is None
    again = [w.write(iter(rows)), None]
    w.commit(again, 0)
    w.commit([w.write(iter(rows))], 0)  # the same batch once more
    assert numbers(target) == [1, 2, 3] and target.manifest().version == 1 and target.manifest().bounds == [[key(1), key(3)]]
    w.abort([w.write(iter(log(spark, [9]).toArrow().to_batches()))], 1)
    assert target.vacuum(hours=0) == [lost[0].segment]
    target.verify()
    with pytest.raises(ValueError, match="null"):
        w.write(iter(log(spark, [9]).withColumn("hlc", F.lit(None).cast("string")).toArrow().to_batches()))


def test_two_streams_into_one_store(spark, monkeypatch):
    target = LogStore(spark, scratch_path(spark, "t"))
    a, b = (FE.SinkWriter(target.path, q, "hlc") for q in "ab")
    put, tried = FE.Files.put, []

    def late(self, m):
        if not tried:
            tried.append(1)
            b.commit([b.write(iter(log(spark, [2]).toArrow().to_batches()))], 5)  # another is faster
        return put(self, m)

    monkeypatch.setattr(FE.Files, "put", late)
    a.commit([a.write(iter(log(spark, [1]).toArrow().to_batches()))], 0)
    assert numbers(target) == [1, 2] and target.manifest().batches == {"a": 0, "b": 5}
    target.verify()
