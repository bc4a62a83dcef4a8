"""Bounds, outcomes and errors of a sync."""

import pytest
from pyspark.sql import functions as F

from tidelog.functions import wire as W
from tidelog.functions.platform import Platform
from tidelog.operators import lww as L
from tidelog.operators import ranges as R
from tidelog.operators import sets as S
from tidelog.sources.log import scratch_path
from tidelog.sources.store import LogStore
from tidelog.streaming import session as SE

from .test_session import OWNER, store


def hlc(k):
    return f"{k:012x}" + "0" * 20


def test_a_short_listing_of_a_large_range_is_answered_with_fingerprints(spark, monkeypatch):
    log = spark.range(100_000).select(F.concat(F.lpad(F.lower(F.hex("id")), 12, "0"), F.lit("0" * 20)).alias("hlc"))
    seen = []
    real = type(log).collect
    monkeypatch.setattr(type(log), "collect", lambda self: seen.append(real(self)) or seen[-1])
    out, lacking = SE.respond(log, [W.Range(W.TIMESTAMPS, None, None, [bytes.fromhex(hlc(200_000))])])
    monkeypatch.undo()
    assert max(map(len, seen)) < 32 and {r.kind for r in out} == {W.FINGERPRINT} and len(out) == R.BUCKETS
    assert lacking.count() == 100_000


def test_one_foreign_key_against_many(spark):
    a, b = SE.QueueTransport.pair()
    x, y = SE.Session(store(spark, [5000]), OWNER, a), SE.Session(store(spark, range(600)), OWNER, b)
    SE.run(x, y)
    assert x.state is y.state is SE.State.SYNCED and x.log().count() == y.log().count() == 601


def test_rounds_and_time_that_run_out_are_no_success(spark):
    for kw in ({"max_rounds": 2}, {"seconds": -1.0}):
        a, b = SE.QueueTransport.pair()
        x, y = SE.Session(store(spark, range(300)), OWNER, a), SE.Session(store(spark, range(100, 400)), OWNER, b)
        SE.run(x, y, **kw)
        assert SE.State.UNFINISHED in (x.state, y.state) and SE.State.SYNCED not in (x.state, y.state)


def test_a_request_that_is_refused_is_answered_with_its_error(spark):
    a, b = SE.QueueTransport.pair()
    x = SE.Session(store(spark, range(40)), OWNER, a, write_key=b"w" * 16)
    y = SE.Session(store(spark, [99]), OWNER, b, accepts=lambda m: 0 if m.write_key == b"k" * 16 else 1)
    SE.run(x, y)
    assert x.state is y.state is SE.State.ERROR and x.code == y.code == 1 and "write key" in x.error and y.log().count() == 1


def test_subscriptions(spark):
    a, b = SE.QueueTransport.pair()
    x, y = SE.Session(store(spark, []), OWNER, a), SE.Session(store(spark, []), OWNER, b)
    change = [(bytes.fromhex(hlc(1)), b"v")]
    assert not y.publish(change)
    x.subscribe()
    assert y.poll() and y.subscribed and y.publish(change) and x.poll() and x.log().count() == 1
    x.subscribe(False)
    assert y.poll() and not y.publish(change) and not a.pending()


def test_messages_on_their_way(spark):
    a, b = SE.QueueTransport.pair(hold=True)
    for m in (b"1", b"2", b"3", b"4"):
        a.send(m)
    assert b.pending() == 0 and a.deliver_one() and b.receive() == b"1" and a.drain_sent() == [b"2", b"3", b"4"]
    a.send(b"5")
    assert a.deliver_pending() == 1 and not a.deliver_one() and b.receive() == b"5" and b.receive() is None


def test_of_a_key_twice_in_a_batch_the_first_stays(spark):
    rows = [(hlc(i % 50), i) for i in range(500)]
    s = LogStore(spark, scratch_path(spark, "t"))
    assert s.append(spark.createDataFrame(rows, "hlc string, n long").coalesce(1)) == 50
    assert {(r["hlc"], r["n"]) for r in s.read().collect()} == {(hlc(i), i) for i in range(50)}
    merged = S.merge(s.read(), spark.createDataFrame([(hlc(3), -1), (hlc(70), 1), (hlc(70), 2)], "hlc string, n long").coalesce(1), ["hlc"])
    assert {r["hlc"]: r["n"] for r in merged.collect()} | {hlc(3): 3, hlc(70): 1} == {r["hlc"]: r["n"] for r in merged.collect()}


def test_of_equal_timestamps_the_first_stays(spark):
    rows = [("c", f"v{i}", 7, 100 - i) for i in range(50)]
    df = spark.createDataFrame(rows, "id string, value string, hlc long, arrival long").coalesce(1)
    assert L.cells(df, ["id"]).first()["value"] == "v0" and L.cells(df, ["id"], arrival="arrival").first()["value"] == "v49"
    old = spark.createDataFrame([("c", None, 7)], "id string, value string, hlc long")
    assert L.merge_cells(old, df, ["id"]).first()["value"] is None
    assert L.merge_cells(old.filter("false"), df, ["id"], arrival="arrival").first()["value"] == "v49"


@pytest.mark.parametrize("block", [3, 65536])
def test_windows_over_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK", block)
    rows = spark.createDataFrame([(i, i * i % 7) for i in range(100)], "pos long, v long").repartition(5)
    got = {r["pos"]: (r["b"], r["s"]) for r in R.running_sum(R.with_previous(rows, "v", "b"), "v", "s").collect()}
    v = [i * i % 7 for i in range(100)]
    assert got == {i: (v[i - 1] if i else None, sum(v[: i + 1])) for i in range(100)}


def test_the_clock_is_passed_in(spark):
    p = Platform.fixed(1234, b"s")
    assert p.now() == 1234 and p.random(8) == p.random(8) and len(p.random(24)) == 24
    assert spark.range(2).select(p.now_column().alias("n")).distinct().collect() == [(1234,)]
    assert Platform().now() > 1_700_000_000_000 and Platform().random(16) != Platform().random(16)


def test_no_message_has_more_than_its_ranges(spark, monkeypatch):
    keys = range(600)
    a, b = SE.QueueTransport.pair()
    x, y = SE.Session(store(spark, [k for k in keys if k % 10 or k > 150]), OWNER, a), SE.Session(store(spark, [k for k in keys if k % 7 or k > 150]), OWNER, b)
    SE.run(x, y, max_rounds=80)
    assert x.state is y.state is SE.State.SYNCED
    assert {r["hlc"] for r in x.log().collect()} == {r["hlc"] for r in y.log().collect()} == {hlc(k) for k in keys if k % 10 or k % 7 or k > 150}
    messages = [W.read_message(m) for m in a.sent + b.sent]
    assert max(len(m.ranges) for m in messages) <= SE.RANGES and len(messages) > 8
    assert max(sum(len(r.stamps or []) for r in m.ranges) for m in messages) <= SE.RANGES * (R.LISTED - 1)
    for kinds in ([2] * 16, [2] * 32, [1] * 20 + [2] * 12, [0] * 31 + [2], [2], [1] * 31 + [2], [0, 2] * 16):
        split, later, end, together = SE._plan(kinds)
        kept = [i for i in range(end) if not (together and i and kinds[i] == kinds[i - 1] == 0)]
        assert len(kept) + 15 * len(split) + (end < len(kinds)) <= SE.RANGES and (split or 1 in kinds[:end])
    with pytest.raises(W.WireError):
        SE.respond(x.log(), [W.Range(W.SKIP, bytes.fromhex(hlc(k))) for k in range(40)] + [W.Range(W.SKIP)])
