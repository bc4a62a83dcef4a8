import pytest

from tidelog.functions import wire as W
from tidelog.sources import flatfile
from tidelog.sources.log import scratch_path
from tidelog.sources.store import LogStore
from tidelog.streaming.session import QueueTransport, Session, State, respond, run, summarise

OWNER = b"o" * 16


def store(spark, keys):
    s = LogStore(spark, scratch_path(spark, "s"))
    s.append(spark.createDataFrame([(f"{k:012x}" + "0" * 20, bytearray(str(k).encode())) for k in keys], "hlc string, payload binary"))
    return s


@pytest.mark.parametrize("a,b", [(range(5), range(3, 9)), (range(0), range(10)), (range(300), [*range(100), *range(105, 310)]), (range(40), range(40))])
def test_two_replicas_meet(spark, a, b):
    ends = QueueTransport.pair()
    x, y = Session(store(spark, a), OWNER, ends[0]), Session(store(spark, b), OWNER, ends[1])
    run(x, y)
    want = {f"{k:012x}" + "0" * 20: str(k).encode() for k in {*a, *b}}
    for s in (x, y):
        assert {r["hlc"]: bytes(r["payload"]) for r in s.log().collect()} == want
    assert State.ERROR not in (x.state, y.state) and not ends[0].pending() and not ends[1].pending()


def test_equal_ranges_are_skipped_and_unequal_ones_split(spark):
    log = store(spark, range(200)).read()
    ranges = summarise(log)
    assert len(ranges) == 16 and all(r.kind == W.FINGERPRINT for r in ranges)
    same, lacking = respond(log, ranges)
    assert {r.kind for r in same} == {W.SKIP} and lacking.count() == 0
    part = log.filter(f"hlc != '{150:012x}{'0' * 20}'")
    out, _ = respond(part, ranges)
    assert [r.kind for r in out].count(W.TIMESTAMPS) == 1 and [r.kind for r in out].count(W.SKIP) == 15
    one = [W.Range(W.FINGERPRINT, None, b"x" * 12)]
    assert len(respond(log, one)[0]) == 16


def test_errors_and_transport(spark):
    a, b = QueueTransport.pair()
    s = Session(store(spark, [1]), OWNER, a)
    assert s.state is State.IDLE and not s.poll()
    s.start()
    assert s.state is State.WAITING and b.pending() == 1 and len(a.sent) == 1
    a.inject(W.message(W.Message(OWNER, W.RESPONSE, error=1)))
    s.poll()
    assert s.state is State.ERROR and "write key" in s.error
    t = Session(store(spark, [1]), OWNER, b)
    t.start()
    b.disconnect()
    t.disconnected()
    assert t.state is State.ERROR and not a.connected
    with pytest.raises(ConnectionError):
        a.send(b"x")
    c, d = QueueTransport.pair()
    u = Session(store(spark, []), OWNER, c)
    d.send(W.message(W.Message(OWNER, W.BROADCAST, changes=[(bytes(16), b"v")])))
    u.poll()
    assert u.state is State.SYNCED and u.received == 1


def test_flat_files(spark):
    s = store(spark, [3, 1, 2])
    path = scratch_path(spark, "flat")
    assert flatfile.save(s.read(), path) == 3
    assert [(r["hlc"][:12], bytes(r["payload"])) for r in flatfile.load(spark, path).collect()] == [(f"{k:012x}", str(k).encode()) for k in (1, 2, 3)]
    assert [r["hlc"] for r in s.cursor()] == sorted(r["hlc"] for r in s.read().collect())
