"""A reply of more changes than a message holds."""

import pytest

from tidelog.streaming import session as SE

from .test_session import OWNER, store


@pytest.mark.parametrize("a,b,per", [([], range(25), 4), (range(25), [], 4), ([], range(8), 4), ([], range(40), 1), (range(30), [*range(10), *range(25, 60)], 3)])
def test_all_changes_arrive(spark, monkeypatch, a, b, per):
    monkeypatch.setattr(SE, "PER_MESSAGE", per)
    ends = SE.QueueTransport.pair()
    x, y = SE.Session(store(spark, a), OWNER, ends[0]), SE.Session(store(spark, b), OWNER, ends[1])
    SE.run(x, y)
    want = {f"{k:012x}" + "0" * 20: str(k).encode() for k in {*a, *b}}
    for s in (x, y):
        assert {r["hlc"]: bytes(r["payload"]) for r in s.log().collect()} == want
    assert x.state is y.state is SE.State.SYNCED and not ends[0].pending() and not ends[1].pending()
    assert all(len(SE.W.read_message(m).changes) <= per for e in ends for m in e.sent)


def test_a_sync_cut_off_between_parts_is_no_success(spark, monkeypatch):
    monkeypatch.setattr(SE, "PER_MESSAGE", 4)
    ends = SE.QueueTransport.pair()
    x, y = SE.Session(store(spark, []), OWNER, ends[0]), SE.Session(store(spark, range(9)), OWNER, ends[1])
    x.start()
    assert y.poll() and x.poll() and x.received == 4 and x.state is SE.State.WAITING
    x.disconnected()
    assert x.state is SE.State.ERROR
