"""The codec queries run over every row of the log and list them all."""

import pytest

from tidelog.plans import queries as Q

D = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name,late", [("change_roundtrip", 2500), ("tamper_check", 9001)])
def test_a_fault_in_a_late_row_is_listed(spark, monkeypatch, name, late):
    from tidelog.functions import wire as W

    def faulty(e, hlc, data, *sent):
        if e == late:
            return e, -1, None, None, "fault", *sent
        try:
            c = W.unseal_change(data, bytes.fromhex(hlc), bytes(range(32)))
        except W.WireError as x:
            return e, None, None, None, str(x), *sent
        kind, v = next(iter(c.values.items()))
        return e, c.values["user"], kind, v, None, *sent

    run = lambda: sorted((tuple(r) for r in Q.QUERIES[name](spark, D).collect()), key=lambda r: r[0])
    whole = run()
    assert [r[0] for r in whole] == list(range(len(whole))) and len(whole) == spark.read.parquet(f"{D}/events.parquet").count()
    monkeypatch.setattr(Q, "_back", faulty)
    got = run()
    assert got[:late] + got[late + 1 :] == whole[:late] + whole[late + 1 :] and (got[late][0], got[late][-1]) == (late, "fault")


def test_odd_values_come_back():
    stamp = bytes(5) + b"\x01" + bytes(10)
    for v in (None, -1.5, -3.0, 0.0, 19.0, 20.0, 2.0**53, 1e300, float("inf")):
        sealed = Q._sent(5000, stamp.hex(), 7, "click", v)
        assert Q._back(*sealed[:3], *sealed[3:])[:5] == (5000, 7, "click", v, None)
