"""The tamper check opens batches, and finds each change that is not its own in them."""

from datetime import datetime, timedelta

import pyarrow as pa

from tidelog.plans import queries as Q
from tidelog.sources.log import scratch_path

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_tamper_check_opens_batches(spark, monkeypatch):
    start, d = datetime(2024, 1, 1), scratch_path(spark, "events")
    spark.createDataFrame([(i, start + timedelta(seconds=i), i * 31, "größe" if i % 4 else "click", i / 8 if i % 5 else None, None) for i in range(300)], SCHEMA).write.parquet(f"{d}/events.parquet")

    def fails(*row):
        raise AssertionError("done by row")

    fails.many = Q._back.many
    monkeypatch.setattr(Q, "_back", fails)
    got = sorted(tuple(r) for r in Q.QUERIES["tamper_check"](spark, d).collect())
    assert got == [(i, None if i % 3 else "TimestampMismatch") for i in range(300)]


def test_each_bit_of_a_sealed_change_counts():
    """A change with any one bit turned, among others as they were, does not open."""
    sealed = Q._sent(1, f"{1:012x}" + "0" * 20, 77, "click", 2.5)
    whole = sealed[2]
    turned = [bytes(b ^ (1 << i % 8) * (i // 8 == j) for j, b in enumerate(whole)) for i in range(8 * len(whole)) if i // 8 != 24]  # byte 24 is the length
    data = [whole, *turned, whole]
    n = len(data)
    done, out = Q._back.many(pa.array(range(n)), pa.array([sealed[1]] * n), pa.array(data, pa.binary()), pa.array([77] * n), pa.array(["click"] * n), pa.array([2.5] * n))
    assert done.all() and out[4].to_pylist() == [None, *["DecryptFailed"] * (n - 2), None]
    assert out[1].to_pylist() == [77, *[None] * (n - 2), 77] and out[3].to_pylist() == [2.5, *[None] * (n - 2), 2.5]
