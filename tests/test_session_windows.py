"""Where one session ends and the next begins."""

from datetime import datetime, timedelta

import pytest

from tidelog.plans.queries import QUERIES
from tidelog.sources.log import scratch_path

GAP = 7_200_000
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def sessions(spark, times: dict[int, list[int]]) -> list[tuple[int, int, int, int]]:
    """The query's sessions over events of users at milliseconds after a moment: user, begin, finish (after that moment too), n."""
    start = datetime(2024, 1, 1)
    d = scratch_path(spark, "events")
    rows = [(u, start + timedelta(milliseconds=t)) for u, ts in times.items() for t in ts]
    spark.createDataFrame([(i, at, u, "click", 1.0, None) for i, (u, at) in enumerate(rows)], SCHEMA).coalesce(1).write.parquet(f"{d}/events.parquet")
    zero = int((start - datetime(1970, 1, 1)).total_seconds() * 1000)
    return sorted((int(r["node"], 16), r["begin"] - zero, r["finish"] - zero, r["n"]) for r in QUERIES["stream_session_windows"](spark, d).collect())


@pytest.mark.parametrize("last", [4, 60])
def test_a_row_just_when_a_session_ends_begins_the_next(spark, last):
    """The rows come in several batches, and all in the first one."""
    times = {1: [0, GAP, 2 * GAP], 2: [0, GAP - 1, 2 * GAP - 2], 3: [0, GAP + 1], 9: [last * GAP]}
    want = [(1, 0, GAP, 1), (1, GAP, 2 * GAP, 1), (1, 2 * GAP, 3 * GAP, 1), (2, 0, 3 * GAP - 2, 3), (3, 0, GAP, 1), (3, GAP + 1, 2 * GAP + 1, 1)]
    assert sessions(spark, times) == want


def test_a_session_comes_when_the_watermark_is_at_its_end(spark):
    hour = 3_600_000
    assert sessions(spark, {1: [0], 2: [1], 9: [GAP + hour]}) == [(1, 0, GAP, 1)]
