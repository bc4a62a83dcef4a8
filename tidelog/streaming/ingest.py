"""Change logs as streams: drift checks, idempotent merging, and clocks per node."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import TimerValues

from ..functions import hlc as H
from ..operators.ranges import numbered, running_max, split_hot
from ..sources.store import LogStore


def accepted(log: DataFrame, now: str, millis: str = "millis", counter: str = "counter") -> DataFrame:
    """Rows that are in the domain and not too far ahead of the wall clock. There is no watermark: a late change is never dropped."""
    return log.filter(H.in_domain(F.col(millis), F.col(counter)) & ~H.drifted(F.col(millis), F.col(now)))


def quarantined(log: DataFrame, now: str, millis: str = "millis", counter: str = "counter") -> DataFrame:
    """The other rows, with a ``reason``."""
    ok = H.in_domain(F.col(millis), F.col(counter))
    return log.withColumn("reason", F.when(~ok, "domain").when(H.drifted(F.col(millis), F.col(now)), "drift")).filter(F.col("reason").isNotNull())


def merge_stream(stream: DataFrame, store: LogStore, checkpoint: str, now: str | None = None) -> StreamingQuery:
    """Appends every micro-batch to ``store``. Appending is idempotent by key, so a batch that is run again after a failure changes nothing,
    and duplicates are found in the store however late they come, with no state to grow.
    """

    def each(batch: DataFrame, _: int) -> None:
        store.append(accepted(batch, now) if now else batch)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fold(events: DataFrame, order: str = "seq", node: str = "node", block: int | None = None) -> DataFrame:
    """The clock of each node after each of its events, from (0, 0): adds millis, counter and error.

    ``now`` is the wall clock, which may go back; ``remote_millis`` and ``remote_counter`` are null for a local change. ``order`` has whole numbers,
    distinct within a node. An event that errs leaves the clock as it was: its remote or the clock is too far ahead (drift), or the counter would
    pass its largest value (counter). A remote with the largest counter errs unless the clock or ``now`` is past it, so what it adds to the clock is
    known beforehand. Within a run of equal millis a counter is the largest, over the run's events so far, of that event's own start plus the number
    of events since; so running maxima give what is defined step by step. Nodes of up to ``block`` events are plain windows; those of busier ones are looked
    through in blocks, and so are the runs of a clock that stands still, see ``running_max``.
    """
    rest, hot = split_hot(events, [node], block or 1 << 20)
    out = _fold(rest, order, node, None)
    return out if hot is None else out.unionByName(_fold(hot, order, node, block or 1 << 20))


def _fold(events: DataFrame, order: str, node: str, block: int | None) -> DataFrame:
    """``block``: None where every node's events fit one window."""

    def top(rows: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
        if block:
            return running_max(rows, by, order, column, name, block=block)
        return rows.withColumn(name, F.max(column).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))

    remote, now = F.col("remote_millis"), F.col("now")
    far = F.coalesce(H.drifted(remote, now), F.lit(False))
    full = F.coalesce(F.col("remote_counter") >= H.MAX_COUNTER, F.lit(False))
    e = events.withColumn("_r", F.when(~far & ~full, remote))
    e = e.withColumn("_c", F.when(~far & (~full | (now > remote)), F.greatest(now, F.coalesce("_r", F.lit(0)))))
    e = top(e, [node], "_c", "_m").drop("_c").withColumn("_m", F.coalesce("_m", F.lit(0)))
    e = e.withColumn("error", F.when(far | H.drifted(F.col("_m"), now), "drift").when(full & (remote >= F.col("_m")), "counter"))
    good = e.filter("error IS NULL")
    if block:
        good = numbered(good, [node, "_m"], order, "_i", block)
    else:
        good = good.withColumn("_i", F.row_number().over(Window.partitionBy(node, "_m").orderBy(order)))
    remote = F.when(F.col("_r") == F.col("_m"), F.col("remote_counter") + 1)
    start = F.when(F.col("_i") == 1, F.greatest(F.when(F.col("_m") == 0, 1).otherwise(0), F.coalesce(remote, F.lit(0)))).otherwise(remote)
    good = top(good.withColumn("_v", start - F.col("_i")), [node, "_m"], "_v", "_w").withColumn("counter", (F.col("_w") + F.col("_i")).cast("long"))
    good = good.withColumn("error", F.when(F.col("counter") > H.MAX_COUNTER, "counter"))
    good = good.withColumn("millis", F.when(F.col("error").isNull(), F.col("_m"))).withColumn("counter", F.when(F.col("error").isNull(), F.col("counter")))
    bad = e.filter("error IS NOT NULL").withColumn("counter", F.lit(None).cast("long")).withColumn("millis", F.lit(None).cast("long"))
    return good.drop("_i", "_v", "_w", "_r", "_m").unionByName(bad.drop("_r", "_m"))


CLOCK = "node string, seq long, millis long, counter long, error string"


def step(ms: int, counter: int, now: int, remote: tuple[int, int] | None) -> tuple[int, int, str | None]:
    """One event of a node's clock: the new clock, or the old one and an error."""
    top = max(ms, now, remote[0] if remote else 0)
    if top - now > H.MAX_DRIFT:
        return ms, counter, "drift"
    starts = [counter + 1] * (top == ms) + ([remote[1] + 1] if remote and remote[0] == top else [])
    new = max(starts, default=0)
    return (ms, counter, "counter") if new > H.MAX_COUNTER else (top, new, None)


#: Consecutive numbers of events that are held and sorted together.
LOT = 4096
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ClockProcessor(StatefulProcessor):
    """A node's clock as value state. Events of one micro-batch are taken in lots of ``lot`` consecutive numbers, lowest first: when they come in more than one
    batch of rows they wait in map state, a lot a key, so no more than a lot and a batch of rows are in memory however many a node has.
    """

    def __init__(self, lot: int = LOT, ttl_ms: int | None = None) -> None:
        self.lot, self.ttl_ms = lot, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clock = handle.getValueState("clock", "millis long, counter long", self.ttl_ms)
        self.waiting = handle.getMapState("waiting", "lot long", "events binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        ms, counter = self.clock.get() if self.clock.exists() else (0, 0)
        first = next(rows)
        more = next(rows, None)
        for events in [self._events(first)] if more is None and len(first) <= self.lot else self._lots(chain([first], [] if more is None else [more], rows)):
            out = []
            for seq, now, rm, rc in events[np.argsort(events[:, 0])].tolist():
                ms, counter, error = step(ms, counter, now, None if rm < 0 else (rm, rc))
                out.append((key[0], seq, None if error else ms, None if error else counter, error))
            yield pd.DataFrame(out, columns=["node", "seq", "millis", "counter", "error"]).astype({"millis": "Int64", "counter": "Int64"})
        self.clock.update((ms, counter))

    def close(self) -> None:
        pass

    @staticmethod
    def _events(rows: pd.DataFrame) -> np.ndarray:
        """(seq, now, remote millis or -1, remote counter)"""
        return np.stack([pd.to_numeric(rows[c]).fillna(-1).astype("int64").to_numpy() for c in ("seq", "now", "remote_millis", "remote_counter")], axis=1)

    def _lots(self, batches: Iterable[pd.DataFrame]) -> Iterator[np.ndarray]:
        lots = set()
        for rows in batches:
            events = self._events(rows)
            of = events[:, 0] // self.lot
            for lot in np.unique(of).tolist():
                held = self.waiting.getValue((lot,))[0] if lot in lots else b""
                self.waiting.updateValue((lot,), (bytes(held) + events[of == lot].tobytes(),))
                lots.add(lot)
        for lot in sorted(lots):
            yield np.frombuffer(bytes(self.waiting.getValue((lot,))[0]), np.int64).reshape(-1, 4)
            self.waiting.removeKey((lot,))


def clock_stream(events: DataFrame, lot: int = LOT, ttl_ms: int | None = None) -> DataFrame:
    """``fold`` over a stream of (node, seq, now, remote_millis, remote_counter): the clocks are kept as keyed state between micro-batches.

    Within a micro-batch a node's events are taken by ``seq`` (distinct whole numbers), in lots, see ``ClockProcessor``; micro-batches must come in its order.
    With ``ttl_ms`` a node's clock is forgotten when it was idle for so long (processing time), and then begins anew. The session needs the state store
    ``ROCKSDB`` (spark.sql.streaming.stateStore.providerClass) when the query is started.
    """
    return events.groupBy("node").transformWithStateInPandas(ClockProcessor(lot, ttl_ms), CLOCK, "Append", "ProcessingTime" if ttl_ms else "None")
