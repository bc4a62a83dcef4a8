"""Event-time windows over a stream of changes: counts and fingerprints by window of the clock's milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fingerprint as FP


def timed(stream: DataFrame, delay: str, millis: str = "millis") -> DataFrame:
    """Adds the event time ``at`` with a watermark ``delay`` behind the latest."""
    return stream.withColumn("at", F.timestamp_millis(millis)).withWatermark("at", delay)


def session(gap: int) -> Column:
    """Sessions of the column ``at``, each up to ``gap`` milliseconds after its last row; a row at just that time begins the next.

    ``F.session_window`` takes such a row into the session before, so it gets a gap that is a microsecond shorter, which tells no other times in milliseconds apart.
    """
    return F.session_window("at", f"{gap * 1000 - 1} microseconds")


def windowed(stream: DataFrame, window: Column, delay: str, by: list[str] | None = None, millis: str = "millis", hlc: str = "hlc") -> DataFrame:
    """Per window (and ``by``): begin and finish in milliseconds, n and fp.

    ``window`` is of the column ``at``: ``F.window("at", width)`` for tumbling windows, with a slide for sliding ones, or ``session(gap)``.
    In append mode a window comes once, when the watermark has passed its end. A row whose window was closed by then is late: it is left out here
    and counted by ``late``; the log itself keeps it. State is bounded by the windows that are open.
    """
    rows = timed(FP.with_lanes(stream, hlc), delay, millis)
    out = rows.groupBy(window.alias("w"), *(by or [])).agg(F.count(F.lit(1)).alias("n"), *FP.xor())
    finish = F.unix_millis(F.col("w.end") + F.expr("INTERVAL 999 MICROSECONDS"))  # the end of a session is a microsecond early
    return out.select(*(by or []), F.unix_millis("w.start").alias("begin"), finish.alias("finish"), "n", FP.text().alias("fp"))


def run(windows: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Writes the windows that close on what the stream has now, and returns all that are closed so far. Called again, it goes on from the checkpoint."""
    q = windows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return windows.sparkSession.read.schema(windows.schema).parquet(path)


def still_open(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The windows (tumbling or sliding) that wait in the state of a query: begin, finish, n."""
    state = spark.read.format("statestore").load(checkpoint)
    w = f"key.`{state.schema['key'].dataType.names[0]}`"
    n = f"value.`{state.schema['value'].dataType.names[0]}`"
    return state.select(F.unix_millis(F.col(f"{w}.start")).alias("begin"), F.unix_millis(F.col(f"{w}.end")).alias("finish"), F.col(n).alias("n"))


def late(seen: int, closed: DataFrame, open_: DataFrame) -> int:
    """How many (row, window) pairs came after their window was closed. ``seen``: pairs in all, that is rows times windows a row."""
    total = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return seen - total(closed) - total(open_)
