"""Hybrid logical clock timestamps as Column expressions.

A timestamp is (millis, counter, node); its text form is 32 lowercase hex digits, 12 of millis, 4 of counter and 16 of node, whose
order as a string is the order of time, and of the 16 bytes.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest millis; 2**48 - 1 stands for infinity and is not a time.
MAX_MILLIS = (1 << 48) - 2
MAX_COUNTER = 65535
#: How far in milliseconds a clock may run ahead of the wall clock.
MAX_DRIFT = 5 * 60 * 1000


def millis(ts: str) -> Column:
    """Milliseconds since 1970 of a timestamp column without time zone, cut off, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{ts}`) div 1000")


def instant(hlc: str, more: int = 0) -> Column:
    """The time of a text timestamp's millis plus ``more``, as a timestamp without time zone that a scan can compare with."""
    ms = min(int(hlc[:12], 16) + more, 253_402_300_799_999)  # the end of the year 9999
    return F.expr(f"timestamp_ntz'{(datetime(1970, 1, 1) + timedelta(milliseconds=ms)).isoformat(sep=' ', timespec='milliseconds')}'")


def node(number: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(number), 16, "0"))


def valid_node(text: str | Column) -> Column:
    return F.coalesce((F.col(text) if isinstance(text, str) else text).rlike("^[0-9a-f]{16}$"), F.lit(False))


def encode(ms: Column, counter: Column, node_hex: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(ms.cast("long")), 12, "0"), F.lpad(F.hex(counter.cast("long")), 4, "0"), node_hex))


def to_bytes(hlc: str | Column) -> Column:
    return F.unhex(hlc)


def decode(hlc: str) -> list[Column]:
    """millis, counter and node of a text timestamp; millis is null for the reserved value."""
    ms = F.conv(F.substring(hlc, 1, 12), 16, 10).cast("long")
    return [F.when(ms <= MAX_MILLIS, ms).alias("millis"), F.conv(F.substring(hlc, 13, 4), 16, 10).cast("long").alias("counter"), F.substring(hlc, 17, 16).alias("node")]


def in_domain(ms: Column, counter: Column) -> Column:
    return F.coalesce(ms.between(0, MAX_MILLIS) & counter.between(0, MAX_COUNTER), F.lit(False))


def drifted(ms: Column, now: Column, limit: int = MAX_DRIFT) -> Column:
    """Whether a time is so far ahead of the wall clock that it is refused. Late times never are."""
    return (ms - now) > limit


def _tick(top: Column, counter: Column, now: Column) -> Column:
    error = F.when(drifted(top, now), "drift").when(counter > MAX_COUNTER, "counter")
    return F.struct(F.when(error.isNull(), top).alias("millis"), F.when(error.isNull(), counter).cast("long").alias("counter"), error.alias("error"))


def send(ms: Column, counter: Column, now: Column) -> Column:
    """The clock after a local change: struct of millis and counter, or of an error."""
    top = F.greatest(ms, now)
    return _tick(top, F.when(top == ms, counter + 1).otherwise(0), now)


def receive(ms: Column, counter: Column, other_ms: Column, other_counter: Column, now: Column) -> Column:
    """The clock after a remote change was seen; the node stays the local one."""
    top = F.greatest(ms, other_ms, now)
    at_both, at_own, at_other = (top == ms) & (top == other_ms), top == ms, top == other_ms
    return _tick(top, F.when(at_both, F.greatest(counter, other_counter) + 1).when(at_own, counter + 1).when(at_other, other_counter + 1).otherwise(0), now)


def clock_text(ms: Column) -> Column:
    """HH:MM:SS.mmm in UTC, by arithmetic, so the session's zone has no say."""
    part = lambda per, mod, width: F.lpad(((ms - F.pmod(ms, F.lit(per))) / per % mod).cast("long").cast("string"), width, "0")
    return F.concat(part(3_600_000, 24, 2), F.lit(":"), part(60_000, 60, 2), F.lit(":"), part(1000, 60, 2), F.lit("."), part(1, 1000, 3))
