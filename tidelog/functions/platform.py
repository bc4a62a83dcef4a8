"""The wall clock and random bytes, as values that are passed in."""

from __future__ import annotations

import hashlib
import os
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Platform:
    """``now`` gives milliseconds since 1970, ``random`` so many bytes."""

    now: Callable[[], int] = lambda: time.time_ns() // 1_000_000
    random: Callable[[int], bytes] = os.urandom

    @classmethod
    def fixed(cls, millis: int, seed: bytes = b"") -> Platform:
        """A clock that stands still and bytes that are the same each time; for tests, and for jobs that must come out alike when run again."""
        return cls(lambda: millis, lambda n: hashlib.shake_256(seed).digest(n))

    def now_column(self) -> Column:
        """The clock read once, so that all tasks of a job agree on it."""
        return F.lit(self.now()).cast("long")
