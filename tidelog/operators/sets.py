"""Set operations on logs, by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_of_batch(batch: DataFrame, keys: list[str], arrival: str | None = None) -> DataFrame:
    """One row per key: the first by ``arrival``, or, without, in the batch's own order (that in which its files and rows are read).

    A partial and a final aggregate, so a key that is repeated very often is thinned out before the shuffle.
    """
    at = F.monotonically_increasing_id() if arrival is None else F.col(arrival)
    rows = batch.select(*keys, F.struct(*[c for c in batch.columns if c not in keys], F.lit(None).cast("int").alias("_")).alias("_row"), at.alias("_at"))
    first = rows.groupBy(*keys).agg(F.min_by("_row", "_at").alias("_row"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in batch.columns])


def missing(ours: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    """What we have and they lack."""
    return ours.join(theirs.select(*keys), keys, "left_anti")


def common(ours: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    return ours.join(theirs.select(*keys), keys, "left_semi")


def lacks_any(ours: DataFrame, theirs: DataFrame, keys: list[str]) -> bool:
    """Whether they have anything that we lack; stops at the first such row."""
    return missing(theirs, ours, keys).limit(1).count() > 0


def merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All of ``old`` and what ``new`` adds: on equal keys the old row stays, whatever the payload."""
    return old.unionByName(missing(first_of_batch(new, keys), old, keys).select(*old.columns))


def with_payload(index: DataFrame, payloads: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with their payloads; null where the key is known but its data is not here."""
    return index.join(payloads, keys, "left")
