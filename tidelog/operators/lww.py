"""Last writer wins, cell by cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import running_max

#: Columns that every table has beside its own. Fixed names.
SYSTEM_COLUMNS = ["createdAt", "updatedAt", "isDeleted", "ownerId", "id"]


def accepts(current: Column, incoming: Column) -> Column:
    """Whether a change at ``incoming`` replaces a cell last changed at ``current``: an equal timestamp does not."""
    return current.isNull() | (current < incoming)


def cells(log: DataFrame, keys: list[str], value: str = "value", hlc: str = "hlc", arrival: str | None = None) -> DataFrame:
    """The winner of each cell; a null value can win. One partial and one final aggregate, so a much-changed cell is no hot key.

    Of changes with equal timestamps the first stays: by the number ``arrival``. Without it that is the one read first, which depends on how files are split
    among tasks: give ``arrival`` wherever timestamps may repeat.
    """
    at = F.monotonically_increasing_id() if arrival is None else F.col(arrival)
    rows = log.select(*keys, value, hlc, (-at).alias("_late"))
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(hlc, "_late")).alias(value), F.max(hlc).alias(hlc))


def cells_as_of(log: DataFrame, keys: list[str], at: str, value: str = "value", hlc: str = "hlc") -> DataFrame:
    return cells(log.filter(F.col(hlc) <= at), keys, value, hlc)


def merge_cells(current: DataFrame, log: DataFrame, keys: list[str], value: str = "value", hlc: str = "hlc", arrival: str | None = None) -> DataFrame:
    """Winners after more changes: the same aggregate over the old winners and the new changes, in any order and with repeats.

    On equal timestamps an old winner stays, and of new changes the first (by ``arrival``, or in the log's own order).
    """
    cols = [*keys, value, hlc]
    at = F.monotonically_increasing_id() if arrival is None else F.col(arrival)
    old, new = current.select(*cols, F.struct(F.lit(0).alias("new"), F.lit(0).cast("long").alias("at")).alias("_at")), log.select(*cols, F.struct(F.lit(-1).alias("new"), (-at).cast("long").alias("at")).alias("_at"))
    both = old.unionByName(new).groupBy(*keys)
    return both.agg(F.max_by(value, F.struct(hlc, "_at")).alias(value), F.max(hlc).alias(hlc))


def rejected(log: DataFrame, keys: list[str], arrival: str, hlc: str = "hlc", block: int | None = None) -> DataFrame:
    """The changes that come, in order of ``arrival`` (distinct within a cell), after a change of their cell with an equal or larger
    timestamp. A much-changed cell is looked through in blocks of arrivals, see ``running_max``.
    """
    return running_max(log, keys, arrival, hlc, "_cur", before=True, block=block).filter(~accepts(F.col("_cur"), F.col(hlc))).drop("_cur")


def is_system(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).isin(*SYSTEM_COLUMNS)


def change_columns(changes: DataFrame, values: str = "values", is_insert: str = "is_insert", is_delete: str = "is_delete") -> DataFrame:
    """One row per column that a change writes, with its position: createdAt or updatedAt, isDeleted if set, then its own columns.

    ``values`` is a map of strings. Adds ``position``, ``column`` and ``value``; system columns have the change's millis or flag as value
    where the columns ``millis`` exist, as text.
    """
    when = F.struct(F.when(F.col(is_insert), "createdAt").otherwise("updatedAt").alias("column"), F.col("millis").cast("string").alias("value"))
    gone = F.struct(F.lit("isDeleted").alias("column"), F.when(F.col(is_delete), "1").otherwise("0").alias("value"))
    own = F.transform(F.map_entries(values), lambda e: F.struct(e["key"].alias("column"), e["value"].alias("value")))
    every = F.concat(F.array(when), F.filter(F.array(gone), lambda _: F.col(is_delete).isNotNull()), own)
    return changes.select("*", F.posexplode(every).alias("position", "_e")).select("*", F.col("_e.column").alias("column"), F.col("_e.value").alias("value")).drop("_e")


def pivot(cells_: DataFrame, row_keys: list[str], column: str, value: str, known: list[str]) -> DataFrame:
    """Cells as rows of a table with the ``known`` columns, which are named, so no pass is spent on finding them."""
    return cells_.groupBy(*row_keys).pivot(column, known).agg(F.first(value))


def live_rows(cells_: DataFrame, row_keys: list[str], column: str = "column", value: str = "value") -> DataFrame:
    """Row keys whose winning isDeleted is not 1: a later 0 brings a row back."""
    gone = cells_.filter((F.col(column) == "isDeleted") & (F.col(value) == "1")).select(*row_keys)
    return cells_.select(*row_keys).distinct().join(gone, row_keys, "left_anti")


def typed(value: Column) -> Column:
    """A value with its type, as a variant: numbers, texts, flags, bytes, times, nested values; null is a null of its own, which can win a cell like any other."""
    return F.coalesce(value.cast("variant"), F.parse_json(F.lit("null")))


def type_of(value: str | Column) -> Column:
    """The name of a typed value's type, e.g. DOUBLE, STRING, BINARY; VOID for null."""
    return F.schema_of_variant(value)


def typed_pivot(cells_: DataFrame, row_keys: list[str], column: str, value: str, known: dict[str, str]) -> DataFrame:
    """Cells of typed values as rows with the ``known`` columns, each read as its type; null where a cell is missing, null or does not fit the type."""
    each = [F.max(F.when(F.col(column) == name, F.try_variant_get(value, "$", kind))).alias(name) for name, kind in known.items()]  # a cell comes once
    return cells_.groupBy(*row_keys).agg(*each)
