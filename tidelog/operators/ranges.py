"""Positions, balanced buckets and range summaries of a log ordered by key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import fingerprint as FP
from ..sources.log import dropped, materialised, small

#: Buckets of a reconciliation round, the fewest keys a bucket may have, and the keys below which a range is listed. Fixed values.
BUCKETS, LEAST, LISTED = 16, 2, 32
#: Consecutive positions that one window spans at most.
BLOCK = 65536


def with_position(log: DataFrame, key: str = "hlc", groups: list[str] | None = None) -> DataFrame:
    """Adds ``pos``, the place of each row from 0 in the order of ``key`` within its group. Keys are distinct within a group.

    The one shuffle deals rows to partitions by range, where they are sorted and written with the number of their place in the
    partition. To that the number of rows in the partitions before is added, from a table of a row a partition and group (broadcast where
    small). No window spans more than those rows, unlike a row_number over everything, which would bring all rows to one task.
    """
    by = groups or []
    dealt = log.repartitionByRange(*by, key).sortWithinPartitions(*by, key).withColumn("_at", F.monotonically_increasing_id())
    dealt = materialised(dealt, "ranked")
    pid = F.shiftright("_at", 33)
    counts = dealt.groupBy(pid.alias("_pid"), *by).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", *by, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    offsets = small(materialised(offsets, "offsets"))
    offsets = offsets.toDF("_p", *[f"_g{i}" for i in range(len(by))], "_shift")
    on = [pid == F.col("_p"), *[F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)]]
    return dealt.join(offsets, on).withColumn("pos", F.col("_at") + F.col("_shift")).select(*log.columns, "pos")


def bucket_of(pos: Column, n: Column | int, k: int) -> Column:
    """The bucket from 0 of a position when n rows go to k buckets as evenly as can be, the first n mod k having one more."""
    n = n if isinstance(n, Column) else F.lit(n)
    r = n % k
    q = ((n - r) / k).cast("long")
    wide = r * (q + 1)
    return F.when(pos < wide, F.floor(pos / (q + 1))).otherwise(r + F.floor((pos - wide) / F.greatest(q, F.lit(1)))).cast("long")


def boundaries(n: int, k: int, least: int = LEAST) -> list[int]:
    """The ends of k balanced buckets of n rows; an error that says how many rows it takes when there are too few."""
    if n < k * least:
        raise ValueError(f"{k} buckets of {least} take {k * least} rows, there are {n}")
    return [(i + 1) * (n // k) + min(i + 1, n % k) for i in range(k)]


def slice_of(log: DataFrame, begin: int, end: int, key: str = "hlc") -> DataFrame:
    """Rows at positions begin to end - 1."""
    return with_position(log, key).filter((F.col("pos") >= begin) & (F.col("pos") < end))


def summary(rows: DataFrame, bucket: str = "bucket", key: str = "hlc") -> DataFrame:
    """Per bucket its number of keys, fingerprint, and bounds: lower is its first key, upper the next bucket's (null: no bound)."""
    s = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lower"), *FP.xor())
    return s.select(bucket, "n", "lower", F.lead("lower").over(Window.partitionBy(F.lit(0)).orderBy(bucket)).alias("upper"), FP.text().alias("fp"))


def balanced_summary(log: DataFrame, k: int = BUCKETS, key: str = "hlc") -> DataFrame:
    """``summary`` of k balanced buckets; the final window is over k rows."""
    placed = with_position(FP.with_lanes(log, key), key)
    return summary(placed.withColumn("bucket", bucket_of(F.col("pos"), log.count(), k)), "bucket", key)


def range_rows(log: DataFrame, key: str = "hlc") -> DataFrame:
    """What a replica says of its log: one listing when it has fewer than ``LISTED`` keys (an empty one has an empty listing), else fingerprints."""
    n = log.count()
    if n >= LISTED:
        return balanced_summary(log, BUCKETS, key).select(F.col("bucket").alias("range_idx"), "lower", "upper", F.lit("fingerprint").alias("kind"), "fp", F.lit(None).cast("array<string>").alias("timestamps"))
    listed = log.agg(F.sort_array(F.collect_list(key)).alias("timestamps"))  # fewer than LISTED keys
    return listed.select(F.lit(0).cast("long").alias("range_idx"), F.lit(None).cast("string").alias("lower"), F.lit(None).cast("string").alias("upper"), F.lit("timestamps").alias("kind"), F.lit(None).cast("string").alias("fp"), "timestamps")


def place(rows: DataFrame, bounds: DataFrame, key: str = "hlc", name: str = "bound") -> DataFrame:
    """Adds the largest of any number of bounds that is not above the row's key, null where there is none. ``bounds`` has the one column; nulls and repeats are passed
    over. A row with a null key has no bound.

    Keys and bounds are put together, dealt by ranges and sorted, in one shuffle; within a partition each row takes the last bound before it, and the
    rows before a partition's first bound take the last one of the partitions before, from a table of a row a partition.
    """
    marks = bounds.toDF(key).filter(F.col(key).isNotNull()).distinct().withColumn("_mark", F.lit(True))
    both = rows.withColumn("_mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    dealt = both.repartitionByRange(key).sortWithinPartitions(F.asc_nulls_first(key), F.desc("_mark"))
    schema = StructType([*both.schema.fields, StructField(name, both.schema[key].dataType), StructField("_pid", IntegerType())])
    at = both.columns.index(key), both.columns.index("_mark")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pid = None, TaskContext.get().partitionId()
        for b in batches:
            if not b.num_rows:
                continue
            mark = b.column(at[1]).to_numpy(zero_copy_only=False).astype(bool)
            upto = np.maximum.accumulate(np.where(mark, np.arange(b.num_rows), -1))
            bound = b.column(at[0]).take(pa.array(upto, mask=upto < 0))
            bound = bound if last is None else pc.fill_null(bound, pa.scalar(last, bound.type))
            last = bound[-1].as_py()
            yield pa.RecordBatch.from_arrays([*b.columns, bound, pa.array(np.full(b.num_rows, pid, np.int32))], names=[*b.schema.names, name, "_pid"])

    filled = materialised(dealt.mapInArrow(fill, schema), "placed")
    ends = filled.groupBy("_pid").agg(F.max(name).alias("_top"))
    before = Window.partitionBy(F.lit(0)).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    carried = small(materialised(ends.select("_pid", F.max("_top").over(before).alias("_carried")), "carried"))
    out = filled.filter(~F.col("_mark")).join(carried, "_pid")
    return out.withColumn(name, F.when(F.col(key).isNotNull(), F.coalesce(name, "_carried"))).select(*rows.columns, name)


def run_lengths(rows: DataFrame, value: str, order: str = "pos") -> DataFrame:
    """Runs of equal values in the order of ``pos``: run, value, begin, length.

    A row starts a run when its value is not that of the row before (``with_previous``, so no window spans all rows); the runs are then
    numbered with ``with_position``, and a run ends where the next begins.
    """
    starts = with_previous(rows.select(order, value), value, "_v", order).filter((F.col(order) == 0) | ~F.col(value).eqNullSafe(F.col("_v")))
    starts = with_position(starts.select(F.col(order).alias("begin"), F.col(value).alias("value")), "begin").withColumnRenamed("pos", "run")
    end = (rows.agg(F.max(order)).first()[0] or 0) + 1
    starts = with_previous(starts.withColumn("_back", -F.col("run")), "begin", "_e", "_back")
    return starts.select("run", "value", "begin", (F.coalesce("_e", F.lit(end)) - F.col("begin")).cast("long").alias("length"))


def with_previous(rows: DataFrame, column: str, name: str, order: str = "pos") -> DataFrame:
    """Adds the value of the row one position before, null for the first. Positions are consecutive integers.

    A window in each block of ``BLOCK`` positions; the first row of a block takes the last one of the block before from a table of a row
    a block (broadcast where small).
    """
    rows = rows.withColumn("_k", F.floor(F.col(order) / BLOCK))
    inner = F.lag(column).over(Window.partitionBy("_k").orderBy(order))
    edge = small(materialised(rows.filter(F.pmod(F.col(order), F.lit(BLOCK)) == BLOCK - 1).select((F.col("_k") + 1).alias("_k"), F.col(column).alias("_edge")), "edges"))
    out = rows.withColumn(name, inner).join(edge, "_k", "left")
    return out.withColumn(name, F.when(F.pmod(F.col(order), F.lit(BLOCK)) == 0, F.col("_edge")).otherwise(F.col(name))).drop("_k", "_edge")


def deltas(rows: DataFrame, column: str = "millis", order: str = "pos") -> DataFrame:
    return with_previous(rows, column, "_b", order).withColumn("delta", F.col(column) - F.coalesce("_b", F.lit(0))).drop("_b")


def running_sum(rows: DataFrame, column: str, name: str, order: str = "pos", block: int | None = None) -> DataFrame:
    """Adds the sum of ``column`` up to each row: within blocks of positions, plus the blocks before, whose sums are summed up in
    the same way, level by level, until one block holds them all. So no window has more than ``block`` rows.
    """
    block = block or BLOCK
    level = F.floor(F.col(order) / block).cast("long")
    inner = F.sum(column).over(Window.partitionBy("_k").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("_k", level)
    sums = materialised(placed.groupBy("_k").agg(F.sum(column).alias("_s")), "sums")
    if sums.limit(2).count() < 2:
        return placed.withColumn(name, inner).drop("_k")
    upto = running_sum(sums.toDF("_p", "_s"), "_s", "_upto", "_p", block).select(F.col("_p").alias("_k"), (F.col("_upto") - F.col("_s")).alias("_before"))
    return placed.withColumn("_in", inner).join(small(materialised(upto, "sums")), "_k").withColumn(name, F.col("_in") + F.col("_before")).drop("_k", "_in", "_before")


def hot_groups(rows: DataFrame, by: list[str], block: int) -> DataFrame | None:
    """The groups with more than ``block`` rows, as ``_h0``, ``_h1``, ..; None if there are none. A partial and a final aggregate."""
    names = [f"_h{i}" for i in range(len(by))]
    hot = materialised(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block).select(*[F.col(c).alias(n) for c, n in zip(by, names)]), "hot")
    if hot.limit(1).count():
        return hot
    dropped(hot)
    return None


def split_hot(rows: DataFrame, by: list[str], block: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of other groups, and those of groups with more than ``block`` rows (None if there are none). Null equals null."""
    hot = hot_groups(rows, by, block)
    if hot is None:
        return rows, None
    on, hot = [F.col(c).eqNullSafe(F.col(f"_h{i}")) for i, c in enumerate(by)], small(hot)
    return rows.join(hot, on, "left_anti"), rows.join(hot, on, "left_semi")


def running_max(rows: DataFrame, by: list[str], order: str, column: str, name: str, before: bool = False, block: int | None = None) -> DataFrame:
    """Adds the largest ``column`` of the rows with equal ``by`` (nulls are equal) up to each in the order of ``order``, which no two of them share; with
    ``before`` the row itself is left out. Null where there is none.

    A group of up to ``block`` rows is one window. The rows of a larger one get their places in it (``with_position``), and a window spans ``block`` places and
    begins with the largest value of the blocks before, so a group that holds much of all rows is many tasks, however its numbers are spread.
    """
    block = block or 1 << 20
    last = -1 if before else 0
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, last)
    rest, hot = split_hot(rows, by, block)
    out = rest.withColumn(name, F.max(column).over(upto))
    if hot is None:
        return out
    placed = blocks(hot, by, order, block)
    earlier = Window.partitionBy(*by).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    tops = placed.groupBy(*by, "_k").agg(F.max(column).alias("_top")).select(*by, "_k", F.max("_top").over(earlier).alias(column))
    both = placed.withColumn("_own", F.lit(True)).unionByName(tops.filter(F.col(column).isNotNull()).withColumn("_own", F.lit(False)), allowMissingColumns=True)
    upto = Window.partitionBy(*by, "_k").orderBy("_own", "pos").rowsBetween(Window.unboundedPreceding, last)
    return out.unionByName(both.withColumn(name, F.max(column).over(upto)).filter("_own").drop("_own", "_k", "pos"))


def blocks(rows: DataFrame, by: list[str], order: str, block: int) -> DataFrame:
    """Adds ``pos``, the place in the group, and ``_k``, the number of its block of ``block`` places."""
    return with_position(rows, order, by).withColumn("_k", F.floor(F.col("pos") / block).cast("long"))


def numbered(rows: DataFrame, by: list[str], order: str, name: str, block: int | None = None) -> DataFrame:
    """Adds the number from 1 of each row in its group, in the order of ``order``; a group of more than ``block`` rows is no one window."""
    rest, hot = split_hot(rows, by, block or 1 << 20)
    out = rest.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(order)).cast("long"))
    return out if hot is None else out.unionByName(with_position(hot, order, by).withColumn(name, F.col("pos") + 1).drop("pos"))
