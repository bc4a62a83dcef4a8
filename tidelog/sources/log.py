"""Change logs from tables, and the scratch tables that iterative operators write."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hlc as H


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a plain local session without one gets a temporary folder, any other master is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new name in the shared folder, in the part of it that the session names in tidelog.scratch, if it does."""
    return "/".join(filter(None, [shared_dir(spark), "tidelog", spark.conf.get("tidelog.scratch", ""), f"{what}-{uuid.uuid4().hex}"]))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Within it, all that operators write beside their results goes to a folder of its own, which is deleted at the end: read or write results before.

    A result is lazy and reads its operator's tables, so these cannot go earlier; those that no result needs go as soon as they have been read.
    """
    before, name = spark.conf.get("tidelog.scratch", ""), f"scratch-{uuid.uuid4().hex}"
    spark.conf.set("tidelog.scratch", name)
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tidelog/{name}")
    try:
        yield at.toString()
    finally:
        spark.conf.set("tidelog.scratch", before)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialised(df: DataFrame, what: str) -> DataFrame:
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``materialised`` made, once nothing will read them again."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of a table that is broadcast at most.
BROADCAST = 50_000


def small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has at most ``BROADCAST`` rows, else joined as it is."""
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str, lower: str | None = None, upper: str | None = None) -> DataFrame:
    """``events`` as a change log: each event sets column event_type of row user_id in table ``events`` to its value.

    With ``lower`` or ``upper`` just the changes at or after the one timestamp and before the other. The millis of the bounds go to the scan as
    a predicate on ``ts``, so files and row groups outside them are not read.
    """
    e = table(spark, sf_dir, "events")
    if lower is not None:
        e = e.filter(F.col("ts") >= H.instant(lower))
    if upper is not None:
        e = e.filter(F.col("ts") < H.instant(upper, 1))
    log = _log(e)
    if lower is not None:
        log = log.filter(F.col("hlc") >= lower)
    return log if upper is None else log.filter(F.col("hlc") < upper)


def _log(events: DataFrame) -> DataFrame:
    e = events.select("event_id", "user_id", "event_type", "value", H.millis("ts").alias("millis"))
    e = e.withColumn("counter", F.col("event_id") % 65536).withColumn("node", H.node("user_id"))
    return e.withColumn("hlc", H.encode(F.col("millis"), F.col("counter"), F.col("node")))


def replica(log: DataFrame, leave_out: int) -> DataFrame:
    """A replica of a log of events that lacks every ``leave_out``-th one."""
    return log.filter(F.col("event_id") % leave_out != 0)
