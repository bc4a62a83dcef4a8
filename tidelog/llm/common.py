"""What the training-data operators share: column picking, written intermediate tables, hot-key splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a plain ``local`` session (tests) gets a temporary folder; any other master is an error,
    since a machine-local folder would not be seen by the other executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def new_path(spark: SparkSession, what: str) -> str:
    """A new name in the shared folder, in the part of it that the session names in tidelog.scratch, if it does."""
    return "/".join(filter(None, [shared_dir(spark), "tidelog", spark.conf.get("tidelog.scratch", ""), f"{what}-{uuid.uuid4().hex}"]))


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends there and a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows for which a table of ``few_files`` gets a file, and the files that a small one may have.
FILE_ROWS, FILES = 1 << 18, 8


def few_files(df: DataFrame, rows: int = 0) -> DataFrame:
    """``df``, of at most ``rows`` rows, in partitions for few files: on a local disk each file starts child processes of the executor (``chmod``).

    The last stage runs in as many tasks, so it should do little for each row and its keys should have few rows each.
    """
    return df.coalesce(max(FILES, -(-rows // FILE_ROWS)))


def evenly(df: DataFrame) -> DataFrame:
    """``df`` dealt anew for few files by one more small shuffle, which leaves the stage before as it is; adaptive execution cuts what is large."""
    return df.hint("rebalance", FILES)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that ``written`` made, once nothing will read it again."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, found by position, so that other columns that differ only in case or clash with internal names do no harm."""
    at = [df.columns.index(n) for n in names]
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_c{i}").alias(n) for i, n in zip(at, names, strict=True)])


def keep_ids(docs: DataFrame, ids: DataFrame, kept: str, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id has a row in ``ids`` (doc_id and any others) for which ``kept`` holds, all columns as they were; a null id equals
    a null id. Each id of ``docs`` must be in ``ids``: the others, mostly few, are written and joined, so that whole texts are shuffled only where they are many.
    """
    names = docs.columns
    at = names.index(id_col)
    plain = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    gone = ids.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.expr(kept)).alias("stays")).filter("NOT stays").select("_id")
    return plain.join(written(evenly(gone), "gone"), F.col(f"_c{at}").eqNullSafe(F.col("_id")), "left_anti").toDF(*names)


#: Rows of a table that is broadcast at most.
BROADCAST = 50_000


def small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has at most ``BROADCAST`` rows, else joined as it is."""
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def whole_groups(batches: Iterator[pa.RecordBatch], column: int, rows: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches sorted by an integer column, regrouped: each list holds whole groups of equal values, and stops at the first end of a group beyond ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    n, last = 0, None
    for b in batches:
        if not b.num_rows:
            continue
        v = b.column(column).to_numpy()
        begin = 0
        for end in np.append(np.flatnonzero(v[1:] != v[:-1]) + 1, b.num_rows).tolist():
            if v[begin] != last and n >= rows:
                yield held
                held, n = [], 0
            last = v[begin]
            held.append(b.slice(begin, end - begin))
            n += end - begin
            begin = end
    if held:
        yield held


def split_hot(df: DataFrame, keys: list[str], id_col: str, target: int) -> DataFrame:
    """Adds ``part_a``, ``part_b``: a key with more than ``target`` rows is cut into blocks by hash of ``id_col`` and each row goes
    to every pair of blocks that holds its own, so that each pair of rows of a key meets in exactly one (key, part_a, part_b):
    that with part_a, part_b the smaller and larger of their blocks. Column ``part`` is the row's own block. The table of hot keys is
    broadcast where it is small, so ``df`` is not shuffled for it.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > target)
    counts = small(written(counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.ceil(F.col("_n") / target).cast("int").alias("_blocks")), "hot"))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    joined = df.join(counts, on, "left").drop(*[f"_k_{k}" for k in keys])
    joined = joined.withColumn("_blocks", F.coalesce("_blocks", F.lit(1))).withColumn("part", F.pmod(F.xxhash64(id_col), F.col("_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    return joined.withColumn("_o", other).withColumn("part_a", F.least("part", "_o")).withColumn("part_b", F.greatest("part", "_o")).drop("_o", "_blocks")
