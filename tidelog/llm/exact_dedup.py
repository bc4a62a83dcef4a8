"""Exact dedup over a persistent digest index, bucketed and sorted by hash."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import few_files, keep_ids, new_path, pick, table, written


class DigestIndex:
    """An append-only table (digest, keep_id, n), bucketed and sorted by digest.

    ``path`` must be in storage that all executors share. ``buckets`` is fixed when the index is made and is kept beside it, so
    a later session opens the same layout. A batch is appended after a sort-merge anti-join; the index side is not shuffled
    when the batch has as many partitions as there are buckets.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.name = "tidelog_digests_" + hashlib.md5(path.encode()).hexdigest()[:16]
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta")
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            self.buckets = spark.read.parquet(f"{path}/meta").first()["buckets"]
        else:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).coalesce(1).write.parquet(f"{path}/meta")
        if not spark.catalog.tableExists(self.name):
            at = f"{path}/rows".replace("'", "''")
            spark.sql(f"CREATE TABLE {self.name} (digest STRING, keep_id BIGINT, n BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{at}'")

    def close(self) -> None:
        """Takes the table out of the session's catalogue, not its files: a later index of the same path opens them again."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame) -> None:
        """Adds those of ``groups`` (digest, keep_id, n; digests distinct) whose digest is not in the index yet."""
        fresh = groups.hint("merge").join(self.rows.select("digest"), "digest", "left_anti").select("digest", "keep_id", "n")
        fresh = fresh.repartition(self.buckets, "digest")
        fresh.write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)


def exact_dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. New digests are appended to ``index``.

    Texts are equal when identical; a null text counts as empty, an empty text is a text like any other. Of equal texts in one
    batch the row with the largest id stays; if the index has the digest from an earlier batch, that batch's keep_id stays and
    every row of this one goes. group_size counts equal rows of this batch and those counted in the index at the time. A null id
    is lower than any other; if all ids of a group are null, keep_id is null and one row stays. Of rows that repeat the same id
    and text one stays. Empty input: no rows. Extra columns are not looked at. The text is read once, only digests are shuffled;
    a digest that holds very many rows is counted by partial aggregates and its look-up is an exchanged equi-join, which
    adaptive execution splits.
    """
    rows = written(pick(docs, id_col, text_col).select(F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("digest")), "digests")
    groups = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    known = index.rows.select("digest", F.col("keep_id").alias("old_id"), F.col("n").alias("old_n"), F.lit(True).alias("old"))
    stats = written(few_files(groups.hint("merge").join(known, "digest", "left"), rows.count()), "groups")
    index.append(stats)
    out = rows.join(stats, "digest").select(
        "doc_id",
        F.when(F.col("old"), F.col("old_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        (F.col("n") + F.coalesce("old_n", F.lit(0))).alias("group_size"),
        (F.col("old").isNull() & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    # Only the rows that may stay, one or a few of each group, are looked through for repeats of the same id.
    repeats = stats.filter("old IS NULL AND n > 1").select(F.col("digest").alias("d"), F.col("keep_id").alias("k"))
    twice = rows.join(repeats, (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("k"))).groupBy("digest").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    if twice.limit(1).count():
        nth = F.row_number().over(Window.partitionBy("text_sha256", "doc_id", "kept").orderBy(F.lit(1)))
        out = out.filter("NOT kept").union(out.filter("kept").withColumn("nth", nth).withColumn("kept", F.col("nth") == 1).drop("nth"))
    return out


def drop_copies(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were. Rows that repeat both id and text are cut to one."""
    found = exact_dedup(docs, index, id_col, text_col)
    kept = keep_ids(docs, found, "kept", id_col)
    if found.filter("kept").count() == kept.count():
        return kept
    names = kept.columns
    plain = kept.toDF(*[f"_c{i}" for i in range(len(names))])
    i, t = f"_c{names.index(id_col)}", F.coalesce(F.col(f"_c{names.index(text_col)}"), F.lit(""))
    plain = plain.withColumn("_d", F.sha2(t, 256))
    stay = found.filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_s"))
    plain = plain.join(stay, F.col(i).eqNullSafe(F.col("_id")) & (F.col("_d") == F.col("_s")), "left_semi")
    nth = F.row_number().over(Window.partitionBy(i, "_d").orderBy(F.lit(1)))
    return plain.withColumn("_nth", nth).filter("_nth = 1").drop("_nth", "_d").toDF(*names)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark, new_path(spark, "digest-index"))
    found = exact_dedup(table(spark, sf_dir, "documents"), index)
    index.close()
    return found


ORACLE = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

