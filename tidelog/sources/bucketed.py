"""A log laid out by key: bucketed by hash and sorted, with Bloom filters, so that neither merging nor a lookup moves what is stored."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import sets as S
from .log import dropped, materialised


class BucketedLog:
    """Rows keyed by ``key`` (not null) in a table of ``buckets`` buckets under ``path``, which all executors share.

    A batch is dealt to the buckets and joined with the stored rows bucket by bucket: the stored side is read in place. A lookup reads one bucket, of that
    the files and row groups whose bounds and Bloom filters do not rule the key out. Each merge adds up to a file a bucket; ``compact`` makes them one again. The
    number of buckets is fixed by the first to use the path. ``close`` takes the table out of the session's catalogue, not its files.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, buckets: int | None = None, key: str = "hlc"):
        self.spark, self.path, self.key, self.schema = spark, path, key, schema
        self.name = "tidelog_log_" + hashlib.md5(path.encode()).hexdigest()[:16]
        meta = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta")
        if meta.getFileSystem(spark._jsc.hadoopConfiguration()).exists(meta):
            got = spark.read.parquet(f"{path}/meta").first()
            self.buckets, self.folder = got["buckets"], got["folder"]
        else:
            self.buckets, self.folder = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "rows"
            self._remember()
        if not spark.catalog.tableExists(self.name):
            self._create()

    def _remember(self) -> None:
        self.spark.range(1).select(F.lit(self.buckets).alias("buckets"), F.lit(self.folder).alias("folder")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/meta")

    def _create(self) -> None:
        at, columns = f"{self.path}/{self.folder}".replace("'", "''"), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        bloom = f"OPTIONS ('parquet.bloom.filter.enabled#{self.key}' 'true')"
        self.spark.sql(f"CREATE TABLE {self.name} ({columns}) USING parquet {bloom} CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{at}'")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def point(self, key: str) -> DataFrame:
        return self.read().filter(F.col(self.key) == key)

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The first of each new key of ``batch``; only the batch is shuffled. An outer join, as an anti-join would be planned below the dealing to buckets."""
        new = S.first_of_batch(batch, [self.key]).repartition(self.buckets, self.key)
        there = self.read().select(F.col(self.key).alias("_there")).hint("merge")
        return new.join(there, F.col(self.key) == F.col("_there"), "left").filter("_there IS NULL").select(*self.schema.names)

    def _write(self, rows: DataFrame, name: str) -> None:
        dealt = rows.repartition(self.buckets, self.key).sortWithinPartitions(self.key)
        dealt.write.format("parquet").mode("append").option(f"parquet.bloom.filter.enabled#{self.key}", "true").bucketBy(self.buckets, self.key).sortBy(self.key).saveAsTable(name)

    def merge(self, batch: DataFrame) -> int:
        """Adds what is new and returns how many rows were; on a key that is there the old row stays. A null key is an error."""
        new = materialised(self.fresh(batch), "fresh")
        n, bare = new.agg(F.count(F.lit(1)), F.count(F.when(F.col(self.key).isNull(), 1))).first()
        if n and not bare:
            self._write(new, self.name)
        dropped(new)
        if bare:
            raise ValueError(f"{bare} keys of the batch are null")
        return n

    def compact(self) -> None:
        """Writes one sorted file a bucket into a new folder, which the table then has; the old one stays until it is deleted by hand."""
        rows, self.folder = materialised(self.read(), "rows"), f"rows-{hashlib.md5(self.folder.encode()).hexdigest()[:8]}"
        self.close()
        self._create()
        self._write(rows, self.name)
        self._remember()
        dropped(rows)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
