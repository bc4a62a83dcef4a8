"""Merging into and looking up in a bucketed log, typed cells, and cursors that are resumed."""

import pytest
from pyspark.sql import functions as F

from tidelog.operators import lww as L
from tidelog.sources.bucketed import BucketedLog
from tidelog.sources.log import scratch_path
from tidelog.sources.store import LogStore

from .test_changelog import log
from .test_store_bounds import key


@pytest.fixture
def bucketed(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    out = BucketedLog(spark, scratch_path(spark, "b"), log(spark, []).schema, 3)
    yield out
    out.close()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_merging_keeps_what_is_there(spark, bucketed):
    assert bucketed.merge(log(spark, [3, 1, 2, 1])) == 3 and bucketed.merge(log(spark, [1, 2])) == 0
    assert bucketed.merge(log(spark, [2, 9]).withColumn("n", F.lit(-1).cast("long"))) == 1
    assert sorted(r["n"] for r in bucketed.read().collect()) == [-1, 1, 2, 3]
    with pytest.raises(ValueError, match="null"):
        bucketed.merge(log(spark, [7]).withColumn("hlc", F.lit(None).cast("string")))
    bucketed.compact()
    assert sorted(r["n"] for r in bucketed.read().collect()) == [-1, 1, 2, 3] and len(bucketed.read().inputFiles()) <= 3
    bucketed.close()
    again = BucketedLog(spark, bucketed.path, log(spark, []).schema, 7)
    assert again.buckets == 3 and again.merge(log(spark, [9, 10])) == 1 and again.read().count() == 5


def test_the_stored_side_is_not_moved(spark, bucketed):
    bucketed.merge(log(spark, range(200)))
    fresh = bucketed.fresh(log(spark, [5, 500]))
    fresh.collect()
    plan = fresh._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    batch, stored = plan.split("ExistingRDD")  # the join's left side comes first
    assert "Exchange" in batch and "Bucketed: true" in stored and "Exchange" not in stored and "SortMergeJoin" in plan
    point = bucketed.point(key(7))
    assert point.count() == 1 and bucketed.point(key(999)).count() == 0
    parts = lambda df: df._jdf.queryExecution().toRdd().getNumPartitions()
    assert parts(point) == 1 and parts(bucketed.read()) == 3  # of three files one is read
    text = point._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(hlc," in text and "Exchange" not in text


def test_files_have_bloom_filters(spark, bucketed):
    bucketed.merge(log(spark, range(500)))
    jvm = spark._jvm
    for f in bucketed.read().inputFiles():
        at = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(f), spark._jsc.hadoopConfiguration())
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(at)
        column = reader.getFooter().getBlocks().get(0).getColumns().get(0)
        assert column.getPath().toDotString() == "hlc" and column.getBloomFilterOffset() > 0
        reader.close()


def test_values_keep_their_types(spark):
    rows = [("r", "a", 1, "x"), ("r", "a", 2, None), ("r", "b", 1, "x")]
    df = spark.createDataFrame(rows, "id string, col string, hlc long, t string")
    kinds = F.when(F.col("col") == "b", L.typed(F.lit(2.5))).otherwise(L.typed(F.col("t")))
    won = L.cells(df.withColumn("value", kinds), ["id", "col"])
    assert {r["col"]: r["k"] for r in won.select("col", L.type_of("value").alias("k")).collect()} == {"a": "VOID", "b": "DOUBLE"}
    more = df.limit(1).withColumn("hlc", F.lit(3).cast("long")).withColumn("value", L.typed(F.unhex(F.lit("00ff")))).select("id", "col", "value", "hlc")
    got = L.typed_pivot(L.merge_cells(won, more, ["id", "col"]), ["id"], "col", "value", {"a": "binary", "b": "double", "c": "string"}).first()
    assert (bytes(got["a"]), got["b"], got["c"]) == (b"\x00\xff", 2.5, None)


def test_a_cursor_goes_on_after_a_key(spark):
    store = LogStore(spark, scratch_path(spark, "t"))
    assert list(store.cursor()) == [] and store.scan() is None
    for keys in ([5, 1], [3, 9], [20, 30]):
        store.append(log(spark, keys))
    seen = []
    while part := list(zip(range(2), store.cursor(after=seen[-1]["hlc"] if seen else None))):
        seen += [r for _, r in part]
    assert [r["n"] for r in seen] == [1, 3, 5, 9, 20, 30]
    assert all(store.manifest().segments[2] in f for f in store.scan(after=key(9)).inputFiles())
    assert store.scan(after=key(99)).count() == 0 and [r["n"] for r in store.scan(key(1), key(9)).collect()] == [3, 5]
