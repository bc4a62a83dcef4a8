"""The registered queries over the change-log operators, each with the SQL it is held against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bulk as B
from ..functions import encodings as E
from ..functions import fingerprint as FP
from ..functions import hlc as H
from ..functions import wire as W
from ..operators import descent as DE
from ..operators import lww as L
from ..operators import ranges as R
from ..operators import reconcile as RC
from ..operators import sets as S
from ..sources.bucketed import BucketedLog
from ..sources.log import event_log, replica, scratch_path, table
from ..sources.store import LogStore, ReplayError
from ..streaming import feed as FE
from ..streaming import ingest as I
from ..streaming import windows as WI

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LOG = """log AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS millis, event_id % 65536 AS counter, printf('%016x', user_id) AS node,
  printf('%012x', epoch_us(ts) // 1000) || printf('%04x', event_id % 65536) || printf('%016x', user_id) AS hlc FROM events),
k AS (SELECT *, substr(sha256(unhex(hlc)), 1, 24) AS fp, row_number() OVER (ORDER BY hlc) - 1 AS pos, ntile(16) OVER (ORDER BY hlc) - 1 AS bucket FROM log),
x AS (SELECT *, ('0x' || substr(fp, 1, 8))::BIGINT AS l0, ('0x' || substr(fp, 9, 8))::BIGINT AS l1, ('0x' || substr(fp, 17, 8))::BIGINT AS l2 FROM k),
a AS (SELECT * FROM x WHERE event_id % 10 <> 0), b AS (SELECT * FROM x WHERE event_id % 7 <> 0)"""
XOR = "printf('%08x', coalesce(bit_xor(l0), 0)) || printf('%08x', coalesce(bit_xor(l1), 0)) || printf('%08x', coalesce(bit_xor(l2), 0))"


def query(oracle: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = f"WITH {LOG} {oracle}"
        return f

    return register


CELL = ["user_id", "event_type"]


# ---- clocks


@query("SELECT event_id, hlc FROM log")
def hlc_encode(spark: SparkSession, d: str) -> DataFrame:
    return event_log(spark, d).select("event_id", "hlc")


@query("SELECT event_id, millis, counter::BIGINT AS counter, node FROM log")
def hlc_decode(spark: SparkSession, d: str) -> DataFrame:
    return event_log(spark, d).select("event_id", *H.decode("hlc"))


@query("SELECT event_id, pos::BIGINT AS pos FROM k")
def hlc_order(spark: SparkSession, d: str) -> DataFrame:
    return R.with_position(event_log(spark, d)).select("event_id", "pos")


@query("SELECT event_id, hlc FROM log WHERE hlc >= '018cd00000000000' AND hlc < '018ce00000000000'")
def hlc_range_scan(spark: SparkSession, d: str) -> DataFrame:
    return event_log(spark, d, "018cd00000000000", "018ce00000000000").select("event_id", "hlc")


@query("SELECT event_id, user_id, value FROM log WHERE hlc = (SELECT max(hlc) FROM log)")
def hlc_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    log = event_log(spark, d)
    store = LogStore(spark, scratch_path(spark, "store"))
    store.append(log)
    return store.point(log.agg(F.max("hlc")).first()[0]).select("event_id", "user_id", "value")


NOW = "(millis - event_id % 3 * 200000)"


@query(f"""SELECT event_id, CASE WHEN e IS NULL THEN top END AS millis, CASE WHEN e IS NULL THEN c END::BIGINT AS counter, e AS error FROM (
  SELECT event_id, top, c, CASE WHEN top - now > 300000 THEN 'drift' WHEN c > 65535 THEN 'counter' END AS e FROM (
    SELECT event_id, now, greatest(millis, now) AS top, CASE WHEN greatest(millis, now) = millis THEN counter + 1 ELSE 0 END AS c FROM (SELECT *, {NOW} AS now FROM log)))""")
def hlc_send_tick(spark: SparkSession, d: str) -> DataFrame:
    log = event_log(spark, d).withColumn("t", H.send(F.col("millis"), F.col("counter"), F.expr(NOW)))
    return log.select("event_id", "t.millis", "t.counter", "t.error")


@query(f"""SELECT event_id, CASE WHEN e IS NULL THEN top END AS millis, CASE WHEN e IS NULL THEN c END::BIGINT AS counter, e AS error FROM (
  SELECT event_id, top, c, CASE WHEN top - now > 300000 THEN 'drift' WHEN c > 65535 THEN 'counter' END AS e FROM (
    SELECT event_id, now, top, CASE WHEN top = millis AND top = om THEN greatest(counter, oc) + 1 WHEN top = millis THEN counter + 1 WHEN top = om THEN oc + 1 ELSE 0 END AS c FROM (
      SELECT *, greatest(millis, om, now) AS top FROM (SELECT *, {NOW} AS now, millis + event_id % 5 * 40000 - 80000 AS om, event_id % 7 AS oc FROM log))))""")
def hlc_receive_tick(spark: SparkSession, d: str) -> DataFrame:
    log = event_log(spark, d).withColumn("t", H.receive(F.col("millis"), F.col("counter"), F.expr("millis + event_id % 5 * 40000 - 80000"), F.expr("event_id % 7"), F.expr(NOW)))
    return log.select("event_id", "t.millis", "t.counter", "t.error")


@query(f"SELECT event_id, 'drift' AS reason FROM log WHERE millis - {NOW} > 300000")
def drift_rejects(spark: SparkSession, d: str) -> DataFrame:
    return I.quarantined(event_log(spark, d).withColumn("now", F.expr(NOW)), "now").select("event_id", "reason")


@query("SELECT event_id, CASE WHEN event_id % 11 = 0 THEN FALSE WHEN event_id % 13 = 0 THEN FALSE ELSE TRUE END AS ok FROM log")
def domain_checks(spark: SparkSession, d: str) -> DataFrame:
    log = event_log(spark, d)
    ms = F.when(F.col("event_id") % 11 == 0, H.MAX_MILLIS + 1).otherwise(F.col("millis"))
    counter = F.when(F.col("event_id") % 13 == 0, H.MAX_COUNTER + 1).otherwise(F.col("counter"))
    return log.select("event_id", H.in_domain(ms, counter).alias("ok"))


def _clock_events(spark: SparkSession, d: str) -> DataFrame:
    e = event_log(spark, d).withColumn("seq", F.col("event_id")).withColumn("now", F.expr("millis div 100000 * 100000"))
    remote = F.col("event_id") % 3 == 0
    return e.select("node", "seq", "now", F.when(remote, F.expr("now + event_id % 4 * 120000")).alias("remote_millis"), F.when(remote, F.col("event_id") % 50).alias("remote_counter"))


#: The clock of each node, event by event.
FOLD = """e AS (SELECT node, event_id AS seq, now, CASE WHEN event_id % 3 = 0 THEN now + event_id % 4 * 120000 END AS rm, CASE WHEN event_id % 3 = 0 THEN event_id % 50 END AS rc,
  row_number() OVER (PARTITION BY node ORDER BY event_id) AS i FROM (SELECT *, millis // 100000 * 100000 AS now FROM log)),
r(node, i, seq, ms, c, error) AS (SELECT DISTINCT node, 0::BIGINT, NULL::BIGINT, 0::BIGINT, 0::BIGINT, NULL::VARCHAR FROM e
  UNION ALL SELECT node, i, seq, CASE WHEN x IS NULL THEN top ELSE ms END, CASE WHEN x IS NULL THEN new ELSE c END, x FROM (
    SELECT *, CASE WHEN top - now > 300000 THEN 'drift' WHEN new > 65535 THEN 'counter' END AS x FROM (
      SELECT *, greatest(CASE WHEN top = ms THEN c + 1 ELSE 0 END, CASE WHEN top = rm THEN rc + 1 ELSE 0 END) AS new FROM (
        SELECT r.node, e.i, e.seq, e.now, e.rm, e.rc, r.ms, r.c, greatest(r.ms, e.now, coalesce(e.rm, 0)) AS top FROM r JOIN e ON e.node = r.node AND e.i = r.i + 1))))
SELECT node, seq, CASE WHEN error IS NULL THEN ms END AS millis, CASE WHEN error IS NULL THEN c END AS counter, error FROM r WHERE i > 0"""


@query()
def hlc_fold(spark: SparkSession, d: str) -> DataFrame:
    return I.fold(_clock_events(spark, d)).select("node", "seq", "millis", "counter", "error")


@query("SELECT event_id, strftime(make_timestamp(millis * 1000), '%H:%M:%S.%g') AS clock FROM log")
def utc_clock_text(spark: SparkSession, d: str) -> DataFrame:
    return event_log(spark, d).select("event_id", H.clock_text(F.col("millis")).alias("clock"))


@query("SELECT p_partkey, regexp_full_match(t, '[0-9a-f]{16}') AS valid FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN printf('%016x', p_partkey) WHEN 1 THEN printf('%016X', p_partkey + 200) WHEN 2 THEN printf('%017x', p_partkey) ELSE '' END AS t FROM part)")
def node_id_valid(spark: SparkSession, d: str) -> DataFrame:
    h = F.hex("p_partkey")
    t = F.when(F.col("p_partkey") % 4 == 0, F.lower(F.lpad(h, 16, "0"))).when(F.col("p_partkey") % 4 == 1, F.lpad(F.hex(F.col("p_partkey") + 200), 16, "0")).when(F.col("p_partkey") % 4 == 2, F.lower(F.lpad(h, 17, "0"))).otherwise("")
    return table(spark, d, "part").select("p_partkey", H.valid_node(t).alias("valid"))


# ---- fingerprints, positions, buckets


@query("SELECT count(*)::BIGINT AS n FROM log")
def log_size(spark: SparkSession, d: str) -> DataFrame:
    return event_log(spark, d).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*)::BIGINT AS n FROM log")
def manifest_scan(spark: SparkSession, d: str) -> DataFrame:
    store = LogStore(spark, scratch_path(spark, "store"))
    store.append(event_log(spark, d))
    return spark.range(1).select(F.lit(store.size()).cast("long").alias("n"))


@query("SELECT event_id, pos::BIGINT AS pos FROM k WHERE pos >= 100 AND pos < 250")
def positional_slice(spark: SparkSession, d: str) -> DataFrame:
    return R.slice_of(event_log(spark, d), 100, 250).select("event_id", "pos")


@query("SELECT event_id, fp FROM k")
def key_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return event_log(spark, d).select("event_id", FP.key_fingerprint("hlc").alias("fp"))


@query(f"SELECT count(*)::BIGINT AS n, {XOR} AS fp FROM x WHERE hlc >= '018cd00000000000'")
def fingerprint_range(spark: SparkSession, d: str) -> DataFrame:
    rows = FP.with_lanes(event_log(spark, d, "018cd00000000000").select("hlc"))
    return rows.agg(F.count(F.lit(1)).alias("n"), *FP.xor()).select("n", FP.text().alias("fp"))


@query(f"SELECT {XOR} AS fp FROM x WHERE hlc < '0'")
def fingerprint_empty_range(spark: SparkSession, d: str) -> DataFrame:
    return FP.with_lanes(event_log(spark, d).filter(F.col("hlc") < "0").select("hlc")).agg(*FP.xor()).select(FP.text().alias("fp"))


@query(f"SELECT {XOR} AS fp, {XOR} AS fp_of_parts FROM x")
def fingerprint_partition_law(spark: SparkSession, d: str) -> DataFrame:
    rows = FP.with_lanes(event_log(spark, d).select("hlc", "event_id"))
    whole = rows.agg(*FP.xor()).select(FP.text().alias("fp"))
    parts = rows.groupBy(F.col("event_id") % 3).agg(*FP.xor()).agg(*FP.xor()).select(FP.text().alias("fp_of_parts"))
    return whole.withColumn("fp_of_parts", F.lit(parts.first()[0]))


@query("SELECT bucket::BIGINT AS bucket, count(*)::BIGINT AS n FROM k GROUP BY bucket")
def balanced_buckets(spark: SparkSession, d: str) -> DataFrame:
    return R.balanced_summary(event_log(spark, d)).select("bucket", "n")


@query(f"SELECT bucket::BIGINT AS bucket, count(*)::BIGINT AS n, {XOR} AS fp FROM x GROUP BY bucket")
def bucket_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return R.balanced_summary(event_log(spark, d)).select("bucket", "n", "fp")


@query("SELECT bucket::BIGINT AS bucket, min(hlc) AS lower, lead(min(hlc)) OVER (ORDER BY bucket) AS upper FROM k GROUP BY bucket")
def bucket_bounds(spark: SparkSession, d: str) -> DataFrame:
    return R.balanced_summary(event_log(spark, d)).select("bucket", "lower", "upper")


@query(f"SELECT bucket::BIGINT AS range_idx, min(hlc) AS lower, lead(min(hlc)) OVER (ORDER BY bucket) AS upper, 'fingerprint' AS kind, {XOR} AS fp FROM x GROUP BY bucket")
def range_listing(spark: SparkSession, d: str) -> DataFrame:
    return R.range_rows(event_log(spark, d)).select("range_idx", "lower", "upper", "kind", "fp")


@query("SELECT event_id, hlc || fp AS entry FROM k")
def index_entry_bytes(spark: SparkSession, d: str) -> DataFrame:
    entry = F.concat(H.to_bytes("hlc"), F.unhex(FP.key_fingerprint("hlc")))
    return event_log(spark, d).select("event_id", F.lower(F.hex(entry)).alias("entry"))


@query("SELECT event_id, (millis - coalesce(lag(millis) OVER (ORDER BY hlc), 0))::BIGINT AS delta FROM k")
def delta_millis(spark: SparkSession, d: str) -> DataFrame:
    return R.deltas(R.with_position(event_log(spark, d))).select("event_id", "delta")


@query("SELECT event_id, millis FROM log")
def delta_decode(spark: SparkSession, d: str) -> DataFrame:
    coded = R.deltas(R.with_position(event_log(spark, d))).select("event_id", "pos", "delta")
    return R.running_sum(coded, "delta", "millis").select("event_id", "millis")


RUNS = """SELECT run::BIGINT AS run, any_value(v)::{t} AS value, count(*)::BIGINT AS length FROM (SELECT v, sum(c) OVER (ORDER BY pos) - 1 AS run FROM (
  SELECT pos, v, CASE WHEN lag(v) OVER (ORDER BY pos) IS DISTINCT FROM v THEN 1 ELSE 0 END AS c FROM (SELECT pos, {v} AS v FROM k))) GROUP BY run"""


@query(RUNS.format(v="counter // 64 % 3", t="BIGINT"))
def rle_counters(spark: SparkSession, d: str) -> DataFrame:
    rows = R.with_position(event_log(spark, d)).withColumn("c", F.expr("counter div 64 % 3"))
    return R.run_lengths(rows, "c").select("run", F.col("value").cast("long").alias("value"), "length")


@query(RUNS.format(v="node", t="VARCHAR"))
def rle_nodes(spark: SparkSession, d: str) -> DataFrame:
    return R.run_lengths(R.with_position(event_log(spark, d)), "node").select("run", "value", "length")


# ---- last writer wins


@query("SELECT user_id, event_type, arg_max_null(value, hlc) AS value, max(hlc) AS hlc FROM log GROUP BY user_id, event_type")
def lww_cells(spark: SparkSession, d: str) -> DataFrame:
    return L.cells(event_log(spark, d), CELL)


@query("SELECT user_id, event_type, arg_max_null(value, hlc) AS value, max(hlc) AS hlc FROM log WHERE hlc <= '018ce00000000000' GROUP BY user_id, event_type")
def lww_as_of(spark: SparkSession, d: str) -> DataFrame:
    return L.cells_as_of(event_log(spark, d), CELL, "018ce00000000000")


@query("SELECT user_id, event_type, arg_max_null(v, hlc) AS value, max(hlc) AS hlc FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v FROM log) GROUP BY user_id, event_type")
def lww_null_winner(spark: SparkSession, d: str) -> DataFrame:
    return L.cells(event_log(spark, d).withColumn("value", F.when(F.col("event_id") % 3 != 0, F.col("value"))), CELL)


ARRIVAL = "event_id * 7919 % 10007"


@query(f"""SELECT event_id FROM (SELECT event_id, hlc, max(hlc) OVER (PARTITION BY user_id, event_type ORDER BY {ARRIVAL}, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cur FROM log) WHERE cur >= hlc""")
def lww_rejected(spark: SparkSession, d: str) -> DataFrame:
    log = event_log(spark, d).withColumn("arrival", F.struct(F.expr(ARRIVAL).alias("at"), "event_id"))
    return L.rejected(log, CELL, "arrival").select("event_id")


@query("SELECT a.event_id, (b.hlc IS NULL OR b.hlc < a.hlc) AS accepted FROM log a LEFT JOIN log b ON b.event_id = a.event_id + 1")
def lww_accepts(spark: SparkSession, d: str) -> DataFrame:
    log = event_log(spark, d)
    current = log.select((F.col("event_id") - 1).alias("e"), F.col("hlc").alias("current"))
    return log.join(current, log["event_id"] == current["e"], "left").select("event_id", L.accepts(F.col("current"), F.col("hlc")).alias("accepted"))


@query("SELECT user_id, event_type, arg_max_null(value, hlc) AS value, max(hlc) AS hlc FROM log GROUP BY user_id, event_type")
def lww_incremental(spark: SparkSession, d: str) -> DataFrame:
    log = event_log(spark, d)
    old = L.cells(log.filter("event_id % 4 < 3"), CELL)
    return L.merge_cells(old, log.filter("event_id % 4 > 1"), CELL)


def _changes(spark: SparkSession, d: str) -> DataFrame:
    log = event_log(spark, d)
    gone = F.when(F.col("event_id") % 5 == 0, True).when(F.col("event_id") % 5 == 1, False)
    return log.select("event_id", "user_id", "millis", "hlc", (F.col("event_id") % 4 == 0).alias("is_insert"), gone.alias("is_delete"), F.create_map("event_type", F.format_string("%.2f", "value")).alias("values"))


CHANGES = """c AS (SELECT event_id, user_id, millis, hlc, event_type, printf('%.2f', value) AS v, event_id % 4 = 0 AS ins, CASE event_id % 5 WHEN 0 THEN '1' WHEN 1 THEN '0' END AS del FROM log),
e AS (SELECT event_id, user_id, hlc, 0 AS position, CASE WHEN ins THEN 'createdAt' ELSE 'updatedAt' END AS "column", millis::VARCHAR AS value FROM c
  UNION ALL SELECT event_id, user_id, hlc, 1, 'isDeleted', del FROM c WHERE del IS NOT NULL
  UNION ALL SELECT event_id, user_id, hlc, CASE WHEN del IS NULL THEN 1 ELSE 2 END, event_type, v FROM c)"""


@query('SELECT event_id, position::BIGINT AS position, "column", value FROM e')
def change_columns(spark: SparkSession, d: str) -> DataFrame:
    return L.change_columns(_changes(spark, d)).select("event_id", F.col("position").cast("long").alias("position"), "column", "value")


@query("""SELECT "column", "column" IN ('createdAt', 'updatedAt', 'isDeleted', 'ownerId', 'id') AS system, count(*)::BIGINT AS n FROM e GROUP BY "column" """)
def system_columns(spark: SparkSession, d: str) -> DataFrame:
    return L.change_columns(_changes(spark, d)).groupBy("column").agg(F.count(F.lit(1)).alias("n")).select("column", L.is_system("column").alias("system"), "n")


KNOWN = ["createdAt", "updatedAt", "isDeleted"]


@query("""SELECT user_id, max(value) FILTER ("column" = 'createdAt') AS createdAt, max(value) FILTER ("column" = 'updatedAt') AS updatedAt, max(value) FILTER ("column" = 'isDeleted') AS isDeleted FROM (
  SELECT user_id, "column", arg_max_null(value, hlc) AS value FROM e GROUP BY user_id, "column") GROUP BY user_id""")
def row_pivot(spark: SparkSession, d: str) -> DataFrame:
    won = L.cells(L.change_columns(_changes(spark, d)), ["user_id", "column"])
    return L.pivot(won, ["user_id"], "column", "value", KNOWN)


@query("""SELECT user_id FROM (SELECT user_id, "column", arg_max_null(value, hlc) AS value FROM e GROUP BY user_id, "column") WHERE "column" = 'isDeleted' AND value = '1'""")
def soft_delete(spark: SparkSession, d: str) -> DataFrame:
    won = L.cells(L.change_columns(_changes(spark, d)), ["user_id", "column"])
    return won.filter("`column` = 'isDeleted' AND value = '1'").select("user_id")


@query("""SELECT user_id FROM (SELECT user_id, arg_max_null(value, hlc) FILTER ("column" = 'isDeleted') AS v FROM e GROUP BY user_id) WHERE v IS DISTINCT FROM '1'""")
def undelete(spark: SparkSession, d: str) -> DataFrame:
    return L.live_rows(L.cells(L.change_columns(_changes(spark, d)), ["user_id", "column"]), ["user_id"])


#: Every event sets a cell to a number, a text, null or bytes.
TYPED = """v AS (SELECT *, event_id % 4 AS kind FROM log), y AS (SELECT user_id, event_type, max(hlc) AS hlc, arg_max(kind, hlc) AS kind, arg_max(value, hlc) AS value FROM v GROUP BY user_id, event_type)"""


def _typed_cells(spark: SparkSession, d: str) -> DataFrame:
    kind, log = F.col("event_id") % 4, event_log(spark, d)
    value = F.when(kind == 0, L.typed(F.col("value"))).when(kind == 1, L.typed(F.concat(F.lit("é"), "hlc"))).when(kind == 2, L.typed(F.lit(None).cast("string"))).otherwise(L.typed(H.to_bytes("hlc")))
    return L.cells(log.withColumn("value", value), CELL)


@query(f"""SELECT user_id, event_type, hlc, ['DOUBLE', 'STRING', 'VOID', 'BINARY'][kind + 1] AS type, CASE WHEN kind = 0 THEN value END AS number, CASE WHEN kind = 1 THEN 'é' || hlc END AS text, CASE WHEN kind = 3 THEN hlc END AS bytes FROM y""")
def typed_cells(spark: SparkSession, d: str) -> DataFrame:
    get = lambda kind: F.try_variant_get("value", "$", kind)
    number = F.when(L.type_of("value") == "DOUBLE", get("double"))
    text, data = F.when(L.type_of("value") == "STRING", get("string")), F.when(L.type_of("value") == "BINARY", F.lower(F.hex(get("binary"))))
    return _typed_cells(spark, d).select(*CELL, "hlc", L.type_of("value").alias("type"), number.alias("number"), text.alias("text"), data.alias("bytes"))


@query("""SELECT user_id, arg_max(value, hlc) FILTER (event_type = 'click') AS click, arg_max('é' || hlc, hlc) FILTER (event_type = 'view') AS view, arg_max(hlc, hlc) FILTER (event_type = 'purchase') AS purchase FROM log GROUP BY user_id""")
def typed_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Clicks are numbers, views texts, purchases bytes and all else null."""
    kind = F.col("event_type")
    value = F.when(kind == "click", L.typed(F.col("value"))).when(kind == "view", L.typed(F.concat(F.lit("é"), "hlc"))).when(kind == "purchase", L.typed(H.to_bytes("hlc"))).otherwise(L.typed(F.lit(None).cast("string")))
    rows = L.typed_pivot(L.cells(event_log(spark, d).withColumn("value", value), CELL), ["user_id"], "event_type", "value", {"click": "double", "view": "string", "purchase": "binary"})
    return rows.withColumn("purchase", F.lower(F.hex("purchase")))


ORACLES["typed_cells"] = f"WITH {LOG}, {TYPED} " + ORACLES["typed_cells"].removeprefix(f"WITH {LOG} ")
for _name in ("change_columns", "system_columns", "row_pivot", "soft_delete", "undelete"):
    _body = ORACLES[_name].removeprefix(f"WITH {LOG} ")
    ORACLES[_name] = f"WITH {LOG}, {CHANGES} {_body}"


# ---- replicas


def _replicas(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    log = event_log(spark, d)
    return replica(log, 10), replica(log, 7)


@query("SELECT event_id, hlc FROM a WHERE hlc NOT IN (SELECT hlc FROM b)")
def missing_at_b(spark: SparkSession, d: str) -> DataFrame:
    a, b = _replicas(spark, d)
    return S.missing(a, b, ["hlc"]).select("event_id", "hlc")


@query("SELECT event_id, hlc FROM b WHERE hlc NOT IN (SELECT hlc FROM a)")
def missing_at_a(spark: SparkSession, d: str) -> DataFrame:
    a, b = _replicas(spark, d)
    return S.missing(b, a, ["hlc"]).select("event_id", "hlc")


@query("SELECT event_id, hlc FROM a WHERE hlc IN (SELECT hlc FROM b)")
def common_keys(spark: SparkSession, d: str) -> DataFrame:
    a, b = _replicas(spark, d)
    return S.common(a, b, ["hlc"]).select("event_id", "hlc")


@query("SELECT event_id, hlc, value FROM a UNION ALL SELECT event_id, hlc, -value FROM b WHERE hlc NOT IN (SELECT hlc FROM a)")
def merged_log(spark: SparkSession, d: str) -> DataFrame:
    a, b = (x.select("event_id", "hlc", "value") for x in _replicas(spark, d))
    return S.merge(a, b.withColumn("value", -F.col("value")), ["hlc"])


@query("SELECT event_id, hlc, 1::BIGINT AS arrival FROM log")
def batch_dedup(spark: SparkSession, d: str) -> DataFrame:
    log = event_log(spark, d).select("event_id", "hlc")
    twice = log.withColumn("arrival", F.lit(2).cast("long")).unionByName(log.withColumn("arrival", F.lit(1).cast("long")))
    return S.first_of_batch(twice, ["hlc"], "arrival")


@query("SELECT count(*)::BIGINT AS n FROM a WHERE hlc IN (SELECT hlc FROM b)")
def duplicate_count(spark: SparkSession, d: str) -> DataFrame:
    a, b = _replicas(spark, d)
    return S.common(a, b, ["hlc"]).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT (SELECT count(*) FROM b WHERE hlc NOT IN (SELECT hlc FROM a)) > 0 AS lacks FROM (SELECT 1)")
def exists_missing(spark: SparkSession, d: str) -> DataFrame:
    a, b = _replicas(spark, d)
    return spark.range(1).select(F.lit(S.lacks_any(a, b, ["hlc"])).alias("lacks"))


@query("SELECT a.event_id, b.value AS payload FROM a LEFT JOIN b USING (hlc)")
def payload_join(spark: SparkSession, d: str) -> DataFrame:
    a, b = _replicas(spark, d)
    return S.with_payload(a.select("event_id", "hlc"), b.select("hlc", F.col("value").alias("payload")), ["hlc"]).select("event_id", "payload")


RANGES = f"""n AS (SELECT hlc, ntile(16) OVER (ORDER BY hlc) - 1 AS bucket, l0, l1, l2 FROM a),
o AS (SELECT bucket, count(*) AS n_a, min(hlc) AS lo, lead(min(hlc)) OVER (ORDER BY bucket) AS upper, {XOR} AS fp_a FROM n GROUP BY bucket),
t AS (SELECT o.bucket, count(b.hlc) AS n_b, {XOR} AS fp_b FROM o LEFT JOIN b ON (b.hlc >= lo OR o.bucket = 0) AND (upper IS NULL OR b.hlc < upper) GROUP BY o.bucket)
SELECT bucket::BIGINT AS range_idx, CASE WHEN bucket > 0 THEN lo END AS lower, upper, n_a::BIGINT AS n_a, n_b::BIGINT AS n_b, fp_a, fp_b, fp_a <> fp_b OR n_a <> n_b AS differs FROM o JOIN t USING (bucket)"""


@query()
def reconcile_ranges(spark: SparkSession, d: str) -> DataFrame:
    return RC.compare(*_replicas(spark, d))


@query()
def reconcile_differing(spark: SparkSession, d: str) -> DataFrame:
    log = event_log(spark, d)
    return RC.compare(log, event_log(spark, d, "018cd00000000000")).filter("differs").select("range_idx", "n_a", "n_b")


ORACLES["reconcile_ranges"] = f"WITH {LOG}, {RANGES}"
ORACLES["reconcile_differing"] = f"WITH {LOG.replace('a AS (SELECT * FROM x WHERE event_id % 10 <> 0)', 'a AS (SELECT * FROM x)').replace('event_id % 7 <> 0', chr(39).join(['hlc >= ', '018cd00000000000', '']))}, r AS (WITH {RANGES}) SELECT range_idx, n_a, n_b FROM r WHERE differs"


@query("SELECT 'a' AS lacking, event_id, hlc FROM b WHERE hlc NOT IN (SELECT hlc FROM a) UNION ALL SELECT 'b', event_id, hlc FROM a WHERE hlc NOT IN (SELECT hlc FROM b)")
def reconcile_full(spark: SparkSession, d: str) -> DataFrame:
    a, b = _replicas(spark, d)
    diff = RC.reconcile(a, b)
    lacking = diff.missing_at_a.withColumn("lacking", F.lit("a")).unionByName(diff.missing_at_b.withColumn("lacking", F.lit("b")))
    return lacking.join(event_log(spark, d).select("event_id", "hlc"), "hlc").select("lacking", "event_id", "hlc")


@query("SELECT FALSE AS before, TRUE AS after FROM (SELECT 1)")
def replicas_equal(spark: SparkSession, d: str) -> DataFrame:
    a, b = (x.select("hlc") for x in _replicas(spark, d))
    before, after = RC.equal(a, b), RC.equal(S.merge(a, b, ["hlc"]), S.merge(b, a, ["hlc"]))
    return spark.range(1).select(F.lit(before).alias("before"), F.lit(after).alias("after"))


# ---- order statistics and fingerprints kept with a store


def _store(spark: SparkSession, log: DataFrame, segments: int) -> LogStore:
    """A store that got a log in as many batches, whose keys are spread over all of it."""
    store = LogStore(spark, scratch_path(spark, "store"))
    for i in range(segments):
        store.append(log.filter(F.col("event_id") % segments == i))
    return store


@query("SELECT event_id, pos::BIGINT AS pos FROM k WHERE pos >= 300 AND pos < 450")
def store_positional_slice(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, event_log(spark, d).select("event_id", "hlc"), 3).slice(300, 450).select("event_id", "pos")


@query(f"""SELECT o.event_id, count(x.hlc)::BIGINT AS n, {XOR} AS fp FROM (SELECT event_id, hlc AS lo, printf('%012x', millis + 3600000) || substr(hlc, 13) AS up FROM log WHERE event_id % 20 = 0) o
LEFT JOIN x ON x.hlc >= o.lo AND x.hlc < o.up GROUP BY o.event_id""")
def store_range_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """The fingerprint of the hour from every twentieth event on."""
    log = event_log(spark, d)
    upper = H.encode(F.col("millis") + 3_600_000, F.col("counter"), F.col("node"))
    asked = log.filter("event_id % 20 = 0").select("event_id", F.col("hlc").alias("lower"), upper.alias("upper"))
    return _store(spark, log.select("event_id", "hlc"), 2).fingerprints(asked).select("event_id", "n", "fp")


@query("SELECT a.event_id, o.hlc AS bound FROM a ASOF LEFT JOIN (SELECT hlc FROM b WHERE event_id % 5 = 0) o ON a.hlc >= o.hlc")
def many_bound_join(spark: SparkSession, d: str) -> DataFrame:
    a, b = _replicas(spark, d)
    return R.place(a.select("event_id", "hlc"), b.filter("event_id % 5 = 0").select("hlc")).select("event_id", "bound")


@query("SELECT 'a' AS lacking, hlc FROM b WHERE hlc NOT IN (SELECT hlc FROM a) UNION ALL SELECT 'b', hlc FROM a WHERE hlc NOT IN (SELECT hlc FROM b)")
def reconcile_descent(spark: SparkSession, d: str) -> DataFrame:
    a, b = (_store(spark, x.select("event_id", "hlc"), 1) for x in _replicas(spark, d))
    return DE.descend(a, b).found


@query("SELECT TRUE AS bounded, (SELECT count(*) FROM a WHERE hlc NOT IN (SELECT hlc FROM b)) + (SELECT count(*) FROM b WHERE hlc NOT IN (SELECT hlc FROM a)) AS found FROM (SELECT 1)")
def reconcile_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Whether every round of a descent kept to its budget, of a quarter of the usual ranges, and how many differences were found."""
    a, b = (_store(spark, x.select("event_id", "hlc"), 1) for x in _replicas(spark, d))
    out = DE.descend(a, b, DE.RANGES // 4, DE.KEYS // 4)
    bounded = all(max(r.opened, r.listed) <= DE.RANGES // 4 and r.compared <= DE.RANGES // 4 * DE.WIDTH and r.keys <= DE.KEYS // 4 for r in out.rounds)
    return out.found.agg(F.count(F.lit(1)).alias("found")).select(F.lit(bounded and out.done).alias("bounded"), "found")


# ---- encodings


@query("""SELECT event_id, CASE WHEN n <= 1 THEN n ELSE (n + (1::BIGINT << z) - 1) & ~((1::BIGINT << z) - 1) END AS padded FROM (
  SELECT event_id, n, CASE WHEN n <= 1 THEN 0 ELSE greatest(0, length(bin(n)) - 1 - length(bin((length(bin(n)) - 1)::BIGINT))) END::INTEGER AS z FROM (SELECT event_id, event_id * 37 % 1048577 AS n FROM log))""")
def padme_lengths(spark: SparkSession, d: str) -> DataFrame:
    return event_log(spark, d).withColumn("n", F.expr("event_id * 37 % 1048577")).select("event_id", E.padme_length("n").alias("padded"))


@query("SELECT event_id, replace(replace(rtrim(to_base64(unhex(hlc)), '='), '+', '-'), '/', '_') AS id, hlc AS back FROM log")
def base64url_ids(spark: SparkSession, d: str) -> DataFrame:
    log = event_log(spark, d).withColumn("id", E.base64url(H.to_bytes("hlc")))
    return log.select("event_id", "id", F.lower(F.hex(E.from_base64url(F.col("id")))).alias("back"))


@query("SELECT event_id, ((event_id % 2 = 0)::INT + (event_id % 3 = 0)::INT * 2 + (event_id % 5 = 0)::INT * 4)::BIGINT AS bits, event_id % 3 = 0 AS second FROM log")
def flag_bits(spark: SparkSession, d: str) -> DataFrame:
    log = event_log(spark, d)
    bits = E.flag_bits(*[F.col("event_id") % m == 0 for m in (2, 3, 5)])
    return log.select("event_id", bits.alias("bits")).withColumn("second", E.flag("bits", 1))


@query("SELECT event_id, greatest(1, (length(bin(millis)) + 6) // 7)::BIGINT AS size FROM log")
def varint_size(spark: SparkSession, d: str) -> DataFrame:
    return event_log(spark, d).select("event_id", E.varint_size("millis").alias("size"))


@query("""SELECT event_id, array_to_string([printf('%02x', ((millis >> (7 * i)) & 127) + CASE WHEN i < greatest(1, (length(bin(millis)) + 6) // 7) - 1 THEN 128 ELSE 0 END) for i in range(greatest(1, (length(bin(millis)) + 6) // 7))], '') AS bytes FROM log""")
def varint_bytes(spark: SparkSession, d: str) -> DataFrame:
    return event_log(spark, d).select("event_id", E.varint_hex("millis").alias("bytes"))


@query("SELECT event_id, millis, TRUE AS whole FROM log")
def varint_read(spark: SparkSession, d: str) -> DataFrame:
    """Two numbers written one after the other and read again; without its last byte the second is none."""
    log = event_log(spark, d).select("event_id", F.concat(E.varint_hex("event_id"), E.varint_hex("millis")).alias("data"))
    log = log.withColumn("first", E.varint_at("data")).withColumn("second", E.varint_at("data", F.col("first.size")))
    short = E.varint_at(F.expr("left(data, length(data) - 2)"), F.col("first.size"))
    return log.select(F.col("first.value").alias("event_id"), F.col("second.value").alias("millis"), (short.isNull() & ((F.col("first.size") + F.col("second.size")) * 2 == F.length("data"))).alias("whole"))


def _mapped(df: DataFrame, schema: str, row: Callable[..., tuple]) -> DataFrame:
    """``row`` of each row. A function marked ``_batched`` has another beside it that does most rows of a batch at once."""
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
    fields = pa.schema([pa.field(n, kinds[t]) for n, t in (x.split(" ") for x in schema.split(", "))])

    def by_row(columns: list[pa.Array]) -> list[pa.Array]:
        out = [row(*r) for r in zip(*(c.to_pylist() for c in columns))]
        return [pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * len(fields), fields)]

    def whole(columns: list[pa.Array]) -> list[pa.Array]:
        done, out = row.many(*columns)
        rest = np.flatnonzero(~done)
        out = [c.cast(f.type) for c, f in zip(out, fields)]
        if not len(rest):
            return out
        others = by_row([B.taken(c, rest) for c in columns])
        return [B.in_order([(np.flatnonzero(done), c), (rest, o)]) for c, o in zip(out, others)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays((whole if b.num_rows and hasattr(row, "many") else by_row)(b.columns), schema=fields)

    return df.mapInArrow(run, schema)


@query("SELECT event_id, value FROM log")
def msgpack_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(event_log(spark, d).select("event_id", "value"), "event_id long, value double", lambda e, v: (e, W.Reader(W.number(v)).number()))


@query("SELECT node, hlc FROM log")
def timestamps_buffer_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    packed = event_log(spark, d).groupBy("node", F.expr("event_id div 4096").alias("part")).agg(F.sort_array(F.collect_list("hlc")).alias("h"))  # at most 4096 a list
    back = _mapped(packed.select("node", F.array_join("h", ",").alias("h")), "node string, h string", lambda n, h: (n, ",".join(t.hex() for t in W.Reader(W.timestamps([bytes.fromhex(x) for x in h.split(",")])).timestamps())))
    return back.select("node", F.explode(F.split("h", ",")).alias("hlc"))


KEY, NONCE = bytes(range(32)), bytes(24)


def _sealed(e: int, hlc: str, user: int, kind: str, v: float) -> tuple[int, str, bytes]:
    stamp = bytes.fromhex(hlc)
    change = W.Change("events", user.to_bytes(16, "big"), {kind: v, "user" if kind != "user" else "user_id": user}, True)
    return e, hlc, W.seal_change(change, stamp, KEY, stamp + bytes(8))


def _opened(e: int, hlc: str, data: bytes) -> tuple:
    try:
        c = W.unseal_change(data, bytes.fromhex(hlc), KEY)
    except W.WireError as x:
        return e, None, None, None, str(x)
    (kind, v), (_, user) = c.values.items()
    return e, user, kind, v, None


OPENED = "event_id long, user_id long, event_type string, value double, error string"
SENT = "sent_user long, sent_type string, sent_value double"


def _batched(many: Callable[..., tuple[np.ndarray, list[pa.Array]]]) -> Callable:
    """Marks a function of a row with its form for the columns of a batch. This gives which rows it has done, and the results of these; the others are done by row."""

    def mark(row: Callable) -> Callable:
        row.many = many
        return row

    return mark


def _all_sent(*columns: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    stamp, done = B.stamps(columns[1])
    mine = pc.and_(pc.greater_equal(columns[2], 0), pc.not_equal(columns[3], "user"))
    done &= pc.fill_null(mine, False).to_numpy(zero_copy_only=False)
    e, hlc, user, kind, v = (B.taken(c, np.flatnonzero(done)) for c in columns)
    if not len(e):
        return done, [e, hlc, pa.array([], pa.binary()), user, kind, v]
    stamp, eight = stamp[done], np.zeros((len(e), 8), np.uint8)
    ids = np.concatenate([eight, user.to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8)], 1)
    plain = B.plain_inserts("events", stamp, ids, [(kind, B.numbers(v)), ("user", B.integers(user))])
    return done, [e, hlc, B.seal_changes(plain, KEY, np.concatenate([stamp, eight], 1)), user, kind, v]


def _all_back(e: pa.Array, hlc: pa.Array, data: pa.Array, *sent: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    (stamp, good), done = B.stamps(hlc), np.zeros(len(e), bool)
    parts: list[tuple[np.ndarray, list[pa.Array]]] = []
    for at, nonces, sealed in B.sealed_parts(data):
        plain, right = B.unseal(KEY, nonces, sealed)
        fault = ~right | (plain[:, 1:17] != stamp[at]).any(1)
        r = B.Readers(plain)
        r.odd |= plain[:, 0] > 127
        r.skip(18)  # version, timestamp and flags
        r.string()
        r.skip(16)
        r.odd |= r.varint() != 2
        kind, (v, null), name, user = r.string(), r.number(), r.string(), r.integer()
        r.odd |= ~r.texts_are(*name, b"user")
        ok = good[at] & (fault | ~r.odd)
        try:
            kinds = r.texts(kind[0], np.where(fault | r.odd, 0, kind[1])).cast(pa.string())
        except pa.ArrowInvalid:  # not UTF-8 somewhere
            continue
        done[at[ok]], bad = True, pa.array(fault)
        error = pc.if_else(bad, pc.if_else(pa.array(right), "TimestampMismatch", "DecryptFailed"), pa.scalar(None, pa.string()))
        columns = [pa.array(user, mask=fault), pc.if_else(bad, pa.scalar(None, pa.string()), kinds), pa.array(v, mask=fault | null), error]
        parts.append((at[ok], [B.taken(c, np.flatnonzero(ok)) for c in columns]))
    mine = np.flatnonzero(done)
    opened = [B.in_order([(at, columns[i]) for at, columns in parts]) if parts else pa.nulls(0) for i in range(4)]
    return done, [B.taken(e, mine), *opened, *(B.taken(c, mine) for c in sent)]


@_batched(_all_sent)
def _sent(e: int, hlc: str, user: int, kind: str, v: float) -> tuple:
    return *_sealed(e, hlc, user, kind, v), user, kind, v


@_batched(_all_back)
def _back(e: int, hlc: str, data: bytes, *sent: object) -> tuple:
    return *_opened(e, hlc, data), *sent


def _codec(log: DataFrame, stamp: Column) -> DataFrame:
    """Every row of ``log`` sealed, then opened under ``stamp``, beside what was sent. The cipher takes most of the time, so rows are dealt to all cores first."""
    log = log.select("event_id", "hlc", "user_id", "event_type", "value").repartition(log.sparkSession.sparkContext.defaultParallelism, "event_id")
    sealed = _mapped(log, f"event_id long, hlc string, data binary, {SENT}", _sent)
    return _mapped(sealed.withColumn("hlc", stamp), f"{OPENED}, {SENT}", _back)


@query("SELECT event_id, user_id, event_type, value, NULL::VARCHAR AS error FROM log")
def change_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return _codec(event_log(spark, d), F.col("hlc")).select("event_id", "user_id", "event_type", "value", "error")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'TimestampMismatch' END AS error FROM log")
def tamper_check(spark: SparkSession, d: str) -> DataFrame:
    """Every third change is opened under another timestamp than it was sealed with."""
    moved = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("00"), F.substring("hlc", 3, 30))).otherwise(F.col("hlc"))
    return _codec(event_log(spark, d), moved).select("event_id", "error")


@query("SELECT node, count(*)::BIGINT AS changes, count(*)::BIGINT AS listed FROM log GROUP BY node")
def message_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    packed = event_log(spark, d).groupBy("node", F.expr("event_id div 4096").alias("part")).agg(F.array_join(F.sort_array(F.collect_list("hlc")), ",").alias("h"))  # at most 4096 a message

    def there_and_back(node: str, h: str) -> tuple:
        stamps = [bytes.fromhex(x) for x in h.split(",")]
        m = W.Message(bytes(8) + bytes.fromhex(node), changes=[(t, t[8:]) for t in stamps], ranges=[W.Range(W.SKIP, stamps[0]), W.Range(W.TIMESTAMPS, None, None, stamps)])
        back = W.read_message(W.message(m))
        assert back.owner[8:].hex() == node and all(c == t[8:] for t, c in back.changes)
        return node, len(back.changes), len(back.ranges[1].stamps)

    out = _mapped(packed.select("node", "h"), "node string, changes long, listed long", there_and_back)
    return out.groupBy("node").agg(F.sum("changes").alias("changes"), F.sum("listed").alias("listed"))


@query("SELECT event_id, hlc, event_type FROM log")
def flat_file_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    parts = event_log(spark, d).select(F.expr("event_id div 4096").alias("part"), "event_id", "hlc", "event_type").groupBy("part").agg(F.to_json(F.collect_list(F.struct("event_id", "hlc", "event_type"))).alias("j"))  # at most 4096 a file
    import json

    def save(part: int, j: str) -> tuple:
        return part, W.flat_file([(bytes.fromhex(r["hlc"]), f"{r['event_id']}:{r['event_type']}".encode()) for r in json.loads(j)])

    def load(part: int, data: bytes) -> tuple:
        return part, json.dumps([{"hlc": t.hex(), "p": p.decode()} for t, p in W.read_flat_file(data)])

    back = _mapped(_mapped(parts, "part long, data binary", save), "part long, j string", load)
    rows = back.select(F.explode(F.from_json("j", "array<struct<hlc:string,p:string>>")).alias("r"))
    return rows.select(F.split("r.p", ":")[0].cast("long").alias("event_id"), "r.hlc", F.split("r.p", ":")[1].alias("event_type"))


@query()
def owner_keys(spark: SparkSession, d: str) -> DataFrame:
    keys = W.owner_keys(bytes.fromhex("0660cc198330660cc198330660cc1983"), "Ledger")  # a few keys, derived on the driver
    shard = W.shard_keys(keys, ["shard", "1"], "Ledger")
    return spark.createDataFrame([(n, k.id.hex(), len(k.encryption_key), k.write_key.hex()) for n, k in (("owner", keys), ("shard", shard))], "name string, id string, key_bytes long, write_key string")


# ---- store and streams


@query("SELECT event_id, hlc FROM log WHERE event_id % 10 <> 0 OR event_id % 7 <> 0")
def store_append_idempotent(spark: SparkSession, d: str) -> DataFrame:
    a, b = (x.select("event_id", "hlc") for x in _replicas(spark, d))
    store = LogStore(spark, scratch_path(spark, "store"))
    for batch in (a, b, a):
        store.append(batch)
    store.compact()
    store.verify()
    return store.read()


@query("SELECT 3::BIGINT AS version, TRUE AS replayed, TRUE AS advanced FROM (SELECT 1)")
def store_replay_detect(spark: SparkSession, d: str) -> DataFrame:
    log = event_log(spark, d).select("event_id", "hlc")
    store = LogStore(spark, scratch_path(spark, "store"))
    for i in range(3):
        store.append(log.filter(F.col("event_id") % 3 == i))
    replayed = False
    try:
        store.manifest(trusted=5)
    except ReplayError:
        replayed = True
    m = store.manifest(trusted=2)
    return spark.range(1).select(F.lit(m.version).cast("long").alias("version"), F.lit(replayed).alias("replayed"), F.lit(m.version == 3).alias("advanced"))


@query("SELECT event_id, hlc FROM log WHERE event_id % 10 <> 0 OR event_id % 7 <> 0")
def bucketed_merge(spark: SparkSession, d: str) -> DataFrame:
    a, b = (x.select("event_id", "hlc") for x in _replicas(spark, d))
    log = BucketedLog(spark, scratch_path(spark, "bucketed"), a.schema)
    for batch in (a, b, a):
        log.merge(batch)
    return log.read()


@query("SELECT event_id, hlc, pos >= 100 AS resumed FROM k")
def store_cursor(spark: SparkSession, d: str) -> DataFrame:
    """A cursor is left after a hundred rows, and another goes on after the last key."""
    store = _store(spark, event_log(spark, d).select("event_id", "hlc"), 2)
    first = list(islice(store.cursor(), 100))
    rest = store.scan(after=first[-1]["hlc"] if first else None)
    return spark.createDataFrame(first, rest.schema).withColumn("resumed", F.lit(False)).unionByName(rest.withColumn("resumed", F.lit(True)))


def _landing(spark: SparkSession, rows: DataFrame, files: int) -> DataFrame:
    path = scratch_path(spark, "landing")
    rows.repartition(files).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(f"SELECT event_id, hlc FROM log WHERE millis - {NOW} <= 300000")
def stream_merge(spark: SparkSession, d: str) -> DataFrame:
    log = event_log(spark, d).select("event_id", "hlc", "millis", "counter", F.expr(NOW).alias("now"))
    stream = _landing(spark, log.unionByName(log.filter("event_id % 5 = 0")), 3)
    store = LogStore(spark, scratch_path(spark, "store"))
    I.merge_stream(stream, store, scratch_path(spark, "checkpoint"), "now").awaitTermination()
    return store.read().select("event_id", "hlc")


def _fed(spark: SparkSession, d: str, each: Callable[[DataFrame, str], object]) -> None:
    """A store gets a log in three batches; after each, ``each`` runs a stream of its changes from the same checkpoint, so it is started anew every time."""
    log = event_log(spark, d).select("event_id", "hlc")
    source, checkpoint = LogStore(spark, scratch_path(spark, "store")), scratch_path(spark, "checkpoint")
    for i in range(3):
        source.append(log.filter(F.col("event_id") % 3 == i))
        each(FE.feed(source, log.schema), checkpoint).awaitTermination()


@query("SELECT event_id, hlc FROM log")
def stream_feed_merge(spark: SparkSession, d: str) -> DataFrame:
    store = LogStore(spark, scratch_path(spark, "store"))
    _fed(spark, d, lambda stream, checkpoint: I.merge_stream(stream, store, checkpoint))
    return store.read().select("event_id", "hlc")


@query(f"SELECT event_id, hlc, (SELECT count(*) FROM log)::BIGINT AS n, (SELECT {XOR} FROM x) AS fp FROM log")
def stream_sink(spark: SparkSession, d: str) -> DataFrame:
    store = LogStore(spark, scratch_path(spark, "store"))
    _fed(spark, d, lambda stream, checkpoint: FE.into(stream, store, "copy", checkpoint))
    m = store.manifest()
    return store.read().select("event_id", "hlc", F.lit(m.n_rows).cast("long").alias("n"), F.lit(m.fp).alias("fp"))


def _landings(spark: SparkSession, rows: DataFrame, batch: Column, batches: int) -> DataFrame:
    """A stream of ``rows`` in as many micro-batches, by the number ``batch``."""
    path = scratch_path(spark, "landing")
    for i in range(batches):
        rows.filter(batch == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query()
def stream_hlc_state(spark: SparkSession, d: str) -> DataFrame:
    events = _clock_events(spark, d)
    top = events.agg(F.max("seq")).first()[0] or 0
    stream = _landings(spark, events, F.expr(f"least(seq * 4 div {top + 1}, 3)"), 4)
    out, before = scratch_path(spark, "clocks"), spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", I.ROCKSDB)
    try:
        q = I.clock_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "checkpoint")).trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    q.awaitTermination()
    return spark.read.schema(I.CLOCK).parquet(out)


def _thirds(spark: SparkSession, d: str, late: bool) -> tuple[DataFrame, DataFrame]:
    """The log, and a stream of it in thirds of its time; with ``late`` every 50th event comes with the last."""
    log = event_log(spark, d).select("event_id", "node", "millis", "hlc")
    lo, hi = log.agg(F.min("millis"), F.max("millis")).first()
    batch = F.expr(f"CASE WHEN {late} AND event_id % 50 = 0 THEN 2 ELSE least((millis - {lo}) * 3 div ({hi} - {lo} + 1), 2) END")
    return log, _landings(spark, log, batch, 3)


def _windows(spark: SparkSession, d: str, width: str, slide: str | None, per_row: int) -> DataFrame:
    log, stream = _thirds(spark, d, True)
    checkpoint = scratch_path(spark, "checkpoint")
    closed = WI.run(WI.windowed(stream, F.window("at", width, slide), "1 hour"), scratch_path(spark, "windows"), checkpoint)
    return closed.withColumn("late", F.lit(WI.late(log.count() * per_row, closed, WI.still_open(spark, checkpoint))).cast("long"))


#: A watermark is an hour behind the latest event of the batches before; a batch leaves out what the one before has closed.
WINDOWS = """, t AS (SELECT x.*, CASE WHEN event_id % 50 = 0 THEN 2 ELSE least((millis - lo) * 3 // (hi - lo + 1), 2) END AS batch, hi FROM x, (SELECT min(millis) AS lo, max(millis) AS hi FROM log)),
w AS (SELECT t.*, millis - millis % {slide} - i * {slide} AS begin, millis - millis % {slide} - i * {slide} + {width} AS finish FROM t, range({width} // {slide}) r(i)),
l AS (SELECT *, batch = 2 AND finish <= (SELECT max(millis) - 3600000 FROM t WHERE batch = 0) AS late FROM w)
SELECT begin, finish, count(*)::BIGINT AS n, {xor} AS fp, (SELECT count(*) FROM l WHERE late)::BIGINT AS late FROM l WHERE NOT late AND finish <= hi - 3600000 GROUP BY begin, finish"""


@query(WINDOWS.format(slide=6 * 3_600_000, width=6 * 3_600_000, xor=XOR))
def stream_tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d, "6 hours", None, 1)


@query(WINDOWS.format(slide=3 * 3_600_000, width=12 * 3_600_000, xor=XOR))
def stream_sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d, "12 hours", "3 hours", 4)


@query(f"""SELECT node, min(millis) AS begin, max(millis) + 7200000 AS finish, count(*)::BIGINT AS n, {XOR} AS fp FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY node ORDER BY millis, event_id) AS run FROM (
    SELECT *, CASE WHEN millis - lag(millis) OVER (PARTITION BY node ORDER BY millis, event_id) < 7200000 THEN 0 ELSE 1 END AS fresh FROM x))
GROUP BY node, run HAVING max(millis) + 7200000 <= (SELECT max(millis) FROM log) - 3600000""")
def stream_session_windows(spark: SparkSession, d: str) -> DataFrame:
    _, stream = _thirds(spark, d, False)
    return WI.run(WI.windowed(stream, WI.session(7_200_000), "1 hour", ["node"]), scratch_path(spark, "windows"), scratch_path(spark, "checkpoint"))


@query("SELECT count(*)::BIGINT AS messages, count(DISTINCT node)::BIGINT AS nodes FROM log")
def message_counters(spark: SparkSession, d: str) -> DataFrame:
    return event_log(spark, d).agg(F.count(F.lit(1)).alias("messages"), F.countDistinct("node").alias("nodes"))


for _name in ("hlc_fold", "stream_hlc_state"):
    ORACLES[_name] = f"WITH RECURSIVE {LOG}, {FOLD}"
