import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions import encodings as E
from tidelog.functions import fingerprint as FP
from tidelog.functions import hlc as H
from tidelog.functions import wire as W
from tidelog.operators import lww as L
from tidelog.operators import ranges as R
from tidelog.operators import reconcile as RC
from tidelog.operators import sets as S
from tidelog.sources.log import scratch_path
from tidelog.sources.store import CorruptError, LogStore, Manifest, ReplayError
from tidelog.streaming import ingest as I

SF = "/root/testdata/sf0.001"


def log(spark, keys):
    return spark.createDataFrame([(f"{k:012x}{0:04x}{0:016x}", k) for k in keys], "hlc string, n long")


def test_ticks(spark):
    send = [((0, 0), 1, (1, 0, None)), ((0, 0), 0, (0, 1, None)), ((1, 0), 0, (1, 1, None)), ((0, 65535), 0, (None, None, "counter")), ((300001, 0), 0, (None, None, "drift"))]
    df = spark.createDataFrame([(i, m, c, now) for i, ((m, c), now, _) in enumerate(send)], "i int, m long, c long, now long")
    got = df.select("i", H.send(F.col("m"), F.col("c"), F.col("now")).alias("t")).orderBy("i").collect()
    assert [tuple(r["t"]) for r in got] == [w for *_, w in send]
    receive = [(1, (0, 0), (0, 0), (1, 0)), (1, (1, 0), (1, 1), (1, 2)), (0, (1, 1), (1, 0), (1, 2)), (0, (2, 0), (1, 0), (2, 1)), (0, (1, 0), (2, 0), (2, 1))]
    df = spark.createDataFrame([(i, now, *a, *b) for i, (now, a, b, _) in enumerate(receive)], "i int, now long, m long, c long, rm long, rc long")
    got = df.select("i", H.receive(*map(F.col, ("m", "c", "rm", "rc", "now"))).alias("t")).orderBy("i").collect()
    assert [tuple(r["t"])[:2] for r in got] == [w for *_, w in receive]


def test_hlc_forms(spark):
    r = spark.createDataFrame([("4febdfb5d0782bfa",), ("",), ("4FEBDFB5D0782BFA",), ("4febdfb5d0782bfa0",), (None,)], "t string").select(H.valid_node("t").alias("v")).collect()
    assert [x["v"] for x in r] == [True, False, False, False, False]
    r = spark.createDataFrame([("f" * 12 + "0001" + "0" * 16,)], "h string").select(*H.decode("h")).first()
    assert r["millis"] is None and r["counter"] == 1
    zero = spark.range(1).select(FP.key_fingerprint(F.lit("0" * 32)).alias("f")).first()["f"]
    assert zero == "374708fff7719dd5979ec875"


def test_encodings_agree_with_the_codec(spark):
    n = [0, 1, 2, 3, 9, 127, 128, 255, 16384, 10**6, 2**40, 2**53 - 1]
    rows = spark.createDataFrame([(x,) for x in n], "n long").select("n", E.varint_hex("n").alias("v"), E.varint_size("n").alias("s"), E.padme_length("n").alias("p")).collect()
    for r in rows:
        assert r["v"] == W.varint(r["n"]).hex() and r["s"] == len(W.varint(r["n"])) and r["p"] == W.padme(r["n"])
        assert rows and spark.range(1).select(E.varint_at(F.lit("ff" + r["v"] + "80"), 1).alias("x")).first()["x"] == (r["n"], r["s"])
    odd = spark.createDataFrame([("",), ("80",), ("ff" * 9,), ("ff" * 8 + "7f",), ("00",)], "h string").select(E.varint_at("h").alias("x")).collect()
    assert [x["x"] and tuple(x["x"]) for x in odd] == [None, None, None, (2**63 - 1, 9), (0, 1)]
    r = spark.range(1).select(*[E.base64url(F.unhex(F.lit(h))).alias(f"c{i}") for i, h in enumerate(("", "00", "0000", "000000", "ffffff", "4ad6ef7533f193cd33d1c355c03260ea"))]).first()
    assert list(r) == ["", "AA", "AAA", "AAAA", "____", "StbvdTPxk80z0cNVwDJg6g"]


def test_balanced_buckets(spark):
    assert R.boundaries(10, 3) == [4, 7, 10] and R.boundaries(35, 16)[:4] == [3, 6, 9, 11]
    for n, k in ((5, 3), (31, 16)):
        with pytest.raises(ValueError, match=str(2 * k)):
            R.boundaries(n, k)
    for n in (16, 35, 100, 1007):
        got = spark.range(n).select(F.col("id"), R.bucket_of(F.col("id"), n, 16).alias("b")).groupBy("b").count().orderBy("b").collect()
        ends, at = [], 0
        for r in got:
            at += r["count"]
            ends.append(at)
        assert ends == R.boundaries(n, 16, 1)


def test_positions_and_runs(spark):
    keys = random.Random(1).sample(range(1000), 200)
    got = {r["n"]: r["pos"] for r in R.with_position(log(spark, keys)).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}
    rows = spark.createDataFrame(list(enumerate("aabbbac")), "pos long, v string")
    assert [(r["value"], r["length"]) for r in R.run_lengths(rows, "v").orderBy("run").collect()] == [("a", 2), ("b", 3), ("a", 1), ("c", 1)]
    assert R.with_position(log(spark, [])).count() == 0
    s = R.range_rows(log(spark, [])).first()
    assert s["kind"] == "timestamps" and s["timestamps"] == []


def test_fingerprints_combine(spark):
    f = lambda keys: FP.with_lanes(log(spark, keys)).agg(*FP.xor()).select(FP.text().alias("f")).first()["f"]
    x = lambda a, b: f"{int(a, 16) ^ int(b, 16):024x}"
    assert f([]) == "0" * 24 and x(f([1, 2]), f([3, 4, 5])) == f([5, 4, 3, 2, 1])


def test_last_writer_wins(spark):
    rows = [("r", "a", "1", 1), ("r", "a", None, 3), ("r", "a", "2", 2), ("r", "b", "x", 1)]
    df = spark.createDataFrame(rows, "id string, col string, value string, hlc long")
    won = {r["col"]: (r["value"], r["hlc"]) for r in L.cells(df, ["id", "col"]).collect()}
    assert won == {"a": (None, 3), "b": ("x", 1)}
    again = L.merge_cells(L.cells(df.filter("hlc < 3"), ["id", "col"]), df, ["id", "col"])
    assert {r["col"]: (r["value"], r["hlc"]) for r in again.collect()} == won
    r = spark.createDataFrame([(None, 1), (1, 2), (2, 1), (1, 1)], "c long, i long").select(L.accepts(F.col("c"), F.col("i")).alias("a")).collect()
    assert [x["a"] for x in r] == [True, True, False, False]


def test_delete_and_undelete(spark):
    rows = [(1, "a", 10, True, None), (2, "a", 20, False, True), (3, "b", 10, True, None), (4, "b", 20, False, True), (5, "b", 30, False, False)]
    df = spark.createDataFrame(rows, "hlc long, id string, millis long, is_insert boolean, is_delete boolean").withColumn("values", F.create_map(F.lit("t"), F.lit("v")))
    cols = L.change_columns(df)
    assert [r["column"] for r in cols.filter("hlc = 2").orderBy("position").collect()] == ["updatedAt", "isDeleted", "t"]
    won = L.cells(cols, ["id", "column"])
    assert [r["id"] for r in L.live_rows(won, ["id"]).collect()] == ["b"]


@pytest.mark.parametrize("a,b", [(range(0), range(0)), (range(5), range(0)), (range(200), range(100, 300)), (range(400), [*range(200), *range(201, 400)]), (range(50), range(50))])
def test_reconciliation(spark, a, b):
    a, b = set(a), set(b)
    diff = RC.reconcile(log(spark, a), log(spark, b), k=4, listed=8)
    keys = lambda df: {int(r["hlc"][:12], 16) for r in df.collect()}
    assert keys(diff.missing_at_a) == b - a and keys(diff.missing_at_b) == a - b
    assert RC.equal(log(spark, a), log(spark, b)) == (a == b)
    merged = S.merge(log(spark, a), log(spark, b), ["hlc"])
    assert RC.equal(merged, log(spark, a | b))


def test_store(spark):
    store = LogStore(spark, scratch_path(spark, "t"))
    assert store.read() is None and store.size() == 0 and store.append(log(spark, [])) == 0
    assert store.append(log(spark, [3, 1, 2, 1])) == 3
    assert store.append(log(spark, [1, 2])) == 0 and store.manifest().version == 1
    assert store.append(log(spark, [2, 9]).withColumn("n", F.lit(-1).cast("long"))) == 1
    assert {r["n"] for r in store.read().collect()} == {1, 2, 3, -1}
    store.verify()
    assert store.read(1).count() == 3
    with pytest.raises(ReplayError):
        store.manifest(trusted=9)
    with pytest.raises(ReplayError):
        store.commit(Manifest(2, 0, "0" * 24, []))
    assert store.manifest(trusted=1).version == 2
    store.compact()
    store.verify()
    assert len(store.manifest().segments) == 1 and store.point(f"{9:012x}" + "0" * 20).count() == 1
    store.commit(Manifest(4, 99, "0" * 24, store.manifest().segments))
    with pytest.raises(CorruptError):
        store.verify()


def test_a_run_lost_between_segment_and_manifest_leaves_no_trace(spark):
    store = LogStore(spark, scratch_path(spark, "t"))
    store.append(log(spark, [1, 2]))
    commit, store.commit = store.commit, lambda m: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        store.append(log(spark, [3]))
    store.commit = commit
    assert store.read().count() == 2 and store.append(log(spark, [3])) == 1 and store.read().count() == 3


def test_clock_fold_is_the_stepwise_clock(spark):
    rnd = random.Random(3)
    rows, want = [], {}
    for node in ("a", "b", "c", None):
        ms, c, now = 0, 0, 1000
        for seq in range(150):
            now += rnd.choice([0, 0, 1, 5, -3, -40, 0 if seq % 50 else 500000])
            remote = rnd.choice([None, (now + rnd.choice([-5, 0, 0, 2, 400000]), rnd.choice([rnd.randint(0, 9), 65535, 65533]))])
            rows.append((node, seq, now, *(remote or (None, None))))
            ms, c, error = I.step(ms, c, now, remote)
            want[node, seq] = (None, None, error) if error else (ms, c, None)
    assert {x[2] for x in want.values()} == {None, "drift", "counter"}
    df = spark.createDataFrame(rows, "node string, seq long, now long, remote_millis long, remote_counter long")
    for block in (None, 16):
        got = {(r["node"], r["seq"]): (r["millis"], r["counter"], r["error"]) for r in I.fold(df, block=block).collect()}
        assert got == want


def test_rejected_changes_of_a_hot_cell_in_blocks(spark):
    rnd = random.Random(5)
    rows = [(a, rnd.choice([None, 1, 1, 1, 2]), f"{rnd.randint(0, 400):04d}") for a in range(-50, 300)]
    want, top = set(), {}
    for a, cell, at in rows:
        if cell in top and top[cell] >= at:
            want.add(a)
        top[cell] = max(top.get(cell, ""), at)
    df = spark.createDataFrame(rows, "arrival long, cell long, hlc string")
    for block in (None, 1, 16):
        assert sorted(r["arrival"] for r in L.rejected(df, ["cell"], "arrival", block=block).collect()) == sorted(want)
    assert L.rejected(df.limit(0), ["cell"], "arrival").count() == 0


def test_stream_is_batch(spark):
    from tidelog.plans.queries import QUERIES

    a, b = (sorted(map(str, QUERIES[q](spark, SF).select("node", "seq", "millis", "counter", "error").collect())) for q in ("hlc_fold", "stream_hlc_state"))
    assert a == b and len(a) == 1000


def test_plans_scan_only_what_they_need(spark):
    from tidelog.plans.queries import QUERIES

    plan = QUERIES["lww_cells"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "partial_max_by" in plan


def test_a_clock_that_stands_still_is_many_windows(spark, monkeypatch):
    n, sizes = 400, []
    rows = [("a", i * 1000, 1000, *((1000, i % 50) if i % 3 == 0 else (None, None))) for i in range(n)] + [("b", 1, 5, None, None)]
    df = spark.createDataFrame(rows, "node string, seq long, now long, remote_millis long, remote_counter long")
    real = R.blocks
    monkeypatch.setattr(R, "blocks", lambda rows, by, order, block: sizes.append(real(rows, by, order, block).groupBy(*by, "_k").count().agg(F.max("count")).first()[0]) or real(rows, by, order, block))
    got = {(r["node"], r["seq"]): (r["millis"], r["counter"]) for r in I.fold(df, block=32).collect()}
    ms, c, want = 0, 0, {}
    for node, seq, now, rm, rc in rows[:-1]:
        ms, c, _ = I.step(ms, c, now, None if rm is None else (rm, rc))
        want[node, seq] = ms, c
    assert got == want | {("b", 1): (5, 0)}
    assert len(sizes) == 2 and max(sizes) <= 32  # the node's clock, and the run of its one millisecond


def test_arrivals_that_lie_far_apart_are_blocks_too(spark, monkeypatch):
    rnd, sizes = random.Random(6), []
    rows = [(rnd.randrange(1 << 60), f"{rnd.randint(0, 400):04d}") for _ in range(300)]
    real = R.blocks
    monkeypatch.setattr(R, "blocks", lambda rows, by, order, block: sizes.append(real(rows, by, order, block).groupBy("_k").count().agg(F.max("count")).first()[0]) or real(rows, by, order, block))
    df = spark.createDataFrame(rows, "arrival long, hlc string").withColumn("cell", F.lit(1))
    top, want = "", []
    for a, at in sorted(rows):
        want += [a] if top >= at else []
        top = max(top, at)
    assert sorted(r["arrival"] for r in L.rejected(df, ["cell"], "arrival", block=25).collect()) == want and sizes == [25]
