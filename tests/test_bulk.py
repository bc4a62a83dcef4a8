"""The codec over batches writes and reads what the codec of rows does, and is what the queries run."""

import os
import random
import time
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest

from tidelog.functions import bulk as B
from tidelog.functions import wire as W
from tidelog.plans import queries as Q
from tidelog.sources.log import scratch_path

VALUES = [None, 0.0, -0.0, 1.0, 19.0, 20.0, 127.0, 128.0, 255.0, 256.0, 65535.0, 65536.0, 2.0**31, 2.0**32 - 1, 2.0**32, 2.0**53, -1.0, -32.0, -33.0, -128.0, -129.0, -32768.0, -32769.0, -(2.0**31), -(2.0**31) - 1, 1e300, float("inf"), -1.5]
USERS = [0, 19, 20, 127, 128, 16383, 16384, 1 << 31, W.MAX_INT]
KINDS = ["click", "user", "größe", "", "x" * 127, "y" * 128, "z" * 400]


def rows(n):
    rnd = random.Random(5)
    users = USERS + [rnd.randrange(90_000) for _ in range(n - len(USERS))]
    return [(i, f"{1_704_067_200_000 + 7 * i:012x}{i % 65536:04x}{u:016x}", u, rnd.choice(KINDS), VALUES[i] if i < len(VALUES) else round(rnd.random() * 200, 2)) for i, u in enumerate(users)]


def columns(table, kinds):
    return [pa.array(c, k) for c, k in zip(zip(*table), kinds)]


SENT = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.float64()]
SEALED = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.float64()]


def together(many, row, table, kinds):
    """What ``many`` has done, checked against ``row``; and all rows by ``row``."""
    done, out = many(*columns(table, kinds))
    want = [row(*r) for r in table]
    assert list(zip(*(c.to_pylist() for c in out))) == [w for w, d in zip(want, done) if d]
    return done, want


@pytest.mark.parametrize("size", [35, 63, 64, 65, 80, 300])
def test_seal_equals_that_of_a_row(size):
    key, rnd = bytes(range(32)), np.random.default_rng(size)
    nonces, plain = rnd.integers(0, 256, (9, 24), np.uint8), rnd.integers(0, 256, (9, size), np.uint8)
    sealed = B.seal(key, nonces, plain)
    assert [s.tobytes() for s in sealed] == [W.seal(key, n.tobytes(), p.tobytes()) for n, p in zip(nonces, plain)]
    sealed[3, 1] ^= 1
    back, right = B.unseal(key, nonces, sealed)
    assert right.tolist() == [i != 3 for i in range(9)] and (np.delete(back, 3, 0) == np.delete(plain, 3, 0)).all()


@pytest.mark.parametrize("key", [b"\xff" * 32, bytes(32), b"\2" + bytes(15) + b"\xff" * 16])
@pytest.mark.parametrize("message", [b"\xff" * 32, b"\xfb" + b"\xff" * 15 + bytes(16), b"\xfe" * 48, bytes(16)])
def test_tags_at_the_edge_of_the_prime(key, message):
    each = lambda b: np.frombuffer(b, np.uint8)[None]
    assert B.poly1305(each(key), each(message))[0].tobytes() == W.poly1305(key, message)


def test_batches_equal_rows():
    table = rows(300)
    done, sent = together(Q._sent.many, Q._sent, table, SENT)
    assert [r[3] != "user" for r in table] == done.tolist()
    moved = [(e, "00" + h[2:] if e % 3 == 0 else h, d[:-1] + bytes([d[-1] ^ 1]) if e % 7 == 0 else d, *s) for e, h, d, *s in sent]
    moved[4] = *moved[4][:2], moved[4][2][:60], *moved[4][3:]  # cut off
    moved[5] = *moved[5][:2], moved[5][2] + b"x", *moved[5][3:]  # with more behind it
    done, back = together(Q._back.many, Q._back, moved, SEALED)
    assert {r[4] for r in back} == {None, "TimestampMismatch", "DecryptFailed", "ends too early"}
    assert [i for i, d in enumerate(done) if not d and table[i][3] != "user"] == [4, 5]
    assert all(r[1:4] == t[2:] for r, t in zip(back, table) if r[4] is None)


def test_a_batch_is_not_done_row_by_row():
    """A row at a time took more than a millisecond."""
    table = [(i, f"{i:012x}{0:04x}{i:016x}", i, "click", i + 0.25) for i in range(5000)]
    start = time.process_time()
    done, sent = Q._sent.many(*columns(table, SENT))
    opened, back = Q._back.many(*sent)
    assert done.all() and opened.all() and back[1].to_pylist() == list(range(5000))
    assert time.process_time() - start < 1


def test_queries_open_batches(spark, monkeypatch):
    """Odd rows among others, and with a form of rows that fails where all are as usual."""
    start = datetime(2024, 1, 1)
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"

    def written(table):
        d = scratch_path(spark, "events")
        spark.createDataFrame([(e, start + timedelta(seconds=e), u, k, v, None) for e, _, u, k, v in table], schema).write.parquet(f"{d}/events.parquet")
        return d

    table = rows(200)
    run = lambda name, d: sorted((tuple(r) for r in Q.QUERIES[name](spark, d).collect()), key=lambda r: r[0])
    assert run("change_roundtrip", written(table)) == [(e, u, k, v, None) for e, _, u, k, v in table]

    def fails(*row):
        raise AssertionError(os.getpid())

    fails.many = Q._back.many
    monkeypatch.setattr(Q, "_back", fails)
    table = [r for r in table if r[3] != "user"]
    assert run("change_roundtrip", written(table)) == [(e, u, k, v, None) for e, _, u, k, v in table]
