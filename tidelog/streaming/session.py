"""A sync session over a transport: ranges and changes as wire messages, the log's side of each round as Spark jobs."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fingerprint as FP
from ..functions import wire as W
from ..operators import ranges as R
from ..operators import sets as S
from ..sources.store import CorruptError, LogStore, ReplayError

#: Changes of one message. What is more goes ahead in messages of changes alone.
PER_MESSAGE = 10_000
#: Ranges of one message at most. What is beyond is one fingerprint, looked into in later rounds. A fixed value.
RANGES = 32


class State(Enum):
    """``UNFINISHED``: the rounds allowed, or the time, ran out with ranges still open."""

    IDLE, WAITING, SYNCED, ERROR, UNFINISHED = "idle", "waiting", "synced", "error", "unfinished"


class QueueTransport:
    """One end of a pair of in-memory queues, first in first out; for tests, and the shape of what a socket transport has.

    With ``hold`` what is sent stays on its way until it is delivered, one message or all, or taken back with ``drain_sent``.
    """

    def __init__(self, hold: bool = False) -> None:
        self.hold, self.on_the_way = hold, deque()
        self.inbox: deque[bytes] = deque()
        self.peer: QueueTransport | None = None
        self.sent: list[bytes] = []

    @classmethod
    def pair(cls, hold: bool = False) -> tuple[QueueTransport, QueueTransport]:
        a, b = cls(hold), cls(hold)
        a.peer, b.peer = b, a
        return a, b

    @property
    def connected(self) -> bool:
        return self.peer is not None

    def send(self, data: bytes) -> None:
        if not self.peer:
            raise ConnectionError("not connected")
        self.sent.append(data)
        (self.on_the_way if self.hold else self.peer.inbox).append(data)

    def deliver_one(self) -> bool:
        if not self.on_the_way or not self.peer:
            return False
        self.peer.inbox.append(self.on_the_way.popleft())
        return True

    def deliver_pending(self) -> int:
        n = 0
        while self.deliver_one():
            n += 1
        return n

    def drain_sent(self) -> list[bytes]:
        """What is on its way, which then never arrives."""
        out = list(self.on_the_way)
        self.on_the_way.clear()
        return out

    def inject(self, data: bytes) -> None:
        self.inbox.append(data)

    def pending(self) -> int:
        return len(self.inbox)

    def receive(self) -> bytes | None:
        return self.inbox.popleft() if self.inbox else None

    def disconnect(self) -> None:
        if self.peer:
            self.peer.peer = None
        self.peer = None


def summarise(log: DataFrame, key: str = "hlc") -> list[W.Range]:
    """The ranges that a session starts with: at most ``R.BUCKETS``, or a listing of fewer than ``R.LISTED`` keys."""
    rows = R.range_rows(log, key).orderBy("range_idx").collect()
    return [_range(r["kind"], r["upper"], r["fp"], r["timestamps"]) for r in rows]


def _range(kind: str, upper: str | None, fp: str | None, stamps: list[str] | None) -> W.Range:
    up = bytes.fromhex(upper) if upper else None
    if kind == "timestamps":
        return W.Range(W.TIMESTAMPS, up, None, [bytes.fromhex(t) for t in stamps or []])
    return W.Range(W.FINGERPRINT, up, bytes.fromhex(fp))


def respond(log: DataFrame, ranges: list[W.Range], key: str = "hlc") -> tuple[list[W.Range], DataFrame]:
    """Our ranges in answer to a peer's, and the keys that the peer lacks of the ranges it listed.

    A range is half open, from the bound before it to its own. Equal fingerprints are skipped; of an unequal range we list our keys when
    they are few, else we split it. A listing is skipped if it has no key that we lack; else it is answered with our keys, when they
    are few, or with fingerprints of the range split (a short listing may be of a range in which we have very many). The log is read once
    for all fingerprints, once for all listings and once for all splits.

    An answer has at most ``RANGES`` ranges (neighbours that are skipped are one, where that is needed). Unequal ranges are split as far as there is room;
    the others are left as our fingerprint, for the rounds to come. Where there is no room for even one split, the last ranges become one. A peer's message
    may not have more either. So what is collected is bounded: a row a range, ``R.BUCKETS`` rows a split one, fewer than ``R.LISTED`` keys a listed
    one, and the peer's own listings.
    """
    if len(ranges) > RANGES:
        raise W.WireError(f"{len(ranges)} ranges, at most {RANGES} are allowed")
    spark = log.sparkSession
    bounds = [r.upper.hex() for r in ranges[:-1]]
    place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(key))) if bounds else F.lit(0)
    placed = FP.with_lanes(log.select(key), key).withColumn("i", place)
    own = {r["i"]: (r["n"], r["fp"]) for r in placed.groupBy("i").agg(F.count(F.lit(1)).alias("n"), *FP.xor()).select("i", "n", FP.text().alias("fp")).collect()}
    theirs = spark.createDataFrame([(i, t.hex()) for i, r in enumerate(ranges) if r.kind == W.TIMESTAMPS for t in r.stamps], f"i int, {key} string")
    listed = [i for i, r in enumerate(ranges) if r.kind == W.TIMESTAMPS]
    differ = [i for i, r in enumerate(ranges) if r.kind == W.FINGERPRINT and own.get(i, (0, "0" * 24))[1] != r.fp.hex()]
    unknown = {r["i"] for r in S.missing(theirs, placed, ["i", key]).select("i").distinct().collect()} if listed else set()
    size = lambda i: own.get(i, (0, ""))[0]
    open_ = {*differ, *unknown}
    small = sorted(i for i in open_ if size(i) < R.LISTED)
    split, later, end, together = _plan([2 if i in open_ and size(i) >= R.LISTED else int(i in open_) for i in range(len(ranges))])
    keys: dict[int, list[str]] = {}
    for r in placed.filter(F.col("i").isin(small)).select("i", key).collect() if small else []:
        keys.setdefault(r["i"], []).append(r[key])
    cut: dict[int, list] = {}
    if split:
        ranked = R.with_position(placed.filter(F.col("i").isin(split)), key, ["i"])
        sized = ranked.join(F.broadcast(spark.createDataFrame([(i, own[i][0]) for i in split], "i int, m long")), "i").withColumn("bucket", R.bucket_of(F.col("pos"), F.col("m"), R.BUCKETS))
        for r in sized.groupBy("i", "bucket").agg(F.min(key).alias("lower"), *FP.xor()).select("i", "bucket", "lower", FP.text().alias("fp")).orderBy("i", "bucket").collect():
            cut.setdefault(r["i"], []).append(r)
    out: list[W.Range] = []
    for i, r in enumerate(ranges[:end]):
        if i in cut:
            parts = cut[i]
            out += [W.Range(W.FINGERPRINT, bytes.fromhex(b["lower"]), bytes.fromhex(a["fp"])) for a, b in zip(parts, parts[1:])]
            out.append(W.Range(W.FINGERPRINT, r.upper, bytes.fromhex(parts[-1]["fp"])))
        elif i in later:
            out.append(W.Range(W.FINGERPRINT, r.upper, bytes.fromhex(own[i][1])))
        elif i in open_:
            out.append(W.Range(W.TIMESTAMPS, r.upper, None, [bytes.fromhex(k) for k in sorted(keys.get(i, []))]))
        elif together and out and out[-1].kind == W.SKIP:
            out[-1] = W.Range(W.SKIP, r.upper)
        else:
            out.append(W.Range(W.SKIP, r.upper))
    if end < len(ranges):
        rest = 0
        for i in range(end, len(ranges)):
            rest ^= int(own.get(i, (0, "0"))[1], 16)
        out.append(W.Range(W.FINGERPRINT, None, rest.to_bytes(12, "big")))
    lacking = S.missing(placed.filter(F.col("i").isin(listed)), theirs, ["i", key]).select(key)
    return out, lacking


def _plan(ranges: list[int]) -> tuple[list[int], list[int], int, bool]:
    """Which of the ranges (0: skipped, 1: listed, 2: too large to list) are split and which wait; the first of those that become one; whether neighbours that are skipped do."""
    together = sum(R.BUCKETS if k == 2 else 1 for k in ranges) > RANGES
    unit = [0 if together and i and k == 0 == ranges[i - 1] else 1 for i, k in enumerate(ranges)]
    split: list[int] = []
    later: list[int] = []
    used, moved = 0, False
    for i, k in enumerate(ranges):
        rest = sum(unit[i + 1 :])
        cost = unit[i]
        if k == 2 and used + R.BUCKETS + (rest if moved else min(rest, 1)) <= RANGES:
            cost = R.BUCKETS
        if used + cost + min(rest, 1) > RANGES:
            return split, later, i, together
        if k == 2:
            (split if cost > 1 else later).append(i)
        used, moved = used + cost, moved or k == 1 or cost > 1
    return split, later, len(ranges), together


class Session:
    """One side of a sync. ``store`` has columns ``hlc`` and ``payload``; payloads travel as they are, sealed or not.

    A session that others write to has ``accepts``, which says of a request's message what is wrong with it (a ``W.ERRORS`` number, 0 for nothing):
    a request that it refuses is answered with that error, and none of its changes is taken. A peer's error, or one that the store
    raises on a peer's changes (answered as error 2), ends in ``State.ERROR`` with ``code`` and ``error``.
    """

    code = 0
    subscribed = False

    def __init__(self, store: LogStore, owner: bytes, transport: QueueTransport, write_key: bytes | None = None, on_change: Callable[[int], None] | None = None, accepts: Callable[[W.Message], int] | None = None):
        self.accepts = accepts
        self.store, self.owner, self.transport, self.write_key = store, owner, transport, write_key
        self.state, self.rounds, self.parts, self.received, self.error, self.on_change = State.IDLE, 0, 0, 0, "", on_change

    def log(self) -> DataFrame:
        rows = self.store.read()
        return self.store.spark.createDataFrame([], "hlc string, payload binary") if rows is None else rows

    def _send(self, ranges: list[W.Range], changes: list[tuple[bytes, bytes]] | None = None) -> None:
        self.transport.send(W.message(W.Message(self.owner, W.REQUEST, self.write_key, 1, changes=changes or [], ranges=ranges)))

    def start(self) -> None:
        self._send(summarise(self.log()))
        self.state = State.WAITING

    def subscribe(self, on: bool = True) -> None:
        """Asks the peer to send changes as they come (or no longer to)."""
        self.transport.send(W.message(W.Message(self.owner, W.REQUEST, self.write_key, W.SUBSCRIBE if on else W.UNSUBSCRIBE)))

    def publish(self, changes: list[tuple[bytes, bytes]]) -> bool:
        """Sends changes to a peer that has subscribed; False, and nothing sent, to one that has not."""
        if self.subscribed:
            self.transport.send(W.message(W.Message(self.owner, W.BROADCAST, changes=changes)))
        return self.subscribed

    def disconnected(self) -> None:
        if self.state is State.WAITING:
            self.state = State.ERROR

    def _fail(self, code: int, text: str, tell: bool) -> bool:
        self.state, self.code, self.error = State.ERROR, code, text
        if tell:
            self.transport.send(W.message(W.Message(self.owner, W.RESPONSE, error=code)))
        return True

    def poll(self) -> bool:
        """Handles one waiting message; False if there is none."""
        data = self.transport.receive()
        if data is None:
            return False
        self.rounds += 1
        try:
            m = W.read_message(data)
        except W.WireError as e:
            return self._fail(getattr(e, "code", 0), str(e), tell=False)
        if m.kind == W.REQUEST:
            code = self.accepts(m) if self.accepts else 0
            if code:
                return self._fail(code, f"refused: {W.ERRORS.get(code, 'unknown')} error", tell=True)
            if m.subscription in (W.SUBSCRIBE, W.UNSUBSCRIBE):
                self.subscribed = m.subscription == W.SUBSCRIBE
            if not m.ranges and not m.changes:  # about the subscription alone
                return True
        if m.changes:
            batch = self.store.spark.createDataFrame([(t.hex(), bytearray(c)) for t, c in m.changes], "hlc string, payload binary")
            try:
                self.received += self.store.append(batch)
            except (ReplayError, CorruptError) as e:
                return self._fail(2, str(e), tell=True)
            if self.on_change:
                self.on_change(len(m.changes))
        if m.kind == W.BROADCAST:
            self.parts += 1
            if self.state is State.WAITING:  # changes alone do not end a sync; the message with the ranges comes after them
                return True
        if W.complete(m):
            self.state = State.SYNCED
            if m.ranges and m.changes:  # the sender waits to hear that all its changes came
                self._send([W.Range(W.SKIP)])
            return True
        ranges, lacking = respond(self.log(), m.ranges)
        sent: list[tuple[bytes, bytes]] = []
        for r in S.with_payload(lacking, self.log(), ["hlc"]).orderBy("hlc").toLocalIterator():
            if len(sent) == PER_MESSAGE:
                self.transport.send(W.message(W.Message(self.owner, W.BROADCAST, changes=sent)))
                sent = []
            sent.append((bytes.fromhex(r["hlc"]), bytes(r["payload"] or b"")))
        self._send(ranges, sent)
        self.state = State.SYNCED if all(r.kind == W.SKIP for r in ranges) and not sent else State.WAITING
        return True


def run(a: Session, b: Session, max_rounds: int = 30, seconds: float = float("inf"), clock: Callable[[], float] = time.monotonic) -> int:
    """Lets two sessions talk until neither has a message waiting. Returns the number of messages handled; those of changes alone do not count towards ``max_rounds``.

    A side that then still waits, because the rounds or the ``seconds`` ran out or because its peer fell silent, is ``UNFINISHED``: it is never
    taken for synced, and may be started again.
    """
    a.start()
    n, parts, until = 0, a.parts + b.parts, clock() + seconds
    while n - (a.parts + b.parts - parts) < max_rounds and clock() < until and (b.poll() or a.poll()):
        n += 1
    for s in (a, b):
        if s.state is State.WAITING or (s.state is State.IDLE and s.transport.pending()):
            s.state = State.UNFINISHED
    return n
