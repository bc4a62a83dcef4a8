"""A versioned, append-only store of a change log with an atomically replaced manifest."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import fingerprint as FP
from ..operators import sets as S
from .directory import Directory, build
from .log import dropped, materialised


#: Parts of a batch's time, each with bounds of its own.
SPANS = 64


class ReplayError(RuntimeError):
    """The store is not at the version that the reader trusts: it was rolled back, or moved on without the reader."""


class CorruptError(RuntimeError):
    """A manifest cannot be read, or the rows do not have the count and fingerprint that it states."""


@dataclass
class Manifest:
    version: int = 0
    n_rows: int = 0
    fp: str = "0" * 24
    segments: list[str] = field(default_factory=list)
    #: The smallest and largest timestamp of each segment; None where it has none or it was not recorded.
    bounds: list[list[str] | None] = field(default_factory=list)
    #: The last batch of each stream that appends by itself.
    batches: dict[str, int] = field(default_factory=dict)
    #: append, or compact: the version has the rows of the one before.
    kind: str = "append"

    def __post_init__(self) -> None:
        self.bounds += [None] * (len(self.segments) - len(self.bounds))


class LogStore:
    """Rows keyed by ``keys`` under a path that all executors share.

    An append writes a segment of the rows whose keys are new and its directory (see ``directory``), then a manifest of the next version, which is put in
    place as a whole: readers see the old version until then, and a run lost on the way leaves files that no manifest names, which ``vacuum`` takes away. The
    newest manifest counts. Appending the same rows again changes nothing. On a key that is there already the old row stays. A key must not be null.
    """

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("hlc",), hlc: str = "hlc"):
        self.spark, self.path, self.keys, self.hlc = spark, path, list(keys), hlc
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(path))

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self, version: int | None = None, trusted: int | None = None) -> Manifest:
        """The manifest of a version or of the newest one. ``trusted`` is the version the caller last saw: the same is fine, one more is a commit
        whose news got lost and is taken over, 0 or None takes any, and anything else is a ``ReplayError``.
        """
        found = self.versions()
        at = (found[-1] if found else 0) if version is None else version
        if trusted and at not in (trusted, trusted + 1):
            raise ReplayError(f"version {at}, trusted {trusted}")
        if at == 0:
            return Manifest()
        if at not in found:
            raise CorruptError(f"no version {at}")
        stream = self._fs.open(self._path(f"{self.path}/manifest-{at}.json"))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        try:
            m = Manifest(**json.loads(text))
        except (ValueError, TypeError) as e:
            raise CorruptError(f"manifest {at}: {e}") from e
        if m.version != at:
            raise CorruptError(f"manifest {at} says version {m.version}")
        return m

    def size(self) -> int:
        """The number of rows, from the manifest alone."""
        return self.manifest().n_rows

    def read(self, version: int | None = None, trusted: int | None = None) -> DataFrame | None:
        """The rows at a version, a segment being read only once; None before the first append."""
        m = self.manifest(version, trusted)
        return self.spark.read.parquet(*[f"{self.path}/{s}" for s in m.segments]) if m.segments else None

    def point(self, key: str) -> DataFrame | None:
        """Rows of one timestamp; the comparison is pushed to the files, which are sorted by it."""
        rows = self.read()
        return None if rows is None else rows.filter(F.col(self.hlc) == key)

    def scan(self, after: str | None = None, upper: str | None = None, version: int | None = None) -> DataFrame | None:
        """Rows in key order after one timestamp and before another; both are pushed to the files, and segments beyond them are not read."""
        m = self.manifest(version)
        near = [s for s, b in zip(m.segments, m.bounds) if b is None or ((after is None or b[1] > after) and (upper is None or b[0] < upper))]
        if not near:
            rows = self.read(version)
            return None if rows is None else rows.limit(0)
        rows = self.spark.read.parquet(*[f"{self.path}/{s}" for s in near])
        rows = rows if after is None else rows.filter(F.col(self.hlc) > after)
        return (rows if upper is None else rows.filter(F.col(self.hlc) < upper)).orderBy(self.hlc)

    def cursor(self, version: int | None = None, after: str | None = None) -> Iterator[Row]:
        """Rows in key order, pulled one partition at a time; ``after`` the last key that was seen it goes on."""
        rows = self.scan(after, version=version)
        return iter(()) if rows is None else rows.toLocalIterator()

    def verify(self, version: int | None = None) -> None:
        m, rows = self.manifest(version), self.read(version)
        if rows is None:
            return
        got = FP.with_lanes(rows.select(self.hlc), self.hlc).agg(F.count(F.lit(1)).alias("n"), *FP.xor()).select("n", FP.text().alias("fp")).first()
        if (got["n"], got["fp"]) != (m.n_rows, m.fp):
            raise CorruptError(f"version {m.version} states {m.n_rows} rows and {m.fp}, the files have {got['n']} and {got['fp']}")

    def near(self, m: Manifest, batch: DataFrame) -> DataFrame | None:
        """The stored rows that can have a key of ``batch``: of the segments whose bounds meet the batch's, and there within the batch's bounds
        (files are sorted by timestamp, so most of a large segment is not read). All rows where the timestamp is no part of the key.
        """
        lo, hi = batch.agg(F.min(self.hlc), F.max(self.hlc)).first()
        return self._within(m, [] if lo is None else [(lo, hi)])

    def _within(self, m: Manifest, spans: list[tuple[str, str]]) -> DataFrame | None:
        if self.hlc not in self.keys:
            return self.read(m.version)
        meet = [f"{self.path}/{s}" for s, b in zip(m.segments, m.bounds) if any(b is None or (b[0] <= hi and lo <= b[1]) for lo, hi in spans)]
        return self.spark.read.parquet(*meet).filter(reduce(or_, [F.col(self.hlc).between(lo, hi) for lo, hi in spans])) if meet and spans else None

    def _old(self, m: Manifest, batch: DataFrame, lo: str | None, hi: str | None) -> DataFrame | None:
        """``near`` with the bounds of up to ``SPANS`` parts of the batch's time, so that one late row beside new ones does not bring in all that lies between."""
        if lo is None or self.hlc not in self.keys or not any(b is None or (b[0] <= hi and lo <= b[1]) for b in m.bounds):
            return self._within(m, [])
        first = int(lo[:12], 16)
        part = (F.conv(F.substring(self.hlc, 1, 12), 16, 10).cast("long") - first) / ((int(hi[:12], 16) - first) // SPANS + 1)
        spans = batch.groupBy(part.cast("long").alias("p")).agg(F.min(self.hlc), F.max(self.hlc)).orderBy("p").collect()  # SPANS rows at most
        return self._within(m, [(r[1], r[2]) for r in spans])

    def directory(self, version: int | None = None) -> Directory:
        """Order statistics and fingerprints of the keys at a version."""
        m = self.manifest(version)
        for s in m.segments:
            if not self._fs.exists(self._path(f"{self.path}/directory/{s}")):
                self._describe(s)  # a stream's sink leaves that to the first who asks
        return Directory(self.spark, self.path, m.segments, self.hlc)

    def slice(self, begin: int, end: int, version: int | None = None) -> DataFrame | None:
        """Rows at positions ``begin`` to ``end`` - 1 in key order, with ``pos``; only files that can hold them are read. None where there are none."""
        return self.directory(version).slice(begin, end)

    def fingerprints(self, ranges: DataFrame, version: int | None = None) -> DataFrame:
        """Adds n and fp to the ranges (lower, upper); of the rows only those at the edges of ranges are read."""
        return self.directory(version).fingerprints(ranges)

    def append(self, batch: DataFrame, trusted: int | None = None) -> int:
        """Adds what is new and returns how many rows were. A batch of known keys writes nothing and keeps the version. A null key is an error, since no
        key equals it.
        """
        m = self.manifest(trusted=trusted)
        fresh = materialised(S.first_of_batch(batch, self.keys), "batch")
        bare = F.count(F.when(reduce(or_, [F.col(k).isNull() for k in self.keys]), 1)).alias("bare")
        got = fresh.agg(F.count(F.lit(1)).alias("n"), bare, F.min(self.hlc).alias("lo"), F.max(self.hlc).alias("hi")).first()
        if got["bare"]:
            dropped(fresh)
            raise ValueError(f"{got['bare']} keys of the batch are null")
        old = self._old(m, fresh, got["lo"], got["hi"]) if m.segments else None
        n = got["n"]
        if old is not None:
            batch, fresh = fresh, materialised(S.missing(fresh, old, self.keys), "fresh")
            dropped(batch)
            n = fresh.count()
        if n:
            self.commit(self.next(m, fresh))
        dropped(fresh)
        return n

    def next(self, m: Manifest, fresh: DataFrame) -> Manifest:
        """Writes a segment of rows that are new, and its directory; the manifest that would add it to ``m``."""
        segment = self._segment(m.version + 1, fresh)
        got = FP.with_lanes(self.spark.read.parquet(f"{self.path}/{segment}").select(self.hlc), self.hlc).agg(F.count(F.lit(1)).alias("n"), F.min(self.hlc).alias("lo"), F.max(self.hlc).alias("hi"), *FP.xor()).first()
        fp = "".join(f"{int(m.fp[8 * i : 8 * i + 8], 16) ^ got[n]:08x}" for i, n in enumerate(FP.LANES))
        span = None if got["lo"] is None else [got["lo"], got["hi"]]
        return Manifest(m.version + 1, m.n_rows + got["n"], fp, [*m.segments, segment], [*m.bounds, span], m.batches)

    def _segment(self, version: int, rows: DataFrame) -> str:
        segment = f"segment-{version}-{uuid.uuid4()}"
        rows.repartitionByRange(self.hlc).sortWithinPartitions(self.hlc).write.parquet(f"{self.path}/{segment}")
        self._describe(segment)
        return segment

    def _describe(self, segment: str) -> None:
        """Writes a segment's directory aside and puts it in place as a whole; of two who do so at once one's is dropped."""
        aside, place = self._path(f"{self.path}/directory/_{uuid.uuid4()}"), self._path(f"{self.path}/directory/{segment}")
        build(self.spark, f"{self.path}/{segment}", aside.toString(), self.hlc)
        if self._fs.exists(place) or not self._fs.rename(aside, place):
            self._fs.delete(aside, True)

    def commit(self, m: Manifest) -> None:
        """Puts a manifest in its place unless there is one: of two writers one gets a ``ReplayError``. Readers never see half of it."""
        if not self._put(f"{self.path}/manifest-{m.version}.json", json.dumps(m.__dict__).encode()):
            raise ReplayError(f"version {m.version} was committed by another writer")

    def _put(self, name: str, data: bytes) -> bool:
        """Writes a file unless its name is taken. On a local disk, where a rename overwrites, by a link, which does not; on HDFS by a rename, which fails
        there; elsewhere (object stores) by a create that does not overwrite, which appears as a whole when it is closed.
        """
        scheme, target = self._fs.getUri().getScheme(), self._path(name)
        aside = self._path(f"{self.path}/_{uuid.uuid4()}") if scheme in ("file", "hdfs") else target
        try:
            out = self._fs.create(aside, False)
            out.write(bytearray(data))
            out.close()
            if scheme == "file":
                local = lambda p: self.spark._jvm.java.io.File(p.toUri().getPath()).toPath()
                self.spark._jvm.java.nio.file.Files.createLink(local(target), local(aside))
            return scheme != "hdfs" or self._fs.rename(aside, target)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            if aside is not target:
                self._fs.delete(aside, False)

    def vacuum(self, retain: int = 10, hours: float = 24.0) -> list[str]:
        """Deletes manifests but the newest ``retain``, and segments, directories and unfinished files that none of those names; returns the names.

        What is younger than ``hours`` stays, since a writer that has not committed yet may have written it: give more than the longest append takes.
        """
        if retain < 1:
            raise ValueError("at least one version is retained")
        found = self.versions()
        keep = {s for v in found[-retain:] for s in self.manifest(v).segments} | {f"manifest-{v}.json" for v in found[-retain:]}
        until = time.time() * 1000 - hours * 3_600_000
        listed = list(self._fs.listStatus(self._path(self.path)))
        inner = self._path(f"{self.path}/directory")
        listed += list(self._fs.listStatus(inner)) if self._fs.exists(inner) else []
        gone = []
        for s in listed:
            name = s.getPath().getName()
            if name not in keep and name.startswith(("segment-", "manifest-", "_")) and s.getModificationTime() <= until:
                self._fs.delete(s.getPath(), True)
                gone.append(name)
        return sorted(set(gone))

    def compact(self) -> None:
        """Rewrites all segments as one, in key order, as the next version."""
        m = self.manifest()
        if len(m.segments) < 2:
            return
        segment = self._segment(m.version + 1, self.read(m.version))
        span = None if None in m.bounds else [min(b[0] for b in m.bounds), max(b[1] for b in m.bounds)]
        self.commit(Manifest(m.version + 1, m.n_rows, m.fp, [segment], [span], m.batches, "compact"))
