"""A store as a stream: its changes as a source whose offsets are versions, and a sink that commits each micro-batch once.

Both are Python data sources; they read and write the store's files through the file system of its path, in tasks, and hold no more than a file's row group or
``ROWS`` rows at a time.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.store import LogStore, Manifest, ReplayError

#: Rows of a file that a task of the sink sorts and writes at a time.
ROWS = 1 << 18


@dataclass
class Files:
    """The files of a store, from a process without a Spark session."""

    path: str

    def __post_init__(self) -> None:
        self.fs, self.root = pafs.FileSystem.from_uri(self.path)

    def versions(self) -> list[int]:
        found = [i.base_name for i in self.fs.get_file_info(pafs.FileSelector(self.root, allow_not_found=True))]
        return sorted(int(n[9:-5]) for n in found if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self, version: int) -> Manifest:
        if version == 0:
            return Manifest()
        try:
            with self.fs.open_input_stream(f"{self.root}/manifest-{version}.json") as f:
                return Manifest(**json.loads(f.read()))
        except FileNotFoundError as e:
            raise ReplayError(f"version {version} is not there (any more): begin with a later one") from e

    def added(self, version: int) -> list[str]:
        """The segments that a version added; none where it only put old rows together."""
        m = self.manifest(version)
        return [] if m.kind == "compact" else [s for s in m.segments if s not in set(self.manifest(version - 1).segments)]

    def parts(self, segment: str) -> list[str]:
        return sorted(i.path for i in self.fs.get_file_info(pafs.FileSelector(f"{self.root}/{segment}")) if i.base_name.endswith(".parquet"))

    def put(self, m: Manifest) -> bool:
        """Puts a manifest in its place unless there is one, as ``LogStore.commit`` does."""
        name, aside = f"{self.root}/manifest-{m.version}.json", f"{self.root}/_{uuid.uuid4()}"
        kind = self.fs.type_name
        if kind not in ("local", "hdfs"):
            raise NotImplementedError(f"no commit that leaves a taken name alone on {kind}")
        with self.fs.open_output_stream(aside) as f:
            f.write(json.dumps(asdict(m)).encode())
        try:
            if kind == "local":
                os.link(aside, name)
                self.fs.delete_file(aside)
            else:
                self.fs.move(aside, name)  # fails where the name is taken
        except OSError:
            self.fs.delete_file(aside)
            if m.version in self.versions():
                return False
            raise
        return True


@dataclass
class Part(InputPartition):
    path: str


class FeedReader(DataSourceStreamReader):
    def __init__(self, path: str, since: int, schema: StructType) -> None:
        self.path, self.since, self.schema = path, since, schema

    def initialOffset(self) -> dict:
        return {"version": self.since}

    def latestOffset(self) -> dict:
        return {"version": max([self.since, *Files(self.path).versions()])}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        files = Files(self.path)
        return [Part(p) for v in range(start["version"] + 1, end["version"] + 1) for s in files.added(v) for p in files.parts(s)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        files, schema = Files(self.path), to_arrow_schema(self.schema)
        with files.fs.open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=schema.names):
                yield pa.RecordBatch.from_arrays([batch.column(n).cast(schema.field(n).type) for n in schema.names], schema=schema)

    def commit(self, end: dict) -> None:
        pass


class Feed(DataSource):
    """The rows that each version of a store added, as a stream. Options: ``path``, and ``since``, the version after which it begins (0).

    The offset of a stream is a version, so a query that is started again goes on with the versions it has not seen; compactions add nothing. A version
    whose manifest ``vacuum`` took away cannot be read: retain as many as a stream may be behind.
    """

    @classmethod
    def name(cls) -> str:
        return "tidelog_feed"

    def streamReader(self, schema: StructType) -> FeedReader:
        return FeedReader(self.options["path"], int(self.options.get("since", "0")), schema)


def feed(store: LogStore, schema: StructType, since: int = 0) -> DataFrame:
    """The stream of a store's changes."""
    store.spark.dataSource.register(Feed)
    return store.spark.readStream.format("tidelog_feed").schema(schema).option("path", store.path).option("since", since).load()


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: the name of a segment, None without rows."""

    segment: str | None
    n: int = 0
    lo: str | None = None
    hi: str | None = None
    fp: int = 0


class SinkWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str, query: str, hlc: str) -> None:
        self.path, self.query, self.hlc = path, query, hlc

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, out = Files(self.path), Written(None)
        held: list[pa.RecordBatch] = []
        for batch in iterator:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS:
                self._file(files, held, out)
                held = []
        if held:
            self._file(files, held, out)
        return out

    def _file(self, files: Files, held: list[pa.RecordBatch], out: Written) -> None:
        rows = pa.Table.from_batches(held).sort_by(self.hlc)
        keys = rows.column(self.hlc)
        if keys.null_count:
            raise ValueError(f"{keys.null_count} keys are null")
        if out.segment is None:
            out.segment = f"segment-{uuid.uuid4()}"
            files.fs.create_dir(f"{files.root}/{out.segment}")
        with files.fs.open_output_stream(f"{files.root}/{out.segment}/part-{uuid.uuid4()}.parquet") as f:
            pq.write_table(rows, f)
        for k in keys.to_pylist():
            out.fp ^= int.from_bytes(hashlib.sha256(bytes.fromhex(k)).digest()[:12], "big")
        lo, hi = pc.min_max(keys).as_py().values()
        out.n, out.lo, out.hi = out.n + rows.num_rows, min(out.lo or lo, lo), max(out.hi or hi, hi)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        """One new version with the segments of all tasks and the number of the batch. A batch that a version already has is dropped: it was committed, and
        the stream was lost before it knew.
        """
        files, done = Files(self.path), [m for m in messages if m is not None and m.segment]
        while True:
            m = files.manifest(max([0, *files.versions()]))
            if m.batches.get(self.query, -1) >= batchId:
                return self.abort(messages, batchId)
            fp = int(m.fp, 16)
            for x in done:
                fp ^= x.fp
            new = Manifest(m.version + 1, m.n_rows + sum(x.n for x in done), f"{fp:024x}", [*m.segments, *[x.segment for x in done]], [*m.bounds, *[[x.lo, x.hi] for x in done]], {**m.batches, self.query: batchId})
            if files.put(new):
                return None

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        files = Files(self.path)
        for m in messages:
            if m is not None and m.segment:
                files.fs.delete_dir(f"{files.root}/{m.segment}")


class Sink(DataSource):
    """Appends a stream's rows to a store, each micro-batch exactly once. Options: ``path``, ``query`` (the name under which the store remembers the last batch;
    a stream keeps it over restarts, as it keeps its checkpoint) and ``hlc``.

    A task writes its rows, sorted, as a segment and reports its count, bounds and fingerprint; the driver adds all in one manifest, which also names the batch.
    So a batch that is run again is known by its number, with no join. Keys are not looked for in the store: they must be new, as those of a feed are.
    """

    @classmethod
    def name(cls) -> str:
        return "tidelog_store"

    def streamWriter(self, schema: StructType, overwrite: bool) -> SinkWriter:
        return SinkWriter(self.options["path"], self.options["query"], self.options.get("hlc", "hlc"))


def into(stream: DataFrame, store: LogStore, query: str, checkpoint: str) -> StreamingQuery:
    """Appends what the stream has now to ``store``, and stops."""
    spark: SparkSession = store.spark
    spark.dataSource.register(Sink)
    return stream.writeStream.format("tidelog_store").option("path", store.path).option("query", query).option("hlc", store.hlc).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
