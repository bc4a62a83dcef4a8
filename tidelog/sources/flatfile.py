"""Single-file logs in the length-prefixed flat form."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions import wire as W

SCHEMA = "path string, hlc string, payload binary"


def load(spark: SparkSession, path: str) -> DataFrame:
    """The entries of all flat files at ``path`` (a file, folder or pattern), each up to where it breaks off; a task reads a file at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                entries = W.read_flat_file(data.as_py() or b"")
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(entries), pa.string()), pa.array([t.hex() for t, _ in entries], pa.string()), pa.array([p for _, p in entries], pa.binary())], names=["path", "hlc", "payload"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)


def save(log: DataFrame, path: str, hlc: str = "hlc", payload: str = "payload") -> int:
    """Writes a log in key order as one flat file; null payloads are empty. The form is one file by nature, so rows are streamed through
    the driver, a partition at a time. Use it for exports of a device's size, and ``LogStore`` for everything else.
    """
    spark = log.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, False)
    n = log.count()
    out.write(bytearray(struct.pack("<I", n)))
    for r in log.select(hlc, payload).orderBy(hlc).toLocalIterator():
        data = bytes(r[payload] or b"")
        out.write(bytearray(bytes.fromhex(r[hlc]) + struct.pack("<I", len(data)) + data))
    out.close()
    return n
