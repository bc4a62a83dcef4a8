"""SimHash near-dedup with pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, few_files, keep_ids, pick, split_hot, table, whole_groups, written
from .components import connected_components

BITS = 64
#: Shingles hashed at a time, which bounds the memory of a very long text.
CHUNK = 1 << 16
#: Rows of one first-segment value that one task compares; a value with more is cut into pairs of blocks.
BLOCK = 200_000
#: Pairs expanded at a time.
PAIRS = 1 << 20


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of the word shingles of ``text``; 0 for a text without words (null and empty included)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    n, ones, digest = max(1, len(words) - width + 1), np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends[width - 1 :] - 1).tolist() if len(words) > width else [len(joined)]
    for at in range(0, n, CHUNK):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + CHUNK], stops[at : at + CHUNK])], np.uint64)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp): one row per document; fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return pick(docs, id_col, text_col).select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, fp long")


def segments(bits: int, tau: int) -> list[tuple[int, int]]:
    """(shift, width) of ``tau`` + 1 segments, as even as can be: by the pigeonring principle, two fingerprints that differ in at most
    ``tau`` bits have a segment from which, around the ring, the first l segments differ in at most l * tau // (tau + 1) = l - 1 bits, for every l.
    """
    m = tau + 1
    edges = [bits * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def chained_pairs(fps: np.ndarray, start: np.ndarray, rows: np.ndarray, tau: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs whose fingerprints differ in 1 to ``tau`` bits and whose chain from segment ``start`` keeps every prefix budget.

    ``rows`` numbers the group of each entry; pairs are within a group, and all entries of a group have the same start and the same
    first segment. The second segment may differ in one bit (budget 2 - 1): the entries are sorted by group and second segment and
    looked up under the exact value and each one-bit variant. The longer prefixes are then checked before the whole distance.
    """
    seg = segments(BITS, tau)
    shift, width = (np.array(x, np.uint64) for x in zip(*seg))
    two = (start + 1) % len(seg)
    second = (fps >> shift[two]) & ((np.uint64(1) << width[two]) - np.uint64(1))
    key = (rows.astype(np.uint64) << np.uint64(24)) | second
    order = np.argsort(key, kind="stable")
    key, fps, start = key[order], fps[order], start[order]
    for bit in (None, *range(max(w for _, w in seg))):
        want = key if bit is None else key ^ np.uint64(1 << bit)
        lo, hi = (np.arange(1, len(key) + 1), np.searchsorted(key, want, "right")) if bit is None else (np.searchsorted(key, want, "left"), np.searchsorted(key, want, "right"))
        if bit is not None:  # each unordered pair once: from the entry whose bit is clear
            clear = (key & np.uint64(1 << bit)) == 0
            lo = np.where(clear, lo, hi)
        many = np.maximum(hi - lo, 0)
        begin = 0
        total = np.cumsum(many)
        while begin < len(key):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS, "right")))
            n = many[begin:end]
            if n.sum():
                a = np.repeat(np.arange(begin, end), n)
                b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[begin:end], n)
                x, ok, spent = fps[a] ^ fps[b], np.ones(len(a), bool), np.zeros(len(a), np.int64)
                for k in range(len(seg)):
                    s = (start[a] + k) % len(seg)
                    spent += np.bitwise_count((x >> shift[s]) & ((np.uint64(1) << width[s]) - np.uint64(1)))
                    ok &= spent <= k
                ok &= x != 0
                if ok.any():
                    yield order[a[ok]], order[b[ok]]
            begin = end


def local_roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index that each of ``n`` entries reaches by ``pairs``, which are folded in one lot at a time."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            differ = ra != rb
            if not differ.any():
                break
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def links(fps: DataFrame, tau: int = 4, block: int = BLOCK) -> DataFrame:
    """(a, b): edges between distinct fingerprints (column fp, no repeats) with the same components as all pairs within ``tau`` bits.

    Every fingerprint goes to the values of its ``tau`` + 1 segments. Of each value's pairs the chains are checked in a task; a value
    with more than ``block`` fingerprints is cut into blocks whose pairs are dealt to several tasks. A task takes its groups one after another,
    some ``block`` rows at a time, so its memory does not grow with its share of the input. It returns, per fingerprint,
    a link to the smallest one it reaches within the task, so a dense ball of n near copies gives n - 1 edges, not all its pairs.
    """
    seg = segments(BITS, tau)
    value = [F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("fp", s).bitwiseAND((1 << w) - 1).cast("int").alias("v")) for i, (s, w) in enumerate(seg)]
    rows = fps.select("fp", F.explode(F.array(*value)).alias("s")).select("fp", "s.i", "s.v")
    rows = split_hot(rows, ["i", "v"], "fp", block).select("fp", "i", F.xxhash64("i", "v", "part_a", "part_b").alias("g"))
    n = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in whole_groups(batches, 2, block):
            fp, start, g = (np.concatenate([b.column(k).to_numpy() for b in got]) for k in range(3))
            fp = fp.view(np.uint64)
            group = np.unique(g, return_inverse=True)[1]
            root = local_roots(len(fp), chained_pairs(fp, start.astype(np.int64), group, tau))
            own = np.flatnonzero(root != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[own].view(np.int64)), pa.array(fp[root[own]].view(np.int64))], names=["a", "b"])

    return rows.repartition(n, "g").sortWithinPartitions("g").mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, tau: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Lower-cased (A-Z) words between ASCII white space; ``width``-word shingles with repeats, a shorter text's whole sequence, and 0 for
    a text without words (null, empty, white space), which links like any other. Documents link when their fingerprints differ in at
    most ``tau`` bits; component_id is the smallest doc_id reachable. A null id is no id: if a whole component has none, it is null.
    Equal fingerprints are compared once. Repeated rows are kept. Empty input: no rows. Extra columns are not looked at.
    """
    fps = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    n = fps.count()
    least = written(few_files(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), n), "distinct")
    found = connected_components(links(least.select("fp"), tau))
    low = found.join(least, found["node"] == least["fp"]).groupBy("component").agg(F.min("low").alias("component_id"))
    linked = found.join(low, "component").select(F.col("node").alias("fp"), "component_id")
    named = least.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id"))
    named = written(few_files(named, n), "named")
    for scratch in (found, least):
        dropped(scratch)
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest; rows with a null id stay. All columns as they were."""
    found = near_groups(docs, id_col, text_col)
    return keep_ids(docs, found, "doc_id <=> component_id OR doc_id IS NULL", id_col)


def op10_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
