"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, pick, split_hot, table, whole_groups, written
from .components import connected_components
from .simhash import local_roots

#: Vectors that the rotations are learned from at most: those whose ids have the smallest hashes. Every vector is indexed.
SAMPLE = 20_000
#: Bits of one rotation's code, bits of one table's key, and rotations. A pair is a candidate when some table's keys differ in at most one bit.
BITS, KEY, ROTATIONS = 64, 16, 2
#: Share of all bits, beside four, in which the codes of a candidate pair differ at most. Vectors at the threshold's angle differ in 6 % of them on average.
FARTHEST = 0.25
#: Rows of one key that one task compares; a key with more is cut into pairs of blocks. Pairs expanded at a time.
BLOCK, PAIRS = 20_000, 1 << 16


@dataclass
class Quantiser:
    """Codes of unit vectors: the signs of (x - mean) @ projections[r], ``KEY`` bits a table."""

    mean: np.ndarray
    projections: list[np.ndarray]

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(n, tables) integer keys. A vector of another length is cut or filled with zeros for its code alone."""
        d = len(self.mean)
        x = np.pad(x[:, :d], ((0, 0), (0, max(0, d - x.shape[1])))) - self.mean
        out = []
        for p in self.projections:
            bits = x @ p > 0
            for at in range(0, bits.shape[1], KEY):
                part = bits[:, at : at + KEY]
                out.append(part @ (1 << np.arange(part.shape[1])))
        return np.stack(out, axis=1).astype(np.int64)


def iterative_quantisation(x: np.ndarray, bits: int = BITS, rotations: int = ROTATIONS, rounds: int = 40, seed: int = 11) -> Quantiser:
    """Learns rotations of the principal components of unit vectors ``x`` (n, d) that lie close to their own signs.

    Each round sets the codes to the signs and the rotation to the one that brings the projected vectors nearest to them (a singular value
    decomposition), from a random start; the starts give different tables. Components have variances evened out by the rotation, so bits are balanced.
    """
    mean = x.mean(axis=0)
    centred = x - mean
    _, _, components = np.linalg.svd(centred if len(x) > x.shape[1] else np.vstack([centred, np.eye(x.shape[1]) * 1e-6]), full_matrices=False)
    base = components[:bits].T
    v = centred @ base
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(rotations):
        r, _ = np.linalg.qr(rng.standard_normal((base.shape[1], base.shape[1])))
        for _ in range(rounds):
            a, _, b = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (a @ b).T
        out.append(base @ r)
    return Quantiser(mean, out)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_pairs(group: np.ndarray, width: np.ndarray, half: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the same group whose other halves (``half``, of ``width`` bits) differ in at most one bit, each once."""
    key = (group.astype(np.uint64) << np.uint64(KEY)) | half.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    for bit in (None, *range(int(width.max(initial=0)))):
        if bit is None:
            lo, hi = np.arange(1, len(key) + 1), np.searchsorted(key, key, "right")
        else:
            want = key ^ np.uint64(1 << bit)
            lo, hi = np.searchsorted(key, want, "left"), np.searchsorted(key, want, "right")
            lo = np.where((key >> np.uint64(bit)) & np.uint64(1) == 0, lo, hi)
        many = np.maximum(hi - lo, 0)
        total, begin = np.cumsum(many), 0
        while begin < len(key):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS, "right")))
            n = many[begin:end]
            if n.sum():
                a = np.repeat(np.arange(begin, end), n)
                b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[begin:end], n)
                yield order[a], order[b]
            begin = end


def vectors(rows: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, str]:
    """(vec_id, label, dim, digest, vec) as bytes, and the numpy type of the bytes; digest is null where a vector links with nothing."""
    kind = rows.schema[vec_col].dataType
    dt = "<f4" if getattr(kind, "elementType", None) is not None and kind.elementType.typeName() == "float" else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, digests, raw = [], [], []
            for i, label, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                x = np.array([], dt)
                if v.is_valid and i is not None and label is not None and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(dt) + np.array(0, dt)
                good = len(x) > 0 and bool(np.isfinite(x).all()) and bool(x.any())
                dims.append(len(x))
                raw.append(x.tobytes() if good else None)
                digests.append(hashlib.blake2b(b"%d:" % len(x) + x.tobytes() + label.encode(), digest_size=16).digest() if good else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dims, pa.int32()), pa.array(digests, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "label", "dim", "digest", "vec"])

    plain = pick(rows, id_col, label_col, vec_col).select(F.col(id_col).cast("long"), F.col(label_col).cast("string"), F.col(vec_col).cast("array<float>" if dt == "<f4" else "array<double>"))
    return plain.mapInArrow(run, "vec_id long, label string, dim int, digest binary, vec binary"), dt


def near_vectors(rows: DataFrame, threshold: float = 0.98, sample: int = SAMPLE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``rows``: vec_id, n_links, component_id, kept.

    Vectors of the same label and length link when their cosine, in double precision on the original values, is at least
    ``threshold``. Null ids and labels, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing: no
    links, component_id is the id, kept. Equal vectors are compared once and link with one another. n_links counts other rows linked directly.

    The rotations are learned on at most ``sample`` vectors; every vector is indexed. A table's key is cut in two halves and a vector goes to
    both, so keys that differ in at most one bit meet in a half that is equal. A pair counts in the first table, and there in the first half, in which it
    can be found, and is a candidate when their whole codes differ in at most ``FARTHEST`` of the bits. Codes alone are dealt to the tables; the vectors go only to where
    they have a candidate. A task takes its keys one after another, some ``BLOCK`` rows at a time, and returns for each vector its number of
    links and the smallest vector it reaches there. Extra columns are not looked at.
    """
    spark = rows.sparkSession
    all_rows, dt = vectors(rows, id_col, vec_col, label_col)
    all_rows = written(all_rows, "vectors")
    # Of equal vectors one goes on: rows of a digest have the same label, dim and vec.
    reps = all_rows.filter("digest IS NOT NULL").groupBy(F.col("digest").alias("d")).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), *[F.any_value(c).alias(c) for c in ("label", "dim", "vec")])
    reps = written(reps, "reps")
    length = reps.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if length is None:
        return all_rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    chosen = reps.filter(F.col("dim") == length["dim"]).orderBy(F.xxhash64("rep"), "rep").limit(sample).select("vec").collect()
    q = iterative_quantisation(unit(np.stack([np.frombuffer(r["vec"], dt) for r in chosen])))
    widths = [min(KEY, p.shape[1] - at) for p in q.projections for at in range(0, p.shape[1], KEY)]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.zeros((b.num_rows, len(widths)), np.int64)
            dims = b.column(1).to_numpy()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                keys[at] = q.keys(unit(np.stack([np.frombuffer(b.column(3)[int(i)].as_buffer(), dt) for i in at])))
            packed = pa.array(list(keys.astype(np.uint16)), pa.list_(pa.uint16())).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), packed], names=["d", "dim", "label", "keys"])

    coded = reps.select("d", "dim", "label", "vec").mapInArrow(code, "d binary, dim int, label string, keys array<int>")
    low = [w // 2 for w in widths]
    at = [F.struct(F.lit(j).alias("j"), F.lit(h).alias("h"), (F.col("keys")[j].bitwiseAND((1 << low[j]) - 1) if h == 0 else F.shiftright(F.col("keys")[j], low[j])).alias("v")) for j in range(len(widths)) for h in (0, 1)]
    dealt = coded.select("d", "dim", "label", "keys", F.explode(F.array(*at)).alias("s")).select("d", "dim", "label", "keys", "s.j", "s.h", "s.v")
    dealt = split_hot(dealt, ["label", "dim", "j", "h", "v"], "d", BLOCK)
    dealt = dealt.select("d", "keys", "j", "h", F.xxhash64("label", "dim", "j", "h", "v", "part_a", "part_b").alias("g"), F.xxhash64("label", "dim").alias("ld"), "part", (F.col("part_a") == F.col("part_b")).alias("same"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    farthest = 4 + sum(widths) * FARTHEST

    def candidates(got: list[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows (d, keys, j, h, g, ld, part, same, ..) whose codes are close, each in the first table and half that can find it."""
        j, h, g, ld, part, same = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in got]) for c in range(2, 8))
        keys = np.concatenate([b.column(1).flatten().to_numpy().reshape(b.num_rows, -1) for b in got])
        shift, width = np.array(low)[j], np.array(widths)[j]
        mine = keys[np.arange(len(j)), j]
        other = np.where(h == 0, mine >> shift, mine & ((1 << shift) - 1))
        for a, b in near_pairs(np.unique(g, return_inverse=True)[1], np.where(h == 0, width - shift, shift), other):
            ok = ((part[a] != part[b]) | same[a]) & (ld[a] == ld[b])
            a, b = a[ok], b[ok]
            differ = keys[a] ^ keys[b]
            bits = np.bitwise_count(differ)
            first = np.argmax(bits <= 1, axis=1)
            d = differ[np.arange(len(a)), first]
            low_equal = (d & ((1 << np.array(low)[first]) - 1)) == 0
            ok = (first == j[a]) & (h[a] == np.where(low_equal, 0, 1)) & (bits.sum(axis=1) <= farthest)
            yield a[ok], b[ok]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in whole_groups(batches, 4, BLOCK):
            some = np.zeros(sum(b.num_rows for b in got), bool)
            for a, b in candidates(got):
                some[a] = some[b] = True
            begin = 0
            for b in got:
                yield b.filter(pa.array(some[begin : begin + b.num_rows]))
                begin += b.num_rows

    chosen = dealt.repartition(parts, "g").sortWithinPartitions("g").mapInArrow(choose, dealt.schema)
    chosen = written(chosen, "candidates").join(reps.select(F.col("d").alias("_d"), "rep", "n", "vec"), F.col("d") == F.col("_d")).drop("_d")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in whole_groups(batches, 4, BLOCK):
            yield link_groups(got)

    def link_groups(got: list[pa.RecordBatch]) -> pa.RecordBatch:
        rep, n = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in got]) for c in (8, 9))
        raw = [v for b in got for v in b.column(10)]
        whole = np.concatenate([np.frombuffer(v.as_buffer(), dt) for v in raw])
        size = np.array([len(v.as_buffer()) for v in raw]) // np.dtype(dt).itemsize
        begin = np.cumsum(size) - size
        links = np.zeros(len(rep), np.int64)

        def linked() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for a, b in candidates(got):
                ok = (rep[a] != rep[b]) & (size[a] == size[b])
                a, b = a[ok], b[ok]
                keep = np.zeros(len(a), bool)
                for s in np.unique(size[a]):
                    k = np.flatnonzero(size[a] == s)
                    x, y = (whole[begin[i[k]][:, None] + np.arange(s)].astype(np.float64) for i in (a, b))
                    x, y = (z / np.abs(z).max(axis=1, keepdims=True) for z in (x, y))
                    keep[k] = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y)) >= threshold
                a, b = a[keep], b[keep]
                np.add.at(links, a, n[b])
                np.add.at(links, b, n[a])
                yield a, b

        root = local_roots(len(rep), linked())
        own = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(rep[own]), pa.array(links[own]), pa.array(rep[root[own]])], names=["rep", "links", "root"])

    found = written(chosen.repartition(parts, "g").sortWithinPartitions("g").mapInArrow(link, "rep long, links long, root long"), "links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    edges = found.select(F.col("rep").alias("a"), F.col("root").alias("b"))
    components = connected_components(edges).select(F.col("node").alias("rep"), "component")
    named = reps.select("d", "rep", "n").join(counts, "rep", "left").join(components, "rep", "left")
    named = written(named.select("d", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("c")), "named")
    for scratch in (reps, found, components):
        dropped(scratch)
    out = all_rows.select("vec_id", "digest").join(named, F.col("digest") == F.col("d"), "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op6_embedding_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c USING (vec_id)
"""
