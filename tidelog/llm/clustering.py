"""Centroid clustering in integers; centroids are screened by block norms."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, table, written
from .integers import SCALE, integer_vectors

#: Clusters, rounds, components of a vector, and the seed of the starting centroids.
CLUSTERS, ROUNDS, LENGTH, SEED = 40, 5, 64, 2
#: Components of a block.
BLOCK = 8
#: Vectors that are compared with all centroids at a time.
VECTORS = 4096


def block_norms(x: np.ndarray) -> np.ndarray:
    """(n, blocks): the lengths of each vector's blocks. By the inequality of Cauchy and Schwarz |x - c|^2 >= the sum of (|x_b| - |c_b|)^2 over the blocks b."""
    x = x.astype(np.float64)
    return np.sqrt(np.add.reduceat(x * x, np.arange(0, x.shape[1], BLOCK), axis=1))


def exact(x: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray, at_once: int = 1 << 16) -> np.ndarray:
    """Squared distances of rows i of x and j of c, in integers."""
    out = [np.zeros(0, np.int64)]
    for k in range(0, len(i), at_once):
        d = x[i[k : k + at_once]] - c[j[k : k + at_once]]
        out.append(np.einsum("ij,ij->i", d, d))
    return np.concatenate(out)


def assign(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray, centroid_norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid (of equals the smallest number) and the squared distance to it, for each row of ``x``.

    The centroid with the lowest bound gets its exact distance first; then only those whose bound does not exceed that.
    """
    squares, theirs = (norms**2).sum(axis=1)[:, None], (centroid_norms**2).sum(axis=1)[None]
    bound = squares + theirs - 2 * norms @ centroid_norms.T
    slack = 1e-9 * (squares + theirs) + 1e-6  # far above what rounding can do
    rows, first = np.arange(len(x)), bound.argmin(axis=1)
    limit = exact(x, centroids, rows, first)
    i, j = np.nonzero(bound - slack <= limit[:, None])
    d = exact(x, centroids, i, j)
    order = np.lexsort((j, d, i))
    best = order[np.searchsorted(i[order], rows, "left")]
    return j[best], d[best]


def chunks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for b in batches:
        for k in range(0, b.num_rows, VECTORS):
            part = b.slice(k, VECTORS)
            yield part, np.frombuffer(b"".join(part.column(1).to_pylist()), "<i8").reshape(-1, dim), np.frombuffer(b"".join(part.column(2).to_pylist())).reshape(part.num_rows, -1)


def clusters(rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, length: int = LENGTH, seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector that takes part: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Components are the integers floor(256 * x); all distances, sums and means are exact. Vectors of another length than ``length``, with null
    or non-finite components, or too long for 64-bit arithmetic (``integers.TOO_LONG``) take no part. Centroids start as the ``k`` vectors with the smallest
    SHA-256 of ``seed:vec_id`` (a null id is empty text there; rows that share an id go by their components), or as all vectors when there
    are fewer. A round assigns every vector to the nearest centroid, of equally near ones the smallest number, and moves each centroid that has vectors to the
    floor of their mean. Repeated rows are vectors each. Sums beyond 64 bits are null. Empty table: no rows. Other columns are not looked at.

    Vectors are written once with their block norms. A round is one pass: the centroids, k of them, go to all tasks; a task adds up what it assigns
    and returns a row a cluster, so a large cluster is no hot key and nothing but those rows is shuffled.
    """
    spark = rows.sparkSession

    def with_norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            norms = block_norms(np.frombuffer(b"".join(b.column(1).to_pylist()), "<i8").reshape(-1, length)).tobytes()
            size = len(norms) // max(b.num_rows, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([norms[i * size : (i + 1) * size] for i in range(b.num_rows)], pa.binary())], names=["vec_id", "vec", "norms"])

    vectors = written(integer_vectors(rows, id_col, vec_col, length).select("vec_id", "vec").mapInArrow(with_norms, "vec_id long, vec binary, norms binary"), "vectors")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = vectors.select("vec", digest.alias("h")).orderBy("h", "vec").limit(k).collect()
    centroids = np.array([np.frombuffer(bytes(r["vec"]), "<i8") for r in first], np.int64).reshape(-1, length)

    def totals(at: np.ndarray) -> DataFrame:
        norms = block_norms(at)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, sums = np.zeros(len(at), np.int64), np.zeros((len(at), length), np.int64)
            for _, x, mine in chunks(batches, length):
                j, _ = assign(x, mine, at, norms)
                n += np.bincount(j, minlength=len(at))
                np.add.at(sums, j, x)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

        parts = vectors.select("vec_id", "vec", "norms").mapInArrow(run, "cluster int, n long, sums array<long>")
        each = [F.sum(F.col("sums")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(length)]
        return parts.groupBy("cluster").agg(F.sum("n").alias("n"), *each)

    for _ in range(rounds if len(centroids) else 0):
        centroids = centroids.copy()
        for r in totals(centroids).collect():  # a row a cluster
            centroids[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(length)]
    last, last_norms = centroids, block_norms(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x, mine in chunks(batches, length):
            j, d = assign(x, mine, last, last_norms)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(j, pa.int32()), pa.array(d)], names=["vec_id", "cluster", "distance"])

    assigned = written(vectors.mapInArrow(run, "vec_id long, cluster int, distance long"), "assigned")
    dropped(vectors)
    sums = [(r["cluster"], r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()]  # a row a cluster
    fits = lambda n: int(n) if int(n) < 1 << 63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in last.tolist()]
    told = spark.createDataFrame([(c, fits(s), fits(sum(s for _, s in sums)), sha[c]) for c, s in sums], "c int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(told), F.col("cluster") == F.col("c")).drop("c")


def op13_block_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


_DISTANCE = "list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"


def _assigned(i: int) -> str:
    return f"""a{i} AS MATERIALIZED (SELECT vec_id, any_value(e) AS e, min(d) AS distance, arg_min(cluster, (d, cluster)) AS cluster FROM (SELECT v.vec_id, v.e, c.cluster, {_DISTANCE} AS d FROM v, c{i} c) GROUP BY vec_id)"""


def _moved(i: int) -> str:
    return f"""c{i} AS MATERIALIZED (SELECT c.cluster, coalesce(m.e, c.e) AS e FROM c{i - 1} c LEFT JOIN (
  SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY p)::BIGINT[] AS e FROM (SELECT cluster, p, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(e) AS x, generate_subscripts(e, 1) AS p FROM a{i - 1}) GROUP BY cluster, p) GROUP BY cluster) m USING (cluster))"""


ORACLE = f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = {LENGTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h) - 1)::INTEGER AS cluster, e FROM (SELECT e, sha256('{SEED}:' || vec_id) AS h FROM v ORDER BY h LIMIT {CLUSTERS})),
{_assigned(0)},
{", ".join(f"{_moved(i)}, {_assigned(i)}" for i in range(1, ROUNDS + 1))}
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} c USING (cluster)
"""
