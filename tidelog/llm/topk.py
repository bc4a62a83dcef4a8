"""Exact search for the largest inner products by segment statistics at several resolutions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, new_path, table, written
from .integers import SCALE, integer_vectors, matrix

#: Neighbours of a query, and every how-manieth id is a query.
TOP, EVERY = 5, 50
#: Segments that a vector is cut into, coarse to fine.
SEGMENTS = (1, 4, 16)
#: Components of the queries of a block at most, or one query; a block is sent to every task. Components of the vectors that give first thresholds.
BLOCK, SAMPLE = 1 << 18, 1 << 17
#: Queries and vectors compared at a time.
QUERIES, VECTORS = 1024, 2048
LOW = -(1 << 62)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """(n, 2 * segments): each segment's mean and standard deviation, times the root of its length.

    The squared distance of two vectors is at least that of their statistics, since within a segment it is length * (difference of the means)^2
    plus the squared distance of the centred parts, which is at least length * (difference of the deviations)^2. All squares together are the vector's own,
    so the inner product of two vectors is at most that of their statistics: a lower bound of the distance is an upper bound of the product.
    """
    at = np.arange(segments) * x.shape[1] // segments
    n = np.diff(np.append(at, x.shape[1]))
    x = x.astype(np.float64)
    mean = np.add.reduceat(x, at, axis=1) / n
    spread = np.add.reduceat((x - np.repeat(mean, n, axis=1)) ** 2, at, axis=1)
    return np.concatenate([mean * np.sqrt(n), np.sqrt(spread)], axis=1)


def levels(dim: int) -> list[int]:
    return sorted({min(s, dim) for s in SEGMENTS})


@dataclass
class Queries:
    """Queries of one length: ids, integers, statistics by level, lengths, and the score that a candidate needs at least so far."""

    ids: np.ndarray
    x: np.ndarray

    def __post_init__(self) -> None:
        self.stats = [statistics(self.x, s) for s in levels(self.x.shape[1])]
        self.size = np.linalg.norm(self.x.astype(np.float64), axis=1)
        self.least = np.full(len(self.ids), LOW, np.int64)


def kept(q: np.ndarray, score: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` best of each q: highest score, then smallest id."""
    order = np.lexsort((ids, -score, q))
    begin = np.searchsorted(q[order], q[order], "left")
    return order[np.arange(len(order)) - begin < top]


def products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, at_once: int = 1 << 16) -> np.ndarray:
    """Inner products of rows i of a and j of b."""
    return np.concatenate([np.zeros(0, np.int64), *[np.einsum("ij,ij->i", a[i[k : k + at_once]], b[j[k : k + at_once]]) for k in range(0, len(i), at_once)]])


def survivors(q: Queries, part: slice, x: np.ndarray, stats: list[np.ndarray], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) that no level rules out. A vector that is out for all queries of the part is not looked at on the next level."""
    slack = 1e-9 * q.size[part].max(initial=0) * size + 1e-6  # far above what rounding can do
    at, open_ = np.arange(len(x)), None
    for mine, theirs in zip(q.stats, stats):
        near = mine[part] @ theirs[at].T + slack[at] >= q.least[part][:, None]
        open_ = near if open_ is None else open_ & near
        some = open_.any(axis=0)
        at, open_ = at[some], open_[:, some]
    i, j = np.nonzero(open_)
    return i + part.start, at[j]


class Search:
    """The best candidates for the queries of a block, as (query, score, id), among the vectors seen."""

    def __init__(self, q: Queries, top: int) -> None:
        self.q, self.top = q, top
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def see(self, ids: np.ndarray, x: np.ndarray) -> None:
        q = self.q
        stats, size = [statistics(x, s) for s in levels(x.shape[1])], np.linalg.norm(x.astype(np.float64), axis=1)
        for begin in range(0, len(q.ids), QUERIES):
            i, j = survivors(q, slice(begin, min(begin + QUERIES, len(q.ids))), x, stats, size)
            other = q.ids[i] != ids[j]
            i, j = i[other], j[other]
            score = products(q.x, x, i, j)
            good = score >= q.least[i]
            both = [np.concatenate([a, b]) for a, b in zip(self.found, (i[good], score[good], ids[j[good]]))]
            best = kept(*both, self.top)
            self.found = tuple(a[best] for a in both)
            full = np.flatnonzero(np.bincount(self.found[0], minlength=len(q.ids)) >= self.top)
            worst = np.searchsorted(self.found[0], full, "right") - 1  # found is ordered by query, best first
            q.least[full] = np.maximum(q.least[full], self.found[1][worst])


def nearest(rows: DataFrame, top: int = TOP, every: int = EVERY, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by ``every`` the ``top`` other rows with the largest inner product: query_id, rank, vec_id, score; of
    equal scores the smaller id first.

    Components are the integers floor(256 * x). Vectors take part unless null, empty, with null or non-finite components, too long for 64-bit
    arithmetic (``integers.TOO_LONG``) or without an id. Vectors of different lengths are not compared. Rows that repeat an id are candidates each, but
    not for the query of that id; as a query the id counts once, with the smallest of its vectors (as bytes). Fewer candidates than ``top``: all. Empty
    table: no rows. Other columns are not looked at.

    Queries go in blocks of bounded size; each block is sent to all tasks, and each task looks at the vectors it reads, so nothing is shuffled but the
    best ``top`` a query and task. A pair is ruled out when the bound from its segments' means and deviations, coarse to fine, is below what the
    query already has; the rest get their exact product. First thresholds come from a bounded sample; they only save work, as every vector is looked at.
    """
    spark = rows.sparkSession
    all_rows = written(integer_vectors(rows, id_col, vec_col).filter("vec_id IS NOT NULL"), "vectors")
    asked = written(all_rows.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min_by(F.struct("dim", "vec"), "vec").alias("v")).select("vec_id", "v.*"), "queries")
    widest = all_rows.agg(F.max("dim")).first()[0] or 1
    some: dict[int, list] = {}
    for r in all_rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, SAMPLE // widest)).collect():  # bounded by SAMPLE components
        some.setdefault(r["dim"], []).append(r)
    path = new_path(spark, "nearest")
    schema = "query_id long, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)

    def run_block(block: dict[int, list]) -> None:
        queries = {d: Queries(np.array([r["vec_id"] for r in g]), np.frombuffer(b"".join(bytes(r["vec"]) for r in g), "<i8").reshape(-1, d)) for d, g in block.items()}
        for d, q in queries.items():
            if d in some:
                s = Search(q, top)
                ids, x = np.array([r["vec_id"] for r in some[d]]), np.frombuffer(b"".join(bytes(r["vec"]) for r in some[d]), "<i8").reshape(-1, d)
                for k in range(0, len(ids), VECTORS):
                    s.see(ids[k : k + VECTORS], x[k : k + VECTORS])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searches = {d: Search(q, top) for d, q in queries.items()}
            for b in batches:
                dims = b.column(1).to_numpy()
                for d, s in searches.items():
                    at = np.flatnonzero(dims == d)
                    for k in range(0, len(at), VECTORS):
                        these = pa.array(at[k : k + VECTORS])
                        s.see(b.column(0).take(these).to_numpy(), matrix(b.column(2).take(these), d))
            for s in searches.values():
                i, score, ids = s.found
                yield pa.RecordBatch.from_arrays([pa.array(s.q.ids[i]), pa.array(ids), pa.array(score)], names=["query_id", "vec_id", "score"])

        all_rows.mapInArrow(run, schema).write.mode("append").parquet(path)

    block: dict[int, list] = {}
    size = 0
    for r in asked.toLocalIterator():
        if size and size + r["dim"] > BLOCK:
            run_block(block)
            block, size = {}, 0
        block.setdefault(r["dim"], []).append(r)
        size += r["dim"]
    if size:
        run_block(block)
    dropped(asked)
    dropped(all_rows)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return spark.read.schema(schema).parquet(path).withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op12_segment_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM p) WHERE rank <= {TOP}
"""
