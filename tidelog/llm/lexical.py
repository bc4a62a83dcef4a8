"""Ranked lexical search by sort-based accumulation: matched (item, document, impact) entries are concatenated, radix-sorted by packed key and summed up."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, new_path, pick, table, written

#: (item, term) pairs and items of one block of queries at most (an item with more pairs is a block of its own). A block is sent to every task.
PAIRS, ITEMS = 1 << 18, 1 << 16
#: Entries that a task sorts at a time, at most (or those of one document, which has no more than a block has pairs), and documents.
ENTRIES, SLOTS = 1 << 20, 1 << 16
#: Documents that an item gets.
TOP = 20
#: Letters A-Z in lower case, digits, a-z and all bytes of characters beyond ASCII; everything else separates terms.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return (text or b"").translate(PLAIN).split()


@dataclass
class Block:
    """Some of the items: ``terms`` numbers the terms, and items ``items[at[t]:at[t + 1]]`` (places in ``ids``) hold term t ``times`` times each."""

    ids: list[int | None] = field(default_factory=list)
    terms: dict[bytes, int] = field(default_factory=dict)
    pairs: list[tuple[int, int, int]] = field(default_factory=list)

    def add(self, item: int | None, terms: list[bytes], times: list[int]) -> None:
        at = len(self.ids)
        self.ids.append(item)
        self.pairs += [(self.terms.setdefault(bytes(t), len(self.terms)), at, n) for t, n in zip(terms, times)]

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = np.array(self.pairs, np.int64).reshape(-1, 3)
        p = p[np.argsort(p[:, 0], kind="stable")]
        return np.searchsorted(p[:, 0], np.arange(len(self.terms) + 1)), p[:, 1], p[:, 2]


def blocks(items: DataFrame) -> Iterator[Block]:
    """The items cut into blocks, one at a time on the driver. Rows: id, terms, times."""
    block = Block()
    for r in items.toLocalIterator():
        if block.ids and (len(block.pairs) + len(r["terms"]) > PAIRS or len(block.ids) == ITEMS):
            yield block
            block = Block()
        block.add(r["item_id"], r["terms"], r["times"])
    if block.ids:
        yield block


def lists(of: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, of)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*of, np.zeros(0, np.int32)]).astype(np.int32)))


def matched(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of the documents (doc_id, text) that have any term: n counts all terms, the arrays hold those of ``terms``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, keys, times = [], [], []
            for text in b.column(1).cast(pa.binary()):
                found = terms_of(text.as_py())
                counts = Counter(map(terms.get, found))
                counts.pop(None, None)
                size.append(len(found))
                keys.append(np.fromiter(counts.keys(), np.int32, len(counts)))
                times.append(np.fromiter(counts.values(), np.int32, len(counts)))
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), lists(keys), lists(times)], names=["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(np.array(size) > 0))

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def radix_order(key: np.ndarray) -> np.ndarray:
    """The stable order of unsigned 32-bit keys, by 16-bit digits from the lowest (numpy sorts 16-bit integers by radix). A digit that is in order is passed over."""
    order = None
    for shift in (0, 16):
        digit = (key >> np.uint32(shift)).astype(np.uint16)
        digit = digit if order is None else digit[order]
        if (digit[1:] < digit[:-1]).any():
            by = np.argsort(digit, kind="stable")
            order = by if order is None else order[by]
    return np.arange(len(key)) if order is None else order


def accumulated(item: np.ndarray, slot: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the impacts of equal (item, slot), by item and slot."""
    key = (item.astype(np.uint32) << np.uint32(16)) | slot.astype(np.uint32)
    order = radix_order(key)
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return (key[starts] >> np.uint32(16)).astype(np.int64), (key[starts] & np.uint32(0xFFFF)).astype(np.int64), np.add.reduceat(impact[order], starts)


class Heaps:
    """For each item the ``top`` best documents so far; ``floor`` is the score that a document needs at least to be looked at."""

    def __init__(self, items: int, top: int) -> None:
        self.top, self.heaps, self.floor = top, [[] for _ in range(items)], np.ones(items, np.int64)

    def offer(self, item: np.ndarray, score: np.ndarray, doc: list[int | None]) -> None:
        for i, s, d in zip(item.tolist(), score.tolist(), doc):
            heap, entry = self.heaps[i], (s, -(1 << 63) if d is None else -d)  # of equal scores the smallest id is the best, none the worst
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.top:
                self.floor[i] = heap[0][0]


def best(rows: DataFrame, block: Block, n_docs: int, n_terms: int, df: dict[int, int], top: int) -> DataFrame:
    """(item_id, doc_id, score): of the rows of ``matched`` that a task reads, the best for each item of the block."""
    at, items, times = block.arrays()
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(block.terms))], np.int64)
    ids = block.ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(len(ids), top)
        for b in batches:
            size = b.column(2).value_lengths().to_numpy()
            end = np.cumsum(size)
            term, tf = (b.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
            m = 100 - 25 + (25 * b.column(1).to_numpy() * n_docs) // n_terms
            slot = np.repeat(np.arange(b.num_rows), size)
            impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[slot]))
            fan = at[term + 1] - at[term]
            entries = np.concatenate([[0], np.cumsum(fan)])
            upto = entries[end]  # of the documents so far
            first = 0
            while first < b.num_rows:
                last = int(np.searchsorted(upto, (upto[first - 1] if first else 0) + ENTRIES, "right"))
                last = min(max(last, first + 1), first + SLOTS)
                part = slice(end[first - 1] if first else 0, end[last - 1] if last else 0)
                many, n = fan[part], int(fan[part].sum())
                if n:
                    e = np.arange(n) + np.repeat(at[term[part]] - np.cumsum(many) + many, many)
                    item, doc, score = accumulated(items[e], np.repeat(slot[part] - first, many), np.repeat(impact[part], many) * times[e])
                    good = score >= heaps.floor[item]
                    heaps.offer(item[good], score[good], b.column(0).take(pa.array(doc[good] + first)).to_pylist())
                first = last
        out = [(ids[i], None if d == -(1 << 63) else -d, s) for i, heap in enumerate(heaps.heaps) for s, d in heap]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*out) if out else ((), (), ()))], names=["item_id", "doc_id", "score"])

    return rows.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``top`` documents with the highest score above 0 for each item: item_id, rank, doc_id, score; equal scores by ascending id.

    Terms are runs of ASCII letters, digits and characters beyond ASCII in the whole text, A-Z lower-cased. The score is the sum over an item's terms,
    repeats included, of integer weights of rarity times saturating counts with a length correction. Null and empty texts have no terms:
    such documents count nowhere, such items get no rows. Rows that repeat a document are documents each; a null id ranks after the others of
    its score. Rows that share an item's id are one item, with their smallest text. Empty tables: no rows. Other columns are not looked at.

    Items are taken in blocks of bounded size, each sent to all tasks. A pass over the documents counts, document by document, the terms of the block
    (and all terms); then each task concatenates an (item, document, impact) entry for every match, a bounded number at a time, sorts them by
    radix, adds up runs of equal keys and keeps the best of each item in a heap. What the tasks have kept is dealt by ranges of items and selected once more.
    A document lies in one task, so no entries are shuffled and a frequent term is no hot key.
    """
    spark = docs.sparkSession
    texts = pick(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [Counter(terms_of(t.as_py())) for t in b.column(1).cast(pa.binary())]
            arrays = [b.column(0), pa.array([list(c) for c in found], pa.list_(pa.binary())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["item_id", "terms", "times"]).filter(pa.array([bool(c) for c in found], pa.bool_()))

    wanted = pick(items, item_col, item_text).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    wanted = written(wanted.groupBy("item_id").agg(F.min("text").alias("text")).mapInArrow(count, "item_id long, terms array<binary>, times array<int>"), "items")
    path = new_path(spark, "ranked")
    spark.createDataFrame([], "item_id long, doc_id long, score long").write.parquet(path)
    for block in blocks(wanted):
        rows = written(matched(texts, block.terms), "matched")
        total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
        if total["n"]:
            df = {r["t"]: r["n"] for r in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}  # of the block's terms
            best(rows, block, total["n"], total["l"], df, top).write.mode("append").parquet(path)
        dropped(rows)
    dropped(wanted)
    found = spark.read.schema("item_id long, doc_id long, score long").parquet(path).repartitionByRange("item_id")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op11_sorted_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_UPPER = "".join(map(chr, range(65, 91)))
_TERMS = rf"""regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
ORACLE = f"""
WITH q AS MATERIALIZED (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
d AS MATERIALIZED (SELECT doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
s AS MATERIALIZED (SELECT count(*) AS n, sum(len(terms))::BIGINT AS l FROM d WHERE len(terms) > 0),
p AS MATERIALIZED (SELECT doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS MATERIALIZED (SELECT term, floor(1000 * ln((2 * (SELECT n FROM s) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p GROUP BY term),
i AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * p.n * s.n) // s.l))) AS impact FROM p JOIN w USING (term), s),
r AS (SELECT item_id, doc_id, sum(impact * qtf)::BIGINT AS score FROM i JOIN q USING (term) GROUP BY item_id, doc_id HAVING sum(impact * qtf) > 0)
SELECT item_id, rank, doc_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM r) WHERE rank <= {TOP}
"""
