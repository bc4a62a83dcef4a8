"""Katz backoff scoring: Good-Turing discounted n-gram counts with exactly normalised backoff weights, in partitioned tables.

Words are numbered by an exact dictionary. Texts are cut into chunks, and what travels is a chunk's distinct words or n-grams, as packed
columns: a row a chunk and partition, never a row a token. Each order k from 2 on is one pass:

  deal      a chunk's distinct k-grams go to the partition of their context, with their training count in the chunk and the count of
            the (k-1)-gram that they end in, which the pass before has told the chunk
  add       a partition sums the counts, keeps them as the model's table of this order, and answers every chunk, n-gram by n-gram,
            with the count; for one that training lacks, with what the context's backoff weight is made of
  evaluate  after the last pass a chunk has every count and weight of its tokens and works out the recursion for each

Chunks and partitions have ``CHUNK`` and ``PART`` tokens however large the input, so a task's memory stays the same. A chunk sends a row only to
partitions that it has n-grams for: the rows that travel are tokens^2 / (CHUNK * PART) at most, and never more than the chunks' distinct
n-grams; they hold several thousand each as long as both sizes are in proportion to the square root of the input.
"""

from __future__ import annotations

import gc
import uuid
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, pick, table, written

#: Counts up to this are discounted.
KATZ = 5
#: Tokens of a chunk, and tokens that a partition of contexts is made for.
CHUNK, PART = 5 << 18, 1 << 20
END = b""  # no word is empty
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def squeezed(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def unsqueezed(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b)


def packed(a: np.ndarray) -> bytes:
    """Numbers from 0 on as bytes: as many bytes a number as the largest takes, grouped by significance and compressed."""
    if not len(a):
        return b""
    size = max(1, (int(a.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(a.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :size]
    return bytes([size]) + squeezed(planes.T.tobytes())


def unpacked(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(unsqueezed(b[1:]), np.uint8).reshape(b[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : b[0]] = planes.T
    return out.view("<i8").ravel()


def numbered(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of integers from 0 on, ascending, and each one's place among them. Value and place are sorted as one integer where they fit."""
    bits = max(len(a) - 1, 1).bit_length()
    if not len(a) or int(a.max()).bit_length() + bits > 63:
        own, at = np.unique(a, return_inverse=True)
        return own, at.astype(np.int32)
    both = a.astype(np.int64)  # worked on in place, for its size
    both <<= bits
    both |= np.arange(len(a))
    both.sort()
    place = (both & ((1 << bits) - 1)).astype(np.int32)
    both >>= bits
    new = np.empty(len(both), bool)
    new[0] = True
    np.not_equal(both[1:], both[:-1], out=new[1:])
    at = np.empty(len(both), np.int32)
    at[place] = np.cumsum(new, dtype=np.int32) - 1
    return both[new], at


def arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([pa.field(n, kinds[t]) for n, t in (x.split(" ") for x in ddl.split(", "))])


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for i in range(b.num_rows):
            yield tuple(c[i].as_py() for c in b.columns)


def by_first(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of equal first column, which come one after another."""
    at, held = None, []
    for r in rows_of(batches):
        if held and r[0] != at:
            yield at, held
            held = []
        at = r[0]
        held.append(r)
    if held:
        yield at, held


def discounts(n: list[int]) -> np.ndarray:
    """Factors for counts 0 to KATZ + 1 from n[r], the number of things counted r times (r from 1 to KATZ + 1); above KATZ the factor is 1.

    Katz's form of Good-Turing. Where it has no value between 0 and 1 (too few things were counted), half of one is taken off the count.
    """
    d = np.ones(KATZ + 2)
    top = (KATZ + 1) * n[KATZ + 1] / n[1] if n[1] else 1.0
    for r in range(1, KATZ + 1):
        x = ((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top) if n[r] and top < 1 else 0.0
        d[r] = x if 0 < x < 1 else 1 - 0.5 / r
    return d


class Unigrams:
    """P(w) = d(c) c / N; the mass left over is shared evenly by the unseen words, of which Chao's estimate says how many there are."""

    def __init__(self, total: int, kinds: int, n: list[int]):
        self.total, self.kinds, self.n, self.d = total, kinds, n, discounts(n)
        used = sum(self.d[r] * r * n[r] for r in range(1, KATZ + 1)) + total - sum(r * n[r] for r in range(1, KATZ + 1))
        self.unseen = max(1, round(n[1] ** 2 / (2 * n[2]))) if n[2] else max(1, n[1] * (n[1] - 1) // 2)
        self.left = (total - used) / total if total else 1.0
        if self.left <= 0:  # nothing was counted KATZ times or less: one count is set aside
            self.scale, self.left = total / (total + 1), 1 / (total + 1)
        else:
            self.scale = 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        seen = self.scale * self.d[np.minimum(c, KATZ + 1)] * c / max(self.total, 1)
        return np.where(c > 0, seen, self.left / self.unseen)


RANKS = ", ".join(f"r{r} long" for r in range(1, KATZ + 2))
CHUNKS = "chunk long, docs array<long>, lens binary, held binary, tokens binary, words binary, counts binary, n long, starts long"
WORDS = "p int, chunk long, words binary, at binary, counts binary"
ANSWERS = "p int, chunk long, a binary, b binary, c binary"
GRAMS = "p int, chunk long, context binary, runs binary, words binary, train binary, lower binary, cut binary"
NONE = (None,) * 8


@dataclass
class Model:
    """A fitted model: numbers, and the paths of its tables (``words``, and ``grams`` by order from 2 on), all partitioned by ``p``.

    ``words`` has rows WORDS (the words of partition p by falling count; the one at place i has the number i * parts + p + 1, and 0 is a text's
    beginning), ``grams`` rows GRAMS: contexts, their numbers of followers, the followers, their counts.
    """

    order: int
    parts: int
    starts: int
    total: int
    kinds: int
    ranks: list[list[int]]
    words: str = ""
    grams: list[str] = field(default_factory=list)

    @property
    def unigrams(self) -> Unigrams:
        return Unigrams(self.total, self.kinds, self.ranks[0])

    @property
    def most(self) -> int:
        """Training tokens of a context beyond which it is cut by its followers, so that no partition holds much more than its share."""
        return max(1024, self.total // (2 * self.parts))


def chunks(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, held, text) as chunks with local word numbers, one row each."""
    schema, size = arrow(CHUNKS), CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh() -> tuple:
            ids: defaultdict = defaultdict()
            ids.default_factory = ids.__len__
            return ids, array("i"), [], [], []

        def flush(made: int) -> pa.RecordBatch:
            t, n, out = np.frombuffer(tokens, np.int32), np.array(lens), np.array(held, bool)
            counts = np.bincount(t[~np.repeat(out, n)], minlength=len(ids))
            chunk = (TaskContext.get().partitionId() << 24) + made
            return batch([(chunk, docs_, packed(n), packed(out), packed(t), squeezed(b" ".join(ids)), packed(counts), int(n[~out].sum()), int((~out).sum()))], schema)

        made = 0
        ids, tokens, docs_, lens, held = fresh()
        for b in batches:
            for doc, out, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
                words.append(END)
                tokens.extend(map(ids.__getitem__, words))
                docs_.append(doc)
                lens.append(len(words))
                held.append(out)
                if len(tokens) >= size:
                    yield flush(made)
                    made += 1
                    ids, tokens, docs_, lens, held = fresh()
        if docs_:
            yield flush(made)

    return docs.mapInArrow(run, CHUNKS)


def dealt(rows: DataFrame, parts: int) -> DataFrame:
    """Rows with a column p to the tasks of their p, where they come one p after another."""
    return rows.repartition(parts, "p").sortWithinPartitions("p", "chunk")


def number_words(rows: DataFrame, parts: int, known: DataFrame | None) -> DataFrame:
    """Answers to each chunk of ``rows``: its words' numbers (a: places in the chunk, b: numbers, c: counts), and the table of words (chunk -1).

    ``known``, a table of words, adds its own counts; its words keep their numbers and no others are counted.
    """
    words, answers = arrow(WORDS), arrow(ANSWERS)
    fixed = known is not None

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, blob, counts in rows_of(batches):
            ws, c = np.array(unsqueezed(blob).split(b" "), object), unpacked(counts)
            p = np.array([xxhash.xxh3_64_intdigest(w) % parts for w in ws])
            order = np.argsort(p, kind="stable")
            ends = np.searchsorted(p[order], np.arange(parts + 1))
            yield batch([(k, chunk, squeezed(b" ".join(ws[i])), packed(i), packed(c[i])) for k in range(parts) if len(i := order[ends[k] : ends[k + 1]])], words)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, got in by_first(batches):
            ids: defaultdict = defaultdict()
            ids.default_factory = ids.__len__
            at = [np.fromiter(map(ids.__getitem__, unsqueezed(r[2]).split(b" ")), np.int64) for r in got]
            own = [not fixed or r[1] < 0 for r in got]
            total = np.bincount(np.concatenate(at), np.concatenate([unpacked(r[4]) * o for r, o in zip(got, own)]), len(ids)).astype(np.int64)
            names = np.array(list(ids), object)
            if fixed:  # the stored words come first (chunk -1), in the order of their places
                rank = np.arange(len(ids))
            else:
                order = np.array(sorted(range(len(ids)), key=lambda i: (-total[i], names[i])), np.int64)
                rank = np.empty(len(ids), np.int64)
                rank[order] = np.arange(len(order))
                yield batch([(p, -1, squeezed(b" ".join(names[order])), packed(total[order]), None)], answers)
            number = rank * parts + p + 1
            out = [(p, r[1], r[3], packed(number[i]), packed(total[i])) for r, i in zip(got, at) if r[1] >= 0]
            for k in range(0, len(out), 64):
                yield batch(out[k : k + 64], answers)

    sent = rows.select("chunk", "words", "counts").mapInArrow(deal, WORDS)
    return dealt(sent if known is None else sent.union(known), parts).mapInArrow(add, ANSWERS)


class Chunk:
    """A chunk's n-grams. ``at[k]`` numbers the k-gram that ends at each token; the others are by that number: ``context[k]`` (0: a text's
    beginning, else the number of the (k-1)-gram before it plus 1), ``word[k]``, ``suffix[k]`` (the (k-1)-gram it ends in), ``count[k]``
    in training and ``before[k]``, its context's. All follow from the chunk's row and the answers, so every pass finds the same numbers.
    """

    def __init__(self, lens: bytes, held: bytes, tokens: bytes, numbers: list, model: Model):
        self.model = model
        self.lens, self.held, t = unpacked(lens), unpacked(held).astype(bool), unpacked(tokens)
        n = sum(len(unpacked(x["a"])) for x in numbers)
        ids, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for x in numbers:
            at = unpacked(x["a"])
            ids[at], count[at] = unpacked(x["b"]), unpacked(x["c"])
        order = np.argsort(ids, kind="stable")
        label = np.empty(n, np.int32)
        label[order] = np.arange(n, dtype=np.int32)
        self.ids, self.begin = ids[order], np.cumsum(self.lens) - self.lens
        self.at, self.count = [None, label[t]], [None, count[order]]
        self.context, self.word, self.suffix, self.before = [[None, None] for _ in range(4)]
        self.zero: list = [None, None]

    def extend(self) -> None:
        """The n-grams of the next order."""
        last = self.at[-1]
        context = np.empty(len(last), np.int64)
        context[1:] = last[:-1] + 1
        context[self.begin] = 0
        context *= len(self.ids)
        context += self.at[1]
        own, at = numbered(context)
        suffix = np.empty(len(own), np.int32)
        suffix[at] = last
        self.context.append((own // max(len(self.ids), 1)).astype(np.int32))
        self.word.append((own % max(len(self.ids), 1)).astype(np.int32))
        self.suffix.append(suffix)
        self.at.append(at)
        self.before.append(np.concatenate([[self.model.starts], self.count[len(self.at) - 2]])[self.context[-1]])

    def contexts(self, k: int) -> list[np.ndarray]:
        """The word numbers of the contexts of order ``k``, a column a word."""
        return [np.concatenate([[0], x]) for x in ([self.ids] if k == 2 else [*(x[self.context[k - 1]] for x in self.contexts(k - 1)), self.ids[self.word[k - 1]]])]

    def places(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams that are sent, by partition, and where each partition's end. A context that training lacks has no n-grams to ask for."""
        parts, most = self.model.parts, self.model.most
        mix = np.zeros(int(self.context[k].max(initial=-1)) + 1, np.uint64)
        for x in self.contexts(k):
            mix = (mix ^ x[: len(mix)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mix ^= mix >> np.uint64(31)
        chosen = np.flatnonzero(self.before[k] > 0)
        cuts = -(-self.before[k][chosen] // most)
        p = ((mix[self.context[k][chosen]] % np.uint64(parts)).astype(np.int64) + self.ids[self.word[k][chosen]] % cuts * 7919) % parts
        by = np.argsort(p, kind="stable")
        return chosen[by], np.searchsorted(p[by], np.arange(parts + 1))

    def answer(self, k: int, answers: list, weights: bool = True) -> None:
        """Takes in the counts of order ``k``, and, with ``weights``, of n-grams that training lacks the context's numbers (``zero``: n-grams, followers by count, spent)."""
        sent, ends = self.places(k)
        count, zero = np.zeros(len(self.word[k]), np.int64), [(np.zeros(0, np.int64), np.zeros((KATZ, 0)), np.zeros(0))]
        for x in answers or []:
            j, c = sent[ends[x["p"]] : ends[x["p"] + 1]], unpacked(x["a"])
            count[j] = c
            z = j[c == 0] if weights else []
            if len(z):
                zero.append((z, unpacked(x["b"]).reshape(KATZ, -1), np.frombuffer(unsqueezed(x["c"]))))
        self.count.append(count)
        self.zero.append(tuple(np.concatenate(c, axis=-1) for c in zip(*zero)))


def deal_grams(k: int, model: Model) -> Callable:
    schema, parts, most = arrow(GRAMS), model.parts, model.most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, *row in rows_of(batches):
            out = blocks(chunk, row)  # the arrays of a chunk are gone before those of the next are made
            for at in range(0, len(out), 1024):
                yield batch(out[at : at + 1024], schema)

    def blocks(chunk: int, row: list) -> list[tuple]:
        c = Chunk(*row[:4], model)
        for j in range(2, k + 1):
            c.extend()
            if j < k:
                c.answer(j, row[2 + j], weights=False)
        token_train = np.repeat(~c.held, c.lens)
        train = np.bincount(c.at[k][token_train], minlength=len(c.word[k]))
        lower = c.count[1][c.word[k]] if k == 2 else c.count[k - 1][c.suffix[k]]
        heads = c.contexts(k)
        sent, ends = c.places(k)
        out = []
        for p in range(parts):
            i = sent[ends[p] : ends[p + 1]]
            if not len(i):
                continue
            context = c.context[k][i]
            change = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
            head = [x[context[change]] for x in heads]
            head[0] = np.diff(head[0], prepend=0)  # contexts ascend
            cut = c.before[k][i[change]] > most
            out.append((p, chunk, packed(np.concatenate(head)), packed(np.diff(np.append(change, len(i)))), packed(c.ids[c.word[k][i]]), packed(train[i]), packed(lower[i]), packed(cut)))
        return out

    return run


def read_grams(k: int, rows: list[tuple]) -> tuple[np.ndarray, ...]:
    """Rows GRAMS as columns: heads (k - 1, contexts), cut by head, head of each n-gram, word, train, lower, and n-grams by row."""
    heads, cuts, runs, cols, sizes = [], [], [], ([], [], []), []
    for _, _, head, run, words, train, lower, cut in rows:
        h = unpacked(head).reshape(k - 1, -1)
        h[0] = np.cumsum(h[0])
        heads.append(h)
        cuts.append(unpacked(cut))
        runs.append(unpacked(run))
        for c, x in zip(cols, (words, train, lower)):
            c.append(unpacked(x))
        sizes.append(len(cols[0][-1]))
    run = np.concatenate(runs)
    return np.concatenate(heads, axis=1), np.concatenate(cuts), np.repeat(np.arange(len(run)), run), *map(np.concatenate, cols), np.array(sizes)


def add_grams(k: int, model: Model) -> Callable:
    """Sums of a partition's n-grams. Out come the model's rows (kind 0), answers to chunks (kind 1), the parts of contexts that are cut (kind 2), and
    which chunks ask for those (kind 3).
    """
    schema, uni = arrow(SUMMED), model.unigrams
    d = discounts(model.ranks[k - 2]) if k > 2 else None
    none = (0,) * (KATZ + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, rows in by_first(batches):
            yield from one(p, rows)

    def one(p: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        names = [r[1] for r in rows]
        heads, cut, head, word, train, lower, sizes = read_grams(k, rows)
        del rows
        which = numbered(heads[0])[1]
        for x in heads[1:]:
            kinds, x = numbered(x)
            which = numbered(which.astype(np.int64) * len(kinds) + x)[1]
        kinds, word = numbered(word)
        word = which[head].astype(np.int64) * len(kinds) + word
        del head
        own, at = numbered(word)
        del word
        context, n = own // len(kinds), int(which.max()) + 1
        count = np.bincount(at, train, len(own)).astype(np.int64)
        low = np.empty(len(own), np.int64)
        low[at] = lower
        del lower, train
        seen = np.flatnonzero(count)
        spent = np.bincount(context[seen], uni.p(low[seen]) if k == 2 else d[np.minimum(low[seen], KATZ + 1)] * low[seen], n)
        followers = np.stack([np.bincount(context[count == r], minlength=n) for r in range(1, KATZ + 1)])
        place = np.empty(n, np.int64)
        place[which] = np.arange(len(which))
        is_cut = cut[place] > 0
        ranks = [int((count == r).sum()) for r in range(1, KATZ + 2)]
        ctx = context[seen]
        change = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(ctx) else np.zeros(0, np.int64)
        head = [x[place[ctx[change]]] for x in heads]
        first = np.lexsort(head[::-1]) if len(change) else change
        if len(change):  # contexts in ascending order of their numbers
            runs = np.diff(np.append(change, len(ctx)))
            order = np.repeat(change[first] - (np.cumsum(runs[first]) - runs[first]), runs[first]) + np.arange(len(ctx))
            head = [x[first] for x in head]
            cuts = is_cut[ctx[change[first]]]
            head[0] = np.diff(head[0], prepend=0)
            yield batch([(0, p, -1, packed(np.concatenate(head)), packed(runs[first]), packed(kinds[own[seen] % len(kinds)][order]), packed(count[seen][order]), packed(low[seen][order]), packed(cuts), None, 0.0, *ranks)], schema)
        out, begin = [], 0
        for name, size in zip(names, sizes):
            j = at[begin : begin + size]
            begin += size
            if name >= 0:
                zero = context[j[count[j] == 0]]
                out.append((1, p, name, packed(count[j]), packed(followers[:, zero].ravel()) if len(zero) else None, squeezed(spent[zero].tobytes()) if len(zero) else None, None, None, None, None, 0.0, *none))
                out += [(3, p, name, None, None, None, None, None, None, [int(x[place[c]]) for x in heads], 0.0, *none) for c in np.unique(zero[is_cut[zero]])]
            if len(out) >= 1024:
                yield batch(out, schema)
                out = []
        out += [(2, p, -1, None, None, None, None, None, None, [int(x[place[c]]) for x in heads], float(spent[c]), *(int(f) for f in followers[:, c]), 0) for c in np.flatnonzero(is_cut)]
        if out:
            yield batch(out, schema)

    return run


SUMMED = "kind int, p int, chunk long, a binary, b binary, c binary, d binary, e binary, f binary, context array<long>, spent double, " + RANKS
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def evaluate(model: Model) -> Callable:
    """The recursion for every token of a chunk. The last columns have, for each order, what the chunk asks of contexts that are cut: followers by count, and spent, over all their parts."""
    uni, d = model.unigrams, [None, *map(discounts, model.ranks)]
    result, r = arrow(RESULT), np.arange(1, KATZ + 1)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, *row in rows_of(batches):
            c = Chunk(*row[:4], model)
            p = uni.p(c.count[1])[c.at[1]]
            for k in range(2, model.order + 1):
                c.extend()
                c.answer(k, row[2 + k])
                z, followers, spent = c.zero[k]
                before = c.before[k][z]
                big = np.flatnonzero(before > model.most)
                if len(big):
                    heads = [x[c.context[k][z[big]]] for x in c.contexts(k)]
                    whole = {tuple(x["context"]): ([x[f"r{i}"] for i in range(1, KATZ + 1)], x["s"]) for x in row[1 + model.order + k]}
                    totals = [whole[key] for key in zip(*(x.tolist() for x in heads))]
                    followers, spent = followers.copy(), spent.copy()
                    followers[:, big], spent[big] = np.array([t[0] for t in totals]).T, [t[1] for t in totals]
                left = 1 - ((d[k][1 : KATZ + 1, None] * r * followers).sum(axis=0) + before - (r * followers).sum(axis=0)) / (before + 1.0)
                if k > 2:
                    spent = spent / (c.before[k - 1][c.suffix[k][z]] + 1.0)
                alpha = np.ones(len(c.word[k]))
                alpha[z] = left / (1 - spent)
                count = c.count[k]
                own = d[k][np.minimum(count, KATZ + 1)] * count / (c.before[k] + 1.0)
                p = np.where((count > 0)[c.at[k]], own[c.at[k]], alpha[c.at[k]] * p)
            n = c.count[1][c.at[1]]
            sums = lambda x: np.add.reduceat(x, c.begin) if len(c.begin) else x
            base = sums(np.log10(n + 1.0) - np.log10(uni.total + uni.kinds + 1))
            known, score = sums((n > 0).astype(np.int64)), sums(np.log10(p))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(c.held), pa.array(c.lens), pa.array(known), pa.array(np.full(len(docs), uni.total)), pa.array(base), pa.array(score)], schema=result)

    return run


class Tables:
    """Scratch tables bucketed by chunk, so that what belongs to a chunk is joined without a shuffle; dropped at the end."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.made, self.buckets = spark, [], buckets

    def add(self, rows: DataFrame) -> DataFrame:
        name, path = f"tidelog_katz_{uuid.uuid4().hex}", new_path(self.spark, "katz")
        rows.write.format("parquet").bucketBy(self.buckets, "chunk").option("path", path).saveAsTable(name)
        self.made.append((name, path))
        return self.spark.table(name)

    def answers(self, rows: DataFrame, name: str) -> DataFrame:
        """Answers (p, chunk, a, b, c) as one row a chunk."""
        rows = self.add(rows.select("p", "chunk", "a", "b", "c").repartition(self.buckets, "chunk"))
        return rows.groupBy("chunk").agg(F.collect_list(F.struct("p", "a", "b", "c")).alias(name))

    def forget(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self) -> None:
        for name, path in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.forget(path)

    def free(self) -> None:
        """Lets go of the shuffle files of passes that are over: they are deleted once their plans are garbage."""
        gc.collect()
        self.spark._jvm.System.gc()


HELD_OUT = "pmod(crc32(cast(coalesce(cast(doc_id as string), '') as binary)), 7) = 2"


def _passes(docs: DataFrame, model: Model | None, order: int, held_out: str, store: str) -> tuple[DataFrame, Model]:
    """Scores of ``docs``, by ``model`` or by one fitted on those of them that are not held out, whose tables then are under ``store``."""
    spark = docs.sparkSession
    # Some six bytes a token: about a chunk a bucket, so a task's share does not grow with the input.
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    tables = Tables(spark, max(size // (6 * CHUNK), 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    scratch: list[str] = []
    try:
        return _scored(docs, model, order, held_out, store, tables, scratch)
    finally:  # after a failure too
        tables.drop()
        for path in scratch:
            tables.forget(path)


def _scored(docs: DataFrame, model: Model | None, order: int, held_out: str, store: str, tables: Tables, scratch: list[str]) -> tuple[DataFrame, Model]:
    """``_passes``, with scratch tables in ``tables`` and other scratch folders in ``scratch``."""
    spark, given = docs.sparkSession, model
    rows = tables.add(chunks(docs.select("doc_id", F.expr(held_out).alias("held"), "text")))
    s = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("starts"), F.lit(0)).alias("starts")).first()
    parts = given.parts if given else -(-s["n"] // PART) or 1
    path = new_path(spark, "numbered") if given else f"{store}/words"
    known = spark.read.parquet(given.words).select("p", "chunk", F.col("a").alias("words"), F.lit(None).cast("binary").alias("at"), F.col("b").alias("counts")) if given else None
    number_words(rows, parts, known).withColumn("kind", F.when(F.col("chunk") < 0, 0).otherwise(1)).write.partitionBy("kind").parquet(path)
    numbered = spark.read.schema(f"{ANSWERS}, kind int").parquet(path)
    if not given:
        stats = numbered.filter("kind = 0").select("b").mapInArrow(_ranks, f"n long, v long, {RANKS}")
        t = stats.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", *(f"r{r}" for r in range(1, KATZ + 2)))]).first()
        counts = [0, *(t[f"r{r}"] for r in range(1, KATZ + 2))]
        model = Model(order, parts, s["starts"], t["n"], t["v"], [counts], f"{path}/kind=0")
    joined = rows.select("chunk", "docs", "lens", "held", "tokens").hint("merge").join(tables.answers(numbered.filter("kind = 1"), "a1"), "chunk")
    tables.forget(f"{path}/kind=1")
    columns, wholes = ["lens", "held", "tokens", "a1"], []
    scratch += [path] if given else []
    for k in range(2, model.order + 1):
        tables.free()
        sent = joined.select("chunk", *columns).mapInArrow(deal_grams(k, model), GRAMS)
        if given:
            sent = sent.union(spark.read.parquet(given.grams[k - 2]).select(*[F.col(a).alias(b) for a, b in zip(("p", "chunk", "a", "b", "c", "d", "e", "f"), [x.split()[0] for x in GRAMS.split(", ")])]))
        path = f"{store}/grams{k}" if not given else new_path(spark, "summed")
        dealt(sent, parts).mapInArrow(add_grams(k, model), SUMMED).write.partitionBy("kind").parquet(path)
        summed = spark.read.schema(SUMMED).parquet(path)
        if given:
            scratch.append(path)
        else:
            t = summed.filter("kind = 0").agg(*[F.coalesce(F.sum(f"r{r}"), F.lit(0)).alias(f"r{r}") for r in range(1, KATZ + 2)]).first()
            model.ranks.append([0, *(t[f"r{r}"] for r in range(1, KATZ + 2))])
            model.grams.append(f"{path}/kind=0")
        ranks = [f"r{r}" for r in range(1, KATZ + 1)]
        cut = summed.filter("kind = 2").groupBy("context").agg(F.sum("spent").alias("s"), *[F.sum(r).alias(r) for r in ranks])
        asked = summed.filter("kind = 3").select("chunk", "context").distinct().join(cut, "context")
        asked = tables.add(asked.select("chunk", F.struct("context", "s", *ranks).alias("x")).repartition(tables.buckets, "chunk"))
        wholes.append(asked.groupBy("chunk").agg(F.collect_list("x").alias(f"w{k}")))
        joined = joined.join(tables.answers(summed.filter("kind = 1"), f"a{k}"), "chunk", "left")
        columns.append(f"a{k}")
        if not given:
            for kind in (1, 3):
                tables.forget(f"{path}/kind={kind}")
    for k, w in enumerate(wholes, 2):
        joined = joined.join(w, "chunk", "left")
        columns.append(f"w{k}")
    return written(joined.select("docs", *columns).mapInArrow(evaluate(model), RESULT), "scores"), model


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (b,) in rows_of(batches):
        c = unpacked(b)
        c = c[c > 0]
        yield batch([(int(c.sum()), len(c), *(int((c == r).sum()) for r in range(1, KATZ + 2)))], arrow(f"n long, v long, {RANKS}"))


def katz_scores(docs: DataFrame, held_out: str = HELD_OUT, id_col: str = "doc_id", text_col: str = "text", order: int = 2, store: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the text).

    Tokens are words between ASCII white space with A-Z lower-cased, then one end. The model learns from the documents that ``held_out`` (SQL over
    doc_id) is not true of. P(w | h) is d(c) c(h, w) / (c(h) + 1) where training has w after the ``order`` - 1 words h, else a(h) P(w | h'), h' being h
    without its first word and a(h) such that the sum over all words is exactly 1; P(w | h) is P(w | h') where training lacks h. A text's
    beginning counts as a word before it. Words are told apart by themselves, not by a hash, and sums are double precision throughout.
    Null and empty texts are the end alone; a null id counts as an empty one for ``held_out``. Repeated rows are documents of their
    own. With no training text every token is an unseen word. Empty input: no rows. The model's tables stay under ``store``, if that is given.
    """
    return fit(docs, order, held_out, id_col, text_col, store)[0]


def fit(docs: DataFrame, order: int = 3, held_out: str = HELD_OUT, id_col: str = "doc_id", text_col: str = "text", store: str | None = None) -> tuple[DataFrame, Model]:
    """``katz_scores`` and the model, whose tables are under ``store`` (a new folder beside the other scratch tables if none is named)."""
    if order < 2:
        raise ValueError("an order of 2 at least")
    plain = pick(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    at = store or new_path(docs.sparkSession, "katz-model")
    scores, model = _passes(plain, None, order, held_out, at)
    return scores, model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` scored by a stored model, columns as in ``katz_scores``; all are held out."""
    plain = pick(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return _passes(plain, model, model.order, "true", "")[0]


def ngrams(spark: SparkSession, model: Model, k: int) -> DataFrame:
    """The model's table of order ``k`` as plain rows: context (word numbers, 0 for a text's beginning), word, count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            heads, _, head, word, count, _, _ = read_grams(k, [r])
            yield pa.RecordBatch.from_arrays([pa.array(list(heads[:, head].T), pa.list_(pa.int64())), pa.array(word), pa.array(count)], names=["context", "word", "count"])

    return spark.read.parquet(model.grams[k - 2]).select("p", "chunk", "a", "b", "c", "d", "e", "f").mapInArrow(run, "context array<long>, word long, count long")


def op9_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit(table(spark, sf_dir, "documents"), order=3)[0]
