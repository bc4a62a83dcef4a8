"""Cost-balanced packing of tokenised documents into fixed-length training sequences."""

from __future__ import annotations

import heapq
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table

#: Words whose ids a worker remembers; beyond it the memory starts anew. A worker lives on through later stages, and its memory with it.
REMEMBERED = 1 << 18

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


class Encoder(dict):
    """Text to ids (uint32) of a byte-level BPE vocabulary.

    ``whole`` gives the ids of a text as the tokenizers file has them: the contents of added tokens are those tokens, wherever they stand in
    the text. To ``ids`` they are ordinary text.

    The vocabulary is read from a ``tokenizers`` file; the merges run in ``tiktoken`` over the same vocabulary, whose ids are the same
    (a byte-level vocabulary numbers its tokens in merge order) and which is several times as fast. A text whose only white
    space is single spaces and newlines between words is cut there, where the split pattern always begins a new piece, and each
    word's ids are remembered; any other text is encoded as one string.
    """

    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that look at what stands beside them are not supported")
        self.added = {c: np.array([i], "<u4") for c, i in special.items()}
        self.between = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        encoding = tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode, self.piece = encoding.encode_ordinary, encoding._core_bpe.encode_single_piece

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        spaced = word if word[0] == "\n" else " " + word
        ids = array("I", self.piece(spaced.encode()) if word.isascii() and word.isalpha() else self.encode(spaced)).tobytes()
        self[word] = ids
        return ids

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if " ".join(text.split()) != text.replace("\n", " "):
            return np.array(self.encode(text), "<u4")
        first, *rest = text.replace("\n", " \n").split(" ")
        return np.frombuffer(np.array(self.encode(first), "<u4").tobytes() + b"".join(map(self.__getitem__, rest)), "<u4")

    def whole(self, text: str) -> np.ndarray:
        if not self.between or not self.between.search(text):
            return self.ids(text)
        return np.concatenate([self.added[t] if i % 2 else self.ids(t) for i, t in enumerate(self.between.split(text))])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cost(length: int, linear: float, quadratic: float) -> float:
    return linear * length + quadratic * length * length


def assign(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) for documents of these lengths.

    Documents longer than a sequence are cut at multiples of ``capacity``; the pieces go in descending order of length, each to the
    sequence of lowest cost that still has room for it. There are as many sequences as full ones are needed: when none has room,
    the piece is cut to fill the roomiest, and the rest takes its place in the order. The tokens beyond the last full sequence go
    to sequences whose lengths are powers of two (the binary digits of their count), which need no padding.
    """
    total = sum(lengths)
    sizes = [capacity] * (total // capacity) + [1 << b for b in reversed(range((total % capacity).bit_length())) if total % capacity >> b & 1]
    waiting: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    for doc, n in enumerate(lengths):
        for start in range(0, n, capacity):
            waiting[min(capacity, n - start)].append((doc, start))
    room, spent = list(sizes), [0.0] * len(sizes)
    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    parked: list[list[int]] = [[] for _ in range(capacity + 1)]
    for s, n in enumerate(sizes):
        parked[n].append(s)
    open_: list[tuple[float, int]] = []
    low, roomiest = capacity + 1, capacity
    for n in range(capacity, 0, -1):
        while low > n:  # sequences with room for a piece of this length
            low -= 1
            for s in parked[low]:
                heapq.heappush(open_, (spent[s], s))
            parked[low] = []
        roomiest = min(roomiest, n - 1)
        while waiting[n]:
            doc, start = waiting[n].pop()
            while open_ and room[open_[0][1]] < n:
                s = heapq.heappop(open_)[1]
                parked[room[s]].append(s)
                roomiest = max(roomiest, room[s])
            if open_:
                s, take = heapq.heappop(open_)[1], n
            else:
                while not parked[roomiest]:
                    roomiest -= 1
                s, take = parked[roomiest].pop(), roomiest
                waiting[n - take].append((doc, start + take))
            out[s].append((doc, start, take))
            room[s] -= take
            spent[s] += cost(take, linear, quadratic)
            if room[s] >= n:
                heapq.heappush(open_, (spent[s], s))
            elif room[s]:
                parked[room[s]].append(s)
                roomiest = max(roomiest, room[s])
    return out


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 1, linear: float = 1.0, quadratic: float = 1 / 2048, block_tokens: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cost (of the piece).

    A document is the ids of its text (added tokens in it included, see ``Encoder.whole``), then ``end_id``; a null or empty text is the end id alone. Each task packs the documents it
    reads as they come, ``block_tokens`` tokens at a time (a longer document is a block of its own), so nothing is shuffled, no key
    can be hot and memory is bounded by a block and the longest document. sequence_id is the partition's number times 2**32 plus a
    count, unique over the result. Ties go to the sequence made first. Repeated rows are packed each on its own; a null id stays
    null. Empty input: no rows. Extra columns are not looked at. ``vocabulary`` is a tokenizers file that every executor can open.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def flush(docs_: list[tuple[int | None, np.ndarray]], base: int) -> tuple[pa.RecordBatch, int]:
        cols: list[list] = [[] for _ in range(8)]
        placed = assign([len(i) for _, i in docs_], capacity, linear, quadratic)
        for k, pieces in enumerate(placed):
            offset = 0
            for d, start, n in pieces:
                doc, ids = docs_[d]
                for c, v in zip(cols, (doc, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), base + k, offset, cost(n, linear, quadratic))):
                    c.append(v)
                offset += n
        kinds = [pa.int64()] * 7 + [pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")]), base + len(placed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, base = encoder(vocabulary), TaskContext.get().partitionId() << 32
        held: list[tuple[int | None, np.ndarray]] = []
        tokens = 0
        for b in batches:
            for doc, text in zip(b.column(0), b.column(1)):
                ids = np.append(enc.whole(text.as_py() or ""), np.uint32(end_id))
                if tokens and tokens + len(ids) > block_tokens:
                    out, base = flush(held, base)
                    yield out
                    held, tokens = [], 0
                held.append((doc.as_py(), ids))
                tokens += len(ids)
        if held:
            yield flush(held, base)[0]

    return pick(docs, id_col, text_col).select(F.col(id_col).cast("long"), text_col).mapInArrow(run, SCHEMA)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_vocabulary())
