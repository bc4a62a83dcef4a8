import random
import zlib

import numpy as np
import pytest

from tidelog.llm import packing as P

from .cases import LONG, ROWS, frame


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.default_vocabulary())


def test_encoder_is_the_tokenizer(tokenizer):
    rnd = random.Random(1)
    texts = [t for _, t in ROWS if t] + ["don't  x's", "<|endoftext|> a", "a\n\nb", " lead", "trail ", "a \nb", "x y", "a　b", "1a2 ٣x"]
    texts += ["".join(rnd.choice([" ", "\n", "a", "B", "1", "'", "é", "\t", ".", "s", "　", "_", "\r"]) for _ in range(25)) for _ in range(500)]
    e = P.encoder(P.default_vocabulary())
    for t in texts:
        assert e.whole(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t[:60]


def check(lengths, out, capacity=2048):
    seen = [np.zeros(n, int) for n in lengths]
    for s in out:
        n = sum(x[2] for x in s)
        assert n == capacity or n & (n - 1) == 0
        for d, a, k in s:
            assert k > 0
            seen[d][a : a + k] += 1
    assert all((x == 1).all() for x in seen)


def test_assignment_covers_each_token_once_without_padding():
    rnd = random.Random(2)
    for _ in range(100):
        lengths = [rnd.choice([1, rnd.randint(1, 60), rnd.randint(1, 9000)]) for _ in range(rnd.randint(0, 50))]
        check(lengths, P.assign(lengths, 2048, 1.0, 1 / 2048))


def test_costs_are_balanced():
    rnd = random.Random(3)
    lengths = [rnd.randint(20, 700) for _ in range(2000)]
    out = [s for s in P.assign(lengths, 2048, 1.0, 1 / 2048) if sum(x[2] for x in s) == 2048]
    spread = lambda seqs: np.std([sum(P.cost(x[2], 1.0, 1 / 2048) for x in s) for s in seqs])
    stream, at = [[]], 0
    for d, n in enumerate(lengths):  # cut in arriving order
        while n:
            take = min(n, 2048 - at)
            stream[-1].append((d, 0, take))
            n, at = n - take, at + take
            if at == 2048:
                stream.append([])
                at = 0
    assert spread(out) < spread([s for s in stream if s])


@pytest.mark.parametrize("block", [1 << 22, 3000])
def test_pieces_of_odd_rows(spark, tokenizer, block):
    got = P.pack(frame(spark), P.default_vocabulary(), block_tokens=block).collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in ROWS}
    times = {i: sum(j == i for j, _ in ROWS) for i, _ in ROWS}
    total = dict.fromkeys(ids, 0)
    sequences = {}
    for r in got:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        total[r["doc_id"]] += r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert total == {i: len(ids[i]) * times[i] for i in ids}
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == 2048 or at & (at - 1) == 0
    assert P.pack(frame(spark, []), P.default_vocabulary()).count() == 0


def test_long_text_is_packed_whole(spark, tokenizer):
    got = P.pack(frame(spark, [(6, LONG)]), P.default_vocabulary(), block_tokens=1000)
    assert got.agg({"length": "sum"}).first()[0] == len(tokenizer.encode(LONG).ids) + 1


def naive(lengths, capacity):
    """The rule in the plainest words: longest piece first, to the cheapest sequence with room, else cut to fill the roomiest."""
    total = sum(lengths)
    sizes = [capacity] * (total // capacity) + [1 << b for b in reversed(range(12)) if total % capacity >> b & 1]
    waiting = [(min(capacity, n - s), d, s) for d, n in enumerate(lengths) for s in range(0, n, capacity)]
    room, spent = list(sizes), [0.0] * len(sizes)
    while waiting:
        waiting.sort(key=lambda x: x[0])
        n, d, start = waiting.pop()
        fits = [i for i in range(len(sizes)) if room[i] >= n]
        i = min(fits, key=lambda i: (spent[i], i)) if fits else max(range(len(sizes)), key=lambda i: room[i])
        take = min(n, room[i])
        room[i] -= take
        spent[i] += P.cost(take, 1.0, 1 / capacity)
        if take < n:
            waiting.append((n - take, d, start + take))
    return sorted(spent)


def test_assignment_is_the_greedy_rule():
    rnd = random.Random(9)
    for _ in range(200):
        lengths = [rnd.randint(1, 40) for _ in range(rnd.randint(1, 30))]
        got = sorted(sum(P.cost(n, 1.0, 1 / 64) for *_, n in s) for s in P.assign(lengths, 64, 1.0, 1 / 64))
        whole = all(start == 0 and n == lengths[d] for s in P.assign(lengths, 64, 1.0, 1 / 64) for d, start, n in s)
        if whole:  # without cuts nothing is left to chance
            assert got == pytest.approx(naive(lengths, 64))
