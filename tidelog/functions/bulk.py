"""Sealing and opening for all rows of a batch at once: the codec and the cipher of ``wire`` over arrays.

Bytes are arrays of uint8, a row each. What is written equals, byte for byte, what ``wire`` writes row by row. Of forms that are rare in a column, a value is
written by ``wire``, once for all rows that have it; rows that say something unusual when they are read are left to ``wire`` too (``Readers.odd``).
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import wire as W

# ---- columns of bytes


def binary(rows: np.ndarray, sizes: np.ndarray | None = None) -> pa.Array:
    """An Arrow column of the rows, or of the first ``sizes`` bytes of each."""
    n, width = rows.shape
    if sizes is None:
        ends, data = np.arange(n + 1, dtype=np.int32) * width, np.ascontiguousarray(rows)
    else:
        ends, data = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), rows[np.arange(width) < sizes[:, None]]
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _offsets(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]


def sizes_of(column: pa.Array) -> np.ndarray:
    return np.diff(_offsets(column)) if len(column) else np.zeros(0, np.int32)


def matrix(column: pa.Array) -> np.ndarray:
    """The bytes of a column without nulls whose values are all of one size."""
    at = _offsets(column)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].reshape(len(column), (at[-1] - at[0]) // len(column))


def taken(column: pa.Array, at: np.ndarray) -> pa.Array:
    """The values at ascending positions."""
    return column if len(at) == len(column) else column.take(pa.array(at))


def by_size(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and bytes of the values of each size."""
    sizes = sizes_of(column)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, matrix(taken(column, at))


def in_order(parts: list[tuple[np.ndarray, pa.Array]]) -> pa.Array:
    """One column of parts in the order of their positions."""
    if len(parts) == 1:
        return parts[0][1]
    return pa.concat_arrays([p for _, p in parts]).take(pa.array(np.argsort(np.concatenate([at for at, _ in parts]))))


_NIBBLES = np.full(256, 255, np.uint8)
for _i, _c in enumerate("0123456789abcdef"):
    _NIBBLES[ord(_c)] = _NIBBLES[ord(_c.upper())] = _i


def stamps(hlc: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 16 bytes of each text timestamp, and at which positions there is one."""
    out, good = np.zeros((len(hlc), 16), np.uint8), np.zeros(len(hlc), bool)
    for at, text in by_size(hlc):
        if text.shape[1] == 32:
            x = _NIBBLES[text]
            out[at], good[at] = x[:, ::2] << 4 | x[:, 1::2], (x < 16).all(1)
    return out, good


# ---- XChaCha20-Poly1305


def _rounds(x: list[np.ndarray]) -> None:
    """The twenty rounds on words that are columns, in place."""
    t = np.empty_like(x[0])

    def quarter(a: int, b: int, c: int, d: int) -> None:
        for p, q, r, n in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
            p, q, r = x[p], x[q], x[r]
            np.add(p, q, out=p)
            np.bitwise_xor(r, p, out=r)
            np.left_shift(r, np.uint32(n), out=t)
            np.right_shift(r, np.uint32(32 - n), out=r)
            np.bitwise_or(r, t, out=r)

    for _ in range(10):
        for i in range(4):
            quarter(i, 4 + i, 8 + i, 12 + i)
        for i in range(4):
            quarter(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4)


def _words(rows: np.ndarray) -> np.ndarray:
    """Columns of little-endian words."""
    return np.ascontiguousarray(np.ascontiguousarray(rows).view("<u4").T).astype(np.uint32, copy=False)


def _bytes(words: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(words.T).astype("<u4", copy=False).view(np.uint8)


def _state(n: int, key: np.ndarray, rest: np.ndarray) -> np.ndarray:
    s = np.empty((16, n), np.uint32)
    s[:4], s[4:12], s[12:] = np.array(W._CONSTANTS, np.uint32)[:, None], key, rest
    return s


def _stream(key: bytes, nonces: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row's nonce of 24 bytes the key of its tag, and as many bytes as are to be sealed."""
    n, blocks = len(nonces), 1 + -(-size // 64)
    nonce = _words(nonces)
    s = _state(n, np.frombuffer(key, "<u4")[:, None], nonce[:4])
    _rounds(list(s))
    rest = np.zeros((4, blocks, n), np.uint32)
    rest[0], rest[2], rest[3] = np.arange(blocks, dtype=np.uint32)[:, None], nonce[4], nonce[5]
    s = _state(blocks * n, np.tile(np.concatenate([s[:4], s[12:]]), blocks), rest.reshape(4, -1))
    x = s.copy()
    _rounds(list(x))
    out = _bytes(x + s).reshape(blocks, n, 64)
    return out[0, :, :32], np.concatenate(list(out[1:]), 1)[:, :size] if blocks > 1 else np.empty((n, 0), np.uint8)


def poly1305(keys: np.ndarray, messages: np.ndarray) -> np.ndarray:
    """The tags of messages of one size, a multiple of 16; numbers are five limbs of 26 bits."""
    u, low = np.uint64, np.uint64((1 << 26) - 1)

    def limbs(pair: np.ndarray) -> list[np.ndarray]:
        lo, hi = pair[:, 0], pair[:, 1]
        return [lo & low, lo >> u(26) & low, (lo >> u(52) | hi << u(12)) & low, hi >> u(14) & low, hi >> u(40)]

    key = np.ascontiguousarray(keys).view("<u8").astype(u, copy=False)
    r = limbs(key[:, :2] & np.array([0x0FFFFFFC0FFFFFFF, 0x0FFFFFFC0FFFFFFC], u))
    r5 = [x * u(5) for x in r]
    words = np.ascontiguousarray(messages).view("<u8").astype(u, copy=False)
    h = [np.zeros(len(keys), u) for _ in range(5)]
    for i in range(0, words.shape[1], 2):
        h = [a + b for a, b in zip(h, limbs(words[:, i : i + 2]))]
        h[4] += u(1 << 24)
        d = [sum(h[j] * (r[k - j] if j <= k else r5[5 + k - j]) for j in range(5)) for k in range(5)]
        carry = u(0)
        for k in range(5):
            d[k] = d[k] + carry
            carry, d[k] = d[k] >> u(26), d[k] & low
        d[0] = d[0] + carry * u(5)
        d[1], d[0] = d[1] + (d[0] >> u(26)), d[0] & low
        h = d
    for _ in range(2):
        carry = u(0)
        for k in range(5):
            h[k] = h[k] + carry
            carry, h[k] = h[k] >> u(26), h[k] & low
        h[0] = h[0] + carry * u(5)
    carry, less = u(5), []
    for k in range(5):  # h - (2**130 - 5), if that is not negative
        x = h[k] + carry
        carry = x >> u(26)
        less.append(x & low)
    h = [np.where(carry > 0, b, a) for a, b in zip(h, less)]
    lo, hi = h[0] | h[1] << u(26) | h[2] << u(52), h[2] >> u(12) | h[3] << u(14) | h[4] << u(40)
    first = lo + key[:, 2]
    return np.stack([first, hi + key[:, 3] + (first < lo)], 1).astype("<u8", copy=False).view(np.uint8)


def _tags(keys: np.ndarray, sealed: np.ndarray) -> np.ndarray:
    n, size = sealed.shape
    end = np.frombuffer(bytes(-size % 16) + struct.pack("<QQ", 0, size), np.uint8)
    return poly1305(keys, np.concatenate([sealed, np.broadcast_to(end, (n, len(end)))], 1))


def seal(key: bytes, nonces: np.ndarray, plain: np.ndarray) -> np.ndarray:
    tag_keys, stream = _stream(key, nonces, plain.shape[1])
    sealed = plain ^ stream
    return np.concatenate([sealed, _tags(tag_keys, sealed)], 1)


def unseal(key: bytes, nonces: np.ndarray, sealed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What was sealed, and whether the tag is right: where it is not, the bytes mean nothing."""
    tag_keys, stream = _stream(key, nonces, sealed.shape[1] - 16)
    return sealed[:, :-16] ^ stream, (_tags(tag_keys, sealed[:, :-16]) == sealed[:, -16:]).all(1)


# ---- writing changes


def varints(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and sizes of numbers of 0 to ``wire.MAX_INT``."""
    x, out, sizes = x.astype(np.uint64), np.empty((len(x), 8), np.uint8), np.ones(len(x), np.int64)
    for i in range(8):
        more = x > 127
        out[:, i] = x & np.uint64(127) | more.astype(np.uint64) << np.uint64(7)
        sizes += more
        x = x >> np.uint64(7)
    return out, sizes


def _each(x: np.ndarray, write: Callable[[object], bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and sizes of what ``write`` makes of each number, called once for equal ones."""
    found, where = np.unique(x, return_inverse=True)
    coded = [write(v) for v in found.tolist()]
    return np.array([list(c.ljust(width, b"\0")) for c in coded], np.uint8).reshape(-1, width)[where], np.array([len(c) for c in coded], np.int64)[where]


def integers(column: pa.Array) -> pa.Array:
    """``wire.value`` of whole numbers without nulls."""
    x = column.to_numpy(zero_copy_only=False)
    rows, sizes = varints(np.where(x < 0, 0, x))
    rows, sizes = np.concatenate([np.full((len(x), 1), W.NON_NEGATIVE_INT, np.uint8), rows], 1), sizes + 1
    rows = np.concatenate([rows, np.zeros((len(x), 1), np.uint8)], 1)
    rare = (x < 20) | (x > W.MAX_INT)
    rows[rare], sizes[rare] = _each(x[rare], W.value, 10)
    return binary(rows, sizes)


def numbers(column: pa.Array) -> pa.Array:
    """``wire.value`` of floating-point numbers or nulls."""
    null = column.is_null().to_numpy(zero_copy_only=False)
    x = pc.fill_null(column, 0.5).to_numpy(zero_copy_only=False)
    rows, sizes = np.empty((len(x), 10), np.uint8), np.full(len(x), 10, np.int64)
    rows[:, :2], rows[:, 2:] = (W.NUMBER, 0xCB), x.astype(">f8").view(np.uint8).reshape(-1, 8)
    rare = (x == np.floor(x)) & (x >= -(1 << 31)) & (x < 1 << 32)
    rows[rare], sizes[rare] = _each(x[rare], W.value, 10)
    rows[null, 0], sizes[null] = W.NULL, 1
    return binary(rows, sizes)


def strings(column: pa.Array) -> pa.Array:
    """``wire.string`` of texts, written once for equal ones."""
    d = column.dictionary_encode()
    return pa.array([W.string(s) for s in d.dictionary.to_pylist()], pa.binary()).take(d.indices)


def plain_inserts(table: str, stamp: np.ndarray, ids: np.ndarray, cells: list[tuple[pa.Array | str, pa.Array]]) -> pa.Array:
    """``wire.plain_change`` of rows put into one table: the names of cells (one for all rows, or a column), and their values as they are written."""
    parts: list = [pa.scalar(W.varint(W.VERSION), pa.binary()), binary(stamp), W.flags(True, False, False) + W.string(table), binary(ids), W.varint(len(cells))]
    for name, value in cells:
        parts += [W.string(name) if isinstance(name, str) else strings(name), value]
    out = pc.binary_join_element_wise(*[pa.scalar(p, pa.binary()) if isinstance(p, bytes) else p for p in parts], pa.scalar(b"", pa.binary()))
    found, where = np.unique(sizes_of(out), return_inverse=True)
    fill = np.array([W.padme(n) - n for n in found.tolist()])[where]
    return pc.binary_join_element_wise(out, binary(np.zeros((len(fill), int(fill.max(initial=0))), np.uint8), fill), pa.scalar(b"", pa.binary()))


def seal_changes(plain: pa.Array, key: bytes, nonces: np.ndarray) -> pa.Array:
    """``wire.seal_change`` of changes that are plain so far."""
    parts = []
    for at, rows in by_size(plain):
        head = np.frombuffer(W.varint(rows.shape[1] + 16), np.uint8)
        parts.append((at, binary(np.concatenate([nonces[at], np.broadcast_to(head, (len(at), len(head))), seal(key, nonces[at], rows)], 1))))
    return in_order(parts)


# ---- reading changes


class Readers:
    """Reads the same things from every row. A row that ends too early, or has what is not read here, is marked in ``odd``; what it gives means nothing."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows, self.each = rows, np.arange(len(rows))
        self.at, self.odd = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)

    def peek(self, i: int | np.ndarray = 0) -> np.ndarray:
        return self.rows[self.each, np.minimum(self.at + i, self.rows.shape[1] - 1)]

    def skip(self, n: int | np.ndarray) -> np.ndarray:
        """Where what is skipped begins."""
        before = self.at
        self.at = before + n
        self.odd |= self.at > self.rows.shape[1]
        self.at = np.minimum(self.at, self.rows.shape[1])
        return before

    def byte(self) -> np.ndarray:
        b = self.peek()
        self.skip(1)
        return b

    def varint(self, where: np.ndarray | bool = True) -> np.ndarray:
        """The number at each row of ``where``; the others stay where they are and give 0."""
        value, more = np.zeros(len(self.rows), np.int64), np.broadcast_to(where, self.at.shape)
        for i in range(8):
            if not more.any():
                return value
            b = self.peek()
            self.skip(more.astype(np.int64))
            value |= np.where(more, b & 127, 0).astype(np.int64) << 7 * i
            more = more & (b > 127)
        self.odd |= more | (value > W.MAX_INT)
        return value

    def string(self) -> tuple[np.ndarray, np.ndarray]:
        """Beginnings and sizes."""
        n = np.minimum(self.varint(), self.rows.shape[1] + 1)
        return self.skip(n), n

    def texts(self, at: np.ndarray, n: np.ndarray) -> pa.Array:
        """What ``string`` found, as a column of bytes."""
        width = int(n.max(initial=0))
        return binary(self.rows[self.each[:, None], np.minimum(at[:, None] + np.arange(width), self.rows.shape[1] - 1)], n)

    def texts_are(self, at: np.ndarray, n: np.ndarray, text: bytes) -> np.ndarray:
        same = self.rows[self.each[:, None], np.minimum(at[:, None] + np.arange(len(text)), self.rows.shape[1] - 1)] == np.frombuffer(text, np.uint8)
        return (n == len(text)) & same.all(1)

    def integer(self) -> np.ndarray:
        """A value that is a whole number of 0 or more."""
        tag = self.byte()
        long = tag == W.NON_NEGATIVE_INT
        self.odd |= (tag >= 20) & ~long
        return np.where(long, self.varint(long), tag)

    def number(self) -> tuple[np.ndarray, np.ndarray]:
        """A value that is a floating-point number or null, and whether it is null."""
        tag = self.byte()
        null, own = tag == W.NULL, tag == W.NUMBER
        self.odd |= ~null & ~own
        form = self.peek()
        raw = np.stack([self.peek(i) for i in range(1, 9)], 1).view(">u8").reshape(-1).astype(np.uint64)
        out, size = raw.view(np.float64).copy(), np.full(len(raw), 8)
        known = form == 0xCB
        for tags, n, signed in ((0xCC, 1, False), (0xCD, 2, False), (0xCE, 4, False), (0xD0, 1, True), (0xD1, 2, True), (0xD2, 4, True)):
            if (at := form == tags).any():
                whole = (raw[at].view(np.int64) if signed else raw[at]) >> (np.int64 if signed else np.uint64)(64 - 8 * n)
                out[at], size[at], known[at] = whole, n, True
        for at, less in ((form < 0x80, 0), (form >= 0xE0, 256)):
            out[at], size[at], known[at] = form[at].astype(np.float64) - less, 0, True
        self.odd |= own & ~known
        self.skip(np.where(own, 1 + size, 0))
        return out, null


def sealed_parts(data: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of sealed changes, by their size: positions, nonces, and what is sealed. Those that are too short or not of the length that they say are left out."""
    for at, rows in by_size(data):
        size = rows.shape[1]
        for head in (1, 2, 3, 4):
            n = size - 24 - head
            if n > 34 and len(want := W.varint(n)) == head:
                whole = (rows[:, 24 : 24 + head] == np.frombuffer(want, np.uint8)).all(1)
                if whole.any():
                    yield at[whole], rows[whole, :24], rows[whole, 24 + head :]
