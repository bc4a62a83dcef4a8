"""Encodings that built-in functions can express: padded lengths, base64url, varints, flag bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def padme_length(n: str) -> Column:
    """The PADME length: all but the leading log log n bits of a length are rounded up."""
    return F.expr(
        f"CASE WHEN `{n}` <= 1 THEN CAST(`{n}` AS BIGINT) ELSE transform(array(greatest(0, length(bin(`{n}`)) - 1 - length(bin(length(bin(`{n}`)) - 1)))),"
        f" z -> (`{n}` + shiftleft(1L, z) - 1) & ~(shiftleft(1L, z) - 1))[0] END"
    )


def base64url(data: Column) -> Column:
    return F.translate(F.base64(data), "+/=\r\n", "-_")


def from_base64url(text: Column) -> Column:
    return F.unbase64(F.translate(text, "-_", "+/"))


def varint_size(n: str) -> Column:
    return F.expr(f"CAST(greatest(1, (length(bin(`{n}`)) + 6) div 7) AS BIGINT)")


def varint_hex(n: str) -> Column:
    """Seven bits a byte, the lowest first, the top bit of each but the last set; as hex."""
    size = f"greatest(1, (length(bin(`{n}`)) + 6) div 7)"
    return F.expr(f"lower(array_join(transform(sequence(0, CAST({size} AS INT) - 1), i -> lpad(hex((shiftright(`{n}`, 7 * i) & 127) + IF(i < {size} - 1, 128, 0)), 2, '0')), ''))")


def varint_at(data: str | Column, at: int | Column = 0) -> Column:
    """The number whose bytes begin at byte ``at`` of hex text: struct of value and size in bytes; null where the bytes end too soon or say more than 63 bits."""
    data, at = (F.col(data) if isinstance(data, str) else data), (F.lit(at) if isinstance(at, int) else at)
    byte = lambda i: F.conv(F.substr(data, (at + i) * 2 + 1, F.lit(2)), 16, 10).cast("long")
    every = F.transform(F.array(*map(F.lit, range(9))), byte)  # null beyond the end
    last = F.array_position(F.transform(every, lambda b: b < 128), F.lit(True)).cast("int")  # from 1; 0: none
    own = F.slice(every, 1, F.greatest(last, F.lit(1)))
    value = F.aggregate(F.reverse(own), F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 7) + b.bitwiseAND(127))
    return F.when(last > 0, F.struct(value.alias("value"), last.alias("size")))


def flag_bits(*flags: Column) -> Column:
    """Up to eight booleans as a byte, the first the lowest bit; null counts as false."""
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(flags)), F.lit(0)).cast("long")


def flag(bits: str, i: int) -> Column:
    return F.col(bits).bitwiseAND(1 << i) != 0
