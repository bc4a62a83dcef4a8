"""Order-independent fingerprints: the XOR of the first 12 bytes of each key's SHA-256, kept as three 32-bit lanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = ["fp0", "fp1", "fp2"]


def key_fingerprint(hlc: str | Column) -> Column:
    return F.substring(F.sha2(F.unhex(hlc), 256), 1, 24)


def lanes(fp: str | Column) -> list[Column]:
    return [F.conv(F.substring(fp, 1 + 8 * i, 8), 16, 10).cast("long").alias(n) for i, n in enumerate(LANES)]


def with_lanes(df: DataFrame, hlc: str = "hlc") -> DataFrame:
    """Adds the lanes. Worth storing with the log: a range's fingerprint then needs no hashing."""
    return df.withColumn("_fp", key_fingerprint(hlc)).select("*", *lanes("_fp")).drop("_fp")


def xor() -> list[Column]:
    """Aggregates that XOR the lanes; partial and final aggregates combine, and no rows give zero."""
    return [F.coalesce(F.bit_xor(n), F.lit(0).cast("long")).alias(n) for n in LANES]


def text() -> Column:
    return F.concat(*[F.lower(F.lpad(F.hex(n), 8, "0")) for n in LANES])
