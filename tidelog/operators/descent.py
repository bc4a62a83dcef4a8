"""Reconciliation of two stores in rounds of bounded size, by descending the fingerprints that they keep."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.log import dropped, materialised, scratch_path
from ..sources.store import LogStore

#: Ranges that a round opens, and ranges that it lists, at most; keys that it lists at most.
RANGES, KEYS = 8192, 1 << 20
#: Keys from which on a side's range is opened rather than listed.
LISTED = 256
#: Ranges that an open one is cut into by one more digit, and the digits of a key.
WIDTH, DIGITS = 16, 32

FOUND = "lacking string, hlc string"


@dataclass
class Round:
    """``opened`` ranges were cut into ``compared`` ones, whose fingerprints were compared; of ``listed`` ranges the keys of both sides, ``keys`` in all, were."""

    opened: int
    compared: int
    listed: int
    keys: int


@dataclass
class Descent:
    """``found`` (lacking: a or b, hlc) so far, the rounds so far, and what is still open: give ``cursor`` to ``descend`` again to go on. Nothing open: done."""

    found: DataFrame
    rounds: list[Round] = field(default_factory=list)
    cursor: dict[str, list] = field(default_factory=lambda: {"open": [["", 0, 0]], "few": []})

    @property
    def done(self) -> bool:
        return not self.cursor["open"] and not self.cursor["few"]


def descend(a: LogStore, b: LogStore, ranges: int = RANGES, keys: int = KEYS, listed: int = LISTED, max_rounds: int | None = None, cursor: dict[str, list] | None = None) -> Descent:
    """Finds the keys that either store lacks.

    A range is the keys with a common beginning; an open one is cut by its next digits, and of the pieces those stay that have different fingerprints or
    counts. A piece is listed when both sides have fewer than ``listed`` keys in it, or one has none at all and the other no more than a round may
    list; the rest are opened in turn, lowest first, so that what waits is a few times a round's ranges however many differences there are.

    A round opens and lists at most ``ranges`` ranges each and lists at most ``keys`` keys. Fingerprints come from the stores' directories (no inner rows are read);
    listed keys are compared by a join and written, never collected. After ``max_rounds`` it stops, to be continued by the cursor.
    """
    if keys < 2 * (listed - 1):
        raise ValueError(f"a round must be able to list one range: {2 * (listed - 1)} keys")
    spark, path = a.spark, scratch_path(a.spark, "differences")
    spark.createDataFrame([], FOUND).write.parquet(path)
    out = Descent(spark.read.schema(FOUND).parquet(path))
    if cursor is not None:
        out.cursor = {k: [list(x) for x in v] for k, v in cursor.items()}
    left, right = a.directory(), b.directory()
    while not out.done and (max_rounds is None or len(out.rounds) < max_rounds):
        open_, few = out.cursor["open"], out.cursor["few"]
        taken, open_ = open_[:ranges], open_[ranges:]
        pieces = _cut([p for p, _, _ in taken], ranges)
        if pieces:
            differ = _differing(left, right, pieces)
            short = lambda p, n, m: max(n, m) < listed or (min(n, m) == 0 and n + m <= keys) or len(p) >= DIGITS
            few += [x for x in differ if short(*x)]
            open_ = [x for x in differ if not short(*x)] + open_
        now, n = [], 0
        while few and len(now) < ranges and (n + few[0][1] + few[0][2] <= keys or not now):
            n += few[0][1] + few[0][2]
            now.append(few.pop(0)[0])
        if now:
            _list(left.within(now), right.within(now), a.hlc, b.hlc).write.mode("append").parquet(path)
        out.cursor = {"open": open_, "few": few}
        out.rounds.append(Round(len(taken), len(pieces), len(now), n))
    out.found = spark.read.schema(FOUND).parquet(path)
    return out


def _cut(prefixes: list[str], ranges: int) -> list[str]:
    """Pieces of ranges: by one digit, or by more where few ranges would be cut."""
    out = prefixes
    while prefixes and (out is prefixes or len(out) * WIDTH <= ranges):
        out = [p + d if len(p) < DIGITS else p for p in out for d in ("0123456789abcdef" if len(p) < DIGITS else "0")]
        if len(out[0]) >= DIGITS:
            break
    return out


def _differing(left, right, pieces: list[str]) -> list[list]:
    """(prefix, n at a, n at b) of the pieces that differ, in order; at most as many as there are pieces."""
    spans = materialised(left.spark.createDataFrame([(p, p + "g") for p in pieces], "lower string, upper string"), "pieces")
    x, y = left.fingerprints(spans).toDF("lower", "upper", "n_a", "fp_a"), right.fingerprints(spans).toDF("lower", "_u", "n_b", "fp_b")
    both = x.join(y, "lower").filter((F.col("n_a") != F.col("n_b")) | (F.col("fp_a") != F.col("fp_b")))
    got = sorted([r["lower"], r["n_a"], r["n_b"]] for r in both.select("lower", "n_a", "n_b").collect())
    dropped(spans)
    return got


def _list(x: DataFrame | None, y: DataFrame | None, hlc_a: str, hlc_b: str) -> DataFrame:
    none = lambda z: z.sparkSession.createDataFrame([], "hlc string")
    ours = none(y) if x is None else x.select(F.col(hlc_a).alias("hlc"))
    theirs = none(x) if y is None else y.select(F.col(hlc_b).alias("hlc"))
    both = ours.withColumn("_s", F.lit(1)).unionByName(theirs.withColumn("_s", F.lit(2))).groupBy("hlc").agg(F.sum("_s").alias("_s"))
    return both.filter("_s < 3").select(F.when(F.col("_s") == 1, "b").otherwise("a").alias("lacking"), "hlc")
