"""Range-based reconciliation of two replicas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fingerprint as FP
from ..sources.log import materialised, small
from . import ranges as R


@dataclass
class Difference:
    """What each side lacks, and how many keys each round looked at."""

    missing_at_a: DataFrame
    missing_at_b: DataFrame
    rounds: list[int]


def compare(a: DataFrame, b: DataFrame, k: int = R.BUCKETS, key: str = "hlc") -> DataFrame:
    """a's balanced ranges with both sides' counts and fingerprints: range_idx, lower, upper, n_a, n_b, fp_a, fp_b, differs.

    Ranges are half open, from one bucket's first key to the next one's; the first has no lower bound and the last no upper one. b's keys are
    placed by the k - 1 inner bounds, which are literals of the plan.
    """
    ours = R.balanced_summary(a, k, key)
    bounds = [r["lower"] for r in ours.filter("bucket > 0").select("lower").orderBy("lower").collect()]  # k - 1 at most
    place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= F.col(key))) if bounds else F.lit(0)
    placed = FP.with_lanes(b, key).withColumn("bucket", place.cast("long"))
    theirs = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_b"), *FP.xor()).select("bucket", "n_b", FP.text().alias("fp_b"))
    out = ours.join(theirs, "bucket", "full_outer")
    lower = F.when(F.col("bucket") > 0, F.col("lower")).alias("lower")
    cols = [F.col("bucket").alias("range_idx"), lower, "upper", F.coalesce("n", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"), F.coalesce("fp", F.lit("0" * 24)).alias("fp_a"), F.coalesce("fp_b", F.lit("0" * 24)).alias("fp_b")]
    return out.select(*cols).withColumn("differs", (F.col("fp_a") != F.col("fp_b")) | (F.col("n_a") != F.col("n_b")))


def equal(a: DataFrame, b: DataFrame, key: str = "hlc") -> bool:
    """Whether two replicas hold the same keys, by fingerprint and count: one aggregate a side."""
    f = lambda x: FP.with_lanes(x, key).agg(F.count(F.lit(1)).alias("n"), *FP.xor()).first()
    return f(a) == f(b)


def reconcile(a: DataFrame, b: DataFrame, k: int = R.BUCKETS, listed: int = R.LISTED, max_rounds: int = 10, key: str = "hlc") -> Difference:
    """Finds what either replica lacks by descending only into ranges that differ, down to those of ``listed`` keys, which are listed.

    The keys of both sides are placed once, in order, and cut into leaves of ``listed`` places; a leaf has a fingerprint a side, and a range of
    the rounds before is ``k`` ranges of the next, so its fingerprints are those of its leaves combined, by division of the leaf's number.
    Rounds work on the small table of leaves, however the differences are spread; of the keys, only those of differing leaves are looked
    at again. With more levels than ``max_rounds``, the upper ones are left out.
    """
    side = lambda x, i: x.select(key).distinct().withColumn("_s", F.lit(1 << i))
    keys = side(a, 0).unionByName(side(b, 1)).groupBy(key).agg(F.sum("_s").alias("_s"))
    placed = R.with_position(keys, key).withColumn("_leaf", F.floor(F.col("pos") / listed).cast("long"))
    placed = materialised(placed.select(key, "_s", "_leaf"), "placed")
    lanes = FP.with_lanes(placed, key)
    of_side = lambda i: [F.bit_xor(F.when(F.col("_s").bitwiseAND(1 << i) != 0, F.col(n)).otherwise(F.lit(0).cast("long"))).alias(f"{n}_{i}") for n in FP.LANES]
    count = lambda i: F.count(F.when(F.col("_s").bitwiseAND(1 << i) != 0, 1)).alias(f"n_{i}")
    leaves = materialised(lanes.groupBy("_leaf").agg(*of_side(0), *of_side(1), count(0), count(1)), "leaves")
    differs = (F.col("n_0") != F.col("n_1")) | F.concat_ws(":", *[f"{n}_0" for n in FP.LANES]).eqNullSafe(F.concat_ws(":", *[f"{n}_1" for n in FP.LANES])).__invert__()
    top = leaves.agg(F.max("_leaf").alias("m"), F.sum(F.col("n_0") + F.col("n_1")).alias("n")).first()
    sizes = [top["n"]] if top["n"] else []
    levels = [j for j in range(1, max_rounds) if top["n"] and k**j <= top["m"]]
    for j in reversed(levels):
        up = leaves.groupBy(F.floor(F.col("_leaf") / k**j)).agg(*[F.bit_xor(f"{n}_{i}").alias(f"{n}_{i}") for n in FP.LANES for i in (0, 1)], *[F.sum(f"n_{i}").alias(f"n_{i}") for i in (0, 1)])
        open_ = up.filter(differs).agg(F.sum(F.col("n_0") + F.col("n_1"))).first()[0] or 0
        if not open_:
            break
        sizes.append(open_)
    rest = placed.join(small(materialised(leaves.filter(differs).select("_leaf"), "differing")), "_leaf", "left_semi")
    return Difference(rest.filter("_s = 2").select(key), rest.filter("_s = 1").select(key), sizes)
