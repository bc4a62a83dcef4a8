"""What a store keeps beside each segment: counts, bounds and fingerprints of its files and of key prefixes.

A segment's prefix tree has a node (number of keys, XOR lanes) for each key prefix of 2, 4, .. ``DEEPEST`` hex digits, below a node only where that has more than
``LEAF`` keys. So what lies before a bound is, a level at a time, what lies under the smaller siblings of the bound's prefix, and of one leaf the rows
before the bound; a range is the difference of its bounds, since counts subtract and XOR undoes itself. An append adds the nodes of its segment alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fingerprint as FP
from ..operators import ranges as R
from .log import dropped, materialised, small

#: Keys of a node that has no nodes below; digits of a level; digits of the deepest level, those of the milliseconds.
LEAF, STEP, DEEPEST = 1024, 2, 12
#: Edges of ranges up to which their rows are asked for as literal bounds, which a scan can use, beside the join.
LITERAL = 64

NODES = "depth int, prefix string, n long, fp0 long, fp1 long, fp2 long, leaf boolean"
FILES = "file string, n long, lo string, hi string"


def build(spark: SparkSession, segment: str, path: str, hlc: str) -> None:
    """Writes the nodes and files of a segment. A node's number of keys is the sum over its children, so one window over siblings says which are kept."""
    rows = spark.read.parquet(segment)
    base = FP.with_lanes(rows.select(F.col(hlc).alias("hlc"))).groupBy(F.substring("hlc", 1, DEEPEST).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), *FP.xor())
    depths = F.explode(F.array(*[F.lit(d) for d in range(STEP, DEEPEST + 1, STEP)]))
    every = base.withColumn("depth", depths).withColumn("prefix", F.expr("left(prefix, depth)")).groupBy("depth", "prefix").agg(F.sum("n").alias("n"), *FP.xor())
    above = F.sum("n").over(Window.partitionBy("depth", F.expr(f"left(prefix, depth - {STEP})")))
    kept = every.withColumn("above", above).filter((F.col("above") > LEAF) | (F.col("depth") == STEP))
    kept.select("depth", "prefix", "n", *FP.LANES, ((F.col("n") <= LEAF) | (F.col("depth") == DEEPEST)).alias("leaf")).write.parquet(f"{path}/nodes")
    files = rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n"), F.min(hlc).alias("lo"), F.max(hlc).alias("hi"))
    files.coalesce(1).write.parquet(f"{path}/files")  # a row a file


@dataclass
class Directory:
    """The directories of some segments of a store together."""

    spark: SparkSession
    store: str
    segments: list[str]
    hlc: str

    def _table(self, kind: str, schema: str) -> DataFrame:
        if not self.segments:
            return self.spark.createDataFrame([], f"{schema}, segment string")
        rows = self.spark.read.schema(schema).parquet(*[f"{self.store}/directory/{s}/{kind}" for s in self.segments])
        return rows.withColumn("segment", F.regexp_extract("_metadata.file_path", f"directory/([^/]+)/{kind}/", 1))

    @property
    def nodes(self) -> DataFrame:
        return self._table("nodes", NODES)

    @property
    def files(self) -> DataFrame:
        return self._table("files", FILES)

    def rows_of(self, paths: list[str]) -> DataFrame | None:
        return self.spark.read.parquet(*paths) if paths else None

    def paths(self, wanted: DataFrame) -> list[str]:
        """Full names of the distinct (segment, file) of ``wanted``: at most all files of the store."""
        return sorted(f"{self.store}/{r['segment']}/{r['file']}" for r in wanted.select("segment", "file").distinct().collect())

    def total(self) -> DataFrame:
        """One row: n and lanes of all keys."""
        return self.nodes.filter(F.col("depth") == STEP).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *FP.xor())

    def below(self, bounds: DataFrame) -> DataFrame:
        """(bound, n, lanes) of the keys below each distinct bound of ``bounds`` (bound, not null). What a level adds is worked out once for all bounds with the same
        beginning, by a running sum over the siblings, and a row a bound and level meets it.
        """
        bounds = bounds.select("bound").distinct()
        depth = F.explode(F.array(*[F.lit(d) for d in range(STEP, DEEPEST + 1, STEP)]))
        steps = bounds.withColumn("depth", depth).withColumn("parent", F.expr(f"left(bound, depth - {STEP})")).withColumn("child", F.expr("left(bound, depth)"))
        steps = materialised(steps, "steps")
        merged = self.nodes.groupBy("depth", F.col("prefix").alias("child")).agg(F.sum("n").alias("n"), *FP.xor()).withColumn("parent", F.expr(f"left(child, depth - {STEP})"))
        asked = steps.select("depth", "parent", "child").distinct()  # a few hundred under one parent, however many bounds there are
        none = [F.lit(0).cast("long").alias(c) for c in ("n", *FP.LANES)]
        both = merged.withColumn("_node", F.lit(1)).unionByName(asked.select("*", *none, F.lit(0).alias("_node")))
        before = Window.partitionBy("depth", "parent").orderBy("child", "_node").rowsBetween(Window.unboundedPreceding, 0)
        smaller = both.select("depth", "child", "_node", F.sum("n").over(before).alias("n"), *[F.bit_xor(c).over(before).alias(c) for c in FP.LANES]).filter("_node = 0")
        inner = steps.join(smaller, ["depth", "child"]).select("bound", "n", *FP.LANES)
        leaves = self.nodes.filter("leaf").select(F.col("depth").alias("d"), "prefix", "segment")
        edges = materialised(steps.join(leaves, (F.col("depth") == F.col("d")) & (F.col("child") == F.col("prefix"))).select("bound", "segment", "prefix"), "edges")
        at = edges.select("bound", "prefix", F.col("segment").alias("s"))
        paths = self.paths(self.files.join(at, (F.col("segment") == F.col("s")) & (F.col("lo") < F.col("bound")) & (F.col("hi") >= F.col("prefix"))))
        rows = self.rows_of(paths)
        if rows is not None:
            some = edges.select("prefix", "bound").limit(LITERAL + 1).collect()
            if len(some) <= LITERAL:
                rows = rows.filter(_any([(F.col(self.hlc) >= r["prefix"]) & (F.col(self.hlc) < r["bound"]) for r in some]))
            rows = rows.select(F.col(self.hlc).alias("hlc"), F.regexp_extract("_metadata.file_path", "/([^/]+)/[^/]+$", 1).alias("_s"))
            rows = rows.withColumn("_d", depth).withColumn("_p", F.expr("left(hlc, _d)"))
            edge = FP.with_lanes(rows.join(small(edges), (F.col("_s") == F.col("segment")) & (F.col("_p") == F.col("prefix")) & (F.col("hlc") < F.col("bound"))).select("bound", "hlc"))
            inner = inner.unionByName(edge.groupBy("bound").agg(F.count(F.lit(1)).alias("n"), *FP.xor()))
        found = inner.groupBy("bound").agg(F.sum("n").alias("n"), *FP.xor())
        out = bounds.join(found, "bound", "left")
        out = materialised(out.select("bound", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n", *FP.LANES)]), "below")
        dropped(edges, steps)
        return out

    def fingerprints(self, ranges: DataFrame) -> DataFrame:
        """Adds n and fp to rows with ``lower`` (null: from the start) and ``upper`` (null: to the end), half open; an upper bound that is not above the lower one makes an empty range."""
        bounds = ranges.select(F.col("lower").alias("bound")).union(ranges.select("upper")).filter("bound IS NOT NULL")
        b, whole = self.below(bounds), self.total().toDF("tn", *[f"t_{c}" for c in FP.LANES])
        side = lambda s: b.toDF(s, *[f"{s}_{c}" for c in ("n", *FP.LANES)])
        both = ranges.join(side("lower"), "lower", "left").join(side("upper"), "upper", "left").crossJoin(F.broadcast(whole))  # one row
        lo = lambda c: F.coalesce(f"lower_{c}", F.lit(0).cast("long"))
        hi = lambda c, t: F.when(F.col("upper").isNull(), F.col(t)).otherwise(F.col(f"upper_{c}"))
        some = F.coalesce(F.col("lower") < F.col("upper"), F.lit(True))
        out = both.withColumn("n", F.when(some, hi("n", "tn") - lo("n")).otherwise(0).cast("long"))
        for c in FP.LANES:
            out = out.withColumn(c, F.when(some, hi(c, f"t_{c}").bitwiseXOR(lo(c))).otherwise(0).cast("long"))
        return out.select(*ranges.columns, "n", FP.text().alias("fp"))

    def within(self, prefixes: list[str]) -> DataFrame | None:
        """The rows whose keys begin with one of ``prefixes`` (none of which begins with another), with it as ``prefix``; only files that can hold them are read."""
        spans = self.spark.createDataFrame([(p, p + "g") for p in prefixes], "p string, q string")
        rows = self.rows_of(self.paths(self.files.join(F.broadcast(spans), (F.col("hi") >= F.col("p")) & (F.col("lo") < F.col("q")))))
        if rows is None:
            return None
        lengths = F.explode(F.array(*[F.lit(n) for n in sorted({len(p) for p in prefixes})]))
        rows = rows.filter(F.col(self.hlc).between(min(prefixes), max(prefixes) + "g")).withColumn("_n", lengths)
        return rows.join(small(spans.select("p")), F.expr(f"left({self.hlc}, _n)") == F.col("p")).drop("_n").withColumnRenamed("p", "prefix")

    def near(self, begin: int, end: int) -> tuple[str, str | None]:
        """Keys (from, to) between which all positions from ``begin`` to ``end`` - 1 lie: a descent of the tree, one small look a level.

        Keys of segments that are not divided as far as others lie anywhere under their leaf, so a step is taken only as far as is certain with them.
        """
        lo, hi = _Descent(begin, upper=False), _Descent(end, upper=True)
        nodes = self.nodes
        for depth in range(STEP, DEEPEST + 1, STEP):
            parents = [x.prefix for x in (lo, hi) if x.open]
            if not parents:
                break
            level = nodes.filter((F.col("depth") == depth) & _any([F.col("prefix").startswith(p) for p in parents]))
            rows = level.groupBy("prefix").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("leaf"), F.col("n")).otherwise(0)).alias("loose")).collect()  # at most 256 a parent
            for x in (lo, hi):
                x.step(sorted((r["prefix"], r["n"], r["loose"]) for r in rows if r["prefix"].startswith(x.prefix)))
        return lo.key or "", hi.key

    def slice(self, begin: int, end: int) -> DataFrame | None:
        """The rows at positions ``begin`` to ``end`` - 1 of all keys in order, with ``pos``, read from the files that hold them."""
        if end <= begin or not self.segments:
            return None
        lo, hi = self.near(begin, end)
        paths = self.paths(self.files.filter((F.col("hi") >= lo) & (F.col("lo") < hi if hi else F.lit(True))))
        rows = self.rows_of(paths)
        if rows is None:
            return None
        before = self.below(self.spark.createDataFrame([(lo,)], "bound string")).first()["n"] if lo else 0
        rows = rows.filter((F.col(self.hlc) >= lo) & (F.col(self.hlc) < hi if hi else F.lit(True)))
        placed = R.with_position(rows, self.hlc).withColumn("pos", F.col("pos") + before)
        return placed.filter((F.col("pos") >= begin) & (F.col("pos") < end))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


class _Descent:
    """The way to a position: ``key`` is a bound that the position is surely not below (or, ``upper``, that all before it are surely below)."""

    def __init__(self, target: int, upper: bool) -> None:
        self.target, self.upper = target, upper
        self.prefix, self.key, self.open = "", None, True
        self.before, self.loose = 0, 0  # keys surely below the prefix, and keys that may lie on either side of what is below it

    def step(self, children: list[tuple[str, int, int]]) -> None:
        if not self.open:
            return
        before, chosen = self.before, None
        for prefix, n, loose in children:
            if self.upper and before + n >= self.target:
                chosen = (prefix, before, loose)
                break
            if not self.upper and before + self.loose <= self.target:
                chosen = (prefix, before, loose)
            before += n
        if chosen is None:
            self.open = False
            return
        self.prefix, self.before = chosen[0], chosen[1]
        self.loose += chosen[2]
        self.key = self.prefix + "g" if self.upper else self.prefix  # g comes after all hex digits
