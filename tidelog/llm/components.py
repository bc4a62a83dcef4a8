"""Connected components by distributed minimum-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, evenly, written


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of comparable ids -> (node, component): each node with an edge and the smallest node it reaches.

    Nothing is collected. ``edges`` is computed once and need not be a written table. Every round ends in a written table; the tables of rounds before are deleted. The joins are plain equi-joins between exchanged sides, so
    adaptive execution splits a node or label that has very many rows; the minimum is taken by partial aggregates first. What a round writes is dealt anew, so that it is in few files.
    Null ends and self-loops: dropped, so a node with no other edge is not in the result. No edges: an empty result.
    """
    ends = F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")
    both = written(evenly(edges.filter("a <> b").select(ends).select(F.col("e.v").alias("a"), F.col("e.w").alias("b")).distinct()), "edges")
    labels = written(evenly(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")).toDF("v", "l")), "labels")
    while True:
        near = both.join(labels, both["a"] == labels["v"]).groupBy("b").agg(F.min("l").alias("m"))
        low = labels.join(near, labels["v"] == near["b"]).select("v", F.col("l").alias("was"), F.least("l", "m").alias("l"))
        low = written(evenly(low), "labels")
        dropped(labels)
        jump = low.select(F.col("v").alias("p"), F.col("l").alias("pl"))
        new = written(evenly(low.join(jump, low["l"] == jump["p"]).select("v", F.least("l", "pl").alias("l"), "was")), "labels")
        dropped(low)
        if not new.filter("l <> was").limit(1).count():
            dropped(both)
            return new.select(F.col("v").alias("node"), F.col("l").alias("component"))
        labels = new.select("v", "l")
