"""Connected components over edge tables, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import discard, join_hot, materialize


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("s"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
    return tuple(r)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of an edge table of longs; root is the smallest node of its component.

    Each round writes its edge table to the shared folder, so lost executors repeat one round at most; the table before
    it is deleted then. Rows with a null end and self-loops are left out; an empty table gives an empty result; repeated
    edges count once. Minima are partial aggregates, and the minima of hubs, at most 2/HOT_SHARE of them, are broadcast to
    their edges, so a hub with a third of all edges costs no single task. Nothing reaches the driver but a signature of
    three numbers a round. RuntimeError if max_rounds rounds (far above the log-squared bound) don't converge.
    """
    e = edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).where("x is not null and y is not null and x <> y")
    e = materialize(e.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "cc")
    before = _signature(e)
    if not before[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_hot(both.where("v > u"), least, ["u"], "n", before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = materialize(large.distinct(), "cc-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        kept = join_hot(large, least, ["u"], "n", before[0]).where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        old, e = e, materialize(kept.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        discard(old)
        discard(large)
        after = _signature(e)
        if after == before:
            roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = after
    raise RuntimeError("components did not converge")
