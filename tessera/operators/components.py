"""Connected components of an edge table, without bringing any label to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.util import settle


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that can be reached. Each round hooks every root to the
    least root beside it and jumps pointers until each points to the end of its chain. A root that is left
    after two rounds has taken in another, so their number halves at least every two rounds; the rounds go on
    until no edge is left.

    Null ends are left out; repeated edges and loops do no harm; an empty table gives an empty one."""
    e = settle(edges.where(f"{a} is not null and {b} is not null and {a} <> {b}").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    nodes = e.select(F.col("a").alias("node")).union(e.select(F.col("b").alias("node"))).distinct()
    labels = settle(nodes.select("node", F.col("node").alias("component")))
    work = e
    while not work.isEmpty():
        both = work.union(work.select(F.col("b").alias("a"), F.col("a").alias("b")))
        jump = settle(both.groupBy(F.col("a").alias("root")).agg(F.least(F.min("b"), F.min("a")).alias("to")))
        moving = True
        while moving:  # half of the way to the end is left each time
            far = jump.select(F.col("root").alias("to"), F.col("to").alias("far"))
            jump = settle(jump.join(far, "to").select("root", F.col("far").alias("to"), (F.col("far") < F.col("to")).alias("moved")))
            moving = not jump.where("moved").isEmpty()
        jump = jump.drop("moved")
        labels = settle(labels.join(jump, labels["component"] == jump["root"], "left").select("node", F.coalesce("to", "component").alias("component")))
        ja, jb = jump.select(F.col("root").alias("a"), F.col("to").alias("a2")), jump.select(F.col("root").alias("b"), F.col("to").alias("b2"))
        moved = work.join(ja, "a", "left").join(jb, "b", "left").select(F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b"))
        work = settle(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return labels
