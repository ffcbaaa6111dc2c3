"""Connected components by alternating large-star and small-star steps.

The number of rounds grows with the logarithm of the longest path.  A node of very
many edges is no hot key: a node's least neighbour is found by partial minima
and reaches its edges by a join on the node and one of ``SALTS`` parts of them.  Every
round is a table of the shared folder, so lineage stays short, and it goes when the next
is written; nothing reaches the driver but a count.

The driver keeps every plan, stage and task for a while, so a round has few exchanges, the minima and
the join share one, and no round follows once all edges are stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Room

SALTS = 1024


def _stars(edges: DataFrame) -> bool:
    """Whether different ``edges(a, b)``, which point down, are stars: no node has two lower ones, or a lower and a higher one."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return nodes.where("down > 1 or down = 1 and up = 1").agg(F.count("*")).first()[0] == 0


def _with_least(rows: DataFrame) -> DataFrame:
    """``rows(u, v)`` with ``m``, the least ``v`` of the ``u``."""
    salted = rows.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).repartition("u", "s")
    parts = salted.groupBy("u", "s").agg(F.min("v").alias("m"))
    least = parts.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("s").alias("parts"))  # at most SALTS a node
    named = least.select("u", F.explode("parts").alias("s"), "m")
    return salted.join(named.hint("merge"), ["u", "s"]).select("u", "v", "m")


def _large(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least of the node and its neighbours; links may repeat."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    moved = _with_least(both).where("v > u")
    return moved.select(F.col("v").alias("a"), F.least("m", "u").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of these; ``edges`` point down."""
    linked = _with_least(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    to = F.explode(F.array("v", "u")).alias("a")
    return linked.select(to, F.col("m").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame, room: Room, rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, root)`` with root the smallest node of the component.

    Nodes without an edge do not appear; loops and repeated edges do no harm.
    Empty input gives an empty result.  The result is a table of ``room``.
    Raises if ``rounds`` do not suffice.
    """
    now = room.saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        if _stars(now):
            break
        before = now
        now = room.saved(_small(_large(before)), "edges")
        room.drop(before)
    else:
        if not _stars(now):
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
