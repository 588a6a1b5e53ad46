"""Rating systems: the connected components of the match graph.

Two sides whose ratings can ever influence each other share a component, so components are the
finest key under which a fold is still exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kickline.operators.joins import sized_broadcast
from kickline.session import stage


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """`node, system` for both ends of every edge; system is the smallest node of the component.

    Random contraction: in every round a node joins the neighbour (or itself) with the least hash of
    the round, and edges between joined nodes vanish. A constant share of the nodes goes per round, whatever
    the shape, so there are about log(nodes) rounds on shrinking tables; then the joins are read backwards. Null
    ends take no part; a node that only meets itself is a system of its own.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL").distinct()
    pairs = stage(pairs, "graph")
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    left = stage(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct(), "graph")
    joined = []
    while not left.isEmpty():
        turn = F.lit(len(joined))
        best = F.min(F.struct(F.xxhash64(turn, "v").alias("h"), F.col("v").alias("to")))
        own = F.struct(F.xxhash64(turn, "u").alias("h"), F.col("u").alias("to"))
        step = stage(left.groupBy("u").agg(best.alias("best")).select("u", F.least("best", own)["to"].alias("to")), "joined")
        joined.append(step)
        moved = left.join(step.select(F.col("u"), F.col("to").alias("x")), "u").drop("u")
        moved = moved.join(step.select(F.col("u").alias("v"), F.col("to").alias("y")), "v")
        left = stage(moved.filter("x <> y").select(F.col("x").alias("u"), F.col("y").alias("v")).distinct(), "graph")
    ends = None   # where the nodes that were left after a round ended up
    for step in reversed(joined):
        if ends is None:
            ends = step.select("u", F.col("to").alias("end"))
        else:
            later = ends.select(F.col("u").alias("to"), F.col("end"))
            ends = stage(step.join(later, "to", "left").select("u", F.coalesce("end", "to").alias("end")), "ends")
    if ends is None:
        return nodes.select("node", F.col("node").alias("system"))
    rooted = nodes.join(ends.select(F.col("u").alias("node"), "end"), "node", "left").select("node", F.coalesce("end", "node").alias("end"))
    least = rooted.groupBy("end").agg(F.min("node").alias("system"))
    return rooted.join(least, "end").select("node", "system")


def with_system(matches: DataFrame, home: str = "home", away: str = "away", system: str = "system") -> DataFrame:
    """Adds the rating system of every match."""
    of = components(matches, home, away).select(F.col("node").alias(home), F.col("system").alias(system))
    return matches.join(sized_broadcast(of), home)
