"""Connected components of a table of links, by contraction; nothing is gathered on the driver or in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, component) for every node of a link; component is the least node that can be reached.

    Each round, every node joins the neighbour (or itself) that comes first, and links between joined nodes
    vanish. Rounds go by the ids (a star around its least node is one node then) and by hashes that are new
    each time (which shrink any graph by a constant factor) in turn. Links may repeat, go either way and
    join a node with itself. Hot nodes are pre-aggregated.
    """
    edges = links.select(F.col(a).alias("x"), F.col(b).alias("y"))
    edges = common.staged(edges.union(edges.select("y", "x")).distinct(), "edges")
    nodes = common.staged(edges.select(F.col("x").alias("node"), F.col("x").alias("at")).distinct(), "nodes")
    turn = 0
    while True:
        edges = edges.filter("x <> y")
        if edges.isEmpty():
            break
        turn += 1
        first_by = (lambda c: F.lit(0)) if turn % 2 else (lambda c: F.xxhash64(F.col(c), F.lit(turn)))  # noqa: B023
        order = lambda c: F.struct(first_by(c).alias("o"), F.col(c).alias("v"))  # noqa: E731, B023
        first = edges.groupBy("x").agg(F.min(order("y")).alias("m"))
        first = common.staged(first.select(F.col("x").alias("from"), F.least(F.col("m"), order("x"))["v"].alias("to")), "joined")
        nodes = nodes.join(first, F.col("at") == F.col("from"), "left").select("node", F.coalesce("to", "at").alias("at"))
        nodes = common.staged(nodes, "nodes")
        edges = edges.join(first, F.col("x") == F.col("from")).select(F.col("to").alias("x"), "y")
        edges = edges.join(first, F.col("y") == F.col("from")).select("x", F.col("to").alias("y"))
        edges = common.staged(edges.filter("x <> y").distinct(), "edges")
    least = nodes.groupBy("at").agg(F.min("node").alias("component"))
    return common.staged(nodes.join(least, "at").select("node", "component"), "components")
