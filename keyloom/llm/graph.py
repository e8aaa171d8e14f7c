"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import discard, written


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over links (a, b), for every node with a link.

    Each round hooks every node to the neighbour that comes first in that round's
    seeded order (or to itself) and contracts the links, so the number of linked
    nodes falls by a constant factor in expectation whatever the shape: a chain of
    n nodes takes O(log n) rounds.  Minima are combined before their shuffle, and
    the joins read plain tables, so a hub's rows can be split among tasks.

    Null nodes and self links are ignored; repeated links count once; no links: no rows.
    """
    links = links.where("a is not null and b is not null and a <> b")
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes = edges.select("a").union(edges.select("b")).distinct()
    labels = written(nodes.select(F.col("a").alias("node"), F.col("a").alias("rep")), "labels")
    turn = 0
    while not edges.isEmpty():
        order = lambda c: F.xxhash64(F.lit(turn), F.col(c))
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        first = both.groupBy("u").agg(F.min(F.struct(order("v").alias("h"), F.col("v"))).alias("best"))
        mine = F.struct(order("u").alias("h"), F.col("u").alias("v"))
        hooks = written(first.select("u", F.least("best", mine)["v"].alias("to")), "hooks")
        left = hooks.select(F.col("u").alias("a"), F.col("to").alias("x"))
        right = hooks.select(F.col("u").alias("b"), F.col("to").alias("y"))
        moved = edges.join(left, "a").join(right, "b").where("x <> y")
        contracted = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        move = hooks.select(F.col("u").alias("rep"), "to")
        relabelled = written(labels.join(move, "rep", "left").select("node", F.coalesce("to", "rep").alias("rep")), "labels")
        discard(edges, labels, hooks)
        edges, labels, turn = contracted, relabelled, turn + 1
    # written, so that a large component's rows can be split among tasks in the join
    smallest = written(labels.groupBy("rep").agg(F.min("node").alias("component")), "smallest")
    return labels.join(smallest, "rep").select("node", "component")
