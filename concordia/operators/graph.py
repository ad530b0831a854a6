"""Checks of graphs of persons or places: ends that don't exist, reachability, cycles, and trees without an edge."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import put, remove
from .pointers import chains


def orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges(a, b, kind): a, b, end for each end that is no node(id)."""
    sides = [edges.join(nodes.select(F.col("id").alias(c)), c, "left_anti").select("a", "b", F.lit(c).alias("end")) for c in ("a", "b")]
    return sides[0].unionByName(sides[1])


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """start(id): id, depth of every node reached, breadth first; a node keeps its least depth, so cycles end;
    a round that finds no new node is the last.

    Each round joins only the newest nodes and is written out, so its lineage stays one round deep; a round for each
    depth. Where a node has one link at most, `pointers.reached` takes the logarithm of that.
    """
    spark = edges.sparkSession
    seen = start.select("id", F.lit(0).alias("depth")).distinct()
    front, depth, paths = seen, 0, []
    while True:
        depth += 1
        new = front.join(edges, front["id"] == edges["a"]).select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti")
        front, path = put(new.select("id", F.lit(depth).alias("depth")), "front")
        paths.append(path)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if depth % 8 == 0:  # one table to read and not one a round
            seen, path = put(seen, "seen")
            # the newest nodes are read once more
            for old in paths[:-1]:
                remove(spark, old)
            paths = [paths[-1], path]
    return seen


def cyclic(edges: DataFrame, leave_out: list[str] = ()) -> bool:
    """Whether edges(a, b) have a cycle; with edges(a, b, kind), edges of the kinds left out don't count (a null
    kind is none of them). Null ends are no nodes.

    Nodes without a way in or out go; nodes with one way out are merged into where their chain leads, a path
    of n edges in log n rounds. When every end has a way on, there is a cycle.
    """
    spark = edges.sparkSession
    if leave_out:
        edges = edges.filter(F.col("kind").isNull() | ~F.col("kind").isin(*leave_out))
    edges, path = put(edges.select("a", "b").filter("a is not null and b is not null").distinct(), "edges")
    n = edges.count()
    while n:
        if not edges.filter("a = b").isEmpty():
            break
        onward = edges.join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        inner, inner_path = put(onward.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a", "b"), "edges")
        remove(spark, path)
        path = inner_path
        left = inner.count()
        if left in (0, n):
            n = left
            break
        single = inner.groupBy("a").agg(F.count("*").alias("ways"), F.min("b").alias("next")).filter("ways = 1").select(F.col("a").alias("id"), "next")
        ends = chains(single)
        if not ends.filter("loops").isEmpty():
            n = left
            break
        # a merged node's own edge goes with it; edges into it lead to where its chain ends
        ends = ends.select("id", "end")
        rest = inner.join(ends.select(F.col("id").alias("a")), "a", "left_anti").join(ends.withColumnRenamed("id", "b"), "b", "left")
        edges, path = put(rest.select("a", F.coalesce("end", "b").alias("b")).distinct(), "edges")
        remove(spark, inner_path)
        n = edges.count()
    remove(spark, path)
    return n > 0


def trees(nodes: DataFrame, edges: DataFrame, parent: str = "parent") -> DataFrame:
    """nodes(id, tree), edges(a, b, kind): tree, persons, parents of each tree: its nodes, and its edges of the
    parent kind, as which an edge without a kind counts, with both ends in the tree. Repeated edges count each."""
    own = edges.filter(F.coalesce("kind", F.lit(parent)) == parent).join(nodes.select(F.col("id").alias("a"), "tree"), "a").join(nodes.select(F.col("id").alias("b"), "tree"), ["b", "tree"])
    counted = nodes.select("tree", F.lit(1).alias("p"), F.lit(0).alias("e")).unionByName(own.select("tree", F.lit(0).alias("p"), F.lit(1).alias("e")))
    return counted.groupBy("tree").agg(F.sum("p").alias("persons"), F.sum("e").alias("parents"))
