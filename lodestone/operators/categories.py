"""Category graphs: levels, cycles, counts that climb all paths, and listings. Edges are (parent, child)."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.links import tree_depths
from lodestone.sources.tables import settled


def among_known(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are known nodes."""
    return edges.join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi").join(nodes.select(F.col("node").alias("child")), "child", "left_semi").select("parent", "child").distinct()


def level_edges(edges: DataFrame, root: Any, excluded: tuple = ()) -> DataFrame:
    """(parent, child, depth) of edges that lead exactly one level down; `excluded` parents lead nowhere."""
    depths = tree_depths(edges, root)
    up, down = depths.select(F.col("node").alias("parent"), F.col("depth").alias("above")), depths.select(F.col("node").alias("child"), "depth")
    found = edges.distinct().join(up, "parent").join(down, "child").filter("depth = above + 1")
    return (found.filter(~F.col("parent").isin(*excluded)) if excluded else found).select("parent", "child", "depth")


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: number of nodes, of edges, and of nodes that have no parent."""
    isolated = nodes.join(edges.select(F.col("child").alias("node")).distinct(), "node", "left_anti").agg(F.count("*").alias("n_isolated"))
    return nodes.agg(F.count("*").alias("n_nodes")).crossJoin(edges.agg(F.count("*").alias("n_edges"))).crossJoin(isolated)  # one row each


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without a parent."""
    return nodes.join(edges.select(F.col("child").alias("node")), "node", "left_anti")


def leaves(level: DataFrame) -> DataFrame:
    """Nodes below the root without children of the next level."""
    return level.select(F.col("child").alias("node")).distinct().join(level.select(F.col("parent").alias("node")), "node", "left_anti")


def child_counts(level: DataFrame) -> DataFrame:
    return level.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))


def export(nodes: DataFrame, edges: DataFrame, depths: DataFrame, articles: DataFrame) -> DataFrame:
    """(node, n_parents, n_children, n_articles, depth): depth -1 where the root is out of reach."""
    parents = edges.groupBy(F.col("child").alias("node")).agg(F.count("*").alias("n_parents"))
    children = edges.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    joined = nodes.join(parents, "node", "left").join(children, "node", "left").join(articles, "node", "left").join(depths, "node", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_parents", "n_children", "n_articles")]
    return joined.select("node", *zero, F.coalesce("depth", F.lit(-1)).alias("depth"))


def on_cycles(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves. Nodes without an edge in or out are trimmed until none is left to trim; reachability
    is followed in what remains, which holds nothing but cycles and what lies between them."""
    now = settled(edges.select("parent", "child").distinct())
    n = now.count()
    while True:
        now = settled(now.join(now.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").join(now.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").select("parent", "child"))
        after = now.count()
        if after == n:
            break
        n = after
    reach = front = now.select(F.col("parent").alias("start"), F.col("child").alias("node"))
    while True:
        step = front.join(now, front["node"] == now["parent"]).select("start", F.col("child").alias("node")).distinct()
        front = settled(step.join(reach, ["start", "node"], "left_anti"))
        if front.isEmpty():
            return reach.filter("start = node").select("node").distinct()
        reach = settled(reach.unionByName(front))


def recursive_counts(level: DataFrame, own: DataFrame) -> DataFrame:
    """(node, n): every leaf's own (node, n) added to each of its ancestors once for each path up, and to itself."""
    front = settled(own.join(leaves(level), "node", "left_semi").select("node", F.col("n").cast("long").alias("n")))
    every = front
    up = level.select(F.col("child").alias("node"), "parent")
    while True:
        front = settled(front.join(up, "node").groupBy(F.col("parent").alias("node")).agg(F.sum("n").alias("n")))
        if front.isEmpty():
            return every.groupBy("node").agg(F.sum("n").alias("n"))
        every = every.unionByName(front)


def paths_up(level: DataFrame, starts: DataFrame, top: int = 1) -> DataFrame:
    """(start, path): all ways from each start node up to depth `top`, listed from the top down."""
    up = level.select(F.col("child").alias("node"), "parent", "depth")
    front = starts.select(F.col("node").alias("start"), "node", F.array("node").alias("path"))
    done = None
    while True:
        step = settled(front.join(up, "node", "left"))
        ended = step.filter(F.col("depth").isNull() | (F.col("depth") <= top)).select("start", "path").distinct()
        done = ended if done is None else done.unionByName(ended)
        front = step.filter(F.col("depth") > top).select("start", F.col("parent").alias("node"), F.concat(F.array("parent"), "path").alias("path"))
        if front.isEmpty():
            return done


def subtree(level: DataFrame, root: Any, counts: DataFrame, least: int) -> DataFrame:
    """(path, n) of all nodes below `root`, by every path down; leaves only where their count is over `least`."""
    kind = dict(level.dtypes)["child"]
    front = level.sparkSession.range(1).select(F.lit(root).cast(kind).alias("node"), F.array(F.lit(root).cast(kind)).alias("path"))
    found = None
    while True:
        front = settled(front.join(level.select(F.col("parent").alias("node"), "child"), "node").select(F.col("child").alias("node"), F.concat("path", F.array("child")).alias("path")))
        if front.isEmpty():
            break
        found = front if found is None else found.unionByName(front)
    if found is None:
        found = front
    leaf = leaves(level).withColumn("leaf", F.lit(True))
    rows = found.join(counts, "node", "left").join(leaf, "node", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.filter(F.col("leaf").isNull() | (F.col("n") > least)).select(F.concat_ws("/", F.transform("path", lambda x: x.cast("string"))).alias("path"), "n")


def codes(names: DataFrame, mapping: DataFrame, levels: int = 3) -> DataFrame:
    """(name, code) by a (name, code) mapping; unknown names get zeros, two at the top and three at the last level."""
    return names.join(mapping, "name", "left").select("name", "level", F.coalesce("code", F.when(F.col("level") < levels, "00").otherwise("000")).alias("code"))


def nested_codes(level: DataFrame, first: int = 21, depth: int = 3) -> DataFrame:
    """(node, code): numbers from `first` at level one, then the place among the siblings in two digits, down to `depth`."""
    place = F.row_number().over(Window.partitionBy("parent").orderBy("child"))
    found = level.filter("depth = 1").select(F.col("child").alias("node"), (place + first - 1).cast("string").alias("code"))
    every, now = found, found
    for k in range(2, depth + 1):
        down = level.filter(F.col("depth") == k).join(now.select(F.col("node").alias("parent"), "code"), "parent")
        now = down.select(F.col("child").alias("node"), F.concat("code", F.lpad(place.cast("string"), 2, "0")).alias("code"))
        every = every.unionByName(now)
    return every
