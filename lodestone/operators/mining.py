"""Semantic path mining: categories of a text's concepts, weights that climb, paths, and a choice of independent ones.

Every frame carries `query`; edges are the level edges (parent, child, depth) of a category graph.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.tables import settled

MIX = 0.6


def category_distribution(vectors: DataFrame, members: DataFrame, inlinks: DataFrame, limit: int = 50, mix: float = MIX) -> DataFrame:
    """(query, category, w) of (query, concept, v), (concept, category) and (concept, source).

    Of a query's `limit` best concepts each scores, in a category, mix * v + (1 - mix) * (weights of its inlinks inside
    the category) / (number of its inlinks); a category is the mean of its concepts, normalised over categories.
    """
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("v").desc(), "concept"))
    top = vectors.withColumn("rank", rank).filter(F.col("rank") <= limit).select("query", "concept", "v").join(members, "concept")
    n = inlinks.groupBy("concept").agg(F.count("*").alias("n_in"))
    source = top.select("query", "category", F.col("concept").alias("source"), F.col("v").alias("given"))
    near = top.join(inlinks, "concept").join(source, ["query", "category", "source"]).groupBy("query", "category", "concept").agg(F.sum("given").alias("given"))
    scored = top.join(n, "concept", "left").join(near, ["query", "category", "concept"], "left")
    score = mix * F.col("v") + (1 - mix) * F.coalesce(F.col("given") / F.col("n_in"), F.lit(0.0))
    mean = scored.groupBy("query", "category").agg(F.avg(score).alias("w"))
    whole = mean.groupBy("query").agg(F.sum("w").alias("all"))
    return mean.join(whole, "query").select("query", "category", (F.col("w") / F.col("all")).alias("w"))


def propagated(level: DataFrame, weights: DataFrame, share: DataFrame | None = None) -> DataFrame:
    """(query, node, w): every category's weight pushed up to its parents, split evenly or by `share` (node, n) of the
    parents, and added at each visit."""
    if share is None:
        part = level.select(F.col("child").alias("node"), "parent").withColumn("p", 1 / F.count("*").over(Window.partitionBy("node")))
    else:
        part = level.select(F.col("child").alias("node"), "parent").join(share.select(F.col("node").alias("parent"), "n"), "parent")
        part = part.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("node"))).drop("n")
    part = settled(part)
    front = settled(weights.select("query", F.col("category").alias("node"), "w"))
    every = front
    while True:
        front = settled(front.join(part, "node").groupBy("query", F.col("parent").alias("node")).agg(F.sum(F.col("w") * F.col("p")).alias("w")))
        if front.isEmpty():
            return every.groupBy("query", "node").agg(F.sum("w").alias("w"))
        every = every.unionByName(front)


def paths(level: DataFrame, visited: DataFrame, root: Any) -> DataFrame:
    """(query, nodes, weights): all ways down from the root through visited nodes that can't grow; the root weighs one."""
    kind = dict(level.dtypes)["child"]
    down = settled(visited.select("query", F.col("node").alias("child"), F.col("w")).join(level.select(F.col("parent").alias("last"), "child"), "child"))
    front = visited.select("query").distinct().select("query", F.lit(root).cast(kind).alias("last"), F.array(F.lit(root).cast(kind)).alias("nodes"), F.array(F.lit(1.0)).alias("weights"))
    done = None
    while True:
        step = settled(front.join(down, ["query", "last"], "left"))
        ended = step.filter("child is null and size(nodes) > 1").select("query", "nodes", "weights")
        done = ended if done is None else done.unionByName(ended)
        front = step.filter("child is not null").select("query", F.col("child").alias("last"), F.concat("nodes", F.array("child")).alias("nodes"), F.concat("weights", F.array("w")).alias("weights"))
        if front.isEmpty():
            return done


def without_inner_leaves(found: DataFrame, child_counts: DataFrame) -> DataFrame:
    """Paths whose last node has no children counted."""
    inner = child_counts.filter("n_children > 0").select(F.col("node").alias("last"))
    return found.withColumn("last", F.element_at("nodes", -1)).join(inner, "last", "left_anti").drop("last")


def scored(found: DataFrame) -> DataFrame:
    """With score, the mean of the weights."""
    return found.withColumn("score", F.aggregate("weights", F.lit(0.0), lambda a, x: a + x) / F.size("weights"))


def dependence(a: Column, b: Column, skip: int = 0) -> Column:
    """How far two paths are one: 1 with the same last node, else the common places, the early ones weighing most.
    With `skip`, that many places from the root are left out."""
    short, long = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    places = F.sequence(F.lit(skip), F.greatest(short - 1, F.lit(skip)))
    inside = lambda i: (short - i).cast("double")
    same = F.aggregate(places, F.lit(0.0), lambda s, i: s + F.when((i < short) & (F.get(a, i) == F.get(b, i)), inside(i)).otherwise(0.0))
    room = F.aggregate(places, F.lit(0.0), lambda s, i: s + F.when(i < short, inside(i)).otherwise(0.0)) + (long - short)
    return F.when(F.element_at(a, -1) == F.element_at(b, -1), 1.0).when(room == 0, 0.0).otherwise(same / room)


def independent(found: DataFrame, top: int = 20, bar: float = 0.7) -> DataFrame:
    """(query, nodes, score, place): again and again the best path that is left is taken, and it and all that depend on
    it by over `bar` go; `top` times. Each step joins the paths that are left with one path a query."""
    left = settled(found.select("query", "nodes", "score"))
    taken = None
    for place in range(1, top + 1):
        best = left.groupBy("query").agg(F.max(F.struct(F.round("score", 9).alias("s"), F.transform("nodes", lambda x: -x).alias("k"), "nodes", "score")).alias("b"))
        best = settled(best.select("query", F.col("b.nodes").alias("best"), F.col("b.score").alias("best_score")))
        if best.isEmpty():
            break
        here = best.select("query", F.col("best").alias("nodes"), F.col("best_score").alias("score"), F.lit(place).alias("place"))
        taken = here if taken is None else taken.unionByName(here)
        left = settled(left.join(best, "query").filter(dependence(F.col("nodes"), F.col("best")) <= bar).select("query", "nodes", "score"))
    return taken if taken is not None else left.withColumn("place", F.lit(0))


def level_one(level: DataFrame, visited: DataFrame, counts: DataFrame) -> DataFrame:
    """(query, node, raw, normalised) of every node of level one, 0 where not visited; normalised by the node's children
    and to a sum of one."""
    ones = level.filter("depth = 1").select(F.col("child").alias("node")).distinct().join(counts, "node", "left")
    every = visited.select("query").distinct().crossJoin(F.broadcast(ones))  # level one is a few main topics
    rows = every.join(visited, ["query", "node"], "left").select("query", "node", F.coalesce("w", F.lit(0.0)).alias("raw"), (F.coalesce("w", F.lit(0.0)) / F.coalesce("n_children", F.lit(1))).alias("x"))
    whole = F.sum("x").over(Window.partitionBy("query"))
    return rows.select("query", "node", "raw", F.when(whole > 0, F.col("x") / whole).otherwise(0.0).alias("normalised"))


def walk_similarity(pairs: DataFrame, level: DataFrame, alpha: float = MIX) -> DataFrame:
    """(id, s) of (id, x, y): how likely a walk down path x meets path y.

    From node x_i a step leads to itself or a child with 1 / (children + 1). At place i the walk scores alpha times the
    chances to step onto any of y_i, y_i+1, ...; with the chance to step onto y_i it goes on, weighing 1 - alpha.
    """
    n = level.groupBy(F.col("parent").alias("c")).agg(F.count("*").alias("n_children"))
    place = pairs.select("id", "y", F.posexplode("x").alias("i", "c")).filter(F.col("i") < F.size("y"))
    place = place.select("id", "i", "c", F.posexplode("y").alias("j", "to")).filter("j >= i").join(n, "c", "left")
    edge = level.select(F.col("parent").alias("c"), F.col("child").alias("to"), F.lit(1.0).alias("down"))
    meets = F.when(F.col("c") == F.col("to"), 1.0).otherwise(F.coalesce("down", F.lit(0.0))) / (F.coalesce("n_children", F.lit(0)) + 1)
    rows = place.join(edge, ["c", "to"], "left").withColumn("m", meets).groupBy("id", "i").agg(F.sum("m").alias("any"), F.sum(F.when(F.col("i") == F.col("j"), F.col("m")).otherwise(0.0)).alias("on"))
    steps = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "any", "on"))).alias("s"))
    step = lambda a, x: F.struct((a["p"] * (1 - alpha) * x["on"]).alias("p"), (a["sum"] + a["p"] * alpha * x["any"]).alias("sum"))
    return steps.select("id", F.aggregate("s", F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum")), step, lambda a: a["sum"]).alias("s"))


def path_relatedness(pairs: DataFrame, best: DataFrame) -> DataFrame:
    """(a, b, relatedness) of pairs of queries by the dependence of their best paths, the root left out; 0 without paths."""
    one = best.filter("place = 1").select("query", "nodes")
    rows = pairs.join(one.select(F.col("query").alias("a"), F.col("nodes").alias("x")), "a", "left").join(one.select(F.col("query").alias("b"), F.col("nodes").alias("y")), "b", "left")
    return rows.select("a", "b", F.coalesce(dependence(F.col("x"), F.col("y"), 1), F.lit(0.0)).alias("relatedness"))
