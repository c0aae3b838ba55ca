"""Belief propagation in pairwise factor graphs, as joins and aggregates over message rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.tables import settled

#: Weights below this, zero among them, count as this much.
LEAST = 1e-300


def _log(p: Column) -> Column:
    return F.log(F.greatest(p.cast("double"), F.lit(LEAST)))


def _totals(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    """(v, x, t): a node's own log weight and that of all messages to it, the greatest of a node at 0."""
    come = messages.groupBy(F.col("dst").alias("v"), "x").agg(F.sum("m").alias("come"))
    rows = nodes.join(come, ["v", "x"], "left").select("v", "x", (F.col("own") + F.coalesce("come", F.lit(0.0))).alias("t"))
    return rows.join(rows.groupBy("v").agg(F.max("t").alias("top")), "v").select("v", "x", (F.col("t") - F.col("top")).alias("t"))


def messages(nodes: DataFrame, edges: DataFrame, best: bool = False, damping: float = 0.0, tolerance: float = 1e-9, rounds: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The settled messages (src, dst, x, m) in logs, and the nodes (v, x, own), of node weights (v, x, p) and edge weights
    (u, v, x, y, p), each edge given once. Sums over the sender's states, or with `best` the greatest. All edges send at
    once; exact on trees, after as many rounds as the longest path. Stops when no message moves by more than `tolerance`,
    raises if that takes over `rounds`. An edge between nodes without weights, and a node without any edge, add nothing."""
    own = settled(nodes.groupBy("v", "x").agg(F.sum(_log(F.col("p"))).alias("own")))
    weight = edges.groupBy("u", "v", "x", "y").agg(F.sum(_log(F.col("p"))).alias("w"))
    there, back = weight.toDF("src", "dst", "xs", "x", "w"), weight.select("v", "u", "y", "x", "w").toDF("src", "dst", "xs", "x", "w")
    both = settled(there.unionByName(back).groupBy("src", "dst", "xs", "x").agg(F.sum("w").alias("w")))
    now = settled(both.select("src", "dst", "x").distinct().withColumn("m", F.lit(0.0)))
    for _ in range(rounds):
        answer = now.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("x").alias("xs"), F.col("m").alias("m_back"))
        sent = both.join(_totals(own, now).select(F.col("v").alias("src"), F.col("x").alias("xs"), "t"), ["src", "xs"]).join(answer, ["src", "dst", "xs"])
        sent = sent.select("src", "dst", "x", (F.col("w") + F.col("t") - F.col("m_back")).alias("s"))
        top = F.max("s").alias("top")
        if best:
            new = sent.groupBy("src", "dst", "x").agg(top).withColumnRenamed("top", "m")
        else:
            new = sent.join(sent.groupBy("src", "dst", "x").agg(top), ["src", "dst", "x"]).groupBy("src", "dst", "x").agg((F.first("top") + F.log(F.sum(F.exp(F.col("s") - F.col("top"))))).alias("m"))
        level = new.groupBy("src", "dst").agg(F.max("m").alias("top"))
        moved = new.join(level, ["src", "dst"]).join(now.withColumnRenamed("m", "old"), ["src", "dst", "x"])
        moved = settled(moved.select("src", "dst", "x", "old", ((1 - damping) * (F.col("m") - F.col("top")) + damping * F.col("old")).alias("m")))
        change = moved.agg(F.max(F.abs(F.col("m") - F.col("old")))).first()[0]
        now = moved.drop("old")
        if change is None or change <= tolerance:
            return now, own
    raise ValueError(f"messages still move after {rounds} rounds: give a damping or a wider tolerance")


def marginals(nodes: DataFrame, edges: DataFrame, damping: float = 0.0, tolerance: float = 1e-9, rounds: int = 1000) -> DataFrame:
    """(v, x, p): each node's distribution; exact on trees, the loopy approximation elsewhere."""
    sent, own = messages(nodes, edges, False, damping, tolerance, rounds)
    t = _totals(own, sent).withColumn("e", F.exp("t"))
    return t.join(t.groupBy("v").agg(F.sum("e").alias("all")), "v").select("v", "x", (F.col("e") / F.col("all")).alias("p"))


def best_states(nodes: DataFrame, edges: DataFrame, damping: float = 0.0, tolerance: float = 1e-9, rounds: int = 1000) -> DataFrame:
    """(v, x): each node's state in the likeliest whole assignment (on trees, where that is unique); the least at ties."""
    sent, own = messages(nodes, edges, True, damping, tolerance, rounds)
    t = _totals(own, sent).select("v", "x", F.round("t", 9).alias("t"))
    return t.join(t.groupBy("v").agg(F.max("t").alias("t")), ["v", "t"]).groupBy("v").agg(F.min("x").alias("x"))
