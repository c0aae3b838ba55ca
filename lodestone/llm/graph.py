"""Connected components of a distributed edge table: contraction in tasks, then alternating star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textops as tx

ROOM = 2_000_000  # edges that one task holds


def find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        x = up


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of all pairs; afterwards parent points at the roots, the smallest of each set."""
    while len(a):
        a, b = find(parent, a), find(parent, b)
        open_ = a != b
        a, b = a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
    while True:
        up = parent[parent]
        if (up == parent).all():
            return
        parent[:] = up


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a task's edges with the smallest that it reaches over them."""
    held = [b for b in batches if b.num_rows]
    if held:
        table = pa.Table.from_batches(held)
        nodes, place = np.unique(np.concatenate([table.column(0).to_numpy(), table.column(1).to_numpy()]), return_inverse=True)
        parent = np.arange(len(nodes))
        unite(parent, place[: len(place) // 2], place[len(place) // 2 :])
        moved = np.flatnonzero(parent != np.arange(len(nodes)))
        for at in range(0, len(moved), 100_000):
            part = moved[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(nodes[parent[part]])], ["a", "b"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
    return both.join(tx.dealt_anew(least, "a"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(tx.dealt_anew(least, "a"), "a")
    return joined.select("b", "m").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, room: int = ROOM) -> DataFrame:
    """(node, root): root is the smallest node reachable; nodes without an edge to another are absent.

    Edges are dealt out at `room` a task, which contracts its own to a star for each component. Where more than one
    task was needed, large and small star steps follow until nothing changes: minima are combined map-side and hubs
    meet in plain equi-joins, which adaptive execution splits, so no task gathers a node's neighbours. Each step is
    written to the shared folder. Rows with a null are no edges.
    """
    spark = edges.sparkSession
    now = tx.stored(edges.filter("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")), "edges")
    parts = max(1, -(-now.count() // room))
    after = tx.stored(now.repartition(parts).mapInArrow(_contracted, "a long, b long"), "edges")
    tx.drop_stored(spark, now)
    now, before = after, None
    while parts > 1:
        after = tx.stored(_small_star(_large_star(now)), "edges")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        tx.drop_stored(spark, now)
        now = after
        if mark == before:
            break
        before = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
