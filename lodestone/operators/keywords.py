"""Key words of a text by PageRank over the graph of its neighbouring words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def word_graph(words: DataFrame, title: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, word, n, importance) and edges (id, src, dst, n) of (id, part, pos, word), part 0 being the title.

    Neighbours in one part are joined in both directions; a word in the title is of importance `title`, others of 1.
    """
    nodes = words.groupBy("id", "word").agg(F.count("*").alias("n"), F.max(F.when(F.col("part") == 0, title).otherwise(1.0)).alias("importance"))
    before = words.withColumn("src", F.lag("word").over(Window.partitionBy("id", "part").orderBy("pos"))).filter("src is not null").select("id", "src", F.col("word").alias("dst"))
    both = before.unionByName(before.select("id", F.col("dst").alias("src"), F.col("src").alias("dst")))
    return nodes, both.groupBy("id", "src", "dst").agg(F.count("*").alias("n"))


def transitions(nodes: DataFrame, edges: DataFrame, alpha: float = 0.1, beta: float = 0.9, gamma: float = 0.0) -> DataFrame:
    """(id, src, dst, p): alpha spread evenly over the neighbours of src, beta by their importance, gamma by their counts."""
    w = Window.partitionBy("id", "src")
    rows = edges.select("id", "src", "dst").join(nodes.withColumnRenamed("word", "dst"), ["id", "dst"])
    p = alpha / F.count("*").over(w) + beta * F.col("importance") / F.sum("importance").over(w) + gamma * F.col("n") / F.sum("n").over(w)
    return rows.select("id", "src", "dst", p.alias("p"))


def ranked(nodes: DataFrame, moves: DataFrame, tax: float = 0.15, rounds: int = 20) -> DataFrame:
    """(id, word, rank): V' = (1 - tax) M V + tax / n in each text's own graph; the graphs of a batch are iterated side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = np.asarray(batch.column(1).value_lengths())
            edges = batch.column(1).flatten()
            text = np.repeat(np.arange(len(many)), many)
            held = pa.concat_arrays([edges.field("src"), edges.field("dst")]).dictionary_encode()
            # a node is a word of one text
            node, place = np.unique(np.tile(text, 2) * len(held.dictionary) + np.asarray(held.indices), return_inverse=True)
            src, dst, p = place[: len(text)], place[len(text) :], np.asarray(edges.field("p"))
            of, word = np.divmod(node, max(1, len(held.dictionary)))
            even = 1.0 / np.asarray(batch.column(2))[of]
            v = even
            for _ in range(rounds):
                v = (1 - tax) * np.bincount(dst, p * v[src], len(node)) + tax * even
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), held.dictionary.take(pa.array(word)), pa.array(v, pa.float64())], ["id", "word", "rank"])

    size = nodes.groupBy("id").agg(F.count("*").alias("n_words"))
    graphs = moves.groupBy("id").agg(F.collect_list(F.struct("src", "dst", "p")).alias("edges")).join(size, "id")
    found = graphs.select(F.col("id").cast("long"), "edges", "n_words").mapInArrow(run, "id long, word string, rank double")
    alone = nodes.join(moves.select("id", F.col("src").alias("word")), ["id", "word"], "left_anti").join(size, "id")
    return found.unionByName(alone.select(F.col("id").cast("long"), "word", ((tax) / F.col("n_words")).alias("rank")))


def top_words(ranks: DataFrame, top: int = 10) -> DataFrame:
    """The `top` words of each text, the earlier in the alphabet at ties."""
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.round("rank", 9).desc(), "word"))
    return ranks.withColumn("place", place).filter(F.col("place") <= top)
