"""Link graphs: inversion, counts, relatedness, category trees and PageRank."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.sources.tables import settled


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, target, freq): targets of a page with their multiplicity."""
    return pages.select("page_id", F.explode(tx.hrefs(F.col("html"))).alias("target")).groupBy("page_id", "target").agg(F.count("*").alias("freq"))


def inlinks(links: DataFrame) -> DataFrame:
    """(target, n_pages, n_links)."""
    return links.groupBy("target").agg(F.count("*").alias("n_pages"), F.sum("freq").alias("n_links"))


def shared_inlinks(links: DataFrame, total: DataFrame) -> DataFrame:
    """(a, b, n_both, similarity): targets that occur on one page; similarity from their inlink sets:
    1 - (ln max - ln both) / (ln N - ln min). Pairs are rows of a join on the page, combined map-side; their number grows with
    the square of a page's links, as the result's does."""
    one = links.select("page_id", F.col("target").alias("a")).distinct()
    both = one.join(one.withColumnRenamed("a", "b"), "page_id").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n_both"))
    n = inlinks(links).select("target", "n_pages")
    x = both.join(n.select(F.col("target").alias("a"), F.col("n_pages").alias("na")), "a").join(n.select(F.col("target").alias("b"), F.col("n_pages").alias("nb")), "b").crossJoin(F.broadcast(total))  # one row
    low, high = F.least("na", "nb"), F.greatest("na", "nb")
    spread = F.log("n_docs") - F.log(low)
    return x.select("a", "b", "n_both", F.when(spread == 0, 1.0).otherwise(1 - (F.log(high) - F.log("n_both")) / spread).alias("similarity"))


def outlink_vectors(links: DataFrame, total: DataFrame) -> DataFrame:
    """(page_id, target, w): ln(N / inlinks of the target)."""
    n = inlinks(links).crossJoin(F.broadcast(total)).select("target", F.log(F.col("n_docs") / F.col("n_pages")).alias("w"))
    return links.join(n, "target").select("page_id", "target", "w")


def tree_depths(edges: DataFrame, root: Any) -> DataFrame:
    """(node, depth): least number of edges from `root` over (parent, child); nodes out of reach are absent.

    A frontier a step, each checkpointed, until one is empty: as many steps as the graph is deep, no bound on it.
    """
    kind = dict(edges.dtypes)["child"]
    found = edges.sparkSession.range(1).select(F.lit(root).cast(kind).alias("node"), F.lit(0).alias("depth"))
    front, depth = found, 0
    while True:
        depth += 1
        front = settled(edges.join(front.select(F.col("node").alias("parent")), "parent").select(F.col("child").alias("node")).distinct().join(found.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return found
        found = found.unionByName(front)


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 20, tolerance: float | None = None) -> DataFrame:
    """(node, rank) over (src, dst, freq): V' = damping * M V + (1 - damping) / n, M from link shares, nodes without
    outlinks passing nothing on. `rounds` steps as given, or with a `tolerance` until no rank moves by more, however
    many that takes. Checkpointed every round."""
    nodes = settled(edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct())
    n = nodes.count()
    out = edges.groupBy("src").agg(F.sum("freq").alias("all"))
    share = settled(edges.join(out, "src").select("src", "dst", (F.col("freq") / F.col("all")).alias("p")))
    rank, step = nodes.withColumn("rank", F.lit(1.0 / max(n, 1))), 0
    while tolerance is not None or step < rounds:
        given = share.join(rank, share["src"] == rank["node"]).groupBy("dst").agg(F.sum(F.col("p") * F.col("rank")).alias("got"))
        after = settled(nodes.join(given, nodes["node"] == given["dst"], "left").select("node", (damping * F.coalesce("got", F.lit(0.0)) + (1 - damping) / n).alias("rank")))
        moved = None if tolerance is None else after.join(rank.withColumnRenamed("rank", "was"), "node").agg(F.max(F.abs(F.col("rank") - F.col("was")))).first()[0]
        rank, step = after, step + 1
        if tolerance is not None and (moved is None or moved <= tolerance):
            break
    return rank
