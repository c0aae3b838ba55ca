"""TF-IDF index and explicit semantic analysis."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx

LIMIT = 50
#: Characters whose terms a task counts at once, about, where rows are dealt to as many tasks as their texts need.
HELD = 32_000_000


def term_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term): each analysed term of each row's text as often as it stands there; words are filtered as rows, in generated code."""
    return docs.select(key, F.explode(tx.words(F.col("text"))).alias("term")).filter(tx.is_term(F.col("term")))


def term_counts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term, n): occurrences of each analysed term in each row's text."""
    return term_rows(docs, key).groupBy(key, "term").agg(F.count("*").alias("n"))


def dealt_by_size(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` dealt by `key` to as many tasks as their texts need, so that what a task counts by key doesn't grow with the rows; what
    is counted by key and more is not dealt again. Few rows may make much text, which sizes of files don't tell."""
    n = docs.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0
    if n <= HELD:
        return docs
    return docs.repartition(max(-(-n // HELD), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


def frequencies(counts: DataFrame, total: DataFrame) -> DataFrame:
    """(term, df, idf), idf = ln(N / df); `total` is one row with n_docs."""
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(total)).select("term", "df", F.log(F.col("n_docs") / F.col("df")).alias("idf"))  # one row


def tfidf(counts: DataFrame, idf: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term, w): (1 + ln tf) * idf, L2-normalised per row; terms of every row have idf 0 and weight 0. Null keys are left out."""
    raw = counts.filter(F.col(key).isNotNull()).join(idf, "term").withColumn("x", (1 + F.log("n")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key)))
    return raw.withColumn("norm", norm).select(key, "term", F.when(F.col("norm") > 0, F.col("x") / F.col("norm")).otherwise(0.0).alias("w"))


def pruned_postings(weights: DataFrame, always: int = 100, drop: float = 0.005) -> DataFrame:
    """(term, doc_id, w, rank): the first `always` postings by weight, then on while the last hundred still fall by
    over `drop` of the greatest weight; the first failure ends the list.

    Weights fall by at most the greatest in all, so at most 1 / drop stretches of `always` postings can go on: what lies
    beyond can't be in a list, and is cut off in each task before a frequent term's postings meet.
    """
    w = Window.partitionBy("term").orderBy(F.col("near").desc(), "doc_id")  # a column, so that all windows share one sort
    longest = always * (2 + math.ceil(1 / drop))
    ranked = weights.withColumn("near", F.round("w", 9)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= longest).withColumn("rank", F.col("rank") - 1)
    ranked = ranked.withColumn("top", F.first("w").over(w)).withColumn("before", F.lag("w", 1).over(w)).withColumn("far", F.lag("w", always).over(w))
    fails = (F.col("rank") >= always) & ~(F.col("top") * drop < F.col("far") - F.col("before"))
    failed = F.sum(fails.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("failed", failed).filter("failed = 0").select("term", "doc_id", "w", "rank")


def concept_vectors(queries: DataFrame, key: str, postings: DataFrame, idf: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(key, doc_id, score, rank): each query text's `limit` best concepts (documents).

    A query term weighs (1 + ln f) * idf, L2-normalised; every occurrence adds posting * weight; the sum is divided
    by the number of the query's terms, unknown ones included.
    """
    counts = term_counts(queries, key)
    size = counts.groupBy(key).agg(F.sum("n").alias("n_terms"))
    known = counts.join(idf.filter("idf > 0"), "term").withColumn("x", (1 + F.log("n")) * F.col("idf"))
    norm = known.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm")).join(size, key)
    q = known.join(norm, key).select(key, "term", (F.col("n") * F.col("x") / F.col("norm") / F.col("n_terms")).alias("q"))
    score = q.join(postings, "term").groupBy(key, "doc_id").agg(F.sum(F.col("q") * F.col("w")).alias("score"))
    order = Window.partitionBy(key).orderBy(F.round("score", 9).desc(), "doc_id")
    return score.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def vector_cosine(pairs: DataFrame, vectors: DataFrame, a: str, b: str, key: str, dim: str, value: str) -> DataFrame:
    """`pairs` (a, b) with the cosine of their sparse vectors; -1 where either has none."""
    norm = vectors.groupBy(key).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm"))
    left = pairs.join(vectors.select(F.col(key).alias(a), F.col(dim).alias("_d"), F.col(value).alias("_x")), a)
    right = vectors.select(F.col(key).alias(b), F.col(dim).alias("_d"), F.col(value).alias("_y"))
    dot = left.join(right, [b, "_d"]).groupBy(a, b).agg(F.sum(F.col("_x") * F.col("_y")).alias("dot"))
    out = pairs.join(norm.select(F.col(key).alias(a), F.col("norm").alias("na")), a, "left").join(norm.select(F.col(key).alias(b), F.col("norm").alias("nb")), b, "left").join(dot, [a, b], "left")
    cosine = F.when(F.col("na").isNull() | F.col("nb").isNull(), -1.0).when(F.col("na") * F.col("nb") == 0, 0.0).otherwise(F.coalesce("dot", F.lit(0.0)) / (F.col("na") * F.col("nb")))
    return out.select(a, b, cosine.alias("cosine"))
