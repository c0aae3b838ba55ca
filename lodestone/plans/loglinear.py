"""Queries of log-linear models over unhashed terms. No SQL: their optima are tested against dense ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import loglinear
from lodestone.plans.base import query, rounded
from lodestone.sources.tables import read


def _labelled(spark, d):
    labels = read(spark, d, "labels").filter("quality in (0, 1)").select("doc_id", F.col("quality").alias("label"))
    return read(spark, d, "documents").join(labels, "doc_id").select("label", tx.terms(F.col("text")).alias("terms"))


@query()
def entropy_labels(spark, d):
    """The likelier quality of every document, by maximum entropy over all terms, the bias penalised too; 20 rounds."""
    weights, classes, _ = loglinear.maximum_entropy(_labelled(spark, d), rounds=20, tolerance=1e-4)
    p = loglinear.class_scores(read(spark, d, "documents").select("doc_id", tx.terms(F.col("text")).alias("terms")), weights, classes)
    return rounded(p.groupBy("doc_id").agg(F.max_by("label", "p").alias("predicted"), F.max("p").alias("p")), "p", digits=3)


@query()
def sparse_entropy_weights(spark, d):
    """The terms that a penalty on the weights' sum leaves a weight for quality 1, after 20 rounds."""
    weights, classes, _ = loglinear.maximum_entropy(_labelled(spark, d), 0.0, 2.0, rounds=20, tolerance=1e-4)
    found = weights.select("feature", F.col("w")[len(classes) - 1].alias("w")).filter("w <> 0")
    return rounded(found, "w", digits=3)
