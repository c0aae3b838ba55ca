"""Labelled text: naive Bayes, information gain, splits and evaluation, clustering measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.tables import settled


def naive_bayes(counts: DataFrame, labels: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(label, term, logp) of seen pairs, and (label, prior, unseen): Laplace over the vocabulary and the classes."""
    rows = counts.join(labels, key)
    pairs = rows.groupBy("label", "term").agg(F.sum("n").alias("n"))
    vocabulary = counts.select(F.countDistinct("term").alias("v"))
    size = pairs.groupBy("label").agg(F.sum("n").alias("total"))
    classes = labels.groupBy("label").agg(F.count("*").alias("docs"))
    whole = classes.agg(F.sum("docs").alias("all"), F.count("*").alias("kinds"))
    priors = classes.join(size, "label", "left").crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(vocabulary))  # one row each
    priors = priors.select("label", F.log((F.col("docs") + 1) / (F.col("all") + F.col("kinds"))).alias("prior"), (F.coalesce("total", F.lit(0)) + F.col("v")).alias("room"))
    model = pairs.join(F.broadcast(priors), "label").select("label", "term", F.log((F.col("n") + 1) / F.col("room")).alias("logp"))
    return model, priors.select("label", "prior", F.log(1 / F.col("room")).alias("unseen"))


def naive_bayes_predict(counts: DataFrame, model: DataFrame, priors: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, label, score): log prior + sum n * log p for every row and label.

    The priors are a row per class: they go to every task, as a shuffle by label would gather all rows in a task per class.
    """
    priors = F.broadcast(priors)
    size = counts.groupBy(key).agg(F.sum("n").alias("size"))
    gain = counts.join(model, "term").join(priors, "label").groupBy(key, "label").agg(F.sum(F.col("n") * (F.col("logp") - F.col("unseen"))).alias("gain"))
    base = size.crossJoin(priors)
    return base.join(gain, [key, "label"], "left").select(key, "label", (F.col("prior") + F.col("size") * F.col("unseen") + F.coalesce("gain", F.lit(0.0))).alias("score"))


def best_label(scores: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, predicted): the label with the greatest score, the smaller label at ties."""
    top = scores.groupBy(key, F.round("score", 6).alias("s")).agg(F.min("label").alias("l")).groupBy(key).agg(F.max_by("l", "s").alias("predicted"))
    return top.select(key, "predicted")


def class_measures(pairs: DataFrame) -> DataFrame:
    """Per label of (label, predicted): tp, fp, fn, precision, recall, f1 (1 where nothing was there to find)."""
    both = pairs.groupBy("label", "predicted").agg(F.count("*").alias("n"))
    rows = both.select("label", F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).alias("fp"), F.when(F.col("label") != F.col("predicted"), F.col("n")).otherwise(0).alias("fn"))
    rows = rows.unionByName(both.filter("label <> predicted").select(F.col("predicted").alias("label"), F.lit(0).alias("tp"), F.col("n").alias("fp"), F.lit(0).alias("fn")))
    s = rows.groupBy("label").agg(*(F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")))
    p = F.when(F.col("tp") + F.col("fp") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fp")))
    r = F.when(F.col("tp") + F.col("fn") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fn")))
    s = s.withColumn("precision", p).withColumn("recall", r)
    return s.withColumn("f1", F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)))


def _xlog2(n, total):
    return F.when(n > 0, -(n / total) * F.log2(n / total)).otherwise(0.0)


def information_gain(counts: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(term, gain) in bits of a term's presence about a 0/1 label."""
    whole = F.broadcast(labels.agg(F.count("*").alias("n"), F.sum("label").alias("pos")))  # one row
    t = counts.join(labels, key).groupBy("term").agg(F.count("*").alias("k"), F.sum("label").alias("kp")).crossJoin(whole)
    entropy = lambda p, n: F.when(n > 0, _xlog2(p, n) + _xlog2(n - p, n)).otherwise(0.0)
    n, k, pos, kp = (F.col(c).cast("double") for c in ("n", "k", "pos", "kp"))
    return t.select("term", (entropy(pos, n) - k / n * entropy(kp, k) - (n - k) / n * entropy(pos - kp, n - k)).alias("gain"))


def numbered(rows: DataFrame, *order: str, ascending: bool = True, value: str | None = None) -> DataFrame:
    """`rows` with number, their place in the order of these columns, from 1; with `value`, its running sum instead.

    No window over everything: rows are range-partitioned, summed within their partition, and the sums of the
    partitions before (one row a partition) are added.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc() if ascending else F.col(c).desc() for c in order]
    dealt = settled(rows.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()))
    own = F.lit(1) if value is None else F.col(value)
    sizes = dealt.groupBy("_part").agg(F.sum(own).alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))  # one row a partition
    run = F.sum(own).over(Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_run", run).join(before, "_part").withColumn("number", F.col("_run") + F.col("_before")).drop("_part", "_run", "_before")


def folds(rows: DataFrame, key: str, label: str, m: int) -> DataFrame:
    """(key, label, fold): round-robin inside each class, in order of the key.

    A class may hold most rows, so a place in it is its place in the order by class and key, less the rows of the
    classes before (one row a class).
    """
    sizes = rows.groupBy(label).agg(F.count("*").alias("_n"))
    before = sizes.select(F.col(label).alias("_label"), (F.sum("_n").over(Window.orderBy(label)) - F.col("_n")).alias("_before"))  # one row a class
    placed = numbered(rows.select(key, label), label, key)
    return placed.join(before, F.col(label).eqNullSafe(F.col("_label"))).select(key, label, ((F.col("number") - F.col("_before") - 1) % m).alias("fold"))


def roc_counts(rows: DataFrame) -> DataFrame:
    """Per distinct score of (score, label 0/1): positives and negatives with a score at or above it."""
    each = rows.groupBy("score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    tp = numbered(each, "score", ascending=False, value="p").withColumnRenamed("number", "tp")
    return numbered(tp, "score", ascending=False, value="q").select("score", "tp", F.col("number").alias("fp"))


def clustering_measures(rows: DataFrame) -> DataFrame:
    """One row of pair and B-cubed precision, recall and F1 for (truth, cluster), from the contingency table."""
    cell = rows.groupBy("truth", "cluster").agg(F.count("*").alias("n"))
    a = cell.groupBy("truth").agg(F.sum("n").alias("na"))
    b = cell.groupBy("cluster").agg(F.sum("n").alias("nb"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    whole = cell.join(a, "truth").join(b, "cluster").agg(pairs("n").alias("both"), F.sum(F.col("n") * F.col("n") / F.col("nb")).alias("bp"), F.sum(F.col("n") * F.col("n") / F.col("na")).alias("br"), F.sum("n").alias("all"))
    whole = whole.crossJoin(F.broadcast(a.agg(pairs("na").alias("pa")))).crossJoin(F.broadcast(b.agg(pairs("nb").alias("pb"))))  # one row each
    p, r = F.when(F.col("pb") == 0, 1.0).otherwise(F.col("both") / F.col("pb")), F.when(F.col("pa") == 0, 1.0).otherwise(F.col("both") / F.col("pa"))
    bp, br = F.col("bp") / F.col("all"), F.col("br") / F.col("all")
    f1 = lambda x, y: F.when(x + y == 0, 0.0).otherwise(2 * x * y / (x + y))
    return whole.select(p.alias("pair_precision"), r.alias("pair_recall"), f1(p, r).alias("pair_f1"), bp.alias("b3_precision"), br.alias("b3_recall"), f1(bp, br).alias("b3_f1"))


def posteriors(scores: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, label, p): log scores of all labels of a row, less their maximum, exponentiated and normalised."""
    w = Window.partitionBy(key)
    raised = scores.withColumn("e", F.exp(F.col("score") - F.max("score").over(w)))
    return raised.select(key, "label", (F.col("e") / F.sum("e").over(w)).alias("p"))


def accuracy_at_coverage(rows: DataFrame) -> DataFrame:
    """(score, coverage, accuracy) of (score, correct 0/1): what is covered from the highest score down, and right there."""
    each = rows.groupBy("score").agg(F.count("*").alias("n"), F.sum("correct").alias("k"))
    whole = rows.agg(F.count("*").alias("total"))
    run = numbered(numbered(each, "score", ascending=False, value="n").withColumnRenamed("number", "n_run"), "score", ascending=False, value="k").crossJoin(whole)  # one row
    return run.select("score", (F.col("n_run") / F.col("total")).alias("coverage"), (F.col("number") / F.col("n_run")).alias("accuracy"))


def coverage_area(curve: DataFrame) -> DataFrame:
    """One row: the area under (coverage, accuracy) by trapezoids over 1 to 100 per cent, a unit each."""
    steps = curve.select(F.explode(F.sequence(F.lit(1), F.lit(100))).alias("at"), "coverage", "accuracy").filter(F.col("coverage") * 100 >= F.col("at") - 1e-9)
    at = steps.groupBy("at").agg(F.min_by("accuracy", "coverage").alias("y"))
    return at.agg((F.sum("y") - (F.sum(F.when(F.col("at").isin(1, 100), F.col("y")).otherwise(0.0))) / 2).alias("area"))
