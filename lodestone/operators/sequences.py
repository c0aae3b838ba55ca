"""Token and label sequences: windows, spans, n-grams, key phrases and divergences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.sources.tables import settled


def window_features(rows: DataFrame, key: str, order: str, value: str, left: int = -2, right: int = 3) -> DataFrame:
    """Values at offsets left <= k < right around each row (itself skipped); <START n> and <END n> beyond the ends."""
    w = Window.partitionBy(key).orderBy(order)
    whole = Window.partitionBy(key)
    place, size = F.row_number().over(w), F.count("*").over(whole)
    out = rows.withColumn("_p", place).withColumn("_n", size)
    for k in range(left, right):
        if k:
            at = F.col("_p") + k
            near = F.lag(value, -k).over(w) if k < 0 else F.lead(value, k).over(w)
            beyond = F.when(at < 1, F.format_string("<START%d>", F.lit(1) - at)).when(at > F.col("_n"), F.format_string("<END%d>", at - F.col("_n")))
            out = out.withColumn(f"at_{k}".replace("-", "m"), F.coalesce(beyond, near))
    return out.drop("_p", "_n")


def bio(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Tags: I- where the previous row has the same value, else B-."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("tag", F.concat(F.when(before == F.col(value), "I-").otherwise("B-"), F.col(value)))


def spans(tagged: DataFrame, key: str, order: str) -> DataFrame:
    """(key, type, first, last): runs of BIO tags."""
    w = Window.partitionBy(key).orderBy(order)
    run = F.sum(F.col("tag").startswith("B-").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return tagged.withColumn("run", run).groupBy(key, "run").agg(F.first(F.expr("substring(tag, 3)")).alias("type"), F.min(order).alias("first"), F.max(order).alias("last")).drop("run")


def bigram_counts(docs: DataFrame) -> DataFrame:
    """(a, b, n): adjacent analysed terms over all documents."""
    t = docs.select(tx.terms(F.col("text")).alias("t")).filter(F.size("t") > 1)
    pair = F.arrays_zip(F.slice("t", F.lit(1), F.size("t") - 1).alias("a"), F.slice("t", F.lit(2), F.size("t") - 1).alias("b"))
    return t.select(F.explode(pair).alias("p")).select("p.a", "p.b").groupBy("a", "b").agg(F.count("*").alias("n"))


def association(bigrams: DataFrame) -> DataFrame:
    """(a, b, n, g2): four-cell log-likelihood of each bigram, cells smoothed by 0.01."""
    bigrams = settled(bigrams)  # read four times, and counted once
    left = bigrams.groupBy("a").agg(F.sum("n").alias("na"))
    right = bigrams.groupBy("b").agg(F.sum("n").alias("nb"))
    whole = F.broadcast(bigrams.agg(F.sum("n").alias("all")))  # one row
    x = bigrams.join(left, "a").join(right, "b").crossJoin(whole)
    k = [F.col("n"), F.col("na") - F.col("n"), F.col("nb") - F.col("n"), F.col("all") - F.col("na") - F.col("nb") + F.col("n")]
    k = [c.cast("double") + 0.01 for c in k]
    r1, r2, c1, c2 = k[0] + k[1], k[2] + k[3], k[0] + k[2], k[1] + k[3]
    total = r1 + r2
    g2 = 2 * sum((o * F.log(o * total / (r * c)) for o, r, c in ((k[0], r1, c1), (k[1], r1, c2), (k[2], r2, c1), (k[3], r2, c2))), F.lit(0.0))
    return x.select("a", "b", "n", g2.alias("g2"))


def phrases(docs: DataFrame, key: str = "doc_id", stop: tuple[str, ...] = tx.STOP_WORDS) -> DataFrame:
    """(key, phrase): candidate key phrases, runs of words between punctuation and stop words, with repeats."""
    flat = F.regexp_replace(F.lower("text"), "[^a-z ]+", " | ")
    words = F.filter(F.split(flat, " +"), lambda w: F.length(w) > 0)
    marked = F.transform(words, lambda w: F.when(w.isin(*stop), F.lit("|")).otherwise(w))
    pieces = F.split(F.array_join(marked, " "), r"[ ]*\|[ |]*")
    return docs.select(key, F.explode(pieces).alias("phrase")).select(key, F.trim("phrase").alias("phrase")).filter("phrase <> ''")


def rake(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, phrase, score): word score (degree + frequency) / frequency per document, a phrase sums its words."""
    p = phrases(docs, key).withColumn("words", F.split("phrase", " "))
    w = p.select(key, F.explode("words").alias("word"), (F.size("words") - 1).alias("deg")).groupBy(key, "word").agg(((F.sum("deg") + F.count("*")) / F.count("*")).alias("s"))
    d = p.select(key, "phrase", "words").dropDuplicates([key, "phrase"]).select(key, "phrase", F.explode("words").alias("word"))
    return d.join(w, [key, "word"]).groupBy(key, "phrase").agg(F.sum("s").alias("score"))


def entropy(counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_terms, entropy in nats) of each row's term distribution."""
    size = counts.groupBy(key).agg(F.sum("n").alias("n_terms"))
    p = F.col("n") / F.col("n_terms")
    return counts.join(size, key).groupBy(key, "n_terms").agg(F.sum(-p * F.log(p)).alias("entropy"))


def divergence(counts: DataFrame, group: str) -> DataFrame:
    """(a, b, js): Jensen-Shannon divergence in bits between the term distributions of groups (few)."""
    size = counts.groupBy(group).agg(F.sum("n").alias("size"))
    p = counts.join(size, group).select(group, "term", (F.col("n") / F.col("size")).alias("p"))
    kinds = size.select(group)
    pairs = kinds.select(F.col(group).alias("a")).join(kinds.select(F.col(group).alias("b")), F.col("a") < F.col("b"))
    side = lambda own: p.join(pairs, p[group] == pairs[own]).select("a", "b", "term", *(F.when(F.lit(own == s), F.col("p")).otherwise(0.0).alias(s + "p") for s in "ab"))
    both = side("a").unionByName(side("b")).groupBy("a", "b", "term").agg(F.sum("ap").alias("p"), F.sum("bp").alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    term = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return both.groupBy("a", "b").agg((F.sum(term(F.col("p")) + term(F.col("q"))) / 2).alias("js"))
