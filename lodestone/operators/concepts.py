"""Concept vectors beyond the plain index: boosts, link and page-view vectors, their algebra, search and distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.links import inlinks as _inlinks


def vocabulary(counts: DataFrame, title_terms: DataFrame, least: int = 5) -> DataFrame:
    """(term, df) of terms in over `least` rows, or in some title."""
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    named = title_terms.select("term").distinct().withColumn("named", F.lit(True))
    return df.join(named, "term", "left").filter((F.col("df") > least) | F.col("named")).select("term", "df")


def named_counts(words: DataFrame, title_terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term, n, named) of words (key, term), a row for each occurrence: how often a term stands in a row, and whether in its
    title too. The title's terms are counted along, so that no join by row and term is needed."""
    rows = words.select(key, "term", F.lit(1).alias("n"), F.lit(False).alias("named"))
    rows = rows.unionByName(title_terms.select(key, "term", F.lit(0).alias("n"), F.lit(True).alias("named")))
    return rows.groupBy(key, "term").agg(F.sum("n").alias("n"), F.max("named").alias("named")).filter("n > 0")


def boosted(raw: DataFrame, boost: float = 1.5, key: str = "doc_id") -> DataFrame:
    """(key, term, w) of raw weights (key, term, x, named): those of title terms times `boost`. The norm is the root of the sum of squares
    plus (boost - 1) * x for each title term: a linear correction, as results that must match have it. Null keys are left out."""
    rows = raw.filter(F.col(key).isNotNull()).withColumn("named", F.col("named") & F.lit(boost > 1.1))
    square = F.col("x") * F.col("x") + F.when(F.col("named"), F.col("x") * (boost - 1)).otherwise(0.0)
    rows = rows.withColumn("norm", F.sqrt(F.sum(square).over(Window.partitionBy(key))))
    w = F.when(F.col("named"), F.col("x") * boost).otherwise(F.col("x")) / F.col("norm")
    return rows.select(key, "term", F.when(F.col("norm") > 0, w).otherwise(0.0).alias("w"))


def trimmed(vectors: DataFrame, limit: int) -> DataFrame:
    """The `limit` greatest of each query's (query, concept, v)."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.round("v", 9).desc(), "concept"))
    return vectors.withColumn("_r", place).filter(F.col("_r") <= limit).drop("_r")


def link_vectors(vectors: DataFrame, inlinks: DataFrame, limit: int) -> DataFrame:
    """(query, concept, v): each of the `limit` best concepts that a more general concept links to gets the weights of
    those of them that are among the best, too. q is more general than p if ln(in(q)) - ln(in(p)) > 1."""
    top = trimmed(vectors, limit)
    n = inlinks.groupBy("concept").agg(F.count("*").alias("n"))
    general = inlinks.join(n, "concept").join(n.select(F.col("concept").alias("source"), F.col("n").alias("m")), "source").filter(F.log("m") - F.log("n") > 1)
    given = top.select("query", F.col("concept").alias("source"), F.col("v").alias("given"))
    rows = top.join(general, "concept").join(given, ["query", "source"], "left")
    return rows.groupBy("query", "concept").agg(F.sum(F.coalesce("given", F.lit(0.0))).alias("v"))


def added(*vectors: DataFrame) -> DataFrame:
    """The sum of vectors; entries that come to nothing are left out."""
    every = vectors[0].select("query", "concept", "v")
    for v in vectors[1:]:
        every = every.unionByName(v.select("query", "concept", "v"))
    return every.groupBy("query", "concept").agg(F.sum("v").alias("v")).filter("v <> 0")


def merged(a: DataFrame, b: DataFrame, p: float) -> DataFrame:
    """a * (1 - p) + b * p."""
    return added(a.withColumn("v", F.col("v") * (1 - p)), b.withColumn("v", F.col("v") * p))


def norms(vectors: DataFrame) -> DataFrame:
    """(query, norm1, norm2): the plain sum and the length."""
    return vectors.groupBy("query").agg(F.sum("v").alias("norm1"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm2"))


def page_view_vectors(vectors: DataFrame, views: DataFrame) -> DataFrame:
    """(query, concept, v): log2(1 + views) of each query's concepts, normalised by their sum."""
    rows = vectors.select("query", "concept").join(views, "concept", "left").withColumn("x", F.log2(1 + F.coalesce("views", F.lit(0))))
    whole = F.sum("x").over(Window.partitionBy("query"))
    return rows.select("query", "concept", F.when(whole > 0, F.col("x") / whole).otherwise(0.0).alias("v"))


def combined(vectors: DataFrame, inlinks: DataFrame, limit: int = 50, views: DataFrame | None = None) -> DataFrame:
    """Cut to 2 * limit, plus the link vector; with `views`, (v + p * sum of v) / 2, p being the page-view vector."""
    base = trimmed(vectors, 2 * limit)
    out = added(base, link_vectors(base, inlinks, limit))
    if views is None:
        return out
    seen = page_view_vectors(out, views).withColumnRenamed("v", "p")
    whole = F.sum("v").over(Window.partitionBy("query"))
    return out.join(seen, ["query", "concept"]).select("query", "concept", ((F.col("v") + F.col("p") * whole) / 2).alias("v"))


def two_hops(links: DataFrame, total: DataFrame) -> DataFrame:
    """(page_id, target, w): ln(N / inlinks) of the pages a page links to, and for those two links away the sum of
    ln(N / inlinks) * (weight of the page between), which takes the place of a weight one link away."""
    n = _inlinks(links).crossJoin(total).select("target", F.log(F.col("n_docs") / F.col("n_pages")).alias("w"))  # one row
    one = links.select("page_id", "target").distinct().join(n, "target")
    second = links.select(F.col("page_id").alias("target"), F.col("target").alias("far")).distinct().join(n.select(F.col("target").alias("far"), F.col("w").alias("w2")), "far")
    two = one.join(second, "target").groupBy("page_id", F.col("far").alias("target")).agg(F.sum(F.col("w2") * F.col("w")).alias("w2"))
    return one.join(two, ["page_id", "target"], "full").select("page_id", "target", F.coalesce("w2", "w").alias("w"))


def inlink_similarity(pairs: DataFrame, links: DataFrame, total: DataFrame) -> DataFrame:
    """(a, b, similarity) of pairs of pages by the pages that link to both; 0 where there are none."""
    into = links.select(F.col("target").alias("page"), F.col("page_id").alias("source")).distinct()
    n = into.groupBy("page").agg(F.count("*").alias("n"))
    both = pairs.join(into.withColumnRenamed("page", "a"), "a").join(into.withColumnRenamed("page", "b"), ["b", "source"]).groupBy("a", "b").agg(F.count("*").alias("both"))
    rows = pairs.join(both, ["a", "b"], "left").join(n.toDF("a", "na"), "a", "left").join(n.toDF("b", "nb"), "b", "left").crossJoin(total)  # one row
    spread = F.log("n_docs") - F.log(F.least("na", "nb"))
    value = F.when(F.col("both").isNull(), 0.0).when(spread == 0, 1.0).otherwise(1 - (F.log(F.greatest("na", "nb")) - F.log("both")) / spread)
    return rows.select("a", "b", value.alias("similarity"))


def web_distances(docs: DataFrame, pairs: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """(a, b, distance) of pairs of phrases by the texts that hold them as words, twice their number counting; -1 where
    one occurs nowhere, 10000 where never together. One scan, a few counters for each pair."""
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), F.lit(" "))
    has = lambda p: F.contains(F.col("_t"), F.lit(f" {p.lower()} "))
    counts: list[Column] = [F.count("*").alias("n")]
    for k, (a, b) in enumerate(pairs):
        counts += [F.count_if(has(a)).alias(f"a{k}"), F.count_if(has(b)).alias(f"b{k}"), F.count_if(has(a) & has(b)).alias(f"c{k}")]
    whole = docs.select(plain.alias("_t")).agg(*counts)
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"a{k}").alias("fa"), F.col(f"b{k}").alias("fb"), F.col(f"c{k}").alias("fc")) for k, (a, b) in enumerate(pairs)])
    r = whole.select("n", F.explode(rows).alias("r")).select("n", "r.*")
    la, lb, lc = (F.log(2.0 * F.col(c)) for c in ("fa", "fb", "fc"))
    value = F.when((F.col("fa") == 0) | (F.col("fb") == 0), -1.0).when(F.col("fc") == 0, 10_000.0).otherwise((F.greatest(la, lb) - lc) / (F.log("n") - F.least(la, lb)))
    return r.select("a", "b", value.alias("distance"))


def search(queries: DataFrame, postings: DataFrame, titles: DataFrame, texts: DataFrame, top: int = 10, cut: int = 200) -> DataFrame:
    """(query, doc_id, rank, snippet): rows that hold a query term in title or text, by the sum of the terms' weights."""
    hits = queries.join(postings, "term").select("query", "doc_id", "w").unionByName(queries.join(titles, "term").select("query", "doc_id", F.lit(1.0).alias("w")))
    score = hits.groupBy("query", "doc_id").agg(F.sum("w").alias("score"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "doc_id"))
    best = score.withColumn("rank", place).filter(F.col("rank") <= top)
    snippet = F.when(F.length("text") > cut + 50, F.substring("text", 1, cut)).otherwise(F.col("text"))
    return best.join(texts, "doc_id").select("query", "doc_id", "rank", snippet.alias("snippet"))
