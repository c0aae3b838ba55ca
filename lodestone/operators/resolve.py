"""Names, aliases, redirects and links: look-ups as joins, and the filters and counts of a wiki's pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx


def first_ids(names: DataFrame) -> DataFrame:
    """(name, id) with the smallest id of each lower-cased name of (id, name)."""
    return names.groupBy(F.lower("name").alias("name")).agg(F.min("id").alias("id"))


def by_name(rows: DataFrame, column: str, names: DataFrame, otherwise: int | None = None) -> DataFrame:
    """`rows` with the first id of the name in `column`, whatever its case; `otherwise` where there is none."""
    found = rows.withColumn("_key", F.lower(column)).join(first_ids(names).withColumnsRenamed({"name": "_key"}), "_key", "left").drop("_key")
    return found.withColumn("id", F.coalesce("id", F.lit(otherwise).cast("long")))


def by_name_or_alias(rows: DataFrame, column: str, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """The id by name, else by alias, else 0."""
    one, two = first_ids(names).toDF("_key", "_one"), first_ids(aliases).toDF("_key", "_two")
    found = rows.withColumn("_key", F.lower(column)).join(one, "_key", "left").join(two, "_key", "left")
    return found.withColumn("id", F.coalesce("_one", "_two", F.lit(0))).drop("_key", "_one", "_two")


def resolved_links(links: DataFrame, names: DataFrame) -> DataFrame:
    """(src, dst, freq) of links (src, target) whose target is a known name."""
    known = first_ids(names).toDF("_key", "dst")
    return links.withColumn("_key", F.lower("target")).join(known, "_key").groupBy("src", "dst").agg(F.count("*").alias("freq"))


def link_totals(links: DataFrame, names: DataFrame) -> DataFrame:
    """One row: pages with links, links resolved, distinct pairs, links to unknown names."""
    known = first_ids(names).toDF("_key", "dst")
    rows = links.withColumn("_key", F.lower("target")).join(known, "_key", "left")
    return rows.agg(F.countDistinct("src").alias("pages"), F.count("dst").alias("out_links"), F.countDistinct(F.when(F.col("dst").isNotNull(), F.struct("src", "dst"))).alias("in_links"), F.count(F.when(F.col("dst").isNull(), 1)).alias("skip_links"))


def redirects(pages: DataFrame, names: DataFrame) -> DataFrame:
    """(name, id) of redirect pages (title, redirect) whose target is known and is another name, whatever the case."""
    known = first_ids(names).toDF("_key", "_id")
    return pages.filter("redirect is not null and lower(title) <> lower(redirect)").withColumn("_key", F.lower("redirect")).join(known, "_key").groupBy(F.lower("title").alias("name")).agg(F.min("_id").alias("id"))


def redirect_names(found: DataFrame) -> DataFrame:
    """(id, names): all names that lead to an id."""
    return found.groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("names"))


def alias_lists(pages: DataFrame) -> DataFrame:
    """(name, aliases): titles of the redirects to each lower-cased target, distinct, in order of the title."""
    return pages.filter("redirect is not null").groupBy(F.lower("redirect").alias("name")).agg(F.array_sort(F.collect_set("title")).alias("aliases"))


def accepted(title: Column, categories: Column, text: Column, least: int) -> Column:
    """First stop rule: a good title, not a disambiguation page by its few categories, text of over `least` characters."""
    list_ = (F.size(categories) < 3) & F.exists(categories, lambda c: c == "Disambiguation pages")
    return tx.accepts_title(title) & ~title.rlike(r"\(\d{4}(–|-)\d{2,4}\)$") & ~list_ & (F.length(text) > least)


def first_stop(pages: DataFrame, least: int = 20) -> DataFrame:
    """(id, kind) of what passes: articles, common categories, and redirects, which only give their names on."""
    rows = pages.withColumn("_c", tx.categories(F.col("text")))
    article = (F.col("ns") == 0) & accepted(F.col("title"), F.col("_c"), tx.plain_text(F.col("text")), least)
    kind = F.when(F.col("redirect").isNotNull(), "redirect").when(article, "article").when((F.col("ns") == 14) & (F.size("_c") > 0), "category")
    return rows.select("id", kind.alias("kind")).filter("kind is not null")


def second_stop(articles: DataFrame, links: DataFrame, aliases: DataFrame, least: int = 10) -> DataFrame:
    """(id, title, n_in, n_out, n_aliases) of articles with `least` links in and out together; links (src, target) count
    with their multiplicity, by the target's lower-cased name."""
    ins = links.groupBy(F.lower("target").alias("_key")).agg(F.count("*").alias("n_in"))
    outs = links.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_out"))
    rows = articles.withColumn("_key", F.lower("title")).join(ins, "_key", "left").join(outs, "id", "left").join(aliases.withColumnRenamed("name", "_key"), "_key", "left")
    rows = rows.select("id", "title", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_in", "n_out")), F.coalesce(F.size("aliases"), F.lit(0)).alias("n_aliases"))
    return rows.filter(F.col("n_in") + F.col("n_out") >= least)


def in_and_out(links: DataFrame) -> DataFrame:
    """(id, n_in, n_out): distinct pages that link to a page and that it links to."""
    ins = links.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("n_in"))
    outs = links.groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("n_out"))
    return ins.join(outs, "id", "full").select("id", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))


def white_listed(rows: DataFrame, column: str, allowed: DataFrame) -> DataFrame:
    """Rows whose value is allowed; an empty list allows all."""
    return rows if allowed.isEmpty() else rows.join(allowed.select(F.col(allowed.columns[0]).alias(column)), column, "left_semi")


def kernel_links(links: DataFrame, kernel: DataFrame, every: DataFrame) -> DataFrame:
    """Links from a kernel node to any known node, and from others to kernel nodes."""
    k, e = kernel.select("id"), every.select("id")
    from_kernel = links.join(k.withColumnRenamed("id", "src"), "src", "left_semi").join(e.withColumnRenamed("id", "dst"), "dst", "left_semi")
    rest = links.join(k.withColumnRenamed("id", "src"), "src", "left_anti").join(k.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return from_kernel.select("src", "dst").unionByName(rest.select("src", "dst"))


def countries(points: DataFrame, known: DataFrame) -> DataFrame:
    """`points` (lon, lat) with the country of their exact place; places that are none's are in the ocean."""
    keyed = points.withColumn("key", tx.coordinate_key(F.col("lon"), F.col("lat")))
    return keyed.join(known.select("key", "country"), "key", "left").withColumn("country", F.coalesce("country", F.lit("Ocean")))


def places(points: DataFrame) -> DataFrame:
    """(lon, lat, n): distinct places and how often they occur."""
    return points.groupBy("lon", "lat").agg(F.count("*").alias("n"))


def write_places(found: DataFrame, path: str, repeat: bool = False, rows: int = 200_000) -> None:
    """Places by longitude and latitude, once each or as often as they occur, `rows` a file."""
    out = found.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("_k") if repeat else found
    out.orderBy("lon", "lat").write.mode("overwrite").option("maxRecordsPerFile", rows).csv(path, header=True)


def abroad(rows: DataFrame, home: str) -> DataFrame:
    """(uid, countries) of users seen in other countries than `home`."""
    return rows.filter(F.col("country") != home).groupBy("uid").agg(F.array_sort(F.collect_set("country")).alias("countries"))


def merged_paths(rows: DataFrame) -> DataFrame:
    """(path, text, n, depth): the descriptions of each path, in order of their id, and its depth."""
    each = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("t"))
    return each.select("path", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"), F.size("t").cast("long").alias("n"), (F.size(F.split("path", "/")) - 1).alias("depth"))


def shared_stems(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of names of (id, name) and (id, name) that have a stemmed word in common, with the number of such words."""
    stems = lambda df, i: df.select(F.col("id").alias(i), F.explode(F.array_distinct(F.transform(tx.stemmed("regexp_extract_all(lower(name), '[a-z]+', 0)"), lambda x: x))).alias("stem"))
    return stems(a, "a").join(stems(b, "b"), "stem").groupBy("a", "b").agg(F.count("*").alias("n"))


def newest_before(rows: DataFrame, events: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """As-of join: each row with the value of the last event of its key at or before its time, by one sort of both."""
    left = rows.select(*rows.columns, F.lit(None).cast(dict(events.dtypes)[value]).alias("_v"), F.lit(1).alias("_side"))
    right = events.select(*(F.col(c) if c in (key, at) else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes), F.col(value).alias("_v"), F.lit(0).alias("_side"))
    w = Window.partitionBy(key).orderBy(at, "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    return left.unionByName(right).withColumn("as_of", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1").drop("_v", "_side")


def within(rows: DataFrame, spans: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Range join: rows whose value lies in low <= value < high of a span. Both sides are cut into bins of `width`, a
    span into all that it touches, so that it is an equi-join and no product."""
    bin_ = lambda c: F.floor(F.col(c) / width)
    cut = spans.withColumn("_bin", F.explode(F.sequence(bin_(low), F.greatest(bin_(low), F.ceil(F.col(high) / width) - 1))))
    return rows.withColumn("_bin", bin_(value)).join(cut, "_bin").filter((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("_bin")
