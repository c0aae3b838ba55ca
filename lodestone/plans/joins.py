"""Queries of look-ups, link resolution, stop filters, grouping sets, as-of and range joins, dates and JSON."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import resolve
from lodestone.plans.base import Views, query, rounded
from lodestone.plans.wikitext import VIEWS as WIKI
from lodestone.sources.tables import read

_LINK = r"regexp_extract_all(text, '\[\[([^\]|:#]+)(?:[|#][^\]]*)?\]\]', 1)"
_CATEGORY = r"regexp_extract_all(text, '\[\[(?i:Category):([^\]|]+)', 1)"
VIEWS = Views(
    WIKI
    | {
        "name": "SELECT lower(title) AS name, min(id) AS id FROM wiki WHERE ns = 0 GROUP BY lower(title)",
        "link": f"SELECT id AS src, trim(unnest({_LINK})) AS target FROM wiki WHERE ns = 0",
        "resolved": "SELECT src, id AS dst, count(*) AS freq FROM link JOIN name ON name = lower(target) GROUP BY src, id",
        "redir": "SELECT lower(title) AS name, min(name.id) AS id FROM wiki JOIN name ON name.name = lower(redirect) WHERE lower(title) <> lower(redirect) GROUP BY lower(title)",
        "alias": "SELECT lower(redirect) AS name, list_sort(list(DISTINCT title)) AS aliases FROM wiki WHERE redirect IS NOT NULL GROUP BY lower(redirect)",
    }
)


def _names(spark, d):
    return WIKI.frame(spark, d, "wiki").filter("ns = 0").select("id", F.col("title").alias("name"))


def _links(spark, d):
    return WIKI.frame(spark, d, "wiki").filter("ns = 0").select(F.col("id").alias("src"), F.explode(tx.internal_links(F.col("text"))).alias("target"))


def _categories(spark, d):
    return WIKI.frame(spark, d, "wiki").filter("ns = 0").select("id", "title", F.explode(tx.categories(F.col("text"))).alias("category"))


@query(VIEWS.text("link", "name", last="SELECT src, target, coalesce(id, -1) AS id FROM link LEFT JOIN name ON name = lower(target)"))
def name_lookup(spark, d):
    return resolve.by_name(_links(spark, d), "target", _names(spark, d), -1).select("src", "target", "id")


@query(VIEWS.text("link", "name", "redir", last="SELECT src, target, coalesce(name.id, redir.id, 0) AS id FROM link LEFT JOIN name ON name.name = lower(target) LEFT JOIN redir ON redir.name = lower(target)"))
def name_or_alias_lookup(spark, d):
    found = resolve.redirects(WIKI.frame(spark, d, "wiki"), _names(spark, d))
    return resolve.by_name_or_alias(_links(spark, d), "target", _names(spark, d), found).select("src", "target", "id")


@query(VIEWS.text("resolved", last="SELECT src, dst, freq FROM resolved"))
def resolved_links(spark, d):
    return resolve.resolved_links(_links(spark, d), _names(spark, d))


@query(VIEWS.text("link", "name", last="SELECT count(DISTINCT src) AS pages, count(id) AS out_links, count(DISTINCT CASE WHEN id IS NOT NULL THEN (src, id) END) AS in_links, count(*) - count(id) AS skip_links FROM link LEFT JOIN name ON name = lower(target)"))
def link_totals(spark, d):
    return resolve.link_totals(_links(spark, d), _names(spark, d))


@query(VIEWS.text("redir", last="SELECT id, array_to_string(list_sort(list(name)), ',') AS names FROM redir GROUP BY id"))
def redirect_names(spark, d):
    found = resolve.redirects(WIKI.frame(spark, d, "wiki"), _names(spark, d))
    return resolve.redirect_names(found).select("id", F.concat_ws(",", "names").alias("names"))


@query(VIEWS.text("alias", last="SELECT name, array_to_string(aliases, ',') AS aliases FROM alias"))
def alias_lists(spark, d):
    return resolve.alias_lists(WIKI.frame(spark, d, "wiki")).select("name", F.concat_ws(",", "aliases").alias("aliases"))


_YEAR = "(length(title) > 7 AND regexp_matches(title, '^[0-9]{4}'))"


@query(
    VIEWS.text(
        "wiki",
        last=f"SELECT id, CASE WHEN redirect IS NOT NULL THEN 'redirect' WHEN ns = 0 THEN 'article' ELSE 'category' END AS kind FROM wiki WHERE redirect IS NOT NULL OR ns = 14 OR NOT ({_YEAR} OR contains(lower(title), 'list of') OR contains(lower(title), '(disambiguation)') OR regexp_matches(title, '\\(\\d{{4}}-\\d{{2,4}}\\)$'))",
    )
)
def first_stop_filter(spark, d):
    return resolve.first_stop(WIKI.frame(spark, d, "wiki"))


@query(
    VIEWS.text(
        "link", "alias",
        last="SELECT id, title, n_in, n_out, n_aliases FROM (SELECT id, title, coalesce((SELECT count(*) FROM link WHERE lower(target) = lower(title)), 0) AS n_in, (SELECT count(*) FROM link WHERE src = wiki.id) AS n_out, coalesce((SELECT len(aliases) FROM alias WHERE name = lower(title)), 0) AS n_aliases FROM wiki WHERE ns = 0) WHERE n_in + n_out >= 5",
    )
)
def second_stop_filter(spark, d):
    pages = WIKI.frame(spark, d, "wiki")
    found = resolve.second_stop(pages.filter("ns = 0").select("id", "title"), _links(spark, d), resolve.alias_lists(pages), 5)
    return found.withColumn("n_aliases", F.col("n_aliases").cast("long"))


@query(VIEWS.text("resolved", last="SELECT coalesce(a.id, b.id) AS id, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out FROM (SELECT dst AS id, count(DISTINCT src) AS n_in FROM resolved GROUP BY dst) a FULL JOIN (SELECT src AS id, count(DISTINCT dst) AS n_out FROM resolved GROUP BY src) b ON a.id = b.id"))
def concept_link_counts(spark, d):
    return resolve.in_and_out(resolve.resolved_links(_links(spark, d), _names(spark, d)))


@query(VIEWS.text("resolved", last="SELECT src, dst FROM resolved WHERE src % 4 = 1 AND dst % 3 <> 0 UNION ALL SELECT src, dst FROM resolved WHERE src % 4 <> 1 AND dst % 4 = 1"))
def kernel_links(spark, d):
    every = _names(spark, d).filter("id % 3 <> 0")
    return resolve.kernel_links(resolve.resolved_links(_links(spark, d), _names(spark, d)), _names(spark, d).filter("id % 4 = 1"), every)


@query(VIEWS.text("wiki", last=f"SELECT title, category FROM (SELECT DISTINCT id, title, trim(unnest({_CATEGORY})) AS category FROM wiki WHERE ns = 0) WHERE category IN ('C5', 'C10', 'C15')"))
def articles_of_accepted_categories(spark, d):
    some = spark.createDataFrame([("C5",), ("C10",), ("C15",)], "category string")
    return resolve.white_listed(_categories(spark, d), "category", some).select("title", "category")


@query(VIEWS.text("wiki", last=f"SELECT a.id AS concept, c.id AS category FROM (SELECT DISTINCT id, trim(unnest({_CATEGORY})) AS category FROM wiki WHERE ns = 0) a JOIN wiki c ON c.ns = 14 AND lower(regexp_replace(c.title, '(?i)^category:', '')) = lower(category)"))
def concept_categories(spark, d):
    names = WIKI.frame(spark, d, "wiki").filter("ns = 14").select("id", tx.category_title(F.col("title")).alias("name"))
    rows = _categories(spark, d).withColumnRenamed("id", "concept")
    return resolve.by_name(rows, "category", names, -1).filter("id >= 0").select("concept", F.col("id").alias("category"))


@query(VIEWS.text("wiki", last="SELECT id FROM wiki WHERE lower(title) NOT IN (SELECT lower(redirect) FROM wiki WHERE redirect IS NOT NULL)"))
def titles_not_yet_known(spark, d):
    pages = WIKI.frame(spark, d, "wiki")
    known = pages.filter("redirect is not null").select(F.lower("redirect").alias("_key"))
    return pages.withColumn("_key", F.lower("title")).join(known, "_key", "left_anti").select("id")


_GEO = "SELECT c_custkey AS uid, c_nationkey % 9 + 0.5::DOUBLE AS lon, c_custkey % 5 + 0.25::DOUBLE AS lat FROM customer"


def _points(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("uid"), F.expr("c_nationkey % 9 + 0.5D").alias("lon"), F.expr("c_custkey % 5 + 0.25D").alias("lat"))


def _known(spark, d):
    return read(spark, d, "nation").select(tx.coordinate_key(F.expr("n_nationkey % 6 + 0.5D"), F.expr("n_regionkey % 5 + 0.25D")).alias("key"), F.col("n_name").alias("country")).groupBy("key").agg(F.min("country").alias("country"))


_COUNTRY = f"p AS ({_GEO}), known AS (SELECT n_nationkey % 6 + 0.5::DOUBLE AS lon, n_regionkey % 5 + 0.25::DOUBLE AS lat, min(n_name) AS country FROM nation GROUP BY 1, 2), c AS (SELECT uid, coalesce(country, 'Ocean') AS country FROM p LEFT JOIN known USING (lon, lat))"


@query(f"WITH {_COUNTRY} SELECT uid, country FROM c")
def countries_of_points(spark, d):
    return resolve.countries(_points(spark, d), _known(spark, d)).select("uid", "country")


@query(f"WITH {_COUNTRY} SELECT uid % 50 AS uid, array_to_string(list_sort(list(DISTINCT country)), ',') AS countries FROM c WHERE country <> 'Ocean' GROUP BY uid % 50")
def users_abroad(spark, d):
    rows = resolve.countries(_points(spark, d), _known(spark, d)).withColumn("uid", F.col("uid") % 50)
    return resolve.abroad(rows, "Ocean").select("uid", F.concat_ws(",", "countries").alias("countries"))


@query(f"WITH p AS ({_GEO}) SELECT lon, lat, count(*) AS n FROM p GROUP BY lon, lat")
def distinct_places(spark, d):
    return resolve.places(_points(spark, d))


@query("SELECT user_id, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY user_id")
def page_views(spark, d):
    e = read(spark, d, "events")
    kind = e.agg(F.min("event_type").alias("kind"))
    return rounded(e.join(kind, e["event_type"] == kind["kind"], "left_semi").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total")


@query("SELECT p_brand || '/' || p_type AS path, string_agg(p_name, chr(10) ORDER BY p_partkey) AS text, count(*) AS n, 1 AS depth FROM part GROUP BY ALL")
def merged_topic_paths(spark, d):
    rows = read(spark, d, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("path"), F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    return resolve.merged_paths(rows)


@query("SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS g, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def order_cube(spark, d):
    return rounded(read(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), "total", digits=2)


@query("SELECT l_returnflag, l_linestatus, grouping(l_returnflag) * 2 + grouping(l_linestatus) AS g, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def line_rollup(spark, d):
    return read(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))


@query("SELECT event_id, (SELECT max_by(p.value, (p.ts, p.value)) FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.ts <= e.ts) AS as_of FROM events e WHERE event_type = 'click'")
def last_purchase_before_click(spark, d):
    e = read(spark, d, "events")
    clicks, buys = e.filter("event_type = 'click'").select("event_id", "user_id", "ts"), e.filter("event_type = 'purchase'").select("user_id", "ts", "value")
    return resolve.newest_before(clicks, buys, "user_id", "ts", "value").select("event_id", "as_of")


@query("SELECT o_orderkey, n_nationkey FROM orders JOIN nation ON o_totalprice >= n_nationkey * 7000.0 AND o_totalprice < n_nationkey * 7000.0 + 9000.0 + n_regionkey * 2500.0")
def orders_in_price_bands(spark, d):
    bands = read(spark, d, "nation").select("n_nationkey", F.expr("n_nationkey * 7000D").alias("low"), F.expr("n_nationkey * 7000D + 9000D + n_regionkey * 2500D").alias("high"))
    return resolve.within(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), bands, "o_totalprice", "low", "high", 8000.0).select("o_orderkey", "n_nationkey")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, year(ts) AS y, month(ts) AS m, dayofmonth(ts) AS d, hour(ts) AS h, CAST(date_trunc('month', ts) AS DATE) AS month_start, date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) AS days FROM events")
def event_dates_and_properties(spark, d):
    t = F.col("ts")
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.year(t).alias("y"), F.month(t).alias("m"), F.dayofmonth(t).alias("d"), F.hour(t).alias("h"), F.date_trunc("month", t).cast("date").alias("month_start"), F.datediff(t.cast("date"), F.lit("2020-01-01").cast("date")).alias("days"))


@query("(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def customers_by_set_operations(spark, d):
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    keys = lambda s: o.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return keys("F").intersect(keys("O")).subtract(c.filter("c_acctbal < 0").select("c_custkey"))


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def dearest_orders(spark, d):
    """The three dearest of each customer: the rank's limit is kept before the shuffle as well as after it."""
    o = read(spark, d, "orders").join(read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey"))
    return o.withColumn("place", place).filter("place <= 3").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
