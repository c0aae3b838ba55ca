"""Queries of the text functions, over wiki pages made from parts and over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.plans.base import Views, query
from lodestone.sources import tables
from lodestone.sources.tables import read

VIEWS = Views(
    n_parts="SELECT count(*) AS n_all FROM part",
    wiki="SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 14 ELSE 0 END AS ns, "
    "CASE WHEN p_partkey % 5 = 0 THEN concat('Category:C', p_partkey) WHEN p_partkey % 11 = 0 THEN concat('List of parts ', p_partkey) WHEN p_partkey % 13 = 0 THEN concat('1999 in parts ', p_partkey) "
    "WHEN p_partkey % 17 = 0 THEN concat('Part ', p_partkey, ' (disambiguation)') WHEN p_partkey % 19 = 0 THEN concat('Part ', p_partkey, ' (1990-95)') ELSE concat('Part ', p_partkey) END AS title, "
    "CASE WHEN p_partkey % 7 = 0 AND p_partkey % 5 <> 0 THEN concat('Part ', (p_partkey + 5) % n_all + 1) WHEN p_partkey % 28 = 1 THEN concat('PART ', p_partkey) END AS redirect, "
    "concat('== ', p_brand, ' ==', chr(10), 'The ''''''', p_type, ''''''' is {{box|a={{b|c}} d}} made<ref>note</ref> of [[Part ', (p_partkey * 3) % n_all + 1, '|a label]] and [[PART ', (p_partkey + 1) % n_all + 1, ']].', chr(10), "
    "CASE WHEN p_partkey % 4 = 0 THEN concat('* item [[Nowhere ', p_partkey, ']]', chr(10)) ELSE '' END, 'key:value', chr(10), '[[Category:C', (p_partkey % 9) * 5 + 5, '|', p_name, ']]', "
    "CASE WHEN p_partkey % 3 = 0 THEN '[[category:C5]]{{Commonscat|Big Thing}}' ELSE '' END, CASE WHEN p_partkey % 10 = 0 THEN '{{CR| Old name }}' ELSE '' END) AS text FROM part, n_parts",
)
_LINES = "string_split(t, chr(10))"


def wiki(spark, d):
    return VIEWS.frame(spark, d, "wiki")


@query(VIEWS.text("wiki", last=r"SELECT id, array_to_string(list_distinct_ordered, ',') AS categories FROM (SELECT id, list_filter(list_transform(regexp_extract_all(text, '\[\[(?i:Category):([^\]|]+)', 1), lambda x: trim(x)), lambda x, i: list_position(list_transform(regexp_extract_all(text, '\[\[(?i:Category):([^\]|]+)', 1), lambda y: trim(y)), x) = i) AS list_distinct_ordered FROM wiki)"))
def page_categories(spark, d):
    return wiki(spark, d).select("id", F.concat_ws(",", tx.categories(F.col("text"))).alias("categories"))


@query(VIEWS.text("wiki", last=r"SELECT id, array_to_string(list_transform(regexp_extract_all(text, '\[\[([^\]|:#]+)(?:[|#][^\]]*)?\]\]', 1), lambda x: trim(x)), ',') AS links FROM wiki"))
def page_internal_links(spark, d):
    return wiki(spark, d).select("id", F.concat_ws(",", tx.internal_links(F.col("text"))).alias("links"))


@query(VIEWS.text("wiki", last=r"SELECT id, nullif(trim(regexp_extract(text, '(?i)\{\{\s*cr\s*\|([^}|]+)', 1)), '') AS redirect, nullif(trim(regexp_extract(text, '(?i)\{\{\s*commonscat\s*\|([^}|]+)', 1)), '') AS commons, regexp_replace(title, '(?i)^category:', '') AS category FROM wiki"))
def page_tags(spark, d):
    t = F.col("text")
    return wiki(spark, d).select("id", tx.category_redirect(t).alias("redirect"), tx.commons_tag(t).alias("commons"), tx.category_title(F.col("title")).alias("category"))


@query(
    VIEWS.text(
        "wiki",
        last=r"""SELECT id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_full_match(x, '[^:]+:[^ ]+')), chr(10)) AS plain FROM (
SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\{\{[^{}]*\}\}', '', 'g'), '\{\{[^{}]*\}\}', '', 'g'),
'<ref.*?</ref>', '', 'g'), '\[\[(?i:category):[^\]]*\]\]', '', 'g'), '\[\[(?:[^\]|]*\|)?([^\]|]*)\]\]', '\1', 'g'), '''{2,}', '', 'g'), '(?m)^\s*=+\s*(.*?)\s*=+\s*$', '\1', 'g'), '(?m)^[*#:;]+\s*', '', 'g') AS t FROM wiki)""",
    )
)
def page_plain_text(spark, d):
    return wiki(spark, d).select("id", tx.plain_text(F.col("text")).alias("plain"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(replace(lower(text), '''', ''), '[a-z0-9]+(?:[.@_&/-][a-z0-9]+)*'), ' ') AS cleaned, len(list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda x: trim(x)), lambda x: x <> '')) AS sentences FROM documents WHERE text IS NOT NULL")
def cleaned_texts(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").filter("text is not null").select("doc_id", tx.cleaned(t).alias("cleaned"), F.size(tx.sentences(t)).cast("long").alias("sentences"))


def _stems() -> str:
    out = "list_distinct(regexp_extract_all(lower(text), '[a-z]+'))"
    for step in tx.porter_steps("regexp_matches({0}, '{1}')"):
        out = f"list_transform({out}, lambda w: {step})"
    return out


@query(f"SELECT doc_id, array_to_string(list_sort({_stems()}), ' ') AS stems FROM documents WHERE text IS NOT NULL")
def stemmed_words(spark, d):
    found = tx.stemmed("array_distinct(regexp_extract_all(lower(text), '[a-z]+', 0))")
    return read(spark, d, "documents").filter("text is not null").select("doc_id", F.array_join(F.array_sort(found), " ").alias("stems"))


@query("SELECT o_orderkey AS id, translate(o_orderpriority, 'MEDIUM-', 'medium_') AS converted, regexp_full_match(substr(o_orderpriority, 1, 1) || '.5%', '[0-9.%年月日]+') AS numeric_ FROM orders")
def converted_characters(spark, d):
    p = F.col("o_orderpriority")
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), tx.converted(p, "MEDIUM-", "medium_").alias("converted"), tx.is_number_or_date(F.concat(F.substring(p, 1, 1), F.lit(".5%"))).alias("numeric_"))


@query("SELECT c_custkey AS id, CAST(c_nationkey AS DOUBLE) + 0.5 AS lon, -(c_custkey % 7) - 0.25 AS lat, printf('%.6f,%.6f', CAST(c_nationkey AS DOUBLE) + 0.5, -(c_custkey % 7) - 0.25::DOUBLE) AS key FROM customer".replace("-(c_custkey % 7) - 0.25 AS lat", "CAST(-(c_custkey % 7) - 0.25 AS DOUBLE) AS lat"))
def parsed_points(spark, d):
    geo = F.concat(F.lit("POINT("), F.col("c_nationkey"), F.lit(".5 "), F.when(F.col("c_custkey") % 7 == 0, "-0").otherwise(F.concat(F.lit("-"), F.col("c_custkey") % 7)), F.lit(".25)"))
    found = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), tx.point(geo).alias("p"))
    return found.select("id", "p.lon", "p.lat", tx.coordinate_key(F.col("p.lon"), F.col("p.lat")).alias("key"))


@query(VIEWS.text("wiki", last="SELECT id, title, category FROM (SELECT DISTINCT id, title, trim(unnest(regexp_extract_all(text, '\\[\\[(?i:Category):([^\\]|]+)', 1))) AS category FROM wiki WHERE redirect IS NULL)"))
def category_store_rows(spark, d):
    return tables.category_rows(wiki(spark, d))


@query(VIEWS.text("wiki", last="SELECT id, trim(regexp_extract(l, '\\[\\[([^\\]|:#]+)\\|([^\\]]+)\\]\\]', 1)) AS target, trim(regexp_extract(l, '\\[\\[([^\\]|:#]+)\\|([^\\]]+)\\]\\]', 2)) AS label FROM (SELECT id, unnest(regexp_extract_all(text, '(\\[\\[[^\\]|:#]+\\|[^\\]]+\\]\\])', 1)) AS l FROM wiki)"))
def link_labels(spark, d):
    return tables.anchors(wiki(spark, d))


@query(VIEWS.text("wiki", last="SELECT id, title FROM wiki WHERE ns = 0 AND length(title) < 7"))
def short_titles(spark, d):
    return wiki(spark, d).filter("ns = 0").filter(F.length("title") < 7).select("id", "title")


@query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def gzip_round_trip(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("doc_id", tables.gunzipped(tables.gzipped("text")).alias("text"))
