"""Queries over a category graph with second parents and cycles, made from the part numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import categories as cg
from lodestone.operators.links import tree_depths
from lodestone.plans.base import Views, query, rounded

#: k is a category's number, 0 the root; of each, one parent lies nearer to the root, some have a second, some edges lead back.
VIEWS = Views(
    num="SELECT p_partkey AS k FROM part",
    edges="SELECT CAST(floor(k / 4) AS BIGINT) AS parent, k AS child FROM num UNION SELECT CAST(floor(k / 4) AS BIGINT) + 1 AS parent, k AS child FROM num WHERE k % 6 = 0 AND k > 6 "
    "UNION SELECT k AS parent, CAST(floor(k / 16) AS BIGINT) AS child FROM num WHERE k % 25 = 24 AND k >= 16",
    nodes="SELECT k AS node FROM num UNION SELECT CAST(0 AS BIGINT) AS node",
    size="SELECT count(*) AS size FROM num",
    article="SELECT doc_id AS concept, (doc_id * 7) % size AS category FROM documents, size UNION SELECT doc_id AS concept, (doc_id * 13 + 5) % size AS category FROM documents, size WHERE doc_id % 2 = 0",
    article_count="SELECT category AS node, count(*) AS n_articles FROM article GROUP BY category",
    # in DuckDB only: recursive
    reach="SELECT CAST(0 AS BIGINT) AS node, 0 AS depth UNION SELECT child, depth + 1 FROM reach JOIN edges ON parent = node WHERE depth < 30",
    depths="SELECT node, min(depth) AS depth FROM reach GROUP BY node",
    level="SELECT parent, child, b.depth AS depth FROM edges JOIN depths a ON a.node = parent JOIN depths b ON b.node = child WHERE b.depth = a.depth + 1",
    leaf="SELECT DISTINCT child AS node FROM level WHERE child NOT IN (SELECT parent FROM level)",
    climb="SELECT node, n_articles AS n FROM leaf JOIN article_count USING (node) UNION ALL SELECT parent, n FROM climb JOIN level ON child = node",
    counted="SELECT node, CAST(sum(n) AS BIGINT) AS n FROM climb GROUP BY node",
    up="SELECT node AS start, node, [node] AS path FROM leaf UNION ALL SELECT start, parent, list_prepend(parent, path) FROM up JOIN level ON child = node WHERE depth > 1",
    down="SELECT CAST(1 AS BIGINT) AS node, [CAST(1 AS BIGINT)] AS path UNION ALL SELECT child, list_append(path, child) FROM down JOIN level ON parent = node",
    closed="SELECT parent AS start, child AS node FROM edges UNION SELECT start, child FROM closed JOIN edges ON parent = node",
)


def edges(spark, d):
    return VIEWS.frame(spark, d, "edges")


def level(spark, d):
    return cg.settled(cg.level_edges(edges(spark, d), 0))


def own_counts(spark, d):
    return VIEWS.frame(spark, d, "article_count")


@query(VIEWS.text("depths", last="SELECT node, depth FROM depths"))
def category_graph_depths(spark, d):
    return tree_depths(edges(spark, d), 0)


@query(VIEWS.text("level", last="SELECT parent, child, depth FROM level WHERE parent <> 3"))
def category_level_edges(spark, d):
    return cg.level_edges(edges(spark, d), 0, excluded=(3,))


@query(VIEWS.text("edges", "nodes", last="SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM nodes WHERE node NOT IN (SELECT child FROM edges)) AS n_isolated"))
def category_statistics(spark, d):
    return cg.statistics(VIEWS.frame(spark, d, "nodes"), edges(spark, d))


@query(VIEWS.text("edges", "nodes", last="SELECT node FROM nodes WHERE node NOT IN (SELECT child FROM edges)"))
def categories_without_parent(spark, d):
    return cg.isolated(VIEWS.frame(spark, d, "nodes"), edges(spark, d))


@query(VIEWS.text("closed", last="SELECT node FROM closed WHERE start = node"))
def categories_on_cycles(spark, d):
    return cg.on_cycles(edges(spark, d))


@query(VIEWS.text("level", "leaf", last="SELECT node FROM leaf"))
def leaf_categories(spark, d):
    return cg.leaves(level(spark, d))


@query(VIEWS.text("level", last="SELECT parent AS node, count(*) AS n_children FROM level GROUP BY parent"))
def category_child_counts(spark, d):
    return cg.child_counts(level(spark, d))


@query(VIEWS.text("counted", last="SELECT node, n FROM counted"))
def recursive_concept_counts(spark, d):
    return cg.recursive_counts(level(spark, d), own_counts(spark, d).withColumnRenamed("n_articles", "n"))


@query(VIEWS.text("up", last="SELECT DISTINCT start, '/' || array_to_string(path, '/') AS path FROM up JOIN level ON child = up.node WHERE level.depth = 1"))
def category_paths_to_level_one(spark, d):
    tree = level(spark, d)
    return cg.paths_up(tree, cg.leaves(tree)).select("start", F.concat(F.lit("/"), F.concat_ws("/", F.transform("path", lambda x: x.cast("string")))).alias("path"))


@query(VIEWS.text("down", "leaf", "counted", last="SELECT array_to_string(path, '/') AS path, coalesce(n, 0) AS n FROM down LEFT JOIN counted USING (node) WHERE len(path) > 1 AND (node NOT IN (SELECT node FROM leaf) OR coalesce(n, 0) > 5)"))
def category_subtree(spark, d):
    tree = level(spark, d)
    counts = cg.recursive_counts(tree, own_counts(spark, d).withColumnRenamed("n_articles", "n"))
    return cg.subtree(tree, 1, counts, 5)


@query(
    VIEWS.text(
        "nodes", "edges", "article_count", "depths",
        last="SELECT node, coalesce(p, 0) AS n_parents, coalesce(c, 0) AS n_children, coalesce(n_articles, 0) AS n_articles, coalesce(depth, -1) AS depth FROM nodes "
        "LEFT JOIN (SELECT child AS node, count(*) AS p FROM edges GROUP BY child) USING (node) LEFT JOIN (SELECT parent AS node, count(*) AS c FROM edges GROUP BY parent) USING (node) "
        "LEFT JOIN article_count USING (node) LEFT JOIN depths USING (node)",
    )
)
def category_export(spark, d):
    e = edges(spark, d)
    return cg.export(VIEWS.frame(spark, d, "nodes"), e, tree_depths(e, 0), own_counts(spark, d))


@query(VIEWS.text("article_count", last="SELECT n_articles, count(*) AS n_categories FROM article_count GROUP BY n_articles"))
def articles_per_category(spark, d):
    return own_counts(spark, d).groupBy("n_articles").agg(F.count("*").alias("n_categories"))


@query(VIEWS.text("article", last="SELECT category, list_sort(list(concept)) AS concepts, count(*) AS n FROM article GROUP BY category").replace("list_sort(list(concept))", "array_to_string(list_sort(list(concept)), ',')"))
def category_articles(spark, d):
    sets = VIEWS.frame(spark, d, "article").groupBy("category").agg(F.array_sort(F.collect_set("concept")).alias("c"))
    return sets.select("category", F.concat_ws(",", F.transform("c", lambda x: x.cast("string"))).alias("concepts"), F.size("c").cast("long").alias("n"))


@query(
    VIEWS.text(
        "level",
        last="SELECT node, code FROM (SELECT child AS node, CAST(row_number() OVER (PARTITION BY parent ORDER BY child) + 20 AS VARCHAR) AS code, 1 AS l FROM level WHERE depth = 1) UNION ALL "
        "SELECT y.child, x.code || lpad(CAST(row_number() OVER (PARTITION BY y.parent ORDER BY y.child) AS VARCHAR), 2, '0') FROM level y JOIN (SELECT child AS node, CAST(row_number() OVER (PARTITION BY parent ORDER BY child) + 20 AS VARCHAR) AS code FROM level WHERE depth = 1) x ON x.node = y.parent WHERE y.depth = 2",
    )
)
def category_codes(spark, d):
    return cg.nested_codes(level(spark, d), depth=2)


@query("SELECT n_name AS name, 1 + n_regionkey % 3 AS level, coalesce(r_name, CASE WHEN 1 + n_regionkey % 3 < 3 THEN '00' ELSE '000' END) AS code FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 2) ON r_regionkey * 5 = n_nationkey")
def name_codes(spark, d):
    nation, region = cg_read(spark, d, "nation"), cg_read(spark, d, "region").filter("r_regionkey < 2")
    mapping = region.join(nation, F.expr("r_regionkey * 5 = n_nationkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("code"))
    return cg.codes(nation.select(F.col("n_name").alias("name"), F.expr("1 + n_regionkey % 3").alias("level")), mapping)


def cg_read(spark, d, name):
    from lodestone.sources.tables import read

    return read(spark, d, name)


@query(VIEWS.text("depths", last="SELECT depth, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent FROM depths GROUP BY depth"))
def category_depth_shares(spark, d):
    found = tree_depths(edges(spark, d), 0)
    whole = found.agg(F.count("*").alias("whole"))
    return rounded(found.groupBy("depth").agg(F.count("*").alias("n")).crossJoin(whole).select("depth", "n", (100.0 * F.col("n") / F.col("whole")).alias("percent")), "percent")  # one row
