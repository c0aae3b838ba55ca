"""Queries of semantic path mining over the category graph, with concept weights made from the ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import categories as cg
from lodestone.operators import mining
from lodestone.plans import categories as base
from lodestone.plans.base import Views, query, rounded

TOP = 3
VIEWS = Views(
    base.VIEWS
    | {
        "n_docs": "SELECT count(*) AS n FROM documents",
        "vectors": "SELECT item_id AS query, (item_id * 37 + n_nationkey * 11) % n AS concept, 1.0 / (n_nationkey + 1) AS v FROM benchmark, nation, n_docs WHERE n_nationkey < 8",
        "vector": "SELECT query, concept, CAST(max(v) AS DOUBLE) AS v FROM vectors GROUP BY query, concept",
        "inlinks": "SELECT doc_id AS concept, (doc_id + 11) % n AS source FROM documents, n_docs UNION SELECT doc_id AS concept, (doc_id * 3 + 1) % n AS source FROM documents, n_docs",
        "top": "SELECT query, concept, category, v FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY v DESC, concept) AS r FROM vector) JOIN article USING (concept) WHERE r <= 50",
        "near": "SELECT t.query, t.category, t.concept, sum(s.v) AS given FROM top t JOIN inlinks i ON i.concept = t.concept JOIN top s ON s.query = t.query AND s.category = t.category AND s.concept = i.source GROUP BY ALL",
        "n_in": "SELECT concept, count(*) AS n_in FROM inlinks GROUP BY concept",
        "mean": "SELECT query, category, avg(0.6::DOUBLE * v + 0.4::DOUBLE * coalesce(given / n_in, 0)) AS w FROM top LEFT JOIN n_in USING (concept) LEFT JOIN near USING (query, category, concept) GROUP BY ALL",
        "dist": "SELECT query, category, w / sum(w) OVER (PARTITION BY query) AS w FROM mean",
        "part_": "SELECT child AS node, parent, 1.0::DOUBLE / count(*) OVER (PARTITION BY child) AS p FROM level",
        "push": "SELECT query, category AS node, w FROM dist UNION ALL SELECT query, parent, w * p FROM push JOIN part_ USING (node)",
        "visited": "SELECT query, node, sum(w) AS w FROM push GROUP BY ALL",
        "drill": "SELECT DISTINCT query, CAST(0 AS BIGINT) AS node, [CAST(0 AS BIGINT)] AS nodes, [1.0::DOUBLE] AS weights FROM visited "
        "UNION ALL SELECT drill.query, level.child, list_append(nodes, level.child), list_append(weights, visited.w) FROM drill JOIN level ON level.parent = drill.node JOIN visited ON visited.query = drill.query AND visited.node = level.child",
        "path": "SELECT query, nodes, weights, list_sum(weights) / len(weights) AS score FROM drill WHERE len(nodes) > 1 AND NOT EXISTS (SELECT 1 FROM level JOIN visited ON visited.node = level.child WHERE level.parent = drill.node AND visited.query = drill.query)",
    }
)


def _dependence(a: str, b: str, skip: int = 0) -> str:
    short, long = f"least(len({a}), len({b}))", f"greatest(len({a}), len({b}))"
    places = f"range({skip}, {short})"
    same = f"list_sum(list_transform({places}, lambda i: CASE WHEN {a}[i + 1] = {b}[i + 1] THEN ({short} - i)::DOUBLE ELSE 0 END))"
    room = f"(coalesce(list_sum(list_transform({places}, lambda i: ({short} - i)::DOUBLE)), 0) + {long} - {short})"
    return f"CASE WHEN {a}[-1] = {b}[-1] THEN 1.0::DOUBLE WHEN {room} = 0 THEN 0 ELSE coalesce({same}, 0) / {room} END"


def _greedy() -> str:
    """The choice of independent paths, step by step."""
    parts, left = [], "path"
    for k in range(1, TOP + 1):
        parts.append(f"best{k} AS (SELECT query, nodes AS best, score AS best_score FROM {left} QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, nodes) = 1)")
        parts.append(f"left{k} AS (SELECT query, nodes, score FROM {left} JOIN best{k} USING (query) WHERE {_dependence('nodes', 'best')} <= 0.7)")
        left = f"left{k}"
    return ", " + ", ".join(parts) + ", chosen AS (" + " UNION ALL ".join(f"SELECT query, best AS nodes, best_score AS score, {k} AS place FROM best{k}" for k in range(1, TOP + 1)) + ") "


def _text(column: str = "nodes"):
    return F.concat_ws("/", F.transform(column, lambda x: x.cast("string")))


def _distribution(spark, d):
    return mining.category_distribution(*(VIEWS.frame(spark, d, x) for x in ("vector", "article", "inlinks")))


def _visited(spark, d):
    return mining.propagated(base.level(spark, d), _distribution(spark, d))


def _paths(spark, d):
    tree = base.level(spark, d)
    return mining.scored(mining.paths(tree, cg.settled(mining.propagated(tree, _distribution(spark, d))), 0))


@query(VIEWS.text("dist", last="SELECT query, category, round(w, 6) AS w FROM dist"))
def category_distribution(spark, d):
    return rounded(_distribution(spark, d), "w")


@query(VIEWS.text("visited", last="SELECT query, node, round(w, 6) AS w FROM visited"))
def category_weight_propagation(spark, d):
    return rounded(_visited(spark, d), "w")


@query(
    VIEWS.text("dist", "level", "counted", last="").rstrip()
    + ", part2 AS (SELECT child AS node, parent, n / sum(n) OVER (PARTITION BY child) AS p FROM level JOIN counted ON counted.node = parent), "
    "push2 AS (SELECT query, category AS node, w FROM dist UNION ALL SELECT query, parent, w * p FROM push2 JOIN part2 USING (node)) SELECT query, node, round(sum(w), 6) AS w FROM push2 GROUP BY ALL"
)
def category_weight_by_counts(spark, d):
    tree = base.level(spark, d)
    counts = cg.recursive_counts(tree, base.own_counts(spark, d).withColumnRenamed("n_articles", "n"))
    return rounded(mining.propagated(tree, _distribution(spark, d), counts), "w")


@query(VIEWS.text("path", last="SELECT query, array_to_string(nodes, '/') AS path, round(score, 6) AS score FROM path"))
def semantic_paths(spark, d):
    return rounded(_paths(spark, d).select("query", _text().alias("path"), "score"), "score")


@query(VIEWS.text("path", last="SELECT query, array_to_string(nodes, '/') AS path, round(score, 6) AS score FROM path WHERE nodes[-1] NOT IN (SELECT parent FROM level)"))
def semantic_paths_to_leaves(spark, d):
    tree = base.level(spark, d)
    return rounded(mining.without_inner_leaves(_paths(spark, d), cg.child_counts(tree)).select("query", _text().alias("path"), "score"), "score")


@query(VIEWS.text("path", last="").rstrip() + _greedy() + "SELECT query, array_to_string(nodes, '/') AS path, round(score, 6) AS score, place FROM chosen")
def independent_paths(spark, d):
    return rounded(mining.independent(_paths(spark, d), TOP).select("query", _text().alias("path"), "score", "place"), "score")


@query(
    VIEWS.text("visited", "level", last="").rstrip() + ", ones AS (SELECT DISTINCT child AS node FROM level WHERE depth = 1), kids AS (SELECT parent AS node, count(*) AS c FROM level GROUP BY parent), "
    "x AS (SELECT q.query, ones.node, coalesce(w, 0) AS raw, coalesce(w, 0) / coalesce(c, 1) AS x FROM (SELECT DISTINCT query FROM visited) q CROSS JOIN ones LEFT JOIN visited v ON v.query = q.query AND v.node = ones.node LEFT JOIN kids ON kids.node = ones.node) "
    "SELECT query, node, round(raw, 6) AS raw, round(CASE WHEN sum(x) OVER (PARTITION BY query) > 0 THEN x / sum(x) OVER (PARTITION BY query) ELSE 0 END, 6) AS normalised FROM x"
)
def level_one_distribution(spark, d):
    tree = base.level(spark, d)
    return rounded(mining.level_one(tree, cg.settled(_visited(spark, d)), cg.child_counts(tree)), "raw", "normalised")


_PAIRS = "pairs AS (SELECT item_id AS a, item_id + 1 AS b FROM benchmark), first_ AS (SELECT query, nodes FROM chosen WHERE place = 1)"


@query(
    VIEWS.text("path", last="").rstrip() + _greedy() + f", {_PAIRS} SELECT a, b, round(CASE WHEN x.nodes IS NULL OR y.nodes IS NULL THEN 0 ELSE {_dependence('x.nodes', 'y.nodes', 1)} END, 6) AS relatedness "
    "FROM pairs LEFT JOIN first_ x ON x.query = a LEFT JOIN first_ y ON y.query = b"
)
def path_relatedness(spark, d):
    pairs = base.cg_read(spark, d, "benchmark").select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"))
    return rounded(mining.path_relatedness(pairs, mining.independent(_paths(spark, d), 1)), "relatedness")


_WALK = (
    ", m AS (SELECT a, i, j, (CASE WHEN x[i + 1] = y[j + 1] OR level.child IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) / (coalesce(c, 0) + 1) AS m "
    "FROM walks, (SELECT unnest(range(0, 30)) AS i), (SELECT unnest(range(0, 30)) AS j) LEFT JOIN level ON level.parent = x[i + 1] AND level.child = y[j + 1] LEFT JOIN kids ON kids.node = x[i + 1] WHERE i < len(x) AND i < len(y) AND j >= i AND j < len(y)), "
    "r AS (SELECT a, i, sum(m) AS any_, sum(CASE WHEN i = j THEN m ELSE 0 END) AS on_ FROM m GROUP BY ALL), "
    "w AS (SELECT a, 0 AS i, 1.0::DOUBLE AS p, 0.0::DOUBLE AS s FROM walks UNION ALL SELECT w.a, w.i + 1, p * 0.4 * on_, s + p * 0.6 * any_ FROM w JOIN r ON r.a = w.a AND r.i = w.i) "
)


@query(
    VIEWS.text("path", "level", last="").rstrip() + _greedy() + f", {_PAIRS}, kids AS (SELECT parent AS node, count(*) AS c FROM level GROUP BY parent), "
    "walks AS (SELECT a, x.nodes AS x, y.nodes AS y FROM pairs JOIN first_ x ON x.query = a JOIN first_ y ON y.query = b)" + _WALK + "SELECT a, round(max_by(s, i), 6) AS s FROM w GROUP BY a"
)
def path_walk_similarity(spark, d):
    best = mining.independent(_paths(spark, d), 1).select("query", "nodes")
    best = cg.settled(best)
    pairs = best.select(F.col("query").alias("id"), F.col("nodes").alias("x"), (F.col("query") + 1).alias("query")).join(best.withColumnRenamed("nodes", "y"), "query")
    return rounded(mining.walk_similarity(pairs.select("id", "x", "y"), base.level(spark, d)), "s").withColumnRenamed("id", "a")
