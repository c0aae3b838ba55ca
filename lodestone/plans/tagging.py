"""Queries of the sequence models, extraction and ranking measures and the experiments' operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import evaluate, index, lattices, learn, tagging
from lodestone.plans.base import Views, query, rounded
from lodestone.plans.mining import VIEWS as MINING
from lodestone.plans.relatedness import VIEWS as RELATED
from lodestone.sources.tables import read

#: Turns of a conversation are a sequence: the role is the state, two properties of the text the symbol.
VIEWS = Views(
    obs="SELECT conv_id AS seq, turn AS t, role AS state, concat(CAST(length(coalesce(text, '')) % 3 AS STRING), CASE WHEN turn % 2 = 0 THEN 'e' ELSE 'o' END) AS symbol FROM conversations",
    state_="SELECT DISTINCT state FROM obs",
    n_state="SELECT count(*) AS k FROM state_",
    n_symbol="SELECT count(DISTINCT symbol) AS k FROM obs",
    start_="SELECT s.state, ln((coalesce(n, 0) + 1) / (sum(coalesce(n, 0) + 1) OVER ())) AS p FROM state_ s LEFT JOIN (SELECT state, count(*) AS n FROM obs WHERE (seq, t) IN (SELECT (seq, min(t)) FROM obs GROUP BY seq) GROUP BY state) USING (state)",
    move_="SELECT a.state AS s, b.state AS s2, ln((coalesce(n, 0) + 1) / (sum(coalesce(n, 0) + 1) OVER (PARTITION BY a.state))) AS p FROM state_ a CROSS JOIN state_ b LEFT JOIN (SELECT x.state AS f, y.state AS g, count(*) AS n FROM obs x JOIN obs y ON x.seq = y.seq AND y.t = x.t + 1 GROUP BY ALL) ON f = a.state AND g = b.state",
    emit_="SELECT a.state AS s, b.symbol, ln((coalesce(n, 0) + 1) / (tot + n_symbol.k + 1)) AS p FROM state_ a CROSS JOIN (SELECT DISTINCT symbol FROM obs) b LEFT JOIN (SELECT state, symbol, count(*) AS n FROM obs GROUP BY ALL) c ON c.state = a.state AND c.symbol = b.symbol JOIN (SELECT state, count(*) AS tot FROM obs GROUP BY state) d ON d.state = a.state, n_symbol",
    place_="SELECT seq, t, symbol, row_number() OVER (PARTITION BY seq ORDER BY t) AS i, count(*) OVER (PARTITION BY seq) AS n FROM obs",
    fwd="SELECT seq, i, state AS s, start_.p + emit_.p AS v FROM place_ JOIN emit_ USING (symbol) JOIN start_ ON state = emit_.s WHERE i = 1 UNION ALL "
    "SELECT seq, i, s, v FROM (SELECT f.seq, f.i + 1 AS i, e.s, max(f.v + m.p) + any_value(e.p) AS v FROM fwd f JOIN place_ o ON o.seq = f.seq AND o.i = f.i + 1 JOIN move_ m ON m.s = f.s JOIN emit_ e ON e.s = m.s2 AND e.symbol = o.symbol GROUP BY f.seq, f.i, e.s)",
    trace_="SELECT seq, n AS i, arg_max(s, (round(v, 9), s)) AS s FROM fwd JOIN (SELECT DISTINCT seq, n FROM place_) USING (seq) WHERE i = n GROUP BY seq, n UNION ALL "
    "SELECT seq, i, s FROM (SELECT r.seq, r.i - 1 AS i, arg_max(f.s, (round(f.v + m.p, 9), f.s)) AS s FROM trace_ r JOIN fwd f ON f.seq = r.seq AND f.i = r.i - 1 JOIN move_ m ON m.s = f.s AND m.s2 = r.s GROUP BY r.seq, r.i)",
    alpha_="SELECT seq, i, state AS s, exp(start_.p + emit_.p) AS v FROM place_ JOIN emit_ USING (symbol) JOIN start_ ON state = emit_.s WHERE i = 1 UNION ALL "
    "SELECT seq, i, s, v FROM (SELECT f.seq, f.i + 1 AS i, e.s, sum(f.v * exp(m.p)) * exp(any_value(e.p)) AS v FROM alpha_ f JOIN place_ o ON o.seq = f.seq AND o.i = f.i + 1 JOIN move_ m ON m.s = f.s JOIN emit_ e ON e.s = m.s2 AND e.symbol = o.symbol GROUP BY f.seq, f.i, e.s)",
    path_="SELECT seq, i, s, [s] AS path, v FROM fwd WHERE i = 1 UNION ALL SELECT f.seq, f.i + 1, e.s, list_append(f.path, e.s), f.v + m.p + e.p FROM path_ f JOIN place_ o ON o.seq = f.seq AND o.i = f.i + 1 JOIN move_ m ON m.s = f.s JOIN emit_ e ON e.s = m.s2 AND e.symbol = o.symbol",
    whole_="SELECT seq, path, v, row_number() OVER (PARTITION BY seq ORDER BY round(v, 9) DESC, path) AS rank FROM path_ JOIN (SELECT DISTINCT seq, n FROM place_) USING (seq) WHERE i = n",
    beta_="SELECT seq, n AS i, state AS s, 1.0::DOUBLE AS v FROM (SELECT DISTINCT seq, n FROM place_), state_ UNION ALL "
    "SELECT seq, i, s, v FROM (SELECT f.seq, f.i - 1 AS i, m.s, sum(f.v * exp(m.p) * exp(e.p)) AS v FROM beta_ f JOIN place_ o ON o.seq = f.seq AND o.i = f.i JOIN emit_ e ON e.s = f.s AND e.symbol = o.symbol JOIN move_ m ON m.s2 = f.s WHERE f.i > 1 GROUP BY f.seq, f.i, m.s)",
)


def _rows(spark, d):
    return VIEWS.frame(spark, d, "obs")


@query(VIEWS.text("emit_", last="SELECT s AS state, symbol, round(p, 6) AS p FROM emit_"))
def emission_probabilities(spark, d):
    m = tagging.fit_markov(_rows(spark, d))
    return spark.createDataFrame([(s, x, round(float(m.emit[i, j]), 6)) for i, s in enumerate(m.states) for x, j in m.place.items()], "state string, symbol string, p double")


@query(VIEWS.text("trace_", "place_", last="SELECT seq, p.t, s AS state FROM trace_ JOIN place_ p USING (seq, i)"))
def viterbi_path(spark, d):
    rows = _rows(spark, d)
    return tagging.best_paths(rows.select("seq", "t", "symbol"), tagging.fit_markov(rows)).select("seq", "t", "state")


@query(VIEWS.text("alpha_", "beta_", "place_", last="SELECT a.seq, p.t, a.s AS state, round(a.v * b.v / sum(a.v * b.v) OVER (PARTITION BY a.seq, a.i), 6) AS p FROM alpha_ a JOIN beta_ b ON a.seq = b.seq AND a.i = b.i AND a.s = b.s JOIN place_ p ON p.seq = a.seq AND p.i = a.i"))
def state_posteriors(spark, d):
    rows = _rows(spark, d)
    return rounded(tagging.state_posteriors(rows.select("seq", "t", "symbol"), tagging.fit_markov(rows)), "p")


@query(VIEWS.text("whole_", last="SELECT seq, rank, array_to_string(path, ' ') AS path, round(v, 6) AS score FROM whole_ WHERE rank <= 3"))
def three_best_paths(spark, d):
    """The three likeliest rows of roles of each conversation; the SQL lists all paths."""
    rows = _rows(spark, d)
    found = lattices.best_markov_paths(rows.select("seq", "t", "symbol"), tagging.fit_markov(rows), 3)
    paths = found.groupBy("seq", F.col("rank").cast("long").alias("rank")).agg(F.array_sort(F.collect_list(F.struct("t", "state"))).alias("path"), F.first("score").alias("score"))
    return rounded(paths.select("seq", "rank", F.concat_ws(" ", F.transform("path", lambda r: r.state)).alias("path"), "score"), "score")


@query(
    VIEWS.text(
        "whole_", "place_",
        last=""", best AS (SELECT p.seq, p.i, p.t, p.n, path[p.i] AS s FROM whole_ w JOIN place_ p USING (seq) WHERE rank = 1),
cut AS (SELECT *, sum(CASE WHEN s IS DISTINCT FROM b THEN 1 ELSE 0 END) OVER (PARTITION BY seq ORDER BY i) AS g FROM (SELECT *, lag(s) OVER (PARTITION BY seq ORDER BY i) AS b FROM best)),
span AS (SELECT seq, g, any_value(s) AS s, min(i) AS a, max(i) AS z, min(t) AS ta, max(t) AS tz, any_value(n) AS n FROM cut GROUP BY seq, g),
total AS (SELECT seq, sum(exp(v)) AS total FROM whole_ GROUP BY seq)
SELECT x.seq, ta AS begin, tz AS "end", x.s AS state, round(sum(exp(v)) / any_value(total), 6) AS p FROM span x JOIN whole_ w USING (seq) JOIN total USING (seq)
WHERE len(list_filter(path[a:z], lambda q: q <> x.s)) = 0 AND (a = 1 OR path[a - 1] <> x.s) AND (z = x.n OR path[z + 1] <> x.s) GROUP BY x.seq, g, ta, tz, x.s""",
    )
)
def span_confidences(spark, d):
    """How sure each run of equal roles of the best path is; the SQL sums over all paths."""
    rows = _rows(spark, d)
    return rounded(lattices.markov_confidences(rows.select("seq", "t", "symbol"), tagging.fit_markov(rows)), "p")


@query()
def entropy_markov_states(spark, d):
    """The roles by a maximum-entropy Markov model; its paths are tested against all paths."""
    rows = _rows(spark, d).withColumn("features", F.array("symbol", F.concat(F.lit("t"), F.col("t").cast("string"))))
    weights, states, _ = lattices.fit_entropy_markov(rows, rounds=15, tolerance=1e-5)
    return lattices.best_entropy_paths(rows.drop("state"), weights, states).select("seq", "t", "state")


@query()
def chain_field_states(spark, d):
    """A conditional random field trained on the roles: gradient and accuracy are tested."""
    rows = _rows(spark, d).withColumn("features", F.array("symbol", F.concat(F.lit("t"), F.col("t").cast("string"))))
    chain, w, _ = tagging.fit_chain(rows, rounds=15)
    return tagging.chain_paths(rows, chain, w)


# Fields: the local links of a page are the truth, what starts in the first half of the page is predicted.
_FIELDS = """truth AS (SELECT page_id AS doc, left(target, 1) AS field, target AS value FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS target FROM pages)),
pred AS (SELECT doc, CASE WHEN length(value) % 5 = 0 THEN 'x' ELSE field END AS field, value FROM truth WHERE length(value) % 3 > 0),
c AS (SELECT field, count(*) FILTER (t) AS n_correct, count(*) AS n_predicted FROM (SELECT field, (doc, field, value) IN (SELECT (doc, field, value) FROM truth) AS t FROM pred) GROUP BY field),
s AS (SELECT field, coalesce(n_correct, 0) AS n_correct, coalesce(n_predicted, 0) AS n_predicted, coalesce(n_true, 0) AS n_true FROM c FULL JOIN (SELECT field, count(*) AS n_true FROM truth GROUP BY field) USING (field)),
pr AS (SELECT *, CASE WHEN n_predicted = 0 THEN 0 ELSE n_correct / n_predicted END AS p, CASE WHEN n_true = 0 THEN 1 ELSE n_correct / n_true END AS r FROM s),
f AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1 FROM pr)"""


def _fields(spark, d):
    truth = read(spark, d, "pages").select(F.col("page_id").alias("doc"), F.explode(F.array_distinct(tx.hrefs(F.col("html")))).alias("value")).select("doc", F.substring("value", 1, 1).alias("field"), "value")
    predicted = truth.filter(F.length("value") % 3 > 0).withColumn("field", F.when(F.length("value") % 5 == 0, "x").otherwise(F.col("field")))
    return evaluate.field_scores(predicted, truth)


@query(f"WITH {_FIELDS} SELECT field, n_correct, n_predicted, n_true, round(p, 6) AS p, round(r, 6) AS r, round(f1, 6) AS f1 FROM f")
def field_scores(spark, d):
    return rounded(_fields(spark, d), "p", "r", "f1")


@query(f"WITH {_FIELDS}, o AS (SELECT sum(n_correct) / sum(n_predicted) AS p, sum(n_correct) / sum(n_true) AS r, avg(f1) AS m FROM f) SELECT round(p, 6) AS p, round(r, 6) AS r, round(2 * p * r / (p + r), 6) AS f1, round(m, 6) AS macro_f1 FROM o")
def overall_field_scores(spark, d):
    return rounded(evaluate.overall_fields(_fields(spark, d)), "p", "r", "f1", "macro_f1")


@query(VIEWS.text("trace_", "place_", "obs", last="SELECT count(*) AS n, count(*) FILTER (s = state) AS n_right, round(count(*) FILTER (s = state) / count(*), 6) AS accuracy FROM trace_ JOIN place_ p USING (seq, i) JOIN obs o ON o.seq = p.seq AND o.t = p.t"))
def token_accuracy(spark, d):
    rows = _rows(spark, d)
    found = tagging.best_paths(rows.select("seq", "t", "symbol"), tagging.fit_markov(rows)).select("seq", "t", F.col("state").alias("predicted"))
    return rounded(evaluate.token_accuracy(found.join(rows.withColumnRenamed("state", "label"), ["seq", "t"])), "accuracy")


@query(
    VIEWS.text(
        "trace_", "place_", "obs",
        last=""", pair AS (SELECT o.state AS label, s AS predicted FROM trace_ JOIN place_ p USING (seq, i) JOIN obs o ON o.seq = p.seq AND o.t = p.t),
each AS (SELECT label AS l FROM pair UNION SELECT predicted FROM pair),
m AS (SELECT l AS label, count(*) FILTER (pair.label = l AND predicted = l) AS tp, count(*) FILTER (pair.label <> l AND predicted = l) AS fp, count(*) FILTER (pair.label = l AND predicted <> l) AS fn FROM each, pair GROUP BY l),
pr AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END AS recall FROM m)
SELECT label, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1 FROM pr""",
    )
)
def token_class_scores(spark, d):
    """Precision, recall and F1 of every state over all places of the best paths."""
    rows = _rows(spark, d)
    found = tagging.best_paths(rows.select("seq", "t", "symbol"), tagging.fit_markov(rows)).select("seq", "t", F.col("state").alias("predicted"))
    pairs = found.join(rows.withColumnRenamed("state", "label"), ["seq", "t"]).select("label", "predicted")
    return rounded(learn.class_measures(pairs), "precision", "recall", "f1")


_LANG = "tl AS (SELECT lang, term, n FROM tf JOIN documents USING (doc_id)), d_ AS (SELECT lang, term, sum(n) / (SELECT sum(n) FROM tl y WHERE y.lang = x.lang) AS p FROM tl x GROUP BY lang, term)"


@query(RELATED.text("tf", last="").rstrip() + f", {_LANG} SELECT round(sum(e.p * log2(e.p / a.p)), 6) AS kl, round(-sum(e.p * ln(e.p)), 6) AS entropy FROM (SELECT * FROM d_ WHERE lang = 'en') e JOIN (SELECT term, sum(n) / (SELECT sum(n) FROM tl) AS p FROM tl GROUP BY term) a USING (term)")
def english_divergence(spark, d):
    counts = index.term_counts(read(spark, d, "documents")).join(read(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    total = lambda df: df.groupBy("term").agg(F.sum("n").alias("n")).crossJoin(df.agg(F.sum("n").alias("all"))).select("term", (F.col("n") / F.col("all")).alias("p"))  # noqa: E731  one row
    return rounded(evaluate.divergences(total(counts.filter("lang = 'en'")), total(counts.filter("lang is not null"))), "kl", "entropy")


_RUNS = "r AS (SELECT n_nationkey AS run, vec_id, label AS truth, (label * (n_nationkey + 1) + vec_id % (n_nationkey + 2)) % 9 AS cluster FROM embeddings, nation WHERE n_nationkey < 4)"


@query(
    f"WITH {_RUNS}, c AS (SELECT run, truth, cluster, count(*) AS n FROM r GROUP BY ALL), a AS (SELECT run, truth, sum(n) AS na, count(*) AS ka FROM c GROUP BY ALL), b AS (SELECT run, cluster, sum(n) AS nb, count(*) AS kb FROM c GROUP BY ALL), "
    "j AS (SELECT sum(n * (n - 1) / 2) AS both_, sum(n * n / nb) / sum(n) AS bp, sum(n * n / na) / sum(n) AS br FROM c JOIN a USING (run, truth) JOIN b USING (run, cluster)), "
    "m AS (SELECT both_ / (SELECT sum(nb * (nb - 1) / 2) FROM b) AS pp, both_ / (SELECT sum(na * (na - 1) / 2) FROM a) AS pr, bp, br, (SELECT sum(nb - kb) / sum(nb - 1) FROM b) AS mp, (SELECT sum(na - ka) / sum(na - 1) FROM a) AS mr FROM j) "
    "SELECT round(2 * pp * pr / (pp + pr), 6) AS pair_f1, round(2 * bp * br / (bp + br), 6) AS b3_f1, round(2 * mp * mr / (mp + mr), 6) AS muc_f1 FROM m"
)
def clustering_totals(spark, d):
    runs = read(spark, d, "nation").filter("n_nationkey < 4").select(F.col("n_nationkey").alias("run"))
    rows = read(spark, d, "embeddings").crossJoin(runs).selectExpr("run", "label AS truth", "(label * (run + 1) + vec_id % (run + 2)) % 9 AS cluster")  # four rows
    return rounded(evaluate.clustering_totals(rows), "pair_f1", "b3_f1", "muc_f1")


_NAMES = "SELECT p_partkey AS id, string_split(lower(p_brand || '/' || p_type || '/' || p_name), '/') AS ideal, string_split(lower(p_type || '/' || p_brand || ' x/' || p_type), '/') AS found FROM part"


def _names(spark, d):
    part = read(spark, d, "part")
    split = lambda *c: F.split(F.lower(F.concat_ws("/", *c)), "/")
    return part.select(F.col("p_partkey").alias("id"), split("p_brand", "p_type", "p_name").alias("ideal"), split("p_type", F.concat("p_brand", F.lit(" x")), "p_type").alias("found"))


@query(
    f"WITH n AS ({_NAMES}) SELECT id, round(list_sum(list_transform(range(len(found)), lambda i: CASE WHEN list_contains(ideal, found[i + 1]) THEN ln(2.0::DOUBLE) / ln(i + 2.0::DOUBLE) ELSE 0 END)) / list_sum(list_transform(range(len(ideal)), lambda i: ln(2.0::DOUBLE) / ln(i + 2.0::DOUBLE))), 6) AS ndcg, "
    "round(list_sum(list_transform(list_distinct(ideal), lambda a: list_max(list_transform(found, lambda b: CASE WHEN a = b THEN 1.0::DOUBLE WHEN list_has_any(string_split(a, ' '), string_split(b, ' ')) THEN 0.5 ELSE 0 END)))) / len(list_distinct(ideal)), 6) AS bag FROM n"
)
def path_similarities(spark, d):
    return rounded(_names(spark, d).select("id", evaluate.discounted_gain(F.col("ideal"), F.col("found")).alias("ndcg"), evaluate.bag_similarity(F.col("ideal"), F.col("found")).alias("bag")), "ndcg", "bag")


_RANKS = "k AS (SELECT query, concept % 5 AS g, row_number() OVER (PARTITION BY query ORDER BY concept) AS rank, v AS score FROM vector)"


def _ranks(spark, d):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("query").orderBy("concept"))
    return MINING.frame(spark, d, "vector").select("query", (F.col("concept") % 5).alias("g"), place.alias("rank"), F.col("v").alias("score"))


@query(MINING.text("vector", last="").rstrip() + f", {_RANKS} SELECT g, rank, round(avg(b), 6) AS score FROM (SELECT g, rank, max(score) OVER (PARTITION BY query ORDER BY rank) AS b FROM k) GROUP BY g, rank")
def best_prefix_scores(spark, d):
    return rounded(evaluate.best_so_far(_ranks(spark, d), "g"), "score")


@query(MINING.text("vector", last="").rstrip() + f", {_RANKS}, b AS (SELECT * FROM (VALUES (0.2::DOUBLE), (0.5), (2.0)) x(bar)), m AS (SELECT bar, query, min(rank) AS r FROM k, b WHERE score >= bar GROUP BY ALL) SELECT bar, round(100 * coalesce(sum(1 / r), 0) / (SELECT count(DISTINCT query) FROM k), 6) AS mrr FROM b LEFT JOIN m USING (bar) GROUP BY bar")
def reciprocal_ranks(spark, d):
    return rounded(evaluate.reciprocal_rank(_ranks(spark, d), [0.2, 0.5, 2.0]), "mrr")


@query("WITH f AS (SELECT quality, (row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) % 10 AS fold FROM labels WHERE quality IN (0, 1)) SELECT round(avg(m), 6) AS mean, count(*) AS n_folds FROM (SELECT fold, avg(quality) AS m FROM f GROUP BY fold)")
def mean_over_folds(spark, d):
    rows = read(spark, d, "labels").filter("quality in (0, 1)")
    return rounded(evaluate.mean_over_folds(learn.folds(rows, "doc_id", "quality", 10), "quality"), "mean")


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 5 AS fold FROM labels")
def split_in_turn(spark, d):
    """Every fifth row by id: numbered within range partitions, on which the partitions' counts before are added."""
    return learn.numbered(read(spark, d, "labels").select("doc_id"), "doc_id").select("doc_id", ((F.col("number") - 1) % 5).alias("fold"))


@query(RELATED.text("google", last="SELECT count(*) AS n, round(corr(CAST(a % 7 AS DOUBLE), similarity), 6) AS r FROM google WHERE similarity >= 0"))
def relatedness_correlation(spark, d):
    from lodestone.operators import concepts
    from lodestone.plans import relatedness as rel

    found = concepts.inlink_similarity(rel._pairs(spark, d), rel._links(spark, d), rel._n_pages(spark, d))
    return rounded(evaluate.correlation(found.select((F.col("a") % 7).cast("double").alias("human"), F.col("similarity").alias("score"))), "r")


@query(
    RELATED.text("tf", last="").rstrip() + ", k AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM documents)) - ln(count(*)) AS idf FROM tf GROUP BY term HAVING count(*) > 5 AND ln((SELECT count(*) FROM documents)) - ln(count(*)) > 3.0), "
    "x AS (SELECT a.term AS a, b.term AS b, ka.df, (kb.idf - 3.0) / (ka.idf - 3.0) * count(*) / ka.df AS weight FROM tf a JOIN tf b ON a.doc_id = b.doc_id AND a.term <> b.term JOIN k ka ON ka.term = a.term JOIN k kb ON kb.term = b.term GROUP BY a.term, b.term, ka.df, ka.idf, kb.idf) "
    "SELECT a, b, round(weight, 6) AS weight FROM x QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(weight, 9) DESC, b) <= 10 AND weight >= 0.05"
)
def cooccurrence_links(spark, d):
    docs = read(spark, d, "documents")
    return rounded(evaluate.cooccurrence_links(index.term_counts(docs), docs.agg(F.count("*").alias("n_docs"))), "weight")


_GAIN = (
    "l AS (SELECT doc_id, quality AS label FROM labels WHERE quality IN (0, 1)), w AS (SELECT count(*) AS n, sum(label) AS p FROM l), t AS (SELECT term, count(*) AS k, sum(label) AS kp FROM tf JOIN l USING (doc_id) GROUP BY term), "
    "h AS (SELECT term, {} AS gain FROM t, w)"
)


def _entropy(p: str, n: str) -> str:
    part = lambda x: f"CASE WHEN {x} > 0 THEN -(({x}) / ({n})::DOUBLE) * log2(({x}) / ({n})::DOUBLE) ELSE 0 END"
    return f"CASE WHEN {n} > 0 THEN {part(p)} + {part(f'{n} - ({p})')} ELSE 0 END"


@query(RELATED.text("tf", last="").rstrip() + ", " + _GAIN.format(f"({_entropy('p', 'n')}) - k / n * ({_entropy('kp', 'k')}) - (n - k) / n * ({_entropy('p - kp', '(n - k)')})") + " SELECT term, round(gain, 6) AS gain FROM h ORDER BY round(gain, 9) DESC, term LIMIT 50")
def top_gain_terms(spark, d):
    labels = read(spark, d, "labels").filter("quality in (0, 1)").select("doc_id", F.col("quality").alias("label"))
    return rounded(evaluate.top_gain(learn.information_gain(index.term_counts(read(spark, d, "documents")), labels), 50), "gain")


@query(MINING.text("vector", last="").rstrip() + ", x AS (SELECT item_id AS id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS f FROM benchmark UNION SELECT query, concat('ESA:', concept) FROM vector UNION SELECT item_id, concat('ESPM:0/', item_id % 7) FROM benchmark) SELECT id, array_to_string(list_sort(list(DISTINCT f)), ' ') AS features FROM x GROUP BY id")
def mixed_features(spark, d):
    b = read(spark, d, "benchmark")
    words = b.select(F.col("item_id").alias("id"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    paths = b.select(F.col("item_id").alias("id"), F.concat(F.lit("0/"), (F.col("item_id") % 7).cast("string")).alias("path"))
    found = evaluate.mixed_features(words, MINING.frame(spark, d, "vector").select(F.col("query").alias("id"), "concept"), paths)
    return found.select("id", F.concat_ws(" ", "features").alias("features"))


@query(MINING.text("vector", last="SELECT query AS id, string_agg(concat(concept, '|C', concept, '|', printf('%.4f', v)), chr(10) ORDER BY round(v, 9) DESC, concept) AS tags FROM vector GROUP BY query"))
def tag_lines(spark, d):
    rows = MINING.frame(spark, d, "vector").select(F.col("query").alias("id"), F.col("concept").alias("tag"), F.concat(F.lit("C"), F.col("concept").cast("string")).alias("name"), F.col("v").alias("score"))
    return evaluate.tag_lines(rows)
