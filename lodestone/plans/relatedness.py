"""Queries of concept vectors, link relatedness, search and key words."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import concepts, index, keywords, resolve
from lodestone.plans import joins
from lodestone.plans.base import Views, query, rounded
from lodestone.plans.mining import VIEWS as MINING
from lodestone.sources.tables import read, settled

_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


def _terms(column: str) -> str:
    return f"list_filter(regexp_extract_all(lower({column}), '\\p{{L}}+'), lambda w: length(w) BETWEEN 2 AND 50 AND w NOT IN ({_STOP}))"


VIEWS = Views(
    joins.VIEWS
    | {k: v for k, v in MINING.items() if k in ("n_docs", "vectors", "vector", "inlinks")}
    | {
        "tok": f"SELECT doc_id, unnest({_terms('text')}) AS term FROM documents",
        "tf": "SELECT doc_id, term, count(*) AS n FROM tok GROUP BY ALL",
        "title_term": f"SELECT DISTINCT doc_id, unnest({_terms('substr(text, 1, 40)')}) AS term FROM documents",
        "idf": "SELECT term, count(*) AS df, ln((SELECT count(*) FROM documents) / count(*)) AS idf FROM tf GROUP BY term",
        "raw": "SELECT doc_id, term, (1 + ln(n)) * idf AS x, t.term IS NOT NULL AS named FROM tf JOIN idf USING (term) LEFT JOIN title_term t USING (doc_id, term)",
        "boosted": "SELECT doc_id, term, CASE WHEN norm > 0 THEN x * CASE WHEN named THEN 1.5::DOUBLE ELSE 1 END / norm ELSE 0 END AS w FROM raw JOIN (SELECT doc_id, sqrt(sum(x * x + CASE WHEN named THEN x * 0.5::DOUBLE ELSE 0 END)) AS norm FROM raw GROUP BY doc_id) USING (doc_id)",
        "best": "SELECT query, concept, v FROM vector QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(v, 9) DESC, concept) <= 6",
        "best3": "SELECT query, concept, v FROM best QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(v, 9) DESC, concept) <= 3",
        # the same links with most of them into few concepts, so that some are more general than others
        "ins": "SELECT concept % 7 AS concept, source FROM inlinks UNION SELECT concept, source FROM inlinks",
        "n_ins": "SELECT concept, count(*) AS n FROM ins GROUP BY concept",
        "linked": "SELECT t.query, t.concept, sum(coalesce(g.v, 0)) AS v FROM best3 t JOIN ins i USING (concept) JOIN n_ins p ON p.concept = t.concept JOIN n_ins q ON q.concept = i.source LEFT JOIN best3 g ON g.query = t.query AND g.concept = i.source WHERE ln(q.n) - ln(p.n) > 1 GROUP BY ALL",
        "mixed": "SELECT query, concept, sum(v) AS v FROM (SELECT * FROM best UNION ALL SELECT * FROM linked) GROUP BY ALL HAVING sum(v) <> 0",
        "views": "SELECT user_id AS concept, count(*) AS views FROM events GROUP BY user_id",
        "into_": "SELECT DISTINCT dst AS page, src AS source FROM resolved",
        "n_into": "SELECT page, count(*) AS n FROM into_ GROUP BY page",
        "pair": "SELECT id AS a, id + 1 AS b FROM wiki WHERE ns = 0",
        "n_wiki": "SELECT count(*) AS n_docs FROM wiki",
        "out1": "SELECT src, dst, ln(n_docs / n) AS w FROM (SELECT DISTINCT src, dst FROM resolved) JOIN n_into ON page = dst, n_wiki",
        "google": "SELECT a, b, CASE WHEN both_ IS NULL THEN 0 WHEN ln(n_docs) - ln(least(x.n, y.n)) = 0 THEN 1 ELSE 1 - (ln(greatest(x.n, y.n)) - ln(both_)) / (ln(n_docs) - ln(least(x.n, y.n))) END AS similarity FROM pair "
        "LEFT JOIN (SELECT a, b, count(*) AS both_ FROM pair JOIN into_ i ON i.page = a JOIN into_ j ON j.page = b AND i.source = j.source GROUP BY ALL) USING (a, b) LEFT JOIN n_into x ON x.page = a LEFT JOIN n_into y ON y.page = b, n_wiki",
        "cosine": "SELECT a, b, CASE WHEN x.norm IS NULL OR y.norm IS NULL THEN -1 WHEN x.norm * y.norm = 0 THEN 0 ELSE coalesce(dot, 0) / (x.norm * y.norm) END AS cosine FROM pair LEFT JOIN (SELECT src AS a, sqrt(sum(w * w)) AS norm FROM out1 GROUP BY src) x USING (a) LEFT JOIN (SELECT src AS b, sqrt(sum(w * w)) AS norm FROM out1 GROUP BY src) y USING (b) "
        "LEFT JOIN (SELECT a, b, sum(i.w * j.w) AS dot FROM pair JOIN out1 i ON i.src = a JOIN out1 j ON j.src = b AND i.dst = j.dst GROUP BY ALL) USING (a, b)",
        "word": "SELECT id, 0 AS part_, generate_subscripts(w, 1) AS pos, unnest(w) AS word FROM (SELECT id, regexp_extract_all(lower(title), '[a-z]{2,}') AS w FROM wiki) UNION ALL SELECT id, 1, generate_subscripts(w, 1), unnest(w) FROM (SELECT id, regexp_extract_all(lower(text), '[a-z]{2,}') AS w FROM wiki)",
        "node_": "SELECT id, word, count(*) AS n, max(CASE WHEN part_ = 0 THEN 30.0::DOUBLE ELSE 1 END) AS importance FROM word GROUP BY ALL",
        "step_": "SELECT id, lag(word) OVER (PARTITION BY id, part_ ORDER BY pos) AS src, word AS dst FROM word",
        "edge_": "SELECT id, src, dst, count(*) AS n FROM (SELECT * FROM step_ WHERE src IS NOT NULL UNION ALL SELECT id, dst, src FROM step_ WHERE src IS NOT NULL) GROUP BY ALL",
        "move_": "SELECT e.id, src, dst, 0.1::DOUBLE / count(*) OVER w + 0.9::DOUBLE * importance / sum(importance) OVER w AS p FROM edge_ e JOIN node_ ON node_.id = e.id AND word = dst WINDOW w AS (PARTITION BY e.id, src)",
        "n_node": "SELECT id, count(*) AS n FROM node_ GROUP BY id",
        "walk_": "SELECT 0 AS k, id, word, 1.0::DOUBLE / n_node.n AS v FROM node_ JOIN n_node USING (id) UNION ALL SELECT k + 1, walk_.id, dst, 0.85::DOUBLE * sum(p * v) + 0.15::DOUBLE / any_value(n_node.n) FROM walk_ JOIN move_ ON move_.id = walk_.id AND src = word JOIN n_node ON n_node.id = walk_.id WHERE k < 20 GROUP BY k, walk_.id, dst",
    }
)


def _docs(spark, d):
    return read(spark, d, "documents")


def _titles(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(tx.terms(F.substring("text", 1, 40))).alias("term")).distinct()


def _boosted(spark, d):
    counts = settled(concepts.named_counts(index.term_rows(_docs(spark, d)), _titles(spark, d)))  # read by frequencies and weights
    idf = index.frequencies(counts, _docs(spark, d).agg(F.count("*").alias("n_docs")))
    return concepts.boosted(counts.join(idf, "term").withColumn("x", (1 + F.log("n")) * F.col("idf")))


def _vector(spark, d):
    return MINING.frame(spark, d, "vector")


def _ins(spark, d):
    found = MINING.frame(spark, d, "inlinks")
    return found.withColumn("concept", F.col("concept") % 7).unionByName(found).distinct()


def _links(spark, d):
    found = resolve.resolved_links(joins._links(spark, d), joins._names(spark, d))
    return found.select(F.col("src").alias("page_id"), F.col("dst").alias("target"), "freq")


def _n_pages(spark, d):
    return joins.WIKI.frame(spark, d, "wiki").agg(F.count("*").alias("n_docs"))


def _pairs(spark, d):
    return joins._names(spark, d).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))


@query(VIEWS.text("wiki", last=f"SELECT id, unnest({_terms('concat(title, chr(10), text)')}) AS term, 1 AS one FROM wiki").replace("SELECT id, unnest", "SELECT id, term, count(*) AS n FROM (SELECT id, unnest").replace(", 1 AS one FROM wiki", " FROM wiki) GROUP BY ALL"))
def indexed_documents(spark, d):
    pages = joins.WIKI.frame(spark, d, "wiki").select("id", F.concat_ws("\n", "title", "text").alias("text"))
    return index.term_counts(index.dealt_by_size(pages, "id"), "id")


@query(VIEWS.text("tf", "title_term", last="SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) > 5 OR term IN (SELECT term FROM title_term)"))
def filtered_vocabulary(spark, d):
    return concepts.vocabulary(index.term_counts(_docs(spark, d)), _titles(spark, d))


@query(VIEWS.text("boosted", last="SELECT doc_id, term, round(w, 6) AS w FROM boosted"))
def title_boosted_weights(spark, d):
    return rounded(_boosted(spark, d), "w")


@query(VIEWS.text("best", last="SELECT query, concept, round(v, 6) AS v FROM best"))
def trimmed_vectors(spark, d):
    return rounded(concepts.trimmed(_vector(spark, d), 6), "v")


@query(VIEWS.text("linked", last="SELECT query, concept, round(v, 6) AS v FROM linked"))
def link_vectors(spark, d):
    return rounded(concepts.link_vectors(concepts.trimmed(_vector(spark, d), 6), _ins(spark, d), 3), "v")


@query(VIEWS.text("vector", "views", last="SELECT query, concept, round(CASE WHEN sum(x) OVER (PARTITION BY query) > 0 THEN x / sum(x) OVER (PARTITION BY query) ELSE 0 END, 6) AS v FROM (SELECT query, concept, log2(1 + coalesce(views, 0)) AS x FROM vector LEFT JOIN views USING (concept))"))
def page_view_vectors(spark, d):
    views = read(spark, d, "events").groupBy(F.col("user_id").alias("concept")).agg(F.count("*").alias("views"))
    return rounded(concepts.page_view_vectors(_vector(spark, d), views), "v")


@query(VIEWS.text("mixed", last="SELECT query, concept, round(v, 6) AS v FROM mixed"))
def combined_vectors(spark, d):
    return rounded(concepts.combined(_vector(spark, d), _ins(spark, d), 3), "v")


@query(VIEWS.text("mixed", last="SELECT query, round(sum(v * 0.75::DOUBLE), 6) AS norm1, round(sqrt(sum(v * v * 0.5625::DOUBLE)), 6) AS norm2 FROM mixed GROUP BY query"))
def vector_norms(spark, d):
    v = concepts.combined(_vector(spark, d), _ins(spark, d), 3)
    return rounded(concepts.norms(concepts.merged(v, v.withColumn("v", F.lit(0.0)), 0.25)), "norm1", "norm2")


@query(VIEWS.text("google", "cosine", last="SELECT a, b, round(0.5 * cosine + 0.5 * similarity, 6) AS relatedness FROM google JOIN cosine USING (a, b)"))
def link_relatedness(spark, d):
    links, total, pairs = _links(spark, d), _n_pages(spark, d), _pairs(spark, d)
    n = links.groupBy("target").agg(F.countDistinct("page_id").alias("n"))
    vectors = links.join(n, "target").crossJoin(total).select("page_id", "target", F.log(F.col("n_docs") / F.col("n")).alias("w"))  # one row
    cosine = index.vector_cosine(pairs, vectors, "a", "b", "page_id", "target", "w")
    both = concepts.inlink_similarity(pairs, links, total).join(cosine, ["a", "b"])
    return rounded(both.select("a", "b", (0.5 * F.col("cosine") + 0.5 * F.col("similarity")).alias("relatedness")), "relatedness")


@query(VIEWS.text("out1", last="SELECT coalesce(o.src, t.src) AS page_id, coalesce(o.dst, t.dst) AS target, round(coalesce(w2, w), 6) AS w FROM out1 o FULL JOIN (SELECT x.src, y.dst, sum(y.w * x.w) AS w2 FROM out1 x JOIN out1 y ON y.src = x.dst GROUP BY ALL) t ON t.src = o.src AND t.dst = o.dst"))
def two_hop_vectors(spark, d):
    return rounded(concepts.two_hops(_links(spark, d), _n_pages(spark, d)), "w")


_PHRASES = [("the", "of"), ("and", "in"), ("zzzz", "the"), ("and the", "to"), ("tion", "der")]


@query(
    "WITH t AS (SELECT ' ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') || ' ' AS t FROM documents), p AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{a}', '{b}')" for a, b in _PHRASES)
    + ") x(a, b)), f AS (SELECT a, b, count(*) FILTER (contains(t, ' ' || a || ' ')) AS fa, count(*) FILTER (contains(t, ' ' || b || ' ')) AS fb, count(*) FILTER (contains(t, ' ' || a || ' ') AND contains(t, ' ' || b || ' ')) AS fc FROM p, t GROUP BY a, b) "
    "SELECT a, b, round(CASE WHEN fa = 0 OR fb = 0 THEN -1 WHEN fc = 0 THEN 10000 ELSE (ln(2.0::DOUBLE * greatest(fa, fb)) - ln(2.0::DOUBLE * fc)) / (ln((SELECT count(*) FROM documents)) - ln(2.0::DOUBLE * least(fa, fb))) END, 6) AS distance FROM f"
)
def web_distances(spark, d):
    return rounded(concepts.web_distances(_docs(spark, d), _PHRASES), "distance")


@query(
    VIEWS.text("boosted", "title_term", last="").rstrip() + f", q AS (SELECT DISTINCT item_id AS query, unnest({_terms('text')}) AS term FROM benchmark), "
    "h AS (SELECT query, doc_id, w FROM q JOIN boosted USING (term) UNION ALL SELECT query, doc_id, 1.0::DOUBLE FROM q JOIN title_term USING (term)), s AS (SELECT query, doc_id, sum(w) AS score FROM h GROUP BY ALL), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s QUALIFY rank <= 10) SELECT query, doc_id, rank, CASE WHEN length(text) > 250 THEN substr(text, 1, 200) ELSE text END AS snippet FROM r JOIN documents USING (doc_id)"
)
def index_search(spark, d):
    q = read(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.explode(tx.terms(F.col("text"))).alias("term")).distinct()
    return concepts.search(q, _boosted(spark, d), _titles(spark, d), _docs(spark, d).select("doc_id", "text"))


def _words(spark, d):
    pages = joins.WIKI.frame(spark, d, "wiki")
    part = lambda c, k: pages.select("id", F.lit(k).alias("part"), F.posexplode(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{2,}"), F.lit(0))).alias("pos", "word"))
    return part("title", 0).unionByName(part("text", 1))


@query(VIEWS.text("edge_", last="SELECT id, src, dst, n FROM edge_"))
def word_graph(spark, d):
    return keywords.word_graph(_words(spark, d))[1]


@query(VIEWS.text("move_", last="SELECT id, src, dst, round(p, 6) AS p FROM move_"))
def word_transitions(spark, d):
    return rounded(keywords.transitions(*keywords.word_graph(_words(spark, d))), "p")


@query(VIEWS.text("walk_", last="SELECT id, word, round(v, 6) AS rank, row_number() OVER (PARTITION BY id ORDER BY round(v, 9) DESC, word) AS place FROM walk_ WHERE k = 20 QUALIFY place <= 5"))
def key_words(spark, d):
    nodes, edges = keywords.word_graph(_words(spark, d))
    return rounded(keywords.top_words(keywords.ranked(nodes, keywords.transitions(nodes, edges)), 5), "rank")
