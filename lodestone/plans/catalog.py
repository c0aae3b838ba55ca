"""Every registered query with the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import evaluate, index, learn, links, models, sequences
from lodestone.operators import learners as learners_
from lodestone.plans.base import QUERIES, SQL, query  # noqa: F401
from lodestone.plans.base import rounded as _round
from lodestone.sources.tables import read, settled

FLAGSHIP = "esa_concept_vector"

_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


def _terms(column: str = "text") -> str:
    return f"list_filter(regexp_extract_all(lower({column}), '\\p{{L}}+'), lambda w: length(w) BETWEEN 2 AND 50 AND w NOT IN ({_STOP}))"


_INDEX = f"""
tok AS (SELECT doc_id, unnest({_terms()}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS n FROM tok GROUP BY ALL),
idf AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM documents) / count(*)) AS idf FROM tf GROUP BY term),
raw AS (SELECT doc_id, term, (1 + ln(n)) * idf AS x FROM tf JOIN idf USING (term)),
norm AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM raw GROUP BY doc_id),
tfidf AS (SELECT doc_id, term, CASE WHEN norm > 0 THEN x / norm ELSE 0 END AS w FROM raw JOIN norm USING (doc_id)),
ranked AS (SELECT *, row_number() OVER o - 1 AS rank, first(w) OVER o AS top, lag(w, 1) OVER o AS before, lag(w, 100) OVER o AS far FROM tfidf WINDOW o AS (PARTITION BY term ORDER BY round(w, 9) DESC, doc_id)),
kept AS (SELECT *, sum(CASE WHEN rank >= 100 AND NOT (top * 0.005 < far - before) THEN 1 ELSE 0 END) OVER (PARTITION BY term ORDER BY rank) AS failed FROM ranked),
postings AS (SELECT term, doc_id, w, rank FROM kept WHERE failed = 0)
"""
_ESA = (
    _INDEX
    + f""",
qtok AS (SELECT item_id, unnest({_terms()}) AS term FROM benchmark),
qtf AS (SELECT item_id, term, count(*) AS n FROM qtok GROUP BY ALL),
qsize AS (SELECT item_id, sum(n) AS n_terms FROM qtf GROUP BY item_id),
qraw AS (SELECT item_id, term, n, (1 + ln(n)) * idf AS x FROM qtf JOIN idf USING (term) WHERE idf > 0),
qnorm AS (SELECT item_id, sqrt(sum(x * x)) AS norm FROM qraw GROUP BY item_id),
q AS (SELECT item_id, term, n * x / norm / n_terms AS q FROM qraw JOIN qnorm USING (item_id) JOIN qsize USING (item_id)),
scored AS (SELECT item_id, doc_id, sum(q * w) AS score FROM q JOIN postings USING (term) GROUP BY ALL),
vectors AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored QUALIFY rank <= 50)
"""
)
_LABELS = "lab AS (SELECT doc_id, quality AS label FROM labels WHERE quality IN (0, 1))"
_LINKS = """
hrefs AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS target FROM pages),
links AS (SELECT page_id, target, count(*) AS freq FROM hrefs GROUP BY ALL),
ins AS (SELECT target, count(*) AS n_pages, CAST(sum(freq) AS BIGINT) AS n_links FROM links GROUP BY target)
"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents")


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return index.term_counts(_docs(spark, d))


def _total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_docs"))


def _weights(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    counts = settled(_counts(spark, d))  # read three times
    idf = index.frequencies(counts, _total(_docs(spark, d)))
    return index.tfidf(counts, idf.select("term", "idf")), idf.select("term", "idf")


def _concepts(spark: SparkSession, d: str) -> DataFrame:
    """Only the postings of terms that some item has are ranked."""
    weights, idf = _weights(spark, d)
    items = read(spark, d, "benchmark")
    asked = index.term_counts(items, "item_id").select("term").distinct()
    return index.concept_vectors(items, "item_id", index.pruned_postings(weights.join(asked, "term", "left_semi")), idf)


@query(f"WITH {_INDEX} SELECT doc_id, term, n FROM tf")
def term_counts(spark, d):
    return _counts(spark, d)


@query(f"WITH {_INDEX} SELECT term, df, round(idf, 6) AS idf FROM idf")
def inverse_document_frequency(spark, d):
    return _round(index.frequencies(_counts(spark, d), _total(_docs(spark, d))), "idf")


@query(f"WITH {_INDEX} SELECT doc_id, term, round(w, 6) AS w FROM tfidf")
def tfidf_weights(spark, d):
    return _round(_weights(spark, d)[0], "w")


@query(f"WITH {_INDEX} SELECT term, doc_id, round(w, 6) AS w, rank FROM postings")
def pruned_postings(spark, d):
    return _round(index.pruned_postings(_weights(spark, d)[0]), "w").withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_ESA} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM vectors")
def esa_concept_vector(spark, d):
    return _round(_concepts(spark, d), "score").withColumn("rank", F.col("rank").cast("long"))


@query(
    f"""WITH {_ESA},
pairs AS (SELECT item_id AS a, item_id + 1 AS b FROM benchmark),
size AS (SELECT item_id, sqrt(sum(score * score)) AS norm FROM vectors GROUP BY item_id),
dot AS (SELECT x.item_id AS a, y.item_id AS b, sum(x.score * y.score) AS dot FROM vectors x JOIN vectors y ON y.item_id = x.item_id + 1 AND x.doc_id = y.doc_id GROUP BY ALL)
SELECT a, b, round(CASE WHEN m.norm IS NULL OR n.norm IS NULL THEN -1 WHEN m.norm * n.norm = 0 THEN 0 ELSE coalesce(dot, 0) / (m.norm * n.norm) END, 6) AS cosine
FROM pairs LEFT JOIN size m ON m.item_id = a LEFT JOIN size n ON n.item_id = b LEFT JOIN dot USING (a, b)"""
)
def esa_relatedness(spark, d):
    pairs = read(spark, d, "benchmark").select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"))
    return _round(index.vector_cosine(pairs, _concepts(spark, d), "a", "b", "item_id", "doc_id", "score"), "cosine")


@query(f"WITH {_LINKS} SELECT * FROM links")
def page_links(spark, d):
    return links.page_links(read(spark, d, "pages"))


@query(f"WITH {_LINKS} SELECT * FROM ins")
def inlink_counts(spark, d):
    return links.inlinks(links.page_links(read(spark, d, "pages")))


@query(
    f"""WITH {_LINKS},
both_ AS (SELECT x.target AS a, y.target AS b, count(*) AS n_both FROM links x JOIN links y ON x.page_id = y.page_id AND x.target < y.target GROUP BY ALL)
SELECT a, b, n_both, round(CASE WHEN ln((SELECT count(*) FROM pages)) - ln(least(m.n_pages, n.n_pages)) = 0 THEN 1 ELSE 1 - (ln(greatest(m.n_pages, n.n_pages)) - ln(n_both)) / (ln((SELECT count(*) FROM pages)) - ln(least(m.n_pages, n.n_pages))) END, 6) AS similarity
FROM both_ JOIN ins m ON m.target = a JOIN ins n ON n.target = b"""
)
def shared_inlink_similarity(spark, d):
    pages = read(spark, d, "pages")
    return _round(links.shared_inlinks(links.page_links(pages), _total(pages)), "similarity")


@query(
    f"""WITH {_LINKS},
v AS (SELECT page_id, target, ln((SELECT count(*) FROM pages) / n_pages) AS w FROM links JOIN ins USING (target)),
size AS (SELECT page_id, sqrt(sum(w * w)) AS norm FROM v GROUP BY page_id),
dot AS (SELECT x.page_id AS a, y.page_id AS b, sum(x.w * y.w) AS dot FROM v x JOIN v y ON y.page_id = x.page_id + 1 AND x.target = y.target GROUP BY ALL),
pairs AS (SELECT page_id AS a, page_id + 1 AS b FROM pages)
SELECT a, b, round(CASE WHEN m.norm IS NULL OR n.norm IS NULL THEN -1 WHEN m.norm * n.norm = 0 THEN 0 ELSE coalesce(dot, 0) / (m.norm * n.norm) END, 6) AS cosine
FROM pairs LEFT JOIN size m ON m.page_id = a LEFT JOIN size n ON n.page_id = b LEFT JOIN dot USING (a, b)"""
)
def outlink_cosine(spark, d):
    pages = read(spark, d, "pages")
    vectors = links.outlink_vectors(links.page_links(pages), _total(pages))
    pairs = pages.select(F.col("page_id").alias("a"), (F.col("page_id") + 1).alias("b"))
    return _round(index.vector_cosine(pairs, vectors, "a", "b", "page_id", "target", "w"), "cosine")


def _tree(spark: SparkSession, d: str) -> DataFrame:
    r, n, c = (read(spark, d, t) for t in ("region", "nation", "customer"))
    edges = r.select(F.lit("root").alias("parent"), F.concat(F.lit("r"), "r_regionkey").alias("child"))
    edges = edges.unionByName(n.select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child")))
    return edges.unionByName(c.select(F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.concat(F.lit("c"), "c_custkey").alias("child")))


_TREE = """
edges AS (SELECT 'root' AS parent, 'r' || r_regionkey AS child FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
walk AS (SELECT 'root' AS node, 0 AS depth UNION SELECT child, depth + 1 FROM walk JOIN edges ON parent = node),
depths AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node)
"""


@query(f"WITH RECURSIVE {_TREE} SELECT node, depth FROM depths")
def category_depths(spark, d):
    return links.tree_depths(_tree(spark, d), "root")


@query(f"WITH RECURSIVE {_TREE} SELECT depth, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent FROM depths GROUP BY depth")
def category_depth_histogram(spark, d):
    found = links.tree_depths(_tree(spark, d), "root")
    whole = found.agg(F.count("*").alias("all"))
    return found.groupBy("depth").agg(F.count("*").alias("n")).crossJoin(F.broadcast(whole)).select("depth", "n", F.round(100.0 * F.col("n") / F.col("all"), 6).alias("percent"))


@query()
def part_pagerank(spark, d):
    """PageRank of suppliers over parts that one order line follows with another: iterative, checked by its sum in tests."""
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("src"))
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("src").alias("dst"))
    edges = lines.join(after, ["l_orderkey", "l_linenumber"]).groupBy("src", "dst").agg(F.count("*").alias("freq"))
    return links.pagerank(edges)


_NB = (
    _INDEX
    + """,
lab AS (SELECT doc_id, lang AS label FROM documents),
pair AS (SELECT label, term, sum(n) AS n FROM tf JOIN lab USING (doc_id) GROUP BY ALL),
prior AS (SELECT label, ln((count(*) + 1) / ((SELECT count(*) FROM lab) + (SELECT count(DISTINCT label) FROM lab))) AS prior,
  coalesce((SELECT sum(n) FROM pair p WHERE p.label = l.label), 0) + (SELECT count(DISTINCT term) FROM tf) AS room FROM lab l GROUP BY label),
model AS (SELECT label, term, ln((n + 1) / room) AS logp FROM pair JOIN prior USING (label)),
size AS (SELECT doc_id, sum(n) AS size FROM tf GROUP BY doc_id),
gain AS (SELECT doc_id, label, sum(n * (logp - ln(1 / room))) AS gain FROM tf JOIN model USING (term) JOIN prior USING (label) GROUP BY ALL),
score AS (SELECT s.doc_id, p.label, prior + size * ln(1 / room) + coalesce(gain, 0) AS score FROM size s CROSS JOIN prior p LEFT JOIN gain g ON g.doc_id = s.doc_id AND g.label = p.label),
best AS (SELECT doc_id, label AS predicted FROM score QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, label) = 1),
judged AS (SELECT label, predicted FROM best JOIN lab USING (doc_id))
"""
)


def _bayes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    counts, labels = settled(_counts(spark, d)), _docs(spark, d).select("doc_id", F.col("lang").alias("label"))
    model, priors = learn.naive_bayes(counts, labels)
    return counts, labels, model, priors


@query(f"WITH {_NB} SELECT label, term, round(logp, 6) AS logp FROM model")
def naive_bayes_model(spark, d):
    return _round(_bayes(spark, d)[2], "logp")


@query(f"WITH {_NB} SELECT doc_id, predicted FROM best")
def naive_bayes_labels(spark, d):
    counts, _, model, priors = _bayes(spark, d)
    return learn.best_label(learn.naive_bayes_predict(counts, model, priors))


@query(
    f"""WITH {_NB},
m AS (SELECT l.label, count(*) FILTER (j.label = l.label AND j.predicted = l.label) AS tp, count(*) FILTER (j.label <> l.label AND j.predicted = l.label) AS fp,
  count(*) FILTER (j.label = l.label AND j.predicted <> l.label) AS fn FROM (SELECT DISTINCT label FROM lab) l, judged j GROUP BY l.label),
pr AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END AS recall FROM m)
SELECT label, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1 FROM pr"""
)
def classifier_measures(spark, d):
    counts, labels, model, priors = _bayes(spark, d)
    found = learn.best_label(learn.naive_bayes_predict(counts, model, priors))
    return _round(learn.class_measures(found.join(labels, "doc_id").select("label", "predicted")), "precision", "recall", "f1")


@query(f"WITH {_NB}, c AS (SELECT label, predicted, count(*) AS n FROM judged GROUP BY ALL) SELECT label, predicted, n, round(n / sum(n) OVER (PARTITION BY label), 6) AS share FROM c")
def confusion_cells(spark, d):
    counts, labels, model, priors = _bayes(spark, d)
    found = learn.best_label(learn.naive_bayes_predict(counts, model, priors))
    return _round(evaluate.confusion(found.join(labels, "doc_id").select("label", "predicted")), "share")



@query(
    f"""WITH {_INDEX}, {_LABELS},
w AS (SELECT count(*)::DOUBLE AS n, sum(label)::DOUBLE AS pos FROM lab),
t AS (SELECT term, count(*)::DOUBLE AS k, sum(label)::DOUBLE AS kp FROM tf JOIN lab USING (doc_id) GROUP BY term),
c AS (SELECT *, n - k AS r, pos - kp AS rp FROM t, w)
SELECT term, round((CASE WHEN pos > 0 THEN -pos / n * log2(pos / n) ELSE 0 END + CASE WHEN n - pos > 0 THEN -(n - pos) / n * log2((n - pos) / n) ELSE 0 END)
 - k / n * (CASE WHEN kp > 0 THEN -kp / k * log2(kp / k) ELSE 0 END + CASE WHEN k - kp > 0 THEN -(k - kp) / k * log2((k - kp) / k) ELSE 0 END)
 - r / n * (CASE WHEN rp > 0 THEN -rp / r * log2(rp / r) ELSE 0 END + CASE WHEN r - rp > 0 THEN -(r - rp) / r * log2((r - rp) / r) ELSE 0 END), 6) + 0.0 AS gain FROM c"""
)
def information_gain(spark, d):
    labels = read(spark, d, "labels").filter(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").alias("label"))
    return learn.information_gain(_counts(spark, d), labels).withColumn("gain", F.round("gain", 6) + 0.0)


@query("SELECT doc_id, quality, (row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) % 10 AS fold FROM labels")
def stratified_folds(spark, d):
    return learn.folds(read(spark, d, "labels"), "doc_id", "quality", 10).withColumn("fold", F.col("fold").cast("long"))


@query(
    """WITH e AS (SELECT n_chars AS score, sum(quality) AS p, sum(1 - quality) AS q FROM labels JOIN documents USING (doc_id) GROUP BY n_chars)
SELECT score, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(q) OVER w AS BIGINT) AS fp FROM e WINDOW w AS (ORDER BY score DESC)"""
)
def roc_counts(spark, d):
    rows = read(spark, d, "labels").join(_docs(spark, d), "doc_id").select(F.col("n_chars").alias("score"), F.col("quality").alias("label"))
    return learn.roc_counts(rows)


@query(
    """WITH cell AS (SELECT lang AS truth, source AS cluster, count(*)::DOUBLE AS n FROM documents GROUP BY ALL),
a AS (SELECT truth, sum(n) AS na FROM cell GROUP BY truth), b AS (SELECT cluster, sum(n) AS nb FROM cell GROUP BY cluster),
w AS (SELECT sum(n * (n - 1) / 2) AS n_both, sum(n * n / nb) / sum(n) AS bp, sum(n * n / na) / sum(n) AS br FROM cell JOIN a USING (truth) JOIN b USING (cluster)),
s AS (SELECT bp, br, n_both / (SELECT sum(nb * (nb - 1) / 2) FROM b) AS p, n_both / (SELECT sum(na * (na - 1) / 2) FROM a) AS r FROM w)
SELECT round(p, 6) AS pair_precision, round(r, 6) AS pair_recall, round(2 * p * r / (p + r), 6) AS pair_f1, round(bp, 6) AS b3_precision, round(br, 6) AS b3_recall, round(2 * bp * br / (bp + br), 6) AS b3_f1 FROM s"""
)
def clustering_measures(spark, d):
    found = learn.clustering_measures(_docs(spark, d).select(F.col("lang").alias("truth"), F.col("source").alias("cluster")))
    return _round(found, *found.columns)


_WINDOWS = ", ".join(
    f"coalesce(CASE WHEN p + {k} < 1 THEN '<START' || (1 - (p + {k})) || '>' WHEN p + {k} > n THEN '<END' || (p + {k} - n) || '>' END, "
    + (f"lag(role, {-k}) OVER o" if k < 0 else f"lead(role, {k}) OVER o") + f") AS at_{str(k).replace('-', 'm')}"
    for k in (-2, -1, 1, 2)
)


@query(f"WITH x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, turn, role, {_WINDOWS} FROM x WINDOW o AS (PARTITION BY conv_id ORDER BY turn)")
def window_features(spark, d):
    return sequences.window_features(read(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role")


_BIO = "tagged AS (SELECT conv_id, turn, role, CASE WHEN lag(role) OVER o = role THEN 'I-' ELSE 'B-' END || role AS tag FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn))"


@query(f"WITH {_BIO} SELECT * FROM tagged")
def bio_tags(spark, d):
    return sequences.bio(read(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role")


@query(
    f"""WITH {_BIO}, r AS (SELECT *, sum(CASE WHEN tag LIKE 'B-%' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM tagged)
SELECT conv_id, min(substr(tag, 3)) AS type, min(turn) AS first, max(turn) AS last FROM r GROUP BY conv_id, run"""
)
def bio_spans(spark, d):
    return sequences.spans(sequences.bio(read(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role"), "conv_id", "turn")


_BIGRAMS = f"""
t AS (SELECT {_terms()} AS t FROM documents),
pairs AS (SELECT unnest(list_zip(t[:len(t) - 1], t[2:])) AS p FROM t WHERE len(t) > 1),
big AS (SELECT p[1] AS a, p[2] AS b, count(*) AS n FROM pairs GROUP BY ALL)
"""


@query(f"WITH {_BIGRAMS} SELECT a, b, n FROM big")
def bigram_counts(spark, d):
    return sequences.bigram_counts(_docs(spark, d))


@query(
    f"""WITH {_BIGRAMS}, l AS (SELECT a, sum(n) AS na FROM big GROUP BY a), r AS (SELECT b, sum(n) AS nb FROM big GROUP BY b),
k AS (SELECT a, b, n, n + 0.01::DOUBLE AS k0, na - n + 0.01::DOUBLE AS k1, nb - n + 0.01::DOUBLE AS k2, (SELECT sum(n) FROM big) - na - nb + n + 0.01::DOUBLE AS k3 FROM big JOIN l USING (a) JOIN r USING (b)),
g AS (SELECT *, k0 + k1 + k2 + k3 AS t FROM k)
SELECT a, b, n, round(2 * (k0 * ln(k0 * t / ((k0 + k1) * (k0 + k2))) + k1 * ln(k1 * t / ((k0 + k1) * (k1 + k3))) + k2 * ln(k2 * t / ((k2 + k3) * (k0 + k2))) + k3 * ln(k3 * t / ((k2 + k3) * (k1 + k3)))), 3) AS g2 FROM g"""
)
def bigram_association(spark, d):
    return _round(sequences.association(sequences.bigram_counts(_docs(spark, d))), "g2", digits=3)


_PHRASES = f"""
flat AS (SELECT item_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z ]+', ' | ', 'g'), ' +'), lambda w: length(w) > 0) AS words FROM benchmark),
marked AS (SELECT item_id, list_transform(words, lambda w: CASE WHEN w IN ({_STOP}) THEN '|' ELSE w END) AS words FROM flat),
pieces AS (SELECT item_id, trim(unnest(string_split_regex(array_to_string(words, ' '), '[ ]*\\|[ |]*'))) AS phrase FROM marked),
ph AS (SELECT * FROM pieces WHERE phrase <> '')
"""


@query(
    f"""WITH {_PHRASES},
words AS (SELECT item_id, unnest(string_split(phrase, ' ')) AS word, len(string_split(phrase, ' ')) - 1 AS deg FROM ph),
s AS (SELECT item_id, word, (sum(deg) + count(*)) / count(*) AS s FROM words GROUP BY ALL),
u AS (SELECT item_id, phrase, unnest(string_split(phrase, ' ')) AS word FROM (SELECT DISTINCT item_id, phrase FROM ph))
SELECT item_id, phrase, round(sum(s), 6) AS score FROM u JOIN s USING (item_id, word) GROUP BY ALL"""
)
def rake_phrases(spark, d):
    return _round(sequences.rake(read(spark, d, "benchmark"), "item_id"), "score")


@query(f"WITH {_INDEX}, s AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_terms FROM tf GROUP BY doc_id) SELECT doc_id, n_terms, round(sum(-(n / n_terms) * ln(n / n_terms)), 6) + 0.0 AS entropy FROM tf JOIN s USING (doc_id) GROUP BY ALL")
def term_entropy(spark, d):
    return sequences.entropy(_counts(spark, d)).withColumn("entropy", F.round("entropy", 6) + 0.0)


@query(
    f"""WITH {_INDEX}, g AS (SELECT lang, term, sum(n) AS n FROM tf JOIN documents USING (doc_id) GROUP BY ALL),
p AS (SELECT lang, term, n / sum(n) OVER (PARTITION BY lang) AS p FROM g), k AS (SELECT DISTINCT lang FROM p),
prs AS (SELECT x.lang AS a, y.lang AS b FROM k x JOIN k y ON x.lang < y.lang),
sides AS (SELECT a, b, term, p, 0.0::DOUBLE AS q FROM prs JOIN p ON lang = a UNION ALL SELECT a, b, term, 0.0, p FROM prs JOIN p ON lang = b),
m AS (SELECT a, b, term, sum(p) AS p, sum(q) AS q FROM sides GROUP BY ALL)
SELECT a, b, round(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 6) AS js FROM m GROUP BY ALL"""
)
def language_divergence(spark, d):
    rows = _counts(spark, d).join(_docs(spark, d).select("doc_id", "lang"), "doc_id").groupBy("lang", "term").agg(F.sum("n").alias("n"))
    return _round(sequences.divergence(rows, "lang"), "js")


@query(
    f"""WITH {_INDEX} SELECT term, CASE WHEN length(term) <= 3 THEN term WHEN term LIKE '%sses' THEN regexp_replace(term, 'sses$', 'ss') WHEN term LIKE '%ies' THEN regexp_replace(term, 'ies$', 'y')
 WHEN term LIKE '%ss' THEN term ELSE regexp_replace(term, 's$', '') END AS singular FROM idf"""
)
def singular_terms(spark, d):
    return _counts(spark, d).select("term").distinct().select("term", tx.singular(F.col("term")).alias("singular"))


@query(
    """SELECT a.p_partkey AS a, b.p_partkey AS b, CASE WHEN length(a.p_name) = 0 OR length(b.p_name) = 0 THEN 1.0 ELSE round(levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name))::DOUBLE, 6) END AS ratio
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"""
)
def levenshtein_ratio(spark, d):
    p = read(spark, d, "part").select("p_partkey", "p_name")
    after = p.select(F.col("p_partkey").alias("b"), (F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    long = F.greatest(F.length("p_name"), F.length("other"))
    ratio = F.when((F.length("p_name") == 0) | (F.length("other") == 0), 1.0).otherwise(F.round(F.levenshtein("p_name", "other") / long, 6))
    return p.join(after, "p_partkey").select(F.col("p_partkey").alias("a"), "b", ratio.alias("ratio"))


@query("SELECT min(doc_id) AS doc_id, lower(trim(split_part(text, '.', 1))) AS title, count(*) AS n FROM documents GROUP BY lower(trim(split_part(text, '.', 1)))")
def first_writer_names(spark, d):
    """Name to id: the first writer of a title keeps it."""
    title = F.lower(F.trim(F.split_part("text", F.lit("."), F.lit(1))))
    return _docs(spark, d).groupBy(title.alias("title")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query(
    """WITH v AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
c AS (SELECT label, i, avg(x) AS m FROM v GROUP BY ALL),
s AS (SELECT vec_id, v.label, c.label AS near, sum((x - m) * (x - m)) AS dist FROM v JOIN c USING (i) GROUP BY ALL)
SELECT vec_id, label, near FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(dist, 6), near) = 1"""
)
def nearest_centroid(spark, d):
    e = read(spark, d, "embeddings")
    v = e.select("vec_id", "label", F.posexplode(F.transform("embedding", lambda x: x.cast("double"))).alias("i", "x"))
    c = v.groupBy("label", "i").agg(F.avg("x").alias("m")).groupBy(F.col("label").alias("near")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))
    spread = F.aggregate(F.zip_with("embedding", "centre", lambda x, m: (x.cast("double") - m) * (x.cast("double") - m)), F.lit(0.0), lambda a, x: a + x)
    best = F.min(F.struct(F.round(spread, 6).alias("dist"), "near")).alias("b")
    return e.crossJoin(c).groupBy("vec_id", "label").agg(best).select("vec_id", "label", F.col("b.near").alias("near"))  # a row per class


@query(
    f"""WITH {_NB}, e AS (SELECT doc_id, label, exp(score - max(score) OVER (PARTITION BY doc_id)) AS e FROM score)
SELECT doc_id, label, round(e / sum(e) OVER (PARTITION BY doc_id), 5) + 0.0 AS p FROM e"""
)
def naive_bayes_posteriors(spark, d):
    counts, _, model, priors = _bayes(spark, d)
    found = learn.posteriors(learn.naive_bayes_predict(counts, model, priors))
    return found.withColumn("p", F.round("p", 5) + 0.0)


@query(
    """WITH e AS (SELECT n_chars AS score, count(*) AS n, sum(quality) AS k FROM labels JOIN documents USING (doc_id) GROUP BY n_chars),
r AS (SELECT score, sum(n) OVER w AS n, sum(k) OVER w AS k FROM e WINDOW w AS (ORDER BY score DESC))
SELECT score, round(n::DOUBLE / (SELECT sum(n) FROM e), 6) AS coverage, round(k::DOUBLE / n, 6) AS accuracy FROM r"""
)
def accuracy_at_coverage(spark, d):
    rows = read(spark, d, "labels").join(_docs(spark, d), "doc_id").select(F.col("n_chars").alias("score"), F.col("quality").alias("correct"))
    return _round(learn.accuracy_at_coverage(rows), "coverage", "accuracy")


@query(
    """WITH s AS (SELECT role AS a, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
p AS (SELECT a, b, count(*) AS n FROM s WHERE b IS NOT NULL GROUP BY ALL)
SELECT a, b, n, round(ln((n + 1)::DOUBLE / (sum(n) OVER (PARTITION BY a) + (SELECT count(DISTINCT role) FROM conversations))), 6) AS logp FROM p"""
)
def state_transitions(spark, d):
    return _round(models.transitions(read(spark, d, "conversations"), "conv_id", "turn", "role"), "logp")


@query(
    """SELECT * FROM (SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) || '@-1_&_' || role AS feature FROM conversations) WHERE feature IS NOT NULL"""
)
def feature_conjunctions(spark, d):
    return models.conjunctions(read(spark, d, "conversations"), "conv_id", "turn", "role")


@query(
    """WITH f AS (SELECT lang, source, count(*)::DOUBLE AS v FROM documents GROUP BY ALL),
g AS (SELECT source, quality, count(*)::DOUBLE AS v FROM documents JOIN labels USING (doc_id) GROUP BY ALL),
m AS (SELECT lang, quality, sum(f.v * g.v) AS v FROM f JOIN g USING (source) GROUP BY ALL)
SELECT lang, quality, round(v / (SELECT sum(v) FROM m), 6) AS value FROM m"""
)
def variable_elimination(spark, d):
    docs = _docs(spark, d)
    f = docs.groupBy("lang", "source").agg(F.count("*").cast("double").alias("value"))
    g = docs.join(read(spark, d, "labels"), "doc_id").groupBy("source", "quality").agg(F.count("*").cast("double").alias("value"))
    return _round(models.eliminate([f, g], "lang", "quality"), "value")


def _by_language(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, lang, term, n): occurrences as they stand in the texts, n being 1; only ids that repeat are counted and joined."""
    docs = _docs(spark, d).filter("doc_id is not null")
    words = docs.select("doc_id", "lang", F.explode(tx.words(F.col("text"))).alias("term")).filter(tx.is_term(F.col("term"))).withColumn("n", F.lit(1).cast("long"))
    twice = settled(docs.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").select("doc_id"))
    if twice.isEmpty():
        return words
    shared = docs.join(twice, "doc_id", "left_semi")
    return words.join(twice, "doc_id", "left_anti").unionByName(index.term_counts(shared).join(shared.select("doc_id", "lang"), "doc_id"))


_TOPIC = f"{_INDEX}, o AS (SELECT doc_id, lang, term, n FROM tf JOIN documents USING (doc_id)), c AS (SELECT lang, term, sum(n) AS n FROM o GROUP BY ALL)"


@query(
    f"""WITH {_TOPIC}, room AS (SELECT lang, sum(n) + 0.01::DOUBLE * (SELECT count(DISTINCT term) FROM c) AS room FROM c GROUP BY lang),
seen AS (SELECT term, sum(n / room) AS seen FROM c JOIN room USING (lang) GROUP BY term),
t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) <= 20)
SELECT lang, round(avg((n + 0.01::DOUBLE) / room / (seen + (SELECT sum(0.01::DOUBLE / room) FROM room))), 6) AS exclusivity FROM t JOIN room USING (lang) JOIN seen USING (term) GROUP BY lang"""
)
def topic_exclusivity(spark, d):
    counts = _by_language(spark, d).groupBy("lang", "term").agg(F.sum("n").alias("n"))
    return _round(models.exclusivity(counts, "lang"), "exclusivity")


@query(
    f"""WITH {_TOPIC}, t AS (SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS r FROM c QUALIFY r <= 10),
h AS (SELECT doc_id, lang, r FROM o JOIN t USING (lang, term)), s AS (SELECT lang, r AS j, count(*) AS dj FROM h GROUP BY ALL),
b AS (SELECT x.lang, x.r AS i, y.r AS j, count(*) AS dij FROM h x JOIN h y ON x.doc_id = y.doc_id AND x.lang = y.lang AND x.r > y.r GROUP BY ALL)
SELECT t.lang, round(sum(ln((coalesce(dij, 0) + 0.01::DOUBLE) / (dj + 0.01::DOUBLE))), 6) AS coherence
FROM t JOIN s ON s.lang = t.lang AND t.r > s.j LEFT JOIN b ON b.lang = t.lang AND b.i = t.r AND b.j = s.j GROUP BY t.lang"""
)
def topic_coherence(spark, d):
    return _round(models.coherence(_by_language(spark, d), "lang"), "coherence")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    labels = read(spark, d, "labels").filter(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("double").alias("label"))
    return _docs(spark, d).select("doc_id", "text").join(labels, "doc_id", "left")


@query()
def maximum_entropy_labels(spark, d):
    """Trained on every labelled row, predicts every document: accuracy is tested."""
    return models.maximum_entropy(_labelled(spark, d))


@query()
def decision_tree_labels(spark, d):
    """A tree of presence splits over all terms, grown a level a pass."""
    rows = _labelled(spark, d)
    tree = learners_.presence_tree(_counts(spark, d).select("doc_id", "term"), rows.filter("label is not null").select("doc_id", F.col("label").cast("int").alias("label")))
    terms = _docs(spark, d).select("doc_id", tx.terms(F.col("text")).alias("terms"))
    return terms.select("doc_id", learners_.presence_label(tree).cast("double").alias("predicted"))


@query()
def support_vector_labels(spark, d):
    return models.support_vectors(_labelled(spark, d))


@query()
def latent_topics(spark, d):
    return models.topics(_docs(spark, d))


@query()
def k_means_clusters(spark, d):
    return models.k_means(read(spark, d, "embeddings"), "vec_id", "embedding")


from lodestone.plans import categories, embeddings, features, graphical, joins, learners, loglinear, mining, relatedness, tagging, wikitext  # noqa: E402,F401
