"""Queries of token features, dictionaries, distances, gains and estimators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import features as ft
from lodestone.plans.base import query, rounded
from lodestone.sources.tables import read

PATTERNS = {"CAPITAL": "[A-Z][a-z]*", "UPPER": "[A-Z]+", "VOWELS": "[aeiou]+"}
_TOKENS = "tk AS (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') AS tokens FROM conversations)"
_EACH = _TOKENS + ", each_ AS (SELECT conv_id, turn, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM tk), tok AS (SELECT conv_id, turn, i - 1 AS place, tokens[i] AS token, tokens FROM each_)"
_TERMS = "tf AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents) GROUP BY ALL)"


def _talk(spark, d):
    return read(spark, d, "conversations").withColumn("tokens", ft.letters(F.col("text")))


def _tokens(spark, d):
    return _talk(spark, d).select("conv_id", "turn", F.posexplode("tokens").alias("place", "token"))


def _counts(spark, d):
    """Terms without stop words or bounds: all runs of letters in lower case."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("term")
    return read(spark, d, "documents").select("doc_id", words).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


def _total(spark, d):
    return read(spark, d, "documents").agg(F.count("*").alias("n_docs"))


@query("SELECT gram, count(*) AS n FROM (SELECT substring('>' || text || '<', unnest(range(1, length(text) + 2 - 3 + 1)), 3) AS gram FROM conversations WHERE length(text) > 1) GROUP BY gram")
def character_grams(spark, d):
    return read(spark, d, "conversations").select(F.explode(ft.character_grams(F.col("text"), 3, True)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query(f"WITH {_EACH} SELECT gram, count(*) AS n FROM (SELECT array_to_string(tokens[place + 2 - s:place + 1], '_') AS gram FROM tok, (SELECT unnest([1, 2, 3]) AS s) WHERE place + 1 >= s) GROUP BY gram")
def token_grams(spark, d):
    return _talk(spark, d).select(F.explode(ft.token_grams(F.col("tokens"), [1, 2, 3])).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query(
    f"WITH {_EACH}, f AS (SELECT unnest(list_filter(['W=' || token, CASE WHEN length(token) > 3 THEN 'P=' || left(token, 3) END, CASE WHEN length(token) > 3 THEN 'S=' || right(token, 3) END, CASE WHEN place = 0 THEN 'FIRST' END, "
    + ", ".join(f"CASE WHEN regexp_full_match(token, '{p}') THEN '{k}' END" for k, p in PATTERNS.items())
    + "], lambda x: x IS NOT NULL)) AS feature FROM tok) SELECT feature, count(*) AS n FROM f GROUP BY feature"
)
def token_features(spark, d):
    found = ft.token_features(F.col("token"), F.col("place"), patterns=PATTERNS)
    return _tokens(spark, d).select(F.explode(found).alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))


_LEXICON = "lex AS (SELECT DISTINCT phrase FROM (SELECT array_to_string(w[1:unnest([2, 3])], ' ') AS phrase FROM (SELECT regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark) WHERE len(w) > 2))"


@query(
    f"""WITH dt AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents), {_LEXICON},
dp AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM dt),
g AS (SELECT doc_id, i - 1 AS place, s AS n, array_to_string(w[i:i + s - 1], ' ') AS phrase FROM dp, (SELECT unnest([1, 2, 3]) AS s) WHERE i + s - 1 <= len(w))
SELECT doc_id, place, phrase, n FROM g SEMI JOIN lex USING (phrase) QUALIFY row_number() OVER (PARTITION BY doc_id, place ORDER BY n DESC) = 1"""
)
def lexicon_phrases(spark, d):
    """The lexicon is the first two and three words of every benchmark item."""
    w = read(spark, d, "benchmark").select(ft.letters(F.col("text")).alias("w")).filter(F.size("w") > 2)
    lexicon = w.select(F.explode(F.array(*[F.array_join(F.slice("w", 1, k), " ") for k in (2, 3)])).alias("phrase"))
    return ft.phrase_places(read(spark, d, "documents").select("doc_id", ft.letters(F.col("text")).alias("tokens")), lexicon, 3)


@query("SELECT conv_id, turn, coalesce(last_value(CASE WHEN role <> 'user' THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 'user') AS remembered FROM conversations")
def remembered_labels(spark, d):
    return ft.remembered(read(spark, d, "conversations"), "conv_id", "turn", "role", "user").select("conv_id", "turn", "remembered")


@query(f"WITH {_TERMS} SELECT doc_id, term, round(ln(n) + 1, 6) AS x FROM tf")
def log_scaled_counts(spark, d):
    return rounded(_counts(spark, d).select("doc_id", "term", ft.log_scaled(F.col("n")).alias("x")), "x")


@query(f"WITH {_TERMS} SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) / (SELECT count(*) FROM documents) > 0.3")
def common_term_list(spark, d):
    return ft.common_terms(_counts(spark, d), _total(spark, d), 0.3)


@query(f"WITH {_TERMS} SELECT term, CAST(sum(n) AS BIGINT) AS n, count(*) AS df FROM tf GROUP BY term HAVING sum(n) >= 5 AND count(*) >= 2 AND count(*) / (SELECT count(*) FROM documents) <= 0.5")
def trimmed_features(spark, d):
    return ft.trimmed_features(_counts(spark, d), _total(spark, d), least=5, least_docs=2, share=0.5)


@query(f"WITH {_TERMS} SELECT term, row_number() OVER (ORDER BY term) - 1 AS id FROM (SELECT DISTINCT term FROM tf)")
def term_dictionary(spark, d):
    return ft.dictionary(_counts(spark, d), "term")


@query(f"WITH {_EACH}, t AS (SELECT *, turn * 100000 + place AS p FROM tok) SELECT conv_id, token, min(p) AS first, count(*) FILTER (p > m) AS n_later FROM (SELECT *, min(p) OVER (PARTITION BY conv_id, token) AS m FROM t) GROUP BY conv_id, token")
def first_mentions(spark, d):
    t = _tokens(spark, d).withColumn("p", F.col("turn") * 100000 + F.col("place"))
    return ft.first_mentions(t, "conv_id", "p").groupBy("conv_id", "token").agg(F.min("first").alias("first"), F.count_if("repeated").alias("n_later"))


@query("SELECT p_partkey, 'size' AS feature, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, lower(left(p_brand, 5)), 1.0 FROM part")
def parsed_features(spark, d):
    """Feature lines made from the parts, parsed again."""
    line = F.concat(F.lit("size=0 size="), F.col("p_size").cast("string"), F.lit(", "), F.lower(F.left("p_brand", F.lit(5))))
    return read(spark, d, "part").select("p_partkey", F.explode(ft.parsed_features(line)).alias("feature", "value"))


@query(
    """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
m AS (SELECT i, avg(v) AS c FROM x GROUP BY i)
SELECT vec_id, round(sum(abs(v - c)), 6) AS manhattan, round(sqrt(sum((v - c) * (v - c))), 6) AS euclidean, round(max(abs(v - c)), 6) AS greatest,
round(sum(abs(v - c) ** 3) ** (1 / 3), 6) AS minkowski, round(1 - sum(v * c) / sqrt(sum(v * v) * sum(c * c)), 6) AS angular FROM x JOIN m USING (i) GROUP BY vec_id"""
)
def vector_distances(spark, d):
    """Every embedding's distances from the mean of all."""
    e = read(spark, d, "embeddings")
    mean = e.select(F.posexplode("embedding").alias("i", "v")).groupBy("i").agg(F.avg(F.col("v").cast("double")).alias("c"))
    one = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("mean"))  # one row, as long as a vector
    return e.crossJoin(F.broadcast(one)).select("vec_id", *(F.round(c, 6).alias(k) for k, c in ft.distances(F.col("embedding"), F.col("mean")).items()))


def _hsql(*parts: str) -> str:
    whole = "(" + " + ".join(parts) + ")"
    return "(" + " + ".join(f"CASE WHEN {p} > 0 THEN -({p}) / {whole} * log2(({p}) / {whole}) ELSE 0 END" for p in parts) + ")"


@query(
    f"""WITH {_TERMS}, b AS (SELECT lang AS label, term, count(*) AS n FROM tf JOIN documents USING (doc_id) WHERE lang IS NOT NULL GROUP BY ALL),
t AS (SELECT term, sum(n) AS t FROM b GROUP BY term), l AS (SELECT lang AS label, count(*) AS l FROM documents WHERE lang IS NOT NULL GROUP BY lang),
x AS (SELECT label, term, n, CAST(t AS DOUBLE) AS t, CAST(l AS DOUBLE) AS l, CAST((SELECT sum(l) FROM l) AS DOUBLE) AS a FROM b JOIN t USING (term) JOIN l USING (label)),
g AS (SELECT label, term, n, greatest(0.0, {_hsql("l", "(a - l)")} - t / a * {_hsql("n", "(t - n)")} - CASE WHEN a > t THEN (a - t) / a * {_hsql("(l - n)", "(a - t - l + n)")} ELSE 0 END) + 0.0 AS gain, {_hsql("t", "(a - t)")} AS split FROM x)
SELECT label, term, n, round(gain, 6) AS gain, round(CASE WHEN split > 0 THEN gain / split ELSE 0 END, 6) AS ratio FROM g"""
)
def label_gains(spark, d):
    labels = read(spark, d, "documents").select("doc_id", F.col("lang").alias("label"))
    return rounded(ft.label_gains(_counts(spark, d), labels), "gain", "ratio")


@query(f"WITH {_TERMS}, c AS (SELECT term, CAST(sum(n) AS BIGINT) AS n FROM tf GROUP BY term), s AS (SELECT sum(n) AS a, count(*) AS v FROM c) SELECT term, n, round(n / a, 9) AS likeliest, round((n + 1) / (a + v), 9) AS laplace, round((n + 2.0::DOUBLE / v) / (a + 2.0::DOUBLE), 9) AS m_estimate FROM c, s")
def smoothed_multinomials(spark, d):
    counts = _counts(spark, d).groupBy("term").agg(F.sum("n").alias("n"))
    return rounded(ft.multinomials(counts, 2.0), "likeliest", "laplace", "m_estimate", digits=9)


@query(
    """WITH s AS (SELECT var_pop(l_quantity) AS a, var_pop(l_discount) AS b, covar_pop(l_quantity, l_discount) AS c, covar_pop(l_quantity, l_extendedprice) AS p, covar_pop(l_discount, l_extendedprice) AS q,
avg(l_quantity) AS mx, avg(l_discount) AS mz, avg(l_extendedprice) AS my FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_extendedprice IS NOT NULL),
w AS (SELECT (p * b - q * c) / (a * b - c * c) AS u, (q * a - p * c) / (a * b - c * c) AS v, mx, mz, my FROM s)
SELECT 'l_quantity' AS feature, round(u, 3) AS weight FROM w UNION ALL SELECT 'l_discount', round(v, 3) FROM w UNION ALL SELECT 'intercept', round(my - u * mx - v * mz, 3) FROM w"""
)
def least_squares_weights(spark, d):
    found = ft.least_squares(read(spark, d, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")
    return spark.createDataFrame([(k, round(w, 3)) for k, w in found.items()], "feature string, weight double")


@query(f"WITH {_TERMS}, s AS (SELECT term, count(*) AS n, sum(n) AS s, sum(n * n) AS q, (SELECT count(*) FROM documents) AS d FROM tf GROUP BY term) SELECT term, n, round(s / d, 6) AS mean, round((q - d * (s / d) * (s / d)) / (d - 1), 6) AS variance FROM s")
def term_moments(spark, d):
    return rounded(ft.sparse_moments(_counts(spark, d), _total(spark, d), "term", "n"), "mean", "variance")


@query(
    """WITH p AS (SELECT page_id, unnest(regexp_extract_all(html, '</?[A-Za-z][^<>]*>|[A-Za-z]+')) AS piece, generate_subscripts(regexp_extract_all(html, '</?[A-Za-z][^<>]*>|[A-Za-z]+'), 1) AS i FROM pages),
k AS (SELECT *, CASE WHEN piece LIKE '</%' THEN 'O' WHEN piece LIKE '<%' THEN lower(regexp_extract(piece, '^<([A-Za-z][A-Za-z0-9]*)', 1)) END AS own FROM p
WHERE NOT piece LIKE '<%' OR lower(regexp_extract(piece, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) IN ('p', 'a', 'h1', 'h2', 'li')),
t AS (SELECT page_id, piece, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING), 'O') AS tag FROM k)
SELECT page_id, tag, count(*) AS n, min(piece) AS least FROM t WHERE NOT piece LIKE '<%' GROUP BY page_id, tag"""
)
def tagged_tokens(spark, d):
    found = ft.tagged_tokens(F.col("html"), allowed=["p", "a", "h1", "h2", "li"])
    rows = read(spark, d, "pages").select("page_id", F.explode(found).alias("x")).select("page_id", "x.*")
    return rows.groupBy("page_id", "tag").agg(F.count("*").alias("n"), F.min("token").alias("least"))


RULES = [("of the", "of the"), ("in the", "inside 1"), ("the", "3 t")]


@query("""WITH w AS (SELECT conv_id, turn, ' ' || regexp_replace(lower(text), '(\\s)', '\\1\\1', 'g') || ' ' AS t FROM conversations),
r AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(t, '(\\s)of\\s+the(\\s)', '\\1of_the\\2', 'g'), '(\\s)in\\s+the(\\s)', '\\1inside_1\\2', 'g'), '(\\s)the(\\s)', '\\1_3_t\\2', 'g') AS t FROM w)
SELECT conv_id, turn, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS text FROM r""")
def replaced_phrases(spark, d):
    out = ft.replaced(F.col("text"), RULES)
    return read(spark, d, "conversations").select("conv_id", "turn", F.trim(F.regexp_replace(out, r"\s+", " ")).alias("text"))


@query("SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, round(avg(l_extendedprice), 4) AS mean, round(var_samp(l_extendedprice), 1) AS variance, round(stddev_samp(l_extendedprice) / sqrt(count(l_extendedprice)), 4) AS error, min(l_extendedprice) AS least, max(l_extendedprice) AS greatest FROM lineitem GROUP BY ALL")
def price_summary(spark, d):
    return rounded(rounded(ft.summary(read(spark, d, "lineitem"), "l_extendedprice", "l_returnflag", "l_linestatus"), "mean", "error", digits=4), "variance", digits=1)


@query()
def word_dirichlet(spark, d):
    """Parameters under which the documents' counts of four common words are likeliest; against its neighbours in the tests."""
    found = ft.dirichlet(_counts(spark, d).filter(F.col("term").isin("the", "of", "and", "in")), "doc_id", "term")
    return spark.createDataFrame([(k, round(v, 4)) for k, v in found.items()], "term string, alpha double")
