"""What must not gather in one task, or grow faster than the tables."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import concepts, embeddings, gibbs, index, keywords, learn, learners, loglinear, models, optimise, sequences


@pytest.fixture
def no_guess(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_never_dealt_by_class_alone(spark, no_guess):
    """A class's rows meet in no task, whatever the optimiser knows of sizes."""
    counts = spark.createDataFrame([(i, f"w{i % 5}", 1) for i in range(40)], "doc_id long, term string, n long")
    labels = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("label"))
    model, priors = learn.naive_bayes(counts, labels)
    scores = learn.naive_bayes_predict(counts, model.localCheckpoint(), priors.localCheckpoint())
    assert "hashpartitioning(label#" not in _plan(scores)
    assert scores.count() == 80


def test_long_documents_share_blocks_with_long_ones(spark):
    """a sweep takes as many steps as the longest document of a block, so a few long ones must not stand in all blocks."""
    rows = [(i, " ".join(f"w{i % 7}{'abcdefg'[j % 7]}x" for j in range(400 if i % 40 == 0 else 10))) for i in range(400)]
    docs = spark.createDataFrame([(i, t.replace("0", "q").translate(str.maketrans("123456", "rstuvy"))) for i, t in rows], "doc_id long, text string")
    state = gibbs.assigned(docs, 3, block=1_000)
    sizes = [(r.block, r.a, r.z) for r in state.groupBy("block").agg(F.min(F.size("terms")).alias("a"), F.max(F.size("terms")).alias("z")).collect()]
    assert len(sizes) > 3 and all(a == z for _, a, z in sizes) and state.count() == 400
    assert gibbs.assigned(docs.limit(0), 3).count() == 0 and gibbs.assigned(docs.select("doc_id", F.lit(None).cast("string").alias("text")), 3).count() == 400


def test_asked_vectors_are_not_sent_with_every_row(spark):
    """F8: no product of the model's rows and the asked vectors; many equal cosines keep to k, the smaller terms first."""
    model = spark.range(300).select(F.format_string("t%03d", "id").alias("term"), F.array(F.lit(1.0), (F.col("id") % 2).cast("double")).alias("v"))
    found = embeddings.nearest(model, model.filter("term < 't100'"), 3, block=7, rows=40)
    plan = _plan(found)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.term, []).append(r.neighbour)
    assert len(got) == 100 and got["t000"] == ["t002", "t004", "t006"] and got["t003"] == ["t001", "t005", "t007"]


def test_names_are_joined_once_not_in_every_round(spark, monkeypatch):
    """Rounds pass numbers between chunks and blocks; blocks grow with the rows, as each asks for its features' weights."""
    rows = spark.createDataFrame([(i % 2, [f"w{i % 7}", f"w{(i * i) % 11}", "all"]) for i in range(200)], "label int, terms array<string>")
    monkeypatch.setattr(optimise, "gradient", lambda *_: pytest.fail("weights are joined by name"))
    sizes = []
    real = optimise.dealt_to
    monkeypatch.setattr(optimise, "dealt_to", lambda total, least, most=0: sizes.append(real(900_000_000, least, most)) or real(total, least, most))
    weights, _, seen = loglinear.maximum_entropy(rows, rounds=3)
    assert weights.count() == 10 and len(seen) == 4 and sizes[0] < 100


def test_maximum_entropy_has_the_dense_models_scores(spark, monkeypatch):
    """F2: no dense vector of all buckets; the optimum is that of the binary model, the bias free, and scores are equal."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer

    rows = [(i, " ".join(f"{'abcdefg'[(i * j) % 7]}term" for j in range(1, 2 + i % 9)), None if i % 5 == 4 else float(i % 3 == 0)) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label double")
    x = docs.select("doc_id", "label", F.split("text", " ").alias("terms"))
    x = CountVectorizer(inputCol="terms", outputCol="features").fit(x).transform(x)
    known = x.filter("label is not null")
    dense = LogisticRegression(regParam=1 / known.count(), standardization=False, maxIter=500, tol=1e-12).fit(known).transform(x)
    want = {r.doc_id: (int(r.prediction), max(r.probability)) for r in dense.collect()}
    monkeypatch.setattr(models, "term_width", lambda *_: pytest.fail("dense weights of buckets"))
    got = {r.doc_id: (r.predicted, r.score) for r in models.maximum_entropy(docs).collect()}
    assert got.keys() == want.keys() and all(abs(got[i][1] - want[i][1]) < 2e-3 for i in want)
    assert all(got[i][0] == want[i][0] for i in want if want[i][1] > 0.51)


def test_key_words_take_no_group_for_each_text(spark):
    """many small graphs are iterated side by side, each as if alone."""
    words = spark.createDataFrame([(i, 1, j, f"w{(j * (i + 2)) % 7}") for i in range(40) for j in range(5 + i % 9)] + [(99, 1, 0, "alone")], "id long, part int, pos int, word string")
    nodes, edges = keywords.word_graph(words)
    found = keywords.ranked(nodes, keywords.transitions(nodes, edges))
    assert "FlatMapGroupsInPandas" not in _plan(found)
    got = {(r.id, r.word): r["rank"] for r in found.collect()}
    moves, n = keywords.transitions(nodes, edges).collect(), {}
    for r in nodes.collect():
        n.setdefault(r.id, {})[r.word] = len(n.get(r.id, {}))
    assert len(got) == sum(map(len, n.values()))
    for i, at in n.items():
        m, v = np.zeros((len(at), len(at))), np.full(len(at), 1 / len(at))
        for r in moves:
            if r.id == i:
                m[at[r.dst], at[r.src]] = r.p
        for _ in range(20):
            v = 0.85 * m @ v + 0.15 / len(at)
        assert all(abs(got[i, w] - v[k]) < 1e-12 for w, k in at.items())


def test_coherence_deals_no_occurrences_by_term(spark, no_guess):
    """top words go to the occurrences, not all occurrences to the top words."""
    rows = spark.createDataFrame([(i, "ab"[i % 2], f"w{(i * j) % 5}", 1) for i in range(30) for j in range(4)], "doc_id long, topic string, term string, n long")
    assert not re.search(r"SortMergeJoin \[topic#\d+, term#", _plan(models.coherence(rows, "topic")))
    once = rows.groupBy("doc_id", "topic", "term").agg(F.sum("n").alias("n"))
    found = lambda x: sorted((r.topic, round(r.coherence, 9)) for r in models.coherence(x, "topic", limit=3).collect())
    assert found(rows) == found(once) and len(found(rows)) == 2


def test_winnow_streams_few_bytes_a_term(spark):
    """the one ordered task gets numbers of a byte or few, the commonest terms the smallest, and no strings."""
    x = np.array([1, 127, 128, 16383, 16384, 2**21, 2**40])
    data, size = learners._to_bytes(x)
    assert learners._from_bytes(data.tobytes()).tolist() == x.tolist() and size.tolist() == [1, 1, 2, 2, 3, 4, 6]
    rows = [(i, i % 2, [f"averylongterm{j}" for j in range(100, 100 + i % 60)]) for i in range(200)] + [(900, 1, []), (901, 0, None)]
    each, names = learners._numbered(spark.createDataFrame(rows, "id long, label long, terms array<string>"))
    known = {r.number: r.term for r in names.collect()}
    got = {r.id: r.terms for r in each.collect()}
    assert {i: [known[n] for n in learners._from_bytes(b or b"")] for i, b in got.items()} == {i: t or [] for i, _, t in rows}
    assert sum(len(b or b"") for b in got.values()) == sum(len(t or []) for *_, t in rows)


def test_made_texts_are_counted_in_tasks_that_grow_in_number(spark, no_guess, monkeypatch):
    """few rows that make much text are dealt to tasks by its size, once."""
    pages = spark.range(50).select("id", F.repeat(F.lit("apple pear "), 20).alias("text"))
    monkeypatch.setattr(index, "HELD", 500)
    found = index.term_counts(index.dealt_by_size(pages, "id"), "id")
    plan = _plan(found).split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning(") == 1 and re.search(r"hashpartitioning\(id#\d+L, 22\)", plan)
    assert found.count() == 100 and found.filter("n <> 20").count() == 0


def test_support_vectors_have_no_dense_weights(spark, monkeypatch):
    """weights are rows of chunks of terms; a row without terms or label has a prediction, equal ids are one row."""
    rows = [(i, "aa bb cc" if i % 2 else "dd ee", float(i % 2)) for i in range(20)] + [(20, "aa cc", None), (21, "dd", None), (22, None, None), (20, "bb", None)]
    monkeypatch.setattr(models, "term_width", lambda *_: pytest.fail("dense weights of buckets"))
    got = {r.doc_id: r.predicted for r in models.support_vectors(spark.createDataFrame(rows, "doc_id long, text string, label double"), rounds=5).collect()}
    assert len(got) == 23 and got[20] == 1 and got[21] == 0 and all(got[i] == i % 2 for i in range(20))


def test_bigrams_are_counted_once(spark):
    """the counts are read for both words and the total, but the texts only once."""
    docs = spark.createDataFrame([("to be red fox red fox",), ("fox red",), (None,)], "text string")
    found = sequences.association(sequences.bigram_counts(docs))
    assert "regexp" not in _plan(found)
    assert sorted((r.a, r.b, r.n) for r in found.collect()) == [("fox", "red", 2), ("red", "fox", 2)]


def test_weights_are_joined_with_frequencies_once(spark, no_guess):
    """a row's norm comes with its own rows, and a title's terms are counted along; neither is joined to the weights."""
    rows = [(1, "red fox", "red fox red hen"), (2, "hen", "hen cat"), (2, "cow", "cat"), (None, "fox", "fox"), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, text string")
    titles = docs.select("doc_id", F.explode(F.split("title", " ")).alias("term"))
    counts = concepts.named_counts(index.term_rows(docs), titles)
    assert {(r.doc_id, r.term, r.n, r.named) for r in counts.collect()} == {(1, "red", 2, True), (1, "fox", 1, True), (1, "hen", 1, False), (2, "hen", 1, True), (2, "cat", 2, False), (None, "fox", 1, True)}
    counts, idf = counts.localCheckpoint(), spark.createDataFrame([("red", 1.0), ("fox", 2.0), ("hen", 0.5), ("cat", 0.0)], "term string, idf double")
    raw = counts.join(idf, "term").withColumn("x", (1 + F.log("n")) * F.col("idf"))
    red = 1 + np.log(2)
    for found, x in ((index.tfidf(counts, idf), (1, 1, red * red + 4.25)), (concepts.boosted(raw), (1.5, 1.5, red * red + 4.25 + (red + 2) / 2))):
        assert _plan(found).count("SortMergeJoin") == 1
        got = {(r.doc_id, r.term): r.w for r in found.collect()}
        assert set(got) == {(1, "red"), (1, "fox"), (1, "hen"), (2, "hen"), (2, "cat")} and got[2, "cat"] == 0
        assert abs(got[1, "red"] - red * x[0] / x[2] ** 0.5) < 1e-12 and abs(got[1, "hen"] - 0.5 / x[2] ** 0.5) < 1e-12


def test_postings_are_sorted_once_for_all_windows(spark, no_guess):
    """an order by an expression is a column of its own in each window, and is sorted anew; one column is sorted once a side."""
    weights = spark.range(500).select(F.lit("t").alias("term"), F.col("id").alias("doc_id"), (1 / (F.col("id") + 1)).alias("w"))
    found = index.pruned_postings(weights, always=10)
    assert _plan(found).split("== Initial Plan ==")[0].count("Sort [") <= 2
    assert [r["rank"] for r in found.orderBy("rank").limit(11).collect()] == list(range(11))
