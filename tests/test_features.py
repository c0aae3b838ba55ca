"""Token features, gains and estimators on small rows with nulls, empty texts, repeats and empty tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import features as ft


def _one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "n", "borders", "found"), [("abcd", 2, False, ["ab", "bc"]), ("ab", 2, False, []), ("a", 2, False, []), ("", 2, True, []), (None, 2, False, []), ("ab", 2, True, [">a", "ab"]), ("a\nbc", 2, False, ["a\n", "\nb"]), ("a😀bc", 2, False, ["a😀", "😀b"])])
def test_character_grams(spark, text, n, borders, found):
    assert _one(spark, text, ft.character_grams(F.col("text"), n, borders)) == found


def test_token_grams(spark):
    assert _one(spark, "a b c", ft.token_grams(F.split("text", " "), [1, 2])) == ["a", "b", "a_b", "c", "b_c"]
    assert _one(spark, None, ft.token_grams(ft.letters(F.col("text")), [1, 2])) == []
    assert _one(spark, "a", ft.token_grams(F.split("text", " "), [3])) == []


def test_phrases_take_the_longest(spark):
    rows = spark.createDataFrame([(1, "a b c a b".split()), (2, []), (3, None)], "doc_id long, tokens array<string>")
    lexicon = spark.createDataFrame([("a b",), ("a b c",), ("a b",), ("b",), (None,)], "phrase string")
    found = {(r.doc_id, r.place): r.phrase for r in ft.phrase_places(rows, lexicon, 3).collect()}
    assert found == {(1, 0): "a b c", (1, 1): "b", (1, 3): "a b", (1, 4): "b"}
    assert ft.phrase_places(rows.limit(0), lexicon, 3).count() == 0


def test_parsed_features(spark):
    assert _one(spark, " a=1.5, b c=x a=2 ", ft.parsed_features(F.col("text"))) == {"b": 1.0, "c": None, "a": 2.0}
    assert _one(spark, None, ft.parsed_features(F.col("text"))) == {}


def test_remembered_labels(spark):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(["O", "A", "O", None, "B", "O"])], "seq long, t long, label string")
    assert [r.remembered for r in ft.remembered(rows, "seq", "t", "label", "O").orderBy("t").collect()] == ["O", "A", "A", "A", "B", "B"]


def test_dictionary_has_no_gaps(spark):
    rows = spark.createDataFrame([(f"w{i % 50:02}",) for i in range(500)] + [(None,)], "term string")
    assert [(r.term, r.id) for r in ft.dictionary(rows, "term").orderBy("id").collect()] == [(f"w{i:02}", i) for i in range(50)]


def test_label_gains_against_entropies(spark):
    rng = np.random.default_rng(3)
    labels = [(i, ["x", "y", "z"][rng.integers(3)]) for i in range(60)]
    terms = sorted({(i, f"t{j}", 1) for i in range(60) for j in range(4) if rng.random() < 0.2 + 0.2 * j} | {(i, "all", 2) for i in range(60)})
    found = ft.label_gains(spark.createDataFrame(terms, "doc_id long, term string, n long"), spark.createDataFrame(labels, "doc_id long, label string")).collect()

    def h(xs):
        return -sum(p * math.log2(p) for p in (xs.count(v) / len(xs) for v in set(xs))) if xs else 0.0

    for r in found:
        y = [lab == r.label for _, lab in labels]
        has = [any(t[0] == i and t[1] == r.term for t in terms) for i, _ in labels]
        a, b = [v for v, k in zip(y, has, strict=True) if k], [v for v, k in zip(y, has, strict=True) if not k]
        gain = h(y) - len(a) / 60 * h(a) - len(b) / 60 * h(b)
        assert abs(r.gain - gain) < 1e-9 and abs(r.ratio - (gain / h(has) if h(has) else 0)) < 1e-9


def test_least_squares_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)] + [(None, 1.0, 1.0, 1.0)], "a double, b double, c double, y double")
    w = ft.least_squares(df, ["a", "b", "c"], "y")
    assert np.allclose([w["a"], w["b"], w["c"], w["intercept"]], np.linalg.lstsq(np.c_[x, np.ones(200)], y, rcond=None)[0])
    shrunk = ft.least_squares(df, ["a", "b", "c"], "y", ridge=1e6)
    assert abs(shrunk["b"]) < 0.01 and abs(shrunk["intercept"] - y.mean()) < 0.01
    with pytest.raises(ValueError, match="no row"):
        ft.least_squares(df.limit(0), ["a"], "y")


def test_distances_and_moments(spark):
    row = spark.createDataFrame([([1.0, 2.0, 0.0], [0.0, 0.0, 0.0]), ([1.0, 0.0, 0.0], [0.0, 1.0, 0.0])], "a array<double>, b array<double>").select(*(c.alias(k) for k, c in ft.distances(F.col("a"), F.col("b")).items())).collect()
    assert row[0].manhattan == 3 and abs(row[0].euclidean - 5**0.5) < 1e-12 and row[0].greatest == 2 and abs(row[0].minkowski - 9 ** (1 / 3)) < 1e-12 and row[0].angular == 1
    assert row[1].angular == 1
    total = spark.createDataFrame([(4,)], "n_docs long")
    m = ft.sparse_moments(spark.createDataFrame([("t", 2), ("t", 4)], "term string, n long"), total, "term", "n").first()
    assert m["mean"] == 1.5 and abs(m["variance"] - np.var([2, 4, 0, 0], ddof=1)) < 1e-12


def test_tagged_tokens(spark):
    found = lambda text, **k: [(x.token, x.tag) for x in _one(spark, text, ft.tagged_tokens(F.col("text"), **k))]
    assert found("a <PER id=1>Ann Lee</PER> met <LOC>Rome") == [("a", "O"), ("Ann", "per"), ("Lee", "per"), ("met", "O"), ("Rome", "loc")]
    assert found("x <b><i>y</i> z</b>", allowed=["i"]) == [("x", "O"), ("y", "i"), ("z", "O")]
    assert found("x <b><i>y</i> z</b>", allowed=["b"]) == [("x", "O"), ("y", "b"), ("z", "b")]
    assert found(None) == [] and found("") == [] and found("<p></p>") == []


def test_replaced_phrases(spark):
    rules = [("new  york", "ny city"), ("york", "yo$rk"), ("a.b", "2 x")]
    assert _one(spark, "New York york a.b axb newyork york, new york new york", ft.replaced(F.col("text"), rules)) == "ny_city yo$rk _2_x axb newyork york, ny_city ny_city"
    assert _one(spark, None, ft.replaced(F.col("text"), rules)) is None


def test_dirichlet_is_the_likeliest(spark):
    rng = np.random.default_rng(0)
    true = np.array([0.8, 2.0, 4.0])
    rows = [(i, k, int(c)) for i in range(600) for k, c in zip("abc", rng.multinomial(40, rng.dirichlet(true)), strict=True)]
    found = ft.dirichlet(spark.createDataFrame(rows, "g long, k string, n long"), "g", "k", rounds=2000, tolerance=1e-9)
    got = np.array([found[k] for k in "abc"])
    assert np.allclose(got, true, rtol=0.15)
    table = np.array([n for *_, n in rows]).reshape(-1, 3)

    def score(a):
        lg = np.vectorize(math.lgamma)
        return (math.lgamma(a.sum()) - lg(a.sum() + table.sum(1))).sum() + (lg(a + table) - lg(a)).sum()

    assert all(score(got) >= score(got * f) for f in ([1.02, 1, 1], [0.98, 1, 1], [1, 1.02, 1], [1, 0.98, 1], [1, 1, 1.02], [1, 1, 0.98]))
    assert ft.dirichlet(spark.createDataFrame([], "g long, k string, n long"), "g", "k") == {}


def test_summary_leaves_nulls_out(spark):
    r = ft.summary(spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", None)], "g string, x double"), "x", "g")
    assert {x.g: (x.n, x["mean"], x.variance, x.error, x.least) for x in r.collect()} == {"a": (2, 2.0, 2.0, 1.0, 1.0), "b": (0, None, None, None, None)}
