"""Gibbs-sampled topics against planted ones, and belief propagation against all assignments."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import beliefs, gibbs

GROUPS = [[f"{a}{b}{c}" for b in "xyz" for c in "pqrs"] for a in ("ka", "lo", "mu")]


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(GROUPS[i % 3], 30))) for i in range(90)] + [(90, None), (91, ""), (91, GROUPS[0][0]), (None, GROUPS[1][0])]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("block", [200_000, 700])
def test_planted_topics_are_found(planted, block):
    state = gibbs.gibbs_topics(planted, 3, rounds=15, seed=2, block=block)
    assert (state.select("block").distinct().count() > 1) == (block == 700)
    assert state.count() == 94 and state.agg(F.sum(F.size("z"))).first()[0] == 90 * 30 + 2
    top = {}
    for r in gibbs.topic_terms(state, 12).collect():
        top.setdefault(r.topic, set()).add(r.term)
    assert sorted(map(sorted, top.values())) == sorted(map(sorted, GROUPS))
    even = gibbs.shares(F.col("z"), 3, 0.1)
    share = {(r.key, r.n): r.s for r in state.select("key", F.size("terms").alias("n"), even.alias("s")).collect()}
    assert all(abs(x - 1 / 3) < 1e-9 for x in share[90, 0]) and max(share[0, 30]) > 0.95


def test_reruns_agree_and_counts_fit(planted):
    a, b = (sorted((repr(r.key), r.terms, r.z) for r in gibbs.gibbs_topics(planted, 3, rounds=3).collect()) for _ in range(2))
    assert a == b


def test_unseen_documents_take_the_trained_topics(spark, planted):
    state = gibbs.gibbs_topics(planted, 3, rounds=15, seed=2)
    counts = gibbs.term_topics(state, 3)
    unseen = spark.createDataFrame([(i, " ".join(GROUPS[i][:8]) + " neverseen") for i in range(3)] + [(3, None)], "doc_id long, text string")
    found = {r.key: r.z for r in gibbs.inferred_topics(unseen, counts, 3).collect()}
    owner = {r.term: int(np.argmax(r.c)) for r in counts.collect()}
    for i in range(3):
        assert len(found[i]) == 9 and sum(z == owner[GROUPS[i][0]] for z in found[i]) >= 8
    assert list(found[3]) == []


def test_empty_table_and_diagnostics(spark, planted):
    assert gibbs.gibbs_topics(planted.limit(0), 3, rounds=2).count() == 0
    state = spark.createDataFrame([(0, 1, ["a", "b", "a"], [0, 0, 1]), (0, 2, ["a"], [0])], "block int, key long, terms array<string>, z array<int>")
    d = {r.topic: r for r in gibbs.diagnostics(state).collect()}
    p = np.array([2 / 3, 1 / 3])
    assert d[0].tokens == 3 and d[0].documents == 2 and d[1].documents == 1
    assert abs(d[0].effective_words - 1 / (p @ p)) < 1e-9 and abs(d[0].document_entropy + p @ np.log(p)) < 1e-9
    assert abs(d[0].uniform_distance - p @ np.log(p * 2)) < 1e-9 and abs(d[0].corpus_distance - p @ np.log(p / [3 / 4, 1 / 4])) < 1e-9


def _graph(spark, links, k=3, strength=1.0, seed=0):
    rng = np.random.default_rng(seed)
    names = sorted({v for e in links for v in e})
    node = {v: rng.uniform(0.2, 1, k) for v in names}
    edge = {e: np.exp(strength * rng.normal(size=(k, k))) for e in links}
    nodes = spark.createDataFrame([(v, x, float(p)) for v in names for x, p in enumerate(node[v])], "v string, x int, p double")
    edges = spark.createDataFrame([(u, v, x, y, float(w[x, y])) for (u, v), w in edge.items() for x in range(k) for y in range(k)], "u string, v string, x int, y int, p double")
    whole = {}
    for xs in itertools.product(range(k), repeat=len(names)):
        at = dict(zip(names, xs, strict=True))
        whole[xs] = np.prod([node[v][at[v]] for v in names]) * np.prod([w[at[u], at[v]] for (u, v), w in edge.items()])
    total = sum(whole.values())
    exact = {(v, x): sum(p for xs, p in whole.items() if xs[i] == x) / total for i, v in enumerate(names) for x in range(k)}
    return nodes, edges, exact, dict(zip(names, max(whole, key=whole.get), strict=True))


def test_beliefs_are_exact_on_trees(spark):
    nodes, edges, exact, best = _graph(spark, [("a", "b"), ("b", "c"), ("b", "d"), ("e", "d")])
    found = {(r.v, r.x): r.p for r in beliefs.marginals(nodes, edges).collect()}
    assert found.keys() == exact.keys() and all(abs(found[c] - exact[c]) < 1e-9 for c in exact)
    assert {r.v: r.x for r in beliefs.best_states(nodes, edges).collect()} == best


def test_beliefs_are_near_on_loops(spark):
    nodes, edges, exact, _ = _graph(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")], k=2, strength=0.3)
    found = {(r.v, r.x): r.p for r in beliefs.marginals(nodes, edges, damping=0.2, tolerance=1e-6).collect()}
    assert all(abs(found[c] - exact[c]) < 0.02 for c in exact)
    with pytest.raises(ValueError, match="still move"):
        beliefs.marginals(nodes, edges, tolerance=0.0, rounds=1)


def test_lone_nodes_and_zero_weights(spark):
    nodes = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0), ("b", 0, 0.0), ("b", 1, 1.0)], "v string, x int, p double")
    none = spark.createDataFrame([], "u string, v string, x int, y int, p double")
    assert {(r.v, r.x): round(r.p, 9) for r in beliefs.marginals(nodes, none).collect()} == {("a", 0): 0.25, ("a", 1): 0.75, ("b", 0): 0.0, ("b", 1): 1.0}
    equal = spark.createDataFrame([("a", "b", x, y, float(x == y)) for x in (0, 1) for y in (0, 1)], "u string, v string, x int, y int, p double")
    assert {(r.v, r.x): round(r.p, 9) for r in beliefs.marginals(nodes, equal).collect()} == {("a", 0): 0.0, ("a", 1): 1.0, ("b", 0): 0.0, ("b", 1): 1.0}


def test_labelled_documents_keep_to_their_topics(spark):
    """Documents of one topic fix what it is; those of two then split their words between them."""
    rng = np.random.default_rng(1)
    both = [*GROUPS[0], *GROUPS[1]]
    rows = [(i, " ".join(rng.choice(both if i % 3 == 2 else GROUPS[i % 3], 20)), [0, 1] if i % 3 == 2 else [i % 3]) for i in range(60)] + [(60, "kaxp", None), (61, "kaxp", []), (62, None, [1])]
    state = gibbs.gibbs_topics(spark.createDataFrame(rows, "doc_id long, text string, own array<int>"), 3, rounds=10, labels="own")
    for r in state.collect():
        assert set(r.z) <= set(r.allowed) and len(r.z) == len(r.terms)
        assert list(r.allowed) == ([0, 1, 2] if r.key in (60, 61) else [0, 1] if r.key % 3 == 2 and r.key < 60 else [1] if r.key == 62 else [r.key % 3])
    owner = {r.term: int(np.argmax(r.c)) for r in gibbs.term_topics(state, 3).collect()}
    assert all(owner[t] == 0 for t in GROUPS[0]) and all(owner[t] == 1 for t in GROUPS[1])
