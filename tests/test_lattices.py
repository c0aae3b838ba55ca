"""N best paths, confidences and maximum-entropy Markov models against all paths."""

import itertools
import math
import random

import numpy as np
import pytest

from lodestone.operators import lattices, loglinear, tagging


def _all(emit, start, move):
    """(path, score) of every path."""
    to = (lambda t: move[t]) if move.ndim == 3 else (lambda t: move)
    for path in itertools.product(range(len(start)), repeat=len(emit)):
        yield path, start[path[0]] + sum(emit[t, s] for t, s in enumerate(path)) + sum(to(t)[path[t - 1], path[t]] for t in range(1, len(path)))


def _lattice(r, n, k, varying):
    return r.normal(size=(n, k)), r.normal(size=k), r.normal(size=(n, k, k) if varying else (k, k))


@pytest.mark.parametrize("varying", [False, True])
def test_n_best_equal_the_sorted_list(varying):
    r = np.random.default_rng(1)
    for n, k, m in [(1, 3, 5), (4, 3, 7), (6, 2, 64), (5, 3, 300), (3, 1, 2)]:
        lattice = _lattice(r, n, k, varying)
        want = sorted(_all(*lattice), key=lambda x: (-round(x[1], 9), x[0]))[:m]
        got = lattices.n_best(*lattice, m)
        assert [tuple(p) for p, _ in got] == [p for p, _ in want] and np.allclose([s for _, s in got], [s for _, s in want])
    same = np.zeros((4, 3)), np.zeros(3), np.zeros((3, 3))  # all paths tie
    assert [tuple(p) for p, _ in lattices.n_best(*same, 9)] == list(itertools.product(range(3), repeat=4))[:9]


@pytest.mark.parametrize("varying", [False, True])
def test_constrained_sums_equal_matching_paths(varying):
    r = np.random.default_rng(2)
    for n, k in [(1, 2), (5, 3), (6, 2)]:
        lattice = _lattice(r, n, k, varying)
        paths = list(_all(*lattice))
        assert abs(lattices.log_sum(*lattice) - math.log(sum(math.exp(s) for _, s in paths))) < 1e-9
        allowed = r.random((n, k)) < 0.7
        some = [math.exp(s) for p, s in paths if all(allowed[t, x] for t, x in enumerate(p))]
        got = lattices.log_sum(*lattice, allowed)
        assert abs(got - math.log(sum(some))) < 1e-9 if some else np.isneginf(got)
        best = np.array(max(paths, key=lambda x: x[1])[0])
        for a, b in lattices.spans(best):
            match = [math.exp(s) for p, s in paths if all(p[t] == best[a] for t in range(a, b)) and (a == 0 or p[a - 1] != best[a]) and (b == n or p[b] != best[a])]
            assert abs(lattices.confidence(lattice, best, a, b) - sum(match) / sum(math.exp(s) for _, s in paths)) < 1e-9


def test_frames_of_paths(spark):
    r = random.Random(4)
    rows = [(q, 2 * t, r.choice("AB"), r.choice("xyz")) for q in range(20) for t in range(r.randint(1, 6))]
    frame = spark.createDataFrame(rows, "seq long, t long, state string, symbol string").repartition(3)
    model = tagging.fit_markov(frame)
    got = lattices.best_markov_paths(frame.drop("state"), model, 3).collect()
    for q in range(20):
        own = sorted((t, x) for a, t, _, x in rows if a == q)
        want = sorted(_all(model.scores([x for _, x in own]), model.start, model.move), key=lambda x: (-round(x[1], 9), x[0]))[:3]
        for rank, (path, score) in enumerate(want):
            found = sorted((g.t, g.state, g.score) for g in got if g.seq == q and g["rank"] == rank + 1)
            assert [(t, s) for t, s, _ in found] == [(t, model.states[s]) for (t, _), s in zip(own, path, strict=True)] and abs(found[0][2] - score) < 1e-9
    best = {(g.seq, g.t): g.state for g in got if g["rank"] == 1}
    for c in lattices.markov_confidences(frame.drop("state"), model).collect():
        assert 0 < c.p <= 1 + 1e-9 and all(best[c.seq, t] == c.state for t in range(c.begin, c.end + 1, 2))


def test_entropy_markov_model(spark):
    r = random.Random(7)
    rows = []
    for q in range(60):
        state = r.choice("AB")
        for t in range(r.randint(1, 6)):
            state = state if r.random() < 0.8 else r.choice("AB")
            rows.append((q, t, state, [f"s{r.choice('12' if state == 'A' else '23')}"]))
    frame = spark.createDataFrame(rows, "seq long, t long, state string, features array<string>")
    weights, states, _ = lattices.fit_entropy_markov(frame, 5.0, tolerance=1e-9, block=200)
    w = {x.feature: np.array(x.w) for x in weights.collect()}
    assert {loglinear.START, f"{loglinear.FROM}A", f"{loglinear.FROM}B", "s1", "s2", "s3"} <= set(w)

    def local(before, features):
        s = w[loglinear.BIAS] + w[before] + sum(w[f] for f in features)
        return s - np.log(np.exp(s).sum())

    got = lattices.best_entropy_paths(frame.drop("state"), weights, states, 2).collect()
    right = 0
    for q in range(60):
        own = sorted((t, s, f) for a, t, s, f in rows if a == q)
        scored = []
        for path in itertools.product(range(2), repeat=len(own)):
            before, total = loglinear.START, 0.0
            for s, (_, _, f) in zip(path, own, strict=True):
                total += local(before, f)[s]
                before = f"{loglinear.FROM}{states[s]}"
            scored.append((path, total))
        assert abs(sum(math.exp(s) for _, s in scored) - 1) < 1e-9  # normalised place by place
        for rank, (path, score) in enumerate(sorted(scored, key=lambda x: (-round(x[1], 9), x[0]))[:2]):
            found = sorted((g.t, g.state, g.score) for g in got if g.seq == q and g["rank"] == rank + 1)
            assert [s for _, s, _ in found] == [states[s] for s in path] and abs(found[0][2] - score) < 1e-8
            right += sum(s == x for (_, x, _), s in zip(own, [s for _, s, _ in found], strict=True)) if not rank else 0
    assert right > 0.8 * len(rows)
    assert all(0 < c.p < 1 + 1e-9 for c in lattices.entropy_confidences(frame.drop("state"), weights, states).collect())
