"""Sequence lattices: the n best paths, confidences by constrained sums, and maximum-entropy Markov models.

A lattice is emit[t, s], start[s] and move[s, t] (or move[t, s, s'] where moves change along the sequence, move[t] leading to place
t) in logs. A sequence is worked through in its task; n best paths hold n partial paths a state, no more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import loglinear
from lodestone.operators.tagging import Markov, _gathered, _sum

#: Scores that agree to so many digits are ties.
DIGITS = 9
Lattice = tuple[np.ndarray, np.ndarray, np.ndarray]


def _moves(emit: np.ndarray, move: np.ndarray) -> Callable[[int], np.ndarray]:
    return (lambda t: move[t]) if move.ndim == 3 else (lambda t: move)


def n_best(emit: np.ndarray, start: np.ndarray, move: np.ndarray, n: int) -> list[tuple[np.ndarray, float]]:
    """The n paths of the greatest score, the one whose states come first at ties. Each state keeps its n best partial paths: a path
    among the n best has no other beginning."""
    k, to = len(start), _moves(emit, move)
    score, state, order = start + emit[0], np.arange(k), np.arange(k)  # partial paths, and their place by their states
    back = []
    for t in range(1, len(emit)):
        rows = to(t)
        kept = []
        for s in range(k):
            found = score + rows[state, s]
            kept.append(np.lexsort((order, -np.round(found, DIGITS)))[:n])
        before = np.concatenate(kept)
        after = np.repeat(np.arange(k), [len(x) for x in kept])
        score = score[before] + rows[state[before], after] + emit[t, after]
        order = np.argsort(np.lexsort((after, order[before])), kind="stable")
        state = after
        back.append((before, state))
    out = []
    for i in np.lexsort((order, -np.round(score, DIGITS)))[:n]:
        path, at = [int(state[i])], int(i)
        for t in range(len(back) - 1, -1, -1):
            at = int(back[t][0][at])
            path.append(int(back[t - 1][1][at]) if t else at)
        out.append((np.array(path[::-1]), float(score[i])))
    return out


def log_sum(emit: np.ndarray, start: np.ndarray, move: np.ndarray, allowed: np.ndarray | None = None) -> float:
    """The log of the summed weights of all paths, or of those that keep to `allowed`[t, s]; -inf where there are none."""
    to = _moves(emit, move)
    a, emit = start, emit if allowed is None else np.where(allowed, emit, -np.inf)
    for t in range(len(emit)):
        if t:
            a = np.full(len(start), -np.inf) if np.isneginf(a).all() else _sum(np.maximum(a[:, None] + to(t), -1e300), 0)
        a = a + emit[t]
        a[a < -1e290] = -np.inf
    return -np.inf if np.isneginf(a).all() else float(_sum(a, 0))


def spans(path: np.ndarray) -> list[tuple[int, int]]:
    """[begin, end) of the runs of equal states."""
    cut = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
    return list(zip(cut[:-1], cut[1:], strict=True))


def confidence(lattice: Lattice, path: np.ndarray, begin: int, end: int) -> float:
    """The probability that the sequence has this very span: its state inside, another one just before and behind."""
    emit, start, move = lattice
    allowed = np.ones(emit.shape, bool)
    own = path[begin]
    allowed[begin:end] = False
    allowed[begin:end, own] = True
    for t in (begin - 1, end):
        if 0 <= t < len(emit):
            allowed[t, own] = False
    return float(np.exp(log_sum(emit, start, move, allowed) - log_sum(emit, start, move)))


def _paths(held: DataFrame, lattice: Callable[[list], Lattice], names: list, n: int, kind: str) -> DataFrame:
    """(seq, rank, t, state, score) of gathered rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seq, rows in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                t = [r["t"] for r in rows]
                for rank, (path, score) in enumerate(n_best(*lattice(rows), n)):
                    m = len(t)
                    yield pa.RecordBatch.from_arrays([pa.array([seq.as_py()] * m, pa.int64()), pa.array([rank + 1] * m, pa.int32()), pa.array(t, pa.int64()), pa.array([names[s] for s in path]), pa.array(np.full(m, score))], ["seq", "rank", "t", "state", "score"])

    return held.mapInArrow(run, f"seq long, rank int, t long, state {kind}, score double")


def _confidences(held: DataFrame, lattice: Callable[[list], Lattice], names: list, kind: str) -> DataFrame:
    """(seq, begin, end, state, p): the spans of the best path, first and last t, with their confidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seq, rows in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own, t = lattice(rows), [r["t"] for r in rows]
                path = n_best(*own, 1)[0][0]
                found = spans(path)
                p = [confidence(own, path, a, b) for a, b in found]
                yield pa.RecordBatch.from_arrays([pa.array([seq.as_py()] * len(found), pa.int64()), pa.array([t[a] for a, _ in found], pa.int64()), pa.array([t[b - 1] for _, b in found], pa.int64()), pa.array([names[path[a]] for a, _ in found]), pa.array(p)], ["seq", "begin", "end", "state", "p"])

    return held.mapInArrow(run, f"seq long, begin long, end long, state {kind}, p double")


def best_markov_paths(rows: DataFrame, model: Markov, n: int, kind: str = "string") -> DataFrame:
    """(seq, rank, t, state, score): the n likeliest paths of (seq, t, symbol), with their log probabilities."""
    return _paths(_gathered(rows, "symbol"), lambda held: (model.scores([r["symbol"] for r in held]), model.start, model.move), model.states, n, kind)


def markov_confidences(rows: DataFrame, model: Markov, kind: str = "string") -> DataFrame:
    """(seq, begin, end, state, p): the best path's spans and the probability of each, over all paths."""
    return _confidences(_gathered(rows, "symbol"), lambda held: (model.scores([r["symbol"] for r in held]), model.start, model.move), model.states, kind)


def fit_entropy_markov(rows: DataFrame, variance: float = 10.0, l1: float = 0.0, rounds: int = 100, tolerance: float = 1e-8, block: int = loglinear.BLOCK) -> tuple[DataFrame, list, list[float]]:
    """((feature, w), states, values by round) of (seq, t, state, features): the probability of a state given the one before and the
    features here, by maximum entropy; the state before is a feature like the others, `START` where there is none."""
    before = F.lag("state").over(Window.partitionBy("seq").orderBy("t"))
    came = F.when(before.isNull(), loglinear.START).otherwise(F.concat(F.lit(loglinear.FROM), before.cast("string")))
    return loglinear.maximum_entropy(rows.select(F.col("state").alias("label"), F.concat("features", F.array(came)).alias("terms")), variance, l1, rounds, tolerance, block)


def entropy_lattice(emit: np.ndarray, start: np.ndarray, move: np.ndarray) -> Lattice:
    """Weights to probabilities: each place's states are normalised given the state before."""
    first = emit[0] + start
    rows = emit[:, None, :] + move[None]
    rows = rows - _sum(rows, 2)[:, :, None]
    return np.zeros_like(emit), first - _sum(first, 0), rows


def _entropy(rows: DataFrame, weights: DataFrame, states: list) -> tuple[DataFrame, Callable[[list], Lattice]]:
    start, move = loglinear.moves(weights, states)
    bias = weights.filter(F.col("feature") == loglinear.BIAS).first()
    own = np.array(bias.w) if bias else np.zeros(len(states))
    return loglinear.emissions(rows, weights, len(states)), lambda held: entropy_lattice(np.array([r["e"] for r in held]) + own, start, move)


def best_entropy_paths(rows: DataFrame, weights: DataFrame, states: list, n: int = 1, kind: str = "string") -> DataFrame:
    """(seq, rank, t, state, score): the n likeliest paths of (seq, t, features)."""
    held, lattice = _entropy(rows, weights, states)
    return _paths(held, lattice, states, n, kind)


def entropy_confidences(rows: DataFrame, weights: DataFrame, states: list, kind: str = "string") -> DataFrame:
    """(seq, begin, end, state, p): the best path's spans and the probability of each."""
    held, lattice = _entropy(rows, weights, states)
    return _confidences(held, lattice, states, kind)


def best_chain_paths(rows: DataFrame, weights: DataFrame, states: list, n: int = 1, kind: str = "string") -> DataFrame:
    """(seq, rank, t, state, score): the n best paths of a chain that `loglinear.chain` fitted; scores are log weights."""
    start, move = loglinear.moves(weights, states)
    return _paths(loglinear.emissions(rows, weights, len(states)), lambda held: (np.array([r["e"] for r in held]), start, move), states, n, kind)
