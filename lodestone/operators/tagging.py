"""Sequence models: a hidden Markov model by counts, its best paths and state probabilities, and a linear-chain CRF.

A model is small beside the data (states x states, and states x symbols or hashed features); sequences are groups whose
rows are gathered in order, and worked through in numpy, one sequence at a time, in batches of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Markov:
    """Log probabilities: start[s], move[s, t], emit[s, symbol]; the last column of emit is for unknown symbols."""

    def __init__(self, states: list, symbols: list, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.states, self.place = states, {x: i for i, x in enumerate(symbols)}
        self.start, self.move, self.emit = start, move, emit

    def scores(self, symbols: list) -> np.ndarray:
        return self.emit[:, [self.place.get(x, -1) for x in symbols]].T


def fit_markov(rows: DataFrame) -> Markov:
    """From (seq, t, state, symbol) by counts plus one. The counts are gathered: states x (states + symbols) numbers."""
    after = rows.alias("a").join(rows.select("seq", (F.col("t") - 1).alias("t"), F.col("state").alias("next")), ["seq", "t"])
    emit = rows.groupBy("state", "symbol").agg(F.count("*").alias("n")).collect()
    move = after.groupBy("state", "next").agg(F.count("*").alias("n")).collect()
    first = rows.groupBy("seq").agg(F.min_by("state", "t").alias("state")).groupBy("state").agg(F.count("*").alias("n")).collect()
    states, symbols = sorted({r.state for r in emit}), sorted({r.symbol for r in emit})
    at, col = {s: i for i, s in enumerate(states)}, {x: i for i, x in enumerate(symbols)}
    b, m, e = np.ones(len(states)), np.ones((len(states), len(states))), np.ones((len(states), len(symbols) + 1))
    for r in first:
        b[at[r.state]] += r.n
    for r in move:
        m[at[r.state], at[r.next]] += r.n
    for r in emit:
        e[at[r.state], col[r.symbol]] += r.n
    return Markov(states, symbols, np.log(b / b.sum()), np.log(m / m.sum(1, keepdims=True)), np.log(e / e.sum(1, keepdims=True)))


def viterbi(emit: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, float]:
    """The best states of one sequence, the first state at ties, and their log score."""
    n = len(emit)
    back, v = np.zeros((n, len(start)), np.int32), start + emit[0]
    for t in range(1, n):
        x = v[:, None] + move
        back[t] = x.argmax(0)
        v = x.max(0) + emit[t]
    path = np.zeros(n, np.int32)
    path[-1] = int(v.argmax())
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path, float(v.max())


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def forward_backward(emit: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Log forward and backward scores, and the log of all paths' sum."""
    n = len(emit)
    a, b = np.zeros_like(emit), np.zeros_like(emit)
    a[0] = start + emit[0]
    for t in range(1, n):
        a[t] = _sum(a[t - 1][:, None] + move, 0) + emit[t]
    for t in range(n - 2, -1, -1):
        b[t] = _sum(move + (emit[t + 1] + b[t + 1])[None, :], 1)
    return a, b, float(_sum(a[-1], 0))


def _gathered(rows: DataFrame, *columns: str) -> DataFrame:
    """(seq, rows): a sequence's rows in order."""
    return rows.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("t", *columns))).alias("rows"))


def best_paths(rows: DataFrame, model: Markov, kind: str = "string") -> DataFrame:
    """(seq, t, state, score) of (seq, t, symbol): the most likely states; score is the whole path's log probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seq, held in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                path, score = viterbi(model.scores([r["symbol"] for r in held]), model.start, model.move)
                n = len(held)
                yield pa.RecordBatch.from_arrays([pa.array([seq.as_py()] * n, pa.int64()), pa.array([r["t"] for r in held], pa.int64()), pa.array([model.states[s] for s in path]), pa.array(np.full(n, score))], ["seq", "t", "state", "score"])

    return _gathered(rows, "symbol").mapInArrow(run, f"seq long, t long, state {kind}, score double")


def state_posteriors(rows: DataFrame, model: Markov, kind: str = "string") -> DataFrame:
    """(seq, t, state, p): the probability of each state at each place, given the whole sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.states)
        for batch in batches:
            for seq, held in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                a, b, z = forward_backward(model.scores([r["symbol"] for r in held]), model.start, model.move)
                n = len(held)
                yield pa.RecordBatch.from_arrays([pa.array([seq.as_py()] * (n * k), pa.int64()), pa.array(np.repeat([r["t"] for r in held], k), pa.int64()), pa.array(model.states * n), pa.array(np.exp(a + b - z).ravel())], ["seq", "t", "state", "p"])

    return _gathered(rows, "symbol").mapInArrow(run, f"seq long, t long, state {kind}, p double")


class Chain:
    """A linear-chain CRF: weights of (hashed feature, state) and (state, state)."""

    def __init__(self, states: list, buckets: int):
        self.states, self.buckets = states, buckets
        self.size = (buckets + len(states) + 1) * len(states)

    def split(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = len(self.states)
        return w[: self.buckets * k].reshape(self.buckets, k), w[self.buckets * k : (self.buckets + k) * k].reshape(k, k), w[(self.buckets + k) * k :]

    def emit(self, w: np.ndarray, features: list[list[int]]) -> np.ndarray:
        return np.stack([self.split(w)[0][f].sum(0) for f in features])

    def gradient(self, w: np.ndarray, features: list[list[int]], states: list[int]) -> tuple[float, np.ndarray]:
        """Log likelihood of one sequence's states and its gradient."""
        unary, move, start = self.split(w)
        e = self.emit(w, features)
        a, b, z = forward_backward(e, start, move)
        p, g = np.exp(a + b - z), np.zeros_like(w)
        gu, gm, gs = self.split(g)
        right = float(start[states[0]] + e[np.arange(len(states)), states].sum() + sum(move[x, y] for x, y in zip(states, states[1:], strict=False)))
        hit = np.zeros_like(p)
        hit[np.arange(len(states)), states] = 1
        for t, f in enumerate(features):
            np.add.at(gu, f, hit[t] - p[t])
        gs += hit[0] - p[0]
        for t in range(1, len(states)):
            gm[states[t - 1], states[t]] += 1
            gm -= np.exp(a[t - 1][:, None] + move + (e[t] + b[t])[None, :] - z)
        return right - z, g


def fit_chain(rows: DataFrame, buckets: int = 1 << 12, rounds: int = 30, rate: float = 0.5, prior: float = 10.0) -> tuple[Chain, np.ndarray, list[float]]:
    """A CRF of (seq, t, state, features: array of strings), by AdaGrad steps on the log likelihood of all sequences.

    Each round sums likelihood and gradient over the sequences in their tasks: the driver gets one vector a partition,
    of fixed size. Features are hashed into `buckets`, so different ones may share a weight.
    """
    states = sorted(r[0] for r in rows.select("state").distinct().collect())
    at = {s: i for i, s in enumerate(states)}
    chain = Chain(states, buckets)
    hashed = rows.withColumn("f", F.transform("features", lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int")))
    held = _gathered(hashed, "state", "f").persist()
    w, squares, seen = np.zeros(chain.size), np.full(chain.size, 1e-8), []
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], w: np.ndarray = w) -> Iterator[pa.RecordBatch]:
            total, g, n = 0.0, np.zeros(chain.size), 0
            for batch in batches:
                for found in batch.column(0).to_pylist():
                    x, d = chain.gradient(w, [r["f"] for r in found], [at[r["state"]] for r in found])
                    total, g, n = total + x, g + d, n + 1
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([n]), pa.array([g.tobytes()], pa.binary())], ["ll", "n", "g"])

        parts = held.select("rows").mapInArrow(run, "ll double, n long, g binary").collect()
        n = max(1, sum(p["n"] for p in parts))
        g = (sum(np.frombuffer(p["g"], np.float64) for p in parts) - w / prior) / n
        seen.append(sum(p["ll"] for p in parts))
        squares = squares + g * g
        w = w + rate * g / np.sqrt(squares)
    held.unpersist()
    return chain, w, seen


def chain_paths(rows: DataFrame, chain: Chain, w: np.ndarray, kind: str = "string") -> DataFrame:
    """(seq, t, state): the best states of (seq, t, features)."""
    _, move, start = chain.split(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seq, held in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                path, _ = viterbi(chain.emit(w, [r["f"] for r in held]), start, move)
                yield pa.RecordBatch.from_arrays([pa.array([seq.as_py()] * len(held), pa.int64()), pa.array([r["t"] for r in held], pa.int64()), pa.array([chain.states[s] for s in path])], ["seq", "t", "state"])

    hashed = rows.withColumn("f", F.transform("features", lambda x: F.pmod(F.xxhash64(x), F.lit(chain.buckets)).cast("int")))
    return _gathered(hashed, "f").mapInArrow(run, f"seq long, t long, state {kind}")
