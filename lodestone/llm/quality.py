"""Quality by Bradley-Terry pairwise ranking.

Every text gets a vector of features (shares of byte classes, repetition, word shapes, size). All labelled rows train: they are
dealt to blocks by a hash of the id, and in a block every row stands in `PAIRS` or more preference pairs, drawn between its rows of label 1
and label 0. Weights w minimise the logistic loss on feature differences by Newton steps, of which each adds up gradient and curvature
over the blocks, so P(a preferred to b) = sigmoid(w . (f(a) - f(b))). A document's score is w . f, on which a threshold is set by quantile:
the share of label 0 among the training rows falls below it. `score` maps this to 0..1 by a logistic curve fitted on all of them. The driver
holds sums only, and the few scores next to the threshold; whole texts are read, once, for training and scoring.

Defined results: null and empty texts have features of zero; without rows of both labels every score is the
share of label 1 (0.5 without rows); null labels are left out; rows that share an id are scored each and train
once; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import textops as tx
from lodestone.llm.toxicity import sampled

TRAIN_ROWS = 6000
#: Pairs a training row stands in at least, rows of a block on average, rows of the rarer label there, scores that the driver may sort.
PAIRS, BLOCK, RARER, FEW = 10, 4_000, 50, 10_000
FEATURES = 27
CUT = 0.3


def _classes() -> np.ndarray:
    table = np.zeros((256, 10), np.float32)
    for k, members in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:", b"!?", b"|<>{}[]\\/_=~^", b"%&*$#@+", b"\n\r", b"'\"()-", bytes(range(128, 256)))):
        table[list(members), k] = 1
    return table


_CLASS = _classes().T.copy()


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features per text."""
    n, size = len(offsets) - 1, np.diff(offsets)
    if not len(data):
        return np.zeros((n, FEATURES), np.float32)
    per = np.maximum(size, 1)
    shares = np.stack([np.diff(np.concatenate([[0], np.cumsum(c[data], dtype=np.float64)])[offsets]) / per for c in _CLASS], 1)
    starts, ends, rows = tx.word_spans(data, offsets)
    words = np.maximum(rows, 1)
    of = np.repeat(np.arange(n), rows)
    length = (ends - starts).astype(np.float64)
    sums = lambda x: np.bincount(of, x, n)
    mean = sums(length) / words
    h = tx.word_hashes(data, starts, ends, lower=True)

    def distinct(x: np.ndarray, row: np.ndarray) -> np.ndarray:
        order = np.lexsort((x, row))
        new = np.ones(len(x), bool)
        new[1:] = (x[order][1:] != x[order][:-1]) | (row[order][1:] != row[order][:-1])
        return np.bincount(row, minlength=n), np.bincount(row[order][new], minlength=n)

    ratios = []
    for k in (1, 3):
        x = h
        with np.errstate(over="ignore"):
            for j in range(1, k):
                x = tx.mix(x[:-1] * np.uint64(31) + h[j:])
        row = of[: len(x)]
        inside = row == of[k - 1 :] if len(x) else np.zeros(0, bool)
        total, different = distinct(x[inside], row[inside])
        ratios.append(np.where(total > 0, different / np.maximum(total, 1), 1))
    upper = _CLASS[0]
    last, first = data[ends - 1] if len(ends) else data[:0], data[starts] if len(starts) else data[:0]
    second = data[np.minimum(starts + 1, len(data) - 1)] if len(starts) else data[:0]
    out = [
        shares,
        shares[:, [0, 2, 4, 5, 6]] > 0.02,
        np.stack(
            [
                np.log1p(rows) / 5,
                np.log1p(rows) ** 2 / 25,
                mean / 8,
                np.sqrt(np.maximum(sums(length**2) / words - mean**2, 0)) / 4,
                *ratios,
                sums(upper[first]) / words,
                sums(upper[first] * upper[second]) / words,
                sums(_CLASS[6][last] + _CLASS[5][last]) / words,
                sums(length == 1) / words,
                sums(length > 14) / words,
                rows / np.maximum(np.diff(np.concatenate([[0], np.cumsum(data == 10)])[offsets]) + 1, 1) / 50,
            ],
            1,
        ),
    ]
    return np.nan_to_num(np.concatenate(out, 1).astype(np.float32))


class Ranker:
    """Weights over standardised features and products of them, threshold, and the curve to 0..1."""

    def __init__(self):
        self.constant: float | None = 0.5

    def _expand(self, f: np.ndarray) -> np.ndarray:
        z = np.clip((f - self.mean) / self.scale, -6, 6)
        return np.concatenate([z, np.abs(z), z * z / 6], 1)

    def rank(self, f: np.ndarray) -> np.ndarray:
        return self._expand(f).astype(np.float64) @ self.w

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(0..1, at or above the quantile threshold)."""
        n = len(offsets) - 1
        if self.constant is not None:
            return np.full(n, self.constant), np.ones(n, bool)
        parts = [features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in tx.chunks(offsets, 1 << 20)]
        return self.scored(np.concatenate(parts) if parts else np.zeros((0, FEATURES), np.float32))

    def scored(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.constant is not None:
            return np.full(len(f), self.constant), np.ones(len(f), bool)
        s = self.rank(f)
        return 1 / (1 + np.exp(-np.clip(self.slope * s + self.shift, -30, 30))), s >= self.threshold


def sample_features(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, labels, share of label 1 among all) of a bounded sample, by id, to look at: the driver gets numbers, no texts. Training doesn't use it."""
    rows, share = sampled(docs, labels, "quality", limit)
    if rows is None:
        return np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64), share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.binary_column(batch, "text")
            found = [features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in tx.chunks(offsets, 1 << 20)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), pa.array([x.tobytes() for part in found for x in part], pa.binary())], ["doc_id", "label", "features"])

    found = rows.select(F.col("doc_id").cast("long"), "text", "label").mapInArrow(run, "doc_id long, label int, features binary").toArrow().sort_by("doc_id")  # `limit` rows at most
    return np.frombuffer(b"".join(found["features"].to_pylist()), np.float32).reshape(-1, FEATURES), found["label"].to_numpy(), share


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, features) of every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.binary_column(batch, "text")
            found = [features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in tx.chunks(offsets, 1 << 20)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for part in found for x in part], pa.binary())], ["doc_id", "features"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, features binary")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(-1, FEATURES)


def _added(blocks: DataFrame, work: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of what `work` makes of (block, features, labels)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, f, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([np.asarray(work(k, _matrix([f]), np.frombuffer(y, np.int8)), np.float64).tobytes()], pa.binary())], ["block", "sums"])

    total = None
    for r in sorted(blocks.select("block", "f", "y").mapInArrow(run, "block long, sums binary").toLocalIterator(), key=lambda r: r.block):
        part = np.frombuffer(r.sums)
        total = part if total is None else total + part
    return total


def _pairs(block: int, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of label 1 and of label 0: each in `PAIRS` pairs at least."""
    r, good, bad = np.random.default_rng([5, block]), np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return good[:0], bad[:0]
    n = PAIRS * max(len(good), len(bad))
    return tuple(np.concatenate([r.permutation(x) for _ in range(-(-n // len(x)))])[:n] for x in (good, bad))


def _threshold(blocks: DataFrame, model: Ranker, low: float, high: float, place: int) -> float:
    """The score with `place` smaller ones in order, counted in ever finer cells between `low` and `high`."""
    while True:
        edges = np.linspace(low, high, 4097)

        def work(_: int, f: np.ndarray, y: np.ndarray, edges=edges) -> np.ndarray:
            s = model.rank(f)
            inside = s[(s >= edges[0]) & (s <= edges[-1])]
            return np.concatenate([[(s < edges[0]).sum()], np.bincount(np.minimum(np.searchsorted(edges, inside, "right") - 1, 4095), minlength=4096)])

        seen = np.cumsum(_added(blocks, work))
        cell = int(np.searchsorted(seen, place, "right")) - 1
        low, high = edges[cell], edges[cell + 1]
        if seen[cell + 1] - seen[cell] <= FEW or not low < edges[cell] + (high - low) / 4096 < high:
            break

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.column(0).to_pylist():
                s = model.rank(_matrix([f]))
                last = s <= high if cell == 4095 else s < high
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(s[(s >= low) & last]))], ["s"])

    rows = blocks.select("f").mapInArrow(held, "s double").distinct().orderBy("s").limit(FEW).collect()
    values = np.array([r.s for r in rows])

    def ranks(_: int, f: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.sort(model.rank(f)), values, "right").astype(float)

    return float(values[min(int(np.searchsorted(_added(blocks, ranks), place, "right")), len(values) - 1)])


def fitted(found: DataFrame, labels: DataFrame) -> Ranker:
    """The model of all rows of (doc_id, features) that have a label."""
    known = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    rows = found.join(known, "doc_id").groupBy("doc_id").agg(F.min(F.struct("features", "label")).alias("r")).select("doc_id", "r.*")
    rows = tx.stored(rows, "labelled")
    size = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    model, total = Ranker(), sum(size.values())
    if len(size) < 2:
        every = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
        model.constant = every.get(1, 0) / sum(every.values()) if every else 0.5
        return model
    model.constant, n = None, max(1, min(total // BLOCK, min(size.values()) // RARER))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id")
        return pd.DataFrame({"block": [int(group["block"].iloc[0])], "f": [b"".join(group["features"])], "y": [group["label"].to_numpy(np.int8).tobytes()]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(n)))
    blocks = tx.stored(dealt.groupBy("block").applyInPandas(pack, "block long, f binary, y binary"), "blocks")
    first = _added(blocks, lambda _, f, y: np.concatenate([f.sum(0, dtype=float), (f.astype(float) ** 2).sum(0)]))
    mean = first[:FEATURES] / total
    model.mean, model.scale = mean.astype(np.float32), (np.sqrt(np.maximum(first[FEATURES:] / total - mean**2, 0)) + 1e-3).astype(np.float32)
    wide = 3 * FEATURES

    def pairs(w: np.ndarray) -> np.ndarray:
        def work(k: int, f: np.ndarray, y: np.ndarray) -> np.ndarray:
            z, (a, b) = model._expand(f).astype(np.float64), _pairs(k, y)
            out = np.zeros(2 + wide + wide * wide)
            for at in range(0, len(a), 20_000):
                d = z[a[at : at + 20_000]] - z[b[at : at + 20_000]]
                s = d @ w
                p = 1 / (1 + np.exp(np.clip(s, -500, 500)))
                out += np.concatenate([[len(d), np.logaddexp(0, -s).sum()], -(d * p[:, None]).sum(0), ((d * (p * (1 - p))[:, None]).T @ d).ravel()])
            return out

        x = _added(blocks, work)
        m = max(x[0], 1)
        return np.concatenate([[x[1] / m + 5e-5 * w @ w], x[2 : 2 + wide] / m + 1e-4 * w, (x[2 + wide :].reshape(wide, wide) / m + 1e-4 * np.eye(wide)).ravel()])

    w = np.zeros(wide)
    x, move = pairs(w), np.zeros(wide)
    for _ in range(30):  # Newton steps, halved until the loss falls
        move = np.linalg.solve(x[1 + wide :].reshape(wide, wide), x[1 : 1 + wide])
        gain, step = float(move @ x[1 : 1 + wide]), 1.0
        if gain < 1e-7:
            break
        while (new := pairs(w - step * move))[0] > x[0] - 1e-4 * step * gain and step > 1e-3:
            step /= 2
        w, x = w - step * move, new
    model.w = w

    def spread(_: int, f: np.ndarray, y: np.ndarray) -> np.ndarray:
        s = model.rank(f)
        return np.array([s.sum(), (s * s).sum()])

    ends = blocks.select("f").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([float(g(s)) for s in map(model.rank, (_matrix([f]) for f in b.column(0).to_pylist())) for g in (np.min, np.max)])], ["s"]) for b in batches), "s double").agg(F.min("s").alias("low"), F.max("s").alias("high")).first()
    model.threshold = _threshold(blocks, model, ends.low, ends.high, size[0])
    one, two = _added(blocks, spread) / total
    slope, shift = 1.0 / (np.sqrt(max(two - one * one, 0)) + 1e-9), 0.0
    for _ in range(100):  # logistic curve, by Newton steps

        def curve(_: int, f: np.ndarray, y: np.ndarray, slope=slope, shift=shift) -> np.ndarray:
            s = model.rank(f)
            p = 1 / (1 + np.exp(-np.clip(slope * s + shift, -30, 30)))
            e, q = (y - p) / total, p * (1 - p) / total
            return np.array([(e * s).sum(), e.sum(), (q * s * s).sum(), (q * s).sum(), q.sum()])

        a, b, ss, s1, s0 = _added(blocks, curve)
        move = np.clip(np.linalg.solve([[ss + 1e-6, s1], [s1, s0 + 1e-6]], [a - 1e-6 * slope, b]), -0.5, 0.5)
        slope, shift = slope + move[0], shift + move[1]
        if np.abs(move).max() < 1e-4 * max(1.0, abs(slope)):
            break
    model.slope, model.shift = max(float(slope), 1e-6), float(shift)
    return model


def train(docs: DataFrame, labels: DataFrame) -> Ranker:
    return fitted(featured(docs), labels)


def scores(found: DataFrame, model: Ranker) -> DataFrame:
    """(doc_id, score, kept) of every row of (doc_id, features)."""
    shared = found.sparkSession.sparkContext.broadcast(model.__dict__)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ranker()
        own.__dict__.update(shared.value)
        for batch in batches:
            x, kept = own.scored(_matrix(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.float64()), pa.array(kept)], ["doc_id", "score", "kept"])

    return found.mapInArrow(run, "doc_id long, score double, kept boolean")


def score(docs: DataFrame, model: Ranker) -> DataFrame:
    """(doc_id, score, kept) of every row of (doc_id, text)."""
    return scores(featured(docs), model)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = tx.documents(spark, sf_dir), tx.read_table(spark, sf_dir, "labels")
    found = tx.stored(featured(docs), "features")
    model = fitted(found, labels.filter(tx.crc_mod("doc_id", 5) != 0))
    return scores(found, model).select("doc_id", (tx.crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "kept")
