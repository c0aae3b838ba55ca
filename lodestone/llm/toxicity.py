"""Toxicity: a convolutional text classifier over hashed word embeddings.

Each word (cut at white space, A-Z lowered, punctuation around it dropped) is embedded as the sum of the vectors
of its hash and of the hashes of its first 3 to 7 bytes, so that unseen inflections of a known stem still score.
Filters of several widths run over the sequence, the greatest response of each filter over the whole text is
kept, and a logistic layer scores these. All of it is trained here, in numpy, by Adam on log loss from a bounded
sample of labelled rows (`TRAIN_ROWS`, half of each label where there are enough, chosen by a hash of the id);
whole texts are used for training and scoring. Half of what the true label shares ask for is added to the
logit, between the balanced sample's scores and calibrated ones: full calibration loses recall at the cut, none precision. Thresholds are calibrated per language on all clean labelled rows that were not fitted on (a fifth of
the sample, by a hash of the id, and all rows outside it): the lowest score from `CUT` up at which the language's false positives
stay within `MAX_FALSE`; the language picks the threshold, never enters the score. One rule holds for any number of rows: a language's
false positives are counted together with 1 / `MAX_FALSE` rows that behave like all languages' rows do, and those of all
languages with as many of which `MAX_FALSE` are false at every threshold. So few rows move a threshold little, no rows not at all.

Defined results: null and empty texts are one padding word; without labelled rows of both kinds every score is
the share of label 1 (0.5 without rows); null labels are left out; an unknown language takes the common threshold;
rows that share an id are scored each and are one row of the sample (that with the least text); of labels that
contradict each other the greater holds; an empty table gives no rows; own columns called like a result's keep their
values in `clean`. Training holds the sample's whole texts in one task, scoring one text at a time in a worker.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import textops as tx

TRAIN_ROWS = 4000
BUCKETS = 1 << 15
DIM = 8
FILTERS = {1: 16, 2: 8, 3: 8}
PREFIXES = (3, 4, 5, 6, 7)
DROPPED = 0.4
STEPS = 500  # at least, on small samples
MAX_FALSE = 0.005
GRAIN = 10_000  # thresholds are multiples of 1 / GRAIN
CUT = 0.7
_EDGE = np.zeros(256, bool)
_EDGE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket numbers of shape words x features, words per text); an empty text gets one padding word."""
    starts, ends, rows = tx.word_spans(data, offsets)
    for _ in range(3):  # punctuation at either end, never the whole word
        longer = ends - starts > 1
        starts = starts + (longer & _EDGE[data[starts]]) if len(starts) else starts
        longer = ends - starts > 1
        ends = ends - (longer & _EDGE[data[ends - 1]]) if len(ends) else ends
    spans = [(starts, ends), *((starts, np.minimum(ends, starts + k)) for k in PREFIXES)]
    found = [h + np.uint64(k) for h, k in zip(tx.span_hashes(data, starts, ends, spans, lower=True), (0, *PREFIXES), strict=True)]
    x = np.stack([tx.mix(f) % np.uint64(BUCKETS - 1) + np.uint64(1) for f in found], 1).astype(np.int32)
    none = rows == 0
    if none.any():
        x = np.insert(x, np.cumsum(rows)[none], 0, axis=0)
        rows = rows + none
    return x, rows


class Network:
    """Embedding, convolutions, max pooling over each text, logistic layer."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {"emb": r.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)}
        self.p["emb"][0] = 0
        for width, n in FILTERS.items():
            self.p[f"w{width}"] = r.normal(0, (width * DIM) ** -0.5, (width, DIM, n)).astype(np.float32)
            self.p[f"b{width}"] = np.zeros(n, np.float32)
        self.p["out"] = r.normal(0, 0.1, sum(FILTERS.values())).astype(np.float32)
        self.p["bias"] = np.zeros(1, np.float32)
        self.shift = 0.0
        self.constant: float | None = None

    def _pool(self, e: np.ndarray, rows: np.ndarray, places: bool) -> tuple[np.ndarray, dict]:
        first = np.cumsum(rows) - rows
        last = np.repeat(first + rows, rows)  # windows stop at their text's end: what lies beyond counts as zero
        pooled, where = [], {}
        for width, n in FILTERS.items():
            y = np.broadcast_to(self.p[f"b{width}"], (len(e), n)).copy()
            for k in range(width):
                part = e[k:] @ self.p[f"w{width}"][k]
                if k:
                    part[np.arange(k, len(e)) >= last[: len(e) - k]] = 0
                y[: len(e) - k] += part
            top = np.maximum.reduceat(y, first, axis=0)
            pooled.append(top)
            if places:
                at = np.full((len(rows), n), -1)
                hit_row, hit_col = np.nonzero(y == np.repeat(top, rows, axis=0))
                at[np.repeat(np.arange(len(rows)), rows)[hit_row], hit_col] = hit_row
                where[width] = at
        return np.maximum(np.concatenate(pooled, 1), 0), where

    def logits(self, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        emb = self.p["emb"]
        e = emb[x[:, 0]]
        for k in range(1, x.shape[1]):
            e += emb[x[:, k]]
        return self._pool(e, rows, False)[0] @ self.p["out"] + self.p["bias"][0] + self.shift

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        out = [np.zeros(0)]
        for a, b in tx.chunks(offsets, 1 << 20):
            out.append(self.logits(*encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])))
        return 1 / (1 + np.exp(-np.clip(np.concatenate(out).astype(np.float64), -30, 30)))

    def fit(self, texts: list[bytes], labels: np.ndarray, share: float, epochs: int | None = None, seed: int = 7) -> Network:
        """Adam on batches of whole texts; only the places that won the pooling pass gradients on."""
        epochs = epochs or int(np.clip(-(-STEPS * 64 // max(1, len(texts))), 10, 60))
        r = np.random.default_rng(seed)
        codes = [encode(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
        state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = r.permutation(len(codes))
            for at in range(0, len(order), 64):
                pick = order[at : at + 64]
                x, rows = np.concatenate([codes[i] for i in pick]), np.array([len(codes[i]) for i in pick])
                x = np.where(r.random(x.shape) < DROPPED, 0, x)  # no single feature may carry a word
                e = self.p["emb"][x].sum(1) / (1 - DROPPED)
                pooled, where = self._pool(e, rows, True)
                z = pooled @ self.p["out"] + self.p["bias"][0]
                g = ((1 / (1 + np.exp(-z)) - labels[pick]) / len(pick)).astype(np.float32)
                grads = {"out": pooled.T @ g, "bias": np.array([g.sum()], np.float32)}
                back = (g[:, None] * self.p["out"]) * (pooled > 0)
                touched, inner, c = [], [], 0
                for width, n in FILTERS.items():
                    d, at_ = back[:, c : c + n], where[width]
                    c += n
                    grads[f"b{width}"] = d.sum(0)
                    gw = np.zeros_like(self.p[f"w{width}"])
                    doc, col = np.nonzero(d)
                    for k in range(width):
                        place = at_[doc, col] + k
                        inside = place < (np.cumsum(rows))[doc]
                        pl, dd, cc = place[inside], d[doc, col][inside], col[inside]
                        np.add.at(gw[k].T, cc, dd[:, None] * e[pl])
                        touched.append(pl)
                        inner.append(dd[:, None] * self.p[f"w{width}"][k][:, cc].T)
                    grads[f"w{width}"] = gw
                step += 1
                rate = 0.01 * (1 - epoch / epochs) + 0.001
                for k, gr in grads.items():
                    m, v = state[k]
                    gr = gr + 1e-4 * self.p[k] if k != "bias" else gr
                    m += 0.1 * (gr - m)
                    v += 0.01 * (gr * gr - v)
                    self.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
                at_, gi = np.concatenate(touched), np.concatenate(inner)
                ids = x[at_].ravel()
                use, inv = np.unique(ids, return_inverse=True)
                ge = np.zeros((len(use), DIM), np.float32)
                np.add.at(ge, inv, np.repeat(gi, x.shape[1], axis=0))
                m, v = state["emb"]  # only rows that were read move
                m[use] += 0.1 * (ge - m[use])
                v[use] += 0.01 * (ge * ge - v[use])
                self.p["emb"][use] -= rate * m[use] / (np.sqrt(v[use]) + 1e-7)
                self.p["emb"][0] = 0
        balanced = max(1e-6, min(1 - 1e-6, float(labels.mean())))
        self.shift = float(np.log(share / (1 - share)) - np.log(balanced / (1 - balanced))) * 0.5
        return self


def sampled(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> tuple[DataFrame | None, float]:
    """(doc_id, text, label, lang) and the share of label 1 among all: up to limit / 2 rows of each label, by a hash of the id."""
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col("doc_id"), F.col(label).alias("label")).groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return None, 0.5
    picked = None
    for value in (0, 1):  # top-k, not a sort of everything
        some = known.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(limit // 2)
        picked = some if picked is None else picked.unionByName(some)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), lang.alias("lang")).join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "label", "lang")).alias("r"))  # an id is one row of the sample, however often it repeats
    return rows.select("doc_id", "r.text", "r.label", "r.lang"), counts.get(1, 0) / total


def ordered(rows: list[tuple]) -> list[tuple]:
    """(text, label, lang) by id and text."""
    rows = sorted(((r[0], bytes(r[1] or b""), r[2], r[3]) for r in rows), key=lambda r: r[:2])
    return [r[1:] for r in rows]


def _network(docs: DataFrame, labels: DataFrame, limit: int) -> tuple[Network, DataFrame | None]:
    """The network, fitted in one task on the bounded sample, and the ids it was fitted on (None: it is a constant).

    The driver gets the weights only; a lost executor's task starts again and gives the same weights.
    """
    rows, share = sampled(docs, labels, "toxic", limit)
    if rows is None:
        return fitted([], share), None
    used = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(5)) != 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fitted(ordered(held), share).__dict__)], pa.binary())], ["model"])

    found = used.repartition(1).mapInArrow(run, "model binary").collect()
    if not found:
        return fitted([], share), None
    net = Network.__new__(Network)
    net.__dict__.update(pickle.loads(bytes(found[0]["model"])))
    return net, used.select("doc_id").distinct() if net.constant is None else None


def _limits(scored: DataFrame, labels: DataFrame, used: DataFrame | None) -> dict:
    """Thresholds over (doc_id, lang, _score) rows that are labelled clean and weren't fitted on."""
    if used is None:
        return {None: CUT}
    clean = labels.groupBy("doc_id").agg(F.max(F.when(F.col("toxic").isin(0, 1), F.col("toxic"))).alias("label")).filter("label = 0").select("doc_id")
    clean = clean.join(F.broadcast(used), "doc_id", "left_anti")  # at most the sample's rows
    return thresholds(scored.select("doc_id", "lang", "_score").join(clean, "doc_id"))


def _lang(docs: DataFrame) -> Column:
    return (F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")).alias("lang")


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> tuple[Network, dict]:
    """The network and its thresholds by language (None: common)."""
    net, used = _network(docs, labels, limit)
    return net, _limits(score(docs.select("doc_id", "text", _lang(docs)), net, {None: CUT}), labels, used)


def thresholds(clean: DataFrame) -> dict:
    """The thresholds by language (None: common) over the (lang, _score) of all clean rows."""
    count = clean.groupBy("lang", F.floor(F.col("_score") * GRAIN).cast("long").alias("at")).agg(F.count("*").alias("n"))
    count = count.groupBy("lang").agg(F.collect_list(F.struct("at", "n")).alias("c"))  # GRAIN + 1 pairs at most
    counts = {row["lang"]: np.bincount([x["at"] for x in row["c"]], [x["n"] for x in row["c"]], GRAIN + 1) for row in count.toLocalIterator()}
    above = lambda c: np.cumsum(c[::-1])[::-1]  # noqa: E731  rows at or over each threshold
    places = np.arange(GRAIN + 1)

    def lowest(rate: np.ndarray) -> float:
        fine = np.flatnonzero((rate <= MAX_FALSE + 1e-12) & (places >= CUT * GRAIN))
        return float(min(fine[0] / GRAIN, 0.999)) if len(fine) else 0.999

    prior = 1 / MAX_FALSE
    every = sum(counts.values(), np.zeros(GRAIN + 1))
    rate = (above(every) + prior * MAX_FALSE) / (every.sum() + prior)
    return {None: lowest(rate)} | {lang: lowest((above(c) + prior * rate) / (c.sum() + prior)) for lang, c in counts.items() if lang is not None}


def fitted(rows: list[tuple], share: float) -> Network:
    """The network of (text, label, lang) rows."""
    net = Network()
    if len({y for _, y, _ in rows}) < 2:
        net.constant = share
        return net
    return net.fit([r[0] for r in rows], np.array([r[1] for r in rows], np.float32), share)


def _scored(docs: DataFrame, net: Network, limits: dict) -> tuple[DataFrame, str, str]:
    """`docs` with score and flagged, under names that none of its own columns has, and these names."""
    model = docs.sparkSession.sparkContext.broadcast((net.p, net.shift, net.constant))  # of fixed size
    text, score_, flagged = (tx.fresh(docs, x) for x in ("_bytes", "_score", "_flagged"))
    lang = "lang" if "lang" in docs.columns else None

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network.__new__(Network)
        own.p, own.shift, own.constant = model.value
        for batch in batches:
            found = own.scores(*tx.binary_column(batch, text))
            if lang:
                floor = np.array([limits.get(x, limits[None]) for x in batch.column(batch.schema.get_field_index(lang)).to_pylist()])
            else:
                floor = np.full(len(found), limits[None])
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found), pa.array(found >= floor)], [*names, score_, flagged])

    schema = T.StructType([*docs.schema.fields, T.StructField(score_, T.DoubleType()), T.StructField(flagged, T.BooleanType())])
    return docs.select(*tx.own(docs), F.col("text").cast("binary").alias(text)).mapInArrow(keep, schema), score_, flagged


def score(docs: DataFrame, net: Network, limits: dict) -> DataFrame:
    """`docs` with _score and _flagged (at or above its language's threshold), in place of own columns of these names."""
    scored, score_, flagged = _scored(docs, net, limits)
    rest = [c for c in docs.columns if c.lower() not in ("_score", "_flagged")]
    return scored.select(*(scored[f"`{c}`"] for c in rest), F.col(score_).alias("_score"), F.col(flagged).alias("_flagged"))


def _flag(score_: Column, lang: Column, limits: dict) -> Column:
    """Whether a score is at or above its language's threshold."""
    known = [x for k, v in limits.items() if k is not None for x in (F.lit(k), F.lit(v))]
    return score_ >= (F.coalesce(F.create_map(*known)[lang], F.lit(limits[None])) if known else F.lit(limits[None]))


def clean(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """`docs` without the rows that a network trained on `labels` flags, in all its columns: scored once, stored, then cut."""
    net, used = _network(docs, labels, limit)
    scored, score_, flagged = _scored(docs, net, {None: CUT})
    scored = tx.stored(scored.drop(flagged), "scored")
    limits = _limits(scored.select("doc_id", _lang(docs), F.col(score_).alias("_score")), labels, used)
    return scored.filter(~_flag(F.col(score_), _lang(docs), limits)).select(*tx.own(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = tx.documents(spark, sf_dir), tx.read_table(spark, sf_dir, "labels")
    labels = labels.filter(tx.crc_mod("doc_id", 3) != 1)
    net, used = _network(docs, labels, TRAIN_ROWS)
    scored = score(docs.select("doc_id", "text", "lang"), net, {None: CUT}).select("doc_id", "lang", "_score")
    scored = tx.stored(scored, "scores")
    flagged = _flag(F.col("_score"), F.col("lang"), _limits(scored, labels, used))
    return scored.select("doc_id", (tx.crc_mod("doc_id", 3) == 1).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= CUT).cast("int").alias("predicted"), flagged.alias("flagged"))
