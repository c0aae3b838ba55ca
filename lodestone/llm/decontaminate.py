"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words are counted over the whole corpus.
2. A randomised SVD of the benchmark's TF-IDF passages gives the latent space. Products of the passages with a block
   of vectors are made in the passages' tasks and summed by bucket into a stored table; a table is made orthonormal by
   the Gram matrix of its rows, which tasks sum as well. The driver factorises only matrices of RANK + 16 columns and
   rows; the tall ones stay in tables. (Singular values below 1e-6 of the greatest can't be told from zero so.)
3. Every document passage (`WINDOW` words, every `STRIDE` words, whole texts) is projected; pairs of passages with a
   cosine of `COSINE` or more are candidates. Lengths sum the squared weight of each occurrence. Passages whose words
   are hardly known to any item (less than that share of the passage's length) are left at once. The cosine is no
   bound for the rule of step 4, so every (document, item) where enough of the item's words stand near each other for
   the rule to hold (`Gate`) is a candidate too: no leak of step 4 is missed.
4. Each candidate is checked on the words: the longest common subsequence of item and the text around the passage,
   and whether the item's answer (its last sentence) stands there verbatim. A leak has `LCS` of the item's words in
   order, or `LCS_ANSWER` and the answer; items below `SHORT` words must stand there word by word.

Items are handled in blocks of `ITEMS` rows and `ITEM_BYTES` at most (a longer item is a block of its own), which the
tasks read from tables of that bounded size: nothing is broadcast.

Defined results: null and empty texts, items without words and items with a null id match nothing; empty tables give
no rows; a document is reported once per item it leaks, with its best passage; rows that share a doc_id are reported
as one document, items that share an item_id as one item; very long texts are cut into passages like others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import textops as tx

BUCKETS = 1 << 16
RANK = 256
WINDOW, STRIDE = 32, 16
COSINE = 0.45
LCS, LCS_ANSWER, SHORT = 0.75, 0.5, 8
ITEMS, ITEM_BYTES = 4096, 32 << 20
TILE = 4096  # passages of documents, and of items, whose cosines are held at once
_STRIP = b".,;:!?\"'()[]{}"
_STRIPPED = np.zeros(256, bool)
_STRIPPED[list(_STRIP)] = True


def _texts(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.col("text").cast("binary").alias("text"))


def _buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each word, words per text)."""
    starts, ends, rows = tx.word_spans(data, offsets)
    return (tx.word_hashes(data, starts, ends, lower=True) & np.uint64(BUCKETS - 1)).astype(np.int32), rows


def _sums(blobs: DataFrame, kind: str) -> np.ndarray | None:
    """Add up arrays of one fixed size, first in groups, then together."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total = np.frombuffer(x, kind) if total is None else total + np.frombuffer(x, kind)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["x"])

    rows = blobs.repartition(16).mapInArrow(add, "x binary").repartition(1).mapInArrow(add, "x binary").collect()
    return np.frombuffer(rows[0][0], kind) if rows else None


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """log((1 + documents) / (1 + documents with the bucket)) for each bucket, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            data, offsets = tx.binary_column(batch, "text")
            total[BUCKETS] += len(offsets) - 1
            for a, b in tx.chunks(offsets):
                bucket, rows = _buckets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                each = np.unique(np.repeat(np.arange(len(rows)), rows) * BUCKETS + bucket)
                total[:BUCKETS] += np.bincount(each & (BUCKETS - 1), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["x"])

    total = _sums(_texts(docs, "doc_id").mapInArrow(run, "x binary"), "<i8")
    total = np.zeros(BUCKETS + 1) if total is None else total
    return np.log((1 + total[BUCKETS]) / (1 + total[:BUCKETS])).astype(np.float32) + 0.01


def passages(text: bytes | None) -> list[np.ndarray]:
    """The bucket numbers of an item's passages: the whole item, or windows where it is much longer than one."""
    data = np.frombuffer(text or b"", np.uint8)
    bucket, _ = _buckets(data, np.array([0, len(data)]))
    if not len(bucket):
        return []
    if len(bucket) <= WINDOW + STRIDE:
        return [bucket]
    return [bucket[a : a + WINDOW] for a in range(0, len(bucket) - STRIDE, STRIDE)]


def _vectors(path: str) -> tuple[np.ndarray, np.ndarray]:
    """A stored table (bucket, vector): buckets in order, a row for each."""
    rows = tx.read_folder(path)
    bucket = rows["bucket"].to_numpy()
    order = np.argsort(bucket)
    vectors = np.frombuffer(b"".join(rows["vector"].to_pylist()), np.float64)
    return bucket[order], vectors.reshape(len(bucket), -1)[order]


def _rows(bucket: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(bucket), 1000):
        part = vectors[at : at + 1000]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[at : at + 1000], pa.int32()), pa.array([x.tobytes() for x in part], pa.binary())], ["bucket", "vector"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors of each bucket added up."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for bucket, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(vector, np.float64)
            total[bucket] = total[bucket] + x if bucket in total else x
    if total:
        yield from _rows(np.array(list(total)), np.stack(list(total.values())))


def _inverse_root(gram: np.ndarray) -> np.ndarray:
    """What makes the rows' columns orthonormal; directions without length are left out."""
    value, vector = np.linalg.eigh(gram)
    some = value > 1e-12 * max(value[-1], 1e-300)
    return vector[:, some] / np.sqrt(value[some])


def latent_space(items: DataFrame, idf: np.ndarray, rank: int = RANK, powers: int = 2, seed: int = 3) -> tuple[str, np.ndarray] | None:
    """Right singular vectors of the TF-IDF passages of items (id, text): a stored table (bucket, vector) and what its rows are multiplied by.

    Only rows of buckets that occur in the items are made. None: no item has words.
    """
    width = rank + 16
    spark = items.sparkSession

    def basis(path: str | None, turn: np.ndarray | None, used: np.ndarray) -> np.ndarray:
        if path is None:  # probes: the same for a bucket in every task
            return np.stack([np.random.default_rng([seed, int(u)]).normal(size=width) for u in used])
        known, rows = _vectors(path)
        return rows[np.searchsorted(known, used)] @ turn

    def over_passages(path: str | None, turn: np.ndarray | None, square: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = [np.unique(p, return_counts=True) for batch in batches for text in batch.column(1).to_pylist() for p in passages(text)]
            if not own:
                return
            used = np.unique(np.concatenate([u for u, _ in own]))
            q = basis(path, turn, used)
            total = np.zeros((q.shape[1], q.shape[1])) if square else np.zeros_like(q)
            for use, n in own:
                x = n * idf[use]
                x = x / (np.linalg.norm(x) or 1)
                at = np.searchsorted(used, use)
                y = x @ q[at]
                if square:
                    total += np.outer(y, y)
                else:
                    total[at] += np.outer(x, y)
            if square:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["x"])
            else:
                yield from _rows(used, total)

        return run

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(batch.num_rows, -1)
            total[: rows.shape[1], : rows.shape[1]] += rows.T @ rows
            size = rows.shape[1]
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total[:size, :size].tobytes()], pa.binary())], ["x"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = turn = None
    for _ in range(powers):  # the table holds Z = A'(A Q), Q being the table before times its turn
        path = tx.store(items.mapInArrow(over_passages(path, turn, False), "bucket int, vector binary").repartition(min(n, 64), "bucket").mapInArrow(_summed, "bucket int, vector binary"), "latent")
        square = _sums(spark.read.parquet(path).mapInArrow(gram, "x binary"), "<f8")
        if square is None:
            return None
        side = int(len(square) ** 0.5)
        turn = _inverse_root(square.reshape(side, side))
    # in the basis Q, A'A is (A Q)'(A Q): its leading eigenvectors are the right singular vectors
    inner = _sums(items.mapInArrow(over_passages(path, turn, True), "x binary"), "<f8").reshape(turn.shape[1], turn.shape[1])
    value, vector = np.linalg.eigh(inner)
    keep = np.argsort(value)[::-1][: min(rank, int((value > 1e-9).sum()) or 1)]
    return path, (turn @ vector[:, keep]).astype(np.float32)


def lcs(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, a bit per word of `a`."""
    places: dict[bytes, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        both = row & places.get(w, 0)
        row = (row + both | row - both) & full
    return len(a) - row.bit_count()


def _words(text: bytes | None) -> list[bytes]:
    return [w.strip(_STRIP) or w for w in tx.lowered(text).split()]


def _answer(text: bytes) -> list[bytes]:
    """The last sentence of at least three words."""
    parts = [_words(p) for p in re.split(rb"(?<=[.!?])\s+|\n", text)]
    parts = [p for p in parts if len(p) >= 3]
    return parts[-1] if len(parts) > 1 else []


def _contains(words: list[bytes], part: list[bytes]) -> bool:
    return bool(part) and b" " + b" ".join(part) + b" " in b" " + b" ".join(words) + b" "


class Item:
    """A benchmark item's words, ready for the word checks."""

    def __init__(self, text: bytes):
        self.words, self.answer = _words(text), _answer(text)

    def check(self, around: list[bytes]) -> tuple[float, bool, bool]:
        """(share of the item's words found in order, answer found, leak)."""
        if len(self.words) < SHORT:
            found = _contains(around, self.words)
            return float(found), found, found
        present = set(around)
        if sum(w in present for w in self.words) < LCS_ANSWER * len(self.words):  # bounds the common subsequence
            return 0.0, False, False
        share, answer = lcs(self.words, around) / len(self.words), _contains(around, self.answer)
        return share, answer, share >= LCS or share >= LCS_ANSWER and answer


def _hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each word, hash of each word as `_words` cuts it, words per text)."""
    starts, ends, rows = tx.word_spans(data, offsets)
    a, b = starts.copy(), ends.copy()
    for at, step in ((a, 1), (b, -1)):
        todo = np.flatnonzero(a < b)
        while len(todo):
            todo = todo[_STRIPPED[data[at[todo] - (step < 0)]]]
            at[todo] += step
            todo = todo[a[todo] < b[todo]]
    none = a >= b
    a[none], b[none] = starts[none], ends[none]
    whole, cut = tx.span_hashes(data, starts, ends, [(starts, ends), (a, b)], lower=True)
    return (whole & np.uint64(BUCKETS - 1)).astype(np.int32), cut, rows


class Gate:
    """Finds the stretches of text in which an item's words are many enough for its check to succeed.

    A stretch is twice as long as the longest text that is held against an item, and begins that length after the
    one before: each such text lies in the stretch it begins in. In it, the words of the item that occur bound the
    common subsequence, and the answer's distinct words must all occur.
    """

    def __init__(self, items: list[Item]):
        self.span = max(2 * len(x.words) for x in items) + WINDOW
        n = np.array([len(x.words) for x in items])
        self.size, self.short = n, n < SHORT
        joined = b" ".join(w for x in items for w in x.words)
        data = np.frombuffer(joined, np.uint8)
        starts, ends, _ = tx.word_spans(data, np.array([0, len(data)]))
        hashes, owner = tx.word_hashes(data, starts, ends, lower=True), np.repeat(np.arange(len(items)), n)
        answer = np.array([w in part for x in items for part in (set(x.answer),) for w in x.words], bool)
        self.vocabulary, word = np.unique(hashes, return_inverse=True)
        pair, place = np.unique(word * len(items) + owner, return_inverse=True)
        self.owner, self.count = pair % len(items), np.bincount(place)
        self.answers = np.bincount(place, answer) > 0
        self.first = np.searchsorted(pair // len(items), np.arange(len(self.vocabulary) + 1))
        self.answer = np.bincount(self.owner, self.answers, len(items)).astype(np.int64)

    def found(self, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, number of the stretch, item), from the words' hashes and the words of each text."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = np.flatnonzero(self.vocabulary[at] == hashes)
        stretches = -(-rows // self.span)
        base, of = np.cumsum(stretches) - stretches, np.repeat(np.arange(len(rows)), rows)[known]
        number = (known - (np.cumsum(rows) - rows)[of]) // self.span
        own = base[of] + number
        also = number > 0
        key = np.unique(np.concatenate([own, own[also] - 1]) * len(self.vocabulary) + np.concatenate([at[known], at[known][also]]))
        word, stretch = key % len(self.vocabulary), key // len(self.vocabulary)
        many = self.first[word + 1] - self.first[word]
        place = np.repeat(self.first[word] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        cell, shape = np.repeat(stretch, many) * len(self.size) + self.owner[place], (int(stretches.sum()), len(self.size))
        count = np.bincount(cell, self.count[place], shape[0] * shape[1]).reshape(shape)
        answered = np.bincount(cell, self.answers[place], shape[0] * shape[1]).reshape(shape) >= np.maximum(self.answer, 1)
        enough = np.where(self.short, count >= self.size, (count >= LCS * self.size) | (count >= LCS_ANSWER * self.size) & answered)
        i, j = np.nonzero(enough)
        text = np.searchsorted(base, i, "right") - 1
        return text, i - base[text], j


class Search:
    """A block of items, their passages in the latent space, and the word checks."""

    def __init__(self, items: str, latent: str, turn: np.ndarray, idf: np.ndarray):
        held = tx.read_folder(items)
        rows = sorted(zip(held["id"].to_pylist(), held["text"].to_pylist(), strict=True))
        self.ids = [i for i, _ in rows]
        self.checks = [Item(t) for _, t in rows]
        known, space = _vectors(latent)
        weighted = (space @ turn).astype(np.float32) * idf[known, None]
        vectors, owner = [np.zeros((0, turn.shape[1]), np.float32)], []
        for i, (_, text) in enumerate(rows):
            for p in passages(text):
                v = weighted[np.searchsorted(known, p)].sum(0)
                n = np.linalg.norm(v)
                if n > 0:  # divided by what the space keeps of the passage: an exact copy has cosine one
                    vectors.append(v[None] / n * (np.sqrt((idf[p] ** 2).sum()) / n))
                    owner.append(i)
        self.vectors, self.owner = np.concatenate(vectors), np.array(owner, np.int64)
        self.table = np.concatenate([weighted, np.zeros((1, weighted.shape[1]), np.float32)])
        self.number = np.full(BUCKETS, -1, np.int32)
        self.number[known] = np.arange(len(known))
        self.power = idf**2
        self.worded = np.flatnonzero([bool(x.words) for x in self.checks])
        self.gate = Gate([self.checks[i] for i in self.worded]) if len(self.worded) else None

    def found(self, part: np.ndarray, off: np.ndarray, only_candidates: bool) -> Iterator[tuple]:
        """(text, item, cosine, share, answer, latent) of the texts that leak an item; `latent`: the latent search proposed it."""
        table, power, vectors, owner, checks = self.table, self.power, self.vectors, self.owner, self.checks
        bucket, stripped, size = _hashed(part, off)
        blocks = -(-size // STRIDE)
        if not blocks.sum() or self.gate is None:
            return
        of = np.repeat(np.arange(len(size)), blocks)
        first = np.cumsum(size) - size
        start = first[of] + (np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * STRIDE
        where = self.number[bucket]
        norm = np.add.reduceat(power[bucket], start)
        known = np.add.reduceat(np.where(where >= 0, power[bucket], 0), start)
        follows = np.append(of[1:] == of[:-1], False)  # a passage is this block and the next of the same text
        length = np.sqrt(norm + np.append(np.where(follows[:-1], norm[1:], 0), 0))
        both = known + np.append(np.where(follows[:-1], known[1:], 0), 0)
        far = np.flatnonzero(both >= (COSINE * length) ** 2)
        stop = np.append(start[1:], len(bucket))
        stop = np.where(follows, np.append(stop[1:], 0), stop)
        best: dict[tuple[int, int], tuple] = {}
        texts: dict[int, list[bytes]] = {}  # of one document

        def words(doc: int) -> list[bytes]:
            if doc not in texts:
                texts.clear()
                texts[doc] = _words(part[off[doc] : off[doc + 1]].tobytes())
            return texts[doc]

        def keep(doc: int, item: int, cos: float, checked: tuple) -> None:
            if checked[2] and ((doc, item) not in best or best[doc, item][1::-1] < (checked[0], cos)):
                best[doc, item] = (cos, *checked)

        for at in range(0, len(far), TILE):
            pick = far[at : at + TILE]
            sums = np.zeros((len(pick), table.shape[1]), np.float32)
            for k in range(WINDOW):
                place = start[pick] + k
                inside = place < stop[pick]
                word = where[np.minimum(place, len(where) - 1)]
                sums += table[np.where(inside & (word >= 0), word, len(table) - 1)]
            sums /= length[pick, None]
            for low_ in range(0, len(vectors), TILE):  # a tile of cosines, however many passages a block of items has
                cos = sums @ vectors[low_ : low_ + TILE].T
                i, j = np.nonzero(cos >= COSINE)
                for doc, item, low, c in zip(of[pick[i]].tolist(), owner[j + low_].tolist(), (start[pick[i]] - first[of[pick[i]]]).tolist(), cos[i, j].tolist(), strict=True):
                    reach = len(checks[item].words)
                    keep(doc, item, c, (0.0, False, True) if only_candidates else checks[item].check(words(doc)[max(0, low - reach) : low + WINDOW + reach]))
        latent = set(best)
        for doc, stretch, item in () if only_candidates else zip(*(x.tolist() for x in self.gate.found(stripped, size)), strict=True):
            item = int(self.worded[item])
            reach, low = len(checks[item].words), stretch * self.gate.span
            if not checks[item].check(words(doc)[low : low + 2 * self.gate.span])[2]:
                continue
            for at in range(low + reach + -(low + reach) % STRIDE if low else 0, min(low + self.gate.span + reach, int(size[doc])), STRIDE):
                checked = checks[item].check(words(doc)[max(0, at - reach) : at + WINDOW + reach])
                if checked[2]:
                    place = np.arange(first[doc] + at, first[doc] + min(at + WINDOW, int(size[doc])))
                    word = where[place]
                    cos = vectors[owner == item] @ table[np.where(word >= 0, word, len(table) - 1)].sum(0) / np.sqrt(power[bucket[place]].sum())
                    keep(doc, item, float(cos.max(initial=0)), checked)
        for (doc, item), (cos, share, answer, _) in best.items():
            yield doc, self.ids[item], cos, share, answer, (doc, item) in latent


_READY: dict[str, Search] = {}  # of one block of items, kept between a worker's tasks


def _search(docs: DataFrame, items: DataFrame, n_bytes: int, idf: np.ndarray, only_candidates: bool) -> DataFrame:
    schema = "doc_id long, item_id long, cosine double, lcs double, answer boolean, latent boolean"
    path = tx.store(_texts(items, "item_id").filter("id is not null and text is not null").repartition(max(1, n_bytes >> 20)), "items")
    space = latent_space(docs.sparkSession.read.parquet(path), idf)
    if space is None:
        return docs.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _READY:
            _READY.clear()
            _READY[path] = Search(path, *space, idf)
        search = _READY[path]
        for batch in batches:
            data, offsets = tx.binary_column(batch, "text")
            for a, b in tx.chunks(offsets, 1 << 20):
                out = [(a + doc, *x) for doc, *x in search.found(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], only_candidates)]
                if out:
                    c = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(c[0])), pa.array(c[1], pa.int64()), pa.array(c[2], pa.float64()), pa.array(c[3], pa.float64()), pa.array(c[4]), pa.array(c[5])], ["doc_id", "item_id", "cosine", "lcs", "answer", "latent"])

    return _texts(docs, "doc_id").mapInArrow(run, schema)


def leaks(docs: DataFrame, benchmark: DataFrame, only_candidates: bool = False) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer, latent): every document that contains a benchmark item, or a paraphrase; `latent` says
    that the latent search proposed a passage which passed the check, so that the share the gate adds can be read off.

    With `only_candidates`, what the latent search alone proposes.
    """
    idf = inverse_frequencies(docs)
    n, size = benchmark.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-n // ITEMS), -(-(size or 0) // ITEM_BYTES))
    found = None
    for k in range(blocks):
        items = benchmark if blocks == 1 else benchmark.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        part = _search(docs, items, (size or 0) // blocks, idf, only_candidates)
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("lcs", "cosine", "answer")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best, F.max("latent").alias("latent")).select("doc_id", "item_id", "b.cosine", "b.lcs", "b.answer", "latent")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak nothing; rows with a null id stay."""
    bad = leaks(docs, benchmark).select("doc_id").distinct()
    return tx.without(docs, bad)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(tx.documents(spark, sf_dir), tx.read_table(spark, sf_dir, "benchmark"))
