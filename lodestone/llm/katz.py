"""Language-model scoring: a Katz backoff model of n-grams.

Counts r <= K are discounted by Good-Turing (d_r from counts of counts), larger ones are kept. At every order
P(w | h) = d_r c(h w) / c(h) for n-grams seen in training, else weight(h) P(w | h'), h' being h without its first
word: the recursion ends at the words themselves. weight(h) spreads exactly the mass that the discounts of h have
freed over the words not seen after h. P(w) is the same construction, its freed mass going to one class of unknown
words. A history (or order) whose discounts free nothing gives up 1 / (c + 1), so every probability is above zero and
each distribution sums to one.

The model is a folder of tables, each partitioned by `part` and sorted by its key:

    words       word (64-bit hash), number, n
    ngrams<k>   context, word, n, lower (the probability one order below)
    contexts<k> context, total, kept (what multiplies discounted counts), weight (of the order below)

A context of order k is the number of the n-gram of order k - 1 that stands before the word; 0 is the start of a text.

Texts become blocks of local word numbers. Words are dealt out by hash: each word's partition counts it and answers
every block with the word's number and count. N-grams are dealt out by context, each block sending an n-gram once, at
the highest order with all its documents. A partition folds its requests batch by batch into the tables, then reads
its part of the tables and answers each request with log probabilities summed per document (below the highest order:
with numbers and probabilities, from which the blocks ask the next order). Contexts with over half a partition's share
of the tokens are dealt out by n-gram instead; their totals are added up by a query and read as a table. The number of
partitions follows the bytes of text, so that one partition's share stays the same at every size.

Defined results: null and empty texts are one end token; with no training text every token is unknown and has
probability one; an empty table gives no rows; rows that share a doc_id are scored separately; words are told apart by
64-bit hashes; very long texts are one block; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyspark import RDD, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import textops as tx

K = 5
ORDER = 2
BLOCK_BYTES = 8 << 20
PART_BYTES = 16 << 20
FOLD = 2_000_000
END = 0x1D8E4E27C47D124F
NO_ID = -(1 << 63)
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
SORTED = ("context", "word", "number")
_COUNTS = [f"n{r}" for r in range(1, K + 1)]


def _pack(x: np.ndarray) -> bytes:
    """Bytes of the same significance lie together, which compresses small numbers well."""
    x = np.ascontiguousarray(x)
    return x.dtype.str.encode() + b":" + zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() if len(x) else b"")


def _unpack(b: bytes) -> np.ndarray:
    kind, _, data = b.partition(b":")
    kind = np.dtype(kind.decode())
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8) if data else np.zeros(0, np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel() if len(raw) else np.zeros(0, kind)


def _small(x: np.ndarray) -> bytes:
    """Packed whole numbers, in four bytes each where they fit."""
    return _pack(x.astype(np.uint32 if not len(x) or x.max() < 1 << 32 else np.uint64))


def _by_key(key: int) -> int:
    return key


def _slices(sorted_parts: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    cut = np.searchsorted(sorted_parts, np.arange(n + 1))
    return ((p, int(a), int(b)) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a)


def _shifted(x: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
    """The value before each place, `start` at the first of each text."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[first] = start
    return out


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def write_part(folder: str, table: str, part: int, columns: dict[str, np.ndarray]) -> None:
    """One partition of a table; a repeated task leaves one whole file."""
    store, at = tx.file_system(folder)
    place = f"{at}/{table}/part={part}"
    store.create_dir(place, recursive=True)
    own = f"{place}/.{uuid.uuid4().hex}"
    try:
        with store.open_output_stream(own) as out:
            pq.write_table(pa.table(columns), out, compression="zstd", use_dictionary=[x for x in columns if x not in SORTED], column_encoding={x: "DELTA_BINARY_PACKED" for x in columns if x in SORTED})
        store.move(own, f"{place}/rows.parquet")
    except BaseException:
        store.delete_file(own)
        raise


def read_part(folder: str, table: str, part: int) -> dict[str, np.ndarray]:
    store, at = tx.file_system(folder)
    with store.open_input_file(f"{at}/{table}/part={part}/rows.parquet") as f:
        rows = pq.ParquetFile(f).read()
    return {name: rows[name].to_numpy() for name in rows.column_names}


def read_whole(path: str) -> dict[str, np.ndarray]:
    rows = tx.read_folder(path)
    return {name: rows[name].to_numpy() for name in rows.column_names}


def discounts(counts_of: np.ndarray, k: int = K) -> np.ndarray:
    """d_0 .. d_k from counts of counts n_1 .. n_{k+1}; what Good-Turing can't give is left undiscounted."""
    d = np.ones(k + 1)
    n = np.concatenate([[0], counts_of]).astype(float)
    if n[1] > 0:
        common = (k + 1) * n[k + 1] / n[1]
        for r in range(1, k + 1):
            if n[r] > 0 and n[r + 1] > 0 and common < 1:
                x = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
                if 0 < x < 1:
                    d[r] = x
    return d


def kept_counts(d: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    return c * np.where(c <= K, d[np.minimum(c, K)], 1.0)


class Unigrams:
    def __init__(self, n: int, by_count: np.ndarray, d: np.ndarray):
        """by_count: n_1 .. n_K, as the mass freed follows from them."""
        self.d, self.n = d, n
        freed = float(sum((1 - d[r]) * r * by_count[r - 1] for r in range(1, K + 1)))
        self.scale = 1.0
        if n == 0:
            self.unknown = 1.0
        elif freed <= 0:
            self.scale, self.unknown = n / (n + 1), 1 / (n + 1)
        else:
            self.unknown = freed / n

    def __call__(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.scale * kept_counts(self.d, c) / max(1, self.n), self.unknown)


def _blocks(folds: int, held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = tx.binary_column(batch, "text")
            ids = batch.column(0)
            numbers = ids.fill_null(NO_ID).to_numpy()
            train = np.array([tx.crc("" if i is None else i) % folds != held for i in ids.to_pylist()], bool)
            for a, b in tx.chunks(offsets, BLOCK_BYTES):
                found, size = [], []
                for c, d in tx.chunks(offsets[a : b + 1]):
                    off = offsets[a + c : a + d + 1]
                    piece = data[off[0] : off[-1]]
                    starts, ends, rows = tx.word_spans(piece, off - off[0])
                    h = tx.word_hashes(piece, starts, ends, lower=True)
                    found.append(np.insert(h, np.cumsum(rows), np.uint64(END)))
                    size.append(rows + 1)
                h, rows = np.concatenate(found), np.concatenate(size)
                vocabulary, local = np.unique(h, return_inverse=True)
                counts = np.bincount(local[np.repeat(train[a:b], rows)], minlength=len(vocabulary))
                block = (part << 24) + seq
                seq += 1
                row = [_pack(numbers[a:b]), _pack(train[a:b].astype(np.uint8)), _pack(rows.astype(np.uint32)), _pack(vocabulary), _pack(counts.astype(np.uint32)), _pack(local.astype(np.uint32))]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([x], pa.binary()) for x in row)], ["block", "ids", "train", "rows", "vocabulary", "counts", "stream"])

    return run


def _gathered(rows: Iterable) -> Iterator[tuple[int, tuple, dict[int, list]]]:
    """Each block with the answers it got, by order and part."""
    held: dict[int, list] = defaultdict(lambda: [None, defaultdict(list)])
    for _, (kind, block, row) in rows:
        if kind == "block":
            held[block][0] = row
        else:
            held[block][1][kind].append(row)
    for block in sorted(held):
        row, given = held.pop(block)
        for some in given.values():
            some.sort(key=lambda x: x[0])  # always in the same order
        yield block, row, given


def _numbers(given: list[tuple], parts: int) -> np.ndarray:
    """The numbers that the answers of one order give to the block's entries."""
    return np.concatenate([np.cumsum(_unpack(row[1]).astype(np.int64)) * parts + row[0] + 1 for row in given])


class _Places:
    """Every token of a block with its context, at one order after the other."""

    def __init__(self, row: tuple, given: dict[int, list], parts: int, crowd: float):
        self.parts, self.crowd = parts, crowd
        self.train, self.size, local = _unpack(row[1]).astype(bool), _unpack(row[2]).astype(np.int64), _unpack(row[5])
        self.first = np.cumsum(self.size) - self.size
        self.w = _numbers(given[1], parts)[local]
        self.c1 = np.concatenate([_unpack(x[2]) for x in given[1]]).astype(np.int64)[local]
        self.context, self.lower = _shifted(self.w, self.first, 0), self.c1
        self._hot(self.c1)

    def _hot(self, c: np.ndarray) -> None:
        """Contexts that are dealt out by n-gram; as many texts start as there are texts: like a frequent word."""
        self.hot = _shifted((c > self.crowd).astype(np.uint8), self.first, 1).astype(bool)
        mixed = tx.mix(self.context.astype(np.uint64) + np.uint64(1))
        with np.errstate(over="ignore"):
            self.part = (np.where(self.hot, tx.mix(mixed + self.w.astype(np.uint64)), mixed) % np.uint64(self.parts)).astype(np.int64)

    def sort(self, *last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order by part, context and word, where a new n-gram begins in it)."""
        order = np.lexsort((*last, self.w, self.context, self.part))
        return order, _new(self.part[order], self.context[order], self.w[order])

    def up(self, given: list[tuple]) -> None:
        """On to the next order, by what was answered for the n-grams of this one."""
        order, new = self.sort()
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(new) - 1
        c = np.concatenate([_unpack(x[2]) for x in given]).astype(np.int64)[entry]
        self.lower = np.concatenate([_unpack(x[3]) for x in given])[entry]
        self.context = _shifted(_numbers(given, self.parts)[entry], self.first, 0)
        self._hot(c)


class _Request:
    """The n-grams that a block asks one partition for."""

    def __init__(self, row: tuple, order: int, unigrams: Unigrams):
        self.context, self.runs, hot, w, lower, trained = (_unpack(x) for x in row[:6])
        self.runs = self.runs.astype(np.int64)
        self.w, self.n = w.astype(np.int64), trained.astype(np.int64)
        self.context, self.hot = self.context.astype(np.int64), hot.astype(bool)
        self.lower = unigrams(lower.astype(np.int64)) if order == 2 else lower

    def rows(self) -> tuple:
        return np.repeat(self.context, self.runs), self.w, self.n, self.lower, np.repeat(self.hot, self.runs)


def _fold(held: list[tuple]) -> tuple:
    """Rows (context, word, n, lower, hot), each n-gram once, sorted."""
    h, w, n, lower, hot = (np.concatenate(c) for c in zip(*held, strict=True)) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))
    order = np.lexsort((w, h))
    at = np.flatnonzero(_new(h[order], w[order])) if len(h) else order
    return h[order][at], w[order][at], np.add.reduceat(n[order], at) if len(at) else n, lower[order][at], hot[order][at]


def _folded(rows: Iterable, trained: bool) -> tuple:
    held, size, limit = [], 0, FOLD
    for row in rows:
        x = row.rows()
        some = x[2] > 0 if trained else slice(None)
        held.append(tuple(c[some] for c in x))
        size += len(held[-1][0])
        if size > limit:
            held = [_fold(held)]
            size = len(held[0][0])
            limit = max(FOLD, 2 * size)
    return _fold(held)


class _Trained:
    """One partition of an order's tables, ready for look-ups."""

    def __init__(self, folder: str, k: int, part: int, d: np.ndarray, hot: dict[str, np.ndarray], room: int):
        own, self.ngrams, self.d, self.room = read_part(folder, f"sums{k}", part), read_part(folder, f"ngrams{k}", part), d, room
        local = ~own["hot"]
        sums = {x: np.concatenate([own[x][local], hot[x]]) for x in ("context", "total", "seen", *_COUNTS)}
        order = np.argsort(sums["context"], kind="stable")
        sums = {x: v[order] for x, v in sums.items()}
        self.context, self.total = sums["context"], sums["total"].astype(float)
        free = sum((1 - d[r]) * r * sums[f"n{r}"] for r in range(1, K + 1))
        none = free <= 1e-12
        free = np.where(none, self.total / (self.total + 1), free)
        self.kept = np.where(none, self.total / (self.total + 1), 1.0)
        self.weight = free / np.maximum(self.total, 1) / np.maximum(1 - sums["seen"], 1e-300)
        self.key = np.searchsorted(self.context, self.ngrams["context"]) * room + self.ngrams["word"]
        first = np.isin(self.context, own["context"][local]) if part else np.ones(len(self.context), bool)  # hot ones: once
        write_part(folder, f"contexts{k}", part, {"context": self.context[first], "total": sums["total"][first], "kept": self.kept[first], "weight": self.weight[first]})

    def __call__(self, x: _Request) -> np.ndarray:
        """Probability of each n-gram."""
        if not len(self.context):
            return x.lower
        at = np.minimum(np.searchsorted(self.context, x.context), len(self.context) - 1)
        known, at = np.repeat(self.context[at] == x.context, x.runs), np.repeat(at, x.runs)
        key = at * self.room + x.w
        place = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        c = np.where(known & (self.key[place] == key), self.ngrams["n"][place], 0) if len(self.key) else np.zeros(len(key), np.int64)
        return np.where(c > 0, self.kept[at] * kept_counts(self.d, c) / np.maximum(self.total[at], 1), np.where(known, self.weight[at], 1.0) * x.lower)


def score(docs: DataFrame, folds: int = 7, held: int = 2, order: int = ORDER, folder: str | None = None) -> DataFrame:
    """Score every row of (doc_id, text) by a model of the rows whose crc32(doc_id) modulo `folds` isn't `held`.

    `folder` keeps the model's tables (default: a fresh one in the shared folder).
    """
    spark = docs.sparkSession
    folder = folder or tx.scratch(spark, "katz")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    schema = "block long, ids binary, train binary, rows binary, vocabulary binary, counts binary, stream binary"
    blocks = texts.mapInArrow(_blocks(folds, held), schema).rdd.map(lambda r: (hash((r[0] >> 24) * 1_000_003 + (r[0] & 0xFFFFFF)) % parts, ("block", r[0], tuple(bytes(x) for x in r[1:])))).partitionBy(parts, _by_key)

    # words: count them, then answer each block with numbers and counts
    def ask(rows: Iterable) -> Iterator:
        for key, (_, block, row) in rows:
            vocabulary, counts = _unpack(row[3]), _unpack(row[4])
            part = ((vocabulary >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            for p, a, b in _slices(part, parts):
                yield p, (key, block, _pack(vocabulary[a:b]), _pack(counts[a:b]))

    def counted(rows: Iterable) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """The requests, the distinct words, the place of each asked word among them, and their counts."""
        asked = [(key, block, _unpack(v), _unpack(c)) for _, (key, block, v, c) in rows]
        if not asked:
            return [], np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        distinct, place = np.unique(np.concatenate([x[2] for x in asked]), return_inverse=True)
        count = np.bincount(place, np.concatenate([x[3] for x in asked]), len(distinct)).astype(np.int64)
        return [(x[0], x[1], len(x[2])) for x in asked], distinct, place, count

    def word_totals(p: int, rows: Iterable) -> Iterator:
        _, words_, _, c = counted(rows)
        write_part(folder, "words", p, {"word": words_.view(np.int64), "number": np.arange(len(c)) * parts + p + 1, "n": c})
        yield len(c), int(c.sum()), int((c > 0).sum()), np.bincount(np.minimum(c, K + 2), minlength=K + 3)[1 : K + 2]

    words = blocks.mapPartitions(ask).partitionBy(parts, _by_key)
    totals = words.mapPartitionsWithIndex(word_totals).collect()  # a few numbers for each partition
    n, v = sum(t[1] for t in totals), sum(t[2] for t in totals)
    room = (max((t[0] for t in totals), default=0) + 1) * parts + 1
    by_count = np.sum([t[3] for t in totals], axis=0) if totals else np.zeros(K + 1)
    unigrams = Unigrams(n, by_count[:K], discounts(by_count))
    crowd = max(1.0, n / parts / 2)

    def answer(p: int, rows: Iterable) -> Iterator:
        asked, _, place, count = counted(rows)
        at = 0
        for key, block, size in asked:
            own = place[at : at + size]
            at += size
            yield key, (1, block, (p, _small(np.diff(own, prepend=0)), _small(count[own])))

    joined = blocks.union(words.mapPartitionsWithIndex(answer).partitionBy(parts, _by_key))

    # n-grams, order by order: each block deals out its own, once each
    for k in range(2, order + 1):
        top = k == order

        def deal(key: int, rows: Iterable, k: int = k, top: bool = top) -> Iterator:
            for block, row, given in _gathered(rows):
                x = _Places(row, given, parts, crowd)
                for j in range(2, k):
                    x.up(given[j])
                doc = np.repeat(np.arange(len(x.size)), x.size)
                sort, new = x.sort(doc) if top else x.sort()
                part, h, w, doc, hot, lower = x.part[sort], x.context[sort], x.w[sort], doc[sort], x.hot[sort], x.lower[sort]
                at = np.flatnonzero(new)
                trained = np.add.reduceat(x.train[doc].astype(np.int64), at) if len(at) else at
                times = np.diff(at, append=len(new))
                place = np.append(at, len(new))
                for p, a, b in _slices(part[at], parts):
                    one = at[a:b]
                    runs = np.flatnonzero(_new(h[one]))
                    found = [_small(h[one][runs]), _small(np.diff(runs, append=len(one))), _pack(hot[one][runs].astype(np.uint8)), _small(w[one]), _small(lower[one]) if k == 2 else _pack(lower[one]), _small(trained[a:b])]
                    yield p, (key, block, (*found, _small(times[a:b]), _small(doc[place[a] : place[b]])) if top else tuple(found))

        def learn(p: int, rows: Iterable, k: int = k) -> Iterator:
            h, w, c, lower, hot = _folded((_Request(row, k, unigrams) for _, (_, _, row) in rows), True)
            run = np.flatnonzero(_new(h)) if len(h) else np.zeros(0, np.int64)
            add = lambda x: np.add.reduceat(x, run) if len(run) else x[:0]
            write_part(folder, f"ngrams{k}", p, {"context": h, "word": w, "n": c, "lower": lower})
            write_part(folder, f"sums{k}", p, {"context": h[run], "total": add(c), "seen": add(lower), "hot": hot[run], **{x: add((c == r).astype(np.int64)) for r, x in enumerate(_COUNTS, 1)}})
            yield np.bincount(np.minimum(c, K + 2), minlength=K + 3)[1 : K + 2]

        asked = joined.mapPartitionsWithIndex(deal).partitionBy(parts, _by_key)
        counts_of = asked.mapPartitionsWithIndex(learn).treeReduce(lambda a, b: a + b)
        d = discounts(counts_of)
        sums = spark.read.parquet(f"{folder}/sums{k}").filter("hot").groupBy("context")
        sums = sums.agg(F.sum("total").alias("total"), F.sum("seen").alias("seen"), *(F.sum(x).alias(x) for x in _COUNTS))
        sums.coalesce(1).write.mode("overwrite").parquet(f"{folder}/hot{k}")  # two contexts for each partition at most

        def evaluate(p: int, rows: Iterable, k: int = k, d: np.ndarray = d, top: bool = top) -> Iterator:
            model = _Trained(folder, k, p, d, read_whole(f"{folder}/hot{k}"), room)
            if top:
                for _, (key, block, row) in rows:
                    docs_, inverse = np.unique(_unpack(row[7]), return_inverse=True)
                    logs = np.repeat(np.log10(model(_Request(row, k, unigrams))), _unpack(row[6]).astype(np.int64))
                    yield key, (k, block, (p, _pack(docs_), _pack(np.bincount(inverse, logs, len(docs_)))))
                return
            rows = [(key, block, _Request(row, k, unigrams)) for _, (key, block, row) in rows]
            h, w, c, _, _ = _folded((x for _, _, x in rows), False)
            contexts = h[_new(h)] if len(h) else h
            every = np.searchsorted(contexts, h) * room + w
            for key, block, x in rows:
                place = np.searchsorted(every, np.repeat(np.searchsorted(contexts, x.context), x.runs) * room + x.w)
                yield key, (k, block, (p, _small(np.diff(place, prepend=0)), _small(c[place]), _pack(model(x))))

        joined = joined.union(asked.mapPartitionsWithIndex(evaluate).partitionBy(parts, _by_key))

    def finish(rows: Iterable) -> Iterator:
        for _, row, given in _gathered(rows):
            x = _Places(row, given, parts, crowd)
            doc = np.repeat(np.arange(len(x.size)), x.size)
            base = np.bincount(doc, np.log10((x.c1 + 1) / (n + v + 1)), len(x.size))
            known = np.bincount(doc, x.c1 > 0, len(x.size)).astype(np.int64)
            if order == 1:
                sums = np.bincount(doc, np.log10(unigrams(x.c1)), len(x.size))
            else:
                sums = np.zeros(len(x.size))
                for _, docs_, value in given[order]:
                    sums[_unpack(docs_)] += _unpack(value)
            for i, t, s, k, b, y in zip(_unpack(row[0]).tolist(), x.train.tolist(), x.size.tolist(), known.tolist(), base.tolist(), sums.tolist(), strict=True):
                yield None if i == NO_ID else i, not t, s, k, n, b, y

    scored: RDD = joined.mapPartitions(finish)
    return spark.createDataFrame(scored, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(tx.documents(spark, sf_dir))
