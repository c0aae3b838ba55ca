"""Substring dedup by level-wise doubling of repeated word windows.

Windows of `words / 2**levels` words are hashed first. Of these, and of the levels after them, only content-defined
anchors are counted: the least hash of every run of windows inside one window of twice the length, so that two equal
windows always share their anchors, at the same offset. Anchors that occur once die. What survives alone is extended
to windows of twice the length, and so on up to `words`. At that length every window around a survivor is kept: the
first occurrence (smallest doc_id, then earliest start) of each is found from two independent hashes of 64 and 32 bits, and each
later occurrence covers the words that are removed. Doubling then goes on over every place until nothing survives: a window
of twice the length is known by the hashes of its halves, so that only repeated windows are looked at again and no text is.
`longest_repeat` is the last length at which any window of a document occurs twice (0: none), `longest` the last at which
one does that begins at its least window of `words` words. They can't change what is removed, as all windows of `words`
words inside a longer repeat repeat as well.

Documents equal to an earlier one word by word are collapsed first: they lose all their words if they have a
window at all, and can't be the first occurrence of anything.

Defined results: null and empty texts have no words; rows with a null doc_id are returned untouched and are nobody's
first occurrence; rows that share a doc_id are documents of their own, ordered by the digest of their words, and equal
ones among them are cut alike, none being the other's copy; an empty table gives no rows; other columns are ignored;
whole texts are read, one text at a time where windows are made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import textops as tx

MULTIPLIER, SECOND = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB


def windows(h: np.ndarray, length: int, multiplier: int = MULTIPLIER) -> np.ndarray:
    """Polynomial hash of `length` values from every position (shorter by length - 1), by doubling."""
    with np.errstate(over="ignore"):
        out, done, bit = None, 0, 1
        power, factor = h, np.uint64(multiplier)
        left = length
        while left:
            if left & 1:
                if out is None:
                    out, done, scale = power, bit, factor
                else:
                    n = len(h) - done - bit + 1
                    if n <= 0:
                        return np.zeros(0, np.uint64)
                    out, scale, done = out[:n] + scale * power[done : done + n], scale * factor, done + bit
            left >>= 1
            if left:
                n = len(power) - bit
                if n <= 0:
                    return np.zeros(0, np.uint64)
                power, factor, bit = power[:n] + factor * power[bit:], factor * factor, 2 * bit
    return out


def _slide(x: np.ndarray, width: int, of: Callable) -> np.ndarray:
    """Least or greatest value of `width` values from every position, by doubling."""
    size = 1
    while 2 * size <= width:
        x, size = of(x[:-size], x[size:]), 2 * size
    rest = width - size
    return of(x[:-rest], x[rest:]) if rest else x


def anchors(h: np.ndarray, rows: np.ndarray, words: int, short: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the short windows that are least in some full window inside their document.

    `rows` holds the words of each document that `h` joins; windows across documents are left out.
    """
    n = len(h)
    if n < words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    small = tx.mix(windows(h, short))
    span = words - short + 1
    least = _slide(small, span, np.minimum)  # one per full window
    left = np.repeat(np.cumsum(rows), rows) - np.arange(n)
    least = np.where(left[: len(least)] >= words, least, 0)
    pad = np.zeros(span - 1, np.uint64)
    most = _slide(np.concatenate([pad, least, pad]), span, np.maximum)  # greatest least of the full windows around
    at = np.flatnonzero((small == most) & (small > 0))
    return at, small[at]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def _sub(place: str) -> Column:
    """Which of the rows that share its id a place is in: the upper half of the place."""
    return F.shiftright(place, 32).cast("int")


def _word(place: str) -> Column:
    """The word at which a place is: its lower half."""
    return F.col(place).bitwiseAND(0xFFFFFFFF).cast("int")


def _digest(text: bytes | None) -> tuple[int, bytes]:
    words = tx.split(text)
    return len(words), hashlib.sha256(b" ".join(words)).digest()


def told_apart(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text, sub) of the different rows, and (doc_id, digest, sub) of ids that repeat (None: no id does)."""
    texts = _texts(docs)
    ids = tx.stored(texts.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "repeated_ids")
    if ids.isEmpty():
        return texts.withColumn("sub", F.lit(0)), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_digest(t.as_py())[1] for t in batch.column(1)], pa.binary())], ["doc_id", "text", "digest"])

    more = texts.join(ids, texts["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").mapInArrow(run, "doc_id long, text binary, digest binary").dropDuplicates(["doc_id", "digest"])
    more = tx.stored(more.withColumn("sub", F.row_number().over(Window.partitionBy("doc_id").orderBy("digest")) - 1), "told_apart")
    once = texts.join(ids, texts["doc_id"].eqNullSafe(ids["doc_id"]), "left_anti").withColumn("sub", F.lit(0))
    return once.unionByName(more.select("doc_id", "text", "sub")), more.select("doc_id", "digest", "sub")


def read(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, digest): the digest of the words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests = zip(*(_digest(t.as_py()) for t in batch.column(1)), strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary())], ["doc_id", "n_words", "digest"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_words long, digest binary")


def anchor_rows(texts: DataFrame, words: int, short: int) -> DataFrame:
    """(h, doc_id, at): the anchors of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, subs = batch.column(0), batch.column(2).to_numpy().astype(np.int64)
            data, offsets = tx.binary_column(batch, "text")
            for a, b in tx.chunks(offsets):
                part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, rows = tx.word_spans(part, off)
                at, h = anchors(tx.word_hashes(part, starts, ends), rows, words, short)
                if len(at):
                    first = np.cumsum(rows) - rows
                    of = np.searchsorted(first + rows, at, "right")
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), ids.slice(a, b - a).take(pa.array(of)), pa.array((at - first[of]) | subs[a:b][of] << 32)], ["h", "doc_id", "at"])

    return texts.select("doc_id", "text", "sub").mapInArrow(run, "h long, doc_id long, at long")


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that occur more than once: counted map-side first, so a frequent key costs one row a task."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys)


def extended(texts: DataFrame, alive: DataFrame, length: int, every: bool) -> DataFrame:
    """(h, g, doc_id, start) of the windows of `length` words around surviving anchors of half the length: with `every` all
    of them, else only anchors."""
    short = length // 2
    alive = alive.groupBy("doc_id", _sub("at").alias("sub")).agg(F.collect_list(_word("at")).alias("at"))
    marked = texts.join(alive, ["doc_id", "sub"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, sub, text, at in zip(*batch.columns, strict=True):
                data = np.frombuffer(text.as_py() or b"", np.uint8)
                starts, ends, _ = tx.word_spans(data, np.array([0, len(data)]))
                h = tx.word_hashes(data, starts, ends)
                if len(h) < length:
                    continue
                small = tx.mix(windows(h, short))
                live = np.full(len(small), np.iinfo(np.uint64).max)
                at = at.values.to_numpy(zero_copy_only=False)
                live[at] = small[at]
                span = length - short + 1  # a repeated window's least short window is an anchor that lives
                start = np.flatnonzero(_slide(live, span, np.minimum) == _slide(small, span, np.minimum))
                if not every:
                    start = np.intersect1d(anchors(h, np.array([len(h)]), 2 * length, length)[0], start)
                one = tx.mix(windows(h, length)[start])
                two = tx.mix(windows(h, length, SECOND)[start]) if every else np.zeros(len(start), np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array((two >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(np.full(len(start), doc_id.as_py(), np.int64)), pa.array(start | sub.as_py() << 32)], ["h", "g", "doc_id", "start"])

    return marked.select("doc_id", "sub", "text", "at").mapInArrow(run, "h long, g int, doc_id long, start long")


def repeats(found: DataFrame) -> DataFrame:
    """(h, g, doc_id, start, later) of the windows whose words stand elsewhere too; later: whether they also start earlier."""
    keys = ["h", "g"]
    first = found.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start")).alias("first")).filter("n > 1").select(*keys, "first")
    return found.join(tx.dealt_anew(first, "h"), keys).select(*keys, "doc_id", "start", (F.struct("doc_id", "start") > F.col("first")).alias("later"))


def _remove(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, starts in zip(batch.column(2), batch.column(3), strict=True):
                tokens = tx.split(text.as_py())
                change = np.zeros(len(tokens) + 1, np.int32)
                starts = starts.values.to_numpy(zero_copy_only=False)
                np.add.at(change, starts, 1)
                np.add.at(change, starts + words, -1)
                gone = np.cumsum(change[:-1]) > 0
                kept = b" ".join(w for w, g in zip(tokens, gone.tolist(), strict=True) if not g)
                out.append((int(gone.sum()), hashlib.sha256(kept).hexdigest()))
            cut, sha = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cut, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "sub", "cut", "sha"])

    return run


def survivors(alive: DataFrame, words: int) -> DataFrame:
    """(doc_id, sub, longest, longest_repeat): doubles the length of repeated windows, from every place, until none is left.

    `alive` has (h, g, doc_id, start) of the repeated windows of `words` words. A window of twice the length repeats only where
    the window at its start and the one behind that do, and is equal to another where both are. `low` is the least hash of
    the windows of `words` words inside a window, `least` whether it begins there.
    """
    spark, length, own = alive.sparkSession, words, F.col("h").bitwiseXOR(F.lit(-(1 << 63)))  # hashes are unsigned
    alive, best = alive.select("h", "g", "doc_id", "start", own.alias("low"), F.lit(True).alias("least")), None
    by = Window.partitionBy("doc_id").orderBy("start")
    while True:
        ahead = lambda c, n: F.first(c).over(by.rangeBetween(n, n))
        half, span = length // 2, by.rangeBetween(0, length)
        # windows of twice the words and more overlap enough for three of them to have all inside; not so the first ones
        low = F.min("low").over(span) if length == words else F.least("low", ahead("low", half), ahead("low", length))
        pairs = alive.select("h", "g", "doc_id", "start", "low", "least", ahead("h", length).alias("h2"), ahead("g", length).alias("g2"), low.alias("all")).filter("h2 is not null")
        now = pairs.select(F.xxhash64("h", "h2").alias("h"), F.hash("g", "g2").alias("g"), "doc_id", "start", F.col("all").alias("low"), (F.col("least") & (F.col("all") == F.col("low"))).alias("least"))
        now = tx.stored(now, "doubled")
        alive_now = tx.stored(now.join(tx.dealt_anew(repeated(now, ["h", "g"]), "h"), ["h", "g"]), "alive")
        tx.drop_stored(spark, now)
        if length > words:
            tx.drop_stored(spark, alive)
        alive, length = alive_now, 2 * length
        at = F.lit(length).cast("long")
        here = tx.stored(alive.groupBy("doc_id", _sub("start").alias("sub")).agg(F.max(F.when(F.col("least"), at)).alias("longest"), F.max(at).alias("longest_repeat")), "longest")
        best = here if best is None else best.unionByName(here)
        if here.isEmpty():
            tx.drop_stored(spark, alive)
            return best.groupBy("doc_id", "sub").agg(F.max("longest").alias("longest"), F.max("longest_repeat").alias("longest_repeat"))


def substring_dedup(docs: DataFrame, words: int = 20, levels: int = 1) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, longest, longest_repeat per document."""
    if levels < 1 or words % 2**levels:
        raise ValueError("words must be a multiple of 2 ** levels, levels 1 or more")
    spark = docs.sparkSession
    texts, subs = told_apart(docs)
    known = tx.stored(read(docs), "read")
    least = known.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("n")).filter("n > 1").select("digest", "first_id", "last_id")
    known = known.join(tx.dealt_anew(least, "digest"), "digest", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)))
    known = known.withColumn("again", F.col("doc_id").isNotNull() & F.coalesce(F.col("last_id") > F.col("first_id"), F.lit(False)))
    known = known.withColumn("sub", F.lit(0)) if subs is None else known.join(subs, ["doc_id", "digest"], "left").withColumn("sub", F.coalesce("sub", F.lit(0)))
    known = tx.stored(known.select("doc_id", "sub", "n_words", "digest", "copy", "again"), "known")
    length = words >> levels
    rows = tx.stored(anchor_rows(texts.filter("doc_id is not null"), 2 * length, length), "anchors")
    copies = known.filter("copy").select("doc_id", "sub").distinct()
    alive = rows.join(tx.dealt_anew(repeated(rows, ["h"]), "h"), "h").select("doc_id", "at").withColumn("sub", _sub("at"))
    alive = tx.stored(alive.join(copies, ["doc_id", "sub"], "left_anti").select("doc_id", "at"), "alive")
    tx.drop_stored(spark, rows)
    while (length := 2 * length) < words:
        rows = tx.stored(extended(texts, alive, length, False), "anchors")
        alive = tx.stored(rows.join(tx.dealt_anew(repeated(rows, ["h"]), "h"), "h").select("doc_id", F.col("start").alias("at")), "alive")
        tx.drop_stored(spark, rows)
    found = tx.stored(extended(texts, alive, words, True), "windows")
    tx.drop_stored(spark, alive)
    twice = tx.stored(repeats(found), "repeats")
    tx.drop_stored(spark, found)
    starts = twice.filter("later").groupBy("doc_id", _sub("start").alias("sub")).agg(F.collect_list(_word("start")).alias("starts"))
    starts = tx.stored(starts, "starts")
    longest = tx.stored(survivors(twice.drop("later"), words), "longest")
    any_ = tx.stored(twice.select("doc_id", _sub("start").alias("sub"), F.lit(words).cast("long").alias("first")).distinct(), "any")
    tx.drop_stored(spark, twice)
    cut = texts.join(starts, ["doc_id", "sub"]).select("doc_id", "sub", "text", "starts").mapInArrow(_remove(words), "doc_id long, sub int, cut long, sha string")
    gone = F.col("copy") & (F.col("n_words") >= words)
    empty = hashlib.sha256(b"").hexdigest()
    removed = F.when(gone, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).cast("long")
    doubled = F.lit(words) * F.pow(F.lit(2), F.floor(F.log2(F.col("n_words") / words) + 1e-9))
    return known.join(cut, ["doc_id", "sub"], "left").join(longest, ["doc_id", "sub"], "left").join(any_, ["doc_id", "sub"], "left").select(
        "doc_id",
        "n_words",
        removed.alias("n_removed"),
        F.when(gone, F.lit(empty)).otherwise(F.coalesce("sha", F.lower(F.hex("digest")))).alias("kept_sha256"),
        F.when(gone, doubled).otherwise(F.coalesce("longest", F.when(removed > 0, F.lit(words)).otherwise(0))).cast("long").alias("longest"),
        F.when(F.col("again") & (F.col("n_words") >= words), doubled).otherwise(F.coalesce("longest_repeat", "first", F.lit(0))).cast("long").alias("longest_repeat"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(tx.documents(spark, sf_dir))
