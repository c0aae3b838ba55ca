"""Vectorised text primitives shared by the operators: every function works on whole byte buffers.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; since UTF-8 never uses those bytes
inside a longer sequence, words can be cut from bytes without decoding. Null texts count as empty.
"""

from __future__ import annotations

import contextlib
import os
import re
import threading
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
_BLOCK = 1 << 20
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_tables: dict[str, np.ndarray] = {}
_lock, _writers, _before = threading.Lock(), 0, None


def _table(name: str) -> np.ndarray:
    """Powers of the odd base, their inverses, and a random 64-bit value for each byte."""
    if not _tables:
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            for key, b in (("pow", _BASE), ("inv", inverse)):
                x = np.full(_BLOCK + 1, b, np.uint64)
                x[0] = 1
                _tables[key] = np.multiply.accumulate(x)
        _tables["byte"] = np.random.default_rng(20231).integers(1, 1 << 63, 256, dtype=np.uint64)
    return _tables[name]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: spreads every input bit over the output."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def binary_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary or string column; nulls become empty rows."""
    col = batch.column(batch.schema.get_field_index(name))
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if col.null_count:  # what lies under a null slot is undefined
        keep = np.asarray(col.is_valid())
        if (np.diff(off)[~keep] > 0).any():
            parts = [data[a:b] for a, b, k in zip(off[:-1], off[1:], keep, strict=True) if k]
            data = np.concatenate([*parts, np.zeros(0, np.uint8)])
            off = np.concatenate([[0], np.cumsum(np.where(keep, np.diff(off), 0))])
    return data[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes; a longer row stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words per row): no word crosses a row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    word = ~_IS_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    cut = offsets[:-1][np.diff(offsets) > 0]
    first[cut] = word[cut]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[offsets[1:][np.diff(offsets) > 0] - 1] = word[offsets[1:][np.diff(offsets) > 0] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, spans: list[tuple[np.ndarray, np.ndarray]], lower: bool = False) -> list[np.ndarray]:
    """Mixed 64-bit polynomial hashes of spans inside each word, from running sums over blocks of bytes."""
    powers, inverse, table = _table("pow"), _table("inv"), _table("byte")
    if lower:
        table = table[_LOWER]
    out, i, n = [np.empty(len(starts), np.uint64) for _ in spans], 0, len(starts)
    factor = np.uint64(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):

        def alone(s: int, e: int) -> np.uint64:
            if e - s <= _BLOCK:
                return (table[data[s:e]] * powers[: e - s]).sum(dtype=np.uint64) + np.uint64(e - s) * factor
            h = np.uint64(0)
            while s < e:  # a word longer than a block: folded piece by piece
                piece = data[s : min(s + _BLOCK, e)]
                h = mix(np.array([h + (table[piece] * powers[: len(piece)]).sum(dtype=np.uint64)], np.uint64))[0]
                s += _BLOCK
            return h

        while i < n:
            at = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, at + _BLOCK, "right")))
            if ends[i] - at > _BLOCK:
                for x, (s, e) in zip(out, spans, strict=True):
                    x[i] = alone(int(s[i]), int(e[i]))
                i += 1
                continue
            piece = data[at : ends[j - 1]]
            run = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(table[piece] * powers[: len(piece)], out=run[1:])
            for x, (s, e) in zip(out, spans, strict=True):
                s_, e_ = s[i:j] - at, e[i:j] - at
                x[i:j] = (run[e_] - run[s_]) * inverse[s_] + (e_ - s_).astype(np.uint64) * factor
            i = j
    return [mix(x) for x in out]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A mixed 64-bit hash of each word."""
    return span_hashes(data, starts, ends, [(starts, ends)], lower)[0]


def split(text: bytes | None) -> list[bytes]:
    """The words of one text."""
    return text.split() if text else []


def normalised(text: bytes | None) -> bytes:
    """Each white-space run becomes one space; runs at the ends stay as one space."""
    if not text:
        return b""
    words = text.split()
    if not words:
        return b" "
    return (b" " if text[0] in b" \t\n\v\f\r" else b"") + b" ".join(words) + (b" " if text[-1] in b" \t\n\v\f\r" else b"")


def lowered(text: bytes | None) -> bytes:
    """A-Z become a-z; other letters stay (bytes.lower() is ASCII only)."""
    return text.lower() if text else b""


def crc(doc_id: int | None) -> int:
    return zlib.crc32(str(doc_id).encode())


def crc_mod(col: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in small batches, so that a worker's memory doesn't follow their length.

    These two settings stay on the session, as frames are run after a query has returned; values that the caller set are kept.
    """
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))):
        if not spark.conf.isModifiable(key) or spark.sparkContext.getConf().contains(key):
            continue
        spark.conf.set(key, value)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system for a folder of ours, and the path in it."""
    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; one of our own only where none is set and all run on one machine."""
    small_batches(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(os.environ.get("TMPDIR", "/tmp"), "lodestone-shared")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _cleaned_up(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go once a query ends, while any thread is in here."""
    global _writers, _before
    with _lock:
        if not _writers:
            _before = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        _writers += 1
    try:
        yield
    finally:
        with _lock:
            _writers -= 1
            if not _writers:
                spark.conf.unset(_CLEANUP) if _before is None else spark.conf.set(_CLEANUP, _before)


def store(df: DataFrame, name: str) -> str:
    """Write a table to the shared folder: its path."""
    path = scratch(df.sparkSession, name)
    with _cleaned_up(df.sparkSession):  # the written table takes the place of the shuffle files
        df.write.option("compression", "zstd").parquet(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage and survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(store(df, name))


def read_folder(path: str) -> pa.Table:
    """A small table of ours, read whole in a task."""
    folder, at = file_system(path)
    return pq.read_table(at, filesystem=folder)


def dealt_anew(df: DataFrame, key: str) -> DataFrame:
    """`df` with a computed copy of a long, string or binary key, so that a join on the key deals `df` out once more.

    Adaptive execution splits a hot key's join only where both sides come straight from a shuffle; an aggregate on the
    key keeps its place and would bind the other side's rows of that key to one task.
    """
    kind = dict(df.dtypes)[key]
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0).cast("long")) if kind == "bigint" else F.concat(F.col(key), F.lit("").cast(kind)))


def drop_stored(spark: SparkSession, df: DataFrame) -> None:
    """Delete what `stored` wrote."""
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(docs: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `docs` is called so."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return name


def own(docs: DataFrame) -> list[Column]:
    """The columns of `docs`, whatever they are called."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id isn't in `gone` (doc_id); null ids stay. No column name can clash."""
    d, g = docs.alias("_docs"), gone.alias("_gone")
    return d.join(g, F.col("_docs.doc_id") == F.col("_gone.doc_id"), "left_anti")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
