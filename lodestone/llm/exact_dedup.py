"""Exact dedup with a cuckoo-filter index over content digests.

Each text is normalised (every white-space run becomes one space) and digested with SHA-256. Digests are
pre-aggregated where they are read, dealt out by bucket and looked up in their bucket's cuckoo filter: a miss
is a new live digest and is inserted; a hit is verified against the digests stored in the bucket, so a false
positive of the filter never merges two texts. A filter that overflows is rebuilt at twice the size from the
stored keys. `apply_changes` inserts and deletes live digests in a stored index, whose members name the row to keep.

Defined results: null text equals the empty text; empty tables give empty results; of rows that share the
smallest doc_id of a group all carry kept = true; null ids sort after all others; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import textops as tx

SLOTS = 4
KICKS = 400
BUCKET_ROWS = 1_000_000


class CuckooFilter:
    """16-bit fingerprints, four slots a bucket, two candidate buckets: insertion, lookup and deletion."""

    def __init__(self, capacity: int = 1024):
        self.buckets = 1
        while self.buckets * SLOTS * 0.9 < max(capacity, 4):
            self.buckets *= 2
        self.table = np.zeros((self.buckets, SLOTS), np.uint16)
        self.live = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "little") or 1
        first = int.from_bytes(digest[10:18], "little") & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 & (self.buckets - 1))

    def __contains__(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        return mark in self.table[a].tolist() or mark in self.table[b].tolist()

    def insert(self, digest: bytes) -> bool:
        """False: no room after KICKS moves; the caller rebuilds from its stored keys (one mark has been lost)."""
        mark, a, b = self._places(digest)
        at = a
        for at in (a, b):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                self.live += 1
                return True
        for kick in range(KICKS):
            slot = (mark + kick) % SLOTS
            mark, self.table[at, slot] = int(self.table[at, slot]), mark
            at = self._other(at, mark)
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                self.live += 1
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        for at in (a, b):
            hit = np.flatnonzero(self.table[at] == mark)
            if len(hit):
                self.table[at, hit[0]] = 0
                self.live -= 1
                return True
        return False


class BucketIndex:
    """The live digests of one bucket: a filter in front, the stored keys with keep_id and count behind."""

    def __init__(self, capacity: int = 1024):
        self.filter = CuckooFilter(capacity)
        self.keys: dict[bytes, list] = {}
        self.lookups = self.hits = self.false_hits = self.resizes = 0

    def _resize(self) -> None:
        size = max(2 * self.filter.buckets * SLOTS, 2 * len(self.keys))
        while True:
            self.filter = CuckooFilter(size)
            self.resizes += 1
            if all(self.filter.insert(k) for k in self.keys):
                return
            size *= 2

    def add(self, digest: bytes, doc_id: int | None, n: int = 1) -> None:
        self.lookups += 1
        if digest in self.filter:
            self.hits += 1
            held = self.keys.get(digest)
            if held is not None:
                held[1] += n
                if doc_id is not None and (held[0] is None or doc_id < held[0]):
                    held[0] = doc_id
                return
            self.false_hits += 1
        self.keys[digest] = [doc_id, n]
        if not self.filter.insert(digest):
            self._resize()

    def remove(self, digest: bytes, n: int = 1) -> bool:
        """Take away n copies; the last one deletes the digest."""
        held = self.keys.get(digest) if digest in self.filter else None
        if held is None:
            return False
        held[1] -= n
        if held[1] <= 0:
            del self.keys[digest]
            self.filter.delete(digest)
        return True


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row, from its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashlib.sha256(tx.normalised(t.as_py())).digest() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "digest"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, digest binary")


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What one task has read of each digest: bounds the rows that a digest sends to its bucket by the tasks."""
    for batch in batches:
        seen: dict[bytes, list] = {}
        for doc_id, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held = seen.setdefault(digest, [None, 0])
            held[1] += 1
            if doc_id is not None and (held[0] is None or doc_id < held[0]):
                held[0] = doc_id
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], ["digest", "doc_id", "n"])


def _live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = BucketIndex()
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            index.add(*row)
    rows = list(index.keys.items())
    for at in range(0, len(rows), 50_000):
        part = rows[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.binary()), pa.array([v[0] for _, v in part], pa.int64()), pa.array([v[1] for _, v in part], pa.int64())], ["digest", "keep_id", "group_size"])


def live_digests(keyed: DataFrame, buckets: int | None = None) -> DataFrame:
    """The index's rows: (digest, keep_id, group_size), one per distinct text. Buckets follow the rows, so that each stays in a task's memory."""
    buckets = buckets or max(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-keyed.count() // BUCKET_ROWS))
    partial = keyed.mapInArrow(_partials, "digest binary, doc_id long, n long")
    return partial.repartition(buckets, "digest").mapInArrow(_live, "digest binary, keep_id long, group_size long")


def apply_changes(index: DataFrame, members: DataFrame, added: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A stored index and its members (doc_id, digest) after insertions and deletions of (doc_id, digest) rows.

    A deletion takes one member row with its id and digest; where none is left it has no effect. A digest whose last
    member goes is deleted; one whose keep_id goes is kept under the smallest id that is left.
    """
    spark = index.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = ["doc_id", "digest"]
    counted = lambda df, n: df.groupBy(*key).agg((F.count("*") * n).alias("n"))
    held = counted(members.select(*key).unionByName(added.select(*key)), 1).withColumnRenamed("n", "there")
    less = counted(removed.select(*key), 1).withColumnsRenamed({"doc_id": "_id", "digest": "_digest"})
    both = held.join(less, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    left = tx.stored(both.select(*key, "there", F.least("there", F.coalesce("n", F.lit(0))).alias("gone")), "left")
    gone = left.filter("gone > 0").groupBy("digest").agg(F.sum("gone").alias("n"))
    touched = tx.dealt_anew(gone.select("digest"), "digest")
    keep = left.filter("there > gone").join(touched, "digest", "left_semi").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    no_id, no_n = F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n")
    rows = (
        index.select("digest", F.col("keep_id").alias("doc_id"), F.col("group_size").alias("n"), F.lit(0).alias("step"))
        .unionByName(added.select(*key).mapInArrow(_partials, "digest binary, doc_id long, n long").withColumn("step", F.lit(1)))
        .unionByName(gone.select("digest", no_id, "n", F.lit(2).alias("step")))
        .unionByName(keep.select("digest", "doc_id", no_n, F.lit(3).alias("step")))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = BucketIndex()
        for batch in batches:
            for digest, doc_id, n, step in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if step == 2:
                    bucket.remove(digest, n)
                elif step == 3:
                    bucket.keys[digest][0] = doc_id
                else:
                    bucket.add(digest, doc_id, n)
        keys = bucket.keys
        yield pa.RecordBatch.from_arrays([pa.array(list(keys), pa.binary()), pa.array([v[0] for v in keys.values()], pa.int64()), pa.array([v[1] for v in keys.values()], pa.int64())], ["digest", "keep_id", "group_size"])

    changed = rows.repartition(buckets, "digest").sortWithinPartitions("step").mapInArrow(run, "digest binary, keep_id long, group_size long")
    rest = left.filter("there > gone").withColumn("n", F.explode(F.sequence(F.lit(1), F.col("there") - F.col("gone")))).select(*key)
    return changed, rest


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of (doc_id, text)."""
    keyed = tx.stored(digests(docs), "digests")
    groups = live_digests(keyed)
    return keyed.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(tx.documents(spark, sf_dir))


SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, h AS text_sha256
FROM t WINDOW w AS (PARTITION BY h)
"""
