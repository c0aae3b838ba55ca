"""Token-ID / binary output: flat unsigned integer files plus 64-bit document offsets.

Documents are range-partitioned (about `FILE_BYTES` of text each) and sorted by doc_id; each task encodes its documents and writes one set of files:

    part-NNNNN.bin   token ids, little-endian, the narrowest of uint16 / uint32 that holds the vocabulary
    part-NNNNN.idx   uint64 offsets into the .bin, one per document and one for the end
    part-NNNNN.ids   int64 doc_ids (the smallest int64 for a null id)

Tasks write under a name of their own attempt and rename, so a repeated task leaves one whole file. The
partitions' bases are prefix sums of their token counts (one row per partition). The reader maps local files into
memory and reads others through pyarrow's file systems.

Defined results: null text is empty and gives the end id alone; an empty table gives no files; repeated doc_ids
keep one entry per row.
"""

from __future__ import annotations

import itertools
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import textops as tx

END_ID = 1
NO_ID = -(1 << 63)
CACHE_WORDS = 800_000
FILE_BYTES = 32 << 20  # of text for a set of files: the words of a task are learnt once
_STARTED: dict[str, Encoder] = {}  # one per Python worker, kept between tasks

#: Letters of one or two bytes whose lower case is one letter, then punctuation: one or two pieces for the tokenizer.
_PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,!?;:|%&*$#()-]*)")


class Encoder:
    """Encodes words through the tokenizers library and keeps what each distinct word gave.

    Only for tokenizers whose pieces never cross white space (`word_bpe_49k.json`): a text's ids are then its
    words' ids in order. Plain words are encoded many at a time; the tokenizer ends each piece with one id that
    carries the word-end mark, so the ids fall apart at known places. All other words are encoded one by one.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.ends = np.zeros(self.size, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.start, self.count, self.used, self.filled = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), 0, 0
        self.pool = np.zeros(1 << 18, np.uint32)
        self._keep([b""], np.zeros(1, np.int64), np.zeros(0, np.uint32))

    def rest(self) -> None:
        """Give the words' memory back: the worker goes on to other operators' tasks."""
        self._clear()
        pa.default_memory_pool().release_unused()

    def _keep(self, words: list[bytes], counts: np.ndarray, ids: np.ndarray) -> None:
        n = self.filled + len(words)
        while n > len(self.start):
            self.start, self.count = np.concatenate([self.start, np.zeros_like(self.start)]), np.concatenate([self.count, np.zeros_like(self.count)])
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.place.update(zip(words, range(self.filled, n), strict=True))
        self.count[self.filled : n] = counts
        self.start[self.filled : n] = self.used + np.cumsum(counts) - counts
        self.pool[self.used : self.used + len(ids)] = ids
        self.filled, self.used = n, self.used + len(ids)

    def _each(self, words: list[bytes]) -> None:
        if words:
            found = [x.ids for x in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]
            self._keep(words, np.array([len(x) for x in found], np.int64), np.array([i for x in found for i in x], np.uint32))

    def _learn(self, words: list[bytes]) -> None:
        """Give every new word a place."""
        plain, head, tail, other, match, placed = [], [], [], [], _PLAIN.fullmatch, self.place
        for w in words:
            m = match(w)
            if m is None:
                other.append(w)
            else:
                plain.append(w)
                head.append(m[1].lower())
                tail.append(m[2])
        self._each(other)
        missing = [b for b in dict.fromkeys(itertools.chain(head, filter(None, tail))) if b not in placed]
        for at in range(0, len(missing), 4096):
            part = missing[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part) or stops[-1] != len(ids):
                self._each(part)
            else:
                self._keep(part, np.diff(stops, prepend=0), ids)
        new = [i for i, w in enumerate(plain) if w not in placed]
        if new:
            first = np.fromiter((placed[head[i]] for i in new), np.int64, len(new))
            second = np.fromiter((placed[tail[i]] for i in new), np.int64, len(new))
            size = np.stack([self.count[first], self.count[second]], 1).ravel().astype(np.int64)
            self._keep([plain[i] for i in new], self.count[first] + self.count[second], self._gather(np.stack([self.start[first], self.start[second]], 1).ravel(), size))

    def _gather(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        total = int(size.sum())
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(total)
        return self.pool[at]

    def encode(self, texts: list[bytes | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, ids per text)."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.binary())
        texts = texts.fill_null(b"").view(pa.string())
        # Splits at runs of [\x20\x09-\x0D]; a run at an end gives an empty word, which has no ids.
        split = pc.ascii_split_whitespace(texts)
        edge = np.asarray(split.offsets).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        listed = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary.view(pa.binary()))
        words = pc.binary_join(listed, b" ")[0].as_py().split(b" ") if len(coded) else []
        place = list(map(self.place.get, words))
        if None in place:
            if self.filled > self.limit:
                self._clear()
            self._learn([w for w in words if w not in self.place])
            place = list(map(self.place.__getitem__, words))
        place = np.array(place, np.int64)[coded.indices.to_numpy()] if words else np.zeros(0, np.int64)
        size = self.count[place].astype(np.int64)
        run = np.concatenate([[0], np.cumsum(size)])
        return self._gather(self.start[place], size), np.diff(run[edge - edge[0]])


def encoder(path: str) -> Encoder:
    if path not in _STARTED:
        _STARTED[path] = Encoder(path)
    return _STARTED[path]


def write_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write the files; returns (part, name, n_docs, n_tokens, base), one row per partition in doc_id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, (store, at) = encoder(tokenizer), tx.file_system(folder)
        kind = np.dtype("<u2" if max(code.size, end_id + 1) <= 1 << 16 else "<u4")
        part = TaskContext.get().partitionId()
        name, own = f"part-{part:05d}", f".{part:05d}-{uuid.uuid4().hex}"
        store.create_dir(at, recursive=True)
        sizes, ids, ends = [], [], ("bin", "idx", "ids")
        try:
            with store.open_output_stream(f"{at}/{own}.bin") as out:
                for batch in batches:
                    ids.append(batch.column(0).fill_null(NO_ID).to_numpy())
                    texts = batch.column(1)
                    for a, b in tx.chunks(tx.binary_column(batch, "text")[1], 8 << 20):
                        tokens, n = code.encode(texts.slice(a, b - a))
                        whole = np.insert(tokens, np.cumsum(n), end_id).astype(kind)
                        sizes.append(n + 1)
                        out.write(whole.tobytes())
            code.rest()
            n = np.concatenate([*sizes, np.zeros(0, np.int64)])
            for end, data in (("idx", np.concatenate([[0], np.cumsum(n)]).astype("<u8")), ("ids", np.concatenate([*ids, np.zeros(0, np.int64)]).astype("<i8"))):
                with store.open_output_stream(f"{at}/{own}.{end}") as out:
                    out.write(data.tobytes())
            if len(n):
                for end in ends:
                    store.move(f"{at}/{own}.{end}", f"{at}/{name}.{end}")
        finally:  # what an attempt that failed, or had nothing to write, has begun
            for end in ends:
                if store.get_file_info(f"{at}/{own}.{end}").type != fs.FileType.NotFound:
                    store.delete_file(f"{at}/{own}.{end}")
        if not len(n):
            return
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([len(n)]), pa.array([int(n.sum())]), pa.array([kind.str])], ["part", "name", "n_docs", "n_tokens", "kind"])

    spark = docs.sparkSession
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    size = ordered.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(-(-size // FILE_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), 1)
    ordered = ordered.repartitionByRange(n, F.col("doc_id").asc_nulls_last()).sortWithinPartitions(F.col("doc_id").asc_nulls_last())
    written = ordered.mapInArrow(run, "part int, name string, n_docs long, n_tokens long, kind string").toArrow().sort_by("part")
    size = written["n_tokens"].to_numpy()
    parts = written.append_column("base", pa.array(np.cumsum(size) - size))
    schema = "part int, name string, n_docs long, n_tokens long, kind string, base long"
    return spark.createDataFrame(parts.to_pylist(), schema)


def map_file(folder: str, name: str, kind: str) -> np.ndarray:
    """A file's numbers: mapped into memory where the folder is local."""
    store, at = tx.file_system(folder)
    path = f"{at}/{name}"
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def read_files(parts: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, offsets = map_file(folder, f"{row['name']}.ids", "<i8"), map_file(folder, f"{row['name']}.idx", "<u8").astype(np.int64)
                tokens = map_file(folder, f"{row['name']}.bin", row["kind"])
                sums = [zlib.crc32(tokens[a:b].astype("<u4").tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                doc_id = pa.array(np.asarray(ids), mask=np.asarray(ids) == NO_ID)
                yield pa.RecordBatch.from_arrays([doc_id, pa.array(row["base"] + offsets[:-1]), pa.array(np.diff(offsets)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return parts.repartition(max(1, parts.count()), "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode, write to a fresh shared folder and read back."""
    folder = tx.scratch(docs.sparkSession, "tokens")
    return read_files(write_files(docs, folder, tokenizer or default_tokenizer(), end_id), folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(tx.documents(spark, sf_dir))
