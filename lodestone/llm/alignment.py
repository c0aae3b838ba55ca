"""Cross-tokenizer alignment: the tokens of two tokenizers over the same bytes, in the smallest groups that end together.

Each byte of a text gets a label: no token ends after it, one of A, one of B, or one of both. A regular expression scans the labels
for spans up to each both-label; a span is a group, and its labels count the group's tokens. Two tokens are linked where their bytes
overlap.

Texts are cut before each run of white space that follows something else, but for runs that begin with a sign which pieces join to
words (a carriage return). No token of either tokenizer crosses such a cut (the pieces are looked through when they are loaded; the
pre-tokenizer's pattern breaks there), so a text's tokens are its segments' tokens in order; the distinct
segments of a worker are encoded and aligned once. A text of which a segment doesn't come back byte for byte is encoded whole.

How many documents hold a pair of ids linked is counted over the corpus in tables: blocks of documents send each of their pairs
once with its documents in the block, and get the corpus-wide counts of just these pairs back, from a folder for each block.
Nothing that grows with the corpus lies in one task or on the driver.

Defined results: null and empty texts, and texts whose joined token bytes differ from space+text, have no tokens (zeros, an empty
string for the digest); null and repeated doc_ids are rows of their own; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import textops as tx

#: Bytes of text whose pairs are counted together.
BLOCK = 64 << 20
#: Bytes of distinct segments a worker keeps.
KEPT = 6 << 20
_SPAN = re.compile(rb"[^x]*x")
_LABELS = np.frombuffer(b"nabx", np.uint8)
#: White space of Unicode beyond ASCII, in UTF-8.
_WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_ASCII = np.zeros(256, bool)
_ASCII[[9, 10, 11, 12, 13, 32]] = True
_INSIDE = re.compile(r"[^\s▁][\s▁]")
_STARTED: dict[tuple, Aligner] = {}  # one per Python worker, kept between tasks


class ByteLevel:
    """A byte-level BPE of the tokenizers library; special tokens inside texts are plain text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] or spec["pre_tokenizer"].get("type") != "ByteLevel" or not spec["pre_tokenizer"].get("use_regex"):
            raise ValueError(f"{path}: not a byte-level tokenizer that breaks at white space")
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256
        rest = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
        entries = self.model.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * (max(entries.values()) + 1)
        for token, i in entries.items():
            self.bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with white space."""
        return [x.ids for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """A BPE model of sentencepiece with byte fallback, which puts a space before a text."""

    LEAD = "a"

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bound = {x[1] for p in pieces for x in _INSIDE.findall(p)}  # white space that ends words' pieces: no cut before it
        if self.bound - set("\r\t\v\f"):
            raise ValueError(f"{path}: pieces cross from text to white space")
        as_byte = re.compile(r"<0x([0-9A-F]{2})>")
        self.bytes = [bytes([int(m[1], 16)]) if (m := as_byte.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.lead = self.model.encode(self.LEAD)

    def whole(self, text: str) -> list[int]:
        return self.model.encode(text)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with white space: after a letter whose own ids are taken off."""
        n = len(self.lead)
        found = self.model.encode([self.LEAD + t for t in texts], num_threads=1)
        return [ids[n:] if ids[:n] == self.lead else [] for ids in found]


class Ragged:
    """Rows of numbers in one growing array."""

    def __init__(self):
        self.values, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.count, self.rows = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0

    def add(self, values: np.ndarray, counts: np.ndarray) -> None:
        while self.used + len(values) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        while self.rows + len(counts) > len(self.start):
            self.start, self.count = np.concatenate([self.start, np.zeros_like(self.start)]), np.concatenate([self.count, np.zeros_like(self.count)])
        self.values[self.used : self.used + len(values)] = values
        self.start[self.rows : self.rows + len(counts)] = self.used + np.cumsum(counts) - counts
        self.count[self.rows : self.rows + len(counts)] = counts
        self.used, self.rows = self.used + len(values), self.rows + len(counts)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of the rows one after the other, how many each has)."""
        size = self.count[rows]
        at = np.repeat(self.start[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return self.values[at], size


def labels(n: int, ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """A letter for each of n bytes: n, a, b or x as no token, one of A, one of B or one of both ends with it."""
    code = np.zeros(n, np.uint8)
    code[ends_a - 1] = 1
    code[ends_b - 1] += 2
    return _LABELS[code]


def groups(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, tokens of A, tokens of B) of each span up to a both-label; the last label must be one."""
    size = np.fromiter(map(len, _SPAN.findall(marks.tobytes())), np.int64)
    start = np.cumsum(size) - size
    count = [np.add.reduceat((marks == own) | (marks == ord("x")), start, dtype=np.int64) if len(start) else np.zeros(0, np.int64) for own in b"ab"]
    return size, *count


class Aligner:
    """Encodes and aligns segments, each distinct one once."""

    def __init__(self, a_path: str, b_path: str, limit: int = KEPT):
        self.a, self.b, self.limit = ByteLevel(a_path), Pieces(b_path), limit
        self.size_a, self.size_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.held, self.right, self.parts = 0, np.zeros(1 << 12, bool), [Ragged() for _ in range(4)]  # ids of A and B, group sizes in A and B

    def _ids(self, kind, size: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ids per text, whether a text's bytes come back). Texts are encoded many at a time, in one string: ids fall apart at
        the texts' ends. Where they don't, and for texts of white space only, each alone."""
        out: list = [None] * len(texts)
        alone = [i for i, t in enumerate(texts) if not t.strip()]
        together = [i for i, t in enumerate(texts) if t.strip()]
        runs, at, held = [], [], 0
        for i in together:
            at.append(i)
            held += len(texts[i])
            if held > 1 << 14:
                runs.append(at)
                at, held = [], 0
        if at:
            runs.append(at)
        for k in range(0, len(runs), 16):
            some = runs[k : k + 16]
            strings = [b"".join(texts[i] for i in run) for run in some]
            for run, string, ids in zip(some, strings, kind.encode([s.decode("utf-8", "replace") for s in strings]), strict=True):
                ids = np.array(ids, np.int32)
                ends, stops = np.cumsum(size[ids]), np.cumsum([len(texts[i]) for i in run])
                last = np.searchsorted(ends, stops)
                if not len(ids) or last[-1] >= len(ids) or (ends[last] != stops).any() or b"".join(kind.bytes[i] for i in ids) != string:
                    alone += run
                else:
                    for i, x in zip(run, np.split(ids, last[:-1] + 1), strict=True):
                        out[i] = x
        for i, ids in zip(alone, kind.encode([texts[i].decode("utf-8", "replace") for i in alone]) if alone else [], strict=True):
            out[i] = np.array(ids, np.int32)
        right = np.ones(len(texts), bool)
        right[alone] = [b"".join(kind.bytes[j] for j in out[i]) == texts[i] for i in alone]
        return np.concatenate([np.zeros(0, np.int32), *out]), np.array([len(x) for x in out], np.int64), right

    def _learn(self, texts: list[bytes]) -> None:
        a, na, right_a = self._ids(self.a, self.size_a, texts)
        b, nb, right_b = self._ids(self.b, self.size_b, texts)
        right = right_a & right_b
        keep_a, keep_b = np.repeat(right, na), np.repeat(right, nb)
        a, b, na, nb = a[keep_a], b[keep_b], np.where(right, na, 0), np.where(right, nb, 0)
        _, ga, gb = groups(labels(int(self.size_a[a].sum()), np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])))
        edge = np.concatenate([[0], np.searchsorted(np.cumsum(ga), np.cumsum(na), "right")])  # a text's end is a group's end
        n, total = self.parts[0].rows, self.parts[0].rows + len(texts)
        while total > len(self.right):
            self.right = np.concatenate([self.right, np.zeros_like(self.right)])
        self.right[n:total] = right
        for part, values, counts in zip(self.parts, (a, b, ga, gb), (na, nb, np.diff(edge), np.diff(edge)), strict=True):
            part.add(values, counts)
        self.place.update(zip(texts, range(n, total), strict=True))
        self.held += sum(map(len, texts))

    def whole(self, text: bytes) -> tuple[np.ndarray, ...]:
        """One text as it stands: its ids and groups, nothing where its bytes don't come back."""
        shown = text.decode("utf-8", "replace")
        a, b = np.array(self.a.encode([shown])[0], np.int32), np.array(self.b.whole(shown[1:]), np.int32)
        if b"".join(self.a.bytes[i] for i in a) != text or b"".join(self.b.bytes[i] for i in b) != text:
            return (np.zeros(0, np.int32),) * 4
        _, ga, gb = groups(labels(len(text), np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])))
        return a, b, ga.astype(np.int32), gb.astype(np.int32)

    def align(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For the ids of A and B and the groups' sizes in A and B: (values of all texts, how many each text has)."""
        size = np.diff(offsets)
        spaced = np.insert(data, offsets[:-1][size > 0], 32)
        off = np.concatenate([[0], np.cumsum(size + (size > 0))])
        white = _ASCII[spaced]
        raw = spaced.tobytes()
        for m in _WIDE.finditer(raw):
            white[m.start() : m.end()] = True
        first = white.copy()
        first[1:] &= ~white[:-1]
        for sign in self.b.bound:
            first &= spaced != ord(sign)
        first[off[:-1][size > 0]] = True
        start = np.flatnonzero(first)
        if not len(start):
            return [(np.zeros(0, np.int32), np.zeros(len(size), np.int64))] * 4
        edge = np.searchsorted(start, off)
        bounds = pa.py_buffer(np.append(start, len(spaced)).astype(np.int64).tobytes())
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, bounds, pa.py_buffer(raw)]).dictionary_encode()
        words = coded.dictionary.to_pylist()
        if self.held > self.limit:
            self.clear()
        new = [w for w in words if w not in self.place]
        if new:
            self._learn(new)
        place = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        wrong = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(~self.right[place])])[edge]) > 0)
        out = []
        for part in self.parts:
            values, counts = part.take(place)
            out.append((values, np.diff(np.concatenate([[0], np.cumsum(counts)])[edge])))
        if not len(wrong):
            return out
        other = {int(i): self.whole(raw[off[i] : off[i + 1]]) for i in wrong}
        mended = []
        for k, (values, counts) in enumerate(out):
            rows = np.split(values, np.cumsum(counts)[:-1])
            rows = [other[i][k] if i in other else x for i, x in enumerate(rows)]
            mended.append((np.concatenate(rows), np.array([len(x) for x in rows], np.int64)))
        return mended


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _STARTED:
        _STARTED[a_path, b_path] = Aligner(a_path, b_path)
    return _STARTED[a_path, b_path]


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


COLUMNS = ("a", "b", "group_a", "group_b")


def aligned(docs: DataFrame, tokenizers: tuple[str, str] | None = None, block: int = BLOCK) -> DataFrame:
    """(block, doc_id, a, b, group_a, group_b): each text's ids in A and B, and how many of them its groups hold, in order, as
    little-endian 32-bit integers; `block` numbers runs of documents of about as many bytes of text. `as_arrays` unpacks them."""
    paths = tokenizers or default_tokenizers()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, read = aligner(*paths), TaskContext.get().partitionId(), 0
        for batch in batches:
            for x, y in tx.chunks(tx.binary_column(batch, "text")[1], 1 << 20):
                rows = batch.slice(x, y - x)
                data, off = tx.binary_column(rows, "text")
                packed = []
                for values, counts in code.align(data, off):
                    ends = pa.py_buffer((4 * np.concatenate([[0], np.cumsum(counts)])).astype(np.int64).tobytes())
                    packed.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), y - x, [None, ends, pa.py_buffer(values.astype("<i4").tobytes())]).cast(pa.binary()))
                number = part * (1 << 20) + read // block
                read += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(y - x, number, np.int64)), rows.column("doc_id"), *packed], ["block", "doc_id", *COLUMNS])
        code.clear()  # the worker goes on to other tasks
        pa.default_memory_pool().release_unused()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "block long, doc_id long, a binary, b binary, group_a binary, group_b binary")


def as_arrays(found: DataFrame) -> DataFrame:
    """`aligned` with its numbers as arrays of integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array(v)) for v, e in (_unpacked(batch, c) for c in COLUMNS)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], ["doc_id", *COLUMNS])

    return found.select("doc_id", *COLUMNS).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} array<int>" for c in COLUMNS))


def _unpacked(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, offsets by row)."""
    data, off = tx.binary_column(batch, name)
    return np.frombuffer(data.tobytes(), "<i4"), off // 4


def _links(a: np.ndarray, b: np.ndarray, edge_a: np.ndarray, sizes: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, pair): a link for each stretch of bytes between ends of any tokens; a pair is A's id in the high 32 bits and B's."""
    ends_a, ends_b = np.cumsum(sizes[0][a]), np.cumsum(sizes[1][b])
    mark = np.zeros(int(ends_a[-1]) + 1 if len(a) else 1, np.uint8)
    mark[ends_a] = 1
    mark[ends_b] += 2
    mark = mark[mark > 0]
    in_a, in_b = mark & 1, mark >> 1
    own_a, own_b = np.cumsum(in_a, dtype=np.int64) - in_a, np.cumsum(in_b, dtype=np.int64) - in_b
    row = np.repeat(np.arange(len(edge_a) - 1), np.diff(edge_a))
    return row[own_a], a[own_a].astype(np.int64) << 32 | b[own_b]


def _sizes(paths: tuple[str, str]) -> tuple[np.ndarray, np.ndarray]:
    code = aligner(*paths)
    return code.size_a, code.size_b


def block_pairs(found: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """(block, a, b, n): each block's linked pairs and how many of its documents hold them; a block that is read in parts, or whose
    pairs pass a bound, gives several rows for a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, own, keys, counts, waiting = _sizes(paths), None, np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def merged() -> None:
            nonlocal keys, counts
            every = np.concatenate([keys, *[k for k, _ in waiting]])
            n = np.concatenate([counts, *[c for _, c in waiting]])
            order = np.argsort(every, kind="stable")
            every, n = every[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
            keys, counts = every[first], np.add.reduceat(n, first) if len(first) else n
            waiting.clear()

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal keys, counts
            merged()
            for i in range(0, len(keys), 1 << 16):
                k = keys[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), own, np.int64)), pa.array((k >> 32).astype(np.int32)), pa.array((k & 0xFFFFFFFF).astype(np.int32)), pa.array(counts[i : i + (1 << 16)].astype(np.int32))], ["block", "a", "b", "n"])
            keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        for batch in batches:
            blocks = batch.column("block").to_numpy()
            for x, y in _runs(blocks, batch):
                if blocks[x] != own or len(keys) > 1 << 22:
                    if own is not None:
                        yield from out()
                    own = int(blocks[x])
                rows = batch.slice(x, y - x)
                (a, edge), (b, _) = _unpacked(rows, "a"), _unpacked(rows, "b")
                if not len(a):
                    continue
                row, pair = _links(a, b, edge, sizes)
                order = np.lexsort((pair, row)) if y - x > 1 else np.argsort(pair, kind="stable")
                row, pair = row[order], pair[order]
                new = np.concatenate([[True], (pair[1:] != pair[:-1]) | (row[1:] != row[:-1])])
                waiting.append(np.unique(pair[new], return_counts=True))
                if sum(len(k) for k, _ in waiting) > 1 << 20:
                    merged()
        if own is not None:
            yield from out()

    return found.select("block", "a", "b").mapInArrow(run, "block long, a int, b int, n int")


def _runs(blocks: np.ndarray, batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Ranges of rows of one block, with about 2 MB of ids."""
    cut = np.flatnonzero(np.diff(blocks)) + 1
    off = tx.binary_column(batch, "a")[1]
    for x, y in zip([0, *cut.tolist()], [*cut.tolist(), len(blocks)], strict=True):
        if y > x:
            for p, q in tx.chunks(off[x : y + 1]):
                yield x + p, x + q


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, count, best): how many documents hold each pair linked, and the highest such count of its A id."""
    count = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    return count.join(count.groupBy("a").agg(F.max("count").alias("best")), "a")


def answers(pairs: DataFrame, counts: DataFrame) -> str:
    """The folder with a table for each block: (pair, count, best) of its pairs."""
    path = tx.scratch(pairs.sparkSession, "pair-counts")
    asked = pairs.select("block", "a", "b").join(counts, ["a", "b"])
    pair = (F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("pair")
    asked.select("block", pair, "count", "best").repartition("block").sortWithinPartitions("block", "pair").write.option("compression", "zstd").partitionBy("block").parquet(path)
    return path


def digests(found: DataFrame, folder: str, paths: tuple[str, str]) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, own = _sizes(paths), None
        write = Digits(max(map(len, sizes)))
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            for x, y in _runs(blocks, batch):
                rows = batch.slice(x, y - x)
                (a, ea), (b, eb), (ga, eg), (gb, _) = (_unpacked(rows, c) for c in COLUMNS)
                values = [np.diff(ea), np.diff(eb), np.diff(eg)]
                if len(a):
                    if blocks[x] != own:
                        own = int(blocks[x])
                        table = tx.read_folder(f"{folder}/block={own}")
                        pair, at = np.unique(table["pair"].to_numpy(), return_index=True)
                        count, best = table["count"].to_numpy()[at], table["best"].to_numpy()[at]
                    row, held = _links(a, b, ea, sizes)
                    at = np.searchsorted(pair, held)
                    edge = np.searchsorted(row, np.arange(y - x + 1))
                    total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v, dtype=np.int64)])[edge])  # noqa: B023, E731
                    values += [np.diff(edge), total(count[at] == best[at]), total(count[at])]
                else:
                    values += [np.zeros(y - x, np.int64)] * 3
                sums = [hashlib.sha256(s).hexdigest() if s else "" for s in write.rows(a, b, ga, gb, eg)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *[pa.array(v, pa.int64()) for v in values], pa.array(sums, pa.string())], ["doc_id", *names, "groups_sha256"])

    return found.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", groups_sha256 string")


class Digits:
    """Writes groups as `a1,a2|b1;a3|b2,b3`."""

    def __init__(self, n: int):
        width = len(str(n)) + 1
        self.text = np.frombuffer(b"".join(str(i).encode().ljust(width) for i in range(n)), np.uint8).reshape(n, width)
        self.size = np.array([len(str(i)) for i in range(n)], np.int64)

    def rows(self, a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, edge: np.ndarray) -> list[bytes]:
        """A string for each row; row i has the groups edge[i]:edge[i + 1]."""
        ends_a, ends_b = np.cumsum(ga), np.cumsum(gb)
        ids, sign = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[np.arange(len(a)) + np.repeat(ends_b - gb, ga)] = a
        ids[np.arange(len(b)) + np.repeat(ends_a, gb)] = b
        sign[ends_a + ends_b - gb - 1] = ord("|")
        sign[ends_a + ends_b - 1] = ord(";")
        size, text = self.size[ids], self.text[ids]
        text[np.arange(len(ids)), size] = sign
        out = text[np.arange(text.shape[1]) <= size[:, None]].tobytes()
        ends = np.concatenate([[0], np.cumsum(size + 1)])[np.concatenate([[0], ends_a + ends_b])[edge]]
        return [out[x : max(x, y - 1)] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def token_alignment(docs: DataFrame, tokenizers: tuple[str, str] | None = None, block: int = BLOCK) -> DataFrame:
    """Align, count linked pairs over the corpus, and read each document's groups and links back."""
    paths = tokenizers or default_tokenizers()
    found = tx.stored(aligned(docs, paths, block), "aligned")
    pairs = tx.stored(block_pairs(found, paths), "pairs")
    counts = tx.stored(pair_counts(pairs), "counts")
    folder = answers(pairs, counts)
    for done in (pairs, counts):
        tx.drop_stored(docs.sparkSession, done)
    return digests(found, folder, paths)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(tx.documents(spark, sf_dir))
