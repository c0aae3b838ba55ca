"""Fill-in-middle: texts are cut at units into prefix, middle and suffix, and written in PSM or SPM order with marks.

Units (lines by default) and marks inside the text are found by a finite automaton over bytes, scanned in parallel: a chunk
gives its transition function (the end state for each state it may be entered in) and its number of units for each of them.
Functions compose associatively, so that a chunk's entry state and units before it come from the chunks before it, and the chunk
that holds a cut is chosen by counts alone; inside the chunk the same composition is a tree that is walked down to the byte.

A text of one chunk is finished in the task that reads it. Longer texts are cut into chunks, which are stored, scanned in any
order and resolved from their functions: at most 2 GB / chunk of them belong to one row, as no Spark row is longer. Their output is a
table of pieces; a digest of it reads the pieces in order and holds one at a time.

Defined results: a null text is empty and plain; a null doc_id counts as no digits; rows that share a doc_id are documents of their
own; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import textops as tx

CHUNK = 32 << 10
MARKS = (b"<P>", b"<S>", b"<M>")
#: Which segment (0 prefix, 1 middle, 2 suffix) comes first, second and third in the output; the marks before them.
ORDER = {"psm": ((0, 2, 1), (0, 1, 2)), "spm": ((2, 0, 1), (1, 0, 2))}


@dataclass
class Automaton:
    """move[state, class] and hit[state, class] (1 where a byte of the class begins a unit), classes[byte]; starts in state 0."""

    classes: np.ndarray
    move: np.ndarray
    hit: np.ndarray

    @cached_property
    def settled(self) -> np.ndarray:
        """Classes of which a run moves like its first byte and hits at most there: only first bytes need be looked at."""
        again = np.take_along_axis(self.move, self.move.astype(np.int64), 0) == self.move
        return (again & (np.take_along_axis(self.hit, self.move.astype(np.int64), 0) == 0)).all(0)


def _classes(words: tuple[bytes, ...]) -> tuple[np.ndarray, list[bytes]]:
    """A class for each byte of the words, and 0 for all others."""
    known = sorted({bytes([b]) for w in words for b in w})
    classes = np.zeros(256, np.uint8)
    for i, b in enumerate(known):
        classes[b[0]] = i + 1
    return classes, [b"", *known]


def _keywords(words: tuple[bytes, ...], symbols: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(move, hit) over what was read of a word so far; a whole word hits and goes on from nothing."""
    states = [b"", *sorted({w[:i] for w in words for i in range(1, len(w))})]
    move, hit = np.zeros((len(states), len(symbols)), np.uint8), np.zeros((len(states), len(symbols)), np.int32)
    for i, had in enumerate(states):
        for c, b in enumerate(symbols):
            read = had + b if b else b""
            hit[i, c] = read in words
            rest = b"" if read in words else read
            move[i, c] = next(states.index(rest[k:]) for k in range(len(rest) + 1) if rest[k:] in states)
    return move, hit


def mark_finder(marks: tuple[bytes, ...] = MARKS) -> Automaton:
    """Hits at the last byte of each mark. No mark may hold its first byte twice, so that marks never overlap."""
    if any(m[:1] in n[1:] for m in marks for n in marks):
        raise ValueError("a mark's first byte must not stand inside a mark")
    classes, symbols = _classes(marks)
    return Automaton(classes, *_keywords(marks, symbols))


def line_automaton(marks: tuple[bytes, ...] = MARKS) -> Automaton:
    """Hits at the first byte of each line ``[^\\n]*\\n|[^\\n]+``; its last two states have read a mark (`marked`).

    The product of two automata: whether a line is open, and what of a mark was read (with a last state: one was found).
    """
    classes, symbols = _classes((*marks, b"\n"))
    move, hit = _keywords(marks, symbols)
    k, c = len(move) + 1, len(symbols)
    seen = np.vstack([np.where(hit > 0, k - 1, move), np.full((1, c), k - 1)])
    ends = np.array([b == b"\n" for b in symbols])
    out, hits = np.zeros((2 * k, c), np.uint8), np.zeros((2 * k, c), np.int32)
    for found in range(k):
        for open_ in (0, 1):
            state = 2 * found + open_
            out[state] = 2 * seen[found] + np.where(ends, 0, 1)
            hits[state] = 1 - open_
    return Automaton(classes, out, hits)


def marked(auto: Automaton, state: np.ndarray) -> np.ndarray:
    """Whether states of a line automaton are those after a mark."""
    return state >= len(auto.move) - 2


class Scan:
    """Functions and counts of chunks: data[offsets[i]:offsets[i + 1]] is chunk i; a tree over each chunk's bytes."""

    def __init__(self, auto: Automaton, data: np.ndarray, offsets: np.ndarray):
        of = auto.classes[data]
        keep = np.ones(len(data), bool)
        keep[1:] = (of[1:] != of[:-1]) | ~auto.settled[of[1:]]
        keep[offsets[:-1][np.diff(offsets) > 0]] = True
        self.at, self.n, self.offsets = np.flatnonzero(keep), len(auto.move), offsets
        edge = np.searchsorted(self.at, offsets)
        c = of[self.at]
        self.levels = [(edge[:-1], np.diff(edge), np.ascontiguousarray(auto.move.T[c]), np.ascontiguousarray(auto.hit.T[c]))]
        while len(self.levels[-1][1]) and self.levels[-1][1].max() > 1:
            self.levels.append(self._above(*self.levels[-1]))
        _, size, move, hit = self.levels[-1]
        self.move = np.broadcast_to(np.arange(self.n, dtype=np.uint8), (len(size), self.n)).copy()
        self.hit = np.zeros((len(size), self.n), np.int64)
        self.move[size > 0], self.hit[size > 0] = move, hit

    def _above(self, start: np.ndarray, size: np.ndarray, move: np.ndarray, hit: np.ndarray) -> tuple:
        """Neighbours composed two by two; the last of an odd number goes up alone."""
        half = (size + 1) // 2
        begin = np.cumsum(half) - half
        left = np.repeat(start - 2 * begin, half) + 2 * np.arange(int(half.sum()))
        pair = np.flatnonzero(left + 1 < np.repeat(start + size, half))
        up, ups = move[left], hit[left]
        mid = up[pair].astype(np.int64)
        up[pair] = np.take_along_axis(move[left[pair] + 1], mid, 1)
        ups[pair] += np.take_along_axis(hit[left[pair] + 1], mid, 1)
        return begin, half, up, ups

    def find(self, chunk: np.ndarray, state: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Where in `data` the k-th hit (from 0) of each chunk lies, when it is entered in `state`."""
        chunk, state, k, j = chunk.astype(np.int64), state.astype(np.int64), k.astype(np.int64), np.zeros(len(chunk), np.int64)
        for start, size, move, hit in self.levels[-2::-1]:
            left = start[chunk] + 2 * j
            here = hit[left, state]
            right = (k >= here) & (2 * j + 1 < size[chunk])
            k, j = np.where(right, k - here, k), 2 * j + right
            state = np.where(right, move[left, state], state)
        return self.at[self.levels[0][0][chunk] + j]


def _chars(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points before each offset: bytes that don't continue one."""
    run = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return run[offsets]


def _joined(form: str, segments: tuple, marks: tuple[bytes, ...]) -> bytes:
    if form == "plain":
        return b"".join(segments)
    return b"".join(marks[m] + segments[s] for s, m in zip(*ORDER[form], strict=True))


def restored(form: Column, output: Column, marks: tuple[bytes, ...] = MARKS) -> Column:
    """The text of an output: what follows the marks, in the order of the text."""
    parts = F.split(output.cast("string"), "|".join(f"\\Q{m.decode()}\\E" for m in marks))
    back = output.cast("string")
    for name, (order, _) in ORDER.items():
        back = F.when(form == name, F.concat(*[F.get(parts, F.lit(order.index(s) + 1)) for s in range(3)])).otherwise(back)
    return back


def _forms(n: Column, size: Column, found: Column, rate: int, spm: int) -> list[Column]:
    """(form, first, second): by the draws h1 to h4."""
    plain = (size == 0) | found | (F.col("h3") % 100 >= rate)
    a, b = F.col("h1") % (n + 1), F.col("h2") % (n + 1)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    return [form.alias("form"), F.least(a, b).alias("first"), F.greatest(a, b).alias("second")]


def _drawn(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, text, h1..h4): the first four groups of 8 hex digits of sha256(`seed:doc_id`)."""
    hex_ = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring(hex_, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), *draws)


WHOLE = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"


def _at_once(rows: DataFrame, rate: int, spm: int, marks: tuple[bytes, ...]) -> DataFrame:
    """Texts of one chunk, each finished where it is read."""
    auto = line_automaton(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, edges = tx.binary_column(batch, "text")
            for a, b in tx.chunks(edges):
                part = batch.slice(a, b - a)
                data, off = tx.binary_column(part, "text")
                scan, rows_ = Scan(auto, data, off), np.arange(b - a)
                n = scan.hit[:, 0]
                h = [part.column(f"h{i}").to_numpy() for i in range(1, 5)]
                plain = (np.diff(off) == 0) | marked(auto, scan.move[:, 0]) | (h[2] % 100 >= rate)
                form = np.where(plain, "plain", np.where(h[3] % 100 < spm, "spm", "psm"))
                x, y = h[0] % (n + 1), h[1] % (n + 1)
                cut = []
                for k in (np.minimum(x, y), np.maximum(x, y)):
                    inside = np.flatnonzero(k < n)
                    at = off[1:].copy()
                    at[inside] = scan.find(rows_[inside], np.zeros(len(inside)), k[inside])
                    cut.append(at)
                c0, c1, c2 = (_chars(data, p) for p in (off[:-1], *cut))
                raw = data.tobytes()
                out = [_joined(f, (raw[s:p], raw[p:q], raw[q:e]), marks) for f, s, p, q, e in zip(form.tolist(), off[:-1].tolist(), cut[0].tolist(), cut[1].tolist(), off[1:].tolist(), strict=True)]
                arrays = [part.column("doc_id"), pa.array(n), pa.array(form.tolist(), pa.string()), pa.array(c1 - c0, pa.int64(), mask=plain), pa.array(c2 - c1, pa.int64(), mask=plain), pa.array(out, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, WHOLE)


def _pieces(rows: DataFrame, chunk: int) -> DataFrame:
    """(doc, no, start, piece, and on piece 0 doc_id and the draws): long texts as rows of `chunk` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = tx.binary_column(batch, "text")
            for i, row in enumerate(batch.drop_columns(["text"]).to_pylist()):
                text, doc = data[off[i] : off[i + 1]], uuid.uuid4().hex
                for a in range(0, len(text), 64 * chunk):
                    starts = list(range(a, min(len(text), a + 64 * chunk), chunk))
                    head = lambda name: pa.array([row[name] if not s else None for s in starts], pa.int64())  # noqa: B023, E731
                    held = [pa.array([doc] * len(starts)), pa.array([s // chunk for s in starts], pa.int32()), pa.array(starts, pa.int64()), pa.array([text[s : s + chunk].tobytes() for s in starts], pa.binary())]
                    yield pa.RecordBatch.from_arrays([*held, *map(head, names)], ["doc", "no", "start", "piece", *names])

    names = ["doc_id", "h1", "h2", "h3", "h4"]
    return rows.mapInArrow(run, "doc string, no int, start long, piece binary, doc_id long, h1 long, h2 long, h3 long, h4 long")


ENTRY = ["doc", "no", "start", "size", "chars", "state", "leaves", "before", "hits"]


def resolved(pieces: DataFrame, auto: Automaton) -> DataFrame:
    """(doc, no, start, size, chars, state, leaves, before, hits) of (doc, no, start, piece): each chunk's entry state, exit state,
    units before it and its own. Chunks are scanned wherever they lie; only their functions come together, by document."""
    s = len(auto.move)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = tx.binary_column(batch, "piece")
            found = Scan(auto, data, off)
            flat = lambda x, kind: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), kind), s).cast(pa.list_(kind))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("no"), batch.column("start"), pa.array(np.diff(off)), pa.array(np.diff(_chars(data, off))), flat(found.move.astype(np.int32), pa.int32()), flat(found.hit, pa.int64())], ["doc", "no", "start", "size", "chars", "move", "hit"])

    def entered(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        run, total = (np.asarray(table.column(c).combine_chunks().flatten()).reshape(-1, s).astype(np.int64) for c in ("move", "hit"))
        step = 1
        while step < len(run):  # composed with what lies 1, 2, 4, ... chunks before
            left, lefts = run[:-step].copy(), total[:-step].copy()
            total[step:] = lefts + np.take_along_axis(total[step:], left, 1)
            run[step:] = np.take_along_axis(run[step:], left, 1)
            step *= 2
        state, before = np.concatenate([[0], run[:-1, 0]]), np.concatenate([[0], total[:-1, 0]])
        found = [pa.array(x) for x in (state, run[:, 0], before, total[:, 0] - before)]
        return pa.RecordBatch.from_arrays([*[table.column(c).combine_chunks() for c in ENTRY[:5]], *found], ENTRY)

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, []
        for batch in batches:
            docs = batch.column("doc").to_pylist()
            edges = [i for i in range(1, len(docs)) if docs[i] != docs[i - 1]]
            for a, b in zip([0, *edges], [*edges, len(docs)], strict=True):
                if held and docs[a] != own:
                    yield entered(held)
                    held = []
                own = docs[a] if b > a else own
                held += [batch.slice(a, b - a)] if b > a else []
        if held:
            yield entered(held)

    functions = pieces.select("doc", "no", "start", "piece").mapInArrow(scan, "doc string, no int, start long, size long, chars long, move array<int>, hit array<bigint>")
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not merged by their bytes
    return functions.repartition(n, "doc").sortWithinPartitions("doc", "no").mapInArrow(along, "doc string, no int, " + ", ".join(f"{c} long" for c in ENTRY[2:]))


def located(pieces: DataFrame, entries: DataFrame, targets: DataFrame, auto: Automaton) -> DataFrame:
    """(doc, which, at, chars) of (doc, which, k): the byte of the k-th unit and the code points before it, or the text's end
    where there are no more. Only chunks that hold a target are read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = tx.binary_column(batch, "piece")
            at = Scan(auto, data, off).find(np.arange(len(off) - 1), batch.column("state").to_numpy(), batch.column("k").to_numpy())
            chars = _chars(data, at) - _chars(data, off[:-1])
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("which"), pa.array(batch.column("start").to_numpy() + at - off[:-1]), batch.column("no"), pa.array(chars)], ["doc", "which", "at", "no", "chars"])

    asked = entries.join(targets, "doc").filter("before <= k and k < before + hits")
    asked = asked.select("doc", "no", "which", "state", (F.col("k") - F.col("before")).alias("k"))
    inside = pieces.select("doc", "no", "start", "piece").join(asked, ["doc", "no"]).select("doc", "which", "start", "no", "state", "k", "piece")
    found = inside.mapInArrow(run, "doc string, which int, at long, no int, chars long")
    places = targets.select("doc", "which").join(found, ["doc", "which"], "left")
    lead = entries.select("doc", F.col("no").alias("part"), F.col("size"), F.col("chars").alias("own"))
    sums = places.join(lead, "doc").groupBy("doc", "which").agg(F.first("at").alias("at"), F.first("chars").alias("chars"), F.first("no").alias("no"), F.sum("size").alias("size"), F.sum("own").alias("all"), F.sum(F.when(F.col("part") < F.col("no"), F.col("own")).otherwise(0)).alias("lead"))
    return sums.select("doc", "which", F.coalesce("at", "size").alias("at"), F.coalesce(F.col("chars") + F.col("lead"), "all").alias("chars"))


def _ranges(pieces: DataFrame, ranges: DataFrame) -> DataFrame:
    """(doc, at, piece): what of (doc, start, piece) lies in a range (doc, from, to, shift), `shift` bytes further."""
    p, r = pieces.select("doc", "start", "piece"), ranges.select("doc", "from", "to", "shift")
    held = p.join(r, "doc").withColumn("stop", F.col("start") + F.octet_length("piece"))
    a, b = F.greatest("start", "from"), F.least("stop", "to")
    cut = F.substring("piece", (a - F.col("start") + 1).cast("int"), (b - a).cast("int"))
    return held.filter(a < b).select("doc", (a + F.col("shift")).alias("at"), cut.alias("piece"))


def in_pieces(rows: DataFrame, rate: int, spm: int, marks: tuple[bytes, ...], chunk: int) -> tuple[DataFrame, DataFrame]:
    """Long texts: (doc, doc_id, n, form, prefix_chars, middle_chars), and their outputs as stored pieces (doc, at, piece)."""
    auto = line_automaton(marks)
    pieces = tx.stored(_pieces(rows, chunk), "pieces")
    entries = tx.stored(resolved(pieces, auto), "entries")
    totals = entries.groupBy("doc").agg(F.sum("hits").alias("n"), F.sum("size").alias("size"), F.max_by("leaves", "no").alias("state"))
    heads = pieces.filter("no = 0").select("doc", "doc_id", "h1", "h2", "h3", "h4")
    plan = heads.join(totals, "doc")
    plan = tx.stored(plan.select("doc", "doc_id", "n", "size", *_forms(F.col("n"), F.col("size"), F.col("state") >= len(auto.move) - 2, rate, spm)), "plan")
    targets = plan.filter("form <> 'plain'").select("doc", F.posexplode(F.array("first", "second")).alias("which", "k"))
    cuts = located(pieces, entries, targets, auto).groupBy("doc").agg(*[F.max(F.when(F.col("which") == i, F.col(c))).alias(f"{c}{i}") for i in (0, 1) for c in ("at", "chars")])
    shape = plan.join(cuts, "doc", "left")
    shape = tx.stored(shape.select("doc", "doc_id", "n", "form", "size", "at0", "at1", F.col("chars0").alias("prefix_chars"), (F.col("chars1") - F.col("chars0")).alias("middle_chars")), "shape")
    bounds = [F.lit(0).cast("long"), F.col("at0"), F.col("at1"), F.col("size")]
    ranges, signs = [shape.filter("form = 'plain'").select("doc", bounds[0].alias("from"), bounds[3].alias("to"), bounds[0].alias("shift"))], []
    for form, (order, named) in ORDER.items():
        own, out = shape.filter(F.col("form") == form), bounds[0]
        for s, m in zip(order, named, strict=True):
            signs.append(own.select("doc", out.alias("at"), F.lit(marks[m]).alias("piece")))
            out = out + len(marks[m])
            ranges.append(own.select("doc", bounds[s].alias("from"), bounds[s + 1].alias("to"), (out - bounds[s]).alias("shift")))
            out = out + bounds[s + 1] - bounds[s]
    output = _ranges(pieces, _all(ranges)).unionByName(_all(signs))
    output = tx.stored(output, "output")
    for done in (pieces, entries, plan):
        tx.drop_stored(rows.sparkSession, done)
    return shape.select("doc", "doc_id", "n", "form", "prefix_chars", "middle_chars"), output


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def digest(pieces: DataFrame, name: str) -> DataFrame:
    """(doc, name): SHA-256 of each document's (doc, at, piece) in order; a task holds a batch of pieces and one state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, None
        for batch in batches:
            docs, done = batch.column("doc").to_pylist(), []
            for doc, piece in zip(docs, batch.column("piece"), strict=True):
                if doc != own:
                    if own is not None:
                        done.append((own, state.hexdigest()))
                    own, state = doc, hashlib.sha256()
                state.update(piece.as_buffer())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in done]), pa.array([x for _, x in done])], ["doc", name])
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([state.hexdigest()])], ["doc", name])

    return pieces.select("doc", "at", "piece").repartition("doc").sortWithinPartitions("doc", "at").select("doc", "piece").mapInArrow(run, f"doc string, {name} string")


def restored_pieces(shape: DataFrame, output: DataFrame, marks: tuple[bytes, ...] = MARKS) -> DataFrame:
    """(doc, at, piece): the texts, rebuilt from output pieces and form: marks are found by the same parallel scan."""
    auto = mark_finder(marks)
    number = F.row_number().over(Window.partitionBy("doc").orderBy("at")) - 1
    pieces = tx.stored(output.select("doc", "at", "piece").withColumn("no", number.cast("int")).withColumnRenamed("at", "start"), "numbered")
    entries = tx.stored(resolved(pieces, auto), "entries")
    size = entries.groupBy("doc").agg(F.sum("size").alias("size"))
    targets = shape.filter("form <> 'plain'").select("doc", F.posexplode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("which", "k"))
    ends = located(pieces, entries, targets, auto).groupBy("doc").agg(*[F.max(F.when(F.col("which") == i, F.col("at") + 1)).alias(f"e{i}") for i in range(3)])
    known = shape.select("doc", "form").join(size, "doc").join(ends, "doc", "left")
    zero = F.lit(0).cast("long")
    ranges = [known.filter("form = 'plain'").select("doc", zero.alias("from"), F.col("size").alias("to"), zero.alias("shift"))]
    for form, (order, named) in ORDER.items():
        own = known.filter(F.col("form") == form)
        stops = [F.col("e1") - len(marks[named[1]]), F.col("e2") - len(marks[named[2]]), F.col("size")]
        length = {s: stops[i] - F.col(f"e{i}") for i, s in enumerate(order)}
        for i, s in enumerate(order):
            to = sum((length[x] for x in range(s)), zero)
            ranges.append(own.select("doc", F.col(f"e{i}").alias("from"), stops[i].alias("to"), (to - F.col(f"e{i}")).alias("shift")))
    return _ranges(pieces, _all(ranges))


def infilled(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, marks: tuple[bytes, ...] = MARKS, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts of one chunk (doc_id, n, form, prefix_chars, middle_chars, output); and for longer ones (doc, doc_id, n, form,
    prefix_chars, middle_chars) and their outputs as (doc, at, piece), pieces in order of `at`.

    `rate` of 100 documents are cut, `spm` of 100 of those are written suffix first; texts that hold a mark stay plain.
    """
    tx.shared_folder(docs.sparkSession)
    rows = _drawn(docs, seed)
    shape, output = in_pieces(rows.filter(F.octet_length("text") > chunk), rate, spm, marks, chunk)
    return _at_once(rows.filter(F.octet_length("text") <= chunk), rate, spm, marks), shape, output


def digests(whole: DataFrame, shape: DataFrame, output: DataFrame, marks: tuple[bytes, ...] = MARKS) -> DataFrame:
    """Per document, read from the outputs: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""

    sums = [F.sha2(x.cast("binary"), 256).alias(n) for x, n in ((F.col("output"), "output_sha256"), (restored(F.col("form"), F.col("output"), marks), "restored_sha256"))]
    long_ = shape.join(digest(output, "output_sha256"), "doc").join(digest(restored_pieces(shape, output, marks), "restored_sha256"), "doc").drop("doc")
    return whole.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *sums).unionByName(long_)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(*infilled(tx.documents(spark, sf_dir)))
