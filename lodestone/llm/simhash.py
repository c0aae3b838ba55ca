"""SimHash near-dedup by a self-join of binary tries.

A fingerprint bit is set when it is set in over half of the XXH64 hashes (seed 42) of the text's word shingles.
Equal fingerprints are one class. Two fingerprints that differ in at most k bits agree on one of k + 1 blocks of
bits at least, so the classes are dealt out once per block by the block's value; within a value their binary
trie is joined with itself: pairs of nodes are traversed together, differing bits add up, and a pair is dropped
as soon as it exceeds the budget of k bits. Pairs of nodes that already lie in one component are dropped too,
so a large group of near copies gives a spanning set of edges and not all its pairs. A block value held by over
`crowd` classes is dealt out as pairs of hashed portions: every pair of classes still meets.

Defined results: null and empty texts have fingerprint zero and link like any other; fewer words than a shingle
make one shingle of the whole sequence; component_id is the smallest doc_id reachable (null ids count as none).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import textops as tx
from lodestone.llm.graph import components, unite

BITS = 64
TASK_ROWS = 2_000_000  # dealt rows of a task, about
TASK_BYTES = 256 << 20  # of texts that a task verifies, one group after the other
GROUPED = 60_000  # rows whose tries are held at once; a larger group alone
_LANES = np.uint64(0x0101010101010101)


def bits_over_half(hashes: np.ndarray) -> int:
    """The majority of each bit over unsigned 64-bit hashes."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros((8, 8), np.int64)
    for at in range(0, n, 255 * 4096):  # byte lanes hold sums of up to 255 rows
        part = hashes[at : at + 255 * 4096]
        rows = -(-len(part) // 255)
        square = np.zeros(rows * 255, np.uint64)
        square[: len(part)] = part
        square = square.reshape(255, rows)
        for k in range(8):
            lanes = ((square >> np.uint64(k)) & _LANES).sum(axis=0, dtype=np.uint64)
            counts[k] += lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    out = 0
    for k in range(8):
        for byte in range(8):
            if 2 * counts[k, byte] > n:
                out |= 1 << (8 * byte + k)
    return out


def fingerprint(text: bytes | None, shingle: int) -> int:
    words = tx.lowered(text).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return bits_over_half(np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(words) - shingle] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    view = memoryview(joined)
    return bits_over_half(np.fromiter([digest(view[s:e], 42) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64, len(starts)))


def word_fingerprint(text: bytes | None) -> int:
    """Of a text's distinct words, each weighing by its length beyond three bytes: nearly blind to common words."""
    data = np.frombuffer(tx.lowered(text), np.uint8)
    starts, ends, _ = tx.word_spans(data, np.array([0, len(data)]))
    if not len(starts):
        return 0
    words, first = np.unique(tx.word_hashes(data, starts, ends), return_index=True)
    weight = np.clip((ends - starts)[first] - 3, 0.2, 12).astype(np.float32)
    balance = np.zeros(BITS, np.float64)
    for at in range(0, len(words), 65_536):
        bits = np.unpackbits(words[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        balance += weight[at : at + 65_536] @ (bits.astype(np.float32) * 2 - 1)
    return int.from_bytes(np.packbits(balance > 0, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row, from whole texts; fp is the fingerprint as a signed long. Shingle 0: distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) if shingle else word_fingerprint(t.as_py()) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def trie_join(group: np.ndarray, fp: np.ndarray, budget: int, width: int = 400_000) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j) that span the components, within each group, of fingerprints at most `budget` bits apart.

    `group` and `fp` are sorted by (group, fp). Nodes of the trie are ranges of the sorted fingerprints. The
    traversal goes depth by depth over at most `width` pairs of nodes at a time, deepest first, so its memory
    doesn't grow with the pairs.
    """
    n = len(fp)
    parent = np.arange(n)
    if n < 2:
        return parent[:0], parent[:0]
    zeros = np.zeros((BITS, n + 1), np.int32)
    for d in range(BITS):
        np.cumsum((fp >> np.uint64(BITS - 1 - d)) & np.uint64(1) == 0, out=zeros[d, 1:])
    cut = np.flatnonzero(np.diff(group)) + 1
    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [n]])
    some = hi - lo > 1
    lo, hi = lo[some], hi[some]
    todo = [(0, lo, hi, lo, hi, np.zeros(len(lo), np.int16))]
    while todo:
        depth, al, ah, bl, bh, dist = todo.pop()
        if len(al) > width:
            todo += [(depth, al[at : at + width], ah[at : at + width], bl[at : at + width], bh[at : at + width], dist[at : at + width]) for at in range(0, len(al), width)]
            continue
        joined = np.concatenate([[0], np.cumsum(parent[1:] == parent[:-1])])  # ranges of one component
        same = (joined[ah - 1] - joined[al] == ah - 1 - al) & (joined[bh - 1] - joined[bl] == bh - 1 - bl) & (parent[al] == parent[bl])
        al, ah, bl, bh, dist = (x[~same] for x in (al, ah, bl, bh, dist))
        near = ((ah - al) * (bh - bl) <= 16) | (depth == BITS)
        if near.any():
            a, b, na, nb = al[near], bl[near], (ah - al)[near], (bh - bl)[near]
            size = na * nb
            of = np.repeat(np.arange(len(a)), size)
            k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            i, j = a[of] + k // nb[of], b[of] + k % nb[of]
            ok = (i < j) & (parent[i] != parent[j])
            i, j = i[ok], j[ok]
            ok = np.bitwise_count(fp[i] ^ fp[j]) <= budget
            unite(parent, i[ok], j[ok])
        al, ah, bl, bh, dist = (x[~near] for x in (al, ah, bl, bh, dist))
        if not len(al):
            continue
        z = zeros[depth]
        am, bm, own = al + z[ah] - z[al], bl + z[bh] - z[bl], al == bl
        pairs = [(al, am, bl, bm, dist), (am, ah, bm, bh, dist), (al, am, bm, bh, dist + 1)]
        pairs.append((am[~own], ah[~own], bl[~own], bm[~own], dist[~own] + 1))
        al, ah, bl, bh, dist = (np.concatenate(x) for x in zip(*pairs, strict=True))
        ok = (ah > al) & (bh > bl) & (dist <= budget) & ~((al == bl) & (ah - al < 2))
        todo.append((depth + 1, al[ok], ah[ok], bl[ok], bh[ok], dist[ok]))
    i = np.flatnonzero(parent != np.arange(n))
    return i, parent[i]


def agreement(classes: int, budget: int, bucket: int = 256) -> int:
    """The fewest blocks to agree on for which random fingerprints leave `bucket` classes a value or fewer."""
    agree = 1
    while agree < 8 and bucket * 2 ** (BITS * agree / (budget + agree)) < classes:
        agree += 1
    return agree


def links(classes: DataFrame, budget: int = 3, agree: int = 1, crowd: int = 100_000) -> DataFrame:
    """Edges (a, b) between fingerprints of `classes` (fp) that span all components within the budget.

    With budget + agree blocks, two fingerprints within the budget agree on `agree` blocks at least: more blocks to
    agree on give more, smaller buckets. Fingerprints of several kinds (a column kind) meet their own kind only, which
    then stands in the edges.
    """
    spark = classes.sparkSession
    blocks = budget + agree
    edge = [round(BITS * k / blocks) for k in range(blocks + 1)]
    pick = lambda k: F.shiftrightunsigned("fp", edge[k]).bitwiseAND((1 << edge[k + 1] - edge[k]) - 1)
    chosen = list(itertools.combinations(range(blocks), agree))
    value = [reduce(lambda x, k: F.shiftleft(x, edge[k + 1] - edge[k]).bitwiseOR(pick(k)), c[1:], pick(c[0])) for c in chosen]
    kinds = "kind" in classes.columns
    number = lambda k: F.col("kind") * len(chosen) + k if kinds else F.lit(k)
    part = F.explode(F.array(*[F.struct(number(k).alias("block"), v.alias("value")) for k, v in enumerate(value)]))
    dealt = classes.select("fp", part.alias("p")).select("fp", "p.block", "p.value")
    # how crowded a value is only decides how it is dealt out, so an estimate from the classes of some hashes is enough
    rate = max(1, crowd // 1000)
    some = dealt.filter(F.pmod(F.xxhash64("fp", F.lit(5)), F.lit(rate)) == 0)
    crowded = tx.stored(some.groupBy("block", "value").agg((F.count("*") * rate).alias("n")).filter(F.col("n") > crowd), "crowded")
    if not crowded.isEmpty():
        dealt = dealt.join(crowded, ["block", "value"], "left")
        portions = F.ceil(F.coalesce("n", F.lit(1)) / crowd).cast("int")
        mine = F.pmod(F.xxhash64("fp"), portions).cast("int")
        meets = F.when(portions == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), portions - 1), lambda k: k != mine))
        dealt = dealt.select("fp", "block", "value", mine.alias("mine"), F.explode(meets).alias("other"))
        dealt = dealt.select("fp", "block", "value", F.least("mine", "other").alias("lower"), F.greatest("mine", "other").alias("upper"))
    else:
        dealt = dealt.select("fp", "block", "value", F.lit(0).alias("lower"), F.lit(0).alias("upper"))
    keys = ["block", "value", "lower", "upper"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        fp = table.column(0).to_numpy().view(np.uint64)
        group = table.column(1).to_numpy().view(np.uint64)
        order = np.lexsort((fp, group))
        fp, group = fp[order], group[order]
        kind = table.column(2).to_numpy()[order] if kinds else None
        cut = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
        a = 0
        while a < len(fp):  # whole groups, some at a time: the tries' tables stay small
            b = max(int(cut[np.searchsorted(cut, a + GROUPED, "right") - 1]), int(cut[np.searchsorted(cut, a, "right")]))
            i, j = trie_join(group[a:b], fp[a:b], budget)
            found = [pa.array(fp[a:b][i].view(np.int64)), pa.array(fp[a:b][j].view(np.int64))]
            if kinds:
                found.append(pa.array(kind[a:b][i]))
            if len(i):
                yield pa.RecordBatch.from_arrays(found, ["a", "b", "kind"][: len(found)])
            a = b

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-classes.count() * len(chosen) // TASK_ROWS))
    also = [F.floor(F.col("block") / len(chosen)).cast("int").alias("kind")] if kinds else []
    return dealt.select("fp", F.xxhash64(*keys).alias("task"), *also).repartition(n, "task").mapInArrow(run, "a long, b long" + (", kind int" if kinds else ""))


def near_dedup(docs: DataFrame, shingle: int = 3, budget: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of (doc_id, text)."""
    marked = tx.stored(fingerprints(docs, shingle), "fingerprints")
    classes = tx.stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "classes")
    found = components(links(classes.select("fp"), budget, agreement(classes.count(), budget)))
    rooted = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return marked.join(rooted.join(tx.dealt_anew(least, "root"), "root").select("fp", "component_id"), "fp")


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """Distinct hashes of a text's shingles of lower-cased words (a shorter text: of the whole)."""
    data = np.frombuffer(text or b"", np.uint8)
    starts, ends, _ = tx.word_spans(data, np.array([0, len(data)]))
    h = tx.word_hashes(data, starts, ends, lower=True)
    if not len(h):
        return h
    k = min(shingle, len(h))
    with np.errstate(over="ignore"):
        x = h[: len(h) - k + 1].copy()
        for j in range(1, k):
            x = tx.mix(x) + h[j : len(h) - k + 1 + j]
    return np.unique(x)


@lru_cache
def _hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    """What `n` hashes flip and multiply by."""
    flip, factor = np.random.default_rng(17).integers(0, 1 << 32, (2, n, 1), dtype=np.uint32)
    return flip, factor | np.uint32(1)


def minwise_fingerprints(found: np.ndarray, kinds: int) -> np.ndarray:
    """`kinds` fingerprints of a shingle set: a bit of the least shingle under each of 64 hashes a fingerprint.

    Two sets differ in each bit with half of one minus their Jaccard similarity, whatever was edited.
    """
    if not len(found):
        return np.zeros(kinds, np.uint64)
    flip, factor = _hashes(kinds * BITS)
    least = np.full(kinds * BITS, np.iinfo(np.uint32).max)
    found = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(found), 512):
        x = found[at : at + 512] ^ flip
        x *= factor
        np.minimum(least, x.min(axis=1), out=least)
    bits = (tx.mix(least.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits.reshape(kinds, BITS), axis=1, bitorder="little").view(np.uint64)[:, 0]


def _minwise(texts: DataFrame, shingle: int, kinds: int) -> DataFrame:
    """(doc_id, kind, fp) of every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [minwise_fingerprints(shingle_set(t.as_py(), shingle), kinds) for t in batch.column(1)]
            fp = np.concatenate([np.zeros(0, np.uint64), *found])
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), kinds)))
            kind = np.tile(np.arange(kinds, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([ids, pa.array(kind), pa.array(fp.view(np.int64))], ["doc_id", "kind", "fp"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, kind int, fp long")


def candidates(texts: DataFrame, shingle: int, budget: int, kinds: int) -> DataFrame:
    """(doc_id, leader): components, by their smallest id, of rows with a fingerprint of a kind within the budget."""
    marked = tx.stored(_minwise(texts, shingle, kinds), "fingerprints")
    classes = tx.stored(marked.groupBy("kind", "fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    few = classes.select("kind", "fp", "least")
    near = links(classes.select("fp", "kind"), budget, agreement(classes.count() // kinds, budget)).distinct()
    near = near.join(few.withColumnsRenamed({"fp": "a", "least": "x"}), ["kind", "a"]).join(few.withColumnsRenamed({"fp": "b", "least": "y"}), ["kind", "b"]).select("x", "y")
    same = marked.join(classes.filter("n > 1").select("kind", F.col("fp").bitwiseXOR(F.lit(0).cast("long")).alias("fp"), "least"), ["kind", "fp"]).select(F.col("doc_id").alias("x"), F.col("least").alias("y"))
    found = components(near.unionByName(same).toDF("a", "b"))
    return found.select(F.col("node").alias("doc_id"), F.col("root").alias("leader")).unionByName(found.select(F.col("root").alias("doc_id"), F.col("root").alias("leader")).distinct())


def linked(ids: np.ndarray, sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """The smallest id that each row reaches over pairs of shingle sets with this Jaccard similarity or more.

    A row is counted against all others at once over the shingles they share; all rows are, unless all are one
    already. Rows of one id are one; sets without shingles are alike.
    """
    n, size = len(ids), np.array([len(x) for x in sets])
    label = np.unique(ids, return_inverse=True)[1]
    if (size == 0).any():
        label[np.isin(label, label[size == 0])] = label[size == 0].min()
    keys, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(keys, kind="stable")
    ranked, holder = keys[order], owner[order]
    lo, hi = np.searchsorted(ranked, keys, "left"), np.searchsorted(ranked, keys, "right")
    first = np.cumsum(size) - size
    for x in range(n):
        if (label == label[0]).all():
            break
        a, b = lo[first[x] : first[x] + size[x]], hi[first[x] : first[x] + size[x]]
        many = b - a
        place = np.repeat(a - (np.cumsum(many) - many), many) + np.arange(many.sum())
        both = np.bincount(holder[place], minlength=n)
        union = size[x] + size - both
        alike = np.flatnonzero((both > 0) & (both >= similarity * union - 1e-9))
        if len(alike):
            label[np.isin(label, label[alike])] = label[alike].min()
    return np.unique(ids)[label]


def _verified(shingle: int, similarity: float):
    """Rows (task, leader, whole, doc_id, text), sorted by task, to (a, b, whole): each id with the smallest it reaches in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def edges() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                ids = np.array([i for i, _ in held])
                least = linked(ids, [x for _, x in held], similarity)
                moved = ids != least
                yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(least[moved]), pa.array(np.full(moved.sum(), now[2]))], ["a", "b", "whole"])

        for batch in batches:
            for task, leader, whole, doc, text in zip(*batch.columns, strict=True):
                if now != (key := (task.as_py(), leader.as_py(), whole.as_py())):
                    yield from edges()
                    now, held = key, []
                held.append((doc.as_py(), shingle_set(text.as_py(), shingle)))
        yield from edges()

    return run


def representatives(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, budget: int = 8, kinds: int = 4, crowd: int = 300, room: int = 32 << 20) -> DataFrame:
    """`docs` without near copies: of each group one row, that of the smallest id, stays in all its columns.

    Equal texts go at once. Of the others, fingerprints of the shingle sets propose components. In each, every pair of
    rows not yet in one group is held against each other on whole shingle sets; pairs alike by `similarity` or more
    are the links of the groups. A component of over `crowd` rows or `room` bytes is dealt out as pairs of hashed
    portions: every pair still meets. Texts without words are alike; null ids stay.
    """
    spark = docs.sparkSession
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("text"))
    keyed = tx.stored(texts.select("doc_id", F.sha2("text", 256).alias("digest")), "digests")
    least = keyed.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1").select("digest", "least")
    equal = keyed.join(tx.dealt_anew(least, "digest"), "digest").filter("doc_id > least").select("doc_id").distinct()
    gone = tx.stored(equal, "equal")
    rest = tx.without(texts, gone)
    open_ = tx.stored(candidates(rest, shingle, budget, kinds), "members")
    members = rest.join(open_, "doc_id")
    size = members.groupBy("leader").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    size = tx.stored(size.select("leader", F.greatest(F.ceil(F.col("n") / crowd), F.ceil(F.col("bytes") / room), F.lit(1)).cast("int").alias("portions"), "bytes"), "sizes")
    bytes_ = size.agg(F.sum(F.col("bytes") * F.greatest(F.col("portions") - 1, F.lit(1)))).first()[0] or 0
    mine = F.pmod(F.xxhash64("doc_id"), F.col("portions")).cast("int")
    meets = F.when(F.col("portions") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("portions") - 1), lambda k: k != mine))
    dealt = members.join(size.drop("bytes"), "leader").select("leader", "portions", mine.alias("mine"), "doc_id", "text", F.explode(meets).alias("other"))
    dealt = dealt.select(F.xxhash64("leader", F.least("mine", "other"), F.greatest("mine", "other")).alias("task"), "leader", (F.col("portions") == 1).alias("whole"), "doc_id", "text")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-bytes_ // TASK_BYTES))
    dealt = dealt.repartition(n, "task").sortWithinPartitions("task", "leader")
    found = tx.stored(dealt.mapInArrow(_verified(shingle, similarity), "a long, b long, whole boolean"), "verified")
    gone = gone.unionByName(found.filter("whole").select(F.col("a").alias("doc_id")))
    parted = found.filter("not whole")
    if not parted.isEmpty():
        gone = gone.unionByName(components(parted.select("a", "b")).select(F.col("node").alias("doc_id")))
    # rows that repeat an id are copies of one document: the first of equal rows is enough
    return tx.without(docs, gone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(tx.documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
