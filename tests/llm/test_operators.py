"""The operators against brute force, on documents with nulls, empty, long, tied and repeated texts."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, exact_dedup, graph, html_text, katz, mixing, quality, simhash, substring, token_files, toxicity
from lodestone.llm import textops as tx

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, digest string, label int"


def _rows():
    r = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["the", "of"] * 20
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    texts = [make(r.randint(1, 120)) for _ in range(40)]
    shared = make(45)
    texts += [f"{make(15)} {shared} {make(10)}" for _ in range(12)]
    texts += [texts[5]] * 6 + [texts[41].replace(" ", "\t\n", 3)] * 2
    base = make(200).split()
    for _ in range(8):
        near = list(base)
        near[r.randrange(200)] = "edit"
        texts.append(" ".join(near))
    texts += [None, "", " ", "\n", "one", "One TWO", "x" * 50_000, make(20_000), "café été ÀÉ naïve", make(19), make(20)]
    return [(i, t, r.choice(["en", "de", None]), r.choice(["a", "b", None]), len(t or ""), 1, "d", 0) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = _rows()
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def texts():
    return {r[0]: (r[1] or "").encode() for r in _rows()}


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_primitives(texts):
    data = np.frombuffer(b"".join(texts.values()), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts.values()])]).astype(np.int64)
    starts, ends, rows = tx.word_spans(data, off)
    assert [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == [w for t in texts.values() for w in t.split()]
    assert rows.tolist() == [len(t.split()) for t in texts.values()]
    h = tx.word_hashes(data, starts, ends)
    seen = {}
    for a, b, x in zip(starts, ends, h.tolist(), strict=True):
        assert seen.setdefault(data[a:b].tobytes(), x) == x
    assert len(set(seen.values())) == len(seen)


def _cut(rows, size=20):
    """Brute force: (doc_id, n_words, n_removed, kept_sha256) of (doc_id, text) rows in order; equal rows of one id are one."""
    seen, want = {}, []
    for i, t in rows:
        w, gone = t.split(), [False] * len(t.split())
        for k in range(len(w) - size + 1):
            first = seen.setdefault(tuple(w[k : k + size]), (i, tuple(w), k))
            if first[:2] != (i, tuple(w)) or first[2] < k:
                gone[k : k + size] = [True] * size
        want.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return want


@pytest.mark.parametrize("levels", [1, 2])
def test_substring(docs, texts, none, levels):
    assert sorted(tuple(r)[:4] for r in substring.substring_dedup(docs, levels=levels).collect()) == sorted(_cut(texts.items()))
    assert substring.substring_dedup(none).count() == 0


def test_substring_repeated_ids(spark):
    r = random.Random(8)
    make = lambda n: " ".join(f"w{r.randrange(9**6)}" for _ in range(n))
    shared = make(30)
    rows = [(1, make(25)), (2, f"{make(5)} {shared}"), (2, f"{shared} {make(9)}"), (3, shared), (3, shared), (None, shared), (4, f"{shared} {make(3)}")]
    by = lambda x: (x[0], hashlib.sha256(x[1].encode()).digest())
    want = _cut([(i, t.encode()) for i, t in sorted((x for x in rows if x[0]), key=by)])
    got = [tuple(x)[:4] for x in substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(x for x in got if x[0]) == sorted(want)
    assert [x[1:3] for x in got if x[0] is None] == [(30, 0)]


def test_substring_longest(spark):
    r = random.Random(4)
    make = lambda n: " ".join(f"w{r.randrange(9**6)}" for _ in range(n))
    long, some = make(400), make(90)
    rows = [(1, f"{make(50)} {long}"), (2, f"{long} {make(7)}"), (3, f"{some} {make(5)}"), (4, f"{make(30)} {some}"), (5, make(300)), (6, f"{make(3)} {make(30)}"), (7, make(45))]
    rows.append((8, rows[6][1]))
    want, seen = Counter(), {}
    for i, t in rows[:-1]:
        data = t.encode()
        starts, ends, _ = tx.word_spans(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        h = tx.word_hashes(np.frombuffer(data, np.uint8), starts, ends)
        one = tx.mix(substring.windows(h, 20))
        for size in (40, 80, 160, 320):
            for k in range(len(h) - size + 1):
                if one[k : k + size - 19].min() == one[k]:
                    seen.setdefault((size, h[k : k + size].tobytes()), []).append(i)
    for (size, _), ids in seen.items():
        for i in ids if len(ids) > 1 else ():
            want[i] = max(want[i], size)
    got = {x.doc_id: x.longest for x in substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: want[i] for i in range(1, 8)} | {8: 40} and want[1] == want[2] >= 80 and want[4] == 40


def test_substring_longest_repeat(spark):
    """repeats are followed from every place, not only from their least window."""
    r = random.Random(14)
    make = lambda n: " ".join(f"w{r.randrange(9**6)}" for _ in range(n))
    rows, want = [], {}
    for i, n in enumerate((20, 39, 40, 45, 90, 159, 160, 400, 700)):
        shared = make(n)
        rows += [(2 * i, f"{make(11)} {shared}"), (2 * i + 1, f"{shared} {make(5)}")]
        want |= {2 * i + k: 20 << (n // 20).bit_length() - 1 for k in (0, 1)}
    rows += [(50, make(60)), (51, f"{make(40)} a " * 2), (52, make(45))]
    rows += [(53, rows[-1][1]), (54, make(19)), (55, rows[-1][1]), (None, rows[0][1])]
    want |= {50: 0, 51: 40, 52: 40, 53: 40, 54: 0, 55: 40, None: 0}
    got = {x.doc_id: x.longest_repeat for x in substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def _katz(tokens, train, order):
    """Brute force: (unigram counts, probability of a word after a context). A context is START or (context before, word)."""
    counts = [Counter(), *(Counter() for _ in range(order))]

    def contexts(t, k):
        return [()] * len(t) if k == 1 else ["START", *zip(contexts(t, k - 1), t, strict=True)][: len(t)]

    for i in train:
        for k in range(1, order + 1):
            counts[k].update(zip(contexts(tokens[i], k), tokens[i], strict=True))
    total = [Counter(), *(Counter() for _ in range(order))]
    after = [{}, *({} for _ in range(order))]
    for k in range(1, order + 1):
        for (h, w), c in counts[k].items():
            total[k][h] += c
            after[k].setdefault(h, []).append(w)
    d = [None, *(katz.discounts(np.array([Counter(c.values())[r] for r in range(1, katz.K + 2)])) for c in counts[1:])]
    cut = lambda k, c: (d[k][c] if c <= katz.K else 1) * c

    def shorter(k, h):
        if k == 2:
            return ()
        return h if h == "START" else (shorter(k - 1, h[0]), h[1])

    @lru_cache(None)
    def left(k, h):
        """(scale of the seen, what is freed, the lower orders' share of the seen)"""
        n = total[k][h]
        free = sum(counts[k][h, w] - cut(k, counts[k][h, w]) for w in after[k][h])
        bare = free <= 1e-12
        return (n / (n + 1) if bare else 1.0), (n / (n + 1) if bare else free) / n, sum(p(k - 1, shorter(k, h), w) for w in after[k][h]) if k > 1 else 0.0

    def p(k, h, w):
        if not total[k][h]:
            return p(k - 1, shorter(k, h), w) if k > 1 else 1.0
        scale, free, seen = left(k, h)
        if k == 1 and scale < 1:
            free = 1 / (total[k][h] + 1)
        if counts[k][h, w]:
            return scale * cut(k, counts[k][h, w]) / total[k][h]
        return free / (1 - seen) * p(k - 1, shorter(k, h), w) if k > 1 else free

    return Counter({w: c for (_, w), c in counts[1].items()}), p, contexts


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz(spark, docs, texts, none, tmp_path, order):
    got = {r.doc_id: r for r in katz.score(docs, order=order, folder=f"file://{tmp_path}/model").collect()}
    d = {i: [*t.lower().split(), 0] for i, t in texts.items()}
    train = [i for i in d if zlib.crc32(str(i).encode()) % 7 != 2]
    u, p, contexts = _katz(d, train, order)
    n, v = sum(u.values()), len(u)
    seen = {h for t in d.values() for h in contexts(t, order)}
    for h in sorted(seen, key=str)[:20]:  # exactly normalised, with one class of unknown words
        assert abs(sum(p(order, h, w) for w in u) + p(order, h, "never seen") - 1) < 1e-9
    for i, t in d.items():
        want = sum(math.log10(p(order, h, w)) for h, w in zip(contexts(t, order), t, strict=True))
        r = got[i]
        assert abs(r.score - want) < 1e-6 * max(1, -want)
        assert abs(r.base_score - sum(math.log10((u[w] + 1) / (n + v + 1)) for w in t)) < 1e-6 * max(1, -want)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(u[w] > 0 for w in t), n, i not in train)
    if order > 1:  # the tables alone give distributions that sum to one
        ngrams, known = (spark.read.parquet(f"{tmp_path}/model/{x}{order}") for x in ("ngrams", "contexts"))
        assert known.groupBy("context").count().filter("count > 1").isEmpty()
        counts_of = ngrams.groupBy("n").count().collect()
        q = katz.discounts(np.array([sum(r["count"] for r in counts_of if r.n == k) for k in range(1, katz.K + 2)]))
        kept = F.col("n") * F.when(F.col("n") <= katz.K, F.array(*map(F.lit, q.tolist()))[F.least("n", F.lit(katz.K)).cast("int")]).otherwise(1.0)
        sums = ngrams.groupBy("context").agg(F.sum(kept).alias("mass"), F.sum("lower").alias("lower")).join(known, "context")
        assert sums.filter(F.abs(F.col("kept") * F.col("mass") / F.col("total") + F.col("weight") * (1 - F.col("lower")) - 1) > 1e-9).isEmpty()
        assert ngrams.agg(F.sum("n")).first()[0] == n and sums.count() == known.count()
    assert katz.score(none, order=order).count() == 0


def test_katz_repeated_ids(spark):
    rows = [(1, "a b"), (1, "a b c"), (None, "b c"), (2, None)]
    got = katz.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 3), (1, 3), (1, 4), (2, 1)]


def test_mixing(docs, texts, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(texts) and all(r["size"] == len(texts[r.doc_id].split()) and r.copies <= 3 for r in rows)
    plan = {r.source: (r.source_size, r.target) for r in rows}
    assert abs(sum(t for _, t in plan.values()) - sum(s for s, _ in plan.values())) < 1e-6
    again = {r.doc_id: r.copies for r in mixing.mix(docs.repartition(3)).collect()}
    assert all(again[r.doc_id] == r.copies for r in rows)
    assert mixing.emitted(docs).columns == docs.columns and mixing.mix(none).count() == 0


def test_clashing_names(spark):
    names = ["size", "source_size", "target", "rate", "copies", "plan", "copy", "_bytes", "_score", "_flagged", "h", "digest", "n", "least", "leader", "task"]
    r = random.Random(4)
    word = lambda: "".join(r.choice("aeioust") for _ in range(5))
    rows = [(i, " ".join([*(word() for _ in range(30)), *(["zork"] if i % 5 == 0 else [])]), "en", "ab"[i % 2], *range(99, 99 + len(names))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` int" for c in names))
    labels = spark.createDataFrame([(r[0], int(r[0] % 5 == 0)) for r in rows], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, rows[1][1])], "item_id long, text string")
    for stage in (lambda d: toxicity.clean(d, labels), simhash.representatives, lambda d: decontaminate.clean(d, bench), mixing.emitted):
        out = stage(docs)
        assert out.columns == docs.columns
        got = {tuple(x) for x in out.collect()}
        assert got and got <= {tuple(x) for x in rows}
    assert mixing.mix(docs).select("size").distinct().count() == 2


def test_water_filling(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1), ("c", 10), (None, 50)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["b"] == 3 and got["c"] == 30 and abs(got["a"] - 64) < 1e-9 and abs(got[None] - 64) < 1e-9


def test_token_files(docs, texts, none):
    from tokenizers import Tokenizer

    t, base = Tokenizer.from_file(token_files.default_tokenizer()), 0
    got = {r.doc_id: tuple(r)[1:] for r in token_files.token_files(docs).collect()}
    for i in sorted(texts):
        ids = [*t.encode(texts[i].decode(), add_special_tokens=False).ids, 1]
        assert got[i] == (base, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        base += len(ids)
    assert token_files.token_files(none).count() == 0


def test_token_files_repeats_and_nulls(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.default_tokenizer())
    rows = [(3, "some words"), (3, "other words here"), (None, "no id"), (None, None), (-4, "first")]
    got = token_files.token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = Counter((i, zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for i, x in rows)
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [-4, 3, 3, None, None] and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    token_files.write_files(docs, f"file://{tmp_path}/tokens", token_files.default_tokenizer()).collect()
    assert not [f.name for f in (tmp_path / "tokens").iterdir() if f.name.startswith(".")]


def test_encoder_on_odd_words():
    e = token_files.Encoder(token_files.default_tokenizer(), limit=10)
    odd = ["it's I'LL don't", "<|endoftext|> a<|startoftext|>b", "ÀÉÎ ß ×÷ İstanbul", "é ́x", "a1b2 99 !!?? x--y", "日本語 テスト", "a b c", "ﬁ Ⅳ \x1c\x1d z"]
    ids, n = e.encode([o.encode() for o in odd])
    want = [e.tokenizer.encode(o, add_special_tokens=False).ids for o in odd]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def _components(fp, budget):
    root = list(range(len(fp)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(fp)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fp))]


def test_simhash(docs, texts, none):
    fp = []
    for t in texts.values():
        w = t.lower().split()
        s = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        fp.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    want = _components(fp, 3)
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_dedup(docs).collect()}
    assert got == {i: (fp[i], want[i]) for i in range(len(fp))}
    assert simhash.near_dedup(none).count() == 0


def test_simhash_repeats_and_nulls(spark):
    rows = [(5, "one two three four"), (5, "one two three four"), (None, "one two three four"), (None, None), (2, ""), (9, "other words stand here now")]
    got = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 2), (0, 5), (2, 2), (5, 5), (5, 5), (9, 9)]


@pytest.mark.parametrize(("budget", "agree", "crowd"), [(3, 1, 100_000), (3, 1, 5), (6, 2, 100_000)])
def test_trie_join(spark, budget, agree, crowd):
    r = random.Random(budget + crowd)
    fp = [r.getrandbits(64) for _ in range(60)]
    fp += [f ^ sum(1 << b for b in r.sample(range(64), r.randint(1, budget + 1))) for f in fp for _ in range(3)]
    fp = sorted(set(fp))
    want = _components(fp, budget)
    signed = [f - (1 << 64) if f >> 63 else f for f in fp]
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), budget, agree, crowd).collect()
    place, root = {s: i for i, s in enumerate(signed)}, list(range(len(fp)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for e in edges:
        a, b = find(place[e.a]), find(place[e.b])
        root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(fp))] == want


@pytest.mark.parametrize("room", [2_000_000, 40])
def test_components(spark, room):
    r = random.Random(room)
    edges = [(r.randrange(-60, 200), r.randrange(-60, 200)) for _ in range(130)] + [(300, k) for k in range(301, 340)] + [(k, k + 1) for k in range(400, 440)] + [(5, 5), (None, 7)]
    root = {}
    for a, b in edges:
        if a is not None and a != b:
            x, y = root.setdefault(a, a), root.setdefault(b, b)
            root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "a long, b long"), room).collect()}
    assert got == {k: v for k, v in root.items() if k != v}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_representatives(docs, texts):
    kept = {r.doc_id for r in simhash.representatives(docs).collect()}
    near = [i for i, t in texts.items() if b" edit " in t or t.endswith(b" edit")]
    assert len(kept & set(near)) == 1 and {6, 7, 8} <= kept and not kept & set(range(52, 58))


def _jaccard(a, b, k=5):
    a, b = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set() for w in (a.split(), b.split()))
    return len(a & b) / len(a | b) if a | b else 1.0


def _brute_groups(texts, similarity=0.8):
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if _jaccard(texts[i], texts[j]) >= similarity:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return root


@pytest.mark.parametrize("room", [32 << 20, 1000])
def test_representatives_of_many_families(spark, room):
    r = random.Random(11)
    words = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(7):  # the same words in seven orders: near in words, far in shingles
        r.shuffle(words)
        texts.append(" ".join(words))
        for k in (20, 75, 130):
            texts.append(" ".join([*words[:k], "edit", *words[k + 1 :]]))
    order = list(range(len(texts)))
    r.shuffle(order)
    texts = [texts[i] for i in order]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(set(_brute_groups(texts)))
    assert len(want) == 7
    assert sorted(x.doc_id for x in simhash.representatives(df, room=room).collect()) == want
    # all in one component, in one task and in portions
    ids, sets = np.arange(len(texts)), [simhash.shingle_set(t.encode(), 5) for t in texts]
    assert simhash.linked(ids, sets, 0.8).tolist() == _brute_groups(texts)


def _edited(r, words, fresh, block):
    """A copy with up to a fifth of its shingles new: words scattered, or a block put in."""
    out = list(words)
    if block:
        at = r.randrange(len(out))
        out[at:at] = [fresh() for _ in range(r.randint(1, int(0.24 * len(words))))]
    else:
        for at in r.sample(range(len(out)), r.randint(1, max(1, len(words) // 45))):
            out[at] = fresh()
    return out


def test_near_copy_recall():
    r = random.Random(19)
    fresh = lambda: f"n{r.randrange(10**6)}"
    for block in (False, True):
        met = total = 0
        while total < 300:
            a = [fresh() for _ in range(r.randint(30, 200))]
            x, y = " ".join(a), " ".join(_edited(r, a, fresh, block))
            if _jaccard(x, y) < 0.8:
                continue
            one, two = (simhash.minwise_fingerprints(simhash.shingle_set(t.encode(), 5), 4) for t in (x, y))
            met += np.bitwise_count(one ^ two).min() <= 8
            total += 1
        assert met >= 0.99 * total


def test_loosely_alike_documents_stay(spark):
    base = [f"w{i}" for i in range(104)]  # 100 shingles
    change = lambda w, at: [*w[:at], f"edit{at}", *w[at + 1 :]]
    loose = base
    for at in (10, 30, 50):  # 15 shingles of 100 changed: 0.74
        loose = change(loose, at)
    one = change(change(base, 70), 90)  # 0.82 to the base, 0.74 to what follows once more
    texts = [" ".join(w) for w in (base, loose, one, change(change(one, 10), 30))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert _jaccard(texts[0], texts[1]) < 0.8 <= _jaccard(texts[0], texts[2]) and _jaccard(texts[0], texts[3]) < 0.8 <= _jaccard(texts[2], texts[3])
    assert sorted(x.doc_id for x in simhash.representatives(df).collect()) == sorted(set(_brute_groups(texts))) == [0, 1]


def test_exact(docs, texts, none):
    norm = {i: exact_dedup.tx.normalised(t) for i, t in texts.items()}
    by = {}
    for i, t in norm.items():
        by.setdefault(t, []).append(i)
    want = sorted((i, by[t][0], len(by[t]), by[t][0] == i, hashlib.sha256(t).hexdigest()) for i, t in norm.items())
    assert sorted(map(tuple, exact_dedup.exact_dedup(docs).collect())) == want
    assert exact_dedup.exact_dedup(none).count() == 0


def test_cuckoo_index():
    index, keys = exact_dedup.BucketIndex(8), [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for k in keys * 2:
        index.add(k, 5)
    assert len(index.keys) == 3000 and index.resizes and all(v[1] == 2 for v in index.keys.values())
    assert all(k in index.filter for k in keys)
    for k in keys[:1000] * 2:
        assert index.remove(k)
    assert not index.remove(keys[0]) and all(k in index.filter for k in keys[1000:]) and index.filter.live == 2000


def test_index_changes(spark):
    r = random.Random(6)
    marks = [hashlib.sha256(str(k).encode()).digest() for k in range(6)]
    frame = lambda rows: spark.createDataFrame([(i, bytearray(d)) for i, d in rows], "doc_id long, digest binary")
    rows = [(i, r.choice(marks[:5])) for i in range(40)] + [(7, marks[0])] * 3 + [(None, marks[1])]
    index = exact_dedup.live_digests(frame(rows))
    added = [(100 + k, r.choice(marks)) for k in range(8)] + [(-5, marks[2])]
    removed = [min(x for x in rows if x[0] is not None and x[1] == m) for m in marks[:3]] + [x for x in rows if x[1] == marks[3]] + [(7, marks[0])] * 2 + [(999, marks[4]), added[0], (-5, marks[2])]
    want = Counter([*rows, *added])
    for x in removed:
        want[x] -= want[x] > 0
    index, members = exact_dedup.apply_changes(index, frame(rows), frame(added), frame(removed))
    assert Counter((x.doc_id, bytes(x.digest)) for x in members.collect()) == +want
    groups = {}
    for (i, d), n in want.items():
        groups.setdefault(d, []).extend([i] * n)
    least = {d: (min((i for i in ids if i is not None), default=None), len(ids)) for d, ids in groups.items() if ids}
    assert {bytes(x.digest): (x.keep_id, x.group_size) for x in index.collect()} == least
    again, _ = exact_dedup.apply_changes(index, members, frame([]), members)
    assert again.isEmpty()


def test_html():
    page = "<nav><a href=x>Menu</a></nav><article><h1>A &amp; B</h1><p>One\n two<p>Tiny<div class='ad'>Buy</div><p>End&eacute;</article><div id=comments><p>first post by a reader</p></div><footer>foot</footer><script>var x='</p>'</script>"
    assert html_text.main_text(page) == "A & B\nOne two\nTiny\nEndé"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p>") == ""
    assert html_text.main_text("plain words") == "plain words"


def test_html_attributes_and_odd_markup():
    get = html_text.main_text
    assert get('<article><p title="the hidden cost">Body text</p></article>') == "Body text"
    assert get('<p>See <a href="/hidden/path">our link</a> now</p>') == "See our link now"
    assert get('<article data-hidden="false">x</article>') == "x"
    assert get('<article><section id="discussion">Talk</section><p class="related-work">Rel</p></article>') == "Talk\nRel"
    assert get("<p>one<br>two") == "one two" and get("<p>a&nbsp;&#x41;&amp;lt;</p>") == "a A&lt;"
    assert get("<article><p>a<div class='site-notice'>n</div><div class='content-sidebar-wrap'><p>kept</div><span class=ad>Buy</span><p hidden>h<p style='Display : none'>h</article>") == "a\nkept"
    assert get("<p>q</p><!-- never") == get("<p>q</p><script>never") == get("<p>q</p><div title='never") == "q"
    assert get("a < b<p>5 > 4 </ p>&bogus;") == "a < b\n5 > 4 &bogus;"
    assert get("<article><p><a href=x>Linked paragraph</a></p><p>Text</p></article>") == "Linked paragraph\nText"


def test_html_keeps_what_an_article_says():
    page = lambda inner: html_text.main_text(f"<html><body><nav><a href='/'>Home</a></nav><article><p>Begin here.</p>{inner}<p>The end.</p></article></body></html>")
    kept = "<ul><li><a href='/1'>First source</a></li><li><a href='/2'>Second source</a></li><li><a href='/3'>Third</a></li><li><a href='/4'>Fourth</a></li></ul>"
    assert page(kept) == "Begin here.\nFirst source\nSecond source\nThird\nFourth\nThe end."
    for inner in ('<h2 class="header">Title</h2>', '<div class="market-share"><p>Title</p></div>', '<section class="comments-on-history"><p>Title</p></section>', '<div class="header"><p>Title</p></div>', '<h3 class="nav">Title</h3>'):
        assert page(inner) == "Begin here.\nTitle\nThe end."
    for inner in ('<div class="ad">Buy</div>', '<div class="share-buttons"><p>Share</p></div>', '<section class="comments"><p>So true</p></section>', '<div class="comment-list"><p>So true</p></div>', '<ul class="menu"><li>One</li></ul>', '<div id="cookie-bar">Accept</div>'):
        assert page(inner) == "Begin here.\nThe end."


def test_html_time_follows_the_size():
    for unit in ("<div class='", "<div class=a><p>x", "<p><b>", "</b>", "<td>x", "<li>"):
        began = time.process_time()
        html_text.main_text(unit * ((1 << 20) // len(unit)))
        assert time.process_time() - began < 2 * 4


def test_html_line_blocks_decide():
    menu = "".join(f"<li><a href=x{i}>Go to page number {i}</a></li>" for i in range(6))
    page = f"<body><ul>{menu}</ul><p>First text.</p><p><a href=y>One link</a></p><p>Second text.</p><ul>{menu}</ul></body>"
    assert html_text.main_text(page) == "First text.\nOne link\nSecond text."
    every = [t for t, _, _ in html_text.lines(page) if t]  # the same without the step
    assert len(every) == 15 and html_text.main_text(page, window=1) == "First text.\nSecond text."


def _plain(page):
    """The text of the blocks of the first article element, by the standard library's parser."""
    blocks, inside = [[]], [False]

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            inside[0] |= tag == "article"
            if tag in html_text.BLOCK:
                blocks.append([])

        def handle_endtag(self, tag):
            inside[0] &= tag != "article"
            if tag in html_text.BLOCK:
                blocks.append([])

        def handle_data(self, data):
            if inside[0]:
                blocks[-1].append(data)

    reader = Reader(convert_charrefs=True)
    reader.feed(page or "")
    reader.close()
    return "\n".join(x for b in blocks if (x := " ".join("".join(b).split())))


def test_html_on_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in html_text.query(spark, "/root/testdata/sf0.001").collect()}
    want = {r.page_id: (r.url, t, len(t)) for r in pages.collect() for t in [_plain(r.html)]}
    assert got == want and len(want) == 50
    odd = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 2), (1, "u", "", 2), (2, "v", "<p>" + "x " * 300_000, 3)], "page_id long, url string, html string, text int")
    assert sorted((r.page_id or 0, r.url or "", r.n_chars) for r in html_text.extract(odd).collect()) == [(0, "", 0), (1, "u", 0), (1, "u", 0), (2, "v", 599_999)]
    assert html_text.extract(odd.limit(0)).count() == 0


@pytest.mark.parametrize("length", [3000, 50_000])
def test_html_without_article(length):
    long = ("word " * (length // 5)).strip()
    menu = "<ul>" + "".join(f"<li><a href=x{i}>Link {i}</a></li>" for i in range(4)) + "</ul>"
    page = f"<body><div class=nav>Home</div><p>Short one.</p>{menu}<p>{long}</p>{menu}<p>Second short.</p><p><a href=y>See the report</a></p><p>Third.</p><div class=ad>Buy</div><footer>foot</footer></body>"
    assert html_text.main_text(page).split("\n") == ["Short one.", long, "Second short.", "See the report", "Third."]


def test_decontamination(spark):
    r = random.Random(5)
    make = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    items = [make(r.randint(15, 60)) for _ in range(30)]
    rows = [(i, f"{make(r.randint(0, 80))} {items[i]} {make(50)}") for i in range(30)] + [(100 + i, make(120)) for i in range(100)]
    words = items[3].split()
    words[4] = words[11] = "changed"
    rows += [(300, f"{make(30)} {' '.join(words)} {make(30)}"), (301, None), (302, ""), (None, make(40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (500, None), (501, "")], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(docs, bench).collect()}
    assert got == {(i, i) for i in range(30)} | {(300, 3)}
    near = {(x.doc_id, x.item_id) for x in decontaminate.leaks(docs, bench, only_candidates=True).collect()}
    assert len(got & near) >= 0.9 * len(got)
    assert decontaminate.clean(docs, bench).filter("doc_id is null").count() == 1


def test_decontamination_finds_what_the_rule_accepts(spark):
    r = random.Random(29)
    rare = lambda n: ["".join(r.choice("abcdefgh") for _ in range(7)) for _ in range(n)]
    common = [f"c{i}" for i in range(12)]
    items = [rare(5), rare(6), [r.choice(common) for _ in range(15)], [*rare(44), "end.", *rare(4)], rare(90)]
    texts = []
    for _ in range(12):
        for k, item in enumerate(items):
            part = [w for i, w in enumerate(item) if k < 3 or i % 2 or k == 3 and i > 44 or k == 4 and i % 8 > 1]
            texts.append(" ".join([*rare(r.randint(0, 70)), *part, *rare(r.randint(20, 60))]).replace(part[0], f'"{part[0].upper()},', 1))
        texts.append(" ".join([*rare(60), *(r.choice(common) for _ in range(30))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    want = set()
    for d, text in enumerate(texts):
        words = decontaminate._words(text.encode())
        for i, item in enumerate(items):
            check, n = decontaminate.Item(" ".join(item).encode()), len(item)
            if any(check.check(words[max(0, at - n) : at + decontaminate.WINDOW + n])[2] for at in range(0, len(words), decontaminate.STRIDE)):
                want.add((d, i))
    assert {(6 * k + i, i) for k in range(12) for i in range(5)} <= want
    assert {(x.doc_id, x.item_id) for x in decontaminate.leaks(docs, bench).collect()} == want
    assert len({(x.doc_id, x.item_id) for x in decontaminate.leaks(docs, bench, only_candidates=True).collect()} & want) < len(want)


@pytest.mark.parametrize("block", [200, 4096])
def test_decontamination_over_many_items(spark, monkeypatch, block):
    """Recall against a common subsequence over all pairs: several blocks of items, or more passages than the rank."""
    monkeypatch.setattr(decontaminate, "ITEMS", block)
    r = random.Random(13)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    make = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [make(r.randint(12, 40)) for _ in range(700)] + [make(700)]
    texts = []
    for k in range(0, 700, 6):  # a tenth of the words changed, or one more for every eight
        some = [w for w in items[k] if r.random() < 0.9] if k % 12 else [x for w in items[k] for x in ([w, *make(1)] if r.random() < 0.12 else [w])]
        texts.append([*make(r.randint(0, 60)), *some, *make(r.randint(0, 60))])
    texts += [[*make(40), *items[700], *make(40)]] + [make(150) for _ in range(60)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    want = set()
    for d, text in enumerate(texts):
        held = set(text)
        for i, item in enumerate(items):
            if sum(w in held for w in item) >= 0.75 * len(item):
                n = len(item)
                if any(decontaminate.lcs(item, text[max(0, at - n) : at + decontaminate.WINDOW + n]) >= 0.75 * n for at in range(0, len(text), decontaminate.STRIDE)):
                    want.add((d, i))
    found = lambda **o: {(x.doc_id, x.item_id) for x in decontaminate.leaks(docs, bench, **o).collect()}
    assert len(want) > 100 and found() == want
    assert len(found(only_candidates=True) & want) >= 0.9 * len(want)
    assert decontaminate.leaks(docs.limit(0), bench).count() == decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_lcs():
    assert decontaminate.lcs(list("abcbdab"), list("bdcaba")) == 4 and decontaminate.lcs(["a"], []) == 0


def test_toxicity(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("aeioust") for _ in range(5))
    rows, labels = [], []
    for i in range(1800):
        w = [word() for _ in range(r.randint(5, 60))]
        if i % 5 == 0:
            w[r.randrange(len(w))] = "zork" + word()
        rows.append((i, " ".join(w), "en"))
        labels.append((i, int(i % 5 == 0)))
    rows += [(5000, None, None), (5001, "", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lab = spark.createDataFrame([*labels, (5000, None)], "doc_id long, toxic int")
    net, limits = toxicity.train(docs, lab.filter(tx.crc_mod("doc_id", 3) != 1))
    got = {x.doc_id: x._score for x in toxicity.score(docs, net, limits).collect()}
    held = [i for i in range(1800) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(got) == 1802 and sum((got[i] >= 0.5) == (i % 5 == 0) for i in held) >= 0.95 * len(held)
    bare, limits = toxicity.train(docs, lab.filter(F.lit(False)))
    assert {x._score for x in toxicity.score(docs, bare, limits).collect()} == {0.5}


def test_quality(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("aeioust") for _ in range(r.randint(2, 9)))
    rows, labels = [], []
    for i in range(1200):
        w = [word() for _ in range(r.randint(5, 60))]
        if i % 3 == 0:
            w = [x + r.choice(["***", "###", "%%"]) for x in w[: len(w) // 2 + 1]] * 2
        rows.append((i, " ".join(w), "en"))
        labels.append((i, int(i % 3 != 0)))
    rows += [(5000, None, None), (5001, "", "xx"), (5002, "x " * 100_000, "en"), (7, rows[7][1], "en"), (None, "some words", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string").repartition(3)
    lab = spark.createDataFrame([*labels, (5000, None), (5001, 7)], "doc_id long, quality int")
    model = quality.train(docs, lab.filter(tx.crc_mod("doc_id", 5) != 0))
    got = quality.score(docs, model).collect()
    held = {i for i in range(1200) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    assert sum((x.score >= quality.CUT) == (x.doc_id % 3 != 0) for x in got if x.doc_id in held) >= 0.97 * len(held)
    # the pairs' objective: nearly every preferred text of the sample is ranked above the other
    found, y, share = quality.sample_features(docs, lab)
    rank = model.rank(found)
    assert abs(share - 2 / 3) < 1e-9 and np.mean(rank[y == 1][:, None] > rank[y == 0][None, :]) > 0.99
    # features and scores against one text at a time
    for x in got[:50]:
        t = next(t for i, t, _ in rows if i == x.doc_id) or ""
        f = quality.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        want = 1 / (1 + math.exp(-np.clip(model.slope * model.rank(f)[0] + model.shift, -30, 30)))
        assert abs(x.score - want) < 1e-6 and x.kept == (model.rank(f)[0] >= model.threshold)
    assert {x.score for x in quality.score(docs, quality.train(docs, lab.limit(0))).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


def _slow_logit(net, text):
    """The network one text, one window and one filter at a time."""
    words = [w for w in text.lower().split()] or [b""]
    x, _ = toxicity.encode(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    e = [net.p["emb"][row].sum(0) for row in x]
    assert len(e) == len(words)
    out = float(net.p["bias"][0]) + net.shift
    at = 0
    for width, n in toxicity.FILTERS.items():
        for f in range(n):
            best = max(float(net.p[f"b{width}"][f]) + sum(float(e[i + k] @ net.p[f"w{width}"][k][:, f]) for k in range(width) if i + k < len(e)) for i in range(len(e)))
            out += max(best, 0.0) * float(net.p["out"][at])
            at += 1
    return out


def test_toxicity_against_brute_force():
    r = random.Random(3)
    net = toxicity.Network(3)
    texts = [" ".join("".join(r.choice("abcdé,.") for _ in range(r.randint(1, 9))) for _ in range(r.randint(0, 12))).encode() for _ in range(30)]
    net.p["b2"] += 0.1
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = net.scores(data, off)
    assert np.allclose(got, [1 / (1 + math.exp(-_slow_logit(net, t))) for t in texts], atol=1e-5)


def test_toxicity_thresholds(spark):
    r = random.Random(31)
    rows = [("en", r.random() * 0.8) for _ in range(5000)] + [("fr", 0.1 + i / 1000) for i in range(50)] + [("fr", 0.9999)]
    rows += [("de", 0.75 + i / 10_000) for i in range(400)] + [("de", 0.9999)] + [("it", 0.2)] * 3
    found = lambda rows: toxicity.thresholds(spark.createDataFrame(rows, "lang string, _score double"))
    got, prior = found(rows), 1 / toxicity.MAX_FALSE

    def slow(lang):
        """The lowest multiple from CUT up at which the language's rows and those borrowed from all languages keep to MAX_FALSE."""
        own = [int(s * toxicity.GRAIN) for x, s in rows if x == lang]
        for at in range(int(toxicity.CUT * toxicity.GRAIN), toxicity.GRAIN + 1):
            rate = (sum(int(s * toxicity.GRAIN) >= at for _, s in rows) + 1) / (len(rows) + prior)
            if lang is not None:
                rate = (sum(s >= at for s in own) + prior * rate) / (len(own) + prior)
            if rate <= toxicity.MAX_FALSE + 1e-12:
                return min(at / toxicity.GRAIN, 0.999)
        return 0.999

    assert got == {lang: slow(lang) for lang in ("en", "fr", "de", "it", None)}
    # one odd row moves a threshold little, whatever the language's size; few rows hardly leave the common one
    for lang in ("fr", "de"):
        assert abs(found([r for r in rows if r != (lang, 0.9999)])[lang] - got[lang]) < 0.02
    assert abs(got["it"] - got[None]) < 0.005 and found([])[None] == toxicity.CUT


def test_toxicity_thresholds_see_rows_outside_the_sample(spark):
    rows = [(i, f"zork{i % 7} bad" if i % 4 == 0 else f"calm{i % 9} word", "en") for i in range(400)]
    rows += [(1000 + i, f"zork{i % 7} calm", "fr") for i in range(600)]  # clean, though the stem is toxic in English
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 400 and i % 4 == 0)) for i, _, _ in rows], "doc_id long, toxic int")
    net, limits = toxicity.train(docs, labels, limit=40)
    scored = toxicity.score(docs, net, limits).filter("doc_id >= 1000 and _flagged")
    assert scored.count() <= 2 * toxicity.MAX_FALSE * 600 + 20  # the fitted rows aside


def test_quality_learns_from_all_labelled_rows(spark, monkeypatch):
    """every labelled row is in a block and a pair, and the threshold is the exact quantile of all their scores."""
    monkeypatch.setattr(quality, "BLOCK", 100)
    monkeypatch.setattr(quality, "sampled", lambda *_: pytest.fail("a sample trains"))
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["word", "other", "###", "%%"] if i % 3 == 0 else ["word", "other", "Text", "###"]) for _ in range(r.randint(5, 30)))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(600)], "doc_id long, quality int"))
    rank = sorted(float(model.rank(quality.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])))[0]) for _, t in rows)
    assert abs(model.threshold - rank[200]) < 1e-9
    y = np.array([1] * 30 + [0] * 7)
    a, b = quality._pairs(3, y)
    assert len(a) == len(b) == 300 and np.bincount(a, minlength=37)[:30].min() >= quality.PAIRS and np.bincount(b, minlength=37)[30:].min() >= quality.PAIRS
