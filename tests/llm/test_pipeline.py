"""The pipeline, stage by stage, against brute force on sf0.001 with odd rows added, and on an empty table."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lodestone.llm import decontaminate, mixing, token_files, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    near = docs.filter("length(text) > 400").orderBy("doc_id").limit(3).selectExpr("doc_id + 9000 as doc_id", "concat(text, ' ', 'added') as text", "lang", "source", "n_chars")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("text is not null").orderBy("item_id").first()
    odd = [(None, None, None, None, None), (9100, "", None, "a", 0), (9101, None, "en", None, None), (9102, f"before it {item.text} after it", "en", "a", 9), (9103, "word " * 30_000, "xx", "a", 1), (None, "some text without an id", "en", "b", 1)]
    docs.unionByName(near).unionByName(spark.createDataFrame(odd, docs.schema)).write.parquet(f"{at}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{at}/{name}.parquet")
    return at


@pytest.fixture(scope="module")
def stages(spark, folder):
    """The rows before the first stage and after each."""
    rows = [spark.read.parquet(f"{folder}/documents.parquet")]
    columns = rows[0].columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows[-1], folder)
        assert name == "token_files" or out.columns == columns
        path = f"{folder}/{name}"
        out.write.parquet(path)
        rows.append(spark.read.parquet(path))
    return [r.collect() for r in rows]


def _words(text):
    return (text or "").encode().split()


def test_toxicity_stage(spark, folder, stages):
    before, after = stages[0], stages[1]
    net, limits = toxicity.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    keep = []
    for r in before:
        data = (r.text or "").encode()
        score = net.scores(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]
        if score < limits.get(r.lang, limits[None]):
            keep.append(r)
    assert Counter(map(tuple, after)) == Counter(map(tuple, keep)) and len(after) >= 0.8 * len(before)


def test_near_copy_stage(stages):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    rows = [r for r in stages[1] if r.doc_id is not None]
    sets, root = [shingles(r.text) for r in rows], [r.doc_id for r in rows]
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) >= 0.8 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    want = [r for r, x in zip(rows, root, strict=True) if r.doc_id == x] + [r for r in stages[1] if r.doc_id is None]
    assert Counter(map(tuple, stages[2])) == Counter(map(tuple, want))
    assert len(want) < len(stages[1]) and not any(r.doc_id and 9000 <= r.doc_id < 9100 for r in stages[2])


def test_decontamination_stage(spark, folder, stages):
    items = [decontaminate.Item(r.text.encode()) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r.text]
    want = []
    for r in stages[2]:
        words = decontaminate._words((r.text or "").encode())
        held = set(words)
        some = [x for x in items if x.words and sum(w in held for w in x.words) >= 0.5 * len(x.words)]
        leak = any(x.check(words[max(0, at - len(x.words)) : at + decontaminate.WINDOW + len(x.words)])[2] for x in some for at in range(0, len(words), decontaminate.STRIDE))
        if not leak or r.doc_id is None:
            want.append(r)
    assert Counter(map(tuple, stages[3])) == Counter(map(tuple, want)) and 9102 not in {r.doc_id for r in want}


def test_mixing_stage(stages):
    size = Counter()
    for r in stages[3]:
        size[r.source] += len(_words(r.text))
    names = sorted((x for x in size if x is not None), key=lambda x: x) + [None] * (None in size)
    weight = {x: k % 3 + 1 for k, x in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(size.values()))
    while open_:
        level = left / sum(weight[x] for x in open_)
        full = [x for x in open_ if level * weight[x] > 3 * size[x]]
        for x in full or open_:
            target[x] = 3.0 * size[x] if full else level * weight[x]
        left -= sum(target[x] for x in full)
        open_ = open_ - set(full) if full else set()
    want = Counter()
    for r in stages[3]:
        rate = target[r.source] / size[r.source] if size[r.source] else 0.0
        draw = int(hashlib.md5(f"{mixing.SEED}:{'null' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:13], 16) / (1 << 52)
        want[tuple(r)] += math.floor(rate) + (draw < rate - math.floor(rate))
    assert Counter(map(tuple, stages[4])) == +want


def test_token_stage(stages):
    from tokenizers import Tokenizer

    code, base, want = Tokenizer.from_file(token_files.default_tokenizer()), 0, []
    got = sorted(stages[5], key=lambda r: r.start)
    texts = {}
    for r in stages[4]:
        texts.setdefault(r.doc_id, []).append([*code.encode(r.text or "", add_special_tokens=False).ids, 1])
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in stages[4]), key=lambda x: (x is None, x))
    for r in got:
        assert r.start == base
        base += r.n_tokens
        want.append((r.doc_id, r.n_tokens, r.ids_crc32))
    assert Counter(want) == Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, xs in texts.items() for x in xs)


def test_empty_table(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name
