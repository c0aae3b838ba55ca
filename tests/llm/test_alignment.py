"""Token alignment against a version that takes one text at a time, straight from the two libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lodestone.llm import alignment


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}

    def bytes_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    def tokens(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes_b(i) for i in ids[1]]
        if any(b"".join(r) != (" " + text).encode() for r in raw):
            return None
        spans = []
        for own, parts in zip(ids, raw, strict=True):
            at, rows = 0, []
            for i, p in zip(own, parts, strict=True):
                rows.append((at, at + len(p), i))
                at += len(p)
            spans.append(rows)
        return spans

    return tokens


def _slow(rows, tokens):
    found = {k: tokens(t) if t else None for k, t in enumerate(t for _, t in rows)}
    links = {}
    for k, spans in found.items():
        if spans:
            out, j = [], 0
            for s, e, i in spans[0]:
                while spans[1][j][1] <= s:
                    j += 1
                k2 = j
                while k2 < len(spans[1]) and spans[1][k2][0] < e:
                    out.append((i, spans[1][k2][2]))
                    k2 += 1
            links[k] = out
    count = Counter(p for out in links.values() for p in set(out))
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    result = []
    for k, (doc_id, _) in enumerate(rows):
        spans = found[k]
        if not spans:
            result.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        parts, at = [], 0
        for c in cuts:
            parts.append("|".join(",".join(str(i) for s, e, i in side if s >= at and e <= c) for side in spans))
            at = c
        out = links[k]
        result.append((doc_id, len(spans[0]), len(spans[1]), len(cuts), len(out), sum(count[p] == best[p[0]] for p in out), sum(count[p] for p in out), hashlib.sha256(";".join(parts).encode()).hexdigest()))
    return result


def _rows():
    r = random.Random(8)
    pool = ["the", "naïve", "über", "漢字", "🙂🙃", "  ", "\n", "\n\n", "\t", " ", "　", "don't", "we'll", "123456", "!?…", "<s>", "</s>", "<|endoftext|>", "<unk>", "<0x41>", "é", "ﬁ", "\x1c", "\x85", "a\x00b", "-----", "\r\n", ");\r\n", "*/\r", "\r \n", "oureaiéqueux"]
    make = lambda n: "".join(r.choice(pool) + r.choice([" ", " ", "", "  "]) for _ in range(n))
    texts = [make(r.randint(1, 60)) for _ in range(80)] + [None, "", " ", "  ", "\n", "a", " a", "a ", "a▁b and words", "▁", "x" * 3000, "word " * 4000, "﻿bom", "tail  \n "]
    rows = list(enumerate(texts))
    return rows + [(3, texts[3]), (3, "another of the id"), (None, "no id at all"), (None, None)]


@pytest.mark.parametrize("block", [1 << 12, 64 << 20])
def test_alignment_against_brute_force(spark, plain, block):
    rows = _rows()
    docs = spark.createDataFrame([(i, t, "x", b"y", 7) for i, t in rows], "doc_id long, text string, a string, b binary, block long").repartition(3)
    got = sorted((tuple(r) for r in alignment.token_alignment(docs, block=block).collect()), key=repr)
    want = sorted(_slow(rows, plain), key=repr)
    assert got == want
    assert next(x for x in want if x[0] == rows.index((88, "a▁b and words")))[1:] == (0, 0, 0, 0, 0, 0, "") if (88, "a▁b and words") in rows else True


def test_given_documents(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in alignment.query(spark, "/root/testdata/sf0.001").collect()), key=repr)
    assert got == sorted(_slow(rows, plain), key=repr)


def test_labels_and_groups():
    marks = alignment.labels(9, np.array([2, 4, 9]), np.array([1, 4, 6, 7, 9]))
    assert marks.tobytes() == b"banxnbbnx"
    size, a, b = alignment.groups(marks)
    assert size.tolist() == [4, 5] and a.tolist() == [2, 1] and b.tolist() == [2, 3]
    assert [x.tolist() for x in alignment.groups(np.zeros(0, np.uint8))] == [[], [], []]


def test_arrays_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "two words"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in alignment.as_arrays(alignment.aligned(docs)).collect()}
    assert len(rows[1].a) == sum(rows[1].group_a) > 0 and len(rows[1].b) == sum(rows[1].group_b) > 0 and rows[2].a == []
    none = alignment.token_alignment(docs.limit(0))
    assert none.count() == 0 and none.columns[0] == "doc_id" and none.columns[-1] == "groups_sha256"


def test_a_worker_forgets_and_learns_again():
    code = alignment.Aligner(*alignment.default_tokenizers(), limit=50)
    texts = [f"some words {i} of a text\n".encode() * 3 for i in range(40)]
    for _ in range(2):
        for t in texts:
            got = code.align(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
            assert all((x == y).all() for (x, _), y in zip(got, code.whole(b" " + t), strict=True))
            assert code.held < 200
