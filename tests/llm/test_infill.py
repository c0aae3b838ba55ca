"""Fill-in-middle against a version that works on one text at a time, with chunks of a few bytes and of many."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import infill

SCHEMA = "doc_id long, text string, doc string, n long, h1 string"


def _slow(doc_id, text, rate=100, spm=50, seed=7):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, form, len(p), len(m), sha(out), sha(text))


def _rows():
    r = random.Random(5)
    make = lambda k: "".join(r.choice(["a", "é", "漢", "🙂", "\n", "\n\n", "<", "P", ">", "<P", "S>", " ", "\r"]) for _ in range(k))
    texts = [make(r.randint(0, 90)) for _ in range(150)] + [None, "", "\n", "\n\n\n", "x", "no end", "end\n", "<P>", "a<M>b\nc", "<<S>", "<P><", "é" * 40, "\n" * 50, "y" * 70_000, ("z" * 99 + "\n") * 900]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [(3, rows[3][1]), (3, "another\nof the same id"), (None, "no id\nat all\n"), (None, None), (-5, "a\nb\nc\nd"), (2**62, "e\nf")]


@pytest.mark.parametrize("chunk", [5, 64, 32 << 10])
def test_infill_against_brute_force(spark, chunk):
    rows = _rows() if chunk > 5 else [(i, t) for i, t in _rows() if len(t or "") < 1000]
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA).repartition(3)
    found = sorted((tuple(r) for r in infill.digests(*infill.infilled(docs, chunk=chunk)).collect()), key=repr)
    assert found == sorted((_slow(i, t) for i, t in rows), key=repr)


def test_rates_marks_and_outputs(spark):
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in infill.digests(*infill.infilled(docs, 11, 40, 0, chunk=50)).collect()}
    assert got == {_slow(i, t, 40, 0, 11) for i, t in rows} and len({r[2] for r in got}) == 2
    whole, _, pieces = infill.infilled(docs, chunk=100)
    for r in whole.withColumn("back", infill.restored(F.col("form"), F.col("output"))).collect():
        assert any(i == r.doc_id and (t or "") == r.back for i, t in rows)
    assert pieces.count() > 700 and max(len(p.piece) for p in pieces.collect()) <= 100
    with pytest.raises(ValueError):
        infill.mark_finder((b"<a>", b"<b<>"))


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    out = infill.digests(*infill.infilled(none))
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"] and out.count() == 0


def test_scan_composes_and_finds():
    r = random.Random(9)
    auto = infill.line_automaton()
    for _ in range(50):
        text = bytes(r.choice(b"ab\n\n<<PSM>>") for _ in range(r.randint(0, 80)))
        cuts = sorted(r.randint(0, len(text)) for _ in range(r.randint(0, 6)))
        off = np.array([0, *cuts, len(text)])
        scan = infill.Scan(auto, np.frombuffer(text, np.uint8), off)
        for i, (a, b) in enumerate(zip(off[:-1], off[1:], strict=True)):
            for start in range(len(auto.move)):
                state, at = start, []
                for j in range(a, b):
                    c = auto.classes[text[j]]
                    if auto.hit[state, c]:
                        at.append(j)
                    state = auto.move[state, c]
                assert scan.move[i, start] == state and scan.hit[i, start] == len(at)
                k = np.arange(len(at))
                assert scan.find(np.full(len(at), i), np.full(len(at), start), k).tolist() == at
