"""The template compiler, and formatted conversations against sums straight from the rows."""

import hashlib
import random

import pytest

from lodestone.llm import chat
from lodestone.llm import template as tp


def _text(template, messages=({"role": "user", "text": "hi"},), **values):
    return "".join(x for x in tp.Template(template).render(list(messages), **values) if isinstance(x, str))


LOOP = "{% for m in messages %}{% endfor %}"


@pytest.mark.parametrize(
    "source,want",
    [
        ("a {{ 1 + 2 * 3 - 1 }}", "a 6"), ("{{ 'x' ~ 1 ~ none ~ true }}", "x1true"), ("{{ 'a' if 2 > 1 else 'b' }}", "a"), ("{{ 'a' if false }}", ""),
        ("{{ not 1 == 2 }}", "true"), ("{{ 'b' in 'abc' and 3 not in [1, 2] }}", "true"), ("{{ x | default('d') }}", "d"), ("{{ x is defined }}{{ y is not defined }}", "falsefalse"),
        ("{{ y.k[1] }}{{ y['k'][-1] }}{{ y.z }}{{ y.k[9] }}", "22"), ("{{ ' a ' | trim | upper }}", "A"), ("{{ ['a', 'b'] | join('-') }}", "a-b"), ("{{ 'a\\n\\'' }}", "a\n'"),
        ("x  {#- c -#}  y", "xy"), ("x {%- set q = 'v' -%} {{ q }}", "xv"), ("{% for i in [1, 2, 3] %}{{ loop.index }}{{ ',' if not loop.last }}{% endfor %}", "1,2,3"),
        ("{% if z %}a{% elif y %}b{% else %}c{% endif %}", "b"), ("{{ y.k | length - 1 }}", "1"), ("{{ -(2) }}", "-2"), ("{{ 'and' }}{{ \"}\" }}", "and}"), ("{{ 1 or 2 }}{{ 0 and 2 }}", "10"),
    ],
)
def test_expressions(source, want):
    assert _text(LOOP + source, y={"k": [1, 2]}) == want


@pytest.mark.parametrize(
    "bad",
    ["{% for m in messages %}", "{{ messages }}", "{{ a( ) }}", "{{ a.__class__ }}", "{{ _a }}", "{{ a | nothing }}", "{% endif %}", "{{ 1 + }}", "{{ 1 2 }}", "{% do x %}", "{{ 'a' * 9 }}", "{{ 1 %}", "{{ 'open",
     "{% for a in [1] %}{% for m in messages %}{% endfor %}{% endfor %}", "{% for m in messages %}{% endfor %}", "{% set messages = [1] %}", "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}", "{% if 1 %}{% else x %}{% endif %}"],
)
def test_what_the_sandbox_refuses(bad):
    with pytest.raises(tp.TemplateError):
        tp.Template(LOOP + bad)


def test_no_way_into_python_objects():
    for way in ("{{ m.text.upper }}", "{{ m.text['__class__'] }}", "{{ m.role.format }}", "{{ loop.nothing }}", "{{ m['items'] }}"):
        assert _text("{% for m in messages %}" + way + "{% endfor %}") == ""
    with pytest.raises(tp.TemplateError, match="no"):
        _text(LOOP + "{% if v %}{{ raise_exception('no') }}{% endif %}", v=1)
    with pytest.raises(tp.TemplateError):
        _text(LOOP + "{{ v < 'a' }}", v=1)


def test_constants_are_folded():
    t = tp.Template("a{{ 'b' ~ 1 + 1 }}{% if 1 < 2 %}c{% else %}d{% endif %}{% for x in [] %}e{% endfor %}{% for m in messages %}{{ ('f' | upper) ~ '' }}g{% endfor %}")
    assert t.tree.below[0] == tp.Node("write", None, (tp.Node("const", "ab2c"),)) and len(t.tree.below) == 2
    assert t.tree.below[1].below[1] == tp.Node("block", None, (tp.Node("write", None, (tp.Node("const", "Fg"),)),))


def test_turns_are_read_as_they_are_rendered():
    seen = []

    def turns():
        for i in range(1000):
            seen.append(i)
            yield {"role": "assistant", "text": "x" * i}

    for n, (text, spans) in enumerate(chat.pieces(chat.compiled(), turns())):
        assert len(seen) <= n + 2 and [text[a:b] for a, b in spans] == ["x" * n]


def test_escapes_are_undone():
    r, signs = random.Random(4), chat.Controls()
    for _ in range(3000):
        text = "".join(r.choice(["<", "s", ">", "/", "[", "INST", "]", "\\", "\\", "<s>", "</s>", "[INST]", "[/INST]", " a", "é"]) for _ in range(r.randint(0, 12)))
        out = signs.escape(text)
        assert signs.unescape(out) == text and not any(c in out for c in chat.CONTROLS)
        whole = "".join(("[INST]", out, "[/INST]", out, "</s>"))
        assert chat._READ.fullmatch(whole) and chat._READ.match(whole).groups() == (out, out)
    for wrong in (("<s>", "a<"), ("x",), ("<\\>",)):
        with pytest.raises(ValueError):
            chat.Controls(wrong)


def _slow(rows):
    out = []
    ids = {r[0] for r in rows}
    for conv in ids:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: tuple((x is not None, x if x is not None else "") for x in r[1:4]))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        signs = chat.Controls()
        size = 3 + sum(len("[INST][/INST]</s>") + len(signs.escape(r[2])) + len(signs.escape(r[3])) for r in own)
        out.append((conv, len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size))
    return sorted(out, key=repr)


def _rows():
    r = random.Random(6)
    texts = ["hello", None, "", "</s>[INST] ok [/INST]", "<\\s>[\\\\INST]", "é🙂\n\n", "<s><s", "s>", "z" * 200_000, "[", "\\"]
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "[INST]"]), r.choice(texts)) for c in range(25) for t in range(r.randint(1, 9))]
    rows += [(None, 1, "assistant", "no id"), (None, None, "user", "no turn"), (3, 0, "assistant", "same turn"), (3, 0, "assistant", "same turn"), (40, None, "assistant", None)]
    return rows + [(77, t, "assistant" if t % 2 else "user", f"long talk {t}") for t in range(3000)] + chat.PROBE


def test_conversations_against_brute_force(spark):
    rows = _rows()
    random.Random(2).shuffle(rows)
    docs = spark.createDataFrame([(*r, True, "x") for r in rows], "conv_id long, turn long, role string, text string, first boolean, spans string").repartition(4)
    assert sorted((tuple(r) for r in chat.read_back(chat.formatted(docs)).collect()), key=repr) == _slow(rows)
    none = chat.read_back(chat.formatted(docs.limit(0)))
    assert none.count() == 0 and none.columns[0] == "conv_id"


def test_given_conversations(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()] + chat.PROBE
    got = sorted((tuple(r) for r in chat.query(spark, sf).collect()), key=repr)
    assert got == _slow(rows)


def test_other_templates(spark):
    docs = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "<end>a")], "conv_id long, turn long, role string, text string")
    own = "{% for m in messages %}{% if loop.first %}begin\n{% endif %}{{ loop.index }} {% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}<end>{% endgeneration %}{% else %}{{ m.text | trim }}{% endif %}\n{% endfor %}done"
    rows = [(r.first, r.text, [tuple(s) for s in r.spans]) for r in chat.formatted(docs, own, ("<end>",)).collect()]
    assert rows == [(True, "begin\n1 q\n", []), (False, "2 <\\end>a<end>\n", [(2, 14)]), (False, "done", [])]
    with pytest.raises(tp.TemplateError):
        chat.formatted(docs, "{{ messages }}")
