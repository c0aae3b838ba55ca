"""Chat formatting: conversations through a compiled template, with the spans that a model is to generate.

Control strings mark turns. A control string inside a text, with any number of backslashes after its first character, gets one more
backslash there; reading back takes one off. So no text holds a control string once escaped, and texts without such strings stay as
they are. No control string may hold another's first character further on: none can begin in a text and end in a mark, or the
other way about.

The rows of a conversation are brought together in the order of their turns and rendered as they come: a task holds one turn and a
text's pieces, whatever a conversation's length. Each turn gives a piece of formatted text with its generated spans, in code
points; reading back goes over the pieces in the same order. A conversation's order makes it one stream.

Defined results: a null role or text is empty; rows without a conv_id are one conversation, a null turn comes first; rows of the
same turn all count, by role and text (nulls first); other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import template as tp
from lodestone.llm import textops as tx

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
TEMPLATE = """
{%- for message in messages -%}
{{ '<s>' if loop.first }}[INST]{{ message.role | escape }}[/INST]
{%- if message.role == 'assistant' -%}
{% generation %}{{ message.text | escape }}{% endgeneration %}
{%- else -%}
{{ message.text | escape }}
{%- endif -%}
</s>
{%- endfor -%}
"""
PIECE = "conv_id long, first boolean, text string, spans array<struct<start: int, stop: int>>"


class Controls:
    """Escapes control strings, and takes the escapes off again."""

    def __init__(self, strings: tuple[str, ...] = CONTROLS):
        if any(len(s) < 2 or "\\" in s for s in strings) or any(s[0] in t[1:] for s in strings for t in strings):
            raise ValueError("control strings have two characters or more, no backslash, and no first character further on")
        rest = "|".join(f"{re.escape(s[0])}(?=\\\\*{re.escape(s[1:])})" for s in strings)
        self._all = re.compile(rest)
        self._more = re.compile("|".join(f"{re.escape(s[0])}\\\\(?=\\\\*{re.escape(s[1:])})" for s in strings))

    def escape(self, text: str | None) -> str:
        return self._all.sub(lambda m: m[0] + "\\", tp.shown(text))

    def unescape(self, text: str) -> str:
        return self._more.sub(lambda m: m[0][0], text)


def compiled(text: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS) -> tp.Template:
    return tp.Template(text, {"escape": Controls(controls).escape})


def pieces(found: tp.Template, turns: Iterable[dict]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """(text, generated spans) for each turn, and what follows the last; a span never lies in two pieces."""
    text, spans, size, begun = [], [], 0, None
    for x in found.render(turns):
        if x is tp.OPEN:
            begun = size
        elif x is tp.CLOSE:
            spans.append((begun, size))
            begun = None
        elif x is not tp.TURN:
            text.append(x)
            size += len(x)
        elif begun is None:
            yield "".join(text), spans
            text, spans, size = [], [], 0
    if size:
        yield "".join(text), spans


def _grouped(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, its rows) of rows that stand together; a group's rows are read as they are asked for."""
    held = next(rows, None)
    while held is not None:
        own = held[0]

        def group() -> Iterator[tuple]:
            nonlocal held
            while held is not None and held[0] == own:  # noqa: B023
                now, held = held, next(rows, None)
                yield now

        some = group()
        yield own, some
        for _ in some:  # what the reader left
            pass


def formatted(conversations: DataFrame, text: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """(conv_id, first, text, spans) of (conv_id, turn, role, text): a row for each piece. A conversation's pieces stand together and in
    order in one partition; the first is marked."""
    compiled(text, controls)  # a template that is wrong fails here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = compiled(text, controls)
        rows = (row for b in batches for row in zip(*[b.column(c).to_pylist() for c in ("conv_id", "role", "text")], strict=True))
        out, size = [], 0
        for conv, turns in _grouped(rows):
            first = True
            for piece, spans in pieces(found, ({"role": r or "", "text": t or ""} for _, r, t in turns)):
                out.append((conv, first, piece, [{"start": s, "stop": e} for s, e in spans]))
                first, size = False, size + len(piece)
                if size > 1 << 20 or len(out) >= 1000:
                    yield batch(out)
                    out, size = [], 0
        if out:
            yield batch(out)

    kinds = [pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))]
    names = ["conv_id", "first", "text", "spans"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(4)], names)

    rows = conversations.selectExpr("cast(conv_id as long) as conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(run, PIECE)


_READ = re.compile(r"(?:<s>)?\[INST\](.*?)\[/INST\](.*?)</s>", re.S)


def read_back(found: DataFrame) -> DataFrame:
    """Per conversation, from `formatted` pieces as they stand (default template and controls): conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars."""
    signs = Controls()

    def digest(rows: Iterator[tuple]) -> tuple:
        turns, loss, n, lost, size, rest = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, ""
        for _, text, spans in rows:
            size += len(text)
            for s in spans:
                own = signs.unescape(text[s["start"] : s["stop"]])
                loss.update(own.encode())
                lost += len(own)
            rest, end = rest + text, 0
            for m in _READ.finditer(rest):
                if m.start() != end:
                    raise ValueError("text between turns")
                turns.update(f"{signs.unescape(m[1])}\n{signs.unescape(m[2])}\n".encode())
                n, end = n + 1, m.end()
            rest = rest[end:]
        if rest:
            raise ValueError("a turn isn't closed")
        return n, turns.hexdigest(), lost, loss.hexdigest(), size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*[b.column(c).to_pylist() for c in ("conv_id", "text", "spans")], strict=True))
        out = []
        for conv, group in _grouped(rows):
            out.append((conv, *digest(group)))
            if len(out) >= 1000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(6)], names)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return found.mapInArrow(run, schema)


#: A conversation whose texts are made of control strings.
PROBE = [(-1, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tx.read_table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) as conv_id", "cast(turn as long) as turn", "role", "text")
    return read_back(formatted(rows.unionByName(spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string"))))
