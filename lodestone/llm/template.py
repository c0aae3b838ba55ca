"""A small sandboxed template language: parsed to a syntax tree, constants folded, compiled to Python closures.

Text stands for itself; ``{{ expression }}`` writes a value, ``{% ... %}`` is a statement (for, if / elif / else, set, generation),
``{# ... #}`` a comment; a ``-`` beside a brace takes off the white space there. What stands between ``generation`` and
``endgeneration`` is marked as generated. Expressions have literals, lists, names, ``a.b``, ``a[b]``, ``~ + - *``, comparisons, ``in``,
``and or not``, ``x if c else y``, ``is defined``, ``is none`` and filters ``value | name(arguments)``.

Sandbox: a template sees only the values and filters it is given. ``a.b`` and ``a[b]`` look into mappings and lists alone, never
into Python objects; there are no calls but filters and ``raise_exception``; loops run over lists and the turns only, so every
template ends. `messages` is a stream: it may be looped over once, outside other loops, and is not kept.

A compiled template is a generator of strings and the marks OPEN, CLOSE (generated text) and TURN (a message is done), so that a
conversation of any length is rendered a turn at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

OPEN, CLOSE, TURN = object(), object(), object()
MISSING = object()


class TemplateError(ValueError):
    """A template that can't be read, or one that raised."""


@dataclass(frozen=True)
class Node:
    """kind, what it is made of, and the nodes below it."""

    kind: str
    value: Any = None
    below: tuple[Node, ...] = ()


_TOKEN = re.compile(r"""\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z]\w*)|(?P<sign>==|!=|<=|>=|[-+*~|.,:()\[\]<>=]))""", re.S)
_TAG = re.compile(r"(\{\{-?|\{%-?|\{#-?)(.*?)(-?\}\}|-?%\}|-?#\})", re.S)
_QUOTED = re.compile(r"\\(.)", re.S)
_ENDS = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_RESERVED = {"and", "or", "not", "in", "is", "if", "else", "elif", "for", "set", "endfor", "endif", "generation", "endgeneration"}
#: Binary signs by how tightly they bind.
_BINDS = {"or": 1, "and": 2, "==": 4, "!=": 4, "<": 4, "<=": 4, ">": 4, ">=": 4, "in": 4, "not in": 4, "~": 5, "+": 6, "-": 6, "*": 7}


class Reader:
    """The expression of one tag, token by token."""

    def __init__(self, text: str):
        self.tokens, at, text = [], 0, text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"can't read {text[at : at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> str | None:
        i = self.at + ahead
        return self.tokens[i][1] if i < len(self.tokens) and self.tokens[i][0] != "string" else None

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted and self.at < len(self.tokens):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise TemplateError(f"{sign!r} is missing")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name" or self.peek() in _RESERVED:
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def done(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} is too much")

    def expression(self) -> Node:
        value = self.binary(0)
        if self.take("if"):
            test = self.binary(0)
            other = self.expression() if self.take("else") else Node("const", "")
            return Node("choose", None, (test, value, other))
        return value

    def binary(self, least: int) -> Node:
        left = self.unary()
        while True:
            sign = "not in" if self.peek() == "not" and self.peek(1) == "in" else self.peek()
            if sign == "is" and least <= 4:
                self.at += 1
                no = self.take("not")
                test = Node("is", self.take("defined", "none") or self.need("defined"), (left,))
                left = Node("not", None, (test,)) if no else test
                continue
            if _BINDS.get(sign, -1) <= least:
                return left
            self.at += 2 if sign == "not in" else 1
            left = Node("binary", sign, (left, self.binary(_BINDS[sign])))

    def unary(self) -> Node:
        if self.take("not"):
            return Node("not", None, (self.binary(3),))
        if self.take("-"):
            return Node("minus", None, (self.unary(),))
        return self.after(self.primary())

    def primary(self) -> Node:
        if self.at >= len(self.tokens):
            raise TemplateError("a value is missing")
        kind, text = self.tokens[self.at]
        if kind == "string":
            self.at += 1
            return Node("const", _QUOTED.sub(lambda m: _ENDS.get(m[1], m[1]), text[1:-1]))
        if kind == "number":
            self.at += 1
            return Node("const", float(text) if "." in text else int(text))
        if self.take("("):
            value = self.expression()
            self.need(")")
            return value
        if self.take("["):
            return Node("list", None, tuple(self.listed("]")))
        if text in _WORDS:
            self.at += 1
            return Node("const", _WORDS[text])
        name = self.name()
        if name == "raise_exception":
            self.need("(")
            return Node("raise", None, tuple(self.listed(")")))
        if self.peek() == "(":
            raise TemplateError(f"{name} can't be called")
        return Node("name", name)

    def listed(self, end: str) -> Iterator[Node]:
        while not self.take(end):
            yield self.expression()
            if self.peek() != end:
                self.need(",")

    def after(self, value: Node) -> Node:
        while True:
            if self.take("."):
                value = Node("item", None, (value, Node("const", self.name())))
            elif self.take("["):
                value = Node("item", None, (value, self.expression()))
                self.need("]")
            elif self.take("|"):
                name = self.name()
                value = Node("filter", name, (value, *(self.listed(")") if self.take("(") else ())))
            else:
                return value


def parse(text: str) -> Node:
    """The syntax tree of a template."""
    parts, at, strip = [], 0, False
    for m in _TAG.finditer(text):
        before = text[at : m.start()]
        before = before.lstrip() if strip else before
        parts.append(("text", before.rstrip() if m[1].endswith("-") else before))
        if m[1][:2] + m[3][-2:] not in ("{{}}", "{%%}", "{##}"):
            raise TemplateError(f"{m[0]!r} doesn't close as it opens")
        if m[1][:2] != "{#":
            parts.append(("write" if m[1][:2] == "{{" else "tag", m[2]))
        at, strip = m.end(), m[3].startswith("-")
    rest = text[at:].lstrip() if strip else text[at:]
    parts.append(("text", rest))
    if any(k == "text" and re.search(r"\{\{|\{%|\{#", t) for k, t in parts):
        raise TemplateError("a tag isn't closed")
    tree, end, left = _block(parts, 0, ())
    if left < len(parts):
        raise TemplateError(f"{end} without a beginning")
    return tree


def _block(parts: list, at: int, ends: tuple[str, ...]) -> tuple[Node, str, int]:
    """(nodes up to a closing tag, that tag, the place of it)."""
    out = []
    while at < len(parts):
        kind, text = parts[at]
        if kind == "text":
            out.append(Node("write", None, (Node("const", text),)))
        elif kind == "write":
            r = Reader(text)
            out.append(Node("write", None, (r.expression(),)))
            r.done()
        else:
            r = Reader(text)
            word = r.peek()
            if word in ("endfor", "endif", "elif", "else", "endgeneration"):
                if word not in ends:
                    raise TemplateError(f"{word} is out of place")
                return Node("block", None, tuple(out)), text, at
            r.at = 1
            if word == "for":
                name = r.name()
                r.need("in")
                over = r.expression()
                body, _, at = _block(parts, at + 1, ("endfor",))
                out.append(Node("for", name, (over, body)))
            elif word == "if":
                node, at = _if(parts, at, r)
                out.append(node)
            elif word == "set":
                name = r.name()
                r.need("=")
                out.append(Node("set", name, (r.expression(),)))
            elif word == "generation":
                body, _, at = _block(parts, at + 1, ("endgeneration",))
                out.append(Node("generation", None, (body,)))
            else:
                raise TemplateError(f"{text.strip()!r} is no statement")
            r.done()
        at += 1
    if ends:
        raise TemplateError(f"{ends[-1]} is missing")
    return Node("block", None, tuple(out)), "", at


def _if(parts: list, at: int, r: Reader) -> tuple[Node, int]:
    test = r.expression()
    body, end, at = _block(parts, at + 1, ("elif", "else", "endif"))
    nothing = Node("block")
    r = Reader(end)
    if r.take("elif"):
        other, at = _if(parts, at, r)
        r.done()
    elif r.take("else"):
        r.done()
        other, _, at = _block(parts, at + 1, ("endif",))
    else:
        other = nothing
    return Node("if", None, (test, body, other)), at


def shown(x: Any) -> str:
    """A value as text."""
    if x is MISSING or x is None:
        return ""
    return "true" if x is True else "false" if x is False else str(x)


_DO: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b, "not in": lambda a, b: a not in b, "~": lambda a, b: shown(a) + shown(b), "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b,
}

FILTERS: dict[str, Callable] = {
    "trim": lambda x: shown(x).strip(), "upper": lambda x: shown(x).upper(), "lower": lambda x: shown(x).lower(), "length": len, "string": shown,
    "default": lambda x, y="": y if x is MISSING or x is None else x, "join": lambda x, y="": y.join(map(shown, x)), "replace": lambda x, a, b: shown(x).replace(a, b),
    "first": lambda x: x[0] if x else MISSING, "last": lambda x: x[-1] if x else MISSING,
}


def _apply(sign: str, a: Any, b: Any) -> Any:
    if sign == "*" and not (isinstance(a, (int, float)) and isinstance(b, (int, float))):
        raise TemplateError("only numbers are multiplied")
    try:
        return _DO[sign](a, b)
    except TypeError:
        raise TemplateError(f"{sign!r} doesn't go with these values") from None


def _item(x: Any, key: Any) -> Any:
    if isinstance(x, dict):
        return x.get(key, MISSING)
    if isinstance(x, (list, str)) and isinstance(key, int) and not isinstance(key, bool) and -len(x) <= key < len(x):
        return x[key]
    return MISSING


def fold(node: Node, filters: dict[str, Callable]) -> Node:
    """The tree with all that needs no values worked out: constants, choices of known outcome, neighbouring texts."""
    below = tuple(fold(x, filters) for x in node.below)
    node = Node(node.kind, node.value, below)
    known = lambda *at: all(below[i].kind == "const" for i in at)
    if node.kind in ("binary", "not", "minus", "item", "filter", "list", "is") and known(*range(len(below))):
        return Node("const", _value(node, filters)({}))
    if node.kind == "choose" and known(0):
        return below[1] if below[0].value else below[2]
    if node.kind == "binary" and node.value in ("and", "or") and known(0):
        return below[1] if bool(below[0].value) == (node.value == "and") else below[0]
    if node.kind == "if" and known(0):
        return below[1] if below[0].value else below[2]
    if node.kind == "for" and known(0) and not below[0].value:
        return Node("block")
    if node.kind == "block":
        out: list[Node] = []
        for x in (y for b in below for y in (b.below if b.kind == "block" else (b,))):
            const = x.kind == "write" and x.below[0].kind == "const"
            if const and out and out[-1].kind == "write" and out[-1].below[0].kind == "const":
                out[-1] = Node("write", None, (Node("const", shown(out[-1].below[0].value) + shown(x.below[0].value)),))
            elif not const or shown(x.below[0].value):
                out.append(x)
        return Node("block", None, tuple(out))
    return node


def _value(node: Node, filters: dict[str, Callable]) -> Callable[[dict], Any]:
    """A closure that works an expression out from the names' values."""
    kind, v = node.kind, node.value
    f = [_value(x, filters) for x in node.below]
    if kind == "const":
        return lambda env: v
    if kind == "name":
        return lambda env: env.get(v, MISSING)
    if kind == "list":
        return lambda env: [x(env) for x in f]
    if kind == "item":
        return lambda env: _item(f[0](env), f[1](env))
    if kind == "not":
        return lambda env: f[0](env) in (MISSING, None) or not f[0](env)
    if kind == "minus":
        return lambda env: _apply("-", 0, f[0](env))
    if kind == "is":
        return (lambda env: f[0](env) is not MISSING) if v == "defined" else (lambda env: f[0](env) is None)
    if kind == "choose":
        return lambda env: f[1](env) if _true(f[0](env)) else f[2](env)
    if kind == "filter":
        own = filters[v]
        return lambda env: own(*[x(env) for x in f])
    if kind == "raise":
        return lambda env: _raise(f[0](env) if f else "")
    if v == "and":
        return lambda env: f[1](env) if _true(x := f[0](env)) else x
    if v == "or":
        return lambda env: x if _true(x := f[0](env)) else f[1](env)
    return lambda env: _apply(v, f[0](env), f[1](env))


def _true(x: Any) -> bool:
    return x is not MISSING and bool(x)


def _raise(text: Any) -> None:
    raise TemplateError(shown(text))


def _statement(node: Node, filters: dict[str, Callable]) -> Callable[[dict], Iterator]:
    """A closure that yields what a statement writes."""
    kind, name = node.kind, node.value
    if kind == "block":
        steps = [_statement(x, filters) for x in node.below]

        def block(env: dict) -> Iterator:
            for step in steps:
                yield from step(env)

        return block
    if kind == "write":
        value = _value(node.below[0], filters)

        def write(env: dict) -> Iterator:
            yield shown(value(env))

        return write
    if kind == "set":
        value = _value(node.below[0], filters)

        def put(env: dict) -> Iterator:
            env[name] = value(env)
            return iter(())

        return put
    if kind == "if":
        test, body, other = _value(node.below[0], filters), _statement(node.below[1], filters), _statement(node.below[2], filters)
        return lambda env: body(env) if _true(test(env)) else other(env)
    if kind == "generation":
        inside = _statement(node.below[0], filters)

        def generation(env: dict) -> Iterator:
            yield OPEN
            yield from inside(env)
            yield CLOSE

        return generation
    over, body = _value(node.below[0], filters), _statement(node.below[1], filters)
    turns = node.below[0] == Node("name", "messages")

    def loop(env: dict) -> Iterator:
        found = over(env)
        if not turns and not isinstance(found, list):
            raise TemplateError("only lists and messages are looped over")
        rows, n = iter(found), 0
        now = next(rows, MISSING)
        while now is not MISSING:
            after = next(rows, MISSING)
            own = {**env, name: now, "loop": {"index": n + 1, "index0": n, "first": n == 0, "last": after is MISSING}}
            yield from body(own)
            if turns:
                yield TURN
            now, n = after, n + 1

    return loop


def _checked(node: Node, filters: dict[str, Callable], inside: bool = False, generated: bool = False) -> int:
    """How often the messages are looped over; raises on what the sandbox doesn't allow."""
    if node.kind == "filter" and node.value not in filters:
        raise TemplateError(f"no filter {node.value}")
    if node.kind == "name" and node.value == "messages":
        raise TemplateError("messages may only be looped over")
    if node.kind == "generation" and generated:
        raise TemplateError("generation inside generation")
    loops, below = 0, node.below
    if node.kind == "for":
        if node.below[0] == Node("name", "messages"):
            if inside or generated:
                raise TemplateError("messages are looped over inside another loop or generation")
            loops, below = 1, node.below[1:]
        inside = True
    if node.kind in ("for", "set") and node.value in ("messages", "loop"):
        raise TemplateError(f"{node.value} can't be set")
    return loops + sum(_checked(x, filters, inside, generated or node.kind == "generation") for x in below)


@dataclass
class Template:
    """A template ready to render."""

    text: str
    filters: dict[str, Callable] = field(default_factory=dict)

    def __post_init__(self):
        known = FILTERS | self.filters
        self.tree = fold(parse(self.text), known)
        if _checked(self.tree, known) != 1:
            raise TemplateError("a template loops over messages once")
        self._run = _statement(self.tree, known)

    def render(self, messages: Iterable[dict], **values: Any) -> Iterator:
        """Strings and OPEN, CLOSE, TURN, as the messages come."""
        return self._run({**values, "messages": messages})
