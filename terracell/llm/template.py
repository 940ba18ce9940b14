"""A small sandboxed template language, compiled to Python closures.

Text stands for itself. ``{{ e }}`` prints, ``{% if %}/{% elif %}/{% else %}``,
``{% for x in e %}`` and ``{% set x = e %}`` control, ``{% generation %}`` marks
its output as generated, ``{# #}`` is a comment; a minus inside a tag strips the
white space beside it. Expressions have literals, names, ``a.b`` and ``a[b]``,
arithmetic, ``~``, comparisons, ``in``, ``and``/``or``/``not``, ``x if c else y``,
tests (``is defined``, ``is none``) and filters.

Sandbox: a template sees the values it is given and nothing else. ``a.b`` looks
up a mapping's key and never a Python attribute; there are no calls but the
filters listed here; numbers alone multiply; nesting is bounded, and output too
unless the caller trusts the template (``most_chars`` None).

Three steps: ``parse`` to a syntax tree, ``fold`` constants (arithmetic, filters,
decided branches, adjacent text), ``Template`` to closures over the tree.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

DEPTH = 64
MOST_CHARS = 1 << 30


class TemplateError(ValueError):
    """A template that is wrong, or does what the sandbox refuses."""


class Undefined:
    """The value of a missing name or key: prints nothing, is false."""

    def __bool__(self):
        return False

    def __str__(self):
        return ""


UNDEFINED = Undefined()


# --- syntax tree -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Unary:
    op: str
    arg: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Choice:
    test: Any
    then: Any
    other: Any


@dataclass(frozen=True)
class Many:
    items: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    args: tuple


@dataclass(frozen=True)
class Test:
    name: str
    arg: Any


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Print:
    value: Any


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple
    empty: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


# --- values ----------------------------------------------------------------------------------------------------------


def to_text(v: Any) -> str:
    if v is None or v is UNDEFINED:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str | int | float):
        return str(v)
    raise TemplateError(f"{type(v).__name__} does not print")


_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """No "<|" is left: every "<", backslashes, "|" gets one more backslash. ``unescape`` undoes it."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_line(text: str) -> str:
    """As ``escape``, and without line ends."""
    return escape(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_line(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text), flags=re.S)


FILTERS: dict[str, Callable] = {
    "escape": lambda v: escape(to_text(v)),
    "escape_line": lambda v: escape_line(to_text(v)),
    "trim": lambda v: to_text(v).strip(),
    "upper": lambda v: to_text(v).upper(),
    "lower": lambda v: to_text(v).lower(),
    "string": to_text,
    "length": lambda v: len(v) if isinstance(v, str | list | tuple | dict) else 0,
    "first": lambda v: v[0] if v else UNDEFINED,
    "last": lambda v: v[-1] if v else UNDEFINED,
    "default": lambda v, other="": other if v is UNDEFINED or v is None else v,
    "replace": lambda v, old, new: to_text(v).replace(to_text(old), to_text(new)),
    "join": lambda v, sep="": to_text(sep).join(map(to_text, v)),
}
TESTS: dict[str, Callable] = {
    "defined": lambda v: v is not UNDEFINED,
    "undefined": lambda v: v is UNDEFINED,
    "none": lambda v: v is None,
    "string": lambda v: isinstance(v, str),
    "mapping": lambda v: isinstance(v, dict),
}


def _number(op: Callable) -> Callable:
    def run(a, b):
        if not all(isinstance(x, int | float) for x in (a, b)):
            raise TemplateError("arithmetic needs numbers")
        return op(a, b)

    return run


def _plus(a, b):
    if isinstance(a, str) and isinstance(b, str) or isinstance(a, list) and isinstance(b, list):
        return a + b
    return _number(operator.add)(a, b)


def _inside(a, b):
    if isinstance(b, str):
        return to_text(a) in b
    return a in b if isinstance(b, list | tuple | dict) else False


BINARY: dict[str, Callable] = {
    "+": _plus,
    "-": _number(operator.sub),
    "*": _number(operator.mul),
    "/": _number(operator.truediv),
    "//": _number(operator.floordiv),
    "%": _number(operator.mod),
    "~": lambda a, b: to_text(a) + to_text(b),
    "==": operator.eq,
    "!=": operator.ne,
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
    "in": _inside,
    "not in": lambda a, b: not _inside(a, b),
}
UNARY: dict[str, Callable] = {"not": operator.not_, "-": lambda a: _number(operator.sub)(0, a)}


def _item(of, key):
    if isinstance(of, dict):
        return of.get(key, UNDEFINED)
    if isinstance(of, list | tuple | str) and isinstance(key, int) and not isinstance(key, bool):
        return of[key] if -len(of) <= key < len(of) else UNDEFINED
    return UNDEFINED


# --- parsing ---------------------------------------------------------------------------------------------------------

_TAG = re.compile(r"\{(?P<kind>[{%#])(?P<l>-?)(?P<body>.*?)(?P<r>-?)(?P<end>[}%#])\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|//|[-+*/%~<>|.,()\[\]=])|$)""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_RESERVED = {"in", "not", "and", "or", "is", "if", "else"}


class _Expression:
    """Recursive descent over one tag's text."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                raise TemplateError(f"unexpected {text[at : at + 12]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at, self.depth = 0, 0

    def peek(self) -> str | None:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return None if kind == "str" else value

    def take(self, *values: str) -> str | None:
        if (v := self.peek()) in values:
            self.at += 1
            return v
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"expected {value!r}")

    def name(self) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, "")
        if kind != "name" or value in _RESERVED or value in _WORDS:
            raise TemplateError(f"expected a name, not {value!r}")
        self.at += 1
        return value

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def expression(self):
        self.depth += 1
        if self.depth > DEPTH:
            raise TemplateError("nested too deep")
        value = self._or()
        if self.take("if"):
            test = self._or()
            value = Choice(test, value, self.expression() if self.take("else") else Const(UNDEFINED))
        self.depth -= 1
        return value

    def _or(self):
        left = self._and()
        while self.take("or"):
            left = Binary("or", left, self._and())
        return left

    def _and(self):
        left = self._not()
        while self.take("and"):
            left = Binary("and", left, self._not())
        return left

    def _not(self):
        return Unary("not", self._not()) if self.take("not") else self._compare()

    def _compare(self):
        left = self._concat()
        while True:
            if op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
                left = Binary(op, left, self._concat())
            elif self.peek() == "not":
                self.at += 1
                self.need("in")
                left = Binary("not in", left, self._concat())
            elif self.take("is"):
                negate = self.take("not")
                kind, word = self.tokens[self.at] if self.at < len(self.tokens) else (None, "")
                if word not in TESTS:
                    raise TemplateError(f"no test {word!r}")
                self.at += 1
                left = Unary("not", Test(word, left)) if negate else Test(word, left)
            else:
                return left

    def _concat(self):
        left = self._sum()
        while op := self.take("~"):
            left = Binary(op, left, self._sum())
        return left

    def _sum(self):
        left = self._product()
        while op := self.take("+", "-"):
            left = Binary(op, left, self._product())
        return left

    def _product(self):
        left = self._unary()
        while op := self.take("*", "/", "//", "%"):
            left = Binary(op, left, self._unary())
        return left

    def _unary(self):
        return Unary("-", self._unary()) if self.take("-") else self._filtered()

    def _filtered(self):
        value = self._atom()
        while True:
            if self.take("."):
                value = Item(value, Const(self.name()))
            elif self.take("["):
                value = Item(value, self.expression())
                self.need("]")
            elif self.take("|"):
                name, args = self.name(), [value]
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                if self.take("("):
                    while not self.take(")"):
                        args.append(self.expression())
                        if self.peek() != ")":
                            self.need(",")
                value = Filter(name, tuple(args))
            else:
                return value

    def _atom(self):
        if self.take("("):
            value = self.expression()
            self.need(")")
            return value
        if self.take("["):
            items = []
            while not self.take("]"):
                items.append(self.expression())
                if self.peek() != "]":
                    self.need(",")
            return Many(tuple(items))
        if self.at >= len(self.tokens):
            raise TemplateError("expression expected")
        kind, value = self.tokens[self.at]
        if kind == "op" or value in _RESERVED and kind == "name":
            raise TemplateError(f"unexpected {value!r}")
        self.at += 1
        if kind == "num":
            return Const(float(value) if "." in value else int(value))
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], "\\" + m[1]), value[1:-1], flags=re.S))
        return Const(_WORDS[value]) if value in _WORDS else Name(value)


def _pieces(source: str) -> list[tuple[str, str]]:
    """(kind, text): kind is "text", "{" or "%"; white space stripped where asked."""
    out, at, strip = [], 0, False
    for m in _TAG.finditer(source):
        if m["end"] != {"{": "}", "%": "%", "#": "#"}[m["kind"]]:
            raise TemplateError(f"unmatched {m[0]!r}")
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        out.append(("text", text.rstrip() if m["l"] else text))
        out.append((m["kind"], m["body"].strip()))
        at, strip = m.end(), bool(m["r"])
    rest = source[at:]
    out.append(("text", rest.lstrip() if strip else rest))
    if any(k == "text" and re.search(r"\{[{%#]|[}%#]\}", t) for k, t in out):
        raise TemplateError("a tag is not closed or not opened")
    return [(k, t) for k, t in out if k != "#" and not (k == "text" and not t)]


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    pieces = _pieces(source)
    at = 0

    def body(ends: tuple[str, ...], depth: int) -> tuple[tuple, str]:
        nonlocal at
        if depth > DEPTH:
            raise TemplateError("nested too deep")
        out = []
        while at < len(pieces):
            kind, text = pieces[at]
            at += 1
            if kind == "text":
                out.append(Text(text))
                continue
            if kind == "{":
                e = _Expression(text)
                out.append(Print(e.expression()))
                e.end()
                continue
            word, _, rest = text.partition(" ")
            if word in ends:
                return tuple(out), text
            e = _Expression(rest)
            if word == "if":
                test = e.expression()
                e.end()
                out.append(branch(test, depth))
            elif word == "for":
                name = e.name()
                e.need("in")
                over = e.expression()
                e.end()
                inside, end = body(("endfor", "else"), depth + 1)
                empty = body(("endfor",), depth + 1)[0] if end == "else" else ()
                out.append(For(name, over, inside, empty))
            elif word == "set":
                name = e.name()
                e.need("=")
                out.append(Set(name, e.expression()))
                e.end()
            elif word == "generation":
                out.append(Generation(body(("endgeneration",), depth + 1)[0]))
            else:
                raise TemplateError(f"unexpected tag {text!r}")
        if ends:
            raise TemplateError(f"expected {' or '.join(ends)}")
        return tuple(out), ""

    def branch(test, depth: int) -> If:
        then, end = body(("elif", "else", "endif"), depth + 1)
        if end.startswith("elif"):
            e = _Expression(end[4:])
            inner = e.expression()
            e.end()
            return If(test, then, (branch(inner, depth + 1),))
        return If(test, then, body(("endif",), depth + 1)[0] if end == "else" else ())

    return body((), 0)[0]


# --- constant folding ------------------------------------------------------------------------------------------------


def _fold(e):
    """An expression with what is constant computed; a constant error stays for the time of rendering."""
    if isinstance(e, Const | Name):
        return e
    if isinstance(e, Choice):
        test = _fold(e.test)
        if isinstance(test, Const):
            return _fold(e.then if test.value else e.other)
        return Choice(test, _fold(e.then), _fold(e.other))
    if isinstance(e, Binary) and e.op in ("and", "or"):
        left, right = _fold(e.left), _fold(e.right)
        if isinstance(left, Const):
            return right if bool(left.value) == (e.op == "and") else left
        return Binary(e.op, left, right)
    if isinstance(e, Item):
        e = Item(_fold(e.of), _fold(e.key))
        parts, run = (e.of, e.key), _item
    elif isinstance(e, Unary):
        e = Unary(e.op, _fold(e.arg))
        parts, run = (e.arg,), UNARY[e.op]
    elif isinstance(e, Binary):
        e = Binary(e.op, _fold(e.left), _fold(e.right))
        parts, run = (e.left, e.right), BINARY[e.op]
    elif isinstance(e, Many):
        e = Many(tuple(map(_fold, e.items)))
        parts, run = e.items, lambda *v: list(v)
    elif isinstance(e, Filter):
        e = Filter(e.name, tuple(map(_fold, e.args)))
        parts, run = e.args, FILTERS[e.name]
    else:
        e = Test(e.name, _fold(e.arg))
        parts, run = (e.arg,), TESTS[e.name]
    if all(isinstance(p, Const) for p in parts):
        try:
            return Const(run(*(p.value for p in parts)))
        except Exception:  # the same error comes when the expression is evaluated
            return e
    return e


def fold(nodes: tuple) -> tuple:
    """The tree with constants folded, decided branches taken and adjacent text joined."""
    out: list = []

    def add(node) -> None:
        if isinstance(node, Text) and out and isinstance(out[-1], Text):
            out[-1] = Text(out[-1].text + node.text)
        elif not (isinstance(node, Text) and not node.text):
            out.append(node)

    for node in nodes:
        if isinstance(node, Print):
            value = _fold(node.value)
            if isinstance(value, Const) and not isinstance(value.value, list | dict):
                add(Text(to_text(value.value)))
            else:
                add(Print(value))
        elif isinstance(node, If):
            test = _fold(node.test)
            if isinstance(test, Const):
                for inner in fold(node.then if test.value else node.other):
                    add(inner)
            else:
                add(If(test, fold(node.then), fold(node.other)))
        elif isinstance(node, For):
            add(replace(node, over=_fold(node.over), body=fold(node.body), empty=fold(node.empty)))
        elif isinstance(node, Set):
            add(Set(node.name, _fold(node.value)))
        elif isinstance(node, Generation):
            add(Generation(fold(node.body)))
        else:
            add(node)
    return tuple(out)


# --- closures --------------------------------------------------------------------------------------------------------


@dataclass
class Output:
    parts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)
    most: int | None = MOST_CHARS

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)
        if self.most is not None and self.length > self.most:
            raise TemplateError("output too long")


def _value(e) -> Callable[[dict], Any]:
    if isinstance(e, Const):
        return lambda env, v=e.value: v
    if isinstance(e, Name):
        return lambda env, n=e.name: env.get(n, UNDEFINED)
    if isinstance(e, Item):
        of, key = _value(e.of), _value(e.key)
        return lambda env: _item(of(env), key(env))
    if isinstance(e, Unary):
        arg, op = _value(e.arg), UNARY[e.op]
        return lambda env: op(arg(env))
    if isinstance(e, Choice):
        test, then, other = _value(e.test), _value(e.then), _value(e.other)
        return lambda env: then(env) if test(env) else other(env)
    if isinstance(e, Binary):
        left, right = _value(e.left), _value(e.right)
        if e.op == "and":
            return lambda env: left(env) and right(env)
        if e.op == "or":
            return lambda env: left(env) or right(env)
        op = BINARY[e.op]

        def binary(env):
            try:
                return op(left(env), right(env))
            except (TypeError, ZeroDivisionError) as error:
                raise TemplateError(str(error)) from None

        return binary
    if isinstance(e, Many):
        items = [_value(x) for x in e.items]
        return lambda env: [f(env) for f in items]
    if isinstance(e, Filter):
        run, args = FILTERS[e.name], [_value(x) for x in e.args]

        def filtered(env):
            try:
                return run(*(f(env) for f in args))
            except TypeError as error:
                raise TemplateError(str(error)) from None

        return filtered
    test, arg = TESTS[e.name], _value(e.arg)
    return lambda env: test(arg(env))


def _statement(node) -> Callable[[dict, Output], None]:
    if isinstance(node, Text):
        return lambda env, out, t=node.text: out.add(t)
    if isinstance(node, Print):
        value = _value(node.value)
        return lambda env, out: out.add(to_text(value(env)))
    if isinstance(node, Set):
        value = _value(node.value)
        return lambda env, out, n=node.name: env.__setitem__(n, value(env))
    if isinstance(node, If):
        test, then, other = _value(node.test), _block(node.then), _block(node.other)
        return lambda env, out: then(env, out) if test(env) else other(env, out)
    if isinstance(node, Generation):
        inside = _block(node.body)

        def generation(env, out):
            at = out.length
            inside(env, out)
            if out.length > at:
                out.spans.append((at, out.length))

        return generation
    over, inside, empty, name = _value(node.over), _block(node.body), _block(node.empty), node.name

    def loop(env, out):
        items = over(env)
        if not isinstance(items, list | tuple):
            raise TemplateError("for needs a list")
        if not items:
            empty(env, out)
        for i, item in enumerate(items):
            inner = dict(env)
            inner[name] = item
            inner["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(items) - 1, "length": len(items)}
            inside(inner, out)

    return loop


def _block(nodes: tuple) -> Callable[[dict, Output], None]:
    runs = [_statement(n) for n in nodes]
    if len(runs) == 1:
        return runs[0]

    def block(env, out):
        for run in runs:
            run(env, out)

    return block


class Template:
    """A compiled template; ``render`` gives the text and the generated spans."""

    def __init__(self, source: str, most_chars: int | None = MOST_CHARS):
        self.tree, self.most_chars = fold(parse(source)), most_chars
        self._run = _block(self.tree)

    def render(self, **values: Any) -> tuple[str, list[tuple[int, int]]]:
        out = Output(most=self.most_chars)
        self._run(dict(values), out)
        return "".join(out.parts), out.spans
