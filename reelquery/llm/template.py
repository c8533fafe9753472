"""A sandboxed template language compiled to Python closures.

    {{ expr }}  {% if e %}..{% elif e %}..{% else %}..{% endif %}
    {% for x in e %}..{% endfor %}  {% set x = e %}
    {% generation %}..{% endgeneration %}  {# comment #}   "-" inside a mark trims white space

Expressions: literals, names, `a.b` and `a["b"]` (keys of mappings, indices of
strings and lists; never attributes of Python objects), filters, `~ + - * %`,
comparisons, `in`, `and or not`, and `a if c else b`.  Inside a loop, `loop`
has index, index0, first and last.

Source -> tokens -> syntax tree -> folded tree -> closures.  A closure takes
the variables and yields strings and the marks START and END, so messages may
be a stream: a loop looks one item ahead and keeps nothing else.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from enum import Enum
from typing import Any


class TemplateError(ValueError):
    """The template cannot be parsed, or asks for what the sandbox does not give."""


class Mark(Enum):
    START = 1
    END = 2


START, END = Mark.START, Mark.END
Piece = str | Mark


# Syntax tree -----------------------------------------------------------------


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
class Call:
    """A pure function of its operands: operators and filters."""

    name: str
    operands: tuple


@dataclass(frozen=True)
class Choice:
    test: Any
    yes: Any
    no: Any


@dataclass(frozen=True)
class Logic:
    both: bool  # and / or
    left: Any
    right: Any


@dataclass(frozen=True)
class Output:
    value: Any


@dataclass(frozen=True)
class Block:
    nodes: tuple = ()


@dataclass(frozen=True)
class Branch:
    test: Any
    yes: Block
    no: Block


@dataclass(frozen=True)
class Loop:
    name: str
    over: Any
    body: Block


@dataclass(frozen=True)
class Assign:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: Block


def _contains(a: Any, b: Any) -> bool:
    if isinstance(b, str) and not isinstance(a, str):
        raise TemplateError("only a string can lie in a string")
    return a in b


def _number(f: Callable) -> Callable:
    def run(a: Any, b: Any) -> Any:
        if not isinstance(a, int | float) or not isinstance(b, int | float):
            raise TemplateError("arithmetic needs numbers")
        return f(a, b)

    return run


def _plus(a: Any, b: Any) -> Any:
    if type(a) is not type(b) and not (isinstance(a, int | float) and isinstance(b, int | float)):
        raise TemplateError("+ needs two numbers or two strings")
    return a + b


FUNCTIONS: dict[str, Callable] = {
    "~": lambda a, b: text_of(a) + text_of(b),
    "+": _plus, "-": _number(operator.sub), "*": _number(operator.mul), "%": _number(operator.mod),
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "in": _contains, "not": operator.not_,
}
FILTERS: dict[str, Callable] = {
    "trim": lambda a: text_of(a).strip(),
    "upper": lambda a: text_of(a).upper(),
    "lower": lambda a: text_of(a).lower(),
    "length": lambda a: len(a),
    "string": lambda a: text_of(a),
    "default": lambda a, b="": b if a is None else a,
}


def text_of(value: Any) -> str:
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, bool | int | float):
        return str(value)
    raise TemplateError("only strings and numbers can be written")


# Parsing ---------------------------------------------------------------------

_MARKS = re.compile(r"\{%-?.*?-?%\}|\{\{-?.*?-?\}\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(
    r"""\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<string>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")"""
    r"""|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-~+*%<>().,|\[\]=]))""",
    re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Tokens:
    def __init__(self, source: str) -> None:
        self.all: list[tuple[str, str]] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.all.append((m.lastgroup or "", m[m.lastgroup or 0]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.all[self.at] if self.at < len(self.all) else ("end", "")

    def next(self) -> tuple[str, str]:
        token = self.peek()
        self.at += 1
        return token

    def take(self, *values: str) -> str | None:
        kind, value = self.peek()
        if kind in ("op", "name") and value in values:
            self.at += 1
            return value
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected, found {self.peek()[1]!r}")

    def name(self) -> str:
        kind, value = self.next()
        if kind != "name" or value.startswith("__"):
            raise TemplateError(f"a name is expected, found {value!r}")
        return value

    def done(self) -> None:
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")


class _Expressions:
    """Recursive descent, one method per level of precedence."""

    def __init__(self, tokens: _Tokens, filters: Mapping[str, Callable]) -> None:
        self.t, self.filters = tokens, filters

    def choice(self) -> Any:
        value = self.either()
        if self.t.take("if"):
            test = self.either()
            no = self.choice() if self.t.take("else") else Const(None)
            return Choice(test, value, no)
        return value

    def either(self) -> Any:
        left = self.both()
        while self.t.take("or"):
            left = Logic(False, left, self.both())
        return left

    def both(self) -> Any:
        left = self.negation()
        while self.t.take("and"):
            left = Logic(True, left, self.negation())
        return left

    def negation(self) -> Any:
        return Call("not", (self.negation(),)) if self.t.take("not") else self.comparison()

    def comparison(self) -> Any:
        left = self.sum()
        while True:
            if op := self.t.take("==", "!=", "<=", ">=", "<", ">", "in"):
                left = Call(op, (left, self.sum()))
            elif self.t.take("not"):
                self.t.need("in")
                left = Call("not", (Call("in", (left, self.sum())),))
            else:
                return left

    def sum(self) -> Any:
        left = self.product()
        while op := self.t.take("+", "-", "~"):
            left = Call(op, (left, self.product()))
        return left

    def product(self) -> Any:
        left = self.filtered()
        while op := self.t.take("*", "%"):
            left = Call(op, (left, self.filtered()))
        return left

    def filtered(self) -> Any:
        value = self.item()
        while self.t.take("|"):
            name, operands = self.t.name(), [value]
            if name not in self.filters:
                raise TemplateError(f"there is no filter {name!r}")
            if self.t.take("("):
                while not self.t.take(")"):
                    operands.append(self.choice())
                    if not self.t.take(","):
                        self.t.need(")")
                        break
            value = Call("|" + name, tuple(operands))
        return value

    def item(self) -> Any:
        value = self.atom()
        while op := self.t.take(".", "["):
            if op == ".":
                value = Item(value, Const(self.t.name()))
            else:
                value = Item(value, self.choice())
                self.t.need("]")
        return value

    def atom(self) -> Any:
        if self.t.take("("):
            value = self.choice()
            self.t.need(")")
            return value
        kind, value = self.t.next()
        if kind == "number":
            return Const(float(value) if "." in value else int(value))
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "name" and not value.startswith("__"):
            known = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
            return Const(known[value]) if value in known else Name(value)
        raise TemplateError(f"a value is expected, found {value!r}")


def _cut(source: str) -> Iterator[tuple[str, str]]:
    """("text" | "out" | "tag", content)."""
    at, trim = 0, False
    for m in _MARKS.finditer(source):
        text = source[at : m.start()]
        inner = m[0][2:-2]
        if m[0][1] != "#":
            if inner.startswith("-"):
                text, inner = text.rstrip(), inner[1:]
            if trim:
                text = text.lstrip()
            trim = inner.endswith("-")
            inner = inner[:-1] if trim else inner
        if text:
            yield "text", text
        if m[0][1] != "#":
            yield ("out" if m[0][1] == "{" else "tag"), inner
        at = m.end()
    text = source[at:]
    if text.lstrip() if trim else text:
        yield "text", text.lstrip() if trim else text


@dataclass
class _Parser:
    parts: list[tuple[str, str]]
    filters: Mapping[str, Callable]
    at: int = 0

    def block(self, *ends: str) -> tuple[Block, _Tokens | None]:
        nodes: list = []
        while self.at < len(self.parts):
            kind, content = self.parts[self.at]
            self.at += 1
            if kind == "text":
                nodes.append(Output(Const(content)))
                continue
            tokens = _Tokens(content)
            if kind == "out":
                nodes.append(Output(self.whole(tokens)))
                continue
            word = tokens.peek()[1]
            if word in ends:
                return Block(tuple(nodes)), tokens
            nodes.append(self.tag(tokens))
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return Block(tuple(nodes)), None

    def whole(self, tokens: _Tokens) -> Any:
        value = _Expressions(tokens, self.filters).choice()
        tokens.done()
        return value

    def tag(self, tokens: _Tokens) -> Any:
        word = tokens.name()
        if word == "if":
            return self.branch(tokens)
        if word == "for":
            name = tokens.name()
            tokens.need("in")
            over = self.whole(tokens)
            return Loop(name, over, self.block("endfor")[0])
        if word == "set":
            name = tokens.name()
            tokens.need("=")
            return Assign(name, self.whole(tokens))
        if word == "generation":
            tokens.done()
            return Generation(self.block("endgeneration")[0])
        raise TemplateError(f"there is no tag {word!r}")

    def branch(self, tokens: _Tokens) -> Branch:
        test = self.whole(tokens)
        yes, end = self.block("elif", "else", "endif")
        word = end.name() if end else ""
        if word == "elif" and end:
            return Branch(test, yes, Block((self.branch(end),)))
        no = self.block("endif")[0] if word == "else" else Block()
        return Branch(test, yes, no)


def parse(source: str, filters: Mapping[str, Callable]) -> Block:
    return _Parser(list(_cut(source)), filters).block()[0]


# Folding ---------------------------------------------------------------------


def _function(name: str, filters: Mapping[str, Callable]) -> Callable:
    return filters[name[1:]] if name[0] == "|" else FUNCTIONS[name]


def fold(node: Any, filters: Mapping[str, Callable]) -> Any:
    """Evaluate what depends on constants only, drop dead branches, join neighbouring text."""
    f = lambda n: fold(n, filters)
    match node:
        case Item(of, key):
            of, key = f(of), f(key)
            return Const(_item(of.value, key.value)) if isinstance(of, Const) and isinstance(key, Const) else Item(of, key)
        case Call(name, operands):
            operands = tuple(map(f, operands))
            if all(isinstance(o, Const) for o in operands):
                return Const(_function(name, filters)(*(o.value for o in operands)))
            return Call(name, operands)
        case Choice(test, yes, no):
            test = f(test)
            return f(yes if test.value else no) if isinstance(test, Const) else Choice(test, f(yes), f(no))
        case Logic(both, left, right):
            left = f(left)
            if isinstance(left, Const):
                return f(right) if bool(left.value) == both else left
            return Logic(both, left, f(right))
        case Output(value):
            value = f(value)
            return Output(Const(text_of(value.value)) if isinstance(value, Const) else value)
        case Assign(name, value):
            return Assign(name, f(value))
        case Branch(test, yes, no):
            test = f(test)
            return f(yes if test.value else no) if isinstance(test, Const) else Branch(test, f(yes), f(no))
        case Loop(name, over, body):
            return Loop(name, f(over), f(body))
        case Generation(body):
            return Generation(f(body))
        case Block(nodes):
            out: list = []
            for n in map(f, nodes):
                for m in n.nodes if isinstance(n, Block) else (n,):
                    constant = isinstance(m, Output) and isinstance(m.value, Const)
                    if constant and not m.value.value:
                        continue
                    if constant and out and isinstance(out[-1], Output) and isinstance(out[-1].value, Const):
                        out[-1] = Output(Const(out[-1].value.value + m.value.value))
                    else:
                        out.append(m)
            return Block(tuple(out))
    return node


# Closures --------------------------------------------------------------------


def _item(of: Any, key: Any) -> Any:
    if isinstance(of, Mapping):
        return of.get(key)
    if isinstance(of, str | list | tuple) and isinstance(key, int):
        return of[key] if -len(of) <= key < len(of) else None
    raise TemplateError(f"{key!r} cannot be looked up there")


def _value(node: Any, filters: Mapping[str, Callable]) -> Callable[[dict], Any]:
    v = lambda n: _value(n, filters)
    match node:
        case Const(value):
            return lambda _: value
        case Name(name):
            return lambda c: c.get(name)
        case Item(of, key):
            of, key = v(of), v(key)
            return lambda c: _item(of(c), key(c))
        case Call(name, operands):
            function = _function(name, filters)
            if len(operands) == 1:
                (a,) = map(v, operands)
                return lambda c: function(a(c))
            if len(operands) == 2:
                a, b = map(v, operands)
                return lambda c: function(a(c), b(c))
            each = tuple(map(v, operands))
            return lambda c: function(*(e(c) for e in each))
        case Choice(test, yes, no):
            test, yes, no = v(test), v(yes), v(no)
            return lambda c: yes(c) if test(c) else no(c)
        case Logic(both, left, right):
            left, right = v(left), v(right)
            return (lambda c: left(c) and right(c)) if both else (lambda c: left(c) or right(c))
    raise TemplateError(f"cannot compile {node!r}")


Render = Callable[[dict], Iterator[Piece]]


def _render(node: Any, filters: Mapping[str, Callable]) -> Render:
    match node:
        case Output(Const(text)):

            def write_constant(_: dict) -> Iterator[Piece]:
                yield text

            return write_constant
        case Output(value):
            value = _value(value, filters)

            def write(c: dict) -> Iterator[Piece]:
                yield text_of(value(c))

            return write
        case Assign(name, value):
            value = _value(value, filters)

            def assign(c: dict) -> Iterator[Piece]:
                c[name] = value(c)
                return iter(())

            return assign
        case Block(nodes):
            runs = tuple(_render(n, filters) for n in nodes)

            def block(c: dict) -> Iterator[Piece]:
                for run in runs:
                    yield from run(c)

            return block if len(runs) != 1 else runs[0]
        case Branch(test, yes, no):
            test, yes, no = _value(test, filters), _render(yes, filters), _render(no, filters)
            return lambda c: yes(c) if test(c) else no(c)
        case Generation(body):
            body = _render(body, filters)

            def generation(c: dict) -> Iterator[Piece]:
                yield START
                yield from body(c)
                yield END

            return generation
        case Loop(name, over, body):
            over, body = _value(over, filters), _render(body, filters)

            def loop(c: dict) -> Iterator[Piece]:
                items, index = iter(over(c) or ()), 0
                ahead = next(items, items)
                while ahead is not items:
                    now, ahead = ahead, next(items, items)
                    state = {"index": index + 1, "index0": index, "first": not index, "last": ahead is items}
                    yield from body({**c, name: now, "loop": state})
                    index += 1

            return loop
    raise TemplateError(f"cannot compile {node!r}")


def compile_template(source: str, filters: Mapping[str, Callable] | None = None) -> Callable[..., Iterator[Piece]]:
    """source -> render(**variables), which yields strings and marks."""
    filters = {**FILTERS, **(filters or {})}
    run = _render(fold(parse(source, filters), filters), filters)
    return lambda **variables: run(variables)


def with_spans(pieces: Iterable[Piece]) -> tuple[str, list[tuple[int, int]]]:
    """Text, and the spans (code points, end exclusive) between START and END."""
    out: list[str] = []
    spans: list[tuple[int, int]] = []
    at = start = 0
    for p in pieces:
        if p is START:
            start = at
        elif p is END:
            spans.append((start, at))
        else:
            out.append(p)
            at += len(p)
    return "".join(out), spans
