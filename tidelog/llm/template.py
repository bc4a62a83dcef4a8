"""A small sandboxed template language: parsed to a syntax tree, constants folded, compiled to Python closures.

    {{ expr }}   {% set x = expr %}   {% for x in expr %}..{% endfor %}   {% if a %}..{% elif b %}..{% else %}..{% endif %}
    {% generation %}..{% endgeneration %}   {# comment #}

Expressions: strings, integers, true, false, none, names, a.key and a['key'] of mappings, list[0], ~ + - * == != < <= > >= in, not, and,
or, a if c else b, and filters (a | name). Names are those the caller passes, those set, and loop (index, index0, first, last). Mappings and
lists are the only things that can be looked into and no method can be called, so a template reaches nothing but its data.

Only whole numbers of up to 64 bits can be multiplied, so no text can be repeated and folding makes nothing longer than the source. What is rendered, and
what a name is set to, may have ``ROOM`` code points and ``TIMES`` as many as the data that was passed; more is a ``TemplateError``.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#.*?#\}", re.S)
TOKEN = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+*~<>|.()\[\]]))""", re.S)
COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
WORDS = {"true": True, "false": False, "none": None}
FILTERS: dict[str, Callable[[Any], Any]] = {"trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "length": len, "string": lambda x: shown(x)}


#: Code points that a rendering may have beside ``TIMES`` those of its data.
ROOM, TIMES = 1 << 20, 64


class TemplateError(ValueError):
    pass


def times(x: Any, y: Any) -> int:
    if not (isinstance(x, int) and isinstance(y, int)):
        raise TemplateError("only numbers can be multiplied")
    if abs(x * y) >= 1 << 63:
        raise TemplateError("a product of more than 64 bits")
    return x * y


def size_of(x: Any) -> int:
    """Code points and members of data."""
    if isinstance(x, dict):
        return 1 + sum(size_of(k) + size_of(v) for k, v in x.items())
    return 1 + (len(x) if isinstance(x, str) else sum(map(size_of, x)) if isinstance(x, (list, tuple)) else 0)


def shown(x: Any) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


# The syntax tree. An expression is ("const", v), ("name", n), ("get", e, key), ("op", f, [e..]), ("and"|"or", a, b), ("if", c, a, b) or
# ("filter", name, e); a statement is ("text", s), ("out", e), ("set", n, e), ("for", n, e, body), ("cond", [(e, body)..]) or ("gen", body).


class _Expression:
    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while source[at:].strip():
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unreadable: {source[at:]!r}")
            self.tokens.append((("str", "int", "word", "sign")[m.lastindex - 1], m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("word", "sign") and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected")

    def whole(self) -> tuple:
        e = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return e

    def choice(self) -> tuple:
        a = self.either()
        if self.take("if"):
            c = self.either()
            self.need("else")
            return ("if", c, a, self.choice())
        return a

    def either(self) -> tuple:
        a = self.both()
        while self.take("or"):
            a = ("or", a, self.both())
        return a

    def both(self) -> tuple:
        a = self.negated()
        while self.take("and"):
            a = ("and", a, self.negated())
        return a

    def negated(self) -> tuple:
        return ("op", operator.not_, [self.negated()]) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        a = self.summed()
        while True:
            if sign := self.take(*COMPARE):
                a = ("op", COMPARE[sign], [a, self.summed()])
            elif self.take("in"):
                a = ("op", lambda x, y: x in y, [a, self.summed()])
            elif self.peek("not") and self.tokens[self.at + 1 : self.at + 2] == [("word", "in")]:
                self.at += 2
                a = ("op", lambda x, y: x not in y, [a, self.summed()])
            else:
                return a

    def summed(self) -> tuple:
        a = self.multiplied()
        while sign := self.take("+", "-", "~"):
            f = {"+": operator.add, "-": operator.sub, "~": lambda x, y: shown(x) + shown(y)}[sign]
            a = ("op", f, [a, self.multiplied()])
        return a

    def multiplied(self) -> tuple:
        a = self.filtered()
        while self.take("*"):
            a = ("op", times, [a, self.filtered()])
        return a

    def filtered(self) -> tuple:
        a = self.reached()
        while self.take("|"):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "word":
                raise TemplateError("a filter's name expected")
            self.at += 1
            a = ("filter", name, a)
        return a

    def reached(self) -> tuple:
        a = self.atom()
        while True:
            if self.take("."):
                kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
                if kind != "word":
                    raise TemplateError("a key expected")
                self.at += 1
                a = ("get", a, ("const", name))
            elif self.take("["):
                a = ("get", a, self.choice())
                self.need("]")
            else:
                return a

    def atom(self) -> tuple:
        if self.take("("):
            e = self.choice()
            self.need(")")
            return e
        if self.take("-"):
            return ("op", operator.neg, [self.atom()])
        if self.at >= len(self.tokens):
            raise TemplateError("an expression expected")
        kind, v = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), v[1:-1], flags=re.S))
        if kind == "int":
            if len(v) > 18:
                raise TemplateError(f"too large: {v}")
            return ("const", int(v))
        if kind == "word":
            return ("const", WORDS[v]) if v in WORDS else ("name", v)
        raise TemplateError(f"unexpected {v!r}")


def parse(source: str) -> list[tuple]:
    """The statements of a template. A - inside a tag's brace strips the white space on that side."""
    parts: list[tuple[str, str]] = []
    at, strip = 0, False
    for m in TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        left, right = (m[1] or m[4]), (m[3] or m[6])
        parts.append(("text", text.rstrip() if left else text))
        if m[2] is not None:
            parts.append(("out", m[2]))
        elif m[5] is not None:
            parts.append(("tag", m[5].strip()))
        at, strip = m.end(), bool(right)
    parts.append(("text", source[at:].lstrip() if strip else source[at:]))
    body, rest, end = _block(parts, 0, ())
    if end:
        raise TemplateError(f"unexpected {end!r}")
    return body


def _block(parts: list[tuple[str, str]], at: int, ends: tuple[str, ...]) -> tuple[list[tuple], int, str]:
    body: list[tuple] = []
    while at < len(parts):
        kind, v = parts[at]
        at += 1
        if kind == "text":
            if v:
                body.append(("text", v))
            continue
        if kind == "out":
            body.append(("out", _Expression(v).whole()))
            continue
        word, _, rest = v.partition(" ")
        if word in ends or word.startswith("end") or word in ("else", "elif"):
            if word not in ends:
                raise TemplateError(f"unexpected {v!r}")
            return body, at, v
        if word == "set" and (m := re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=(?!=)(.*)", rest, re.S)):
            body.append(("set", m[1], _Expression(m[2]).whole()))
        elif word == "for" and (m := re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.S)):
            inner, at, _ = _block(parts, at, ("endfor",))
            body.append(("for", m[1], _Expression(m[2]).whole(), inner))
        elif word == "if":
            cases, test = [], _Expression(rest).whole()
            while True:
                inner, at, end = _block(parts, at, ("elif", "else", "endif"))
                cases.append((test, inner))
                if end == "endif":
                    break
                test = ("const", True) if end == "else" else _Expression(end[4:]).whole()
            body.append(("cond", cases))
        elif word == "generation":
            inner, at, _ = _block(parts, at, ("endgeneration",))
            body.append(("gen", inner))
        else:
            raise TemplateError(f"unknown tag {v!r}")
    if ends:
        raise TemplateError(f"{ends[-1]!r} is missing")
    return body, at, ""


def _get(of: Any, key: Any) -> Any:
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, tuple, str)) and isinstance(key, int) and not isinstance(key, bool):
        return of[key] if -len(of) <= key < len(of) else None
    return None


def fold(e: tuple, filters: dict[str, Callable]) -> tuple:
    """The expression with constant parts worked out. What fails stays as it is and fails when it is rendered, if ever."""
    kind = e[0]
    if kind in ("const", "name"):
        return e
    if kind == "op":
        args = [fold(a, filters) for a in e[2]]
        e, free = ("op", e[1], args), args
        value = lambda: e[1](*[a[1] for a in args])
    elif kind == "filter":
        a = fold(e[2], filters)
        e, free = ("filter", e[1], a), [a]
        if e[1] not in filters:
            raise TemplateError(f"unknown filter {e[1]!r}")
        value = lambda: filters[e[1]](a[1])
    elif kind == "get":
        a, b = fold(e[1], filters), fold(e[2], filters)
        e, free = ("get", a, b), [a, b]
        value = lambda: _get(a[1], b[1])
    elif kind == "if":
        c, a, b = (fold(x, filters) for x in e[1:])
        return (a if c[1] else b) if c[0] == "const" else ("if", c, a, b)
    else:
        a, b = fold(e[1], filters), fold(e[2], filters)
        if a[0] == "const":
            return b if bool(a[1]) == (kind == "and") else a
        return (kind, a, b)
    if all(x[0] == "const" for x in free):
        try:
            return ("const", value())
        except TemplateError:
            raise
        except Exception:  # noqa: BLE001
            return e
    return e


def fold_body(body: list[tuple], filters: dict[str, Callable]) -> list[tuple]:
    out: list[tuple] = []
    for s in body:
        if s[0] == "out":
            e = fold(s[1], filters)
            s = ("text", shown(e[1])) if e[0] == "const" else ("out", e)
        elif s[0] == "set":
            s = ("set", s[1], fold(s[2], filters))
        elif s[0] == "for":
            s = ("for", s[1], fold(s[2], filters), fold_body(s[3], filters))
        elif s[0] == "gen":
            s = ("gen", fold_body(s[1], filters))
        elif s[0] == "cond":
            cases = []
            for test, inner in s[1]:
                test = fold(test, filters)
                if test[0] == "const" and not test[1]:
                    continue
                cases.append((test, fold_body(inner, filters)))
                if test[0] == "const":
                    break
            if not cases:
                continue
            if cases[0][0][0] == "const":
                for t in cases[0][1]:
                    _add(out, t)
                continue
            s = ("cond", cases)
        _add(out, s)
    return out


def _add(out: list[tuple], s: tuple) -> None:
    if s[0] == "text" and out and out[-1][0] == "text":
        out[-1] = ("text", out[-1][1] + s[1])
    elif s != ("text", ""):
        out.append(s)


@dataclass
class Rendered:
    """Text so far, and the generation spans in code points. More text than ``room`` is refused."""

    room: int = ROOM
    parts: list[str] = field(default_factory=list)
    at: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, s: str) -> None:
        self.at += len(s)
        if self.at > self.room:
            raise TemplateError(f"more than {self.room} characters")
        self.parts.append(s)

    def set(self, env: dict, name: str, v: Any) -> None:
        if isinstance(v, (str, list)) and len(v) > self.room:
            raise TemplateError(f"{name} has more than {self.room} members")
        env[name] = v

    @property
    def text(self) -> str:
        return "".join(self.parts)


def expression(e: tuple, filters: dict[str, Callable]) -> Callable[[dict], Any]:
    kind = e[0]
    if kind == "const":
        v = e[1]
        return lambda env: v
    if kind == "name":
        n = e[1]
        return lambda env: env.get(n)
    if kind == "get":
        a, b = expression(e[1], filters), expression(e[2], filters)
        return lambda env: _get(a(env), b(env))
    if kind == "op":
        f, args = e[1], [expression(a, filters) for a in e[2]]
        if len(args) == 1:
            one = args[0]
            return lambda env: f(one(env))
        x, y = args
        return lambda env: f(x(env), y(env))
    if kind == "filter":
        g, a = filters[e[1]], expression(e[2], filters)
        return lambda env: g(a(env))
    if kind == "if":
        c, a, b = (expression(x, filters) for x in e[1:])
        return lambda env: a(env) if c(env) else b(env)
    a, b = expression(e[1], filters), expression(e[2], filters)
    return (lambda env: a(env) and b(env)) if kind == "and" else (lambda env: a(env) or b(env))


def statements(body: list[tuple], filters: dict[str, Callable]) -> Callable[[dict, Rendered], None]:
    steps = [statement(s, filters) for s in body]

    def run(env: dict, out: Rendered) -> None:
        for s in steps:
            s(env, out)

    return run


def statement(s: tuple, filters: dict[str, Callable]) -> Callable[[dict, Rendered], None]:
    kind = s[0]
    if kind == "text":
        return lambda env, out: out.write(s[1])
    if kind == "out":
        e = expression(s[1], filters)
        return lambda env, out: out.write(shown(e(env)))
    if kind == "set":
        e = expression(s[2], filters)
        return lambda env, out: out.set(env, s[1], e(env))
    if kind == "gen":
        inner = statements(s[1], filters)

        def marked(env: dict, out: Rendered) -> None:
            start = out.at
            inner(env, out)
            out.spans.append((start, out.at))

        return marked
    if kind == "cond":
        cases = [(expression(t, filters), statements(b, filters)) for t, b in s[1]]

        def first(env: dict, out: Rendered) -> None:
            for test, then in cases:
                if test(env):
                    return then(env, out)

        return first
    e, inner = expression(s[2], filters), statements(s[3], filters)

    def loop(env: dict, out: Rendered) -> None:
        for i, (x, last) in enumerate(_with_last(e(env) or ())):
            inner(env | {s[1]: x, "loop": {"index": i + 1, "index0": i, "first": i == 0, "last": last}}, out)

    return loop


def _with_last(xs: Iterable) -> Iterator[tuple[Any, bool]]:
    held = []
    for x in xs:
        if held:
            yield held.pop(), False
        held.append(x)
    if held:
        yield held.pop(), True


def compile_template(source: str, filters: dict[str, Callable[[Any], Any]] | None = None) -> Callable[..., Rendered]:
    """A function from the template's names to the rendered text and its generation spans."""
    known = FILTERS | (filters or {})
    run = statements(fold_body(parse(source), known), known)

    def render(**names: Any) -> Rendered:
        out = Rendered(ROOM + TIMES * size_of(names))
        run(dict(names), out)
        return out

    return render
