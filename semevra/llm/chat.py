"""Chat formatting: a template compiler.

A small sandboxed template language is parsed into a syntax tree, constants are folded, and each node becomes a Python
closure; rendering a conversation runs those closures and marks the character ranges of ``{% generation %}`` blocks.

Language: text; ``{{ expr }}``; ``{% for x in expr %} .. {% endfor %}`` with loop.index, index0, first, last, length;
``{% if %} {% elif %} {% else %} {% endif %}``; ``{% set x = expr %}``; ``{% generation %} .. {% endgeneration %}``;
``{# comment #}``; ``-`` inside a delimiter trims white space on its side. Expressions: strings, numbers, true, false,
none, names, ``a.b``, ``a['b']``, ``+ - * ~``, comparisons, ``in``, ``not in``, ``and or not``, ``x is defined``, and the
filters trim, upper, lower, length, default(v). Names and keys reach only the data that is passed in: no attribute of a
Python object can be read and nothing can be called. What is missing renders as the empty text.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from semevra.session import bounded_batches

CHATML = (
    "{% for m in messages %}{{ '<|im_start|>' + m.role + '\\n' }}{% if m.role == 'assistant' %}{% generation %}{{ m.content }}"
    "{{ '<|im_' ~ 'end|>' }}{% endgeneration %}{% else %}{{ m.content + '<|im_end|>' }}{% endif %}{{ '\\n' }}{% endfor %}"
)


class TemplateError(ValueError):
    """The template does not follow the language."""


class _Missing:
    def __repr__(self) -> str:
        return "missing"


MISSING = _Missing()
_SPLIT = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+*~<>()\[\].,|=]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _text(v: Any) -> str:
    if v is MISSING or v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    return str(v) if isinstance(v, (str, int, float)) else ""


def _get(v: Any, k: Any) -> Any:
    if isinstance(v, dict):
        return v.get(k, MISSING)
    if isinstance(v, (list, str)) and isinstance(k, int) and not isinstance(k, bool) and -len(v) <= k < len(v):
        return v[k]
    return MISSING


def _plus(a: Any, b: Any) -> Any:
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return a + b
    return _text(a) + _text(b)


def _number(f: Callable) -> Callable:
    return lambda a, b: f(a, b) if isinstance(a, (int, float)) and isinstance(b, (int, float)) else MISSING


def _order(f: Callable) -> Callable:
    return lambda a, b: f(a, b) if (isinstance(a, str) and isinstance(b, str)) or (isinstance(a, (int, float)) and isinstance(b, (int, float))) else False


def _in(a: Any, b: Any) -> bool:
    if isinstance(b, str):
        return isinstance(a, str) and a in b
    return a in b if isinstance(b, (list, dict)) else False


_BINARY: dict[str, Callable] = {
    "+": _plus, "-": _number(operator.sub), "*": _number(operator.mul), "~": lambda a, b: _text(a) + _text(b),
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": _order(operator.lt), "<=": _order(operator.le), ">": _order(operator.gt), ">=": _order(operator.ge),
    "in": _in, "not in": lambda a, b: not _in(a, b),
}
_FILTERS: dict[str, Callable] = {
    "trim": lambda v: _text(v).strip(), "upper": lambda v: _text(v).upper(), "lower": lambda v: _text(v).lower(),
    "length": lambda v: len(v) if isinstance(v, (str, list, dict)) else 0, "default": lambda v, d="": d if v is MISSING or v is None else v,
}


def _true(v: Any) -> bool:
    return v is not MISSING and bool(v)


class _Expression:
    """Recursive descent over one expression; nodes are tuples (kind, ...)."""

    def __init__(self, source: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m or m.end() == at:
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values

    def take(self, value: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or (value and (self.tokens[self.at][1] != value or self.tokens[self.at][0] == "str")):
            raise TemplateError(f"expected {value or 'more'}")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self) -> tuple:
        node = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.peek("or"):
            self.take()
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negation()
        while self.peek("and"):
            self.take()
            node = ("and", node, self.negation())
        return node

    def negation(self) -> tuple:
        if self.peek("not"):
            self.take()
            return ("not", self.negation())
        node = self.sum()
        while True:
            if self.peek("==", "!=", "<", "<=", ">", ">=", "in"):
                node = ("binary", self.take()[1], node, self.sum())
            elif self.peek("not"):
                self.take()
                self.take("in")
                node = ("binary", "not in", node, self.sum())
            elif self.peek("is"):
                self.take()
                no = self.peek("not") and bool(self.take())
                self.take("defined")
                node = ("defined", node)
                node = ("not", node) if no else node
            else:
                return node

    def sum(self) -> tuple:
        node = self.product()
        while self.peek("+", "-", "~"):
            node = ("binary", self.take()[1], node, self.product())
        return node

    def product(self) -> tuple:
        node = self.postfix()
        while self.peek("*"):
            node = ("binary", self.take()[1], node, self.postfix())
        return node

    def postfix(self) -> tuple:
        node = self.atom()
        while True:
            if self.peek("."):
                self.take()
                node = ("get", node, ("const", self.take()[1]))
            elif self.peek("["):
                self.take()
                node = ("get", node, self.either())
                self.take("]")
            elif self.peek("|"):
                self.take()
                name, args = self.take()[1], []
                if name not in _FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                if self.peek("("):
                    self.take()
                    while not self.peek(")"):
                        args.append(self.either())
                        if not self.peek(")"):
                            self.take(",")
                    self.take(")")
                if len(args) > (name == "default"):
                    raise TemplateError(f"too many arguments of {name}")
                node = ("filter", name, node, *args)
            else:
                return node

    def atom(self) -> tuple:
        kind, value = self.take()
        if kind == "num":
            return ("const", float(value) if "." in value else int(value))
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "name":
            low = value.lower()
            if low in ("true", "false", "none"):
                return ("const", {"true": True, "false": False, "none": None}[low])
            if value in ("and", "or", "in", "is", "not"):
                raise TemplateError(f"unexpected {value!r}")
            return ("name", value)
        if value == "(":
            node = self.either()
            self.take(")")
            return node
        if value == "-":
            return ("binary", "-", ("const", 0), self.postfix())
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> tuple:
    """The syntax tree: ("block", node, ...)."""
    pieces, trim = [], False
    for part in _SPLIT.split(source):
        if part[:2] in ("{{", "{%", "{#"):
            if part[2:3] == "-" and pieces and pieces[-1][0] == "text":
                pieces[-1] = ("text", pieces[-1][1].rstrip())
            trim = part[-3:-2] == "-"
            body = part[2 + (part[2:3] == "-") : -2 - trim]
            if part[:2] != "{#":
                pieces.append(("out" if part[:2] == "{{" else "tag", body.strip()))
        elif part:
            pieces.append(("text", part.lstrip() if trim else part))
            trim = False
    at = 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal at
        nodes: list[tuple] = []
        while at < len(pieces):
            kind, body = pieces[at]
            at += 1
            if kind == "text":
                nodes.append(("text", ("const", body)))
            elif kind == "out":
                nodes.append(("text", _Expression(body).whole()))
            else:
                word, _, rest = body.partition(" ")
                if word in ends:
                    return ("block", *nodes), body
                if word == "for":
                    m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)
                    if not m:
                        raise TemplateError("for needs a name and a list")
                    inner, _ = block("endfor")
                    nodes.append(("for", m[1], _Expression(m[2]).whole(), inner))
                elif word == "if":
                    arms, test, closing = [], _Expression(rest).whole(), "elif"
                    while closing != "endif":
                        inner, end = block("elif", "else", "endif")
                        arms.append((test, inner))
                        closing, _, cond = end.partition(" ")
                        test = _Expression(cond).whole() if closing == "elif" else ("const", True)
                    nodes.append(("if", *arms))
                elif word == "set":
                    m = re.fullmatch(r"([A-Za-z_]\w*)\s*=\s*(.+)", rest.strip(), re.S)
                    if not m:
                        raise TemplateError("set needs a name and a value")
                    nodes.append(("set", m[1], _Expression(m[2]).whole()))
                elif word == "generation":
                    inner, _ = block("endgeneration")
                    nodes.append(("generation", inner))
                else:
                    raise TemplateError(f"unexpected tag {word!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return ("block", *nodes), ""

    return block()[0]


def fold(node: tuple) -> tuple:
    """The tree with constant expressions evaluated, dead branches cut, and neighbouring constant texts joined."""
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "block":
        out: list[tuple] = []
        for n in map(fold, node[1:]):
            for x in n[1:] if n[0] == "block" else (n,):
                if x == ("text", ("const", "")):
                    continue
                if out and x[0] == "text" and x[1][0] == "const" and out[-1][0] == "text" and out[-1][1][0] == "const":
                    out[-1] = ("text", ("const", out[-1][1][1] + x[1][1]))
                else:
                    out.append(x)
        return ("block", *out)
    if kind == "text":
        e = fold(node[1])
        return ("text", ("const", _text(e[1]))) if e[0] == "const" else ("text", e)
    if kind == "if":
        arms: list[tuple] = []
        for test, inner in node[1:]:
            test = fold(test)
            if test[0] == "const" and not _true(test[1]):
                continue
            arms.append((test, fold(inner)))
            if test[0] == "const":
                break
        if not arms:
            return ("block",)
        return arms[0][1] if arms[0][0][0] == "const" else ("if", *arms)
    if kind == "for":
        return ("for", node[1], fold(node[2]), fold(node[3]))
    if kind == "set":
        return ("set", node[1], fold(node[2]))
    if kind == "generation":
        return ("generation", fold(node[1]))
    head = 2 if kind in ("binary", "filter") else 1
    node = (*node[:head], *map(fold, node[head:]))
    if all(x[0] == "const" for x in node[head:]):
        return ("const", _evaluate(node)({}))
    return node


def _evaluate(node: tuple) -> Callable[[dict], Any]:
    kind = node[0]
    if kind == "const":
        v = node[1]
        return lambda env: v
    if kind == "name":
        name = node[1]
        return lambda env: env.get(name, MISSING)
    if kind == "get":
        a, k = _evaluate(node[1]), _evaluate(node[2])
        return lambda env: _get(a(env), k(env))
    if kind == "binary":
        f, a, b = _BINARY[node[1]], _evaluate(node[2]), _evaluate(node[3])
        return lambda env: f(a(env), b(env))
    if kind == "filter":
        f, a, args = _FILTERS[node[1]], _evaluate(node[2]), [_evaluate(x) for x in node[3:]]
        return lambda env: f(a(env), *[x(env) for x in args])
    if kind == "defined":
        a = _evaluate(node[1])
        return lambda env: a(env) is not MISSING
    if kind == "not":
        a = _evaluate(node[1])
        return lambda env: not _true(a(env))
    a, b = _evaluate(node[1]), _evaluate(node[2])
    if kind == "and":
        return lambda env: b(env) if _true(x := a(env)) else x
    return lambda env: x if _true(x := a(env)) else b(env)


class _Out:
    __slots__ = ("parts", "size", "spans")

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []


def _generate(node: tuple) -> Callable[[dict, _Out], None]:
    kind = node[0]
    if kind == "block":
        steps = [_generate(n) for n in node[1:]]

        def block(env: dict, out: _Out) -> None:
            for s in steps:
                s(env, out)

        return block
    if kind == "text":
        e = _evaluate(node[1])

        def text(env: dict, out: _Out) -> None:
            t = _text(e(env))
            out.parts.append(t)
            out.size += len(t)

        return text
    if kind == "if":
        arms = [(_evaluate(t), _generate(b)) for t, b in node[1:]]

        def choose(env: dict, out: _Out) -> None:
            for test, body in arms:
                if _true(test(env)):
                    return body(env, out)

        return choose
    if kind == "for":
        name, items, body = node[1], _evaluate(node[2]), _generate(node[3])

        def loop(env: dict, out: _Out) -> None:
            values = items(env)
            if not isinstance(values, list):
                return
            inner = dict(env)
            for i, v in enumerate(values):
                inner[name] = v
                inner["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(values) - 1, "length": len(values)}
                body(inner, out)

        return loop
    if kind == "set":
        name, value = node[1], _evaluate(node[2])

        def put(env: dict, out: _Out) -> None:
            env[name] = value(env)

        return put
    body = _generate(node[1])

    def mark(env: dict, out: _Out) -> None:
        start = out.size
        body(env, out)
        out.spans.append((start, out.size))

    return mark


def compile_template(source: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from the data to the text and the character ranges of its generation blocks."""
    run = _generate(fold(parse(source)))

    def render(data: dict) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        run(dict(data), out)
        return "".join(out.parts), out.spans

    return render


def format_chats(turns: DataFrame, template: str = CHATML, add_generation_prompt: bool = False, variables: dict | None = None) -> DataFrame:
    """(conv_id, n_turns, rendered, generation) for each conversation of (conv_id, turn, role, text).

    The template sees the list ``messages`` (role, content), ``add_generation_prompt`` and ``variables``, plain values by name.
    generation lists the ranges as 'start-end,...' in characters. Turns go by turn number, then role, then text; a null
    turn comes first; repeated rows are repeated turns. A null role or text is the empty one, and very long ones are rendered
    whole. Rows without a conv_id are left out. A faulty template raises TemplateError before any row is read. Other columns are not looked at. An empty
    table gives an empty result.
    """
    bounded_batches(turns)
    compile_template(template)
    known = {**(variables or {}), "add_generation_prompt": add_generation_prompt}
    t = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    grouped = t.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = compile_template(template)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                n, texts, spans = [], [], []
                for m in part.column("m").to_pylist():
                    text, marks = f({**known, "messages": [{"role": x["role"], "content": x["text"]} for x in m]})
                    n.append(len(m))
                    texts.append(text)
                    spans.append(",".join(f"{a}-{z}" for a, z in marks))
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), pa.array(n, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, pa.string())],
                    ["conv_id", "n_turns", "rendered", "generation"]
                )

    return grouped.mapInArrow(render, "conv_id long, n_turns long, rendered string, generation string")


CHATML_SQL = """
WITH p AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         '<|im_start|>' || coalesce(role, '') || chr(10) AS head, coalesce(text, '') || '<|im_end|>' AS body
  FROM conversations WHERE conv_id IS NOT NULL),
q AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(body) - 1 AS pos FROM p)
SELECT conv_id, count(*) AS n_turns,
       string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered,
       coalesce(string_agg(CASE WHEN role = 'assistant' THEN CAST(CAST(pos AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(pos + length(body) AS BIGINT) AS VARCHAR) END,
                ',' ORDER BY turn NULLS FIRST, role, text), '') AS generation
FROM q GROUP BY conv_id
"""
