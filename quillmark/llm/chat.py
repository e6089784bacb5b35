"""Chat formatting: a sandboxed template language compiled to Python closures with generation markers.

The language has ``{{ expression }}``, ``{% for x in name %}``, ``{% if %}/{% elif %}/{% else %}`` and
``{% generation %}`` blocks. Expressions know names, fields of rows, string and integer literals, ``== != + and or
not``, parentheses and filters. There are no calls, no attributes of Python objects and no imports to reach.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import small_batches

Piece = tuple[str, bool]
Scope = dict[str, Any]

TEMPLATE = (
    "{% for m in messages %}{{ '<|' + 'im_start' + '|>' }}{{ m.role | escape_line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}<|im_end|>\n{% endfor %}"
)
CONTROLS = ("<|", "[INST]", "[/INST]", "<s>", "</s>")
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))


class TemplateError(ValueError):
    """The template is not in the language."""


def escape(text: str) -> str:
    """Break up every control string with a backslash; backslashes are doubled, so ``unescape`` restores any text."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def escape_line(text: str) -> str:
    """As ``escape``, for texts that must stay on one line."""
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\n]?)", lambda m: {"\\": "\\", "n": "\n", "": ""}[m[1]], text) if "\\" in text else text


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "escape_line": escape_line, "trim": str.strip, "upper": str.upper, "lower": str.lower}


# --- syntax tree ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Node:
    """``kind`` and its parts: nodes, names or literals."""

    kind: str
    parts: tuple = ()


def _const(value: Any) -> Node:
    return Node("const", (value,))


_TAG = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[+|().]))")
_UNQUOTE = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][1] in values and self.tokens[self.at][0] != "str"

    def take(self) -> tuple[str, str]:
        if self.at == len(self.tokens):
            raise TemplateError("the expression ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def need(self, value: str) -> None:
        if not self.peek(value):
            raise TemplateError(f"{value!r} is missing")
        self.at += 1

    def whole(self) -> Node:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self) -> Node:
        node = self.both()
        while self.peek("or"):
            self.take()
            node = Node("or", (node, self.both()))
        return node

    def both(self) -> Node:
        node = self.negated()
        while self.peek("and"):
            self.take()
            node = Node("and", (node, self.negated()))
        return node

    def negated(self) -> Node:
        if self.peek("not"):
            self.take()
            return Node("not", (self.negated(),))
        node = self.sum()
        while self.peek("==", "!="):
            node = Node(self.take()[1], (node, self.sum()))
        return node

    def sum(self) -> Node:
        node = self.filtered()
        while self.peek("+"):
            self.take()
            node = Node("+", (node, self.filtered()))
        return node

    def filtered(self) -> Node:
        node = self.atom()
        while self.peek("|"):
            self.take()
            name = self.take()[1]
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = Node("filter", (name, node))
        return node

    def atom(self) -> Node:
        kind, value = self.take()
        if kind == "str":
            return _const(re.sub(r"\\(.)", lambda m: _UNQUOTE.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "int":
            return _const(int(value))
        if value == "(":
            node = self.either()
            self.need(")")
            return node
        if kind != "name" or value in ("and", "or", "not"):
            raise TemplateError(f"unexpected {value!r}")
        node = Node("name", (value,))
        while self.peek("."):
            self.take()
            kind, name = self.take()
            if kind != "name" or name.startswith("_"):
                raise TemplateError(f"no field {name!r}")
            node = Node("field", (node, name))
        return node


def parse(source: str) -> Node:
    """Template text to a syntax tree."""
    parts = [p for p in _TAG.split(source) if p]
    tree, at, closed = _block(parts, 0, ())
    return tree


def _block(parts: list[str], at: int, until: tuple[str, ...]) -> tuple[Node, int, str]:
    found: list[Node] = []
    while at < len(parts):
        part = parts[at]
        at += 1
        if part.startswith("{{") and part.endswith("}}"):
            found.append(Node("print", (_Expression(part[2:-2]).whole(),)))
        elif part.startswith("{%") and part.endswith("%}"):
            body = part[2:-2].strip()
            word = body.split()[0] if body else ""
            if word in until:
                return Node("list", tuple(found)), at, body
            if word == "for":
                m = re.fullmatch(r"for\s+([A-Za-z]\w*)\s+in\s+([A-Za-z]\w*)", body)
                if not m:
                    raise TemplateError(f"cannot read {body!r}")
                inner, at, _ = _block(parts, at, ("endfor",))
                found.append(Node("for", (m[1], m[2], inner)))
            elif word == "if":
                node, at = _branches(parts, at, body[2:])
                found.append(node)
            elif word == "generation":
                inner, at, _ = _block(parts, at, ("endgeneration",))
                found.append(Node("generation", (inner,)))
            else:
                raise TemplateError(f"unknown tag {body!r}")
        else:
            found.append(Node("print", (_const(part),)))
    if until:
        raise TemplateError(f"{until[-1]!r} is missing")
    return Node("list", tuple(found)), at, ""


def _branches(parts: list[str], at: int, condition: str) -> tuple[Node, int]:
    test = _Expression(condition).whole()
    body, at, closed = _block(parts, at, ("elif", "else", "endif"))
    other = Node("list")
    if closed.startswith("elif"):
        other, at = _branches(parts, at, closed[4:])
    elif closed == "else":
        other, at, _ = _block(parts, at, ("endif",))
    return Node("if", (test, body, other)), at


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


_OPS: dict[str, Callable[[Any, Any], Any]] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "+": lambda a, b: _text(a) + _text(b), "and": lambda a, b: a and b, "or": lambda a, b: a or b}


def fold_constants(node: Node) -> Node:
    """Evaluate what holds no names, drop branches that can't be taken and join neighbouring texts."""
    node = Node(node.kind, tuple(fold_constants(p) if isinstance(p, Node) else p for p in node.parts))
    known = lambda *ns: all(n.kind == "const" for n in ns)
    p = node.parts
    if node.kind in _OPS and known(*p):
        return _const(_OPS[node.kind](p[0].parts[0], p[1].parts[0]))
    if node.kind == "not" and known(*p):
        return _const(not p[0].parts[0])
    if node.kind == "filter" and known(p[1]):
        return _const(FILTERS[p[0]](_text(p[1].parts[0])))
    if node.kind == "if" and known(p[0]):
        return p[1] if p[0].parts[0] else p[2]
    if node.kind == "list":
        flat: list[Node] = []
        for x in p:
            for y in x.parts if x.kind == "list" else (x,):
                if y.kind == "print" and known(y.parts[0]) and flat and flat[-1].kind == "print" and known(flat[-1].parts[0]):
                    y = Node("print", (_const(_text(flat.pop().parts[0].parts[0]) + _text(y.parts[0].parts[0])),))
                flat.append(y)
        return Node("list", tuple(flat))
    return node


def _value(node: Node) -> Callable[[Scope], Any]:
    p = node.parts
    if node.kind == "const":
        return lambda scope, v=p[0]: v
    if node.kind == "name":
        return lambda scope, n=p[0]: scope.get(n)
    if node.kind == "field":
        row, name = _value(p[0]), p[1]
        return lambda scope: x.get(name) if isinstance(x := row(scope), dict) else None
    if node.kind == "filter":
        f, inner = FILTERS[p[0]], _value(p[1])
        return lambda scope: f(_text(inner(scope)))
    if node.kind == "not":
        inner = _value(p[0])
        return lambda scope: not inner(scope)
    a, b = _value(p[0]), _value(p[1])
    if node.kind == "and":
        return lambda scope: a(scope) and b(scope)
    if node.kind == "or":
        return lambda scope: a(scope) or b(scope)
    op = _OPS[node.kind]
    return lambda scope: op(a(scope), b(scope))


def _emit(node: Node, marked: bool) -> Callable[[Scope], Iterator[Piece]]:
    p = node.parts
    if node.kind == "print":
        value = _value(p[0])
        return lambda scope: iter(((_text(value(scope)), marked),))
    if node.kind == "list":
        inner = [_emit(x, marked) for x in p]
        return lambda scope: (piece for f in inner for piece in f(scope))
    if node.kind == "generation":
        return _emit(p[0], True)
    if node.kind == "if":
        test, yes, no = _value(p[0]), _emit(p[1], marked), _emit(p[2], marked)
        return lambda scope: yes(scope) if test(scope) else no(scope)
    name, source, body = p[0], p[1], _emit(p[2], marked)

    def loop(scope: Scope) -> Iterator[Piece]:
        for item in scope.get(source) or ():
            yield from body(scope | {name: item})

    return loop


def compile_template(source: str) -> Callable[[Scope], Iterator[Piece]]:
    """A function of the variables that yields (text, is it under the loss mask); rows may be an iterator."""
    return _emit(fold_constants(parse(source)), False)


# --- reading back ---------------------------------------------------------------------------------


_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def read_turns(pieces: Iterator[Piece]) -> Iterator[tuple[str, str, str, int]]:
    """From formatted output, turn by turn: role, text, the unescaped text under the mask, code points of the turn.

    Holds one turn at a time, so a conversation of any length streams through.
    """
    held: list[Piece] = []
    for piece in pieces:
        held.append(piece)
        if piece[0].endswith("<|im_end|>\n") or "<|im_end|>\n" in piece[0]:
            whole = "".join(t for t, _ in held)
            stop = whole.rindex("<|im_end|>\n") + len("<|im_end|>\n")
            turns = list(_TURN.finditer(whole, 0, stop))
            if len(turns) != 1 or turns[0].span() != (0, stop):
                raise TemplateError(f"the output can't be read back: {whole[:200]!r}")
            yield unescape(turns[0][1]), unescape(turns[0][2]), unescape("".join(t for t, m in held if m)), stop
            held = [(whole[stop:], False)] if stop < len(whole) else []
    if any(t for t, _ in held):
        raise TemplateError("the output ends inside a turn")


SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` -> one row per conversation, read back from its formatted text.

    Turns are in order of turn, then role, then text; nulls come first. Null roles and texts count as empty; rows
    of a null conv_id form one conversation. Repeated rows are turns of their own; no rows give no rows; other
    columns are ignored. Rows arrive sorted and stream through the template, so a worker holds one turn and two
    running digests, however long a conversation is.
    """
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        turns = (t for b in batches for t in zip(*(b.column(k).to_pylist() for k in (0, 2, 3))))
        out: list[tuple] = []
        for conv_id, group in groupby(turns, key=lambda t: t[0]):
            messages = ({"role": role or "", "text": text or ""} for _, role, text in group)
            n = loss = size = 0
            said, under = hashlib.sha256(), hashlib.sha256()
            for role, text, masked, chars in read_turns(render({"messages": messages})):
                said.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                under.update(masked.encode("utf-8", "surrogatepass"))
                n, loss, size = n + 1, loss + len(masked), size + chars
            out.append((conv_id, n, said.hexdigest(), loss, under.hexdigest(), size))
            if len(out) == 1000:
                yield _batch(out)
                out = []
        yield _batch(out)

    kinds = {"conv_id": "long", "turn": "long", "role": "string", "text": "string"}
    source = rows.select(*(F.col(c).cast(kind).alias(c) for c, kind in kinds.items()))
    return source.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in SCHEMA.split(", ")])


def _sql_escaped(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


#: The same digests without a template: what went in, in order, and the lengths of the escaped parts.
SQL = f"""
WITH extra AS (SELECT -1 AS conv_id, 0 AS turn, 'user' AS role, '</s>[INST] ok [/INST]' AS text UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM extra))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(24 + length(replace({_sql_escaped("role")}, chr(10), '\\n')) + length({_sql_escaped("text")}))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""
