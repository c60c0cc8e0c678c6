"""The expression language: text to a syntax tree to a Column.

Loosest first: ``||``, ``&&``, ``== !=``, ``< <= > >=``, text and membership (``++ contains starts_with ends_with
in``), ``+ -``, ``* / %``, ``**`` (to the right), unary ``- !``, then ``.field``, ``f(...)`` and ``[i]``. Literals are
numbers, "text", true, false, null, ``[...]`` and ``{k: v}``; choices are ``if c then a else b`` and ``cond when c then
v ... default d``. Division follows one rule: ``/`` is true division (``div(a, b)`` truncates); division by zero and
an index out of range are errors. Types are those of the table: what can't work is refused when the rule is compiled.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache, reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleweft.functions import values as V
from ruleweft.model import RuleError

TOKEN = re.compile(r'\s*(?:(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\d+)|(?P<str>"(?:\\.|[^"\\])*")|(?P<id>[A-Za-z_][A-Za-z0-9_]*)|(?P<op>\|\||&&|==|!=|<=|>=|\+\+|\*\*|[-+*/%<>!.,:()\[\]{}]))')
WORDS = {"true", "false", "null", "if", "then", "else", "cond", "when", "default", "contains", "starts_with", "ends_with", "in"}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", '"': '"'}
#: Binary operators by level, loosest first; ``**`` stands apart.
LEVELS = (("||",), ("&&",), ("==", "!="), ("<", "<=", ">", ">="), ("++", "contains", "starts_with", "ends_with", "in"), ("+", "-"), ("*", "/", "%"))


@dataclass(frozen=True)
class Node:
    """kind: lit, var, array, object, unary, binary, call, index, field, if, cond."""

    kind: str
    value: Any = None
    args: tuple = ()


def tokens(text: str) -> list[tuple[str, Any]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise RuleError("expression", f"unexpected {text[at:].strip()[:1]!r} in {text!r}")
        at = m.end()
        if m["num"]:
            out.append(("num", float(m["num"]) if "." in m["num"] else int(m["num"])))
        elif m["str"]:
            out.append(("str", re.sub(r"\\(.)", lambda e: ESCAPES.get(e[1], e[1]), m["str"][1:-1])))
        elif m["id"]:
            out.append(("word" if m["id"] in WORDS else "id", m["id"]))
        else:
            out.append(("op", m["op"]))
    return [*out, ("end", None)]


class Parser:
    def __init__(self, text: str) -> None:
        self.text, self.left = text, tokens(text)[::-1]

    def peek(self) -> tuple[str, Any]:
        return self.left[-1]

    def take(self, *values: str) -> bool:
        if self.peek()[0] in ("op", "word") and self.peek()[1] in values:
            self.left.pop()
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise RuleError("expression", f"expected {value!r}, got {self.peek()[1]!r} in {self.text!r}")

    def parse(self) -> Node:
        out = self.level(0)
        if self.peek()[0] != "end":
            raise RuleError("expression", f"unexpected {self.peek()[1]!r} in {self.text!r}")
        return out

    def level(self, n: int) -> Node:
        if n == len(LEVELS):
            return self.power()
        out = self.level(n + 1)
        while self.peek()[0] in ("op", "word") and self.peek()[1] in LEVELS[n]:
            op = self.left.pop()[1]
            out = Node("binary", op, (out, self.level(n + 1)))
        return out

    def power(self) -> Node:
        base = self.unary()
        return Node("binary", "**", (base, self.power())) if self.take("**") else base

    def unary(self) -> Node:
        for op in "-!":
            if self.take(op):
                return Node("unary", op, (self.unary(),))
        return self.postfix()

    def postfix(self) -> Node:
        out = self.primary()
        while True:
            if self.take("."):
                kind, name = self.left.pop()
                if kind != "id":
                    raise RuleError("expression", f"expected a field after '.' in {self.text!r}")
                out = Node("field", name, (out,))
            elif self.take("["):
                out = Node("index", None, (out, self.level(0)))
                self.need("]")
            else:
                return out

    def several(self, end: str) -> list[Node]:
        out: list[Node] = []
        while not self.take(end):
            out.append(self.level(0))
            if not self.take(","):
                self.need(end)
                break
        return out

    def primary(self) -> Node:
        if self.take("("):
            out = self.level(0)
            self.need(")")
            return out
        if self.take("["):
            return Node("array", None, tuple(self.several("]")))
        if self.take("{"):
            keys, out = [], []
            while not self.take("}"):
                kind, name = self.left.pop()
                if kind not in ("id", "str"):
                    raise RuleError("expression", f"expected a key in {self.text!r}")
                self.need(":")
                keys.append(name)
                out.append(self.level(0))
                if not self.take(","):
                    self.need("}")
                    break
            return Node("object", tuple(keys), tuple(out))
        if self.take("if"):
            c = self.level(0)
            self.need("then")
            a = self.level(0)
            self.need("else")
            return Node("if", None, (c, a, self.level(0)))
        if self.take("cond"):
            out = []
            while self.take("when"):
                out.append(self.level(0))
                self.need("then")
                out.append(self.level(0))
            last = self.level(0) if self.take("default") else None
            if not out:
                raise RuleError("expression", f"cond without when in {self.text!r}")
            return Node("cond", last is not None, tuple(out) + ((last,) if last else ()))
        kind, value = self.left.pop()
        if kind in ("num", "str"):
            return Node("lit", value)
        if kind == "word" and value in ("true", "false", "null"):
            return Node("lit", {"true": True, "false": False, "null": None}[value])
        if kind == "id":
            return Node("call", value, tuple(self.several(")"))) if self.take("(") else Node("var", value)
        raise RuleError("expression", f"unexpected {value!r} in {self.text!r}")


@lru_cache(maxsize=4096)
def parse(text: str) -> Node:
    return Parser(text).parse()


def variables(node: Node) -> list[str]:
    """Names that an expression reads, sorted."""
    out = {node.value} if node.kind == "var" else set()
    for a in node.args:
        out |= set(variables(a))
    return sorted(out)


@dataclass
class Typed:
    """A Column with its type: a class of values, the element class for arrays, and literal items where known."""

    col: Column
    kind: str
    whole: bool = False
    item: Typed | None = None
    fields: dict | None = None
    type: T.DataType | None = None


def typed(c: Column, t: T.DataType) -> Typed:
    if V.is_cell(t):
        return Typed(c, "cell", type=t)
    k = V.kind(t)
    item = typed(F.lit(None), t.elementType) if k == "array" else typed(F.lit(None), t.valueType) if isinstance(t, T.MapType) else None
    fields = {f.name: f.dataType for f in t.fields} if isinstance(t, T.StructType) else None
    return Typed(c, k, isinstance(t, V.WHOLE), item, fields, t)


#: name: (fewest arguments, most or None, builder)
FUNCTIONS: dict[str, tuple[int, int | None, Callable[..., Typed]]] = {}


def function(name: str, least: int, most: int | None = None):
    """Registers a function of the language; calculators and users add theirs the same way."""

    def put(f):
        FUNCTIONS[name] = (least, most if most != 0 else least, f)
        return f

    return put


def taken(x: Typed, kind: str) -> Typed:
    """A cell's part of a kind; NULL if the cell holds another one."""
    if x.kind != "cell":
        return x
    part = {"number": V.cell_number(x.col), "string": x.col["s"], "boolean": x.col["b"], "date": x.col["ts"]}
    if kind not in part:
        raise RuleError("type", f"a field of several kinds can't be taken as {kind}")
    return Typed(part[kind], kind)


def _numbers(name: str, *xs: Typed) -> None:
    for x in xs:
        if x.kind not in ("number", "null"):
            raise RuleError("type", f"{name} needs numbers, not {x.kind}")


@function("max", 1, None)
def _max(*xs: Typed) -> Typed:
    _numbers("max", *xs)
    return Typed(F.greatest(*(x.col for x in xs)) if len(xs) > 1 else xs[0].col, "number", all(x.whole for x in xs))


@function("min", 1, None)
def _min(*xs: Typed) -> Typed:
    _numbers("min", *xs)
    return Typed(F.least(*(x.col for x in xs)) if len(xs) > 1 else xs[0].col, "number", all(x.whole for x in xs))


@function("round", 1, 2)
def _round(x: Typed, n: Typed | None = None) -> Typed:
    _numbers("round", x)
    if n is None:
        return Typed(F.round(x.col.cast("double"), 0), "number")
    scale = F.pow(F.lit(10.0), n.col)
    y = x.col.cast("double") * scale
    # what overflows has no digits to round
    return Typed(F.when(F.abs(y) >= float("inf"), x.col.cast("double")).otherwise(F.signum(y) * F.round(F.abs(y), 0) / scale), "number")


@function("abs", 1)
def _abs(x: Typed) -> Typed:
    _numbers("abs", x)
    return Typed(F.abs(x.col), "number", x.whole)


@function("div", 2)
def _div(a: Typed, b: Typed) -> Typed:
    _numbers("div", a, b)
    q = a.col.cast("double") / b.col.cast("double")
    return Typed(F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)), "number", True)


@function("push", 2)
def _push(xs: Typed, x: Typed) -> Typed:
    return Typed(F.array_append(xs.col, x.col), "array", item=xs.item or x)


@function("length", 1)
def _length(x: Typed) -> Typed:
    return Typed((F.length(x.col) if x.kind == "string" else F.size(x.col)).cast("bigint"), "number", True)


@function("date", 1)
def _date(x: Typed) -> Typed:
    return Typed(F.to_timestamp(x.col), "date")


class Compiler:
    """``fields`` gives a name's Column and type, ``constants`` what isn't a field, ``lookup`` another fact's field."""

    def __init__(self, fields: Callable[[str], tuple[Column, T.DataType]], constants: dict[str, Any] | None = None, lookup: Callable[[Column, str], tuple[Column, T.DataType]] | None = None) -> None:
        self.fields, self.constants, self.lookup = fields, constants or {}, lookup

    def __call__(self, node: Node) -> Typed:
        return getattr(self, f"_{node.kind}")(node)

    def _lit(self, n: Node) -> Typed:
        return Typed(V.lit(n.value), V.literal_kind(n.value), isinstance(n.value, int) and not isinstance(n.value, bool))

    def _var(self, n: Node) -> Typed:
        c, t = self.fields(n.value)
        if not isinstance(t, T.NullType):
            return typed(c, t)
        if n.value in self.constants:
            return self._lit(Node("lit", self.constants[n.value]))
        raise RuleError("expression", f"unknown variable {n.value!r}")

    def _array(self, n: Node) -> Typed:
        items = [self(a) for a in n.args]
        return Typed(F.array(*(i.col for i in items)), "array", item=items[0] if items else None)

    def _object(self, n: Node) -> Typed:
        items = {k: self(a) for k, a in zip(n.value, n.args, strict=True)}
        return Typed(F.struct(*(x.col.alias(k) for k, x in items.items())) if items else F.create_map(), "object", fields=items)

    def _unary(self, n: Node) -> Typed:
        x = taken(self(n.args[0]), "number" if n.value == "-" else "boolean")
        if n.value == "-":
            _numbers("-", x)
            return Typed(-x.col, "number", x.whole)
        by = {"boolean": lambda: ~x.col, "array": lambda: F.size(x.col) == 0, "object": lambda: F.lit(not x.fields), "null": lambda: F.lit(True)}
        if x.kind not in by:
            raise RuleError("type", f"! can't take {x.kind}")
        return Typed(F.coalesce(by[x.kind](), F.lit(True)), "boolean")

    def _binary(self, n: Node) -> Typed:
        a, b, op = self(n.args[0]), self(n.args[1]), n.value
        if "cell" in (a.kind, b.kind):
            kinds = {a.kind, b.kind} - {"cell", "null"}
            want = kinds.pop() if kinds else "boolean" if op in ("||", "&&") else "string" if op in ("++", "contains", "starts_with", "ends_with") else "number"
            if op in ("==", "!=") and a.kind == b.kind:
                same = V.cell_equal(a.col, b.col, typed=False)
                return Typed(same if op == "==" else ~same, "boolean")
            a, b = taken(a, want), taken(b, want)
        if op in ("||", "&&"):
            if {a.kind, b.kind} - {"boolean"}:
                raise RuleError("type", f"{op} needs booleans, not {a.kind} and {b.kind}")
            return Typed(a.col | b.col if op == "||" else a.col & b.col, "boolean")
        if op in ("==", "!="):
            return Typed(self._same(a, b) if op == "==" else ~self._same(a, b), "boolean")
        if op in ("<", "<=", ">", ">="):
            if a.kind != b.kind or a.kind not in ("number", "string", "date", "array"):
                raise RuleError("type", f"can't order {a.kind} and {b.kind}")
            x, y = (F.size(a.col), F.size(b.col)) if a.kind == "array" else (a.col, b.col)
            return Typed({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], "boolean")
        if op == "in":
            return Typed(F.array_contains(b.col, a.col), "boolean")
        if op == "++":
            if a.kind != b.kind or a.kind not in ("string", "array"):
                raise RuleError("type", f"++ can't join {a.kind} and {b.kind}")
            return Typed(F.concat(a.col, b.col), a.kind, item=a.item or b.item)
        if op in ("contains", "starts_with", "ends_with"):
            if op == "contains" and a.kind == "array":
                return Typed(F.array_contains(a.col, b.col), "boolean")
            if a.kind != "string" or b.kind != "string":
                raise RuleError("type", f"{op} needs text, not {a.kind} and {b.kind}")
            return Typed({"contains": a.col.contains, "starts_with": a.col.startswith, "ends_with": a.col.endswith}[op](b.col), "boolean")
        if op == "+" and a.kind == b.kind == "string":
            return Typed(F.concat(a.col, b.col), "string")
        _numbers(op, a, b)
        whole = a.whole and b.whole
        if op == "/":
            return Typed(a.col.cast("double") / b.col.cast("double"), "number")
        if op == "**":
            power = F.pow(a.col.cast("double"), b.col.cast("double"))
            positive = n.args[1].kind == "lit" and n.args[1].value >= 0
            return Typed(power.cast("bigint") if whole and positive else power, "number", whole and positive)
        return Typed({"+": a.col + b.col, "-": a.col - b.col, "*": a.col * b.col, "%": a.col % b.col}[op], "number", whole)

    def _same(self, a: Typed, b: Typed) -> Column:
        if "null" in (a.kind, b.kind):
            return F.lit(True) if a.kind == b.kind else (a if b.kind == "null" else b).col.isNull()
        if a.kind != b.kind:
            return a.col.isNull() & b.col.isNull()
        if a.kind == "number" and not (a.whole and b.whole):
            near = F.abs(a.col - b.col) < 2.220446049250313e-16
            return F.coalesce(near | (a.col == b.col), a.col.isNull() & b.col.isNull())
        if a.kind == "object":
            return F.to_json(a.col).eqNullSafe(F.to_json(b.col))
        return a.col.eqNullSafe(b.col)

    def _call(self, n: Node) -> Typed:
        if n.value not in FUNCTIONS:
            raise RuleError("expression", f"unknown function {n.value!r}")
        least, most, f = FUNCTIONS[n.value]
        if len(n.args) < least or most is not None and len(n.args) > most:
            raise RuleError("expression", f"{n.value} takes {least} to {most or 'any number of'} arguments, not {len(n.args)}")
        args = [self(a) for a in n.args]
        # what functions take from fields of several kinds is their number
        return f(*(taken(x, "number") for x in args))

    def _index(self, n: Node) -> Typed:
        x, i = self(n.args[0]), self(n.args[1])
        if x.kind == "array":
            at = F.when(i.col >= 0, i.col + 1).otherwise(i.col).cast("int")
            item = x.item or Typed(F.lit(None), "null")
            return Typed(F.element_at(x.col, at), item.kind, item.whole, item.item, item.fields)
        if x.kind == "object" and n.args[1].kind == "lit" and x.fields is not None:
            return self._part(x, n.args[1].value)
        if x.kind == "object":
            item = x.item or Typed(F.lit(None), "string")
            return Typed(F.try_element_at(x.col, i.col), item.kind, item.whole, item.item, item.fields)
        raise RuleError("type", f"{x.kind} can't be indexed")

    def _part(self, x: Typed, name: str) -> Typed:
        got = x.fields.get(name)
        if got is None:
            return Typed(F.lit(None), "null")
        if isinstance(got, Typed):
            return Typed(x.col[name], got.kind, got.whole, got.item, got.fields)
        return typed(x.col[name], got)

    def _field(self, n: Node) -> Typed:
        x = self(n.args[0])
        if x.kind == "object" and x.fields is not None:
            return self._part(x, n.value)
        if x.kind == "string" and self.lookup:
            return typed(*self.lookup(x.col, n.value))
        raise RuleError("type", f"{x.kind} has no field {n.value!r}")

    def _truth(self, x: Typed) -> Column:
        if x.kind == "cell":
            return F.coalesce(x.col["b"], V.cell_number(x.col) != 0, F.length(x.col["s"]) > 0, x.col["ts"].isNotNull())
        by = {"boolean": lambda: x.col, "number": lambda: x.col != 0, "string": lambda: F.length(x.col) > 0, "date": lambda: x.col.isNotNull(), "array": lambda: F.size(x.col) > 0, "object": lambda: F.lit(bool(x.fields)), "null": lambda: F.lit(False)}
        return F.coalesce(by[x.kind](), F.lit(False))

    def _if(self, n: Node) -> Typed:
        c, a, b = (self(x) for x in n.args)
        return Typed(F.when(self._truth(c), a.col).otherwise(b.col), b.kind if a.kind == "null" else a.kind, a.whole and b.whole, a.item or b.item, a.fields or b.fields)

    def _cond(self, n: Node) -> Typed:
        args = [self(x) for x in n.args]
        last = args.pop() if n.value else None
        pairs = list(zip(args[::2], args[1::2], strict=True))
        out = reduce(lambda w, p: w.when(self._truth(p[0]), p[1].col), pairs[1:], F.when(self._truth(pairs[0][0]), pairs[0][1].col))
        first = pairs[0][1]
        if last is None:
            return Typed(out.otherwise(F.raise_error(F.lit("No condition matched"))), first.kind, False, first.item, first.fields)
        return Typed(out.otherwise(last.col), first.kind, all(p[1].whole for p in pairs) and last.whole, first.item, first.fields)


def compile_expression(text: str, fields, constants: dict[str, Any] | None = None, lookup=None) -> Typed:
    return Compiler(fields, constants, lookup)(parse(text))
