"""The row-transform language, compiled to Spark columns.

    expr := name "(" [expr ("," expr)*] ")" | field | "string" | number

Values are text. A call with an argument too few is null; unknown functions and bad syntax raise when compiled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions.columns import half_up, integer, is_blank, number, shown_number, trimmed


class BadExpression(ValueError):
    pass


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Field:
    name: str


@dataclass(frozen=True)
class Text:
    value: str


_TOKENS = re.compile(r'\s*(?:(?P<text>"(?:[^"\\]|\\.)*")|(?P<number>-?\d+(?:\.\d+)?)|(?P<name>\w+)|(?P<mark>[(),]))', re.S)


def parse(source: str):
    """The syntax tree of an expression."""
    tokens: list[tuple[str, str]] = []
    at, end = 0, len(source.rstrip())
    while at < end:
        m = _TOKENS.match(source, at)
        if m is None:
            raise BadExpression(f"unexpected {source[at:at + 10]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    tokens.append(("end", ""))
    tree, rest = _expression(tokens, 0)
    if tokens[rest][0] != "end":
        raise BadExpression(f"unexpected {tokens[rest][1]!r}")
    return tree


def _expression(tokens: list[tuple[str, str]], at: int):
    kind, value = tokens[at]
    if kind == "text":
        return Text(re.sub(r"\\(.)", r"\1", value[1:-1], flags=re.S)), at + 1
    if kind == "number":
        return Text(value), at + 1
    if kind != "name":
        raise BadExpression("an expression is missing")
    if tokens[at + 1] != ("mark", "("):
        return Field(value), at + 1
    if value not in FUNCTIONS:
        raise BadExpression(f"no function {value}")
    args, at = [], at + 2
    if tokens[at] == ("mark", ")"):
        return Call(value, ()), at + 1
    while True:
        arg, at = _expression(tokens, at)
        args.append(arg)
        if tokens[at] == ("mark", ")"):
            return Call(value, tuple(args)), at + 1
        if tokens[at] != ("mark", ","):
            raise BadExpression("a bracket is not closed")
        at += 1


def NULL(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _truthy(c: Column) -> Column:
    return ~is_blank(c) & ~c.isin("false", "0")


def _said(b: Column) -> Column:
    return F.when(b, F.lit("true")).otherwise(F.lit("false"))


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _arithmetic(op: Callable[[Column, Column], Column]):
    return 2, lambda a: shown_number(op(number(a[0]), number(a[1])))


def _compare(op: Callable[[Column, Column], Column]):
    def build(a):
        x, y = number(a[0]), number(a[1])
        return _said(F.when(x.isNotNull() & y.isNotNull(), op(x, y)).otherwise(op(_or_empty(a[0]), _or_empty(a[1]))))

    return 2, build


def _slice(a):
    size = F.length(a[0])
    start = F.greatest(F.lit(0), F.least(F.coalesce(integer(a[1]), F.lit(0)) if len(a) > 1 else F.lit(0), size))
    stop = F.greatest(start, F.least(F.coalesce(integer(a[2]), size) if len(a) > 2 else size, size))
    return F.substring(a[0], start + 1, stop - start)


def _split(a):
    mark = F.concat(F.lit(r"\Q"), F.coalesce(a[1], F.lit(",")), F.lit(r"\E"))
    i = F.coalesce(integer(a[2]), F.lit(0)) if len(a) > 2 else F.lit(0)
    return F.when(i >= 0, trimmed(F.try_element_at(F.split(a[0], mark), i + 1)))


def _all_of(a, both: Callable[[Column, Column], Column], start: bool) -> Column:
    out = F.lit(start)
    for x in a:
        out = both(out, _truthy(x))
    return _said(out)


#: Name to (least arguments, builder of a column from columns).
FUNCTIONS: dict[str, tuple[int, Callable]] = {
    "upper": (1, lambda a: F.upper(a[0])),
    "lower": (1, lambda a: F.lower(a[0])),
    "trim": (1, lambda a: trimmed(a[0])),
    "strip": (1, lambda a: F.btrim(a[0], F.coalesce(a[1], F.lit(" ")) if len(a) > 1 else F.lit(" "))),
    "replace": (3, lambda a: F.replace(a[0], _or_empty(a[1]), _or_empty(a[2]))),
    "regex_replace": (3, lambda a: F.regexp_replace(a[0], _or_empty(a[1]), _or_empty(a[2]))),
    "regex_extract": (2, lambda a: F.regexp_substr(_or_empty(a[0]), a[1])),
    "substring": (1, _slice),
    "split": (2, _split),
    "concat": (0, lambda a: F.concat(F.lit(""), *[_or_empty(x) for x in a])),
    "digits": (1, lambda a: F.regexp_replace(a[0], r"\P{Nd}", "")),
    "length": (1, lambda a: F.length(_or_empty(a[0])).cast("string")),
    "default": (1, lambda a: F.when(~is_blank(a[0]), a[0]).otherwise(a[1] if len(a) > 1 else NULL("string"))),
    "coalesce": (0, lambda a: F.coalesce(NULL("string"), *[F.when(~is_blank(x), x) for x in a])),
    "to_number": (1, lambda a: shown_number(number(a[0]))),
    "round": (1, lambda a: shown_number(half_up(number(a[0]), F.coalesce(integer(a[1]), F.lit(0)) if len(a) > 1 else 0))),
    "add": _arithmetic(lambda x, y: x + y),
    "sub": _arithmetic(lambda x, y: x - y),
    "mul": _arithmetic(lambda x, y: x * y),
    "div": _arithmetic(F.try_divide),
    "eq": (2, lambda a: _said(trimmed(a[0]).eqNullSafe(trimmed(a[1])))),
    "gt": _compare(lambda x, y: x > y),
    "lt": _compare(lambda x, y: x < y),
    "gte": _compare(lambda x, y: x >= y),
    "lte": _compare(lambda x, y: x <= y),
    "contains": (2, lambda a: _said(F.contains(F.lower(_or_empty(a[0])), F.lower(_or_empty(a[1]))))),
    "not": (1, lambda a: _said(~_truthy(a[0]))),
    "and": (0, lambda a: _all_of(a, lambda x, y: x & y, True)),
    "or": (0, lambda a: _all_of(a, lambda x, y: x | y, False)),
    "if": (1, lambda a: F.when(_truthy(a[0]), a[1] if len(a) > 1 else NULL("string")).otherwise(a[2] if len(a) > 2 else NULL("string"))),
}


def compiled(source: str, columns: Mapping[str, Column] | list[str]) -> Column:
    """The column that an expression stands for. Fields that are not among the columns are null."""
    known = columns if isinstance(columns, Mapping) else {c: F.col(f"`{c}`").cast("string") for c in columns}

    def build(node) -> Column:
        if isinstance(node, Text):
            return F.lit(node.value)
        if isinstance(node, Field):
            return known.get(node.name, NULL("string"))
        least, make = FUNCTIONS[node.name]
        return NULL("string") if len(node.args) < least else make([build(x) for x in node.args])

    return build(parse(source))


def slug(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def transformed(df, transforms: Mapping[str, str]):
    """df with a column for each (name, expression), all from the columns as they were; a blank expression is left out."""
    names = df.columns
    new = {slug(k): compiled(v, names) for k, v in transforms.items() if v.strip()}
    kept = [F.col(f"`{c}`") for c in names if c not in new]
    return df.select(*kept, *[c.alias(k) for k, c in new.items()])
