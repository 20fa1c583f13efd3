"""Filter values such as ">150", "10-20" or "2024-01-01..2024-02-01", compiled to columns, and shown as query JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions.columns import NUMBER, plain_number, trimmed, words_of_text

_OPERATOR = re.compile(r"(>=|<=|>|<)\s*(.+)", re.S)
_NUMBERS = re.compile(r"(.+?)\s*(?:\.\.|to|-)\s*(.+)", re.S)
_DATES = re.compile(r"(.+?)\s*(?:\.\.|to)\s*(.+)", re.S)
_OPS = {">": Column.__gt__, ">=": Column.__ge__, "<": Column.__lt__, "<=": Column.__le__}
_NAMES = {">": "gt", ">=": "gte", "<": "lt", "<=": "lte"}


def _number(s: str) -> float | None:
    return float(s) if re.match(NUMBER, s.strip()) else None


def predicate(value: str, kind: str | None = None, typed: bool = False):
    """A function from a column to a boolean column for one filter value. kind: num, date or neither.

    Columns are text unless typed says that they are numbers (num) or clean ISO dates; typed comparisons stay plain, so
    that they reach the scan.
    """
    number, text = ((lambda c: c), (lambda c: c)) if typed else (plain_number, trimmed)
    s = value.strip()
    m = _OPERATOR.fullmatch(s)
    if kind == "num":
        if m:
            bound = _number(m[2])
            return (lambda c: F.lit(False)) if bound is None else (lambda c: _OPS[m[1]](number(c), F.lit(bound)))
        r = _NUMBERS.fullmatch(s)
        ends = [_number(x) for x in r.groups()] if r else [None]
        if None not in ends:
            return lambda c: number(c).between(min(ends), max(ends))
        if (same := _number(s)) is not None:
            return lambda c: number(c) == F.lit(same)
    if kind == "date":
        if m:
            return lambda c: _OPS[m[1]](text(c), F.lit(m[2].strip()))
        if r := _DATES.fullmatch(s):
            return lambda c: text(c).between(r[1].strip(), r[2].strip())
    return lambda c: F.lower(trimmed(c.cast("string"))) == F.lit(s.lower())


def scanned(c: Column, value: str, kind: str) -> Column:
    """The filter on a column that holds numbers or clean ISO dates, for use in where(): pushed down to the scan."""
    return predicate(value, kind, True)(c)


def strict_predicate(value: str, kind: str | None = None):
    """The stricter grammar: ``=`` as an operator, date bounds in either order, and numbers equal as numbers on any field."""
    s = value.strip()
    if s.startswith("="):
        s = s[1:].strip()
        same = _number(s)
        return (lambda c: plain_number(c) == F.lit(same)) if same is not None and kind != "date" else predicate(s)
    if kind == "date" and (r := _DATES.fullmatch(s)):
        low, high = sorted((r[1].strip(), r[2].strip()))
        return lambda c: trimmed(c).between(low, high)
    if kind is None and (same := _number(s)) is not None:
        return lambda c: F.coalesce(plain_number(c) == F.lit(same), F.lit(False)) | (F.lower(trimmed(c)) == F.lit(s.lower()))
    return predicate(value, kind)


def matches(c: Column, value: str, kind: str | None = None, is_array: bool = False, strict: bool = False) -> Column:
    """Whether a field has a value that the filter takes; for arrays any member will do. Never null."""
    test = strict_predicate(value, kind) if strict else predicate(value, kind)
    found = F.exists(c, lambda x: test(x.cast("string"))) if is_array else test(c.cast("string"))
    return F.coalesce(found, F.lit(False))


def all_terms(blob: Column, query: str) -> Column:
    """Keyword search: every term of the query is in the text, in any order. A query without terms takes all."""
    terms = re.sub(r"[^a-z0-9]+", " ", query.lower()).split()
    text = words_of_text(blob)
    out = F.lit(True)
    for t in terms:
        out = out & F.contains(text, F.lit(t))
    return out


def term_score(blob: Column, query: str) -> Column:
    """How often the query's terms stand in the lower-cased text, overlaps not counted."""
    text = F.lower(F.coalesce(blob, F.lit("")))
    out = F.lit(0.0)
    for t in query.lower().split():
        out = out + (F.length(text) - F.length(F.replace(text, F.lit(t), F.lit("")))) / F.lit(float(len(t)))
    return out


def _value(s: str):
    return s if _number(s) is None else _number(s)


def clause(field: str, value: str) -> dict:
    """One filter as query JSON. Any value with ".." or "to" inside reads as a range here, whatever the field's kind."""
    s = value.strip()
    if m := _OPERATOR.fullmatch(s):
        return {"range": {field: {_NAMES[m[1]]: _value(m[2])}}}
    if m := _DATES.fullmatch(s):
        return {"range": {field: {"gte": _value(m[1]), "lte": _value(m[2])}}}
    return {"term": {field: value}}


def query_json(
    query: str | None,
    filters: Sequence[tuple[str, str]],
    text_fields: Sequence[str],
    tag: tuple[str, str] | None = None,
    source: tuple[str, str] | None = None,
    size: int | None = None,
) -> str:
    """The query for display: match_all, or a bool of must and filter. The last of filters on one field stands."""
    terms = [clause(f, v) for f, v in dict(filters).items()]
    terms += [{"term": {f: v}} for f, v in (x for x in (tag, source) if x and x[0] and x[1])]
    must = [{"multi_match": {"query": query, "fields": list(text_fields)}}] if query and query.strip() else []
    inner = ({"must": must} if must else {}) | ({"filter": terms} if terms else {})
    body = {"bool": inner} if inner else {"match_all": {}}
    return json.dumps(body if size is None else {"size": size, "query": body})
