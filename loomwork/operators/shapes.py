"""Columns that share a canonical field become one scalar, a list, or a list of {type, value}."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.columns import blank_to_null, cleaned, split_values, trimmed
from loomwork.operators.profile import OS_TYPE

#: Share of rows with two or more slots filled below which slots are one field, and above which no common stem is needed.
LEAST_SHARED, WITHOUT_STEM = 0.02, 0.5
STEM = 3


@dataclass(frozen=True)
class Shape:
    canonical: str
    cardinality: str  # scalar or array
    style: str  # single, positional or semantic
    kind: str
    sources: tuple[str, ...]
    labels: tuple[str | None, ...]
    shared: float = 0.0

    @property
    def os_type(self) -> str | None:
        return OS_TYPE.get(self.kind)

    @property
    def tagged(self) -> bool:
        return self.cardinality == "array" and self.style == "semantic"


def common_prefix(names: Sequence[str]) -> str:
    out = []
    for letters in zip(*names):
        if len(set(letters)) > 1:
            break
        out.append(letters[0])
    return "".join(out)


def qualifiers(names: Sequence[str]) -> tuple[tuple[str | None, ...], str, bool]:
    """(label of each column, style, whether the names share a stem): what is left between common prefix and suffix."""
    if len(names) == 1:
        return (None,), "single", False
    head = common_prefix(names)
    tail = common_prefix([n[::-1] for n in names])[::-1]
    stem = sum(ch.isalnum() for ch in head + tail) >= STEM
    middle = [n[len(head) : len(n) - len(tail)] if len(head) + len(tail) < len(n) else "" for n in names]
    labels = tuple(re.sub(r"[^A-Za-z0-9]+", " ", m).strip() for m in middle)
    return labels, "positional" if all(not x or x.isdigit() for x in labels) else "semantic", stem


def group_kind(kinds: Sequence[str]) -> str:
    """free_text only if all are; else the first other kind."""
    return next((k for k in kinds if k != "free_text"), "free_text")


def slot_counts(df: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """One row: n, and for each group g the rows with two or more slots filled and those where they differ (one pass)."""
    aggs = [F.count("*").alias("n")]
    for g, names in groups.items():
        filled = F.array_compact(F.array(*[trimmed(blank_to_null(F.col(f"`{c}`").cast("string"))) for c in names]))
        aggs.append(F.count_if(F.size(filled) >= 2).alias(f"{g}__shared"))
        aggs.append(F.count_if(F.size(F.array_distinct(filled)) >= 2).alias(f"{g}__differ"))
    return df.agg(*aggs)


def plan(df: DataFrame, named: Sequence[tuple[str, str, str]], lists: frozenset[str] = frozenset()) -> list[Shape]:
    """Shapes of a table from (column, kind, canonical) in column order; lists: canonicals that always hold lists."""
    groups: dict[str, list[tuple[str, str]]] = {}
    for column, kind, canonical in named:
        groups.setdefault(canonical, []).append((column, kind))
    kinds = {c: group_kind([k for _, k in own]) for c, own in groups.items()}
    asked = {c: [n for n, _ in own] for c, own in groups.items() if len(own) > 1 and kinds[c] != "free_text"}
    counts = slot_counts(df, asked).first() if asked else None
    out = []
    for c, own in groups.items():
        names = tuple(n for n, _ in own)
        labels, style, stem = qualifiers(names)
        cardinality, shared = "scalar", 0.0
        if c in asked:
            both, differ = counts[f"{c}__shared"], counts[f"{c}__differ"]
            shared = both / counts["n"] if counts["n"] else 0.0
            if shared >= LEAST_SHARED and differ / max(both, 1) >= 0.5 and (stem or shared >= WITHOUT_STEM):
                cardinality = "array"
        if c in lists:
            cardinality = "array"
        out.append(Shape(c, cardinality, style, kinds[c], names, labels, shared))
    return out


def first_value(columns: Sequence[Column], kind: str) -> Column:
    return F.coalesce(*[cleaned(c, kind) for c in columns])


def positional(columns: Sequence[Column], kind: str) -> Column:
    """Distinct values in column order."""
    return F.array_distinct(F.array_compact(F.array(*[cleaned(c, kind) for c in columns])))


def labelled(columns: Sequence[Column], labels: Sequence[str | None], kind: str) -> Column:
    """list of {type, value}, one for each distinct value, with the first label; no label is "other", a blank one stays."""
    items = [
        F.when(cleaned(c, kind).isNotNull(), F.struct(F.lit("other" if x is None else x).alias("type"), cleaned(c, kind).alias("value")))
        for c, x in zip(columns, labels)
    ]
    present = F.array_compact(F.array(*items))
    values = F.transform(present, lambda x: x["value"])
    return F.filter(present, lambda x, i: F.array_position(values, x["value"]) == i + 1)


def as_texts(shape: Shape) -> Column:
    """The field as list<{type, value: string}>: the common form in which files merge (see entities)."""
    columns = [F.col(f"`{c}`").cast("string") for c in shape.sources]
    text = lambda c: cleaned(c, shape.kind).cast("string")
    tag = lambda values, kind: F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))
    if shape.cardinality == "array" and len(columns) == 1:
        return tag(F.coalesce(split_values(blank_to_null(columns[0])), F.array().cast("array<string>")), "other")
    if shape.tagged:
        items = labelled(columns, shape.labels, shape.kind)
        return F.transform(items, lambda x: F.struct(F.when(F.trim(x["type"]) == "", "other").otherwise(x["type"]).alias("type"), x["value"].cast("string").alias("value")))
    values = [text(c) for c in columns]
    if shape.cardinality == "scalar":
        values = [F.coalesce(*values)]
    return tag(F.array_distinct(F.array_compact(F.array(*values))), "other")


def consolidated(df: DataFrame, shapes: Sequence[Shape], keep: Sequence[str] = ()) -> DataFrame:
    """df with a column for each shape, in the shape's own type: one select."""
    out = []
    for s in shapes:
        columns = [F.col(f"`{c}`").cast("string") for c in s.sources]
        if s.cardinality == "scalar" or s.kind == "free_text":
            c = first_value(columns, s.kind)
        elif s.style == "semantic":
            c = labelled(columns, s.labels, s.kind)
        elif len(columns) == 1:
            c = split_values(blank_to_null(columns[0]))
        else:
            c = positional(columns, s.kind)
        out.append(c.alias(s.canonical))
    return df.select(*keep, *out)
