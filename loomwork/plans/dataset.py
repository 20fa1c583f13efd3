"""One table: profile, name, shape, then a lazy plan for its documents and searches."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import filters
from loomwork.operators import facets, shapes, tags
from loomwork.operators.canon import Embed, Mapping
from loomwork.operators.profile import Profile, profile, quality_counts
from loomwork.sources import sinks

_KIND = {"double": "num", "long": "num", "integer": "num", "float": "num", "date": "date"}


def filter_kind(os_type: str | None) -> str | None:
    return _KIND.get(os_type or "")


@dataclass
class Dataset:
    """A table with what has been found out about it. ``order`` names the columns that order its rows."""

    df: DataFrame
    order: Sequence[str]
    profiles: list[Profile]
    names: dict[str, tuple[str, str]]
    shapes: list[shapes.Shape]

    @classmethod
    def load(cls, df: DataFrame, order: Sequence[str] = ("_row",), mapping: Mapping | None = None, embed: Embed | None = None) -> Dataset:
        mapping = mapping or Mapping()
        found = profile(df, list(order))
        names = {p.name: mapping.resolve(p.name, p.kind, embed) for p in found}
        named = [(p.name, p.kind, names[p.name][0]) for p in found if p.searchable]
        lists = frozenset(c for c, (_, multiple) in mapping.custom.items() if multiple)
        return cls(df, order, found, names, shapes.plan(df, named, lists))

    def documents(self) -> DataFrame:
        return shapes.consolidated(self.df, self.shapes, self.order)

    def merge_texts(self) -> DataFrame:
        """Every field as list<{type, value}>, scalars as text: what merges over files."""
        own = [
            (shapes.as_texts(s) if s.cardinality == "array" else shapes.first_value([F.col(f"`{c}`").cast("string") for c in s.sources], s.kind).cast("string")).alias(s.canonical)
            for s in self.shapes
        ]
        return self.df.select(*self.order, *own)

    def quality(self) -> DataFrame:
        numeric = [p.name for p in self.profiles if p.kind == "numeric" and p.searchable]
        return quality_counts(self.df, numeric) if numeric else self.df.sparkSession.sql("SELECT 0L AS coerced, 0L AS quarantined")

    @property
    def escalations(self) -> int:
        return sum(p.escalated for p in self.profiles)

    @property
    def text_fields(self) -> list[str]:
        return [s.canonical for s in self.shapes if s.kind == "free_text" or s.canonical == "description"]

    def keywords(self, field: str | None = None) -> DataFrame:
        fields = [field] if field else self.text_fields
        text = F.concat_ws(" ", *[F.col(f"`{c}`") for c in fields])
        docs = self.documents().withColumn("_seq", F.struct(*self.order))
        return tags.keywords(docs, "_seq", text)

    def facets(self) -> DataFrame:
        own = [s for s in self.shapes if s.kind != "free_text"]
        docs = shapes.consolidated(self.df, self.shapes, self.order).withColumn("_seq", F.struct(*self.order))
        lists = {s.canonical for s in own if s.cardinality == "array"}
        flat = [F.transform(F.col(f"`{s.canonical}`"), lambda x: x["value"]).alias(s.canonical) if s.tagged else F.col(f"`{s.canonical}`") for s in own]
        rows = docs.select("_seq", *flat)
        return facets.facets(facets.counts(rows, [s.canonical for s in own], "_seq", lists))

    def test(self, field: str, value: str) -> Column:
        s = next((x for x in self.shapes if x.canonical == field), None)
        if s is None:
            return F.lit(False)
        c = F.col(f"`{field}`")
        c = F.transform(c, lambda x: x["value"]) if s.tagged else c
        return filters.matches(c, value, filter_kind(s.os_type), s.cardinality == "array")

    def matching(self, query: str = "", where: Sequence[tuple[str, str]] = (), mode: str = "all", tag: tuple[str, str] | None = None) -> DataFrame:
        """All documents that a search finds. The whole query is a part of the document's text, or with mode ``keyword``
        of its extracted keywords; tag: a text field and one of its keywords."""
        docs = self.documents()
        if mode == "keyword" and query.strip():
            found = self.keywords().groupBy("_seq").agg(F.array_join(F.sort_array(F.collect_list("keyword")), " ").alias("_blob"))
            docs = docs.withColumn("_seq", F.struct(*self.order)).join(found, "_seq", "left").drop("_seq")
            keep = F.contains(F.coalesce("_blob", F.lit("")), F.lit(query.strip().lower()))
        else:
            texts = [F.to_json(c) if t.startswith("array") else c.cast("string") for c, t in ((F.col(f"`{n}`"), t) for n, t in docs.dtypes if n not in self.order)]
            keep = F.contains(F.lower(F.concat_ws(" ", *texts)), F.lit(query.strip().lower())) if query.strip() else F.lit(True)
        for field, value in where:
            keep = keep & self.test(field, value)
        found = docs.where(keep).drop("_blob")
        if tag:
            tagged = self.keywords(tag[0]).where(F.col("keyword") == tag[1]).select("_seq")
            found = found.withColumn("_seq", F.struct(*self.order)).join(tagged, "_seq", "left_semi").drop("_seq")
        return found

    def search(self, query: str = "", where: Sequence[tuple[str, str]] = (), page: int = 1, size: int = 12, **more) -> DataFrame:
        """A page of ``matching`` in row order."""
        return facets.page(self.matching(query, where, **more), self.order, page, size)

    def total(self, query: str = "", where: Sequence[tuple[str, str]] = (), **more) -> DataFrame:
        """One row: the hits of a search before paging."""
        return self.matching(query, where, **more).agg(F.count("*").alias("total"))

    def kind_counts(self) -> dict[str, int]:
        """How many columns have each kind."""
        return dict(Counter(p.kind for p in self.profiles))

    def query_json(self, query: str = "", where: Sequence[tuple[str, str]] = (), size: int = 12) -> str:
        fields = [s.canonical for s in self.shapes if s.os_type in ("keyword", "text")]
        return filters.query_json(query, where, fields, size=size)

    def mapping(self) -> dict:
        return sinks.mapping(self.shapes)

    def json_schema(self, title: str) -> dict:
        return sinks.json_schema(self.mapping(), frozenset(s.canonical for s in self.shapes if s.cardinality == "array"), title)
