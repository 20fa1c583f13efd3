"""Many tables as one set of entities: specs in Python, everything else a lazy plan made from them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import dsl, filters, geo
from loomwork.operators import enrich, entities, extract, facets, tags, vectors
from loomwork.operators.canon import Embed, Mapping
from loomwork.plans.dataset import Dataset, filter_kind
from loomwork.sources import sinks
from loomwork.sources.files import ROW, short_name


class Collection:
    """A named set of files merged by a key. Each change drops the plan; the next read makes it anew."""

    def __init__(self, name: str, key: str = "email", embed: Embed | None = None):
        self.name, self.key, self.embed = name, key, embed
        self.files: list[tuple[str, DataFrame]] = []
        self.mapping = Mapping()
        self.transforms: dict[str, str] = {}
        self.references: list[tuple[str, str, object]] = []
        self.segments: dict[str, list[tuple[str, str]]] = {}
        self.attributes: list[extract.Attribute] = []
        self.client = extract.NoModel
        self._loaded: list[tuple[str, Dataset]] | None = None

    # ---- changes

    def _changed(self) -> Collection:
        self._loaded = None
        return self

    def add(self, name: str, df: DataFrame) -> Collection:
        """A table with a ``_row`` column that orders it."""
        name = short_name(name)
        if any(n == name for n, _ in self.files):
            raise ValueError(f"{name} is in the collection")
        self.files.append((name, df))
        return self._changed()

    def rekey(self, key: str) -> Collection:
        self.key = key
        return self._changed()

    def override(self, column: str, canonical: str | None) -> Collection:
        self.mapping.override(column, canonical)
        return self._changed()

    def add_canonical(self, name: str, type_: str = "keyword", multiple: bool = False) -> Collection:
        self.mapping.add(name, type_, multiple)
        return self._changed()

    def remove_canonical(self, name: str) -> Collection:
        self.mapping.remove(name)
        return self._changed()

    def transform(self, field: str, expression: str) -> Collection:
        """A new field by an expression; a blank one removes it. Bad expressions raise here."""
        field = dsl.slug(field)
        if expression.strip():
            dsl.parse(expression)
            self.transforms[field] = expression
        else:
            self.transforms.pop(field, None)
        return self._changed()

    def enrich(self, source: str, reference: DataFrame | Collection, field: str) -> Collection:
        """Fill fields from a table or another collection by a field that both have; the same source is replaced."""
        if reference is self:
            raise ValueError("a collection can't be its own reference")
        self.references = [r for r in self.references if r[0] != source] + [(source, field, reference)]
        return self

    def remove_enrichment(self, source: str) -> Collection:
        self.references = [r for r in self.references if r[0] != source]
        return self

    def segment(self, name: str, where: Sequence[tuple[str, str]]) -> Collection:
        self.segments[name] = list(where)
        return self

    def remove_segment(self, name: str) -> Collection:
        self.segments.pop(name, None)
        return self

    def extract(self, attributes: Sequence[extract.Attribute], client=extract.NoModel) -> Collection:
        self.attributes, self.client = list(attributes), client
        return self

    # ---- plans

    def datasets(self) -> list[tuple[str, Dataset]]:
        if self._loaded is None:
            self._loaded = [(n, Dataset.load(dsl.transformed(df, self.transforms), (ROW,), self.mapping, self.embed)) for n, df in self.files]
        return self._loaded

    def schema(self) -> dict[str, dict]:
        """Field to type, kind, cardinality, sources and whether the files disagree on its type."""
        out: dict[str, dict] = {}
        for name, d in self.datasets():
            for s in d.shapes:
                custom = self.mapping.custom.get(s.canonical)
                kind = custom[0] if custom else s.os_type
                own = out.setdefault(s.canonical, {"os_type": kind, "kind": s.kind, "cardinality": "scalar", "sources": [], "types": set()})
                own["sources"].append(name)
                own["types"].add(s.os_type)
                if s.cardinality == "array" or (custom and custom[1]):
                    own["cardinality"] = "array"
        for own in out.values():
            own["conflict"] = len(own["types"]) > 1
        return out

    def _fields(self) -> tuple[list[str], list[str]]:
        own = self.schema()
        return [c for c, s in own.items() if s["cardinality"] != "array"], [c for c, s in own.items() if s["cardinality"] == "array"]

    def rows(self) -> DataFrame:
        """All rows of all files in the form that merges."""
        _, lists = self._fields()
        parts = []
        for name, d in self.datasets():
            df = d.merge_texts()
            for c in lists:  # a list in another file
                if c in df.columns and not dict(df.dtypes)[c].startswith("array"):
                    item = F.when(F.col(f"`{c}`").isNotNull(), F.array(F.struct(F.lit("other").alias("type"), F.col(f"`{c}`").alias("value"))))
                    df = df.withColumn(c, item)
            parts.append((name, df))
        return entities.union_files(parts, (ROW,))

    def merged(self) -> DataFrame:
        """Entities: scalars as lists of the values seen, lists as {type, value}; _key, _first, _rows, _source_file."""
        scalars, lists = self._fields()
        rows = self.rows()
        if self.key in rows.columns:
            text = F.array_join(F.transform(F.col(f"`{self.key}`"), lambda x: x["value"]), " ") if self.key in lists else F.col(f"`{self.key}`")
            rows = rows.withColumn("_keytext", text)
        else:
            rows = rows.withColumn("_keytext", F.lit(None).cast("string"))
        return entities.merge(rows, "_keytext", self.key, scalars, lists)

    def entities(self) -> DataFrame:
        """``merged`` after enrichments and extraction."""
        out = self.merged()
        for source, field, reference in self.references:
            out = self._enriched(out, field, reference)
        if self.attributes:
            text = [self.text(c) for c in self.text_fields() if c in out.columns]
            if text:
                out = extract.extract(out.withColumn("_all_text", F.concat_ws(" ", *text)), "_all_text", self.attributes, self.client).drop("_all_text")
        return out

    def _enriched(self, df: DataFrame, field: str, reference) -> DataFrame:
        if isinstance(reference, Collection):
            ref, order, key = reference.entities(), ("_first",), F.array_join(reference.plain(field), " ")
            names = [c for c in ref.columns if not c.startswith("_") and c != field]
        else:
            d = Dataset.load(reference, (ROW,), self.mapping, self.embed)
            ref, order = d.merge_texts(), (ROW,)
            ref = ref.select(*[F.when(F.col(f"`{c}`").isNotNull(), F.array(F.col(f"`{c}`"))).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in ref.dtypes])
            key, names = F.array_join(F.col(f"`{field}`"), " "), [c for c in ref.columns if c not in (field, ROW)]
        found = enrich.reference(ref, key, field, names, order)
        own = df.select(*[F.when(F.size(F.col(f"`{c}`")) > 0, F.col(f"`{c}`")).alias(c) if t.startswith("array") else F.col(f"`{c}`") for c, t in df.dtypes])
        return enrich.enrich(own, F.array_join(self.plain(field), " "), field, found, names).drop("_gained")

    # ---- reading

    def text_fields(self) -> list[str]:
        return [c for c, s in self.schema().items() if s["kind"] == "free_text" or c == "description"]

    def plain(self, field: str) -> Column:
        """A field's values as a list of texts."""
        return F.transform(F.col(f"`{field}`"), lambda x: x["value"]) if field in self._fields()[1] else F.col(f"`{field}`")

    def text(self, field: str) -> Column:
        return F.array_join(F.coalesce(self.plain(field), F.array().cast("array<string>")), " ")

    def where(self, tests: Sequence[tuple[str, str]]) -> Column:
        own, out = self.schema(), F.lit(True)
        for field, value in tests:
            out = out & (filters.matches(self.plain(field), value, filter_kind(own[field]["os_type"]), True) if field in own else F.lit(False))
        return out

    def blob(self) -> Column:
        return F.concat_ws(" ", *[self.text(c) for c in self.schema()])

    def matching(
        self,
        query: str = "",
        where: Sequence[tuple[str, str]] = (),
        sources: Sequence[str] = (),
        box: Sequence[float] | None = None,
        ring: Sequence[tuple[float, float]] | None = None,
        geo_field: str = "location",
        vector: Sequence[float] | None = None,
        tag: str | None = None,
    ) -> DataFrame:
        """All entities that a search finds: filters and the tag first, then all terms of the query, or those that have a
        vector (with their score) where a query vector is given."""
        df = self.tagged() if tag else self.entities()
        keep = self.where(where)
        if tag:
            keep = keep & tags.with_tag(F.col("_tags"), tag)
        if sources:
            keep = keep & F.arrays_overlap("_source_file", F.array(*[F.lit(short_name(s)) for s in sources]))
        if box or ring:
            keep = keep & (F.coalesce(geo.matches(self.plain(geo_field), box, ring), F.lit(False)) if geo_field in df.columns else F.lit(False))
        if vector is not None and "_vector" in df.columns:
            return vectors.scored(df.where(keep), F.col("_vector"), vector)
        return df.where(keep & filters.all_terms(self.blob(), query))

    def search(self, query: str = "", page: int = 1, size: int = 30, **tests) -> DataFrame:
        """A page of ``matching``: by score where there is one, else in the order of arrival."""
        found = self.matching(query, **tests)
        return facets.page(found, [F.desc("score"), "_first"] if "score" in found.columns else ["_first"], page, size)

    def total(self, query: str = "", **tests) -> DataFrame:
        """One row: the hits of a search before paging."""
        return self.matching(query, **tests).agg(F.count("*").alias("total"))

    def tagged(self) -> DataFrame:
        """``entities`` with their tags, ``_tags``."""
        lists = tags.tag_lists(self.keywords(), "_first").withColumnRenamed("tags", "_tags")
        return self.entities().join(lists, "_first", "left")

    def keywords(self) -> DataFrame:
        fields = [c for c, s in self.schema().items() if s["os_type"] == "text"]
        return tags.keywords(self.merged(), "_first", F.concat_ws(" ", *[self.text(c) for c in fields]) if fields else F.lit(""))

    def detail(self) -> DataFrame:
        """One row: raw records, entities, merged."""
        return entities.counters(self.merged())

    def roll_up(self) -> list[tuple[str, str, str, int, bool]]:
        """(field, type, cardinality, number of files, whether their types differ): fields of most files first, then by name."""
        rows = [(c, s["os_type"], s["cardinality"], len(s["sources"]), s["conflict"]) for c, s in self.schema().items()]
        return sorted(rows, key=lambda r: (-r[3], r[0]))

    def progress(self) -> DataFrame:
        """One row: the distinct texts that extraction asks about, and those that gave a value for any attribute."""
        done = self.entities()
        text = [self.text(c) for c in self.text_fields()]
        own = done.where(F.trim(F.concat_ws(" ", *text)) != "").select(F.concat_ws(" ", *text).alias("t"), *[a.name for a in self.attributes])
        answered = F.lit(False)
        for a in self.attributes:
            answered = answered | F.col(a.name).isNotNull()
        return own.agg(F.count_distinct("t").alias("total"), F.count_distinct(F.when(answered, F.col("t"))).alias("done"))

    def conflicts(self) -> DataFrame:
        return entities.conflicts(self.merged(), self._fields()[0])

    def facets(self) -> DataFrame:
        own = [c for c, s in self.schema().items() if s["os_type"] in ("keyword", "boolean")]
        rows = self.merged().select("_first", *[self.plain(c).alias(c) for c in own])
        return facets.facets(facets.counts(rows, own, "_first", own))

    def segment_counts(self) -> DataFrame:
        return facets.segments(self.entities(), {n: self.where(w) for n, w in self.segments.items()})

    def index_name(self) -> str:
        return sinks.table_name(self.name)

    def index_mapping(self) -> dict:
        return sinks.collection_mapping({c: (s["os_type"], s["cardinality"]) for c, s in self.schema().items()})

    def reindex(self) -> int:
        """Write the entities with their tags as the collection's table; its rows."""
        return sinks.write_index(self.tagged(), self.index_name())

    def spec(self) -> dict:
        """What to save: everything but the data and the model client."""
        return {
            "name": self.name,
            "key": self.key,
            "files": [n for n, _ in self.files],
            "overrides": self.mapping.overrides,
            "custom": {k: list(v) for k, v in self.mapping.custom.items()},
            "transforms": self.transforms,
            "segments": {k: [list(x) for x in v] for k, v in self.segments.items()},
        }

    def register(self, view: str | None = None) -> None:
        """A temporary view of the entities for SQL."""
        self.entities().createOrReplaceTempView(view or sinks.table_name(self.name, ""))

    @classmethod
    def restored(cls, spec: dict, open_file: Callable[[str], DataFrame], embed: Embed | None = None) -> Collection:
        """A collection from a saved spec; files are read anew by name."""
        out = cls(spec["name"], spec["key"], embed)
        out.mapping = Mapping(dict(spec["overrides"]), {k: tuple(v) for k, v in spec["custom"].items()})
        out.transforms = dict(spec["transforms"])
        out.segments = {k: [tuple(x) for x in v] for k, v in spec["segments"].items()}
        for name in spec["files"]:
            out.add(name, open_file(name))
        return out
