"""Rows of many files merged into entities by a normalised key; conflicts are kept, in the order they were seen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.columns import key_of

TAGGED = "array<struct<type:string,value:string>>"


def ordered(seq: Column, value: Column) -> Column:
    """Values that aren't null, in the order of seq (an aggregate)."""
    rows = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(seq.alias("seq"), value.alias("v")))))
    return F.transform(rows, lambda r: r["v"])


def distinct_in_order(seq: Column, value: Column) -> Column:
    """Distinct values in order of their first seq (an aggregate)."""
    return F.array_distinct(ordered(seq, value))


def merged_tags(items: Column) -> Column:
    """list<{type, value}> with one item for each value (trimmed, any case): the first, or in its place the first whose
    label says more than "other"."""
    none = F.array().cast(TAGGED)
    same = lambda x, y: F.lower(F.trim(x["value"])) == F.lower(F.trim(y["value"]))

    def add(acc: Column, x: Column) -> Column:
        better = lambda y: F.when(same(x, y) & (y["type"] == "other") & (x["type"] != "other"), x).otherwise(y)
        return F.when(F.exists(acc, lambda y: same(x, y)), F.transform(acc, better)).otherwise(F.array_append(acc, x))

    return F.aggregate(items, none, add)


def merge(
    rows: DataFrame, key: str, canonical: str, scalars: Sequence[str], lists: Sequence[str] = (), seq: Sequence[str] = ("_file", "_row"), source: str | None = "_source"
) -> DataFrame:
    """Entities from rows in the order of seq. Rows without a key stay entities of their own.

    Scalars become the list of distinct values seen (one: no conflict); lists (list<{type, value}>) merge by value.
    ``_key``, ``_first`` (order of the entity), ``_rows`` and ``_source_file`` come with them. Values are reduced to
    distinct ones a task before the shuffle, so a hot key moves its different values only.
    """
    order = F.struct(*seq)
    normalised = key_of(F.col(key).cast("string"), canonical)
    own_id = F.concat(F.lit("\u0000"), F.concat_ws("|", *[F.col(c).cast("string") for c in seq]))
    keyed = rows.withColumn("_key", F.when(normalised != "", normalised)).withColumn("_group", F.coalesce("_key", own_id)).withColumn("_seq", order)
    aggs = [F.min("_seq").alias("_first"), F.first("_key").alias("_key"), F.sum("_n").alias("_rows")]
    pre = keyed
    values = list(scalars) + ([source] if source else [])
    # one narrow row for each (entity, field, value) with its first position, then lists in that order
    parts = [F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value"), F.lit(None).cast("string").alias("type")) for c in values]
    flat = [_flat(c) for c in lists]
    whole = F.concat(F.array(*parts), *flat) if flat else F.array(*parts)
    exploded = pre.select("_group", "_key", "_seq", F.posexplode(whole).alias("_pos", "_item"))
    slim = exploded.where("_item.value is not null").groupBy("_group", "_item.field", "_item.value", "_item.type").agg(F.min(F.struct("_seq", "_pos")).alias("at"))
    rolled = slim.groupBy("_group").pivot("field", [*values, *lists]).agg(F.array_sort(F.collect_list(F.struct("at", "type", "value"))))
    heads = pre.withColumn("_n", F.lit(1)).groupBy("_group").agg(*aggs)
    out = heads.join(rolled, "_group", "left")
    texts = lambda c: F.array_distinct(F.transform(F.coalesce(F.col(f"`{c}`"), F.array().cast(_item_type(seq, rows))), lambda r: r["value"]))
    tags = lambda c: merged_tags(
        F.transform(F.coalesce(F.col(f"`{c}`"), F.array().cast(_item_type(seq, rows))), lambda r: F.struct(r["type"].alias("type"), r["value"].alias("value")))
    )
    chosen = [texts(c).alias(c) for c in scalars] + [tags(c).alias(c) for c in lists]
    shown = [texts(source).alias("_source_file")] if source else []
    return out.select("_key", "_first", "_rows", *chosen, *shown)


def _flat(field: str) -> Column:
    row = lambda x: F.struct(F.lit(field).alias("field"), x["value"].alias("value"), x["type"].alias("type"))
    return F.transform(F.coalesce(F.col(f"`{field}`"), F.array().cast(TAGGED)), row)


def _item_type(seq: Sequence[str], rows: DataFrame) -> str:
    kinds = ",".join(f"`{c}`:{rows.schema[c].dataType.simpleString()}" for c in seq)
    return f"array<struct<at:struct<_seq:struct<{kinds}>,_pos:int>,type:string,value:string>>"


def single(c: Column) -> Column:
    """A scalar field for display: its value, or all of a conflict joined by spaces."""
    return F.when(F.size(c) > 0, F.array_join(c, " "))


def conflicts(entities: DataFrame, scalars: Sequence[str]) -> DataFrame:
    """One row: for each scalar field the entities that hold more than one value."""
    return entities.agg(*[F.count_if(F.size(F.col(f"`{c}`")) > 1).alias(c) for c in scalars])


def counters(entities: DataFrame) -> DataFrame:
    """One row: raw rows, entities, and rows merged away."""
    return entities.agg(F.sum("_rows").alias("raw_records"), F.count("*").alias("entities"), (F.sum("_rows") - F.count("*")).alias("merged"))


def union_files(files: Sequence[tuple[str, DataFrame]], order: Sequence[str]) -> DataFrame:
    """All rows of all files with _file (its number), _row (a struct of its order columns) and _source (its short name)."""
    out = None
    for i, (name, df) in enumerate(files):
        own = df.withColumns({"_file": F.lit(i), "_row": F.struct(*order) if len(order) > 1 else F.col(order[0]), "_source": F.lit(name)})
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out
