"""Facet counts, segment counts, paging and display columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.shapes import Shape

MOST_VALUES = 40
#: Fields shown first, of a dataset and of a collection.
DATASET_ORDER = (
    "full_name", "first_name", "last_name", "company", "email", "phone", "city", "country", "job_title", "amount", "rating", "date",
)
COLLECTION_ORDER = ("company", "email", "phone", "country", "city", "job_title", "amount", "date", "lead_source")


def counts(df: DataFrame, fields: Sequence[str], seq: str, arrays: Sequence[str] = ()) -> DataFrame:
    """(field, value, n, first): how often each value stands, and where first; all fields in one pass.

    Lists count each member. Values that are null are left out.
    """
    item = lambda c, x: F.struct(F.lit(c).alias("field"), x.cast("string").alias("value"))
    single = F.array(*[item(c, F.col(f"`{c}`")) for c in fields if c not in arrays])
    members = lambda c: F.transform(F.coalesce(F.col(f"`{c}`"), F.array().cast("array<string>")), lambda x: item(c, x))
    lists = [members(c) for c in arrays]
    whole = F.concat(single, *lists) if lists else single
    rows = df.select(F.col(seq).alias("seq"), F.explode(whole).alias("i")).where("i.value is not null")
    return rows.groupBy("i.field", "i.value").agg(F.count("*").alias("n"), F.min("seq").alias("first"))


def facets(counted: DataFrame, most: int = MOST_VALUES) -> DataFrame:
    """(field, distinct_values, value, n, rank): values only of fields with at most ``most``; ties in order of first sight."""
    sizes = counted.groupBy("field").agg(F.count("*").alias("distinct_values"))
    listed = counted.join(sizes, "field").where(F.col("distinct_values") <= most)
    order = Window.partitionBy("field").orderBy(F.desc("n"), "first")  # at most ``most`` rows a field
    ranked = listed.withColumn("rank", F.row_number().over(order)).select("field", "value", "n", "rank")
    return sizes.join(ranked, "field", "left").select("field", "distinct_values", "value", "n", "rank")


def most_common(counted: DataFrame, top: int = MOST_VALUES) -> DataFrame:
    """(field, value, n, rank) of the top values of each field."""
    order = Window.partitionBy("field").orderBy(F.desc("n"), "first")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).drop("first")


def segments(df: DataFrame, named: Mapping[str, Column]) -> DataFrame:
    """(segment, n) of all segments in one scan."""
    row = df.agg(*[F.count_if(p).alias(f"s{i}") for i, p in enumerate(named.values())])
    stack = ", ".join(f"'{name}', s{i}" for i, name in enumerate(named))
    return row.select(F.expr(f"stack({len(named)}, {stack}) as (segment, n)"))


def filled(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, n): rows where a field isn't null."""
    row = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in fields])
    stack = ", ".join(f"'{c}', `{c}`" for c in fields)
    return row.select(F.expr(f"stack({len(fields)}, {stack}) as (field, n)"))


def page(df: DataFrame, order: Sequence[Column | str], number: int = 1, size: int = 30) -> DataFrame:
    """A page of a total order; numbers and sizes under 1 count as 1."""
    number, size = max(1, number), max(1, size)
    return df.orderBy(*order).offset(min((number - 1) * size, 2**31 - 1 - size)).limit(size)


def dataset_columns(shapes: Sequence[Shape], most: int = 8) -> list[str]:
    """Fields to show of a dataset: the usual ones, then others up to ``most``; never free text."""
    names = [s.canonical for s in shapes if s.kind != "free_text"]
    first = [c for c in DATASET_ORDER if c in names]
    return (first + sorted(c for c in names if c not in first))[:most]


def collection_columns(fields: Sequence[str]) -> list[str]:
    first = [c for c in COLLECTION_ORDER if c in fields]
    return ["_source_file", "name", *first, *sorted(c for c in fields if c not in first)]


def row_name(full: Column, first: Column, last: Column) -> Column:
    """full_name, or first and last name."""
    part = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(part(full), F.concat_ws(" ", part(first), part(last)))


def points(df: DataFrame, field: Column, labels: Sequence[Column], seq: str, most: int = 5000) -> DataFrame:
    """(seq, lat, lng, label) of rows with a point, up to ``most``."""
    from loomwork.functions.geo import point

    own = df.select(F.col(seq).alias("seq"), point(field).alias("p"), F.coalesce(*labels, field).alias("label"))
    return own.where("p is not null").orderBy("seq").limit(most).select("seq", "p.lat", "p.lng", "label")
