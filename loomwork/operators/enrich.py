"""Lookup joins: fields of a reference fill what a table lacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.columns import is_blank, key_of


def reference(ref: DataFrame, key: Column, canonical: str, fields: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """(_nk, fields): the first row of the reference for each normalised key, by seq. Reduced before the shuffle."""
    own = ref.withColumn("_nk", key_of(key.cast("string"), canonical)).where("_nk <> ''")
    picked = own.groupBy("_nk").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in fields]), F.struct(*seq)).alias("_r"))
    return picked.select("_nk", *[F.col(f"_r.`{c}`").alias(f"_ref_{c}") for c in fields])


def enrich(df: DataFrame, key: Column, canonical: str, ref: DataFrame, fields: Sequence[str]) -> DataFrame:
    """df with the fields of ``reference`` where its own are null; names starting with _ and the key itself are left out.

    A left join on the normalised key; Spark broadcasts the reference if its size allows. _gained tells whether a row
    got anything.
    """
    fields = [c for c in fields if not c.startswith("_")]
    joined = df.withColumn("_nk", key_of(key.cast("string"), canonical)).join(ref, "_nk", "left")
    present = set(df.columns)
    old = lambda c: F.col(f"`{c}`") if c in present else F.lit(None)
    gained = F.lit(False)
    for c in fields:
        gained = gained | (old(c).isNull() & F.col(f"_ref_{c}").isNotNull())
    kept = [F.col(f"`{c}`") for c in df.columns if c not in fields]
    new = [F.coalesce(old(c).cast(ref.schema[f"_ref_{c}"].dataType), F.col(f"_ref_{c}")).alias(c) for c in fields]
    return joined.select(*kept, *new, gained.alias("_gained"))


def chain(df: DataFrame, steps: Sequence[tuple[Column, str, DataFrame, Sequence[str]]]) -> DataFrame:
    """Enrichments in order; a later one sees what earlier ones attached."""
    for key, canonical, ref, fields in steps:
        df = enrich(df, key, canonical, ref, fields).drop("_gained")
    return df


def has_value(c: Column) -> Column:
    return ~is_blank(c.cast("string"))
