"""Where results go: tables in place of an index, bulk NDJSON, CSV and JSON exports, and schema documents."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators.shapes import Shape

def _vector(own: dict) -> dict:
    n = own.get("dimension")
    numbers = {"type": "array", "items": {"type": "number"}}
    return numbers if n is None else {**numbers, "minItems": n, "maxItems": n, "description": f"{n}-dim embedding vector"}


#: How an index type is written in JSON Schema: the names are fixed values, and types that aren't here are strings.
SCHEMAS = {
    **{t: lambda own: {"type": "number"} for t in ("double", "float")},
    **{t: lambda own: {"type": "integer"} for t in ("long", "integer")},
    "boolean": lambda own: {"type": "boolean"},
    "date": lambda own: {"type": "string", "format": "date"},
    "knn_vector": _vector,
}


def _schema(own: dict) -> dict:
    """The JSON Schema of one entry of a mapping; an entry without a type is an object of its properties."""
    if "type" not in own and (inner := own.get("properties")) is not None:
        return {"type": "object", "properties": dict(zip(inner, map(_schema, inner.values())))}
    return SCHEMAS.get(own.get("type"), lambda _: {"type": "string"})(own)


TAG = {"type": "keyword"}


def table_name(name: str, prefix: str = "col_") -> str:
    return prefix + re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")[:40]


def mapping(shapes: Sequence[Shape]) -> dict:
    """The flat mapping of a dataset: each canonical's type; a list of {type, value} is an object of both."""

    def one(s: Shape) -> dict:
        own = {"type": s.os_type or "keyword"}
        return {"properties": {"type": TAG, "value": own}} if s.tagged else own

    return {"mappings": {"properties": {s.canonical: one(s) for s in shapes}}}


def collection_mapping(fields: Mapping[str, tuple[str, str]]) -> dict:
    """The mapping of a collection from canonical to (type, cardinality): lists are nested, sources and tags come along."""
    out = {
        name: {"type": "nested", "properties": {"type": TAG, "value": {"type": kind}}} if cardinality == "array" else {"type": kind}
        for name, (kind, cardinality) in fields.items()
    }
    return {"mappings": {"properties": {**out, "_source_file": TAG, "_tags": TAG}}}


def json_schema(found: dict, lists: frozenset[str], title: str) -> dict:
    """JSON Schema 2020-12 of a mapping; fields in ``lists`` are arrays of their type."""
    listed = {True: lambda s: {"type": "array", "items": s}, False: lambda s: s}
    fields = found.get("mappings", {}).get("properties", {})
    shape = {"type": "object", "properties": {name: listed[name in lists](_schema(own)) for name, own in fields.items()}, "additionalProperties": False}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": title, **shape}


def vector_mapping(field: str, dimension: int) -> dict:
    """The mapping of a vector field for an external index. Spark itself scans vectors exactly."""
    method = {"name": "hnsw", "engine": "lucene", "space_type": "cosinesimil"}
    return {field: {"type": "knn_vector", "dimension": dimension, "method": method}}


def write_index(df: DataFrame, name: str, path: str | None = None) -> int:
    """The table in place of an index of that name, replaced as a whole; its rows. path: where its files go, if not into
    the warehouse."""
    out = df.write.mode("overwrite")
    (out if path is None else out.option("path", path)).saveAsTable(name)
    return df.sparkSession.table(name).count()


def delete_index(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")


def list_indexes(spark: SparkSession, pattern: str) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(pattern=pattern))


def orphans(spark: SparkSession, live: Sequence[str]) -> list[str]:
    """Tables of collections that are no more, and all of single datasets."""
    return sorted((set(list_indexes(spark, "col_*")) - set(live)) | set(list_indexes(spark, "kt_*")))


def delete_orphans(spark: SparkSession, live: Sequence[str]) -> list[str]:
    found = orphans(spark, live)
    for name in found:
        delete_index(spark, name)
    return found


def bulk_lines(df: DataFrame, index: str, key: Column) -> DataFrame:
    """One text column ``value``: an action line and a document line for each row, nulls left out of documents."""
    action = F.to_json(F.struct(F.struct(F.lit(index).alias("_index"), key.cast("string").alias("_id")).alias("index")))
    return df.select(F.concat_ws("\n", action, F.to_json(F.struct(*df.columns))).alias("value"))


def write_bulk(df: DataFrame, index: str, key: Column, path: str) -> None:
    bulk_lines(df, index, key).write.mode("overwrite").text(path)


def export(df: DataFrame, path: str, form: str = "json") -> None:
    """CSV (lists as JSON text) or JSON lines."""
    if form == "csv":
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c, t in df.dtypes]
        df.select(*flat).write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").json(path)


def save_spec(spec: dict, path: str) -> None:
    Path(path).write_text(json.dumps(spec, indent=2, sort_keys=True))


def load_spec(path: str) -> dict:
    return json.loads(Path(path).read_text())
