"""Two datasets matched, or several linked, by a canonical field that they share."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators import match
from loomwork.plans.dataset import Dataset


@dataclass
class Matched:
    key: str
    pairs: DataFrame  # a_seq, b_seq, sim
    report: DataFrame  # one row
    shown: DataFrame  # the report's list of pairs with the fields to show


def _text(d: Dataset, field: str) -> Column:
    s = next(x for x in d.shapes if x.canonical == field)
    c = F.col(f"`{field}`")
    if s.cardinality == "array":
        return F.array_join(F.transform(c, lambda x: (x["value"] if s.tagged else x).cast("string")), " ")
    return c.cast("string")


def _texts(d: Dataset, fields: Sequence[str]) -> DataFrame:
    """The fields as text, with the row's number ``_row``."""
    return d.documents().select(F.col(d.order[0]).alias("_row"), *[_text(d, f).alias(f) for f in fields])


def shared(datasets: Sequence[Dataset]) -> list[tuple[str, str]]:
    """(field, kind) of the fields that all datasets have and that aren't free text, in the first one's order."""
    names = [{s.canonical for s in d.shapes} for d in datasets]
    return [(s.canonical, s.kind) for s in datasets[0].shapes if s.kind != "free_text" and all(s.canonical in n for n in names)]


def candidates(a: Dataset, b: Dataset) -> DataFrame:
    """Fields to match by, the best first."""
    fields = shared([a, b])
    return match.join_keys(_texts(a, [f for f, _ in fields]), _texts(b, [f for f, _ in fields]), fields)


def pair_up(a: Dataset, b: Dataset, key: str | None = None, threshold: float = match.THRESHOLD) -> Matched:
    """Match a's rows to b's by a field; without one by the best candidate."""
    if key is None:
        best = candidates(a, b).first()
        if best is None:
            raise ValueError("no shared field")
        key = best["field"]
    ka = match.keyed(_texts(a, [key]), F.col(f"`{key}`"), key, "_row")
    kb = match.keyed(_texts(b, [key]), F.col(f"`{key}`"), key, "_row")
    pairs = match.best_matches(ka, kb, threshold)
    report = match.report(ka, b.df.count(), pairs, a.df.count())
    shown = match.shown(pairs)
    for d, side in ((a, "a"), (b, "b")):
        fields = match.displayed([s.canonical for s in d.shapes])
        shown = shown.join(_texts(d, fields).select(F.col("_row").alias(f"{side}_seq"), F.struct(*fields).alias(side) if fields else F.lit(None).alias(side)), f"{side}_seq", "left")
    return Matched(key, pairs, report, shown)


def link_keys(datasets: Sequence[Dataset]) -> DataFrame:
    """(field, uniqueness): the mean uniqueness of each shared field over all datasets, the best first."""
    fields = shared(datasets)
    rows = None
    for d in datasets:
        t = _texts(d, [f for f, _ in fields])
        own = match.join_keys(t, t, fields).select("field", "uniqueness")
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("field").agg(F.avg("uniqueness").alias("uniqueness")).orderBy(F.desc("uniqueness"), "field")


def link(datasets: Sequence[tuple[str, Dataset]], key: str, threshold: float = match.THRESHOLD) -> DataFrame:
    """Every row of every dataset that has a key, with its entity: seq is unique over all datasets."""
    match.checkpoint_folder(datasets[0][1].df.sparkSession)
    tables = []
    for n, (name, d) in enumerate(datasets):
        rows = _texts(d, [key]).withColumn("seq", F.col("_row") + F.lit(n) * F.lit(1 << 52))
        tables.append((name, match.keyed(rows, F.col(f"`{key}`"), key, "seq")))
    return match.linked(match.union_rows(tables), threshold)


def flattened(linked: DataFrame) -> DataFrame:
    """The entities as one table of texts, to write in place of an index: entity_id, key, sources, size."""
    own = linked.groupBy("entity_id", "size").agg(F.min(F.struct("seq", "k")).alias("f"), F.array_sort(F.collect_set("source")).alias("s"))
    return own.select("entity_id", F.col("f.k").alias("key"), F.array_join("s", " ").alias("sources"), F.col("size").cast("string").alias("size"))
