"""Tables from CSV files and rows at hand: all cells text, blank cells null, rows in order."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions.columns import blank_to_null

DELIMITERS = (",", "\t", ";", "|")
ROW = "_row"


def sniff(line: str) -> str:
    """The delimiter that stands most often outside double quotes; the first of equal ones, a comma if there is none."""
    bare = re.sub(r'"[^"]*"?', "", line)
    best = max(DELIMITERS, key=lambda d: (bare.count(d), -DELIMITERS.index(d)))
    return best if bare.count(best) else ","


def sniff_file(spark: SparkSession, path: str) -> str:
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    return sniff(first[0]["value"]) if first else ","


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, multi_line: bool = True, ranked: bool = False) -> DataFrame:
    """A CSV file with a header; cells keep their text, blank ones are null, and ``_row`` orders the rows.

    With multi_line cells may hold line feeds, and a file is one task; without it large files are split. ``_row`` only
    rises, by partition; ranked makes it the rank by file name and place in the file, the same however files are split
    and dealt, at the cost of a shuffle by ranges.
    """
    df = (
        spark.read.option("header", True)
        .option("sep", delimiter or sniff_file(spark, path))
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("inferSchema", False)
        .option("mode", "PERMISSIVE")
        .csv(path)
    )
    if not ranked:
        return numbered(df)
    from loomwork.operators import match

    match.checkpoint_folder(spark)
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("id")).alias("_place")
    cells = [blank_to_null(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns]
    return match.numbered(df.select(*cells, place), "_place", ROW).drop("_place").withColumn(ROW, F.col(ROW) - 1)


def numbered(df: DataFrame) -> DataFrame:
    """All columns as text with blanks null, and _row. Ids rise within a file's partitions, and order is all they tell."""
    return df.select(*[blank_to_null(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns], F.monotonically_increasing_id().alias(ROW))


def from_rows(spark: SparkSession, headers: Sequence[str], rows: Iterable[Mapping[str, str | None]]) -> DataFrame:
    """Rows handed in directly; columns that a row lacks are null."""
    schema = T.StructType([T.StructField(h, T.StringType()) for h in headers] + [T.StructField(ROW, T.LongType())])
    data = [(*[None if r.get(h) is None or not str(r[h]).strip() else str(r[h]) for h in headers], i) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, schema)


def read_excel(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """A small spreadsheet through pandas on the driver, where an Excel reader is installed."""
    import pandas as pd

    found = pd.read_excel(path, sheet_name=sheet, dtype=str)
    return from_rows(spark, list(found.columns), found.where(found.notna(), None).to_dict("records"))


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines with a schema that is given, so that nothing is read twice."""
    return numbered(spark.read.schema(schema).json(path))


def read_jdbc(spark: SparkSession, options: Mapping[str, str], since: tuple[str, str] | None = None) -> DataFrame:
    """A table over JDBC; since: (column, value) after which rows are new (incremental reads)."""
    df = spark.read.format("jdbc").options(**options).load()
    return df.where(F.col(since[0]) > F.lit(since[1])) if since else df


def confined(root: str, name: str) -> Path:
    """The path of a file under root; anything outside raises."""
    top = Path(root).resolve()
    path = (top / name).resolve()
    if not path.is_relative_to(top) or not path.is_file():
        raise ValueError(f"no file {name}")
    return path


def samples(root: str, folders: Sequence[str] = (".", "samples", "collections")) -> list[str]:
    """CSV files under root and its known folders, sorted in each."""
    top = Path(root)
    return [str(p.relative_to(top)) for f in folders for p in sorted((top / f).glob("*.csv"))]


def short_name(path: str) -> str:
    return re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])


def first_rows(df: DataFrame, order: Sequence[str], n: int = 5000) -> DataFrame:
    """The first n rows: a limit for previews, off unless asked for."""
    return df.orderBy(*order).limit(n)


def random_rows(df: DataFrame, share: float = 0.05, least: int = 50, seed: int = 1) -> DataFrame:
    """A uniform sample: a share of the rows, or at least so many."""
    n = df.count()
    return df.orderBy(F.rand(seed)).limit(max(least, round(n * share)))
