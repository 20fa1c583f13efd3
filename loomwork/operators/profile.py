"""Column profiles: one aggregation over the unpivoted table, then a decision a column on the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.columns import MONEY, blank_to_null, half_up, is_date, number, round3, trimmed
from loomwork.functions.geo import is_point

#: Cells of a column that a kind is told from: the first so many populated ones in row order.
SAMPLE = 1500
MARGIN = 0.25
OS_TYPE = {
    "numeric": "double",
    "boolean": "boolean",
    "date": "date",
    "enum": "keyword",
    "identifier": "keyword",
    "free_text": "text",
    "geo_point": "geo_point",
}
#: Order of the scores; the first of equal ones wins.
SCORES = ("geo_point", "numeric", "boolean", "date", "free_text", "enum", "identifier")


@dataclass(frozen=True)
class Profile:
    name: str
    kind: str
    os_type: str | None
    fill_rate: float
    margin: float
    escalated: bool
    searchable: bool
    cardinality: int
    distinct_ratio: float
    avg_words: float
    note: str = ""


def cells(df: DataFrame, order: list[str], columns: list[str] | None = None) -> DataFrame:
    """(col, pos, seq, val): every cell of the columns, unpivoted; seq numbers the rows by the order columns.

    The order columns must tell rows apart; they stand in seq as a struct, so no global numbering is needed.
    """
    names = columns or [c for c in df.columns if c not in order]
    pairs = ", ".join(f"{i}, '{c}', cast(`{c}` as string)" for i, c in enumerate(names))
    return df.select(F.struct(*order).alias("seq"), F.expr(f"stack({len(names)}, {pairs}) as (pos, col, val)"))


def sampled(cell_rows: DataFrame, n: int = SAMPLE) -> DataFrame:
    """The first n populated cells of each column. Tasks keep at most n a column before the shuffle.

    Spark limits ranks before a shuffle only up to a threshold, which is raised to n where it is lower; it changes no
    result.
    """
    conf, key = cell_rows.sparkSession.conf, "spark.sql.optimizer.windowGroupLimitThreshold"
    if int(conf.get(key)) < n:
        conf.set(key, str(n))
    first = Window.partitionBy("pos").orderBy("seq")
    filled = cell_rows.withColumn("val", blank_to_null(F.col("val"))).where("val is not null")
    return filled.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n).drop("rank")


def fill(cell_rows: DataFrame) -> DataFrame:
    """(col, n, filled, fill_rate) over all rows."""
    counted = cell_rows.groupBy("pos", "col").agg(F.count("*").alias("n"), F.count(blank_to_null(F.col("val"))).alias("filled"))
    return counted.withColumn("fill_rate", round3(F.coalesce(F.try_divide("filled", "n"), F.lit(0.0))))


def measures(cell_rows: DataFrame, n: int = SAMPLE) -> DataFrame:
    """Per column, over its sample: populated, cardinality, ratios, lengths and the shares behind the scores."""
    v = F.col("val")
    words = F.size(F.filter(F.split(trimmed(v), r"\s+"), lambda w: w != ""))
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    return sampled(cell_rows, n).groupBy("pos", "col").agg(
        F.count("*").alias("populated"),
        F.count_distinct("val").alias("cardinality"),
        F.avg(F.length("val")).alias("avg_len"),
        F.avg(words).alias("avg_words"),
        share(number(v).isNotNull()).alias("numeric_share"),
        share(F.lower(v).isin("true", "false", "yes", "no")).alias("boolean_share"),
        share(is_date(v)).alias("date_share"),
        share(is_point(v)).alias("geo_share"),
    )


def scored(m: DataFrame) -> DataFrame:
    """The measures with a score for each kind."""
    zero = F.lit(0.0)
    ratio = F.col("cardinality") / F.col("populated")
    geo = F.when(F.col("geo_share") >= 0.7, F.col("geo_share")).otherwise(zero)
    boolean = F.when(F.col("cardinality") <= 3, F.col("boolean_share")).otherwise(zero)
    dated = (F.col("numeric_share") < 0.5) & (F.col("avg_words") <= 3) & (F.col("avg_len") >= 6)
    text = F.when(F.col("avg_words") >= 12, F.least(F.lit(1.0), F.col("avg_words") / 25)).otherwise(zero)
    out = m.withColumns(
        {
            "distinct_ratio": ratio,
            "geo_point": geo,
            "numeric": F.col("numeric_share"),
            "boolean": boolean,
            "date": F.when(dated, F.col("date_share")).otherwise(zero),
            "free_text": text,
        }
    )
    stringy = (F.col("numeric_share") < 0.5) & (F.col("free_text") == 0) & (F.col("geo_point") == 0)
    few = stringy & (F.col("cardinality") <= 50) & (F.col("distinct_ratio") <= 0.6)
    return out.withColumns(
        {"enum": F.when(few, 0.8).otherwise(zero), "identifier": F.when(stringy & ~few, 0.7).otherwise(zero)}
    )


def decided(scores: DataFrame) -> DataFrame:
    """The scores with kind, gap to the runner-up and whether the gap is too narrow (escalated)."""
    ranked = F.array(*[F.struct((-F.col(k)).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(SCORES)])
    order = F.array_sort(ranked)
    gap = order[1]["s"] - order[0]["s"]
    return scores.withColumns({"kind": order[0]["k"], "gap": gap, "escalated": gap < MARGIN})


def profile(df: DataFrame, order: list[str], columns: list[str] | None = None, n: int = SAMPLE) -> list[Profile]:
    """The catalog of a table; one row a column comes to the driver, which plans the next steps by it."""
    names = columns or [c for c in df.columns if c not in order]
    rows = cells(df, order, names)
    rates = {r["col"]: r for r in fill(rows).collect()}
    found = {r["col"]: r for r in decided(scored(measures(rows, n))).collect()}
    out = []
    for c in names:
        rate, r = rates[c]["fill_rate"] if c in rates else 0.0, found.get(c)
        if r is None:
            out.append(Profile(c, "empty", None, rate, 1.0, False, False, 0, 0.0, 0.0, "no values"))
            continue
        index = r["kind"] == "numeric" and r["distinct_ratio"] > 0.99 and c.lower().startswith("unnamed")
        out.append(
            Profile(
                c, r["kind"], OS_TYPE[r["kind"]], rate, round(r["gap"], 3), r["escalated"], not index, r["cardinality"],
                round(r["distinct_ratio"], 3), round(r["avg_words"], 1), "row index" if index else "",
            )
        )
    return out


def quality_counts(df: DataFrame, numeric: list[str]) -> DataFrame:
    """(coerced, quarantined) over the numeric columns: cells that became numbers by stripping, and cells that never did."""
    pairs = ", ".join(f"cast(`{c}` as string)" for c in numeric)
    v = blank_to_null(F.col("val"))
    x = number(v)
    stripped = F.regexp_replace(v, MONEY, "")
    long = df.select(F.expr(f"stack({len(numeric)}, {pairs}) as (val)"))
    return long.agg(
        F.count_if(v.isNotNull() & x.isNotNull() & (stripped != v)).alias("coerced"),
        F.count_if(v.isNotNull() & x.isNull()).alias("quarantined"),
    )


def voted_types(cell_rows: DataFrame) -> DataFrame:
    """A simpler inference by votes of nine tenths: boolean, integer, float, date, email, free_text, categorical, keyword."""
    v = F.trim(blank_to_null(F.col("val")))
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    m = cell_rows.where(v.isNotNull()).groupBy("pos", "col").agg(
        F.count_distinct(v).alias("distinct_values"),
        F.count("*").alias("n"),
        F.avg(F.length(v)).alias("avg_len"),
        share(F.lower(v).isin("true", "false", "yes", "no", "0", "1", "t", "f", "y", "n")).alias("b"),
        share(v.rlike(r"^[+-]?[0-9]+$")).alias("i"),
        share(number(v).isNotNull()).alias("f"),
        share(is_date(v)).alias("d"),
        share(v.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")).alias("e"),
    )
    ratio = F.col("distinct_values") / F.col("n")
    kind = (
        F.when((F.col("b") >= 0.9) & (F.col("distinct_values") <= 3), "boolean")
        .when(F.col("i") >= 0.9, "integer")
        .when(F.col("f") >= 0.9, "float")
        .when(F.col("d") >= 0.9, "date")
        .when(F.col("e") >= 0.9, "email")
        .when(F.col("avg_len") >= 25, "free_text")
        .when((F.col("distinct_values") <= 25) & (ratio <= 0.3), "categorical")
        .otherwise("keyword")
    )
    return m.select("col", "n", "distinct_values", half_up(F.col("avg_len"), 1).alias("avg_len"), kind.alias("type"))


def fitting(c: Column, type_: str) -> Column:
    """The cell if it fits a voted type, else null."""
    v = F.trim(blank_to_null(c))
    tests = {
        "boolean": F.lower(v).isin("true", "false", "yes", "no", "0", "1", "t", "f", "y", "n"),
        "integer": v.rlike(r"^[+-]?[0-9]+$"),
        "float": number(v).isNotNull(),
        "date": is_date(v),
        "email": v.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"),
    }
    return F.when(tests[type_], v) if type_ in tests else v
