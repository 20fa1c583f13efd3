"""Which field to partition an index by, and how to deal its values to balanced buckets."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions.columns import half_up, round3

LEAST_VALUES, MOST_DISTINCT, MOST_TOP = 8, 0.5, 0.6
ROWS_A_BUCKET, MOST_BUCKETS = 5000, 8
#: Values of a field that are dealt out on the driver; a field with more is none to partition by (near-unique).
VALUES_ON_DRIVER = 1_000_000
#: Fields whose values are known to change.
MUTABLE = ("plan", "is_active", "status")


def histogram(df: DataFrame, field: str) -> DataFrame:
    """(value, n) of the values that aren't blank."""
    v = F.col(f"`{field}`").cast("string")
    return df.where(F.trim(v) != "").groupBy(v.alias("value")).agg(F.count("*").alias("n"))


def skew(counts: DataFrame) -> DataFrame:
    """One row: cardinality, populated, top1_share, entropy (normalised to 1 for equal counts)."""
    totals = counts.agg(F.count("*").alias("cardinality"), F.sum("n").alias("populated"), F.max("n").alias("top"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    h = F.log("populated") - F.col("nlogn") / F.col("populated")  # -sum(p ln p) from sums that merge
    entropy = F.when(F.col("cardinality") > 1, F.try_divide(h, F.log("cardinality"))).otherwise(0.0)
    return totals.select("cardinality", "populated", round3(F.try_divide("top", "populated")).alias("top1_share"), round3(entropy).alias("entropy"))


def verdict(counts: DataFrame, field: str) -> DataFrame:
    """``skew`` with distinct_ratio and verdict: FACET_ONLY, PARTITION_KEY or PARTITION_KEY_SKEWED."""
    s = skew(counts)
    ratio = F.try_divide("cardinality", F.greatest("populated", F.lit(1)))
    facet = (F.col("cardinality") < LEAST_VALUES) | (ratio > MOST_DISTINCT) | F.lit(field in MUTABLE)
    skewed = F.coalesce(F.col("top1_share"), F.lit(0.0)) > MOST_TOP
    label = F.when(facet, "FACET_ONLY").when(skewed, "PARTITION_KEY_SKEWED").otherwise("PARTITION_KEY")
    return s.select(F.lit(field).alias("field"), "*", half_up(ratio, 4).alias("distinct_ratio"), label.alias("verdict"))


def bucket_count(cardinality: int, populated: int) -> int:
    return max(2, min(MOST_BUCKETS, cardinality, round(populated / ROWS_A_BUCKET) or 2))


def deal(counts: list[tuple[str, int]], buckets: int) -> dict[str, int]:
    """Largest first into the lightest bucket; equal counts by value, equal buckets by number."""
    heap = [(0, b) for b in range(buckets)]
    out = {}
    for value, n in sorted(counts, key=lambda x: (-x[1], x[0])):
        rows, b = heapq.heappop(heap)
        out[value] = b
        heapq.heappush(heap, (rows + n, b))
    return out


def buckets(df: DataFrame, field: str) -> DataFrame:
    """(value, n, bucket): the plan of a field. Its histogram comes to the driver, at most VALUES_ON_DRIVER rows."""
    counts = histogram(df, field)
    s = skew(counts).first()
    if s["cardinality"] > VALUES_ON_DRIVER:
        raise ValueError(f"{field} has {s['cardinality']} values; too many to partition by")
    rows = [(r["value"], r["n"]) for r in counts.collect()]
    plan = deal(rows, bucket_count(s["cardinality"], s["populated"] or 0))
    return df.sparkSession.createDataFrame([(v, n, plan[v]) for v, n in rows], "value string, n long, bucket int")


def balance(dealt: DataFrame) -> DataFrame:
    """(bucket, rows, n_values) and the ratio of the largest to the smallest bucket."""
    own = dealt.groupBy("bucket").agg(F.sum("n").alias("rows"), F.count("*").alias("n_values"))
    ends = own.agg(half_up(F.max("rows") / F.greatest(F.min("rows"), F.lit(1)), 2).alias("balance_ratio"))
    return own.crossJoin(F.broadcast(ends))  # one row


def write_bucketed(df: DataFrame, field: str, path: str) -> None:
    """The table partitioned by the plan's bucket, so a filter on the field's bucket reads that part only."""
    plan = buckets(df, field).select(F.col("value").alias(field), "bucket")
    joined = df.join(F.broadcast(plan), field, "left").withColumn("bucket", F.coalesce("bucket", F.lit(-1)))
    joined.write.mode("overwrite").partitionBy("bucket").parquet(path)
