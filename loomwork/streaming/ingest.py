"""Entities from a stream of rows: each micro-batch is merged into the entity table (an extension, not parity).

The table keeps one row for each (key, field, value) with its first position, so merging a batch is an aggregation of
both; a batch that is run again gives the same table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions.columns import key_of


def facts(rows: DataFrame, key: str, canonical: str, fields: Sequence[str], seq: str) -> DataFrame:
    """(_key, field, value, at): the distinct values of each key with their first position."""
    own = rows.withColumn("_key", key_of(F.col(key).cast("string"), canonical)).where("_key <> ''")
    pairs = ", ".join(f"'{c}', cast(`{c}` as string)" for c in fields)
    long = own.select("_key", F.col(seq).alias("at"), F.expr(f"stack({len(fields)}, {pairs}) as (field, value)"))
    return long.where("value is not null").groupBy("_key", "field", "value").agg(F.min("at").alias("at"))


def folded(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).groupBy("_key", "field", "value").agg(F.min("at").alias("at"))


def entities(table: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(_key, fields): each field the list of its values in order."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda r: r["value"])
    return table.groupBy("_key").pivot("field", list(fields)).agg(rows)


def start(stream: DataFrame, folder: str, key: str, canonical: str, fields: Sequence[str], seq: str, trigger: dict | None = None):
    """Run the stream into ``folder``/v<batch>; the latest version is the table. Returns the streaming query."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = facts(batch, key, canonical, fields, seq)
        before = latest(spark, folder, number - 1)
        whole = new if before is None else folded(before, new)
        whole.write.mode("overwrite").parquet(f"{folder}/v{number}")

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def latest(spark, folder: str, upto: int) -> DataFrame | None:
    """The table of the last batch up to a number."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for n in range(upto, -1, -1):
        if system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v{n}/_SUCCESS")):
            return spark.read.parquet(f"{folder}/v{n}")
    return None
