"""Shared plumbing of the llm operators: durable staging tables and Arrow batch sizes."""

from __future__ import annotations

import contextlib
import ctypes

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.sources.folders import new_folder, shared_folder  # noqa: F401

#: Rows of an Arrow batch that carries whole texts; keeps a Python worker's batch small even when texts are long.
TEXT_ROWS = 64
#: Rows of an Arrow batch that carries numbers only.
NARROW_ROWS = 20_000


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows while the block runs."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stage(df: DataFrame, tag: str, rows: int | None = None, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, so a lost executor costs no recomputation.

    Tables of hashes and numbers are staged with the codec PLAIN: they hardly shrink, and a codec's buffers lie outside
    the heap, where many small files add up.
    """
    spark = df.sparkSession
    path = new_folder(spark, tag)
    with arrow_rows(spark, rows) if rows else contextlib.nullcontext():
        df.write.option("compression", codec).parquet(path)  # snappy would hold still more memory outside the heap
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


#: The codec of tables of hashes and numbers.
PLAIN = "uncompressed"


def discard(df: DataFrame) -> None:
    """Remove a staged table that nothing reads any more."""
    path = getattr(df, "staged_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def keep_freed_memory() -> None:
    """This process keeps up to 64 MB that it has freed, for its next arrays.

    By default glibc returns a large array's memory to the system at once, and the next array gets its pages one by one.
    """
    with contextlib.suppress(OSError, AttributeError):  # another C library
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex64(column) -> "F.Column":
    """A signed long as 16 lower-case hex digits of its bits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def shielded(df: DataFrame, names: list[str]) -> DataFrame:
    """df's columns under names that nothing clashes with (_own_0, _own_1, ...), and copies of the named ones."""
    own = [F.col(f"`{c}`").alias(f"_own_{i}") for i, c in enumerate(df.columns)]
    return df.select(*own, *[F.col(f"`{c}`").alias(c) for c in names])


def restored(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that ``shielded`` put away, as they were."""
    return df.select(*[F.col(f"_own_{i}").alias(c) for i, c in enumerate(columns)])
