"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialize, new_path, read_table, shared_dir

__all__ = ["batches_of", "bounded_sample", "held_out", "materialize", "new_path", "read_table", "shared_dir"]


BROADCAST_GROUPS = 100_000  # counts, 30 bytes each


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents that are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def bounded_sample(rows: DataFrame, by: str, picked_by: list[str], bound: int) -> DataFrame:
    """About `bound` rows of each value of `by` (all, if fewer), picked by a hash of `picked_by` in the scan.

    Only the counts by value are aggregated. The bound holds for the expected size: a row is kept if its
    hash is below bound / count of its group.
    """
    counts = materialize(rows.groupBy(by).agg(F.count("*").alias("_n")), "sample-counts")
    if counts.count() <= BROADCAST_GROUPS:
        counts = F.broadcast(counts)
    spread = 1 << 30
    return rows.join(counts, by).where(F.pmod(F.xxhash64(F.lit(7), *picked_by), F.lit(spread)) < F.lit(float(spread) * bound) / F.col("_n")).drop("_n")


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside send Python workers this many rows at a time, so that long rows stay within memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
