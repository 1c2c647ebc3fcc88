"""Tables clustered by trajectory: replay and window reads of what is stored need no shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import new_path

BUCKETS = 16


def write_clustered(rows: DataFrame, name: str, buckets: int = BUCKETS, by: str = "trajectory_id", order: tuple[str, ...] = ("slot",), split: str = "split") -> str:
    """Writes a table by split, in `buckets` of a trajectory each sorted by time, and returns its name.

    Rows are dealt out as the buckets are, so a bucket of a split is one file, whose row groups have narrow ranges of time.
    """
    table = f"{name}_{uuid.uuid4().hex}"
    columns = [c for c in rows.columns if c != split]
    ready = rows.select(*columns, split).repartition(buckets, by)
    ready.write.partitionBy(split).bucketBy(buckets, by).sortBy(*order).option("path", new_path(rows.sparkSession, name)).format("parquet").saveAsTable(table)
    return table


def rewrite_split(rows: DataFrame, table: str, value: str, buckets: int = BUCKETS, by: str = "trajectory_id", split: str = "split") -> None:
    """Replaces one split of a table by the rows of that split; to do it again changes nothing, and other splits are not touched."""
    spark = rows.sparkSession
    columns = [c for c in spark.table(table).columns if c != split]
    own = rows.where(F.col(split) == value).select(*columns, split).repartition(buckets, by)
    name = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(name)
    spark.conf.set(name, "dynamic")  # an option of the writer does not reach a table
    try:
        own.write.mode("overwrite").insertInto(table)
    finally:
        spark.conf.set(name, before)


def read_clustered(spark: SparkSession, table: str, splits: tuple[str, ...] = (), first: int | None = None, last: int | None = None, time: str = "slot", split: str = "split") -> DataFrame:
    """Rows of the splits and the window of time; both reach the scan, which skips other splits' files and row groups of other times."""
    rows = spark.table(table)
    if splits:
        rows = rows.where(F.col(split).isin(*splits))
    if first is not None:
        rows = rows.where(F.col(time) >= first)
    if last is not None:
        rows = rows.where(F.col(time) <= last)
    return rows
