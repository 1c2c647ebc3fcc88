"""Compacted, hive-partitioned trees of market files and their state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import dims
from tidemark.functions.specs import Spec
from tidemark.session import materialize, new_path

PARTS = ("exchange", "stream", "symbol", "day")
STATE_SCHEMA = "days MAP<STRING, STRUCT<status: STRING>>, partitions MAP<STRING, STRUCT<status: STRING, rows: BIGINT>>"
# The tree's folders; data files are named data.* or, written by Spark, part-*. State and metadata files are not.
FOLDERS = ("exchange", "stream", "symbol", "date")
PARQUET_FILES, LINE_FILES = "{data,part-}*.parquet", "{data,part-}*.{json,jsonl,ndjson}{,.gz}"


def day_of(us):  # noqa: ANN001, ANN201
    """Calendar day as yyyymmdd of microseconds since 2024-01-01."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.floor(us / 86_400_000_000).cast("int"))
    return (F.year(day) * 10_000 + F.month(day) * 100 + F.day(day)).cast("int")


def partition_id(exchange, stream, symbol, day):  # noqa: ANN001, ANN201
    """Column: exchange/stream/lower-case symbol/yyyymmdd."""
    return F.concat_ws("/", exchange, stream, F.lower(symbol), day.cast("string"))


def write_state(state: DataFrame, name: str) -> str:
    """Writes rows (exchange, stream, symbol, day, status, rows) as state documents, one for each exchange and day, so that none grows with the history."""
    path = new_path(state.sparkSession, name)
    entry = F.struct(partition_id(F.col("exchange"), F.col("stream"), F.col("symbol"), F.col("day")), F.struct("status", "rows"))
    documents = state.groupBy("exchange", "day").agg(F.map_from_entries(F.collect_list(entry)).alias("partitions"), F.min("status").alias("status"))
    days = F.create_map(F.col("day").cast("string"), F.struct("status")).alias("days")
    documents.select(F.to_json(F.struct(days, "partitions")).alias("value")).write.text(path)
    return path


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """State documents (`value`: JSON), one document a line."""
    return spark.read.text(path)


def parse_state(documents: DataFrame) -> DataFrame:
    """id, status, rows from state documents, one row per partition; a malformed document has none."""
    parsed = documents.select(F.from_json("value", STATE_SCHEMA).alias("s"))
    return parsed.select(F.explode("s.partitions").alias("id", "p")).select("id", F.coalesce("p.status", F.lit("unknown")).alias("status"), "p.rows")


def parse_days(documents: DataFrame) -> DataFrame:
    """day, status of the days of state documents."""
    parsed = documents.select(F.from_json("value", STATE_SCHEMA).alias("s"))
    return parsed.select(F.explode("s.days").alias("day", "d")).select("day", F.coalesce("d.status", F.lit("unknown")).alias("status"))


def well_formed(state: DataFrame) -> DataFrame:
    """exchange, stream, symbol (lower-case), day (text), status of ids with four parts."""
    parts = F.split("id", "/")
    return state.where(F.size(parts) == 4).select(*(F.get(parts, i).alias(c) for i, c in enumerate(PARTS)), "status")


def select_partitions(state: DataFrame, spec: Spec, first_day: int, last_day: int) -> DataFrame:
    """Successful partitions of the contract in the days; malformed ids are dropped. Drives partition pruning."""
    spark = state.sparkSession
    parts = F.split("id", "/")
    day = F.get(parts, 3)
    named = state.where((F.size(parts) == 4) & day.rlike("^[0-9]{8}$") & (F.col("status") == "success")).select(
        F.get(parts, 0).alias("exchange"), F.get(parts, 1).alias("stream"), F.get(parts, 2).alias("lower_symbol"), day.cast("int").alias("day")
    )
    allowed = dims.availability(spark, spec).where("available").select("exchange", "stream")
    symbols = dims.symbols(spark, spec).select("symbol", F.lower("symbol").alias("lower_symbol"))
    kept = named.where(F.col("day").between(first_day, last_day)).join(F.broadcast(allowed), ["exchange", "stream"], "left_semi")
    return kept.join(F.broadcast(symbols), "lower_symbol").select("exchange", "stream", "symbol", "day")


def summarize(state: DataFrame, days: DataFrame, top: int = 20, sample: int = 10) -> DataFrame:
    """kind, key, n of partitions: by status, exchange, stream and (the `top`) symbols; the first and last `sample` days, of all and of
    the successful ones; days by status; how many partitions there are and are well formed, and the successful days."""
    parts = well_formed(state)
    stacked = parts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in ("status", "exchange", "stream", "symbol", "day")))).alias("x"))
    counts = stacked.groupBy("x.kind", "x.key").agg(F.count("*").alias("n"))
    most = counts.where("kind = 'symbol'").orderBy(F.desc("n"), "key").limit(top)
    good = parts.where("status = 'success'").groupBy(F.col("day").alias("key")).agg(F.count("*").alias("n"))
    every = counts.where("kind = 'day'").select("key", "n")
    ends = [
        rows.orderBy(order).limit(sample).select(F.lit(kind).alias("kind"), "key", "n")
        for kind, rows, order in (("days_first", every, F.asc("key")), ("days_last", every, F.desc("key")), ("successful_first", good, F.asc("key")), ("successful_last", good, F.desc("key")))
    ]
    single = lambda kind, rows: rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit("").alias("key"), "n")
    by_day = days.groupBy(F.col("status").alias("key")).agg(F.count("*").alias("n")).select(F.lit("day_status").alias("kind"), "key", "n")
    found = counts.where("kind NOT IN ('symbol', 'day')").unionByName(most).unionByName(by_day)
    for part in (*ends, single("partitions", state), single("matched", parts), single("successful_days", good)):
        found = found.unionByName(part)
    return found


def listed(spark: SparkSession, path: str) -> DataFrame:
    """exchange, stream, symbol (upper-case), day of the partitions below a tree that have a data file; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{data,part-}*").load(path).select("path")
    part = lambda folder: F.regexp_extract("path", rf"/{folder}=([^/]+)/", 1)
    return files.select(part("exchange").alias("exchange"), part("stream").alias("stream"), F.upper(part("symbol")).alias("symbol"), part("date").cast("int").alias("day")).distinct()


def missing(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Selected partitions that no file stands for."""
    return wanted.join(present.select(*PARTS), list(PARTS), "left_anti")


def require_any(found: DataFrame) -> DataFrame:
    """The same rows; an error if there is none."""
    if found.isEmpty():
        raise ValueError("no readable partition")
    return found


def write_ndjson(events: DataFrame, name: str) -> str:
    path = new_path(events.sparkSession, name)
    events.write.option("compression", "gzip").json(path)
    return path


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with an explicit schema; blank lines are skipped by the reader."""
    return spark.read.schema(schema).json(path)


def write_tree(events: DataFrame, name: str) -> str:
    """exchange= / stream= / symbol= / date= folders of one tree: even days as Parquet, odd ones as JSON lines."""
    path = new_path(events.sparkSession, name)
    dated = events.withColumn("date", day_of(F.col("us"))).withColumn("symbol", F.lower("symbol"))
    dated.where("date % 2 = 0").write.partitionBy(*FOLDERS).parquet(path)
    dated.where("date % 2 = 1").write.mode("append").partitionBy(*FOLDERS).option("compression", "gzip").json(path)
    return path


def read_tree(spark: SparkSession, path: str, schema: T.StructType, spec: Spec) -> DataFrame:
    """All data files of a tree with one schema; partition columns come from the folders and prune the scan.

    Parquet and JSON lines may lie side by side; state and metadata files are no data files and are not read.
    """
    whole = T.StructType([*schema.fields, T.StructField("date", T.IntegerType())])
    files = lambda names: spark.read.schema(whole).option("basePath", path).option("pathGlobFilter", names)
    both = files(PARQUET_FILES).parquet(path).unionByName(files(LINE_FILES).json(path), allowMissingColumns=True)
    excluded = F.lit(False)
    for exchange, stream in spec.unavailable:
        excluded = excluded | ((F.col("exchange") == exchange) & (F.col("stream") == stream))
    kept = both.where(~excluded & F.col("exchange").isin(*spec.exchanges) & F.col("symbol").isin(*(s.lower() for s in spec.symbols)))
    return kept.withColumn("symbol", F.upper("symbol")).withColumnRenamed("date", "day")


SELECTED_PATHS = 100_000


def read_selected(spark: SparkSession, path: str, selected: DataFrame, schema: T.StructType, most_paths: int = SELECTED_PATHS) -> DataFrame:
    """Rows of the `selected` partitions (exchange, stream, symbol, day) of a tree; no other folder is opened.

    Up to `most_paths` partitions that have files are read by their paths, whose number is counted first. More of them are met by
    the partition columns, by which Spark prunes the scan while it runs. The rows are the same.
    """
    present = selected.join(listed(spark, path), list(PARTS), "left_semi").distinct()
    parts = present.limit(most_paths + 1).collect()
    if not parts:
        raise ValueError("no readable partition")
    whole = T.StructType([*schema.fields, T.StructField("date", T.IntegerType())])
    reader = lambda names: spark.read.schema(whole).option("basePath", path).option("pathGlobFilter", names)
    if len(parts) <= most_paths:
        paths = [f"{path}/exchange={r['exchange']}/stream={r['stream']}/symbol={r['symbol'].lower()}/date={r['day']}" for r in parts]
        both = reader(PARQUET_FILES).parquet(*paths).unionByName(reader(LINE_FILES).json(paths), allowMissingColumns=True)
        return both.withColumn("symbol", F.upper("symbol")).withColumnRenamed("date", "day")
    wanted = materialize(present.select("exchange", "stream", F.lower("symbol").alias("symbol"), F.col("day").alias("date")), "selected-partitions").where("date > 0")
    both = [x.join(wanted, ["exchange", "stream", "symbol", "date"], "left_semi") for x in (reader(PARQUET_FILES).parquet(path), reader(LINE_FILES).json(path))]
    return both[0].unionByName(both[1], allowMissingColumns=True).withColumn("symbol", F.upper("symbol")).withColumnRenamed("date", "day")
