"""The driver's tables seen as key-value data, logs, catalogs and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kv_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("value"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a mutation log: a user's errors delete, all else puts."""
    op = F.when(F.col("event_type") == "error", "delete").otherwise("put")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), op.alias("op"), F.expr(MICROS.format("ts")).alias("ts_us"), F.col("event_id").alias("version"))


def kv_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as rows with an expiry: errors never expire, views at once, the rest after a while."""
    ttl = F.when(F.col("event_type") == "error", None).when(F.col("event_type") == "view", 0).otherwise(F.col("event_id") % 100 * 3600)
    observed = F.expr(f"{MICROS.format('ts')} div 1000")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.col("event_type").alias("value"), ttl.cast("long").alias("ttl_s"), observed.alias("observed_ms"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as latency samples in whole nanoseconds."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("outcome"), "event_id", "user_id", F.floor(F.col("value") * 1e6).cast("long").alias("ns"), F.expr(MICROS.format("ts")).alias("ts_us"))


#: Key ranges over customer keys: a sealed parent, its parts, and a keyspace with a gap.
RANGES = """(1, 1, 0, 300, 1, 3, false), (2, 1, 300, 900, 2, 5, false), (3, 1, 900, null, 1, 1, false), (4, 1, 0, 900, 1, 2, true),
(5, 2, 0, 100, 1, 1, false), (6, 2, 200, null, 1, 1, false), (7, 3, 0, 500, 1, 1, false), (8, 3, 400, null, 1, 1, false)"""

EPOCHS = "(1, 0, 1, false), (1, 2000, 2, false), (1, 6000, 3, true), (2, 0, 2, false), (2, 5000, 3, false), (3, 1000, 4, false)"


def values(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    """Inline rows; columns are `name type` pairs."""
    pairs = [c.split() for c in columns.split(", ")]
    frame = spark.sql(f"select * from values {rows} as t({', '.join(n for n, _ in pairs)})")
    return frame.select(*[F.col(n).cast(t).alias(n) for n, t in pairs])


def ranges(spark: SparkSession) -> DataFrame:
    rows = values(spark, RANGES, "range_id long, keyspace_id long, lo long, hi long, conf_ver long, version long, sealed boolean")
    return rows.withColumnsRenamed({"lo": "start", "hi": "end"})
