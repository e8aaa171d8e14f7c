"""Mutation logs and operation histories in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LOG = "term long, idx long, ordinal int, op string, keyspace_id int, key long, value string, range_id long, conf_ver long, version long"
HISTORY = "history string, type string, seq long, id long, client string, op string, key string, value string, outcome string, result string, phase string"


def append(log: DataFrame, path: str, ttl_secs: int | None = None, causal_ts: int | None = None) -> None:
    """Add mutations to a log folder; a log is partitioned by keyspace and never rewritten.

    Options that a plain log does not honour are refused, never ignored.
    """
    for name, value in (("TTL", ttl_secs), ("causal timestamp", causal_ts)):
        if value is not None:
            raise NotImplementedError(f"a plain log has no {name}")
    log.write.mode("append").partitionBy("keyspace_id").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(path)


def stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """New files of a log folder, as a stream."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def history(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON-lines histories; a malformed line fails the read."""
    return spark.read.schema(HISTORY).option("mode", "FAILFAST").json(path)
