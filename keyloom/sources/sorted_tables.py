"""Immutable sorted tables on Parquet, their manifests and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators.ordering import running

TABLE_BYTES = 8 << 20


def write_sorted(df: DataFrame, path: str, key: list[str], rows_per_file: int = 1_000_000) -> None:
    """Write df in disjoint key ranges, sorted within files; a repeated key is an error."""
    again = df.groupBy(*key).count().where("count > 1").limit(1)
    if not again.isEmpty():
        raise ValueError("keys must be unique")
    ordered = df.repartitionByRange(*key).sortWithinPartitions(*key)
    ordered.write.option("maxRecordsPerFile", rows_per_file).parquet(path)


def manifest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(file, smallest, largest, n, bytes) of every file of a table."""
    table = spark.read.parquet(path)
    rows = table.select(F.col(key).alias("key"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    return rows.groupBy("file").agg(F.min("key").alias("smallest"), F.max("key").alias("largest"), F.count(F.lit(1)).alias("n"), F.max("size").alias("bytes"))


def prune(manifests: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe, file) of the files that may hold a probe; a request's probes are few."""
    hit = (F.col("smallest") <= F.col("probe")) & (F.col("probe") <= F.col("largest"))
    return manifests.join(F.broadcast(probes), hit).select("probe", "file")


def restore(spark: SparkSession, manifests: DataFrame, schema) -> DataFrame:
    """All rows of a manifest's files; the manifest's own size is that of its file list."""
    files = [r["file"] for r in manifests.select("file").distinct().collect()]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def object_digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256, bytes) of stored objects."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def closure_problems(expected: DataFrame, objects: DataFrame) -> DataFrame:
    """(file, problem): referenced objects that are missing or differ from their digest."""
    have = objects.select("file", F.col("sha256").alias("now"))
    rows = expected.join(have, "file", "left")
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("sha256"), "ObjectContentMismatch")
    return rows.select("file", problem.alias("problem")).where("problem is not null")


def layout(kv: DataFrame, size: str = "bytes", target: int = TABLE_BYTES) -> DataFrame:
    """kv (key, bytes) with table: rows in key order cut wherever the running bytes pass target."""
    laid = running(kv, ["key"], size)
    return laid.withColumn("table", F.expr(f"(upto - `{size}`) div {target}")).drop("upto")


def layout_manifest(laid: DataFrame, size: str = "bytes") -> DataFrame:
    """(table, smallest, largest, n, bytes)."""
    return laid.groupBy("table").agg(F.min("key").alias("smallest"), F.max("key").alias("largest"), F.count(F.lit(1)).alias("n"), F.sum(size).cast("long").alias("bytes"))
