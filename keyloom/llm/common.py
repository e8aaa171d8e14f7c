"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keyloom.sources.shared import discard, shared_dir, written

__all__ = ["discard", "documents", "record_schema", "recorded", "shared_dir", "small_batches", "texts_of", "thin_batches", "written"]

AT_ONCE = 512  # rows of a batch that Python works on, and hands back, at once
BATCH_BYTES = 1 << 20  # of a batch that Spark sends to Python, where an executor has little room


def record_schema(rows: DataFrame, more: str) -> StructType:
    """The schema of rows' record column with further columns after it, whatever names record holds."""
    return StructType([rows.schema["record"], *StructType.fromDDL(more).fields])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """From here on the session sends Python about BATCH_BYTES at once, by default 10,000 rows; a smaller limit stays.

    The executor's JVM holds a batch outside its heap and the Python worker holds it too, for each core.
    """
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(limit).lower().removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(limit, str(BATCH_BYTES))


def recorded(docs: DataFrame, carry: list[str] | None, *more: Column) -> DataFrame:
    """docs' columns in carry (all by default) as a struct record, and more; text follows as data unless record holds it.

    So a text goes to Python once, not twice.
    """
    columns = docs.columns if carry is None else carry
    data = [] if "text" in columns else [F.col("text").cast("binary").alias("data")]
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("record"), *more, *data)


def texts_of(batch: pa.RecordBatch) -> pa.Array:
    """The texts in a batch of recorded()."""
    return batch.column("data") if "data" in batch.schema.names else batch.column("record").field("text")


def thin_batches(batches: Iterator[pa.RecordBatch], rows: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that what goes back to Spark is never held as a whole.

    A Python worker serves many tasks and waits between them; what is unused is given back before and after each.
    """
    pa.default_memory_pool().release_unused()
    batch = None
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)
    del batch
    pa.default_memory_pool().release_unused()
