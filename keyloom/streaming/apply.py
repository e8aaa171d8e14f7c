"""Streams over the mutation log: state folds, expiry and token buckets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

POSITION = ["term", "idx", "ordinal"]


def _folder(path: str, batch: int) -> str:
    return f"{path}/batch={batch:012d}"


def _last(spark: SparkSession, path: str) -> int | None:
    """The newest complete state before any given batch, by its success mark."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_SUCCESS"))
    names = [s.getPath().getParent().getName() for s in found or []]
    return max((int(n.partition("=")[2]) for n in names), default=None)


BUCKETS = 64
STATE = "keyspace_id int, key long, op string, value string, position struct<term:long,idx:long,ordinal:int>"


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("keyspace_id", "key"), F.lit(buckets)).cast("int").alias("bucket")


def _held(spark: SparkSession, path: str) -> dict[int, str]:
    """The newest folder of each bucket, of complete batches only."""
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    marks = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_SUCCESS"))
    complete = {str(m.getPath().getParent().getName()) for m in marks or []}
    found: dict[int, tuple[str, str]] = {}
    for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/bucket=*")) or []:
        batch, bucket = str(s.getPath().getParent().getName()), int(str(s.getPath().getName()).partition("=")[2])
        if batch in complete and batch > found.get(bucket, ("", ""))[0]:
            found[bucket] = (batch, str(s.getPath()))
    return {bucket: folder for bucket, (_, folder) in found.items()}


def fold_batch(state_path: str, buckets: int = BUCKETS):
    """A foreachBatch function that folds log rows into a state table, a folder a batch.

    State is dealt into buckets of keys, and a batch rewrites those that its rows touch.
    It keeps deletes and each key's position, so that a batch that comes again, or rows
    at or below what was applied, change nothing.
    """

    def apply(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        last = _last(spark, state_path)
        if last is not None and batch <= last:
            return
        new = rows.select("keyspace_id", "key", "op", "value", F.struct(*POSITION).alias("position")).to(StructType.fromDDL(STATE))
        touched = {r["bucket"] for r in new.select(_bucket(buckets)).distinct().collect()}  # at most `buckets`
        before = [folder for bucket, folder in _held(spark, state_path).items() if bucket in touched]
        if before:
            new = spark.read.schema(STATE).parquet(*before).unionByName(new)
        newest = F.max_by(F.struct("op", "value", "position"), "position").alias("s")
        state = new.groupBy("keyspace_id", "key").agg(newest).select("keyspace_id", "key", "s.*", _bucket(buckets))
        state.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(_folder(state_path, batch))

    return apply


def run_fold(log: DataFrame, state_path: str, checkpoint: str) -> StreamingQuery:
    """Fold all there is of a streamed log and stop."""
    return log.writeStream.foreachBatch(fold_batch(state_path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_state(spark: SparkSession, state_path: str) -> DataFrame:
    """Live rows (keyspace_id, key, value) of the newest state."""
    if _last(spark, state_path) is None:
        raise ValueError("no state was written")
    folders = _held(spark, state_path).values()
    rows = spark.read.schema(STATE).parquet(*folders) if folders else spark.createDataFrame([], STATE)
    return rows.where("op = 'put'").select("keyspace_id", "key", "value")


def expire_stream(log: DataFrame, idle: str = "0 seconds") -> DataFrame:
    """(key, value, expired_at) of puts whose event-time expiry has passed the watermark.

    log: key, value, at (timestamp), expires_at (timestamp or null).  A later put or delete
    of the key replaces the timer.
    """
    schema = "key long, value string, expired_at timestamp"

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            value, due = state.get
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "value": [value], "expired_at": [pd.Timestamp(due, unit="us")]})
            return
        rows = pd.concat(list(batches)).sort_values("at")
        last = rows.iloc[-1]
        if pd.isna(last.expires_at):
            state.exists and state.remove()
            return
        due = int(last.expires_at.value // 1000)
        state.update((last.value, due))
        state.setTimeoutTimestamp(max(due // 1000, state.getCurrentWatermarkMs() + 1))

    marked = log.withWatermark("at", idle)
    return marked.groupBy("key").applyInPandasWithState(step, schema, "value string, due long", "append", GroupStateTimeout.EventTimeTimeout)


def token_bucket_stream(requests: DataFrame, capacity: int, per_second: int) -> DataFrame:
    """The streamed form of folds.token_bucket; requests of a batch are taken in time order."""
    full = capacity * 1_000_000
    schema = "tenant long, ts_us long, request_id long, admitted boolean, tokens long"

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts_us", "request_id"])
        tokens, last = state.get if state.exists else (full, int(rows.ts_us.iloc[0]))
        out = []
        for r in rows.itertuples():
            tokens = min(full, tokens + max(0, int(r.ts_us) - last) * per_second)
            last, cost = max(last, int(r.ts_us)), int(r.cost) * 1_000_000
            admitted = tokens >= cost
            tokens -= cost if admitted else 0
            out.append((key[0], r.ts_us, r.request_id, admitted, tokens))
        state.update((tokens, last))
        yield pd.DataFrame(out, columns=["tenant", "ts_us", "request_id", "admitted", "tokens"])

    return requests.groupBy("tenant").applyInPandasWithState(step, schema, "tokens long, last long", "append", GroupStateTimeout.NoTimeout)
