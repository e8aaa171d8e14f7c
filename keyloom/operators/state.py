"""State from an ordered mutation log: folds, versions, garbage, overlays.

A log has key, value, op ('put' or 'delete') and a position of columns that order it as a
tuple.  All columns of a key and its newest position are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.functions.keys import in_range
from keyloom.operators.ordering import placed

CHUNK = 1024


def _position(columns: list[str]) -> Column:
    return F.struct(*columns)


def fold(log: DataFrame, position: list[str], key: list[str] | None = None, after: Column | None = None) -> DataFrame:
    """Live (key, value): the last mutation of a key wins, a delete hides it.

    after, if given, tells which rows are new; the rest were applied before.
    """
    key = key or ["key"]
    rows = log if after is None else log.where(after)
    newest = F.max_by(F.struct("op", "value"), _position(position)).alias("last")
    return rows.groupBy(*key).agg(newest).where("last.op = 'put'").select(*key, "last.value")


def at_version(log: DataFrame, version: int, position: list[str], column: str = "version") -> DataFrame:
    """State as of a version: the newest mutation at or below it."""
    return fold(log.where(F.col(column) <= version), position)


def batch_fold(log: DataFrame, batch: str, ordinal: list[str]) -> DataFrame:
    """One mutation a batch and key: the last one in the batch's order."""
    last = F.max_by(F.struct("op", "value"), _position(ordinal)).alias("last")
    return log.groupBy(batch, "key").agg(last).select(batch, "key", "last.op", "last.value")


def accepted(log: DataFrame, verdicts: DataFrame, batch: str) -> DataFrame:
    """The log without the batches that were refused: all of a batch or none of it."""
    return log.join(verdicts.where("verdict = 'ok'").select(batch), batch, "left_semi")


def delete_range_plan(kv: DataFrame, start, end, chunk: int = CHUNK) -> DataFrame:
    """(key, chunk) of a range delete: keys chosen once, deleted a chunk at a time."""
    rows = kv if start is None else kv.where(F.col("key") >= F.lit(start))
    rows = rows if end is None else rows.where(F.col("key") < F.lit(end))
    return placed(rows.select("key"), ["key"]).select("key", F.expr(f"place div {chunk}").alias("chunk"))


def delete_range_receipt(plan: DataFrame) -> DataFrame:
    """(chunk, n, first_key, last_key) of each atomic step."""
    return plan.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def delete_chunk(log: DataFrame, plan: DataFrame, positions: DataFrame) -> DataFrame:
    """The log with the plan's tombstones, each chunk at the position it was given (chunk, version)."""
    gone = plan.join(F.broadcast(positions), "chunk").select("key", F.lit(None).cast(dict(log.dtypes)["value"]).alias("value"), F.lit("delete").alias("op"), "version")
    return log.select("key", "value", "op", "version").unionByName(gone)


def without_range(kv: DataFrame, start, end) -> DataFrame:
    """The engine's own atomic range delete."""
    return kv.where(~in_range(F.col("key"), F.lit(start), F.lit(end)))


def garbage(versions: DataFrame, oldest: int) -> DataFrame:
    """versions (key, version, is_tombstone) with doomed: nobody can read it any more.

    Versions above oldest stay.  Of the others a key's newest stays unless it is a
    tombstone.
    """
    old = F.col("version") <= oldest
    newest = versions.where(old).groupBy("key").agg(F.max("version").alias("newest"))
    marked = versions.join(newest, "key", "left")
    return marked.withColumn("doomed", old & ((F.col("version") < F.col("newest")) | F.col("is_tombstone"))).drop("newest")


def garbage_report(marked: DataFrame, oldest: int) -> DataFrame:
    """(scanned, removed, oldest, cycle_complete) of a collection over all keys."""
    return marked.agg(F.count(F.lit(1)).alias("scanned"), F.count(F.when(F.col("doomed"), 1)).alias("removed")).select("scanned", "removed", F.lit(oldest).cast("long").alias("oldest"), F.lit(True).alias("cycle_complete"))


def overlay(snapshot: DataFrame, pending: DataFrame) -> DataFrame:
    """(key, value) of a snapshot under pending (key, op, value): pending wins, deletes hide."""
    over = pending.select("key", F.col("op").alias("new_op"), F.col("value").alias("new_value"))
    both = snapshot.join(over, "key", "full_outer")
    return both.where("new_op is null or new_op = 'put'").select("key", F.when(F.col("new_op").isNotNull(), F.col("new_value")).otherwise(F.col("value")).alias("value"))


def data_revision(log: DataFrame, kind: str = "kind", user_kinds: tuple[str, ...] = ("put", "delete")) -> DataFrame:
    """Changes that users can see."""
    return log.agg(F.count(F.when(F.col(kind).isin(*user_kinds), 1)).alias("revision"))
