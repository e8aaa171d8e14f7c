"""Expiry under a committed clock: resolution, visibility, bounded pages, cleanup.

Pages are prefixes of a range in key order under several budgets.  A page is a bounded
part of one range, so its running sums are counted over at most `examined` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.functions.keys import successor
from keyloom.operators import reads

ROWS, EXAMINED, BYTES = 256, 4096, 1 << 20
#: Parts of an expiry record, as far as a table has them, and its encoded size.
RECORD = ("digest", "expiry_term", "expiry_idx", "expires_at_ms")
RECORD_BYTES = 64


def resolve_expiry(ttl_s: Column, observed_ms: Column) -> Column:
    """None clears; 0 expires at the observed clock; else so many seconds after it (overflow raises)."""
    return F.when(ttl_s.isNull(), F.lit(None).cast("long")).otherwise(observed_ms + 1000 * ttl_s.cast("long"))


def visible(expires_at_ms: Column, watermark_ms) -> Column:
    return expires_at_ms.isNull() | (expires_at_ms > F.lit(watermark_ms))


def clock(log: DataFrame, position: list[str], observed: str, by: list[str]) -> DataFrame:
    """The merged clock after each entry of a group: it never goes back."""
    so_far = Window.partitionBy(*by).orderBy(*position).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("watermark", F.max(observed).over(so_far))


def ttl_fold(log: DataFrame, position: list[str]) -> DataFrame:
    """(key, value, expires_at_ms): a put sets or clears the expiry, a delete removes both."""
    last = F.max_by(F.struct("op", "value", "expires_at_ms"), F.struct(*position)).alias("last")
    return log.groupBy("key").agg(last).where("last.op = 'put'").select("key", "last.value", "last.expires_at_ms")


def get(kv: DataFrame, key, watermark_ms: int) -> DataFrame:
    """The row of a key, unless it has expired."""
    return reads.point_get(kv.where(visible(F.col("expires_at_ms"), watermark_ms)), key)


def batch_get(kv: DataFrame, keys: list, watermark_ms: int, key_type: str = "long") -> DataFrame:
    """(pos, key, found, value) in request order; an expired row is a miss."""
    return reads.batch_get(kv.where(visible(F.col("expires_at_ms"), watermark_ms)), keys, key_type)


def _walked(kv: DataFrame, start, end, counts: Column, size: Column, rows: int, examined: int, bytes_: int) -> DataFrame:
    """The rows of [start, end) that a page reaches, in key order, with inside: on the page or passed over.

    A page ends when so many rows are taken or examined, or before a counted row that
    would exceed the bytes; that row is reached and not inside.  A counted row that
    exceeds the bytes by itself is an error.
    """
    if min(rows, examined, bytes_) < 1:
        raise ValueError("budgets must be positive")
    first = kv if start is None else kv.where(F.col("key") >= F.lit(start))
    first = first if end is None else first.where(F.col("key") < F.lit(end))
    first = first.orderBy("key").limit(examined)
    so_far = Window.partitionBy(F.lit(0)).orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    marked = first.withColumn("counts", counts).withColumn("size", F.when(counts, size).otherwise(0).cast("long"))
    marked = marked.withColumn("row_no", F.sum(F.col("counts").cast("long")).over(so_far)).withColumn("upto", F.sum("size").over(so_far))
    reached = (F.col("row_no") - F.col("counts").cast("long") < rows) & (F.col("upto") - F.col("size") <= bytes_)
    fits = F.when(F.col("size") > bytes_, F.raise_error(F.lit("one row exceeds the byte budget")).cast("boolean")).otherwise(F.col("upto") <= bytes_)
    return marked.where(reached).withColumn("inside", fits)


def _cursor(page: DataFrame, kv: DataFrame, end, rows: int, examined: int) -> DataFrame:
    """(n_rows, n_examined, resume_key, resume_inclusive) of walked rows.

    A stop before a row resumes at it; a page that is full resumes after the last row it
    examined, whether or not another one follows; a page that met the range's end, or
    could only resume there, has no cursor.
    """
    got = page.agg(
        F.count(F.when(F.col("inside") & F.col("counts"), 1)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_examined"),
        F.max("key").alias("last"),
        F.coalesce(F.bool_or(~F.col("inside")), F.lit(False)).alias("at_row"),
    )
    more = (F.col("n_rows") >= rows) | (F.col("n_examined") >= examined)
    if end is not None and dict(kv.dtypes)["key"] in ("binary", "string"):
        more = more & (successor(F.col("last").cast("binary")) < F.lit(end).cast("binary"))
    resume = F.when(F.col("at_row") | more, F.col("last"))
    return got.select("n_rows", "n_examined", resume.alias("resume_key"), F.when(resume.isNotNull(), F.col("at_row")).alias("resume_inclusive"))


def _scanned(kv: DataFrame, start, end, watermark_ms: int, rows: int, examined: int, bytes_: int) -> DataFrame:
    size = F.octet_length(F.col("key").cast("string")) + F.octet_length("value") + 16
    return _walked(kv, start, end, visible(F.col("expires_at_ms"), watermark_ms), size, rows, examined, bytes_)


def scan_page(kv: DataFrame, start, end, watermark_ms: int, rows: int = ROWS, examined: int = EXAMINED, bytes_: int = BYTES) -> DataFrame:
    """(key, value) of the visible rows of a page; a visible row costs key + value + 16 bytes."""
    return _scanned(kv, start, end, watermark_ms, rows, examined, bytes_).where("inside and counts").select("key", "value")


def scan_cursor(kv: DataFrame, start, end, watermark_ms: int, rows: int = ROWS, examined: int = EXAMINED, bytes_: int = BYTES) -> DataFrame:
    """(n_rows, n_examined, resume_key, resume_inclusive) of the same page."""
    return _cursor(_scanned(kv, start, end, watermark_ms, rows, examined, bytes_), kv, end, rows, examined)


def _expired(kv: DataFrame, start, end, watermark_ms: int, candidates: int, examined: int, bytes_: int) -> DataFrame:
    records = kv.where(F.col("expires_at_ms").isNotNull()).select("key", *_record(kv))
    size = F.octet_length(F.col("key").cast("string")) + 4 + RECORD_BYTES
    return _walked(records, start, end, ~visible(F.col("expires_at_ms"), watermark_ms), size, candidates, examined, bytes_)


def _record(kv: DataFrame) -> list[str]:
    return [c for c in RECORD if c in kv.columns]


def cleanup_page(kv: DataFrame, start, end, watermark_ms: int, candidates: int = ROWS, examined: int = EXAMINED, bytes_: int = BYTES) -> DataFrame:
    """(key, record) of expired records to remove; each costs key + 4 + 64 bytes.

    Only expiry records are examined; values are not read.
    """
    return _expired(kv, start, end, watermark_ms, candidates, examined, bytes_).where("inside and counts").select("key", *_record(kv))


def cleanup_cursor(kv: DataFrame, start, end, watermark_ms: int, candidates: int = ROWS, examined: int = EXAMINED, bytes_: int = BYTES) -> DataFrame:
    """(n_rows, n_examined, resume_key, resume_inclusive) of the same page."""
    return _cursor(_expired(kv, start, end, watermark_ms, candidates, examined, bytes_), kv, end, candidates, examined)


def cleanup_apply(kv: DataFrame, observed: DataFrame, watermark_ms: int) -> DataFrame:
    """kv without the observed records that are unchanged, in every part, and still expired."""
    parts = [c for c in _record(kv) if c in observed.columns]
    seen = observed.select("key", *[F.col(c).alias(f"seen_{c}") for c in parts])
    same = (kv["key"] == seen["key"]) & ~visible(kv["expires_at_ms"], watermark_ms)
    for c in parts:
        same = same & kv[c].eqNullSafe(seen[f"seen_{c}"])
    return kv.join(seen, same, "left_anti")


def _doomed(kv: DataFrame, start, end, keys: int, bytes_: int) -> DataFrame:
    size = F.octet_length(F.col("key").cast("string")) + 5
    return _walked(kv.select("key"), start, end, F.lit(True), size, keys, keys, bytes_)


def delete_page(kv: DataFrame, start, end, keys: int = ROWS, bytes_: int = BYTES) -> DataFrame:
    """Keys of a page to delete, expired ones included; each costs key + 5 bytes."""
    return _doomed(kv, start, end, keys, bytes_).where("inside").select("key")


def delete_cursor(kv: DataFrame, start, end, keys: int = ROWS, bytes_: int = BYTES) -> DataFrame:
    """(n_rows, n_examined, resume_key, resume_inclusive) of the same page."""
    return _cursor(_doomed(kv, start, end, keys, bytes_), kv, end, keys, keys)


def legacy_allowed(tables: DataFrame) -> DataFrame:
    """Whether commands without expiry are still taken; turning expiry on is one-way."""
    return tables.withColumn("legacy_allowed", ~F.col("ttl_enabled"))
