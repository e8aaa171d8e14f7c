"""Reads on one fixed snapshot: gets, scans, pages, seeks, counts, digests.

A snapshot is any DataFrame with a key and a value column; it is read once, so that all
rows of an answer come from the same state.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.functions.keys import MAX_BATCH, in_range, prefix_successor
from keyloom.operators.ordering import carried, placed

PAGE = 512


def point_get(kv: DataFrame, key) -> DataFrame:
    return kv.where(F.col("key") == F.lit(key))


def batch_get(kv: DataFrame, keys: list, key_type: str = "long") -> DataFrame:
    """(pos, key, found, value) in request order; repeated keys repeat, misses report."""
    if len(keys) > MAX_BATCH:
        raise ValueError(f"a batch has at most {MAX_BATCH} keys")
    wanted = kv.sparkSession.range(1).select(F.posexplode(F.lit(list(keys)).cast(f"array<{key_type}>")).alias("pos", "key"))
    hits = kv.select(F.col("key"), F.lit(True).alias("hit"), "value")
    # a request holds at most MAX_BATCH keys
    near = hits.join(F.broadcast(wanted.select("key").distinct()), "key", "left_semi")
    return wanted.join(near, "key", "left").select("pos", "key", F.coalesce("hit", F.lit(False)).alias("found"), "value")


def batch_get_within(kv: DataFrame, keys: list, budget: int, key_type: str = "long") -> DataFrame:
    """batch_get if all value bytes, repeats included, fit in budget; else no row at all."""
    got = batch_get(kv, keys, key_type)
    whole = Window.partitionBy(F.lit(0))  # at most MAX_BATCH rows
    spent = F.coalesce(F.sum(F.octet_length("value")).over(whole), F.lit(0))
    return got.withColumn("bytes", spent).where(F.col("bytes") <= budget)


def scan(kv: DataFrame, start=None, end=None, limit: int | None = None, reverse: bool = False) -> DataFrame:
    """Rows of [start, end) in key order, at most limit; an inverted range is empty."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be positive")
    rows = kv
    if start is not None:
        rows = rows.where(F.col("key") >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col("key") < F.lit(end))
    rows = rows.orderBy(F.desc("key") if reverse else F.asc("key"))
    return rows if limit is None else rows.limit(limit)


def next_page(kv: DataFrame, last, end=None, limit: int = 100) -> DataFrame:
    """The page after a key."""
    return scan(kv.where(F.col("key") > F.lit(last)), None, end, limit)


def prefix_scan(kv: DataFrame, prefix: str | bytes) -> DataFrame:
    """Keys with a prefix, strings or bytes; the comparison reaches the files."""
    if isinstance(prefix, str):
        return kv.where(F.col("key").startswith(prefix))
    rows, end = kv.where(F.col("key") >= F.lit(prefix)), prefix_successor(prefix)
    return rows if end is None else rows.where(F.col("key") < F.lit(end))


def seek_le(kv: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (probe) with the greatest key at or below each, and its value; null if none.

    Keys and probes are put in one order by ranges, and each probe takes the last key
    before it.  Keys may be numbers, strings or bytes.
    """
    have = kv.select("key", F.struct("key", "value").alias("hit"), F.lit(0).alias("asked"))
    want = probes.select(F.col("probe").alias("key"), F.lit(None).cast(have.schema["hit"].dataType).alias("hit"), F.lit(1).alias("asked")).distinct()
    found = carried(have.unionByName(want), ["key", "asked"], "hit").where("asked = 1")
    return probes.join(found.select(F.col("key").alias("probe"), "hit.key", "hit.value"), "probe", "left")


def entry_count(kv: DataFrame) -> DataFrame:
    return kv.agg(F.count(F.lit(1)).alias("n"))


def encoded(column: Column, kind: str) -> Column:
    """The bytes of a key or value, in hexadecimal: numbers as eight big-endian bytes."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.lpad(F.hex(column.cast("long")), 16, "0")
    return F.hex(column.cast("binary"))


def framed(key: Column, value: Column) -> Column:
    """length, key, length, value in hexadecimal; lengths are four big-endian bytes."""
    size = lambda x: F.lpad(F.hex((F.length(x) / 2).cast("long")), 8, "0")
    return F.concat(size(key), key, size(value), value)


def range_digest(kv: DataFrame, by: list[str], page: int = PAGE) -> DataFrame:
    """(by, n, digest) of each range's rows (key, value): SHA-256 over framed rows in key order.

    A page of `page` neighbouring rows is hashed, each row with its lengths before it; pages are
    hashed in turn by books of so many pages, books by shelves, and a range's shelves make
    its digest.  No task sees a whole range, and two copies agree however they are stored.
    """
    kinds = dict(kv.dtypes)
    rows = kv.select(*by, "key", framed(encoded(F.col("key"), kinds["key"]), encoded(F.col("value"), kinds["value"])).alias("body"))
    rows = placed(rows, [*by, "key"])
    firsts = rows.groupBy(*[F.col(c).alias(f"of_{c}") for c in by]).agg(F.min("place").alias("first"))
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in by]
    rows = rows.join(firsts, reduce(and_, same)).select(*by, (F.col("place") - F.col("first")).alias("no"), F.lit(1).cast("long").alias("n"), "body")
    for _ in range(3):
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "body"))), lambda r: r["body"]), "")
        pages = rows.groupBy(*by, F.expr(f"no div {page}").alias("up")).agg(F.sum("n").alias("n"), F.sha2(F.unhex(joined), 256).alias("body"))
        rows = pages.withColumnRenamed("up", "no")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "body"))), lambda r: r["body"]), "")
    return rows.groupBy(*by).agg(F.sum("n").alias("n"), F.sha2(F.unhex(joined), 256).alias("digest"))


def cross_range_scan(kv: DataFrame, ranges: DataFrame, start=None, end=None, limit: int | None = None) -> DataFrame:
    """A scan over all unsealed ranges, each row with the range that serves it."""
    live = ranges.where(~F.col("sealed"))
    served = kv.join(live, in_range(F.col("key"), live["start"], live["end"]) & (kv["keyspace_id"] == live["keyspace_id"])).select(kv["*"], "range_id")
    return scan(served, start, end, limit)
