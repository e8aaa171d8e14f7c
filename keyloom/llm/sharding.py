"""Sharding by a two-pass external shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType
from pyspark.sql.window import Window

from keyloom.llm.common import discard, documents, written

SEED = 20_240_601
BUCKET_BYTES = 256 << 20  # what a task of the second pass shuffles; it may spill
MIN_BUCKETS = 32
MOST_BUCKETS = 1 << 20  # their starts, 16 bytes each, go to every task; beyond, buckets grow instead
HEAVY = 1 << 16  # an equal part of the rows that is larger than one in so many is scattered copy by copy
SHARDS = 16
PLACE = (1 << 33) - 1  # of monotonically_increasing_id: the row's place in its partition


def record_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text plus one; a null text has no bytes."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _digest(df: DataFrame, key: list[str], seed: int) -> Column:
    """A seeded hash of a whole row, its key columns first; nulls count by their place."""
    first = [*key, *(c for c in df.columns if c not in key)]
    maps = {f.name for f in df.schema.fields if isinstance(f.dataType, MapType)}
    values = [F.to_json(F.col(f"`{c}`")) if c in maps else F.col(f"`{c}`") for c in first]
    return F.xxhash64(F.lit(seed), *values, *[F.col(f"`{c}`").isNull() for c in first])


def external_shuffle(df: DataFrame, size: Column, key: list[str], seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, min_buckets: int = MIN_BUCKETS) -> DataFrame:
    """A uniformly shuffled copy of df, written to the shared folder.

    Returns (record struct of df's columns, bucket int, pos int); bucket, then pos,
    is the new order.  The order follows from the rows and the seed alone, however df is
    split and however often a task is run again.

    Pass 1 scatters every record into one of B buckets by a seeded hash of the whole row,
    where B is the input's bytes over bucket_bytes, so that a bucket is a task's work;
    repeated keys scatter as well.  Equal rows share a bucket, but for groups that hold
    more than one row in HEAVY: of these one copy is kept with the number of copies, and
    each copy is scattered by its number.  Pass 2 gathers each bucket in a partition of
    its own, in the order of the hashes, and draws a seeded random key for each place;
    the order of the keys is the new one.  That is the uniform permutation that swapping
    from the end (Fisher-Yates) draws, but needs no random access: the sort may spill.

    Nulls in any column, empty texts and equal rows are records like any other.  An
    empty df gives no rows.  Extra columns travel inside record, so that no name can
    clash.  One record larger than bucket_bytes just makes its bucket that much larger.
    """
    whole = df.select(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    buckets = min(MOST_BUCKETS, max(min_buckets, -(-(whole["bytes"] or 0) // bucket_bytes)))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("record"), _digest(df, key, seed).alias("h"), _digest(df, key, seed + 1).alias("g"))
    thin = df.select(_digest(df, key, seed).alias("h"), _digest(df, key, seed + 1).alias("g"))
    heavy = written(thin.groupBy("h", "g").count().where(F.col("count") > 1 + whole["rows"] // HEAVY), "heavy")
    spread = rows.withColumn("copy", F.lit(0).cast("long"))
    if not heavy.isEmpty():
        few = F.broadcast(heavy)  # fewer than HEAVY rows of 24 bytes
        one = rows.join(few, ["h", "g"]).groupBy("h", "g").agg(F.first("record").alias("record"), F.first("count").alias("n"))
        copies = one.select("record", "h", "g", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
        spread = rows.join(few, ["h", "g"], "left_anti").select("record", "h", "g", F.lit(0).cast("long").alias("copy")).unionByName(copies)
    bucket = F.pmod(F.xxhash64(F.lit(seed), "h", "copy"), F.lit(buckets)).cast("int")
    gathered = spread.withColumn("bucket", bucket).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("h", "g", "copy")
    keyed = gathered.select("bucket", "record", F.monotonically_increasing_id().bitwiseAND(F.lit(PLACE)).alias("at"))
    keyed = keyed.withColumn("draw", F.xxhash64(F.lit(seed), "bucket", "at")).sortWithinPartitions("draw", "at")
    mixed = keyed.select("bucket", F.monotonically_increasing_id().bitwiseAND(F.lit(PLACE)).cast("int").alias("pos"), "record")
    out = written(mixed, "shuffled")
    discard(heavy)
    return out


def shard_rows(df: DataFrame, size: Column, key: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Deal df into shards 0 .. shards-1 of row counts at most one apart, in shuffled order.

    Returns (record, shard int, slot long), slot gapless from 0 in each shard.  Only
    the count of each bucket (one row a bucket) is put in order globally.
    """
    mixed = external_shuffle(df, size, key, seed)
    counts = written(mixed.groupBy("bucket").count(), "buckets")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    rows = counts.agg(F.sum("count").alias("n")).first()["n"] or 0
    base, more = divmod(rows, shards)
    cut = more * (base + 1)  # the first `more` shards hold one row more
    # at most MOST_BUCKETS rows of 16 bytes
    place = mixed.join(F.broadcast(starts), "bucket").select("record", (F.col("start") + F.col("pos")).alias("p"))
    if base:
        shard = F.when(F.col("p") < cut, F.expr(f"p div {base + 1}")).otherwise(F.expr(f"(p - {cut}) div {base}") + more)
    else:
        shard = F.col("p")
    place = place.withColumn("shard", shard.cast("int"))
    first = F.col("shard") * base + F.least(F.col("shard"), F.lit(more))
    return place.select("record", "shard", (F.col("p") - first).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the result of shard_rows as Parquet, a folder a shard, rows in slot order."""
    flat = sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    flat.write.partitionBy("shard").parquet(path)


def op9_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot under the law `rows`."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    dealt = shard_rows(docs, record_bytes(F.col("text")), ["doc_id"])
    text = F.col("record.text")
    return dealt.select(
        F.col("record.doc_id").alias("doc_id"),
        record_bytes(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
