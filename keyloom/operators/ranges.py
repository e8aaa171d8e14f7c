"""Key ranges: routing, permits, splits, merges and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.functions.keys import exact_epoch, in_range
from keyloom.operators.ordering import carried, placed, running
from keyloom.sources.shared import written

MAX_SPLIT_KEY = 1024  # bytes

BROADCAST_RANGES = 2_000  # each key looks at all ranges of its keyspace
BLOCK, REACHING = 1_024, 1_024  # starts that are held together, and ranges that meet one copy of them


def route(keys: DataFrame, ranges: DataFrame, most: int = BROADCAST_RANGES) -> DataFrame:
    """keys (keyspace_id, key, ...) with the range that owns each; range_id null if none does.

    The range with the last start at or below a key (the greatest range_id of equal
    starts) owns it if the key is before that range's end; so a key has one owner at most,
    even where ranges overlap.  While the ranges are few they are sent to every task, each
    up to the next one's start; beyond, keys and starts are put in one order by ranges of
    it.  Both ways give the same rows, for numbers, strings and bytes.
    """
    bounds = ranges.select("range_id", F.col("keyspace_id").alias("ks"), "start", "end")
    if bounds.limit(most + 1).count() <= most:
        order = Window.partitionBy("ks").orderBy("start", "range_id")
        spans = bounds.withColumn("next", F.lead("start").over(order))
        met = (keys["keyspace_id"] == F.col("ks")) & in_range(keys["key"], F.col("start"), F.col("next"))
        owner = F.when(F.col("end").isNull() | (keys["key"] < F.col("end")), F.col("range_id"))
        return keys.join(F.broadcast(spans), met, "left").select(keys["*"], owner.alias("range_id"))
    starts = bounds.select(F.col("ks").alias("keyspace_id"), F.col("start").alias("key"), F.struct("ks", "range_id", "end").alias("owner"), F.lit(0).alias("asked"))
    asked = keys.select("keyspace_id", "key").distinct().select("*", F.lit(None).cast(starts.schema["owner"].dataType).alias("owner"), F.lit(1).alias("asked"))
    found = carried(starts.unionByName(asked), ["keyspace_id", "key", "asked", F.col("owner.range_id")], "owner").where("asked = 1")
    inside = (F.col("owner.ks") == F.col("keyspace_id")) & (F.col("owner.end").isNull() | (F.col("key") < F.col("owner.end")))
    found = found.select("keyspace_id", "key", F.when(inside, F.col("owner.range_id")).alias("range_id"))
    return keys.join(found, ["keyspace_id", "key"], "left").select(*[keys[c] for c in keys.columns], "range_id")


def permit(batch_keys: DataFrame, ranges: DataFrame) -> DataFrame:
    """(batch, verdict) for (batch, range_id, keyspace_id, conf_ver, version, key) rows.

    The checks come in this order: unknown range, keyspace, epoch or seal, containment of
    every key.  One failing key refuses its whole batch.
    """
    r = ranges.select("range_id", F.col("keyspace_id").alias("r_ks"), F.col("conf_ver").alias("r_conf"), F.col("version").alias("r_ver"), "sealed", "start", "end")
    rows = batch_keys.join(r, "range_id", "left")
    current = exact_epoch(F.col("conf_ver"), F.col("version"), F.col("r_conf"), F.col("r_ver"), F.col("sealed"))
    held = rows.groupBy("batch").agg(
        F.bool_and(F.col("r_ks").isNotNull()).alias("known"),
        F.bool_and(F.coalesce(F.col("r_ks") == F.col("keyspace_id"), F.lit(False))).alias("same_keyspace"),
        F.bool_and(current).alias("current"),
        F.bool_and(F.coalesce(in_range(F.col("key"), F.col("start"), F.col("end")), F.lit(False))).alias("inside"),
    )
    verdict = F.when(~F.col("known"), "RegionNotFound").when(~F.col("same_keyspace"), "KeyspaceNotFound").when(~F.col("current"), "StaleEpoch").when(~F.col("inside"), "RangeCrossesRegion").otherwise("ok")
    return held.select("batch", verdict.alias("verdict"))


def fence(mutations: DataFrame, epochs: DataFrame) -> DataFrame:
    """mutations (range_id, position, version, ...) with the epoch in force and applies.

    epochs (range_id, since, version, sealed) is a timeline; a mutation meets the last one
    that began at or before its position.
    """
    until = F.lead("since").over(Window.partitionBy("range_id").orderBy("since"))
    spans = epochs.select("range_id", "since", until.alias("until"), F.col("version").alias("now_version"), "sealed")
    there = (mutations["range_id"] == spans["range_id"]) & (mutations["position"] >= spans["since"]) & (spans["until"].isNull() | (mutations["position"] < spans["until"]))
    met = mutations.join(spans, there, "left").select(mutations["*"], "now_version", "sealed")
    return met.withColumn("applies", F.coalesce((F.col("version") == F.col("now_version")) & ~F.col("sealed"), F.lit(False)))


def partition_check(ranges: DataFrame, slice_only: bool = False, first=None) -> DataFrame:
    """(keyspace_id, valid): unsealed ranges cover all keys from first on once; a slice may have gaps."""
    live = ranges.where(~F.col("sealed"))
    order = Window.partitionBy("keyspace_id").orderBy(F.asc_nulls_first("start"))
    rows = live.withColumn("next", F.lead("start").over(order)).withColumn("no", F.row_number().over(order))
    last = F.col("next").isNull()
    joined = F.when(last, F.lit(True) if slice_only else F.col("end").isNull()).otherwise(F.col("end").isNotNull() & (F.col("end") <= F.col("next") if slice_only else F.col("end") == F.col("next")))
    begins = F.lit(True) if slice_only else (F.col("no") > 1) | F.col("start").eqNullSafe(F.lit(first))
    return rows.groupBy("keyspace_id").agg(F.bool_and(joined & begins).alias("valid"))


def overlaps(ranges: DataFrame) -> DataFrame:
    """(keyspace_id, left, right) of all pairs of ranges that share a key, the one that starts first on the left.

    Starts and ends are put in one order and starts are counted: a range overlaps the
    starts counted between its own and its end, so that no pair is looked at in vain.
    Starts are held in blocks of the order and a range is sent once to each block that it
    reaches, so that what is shuffled grows with the ranges and not with the pairs; a block
    that many ranges reach is held in several copies, each for some of these.
    """
    some = ranges.where("end is null or end > start")
    start = some.select("keyspace_id", F.lit(False).alias("open"), F.col("start").alias("key"), F.lit(1).cast("long").alias("begins"), "range_id")
    end = some.select("keyspace_id", F.col("end").isNull().alias("open"), F.col("end").alias("key"), F.lit(0).cast("long").alias("begins"), "range_id")
    counted = running(start.unionByName(end), ["keyspace_id", "open", "key", "begins", "range_id"], "begins")
    first = counted.where("begins = 1").select("keyspace_id", "range_id", F.col("upto").alias("own"))
    last = counted.where("begins = 0").select("keyspace_id", "range_id", F.col("upto").alias("last"))
    # places of starts from 0: a range's own is one before low
    over = written(first.join(last, ["keyspace_id", "range_id"]).where("last > own").select("keyspace_id", F.col("range_id").alias("left"), F.col("own").alias("low"), (F.col("last") - 1).alias("high")), "reach")
    reach = over.withColumn("block", F.explode(F.expr(f"sequence(low div {BLOCK}, high div {BLOCK})")))
    copies = reach.groupBy("block").agg(F.expr(f"(count(*) - 1) div {REACHING} + 1").alias("copies"))
    place = F.col("own") - 1
    held = first.groupBy(F.expr(f"(own - 1) div {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "range_id")))["range_id"].alias("starts"))
    held = held.join(copies, "block").select("block", "starts", F.explode(F.expr("sequence(0, copies - 1)")).alias("copy"))
    met = reach.join(copies, "block").withColumn("copy", F.pmod(F.xxhash64("keyspace_id", "left"), "copies")).join(held, ["block", "copy"])
    at = F.greatest(F.col("low") - F.col("block") * BLOCK, F.lit(0))
    until = F.least(F.col("high") - F.col("block") * BLOCK, F.lit(BLOCK - 1))
    return met.select("keyspace_id", "left", F.explode(F.slice("starts", (at + 1).cast("int"), (until - at + 1).cast("int"))).alias("right"))


def median_key(sizes_from: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, split_key): the key at place n div 2 in order, if n >= 2 and it is not the first."""
    rows = placed(sizes_from.select(*by, "key"), [*by, "key"])
    groups = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"), F.min("key").alias("least"))
    hit = (F.col("place") == F.expr("first + n div 2")) & (F.col("n") >= 2) & (F.col("key") > F.col("least"))
    return rows.join(groups, by).where(hit).select(*by, "n", F.col("key").alias("split_key"))


def split_plan(ranges: DataFrame, requests: DataFrame, busy: DataFrame) -> DataFrame:
    """(range_id, verdict, children) for requests (range_id, split_key).

    children are [start, key) and [key, end); refused requests have none.
    """
    rows = requests.join(ranges, "range_id", "left").join(busy.select("range_id", F.lit(True).alias("busy")).distinct(), "range_id", "left")
    inside = (F.col("start").isNull() | (F.col("split_key") > F.col("start"))) & (F.col("end").isNull() | (F.col("split_key") < F.col("end")))
    bytes_ = dict(requests.dtypes)["split_key"] in ("binary", "string")
    sized = F.octet_length("split_key").between(1, MAX_SPLIT_KEY) if bytes_ else F.lit(True)
    verdict = F.when(F.col("keyspace_id").isNull(), "RegionNotFound").when(F.col("sealed"), "sealed").when(F.coalesce("busy", F.lit(False)), "busy").when(~sized, "MalformedKey").when(~inside, "outside").otherwise("ok")
    part = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    children = F.array(part(F.col("start"), F.col("split_key")), part(F.col("split_key"), F.col("end")))
    return rows.select("range_id", "split_key", verdict.alias("verdict"), F.when(verdict == "ok", children).alias("children"))


def publish(ranges: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    """ranges with sealed parents replaced by their children (split or merge)."""
    return ranges.join(gone.select("range_id"), "range_id", "left_anti").unionByName(new)


def merge_candidates(ranges: DataFrame, busy: DataFrame | None = None) -> DataFrame:
    """(keyspace_id, low, high) of unsealed, idle neighbours: the low one's end is the high one's start."""
    idle = ranges.where(~F.col("sealed"))
    if busy is not None:
        idle = idle.join(busy.select("range_id"), "range_id", "left_anti")
    low = idle.select("keyspace_id", F.col("range_id").alias("low"), F.col("end").alias("edge"))
    high = idle.select("keyspace_id", F.col("range_id").alias("high"), F.col("start").alias("edge"))
    return low.join(high, ["keyspace_id", "edge"]).select("keyspace_id", "low", "high")


def seal_check(epochs: DataFrame) -> DataFrame:
    """Timeline steps with valid: a seal changes nothing but sealed and adds one to version."""
    order = Window.partitionBy("range_id").orderBy("since")
    same = F.lag("start").over(order).eqNullSafe(F.col("start")) & F.lag("end").over(order).eqNullSafe(F.col("end"))
    step = same & ~F.lag("sealed").over(order) & F.col("sealed") & (F.col("version") == F.lag("version").over(order) + 1)
    return epochs.withColumn("valid", F.when(F.lag("since").over(order).isNull(), F.lit(True)).otherwise(step))


def split_candidates(ranges: DataFrame, busy: DataFrame, least_bytes: int, now: int, cooldown: int) -> DataFrame:
    """The largest led, idle, unsealed and cooled range of at least so many bytes: one a pass."""
    fit = ranges.where(F.col("leader") & ~F.col("sealed") & (F.col("bytes") >= least_bytes) & (F.col("last_split") + cooldown <= now))
    return fit.join(busy.select("range_id"), "range_id", "left_anti").orderBy(F.desc("bytes"), "range_id").limit(1)


def population_check(parent: DataFrame, child: DataFrame, by: list[str]) -> DataFrame:
    """(by, same): whether a child holds just its half of the parent's rows."""
    from keyloom.operators.reads import range_digest

    left = range_digest(parent, by)
    right = range_digest(child, by).select(*by, F.col("n").alias("child_n"), F.col("digest").alias("child_digest"))
    same = F.col("n").eqNullSafe(F.col("child_n")) & F.col("digest").eqNullSafe(F.col("child_digest"))
    return left.join(right, by, "full_outer").select(*by, same.alias("same"))


def footprint(files: DataFrame) -> DataFrame:
    """Bytes of each range."""
    return files.groupBy("range_id").agg(F.sum("bytes").cast("long").alias("bytes"))
