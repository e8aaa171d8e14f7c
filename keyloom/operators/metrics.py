"""Latency histograms, exact interval quantiles, throughput and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.functions.buckets import fine_bucket, log2_bucket, log2_lower, log2_upper


def histogram(samples: DataFrame, by: list[str], value: str = "ns") -> DataFrame:
    """(by, bucket, n, sum_ns, min_ns, max_ns) in 65 power-of-two buckets."""
    rows = samples.withColumn("bucket", log2_bucket(F.col(value)))
    return rows.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(value).cast("long").alias("sum_ns"), F.min(value).alias("min_ns"), F.max(value).alias("max_ns"))


def fine_histogram(samples: DataFrame, by: list[str], value: str = "ns") -> DataFrame:
    return samples.groupBy(*by, fine_bucket(F.col(value)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(hist: DataFrame, by: list[str], percents: list[int]) -> DataFrame:
    """(by, percent, bucket, lower_ns, upper_ns): the first bucket that reaches rank ceil(n p / 100)."""
    order = Window.partitionBy(*by).orderBy("bucket")
    rows = hist.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    asked = rows.withColumn("percent", F.explode(F.lit(percents)))
    rank = F.expr("(total * percent + 99) div 100")
    first = asked.where(F.col("upto") >= rank).groupBy(*by, "percent").agg(F.min("bucket").alias("bucket"))
    return first.select(*by, "percent", "bucket", log2_lower(F.col("bucket")).alias("lower_ns"), log2_upper(F.col("bucket")).alias("upper_ns"))


def pooled(hists: DataFrame, by: list[str]) -> DataFrame:
    """Raw buckets of repetitions added up; quantiles come from the sums."""
    return hists.groupBy(*by, "bucket").agg(F.sum("n").cast("long").alias("n"))


def delta(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """(by, bucket, n, conserved): what came between two snapshots; no bucket may fall."""
    left = before.select(*by, "bucket", F.col("n").alias("was"))
    rows = after.select(*by, "bucket", F.col("n").alias("now")).join(left, [*by, "bucket"], "full_outer")
    n = F.coalesce("now", F.lit(0)) - F.coalesce("was", F.lit(0))
    return rows.select(*by, "bucket", n.cast("long").alias("n"), (n >= 0).alias("conserved"))


def plausible(hist: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, plausible): the sum lies within the buckets' bounds, the extrema in the outer buckets."""
    rows = hist.withColumn("low", log2_lower(F.col("bucket"))).withColumn("high", log2_upper(F.col("bucket")))
    product = lambda c: F.sum(F.col(c).cast("decimal(20,0)") * F.col("n"))
    got = rows.groupBy(*by).agg(F.sum("n").cast("long").alias("n"), product("low").alias("least"), product("high").alias("most"), F.sum("sum_ns").alias("sum_ns"), F.min("min_ns").alias("lo"), F.max("max_ns").alias("hi"), F.min("bucket").alias("first"), F.max("bucket").alias("last"))
    good = (F.col("sum_ns") >= F.col("least")) & (F.col("sum_ns") <= F.col("most")) & (log2_bucket(F.col("lo")) == F.col("first")) & (log2_bucket(F.col("hi")) == F.col("last"))
    return got.select(*by, "n", good.alias("plausible"))


def dominance(left: DataFrame, right: DataFrame) -> DataFrame:
    """(dominates): at every bucket the left has at most as many samples so far as the right."""
    rows = left.select("bucket", F.col("n").alias("l")).join(right.select("bucket", F.col("n").alias("r")), "bucket", "full_outer")
    order = Window.orderBy("bucket")  # at most one row a bucket
    sums = rows.select(F.sum(F.coalesce("l", F.lit(0))).over(order).alias("l"), F.sum(F.coalesce("r", F.lit(0))).over(order).alias("r"))
    return sums.agg(F.bool_and(F.col("l") <= F.col("r")).alias("dominates"))


def throughput(operations: DataFrame, by: list[str], cutoff: str) -> DataFrame:
    """(by, successes, elapsed_ns, per_second); elapsed runs to the later of cutoff and last end."""
    got = operations.groupBy(*by).agg(F.count(F.when(F.col("outcome") == "ok", 1)).alias("successes"), F.greatest(F.max(cutoff), F.max("end_ns")).alias("elapsed_ns"))
    return got.withColumn("per_second", F.col("successes") / (F.col("elapsed_ns") / 1e9))


def repeats_pooled(repeats: DataFrame, by: list[str]) -> DataFrame:
    """Sum of successes over sum of elapsed time, never a mean of rates."""
    got = repeats.groupBy(*by).agg(F.sum("successes").cast("long").alias("successes"), F.sum("elapsed_ns").cast("long").alias("elapsed_ns"))
    return got.withColumn("per_second", F.col("successes") / (F.col("elapsed_ns") / 1e9))


def family(outcome: Column, kind: Column) -> Column:
    """The family of an operation's outcome."""
    write = kind.isin("put", "delete", "batch", "delete_range")
    return F.when(outcome == "ok", "acknowledged").when(outcome == "not_leader", "not_leader").when(outcome == "admission", "admission_refusal").when(outcome == "rejected", "client_rejection").when(write, "unknown_write").otherwise("read_failure")


def outcome_families(operations: DataFrame) -> DataFrame:
    """(family, n)."""
    return operations.groupBy(family(F.col("outcome"), F.col("kind")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


def coverage(operations: DataFrame) -> DataFrame:
    """(dimension, name, n) of a history: all, by outcome, by kind, successes by phase and kind."""
    one = F.count(F.lit(1)).alias("n")
    parts = [
        operations.agg(one).select(F.lit("operations").alias("dimension"), F.lit("").alias("name"), "n"),
        operations.groupBy("outcome").agg(one).select(F.lit("outcome").alias("dimension"), F.col("outcome").alias("name"), "n"),
        operations.groupBy("kind").agg(one).select(F.lit("kind").alias("dimension"), F.col("kind").alias("name"), "n"),
        operations.where("outcome = 'ok'").groupBy("phase", "kind").agg(one).select(F.lit("phase_kind").alias("dimension"), F.concat_ws("/", "phase", "kind").alias("name"), "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cluster_info(**tables: DataFrame) -> DataFrame:
    """One row with the count of each table, as n_<name>."""
    out = None
    for name, table in tables.items():
        n = table.agg(F.count(F.lit(1)).alias(f"n_{name}")).withColumn("one", F.lit(1))
        out = n if out is None else out.join(n, "one")
    return out.drop("one")
