"""Registered queries and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators import ranges, state
from keyloom.plans import catalog_queries, kv_queries, metric_queries, range_queries
from keyloom.sources import fixtures

QUERIES, ORACLE_SQL = {}, {}
for _part in (kv_queries, range_queries, catalog_queries, metric_queries):
    QUERIES |= _part.queries.run
    ORACLE_SQL |= _part.queries.sql


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live keys of the folded log by the range that owns them."""
    live = state.fold(fixtures.log(spark, sf_dir), ["ts_us", "version"]).withColumn("keyspace_id", F.lit(1).cast("long"))
    owners = fixtures.ranges(spark).where(~F.col("sealed"))
    return ranges.route(live, owners).groupBy("range_id").agg(F.count(F.lit(1)).alias("n_live"))
