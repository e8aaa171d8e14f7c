"""Histograms, quantiles, throughput and outcomes over the fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import metrics
from keyloom.plans.collection import Queries
from keyloom.sources.fixtures import samples

queries = Queries()
NS = "(select event_type as outcome, event_id, user_id, floor(value * 1e6)::bigint as ns, epoch_us(ts) as ts_us from events)"
BUCKET = "case when {0} = 0 then 0 else length(bin({0})) end"
HIST = f"(select outcome, {BUCKET.format('ns')} as bucket, count(*) as n, sum(ns)::bigint as sum_ns, min(ns) as min_ns, max(ns) as max_ns from {NS} group by all)"


def _hist(spark, d):
    return metrics.histogram(samples(spark, d), ["outcome"])


@queries.add(f"select outcome, bucket::int as bucket, n, sum_ns, min_ns, max_ns from {HIST}")
def hist_log2(spark, d):
    return _hist(spark, d)


@queries.add(f"""with c as (select outcome, bucket, sum(n) over (partition by outcome order by bucket) as upto, sum(n) over (partition by outcome) as total from {HIST}),
q as (select outcome, p::int as percent, min(bucket)::int as bucket from c, (values (50), (95), (99)) as v(p) where upto >= (total * p + 99) // 100 group by outcome, p)
select outcome, percent, bucket, case when bucket = 0 then 0 else 1::bigint << (bucket - 1) end as lower_ns, case when bucket = 0 then 0 else (1::bigint << bucket) - 1 end as upper_ns from q""")
def hist_quantiles(spark, d):
    return metrics.quantiles(_hist(spark, d), ["outcome"], [50, 95, 99])


@queries.add(f"""with b as (select outcome, {BUCKET.format('ns')} as bucket, count(*) as n from {NS} where event_id <= 500 group by all), a as (select outcome, {BUCKET.format('ns')} as bucket, count(*) as n from {NS} group by all)
select outcome, bucket::int as bucket, (coalesce(a.n, 0) - coalesce(b.n, 0))::bigint as n, coalesce(a.n, 0) - coalesce(b.n, 0) >= 0 as conserved from a full join b using (outcome, bucket)""")
def hist_delta(spark, d):
    before = metrics.histogram(samples(spark, d).where("event_id <= 500"), ["outcome"])
    return metrics.delta(before, _hist(spark, d), ["outcome"])


@queries.add(f"""select outcome, (case when ns < 64 then ns else 64 * (length(bin(ns)) - 7) + (ns >> (length(bin(ns)) - 7)) end)::int as bucket, count(*) as n from {NS} group by all""")
def hist_fine(spark, d):
    return metrics.fine_histogram(samples(spark, d), ["outcome"])


@queries.add(f"""with h as (select {BUCKET.format('ns')} as bucket, count(*) filter (outcome = 'click') as l, count(*) as r from {NS} group by 1), s as (select sum(l) over (order by bucket) as l, sum(r) over (order by bucket) as r from h)
select bool_and(l <= r) as dominates from s""")
def hist_dominance(spark, d):
    rows = samples(spark, d).withColumn("all", F.lit(1))
    left, right = (metrics.histogram(x, ["all"]).select("bucket", "n") for x in (rows.where("outcome = 'click'"), rows))
    return metrics.dominance(left, right)


@queries.add(f"""with h as (select case when bucket = 0 then 0 else 1::hugeint << (bucket - 1) end as low, (1::hugeint << bucket) - 1 as high, case when outcome = 'click' then sum_ns * 3 else sum_ns end as total, case when outcome = 'view' then min_ns // 4 else min_ns end as least, * from {HIST}),
g as (select outcome, sum(n)::bigint as n, sum(low * n) as lo, sum(high * n) as hi, sum(total) as total, min(least) as mn, max(max_ns) as mx, min(bucket) as first, max(bucket) as last from h group by 1)
select outcome, n, total >= lo and total <= hi and {BUCKET.format('mn')} = first and {BUCKET.format('mx')} = last as plausible from g""")
def hist_plausible(spark, d):
    """Two outcomes are tampered with: a sum too great, a least value out of its bucket."""
    hist = _hist(spark, d).withColumn("sum_ns", F.when(F.col("outcome") == "click", F.col("sum_ns") * 3).otherwise(F.col("sum_ns")))
    return metrics.plausible(hist.withColumn("min_ns", F.when(F.col("outcome") == "view", F.expr("min_ns div 4")).otherwise(F.col("min_ns"))), ["outcome"])


@queries.add(f"select event_id % 2 as target, {BUCKET.format('ns')}::int as bucket, count(*) as n from {NS} group by all")
def hist_pooled(spark, d):
    repeats = metrics.histogram(samples(spark, d).withColumn("target", F.col("event_id") % 2).withColumn("repeat", F.col("event_id") % 3), ["target", "repeat"])
    return metrics.pooled(repeats, ["target"])


@queries.add(f"select user_id, count(*) filter (outcome <> 'error') as successes, greatest(1000000000::bigint, max(ns))::bigint as elapsed_ns, count(*) filter (outcome <> 'error') / (greatest(1000000000::bigint, max(ns)) / 1e9) as per_second from {NS} group by 1")
def cohort_throughput(spark, d):
    ops = samples(spark, d).select("user_id", F.when(F.col("outcome") != "error", "ok").otherwise("failed").alias("outcome"), F.col("ns").alias("end_ns"), F.lit(1_000_000_000).cast("long").alias("cutoff"))
    return metrics.throughput(ops, ["user_id"], "cutoff")


@queries.add(f"select user_id % 4 as target, count(*) filter (outcome <> 'error')::bigint as successes, sum(ns)::bigint as elapsed_ns, count(*) filter (outcome <> 'error') / (sum(ns)::bigint / 1e9) as per_second from {NS} group by 1")
def repeats_pooled(spark, d):
    runs = samples(spark, d).groupBy((F.col("user_id") % 4).alias("target"), "user_id").agg(F.count(F.when(F.col("outcome") != "error", 1)).alias("successes"), F.sum("ns").alias("elapsed_ns"))
    return metrics.repeats_pooled(runs, ["target"])


OPS = "(select case event_type when 'click' then 'ok' when 'view' then 'not_leader' when 'signup' then 'admission' when 'purchase' then 'unknown' else 'rejected' end as outcome, case when event_id % 3 = 0 then 'get' else 'put' end as kind, case when event_id % 2 = 0 then 'warm' else 'measure' end as phase from events)"


def _operations(spark, d):
    outcome = F.when(F.col("outcome") == "click", "ok").when(F.col("outcome") == "view", "not_leader").when(F.col("outcome") == "signup", "admission").when(F.col("outcome") == "purchase", "unknown").otherwise("rejected")
    kind = F.when(F.col("event_id") % 3 == 0, "get").otherwise("put")
    return samples(spark, d).select(outcome.alias("outcome"), kind.alias("kind"), F.when(F.col("event_id") % 2 == 0, "warm").otherwise("measure").alias("phase"))


@queries.add(f"select case when outcome = 'ok' then 'acknowledged' when outcome = 'not_leader' then 'not_leader' when outcome = 'admission' then 'admission_refusal' when outcome = 'rejected' then 'client_rejection' when kind = 'put' then 'unknown_write' else 'read_failure' end as family, count(*) as n from {OPS} group by 1")
def outcome_families(spark, d):
    return metrics.outcome_families(_operations(spark, d))


@queries.add(f"select 'operations' as dimension, '' as name, count(*) as n from {OPS} union all select 'outcome', outcome, count(*) from {OPS} group by 2 union all select 'kind', kind, count(*) from {OPS} group by 2 union all select 'phase_kind', phase || '/' || kind, count(*) from {OPS} where outcome = 'ok' group by 2")
def history_coverage(spark, d):
    return metrics.coverage(_operations(spark, d))
