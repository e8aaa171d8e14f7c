"""Reads, folds, versions and expiry over the fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import folds, reads, state, ttl
from keyloom.operators import ranges as R
from keyloom.plans.collection import Queries
from keyloom.sources import fixtures
from keyloom.sources.fixtures import kv_orders, kv_ttl, log

queries = Queries()
KEYS = [33, 5, 33, -1, 99_999_999, 1]
POSITION = ["ts_us", "version"]
KV = "(select o_orderkey as key, o_orderstatus as value from orders)"
LOG = "(select user_id as key, event_type as value, case when event_type = 'error' then 'delete' else 'put' end as op, epoch_us(ts) as ts_us, event_id as version from events)"
WANTED = "(values (0,33),(1,5),(2,33),(3,-1),(4,99999999),(5,1)) as w(pos, key)"
WATERMARK = 1_705_276_800_000
TTL = "(select event_id as key, event_type as value, case when event_type = 'error' then null when event_type = 'view' then epoch_us(ts) // 1000 else epoch_us(ts) // 1000 + 1000 * (event_id % 100 * 3600) end as expires_at_ms from events)"


@queries.add(f"select key, value from {KV} where key = 33")
def kv_get_point(spark, d):
    return reads.point_get(kv_orders(spark, d), 33)


@queries.add(f"select w.pos::bigint as pos, w.key::bigint as key, k.key is not null as found, k.value from {WANTED} left join {KV} k on k.key = w.key")
def kv_batch_get_ordered(spark, d):
    return reads.batch_get(kv_orders(spark, d), KEYS).withColumn("pos", F.col("pos").cast("long"))


@queries.add(f"select pos, key, found, value, bytes from (select w.pos::bigint as pos, w.key::bigint as key, k.key is not null as found, k.value, coalesce(sum(strlen(k.value)) over (), 0)::bigint as bytes from {WANTED} left join {KV} k on k.key = w.key) where bytes <= 10")
def kv_batch_get_budget(spark, d):
    return reads.batch_get_within(kv_orders(spark, d), KEYS, 10).withColumn("pos", F.col("pos").cast("long"))


@queries.add(f"select key, value from {KV} where key >= 100 and key < 1000 order by key limit 50")
def kv_scan_range(spark, d):
    return reads.scan(kv_orders(spark, d), 100, 1000, 50)


@queries.add(f"select key, value from {KV} where key >= 1000 and key < 100 order by key limit 50")
def kv_scan_inverted(spark, d):
    return reads.scan(kv_orders(spark, d), 1000, 100, 50)


@queries.add(f"select key, value from {KV} where key > (select max(key) from (select key from {KV} where key >= 100 order by key limit 50)) and key < 1000 order by key limit 50")
def kv_scan_page2(spark, d):
    kv = kv_orders(spark, d)
    last = reads.scan(kv, 100, 1000, 50).agg(F.max("key").alias("last")).first()["last"]
    return reads.next_page(kv, last, 1000, 50)


@queries.add(f"select key, value from {KV} where key >= 100 and key < 1000 order by key desc limit 50")
def kv_scan_reverse(spark, d):
    return reads.scan(kv_orders(spark, d), 100, 1000, 50, reverse=True)


@queries.add(f"select p.probe, k.key, k.value from (select c_custkey * 11 + 5 as probe from customer) p asof left join (select * from {KV} where value = 'F') k on p.probe >= k.key")
def kv_seek_le(spark, d):
    probes = fixtures.table(spark, d, "customer").select((F.col("c_custkey") * 11 + 5).alias("probe"))
    return reads.seek_le(kv_orders(spark, d).where("value = 'F'"), probes)


@queries.add("select p_partkey, p_brand as key, p_name as value from part where starts_with(p_brand, 'Brand#1')")
def kv_prefix_scan(spark, d):
    part = fixtures.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("key"), F.col("p_name").alias("value"))
    return reads.prefix_scan(part, "Brand#1")


PARTS = "(select p_partkey, encode(p_brand || '/' || p_type) as key, p_name as value from part)"


def _parts(spark, d):
    key = F.concat("p_brand", F.lit("/"), "p_type").cast("binary")
    return fixtures.table(spark, d, "part").select("p_partkey", key.alias("key"), F.col("p_name").alias("value"))


@queries.add(f"select p_partkey, hex(key) as key, value from {PARTS} where key >= encode('Brand#1') and key < encode('Brand#2')")
def kv_prefix_scan_bytes(spark, d):
    return reads.prefix_scan(_parts(spark, d), b"Brand#1").withColumn("key", F.hex("key"))


BYTE_KV = "(select encode(p_brand || '/' || lpad(p_partkey::varchar, 12, '0')) as key, p_type as value from part)"


def _byte_kv(spark, d):
    key = F.concat("p_brand", F.lit("/"), F.lpad(F.col("p_partkey").cast("string"), 12, "0")).cast("binary")
    return fixtures.table(spark, d, "part").select(key.alias("key"), F.col("p_type").alias("value"))


@queries.add(f"select hex(p.probe) as probe, hex(k.key) as key, k.value from (select distinct encode('Brand#' || (10 + c_custkey % 50) || '/' || lpad((c_custkey * 7)::varchar, 12, '0')) as probe from customer) p asof left join {BYTE_KV} k on p.probe >= k.key")
def kv_seek_le_bytes(spark, d):
    probe = F.concat(F.lit("Brand#"), (F.lit(10) + F.col("c_custkey") % 50).cast("string"), F.lit("/"), F.lpad((F.col("c_custkey") * 7).cast("string"), 12, "0")).cast("binary")
    found = reads.seek_le(_byte_kv(spark, d), fixtures.table(spark, d, "customer").select(probe.alias("probe")).distinct())
    return found.select(F.hex("probe").alias("probe"), F.hex("key").alias("key"), "value")


@queries.add(f"select hex(key) as key, (row_number() over (order by key) - 1) // 100 as chunk from {BYTE_KV} where key >= encode('Brand#2') and key < encode('Brand#4')")
def kv_delete_range_bytes(spark, d):
    return state.delete_range_plan(_byte_kv(spark, d), b"Brand#2", b"Brand#4", 100).withColumn("key", F.hex("key"))


@queries.add(f"""with r as (select substr(value, 1, 3) as grp, row_number() over (partition by substr(value, 1, 3) order by key) - 1 as no, count(*) over (partition by substr(value, 1, 3)) as n, key from {BYTE_KV})
select grp, n, hex(key) as split_key from r where no = n // 2 and n >= 2""")
def region_split_median_bytes(spark, d):
    rows = _byte_kv(spark, d).withColumn("grp", F.substring("value", 1, 3))
    return R.median_key(rows, ["grp"]).withColumn("split_key", F.hex("split_key"))


@queries.add("select count(*) as n from orders")
def kv_entry_count(spark, d):
    return reads.entry_count(kv_orders(spark, d))


DIGEST = """with r as (select key // 5000 as range_id, row_number() over (partition by key // 5000 order by key) - 1 as no, 1 as n, '00000008' || format('{{:016X}}', key) || format('{{:08X}}', strlen(value)) || hex(value) as body from {kv}),
p as (select range_id, no // 512 as up, sum(n) as n, sha256(unhex(string_agg(body, '' order by no))) as body from r group by range_id, no // 512),
b as (select range_id, up // 512 as up, sum(n) as n, sha256(unhex(string_agg(body, '' order by p.up))) as body from p group by range_id, p.up // 512),
s as (select range_id, up // 512 as up, sum(n) as n, sha256(unhex(string_agg(body, '' order by b.up))) as body from b group by range_id, b.up // 512)
select range_id::bigint as range_id, sum(n)::bigint as n, sha256(unhex(string_agg(body, '' order by up))) as digest from s group by range_id"""


@queries.add(DIGEST.format(kv=KV))
def kv_range_digest(spark, d):
    kv = kv_orders(spark, d).withColumn("range_id", F.floor(F.col("key") / 5000))
    return reads.range_digest(kv, ["range_id"])


@queries.add(f"select key, value from (select *, row_number() over (partition by key order by ts_us desc, version desc) as r from {LOG}) where r = 1 and op = 'put'")
def kv_lww_snapshot(spark, d):
    return state.fold(log(spark, d), POSITION)


@queries.add(f"select key, value from (select *, row_number() over (partition by key order by ts_us desc, version desc) as r from {LOG} where version <= 4000) where r = 1 and op = 'put'")
def kv_snapshot_at_version(spark, d):
    return state.at_version(log(spark, d), 4000, POSITION)


@queries.add(f"select batch, key, op, value from (select *, version // 64 as batch, row_number() over (partition by version // 64, key order by version desc) as r from {LOG}) where r = 1")
def kv_batch_fold(spark, d):
    return state.batch_fold(log(spark, d).withColumn("batch", F.expr("version div 64")), "batch", ["version"])


@queries.add(f"select chunk::bigint as chunk, count(*) as n, min(key) as first_key, max(key) as last_key from (select key, (row_number() over (order by key) - 1) // 1024 as chunk from {KV} where key >= 1000 and key < 9000) group by chunk")
def kv_delete_range_chunks(spark, d):
    return state.delete_range_receipt(state.delete_range_plan(kv_orders(spark, d), 1000, 9000))


GC = f"(select key, version, op = 'delete' as is_tombstone, coalesce(version <= 6000 and (version < max(case when version <= 6000 then version end) over (partition by key) or op = 'delete'), false) as doomed from {LOG})"


def _marked(spark, d):
    versions = log(spark, d).select("key", "version", (F.col("op") == "delete").alias("is_tombstone"))
    marked = state.garbage(versions, 6000)
    return marked.withColumn("doomed", F.coalesce("doomed", F.lit(False)))


@queries.add(f"select * from {GC}")
def kv_version_gc(spark, d):
    return _marked(spark, d)


@queries.add(f"select count(*) as scanned, count(*) filter (doomed) as removed, 6000::bigint as oldest, true as cycle_complete from {GC}")
def kv_version_gc_report(spark, d):
    return state.garbage_report(_marked(spark, d), 6000)


@queries.add(f"""with p as (select key, case when key % 10 = 0 then 'delete' else 'put' end as op, 'X' as value from {KV} where key % 5 = 0 union all select -key, 'put', 'N' from {KV} where key % 7 = 0)
select coalesce(p.key, k.key) as key, case when p.op is not null then p.value else k.value end as value from {KV} k full join p on p.key = k.key where p.op is null or p.op = 'put'""")
def kv_overlay_merge(spark, d):
    kv = kv_orders(spark, d)
    over = kv.where("key % 5 = 0").select("key", F.when(F.col("key") % 10 == 0, "delete").otherwise("put").alias("op"), F.lit("X").alias("value"))
    new = kv.where("key % 7 = 0").select((-F.col("key")).alias("key"), F.lit("put").alias("op"), F.lit("N").alias("value"))
    return state.overlay(kv, over.union(new))


@queries.add(f"select count(*) filter (op in ('put', 'delete') and value <> 'view') as revision from {LOG}")
def kv_data_revision(spark, d):
    kinds = log(spark, d).withColumn("kind", F.when(F.col("value") == "view", "manifest").otherwise(F.col("op")))
    return state.data_revision(kinds)


def _expiring(spark, d):
    rows = kv_ttl(spark, d)
    return rows.select("key", "value", ttl.resolve_expiry(F.col("ttl_s"), F.col("observed_ms")).alias("expires_at_ms"))


@queries.add(f"select key, expires_at_ms from {TTL}")
def ttl_resolve(spark, d):
    return _expiring(spark, d).select("key", "expires_at_ms")


@queries.add(f"select key, value from {TTL} where expires_at_ms is null or expires_at_ms > {WATERMARK}")
def ttl_visible(spark, d):
    return _expiring(spark, d).where(ttl.visible(F.col("expires_at_ms"), WATERMARK)).select("key", "value")


@queries.add("select user_id as key, event_id as version, max(event_id % 1000) over (partition by user_id order by epoch_us(ts), event_id rows unbounded preceding) as watermark from events")
def ttl_clock(spark, d):
    rows = log(spark, d).withColumn("observed", F.col("version") % 1000)
    return ttl.clock(rows, POSITION, "observed", ["key"]).select("key", "version", "watermark")


@queries.add(f"""select user_id as key, event_type as value, expires_at_ms from (select e.*, case when event_type = 'view' then null else event_id * 10 end as expires_at_ms, row_number() over (partition by user_id order by epoch_us(ts) desc, event_id desc) as r from events e) where r = 1 and event_type <> 'error'""")
def ttl_put_delete_fold(spark, d):
    rows = log(spark, d).withColumn("expires_at_ms", F.when(F.col("value") != "view", F.col("version") * 10))
    return ttl.ttl_fold(rows, POSITION)


def _walk_sql(counts: str, size: str, rows: int, examined: int, bytes_: int, source: str = TTL, start: int = 100, end: int = 9000) -> str:
    """A page walked row by row: w has the rows reached, the last one stopped before if stop."""
    return f"""with recursive base as materialized (select *, row_number() over (order by key) as i, {counts} as counts, {size} as size from {source} where key >= {start} and key < {end}),
w as (select 0::bigint as i, null::bigint as key, false as taken, false as stop, 0::bigint as n, 0::bigint as used
union all select b.i, b.key, b.counts and w.used + b.size <= {bytes_}, b.counts and w.used + b.size > {bytes_}, w.n + (b.counts and w.used + b.size <= {bytes_})::int, w.used + case when b.counts and w.used + b.size <= {bytes_} then b.size else 0 end
from w join base b on b.i = w.i + 1 where not w.stop and w.i < {examined} and w.n < {rows})"""


def _cursor_sql(rows: int, examined: int) -> str:
    more = f"(stop or i = {examined} or n = {rows})"
    return f" select n as n_rows, i as n_examined, case when {more} then key end as resume_key, case when {more} then stop end as resume_inclusive from w order by i desc limit 1"


SEEN = f"(expires_at_ms is null or expires_at_ms > {WATERMARK})"
SCAN_SIZE, RECORD_SIZE, KEY_SIZE = "strlen(key::varchar) + strlen(value) + 16", "strlen(key::varchar) + 68", "strlen(key::varchar) + 5"
RECORDS = f"(select * from {TTL} where expires_at_ms is not null)"


@queries.add(f"select key, value from {TTL} where key = 17 and {SEEN}")
def ttl_get(spark, d):
    return ttl.get(_expiring(spark, d), 17, WATERMARK).select("key", "value")


@queries.add(f"select w.pos::bigint as pos, w.key::bigint as key, k.key is not null as found, k.value from {WANTED} left join (select * from {TTL} where {SEEN}) k on k.key = w.key")
def ttl_batch_get(spark, d):
    return ttl.batch_get(_expiring(spark, d), KEYS, WATERMARK).withColumn("pos", F.col("pos").cast("long"))


@queries.add(_walk_sql(SEEN, SCAN_SIZE, 20, 200, 420) + " select b.key, b.value from w join base b using (i) where taken")
def ttl_scan_page(spark, d):
    return ttl.scan_page(_expiring(spark, d), 100, 9000, WATERMARK, 20, 200, 420)


@queries.add(_walk_sql(SEEN, SCAN_SIZE, 20, 200, 420) + _cursor_sql(20, 200))
def ttl_scan_cursor(spark, d):
    """Stopped by bytes: the cursor is the row that was not returned."""
    return ttl.scan_cursor(_expiring(spark, d), 100, 9000, WATERMARK, 20, 200, 420)


@queries.add(_walk_sql(SEEN, SCAN_SIZE, 1000, 4096, 100_000, start=100, end=300) + _cursor_sql(1000, 4096))
def ttl_scan_last_page(spark, d):
    """The range ends first: no cursor."""
    return ttl.scan_cursor(_expiring(spark, d), 100, 300, WATERMARK, 1000, 4096, 100_000)


@queries.add(_walk_sql(f"not {SEEN}", RECORD_SIZE, 15, 100, 2000, RECORDS) + " select b.key, b.expires_at_ms from w join base b using (i) where taken")
def ttl_cleanup_page(spark, d):
    return ttl.cleanup_page(_expiring(spark, d), 100, 9000, WATERMARK, 15, 100, 2000)


@queries.add(_walk_sql(f"not {SEEN}", RECORD_SIZE, 15, 100, 2000, RECORDS) + _cursor_sql(15, 100))
def ttl_cleanup_cursor(spark, d):
    return ttl.cleanup_cursor(_expiring(spark, d), 100, 9000, WATERMARK, 15, 100, 2000)


@queries.add(f"select key, value, expires_at_ms, key % 5 as expiry_idx from {TTL} t where not exists (select 1 from {TTL} o where o.key = t.key and o.key % 2 = 0 and o.expires_at_ms + (o.key % 4) // 2 is not distinct from t.expires_at_ms and (o.key % 5) * (o.key % 3 <> 0)::int = t.key % 5 and not (t.expires_at_ms is null or t.expires_at_ms > {WATERMARK}))")
def ttl_cleanup_apply(spark, d):
    """A record written again with the same deadline, at another position, stays."""
    kv = _expiring(spark, d).withColumn("expiry_idx", F.col("key") % 5)
    observed = kv.where("key % 2 = 0").withColumn("expires_at_ms", F.expr("expires_at_ms + (key % 4) div 2"))
    observed = observed.withColumn("expiry_idx", F.when(F.col("key") % 3 != 0, F.col("expiry_idx")).otherwise(0))
    return ttl.cleanup_apply(kv, observed, WATERMARK)


@queries.add(_walk_sql("true", KEY_SIZE, 50, 50, 300) + " select key from w where taken")
def ttl_delete_page(spark, d):
    return ttl.delete_page(_expiring(spark, d), 100, 9000, 50, 300)


@queries.add(_walk_sql("true", KEY_SIZE, 50, 50, 300) + _cursor_sql(50, 50))
def ttl_delete_cursor(spark, d):
    return ttl.delete_cursor(_expiring(spark, d), 100, 9000, 50, 300)


@queries.add()
def range_checksum_fnv(spark, d):
    return folds.range_checksums(kv_orders(spark, d))
