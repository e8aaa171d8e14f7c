"""Catalog, placement, lifecycle and storage queries over the fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.operators import catalog, folds, history, placement
from keyloom.plans.collection import Queries
from keyloom.sources import sorted_tables
from keyloom.sources.fixtures import kv_orders, table, values

queries = Queries()


@queries.add("select s_suppkey, n_name, r_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def catalog_two_hop(spark, d):
    near = catalog.two_hop(table(spark, d, "nation"), table(spark, d, "region"), "n_regionkey", "r_regionkey")
    return catalog.two_hop(table(spark, d, "supplier"), near, "s_nationkey", "n_nationkey").select("s_suppkey", "n_name", "r_name")


@queries.add("select n_nationkey from nation where n_regionkey = 1")
def catalog_index_scan(spark, d):
    return catalog.index_scan(table(spark, d, "nation"), ["n_nationkey"], n_regionkey=1)


@queries.add("select * from nation where n_nationkey = 7")
def catalog_get(spark, d):
    return catalog.get(table(spark, d, "nation"), n_nationkey=7)


@queries.add("select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def catalog_unique_violations(spark, d):
    return catalog.unique_violations(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@queries.add("select o_custkey, o_orderkey from orders where not exists (select 1 from customer where c_custkey = o_custkey and c_acctbal >= 0)")
def catalog_fk_violations(spark, d):
    """Orders of customers that have no account in credit."""
    parents = table(spark, d, "customer").where("c_acctbal >= 0")
    return catalog.missing_parents(table(spark, d, "orders").select("o_custkey", "o_orderkey"), parents, "o_custkey", "c_custkey")


@queries.add("select c_custkey from customer where c_mktsegment = 'BUILDING' and exists (select 1 from orders where o_custkey = c_custkey)")
def catalog_restrict(spark, d):
    doomed = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return catalog.restricted(doomed, table(spark, d, "orders"), "c_custkey", "o_custkey")


@queries.add("select c.c_nationkey, c.c_custkey as probe, s.s_suppkey, s.s_name from customer c asof left join supplier s on s.s_nationkey = c.c_nationkey and c.c_custkey >= s.s_suppkey")
def catalog_seek_index(spark, d):
    """The last supplier of a customer's nation whose key is not above the customer's."""
    probes = table(spark, d, "customer").select(F.col("c_nationkey").alias("s_nationkey"), F.col("c_custkey").alias("probe"))
    found = catalog.seek_index(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), probes, ["s_nationkey"], "s_suppkey")
    return found.select(F.col("s_nationkey").alias("c_nationkey"), "probe", "row.s_suppkey", "row.s_name")


@queries.add("select n_nationkey as keyspace_id, n_name as name, n_regionkey as tenant_id, (select count(*) from supplier where s_nationkey = n_nationkey) as regions from nation")
def catalog_list_keyspaces(spark, d):
    keyspaces = table(spark, d, "nation").select(F.col("n_nationkey").alias("keyspace_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("tenant_id"))
    return catalog.list_keyspaces(keyspaces, table(spark, d, "supplier").select(F.col("s_nationkey").alias("keyspace_id")))


@queries.add("""with h as (select c_custkey, c_nationkey, c_mktsegment from customer where c_mktsegment <> 'MACHINERY'), w as (select c_custkey, case when c_acctbal < 0 then 0 else c_nationkey end as c_nationkey, c_mktsegment from customer where c_mktsegment <> 'BUILDING')
select coalesce(h.c_custkey, w.c_custkey) as c_custkey, case when h.c_custkey is null then 'insert' when w.c_custkey is null then 'delete' else 'replace' end as change from h full join w on h.c_custkey = w.c_custkey where h.c_custkey is null or w.c_custkey is null or h.c_nationkey <> w.c_nationkey""")
def catalog_slice_diff(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    have = rows.where("c_mktsegment <> 'MACHINERY'").drop("c_acctbal")
    want = rows.where("c_mktsegment <> 'BUILDING'").withColumn("c_nationkey", F.when(F.col("c_acctbal") < 0, 0).otherwise(F.col("c_nationkey"))).drop("c_acctbal")
    return catalog.slice_diff(have, want, ["c_custkey"])


@queries.add("select n_regionkey, n_nationkey, n_name from nation where (n_regionkey, n_nationkey) > (1, 5) order by n_regionkey, n_nationkey limit 7")
def catalog_keyset_page(spark, d):
    return catalog.scan_after(table(spark, d, "nation"), ["n_regionkey", "n_nationkey"], (1, 5), 7).select("n_regionkey", "n_nationkey", "n_name")


@queries.add("select event_id as id, event_type as kind from events where event_id > 200 and event_type = 'click' order by event_id limit 64")
def task_list(spark, d):
    tasks = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    return catalog.list_tasks(tasks, 200, "click")


@queries.add("select c_custkey, 99 + 5 + row_number() over (order by c_custkey) as new_id from customer")
def catalog_allocate_ids(spark, d):
    return catalog.allocate_ids(table(spark, d, "customer").select("c_custkey"), ["c_custkey"], taken=5)


@queries.add("select s_suppkey, case when s_suppkey % 3 = 0 then case when s_suppkey % 2 = 0 then 'renamed' end else s_name end as s_name, s_nationkey from supplier")
def catalog_update(spark, d):
    """Names changed, every other one to null."""
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    changes = rows.where("s_suppkey % 3 = 0").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, "renamed").alias("s_name"))
    return catalog.update(rows, changes, ["s_suppkey"])


@queries.add("""with n as (select l_suppkey + l_linenumber * 3 as id, l_partkey * 2 as parent, l_returnflag || l_orderkey as tag from lineitem where l_quantity = 50),
c as (select *, exists (select 1 from supplier where s_suppkey = id) or count(*) over (partition by id) > 1 as conflict, not exists (select 1 from part where p_partkey = parent) as orphan, exists (select 1 from supplier where s_name = tag) or count(*) over (partition by tag) > 1 as again from n)
select id, parent, tag, case when conflict then 'WriteConflict' when orphan then 'ForeignKey' when again then 'Unique' else 'ok' end as verdict from c""")
def catalog_insert(spark, d):
    rows = table(spark, d, "lineitem").where("l_quantity = 50").select((F.col("l_suppkey") + F.col("l_linenumber") * 3).alias("id"), (F.col("l_partkey") * 2).alias("parent"), F.concat("l_returnflag", F.col("l_orderkey").cast("string")).alias("tag"))
    there = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(None).cast("long").alias("parent"), F.col("s_name").alias("tag"))
    return catalog.insert(there, rows, ["id"], ["tag"], "parent", table(spark, d, "part"), "p_partkey")


@queries.add("select c_custkey from customer where not (c_mktsegment = 'BUILDING' and not exists (select 1 from orders where o_custkey = c_custkey))")
def catalog_delete(spark, d):
    """A segment's customers go, but for those with orders."""
    rows = table(spark, d, "customer")
    return catalog.delete(rows, rows.where("c_mktsegment = 'BUILDING'"), ["c_custkey"], table(spark, d, "orders"), "o_custkey").select("c_custkey")


@queries.add("select (select count(*) from nation) as n_nodes, (select count(*) from customer) as n_keyspaces, (select count(*) from region) as n_regions")
def cluster_info(spark, d):
    from keyloom.operators.metrics import cluster_info as info

    return info(nodes=table(spark, d, "nation"), keyspaces=table(spark, d, "customer"), regions=table(spark, d, "region"))


@queries.add("""select * from (select n_regionkey::bigint as group_id, n_nationkey::bigint as node from nation union all select s_nationkey % 5, s_suppkey from supplier) m where not exists (select 1 from customer where c_acctbal < 0 and c_nationkey % 5 = m.group_id and c_custkey = m.node)""")
def committed_members(spark, d):
    initial = table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("group_id"), F.col("n_nationkey").cast("long").alias("node"))
    joined = table(spark, d, "supplier").select((F.col("s_nationkey") % 5).cast("long").alias("group_id"), F.col("s_suppkey").alias("node"))
    removed = table(spark, d, "customer").where("c_acctbal < 0").select((F.col("c_nationkey") % 5).cast("long").alias("group_id"), F.col("c_custkey").alias("node"))
    return catalog.committed_members(initial, joined, removed)


@queries.add("select n_regionkey as group_id, string_agg(n_nationkey::varchar, ',' order by n_nationkey) as nodes from nation group by all")
def data_group_listing(spark, d):
    groups = table(spark, d, "region").select(F.col("r_regionkey").alias("group_id"))
    parts = table(spark, d, "nation").select(F.col("n_regionkey").alias("group_id"), F.col("n_nationkey").alias("node"))
    return catalog.group_listing(groups, replicas=parts).select("group_id", F.array_join(F.col("replicas.node").cast("array<string>"), ",").alias("nodes"))


@queries.add("select n_nationkey as node, c.n as customers, s.n as suppliers from nation left join (select c_nationkey, count(*) as n from customer group by 1) c on c_nationkey = n_nationkey left join (select s_nationkey, count(*) as n from supplier group by 1) s on s_nationkey = n_nationkey")
def node_listing(spark, d):
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").alias("node"))
    progress = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("node")).agg(F.count(F.lit(1)).alias("customers"))
    admissions = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("node")).agg(F.count(F.lit(1)).alias("suppliers"))
    return catalog.node_listing(nodes, progress, admissions, nodes)


STATE = "case c_mktsegment when 'BUILDING' then 'consumed' when 'MACHINERY' then 'revoked' else 'pending' end"


@queries.add(f"select c_custkey as node, case when {STATE} = 'pending' and c_custkey % 200 <= 100 then 'expired' else {STATE} end as effective from customer")
def admission_states(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.expr(STATE).alias("state"), (F.col("c_custkey") % 200).alias("expires_unix"))
    return catalog.admission_state(rows, 100).select("node", "effective")


def _nodes(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.when(F.col("n_nationkey") % 6 == 5, "left").otherwise("active").alias("state"), (F.col("n_nationkey") % 7 == 3).alias("draining"))


def _replicas(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("node"))


@queries.add("select n_nationkey as node, count(c_custkey) as load from nation left join customer on c_nationkey = n_nationkey group by 1")
def replica_load(spark, d):
    return placement.replica_load(_nodes(spark, d).select("node"), _replicas(spark, d))


@queries.add("select n_nationkey as node, count(c_custkey) as load from nation left join customer on c_nationkey = n_nationkey where n_nationkey % 6 <> 5 and n_nationkey % 7 <> 3 and n_nationkey % 4 <> 0 group by 1 order by 2, 1 limit 1")
def placement_destination(spark, d):
    out = _nodes(spark, d).where("node % 4 = 0").select("node")
    return placement.destination(_nodes(spark, d), _replicas(spark, d), out).select("node", "load")


@queries.add("select s_suppkey, floor((s_suppkey + 1.5::double * s_nationkey + 1000::double * (s_suppkey % 8) + 0.01::double * (s_suppkey * 100)) * 4)::bigint as score4 from supplier")
def store_score(spark, d):
    score = placement.store_score(F.col("s_suppkey").cast("double"), F.col("s_nationkey").cast("double"), (F.col("s_suppkey") % 8).cast("double"), (F.col("s_suppkey") * 100).cast("double"))
    return table(spark, d, "supplier").select("s_suppkey", F.floor(score * 4).alias("score4"))


@queries.add("""select s_suppkey as group_id, case when s_suppkey * 7 % 50 >= 40 then 'entries' when s_suppkey * 11 % 50 >= 30 then 'bytes' when s_suppkey % 5 >= 4 then 'age' end as "trigger",
case when (s_suppkey * 7 % 50 >= 40 or s_suppkey * 11 % 50 >= 30 or s_suppkey % 5 >= 4) and least(s_suppkey % 9, s_suppkey % 13) > 3 then least(s_suppkey % 9, s_suppkey % 13) end as new_floor from supplier""")
def compaction_floor(spark, d):
    k = F.col("s_suppkey")
    groups = table(spark, d, "supplier").select(k.alias("group_id"), (k * 7 % 50).alias("entries"), (k * 11 % 50).alias("bytes"), (k % 5).alias("age_ms"), (k % 9).alias("applied"), (k % 13).alias("checkpoint"), F.lit(3).alias("floor"))
    return placement.compaction_floor(groups, 40, 30, 4).select("group_id", "trigger", "new_floor")


#: A customer as a backup of so many ranges, its orders as the ranges that are done.
BACKUPS = "(select c_custkey as id, 1 + c_custkey % 5 as ranges, c_acctbal < -900 as retired, c_acctbal between -900 and -800 as aborted, c_acctbal > 9000 as complete from customer)"
ANCHORS = "(select o_custkey as id, o_orderkey % 6 as range_id from orders where o_orderstatus = 'P')"


def _backups(spark, d, name, done):
    return table(spark, d, "customer").select(F.col("c_custkey").alias(name), (1 + F.col("c_custkey") % 5).alias("ranges"), (F.col("c_acctbal") < -900).alias("retired"), F.col("c_acctbal").between(-900, -800).alias("aborted"), (F.col("c_acctbal") > 9000).alias(done))


def _anchors(spark, d, name):
    return table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias(name), (F.col("o_orderkey") % 6).alias("range_id"))


@queries.add(f"""select b.id as backup_id, count(distinct a.range_id) as anchored, case when any_value(retired) then 'retired' when any_value(aborted) then 'aborted' when any_value(complete) then 'complete' when count(distinct a.range_id) = 0 then 'intended' when count(distinct a.range_id) < any_value(ranges) then 'capturing' else 'anchored' end as stage
from {BACKUPS} b left join {ANCHORS} a on a.id = b.id group by b.id""")
def backup_stage(spark, d):
    return placement.backup_stage(_backups(spark, d, "backup_id", "complete"), _anchors(spark, d, "backup_id"))


@queries.add(f"""select b.id as restore_id, count(distinct a.range_id) as loaded, case when any_value(aborted) then 'aborted' when any_value(complete) then 'published' when count(distinct a.range_id) = 0 then 'intended' when count(distinct a.range_id) < any_value(ranges) then 'loading' else 'loaded' end as stage
from {BACKUPS} b left join {ANCHORS} a on a.id = b.id group by b.id""")
def restore_stage(spark, d):
    return placement.restore_stage(_backups(spark, d, "restore_id", "published"), _anchors(spark, d, "restore_id"))


@queries.add("""select c_custkey as backup_id, case when r.n is null then 'KeyspaceNotFound' when exists (select 1 from nation where n_nationkey = c_nationkey and n_regionkey = 3) then 'busy' when r.sealed then 'sealed' else 'ok' end as verdict
from customer left join (select s_nationkey, count(*) as n, bool_or(s_acctbal < -500) as sealed from supplier group by 1) r on r.s_nationkey = c_nationkey""")
def backup_plan_check(spark, d):
    plans = table(spark, d, "customer").select(F.col("c_custkey").alias("backup_id"), F.col("c_nationkey").alias("keyspace_id"))
    held = table(spark, d, "supplier").select(F.col("s_nationkey").alias("keyspace_id"), (F.col("s_acctbal") < -500).alias("sealed"))
    busy = table(spark, d, "nation").where("n_regionkey = 3").select(F.col("n_nationkey").alias("keyspace_id"))
    return placement.backup_plan_check(plans, held, busy)


#: Users as voters in groups of a few, by when they were last seen.
PROGRESS = "(select user_id % 30 as g, user_id as node, max(event_id) % 131 as seen from events group by 1, 2)"


def _progress(spark, d):
    return table(spark, d, "events").groupBy((F.col("user_id") % 30).alias("group_id"), F.col("user_id").alias("node")).agg((F.max("event_id") % 131).alias("last_active"))


@queries.add(f"""select g as group_id, count(*) filter (seen + 60 < 100) as lost, case when count(*) filter (seen + 60 < 100) = 0 then 'none' when count(*) < 3 or count(*) - count(*) filter (seen + 60 < 100) <= count(*) // 2 then 'wait' else 'replace' end as action from {PROGRESS} p group by g""")
def lost_voters(spark, d):
    return placement.lost_voters(_progress(spark, d), 100, 60)


@queries.add(f"select g as group_id, (count(*) filter (seen + 60 >= 100) - count(*) // 2 - 1)::bigint as margin from {PROGRESS} p group by g")
def quorum_margin(spark, d):
    return placement.quorum_margin(_progress(spark, d), 100, 60)


@queries.add(f"""with m as (select count(*) filter (seen + 60 >= 100) - count(*) // 2 - 1 as margin from {PROGRESS} p group by g),
c as (select 'quorum_margin' as "check", case when min(margin) < 0 then 'fail' when min(margin) = 0 then 'warn' else 'ok' end as level from m
union all select 'apply_lag', case when max(s_suppkey) > 1000000 then 'fail' else 'warn' end from supplier union all select 'unreachable', 'ok')
select * from c union all select 'overall', case max(case level when 'fail' then 2 when 'warn' then 1 else 0 end) when 2 then 'fail' when 1 then 'warn' else 'ok' end from c""")
def health_report(spark, d):
    m = placement.quorum_margin(_progress(spark, d), 100, 60).agg(F.min("margin").alias("m"))
    margin = m.select(F.lit("quorum_margin").alias("check"), F.when(F.col("m") < 0, "fail").when(F.col("m") == 0, "warn").otherwise("ok").alias("level"))
    lag = table(spark, d, "supplier").agg(F.max("s_suppkey").alias("m")).select(F.lit("apply_lag").alias("check"), F.when(F.col("m") > 1_000_000, "fail").otherwise("warn").alias("level"))
    return placement.health([margin, lag, values(spark, "('unreachable', 'ok')", "check string, level string")])


#: What nodes say of groups: the first letter of the user's last kind of event, if any, and whether it is a member.
CELLS = "(select user_id as g, event_id % 3 + 1 as node, case when count(*) % 4 <> 0 then left(max(event_type), 1) end as view, count(*) % 3 <> 0 as member from events group by 1, 2)"


@queries.add(f"""select g as group_id, max(case when node = 1 then coalesce(view, case when member then 'v' end) end) as "1", max(case when node = 2 then coalesce(view, case when member then 'v' end) end) as "2", max(case when node = 3 then coalesce(view, case when member then 'v' end) end) as "3" from {CELLS} c group by g""")
def placement_matrix(spark, d):
    cells = table(spark, d, "events").groupBy(F.col("user_id").alias("group_id"), (F.col("event_id") % 3 + 1).alias("node"))
    cells = cells.agg(F.when(F.count(F.lit(1)) % 4 != 0, F.left(F.max("event_type"), F.lit(1))).alias("view"), (F.count(F.lit(1)) % 3 != 0).alias("member"))
    return placement.placement_matrix(cells, [1, 2, 3])


@queries.add("""select a.user_id as range_id, a.event_id % 4 as expected, case when a.event_id % 7 = 0 then '' else a.event_type end as change_id, case when c.g = a.event_id % 4 + 1 and a.event_id % 7 <> 0 then case when c.c = a.event_type then 'applied' else 'not_applied' end else 'unknown' end as outcome
from events a join (select user_id, count(*) % 5 as g, max(event_type) as c from events group by 1) c using (user_id)""")
def cas_reconcile(spark, d):
    events = table(spark, d, "events")
    attempts = events.select(F.col("user_id").alias("range_id"), (F.col("event_id") % 4).alias("expected"), F.when(F.col("event_id") % 7 == 0, "").otherwise(F.col("event_type")).alias("change_id"))
    current = events.groupBy(F.col("user_id").alias("range_id")).agg((F.count(F.lit(1)) % 5).alias("generation"), F.max("event_type").alias("change_id"))
    return placement.cas_outcome(attempts, current)


STEP = "case event_type when 'click' then 'add' when 'view' then 'catch_up' when 'signup' then 'promote' end"


@queries.add(f"""select c_custkey as plan_id, case when not coalesce(bool_or(s = 'add'), false) then 'add' when not coalesce(bool_or(s = 'catch_up'), false) then 'catch_up' when not coalesce(bool_or(s = 'promote'), false) then 'promote' else 'done' end as "next" from customer left join (select user_id, {STEP} as s from events where value > 150) e on e.user_id = c_custkey group by 1""")
def replica_plan_step(spark, d):
    plans = table(spark, d, "customer").select(F.col("c_custkey").alias("plan_id"))
    evidence = table(spark, d, "events").where("value > 150").select(F.col("user_id").alias("plan_id"), F.expr(STEP).alias("step"))
    return placement.next_step(plans, evidence, ["add", "catch_up", "promote"])


@queries.add("""select c_custkey as resource, coalesce(bool_and(o_orderstatus = 'F'), true) and coalesce(max(o_orderkey % 10) = c_custkey % 10, true) as retire from customer left join orders on o_custkey = c_custkey group by c_custkey""")
def retire_candidates(spark, d):
    """Orders as pins, filled ones released."""
    phase = F.when(F.col("o_orderstatus") == "F", "Released").when(F.col("o_orderstatus") == "O", "Held")
    pins = table(spark, d, "orders").select(F.col("o_custkey").alias("resource"), F.col("o_orderkey").alias("owner"), phase.alias("phase"), (F.col("o_orderkey") % 10).alias("revision"))
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("resource"), (F.col("c_custkey") % 10).alias("expected"))
    return placement.retirable(pins, wanted)


@queries.add("select p_partkey as object from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_returnflag = 'R' and l_quantity > 45)")
def sweep_unreferenced(spark, d):
    objects = table(spark, d, "part").select(F.col("p_partkey").alias("object"))
    return placement.unreferenced(objects, table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("object")))


@queries.add("select p_partkey as object, count(l_partkey) as refs, count(l_partkey) = 0 as deletable from part left join lineitem on l_partkey = p_partkey and l_returnflag = 'R' and l_quantity > 45 group by 1")
def reference_counts(spark, d):
    objects = table(spark, d, "part").select(F.col("p_partkey").alias("object"))
    return placement.reference_counts(objects, table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("object")))


@queries.add("select user_id, event_id as since, lead(event_id) over (partition by user_id order by event_id) as until from events")
def configuration_intervals(spark, d):
    rows = table(spark, d, "events").select("user_id", F.col("event_id").alias("since"))
    return placement.intervals(rows, ["user_id"])


@queries.add("select user_id, bool_and(coalesce(case when event_id % 50 = 0 then null else event_id > 20 end, false)) as closed from events group by 1")
def reader_closure(spark, d):
    terminal = F.when(F.col("event_id") % 50 != 0, F.col("event_id") > 20)
    return placement.closed(table(spark, d, "events").withColumn("terminal", terminal), ["user_id"])


@queries.add("select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by 1")
def checkpoint_selection(spark, d):
    return placement.latest_selection(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


SIZED = "(select o_orderkey as key, strlen(o_orderstatus) + strlen(o_orderpriority) + 8 as bytes from orders)"
LAYOUT = f'(select key, bytes, (sum(bytes) over (order by key) - bytes)::bigint // 4096 as "table" from {SIZED})'


def _laid(spark, d):
    kv = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), (F.octet_length("o_orderstatus") + F.octet_length("o_orderpriority") + 8).cast("long").alias("bytes"))
    return sorted_tables.layout(kv, target=4096)


@queries.add(f'select key, bytes, "table" from {LAYOUT}')
def sst_layout(spark, d):
    return _laid(spark, d)


@queries.add(f'select "table", min(key) as smallest, max(key) as largest, count(*) as n, sum(bytes)::bigint as bytes from {LAYOUT} group by 1')
def sst_manifest(spark, d):
    return sorted_tables.layout_manifest(_laid(spark, d))


@queries.add(f'with m as (select "table" as t, min(key) as lo, max(key) as hi from {LAYOUT} group by 1) select p.probe::bigint as probe, m.t as file from m join (values (5), (777), (12000), (99999999)) as p(probe) on p.probe >= m.lo and p.probe <= m.hi')
def sst_prune(spark, d):
    m = sorted_tables.layout_manifest(_laid(spark, d)).withColumnRenamed("table", "file")
    return sorted_tables.prune(m, values(spark, "(5), (777), (12000), (99999999)", "probe long"))


@queries.add("""select o_orderkey as file, case when o_orderpriority = '1-URGENT' then 'missing' else 'ObjectContentMismatch' end as problem from orders where o_orderpriority = '1-URGENT' or o_orderstatus = 'P'""")
def closure_verification(spark, d):
    """Orders as objects: urgent ones are gone, pending ones hold something else."""
    orders = table(spark, d, "orders")
    expected = orders.select(F.col("o_orderkey").alias("file"), F.sha2(F.col("o_orderstatus").cast("binary"), 256).alias("sha256"))
    stored = orders.where("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("file"), F.sha2(F.when(F.col("o_orderstatus") == "P", F.lit("?")).otherwise(F.col("o_orderstatus")).cast("binary"), 256).alias("sha256"))
    return sorted_tables.closure_problems(expected, stored)


@queries.add("""with recursive r as materialized (select user_id as tenant, epoch_us(ts) as ts_us, event_id as request_id, (event_id % 7 + 1) * 1000000 as cost, row_number() over (partition by user_id order by epoch_us(ts), event_id) as i from events),
b as (select tenant, ts_us, request_id, i, cost <= 6000000 as admitted, 6000000 - case when cost <= 6000000 then cost else 0 end as tokens from r where i = 1
union all select r.tenant, r.ts_us, r.request_id, r.i, r.cost <= least(6000000, b.tokens + (r.ts_us - b.ts_us) // 20000), least(6000000, b.tokens + (r.ts_us - b.ts_us) // 20000) - case when r.cost <= least(6000000, b.tokens + (r.ts_us - b.ts_us) // 20000) then r.cost else 0 end from b join r on r.tenant = b.tenant and r.i = b.i + 1)
select tenant, ts_us, request_id, admitted, tokens::bigint as tokens from b""")
def token_bucket(spark, d):
    """Events as requests of one to seven tokens; a bucket holds six and gets one more every 20,000 seconds."""
    from keyloom.sources.fixtures import log

    requests = log(spark, d).select(F.col("key").alias("tenant"), "ts_us", F.col("version").alias("request_id"), (F.col("version") % 7 + 1).alias("cost"))
    return folds.token_bucket(requests, 6, 1, every_us=20_000)


@queries.add()
def admission_fold(spark, d):
    k = F.col("event_id")
    events = table(spark, d, "events").select((k % 16).alias("server"), k.alias("seq"), F.when(F.floor(k / 16) % 3 == 2, "release").otherwise("request").alias("kind"), (k % 11 * 100 + 1).alias("bytes"), (k % 5 == 0).alias("metadata"))
    return folds.admission(events, 6, 2000, 2)


@queries.add()
def manifest_cas(spark, d):
    k = F.col("event_id")
    changes = table(spark, d, "events").select((k % 32).alias("range_id"), k.alias("seq"), F.floor(k / 64).alias("expected"), F.concat(F.lit("c"), F.floor(k / 64).cast("string")).alias("change_id"), (k - 1).alias("watermark"), (k % 9 != 0).alias("in_scope"))
    return folds.manifest_swaps(changes)


@queries.add()
def pin_transitions(spark, d):
    k = F.col("event_id")
    phases = F.lit(list(folds.PHASES))
    changes = table(spark, d, "events").select((k % 40).alias("resource"), (k % 80).alias("owner"), k.alias("seq"), F.get(phases, (F.floor(k / 80) % 5).cast("int")).alias("phase"))
    return folds.pin_transitions(changes.na.fill("Lost", ["phase"]))


#: Events as a history of each user: kinds of events are written, views read, errors delete, one after another; some reads are off.
OPS = """(select *, (max({'i': invoked, 'v': value}) filter (op <> 'get') over (partition by history order by invoked rows between unbounded preceding and 1 preceding)).v as now from
(select user_id as history, event_id * 2 as invoked, event_id * 2 + 1 as returned, case event_type when 'view' then 'get' when 'error' then 'delete' else 'put' end as op, case when event_type not in ('view', 'error') then event_type end as value from events))"""


@queries.add(f"select history, case when bool_or(op = 'get' and invoked % 74 = 0 and now is distinct from 'click') then 'invalid' else 'valid' end as verdict from {OPS} group by 1")
def history_check(spark, d):
    """A read whose number is a multiple of 37 returns click, whatever was written."""
    kind, k = F.col("event_type"), F.col("event_id")
    op = F.when(kind == "view", "get").when(kind == "error", "delete").otherwise("put")
    rows = table(spark, d, "events").select(F.col("user_id").alias("history"), F.lit("k").alias("key"), op.alias("op"), F.when(op == "put", kind).alias("value"), (k * 2).alias("invoked"), (k * 2 + 1).alias("returned"), F.lit("ok").alias("outcome"))
    before = Window.partitionBy("history").orderBy("invoked").rowsBetween(Window.unboundedPreceding, -1)
    now = F.last(F.when(F.col("op") != "get", F.struct("value")), ignorenulls=True).over(before)["value"]
    seen = F.when(F.col("op") == "get", F.when(F.col("invoked") % 74 == 0, "click").otherwise(now))
    return history.check_histories(rows.withColumn("result", seen))
