"""Placement, maintenance and lifecycle answers from status rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def replica_load(nodes: DataFrame, replicas: DataFrame) -> DataFrame:
    """(node, load): replicas on each node, 0 where there are none."""
    counts = replicas.groupBy("node").agg(F.count(F.lit(1)).alias("load"))
    return nodes.join(counts, "node", "left").withColumn("load", F.coalesce("load", F.lit(0)).cast("long"))


def destination(nodes: DataFrame, replicas: DataFrame, excluded: DataFrame) -> DataFrame:
    """The active, not draining, not excluded node of least (load, node)."""
    fit = nodes.where((F.col("state") == "active") & ~F.col("draining")).join(excluded.select("node"), "node", "left_anti")
    return replica_load(fit, replicas).orderBy("load", "node").limit(1)


def store_score(rcu: Column, wcu: Column, cpu: Column, regions: Column) -> Column:
    return rcu + 1.5 * wcu + 1000 * cpu + 0.01 * regions


def compaction_floor(groups: DataFrame, entries: int, bytes_: int, age_ms: int) -> DataFrame:
    """groups with trigger (which limit is passed) and floor, where it would rise."""
    trigger = F.when(F.col("entries") >= entries, "entries").when(F.col("bytes") >= bytes_, "bytes").when(F.col("age_ms") >= age_ms, "age")
    to = F.least("applied", "checkpoint")
    return groups.withColumn("trigger", trigger).withColumn("new_floor", F.when(trigger.isNotNull() & (to > F.col("floor")), to))


def backup_stage(backups: DataFrame, anchors: DataFrame) -> DataFrame:
    """(backup_id, anchored, stage): what came last wins, else how many ranges are anchored."""
    counts = anchors.groupBy("backup_id").agg(F.countDistinct("range_id").alias("anchored"))
    rows = backups.join(counts, "backup_id", "left").withColumn("anchored", F.coalesce("anchored", F.lit(0)).cast("long"))
    stage = F.when(F.col("retired"), "retired").when(F.col("aborted"), "aborted").when(F.col("complete"), "complete").when(F.col("anchored") == 0, "intended").when(F.col("anchored") < F.col("ranges"), "capturing").otherwise("anchored")
    return rows.select("backup_id", "anchored", stage.alias("stage"))


def backup_plan_check(plans: DataFrame, ranges: DataFrame, running: DataFrame) -> DataFrame:
    """(backup_id, verdict) of backup plans (backup_id, keyspace_id): a keyspace without a live range,
    a sealed range among its own, or another backup of it that still runs refuses the plan."""
    held = ranges.groupBy("keyspace_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or("sealed").alias("some_sealed"))
    busy = running.select("keyspace_id").distinct().withColumn("busy", F.lit(True))
    rows = plans.join(held, "keyspace_id", "left").join(busy, "keyspace_id", "left")
    verdict = F.when(F.col("n").isNull(), "KeyspaceNotFound").when(F.coalesce("busy", F.lit(False)), "busy").when(F.col("some_sealed"), "sealed").otherwise("ok")
    return rows.select("backup_id", verdict.alias("verdict"))


def restore_stage(restores: DataFrame, loaded: DataFrame) -> DataFrame:
    """(restore_id, loaded, stage) in the same way."""
    counts = loaded.groupBy("restore_id").agg(F.countDistinct("range_id").alias("loaded"))
    rows = restores.join(counts, "restore_id", "left").withColumn("loaded", F.coalesce("loaded", F.lit(0)).cast("long"))
    stage = F.when(F.col("aborted"), "aborted").when(F.col("published"), "published").when(F.col("loaded") == 0, "intended").when(F.col("loaded") < F.col("ranges"), "loading").otherwise("loaded")
    return rows.select("restore_id", "loaded", stage.alias("stage"))


def abort_effective(aborts: DataFrame, published: DataFrame) -> DataFrame:
    """Aborts of operations that were not published before."""
    before = (aborts["operation"] == published["operation"]) & (published["position"] <= aborts["position"])
    return aborts.join(published, before, "left_anti")


def lost_voters(progress: DataFrame, now: int, patience: int) -> DataFrame:
    """(group_id, lost, action): replace lost voters only with three or more and a live majority."""
    dead = F.count(F.when(F.col("last_active") + patience < now, 1))
    counts = progress.groupBy("group_id").agg(F.count(F.lit(1)).alias("voters"), dead.alias("lost"))
    live = F.col("voters") - F.col("lost")
    action = F.when(F.col("lost") == 0, "none").when((F.col("voters") < 3) | (live <= F.floor(F.col("voters") / 2)), "wait").otherwise("replace")
    return counts.select("group_id", "lost", action.alias("action"))


def next_step(plans: DataFrame, evidence: DataFrame, steps: list[str]) -> DataFrame:
    """(plan_id, next): the first of the steps without evidence, or done."""
    done = evidence.groupBy("plan_id").agg(F.collect_set("step").alias("done"))
    rows = plans.join(done, "plan_id", "left").withColumn("done", F.coalesce("done", F.array().cast("array<string>")))
    open_ = F.filter(F.lit(steps), lambda s: ~F.array_contains(F.col("done"), s))
    return rows.select("plan_id", F.coalesce(F.get(open_, F.lit(0)), F.lit("done")).alias("next"))


def health(checks: list[DataFrame]) -> DataFrame:
    """(check, level) of all checks and overall, the worst of them."""
    rank = F.when(F.col("level") == "fail", 2).when(F.col("level") == "warn", 1).otherwise(0)
    rows = checks[0]
    for c in checks[1:]:
        rows = rows.unionByName(c)
    worst = rows.agg(F.max(rank).alias("rank"))
    level = F.when(F.col("rank") == 2, "fail").when(F.col("rank") == 1, "warn").otherwise("ok")
    return rows.unionByName(worst.select(F.lit("overall").alias("check"), level.alias("level")))


def quorum_margin(progress: DataFrame, now: int, patience: int) -> DataFrame:
    """(group_id, margin): live voters beyond the majority."""
    live = F.count(F.when(F.col("last_active") + patience >= now, 1))
    return progress.groupBy("group_id").agg((live - F.floor(F.count(F.lit(1)) / 2) - 1).cast("long").alias("margin"))


def placement_matrix(cells: DataFrame, nodes: list) -> DataFrame:
    """Groups by nodes: a node's own view of a group, else that it is a member."""
    shown = cells.withColumn("cell", F.coalesce("view", F.when(F.col("member"), F.lit("v"))))
    return shown.groupBy("group_id").pivot("node", nodes).agg(F.first("cell"))


def cas_outcome(attempts: DataFrame, current: DataFrame) -> DataFrame:
    """attempts (range_id, expected, change_id) with outcome against current (generation, change_id)."""
    now = current.select("range_id", "generation", F.col("change_id").alias("now_id"))
    rows = attempts.join(now, "range_id", "left")
    next_ = (F.col("generation") == F.col("expected") + 1) & (F.col("change_id") != "") & (F.col("now_id") != "")
    outcome = F.when(next_ & (F.col("now_id") == F.col("change_id")), "applied").when(next_, "not_applied").otherwise("unknown")
    return rows.select(*attempts.columns, F.coalesce(outcome, F.lit("unknown")).alias("outcome"))


def unreferenced(objects: DataFrame, references: DataFrame, name: str = "object") -> DataFrame:
    """Objects that no live reference names."""
    return objects.join(references.select(name), name, "left_anti")


def reference_counts(objects: DataFrame, references: DataFrame, name: str = "object") -> DataFrame:
    """(object, refs, deletable)."""
    counts = references.groupBy(name).agg(F.count(F.lit(1)).alias("refs"))
    rows = objects.select(name).join(counts, name, "left").withColumn("refs", F.coalesce("refs", F.lit(0)).cast("long"))
    return rows.withColumn("deletable", F.col("refs") == 0)


def retirable(pins: DataFrame, wanted: DataFrame) -> DataFrame:
    """(resource, retire): every owner is released and the revision is the expected one."""
    held = pins.groupBy("resource").agg(F.bool_and(F.coalesce(F.col("phase") == "Released", F.lit(False))).alias("free"), F.max("revision").alias("revision"))
    retire = F.coalesce("free", F.lit(True)) & (F.col("revision").isNull() | (F.col("revision") == F.col("expected")))
    return wanted.join(held, "resource", "left").select("resource", retire.alias("retire"))


def intervals(timeline: DataFrame, by: list[str], at: str = "since") -> DataFrame:
    """timeline with until: the next entry's time, null for the last."""
    return timeline.withColumn("until", F.lead(at).over(Window.partitionBy(*by).orderBy(at)))


def closed(rows: DataFrame, by: list[str], terminal: str = "terminal") -> DataFrame:
    """(by, closed): all are terminal; what is unknown is not closed."""
    return rows.groupBy(*by).agg(F.bool_and(F.coalesce(F.col(terminal), F.lit(False))).alias("closed"))


def latest_selection(rows: DataFrame, by: list[str], at: str) -> DataFrame:
    """The latest row of each group."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col(at)).alias("last")).select(*by, "last.*")
