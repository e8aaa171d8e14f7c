"""Catalog tables: lookups, scans, constraints, ids, joins over known keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.operators.ordering import carried, placed

FIRST_ID = 100
LAST_KEYSPACE = (1 << 24) - 1
TASK_PAGE, TASK_PAGE_MOST = 64, 256


def get(table: DataFrame, **pk) -> DataFrame:
    return reduce(lambda t, kv: t.where(F.col(kv[0]) == F.lit(kv[1])), pk.items(), table)


def after(columns: list[str], cursor: tuple) -> Column:
    """Whether the columns, as a tuple, are above a cursor."""
    out = F.lit(False)
    for c, v in reversed([*zip(columns, cursor)]):
        out = (F.col(c) > F.lit(v)) | ((F.col(c) == F.lit(v)) & out)
    return out


def scan_after(table: DataFrame, pk: list[str], cursor: tuple | None, limit: int) -> DataFrame:
    """The next page in primary-key order."""
    rows = table if cursor is None else table.where(after(pk, cursor))
    return rows.orderBy(*pk).limit(limit)


def index_scan(table: DataFrame, pk: list[str], **prefix) -> DataFrame:
    """Primary keys of the rows with these index columns."""
    return get(table, **prefix).select(*pk)


def seek_index(table: DataFrame, probes: DataFrame, prefix: list[str], key: str) -> DataFrame:
    """probes (prefix columns, probe) with the row of the same prefix whose key is the last at or below probe.

    The reverse seek of a secondary index: null where no row is below.
    """
    have = table.select(*prefix, F.col(key).alias("at"), F.lit(0).alias("asked"), F.struct(*table.columns).alias("row"))
    want = probes.select(*prefix, F.col("probe").alias("at")).distinct().select(*prefix, "at", F.lit(1).alias("asked"), F.lit(None).cast(have.schema["row"].dataType).alias("row"))
    found = carried(have.unionByName(want), [*prefix, "at", "asked"], "row").where("asked = 1")
    same = reduce(lambda x, c: x & (F.col(f"row.{c}") == F.col(c)), prefix, F.col("row").isNotNull())
    found = found.select(*prefix, F.col("at").alias("probe"), F.when(same, F.col("row")).alias("row"))
    return probes.join(found, [*prefix, "probe"], "left")


def update(table: DataFrame, changes: DataFrame, pk: list[str]) -> DataFrame:
    """table with the changed columns of changes, nulls among them; rows that are not there change nothing.

    Columns that changes does not have, known or not, stay as they are.
    """
    other = [c for c in changes.columns if c not in pk]
    new = changes.select(*pk, *[F.col(c).alias(f"new_{c}") for c in other], F.lit(True).alias("changed"))
    rows = table.join(new, pk, "left")
    return rows.select(*[F.when(F.col("changed"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in other else F.col(c) for c in table.columns])


def insert(table: DataFrame, rows: DataFrame, pk: list[str], unique: list[str] | None = None, fk: str | None = None, parents: DataFrame | None = None, parent_key: str | None = None) -> DataFrame:
    """rows with verdict: what the first check that fails says, or ok.

    Checks, in this order: the primary key is there or comes twice (WriteConflict), the
    reference fk, where there is one, has no parent (ForeignKey), the unique columns are
    there or come twice (Unique).
    """
    def met(columns: list[str]) -> tuple[DataFrame, Column]:
        return table.select(*columns).distinct().withColumn("there", F.lit(True)), F.count(F.lit(1)).over(Window.partitionBy(*columns)) > 1

    held, twice = met(pk)
    checked = rows.join(held, pk, "left").withColumn("conflict", F.coalesce("there", F.lit(False)) | twice).drop("there")
    if fk is not None:
        known = parents.select(F.col(parent_key).alias(fk)).distinct().withColumn("there", F.lit(True))
        checked = checked.join(known, fk, "left").withColumn("orphan", F.col(fk).isNotNull() & F.col("there").isNull()).drop("there")
    if unique is not None:
        held, twice = met(unique)
        whole = reduce(lambda x, c: x & F.col(c).isNotNull(), unique, F.lit(True))
        checked = checked.join(held, unique, "left").withColumn("again", whole & (F.coalesce("there", F.lit(False)) | twice)).drop("there")
    verdict = F.when(F.col("conflict"), "WriteConflict")
    verdict = verdict if fk is None else verdict.when(F.col("orphan"), "ForeignKey")
    verdict = verdict if unique is None else verdict.when(F.col("again"), "Unique")
    return checked.select(*rows.columns, verdict.otherwise("ok").alias("verdict"))


def delete(table: DataFrame, keys: DataFrame, pk: list[str], child: DataFrame | None = None, fk: str | None = None) -> DataFrame:
    """table without the rows of keys, but for those that a child row refers to, which stay (RESTRICT)."""
    gone = keys.select(*pk)
    if child is not None:
        gone = gone.join(child.select(F.col(fk).alias(pk[0])), pk[0], "left_anti")
    return table.join(gone, pk, "left_anti")


def list_keyspaces(keyspaces: DataFrame, regions: DataFrame) -> DataFrame:
    """(keyspace_id, name, tenant_id, regions), regions being how many it has."""
    held = regions.groupBy("keyspace_id").agg(F.count(F.lit(1)).alias("regions"))
    return keyspaces.join(held, "keyspace_id", "left").select("keyspace_id", "name", "tenant_id", F.coalesce("regions", F.lit(0)).cast("long").alias("regions"))


def slice_diff(have: DataFrame, want: DataFrame, pk: list[str]) -> DataFrame:
    """(pk, change): what makes one slice of the catalog another: insert, delete or replace."""
    other = [c for c in want.columns if c not in pk]
    left = have.select(*pk, F.struct(*other).alias("old"), F.lit(True).alias("had"))
    right = want.select(*pk, F.struct(*other).alias("new"), F.lit(True).alias("has"))
    rows = left.join(right, pk, "full_outer")
    change = F.when(F.col("had").isNull(), "insert").when(F.col("has").isNull(), "delete").when(~F.col("old").eqNullSafe(F.col("new")), "replace")
    return rows.select(*pk, change.alias("change")).where("change is not null")


def unique_violations(table: DataFrame, columns: list[str]) -> DataFrame:
    return table.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing_parents(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child rows whose reference, where there is one, has no parent."""
    held = child.where(F.col(fk).isNotNull())
    return held.join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def restricted(parents: DataFrame, child: DataFrame, pk: str, fk: str) -> DataFrame:
    """Parents that cannot be deleted, since a child refers to them."""
    return parents.join(child.select(F.col(fk).alias(pk)), pk, "left_semi")


def allocate_ids(rows: DataFrame, order: list[str], taken: int = 0, most: int | None = None) -> DataFrame:
    """rows with new_id from FIRST_ID + taken on, in order; beyond most it raises."""
    out = placed(rows, order).withColumn("new_id", (F.lit(FIRST_ID + taken) + F.col("place")).cast("long"))
    if most is not None:
        out = out.withColumn("new_id", F.when(F.col("new_id") <= most, F.col("new_id")).otherwise(F.raise_error(F.lit("ids exhausted")).cast("long")))
    return out.drop("place")


def list_tasks(tasks: DataFrame, cursor: int = 0, kind: str | None = None, limit: int = TASK_PAGE) -> DataFrame:
    """Tasks after a cursor, of one kind or all, by id."""
    if not 1 <= limit <= TASK_PAGE_MOST:
        raise ValueError("limit is 1 to 256")
    rows = tasks.where(F.col("id") > cursor)
    return (rows if kind is None else rows.where(F.col("kind") == kind)).orderBy("id").limit(limit)


def two_hop(links: DataFrame, rows: DataFrame, left: str, right: str) -> DataFrame:
    """Rows reached over a link table; links without a row are skipped."""
    return links.join(rows, links[left] == rows[right])


def committed_members(initial: DataFrame, joined: DataFrame, removed: DataFrame) -> DataFrame:
    """(group_id, node): initial and evidenced destinations without removed sources."""
    return initial.union(joined).join(removed, ["group_id", "node"], "left_anti")


def never_again(members: DataFrame, initial: DataFrame, removed: DataFrame) -> DataFrame:
    return members.union(initial).union(removed).distinct()


def group_listing(groups: DataFrame, **parts: DataFrame) -> DataFrame:
    """groups with one sorted array of structs for each part (group_id, ...)."""
    out = groups
    for name, part in parts.items():
        nested = part.groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in part.columns if c != "group_id"]))).alias(name))
        out = out.join(nested, "group_id", "left")
        out = out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))
    return out


def node_listing(nodes: DataFrame, progress: DataFrame, admissions: DataFrame, drains: DataFrame) -> DataFrame:
    """nodes with what is known of each; unknown parts are null."""
    return reduce(lambda out, part: out.join(part, "node", "left"), (progress, admissions, drains), nodes)


def row_class(table: Column) -> Column:
    """Which nodes a catalog row goes to."""
    everywhere = ("schema_version", "cluster_meta", "root_meta", "nodes", "node_admissions")
    return F.when(table.isin(*everywhere), "global").when(table.isin("tenants", "keyspaces", "gac_allotments", "placement_rules"), "keyspace").when(table.isin("regions", "region_peers", "sst_files"), "range").otherwise("root")


def admission_state(rows: DataFrame, now: int) -> DataFrame:
    """Admissions with effective state: a pending one past its time has expired."""
    late = (F.col("state") == "pending") & (F.col("expires_unix") <= now)
    return rows.withColumn("effective", F.when(late, "expired").otherwise(F.col("state")))
