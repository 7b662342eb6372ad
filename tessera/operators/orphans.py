"""Problem 3: references to records that do not exist, per table and period.

Method: parent keys and child keys are unioned in long form and grouped by parent table and key. The
group holds the parents' periods of validity and how many children it has over which span, so a hot
key shrinks map-side to one row. Only groups that do not cover the span of their children at once
are kept; their children, and no others, are looked at one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def norm(c: Column) -> Column:
    """Names are equal whatever their case and outer white space."""
    return F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", ""))


def parents(objects: DataFrame, routines: DataFrame) -> DataFrame:
    """(parent_table, tenant_id, key, since, until): the periods in which a target is there."""
    o = objects.select(F.lit("objects").alias("parent_table"), "tenant_id", F.concat_ws("\x1f", norm(F.col("kind")), norm(F.col("name"))).alias("key"), F.col("first_seen").alias("since"), F.col("deleted_at").alias("until")).where("kind is not null and name is not null")
    r = routines.select(F.lit("routines").alias("parent_table"), "tenant_id", norm(F.col("fqn")).alias("key"), F.col("first_seen").alias("since"), F.col("deleted_at").alias("until"))
    return o.unionByName(r).where("tenant_id is not null and key is not null and since is not null")


def references(objects: DataFrame, routines: DataFrame, calls: DataFrame, type_refs: DataFrame) -> DataFrame:
    """(ref_table, ref_id, tenant_id, parent_table, key, seen_at): every reference with its target's key.

    No reference: a null or blank name, a reference without tenant or seen_at, a call of an unknown
    caller, a qualifier that is no common module of the tenant. Repeated rows may occur.
    """
    t = type_refs.where("category = 'reference' and ref_kind is not null and ref_name is not null").select(
        F.lit("type_refs").alias("ref_table"), F.col("ref_id").alias("ref_id"), "tenant_id", F.lit("objects").alias("parent_table"), F.concat_ws("\x1f", norm(F.col("ref_kind")), norm(F.col("ref_name"))).alias("key"), "seen_at", norm(F.col("ref_name")).alias("name")
    )
    module = F.regexp_replace(F.substring_index("fqn", "::", 1), r"@ext:.*$", "")
    o = routines.where("override_mode is not null and override_target is not null").select(
        F.lit("routines").alias("ref_table"), F.col("routine_id").alias("ref_id"), "tenant_id", F.lit("routines").alias("parent_table"), norm(F.concat(module, F.lit("::"), F.regexp_replace("override_target", r"^[\s ]+|[\s ]+$", ""))).alias("key"), "seen_at", norm(F.col("override_target")).alias("name")
    )
    common = objects.where("kind = 'CommonModule' and name is not null").select("tenant_id", norm(F.col("name")).alias("q")).distinct()
    callers = routines.where("routine_id is not null and tenant_id is not null").groupBy(F.col("routine_id").alias("caller_id")).agg(F.min("tenant_id").alias("tenant_id"))
    c = (
        calls.where("qualifier is not null and method is not null and caller_id is not null")
        .select("call_id", "caller_id", norm(F.col("qualifier")).alias("q"), norm(F.col("method")).alias("name"), "seen_at")
        .join(common.select("q").distinct(), "q", "left_semi")
        .join(callers, "caller_id")
        .join(common, ["tenant_id", "q"], "left_semi")
        .select(F.lit("calls").alias("ref_table"), F.col("call_id").alias("ref_id"), "tenant_id", F.lit("routines").alias("parent_table"), F.concat(F.lit("commonmodule."), "q", F.lit(".module.module::"), "name").alias("key"), "seen_at", "name")
    )
    return t.unionByName(o).unionByName(c).where("tenant_id is not null and key is not null and seen_at is not null and name <> '' and ref_id is not null").drop("name")


def orphans(objects: DataFrame, routines: DataFrame, calls: DataFrame, type_refs: DataFrame) -> DataFrame:
    """(ref_table, ref_id, tenant_id, key, seen_at): references whose target isn't there at their time, each id once."""
    refs = references(objects, routines, calls, type_refs)
    key = ["parent_table", "tenant_id", "key"]
    long = (
        parents(objects, routines).distinct()
        .select(*key, F.struct("since", "until").alias("period"), F.lit(None).cast("timestamp").alias("seen_at"))
        .unionByName(refs.select(*key, F.lit(None).cast("struct<since:timestamp,until:timestamp>").alias("period"), "seen_at"))
    )
    groups = long.groupBy(*key).agg(F.collect_set("period").alias("periods"), F.min("seen_at").alias("first"), F.max("seen_at").alias("last"))
    covered = F.exists("periods", lambda p: (p["since"] <= F.col("first")) & (p["until"].isNull() | (F.col("last") < p["until"])))
    doubtful = groups.where(F.col("first").isNotNull() & ~covered).select(*key, "periods", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    there = F.exists("periods", lambda p: (p["since"] <= F.col("seen_at")) & (p["until"].isNull() | (F.col("seen_at") < p["until"])))
    found = refs.withColumn("salt", F.pmod(F.xxhash64("ref_table", "ref_id"), F.lit(SALTS)).cast("int")).join(doubtful, [*key, "salt"]).where(~there)
    return found.groupBy("ref_table", "ref_id").agg(*[F.min(c).alias(c) for c in ("tenant_id", "key", "seen_at")])


def orphan_counts(objects: DataFrame, routines: DataFrame, calls: DataFrame, type_refs: DataFrame) -> DataFrame:
    """Orphan references per table and month of seen_at."""
    return orphans(objects, routines, calls, type_refs).groupBy("ref_table", F.date_format("seen_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n_orphans"))
