"""Incremental state: diffs by version, staleness, overlays with tombstones, live merges, upserts.

Everything is joins on keys between two tables; nothing is kept on the driver, and a run on unchanged input
changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["tenant_id", "fqn"]


def changed_fqns(stored: DataFrame, refs: DataFrame) -> DataFrame:
    """Fqns of which any part is new or differs, and those deleted. ``stored``: KEYS and version;
    ``refs``: KEYS, version, one row per part. A part without a version counts only where the fqn is new."""
    s = stored.select(*KEYS, F.col("version").alias("old"), F.lit(True).alias("was")).dropDuplicates(KEYS)
    r = refs.groupBy(*KEYS).agg(F.collect_set("version").alias("new"), F.lit(True).alias("is"))
    j = s.join(r, KEYS, "full")
    differs = F.exists("new", lambda v: ~v.eqNullSafe(F.col("old")))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(differs, "changed")
    return j.select(*KEYS, change.alias("change")).where("change is not null")


def stale_chunk_owners(owners: DataFrame, chunks: DataFrame) -> DataFrame:
    """Owners without chunks, or whose version is not among their chunks' versions. An owner without a
    version is not stale once it has chunks with one."""
    c = chunks.groupBy("tenant_id", F.col("owner_fqn").alias("fqn")).agg(F.collect_set("version").alias("versions"), F.count(F.lit(1)).alias("n"))
    j = owners.select(*KEYS, "version").join(c, KEYS, "left")
    stale = F.col("n").isNull() | (F.size("versions") == 0) | ~F.array_contains("versions", F.col("version"))
    return j.where(stale).select(*KEYS)


def stale_routine_owners(modules: DataFrame) -> DataFrame:
    """Owners with a module whose build stamp is missing or of another version (owner_fqn, version,
    graph_built, graph_version)."""
    stale = ~F.coalesce("graph_built", F.lit(False)) | ~F.col("version").eqNullSafe(F.col("graph_version"))
    return modules.where(stale).select("tenant_id", "owner_fqn").distinct()


def stamp(modules: DataFrame, built: DataFrame) -> DataFrame:
    """Modules with the stamp of what was built; others keep theirs."""
    b = built.select("tenant_id", "owner_fqn").distinct().withColumn("now", F.lit(True))
    return modules.join(b, ["tenant_id", "owner_fqn"], "left").select(*[c for c in modules.columns if c not in ("graph_built", "graph_version")], F.coalesce("now", "graph_built").alias("graph_built"), F.when(F.col("now"), F.col("version")).otherwise(F.col("graph_version")).alias("graph_version"))


def needs_full_rebuild(stale: DataFrame) -> DataFrame:
    """A stale common module means that calls anywhere may resolve anew."""
    return stale.groupBy("tenant_id").agg(F.max(F.col("owner_fqn").startswith("CommonModule.")).alias("full"))


def merge_edge_rows(base: DataFrame, overlay: DataFrame, touched: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Edges (src, rel, dst) as a task sees them: the overlay's first, the base's only where their source
    is neither touched nor a tombstone and the same (rel, dst) is not in the overlay; tagged by layer."""
    gone = tombstones.select(F.col("fqn").alias("src")).distinct()
    over = overlay.join(gone, "src", "left_anti").select("src", "rel", "dst").distinct().withColumn("layer", F.lit("working"))
    hidden = touched.select(F.col("fqn").alias("src")).union(gone).distinct()
    rest = base.join(hidden, "src", "left_anti").join(over.select("rel", "dst").distinct(), ["rel", "dst"], "left_anti").select("src", "rel", "dst").distinct().withColumn("layer", F.lit("release"))
    return over.unionByName(rest)


def tag_layer(rows: DataFrame, tombstones: DataFrame, layer: str) -> DataFrame:
    """Rows of a layer without those whose target is a tombstone."""
    return rows.join(tombstones.select(F.col("fqn").alias("dst")).distinct(), "dst", "left_anti").withColumn("layer", F.lit(layer))


def overlay_callees(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """Callees (fqn, via): the overlay's wins per fqn; the base's stay even where the caller is touched."""
    over = overlay.select("fqn", "via").distinct().withColumn("layer", F.lit("working"))
    return over.unionByName(base.join(over, "fqn", "left_anti").select("fqn", "via").distinct().withColumn("layer", F.lit("release")))


def live_merge(indexed: DataFrame, fresh: DataFrame, dirty: DataFrame) -> DataFrame:
    """Rows of dirty files are replaced by those of a fresh parse."""
    keys = ["tenant_id", "path"]
    d = dirty.select(*keys).distinct()
    return indexed.join(d, keys, "left_anti").unionByName(fresh.join(d, keys, "left_semi").select(*indexed.columns))


def file_delta(stored: DataFrame, listing: DataFrame) -> DataFrame:
    """Files added, updated or removed by their times; an unknown time counts as updated."""
    keys = ["tenant_id", "path"]
    s = stored.select(*keys, F.col("mtime").alias("old"), F.lit(True).alias("was"))
    n = listing.select(*keys, F.col("mtime").alias("new"), F.lit(True).alias("is"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("old").isNull() | F.col("new").isNull() | (F.col("old") != F.col("new")), "updated")
    return s.join(n, keys, "full").select(*keys, change.alias("change")).where("change is not null")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows update what they name and are added otherwise. Columns that ``rows`` lacks are kept; a null
    in ``rows`` removes the value. Of several rows with a key one is taken."""
    new = rows.dropDuplicates(keys).withColumn("__is", F.lit(True))
    t, n = table.alias("t"), new.alias("n")
    on = [F.col(f"t.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    j = t.join(n, on, "full")
    cols = []
    for c in [*table.columns, *[c for c in rows.columns if c not in table.columns]]:
        if c in keys:
            cols.append(F.coalesce(f"t.{c}", f"n.{c}").alias(c))
        elif c not in rows.columns:
            cols.append(F.col(f"t.{c}").alias(c))
        elif c not in table.columns:
            cols.append(F.col(f"n.{c}").alias(c))
        else:
            cols.append(F.when(F.col("n.__is"), F.col(f"n.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
    return j.select(*cols)


def write_chunks(chunks: DataFrame, owners: DataFrame) -> DataFrame:
    """Chunks whose owner exists."""
    return chunks.join(owners.select("tenant_id", F.col("fqn").alias("owner_fqn")).distinct(), ["tenant_id", "owner_fqn"], "left_semi")


def without(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """A table without the rows of some keys."""
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def base_tenant(tenant: Column) -> Column:
    """``base@task/id`` -> base."""
    return F.substring_index(tenant, "@task/", 1)


def task_of(tenant: Column) -> Column:
    """The task of an overlay tenant, null for others."""
    return F.when(tenant.contains("@task/"), F.substring_index(tenant, "@task/", -1))


def fingerprint(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """A hash per group that does not depend on the rows' order."""
    h = F.xxhash64(*columns).cast("decimal(38,0)")
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(h).cast("string").alias("fingerprint"))
