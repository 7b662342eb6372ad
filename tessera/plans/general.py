"""Queries over the configuration index that need no text models: orphan references."""

from __future__ import annotations

from tessera.operators import orphans
from tessera.util import read

TABLES = ("objects", "routines", "calls", "type_refs")


def queries() -> dict:
    return {
        "p3_found": lambda s, d: orphans.orphans(*[read(s, d, t) for t in TABLES]).select("ref_table", "ref_id"),
        "p3_counts": lambda s, d: orphans.orphan_counts(*[read(s, d, t) for t in TABLES]),
    }


FOUND = r"""
    o AS (SELECT DISTINCT tenant_id, lower(trim(kind)) AS kind, lower(trim(name)) AS name, first_seen, deleted_at FROM objects),
    r AS (SELECT DISTINCT tenant_id, lower(trim(fqn)) AS fqn, first_seen, deleted_at FROM routines),
    refs AS (
        SELECT DISTINCT 'type_refs' AS ref_table, ref_id, seen_at, NOT EXISTS (
            SELECT 1 FROM o WHERE o.tenant_id = t.tenant_id AND o.kind = lower(trim(t.ref_kind)) AND o.name = lower(trim(t.ref_name)) AND o.first_seen <= t.seen_at AND (o.deleted_at IS NULL OR t.seen_at < o.deleted_at)) AS missing
        FROM type_refs t WHERE category = 'reference' AND ref_kind IS NOT NULL AND trim(ref_name) <> ''
        UNION ALL
        SELECT DISTINCT 'routines', routine_id, seen_at, NOT EXISTS (
            SELECT 1 FROM r WHERE r.tenant_id = t.tenant_id AND r.fqn = lower(regexp_replace(split_part(t.fqn, '::', 1), '@ext:.*$', '') || '::' || trim(t.override_target)) AND r.first_seen <= t.seen_at AND (r.deleted_at IS NULL OR t.seen_at < r.deleted_at))
        FROM routines t WHERE override_mode IS NOT NULL AND trim(override_target) <> ''
        UNION ALL
        SELECT DISTINCT 'calls', call_id, seen_at, NOT EXISTS (
            SELECT 1 FROM r WHERE r.tenant_id = t.tenant_id AND r.fqn = 'commonmodule.' || t.q || '.module.module::' || t.m AND r.first_seen <= t.seen_at AND (r.deleted_at IS NULL OR t.seen_at < r.deleted_at))
        FROM (SELECT c.call_id, c.seen_at, lower(trim(c.qualifier)) AS q, lower(trim(c.method)) AS m, x.tenant_id FROM calls c JOIN (SELECT DISTINCT routine_id, tenant_id FROM routines) x ON x.routine_id = c.caller_id WHERE c.method IS NOT NULL) t
        WHERE EXISTS (SELECT 1 FROM o WHERE o.kind = 'commonmodule' AND o.tenant_id = t.tenant_id AND o.name = t.q))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"WITH {FOUND} SELECT ref_table, ref_id FROM refs WHERE missing",
        "p3_counts": f"WITH {FOUND} SELECT ref_table, strftime(seen_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n_orphans FROM refs WHERE missing GROUP BY 1, 2",
    }
