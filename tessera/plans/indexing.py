"""Queries of the operators in ``operators.index``, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import code, docs, index, metadata, state, text
from tessera.plans import domain, dumps
from tessera.plans import graph as built
from tessera.plans.domain import KINDS, SINCE, Tables, edges, q
from tessera.plans.graph import calls, g

OPS: dict = {}


def op(name: str, sql: str | None = None):
    def add(f):
        OPS[name] = (f, sql)
        return f

    return add


PARTS = f"""SELECT DISTINCT ge.tenant_id, ge.dst || CASE rel WHEN 'HAS_ENUM_VALUE' THEN '#val' ELSE '#form' END AS chunk, {KINDS.replace('kind', 'o.kind', 1).replace('ELSE kind', 'ELSE o.kind')} || ' «' || coalesce(nullif(trim(o.synonym), ''), o.name) || '» ▸ ' || CASE rel WHEN 'HAS_ENUM_VALUE' THEN 'значение «' || string_split(ge.dst, '.')[-1] || '» (' || string_split(ge.dst, '.')[-1] || ')' ELSE 'форма «' || regexp_replace(string_split(ge.dst, '.')[-1], '@.*$', '') || '»' END AS text
    FROM ge JOIN (SELECT tenant_id, fqn, arg_min(kind, (config_id <> 'base', config_id)) AS kind, arg_min(name, (config_id <> 'base', config_id)) AS name, arg_min(struct_pack(s := synonym), (config_id <> 'base', config_id)).s AS synonym FROM oc GROUP BY 1, 2) o ON o.tenant_id = ge.tenant_id AND o.fqn = ge.src WHERE rel IN ('HAS_ENUM_VALUE', 'HAS_FORM')"""
op("op_T07_part_chunks", g(PARTS))(lambda t: index.part_chunks(built.nodes(t), built.edges(t)).select("tenant_id", "chunk", "text"))
op("op_T09_all_chunks")(lambda t: index.all_chunks(built.nodes(t), built.edges(t), text.code_chunks(t.routines, t.files, t.objects), text.doc_chunks(t.doc_units)))
TITLES = """, ti AS (SELECT tenant_id, fqn, arg_min(kind, (config_id <> 'base', config_id)) AS kind, arg_min(name, (config_id <> 'base', config_id)) AS name, coalesce(nullif(trim(arg_min(struct_pack(s := synonym), (config_id <> 'base', config_id)).s), ''), arg_min(name, (config_id <> 'base', config_id))) AS title FROM oc GROUP BY 1, 2),
ty AS (SELECT tenant_id, fqn, role, n, string_agg(DISTINCT raw, ', ' ORDER BY raw) AS types, bool_or(starts_with(raw, 'cfg:CatalogRef.')) AS to_catalog FROM ft GROUP BY 1, 2, 3, 4) """
RU = KINDS.replace("kind", "ti.kind", 1).replace("ELSE kind", "ELSE ti.kind")
op(
    "op_T05_object_chunks",
    g(TITLES + f"""SELECT ti.tenant_id, ti.fqn || '#object' AS chunk, {RU} || ' «' || title || '» (' || name || ')' || coalesce('. ' || CASE WHEN kind IN ('Catalog', 'Document') THEN 'Реквизиты: ' ELSE 'Поля: ' END || f, '') AS text
    FROM ti LEFT JOIN (SELECT tenant_id, fqn, array_to_string(list(n || ': ' || types ORDER BY role, n)[1:30], '; ') AS f FROM ty GROUP BY 1, 2) x ON x.tenant_id = ti.tenant_id AND x.fqn = ti.fqn"""),
)(lambda t: index.object_chunks(built.nodes(t), built.edges(t)).where("chunk_kind = 'object' and owner_fqn not like 'EventSubscription.%'").select("tenant_id", "chunk", "text"))
REQUIRED = "CASE WHEN length(n) % 2 = 0 THEN ' [обязательный реквизит]' ELSE '' END"
op(
    "op_T06_attribute_chunks",
    g(TITLES + f"""SELECT ti.tenant_id, ti.fqn || '.' || role || '.' || n || '#attr' AS chunk, {RU} || ' «' || title || '» ▸ ' || CASE role WHEN 'Dimension' THEN 'измерение' ELSE 'реквизит' END || ' «' || n || '» (' || n || '): ' || types || {REQUIRED} AS text FROM ti JOIN ty ON ty.tenant_id = ti.tenant_id AND ty.fqn = ti.fqn
    UNION ALL SELECT ti.tenant_id, ti.fqn || '.TabularSection.Строки.Attribute.' || n || '#tsattr', {RU} || ' «' || title || '» ▸ табличная часть «Строки» ▸ реквизит «' || n || '» (' || n || '): ' || types || {REQUIRED} FROM ti JOIN ty ON ty.tenant_id = ti.tenant_id AND ty.fqn = ti.fqn WHERE kind = 'Document' AND to_catalog"""),
)(lambda t: index.attribute_chunks(built.nodes(t), built.edges(t)).select("tenant_id", "chunk", "text"))
op(
    "op_T08_subsystem_role_chunks",
    g(TITLES + """SELECT tenant_id, 'Role.Полные#role' AS chunk, 'Роль «Полные» (Полные). Права на объекты: ' || array_to_string(list(x ORDER BY name, fqn)[1:40], '; ') AS text FROM (SELECT ba.tenant_id, ba.name, ba.fqn, title || ': Read' || CASE WHEN length(ba.name) % 2 = 0 THEN ', Update' ELSE '' END || CASE WHEN EXISTS (SELECT 1 FROM fl WHERE fl.tenant_id = ba.tenant_id AND fl.fqn = ba.fqn) THEN ', View' ELSE '' END AS x FROM ba JOIN ti ON ti.tenant_id = ba.tenant_id AND ti.fqn = ba.fqn) GROUP BY 1
    UNION ALL SELECT ba.tenant_id, 'Subsystem.Учёт.Subsystem.' || ba.kind || '#subsystem', 'Подсистема «' || ba.kind || '» (' || ba.kind || '). Состав: ' || array_to_string(list(title ORDER BY ba.name, ba.fqn)[1:40], '; ') FROM ba JOIN ti ON ti.tenant_id = ba.tenant_id AND ti.fqn = ba.fqn GROUP BY ba.tenant_id, ba.kind
    UNION ALL SELECT DISTINCT tenant_id, 'Subsystem.Учёт#subsystem', 'Подсистема «Учёт» (Учёт)' FROM ba"""),
)(lambda t: index.object_chunks(built.nodes(t), built.edges(t)).where("chunk_kind in ('role', 'subsystem')").select("tenant_id", "chunk", "text"))
op(
    "op_T16_routine_units",
    q("""SELECT routine_id, name AS display, start_line AS line, array_to_string((string_split(content, chr(10)))[least(greatest(before + 1, start_line - 40), start_line):end_line], chr(10))[1:40000] AS body
    FROM (SELECT *, coalesce(lag(end_line) OVER (PARTITION BY file_id ORDER BY start_line, routine_id), 0) AS before FROM r WHERE start_line >= 1 AND end_line >= start_line) x JOIN (SELECT DISTINCT file_id, content FROM files WHERE content IS NOT NULL) f USING (file_id)"""),
)(lambda t: index.routine_units(t.routines, t.files).select("routine_id", "display", "line", "body"))
op("op_T16_object_units")(lambda t: index.object_units(built.nodes(t), built.edges(t)))
op("op_C30_signatures")(lambda t: index.signatures(t.routines, t.files))
op("op_H09_name_index", q("SELECT tenant_id, low, string_agg(x, ',' ORDER BY x) AS found, count(*) AS n FROM (SELECT DISTINCT tenant_id, lower(name) AS low, kind || ' ' || fqn AS x FROM o WHERE name IS NOT NULL) GROUP BY 1, 2"))(lambda t: index.name_index(t.objects.where("name is not null")))
op("op_I06_reverse_index", q("SELECT tenant_id, split_part(fqn, '::', 1) AS module, name AS method, arg_max(fqn, routine_id) AS fqn FROM r GROUP BY 1, 2, 3"))(lambda t: index.reverse_index(t.routines))


def stale(t):
    """Owners of the files that changed lately: what a build has to take up again."""
    return t.routines.join(t.files.where(F.col("mtime") >= SINCE).select("file_id"), "file_id", "left_semi").select("tenant_id", F.col("object_fqn").alias("owner_fqn")).distinct()


STALE = f"(SELECT DISTINCT tenant_id, object_fqn FROM routines WHERE file_id IN (SELECT file_id FROM files WHERE mtime >= TIMESTAMP '{SINCE}'))"
op("op_I05_incremental_calls", domain.g(f"SELECT tenant_id, caller, callee FROM e WHERE (tenant_id, caller) NOT IN (SELECT (tenant_id, fqn) FROM r WHERE (tenant_id, object_fqn) IN (SELECT (tenant_id, object_fqn) FROM {STALE})) AND (tenant_id, caller) NOT IN (SELECT (tenant_id, caller) FROM e WHERE (tenant_id, callee) IN (SELECT (tenant_id, fqn) FROM r WHERE (tenant_id, object_fqn) IN (SELECT (tenant_id, object_fqn) FROM {STALE})))"))(
    lambda t: index.incremental_calls(edges(t).select("tenant_id", "caller", "callee"), stale(t), t.routines)[0]
)
op("op_H10_graph_inputs", g("SELECT ge.tenant_id, dst AS module, src AS owner_fqn, split_part(src, '.', 1) AS owner_kind, arg_min(gn.config_id, (gn.config_id <> 'base', gn.config_id)) AS config_id FROM ge JOIN gn ON gn.tenant_id = ge.tenant_id AND gn.fqn = dst AND gn.label IN ('Module', 'Form') WHERE rel IN ('HAS_MODULE', 'HAS_FORM') GROUP BY 1, 2, 3, 4"))(lambda t: index.graph_inputs(built.edges(t), built.nodes(t)))
HASH = "sha1(text || chr(0))"
op("op_I07_to_embed", q(f"SELECT fqn AS chunk, {HASH} AS text_hash FROM (SELECT fqn, min(text) AS text FROM k WHERE text IS NOT NULL GROUP BY 1) WHERE (fqn, {HASH}) NOT IN (SELECT (fqn, {HASH}) FROM k WHERE text IS NOT NULL AND chunk_id % 3 = 0)"))(lambda t: embed(t)[0].select("chunk", "text_hash"))
op("op_I07_gone", q("SELECT DISTINCT fqn AS chunk FROM k WHERE chunk_kind = 'object' AND text IS NOT NULL AND chunk_id % 3 = 0"))(lambda t: embed(t, "chunk_kind <> 'object'")[1])


def embed(t, there: str = "true"):
    k = t.chunks.where("text is not null").dropDuplicates(["chunk_id"])
    now = k.where(there).groupBy(F.col("fqn").alias("chunk")).agg(F.min("text").alias("text"))
    return index.to_embed(now, k.where("chunk_id % 3 = 0").select(F.col("fqn").alias("chunk"), text.sha1_text(F.col("text")).alias("text_hash")))


def overlay(t):
    """The extensions' objects as what tasks have touched, deleted objects as what they have deleted."""
    return index.overlay_sets(metadata.current(t.objects).where("config_id <> 'base'"), t.objects.where("deleted_at is not null"))


GONE = "gone AS (SELECT DISTINCT tenant_id, fqn FROM objects WHERE deleted_at IS NOT NULL AND (tenant_id, fqn) NOT IN (SELECT (tenant_id, fqn) FROM o WHERE config_id <> 'base'))"
op("op_I09_overlay_sets", q(f", {GONE} SELECT DISTINCT tenant_id, fqn, 'touched' AS state FROM o WHERE config_id <> 'base' UNION ALL SELECT tenant_id, fqn, 'tombstone' FROM gone").replace("\n, gone", ", gone"))(overlay)
op("op_H11_masked_routines", q(f", {GONE} SELECT tenant_id, name, bool_and((tenant_id, object_fqn) IN (SELECT (tenant_id, fqn) FROM gone)) AS masked FROM r GROUP BY 1, 2").replace("\n, gone", ", gone"))(lambda t: index.masked_routines(t.routines, overlay(t).where("state = 'tombstone'")))
op("op_I12_overlay_callees", domain.g("SELECT DISTINCT callee AS fqn, kind AS via, 'working' AS layer FROM e WHERE contains(caller, '@ext:') UNION ALL SELECT DISTINCT callee, kind, 'release' FROM e WHERE NOT contains(caller, '@ext:') AND callee NOT IN (SELECT callee FROM e WHERE contains(caller, '@ext:'))"))(lambda t: state.overlay_callees(layer(t, False), layer(t, True)))


def layer(t, over: bool):
    inside = F.col("caller").contains("@ext:")
    return edges(t).where(inside if over else ~inside).select(F.col("callee").alias("fqn"), F.col("kind").alias("via"))


op("op_I16_status", f"SELECT f.tenant_id, count(*) AS n_files, count(i.path) AS n_indexed, sum((i.path IS NULL OR f.mtime IS DISTINCT FROM i.mtime)::INT)::BIGINT AS n_changed, any_value(coalesce(n, 0)) AS n_units, CASE WHEN count(i.path) = 0 THEN 'missing' WHEN any_value(coalesce(n, 0)) = 0 THEN 'empty' WHEN sum((i.path IS NULL OR f.mtime IS DISTINCT FROM i.mtime)::INT) > 0 THEN 'outdated' ELSE 'built' END AS state FROM files f LEFT JOIN (SELECT * FROM files WHERE mtime < TIMESTAMP '{SINCE}' OR mtime IS NULL) i USING (tenant_id, path) LEFT JOIN (SELECT tenant_id, count(DISTINCT id) AS n FROM symbols GROUP BY 1) s ON s.tenant_id = f.tenant_id GROUP BY 1")(
    lambda t: index.status(t.files, t.files.where((F.col("mtime") < SINCE) | F.col("mtime").isNull()), t.symbols.dropDuplicates(["id"]))
)
op("op_I16_orphans", f"SELECT DISTINCT id FROM symbols WHERE (tenant_id, path) NOT IN (SELECT (tenant_id, path) FROM files WHERE mtime < TIMESTAMP '{SINCE}')")(lambda t: index.orphans_of_index(t.symbols.dropDuplicates(["id"]), t.files.where(F.col("mtime") < SINCE)).select("id"))
op("op_K09_snapshot", q("SELECT tenant_id, fqn, min(config_version) AS version FROM o GROUP BY 1, 2"))(lambda t: index.snapshot(t.objects))
op("op_I08_snapshot_diff", q(f"SELECT tenant_id, fqn, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT tenant_id, fqn, min(config_version) AS v, 1 AS n FROM (SELECT DISTINCT * FROM objects WHERE first_seen < TIMESTAMP '{SINCE}') GROUP BY 1, 2) a FULL JOIN (SELECT tenant_id, fqn, min(config_version) AS v, 1 AS n FROM o GROUP BY 1, 2) b USING (tenant_id, fqn) WHERE a.n IS NULL OR b.n IS NULL OR a.v IS DISTINCT FROM b.v"))(
    lambda t: index.snapshot_diff(index.snapshot(t.objects.where(F.col("first_seen") < SINCE).withColumn("deleted_at", F.lit(None).cast("timestamp"))), index.snapshot(t.objects))
)
op("op_H05_file_version", "SELECT tenant_id, path, sha1(content) AS version FROM files WHERE lower(path) LIKE '%.mdo' AND content IS NOT NULL")(lambda t: index.file_version(t.files))
op("op_K03_documents", q("SELECT source || ':' || external_id AS fqn, CASE WHEN source = 'artifact' THEN 'Artifact' ELSE 'Document' END AS label, title, version_hash FROM latest"))(lambda t: index.document_links(t.doc_units, t.objects)[0])
MENTION = r"(?:^|[^\p{L}\p{N}_.])((?:Catalog|Document|Enum|Constant|Report|DataProcessor|InformationRegister|AccumulationRegister|CommonModule)\.[\p{L}_][\p{L}\p{N}_]*)"
op("op_K03_mentions", q(f"SELECT DISTINCT source || ':' || external_id AS src, x AS dst FROM (SELECT source, external_id, unnest(coalesce(links, []) || coalesce(regexp_extract_all(text, '{MENTION}', 1), [])) AS x FROM latest) WHERE x IN (SELECT fqn FROM o)"))(lambda t: index.document_links(t.doc_units, t.objects)[1].where("rel = 'MENTIONS'").select("src", "dst"))


def manifest(t):
    entries = [{"type": "its"}, {"type": "git", "source": "artifact"}]
    units = lambda e: t.doc_units.where(F.col("source") == e.get("source", e["type"])).groupBy("external_id").agg(F.max_by("version_hash", F.struct("updated_at", "unit_id")).alias("version_hash"))
    stored = t.doc_units.where(F.col("updated_at") < SINCE).groupBy("source", "external_id").agg(F.max_by("version_hash", F.struct("updated_at", "unit_id")).alias("version_hash"))
    return index.ingest_manifest(entries, {"its": units, "git": units}, stored)


def ingest_diff_sql() -> str:
    pick = "SELECT source, external_id, arg_max(version_hash, (updated_at, unit_id)) AS v, 1 AS n FROM d WHERE source IN ('its', 'artifact')"
    return q(f"SELECT source, external_id, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM ({pick} AND updated_at < TIMESTAMP '{SINCE}' GROUP BY 1, 2) a FULL JOIN ({pick} AND updated_at IS NOT NULL GROUP BY 1, 2) b USING (source, external_id) WHERE a.n IS NULL OR b.n IS NULL OR a.v IS NULL OR a.v IS DISTINCT FROM b.v")


op("op_D07_ingest_manifest", ingest_diff_sql())(manifest)
MODULES = "(SELECT tenant_id, object_fqn, list_sort(list(DISTINCT CASE WHEN fqn LIKE '%.Form.%' THEN 'Form:' || regexp_extract(fqn, '\\.Form\\.([^.@:]+)', 1) ELSE module_type END)) AS a FROM r WHERE object_fqn IS NOT NULL AND module_type IS NOT NULL GROUP BY 1, 2)"
op("op_H06_pick_module", q(f"SELECT tenant_id, object_fqn, CASE WHEN list_contains(a, 'Module') THEN 'Module' WHEN len(a) = 1 THEN a[1] END AS module, array_to_string(a, ',') AS available FROM {MODULES}"))(lambda t: index.pick_module(module_rows(t)))
op("op_H06_pick_alias", q(f"SELECT tenant_id, object_fqn, CASE WHEN list_contains(a, 'ManagerModule') THEN 'ManagerModule' END AS module FROM {MODULES}"))(lambda t: index.pick_module(module_rows(t), "Manager").drop("available"))


def module_rows(t):
    form = F.regexp_extract("fqn", r"\.Form\.([^.@:]+)", 1)
    return code.live_routines(t.routines).where("object_fqn is not null and module_type is not null").select("tenant_id", "object_fqn", "module_type", F.when(form != "", form).alias("form"))


op(
    "op_A07_overview",
    domain.g("""SELECT tenant_id, 'objects_by_kind' AS metric, kind AS key, count(*) AS n FROM o GROUP BY 1, 3 UNION ALL SELECT tenant_id, 'objects_by_config', config_id, count(*) FROM o GROUP BY 1, 3 UNION ALL SELECT tenant_id, 'routines', NULL, count(*) FROM r GROUP BY 1
    UNION ALL SELECT tenant_id, 'calls', kind || '/' || confidence, count(*) FROM e GROUP BY 1, 3 UNION ALL SELECT tenant_id, 'overrides', override_mode, count(*) FROM r WHERE override_mode IS NOT NULL AND override_target IS NOT NULL AND contains(split_part(fqn, '::', 1), '@ext:') GROUP BY 1, 3
    UNION ALL SELECT tenant_id, 'modules', NULL, count(*) FROM files WHERE kind = 'bsl' GROUP BY 1 UNION ALL SELECT tenant_id, 'code_bytes', NULL, sum(coalesce(strlen(content), 0))::BIGINT FROM files WHERE kind = 'bsl' GROUP BY 1
    UNION ALL SELECT tenant_id, 'entry_points', category, count(*) FROM (SELECT * FROM r JOIN (VALUES ('обработкапроведения', 'проведение'), ('posting', 'проведение'), ('передзаписью', 'запись'), ('призаписи', 'запись'), ('передудалением', 'удаление'), ('обработказаполнения', 'заполнение')) v(low, category) ON low = lower(name)) GROUP BY 1, 3"""),
)(lambda t: index.overview(t.objects, t.routines, calls(t), code.override_edges(t.routines), t.files))

op("op_P12_object_keys", f"WITH {domain.KINDS_SQL} SELECT file_id, '0/' || path AS key, k || '.' || regexp_replace(regexp_extract(path, '^(?:src/)?[A-Za-z]+/([^/]+)', 1), '\\.[A-Za-z]+$', '') AS fqn FROM files LEFT JOIN kinds ON folder = regexp_extract(path, '^(?:src/)?([A-Za-z]+)/', 1)")(lambda t: t.files.select("file_id", F.concat(F.lit("0/"), "path").alias("key")).withColumn("fqn", metadata.fqn_from_object_key(F.col("key"))))
op("op_P10_artifacts", "SELECT file_id, CASE WHEN lower(path) LIKE '%.bsl' THEN 'module' WHEN lower(path) LIKE '%.form' OR lower(path) LIKE '%/ext/form.xml' THEN 'form_layout' WHEN lower(path) LIKE '%.mdo' OR (lower(path) LIKE '%.xml' AND len(string_split(path, '/')) = 2) THEN 'meta' ELSE 'other' END AS what FROM files")(lambda t: t.files.select("file_id", metadata.artifact_of(F.col("path")).alias("what")))
op("op_P06_split_fqn", q("SELECT DISTINCT dst, CASE WHEN contains(dst, '.') THEN split_part(dst, '.', 1) ELSE 'Unresolved' END AS kind, CASE WHEN contains(dst, '.') THEN dst[instr(dst, '.') + 1:] ELSE dst END AS name FROM (SELECT dst FROM refs UNION SELECT substr(dst, instr(dst, '.') + 1) FROM refs)"))(
    lambda t: metadata.reference_edges(t.type_refs).select(F.explode(F.array("dst", F.regexp_replace("dst", r"^[^.]*\.", ""))).alias("dst")).distinct().select("dst", metadata.split_fqn(F.col("dst")).alias("f")).select("dst", "f.kind", "f.name")
)
op("op_Q10_usage_objects", g("SELECT tenant_id, object, n_lines, count(*) OVER () AS total FROM (SELECT own.tenant_id, own.fqn AS object, count(DISTINCT own.config_id) AS n_lines FROM own JOIN ft ON ft.tenant_id = own.tenant_id AND ft.fqn = own.fqn WHERE regexp_matches(raw, '^cfg:" + domain.KIND + "Ref\\.\\s*" + domain.NAME + "$') GROUP BY 1, 2) ORDER BY n_lines DESC, tenant_id, object LIMIT 40"))(lambda t: metadata.usage_report(dumps.files(t), domain.KIND, domain.NAME)[1])
op("op_Q16_overview", q("SELECT o2.tenant_id, o2.config_id, n_objects, n_kinds, top, coalesce(n_files, 0) AS n_files, coalesce(n_modules, 0) AS n_modules FROM (SELECT tenant_id, config_id, sum(n)::BIGINT AS n_objects, count(*) AS n_kinds, array_to_string(list(kind || ':' || n ORDER BY n DESC, kind)[1:5], ',') AS top FROM (SELECT tenant_id, config_id, kind, count(*) AS n FROM o GROUP BY 1, 2, 3) GROUP BY 1, 2) o2 LEFT JOIN (SELECT tenant_id, source AS config_id, count(*) AS n_files, sum((lower(path) LIKE '%.bsl')::INT)::BIGINT AS n_modules FROM files GROUP BY 1, 2) f USING (tenant_id, config_id)"))(lambda t: metadata.overview(t.objects, t.files))
op("op_S27_access", "SELECT doc_id FROM documents WHERE coalesce(CASE WHEN lang = 'inherited' THEN source ELSE lang END, '') NOT IN ('ru', 'en')")(lambda t: docs.accepted(t.documents.select("doc_id", F.col("lang").alias("access"), F.col("source").alias("inherited")), "restricted", ("ru", "en")).select("doc_id"))
op("op_V20_standards", q("SELECT DISTINCT 'std ' || regexp_extract(external_id, '([0-9]+)', 1) AS q, 'its:' || external_id AS fqn, title FROM latest WHERE source = 'its' AND regexp_matches(external_id, '^its-[0-9]+$')"))(lambda t: standards(t))


def standards(t):
    its = t.doc_units.where("source = 'its'").where(F.col("external_id").rlike("^its-[0-9]+$"))
    asked = its.select(F.concat(F.lit("std "), F.regexp_extract("external_id", "([0-9]+)", 1)).alias("q"))
    return docs.get_standards(its, asked, "its-").select("q", "fqn", "title")


def queries() -> dict:
    return {name: (lambda spark, d, f=f: f(Tables(spark, d))) for name, (f, _) in OPS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in OPS.items() if sql}
