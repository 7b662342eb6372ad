"""Queries of the engine's operators over the configuration index, each with its SQL where there is one.

``OPS`` maps a name ``op_<id>_<what>`` to a Spark callable and a SQL text or None.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import code, docs, metadata, metrics, search, state, text
from tessera.plans import dumps
from tessera.sources import bsl, help, metadata_xml, trees
from tessera.util import read, shared_dir

KIND, NAME, TERM = "Catalog", "ПартнерыУчета", "склад"
MODULE, ROUTINE, FILE = "CommonModule.ДиалогиИСообщения", "ПоказатьЗамечание", "CommonModules/ДиалогиИСообщения/Ext/Module.bsl"
HOOKED = "Catalog.ОтборВодителейЧерновик"
USAGE, CALL = r"Справочник\.[А-Яа-яЁё]+", r"Выполнить\(\)"
TEXTS = {1: "учёт тары сохраняет версии объекта", 2: "Найти склад приход", 3: "shift planner enum values"}
SINCE = "2023-07-01"


class Tables:
    """The tables of one scale, read when asked for."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name):
        return read(self.spark, self.sf_dir, name)


OPS: dict = {}


def op(name: str, sql: str | None = None):
    def add(f):
        OPS[name] = (f, sql)
        return f

    return add


BASE = """WITH o AS (SELECT DISTINCT * FROM objects WHERE deleted_at IS NULL),
r AS (SELECT DISTINCT * FROM routines WHERE deleted_at IS NULL),
s AS (SELECT DISTINCT * FROM symbols),
t AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM type_refs),
c AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM calls),
d AS (SELECT DISTINCT unit_id, external_id, source, title, text, version_hash, section_path, links, updated_at FROM doc_units),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, external_id ORDER BY updated_at DESC NULLS LAST, unit_id DESC) AS nth FROM d) WHERE nth = 1),
k AS (SELECT DISTINCT * FROM chunks),
refs AS (SELECT DISTINCT tenant_id, owner_fqn AS src, ref_kind || '.' || trim(ref_name) AS dst, 'REFERENCES' AS rel FROM t WHERE category = 'reference' AND ref_kind IS NOT NULL AND trim(ref_name) <> '' AND owner_fqn IS NOT NULL)
"""


def q(body: str) -> str:
    return BASE + body


# ---- metadata ----
op("op_Q01_list_metadata", q(f"SELECT tenant_id, kind, name, synonym, fqn, config_id, object_id FROM o WHERE kind = '{KIND}' AND (contains(lower(name), '{TERM}') OR contains(lower(synonym), '{TERM}')) ORDER BY kind, name, tenant_id, config_id, object_id LIMIT 200"))(lambda t: metadata.list_metadata(t.objects, KIND, TERM))
op("op_Q02_list_configurations", q("SELECT tenant_id, config_id, count(*) AS n_objects, count(DISTINCT config_version) AS n_versions FROM o GROUP BY 1, 2"))(lambda t: metadata.list_configurations(t.objects))
op(
    "op_Q03_resolve",
    q("""SELECT tenant_id, q, fqn, object_id FROM (SELECT tenant_id, q, fqn, object_id, row_number() OVER (PARTITION BY tenant_id, q ORDER BY how, config_id <> 'base', fqn, object_id) AS n FROM (
        SELECT o.*, q, CASE WHEN o.fqn = q THEN 0 ELSE 1 END AS how FROM o JOIN (SELECT DISTINCT ref_kind || '.' || trim(ref_name) AS q FROM t WHERE ref_name IS NOT NULL AND ref_kind IS NOT NULL UNION SELECT DISTINCT trim(ref_name) FROM t WHERE ref_name IS NOT NULL) x ON o.fqn = q OR o.name = q)) WHERE n = 1"""),
)(lambda t: metadata.resolve(t.objects, t.type_refs.where("ref_name is not null and ref_kind is not null").select(F.concat_ws(".", "ref_kind", F.trim("ref_name")).alias("q")).union(t.type_refs.where("ref_name is not null").select(F.trim("ref_name"))).distinct()))
op("op_Q05_get_object_properties", q("SELECT tenant_id, fqn, object_id, concat_ws(';', 'belonging=' || belonging, 'config_id=' || config_id, 'config_version=' || config_version, 'kind=' || kind, 'name=' || name, 'synonym=' || synonym) AS props FROM o"))(lambda t: metadata.get_object_properties(t.objects).select("tenant_id", "fqn", "object_id", F.array_join(F.array_sort(F.transform(F.map_entries("props"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";").alias("props")))
op("op_Q09_dependency_summary", q("SELECT tenant_id, lower(ref_kind || '.' || trim(ref_name)) AS target, count(DISTINCT field_fqn) AS n_fields, count(DISTINCT owner_fqn) AS n_owners FROM t WHERE category = 'reference' AND ref_kind IS NOT NULL AND trim(ref_name) <> '' GROUP BY 1, 2"))(lambda t: metadata.dependency_summary(t.type_refs))
op("op_Q10_text_usages", f"SELECT tenant_id, source, path, count(*) AS n_lines FROM (SELECT tenant_id, source, path, unnest(string_split(content, chr(10))) AS line FROM files) WHERE regexp_matches(line, '{USAGE}') GROUP BY 1, 2, 3")(lambda t: metadata.text_usages(t.files, USAGE))
op("op_Q13_list_objects", q(f"SELECT tenant_id, name, first(config_id ORDER BY CASE WHEN config_id = 'base' THEN '' ELSE config_id END) AS first_config, count(DISTINCT config_id) > 1 AS in_multiple FROM o WHERE kind = '{KIND}' GROUP BY 1, 2"))(lambda t: metadata.list_objects(t.objects, KIND))
# The kind of a folder by the rule of plurals, not from the library's table.
KINDS_SQL = r"""kinds AS (SELECT DISTINCT folder, CASE WHEN folder = 'FilterCriteria' THEN 'FilterCriterion' WHEN folder LIKE 'ChartsOf%' THEN 'Chart' || folder[7:] WHEN folder LIKE '%sses' THEN folder[:-3] WHEN folder LIKE '%ies' THEN folder[:-4] || 'y' ELSE folder[:-2] END AS k
    FROM (SELECT regexp_extract(regexp_replace(path, '^ext/[^/]+/', ''), '^(?:src/)?([A-Za-z]+)/', 1) AS folder FROM files) WHERE regexp_matches(folder, '^[A-Z].*(s|ia)$'))"""
PATHS = f"{KINDS_SQL}, p AS (SELECT f.*, k AS kind_of, k || '.' || regexp_replace(regexp_extract(path, '^(?:src/)?[A-Za-z]+/([^/]+)', 1), '\\.[A-Za-z]+$', '') AS object FROM files f LEFT JOIN kinds ON folder = regexp_extract(path, '^(?:src/)?([A-Za-z]+)/', 1))"
op("op_Q14_search_metadata", BASE.rstrip() + f", {PATHS} SELECT tenant_id, hit, min(how) AS how FROM (SELECT tenant_id, fqn AS hit, 0 AS how FROM o WHERE contains(lower(name), '{TERM}') OR contains(lower(synonym), '{TERM}') UNION ALL SELECT tenant_id, object, 1 FROM p WHERE kind = 'meta' AND contains(lower(content), '{TERM}') AND object IS NOT NULL) GROUP BY 1, 2")(lambda t: metadata.search_metadata(t.objects, t.files, TERM))
op("op_Q15_find_objects", q(f"SELECT tenant_id, fqn, config_id, row_number() OVER (PARTITION BY tenant_id ORDER BY config_id = 'base', config_id, fqn, object_id)::INTEGER AS place FROM o WHERE lower(name) = lower('{NAME}')"))(lambda t: metadata.find_objects(t.objects, NAME))
op("op_Q16_kind_counts", q("SELECT kind, count(*) AS n, count(DISTINCT tenant_id || '/' || name) AS n_names, sum((config_id <> 'base')::INT)::BIGINT AS n_ext FROM o GROUP BY 1"))(lambda t: metadata.kind_counts(t.objects))
op("op_Q20_unattached", q("SELECT DISTINCT tenant_id || '/' || source AS root FROM files WHERE tenant_id || '/' || source NOT IN (SELECT tenant_id || '/' || config_id FROM o)"))(lambda t: metadata.unattached(t.files.select(F.concat_ws("/", "tenant_id", "source").alias("root")), metadata.current(t.objects).select(F.concat_ws("/", "tenant_id", "config_id").alias("root"))))
op("op_P02_first_of_copies", q("SELECT tenant_id, fqn, config_id, object_id FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, fqn ORDER BY config_id <> 'base', config_id, object_id) AS n FROM o) WHERE n = 1"))(lambda t: metadata.first_of_copies(t.objects))
op("op_P03_artifact_fqns", q("SELECT tenant_id, object_id, CASE WHEN belonging = 'Adopted' AND config_id <> 'base' THEN fqn || '.Module@' || config_id ELSE fqn || '.Module' END AS artifact FROM o"))(lambda t: metadata.artifact_fqns(t.objects))
op(
    "op_P08_merged_copies",
    q("""SELECT tenant_id, fqn, member, config_id FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, fqn, lower(member) ORDER BY n DESC, config_id, member) AS nth FROM (SELECT tenant_id, object_fqn AS fqn, config_id, name AS member, count(*) OVER (PARTITION BY tenant_id, object_fqn, config_id) AS n FROM r WHERE object_fqn IS NOT NULL)) WHERE nth = 1"""),
)(lambda t: metadata.merged_copies(code.live_routines(t.routines).where("object_fqn is not null").select("tenant_id", F.col("object_fqn").alias("fqn"), "config_id", F.col("name").alias("member"))))
op("op_P10_describe_paths", f"WITH {PATHS} SELECT file_id, kind_of, object, nullif(regexp_extract(path, '/Forms/([^/]+)', 1), '') AS form, nullif(regexp_extract(path, '([^/]+)\\.(?i:bsl)$', 1), '') AS module FROM p")(lambda t: metadata.describe_paths(t.files))
op("op_P11_owner_by_prefix", "WITH roots AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:2], '/') AS root FROM files WHERE len(string_split(path, '/')) > 2 UNION SELECT DISTINCT split_part(path, '/', 1) FROM files) SELECT path, arg_max(root, length(root)) AS root FROM (SELECT DISTINCT path FROM files) f JOIN roots ON starts_with(path || '/', root || '/') GROUP BY 1")(
    lambda t: metadata.owner_by_prefix(t.files.select("path").distinct(), t.files.where(F.size(F.split("path", "/")) > 2).select(F.substring_index("path", "/", 2).alias("root")).union(t.files.select(F.substring_index("path", "/", 1))))
)

# ---- call graph ----
RESOLVED = """, first_call AS (SELECT * FROM c),
tg AS (SELECT tenant_id, scope, m, arg_max(fqn, routine_id) AS callee FROM (
    SELECT tenant_id, 'L:' || split_part(fqn, '::', 1) AS scope, {f}(name) AS m, routine_id, fqn FROM r
    UNION ALL SELECT tenant_id, 'C:' || {f}(string_split(object_fqn, '.')[-1]), {f}(name), routine_id, fqn FROM r WHERE starts_with(object_fqn, 'CommonModule.')
    UNION ALL SELECT tenant_id, 'M:' || {f}(string_split(object_fqn, '.')[-1]), {f}(name), routine_id, fqn FROM r WHERE module_type = 'ManagerModule') GROUP BY 1, 2, 3),
cc AS (SELECT call_id, r.tenant_id, r.fqn AS caller, c.qualifier, {f}(c.method) AS m, line FROM first_call c JOIN r ON r.routine_id = c.caller_id),
res AS (SELECT call_id, cc.tenant_id, caller, coalesce(l.callee, co.callee, ma.callee) AS callee,
    CASE WHEN l.callee IS NOT NULL THEN 'local' WHEN co.callee IS NOT NULL THEN 'common_module' WHEN ma.callee IS NOT NULL THEN 'manager' ELSE 'unresolved' END AS kind, line FROM cc
    LEFT JOIN tg l ON qualifier IS NULL AND l.tenant_id = cc.tenant_id AND l.scope = 'L:' || split_part(caller, '::', 1) AND l.m = cc.m
    LEFT JOIN tg co ON co.tenant_id = cc.tenant_id AND co.scope = 'C:' || {f}(qualifier) AND co.m = cc.m
    LEFT JOIN tg ma ON ma.tenant_id = cc.tenant_id AND ma.scope = 'M:' || {f}(qualifier) AND ma.m = cc.m),
e AS (SELECT tenant_id, caller, callee, arg_max(kind, call_id) AS kind, CASE WHEN arg_max(kind, call_id) = 'manager' THEN 'medium' ELSE 'high' END AS confidence FROM res WHERE callee IS NOT NULL GROUP BY 1, 2, 3) """


def g(body: str, fold: str = "") -> str:
    return BASE.rstrip() + RESOLVED.replace("{f}", fold) + body


def edges(t):
    return code.call_edges(code.resolve_calls(t.calls, t.routines, t.objects))


def exported(t):
    return code.live_routines(t.routines).where("export and object_fqn like 'CommonModule.%'").select("tenant_id", "fqn")


EXP = "(SELECT tenant_id, fqn FROM r WHERE export AND object_fqn LIKE 'CommonModule.%')"
CONF = "CASE WHEN kind = 'manager' THEN 'medium' WHEN kind <> 'unresolved' THEN 'high' END AS confidence"
op("op_C05_resolve_calls", g(f"SELECT call_id, tenant_id, caller, callee, kind, {CONF}, line FROM res"))(lambda t: code.resolve_calls(t.calls, t.routines, t.objects))
op("op_C17_resolve_ignore_case", g(f"SELECT call_id, tenant_id, caller, callee, kind, {CONF}, line FROM res", "lower"))(lambda t: code.resolve_calls(t.calls, t.routines, t.objects, True))
op("op_C07_call_edges", g("SELECT tenant_id, caller, callee, kind, confidence FROM e"))(edges)
op("op_C06_override_edges", q("SELECT tenant_id, fqn AS src, regexp_replace(split_part(fqn, '::', 1), '@ext:.*$', '') || '::' || override_target AS dst, override_mode AS mode FROM r WHERE override_mode IS NOT NULL AND override_target IS NOT NULL AND contains(split_part(fqn, '::', 1), '@ext:')"))(lambda t: code.override_edges(t.routines))
# Fixed values, written out for the SQL: what the platform calls.
ENTRY = """entries(low, category) AS (VALUES ('обработкапроведения', 'проведение'), ('обработкаудаленияпроведения', 'проведение'), ('posting', 'проведение'), ('передзаписью', 'запись'), ('призаписи', 'запись'), ('beforewrite', 'запись'), ('onwrite', 'запись'),
    ('передудалением', 'удаление'), ('beforedelete', 'удаление'), ('обработказаполнения', 'заполнение'), ('filling', 'заполнение'), ('прикопировании', 'заполнение'), ('обработкапроверкизаполнения', 'проверка_заполнения'), ('проверказаполнения', 'проверка_заполнения'),
    ('fillcheckprocessing', 'проверка_заполнения'), ('приустановкеновогономера', 'нумерация'), ('приустановкеновогокода', 'нумерация'), ('обработкаполученияданныхвыбора', 'выбор'), ('приполученииданныхвыбора', 'выбор'))"""
#: The tables' routines have none of these names, so modules' routines are given them, and others, by their ids.
CALLED = "ОбработкаПроведения ОбработкаУдаленияПроведения Posting ПередЗаписью ПриЗаписи BeforeWrite OnWrite ПередУдалением BeforeDelete ОбработкаЗаполнения Filling ПриКопировании ОбработкаПроверкиЗаполнения ПроверкаЗаполнения FillCheckProcessing ПриУстановкеНовогоНомера ПриУстановкеНовогоКода ОбработкаПолученияДанныхВыбора ПриПолученииДанныхВыбора ПослеЗаписи ПриОткрытии Проведение".split()
SPREAD = f", {ENTRY}, en AS (SELECT * REPLACE (CASE WHEN routine_id % 25 < {len(CALLED)} AND fqn NOT LIKE '%.Form.%' THEN list_value(" + ", ".join(f"'{x}'" for x in CALLED) + ")[(routine_id % 25)::INTEGER + 1] ELSE name END AS name) FROM r) "


def spread_entries(t):
    given = F.element_at(F.array(*[F.lit(x) for x in CALLED]), (F.col("routine_id") % 25 + 1).cast("int"))
    return t.routines.withColumn("name", F.when((F.col("routine_id") % 25 < len(CALLED)) & ~F.col("fqn").contains(".Form."), given).otherwise(F.col("name")))


op("op_C08_entry_points", BASE.rstrip() + SPREAD + "SELECT tenant_id, fqn, category AS entry FROM en JOIN entries ON low = lower(name)")(lambda t: code.find_handlers(spread_entries(t)))
op("op_C09_resolve_routines", q(f"SELECT tenant_id, routine_id, fqn FROM r WHERE name = '{ROUTINE}' AND ends_with(object_fqn, '.{MODULE.split('.')[1]}')"))(lambda t: code.resolve_routines(t.routines, MODULE.split(".")[1] + "." + ROUTINE).select("tenant_id", "routine_id", "fqn"))
op("op_C10_find_callers", g(f"SELECT DISTINCT e.tenant_id, caller FROM e JOIN {EXP} x ON x.tenant_id = e.tenant_id AND x.fqn = callee"))(lambda t: code.find_callers(edges(t), exported(t)))
op("op_C11_find_callees", g(f"SELECT DISTINCT e.tenant_id, callee, kind AS via FROM e JOIN {EXP} x ON x.tenant_id = e.tenant_id AND x.fqn = caller"))(lambda t: code.find_callees(edges(t), exported(t)))
op("op_C12_call_graph", g(f"SELECT DISTINCT e.tenant_id, caller AS fqn, 'caller' AS side FROM e JOIN {EXP} x ON x.tenant_id = e.tenant_id AND x.fqn = callee UNION ALL SELECT DISTINCT e.tenant_id, callee, 'callee' FROM e JOIN {EXP} x ON x.tenant_id = e.tenant_id AND x.fqn = caller"))(lambda t: code.call_graph(edges(t), exported(t)))
HOPS = 8


def paths_sql() -> str:
    """Breadth first, a level a table: the least path to each node that no level before has."""
    levels = ["f0 AS (SELECT DISTINCT tenant_id, fqn AS src, fqn AS node, [fqn] AS path FROM r WHERE override_mode IS NOT NULL)"]
    for n in range(1, HOPS + 1):
        seen = " UNION ALL ".join(f"SELECT tenant_id, src, node FROM f{k}" for k in range(n))
        levels.append(f"f{n} AS MATERIALIZED (SELECT f.tenant_id, f.src, e.callee AS node, min(list_append(f.path, e.callee)) AS path FROM f{n - 1} f JOIN e ON e.tenant_id = f.tenant_id AND e.caller = f.node WHERE (f.tenant_id, f.src, e.callee) NOT IN (SELECT (tenant_id, src, node) FROM ({seen})) GROUP BY 1, 2, 3)")
    hits = " UNION ALL ".join(f"SELECT f.tenant_id, src, node AS dst, array_to_string(path, ' > ') AS path, {n} AS hops FROM f{n} f JOIN {EXP} x ON x.tenant_id = f.tenant_id AND x.fqn = node" for n in range(HOPS + 1))
    return g(", " + ", ".join(levels) + " " + hits)


op("op_C13_call_path", paths_sql())(lambda t: code.call_path(edges(t), code.live_routines(t.routines).where("override_mode is not null"), exported(t), HOPS).withColumn("path", F.array_join("path", " > ")))
op("op_C15_find_overrides", q(f"SELECT * FROM (SELECT tenant_id, fqn AS src, regexp_replace(split_part(fqn, '::', 1), '@ext:.*$', '') || '::' || override_target AS dst, override_mode AS mode FROM r WHERE override_mode IS NOT NULL AND override_target IS NOT NULL AND contains(split_part(fqn, '::', 1), '@ext:')) WHERE starts_with(dst, '{HOOKED}.')"))(lambda t: code.find_overrides(t.routines, HOOKED))
BODIES = "SELECT tenant_id, split_part(fqn, '#code', 1) AS routine, string_agg(text[instr(text, chr(10)) + 1:], chr(10) ORDER BY coalesce(try_cast(regexp_extract(fqn, '#code/([0-9]+)', 1) AS INT), 0), chunk_id) AS body, count(*) AS parts FROM k WHERE chunk_kind = 'code' GROUP BY 1, 2"
op("op_C16_routine_source", q(BODIES))(lambda t: code.routine_source(t.chunks))
HOOKS = "(SELECT tenant_id, fqn AS src, regexp_replace(split_part(fqn, '::', 1), '@ext:.*$', '') || '::' || override_target AS dst, override_mode AS mode FROM r WHERE override_mode IS NOT NULL AND override_target IS NOT NULL AND contains(split_part(fqn, '::', 1), '@ext:'))"
op("op_C16_with_overrides", q(f", b AS ({BODIES}) SELECT h.tenant_id, h.dst AS routine, b.body, h.mode, h.src AS fqn, regexp_extract(h.src, '@ext:(.*?)::', 1) AS extension, x.body AS source FROM {HOOKS} h LEFT JOIN b ON b.tenant_id = h.tenant_id AND b.routine = h.dst LEFT JOIN b x ON x.tenant_id = h.tenant_id AND x.routine = h.src").replace("\n, b AS", ", b AS"))(
    lambda t: code.source_with_overrides(code.routine_source(t.chunks), code.override_edges(t.routines)).select("tenant_id", "routine", "body", F.explode("overrides").alias("o")).select("tenant_id", "routine", "body", "o.mode", "o.fqn", "o.extension", "o.source")
)
METHODS = "(SELECT DISTINCT name_low AS method_low FROM s WHERE export = 1 AND object LIKE 'CommonModule.%')"
CALLERS = f"SELECT method_low, s.tenant_id, object, name, path, line, call_id FROM c JOIN {METHODS} USING (method_low) JOIN s ON s.id = c.caller_id WHERE NOT (qualifier IS NULL AND s.name_low = method_low)"


def methods(t):
    return t.symbols.where("export = 1 and object like 'CommonModule.%'").select(F.col("name_low").alias("method_low"))


op("op_C18_find_callers_index", q(CALLERS))(lambda t: code.callers_of(t.calls, t.symbols, methods(t)))
op("op_C19_callers_page", q(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY method_low ORDER BY object, name, line, call_id)::INTEGER AS nth FROM ({CALLERS})) WHERE nth <= 40"))(lambda t: code.callers_of(t.calls, t.symbols, methods(t), cap=40))
op("op_C20_call_totals", q(f"SELECT method_low, sum(n)::BIGINT AS n_rows, sum(n_callers)::BIGINT AS n_callers, count(*) AS n_objects FROM (SELECT method_low, tenant_id, object, count(*) AS n, count(DISTINCT name || '|' || path) AS n_callers FROM ({CALLERS}) GROUP BY 1, 2, 3) GROUP BY 1"))(lambda t: code.call_totals(t.calls, t.symbols, methods(t)))
op("op_C21_call_counts", q("SELECT method_low, count(*) AS n FROM c GROUP BY 1"))(lambda t: code.call_counts(t.calls))
op("op_C21_has_name", q("SELECT DISTINCT lower(name) AS name_low, lower(name) IN (SELECT name_low FROM s WHERE name_low IS NOT NULL UNION SELECT method_low FROM c WHERE method_low IS NOT NULL) AS known FROM o"))(lambda t: code.has_name(t.symbols, t.calls, metadata.current(t.objects).select(F.lower("name").alias("name_low"))))
op(
    "op_C22_declarations",
    BASE.rstrip() + (f", x AS (SELECT id, tenant_id, object, name, export, CASE split_part(object, '.', 1) WHEN 'CommonModule' THEN 0 WHEN 'Configuration' THEN 1 WHEN 'Document' THEN 2 WHEN 'Catalog' THEN 3 ELSE 4 END AS relevance FROM s WHERE contains(name_low, '{TERM}')) SELECT *, (SELECT count(*) FROM x) AS total FROM x ORDER BY export DESC, relevance, object, name, id LIMIT 50"),
)(lambda t: code.declarations(t.symbols, TERM))
HINT = "CASE WHEN method_low < 'н' THEN lower(split_part(object, '.', 2)) END"
op("op_C23_find_declarations", q(f"SELECT id, tenant_id, object, name, path, start_line, export, (SELECT count(*) FROM s WHERE contains(name_low, '{TERM}') AND export = 1) AS total, 'all' AS scope, (SELECT count(*) FROM s WHERE contains(name_low, '{TERM}') AND export = 1) > 5 AS truncated FROM s WHERE contains(name_low, '{TERM}') AND export = 1 ORDER BY object, path, start_line, id LIMIT 5"))(lambda t: code.find_declarations(t.symbols, TERM, True, True, limit=5))
op("op_C23_narrowed", q(f"SELECT id, tenant_id, object, name, path, start_line, export, count(*) OVER () AS total, 'object' AS scope, false AS truncated FROM s WHERE name_low = lower('{ROUTINE}') AND (object_low = lower('{MODULE}') OR ends_with(object_low, '.' || lower('{MODULE}')))"))(lambda t: code.find_declarations(t.symbols, ROUTINE, object_hint=MODULE))
op(
    "op_C25_callers_batch",
    q(f"""SELECT * FROM (SELECT h.method_low, hint, s.tenant_id, s.object, s.name, s.path, line, row_number() OVER (PARTITION BY h.method_low, hint ORDER BY s.object, s.name, line, call_id)::INTEGER AS nth, count(*) OVER (PARTITION BY h.method_low, hint) AS total
    FROM c JOIN (SELECT DISTINCT name_low AS method_low, {HINT.replace('method_low', 'name_low')} AS hint FROM s WHERE export = 1 AND object LIKE 'CommonModule.%') h USING (method_low) JOIN s ON s.id = c.caller_id WHERE NOT (qualifier IS NULL AND s.name_low = h.method_low) AND (hint IS NULL OR qualifier_low = hint OR (qualifier IS NULL AND contains(s.object_low, hint)))) WHERE nth <= 3"""),
)(lambda t: code.callers_batch(t.calls, t.symbols, t.symbols.where("export = 1 and object like 'CommonModule.%'").select(F.col("name_low").alias("method_low"), F.when(F.col("name_low") < "н", F.lower(F.split("object", r"\.")[1])).alias("hint")), 3))
op(
    "op_C24_caller_levels",
    q(f"""SELECT 1 AS level, lower('{ROUTINE}') AS calls, caller, path, row_number() OVER (ORDER BY caller, path)::INTEGER AS place, (SELECT count(*) FROM c JOIN s ON s.id = c.caller_id WHERE method_low = lower('{ROUTINE}') AND NOT (qualifier IS NULL AND name_low = method_low)) AS total, false AS truncated
    FROM (SELECT DISTINCT s.name_low AS caller, s.path FROM c JOIN s ON s.id = c.caller_id WHERE method_low = lower('{ROUTINE}') AND NOT (qualifier IS NULL AND s.name_low = method_low)) ORDER BY 3, 4 LIMIT 1000"""),
)(lambda t: code.caller_levels(t.calls, t.symbols, ROUTINE, 1, 1000))
op(
    "op_C24_callers_upward",
    BASE.rstrip().replace("WITH o AS", "WITH RECURSIVE o AS", 1) + f", ne AS (SELECT DISTINCT s.name_low AS caller_name, c.method_low AS callee_name FROM c JOIN s ON s.id = c.caller_id), up AS (SELECT 0 AS level, lower('{ROUTINE}') AS name UNION SELECT level + 1, caller_name FROM up JOIN ne ON callee_name = name WHERE level < 4) SELECT min(level) AS level, name FROM up GROUP BY 2",
)(lambda t: code.callers_upward(t.calls.join(t.symbols.select(F.col("id").alias("caller_id"), "name_low").distinct(), "caller_id").select(F.col("name_low").alias("caller_name"), F.col("method_low").alias("callee_name")), ROUTINE))
op("op_C26_override_hooks", q("SELECT id, tenant_id, object, name, override_mode, override_target FROM s WHERE override_mode IS NOT NULL"))(lambda t: code.override_hooks(t.symbols))
LINES = "(SELECT DISTINCT s.tenant_id, s.path, c.line FROM c JOIN s ON s.id = c.caller_id)"


def call_lines(t):
    s = t.symbols.select(F.col("id").alias("caller_id"), "tenant_id", "path").distinct()
    return t.calls.join(s, "caller_id").select("tenant_id", "path", "line").distinct()


op("op_C28_enclosing", q(f"SELECT tenant_id, path, line, arg_min(id, (start_line, id)) AS id FROM {LINES} p JOIN s USING (tenant_id, path) WHERE start_line IS NOT NULL AND line BETWEEN start_line AND coalesce(end_line, start_line) GROUP BY 1, 2, 3"))(lambda t: code.enclosing(call_lines(t), t.symbols))
op("op_C29_list_routines", q(f"SELECT tenant_id, id, name, start_line, end_line, export FROM s WHERE path = '{FILE}'"))(lambda t: code.list_routines(t.symbols, FILE))
op("op_C29_read_routine", q(f"SELECT id, tenant_id, array_to_string((string_split(content, chr(10)))[start_line:end_line], chr(10)) AS body FROM s JOIN files USING (tenant_id, path) WHERE name_low = lower('{ROUTINE}') AND end_line >= start_line"))(lambda t: code.read_routine(t.symbols, t.files, ROUTINE))
op("op_C29_read_file", f"SELECT path, arg_max(content, (length(content), -file_id)) AS content FROM files WHERE path = '{FILE}' AND length(content) > 0 GROUP BY 1")(lambda t: code.read_file(t.files, FILE))
op("op_C31_locate", q(f"SELECT tenant_id, count(*) AS n_places, CASE WHEN count(*) = 1 THEN min(object || '.' || module) END AS place FROM (SELECT DISTINCT tenant_id, object, module FROM s WHERE name_low = lower('{ROUTINE}')) GROUP BY 1"))(lambda t: code.locate(t.symbols, ROUTINE))
MATCHES = f"(SELECT tenant_id, path, n AS line, regexp_replace(lines[n], '\\r$', '') AS text FROM (SELECT tenant_id, path, string_split(content, chr(10)) AS lines FROM files WHERE kind = 'bsl' AND content IS NOT NULL), unnest(range(1, len(lines) + 1)) AS u(n) WHERE regexp_matches(lines[n], '{CALL}'))"
op("op_C32_search_code", f"SELECT tenant_id, path, line::INTEGER AS line, text, (SELECT count(*) FROM {MATCHES}) AS total FROM {MATCHES} ORDER BY tenant_id, path, line LIMIT 100")(lambda t: code.search_code(t.files, CALL))
op("op_C33_count_total", f"SELECT sum(len(regexp_extract_all(content, '{CALL}')))::BIGINT AS n_matches FROM files")(lambda t: code.count_total(t.files, "content", CALL))
HUNKS = f"(SELECT DISTINCT s.tenant_id, s.path, c.line AS lo, c.line + 3 AS hi FROM c JOIN s ON s.id = c.caller_id WHERE c.seen_at >= TIMESTAMP '{SINCE}' AND c.qualifier IS NULL)"


def hunks(t):
    s = t.symbols.select(F.col("id").alias("caller_id"), "tenant_id", "path").distinct()
    return t.calls.where((F.col("seen_at") >= SINCE) & F.col("qualifier").isNull()).join(s, "caller_id").select("tenant_id", "path", F.col("line").alias("lo"), (F.col("line") + 3).alias("hi")).distinct()


op("op_G01_changed_objects", BASE.rstrip() + f", {PATHS} SELECT tenant_id, source, object, count(*) AS n_files, string_agg(path, ',' ORDER BY path) AS paths FROM p JOIN (SELECT DISTINCT tenant_id, path FROM {HUNKS}) h USING (tenant_id, path) WHERE object IS NOT NULL GROUP BY 1, 2, 3")(lambda t: code.changed_objects(hunks(t), t.files))
op("op_G02_touched_routines", q(f"SELECT DISTINCT tenant_id, id FROM {HUNKS} h JOIN s USING (tenant_id, path) WHERE start_line <= hi AND coalesce(end_line, start_line) >= lo"))(lambda t: code.touched_routines(hunks(t), t.symbols))
op(
    "op_G03_review_set",
    BASE.rstrip()
    + f""", {ENTRY}, tr AS (SELECT DISTINCT s.* FROM {HUNKS} h JOIN s USING (tenant_id, path) WHERE start_line <= hi AND coalesce(end_line, start_line) >= lo),
    ca AS (SELECT x.tenant_id, c.call_id, c.method_low, c.qualifier_low, EXISTS (SELECT 1 FROM objects m WHERE m.kind = 'CommonModule' AND m.tenant_id = x.tenant_id AND lower(m.name) = c.qualifier_low) AS common FROM c JOIN s x ON x.id = c.caller_id),
    n AS (SELECT tr.tenant_id, tr.id, count(*) AS callers FROM tr JOIN ca ON ca.tenant_id = tr.tenant_id AND ca.method_low = tr.name_low WHERE NOT coalesce(common AND qualifier_low <> lower(string_split(object, '.')[-1]) AND qualifier_low NOT IN ('этотобъект', 'thisobject', 'этаформа', 'thisform'), false) GROUP BY 1, 2),
    hk AS (SELECT tenant_id, override_target_low, count(*) AS hooks FROM s WHERE override_mode IS NOT NULL GROUP BY 1, 2)
    SELECT tr.tenant_id, tr.id, object, name, coalesce(export, 0) AS export, EXISTS (SELECT 1 FROM entries WHERE low = lower(name)) AS is_entry, coalesce(hooks, 0) AS hooks, coalesce(callers, 0) AS callers FROM tr LEFT JOIN n ON n.tenant_id = tr.tenant_id AND n.id = tr.id LEFT JOIN hk ON hk.tenant_id = tr.tenant_id AND hk.override_target_low = tr.name_low
    ORDER BY 5 DESC, 6 DESC, 7 DESC, 8 DESC, 2 LIMIT 100""",
)(lambda t: code.review_set(hunks(t), t.symbols, t.calls, t.objects))

# ---- text ----


def joined_again(parts, key: str, piece, name: str):
    """The pieces of each key put together again in order."""
    piece = F.col(piece) if isinstance(piece, str) else piece
    return parts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", piece.alias("x")))), lambda p: p["x"]), "\n").alias(name))


TOKENS = "(SELECT {key}, p, unnest(CASE WHEN len(ws) > 1 THEN list_prepend(p, ws) ELSE [p] END) AS tok FROM (SELECT {key}, p, string_split(regexp_replace(p, '([a-zа-яё0-9])([A-ZА-ЯЁ])', '\\1 \\2', 'g'), ' ') AS ws FROM (SELECT {key}, unnest(string_split_regex({col}, '[^0-9A-Za-zА-Яа-яЁё]+')) AS p FROM {table}) WHERE p <> ''))"
op("op_T01_token_counts", q(f"SELECT lower(tok) AS token, count(*) AS n FROM {TOKENS.format(key='chunk_id', col='text_ident', table='k')} GROUP BY 1"))(lambda t: text.token_rows(t.chunks.dropDuplicates(["chunk_id"]), ["chunk_id"], "text_ident").groupBy("token").agg(F.count(F.lit(1)).alias("n")))
op("op_T01_search_tokens")(lambda t: t.chunks.dropDuplicates(["chunk_id"]).select("chunk_id", text.search_tokens(F.col("name"), F.col("text_ident")).alias("tokens")))
# What is joined again is the text: no line is lost, doubled or cut. How the lines are packed is tested on small texts.
op("op_T02_split_lines", "SELECT doc_id, text FROM documents WHERE text IS NOT NULL")(lambda t: joined_again(text.split_lines(t.documents, ["doc_id"], "text"), "doc_id", "segment", "text"))
op("op_T03_code_chunks")(lambda t: text.code_chunks(t.routines, t.files, t.objects))
op(
    "op_T03_code_bodies",
    q("""SELECT routine_id, body FROM (SELECT routine_id, array_to_string((string_split(content, chr(10)))[start_line:end_line], chr(10)) AS body FROM r JOIN (SELECT DISTINCT file_id, content FROM files) f USING (file_id) WHERE content IS NOT NULL AND start_line >= 1 AND end_line >= start_line)
    WHERE length(regexp_replace(body, '\\s', '', 'g')) >= 80"""),
)(lambda t: joined_again(text.code_chunks(t.routines, t.files, t.objects), "routine_id", F.expr("substring(text, locate('\n', text) + 1)"), "body"))
op("op_T04_doc_chunks", q("SELECT unit_id, text FROM (SELECT unit_id, min(text) AS text FROM d WHERE text IS NOT NULL GROUP BY 1)"))(lambda t: joined_again(text.doc_chunks(t.doc_units), "unit_id", F.expr("substring(text, locate('\n', text) + 1)"), "text"))
op("op_T04_doc_heads", q("SELECT DISTINCT unit_id, title || CASE WHEN len(section_path) > 0 THEN ' ▸ ' || array_to_string(section_path, ' ▸ ') ELSE '' END AS head FROM d WHERE text IS NOT NULL AND title IS NOT NULL"))(lambda t: text.doc_chunks(t.doc_units.where("title is not null")).where("part = 0").select("unit_id", F.regexp_replace(F.substring_index("text", "\n", 1), r" \(часть 1/\d+\)$", "").alias("head")))
# Fixed values, written out for the SQL: the kinds that the tables have.
KINDS = "CASE kind WHEN 'Catalog' THEN 'Справочник' WHEN 'Document' THEN 'Документ' WHEN 'Enum' THEN 'Перечисление' WHEN 'InformationRegister' THEN 'Регистр сведений' WHEN 'AccumulationRegister' THEN 'Регистр накопления' WHEN 'CommonModule' THEN 'Общий модуль' WHEN 'Report' THEN 'Отчёт' WHEN 'DataProcessor' THEN 'Обработка' WHEN 'Constant' THEN 'Константа' ELSE kind END"
op("op_T10_markdown_sections")(lambda t: text.markdown_sections(t.documents, "doc_id", "text"))
op("op_T11_page_sections")(lambda t: text.page_sections(text.markdown_sections(t.doc_units.dropDuplicates(["unit_id"]), "unit_id", "text"), "unit_id"))
op("op_T13_link_mentions")(lambda t: text.link_mentions(t.doc_units, t.objects))
op("op_T14_sha1_text", q("SELECT unit_id, sha1(coalesce(title, '') || chr(0) || coalesce(text, '') || chr(0)) AS h FROM d"))(lambda t: t.doc_units.dropDuplicates(["unit_id"]).select("unit_id", text.sha1_text(F.col("title"), F.col("text")).alias("h")))

# ---- parsers ----
op("op_S13_type_ref", q("SELECT ref_id, CASE WHEN category = 'typeset' THEN 'reference' ELSE category END AS category, ref_kind, trim(ref_name) AS ref_name FROM t WHERE raw IS NOT NULL"))(lambda t: t.type_refs.where("raw is not null").dropDuplicates(["ref_id"]).select("ref_id", metadata_xml.type_ref(F.col("raw")).alias("t")).select("ref_id", "t.category", "t.ref_kind", "t.ref_name"))
RECORDED = "name, start_line, end_line, routine_kind, export, region, directive"
op("op_C02_parse_module")(lambda t: bsl.routines(t.files))
op("op_C03_find_calls")(lambda t: bsl.calls(bsl.routines(t.files)))
op("op_S08_parse_objects")(lambda t: metadata_xml.objects(t.files.where("kind = 'meta'")))
op("op_S23_its_units")(lambda t: trees.its_units(t.files.where(F.lower("path").endswith(".json"))))
op("op_S24_artifact_units")(lambda t: trees.artifact_units(t.documents.select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))))

# ---- search ----


def query_vectors(t):
    """The stated query set: every vector whose id is divisible by 20, against all vectors."""
    return t.chunk_vectors.where("size(embedding) = 64 and vec_id % 20 = 0").dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))


op("op_V01_hash_embed")(lambda t: search.hash_embed(t.chunks.dropDuplicates(["chunk_id"]), "chunk_id", "text_ident"))
op("op_V03_l2", "SELECT vec_id, list_transform(e, lambda x: round(CASE WHEN n = 0 THEN x ELSE x / n END, 4)) AS unit FROM (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM chunk_vectors WHERE embedding IS NOT NULL)")(
    # Keys of a group have no -0.0 any more, so the vector itself is carried beside them.
    lambda t: t.chunk_vectors.where("embedding is not null").groupBy("vec_id", "embedding").agg(F.first("embedding").alias("e")).select("vec_id", F.transform(search.l2(F.col("e").cast("array<double>")), lambda x: search.rounded(x, 4)).alias("unit"))
)
op(
    "op_V05_exact_top_k",
    """WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM chunk_vectors WHERE len(embedding) = 64), qs AS (SELECT vec_id AS query_id, e AS q FROM v WHERE vec_id % 20 = 0),
    x AS (SELECT query_id, vec_id, list_cosine_similarity(e, q) AS c FROM v, qs WHERE list_dot_product(e, e) > 0 AND list_dot_product(q, q) > 0)
    SELECT query_id, vec_id, round((1 + c) / 2, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 6) DESC, vec_id)::INTEGER AS place FROM x) WHERE place <= 10""",
)(lambda t: search.exact_top_k(t.chunk_vectors, query_vectors(t)))
op("op_V07_selectivity", q("SELECT least(count(*), 50000) < 50000 AS exact FROM chunks WHERE chunk_kind = 'object'"))(lambda t: search.selectivity(search.chunk_filter(t.chunks, kinds=["object"])))
# Written out for the SQL: the words of TEXTS; long Cyrillic ones without their last two letters, as beginnings.
TERMS = """terms(query_id, term, prefix) AS (VALUES (1, 'учёт', false), (1, 'тары', false), (1, 'сохраня', true), (1, 'верс', true), (1, 'объек', true), (2, 'найти', false), (2, 'склад', false), (2, 'прих', true), (3, 'shift', false), (3, 'planner', false), (3, 'enum', false), (3, 'values', false))"""
FULL = {"text": 1, "text_ident": 5, "name": 10}
INDEXES: dict = {}


def full_text(t) -> search.FullText:
    """The index of the chunks' texts and names, built once for a session and scale."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in INDEXES:
        INDEXES[key] = search.FullText.build(t.chunks.dropDuplicates(["chunk_id"]), "chunk_id", FULL, f"{shared_dir(t.spark)}/full-text-{uuid.uuid4().hex}")
    return INDEXES[key]


def bm25_sql(idf: str) -> str:
    weighed = " UNION ALL ".join(f"SELECT chunk_id, lower(tok) AS token, {w} AS w FROM {TOKENS.format(key='chunk_id', col=f, table='k')}" for f, w in FULL.items())
    return BASE.rstrip() + f""", {TERMS}, w AS ({weighed}),
    tf AS (SELECT chunk_id, token, sum(w) AS tf, count(*) AS c FROM w GROUP BY 1, 2), dl AS (SELECT chunk_id, sum(c) AS dl FROM tf GROUP BY 1), st AS (SELECT count(*) AS n, avg(dl) AS a FROM dl),
    hit AS (SELECT query_id, term, chunk_id, sum(tf) AS tf FROM tf JOIN terms ON token = term OR (prefix AND starts_with(token, term)) GROUP BY 1, 2, 3), df AS (SELECT query_id, term, count(*) AS df FROM hit GROUP BY 1, 2),
    sc AS (SELECT query_id, chunk_id, round(sum({idf} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score FROM hit JOIN df USING (query_id, term) JOIN dl USING (chunk_id), st GROUP BY 1, 2)
    SELECT query_id::BIGINT AS query_id, chunk_id, score, place, total FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS place, count(*) OVER (PARTITION BY query_id) AS total FROM sc) WHERE place <= 10"""


op("op_V08_full_text", bm25_sql("ln(1 + (n - df + 0.5) / (df + 0.5))"))(lambda t: full_text(t).search(TEXTS))
op("op_V09_bm25", bm25_sql("greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6)"))(lambda t: full_text(t).search(TEXTS, form="fts"))
op("op_V09_snippets")(lambda t: full_text(t).search({1: TEXTS[1]}).join(t.chunks.dropDuplicates(["chunk_id"]).select("chunk_id", "text"), "chunk_id").select("chunk_id", "place", search.snippet(F.col("text"), TEXTS[1]).alias("snippet")))
op(
    "op_K07_postings",
    q(f"SELECT chunk_id, token, tf::BIGINT AS tf, (sum(tf) OVER (PARTITION BY chunk_id))::BIGINT AS dl FROM (SELECT chunk_id, lower(tok) AS token, count(*) AS tf FROM {TOKENS.format(key='chunk_id', col='text_ident', table='k')} GROUP BY 1, 2)"),
)(lambda t: search.postings(t.chunks.dropDuplicates(["chunk_id"]), "chunk_id", {"text_ident": 1}))
op("op_V11_units", q("SELECT chunk_id, split_part(split_part(fqn, '#code', 1), '#', 1) AS unit FROM k"))(lambda t: t.chunks.dropDuplicates(["chunk_id"]).select("chunk_id", search.unit_of(F.col("fqn")).alias("unit")))
op("op_V15_semantic_search")(lambda t: search.semantic_search(t.chunks, t.chunk_vectors, query_vectors(t)))


def hybrid(t):
    ids = t.chunk_vectors.where("size(embedding) = 64").dropDuplicates(["vec_id"]).orderBy("vec_id").limit(len(TEXTS))
    qv = ids.select(F.row_number().over(Window.orderBy("vec_id")).cast("bigint").alias("query_id"), F.col("embedding").alias("qvec"))  # a few rows
    return search.hybrid_search(t.chunks, t.chunk_vectors, qv, TEXTS, full_text(t))


op("op_V16_hybrid_search")(hybrid)
op("op_V17_expand")(lambda t: search.expand(hybrid(t), edges(t), edges(t)))
op(
    "op_V18_readiness",
    q("""SELECT tenant_id, coalesce(no, 0) AS n_objects, coalesce(nc, 0) AS n_chunks, coalesce(nv, 0) AS n_vectors, CASE WHEN coalesce(nv, 0) > 0 THEN 'vectorized' WHEN coalesce(no, 0) > 0 THEN 'structural_only' ELSE 'empty' END AS state
    FROM (SELECT tenant_id, count(DISTINCT object_id) AS no FROM o GROUP BY 1) FULL JOIN (SELECT tenant_id, count(DISTINCT chunk_id) AS nc, count(DISTINCT chunk_id) FILTER (chunk_id IN (SELECT chunk_id FROM chunk_vectors WHERE embedding IS NOT NULL)) AS nv FROM k GROUP BY 1) USING (tenant_id)"""),
)(lambda t: search.readiness(t.objects, t.chunks, t.chunk_vectors))

# ---- documents ----
op("op_D01_related_docs", q(f"SELECT source, external_id, title, 'MENTIONS' AS rel, NULL::DOUBLE AS confidence FROM latest WHERE list_contains(links, '{KIND}.{NAME}')"))(lambda t: docs.related_docs(t.doc_units, f"{KIND}.{NAME}"))
op("op_D02_get_document", q("SELECT tenant_id || '/' || owner_fqn AS owner, string_agg(text, chr(10) || chr(10) ORDER BY coalesce(try_cast(regexp_extract(fqn, '/([0-9]+)$', 1) AS INT), 0), fqn, text) AS body, count(*) AS parts FROM k WHERE tenant_id IS NOT NULL AND owner_fqn IS NOT NULL GROUP BY 1"))(lambda t: docs.get_document(t.chunks.dropDuplicates(["chunk_id"]).where("tenant_id is not null and owner_fqn is not null").select(F.concat("tenant_id", F.lit("/"), "owner_fqn").alias("owner"), "fqn", "text")))


def pages(t):
    return help.pages(dumps.books(t)).where("error is null")


BOOKS = "(SELECT unit_id, title AS name, '8.3.' || (9 + length(title) % 3) || '.1000' AS version, 9 + length(title) % 3 AS n, 'Topic' || unit_id AS en_name FROM latest WHERE title IS NOT NULL)"
op("op_S21_help_pages", q(f"SELECT version, 'context' AS help_kind, regexp_replace(trim(name), '\\s+', ' ', 'g') AS name, en_name, unit_id || '.html' AS page FROM {BOOKS}"))(lambda t: pages(t).select("version", "help_kind", "name", "en_name", "page"))
op("op_S32_help_catalog", q(f"SELECT version, help_kind, name, en_name, page FROM (SELECT version, 'context' AS help_kind, regexp_replace(trim(name), '\\s+', ' ', 'g') AS name, en_name, unit_id || '.html' AS page FROM {BOOKS})"))(lambda t: help.catalog(dumps.books(t)))
op("op_D03_docinfo", q(f"SELECT low, version, name, en_name, place, n_full FROM (SELECT lower(name) AS low, version, name, en_name, row_number() OVER (PARTITION BY lower(name) ORDER BY n DESC, name || ' (' || en_name || ')')::INTEGER AS place, count(*) OVER (PARTITION BY lower(name)) AS n_full FROM {BOOKS}) WHERE place <= 25"))(lambda t: docs.docinfo(pages(t), pages(t).select(F.col("name").alias("q"))).select("low", "version", "name", "en_name", "place", "n_full"))
op("op_D04_versions", q(f"SELECT version, count(*) AS n, 1::BIGINT AS n_kinds FROM {BOOKS} GROUP BY 1"))(lambda t: docs.versions(pages(t)))
op("op_D05_search_titles", q("SELECT unit_id, title, CASE WHEN starts_with(lower(title), 'учёт') THEN 0 ELSE 1 END AS how FROM latest WHERE contains(lower(title), 'учёт') ORDER BY how, title, unit_id LIMIT 50"))(lambda t: docs.search_titles(t.doc_units, "учёт"))
op(
    "op_D06_ingest_diff",
    q(f"""SELECT source, external_id, CASE WHEN a.was IS NULL THEN 'added' WHEN b.is_ IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM (SELECT source, external_id, version_hash AS old, true AS was FROM (SELECT *, row_number() OVER (PARTITION BY source, external_id ORDER BY updated_at DESC NULLS LAST, unit_id DESC) AS m FROM d WHERE updated_at < TIMESTAMP '{SINCE}') WHERE m = 1) a
    FULL JOIN (SELECT source, external_id, version_hash AS new, true AS is_ FROM latest) b USING (source, external_id) WHERE a.was IS NULL OR b.is_ IS NULL OR old IS NULL OR old IS DISTINCT FROM new"""),
)(lambda t: docs.ingest_diff(docs.latest(t.doc_units.where(F.col("updated_at") < SINCE)), docs.latest(t.doc_units)))

# ---- state ----
op(
    "op_I01_changed_fqns",
    q(f"""SELECT tenant_id, fqn, CASE WHEN a.was IS NULL THEN 'added' WHEN b.is_ IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM (SELECT tenant_id, fqn, min(config_version) AS old, true AS was FROM o WHERE first_seen < TIMESTAMP '{SINCE}' AND config_id = 'base' GROUP BY 1, 2) a
    FULL JOIN (SELECT tenant_id, fqn, list(DISTINCT config_version) FILTER (config_version IS NOT NULL) AS new, true AS is_ FROM o GROUP BY 1, 2) b USING (tenant_id, fqn) WHERE a.was IS NULL OR b.is_ IS NULL OR len(list_filter(new, lambda v: v IS DISTINCT FROM old)) > 0"""),
)(lambda t: state.changed_fqns(metadata.current(t.objects).where((F.col("first_seen") < SINCE) & (F.col("config_id") == "base")).groupBy("tenant_id", "fqn").agg(F.min("config_version").alias("version")), metadata.current(t.objects).select("tenant_id", "fqn", F.col("config_version").alias("version"))))
op("op_I02_stale_chunk_owners", q("SELECT DISTINCT o.tenant_id, o.fqn FROM o LEFT JOIN (SELECT tenant_id, owner_fqn AS fqn, list(DISTINCT config_id) FILTER (config_id IS NOT NULL) AS vs, count(*) AS n FROM k GROUP BY 1, 2) c USING (tenant_id, fqn) WHERE n IS NULL OR vs IS NULL OR NOT list_contains(vs, config_id)"))(lambda t: state.stale_chunk_owners(metadata.current(t.objects).select("tenant_id", "fqn", F.col("config_id").alias("version")), t.chunks.select("tenant_id", "owner_fqn", F.col("config_id").alias("version"))).distinct())


def stamps(t):
    return code.live_routines(t.routines).select("tenant_id", F.col("object_fqn").alias("owner_fqn"), F.col("config_id").alias("version"), (~F.col("unterminated")).alias("graph_built"), F.when(F.col("end_line").isNotNull(), F.col("config_id")).alias("graph_version"))


op("op_I03_stale_routine_owners", q("SELECT DISTINCT tenant_id, object_fqn AS owner_fqn FROM r WHERE NOT coalesce(NOT unterminated, false) OR config_id IS DISTINCT FROM CASE WHEN end_line IS NOT NULL THEN config_id END"))(lambda t: state.stale_routine_owners(stamps(t)))
op("op_I05_full_rebuild", q("SELECT tenant_id, max(starts_with(object_fqn, 'CommonModule.')) AS \"full\" FROM (SELECT DISTINCT tenant_id, object_fqn FROM r WHERE NOT coalesce(NOT unterminated, false) OR config_id IS DISTINCT FROM CASE WHEN end_line IS NOT NULL THEN config_id END) GROUP BY 1"))(lambda t: state.needs_full_rebuild(state.stale_routine_owners(stamps(t))))


def layers(t):
    e = metadata.reference_edges(t.type_refs).select(F.concat_ws("/", "tenant_id", "src").alias("src"), "rel", "dst")
    over = metadata.reference_edges(t.type_refs.where(F.col("seen_at") >= SINCE)).select(F.concat_ws("/", "tenant_id", "src").alias("src"), "rel", "dst")
    gone = t.objects.where("deleted_at is not null").select(F.concat_ws("/", "tenant_id", "fqn").alias("fqn"))
    return e, over, over.select(F.col("src").alias("fqn")), gone


LAYERS = f""", er AS (SELECT DISTINCT tenant_id || '/' || src AS src, rel, dst FROM refs), ov AS (SELECT DISTINCT tenant_id || '/' || owner_fqn AS src, 'REFERENCES' AS rel, ref_kind || '.' || trim(ref_name) AS dst FROM t WHERE category = 'reference' AND ref_kind IS NOT NULL AND trim(ref_name) <> '' AND owner_fqn IS NOT NULL AND seen_at >= TIMESTAMP '{SINCE}'),
gone AS (SELECT DISTINCT tenant_id || '/' || fqn AS fqn FROM objects WHERE deleted_at IS NOT NULL), ovk AS (SELECT * FROM ov WHERE src NOT IN (SELECT fqn FROM gone)) """
op("op_I10_merge_edge_rows", BASE.rstrip() + LAYERS + "SELECT src, rel, dst, 'working' AS layer FROM ovk UNION ALL SELECT src, rel, dst, 'release' FROM er WHERE src NOT IN (SELECT src FROM ov) AND src NOT IN (SELECT fqn FROM gone) AND (rel, dst) NOT IN (SELECT (rel, dst) FROM ovk)")(lambda t: state.merge_edge_rows(*layers(t)))
op("op_I11_tag_layer", BASE.rstrip() + LAYERS + "SELECT src, rel, dst, 'working' AS layer FROM ov WHERE dst NOT IN (SELECT fqn FROM gone)")(lambda t: state.tag_layer(layers(t)[1], layers(t)[3], "working").select("src", "rel", "dst", "layer"))
op("op_I13_namespaces", q("SELECT DISTINCT tenant_id || '@task/' || config_id AS overlay, tenant_id AS base, config_id AS task FROM o"))(lambda t: metadata.current(t.objects).select(F.concat("tenant_id", F.lit("@task/"), "config_id").alias("overlay")).distinct().select("overlay", state.base_tenant(F.col("overlay")).alias("base"), state.task_of(F.col("overlay")).alias("task")))
op("op_I14_live_merge", BASE.rstrip() + (", dirty AS (SELECT DISTINCT tenant_id, path FROM files WHERE mtime IS NULL) SELECT id, tenant_id, path, start_line FROM s WHERE (tenant_id, path) NOT IN (SELECT (tenant_id, path) FROM dirty) UNION ALL SELECT id, tenant_id, path, start_line + 1 FROM s WHERE (tenant_id, path) IN (SELECT (tenant_id, path) FROM dirty)"))(lambda t: state.live_merge(t.symbols.dropDuplicates(["id"]).select("id", "tenant_id", "path", "start_line"), t.symbols.dropDuplicates(["id"]).select("id", "tenant_id", "path", (F.col("start_line") + 1).alias("start_line")), t.files.where("mtime is null")))
op("op_I15_file_delta", f"SELECT tenant_id, path, CASE WHEN a.p IS NULL THEN 'added' WHEN b.p IS NULL THEN 'removed' ELSE 'updated' END AS change FROM (SELECT tenant_id, path, mtime AS old, 1 AS p FROM files WHERE kind = 'bsl') a FULL JOIN (SELECT tenant_id, path, CASE WHEN source = 'base' THEN mtime END AS new, 1 AS p FROM files WHERE mtime >= TIMESTAMP '{SINCE}' OR mtime IS NULL) b USING (tenant_id, path) WHERE a.p IS NULL OR b.p IS NULL OR old IS NULL OR new IS NULL OR old <> new")(lambda t: state.file_delta(t.files.where("kind = 'bsl'"), t.files.where((F.col("mtime") >= SINCE) | F.col("mtime").isNull()).select("tenant_id", "path", F.when(F.col("source") == "base", F.col("mtime")).alias("mtime"))))
op("op_K01_upsert", q("SELECT object_id, name, CASE WHEN kind = 'Enum' THEN NULL ELSE synonym END AS synonym FROM o"))(lambda t: state.upsert(metadata.current(t.objects).select("object_id", "name", "synonym"), metadata.current(t.objects).where("kind = 'Enum'").select("object_id", F.lit(None).cast("string").alias("synonym")), ["object_id"]))
op("op_K02_write_chunks", q("SELECT chunk_id FROM k WHERE (tenant_id, owner_fqn) IN (SELECT (tenant_id, fqn) FROM o)"))(lambda t: state.write_chunks(t.chunks.dropDuplicates(["chunk_id"]), metadata.current(t.objects)).select("chunk_id"))
op("op_K05_without_tombstones", q("SELECT chunk_id FROM k WHERE (tenant_id, owner_fqn) NOT IN (SELECT (tenant_id, fqn) FROM objects WHERE deleted_at IS NOT NULL)"))(lambda t: state.without(t.chunks.dropDuplicates(["chunk_id"]), t.objects.where("deleted_at is not null").select("tenant_id", F.col("fqn").alias("owner_fqn")), ["tenant_id", "owner_fqn"]).select("chunk_id"))
op("op_H13_fingerprint")(lambda t: state.fingerprint(t.files, "tenant_id", ["path", "mtime"]))

# ---- metrics ----
op("op_A01_objects_by_kind", q("SELECT tenant_id, kind, count(*) AS n FROM o GROUP BY 1, 2"))(lambda t: metrics.objects_by(t.objects, "kind"))
op("op_A03_calls_by_kind", g("SELECT kind, confidence, count(*) AS n FROM e GROUP BY 1, 2"))(lambda t: metrics.calls_by_kind(edges(t)))
op("op_A04_entry_points", BASE.rstrip() + SPREAD + "SELECT category, count(*) AS n FROM en JOIN entries ON low = lower(name) GROUP BY 1")(lambda t: metrics.entry_points_by(spread_entries(t)))
op("op_A04_overrides_by_mode", q("SELECT override_mode, count(*) AS n FROM r WHERE override_mode IS NOT NULL GROUP BY 1"))(lambda t: metrics.overrides_by_mode(t.routines))
op("op_A05_fan_in", g("SELECT tenant_id, callee AS fqn, count(DISTINCT caller) AS n FROM e GROUP BY 1, 2 ORDER BY n DESC, fqn, tenant_id LIMIT 10"))(lambda t: metrics.top_fan(edges(t), "callee"))
op("op_A05_fan_out", g("SELECT tenant_id, caller AS fqn, count(DISTINCT callee) AS n FROM e GROUP BY 1, 2 ORDER BY n DESC, fqn, tenant_id LIMIT 10"))(lambda t: metrics.top_fan(edges(t), "caller"))
op("op_A06_code_bytes", "SELECT tenant_id, source, kind, count(*) AS n_files, sum(coalesce(strlen(content), 0))::BIGINT AS n_bytes, sum(CASE WHEN content IS NULL THEN 0 ELSE len(string_split(content, chr(10))) END)::BIGINT AS n_lines FROM files GROUP BY 1, 2, 3")(lambda t: metrics.code_bytes(t.files))
op("op_A09_counts", "SELECT 'calls' AS label, count(DISTINCT call_id) AS n FROM calls UNION ALL SELECT 'chunks', count(DISTINCT chunk_id) FROM chunks UNION ALL SELECT 'objects', count(DISTINCT object_id) FROM objects UNION ALL SELECT 'routines', count(DISTINCT routine_id) FROM routines")(lambda t: metrics.counts({"objects": (t.objects, "object_id"), "routines": (t.routines, "routine_id"), "calls": (t.calls, "call_id"), "chunks": (t.chunks, "chunk_id")}))
STATEMENT = "SELECT object, count(*) AS n FROM symbols WHERE export = 1 GROUP BY object ORDER BY n DESC, object LIMIT 50"
op("op_A11_gateway", f"SELECT *, false AS truncated FROM ({STATEMENT})")(lambda t: metrics.gateway(t.spark, STATEMENT, {"symbols": t.symbols, "calls": t.calls, "files": t.files}))
op("op_A12_parse_stats", g("SELECT kind, count(*) AS n FROM res GROUP BY 1"))(lambda t: code.parse_stats(code.resolve_calls(t.calls, t.routines, t.objects)))
op("op_A13_top_methods", q("SELECT method_low, n, total, n_values, n_values > 20 AS truncated FROM (SELECT method_low, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS total, count(*) OVER () AS n_values FROM c GROUP BY 1) ORDER BY n DESC, method_low LIMIT 20"))(lambda t: metrics.top_with_total(t.calls.select("call_id", "method_low").distinct(), "method_low"))


def queries() -> dict:
    return {name: (lambda spark, d, f=f: f(Tables(spark, d))) for name, (f, _) in OPS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in OPS.items() if sql}
