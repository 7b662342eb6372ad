"""Queries of the graph: metadata files are made from the tables, parsed, built into nodes and edges and asked. The SQL
takes the same facts from the tables themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import code, graph, metadata, state
from tessera.plans import domain, dumps
from tessera.plans.domain import BASE, KIND, KINDS_SQL, NAME, RESOLVED, Tables, q
from tessera.sources import metadata_xml, trees
from tessera.util import settle, shared_dir

OPS: dict = {}


def op(name: str, sql: str | None = None):
    def add(f):
        OPS[name] = (f, sql)
        return f

    return add


def g(body: str) -> str:
    return f"{BASE.rstrip()}, {KINDS_SQL}{dumps.TABLES}{body}"


HELD: dict = {}


def once(build):
    """The table that ``build`` gives, written to the shared folder when it is first asked for in a session and scale."""

    def get(t):
        key = (build.__name__, t.spark.sparkContext.applicationId, t.sf_dir)
        if key not in HELD:
            HELD[key] = settle(build(t))
        return HELD[key]

    return get


@once
def records(t):
    return metadata_xml.records(dumps.files(t))


@once
def nodes(t):
    return graph.nodes(records(t), graph.modules(t.files))


@once
def edges(t):
    return graph.edges(records(t), graph.modules(t.files), metadata_xml.rights(dumps.right_files(t)))


@once
def parsed_forms(t):
    return metadata_xml.forms(dumps.form_files(t)).withColumnRenamed("path", "form")


def calls(t):
    return code.call_edges(code.resolve_calls(t.calls, t.routines, t.objects))


# ---- build ----
op("op_P01_nodes", g("SELECT tenant_id, label, fqn, arg_min(config_id, (config_id <> 'base', config_id)) AS config_id FROM gn GROUP BY 1, 2, 3"))(lambda t: nodes(t).select("tenant_id", "label", "fqn", "config_id"))
op("op_P01_edges", g("SELECT DISTINCT tenant_id, src, rel, dst FROM ge"))(lambda t: edges(t).select("tenant_id", "src", "rel", "dst"))
op("op_P04_required", g("SELECT DISTINCT tenant_id, dst AS fqn, length(string_split(dst, '.')[-1]) % 2 = 0 AS required FROM ge WHERE rel IN ('HAS_ATTRIBUTE', 'HAS_DIMENSION')"))(lambda t: nodes(t).where("label = 'Field'").select("tenant_id", "fqn", (F.col("props")["required"] == "true").alias("required")))
op("op_P05_rights_rollup", g("SELECT ba.tenant_id, 'Role.Полные' AS role, ba.fqn AS object, 'Read' || CASE WHEN length(name) % 2 = 0 THEN ',Update' ELSE '' END || CASE WHEN EXISTS (SELECT 1 FROM fl WHERE fl.tenant_id = ba.tenant_id AND fl.fqn = ba.fqn) THEN ',View' ELSE '' END AS granted FROM ba"))(
    lambda t: edges(t).where("rel = 'HAS_RIGHT_ON'").select("tenant_id", F.col("src").alias("role"), F.col("dst").alias("object"), F.col("props")["granted"].alias("granted"))
)
op("op_P06_stubs", g("SELECT DISTINCT tenant_id, dst AS fqn, CASE WHEN contains(dst, '.') THEN split_part(dst, '.', 1) ELSE 'Unresolved' END AS kind FROM ge WHERE rel IN ('REFERENCES', 'OWNED_BY') AND (tenant_id, dst) NOT IN (SELECT (tenant_id, fqn) FROM gn WHERE label = 'Object')"))(
    lambda t: graph.with_stubs(nodes(t), edges(t)).where("props['stub'] = 'true'").select("tenant_id", "fqn", F.col("props")["kind"].alias("kind"))
)
op("op_P07_split_handler", g("SELECT tenant_id, fqn, module, method FROM li"))(lambda t: edges(t).where("rel = 'HANDLED_BY'").select("tenant_id", F.col("src").alias("fqn"), F.col("dst").alias("module"), F.col("props")["method"].alias("method")))
op("op_S14_modules", g("SELECT tenant_id, config_id, fqn AS object_fqn, module AS module_type FROM md WHERE fqn IS NOT NULL"))(lambda t: graph.modules(t.files).where("form is null").select("tenant_id", "config_id", "object_fqn", "module_type").distinct())
op("op_K01_upsert_nodes", g("SELECT tenant_id, label, fqn, CASE WHEN label = 'Form' THEN 'new' ELSE arg_min(config_id, (config_id <> 'base', config_id)) END AS config_id FROM gn GROUP BY 1, 2, 3"))(
    lambda t: state.upsert(nodes(t).select("tenant_id", "label", "fqn", "config_id"), nodes(t).where("label = 'Form'").select("tenant_id", "label", "fqn", F.lit("new").alias("config_id")), ["tenant_id", "label", "fqn"])
)
op("op_K06_wipe_objects", g(f"SELECT DISTINCT tenant_id, src, rel, dst FROM ge WHERE regexp_replace(src, '^([^.]+\\.[^.@]+).*$', '\\1') <> '{KIND}.{NAME}' AND regexp_replace(dst, '^([^.]+\\.[^.@]+).*$', '\\1') <> '{KIND}.{NAME}'"))(lambda t: wiped(t).select("tenant_id", "src", "rel", "dst"))


def wiped(t):
    n = graph.with_stubs(nodes(t), edges(t))
    return graph.wipe(n, edges(t), graph.gone_of(n, "object", None, t.spark.createDataFrame([(f"{KIND}.{NAME}",)], "fqn string")))[1]


TREES: dict = {}


def tree(t) -> str:
    """The folder of the written trees, made once for a session and scale."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in TREES:
        there = shared_dir(t.spark)
        root = f"{there if ':' in there else 'file://' + there}/trees-{uuid.uuid4().hex}"
        dumps.write_tree(t, root)
        TREES[key] = root
    return TREES[key]


def found_parts(t):
    return trees.find_parts(t.spark, tree(t))


def part_rows(t):
    rows = [(f.split("/")[-2], f.split("/")[-1], c, k) for f, c, k in found_parts(t)]
    return t.spark.createDataFrame(rows, "tenant_id string, folder string, config_id string, format string")


def tree_files(t, suffixes=(".xml",)):
    """The files of all parts, with their tenants."""
    return trees.read_tree(t.spark, [(config, folder) for folder, config, _ in found_parts(t)], suffixes).withColumn("tenant_id", F.element_at(F.split("root", "/"), -2))


op("op_S02_discover_parts", g("SELECT DISTINCT tenant_id, replace(config_id, ':', '_') AS folder, config_id, 'dump' AS format FROM oc UNION SELECT DISTINCT tenant_id, 'base', 'base', 'dump' FROM ba"))(part_rows)
PATHS_OF = "CASE WHEN kind LIKE '%y' THEN kind[:-2] || 'ies' ELSE kind || 's' END || '/' || name || '.xml'"
op("op_S04_read_tree", g(f"SELECT tenant_id, config_id, {PATHS_OF} AS path FROM oc UNION SELECT tenant_id, 'base', 'Subsystems/Учёт/Subsystems/' || kind || '.xml' FROM ba UNION SELECT DISTINCT tenant_id, 'base', x FROM ba, (VALUES ('Subsystems/Учёт.xml'), ('Roles/Полные.xml')) v(x) UNION SELECT tenant_id, 'base', 'EventSubscriptions/' || string_split(fqn, '.')[2] || '.xml' FROM li"))(
    lambda t: tree_files(t).where("path like '%/%'").select("tenant_id", "config_id", "path")
)
op("op_S07_dump_info", q("SELECT tenant_id, fqn, min(config_version) AS version FROM o WHERE config_id = 'base' AND config_version IS NOT NULL GROUP BY 1, 2"))(lambda t: trees.dump_versions(tree_files(t).withColumn("path", F.concat_ws("/", "tenant_id", "path"))).select(F.substring_index("path", "/", 1).alias("tenant_id"), "fqn", "version"))
op("op_S08_tree_objects", g("SELECT DISTINCT tenant_id, config_id, fqn, kind FROM oc"))(lambda t: metadata_xml.records(tree_files(t)).where("error is null and kind not in ('Subsystem', 'Role', 'EventSubscription', 'Configuration') and path like '%/%'").select("tenant_id", "config_id", "fqn", "kind"))

# ---- lookups ----
LINES = """, ln AS (SELECT tenant_id, fqn, role || ':' || n || ':' || string_agg(DISTINCT raw, ', ' ORDER BY raw) || ':' || CASE WHEN length(n) % 2 = 0 THEN '!' ELSE '' END || ':' || coalesce(string_agg(DISTINCT ref_kind || '.' || ref_name, '|' ORDER BY ref_kind || '.' || ref_name) FILTER (category = 'reference' AND ref_name IS NOT NULL), '') AS line, n FROM ft GROUP BY tenant_id, fqn, role, n),
ls AS (SELECT tenant_id, src AS fqn, rel, string_agg(DISTINCT regexp_replace(string_split(dst, '.')[-1], '@.*$', ''), ',' ORDER BY regexp_replace(string_split(dst, '.')[-1], '@.*$', '')) AS x FROM ge GROUP BY 1, 2, 3) """
op(
    "op_Q04_get_object",
    g(LINES + """SELECT n.tenant_id, n.fqn, config_id, coalesce((SELECT string_agg(line, ';' ORDER BY line) FROM ln WHERE ln.tenant_id = n.tenant_id AND ln.fqn = n.fqn), '') AS fields,
    coalesce((SELECT x FROM ls WHERE ls.tenant_id = n.tenant_id AND ls.fqn = n.fqn AND rel = 'HAS_ENUM_VALUE'), '') AS enum_values, coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT regexp_replace(string_split(dst, '.')[-1], '@.*$', '') AS x FROM ge WHERE rel = 'HAS_FORM' AND ge.tenant_id = n.tenant_id AND src = n.fqn)), '') AS forms,
    coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT regexp_replace(string_split(dst, '.')[-1], '@.*$', '') AS x FROM ge WHERE rel = 'HAS_MODULE' AND ge.tenant_id = n.tenant_id AND src = n.fqn)), '') AS modules, coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM ge WHERE rel = 'OWNED_BY' AND ge.tenant_id = n.tenant_id AND src = n.fqn), '') AS owners,
    coalesce((SELECT string_agg(src, ',' ORDER BY src) FROM ge WHERE rel = 'CONTAINS' AND ge.tenant_id = n.tenant_id AND dst = n.fqn), '') AS subsystems, coalesce((SELECT x FROM ls WHERE ls.tenant_id = n.tenant_id AND ls.fqn = n.fqn AND rel = 'HAS_TABULAR_SECTION'), '') AS sections
    FROM (SELECT tenant_id, fqn, arg_min(config_id, (config_id <> 'base', config_id)) AS config_id FROM gn WHERE label = 'Object' GROUP BY 1, 2) n"""),
)(lambda t: graph.cards(nodes(t), edges(t)).select("tenant_id", "fqn", "config_id", F.array_join("fields", ";").alias("fields"), *[F.array_join(c, ",").alias(c) for c in ("enum_values", "forms", "modules", "owners", "subsystems")], F.array_join(F.transform("tabular", lambda x: F.substring_index(x, " ", 1)), ",").alias("sections")))
op("op_P09_capped_cards", g("SELECT n.tenant_id, n.fqn, least(count(f.n), 2)::INTEGER AS shown, count(f.n)::INTEGER AS n_fields FROM (SELECT DISTINCT tenant_id, fqn FROM gn WHERE label = 'Object') n LEFT JOIN fl f USING (tenant_id, fqn) GROUP BY 1, 2"))(lambda t: graph.capped(graph.cards(nodes(t), edges(t)), {"fields": 2}).select("tenant_id", "fqn", F.size("fields").alias("shown"), "n_fields"))
op("op_Q06_find_type_usages", g(f"SELECT DISTINCT tenant_id, src AS owner FROM gr WHERE dst = '{KIND}.{NAME}'"))(lambda t: graph.references(edges(t)).where(F.col("dst") == f"{KIND}.{NAME}").select("tenant_id", F.col("src").alias("owner")))
WANTED = "(SELECT DISTINCT tenant_id, fqn FROM oc)"
op("op_Q07_get_dependencies", g(f"SELECT gd.tenant_id, src AS fqn, 'out' AS direction, rel, dst AS other FROM gd JOIN {WANTED} w ON w.tenant_id = gd.tenant_id AND w.fqn = src UNION ALL SELECT gd.tenant_id, dst, 'in', rel, src FROM gd JOIN {WANTED} w ON w.tenant_id = gd.tenant_id AND w.fqn = dst"))(lambda t: metadata.get_dependencies(graph.dependencies(edges(t)), metadata.current(t.objects)))
op("op_Q08_impact_analysis", g(f"SELECT gd.tenant_id, dst AS fqn, 'in' AS direction, rel, src AS other FROM gd JOIN {WANTED} w ON w.tenant_id = gd.tenant_id AND w.fqn = dst"))(lambda t: metadata.get_dependencies(graph.dependencies(edges(t)), metadata.current(t.objects), "in"))
op("op_Q11_subscriptions_for", g("SELECT DISTINCT ba.tenant_id, ba.name, li.fqn AS source, 'OnWrite' AS event FROM li JOIN ba ON ba.tenant_id = li.tenant_id AND ba.kind = 'Document' WHERE lower(ba.name) = (SELECT min(lower(name)) FROM ba WHERE kind = 'Document')"))(lambda t: subscriptions(t))


def subscriptions(t):
    name = metadata.current(t.objects).where("kind = 'Document' and config_id = 'base'").agg(F.min(F.lower("name"))).first()[0] or ""
    types = records(t).where("kind = 'EventSubscription'").select("tenant_id", F.col("fqn").alias("source"), "event", F.transform(F.filter("source_types", lambda x: x["ref_name"].isNotNull()), lambda x: F.concat_ws(".", x["ref_kind"], x["ref_name"])).alias("types"))
    hit = metadata.subscriptions_for(types, name.upper())
    names = metadata.current(t.objects).where((F.lower("name") == name) & (F.col("kind") == "Document")).select("tenant_id", "name").distinct()
    return hit.join(names, "tenant_id").select("tenant_id", "name", "source", "event")


def writes(t):
    return records(t).where("kind = 'Document'").select(F.concat_ws("/", "tenant_id", "config_id").alias("source"), F.col("name").alias("document"), F.col("register_records").alias("registers"))


op("op_Q12_writes_to", g("SELECT DISTINCT oc.tenant_id || '/' || oc.config_id AS source, oc.name AS document FROM oc JOIN rg ON rg.tenant_id = oc.tenant_id AND rg.m = length(oc.name) % 3 WHERE oc.kind = 'Document' AND lower(rg.fqn) LIKE '%.' || (SELECT min(lower(name)) FROM oc WHERE kind LIKE '%Register')"))(
    lambda t: metadata.writes_to(writes(t), (metadata.current(t.objects).where("kind like '%Register'").agg(F.min(F.lower("name"))).first()[0] or "").upper(), True)
)
op("op_A02_kinds_within", g("SELECT tenant_id, 'Subsystem.Учёт' AS root, kind, count(DISTINCT fqn) AS n FROM ba GROUP BY 1, 3 UNION ALL SELECT tenant_id, 'Subsystem.Учёт.Subsystem.' || kind, kind, count(DISTINCT fqn) FROM ba GROUP BY 1, 2, 3"))(lambda t: graph.kinds_within(nodes(t), edges(t), nodes(t).where("label = 'Object' and props['kind'] = 'Subsystem'").select("tenant_id", "fqn")))
op("op_V06_chunk_filter", g(f"SELECT chunk_id FROM k WHERE chunk_kind IN ('code', 'object') AND (tenant_id, owner_fqn) IN (SELECT (tenant_id, fqn) FROM oc WHERE kind IN ('{KIND}', 'Document')) AND (tenant_id, owner_fqn) IN (SELECT (tenant_id, fqn) FROM ba)"))(lambda t: filtered(t))


def filtered(t):
    from tessera.operators.search import chunk_filter

    n = nodes(t)
    owners = n.where("label = 'Object'").select("tenant_id", "fqn", F.col("props")["kind"].alias("kind"))
    within = graph.in_subsystems(edges(t), n.where("label = 'Object' and fqn = 'Subsystem.Учёт'").select("tenant_id", "fqn"))
    return graph.chunks_of(chunk_filter(t.chunks.dropDuplicates(["chunk_id"]), kinds=["code", "object"]), owners, {"kind": [KIND, "Document"]}, within).select("chunk_id")


op(
    "op_V17_object_context",
    g("""SELECT w.tenant_id, w.fqn, (SELECT count(DISTINCT dst) FROM ge WHERE ge.tenant_id = w.tenant_id AND src = w.fqn AND rel IN ('HAS_ATTRIBUTE', 'HAS_DIMENSION', 'HAS_RESOURCE')) AS n_attributes, coalesce((SELECT string_agg(DISTINCT src, ',' ORDER BY src) FROM ge WHERE ge.tenant_id = w.tenant_id AND dst = w.fqn AND rel = 'CONTAINS'), '') AS subsystems,
    coalesce((SELECT array_to_string(list_sort(list(DISTINCT dst))[1:10], ',') FROM gr WHERE gr.tenant_id = w.tenant_id AND gr.src = w.fqn), '') AS refs, coalesce((SELECT string_agg(DISTINCT dst, ',' ORDER BY dst) FROM ge WHERE ge.tenant_id = w.tenant_id AND src = w.fqn AND rel = 'WRITES_TO'), '') AS writes_to FROM (SELECT DISTINCT tenant_id, fqn FROM oc) w"""),
)(lambda t: graph.context_of_objects(edges(t), metadata.current(t.objects)).select("tenant_id", "fqn", "n_attributes", *[F.array_join(c, ",").alias(c) for c in ("subsystems", "refs", "writes_to")]))


# ---- forms, services, templates ----
FORMS = ", fr AS (SELECT DISTINCT tenant_id, config_id, split_part(fqn, '::', 1) AS form, name, directive IS NOT NULL AS wired FROM r WHERE fqn LIKE '%.Form.%'), fx AS (SELECT tenant_id, config_id, form, name, bool_or(wired) AS wired FROM fr GROUP BY 1, 2, 3, 4) "
op("op_S15_form_handlers", g(FORMS + "SELECT tenant_id, form, 'OnChange' AS event, name AS handler, 'Поле' || name AS element FROM fx WHERE wired UNION ALL SELECT DISTINCT tenant_id, form, 'OnOpen', 'НетТакого', NULL FROM fx"))(lambda t: parsed_forms(t).select("tenant_id", "form", F.explode("handlers").alias("h")).select("tenant_id", "form", "h.event", "h.handler", "h.element"))
op("op_S17_form_items", g(FORMS + "SELECT DISTINCT tenant_id, form, 'Группа/Поле' || name AS way, 'Объект.' || name AS data_path FROM fr UNION ALL SELECT DISTINCT tenant_id, form, '/Группа', NULL FROM fr"))(lambda t: parsed_forms(t).select("tenant_id", "form", F.explode("items").alias("i")).select("tenant_id", "form", F.concat_ws("/", "i.trail", "i.name").alias("way"), "i.data_path").distinct())
op("op_C04_handles", g(FORMS + "SELECT DISTINCT tenant_id, form, form || '::' || name AS routine, 'OnChange' AS event, 'Поле' || name AS element FROM fx WHERE wired"))(lambda t: graph.handles(parsed_forms(t), t.routines).select("tenant_id", "form", "routine", "event", "element"))
op("op_C14_find_handlers", g(FORMS + domain.SPREAD + "SELECT DISTINCT tenant_id, object_fqn, module_type AS place, fqn AS routine, category AS entry FROM en JOIN entries ON low = lower(name) WHERE (tenant_id, fqn) NOT IN (SELECT (tenant_id, form || '::' || name) FROM fx WHERE wired) UNION SELECT r.tenant_id, object_fqn, module_type, r.fqn, 'событие_формы' FROM r JOIN fx ON wired AND r.tenant_id = fx.tenant_id AND r.fqn = form || '::' || fx.name"))(
    lambda t: graph.find_handlers(graph.handles(parsed_forms(t), t.routines), domain.spread_entries(t))
)
op("op_K04_routine_nodes", g(FORMS + "SELECT tenant_id, fqn, arg_min(config_id, (config_id <> 'base', config_id, name)) AS config_id, bool_or((tenant_id, fqn) IN (SELECT (tenant_id, form || '::' || name) FROM fx WHERE wired)) AS wired FROM r GROUP BY 1, 2"))(lambda t: graph.routine_nodes(t.routines, graph.handles(parsed_forms(t), t.routines)).select("tenant_id", "fqn", "config_id", F.coalesce(F.col("props")["entry_point"] == "событие_формы", F.lit(False)).alias("wired")))
op(
    "op_K04_routine_edges",
    g(FORMS + RESOLVED.replace("{f}", "") + """SELECT DISTINCT tenant_id, split_part(fqn, '::', 1) AS src, 'DECLARES' AS rel, fqn AS dst FROM r UNION ALL SELECT DISTINCT tenant_id, form, 'HANDLES', form || '::' || name FROM fx WHERE wired
    UNION ALL SELECT DISTINCT tenant_id, fqn, 'OVERRIDES', regexp_replace(split_part(fqn, '::', 1), '@ext:.*$', '') || '::' || override_target FROM r WHERE override_mode IS NOT NULL AND override_target IS NOT NULL AND contains(split_part(fqn, '::', 1), '@ext:') UNION ALL SELECT tenant_id, caller, 'CALLS', callee FROM e"""),
)(lambda t: graph.routine_edges(t.routines, graph.handles(parsed_forms(t), t.routines), calls(t)).select("tenant_id", "src", "rel", "dst"))
op("op_Q17_get_form", g(FORMS + ", pl AS (SELECT tenant_id, regexp_replace(form, '@ext:.*$', '') AS f, config_id, name, wired FROM fx), fi AS (SELECT tenant_id, f, arg_min(config_id, (config_id = 'base', config_id)) AS config_id FROM pl GROUP BY 1, 2), it AS (SELECT pl.*, 'Поле' || name AS item, 0 AS grp FROM pl JOIN fi USING (tenant_id, f, config_id) UNION ALL SELECT DISTINCT tenant_id, f, config_id, NULL, false, 'Группа', 1 FROM pl JOIN fi USING (tenant_id, f, config_id)) SELECT tenant_id, f AS form, config_id, item, place, total FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, f ORDER BY wired DESC, grp, item)::INTEGER AS place, count(*) OVER (PARTITION BY tenant_id, f)::INTEGER AS total FROM it) WHERE place <= 40"))(
    lambda t: graph.form_card(parsed_forms(t).withColumn("form", F.regexp_replace("form", "@ext:.*$", "")))
)
op("op_S18_service_operations", g("SELECT DISTINCT tenant_id, object_fqn AS path, '/' || lower(name) AS name, upper(name) AS handler FROM r WHERE export AND object_fqn LIKE 'CommonModule.%' UNION ALL SELECT DISTINCT tenant_id, object_fqn, '/none', 'НетТакого' FROM r WHERE export AND object_fqn LIKE 'CommonModule.%'"))(lambda t: metadata_xml.services(dumps.service_files(t)).select("tenant_id", "path", "name", "handler"))
op("op_Q18_get_service", g("SELECT tenant_id, object_fqn, upper(name) AS handler, true AS declared, min(start_line) AS line FROM (SELECT DISTINCT * FROM routines) WHERE (tenant_id, object_fqn, lower(name)) IN (SELECT (tenant_id, object_fqn, lower(name)) FROM r WHERE export AND object_fqn LIKE 'CommonModule.%') GROUP BY 1, 2, 3 UNION ALL SELECT DISTINCT tenant_id, object_fqn, 'НетТакого', false, NULL FROM r WHERE export AND object_fqn LIKE 'CommonModule.%'"))(
    lambda t: metadata.service_operations(metadata_xml.services(dumps.service_files(t)).select("tenant_id", F.col("path").alias("object_fqn"), "handler").distinct(), t.routines)
)
op("op_Q19_get_template", g("SELECT ba.tenant_id, ba.fqn AS path, part, x.name FROM ba JOIN (SELECT tenant_id, fqn, 'field' AS part, n AS name FROM fl UNION SELECT tenant_id, fqn, 'set', 'Набор' FROM fl UNION SELECT tenant_id, fqn, 'parameter', 'Период' FROM fl UNION SELECT tenant_id, fqn, 'variant', 'Основной' FROM fl UNION SELECT tenant_id, fqn, 'query', 'ВЫБРАТЬ ' || string_agg(DISTINCT n, ', ' ORDER BY n) FROM fl GROUP BY 1, 2) x ON x.tenant_id = ba.tenant_id AND x.fqn = ba.fqn WHERE kind = 'Report'"))(
    lambda t: metadata_xml.schemas(dumps.schema_files(t)).select("tenant_id", "path", "part", F.coalesce("name", "value").alias("name")).distinct()
)


def queries() -> dict:
    return {name: (lambda spark, d, f=f: f(Tables(spark, d))) for name, (f, _) in OPS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in OPS.items() if sql}
