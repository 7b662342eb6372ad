"""What an index is fed with and what state it is in: chunks of all kinds, units of full text, name and reverse indexes,
documents with their links, snapshots, overlays, status.

Inputs are the node and edge tables of ``graph`` and the index's own tables. Nulls match nothing; repeated rows
count once; empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.code import entry_point, live_routines, module_of
from tessera.operators.metadata import current
from tessera.operators.text import kind_ru, search_tokens, sha1_text

#: Comment lines above a routine that belong to its unit, and characters that a unit may have.
HEAD_LINES, UNIT_CHARS = 40, 40_000
# What roles of fields are called.
ROLE_RU = {"Attribute": "реквизит", "Dimension": "измерение", "Resource": "ресурс"}


def _title(synonym: Column, name: Column) -> Column:
    return F.coalesce(F.when(F.trim(synonym) != "", F.trim(synonym)), name)


def part_chunks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(tenant_id, chunk, owner_fqn, chunk_kind, name, text, text_ident): chunks of enum values, predefined items
    and forms, by one join of parts to their objects for all three."""
    o = nodes.where("label = 'Object'").select("tenant_id", F.col("fqn").alias("src"), F.col("name").alias("owner"), F.col("props").alias("op"))
    rels = {"HAS_ENUM_VALUE": "EnumValue", "HAS_PREDEFINED": "Predefined", "HAS_FORM": "Form"}
    n = nodes.where(F.col("label").isin(*rels.values())).select("tenant_id", "label", F.col("fqn").alias("dst"), "name", F.col("props").alias("p"))
    j = edges.where(F.col("rel").isin(*rels)).select("tenant_id", "src", "rel", "dst").join(n, ["tenant_id", "dst"]).join(o, ["tenant_id", "src"])
    head = F.concat(kind_ru(F.col("op")["kind"]), F.lit(" «"), _title(F.col("op")["synonym"], F.col("owner")), F.lit("»"))
    value = F.concat(head, F.lit(" ▸ значение «"), _title(F.col("p")["synonym"], F.col("name")), F.lit("» ("), "name", F.lit(")"))
    item = F.concat(head, F.lit(" ▸ предопределённый элемент «"), _title(F.col("p")["description"], F.col("name")), F.lit("» ("), "name", F.lit(")"))
    form = F.when(F.col("op")["kind"] == "CommonForm", F.concat(head, F.lit(" ("), "name", F.lit(")"))).otherwise(F.concat(head, F.lit(" ▸ форма «"), "name", F.lit("»")))
    form = F.concat(form, F.coalesce(F.concat(F.lit(". "), F.col("p")["text"]), F.lit("")))
    text = F.when(F.col("label") == "EnumValue", value).when(F.col("label") == "Predefined", item).otherwise(form)
    mark = F.when(F.col("label") == "EnumValue", "#val").when(F.col("label") == "Predefined", "#pre").otherwise("#form")
    kind = F.when(F.col("label") == "EnumValue", "enum_value").when(F.col("label") == "Predefined", "predefined").otherwise("form")
    return j.select("tenant_id", F.concat("dst", mark).alias("chunk"), F.col("src").alias("owner_fqn"), kind.alias("chunk_kind"), "name", text.alias("text"), F.concat_ws(" ", "name", "owner").alias("text_ident"))


#: How many fields an object's chunk lists, and members or rights those of subsystems and roles.
CARD_FIELDS, CARD_MEMBERS = 30, 40


def _objects(nodes: DataFrame) -> DataFrame:
    """(tenant_id, fqn, name, kind, title, comment) of objects that are no stubs."""
    p = F.col("props")
    o = nodes.where("label = 'Object' and not coalesce(props['stub'] = 'true', false)")
    return o.select("tenant_id", "fqn", "name", p["kind"].alias("kind"), _title(p["synonym"], F.col("name")).alias("title"), p["comment"].alias("comment"))


def _fields(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(tenant_id, owner, field, name, role, title, types, required, comment): fields with what they belong to."""
    p = F.col("props")
    f = nodes.where("label = 'Field'").select("tenant_id", F.col("fqn").alias("field"), "name", p["role"].alias("role"), _title(p["synonym"], F.col("name")).alias("title"), F.coalesce(F.when(F.trim(p["type_text"]) != "", F.trim(p["type_text"])), F.lit("—")).alias("types"), F.coalesce(p["required"] == "true", F.lit(False)).alias("required"), p["comment"].alias("comment"))
    own = edges.where("rel in ('HAS_ATTRIBUTE', 'HAS_DIMENSION', 'HAS_RESOURCE')").select("tenant_id", F.col("src").alias("owner"), F.col("dst").alias("field"))
    return own.join(f, ["tenant_id", "field"])


def _listed(rows: DataFrame, by: list[str], order: list, text: Column, most: int) -> DataFrame:
    """The first ``most`` texts of each key, joined by semicolons."""
    x = F.slice(F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{n}") for n, c in enumerate(order)], text.alias("x")))), 1, most)
    return rows.groupBy(*by).agg(F.array_join(F.transform(x, lambda r: r["x"]), "; ").alias("listed"))


def _sentences(*parts: Column) -> Column:
    return F.concat_ws(". ", *parts)


def object_chunks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(tenant_id, chunk, owner_fqn, chunk_kind, text): objects with their first fields, by role and name;
    subsystems with what they contain, roles with their rights, by name."""
    o = _objects(nodes)
    head = F.concat(kind_ru(F.col("kind")), F.lit(" «"), "title", F.lit("» ("), "name", F.lit(")"))
    f = _fields(nodes, edges)
    f = _listed(f.withColumnRenamed("owner", "fqn"), ["tenant_id", "fqn"], [F.col("role"), F.col("name")], F.concat_ws(": ", "title", "types"), CARD_FIELDS)
    label = F.when(F.col("kind").isin("Catalog", "Document"), "Реквизиты: ").otherwise("Поля: ")
    member = o.select("tenant_id", F.col("fqn").alias("dst"), F.col("name").alias("m"), F.col("title").alias("mt"))
    held = edges.where("rel = 'CONTAINS'").select("tenant_id", F.col("src").alias("fqn"), "dst").join(member, ["tenant_id", "dst"])
    right = edges.where("rel = 'HAS_RIGHT_ON'").select("tenant_id", F.col("src").alias("fqn"), "dst", F.replace(F.coalesce(F.col("props")["granted"], F.lit("")), F.lit(","), F.lit(", ")).alias("g")).join(member, ["tenant_id", "dst"])
    parts = [
        (o.where("kind not in ('Subsystem', 'Role')"), f, "object", label),
        (o.where("kind = 'Subsystem'"), _listed(held, ["tenant_id", "fqn"], [F.col("m"), F.col("dst")], F.col("mt"), CARD_MEMBERS), "subsystem", F.lit("Состав: ")),
        (o.where("kind = 'Role'"), _listed(right, ["tenant_id", "fqn"], [F.col("m"), F.col("dst")], F.concat_ws(": ", "mt", "g"), CARD_MEMBERS), "role", F.lit("Права на объекты: ")),
    ]
    return reduce(DataFrame.unionByName, [x.join(y, ["tenant_id", "fqn"], "left").select("tenant_id", F.concat("fqn", F.lit(f"#{kind}")).alias("chunk"), F.col("fqn").alias("owner_fqn"), F.lit(kind).alias("chunk_kind"), _sentences(head, "comment", F.concat(lead, "listed")).alias("text")) for x, y, kind, lead in parts])


def attribute_chunks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(tenant_id, chunk, owner_fqn, chunk_kind, text): a chunk for each field of an object, and for each of a tabular
    section, with its role, types, and whether it must be filled."""
    f = _fields(nodes, edges)
    o = _objects(nodes).select("tenant_id", F.col("fqn").alias("object"), kind_ru(F.col("kind")).alias("k"), F.col("title").alias("ot"))
    section = nodes.where("label = 'TabularSection'").select("tenant_id", F.col("fqn").alias("owner"), _title(F.col("props")["synonym"], F.col("name")).alias("section"))
    of = edges.where("rel = 'HAS_TABULAR_SECTION'").select("tenant_id", F.col("src").alias("object"), F.col("dst").alias("owner"))
    ru = F.coalesce(F.create_map(*[F.lit(x) for kv in ROLE_RU.items() for x in kv])[F.col("role")], F.lit("реквизит"))
    named = F.concat(F.lit(" «"), "title", F.lit("» ("), "name", F.lit("): "), "types", F.when(F.col("required"), " [обязательный реквизит]").otherwise(""))
    head = F.concat("k", F.lit(" «"), "ot", F.lit("» ▸ "))
    own = f.withColumnRenamed("owner", "object").join(o, ["tenant_id", "object"]).select("tenant_id", F.concat("field", F.lit("#attr")).alias("chunk"), F.col("object").alias("owner_fqn"), F.lit("attribute").alias("chunk_kind"), _sentences(F.concat(head, ru, named), "comment").alias("text"))
    inner = f.join(of, ["tenant_id", "owner"]).join(section, ["tenant_id", "owner"]).join(o, ["tenant_id", "object"])
    inner = inner.select("tenant_id", F.concat("field", F.lit("#tsattr")).alias("chunk"), F.col("object").alias("owner_fqn"), F.lit("tabular_attribute").alias("chunk_kind"), F.concat(head, F.lit("табличная часть «"), "section", F.lit("» ▸ реквизит"), named).alias("text"))
    return own.unionByName(inner)


def all_chunks(nodes: DataFrame, edges: DataFrame, code: DataFrame, docs: DataFrame) -> DataFrame:
    """(chunk, chunk_kind, text): every chunk that is embedded, of all sources once: objects, fields, parts, and those of
    code and documents (chunk, text)."""
    text = lambda df, kind: df.select("chunk", F.lit(kind).alias("chunk_kind"), "text")
    own = [x.select("chunk", "chunk_kind", "text") for x in (object_chunks(nodes, edges), attribute_chunks(nodes, edges), part_chunks(nodes, edges))]
    return reduce(DataFrame.unionByName, [*own, text(code, "code"), text(docs, "doc")]).groupBy("chunk", "chunk_kind").agg(F.min("text").alias("text"))


def routine_units(routines: DataFrame, files: DataFrame) -> DataFrame:
    """(routine_id, display, tokens, body, line): a routine with up to ``HEAD_LINES`` lines above it, but not into the
    routine before, cut at ``UNIT_CHARS``. Where a routine begins is taken from the table; the file is split once."""
    from tessera.operators.text import bodies

    r = live_routines(routines).where("file_id is not null and start_line >= 1 and end_line >= start_line")
    w = Window.partitionBy("file_id").orderBy("start_line", "routine_id")
    r = r.withColumn("before", F.coalesce(F.lag("end_line").over(w), F.lit(0)))
    first = F.greatest(F.col("before") + 1, F.col("start_line") - HEAD_LINES)
    tokens = search_tokens(F.col("name"), F.col("object_fqn"), F.col("module_type"), F.col("region"))
    r = r.select("routine_id", F.col("name").alias("display"), tokens.alias("tokens"), F.col("start_line").alias("line"), "file_id", F.least(first, F.col("start_line")).alias("start_line"), "end_line")
    return bodies(r, files, ["routine_id", "display", "tokens", "line"]).withColumn("body", F.substring("body", 1, UNIT_CHARS))


def object_units(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(tenant_id, fqn, title, body): an object with its synonym, fields, sections and values as one unit."""
    o = nodes.where("label = 'Object'").select("tenant_id", "fqn", "name", F.col("props")["kind"].alias("kind"), F.col("props")["synonym"].alias("synonym"))
    parts = nodes.where("label in ('Field', 'TabularSection', 'EnumValue')").select("tenant_id", F.substring_index("fqn", ".", 2).alias("fqn"), F.trim(F.concat_ws(" ", "name", F.col("props")["synonym"])).alias("x")).groupBy("tenant_id", "fqn").agg(F.array_join(F.array_sort(F.collect_set("x")), "\n").alias("parts"))
    body = F.substring(F.concat_ws("\n", "synonym", "parts"), 1, UNIT_CHARS)
    return o.join(parts, ["tenant_id", "fqn"], "left").select("tenant_id", "fqn", search_tokens(F.col("kind"), F.col("name"), F.col("synonym")).alias("title"), body.alias("body"))


def signatures(routines: DataFrame, files: DataFrame, most: int = 5) -> DataFrame:
    """(routine_id, signature, entry_point): the declaration's lines up to the bracket that closes it, at most
    ``most``, joined by blanks."""
    from tessera.operators.text import bodies

    r = live_routines(routines).where("start_line >= 1").select("routine_id", "name", "file_id", "start_line", (F.col("start_line") + most - 1).alias("end_line"))
    lines = F.transform(F.split("body", "\n"), lambda x: F.trim(F.regexp_replace(x, r"\r", "")))
    count = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    upto = F.transform(F.sequence(F.lit(1), F.size(lines)), lambda n: F.array_join(F.slice(lines, F.lit(1), n), " "))
    done = F.filter(upto, lambda x: F.contains(x, F.lit("(")) & (count(x, "(") <= count(x, ")")))
    return bodies(r, files, ["routine_id", "name"]).select("routine_id", F.coalesce(F.get(done, 0), F.get(upto, F.size(upto) - 1)).alias("signature"), entry_point(F.col("name")).alias("entry_point"))


def name_index(objects: DataFrame) -> DataFrame:
    """Lower-case name -> the (kind, fqn) of that name."""
    o = current(objects).select("tenant_id", F.lower("name").alias("low"), "kind", "fqn").distinct()
    return o.groupBy("tenant_id", "low").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "kind", "fqn"))), ",").alias("found"), F.count(F.lit(1)).alias("n"))


def reverse_index(routines: DataFrame) -> DataFrame:
    """(tenant_id, module, method, fqn): what a call in an unchanged module may go to; of one name the last by id."""
    r = live_routines(routines).select("tenant_id", module_of(F.col("fqn")).alias("module"), F.col("name").alias("method"), "routine_id", "fqn")
    return r.groupBy("tenant_id", "module", "method").agg(F.max(F.struct("routine_id", "fqn"))["fqn"].alias("fqn"))


def incremental_calls(resolved: DataFrame, stale: DataFrame, routines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, anew): edges (tenant_id, caller, callee) of callers whose owners are not stale, and the callers that
    are resolved anew: those of stale owners, and those that call into them, as targets may be gone."""
    owner = live_routines(routines).select("tenant_id", F.col("fqn"), F.col("object_fqn").alias("owner_fqn")).distinct()
    old = owner.join(stale.select("tenant_id", "owner_fqn").distinct(), ["tenant_id", "owner_fqn"], "left_semi").select("tenant_id", "fqn").distinct()
    into = resolved.join(old.select("tenant_id", F.col("fqn").alias("callee")), ["tenant_id", "callee"], "left_semi").select("tenant_id", F.col("caller").alias("fqn"))
    anew = old.unionByName(into).distinct()
    return resolved.join(anew.select("tenant_id", F.col("fqn").alias("caller")), ["tenant_id", "caller"], "left_anti"), anew


def graph_inputs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tenant_id, module, owner_fqn, owner_kind, config_id): modules and forms with the object that owns them."""
    m = edges.where("rel in ('HAS_MODULE', 'HAS_FORM')").select("tenant_id", F.col("dst").alias("module"), F.col("src").alias("owner_fqn"))
    o = nodes.where("label = 'Object'").select("tenant_id", F.col("fqn").alias("owner_fqn"), F.col("props")["kind"].alias("owner_kind"))
    c = nodes.where("label in ('Module', 'Form')").select("tenant_id", F.col("fqn").alias("module"), "config_id")
    return m.join(o, ["tenant_id", "owner_fqn"]).join(c, ["tenant_id", "module"])


def to_embed(chunks: DataFrame, stored: DataFrame, full: bool = False) -> tuple[DataFrame, DataFrame]:
    """(todo, gone): chunks (chunk, text) whose text has no vector yet, all if ``full``, and stored keys (chunk,
    text_hash) that no chunk has. Texts are compared by hash, so moved rows cost nothing."""
    now = chunks.select("chunk", "text", sha1_text(F.col("text")).alias("text_hash"))
    gone = stored.select("chunk").distinct().join(now.select("chunk"), "chunk", "left_anti")
    return (now if full else now.join(stored.select("chunk", "text_hash").distinct(), ["chunk", "text_hash"], "left_anti")), gone


def overlay_sets(overlay: DataFrame, deleted: DataFrame) -> DataFrame:
    """(tenant_id, fqn, state): what a task has touched, and what it has deleted; an object that is there again is not
    deleted."""
    t = overlay.select("tenant_id", "fqn").distinct()
    d = deleted.select("tenant_id", "fqn").distinct().join(t, ["tenant_id", "fqn"], "left_anti")
    return t.withColumn("state", F.lit("touched")).unionByName(d.withColumn("state", F.lit("tombstone")))


def masked_routines(routines: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(tenant_id, name, masked): whether all owners of a name's routines are tombstones."""
    t = tombstones.select("tenant_id", F.col("fqn").alias("object_fqn")).distinct().withColumn("gone", F.lit(True))
    j = live_routines(routines).select("tenant_id", "name", "object_fqn").distinct().join(t, ["tenant_id", "object_fqn"], "left")
    return j.groupBy("tenant_id", "name").agg(F.min(F.coalesce("gone", F.lit(False))).alias("masked"))


def status(files: DataFrame, indexed: DataFrame, units: DataFrame) -> DataFrame:
    """I16: per tenant the state of its index: ``missing`` without files in it, ``empty`` without units, ``outdated`` if any
    file is new, gone or of another time, else ``built``; with counts."""
    keys = ["tenant_id", "path"]
    f = files.select(*keys, "mtime").dropDuplicates(keys).withColumn("on_disk", F.lit(True))
    i = indexed.select(*keys, F.col("mtime").alias("stored")).dropDuplicates(keys).withColumn("in_index", F.lit(True))
    j = f.join(i, keys, "full")
    differs = F.col("on_disk").isNull() | F.col("in_index").isNull() | ~F.col("mtime").eqNullSafe(F.col("stored"))
    s = j.groupBy("tenant_id").agg(F.count("on_disk").alias("n_files"), F.count("in_index").alias("n_indexed"), F.sum(differs.cast("bigint")).alias("n_changed"))
    u = units.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_units"))
    state = F.when(F.col("n_indexed") == 0, "missing").when(F.col("n_units") == 0, "empty").when(F.col("n_changed") > 0, "outdated").otherwise("built")
    return s.join(u, "tenant_id", "left").na.fill(0, ["n_units"]).withColumn("state", state)


def orphans_of_index(units: DataFrame, files: DataFrame) -> DataFrame:
    """I16: units (tenant_id, path, id) whose file is no longer there."""
    return units.join(files.select("tenant_id", "path").distinct(), ["tenant_id", "path"], "left_anti")


def snapshot(objects: DataFrame) -> DataFrame:
    """(tenant_id, fqn, version): the least version of an object's copies, as written beside a release."""
    return current(objects).groupBy("tenant_id", "fqn").agg(F.min("config_version").alias("version"))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(tenant_id, fqn, change) between two snapshots."""
    a, b = old.select("tenant_id", "fqn", F.col("version").alias("was"), F.lit(1).alias("a")), new.select("tenant_id", "fqn", F.col("version").alias("now"), F.lit(1).alias("b"))
    j = a.join(b, ["tenant_id", "fqn"], "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return j.select("tenant_id", "fqn", change.alias("change")).where("change is not null")


def file_version(files: DataFrame) -> DataFrame:
    """(tenant_id, path, version) of project metadata: the hash of the file itself, whatever its modules are."""
    return files.where(F.lower("path").endswith(".mdo") & F.col("content").isNotNull()).select("tenant_id", "path", F.sha1("content").alias("version"))


def document_links(units: DataFrame, objects: DataFrame, related: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, links): a node for each document's last version, and its MENTIONS of objects that are there, given or
    found in the text, and RELATES_TO with a confidence (``related``: external_id, source, fqn, confidence)."""
    from tessera.operators.docs import latest
    from tessera.operators.text import link_mentions

    u = latest(units)
    docs = u.select(F.concat_ws(":", "source", "external_id").alias("fqn"), F.when(F.col("source") == "artifact", "Artifact").otherwise("Document").alias("label"), "title", "version_hash")
    m = link_mentions(u, objects).join(u.select("unit_id", F.concat_ws(":", "source", "external_id").alias("src")), "unit_id").select("src", F.lit("MENTIONS").alias("rel"), F.col("fqn").alias("dst"), F.lit(None).cast("double").alias("confidence"))
    if related is not None:
        m = m.unionByName(related.select(F.concat_ws(":", "source", "external_id").alias("src"), F.lit("RELATES_TO").alias("rel"), F.col("fqn").alias("dst"), "confidence"))
    return docs, m.distinct()


def ingest_manifest(entries: list[dict], builders: dict, stored: DataFrame) -> DataFrame:
    """(source, external_id, change) over the entries of a manifest, each built by its type's builder to units
    (external_id, version_hash) and compared with what is stored of its source."""
    from tessera.operators.docs import ingest_diff

    out = None
    for e in entries:
        units = builders[e["type"]](e).withColumn("source", F.lit(e.get("source", e["type"])))
        one = ingest_diff(stored.where(F.col("source") == e.get("source", e["type"])), units.select("source", "external_id", "version_hash"))
        out = one if out is None else out.unionByName(one)
    return out


# Other names of modules.
MODULE_ALIASES = {"object": "ObjectModule", "manager": "ManagerModule", "recordset": "RecordSetModule", "value": "ValueManagerModule", "command": "CommandModule", "session": "SessionModule", "application": "ManagedApplicationModule"}


def pick_module(modules: DataFrame, wanted: str = "") -> DataFrame:
    """(tenant_id, object_fqn, module, available): the module that a name means for each object: an alias, a file's
    stem, ``Form:<name>``; without a name ``Module``, else the only one there is; null where none or several fit.
    ``modules``: tenant_id, object_fqn, module_type, form."""
    name = F.when(F.col("form").isNotNull(), F.concat(F.lit("Form:"), "form")).otherwise(F.col("module_type"))
    g = modules.select("tenant_id", "object_fqn", name.alias("m")).groupBy("tenant_id", "object_fqn").agg(F.array_sort(F.collect_set("m")).alias("all"))
    stem = MODULE_ALIASES.get(wanted.lower(), wanted.removesuffix(".bsl"))
    pick = F.when(F.array_contains("all", stem), F.lit(stem)) if wanted else F.when(F.array_contains("all", "Module"), F.lit("Module")).when(F.size("all") == 1, F.get("all", 0))
    return g.select("tenant_id", "object_fqn", pick.alias("module"), F.array_join("all", ",").alias("available"))


def overview(objects: DataFrame, routines: DataFrame, edges: DataFrame, overrides: DataFrame, files: DataFrame) -> DataFrame:
    """(tenant_id, metric, key, n): the inventory of a tenant as rows: objects by kind and configuration, routines,
    entry points, calls by kind and confidence, overrides by mode, modules and bytes of code."""
    r, o = live_routines(routines), current(objects)
    code = files.where("kind = 'bsl'")

    def rows(metric: str, df: DataFrame, key: Column, n: Column | None = None) -> DataFrame:
        return df.groupBy("tenant_id", key.cast("string").alias("key")).agg((F.count(F.lit(1)) if n is None else F.sum(n)).cast("bigint").alias("n")).select("tenant_id", F.lit(metric).alias("metric"), "key", "n")

    none = F.lit(None)
    parts = [
        rows("objects_by_kind", o, F.col("kind")), rows("objects_by_config", o, F.col("config_id")), rows("routines", r, none), rows("entry_points", r.withColumn("e", entry_point(F.col("name"))).where("e is not null"), F.col("e")),
        rows("calls", edges, F.concat_ws("/", "kind", "confidence")), rows("overrides", overrides, F.col("mode")), rows("modules", code, none), rows("code_bytes", code, none, F.coalesce(F.octet_length("content"), F.lit(0))),
    ]
    return reduce(DataFrame.unionByName, parts)
