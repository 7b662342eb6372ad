"""The graph: nodes and edges of parsed metadata, modules, forms, rights and routines; sinks and wipes over both tables.

``nodes``: tenant_id, label, fqn, config_id, name, props (map). ``edges``: tenant_id, src_label, src, rel, dst_label,
dst, props. Of several copies of a node the first counts: the base's, then by configuration. An adopted copy
shares the object and its fields with the base; its details, forms and modules are told apart by ``@config_id``.
Records with an error, or without a name, give nothing; nulls in lists are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.code import entry_point, live_routines, module_of, override_edges
from tessera.operators.metadata import path_object

# Relations by the role of a field, and those between objects beside references.
ROLE_RELS = {"Attribute": "HAS_ATTRIBUTE", "Dimension": "HAS_DIMENSION", "Resource": "HAS_RESOURCE"}
RELATED = ("OWNED_BY", "WRITES_TO", "CONTAINS", "HAS_SUBSYSTEM", "SUBSCRIBES", "HANDLED_BY", "HAS_RIGHT_ON")
NODE = ["tenant_id", "label", "fqn", "config_id", "name", "props"]
EDGE = ["tenant_id", "src_label", "src", "rel", "dst_label", "dst", "props"]


def _map(**columns: Column) -> Column:
    """A map of what is set."""
    m = F.create_map(*[x for k, v in columns.items() for x in (F.lit(k), v.cast("string"))])
    return F.map_filter(m, lambda k, v: v.isNotNull() & (v != ""))


def _own(records: DataFrame) -> DataFrame:
    r = records.where("error is null and name <> '' and fqn is not null")
    adopted = (F.col("belonging") == "Adopted") & (F.col("config_id") != "base")
    return r.withColumn("mark", F.when(adopted, F.concat(F.lit("@"), "config_id")).otherwise(""))


def modules(files: DataFrame) -> DataFrame:
    """(tenant_id, config_id, object_fqn, form, module_type, path, size): modules by their paths (S14); config_id is
    the file's source."""
    p = F.regexp_replace("path", r"^ext/[^/]+/", "")
    form = F.regexp_extract(p, r"/Forms/([^/]+)", 1)
    name = F.regexp_extract(p, r"([^/]+)\.(?i:bsl)$", 1)
    f = files.where(F.lower("path").endswith(".bsl")).select("tenant_id", F.col("source").alias("config_id"), path_object(p).alias("object_fqn"), F.when(form != "", form).alias("form"), F.when(form != "", "FormModule").otherwise(name).alias("module_type"), "path", F.octet_length("content").alias("size"))
    return f.where("object_fqn is not null").dropDuplicates(["tenant_id", "config_id", "path"])


def _fields(r: DataFrame) -> DataFrame:
    """Fields with the node that they belong to."""
    direct = r.select("tenant_id", "config_id", F.lit("Object").alias("owner_label"), F.col("fqn").alias("owner"), F.explode("fields").alias("f"))
    section = r.select("tenant_id", "config_id", F.explode("tabular").alias("t")).select("tenant_id", "config_id", F.lit("TabularSection").alias("owner_label"), F.col("t.fqn").alias("owner"), F.explode("t.fields").alias("f"))
    return direct.unionByName(section)


def _marked(m: DataFrame, records: DataFrame) -> DataFrame:
    """Modules with their object's mark and their own fqn."""
    mark = _own(records).select("tenant_id", "config_id", F.col("fqn").alias("object_fqn"), "mark").dropDuplicates(["tenant_id", "config_id", "object_fqn"])
    fqn = F.concat("object_fqn", F.when(F.col("form").isNotNull(), F.concat(F.lit(".Form."), "form")).otherwise(F.concat(F.lit(".Module."), "module_type")), "mark")
    return m.join(mark, ["tenant_id", "config_id", "object_fqn"]).withColumn("fqn", fqn)


def nodes(records: DataFrame, modules: DataFrame) -> DataFrame:
    """The nodes of all labels."""
    r = _own(records)
    at = lambda label, fqn, name, props: [F.lit(label).alias("label"), fqn.alias("fqn"), "config_id", name.alias("name"), props.alias("props")]
    flags = F.map_from_entries(F.transform(F.map_entries(F.coalesce("flags", F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.concat(F.lit("flag_"), e["key"]), e["value"])))
    part = lambda column, label, **props: r.select("tenant_id", "config_id", F.explode(column).alias("x")).select("tenant_id", *at(label, F.col("x.fqn"), F.col("x.name"), _map(**{k: F.col(f"x.{v}") for k, v in props.items()})))
    f = _fields(r)
    m = _marked(modules, records)
    parts = [
        r.select("tenant_id", *at("Object", F.col("fqn"), F.col("name"), F.map_concat(_map(kind=F.col("kind"), synonym=F.col("synonym"), comment=F.col("comment"), uuid=F.col("uuid"), belonging=F.col("belonging")), flags))),
        r.where("size(details) > 0").select("tenant_id", *at("Detail", F.concat("fqn", "mark"), F.col("name"), F.col("details"))),
        f.select("tenant_id", *at("Field", F.col("f.fqn"), F.col("f.name"), _map(role=F.col("f.role"), synonym=F.col("f.synonym"), comment=F.col("f.comment"), type_text=F.col("f.type_text"), required=F.col("f.required"), is_reference=F.exists("f.types", lambda t: (t["category"] == "reference") & t["ref_name"].isNotNull())))),
        part("tabular", "TabularSection", synonym="synonym"),
        part("enum_values", "EnumValue", synonym="synonym"),
        part("predefined", "Predefined", code="code", description="description", is_folder="is_folder"),
        r.select("tenant_id", "config_id", "fqn", "mark", F.explode("forms").alias("form")).select("tenant_id", *at("Form", F.concat("fqn", F.lit(".Form."), "form", "mark"), F.col("form"), _map())),
        m.where("form is null").select("tenant_id", *at("Module", F.col("fqn"), F.col("module_type"), _map(path=F.col("path"), size=F.col("size")))),
    ]
    return first_of(reduce(DataFrame.unionByName, parts))


def first_of(nodes: DataFrame) -> DataFrame:
    """Of the copies of a (label, fqn) the base's, else the first configuration's."""
    order = F.struct((F.col("config_id") != "base").alias("ext"), "config_id", "name")
    n = nodes.where("fqn is not null").groupBy("tenant_id", "label", "fqn").agg(F.min_by(F.struct("config_id", "name", "props"), order).alias("n"))
    return n.select("tenant_id", "label", "fqn", "n.config_id", "n.name", "n.props")


def edges(records: DataFrame, modules: DataFrame, rights: DataFrame | None = None) -> DataFrame:
    """The edges of all relations, each (src, rel, dst) once."""
    r = _own(records)
    f = _fields(r)
    empty = _map()

    def rows(df, src_label, src, rel, dst_label, dst, props=empty):
        return df.select("tenant_id", src_label.alias("src_label") if isinstance(src_label, Column) else F.lit(src_label).alias("src_label"), src.alias("src"), rel.alias("rel") if isinstance(rel, Column) else F.lit(rel).alias("rel"), F.lit(dst_label).alias("dst_label"), dst.alias("dst"), props.alias("props"))

    def each(column):
        return r.select("tenant_id", "fqn", "mark", "event", F.explode(column).alias("x"))

    def of_type(t):
        return F.when((F.col(f"{t}.category") == "reference") & F.col(f"{t}.ref_name").isNotNull(), F.concat_ws(".", f"{t}.ref_kind", f"{t}.ref_name"))

    o = F.col("fqn")
    refs = f.select("tenant_id", F.col("f.fqn").alias("fqn"), F.explode("f.types").alias("t")).withColumn("to", of_type("t"))
    role = reduce(lambda a, kv: a.when(F.col("f.role") == kv[0], kv[1]), ROLE_RELS.items(), F.when(F.lit(False), "")).otherwise("HAS_ATTRIBUTE")
    parts = [
        rows(f, F.col("owner_label"), F.col("owner"), role, "Field", F.col("f.fqn")),
        rows(refs, "Field", o, "REFERENCES", "Object", F.col("to")),
        rows(r.where("size(details) > 0"), "Object", o, "HAS_DETAIL", "Detail", F.concat("fqn", "mark")),
        rows(each("tabular"), "Object", o, "HAS_TABULAR_SECTION", "TabularSection", F.col("x.fqn")),
        rows(each("enum_values"), "Object", o, "HAS_ENUM_VALUE", "EnumValue", F.col("x.fqn")),
        rows(each("predefined"), "Object", o, "HAS_PREDEFINED", "Predefined", F.col("x.fqn")),
        rows(each("forms"), "Object", o, "HAS_FORM", "Form", F.concat("fqn", F.lit(".Form."), "x", "mark")),
        rows(_marked(modules, records).where("form is null"), "Object", F.col("object_fqn"), "HAS_MODULE", "Module", o),
        rows(each("owners"), "Object", o, "OWNED_BY", "Object", F.col("x")),
        rows(each("register_records"), "Object", o, "WRITES_TO", "Object", F.col("x")),
        rows(each("content"), "Object", o, "CONTAINS", "Object", F.col("x")),
        rows(each("subsystems"), "Object", o, "HAS_SUBSYSTEM", "Object", F.col("x")),
        rows(each("source_types"), "Object", o, "SUBSCRIBES", "Object", of_type("x"), _map(event=F.col("event"))),
        rows(r.where("handler_module is not null"), "Object", o, "HANDLED_BY", "Object", F.col("handler_module"), _map(method=F.col("handler_method"))),
    ]
    if rights is not None:
        granted = rights.where("error is null and role is not null").select("tenant_id", F.concat(F.lit("Role."), "role").alias("fqn"), F.substring_index("object", ".", 2).alias("to"), F.explode_outer("granted").alias("g"))
        granted = granted.groupBy("tenant_id", "fqn", "to").agg(F.array_join(F.array_sort(F.collect_set("g")), ",").alias("granted"))
        parts.append(rows(granted, "Object", o, "HAS_RIGHT_ON", "Object", F.col("to"), _map(granted=F.col("granted"))))
    return merged(reduce(DataFrame.unionByName, parts))


def merged(edges: DataFrame) -> DataFrame:
    """Each (src, rel, dst) once, with the least of several properties; edges without an end are none."""
    e = edges.where("src is not null and dst is not null")
    return e.groupBy(*[c for c in EDGE if c != "props"]).agg(F.min_by("props", F.to_json("props")).alias("props"))


def with_stubs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes and a stub for each object that is only referred to."""
    there = nodes.where("label = 'Object'").select("tenant_id", F.col("fqn").alias("dst"))
    lost = edges.where("dst_label = 'Object'").select("tenant_id", "dst").distinct().join(there, ["tenant_id", "dst"], "left_anti")
    kind, name = F.when(F.col("dst").contains("."), F.substring_index("dst", ".", 1)).otherwise("Unresolved"), F.regexp_replace("dst", r"^[^.]*\.", "")
    stub = lost.select("tenant_id", F.lit("Object").alias("label"), F.col("dst").alias("fqn"), F.lit(None).cast("string").alias("config_id"), name.alias("name"), _map(kind=kind, stub=F.lit("true")).alias("props"))
    return nodes.unionByName(stub)


def handles(forms: DataFrame, routines: DataFrame) -> DataFrame:
    """(tenant_id, form, routine, name, event, element): handlers of a form's events that the form's module
    declares, exact by name; of several events of one handler the last in the file counts. ``forms``: tenant_id, form (its
    fqn), handlers."""
    h = forms.select("tenant_id", "form", F.posexplode("handlers").alias("n", "h")).groupBy("tenant_id", "form", F.col("h.handler").alias("name")).agg(F.max_by("h", "n").alias("h"))
    r = live_routines(routines).select("tenant_id", module_of(F.col("fqn")).alias("form"), "name", F.col("fqn").alias("routine")).distinct()
    return h.join(r, ["tenant_id", "form", "name"]).select("tenant_id", "form", "routine", "name", "h.event", "h.element")


def find_handlers(handles: DataFrame, routines: DataFrame) -> DataFrame:
    """(tenant_id, object_fqn, place, routine, entry): routines that the platform calls: a form's handlers, and
    module routines by name; a form's handler is told as such whatever its name."""
    r = live_routines(routines).select("tenant_id", "object_fqn", "fqn", "name", "module_type")
    h = handles.select("tenant_id", F.col("routine").alias("fqn"), F.col("event")).groupBy("tenant_id", "fqn").agg(F.min("event").alias("event"))
    j = r.join(h, ["tenant_id", "fqn"], "left").withColumn("entry", entry_point(F.col("name"), F.col("event")))
    return j.where("entry is not null").select("tenant_id", "object_fqn", F.col("module_type").alias("place"), F.col("fqn").alias("routine"), "entry").distinct()


def routine_nodes(routines: DataFrame, handles: DataFrame) -> DataFrame:
    """Routines as nodes, with what starts them."""
    h = handles.select("tenant_id", F.col("routine").alias("fqn"), "event").groupBy("tenant_id", "fqn").agg(F.min("event").alias("event"))
    r = live_routines(routines).join(h, ["tenant_id", "fqn"], "left")
    props = _map(routine_kind=F.col("routine_kind"), export=F.col("export"), region=F.col("region"), directive=F.col("directive"), object_fqn=F.col("object_fqn"), module_type=F.col("module_type"), entry_point=entry_point(F.col("name"), F.col("event")))
    return first_of(r.select("tenant_id", F.lit("Routine").alias("label"), "fqn", "config_id", "name", props.alias("props")))


def routine_edges(routines: DataFrame, handles: DataFrame, calls: DataFrame) -> DataFrame:
    """DECLARES, HANDLES, OVERRIDES and CALLS. ``calls`` are the resolved edges."""
    is_form = module_of(F.col("fqn")).contains(".Form.")
    at = lambda df, label, src, rel, dst, props: df.select("tenant_id", label.alias("src_label"), F.col(src).alias("src"), F.lit(rel).alias("rel"), F.lit("Routine").alias("dst_label"), F.col(dst).alias("dst"), props.alias("props"))
    own = live_routines(routines).withColumn("module", module_of(F.col("fqn")))
    parts = [
        at(own, F.when(is_form, "Form").otherwise("Module"), "module", "DECLARES", "fqn", _map()),
        at(handles, F.lit("Form"), "form", "HANDLES", "routine", _map(event=F.col("event"), element=F.col("element"))),
        at(override_edges(routines), F.lit("Routine"), "src", "OVERRIDES", "dst", _map(mode=F.col("mode"))),
        at(calls, F.lit("Routine"), "caller", "CALLS", "callee", _map(kind=F.col("kind"), confidence=F.col("confidence"))),
    ]
    return merged(reduce(DataFrame.unionByName, parts))


def references(edges: DataFrame) -> DataFrame:
    """(tenant_id, src, dst, rel): objects that refer to objects by fields, their own or those of tabular sections: the
    one and the two steps as equality joins of their own."""
    has = edges.where(F.col("rel").isin(*ROLE_RELS.values()))
    direct = has.where("src_label = 'Object'").select("tenant_id", F.col("src").alias("owner"), F.col("dst").alias("field"))
    section = edges.where("rel = 'HAS_TABULAR_SECTION'").select("tenant_id", F.col("src").alias("owner"), F.col("dst").alias("section"))
    two = has.where("src_label = 'TabularSection'").select("tenant_id", F.col("src").alias("section"), F.col("dst").alias("field")).join(section, ["tenant_id", "section"]).select("tenant_id", "owner", "field")
    to = edges.where("rel = 'REFERENCES'").select("tenant_id", F.col("src").alias("field"), "dst")
    return direct.unionByName(two).join(to, ["tenant_id", "field"]).select("tenant_id", F.col("owner").alias("src"), "dst", F.lit("REFERENCES").alias("rel")).distinct()


def dependencies(edges: DataFrame) -> DataFrame:
    """Q07, Q08: what objects depend on: references by fields, and the seven relations between objects."""
    related = edges.where(F.col("rel").isin(*RELATED)).select("tenant_id", "src", "dst", "rel").distinct()
    return references(edges).unionByName(related)


def cards(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Q04: a row per object: its properties and, as sorted lists, fields with type, need and references, tabular sections
    with their fields, enum values, predefined items, forms, modules, owners and subsystems. Every list is one aggregate
    on the object's key; nothing is asked per object."""
    keys = ["tenant_id", "fqn"]
    o = nodes.where("label = 'Object'").select(*keys, F.col("name"), F.col("props")["kind"].alias("kind"), F.col("props")["synonym"].alias("synonym"), "config_id")
    of = lambda label: nodes.where(F.col("label") == label).select("tenant_id", F.col("fqn").alias("dst"), F.col("name").alias("part"), F.col("props").alias("p"))
    own = lambda rel: edges.where(F.col("rel").isin(*([rel] if isinstance(rel, str) else rel))).select("tenant_id", "src_label", F.col("src").alias("fqn"), "dst")
    refs = edges.where("rel = 'REFERENCES'").groupBy("tenant_id", F.col("src").alias("dst")).agg(F.array_join(F.array_sort(F.collect_set("dst")), "|").alias("refs"))
    f = own(list(ROLE_RELS.values())).join(of("Field"), ["tenant_id", "dst"]).join(refs, ["tenant_id", "dst"], "left")
    f = f.withColumn("line", F.concat_ws(":", F.col("p")["role"], "part", F.col("p")["type_text"], F.when(F.col("p")["required"] == "true", "!").otherwise(""), F.coalesce("refs", F.lit(""))))
    lists = lambda df, name, line: df.groupBy(*keys).agg(F.array_sort(F.collect_list(line)).alias(name))
    inside = lists(f.where("src_label = 'TabularSection'"), "held", F.col("line")).withColumnRenamed("fqn", "dst")
    sections = own("HAS_TABULAR_SECTION").join(of("TabularSection"), ["tenant_id", "dst"]).join(inside, ["tenant_id", "dst"], "left")
    e, p = own("HAS_ENUM_VALUE").join(of("EnumValue"), ["tenant_id", "dst"]), own("HAS_PREDEFINED").join(of("Predefined"), ["tenant_id", "dst"])
    out = [
        lists(f.where("src_label = 'Object'"), "fields", F.col("line")), lists(sections, "tabular", F.concat_ws(" ", "part", F.array_join(F.coalesce("held", F.array().cast("array<string>")), ";"))), lists(e, "enum_values", F.col("part")),
        lists(p, "predefined", F.concat_ws(":", "part", F.col("p")["code"])), lists(own("HAS_FORM").join(of("Form"), ["tenant_id", "dst"]), "forms", F.col("part")), lists(own("HAS_MODULE").join(of("Module"), ["tenant_id", "dst"]), "modules", F.col("part")),
        lists(own("OWNED_BY"), "owners", F.col("dst")), lists(edges.where("rel = 'CONTAINS'").select("tenant_id", F.col("dst").alias("fqn"), "src"), "subsystems", F.col("src")),
    ]
    got = reduce(lambda a, b: a.join(b, keys, "left"), out, o)
    none = F.array().cast("array<string>")
    return got.select(*keys, "name", "kind", "synonym", "config_id", *[F.coalesce(c, none).alias(c) for c in ("fields", "tabular", "enum_values", "predefined", "forms", "modules", "owners", "subsystems")])


#: How many of an object's lists a card shows.
SHOWN = {"fields": 100, "tabular": 60, "predefined": 60, "forms": 200, "modules": 200}


def capped(cards: DataFrame, shown: dict[str, int] | None = None) -> DataFrame:
    """Cards with their lists cut and the totals beside."""
    shown = shown or SHOWN
    return cards.select(*[c for c in cards.columns if c not in shown], *[F.slice(c, 1, n).alias(c) for c, n in shown.items()], *[F.size(c).alias(f"n_{c}") for c in shown])


def wipe(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tables without some nodes (tenant_id, label, fqn) and without the edges at them."""
    keys = ["tenant_id", "label", "fqn"]
    g = gone.select(*keys).distinct()
    src, dst = g.select("tenant_id", F.col("label").alias("src_label"), F.col("fqn").alias("src")), g.select("tenant_id", F.col("label").alias("dst_label"), F.col("fqn").alias("dst"))
    return nodes.join(g, keys, "left_anti"), edges.join(src, src.columns, "left_anti").join(dst, dst.columns, "left_anti")


def gone_of(nodes: DataFrame, what: str, tenant: str | None, objects: DataFrame | None = None, source: str | None = None) -> DataFrame:
    """The nodes that a wipe takes: ``tenant``, ``chunks``, ``routines``, ``docs`` (with their chunks), ``source`` (its
    documents and chunks), ``object`` (all parts of the objects given) or ``scoped`` (these without modules, routines
    and chunks). Without a tenant the objects are those of all."""
    n = nodes if tenant is None else nodes.where(F.col("tenant_id") == tenant)
    if what in ("object", "scoped"):
        top = F.substring_index(F.regexp_replace(module_of(F.col("fqn")), "[@#].*$", ""), ".", 2)
        n = n.join(objects.select(F.col("fqn").alias("top")).distinct(), top == F.col("top"), "left_semi")
        return n if what == "object" else n.where(~F.col("label").isin("Module", "Routine", "Chunk"))
    doc = F.col("label").isin("Document", "Artifact") | ((F.col("label") == "Chunk") & F.col("props")["source"].isNotNull())
    return n.where({"tenant": F.lit(True), "chunks": F.col("label") == "Chunk", "routines": F.col("label") == "Routine", "docs": doc, "source": doc & (F.col("props")["source"] == source)}[what])


def assert_keys(nodes: DataFrame) -> DataFrame:
    """(tenant_id, label, fqn, n): keys that are there more than once; none in a sound table."""
    return nodes.groupBy("tenant_id", "label", "fqn").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def in_subsystems(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(tenant_id, root, fqn): the objects that subsystems (tenant_id, fqn) contain, themselves or by subsystems at any
    depth below them."""
    from tessera.operators.metrics import descendants

    at = lambda c: F.concat_ws("\x01", "tenant_id", c)
    below = descendants(edges.where("rel = 'HAS_SUBSYSTEM'").select(at("src").alias("parent"), at("dst").alias("child")), roots.select(at("fqn").alias("fqn")))
    held = edges.where("rel = 'CONTAINS'").select(at("src").alias("node"), "tenant_id", F.col("dst").alias("fqn"))
    return below.join(held, "node").select("tenant_id", F.substring_index("root", "\x01", -1).alias("root"), "fqn").distinct()


def kinds_within(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Objects by kind within subsystems and their descendants, stubs left out."""
    o = nodes.where("label = 'Object' and not coalesce(props['stub'] = 'true', false)").select("tenant_id", "fqn", F.col("props")["kind"].alias("kind"))
    return in_subsystems(edges, roots).join(o, ["tenant_id", "fqn"]).groupBy("tenant_id", "root", "kind").agg(F.count(F.lit(1)).alias("n"))


def chunks_of(chunks: DataFrame, owners: DataFrame, facets: dict[str, list], subsystem: DataFrame | None = None) -> DataFrame:
    """Chunks by facets of their owner (tenant_id, fqn, and a column for each facet: kind, platform_version,
    corpus_version, doc_topic, help_kind) and, with ``subsystem`` (tenant_id, fqn: its objects), by where the owner is."""
    for column, allowed in facets.items():
        owners = owners.where(F.col(column).isin(allowed) if allowed else F.lit(False))
    keys = owners.select("tenant_id", F.col("fqn").alias("owner_fqn")).distinct()
    out = chunks.join(keys, ["tenant_id", "owner_fqn"], "left_semi") if facets else chunks
    return out if subsystem is None else out.join(subsystem.select("tenant_id", F.col("fqn").alias("owner_fqn")).distinct(), ["tenant_id", "owner_fqn"], "left_semi")


def form_card(forms: DataFrame, limit: int = 40) -> DataFrame:
    """Q17: (tenant_id, form, config_id, item, place, total) of forms (tenant_id, form, config_id, items, handlers), form
    without its mark: an extension's form shadows the base's, and what it lacks is filled from the base's; items with
    handlers go first, then those with a command, then those with data; ``total`` counts all."""
    w = F.struct((F.col("config_id") == "base").alias("base"), "config_id")
    best = forms.groupBy("tenant_id", "form").agg(F.min(w)["config_id"].alias("config_id"), F.min_by("items", F.struct((F.size("items") == 0).alias("none"), w)).alias("items"), F.min_by("handlers", F.struct((F.size("handlers") == 0).alias("none"), w)).alias("handlers"))
    rank = lambda i: F.struct((-F.size(F.filter("handlers", lambda h: h["element"] == i["name"]))).alias("h"), i["command"].isNull().alias("c"), i["data_path"].isNull().alias("d"), i["name"].alias("item"))
    rows = best.select("tenant_id", "form", "config_id", F.size("items").alias("total"), F.posexplode(F.slice(F.array_sort(F.transform("items", rank)), 1, limit)).alias("n", "i"))
    return rows.select("tenant_id", "form", "config_id", F.col("i.item").alias("item"), (F.col("n") + 1).alias("place"), "total")


def context_of_objects(edges: DataFrame, wanted: DataFrame, refs: int = 10) -> DataFrame:
    """(tenant_id, fqn, n_attributes, subsystems, refs, writes_to): what stands around object hits (tenant_id, fqn): four
    aggregates over the edges of the hits, not a question for each."""
    keys = ["tenant_id", "fqn"]
    w = wanted.select(*keys).distinct()
    out = edges.withColumnRenamed("src", "fqn").join(w, keys, "left_semi")
    into = edges.withColumnRenamed("dst", "fqn").join(w, keys, "left_semi")
    listed = lambda df, c, name: df.groupBy(*keys).agg(F.array_sort(F.collect_set(c)).alias(name))
    attributes = out.where(F.col("rel").isin(*ROLE_RELS.values())).groupBy(*keys).agg(F.countDistinct("dst").alias("n_attributes"))
    r = references(edges).withColumnRenamed("src", "fqn").join(w, keys, "left_semi")
    got = w.join(attributes, keys, "left").join(listed(into.where("rel = 'CONTAINS'"), "src", "subsystems"), keys, "left").join(listed(r, "dst", "refs"), keys, "left").join(listed(out.where("rel = 'WRITES_TO'"), "dst", "writes_to"), keys, "left")
    none = F.array().cast("array<string>")
    return got.select(*keys, F.coalesce("n_attributes", F.lit(0)).alias("n_attributes"), F.coalesce("subsystems", none).alias("subsystems"), F.slice(F.coalesce("refs", none), 1, refs).alias("refs"), F.coalesce("writes_to", none).alias("writes_to"))


def context_of_documents(links: DataFrame, wanted: DataFrame) -> DataFrame:
    """(src, rel, dst) of document hits (src): the objects that they mention or are related to."""
    return links.join(wanted.select("src").distinct(), "src", "left_semi").select("src", "rel", "dst").distinct()
