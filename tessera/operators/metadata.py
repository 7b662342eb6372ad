"""Metadata lookups: objects, their fields and what refers to what.

Tables are the index's ``objects`` (object_id, tenant_id, fqn, kind, name, ...) and ``type_refs`` (one row
per type of a field). Repeated deliveries count once; an object is current while deleted_at is null. Nulls
in names match nothing; an empty table gives an empty result; columns that are not named here are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["tenant_id", "fqn"]
#: Lengths of the lists in one object's card: fields and, for registers and subsystems, others.
CARD_FIELDS = 100


def current(objects: DataFrame) -> DataFrame:
    """Each object once, without the deleted ones."""
    return objects.where("deleted_at is null").dropDuplicates(["object_id"])


def fields(type_refs: DataFrame) -> DataFrame:
    """Each type of a field once."""
    return type_refs.dropDuplicates(["ref_id"])


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """A window of the ordered rows with the total beside it; the order must be total. Only the window's
    rows are ordered to one place, the total is an aggregate of its own."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = df.orderBy(*order).offset(offset).limit(limit) if offset else df.orderBy(*order).limit(limit)
    return rows.crossJoin(F.broadcast(total))  # one row


def list_metadata(objects: DataFrame, kind: str | None = None, contains: str | None = None, limit: int = 200) -> DataFrame:
    """Q01: objects by kind and by a part of name or synonym, whatever its case, ordered by kind and name."""
    o = current(objects)
    if kind is not None:
        o = o.where(F.col("kind") == kind)
    if contains is not None:
        low = contains.lower()
        o = o.where(F.lower("name").contains(low) | F.lower("synonym").contains(low))
    return o.select("tenant_id", "kind", "name", "synonym", "fqn", "config_id", "object_id").orderBy("kind", "name", "tenant_id", "config_id", "object_id").limit(limit)


def list_configurations(objects: DataFrame) -> DataFrame:
    """Q02: objects and distinct versions by tenant and configuration."""
    return current(objects).groupBy("tenant_id", "config_id").agg(F.count(F.lit(1)).alias("n_objects"), F.countDistinct("config_version").alias("n_versions"))


def resolve(objects: DataFrame, names: DataFrame) -> DataFrame:
    """Q03: for each ``q`` of ``names`` and tenant one object with q as fqn or name, exact case; an fqn goes
    before a name, the base configuration before an extension, then the least fqn and id."""
    o = current(objects).select("tenant_id", "fqn", "name", "config_id", "object_id")
    by_fqn = o.join(names, o["fqn"] == names["q"]).withColumn("how", F.lit(0))
    by_name = o.join(names, o["name"] == names["q"]).withColumn("how", F.lit(1))
    best = F.min(F.struct("how", (F.col("config_id") != "base").alias("ext"), "fqn", "object_id"))
    return by_fqn.unionByName(by_name).groupBy("tenant_id", "q").agg(best.alias("b")).select("tenant_id", "q", "b.fqn", "b.object_id")


def get_object(objects: DataFrame, type_refs: DataFrame, routines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Cards of the objects in ``wanted`` (tenant_id, fqn): fields with their types (at most
    ``CARD_FIELDS``, with the total), modules and the number of routines."""
    wanted = wanted.select(*KEYS).distinct()
    o = current(objects).join(wanted, KEYS, "left_semi").groupBy("tenant_id", "fqn").agg(F.min("kind").alias("kind"), F.min("name").alias("name"), F.min("synonym").alias("synonym"), F.array_join(F.array_sort(F.collect_set("config_id")), ",").alias("configs"))
    f = fields(type_refs).select("tenant_id", F.col("owner_fqn").alias("fqn"), F.element_at(F.split("field_fqn", r"\."), -1).alias("field"), "raw").join(wanted, KEYS, "left_semi")
    f = f.groupBy("tenant_id", "fqn", "field").agg(F.array_join(F.array_sort(F.collect_set("raw")), "|").alias("types"))
    f = f.groupBy("tenant_id", "fqn").agg(F.array_join(F.slice(F.array_sort(F.collect_list(F.concat_ws(":", "field", "types"))), 1, CARD_FIELDS), ";").alias("fields"), F.count(F.lit(1)).alias("n_fields"))
    r = routines.where("deleted_at is null").dropDuplicates(["routine_id"]).select("tenant_id", F.col("object_fqn").alias("fqn"), "module_type").join(wanted, KEYS, "left_semi").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_routines"), F.array_join(F.array_sort(F.collect_set("module_type")), ",").alias("modules"))
    return o.join(f, KEYS, "left").join(r, KEYS, "left").na.fill(0, ["n_fields", "n_routines"])


def get_object_properties(objects: DataFrame) -> DataFrame:
    """Q05: an object's properties that are set, as a map without the key columns."""
    names = ["kind", "name", "synonym", "config_id", "belonging", "config_version"]
    m = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n) for n in names]))
    return current(objects).select("tenant_id", "fqn", "object_id", F.map_filter(m, lambda k, v: v.isNotNull()).alias("props"))


def find_type_usages(type_refs: DataFrame, kind: str, name: str) -> DataFrame:
    """Q06: owners whose fields, direct or in a tabular section, refer to the object; each once."""
    return type_refs.where((F.col("category") == "reference") & (F.col("ref_kind") == kind) & (F.lower(F.trim("ref_name")) == name.lower())).select("tenant_id", "owner_fqn").distinct()


def reference_edges(type_refs: DataFrame) -> DataFrame:
    """Edges owner -> object of all references by fields, each once."""
    ok = (F.col("category") == "reference") & F.col("ref_kind").isNotNull() & (F.trim("ref_name") != "")
    return type_refs.where(ok & F.col("owner_fqn").isNotNull()).select("tenant_id", F.col("owner_fqn").alias("src"), F.concat_ws(".", "ref_kind", F.trim("ref_name")).alias("dst"), F.lit("REFERENCES").alias("rel")).distinct()


def override_owner_edges(routines: DataFrame) -> DataFrame:
    """Edges from an extension's copy of a module to the object it overrides."""
    ext = (F.col("override_mode").isNotNull()) & F.col("fqn").contains("@ext:") & F.col("object_fqn").isNotNull()
    return routines.where(ext).select("tenant_id", F.concat(F.col("config_id")).alias("src"), F.col("object_fqn").alias("dst"), F.lit("EXTENDS").alias("rel")).distinct()


def get_dependencies(edges: DataFrame, wanted: DataFrame, direction: str = "both") -> DataFrame:
    """Q07, Q08 (direction "in"): neighbours of the objects in ``wanted`` (tenant_id, fqn) over all
    relations, tagged by direction."""
    wanted = wanted.select(*KEYS).distinct()
    out = edges.select("tenant_id", F.col("src").alias("fqn"), F.lit("out").alias("direction"), "rel", F.col("dst").alias("other")).join(wanted, KEYS, "left_semi")
    into = edges.select("tenant_id", F.col("dst").alias("fqn"), F.lit("in").alias("direction"), "rel", F.col("src").alias("other")).join(wanted, KEYS, "left_semi")
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction]


def dependency_summary(type_refs: DataFrame) -> DataFrame:
    """Q09: for each referred object the fields that refer to it, whatever the name's case, and their owners."""
    f = fields(type_refs).where("category = 'reference' and ref_kind is not null and trim(ref_name) <> ''")
    return f.groupBy("tenant_id", F.lower(F.concat_ws(".", "ref_kind", F.trim("ref_name"))).alias("target")).agg(F.countDistinct("field_fqn").alias("n_fields"), F.countDistinct("owner_fqn").alias("n_owners"))


def text_usages(files: DataFrame, pattern: str) -> DataFrame:
    """Q10: lines of text files that match; counted by file. Only matching files are split into lines."""
    hits = files.where(F.col("content").rlike(pattern)).select("tenant_id", "source", "path", F.explode(F.split("content", "\n")).alias("line")).where(F.col("line").rlike(pattern))
    return hits.groupBy("tenant_id", "source", "path").agg(F.count(F.lit(1)).alias("n_lines"))


def list_objects(objects: DataFrame, kind: str, contains: str | None = None) -> DataFrame:
    """Q13: distinct names of a kind over all configurations, with the first of them (base first) and
    whether there are several."""
    o = current(objects).where(F.col("kind") == kind)
    if contains:
        o = o.where(F.lower("name").contains(contains.lower()))
    order = F.when(F.col("config_id") == "base", F.lit("")).otherwise(F.col("config_id"))
    return o.groupBy("tenant_id", "name").agg(F.min(F.struct(order.alias("o"), "config_id"))["config_id"].alias("first_config"), (F.countDistinct("config_id") > 1).alias("in_multiple"))


def search_metadata(objects: DataFrame, files: DataFrame, term: str) -> DataFrame:
    """Q14: objects whose name or synonym holds the term, then files whose text does; each object once,
    the name hit before the text hit."""
    low = term.lower()
    names = current(objects).where(F.lower("name").contains(low) | F.lower("synonym").contains(low)).select("tenant_id", F.col("fqn").alias("hit"), F.lit(0).alias("how"))
    texts = files.where((F.col("kind") == "meta") & F.lower("content").contains(low)).select("tenant_id", path_object(F.col("path")).alias("hit"), F.lit(1).alias("how")).where("hit is not null")
    return names.unionByName(texts).groupBy("tenant_id", "hit").agg(F.min("how").alias("how"))


def find_objects(objects: DataFrame, name: str) -> DataFrame:
    """Q15: where a name is declared, extensions before the base."""
    w = Window.partitionBy("tenant_id").orderBy((F.col("config_id") == "base"), "config_id", "fqn", "object_id")
    return current(objects).where(F.lower("name") == name.lower()).select("tenant_id", "fqn", "config_id", F.row_number().over(w).alias("place"))


def kind_counts(objects: DataFrame) -> DataFrame:
    """Q16: objects by kind and configuration, distinct names."""
    return current(objects).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("tenant_id", "name").alias("n_names"), F.sum((F.col("config_id") != "base").cast("bigint")).alias("n_ext"))


def subscriptions_for(subscriptions: DataFrame, name: str) -> DataFrame:
    """Q11: subscriptions (source, event, types: array of names) whose types include the object."""
    return subscriptions.where(F.exists("types", lambda t: F.lower(F.substring_index(t, ".", -1)) == name.lower())).drop("types")


def writes_to(documents: DataFrame, name: str, reverse: bool = False) -> DataFrame:
    """Q12: registers that a document writes to, over all its copies, or the documents that write to a
    register. ``documents``: source, document, registers (array). Names whatever their case."""
    rows = documents.select("source", "document", F.explode("registers").alias("register"))
    low = name.lower()
    if reverse:
        return rows.where((F.lower("register") == low) | F.lower("register").endswith("." + low)).dropDuplicates(["source", "document"]).select("source", "document")
    return rows.where(F.lower("document") == low).groupBy("register").agg(F.min("source").alias("source"))


# Folders of an object dump and the kinds they stand for.
FOLDER_KINDS = {
    "AccountingRegisters": "AccountingRegister", "AccumulationRegisters": "AccumulationRegister", "BusinessProcesses": "BusinessProcess", "CalculationRegisters": "CalculationRegister", "Catalogs": "Catalog", "ChartsOfAccounts": "ChartOfAccounts", "ChartsOfCalculationTypes": "ChartOfCalculationTypes", "ChartsOfCharacteristicTypes": "ChartOfCharacteristicTypes", "CommandGroups": "CommandGroup", "CommonAttributes": "CommonAttribute", "CommonCommands": "CommonCommand", "CommonForms": "CommonForm", "CommonModules": "CommonModule", "CommonPictures": "CommonPicture", "CommonTemplates": "CommonTemplate", "Constants": "Constant", "DataProcessors": "DataProcessor", "DefinedTypes": "DefinedType", "DocumentJournals": "DocumentJournal", "DocumentNumerators": "DocumentNumerator", "Documents": "Document", "Enums": "Enum", "EventSubscriptions": "EventSubscription", "ExchangePlans": "ExchangePlan", "ExternalDataSources": "ExternalDataSource", "FilterCriteria": "FilterCriterion", "FunctionalOptions": "FunctionalOption", "FunctionalOptionsParameters": "FunctionalOptionsParameter", "HTTPServices": "HTTPService", "InformationRegisters": "InformationRegister", "IntegrationServices": "IntegrationService", "Languages": "Language", "Reports": "Report", "Roles": "Role", "ScheduledJobs": "ScheduledJob", "Sequences": "Sequence", "SessionParameters": "SessionParameter", "SettingsStorages": "SettingsStorage", "StyleItems": "StyleItem", "Subsystems": "Subsystem", "Tasks": "Task", "WebServices": "WebService", "WSReferences": "WSReference", "XDTOPackages": "XDTOPackage",
}


def path_kind(path: Column) -> Column:
    """The kind that a path's folder stands for, after an optional ``src/``."""
    folder = F.regexp_extract(path, r"^(?:src/)?([A-Za-z]+)/", 1)
    table = F.create_map(*[F.lit(x) for kv in FOLDER_KINDS.items() for x in kv])
    return table[F.when(folder != "", folder)]


def path_object(path: Column) -> Column:
    """The fqn of the object that a path belongs to; nested subsystems keep their way."""
    name = F.regexp_replace(F.regexp_extract(path, r"^(?:src/)?[A-Za-z]+/([^/]+)", 1), r"\.[A-Za-z]+$", "")
    deep = F.regexp_extract_all(path, F.lit(r"Subsystems/([^/]+)"), 1)
    nested = F.array_join(F.transform(deep, lambda x: F.concat(F.lit("Subsystem."), F.regexp_replace(x, r"\.[A-Za-z]+$", ""))), ".")
    return F.when(path_kind(path) == "Subsystem", nested).when(path_kind(path).isNotNull() & (name != ""), F.concat_ws(".", path_kind(path), name))


def describe_paths(files: DataFrame) -> DataFrame:
    """P10: kind, object, form and module that each file's path tells."""
    form = F.regexp_extract("path", r"/Forms/([^/]+)", 1)
    module = F.regexp_extract("path", r"([^/]+)\.(?i:bsl)$", 1)
    return files.select("file_id", path_kind(F.col("path")).alias("kind_of"), path_object(F.col("path")).alias("object"), F.when(form != "", form).alias("form"), F.when(module != "", module).alias("module"))


def owner_by_prefix(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """The longest root that a path lies under. Roots are a small listing; instead of testing every
    pair, each path is exploded into its own prefixes and joined by equality."""
    parts = paths.select("path", F.split("path", "/").alias("parts"))
    p = parts.select("path", "parts", F.posexplode("parts").alias("n", "part")).select("path", "n", F.array_join(F.slice("parts", F.lit(1), F.col("n") + 1), "/").alias("root"))
    return p.join(roots.select("root").distinct(), "root").groupBy("path").agg(F.max(F.struct("n", "root"))["root"].alias("root"))


def first_of_copies(objects: DataFrame) -> DataFrame:
    """Of several copies of an fqn the first: base, then by configuration name."""
    w = Window.partitionBy("tenant_id", "fqn").orderBy((F.col("config_id") != "base"), "config_id", "object_id")
    return current(objects).withColumn("nth", F.row_number().over(w)).where("nth = 1").select("tenant_id", "fqn", "config_id", "object_id")


def artifact_fqns(objects: DataFrame) -> DataFrame:
    """What an object's modules, forms and details are called: adopted copies get their configuration."""
    q = F.when((F.col("belonging") == "Adopted") & (F.col("config_id") != "base"), F.concat("fqn", F.lit(".Module@"), "config_id")).otherwise(F.concat("fqn", F.lit(".Module")))
    return current(objects).select("tenant_id", "object_id", q.alias("artifact"))


def stubs(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Destinations of edges that are no object, as stubs; the kind is Unresolved without a point."""
    there = current(objects).select("tenant_id", F.col("fqn").alias("dst"))
    kind = F.when(F.col("dst").contains("."), F.substring_index("dst", ".", 1)).otherwise("Unresolved")
    return edges.select("tenant_id", "dst").distinct().join(there, ["tenant_id", "dst"], "left_anti").select("tenant_id", F.col("dst").alias("fqn"), kind.alias("kind"))


def rights_rollup(rights: DataFrame) -> DataFrame:
    """(role, object, granted array) -> per role and top-level object the sorted union of rights."""
    top = F.substring_index("object", ".", 2)
    return rights.select("role", top.alias("object"), F.explode("granted").alias("r")).groupBy("role", "object").agg(F.array_sort(F.collect_set("r")).alias("granted"))


def merged_copies(members: DataFrame) -> DataFrame:
    """Members (tenant_id, fqn, config_id, member) of all copies of an object as the platform sees it:
    the copy with most members, then what others add by names not seen before, whatever their case."""
    size = members.groupBy("tenant_id", "fqn", "config_id").agg(F.count(F.lit(1)).alias("n"))
    m = members.join(size, ["tenant_id", "fqn", "config_id"])
    best = F.min(F.struct((-F.col("n")).alias("n"), "config_id", "member"))
    return m.groupBy("tenant_id", "fqn", F.lower("member").alias("low")).agg(best.alias("b")).select("tenant_id", "fqn", "b.member", "b.config_id")


def split_handler(c: Column) -> Column:
    """``CommonModule.X.Method`` -> struct(module, method); null with fewer than three parts."""
    p = F.split(c, r"\.")
    return F.when(F.size(p) >= 3, F.struct(F.array_join(F.slice(p, 1, 2), ".").alias("module"), F.array_join(F.slice(p, F.lit(3), F.size(p)), ".").alias("method")))


def service_operations(operations: DataFrame, routines: DataFrame) -> DataFrame:
    """Q18: operations (tenant_id, object_fqn, handler) with the routine that declares each, whatever the
    case of its name."""
    r = routines.dropDuplicates(["routine_id"]).groupBy("tenant_id", "object_fqn", F.lower("name").alias("low")).agg(F.min("start_line").alias("line"))
    o = operations.withColumn("low", F.lower("handler"))
    return o.join(r, ["tenant_id", "object_fqn", "low"], "left").select("tenant_id", "object_fqn", "handler", F.col("line").isNotNull().alias("declared"), "line")


def unattached(on_disk: DataFrame, workspace: DataFrame) -> DataFrame:
    """Q20: roots on disk that no workspace has."""
    return on_disk.select("root").distinct().join(workspace.select("root"), "root", "left_anti")


def form_items(items: DataFrame, limit: int = 40) -> DataFrame:
    """Q17: form items (source_order, form, item, handlers, command, data_path): the extension's form shadows
    the base's; items with handlers, then a command, then data go first."""
    first = items.groupBy("form").agg(F.min("source_order").alias("source_order"))
    w = Window.partitionBy("form").orderBy((F.col("handlers") > 0).desc(), F.col("command").isNotNull().desc(), F.col("data_path").isNotNull().desc(), "item")
    return items.join(first, ["form", "source_order"]).withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("form", "item", "place")


def split_fqn(fqn: Column) -> Column:
    """An fqn -> struct(kind, name); without a point it is a reference that nothing resolves."""
    dotted = F.contains(fqn, F.lit("."))
    return F.struct(F.when(dotted, F.substring_index(fqn, ".", 1)).otherwise("Unresolved").alias("kind"), F.when(dotted, F.regexp_replace(fqn, r"^[^.]*\.", "")).otherwise(fqn).alias("name"))


def fqn_from_object_key(key: Column) -> Column:
    """The fqn of a change's key, ``0/Catalogs/Name.xml`` or a path below an object, without looking for files; null
    where the first folder is none of objects."""
    return path_object(F.regexp_replace(F.regexp_replace(F.replace(key, F.lit("\\"), F.lit("/")), r"^/*\d+/", ""), r"^/+|/+$", ""))


def artifact_of(path: Column) -> Column:
    """What a file is: module, form_layout, meta or other."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return F.when(low.endswith(".bsl"), "module").when(low.endswith(".form") | low.endswith("/ext/form.xml"), "form_layout").when(low.endswith(".mdo") | low.rlike(r"^[^/]+/[^/]+\.xml$"), "meta").otherwise("other")


def usage_report(files: DataFrame, kind: str, name: str, window: int = 100, offset: int = 0, by_object: int = 40) -> tuple[DataFrame, DataFrame]:
    """Q10: (lines, objects): lines of metadata files that name a type ``KindRef.Name`` or ``KindObject.Name``: a window of
    them with the number of all, and the objects with most, with how many objects there are."""
    import re

    pattern = rf"{kind}(?:Ref|Object)\.\s*{re.escape(name)}(?![\p{{L}}\p{{N}}_])"
    f = files.where(F.col("content").rlike(pattern)).select("tenant_id", "config_id", "path", F.posexplode(F.split("content", "\n")).alias("n", "text")).where(F.col("text").rlike(pattern))
    rows = f.select("tenant_id", "config_id", "path", (F.col("n") + 1).alias("line"), path_object(F.col("path")).alias("object"))
    lines = page(rows, ["tenant_id", "config_id", "path", "line"], window, offset)
    objects = rows.groupBy("tenant_id", "object").agg(F.count(F.lit(1)).alias("n_lines"))
    return lines, page(objects, [F.desc("n_lines"), "tenant_id", "object"], by_object)


def overview(objects: DataFrame, files: DataFrame) -> DataFrame:
    """Q16: (tenant_id, config_id, n_objects, n_kinds, top, n_files, n_modules): a row per configuration: objects, the five
    kinds with most, files and modules."""
    k = current(objects).groupBy("tenant_id", "config_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "kind"))), 1, 5)
    o = k.groupBy("tenant_id", "config_id").agg(F.sum("n").alias("n_objects"), F.count(F.lit(1)).alias("n_kinds"), F.array_join(F.transform(top, lambda x: F.concat_ws(":", x["kind"], -x["m"])), ",").alias("top"))
    f = files.groupBy("tenant_id", F.col("source").alias("config_id")).agg(F.count(F.lit(1)).alias("n_files"), F.sum((artifact_of(F.col("path")) == "module").cast("bigint")).alias("n_modules"))
    return o.join(f, ["tenant_id", "config_id"], "left").na.fill(0, ["n_files", "n_modules"])
