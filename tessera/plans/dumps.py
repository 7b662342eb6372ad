"""Metadata files made from the tables, so that parsers and the graph are run on whole files and checked against the
tables they were made from.

Each current object becomes a file of the dump format with its fields, types, forms and relations; beside these each
tenant gets two levels of subsystems by kind, a role with rights on all objects, a subscription and a service for each
common module, a form file for each form, and a composition schema for each report. ``TABLES`` states the same in SQL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.code import live_routines
from tessera.operators.metadata import current


def esc(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def tag(name: str, *inside: Column) -> Column:
    """An element around texts; missing ones are left out."""
    return F.concat(F.lit(f"<{name}>"), *[F.coalesce(c, F.lit("")) for c in inside], F.lit(f"</{name}>"))


def joined(column: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(column)), "")


def folder(kind: Column) -> Column:
    return F.when(kind.endswith("y"), F.concat(F.expr("substring(kind, 1, length(kind) - 1)"), F.lit("ies"))).otherwise(F.concat(kind, F.lit("s")))


def objects(t) -> DataFrame:
    """(tenant_id, fqn, config_id, kind, name, synonym, belonging, object_id): the copies that get a file."""
    return current(t.objects).groupBy("tenant_id", "fqn", "config_id").agg(F.min(F.struct("object_id", "kind", "name", "synonym", "belonging")).alias("o")).select("tenant_id", "fqn", "config_id", "o.*")


def fields(t) -> DataFrame:
    """(tenant_id, fqn, role, n, xml, to_catalog, types): fields with their types as markup."""
    p = F.split("field_fqn", r"\.")
    f = t.type_refs.where("raw is not null and owner_fqn is not null").select("tenant_id", F.col("owner_fqn").alias("fqn"), p[2].alias("role"), p[3].alias("n"), F.trim("raw").alias("raw"), "category").distinct()
    one = F.when(F.col("category") == "typeset", tag("TypeSet", esc(F.col("raw")))).otherwise(tag("Type", esc(F.col("raw"))))
    g = f.groupBy("tenant_id", "fqn", "role", "n").agg(F.array_sort(F.collect_set(F.struct("raw", one.alias("x")))).alias("types"))
    xml = tag("Properties", tag("Name", F.col("n")), tag("Type", F.array_join(F.transform("types", lambda x: x["x"]), "")), F.when(F.length("n") % 2 == 0, "<FillChecking>ShowError</FillChecking>"))
    return g.select("tenant_id", "fqn", "role", "n", xml.alias("xml"), F.exists("types", lambda x: x["raw"].startswith("cfg:CatalogRef.")).alias("to_catalog"))


def form_names(t) -> DataFrame:
    r = live_routines(t.routines).select("tenant_id", F.col("object_fqn").alias("fqn"), "config_id", F.regexp_extract("fqn", r"\.Form\.([^.@:]+)", 1).alias("form"), F.col("fqn").alias("routine"), "name", "directive")
    return r.where("form <> ''")


def files(t) -> DataFrame:
    """(tenant_id, config_id, path, content): the object files."""
    o, f = objects(t), fields(t)
    wrap = lambda kind, body: F.concat(F.lit("<MetaDataObject xmlns='urn:own'><"), kind, F.lit(" uuid='"), F.col("uuid"), F.lit("'>"), body, F.lit("</"), kind, F.lit("></MetaDataObject>"))
    own = f.groupBy("tenant_id", "fqn").agg(
        joined(F.concat(F.lit("<"), "role", F.lit(">"), "xml", F.lit("</"), "role", F.lit(">"))).alias("attributes"),
        joined(F.when(F.col("to_catalog"), F.concat(F.lit("<Attribute>"), "xml", F.lit("</Attribute>")))).alias("section"),
        joined(F.concat(F.lit("<EnumValue><Properties><Name>"), "n", F.lit("</Name></Properties></EnumValue>"))).alias("values"),
    )
    forms = form_names(t).groupBy("tenant_id", "fqn", "config_id").agg(joined(F.concat(F.lit("<Form>"), "form", F.lit("</Form>"))).alias("forms"))
    registers = o.where("kind like '%Register'").select("tenant_id", (F.length("name") % 3).alias("m"), F.concat(F.lit("<Item>"), "fqn", F.lit("</Item>")).alias("i")).groupBy("tenant_id", "m").agg(joined(F.col("i")).alias("registers"))
    owners = t.type_refs.where("category = 'reference' and ref_kind = 'Catalog' and trim(ref_name) <> '' and raw is not null").select("tenant_id", F.col("owner_fqn").alias("fqn"), F.concat(F.lit("<Item>Catalog."), F.trim("ref_name"), F.lit("</Item>")).alias("i")).groupBy("tenant_id", "fqn").agg(joined(F.col("i")).alias("owners"))
    j = o.join(own, ["tenant_id", "fqn"], "left").join(forms, ["tenant_id", "fqn", "config_id"], "left").join(owners, ["tenant_id", "fqn"], "left").withColumn("m", F.length("name") % 3).join(registers, ["tenant_id", "m"], "left")
    props = tag("Properties", tag("Name", F.col("name")), F.when(F.col("synonym").isNotNull(), tag("Synonym", tag("item", F.lit("<lang>ru</lang>"), tag("content", esc(F.col("synonym")))))), tag("ObjectBelonging", F.col("belonging")), F.when(F.col("kind") == "Document", tag("RegisterRecords", F.col("registers"))), F.when(F.col("kind") == "Catalog", tag("Owners", F.col("owners"))))
    section = F.when((F.col("kind") == "Document") & (F.col("section") != ""), F.concat(F.lit("<TabularSection><Properties><Name>Строки</Name></Properties><ChildObjects>"), "section", F.lit("</ChildObjects></TabularSection>")))
    children = tag("ChildObjects", F.col("attributes"), section, F.when(F.col("kind") == "Enum", F.col("values")), F.col("forms"))
    main = j.withColumn("uuid", F.col("object_id").cast("string")).select("tenant_id", "config_id", F.concat(folder(F.col("kind")), F.lit("/"), "name", F.lit(".xml")).alias("path"), wrap(F.col("kind"), F.concat(props, children)).alias("content"))
    base = o.where("config_id = 'base'").withColumn("uuid", F.lit("0"))
    item = F.concat(F.lit("<Item>"), "fqn", F.lit("</Item>"))
    by_kind = base.groupBy("tenant_id", "kind", "uuid").agg(joined(item).alias("x")).select("tenant_id", F.lit("base").alias("config_id"), F.concat(F.lit("Subsystems/Учёт/Subsystems/"), "kind", F.lit(".xml")).alias("path"), wrap(F.lit("Subsystem"), tag("Properties", tag("Name", F.col("kind")), tag("Content", F.col("x")))).alias("content"))
    top = base.groupBy("tenant_id", "uuid").agg(joined(F.concat(F.lit("<Subsystem>"), "kind", F.lit("</Subsystem>"))).alias("x")).select("tenant_id", F.lit("base").alias("config_id"), F.lit("Subsystems/Учёт.xml").alias("path"), wrap(F.lit("Subsystem"), F.concat(F.lit("<Properties><Name>Учёт</Name></Properties>"), tag("ChildObjects", F.col("x")))).alias("content"))
    role = base.select("tenant_id", "uuid").distinct().select("tenant_id", F.lit("base").alias("config_id"), F.lit("Roles/Полные.xml").alias("path"), wrap(F.lit("Role"), F.lit("<Properties><Name>Полные</Name></Properties>")).alias("content"))
    method = live_routines(t.routines).where("export and object_fqn like 'CommonModule.%'").groupBy("tenant_id", F.col("object_fqn").alias("fqn")).agg(F.min("name").alias("method"))
    types = base.where("kind = 'Document'").groupBy("tenant_id").agg(joined(F.concat(F.lit("<Type>cfg:DocumentObject."), "name", F.lit("</Type>"))).alias("types"))
    listens = base.where("kind = 'CommonModule'").join(method, ["tenant_id", "fqn"]).join(types, "tenant_id", "left")
    listens = listens.select("tenant_id", "config_id", F.concat(F.lit("EventSubscriptions/При"), "name", F.lit(".xml")).alias("path"), wrap(F.lit("EventSubscription"), tag("Properties", tag("Name", F.concat(F.lit("При"), "name")), tag("Source", F.col("types")), F.lit("<Event>OnWrite</Event>"), tag("Handler", F.concat("fqn", F.lit("."), "method")))).alias("content"))
    return reduce(DataFrame.unionByName, [main, by_kind, top, role, listens])


def right_files(t) -> DataFrame:
    """Files of rights: every object may be read, own ones updated, their fields viewed."""
    base = objects(t).where("config_id = 'base'")
    right = lambda name, value: F.concat(F.lit(f"<right><name>{name}</name><value>"), value, F.lit("</value></right>"))
    own = base.select("tenant_id", F.concat(F.lit("<object><name>"), "fqn", F.lit("</name>"), right("Read", F.lit("true")), right("Update", F.when(F.length("name") % 2 == 0, "true").otherwise("false")), F.lit("</object>")).alias("x"))
    sub = base.join(fields(t).select("tenant_id", "fqn", "role", "n"), ["tenant_id", "fqn"]).select("tenant_id", F.concat(F.lit("<object><name>"), "fqn", F.lit("."), "role", F.lit("."), "n", F.lit("</name>"), right("View", F.lit("true")), F.lit("</object>")).alias("x"))
    return own.unionByName(sub).groupBy("tenant_id").agg(joined(F.col("x")).alias("x")).select("tenant_id", F.lit("base").alias("config_id"), F.lit("Roles/Полные/Ext/Rights.xml").alias("path"), tag("Rights", F.col("x")).alias("content"))


def form_files(t) -> DataFrame:
    """(tenant_id, config_id, path, form, content): a form for every module of one, with a field for each of its routines;
    routines with an annotation handle the field's event."""
    r = form_names(t).select("tenant_id", "config_id", F.substring_index("routine", "::", 1).alias("form"), "name", "directive").distinct()
    item = F.concat(F.lit("<InputField name='Поле"), "name", F.lit("'><DataPath>Объект."), "name", F.lit("</DataPath>"), F.when(F.col("directive").isNotNull(), F.concat(F.lit("<Events><Event name='OnChange'>"), "name", F.lit("</Event></Events>"))).otherwise(""), F.lit("</InputField>"))
    g = r.groupBy("tenant_id", "config_id", "form").agg(joined(item).alias("x"))
    return g.select("tenant_id", "config_id", F.col("form").alias("path"), F.concat(F.lit("<Form><Attributes><Attribute name='Объект'/></Attributes><Events><Event name='OnOpen'>НетТакого</Event></Events><ChildItems><Group name='Группа'><ChildItems>"), "x", F.lit("</ChildItems></Group></ChildItems></Form>")).alias("content"))


def service_files(t) -> DataFrame:
    """Services of the common modules: an operation for each exported routine, one with other capitals, one that no routine
    declares."""
    r = live_routines(t.routines).where("export and object_fqn like 'CommonModule.%'").select("tenant_id", F.col("object_fqn").alias("path"), "name").distinct()
    method = lambda handler: F.concat(F.lit("<Method><Properties><HTTPMethod>GET</HTTPMethod><Handler>"), handler, F.lit("</Handler></Properties></Method>"))
    ops = r.groupBy("tenant_id", "path").agg(joined(F.concat(F.lit("<URLTemplate><Properties><Template>/"), F.lower("name"), F.lit("</Template></Properties><ChildObjects>"), method(F.upper("name")), F.lit("</ChildObjects></URLTemplate>"))).alias("x"))
    return ops.select("tenant_id", F.lit("base").alias("config_id"), "path", F.concat(F.lit("<MetaDataObject><HTTPService><Properties><Name>С</Name></Properties><ChildObjects>"), "x", F.lit("<URLTemplate><Properties><Template>/none</Template></Properties><ChildObjects>"), method(F.lit("НетТакого")), F.lit("</ChildObjects></URLTemplate></ChildObjects></HTTPService></MetaDataObject>")).alias("content"))


def schema_files(t) -> DataFrame:
    """Composition schemas of the reports: a data set with the fields, a query over them, a parameter and a variant."""
    f = objects(t).where("config_id = 'base' and kind = 'Report'").select("tenant_id", "fqn").join(fields(t), ["tenant_id", "fqn"])
    x = f.groupBy("tenant_id", F.col("fqn").alias("path")).agg(joined(F.concat(F.lit("<field><dataPath>"), "n", F.lit("</dataPath></field>"))).alias("x"), F.array_join(F.array_sort(F.collect_set("n")), ", ").alias("q"))
    return x.select("tenant_id", F.lit("base").alias("config_id"), "path", F.concat(F.lit("<DataCompositionSchema><dataSet><name>Набор</name>"), "x", F.lit("<query>ВЫБРАТЬ "), "q", F.lit("</query></dataSet><parameter><name>Период</name></parameter><settingsVariant><name>Основной</name></settingsVariant></DataCompositionSchema>")).alias("content"))


def write_tree(t, root: str) -> None:
    """The object files as trees below ``root``, a folder for each tenant and configuration with its marker and, for the
    base, a file of versions; written by the workers."""
    own = files(t).select("tenant_id", "config_id", "path", "content")
    parts = own.select("tenant_id", "config_id").distinct()
    name = F.regexp_replace("config_id", "^ext:", "")
    marker = F.concat(F.lit("<MetaDataObject><Configuration><Properties><Name>"), name, F.lit("</Name>"), F.when(F.col("config_id") != "base", "<ConfigurationExtensionPurpose>Customization</ConfigurationExtensionPurpose>").otherwise(""), F.lit("</Properties></Configuration></MetaDataObject>"))
    versions = current(t.objects).where("config_id = 'base' and config_version is not null").groupBy("tenant_id", "fqn").agg(F.min("config_version").alias("v"))
    versions = versions.groupBy("tenant_id").agg(joined(F.concat(F.lit("<Metadata name='"), "fqn", F.lit("' configVersion='"), "v", F.lit("'><Metadata name='Inner' configVersion='0'/></Metadata>"))).alias("x"))
    versions = versions.select("tenant_id", F.lit("base").alias("config_id"), F.lit("ConfigDumpInfo.xml").alias("path"), F.concat(F.lit("<ConfigDumpInfo><ConfigVersions>"), "x", F.lit("</ConfigVersions></ConfigDumpInfo>")).alias("content"))
    rows = own.unionByName(parts.select("tenant_id", "config_id", F.lit("Configuration.xml").alias("path"), marker.alias("content"))).unionByName(versions)

    def write(batches):
        import pandas as pd
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(root)
        for b in batches:
            for tenant, config, path, content in zip(b["tenant_id"], b["config_id"], b["path"], b["content"]):
                at = f"{place}/{tenant}/{config.replace(':', '_')}/{path}"
                system.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(at) as f:
                    f.write(content.encode())
            yield pd.DataFrame({"n": [len(b)]})

    rows.mapInPandas(write, "n bigint").agg(F.sum("n")).collect()


def books(t) -> DataFrame:
    """(path, content): help books in their container format, one a version: a page for each document's last version, its
    title with an English name in brackets."""
    from tessera.operators.docs import latest

    u = latest(t.doc_units).where("title is not null").select(F.concat(F.lit("/opt/8.3."), 9 + F.length("title") % 3, F.lit(".1000/shcntx_ru.hbk")).alias("path"), "unit_id", "title", F.coalesce("text", F.lit("")).alias("text"))

    def bind(key, rows):
        import html
        import io
        import struct
        import zipfile

        import pandas as pd

        store = io.BytesIO()
        with zipfile.ZipFile(store, "w") as z:
            for r in rows.sort_values("unit_id").itertuples():
                z.writestr(f"{r.unit_id}.html", f"<html><body><h1>{html.escape(r.title)} (Topic{r.unit_id})</h1><p>{html.escape(r.text)}</p></body></html>")
        data, name = store.getvalue(), b"\0" * 20 + "FileStorage".encode("utf-16-le")
        block = lambda b: f"\r\n{len(b):08x} {len(b):08x} {0x7FFFFFFF:08x} \r\n".encode() + b
        about = 16 + 31 + 12
        whole = b"\0" * 16 + block(struct.pack("<III", about, about + 31 + len(name), 0x7FFFFFFF)) + block(name) + block(data)
        return pd.DataFrame({"path": [key[0]], "content": [whole]})

    return u.groupBy("path").applyInPandas(bind, "path string, content binary")


# The same in SQL, over the common tables ``o``, ``r`` and ``t``.
TABLES = """, oc AS (SELECT tenant_id, fqn, config_id, arg_min(kind, object_id) AS kind, arg_min(name, object_id) AS name, arg_min(synonym, object_id) AS synonym, arg_min(belonging, object_id) AS belonging FROM o GROUP BY 1, 2, 3),
mk AS (SELECT *, CASE WHEN belonging = 'Adopted' AND config_id <> 'base' THEN '@' || config_id ELSE '' END AS mark FROM oc),
ba AS (SELECT * FROM oc WHERE config_id = 'base'),
ft AS (SELECT DISTINCT tenant_id, owner_fqn AS fqn, string_split(field_fqn, '.')[3] AS role, string_split(field_fqn, '.')[4] AS n, trim(raw) AS raw, category, ref_kind, trim(ref_name) AS ref_name FROM t WHERE raw IS NOT NULL AND owner_fqn IS NOT NULL),
fl AS (SELECT tenant_id, fqn, role, n, bool_or(starts_with(raw, 'cfg:CatalogRef.')) AS to_catalog FROM ft GROUP BY 1, 2, 3, 4),
fm AS (SELECT DISTINCT tenant_id, object_fqn AS fqn, config_id, regexp_extract(fqn, '\\.Form\\.([^.@:]+)', 1) AS form FROM r WHERE fqn LIKE '%.Form.%'),
me AS (SELECT tenant_id, object_fqn AS fqn, min(name) AS method FROM r WHERE export AND object_fqn LIKE 'CommonModule.%' GROUP BY 1, 2),
li AS (SELECT ba.tenant_id, 'EventSubscription.При' || name AS fqn, ba.fqn AS module, method FROM ba JOIN me ON me.tenant_id = ba.tenant_id AND me.fqn = ba.fqn WHERE kind = 'CommonModule'),
own AS (SELECT oc.tenant_id, oc.config_id, oc.fqn, oc.kind, role, n, to_catalog FROM oc JOIN fl ON fl.tenant_id = oc.tenant_id AND fl.fqn = oc.fqn),
md AS (SELECT DISTINCT f.tenant_id, f.source AS config_id, k || '.' || regexp_extract(p, '^(?:src/)?[A-Za-z]+/([^/]+)', 1) AS fqn, regexp_extract(p, '([^/]+)\\.(?i:bsl)$', 1) AS module FROM (SELECT *, regexp_replace(path, '^ext/[^/]+/', '') AS p FROM files WHERE lower(path) LIKE '%.bsl') f JOIN kinds ON folder = regexp_extract(p, '^(?:src/)?([A-Za-z]+)/', 1) WHERE p NOT LIKE '%/Forms/%'),
mm AS (SELECT mk.*, module FROM mk JOIN md ON md.tenant_id = mk.tenant_id AND md.config_id = mk.config_id AND md.fqn = mk.fqn),
rg AS (SELECT tenant_id, fqn, length(name) % 3 AS m FROM oc WHERE kind LIKE '%Register'),
ge AS (
    SELECT tenant_id, fqn AS src, 'HAS_' || upper(role) AS rel, fqn || '.' || role || '.' || n AS dst, 'Object' AS sl FROM own
    UNION SELECT tenant_id, fqn || '.TabularSection.Строки', 'HAS_ATTRIBUTE', fqn || '.TabularSection.Строки.Attribute.' || n, 'TabularSection' FROM own WHERE kind = 'Document' AND to_catalog
    UNION SELECT own.tenant_id, own.fqn || '.' || own.role || '.' || own.n, 'REFERENCES', ref_kind || '.' || ref_name, 'Field' FROM own JOIN ft USING (tenant_id, fqn, role, n) WHERE category = 'reference' AND ref_name IS NOT NULL
    UNION SELECT own.tenant_id, own.fqn || '.TabularSection.Строки.Attribute.' || own.n, 'REFERENCES', ref_kind || '.' || ref_name, 'Field' FROM own JOIN ft USING (tenant_id, fqn, role, n) WHERE own.kind = 'Document' AND to_catalog AND category = 'reference' AND ref_name IS NOT NULL
    UNION SELECT tenant_id, fqn, 'HAS_TABULAR_SECTION', fqn || '.TabularSection.Строки', 'Object' FROM own WHERE kind = 'Document' AND to_catalog
    UNION SELECT tenant_id, fqn, 'HAS_ENUM_VALUE', fqn || '.EnumValue.' || n, 'Object' FROM own WHERE kind = 'Enum'
    UNION SELECT mk.tenant_id, mk.fqn, 'HAS_FORM', mk.fqn || '.Form.' || form || mark, 'Object' FROM mk JOIN fm ON fm.tenant_id = mk.tenant_id AND fm.fqn = mk.fqn AND fm.config_id = mk.config_id
    UNION SELECT tenant_id, fqn, 'HAS_MODULE', fqn || '.Module.' || module || mark, 'Object' FROM mm
    UNION SELECT tenant_id, fqn, 'HAS_DETAIL', fqn || mark, 'Object' FROM mk
    UNION SELECT oc.tenant_id, oc.fqn, 'OWNED_BY', 'Catalog.' || ref_name, 'Object' FROM oc JOIN ft USING (tenant_id, fqn) WHERE oc.kind = 'Catalog' AND category = 'reference' AND ref_kind = 'Catalog' AND ref_name <> ''
    UNION SELECT oc.tenant_id, oc.fqn, 'WRITES_TO', rg.fqn, 'Object' FROM oc JOIN rg ON rg.tenant_id = oc.tenant_id AND rg.m = length(name) % 3 WHERE kind = 'Document'
    UNION SELECT tenant_id, 'Subsystem.Учёт.Subsystem.' || kind, 'CONTAINS', fqn, 'Object' FROM ba
    UNION SELECT tenant_id, 'Subsystem.Учёт', 'HAS_SUBSYSTEM', 'Subsystem.Учёт.Subsystem.' || kind, 'Object' FROM ba
    UNION SELECT li.tenant_id, li.fqn, 'SUBSCRIBES', ba.fqn, 'Object' FROM li JOIN ba ON ba.tenant_id = li.tenant_id AND ba.kind = 'Document'
    UNION SELECT tenant_id, fqn, 'HANDLED_BY', module, 'Object' FROM li
    UNION SELECT tenant_id, 'Role.Полные', 'HAS_RIGHT_ON', fqn, 'Object' FROM ba
    UNION SELECT DISTINCT tenant_id, x, 'HAS_DETAIL', x, 'Object' FROM (SELECT tenant_id, 'Role.Полные' AS x FROM ba UNION SELECT tenant_id, 'Subsystem.Учёт' FROM ba UNION SELECT tenant_id, 'Subsystem.Учёт.Subsystem.' || kind FROM ba UNION SELECT tenant_id, fqn FROM li)),
gn AS (
    SELECT tenant_id, 'Object' AS label, fqn, config_id FROM oc
    UNION SELECT tenant_id, 'Object', dst, 'base' FROM ge WHERE rel = 'HAS_DETAIL' AND split_part(dst, '.', 1) IN ('Role', 'Subsystem', 'EventSubscription')
    UNION SELECT tenant_id, 'Detail', fqn || mark, config_id FROM mk
    UNION SELECT tenant_id, 'Detail', dst, 'base' FROM ge WHERE rel = 'HAS_DETAIL' AND split_part(dst, '.', 1) IN ('Role', 'Subsystem', 'EventSubscription')
    UNION SELECT tenant_id, 'Field', fqn || '.' || role || '.' || n, config_id FROM own
    UNION SELECT tenant_id, 'Field', fqn || '.TabularSection.Строки.Attribute.' || n, config_id FROM own WHERE kind = 'Document' AND to_catalog
    UNION SELECT tenant_id, 'TabularSection', fqn || '.TabularSection.Строки', config_id FROM own WHERE kind = 'Document' AND to_catalog
    UNION SELECT tenant_id, 'EnumValue', fqn || '.EnumValue.' || n, config_id FROM own WHERE kind = 'Enum'
    UNION SELECT mk.tenant_id, 'Form', mk.fqn || '.Form.' || form || mark, mk.config_id FROM mk JOIN fm ON fm.tenant_id = mk.tenant_id AND fm.fqn = mk.fqn AND fm.config_id = mk.config_id
    UNION SELECT tenant_id, 'Module', fqn || '.Module.' || module || mark, config_id FROM mm),
gr AS (SELECT DISTINCT e.tenant_id, coalesce(s.src, e.src) AS src, x.dst FROM ge e JOIN ge x ON x.tenant_id = e.tenant_id AND x.src = e.dst AND x.rel = 'REFERENCES' LEFT JOIN ge s ON s.rel = 'HAS_TABULAR_SECTION' AND e.sl = 'TabularSection' AND s.tenant_id = e.tenant_id AND s.dst = e.src WHERE e.rel IN ('HAS_ATTRIBUTE', 'HAS_DIMENSION')),
gd AS (SELECT tenant_id, src, 'REFERENCES' AS rel, dst FROM gr UNION SELECT tenant_id, src, rel, dst FROM ge WHERE rel IN ('OWNED_BY', 'WRITES_TO', 'CONTAINS', 'HAS_SUBSYSTEM', 'SUBSCRIBES', 'HANDLED_BY', 'HAS_RIGHT_ON'))
"""
