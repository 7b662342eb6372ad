"""Metadata files of both on-disk formats -> typed records, in one Arrow pass.

The dump format wraps values in ``Properties`` and ``ChildObjects`` and uses namespaces and capitals, the
project format is flat with small letters and plurals. ``View`` hides the difference: it looks up children
by local name, sees through the wrappers, and knows both spellings, so one extraction serves both. A file
that does not parse gives a row with ``error`` and nothing else; null content gives no row.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WRAPPERS = ("Properties", "ChildObjects")
RAW_MAX, CUT_MARK = 2000, "…(truncated)"
# Parts of an object by role, in both spellings.
FIELD_ROLES = {"Attribute": "attributes", "Dimension": "dimensions", "Resource": "resources"}
# What generated type names end in, longest first, and kinds that are called otherwise there.
TYPE_SUFFIXES = "RecordKey|RecordManager|RecordSet|TabularSectionRow|TabularSection|Selection|Manager|Object|Record|List|Ref"
KIND_ALIASES = {"ConstantValue": "Constant"}
PLAIN_PREFIXES = ("xs", "v8", "xsd", "ent")
MODULE_FLAGS = ("Global", "ClientManagedApplication", "Server", "ExternalConnection", "ClientOrdinaryApplication", "ServerCall", "Privileged")
TEMPLATE_SUFFIXES = {".mxl": "SpreadsheetDocument", ".mxlx": "SpreadsheetDocument", ".txt": "TextDocument", ".dcs": "DataCompositionSchema", ".dcsset": "DataCompositionSettings", ".html": "HTMLDocument", ".htmldoc": "HTMLDocument", ".bin": "BinaryData", ".axml": "ActiveDocument", ".geos": "GeographicalSchema", ".scheme": "GraphicalSchema", ".xdto": "XDTOPackage"}


def type_ref(raw: Column) -> Column:
    """A type's name -> struct(category, ref_kind, ref_name). Names with a prefix of the platform are
    primitive, ``Kind + suffix . Name`` is a reference, any other name with the configuration's prefix is a
    reference that may lack a name."""
    c = F.trim(raw)
    prefix, local = F.regexp_extract(c, r"^([^:]+):", 1), F.regexp_replace(c, r"^[^:]+:", "")
    kind, name = F.regexp_extract(local, rf"^(.+?)(?:{TYPE_SUFFIXES})\.(.+)$", 1), F.regexp_extract(local, rf"^(.+?)(?:{TYPE_SUFFIXES})\.(.+)$", 2)
    bare, bare_name = F.regexp_extract(local, r"^([^.]+)\.(.+)$", 1), F.regexp_extract(local, r"^([^.]+)\.(.+)$", 2)
    alias = F.create_map(*[F.lit(x) for kv in KIND_ALIASES.items() for x in kv])
    plain = prefix.isin(*PLAIN_PREFIXES) | ((prefix == "") & (name == ""))
    k, n = F.when(name != "", kind).otherwise(bare), F.when(name != "", name).otherwise(bare_name)
    return F.struct(F.when(plain, "primitive").otherwise("reference").alias("category"), F.when(~plain & (n != ""), F.coalesce(alias[k], k)).alias("ref_kind"), F.when(~plain & (n != ""), F.trim(n)).alias("ref_name"))


def resolve_type(raw: str) -> tuple[str, str | None, str | None]:
    """The same for one string, inside parsers."""
    raw = raw.strip()
    prefix, _, local = raw.rpartition(":")
    m = re.match(rf"(.+?)(?:{TYPE_SUFFIXES})\.(.+)$", local) or (re.match(r"([^.]+)\.(.+)$", local) if prefix else None)
    if prefix in PLAIN_PREFIXES or not prefix and not m:
        return "primitive", None, None
    return ("reference", KIND_ALIASES.get(m[1], m[1]), m[2].strip()) if m else ("reference", None, None)


class View:
    """An element by local names, both spellings alike."""

    def __init__(self, el: ET.Element):
        self.el = el

    @property
    def tag(self) -> str:
        return self.el.tag.rpartition("}")[2]

    def kids(self):
        for c in self.el:
            if not isinstance(c.tag, str):
                continue
            v = View(c)
            if v.tag in WRAPPERS:
                yield from v.kids()
            else:
                yield v

    def many(self, *names: str) -> list[View]:
        low = {n.lower() for n in names}
        return [k for k in self.kids() if k.tag.lower() in low]

    def one(self, *names: str) -> View | None:
        return next(iter(self.many(*names)), None)

    def text(self, *names: str, default: str = "") -> str:
        k = self.one(*names)
        return (k.el.text or "").strip() if k is not None else default

    def all(self, *names: str):
        low = {n.lower() for n in names}
        return (View(e) for e in self.el.iter() if isinstance(e.tag, str) and e.tag.rpartition("}")[2].lower() in low)


def synonym(v: View, *names: str) -> str:
    """The Russian value of a multilingual text, else the first."""
    first = ""
    for s in v.many(*(names or ("Synonym",))):
        pairs = [(i.text("lang"), i.text("content")) for i in s.many("item")] or [(s.text("key"), s.text("value"))]
        for lang, value in pairs:
            if value and lang == "ru":
                return value
            first = first or value
    return first


def refs(v: View, *names: str) -> list[str]:
    """Lists of ``Kind.Name``, as items or as repeated elements."""
    return [t for k in v.many(*names) for t in ([(i.el.text or "").strip() for i in k.many("Item")] or [(k.el.text or "").strip()]) if t]


def types_of(v: View, *names: str) -> list[dict]:
    out = []
    for block in v.many(*(names or ("Type",))):
        for e in block.many("Type", "types", "TypeSet"):
            raw = (e.el.text or "").strip()
            if raw:
                category, kind, name = resolve_type(raw)
                out.append({"raw": raw, "category": "typeset" if e.tag.lower() == "typeset" else category, "ref_kind": kind, "ref_name": name})
    return out


def field(v: View, role: str, owner: str) -> dict:
    name, types = v.text("Name"), types_of(v)
    return {"fqn": f"{owner}.{role}.{name}", "name": name, "role": role, "synonym": synonym(v), "comment": v.text("Comment"), "types": types, "type_text": ", ".join(t["raw"] for t in types), "required": v.text("FillChecking") == "ShowError"}


def details(v: View, flat: bool) -> dict[str, str]:
    """An open map of properties. The dump keeps structured values as markup, cut at a length; the
    project format keeps plain values only."""
    out = {}
    source = v if flat else next((View(c) for c in v.el if isinstance(c.tag, str) and c.tag.rpartition("}")[2] == "Properties"), None)
    for k in source.kids() if source is not None else ():
        if not len(k.el):
            value = (k.el.text or "").strip()
        elif flat:
            continue
        else:
            value = "".join(ET.tostring(c, encoding="unicode") for c in k.el).strip()
            value = value if len(value) <= RAW_MAX else value[:RAW_MAX] + CUT_MARK
        if value:
            out[k.tag] = value
    return out


def predefined(v: View, owner: str) -> list[dict]:
    """Predefined items, with those nested below folders."""
    out = []
    for i in v.many("Item", "items", "content"):
        name = i.text("Name")
        if name:
            out.append({"fqn": f"{owner}.Predefined.{name}", "name": name, "code": i.text("Code"), "description": i.text("Description"), "is_folder": i.text("IsFolder").lower() == "true"})
        out += predefined(i, owner)
    return out


def parse_object(root: ET.Element, fqn: str | None = None) -> dict:
    """One object of either format."""
    v = View(root)
    flat = v.tag != "MetaDataObject"
    if not flat:
        v = next(v.kids())
    kind = v.tag
    name = v.text("Name")
    fqn = fqn or f"{kind}.{name}"
    fields = [field(e, role, fqn) for role, many in FIELD_ROLES.items() for e in v.many(role, many)]
    sections = []
    for s in v.many("TabularSection", "tabularSections"):
        own = f"{fqn}.TabularSection.{s.text('Name')}"
        sections.append({"fqn": own, "name": s.text("Name"), "synonym": synonym(s), "fields": [field(e, "Attribute", own) for e in s.many("Attribute", "attributes")]})
    handler = v.text("Handler").split(".")
    pre = v.one("predefined")
    subs = [(e.el.text or "").strip() for e in v.many("Subsystem", "subsystems")]
    forms = [(e.el.text or "").strip() if not len(e.el) else e.text("name") for e in v.many("Form", "forms")]
    return {
        "kind": kind, "name": name, "fqn": fqn, "synonym": synonym(v), "comment": v.text("Comment"), "uuid": v.el.get("uuid"), "belonging": v.text("ObjectBelonging") or "Own", "fields": fields, "tabular": sections,
        "enum_values": [{"fqn": f"{fqn}.EnumValue.{e.text('Name')}", "name": e.text("Name"), "synonym": synonym(e)} for e in v.many("EnumValue", "enumValues")],
        "predefined": predefined(pre, fqn) if pre is not None else [], "forms": [f for f in forms if f], "owners": refs(v, "Owners"), "register_records": refs(v, "RegisterRecords"), "content": refs(v, "Content"),
        "subsystems": [f"{fqn}.Subsystem.{s}" for s in subs if s], "source_types": types_of(v, "Source"), "event": v.text("Event") or None,
        "handler_module": ".".join(handler[:2]) if len(handler) > 2 and handler[0] == "CommonModule" else None, "handler_method": ".".join(handler[2:]) or None,
        "flags": {f: t for f in MODULE_FLAGS if (t := v.text(f))} if kind == "CommonModule" else {}, "details": details(v, flat),
    }


def parse_rights(root: ET.Element) -> list[dict]:
    """Object -> rights granted, sorted; names of rights with their values."""
    out = []
    for o in View(root).many("object"):
        rights = {r.text("name"): r.text("value").lower() == "true" for r in o.many("right") if r.text("name")}
        if o.text("name"):
            out.append({"object": o.text("name"), "rights": rights, "granted": sorted(k for k, x in rights.items() if x)})
    return out


def parse_dump_info(root: ET.Element) -> dict[str, str]:
    """Versions of top-level objects only."""
    top = View(root).one("ConfigVersions")
    return {m.el.get("name"): m.el.get("configVersion") for m in (top.many("Metadata") if top else []) if m.el.get("name") and m.el.get("configVersion")}


def form_handlers(root: ET.Element) -> list[dict]:
    """Events of a form and of its items, with the routines that handle them."""
    out = []

    def walk(el: ET.Element, name: str | None) -> None:
        v = View(el)
        own = el.get("name") or v.text("name") or name if v.tag.lower() not in ("event", "events", "handlers") else name
        for k in v.kids():
            if k.tag == "Event" and (k.el.text or "").strip():
                out.append({"event": k.el.get("name"), "handler": k.el.text.strip(), "element": name if v.tag == "Events" else own})
            elif k.tag == "handlers" and k.text("event") and k.text("name"):
                out.append({"event": k.text("event"), "handler": k.text("name"), "element": own})
            else:
                walk(k.el, own)

    walk(root, root.get("name"))
    return out


def form_text(root: ET.Element, items: int = 60, length: int = 2000) -> str:
    """Distinct captions in order, joined and cut."""
    v = View(root)
    found = [(e.el.text or "").strip() for e in v.all("content")] + [e.text("value") for tag in ("title", "toolTip") for e in v.all(tag)]
    return " · ".join(list(dict.fromkeys(t for t in found if t))[:items])[:length]


def parse_form(root: ET.Element, limit: int = 500) -> dict:
    """Attributes, commands and the item tree of a form, depth first with the way to each item."""
    v = View(root)
    items: list[dict] = []

    def walk(p: View, trail: list[str]) -> None:
        for box in p.many("ChildItems"):
            for k in box.kids():
                step(k, trail)
        for k in p.many("items"):
            step(k, trail)

    def step(k: View, trail: list[str]) -> None:
        if len(items) < limit:
            name = k.el.get("name") or k.text("name")
            items.append({"name": name, "tag": k.tag, "trail": "/".join(trail), "data_path": k.text("DataPath") or None, "command": k.text("CommandName") or None})
            walk(k, [*trail, name])

    walk(v, [])
    attrs = [a for box in v.many("Attributes") for a in (box.many("Attribute") or [box])]
    commands = [c for box in v.many("Commands", "formCommands") for c in (box.many("Command") or [box])]
    return {"attributes": [{"name": a.el.get("name") or a.text("name"), "types": [t["raw"] for t in types_of(a, "Type", "valueType")]} for a in attrs], "commands": [{"name": c.el.get("name") or c.text("name"), "action": c.text("Action")} for c in commands], "items": items, "handlers": form_handlers(root)}


def parse_service(root: ET.Element) -> list[dict]:
    """Operations of an HTTP or a web service: path or name, method, handler, parameters."""
    v = View(root)
    v = next(v.kids()) if v.tag == "MetaDataObject" else v
    out = []
    for t in v.many("URLTemplate", "urlTemplates"):
        for m in t.many("Method", "methods"):
            out.append({"name": t.text("Template"), "method": m.text("HTTPMethod"), "handler": m.text("Handler"), "params": []})
    for o in v.many("Operation", "operations"):
        out.append({"name": o.text("Name"), "method": None, "handler": o.text("ProcedureName"), "params": [p.text("Name") for p in o.many("Parameter", "parameters")]})
    return out


#: Fields of a data set and characters of its query that a schema's record shows.
DCS_FIELDS, DCS_QUERY = 80, 8000


def dcs_rows(root: ET.Element) -> list[tuple[str, str | None, str | None, str | None]]:
    """A composition schema as rows (part, set, name, value), whole and in the file's order: ``set``, ``query``,
    ``field`` with its title, ``parameter``, ``variant``."""
    def named(el: ET.Element, tag: str):
        return [View(c) for c in el if isinstance(c.tag, str) and c.tag.rpartition("}")[2] == tag]

    rows: list[tuple] = []
    for d in named(root, "dataSet"):
        own = d.text("name")
        rows.append(("set", own, own, None))
        rows += [("query", own, None, q.el.text or "") for q in named(d.el, "query")]
        for f in named(d.el, "field"):
            name, title = f.text("dataPath", default="") or f.text("field"), synonym(f, "title") or f.text("title")
            if name or title:
                rows.append(("field", own, name, title))
    rows += [("parameter", None, p.text("name"), None) for p in named(root, "parameter")]
    rows += [("variant", None, v.text("name"), None) for v in named(root, "settingsVariant") if v.text("name")]
    return rows


def parse_dcs(root: ET.Element) -> dict:
    """The rows of a composition schema as one record, with totals beside what is cut."""
    rows = dcs_rows(root)
    sets = {name: {"name": name, "fields": [], "n_fields": 0, "query": "", "query_chars": 0} for part, _, name, _ in rows if part == "set"}
    for part, own, name, value in rows:
        if part == "field":
            sets[own]["n_fields"] += 1
            if sets[own]["n_fields"] <= DCS_FIELDS:
                sets[own]["fields"].append({"field": name, "title": value})
        elif part == "query":
            sets[own].update(query=value.strip()[:DCS_QUERY], query_chars=len(value.strip()))
    for s in sets.values():
        s["truncated"] = s["n_fields"] > DCS_FIELDS
    return {"data_sets": list(sets.values()), "parameters": [n for p, _, n, _ in rows if p == "parameter"], "variants": [n for p, _, n, _ in rows if p == "variant"]}


def template_type(path: Column) -> Column:
    """What a template's file is, by its suffix; null for others."""
    table = F.create_map(*[F.lit(x) for kv in TEMPLATE_SUFFIXES.items() for x in kv])
    return table[F.lower(F.regexp_extract(path, r"(\.[A-Za-z]+)$", 1))]


TYPE = "struct<raw:string,category:string,ref_kind:string,ref_name:string>"
FIELD = f"struct<fqn:string,name:string,role:string,synonym:string,comment:string,type_text:string,required:boolean,types:array<{TYPE}>>"
RECORD = {
    "tenant_id": "string", "config_id": "string", "path": "string", "kind": "string", "name": "string", "fqn": "string", "synonym": "string", "comment": "string", "uuid": "string", "belonging": "string", "fields": f"array<{FIELD}>",
    "tabular": f"array<struct<fqn:string,name:string,synonym:string,fields:array<{FIELD}>>>", "enum_values": "array<struct<fqn:string,name:string,synonym:string>>", "predefined": "array<struct<fqn:string,name:string,code:string,description:string,is_folder:boolean>>",
    "forms": "array<string>", "owners": "array<string>", "register_records": "array<string>", "content": "array<string>", "subsystems": "array<string>", "source_types": f"array<{TYPE}>", "event": "string", "handler_module": "string", "handler_method": "string",
    "flags": "map<string,string>", "details": "map<string,string>", "error": "string",
}
#: The row of an object that is not read.
KEYS = ("tenant_id", "config_id", "path")


def _nested(path: str) -> str | None:
    """The fqn of a subsystem inside others, by its path."""
    names = [re.sub(r"\.[A-Za-z]+$", "", x) for x in re.findall(r"Subsystems/([^/]+)", path)]
    return ".".join(f"Subsystem.{n}" for n in names) if len(names) > 1 else None


def each_file(files: DataFrame, schema: dict[str, str], parse, keys: tuple = KEYS) -> DataFrame:
    """Rows of files (keys..., path, content) that are markup: ``parse(path, root)`` gives dicts for one file. A file that
    does not parse gives one row with ``error``, null content none; keys that the files lack are null."""
    own = [F.col(k) if k in files.columns else F.lit(None).cast("string").alias(k) for k in keys]

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for at in b.itertuples(index=False):
                key, content = dict(zip(keys, at)), at[-1]
                if content is None:
                    continue
                try:
                    root = ET.fromstring(content.removeprefix("﻿").encode())
                    rows += [{**key, "error": None, **r} for r in parse(key["path"], root)]
                except (ET.ParseError, StopIteration) as e:
                    rows.append({**key, "error": str(e) or "no object"})
            out = pd.DataFrame(rows, columns=list(schema), dtype=object)
            yield out.where(out.notna(), None) if len(out) else out

    return files.select(*own, "content").mapInPandas(run, ", ".join(f"{k} {v}" for k, v in schema.items()))


def records(files: DataFrame) -> DataFrame:
    """One record an object file (tenant_id, config_id, path, content), with all its parts."""

    def parse(path, root):
        o = parse_object(root, _nested(path or ""))
        yield {k: o.get(k) for k in RECORD if k not in (*KEYS, "error")}

    return each_file(files, RECORD, parse)


def objects(files: DataFrame) -> DataFrame:
    """Objects of metadata files, flat: all fields in one list, tabular sections by name."""
    r = records(files)
    flat = F.concat("fields", F.flatten(F.transform("tabular", lambda t: t["fields"])))
    short = F.transform(flat, lambda f: F.struct(f["fqn"].alias("fqn"), f["name"].alias("name"), f["role"].alias("role"), f["type_text"].alias("type_text"), f["required"].alias("required")))
    return r.select("path", "kind", "name", "fqn", "synonym", "belonging", short.alias("fields"), F.transform("tabular", lambda t: t["fqn"]).alias("tabular"), "forms", "owners", "details", "error")


def rights(files: DataFrame) -> DataFrame:
    """(tenant_id, config_id, path, role, object, granted) of files of rights; the role is the folder's name."""
    schema = {"tenant_id": "string", "config_id": "string", "path": "string", "role": "string", "object": "string", "granted": "array<string>", "error": "string"}

    def parse(path, root):
        role = re.search(r"Roles/([^/]+)", path or "")
        yield from ({"role": role[1] if role else None, "object": r["object"], "granted": r["granted"]} for r in parse_rights(root))

    return each_file(files, schema, parse)


def forms(files: DataFrame) -> DataFrame:
    """(tenant_id, config_id, path, form, attributes, commands, items, handlers, text) of form files; the form is
    the fqn that the path tells."""
    event = "struct<event:string,handler:string,element:string>"
    schema = {"tenant_id": "string", "config_id": "string", "path": "string", "attributes": "array<struct<name:string,types:array<string>>>", "commands": "array<struct<name:string,action:string>>", "items": "array<struct<name:string,tag:string,trail:string,data_path:string,command:string>>", "handlers": f"array<{event}>", "text": "string", "error": "string"}

    def parse(path, root):
        yield {**parse_form(root), "text": form_text(root)}

    return each_file(files, schema, parse)


def services(files: DataFrame) -> DataFrame:
    """(tenant_id, config_id, path, name, method, handler, params): the operations of service files."""
    schema = {"tenant_id": "string", "config_id": "string", "path": "string", "name": "string", "method": "string", "handler": "string", "params": "array<string>", "error": "string"}
    return each_file(files, schema, lambda path, root: parse_service(root))


def schemas(files: DataFrame) -> DataFrame:
    """(tenant_id, config_id, path, part, set, name, value): composition schemas, row by row."""
    schema = {"tenant_id": "string", "config_id": "string", "path": "string", "part": "string", "set": "string", "name": "string", "value": "string", "error": "string"}
    return each_file(files, schema, lambda path, root: (dict(zip(("part", "set", "name", "value"), r)) for r in dcs_rows(root)))
