"""Parsers of modules, metadata, help books, diffs and documents."""

import hashlib
import io
import struct
import xml.etree.ElementTree as ET
import zipfile

import pytest

from tessera.sources import bsl, help, metadata_xml, trees

MODULE = """#Область Служебные
// Комментарий() не вызов
&НаСервере
&Вместо("Старая")
Функция Новая(Знач А,
    Б = "(") Экспорт
    В = "Текст Вызов( // не комментарий
    // между частями
    |продолжение Вызов2(";
    Общий.Метод(А); Если (А) Тогда Сам(1); КонецЕсли;
    Г = Новый Структура("х");
    Возврат Цепь.Звено.Конец();КонецФункции
#КонецОбласти
Процедура Одной() Вызвать(); КонецПроцедуры
Procedure Last()
    Bad = "not closed
    Call();
"""


def test_module():
    r = bsl.parse_module(MODULE)
    assert [x["name"] for x in r] == ["Новая", "Одной", "Last"]
    f = r[0]
    assert (f["kind"], f["export"], f["region"], f["directive"], f["override_mode"], f["override_target"]) == ("Function", True, "Служебные", "НаСервере", "Вместо", "Старая")
    assert (f["start_line"], f["end_line"], f["unterminated"]) == (5, 12, False)
    assert [(c["qualifier"], c["method"]) for c in f["calls"]] == [("Общий", "Метод"), (None, "Сам"), ("Звено", "Конец")]
    assert r[1]["start_line"] == r[1]["end_line"] == 14 and [c["method"] for c in r[1]["calls"]] == ["Вызвать"]
    assert r[2]["unterminated"] and [c["method"] for c in r[2]["calls"]] == ["Call"]


def test_module_empty_and_marks():
    assert bsl.parse_module("") == []
    assert bsl.parse_module("﻿Процедура А()\r\nКонецПроцедуры")[0]["end_line"] == 2


def test_routines_frame(spark):
    df = spark.createDataFrame([(1, "t", "a.BSL", MODULE, 9), (2, "t", "b.bsl", None, 9)], "file_id long, tenant_id string, path string, content string, name int")
    rows = bsl.routines(df)
    assert rows.count() == 3 and bsl.calls(rows).count() == 5


DUMP = """<MetaDataObject xmlns="http://v8.1c.ru/8.3/MDClasses" xmlns:v8="http://v8.1c.ru/8.1/data/core" xmlns:xr="http://v8.1c.ru/8.3/xcf/readable" xmlns:cfg="x">
<Catalog uuid="u1"><Properties><Name>Товары</Name><Synonym><v8:item><v8:lang>en</v8:lang><v8:content>Goods</v8:content></v8:item><v8:item><v8:lang>ru</v8:lang><v8:content>Товары все</v8:content></v8:item></Synonym>
<Owners><xr:Item>Catalog.Виды</xr:Item></Owners><CodeLength>9</CodeLength><Empty/><Big>{big}</Big></Properties>
<ChildObjects><Attribute><Properties><Name>Вид</Name><Type><v8:Type>cfg:CatalogRef.Виды</v8:Type><v8:Type>xs:string</v8:Type></Type><FillChecking>ShowError</FillChecking></Properties></Attribute>
<TabularSection><Properties><Name>Цены</Name></Properties><ChildObjects><Attribute><Properties><Name>Цена</Name><Type><v8:Type>xs:decimal</v8:Type></Type></Properties></Attribute></ChildObjects></TabularSection>
<Form>ФормаЭлемента</Form></ChildObjects></Catalog></MetaDataObject>"""
PROJECT = """<mdclass:Catalog xmlns:mdclass="m" uuid="u2"><name>Товары</name><synonym><key>ru</key><value>Товары все</value></synonym><owners>Catalog.Виды</owners><codeLength>9</codeLength>
<attributes><name>Вид</name><type><types>CatalogRef.Виды</types><types>String</types></type><fillChecking>ShowError</fillChecking></attributes>
<tabularSections><name>Цены</name><attributes><name>Цена</name><type><types>Number</types></type></attributes></tabularSections><forms><name>ФормаЭлемента</name></forms>
<predefined><items><name>Папка</name><isFolder>true</isFolder><content><name>Лист</name></content></items></predefined></mdclass:Catalog>"""


def test_objects_of_both_formats():
    a = metadata_xml.parse_object(ET.fromstring(DUMP.replace("{big}", "<x>" + "y" * 3000 + "</x>")))
    b = metadata_xml.parse_object(ET.fromstring(PROJECT))
    for o in (a, b):
        assert (o["fqn"], o["synonym"], o["owners"], o["forms"]) == ("Catalog.Товары", "Товары все", ["Catalog.Виды"], ["ФормаЭлемента"])
        assert o["fields"][0]["required"] and o["fields"][0]["types"][0]["ref_name"] == "Виды" and o["fields"][0]["types"][1]["category"] == "primitive"
        assert o["tabular"][0]["fields"][0]["fqn"] == "Catalog.Товары.TabularSection.Цены.Attribute.Цена"
    assert a["details"]["CodeLength"] == "9" and "Empty" not in a["details"] and a["details"]["Big"].endswith(metadata_xml.CUT_MARK)
    assert [(p["name"], p["is_folder"]) for p in b["predefined"]] == [("Папка", True), ("Лист", False)]


def test_objects_frame(spark):
    df = spark.createDataFrame([("a.xml", DUMP), ("b.mdo", PROJECT), ("c.xml", "<a>"), ("d.xml", None), ("e.mdo", "")], "path string, content string")
    rows = {r.path: r for r in metadata_xml.objects(df).collect()}
    assert set(rows) == {"a.xml", "b.mdo", "c.xml", "e.mdo"} and rows["c.xml"].error and rows["a.xml"].fqn == rows["b.mdo"].fqn and len(rows["a.xml"].fields) == 2


def test_type_ref(spark):
    from pyspark.sql import functions as F

    raws = ["cfg:CatalogRef.Виды", "cfg:ConstantValueManager.Курс", "xs:string", "v8:UUID", "cfg:AnyRef", "cfg:DefinedType.Х", "cfg:InformationRegisterRecordKey.Цены", "String"]
    want = [("reference", "Catalog", "Виды"), ("reference", "Constant", "Курс"), ("primitive", None, None), ("primitive", None, None), ("reference", None, None), ("reference", "DefinedType", "Х"), ("reference", "InformationRegister", "Цены"), ("primitive", None, None)]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string").select("i", metadata_xml.type_ref(F.col("raw")).alias("t")).orderBy("i").collect()
    assert [tuple(r.t) for r in rows] == want == [metadata_xml.resolve_type(r) for r in raws]


def test_forms_rights_services():
    form = ET.fromstring("<Form><Attributes><Attribute name='Объект'/></Attributes><Events><Event name='OnOpen'>ПриОткрытии</Event></Events><ChildItems><Group name='Г'><ChildItems><Field name='П'><DataPath>Объект.П</DataPath><Events><Event name='OnChange'>ППриИзменении</Event></Events></Field></ChildItems></Group></ChildItems></Form>")
    f = metadata_xml.parse_form(form)
    assert [(i["name"], i["trail"]) for i in f["items"]] == [("Г", ""), ("П", "Г")] and {(h["event"], h["element"]) for h in f["handlers"]} == {("OnOpen", None), ("OnChange", "П")}
    assert metadata_xml.parse_rights(ET.fromstring("<Rights><object><name>Catalog.А</name><right><name>Read</name><value>true</value></right><right><name>Edit</name><value>false</value></right></object></Rights>"))[0]["granted"] == ["Read"]
    assert metadata_xml.parse_dump_info(ET.fromstring("<a><ConfigVersions><Metadata name='X' configVersion='1'><Metadata name='Y' configVersion='2'/></Metadata></ConfigVersions></a>")) == {"X": "1"}
    s = metadata_xml.parse_service(ET.fromstring("<MetaDataObject><HTTPService><ChildObjects><URLTemplate><Properties><Template>/v1</Template></Properties><ChildObjects><Method><Properties><HTTPMethod>GET</HTTPMethod><Handler>Взять</Handler></Properties></Method></ChildObjects></URLTemplate></ChildObjects></HTTPService></MetaDataObject>"))
    assert (s[0]["name"], s[0]["method"], s[0]["handler"]) == ("/v1", "GET", "Взять")
    d = metadata_xml.parse_dcs(ET.fromstring("<D><dataSet><name>Н</name><field><dataPath>А</dataPath></field><query>ВЫБРАТЬ 1</query></dataSet><parameter><name>П</name></parameter></D>"))
    assert d["data_sets"][0]["n_fields"] == 1 and d["parameters"] == ["П"]
    assert metadata_xml.form_text(ET.fromstring("<F><title><value>А</value></title><x><content>Б</content><content>Б</content></x></F>")) == "Б · А"


def book() -> bytes:
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.html", "<html><h1>Найти (Find)</h1><p>Текст</p></html>")
    store, name = z.getvalue(), b"\0" * 20 + "FileStorage".encode("utf-16-le")
    block = lambda b, nxt=0x7FFFFFFF: f"\r\n{len(b):08x} {len(b):08x} {nxt:08x} \r\n".encode() + b
    directory = 16
    attr = directory + 31 + 12
    data = attr + 31 + len(name)
    return b"\0" * 16 + block(struct.pack("<III", attr, data, 0x7FFFFFFF)) + block(name) + block(store)


def test_help_book(spark):
    rows = help.pages(spark.createDataFrame([("/x/8.3.27.1/shcntx_ru.hbk", bytearray(book())), ("/x/empty.hbk", None)], "path string, content binary")).collect()
    assert [(r.version, r.help_kind, r.name, r.en_name) for r in rows] == [("8.3.27.1", "context", "Найти", "Find")] and "Текст" in rows[0].text
    with pytest.raises(help.Damaged):
        help.Container(b"\0" * 64).document(16)
    bad = help.pages(spark.createDataFrame([("/x/shclang_ru.hbk", bytearray(book()[:60]))], "path string, content binary")).collect()
    assert len(bad) == 1 and bad[0].error and bad[0].help_kind == "client_language" and bad[0].version is None
    assert [(p, v, k) for p, v, k in help.validate(["/a/8.3.27.1/shcntx_ru.hbk", "/a/x.txt", "/a/8.3.27.1/shcntx_ru.hbk"])] == [("/a/8.3.27.1/shcntx_ru.hbk", "8.3.27.1", "context")]
    for none in ([], ["/a/x.txt"]):
        with pytest.raises((ValueError, FileNotFoundError)):
            help.validate(none)
    assert help.version_of("/a/8.3.27/b") is None


def test_long_signatures():
    m = bsl.parse_module("Процедура А(" + ", ".join(f"П{i}" for i in range(4000)) + ") Экспорт\nБ();\nКонецПроцедуры\nПроцедура В(\nПроцедура Г()\nД();\nКонецПроцедуры")
    assert [(r["name"], r["export"], [c["method"] for c in r["calls"]]) for r in m] == [("А", True, ["Б"]), ("В", False, []), ("Г", False, ["Д"])]


def test_diff():
    d = "diff\n--- a/x\n+++ b/dir/x.bsl\n@@ -1,2 +3,4 @@\n+a\n@@ -9 +20,0 @@\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n"
    assert trees.parse_diff(d) == [("dir/x.bsl", 3, 6), ("dir/x.bsl", 20, 20)]


def test_trees(spark, tmp_path):
    base, ext = tmp_path / "conf", tmp_path / "patch"
    for folder, text in ((base, "<a><Name>Main</Name></a>"), (ext, "<a><Name>Fix</Name><ConfigurationExtensionPurpose>Patch</ConfigurationExtensionPurpose></a>")):
        folder.mkdir()
        (folder / "Configuration.xml").write_text(text)
    (base / "m.bsl").write_text("Процедура А() КонецПроцедуры")
    assert trees.detect_format(str(tmp_path)) == "dump"
    parts = trees.discover_parts(str(tmp_path))
    assert [p[0] for p in parts] == ["base", "ext:Fix"]
    rows = {(r.config_id, r.path) for r in trees.read_tree(spark, parts).collect()}
    assert ("base", "m.bsl") in rows and ("ext:Fix", "Configuration.xml") in rows
    with pytest.raises(FileNotFoundError):
        trees.detect_format(str(_empty(tmp_path)))


def _empty(tmp_path):
    e = tmp_path / "empty"
    e.mkdir()
    return e


def test_units(spark):
    files = spark.createDataFrame([("a.json", '{"id": "1", "title": "Т", "text": "x"}'), ("b.json", '[{"title": "Б", "text": "y", "version_hash": "h"}, {"id": "2", "text": " "}]'), ("c.json", "{bad")], "path string, content string")
    rows = sorted((r.title, r.version_hash) for r in trees.its_units(files, {"lang": "ru"}).collect())
    assert len(rows) == 2 and rows[0] == ("Б", "h") and rows[1] == ("Т", hashlib.sha1(b"x\0").hexdigest())
    one = trees.its_units(spark.createDataFrame([("d.json", '{"text": " y ", "source_url": "u"}')], "path string, content string"), {"doc_topic": "x"}).first()
    assert one.external_id == one.title == hashlib.sha1(b"u\0y\0").hexdigest()[:16] and one.doc_topic == "x" and one.links == []
    md = spark.createDataFrame([("p.md", "intro\n# A\ntext\n## B\n\n# C\nmore")], "path string, content string")
    assert sorted(r.external_id for r in trees.artifact_units(md).collect()) == ["p.md#0", "p.md#1", "p.md#3"]
    assert {r.external_id: (r.title, list(r.section_path)) for r in trees.artifact_units(md).collect()}["p.md#0"] == ("p", [])


def test_crawl_fails_whole(spark):
    listing = spark.createDataFrame([("a",), ("b",)], "id string").selectExpr("id", "timestamp'2024-01-01' as modified")
    stored = listing.where("id = 'b'")
    got = trees.crawl(listing, stored, lambda i: (404, None)).collect()
    assert [(r.id, r.gone) for r in got] == [("a", True)]
    with pytest.raises(Exception, match="not read"):
        trees.crawl(listing, stored, lambda i: (429, None)).collect()
