"""The graph from parsed files, its lookups and sinks, and what indexes are fed with: facts on small inputs."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import docs, graph, index, search, state
from tessera.sources import metadata_xml
from tessera.util import in_blocks

HEAD = "<MetaDataObject xmlns='urn:x'>"
CATALOG = f"{HEAD}<Catalog uuid='1'><Properties><Name>Товары</Name><Synonym><item><lang>ru</lang><content>Товар</content></item></Synonym><ObjectBelonging>%s</ObjectBelonging><Owners><Item>Catalog.Склады</Item></Owners></Properties><ChildObjects><Attribute><Properties><Name>Вес</Name><Type><Type>xs:decimal</Type><Type>cfg:CatalogRef. Единицы </Type></Type><FillChecking>ShowError</FillChecking></Properties></Attribute><TabularSection><Properties><Name>Цены</Name></Properties><ChildObjects><Attribute><Properties><Name>Вид</Name><Type><Type>cfg:EnumRef.Виды</Type></Type></Properties></Attribute></ChildObjects></TabularSection><Form>Список</Form></ChildObjects></Catalog></MetaDataObject>"
SUBSYSTEM = f"{HEAD}<Subsystem><Properties><Name>%s</Name><Content><Item>%s</Item></Content></Properties><ChildObjects>%s</ChildObjects></Subsystem></MetaDataObject>"
LISTENER = f"{HEAD}<EventSubscription><Properties><Name>При</Name><Source><Type>cfg:CatalogObject.Товары</Type></Source><Event>OnWrite</Event><Handler>CommonModule.М.Сделать</Handler></Properties></EventSubscription></MetaDataObject>"


@pytest.fixture(scope="module")
def built(spark):
    rows = [
        ("t", "base", "Catalogs/Товары.xml", CATALOG % "Own"), ("t", "ext:Д", "Catalogs/Товары.xml", CATALOG % "Adopted"), ("t", "base", "x.xml", "<broken"), ("t", "base", "y.xml", None), ("t", "base", "Catalogs/Товары.xml", CATALOG % "Own"),
        ("t", "base", "Subsystems/А.xml", SUBSYSTEM % ("А", "Role.Р", "<Subsystem>Б</Subsystem>")), ("t", "base", "Subsystems/А/Subsystems/Б.xml", SUBSYSTEM % ("Б", "Catalog.Товары", "")), ("t", "base", "EventSubscriptions/При.xml", LISTENER),
    ]
    records = metadata_xml.records(spark.createDataFrame(rows, "tenant_id string, config_id string, path string, content string"))
    files = spark.createDataFrame([("t", "base", "Catalogs/Товары/Ext/ObjectModule.bsl", "a"), ("t", "ext:Д", "ext/Д/Catalogs/Товары/Ext/ObjectModule.bsl", None), ("t", "base", "Catalogs/Товары/Forms/Список/Ext/Form/Module.bsl", "b"), ("t", "base", "x.txt", "c")], "tenant_id string, source string, path string, content string")
    rights = metadata_xml.rights(spark.createDataFrame([("t", "base", "Roles/Р/Ext/Rights.xml", "<Rights><object><name>Catalog.Товары</name><right><name>Read</name><value>true</value></right><right><name>Edit</name><value>false</value></right></object><object><name>Catalog.Товары.Attribute.Вес</name><right><name>View</name><value>true</value></right></object></Rights>")], "tenant_id string, config_id string, path string, content string"))
    modules = graph.modules(files)
    return graph.nodes(records, modules).cache(), graph.edges(records, modules, rights).cache(), records


def test_nodes_and_edges(built):
    n, e, records = built
    got = {(r.label, r.fqn): r for r in n.collect()}
    assert ("Detail", "Catalog.Товары@ext:Д") in got and ("Form", "Catalog.Товары.Form.Список@ext:Д") in got and ("Module", "Catalog.Товары.Module.ObjectModule@ext:Д") in got
    assert got["Object", "Catalog.Товары"].config_id == "base" and got["Object", "Catalog.Товары"].props["synonym"] == "Товар"
    assert got["Field", "Catalog.Товары.Attribute.Вес"].props["required"] == "true" and "required" in got["Field", "Catalog.Товары.TabularSection.Цены.Attribute.Вид"].props
    assert ("Object", "Subsystem.А.Subsystem.Б") in got and sum(1 for _, f in got if f == "Catalog.Товары") == 2  # the object and its details
    assert records.where("error is not null").count() == 1 and graph.assert_keys(n).count() == 0
    edges = {(r.src, r.rel, r.dst): r.props for r in e.collect()}
    assert ("Catalog.Товары.Attribute.Вес", "REFERENCES", "Catalog.Единицы") in edges and ("Catalog.Товары", "OWNED_BY", "Catalog.Склады") in edges
    assert edges["Role.Р", "HAS_RIGHT_ON", "Catalog.Товары"] == {"granted": "Read,View"} and edges["EventSubscription.При", "HANDLED_BY", "CommonModule.М"] == {"method": "Сделать"}
    assert ("EventSubscription.При", "SUBSCRIBES", "Catalog.Товары") in edges and ("Subsystem.А", "HAS_SUBSYSTEM", "Subsystem.А.Subsystem.Б") in edges
    stubs = {r.fqn: r.props["kind"] for r in graph.with_stubs(n, e).where("props['stub'] = 'true'").collect()}
    assert stubs == {"Catalog.Единицы": "Catalog", "Enum.Виды": "Enum", "Catalog.Склады": "Catalog", "CommonModule.М": "CommonModule", "Role.Р": "Role"}


def test_lookups(spark, built):
    n, e, _ = built
    assert {(r.src, r.dst) for r in graph.references(e).collect()} == {("Catalog.Товары", "Catalog.Единицы"), ("Catalog.Товары", "Enum.Виды")}
    assert {r.rel for r in graph.dependencies(e).collect()} == {"REFERENCES", "OWNED_BY", "CONTAINS", "HAS_SUBSYSTEM", "SUBSCRIBES", "HANDLED_BY", "HAS_RIGHT_ON"}
    card = {r.fqn: r for r in graph.cards(n, e).collect()}["Catalog.Товары"]
    assert card.fields == ["Attribute:Вес:xs:decimal, cfg:CatalogRef. Единицы:!:Catalog.Единицы"] and card.subsystems == ["Subsystem.А.Subsystem.Б"] and card.forms == ["Список", "Список"]
    assert [(r.n_fields, len(r.fields)) for r in graph.capped(graph.cards(n, e).where("fqn = 'Catalog.Товары'"), {"fields": 0}).collect()] == [(1, 0)]
    root = n.where("fqn = 'Subsystem.А' and label = 'Object'").select("tenant_id", "fqn")
    assert {r.fqn for r in graph.in_subsystems(e, root).collect()} == {"Role.Р", "Catalog.Товары"}
    assert [(r.kind, r.n) for r in graph.kinds_within(graph.with_stubs(n, e), e, root).collect()] == [("Catalog", 1)]  # the role is a stub
    loop = e.unionByName(spark.createDataFrame([("t", "Object", "Subsystem.А.Subsystem.Б", "HAS_SUBSYSTEM", "Object", "Subsystem.А", {})], e.schema))
    assert graph.in_subsystems(loop, root).count() == 2
    left_n, left_e = graph.wipe(n, e, graph.gone_of(n, "object", "t", spark.createDataFrame([("Catalog.Товары",)], "fqn string")))
    assert not [r for r in left_n.collect() if r.fqn.startswith("Catalog.Товары")] and not [r for r in left_e.collect() if "Catalog.Товары" in (r.src, r.dst)]
    assert {r.label for r in graph.gone_of(n, "scoped", "t", spark.createDataFrame([("Catalog.Товары",)], "fqn string")).collect()} == {"Object", "Detail", "Field", "TabularSection", "Form"}
    assert graph.gone_of(n, "tenant", "other").count() == 0 and graph.nodes(built[2].limit(0), graph.modules(spark.createDataFrame([], "tenant_id string, source string, path string, content string"))).count() == 0


def test_handlers(spark):
    routine = "routine_id long, tenant_id string, fqn string, object_fqn string, module_type string, name string, config_id string, routine_kind string, export boolean, region string, directive string, override_mode string, override_target string"
    r = spark.createDataFrame([(1, "t", "Catalog.А.Form.Ф::При", "Catalog.А", "FormModule", "При", "base", "Procedure", False, None, None, None, None), (2, "t", "Catalog.А.Module.ObjectModule::ПЕРЕДЗаписью", "Catalog.А", "ObjectModule", "ПЕРЕДЗаписью", "base", "Procedure", False, None, None, None, None), (3, "t", "Catalog.А.Form.Ф::Проч", "Catalog.А", "FormModule", "Проч", "base", "Function", True, None, None, None, None)], routine).withColumn("deleted_at", F.lit(None).cast("timestamp"))
    f = metadata_xml.forms(spark.createDataFrame([("t", "base", "Catalog.А.Form.Ф", "<Form><Events><Event name='OnOpen'>При</Event><Event name='OnClose'>Нет</Event></Events></Form>")], "tenant_id string, config_id string, path string, content string")).withColumnRenamed("path", "form")
    h = graph.handles(f, r)
    assert [(x.routine, x.event) for x in h.collect()] == [("Catalog.А.Form.Ф::При", "OnOpen")]
    assert {(x.routine.split("::")[1], x.entry) for x in graph.find_handlers(h, r).collect()} == {("При", "событие_формы"), ("ПЕРЕДЗаписью", "запись")}
    e = graph.routine_edges(r, h, spark.createDataFrame([("t", "a", "b", "local", "high")] * 2, "tenant_id string, caller string, callee string, kind string, confidence string"))
    assert sorted(x.rel for x in e.collect()) == ["CALLS", "DECLARES", "DECLARES", "DECLARES", "HANDLES"]
    two = spark.createDataFrame([("t", "Ф", "base", [("б", None, None), ("а", "к", None), ("в", None, "д")], [("э", "п", "в")]), ("t", "Ф", "ext:Я", [("б", None, None)], [])], "tenant_id string, form string, config_id string, items array<struct<name:string,command:string,data_path:string>>, handlers array<struct<event:string,handler:string,element:string>>")
    assert [(x.config_id, x.item) for x in graph.form_card(two).collect()] == [("ext:Я", "б")]
    assert [x.item for x in graph.form_card(two.where("config_id = 'base'")).orderBy("place").collect()] == ["в", "а", "б"]


def test_index_inputs(spark):
    o = spark.createDataFrame([(1, "t", "Catalog.А", "Catalog", "А", "base", "1"), (1, "t", "Catalog.А", "Catalog", "А", "base", "1"), (2, "t", "Document.А", "Document", "а", "base", None)], "object_id long, tenant_id string, fqn string, kind string, name string, config_id string, config_version string").withColumn("deleted_at", F.lit(None).cast("timestamp"))
    assert [(r.low, r.n) for r in index.name_index(o).collect()] == [("а", 2)]
    diff = index.snapshot_diff(index.snapshot(o), index.snapshot(o.where("object_id = 1").withColumn("config_version", F.lit(None).cast("string"))))
    assert {(r.fqn, r.change) for r in diff.collect()} == {("Catalog.А", "changed"), ("Document.А", "removed")}
    m = spark.createDataFrame([("t", "А", "ObjectModule", None), ("t", "Б", "ObjectModule", None), ("t", "Б", "ManagerModule", None), ("t", "В", "Module", None), ("t", "В", "FormModule", "Ф")], "tenant_id string, object_fqn string, module_type string, form string")
    assert {r.object_fqn: r.module for r in index.pick_module(m).collect()} == {"А": "ObjectModule", "Б": None, "В": "Module"}
    assert {r.object_fqn: r.module for r in index.pick_module(m, "Manager").collect()} == {"А": None, "Б": "ManagerModule", "В": None} and {r.module for r in index.pick_module(m, "Form:Ф").collect()} == {None, "Form:Ф"}
    f = spark.createDataFrame([("t", "a", 1), ("t", "b", None), ("u", "c", 1)], "tenant_id string, path string, mtime int")
    u = spark.createDataFrame([("t", "a")], "tenant_id string, path string")
    assert {r.tenant_id: r.state for r in index.status(f, f.where("tenant_id = 't'"), u).collect()} == {"t": "built", "u": "missing"}
    assert {r.state for r in index.status(f.where("path = 'a'"), f.where("tenant_id = 't'"), u).collect()} == {"outdated"} and {r.state for r in index.status(f, f, u.limit(0)).collect()} == {"empty"}
    c = spark.createDataFrame([("x", "текст"), ("y", "другой")], "chunk string, text string")
    todo, gone = index.to_embed(c, c.where("chunk = 'x'").select("chunk", F.sha1(F.concat("text", F.lit("\0"))).alias("text_hash")).unionByName(spark.createDataFrame([("z", "h")], "chunk string, text_hash string")))
    assert [r.chunk for r in todo.collect()] == ["y"] and [r.chunk for r in gone.collect()] == ["z"]
    r = spark.createDataFrame([(1, "t", "m::А", "о", "Module", "А", None, 1, 2, 4), (2, "t", "m::Б", "о", "Module", "Б", None, 1, 5, 6)], "routine_id long, tenant_id string, fqn string, object_fqn string, module_type string, name string, region string, file_id long, start_line int, end_line int").withColumn("deleted_at", F.lit(None).cast("timestamp"))
    files = spark.createDataFrame([(1, "// о А\nПроцедура А(\n б)\nКонецПроцедуры\nПроцедура Б() Экспорт\nКонецПроцедуры"), (2, None)], "file_id long, content string")
    assert {x.routine_id: x.signature for x in index.signatures(r, files).collect()} == {1: "Процедура А( б)", 2: "Процедура Б() Экспорт"}
    assert {x.routine_id: x.body.split("\n")[0] for x in index.routine_units(r, files).collect()} == {1: "// о А", 2: "Процедура Б() Экспорт"}


def test_full_text_reads_only_its_terms(spark, tmp_path):
    d = spark.createDataFrame([(i, f"слово{i} общее", None) for i in range(300)] + [(1000, None, "общее"), (1001, "", "")], "k long, t string, n string")
    at = search.FullText.build(d, "k", {"t": 1, "n": 10}, f"file://{tmp_path}/index")
    plan = at.postings_of([("общее", False)])._jdf.queryExecution().executedPlan().toString()
    assert "(bucket#" in plan.split("PartitionFilters:")[1].split("]")[0] and "EqualTo(token,общее)" in plan
    hits = at.search({1: "слово7", 2: "общее", 3: "нетничего"}).collect()
    assert [(r.k, r.total) for r in hits if r.query_id == 1] == [(7, 1)] and [r.k for r in hits if r.query_id == 2][0] == 1000 and {r.total for r in hits if r.query_id == 2} == {301} and not [r for r in hits if r.query_id == 3]
    s = spark.createDataFrame([("а б в Склады г д е ж з и к л м н",), ("нет",)], "t string").select(search.snippet(F.col("t"), "склад", 4).alias("s")).collect()
    assert s[1].s == "нет" and "Склады" in s[0].s


def test_semantic_links_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "HELD", 2)
    objects = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)] + [(9, [0.0, 0.0]), (8, None), (7, [1.0])], "vec_id long, embedding array<float>")
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (1, [1.0, 0.0]), (3, [0.0, 0.0])], "query_id long, qvec array<float>")
    got = search.link_semantic(docs, objects, k=2, least=0.8).orderBy(F.desc("confidence")).collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(1, 0), (1, 1)] and got[0].confidence == 1.0
    top = search.exact_top_k(objects, docs, 2).orderBy("place").collect()
    assert [(r.query_id, r.vec_id) for r in top] == [(1, 0), (1, 1)] and search.exact_top_k(objects, docs.limit(0)).count() == 0


def test_upsert_keeps_and_removes(spark):
    t = spark.createDataFrame([(1, "a", "b")], "k int, x string, y string")
    got = state.upsert(t, spark.createDataFrame([(1, None), (2, "c")], "k int, x string"), ["k"]).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, None, "b"), (2, "c", None)]


def test_blocks_of_a_hot_key(spark):
    rows = spark.range(1000).selectExpr("id", "case when id < 900 then 1 else id end as k")
    got = in_blocks(rows.unionByName(spark.createDataFrame([(1, None)], "id long, k long")), "k", "id", 100).groupBy("k", "block").count().collect()
    hot = [r["count"] for r in got if r.k == 1]
    assert len(hot) == 9 and max(hot) < 200 and sum(r["count"] for r in got) == 1001 and {r.block for r in got if r.k != 1} == {0}


def test_models_and_standards(spark):
    d = spark.createDataFrame([(1, "аб"), (2, None), (3, "")], "k int, t string")
    got = {r.k: list(r.embedding) for r in search.embed_with(d, "k", "t", lambda: lambda xs: [[len(x), 1] for x in xs]).collect()}
    assert got == {1: [2.0, 1.0], 3: [0.0, 1.0]}
    hits = spark.createDataFrame([(1, "a", "q", "длинный текст"), (1, "b", "q", None), (1, "c", "q", "текст")], "query_id int, unit string, q string, t string")
    assert [r.unit for r in search.rerank_with(hits, "q", "t", lambda: lambda qs, ts: [len(x) for x in ts], 2).orderBy("place").collect()] == ["a", "c"]
    names = spark.createDataFrame([("396",), ("#std396",), ("v8std_396",), ("its:x",), (" без номера ",), (None,)], "q string").select(docs.standard_fqn(F.col("q")).alias("f")).collect()
    assert [r.f for r in names] == ["its:v8std_396"] * 3 + ["its:x", "its:без номера", "its:"]
    pages = spark.createDataFrame([(1, "public", None), (2, "inherited", "public"), (3, "inherited", None), (4, "odd", None), (5, None, "public")], "id int, access string, inherited string")
    assert {r.id for r in docs.accepted(pages).collect()} == {1, 2} and {r.id for r in docs.accepted(pages, "restricted").collect()} == {3, 4, 5} and docs.accepted(pages, "all").count() == 5
