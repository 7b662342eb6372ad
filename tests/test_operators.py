"""Facts of single operators on small tables, with nulls, ties, repeated rows and empty tables."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tessera import scope
from tessera.operators import code, components, docs, metadata, metrics, orphans, search, state, text


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (4, 4), (None, 1), (3, 1), (2, 1)] + [(i, i + 1) for i in range(10, 60)], "a long, b long")
    got = {r.node: r.component for r in components.components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} | {i: 10 for i in range(10, 61)}
    assert components.components(e.limit(0)).count() == 0


def test_components_of_long_chains(spark):
    """Rising ids, falling and rising ids in turn, and shuffled ids: each chain is one component."""
    mixed = random.Random(5).sample(range(20_000, 21_000), 1000)
    waves = [10_000 + (i if i % 2 else 2000 + i) for i in range(1000)]
    chains = [list(range(1, 1001)), waves, mixed]
    e = spark.createDataFrame([(x, y) for c in chains for x, y in zip(c, c[1:])], "a long, b long")
    got = {r.node: r.component for r in components.components(e).collect()}
    assert got == {x: min(c) for c in chains for x in c}


T = "timestamp'2024-0{}-01'"


def orphan_tables(spark):
    o = spark.createDataFrame([(1, "t", "Catalog.А", "Catalog", "А", 1, 3), (1, "t", "Catalog.А", "Catalog", "А", 1, 3), (2, "t", "Catalog.А", "Catalog", "А", 5, None), (3, "t", "CommonModule.М", "CommonModule", "М", 1, None), (4, None, None, None, None, None, None)], "object_id long, tenant_id string, fqn string, kind string, name string, a int, b int")
    month = lambda c: F.expr(f"cast(concat('2024-0', {c}, '-01') as timestamp)")
    o = o.withColumn("first_seen", month("a")).withColumn("deleted_at", month("b")).withColumn("key", F.lit(1))
    r = spark.createDataFrame([(1, "t", "CommonModule.М.Module.Module::Есть", None, None, 1, None), (2, "t", "X.Y.Module.M@ext:E::Н", "После", "нет", 1, None), (3, "t", "X.Y.Module.M@ext:E::Н2", "После", "ДА", 1, None), (4, "t", "X.Y.Module.M::Да", None, None, 1, None), (5, "t", "X.Z::Н", "Перед", None, 1, None)], "routine_id long, tenant_id string, fqn string, override_mode string, override_target string, a int, b int")
    r = r.withColumn("first_seen", month("a")).withColumn("deleted_at", month("b")).withColumn("seen_at", month("2"))
    t = spark.createDataFrame([(1, "t", "reference", "Catalog", " а ", 2), (2, "t", "reference", "Catalog", "А", 4), (3, "t", "reference", "Catalog", "А", 6), (4, "t", "reference", "Catalog", None, 4), (5, "t", "primitive", "Catalog", "Нет", 4), (6, "t", "reference", "Catalog", "  ", 4), (7, None, "reference", "Catalog", "А", 4), (2, "t", "reference", "Catalog", "А", 4), (8, "t", "reference", "Catalog", "А", 3)], "ref_id long, tenant_id string, category string, ref_kind string, ref_name string, a int")
    t = t.withColumn("seen_at", month("a"))
    c = spark.createDataFrame([(1, 4, "м", "ЕСТЬ", 2), (2, 4, "М", "Нету", 2), (3, 4, "Другой", "Нету", 2), (4, 4, None, "Нету", 2), (5, 99, "М", "Нету", 2), (6, None, "М", "Нету", 2)], "call_id long, caller_id long, qualifier string, method string, a int").withColumn("seen_at", month("a"))
    return o, r, c, t


def test_orphans(spark):
    tables = orphan_tables(spark)
    got = {(r.ref_table, r.ref_id) for r in orphans.orphans(*tables).collect()}
    assert got == {("type_refs", 2), ("type_refs", 8), ("routines", 2), ("calls", 2)}
    assert {(r.ref_table, r.month, r.n_orphans) for r in orphans.orphan_counts(*tables).collect()} == {("type_refs", "2024-04", 1), ("type_refs", "2024-03", 1), ("routines", "2024-02", 1), ("calls", "2024-02", 1)}
    assert orphans.orphans(*[x.limit(0) for x in tables]).count() == 0
    assert orphans.orphans(tables[0].limit(0), *tables[1:]).count() == 5


def test_search_tokens(spark):
    rows = spark.createDataFrame([("ПолучитьДанные_Склада2 ERPОтчет получить",), ("",), (None,)], "t string").select(text.search_tokens(F.col("t")).alias("x")).collect()
    assert [r.x for r in rows] == ["ПолучитьДанные Получить Данные Склада2 ERPОтчет", "", ""]


def test_split_lines_against_brute_force(spark):
    body = "\n".join(["слово " * 10] * 5 + [""] + ["x" * 30] * 8 + ["y" * 200])
    rows = text.split_lines(spark.createDataFrame([(1, body), (2, ""), (3, None)], "k int, t string"), ["k"], "t", 100).orderBy("k", "part").collect()
    one = [r for r in rows if r.k == 1]
    rng = random.Random(4)
    for _ in range(400):
        t = "\n".join(rng.choice(["", " ", "a" * rng.randint(1, 12), "b c"]) for _ in range(rng.randint(1, 30)))
        want, held, weight = [], [], 0
        for line in t.split("\n"):
            n = len(line.replace(" ", ""))
            if held and (weight >= 10 and n or weight > 10 and not n):
                want.append("\n".join(held))
                held, weight = [], 0
            held.append(line)
            weight += n
        assert [x for x, _ in text.segments(t, 10)] == [*want, "\n".join(held)], t
    assert "\n".join(r.segment for r in one) == body and [r.k for r in rows if r.k > 1] == [2]
    for a in one[:-1]:
        assert a.weight > 0


def test_markdown(spark):
    md = "pre\n# A\nx\n## B\ny\n# C\n"
    rows = text.markdown_sections(spark.createDataFrame([(1, md), (2, None), (3, "")], "k int, t string"), "k", "t").orderBy("nth", F.desc("body")).collect()
    assert [(r.title, list(r.path), r.body) for r in rows] == [("", [], "pre"), ("", [], ""), ("A", [], "x"), ("B", ["A"], "y"), ("C", [], "")]


def test_mentions(spark):
    r = spark.createDataFrame([("см. Catalog.Товары и Document.Счет, XCatalog.Нет",)], "t string").select(text.mentions(F.col("t")).alias("m")).first()
    assert r.m == ["Catalog.Товары", "Document.Счет"]


def test_rrf(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id long, unit string, place int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id long, unit string, place int")
    got = [(r.unit, r.score) for r in search.rrf([a, b]).orderBy("place").collect()]
    assert got == [("y", round(1 / 60 + 1 / 61, 5)), ("x", round(1 / 60, 5)), ("z", round(1 / 61, 5))]


def test_bm25_ranks_names_over_text(spark):
    d = spark.createDataFrame([(1, "склад товар", "Прочее"), (2, "прочее", "Склад"), (3, None, None)], "k long, t string, n string")
    got = search.bm25(d, "k", {"t": 1, "n": 5}, {1: "склад"}).orderBy("place").collect()
    assert [r.k for r in got] == [2, 1] and got[0].total == 2


def test_hash_embed_and_cosine(spark):
    e = {r.k: r.embedding for r in search.hash_embed(spark.createDataFrame([(1, "а б"), (2, "Б А"), (3, None)], "k int, t string"), "k", "t").collect()}
    assert e[1] == e[2] and abs(sum(x * x for x in e[1]) - 1) < 1e-5 and not any(e[3])
    r = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<double>, b array<double>").select(F.round(search.cosine(F.col("a"), F.col("b")), 6).alias("c")).collect()
    assert [x.c for x in r] == [0.707107, None, None]


def test_l2_as_its_sql(spark, tmp_path):
    """Signs of zeros, halves, one id with two vectors or none, repeated rows: to the bit as in SQL."""
    import duckdb

    import __spark_entry__ as entry

    nan = float("nan")
    ties = [3.0, 1.0, 19999.0, 167.0, 110.0]  # of length 20000; 3 / 20000 is less than the half 0.00015
    rows = [(1, [-1.0, 30000.0]), (1, [-1.0, 30000.0]), (2, ties), (3, [-x for x in ties]), (4, [-0.0, 2.0, 0.0]), (5, [0.0, -0.0]), (6, []), (7, None), (8, [3.0, 4.0]), (8, [4.0, 3.0]), (8, [3.0, 4.0]), (None, [1.0]), (None, [2.0, 0.0]), (9, [nan, 1.0]), (10, [-1e-40, 1e38]), (11, [-float("inf"), -1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/chunk_vectors.parquet")
    got = entry.queries()["op_V03_l2"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW chunk_vectors AS SELECT * FROM read_parquet('{tmp_path}/chunk_vectors.parquet/*.parquet')")
    want = con.execute(entry.oracle_sql()["op_V03_l2"]).fetchall()
    as_text = sorted(repr((r.vec_id, list(r.unit))) for r in got)
    assert as_text == sorted(map(repr, want))
    assert {"(1, [-0.0, 1.0])", "(4, [-0.0, 1.0, 0.0])", "(5, [0.0, -0.0])", "(8, [0.6, 0.8])", "(8, [0.8, 0.6])", "(2, [0.0001, 0.0001, 1.0, 0.0084, 0.0055])"} <= set(as_text) and len(as_text) == 13


def code_tables(spark):
    r = spark.createDataFrame(
        [(1, "t", "CommonModule.О.Module.Module::Метод", "CommonModule.О", "Module", "Метод"), (2, "t", "Catalog.К.Module.ManagerModule::Метод", "Catalog.К", "ManagerModule", "Метод"), (3, "t", "Catalog.К.Module.ObjectModule::Свой", "Catalog.К", "ObjectModule", "Свой"), (4, "t", "Catalog.К.Module.ObjectModule::Вызов", "Catalog.К", "ObjectModule", "Вызов"), (5, "t", "CommonModule.К.Module.Module::Метод", "CommonModule.К", "Module", "Метод")],
        "routine_id long, tenant_id string, fqn string, object_fqn string, module_type string, name string",
    ).withColumn("deleted_at", F.lit(None).cast("timestamp"))
    c = spark.createDataFrame([(1, 4, None, "Свой"), (2, 4, "О", "Метод"), (3, 4, "К", "Метод"), (4, 4, "о", "Метод"), (5, 4, None, "Нет"), (1, 4, None, "Свой"), (6, 77, None, "Свой")], "call_id long, caller_id long, qualifier string, method string").selectExpr("*", "lower(qualifier) qualifier_low", "lower(method) method_low", "1 line", "timestamp'2024-01-01' loaded_at")
    return r, c


def test_call_resolution(spark):
    r, c = code_tables(spark)
    got = {x.call_id: (x.kind, x.confidence) for x in code.resolve_calls(c, r, r).collect()}
    assert got == {1: ("local", "high"), 2: ("common_module", "high"), 3: ("common_module", "high"), 4: ("unresolved", None), 5: ("unresolved", None)}
    got = {x.call_id: x.kind for x in code.resolve_calls(c, r.where("routine_id <> 5"), r, True).collect()}
    assert got[3] == "manager" and got[4] == "common_module"
    assert code.resolve_calls(c.limit(0), r, r).count() == 0


def test_call_path_ends_in_cycles(spark):
    e = spark.createDataFrame([("t", "a", "b"), ("t", "b", "c"), ("t", "c", "a"), ("t", "c", "d"), ("t", "a", "x"), ("t", "x", "d")], "tenant_id string, caller string, callee string")
    one = lambda *n: spark.createDataFrame([("t", x) for x in n], "tenant_id string, fqn string")
    got = {(r.src, r.dst): (r.hops, list(r.path)) for r in code.call_path(e, one("a", "zzz"), one("d", "a")).collect()}
    assert got == {("a", "a"): (0, ["a"]), ("a", "d"): (2, ["a", "x", "d"])}


def test_enclosing_and_hunks(spark):
    s = spark.createDataFrame([("t", "p", 1, 1, 10), ("t", "p", 2, 11, 900), ("t", "p", 3, None, None), ("t", "p", 2, 11, 900)], "tenant_id string, path string, id long, start_line int, end_line int")
    p = spark.createDataFrame([("t", "p", 5), ("t", "p", 700), ("t", "p", 1000)], "tenant_id string, path string, line int")
    assert {r.line: r.id for r in code.enclosing(p, s).collect()} == {5: 1, 700: 2}
    h = spark.createDataFrame([("t", "p", 10, 11)], "tenant_id string, path string, lo int, hi int")
    assert {r.id for r in code.touched_routines(h, s).collect()} == {1, 2}
    whole = spark.createDataFrame([("t", "p", None, None)], "tenant_id string, path string, lo int, hi int")
    assert {r.id for r in code.touched_routines(whole, s).collect()} == {1, 2, 3}


def test_overlay(spark):
    e = lambda *rows: spark.createDataFrame(list(rows), "src string, rel string, dst string")
    k = lambda *n: spark.createDataFrame([(x,) for x in n], "fqn string")
    got = {(r.src, r.dst, r.layer) for r in state.merge_edge_rows(e(("a", "R", "x"), ("b", "R", "y"), ("c", "R", "z"), ("d", "R", "w")), e(("a", "R", "new"), ("e", "R", "w")), k("a"), k("c")).collect()}
    assert got == {("a", "new", "working"), ("e", "w", "working"), ("b", "y", "release")}


def test_state_is_idempotent(spark):
    s = spark.createDataFrame([("t", "a", "1"), ("t", "b", "1"), ("t", "c", None)], "tenant_id string, fqn string, version string")
    assert state.changed_fqns(s.where("version is not null"), s.where("version is not null")).count() == 0
    n = spark.createDataFrame([("t", "a", "1"), ("t", "a", "2"), ("t", "d", None)], "tenant_id string, fqn string, version string")
    assert {(r.fqn, r.change) for r in state.changed_fqns(s, n).collect()} == {("a", "changed"), ("b", "deleted"), ("c", "deleted"), ("d", "added")}
    c = spark.createDataFrame([("t", "a", "1"), ("t", "c", "9")], "tenant_id string, owner_fqn string, version string")
    assert {r.fqn for r in state.stale_chunk_owners(s, c).collect()} == {"b"}
    up = state.upsert(s, spark.createDataFrame([("t", "a", None), ("t", "z", "7")], "tenant_id string, fqn string, version string"), ["tenant_id", "fqn"])
    assert {(r.fqn, r.version) for r in up.collect()} == {("a", None), ("b", "1"), ("c", None), ("z", "7")}


def test_documents(spark):
    c = spark.createDataFrame([("o", "o#chunk/10", "ten"), ("o", "o#chunk/2", "two"), ("o", "o#chunk", "zero")], "owner string, fqn string, text string")
    assert docs.get_document(c).first().body == "zero\n\ntwo\n\nten" and docs.get_document(c, True).first().body == "zero\n\nten\n\ntwo"
    p = spark.createDataFrame([("8.3.9", "k", "А.Найти", "Найти", "Find"), ("8.3.10", "k", "А.Найти", "Найти", "Find"), ("8.3.10", "k", "Б.Найти", "Найти", "Find")], "version string, help_kind string, full_name string, name string, en_name string")
    got = docs.docinfo(p, spark.createDataFrame([("НАЙТИ",)], "q string")).orderBy("place").collect()
    assert [r.version for r in got] == ["8.3.10", "8.3.10", "8.3.9"] and got[0].n_full == 2
    assert [r.version for r in docs.versions(p).collect()] == ["8.3.10", "8.3.9"]


def test_gateway(spark):
    s = spark.createDataFrame([("a", 1), ("b", 2)], "name string, export int")
    tables = {"symbols": s, "calls": s}

    def run(q, **how):
        return metrics.gateway(spark, q, tables, **how).collect()

    assert run("SELECT name FROM symbols WHERE export = 2;")[0].name == "b"
    assert run("SELECT replace(name, 'a', 'drop; x') AS r FROM symbols ORDER BY 1 DESC")[0].r == "drop; x"
    assert run("WITH x AS (SELECT * FROM symbols), y AS (SELECT * FROM x) SELECT count(*) AS n FROM y JOIN calls USING (name) WHERE y.export IN (SELECT export FROM calls) AND EXISTS (SELECT 1 FROM x)")[0].n == 2
    assert [r.truncated for r in run("SELECT * FROM symbols", cap=1)] == [True] and [r.truncated for r in run("SELECT * FROM symbols", cap=2)] == [False] * 2
    assert run("SELECT 1 AS truncated")[0].asDict() == {"truncated": 1, "truncated_": False}
    for bad in (
        "DELETE FROM symbols", "SELECT 1; SELECT 2", "WITH x AS (SELECT 1) DELETE FROM symbols", "", "SHOW TABLES", "INSERT INTO symbols SELECT * FROM calls", "SET a=b", "CREATE VIEW a AS SELECT 1", "EXPLAIN SELECT 1",
        "SELECT * FROM text.`/etc/hostname`", "SELECT * FROM symbols WHERE name IN (SELECT value FROM text.`/etc/hosts`)", "WITH x AS (SELECT * FROM csv.`/etc/hosts`) SELECT * FROM x", "SELECT (SELECT max(value) FROM text.`/etc/hosts`)",
        "SELECT reflect('java.lang.System', 'getProperty', 'java.version')", "SELECT java_method('java.lang.System', 'getProperty', 'java.version')", "SELECT input_file_name() FROM symbols", "SELECT * FROM range(3)", "SELECT TRANSFORM(name) USING 'cat' FROM symbols", "SELECT * FROM other", "SELECT current_user()",
    ):
        with pytest.raises(metrics.Rejected):
            run(bad)
    assert not [t.name for t in spark.catalog.listTables() if t.name in tables]


def test_scope_and_jobs(spark):
    with pytest.raises(scope.Refused):
        scope.TenantScope("")
    with pytest.raises(scope.Refused):
        scope.TenantScope("a", overlay="b@task/1")
    df = spark.createDataFrame([("a",), ("b",), (scope.SHARED,), (None,)], "tenant_id string")
    assert scope.TenantScope("a").apply(df).count() == 2
    assert scope.resolve_tenant("x", {}, {scope.token_hash("x"): "t"}) == "t"
    with pytest.raises(scope.Refused):
        scope.resolve_tenant(None, {}, {})
    run = scope.JobRunner()
    ok, bad = run.submit("a", [("s", lambda: time.sleep(0.05) or 1)]), run.submit("b", [("s", lambda: 1 / 0)])
    with pytest.raises(ValueError):
        run.submit("a", [])
    run.todo.join()
    assert (ok.status, bad.status) == ("succeeded", "failed")
    late = scope.Job("c", [], status="running")
    run.restore([late])
    assert late.status == "failed"


def test_paths(spark):
    f = spark.createDataFrame([(1, "Catalogs/А/Ext/ObjectModule.bsl"), (2, "src/Catalogs/А/А.mdo"), (3, "Subsystems/Х/Subsystems/У.xml"), (4, "docs/a.json"), (5, None), (6, "Documents/Д/Forms/Ф/Ext/Form/Module.BSL")], "file_id long, path string")
    got = {r.file_id: (r.object, r.form, r.module) for r in metadata.describe_paths(f).collect()}
    assert got == {1: ("Catalog.А", None, "ObjectModule"), 2: ("Catalog.А", None, None), 3: ("Subsystem.Х.Subsystem.У", None, None), 4: (None, None, None), 5: (None, None, None), 6: ("Document.Д", "Ф", "Module")}
