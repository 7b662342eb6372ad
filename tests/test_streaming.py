"""Streams of arriving files, scalar functions, and that the core stands without the llm package."""

import os
import subprocess
import sys

from pyspark.sql import functions as F

from tessera import functions as fn
from tessera.streaming import VersionedTable, ingest_stream


def test_ingest_stream(spark, tmp_path):
    schema = "id int, text string, version int"
    inbox = tmp_path / "in"
    spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], schema).write.json(str(inbox))
    table = VersionedTable(spark, f"file://{tmp_path}/table", ["id"], 4)
    for _ in range(2):  # the second run finds nothing new
        ingest_stream(spark.readStream.schema(schema).json(str(inbox)), table, "version", str(tmp_path / "cp")).awaitTermination()
        assert {(r.id, r.text) for r in table.read().collect()} == {(1, "b"), (2, "c")}
    spark.createDataFrame([(2, None, 3), (3, "d", 1)], schema).write.mode("append").json(str(inbox))
    ingest_stream(spark.readStream.schema(schema).json(str(inbox)), table, "version", str(tmp_path / "cp")).awaitTermination()
    assert {(r.id, r.text) for r in table.read().collect()} == {(1, "b"), (2, None), (3, "d")}
    # A new checkpoint begins at batch 0; what it brings is merged all the same, and old versions go.
    for n in range(4):
        spark.createDataFrame([(4, f"n{n}", n)], schema).write.json(str(tmp_path / f"in{n}"))
        ingest_stream(spark.readStream.schema(schema).json(str(tmp_path / f"in{n}")), table, "version", str(tmp_path / f"cp{n}")).awaitTermination()
        assert {(r.id, r.text) for r in table.read().collect()} == {(1, "b"), (2, None), (3, "d"), (4, f"n{n}")}
    assert len(table.versions()) == table.KEPT
    before = table.current()
    table.merge(spark.createDataFrame([(4, "last", 9)], schema))
    after = table.current()
    assert sum(before[b] != after[b] for b in after) == 1 and set(before) == set(after)  # other buckets are taken over
    table.merge(spark.createDataFrame([], schema))
    assert table.current() == after and {r.text for r in table.read().where("id = 4").collect()} == {"last"}
    used = {f.split("/")[0] for _, v in table.versions() for f in table._named(v).values()}
    assert {p.name for p in (tmp_path / "table").iterdir() if p.name.startswith("data-")} == used


def test_functions(spark):
    r = spark.createDataFrame([("base@task/7", "8.3.10", 3723, " Мой_Раздел / x ")], "t string, v string, s int, g string").select(
        fn.base_tenant(F.col("t")).alias("b"), fn.task_of(F.col("t")).alias("k"), fn.version_key(F.col("v")).alias("v"), fn.fmt_duration(F.col("s")).alias("d"), fn.in_namespace(F.col("t"), "base").alias("n"), fn.standard_number(F.lit("std 456")).alias("i"), fn.normalize_slug(F.col("g")).alias("g")
    )
    assert tuple(r.first()) == ("base", "7", [8, 3, 10], "1:02:03", True, 456, "мой-раздел-x")


def test_core_imports_without_llm():
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['tessera.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('p4') for q in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=here, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 90 and out[1:] == ["False", "True"]
