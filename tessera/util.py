"""Helpers that all operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session. Where it is unset, a local
    session, as in tests, gets a temporary folder of its machine, and any other is an error."""
    there = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        there = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(there)
    return there


def settle(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and go on from what was written: lineage is cut, a lost executor
    costs nothing, and later readers prune columns. The folder is removed when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def in_blocks(rows: DataFrame, key: str, item: str, size: int) -> DataFrame:
    """The rows with a ``block`` number, so that a (key, block) has about ``size`` rows: by a hash of the item modulo the
    blocks that the key needs. Keys with one block, nearly all, need no count; the counts of the others are few, and a
    hot key is never sorted or held in one place."""
    from pyspark.sql import functions as F

    many = settle(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > size).select(key, F.ceil(F.col("n") / size).cast("int").alias("n_blocks")))
    return rows.join(many, key, "left").withColumn("block", F.when(F.col("n_blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64(item), F.col("n_blocks"))).cast("int")).drop("n_blocks")


def runs(batches, key: str = "key"):
    """Record batches sorted by ``key`` -> tables that hold each key's rows whole, several keys a table."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        last = t.column(key)[t.num_rows - 1]
        cut = t.num_rows - pc.sum(pc.equal(t.column(key), last)).as_py()
        if cut == 0 and held and held[-1].column(key)[0].as_py() != last.as_py():
            yield pa.concat_tables(held).combine_chunks()
            held = []
        if cut:
            held.append(t.slice(0, cut))
            yield pa.concat_tables(held).combine_chunks()
            held = []
        held.append(t.slice(cut))
    if held:
        yield pa.concat_tables(held).combine_chunks()
