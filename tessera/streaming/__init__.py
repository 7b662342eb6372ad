"""Streams: incremental ingest of arriving files by micro-batches.

The model has no event time and no windows; what arrives is merged into tables by key, batch by batch.
Replaying a batch changes nothing, since the merge is an upsert on keys and the touched buckets are swapped whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.state import upsert


class VersionedTable:
    """A table in a folder, in ``buckets`` by a hash of its keys. A version is a small file that names the folder of each
    bucket; the greatest counts, so that readers see either the old or the new table. A merge reads and writes only the
    buckets that it touches and takes the others over. Versions go on by one from the last, whoever writes. ``KEPT``
    versions stay for readers that began before; folders that only older ones name are removed."""

    KEPT = 3

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], buckets: int = 16):
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), keys, buckets
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[tuple[int, str]]:
        """(version, file) of all versions, the oldest first."""
        here = self.path(self.folder)
        names = [s.getPath().getName() for s in self.fs.listStatus(here)] if self.fs.exists(here) else []
        return sorted((int(n[len("version-") :]), n) for n in names if n.startswith("version-"))

    def _named(self, file: str) -> dict[int, str]:
        """Bucket -> folder, as a version states it."""
        stream = self.fs.open(self.path(f"{self.folder}/{file}"))
        text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return {int(b): f for b, f in (line.split(" ", 1) for line in text.splitlines() if line)}

    def current(self) -> dict[int, str]:
        done = self.versions()
        return self._named(done[-1][1]) if done else {}

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        at = [f"{self.folder}/{f}" for b, f in sorted(self.current().items()) if buckets is None or b in buckets]
        return self.spark.read.parquet(*at) if at else None

    def merge(self, rows: DataFrame) -> None:
        """Rows update and add by key; a row with a key that is there keeps the columns that it does not name."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = [r[0] for r in rows.select(bucket.alias("b")).distinct().collect()]  # at most as many as buckets
        if not touched:
            return
        old = self.read(touched)
        new = rows if old is None else upsert(old, rows, self.keys)
        name = uuid.uuid4().hex
        new.withColumn("__bucket", bucket).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.folder}/data-{name}")
        named = self.current() | {b: f"data-{name}/__bucket={b}" for b in touched}
        number = self.versions()[-1][0] + 1 if self.versions() else 0
        draft = self.path(f"{self.folder}/draft-{name}")
        out = self.fs.create(draft)
        out.write(bytearray("".join(f"{b} {f}\n" for b, f in sorted(named.items())).encode()))
        out.close()
        self.fs.rename(draft, self.path(f"{self.folder}/version-{number:012d}"))  # is there whole, or not at all
        self._vacuum()

    def _vacuum(self) -> None:
        done = self.versions()
        used = {f.split("/")[0] for _, file in done[-self.KEPT :] for f in self._named(file).values()}
        for _, file in done[: -self.KEPT]:
            for folder in {f.split("/")[0] for f in self._named(file).values()} - used:
                self.fs.delete(self.path(f"{self.folder}/{folder}"), True)
            self.fs.delete(self.path(f"{self.folder}/{file}"), False)


def ingest_stream(stream: DataFrame, target: VersionedTable, order: str, checkpoint: str, once: bool = True):
    """Rows of a stream merged into ``target`` by its keys; of several rows of a key in a batch the last by
    ``order`` counts. With ``once`` what is there now is taken, then the query ends."""
    keys = target.keys

    def merge(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in keys]), order).alias("r")).select(*keys, "r.*")
        last = last.persist()  # counted by bucket, then written
        target.merge(last)
        last.unpersist()

    w = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="1 minute")).start()
