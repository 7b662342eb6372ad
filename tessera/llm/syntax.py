"""Problem 1: source files that do not parse, per file and as rates per repository and language.

Method: memoised parsing with derivatives over token streams (``derivatives``, ``grammars``): an
empty derivative marks the failing token, an end that is not nullable means the file was cut off.

Defined results: null content is not judged (``valid`` null); an extension without a grammar is not
judged; an empty ``.bsl`` is valid, an empty ``.xml``, ``.mdo`` or ``.json`` is not; repeated rows of
a file_id give one row in ``found``. Work is one pass over the files, no shuffle but for the rates.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERDICT = "file_id bigint, tenant_id string, source string, language string, valid boolean, line int, truncated boolean"


def language_of(path):
    """The language by the path's extension, whatever its case; null for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("xml", "mdo"), "xml").when(ext.isin("bsl", "json"), ext)


def verdicts(files: DataFrame) -> DataFrame:
    """One row per row of ``files`` (file_id, tenant_id, path, source, content): is it valid, and if
    not, at which line, and was it cut off."""
    rows = files.select(F.col("file_id").cast("bigint"), "tenant_id", "source", language_of(F.col("path")).alias("language"), F.col("content").alias("text"))

    def judge(batches):
        from tessera.llm.grammars import checker

        parser = checker()
        for b in batches:
            valid, line, cut = [], [], []
            for language, text in zip(b.column("language").to_pylist(), b.column("text")):
                text = text.as_py()
                if language is None or text is None:
                    valid.append(None), line.append(None), cut.append(None)
                    continue
                at = parser.failing(language, text)
                valid.append(at is None), line.append(at and at[0]), cut.append(at and at[1])
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in ("file_id", "tenant_id", "source", "language")], pa.array(valid, pa.bool_()), pa.array(line, pa.int32()), pa.array(cut, pa.bool_())],
                ["file_id", "tenant_id", "source", "language", "valid", "line", "truncated"],
            )

    return rows.mapInArrow(judge, VERDICT)


def invalid_files(files: DataFrame) -> DataFrame:
    """p1_found: the ids of the files with content that is not valid for its extension."""
    return verdicts(files).where("valid = false").select("file_id").distinct()


def rates(files: DataFrame) -> DataFrame:
    """Files judged, invalid and cut off per tenant, source and language. Ids delivered twice count once."""
    v = verdicts(files).where("valid is not null").groupBy("file_id").agg(*[F.min(c).alias(c) for c in ("tenant_id", "source", "language", "valid", "truncated")])
    return v.groupBy("tenant_id", "source", "language").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum((~F.col("valid")).cast("bigint")).alias("n_invalid"),
        F.sum(F.coalesce(F.col("truncated"), F.lit(False)).cast("bigint")).alias("n_truncated"),
        F.round(F.avg((~F.col("valid")).cast("double")), 6).alias("invalid_rate"),
    )
