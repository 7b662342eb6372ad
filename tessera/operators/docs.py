"""Documents: versions, related documents, documents put together from chunks, incremental ingest.

A document is an external_id of a source; ``doc_units`` may hold several versions and deliveries of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(units: DataFrame) -> DataFrame:
    """Each document's last version; the greatest unit_id where times are equal."""
    w = Window.partitionBy("source", "external_id").orderBy(F.col("updated_at").desc_nulls_last(), F.desc("unit_id"))
    return units.dropDuplicates(["unit_id"]).withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def related_docs(units: DataFrame, fqn: str, relates: DataFrame | None = None) -> DataFrame:
    """Documents that mention an object, and those related with a confidence; mentions first."""
    u = latest(units)
    m = u.where(F.array_contains("links", fqn)).select("source", "external_id", "title", F.lit("MENTIONS").alias("rel"), F.lit(None).cast("double").alias("confidence"))
    if relates is not None:
        m = m.unionByName(u.join(relates.where(F.col("fqn") == fqn), ["source", "external_id"]).select("source", "external_id", "title", F.lit("RELATES_TO").alias("rel"), "confidence"))
    return m


def get_document(chunks: DataFrame, parity: bool = False) -> DataFrame:
    """Documents put together from chunks (owner, fqn, text) by blank lines, in order of the parts'
    numbers; with ``parity`` in the order of names as texts, where part 10 goes before part 2."""
    number = F.coalesce(F.expr("try_cast(regexp_extract(fqn, '/([0-9]+)$', 1) as int)"), F.lit(0))
    order = F.struct(F.lit(0).alias("n") if parity else number.alias("n"), "fqn", "text")
    return chunks.groupBy("owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["text"]), "\n\n").alias("body"), F.count(F.lit(1)).alias("parts"))


def version_key(c: Column) -> Column:
    """Numbers of a version, so that 8.3.10 goes after 8.3.9."""
    return F.transform(F.split(c, r"\."), lambda x: F.coalesce(F.regexp_extract(x, r"(\d+)", 1).try_cast("int"), F.lit(0)))


def docinfo(pages: DataFrame, names: DataFrame, version: str | None = None, limit: int = 25) -> DataFrame:
    """Help pages (version, help_kind, full_name, name, en_name, ...) by any of their names, whatever
    the case; ``n_full`` tells whether a name is ambiguous; the newest version is place 1."""
    p = pages if version is None else pages.where(F.col("version") == version)
    q = names.select(F.lower("q").alias("low")).distinct()
    keyed = p.select("*", F.explode(F.array_distinct(F.array(F.lower("full_name"), F.lower("name"), F.lower("en_name")))).alias("low"))
    hit = keyed.join(q, "low")
    w = Window.partitionBy("low").orderBy(version_key(F.col("version")).desc(), "full_name", "help_kind")
    n = hit.groupBy("low").agg(F.countDistinct("full_name").alias("n_full"))
    return hit.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).join(n, "low")


def versions(pages: DataFrame) -> DataFrame:
    """Pages by version and kind, newest version first by numbers."""
    return pages.groupBy("version").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("help_kind").alias("n_kinds")).orderBy(version_key(F.col("version")).desc())


def search_titles(units: DataFrame, term: str, limit: int = 50) -> DataFrame:
    """Titles that begin with the term, then those that hold it."""
    low = term.lower()
    u = latest(units).where(F.lower("title").contains(low))
    return u.select("unit_id", "title", F.when(F.lower("title").startswith(low), 0).otherwise(1).alias("how")).orderBy("how", "title", "unit_id").limit(limit)


def ingest_diff(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(source, external_id, change): added, changed, or deleted between two tables of
    (source, external_id, version_hash); equal hashes are no change, a null hash differs from any."""
    s = stored.select("source", "external_id", F.col("version_hash").alias("old"), F.lit(True).alias("was"))
    i = incoming.select("source", "external_id", F.col("version_hash").alias("new"), F.lit(True).alias("is"))
    j = s.join(i, ["source", "external_id"], "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(~F.col("old").eqNullSafe(F.col("new")) | F.col("old").isNull(), "changed")
    return j.select("source", "external_id", change.alias("change")).where("change is not null")


def effective_access(page_level: Column, inherited: Column) -> Column:
    """A page's own level, or the inherited one; unknown levels count as restricted."""
    level = F.when(page_level == "inherited", inherited).otherwise(page_level)
    return F.when(level.isin("public", "restricted", "all"), level).otherwise("restricted")


def accepted(pages: DataFrame, mode: str = "public", public: tuple[str, ...] = ("public",)) -> DataFrame:
    """The pages (access, inherited) of one side: ``public`` those whose effective level is public, ``restricted`` all
    others, unknown levels too, ``all`` both; the two sides never share a page."""
    level = F.when(F.col("access") == "inherited", F.col("inherited")).otherwise(F.col("access"))
    open_ = F.coalesce(level.isin(*public), F.lit(False))
    return {"public": pages.where(open_), "restricted": pages.where(~open_), "all": pages}[mode]


def standard_fqn(c: Column, prefix: str = "v8std_") -> Column:
    """The document of a standard by number, anchor, id or fqn: ``396``, ``#std396``, ``v8std_396``, ``its:...``."""
    s = F.trim(F.coalesce(c, F.lit("")))
    number = F.regexp_extract(s, r"(\d+)", 1)
    return F.when(s.startswith("its:"), s).when(F.lower(s).startswith(prefix), F.concat(F.lit("its:"), s)).when(number != "", F.concat(F.lit("its:" + prefix), number)).otherwise(F.concat(F.lit("its:"), s))


def get_standards(units: DataFrame, wanted: DataFrame, prefix: str = "v8std_") -> DataFrame:
    """(q, fqn, title, text): the documents that names of standards (q) mean, by their last version."""
    u = latest(units.where("source = 'its'")).select(F.concat(F.lit("its:"), "external_id").alias("fqn"), "title", "text")
    return wanted.select("q").distinct().withColumn("fqn", standard_fqn(F.col("q"), prefix)).join(u, "fqn").select("q", "fqn", "title", "text")
