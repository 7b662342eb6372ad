"""Sources that are listed on the driver: configuration trees, git diffs, manifests, document folders.

Only listings, which are small beside the contents, are made here; contents are read by Spark.
"""

from __future__ import annotations

import json
import os
import re
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.text import markdown_sections, sha1_text

DUMP, PROJECT = "Configuration.xml", os.path.join("src", "Configuration", "Configuration.mdo")


def _format_at(folder: str) -> str | None:
    return "dump" if os.path.isfile(os.path.join(folder, DUMP)) else "project" if os.path.isfile(os.path.join(folder, PROJECT)) else None


def detect_format(root: str) -> str:
    """``dump`` or ``project`` by the marker file, at the root first, then below it; the dump's marker
    goes first."""
    folders = [root, *sorted(e.path for e in os.scandir(root) if e.is_dir())]
    kinds = [k for k in (_format_at(f) for f in folders) if k]
    here = _format_at(root)
    if here or kinds:
        return here or min(kinds)
    raise FileNotFoundError(f"no configuration under {root}")


def discover_parts(root: str) -> list[tuple[str, str]]:
    """(config_id, folder) of the base and its extensions, the base first, then by name. An extension
    is a part whose marker states its purpose."""
    parts = []
    for folder in [root, *sorted(e.path for e in os.scandir(root) if e.is_dir())]:
        kind = _format_at(folder)
        if not kind:
            continue
        with open(os.path.join(folder, DUMP if kind == "dump" else PROJECT), encoding="utf-8-sig", errors="replace") as f:
            text = f.read()
        name = re.search(r"<name>\s*([^<\s]+)", text, re.I)
        extension = re.search(r"<configurationExtensionPurpose>\s*\w", text, re.I)
        parts.append((f"ext:{name[1] if name else os.path.basename(folder)}" if extension else "base", folder))
    return sorted(parts, key=lambda p: (p[0] != "base", p[0]))


def find_parts(spark: SparkSession, root: str) -> list[tuple[str, str, str]]:
    """S01 to S03 on any file system: (folder, config_id, format) of the parts at or below ``root``, the base first in
    each folder, then by name. Spark lists and reads the markers, which are as many as there are parts; where a folder has
    both, the dump's counts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "Configuration.{xml,mdo}").load(root)
    text = F.decode("content", "UTF-8")
    project = F.col("path").endswith("/src/Configuration/Configuration.mdo")
    name, purpose = F.regexp_extract(text, r"(?i)<name>\s*([^<\s]+)", 1), F.regexp_extract(text, r"(?i)<configurationExtensionPurpose>\s*(\w)", 1)
    folder = F.regexp_replace("path", r"/(?:src/Configuration/Configuration\.mdo|Configuration\.xml)$", "")
    rows = files.where(project | F.col("path").endswith("/Configuration.xml")).select(folder.alias("folder"), F.when(purpose != "", F.concat(F.lit("ext:"), name)).otherwise("base").alias("config_id"), F.when(project, "project").otherwise("dump").alias("format"))
    best = rows.groupBy("folder").agg(F.min(F.struct("format", "config_id")).alias("b")).select("folder", "b.config_id", "b.format").collect()
    return sorted(((r.folder, r.config_id, r.format) for r in best), key=lambda p: (p[0].rsplit("/", 1)[0], p[1] != "base", p[1]))


def dump_versions(files: DataFrame) -> DataFrame:
    """(path, fqn, version): the versions of top-level objects that ``ConfigDumpInfo.xml`` files (path, content) state."""
    import xml.etree.ElementTree as ET

    from tessera.sources.metadata_xml import parse_dump_info

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    rows += [(path, k, v) for k, v in parse_dump_info(ET.fromstring(content.removeprefix("\ufeff").encode())).items()] if content else []
                except ET.ParseError:
                    continue
            yield pd.DataFrame(rows, columns=["path", "fqn", "version"])

    return files.where(F.col("path").endswith("ConfigDumpInfo.xml")).select("path", "content").mapInPandas(run, "path string, fqn string, version string")


def read_tree(spark: SparkSession, parts: list[tuple[str, str]], suffixes: tuple[str, ...] = (".bsl", ".xml", ".mdo", ".form")) -> DataFrame:
    """(config_id, root, path, mtime, size, content) of the files of the parts (config_id, folder). Spark lists
    and reads all parts in one scan; the path is relative to its part, the longest folder that a file lies in; bytes that
    are no UTF-8 are replaced."""
    roots = [(c, (f if re.match(r"[a-z0-9]+:", f) else "file:" + os.path.abspath(f)).rstrip("/")) for c, f in parts]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*{" + ",".join(suffixes) + "}").load([f for _, f in roots])
    plain = lambda c: F.regexp_replace(c, r"^(\w+):/+", "$1:/")  # noqa: E731  file:///x and file:/x are one place
    known = spark.createDataFrame(roots, "config_id string, root string").select(F.struct((-F.length(plain(F.col("root")))).alias("n"), "config_id", F.concat(plain(F.col("root")), F.lit("/")).alias("at"), "root").alias("r"))
    known = known.agg(F.array_sort(F.collect_list("r")).alias("roots"))  # one row, the longest first
    f = files.crossJoin(F.broadcast(known)).withColumn("here", plain(F.col("path")))
    f = f.withColumn("r", F.get(F.filter("roots", lambda r: F.col("here").startswith(r["at"])), 0))
    return f.select("r.config_id", "r.root", F.expr("substring(here, length(r.at) + 1)").alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("content"))


HUNK = re.compile(r"@@ -\S+ \+(\d+)(?:,(\d+))? @@")


def parse_diff(text: str) -> list[tuple[str, int, int]]:
    """(path, first, last) of changed lines in a diff without context; a deletion counts at its line."""
    out, path = [], None
    for line in text.splitlines():
        if line.startswith("+++ "):
            path = None if line[4:].strip() == "/dev/null" else re.sub(r"^b/", "", line[4:].strip().strip('"'))
        elif path and (m := HUNK.match(line)):
            first, n = int(m[1]), int(m[2] or 1)
            out.append((path, first, first + max(n, 1) - 1))
    return out


def git_hunks(spark: SparkSession, root: str, ref: str = "HEAD") -> DataFrame:
    """Changed lines since ``ref`` and files that are not tracked (lo null: the whole file), by one
    diff for the whole tree."""
    run = lambda *a: subprocess.run(["git", "-C", root, "-c", "core.quotepath=off", *a], capture_output=True, text=True, check=True).stdout
    rows = [(p, a, b) for p, a, b in parse_diff(run("diff", "-U0", ref))] + [(p, None, None) for p in run("ls-files", "--others", "--exclude-standard").splitlines()]
    return spark.createDataFrame(rows, "path string, lo int, hi int")


def load_manifest(path: str) -> list[dict]:
    """Entries of a JSON manifest, each with a known type."""
    with open(path, encoding="utf-8-sig") as f:
        entries = json.load(f)
    entries = entries["sources"] if isinstance(entries, dict) else entries
    for e in entries:
        if e.get("type") not in ("its", "git", "hbk", "wiki"):
            raise ValueError(f"unknown type of source: {e.get('type')}")
    return entries


UNIT = "id string, title string, section_path array<string>, text string, version_hash string, related_fqns array<string>, source_url string, lang string, doc_topic string, corpus_version string"


def its_units(files: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Document units of JSON files (path, content): an object or a list of objects each. Units without text and files
    that are no JSON are left out; a missing id is the first 16 letters of the hash of address and text, a missing
    version the hash of the text; a record's topic and corpus version beat the source's."""
    d = defaults or {}
    body = F.regexp_replace("content", "^\ufeff", "")
    many = f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in UNIT.split(', '))}>>"
    rows = files.select(F.explode(F.when(F.ltrim(body).startswith("["), F.from_json(body, many)).otherwise(F.array(F.from_json(body, UNIT)))).alias("u")).select("u.*")
    text = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    rows = rows.withColumn("text", text).where("text <> ''")
    own = F.coalesce("id", F.substring(sha1_text(F.coalesce("source_url", F.lit("")), F.col("text")), 1, 16))
    topic, version = F.coalesce("doc_topic", F.lit(d.get("doc_topic") or "config")), F.coalesce("corpus_version", F.lit(d.get("corpus_version")))
    return rows.select(own.alias("external_id"), F.coalesce("title", own).alias("title"), F.coalesce("section_path", F.array().cast("array<string>")).alias("section_path"), "text", F.coalesce("version_hash", sha1_text(F.col("text"))).alias("version_hash"), F.coalesce("related_fqns", F.array().cast("array<string>")).alias("links"), "source_url", "lang", topic.alias("doc_topic"), version.alias("corpus_version"))


def artifact_units(files: DataFrame) -> DataFrame:
    """A unit for each section of Markdown files (path, content) that has text, called ``path#n``; titled by its
    heading, or by the file's name before the first."""
    s = markdown_sections(files.select(F.col("path").alias("file"), "content"), "file", "content").where("body <> ''")
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    return s.select(F.concat_ws("#", "file", "nth").alias("external_id"), F.when(F.col("title") != "", F.col("title")).otherwise(name).alias("title"), "file", F.col("path").alias("section_path"), F.col("body").alias("text"), sha1_text(F.col("body")).alias("version_hash"))


def crawl(listing: DataFrame, stored: DataFrame, read_page) -> DataFrame:
    """Pages to read: those whose time differs from the stored one. ``read_page(id)`` gives (status, text);
    404 means the page is gone, any other failure ends the job, since a page not read is not a page deleted."""
    changed = listing.join(stored.select("id", F.col("modified").alias("was")), "id", "left").where("was is null or was <> modified").select("id", "modified")

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for i, m in zip(b["id"], b["modified"]):
                status, text = read_page(i)
                if status not in (200, 404):
                    raise RuntimeError(f"page {i} not read: {status}")
                rows.append((i, m, text if status == 200 else None, status == 404))
            yield pd.DataFrame(rows, columns=["id", "modified", "text", "gone"])

    return changed.mapInPandas(run, "id string, modified timestamp, text string, gone boolean")
