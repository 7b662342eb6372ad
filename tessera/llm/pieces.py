"""Problem 2: items over a size limit, cut at natural boundaries with an overlap.

Method: byte-range processing. A text is handled in ranges of ``RANGE`` characters with halos on both
sides. A worker that has one range finds the boundaries in it (headings, blank lines and code fences,
lines, words), moves the range's two ends to the best boundary in the halo, as its neighbours do, counts
the characters that are no white space, and cuts. Counts per range are stitched by a prefix sum, which
numbers the pieces and tells whether the item is over the limit at all; pieces are given by offset. A text of a
table is one value and is read whole by whoever reads its row, but its ranges are then spread over the workers.
``pieces_of_files`` works on files on a shared file system, of which only each range's bytes are read.

White space is as in Unicode. A leading byte order mark is not text. Routines are the lines start_line to
end_line of their file's content, to its end where end_line is null.

Defined results: null texts, null start_line, a missing file or null content give no item; blank or
empty texts give no piece; a repeated id counts once; a word longer than the limit is cut inside.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.util import in_blocks, settle

LIMIT, OVERLAP = 1200, 120
RANGE, HALO = 65_536, 8_192
#: Routines of one file that are cut together.
BLOCK = 512

# Unicode's White_Space.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
IS_WHITE = np.zeros(0x3001, dtype=bool)
IS_WHITE[WHITE] = True

HEAD_LINE = re.compile(r"^(?:#{1,6}[ \t]+\S|={1,6}[ \t]+\S|#[ \t]*(?:область|region)\b|(?:процедура|функция|procedure|function)[ \t])", re.I | re.M)
FENCE_LINE = re.compile(r"^[ \t]*(?:```|~~~)", re.M)
BLANK_LINE = re.compile(r"^[^\S\n]*\n", re.M)
#: Classes of boundaries, the best first: headings, code blocks and paragraphs, lines, words.
N_CLASSES = 4


def white(text: str) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return IS_WHITE[np.minimum(cp, 0x3000)] & (cp <= 0x3000)


def boundaries(text: str, blank: np.ndarray) -> list[np.ndarray]:
    """Places where a piece may begin, by class."""
    line = np.array([m.end() for m in re.finditer("\n", text)], dtype=np.int64)
    head = np.array([m.start() for m in HEAD_LINE.finditer(text)], dtype=np.int64)
    fence = np.array([m.start() for m in FENCE_LINE.finditer(text)], dtype=np.int64)
    after = np.array([m.end() for m in BLANK_LINE.finditer(text)], dtype=np.int64)
    word = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    return [head, np.union1d(fence, after), line, word]


def natural(text: str, at: int, halo: int) -> int:
    """The end of a range near ``at``: the first boundary of the best class in the halo, else ``at``."""
    if at <= 0 or at >= len(text):
        return max(0, min(at, len(text)))
    part = text[at : at + halo]
    for places in boundaries(part, white(part)):
        places = places[places > 0]
        if len(places):
            return at + int(places[0])
    return at


def cut(text: str, lo: int, hi: int, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(overlap's start, start, end, characters that are no white space, with the overlap) of the pieces
    of text[lo:hi]; text before ``lo`` is what the first piece repeats from."""
    blank = white(text)
    count = np.concatenate([[0], np.cumsum(~blank)])
    by_class = boundaries(text, blank)
    word = by_class[-1]
    out, at = [], lo
    while at < hi:
        back = at
        if at > 0 and overlap:
            back = int(np.searchsorted(count, count[at] - overlap, side="left"))
            k = np.searchsorted(word, back, side="left")
            starts = word[k : k + 1]
            if back > 0:
                back = int(starts[0]) if len(starts) and starts[0] <= at else at
        room = limit - (count[at] - count[back])
        far = int(np.searchsorted(count, count[at] + room, side="right")) - 1
        if far >= hi:
            end = hi
        else:
            least = int(np.searchsorted(count, count[at] + room // 3, side="left"))
            end = far
            for places in by_class:
                i = np.searchsorted(places, far, side="right") - 1
                if i >= 0 and places[i] > max(at, least):
                    end = int(places[i])
                    break
        if count[end] > count[at]:
            out.append((back, at, end, int(count[end] - count[back])))
        elif out:
            out[-1] = (*out[-1][:2], end, out[-1][3])
        else:  # nothing but white space, as a range of a longer text may be
            out.append((at, at, end, 0))
        at = end
    return out


def _whole(kind, ident, text: str, limit: int, overlap: int, with_text: bool):
    """The row of ``RANGES`` for a text of one range."""
    n = len(text)
    solid = n - int(white(text).sum()) if n else 0
    got = cut(text, 0, n, limit, overlap) if solid > limit else [(0, 0, n, solid)] if solid else []
    return kind, ident, 0, solid, [(*c, text[c[0] : c[2]] if with_text else None) for c in got]


def _slices(kind, ident, text: str):
    """Rows of ``SLICES`` for a longer text: each range with its halos, to be cut by whatever worker."""
    n = len(text)
    for k in range((n - 1) // RANGE + 1):
        base = max(0, k * RANGE - HALO)
        yield kind, ident, k, base, k * RANGE - base, (k + 1) * RANGE - base if (k + 1) * RANGE < n else None, text[base : (k + 1) * RANGE + HALO]


def _bare(text: str) -> str:
    return text[1:] if text[:1] == "﻿" else text


SLICES = "item_kind string, item_id bigint, range_no int, base bigint, lo bigint, hi bigint, part string"


def _one_slice(row: tuple, limit: int, overlap: int, with_text: bool):
    kind, ident, k, base, lo, hi, part = row
    first = natural(part, lo, HALO) if k else 0
    last = natural(part, hi, HALO) if hi is not None else len(part)
    solid = int((~white(part[first:last])).sum())
    return kind, ident, k, solid, [(base + b, base + a, base + e, c, part[b:e] if with_text else None) for b, a, e, c in cut(part, first, last, limit, overlap)]


def _cut_slices(slices: DataFrame, limit: int, overlap: int, with_text: bool) -> DataFrame:
    """``RANGES`` of slices, which are spread over the workers: a range moves its two ends as its neighbours do, so that
    nobody needs more of the text."""

    def run(batches):
        for b in batches:
            yield from _chunked((_one_slice(r, limit, overlap, with_text) for r in zip(*[b.column(c).to_pylist() for c in ("item_kind", "item_id", "range_no", "base", "lo", "hi", "part")])), 64)

    return slices.repartition("item_kind", "item_id", "range_no").mapInArrow(run, RANGES)


RANGES = "item_kind string, item_id bigint, range_no int, solid bigint, cuts array<struct<back:bigint,start:bigint,stop:bigint,n_chars:int,text:string>>"


def _batch(rows) -> pa.RecordBatch:
    piece = pa.struct([("back", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("n_chars", pa.int32()), ("text", pa.string())])
    kind, ident, no, solid, cuts = zip(*rows)
    cuts = [[dict(zip(("back", "start", "stop", "n_chars", "text"), c)) for c in x] for x in cuts]
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(ident, pa.int64()), pa.array(no, pa.int32()), pa.array(solid, pa.int64()), pa.array(cuts, pa.list_(piece))], ["item_kind", "item_id", "range_no", "solid", "cuts"])


def _chunked(rows, n: int = 256):
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= n:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _slice_batches(rows):
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    names = ["item_kind", "item_id", "range_no", "base", "lo", "hi", "part"]
    for r in rows:  # a slice is as large as a batch should be
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(r, kinds)], names)


def unit_ranges(doc_units: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = False) -> DataFrame:
    units = doc_units.where("unit_id is not null and text is not null").select(F.col("unit_id").alias("item_id"), "text")

    def short(batches):
        for b in batches:
            yield from _chunked(_whole("doc_unit", i, _bare(t.as_py()), limit, overlap, with_text) for i, t in zip(b.column("item_id").to_pylist(), b.column("text")))

    def long(batches):
        for b in batches:
            yield from _slice_batches(r for i, t in zip(b.column("item_id").to_pylist(), b.column("text")) for r in _slices("doc_unit", i, _bare(t.as_py())))

    size = F.length("text")
    return units.where(size <= RANGE).mapInArrow(short, RANGES).unionByName(_cut_slices(units.where(size > RANGE).mapInArrow(long, SLICES), limit, overlap, with_text))


def routine_ranges(routines: DataFrame, files: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = False) -> DataFrame:
    """A file's content travels once for every ``BLOCK`` routines of the file, not once for each. Only files longer than a
    range can have a routine that is; their routines' ranges are spread."""
    once = routines.where("routine_id is not null and file_id is not null and start_line is not null").groupBy("routine_id").agg(F.min(F.struct("file_id", "start_line", "end_line")).alias("at"))
    blocks = in_blocks(once.select("routine_id", "at.*"), "file_id", "routine_id", BLOCK).groupBy("file_id", "block").agg(F.collect_list(F.struct("routine_id", "start_line", "end_line")).alias("own"))
    texts_of = files.where("content is not null").select("file_id", "content")

    def texts(content, own):
        content = _bare(content)
        starts = [0, *(m.end() for m in re.finditer("\n", content))]
        for r in own:
            first, last = max(1, r["start_line"]), r["end_line"]
            if first > len(starts) or last is not None and last < first:
                continue
            yield r["routine_id"], content[starts[first - 1] : len(content) if last is None or last >= len(starts) else starts[last]]

    def short(batches):
        for b in batches:
            for content, own in zip(b.column("content"), b.column("own").to_pylist()):
                yield from _chunked(_whole("routine", i, t, limit, overlap, with_text) for i, t in texts(content.as_py(), own))

    def long(batches):
        for b in batches:
            for content, own in zip(b.column("content"), b.column("own").to_pylist()):
                yield from _slice_batches(r for i, t in texts(content.as_py(), own) for r in (_slices("routine", i, t) if t else ()))

    size = F.length("content")
    joined = lambda f: f.join(blocks, "file_id").select("content", "own")
    return joined(texts_of.where(size <= RANGE)).mapInArrow(short, RANGES).unionByName(_cut_slices(joined(texts_of.where(size > RANGE)).mapInArrow(long, SLICES), limit, overlap, with_text))


def ranges(doc_units: DataFrame, routines: DataFrame, files: DataFrame, **how) -> DataFrame:
    return unit_ranges(doc_units, **how).unionByName(routine_ranges(routines, files, **how))


def oversized(doc_units: DataFrame, routines: DataFrame, files: DataFrame, limit: int = LIMIT) -> DataFrame:
    """p2_found: (item_kind, item_id) of the items that need cutting, by the stitched counts of their ranges."""
    per_range = ranges(doc_units, routines, files, limit=limit).select("item_kind", "item_id", "range_no", "solid")
    return per_range.groupBy("item_kind", "item_id", "range_no").agg(F.min("solid").alias("solid")).groupBy("item_kind", "item_id").agg(F.sum("solid").alias("n")).where(F.col("n") > limit).select("item_kind", "item_id")


def pieces(doc_units: DataFrame, routines: DataFrame, files: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """(item_kind, item_id, piece_no, back, start, stop, n_chars, text) of the items over the limit: the
    text from ``back`` to ``stop``; what is before ``start`` repeats the piece before."""
    got = ranges(doc_units, routines, files, limit=limit, overlap=overlap, with_text=with_text).groupBy("item_kind", "item_id", "range_no").agg(F.min_by("cuts", "solid").alias("cuts"), F.min("solid").alias("solid"))
    w = Window.partitionBy("item_kind", "item_id")
    ahead = F.coalesce(F.sum(F.size("cuts")).over(w.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    got = got.withColumn("total", F.sum("solid").over(w)).withColumn("ahead", ahead).where(F.col("total") > limit)
    got = got.select("item_kind", "item_id", "ahead", F.posexplode("cuts").alias("k", "c"))
    return got.select("item_kind", "item_id", (F.col("ahead") + F.col("k") + 1).cast("int").alias("piece_no"), "c.back", "c.start", "c.stop", "c.n_chars", "c.text")


def piece_report(doc_units: DataFrame, routines: DataFrame, files: DataFrame) -> DataFrame:
    """(item_kind, n_items, n_pieces, max_chars) of the items that were cut."""
    p = pieces(doc_units, routines, files, with_text=False)
    return p.groupBy("item_kind").agg(F.countDistinct("item_id").alias("n_items"), F.count(F.lit(1)).alias("n_pieces"), F.max("n_chars").alias("max_chars"))


def file_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size) of the files below a folder, listed by Spark; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"))


def pieces_of_files(files: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = RANGE) -> DataFrame:
    """(path, piece_no, back, start, stop, n_chars, text): pieces of UTF-8 files (path, size) on a shared file system, by
    byte offset, each from ``back`` to ``stop``; a file within the limit is one piece. A worker has one range and reads its
    bytes and halos only, from any file system that Arrow knows; pieces are numbered over the ranges by a prefix
    sum of their counts."""
    todo = files.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / range_bytes).cast("int") - 1)).alias("range_no"))
    todo = todo.repartition("path", "range_no")
    fields = {"path": pa.string(), "range_no": pa.int32(), "k": pa.int32(), "back": pa.int64(), "start": pa.int64(), "stop": pa.int64(), "n_chars": pa.int32(), "text": pa.string()}

    def run(batches):
        from pyarrow import fs

        for b in batches:
            for path, size, k in zip(*[b.column(c).to_pylist() for c in ("path", "size", "range_no")]):
                base = max(0, k * range_bytes - 4 * HALO)
                system, place = fs.FileSystem.from_uri(path)
                with system.open_input_file(place) as f:
                    raw = f.read_at(min(size, (k + 1) * range_bytes + 4 * HALO) - base, base)
                skip = next((i for i, x in enumerate(raw[:4]) if x & 0xC0 != 0x80), 0) if base else 3 if raw[:3] == b"\xef\xbb\xbf" else 0
                text = raw[skip:].decode("utf-8", "ignore")
                cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
                width = np.concatenate([[0], np.cumsum(1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF))]) + base + skip
                edge = [int(np.searchsorted(width, x * range_bytes)) for x in (k, k + 1)]
                lo = natural(text, edge[0], HALO) if k else 0
                hi = natural(text, edge[1], HALO) if (k + 1) * range_bytes < size else len(text)
                got = cut(text, lo, hi, limit, overlap)
                cols = list(zip(*[(path, k, i, int(width[b_]), int(width[a]), int(width[e]), c, text[b_:e]) for i, (b_, a, e, c) in enumerate(got)])) or [[]] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, fields.values())], list(fields))

    got = settle(todo.mapInArrow(run, "path string, range_no int, k int, back bigint, start bigint, stop bigint, n_chars int, text string"))
    w = Window.partitionBy("path").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    ahead = got.groupBy("path", "range_no").agg(F.count(F.lit(1)).alias("n")).select("path", "range_no", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("ahead"))
    return got.join(ahead, ["path", "range_no"]).select("path", (F.col("ahead") + F.col("k") + 1).alias("piece_no"), "back", "start", "stop", "n_chars", "text")


def corpus_pieces(doc_units: DataFrame, folder: str) -> DataFrame:
    """(source, piece_no, start, stop, n_chars): the units' texts written as one file a source into a folder, as a corpus is
    delivered, and cut from there."""
    texts = doc_units.where("text is not null and source is not null and unit_id is not null").groupBy("unit_id").agg(F.min(F.struct("source", "text")).alias("u")).select("u.source", "u.text", "unit_id")
    texts.repartition("source").sortWithinPartitions("source", "unit_id").select("source", F.col("text").alias("value")).write.partitionBy("source").mode("overwrite").text(folder)
    p = pieces_of_files(file_sizes(doc_units.sparkSession, folder).where(F.col("path").contains("source=")))
    return p.select(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source"), F.col("piece_no").cast("bigint").alias("piece_no"), "start", "stop", "n_chars")
