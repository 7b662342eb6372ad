"""Problem 8: evaluation texts inside documents.

Method: pigeonhole edit matching over words. A leak is a stretch of at least ``run`` successive words
of an item. A window of ``run`` words with at most ``budget`` edits, split into budget + 1 pieces, has a
piece without an edit. So the pieces of every window of every item are kept in a table; the documents'
words are looked up in it, and around each hit the window is verified with Myers' bit-parallel edit
distance, words being the symbols. ``passages`` gives what is within the budget, with its edits; p8_found
counts only those whose exact run, measured around the hit, is long enough.

Words are runs of letters and digits and equal if they read the same (``reading``): case, ё and е,
look-alike letters and invisible characters don't matter, nor do entities, tags and other marks. Tags and
comments of any length are taken out of the text; what a long one holds is searched by itself.

Defined results: null or blank texts hold no passage; items shorter than ``run`` words leak nowhere;
repeated rows give each (doc_id, item_id) once. Items are a stated query set: they are taken in blocks
of about ``BLOCK`` items, so that what a worker holds stays bounded.
"""

from __future__ import annotations

import functools
import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.util import settle

RUN = 12
BUDGET = 1
BLOCK = 20_000
KNOWN = 300_000

# Letters of other alphabets that look like a Cyrillic or Latin letter, by the letter they are read as.
LOOKALIKES = {
    "а": "aαɑ", "в": "bβ", "с": "cϲ", "е": "eεєё", "н": "hη", "і": "iιїı", "ј": "j", "к": "kκқ", "м": "mμ", "о": "oοσօ", "р": "pρ", "ѕ": "s", "т": "tτ", "у": "yυγ", "х": "xχҳ",
}
# Code points that are not seen.
INVISIBLE = [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, 0x2800, 0x3164, 0xFEFF, 0xFFA0, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), *range(0x180B, 0x180F), *range(0xE0000, 0xE0080), *range(0xE0100, 0xE01F0)]


@functools.lru_cache(maxsize=1)
def reading_table() -> dict[int, str | None]:
    """How single lower-case characters read."""
    return {ord(c): to for to, many in LOOKALIKES.items() for c in many} | dict.fromkeys(INVISIBLE)


TAG = re.compile(r"</?[A-Za-z][^<>]*>")
COMMENT = re.compile(r"<!--(.*?)-->", re.S)
#: Characters from which a tag or comment may hold a passage of its own.
LONG = 40
WORD = re.compile(r"[^\W_]+")
PLAIN = re.compile("[\u0000-~Ѐ-џ «»‐-‧‰-›№]*")


def unmarked(text: str) -> list[str]:
    """The text without entities, comments and tags, and then what was in the long ones of these."""
    if "&" in text:
        text = html.unescape(text)
    if "<" not in text:
        return [text]
    inside: list[str] = []

    def out(m):
        if len(m[0]) >= LONG:
            inside.append(m[0].strip("<!->"))
        return " "

    last = text.rfind("-->")  # no search beyond it, so that openings without an end cost nothing
    if last >= 0:
        text = COMMENT.sub(out, text[: last + 3]) + text[last + 3 :]
    text = TAG.sub(out, text)
    return [text, *(y for x in inside for y in unmarked(x))]


def reading(text: str) -> list[str]:
    """The words of a text without marks, as they read."""
    if not PLAIN.fullmatch(text):
        text = unicodedata.normalize("NFKC", text)
        text = "".join([c for c in text if not unicodedata.combining(c)]) if any(map(unicodedata.combining, text)) else text
    return WORD.findall(text.lower().translate(reading_table()))


def myers(pattern: list, text: list, budget: int) -> int:
    """The least edit distance of ``pattern`` to any stretch of ``text`` (Myers 1999, bit-parallel), or
    budget + 1 if none is within the budget."""
    m = len(pattern)
    peq: dict = {}
    for i, x in enumerate(pattern):
        peq[x] = peq.get(x, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score, best = full, 0, m, m
    for x in text:
        eq = peq.get(x, 0)
        xv = eq | mv
        xh = ((eq & pv) + pv ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        best = min(best, score)
    return best if best <= budget else budget + 1


class Pieces:
    """The pieces of all windows of a block of items, and the words in them."""

    def __init__(self, items: list[tuple[int, list[str]]], run: int, budget: int):
        self.run, self.budget = run, budget
        self.ids: dict[str, int] = {}
        self.items: dict[int, tuple] = {}
        self.known: dict[str, int] = {}
        self.table: dict[tuple, list] = {}
        self.size = run // (budget + 1)
        for item, words in items:
            if len(words) < run:
                continue
            w = tuple(self.ids.setdefault(x, len(self.ids) + 1) for x in words)
            self.items[item] = w
            for i in range(len(w) - self.size + 1):
                self.table.setdefault(w[i : i + self.size], []).append((item, i))

    def numbered(self, text: str) -> list[int]:
        """A document's words by number, 0 for words that no item has."""
        if "&" in text or "<" in text or not PLAIN.fullmatch(text):
            get, out = self.ids.get, []
            for part in unmarked(text):
                out += [0, *(get(x, 0) for x in reading(part))] if out else [get(x, 0) for x in reading(part)]
            return out
        known, out = self.known, []
        for x in WORD.findall(text):
            n = known.get(x)
            if n is None:
                if len(known) > KNOWN:
                    known.clear()
                n = known[x] = self.ids.get(x.lower().translate(reading_table()), 0)
            out.append(n)
        return out

    def search(self, text: str):
        """(item, length of the exact run, edits, its place in the document) of the piece hits that verify."""
        d = self.numbered(text)
        size, run, budget = self.size, self.run, self.budget
        n, i, hits = len(d), 0, []
        while i + size <= n:
            if not d[i + size - 1]:  # no piece spans a word that no item has
                i += size
                continue
            hit = self.table.get(tuple(d[i : i + size]))
            if hit:
                hits.extend((item, at, i) for item, at in hit)
            i += 1
        done: dict = {}
        for item, at, i in hits:
            w = self.items[item]
            if done.get((item, i - at), -1) >= i:
                continue
            for start in range(max(0, at - run + size), min(at, len(w) - run) + 1):
                lo = max(0, i - (at - start) - budget)
                window = d[lo : lo + run + 2 * budget]
                edits = myers(list(w[start : start + run]), window, budget)
                if edits <= budget:
                    left = right = 0
                    while at > left and i > left and w[at - left - 1] == d[i - left - 1]:
                        left += 1
                    while at + right < len(w) and i + right < n and w[at + right] == d[i + right]:
                        right += 1
                    done[item, i - at] = i + right - size
                    yield item, left + right, 0 if left + right >= run else edits, i - left
                    break


@functools.lru_cache(maxsize=1)
def _block(folder: str, run: int, budget: int) -> Pieces:
    """The pieces of a block of items that lies in the shared folder; the last one used is kept by the process."""
    from pyarrow import dataset, fs

    system, place = fs.FileSystem.from_uri(folder)
    t = dataset.dataset(place, filesystem=system, format="parquet").to_table(["item_id", "text"])
    rows = sorted(zip(t.column("item_id").to_pylist(), t.column("text").to_pylist()))
    return Pieces([(i, [w for part in unmarked(x) for w in reading(part)]) for i, x in rows], run, budget)


def passages(documents: DataFrame, items: DataFrame, run: int = RUN, budget: int = BUDGET) -> DataFrame:
    """(doc_id, item_id, n_words, n_edits, at_word): stretches of documents that hold a window of an item within
    the budget of edits; n_words is the longest exact run around the hit.

    The items are written to the shared folder in blocks of about ``BLOCK``, which the workers read; none of them comes to
    the driver. The documents are read once for each block, and nothing of them is shuffled."""
    rows = settle(items.where("text is not null and item_id is not null").groupBy(F.col("item_id").cast("bigint").alias("item_id")).agg(F.min("text").alias("text")))
    n = max(1, -(-rows.count() // BLOCK))
    out = None
    for k in range(n):
        block = settle(rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)) if n > 1 else rows
        files = block.inputFiles()
        folder = files[0].rsplit("/", 1)[0] if files else None

        def scan(batches, folder=folder):
            from tessera.llm.leaks import _block

            for b in batches:
                found = [(doc, *hit) for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) if text and doc is not None and folder for hit in _block(folder, run, budget).search(text)]
                cols = list(zip(*found)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "n_words", "n_edits", "at_word"])

        part = documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(scan, "doc_id bigint, item_id bigint, n_words int, n_edits int, at_word int")
        out = part if out is None else out.unionByName(part)
    return out


def closest(documents: DataFrame, items: DataFrame, run: int = RUN, budget: int = BUDGET) -> DataFrame:
    """p8_passages: (doc_id, item_id, n_edits, n_words): the least edits within the budget with which a document
    holds ``run`` words of an item in a row, and its longest exact run."""
    return passages(documents, items, run, budget).groupBy("doc_id", "item_id").agg(F.min("n_edits").alias("n_edits"), F.max("n_words").alias("n_words"))


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """p8_found: (doc_id, item_id) where the document has ``run`` or more successive words of the item."""
    return passages(documents, items, run).where(F.col("n_words") >= run).select("doc_id", "item_id").distinct()


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per suite: items, and how many of them leaked into how many documents."""
    hit = leaks(documents, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("docs"))
    suite = items.groupBy("item_id").agg(F.min("suite").alias("suite"))
    return suite.join(hit, "item_id", "left").groupBy("suite").agg(F.count(F.lit(1)).alias("n_items"), F.count("docs").alias("n_leaked"), F.sum(F.coalesce("docs", F.lit(0))).cast("bigint").alias("n_links"))
