"""Help books: a container of named elements, one of which is a ZIP of HTML pages.

A container is a chain of blocks. A block begins with a 31-byte text head of three hexadecimal numbers:
length of the document, length of the block, address of the next. The directory is the document at address
16, with records of three 32-bit numbers: addresses of an element's attributes and of its data, and an end
mark. An attribute's name follows 20 bytes of times and flags, in UTF-16.
"""

from __future__ import annotations

import hashlib
import html.parser
import io
import itertools
import re
import struct
import zipfile

from pyspark.sql import DataFrame

NO_BLOCK = 0x7FFFFFFF
HEAD = re.compile(rb"\r\n([0-9a-fA-F]{8}) ([0-9a-fA-F]{8}) ([0-9a-fA-F]{8}) \r\n")
# The kind of help by what a book's file name begins with.
KINDS = {"shcntx": "context", "shlang": "language", "shquery": "query", "shclang": "client_language"}
#: Where the directory's document begins.
DIRECTORY = 16
RECORD = struct.Struct("<III")


class Damaged(ValueError):
    """A container whose blocks do not hold together."""


class Container:
    """A container's elements, by name. A block that is missing, shorter than it says or in a ring makes the element
    that needs it ``Damaged``; elements that do not need it are read all the same."""

    def __init__(self, raw: bytes):
        self.raw = memoryview(raw)

    def blocks(self, at: int):
        """(the document's length as the block states it, the block's bytes) along the chain that begins at ``at``."""
        visited: set[int] = set()
        while at != NO_BLOCK:
            head = HEAD.match(self.raw, at) if 0 <= at < len(self.raw) else None
            if head is None or at in visited:
                raise Damaged(f"no block at {at}")
            visited.add(at)
            whole, size, following = (int(g, 16) for g in head.groups())
            if head.end() + size > len(self.raw):
                raise Damaged(f"the block at {at} is cut off")
            yield whole, self.raw[head.end() : head.end() + size]
            at = following or NO_BLOCK

    def document(self, at: int) -> bytes:
        chain = list(self.blocks(at))
        length = chain[0][0]
        joined = b"".join(part for _, part in chain)
        if len(joined) < length:
            raise Damaged(f"the document at {at} has {len(joined)} of {length} bytes")
        return joined[:length]

    def names(self) -> dict[str, int]:
        """Element -> address of its data, in the directory's order, which ends with an end mark or empty record."""
        listing = self.document(DIRECTORY)
        records = [RECORD.unpack_from(listing, i) for i in range(0, len(listing) - RECORD.size + 1, RECORD.size)]
        inside = list(itertools.takewhile(lambda r: NO_BLOCK not in r[:2] and any(r[:2]), records))
        return {self.document(about)[20:].decode("utf-16-le", "replace").strip("\0 "): data for about, data, _ in inside}

    def element(self, name: str) -> bytes | None:
        at = self.names().get(name)
        return None if at is None else self.document(at)


class _Text(html.parser.HTMLParser):
    BREAKS = frozenset("p br div li tr h1 h2 h3 h4 h5 h6 table ul ol dt dd pre".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.title, self.head, self.into = [], None, None, None

    def handle_starttag(self, tag, attrs):
        if tag in self.BREAKS:
            self.parts.append("\n")
        if tag in ("title", "h1"):
            self.into = tag

    def handle_endtag(self, tag):
        if tag == self.into:
            self.into = None
        if tag in self.BREAKS:
            self.parts.append("\n")

    def handle_data(self, data):
        self.parts.append(data)
        if self.into == "h1":
            self.head = (self.head or "") + data
        elif self.into == "title":
            self.title = (self.title or "") + data


def page(markup: str) -> tuple[str, str]:
    """(title, text): the first heading or else the title; texts of scripts and styles are kept."""
    p = _Text()
    p.feed(markup)
    text = re.sub(r"\n\s*\n+", "\n", re.sub(r"[^\S\n]+", " ", "".join(p.parts))).strip()
    return " ".join((p.head or p.title or "").split()), text


def split_name(title: str) -> tuple[str, str | None]:
    """``Russian (English)`` -> both names."""
    m = re.fullmatch(r"(.+?)\s*\(([A-Za-z][\w. ]*)\)", title)
    return (m[1], m[2]) if m else (title, None)


def version_of(path: str) -> str | None:
    """A version of four numbers: a folder of that name, else the first in the path."""
    parts = [p for p in re.split(r"[/\\]", path) if re.fullmatch(r"\d+(?:\.\d+){3}", p)]
    found = re.search(r"\d+(?:\.\d+){3}", path)
    return parts[0] if parts else found[0] if found else None


def help_kind(path: str) -> str:
    """The kind by the name of a book's file; the longest beginning counts."""
    name = re.split(r"[/\\]", path)[-1].lower()
    return next((KINDS[p] for p in sorted(KINDS, key=len, reverse=True) if name.startswith(p)), "other")


PAGE = "path string, page string, version string, help_kind string, full_name string, name string, en_name string, external_id string, section_path array<string>, version_hash string, text string, error string"


def pages(books: DataFrame) -> DataFrame:
    """Pages with text of help books (path, content binary), as ``spark.read.format("binaryFile")`` gives
    them. A damaged book gives one row with ``error``, a book without pages none."""

    def run(batches):
        import pandas as pd

        names = [c.split()[0] for c in PAGE.split(", ")]
        for b in batches:
            rows = []
            for path, raw in zip(b["path"], b["content"]):
                try:
                    store = Container(bytes(raw)).element("FileStorage") if raw is not None else None
                    if store is None:
                        continue
                    version = version_of(path) or "unknown"
                    with zipfile.ZipFile(io.BytesIO(store)) as z:
                        for name in sorted(n for n in z.namelist() if n.lower().endswith((".html", ".htm"))):
                            markup = z.read(name)
                            title, text = page(markup.decode("utf-8-sig", "replace"))
                            if text:
                                ru, en = split_name(title)
                                full = ru or name
                                digest = hashlib.sha1(b"\0".join([version.encode(), name.encode(), hashlib.sha1(markup).hexdigest().encode(), b""])).hexdigest()
                                rows.append((path, name, version, help_kind(path), title, ru, en, f"{version}|{full}", [p for p in name.split("/")[:-1] if p], digest, text, None))
                except (Damaged, zipfile.BadZipFile) as e:
                    rows.append((path, None, version_of(path), help_kind(path), *[None] * 7, str(e)))
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return books.select("path", "content").mapInPandas(run, PAGE)


def validate(paths: list[str], domains: tuple[str, ...] = ("shcntx", "shlang")) -> list[tuple[str, str, str]]:
    """(path, version, kind) of the books among ``paths`` that belong to the domains, each once; an error where
    no path is given or none is a book."""
    if not paths:
        raise ValueError("a source of help needs a folder, a pattern or files")
    wanted = [p for p in dict.fromkeys(paths) if p.lower().endswith(".hbk") and re.split(r"[/\\]", p)[-1].lower().startswith(tuple(domains))]
    if not wanted:
        raise FileNotFoundError(f"no book of {', '.join(domains)} among {len(paths)} paths")
    return [(p, version_of(p) or "unknown", help_kind(p)) for p in wanted]


def catalog(books: DataFrame) -> DataFrame:
    """(version, help_kind, name, en_name, page) of all pages, without their texts."""
    return pages(books).where("error is null").select("version", "help_kind", "name", "en_name", "page")
