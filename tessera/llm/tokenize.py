"""Problem 7: encoding of the whole corpus with a public byte-level BPE tokenizer.

Method: tokenization automaton. Its states are the last token emitted, its arcs carry tokens; at first
every byte may follow every byte. The merges are compiled into it one after another, in order of rank. The
gadget of merge (x, y) takes the arc of y out of x's state, and gives the automaton the new token: its
state begins as a copy of y's state, and its arcs begin where those of x are at that time. A copy is kept as a
default: the state's tables hold the rank at which it was made and the half that it was copied from, and an
arc that a state does not settle is looked up there. So the automaton is compiled with one entry a merge
(``compile_merges``, on the driver; as large as the vocabulary) and is deterministic: every prefix of a word has
exactly one path. A word is encoded from left to right, each place holding the only token that can end
there, by table look-ups; resolved arcs and words are kept, and a word's ids are joined as bytes.

Decoding emits the arcs' labels, that is, each token's bytes.

Defined results: null and empty texts give an empty list; blanks are encoded like any text; special
tokens' strings are ordinary text; lone surrogates are replaced by U+FFFD, as in UTF-8 files.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 300_000
ARCS = 2_000_000
#: Bytes ahead by which the arcs from a position are kept, if they end within.
NEAR = 8
#: The rank at which an arc is removed that no gadget removes.
NEVER = 1 << 62
#: White space that the two regular-expression modules see differently, and runs between white space.
ODD_SPACE = re.compile("[\x1c-\x1f]")
UNIT = re.compile(r" ?\S+|\s+(?!\S)|\s+")


def compile_merges(ranks: dict[bytes, int]) -> dict[int, tuple[bytes, int, int]]:
    """token -> (its bytes, left half, right half) in order of rank; single bytes have no halves (-1). The
    halves are what the merges before its own leave of its bytes; a token that they do not bring to two is
    made by no merge, has no gadget and no arc."""
    out = {i: (b, -1, -1) for b, i in ranks.items() if len(b) == 1}
    for b, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(b) == 1:
            continue
        parts = [b[i : i + 1] for i in range(len(b))]
        while len(parts) > 2:
            due = [(ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1)]
            first, i = min(due)
            if first >= rank:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2 and all(p in ranks for p in parts):
            out[rank] = (b, ranks[parts[0]], ranks[parts[1]])
    return out


class Automaton:
    """The compiled automaton with its look-up tables. ``tokens`` is what ``compile_merges`` gives."""

    def __init__(self, tokens: dict[int, tuple[bytes, int, int]], pattern: str):
        import regex

        self.pattern = regex.compile(pattern)
        self.size = max(tokens) + 1
        self.label = {t: b for t, (b, _, _) in tokens.items()}
        self.ids = {b: t for t, b in self.label.items()}
        self.table: dict[bytes, int] = {b[:i]: -1 for b in self.ids for i in range(1, len(b))} | self.ids
        self.halves = {t: (x, y) for t, (_, x, y) in tokens.items() if x >= 0}
        #: The gadgets: state and arc, by number, to the rank that removes the arc.
        self.gadgets = {x * self.size + y: t for t, (x, y) in self.halves.items()}
        self.removed: dict[int, int] = {}
        self.words: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}
        self.near: dict[bytes, tuple] = {}

    def removed_at(self, u: int, v: int) -> int:
        """The rank whose gadget takes the arc of v out of the state of u, or NEVER. The younger of the two
        tokens began as a copy: u's state of its right half's, v's arcs of its left half's, as they were then.
        Of equal merges in a row the left one goes first, so an arc is copied to u's state before its own merge
        removes it there, and to v's arcs after."""
        key = u * self.size + v
        got = self.removed.get(key)
        if got is None:
            born_u, born_v = u if u in self.halves else -1, v if v in self.halves else -1
            got = NEVER
            if born_u >= 0 and born_u >= born_v:
                before = self.removed_at(self.halves[u][1], v)
                got = before if before < born_u else NEVER
            elif born_v >= 0:
                before = self.removed_at(u, self.halves[v][0])
                got = before if before <= born_v else NEVER
            if got == NEVER:
                got = self.gadgets.get(key, NEVER)
            if len(self.removed) > ARCS:
                self.removed.clear()
            self.removed[key] = got
        return got

    def word(self, b: bytes) -> list[int]:
        """The ids of one pre-split word: for each place the only token that can end there and where it begins."""
        n, size, near, removed = len(b), self.size, self.near, self.removed
        last, begin = [-1] * (n + 1), [0] * (n + 1)
        for at in range(n):
            u = last[at]
            if at and u < 0:
                continue
            window = b[at : at + NEAR]
            for t, length in near.get(window) or self._arcs_from(b, at, window):
                end = at + length
                if last[end] < 0 and (not at or (removed.get(u * size + t) or self.removed_at(u, t)) == NEVER):
                    last[end], begin[end] = t, at
        out, at = [], n
        while at:
            out.append(last[at])
            at = begin[at]
        return out[::-1]

    def _arcs_from(self, b: bytes, at: int, window: bytes) -> tuple:
        """(token, length) of the tokens that begin at a position, longest first."""
        find, found, end, n = self.table.get, [], at + 1, len(b)
        while end <= n and (t := find(b[at:end])) is not None:
            if t >= 0:
                found.append((t, end - at))
            end += 1
        out = tuple(reversed(found))
        if end <= at + len(window) or at + len(window) == n and len(window) < NEAR:
            if len(self.near) > WORDS:
                self.near.clear()
            self.near[window] = out
        return out

    def _unit(self, unit: str) -> bytes:
        words, out = self.words, []
        for w in self.pattern.findall(unit):
            got = words.get(w)
            if got is None:
                if len(words) > WORDS:
                    words.clear()
                got = np.array(self.word(w.encode("utf-8", "replace")), dtype="<i4").tobytes()
                if len(w) < 200:
                    words[w] = got
            out.append(got)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers. Runs without white space are looked up
        whole: with the space before them they hold whole words of the pattern."""
        if ODD_SPACE.search(text):
            return self._unit(text)
        units, out = self.units, []
        for u in UNIT.findall(text):
            got = units.get(u)
            if got is None:
                got = self._unit(u)
                if len(u) < 60:
                    if len(units) > WORDS:
                        units.clear()
                    units[u] = got
            out.append(got)
        return b"".join(out)

    def decode(self, ids) -> bytes:
        return b"".join([self.label[i] for i in ids])


@functools.lru_cache(maxsize=2)
def compiled(ranks_file: str) -> dict[int, tuple[bytes, int, int]]:
    """The merges of a file of base64 byte strings and ranks, read and compiled by the driver."""
    with open(ranks_file, "rb") as f:
        return compile_merges({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


_HELD: list = [None, None]


def _automaton(tokens: dict, pattern: str) -> Automaton:
    """The automaton of a broadcast, kept with its tables by the worker process."""
    if _HELD[0] is not tokens or _HELD[1].pattern.pattern != pattern:
        _HELD[:] = tokens, Automaton(tokens, pattern)
    return _HELD[1]


def default_tokenizer(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """(file, pattern) of an installed public tokenizer."""
    import public_tokenizers as P

    return P.path(name), P.PATTERN


def encode(documents: DataFrame, ranks_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """p7_ids: doc_id and ids of each document's text. One pass, no shuffle; rows stay as they are."""
    if ranks_file is None:
        ranks_file, pattern = default_tokenizer()

    # As large as the vocabulary.
    shipped = documents.sparkSession.sparkContext.broadcast(compiled(ranks_file))

    def run(batches):
        from tessera.llm.tokenize import _automaton

        automaton = _automaton(shipped.value, pattern)
        for b in batches:
            blobs = [b"" if t is None else automaton.encode(t) for t in b.column("text").to_pylist()]
            offsets = np.zeros(len(blobs) + 1, dtype=np.int32)
            np.cumsum([len(x) // 4 for x in blobs], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(blobs), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids], ["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def counts(documents: DataFrame, **tokenizer) -> DataFrame:
    """Documents and tokens per source, for budgets of training data."""
    n = encode(documents, **tokenizer).select("doc_id", F.size("ids").cast("bigint").alias("n"))
    return documents.select("doc_id", "source").join(n, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_tokens"))
