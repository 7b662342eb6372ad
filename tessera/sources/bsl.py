"""Modules of 1C code -> routines and their calls (C01 to C03), in one Arrow pass per file.

The scan is by islands: literals (which go on in lines that begin with ``|``, comment lines between) and
comments are consumed whole, so that nothing inside them is seen; then regions, annotations, declarations,
ends and calls are read in order. An unclosed literal ends with its line. Defined results: null content
gives no row; a routine without its end runs to the line before the next one or the file's end and is
marked ``unterminated``; names keep their case.
"""

from __future__ import annotations

import bisect
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words that take a bracket but are no calls, Russian and English.
NOT_CALLED = frozenset(
    "если if иначеесли elsif пока while для for каждого each из in по to цикл do и and или or не not возврат return новый new тогда then иначе else попытка try исключение except вызватьисключение raise выполнить execute экспорт export знач val перем var прервать break продолжить continue перейти goto процедура procedure функция function ждать await асинх async".split()
)
# Annotations by which a routine overrides another, by what is recorded.
OVERRIDES = {"вместо": "Вместо", "перед": "Перед", "после": "После", "изменениеиконтроль": "ИзменениеИКонтроль", "around": "Вместо", "instead": "Вместо", "before": "Перед", "after": "После", "changeandvalidate": "ИзменениеИКонтроль"}
LITERAL = r'"(?:[^"\n]|"")*(?:\n[^\S\n]*(?://[^\n]*\n[^\S\n]*)*\|(?:[^"\n]|"")*)*"?'
ISLAND = re.compile(
    rf"""(?P<skip>//[^\n]*|{LITERAL}|'[^'\n]*')
    |\#[^\S\n]*(?:область|region)[^\S\n]+(?P<region>\w+)|(?P<endregion>\#[^\S\n]*(?:конецобласти|endregion)(?!\w))
    |&[^\S\n]*(?P<note>\w+)(?:\s*\(\s*"(?P<target>[^"\n]*)"\s*\))?
    |(?<!\w)(?P<kind>процедура|функция|procedure|function)\s+(?P<name>[^\W\d]\w*)\s*(?=\()
    |(?<!\w)(?P<end>конецпроцедуры|конецфункции|endprocedure|endfunction)(?!\w)
    |(?:(?P<qualifier>(?<![\w.])[^\W\d]\w*|(?<=\.)[^\W\d]\w*)[^\S\n]*\.[^\S\n]*)?(?<!\w)(?P<method>[^\W\d]\w*)[^\S\n]*(?=\()""",
    re.I | re.X,
)
SIGNATURE = re.compile(rf"{LITERAL}|//[^\n]*|[()]|(?P<head>^[^\S\n]*(?:процедура|функция|procedure|function)\s+[^\W\d]\w*\s*\()", re.I | re.M)
EXPORT = re.compile(r"\s*(?:экспорт|export)(?!\w)", re.I)
ROUTINE = "name string, kind string, export boolean, start_line int, end_line int, region string, directive string, override_mode string, override_target string, unterminated boolean, calls array<struct<qualifier:string,method:string,line:int>>"


def _signature_end(text: str, at: int) -> int:
    """The place after the bracket that closes the signature, or the next routine's head or the file's end."""
    depth = 0
    for m in SIGNATURE.finditer(text, at):
        if m["head"]:
            return m.start()
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        if not depth and m[0] == ")":
            return m.end()
    return len(text)


def parse_module(text: str) -> list[dict]:
    """The routines of a module, with the calls inside each."""
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    breaks = [m.start() for m in re.finditer("\n", text)]
    line_of = lambda at: bisect.bisect_left(breaks, at) + 1
    out: list[dict] = []
    regions: list[str] = []
    notes: list[tuple[str, str | None]] = []
    now, inside = None, 0
    for m in ISLAND.finditer(text):
        if m["skip"] is not None:
            continue
        if m["region"]:
            regions.append(m["region"])
        elif m["endregion"]:
            if regions:
                regions.pop()
        elif m["note"]:
            if not now or m.start() > inside:
                notes.append((m["note"], m["target"]))
        elif m["kind"]:
            line = line_of(m.start("kind"))
            if now:
                now.update(end_line=line - 1, unterminated=True)
            inside = _signature_end(text, m.end())
            over = next(((OVERRIDES[n.lower()], t) for n, t in notes if n.lower() in OVERRIDES), (None, None))
            now = {
                "name": m["name"], "kind": "Function" if m["kind"].lower() in ("функция", "function") else "Procedure", "export": bool(EXPORT.match(text, inside)), "start_line": line, "end_line": None, "region": regions[-1] if regions else None,
                "directive": next((n for n, _ in notes if n.lower() not in OVERRIDES), None), "override_mode": over[0], "override_target": over[1], "unterminated": False, "calls": [],
            }
            out.append(now)
            notes = []
        elif m["end"]:
            if now:
                now["end_line"] = line_of(m.start())
            now, notes = None, []
        elif m["method"] and now and m.start() >= inside:
            word, owner = m["method"], m["qualifier"]
            if word.lower() in NOT_CALLED and not owner and text[m.start() - 1 : m.start()] != ".":
                continue
            if owner is None and re.search(r"(?<!\w)(?:новый|new)\s+$", text[max(0, m.start() - 12) : m.start()], re.I):
                continue
            now["calls"].append({"qualifier": None if owner and owner.lower() in NOT_CALLED else owner, "method": word, "line": line_of(m.start("method"))})
    if now:
        now.update(end_line=len(breaks) + 1, unterminated=True)
    return out


def routines(files: DataFrame) -> DataFrame:
    """(file_id, tenant_id, path, routine fields..., calls) of all modules."""

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [{"file_id": i, "tenant_id": t, "path": p, **r} for i, t, p, c in zip(b["file_id"], b["tenant_id"], b["path"], b["content"]) if c is not None for r in parse_module(c)]
            yield pd.DataFrame(rows, columns=["file_id", "tenant_id", "path", *[x.split()[0] for x in ROUTINE.split(", ")]])

    f = files.where(F.col("content").isNotNull() & F.lower("path").endswith(".bsl")).select("file_id", "tenant_id", "path", "content")
    return f.mapInPandas(run, f"file_id bigint, tenant_id string, path string, {ROUTINE}")


def calls(parsed: DataFrame) -> DataFrame:
    """A row for each call of ``routines``."""
    return parsed.select("file_id", "tenant_id", "path", F.col("name").alias("caller"), F.explode("calls").alias("c")).select("file_id", "tenant_id", "path", "caller", "c.qualifier", "c.method", "c.line")
