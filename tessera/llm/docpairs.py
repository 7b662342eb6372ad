"""Problem 6: routines paired with their documentation.

Method: an island grammar. Of a source file only the islands are parsed: comment lines, annotations,
signatures with balanced brackets, and bodies up to the end that belongs to them. Everything else is
water and is skipped. ``GRAMMARS`` holds the islands of each language.

A routine's documentation is the comment lines right above its declaration, with only comment and
annotation lines and no blank line between, or a block comment in languages that have them. It counts if three or more words remain once these are set
aside: the routine's own name and its words, headings, ornaments, reminders and placeholders, tool
marks, change stamps, and code that is commented out.

Defined results: a symbol whose file is missing or has null content, or whose name is not declared there,
gives no pair; of several declarations of the name the one nearest to start_line counts (the first of
two as near); repeated symbols count once; a null start_line counts as line 1.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 3


class Islands:
    """What is parsed of one language. ``head`` has the group name and ends with the bracket that opens the
    signature; ``skip`` are literals and comments, whose insides are seen by nothing; a body ends with the first
    ``end``, or, where that is None, with the brace that closes it. ``line`` and ``note`` begin comment lines and
    annotations; ``block`` are the marks around a comment of several lines."""

    def __init__(self, suffixes: tuple, head: str, skip: str, end: str | None, line: str, note: str | None = None, block: tuple | None = None):
        self.suffixes, self.line, self.note, self.block = suffixes, line, note, block
        self.heads = re.compile(rf"(?P<skip>{skip})|^[^\S\n]*{head}", re.I | re.M | re.S)
        self.brackets = re.compile(rf"(?P<skip>{skip})|(?P<open>\()|(?P<close>\))", re.I | re.S)
        inside = rf"(?<!\w)(?P<close>{end})(?!\w)|(?P<open>(?!))" if end else r"(?P<open>\{)|(?P<close>\})"
        self.body = re.compile(rf"(?P<skip>{skip})|{inside}", re.I | re.S)
        self.depth = 1 if end else 0

    def balanced(self, tokens: re.Pattern, text: str, at: int, stop: int, depth: int) -> int | None:
        """The place after the token that closes what is open from ``at``, before ``stop``."""
        for m in tokens.finditer(text, at, stop):
            if m["open"]:
                depth += 1
            elif m["close"]:
                depth -= 1
                if depth <= 0:
                    return m.end()
        return None


# The islands by language. The words that begin and end a routine.
BSL_LITERAL = r'"(?:[^"\n]|"")*(?:\n[^\S\n]*(?://[^\n]*\n[^\S\n]*)*\|(?:[^"\n]|"")*)*"?'
GRAMMARS = {
    "bsl": Islands(
        (".bsl",),
        r"(?P<begin>(?:(?:асинх|async)\s+)?(?:процедура|функция|procedure|function)\s+)(?P<name>[^\W\d]\w*)\s*\(",
        rf"//[^\n]*|{BSL_LITERAL}|'[^'\n]*'",
        "конецпроцедуры|конецфункции|endprocedure|endfunction",
        "//",
        "&",
    ),
    "braces": Islands(
        (".js", ".ts", ".mjs"),
        r"(?P<begin>(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*)(?P<name>[A-Za-z_$][\w$]*)\s*\(",
        r'//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*"?|\'(?:[^\'\\\n]|\\.)*\'?|`(?:[^`\\]|\\.)*`?',
        None,
        "//",
        "@",
        ("/*", "*/"),
    ),
}


def grammar_of(path: str) -> Islands | None:
    return next((g for g in GRAMMARS.values() if path.lower().endswith(g.suffixes)), None)


WORD = re.compile(r"[^\W\d_]+(?:\w*[^\W\d_])?")
CAMEL = re.compile(r"[А-ЯЁA-Z]?[а-яёa-z]+|[А-ЯЁA-Z]+(?![а-яёa-z])|\d+")
# Words of headings, reminders, placeholders and marks, Russian and English.
HEADING = re.compile(
    r"(?:параметры|возвращаемое значение|возвращает|описание|назначение|пример|примеры|примечание|примечания|варианты вызова|структура|parameters|params|arguments|returns|return value|description|purpose|example|examples|notes?|see also|см\. также)\s*[:.]?",
    re.I,
)
REMINDER = re.compile(r"\W*(?:todo|fixme|xxx|hack|туду|доделать|переделать|to do)(?!\w)", re.I)
PLACEHOLDER = re.compile(
    r"\W*(?:(?:вставить|добавить|дописать|заполнить|здесь|нужно|введите|написать|нет|без|пустое|insert|add|write|no|missing|put|the|your|enter)\s+)*(?:описани[еяю]|комментари[йя]|документаци[яию]|description|comment|documentation|docs?|summary)(?:\s+(?:процедуры|функции|метода|параметра|отсутствует|here|goes|of|the|procedure|function|method|missing|нет|здесь|тут|позже|later))*\W*|n/?a|нет данных|\.\.\.",
    re.I,
)
MARK = re.compile(r"\W*(?:@[\w-]+|[\w-]*lint[\w-]*(?::[\w-]+)?|bslls[\w:-]*|no-?qa\b.*|nolint.*|sonar[\w:-]*|acc:[\w-]*|apk:[\w-]*|акк:[\w-]*|акп:[\w-]*|[\w-]+:[\w-]+-(?:off|on|disable|enable))\W*", re.I)
STAMP = re.compile(r"\s*(?:[-+*<>{}/#\[\]=~]{2,}.*\d.*|.*(?:\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}-\d{2}-\d{2}).*#?\d*|\W*(?:изменен\w*|добавлен\w*|исправлен\w*|доработ\w*|modified|changed|added|fixed|author|автор|дата|date|версия|version|задача|task|ticket)\s*(?:[:#№]|by\b|\d).*)", re.I)
CODE = re.compile(
    r"\s*(?:.*;\s*(?://.*)?|[^\W\d]\w*(?:\.\w+)*\s*=\s*\S.*|[^\W\d]\w*(?:\.\w+)*\(.*\)|(?:если|иначеесли|if|elsif)\s.*\s(?:тогда|then)|(?:для|пока|for|while)\s.*\s(?:цикл|do)|(?:иначе|else|попытка|try|исключение|except|возврат|return|прервать|break|продолжить|continue|конецесли|endif|конеццикла|enddo|конецпопытки|endtry|конецпроцедуры|конецфункции|endprocedure|endfunction)\s*;?|&\s*\w+.*|#\s*(?:область|конецобласти|если|конецесли|region|endregion|if|endif)\b.*|(?:процедура|функция|procedure|function)\s+\w+\s*\(.*|\|.*)",
    re.I,
)


def kept_words(lines: list[str], name: str) -> int:
    """Words of comment lines (without their slashes) that say something about the routine ``name``."""
    own = {name.lower(), *(w.lower() for w in CAMEL.findall(name)), "процедура", "функция", "procedure", "function"}
    own |= {p for p in name.lower().split("_") if p}
    n = 0
    for line in lines:
        s = line.strip().strip("/").strip()
        if not s or HEADING.fullmatch(s) or REMINDER.match(s) or MARK.fullmatch(s) or CODE.fullmatch(s) or PLACEHOLDER.fullmatch(s) or STAMP.fullmatch(s):
            continue
        n += sum(w.lower() not in own for w in WORD.findall(s))
    return n


def _above(text: str, at: int, grammar: Islands) -> tuple[list[str], int]:
    """The comment lines right above the line that begins at ``at``, and where they begin."""
    doc, low = [], at
    while low > 0:
        before = text.rfind("\n", 0, low - 1) + 1
        s = text[before : low - 1].strip()
        if grammar.block and s.endswith(grammar.block[1]) and (opens := text.rfind(grammar.block[0], 0, low)) >= 0:
            inner = text[opens + 2 : text.rfind(grammar.block[1], 0, low)].lstrip("*")
            doc += [x.strip().lstrip("*").strip() for x in reversed(inner.split("\n"))]
            before = text.rfind("\n", 0, opens) + 1
        elif s.startswith(grammar.line):
            doc.append(s[len(grammar.line) :])
        elif not grammar.note or not s.startswith(grammar.note):
            break
        low = before
    return doc[::-1], low


def islands(text: str, grammar: Islands):
    """(name, line, doc lines, head's place, signature's end, body's end) of each routine. A body that has no
    end of its own runs to the documentation of the next routine or the file's end."""
    text = text[1:] if text[:1] == "﻿" else text
    heads = [m for m in grammar.heads.finditer(text) if m["name"]]
    docs = [_above(text, text.rfind("\n", 0, m.start("begin")) + 1, grammar) for m in heads]
    line, seen = 1, 0
    for k, m in enumerate(heads):
        line += text.count("\n", seen, m.start("begin"))
        seen = m.start("begin")
        stop = docs[k + 1][1] if k + 1 < len(heads) else len(text)
        yield m, line, docs[k][0], stop, text


def declarations(files: DataFrame, with_code: bool = True) -> DataFrame:
    """(tenant_id, path, name_low, line, kept[, signature, doc, code]): the routines of each file."""
    schema = "tenant_id string, path string, name_low string, line int, kept int" + (", signature string, doc string, code string" if with_code else "")

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(8 if with_code else 5)]
            for tenant, path, text in zip(*[b.column(c).to_pylist() for c in ("tenant_id", "path", "content")]):
                grammar = grammar_of(path)
                for m, line, doc, stop, text_ in islands(text, grammar):
                    row = [tenant, path, m["name"].lower(), line, kept_words(doc, m["name"]) if doc else 0]
                    if with_code:
                        sign = grammar.balanced(grammar.brackets, text_, m.end(), stop, 1) or stop
                        end = grammar.balanced(grammar.body, text_, sign, stop, grammar.depth) or stop
                        row += [text_[m.start("begin") : sign], "\n".join(x.strip() for x in doc), text_[m.start("begin") : end].rstrip()]
                    for c, x in zip(cols, row):
                        c.append(x)
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
            names = ("tenant_id", "path", "name_low", "line", "kept", "signature", "doc", "code")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], list(names[: len(cols)]))

    suffixes = "|".join(x[1:] for g in GRAMMARS.values() for x in g.suffixes)
    rows = files.where(F.col("content").isNotNull() & F.col("path").rlike(rf"(?i)\.(?:{suffixes})$"))
    return rows.select("tenant_id", "path", "content").mapInArrow(run, schema)


def documented(symbols: DataFrame, files: DataFrame, with_code: bool = False) -> DataFrame:
    """Symbols whose documentation says something, with the declaration that counts for each."""
    found = declarations(files, with_code)
    s = symbols.where("id is not null and name is not null").select(F.col("id").alias("symbol_id"), "tenant_id", "path", F.lower("name").alias("name_low"), F.coalesce("start_line", F.lit(1)).alias("start_line"), (F.col("export") == 1).alias("export"))
    rest = [c for c in found.columns if c not in ("tenant_id", "path", "name_low", "line")]
    best = s.join(found, ["tenant_id", "path", "name_low"]).groupBy("symbol_id").agg(F.min(F.struct(F.abs(F.col("line") - F.col("start_line")).alias("off"), "line", *rest, "export")).alias("d"))
    return best.where(F.col("d.kept") >= LEAST_WORDS).select("symbol_id", "d.line", "d.export", *[f"d.{c}" for c in rest])


def found(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """p6_found: the ids of the symbols with documentation that says something."""
    return documented(symbols, files).select("symbol_id")


def code_pairs(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(symbol_id, export, signature, doc, code): the pairs for training."""
    return documented(symbols, files, True).select("symbol_id", "export", "signature", "doc", "code")
