"""Token classes and grammars of the languages that source files are written in.

``failing(language, text)`` gives None for a valid text, else (line, truncated): the line of the
failing token, and whether the text merely ends too early.
"""

from __future__ import annotations

import functools
import re

from tessera.llm.derivatives import Language

# The keywords of the 1C language, Russian and English, by token class.
KEYWORDS = {
    "if": "если if", "then": "тогда then", "elsif": "иначеесли elsif", "else": "иначе else", "endif": "конецесли endif",
    "for": "для for", "each": "каждого each", "in": "из in", "to": "по to", "while": "пока while", "do": "цикл do", "enddo": "конеццикла enddo",
    "try": "попытка try", "except": "исключение except", "endtry": "конецпопытки endtry",
    "proc": "процедура procedure", "endproc": "конецпроцедуры endprocedure", "func": "функция function", "endfunc": "конецфункции endfunction",
    "var": "перем var", "export": "экспорт export", "val": "знач val", "return": "возврат return", "continue": "продолжить continue", "break": "прервать break",
    "goto": "перейти goto", "raise": "вызватьисключение raise", "exec": "выполнить execute", "handler": "добавитьобработчик addhandler удалитьобработчик removehandler",
    "new": "новый new", "not": "не not", "bool": "и and или or", "lit": "истина true ложь false неопределено undefined null", "async": "асинх async", "await": "ждать await",
}
WORD_CLASS = {w: k for k, ws in KEYWORDS.items() for w in ws.split()}
# Preprocessor words by token class.
DIRECTIVES = {
    "region": "область region", "endregion": "конецобласти endregion", "pif": "если if", "pelsif": "иначеесли elsif", "pelse": "иначе else", "pendif": "конецесли endif",
    "insert": "вставка insert", "endinsert": "конецвставки endinsert", "delete": "удаление delete", "enddelete": "конецудаления enddelete",
}
DIRECTIVE_CLASS = {w: k for k, ws in DIRECTIVES.items() for w in ws.split()}

NL = r"(?:\r\n?|\n)"
PART = r'[^"\r\n]*(?:""[^"\r\n]*)*'
BSL_TOKEN = re.compile(
    r"(?:\s+|//[^\r\n]*)*"
    r"("
    r"\.\s*[^\W\d]\w*"  # a member's name: any word may follow a point
    r"|[^\W\d]\w*"
    rf'|"{PART}(?:{NL}(?:[^\S\r\n]*//[^\r\n]*{NL})*[^\S\r\n]*\|{PART})*"'
    r"|\d+(?:\.\d+)?|'[^'\r\n]*'"
    r"|<>|<=|>=|[-+*/%=<>()\[\],;:?~.]"
    r"|&[ \t]*[^\W\d]\w*|\#[^\r\n]*"
    r"|\S"
    r")"
)
PUNCT = {"-": "sign", "+": "sign", "*": "op", "/": "op", "%": "op", "<>": "op", "<=": "op", ">=": "op", "<": "op", ">": "op", "=": "="} | {c: c for c in "()[],;:?~"}
CONDITION = re.compile(r"(?:[\w()]+\s+|[()]\s*)+(?:тогда|then)", re.I)


def bsl_class(tok: str) -> str:
    c = tok[0]
    if c == ".":
        return "member" if len(tok) > 1 else "bad"
    if c == '"' or c == "'":
        return "lit" if len(tok) > 1 else "bad"
    if c == "&":
        return "note" if len(tok) > 1 else "bad"
    if c == "#":
        m = re.match(r"#\s*(\w+)\s*(.*)", tok)
        kind = m and DIRECTIVE_CLASS.get(m[1].lower())
        if not kind:
            return "#bad"
        rest = re.sub(r"//.*", "", m[2]).strip()
        if kind == "region":
            ok = re.fullmatch(r"[^\W\d]\w*", rest)
        elif kind in ("pif", "pelsif"):
            ok = CONDITION.fullmatch(rest)
        else:
            ok = not rest
        return "#" + kind if ok else "#bad"
    if c.isdigit():
        return "lit"
    if c in PUNCT or tok in PUNCT:
        return PUNCT[tok]
    if c.isalpha() or c == "_":
        return WORD_CLASS.get(tok.lower(), "id")
    return "bad"


def bsl_grammar(g: Language):
    t, ref, seq, alt, star, opt = g.tok, g.ref, g.seq, g.alt, g.star, g.opt
    name = alt(t("id"), t("async"))
    expr, stmts = ref("expr"), ref("stmts")
    args = seq(t("("), opt(expr), star(seq(t(","), opt(expr))), t(")"))
    trailer = star(alt(seq(t("member"), opt(args)), seq(t("["), expr, t("]"))))
    g.rules["postfix"] = seq(name, opt(args), trailer)
    made = seq(t("new"), alt(seq(name, star(t("member")), opt(args)), args))
    g.rules["primary"] = alt(
        ref("postfix"),
        seq(t("lit"), trailer),
        seq(t("("), expr, t(")"), trailer),
        seq(t("?"), t("("), expr, t(","), expr, t(","), expr, t(")"), trailer),
        seq(made, trailer),
    )
    unary = seq(star(alt(t("not"), t("sign"), t("await"))), ref("primary"))
    g.rules["expr"] = seq(unary, star(seq(alt(t("op"), t("sign"), t("="), t("bool")), unary)))
    block = stmts
    var = seq(t("var"), name, opt(t("export")), star(seq(t(","), name, opt(t("export")))))
    simple = alt(
        seq(opt(t("await")), ref("postfix"), opt(t("="), expr)),
        seq(t("("), expr, t(")"), star(alt(seq(t("member"), opt(args)), seq(t("["), expr, t("]")))), opt(t("="), expr)),
        seq(made, trailer),
        seq(t("return"), opt(expr)),
        t("continue"),
        t("break"),
        seq(t("goto"), t("~"), name),
        seq(t("raise"), opt(expr)),
        seq(t("exec"), expr),
        seq(t("handler"), expr, t(","), expr),
        seq(t("if"), expr, t("then"), block, star(seq(t("elsif"), expr, t("then"), block)), opt(t("else"), block), t("endif")),
        seq(t("for"), alt(seq(t("each"), name, t("in"), expr), seq(name, trailer, t("="), expr, t("to"), expr)), t("do"), block, t("enddo")),
        seq(t("while"), expr, t("do"), block, t("enddo")),
        seq(t("try"), block, t("except"), block, t("endtry")),
        var,
    )
    label = seq(t("~"), name, t(":"))
    g.rules["stmts"] = seq(star(seq(star(label), opt(simple), t(";"))), star(label), opt(simple))
    note = seq(t("note"), opt(args))
    param = seq(star(note), opt(t("val")), name, opt(t("="), expr))
    head = seq(name, t("("), opt(param, star(seq(t(","), param))), t(")"), opt(t("export")))
    routine = seq(opt(t("async")), alt(seq(t("proc"), head, stmts, t("endproc")), seq(t("func"), head, stmts, t("endfunc"))))
    declared = alt(seq(star(note), routine), seq(note, star(note), var, t(";")))
    return seq(star(alt(seq(star(label), opt(simple), t(";")), declared)), star(label), opt(simple))


def pre_grammar(g: Language):
    t, seq, star = g.tok, g.seq, g.star
    inner = g.ref("pre")
    g.rules["pre"] = star(
        g.alt(
            seq(t("#region"), inner, t("#endregion")),
            seq(t("#pif"), inner, star(seq(t("#pelsif"), inner)), g.opt(t("#pelse"), inner), t("#pendif")),
            seq(t("#insert"), inner, t("#endinsert")),
            seq(t("#delete"), inner, t("#enddelete")),
        )
    )
    return inner


JSON_TOKEN = re.compile(r'[ \t\r\n]*("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?(?![\w.])|(?:true|false|null)\b|[\[\]{},:]|[^ \t\r\n])', re.ASCII)


def json_class(tok: str) -> str:
    c = tok[0]
    if c == '"':
        return "str" if len(tok) > 1 else "bad"
    if c in "[]{},:":
        return c
    return "lit" if tok in ("true", "false", "null") or c.isdigit() or c == "-" and len(tok) > 1 else "bad"


def json_grammar(g: Language):
    t, seq, alt, star, opt = g.tok, g.seq, g.alt, g.star, g.opt
    value = g.ref("value")
    pair = seq(t("str"), t(":"), value)
    g.rules["value"] = alt(t("str"), t("lit"), seq(t("["), opt(value, star(seq(t(","), value))), t("]")), seq(t("{"), opt(pair, star(seq(t(","), pair))), t("}")))
    return value


NAME = r"[A-Za-z_:\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02ff\u0370-\u037d\u037f-\u1fff\u200c\u200d\u2070-\u218f\u2c00-\u2fef\u3001-\ud7ff\uf900-\ufdcf\ufdf0-\ufffd\U00010000-\U000effff][-.\w:\u00b7\u0300-\u036f\u203f\u2040]*"
ATTR = rf"\s+{NAME}\s*=\s*(?:\"[^<\"]*\"|'[^<']*')"
QUOTED = r"(?:\"[^\"]*\"|'[^']*')"
XML_TOKEN = re.compile(
    rf"<\?xml\s(?:(?!\?>)[\s\S])*\?>|<\?{NAME}(?:\s(?:(?!\?>)[\s\S])*)?\?>|<!--(?:(?!--)[\s\S])*-->|<!\[CDATA\[(?:(?!\]\]>)[\s\S])*\]\]>"
    rf"|<!DOCTYPE\s+{NAME}(?:\s+(?:SYSTEM\s+{QUOTED}|PUBLIC\s+{QUOTED}\s+{QUOTED}))?\s*(?:\[(?:[^\[\]\"']|{QUOTED})*\]\s*)?>"
    rf"|<{NAME}(?:{ATTR})*\s*/?>|</{NAME}\s*>|[^<&]+|&(?:{NAME}|\#\d+|\#x[0-9a-fA-F]+);|[\s\S]"
)
XML_DECL = re.compile(r"<\?xml\s+version\s*=\s*(?:\"1\.\d+\"|'1\.\d+')(?:\s+encoding\s*=\s*(?:\"[A-Za-z][-\w.]*\"|'[A-Za-z][-\w.]*'))?(?:\s+standalone\s*=\s*(?:\"(?:yes|no)\"|'(?:yes|no)'))?\s*\?>")
XML_ATTR = re.compile(rf"({NAME})\s*=\s*(\"[^\"]*\"|'[^']*')")
XML_TAG = re.compile(rf"</?({NAME})")
XML_BAD_CHAR = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\ufffe\uffff]")


def _reference(tok: str) -> bool:
    if tok[1] != "#":
        return tok[1:-1] in ("amp", "lt", "gt", "quot", "apos")
    n = int(tok[3:-1], 16) if tok[2] == "x" else int(tok[2:-1])
    return n < 0x110000 and not XML_BAD_CHAR.match(chr(n))


def xml_class(tok: str):
    c = tok[0]
    if c == "&":
        return "ref" if len(tok) > 1 and _reference(tok) else "bad"
    if c != "<":
        return "ws" if not tok.strip(" \t\r\n") else "bad" if "]]>" in tok else "text"
    if len(tok) == 1:
        return "bad"
    if tok[1] == "/":
        return (">", XML_TAG.match(tok)[1])
    if tok[1] == "?":
        return ("decl" if XML_DECL.fullmatch(tok) else "bad") if re.match(r"<\?xml[\s?]", tok) else "bad" if re.match(r"<\?xml[\s?]", tok, re.I) else "misc"
    if tok[1] == "!":
        return "misc" if tok[2:4] == "--" else "cdata" if tok[2] == "[" else "doctype"
    at = XML_ATTR.findall(tok)
    if at:
        if len({a for a, _ in at}) < len(at):
            return "bad"
        for _, v in at:
            if "&" in v and ("&" in re.sub(rf"&(?:{NAME}|#\d+|#x[0-9a-fA-F]+);", "", v) or not all(_reference(r) for r in re.findall(r"&[^;]+;", v))):
                return "bad"
    return "leaf" if tok[-2] == "/" else ("<", XML_TAG.match(tok)[1])


def xml_grammar(g: Language):
    t, seq, alt, star = g.tok, g.seq, g.alt, g.star
    g.rules["content"] = star(alt(t("text"), t("ws"), t("ref"), t("cdata"), t("misc"), t("leaf"), g.ref("element")))
    g.rules["element"] = g.element(g.ref("content"), lambda c: c[0] == "<", lambda c: (">", c[1]))
    misc = star(alt(t("misc"), t("ws")))
    return seq(g.opt(t("decl")), misc, g.opt(t("doctype"), misc), alt(t("leaf"), g.ref("element")), misc)


# The language that an extension stands for.
LANGUAGES = {"bsl": "bsl", "xml": "xml", "mdo": "xml", "json": "json"}


@functools.lru_cache(maxsize=1)
def checker() -> Checker:
    """The process's parsers, with what they have memoised so far."""
    return Checker()


class Checker:
    """Parsers of all languages with their memos; one per Python worker."""

    CACHE = 400_000

    def __init__(self):
        self.code, self.pre = Language(bsl_grammar), Language(pre_grammar)
        self.json, self.xml = Language(json_grammar), Language(xml_grammar)
        self.seen: dict = {"bsl": {}, "json": {}, "xml": {}}

    def _classes(self, language: str, tokens: list, of) -> list:
        seen = self.seen[language]
        if len(seen) > self.CACHE:
            seen.clear()
        out = []
        for x in tokens:
            c = seen.get(x)
            if c is None:
                c = seen[x] = of(x)
            out.append(c)
        return out

    def failing(self, language: str, text: str) -> tuple[int, bool] | None:
        text = text[1:] if text[:1] == "\ufeff" else text
        if language == "bsl":
            return self._bsl(text)
        if language == "json":
            tokens = JSON_TOKEN.findall(text)
            at = self.json.run(self._classes("json", tokens, json_class))
            return None if at is None else self._where(JSON_TOKEN, text, at, len(tokens))
        bad = XML_BAD_CHAR.search(text)
        tokens = XML_TOKEN.findall(text)
        at = self.xml.run(self._classes("xml", tokens, xml_class))
        if at is not None:
            return self._where(XML_TOKEN, text, at, len(tokens))
        return (text.count("\n", 0, bad.start()) + 1, False) if bad else None

    def _bsl(self, text: str) -> tuple[int, bool] | None:
        tokens = BSL_TOKEN.findall(text)
        classes = self._classes("bsl", tokens, bsl_class)
        where = None
        if "#" in text:
            pre = [i for i, c in enumerate(classes) if c[0] == "#"]
            at = self.pre.run([classes[i] for i in pre])
            if at is not None:
                where = pre[at] if at < len(pre) else len(tokens)
            kept = [i for i, c in enumerate(classes) if c[0] != "#"]
            at = self.code.run([classes[i] for i in kept])
            if at is not None:
                where = min(len(tokens) if where is None else where, kept[at] if at < len(kept) else len(tokens))
        else:
            where = self.code.run(classes)
        return None if where is None else self._where(BSL_TOKEN, text, where, len(tokens))

    @staticmethod
    def _where(pattern: re.Pattern, text: str, at: int, n: int) -> tuple[int, bool]:
        if at >= n:
            return text.count("\n") + 1, True
        m = next(m for i, m in enumerate(pattern.finditer(text)) if i == at)
        return text.count("\n", 0, m.start(pattern.groups and 1)) + 1, False
