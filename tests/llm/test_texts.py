"""Pieces, tokenizer, leaks, documentation pairs."""

import base64
import random
import re

import numpy as np
import pytest

from tessera.llm import docpairs, leaks, pieces, tokenize

solid = lambda t: len(re.sub(r"\s", "", t))


@pytest.mark.parametrize("seed", range(6))
def test_pieces_cover_the_text(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(pieces, "RANGE", rng.choice([500, 3000, 65_536]))
    monkeypatch.setattr(pieces, "HALO", 400)
    words = ["слово", "x" * rng.choice([3, 3000]), "\n", "\n\n", "# Заголовок\n", "```\n", "  ", " ", "\r\n"]
    text = " ".join(rng.choice(words) for _ in range(rng.choice([30, 2000])))
    rows = [pieces._whole("doc_unit", 1, text, 200, 30, True)] if len(text) <= pieces.RANGE else [pieces._one_slice(r, 200, 30, True) for r in pieces._slices("doc_unit", 1, text)]
    assert sum(solid_ for *_, solid_, _ in rows) == solid(text)
    got = [c for *_, cuts in rows for c in cuts]
    if solid(text) <= 200:
        assert len(got) <= 1
        return
    assert got[0][1] == 0 and got[-1][2] == len(text)
    for a, b in zip(got, got[1:]):
        assert a[2] == b[1] and b[0] <= b[1] and solid(text[b[0] : b[1]]) <= 30
    for back, start, stop, n, body in got:
        assert body == text[back:stop] and n == solid(body) <= 200 and stop > start


def test_oversized_items(spark):
    units = spark.createDataFrame([(1, "а" * 1200), (2, "а " * 1201), (3, None), (4, ""), (5, "﻿" + "б" * 1200), (6, " " * 200_000 + "в"), (2, "а " * 1201), (7, "г " * 200_000)], "unit_id long, text string")
    body = "﻿строка\n" + "д" * 1300 + "\nконец"
    files = spark.createDataFrame([(1, body), (2, None)], "file_id long, content string")
    r = [(1, 1, 1, 1), (2, 1, 2, None), (3, 1, 2, 2), (4, 1, 3, 9), (5, 2, 1, 2), (6, 1, None, 2), (7, 1, 50, 60), (8, 9, 1, 2), (2, 1, 2, None)]
    routines = spark.createDataFrame(r, "routine_id long, file_id long, start_line int, end_line int")
    want = {("doc_unit", 2), ("doc_unit", 7), ("routine", 2), ("routine", 3)}
    assert {tuple(x) for x in pieces.oversized(units, routines, files).collect()} == want
    got = pieces.pieces(units, routines, files).collect()
    assert {(x.item_kind, x.item_id) for x in got} == want and max(x.n_chars for x in got) <= 1200
    one = sorted((x for x in got if x.item_id == 7 and x.item_kind == "doc_unit"), key=lambda x: x.piece_no)
    assert [x.piece_no for x in one] == list(range(1, len(one) + 1)) and one[-1].stop == 400_000 and all(a.stop == b.start for a, b in zip(one, one[1:]))
    assert pieces.oversized(units.limit(0), routines.limit(0), files.limit(0)).count() == 0


def test_pieces_of_files(spark, tmp_path):
    text = "\n\n".join("Абзац номер %d, и в нём несколько слов 😀." % i for i in range(4000))
    f = tmp_path / "in" / "a.txt"
    f.parent.mkdir()
    f.write_bytes(b"\xef\xbb\xbf" + text.encode())
    (tmp_path / "in" / "b.txt").write_bytes("мало".encode())
    (tmp_path / "in" / "c.txt").write_bytes(b"")
    rows = pieces.pieces_of_files(pieces.file_sizes(spark, f"file://{tmp_path}/in"), range_bytes=40_000).orderBy("path", "piece_no").collect()
    assert [(r.piece_no, r.text) for r in rows if r.path.endswith("b.txt")] == [(1, "мало")]
    rows, raw = [r for r in rows if r.path.endswith("a.txt")], f.read_bytes()
    assert [r.piece_no for r in rows] == list(range(1, len(rows) + 1))
    assert rows[0].start == 3 and rows[-1].stop == len(raw) and all(a.stop == b.start for a, b in zip(rows, rows[1:]))
    assert all(raw[r.back : r.stop].decode() == r.text and r.n_chars == solid(r.text) <= 1200 for r in rows)
    units = spark.createDataFrame([(1, "s", text), (2, "s", "мало"), (3, None, "x"), (4, "s", None), (1, "s", text)], "unit_id long, source string, text string")
    got = pieces.corpus_pieces(units, f"file://{tmp_path}/corpus").orderBy("piece_no").collect()
    assert {r.source for r in got} == {"s"} and got[-1].stop == len((text + "\nмало\n").encode())


@pytest.fixture(scope="module")
def reference_encoder():
    tiktoken, P = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_automaton_against_the_library(reference_encoder):
    file, pattern = tokenize.default_tokenizer()
    a = tokenize.Automaton(tokenize.compiled(file), pattern)
    rng = random.Random(1)
    texts = ["", " ", "<|endoftext|>", "it's  \n\n x", "aaaaaaaaaaaaaaaaaaaaaaa", "ЁЖ😀é́ ½²Ⅷ", "\x1c \x1d\n"] + ["".join(rng.choice("abcde ЁЖфы01!'\n\t\xa0\x1c\x85_😀") for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    for t in texts:
        ids = np.frombuffer(a.encode(t), "<i4").tolist()
        assert ids == reference_encoder.encode_ordinary(t), t
        assert a.decode(ids) == t.encode()


def test_small_vocabulary_with_runs():
    ranks = {bytes([i]): i for i in range(256)} | {b"aa": 256, b"aaa": 257, b"ab": 258, b"aab": 259}
    a = tokenize.Automaton(tokenize.compile_merges(ranks), r"\S+|\s+")

    def plain(b):
        parts = [b[i : i + 1] for i in range(len(b))]
        while True:
            best = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
            if not best:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    rng = random.Random(2)
    for _ in range(3000):
        b = "".join(rng.choice("aaab") for _ in range(rng.randint(1, 12))).encode()
        assert a.word(b) == plain(b), b


def test_encode_frame(spark, reference_encoder):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Слово word", None), (4, "длинный текст " * 20_000, "x")], "doc_id long, text string, source string")
    got = {r.doc_id: r.ids for r in tokenize.encode(df).collect()}
    assert got[1] == got[2] == [] and got[3] == reference_encoder.encode_ordinary("Слово word") and got[4] == reference_encoder.encode_ordinary("длинный текст " * 20_000)
    assert tokenize.encode(df.limit(0)).count() == 0


ITEM = "Филиал Камнеград отправил 12 пакетов и СтрокаНасоса потерял ещё 25 за смену номер семь по узлу 574"


def test_leaks(spark, monkeypatch):
    items = spark.createDataFrame([(1, "s", ITEM), (2, "s", "короткий текст"), (3, "s", None), (1, "s", ITEM)], "item_id long, suite string, text string")
    w = ITEM.split()
    docs = {
        1: "до " + ITEM + " после",
        2: " ".join(w[:12]),
        3: " ".join(w[:11]),
        4: " ".join(w[2:8] + ["вставка"] + w[8:]),
        5: ITEM.upper().replace("Ё", "Е").replace("О", "O").replace("А", "A"),
        6: "<p>" + "</b> **".join(w[1:14]).replace("а", "а​") + "&nbsp;",
        7: "\n> ".join(w[3:16]),
        8: None,
        9: "",
        10: "шум " * 50_000 + ITEM + " шум" * 50_000,
        11: " ".join(w[5:17][::-1]),
        12: " ".join(w[:6]) + ' <a href="' + "x" * 320 + '"> ' + " ".join(w[6:13]),
        13: " ".join(w[:6]) + "<!-- " + "шум " * 500 + "--> " + " ".join(w[6:13]),
        14: "до <!-- " + ITEM + " --> <!-- без конца",
        15: "<!-- <b " * 3000 + ITEM,
    }
    df = spark.createDataFrame([(k, v, 0) for k, v in docs.items()], "doc_id long, text string, item_id int")
    assert {tuple(r) for r in leaks.leaks(df, items).collect()} == {(k, 1) for k in (1, 2, 5, 6, 7, 10, 12, 13, 14, 15)}
    monkeypatch.setattr(leaks, "BLOCK", 1)
    assert {tuple(r) for r in leaks.leaks(df, items).collect()} == {(k, 1) for k in (1, 2, 5, 6, 7, 10, 12, 13, 14, 15)}
    assert leaks.leaks(df, items.limit(0)).count() == 0 and leaks.leaks(df.limit(0), items).count() == 0
    assert leaks.leaked_items(df, items).collect()[0].n_leaked == 1
    close = {r.doc_id: (r.n_edits, r.n_words) for r in leaks.closest(df, items).collect()}
    assert close[4] == (1, 9) and close[3] == (1, 11) and close[1] == (0, len(w)) and 11 not in close


def test_myers_against_brute_force():
    rng = random.Random(5)
    for _ in range(500):
        p, t = [rng.choice("abc") for _ in range(rng.randint(1, 8))], [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p, 1):
            new = [i]
            for j, y in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert leaks.myers(p, t, 20) == min(row)


def test_doc_pairs(spark):
    text = "\n".join([
        "// Сервис печати уточняет строки табличной части.", "&НаСервере", "Процедура Первая(А,", "  Б) Экспорт", '  В = "КонецПроцедуры";', "КонецПроцедуры",
        "// TODO: описать всё это потом подробно", "Процедура Вторая()", "КонецПроцедуры",
        "// Далёкое описание из нескольких слов", "", "Функция Третья()", "КонецФункции",
        "// Параметры:", "//  А - Число - просроченные заявки за месяц", "Функция Четвертая(А)", "КонецФункции",
        "//Б = В.Г(Д);", "//Возврат;", "Функция Пятая()", "КонецФункции",
        "////////////", "// Найти остаток склада", "////////////", "Функция НайтиОстатокСклада()", "КонецФункции",
        "// +++ Иванов 12.01.2024 #77 правка формы", "// @skip-lint", "Функция Седьмая()", "КонецФункции",
    ])
    files = spark.createDataFrame([("t", "a.bsl", text), ("t", "b.bsl", None)], "tenant_id string, path string, content string")
    names = ["Первая", "ВТОРАЯ", "Третья", "Четвертая", "Пятая", "НайтиОстатокСклада", "Седьмая", "Нет", None]
    rows = [(i, "t", "a.bsl", n, i, 1) for i, n in enumerate(names, 1)] + [(1, "t", "a.bsl", "Первая", 1, 1), (20, "t", "b.bsl", "Первая", None, 0), (21, "t", "zz.bsl", "Первая", None, None)]
    symbols = spark.createDataFrame(rows, "id long, tenant_id string, path string, name string, start_line int, export int")
    assert {r.symbol_id for r in docpairs.found(symbols, files).collect()} == {1, 4}
    one = next(r for r in docpairs.code_pairs(symbols, files).collect() if r.symbol_id == 1)
    assert one.signature == "Процедура Первая(А,\n  Б)" and one.code.endswith('В = "КонецПроцедуры";\nКонецПроцедуры') and one.doc.startswith("Сервис")
    assert docpairs.found(symbols.limit(0), files.limit(0)).count() == 0


def test_bodies_are_balanced():
    """An end on a line with a literal, ends in literals and comments, a body without an end; braces."""
    def code(text, name):
        g = docpairs.grammar_of("x." + name)
        out = {}
        for m, _, doc, stop, t in docpairs.islands(text, g):
            sign = g.balanced(g.brackets, t, m.end(), stop, 1) or stop
            out[m["name"]] = (t[m.start("begin") : g.balanced(g.body, t, sign, stop, g.depth) or stop].rstrip(), doc)
        return out

    got = code('Процедура А(Б = ")", В = 1) // )\nБ = "x"; КонецПроцедуры\n// Описание второй\nФункция Г() Экспорт\n// КонецФункции\nД = "КонецФункции\n|КонецФункции"; Возврат 1;\nКонецФункции\nПроцедура Е()\nЖ();\n// Описание И\n&НаСервере\nПроцедура И()\nКонецПроцедуры', "BSL")
    assert got["А"][0].endswith('Б = "x"; КонецПроцедуры') and got["Г"] == ('Функция Г() Экспорт\n// КонецФункции\nД = "КонецФункции\n|КонецФункции"; Возврат 1;\nКонецФункции', [" Описание второй"])
    assert got["Е"][0].endswith("Ж();") and got["И"][1] == [" Описание И"]
    got = code('/**\n * Adds the two numbers.\n */\nexport function add(a, b = ")}") {\n  if (a) { return `}${b}`; } // }\n  return "}";\n}\n// function no() {\nasync function next() { }\n', "js")
    assert got["add"] == ('export function add(a, b = ")}") {\n  if (a) { return `}${b}`; } // }\n  return "}";\n}', ["", "Adds the two numbers.", ""]) and list(got) == ["add", "next"]
    assert docpairs.kept_words(got["add"][1], "add") == 4
