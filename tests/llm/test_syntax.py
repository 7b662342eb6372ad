"""Parsing with derivatives against the standard parsers and against facts of the 1C language."""

import json
import random
import xml.parsers.expat as expat

import pytest

from tessera.llm import syntax
from tessera.llm.grammars import Checker, checker

GOOD = [
    "",
    "// только примечание",
    "﻿Перем А Экспорт, Б;\r\nА = 1",
    '#Область Х\nПроцедура А(Знач Б, В = "") Экспорт\n  Если Б Тогда Возврат; КонецЕсли\nКонецПроцедуры\n#КонецОбласти',
    '&НаКлиенте\n&Вместо("Х")\nАсинх Функция Ф()\n Возврат ?(А > 1, Новый Структура("а", 1), А[0].Б(,,2).В)\nКонецФункции',
    'А = "строка\n  // между\n |дальше ""кавычки"" // не примечание";',
    "Для Каждого А Из Б Цикл Если Не В И (Г Или Д) Тогда Прервать ИначеЕсли Е Тогда Продолжить Иначе ; КонецЕсли КонецЦикла",
    "#Если Сервер И Не Клиент Тогда\nА();\n#ИначеЕсли ТонкийКлиент Тогда\n#Иначе\n#КонецЕсли",
    "Try A = New(B, C); Except Raise; EndTry; While True Do EndDo; For I = 1 To 2 Do EndDo; ~Метка: Перейти ~Метка; Запрос.Выполнить().Если()",
    "А = '20240101' + 1.5 - -2 * 3 % 4;",
]
BAD = [
    "Процедура А()",
    "Процедура А() КонецФункции",
    "Если А Тогда",
    'А = "не закрыта',
    'А = "не\n\n |закрыта";',
    "А = (1 + 2;",
    "#Область Х",
    "#КонецОбласти",
    "#Если Сервер\nА();\n#КонецЕсли",
    "<<<<<<< HEAD\nА = 1;\n=======\n>>>>>>> x",
    "&НаКлиенте",
    '{"a": 1}',
    "# Заголовок\n\nТекст страницы.",
    "<xml/>",
    "А = 1 Б = 2",
    "А = ;",
    "Попытка А(); КонецПопытки",
    "А = Б..В;",
]


@pytest.mark.parametrize("text", GOOD)
def test_good_modules(text):
    assert checker().failing("bsl", text) is None


@pytest.mark.parametrize("text", BAD)
def test_bad_modules(text):
    assert checker().failing("bsl", text) is not None


def test_truncation_and_place():
    assert checker().failing("bsl", "Процедура А()\n Б();\n") == (3, True)
    assert checker().failing("bsl", "А = 1;\nБ = = 2;\n") == (2, False)
    assert checker().failing("json", '{"a": [1,') == (1, True)
    assert checker().failing("xml", "<a>\n</b>") == (2, False)


def test_json_against_the_standard_parser():
    rng = random.Random(3)
    base = ['{"a": [1, -2.5e+3, true, null, "x\\u0041\\n"], "b": {}}', "[]", '"s"', " 12 ", "[[[]]]"]
    for _ in range(3000):
        s = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(s) + 1)
            s[k : k + rng.randint(0, 2)] = rng.choice(["", ",", "[", "}", '"', "1", "\\", "0", "-", ".", "e", "\t", "tru"])
        s = "".join(s)
        try:
            json.loads(s, parse_constant=lambda c: 1 / 0)
            ok = True
        except (ValueError, ZeroDivisionError):
            ok = False
        assert (checker().failing("json", s) is None) == ok, s


def test_xml_against_the_standard_parser():
    rng = random.Random(4)
    base = ['<?xml version="1.0" encoding="UTF-8"?>\n<a x="1" y=\'2\'><!-- c --><b/><![CDATA[<<]]>t &amp; &#65;<?p i?></a>\n', "<a/>", "<п:а xmlns:п='u'>x</п:а>", "<!DOCTYPE a>\n<a></a>"]
    for _ in range(4000):
        s = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(s) + 1)
            s[k : k + rng.randint(0, 2)] = rng.choice(["", "<", ">", "&", "/", '"', "]]>", "--", "x", " ", "&lt;", "\x01", "="])
        s = "".join(s)
        p = expat.ParserCreate("utf-8")
        try:
            p.Parse(s.encode(), True)
            ok = True
        except expat.ExpatError:
            ok = False
        if "<!DOCTYPE" in s and ok:  # a document type may declare entities, which are not read
            continue
        assert (checker().failing("xml", s) is None) == ok, s


def test_memo_is_dropped_without_changing_results():
    c = Checker()
    c.code.limit = 10
    assert all(c.failing("bsl", t) is None for t in GOOD) and all(c.failing("bsl", t) for t in BAD)


def test_frame(spark):
    rows = [(1, "t", "a.BSL", "s", "А = ;"), (2, "t", "b.json", "s", "{}"), (3, "t", "c.txt", "s", "?"), (4, "t", "d.bsl", "s", None), (5, None, None, None, "x"), (6, "t", "e.xml", "s", ""), (1, "t", "a.BSL", "s", "А = ;"), (7, "t", "f.bsl", "s", "А();\n" * 60_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "file_id long, tenant_id string, path string, source string, content string, language int")
    assert {r.file_id for r in syntax.invalid_files(df).collect()} == {1, 6} and syntax.invalid_files(df).count() == 2
    got = {r.language: (r.n_files, r.n_invalid) for r in syntax.rates(df).collect()}
    assert got == {"bsl": (2, 1), "json": (1, 0), "xml": (1, 1)}
    assert syntax.invalid_files(df.limit(0)).count() == 0
