import unicodedata

import pytest

from curvelake.llm import visual

SAME = [
    ("café", "café"), ("ＡＢＣ１２！", "ABC12!"), ("a b", "a b"), ("　", " "), ("pаypal", "paypal"), ("Ηello", "Hello"), ("ﬁne ﬂow", "fine flow"),
    ("in­visible", "invisible"), ("zero​width﻿", "zerowidth"), ("한글", "한글"), ("ﾊﾟﾝ", "パン"), ("q̣̇", "q̣̇"), ("ẹ́", "ẹ́"), ("​", ""), ("K", "K"), ("①‍", "①"), ("e​́", "é"), ("한가", "한가"), ("µ", "μ"), ("ẹ́ \U000f0003", "ẹ́ \U000f0003"), ("аbc\U000f0e00", "abc\U000f0e00"), ("\U000f0001é", "\U000f0001é"),
    ("ꓐⲞᎠ αρυ", "BOD apu"), ("ёлка", "ёлкa"), ("а\u0323\u0301", "ạ́"),
]
OTHER = [("café", "cafe"), ("café", "cafè"), ("Abc", "abc"), ("x²", "x2"), ("①", "1"), ("👍", "👎"), ("👨‍👩‍👧", "👨👩👧"), ("a b", "a  b"), ("З", "3"), ("a,b", "a.b"), ("́a", "á"), ("oe", "œ"), ("ß", "ss"), ("\U000f0003", "\U000f0004"), ("=a", "a"), ("\U000f0003=", "\U000f0003")]


@pytest.fixture(scope="module")
def form(spark):
    texts = sorted({t for p in SAME + OTHER for t in p})
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    return {texts[r["k"]]: r["form"] for r in visual.consistent_forms(df, ["k"]).collect()}


@pytest.mark.parametrize("a,b", SAME)
def test_same_look_same_form(form, a, b):
    assert form[a] == form[b]


@pytest.mark.parametrize("a,b", OTHER)
def test_other_look_other_form(form, a, b):
    assert form[a] != form[b]


def test_forms_are_composed_and_stable(spark, form):
    forms = sorted(set(form.values()))
    df = spark.createDataFrame(list(enumerate(forms)), "k int, text string")
    again = {forms[r["k"]]: r["form"] for r in visual.consistent_forms(df, ["k"]).collect()}
    assert all(again[f] == f for f in forms)
    assert all(unicodedata.normalize("NFC", f) == f for f in forms)


def test_long_texts_are_covered_whole(spark):
    text = "pаge ﬁve é é " * 3000
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, text string")
    got = {r["k"]: r["form"] for r in visual.consistent_forms(df, ["k"]).collect()}
    assert got == {1: "page five é é " * 3000, 2: None, 3: ""}


def test_pairs(spark):
    rows = [(1, "pay"), (2, "рay"), (3, "pay"), (4, "p​ay"), (5, "Pay"), (6, None), (None, "pаy"), (7, "alone"), (8, "alone"), (4, "p​ay"), (9, ""), (10, "⁠")]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id bigint, text string, form string, k1 int")
    got = sorted(map(tuple, visual.look_same_pairs(df).collect()))
    assert got == [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (9, 10)]
    assert visual.look_same_pairs(df.limit(0)).count() == 0
