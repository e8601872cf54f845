"""Look-alike classes, representatives, rewriting."""

import unicodedata

import pytest

from lectern.llm.lookalike import Normalizer, look_alikes, normalize_look_alikes, rules

NORMALIZER = Normalizer(rules({"e": 9, "é": 3}))


@pytest.mark.parametrize(("text", "want"), [
    ("ＡＢ１２", "AB12"), ("a b c　d", "a b c d"), ("a​b﻿c⁠", "abc"), ("naïve", "naïve"), ("ｅ́", "é"), ("⼀⽤不", "一用不"),
    ("ﬁle oﬃce", "file office"), ("client‑server", "client-server"), ("8 КВ", "8 KB"), ("sуstem", "system"), ("cоmpute", "compute"), ("пaмять", "память"),
])
def test_rewritten(text, want):
    new, n = NORMALIZER.apply(text)
    assert new == want and n > 0


@pytest.mark.parametrize("text", ["память", "Ω(n log n) μ α", "naïve café", "5 ± ½", "“引号”，。；", "① ² ℃ № …", "~～—–", "👨‍👩", "日本語", "", None])
def test_stays(text):
    assert NORMALIZER.apply(text) == (text, 0)


def test_garbled_stays():
    text = "中文" + "进程".encode().decode("latin-1") + "ä¸\xad"
    assert NORMALIZER.apply(text)[1] == 0


def test_equal_after_rewriting():
    forms = ["页表 table", "页表 table", "页表 ｔａｂｌｅ", "页表 tаble", "页​表 table"]
    assert len({NORMALIZER.apply(f)[0] for f in forms}) == 1


def test_rules_end():
    """No replacement holds a pattern again, but for decomposed letters that a second turn joins."""
    rule = rules({})
    assert all(NORMALIZER.apply(v)[0] == v for v in set(rule.values()) if v)


def test_classes_are_transitive():
    for members in look_alikes().values():
        if "ｅ" in members:
            assert {"e", "е", "ｅ"} <= set(members)
            break
    else:
        raise AssertionError


def test_decomposed_against_unicode():
    for c in "áèîõüçñāǐǒśž":
        assert NORMALIZER.apply(unicodedata.normalize("NFD", c))[0] == c


def test_table(spark):
    rows = [(1, "第１章", "1.1 a", "x" * 100_000 + "​", 7), (2, None, "", None, 7), (2, None, "", None, 7), (None, "正常", "正常", "naïve", None)]
    df = spark.createDataFrame(rows, "row_id BIGINT, chapter STRING, section_h2 STRING, content STRING, chapter_changes INT")
    got = normalize_look_alikes(df).collect()
    one = next(r for r in got if r["row_id"] == 1)
    assert (one["chapter"], one["section_h2"], one["chapter_changes"], one["content_changes"]) == ("第1章", "1.1 a", 1, 1)
    assert [tuple(r)[1:] for r in got if r["row_id"] == 2] == [(None, 0, "", 0, None, 0)] * 2
    assert next(r for r in got if r["row_id"] is None)["content_changes"] == 0
    assert normalize_look_alikes(df.filter("false")).count() == 0
