"""Cleaning rules on hand-made texts."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import markdown as M
from lectern.functions import text as X


def apply(spark, fn, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING").select("i", fn(F.col("t")).alias("o")).orderBy("i").collect()
    return [r["o"] for r in rows]


CASES = [
    (M.remove_garbage, "a订ካ఻୲ͻጇፒb", "ab"),
    (M.join_chapter_heading, "## 第1章\n\n## 引论", "## 第1章 引论"),
    (M.image_placeholder, "x<!-- image -->y", "x\n\n> 📷 **[图片]**\n\ny"),
    (M.drop_after_image, "> 📷 **[图片]**\n\n图 1\n\n正文", "> 📷 **[图片]**\n\n正文"),
    (M.drop_isolated_han, "a\n\n甲\n\n乙\n\nb", "a\n\n乙\n\nb"),
    (M.drop_running_titles, "a\n\n操作系统\n\nb", "a\n\nb"),
    (M.drop_isolated_number, "a\n\n12\n\nb", "a\n\nb"),
    (M.drop_isolated_number, "a\n\n１２\n\nb", "a\n\nb"),
    (M.drop_isolated_chapter, "a\n\n第 3 章\n\nb", "a\n\nb"),
    (M.drop_after_heading, "## 标题\n\n碎片\n\n正文", "## 标题\n\n正文"),
    (M.drop_fragments, "a\n\n存储器管\n\n因此 b", "a\n\n因此 b"),
    (M.circled_digits, "①②⑩", "(1)(2)(10)"),
    (M.full_width_dot, "3．x", "3.x"),
    (M.decode_entities, "&amp;lt;", "&lt;"),
    (M.decode_entities, "&amp;quot;", '"'),
    (M.decode_entities, "a&nbsp;b", "a b"),
    (M.unescape_underscore, "a\\_b", "a_b"),
    (M.code_punctuation, "```\nf（x，y）；\n```（", "```\nf(x,y);\n```（"),
    (M.code_punctuation, "（\n```\nf（x）", "（\n```\nf（x）"),
    (M.collapse_blank, "a \n\n\n\nb\t", "a\n\nb"),
    (M.space_blocks, "a\n# b\nc", "a\n\n# b\n\nc"),
    (M.final_trim, "\n\na\n\n", "a\n"),
    (M.normalize_headings, "#include <stdio.h>", "### include <stdio.h>"),
    (M.normalize_headings, "# Internet 概述", "Internet 概述"),
]


@pytest.mark.parametrize(("fn", "text", "want"), CASES)
def test_step(spark, fn, text, want):
    assert apply(spark, fn, text) == [want]


def test_null_and_empty(spark):
    for _, step in M.STEPS:
        assert apply(spark, step, None) == [None]
    assert apply(spark, M.clean, "", None) == ["\n", None]


@pytest.mark.parametrize(("title", "level"), [("第1章 引论", 1), ("第１章 引论", 1), ("1.2.3.4 x", 4), ("1.2.3 x", 3), ("1.2 x", 2), ("1.方便性", 4), ("3. abc", 2), ("概述", 3), ("int main", 0), ("Internet 概述", 0), ("x", 0), ("123", 0), ("foo(bar)", 0), ("} ;", 0)])
def test_title_level(spark, title, level):
    assert apply(spark, M.title_level, title) == [level]


def test_headings_in_code_can_stay(spark):
    text = "# 概述\n```\n#include <a>\n```"
    assert apply(spark, lambda c: M.normalize_headings(c, fences=True), text) == ["### 概述\n```\n#include <a>\n```"]


def test_clean_is_a_projection(spark):
    plan = spark.range(1).select(M.clean(F.lit("x").cast("string")).alias("t"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_counts(spark):
    got = apply(spark, M.cleaning_counts, "a<!-- image -->b\n\n12\n\nc")[0]
    assert got["images"] == 1 and got["isolated_number"] == 1


@pytest.mark.parametrize(("text", "want"), [("all", [0, 1, 2, 3, 4]), ("1,3-5,7", [0, 2, 3, 4]), ("3-1", []), ("", []), ("2,2", [1])])
def test_selection(spark, text, want):
    assert apply(spark, lambda c: X.selection(c, 5), text) == [want]


def test_text_functions(spark):
    assert apply(spark, X.strip, " 　hi\t") == ["hi"]
    assert apply(spark, X.html_escape, "<a & 'b'>") == ["&lt;a &amp; &#x27;b&#x27;&gt;"]
    assert apply(spark, lambda c: X.snippet(c, 3), "abcd", "abc") == ["abc...", "abc"]
    assert apply(spark, X.title_case, "os lab 2nd o'neil") == ["Os Lab 2Nd O'Neil"]
    assert apply(spark, lambda c: X.section_path(c, F.lit(" "), F.lit("C")), "A", "") == ["A > C", "C"]
    assert apply(spark, lambda c: X.section_path(c, c), "", None) == ["未标注章节", "未标注章节"]
    assert apply(spark, lambda c: X.collection_name(c, {"操作系统": "os"}), "操作系统", "_a b_") == ["os", "a_b"]
    assert apply(spark, X.collection_name, "书")[0].startswith("book_")
    assert apply(spark, X.stem, "os_chunks") == ["os"]
    assert apply(spark, lambda c: X.fixed(F.lit(1234.5), 3), "x") == ["1234.500"]


def test_after_heading_by_brute_force(spark, folder):
    """SQL has no lookahead; here every chunk goes through the same rule in Python."""
    import re

    from lectern.plans import registry
    from lectern.session import table

    rule = re.compile(r"(#{1,6}\s+.+?\n\n)([^\n#]{1,15}\n\n)(?=[^\n])")
    texts = {r["row_id"]: r["content"] for r in table(spark, folder, "chunks").select("row_id", "content").collect()}
    more = {-1: "# a\nb\nccc\nd", -2: "## x\n短\n长长\n文", -3: "# a\nb", -4: "", -5: "#\n\n# y\n1\n2\n3", -6: None}
    df = spark.createDataFrame(list(more.items()), "row_id BIGINT, content STRING")
    got = {r["row_id"]: r["text"] for r in registry.queries()["clean_after_heading"](spark, folder).collect()}
    got |= {r["row_id"]: r["text"] for r in df.select("row_id", M.drop_after_heading(registry._spaced(F.col("content"))).alias("text")).collect()}
    want = {k: None if t is None else rule.sub(r"\1", t.replace("\n", "\n\n")) for k, t in (texts | more).items()}
    assert got == want
