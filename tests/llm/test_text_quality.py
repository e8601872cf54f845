"""Text types: statistics against plain counts, labelled texts held out, the table."""

import random

import pytest

from lectern.llm import text_quality as T

COMMON = T.CommonWords(["的", "是", "因为", "为", "the", "of"])
PROSE = "进程是资源分配的基本单位，因为它拥有独立的地址空间。线程共享这些资源，所以切换的代价较小。"


def test_statistics():
    m = T.measure("因为 the 进程是 x1。\n第二行", COMMON)
    # Han: 因为进程是第二行 = 8 words; the, x, 1
    assert m["words"] == 8 + 3 and m["ends"] == 0.5 and m["common"] == pytest.approx((2 + 1 + 1) / 11)
    assert m["word_length"] == pytest.approx((8 + 5) / 11) and m["lines"] == 2
    assert T.measure(None, COMMON)["words"] == T.measure(" \n", COMMON)["words"] == 0


@pytest.mark.parametrize(("line", "n"), [("| a | b | c |", 3), ("a\tb\tc", 3), ("a   b   c", 3), ("a,b,c", 3), ("<tr><td>1</td><td>2</td><td>3</td></tr>", 3), ("进程 12，35–38，40", 1), ("1.1 进程 ........ 12", 1), ("00000000  83 14 3c 93 0e b9", 1), ("他说，这样，那样。", 1)])
def test_cells(line, n):
    assert T.cells(line) == n


def test_repeated():
    assert T.repeated("口" * 100) and T.repeated("abc " * 50) and not T.repeated(PROSE * 2) and not T.repeated("")


def test_em_prefers_agreement():
    patterns = {(0, 0, 0) + (-1,) * 9: 900, (-1, -1, -1, 2) + (-1,) * 8: 60, (-1,) * 4 + (1, 1) + (-1,) * 6: 60, (-1,) * 6 + (3, -1, -1, 3, 3, -1): 20, (0,) + (-1,) * 8 + (3, -1, -1): 10}
    prior, confusion = T.learn(patterns)
    said = {p: k for p, (_, k, _) in zip(patterns, T._said(patterns, prior, confusion))}
    assert list(said.values())[:4] == ["prose", "table", "list", "junk"]
    assert prior.sum() == pytest.approx(1) and prior[0] > 0.7
    assert confusion.sum(axis=2) == pytest.approx(1)
    assert T.learn({})[0].sum() == pytest.approx(1)


def corpus():
    rng = random.Random(3)
    words = ["进程", "线程", "页表", "死锁", "缓冲区", "信号量", "管程", "中断"]
    docs = []
    for i in range(300):
        w = lambda: rng.choice(words)
        docs.append(("prose", "".join(f"{w()}是{w()}的基础，因为它管理{w()}。" for _ in range(8))))
        if i % 10 == 0:
            docs.append(("list", "\n".join(f"- {w()}的{w()}" for _ in range(15))))
            docs.append(("table", "\n".join(f"| {w()} | {rng.randint(1, 999)} | {w()} |" for _ in range(10))))
            docs.append(("junk", "".join(rng.choice("#$%^&*{}[]<>~|\\/") for _ in range(300))))
            docs.append(("junk", "\n".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(60)) for _ in range(6))))
            docs.append(("junk", "此页空白 版权页\n" * 20))
    return docs


def test_table(spark):
    docs = corpus()
    rows = [(i, t, "x") for i, (_, t) in enumerate(docs)] + [(9001, None, "x"), (9002, "", "x"), (9003, " \n\t", "x"), (9004, PROSE * 3000, "x"), (9004, PROSE * 3000, "x")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, kind STRING")
    words = spark.createDataFrame([("zh", "的"), ("zh", "是"), ("zh", "因为"), ("zh", None)], "lang STRING, word STRING")
    got = T.text_types(df, words).collect()
    said = {r["doc_id"]: r["kind"] for r in got}
    assert len(got) == len(rows)
    assert sum(said[i] == k for i, (k, _) in enumerate(docs)) >= 0.98 * len(docs)
    assert said[9001] is said[9002] is said[9003] is None and said[9004] == "prose"
    empty = T.text_types(df.filter("false"), words)
    assert empty.count() == 0 and empty.columns == ["doc_id", "word_count", "mean_word_length", "symbol_share", "punctuated_line_share", "common_word_share", "kind", "posterior"]


def test_copies_of_junk_stay_junk(spark):
    rng = random.Random(5)
    words = ["进程", "线程", "页表", "死锁", "缓冲区", "信号量", "管程", "中断"]
    docs = ["".join(f"{rng.choice(words)}是{rng.choice(words)}的基础，因为它管理{rng.choice(words)}。" for _ in range(8)) for _ in range(900)]
    # random letters in the form of words: no other function votes for junk
    junk = "\n".join(" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(9)) for _ in range(6))
    rows = list(enumerate(docs + [junk] * 450))
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    got = T.text_types(df, spark.createDataFrame([("的",), ("是",)], "word STRING")).groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in got} == {"prose": len(docs), "junk": 450}
