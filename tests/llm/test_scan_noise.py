"""Scan noise: lines, hyphens, misreadings, splits and merges, paragraphs, what is learned, and the table as a whole."""

import numpy as np
import pytest

from lectern.llm import confusions as C
from lectern.llm import language as L
from lectern.llm import queries as Q
from lectern.llm import scan_noise as S
from lectern.llm.confusions import Confusion
from lectern.llm.decoding import Decoder
from lectern.llm.hashing import ROWS, UNIT, Counts, add
from lectern.llm.symbols import stream, symbol_of

CLEAN = "系统中的时间片由调度程序分配，数据结构保存存储器的地址。线程与进程的数据在存储器中。"
ENGLISH = "The message remains in the queue until the process checks the interrupt again."
MORE = "The operating system keeps a list of the processes. It is possible. The possible one is a list. Threads share the memory, and 线程共享内存。多个进程共享内存。"
CONFUSIONS = [Confusion(w, r, 0.0025) for w, r in (("吋", "时"), ("敷", "数"), ("仔", "存"), ("扯", "址"), ("糸", "系"), ("亨", "享"), ("享", "亨"), ("白勺", "的"), ("rn", "m"), ("c", "e"), ("5", "s"), ("!", "i"))]


def model_of(texts):
    table = np.zeros((ROWS << L.BITS) + 1, np.int64)
    L.count_stream(stream(texts), np.full(len(texts), UNIT), table, None, None)
    return L.Model(table)


@pytest.fixture(scope="module")
def decoder():
    return Decoder(model_of([CLEAN, ENGLISH, MORE, "12.1 进程", "3.1 线程"] * 400), CONFUSIONS)


def clean(decoder, text, label="操作系统", chapter="第3章 进程管理", heading=False):
    return S.clean_fields([text], [(S.canon(label, decoder), S.canon(chapter, decoder))], decoder, heading)[0]


@pytest.mark.parametrize("line", ["12", "- 12 -", "— 12 —", "~ 12 ~", "[12]", "·12·", "·· 12", "第 12 页", "P.12", "12/300", "xii"])
def test_page_lines(decoder, line):
    r = clean(decoder, f"系统中的时间片由调\n{line}\n度程序分配，数据结构保存存储器的地址。")
    assert r.kinds == ("page_number",)
    assert r.text == "系统中的时间片由调度程序分配，数据结构保存存储器的地址。"


@pytest.mark.parametrize("line", ["操作系统", "操 作 系 统", "操作糸统", "操作系统 · 12 ·", "12  操作系统", "第3章 进程管理", "第3章   进程管理   12", "— 第3章 进程管理 —", "操作系统 | 第3章 进程管理"])
def test_header_lines(decoder, line):
    r = clean(decoder, f"{CLEAN}\n{line}\n{CLEAN}")
    assert r.kinds == ("header",) and r.text == f"{CLEAN}\n{CLEAN}"


@pytest.mark.parametrize("text", ["第3章的内容到此为止，下一节讨论线程。", "图 3-12 进程", "- 操作系统的进程", "```\n12\n操作系统\n```", "共有 12 个进程。", "> 📷 **[图片]**", "", "   "])
def test_no_noise(decoder, text):
    assert clean(decoder, text) == S.Noise((), text)


def test_null(decoder):
    assert clean(decoder, None) == S.Noise((), None)


@pytest.mark.parametrize(("text", "want"), [("the mes-\nsage remains", "the message remains"), ("the mes–\n  sage remains", "the message remains"), ("the mes¬\n\nsage remains", "the message remains"), ("the mes- \r\nsage remains", "the message remains")])
def test_hyphens(decoder, text, want):
    r = clean(decoder, text)
    assert r.kinds == ("hyphen",) and r.text == want


def test_word_broken_twice(decoder):
    assert clean(decoder, "until the inter-\nru-\npt again").text == "until the interrupt again"


def test_broken_and_misread(decoder):
    r = clean(decoder, "the rnes-\nsage remains")
    assert r.kinds == ("hyphen", "misread") and r.text == "the message remains"


def test_compound_keeps_its_hyphen():
    decoder = Decoder(model_of(["the client-server arrangement"] * 30), [])
    assert clean(decoder, "the client-\nserver arrangement") == S.Noise(("hyphen",), "the client-server arrangement")


def test_broken_words_teach_nothing():
    decoder = Decoder(model_of(["the client-\nserver arrangement"] * 30 + ["a clientserver"] * 3), [])
    assert clean(decoder, "the client-\nserver arrangement").text == "the clientserver arrangement"


def test_dash_is_no_hyphen(decoder):
    assert "hyphen" not in clean(decoder, "the queue —\nthe process").kinds


@pytest.mark.parametrize(("text", "want"), [("系统中的吋间片", "系统中的时间片"), ("敷据结构保存存储器白勺地址", "数据结构保存存储器的地址"), ("仔储器的地扯", "存储器的地址"), ("the rnessage rcmains in the queue", "the message remains in the queue"), ("the me5sage rema!ns", "the message remains")])
def test_misread(decoder, text, want):
    r = clean(decoder, text)
    assert r.kinds == ("misread",) and r.text == want


def test_code_stays(decoder):
    text = "系统中的时间片\n```\nrnessage = 吋间\n12\n```"
    assert clean(decoder, text) == S.Noise((), text)


@pytest.mark.parametrize(("heading", "kinds", "want"), [
    ("3.1 进程 ......... 12", ("page_number",), "3.1 进程"), ("3.1 进程 · · · · 12", ("page_number",), "3.1 进程"), ("3.1 进程\t12", ("page_number",), "3.1 进程"),
    ("操作系统 | 3.1 进程", ("header",), "3.1 进程"), ("操作系统\n3.1 进程", ("header",), "3.1 进程"), ("3.1 IPv6", (), "3.1 IPv6"), ("l2.1 进程", ("misread",), "12.1 进程"), ("3.1 mes-\nsage", ("hyphen",), "3.1 message"),
])
def test_headings(decoder, heading, kinds, want):
    r = clean(decoder, heading, heading=True)
    assert r.kinds == kinds and r.text == want


def test_splits_and_merges(decoder):
    assert clean(decoder, "The opera ting system keeps alist of the processes.") == S.Noise((), "The operating system keeps a list of the processes.")
    assert clean(decoder, "The opera\nting system keeps a list.").text == "The operating system keeps a list."


@pytest.mark.parametrize("text", ["线程共享进程的资源。", "多个进程共享内存", CLEAN, ENGLISH, "系统与享用的", "the list of a message"])
def test_right_text_stays(decoder, text):
    assert clean(decoder, text) == S.Noise((), text)


def test_neighbours_are_read_together(decoder):
    assert clean(decoder, "存储器的地址。线程与进程白勺敷据在仔储器中。").text == "存储器的地址。线程与进程的数据在存储器中。"


def test_width_and_case_are_kept(decoder):
    assert clean(decoder, "Ｔｈｅ ｍｅ５ｓａｇｅ remains, Me5sage").text == "Ｔｈｅ ｍｅｓｓａｇｅ remains, Message"


def test_paragraphs():
    assert S.paragraphs(["完整的一句话说完了。", "另一段。"], [False, False]) == "完整的一句话说完了。\n另一段。"
    assert S.paragraphs(["这句话还没有说", "完就换行了。"], [False, True]) == "这句话还没有说完就换行了。"
    assert S.paragraphs(["- 一项内容", "- 两项内容"], [False, True]) == "- 一项内容\n- 两项内容"
    assert S.paragraphs([], []) == ""


def test_paragraphs_are_the_cheapest_series():
    """Against all series of a few lines."""
    import itertools

    lines = ["it doesn't matter whether the synchronization", "checks the diagnostic", "messages or not, which makes independent", "development possible.", "The fairness is", "determined by the order"]
    odds = [0.0] + [S._end_odds(a, b, False, None) for a, b in zip(lines, lines[1:])]

    def price(joins):
        out = 0.0
        for i, j in enumerate(joins, 1):
            out += max(0.0, odds[i]) if j else max(0.0, -odds[i])
            if i > 1 and j and joins[i - 2]:
                out += S._unlike(lines[i - 2], lines[i - 1])
        return out

    best = min(itertools.product((False, True), repeat=len(lines) - 1), key=price)
    want = lines[0]
    for line, j in zip(lines[1:], best):
        want += (" " if j else "\n") + line
    assert S.paragraphs(lines, [False] * len(lines)) == want


WRAPPED = "It doesn't matter whether the message checks the\nqueue messages or not, which makes independent process\n{}ible.\nThe process is checked by the\nexecution order."
WHOLE = "It doesn't matter whether the message checks the queue messages or not, which makes independent process possible.\nThe process is checked by the execution order."


@pytest.mark.parametrize(("part", "kinds"), [("poss", ()), ("poss-\n  ", ("hyphen",)), ("poss-\n12\n", ("hyphen", "page_number"))])
def test_wrapped_lines_join_without_a_cut(decoder, part, kinds):
    r = clean(decoder, WRAPPED.format(part))
    assert r.kinds == kinds and r.text == WHOLE


def test_words_over_line_ends_join(decoder):
    assert clean(decoder, "数据结构保存存储器的地\n址。时间片由调度\n程序分配").text == "数据结构保存存储器的地址。时间片由调度程序分配"


def test_cuts_are_numbered_after_hyphens(decoder):
    r = clean(decoder, f"the mes-\nsage remains.\n系统中的时间片由调\n12\n度程序分配。\n{CLEAN}")
    assert r.text == f"the message remains.\n系统中的时间片由调度程序分配。\n{CLEAN}"


def test_long_paragraphs_join_whole(decoder):
    lines = ["whether it holds"] * 1000
    assert S.paragraphs(lines, [True] * 1000) == " ".join(lines)


@pytest.mark.parametrize("text", ["```\nthe message remains in\nthe queue\n```", CLEAN + "\u200c\n" + CLEAN, "æŒ‰ç…§å®šä¹‰ï¼Œæˆ‘ä»¬æŠŠã€‚\næŒ‰ç…§å®šä¹‰ï¼Œæˆ‘ä»¬æŠŠã€‚", "段" * 121 + "\n" + CLEAN, "- the message remains\n- in the queue"])
def test_line_ends_that_stay(decoder, text):
    assert clean(decoder, text).text == text


def test_counts_beyond_32_bits():
    table = np.zeros((ROWS << L.BITS) + 1, np.int64)
    L.count_stream(stream([CLEAN]), np.array([UNIT * 10**10]), table, None, None)
    model = L.Model(table)
    assert model.one(1, ord("的")) == pytest.approx(3e10) and model.one(2, ord("的"), ord("时")) == pytest.approx(1e10)


def test_few_collisions():
    """A table with as many items as cells still tells frequent items from those never seen."""
    rng, bits = np.random.default_rng(1), 12
    table = np.zeros(ROWS << bits, np.int64)
    rare, often, never = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (1 << bits, 50, 4000))
    add(table, rare, bits)
    add(table, often, bits, 1000)
    counts = Counts(table, bits)
    assert (np.abs(counts.of(often) - 1000) < 20).all() and np.mean(counts.of(never) > 100) < 0.01


def test_symbols():
    s = stream(["the me5sage\nof 12, 白勺", "", "ａB!"])
    shown = [(s.text[a:b], int(k)) for a, b, k in zip(s.start, s.end, s.owner) if s.text[a] != "\x01"]
    assert shown == [("the", 0), ("me5sage", 0), ("of", 0), ("12", 0), (",", 0), ("白", 0), ("勺", 0), ("ａB", 2), ("!", 2)]
    assert [bool(x) for x in s.line if x] == [True]
    for text in ("me5sage", "白", "12", ","):
        assert symbol_of(text) in s.sym.tolist()
    assert symbol_of("ab") == s.sym[shown.index(("ａB", 2)) + 2 + 2 + 2]


def test_letter_edits():
    assert C.letter_edit("rnessage", "message") == ("rn", "m") and C.letter_edit("me5sage", "message") == ("5", "s")
    assert C.letter_edit("bmary", "binary") == ("m", "in") and C.letter_edit("message", "message") is None and C.letter_edit("first", "last") is None


def test_confusions_are_learned(spark):
    """Misreadings are even; words that share a place, and words of their own right, are no confusions."""
    rng, rows = np.random.default_rng(3), []
    ends = ["地址", "数据", "时间", "线程", "进程", "结构", "程序", "系统"]
    for i in range(6000):
        a, b = rng.choice(ends, 2)
        text = f"第{i}条：系统中的{a}由调度程序{'复用' if i % 3 else '复制'}，保存{b}的时候由{a}说明白的道理，这里{'的确' if i % 40 else '明白'}如此。"
        for right, wrong in (("的", "白勺"), ("时", "吋"), ("数", "敷")):
            text = "".join(wrong if c == right and rng.random() < 0.01 else c for c in text)
        rows.append((i, text, "x", None, None))
    df = spark.createDataFrame(rows, "row_id BIGINT, content STRING, section_h2 STRING, book_name STRING, chapter STRING")
    decoder = S.trained(df, "content", "section_h2")
    found = {(w, r[0]) for held in (decoder.single, decoder.double) for w, x in held.items() for r in x}
    assert {("吋", "时"), ("敷", "数"), ("白勺", "的")} <= found
    assert not found & {("制", "用"), ("用", "制"), ("明白", "的"), ("线", "进"), ("进", "线")}


def test_table(spark, monkeypatch):
    monkeypatch.setattr(S, "learn", lambda *a: CONFUSIONS)
    rows = [(i, CLEAN + str(i), "3.1 进程", "os", "第3章 进程管理", "extra") for i in range(400)]
    rows += [(900, "系统中的吋间片由调度程序\n12\n分配，" + CLEAN, None, None, None, "x"), (901, None, "", "os", None, "x"), (902, "", "操作系统 | 3.1 进程", "os", None, "x"), (903, "系统中的吋间片由调度程序\n12\n分配，" + CLEAN, None, None, None, "x"), (904, CLEAN * 3000, None, "os", None, "x")]
    df = spark.createDataFrame(rows, "row_id BIGINT, content STRING, section_h2 STRING, book_name STRING, chapter STRING, k STRING")
    titles = spark.createDataFrame([("os", "操作系统"), ("db", None)], "book_name STRING, label STRING")
    got = {r["row_id"]: r for r in S.clean_scans(df, titles).collect()}
    assert len(got) == len(rows)
    assert got[900]["content_noise"] == got[903]["content_noise"] == ["misread", "page_number"]
    assert got[900]["content"] == got[903]["content"] == "系统中的时间片由调度程序分配，" + CLEAN
    assert got[901]["content"] is None and got[901]["section_h2"] == "" and got[901]["content_noise"] == []
    assert got[902]["section_h2"] == "3.1 进程" and got[902]["section_h2_noise"] == ["header"]
    assert got[904]["content_noise"] == []
    assert S.clean_scans(df.filter("false"), titles.filter("false")).count() == 0


def test_copies_dont_vote(spark, monkeypatch):
    monkeypatch.setattr(S, "learn", lambda *a: CONFUSIONS)
    wrong = "系统中的吋间片由调度程序分配，the rnessage remains in the queue." + CLEAN
    rows = [(i, f"第{i}次。{CLEAN}{ENGLISH}", f"{i} 进程") for i in range(60)] + [(1000 + i, wrong, f"{i} 线程") for i in range(300)]
    df = spark.createDataFrame(rows, "row_id BIGINT, content STRING, section_h2 STRING").selectExpr("*", "string(null) AS book_name", "string(null) AS chapter")
    got = S.clean_scans(df, spark.createDataFrame([], "book_name STRING, label STRING")).filter("row_id >= 1000")
    assert got.groupBy("content_noise", "content").count().collect() == [(["misread"], wrong.replace("吋", "时").replace("rnessage", "message"), 300)]


def test_found_names_the_field(spark, folder):
    got = Q.p1_found(spark, folder)
    assert dict(got.dtypes) == {"row_id": "bigint", "field": "string", "noise": "string"}
    found = got.collect()
    assert {r["field"] for r in found} == {"content", "section_h2"} and {r["noise"] for r in found} <= set(S.NOISES)
