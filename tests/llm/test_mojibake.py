"""Encoding repair: exact round trips through wrong encodings, and texts that only look odd."""

import random

import pytest

from lectern.llm.mojibake import garbled_spans, repair, repair_encoding

TEXTS = ["进程是资源分配的基本单位，线程共享这些资源。", "The so-called “naïve” method isn’t used here.", "缓冲区（buffer）每隔 851 ms 登记一次控制信息。"]


def whatwg(raw: bytes) -> str:
    """As browsers read cp1252: bytes without a character become control codes."""
    out = ""
    for b in raw:
        try:
            out += bytes((b,)).decode("cp1252")
        except UnicodeDecodeError:
            out += chr(b)
    return out


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("wrong", ["latin-1", "cp1252", "mac_roman", "koi8_r", "cp437", "cp866"])
def test_utf8(text, wrong):
    raw = text.encode()
    bad = whatwg(raw) if wrong == "cp1252" else raw.decode(wrong)
    r = repair(bad)
    assert r.text == text and r.spans and r.layers == 1


@pytest.mark.parametrize("text", [TEXTS[0], TEXTS[2]])
def test_gbk_as_latin(text):
    r = repair(text.encode("gbk").decode("latin-1"))
    assert r.text == text and "gbk" in r.how[0]


@pytest.mark.parametrize("layers", [2, 3])
def test_nested(layers):
    bad = TEXTS[0]
    for _ in range(layers):
        bad = whatwg(bad.encode())
    r = repair(bad)
    assert r.text == TEXTS[0] and r.layers == layers


def test_utf8_as_chinese():
    text = "进程是资源分配的基本单位线程共享"
    bad = text.encode().decode("gb18030")
    assert repair(f"前文，{bad}。").text == f"前文，{text}。"


def test_part_of_a_text():
    bad = "操作系统管理" + whatwg("资源分配".encode()) + "的过程。"
    r = repair(bad)
    assert r.text == "操作系统管理资源分配的过程。"
    assert bad[: r.spans[0][0]] == "操作系统管理" and bad[r.spans[-1][1] :] == "的过程。"


@pytest.mark.parametrize("text", ["锟斤拷锟斤拷锟斤拷", "前文��后文", "ሑͻሄሖକሶଣቇ", TEXTS[0].encode("gbk").decode("utf-8", "replace"), TEXTS[0].encode()[:-1].decode("gbk", "replace")])
def test_lost(text):
    r = repair(text)
    assert r.spans and not r.whole


@pytest.mark.parametrize("text", [*TEXTS, "память граф список дерево", "Ω(n²) μ λ °C ±5 ½", "xiànchéng sǐsuǒ", "naïve résumé façade déjà vu coöperative", "何吋定位，设备驱动桯序", "📷 **[图片]**", "ｆｕｌｌ　ｗｉｄｔｈ", "⼀⽤", "日本語", "", None])
def test_clean(text):
    assert repair(text) == (text, [], [], 0, True)


def test_random_chinese_is_never_touched():
    rng = random.Random(5)
    from lectern.llm.charset import gb_han

    han = sorted(gb_han(1))
    for _ in range(200):
        assert not garbled_spans("".join(rng.choice(han) for _ in range(60)))


def test_table(spark):
    bad = whatwg(TEXTS[0].encode())
    rows = [(1, bad, "x"), (1, bad, "x"), (2, None, "x"), (3, "", "x"), (4, TEXTS[0] * 5000, "x"), (None, "�", None)]
    df = spark.createDataFrame(rows, "row_id BIGINT, content STRING, garbled STRING")
    got = repair_encoding(df).collect()
    assert [(r["garbled"], r["recovered"], r["text"]) for r in got if r["row_id"] == 1] == [(True, True, TEXTS[0])] * 2
    assert {r["row_id"]: r["garbled"] for r in got} == {1: True, 2: False, 3: False, 4: False, None: True}
    assert not next(r for r in got if r["row_id"] is None)["recovered"]
    assert repair_encoding(df.filter("false")).count() == 0
