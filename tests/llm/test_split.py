"""Splitting: round trip, limits, overlap, boundaries."""

from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm.split import LIMIT, OVERLAP, split_oversized, split_text

TEXT = st.text(st.sampled_from("字词句。！\n ab.,#1️\r"), max_size=400)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(2, 60), st.data())
def test_round_trip(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    spans = split_text(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(0 <= b - a <= limit for a, b in spans)
    for (_, b), (c, d) in zip(spans, spans[1:]):
        assert c == b - overlap and d > b
    assert text == text[: spans[0][1]] + "".join(text[a + overlap : b] for a, b in spans[1:])
    assert (len(spans) > 1) == (len(text) > limit)


def test_boundaries():
    sentence = "这是一句完整的话。"
    spans = split_text(sentence * 200)
    assert all((sentence * 200)[b - 1] == "。" for _, b in spans)
    paragraphs = ("段" * 300 + "\n") * 5
    assert all(paragraphs[b - 1] == "\n" for _, b in split_text(paragraphs))
    assert split_text("x" * 2000)[0] == (0, 750)
    assert split_text(None) == [] and split_text("") == [(0, 0)]


def test_words_stay_whole():
    text = "word " * 400
    assert all(text[b - 1] == " " for _, b in split_text(text))


def test_table(spark):
    rows = [(1, "x" * 801, 2, 5, "a"), (2, "x" * 800, None, None, "b"), (3, None, 1, 1, "c"), (4, "", 1, 1, "d"), (1, "x" * 801, 2, 5, "a"), (None, "。" * 5000, 0, 0, None)]
    df = spark.createDataFrame(rows, "row_id BIGINT, content STRING, level INT, piece_no INT, overlap_chars STRING")
    got = split_oversized(df).collect()
    assert sorted(r["piece_no"] for r in got if r["row_id"] == 1) == [0, 0, 1, 1]
    assert all(r["char_count"] == len(r["content"]) <= LIMIT for r in got)
    assert {r["level"] for r in got if r["row_id"] == 1} == {2} and not [r for r in got if r["row_id"] == 3]
    assert all(r["overlap_chars"] == (OVERLAP if r["piece_no"] else 0) for r in got)
    assert split_oversized(df.filter("false")).count() == 0
