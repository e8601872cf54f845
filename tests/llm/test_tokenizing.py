"""Token ids: against the libraries, in blocks of any size, and back."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm.tokenizing import FOLDER, PieceEncoder, Transducer, decode_corpus, encode_corpus, transducer

ALPHABET = st.text(st.one_of(st.sampled_from(" \n\t'.,-=a1lves数据结构。é📷"), st.characters(exclude_categories=["Cs"])), max_size=120)
WHOLE = transducer("byte_bpe_50k", FOLDER)


@settings(max_examples=200, deadline=None)
@given(ALPHABET, st.integers(4, 40))
def test_blocks_give_the_same(text, block):
    small = Transducer(block=block)
    want = WHOLE.encoding.encode_ordinary(text)
    assert list(small.stream(text[i : i + block] for i in range(0, len(text), block))) == want
    assert WHOLE.decode(want) == text


def test_against_other_library():
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    for text in ["进程（process）is 1 of 3.", "<|endoftext|>", "it's  we'll\n\n x", "a" * 500, "  ", "数据" * 200]:
        assert WHOLE.encode(text) == other.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("piece", ["a" * 300, "1234567890" * 30, "数据结构" * 40, "supercalifragilistic" * 9, "=-" * 90])
def test_long_piece(piece):
    encoder, raw, out, rng = PieceEncoder(WHOLE.encoding, WHOLE.ranks), piece.encode(), [], random.Random(1)
    held = at = 0
    while at < len(raw):
        n = rng.randint(1, 30)
        out += encoder.feed(raw[at : at + n])
        held, at = max(held, len(encoder.buf)), at + n
    assert out + encoder.finish() == WHOLE.encoding._encode_single_piece(raw)
    assert held <= 3 * encoder.longest + 30


def test_table(spark):
    rows = [(1, "进程 process", 1), (1, "进程 process", 1), (2, None, 1), (3, "", 1), (4, "页表。" * 60000, 1), (None, " ", None)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, ids INT")
    got = encode_corpus(df).collect()
    assert [list(r["ids"]) for r in got if r["doc_id"] in (2, 3)] == [[], []]
    assert next(list(r["ids"]) for r in got if r["doc_id"] == 4) == WHOLE.encoding.encode_ordinary("页表。" * 60000)
    back = {r["doc_id"]: r["text"] for r in decode_corpus(encode_corpus(df)).collect()}
    assert back == {1: "进程 process", 2: "", 3: "", 4: "页表。" * 60000, None: " "}
    assert encode_corpus(df.filter("false")).count() == 0
