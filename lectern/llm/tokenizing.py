"""Token ids of whole texts by a public byte-level tokenizer, as a streaming transducer with bounded lookahead.

A text is fed in blocks. Tokens are emitted as soon as no later character can change them: the pattern that splits text
before the merges needs three characters beyond a piece, and inside a piece that is longer than a block the merges need
as many bytes as may begin a token (see PieceEncoder). Every text goes this way, in blocks of BLOCK characters. What is kept between blocks is bounded by that, not by the
text. Decoding goes the other way, from ids to bytes to text, with a state machine that keeps at most three bytes.
"""

from __future__ import annotations

import base64
import codecs
import functools
import os
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_rows, schema

#: Where the vocabulary files are; a parameter of every operator here.
FOLDER = os.environ.get("TOKENIZER_FOLDER", "/opt/tokenizers")
#: Fixed value: the pattern of the byte-level vocabularies, which splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The last place where a piece ends whatever stands before and after: no piece goes on from a letter, a number or a sign
#: into white space, nor from letters or numbers into anything else.
CERTAIN = r"(?r)(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])"
#: Characters beyond a piece after which it is certain: an apostrophe may take two letters, white space looks one on.
PIECE_LOOKAHEAD = 3
#: Characters fed at a time; what is kept between blocks is bounded by this and the lookahead, not by the text.
BLOCK = 1 << 10


@functools.lru_cache(4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PieceEncoder:
    """BPE of one piece, fed in parts, with the lookahead that the merge list needs.

    For each prefix of the piece only the last token of its encoding is kept; the encoding of any prefix is then the
    chain of last tokens. A token can follow the chain at some place if encoding it together with the token before gives
    just these two. How far to look ahead follows from the merge list: whatever comes next, the token over the end of what
    was fed starts at a place from which the rest is a beginning of a token, or at the end itself. Tokens that the chains
    of all these places share can't change any more and are emitted.
    """

    def __init__(self, encoding, ranks: dict[bytes, int]):
        self.encoding, self.ranks = encoding, ranks
        self.longest = max(map(len, ranks))
        #: All beginnings of tokens.
        self.begun = {t[:n] for t in ranks for n in range(1, len(t))}
        sizes: dict[bytes, set[int]] = {}
        for t in ranks:
            sizes.setdefault(t[-2:], set()).add(len(t))
        #: Lengths of the tokens that end with two bytes (or are one byte), long ones first.
        self.sizes = {k: sorted(v, reverse=True) for k, v in sizes.items()}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.buf, self.last = b"", [b""]

    def _follows(self, a: bytes, b: bytes) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > 1 << 18:
                self.fits.clear()
            known = self.fits[a, b] = self.encoding._encode_single_piece(a + b) == [self.ranks[a], self.ranks[b]]
        return known

    def feed(self, part: bytes) -> list[int]:
        self.buf += part
        buf, last = self.buf, self.last
        for end in range(len(last), len(buf) + 1):
            for n in (*self.sizes.get(buf[max(0, end - 2) : end], ()), 1):
                token = buf[end - n : end]
                if n <= end and token in self.ranks and (last[end - n] is not None) and (n == end and not last[0] or self._follows(last[end - n], token)):
                    # a token that covers bytes from the start follows nothing, or the token emitted last
                    last.append(token)
                    break
            else:
                last.append(None)
        stable = self._shared()
        out = self._chain(stable)
        if stable:
            keep = last[stable]
            self.buf, self.last = buf[stable:], [keep, *last[stable + 1 :]]
        return out

    def open_places(self) -> list[int]:
        """Where a token over the end of what was fed may start, the end itself included."""
        end = len(self.buf)
        return [p for p in range(max(0, end - self.longest + 1), end) if self.buf[p:] in self.begun] + [end]

    def _shared(self) -> int:
        """The last boundary that the chains of all open places have in common."""
        common = None
        for place in self.open_places():
            if self.last[place] is None:
                continue
            on, at = set(), place
            while at > 0:
                on.add(at)
                at -= len(self.last[at])
            common = on if common is None else common & on
            if not common:
                return 0
        return max(common or {0})

    def _chain(self, end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(self.ranks[self.last[end]])
            end -= len(self.last[end])
        return out[::-1]

    def finish(self) -> list[int]:
        out = self._chain(len(self.buf))
        self.buf, self.last = b"", [b""]
        return out


class Transducer:
    """Text in blocks to token ids, and token ids to text."""

    def __init__(self, name: str = "byte_bpe_50k", folder: str = FOLDER, block: int = BLOCK):
        import regex
        import tiktoken

        self.ranks = _ranks(str(Path(folder, f"{name}.tiktoken")))
        self.encoding = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.block, self.pieces = block, regex.compile(PATTERN)
        self.certain = regex.compile(CERTAIN)
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self._long: PieceEncoder | None = None

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; an empty list for a null and for an empty one."""
        if not text:
            return []
        return list(self.stream(text[i : i + self.block] for i in range(0, len(text), self.block)))

    def stream(self, blocks: Iterable[str]) -> Iterator[int]:
        buf, kind = "", ""
        for block in blocks:
            buf += block
            if kind:  # inside a piece longer than a block
                cut = self._run_end(buf, kind)
                yield from self._long.feed(buf[:cut].encode("utf-8", "surrogatepass"))
                buf = buf[cut:]
                if not buf:
                    continue
                yield from self._long.finish()
                kind = ""
            if m := self.certain.search(buf, 0, max(0, len(buf) - PIECE_LOOKAHEAD)):
                yield from self.encoding.encode_ordinary(buf[: m.start()])
                buf = buf[m.start() :]
            # without such a place, or for what is after it, piece by piece
            if len(buf) <= self.block:
                continue
            stable, solid, spaces = 0, 0, []
            for m in self.pieces.finditer(buf):
                if m.end() > len(buf) - PIECE_LOOKAHEAD:
                    break
                stable = m.end()
                if m[0][-1].isspace():
                    spaces.append(m[0])
                else:
                    solid, spaces = stable, []
            yield from self.encoding.encode_ordinary(buf[:solid])
            for piece in spaces:  # one by one: what follows had split them, without it they would join
                yield from self.encoding.encode_ordinary(piece)
            buf = buf[stable:]
            if len(buf) > self.block and (kind := self._kind(buf)):
                self._long = self._long or PieceEncoder(self.encoding, self.ranks)
                yield from self._long.feed(buf[:-PIECE_LOOKAHEAD].encode("utf-8", "surrogatepass"))
                buf = buf[-PIECE_LOOKAHEAD:]
        if kind:
            cut = self._run_end(buf, kind)
            yield from self._long.feed(buf[:cut].encode("utf-8", "surrogatepass"))
            yield from self._long.finish()
            buf = buf[cut:]
        if buf:
            yield from self.encoding.encode_ordinary(buf)

    @staticmethod
    def _kind(piece: str) -> str:
        """The class of characters that goes on in a long piece; white space is left to the pattern, whose last one joins what follows."""
        import regex

        for kind in (r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]"):
            if regex.fullmatch(rf" ?{kind}+", piece):
                return kind
        return ""

    @staticmethod
    def _run_end(buf: str, kind: str) -> int:
        import regex

        return regex.match(rf"{kind}*", buf).end()

    def decode(self, ids: Iterable[int] | None) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters. Null gives an empty text."""
        state, out = codecs.getincrementaldecoder("utf-8")("replace"), []
        for i in ids or ():
            out.append(state.decode(self.bytes_of[i]))
        out.append(state.decode(b"", True))
        return "".join(out)


@functools.lru_cache(4)
def transducer(name: str, folder: str) -> Transducer:
    return Transducer(name, folder)


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """One row for each input row: key, ids ARRAY<INT>, without special tokens.

    Null and empty texts give an empty list. Strings of special tokens are ordinary text. Repeated rows give equal
    lists; an empty table gives an empty result. No row leaves its partition.
    """
    kind = dict(df.select(F.col(f"`{key}`").alias("k")).dtypes)["k"]

    def make():
        encode = transducer(tokenizer, folder).encode
        return lambda cols: [cols[0], [encode(t) for t in cols[1]]]

    return map_rows(df, [key, text], make, schema(f"k {kind}, ids ARRAY<INT>")).withColumnRenamed("k", key)


def count_tokens(df: DataFrame, columns: tuple[str, ...], text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = FOLDER, name: str = "tokens") -> DataFrame:
    """The columns, and the number of tokens of the text; 0 for null and empty texts. Only the count leaves Python."""
    packed = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(columns)])
    picked = df.select(packed.alias("k"), F.col(f"`{text}`").alias("t"))

    def make():
        encode = transducer(tokenizer, folder).encode
        return lambda cols: [cols[0], [len(encode(t)) for t in cols[1]]]

    flat = map_rows(picked, ["k", "t"], make, schema(f"k {dict(picked.dtypes)['k']}, n BIGINT"))
    return flat.select(*[F.col(f"k.k{i}").alias(c) for i, c in enumerate(columns)], F.col("n").alias(name))


def decode_corpus(df: DataFrame, key: str = "doc_id", ids: str = "ids", tokenizer: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """One row for each input row: key, text. A null or empty list gives an empty text."""
    kind = dict(df.select(F.col(f"`{key}`").alias("k")).dtypes)["k"]

    def make():
        decode = transducer(tokenizer, folder).decode
        return lambda cols: [cols[0], [decode(i) for i in cols[1]]]

    return map_rows(df, [key, ids], make, schema(f"k {kind}, text STRING")).withColumnRenamed("k", key)
