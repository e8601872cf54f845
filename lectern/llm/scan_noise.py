"""Noise of scanned pages: hyphenated words, misread characters, running headers, page numbers.

Lines of headers and page numbers are told by their form and by the printed titles. The rest is one stream without line
ends, whose words are decoded jointly (see decoding.py), under counts and confusions of the corpus itself (language.py,
confusions.py). Where paragraphs begin is chosen by dynamic programming over all line ends outside code, whether other
noise was found or not.
"""

from __future__ import annotations

import difflib
import re
import unicodedata
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_rows, schema
from .confusions import learn, place_hashes
from .decoding import Decoder
from .hashing import ROWS, UNIT, buckets, copies, dense, hashed_counts, keys, sparse
from .language import BITS, PLACE_BITS, Model, count_stream
from .materialize import gathered
from .mojibake import garbled_spans
from .symbols import HYPHENS, stream, symbol_of

NOISES = ("hyphen", "misread", "header", "page_number")

_FENCE = re.compile(r"^[ \t]*```", re.M)
_INVISIBLE = r"\u200b-\u200d\u2060\ufeff"
#: A word broken over a line end; a long stroke only where nothing parts it from the word.
BROKEN = re.compile(rf"(?<=[^\W\d_\u2e80-\u9fff])[{_INVISIBLE}]*([{HYPHENS}\u00ad—~_])[ \t{_INVISIBLE}\u00a0\u2000-\u200a\u202f]*\r?\n[\s{_INVISIBLE}]*(?=[^\W\d_\u2e80-\u9fff])")
_DIGITS = r"[0-9０-９][0-9０-９OolIｌ]{0,3}"
PAGE = re.compile(
    rf"^[\s\-—–―~～·•.…|\[\]()（）【】<>《》〈〉*_=]*(?:(?:第|共)\s*{_DIGITS}\s*页(?:\s*[,，/]?\s*共\s*{_DIGITS}\s*页)?|(?:[Pp](?:age|AGE|g)?\.?\s*)?{_DIGITS}(?:\s*/\s*{_DIGITS}|\s+of\s+{_DIGITS})?(?:\s*页)?|(?=[ivxlc]|[IVXLC])(?:[xX]{{0,3}}(?:[iI][xX]|[iI][vV]|[vV]?[iI]{{0,3}})|[lL][xX]{{0,3}}[vV]?[iI]{{0,3}}))"
    r"[\s\-—–―~～·•.…|\[\]()（）【】<>《》〈〉*_=]*$"
)
HEADING_PAGE = re.compile(rf"(?:(?:[.·•…。．]\s?){{3,}}|…+|\s*[―—–\-_]{{2,}}|(?:\s[·.•]){{3,}}|\t)\s*{_DIGITS}\s*$")
CHAPTER = re.compile(r"^(?:第\s*[0-9０-９一二三四五六七八九十]{1,4}\s*章|Chapter\s+[0-9０-９]{1,3})\s+\S", re.I)
_LIST = re.compile(r"^\s*(?:[-*•+]\s+(?!\d+\s*-\s*$)|\d+[.)、]\s|[(（]?[a-zA-Z\d][)）]\s)")
_CAPTION = re.compile(r"^\s*(?:图|表|Figure|Table|Fig\.?|Listing|清单|代码)\s*[0-9０-９]")
_STOP = re.compile("[。！？；]")
_TERMINAL = re.compile(rf"[。！？.!?；;：:”’」』）)\"][\s{_INVISIBLE}]*$")
#: The longest line of a printed page; a longer one is a paragraph that was never wrapped.
PRINTED = 120


class Places:
    """Counts of places, by one row of cells: too high ones only let more places be looked at."""

    def __init__(self, table: np.ndarray):
        self.table = (np.maximum(table - np.median(table), 0) / UNIT).astype(np.float32)

    def __getstate__(self):
        return sparse(self.table)

    def __setstate__(self, state):
        self.table = dense(state, (1 << PLACE_BITS,))

    def of(self, h: np.ndarray) -> np.ndarray:
        return self.table[buckets(h, PLACE_BITS)]


class Noise(NamedTuple):
    kinds: tuple[str, ...]
    text: str | None


# -- printed titles -------------------------------------------------------------------------------------------------

def canon(text: str, decoder: Decoder | None = None) -> str:
    """Letters, digits and Han characters of a title or a line, in one width and case, misreadings undone one by one."""
    t = unicodedata.normalize("NFKC", text).lower()
    if decoder:
        for wrong, right in decoder.double.items():
            if wrong in t:
                t = t.replace(wrong, right[0][0])
        t = t.translate(decoder.plainer)
    return re.sub(r"[\W_]+", "", t)


def _like(a: str, b: str, least: float) -> bool:
    if not a or not b:
        return False
    if a == b:
        return True
    if not 0.7 <= len(a) / len(b) <= 1.43:
        return False
    m = difflib.SequenceMatcher(None, a, b, autojunk=False)
    return m.quick_ratio() >= least and m.ratio() >= least


def is_header(line: str, label: str, chapter: str, decoder: Decoder | None = None) -> bool:
    """Whether a line of its own is the title of the book or the chapter, with or without a page number.

    label, chapter: in canonical form. A line of more letters than both titles and a page number can have is none.
    """
    if len(line) > 90 and len(re.sub(r"[\W_]+", "", line)) > 1.43 * max(45, len(label) + len(chapter)) + 8:
        return False
    if _LIST.match(line) and not re.match(r"^\s*-\s.*\s-\s*$", line) or _CAPTION.match(line) or line.lstrip().startswith(("<", ">", "|", "#", "$")):
        return False
    core = canon(line, decoder)
    if len(core) < 2:
        return False
    bare = re.sub(r"^\d{1,4}(?=[^\d])|(?<=[^\d])\d{1,4}$", "", core)
    # the number of a chapter is part of it, a page number isn't
    cores = {core, bare, re.sub(r"^p?\d{1,4}(?=第|chapter)", "", core), re.sub(r"(?<=[^\d])\d{1,4}$", "", core)}
    for title in (label, chapter, label + chapter, chapter + label):
        if title and (title != label or len(title) > 1) and any(_like(c, title, 0.75 if len(title) <= 5 else 0.8) for c in cores):
            return True
    if re.search(r"[。！？，；,;!?]", line):
        return False
    # the chapter of a piece isn't always known: a chapter heading alone on a line is one as well
    text = unicodedata.normalize("NFKC", line).strip(" \t-—–|·~*_[]()0123456789")
    return bool(CHAPTER.match(text)) and len(canon(text)) <= 45


def heading_noise(heading: str, label: str, chapter: str, decoder: Decoder | None = None) -> tuple[str, set[str]]:
    """A heading without title and page number joined to it, and the kinds found."""
    kinds: set[str] = set()
    text = heading
    m = HEADING_PAGE.search(text)
    if m and re.search(r"[^\W\d]", text[: m.start()]):
        text = text[: m.start()].rstrip()
        kinds.add("page_number")
    m = re.match(r"^(.*?\S)(?:\s*[|｜/·\-—]\s*|\s+)(?=[0-9０-９]{1,3}\s*[.．][0-9０-９]{1,3}\D)", text, re.S)
    if m and re.search(r"[^\W\d]", m[1]) and is_header(m[1].strip(" |｜/·-—\t\n"), label, chapter, decoder):
        text = text[m.end() :]
        kinds.add("header")
    else:
        m = re.search(r"(?:\s*[|｜]\s*|\s{2,}|\n)([^|｜\n]+)$", text)
        if m and re.search(r"[^\W\d]", m[1]) and is_header(m[1].strip(), label, chapter, decoder):
            text = text[: m.start()].rstrip()
            kinds.add("header")
    return text, kinds


# -- paragraphs -----------------------------------------------------------------------------------------------------

#: Log odds for a line end where nothing was taken out to be a paragraph's end, and where something was.
WHOLE, TORN = 2.0, -4.0
#: How far the language model may move them, what a line too long to be a wrapped one adds, what unlike widths cost.
SURE, UNWRAPPED, UNLIKE = 8.0, 12.0, 4.0


def paragraphs(lines: list[str], cut: list[bool], model: Model | None = None, stays: list[bool] | None = None) -> str:
    """Join lines into paragraphs; cut[i] tells that something was taken out before line i, stays[i] that the line end
    before it stays in any case.

    Each line end is a paragraph's end or not. The log odds of one come from the symbols on both sides; besides, the
    lines inside a paragraph were printed to one width, so two line ends in a row that are none cost the difference of
    their lines' widths. The cheapest series is found by dynamic programming over the decisions at two line ends in a
    row, however long it is.
    """
    if not lines:
        return ""
    n = len(lines)
    ends = [0.0] + [0.0 if stays and stays[i] else _end_odds(lines[i - 1], lines[i], cut[i], model) for i in range(1, n)]
    stay = [True] + [bool(stays and stays[i]) or _fixed(lines[i - 1]) or _fixed(lines[i]) for i in range(1, n)]
    # cost of the best series up to a line end, by whether that one joins; and where it came from
    best, back = {False: 0.0}, []
    for i in range(1, n):
        new, came = {}, {}
        for join in (False, True) if not stay[i] else (False,):
            own = max(0.0, ends[i]) if join else max(0.0, -ends[i]) if not stay[i] else 0.0
            ways = [(price + own + (_unlike(lines[i - 2], lines[i - 1]) if join and before else 0.0), before) for before, price in best.items()]
            new[join], came[join] = min(ways)
        best = new
        back.append(came)
    join, joins = min(best, key=lambda j: best[j]), []
    for came in reversed(back):
        joins.append(join)
        join = came[join]
    out, parts = [], [lines[0]]
    for b, join in zip(lines[1:], reversed(joins)):
        if join:
            parts[-1], b = parts[-1].rstrip(), b.lstrip()
            parts.append(b if not parts[-1] or not b or _wide(parts[-1][-1]) or _wide(b[0]) else f" {b}")
        else:
            out.append("".join(parts))
            parts = [b]
    out.append("".join(parts))
    return "\n".join(out)


#: The symbols of a line, as symbols.py takes them.
_UNIT = re.compile(r"[㐀-鿿]|[^\W_㐀-鿿]+|[^\w\s]|_")


def _unlike(a: str, b: str) -> float:
    return UNLIKE * abs(len(a) - len(b)) / max(len(a), len(b), 1)


def _end_odds(a: str, b: str, cut: bool, model: Model | None) -> float:
    """Log odds that a paragraph ends between two lines."""
    odds = TORN if cut else WHOLE + (UNWRAPPED if max(len(a), len(b)) > PRINTED else 0.0)
    if _TERMINAL.search(a):
        return odds + SURE
    if re.match(r"\s*[a-z，。；、]", b):
        odds -= 3.0
    if model is None:
        return odds
    first, second = _UNIT.findall(a)[-2:], _UNIT.search(b)
    if not first or not second:
        return odds
    near = ([0] + [symbol_of(u) for u in first])[-2:]
    gain = model.end_gain(near[0], near[1], symbol_of(second[0]))
    return odds + max(-SURE, min(SURE, gain))


def _wide(c: str) -> bool:
    """Whether no space stands beside a character: Han ones and their marks, but not the wide forms of Latin letters."""
    plain = unicodedata.normalize("NFKC", c)
    return ord(c) > 0x2E7F and not (plain.isascii() and plain.isalnum())


def _fixed(line: str) -> bool:
    return bool(_LIST.match(line) or _CAPTION.match(line) or line.lstrip().startswith(("<", ">", "|", "#", "$")) or not line.strip())


# -- a field --------------------------------------------------------------------------------------------------------


class Mask:
    """Code fences and garbled sequences, which are left as they are; a fence that is never closed runs to the end.

    Garbled sequences are looked for only when a place has to be judged.
    """

    def __init__(self, text: str):
        self.text, self.garbled = text, None
        self.fences, marks = [], [m.start() for m in _FENCE.finditer(text)] if "```" in text else []
        for i in range(0, len(marks), 2):
            end = text.find("\n", marks[i + 1]) if i + 1 < len(marks) else -1
            self.fences.append((marks[i], len(text) if end < 0 else end))

    def __contains__(self, at: int) -> bool:
        if any(a <= at < b for a, b in self.fences):
            return True
        if self.garbled is None:
            self.garbled = garbled_spans(self.text)
        return any(a <= at < b for a, b in self.garbled)


def _apply(text: str, edits: list[tuple[int, int, str, str]]) -> str:
    at, out = 0, []
    for a, b, new, _ in edits:
        out += [text[at:a], new]
        at = b
    return "".join(out) + text[at:]


class Field(NamedTuple):
    """A field without headers and page numbers. gone: the lines before which others were taken out."""

    text: str
    kinds: set[str]
    gone: set[int]


def without_lines(text: str, label: str, chapter: str, decoder: Decoder, heading: bool) -> Field:
    kinds: set[str] = set()
    if heading:
        new, kinds = heading_noise(text, label, chapter, decoder)
        return Field(new, kinds, set())
    lines, at, gone, masked = [], 0, set(), None
    for line in text.split("\n"):
        kind = None
        if line.strip():
            if PAGE.match(line):
                kind = "page_number"
            elif not _STOP.search(line) and is_header(line, label, chapter, decoder):
                kind = "header"
        if kind:
            masked = masked or Mask(text)
            if at in masked:
                kind = None
        if kind:
            kinds.add(kind)
            gone.add(len(lines))
        else:
            lines.append(line)
        at += len(line) + 1
    return Field("\n".join(lines) if gone else text, kinds, gone)


def clean_fields(texts: list[str | None], titles: list[tuple[str, str]], decoder: Decoder, heading: bool) -> list[Noise]:
    """The repaired texts of a batch of fields and the kinds of noise found in each. Null and empty texts have none.

    titles: the label of the book and the chapter of each, in canonical form.
    """
    held = [i for i, t in enumerate(texts) if t and not t.isspace()]
    fields = [without_lines(texts[i], *titles[i], decoder, heading) for i in held]
    masks = [Mask(f.text) for f in fields]
    breaks = [[(m.start(), m.end(), m[1]) for m in BROKEN.finditer(f.text) if not f.text[m.end()].isupper() or m[1] in "-‐\u2011"] if "\n" in f.text else [] for f in fields]
    found = decoder.decode([f.text for f in fields], breaks, lambda k, at: at in masks[k])
    out = [Noise((), t) for t in texts]
    for i, f, mask, edits in zip(held, fields, masks, found):
        kinds = f.kinds.union(*(e[3].split() for e in edits))
        text = _apply(f.text, edits)
        if heading:
            text = re.sub(r"\s*\n\s*", " ", text)
        elif "\n" in text:
            text = _reflowed(text, _cuts(f.text, f.gone, edits), decoder.model, Mask(text) if edits else mask)
        out[i] = Noise(tuple(k for k in NOISES if k in kinds), text)
    return out


def _cuts(text: str, gone: set[int], edits: list[tuple[int, int, str, str]]) -> list[bool]:
    """For each line that is left after the edits, whether lines were taken out before it."""
    inside = {i for a, b, _, _ in edits if "\n" in text[a:b] for i in range(a, b)}
    out, at, n = [0 in gone], 0, 1
    while (at := text.find("\n", at)) >= 0:
        if at not in inside:
            out.append(n in gone)
        at, n = at + 1, n + 1
    return out


def _reflowed(text: str, cut: list[bool], model: Model, masked: Mask) -> str:
    """Paragraphs of the text outside code, each stretch by itself.

    A line end beside a garbled sequence stays, as the mark that would tell a paragraph's end can't be read there.
    """
    lines = text.split("\n")
    if not any(cut) and all(_TERMINAL.search(x) or not x.strip() for x in lines[:-1]):
        return text
    out, part, torn, stays, fenced, at = [], [], [], [], False, 0
    for line, taken in zip(lines, cut, strict=True):
        if line.lstrip().startswith("```") or fenced:
            if part:
                out.append(paragraphs(part, torn, model, stays))
                part, torn, stays = [], [], []
            out.append(line)
            fenced ^= line.lstrip().startswith("```")
        else:
            open_end = bool(part) and not taken and not (_TERMINAL.search(part[-1]) or _fixed(part[-1]) or _fixed(line))
            stays.append(open_end and any(i in masked for i in range(max(0, at - 4), at + 3)))
            part.append(line)
            torn.append(taken)
        at += len(line) + 1
    if part:
        out.append(paragraphs(part, torn, model, stays))
    return "\n".join(out)


# -- the table ------------------------------------------------------------------------------------------------------


def trained(df: DataFrame, content: str, heading: str) -> Decoder:
    """The decoder for a table: counts of the language model, then the confusions, each from all rows."""
    hashed = [(content, keys(content)), (heading, keys(heading, content))]
    copied = copies(df, *[k for _, k in hashed])
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(copied)

    def count(cols, table):
        main, places = table[: -(1 << PLACE_BITS)], table[-(1 << PLACE_BITS) :]
        for at in (0, 3):
            count_stream(stream([t or "" for t in cols[at]]), shared.value.units(cols[at + 1], cols[at + 2]), main, places, place_hashes)

    columns = [c for name, k in hashed for c in (name, *k)]
    table = hashed_counts(df, tuple(columns), count, ((ROWS << BITS) + 1 + (1 << PLACE_BITS),))
    model = Model(table[: -(1 << PLACE_BITS)])
    return Decoder(model, learn(df, hashed, model, Places(table[-(1 << PLACE_BITS) :]), copied))


def clean_scans(df: DataFrame, titles: DataFrame, key: str = "row_id", content: str = "content", heading: str = "section_h2", book: str = "book_name", chapter: str = "chapter") -> DataFrame:
    """One row for each input row: key, <heading>, <heading>_noise, <content>, <content>_noise.

    titles: book_name and label, the printed title; one row a book, collected. Noise columns are arrays of kinds. Null
    fields stay null, empty ones empty, without noise; unknown books and chapters only leave out what needs them.
    Repeated rows come out alike; an empty table gives an empty result. Counts and confusions are taken over all rows,
    in tables of fixed size. The copies of a content, and of a heading over the same content, share one vote, so that
    they don't vote for their own misreadings; a heading that is misread alike over many different contents still does.
    """
    decoder = trained(df, content, heading)
    labels = {r[0]: canon(r[1] or "", decoder) for r in gathered(titles.select("book_name", "label"), "titles") if r[0]}
    shared = df.sparkSession.sparkContext.broadcast(decoder)
    kind = dict(df.select(F.col(f"`{key}`").alias("k")).dtypes)["k"]

    def make():
        decoder, titled = shared.value, {}

        def run(cols):
            row_keys, contents, headings, books, chapters = cols
            for c in set(chapters) - titled.keys():
                if len(titled) > 1 << 14:
                    titled.clear()
                titled[c] = canon(c or "", decoder)
            names = [(labels.get(b, ""), titled[c] if c in titled else canon(c or "", decoder)) for b, c in zip(books, chapters)]
            out = [row_keys]
            for texts, heads in ((headings, True), (contents, False)):
                done = clean_fields(texts, names, decoder, heads)
                out += [[d.text for d in done], [list(d.kinds) for d in done]]
            return out

        return run

    done = map_rows(df, [key, content, heading, book, chapter], make, schema(f"k {kind}, h STRING, hn ARRAY<STRING>, c STRING, cn ARRAY<STRING>"))
    return done.select(F.col("k").alias(key), F.col("h").alias(heading), F.col("hn").alias(f"{heading}_noise"), F.col("c").alias(content), F.col("cn").alias(f"{content}_noise"))
