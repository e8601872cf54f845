"""Text quality statistics of documents, and their types: natural prose, list, table or junk.

Thresholds on the statistics are labelling functions: each votes for a type or abstains. How often a function votes
what for which type is learned by expectation-maximization from the agreements alone, over the counts of the vote
patterns of the whole corpus; the posterior of a document's pattern gives its type.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_rows, schema
from .charset import clean_class
from .hashing import ROWS, UNIT, Counts, add, copies, hashed_counts, keys, ngrams, points
from .materialize import gathered, written

KINDS = ("prose", "list", "table", "junk")
NGRAM, NGRAM_BITS = 3, 20

_WORD = re.compile(r"[^\W\d_一-鿿]+(?:['’-][^\W\d_一-鿿]+)*|\d+(?:[.,]\d+)*")
_ENDS = re.compile(r"[。！？.!?；;：:…][”’」』）)\"'*]*$")
_SENTENCE = re.compile(r"[。！？；]|[a-z)”’\"'%][.!?](?: |$)|\d[.!?]$|，[^，]{4,}，")
_SYMBOL = re.compile(r"[^\w\s一-鿿。，、；：？！“”‘’（）《》.,;:?!'\"()\-—…·]")
_ODD = re.compile("[^" + clean_class() + "○●◎◇◆□■△▲▽▼☆★※←↑↓]")
_LEADER = re.compile(r"(?:[.…·‧]\s?){3,}")
_RULE = re.compile(r"^[\s|+:=_─━-]{3,}$")
_HEXDUMP = re.compile(r"^[0-9a-fA-F]{4,}[: ]+(?:[0-9a-fA-F]{2,4} +){3,}")
_INDEX = re.compile(r"^\D*[^\W\d]\D*\s\d+(?:[–-]\d+)?(?:[，,]\s*\d+(?:[–-]\d+)?)*$")
_SPLIT = re.compile(r"[|\t,，;<]|  ")
_OPTION = re.compile(r"^(?:[-*•·]|[(（]?[A-Da-d][)）.]|\d+[.、)])\s*\S{1,18}$")
_LATIN_WORD = re.compile(r"(?<!\S)[A-Za-z]{2,}")
_HAN = re.compile("[一-鿿]")
_LETTER = re.compile(r"[^\W\d_]")


def cells(line: str) -> int:
    """The number of cells of a row, 1 where the line is none."""
    if "<td" in line or "<th" in line:
        return len(re.findall(r"<t[dh][ >]", line))
    if _HEXDUMP.match(line) or _LEADER.search(line) or len(line) <= 60 and _INDEX.match(line):
        return 1
    if line.count("|") >= 2:
        parts = line.strip("|").split("|")
        filled = sum(1 for p in parts if re.search(r"\w", p))
        return len(parts) if filled >= 0.6 * len(parts) and len(_SYMBOL.findall(line)) - line.count("|") < 0.2 * len(line) else 1
    if "\t" in line:
        parts = line.split("\t")
    elif "  " in line:
        parts = re.split(r" {2,}", line)
    elif ("," in line or "，" in line or ";" in line) and not _SENTENCE.search(line):
        parts = re.split(r"[,，;]", line)
    else:
        return 1
    if len(parts) >= 3 and all(len(p) <= 34 and p.count(" ") <= 6 for p in parts) and sum(1 for p in parts if re.search(r"\w", p)) >= 3:
        return len(parts)
    return 1


class CommonWords:
    """Counts the words of a text that are common ones; Han ones are looked for longest first."""

    def __init__(self, words: list[str]):
        self.long = sorted((w for w in words if len(w) > 1 and "一" <= w[0] <= "鿿"), key=lambda w: (-len(w), w))
        self.short = sorted(w for w in words if len(w) == 1 and "一" <= w <= "鿿")
        self.other = frozenset(w.lower() for w in words if w and not "一" <= w[0] <= "鿿")

    def covered(self, text: str, others: list[str]) -> int:
        n = sum(1 for w in others if w.lower() in self.other)
        for w in self.long:
            if k := text.count(w):
                n += k * len(w)
                text = text.replace(w, " ")
        return n + sum(map(text.count, self.short))


def measure(text: str | None, common: CommonWords) -> dict[str, float]:
    """The statistics of a text; zeros for null, empty and blank ones."""
    text = (text or "").replace("\r", "")
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    solid = sum(map(len, text.split()))
    if not solid:
        return {k: 0.0 for k in ("words", "word_length", "symbols", "ends", "common", "lines", "solid", "sentences", "rows", "items", "distinct", "digits", "dumps", "odd", "single", "longest")}
    others = _WORD.findall(text)
    codes = points(text)
    han = int(np.count_nonzero((codes >= 0x4E00) & (codes <= 0x9FFF)))
    words = han + len(others)
    covered = common.covered(text, others)
    bare = _LEADER.sub("", text)
    symbols = len(_SYMBOL.findall("\n".join(x for x in bare.split("\n") if not _RULE.match(x)).replace("|", "")))
    kinds, widths = Counter(), Counter()
    counts = [cells(x) if _SPLIT.search(x) else 1 for x in lines]
    shapes = Counter(n for n in counts if n >= 3)
    usual = {n for n, k in shapes.items() if k >= 2 and k >= 0.2 * sum(shapes.values())}
    tokens = text.split()
    single = sum(1 for t in tokens if len(t) == 1) / len(tokens)
    for x, c in zip(lines, counts):
        n = len(x) - x.count(" ")
        if c >= 3 and c in usual or shapes and _RULE.match(x):
            kind = "row"
        elif single > 0.6 or _HEXDUMP.match(x):
            kind = "other"
        elif n <= 60 and _INDEX.match(x):
            kind = "item"
        elif _SENTENCE.search(x) and not _LEADER.search(x) and not _OPTION.match(x):
            kind = "sentence"
        elif n > 24 and (len(_LATIN_WORD.findall(x)) >= 7 or len(_HAN.findall(x)) >= 25 and "  " not in x):
            kind = "sentence"
        elif x[0] == "#" and re.match(r"#{1,6} ", x):
            kind = "heading"
        elif n <= 45 and _LETTER.search(x) or _LEADER.search(x):
            kind = "item"
        else:
            kind = "other"
        kinds[kind] += 1
        widths[kind] += n
    digits = int(np.count_nonzero((codes >= 0x30) & (codes <= 0x39)))
    return {
        "words": words,
        "word_length": (han + sum(map(len, others))) / max(1, words),
        "symbols": symbols / solid,
        "ends": sum(1 for x in lines if _ENDS.search(x)) / len(lines),
        "common": covered / max(1, words),
        "lines": len(lines),
        "solid": solid,
        "sentences": widths["sentence"] / solid,
        "rows": widths["row"] / solid,
        "items": kinds["item"] / max(1, len(lines) - kinds["heading"]),
        "distinct": len({re.sub(r"\d+", "0", x) for x in lines}) / len(lines),
        "digits": digits / solid,
        "dumps": sum(1 for x in lines if _HEXDUMP.match(x)) / len(lines),
        "odd": len(_ODD.findall(text)) / solid,
        "single": single,
        "longest": max(map(len, tokens)),
    }


def repeated(text: str) -> bool:
    """Whether a text is one string over and over."""
    s = re.sub(r"\s+", "", text)
    if len(s) < 20 or s.find(s[:20], 1, 61) < 0:
        return False
    m = re.match(r"(.{1,40}?)\1{3,}", s, re.S)
    return bool(m and len(m[0]) >= 0.8 * len(s))


def votes(m: dict[str, float], fluency: float, text: str) -> tuple[int, ...]:
    """A vote of each labelling function: the place of a type in KINDS, or -1."""
    prose, lst, table, junk = range(4)
    return (
        prose if m["sentences"] >= 0.55 else -1,
        prose if m["ends"] >= 0.6 and m["rows"] < 0.3 else -1,
        prose if m["common"] >= 0.09 and m["sentences"] > 0.3 else -1,
        table if m["rows"] >= 0.5 else -1,
        lst if m["items"] >= 0.6 and m["rows"] < 0.5 and m["sentences"] < 0.5 and m["distinct"] > 0.15 else -1,
        lst if m["items"] >= 0.4 and m["ends"] < 0.4 and m["distinct"] > 0.15 and m["sentences"] < 0.5 and m["symbols"] < 0.2 else -1,
        junk if m["symbols"] >= 0.25 else -1,
        junk if m["distinct"] <= 0.15 and m["lines"] >= 4 and m["rows"] < 0.4 or repeated(text) else -1,
        junk if m["odd"] >= 0.15 else -1,
        junk if fluency < 0 else -1,
        junk if m["longest"] >= 45 and m["sentences"] < 0.3 and m["rows"] < 0.3 and fluency < 0.7 or m["single"] > 0.7 else -1,
        junk if m["digits"] >= 0.6 and m["rows"] < 0.5 and m["items"] < 0.5 or m["dumps"] > 0.5 else -1,
    )


#: How sure each labelling function is taken to be before anything is learned; as strong as so many documents.
PRIOR = (0.8, 0.7, 0.7, 0.9, 0.8, 0.7, 0.85, 0.95, 0.95, 0.9, 0.9, 0.85)
PRIOR_WEIGHT = 20.0


def learn(patterns: dict[tuple[int, ...], int], rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Priors of the types and P(vote | type) of each function, by expectation-maximization over pattern counts.

    Patterns are bounded by the functions, not by the documents. Votes are columns 0 to 3, abstentions column 4.
    """
    k, n = len(KINDS), len(PRIOR)
    start = np.full((n, k, k + 1), 0.0)
    for j, sure in enumerate(PRIOR):
        voted = {p[j] for p in patterns if p[j] >= 0}
        for kind in range(k):
            mine = kind in voted
            start[j, kind, :k] = (1 - sure) * 0.2 / k
            if mine:
                start[j, kind, kind] = 0.6
            for v in voted - {kind}:
                start[j, kind, v] = (1 - sure) * 0.5
            start[j, kind, k] = 0.0
            start[j, kind, k] = max(0.05, 1 - start[j, kind].sum())
            start[j, kind] /= start[j, kind].sum()
    prior, confusion = np.array([0.7, 0.1, 0.1, 0.1]), start.copy()
    keys = list(patterns)
    seen = np.array([[v if v >= 0 else k for v in p] for p in keys], np.int64).reshape(len(keys), n)
    weight = np.array([patterns[p] for p in keys], float)
    for _ in range(rounds if keys else 0):
        post = posterior(seen, prior, confusion)
        mass = post * weight[:, None]
        prior = (mass.sum(axis=0) + 1.0) / (mass.sum() + k)
        for j in range(n):
            table = np.zeros((k, k + 1))
            for v in range(k + 1):
                table[:, v] = mass[seen[:, j] == v].sum(axis=0)
            table += PRIOR_WEIGHT * start[j]
            confusion[j] = table / table.sum(axis=1, keepdims=True)
    return prior, confusion


def posterior(seen: np.ndarray, prior: np.ndarray, confusion: np.ndarray) -> np.ndarray:
    log = np.log(prior)[None, :] + sum(np.log(confusion[j][:, seen[:, j]].T) for j in range(seen.shape[1]))
    p = np.exp(log - log.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _codes(text: str) -> np.ndarray:
    codes = points(text)
    return np.where((codes >= 65) & (codes <= 90), codes + np.uint32(32), codes)


def count_ngrams(texts: list[str | None], units: np.ndarray, table: np.ndarray) -> None:
    """Trigrams of characters, and in the last cell the texts that aren't blank, all in units."""
    held = [t or "" for t in texts]
    codes = _codes("\n".join(held))
    if codes.size:
        weight = np.repeat(units, [len(t) + 1 for t in held])[: codes.size]
        add(table[:-1], ngrams(codes, NGRAM), NGRAM_BITS, weight)
    table[-1] += int(units[[bool(t) and not t.isspace() for t in held]].sum())


class Fluency:
    """Whether the n-grams of letters in a text are those of the corpus: log of a lower quantile of their counts over a
    bound that grows with the corpus."""

    def __init__(self, table: np.ndarray):
        self.counts, self.bound = Counts(table[:-1], NGRAM_BITS, UNIT), max(2.0, 0.004 * float(table[-1]) / UNIT)
        self.letters = np.array([chr(c).isalpha() for c in range(0x10000)])

    def of(self, texts: list[str]) -> list[float]:
        """For a batch at once; 0.7, which means nothing, for texts with hardly any letters."""
        codes = _codes("\n".join(texts))
        inside = self.letters[np.minimum(codes, 0xFFFF)]
        whole = np.zeros(codes.size, bool)
        whole[2:] = inside[2:] & inside[1:-1] & inside[:-2]
        seen = np.where(whole, self.counts.of(ngrams(codes, NGRAM)), -1)
        out, at = [], 0
        for t in texts:
            part = seen[at : at + len(t)]
            part = np.sort(part[part >= 0])
            out.append(float(np.log((part[part.size * 2 // 5] + 1) / self.bound)) if part.size >= 5 else 0.7)
            at += len(t) + 1
        return out


def text_types(df: DataFrame, words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each input row: key, word_count, mean_word_length, symbol_share, punctuated_line_share,
    common_word_share, kind, posterior.

    A word is a Han character, a run of other letters or a number; words: the table of common words (column word),
    which is small and collected. Null, empty and blank texts have zeros and a null kind. Repeated rows come out alike;
    an empty table gives an empty result. The vote patterns are taken over all rows, the n-gram
    counts and the number of documents they are held against with one vote for all copies of a text, so that copies of
    junk don't make it fluent.
    """
    common = CommonWords(sorted(r[0] for r in gathered(words.select("word").dropna().distinct(), "words")))
    spark = df.sparkSession
    copied = spark.sparkContext.broadcast(copies(df, keys(text)))

    def count(cols, table):
        count_ngrams(cols[0], copied.value.units(cols[1], cols[2]), table)

    shared = spark.sparkContext.broadcast(Fluency(hashed_counts(df, (text, *keys(text)), count, ((ROWS << NGRAM_BITS) + 1,))))
    kind = dict(df.select(F.col(f"`{key}`").alias("k")).dtypes)["k"]

    def make():
        fluency = shared.value

        def run(cols):
            out = [cols[0]] + [[] for _ in range(6)]
            fluent = fluency.of([t or "" for t in cols[1]])
            for t, fl in zip(cols[1], fluent):
                m = measure(t, common)
                v = "" if not m["solid"] else ",".join(map(str, votes(m, fl, t)))
                for o, x in zip(out[1:], (int(m["words"]), m["word_length"], m["symbols"], m["ends"], m["common"], v)):
                    o.append(x)
            return out

        return run

    measured = map_rows(df, [key, text], make, schema(f"k {kind}, word_count BIGINT, mean_word_length DOUBLE, symbol_share DOUBLE, punctuated_line_share DOUBLE, common_word_share DOUBLE, votes STRING"))
    measured = written(measured)
    patterns = {tuple(map(int, r["votes"].split(","))): r["count"] for r in measured.filter("votes <> ''").groupBy("votes").count().collect()}
    prior, confusion = learn(patterns)
    said = spark.createDataFrame(_said(patterns, prior, confusion), "votes STRING, kind STRING, posterior DOUBLE")
    # one row a vote pattern: at most 2^12 of them
    out = measured.join(F.broadcast(said), "votes", "left").drop("votes")
    return out.select(F.col("k").alias(key), "word_count", "mean_word_length", "symbol_share", "punctuated_line_share", "common_word_share", "kind", "posterior")


def _said(patterns, prior, confusion) -> list[tuple[str, str, float]]:
    out = []
    for p in patterns:
        post = posterior(np.array([[v if v >= 0 else len(KINDS) for v in p]]), prior, confusion)[0]
        out.append((",".join(map(str, p)), KINDS[int(post.argmax())], float(post.max())))
    return out
