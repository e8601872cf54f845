"""Which characters are misread as which others, learned from the corpus.

A misreading strikes a character evenly wherever it stands: in a place where one symbol is nearly always found (the two
symbols before and after it being the same), another one turns up now and then, at much the same rate in all places of
the right one. Words that share a place don't behave so: they come often in some places and never in most. For each
pair of a rare and a usual symbol the places are counted in which the rare one turned up, and held against the number
that an even rate would give. Words of letters are compared letter by letter, one edit at a time.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .batches import slices
from .hashing import UNIT, mix
from .language import hashes
from .materialize import gathered, written
from .symbols import HAN, WORD, stream

#: How often a place must have been seen, at least and as a share of all symbols, so that their number has a bound at
#: every size of the corpus; and how rare another symbol must be there.
PLACE_LEAST, PLACE_SHARE, RARE = 20, 1e-6, 0.1
#: Places that a confusion must have struck, and how many (and how many occurrences of the right symbol in them) against
#: the number that an even rate would give; the lowest rate worth a reading, and the highest, beyond which it is taken for
#: another word in its own right.
PLACES, EVEN, LOWEST, HIGHEST = 3, 0.4, 1.5e-4, 0.02
#: Share of a place's occurrences that its usual symbol must have. Rate of a reading against the best one of the same
#: symbol. Share of a pair of characters that must be misreadings.
USUAL, CHIEF, OWN = 0.7, 0.3, 0.3
#: Right words that an edit of letters must have been seen in.
WORDS = 3


class Confusion(NamedTuple):
    """wrong: one or two Han characters, or up to two letters or marks of a word; rate: how often right is read so."""

    wrong: str
    right: str
    rate: float


def place_hashes(sym: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the two symbols before and after each run of `width` symbols, at the place of its first one."""
    n = sym.size
    h = np.full(n, 20, np.uint64)
    for d in (-2, -1, width, width + 1):
        part = np.zeros(n, np.uint64)
        lo, hi = max(0, -d), min(n, n - d)
        if lo < hi:
            part[lo:hi] = sym[lo + d : hi + d]
        h = mix(h, part)
    return h


def _rare(lm, sym: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the symbols at some places are rare after the two before them."""
    return lm.counts.of(hashes(3, sym[at - 2], sym[at - 1], sym[at])) <= RARE * lm.counts.of(hashes(2, sym[at - 2], sym[at - 1]))


def place_least(lm) -> float:
    return max(PLACE_LEAST, PLACE_SHARE * lm.total)


def occurrences(lm, places, copied: Counts):
    """A function from texts and their hashes to units by place and symbol as text: in frequent places only."""

    least = place_least(lm)

    def run(texts: list, one: np.ndarray, two: np.ndarray) -> dict[tuple[int, str], int]:
        s = stream([t or "" for t in texts])
        weight = copied.units(one, two)
        out: dict[tuple[int, str], int] = {}
        for width in (1, 2):
            h = place_hashes(s.sym, width)
            if width == 1:
                ok = (s.kind == HAN) | (s.kind == WORD)
            else:
                ok = s.kind == HAN
                ok[:-1] &= ok[1:]
                ok[-1:] = False
            at = np.nonzero(ok)[0]
            at = at[places.of(h[at]) >= least]
            if width == 2:
                at = at[_rare(lm, s.sym, at)]
            if not at.size:
                continue
            both = mix(h[at], s.sym[at] if width == 1 else mix(s.sym[at], s.sym[at + 1]))
            which, found = pd.factorize(both)
            first = np.zeros(found.size, np.int64)
            first[which[::-1]] = np.arange(at.size)[::-1]
            units = np.bincount(which, weights=weight[s.owner[at]], minlength=first.size).astype(np.int64).tolist()
            at = at[first]
            for i, p, n in zip(at.tolist(), h[at].view(np.int64).tolist(), units):
                key = p, s.text[s.start[i] : s.end[i + width - 1]].lower()
                if width == 1 or len(key[1]) == 2:
                    out[key] = out.get(key, 0) + n
        return out

    return run


def letter_edit(a: str, b: str) -> tuple[str, str] | None:
    """What a and b differ in, where that is one edit of at most two letters on either side."""
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    x, y = a[i : len(a) - j], b[i : len(b) - j]
    if x and not y and i:
        # one letter read as two: the letter beside is part of the edit
        x, y = a[i - 1 : len(a) - j], b[i - 1 : len(b) - j]
    elif y and not x and i:
        x, y = a[i - 1 : len(a) - j], b[i - 1 : len(b) - j]
    return (x, y) if 1 <= len(x) <= 2 and 1 <= len(y) <= 2 and x != y and y.isalpha() else None


def learn(df: DataFrame, columns: list[tuple[str, list[Column]]], lm, places, copied: Counts) -> list[Confusion]:
    """The confusions that the texts of the columns (name, hashes) bear out; all rows are read."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((lm, places, copied))
    picked = df.select(*[c for i, (name, hashed) in enumerate(columns) for c in (F.col(f"`{name}`").alias(f"t{i}"), hashed[0].alias(f"a{i}"), hashed[1].alias(f"b{i}"))])

    fields = len(columns)

    def run(batches):
        find = occurrences(*shared.value)
        held: dict[tuple[int, str], int] = {}
        for batch in batches:
            for part in slices(batch, 2000):
                for i in range(fields):
                    for k, n in find(part.column(3 * i).to_pylist(), part.column(3 * i + 1).to_numpy(), part.column(3 * i + 2).to_numpy()).items():
                        held[k] = held.get(k, 0) + n
            if len(held) > 1 << 19:
                yield _batch(held)
                held = {}
        yield _batch(held)

    seen = picked.mapInArrow(run, "place BIGINT, sym STRING, n BIGINT").groupBy("place", "sym").agg((F.sum("n") / UNIT).alias("n"))
    # read four times
    return judge(written(seen), lm)


def _batch(held: dict[tuple[int, str], int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int64()), pa.array([k[1] for k in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["place", "sym", "n"])


def judge(seen: DataFrame, lm) -> list[Confusion]:
    """seen: place, sym, n. The usual symbol of each place against all others there; no pairs among the others.

    Only places where the usual symbol has nearly all occurrences tell what a rare one stands for. A symbol in two parts
    must seldom stand for itself, and neither part may be the right one or already be explained by a confusion of its own.
    """
    place = W.partitionBy("place")
    usual = F.max(F.struct("n", "sym")).over(place)
    at = seen.withColumn("usual", usual).withColumn("all", F.sum("n").over(place)).select("place", "sym", "n", F.col("usual.sym").alias("right"), F.col("usual.n").alias("most"), "all")
    at = at.filter((F.col("most") >= place_least(lm)) & (F.col("most") >= USUAL * F.col("all")))
    rare = at.filter((F.col("sym") != F.col("right")) & (F.col("n") <= RARE * F.col("most")))
    # single Han characters and pairs of them for one; longer ones are words of letters
    han = F.col("right").rlike("^[㐀-鿿]$") & F.col("sym").rlike("^[㐀-鿿]{1,2}$") & ~F.contains("sym", "right")
    pairs = rare.filter(han).groupBy(F.col("sym").alias("wrong"), "right").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("most").alias("held"))
    pairs = pairs.filter(F.col("k") >= PLACES)
    # places of each right symbol by their frequency, as powers of two: at most 64 a symbol
    usual_at = at.filter(F.col("sym") == F.col("right")).groupBy("right", F.floor(F.log2("most")).alias("size")).agg(F.count("*").alias("places"), F.sum("most").alias("mass"))
    totals = usual_at.groupBy("right").agg(F.sum("mass").alias("total"), F.collect_list(F.struct("places", "mass")).alias("sizes"))
    judged = pairs.join(totals, "right").withColumn("rate", F.col("n") / F.col("total")).filter(F.col("rate").between(LOWEST, HIGHEST))
    struck = lambda of: F.aggregate("sizes", F.lit(0.0), lambda s, x: s + x[of] * (1 - F.exp(-F.col("rate") * x["mass"] / x["places"])))
    kept = judged.filter((F.col("k") >= EVEN * struck("places")) & (F.col("held") >= EVEN * struck("mass")))
    rows = gathered(kept.select("wrong", "right", "rate").orderBy("wrong", "right"), "confusions of characters")
    most: dict[str, float] = {}
    for r in rows:
        most[r["wrong"]] = max(most.get(r["wrong"], 0), r["rate"])
    rows = [r for r in rows if r["rate"] >= CHIEF * most[r["wrong"]]]
    single = {r["wrong"] for r in rows if len(r["wrong"]) == 1}
    out = []
    for r in rows:
        wrong, right = r["wrong"], r["right"]
        if len(wrong) == 2 and (single & set(wrong) or r["rate"] * lm.one(1, ord(right)) < OWN * lm.one(2, *map(ord, wrong))):
            continue
        out.append(Confusion(wrong, right, r["rate"]))
    return out + _letters(rare, usual_at)


def _letters(rare: DataFrame, usual_at: DataFrame) -> list[Confusion]:
    word = "^[a-z0-9!|]{4,}$"
    pairs = rare.filter(F.col("right").rlike("^[a-z]{4,}$") & F.col("sym").rlike(word)).groupBy("sym", "right").agg(F.sum("n").alias("n"))

    def run(batches):
        for b in batches:
            out: list[tuple[str, str, str, float]] = []
            for w, r, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if e := letter_edit(w, r):
                    out.append((*e, r, n))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.float64()))], names=["wrong", "edited", "right", "n"])

    edits = pairs.mapInArrow(run, "wrong STRING, edited STRING, right STRING, n DOUBLE").groupBy("wrong", "edited", "right").agg(F.sum("n").alias("n"))
    mass = usual_at.filter(F.col("right").rlike("^[a-z]{4,}$")).groupBy("right").agg(F.sum("mass").alias("mass"))
    found = edits.join(mass, "right").groupBy("wrong", "edited").agg(F.count("*").alias("words"), F.sum("n").alias("n"), F.sum("mass").alias("mass"))
    found = found.filter(F.col("words") >= WORDS).select("wrong", "edited", (F.col("n") / F.col("mass")).alias("rate"))
    return [Confusion(r["wrong"], r["edited"], r["rate"]) for r in gathered(found.orderBy("wrong", "edited"), "confusions of letters")]
