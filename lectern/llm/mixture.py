"""Mixing sources to target weights by entropy balancing.

Documents get rates that differ as little as possible, in relative entropy, from using each once, while each source
reaches its share of the tokens. The dual of that problem is convex, with one multiplier a source: rates are
exponentially tilted by the tokens, exp(multiplier * tokens / mean), cut at the cap of repeats. Newton steps solve it;
each is one aggregation over all documents. Rates are then rounded into copies by systematic sampling.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .materialize import gathered, written
from .tokenizing import FOLDER, count_tokens

STEPS = 40
CLOSE = 1e-6
#: Documents of a source that are rounded in one line: a source may hold a third of all rows, so it has several lines.
LINE = 50_000


def token_sizes(df: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """Key, source, tokens of the documents whose source has a target; those without a token have nothing to give."""
    wanted = df.join(F.broadcast(targets.select(F.col("source").alias("t_source")).distinct()), F.col(f"`{source}`") == F.col("t_source"), "left_semi")
    sized = count_tokens(wanted, (key, source), text, tokenizer, folder)
    return written(sized.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), "tokens").filter("tokens > 0"))


def _newton(sized: DataFrame, goal: dict[str, float], cap: dict[str, int], mean: dict[str, float]) -> dict[str, float]:
    """The multiplier of each source: f(m) = sum of tokens * min(cap, exp(m * tokens / mean)) rises to the goal.

    A step that leaves the bracket found so far is replaced by its middle, so that it always ends.
    """
    spark = sized.sparkSession
    at = {s: 0.0 for s in goal}
    low, high = {s: -60.0 for s in goal}, {s: 60.0 for s in goal}
    left = set(goal)
    for step in range(STEPS + 1):
        if not left:
            break
        if step == STEPS:
            raise ValueError(f"no multiplier found in {STEPS} steps for {sorted(left)}")
        now = spark.createDataFrame([(s, at[s], float(cap[s]), mean[s]) for s in sorted(left)], "source STRING, m DOUBLE, cap DOUBLE, mean DOUBLE")
        joined = sized.join(F.broadcast(now), "source")
        x = F.col("tokens") / F.col("mean")
        free = F.exp(F.least(F.col("m") * x, F.lit(50.0)))
        rate = F.least(free, F.col("cap"))
        sums = joined.groupBy("source").agg(F.sum(F.col("tokens") * rate).alias("f"), F.sum(F.when(free < F.col("cap"), F.col("tokens") * x * rate).otherwise(0.0)).alias("d"))
        for r in sums.collect():  # one row a source
            s, f, d = r["source"], r["f"], r["d"]
            miss = f - goal[s]
            if abs(miss) <= CLOSE * goal[s]:
                left.discard(s)
                continue
            if miss > 0:
                high[s] = at[s]
            else:
                low[s] = at[s]
            step = at[s] - miss / d if d > 0 else math.inf
            at[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
    return at


def mix_sources(df: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", total: float | None = None, tokenizer: str = "byte_bpe_50k", folder: str = FOLDER) -> tuple[DataFrame, DataFrame]:
    """Copies of each document, and the shares reached.

    targets: source, weight, max_repeats; small, and collected. total: tokens of the mixture; by default the most at
    which no cap keeps a source that has documents from its share. Sources without documents get nothing; the weights
    of the others then count in proportion.
    First table: doc_id, source, tokens, copies, of the documents used at least once, at most max_repeats times each.
    Second table: source, weight, max_repeats, documents, tokens_available, documents_used, tokens_used, share.
    Null sources, sources without a target, null and empty texts aren't used; empty tables give an empty mixture. A
    source named twice in targets counts with the sum of its weights and the largest cap.
    """
    spark = df.sparkSession
    clean = targets.filter("source IS NOT NULL").groupBy("source").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    wants = {r["source"]: (r["weight"], r["max_repeats"]) for r in gathered(clean, "targets")}
    sized = token_sizes(df, clean, key, text, source, tokenizer, folder)
    have = {r["source"]: (r["documents"], r["tokens"]) for r in sized.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens")).collect()}
    live = {s: w for s, (w, cap) in wants.items() if s in have and w > 0 and cap > 0}
    if total is None:
        total = min((have[s][1] * wants[s][1] / (w / sum(live.values())) for s, w in live.items()), default=0.0)
    goal = {s: min(total * w / sum(live.values()), have[s][1] * wants[s][1]) for s, w in live.items()}
    mean = {s: have[s][1] / have[s][0] for s in live}
    full = {s for s in live if goal[s] >= have[s][1] * wants[s][1] * (1 - CLOSE)}
    at = _newton(sized, {s: g for s, g in goal.items() if s not in full}, {s: wants[s][1] for s in live}, mean) | {s: math.inf for s in full}
    rows = [(s, min(m, 1e6), float(wants[s][1]), mean[s], math.ceil(have[s][0] / LINE)) for s, m in at.items()]
    rates = spark.createDataFrame(rows, "source STRING, m DOUBLE, cap DOUBLE, mean DOUBLE, parts INT")
    rated = sized.join(F.broadcast(rates), "source").withColumn("rate", F.least(F.exp(F.least(F.col("m") * F.col("tokens") / F.col("mean"), F.lit(50.0))), F.col("cap")))
    rounded = _corrected(_rounded(rated), {s: g for s, g in goal.items()})
    copies = rounded.filter("copies > 0").select("doc_id", "source", "tokens", "copies")
    used = copies.groupBy("source").agg(F.count("*").alias("documents_used"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens_used"))
    rows = [(s, w, int(c), *have.get(s, (0, 0))) for s, (w, c) in wants.items()]
    shares = spark.createDataFrame(rows, "source STRING, weight DOUBLE, max_repeats INT, documents BIGINT, tokens_available BIGINT").join(used, "source", "left").na.fill(0, ["documents_used", "tokens_used"])
    whole = F.sum("tokens_used").over(W.partitionBy())  # one row a source
    return copies, shares.withColumn("share", F.when(whole > 0, F.col("tokens_used") / whole).otherwise(0.0))


def _rounded(rated: DataFrame) -> DataFrame:
    """Copies by systematic sampling: documents of like size lie side by side, their rates add up along the line, and
    each whole number passed is a copy. A part of a source keeps its sum of tokens to within about one document."""
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts"))
    line = W.partitionBy("source", "part").orderBy("tokens", "doc_id")
    fraction = F.col("rate") - F.floor("rate")
    start = F.pmod(F.xxhash64("source", "part"), F.lit(1 << 20)) / (1 << 20)
    out = rated.withColumn("part", part).withColumn("sum", F.round(F.sum(fraction).over(line.rowsBetween(W.unboundedPreceding, 0)) + start, 9))
    return out.withColumn("copies", (F.floor("rate") + F.floor("sum") - F.floor(F.round(F.col("sum") - fraction, 9))).cast("int"))


#: Passes that bring the rounded copies closer to the goals.
PASSES = 3


def _corrected(rounded: DataFrame, goal: dict[str, float]) -> DataFrame:
    """The copies after what rounding left over, a document or so a line, is made up for.

    Where a source has too few tokens, documents that fit what is missing get one copy more, long ones first; where it
    has too many, documents that fit lose one. Each pass leaves a source no farther from its goal. What is left over is
    less than the shortest document that can still change. Only the first line of a source is changed, at most LINE
    documents or so, so that no task gets more. Each pass is one aggregation, a row a source comes back.
    """
    spark, out = rounded.sparkSession, written(rounded.select("doc_id", "source", "tokens", "copies", "cap", "part"))
    for _ in range(PASSES):
        have = {r["source"]: r["used"] for r in out.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used")).collect()}
        off = [(s, g - have.get(s, 0)) for s, g in sorted(goal.items()) if abs(g - have.get(s, 0)) >= 1]
        if not off:
            break
        missing = spark.createDataFrame(off, "source STRING, missing DOUBLE")
        joined = out.join(F.broadcast(missing), "source", "left")
        can = (F.col("part") == 0) & (F.col("tokens") <= F.abs("missing")) & F.when(F.col("missing") > 0, F.col("copies") < F.col("cap")).otherwise(F.col("copies") > 0)
        able = joined.withColumn("able", F.coalesce(can, F.lit(False)))
        # documents that can't change stay out of the line
        line = W.partitionBy("source", "part", "able").orderBy(F.desc("tokens"), "doc_id").rowsBetween(W.unboundedPreceding, 0)
        fits = F.col("able") & (F.sum("tokens").over(line) <= F.abs("missing"))
        change = F.when(fits, F.signum("missing")).otherwise(0.0).cast("int")
        out = written(able.withColumn("change", change).select("doc_id", "source", "tokens", (F.col("copies") + F.col("change")).alias("copies"), "cap", "part"))
    return out
