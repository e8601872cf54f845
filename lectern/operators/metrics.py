"""Evaluation of answers and of retrieval: arithmetic over verdicts, scores and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config
from .bm25 import tokens

METRICS = ("faithfulness", "context_precision", "answer_relevancy", "context_recall")
# Fixed value: keeps the precision of answers without a relevant chunk finite.
EPSILON = 1e-10


def known(c: Column) -> Column:
    """NaN, a failed judgement, as null."""
    return F.nanvl(c, F.lit(None).cast("double"))


def long_scores(scores: DataFrame, key: str = "pair_id", metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """key, metric, score (null where the judgement failed)."""
    return scores.select(key, *[known(F.col(m)).alias(m) for m in metrics]).unpivot([key], list(metrics), "metric", "score")


def metric_means(scores: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """metric, mean, judged, failed: means skip failed judgements."""
    flat = long_scores(scores.withColumn("_one", F.lit(1)), "_one", metrics)
    return flat.groupBy("metric").agg(F.avg("score").alias("mean"), F.count("score").alias("judged"), F.count_if(F.col("score").isNull()).alias("failed"))


def failed_judgements(scores: DataFrame, key: str = "pair_id") -> DataFrame:
    return long_scores(scores, key).filter("score IS NULL").select(key, "metric")


def grade(score: Column) -> Column:
    out = F.lit(config.GRADE_LOW)
    for least, name in reversed(config.GRADES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def bar(score: Column, cells: int = 30) -> Column:
    n = F.floor(score * cells).cast("int")
    return F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), F.lit(cells) - n))


def compare(ours: DataFrame, baseline: DataFrame) -> DataFrame:
    """metric, ours, baseline, delta: means of two runs side by side, metrics of either kept."""
    a = ours.select("metric", F.col("mean").alias("ours"))
    b = baseline.select("metric", F.col("mean").alias("baseline"))
    return a.join(b, "metric", "full").withColumn("delta", F.col("ours") - F.col("baseline"))


def context_precision(ranked: DataFrame, query: str = "query_id", rank: str = "rank", relevant: str = "relevant") -> DataFrame:
    """query, precision: mean of precision at each relevant rank."""
    run = W.partitionBy(query).orderBy(rank).rowsBetween(W.unboundedPreceding, 0)
    v = F.col(relevant).cast("double")
    at = ranked.withColumn("p", F.sum(v).over(run) / F.col(rank) * v)
    return at.groupBy(query).agg((F.sum("p") / (F.sum(v) + EPSILON)).alias("context_precision"))


def verdict_share(verdicts: Column) -> Column:
    """The share of true verdicts, null without any: faithfulness over claims, recall over sentences of the truth."""
    return F.when(F.size(verdicts) > 0, F.size(F.filter(verdicts, lambda x: x)) / F.size(verdicts))


def supported(claims: Column, context: Column) -> Column:
    """A verdict for each sentence of a text: whether the context holds at least half of its distinct tokens.

    Stands where a judging model would. Sentences without a token have no verdict; null where either text is null.
    """
    held = F.array_distinct(tokens(context))
    sentences = F.filter(F.transform(F.regexp_extract_all(claims, F.lit("[^。！？\n]+"), F.lit(0)), lambda s: F.array_distinct(tokens(s))), lambda t: F.size(t) > 0)
    return F.when(context.isNotNull(), F.transform(sentences, lambda t: F.size(F.array_intersect(t, held)) * 2 >= F.size(t)))


def mean_similarity(a: Column, vectors: Column) -> Column:
    """Mean cosine of a vector and those of an array: relevancy of an answer by questions made from it."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    # a vector of zeros is like nothing
    each = F.transform(vectors, lambda v: F.coalesce(dot(a, v) / F.nullif(F.sqrt(dot(a, a) * dot(v, v)), F.lit(0.0)), F.lit(0.0)))
    return F.aggregate(each, F.lit(0.0), lambda s, v: s + v) / F.size(vectors)


def lexical_score(answer: Column, truth: Column) -> Column:
    """0.4 Jaccard of the tokens + 0.4 share of the truth's tokens covered + 0.2 likeness of the lengths.

    Tokens are the retrieval's; keywords are the distinct tokens of the truth; lengths compare as shorter over longer.
    Null where either text is null, 0 where both are empty.
    """
    a, t = F.array_distinct(tokens(answer)), F.array_distinct(tokens(truth))
    both = F.size(F.array_intersect(a, t))
    jaccard = F.when(F.size(F.array_union(a, t)) > 0, both / F.size(F.array_union(a, t))).otherwise(0.0)
    covered = F.when(F.size(t) > 0, both / F.size(t)).otherwise(0.0)
    longer = F.greatest(F.length(answer), F.length(truth))
    lengths = F.when(longer > 0, F.least(F.length(answer), F.length(truth)) / longer).otherwise(0.0)
    return F.when(answer.isNotNull() & truth.isNotNull(), 0.4 * jaccard + 0.4 * covered + 0.2 * lengths)


def chosen_metrics(has_truth: bool, asked: tuple[str, ...] | None = None) -> tuple[str, ...]:
    """The metrics asked for, else all that the data allows: recall needs a ground truth."""
    return tuple(asked) if asked else tuple(m for m in METRICS if has_truth or m != "context_recall")


def chart_label(c: Column, chars: int = 20) -> Column:
    return F.when(F.length(c) > chars, F.concat(F.substring(c, 1, chars), F.lit("…"))).otherwise(c)


def contexts(hits: DataFrame) -> DataFrame:
    """query_id, contexts: the hits of each query in order, each with its place in the books before it."""
    one = F.concat(F.lit("["), F.col("book_name"), F.lit(" - "), F.coalesce("chapter", F.lit("")), F.lit(" - "), F.coalesce("section_h2", F.lit("")), F.lit("]\n"), F.coalesce("content", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("place", one.alias("text"))))
    return hits.groupBy("query_id").agg(F.transform(ordered, lambda x: x["text"]).alias("contexts"))


def baseline_contexts(queries: DataFrame) -> DataFrame:
    """Answers without retrieval are judged against one empty context."""
    return queries.withColumn("contexts", F.array(F.lit("")))
