"""Hybrid retrieval: vector and keyword hits, noise filters, weighted fusion, reranking, context, prompt, answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config
from ..functions.text import fixed, preview
from ..session import small, written
from . import bm25, vector
from .plugins import Embedder, Reranker, code_point_embedding, extractive_answer, hyde

# Words in a second heading that mark summaries and exercises.
NOISE = "小结|习题|思考题"
# Fixed value: the marker where the context was cut.
CUT = "\n（部分内容省略）\n"
# Fixed value: what the answering model is told.
SYSTEM = """你是一个计算机课程的专业 AI 助教，请严格依据教材内容回答问题。

要求：
1. 不要编造教材没有的内容
2. 先给出简明答案（2-3句话），再给出详细解释
3. 如有多个要点，使用编号列表
4. 最后标注引用的章节

回答格式示例：
## 简明答案
[2-3句话的核心答案]

## 详细解释
1. ...
2. ...

## 参考章节
📚 [章节信息]
"""


def informative(h2: str = "section_h2", chars: str = "char_count") -> Column:
    """Neither a summary nor an exercise, and longer than the least size."""
    return ~F.coalesce(F.col(h2), F.lit("")).rlike(NOISE) & (F.col(chars) > config.MIN_HIT_CHARS)


def fuse(semantic: DataFrame, keyword: DataFrame, k: int, semantic_weight: float = config.WEIGHT_SEMANTIC, keyword_weight: float = config.WEIGHT_KEYWORD, dedupe: bool = False, by: tuple[str, ...] = ("query_id", "book_name")) -> DataFrame:
    """Hits of both methods by weighted similarity: query_id, book_name, key, method, similarity, final_score, place.

    Both: query_id, book_name, key, similarity, rank. A chunk that both found counts twice unless dedupe. Equal scores:
    vector hits first, then by rank.
    """
    one = semantic.select("query_id", "book_name", "key", "similarity", "rank", F.lit("embedding").alias("method"), (F.col("similarity") * semantic_weight).alias("final_score"), F.lit(0).alias("source"))
    two = keyword.select("query_id", "book_name", "key", "similarity", "rank", F.lit("bm25").alias("method"), (F.col("similarity") * keyword_weight).alias("final_score"), F.lit(1).alias("source"))
    both = one.unionByName(two).withColumn("final_score", F.round("final_score", 9))
    if dedupe:
        first = W.partitionBy("query_id", "book_name", "key").orderBy(F.desc("final_score"), "source", "rank")
        both = both.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
    place = W.partitionBy(*by).orderBy(F.desc("final_score"), "source", "rank", "book_name", "key")
    return both.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k).drop("source", "rank")


def _of_hits(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """The hits with the texts of their keys. The hits are written, as they tell which texts are wanted.

    Few hits go to all texts; else only the texts that a hit names are exchanged, unless even the keys are too many to broadcast.
    """
    hits = written(hits)
    if small(hits):
        return texts.join(F.broadcast(hits), "key")
    keys = hits.select("key").distinct()
    return (texts.join(F.broadcast(keys), "key", "left_semi") if small(keys, config.BROADCAST_KEYS) else texts).join(hits, "key")


def search(chunks: DataFrame, queries: DataFrame, k: int = config.TOP_K, embedder: Embedder | None = None, reranker: Reranker | None = None, prefilter: bool = False, dedupe: bool = False, scope: str = "book", embedding: str | None = None, write: Callable[[Column], Column] | None = None, instruction: str = "") -> DataFrame:
    """The best chunks of each query and book: query_id, book_name, key, method, similarity, final_score, place, [rerank_score].

    chunks: row_id, book_name, content, section_h2, char_count, [embedding]. queries: query_id, query, book_name (null: all
    books, each searched by itself). The vector branch fetches three times the candidates and filters them afterwards,
    or filters first with prefilter. It encodes the query after the instruction, or the passage that `write` makes of it.
    scope='book' gives k chunks of each query and book. scope='all' gives k chunks of each query: those of its book, or,
    where it names none, the best of max(1, k // 2) chunks of each book. Questions that are alike are searched once.
    """
    alike = queries.select("query_id", "query", "book_name", F.min("query_id").over(W.partitionBy("query", "book_name")).alias("one"))
    queries = alike.filter("query_id = one").drop("one")
    twins = alike.select(F.col("query_id").alias("twin"), F.col("one").alias("query_id"))
    asked = hyde(queries.select("query_id", "query", "book_name"), write, instruction)
    free = F.col("book_name").isNull()
    per_book = F.when(free, F.lit(max(1, k // 2))).otherwise(F.lit(k)) if scope == "all" else F.lit(k)
    times = config.OVERFETCH_RERANK if reranker else 1
    limits = queries.select("query_id", per_book.alias("per_book"), free.alias("free"))
    limits = F.broadcast(limits) if small(limits, config.BROADCAST_KEYS) else limits
    embed = embedder or code_point_embedding()
    held = chunks.withColumnRenamed("row_id", "key")
    with_vectors = held.select("key", "book_name", (F.col(embedding) if embedding else embed(F.col("content"))).alias("embedding"), F.coalesce(informative(), F.lit(False)).alias("informative")).filter("book_name IS NOT NULL")
    if prefilter:
        with_vectors = with_vectors.filter("informative")
    near = vector.nearest(with_vectors, asked.select("query_id", "book_name", embed(F.col("query_text")).alias("embedding")), k * times * config.OVERFETCH_VECTOR, "key", "embedding", "book_name", query_group="book_name", carry=("informative",))
    near = near.join(limits, "query_id").filter(F.col("informative") & (F.col("rank") <= F.col("per_book") * times * config.OVERFETCH_VECTOR))
    index = bm25.build(held, "book_name", "key", "content")
    words = queries.select("query_id", F.col("book_name").alias("grp"), bm25.tokens(F.col("query")).alias("words"))
    key_hits = bm25.top(index, words, k * times).withColumnRenamed("grp", "book_name")
    key_hits = key_hits.join(limits, "query_id").filter(F.col("rank") <= F.col("per_book") * times).withColumn("similarity", F.col("score") * config.BM25_SCALE)
    hits = fuse(near, key_hits, k * times, dedupe=dedupe).join(limits, "query_id").filter(F.col("place") <= F.col("per_book") * times)
    order = F.desc("final_score")
    if reranker:
        # the queries join before the texts do, so that texts are exchanged once at most
        scored = _of_hits(held.select("key", "content"), hits.join(queries.select("query_id", "query"), "query_id")).withColumn("rerank_score", F.round(reranker(F.col("query"), F.col("content")), 9)).drop("content", "query")
        place = W.partitionBy("query_id", "book_name").orderBy(F.desc("rerank_score"), "place")
        hits, order = scored.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= F.col("per_book")), F.desc("rerank_score")
    if scope == "all":
        place = W.partitionBy("query_id").orderBy(order, "place", "book_name", "key", "method")
        hits = hits.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k)
    hits = hits.drop("per_book", "free").join(F.broadcast(twins) if small(twins, config.BROADCAST_KEYS) else twins, "query_id")
    return hits.withColumn("query_id", F.col("twin")).drop("twin")


def block(place: Column, similarity: Column, method: Column, book: Column, chapter: Column, h2: Column, content: Column) -> Column:
    """One hit as it stands in the context."""
    blank = F.lit("")
    return F.concat(
        F.lit("\n【参考资料 "), place.cast("string"), F.lit("】（相似度: "), fixed(similarity, 3), F.lit(" | 方法: "), method, F.lit("）\n 教材: "), book,
        F.lit("\n 章节: "), F.coalesce(chapter, blank), F.lit(" - "), F.coalesce(h2, blank), F.lit("\n 内容:\n"), F.coalesce(content, blank), F.lit("\n---\n"),
    )


def pack_context(hits: DataFrame, limit: int = config.CONTEXT_CHARS) -> DataFrame:
    """query_id, context, used: blocks in order until the first that doesn't fit, then the marker.

    hits: query_id, place, block. The running length only grows, so the blocks kept are those up to the limit.
    """
    run = W.partitionBy("query_id").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    fits = hits.withColumn("fits", F.sum(F.length("block")).over(run) <= limit)
    kept = F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("place", "block"))))
    return fits.groupBy("query_id").agg(kept.alias("kept"), F.count_if(~F.col("fits")).alias("cut")).select(
        "query_id", F.concat(F.array_join(F.transform("kept", lambda x: x["block"]), ""), F.when(F.col("cut") > 0, F.lit(CUT)).otherwise(F.lit(""))).alias("context"), F.size("kept").alias("used")
    )


def prompt(query: Column, context: Column) -> Column:
    return F.concat(F.lit(SYSTEM), F.lit("\n\n## 学生问题\n"), query, F.lit("\n\n## 相关教材内容\n"), context, F.lit("\n\n请开始你的回答：\n"))


def with_texts(chunks: DataFrame, hits: DataFrame) -> DataFrame:
    """The hits with their texts."""
    return _of_hits(chunks.select(F.col("row_id").alias("key"), "chapter", "section_h2", "content"), hits)


#: The columns of a hit in the answers of ask().
HIT = ("place", "book_name", "key", "method", "similarity", "final_score", "chapter", "section_h2", "content")


def ask(chunks: DataFrame, queries: DataFrame, k: int = config.TOP_K, limit: int = config.CONTEXT_CHARS, answerer: Callable[[DataFrame], DataFrame] | None = None, **how) -> DataFrame:
    """query_id, query, hits, context, prompt, answer, model, tokens, sources, success.

    Retrieval, context, prompt and answer. hits: an array of structs in order; sources: the chapters of the first three.
    answerer: adds llm_response to a table with prompt and context, such as plugins.generate; by default the beginning
    of the context is the answer. Queries without a hit have an empty context and prompt and an unsuccessful answer, and
    aren't sent to the answerer.
    """
    hits = search(chunks, queries, k, scope="all", **how)
    blocks = with_texts(chunks, hits).withColumn("block", block(F.col("place"), F.col("similarity"), F.col("method"), F.col("book_name"), F.col("chapter"), F.col("section_h2"), F.col("content")))
    ordered = F.array_sort(F.collect_list(F.struct(*HIT)))
    found = blocks.groupBy("query_id").agg(ordered.alias("hits"))
    sources = F.transform(F.slice("hits", 1, 3), lambda h: F.concat_ws(" > ", h["book_name"], F.nullif(h["chapter"], F.lit("")), F.nullif(h["section_h2"], F.lit(""))))
    packed = pack_context(blocks).join(found, "query_id").join(queries.select("query_id", "query"), "query_id")
    ready = packed.select("query_id", "hits", "context", prompt(F.col("query"), F.col("context")).alias("prompt"), sources.alias("sources"))
    answered = answerer(ready) if answerer else ready.withColumn("llm_response", extractive_answer(F.col("prompt"), F.col("context")))
    answered = answered.select("query_id", "hits", "context", "prompt", "sources", F.col("llm_response.answer").alias("answer"), F.col("llm_response.model").alias("model"), F.col("llm_response.tokens").alias("tokens"), F.col("llm_response.success").alias("success"))
    out = queries.select("query_id", "query").join(answered, "query_id", "left")
    blank = F.lit("")
    none = F.array().cast(answered.schema["hits"].dataType)
    return out.select("query_id", "query", F.coalesce("hits", none).alias("hits"), F.coalesce("context", blank).alias("context"), F.coalesce("prompt", blank).alias("prompt"), "answer", "model", "tokens", "sources", F.coalesce("success", F.lit(False)).alias("success"))


def answer(chunks: DataFrame, queries: DataFrame, k: int = config.TOP_K, **how) -> DataFrame:
    """The older name of ask() without a model: hits, context and prompt; the answer is null and success false."""
    out = ask(chunks, queries, k, **how)
    return out.withColumn("answer", F.lit(None).cast("string")).withColumn("success", F.lit(False))


def successful(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The answers that succeeded, and those kept aside; a null success is none."""
    ok = F.coalesce(F.col("success"), F.lit(False))
    return answers.filter(ok), answers.filter(~ok)


def display(hits: DataFrame) -> DataFrame:
    """query_id, place, similarity, method, book_name, section, preview, flags: hits as they are shown.

    hits: the columns of search and chapter, section_h2, content, has_code, has_image. Missing texts are shown empty.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    flags = F.concat_ws(" | ", F.when(F.col("has_code"), F.lit("💻 含代码")), F.when(F.col("has_image"), F.lit("🖼️ 含图片")))
    return hits.select("query_id", "place", fixed(F.col("similarity"), 4).alias("similarity"), "method", "book_name", F.concat(text("chapter"), F.lit(" | "), text("section_h2")).alias("section"), preview(text("content"), 150).alias("preview"), flags.alias("flags"))


def top_sources(hits: DataFrame, n: int = 3) -> DataFrame:
    """The first n hits of each query."""
    first = W.partitionBy("query_id").orderBy("place", F.desc("final_score"), "book_name", "key")
    return hits.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= n).drop("_n")
