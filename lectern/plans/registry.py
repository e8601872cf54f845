"""Queries over the pipeline's operators, each over its whole tables.

Searches take all questions, or every question whose id is divisible by 20 (`asked`), against all chunks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config
from ..functions import markdown as M
from ..functions import text as X
from ..operators import bm25, hybrid, metrics, packing, plugins, quality, sections, vector
from ..session import small, spread, table
from ..sources import catalog, files

Query = Callable[[SparkSession, str], DataFrame]


def _spaced(c: Column) -> Column:
    """Paragraphs parted by blank lines, as the parser writes them."""
    return F.replace(c, F.lit("\n"), F.lit("\n\n"))


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "chunks"))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    rows = spread(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return rows.withColumn("doc_id", F.col("doc_id").cast("string")).filter("text IS NOT NULL")


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """query_id, query, book_name: all questions; those registered twice count once."""
    rows = table(spark, folder, "eval_questions").filter("question IS NOT NULL")
    return rows.groupBy(F.col("question_id").alias("query_id")).agg(F.min("question").alias("query"), F.min("book_name").alias("book_name"))


def asked(spark: SparkSession, folder: str) -> DataFrame:
    """The questions whose id is divisible by 20."""
    return questions(spark, folder).filter("query_id % 20 = 0")


def _step(name: str, spaced: bool) -> Query:
    step = dict(M.STEPS)[name]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        c = _spaced(F.col("content")) if spaced else F.col("content")
        return _chunks(spark, folder).select("row_id", step(c).alias("text"))

    return run


#: The cleaning steps as queries; whether the text comes with blank lines between paragraphs.
CLEANING = {
    "garbage": False, "join_chapter": True, "image": False, "after_image": True, "isolated_han": True, "running_titles": True, "isolated_number": True,
    "isolated_chapter": True, "after_heading": True, "fragments": True, "headings": False, "circled": False, "dot": False, "entities": False,
    "underscore": False, "code": False, "blank": True, "spacing": False, "trim": True,
}


def clean_all(spark, folder):
    return _chunks(spark, folder).select("row_id", M.clean(_spaced(F.col("content"))).alias("text"))


def cleaning_counts(spark, folder):
    return _chunks(spark, folder).select("row_id", M.cleaning_counts(_spaced(F.col("content"))).alias("n")).select("row_id", "n.*")


def title_level(spark, folder):
    return _chunks(spark, folder).select("row_id", M.title_level(F.col("section_h2")).alias("level"), M.title_valid(F.col("section_h2")).alias("valid"))


def section_parse(spark, folder):
    parsed = sections.parse_sections(_documents(spark, folder))
    return parsed.select("doc_id", F.row_number().over(W.partitionBy("doc_id").orderBy("pos")).alias("n"), "level", "title", "content")


def heading_context(spark, folder):
    carried = sections.heading_context(sections.parse_sections(_documents(spark, folder)))
    return carried.select("doc_id", F.row_number().over(W.partitionBy("doc_id").orderBy("pos")).alias("n"), "chapter", "section_h2", "section_h3", "section_h4", "chapter_num")


def sentence_pack(spark, folder):
    rows = _chunks(spark, folder).filter(f"length(content) > {config.MAX_CHUNK}")
    return rows.select("row_id", F.posexplode(packing.pack_sentences(F.col("content"))).alias("piece", "text"))


def section_chunks(spark, folder):
    return packing.section_chunks(sections.parse_sections(_documents(spark, folder))).select("doc_id", "ordinal", "chunk_id", "content", "char_count", "has_code", "has_image")


def chunk_documents(spark, folder):
    return packing.chunk_documents(_documents(spark, folder)).select("doc_id", "ordinal", "chunk_id", "chapter", "section_h2", "content", "level", "char_count", "has_code", "has_image")


def small_merge(spark, folder):
    """Merging over the stored chunks, a file a document, in order of loading."""
    rows = _chunks(spark, folder).filter("stem IS NOT NULL AND content IS NOT NULL").withColumn("char_count", F.length("content"))
    rows = rows.select(F.col("stem").alias("doc_id"), F.col("row_id").alias("ordinal"), "chunk_id", "chapter", "section_h2", "section_h3", "section_h4", "content", "level", "char_count", "has_code", "has_image")
    return packing.merge_small(rows).select("doc_id", "ordinal", "chunk_id", "content", "char_count", "has_code", "has_image")


def chunk_stats(spark, folder):
    out = quality.chunk_stats(_chunks(spark, folder))
    return out.withColumn("mean_chars", F.round("mean_chars", 6))


def chunk_level_hist(spark, folder):
    return quality.level_histogram(_chunks(spark, folder))


def chunk_flags(spark, folder):
    code, image = packing.flags(F.col("content"))
    return _chunks(spark, folder).select("row_id", code.alias("code"), image.alias("image"))


def markdown_stats(spark, folder):
    return _chunks(spark, folder).select("row_id", quality.markdown_stats(_spaced(F.col("content"))).alias("s")).select("row_id", "s.*")


def parse_report(spark, folder):
    report = quality.parse_report(F.col("text"))
    return _documents(spark, folder).select("doc_id", report.alias("r")).select("doc_id", "r.*", F.concat_ws(",", quality.parse_issues(F.col("r"))).alias("issues"))


def _issues(spark, folder):
    return _chunks(spark, folder).select("row_id", quality.chunk_issues(F.col("content"), F.col("char_count"), F.col("has_code")).alias("issues"))


def chunk_issues(spark, folder):
    return _issues(spark, folder).select("row_id", F.explode("issues").alias("issue"))


def issue_report(spark, folder):
    return quality.issue_report(_issues(spark, folder))


def quality_grade(spark, folder):
    return quality.overall_grade(_issues(spark, folder))


def label_histogram(spark, folder):
    return quality.label_histogram(table(spark, folder, "documents").filter("lang IS NOT NULL"), "lang")


def _scores(spark, folder):
    """All scores, those without a pair too."""
    return table(spark, folder, "eval_scores").select(F.col("pair_id").cast("bigint").alias("pair_id"), *metrics.METRICS)


def metric_means(spark, folder):
    return metrics.metric_means(_scores(spark, folder)).withColumn("mean", F.round("mean", 6))


def metric_failures(spark, folder):
    return metrics.failed_judgements(_scores(spark, folder))


def metric_grade(spark, folder):
    means = metrics.metric_means(_scores(spark, folder)).withColumn("mean", F.round("mean", 6))
    return means.select("metric", metrics.grade(F.col("mean")).alias("grade"), metrics.bar(F.col("mean")).alias("bar"), F.bround("mean", 3).alias("shown"), X.fixed(F.col("mean"), 4).alias("printed"))


def metric_delta(spark, folder):
    runs = table(spark, folder, "qa_comparison").select("pair_id", (F.col("run_name") == "baseline").alias("base")).filter("base IS NOT NULL")
    scored = _scores(spark, folder).filter("pair_id IS NOT NULL").join(runs, "pair_id")
    ours, base = metrics.metric_means(scored.filter("NOT base")), metrics.metric_means(scored.filter("base"))
    both = metrics.compare(ours, base)
    return both.select("metric", *[F.round(c, 6).alias(c) for c in ("ours", "baseline", "delta")])


def chart_frame(spark, folder):
    return table(spark, folder, "eval_scores").select("pair_id", metrics.chart_label(F.col("user_input")).alias("label"))


def lexical_overlap(spark, folder):
    return table(spark, folder, "qa_comparison").select("pair_id", F.round(metrics.lexical_score(F.col("answer"), F.col("ground_truth")), 6).alias("score"))


def knn_topk(spark, folder):
    rows = table(spark, folder, "embeddings")
    queries = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector.nearest(rows, queries, config.TOP_K).select("query_id", "vec_id", "similarity", "rank")


def knn_per_label(spark, folder):
    rows = table(spark, folder, "embeddings")
    queries = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector.nearest(rows, queries, 3, group="label").select("query_id", "label", "vec_id", "similarity", "rank")


def knn_prefilter(spark, folder):
    rows = table(spark, folder, "embeddings")
    queries = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector.nearest(rows.filter("label < 5"), queries, config.TOP_K).select("query_id", "vec_id", "similarity", "rank")


def knn_postfilter(spark, folder):
    rows = table(spark, folder, "embeddings")
    queries = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    wide = vector.nearest(rows, queries, config.TOP_K * config.OVERFETCH_VECTOR)
    kept = wide.join(rows.filter("label < 5").select("vec_id"), "vec_id").drop("rank")
    place = W.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return kept.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= config.TOP_K).select("query_id", "vec_id", "similarity", "rank")


def context_precision(spark, folder):
    """Neighbours with the label of the query count as relevant."""
    rows = table(spark, folder, "embeddings")
    found = knn_topk(spark, folder)
    labels = rows.select("vec_id", "label")
    judged = found.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    out = metrics.context_precision(judged.withColumn("relevant", F.col("label") == F.col("own")))
    return out.withColumn("context_precision", F.round("context_precision", 6))


def _index(spark, folder):
    return bm25.build(_chunks(spark, folder), "book_name", "row_id", "content")


def _words(spark, folder, scope=True):
    return asked(spark, folder).select("query_id", (F.col("book_name") if scope else F.lit(None).cast("string")).alias("grp"), bm25.tokens(F.col("query")).alias("words"))


def bm25_term_stats(spark, folder):
    return _index(spark, folder).terms.select("grp", "term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark, folder):
    found = bm25.top(_index(spark, folder), _words(spark, folder, False), config.TOP_K, per_group=False, digits=6)
    return found.select("query_id", F.col("grp").alias("book_name"), F.col("key").alias("row_id"), "score", "rank")


def bm25_topk_per_book(spark, folder):
    found = bm25.top(_index(spark, folder), _words(spark, folder), config.TOP_K, digits=6)
    return found.select("query_id", F.col("grp").alias("book_name"), F.col("key").alias("row_id"), "score", "rank")


def _found(spark, folder, queries=asked, **how):
    return hybrid.search(_chunks(spark, folder), queries(spark, folder), config.TOP_K, **how)


def hybrid_fusion(spark, folder):
    """The question's own book, or every book where it names none."""
    return _found(spark, folder, questions).select("query_id", "book_name", F.col("key").alias("row_id"), "method", F.round("final_score", 6).alias("final_score"), F.col("place").alias("rank"))


def hybrid_dedupe(spark, folder):
    return _found(spark, folder, questions, dedupe=True).select("query_id", "book_name", F.col("key").alias("row_id"), "method", F.round("final_score", 6).alias("final_score"), F.col("place").alias("rank"))


def hybrid_prefilter(spark, folder):
    return _found(spark, folder, questions, prefilter=True).select("query_id", "book_name", F.col("key").alias("row_id"), "method", F.round("final_score", 6).alias("final_score"), F.col("place").alias("rank"))


def hybrid_cross_book(spark, folder):
    return _found(spark, folder, questions, scope="all").select("query_id", "book_name", F.col("key").alias("row_id"), "method", F.round("final_score", 6).alias("final_score"), F.col("place").alias("rank"))


def hybrid_rerank(spark, folder):
    found = _found(spark, folder, reranker=plugins.overlap_reranker())
    return found.select("query_id", "book_name", F.col("key").alias("row_id"), "method", F.round("rerank_score", 6).alias("rerank_score"), F.col("place").alias("rank"))


def hybrid_instruction(spark, folder):
    """The vector branch encodes the query after the instruction."""
    return _found(spark, folder, questions, instruction=config.INSTRUCTION).select("query_id", "book_name", F.col("key").alias("row_id"), "method", F.round("final_score", 6).alias("final_score"), F.col("place").alias("rank"))


def hybrid_hyde(spark, folder):
    """The vector branch encodes a hypothetical passage; here a frame around the query stands where a model would write one."""
    return _found(spark, folder, questions, write=plugins.framed_passage).select("query_id", "book_name", F.col("key").alias("row_id"), "method", F.round("final_score", 6).alias("final_score"), F.col("place").alias("rank"))


def context_pack(spark, folder):
    """The chunks of each file in order, as far as they fit."""
    rows = _chunks(spark, folder).filter("stem IS NOT NULL")
    place = F.row_number().over(W.partitionBy("stem").orderBy("row_id"))
    blocks = rows.withColumn("place", place).select(
        F.col("stem").alias("query_id"), "place", hybrid.block(F.col("place"), F.lit(0.5), F.lit("embedding"), F.coalesce("book_name", F.lit("")), F.col("chapter"), F.col("section_h2"), F.col("content")).alias("block")
    )
    packed = hybrid.pack_context(blocks)
    return packed.select(F.col("query_id").alias("stem"), F.md5(F.col("context")).alias("context_md5"), F.length("context").alias("chars"), "used")


def prompt_build(spark, folder):
    return table(spark, folder, "qa_comparison").select("pair_id", F.md5(hybrid.prompt(F.coalesce("question", F.lit("")), F.coalesce("ground_truth", F.lit("")))).alias("prompt_md5"))


def ask(spark, folder):
    out = hybrid.ask(_chunks(spark, folder), questions(spark, folder))
    shown = F.transform("hits", lambda h: F.concat_ws(":", h["place"].cast("string"), h["book_name"], h["key"].cast("string"), h["method"]))
    return out.select("query_id", F.coalesce(F.array_join(shown, "|"), F.lit("")).alias("hits"), F.md5("context").alias("context_md5"), F.md5("prompt").alias("prompt_md5"), "answer", "model", F.col("tokens.total").alias("tokens"), F.array_join("sources", "|").alias("sources"), "success")


def answers_kept(spark, folder):
    """The answers that succeeded."""
    return hybrid.successful(hybrid.ask(_chunks(spark, folder), asked(spark, folder)))[0].select("query_id", "answer")


def answers_aside(spark, folder):
    """The questions whose answers failed, kept aside."""
    return hybrid.successful(hybrid.ask(_chunks(spark, folder), questions(spark, folder)))[1].select("query_id")


def _eval_hits(spark, folder):
    hits = hybrid.search(_chunks(spark, folder), questions(spark, folder), config.EVAL_TOP_K, scope="all")
    return hybrid.with_texts(_chunks(spark, folder), hits)


def _truths(spark, folder):
    return table(spark, folder, "eval_questions").groupBy(F.col("question_id").alias("query_id")).agg(F.min("ground_truth").alias("ground_truth"))


def eval_dataset(spark, folder):
    """Question, contexts and truth, as evaluation wants them."""
    found = metrics.contexts(_eval_hits(spark, folder))
    out = questions(spark, folder).join(found, "query_id", "left").join(_truths(spark, folder), "query_id", "left")
    return out.select("query_id", "query", "book_name", "ground_truth", F.coalesce(F.size("contexts"), F.lit(0)).alias("contexts"), F.md5(F.coalesce(F.array_join("contexts", "\n\n"), F.lit(""))).alias("contexts_md5"))


def eval_baseline(spark, folder):
    """The records of an evaluation without retrieval: one empty context each."""
    out = metrics.baseline_contexts(asked(spark, folder)).join(_truths(spark, folder), "query_id", "left")
    return out.select("query_id", "query", "ground_truth", F.size("contexts").alias("contexts"), F.array_join("contexts", "").alias("text"))


def _verdict_pairs(spark, folder):
    return table(spark, folder, "qa_comparison").select("pair_id", "question", "answer", "ground_truth")


def faithfulness(spark, folder):
    """The share of an answer's sentences whose tokens the truth holds at least by half; the truth stands for the context."""
    verdicts = metrics.supported(F.col("answer"), F.col("ground_truth"))
    return _verdict_pairs(spark, folder).select("pair_id", F.round(metrics.verdict_share(verdicts), 6).alias("faithfulness"))


def context_recall(spark, folder):
    """The share of the truth's sentences whose tokens the answer holds at least by half; the answer stands for the context."""
    verdicts = metrics.supported(F.col("ground_truth"), F.col("answer"))
    return _verdict_pairs(spark, folder).select("pair_id", F.round(metrics.verdict_share(verdicts), 6).alias("context_recall"))


def answer_relevancy(spark, folder):
    """The cosine of the question and the answer; the answer stands for the questions made from it."""
    embed = plugins.code_point_embedding()
    held = _verdict_pairs(spark, folder).filter("question IS NOT NULL AND answer IS NOT NULL").select("pair_id", embed(F.col("question")).alias("q"), embed(F.col("answer")).alias("a"))
    return held.select("pair_id", F.round(metrics.mean_similarity(F.col("q"), F.array("a")), 6).alias("answer_relevancy"))


def top_sources(spark, folder):
    hits = _found(spark, folder, questions, scope="all")
    return hybrid.top_sources(hits).select("query_id", "place", "book_name", F.col("key").alias("row_id"))


def result_display(spark, folder):
    """The chunks of the questions' own books as hits of one kind, as they are shown."""
    rows = _chunks(spark, folder).filter("book_name IS NOT NULL").select(F.col("row_id").alias("query_id"), F.lit(1).alias("place"), F.lit(0.5).alias("similarity"), F.lit("embedding").alias("method"), "book_name", "chapter", "section_h2", "content", "has_code", "has_image")
    return hybrid.display(rows)


def point_lookup(spark, folder):
    """The chunks that are asked for by id: here the ids of the asked questions."""
    return catalog.lookup(_chunks(spark, folder), asked(spark, folder).select(F.col("query_id").alias("row_id")), "row_id").select("row_id", "book_name", "chunk_id", F.md5("content").alias("content_md5"))


def collection_counts(spark, folder):
    return catalog.counts(_chunks(spark, folder).filter("book_name IS NOT NULL"))


def load_throughput(spark, folder):
    """Chunks loaded in each book, between its first and its last load."""
    spans = _chunks(spark, folder).filter("book_name IS NOT NULL").groupBy("book_name").agg(F.count("*").alias("chunks"), ((F.max(F.unix_micros(F.col("loaded_at").cast("timestamp"))) - F.min(F.unix_micros(F.col("loaded_at").cast("timestamp")))) / 1e6).alias("seconds"))
    rate = quality.throughput(F.col("chunks").cast("double"), F.col("seconds")).alias("t")
    return spans.select("book_name", "chunks", rate).select("book_name", "chunks", *[F.round(f"t.{c}", 6).alias(c) for c in ("seconds", "seconds_per_row", "rows_per_second")])


def collection_sample(spark, folder):
    return catalog.samples(_chunks(spark, folder).filter("book_name IS NOT NULL")).select("book_name", "row_id", X.preview(F.col("content"), 80).alias("preview"))


def catalog_list(spark, folder):
    return catalog.names(table(spark, folder, "collections")).select("name", catalog.book_of(F.col("name")).alias("book_name"))


def catalog_with_all(spark, folder):
    return catalog.with_all(table(spark, folder, "collections"), "全部教材")


def book_exists(spark, folder):
    return catalog.existing(table(spark, folder, "eval_questions"), table(spark, folder, "collections")).select("question_id", "book_name")


def book_missing(spark, folder):
    return catalog.missing(table(spark, folder, "eval_questions"), table(spark, folder, "collections")).select("question_id", "question")


def label_lookup(spark, folder):
    labels = table(spark, folder, "collections").select("book_name", "label")
    joined = table(spark, folder, "eval_questions").join(F.broadcast(labels) if small(labels) else labels, "book_name", "left")
    return joined.select("question_id", "book_name", X.book_label(F.col("book_name"), F.col("label")).alias("label"))


def section_path(spark, folder):
    return _chunks(spark, folder).select("row_id", X.section_path(F.col("chapter"), F.col("section_h2"), F.col("section_h3")).alias("path"))


def snippet(spark, folder):
    return _chunks(spark, folder).select("row_id", X.snippet(F.col("content")).alias("snippet"))


def stems(spark, folder):
    return _chunks(spark, folder).select("row_id", X.chunks_name(F.col("stem")).alias("name"), X.stem(X.chunks_name(F.col("stem"))).alias("stem"), X.collection_name(F.col("stem")).alias("collection"))


def selection(spark, folder):
    """Selections made from the question ids, out of ten."""
    text = F.concat_ws(",", (F.col("question_id") % 12).cast("string"), F.concat((F.col("question_id") % 5 + 1).cast("string"), F.lit("-"), (F.col("question_id") % 9 + 1).cast("string")))
    return table(spark, folder, "eval_questions").select("question_id", F.concat_ws(",", X.selection(text, 10).cast("array<string>")).alias("chosen"))


def page_segments(spark, folder):
    """The row number stands for a document's pages."""
    return _chunks(spark, folder).select("row_id", F.inline(files.segments((F.col("row_id") % 450 + 1).cast("int"))))


def chunk_preview(spark, folder):
    filled = _chunks(spark, folder).fillna("", ["content", "chunk_id", "chapter", "section_h2", "section_h3", "section_h4"])
    return files.chunk_preview(filled)


def latest_load(spark, folder):
    """Pieces that were loaded again, once."""
    return catalog.latest(_chunks(spark, folder).filter("stem IS NOT NULL AND chunk_id IS NOT NULL"), ("stem", "chunk_id"), "row_id").select("stem", "chunk_id", "row_id")


def messages(spark, folder):
    """Question and answer of each pair as chat messages."""
    one = lambda role, c: F.struct(F.lit(role).alias("role"), F.coalesce(F.col(c), F.lit("")).alias("content"))
    pairs = table(spark, folder, "qa_comparison").select("pair_id", F.array(one("user", "question"), one("assistant", "answer")).alias("m"))
    return pairs.select("pair_id", F.to_json("m").alias("messages"))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return hybrid_fusion(spark, folder)


def queries() -> dict[str, Query]:
    steps = {f"clean_{name}": _step(name, spaced) for name, spaced in CLEANING.items()}
    named = (
        clean_all, cleaning_counts, title_level, section_parse, heading_context, sentence_pack, section_chunks, chunk_documents, small_merge, chunk_stats,
        chunk_level_hist, chunk_flags, markdown_stats, parse_report, chunk_issues, issue_report, quality_grade, label_histogram, metric_means, metric_failures,
        metric_grade, metric_delta, chart_frame, lexical_overlap, knn_topk, knn_per_label, knn_prefilter, knn_postfilter, context_precision, bm25_term_stats,
        bm25_topk, bm25_topk_per_book, hybrid_fusion, hybrid_dedupe, hybrid_prefilter, hybrid_cross_book, hybrid_rerank, hybrid_instruction, hybrid_hyde, context_pack, prompt_build, ask,
        answers_kept, answers_aside, eval_dataset, eval_baseline, load_throughput, faithfulness, context_recall, answer_relevancy, top_sources, result_display, point_lookup, collection_counts, collection_sample, catalog_list, catalog_with_all, book_exists, book_missing, label_lookup, section_path, snippet,
        stems, selection, page_segments, chunk_preview, latest_load, messages,
    )
    return steps | {f.__name__: f for f in named}
