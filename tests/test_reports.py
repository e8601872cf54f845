"""Quality reports, metrics, sources, catalog, streaming."""

import math

import pytest
from pyspark.sql import functions as F

from lectern.operators import metrics, quality
from lectern.schema import EVAL_SCORE
from lectern.sources import catalog, files
from lectern.streaming.ingest import ingest


def issues(spark, content, n, code=False):
    df = spark.createDataFrame([(content, n, code)], "c STRING, n INT, h BOOLEAN")
    return df.select(quality.chunk_issues(F.col("c"), F.col("n"), F.col("h")).alias("i")).first()["i"]


@pytest.mark.parametrize(("n", "want"), [(99, ["too_small"]), (100, []), (2000, []), (2001, ["too_large"])])
def test_sizes(spark, n, want):
    assert issues(spark, "x", n) == want


def test_issues(spark):
    assert issues(spark, "13 if(x)", 500) == ["has_line_numbers"]
    assert issues(spark, "```\n\n}\n```", 500, True) == ["code_truncated", "empty_code"]
    assert issues(spark, None, None, None) == []


@pytest.mark.parametrize(("rate", "want"), [(4.9, "excellent"), (5.0, "good"), (14.9, "good"), (15.0, "poor")])
def test_status(spark, rate, want):
    assert spark.range(1).select(quality.rate_status(F.lit(rate)).alias("s")).first()["s"] == want


def test_report_has_every_issue(spark):
    df = spark.createDataFrame([(["too_small"],), ([],)], "issues ARRAY<STRING>")
    got = {r["issue"]: (r["chunks"], r["percent"]) for r in quality.issue_report(df).collect()}
    assert len(got) == 5 and got["too_small"] == (1, 50.0) and got["too_large"] == (0, 0.0)
    assert quality.issue_report(df.filter("false")).count() == 5
    assert quality.overall_grade(df.filter("false")).first()["grade"] == "excellent"


def test_markdown_stats(spark):
    s = spark.createDataFrame([("# a\n\nkurz\n\n## b\n```\nx\n```",)], "t STRING").select(quality.markdown_stats(F.col("t")).alias("s")).first()["s"]
    assert (s["h1"], s["h2"], s["isolated"], s["code_blocks"]) == (1, 1, 1, 1)
    r = spark.createDataFrame([("## a\n## b",)], "t STRING").select(quality.parse_report(F.col("t")).alias("r")).first()["r"]
    assert r["h2"] == 1


def test_means_skip_failures(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0, 1.0, 1.0), ("b", math.nan, 1.0, 1.0, None), ("c", 3.0, 1.0, 1.0, 1.0)], EVAL_SCORE)
    got = {r["metric"]: (r["mean"], r["failed"]) for r in metrics.metric_means(df).collect()}
    assert got["faithfulness"] == (2.0, 1) and got["context_recall"] == (1.0, 1)
    assert metrics.failed_judgements(df, "user_input").count() == 2


@pytest.mark.parametrize(("score", "want"), [(0.85, "优秀"), (0.70, "良好"), (0.50, "及格"), (0.49, "需改进")])
def test_grade(spark, score, want):
    assert spark.range(1).select(metrics.grade(F.lit(score)).alias("g")).first()["g"] == want


def test_precision(spark):
    df = spark.createDataFrame([(1, i + 1, v) for i, v in enumerate([1, 0, 1, 0, 1])], "query_id INT, rank INT, relevant INT")
    assert metrics.context_precision(df).first()["context_precision"] == pytest.approx(0.7555555555303703, abs=1e-15)


def test_other_metrics(spark):
    one = spark.createDataFrame([([1.0, 0.0], [[1.0, 0.0], [0.0, 1.0]], [True, False])], "a ARRAY<FLOAT>, b ARRAY<ARRAY<FLOAT>>, v ARRAY<BOOLEAN>")
    r = one.select(metrics.mean_similarity(F.col("a"), F.col("b")).alias("m"), metrics.verdict_share(F.col("v")).alias("s")).first()
    assert r["m"] == pytest.approx(0.5) and r["s"] == 0.5
    assert metrics.chosen_metrics(False) == ("faithfulness", "context_precision", "answer_relevancy")
    pair = spark.createDataFrame([("死锁", "死锁"), ("a", None), ("", "")], "a STRING, t STRING")
    assert [x["s"] for x in pair.select(metrics.lexical_score(F.col("a"), F.col("t")).alias("s")).collect()] == [1.0, None, 0.0]


def test_segments(spark):
    get = lambda n: [(r["first"], r["last"]) for r in spark.range(1).select(F.inline(files.segments(F.lit(n)))).collect()]
    assert get(250) == [(1, 100), (101, 200), (201, 250)] and get(100) == [(1, 100)]


def test_pdf_segments_join_in_order(spark):
    df = spark.createDataFrame([("p", bytearray(b"x"))], "path STRING, content BINARY")

    def parser():
        def parse(content, first, last):
            if first == 101:
                raise ValueError
            return f"{first}-{last}"

        return parse

    assert files.parse_pdfs(df, lambda b: 250, parser).first()["text"] == "1-100\n\n\n\n201-250"
    images = files.extract_images(df, lambda: lambda b: [b"1", b"2"]).orderBy("name").collect()
    assert [r["name"] for r in images] == ["image_001.png", "image_002.png"]


def test_files_round_trip(spark, tmp_path):
    scores = spark.createDataFrame([("问", 1.0, None, 0.5, 0.25)], EVAL_SCORE)
    files.write_csv(scores, str(tmp_path / "csv"))
    assert files.read_csv(spark, str(tmp_path / "csv"), EVAL_SCORE).collect() == scores.collect()
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "os_cleaned.md").write_text("# a\n正文", encoding="utf-8")
    assert [tuple(r) for r in files.read_markdown(spark, str(tmp_path / "md")).collect()] == [("os_cleaned", "# a\n正文")]


def test_catalog(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("b", 3, "z")], "book_name STRING, row_id INT, content STRING")
    path = str(tmp_path / "store")
    catalog.upsert(rows, path)
    catalog.upsert(rows.filter("row_id = 3"), path)
    assert sorted(r["row_id"] for r in catalog.scan(spark, path).collect()) == [1, 3]
    plan = catalog.scan(spark, path, "a")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan
    catalog.drop(spark, path, "b")
    assert [r["row_id"] for r in catalog.scan(spark, path).collect()] == [1]
    assert [r["row_id"] for r in catalog.samples(rows).orderBy("row_id").collect()] == [1, 2]
    names = spark.createDataFrame([("textbook_os",), ("textbookXos",), ("other",)], "name STRING")
    assert [r["name"] for r in catalog.names(names).collect()] == ["textbookXos", "textbook_os"]


def test_stream(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "os.md").write_text("# 第1章 引论\n" + "很长的一句话内容。" * 30, encoding="utf-8")
    for _ in range(2):  # a second run finds nothing new
        q = ingest(spark, str(landing), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
        q.awaitTermination(60)
    assert catalog.scan(spark, str(tmp_path / "out")).count() == 1


def test_throughput(spark):
    rows = spark.createDataFrame([(4.0, 2.0), (0.0, 2.0), (4.0, 0.0)], "n DOUBLE, s DOUBLE").select(quality.throughput(F.col("n"), F.col("s")).alias("t"))
    assert [tuple(r["t"]) for r in rows.collect()] == [(2.0, 0.5, 2.0), (2.0, None, 0.0), (0.0, 0.0, None)]


def test_settings():
    from lectern.config import setting

    held = {"JUDGE_MODEL": "a", "MODEL": "b", "JUDGE_KEY": " "}
    assert [setting("model", "judge", "c", held), setting("model", "other", "c", held), setting("key", "judge", "c", held), setting("key", environment=held)] == ["a", "b", "c", None]


def test_lookup(spark):
    from lectern.sources import catalog

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "chunk_id INT, t STRING")
    wanted = spark.createDataFrame([(2,), (2,), (None,), (9,)], "chunk_id INT")
    for bound in (100, 0):
        assert sorted(r["t"] for r in catalog.lookup(rows, wanted, rows=bound).collect()) == ["b", "c"]


def test_discover(spark, tmp_path):
    from lectern.sources import files

    for name in ("b_cleaned.md", "a_cleaned.md", "c.txt"):
        (tmp_path / name).write_text("x")
    assert [r["name"] for r in files.discover(spark, str(tmp_path), "*_cleaned.md").collect()] == ["a_cleaned.md", "b_cleaned.md"]


def test_sentence_verdicts(spark):
    df = spark.createDataFrame([("一二。三四！", "一二"), ("", "x"), (None, "x"), ("一", None)], "a STRING, c STRING")
    assert [r["v"] for r in df.select(metrics.supported(F.col("a"), F.col("c")).alias("v")).collect()] == [[True, False], [], None, None]
