"""BM25, vectors, fusion, context, prompt, answers."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern import config
from lectern.operators import bm25, hybrid, plugins, vector

DOCS = [("g", 1, "a b b c"), ("g", 2, "a a"), ("g", 3, "d"), ("g", 4, ""), ("h", 5, "b"), ("g", 6, None), (None, 7, "a")]


@pytest.fixture(scope="module")
def index(spark):
    return bm25.build(spark.createDataFrame(DOCS, "grp STRING, key INT, text STRING"), "grp", "key", "text")


def brute(query, group):
    texts = {k: t.split() for g, k, t in DOCS if g == group and t is not None}
    n, avg = len(texts), sum(map(len, texts.values())) / len(texts)
    df = Counter(w for t in texts.values() for w in set(t))
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    return {k: sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in query) for k, t in texts.items()}


def test_bm25_against_brute_force(spark, index):
    queries = spark.createDataFrame([(1, "g", ["b", "b", "c"]), (2, "g", ["zz"])], "query_id INT, grp STRING, words ARRAY<STRING>")
    got = {(r["query_id"], r["key"]): (r["score"], r["rank"]) for r in bm25.top(index, queries, 3).collect()}
    want = brute(["b", "b", "c"], "g")
    assert got[1, 1][0] == pytest.approx(want[1]) and got[1, 1][1] == 1
    # nothing found: the first texts in order, with a score of 0
    assert [k for (q, k), (s, _) in sorted(got.items(), key=lambda x: x[1][1]) if q == 2] == [1, 2, 3]


def test_bm25_all_groups(spark, index):
    queries = spark.createDataFrame([(1, None, ["b"])], "query_id INT, grp STRING, words ARRAY<STRING>")
    assert {r["grp"] for r in bm25.top(index, queries, 5, per_group=False).collect()} == {"g", "h"}


def test_nearest(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [0.0, 1.0], 1), (4, None, 1), (5, [0.0, 0.0], 1)], "vec_id INT, embedding ARRAY<FLOAT>, label INT")
    queries = rows.filter("vec_id IN (2, 4)").select(F.col("vec_id").alias("query_id"), "embedding")
    got = [(r["vec_id"], r["similarity"]) for r in vector.nearest(rows, queries, 2).orderBy("rank").collect()]
    assert got == [(1, 1.0), (2, 1.0)]
    assert [r["vec_id"] for r in vector.nearest(rows, queries, 2, exclude_self=True).orderBy("rank").collect()] == [1, 3]
    per = vector.nearest(rows, queries, 1, group="label").orderBy("label").collect()
    assert [(r["label"], r["vec_id"]) for r in per] == [(0, 1), (1, 3)]
    assert vector.nearest(rows, queries.filter("false"), 2).count() == 0
    assert vector.nearest(rows.filter("false"), queries, 2).count() == 0
    carried = vector.nearest(rows, queries, 2, carry=("label",)).orderBy("rank").collect()
    assert [(r["vec_id"], r["label"]) for r in carried] == [(1, 0), (2, 0)]
    assert vector.nearest(rows, rows.select(F.col("vec_id").alias("query_id"), "embedding"), 2, block=2).count() == 8


HIT = "query_id INT, book_name STRING, key INT, similarity DOUBLE, rank INT"


def test_fusion(spark):
    a = spark.createDataFrame([(1, "b", 10, 0.5, 1), (1, "b", 11, 0.3, 2)], HIT)
    b = spark.createDataFrame([(1, "b", 10, 1.0, 1), (1, "b", 12, 20 * 0.05, 2)], HIT)
    got = [(r["key"], r["method"], r["final_score"]) for r in hybrid.fuse(a, b, 9).orderBy("place").collect()]
    # equal scores: vector hits first; a chunk found twice counts twice
    assert got == [(10, "embedding", 0.5), (11, "embedding", 0.3), (10, "bm25", 0.3), (12, "bm25", 0.3)]
    assert [r["key"] for r in hybrid.fuse(a, b, 9, dedupe=True).orderBy("place").collect()] == [10, 11, 12]


@pytest.mark.parametrize(("sizes", "used", "cut"), [((900, 1200, 100), 1, True), ((2500,), 0, True), ((900, 1000), 2, False)])
def test_context(spark, sizes, used, cut):
    df = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate(sizes)], "query_id INT, place INT, block STRING")
    r = hybrid.pack_context(df).first()
    assert r["used"] == used and r["context"].endswith(hybrid.CUT) == cut
    assert len(r["context"].replace(hybrid.CUT, "")) == sum(sizes[:used])


CHUNKS = "row_id BIGINT, book_name STRING, chapter STRING, section_h2 STRING, content STRING, char_count INT"


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([
        (1, "os", "第1章", "1.1 死锁", "死锁是进程互相等待。" * 12, 120), (2, "os", "第1章", "1.2 小结", "死锁死锁死锁" * 20, 120),
        (3, "os", "第2章", "2.1 分页", "分页把内存分成页。" * 12, 108), (4, "db", "第1章", "1.1 事务", "事务要么全做。" * 20, 140), (5, None, "", "", None, None), (6, "db", None, None, "", 0),
    ], CHUNKS)


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([(1, "什么是死锁", "os"), (2, "事务", None), (3, "死锁", "none")], "query_id INT, query STRING, book_name STRING")


def test_search(chunks, questions):
    got = hybrid.search(chunks, questions, 2).collect()
    assert {r["query_id"] for r in got} == {1, 2}
    assert all(r["book_name"] == "os" for r in got if r["query_id"] == 1)
    assert not any(r["method"] == "embedding" and r["key"] == 2 for r in got)
    for r in got:
        assert -1.000001 <= r["similarity"] <= 1.000001 or r["method"] == "bm25"
    best = next(r for r in got if r["query_id"] == 1 and r["place"] == 1)
    assert best["key"] in (1, 2)


def test_rerank_and_scope(chunks, questions):
    got = hybrid.search(chunks, questions, 2, reranker=plugins.overlap_reranker(), dedupe=True, scope="all").collect()
    assert all(r["place"] <= 2 for r in got) and all(0 <= r["rerank_score"] <= 1 for r in got)
    assert hybrid.search(chunks, questions, 1, scope="all").count() >= 1


def test_ask(chunks, questions):
    got = {r["query_id"]: r for r in hybrid.ask(chunks, questions, 2).collect()}
    assert got[1]["success"] and got[1]["answer"] and got[1]["prompt"].endswith("请开始你的回答：\n")
    assert len(got[1]["context"]) <= config.CONTEXT_CHARS + len(hybrid.CUT)
    assert got[3]["hits"] == [] and not got[3]["success"] and got[3]["prompt"] == ""
    assert [h["place"] for h in got[1]["hits"]] == list(range(1, len(got[1]["hits"]) + 1)) and got[1]["tokens"]["total"] > 0 and got[1]["sources"][0].startswith("os > 第")


def test_ask_with_a_model(chunks, questions):
    def client():
        return lambda prompt: "答：" + prompt[-5:]

    got = {r["query_id"]: r for r in hybrid.ask(chunks, questions, 2, answerer=lambda df: plugins.generate(df, client, wait=0.0)).collect()}
    assert got[1]["answer"].startswith("答：") and got[1]["model"] == "client" and got[1]["success"]
    assert got[3]["answer"] is None and not got[3]["success"]


def test_scope(spark, chunks, questions):
    """A question with a book gets k chunks of it; one without gets half as many of each book, k in all."""
    many = spark.createDataFrame([(10 + i, "os", "第1章", f"1.{i} 死锁", "死锁是进程互相等待。" * (11 + i), 200) for i in range(9)], CHUNKS).unionByName(chunks)
    got = hybrid.search(many, questions, 4, scope="all").collect()
    places = lambda q: sorted(r["place"] for r in got if r["query_id"] == q)
    assert places(1) == [1, 2, 3, 4] and places(2) == [1, 2, 3, 4] and places(3) == []
    assert all(sum(r["book_name"] == b for r in got if r["query_id"] == 2) <= 2 for b in ("os", "db"))


def test_search_with_passage(chunks, questions):
    plain = hybrid.search(chunks, questions, 2).collect()
    hyde = hybrid.search(chunks, questions, 2, write=plugins.framed_passage).collect()
    told = hybrid.search(chunks, questions, 2, instruction="说明：").collect()
    best = lambda rows: [(r["query_id"], r["key"], r["similarity"]) for r in rows if r["method"] == "embedding"]
    assert best(plain) != best(hyde) != best(told)


def test_plans_read_the_chunks_few_times(spark, folder):
    from lectern.plans import registry

    plan = registry.bm25_topk_per_book(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [row_id") + plan.count("FileScan parquet [book_name") <= 3 and "NestedLoop" not in plan and "Cartesian" not in plan


def test_answers_kept_aside(spark, chunks, questions):
    rows = spark.createDataFrame([(1, True), (2, False), (3, None)], "query_id INT, success BOOLEAN")
    kept, aside = hybrid.successful(rows)
    assert [r["query_id"] for r in kept.collect()] == [1] and sorted(r["query_id"] for r in aside.collect()) == [2, 3]
    plain = hybrid.answer(chunks, questions, k=3).collect()
    assert len(plain) == questions.count() and all(r["answer"] is None and r["success"] is False and bool(r["prompt"]) == bool(r["hits"]) for r in plain)


def test_display_and_sources(spark):
    rows = [(1, i, 0.98765, 1.0 - i / 10, "bm25", "os", f"k{i}", "C", None, "x" * (148 + i), i == 1, i < 3) for i in range(1, 6)]
    hits = spark.createDataFrame(rows, "query_id INT, place INT, similarity DOUBLE, final_score DOUBLE, method STRING, book_name STRING, key STRING, chapter STRING, section_h2 STRING, content STRING, has_code BOOLEAN, has_image BOOLEAN")
    got = {r["place"]: r for r in hybrid.display(hits).collect()}
    assert got[1]["similarity"] == "0.9877" and got[1]["section"] == "C | " and got[1]["flags"] == "💻 含代码 | 🖼️ 含图片" and got[3]["flags"] == ""
    assert got[2]["preview"] == "x" * 150 and got[3]["preview"] == "x" * 150 + "..."
    assert sorted(r["place"] for r in hybrid.top_sources(hits).collect()) == [1, 2, 3]


def test_generate_retries(spark):
    df = spark.createDataFrame([("ok",), ("bad",)], "prompt STRING")

    def client():
        def ask(p):
            if p == "bad":
                raise RuntimeError("no")
            return p.upper()

        return ask

    got = {r["prompt"]: r["llm_response"] for r in plugins.generate(df, client, wait=0.0).collect()}
    assert got["ok"]["answer"] == "OK" and got["ok"]["success"]
    assert not got["bad"]["success"] and got["bad"]["error"] == "no"


def test_hyde(spark):
    q = spark.createDataFrame([("a",), ("b",)], "query STRING")
    wrote = plugins.hyde(q, lambda c: F.when(c == "a", F.lit("passage"))).orderBy("query").collect()
    assert [r["query_text"] for r in wrote] == ["passage", "b"]
    assert [r["query_text"] for r in plugins.hyde(q, instruction="x:").orderBy("query").collect()] == ["x:a", "x:b"]


def exchanged(spark, run):
    """Rows that all exchanges wrote while run() ran."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return sum(s.shuffleWriteRecords() for s in map(stages().apply, range(stages().size())))

    def stages():
        return store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)

    before = total()
    out = run()
    return total() - before, out


@pytest.mark.parametrize("per_group", [False, True])
def test_bm25_exchanges_no_pairs(spark, per_group):
    """Every text holds a word of every question, but only the best of each task leave it."""
    docs = spark.range(2000, numPartitions=2).selectExpr("concat('g', id % 3) AS grp", "int(id) AS key", "concat_ws(' ', 'a', repeat('b ', int(id % 7)), 'c') AS text")
    index = bm25.build(docs, "grp", "key", "text")
    queries = spark.createDataFrame([(i, None if i % 2 else "g1", ["a", "b"]) for i in range(60)], "query_id INT, grp STRING, words ARRAY<STRING>")
    rows, got = exchanged(spark, lambda: bm25.top(index, queries, 3, per_group=per_group).collect())
    assert len(got) == (30 * 3 + 30 * 9 if per_group else 180) and rows < 4000


def test_best_by_blocks(spark, monkeypatch):
    """Blocks of few rows give the same as one, ties too."""
    from lectern.operators import best

    docs = spark.range(300, numPartitions=3).selectExpr("concat('g', id % 3) AS grp", "int(299 - id) AS key", "concat_ws(' ', 'a', repeat('b ', int(id % 4)), if(id % 50 = 0, 'c', '')) AS text")
    queries = spark.createDataFrame([(1, None, ["b", "c", "c"]), (2, "g1", ["b"]), (3, "g2", ["zz"]), (4, None, None)], "query_id INT, grp STRING, words ARRAY<STRING>")
    vectors = docs.selectExpr("key AS vec_id", "array(float(key % 5), float(1)) AS embedding", "grp")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        seen = []
        for rows in (best.ROWS, 20):
            monkeypatch.setattr(best, "ROWS", rows)
            monkeypatch.setattr(best, "PART", 12_000_000 if rows > 20 else 100)
            index = bm25.build(docs, "grp", "key", "text")
            asked = vectors.filter("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "embedding", "if(vec_id = 50, NULL, grp) AS own")
            near = vector.nearest(vectors, asked, 4, group="grp", query_group="own", exclude_self=True)
            seen.append([sorted(map(tuple, df.collect())) for df in (bm25.top(index, queries, 4), bm25.top(index, queries, 4, per_group=False), near)])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert seen[0] == seen[1] and [len(x) for x in seen[0]] == [32, 16, 32] and all(r[0] != r[2] for r in seen[0][2])


def test_tokens_as_in_sql(spark):
    """Tokens cut in blocks are those of tokens()."""
    texts = ["", "a_1 b死锁c\n锁", "x", "é9-鿿一㐀𠀀z", "ＡB A\x00B", "\n", "run"]
    want = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING").orderBy("i").select(bm25.tokens(F.col("t"))).collect()]
    row, code, names = bm25._split(texts)
    assert [sorted(names[c] for c in code[row == i]) for i in range(len(texts))] == [sorted(w) for w in want]


def test_bm25_on_given_words(spark, index):
    """The index of given tokens scores as that of the texts."""
    docs = spark.createDataFrame(DOCS, "grp STRING, key INT, text STRING")
    given = bm25.build(docs, "grp", "key", "text", words=bm25.tokens(F.col("text")))
    queries = spark.createDataFrame([(1, None, ["b", "b", "c"]), (2, "g", ["zz"])], "query_id INT, grp STRING, words ARRAY<STRING>")
    both = [sorted(map(tuple, x)) for i in (index, given) for x in (i.terms.collect(), bm25.top(i, queries, 3).collect())]
    assert both[:2] == both[2:]


@pytest.mark.parametrize("how", ["rerank", "ask"])
def test_only_texts_of_hits_are_exchanged(spark, monkeypatch, how):
    """Where hits are too many to broadcast, the texts that none of them names stay where they are."""
    rows = spark.range(12_000, numPartitions=2).selectExpr("id AS row_id", "'g' AS book_name", "concat_ws(' ', 'w', repeat('b ', int(id % 7)), string(id % 50)) AS content", "'x' AS chapter", "'y' AS section_h2", "500 AS char_count")
    queries = spark.createDataFrame([(i, f"w {i * 7}", "g" if i % 2 else None) for i in range(20)], "query_id INT, query STRING, book_name STRING")

    def run():
        return sorted(map(str, (hybrid.ask(rows, queries, k=3) if how == "ask" else hybrid.search(rows, queries, k=3, reranker=plugins.overlap_reranker())).collect()))

    want = run()
    monkeypatch.setattr(hybrid, "small", lambda df, limit=config.BROADCAST_ROWS: limit > config.BROADCAST_ROWS)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        count, got = exchanged(spark, run)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == want and count < 12_000


def test_block_of_bounded_memory(spark, index):
    """Rows, terms and places of a block's tokens are held in 32 bits; parts score as the whole."""
    import numpy as np
    import pyarrow as pa

    from lectern.operators import best

    asked = bm25.Asked(index, spark.createDataFrame([(1, "g", ["a", "b"])], "query_id INT, grp STRING, words ARRAY<STRING>"))
    row, term, score = bm25._postings(pa.table({"words": ["a b b c", "a a", "d"]}), asked, 1.5, 0.75, np.arange(3), np.full(3, asked.groups["g"]))
    assert row.dtype == term.dtype == np.int32 and len(row) == 3 and score.sum() == pytest.approx(sum(brute(["a", "b"], "g").values()))
    assert best.BYTES <= 16_000_000 and best.GATHERED <= 250_000


def test_best_of_many_queries_at_once():
    """The best rows of many queries, found together in each block, hold those that sorting all rows gives, ties too."""
    import numpy as np

    from lectern.operators import best

    rng = np.random.default_rng(1)
    queries, blocks = np.array([3, 5, 8, 9]), [rng.integers(0, 6, (4, n)).astype(float) for n in (20, 3, 11)]
    blocks[0][1], blocks[1][2, 0] = -np.inf, -np.inf
    found, sent = best.Best(4, 6), []
    for i, raw in enumerate(blocks):
        for part in (slice(0, 3), slice(3, 6)):
            found.add("g", queries, part, raw[part], slice(10, 10 + raw.shape[1]))
        query, row, score = found.gathered()
        sent += zip(query.tolist(), (-score).tolist(), [i] * query.size, row.tolist())
    for line, j in enumerate(queries.tolist()):
        every = sorted((-s, i, 10 + at) for i, raw in enumerate(blocks) for at, s in enumerate(raw[line].tolist()) if s > -np.inf)
        assert sorted(x[1:] for x in sent if x[0] == j)[:4] == every[:4]


def test_few_steps_for_many_queries(spark, index, monkeypatch):
    """The queries of a group are scored together, and alike if their terms are too many to lay out."""
    import numpy as np
    import pyarrow as pa

    from lectern.operators import best

    queries = spark.createDataFrame([(i, "g" if i % 2 else None, ["a", "b", "b", "zz"][: i % 5]) for i in range(40)], "query_id INT, grp STRING, words ARRAY<STRING>")
    asked = bm25.Asked(index, queries)
    pair, place, part = np.array([0, 0, 0, 1, 1]), np.array([0, 2, 3, 1, 2]), np.array([0.5, 0.25, 2.0, 1.0, 3.0])
    both = []
    for most in (best.PRODUCTS, 1):
        monkeypatch.setattr(best, "PRODUCTS", most)
        both.append(bm25._totals(asked, np.arange(40), pair, 0, place, part, 4))
    assert both[0].any() and (both[0] == both[1]).all()
    monkeypatch.undo()
    kept, calls, add = {}, [], best.Best.add
    monkeypatch.setattr(best.Best, "add", lambda self, *x: calls.append(1) or add(self, *x))
    from pyspark.sql.classic.dataframe import DataFrame

    whole = DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda df, f, *x: kept.update(run=f, rows=df.toArrow()) or whole(df, f, *x))
    bm25.candidates(index, queries, 2, True, 6)
    sent = pa.Table.from_batches(list(kept["run"](iter(kept["rows"].combine_chunks().to_batches()))))
    # 20 queries in one group, 20 in both groups
    assert len(calls) == 3 and len(sent) == 20 * 2 + 20 * 3


def test_blocks_and_scores_are_small():
    """What a task holds at a time stays small, as two tasks and their workers share an executor with its heap."""
    from lectern.operators import best

    assert best.BYTES <= 8_000_000 and best.PRODUCTS <= 1_000_000


def test_encoder_gives_memory_back(monkeypatch):
    """Workers that have encoded texts outlive their tasks, so what they don't need any more goes back."""
    import pyarrow as pa

    from lectern.operators import best

    kept, calls = {}, []
    monkeypatch.setattr(plugins.F, "arrow_udf", lambda f, kind: kept.update(run=f) or (lambda c: c))
    monkeypatch.setattr(best, "release", lambda: calls.append(1))
    plugins.code_point_embedding()(None)
    got = [x.to_pylist() for x in kept["run"](iter([pa.array(["ab", None]), pa.array(["锁"])]))]
    assert len(calls) == 1 and [[sum(v) for v in x] for x in got] == [[2, 0], [1]]


@pytest.fixture(scope="module")
def repeated(spark, folder, tmp_path_factory):
    """Ten texts of the books that are asked about, 800 times with shifted keys, in four files; all questions."""
    from lectern.plans import registry

    out = str(tmp_path_factory.mktemp("repeated"))
    books = registry.asked(spark, folder).select("book_name").distinct()
    rows = spark.read.parquet(f"{folder}/chunks.parquet").join(books, "book_name", "left_semi").filter(hybrid.informative()).orderBy("row_id").limit(10)
    copies = spark.range(800, numPartitions=4).crossJoin(F.broadcast(rows)).withColumn("row_id", F.col("row_id") + F.col("id") * 1_000_000)
    copies.select(*rows.columns).write.parquet(f"{out}/chunks.parquet")
    spark.read.parquet(f"{folder}/eval_questions.parquet").write.parquet(f"{out}/eval_questions.parquet")
    return out


@pytest.mark.parametrize("name", ["answers_kept", "hybrid_instruction", "top_sources", "eval_dataset", "bm25_topk_per_book", "hybrid_hyde", "hybrid_prefilter", "ask"])
def test_queries_exchange_no_words_of_texts(spark, repeated, name):
    """From its first job to its last, a query exchanges few rows for each text, though each text holds many words of the questions."""
    from lectern.plans import registry

    rows, out = exchanged(spark, lambda: registry.queries()[name](spark, repeated).collect())
    assert out and rows < 2 * 8000


def test_parts_of_many_queries(spark, monkeypatch):
    """More queries than a task holds are searched in parts, with the same results."""
    rows = spark.range(300, numPartitions=3).selectExpr("id AS vec_id", "array(float(id % 7), float(id % 11), float(1)) AS embedding", "concat('g', id % 3) AS grp")
    queries = rows.selectExpr("vec_id AS query_id", "embedding", "if(vec_id % 10 = 0, NULL, grp) AS own")
    seen = []
    for most in (vector.QUERIES, 70):
        monkeypatch.setattr(vector, "QUERIES", most)
        seen.append(sorted(map(tuple, vector.nearest(rows, queries, 4, group="grp", query_group="own").collect())))
    assert seen[0] == seen[1] and len(seen[0]) == 270 * 4 + 30 * 12


def test_all_failed_answers_are_kept_aside(spark, folder, tmp_path):
    """Questions about a book that isn't there have no answer, whatever their ids."""
    from lectern.plans import registry

    spark.read.parquet(f"{folder}/chunks.parquet").write.parquet(f"{tmp_path}/chunks.parquet")
    asked = spark.read.parquet(f"{folder}/eval_questions.parquet").withColumn("book_name", F.when(F.col("question_id") % 4 < 2, "none").otherwise(F.col("book_name")))
    asked.write.parquet(f"{tmp_path}/eval_questions.parquet")
    books = spark.read.parquet(f"{folder}/chunks.parquet").select("book_name")
    want = asked.filter("book_name IS NOT NULL AND question IS NOT NULL").join(books, "book_name", "left_anti")
    got = sorted(r["query_id"] for r in registry.answers_aside(spark, str(tmp_path)).collect())
    assert got == sorted({r["question_id"] for r in want.collect()}) and len(got) >= 20


@pytest.mark.parametrize("name", ["ask", "eval_dataset", "hybrid_cross_book", "hybrid_dedupe", "hybrid_fusion", "hybrid_hyde", "hybrid_instruction", "hybrid_prefilter", "top_sources"])
def test_all_questions_are_asked(spark, folder, name):
    """Every question has its rows, whatever its id."""
    from lectern.plans import registry

    got = {r["query_id"] for r in registry.queries()[name](spark, folder).collect()}
    assert got == {r["question_id"] for r in spark.read.parquet(f"{folder}/eval_questions.parquet").filter("question IS NOT NULL").collect()}


def test_rows_are_dealt_out_for_many_queries(spark, monkeypatch):
    """Rows of a group meet in few tasks if many queries look for them: fewer rows are exchanged, with the same results."""
    from lectern.operators import best

    rows = spark.range(2000, numPartitions=8).selectExpr("id AS vec_id", "array(float(id % 101), float(id % 89), float(1)) AS embedding", "concat('g', id % 5) AS grp", "concat_ws(' ', repeat('a ', int(id % 29)), repeat('b ', int(id % 23)), 'c') AS text")
    queries = rows.filter("vec_id < 400").selectExpr("vec_id AS query_id", "embedding", "if(vec_id % 10 = 0, NULL, grp) AS grp", "array('a', if(vec_id % 3 = 0, 'b', 'c')) AS words")
    texts = bm25.build(rows, "grp", "vec_id", "text")
    for run in (lambda: vector.nearest(rows, queries, 8, group="grp", query_group="grp"), lambda: bm25.top(texts, queries, 8)):
        seen = []
        for times in (best.DEALT, 1_000_000):
            monkeypatch.setattr(best, "DEALT", times)
            count, got = exchanged(spark, lambda: sorted(map(tuple, run().collect())))
            seen.append((count, got))
        monkeypatch.undo()
        assert seen[0][1] == seen[1][1] and len(seen[0][1]) == 8 * (360 + 40 * 5)
        assert 1.5 * seen[0][0] < seen[1][0], (seen[0][0], seen[1][0])


def test_a_task_sends_the_best_once():
    """What later blocks put out of the best doesn't leave the task, unless it keeps too much."""
    import numpy as np
    import pyarrow as pa

    from lectern.operators import best

    schema = pa.schema([("query_id", pa.int64()), ("key", pa.int64()), ("score", pa.float64())])
    found, ids = best.Best(2, 6), pa.array([7, 9])
    sent = []
    for i in range(5):
        table = pa.table({"key": np.arange(10) + 10 * i})
        found.add("g", np.array([0, 1]), slice(0, 2), np.stack([np.arange(10.0) + i, np.arange(10.0) - i]), slice(0, 10))
        sent += found.sent(table, ids, schema)
    assert not sent
    got = [tuple(r.values()) for b in found.rest(ids, schema) for r in b.to_pylist()]
    assert sorted(got) == [(7, 39, 12.0), (7, 48, 12.0), (7, 49, 13.0), (9, 8, 8.0), (9, 9, 9.0), (9, 19, 8.0)]


def test_alike_questions_are_searched_once(spark, chunks, monkeypatch):
    """Each of them has the hits all the same."""
    rows = [(1, "锁 是 什么", "os"), (2, "锁 是 什么", "os"), (3, "锁 是 什么", None), (4, "锁 是 什么", None), (5, "索引", "db")]
    queries = spark.createDataFrame(rows, "query_id INT, query STRING, book_name STRING")
    asked, nearest = [], vector.nearest
    monkeypatch.setattr(vector, "nearest", lambda rows, queries, *x, **y: asked.append(queries.count()) or nearest(rows, queries, *x, **y))
    got = hybrid.search(chunks, queries, k=2).collect()
    hits = {i: sorted((r["book_name"], r["key"], r["method"], r["place"]) for r in got if r["query_id"] == i) for i in range(1, 6)}
    assert asked == [3] and hits[1] == hits[2] and hits[3] == hits[4] and hits[1] and hits[3]
