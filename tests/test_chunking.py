"""Sections, heading context, packing and merging."""

import random

from pyspark.sql import functions as F

from lectern import config
from lectern.operators import packing, sections


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id STRING, text STRING")


def rows(df, *order):
    return [r.asDict() for r in df.orderBy(*order).collect()]


def test_parse(spark):
    got = rows(sections.parse_sections(docs(spark, "before\n\n# 第1章 A\n## 1.1 B\nbody\n\nmore\n##### no\n# \nx")), "pos")
    assert [(r["level"], r["title"], r["content"]) for r in got] == [(0, "", "before"), (2, "1.1 B", "body\nmore\n##### no\n# \nx")]


def test_empty_heading_sets_no_chapter(spark):
    got = rows(packing.section_chunks(sections.parse_sections(docs(spark, "# 第1章 A\n## 1.1 B\nbody body body"))), "ordinal")
    assert [(r["chapter"], r["section_h2"], r["chunk_id"]) for r in got] == [("", "1.1 B", "ch0_s1_1_p001")]


def brute_context(sections_):
    ch = h2 = h3 = h4 = ""
    n = 0
    out = []
    for level, title in sections_:
        if level == 1:
            ch, h2, h3, h4, n = title, "", "", "", n + 1
        elif level == 2:
            h2, h3, h4 = title, "", ""
        elif level == 3:
            h3, h4 = title, ""
        elif level == 4:
            h4 = title
        out.append((ch, h2, h3, h4, n))
    return out


def test_context_against_brute_force(spark):
    rng = random.Random(1)
    data, want = [], {}
    for d in range(40):
        s = [(rng.randint(0, 4), f"t{rng.randint(0, 9)}") for _ in range(rng.randint(1, 12))]
        want[f"d{d}"] = brute_context(s)
        data += [(f"d{d}", i, level, title, "x") for i, (level, title) in enumerate(s)]
    df = spark.createDataFrame(data, "doc_id STRING, pos INT, level INT, title STRING, content STRING")
    got = {}
    for r in rows(sections.heading_context(df), "doc_id", "pos"):
        got.setdefault(r["doc_id"], []).append((r["chapter"], r["section_h2"], r["section_h3"], r["section_h4"], r["chapter_num"]))
    assert got == want


def test_chunk_id_pads_and_never_cuts(spark):
    one = lambda c, n, h, k: spark.range(1).select(sections.chunk_id(F.lit(c), F.lit(n), F.lit(h), F.lit(k)).alias("x")).first()["x"]
    assert one("第 2 章", 7, "", 1000) == "ch2_p1000"
    assert one("x", 7, "3.4 y", 5) == "ch7_s3_4_p005"


def pack(spark, text):
    return spark.createDataFrame([(text,)], "t STRING").select(packing.pack_sentences(F.col("t")).alias("p")).first()["p"]


def test_pack(spark):
    s = "x" * 299 + "。"
    assert [len(p) for p in pack(spark, s * 3)] == [600, 300]
    assert [len(p) for p in pack(spark, "y" * 900)] == [900]


def test_pack_keeps_all(spark):
    rng = random.Random(2)
    for _ in range(10):
        text = "".join(rng.choice(["字" * rng.randint(1, 300), "。", "！", "\n"]) for _ in range(30))
        pieces = pack(spark, text)
        assert "".join(pieces) == text
        assert all(len(p) <= config.MAX_CHUNK for p in pieces)


def chunk(i, n):
    return ("d", i, f"c{i}", "", "", "", "", "x" * n, 1, n, False, False)


FIELDS = "doc_id STRING, ordinal INT, chunk_id STRING, chapter STRING, section_h2 STRING, section_h3 STRING, section_h4 STRING, content STRING, level INT, char_count INT, has_code BOOLEAN, has_image BOOLEAN"


def test_merge(spark):
    df = spark.createDataFrame([chunk(1, 300), chunk(2, 50), chunk(3, 760), chunk(4, 50)], FIELDS)
    assert [r["char_count"] for r in rows(packing.merge_small(df), "ordinal")] == [352, 760]
    df = spark.createDataFrame([chunk(1, 50), chunk(2, 300)], FIELDS)
    assert [r["char_count"] for r in rows(packing.merge_small(df), "ordinal")] == [300]
    df = spark.createDataFrame([chunk(1, 50)], FIELDS)
    assert rows(packing.merge_small(df), "ordinal") == []


def test_documents_end_to_end(spark):
    text = "# 第1章 引论\n" + "内容很多的一句话。" * 120 + "\n<table>" + "x" * 900 + "</table>\n## 1.1 小节\n" + "第二段内容。" * 30
    got = rows(packing.chunk_documents(docs(spark, text, "", None)), "doc_id", "ordinal")
    assert all(len(r["content"]) <= config.MAX_CHUNK or "<table>" in r["content"] for r in got)
    assert {r["chapter"] for r in got} == {"第1章 引论"}


def test_plan_has_no_python(spark):
    plan = packing.chunk_documents(docs(spark, "a"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan


def test_merge_of_many_small_chunks(spark):
    """Against a fold in Python, with many small chunks after a big one and counts that differ from lengths."""
    import random

    from pyspark.sql import functions as F

    from lectern.operators import packing

    rng, rows = random.Random(4), []
    for doc in range(6):
        for i in range(900):
            big = i % 450 == 3
            n = rng.randint(100, 795) if big else rng.choice([1, 3, 20, 60, 99])
            rows.append((str(doc), i, "", "", "", "", "", "x" * (n - rng.randint(0, 1) * rng.randint(0, n // 2)), 1, n, False, False))
    df = spark.createDataFrame(rows, "doc_id STRING, ordinal INT, chunk_id STRING, chapter STRING, section_h2 STRING, section_h3 STRING, section_h4 STRING, content STRING, level INT, char_count INT, has_code BOOLEAN, has_image BOOLEAN")
    want = []
    for doc in range(6):
        cur = None
        for r in (x for x in rows if x[0] == str(doc)):
            if r[9] >= 100:
                want += [cur] if cur else []
                cur = [r[0], r[1], r[7], r[9]]
            elif cur and cur[3] + r[9] + 2 <= 800:
                cur[2] += "\n\n" + r[7]
                cur[3] = len(cur[2])
        want += [cur] if cur else []
    got = packing.merge_small(df).select("doc_id", "ordinal", F.col("content"), "char_count").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
