"""Mixing: shares, caps, dual against a plain solver, odd tables."""

import math

import pytest

from lectern.llm import queries as Q
from lectern.llm.mixture import mix_sources

TARGETS = [("a", 0.5, 2), ("b", 0.3, 3), ("c", 0.2, 4), ("none", 0.1, 4)]


@pytest.fixture(scope="module")
def tables(spark):
    docs = [(i, "数据结构与算法。" * (1 + i % 7), "a" if i % 3 else "b") for i in range(900)] + [(2000 + i, "页表。" * 9, "c") for i in range(30)]
    docs += [(3000, None, "a"), (3001, "", "a"), (3002, "x", None), (3003, "x", "unknown")]
    return spark.createDataFrame(docs, "doc_id BIGINT, text STRING, source STRING"), spark.createDataFrame(TARGETS, "source STRING, weight DOUBLE, max_repeats INT")


def test_shares(tables):
    docs, targets = tables
    copies, shares = mix_sources(docs, targets)
    rows = copies.collect()
    cap = {s: c for s, _, c in TARGETS}
    assert all(1 <= r["copies"] <= cap[r["source"]] for r in rows) and len({r["doc_id"] for r in rows}) == len(rows)
    got = {r["source"]: r for r in shares.collect()}
    assert got["none"]["share"] == 0 and got["none"]["documents"] == 0
    for s, w, _ in TARGETS[:3]:
        assert got[s]["share"] == pytest.approx(w, abs=0.02)
    assert sum(r["share"] for r in got.values()) == pytest.approx(1)
    used = {}
    for r in rows:
        used[r["source"]] = used.get(r["source"], 0) + r["tokens"] * r["copies"]
    assert {s: r["tokens_used"] for s, r in got.items() if r["tokens_used"]} == used
    # the source that binds is used as often as it may be
    assert all(r["copies"] == 4 for r in rows if r["source"] == "c")


def test_total_beyond_the_caps(tables):
    docs, targets = tables
    _, shares = mix_sources(docs, targets, total=1e9)
    got = {r["source"]: r for r in shares.collect()}
    assert all(got[s]["tokens_used"] == got[s]["tokens_available"] * c for s, _, c in TARGETS[:3])


def test_rates_are_those_of_the_dual(tables):
    docs, targets = tables
    total = 6000.0
    copies, _ = mix_sources(docs, targets, total=total)
    rows = [r for r in copies.collect() if r["source"] == "a"]
    tokens = [r["tokens"] for r in mix_sources(docs, targets, total=1e9)[0].collect() if r["source"] == "a"]
    mean, goal = sum(tokens) / len(tokens), total * 0.5
    low, high = -60.0, 60.0
    for _ in range(200):
        m = (low + high) / 2
        low, high = (m, high) if sum(t * min(2, math.exp(m * t / mean)) for t in tokens) < goal else (low, m)
    for size in sorted(set(tokens)):
        rate = min(2, math.exp(m * size / mean))
        n = tokens.count(size)
        assert abs(sum(r["copies"] for r in rows if r["tokens"] == size) - rate * n) <= 1.01


def test_odd_tables(tables):
    docs, targets = tables
    copies, shares = mix_sources(docs.filter("false"), targets)
    assert copies.count() == 0 and {r["share"] for r in shares.collect()} == {0.0}
    copies, shares = mix_sources(docs, targets.filter("false"))
    assert copies.count() == 0 and shares.count() == 0


def test_shares_of_the_tables(spark, folder):
    """Shares come as near to the targets as the documents allow: within a document of a source with a few."""
    got = {r["source"]: r for r in Q.p7_shares(spark, folder).collect()}
    live = {s: r for s, r in got.items() if r["documents"] > 0}
    whole = sum(r["weight"] for r in live.values())
    total = sum(r["tokens_used"] for r in live.values())
    for r in live.values():
        mean = r["tokens_available"] / r["documents"]
        assert abs(r["tokens_used"] - total * r["weight"] / whole) <= max(0.02 * total * r["weight"], mean)
