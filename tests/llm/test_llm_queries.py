"""Every query of the subpackage: columns, types, value sets, rows against the tables, and its SQL."""

import duckdb
import pytest

from lectern.llm import queries as Q
from lectern.llm import sql
from lectern.session import table

SHAPES = {
    "p1_found": {"row_id": "bigint", "field": "string", "noise": "string"},
    "p2_found": {"row_id": "bigint"},
    "p3_found": {"row_id": "bigint", "field": "string"},
    "p4_found": {"row_id": "bigint"},
    "p5_found": {"pair_id": "bigint", "defect": "string"},
    "p6_ids": {"doc_id": "bigint", "ids": "array<int>"},
    "p8_found": {"doc_id": "bigint", "kind": "string"},
}
VALUES = {
    ("p1_found", "field"): {"content", "section_h2"}, ("p1_found", "noise"): {"hyphen", "misread", "header", "page_number"},
    ("p3_found", "field"): {"chapter", "section_h2", "content"}, ("p5_found", "defect"): {"empty", "truncated", "refusal", "copy", "language"},
    ("p8_found", "kind"): {"list", "table", "junk"},
}
KEYS = {"p1_found": ("row_id", "field", "noise"), "p3_found": ("row_id", "field"), "p5_found": ("pair_id",), "p6_ids": ("doc_id",), "p8_found": ("doc_id",), "p2_found": ("row_id",), "p4_found": ("row_id",)}


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_shape(spark, folder, name):
    got = Q.queries()[name](spark, folder)
    assert dict(got.dtypes) == SHAPES[name]
    rows = got.collect()
    assert rows and len({tuple(r[k] for k in KEYS[name]) for r in rows}) == len(rows)
    for (query, column), allowed in VALUES.items():
        if query == name:
            assert {r[column] for r in rows} <= allowed


WHOLE = {"p1_text": "chunks", "p3_text": "chunks", "p4_text": "chunks", "p5_defects": "qa_comparison", "p6_ids": "documents", "p8_statistics": "documents"}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_no_row_is_lost(spark, folder, name):
    assert Q.queries()[name](spark, folder).count() == table(spark, folder, WHOLE[name]).count()


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_against_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("chunks", "documents", "qa_comparison"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    df = Q.queries()[name](spark, folder)
    columns = sorted(df.columns)
    cur = con.execute(f"SELECT {', '.join(columns)} FROM ({sql.oracle_sql()[name]})")
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == sorted(cur.fetchall())


def test_no_function_of_two_parameters():
    """A second parameter of a lambda in a higher-order function gets the place in the array, whatever its default."""
    import ast
    import inspect
    import pathlib

    import lectern

    for path in pathlib.Path(inspect.getfile(lectern)).parent.rglob("*.py"):
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, ast.Call) and getattr(node.func, "attr", "") in ("transform", "filter", "exists", "forall"):
                assert not any(isinstance(x, ast.Lambda) and x.args.defaults for x in node.args), path
