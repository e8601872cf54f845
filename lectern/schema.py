"""Schemas of the tables that the operators exchange."""

from pyspark.sql import types as T

_TYPES = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType()}


def fields(kinds: str, *names: str) -> T.StructType:
    """A schema from one letter a column: s string, i int, l bigint, d double, b boolean."""
    return T.StructType([T.StructField(n, _TYPES[k]) for k, n in zip(kinds, names)])


SECTION = fields("siiss", "doc_id", "pos", "level", "title", "content")
CHUNK = fields("ssssssiibb", "chunk_id", "chapter", "section_h2", "section_h3", "section_h4", "content", "level", "char_count", "has_code", "has_image")
MESSAGE = fields("ss", "role", "content")
EVAL_QUESTION = fields("sss", "question", "book_name", "ground_truth")
EVAL_SCORE = fields("sdddd", "user_input", "faithfulness", "context_precision", "answer_relevancy", "context_recall")
QA = fields("sss", "question", "answer", "ground_truth")
LLM_RESPONSE = T.StructType([
    *fields("bss", "success", "answer", "model").fields,
    T.StructField("tokens", fields("iii", "prompt", "completion", "total")),
    *fields("dss", "time", "finish_reason", "error").fields,
])
