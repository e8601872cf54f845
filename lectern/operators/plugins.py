"""Boundaries to models, each with a default that needs none and always answers alike."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from ..schema import LLM_RESPONSE
from . import best

Embedder = Callable[[Column], Column]
Reranker = Callable[[Column, Column], Column]

DIMENSIONS = 64
#: Texts whose code points are counted at a time.
TEXTS = 200


def code_point_embedding(dimensions: int = DIMENSIONS) -> Embedder:
    """Counts of the code points of letters and Han characters, by remainder: a bag of characters, not scaled.

    Stands where a sentence encoder would; batches come in Arrow. A text without letters has a vector of zeros.
    """

    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = np.zeros((len(texts), dimensions), np.float32)
            for i in range(0, len(texts), TEXTS):
                part = [t or "" for t in texts.slice(i, TEXTS).to_pylist()]
                points = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
                counted = ((points >= 0x4E00) & (points <= 0x9FFF)) | ((points >= 97) & (points <= 122)) | ((points >= 65) & (points <= 90))
                cell = np.repeat(np.arange(len(part)) * dimensions, [len(t) for t in part])[counted] + points[counted] % dimensions
                out[i : i + len(part)] = np.bincount(cell, minlength=len(part) * dimensions).reshape(-1, dimensions)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dimensions, pa.int32()), pa.array(out.ravel()))
        best.release()

    return lambda c: F.arrow_udf(embed, T.ArrayType(T.FloatType()))(c)


def overlap_reranker() -> Reranker:
    """The share of a query's distinct tokens that a text holds; stands where a cross-encoder would."""
    from .bm25 import tokens

    def rerank(query: Column, text: Column) -> Column:
        q = F.array_distinct(tokens(query))
        return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(text))) / F.size(q)).otherwise(0.0)

    return rerank


def extractive_answer(prompt: Column, context: Column, chars: int = 200) -> Column:
    """A response struct with the beginning of the context as the answer; stands where a language model would."""
    ok = F.length(F.trim(context)) > 0
    return F.struct(
        ok.alias("success"), F.when(ok, F.substring(context, 1, chars)).alias("answer"), F.lit("extractive").alias("model"),
        F.struct(F.length(prompt).alias("prompt"), F.least(F.length(context), F.lit(chars)).alias("completion"), (F.length(prompt) + F.least(F.length(context), F.lit(chars))).alias("total")).alias("tokens"),
        F.lit(0.0).alias("time"), F.when(ok, F.lit("stop")).alias("finish_reason"), F.when(~ok, F.lit("no context")).alias("error"),
    ).cast(LLM_RESPONSE)


def generate(df: DataFrame, client: Callable[[], Callable[[str], str]], prompt: str = "prompt", retries: int = config.RETRIES, model: str = "client", wait: float = 1.0) -> DataFrame:
    """Adds llm_response from a client made once in each task: up to retries + 1 attempts, a failure struct, never an error.

    The result should be written before it is used twice: a plan that is computed again would ask again.
    """
    target = T.StructType([*df.schema.fields, T.StructField("llm_response", LLM_RESPONSE)])
    at = df.columns.index(prompt)

    def run(batches):
        import time

        ask = client()
        for pdf in batches:
            rows = []
            for values in pdf.itertuples(index=False):
                started, answer, error = time.time(), None, None
                for attempt in range(retries + 1):
                    try:
                        answer, error = ask(values[at]), None
                        break
                    except Exception as e:  # noqa: BLE001
                        error = str(e)
                        if attempt < retries:
                            time.sleep(wait)
                ok = error is None
                rows.append({"success": ok, "answer": answer, "model": model, "tokens": None, "time": time.time() - started, "finish_reason": "stop" if ok else None, "error": error})
            yield pdf.assign(llm_response=rows)

    return df.mapInPandas(run, target)


def framed_passage(query: Column) -> Column:
    """The query in the frame of a textbook sentence; stands where a language model would write a passage."""
    return F.concat(F.lit("教材中对此的说明如下："), query, F.lit("。"))


def hyde(queries: DataFrame, write: Callable[[Column], Column] | None = None, instruction: str = "") -> DataFrame:
    """Adds query_text, what is encoded: a hypothetical passage once a distinct query, else the query after the instruction.

    A passage that came out null falls back to the bare query.
    """
    if write is None:
        return queries.withColumn("query_text", F.concat(F.lit(instruction), F.col("query")))
    passages = queries.select("query").distinct().withColumn("passage", write(F.col("query")))
    return queries.join(passages, "query", "left").withColumn("query_text", F.coalesce("passage", "query")).drop("passage")
