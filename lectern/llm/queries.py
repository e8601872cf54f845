"""The queries of this package: name to function of a session and the folder of the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table
from .lookalike import normalize_look_alikes
from .mixture import mix_sources
from .mojibake import repair_encoding
from .pairs import flag_pairs
from .scan_noise import clean_scans
from .split import split_oversized
from .text_quality import text_types
from .tokenizing import encode_corpus


#: Tables that grow; the others are lookups.
GROWING = ("chunks", "documents", "qa_comparison")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows = table(spark, folder, name)
    return spread(rows) if name in GROWING else rows


def p1_text(spark, folder):
    return clean_scans(_table(spark, folder, "chunks"), _table(spark, folder, "collections"))


def p1_found(spark, folder):
    fields = ("section_h2", "content")
    # a second parameter of the function would get the place in the array
    named = [F.transform(F.col(f"{c}_noise"), lambda x: F.struct(F.lit(c).alias("field"), x.alias("noise"))) for c in fields]  # noqa: B023
    each = F.array(*named)
    return p1_text(spark, folder).select("row_id", F.inline(F.flatten(each)))


def p2_pieces(spark, folder):
    return split_oversized(_table(spark, folder, "chunks"))


def p2_found(spark, folder):
    """A chunk was too long if it came out in several pieces; each chunk has one first piece."""
    return p2_pieces(spark, folder).filter("pieces > 1 AND piece_no = 0").select("row_id")


def p3_text(spark, folder):
    return normalize_look_alikes(_table(spark, folder, "chunks"))


def p3_found(spark, folder):
    fields = ("chapter", "section_h2", "content")
    changed = F.filter(F.array(*[F.when(F.col(f"{c}_changes") > 0, F.lit(c)) for c in fields]), lambda x: x.isNotNull())
    return p3_text(spark, folder).select("row_id", F.explode(changed).alias("field"))


def p4_text(spark, folder):
    return repair_encoding(_table(spark, folder, "chunks"))


def p4_found(spark, folder):
    return p4_text(spark, folder).filter("garbled").select("row_id")


def p6_ids(spark, folder):
    return encode_corpus(_table(spark, folder, "documents"))


def p5_defects(spark, folder):
    return flag_pairs(_table(spark, folder, "qa_comparison"))


def p5_found(spark, folder):
    return p5_defects(spark, folder).filter("defect IS NOT NULL")


def p7_mix(spark, folder):
    return mix_sources(_table(spark, folder, "documents"), _table(spark, folder, "mix_targets"))[0]


def p7_shares(spark, folder):
    return mix_sources(_table(spark, folder, "documents"), _table(spark, folder, "mix_targets"))[1]


def p8_statistics(spark, folder):
    return text_types(_table(spark, folder, "documents"), _table(spark, folder, "common_words"))


def p8_found(spark, folder):
    return p8_statistics(spark, folder).filter("kind <> 'prose'").select("doc_id", "kind")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (p1_found, p1_text, p2_found, p2_pieces, p3_found, p3_text, p4_found, p4_text, p5_found, p5_defects, p6_ids, p7_mix, p7_shares, p8_found, p8_statistics)
    return {f.__name__: f for f in named}
