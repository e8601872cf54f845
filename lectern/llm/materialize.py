"""Small tables on the driver, with a bound; and tables written in the folder that the cluster names for checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row

from ..session import written  # noqa: F401

#: Rows that a lookup table may have to be gathered and sent to all tasks.
LOOKUP_ROWS = 100_000


def gathered(df: DataFrame, what: str, rows: int = LOOKUP_ROWS) -> list[Row]:
    """All rows of a lookup table, such as titles or target weights; one beyond the bound is refused, not cut."""
    out = df.limit(rows + 1).collect()
    if len(out) > rows:
        raise ValueError(f"{what} has more than {rows} rows")
    return out
