"""What several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blanks that stray around keys.
BLANKS = " \t\r\n\u00a0\u3000\u200b\ufeff"


def plain_key(c: Column | str) -> Column:
    """A source or split in its plain form: stray blanks off, lower case."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.btrim(c, F.lit(BLANKS)))


def small_rows(df: DataFrame, most: int) -> list:
    """The rows of a parameter table, which must not exceed ``most``."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a parameter table has more than {most} rows")
    return rows
