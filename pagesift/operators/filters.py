"""Month filter (P1-P4) and report search (P5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import loose_month, month_predicate, parse_month


def month_filter(df: DataFrame, col: str, month: str | None,
                 on_invalid: str = "raise", year_bounds: bool = True) -> DataFrame:
    """Rows whose ``col`` falls in ``month`` ('YYYY-MM'); no month -> all rows.

    ``on_invalid='raise'`` rejects a bad filter up front (P3); ``'pass'``
    returns the rows unfiltered (P3b).  The predicate is a half-open range on
    the raw column, so parquet gets both bounds as pushed filters and skips row
    groups outside the month."""
    try:
        ym = parse_month(month, year_bounds=year_bounds)
    except ValueError:
        if on_invalid == "pass":
            return df
        raise
    if ym is None:
        return df
    return df.filter(month_predicate(F.col(col), *ym))


def month_filter_loose(df: DataFrame, col: str, month: str | None) -> DataFrame:
    """P4, the filter on links before extraction: any two integers joined by a
    hyphen count as year and month ('2024-1' is January 2024), a month that no
    calendar has matches nothing, a null date never matches; what is not two
    integers (or nothing) leaves the rows as they are."""
    ym = loose_month(month)
    if ym is None:
        return df
    if not (1 <= ym[1] <= 12 and 1 <= ym[0] <= 9999):
        return df.filter(F.lit(False))
    return df.filter(month_predicate(F.col(col), *ym))


def search(df: DataFrame, query: str, title: str = "title", text: str = "content_text") -> DataFrame:
    """P5: lowercased, trimmed query; empty matches all; substring of
    ``lower(title) + ' ' + lower(text)``."""
    q = query.lower().strip()
    if not q:
        return df
    hay = F.concat(F.lower(F.col(title)), F.lit(" "), F.lower(F.col(text)))
    return df.filter(F.instr(hay, q) > 0)
