"""Date-string Column functions (F1, F8).

Dates stay ``YYYY-MM-DD`` strings: ``1900-01-01`` is the "unknown" marker and
the final output sort is lexical, exactly as in the source data contract.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assetclean.functions.text import col, strip, year_in_text

UNKNOWN_DATE = "1900-01-01"
HORIZON_YEAR = 2026  # last plausible manufacture year (one parameter, T12)


def week_to_month(week: Column) -> Column:
    """F8: ISO-ish week number -> month, ``max(1, min(12, int(w*7/30.4)+1))``."""
    return F.greatest(F.lit(1), F.least(F.lit(12), F.floor(week * 7 / F.lit(30.4)).cast("int") + 1))


def format_ymd(y: Column, m: Column, d: Column) -> Column:
    return F.format_string("%04d-%02d-%02d", y, m, d)


def normalize_date(c: str | Column, horizon: int = HORIZON_YEAR) -> Column:
    """normalise a free-form date string to ``YYYY-MM-DD``.

    Leading ``Y[-/]M[-/]D`` (prefix match, so a time suffix is ignored); year
    outside 1800..horizon -> 1900; month 13..53 is a week number; any other
    bad month -> 1; day outside 1..28 -> 1. Without that shape a stand-alone
    year gives ``Y-01-01``; anything else is the unknown marker.
    """
    raw = col(c)
    s = strip(raw)
    pat = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})"
    hit = s.rlike(pat)
    y = F.regexp_extract(s, pat, 1).try_cast("int")
    m = F.regexp_extract(s, pat, 2).try_cast("int")
    d = F.regexp_extract(s, pat, 3).try_cast("int")
    y = F.when((y < 1800) | (y > horizon), F.lit(1900)).otherwise(y)
    m = F.when(m.between(13, 53), week_to_month(m)).otherwise(m)
    m = F.when((m < 1) | (m > 12), F.lit(1)).otherwise(m)
    d = F.when((d < 1) | (d > 28), F.lit(1)).otherwise(d)
    free_year = year_in_text(raw)
    return (
        F.when(raw.isNull() | (raw == ""), F.lit(UNKNOWN_DATE))
        .when(hit, format_ymd(y, m, d))
        .when(free_year.isNotNull(), F.concat(free_year, F.lit("-01-01")))
        .otherwise(F.lit(UNKNOWN_DATE))
    )
