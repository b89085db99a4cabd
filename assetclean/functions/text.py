"""String Column functions shared by every operator.

All of these are plain ``pyspark.sql.functions`` compositions, so they stay
inside whole-stage codegen; nothing here is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.strip()`` removes (str.isspace),
# in code-point order. Spark's ``trim`` only removes U+0020, so the input
# cleaning uses ``btrim`` with this set to keep the same semantics.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Leading "(digits)" tag on a serial, optionally followed by whitespace.
PAREN_TAG = r"^\(\d+\)\s*"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row. The optimiser copies
    a named column's expression to each place (and into each turn of a lambda)
    that it moves a filter or a projection to; a lambda's variable it leaves."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: str | Column) -> Column:
    """Python-``strip()`` equivalent: remove leading/trailing whitespace."""
    return F.btrim(col(c), F.lit(PY_WHITESPACE))


def clean_key(c: str | Column) -> Column:
    """Lower-cased stripped text, the key used for every case-insensitive match."""
    return F.lower(strip(c))


def model_norm(c: str | Column) -> Column:
    """lower, strip, collapse inner whitespace runs to one space."""
    return F.regexp_replace(clean_key(c), r"\s+", " ")


def strip_paren_tag(c: str | Column) -> Column:
    """serial without its leading ``(21) `` style tag."""
    return F.regexp_replace(col(c), PAREN_TAG, "")


def paren_tag(c: str | Column) -> Column:
    """The ``(21) `` tag itself, whitespace included ('' when absent)."""
    return F.regexp_extract(col(c), r"^(\(\d+\)\s*)", 1)


def year_in_text(c: str | Column) -> Column:
    """first stand-alone 18xx/19xx/20xx year in free text, or null."""
    y = F.regexp_extract(col(c), r"\b((?:18|19|20)\d{2})\b", 1)
    return F.when(y != "", y)


def pipe_key(*cols: str | Column) -> Column:
    """``a|b|c`` composite key of lower-cased parts (the cache key format)."""
    return F.concat_ws("|", *[F.lower(col(c)) for c in cols])
