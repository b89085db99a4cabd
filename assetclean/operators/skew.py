"""Joins that stay balanced when a few keys hold most of the rows.

``salted_join`` counts the rows of each key and gives a key that holds more
than a ``1 / shares`` part of all rows as many salts as it holds such parts.
At most ``shares`` keys can be that heavy, and their salts are fewer than twice
``shares``, whatever the data: so the table of heavy keys may be broadcast and
the other side is copied fewer than ``2 * shares`` times its rows for one key.
It does not rely on the caller's adaptive settings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

SHARES = 1000


def heavy_keys(rows: DataFrame, on: list[str], shares: int = SHARES) -> DataFrame:
    """(the key columns, ``_salts``) of the keys that hold more than a
    ``1 / shares`` part of the rows; written once, fewer than ``shares`` rows.
    Counting combines on the map side, so a heavy key sends one row a task."""
    counts = cut(rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")), "counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    part = max(total / shares, 1.0)
    return cut(counts.where(F.col("_n") > part).select(*on, F.ceil(F.col("_n") / F.lit(part)).cast("int").alias("_salts")), "heavy")


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", shares: int = SHARES) -> DataFrame:
    """``big`` joined with ``small`` (one row, or few, for each key) on equal
    ``on`` columns, ``how`` = inner or left. Null keys match nothing, as in a
    plain join, and are spread as well. Same rows as ``big.join(small, on)``."""
    if how not in ("inner", "left"):
        raise ValueError(f"how={how}")
    heavy = heavy_keys(big, on, shares)
    salts = heavy.select(*[F.col(c).alias(f"_h_{c}") for c in on], "_salts")
    same = [F.col(c).eqNullSafe(F.col(f"_h_{c}")) for c in on]
    spread = big.join(F.broadcast(salts), same, "left")  # fewer than ``shares`` rows
    spread = spread.withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.col("_salts"))).cast("int"))
    spread = spread.drop("_salts", *[f"_h_{c}" for c in on])
    copies = small.join(F.broadcast(salts), same, "left")
    copies = copies.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
    copies = copies.drop("_salts", *[f"_h_{c}" for c in on])
    return spread.join(copies, [*on, "_salt"], how).drop("_salt")
