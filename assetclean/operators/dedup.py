"""Working columns and first-row-wins de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetclean.functions.text import clean_key, strip

# Header roles, matched on lower-cased stripped header names.
ROLE_HEADERS = {
    "mfg": ("manufacturer",),
    "model": ("model",),
    "sn": ("serial number", "serial_number"),
}
RESERVED_OUTPUT = ("manufactured_date", "device_type", "is_duplicate", "probable_typo")


def resolve_headers(columns: list[str]) -> dict[str, str | None]:
    """Map each role to the real column name (last duplicate wins)."""
    by_norm: dict[str, str] = {}
    for c in columns:
        by_norm[c.lower().strip()] = c
    out: dict[str, str | None] = {}
    for role, names in ROLE_HEADERS.items():
        out[role] = next((by_norm[n] for n in names if n in by_norm), None)
    return out


def with_working_columns(df: DataFrame, headers: dict[str, str | None] | None = None) -> DataFrame:
    """Trimmed working copies ``w_mfg, w_model, w_sn, w_sn_orig``; raw
    columns stay untouched. A missing header or short row gives ``''``."""
    headers = headers or resolve_headers(df.columns)

    def val(role: str):
        c = headers.get(role)
        return strip(F.coalesce(F.col(f"`{c}`"), F.lit(""))) if c else F.lit("")

    return df.withColumns(
        {"w_mfg": val("mfg"), "w_model": val("model"), "w_sn": val("sn"), "w_sn_orig": val("sn")}
    )


def dedup_first(df: DataFrame, keys: tuple[str, ...] = ("w_mfg", "w_model", "w_sn"), order_col: str = "_ord") -> DataFrame:
    """A1: keep the first row (by ``order_col``) of each case-insensitive key.

    ``row_number() == 1`` lets Spark insert a partial WindowGroupLimit before
    the shuffle, so even a key holding a third of the rows ships one row per
    map task, not the whole group.
    """
    w = Window.partitionBy(*[clean_key(k) for k in keys]).orderBy(F.col(order_col))
    return df.withColumn("_dup_rn", F.row_number().over(w)).where(F.col("_dup_rn") == 1).drop("_dup_rn")


def drop_reserved(df: DataFrame) -> DataFrame:
    """Drop output-reserved columns (by lower-cased stripped name)."""
    return df.drop(*[c for c in df.columns if c.lower().strip() in RESERVED_OUTPUT])
