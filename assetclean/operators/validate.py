"""Canonical manufacturer, product metadata lookup, year bounds.

The metadata table is fixed (53 rows), so the contains-style first-match
lookup goes through constants of the plan, row by row: no join, no shuffle,
and nothing that grows with the data is ever broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetclean.functions.constants import constant, constant_map
from assetclean.functions.dates import HORIZON_YEAR
from assetclean.functions.text import bind, clean_key, col, model_norm
from assetclean.sources.metadata import manufacturer_keys, metadata_rows

# Ordered substring rules that name the canonical manufacturer
# key. The first rule whose substring occurs in the lower-cased name wins;
# "ge" is deliberately broad (it is tested early).
CANONICAL_RULES: list[tuple[tuple[str, ...], str]] = [
    (("arjo",), "arjo"),
    (("adc", "american diagnostic"), "american diagnostic"),
    (("baxter",), "baxter"),
    (("biosonic",), "biosonic"),
    (("cogentix",), "cogentix"),
    (("covidien",), "covidien"),
    (("edan",), "edan"),
    (("exergen",), "exergen"),
    (("ge", "general electric"), "ge healthcare"),
    (("hillrom", "hill rom", "hill-rom"), "hillrom"),
    (("hospira",), "hospira"),
    (("jiangmen", "dacheng"), "jiangmen dacheng"),
    (("lab corp", "labcorp"), "lab corp"),
    (("linet",), "linet"),
    (("masimo",), "masimo"),
    (("mindray",), "mindray"),
    (("olympus",), "olympus"),
    (("philips",), "philips"),
    (("stryker",), "stryker"),
    (("thermo",), "thermo scientific"),
    (("unico",), "unico"),
    (("welch allyn",), "welch allyn"),
    (("zoll",), "zoll"),
]

MIN_GLOBAL_YEAR = 1850


def canonical_manufacturer(c: str | Column) -> Column:
    """Ordered contains-rules, then any metadata key, else null."""
    rules = [{"sub": sub, "key": key} for subs, key in CANONICAL_RULES for sub in subs] + [{"sub": key, "key": key} for key in manufacturer_keys()]
    first = bind(clean_key(c), lambda k: F.get(F.filter(constant(rules), lambda r: k.contains(r["sub"])), F.lit(0)))
    return F.when(col(c).isNull() | (col(c) == ""), F.lit(None).cast("string")).otherwise(first["key"])


def _models() -> Column:
    """The metadata table as a constant map: manufacturer key -> its models in
    table order. The table is fixed (53 rows)."""
    by: dict[str, list[dict]] = {}
    for _, key, founded, _, model, start, sources in metadata_rows():
        by.setdefault(key, []).append({"mfg_key": key, "founded_year": founded, "model": model, "start_year": start, "sources": sources})
    return constant_map(by)


def metadata_entry(mfg: str | Column, model: str | Column) -> Column:
    """J8 + J9 as one value: the metadata row that applies, or null."""

    def entry(of: Column) -> Column:
        direct = F.filter(of["models"], lambda m: m["model"] == of["name"])
        either = F.filter(of["models"], lambda m: of["name"].contains(m["model"]) | m["model"].contains(of["name"]))
        return F.coalesce(F.get(direct, F.lit(0)), F.get(either, F.lit(0)))

    models = F.try_element_at(_models(), canonical_manufacturer(mfg))
    return bind(F.struct(models.alias("models"), model_norm(model).alias("name")), entry)


def lookup_metadata(df: DataFrame, mfg: str = "mfg", model: str = "model", prefix: str = "meta_") -> DataFrame:
    """J8 + J9: add ``{prefix}mfg_key, {prefix}founded_year, {prefix}start_year,
    {prefix}sources`` to every row (nulls when no metadata entry applies).

    Direct match on the normalised model wins; otherwise the first model (in
    the table's fixed order) where either name contains the other. A row looks
    only at its manufacturer's few models, in an array of a constant map: no
    join, no shuffle and little generated code.
    """
    e = f"{prefix}entry"
    out = df.withColumn(e, metadata_entry(mfg, model))
    return out.withColumns({f"{prefix}{f}": F.col(e)[f] for f in ("mfg_key", "founded_year", "start_year", "sources")}).drop(e)


def year_check(year: Column, founded: Column, start: Column, horizon: int = HORIZON_YEAR) -> Column:
    """V1 on already-joined metadata: ``struct(is_valid, reason)``; first failing
    reason wins. Without metadata the global window 1850..horizon applies."""
    no_meta = founded.isNull()
    reason = (
        F.when(
            no_meta & ((year < MIN_GLOBAL_YEAR) | (year > horizon)),
            F.format_string(f"Year %d is outside global historical boundaries ({MIN_GLOBAL_YEAR}-{horizon}).", year),
        )
        .when(no_meta, F.lit("No metadata available for this model/manufacturer; passed default sanity check."))
        .when(
            year < founded,
            F.format_string("Year %d is invalid because the manufacturer was founded later in %d.", year, founded),
        )
        .when(
            year < start,
            F.format_string("Year %d is invalid because the product did not begin production until %d.", year, start),
        )
        .when(
            year > horizon,
            F.format_string(f"Year %d is in the future relative to the dataset context (max {horizon}).", year),
        )
        .otherwise(F.lit("Valid"))
    )
    valid = F.when(no_meta, (year >= MIN_GLOBAL_YEAR) & (year <= horizon)).otherwise(
        (year >= founded) & (year >= start) & (year <= horizon)
    )
    return F.struct(valid.alias("is_valid"), reason.alias("reason"))


def validate_years(df: DataFrame, mfg: str, model: str, year: str, horizon: int = HORIZON_YEAR) -> DataFrame:
    """V1-V3 as one operator: metadata lookup, then ``is_valid`` and ``reason``."""
    out = lookup_metadata(df, mfg, model, prefix="meta_")
    chk = year_check(F.col(year), F.col("meta_founded_year"), F.col("meta_start_year"), horizon)
    return out.withColumns({"is_valid": chk["is_valid"], "reason": chk["reason"]})
