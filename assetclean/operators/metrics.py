"""Quality metrics, typo listing and group profiles.

Percentages use ``bround`` (half-even), matching how the source rounds the
binary value in the usual dyadic cases (1/800 -> 0.12, not 0.13).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetclean.functions.text import pipe_key

PROFILE_EXAMPLES = 10


def type_metrics(enriched: DataFrame, order_col: str = "_ord") -> DataFrame:
    """A8 + A9 + O2: ``device_type, count, percentage``, count descending; ties
    keep the order of first appearance in the date-sorted output."""
    first = F.min(F.struct(F.col("manufactured_date"), F.col(order_col))) if order_col in enriched.columns else F.min("manufactured_date")
    counts = enriched.groupBy("device_type").agg(F.count(F.lit(1)).alias("count"), first.alias("_first"))
    total = F.sum("count").over(Window.partitionBy())  # tiny: one row per device type
    return (
        counts.withColumn("percentage", F.bround(F.col("count") / total * 100, 2))
        .orderBy(F.desc("count"), "_first")
        .drop("_first")
    )


def _out_col(df: DataFrame, *names: str):
    for n in names:
        if n in df.columns:
            return F.coalesce(F.col(f"`{n}`"), F.lit(""))
    return F.lit("")


def row_confidence(enriched: DataFrame, types: DataFrame, dates: DataFrame) -> DataFrame:
    """A10 / J14 per row: keys from the *output* columns named exactly
    ``manufacturer``, ``model``, ``serial number`` / ``serial_number``; a
    missing cache entry or confidence counts as 1.0."""
    mfg, model = _out_col(enriched, "manufacturer"), _out_col(enriched, "model")
    blank = F.col("`serial number`") if "serial number" in enriched.columns else F.lit(None)
    sn = F.coalesce(F.nullif(blank, F.lit("")), _out_col(enriched, "serial_number"))
    e = enriched.withColumns({"_tk": pipe_key(mfg, model), "_dk": pipe_key(mfg, model, sn)})
    t = types.select(F.col("type_key").alias("_tk"), F.coalesce(F.col("confidence"), F.lit(1.0)).alias("_tc"))
    d = dates.select(F.col("date_key").alias("_dk"), F.coalesce(F.col("confidence"), F.lit(1.0)).alias("_dc"))
    e = e.join(t, "_tk", "left").join(d, "_dk", "left")
    return e.withColumn("row_confidence", (F.coalesce("_tc", F.lit(1.0)) + F.coalesce("_dc", F.lit(1.0))) / 2.0).drop(
        "_tk", "_dk", "_tc", "_dc"
    )


def average_confidence(enriched: DataFrame, types: DataFrame, dates: DataFrame) -> DataFrame:
    """A10: one row ``total_records, average_confidence`` (100.0 when empty)."""
    rc = row_confidence(enriched, types, dates)
    return rc.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.coalesce(F.bround(F.avg("row_confidence") * 100, 2), F.lit(100.0)).alias("average_confidence"),
    )


def typo_list(types: DataFrame) -> DataFrame:
    """M7: flagged cache entries with upper-cased names and a percentage."""
    parts = F.split(F.col("type_key"), r"\|", 2)
    return types.where(F.col("probable_typo")).select(
        F.col("type_key").alias("key"),
        F.upper(parts[0]).alias("manufacturer"),
        F.upper(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))).alias("model"),
        F.coalesce(F.col("device_type"), F.lit("Medical Device")).alias("device_type"),
        F.bround(F.coalesce(F.col("confidence"), F.lit(1.0)) * 100, 1).alias("confidence"),
    )


def profile_groups(df: DataFrame, mfg: str, model: str, sn: str, order_col: str = "_ord", k: int = PROFILE_EXAMPLES) -> DataFrame:
    """Per case-sensitive (manufacturer, model): row count, first
    and last ``k`` serials in input order.

    Each end is a ``row_number() <= k`` filter, which Spark executes with a
    partial per-map-task limit before the shuffle, so a huge group ships at
    most ``k`` rows per task; only 2k rows per group are ever collected.
    """
    base = df.select(
        F.col(f"`{mfg}`").alias("manufacturer"), F.col(f"`{model}`").alias("model"), F.col(f"`{sn}`").alias("sn"), F.col(order_col).alias("_o")
    )
    g = ["manufacturer", "model"]
    counts = base.groupBy(*g).agg(F.count(F.lit(1)).alias("total"))
    head = base.withColumn("_r", F.row_number().over(Window.partitionBy(*g).orderBy("_o"))).where(F.col("_r") <= k)
    tail = base.withColumn("_r", F.row_number().over(Window.partitionBy(*g).orderBy(F.desc("_o")))).where(F.col("_r") <= k)

    def listed(part: DataFrame, name: str, asc: bool) -> DataFrame:
        agg = part.groupBy(*g).agg(F.array_sort(F.collect_list(F.struct(F.col("_o"), F.col("sn")))).alias("_l"))
        return agg.select(*g, F.transform("_l", lambda x: x["sn"]).alias(name))

    return counts.join(listed(head, "first_serials", True), g).join(listed(tail, "last_serials", False), g)


def summary(raw: DataFrame, enriched: DataFrame, types: DataFrame, model_corrections: DataFrame) -> DataFrame:
    """Run counters as ``metric, value`` rows (no join of the sides).

    The enrich plan keeps every de-duplicated row, so rows written equals rows
    after de-duplication, and what is missing was a duplicate. Typo items are
    the flagged types and the model corrections."""

    def one(df: DataFrame, name: str, value) -> DataFrame:
        return df.agg(F.coalesce(value, F.lit(0)).cast("long").alias("value")).select(F.lit(name).alias("metric"), "value")

    resolved = F.count_if(F.col("mfg_source").isin("cache", "rules", "external")) if "mfg_source" in enriched.columns else F.lit(0)
    sides = raw.select(F.lit(1).alias("n")).unionByName(enriched.select(F.lit(-1).alias("n")))
    typos = types.where(F.col("probable_typo")).select(F.lit(1).alias("n")).unionByName(model_corrections.select(F.lit(1).alias("n")))
    return (
        one(raw, "input_rows", F.count(F.lit(1)))
        .unionByName(one(enriched, "rows_written", F.count(F.lit(1))))
        .unionByName(one(sides, "duplicates_removed", F.sum("n")))
        .unionByName(one(enriched, "manufacturers_resolved", resolved))
        .unionByName(one(typos, "typo_items_flagged", F.count(F.lit(1))))
    )


def profile_summary(df: DataFrame, mfg: str, model: str) -> DataFrame:
    """``pairs, rows``: distinct case-sensitive (manufacturer, model), rows."""
    counts = df.groupBy(F.col(f"`{mfg}`"), F.col(f"`{model}`")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def dashboard_stats(enriched: DataFrame, in_view=None) -> DataFrame:
    """A14 in one pass: rows in the current view (``in_view`` predicate), number
    of device types over the whole table, first and last date in the view
    (min/max; under the default date sort these are the first/last rows)."""
    v = F.lit(True) if in_view is None else in_view
    return enriched.agg(
        F.count_if(v).alias("rows"),
        F.count_distinct("device_type").alias("device_types"),
        F.min(F.when(v, F.col("manufactured_date"))).alias("first_date"),
        F.max(F.when(v, F.col("manufactured_date"))).alias("last_date"),
    )
