"""Text reports as DataFrames of ``line_pos, line`` (text sink optional)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetclean.operators.repair import Corrections

TYPO_HEADER = "The following medical device models are flagged as probable typos or formatting inconsistencies:"
TYPO_NONE = "No probable model typos found in the dataset."
CORR_HEADER = "The enrichment engine dynamically identified and corrected the following formatting inconsistencies:"
CORR_NONE = "No formatting corrections were necessary for this dataset."
MODEL_SECTION = "=== Model Name Spelling & Spacing Corrections ==="
SERIAL_SECTION = "=== Serial Number Formatting Corrections ==="


def _pos(section: int, *parts, text=None) -> F.Column:
    """Place of a line: its section, then up to four numbers, then a text."""
    cols = [F.lit(section).alias("s")] + [(p if isinstance(p, F.Column) else F.lit(p)).cast("long").alias(f"k{i}") for i, p in enumerate(parts)]
    cols += [F.lit(0).cast("long").alias(f"k{i}") for i in range(len(parts), 4)]
    return F.struct(*cols, (F.lit("") if text is None else text).alias("t")).alias("line_pos")


def _headed(body: DataFrame, heading: str, none: str) -> DataFrame:
    """``body`` below its heading and a blank line, or the line for no body."""
    n = body.agg(F.count(F.lit(1)).alias("n"))
    head = n.select(_pos(-2), F.when(F.col("n") > 0, F.lit(heading)).otherwise(F.lit(none)).alias("line"))
    blank = n.where(F.col("n") > 0).select(_pos(-1), F.lit("").alias("line"))
    return head.unionByName(blank).unionByName(body)


def typo_report(types: DataFrame, model_corrections: DataFrame) -> DataFrame:
    """S7 + U4: flagged cache entries in the order of the cache (new ones
    after the old), then model corrections."""
    parts = F.split(F.col("type_key"), r"\|", 2)
    ep = F.col("entry_pos").cast("long") if "entry_pos" in types.columns else F.lit(None).cast("long")
    flagged = types.where(F.col("probable_typo")).select(
        _pos(1, ep.isNull().cast("int"), F.coalesce(ep, F.lit(0)), text=F.col("type_key")),
        F.format_string(
            "Manufacturer: %s | Model: %s (Flagged as probable typo)",
            F.upper(parts[0]),
            F.upper(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))),
        ).alias("line"),
    )
    lp = F.col("line_pos")
    models = model_corrections.select(
        _pos(2, lp["mfg_ord"], lp["p"], lp["a"], lp["b"]), F.concat(F.lit("Model Inconsistency: "), F.col("reason")).alias("line")
    )
    return _headed(flagged.unionByName(models), TYPO_HEADER, TYPO_NONE)


def corrections_report(corr: Corrections) -> DataFrame:
    """Model section, blank line, serial section ("Corrected ..." when the
    value changed, "mismatch noted" otherwise)."""
    lp = F.col("line_pos")
    m = corr.models.select(_pos(1, lp["mfg_ord"], lp["p"], lp["a"], lp["b"]), F.concat(F.lit("- "), F.col("reason")).alias("line"))
    changed = F.col("corrected") != F.col("sn")
    s = corr.serials.select(
        _pos(4, lp["mfg_ord"], lp["first_ord"], lp["rank"], lp["_o"]),
        F.when(
            changed,
            F.format_string(
                "- Corrected serial '%s' to '%s' for manufacturer '%s' (model '%s'): %s", "sn", "corrected", "manufacturer", "model", "reason"
            ),
        )
        .otherwise(
            F.format_string(
                "- Serial formatting mismatch noted for '%s' under '%s' (model '%s'): %s", "sn", "manufacturer", "model", "reason"
            )
        )
        .alias("line"),
    )
    nm = m.agg(F.count(F.lit(1)).alias("n"))
    ns = s.agg(F.count(F.lit(1)).alias("n"))
    frame = lambda df, a, text: df.where(F.col("n") > 0).select(_pos(a), F.lit(text).alias("line"))
    body = (
        frame(nm, 0, MODEL_SECTION)
        .unionByName(m)
        .unionByName(frame(nm, 2, ""))
        .unionByName(frame(ns, 3, SERIAL_SECTION))
        .unionByName(s)
    )
    return _headed(body, CORR_HEADER, CORR_NONE)


def profile_report(profile: DataFrame) -> DataFrame:
    """S10 as lines: the number of pairs, then a block per group in the order
    of manufacturer and model."""
    total = profile.agg(F.count(F.lit(1)).alias("n"))
    head = total.select(F.struct(F.lit("").alias("g"), F.lit("").alias("m"), F.lit(0).alias("i")).alias("line_pos"), F.explode(F.array(F.concat(F.lit("Total unique (manufacturer, model) pairs: "), F.col("n").cast("string")), F.lit(""))).alias("line"))

    def listed(c: str) -> F.Column:
        return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))

    lines = F.array(
        F.format_string("Manufacturer: %s | Model: %s", "manufacturer", "model"),
        F.format_string("  Total count: %d", "total"),
        F.concat(F.lit("  Example serials (first 10): "), listed("first_serials")),
        F.concat(F.lit("  Example serials (last 10): "), listed("last_serials")),
        F.lit(""),
    )
    body = profile.select("manufacturer", "model", F.posexplode(lines).alias("i", "line"))
    return head.unionByName(body.select(F.struct(F.concat(F.lit("\x01"), "manufacturer").alias("g"), F.col("model").alias("m"), F.col("i").cast("int").alias("i")).alias("line_pos"), "line"))


def numbered(report: DataFrame) -> DataFrame:
    """``line_no`` (from 1), ``line``; ranks by ranges, not in one task."""
    from assetclean.operators.consensus import rank_within

    ranked = rank_within(report.withColumn("_all", F.lit(0)), "_all", "line_pos", "line_no")
    return ranked.select(F.col("line_no").cast("long").alias("line_no"), "line")


def write_text(report: DataFrame, path: str) -> None:
    """Optional text sink: lines in report order. The global sort range-
    partitions the lines, so the part files concatenate in order and no
    single task holds the whole report."""
    report.orderBy("line_pos").select("line").write.mode("overwrite").text(path)
