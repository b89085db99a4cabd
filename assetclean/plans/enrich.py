"""S12 / E-1: the whole cleaning and enrichment job as lazy DataFrames.

    raw -> header roles -> trimmed working columns -> first-row dedup
        -> manufacturer inference (cache, rules, external)
        -> corrections (find on the whole table, then apply once)
        -> device type (cache, external, default)
        -> manufacture date (cache, decode, external, serial year, 1900-01-01)
        -> output columns + manufactured_date + device_type, sorted by date

The de-duplicated table feeds three consumers (analysis, apply, reports),
so it is written as Parquet to the shared work folder (see session.work_dir),
which ends its lineage and survives lost executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetclean.functions.dates import HORIZON_YEAR
from assetclean.operators import consensus as C
from assetclean.operators.dedup import dedup_first, drop_reserved, resolve_headers, with_working_columns
from assetclean.operators.infer import infer_manufacturers
from assetclean.operators.repair import Corrections, apply_corrections, find_corrections
from assetclean.operators.resolve import decode_once, resolve_dates, resolve_types, unresolved_dates, unresolved_types, with_keys
from assetclean.sources import caches
from assetclean.functions.text import pipe_key
from assetclean.session import cut

WORK_PREFIXES = ("w_", "g_")
INTERNAL = (
    "type_key",
    "date_key",
    "decoded_date",
    "probable_typo",
    "type_confidence",
    "type_source",
    "date_source",
    "date_confidence",
    "mfg_source",
)


@dataclass
class EnrichResult:
    enriched: DataFrame  # output rows (+ ``_ord``), sorted by manufactured_date, then input order
    detail: DataFrame  # same rows with working columns, sources and confidences
    corrections: Corrections
    types: DataFrame  # type cache after the run
    dates: DataFrame  # date cache after the run
    manufacturers: DataFrame  # manufacturer cache after the run
    headers: dict


def prepare(raw: DataFrame, order_col: str = "_ord") -> tuple[DataFrame, dict]:
    headers = resolve_headers([c for c in raw.columns if c != order_col])
    return dedup_first(with_working_columns(raw, headers), order_col=order_col), headers


def _cut(df: DataFrame, checkpoint: bool, name: str) -> DataFrame:
    return cut(df, name) if checkpoint else df


def new_manufacturers(rows: DataFrame, order_col: str = "_ord") -> DataFrame:
    """What the run adds to the manufacturer cache: the guessed, cached and
    external answers of blank rows, first seen first; no unknown ones."""
    from assetclean.operators.infer import UNKNOWN_MANUFACTURER

    known = rows.where(F.col("mfg_source").isin("cache", "rules", "external") & (F.col("w_mfg") != UNKNOWN_MANUFACTURER))
    return known.groupBy(pipe_key("w_model", "w_sn").alias("mfr_key")).agg(F.min_by("w_mfg", order_col).alias("manufacturer"))


def enrich(
    raw: DataFrame,
    types: DataFrame | None = None,
    dates: DataFrame | None = None,
    mfr_cache: DataFrame | None = None,
    type_answers: DataFrame | None = None,
    date_answers: DataFrame | None = None,
    mfr_answers: DataFrame | None = None,
    horizon: int = HORIZON_YEAR,
    order_col: str = "_ord",
    checkpoint: bool = True,
) -> EnrichResult:
    spark = raw.sparkSession
    types = types if types is not None else caches.empty(spark, caches.TYPE_CACHE_SCHEMA)
    rows, headers = prepare(raw, order_col)

    if mfr_cache is not None or mfr_answers is not None:
        rows = _cut(rows, checkpoint, "dedup")
    ext_mfr = None
    if mfr_answers is not None:
        ext_mfr = C.consensus_manufacturers(None, mfr_answers)
    rows = infer_manufacturers(rows, cache=mfr_cache, external=ext_mfr, raw_mfg=headers.get("mfg"))
    rows = _cut(rows, checkpoint, "rows")
    mfr_after = new_manufacturers(rows, order_col)
    if mfr_cache is not None:
        mfr_after = caches.upsert(mfr_cache.select("mfr_key", "manufacturer"), mfr_after, "mfr_key")

    corr = find_corrections(rows, order_col=order_col)
    fixed = _cut(with_keys(apply_corrections(rows, corr, headers)), checkpoint, "fixed")

    types_after = types
    ext_types = None
    if type_answers is not None:
        todo = unresolved_types(fixed, types, order_col)
        ext_types = C.consensus_types(todo, type_answers)
        types_after = caches.upsert(types, ext_types, "type_key")
    out = resolve_types(fixed, types, ext_types)

    ext_dates = None
    if date_answers is not None:
        out = _cut(decode_once(out, horizon, order_col), checkpoint, "decoded")
        todo = unresolved_dates(out, dates)
        batches = C.request_batches(todo, order_col)
        checked = C.check_external(C.consensus_dates(batches, date_answers), horizon)
        # serials differing only in case share a date key: the last one (by serial) wins
        ext_dates = checked.groupBy("date_key").agg(
            F.max_by(F.struct(F.col("date"), F.col("confidence")), F.col("sn")).alias("_v")
        ).select("date_key", "_v.*")
    out = resolve_dates(out, dates, ext_dates, horizon, order_col)

    new_dates = (
        out.where(F.col("date_source").isin("decode", "external"))
        .groupBy("date_key")
        .agg(
            F.min_by(
                F.struct(F.col("manufactured_date").alias("date"), F.col("date_confidence").alias("confidence")), F.col(order_col)
            ).alias("_v")
        )
        .select("date_key", "_v.*")
    )
    dates_after = new_dates if dates is None else caches.upsert(dates, new_dates, "date_key")

    detail = out
    keep = [c for c in out.columns if not c.startswith(WORK_PREFIXES) and c not in INTERNAL and c not in ("manufactured_date", "device_type")]
    body = drop_reserved(out.select(*[F.col(f"`{c}`") for c in keep]))
    enriched = out.select(*[F.col(f"`{c}`") for c in body.columns], "manufactured_date", "device_type").orderBy(
        "manufactured_date", order_col
    )
    return EnrichResult(enriched, detail, corr, types_after, dates_after, mfr_after, headers)


def write_enriched(result: EnrichResult, path: str, order_col: str = "_ord") -> None:
    """The enriched table as CSV with a header, rows in date order (the
    range-partitioned sort keeps part files in order). Cells keep their outer
    spaces, quotes are doubled. Unlike the source, an empty result still writes
    a file set with the header, and lines end with a newline alone."""
    csv_writer(result.enriched.drop(order_col)).csv(path)


def csv_writer(df: DataFrame):
    return (
        df.write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("emptyValue", "")
        .option("nullValue", "")
    )
