"""Registered queries: one per operator family, each over the inventory
derived from ``orders`` (and its derived side tables), so the work grows
with the input tables. Every callable takes ``(spark, sf_dir)``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetclean.functions.dates import normalize_date
from assetclean.operators import consensus as C
from assetclean.operators import metrics as M
from assetclean.operators import view as V
from assetclean.operators.contain import lookup_products
from assetclean.operators.decode import decode_serials
from assetclean.operators.dedup import dedup_first, with_working_columns
from assetclean.operators.infer import guess_manufacturer, infer_manufacturers
from assetclean.operators.repair import apply_corrections, find_corrections, model_corrections, serial_corrections, written_groups
from assetclean.operators.resolve import decode_once, resolve_dates, resolve_types, unresolved_dates, unresolved_types, with_keys
from assetclean.operators.validate import validate_years
from assetclean.plans import reports as R
from assetclean.plans.enrich import enrich
from assetclean.session import cut, work_dir
from assetclean.sources import caches
from assetclean.sources import testdata as td

HEADERS = {"mfg": "manufacturer", "model": "model", "sn": "serial_number"}
SEARCH_TERM = "Monitor"
SORT_PAGE = (3, "model", "desc")


def _inv(spark: SparkSession, sf: str) -> DataFrame:
    td.register_views(spark, sf)
    return spark.table("inventory")


def _deduped(spark: SparkSession, sf: str) -> DataFrame:
    return dedup_first(with_working_columns(_inv(spark, sf), HEADERS))


def _inferred(spark: SparkSession, sf: str) -> DataFrame:
    """De-duplicated rows with manufacturers inferred: the analysis base, read
    by every correction statistic, so it is written once to the shared work
    folder."""
    rows = infer_manufacturers(_deduped(spark, sf), raw_mfg="manufacturer")
    return cut(rows, "inferred")


def _fixed(spark: SparkSession, sf: str) -> DataFrame:
    rows = _inferred(spark, sf)
    return cut(with_keys(apply_corrections(rows, find_corrections(rows), HEADERS)), "fixed")


def _part_rows(spark: SparkSession, sf: str) -> DataFrame:
    td.register_base_tables(spark, sf, ("part",))
    rows = dedup_first(with_working_columns(spark.sql(td.PART_AS_INVENTORY_SQL), HEADERS))
    return cut(rows, "part")


def q_part_dedup(spark, sf):
    td.register_base_tables(spark, sf, ("part",))
    return dedup_first(with_working_columns(spark.sql(td.PART_AS_INVENTORY_SQL), HEADERS)).select(
        "_ord", "manufacturer", "model", "serial_number"
    )


def q_part_model_corrections(spark, sf):
    mc = model_corrections(written_groups(_part_rows(spark, sf)))
    return mc.select("g_mfg", "g_model", "original", "corrected", "manufacturer", "kind", "distance", "reason")


def q_part_serial_corrections(spark, sf):
    rows = _part_rows(spark, sf)
    return serial_corrections(rows, written_groups(rows)).select("sn", "corrected", "manufacturer", "model", "kind", "reason")


def q_dashboard_stats(spark, sf):
    e = _enriched(spark, sf).enriched
    return M.dashboard_stats(e, V.search_condition(e, SEARCH_TERM))


def q_run_summary(spark, sf):
    res = _enriched(spark, sf)
    return M.summary(_inv(spark, sf), res.detail, res.types, res.corrections.models)


def q_dedup_first(spark, sf):
    return _deduped(spark, sf).select("_ord", "manufacturer", "model", "serial_number")


def q_infer_manufacturer(spark, sf):
    d = _deduped(spark, sf).where(F.col("w_mfg") == "")
    return d.select("_ord", "model", "serial_number", guess_manufacturer("w_model", "w_sn").alias("guessed"))


def q_resolve_manufacturer(spark, sf):
    td.register_views(spark, sf)
    ext = C.consensus_manufacturers(spark.table("mfr_answers"), spark.table("mfr_answers"))
    rows = infer_manufacturers(cut(_deduped(spark, sf), "dedup"), cache=spark.table("mfr_cache"), external=ext, raw_mfg="manufacturer")
    return rows.select("_ord", "manufacturer", F.col("w_mfg").alias("resolved"), "mfg_source")


def q_model_corrections(spark, sf):
    mc = model_corrections(written_groups(_inferred(spark, sf)))
    return mc.select("g_mfg", "g_model", "original", "corrected", "manufacturer", "kind", "distance", "reason")


def q_serial_corrections(spark, sf):
    rows = _inferred(spark, sf)
    sc = serial_corrections(rows, written_groups(rows))
    return sc.select("sn", "corrected", "manufacturer", "model", "kind", "reason")


def q_apply_corrections(spark, sf):
    return _fixed(spark, sf).select(
        "_ord", "manufacturer", "model", "serial_number", F.col("w_mfg").alias("mfg"), F.col("w_model").alias("model_fixed"), F.col("w_sn").alias("sn_fixed")
    )


def q_decode_serials(spark, sf):
    d = decode_serials(_deduped(spark, sf), "w_mfg", "w_model", "w_sn", keep_detail=True)
    return d.select("_ord", "rule_id", "dec_year", "dec_month", "dec_day", "decoded_date")


def q_decode_by_year(spark, sf):
    return _flagship(_deduped(spark, sf))


def _flagship(rows: DataFrame) -> DataFrame:
    """Devices per decoded manufacture year (decode, serial year, else 1900), after dedup."""
    out = resolve_dates(with_keys(rows))
    return out.groupBy(F.substring("manufactured_date", 1, 4).alias("year")).agg(F.count(F.lit(1)).alias("devices"))


def q_validate_years(spark, sf):
    d = decode_serials(_deduped(spark, sf), "w_mfg", "w_model", "w_sn", keep_detail=True)
    # rows with a year; a filter on it would be moved below the decode and decode once more
    d = d.select("_ord", "w_mfg", "w_model", F.explode(F.array_compact(F.array("dec_year"))).alias("dec_year"))
    v = validate_years(d, "w_mfg", "w_model", "dec_year")
    return v.select("_ord", "dec_year", "meta_mfg_key", "meta_founded_year", "meta_start_year", "is_valid", "reason")


def q_normalize_dates(spark, sf):
    td.register_views(spark, sf)
    raw = spark.sql(td.NOISY_DATES_SQL)
    return raw.select("_ord", "raw", normalize_date("raw").alias("normalized"))


def q_resolve_types(spark, sf):
    out = resolve_types(_fixed(spark, sf), spark.table("type_cache"))
    return out.select("_ord", "type_key", "device_type", "probable_typo", "type_confidence", "type_source")


def q_unresolved_types(spark, sf):
    return unresolved_types(_fixed(spark, sf), spark.table("type_cache"))


def q_resolve_dates(spark, sf):
    out = resolve_dates(_fixed(spark, sf), spark.table("date_cache"))
    return out.select("_ord", "date_key", "manufactured_date", "date_source", "date_confidence")


def q_apply_overrides(spark, sf):
    td.register_views(spark, sf)
    return caches.apply_overrides(spark.table("type_cache"), spark.table("type_overrides"))


def q_cache_upsert(spark, sf):
    out = resolve_dates(_fixed(spark, sf), spark.table("date_cache"))
    new = (
        out.where(F.col("date_source") == "decode")
        .groupBy("date_key")
        .agg(F.min_by(F.struct(F.col("manufactured_date").alias("date"), F.col("date_confidence").alias("confidence")), "_ord").alias("v"))
        .select("date_key", "v.*")
    )
    # read by both sides of the upsert: written, so that dates are resolved once
    return caches.upsert(spark.table("date_cache"), cut(new, "new_dates"), "date_key")


def q_rules_table(spark, sf):
    td.register_views(spark, sf)
    return caches.rules_table(spark.table("type_cache"))


def _unresolved_date_rows(spark, sf) -> DataFrame:
    fixed = _fixed(spark, sf)
    dec = decode_once(fixed)
    # read for the serials and for the names: written, so that the decode runs once
    return cut(unresolved_dates(dec, spark.table("date_cache")), "unresolved")


def q_resolver_batches(spark, sf):
    return C.request_batches(_unresolved_date_rows(spark, sf))


def q_consensus_types(spark, sf):
    todo = unresolved_types(_fixed(spark, sf), spark.table("type_cache"))
    return C.consensus_types(todo, spark.table("type_answers"))


def q_consensus_mfr(spark, sf):
    td.register_views(spark, sf)
    rows = infer_manufacturers(_deduped(spark, sf), cache=spark.table("mfr_cache"))
    todo = rows.where(F.col("w_mfg") == "").select(F.concat_ws("|", F.lower("w_model"), F.lower("w_sn")).alias("mfr_key"))
    return C.consensus_manufacturers(todo, spark.table("mfr_answers"))


def q_consensus_dates(spark, sf):
    b = C.request_batches(_unresolved_date_rows(spark, sf))
    return C.consensus_dates(b, spark.table("date_answers"))


def q_check_external(spark, sf):
    b = C.request_batches(_unresolved_date_rows(spark, sf))
    return C.check_external(C.consensus_dates(b, spark.table("date_answers")))


def _enriched(spark, sf):
    td.register_views(spark, sf, written=True)
    return enrich(
        spark.table("inventory"),
        types=spark.table("type_cache"),
        dates=spark.table("date_cache"),
        mfr_cache=spark.table("mfr_cache"),
        type_answers=spark.table("type_answers"),
        date_answers=spark.table("date_answers"),
        mfr_answers=spark.table("mfr_answers"),
        checkpoint=True,
    )


def q_enrich(spark, sf):
    return _enriched(spark, sf).enriched


def q_type_metrics(spark, sf):
    return M.type_metrics(_enriched(spark, sf).enriched)


def q_avg_confidence(spark, sf):
    res = _enriched(spark, sf)
    return M.average_confidence(res.enriched, res.types, res.dates)


def q_typo_list(spark, sf):
    return M.typo_list(_enriched(spark, sf).types)


def q_profile_groups(spark, sf):
    p = M.profile_groups(_inv(spark, sf), "manufacturer", "model", "serial_number")
    return p.select(
        "manufacturer", "model", "total", F.array_join("first_serials", ",").alias("first_serials"), F.array_join("last_serials", ",").alias("last_serials")
    )


def q_search_rows(spark, sf):
    return V.search_rows(_enriched(spark, sf).enriched, SEARCH_TERM)


def q_sort_page(spark, sf):
    n, key, direction = SORT_PAGE
    return V.page(_enriched(spark, sf).enriched, n, key, direction)


def q_last_page(spark, sf):
    """The last page by model, descending, from a stored page index."""
    _, key, direction = SORT_PAGE
    index = V.index_pages(_enriched(spark, sf).enriched, f"{work_dir(spark)}/pages-{uuid.uuid4().hex}", key, direction)
    pages = index.page_count().first()["pages"]
    return index.page(pages).withColumn("pages", F.lit(pages).cast("long"))


def q_typo_report(spark, sf):
    res = _enriched(spark, sf)
    return R.numbered(R.typo_report(res.types, res.corrections.models))


def q_corrections_report(spark, sf):
    return R.numbered(R.corrections_report(_enriched(spark, sf).corrections))


def q_mfr_cache_upsert(spark, sf):
    return _enriched(spark, sf).manufacturers


def q_profile_summary(spark, sf):
    return M.profile_summary(_inv(spark, sf), "manufacturer", "model")


def q_lookup_products(spark, sf):
    """Rows of `customer` looked up in a product table that grows with them."""
    td.register_base_tables(spark, sf, ("customer",))
    products = spark.sql(td.CUSTOMER_PRODUCTS_SQL).withColumn("sources", F.array(F.lit("table")))
    found = lookup_products(spark.sql(td.CUSTOMER_AS_INVENTORY_SQL), products, "manufacturer", "model")
    return found.drop("meta_sources")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "dedup_first": q_dedup_first,
    "infer_manufacturer": q_infer_manufacturer,
    "resolve_manufacturer": q_resolve_manufacturer,
    "model_corrections": q_model_corrections,
    "serial_corrections": q_serial_corrections,
    "apply_corrections": q_apply_corrections,
    "decode_serials": q_decode_serials,
    "decode_by_year": q_decode_by_year,
    "validate_years": q_validate_years,
    "normalize_dates": q_normalize_dates,
    "resolve_types": q_resolve_types,
    "unresolved_types": q_unresolved_types,
    "resolve_dates": q_resolve_dates,
    "apply_overrides": q_apply_overrides,
    "cache_upsert": q_cache_upsert,
    "rules_table": q_rules_table,
    "resolver_batches": q_resolver_batches,
    "consensus_types": q_consensus_types,
    "consensus_mfr": q_consensus_mfr,
    "consensus_dates": q_consensus_dates,
    "check_external": q_check_external,
    "enrich": q_enrich,
    "type_metrics": q_type_metrics,
    "avg_confidence": q_avg_confidence,
    "typo_list": q_typo_list,
    "profile_groups": q_profile_groups,
    "search_rows": q_search_rows,
    "sort_page": q_sort_page,
    "last_page": q_last_page,
    "typo_report": q_typo_report,
    "corrections_report": q_corrections_report,
    "dashboard_stats": q_dashboard_stats,
    "run_summary": q_run_summary,
    "mfr_cache_upsert": q_mfr_cache_upsert,
    "profile_summary": q_profile_summary,
    "lookup_products": q_lookup_products,
    "part_dedup": q_part_dedup,
    "part_model_corrections": q_part_model_corrections,
    "part_serial_corrections": q_part_serial_corrections,
}
