"""Merging answers of two external resolvers, request batches, checks.

The calls themselves are outside the engine; answers arrive as DataFrames
with one row per (entity, resolver). Resolver names are ``primary`` and
``secondary``; the primary's answer is the one used when both answered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetclean.functions.dates import UNKNOWN_DATE, normalize_date
from assetclean.operators.infer import UNKNOWN_MANUFACTURER
from assetclean.operators.validate import lookup_metadata, year_check
from assetclean.session import cut
from assetclean.sources.caches import DEFAULT_DEVICE_TYPE

BATCH_SIZE = 30
# Consensus confidences.
TYPE_CONF = {"none": 0.1, "one": 0.5, "agree": 0.95, "differ": 0.60}
DATE_CONF = {"none": 0.1, "one": 0.5, "agree": 0.90, "differ": 0.50}
MIN_DECAYED = 0.3
DECAY_STEP = 0.2


def _pick(resolver: str, c: str) -> Column:
    return F.max(F.when(F.col("resolver") == resolver, F.col(c)))


def consensus_types(entities: DataFrame, answers: DataFrame) -> DataFrame:
    """``entities(type_key)`` x ``answers(type_key, resolver, device_type,
    probable_typo)`` -> ``type_key, device_type, probable_typo, confidence``."""
    a = answers.groupBy("type_key").agg(
        F.max(F.col("resolver") == "primary").alias("has_p"),
        F.max(F.col("resolver") == "secondary").alias("has_s"),
        _pick("primary", "device_type").alias("p_type"),
        _pick("primary", "probable_typo").alias("p_typo"),
        _pick("secondary", "device_type").alias("s_type"),
        _pick("secondary", "probable_typo").alias("s_typo"),
    )
    e = entities.select("type_key").distinct().join(a, "type_key", "left")
    hp, hs = F.coalesce(F.col("has_p"), F.lit(False)), F.coalesce(F.col("has_s"), F.lit(False))
    agree = F.col("p_type").eqNullSafe(F.col("s_type")) & F.col("p_typo").eqNullSafe(F.col("s_typo"))
    conf = (
        F.when(~hp & ~hs, F.lit(TYPE_CONF["none"]))
        .when(~hp | ~hs, F.lit(TYPE_CONF["one"]))
        .when(agree, F.lit(TYPE_CONF["agree"]))
        .otherwise(F.lit(TYPE_CONF["differ"]))
    )
    dtype = F.when(hp, F.col("p_type")).when(hs, F.col("s_type"))
    typo = F.when(hp, F.col("p_typo")).when(hs, F.col("s_typo"))
    return e.select(
        "type_key",
        F.coalesce(dtype, F.lit(DEFAULT_DEVICE_TYPE)).alias("device_type"),
        F.coalesce(typo, F.lit(False)).alias("probable_typo"),
        conf.alias("confidence"),
    )


def consensus_manufacturers(entities: DataFrame | None, answers: DataFrame) -> DataFrame:
    """Primary, else secondary, else ``Unknown Manufacturer``, for each of
    ``entities``, or for all that have an answer."""
    a = answers.groupBy("mfr_key").agg(
        F.max(F.col("resolver") == "primary").alias("has_p"),
        _pick("primary", "manufacturer").alias("p"),
        _pick("secondary", "manufacturer").alias("s"),
    )
    e = a if entities is None else entities.select("mfr_key").distinct().join(a, "mfr_key", "left")
    m = F.when(F.coalesce(F.col("has_p"), F.lit(False)), F.col("p")).otherwise(F.col("s"))
    return e.select("mfr_key", F.coalesce(m, F.lit(UNKNOWN_MANUFACTURER)).alias("manufacturer"))


def rank_within(df: DataFrame, key: str, order: str, out: str = "rank") -> DataFrame:
    """1-based position of each row inside its ``key`` group, by ``order``
    (unique within the key), without sending a group to one task.

    Rows are range-partitioned on (key, order), so a key that holds a third
    of all rows is spread over many partitions. The number of the partition is
    written with the rows, once: counts and local ranks must see the same
    bounds, and two evaluations of a range partitioning need not agree. Each
    partition numbers its rows locally and a small per-(partition, key) count
    table supplies the offsets; only that is ever grouped per key.
    """
    n = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    parts = df.repartitionByRange(int(n), F.col(key), F.col(order)).withColumn("_pid", F.spark_partition_id())
    parts = cut(parts, "ranges")
    local = parts.withColumn("_lrn", F.row_number().over(Window.partitionBy("_pid", key).orderBy(order)))
    counts = local.groupBy("_pid", key).agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = counts.withColumn(
        "_off",
        F.coalesce(
            F.sum("_cnt").over(Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ),
    ).select("_pid", key, "_off")
    return local.join(offsets, ["_pid", key]).withColumn(out, F.col("_off") + F.col("_lrn")).drop("_pid", "_lrn", "_off")


def request_batches(unresolved: DataFrame, order_col: str = "_ord", batch_size: int = BATCH_SIZE) -> DataFrame:
    """C4: distinct non-blank serials per type key, in batches of ``batch_size``
    (by serial order), with the first-seen (manufacturer, model) spelling and
    metadata context (founding year, launch year, two source links)."""
    u = unresolved.where(F.col("w_sn") != "")
    who = unresolved.groupBy("type_key").agg(
        F.min_by(F.struct(F.col("w_mfg").alias("manufacturer"), F.col("w_model").alias("model")), F.col(order_col)).alias("_w")
    )
    who = lookup_metadata(who.select("type_key", "_w.*"), "manufacturer", "model", prefix="meta_")
    serials = u.select("type_key", F.col("w_sn").alias("sn")).distinct()
    ranked = rank_within(serials, "type_key", "sn", "_rank")
    ranked = ranked.withColumn("batch_no", F.floor((F.col("_rank") - 1) / batch_size).cast("int")).drop("_rank")
    return ranked.join(who, "type_key").select(
        "type_key",
        "manufacturer",
        "model",
        "batch_no",
        "sn",
        F.col("meta_founded_year").alias("founded_year"),
        F.col("meta_start_year").alias("product_start_year"),
        F.col("meta_sources")[0].alias("source_1"),
        F.col("meta_sources")[1].alias("source_2"),
    )


def consensus_dates(batches: DataFrame, answers: DataFrame) -> DataFrame:
    """Per batch, merge ``answers(type_key, sn, resolver, date)``.

    No answer at all -> every serial ``1900-01-01`` at 0.1; one resolver ->
    its dates at 0.5; both -> the primary's dates at 0.90 when the two agree
    on every requested serial, else 0.50. Serials the chosen resolver did not
    answer get no date. Returns ``type_key, manufacturer, model, batch_no, sn,
    date, confidence``.
    """
    b = batches.select("type_key", "manufacturer", "model", "batch_no", "sn")
    a = answers.groupBy("type_key", "sn").agg(
        F.max(F.col("resolver") == "primary").alias("p_ans"),
        F.max(F.col("resolver") == "secondary").alias("s_ans"),
        _pick("primary", "date").alias("p_date"),
        _pick("secondary", "date").alias("s_date"),
    )
    j = b.join(a, ["type_key", "sn"], "left")
    w = Window.partitionBy("type_key", "batch_no")
    j = j.withColumns(
        {
            "_hp": F.coalesce(F.max("p_ans").over(w), F.lit(False)),
            "_hs": F.coalesce(F.max("s_ans").over(w), F.lit(False)),
            "_agree": F.min(F.col("p_date").eqNullSafe(F.col("s_date"))).over(w),
        }
    )
    conf = (
        F.when(~F.col("_hp") & ~F.col("_hs"), F.lit(DATE_CONF["none"]))
        .when(~F.col("_hp") | ~F.col("_hs"), F.lit(DATE_CONF["one"]))
        .when(F.col("_agree"), F.lit(DATE_CONF["agree"]))
        .otherwise(F.lit(DATE_CONF["differ"]))
    )
    date = (
        F.when(~F.col("_hp") & ~F.col("_hs"), F.lit(UNKNOWN_DATE))
        .when(F.col("_hp"), F.col("p_date"))
        .otherwise(F.col("s_date"))
    )
    out = j.withColumns({"date": date, "confidence": conf})
    return out.where(F.col("date").isNotNull()).select(
        "type_key", "manufacturer", "model", "batch_no", "sn", "date", "confidence"
    )


def _decayed(c0: Column, k: Column) -> Column:
    """``k`` successive ``c = max(0.3, c - 0.2)`` steps, evaluated step by step
    (same floating-point path as repeated subtraction)."""
    return F.aggregate(
        F.sequence(F.lit(1), F.greatest(k, F.lit(1))),
        c0,
        lambda acc, i: F.when(i <= k, F.greatest(F.lit(MIN_DECAYED), acc - DECAY_STEP)).otherwise(acc),
    )


def check_external(consensus: DataFrame, horizon: int | None = None) -> DataFrame:
    """Normalise external dates, check the year against the metadata; a
    failing date becomes ``<product start>-01-01`` (1900 without metadata) and
    lowers the batch confidence for it and every later serial of the batch.
    Returns ``type_key, date_key, sn, date, confidence, is_valid``."""
    kw = {} if horizon is None else {"horizon": horizon}
    d = consensus.withColumn("date", normalize_date("date", **kw))
    d = lookup_metadata(d, "manufacturer", "model", prefix="meta_")
    year = F.substring("date", 1, 4).cast("int")
    chk = year_check(year, F.col("meta_founded_year"), F.col("meta_start_year"), **kw)
    d = d.withColumn("is_valid", chk["is_valid"])
    w = Window.partitionBy("type_key", "batch_no").orderBy("sn").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_k", F.sum(F.when(F.col("is_valid"), 0).otherwise(1)).over(w))
    fallback = F.concat(F.coalesce(F.col("meta_start_year"), F.lit(1900)).cast("string"), F.lit("-01-01"))
    return d.select(
        "type_key",
        F.concat_ws("|", F.lower("manufacturer"), F.lower("model"), F.lower("sn")).alias("date_key"),
        "sn",
        F.when(F.col("is_valid"), F.col("date")).otherwise(fallback).alias("date"),
        F.when(F.col("_k") == 0, F.col("confidence")).otherwise(_decayed(F.col("confidence"), F.col("_k"))).alias("confidence"),
        "is_valid",
    )
