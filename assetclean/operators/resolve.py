"""Device type and manufacture date resolution.

Type: cache -> external answer -> ``Medical Device``.
Date: cache -> serial decode -> external answer -> year found in the serial
-> ``1900-01-01``. A date, once resolved for a ``mfg|model|sn`` key (the
first decodable row of that key, in input order), serves every row with the
same key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetclean.functions.dates import UNKNOWN_DATE, normalize_date
from assetclean.functions.text import pipe_key, year_in_text
from assetclean.operators.decode import decode_serials
from assetclean.sources.caches import DEFAULT_DEVICE_TYPE

MISSING_TYPE_CONFIDENCE = 0.1


def with_keys(df: DataFrame, mfg: str = "w_mfg", model: str = "w_model", sn: str = "w_sn") -> DataFrame:
    return df.withColumns({"type_key": pipe_key(mfg, model), "date_key": pipe_key(mfg, model, sn)})


def resolve_types(df: DataFrame, types: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """J1 + E2: add ``device_type, probable_typo, type_confidence, type_source``.

    ``types`` is a type cache; ``external`` has ``type_key, device_type,
    probable_typo, confidence`` (consensus answers for keys not cached).
    """
    if "type_key" not in df.columns:
        df = with_keys(df)
    t = types.select(
        "type_key",
        F.col("device_type").alias("_t_type"),
        F.col("probable_typo").alias("_t_typo"),
        F.coalesce(F.col("confidence"), F.lit(1.0)).alias("_t_conf"),
    )
    out = df.join(t, "type_key", "left")
    cached = F.col("_t_type").isNotNull() | F.col("_t_conf").isNotNull()
    dtype, typo, conf = F.col("_t_type"), F.col("_t_typo"), F.col("_t_conf")
    src = F.when(cached, F.lit("cache"))
    if external is not None:
        x = external.select(
            "type_key",
            F.col("device_type").alias("_x_type"),
            F.col("probable_typo").alias("_x_typo"),
            F.col("confidence").alias("_x_conf"),
        )
        out = out.join(x, "type_key", "left")
        use_x = ~cached & F.col("_x_conf").isNotNull()
        dtype = F.when(use_x, F.col("_x_type")).otherwise(dtype)
        typo = F.when(use_x, F.col("_x_typo")).otherwise(typo)
        conf = F.when(use_x, F.col("_x_conf")).otherwise(conf)
        src = F.when(use_x, F.lit("external")).otherwise(src)
    out = out.withColumns(
        {
            "device_type": F.coalesce(dtype, F.lit(DEFAULT_DEVICE_TYPE)),
            "probable_typo": F.coalesce(typo, F.lit(False)),
            "type_confidence": F.coalesce(conf, F.lit(MISSING_TYPE_CONFIDENCE)),
            "type_source": F.coalesce(src, F.lit("default")),
        }
    )
    return out.drop(*[c for c in out.columns if c.startswith("_t_") or c.startswith("_x_")])


def unresolved_types(df: DataFrame, types: DataFrame, order_col: str = "_ord") -> DataFrame:
    """J4 + U1: distinct type keys missing from the cache, with the last-seen
    spelling of (manufacturer, model) for the question."""
    if "type_key" not in df.columns:
        df = with_keys(df)
    keys = df.join(types.select("type_key"), "type_key", "left_anti")
    return keys.groupBy("type_key").agg(
        F.max_by(F.struct(F.col("w_mfg").alias("manufacturer"), F.col("w_model").alias("model")), F.col(order_col)).alias("_v")
    ).select("type_key", "_v.*")


def decode_once(df: DataFrame, horizon: int | None = None, order_col: str = "_ord") -> DataFrame:
    """Serial decode + first-decodable-row rule per date key (``decoded_date``).

    Colliding keys are found from the key column alone (a narrow count with
    map-side partial aggregation); only the rows of those keys are decoded a
    second time to pick the first decodable one, and the resulting tiny table
    is joined back (AQE broadcasts it when small). The full table is decoded
    once and never shuffled for this rule.
    """
    kw = {} if horizon is None else {"horizon": horizon}
    multi = df.groupBy("date_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("date_key")
    coll = decode_serials(df.join(multi, "date_key", "left_semi"), "w_mfg", "w_model", "w_sn", **kw)
    firsts = coll.groupBy("date_key").agg(
        F.min_by("decoded_date", F.when(F.col("decoded_date").isNotNull(), F.col(order_col))).alias("_first")
    )
    out = decode_serials(df, "w_mfg", "w_model", "w_sn", **kw).join(firsts, "date_key", "left")
    return out.withColumn("decoded_date", F.coalesce(F.col("_first"), F.col("decoded_date"))).drop("_first")


def resolve_dates(
    df: DataFrame,
    dates: DataFrame | None = None,
    external: DataFrame | None = None,
    horizon: int | None = None,
    order_col: str = "_ord",
) -> DataFrame:
    """E1 + J2: add ``manufactured_date, date_source, date_confidence``.

    ``dates``: date cache ``date_key, date, confidence``. ``external``: checked
    external answers ``date_key, date, confidence`` (see consensus.check_external).
    """
    kw = {} if horizon is None else {"horizon": horizon}
    if "date_key" not in df.columns:
        df = with_keys(df)
    if "decoded_date" in df.columns:  # already decoded (see decode_once)
        out = df
    else:
        out = decode_once(df, horizon, order_col)
    if dates is None:  # no cache: no join at all
        out = out.withColumns({"_c_date": F.lit(None).cast("string"), "_c_conf": F.lit(None).cast("double")})
    else:
        d = dates.select(
            "date_key", normalize_date("date", **kw).alias("_c_date"), F.coalesce(F.col("confidence"), F.lit(1.0)).alias("_c_conf")
        )
        out = out.join(d, "date_key", "left")
    cached = F.col("_c_conf").isNotNull()
    has_dec = ~cached & F.col("decoded_date").isNotNull()
    date = F.when(cached, F.col("_c_date")).when(has_dec, F.col("decoded_date"))
    conf = F.when(cached, F.col("_c_conf")).when(has_dec, F.lit(1.0))
    src = F.when(cached, F.lit("cache")).when(has_dec, F.lit("decode"))
    if external is not None:
        x = external.select("date_key", F.col("date").alias("_x_date"), F.col("confidence").alias("_x_conf"))
        out = out.join(x, "date_key", "left")
        use_x = date.isNull() & F.col("_x_conf").isNotNull()
        date = F.when(use_x, normalize_date("_x_date", **kw)).otherwise(date)
        conf = F.when(use_x, F.col("_x_conf")).otherwise(conf)
        src = F.when(use_x, F.lit("external")).otherwise(src)
    y = year_in_text("w_sn")
    out = out.withColumns(
        {
            "manufactured_date": F.coalesce(date, F.concat(y, F.lit("-01-01")), F.lit(UNKNOWN_DATE)),
            "date_source": F.coalesce(src, F.when(y.isNotNull(), F.lit("serial_year")), F.lit("unknown")),
            "date_confidence": conf,
        }
    )
    return out.drop(*[c for c in out.columns if c.startswith("_c_") or c.startswith("_x_")])


def unresolved_dates(df: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Rows whose date is neither cached nor decodable (input to C4).
    Expects ``decoded_date`` (after :func:`decode_once`) and ``date_key``."""
    out = df.where(F.col("decoded_date").isNull())
    if dates is not None:
        out = out.join(dates.select("date_key"), "date_key", "left_anti")
    return out
