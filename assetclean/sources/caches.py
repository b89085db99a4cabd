"""Lookup caches as DataFrames.

Cache shapes (all keys are lower-cased ``|``-joined strings):

* device types ``type_key, device_type, probable_typo, confidence``
* serial dates ``date_key, date, confidence``
* manufacturers ``mfr_key, manufacturer``

A JSON cache file is one JSON object (key -> value); it is read with
``wholetext`` + ``from_json`` into a map and exploded, accepting both the
current object values and the legacy bare-string values in one pass. Such a
file is a single document and is read by one task, so it is only the import
path; the engine's own cache sink writes Parquet (splittable, versioned), in
buckets by a hash of the key, so that a run rewrites only what it touches.
A missing file, or one that is no JSON object, reads as an empty cache; any
other failure to read is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetclean.functions.dates import HORIZON_YEAR, normalize_date
from assetclean.functions.text import strip
from assetclean.session import cut

DEFAULT_DEVICE_TYPE = "Medical Device"

TYPE_CACHE_SCHEMA = "type_key string, device_type string, probable_typo boolean, confidence double, entry_pos long"
DATE_CACHE_SCHEMA = "date_key string, date string, confidence double"
MFR_CACHE_SCHEMA = "mfr_key string, manufacturer string"


def _json_entries(spark: SparkSession, path: str) -> DataFrame:
    """``key, value, pos`` from one JSON object file; nested objects stay JSON text."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], "key string, value string, pos int")
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json(F.col("value"), T.MapType(T.StringType(), T.StringType()))
    return raw.select(F.posexplode(F.coalesce(m, F.create_map().cast("map<string,string>"))).alias("pos", "key", "value"))


def read_type_cache(spark: SparkSession, path: str) -> DataFrame:
    """S3 + S4: type cache with legacy values upgraded (``Medical Device``,
    False, 1.0 defaults)."""
    e = _json_entries(spark, path)
    obj = F.from_json(F.col("value"), "device_type string, probable_typo boolean, confidence double")
    is_obj = strip(F.col("value")).startswith("{")
    return e.select(
        F.col("key").alias("type_key"),
        F.when(is_obj, F.coalesce(obj["device_type"], F.lit(DEFAULT_DEVICE_TYPE))).otherwise(F.col("value")).alias("device_type"),
        F.when(is_obj, F.coalesce(obj["probable_typo"], F.lit(False))).otherwise(F.lit(False)).alias("probable_typo"),
        F.when(is_obj, F.coalesce(obj["confidence"], F.lit(1.0))).otherwise(F.lit(1.0)).alias("confidence"),
        F.col("pos").cast("long").alias("entry_pos"),
    )


def read_date_cache(spark: SparkSession, path: str, horizon: int = HORIZON_YEAR) -> DataFrame:
    """S3 + S4 for serial dates; dates are re-normalised (F1) on load."""
    e = _json_entries(spark, path)
    obj = F.from_json(F.col("value"), "date string, confidence double")
    is_obj = strip(F.col("value")).startswith("{")
    return e.select(
        F.col("key").alias("date_key"),
        normalize_date(F.when(is_obj, obj["date"]).otherwise(F.col("value")), horizon).alias("date"),
        F.when(is_obj, F.coalesce(obj["confidence"], F.lit(1.0))).otherwise(F.lit(1.0)).alias("confidence"),
    )


def read_mfr_cache(spark: SparkSession, path: str) -> DataFrame:
    e = _json_entries(spark, path)
    return e.select(F.col("key").alias("mfr_key"), F.col("value").alias("manufacturer"))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def write_cache(df: DataFrame, path: str, *by: str) -> None:
    """Write a new cache version (Parquet, in a folder for each value of
    ``by``). Never overwrite the path the current plan reads from; callers pass
    a fresh version directory."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


#: folders of a stored cache; a run rewrites only those its keys fall into
BUCKETS = 64


def bucket_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def read_buckets(spark: SparkSession, path: str, versions: dict[int, int], schema: str, only: list[int] | None = None) -> DataFrame:
    """The cache whose bucket ``b`` was last written by version
    ``versions[b]``; ``only`` these buckets."""
    paths = [f"{path}/version={v}/bucket={b}" for b, v in versions.items() if only is None or b in only]
    return spark.read.schema(schema).parquet(*paths) if paths else empty(spark, schema)


def write_buckets(changes: DataFrame, path: str, version: int, versions: dict[int, int], key: str, schema: str) -> dict[int, int]:
    """Put new and changed entries (one per key) into the stored cache: the
    buckets they fall into are written anew under ``version``, all others stay
    where they are. Gives the versions after that. An entry that is there
    already keeps its ``entry_pos``; new ones come after all old ones, by key.
    """
    spark = changes.sparkSession
    changes = cut(changes, "changes")
    touched = [r["b"] for r in changes.select(bucket_of(key).alias("b")).distinct().collect()]  # BUCKETS at most
    if not touched:
        return versions
    old = read_buckets(spark, path, versions, schema, touched)
    if "entry_pos" in old.columns:
        last = read_buckets(spark, path, versions, schema).agg(F.max("entry_pos")).first()[0]
        places = old.select(key, F.col("entry_pos").alias("_pos"))
        ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
        new = changes.drop("entry_pos").join(places, key, "left").repartitionByRange(ranges, key).sortWithinPartitions(key)
        # increasing in the order of the keys, which is all that a position is for
        changes = new.withColumn("entry_pos", F.coalesce("_pos", F.lit(-1 if last is None else last) + 1 + F.monotonically_increasing_id())).drop("_pos")
    rows = upsert(old, changes.select(*old.columns), key)
    write_cache(rows.withColumn("bucket", bucket_of(key)).repartition("bucket"), f"{path}/version={version}", "bucket")
    return versions | dict.fromkeys(touched, version)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New value wins per key: ``new UNION ALL (old LEFT ANTI new)``."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"), allowMissingColumns=True)


def apply_overrides(types: DataFrame, overrides: DataFrame, seq: str = "seq") -> DataFrame:
    """Manual device-type overrides (``key, device_type``, the order
    column ``seq``).

    The override key is lower-cased and stripped. An existing key only gets a
    new device type (typo flag and confidence stay); a new key is added with
    ``probable_typo = false`` and no confidence (read later as 1.0). If one
    key is overridden several times, the last override wins: the one of the
    greatest ``seq`` or, without that column, the last row as read.
    """
    o = overrides if seq in overrides.columns else overrides.withColumn(seq, F.monotonically_increasing_id())
    o = o.groupBy(strip(F.lower(F.col("key"))).alias("type_key")).agg(F.max_by("device_type", seq).alias("_new"))
    return types.join(o, "type_key", "full_outer").select(
        "type_key",
        F.coalesce(F.col("_new"), F.col("device_type")).alias("device_type"),
        F.coalesce(F.col("probable_typo"), F.lit(False)).alias("probable_typo"),
        "confidence",
        *(["entry_pos"] if "entry_pos" in types.columns else []),
    )


def rules_table(types: DataFrame) -> DataFrame:
    """The current type rules split into manufacturer and model."""
    parts = F.split(F.col("type_key"), r"\|", 2)
    return types.select(
        "type_key",
        parts[0].alias("manufacturer"),
        F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("model"),
        "device_type",
        "probable_typo",
        "confidence",
    )
