"""Product metadata (manufacturer founding year, model launch year, sources).

The table is a fixed 53-row data file shipped with the package. It is read on
the driver with the ``csv`` module and turned into a local relation, so it is
embedded in the plan and every executor gets it with the task (no shared file
system needed); its size is fixed, so broadcasting it is always safe.
"""

from __future__ import annotations

import csv
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DATA_FILE = Path(__file__).resolve().parent.parent / "data" / "product_metadata.csv"

METADATA_SCHEMA = T.StructType(
    [
        T.StructField("mfg_ord", T.IntegerType(), False),
        T.StructField("mfg_key", T.StringType(), False),
        T.StructField("founded_year", T.IntegerType(), False),
        T.StructField("model_ord", T.IntegerType(), False),
        T.StructField("model_key", T.StringType(), False),
        T.StructField("product_start_year", T.IntegerType(), False),
        T.StructField("sources", T.ArrayType(T.StringType()), False),
    ]
)


@lru_cache(maxsize=1)
def metadata_rows() -> tuple[tuple, ...]:
    with DATA_FILE.open(newline="", encoding="utf-8") as f:
        rows = []
        for r in csv.DictReader(f):
            rows.append(
                (
                    int(r["mfg_ord"]),
                    r["mfg_key"],
                    int(r["founded_year"]),
                    int(r["model_ord"]),
                    r["model_key"],
                    int(r["product_start_year"]),
                    [r["source_1"], r["source_2"]],
                )
            )
    return tuple(rows)


def manufacturer_keys() -> list[str]:
    """Metadata manufacturer keys in their fixed order."""
    seen: dict[str, None] = {}
    for r in metadata_rows():
        seen.setdefault(r[1], None)
    return list(seen)


def product_metadata(spark: SparkSession) -> DataFrame:
    """One row per (manufacturer, model) with the ordering columns used by
    first-match lookups."""
    return spark.createDataFrame(list(metadata_rows()), METADATA_SCHEMA)
