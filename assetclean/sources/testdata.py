"""Synthetic inventory and side tables derived from the driver's ``orders`` table.

The driver's tables hold no equipment inventory, so one is *derived* from
``orders`` with SQL text that both Spark SQL and DuckDB accept unchanged: the
same text defines the Spark input (``spark.sql``) and the DuckDB oracle's CTE,
so the two engines start from identical rows. Everything grows with
``orders`` (one inventory row per order).

Row ``k = o_orderkey`` (unique, dense) is the input order ``_ord``. The
equipment family is ``k % 24``; serial digits come from ``k``; "dirt" is
injected by residues of ``k`` (missing prefixes, ``(21)`` tags, length
outliers, blank fields, case noise, spacing variants, spelling typos and
exact duplicates of an earlier row of the same family).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetclean.functions.text import bind
from assetclean.session import cut

# The equipment families of the synthetic inventory
# (manufacturer, model, device type, serial layout as SQL over the digit
# fields yy/mm/dd/ww/seq/d1/mc/zc of the serial key).
FAMILIES: list[tuple[str, str, str, str]] = [
    ("LINET", "ELEGANZA 3", "Hospital Bed", "'20' || yy || mm || seq"),
    ("Unico", "G380PL LED", "Laboratory Analyzer", "'G38L-20' || yy || mm || dd"),
    ("LAB CORP.", "642E", "Laboratory Analyzer", "yy || mm || dd || 'LB348'"),
    ("Jiangmen Dacheng", "IOB-507", "Dermatoscope", "'WU20' || yy || mm || dd || 'EN'"),
    ("Edan Instruments", "ELITEV5", "Patient Monitor", "'M' || yy || mc || seq"),
    ("Mindray", "EPM12MA", "Patient Monitor", "'AH9-' || d1 || mc || seq"),
    ("ZOLL Medical", "R SERIES", "Defibrillator", "'AF' || yy || zc || seq"),
    ("Hillrom", "CENTURY", "Hospital Bed", "mm || 'R' || seq || '199' || d1"),
    ("PHILIPS", "INTELLIVUE MP50", "Patient Monitor", "'DE' || d1 || seq"),
    ("GE HEALTHCARE", "APEX PRO CH", "Telemetry Monitor", "'SA3' || yy || ww || seq || 'GA'"),
    ("American Diagnostic", "CE 1434", "Stethoscope", "'C' || yy || ww || seq"),
    ("Welch Allyn", "SPOT VITAL SIGNS", "Vital Signs Monitor", "'20' || yy || seq"),
    ("Welch Allyn", "SURETEMPPLUS", "Thermometer", "'2' || CAST(3 + sk % 2 AS STRING) || seq"),
    ("ARJO INC.", "FLOWTRON", "Compression Therapy System", "'2100' || seq"),
    ("BAXTER HEALTHCARE CORP.", "SPECTRUM IQ", "Infusion Pump", "'3' || CAST(7 + sk % 2 AS STRING) || seq"),
    ("BIOSONIC", "UC95D15", "Ultrasound Probe", "yy || mm || seq"),
    ("Cogentix Medical", "CST-4000", "Endoscopy System", "'CS' || yy || ww || 'F'"),
    ("Covidien", "RAPIDVAC", "Vacuum Drainage System", "'VL01' || yy || seq"),
    ("Exergen", "TAT5000", "Temporal Thermometer", "'A' || yy || ww || seq"),
    ("Hospira", "PLUMA+", "Infusion Pump", "'17' || seq"),
    ("Masimo", "RAD8", "Pulse Oximeter", "'M19' || seq"),
    ("Olympus", "CV190", "Endoscopy Processor", "'75' || seq"),
    ("Stryker", "1115", "Hospital Bed", "'20' || yy || seq"),
    ("THERMO SCIENTIFIC", "SMARTVUE915", "Laboratory Freezer", "'18' || seq || 'D4C1'"),
]
N_FAMILIES = len(FAMILIES)


def _case(field: int) -> str:
    arms = " ".join(f"WHEN {i} THEN {_sql_value(f, field)}" for i, f in enumerate(FAMILIES))
    return f"CASE fam {arms} END"


def _sql_value(fam: tuple[str, str, str, str], field: int) -> str:
    v = fam[field]
    return v if field == 3 else "'" + v.replace("'", "''") + "'"


def _pad(expr: str, n: int) -> str:
    return f"lpad(CAST({expr} AS STRING), {n}, '0')"


# Stage 1: family, serial key (a duplicate row re-uses the key of the row 24
# orders earlier, i.e. of the same family) and the digit fields.
_BASE = f"""
SELECT o_orderkey AS k, o_orderkey % {N_FAMILIES} AS fam, o_orderstatus, o_orderpriority, o_orderdate,
       CASE WHEN o_orderkey % 23 = 1 AND o_orderkey >= {N_FAMILIES} THEN o_orderkey - {N_FAMILIES}
            ELSE o_orderkey END AS sk
FROM orders
"""

_DIGITS = f"""
SELECT b.*, {_pad('10 + sk % 13', 2)} AS yy, {_pad('1 + sk % 12', 2)} AS mm, {_pad('1 + sk % 28', 2)} AS dd,
       {_pad('1 + sk % 52', 2)} AS ww, lpad(CAST(sk AS STRING), CAST(greatest(5, length(CAST(sk AS STRING))) AS INT), '0') AS seq, CAST(sk % 7 AS STRING) AS d1,
       substr('123456789ABC', CAST(1 + sk % 12 AS INT), 1) AS mc,
       substr('ABCDEFGHIJKL', CAST(1 + sk % 12 AS INT), 1) AS zc
FROM ({_BASE}) b
"""

_CLEAN = f"""
SELECT d.k, d.fam, d.o_orderstatus, d.o_orderpriority, d.o_orderdate,
       {_case(0)} AS mfg0, {_case(1)} AS model0, {_case(2)} AS dtype0, {_case(3)} AS sn0
FROM ({_DIGITS}) d
"""

# Stage 2: dirt by residues of the order key (one relation with the family
# attributes, so side tables never join the inventory to itself).
INVENTORY_ALL_SQL = f"""
SELECT c.k AS _ord,
       CASE WHEN c.k % 19 = 2 THEN ''
            WHEN c.k % 13 = 4 THEN lower(c.mfg0)
            ELSE c.mfg0 END AS manufacturer,
       CASE WHEN c.k % 4001 = 99 THEN substr(c.model0, 1, length(c.model0) - 1) || 'Q'
            WHEN c.k % 29 = 11 AND c.model0 LIKE '% %' THEN replace(c.model0, ' ', '')
            WHEN c.k % 29 = 11 THEN substr(c.model0, 1, 2) || ' ' || substr(c.model0, 3)
            WHEN c.k % 11 = 6 THEN lower(c.model0)
            ELSE c.model0 END AS model,
       CASE WHEN c.k % 37 = 0 THEN ''
            WHEN c.k % 1009 = 7 THEN '(21) ' || c.sn0
            WHEN c.k % 17 = 3 THEN regexp_replace(c.sn0, '^[A-Za-z]+', '')
            WHEN c.k % 31 = 5 THEN c.sn0 || 'X'
            ELSE c.sn0 END AS serial_number,
       c.o_orderpriority AS site,
       c.fam, c.mfg0, c.model0, c.dtype0, c.o_orderstatus, c.o_orderpriority,
       CAST(CAST(c.o_orderdate AS DATE) AS STRING) AS order_day
FROM ({_CLEAN}) c
"""

INVENTORY_SQL = "SELECT _ord, manufacturer, model, serial_number, site FROM inv_all"

# Family attributes of each inventory row (for side tables only).
INVENTORY_FAMILY_SQL = "SELECT _ord, fam, mfg0, model0, dtype0, o_orderstatus, o_orderpriority, order_day FROM inv_all"


# Side tables, each derived from the inventory (previous-run caches, manual
# overrides and the two external resolvers' answers). Same text in both engines.
SIDE_TABLES: dict[str, str] = {
    # device-type cache from a previous run: families 0,1,3,4,6,7,.. (fam % 3 <> 2)
    "type_cache": """
SELECT lower(mfg0) || '|' || lower(model0) AS type_key, dtype0 AS device_type,
       fam % 5 = 0 AS probable_typo,
       CAST(CASE WHEN fam % 2 = 0 THEN 0.95 ELSE 0.6 END AS DOUBLE) AS confidence
FROM inv_family WHERE fam % 3 <> 2 GROUP BY lower(mfg0) || '|' || lower(model0), dtype0, fam
""",
    # serial-date cache: finished orders of every fourth family
    "date_cache": """
SELECT lower(i.manufacturer) || '|' || lower(i.model) || '|' || lower(i.serial_number) AS date_key,
       min(i.order_day) AS date, CAST(0.9 AS DOUBLE) AS confidence
FROM inv_all i
WHERE i.o_orderstatus = 'F' AND i.fam % 4 = 1 AND i.manufacturer <> ''
GROUP BY lower(i.manufacturer) || '|' || lower(i.model) || '|' || lower(i.serial_number)
""",
    # manufacturer cache for part of the blank-manufacturer rows
    "mfr_cache": """
SELECT lower(i.model) || '|' || lower(i.serial_number) AS mfr_key, min(i.mfg0) AS manufacturer
FROM inv_all i
WHERE i.manufacturer = '' AND i._ord % 3 = 0
GROUP BY lower(i.model) || '|' || lower(i.serial_number)
""",
    # manual overrides: one per cached family of every fourth family, plus new keys
    "type_overrides": """
SELECT upper(mfg0) || '|' || model0 AS key, 'Override ' || dtype0 AS device_type, min(_ord) AS seq FROM inv_family
WHERE fam % 4 = 0 GROUP BY upper(mfg0) || '|' || model0, 'Override ' || dtype0
UNION ALL
SELECT ' ' || mfg0 || '|' || upper(model0) AS key, 'Second ' || dtype0 AS device_type, min(_ord) + 1000000000000 AS seq FROM inv_family
WHERE fam % 8 = 0 GROUP BY ' ' || mfg0 || '|' || upper(model0), 'Second ' || dtype0
UNION ALL
SELECT ' ' || mfg0 || '|' || model0 || ' v2 ' AS key, 'New ' || dtype0 AS device_type, min(_ord) AS seq FROM inv_family
WHERE fam % 6 = 1 GROUP BY ' ' || mfg0 || '|' || model0 || ' v2 ', 'New ' || dtype0
""",
    # device-type answers of two resolvers, one per (key, resolver)
    "type_answers": """
SELECT lower(i.manufacturer) || '|' || lower(i.model) AS type_key, 'primary' AS resolver,
       min(i.dtype0) AS device_type, min(i.fam) % 7 = 0 AS probable_typo
FROM inv_all i
WHERE i.fam % 4 <> 3 AND i.manufacturer <> ''
GROUP BY lower(i.manufacturer) || '|' || lower(i.model)
UNION ALL
SELECT lower(i.manufacturer) || '|' || lower(i.model) AS type_key, 'secondary' AS resolver,
       CASE WHEN min(i.fam) % 3 = 0 THEN 'Medical Equipment' ELSE min(i.dtype0) END AS device_type,
       min(i.fam) % 7 = 0 AS probable_typo
FROM inv_all i
WHERE i.fam % 5 <> 4 AND i.manufacturer <> ''
GROUP BY lower(i.manufacturer) || '|' || lower(i.model)
""",
    # serial-date answers of two resolvers (the secondary sometimes disagrees)
    "date_answers": """
SELECT lower(i.mfg0) || '|' || lower(i.model0) AS type_key, i.serial_number AS sn, 'primary' AS resolver,
       min(i.order_day) AS date
FROM inv_all i
WHERE i._ord % 3 <> 0 AND i.serial_number <> ''
GROUP BY lower(i.mfg0) || '|' || lower(i.model0), i.serial_number
UNION ALL
SELECT lower(i.mfg0) || '|' || lower(i.model0) AS type_key, i.serial_number AS sn, 'secondary' AS resolver,
       CASE WHEN min(i._ord) % 7 = 0 THEN replace(min(i.order_day), '-', '/') || ' 08:00'
            WHEN min(i._ord) % 11 = 0 THEN '1930-01-01' ELSE min(i.order_day) END AS date
FROM inv_all i
WHERE i._ord % 4 <> 0 AND i.serial_number <> ''
GROUP BY lower(i.mfg0) || '|' || lower(i.model0), i.serial_number
""",
    # manufacturer answers for blank-manufacturer rows
    "mfr_answers": """
SELECT lower(i.model) || '|' || lower(i.serial_number) AS mfr_key, 'primary' AS resolver, min(i.mfg0) AS manufacturer
FROM inv_all i
WHERE i.manufacturer = '' AND i._ord % 2 = 0
GROUP BY lower(i.model) || '|' || lower(i.serial_number)
UNION ALL
SELECT lower(i.model) || '|' || lower(i.serial_number) AS mfr_key, 'secondary' AS resolver,
       CASE WHEN min(i._ord) % 5 = 0 THEN 'Unknown Manufacturer' ELSE upper(min(i.mfg0)) END AS manufacturer
FROM inv_all i
WHERE i.manufacturer = '' AND i._ord % 3 <> 1
GROUP BY lower(i.model) || '|' || lower(i.serial_number)
""",
}


def inventory_cte() -> str:
    """``WITH`` clause (no trailing comma) defining ``inventory``, ``inv_family``
    and every side table."""
    parts = [f"inv_all AS ({INVENTORY_ALL_SQL})", f"inventory AS ({INVENTORY_SQL})", f"inv_family AS ({INVENTORY_FAMILY_SQL})"]
    parts += [f"{name} AS ({sql})" for name, sql in SIDE_TABLES.items()]
    return "WITH " + ",\n".join(parts)


def register_views(spark: SparkSession, sf_dir: str, written: bool = False) -> None:
    """Register ``inventory``, ``inv_family`` and the side tables as temp views.
    ``written``: the derived rows are written once to the shared work folder,
    for jobs that read many of the side tables."""
    register_base_tables(spark, sf_dir)
    inv_all = inventory_rows(spark)
    (cut(inv_all, "inv_all") if written else inv_all).createOrReplaceTempView("inv_all")
    spark.sql(INVENTORY_SQL).createOrReplaceTempView("inventory")
    spark.sql(INVENTORY_FAMILY_SQL).createOrReplaceTempView("inv_family")
    for name, sql in SIDE_TABLES.items():
        spark.sql(sql).createOrReplaceTempView(name)


def inventory_rows(spark: SparkSession) -> DataFrame:
    """The rows of :data:`INVENTORY_ALL_SQL` over the view ``orders``. The long
    CASEs of a clean row are bound (see :func:`bind`): in one generated method
    with all that follows they exceed what the JVM compiles (8,000 bytes of
    code) and would be interpreted, at some eight times the cost."""
    names = {f"{name}0": bind(F.expr(_case(field)), lambda value: value) for field, name in enumerate(("mfg", "model", "dtype", "sn"))}
    clean = spark.sql(_DIGITS).withColumns(names)
    clean.select("k", "fam", "o_orderstatus", "o_orderpriority", "o_orderdate", *names).createOrReplaceTempView("inv_clean")
    return spark.sql(INVENTORY_ALL_SQL.replace(f"({_CLEAN})", "inv_clean"))


def register_base_tables(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = ("orders",)) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


# Date strings in the shapes the normaliser must handle (F1), one per order.
NOISY_DATES_SQL = """
SELECT o_orderkey AS _ord,
       CASE o_orderkey % 11
            WHEN 0 THEN d
            WHEN 1 THEN replace(d, '-', '/')
            WHEN 2 THEN d || ' 10:30:00'
            WHEN 3 THEN 'built ' || substr(d, 1, 4) || ' approx'
            WHEN 4 THEN substr(d, 1, 5) || CAST(13 + o_orderkey % 45 AS STRING) || '-' || substr(d, 9, 2)
            WHEN 5 THEN substr(d, 1, 8) || CAST(27 + o_orderkey % 6 AS STRING)
            WHEN 6 THEN '1799' || substr(d, 5)
            WHEN 7 THEN ''
            WHEN 8 THEN substr(d, 1, 5) || '00' || substr(d, 8)
            WHEN 9 THEN '  ' || substr(d, 1, 4) || '/' || CAST(1 + o_orderkey % 12 AS STRING) || '/' || CAST(o_orderkey % 31 AS STRING)
            ELSE 'unknown ' || CAST(o_orderkey % 100 AS STRING)
       END AS raw
FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d FROM orders) t
"""


# `part` seen as an inventory: brand as the group, type as the label, name as
# the code (the operators are generic in these three roles).
PART_AS_INVENTORY_SQL = """
SELECT p_partkey AS _ord, p_brand AS manufacturer, p_type AS model, p_name AS serial_number, CAST(p_size AS STRING) AS site
FROM part
"""

# `customer` seen as an inventory (segment as the group, name as the label), and
# a caller's product table for it: ends of every third name, of four lengths.
CUSTOMER_AS_INVENTORY_SQL = """
SELECT c_custkey AS _ord, c_mktsegment AS manufacturer, c_name AS model
FROM customer
"""
CUSTOMER_PRODUCTS_SQL = """
SELECT ascii(c_mktsegment) AS mfg_ord, lower(c_mktsegment) AS mfg_key, 1900 + ascii(c_mktsegment) AS founded_year, c_custkey AS model_ord,
       lower(substr(c_name, CAST(10 + c_custkey % 4 AS INT))) AS model_key, CAST(1950 + c_custkey % 70 AS INT) AS product_start_year
FROM customer WHERE c_custkey % 3 = 0
"""
