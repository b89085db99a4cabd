"""Repair operators on inline rows and golden reports on the sample inventory."""

import os

from pyspark.sql import functions as F

from assetclean.operators.dedup import dedup_first, resolve_headers, with_working_columns
from assetclean.operators.metrics import profile_groups, type_metrics
from assetclean.operators.repair import find_corrections
from assetclean.plans import reports as R
from assetclean.plans.enrich import enrich
from assetclean.sources import caches
from assetclean.sources.csv_source import read_inventory_csv

FIX = os.path.join(os.path.dirname(__file__), "fixtures")

ROWS = [
    ("American Diagnostic", "CE 1434", "C241870143"), ("American Diagnostic", "CE 1434", "C241870093"),
    ("American Diagnostic", "CE 1434", "C241843867"), ("American Diagnostic", "CE 1434", "C241843922"),
    ("American Diagnostic", "CE 1434", "C241843881"), ("American Diagnostic", "CE 1434", "C241843806"),
    ("American Diagnostic", "CE 1434", "22192114"), ("American Diagnostic", "CE 1434", "22192189"),
    ("ZOLL Medical", "RSERIES", "AF23L173769"), ("ZOLL Medical", "RSERIES", "AF23L173935"),
    ("ZOLL Medical", "RSERIES", "AF25G186555"), ("ZOLL Medical", "RSERIES", "AF25J188748"),
    ("ZOLL Medical", "RSERIES", "AF23G169205"), ("ZOLL Medical", "R Series", "AF17D065064"),
    ("Baxter", "SPECTRUM IQ", "3757686"), ("Baxter", "SPECTRUM IQ", "3757504"), ("Baxter", "SPECTRUM IQ", "3757280"),
    ("Baxter", "SPECTRUM IQ", "3757194"), ("Baxter", "SPECTRUM IQ", "3757377"), ("Baxter", "SPECTRM IQ", "3827871"),
]


def _rows(spark, rows):
    df = spark.createDataFrame([(i,) + r for i, r in enumerate(rows)], "_ord long, manufacturer string, model string, sn string")
    return with_working_columns(df, {"mfg": "manufacturer", "model": "model", "sn": "sn"})


def test_inline_corrections(spark):
    c = find_corrections(_rows(spark, ROWS))
    sc = {r.sn: r.corrected for r in c.serials.collect()}
    assert sc["22192114"] == "C22192114" and sc["22192189"] == "C22192189"
    mc = {(r.g_mfg, r.g_model): r.corrected for r in c.models.collect()}
    assert mc[("zoll medical", "r series")] == "RSERIES"
    assert mc[("baxter", "spectrm iq")] == "SPECTRUM IQ"


def test_serial_keyed_last_group_wins(spark):
    # the same serial in two groups: the later group's prefix fix applies to both
    rows = [("A", "m1", "X1001"), ("A", "m1", "X1002"), ("A", "m1", "X1003"), ("A", "m1", "1009"),
            ("B", "m2", "Y2001"), ("B", "m2", "Y2002"), ("B", "m2", "Y2003"), ("B", "m2", "1009")]
    sc = {r.sn: r.corrected for r in find_corrections(_rows(spark, rows)).serials.collect()}
    assert sc["1009"] == "Y1009"


def test_share_thresholds(spark):
    # 3 of 5 = 0.6 exactly qualifies for the prefix rule
    rows = [("A", "m", "Q11"), ("A", "m", "Q12"), ("A", "m", "Q13"), ("A", "m", "R14"), ("A", "m", "15")]
    sc = {r.sn: r.corrected for r in find_corrections(_rows(spark, rows)).serials.collect()}
    assert sc["R14"] == "QR14" and sc["15"] == "Q15"


def _sample(spark):
    raw = read_inventory_csv(spark, os.path.join(FIX, "sample_inventory.csv"))
    h = resolve_headers([c for c in raw.columns if c != "_ord"])
    return raw, dedup_first(with_working_columns(raw, h))


def test_dedup_sample(spark):
    raw, rows = _sample(spark)
    assert raw.count() == 801 and rows.count() == 800


def test_golden_corrections_report(spark):
    _, rows = _sample(spark)
    rep = R.corrections_report(find_corrections(rows)).orderBy("line_pos").collect()
    got = [r.line for r in rep]
    exp = open(os.path.join(FIX, "expected_corrections.txt")).read().rstrip("\n").split("\n")
    assert got == exp


def test_golden_typo_report(spark):
    raw, _ = _sample(spark)
    types = caches.read_type_cache(spark, os.path.join(FIX, "type_cache.json"))
    res = enrich(raw, types=types)
    got = [r.line for r in R.typo_report(res.types, res.corrections.models).orderBy("line_pos").collect()]
    exp = open(os.path.join(FIX, "expected_typos.txt")).read().rstrip("\n").split("\n")
    assert got == exp
    m = {r.device_type: r.percentage for r in type_metrics(res.enriched).collect()}
    assert m["Dermatoscope"] == 0.12  # 1 of 800, half-even
    assert res.enriched.count() == 800


def test_golden_profile(spark):
    raw, _ = _sample(spark)
    p = profile_groups(raw, "manufacturer", "model", "serial number")
    assert p.count() == 55
    text = open(os.path.join(FIX, "expected_profile.txt")).read()
    lines = [r.line for r in R.profile_report(p).orderBy("line_pos").collect()]
    assert "\n".join(lines).rstrip("\n") == text.rstrip("\n")
    for r in p.collect():
        assert f"Manufacturer: {r.manufacturer} | Model: {r.model}\n  Total count: {r.total}\n" in text
        assert f"(first 10): {r.first_serials!r}" in text
        assert f"(last 10): {r.last_serials!r}" in text


def test_metrics_order_and_csv_sink(spark, tmp_path):
    from assetclean.plans.enrich import write_enriched

    raw, _ = _sample(spark)
    res = enrich(raw, types=caches.read_type_cache(spark, os.path.join(FIX, "type_cache.json")))
    m = [(r.device_type, r["count"]) for r in type_metrics(res.enriched).collect()]
    assert m[0] == ("Patient Monitor", 202)
    counts = [c for _, c in m]
    assert counts == sorted(counts, reverse=True)
    out = str(tmp_path / "enriched")
    write_enriched(res, out)
    back = spark.read.option("header", True).csv(out)
    assert back.columns == ["manufacturer", "model", "serial number", "manufactured_date", "device_type"]
    assert back.count() == 800
