"""Byte-exact files, ranks, horizon, overrides, rule arms and near labels."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from assetclean.functions.dates import normalize_date
from assetclean.operators import consensus as C
from assetclean.operators import decode, infer, repair, validate, view
from assetclean.plans.enrich import csv_writer, enrich
from assetclean.sources import caches
from assetclean.sources.csv_source import read_inventory_csv
from assetclean.sources.metadata import metadata_rows, product_metadata


def text_of(folder):
    return "".join(open(p, newline="").read() for p in sorted(glob.glob(os.path.join(folder, "part-*"))))


def test_csv_in_is_rfc_4180(spark, tmp_path):
    a = 'manufacturer,model,serial number\n"Acme","Say ""hi"", ok",S1\nB,"two\nlines", pad \nC,,\n'
    (tmp_path / "a b.csv").write_text(a)
    (tmp_path / "z.csv").write_text("manufacturer,model,serial number\n" + "".join(f"Z,m,{i}\n" for i in range(500)))
    one = read_inventory_csv(spark, str(tmp_path / "a b.csv")).orderBy("_ord").collect()
    assert [tuple(r)[:2] for r in one] == [("Acme", 'Say "hi", ok'), ("B", "two\nlines"), ("C", None)]
    assert one[0]["serial number"] == "S1" and one[1]["serial number"] == " pad "
    for multi in (True, False):
        rows = read_inventory_csv(spark, str(tmp_path), multi_line=multi).orderBy("_ord").collect()
        names = [r["manufacturer"] for r in rows]
        assert names[0] == "Acme" and names[-500:] == ["Z"] * 500  # file order, not size order
        assert [r["serial number"] for r in rows[-500:]] == [str(i) for i in range(500)]
        assert len({r["_ord"] for r in rows}) == len(rows)


def test_csv_out_keeps_cells(spark, tmp_path):
    df = spark.createDataFrame([("  Acme ", 'a "q" b', "x,y"), ("", None, "two\nlines")], "a string, b string, c string").coalesce(1)
    csv_writer(df).csv(str(tmp_path / "o"))
    assert text_of(tmp_path / "o") == 'a,b,c\n  Acme ,"a ""q"" b","x,y"\n,,"two\nlines"\n'


def test_export_is_json_cells(spark, tmp_path):
    df = spark.createDataFrame([(2, "  Acme ", 'a "q" \\ b'), (1, None, "two\nlines, é")], "_ord long, a string, `b c` string")
    view.export_csv(df, str(tmp_path / "o"))
    assert text_of(tmp_path / "o") == 'a,b c\n"","two\\nlines, é"\n"  Acme ","a \\"q\\" \\\\ b"\n'


@pytest.mark.parametrize("reuse", ["true", "false"])
@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_ranks_of_many_rows_with_more_columns(spark, reuse, adaptive):
    n = 400_000
    df = spark.range(n).select((F.col("id") % 3).alias("k"), F.format_string("%09d", (F.col("id") * 7919) % n).alias("o"), F.sha2(F.col("id").cast("string"), 256).alias("extra"))
    old = {c: spark.conf.get(c) for c in ("spark.sql.exchange.reuse", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        got = C.rank_within(df, "k", "o")
        want = df.select("k", "o", (F.row_number().over(C.Window.partitionBy("k").orderBy("o"))).alias("w"))
        assert got.columns == ["k", "o", "extra", "rank"]
        wrong = got.join(want, ["k", "o"]).where(F.col("rank") != F.col("w")).count()
        assert wrong == 0 and got.count() == n
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_horizon_is_one_parameter(spark, tmp_path):
    cons = spark.createDataFrame([("k", "Nobody", "X", 0, "s", "2028-03-03", 0.5)], "type_key string, manufacturer string, model string, batch_no int, sn string, date string, confidence double")
    assert C.check_external(cons, 2030).first()["date"] == "2028-03-03"
    assert C.check_external(cons).first()["date"] == "1900-03-03"
    (tmp_path / "d.json").write_text('{"a|b|c": {"date": "2028-03-03", "confidence": 0.5}, "d|e|f": "2028-04-04"}')
    got = {r.date_key: (r.date, r.confidence) for r in caches.read_date_cache(spark, str(tmp_path / "d.json"), 2030).collect()}
    assert got == {"a|b|c": ("2028-03-03", 0.5), "d|e|f": ("2028-04-04", 1.0)}
    raw = spark.createDataFrame([(1, "Nobody", "X", "Q1")], "_ord long, manufacturer string, model string, serial_number string")
    dates = spark.createDataFrame([("nobody|x|q1", "2029-02-02", 1.0)], "date_key string, date string, confidence double")
    assert enrich(raw, dates=dates, horizon=2030).enriched.first()["manufactured_date"] == "2029-02-02"
    assert spark.range(1).select(normalize_date(F.lit("2028-01-02"), 2030)).first()[0] == "2028-01-02"


def test_caches_missing_corrupt_and_legacy(spark, tmp_path):
    assert caches.read_type_cache(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "bad.json").write_text("not json")
    assert caches.read_mfr_cache(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "t.json").write_text('{"a|b": "Old Style", "c|d": {"device_type": "New", "probable_typo": true, "confidence": 0.6}, "e|f": {}}')
    got = {r.type_key: (r.device_type, r.probable_typo, r.confidence) for r in caches.read_type_cache(spark, str(tmp_path / "t.json")).collect()}
    assert got == {"a|b": ("Old Style", False, 1.0), "c|d": ("New", True, 0.6), "e|f": ("Medical Device", False, 1.0)}


def test_last_override_wins(spark):
    types = spark.createDataFrame([("a|b", "T", True, 0.6, 4)], caches.TYPE_CACHE_SCHEMA)
    o = spark.createDataFrame([(" A|B ", "second", 2), ("a|b", "first", 1), ("n|m", "new", 3)], "key string, device_type string, seq int")
    got = {r.type_key: tuple(r)[1:] for r in caches.apply_overrides(types, o).collect()}
    assert got == {"a|b": ("second", True, 0.6, 4), "n|m": ("new", False, None, None)}
    listed = spark.createDataFrame([("a|b", f"v{i}") for i in range(100)], "key string, device_type string")
    assert caches.apply_overrides(types, listed).first()["device_type"] == "v99"


def test_every_inference_arm(spark):
    cases = [(p.upper(), "", name) for pats, name in infer.MODEL_RULES for p in pats]
    for alts, name in infer.SERIAL_RULES:
        cases += [("", ("ZZ" + p if kind == "suffix" else "@" + p + "@" if kind == "contains" else p + "@"), name) for kind, p in alts]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, model string, sn string, want string")
    wrong = [tuple(r) for r in df.withColumn("got", infer.guess_manufacturer("model", "sn")).where("got is null or got <> want").collect()]
    assert wrong == []


def test_every_canonical_arm_and_metadata_row(spark):
    arms = [(s, key) for subs, key in validate.CANONICAL_RULES for s in subs]
    df = spark.createDataFrame(arms, "m string, want string")
    got = df.withColumn("got", validate.canonical_manufacturer("m")).where("got <> want").collect()
    first = {key: next(k for subs, k in validate.CANONICAL_RULES for s in subs if s in m) for m, key in arms}
    assert all(first[r.want] == r.got for r in got)
    assert product_metadata(spark).count() == len(metadata_rows()) == 53
    rows = [(r[1], r[4].upper(), r[1], r[2], r[5]) for r in metadata_rows()]
    df = spark.createDataFrame(rows, "mfg string, model string, k string, f int, s int")
    out = validate.lookup_metadata(df, "mfg", "model").where("meta_founded_year <> f or meta_start_year <> s or meta_mfg_key <> k or meta_mfg_key is null").collect()
    assert out == []


def test_decode_rules_are_a_parameter(spark):
    own = [decode.Rule("acme", r"^(\d{2})-(\d)'(\d)", 2000, 1, 2, 3), *decode.DECODE_RULES]
    df = spark.createDataFrame([("ACME Corp", "X", "01-2'3"), ("Masimo", "RAD8", "M192824")], "mfg string, model string, sn string")
    assert [r.decoded_date for r in decode.decode_serials(df, rules=own).orderBy("mfg").collect()] == ["2001-02-03", "2019-01-01"]
    assert decode.decode_serials(df, rules=[]).where("decoded_date is not null").count() == 0


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_segments_find_every_near_pair(spark):
    import random

    rng = random.Random(4)
    keys = {"".join(rng.choice("ab1") for _ in range(rng.randint(1, 9))) for _ in range(150)} | {"x" * 2000, "x" * 1999 + "y", "y" + "x" * 2000 + "z"}
    keys = sorted(keys)
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    small = df.select(F.col("k").alias("s"), F.explode(repair.probes(F.col("k"))).alias("p"))
    big = df.select(F.col("k").alias("b"), F.explode(repair.segments(F.col("k"))).alias("p"))
    got = {tuple(r) for r in small.join(big, "p").select("s", "b").distinct().collect()}
    near = {(s, b) for s in keys for b in keys if abs(len(s) - len(b)) <= 2 and (len(s) < 100 and lev(s, b) <= 2 or s == b)}
    near |= {("x" * 2000, "x" * 1999 + "y"), ("x" * 2000, "y" + "x" * 2000 + "z")}
    assert near <= got


def test_group_counts_aggregate_by_hash(spark):
    rows = spark.createDataFrame([(i, "M", "A b" if i % 2 else "AB") for i in range(50)], "_ord long, w_mfg string, w_model string")
    plan = repair.model_groups(rows)._jdf.queryExecution().executedPlan().toString()
    scan_up = plan[plan.rindex("HashAggregate") :]
    assert "HashAggregate" in plan and "SortAggregate" not in scan_up
    got = {r.g_model: (r.n_rows, r.first_ord, r.orig_model) for r in repair.model_groups(rows).collect()}
    assert got == {"ab": (25, 0, "AB"), "a b": (25, 1, "A b")}


def test_reserved_columns_and_empty_model_keys(spark):
    raw = spark.createDataFrame([(1, "M", "--", "S1", "x", "y"), (2, "M", "", "S2", "x", "y")], "_ord long, Manufacturer string, MODEL string, serial_number string, `Device_Type ` string, is_duplicate string")
    res = enrich(raw)
    assert res.enriched.columns == ["_ord", "Manufacturer", "MODEL", "serial_number", "manufactured_date", "device_type"]
    assert res.corrections.models.count() == 0 and res.enriched.count() == 2


def test_final_order_is_by_date_then_input(spark):
    rows = [(i, "Masimo", "RAD8", f"M19{i:04d}" if i % 2 else f"Q{i}") for i in range(40)]
    got = [(r.manufactured_date, r._ord) for r in enrich(spark.createDataFrame(rows, "_ord long, manufacturer string, model string, serial_number string").repartition(5)).enriched.collect()]
    assert got == sorted(got)
