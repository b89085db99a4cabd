"""Plan shape: no cartesian product, nested-loop join or Python evaluation in
the physical plans; dedup uses a partial WindowGroupLimit before its shuffle."""

import re

import pytest

import __spark_entry__ as E

SMOKE = "/root/testdata/sf0.001"
FORBIDDEN = r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython|PythonUDF"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["dedup_first", "model_corrections", "serial_corrections", "decode_by_year", "resolver_batches", "profile_groups"])
def test_no_forbidden_nodes(spark, name):
    import os

    if not os.path.isdir(SMOKE):
        pytest.skip("driver test data not present")
    plan = _plan(E.queries()[name](spark, SMOKE))
    assert not re.search(FORBIDDEN, plan), plan


def test_dedup_partial_limit(spark):
    import os

    if not os.path.isdir(SMOKE):
        pytest.skip("driver test data not present")
    plan = _plan(E.queries()["dedup_first"](spark, SMOKE))
    # WindowGroupLimit appears on both sides of the exchange (partial + final)
    assert plan.count("WindowGroupLimit") >= 2


def _steps(df) -> int:
    """Patterns that the optimised plan of ``df`` applies, copies counted."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return len(re.findall(r"regexp_extract\(|regexp_replace\(|rlike", plan, re.IGNORECASE))


def test_decode_steps_are_not_copied(spark):
    from pyspark.sql import functions as F

    from assetclean.operators.decode import decode_serials
    from assetclean.operators.infer import infer_manufacturers
    from assetclean.operators.validate import validate_years

    rows = spark.range(3).select(F.concat(F.lit("x"), "id").alias("m"), F.concat(F.lit("y"), "id").alias("o"), F.concat(F.lit("z"), "id").alias("s"), "id")
    decoded = decode_serials(rows, "m", "o", "s", keep_detail=True)
    once = _steps(decoded)
    assert once <= 20, once
    # a filter moved below the decode repeats it once, not at each use of a step
    assert _steps(decoded.where("dec_year is not null")) <= 2 * once
    assert _steps(validate_years(decoded.where("dec_year is not null"), "m", "o", "dec_year")) <= 2 * once + 2
    guessed = infer_manufacturers(rows, "m", "o", "s").where("m <> ''")
    assert _steps(guessed) <= 4


def test_names_are_cleaned_once_a_row(spark):
    """Not once for each rule that the cleaned name is compared with."""
    from pyspark.sql import functions as F

    from assetclean.operators.infer import guess_manufacturer
    from assetclean.operators.validate import canonical_manufacturer

    rows = spark.range(1).select(F.col("id").cast("string").alias("a"), F.col("id").cast("string").alias("b"))
    for c in (canonical_manufacturer("a"), guess_manufacturer("a", "b")):
        plan = rows.select(c.alias("c"))._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"contains\((lower|upper|regexp_replace|btrim|trim)\(", plan, re.IGNORECASE), plan


def test_rows_are_counted_once(spark):
    """Each statistic of the corrections comes from one count of the rows, with
    the modes by rows, then first seen, and the first-seen spellings."""
    from pyspark.sql import functions as F

    from assetclean.operators.repair import model_corrections, serial_corrections, written_groups

    rows = [("Acme", "M-1", f"AB{i:04d}") for i in range(6)] + [("acme", "m-1", "0042"), ("ACME", "M 1", "CD77"), ("acme", "M-1", "(21) AB0099"), ("acme", "M-1", "")]
    src = spark.range(len(rows), numPartitions=3).select("id", F.element_at(F.expr("array(" + ",".join("struct('%s' as m,'%s' as o,'%s' as s)" % r for r in rows) + ")"), (F.col("id") + 1).cast("int")).alias("v"))
    df = src.select(F.col("id").alias("_ord"), F.col("v.m").alias("w_mfg"), F.col("v.o").alias("w_model"), F.col("v.s").alias("w_sn"))

    def scans(frame):
        return frame._jdf.queryExecution().optimizedPlan().toString().count("Range (")

    groups = written_groups(df)
    models, serials = model_corrections(groups), serial_corrections(df, groups)
    assert scans(models) == 0 and scans(serials) == 1
    assert [(r.g_model, r.n_rows, r.first_ord, r.orig_model, r.mfg_ord, r.orig_mfg) for r in groups.orderBy("first_ord").collect()] == [("m-1", 9, 0, "M-1", 0, "Acme"), ("m 1", 1, 7, "M 1", 0, "Acme")]
    assert [(r.original, r.corrected) for r in models.collect()] == [("M 1", "M-1")]
    assert {(r.sn, r.corrected, r.kind) for r in serials.collect()} == {("0042", "AB0042", "prefix"), ("(21) AB0099", "AB0099", "paren")}


def test_inventory_can_be_written_once(spark, tmp_path):
    from assetclean.sources import testdata as td

    orders = "id as o_orderkey, 'F' as o_orderstatus, '1-URGENT' as o_orderpriority, timestamp'1996-01-02' as o_orderdate"
    spark.range(120).selectExpr(*orders.split(", ")).write.parquet(f"{tmp_path}/orders.parquet")
    td.register_views(spark, str(tmp_path))
    names = ["inventory", "inv_family", *td.SIDE_TABLES]
    lazy = {n: sorted(map(str, spark.table(n).collect())) for n in names}
    td.register_views(spark, str(tmp_path), written=True)
    assert {n: sorted(map(str, spark.table(n).collect())) for n in names} == lazy
    assert "orderdate" not in spark.table("date_answers")._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["resolver_batches", "cache_upsert"])
def test_decoded_rows_are_read_not_decoded_again(spark, tmp_path, name):
    """The batches and both sides of the upsert read what one decode wrote."""
    orders = "id as o_orderkey, 'F' as o_orderstatus, '1-URGENT' as o_orderpriority, timestamp'1996-01-02' as o_orderdate"
    spark.range(240).selectExpr(*orders.split(", ")).write.parquet(f"{tmp_path}/orders.parquet")
    out = E.queries()[name](spark, str(tmp_path))
    assert out.count() > 0
    assert "welch allyn,suretemp" not in out._jdf.queryExecution().optimizedPlan().toString()  # the decode rules


def test_inventory_derivation_is_compiled_and_equals_its_sql(spark, capsys, tmp_path):
    """The JVM interprets methods of more than 8,000 bytes of code."""
    from assetclean.sources import testdata as td

    orders = spark.range(-30, 5000).selectExpr("if(id % 50 = 7, null, id) as o_orderkey", "if(id % 2 = 0, 'F', 'O') as o_orderstatus", "'1-URGENT' as o_orderpriority", "date_add(date'1995-01-01', cast(id as int)) as o_orderdate")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    td.register_views(spark, str(tmp_path))
    rows = spark.table("inventory")
    rows.explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000
    derived, sql = spark.table("inv_all"), spark.sql(td.INVENTORY_ALL_SQL)
    assert derived.schema == sql.schema and sorted(map(repr, derived.collect())) == sorted(map(repr, sql.collect()))
