"""The containment join and the lookup in a caller's product table."""

import random

import pytest

from assetclean.operators.contain import contained_pairs, first_contained, lookup_products
from assetclean.operators.validate import lookup_metadata
from assetclean.sources.metadata import METADATA_SCHEMA, metadata_rows, product_metadata


def brute(names, entries, either):
    out = {}
    for by, name in names:
        if by is None or name is None:
            continue
        hit = [o for b, t, o in entries if b == by and t is not None and (t in name or (either and name in t))]
        if hit:
            out[by, name] = min(hit)
    return out


@pytest.mark.parametrize("either", [True, False])
def test_first_contained_equals_brute_force(spark, either):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab c") for _ in range(n))
    names = [(rng.choice("xyz"), word(rng.randint(0, 9))) for _ in range(250)] + [("x", None), (None, "ab"), ("w", "ab"), ("x", "é日本語\U0001f600z")]
    entries = [(rng.choice("xyz"), word(rng.randint(1, 7)), i) for i in range(120)] + [("z", "", 500), ("x", "本語\U0001f600", 501), ("x", None, 0), (None, "a", 0)]
    got = first_contained(spark.createDataFrame(names + names[:20], "by string, text string"), spark.createDataFrame(entries + entries[:9], "by string, text string, ord int"), either)
    rows = got.collect()
    assert {(r["by"], r["text"]): r["ord"] for r in rows} == brute(names, entries, either) and len(rows) == len({(r["by"], r["text"]) for r in rows})
    none = spark.createDataFrame([], "by string, text string, ord int")
    assert first_contained(none, none).count() == 0 == first_contained(spark.createDataFrame(names, "by string, text string"), none).count()


def test_a_common_stem_is_no_hot_key(spark):
    """100,000 models that all hold "series": as many candidates as matches."""
    entries = spark.range(100_000).selectExpr("'m' as by", "concat('series ', lpad(conv(id * 7919 % 100000, 10, 36), 4, '0')) as text")
    names = spark.range(0, 100_000, 500).selectExpr("'m' as by", "concat('the series ', lpad(conv(id * 7919 % 100000, 10, 36), 4, '0'), ' unit') as text")
    pairs = contained_pairs(entries, names)
    assert sorted(r["haystack"] == f"the {r['needle']} unit" for r in pairs.collect()) == [True] * 200
    plan = pairs._jdf.queryExecution().explainString(pairs.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_lookup_equals_the_built_in_table(spark):
    rng = random.Random(2)
    table = metadata_rows()
    rows = [(r[1].upper(), f" {r[4]} ") for r in table] + [(f"The {r[1]} Co", f"{r[4]}  plus x") for r in table] + [(r[1], r[4][: max(1, len(r[4]) // 2)]) for r in table]
    rows += [(rng.choice(table)[1], rng.choice(table)[4]) for _ in range(60)] + [("", "x"), (None, "x"), ("arjo", None), ("arjo", ""), ("nobody", "x")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_ord int, mfg string, model string")
    want = sorted(map(tuple, lookup_metadata(df).collect()))
    assert sorted(map(tuple, lookup_products(df, product_metadata(spark)).select(*lookup_metadata(df).columns).collect())) == want
    assert sum(r[3] is not None for r in want) > 150


def test_lookup_in_a_table_of_the_caller(spark):
    products = spark.createDataFrame([(1, "acme", 1950, 1, "rocket 9", 1960, ["s"]), (1, "acme", 1950, 2, "rocket", 1970, ["t"]), (2, "acme works", 1980, 1, "rocket", 1990, ["u"])], METADATA_SCHEMA)
    df = spark.createDataFrame([("ACME Works", "Rocket"), ("acme", "rocket 9000"), ("acme", "rock"), ("Other", "rocket")] + [("acme inc", "rocket")] * 500, "mfg string, model string")
    got = {(r["mfg"], r["model"]): (r["meta_mfg_key"], r["meta_start_year"]) for r in lookup_products(df, products).collect()}
    assert got == {("ACME Works", "Rocket"): ("acme", 1970), ("acme", "rocket 9000"): ("acme", 1960), ("acme", "rock"): ("acme", 1960), ("Other", "rocket"): (None, None), ("acme inc", "rocket"): ("acme", 1970)}
    assert lookup_products(df, products).count() == 504 and lookup_products(df.limit(0), products.limit(0)).count() == 0
