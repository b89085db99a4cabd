"""The pipeline against a brute-force version of each stage's decision."""

import corpus_pipeline as C
from test_native import shingles
from test_python import brute_components

from assetclean.llm.common import cut

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [s for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (s := shingles(r["text"]))]
    states = [docs]
    for k, (_, stage) in enumerate(C.STAGES):
        states.append(cut(stage(spark, states[-1], SF), f"test-{k}"))
    rows = [[tuple(r) for r in s.select(*columns).collect()] for s in states]
    assert all(s.columns == columns for s in states[:-1])
    # language ID: whatever has letters and is prose stays
    assert {r[0] for r in rows[0] if any(c.isalpha() for c in r[1] or "")} >= {r[0] for r in rows[1]}
    assert len(rows[1]) >= 0.98 * len(rows[0])
    # near duplicates: the least id of each component
    parts = brute_components([(r[0], r[1]) for r in rows[1]])
    assert {str(r[0]) for r in rows[2]} == {p for _, _, p in parts} and len(rows[2]) == len({p for _, _, p in parts})
    # decontamination
    clean = [r for r in rows[2] if not any(100 * len(shingles(r[1]) & q) >= 80 * len(q) for q in items)]
    assert sorted(r[0] for r in clean) == sorted(r[0] for r in rows[3]) and len(clean) < len(rows[2])
    # mixing: near every target, repeats taken
    size = lambda r: len((r[1] or "").encode().split())
    total = sum(map(size, rows[3]))
    assert abs(sum(map(size, rows[4])) - 1.5 * total) < 0.1 * total
    assert {r[0] for r in rows[4]} <= {r[0] for r in rows[3]} and len(rows[4]) > len(rows[3])
    # sharding: a law of rows, whole rows
    assert sorted(rows[5], key=str) == sorted(rows[4], key=str)
    counts = [r["count"] for r in states[5].groupBy("shard").count().collect()]
    assert max(counts) - min(counts) <= 1
    assert sorted(tuple(r) for r in C.run(spark, SF).select("doc_id", "shard", "slot").collect()) == sorted(tuple(r) for r in states[5].select("doc_id", "shard", "slot").collect())


def test_a_document_without_a_language_goes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(-1, "12345 67890", None, None, 1), (-2, None, None, None, None), (-3, "日本語の文章がここにあります", None, None, 5), (None, "", None, None, 0)], docs.schema)
    left = {r["doc_id"] for r in C.language_stage(spark, docs.union(odd), SF).collect()}
    assert not left & {-1, -2, -3, None}


def test_stages_take_an_empty_table(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, none, SF).count() == 0
