"""Incremental runs: the second file reuses the date cache written by the first."""

import os
import tempfile

from assetclean.streaming import incremental

SCHEMA = "manufacturer string, model string, `serial number` string"


def test_two_runs_share_caches(spark):
    root = tempfile.mkdtemp(prefix="assetclean-inc-")
    inp = os.path.join(root, "in")
    os.makedirs(inp)
    with open(os.path.join(inp, "a.csv"), "w") as f:
        f.write("manufacturer,model,serial number\nMasimo,RAD8,M192824\nMasimo,RAD8,M192825\nPHILIPS,MX500,DE671R3701\n")
    q = incremental.start(spark, inp, SCHEMA, os.path.join(root, "out"), os.path.join(root, "state"), os.path.join(root, "ckpt"))
    q.awaitTermination(120)
    with open(os.path.join(inp, "b.csv"), "w") as f:
        f.write("manufacturer,model,serial number\nMasimo,RAD8,M192824\nStryker,1115,2017006701271\n")
    q = incremental.start(spark, inp, SCHEMA, os.path.join(root, "out"), os.path.join(root, "state"), os.path.join(root, "ckpt"))
    q.awaitTermination(120)
    out0 = spark.read.option("header", True).csv(os.path.join(root, "out", "batch=0"))
    out1 = spark.read.option("header", True).csv(os.path.join(root, "out", "batch=1"))
    assert out0.count() == 3 and out1.count() == 2
    got = {r["serial number"]: r.manufactured_date for r in out1.collect()}
    assert got == {"M192824": "2019-01-01", "2017006701271": "2017-01-01"}
    state = os.path.join(root, "state")
    keys = {r.date_key for r in incremental.cache_before(spark, state, "dates", 2).collect()}
    assert "masimo|rad8|m192825" in keys and "stryker|1115|2017006701271" in keys
    rewritten = spark.read.parquet(os.path.join(state, "dates", "version=1"))
    assert "stryker|1115|2017006701271" in {r.date_key for r in rewritten.collect()}
    assert len({r.bucket for r in rewritten.collect()}) == 1  # of one new key


def test_a_batch_run_again_sees_what_it_saw_before(spark, tmp_path, monkeypatch):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    one = spark.createDataFrame([("Masimo", "RAD8", "M192824"), ("", "RAD8", "M191111")], SCHEMA)
    two = spark.createDataFrame([("", "RAD8", "M191111"), ("", "RAD8", "M192222")], SCHEMA)
    incremental.process_batch(one, 0, out, state)
    write = incremental.caches.write_cache
    calls = []

    def failing(df, path, *by):
        calls.append(path)
        if len(calls) == 2:
            raise RuntimeError("lost between two writes")
        write(df, path, *by)

    monkeypatch.setattr(incremental.caches, "write_cache", failing)
    try:
        incremental.process_batch(two, 1, out, state)
    except RuntimeError:
        pass
    monkeypatch.setattr(incremental.caches, "write_cache", write)
    assert incremental.finished(spark, state, 9) == [0]
    incremental.process_batch(two, 1, out, state)
    assert incremental.finished(spark, state, 9) == [0, 1]
    mfr = {r.mfr_key: r.manufacturer for r in incremental.cache_before(spark, state, "manufacturers", 2).collect()}
    assert mfr == {"rad8|m191111": "Masimo", "rad8|m192222": "Masimo"}
    dates = incremental.cache_before(spark, state, "dates", 2).groupBy("date_key").count().where("count > 1").count()
    assert dates == 0


def entries(spark, keys):
    rows = [(k, f"type of {k}", True, 0.5, None) for k in keys]
    return spark.createDataFrame(rows, incremental.caches.TYPE_CACHE_SCHEMA)


def test_a_run_rewrites_only_the_buckets_of_its_keys(spark, tmp_path):
    caches, path = incremental.caches, str(tmp_path / "types")
    put = lambda keys, v, versions: caches.write_buckets(entries(spark, keys), path, v, versions, "type_key", caches.TYPE_CACHE_SCHEMA)
    first = put([f"m|{i}" for i in range(2000)], 0, {})
    assert set(first) == set(range(caches.BUCKETS)) and set(first.values()) == {0}
    second = put([f"n|{i}" for i in range(10)], 1, first)
    written = os.listdir(os.path.join(path, "version=1"))
    assert 1 <= len([d for d in written if d.startswith("bucket=")]) <= 10
    assert [b for b in second if second[b] != first[b]] and len([b for b in second if second[b] == 1]) <= 10
    after = caches.read_buckets(spark, path, second, caches.TYPE_CACHE_SCHEMA)
    assert after.count() == 2010 and after.select("type_key").distinct().count() == 2010
    assert {r.type_key for r in caches.read_buckets(spark, path, first, caches.TYPE_CACHE_SCHEMA).collect()} == {f"m|{i}" for i in range(2000)}
    assert put([], 2, second) == second and not os.path.exists(os.path.join(path, "version=2"))


def test_positions_stay_and_new_entries_come_last(spark, tmp_path):
    caches, path, versions = incremental.caches, str(tmp_path / "types"), {}
    for v, keys in enumerate((["b|1", "d|1"], ["c|1", "a|1", "d|1"], ["a|0"])):
        versions = caches.write_buckets(entries(spark, keys), path, v, versions, "type_key", caches.TYPE_CACHE_SCHEMA)
    got = caches.read_buckets(spark, path, versions, caches.TYPE_CACHE_SCHEMA).orderBy("entry_pos")
    assert [r.type_key for r in got.collect()] == ["b|1", "d|1", "a|1", "c|1", "a|0"]


def test_typo_report_keeps_the_order_of_the_runs(spark, tmp_path):
    from assetclean.plans.reports import numbered, typo_report

    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for batch, names in enumerate((["Zeta", "Mid"], ["Alpha", "Mid"])):
        rows = spark.createDataFrame([(n, "X1", f"S{batch}{n}") for n in names], SCHEMA)
        said = spark.createDataFrame([(f"{n.lower()}|x1", r, "Monitor", True, 0.9) for n in names for r in ("primary", "secondary")], "type_key string, resolver string, device_type string, probable_typo boolean, confidence double")
        incremental.process_batch(rows, batch, out, state, type_answers=said)
    types = incremental.cache_before(spark, state, "types", 2)
    none = spark.createDataFrame([], "line_pos struct<mfg_ord:long,p:long,a:long,b:long>, reason string")
    lines = [r.line for r in numbered(typo_report(types, none)).orderBy("line_no").collect()]
    assert [line.split()[1] for line in lines if line.startswith("Manufacturer")] == ["MID", "ZETA", "ALPHA"]
