"""The salted join: same rows as a plain one, and no task with a hot key."""

from pyspark.sql import functions as F

from assetclean.operators.skew import heavy_keys, salted_join


def rows(spark):
    hot = [("hot", i) for i in range(4000)] + [(None, i) for i in range(4000)]
    rest = [(f"k{i % 3000}", i) for i in range(4000)]
    return spark.createDataFrame(hot + rest, "k string, v long").repartition(6)


def test_same_rows_as_a_plain_join(spark):
    big = rows(spark)
    small = spark.createDataFrame([("hot", 1), ("k7", 2), ("k7", 3), ("other", 4), (None, 5)], "k string, w long")
    for how in ("inner", "left"):
        got = sorted(salted_join(big, small, ["k"], how).collect(), key=str)
        assert got == sorted(big.join(small, "k", how).collect(), key=str)
    empty = big.limit(0)
    assert salted_join(empty, small, ["k"]).count() == 0
    assert salted_join(big, small.limit(0), ["k"], "left").count() == big.count()


def test_heavy_keys_are_few_and_counted(spark):
    heavy = {r["k"]: r["_salts"] for r in heavy_keys(rows(spark), ["k"], shares=30).collect()}
    assert heavy == {"hot": 10, None: 10}


def test_no_task_takes_a_hot_key_without_adaptive_execution(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        small = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(3000)], "k string, w long")
        sizes = sorted(r["count"] for r in salted_join(rows(spark), small, ["k"], "left").groupBy(F.spark_partition_id()).count().collect())
        plain = sorted(r["count"] for r in rows(spark).join(small, "k", "left").groupBy(F.spark_partition_id()).count().collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert plain[-1] > 4000
    assert sizes[-1] < 2 * sizes[len(sizes) // 2]
