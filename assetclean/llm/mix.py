"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by (source, hash bucket); a running sum finds the bucket in
which a source's budget ends; only that boundary bucket is read again, in
finer buckets, until single hash values are left. The result is one hash
threshold per source, and rows are chosen by comparing their hash with it:
no row is ever sorted.

Defined results: null source is a source of its own, ordered last; null text
has size 0; an empty table gives no rows. Source statistics cover all rows.
Rows, not keys, are hashed: the plan (op2) takes key, null as the empty text,
and text, null as the empty one, ``mix`` all columns, and both hash the
occurrences of equal rows apart, so null and repeated keys make no difference.
Equal rows travel as one row and a number. Texts of any length are read whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, id_hash, packed, table

BITS = 60
LEVEL_BITS = 12
#: repeats of a row that one task writes; results don't depend on it
REPEATS = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, size) rows -> (source, source_size, target), one row per source.

    Sources in code-point order, null last, take ``weights`` in turn. Together
    the targets are ``share`` of all sizes; none is above ``cap`` times its
    source, and what exceeds it goes to the others by weight. In closed form:
    in the order of source_size / weight, the sources up to some point are at
    their cap and the rest share what is left. Windows run over one row per
    source.
    """
    one = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    one = one.withColumn("weight", reduce(lambda c, i: c.when(turn == i, F.lit(float(weights[i]))), range(1, len(weights)), F.when(turn == 0, F.lit(float(weights[0])))))
    up = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    total = Window.partitionBy()
    one = one.withColumns({"sized": F.sum("source_size").over(up), "weight_left": F.sum("weight").over(down), "total": F.sum("source_size").over(total)})
    # level of water if every source before this one is at its cap
    level = (share * F.col("total") - cap * (F.col("sized") - F.col("source_size"))) / F.col("weight_left")
    one = one.withColumn("level", F.greatest(level, F.lit(0.0)))
    one = one.withColumn("capped", F.col("level") * F.col("weight") >= cap * F.col("source_size"))
    one = one.withColumn("final_level", F.min(F.when(~F.col("capped"), F.struct((F.col("source_size") / F.col("weight")).alias("at"), F.col("level").alias("level")))).over(total)["level"])
    target = F.when(F.col("capped"), cap * F.col("source_size")).otherwise(F.least(F.col("final_level") * F.col("weight"), cap * F.col("source_size")))
    return one.select("source", "source_size", target.cast("double").alias("target"))


def hash_thresholds(rows: DataFrame, targets: DataFrame, levels: int = 2) -> DataFrame:
    """rows (source, size, h) and targets -> (source, source_size, target,
    copies, threshold): every row is taken ``copies`` times, and once more
    where h <= threshold."""
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("copies", copies).withColumn("need", F.col("target") - F.col("copies") * F.col("source_size"))
    open_ = plan.select(F.col("source").alias("s"), "need", F.lit(0).cast("long").alias("prefix"))
    depth = 0
    for _ in range(levels):
        depth += LEVEL_BITS
        open_ = _refine(rows, open_, depth)
    # what is left of the boundary bucket: single hash values
    ends = (
        _inside(rows, open_, depth)
        .groupBy("s", "need", "prefix", F.col("h").alias("v"))
        .agg(F.sum("size").alias("w"))
        .withColumn("before", F.sum("w").over(Window.partitionBy("s").orderBy("v")) - F.col("w"))
        .filter((F.col("before") + F.col("w") / 2 <= F.col("need")) & (F.col("need") > 0))
        .groupBy("s")
        .agg(F.max("v").alias("last"))
    )
    below = F.shiftleft("prefix", BITS - depth) - 1
    ends = ends.withColumnRenamed("s", "ends_s")
    cutoff = open_.join(ends, F.col("s").eqNullSafe(F.col("ends_s")), "left").select("s", F.coalesce("last", below).alias("threshold"))
    joined = plan.join(cutoff, F.col("source").eqNullSafe(F.col("s")), "left")
    return joined.select("source", "source_size", "target", "copies", F.coalesce("threshold", F.lit(-1)).cast("long").alias("threshold"))


def _inside(rows: DataFrame, open_: DataFrame, depth: int) -> DataFrame:
    """The rows of each source's boundary bucket at this depth."""
    same = F.col("source").eqNullSafe(F.col("s"))
    if depth:
        same &= F.shiftright("h", BITS - depth) == F.col("prefix")
    return rows.select("source", "h", "size").join(open_, same).select("s", "need", "prefix", "h", "size")


def _refine(rows: DataFrame, open_: DataFrame, depth: int) -> DataFrame:
    """One level: histogram of 2^12 buckets in the boundary bucket of before,
    then the bucket in which the running sum reaches the need."""
    if depth == LEVEL_BITS:  # every row counts: sum first, join after
        hist = rows.groupBy(F.col("source").alias("hs"), F.shiftright("h", BITS - depth).alias("bucket")).agg(F.sum("size").alias("w"))
        hist = hist.join(open_, F.col("hs").eqNullSafe(F.col("s"))).select("s", "need", "bucket", "w")
    else:
        hist = _inside(rows, open_, depth - LEVEL_BITS).groupBy("s", "need", F.shiftright("h", BITS - depth).alias("bucket")).agg(F.sum("size").alias("w"))
    run = hist.withColumn("sum", F.sum("w").over(Window.partitionBy("s").orderBy("bucket")))
    return run.filter((F.col("sum") >= F.col("need")) & (F.col("sum") > 0)).groupBy("s").agg(F.min(F.struct("bucket", (F.col("need") - F.col("sum") + F.col("w")).alias("need"))).alias("b")).select("s", F.col("b.need").alias("need"), F.col("b.bucket").alias("prefix"))


def plan_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **rules) -> tuple[DataFrame, DataFrame]:
    """(narrow rows: key, source, size, h; one row of decisions per source).
    Texts are read once, to count their words and to hash them; the histograms
    read the narrow rows."""
    digest = F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit(""))))
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), id_hash(digest).alias("h"))
    distinct = cut(rows.groupBy("key", "source", "size", "h").agg(F.count("*").alias("m")), "distinct")
    rows = cut(occurrences(distinct).drop("row_h"), "mix")
    decisions = cut(hash_thresholds(rows, source_targets(rows, **rules)), "thresholds")
    return rows, decisions


def repeats(h: Column) -> Column:
    return F.col("copies") + F.when(h <= F.col("threshold"), 1).otherwise(0)


def times(rows: DataFrame, n: str, name: str) -> DataFrame:
    """Each row ``n`` times, numbered from 1 in ``name``. What repeats more than
    REPEATS times is dealt over tasks in pieces of so many. ``rows`` are read
    twice, so they should be written."""
    few = rows.filter(F.col(n) <= REPEATS).select("*", F.explode(F.sequence(F.lit(1).cast("long"), n)).alias(name))
    pieces = rows.filter(F.col(n) > REPEATS).select("*", F.explode(F.sequence(F.lit(1).cast("long"), n, F.lit(REPEATS))).alias("_from"))
    last = F.least(F.col("_from") + REPEATS - 1, F.col(n))
    many = pieces.repartition(F.xxhash64("_from"), "_from").select(*rows.columns, F.explode(F.sequence("_from", last)).alias(name))
    return few.union(many)


def occurrences(distinct: DataFrame) -> DataFrame:
    """Rows with ``h`` and a number m -> one row for each of the m occurrences,
    with row_h = h and an ``h`` of its own; the first has the row's own hash."""
    j = times(distinct.withColumnRenamed("h", "row_h"), "m", "j")
    return j.withColumn("h", F.when(F.col("j") == 1, F.col("row_h")).otherwise(id_hash(F.concat_ws(":", "row_h", "j")))).drop("j", "m")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **rules) -> DataFrame:
    """The mixed documents: each row as often as the mix takes it, all columns
    kept. Equal rows are gathered as one row and a number."""
    rows = docs.select(packed(docs), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), id_hash(F.to_json(packed(docs))).alias("h"))
    distinct = cut(rows.groupBy("source", "size", "h").agg(F.count("*").alias("m")), "mix")
    d = cut(hash_thresholds(occurrences(distinct), source_targets(occurrences(distinct), **rules)), "thresholds").withColumnRenamed("source", "of")
    same = F.col("source").eqNullSafe(F.col("of"))
    equal = occurrences(distinct.filter("m > 1")).join(d, same).groupBy(F.col("row_h").alias("equal_h")).agg(F.sum(repeats(F.col("h"))).alias("taken"))
    equal = cut(equal, "equal")
    one = rows.join(equal, F.col("h") == F.col("equal_h"), "left_anti").join(d, same).select("row", repeats(F.col("h")).alias("n"))
    many = rows.join(equal.select("equal_h"), F.col("h") == F.col("equal_h"), "left_semi").groupBy("h").agg(F.first("row").alias("row"))
    many = cut(many.join(equal, F.col("h") == F.col("equal_h")).filter("taken > 0").select("row", F.col("taken").alias("n")), "repeated")
    one = one.filter("n > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("j"))  # by the cap, few times
    return one.union(times(many, "n", "j").select("row", "j")).select("row.*")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, d = plan_mix(table(spark, sf_dir, "documents"))
    d = d.withColumnRenamed("source", "s")
    return rows.join(d, F.col("source").eqNullSafe(F.col("s"))).select(F.col("key").alias("doc_id"), "size", "source_size", "target", (repeats(F.col("h")) * F.col("size")).cast("long").alias("taken"))


#: The same rows from sorted running sums instead of histograms.
ORACLE = r"""
WITH RECURSIVE r AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS row_h
  FROM documents),
j AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, source, size, row_h) AS j FROM r),
d AS (
  SELECT doc_id, source, size,
         CASE WHEN j = 1 THEN row_h ELSE CAST('0x' || substr(md5(CAST(row_h AS VARCHAR) || ':' || CAST(j AS VARCHAR)), 1, 15) AS BIGINT) END AS h
  FROM j),
s AS (
  SELECT source, sum(size) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
  FROM d GROUP BY source),
water AS (
  SELECT 0 AS step, (SELECT 1.5 * sum(source_size) / sum(weight) FROM s)::DOUBLE AS level
  UNION ALL
  SELECT step + 1, (SELECT (1.5 * sum(source_size) - 2.0 * coalesce(sum(source_size) FILTER (water.level * weight >= 2.0 * source_size), 0))
                           / sum(weight) FILTER (NOT water.level * weight >= 2.0 * source_size) FROM s)::DOUBLE
  FROM water WHERE step < 40),
t AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size, least(2.0 * source_size, weight * (SELECT level FROM water WHERE step = 40))::DOUBLE AS target FROM s),
v AS (
  SELECT d.source, h, sum(size) AS w, sum(sum(size)) OVER (PARTITION BY d.source ORDER BY h) - sum(size) AS before FROM d GROUP BY d.source, h),
k AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
c AS (
  SELECT k.source, any_value(source_size) AS source_size, any_value(target) AS target, any_value(copies) AS copies,
         coalesce(max(h) FILTER (before + w / 2.0 <= target - copies * source_size AND target - copies * source_size > 0), -1) AS threshold
  FROM k JOIN v ON k.source IS NOT DISTINCT FROM v.source GROUP BY k.source)
SELECT doc_id, size, source_size, target, CAST((copies + CASE WHEN h <= threshold THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source
"""
