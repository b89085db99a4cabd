"""Merkle manifest of a dataset by slot pivots.

Every row is a leaf: the SHA-256 of its columns. The leaves of a group (a
language) are ordered and ``fanout`` consecutive nodes become their parent,
until one node, the group's subroot, is left; the subroots make the root the
same way.

Slot pivot: on each level conditional aggregates spread the children of a
parent into one column per slot. The columns put together and hashed are the
parent; put together without a child's own column they are its siblings, one
step of its proof. Blocks of BLOCK consecutive nodes share one shuffle: all
levels inside a block are windows over the same partitioning. The tops of the
blocks are the rows of the next stride, 1 / BLOCK as many; proofs are put
together from the top down, one join by (group, block) a stride.

Positions come from a range partitioning by (group, order, leaf, tie), written
once with the place of each row in its range, and a table of one row for each
(range, group). So neither a group nor a row that repeats a million times is
ever sorted or joined in one task. DataFrame functions only.

Defined results: null columns hash as ``-``; null groups are a group, the
first; null keys come first within theirs; rows of equal key are ordered by
their leaf, and wholly equal rows are interchangeable, each with its own
place and proof; empty and very long texts are hashed like any other; an empty
table gives no rows. Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: nodes that share a shuffle, at most (and a block's rows in one window)
BLOCK = 256
STEP = "array<struct<left:string,right:string>>"
#: (range, group) rows that may be broadcast, some 100 bytes each
BROADCAST_ROWS = 200_000


def sha(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("", *parts), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 length, a colon and the value."""
    s = value.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_hash(*values: Column) -> Column:
    return sha(*map(encoded, values))


def group_key(group: Column) -> Column:
    """A non-null string in the order of the groups, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def positions(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with a group ``g`` -> the same with ``pos`` (from 0 within the
    group) and ``n`` (its rows), and the largest ``n``."""
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["g", *order, "_tie"]
    placed = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    # after the sort this id is (partition, place in it)
    placed = cut(placed.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "leaves")
    placed = placed.withColumns({"_range": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND((1 << 33) - 1)})
    per = placed.groupBy("_range", "g").agg(F.min("_place").alias("first"), F.count("*").alias("m"))
    of = Window.partitionBy("g")
    before = F.sum("m").over(of.orderBy("_range")) - F.col("m")
    per = cut(per.select("_range", "g", (before - F.col("first")).alias("_shift"), F.sum("m").over(of).alias("n")), "offsets")
    parts, most = per.agg(F.count("*"), F.max("n")).first()
    small = F.broadcast(per) if parts <= BROADCAST_ROWS else per
    return placed.join(small, ["_range", "g"]).withColumn("pos", F.col("_place") + F.col("_shift")).drop("_at", "_range", "_place", "_shift"), most or 0


def stride(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Nodes (g, pos, n, h, ...) with ``block``, the ``top`` of the block that
    holds them, and ``path``: their siblings on each level up to it."""
    df = nodes.selectExpr("*", f"pos div {fanout**levels} AS block", "h AS top").repartition("g", "block")
    slots = [f"_slot{i}" for i in range(fanout)]
    for level in range(levels):
        width = fanout**level
        slot, parent = f"pos div {width} % {fanout}", f"PARTITION BY g, block, pos div {width * fanout}"
        df = df.selectExpr("*", *(f"max(CASE WHEN {slot} = {i} THEN top END) OVER ({parent}) AS {c}" for i, c in enumerate(slots)))
        left = ", ".join(f"CASE WHEN {slot} > {i} THEN {c} END" for i, c in enumerate(slots))
        right = ", ".join(f"CASE WHEN {slot} < {i} THEN {c} END" for i, c in enumerate(slots))
        # a group with one node on this level has come to its end
        step = f"CASE WHEN n > {width} THEN struct(concat_ws('', {left}) AS left, concat_ws('', {right}) AS right) END AS _step{level}"
        top = f"CASE WHEN n > {width} THEN sha2(concat_ws('', {', '.join(slots)}), 256) ELSE top END AS top"
        df = df.selectExpr(f"* EXCEPT (top, {', '.join(slots)})", step, top)
    steps = [f"_step{level}" for level in range(levels)]
    return df.selectExpr(f"* EXCEPT ({', '.join(steps)})", f"CAST(array_compact(array({', '.join(steps)})) AS {STEP}) AS path")


def build(nodes: DataFrame, most: int, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """Strides from the leaves up, and the last node of each group (g, pos, h).
    ``most`` is the size of the largest group."""
    strides = []
    while most > 1:
        levels = 1
        while fanout ** (levels + 1) <= BLOCK and fanout**levels < most:
            levels += 1
        size = fanout**levels
        done = cut(stride(nodes, fanout, levels), f"stride-{len(strides)}")
        strides.append(done)
        nodes = done.filter(F.col("pos") % size == 0).selectExpr("g", "block AS pos", f"(n + {size - 1}) div {size} AS n", "top AS h")
        most = -(-most // size)
    return strides, nodes.select("g", "pos", "h")


def climb(nodes: DataFrame, strides: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Leaves with their whole ``path`` and the other columns of ``tops``
    (g, pos, path, ...), the one node of each group above them."""
    extra = [c for c in tops.columns if c not in ("g", "pos", "path")]
    if not strides:
        return nodes.join(tops, ["g", "pos"])
    for s in reversed(strides):
        above = tops.select("g", F.col("pos").alias("block"), F.col("path").alias("_up"), *extra)
        tops = s.join(above, ["g", "block"]).withColumn("path", F.concat("path", "_up")).drop("block", "_up", "top")
    return tops


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, leaf, lambda h, s: sha(s["left"], h, s["right"]))


def manifest(rows: DataFrame, fanout: int = 2) -> DataFrame:
    """Rows (g, key, leaf, ...) -> the same with ``path``, ``subroot`` and
    ``root``; leaves of a group are ordered by (key, leaf)."""
    nodes, most = positions(rows, ["key", "leaf"])
    nodes = nodes.withColumn("h", F.col("leaf"))
    strides, subroots = build(nodes, most, fanout)
    # the subroots are the leaves of one more tree, in the order of the groups
    above = subroots.select(F.lit("").alias("g"), F.col("g").alias("group"), F.col("h").alias("subroot"))
    above, groups = positions(above, ["group"])
    above = above.withColumn("h", F.col("subroot"))
    upper, root = build(above, groups, fanout)
    above = climb(above, upper, root.select("g", "pos", F.array().cast(STEP).alias("path"), F.col("h").alias("root")))
    tops = above.select(F.col("group").alias("g"), F.lit(0).cast("long").alias("pos"), "path", "subroot", "root")
    return climb(nodes, strides, tops).drop("h", "pos", "n")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    def leaf(n_chars: Column) -> Column:
        return leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))

    docs = table(spark, sf_dir, "documents")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = docs.select(group_key(F.col("lang")).alias("g"), F.col("doc_id").alias("key"), leaf(F.col("n_chars")).alias("leaf"), F.when(changed, leaf(F.try_add(F.col("n_chars"), F.lit(1)))).alias("tampered"))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    out = manifest(rows).withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return out.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: The trees level by level; crc32 is spelled out bit by bit.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS g,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS chars,
         coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS more,
         coalesce(strlen(text) || ':' || text, '-') AS body,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
             lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)), 4294967295::BIGINT) AS crc
  FROM documents),
h AS (SELECT doc_id, g, sha256(head || chars || body) AS leaf, CASE WHEN doc_id IS NOT NULL AND crc % 7 = 0 THEN sha256(head || more || body) END AS tampered FROM d),
l AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n, row_number() OVER () AS id FROM h),
t AS (
  SELECT 0 AS level, g, pos, n, leaf AS h FROM l
  UNION ALL
  SELECT level + 1, g, pos // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY level, g, pos // 2),
s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS level, pos, n, subroot AS h FROM s
  UNION ALL
  SELECT level + 1, pos // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, pos // 2),
p AS (
  SELECT id, g, 0 AS level, pos, n, '' AS siblings, coalesce(tampered, leaf) AS f FROM l
  UNION ALL
  SELECT id, p.g, p.level + 1, p.pos // 2, (p.n + 1) // 2, siblings || coalesce(t.h, ''), sha256(CASE WHEN p.pos % 2 = 0 THEN f || coalesce(t.h, '') ELSE coalesce(t.h, '') || f END)
  FROM p LEFT JOIN t ON t.level = p.level AND t.g = p.g AND t.pos = xor(p.pos, 1) WHERE p.n > 1),
q AS (
  SELECT id, 0 AS level, s.pos, s.n, siblings, f FROM p JOIN s ON s.g = p.g WHERE p.n = 1
  UNION ALL
  SELECT id, q.level + 1, q.pos // 2, (q.n + 1) // 2, siblings || coalesce(u.h, ''), sha256(CASE WHEN q.pos % 2 = 0 THEN f || coalesce(u.h, '') ELSE coalesce(u.h, '') || f END)
  FROM q LEFT JOIN u ON u.level = q.level AND u.pos = xor(q.pos, 1) WHERE q.n > 1)
SELECT l.doc_id, l.leaf, s.subroot, u.h AS root, sha256(q.siblings) AS proof_sha256, q.f AS folded_root, q.f = u.h AS verified
FROM l JOIN s ON s.g = l.g JOIN q ON q.id = l.id AND q.n = 1 JOIN u ON u.n = 1
"""
