"""Benchmark decontamination by size-partitioned MinHash containment search.

Every document and test item is the set of its distinct shingles of five
words. A document's sketch is a one-permutation MinHash: the hash space is cut
into equal bins and each bin keeps its least hash. Documents are partitioned by
size: a set of n shingles gets the power of two next above n * BINS_PER_SHINGLE
as its number of bins, so that a shingle of a short item survives in the sketch
of a long document as likely as in that of a short one. An item is sketched
with the bins of each partition and probes it; documents that agree with it in
a bin are candidates, and exact containment of the word shingles decides.

With two bins a shingle, a shared shingle is its bin's least with probability
0.79 or more, so a document that holds 80 % of an item of q shingles is missed
with probability at most 0.21 ** (0.8 q): 1e-6 for items of 13 words or more.
Items of fewer than SHORT shingles are searched through all shingles, which
misses none. With ``inside``, which op8 and ``clean`` use, items of fewer than
five words are searched among the documents' runs of as many words, for the
numbers of words that occur among the items. DataFrame functions only.

Defined results: A-Z is lowered; a text of fewer than five words is one
shingle, its whole word sequence (the oracle's SQL, and ``contained`` without
``inside``, find such an item only where it is a whole text); null or empty texts, on either side, match
nothing; rows that share a key count as one document (or item) with the best
containment of its rows, null keys included (``clean`` decides for each row);
extra columns are ignored; empty
tables give no rows. No document, bin or candidate list is capped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, word_array

WORDS = 5
BINS_PER_SHINGLE = 2
SHORT = 9
PERCENT = 80
#: some 50 bytes each in an executor's memory
BROADCAST_ROWS = 1_000_000


def shingle_hashes(words: Column) -> Column:
    """Sorted distinct 64-bit hashes of the shingles of a word array column."""
    one = F.transform(F.sequence(F.lit(1), F.size(words) - (WORDS - 1)), lambda i: F.xxhash64(F.slice(words, i, WORDS)))
    return F.sort_array(F.array_distinct(F.when(F.size(words) >= WORDS, one).when(F.size(words) > 0, F.array(F.xxhash64(words)))))


def shingle_texts(words: Column) -> Column:
    one = F.transform(F.sequence(F.lit(1), F.size(words) - (WORDS - 1)), lambda i: F.array_join(F.slice(words, i, WORDS), " "))
    return F.array_distinct(F.when(F.size(words) >= WORDS, one).when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>")))


def _sets(rows: DataFrame, key: str, text: str) -> DataFrame:
    words = rows.select(F.col(key).alias("key"), word_array(F.col(text), lower=True).alias("words"))
    return words.filter(F.size("words") > 0).select("key", shingle_hashes(F.col("words")).alias("set"))


def document_sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, bits (2^bits bins), hash, least: one row for each distinct shingle,
    ``least`` where it is its bin's least."""
    rows = _sets(docs, key, text).withColumn("bits", F.ceil(F.log2(F.size("set") * F.lit(BINS_PER_SHINGLE))).cast("int"))

    def bin_of(h: Column) -> Column:
        return F.call_function("shiftrightunsigned", h, 64 - F.col("bits"))

    marked = F.transform("set", lambda h, i: F.struct(h.alias("hash"), ((i == 0) | (bin_of(h) != bin_of(F.get("set", i - 1)))).alias("least")))
    return rows.select("key", "bits", F.explode(marked).alias("s")).select("key", "bits", "s.hash", "s.least")


def item_probes(items: DataFrame, key: str, text: str) -> DataFrame:
    """item, hash, from_bits: the hash is its bin's least in the item for
    2^from_bits bins and more. In sorted order only the neighbour before can
    share its bin, so from_bits is one more than their common leading bits."""
    rows = _sets(items, key, text).select(F.col("key").alias("item"), F.size("set").alias("n"), "set", F.posexplode("set").alias("i", "hash"))
    common = 64 - F.length(F.bin(F.col("hash").bitwiseXOR(F.get("set", F.col("i") - 1))))
    return rows.select("item", "hash", F.when(F.col("i") == 0, 0).otherwise(common + 1).alias("from_bits"), (F.col("n") < SHORT).alias("short"))


def candidates(docs: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str) -> DataFrame:
    """Distinct (key, item) that agree in a bin of the document's partition.
    The probes are broadcast if they are few; else both sides are shuffled by
    hash, with the same result."""
    d, q = document_sketches(docs, key, text), cut(item_probes(items, item_key, item_text), "probes")
    if q.count() <= BROADCAST_ROWS:
        q = F.broadcast(q)
    agree = d.join(q, "hash").filter((F.col("least") & (F.col("bits") >= F.col("from_bits"))) | F.col("short"))
    return agree.select("key", "item").distinct()


def short_hits(docs: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str) -> DataFrame | None:
    """key, item, 1, 1: the documents that hold an item of fewer than WORDS
    words; None if there is no such item."""
    q = items.select(F.col(item_key).alias("item"), word_array(F.col(item_text), lower=True).alias("words"))
    q = cut(q.filter(F.size("words").between(1, WORDS - 1)).select("item", F.size("words").alias("k"), F.array_join("words", " ").alias("run")).distinct(), "short")
    lengths = sorted(r["k"] for r in q.select("k").distinct().collect())  # WORDS - 1 at most
    if not lengths:
        return None
    if q.count() <= BROADCAST_ROWS:
        q = F.broadcast(q)
    d = docs.select(F.col(key).alias("key"), word_array(F.col(text), lower=True).alias("words"))

    def runs(k: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size("words") - (k - 1)), lambda i: F.array_join(F.slice("words", i, k), " "))
        return F.when(F.size("words") >= k, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))

    d = d.select("key", F.explode(F.concat(*[runs(k) for k in lengths])).alias("run"))  # words hold no space: runs of other lengths differ
    one = F.lit(1).cast("long")
    return d.join(q.select("item", "run"), "run").select("key", "item").distinct().select("key", "item", one.alias("shared"), one.alias("item_shingles"))


def contained(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", percent: int = PERCENT, inside: bool = False) -> DataFrame:
    """key, item, shared, item_shingles: the documents that hold at least
    ``percent`` of an item's shingles."""
    short = None
    if inside:
        short = short_hits(docs, items, key, text, item_key, item_text)
        items = items.filter(F.size(word_array(F.col(item_text))) >= WORDS)
    found = cut(candidates(docs, items, key, text, item_key, item_text), "candidates")
    d = docs.select(F.col(key).alias("d_key"), F.col(text).alias("d_text"))
    # only the candidates' texts are cut into shingles again, and only once a document
    hits = found.groupBy("key").agg(F.collect_set(F.struct("item")).alias("found"))  # at most the number of items
    d = d.join(hits, F.col("d_key").eqNullSafe(F.col("key"))).select("key", "found", word_array(F.col("d_text"), lower=True).alias("words"))
    d = d.select("key", "found", shingle_texts(F.col("words")).alias("doc_set")).select("key", F.explode("found").alias("f"), "doc_set").select("key", F.col("f.item").alias("item"), "doc_set")
    q = items.select(F.col(item_key).alias("q_item"), word_array(F.col(item_text), lower=True).alias("words")).select("q_item", shingle_texts(F.col("words")).alias("item_set")).filter(F.size("item_set") > 0)
    both = d.join(q, F.col("item").eqNullSafe(F.col("q_item")))
    both = both.select("key", "item", F.size(F.array_intersect("doc_set", "item_set")).cast("long").alias("shared"), F.size("item_set").cast("long").alias("item_shingles"))
    both = both.filter(100 * F.col("shared") >= percent * F.col("item_shingles"))
    if short is not None:
        both = both.union(short)
    best = both.groupBy("key", "item").agg(F.max(F.struct((F.col("shared") / F.col("item_shingles")).alias("part"), "shared", "item_shingles")).alias("b"))
    return best.select("key", "item", "b.shared", "b.item_shingles")


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """``docs`` without the rows that hold a test item. What a row holds
    depends on its text alone, so rows are known by a 128-bit hash of it: null
    and repeated keys make no difference."""
    texts = docs.select(F.md5(F.col(text)).alias("key"), F.col(text).alias("text"))
    leaks = cut(contained(texts, items, "key", "text", inside=True, **names).select(F.col("key").alias("leak")).distinct(), "leaks")  # its size is known to the planner
    return docs.alias("d").join(leaks.alias("l"), F.md5(F.col(f"d.{text}")) == F.col("l.leak"), "left_anti")


def op8_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), inside=True)
    return got.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), "shared", "item_shingles", (F.col("shared") / F.col("item_shingles")).alias("containment"))


#: All shingles of all documents joined with those of the items.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
ds AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s FROM d WHERE len(w) > 0),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
bs AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s FROM b WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS item_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS shared, any_value(item_shingles) AS item_shingles, count(*) / any_value(item_shingles) AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id
HAVING 100 * count(*) >= 80 * any_value(item_shingles)
"""
