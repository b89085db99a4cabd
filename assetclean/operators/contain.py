"""Containment join: which texts of one side lie inside texts of the other.

An inverted index of grams, runs of characters, gives the candidates. A needle looks under one
gram only, the one that the fewest haystacks of its group hold, and not at all
if some gram of it is in none; ``contains`` then checks each candidate. So a
common stem ("series") is no hot key as long as the needle has a rarer part,
and nothing is compared with everything. Needles of one or two characters look
under themselves. Both joins are salted by counted keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetclean.functions.constants import constant
from assetclean.functions.text import clean_key, model_norm
from assetclean.operators.skew import salted_join
from assetclean.operators.validate import CANONICAL_RULES
from assetclean.session import cut

#: A needle of at least so many characters looks under grams of that length;
#: long grams keep the lists short where there are many texts.
GRAMS = (6, 3)


def _grams(texts: DataFrame) -> DataFrame:
    """(by, text, gram): each different run of ``n`` characters of a text."""
    starts = F.sequence(F.lit(1).cast("long"), F.char_length("text") - F.col("n") + 1)
    runs = F.array_distinct(F.transform(starts, lambda i: F.substring("text", i, F.col("n"))))
    return texts.where(F.char_length("text") >= F.col("n")).select("by", "text", F.explode(runs).alias("gram"))


def contained_pairs(needles: DataFrame, haystacks: DataFrame) -> DataFrame:
    """(by, needle, haystack) for each needle that lies in a haystack of the
    same group ``by``. Both sides have columns ``by`` and ``text``, without
    repeats, and should be written tables, as they are read several times.
    Nulls and empty needles match nothing here."""
    size = F.char_length("text")
    n = F.when(size >= GRAMS[0], GRAMS[0]).when(size >= GRAMS[1], GRAMS[1]).otherwise(size)
    sized = needles.where(size > 0).withColumn("n", n)
    used = [r["n"] for r in sized.select("n").distinct().collect()]  # four values at most
    lengths = F.array(*[F.lit(x) for x in sorted(used)]).cast("array<int>")
    index = cut(_grams(haystacks.withColumn("n", F.explode(lengths))), "index").withColumnRenamed("text", "haystack")
    held = index.groupBy("by", "gram").agg(F.count(F.lit(1)).alias("held"))
    mine = salted_join(_grams(sized), held, ["by", "gram"], "left")
    rarest = mine.groupBy("by", "text").agg(F.min(F.struct(F.coalesce("held", F.lit(0).cast("long")).alias("held"), "gram")).alias("r"))
    chosen = cut(rarest.where("r.held > 0").select("by", F.col("text").alias("needle"), F.col("r.gram").alias("gram")), "needles")
    found = salted_join(index, chosen, ["by", "gram"])
    return found.where(F.col("haystack").contains(F.col("needle"))).select("by", "needle", "haystack")


def first_contained(names: DataFrame, entries: DataFrame, either: bool = True) -> DataFrame:
    """(by, text, ord): for each name the least ``ord`` of the entries of its
    group whose text lies in the name or, with ``either``, holds it.

    ``names``: by, text; ``entries``: by, text, ord (any type with an order).
    An empty text lies in every text; nulls match nothing; names without a
    match are left out; repeated names give one row."""
    names = cut(names.select("by", "text").dropna().distinct(), "names")
    entries = cut(entries.select("by", "text", "ord").dropna().groupBy("by", "text").agg(F.min("ord").alias("ord")), "entries")
    texts = entries.select("by", "text")
    inside = contained_pairs(texts, names).select("by", F.col("haystack").alias("text"), F.col("needle").alias("entry"))
    if either:
        inside = inside.union(contained_pairs(names, texts).select("by", F.col("needle").alias("text"), F.col("haystack").alias("entry")))
    hits = inside.join(entries.withColumnRenamed("text", "entry"), ["by", "entry"]).select("by", "text", "ord")
    # an empty entry lies in every name of its group, an empty name in every entry
    empty = entries.where("text = ''").select("by", "ord")
    hits = hits.union(names.join(empty, "by").select("by", "text", "ord"))
    if either:
        least = entries.groupBy("by").agg(F.min("ord").alias("ord"))
        hits = hits.union(names.where("text = ''").join(least, "by").select("by", "text", "ord"))
    return hits.groupBy("by", "text").agg(F.min("ord").alias("ord"))


def lookup_products(df: DataFrame, products: DataFrame, mfg: str = "mfg", model: str = "model", prefix: str = "meta_") -> DataFrame:
    """J8-J10 with a caller's product table of any size, in the schema of
    ``sources.metadata``: adds ``{prefix}mfg_key, {prefix}founded_year,
    {prefix}start_year, {prefix}sources``, as ``lookup_metadata`` does with the
    table it knows.

    A manufacturer is the one that the fixed rules name, else the first of the
    table whose key lies in the name. Among its models an equal one wins, else
    the first in table order of which either name contains the other. Names
    are matched once each, however many rows have them; a blank or null
    manufacturer or a null model finds nothing."""
    k, n = f"{prefix}k", f"{prefix}n"
    rows = df.withColumns({k: clean_key(mfg), n: model_norm(model)})
    pairs = cut(rows.where((F.col(k) != "") & F.col(n).isNotNull()).select(F.col(k).alias("k"), F.col(n).alias("n")).distinct(), "pairs")
    table = products.select(F.struct("mfg_ord", "model_ord").alias("ord"), "mfg_ord", F.col("mfg_key").alias("by"), F.col("model_key").alias("text"), "founded_year", F.col("product_start_year").alias("start_year"), "sources")
    table = cut(table, "products")

    rules = [{"subs": list(subs), "key": key} for subs, key in CANONICAL_RULES]
    by_rule = F.get(F.filter(constant(rules), lambda r: F.exists(r["subs"], F.col("k").contains)), F.lit(0))["key"]
    makers = cut(pairs.select("k").distinct().withColumn("canon", by_rule), "makers")
    keys = table.select(F.lit("").alias("by"), F.col("by").alias("text"), F.struct("mfg_ord", F.col("by").alias("key")).alias("ord"))
    guessed = first_contained(makers.where("canon is null").select(F.lit("").alias("by"), F.col("k").alias("text")), keys, either=False)
    makers = makers.where("canon is not null").union(guessed.select("text", "ord.key"))

    named = cut(salted_join(pairs, makers, ["k"]).select("k", "n", F.col("canon").alias("by"), F.col("n").alias("text")), "named")
    wanted = named.select("by", "text").distinct()
    equal = wanted.join(table.groupBy("by", "text").agg(F.min("ord").alias("ord")), ["by", "text"])
    equal = cut(equal, "equal")
    near = first_contained(wanted.join(equal, ["by", "text"], "left_anti"), table)
    entry = table.select("by", "ord", "founded_year", "start_year", "sources").dropDuplicates(["by", "ord"])
    best = equal.select("by", "text", "ord").union(near.select("by", "text", "ord")).join(entry, ["by", "ord"])
    out = named.join(best, ["by", "text"]).select(F.col("k").alias(k), F.col("n").alias(n), F.col("by").alias(f"{prefix}mfg_key"), *[F.col(c).alias(f"{prefix}{c}") for c in ("founded_year", "start_year", "sources")])
    return salted_join(rows, cut(out, "answers"), [k, n], "left").drop(k, n).select(*df.columns, *[f"{prefix}{c}" for c in ("mfg_key", "founded_year", "start_year", "sources")])
