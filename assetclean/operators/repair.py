"""Group-majority repair of labels and codes.

All statistics are two-level aggregations (row -> (group, value) counts by
hash -> one row per group) whose output is one row per group or per distinct
label; the result is joined back with an equi-join that AQE broadcasts only
when it is small at run time. No step gathers a group's rows into one task.

"First seen" always means smallest ``_ord`` (the caller's total input order).

Model typo pairs (M2) are found without comparing all pairs of a
manufacturer's labels: of three segments of a key, two edits leave one untouched, and the
other key holds it shifted by at most two places. Keys are joined on those
segments and only the candidates are checked with ``levenshtein``. This is
exact, takes a fixed number of substrings per label, whatever its length, and
the work grows with the number of close pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetclean.functions.text import clean_key, paren_tag, strip_paren_tag
from assetclean.session import cut

PREFIX_SHARE = 0.6
LENGTH_SHARE = 0.70
MIN_SERIALS = 3
TYPO_BIG = 5
TYPO_SMALL = 2
MAX_PAREN = 2
MAX_TYPO_DISTANCE = 2


@dataclass
class Corrections:
    """Model corrections keyed by (g_mfg, g_model); serial corrections keyed by raw serial."""

    models: DataFrame
    serials: DataFrame


def with_group_keys(df: DataFrame, mfg: str = "w_mfg", model: str = "w_model") -> DataFrame:
    return df.withColumns({"g_mfg": clean_key(mfg), "g_model": clean_key(model)})


def _label_groups(df: DataFrame, mfg: str, model: str, order_col: str) -> DataFrame:
    g = with_group_keys(df, mfg, model)
    # spellings first: sums and minima of numbers aggregate by hash, and what
    # needs an ordered pick of a string is left with one row per spelling
    spelled = g.groupBy("g_mfg", "g_model", F.col(mfg).alias("mfg"), F.col(model).alias("model")).agg(
        F.count(F.lit(1)).alias("n"), F.min(order_col).alias("first")
    )
    return spelled.groupBy("g_mfg", "g_model").agg(
        F.sum("n").alias("n_rows"), F.min("first").alias("first_ord"), F.min_by("model", "first").alias("orig_model"), F.min_by("mfg", "first").alias("_mfg")
    )


def _named(groups: DataFrame) -> DataFrame:
    mfgs = groups.groupBy("g_mfg").agg(F.min("first_ord").alias("mfg_ord"), F.min_by("_mfg", "first_ord").alias("orig_mfg"))
    return groups.drop("_mfg").join(mfgs, "g_mfg")


def model_groups(df: DataFrame, mfg: str = "w_mfg", model: str = "w_model", order_col: str = "_ord") -> DataFrame:
    """A2: one row per case-insensitive (manufacturer, model) with its row
    count, first position and first-seen spellings of both names."""
    return _named(_label_groups(df, mfg, model, order_col))


def written_groups(df: DataFrame, mfg: str = "w_mfg", model: str = "w_model", order_col: str = "_ord") -> DataFrame:
    """:func:`model_groups` over groups that are written once, for the many
    steps that read them: the rows are scanned once."""
    return _named(cut(_label_groups(df, mfg, model, order_col), "groups"))


def segments(key: Column, edits: int = MAX_TYPO_DISTANCE) -> Column:
    """``(len, i, seg)``: the key cut into ``edits + 1`` even segments."""
    n, k = F.length(key), edits + 1

    def one(i: Column) -> Column:
        start, end = F.floor(i * n / k), F.floor((i + 1) * n / k)
        return F.struct(n.alias("len"), i.alias("i"), key.substr((start + 1).cast("int"), (end - start).cast("int")).alias("seg"))

    return F.transform(F.sequence(F.lit(0), F.lit(edits)), one)


def probes(key: Column, edits: int = MAX_TYPO_DISTANCE) -> Column:
    """The ``(len, i, seg)`` that a key within ``edits`` edits may have: one of
    its segments is untouched and lies here, shifted by ``edits`` at most."""
    n, k = F.length(key), edits + 1
    shifts = F.sequence(F.lit(-edits), F.lit(edits))

    def of_length(d: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(edits)), lambda i: F.transform(shifts, lambda shift: piece(n + d, i, shift))))

    def piece(length: Column, i: Column, shift: Column) -> Column:
        start, end = F.floor(i * length / k), F.floor((i + 1) * length / k)
        at, size = start + shift, end - start
        fits = (length >= 0) & (at >= 0) & (at + size <= n)
        return F.when(fits, F.struct(length.alias("len"), i.alias("i"), key.substr((at + 1).cast("int"), size.cast("int")).alias("seg")))

    return F.array_distinct(F.filter(F.flatten(F.transform(shifts, of_length)), lambda x: x.isNotNull()))


def model_corrections(groups: DataFrame) -> DataFrame:
    """M1 + M2 over the per-group table from :func:`model_groups`.

    Returns ``g_mfg, g_model, original, corrected, manufacturer, reason, kind,
    distance, line_pos`` (one row per corrected case-insensitive model).
    """
    gk = groups.withColumn("norm_key", F.regexp_replace("g_model", "[^a-z0-9]", "")).where(F.col("norm_key") != "")

    # M1: variants sharing one alphanumeric key -> most rows, ties first seen.
    wk = Window.partitionBy("g_mfg", "norm_key")
    ranked = gk.withColumns(
        {
            "_rn": F.row_number().over(wk.orderBy(F.desc("n_rows"), F.asc("first_ord"))),
            "_nvar": F.count(F.lit(1)).over(wk),
            "_dominant": F.max_by("orig_model", F.struct(F.col("n_rows"), -F.col("first_ord"))).over(wk),
            "_npos": F.min("first_ord").over(wk),
        }
    )
    m1 = ranked.where((F.col("_nvar") > 1) & (F.col("_rn") > 1)).select(
        "g_mfg",
        "g_model",
        F.col("orig_model").alias("original"),
        F.col("_dominant").alias("corrected"),
        F.col("orig_mfg").alias("manufacturer"),
        F.format_string(
            "Standardized model spelling '%s' to match dominant variant '%s' for manufacturer '%s'",
            "orig_model",
            "_dominant",
            "orig_mfg",
        ).alias("reason"),
        F.lit("spacing").alias("kind"),
        F.lit(None).cast("int").alias("distance"),
        F.lit(1).alias("_phase"),
        F.struct(F.col("mfg_ord"), F.lit(1).alias("p"), F.col("_npos").alias("a"), F.col("_rn").cast("long").alias("b")).alias(
            "line_pos"
        ),
    )

    # M2: near keys inside a manufacturer, big side >= 5 rows, small side <= 2.
    keys = gk.groupBy("g_mfg", "norm_key").agg(
        F.sum("n_rows").alias("cnt"),
        F.min("first_ord").alias("pos"),
        F.min_by("orig_model", "first_ord").alias("first_variant"),
    )
    small = keys.where(F.col("cnt") <= TYPO_SMALL).select(
        "g_mfg", F.explode(probes(F.col("norm_key"))).alias("_p"), F.col("norm_key").alias("s_key"), F.col("pos").alias("s_pos")
    )
    big = keys.where(F.col("cnt") >= TYPO_BIG).select(
        "g_mfg", F.explode(segments(F.col("norm_key"))).alias("_p"), F.col("norm_key").alias("b_key"), F.col("pos").alias("b_pos"), F.col("first_variant").alias("b_target")
    )
    pairs = (
        small.join(big, ["g_mfg", "_p"])
        .drop("_p")
        .distinct()
        .where(F.abs(F.length("s_key") - F.length("b_key")) <= MAX_TYPO_DISTANCE)
        .withColumn("dist", F.levenshtein("s_key", "b_key", MAX_TYPO_DISTANCE))
        .where(F.col("dist").between(1, MAX_TYPO_DISTANCE))
    )
    order = F.struct(F.least("s_pos", "b_pos").alias("i"), F.greatest("s_pos", "b_pos").alias("j"))
    best = pairs.groupBy("g_mfg", "s_key").agg(
        F.max_by(F.struct(F.col("b_target").alias("target"), F.col("dist").alias("dist")), order).alias("_last"),
        F.min(order).alias("_first"),
    )
    m2 = best.join(gk.withColumnRenamed("norm_key", "s_key"), ["g_mfg", "s_key"]).select(
        "g_mfg",
        "g_model",
        F.col("orig_model").alias("original"),
        F.col("_last.target").alias("corrected"),
        F.col("orig_mfg").alias("manufacturer"),
        F.format_string(
            "Corrected spelling typo '%s' to dominant model '%s' for manufacturer '%s' (Levenshtein distance: %d)",
            "orig_model",
            "_last.target",
            "orig_mfg",
            "_last.dist",
        ).alias("reason"),
        F.lit("typo").alias("kind"),
        F.col("_last.dist").alias("distance"),
        F.lit(2).alias("_phase"),
        F.struct(
            F.col("mfg_ord"), F.lit(2).alias("p"), F.col("_first.i").alias("a"), F.col("first_ord").alias("b")
        ).alias("line_pos"),
    )
    both = m1.unionByName(m2)
    cols = ["original", "corrected", "manufacturer", "reason", "kind", "distance"]
    merged = both.groupBy("g_mfg", "g_model").agg(
        F.max_by(F.struct(*cols), "_phase").alias("_v"), F.min("line_pos").alias("line_pos")
    )
    return merged.select("g_mfg", "g_model", *[F.col(f"_v.{c}").alias(c) for c in cols], "line_pos")


def serial_corrections(df: DataFrame, groups: DataFrame, sn: str = "w_sn", order_col: str = "_ord") -> DataFrame:
    """M3 (missing dominant prefix), M4 (stray ``(n)`` tag), M5 (length note).

    Keyed by the serial alone; when a serial gets entries from several groups
    the last prefix/tag fix wins, and a length note only stands if it was the
    first entry for that serial. Returns ``sn, corrected, manufacturer, model,
    reason, kind, line_pos``.
    """
    r = (
        with_group_keys(df)
        .where(F.col(sn) != "")
        .select("g_mfg", "g_model", F.col(order_col).alias("_o"), F.col(sn).alias("sn"))
        .withColumn("_clean", strip_paren_tag("sn"))
        .withColumns(
            {
                "_prefix": F.upper(F.regexp_extract("_clean", "^([A-Za-z]+)", 1)),
                "_paren": F.col("sn").rlike(r"^\(\d+\)"),
                "_len": F.length("_clean"),
            }
        )
    )
    gkey = ["g_mfg", "g_model"]
    # the rows are counted once, by prefix and length; all statistics come from these counts
    counts = r.groupBy(*gkey, "_prefix", "_len").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("_paren").cast("int")).alias("pc"), F.min("_o").alias("o"))
    counts = cut(counts, "counts")

    def mode(of: DataFrame, value: str, name: str) -> DataFrame:
        by = of.groupBy(*gkey, value).agg(F.sum("c").alias("c"), F.min("o").alias("o"))
        return by.groupBy(*gkey).agg(F.max_by(value, F.struct(F.col("c"), -F.col("o"))).alias(f"dom_{name}"), F.max("c").alias(f"dom_{name}_cnt"))

    gstats = counts.groupBy(*gkey).agg(F.sum("c").alias("n"), F.sum("pc").alias("pc"))
    pstats = mode(counts.where(F.col("_prefix") != ""), "_prefix", "prefix").withColumnRenamed("dom_prefix_cnt", "dom_cnt")
    lstats = mode(counts, "_len", "len")
    stats = (
        gstats.where(F.col("n") >= MIN_SERIALS)
        .join(pstats, gkey, "left")
        .join(lstats, gkey, "left")
        .join(groups.select(*gkey, "orig_mfg", "orig_model", "mfg_ord", "first_ord"), gkey)
    )
    j = r.join(stats, gkey)
    n = F.col("n").cast("double")
    m3_ok = (
        F.col("dom_prefix").isNotNull()
        & (F.col("dom_cnt") / n >= PREFIX_SHARE)
        & ~F.upper("_clean").startswith(F.col("dom_prefix"))
    )
    m4_ok = (F.col("pc") > 0) & (F.col("pc") <= MAX_PAREN) & (F.col("n") - F.col("pc") >= MIN_SERIALS) & F.col("_paren")
    m5_ok = (F.col("dom_len_cnt") / n >= LENGTH_SHARE) & (F.col("_len") != F.col("dom_len"))

    def entry(ok: Column, rank: int, kind: str, corrected: Column, reason: Column) -> Column:
        return F.struct(
            ok.alias("ok"),
            F.lit(rank).alias("rank"),
            F.lit(kind).alias("kind"),
            # texts are only made for what is found
            F.when(ok, corrected).alias("corrected"),
            F.when(ok, reason).alias("reason"),
        )

    entries = F.array(
        entry(
            m3_ok,
            1,
            "prefix",
            F.concat(paren_tag("sn"), F.col("dom_prefix"), F.col("_clean")),
            F.format_string(
                "Prepended missing dominant prefix '%s' to serial '%s' to match dominant format under '%s' (model: '%s')",
                "dom_prefix",
                "sn",
                "orig_mfg",
                "orig_model",
            ),
        ),
        entry(
            m4_ok,
            2,
            "paren",
            F.col("_clean"),
            F.format_string(
                "Stripped unexpected prefix '%s' from serial '%s' for manufacturer '%s'",
                F.regexp_extract("sn", r"^(\(\d+\))", 1),
                "sn",
                "orig_mfg",
            ),
        ),
        entry(
            m5_ok,
            3,
            "length",
            F.col("sn"),
            F.format_string(
                "Serial length mismatch (%d chars vs dominant length of %d chars) for '%s' (model: '%s')",
                "_len",
                "dom_len",
                "orig_mfg",
                "orig_model",
            ),
        ),
    )
    e = j.where(m3_ok | m4_ok | m5_ok).select(  # entries are only built for rows that have one
        "sn", "orig_mfg", "orig_model", "mfg_ord", "first_ord", "_o", F.explode(F.filter(entries, lambda x: x["ok"])).alias("e")
    )
    fix = F.col("e.rank") < 3
    # Last prefix/tag fix wins; a length note only if nothing else wrote first.
    prio = F.struct(
        fix.alias("fix"),
        F.when(fix, F.col("mfg_ord")).otherwise(-F.col("mfg_ord")).alias("a"),
        F.when(fix, F.col("first_ord")).otherwise(-F.col("first_ord")).alias("b"),
        F.col("e.rank").alias("c"),
    )
    value = F.struct(
        F.col("e.corrected").alias("corrected"),
        F.col("orig_mfg").alias("manufacturer"),
        F.col("orig_model").alias("model"),
        F.col("e.reason").alias("reason"),
        F.col("e.kind").alias("kind"),
    )
    pos = F.struct(F.col("mfg_ord"), F.col("first_ord"), F.col("e.rank").alias("rank"), F.col("_o"))
    out = e.groupBy("sn").agg(F.max_by(value, prio).alias("_v"), F.min(pos).alias("line_pos"))
    return out.select("sn", "_v.*", "line_pos")


def find_corrections(df: DataFrame, order_col: str = "_ord") -> Corrections:
    """Analyse a de-duplicated table (working columns ``w_*``)."""
    groups = written_groups(df, order_col=order_col)
    return Corrections(models=model_corrections(groups), serials=serial_corrections(df, groups, order_col=order_col))


def apply_corrections(
    df: DataFrame,
    corr: Corrections,
    headers: dict[str, str | None] | None = None,
) -> DataFrame:
    """M6: one pass, not transitive. Model fix on (manufacturer, model); serial
    fix on the original serial only (any manufacturer). Raw columns named in
    ``headers`` get the corrected values too."""
    headers = headers or {}
    g = with_group_keys(df)
    mc = corr.models.select("g_mfg", "g_model", F.col("corrected").alias("_mc"))
    g = g.join(mc, ["g_mfg", "g_model"], "left")
    upd = {"w_model": F.coalesce(F.col("_mc"), F.col("w_model"))}
    if headers.get("model"):
        upd[headers["model"]] = F.when(F.col("_mc").isNotNull(), F.col("_mc")).otherwise(F.col(f"`{headers['model']}`"))
    g = g.withColumns(upd).drop("_mc", "g_mfg", "g_model")

    sc = corr.serials.select(F.col("sn").alias("w_sn_orig"), F.col("corrected").alias("_sc"))
    has = g.where(F.col("w_sn_orig") != "").join(sc, "w_sn_orig", "left")
    none = g.where(F.col("w_sn_orig") == "").withColumn("_sc", F.lit(None).cast("string"))
    g = has.unionByName(none)
    upd = {"w_sn": F.coalesce(F.col("_sc"), F.col("w_sn"))}
    if headers.get("sn"):
        upd[headers["sn"]] = F.when(F.col("_sc").isNotNull(), F.col("_sc")).otherwise(F.col(f"`{headers['sn']}`"))
    return g.withColumns(upd).drop("_sc")
