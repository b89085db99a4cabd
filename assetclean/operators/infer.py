"""Manufacturer inference (section 2.9, E3) by ordered rules.

Model-name rules are tried first (substring of the normalised model), then
serial rules on the upper-cased serial; the first match wins. The rule lists
are data, held as constants of the plan, so no join or UDF is involved. The per-key cache lookup (J3) only touches the rows
whose manufacturer is blank; the others never enter that join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetclean.functions.constants import constant, constant_map
from assetclean.functions.text import bind, col, model_norm, pipe_key, strip

UNKNOWN_MANUFACTURER = "Unknown Manufacturer"

# Model keyword rules, in match order (substring of the
# lower-cased, whitespace-collapsed model name).
MODEL_RULES: list[tuple[tuple[str, ...], str]] = [
    (("eleganza",), "Linet"),
    (("spectrum iq", "spectrm iq"), "Baxter Healthcare Corp."),
    (("flowtron",), "Arjo Inc."),
    (("rapidvac",), "Covidien"),
    (("tat5000", "tat 5000"), "Exergen"),
    (("apex pro", "patient data module", "pdm"), "GE Healthcare"),
    (("filac", "suretemp", "spot vital"), "Welch Allyn"),
    (("aed", "propaq", "r series", "x series", "m series", "rseries"), "ZOLL Medical"),
    (("intellivue", "mx40", "mx500", "m3002a"), "Philips"),
    (("cv190", "cv-190"), "Olympus"),
    (("rad8", "rad-8"), "Masimo"),
    (("cst-4000", "cst-5000", "cst4000", "cst5000"), "Cogentix Medical"),
    (("642e",), "Lab Corp."),
    (("g380pl",), "Unico"),
    (("ce 1434", "ce1434"), "American Diagnostic"),
    (("iob-507", "iob507"), "Jiangmen Dacheng"),
    (("smartvue",), "Thermo Scientific"),
    (("1061", "1115"), "Stryker"),
    (("benevision", "epm12ma", "epm-12m"), "Mindray"),
    (("uc95",), "BioSonic"),
]

# Serial rules on the upper-cased serial, in match order.
# Each rule is a list of (test, pattern) alternatives: "prefix", "suffix" or
# "contains".
SERIAL_RULES: list[tuple[list[tuple[str, str]], str]] = [
    ([("prefix", "WU20"), ("suffix", "EN")], "Jiangmen Dacheng"),
    ([("prefix", "DE")], "Philips"),
    (
        [
            ("prefix", p)
            for p in (
                "AR13", "AR18", "AR20", "AR21", "AR22", "AR25", "AF11", "AF16", "AF17", "AF18", "AF19", "AF23",
                "AF24", "AF25", "AI10", "AI11", "AI15", "T03", "T04", "T08", "T09", "T10", "T11", "T12", "T13",
                "T14", "T15", "T16", "X18", "X19", "X22", "X23", "X25", "D16", "3T13",
            )
        ],
        "ZOLL Medical",
    ),
    ([("prefix", "CS17"), ("prefix", "CS07")], "Cogentix Medical"),
    ([("contains", "LB")], "Lab Corp."),
    ([("prefix", "A15")], "Exergen"),
    ([("prefix", p) for p in ("RTS14", "RT90", "RT91", "SA31", "SPX18")], "GE Healthcare"),
    (
        [("prefix", p) for p in ("A11", "A12", "A14", "A16", "A20", "A10", "20150", "20081", "2303", "0743")],
        "Welch Allyn",
    ),
    ([("prefix", "2100")], "Arjo Inc."),
    ([("prefix", p) for p in ("375", "382", "381", "383", "378", "380")], "Baxter Healthcare Corp."),
    ([("prefix", p) for p in ("130", "131")], "BioSonic"),
    ([("prefix", "VL01")], "Covidien"),
    ([("prefix", p) for p in ("1743", "1744", "1745", "1748")], "Hospira"),
    ([("prefix", "M19")], "Masimo"),
    ([("prefix", "7500"), ("prefix", "7550")], "Olympus"),
    ([("prefix", p) for p in ("202100", "202200", "201700", "1090")], "Stryker"),
    ([("prefix", p) for p in ("1835", "181")], "Thermo Scientific"),
    ([("prefix", "G38L")], "Unico"),
    ([("prefix", p) for p in ("202101", "202002", "202402", "202403")], "Linet"),
    ([("prefix", "2219"), ("prefix", "C241")], "American Diagnostic"),
    ([("prefix", p) for p in ("FS-28", "F5-28", "FS-11", "F5-11", "AH9-3", "AH9-2")], "Mindray"),
]


def _serial_tables() -> tuple[dict[int, dict[str, dict]], list[dict]]:
    """The serial rules as look-ups: length -> prefix -> (order, name), and the
    few tests that are no prefix, in order."""
    prefixes: dict[int, dict[str, dict]] = {}
    others = []
    for order, (alts, name) in enumerate(SERIAL_RULES):
        for kind, pat in alts:
            if kind == "prefix":
                prefixes.setdefault(len(pat), {}).setdefault(pat, {"order": order, "name": name})
            else:
                others.append({"ends": int(kind == "suffix"), "pat": pat, "hit": {"order": order, "name": name}})
    return prefixes, others


def guess_manufacturer(model: str | Column, sn: str | Column) -> Column:
    """Rule-based manufacturer guess from model and serial; null when no rule
    fires. A serial is looked up by its first characters, once for each length
    of prefix, and of all rules that fit the first one wins."""
    return bind(F.struct(model_norm(model).alias("mn"), F.upper(strip(F.coalesce(col(sn), F.lit("")))).alias("su")), lambda n: _guess(n["mn"], n["su"]))


def _guess(mn: Column, su: Column) -> Column:
    names = constant([{"sub": pat, "name": name} for pats, name in MODEL_RULES for pat in pats])
    by_model = F.get(F.filter(names, lambda r: mn.contains(r["sub"])), F.lit(0))["name"]
    prefixes, others = _serial_tables()
    hits = [F.try_element_at(constant_map(table), F.substring(su, 1, length)) for length, table in sorted(prefixes.items())]
    if others:
        fits = F.filter(constant(others), lambda r: ((r["ends"] == 1) & su.endswith(r["pat"])) | ((r["ends"] == 0) & su.contains(r["pat"])))
        hits.append(F.get(fits, F.lit(0))["hit"])
    by_serial = F.array_min(F.array(*hits))["name"]
    return F.coalesce(F.when(mn != "", by_model), F.when(su != "", by_serial))


def infer_manufacturers(
    df: DataFrame,
    mfg: str = "w_mfg",
    model: str = "w_model",
    sn: str = "w_sn",
    cache: DataFrame | None = None,
    external: DataFrame | None = None,
    raw_mfg: str | None = None,
) -> DataFrame:
    """Fill blank manufacturers: given -> cache -> rules -> external answer.

    ``cache``: ``mfr_key STRING ('model|sn' lower-cased), manufacturer STRING``.
    ``external``: ``mfr_key, manufacturer`` consensus answers (C3); the
    "Unknown Manufacturer" answer is ignored. Adds ``mfg_source`` (given,
    cache, rules, external or null) and writes the value back into
    ``raw_mfg`` when that column exists.
    """
    blank = strip(col(mfg)) == ""
    if cache is None and external is None:  # one pass, nothing to join
        guess = F.when(blank, guess_manufacturer(model, sn))
        out = df.withColumns({"_mfr_guess": guess})
        upd = {mfg: F.coalesce("_mfr_guess", col(mfg)), "mfg_source": F.when(~blank, "given").when(F.col("_mfr_guess").isNotNull(), "rules")}
        if raw_mfg and raw_mfg in df.columns and raw_mfg != mfg:
            upd[raw_mfg] = F.coalesce("_mfr_guess", F.col(raw_mfg))
        return out.withColumns(upd).drop("_mfr_guess")
    # the given rows stay out of the joins; pass a written table, it is read twice
    known = df.where(~blank).withColumn("mfg_source", F.lit("given"))
    todo = df.where(blank).withColumn("_mfr_key", pipe_key(model, sn))
    if cache is not None:
        c = cache.select(F.col("mfr_key").alias("_mfr_key"), F.col("manufacturer").alias("_mfr_cached"))
        todo = todo.join(c, "_mfr_key", "left")
        has_cached = F.col("_mfr_cached").isNotNull()
    else:
        todo = todo.withColumn("_mfr_cached", F.lit(None).cast("string"))
        has_cached = F.lit(False)
    rule = guess_manufacturer(model, sn)
    guess = F.when(has_cached, F.col("_mfr_cached")).otherwise(rule)
    src = F.when(has_cached & (F.col("_mfr_cached") != ""), F.lit("cache")).when(
        ~has_cached & rule.isNotNull(), F.lit("rules")
    )
    todo = todo.withColumns({"_mfr_guess": F.when(guess != "", guess), "mfg_source": src})
    if external is not None:
        e = external.select(F.col("mfr_key").alias("_mfr_key"), F.col("manufacturer").alias("_mfr_ext"))
        e = e.where(F.col("_mfr_ext").isNotNull() & (F.col("_mfr_ext") != UNKNOWN_MANUFACTURER) & (F.col("_mfr_ext") != ""))
        todo = todo.join(e, "_mfr_key", "left")
        todo = todo.withColumns(
            {
                "mfg_source": F.when(F.col("_mfr_guess").isNull() & F.col("_mfr_ext").isNotNull(), F.lit("external")).otherwise(
                    F.col("mfg_source")
                ),
                "_mfr_guess": F.coalesce(F.col("_mfr_guess"), F.col("_mfr_ext")),
            }
        ).drop("_mfr_ext")
    new_mfg = F.coalesce(F.col("_mfr_guess"), col(mfg))
    upd = {mfg: new_mfg}
    if raw_mfg and raw_mfg in df.columns and raw_mfg != mfg:
        upd[raw_mfg] = F.when(F.col("_mfr_guess").isNotNull(), F.col("_mfr_guess")).otherwise(F.col(raw_mfg))
    todo = todo.withColumns(upd).drop("_mfr_key", "_mfr_cached", "_mfr_guess")
    return known.unionByName(todo)
