"""Serial-number date decode (section 2.8) by a table of rules.

A rule is a row: the keyword that the lower-cased manufacturer must contain
(and, if given, the text that the model must contain), a pattern of the serial,
the groups of the pattern that hold year, month and day, and how to read them.
The first keyword that occurs selects the rules; the first of these whose
pattern matches decodes (no fall-through to other keywords). The rows are one
constant array, which one expression interprets for every serial, so the plan
does not grow with the rules; a caller may pass other rows. The decoded year
must lie in 1950..horizon and pass the metadata year bounds (V1); month is then
clamped to 1..12 and day to 1..28.
"""

from __future__ import annotations

from itertools import groupby
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetclean.functions.constants import constant
from assetclean.functions.dates import HORIZON_YEAR, format_ymd, week_to_month
from assetclean.functions.text import bind, clean_key, col, strip, strip_paren_tag
from assetclean.operators.validate import metadata_entry, year_check

MIN_DECODE_YEAR = 1950


class Rule(NamedTuple):
    """``base`` is added to the year read from its group; group 0 means that
    the base is the year (month and day: 1). ``year_as``: number, short (0 to
    9 count from 2010, others from 2000) or letter (A is 1; 0 and 1 are read as
    O and I). ``month_as``: number, week, abc (A to C are 10 to 12), abc_or_one
    (so, other characters are 1) or letter (A is 1). A pattern with
    ``earliest`` only matches years from it to the horizon."""

    keyword: str
    pattern: str
    base: int = 0
    year: int = 0
    month: int = 0
    day: int = 0
    year_as: str = "number"
    month_as: str = "number"
    earliest: int = 0
    model: str = ""


# The decode rules, in match order.
DECODE_RULES: list[Rule] = [
    Rule("linet", r"^(\d{4})(\d{2})", 0, 1, 2),
    Rule("unico", r"(\d{4})(\d{2})(\d{2})", 0, 1, 2, 3),
    Rule("lab corp", r"^(\d{2})(\d{2})(\d{2})", 2000, 1, 2, 3),
    Rule("dacheng", r"(\d{4})(\d{2})(\d{2})", 0, 1, 2, 3),
    Rule("jiangmen", r"(\d{4})(\d{2})(\d{2})", 0, 1, 2, 3),
    Rule("edan", r"[A-Za-z](\d{2})([1-9|A-C|a-c])", 2000, 1, 2, month_as="abc"),
    Rule("mindray", r"(?s)^[^-]*-(\d)(.)", 2020, 1, 2, month_as="abc_or_one"),
    Rule("mindray", r"(?s)^(?!.*-)[a-zA-Z]*(\d)(.)", 2020, 1, 2, month_as="abc_or_one"),
    Rule("zoll", r"[A-Za-z]{1,2}(\d{1,2})([1-9|A-L|a-l])", 0, 1, 2, year_as="short", month_as="letter"),
    Rule("hill rom", r"(?s)^(?=(\d{2})?).*?(\d{4})$", 0, 2, 1, earliest=1990),
    Rule("hill rom", r"(?iu)^([a-z01])", 2000, 1, year_as="letter"),
    Rule("hillrom", r"(?s)^(?=(\d{2})?).*?(\d{4})$", 0, 2, 1, earliest=1990),
    Rule("hillrom", r"(?iu)^([a-z01])", 2000, 1, year_as="letter"),
    Rule("philips", r"^DE\D*(\d)", 2010, 1),
    Rule("philips", r"^(\d)", 2010, 1),
    Rule("ge healthcare", r"(?s)^.{3}(\d{2})(\d{2})", 2000, 1, 2, month_as="week"),
    Rule("american diagnostic", r"^(\d{2})(\d{2})", 2000, 1, 2, month_as="week"),
    Rule("american diagnostic", r"(?s)^.(\d{2})(\d{2})", 2000, 1, 2, month_as="week"),
    Rule("welch allyn", r"^(\d{4})", 0, 1, model="spot"),
    Rule("welch allyn", r"^0?7", 2007, model="suretemp"),
    Rule("welch allyn", r"^23", 2023, model="suretemp"),
    Rule("welch allyn", r"^24", 2024, model="suretemp"),
    Rule("welch allyn", r"^\p{L}(\d{2})", 2000, 1, model="suretemp"),
    Rule("welch allyn", r"^(\d{2})", 2000, 1, model="suretemp"),
    Rule("welch allyn", r"^\p{L}(\d{2})", 2000, 1),
    Rule("welch allyn", r"^(\d{2})", 2000, 1),
    Rule("arjo", r"^21", 2021),
    Rule("baxter", r"^37", 2017),
    Rule("baxter", r"^38", 2018),
    Rule("biosonic", r"^(\d{2})(\d{2})", 2000, 1, 2),
    Rule("cogentix", r"(?s)^.{2}(\d{2})(\d{2})", 2000, 1, 2, month_as="week"),
    Rule("covidien", r"(?s)^.{4}(\d{2})", 2000, 1),
    Rule("exergen", r"(?s)^.(\d{2})(\d{2})", 2000, 1, 2, month_as="week"),
    Rule("hospira", r"^17", 2017),
    Rule("masimo", r"^M19", 2019),
    Rule("olympus", r"^75", 2015),
    Rule("stryker", r"(?s)^(20[12].?)", 0, 1),
    Rule("stryker", r"^10", 2010),
    Rule("thermo scientific", r"^18", 2018),
]


def _constant(rules: list[Rule]) -> Column:
    """The rules as one constant: an array of (keyword, model, variants)."""
    sets = [(k, list(v)) for k, v in groupby(rules, key=lambda r: (r.keyword, r.model))]
    return constant([{"keyword": k, "model": m, "variants": [{n: v for n, v in r._asdict().items() if n not in ("keyword", "model")} for r in of]} for (k, m), of in sets])


def chosen_rules(mfg_l: Column, model_l: Column, rules: list[Rule] = DECODE_RULES) -> Column:
    """(keyword, model, variants) of the first keyword contained in the
    manufacturer, or null."""
    if not rules:
        return F.get(F.filter(_constant(DECODE_RULES), lambda r: F.lit(False)), F.lit(0))
    return F.get(F.filter(_constant(rules), lambda r: mfg_l.contains(r["keyword"]) & ((r["model"] == "") | model_l.contains(r["model"]))), F.lit(0))


def _group(sn: Column, rule: Column, which: str) -> Column:
    return F.call_function("regexp_extract", sn, rule["pattern"], rule[which])


def _year(sn: Column, rule: Column) -> Column:
    def read(text: Column) -> Column:
        return (
            F.when(rule["year_as"] == "letter", bind(F.upper(text), by_letter))
            .when(rule["year_as"] == "short", bind(text.try_cast("int"), lambda number: number + F.when(number < 10, 2010).otherwise(2000)))
            .otherwise(rule["base"] + text.try_cast("int"))
        )

    def by_letter(letter: Column) -> Column:
        letter = F.when(letter == "1", F.lit("I")).when(letter == "0", F.lit("O")).otherwise(letter)
        return F.when(letter.rlike("^[A-Z]$"), rule["base"] + F.ascii(letter) - 64)

    return F.when(rule["year"] == 0, rule["base"]).otherwise(bind(_group(sn, rule, "year"), read))


def _month(sn: Column, rule: Column) -> Column:
    def read(code: Column) -> Column:
        number, place = code.try_cast("int"), F.ascii(code) - 64
        abc = F.when(code.isin("A", "B", "C"), place + 9).otherwise(number)
        return (
            F.when(rule["month_as"] == "week", week_to_month(number))
            .when(rule["month_as"] == "abc", abc)
            .when(rule["month_as"] == "abc_or_one", F.coalesce(abc, F.lit(1)))
            .when(rule["month_as"] == "letter", F.coalesce(number, place))
            .otherwise(F.coalesce(number, F.lit(1)))  # a group that need not take part
        )

    return F.when(rule["month"] == 0, 1).otherwise(bind(F.upper(_group(sn, rule, "month")), read))


def matching_rule(chosen: Column, sn: Column, horizon: int = HORIZON_YEAR) -> Column:
    """The first variant whose pattern the serial matches, or null."""

    def fits(v: Column) -> Column:
        return F.call_function("rlike", sn, v["pattern"]) & ((v["earliest"] == 0) | _year(sn, v).between(v["earliest"], F.lit(horizon)))

    return F.get(F.filter(chosen["variants"], fits), F.lit(0))


def read_rule(rule: Column, sn: Column) -> Column:
    """struct(y, m, d) by a matching rule, before year checks (null = no parse)."""
    day = F.when(rule["day"] == 0, 1).otherwise(_group(sn, rule, "day").try_cast("int"))

    def found(month: Column) -> Column:
        parts = F.struct(_year(sn, rule).cast("int").alias("y"), month.cast("int").alias("m"), day.cast("int").alias("d"))
        return F.when(rule.isNotNull() & month.isNotNull(), parts)

    return bind(_month(sn, rule), found)


def raw_decode(mfg: str | Column, model: str | Column, sn: str | Column, horizon: int = HORIZON_YEAR, rules: list[Rule] = DECODE_RULES) -> Column:
    """struct(rule_id, found, founded_year, start_year): the keyword chosen, what
    the serial says (see :func:`read_rule`) and the metadata's year bounds. One
    expression, in which each step is computed once, wherever it is moved to."""
    names = F.struct(clean_key(mfg).alias("mfg"), clean_key(model).alias("model"), strip_paren_tag(strip(col(sn))).alias("sn"))

    def read(w: Column) -> Column:
        rule = lambda chosen: F.when(col(sn).isNotNull() & (col(sn) != ""), matching_rule(chosen, w["sn"], horizon))
        return bind(
            F.struct(chosen_rules(w["mfg"], w["model"], rules).alias("set"), metadata_entry(w["mfg"], w["model"]).alias("meta")),
            lambda c: F.struct(
                c["set"]["keyword"].alias("rule_id"),
                bind(rule(c["set"]), lambda r: read_rule(r, w["sn"])).alias("found"),
                c["meta"]["founded_year"].alias("founded_year"),
                c["meta"]["start_year"].alias("start_year"),
            ),
        )

    return bind(names, read)


def decode_serials(
    df: DataFrame,
    mfg: str = "mfg",
    model: str = "model",
    sn: str = "sn",
    horizon: int = HORIZON_YEAR,
    out: str = "decoded_date",
    keep_detail: bool = False,
    rules: list[Rule] = DECODE_RULES,
) -> DataFrame:
    """Add ``out`` (``YYYY-MM-DD`` or null) decoded from the serial.

    With ``keep_detail`` also ``rule_id, dec_year, dec_month, dec_day,
    is_valid, reason`` (validation details of the raw decode).
    """
    w = df.withColumn("_dc_raw", raw_decode(mfg, model, sn, horizon, rules)).withColumn("_dc", F.col("_dc_raw.found"))
    y = F.col("_dc.y")
    chk = year_check(y, F.col("_dc_raw.founded_year"), F.col("_dc_raw.start_year"), horizon)
    ok = y.between(MIN_DECODE_YEAR, horizon) & chk["is_valid"]
    m = F.greatest(F.lit(1), F.least(F.lit(12), F.col("_dc.m")))
    d = F.greatest(F.lit(1), F.least(F.lit(28), F.col("_dc.d")))
    w = w.withColumn(out, F.when(ok, format_ymd(y, m, d)))
    if keep_detail:
        w = w.withColumns(
            {
                "rule_id": F.col("_dc_raw.rule_id"),
                "dec_year": y,
                "dec_month": F.col("_dc.m"),
                "dec_day": F.col("_dc.d"),
                "is_valid": F.when(y.isNotNull(), chk["is_valid"]),
                "reason": F.when(y.isNotNull(), chk["reason"]),
            }
        )
    drop = [c for c in w.columns if c.startswith("_dc")]
    return w.drop(*drop)
