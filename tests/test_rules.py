"""Single-operator cases: decode, year bounds, manufacturer guesses, edit distance."""

from pyspark.sql import functions as F

from assetclean.operators.decode import decode_serials
from assetclean.operators.infer import guess_manufacturer
from assetclean.operators.validate import validate_years

DECODE_CASES = [
    ("LINET", "ELEGANZA 3", "20210147025", "2021-01-01"),
    ("Unico", "G380PL LED", "G38L-20141208", "2014-12-08"),
    ("LAB CORP.", "642E", "241013LB348", "2024-10-13"),
    ("Edan Instruments", "ELITEV5", "M19805320027", "2019-08-01"),
    ("Edan Instruments", "ELITEV5", "M19A05320027", "2019-10-01"),
    ("Mindray", "EPM12MA", "AH9-3C001824", "2023-12-01"),
    ("ZOLL Medical", "M SERIES", "T09B109955", "2019-02-01"),
    ("ZOLL Medical", "M SERIES", "T12L131022", "2012-12-01"),
    ("Hillrom", "CENTURY", "02R2981999", "1999-02-01"),
    ("HILL ROM", "CENTURYP1400", "L070HE0786", "2012-01-01"),
    ("PHILIPS", "MX500", "DE671R3701", "2016-01-01"),
    ("GE HEALTHCARE", "PATIENT DATA MODULE (PDM)", "SA315208552GA", "2015-05-01"),
    ("Welch Allyn", "SPOT VITAL SIGNS", "201507871", "2015-01-01"),
    ("Welch Allyn", "SURETEMPPLUS", "24519376", "2024-01-01"),
    ("ARJO INC.", "FLOWTRON", "2100053978", "2021-01-01"),
    ("BAXTER HEALTHCARE CORP.", "SPECTRUM IQ", "3757686", "2017-01-01"),
    ("BIOSONIC", "UC95D15", "131100008", "2013-11-01"),
    ("Cogentix Medical", "CST-4000", "CS1704F", "2017-01-01"),
    ("Covidien", "RAPIDVAC", "VL012301X", "2023-01-01"),
    ("Exergen", "TAT5000", "A1539272", "2015-09-01"),
    ("Olympus", "CV190", "7500545", "2015-01-01"),
    ("Stryker", "1115", "2017006701271", "2017-01-01"),
    ("THERMO SCIENTIFIC", "SMARTVUE915", "18175660D4C1", "2018-01-01"),
    ("Masimo", "RAD8", "M192824", "2019-01-01"),
    ("Masimo", "RAD8", "M852824", None),
    ("LINET", "ELEGANZA 3", "", None),
    ("Stryker", "1115", "201X0067", None),
    ("Edan Instruments", "ELITEV5", "M19|0532", None),
    ("Welch Allyn", "SPOT VITAL SIGNS", "A1507871", None),
    ("Unknown Corp", "X", "20210147025", None),
    ("Hillrom", "CENTURY", "(21) 02R2981999", "1999-02-01"),
]


def test_decode_cases(spark):
    df = spark.createDataFrame([(i,) + c[:3] for i, c in enumerate(DECODE_CASES)], "i int, mfg string, model string, sn string")
    got = {r.i: r.decoded_date for r in decode_serials(df).collect()}
    for i, c in enumerate(DECODE_CASES):
        assert got[i] == c[3], c


VALIDATION_CASES = [
    ("ZOLL Medical", "M SERIES", 2005, True, "Valid"),
    ("Philips", "INTELLIVUE MP50", 2010, True, "Valid"),
    ("LINET", "ELEGANZA 3", 2021, True, "Valid"),
    ("Welch Allyn", "FILAC3000", 2020, True, "Valid"),
    ("GE HEALTHCARE", "APEX PRO CH", 2014, True, "Valid"),
    ("Masimo", "RAD8", 1985, False, "founded"),
    ("ZOLL Medical", "X Series", 2005, False, "production"),
    ("Philips", "MX500", 2030, False, "future"),
    ("Unknown Corp", "Model X", 2015, True, "No metadata"),
    ("Unknown Corp", "Model X", 1849, False, "outside global"),
    ("Draeger", "APEX PRO CH", 1990, False, "founded"),
    ("Draeger", "anything", 1990, True, "No metadata"),
]


def test_year_bounds(spark):
    df = spark.createDataFrame([(i,) + c[:3] for i, c in enumerate(VALIDATION_CASES)], "i int, mfg string, model string, y int")
    got = {r.i: (r.is_valid, r.reason) for r in validate_years(df, "mfg", "model", "y").collect()}
    for i, c in enumerate(VALIDATION_CASES):
        assert got[i][0] == c[3], c
        assert c[4] in got[i][1], (c, got[i])


GUESS_CASES = [
    ("ELEGANZA 3", "20210147025", "Linet"),
    ("SPECTRUM IQ", "3757686", "Baxter Healthcare Corp."),
    ("FLOWTRON", "2100053978", "Arjo Inc."),
    ("RAPIDVAC", "VL012301X", "Covidien"),
    ("TAT5000", "A1539272", "Exergen"),
    ("FILAC3000", "A2053244X", "Welch Allyn"),
    ("INTELLIVUE MP50", "DE82061700", "Philips"),
    ("CV190", "7500545", "Olympus"),
    ("RAD8", "M192824", "Masimo"),
    ("CST-4000", "CS1704F", "Cogentix Medical"),
    ("", "AF23L173769", "ZOLL Medical"),
    ("", "DE82061700", "Philips"),
    ("", "WU202406267EN", "Jiangmen Dacheng"),
    ("", "SA315208552GA", "GE Healthcare"),
    ("", "VL012301X", "Covidien"),
    ("", "2100053978", "Arjo Inc."),
    ("", "3757686", "Baxter Healthcare Corp."),
    ("", "A1539272", "Exergen"),
    ("UNKNOWN MODEL XYZ", "ZZZ999999", None),
    ("", "M19805320027", "Masimo"),
]


def test_guess_manufacturer(spark):
    df = spark.createDataFrame([(i,) + c[:2] for i, c in enumerate(GUESS_CASES)], "i int, model string, sn string")
    got = {r.i: r.g for r in df.select("i", guess_manufacturer("model", "sn").alias("g")).collect()}
    for i, c in enumerate(GUESS_CASES):
        assert got[i] == c[2], c


def test_levenshtein_builtin(spark):
    pairs = [("rseries", "rseries", 0), ("spectrumiq", "spectrmiq", 1), ("f9express", "f9 express", 1), ("abc", "def", 3)]
    df = spark.createDataFrame(pairs, "a string, b string, d int")
    for r in df.select("d", F.levenshtein("a", "b").alias("g")).collect():
        assert r.d == r.g
