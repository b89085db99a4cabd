"""DuckDB oracle SQL for the registered queries.

An independent, set-based restatement of each operator in plain SQL (window
functions, joins, brute-force pair comparison), run by the driver on the same
parquet tables. The rule lists (manufacturer guesses, canonical keys, decode
keywords) and the metadata table are data and are rendered from the same
fixed values the library uses.
"""

from __future__ import annotations

from assetclean.operators.infer import MODEL_RULES, SERIAL_RULES
from assetclean.operators.validate import CANONICAL_RULES
from assetclean.sources.metadata import manufacturer_keys, metadata_rows
from assetclean.functions.text import PY_WHITESPACE
from assetclean.sources import testdata as td
from assetclean.plans import reports as R

WS = " || ".join(f"chr({ord(c)})" for c in PY_WHITESPACE)


def trimx(x: str) -> str:
    return f"trim({x}, {WS})"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def guess_sql(model: str, sn: str) -> str:
    mn = f"regexp_replace(lower({trimx(model)}), '\\s+', ' ', 'g')"
    su = f"upper({trimx(sn)})"
    arms = []
    for pats, name in MODEL_RULES:
        hit = " OR ".join(f"contains({mn}, {q(p)})" for p in pats)
        arms.append(f"WHEN {mn} <> '' AND ({hit}) THEN {q(name)}")
    for alts, name in SERIAL_RULES:
        tests = []
        for kind, p in alts:
            if kind == "prefix":
                tests.append(f"starts_with({su}, {q(p)})")
            elif kind == "suffix":
                tests.append(f"suffix({su}, {q(p)})")
            elif kind == "contains":
                tests.append(f"contains({su}, {q(p)})")
            else:
                tests.append(f"regexp_matches({su}, {q(p)})")
        arms.append(f"WHEN {su} <> '' AND ({' OR '.join(tests)}) THEN {q(name)}")
    return "CASE " + " ".join(arms) + " END"


def rules_sql(k: str) -> str:
    """The fixed rules for a lower-cased manufacturer name, null if none fits."""
    arms = " ".join(f"WHEN {' OR '.join(f"contains({k}, '{x}')" for x in subs)} THEN '{key}'" for subs, key in CANONICAL_RULES)
    return f"CASE {arms} END"


def canon_sql(mfg: str) -> str:
    k = f"lower({trimx(mfg)})"
    rules = list(CANONICAL_RULES) + [((key,), key) for key in manufacturer_keys()]
    arms = []
    for subs, key in rules:
        arms.append("WHEN " + " OR ".join(f"contains({k}, {q(s)})" for s in subs) + f" THEN {q(key)}")
    return f"CASE WHEN {mfg} IS NULL OR {mfg} = '' THEN NULL " + " ".join(arms) + " END"


def meta_values() -> str:
    vals = []
    for r in metadata_rows():
        src = "[" + ", ".join(q(s) for s in r[6]) + "]"
        vals.append(f"({r[0]}, {q(r[1])}, {r[2]}, {r[3]}, {q(r[4])}, {r[5]}, {src})")
    return (
        "SELECT * FROM (VALUES " + ", ".join(vals) + ") t(mfg_ord, mfg_key, founded_year, model_ord, model_key, product_start_year, sources)"
    )


def wk(w: str) -> str:
    return f"greatest(1, least(12, CAST(floor(({w}) * 7 / 30.4) AS INTEGER) + 1))"


def i(x: str) -> str:
    return f"TRY_CAST({x} AS INTEGER)"


def sl(sn: str, a: int, b: int) -> str:
    return f"substr({sn}, {a + 1}, {b - a})"


def dig(x: str) -> str:
    return f"regexp_matches({x}, '^[0-9]+$')"


def ymd(y: str, m: str = "1", d: str = "1") -> str:
    return f"{{'y': CAST({y} AS INTEGER), 'm': CAST({m} AS INTEGER), 'd': CAST({d} AS INTEGER)}}"


def decode_sql(rule: str, s: str, model: str) -> str:
    """struct(y, m, d) of the selected rule (NULL = no parse)."""
    rx = lambda p, g: f"regexp_extract({s}, {q(p)}, {g})"
    mt = lambda p: f"regexp_matches({s}, {q(p)})"
    edan_p = r"[A-Za-z](\d{2})([1-9|A-C|a-c])"
    edan_code = f"upper({rx(edan_p, 2)})"
    edan_m = f"CASE {edan_code} WHEN 'A' THEN 10 WHEN 'B' THEN 11 WHEN 'C' THEN 12 WHEN '|' THEN NULL ELSE {i(edan_code)} END"
    part = f"CASE WHEN contains({s}, '-') THEN regexp_extract({s}, '(?s)^[^-]*-(.*)$', 1) ELSE regexp_replace({s}, '^[a-zA-Z]+', '') END"
    mcode = f"upper(substr({part}, 2, 1))"
    mind_m = f"CASE {mcode} WHEN 'A' THEN 10 WHEN 'B' THEN 11 WHEN 'C' THEN 12 ELSE CASE WHEN regexp_matches({mcode}, '^[0-9]$') THEN {i(mcode)} ELSE 1 END END"
    zoll_p = r"[A-Za-z]{1,2}(\d{1,2})([1-9|A-L|a-l])"
    zy = i(rx(zoll_p, 1))
    zc = f"upper({rx(zoll_p, 2)})"
    y4 = i(rx(r"(\d{4})$", 1))
    fc = f"CASE upper(substr({s}, 1, 1)) WHEN '1' THEN 'I' WHEN '0' THEN 'O' ELSE upper(substr({s}, 1, 1)) END"
    after_de = rx(r"^DE\D*(\d)", 1)
    generic = (
        f"CASE WHEN {mt(r'^\p{L}')} AND length({s}) >= 3 AND {dig(sl(s, 1, 3))} THEN {ymd('2000 + ' + i(sl(s, 1, 3)))} "
        f"WHEN {mt(r'^\d{2}')} THEN {ymd('2000 + ' + i(sl(s, 0, 2)))} END"
    )
    pre = lambda pairs: "CASE " + " ".join(f"WHEN starts_with({s}, {q(p)}) THEN {ymd(str(y))}" for p, y in pairs) + " END"
    ymd8 = r"(\d{4})(\d{2})(\d{2})"
    lab = r"^(\d{2})(\d{2})(\d{2})"
    rules = {
        "linet": f"CASE WHEN {mt(r'^\d{6}')} THEN {ymd(i(sl(s, 0, 4)), i(sl(s, 4, 6)))} END",
        "ymd8": f"CASE WHEN {mt(ymd8)} THEN {ymd(i(rx(ymd8, 1)), i(rx(ymd8, 2)), i(rx(ymd8, 3)))} END",
        "lab corp": f"CASE WHEN {mt(lab)} THEN {ymd('2000 + ' + i(rx(lab, 1)), i(rx(lab, 2)), i(rx(lab, 3)))} END",
        "edan": f"CASE WHEN {mt(edan_p)} AND ({edan_m}) IS NOT NULL THEN {ymd('2000 + ' + i(rx(edan_p, 1)), edan_m)} END",
        "mindray": f"CASE WHEN length({part}) >= 2 AND regexp_matches(substr({part}, 1, 1), '^[0-9]$') THEN {ymd('2020 + ' + i(f'substr({part}, 1, 1)'), mind_m)} END",
        "zoll": f"CASE WHEN {mt(zoll_p)} THEN {ymd(f'CASE WHEN {zy} < 10 THEN 2010 + {zy} ELSE 2000 + {zy} END', f'CASE WHEN regexp_matches({zc}, {q(chr(94) + "[0-9]$")}) THEN {i(zc)} ELSE ascii({zc}) - 64 END')} END",
        "hillrom": f"CASE WHEN {y4} BETWEEN 1990 AND 2026 THEN {ymd(y4, f'CASE WHEN {mt(chr(94) + chr(92) + "d{2}")} THEN {i(sl(s, 0, 2))} ELSE 1 END')} "
        f"WHEN regexp_matches({fc}, '^[A-Z]$') THEN {ymd(f'2000 + ascii({fc}) - 64')} END",
        "philips": f"CASE WHEN starts_with({s}, 'DE') THEN CASE WHEN {after_de} <> '' THEN {ymd('2010 + ' + i(after_de))} END "
        f"WHEN {mt(r'^\d')} THEN {ymd('2010 + ' + i(f'substr({s}, 1, 1)'))} END",
        "ge healthcare": f"CASE WHEN length({s}) >= 7 AND {dig(sl(s, 3, 5))} AND {dig(sl(s, 5, 7))} THEN {ymd('2000 + ' + i(sl(s, 3, 5)), wk(i(sl(s, 5, 7))))} END",
        "american diagnostic": f"CASE WHEN {mt(r'^\d{4}')} THEN {ymd('2000 + ' + i(sl(s, 0, 2)), wk(i(sl(s, 2, 4))))} "
        f"WHEN length({s}) >= 5 AND {dig(sl(s, 1, 3))} AND {dig(sl(s, 3, 5))} THEN {ymd('2000 + ' + i(sl(s, 1, 3)), wk(i(sl(s, 3, 5))))} END",
        "welch allyn": f"CASE WHEN {s} = '' THEN NULL WHEN contains({model}, 'spot') THEN CASE WHEN {mt(r'^\d{4}')} THEN {ymd(i(sl(s, 0, 4)))} END "
        f"WHEN contains({model}, 'suretemp') THEN CASE WHEN starts_with({s}, '7') OR starts_with({s}, '07') THEN {ymd('2007')} "
        f"WHEN starts_with({s}, '23') THEN {ymd('2023')} WHEN starts_with({s}, '24') THEN {ymd('2024')} ELSE {generic} END ELSE {generic} END",
        "arjo": pre([("21", 2021)]),
        "baxter": pre([("37", 2017), ("38", 2018)]),
        "biosonic": f"CASE WHEN {mt(r'^\d{4}')} THEN {ymd('2000 + ' + i(sl(s, 0, 2)), i(sl(s, 2, 4)))} END",
        "cogentix": f"CASE WHEN length({s}) >= 6 AND {dig(sl(s, 2, 4))} AND {dig(sl(s, 4, 6))} THEN {ymd('2000 + ' + i(sl(s, 2, 4)), wk(i(sl(s, 4, 6))))} END",
        "covidien": f"CASE WHEN length({s}) >= 6 AND {dig(sl(s, 4, 6))} THEN {ymd('2000 + ' + i(sl(s, 4, 6)))} END",
        "exergen": f"CASE WHEN length({s}) >= 5 AND {dig(sl(s, 1, 3))} AND {dig(sl(s, 3, 5))} THEN {ymd('2000 + ' + i(sl(s, 1, 3)), wk(i(sl(s, 3, 5))))} END",
        "hospira": pre([("17", 2017)]),
        "masimo": pre([("M19", 2019)]),
        "olympus": pre([("75", 2015)]),
        "stryker": f"CASE WHEN starts_with({s}, '201') OR starts_with({s}, '202') THEN {ymd(i(sl(s, 0, 4)))} WHEN starts_with({s}, '10') THEN {ymd('2010')} END",
        "thermo scientific": pre([("18", 2018)]),
    }
    order = [
        ("linet", "linet"), ("unico", "ymd8"), ("lab corp", "lab corp"), ("dacheng", "ymd8"), ("jiangmen", "ymd8"),
        ("edan", "edan"), ("mindray", "mindray"), ("zoll", "zoll"), ("hill rom", "hillrom"), ("hillrom", "hillrom"),
        ("philips", "philips"), ("ge healthcare", "ge healthcare"), ("american diagnostic", "american diagnostic"),
        ("welch allyn", "welch allyn"), ("arjo", "arjo"), ("baxter", "baxter"), ("biosonic", "biosonic"),
        ("cogentix", "cogentix"), ("covidien", "covidien"), ("exergen", "exergen"), ("hospira", "hospira"),
        ("masimo", "masimo"), ("olympus", "olympus"), ("stryker", "stryker"), ("thermo scientific", "thermo scientific"),
    ]
    return "CASE " + " ".join(f"WHEN {rule} = {q(kw)} THEN {rules[fn]}" for kw, fn in order) + " END"


def rule_sql(mfg_l: str) -> str:
    kws = ["linet", "unico", "lab corp", "dacheng", "jiangmen", "edan", "mindray", "zoll", "hill rom", "hillrom", "philips",
           "ge healthcare", "american diagnostic", "welch allyn", "arjo", "baxter", "biosonic", "cogentix", "covidien",
           "exergen", "hospira", "masimo", "olympus", "stryker", "thermo scientific"]
    return "CASE " + " ".join(f"WHEN contains({mfg_l}, {q(k)}) THEN {q(k)}" for k in kws) + " END"


def lookup_ctes(name: str, src: str, mfg: str, model: str) -> str:
    """``{name}``: src rows + meta_mfg_key, meta_founded_year, meta_start_year, meta_sources."""
    mnorm = f"regexp_replace(lower({trimx(model)}), '\\s+', ' ', 'g')"
    return f"""
{name}_k AS (SELECT *, {canon_sql(mfg)} AS _canon, {mnorm} AS _mnorm FROM {src}),
{name}_best AS (
  SELECT k._canon, k._mnorm, m.mfg_key, m.founded_year, m.product_start_year, m.sources FROM
  (SELECT DISTINCT _canon, _mnorm FROM {name}_k WHERE _canon IS NOT NULL) k JOIN meta m
    ON k._canon = m.mfg_key AND (k._mnorm = m.model_key OR contains(k._mnorm, m.model_key) OR contains(m.model_key, k._mnorm))
  QUALIFY row_number() OVER (PARTITION BY k._canon, k._mnorm ORDER BY CASE WHEN k._mnorm = m.model_key THEN -1 ELSE m.model_ord END) = 1),
{name} AS (SELECT k.* EXCLUDE (_canon, _mnorm), b.mfg_key AS meta_mfg_key, b.founded_year AS meta_founded_year,
  b.product_start_year AS meta_start_year, b.sources AS meta_sources
  FROM {name}_k k LEFT JOIN {name}_best b ON k._canon = b._canon AND k._mnorm = b._mnorm)"""


def valid_sql(y: str, f: str, st: str) -> str:
    return f"CASE WHEN {f} IS NULL THEN ({y} >= 1850 AND {y} <= 2026) ELSE ({y} >= {f} AND {y} >= {st} AND {y} <= 2026) END"


def reason_sql(y: str, f: str, st: str) -> str:
    return (
        f"CASE WHEN {f} IS NULL AND ({y} < 1850 OR {y} > 2026) THEN printf('Year %d is outside global historical boundaries (1850-2026).', {y}) "
        f"WHEN {f} IS NULL THEN 'No metadata available for this model/manufacturer; passed default sanity check.' "
        f"WHEN {y} < {f} THEN printf('Year %d is invalid because the manufacturer was founded later in %d.', {y}, {f}) "
        f"WHEN {y} < {st} THEN printf('Year %d is invalid because the product did not begin production until %d.', {y}, {st}) "
        f"WHEN {y} > 2026 THEN printf('Year %d is in the future relative to the dataset context (max 2026).', {y}) ELSE 'Valid' END"
    )


def decode_ctes(name: str, src: str) -> str:
    """``{name}``: src rows (with w_mfg, w_model, w_sn) + rule_id, dec_*, decoded_date, meta_*."""
    s = f"regexp_replace({trimx('w_sn')}, '^\\(\\d+\\)\\s*', '')"
    ml = f"lower({trimx('w_model')})"
    fl = f"lower({trimx('w_mfg')})"
    return f"""
{name}_r AS (SELECT *, {rule_sql(fl)} AS rule_id, {s} AS _s, {ml} AS _ml, {fl} AS _fl FROM {src}),
{name}_d AS (SELECT *, CASE WHEN w_sn IS NOT NULL AND w_sn <> '' THEN {decode_sql('rule_id', '_s', '_ml')} END AS _dc FROM {name}_r),
{lookup_ctes(name + '_m', name + '_d', '_fl', '_ml')},
{name} AS (SELECT * EXCLUDE (_dc, _s, _ml, _fl), _dc.y AS dec_year, _dc.m AS dec_month, _dc.d AS dec_day,
  CASE WHEN _dc.y BETWEEN 1950 AND 2026 AND {valid_sql('_dc.y', 'meta_founded_year', 'meta_start_year')}
       THEN printf('%04d-%02d-%02d', _dc.y, greatest(1, least(12, _dc.m)), greatest(1, least(28, _dc.d))) END AS decoded_date
  FROM {name}_m)"""


def normalize_sql(x: str) -> str:
    s = trimx(x)
    p = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})"
    y = f"TRY_CAST(regexp_extract({s}, '{p}', 1) AS INTEGER)"
    m = f"TRY_CAST(regexp_extract({s}, '{p}', 2) AS INTEGER)"
    d = f"TRY_CAST(regexp_extract({s}, '{p}', 3) AS INTEGER)"
    y2 = f"CASE WHEN {y} < 1800 OR {y} > 2026 THEN 1900 ELSE {y} END"
    m1 = f"CASE WHEN {m} BETWEEN 13 AND 53 THEN {wk(m)} ELSE {m} END"
    m2 = f"CASE WHEN ({m1}) < 1 OR ({m1}) > 12 THEN 1 ELSE ({m1}) END"
    d2 = f"CASE WHEN {d} < 1 OR {d} > 28 THEN 1 ELSE {d} END"
    fy = f"regexp_extract({x}, '\\b((?:18|19|20)\\d{{2}})\\b', 1)"
    return (
        f"CASE WHEN {x} IS NULL OR {x} = '' THEN '1900-01-01' "
        f"WHEN regexp_matches({s}, '{p}') THEN printf('%04d-%02d-%02d', {y2}, {m2}, {d2}) "
        f"WHEN {fy} <> '' THEN {fy} || '-01-01' ELSE '1900-01-01' END"
    )


GUESS = guess_sql("w_model", "w_sn")

BASE_T = f""",
meta AS ({meta_values()}),
rows0 AS (SELECT *, {trimx("coalesce(manufacturer, '')")} AS w_mfg, {trimx("coalesce(model, '')")} AS w_model,
          {trimx("coalesce(serial_number, '')")} AS w_sn FROM inventory),
dedup AS (SELECT * FROM rows0 QUALIFY row_number() OVER (PARTITION BY lower(w_mfg), lower(w_model), lower(w_sn) ORDER BY _ord) = 1),
{{INFER}}g AS (SELECT *, lower({trimx('w_mfg')}) AS g_mfg, lower({trimx('w_model')}) AS g_model FROM inferred),
groups AS (SELECT g_mfg, g_model, count(*) AS n_rows, min(_ord) AS first_ord, arg_min(w_model, _ord) AS orig_model FROM g GROUP BY g_mfg, g_model),
mfgs AS (SELECT g_mfg, min(_ord) AS mfg_ord, arg_min(w_mfg, _ord) AS orig_mfg FROM g GROUP BY g_mfg),
grp AS (SELECT gr.*, m.mfg_ord, m.orig_mfg FROM groups gr JOIN mfgs m USING (g_mfg)),
gk AS (SELECT * FROM (SELECT *, regexp_replace(g_model, '[^a-z0-9]', '', 'g') AS norm_key FROM grp) t WHERE norm_key <> ''),
m1r AS (SELECT *, row_number() OVER (PARTITION BY g_mfg, norm_key ORDER BY n_rows DESC, first_ord) AS rn,
               min(first_ord) OVER (PARTITION BY g_mfg, norm_key) AS npos,
               count(*) OVER (PARTITION BY g_mfg, norm_key) AS nvar FROM gk),
m1 AS (SELECT r.g_mfg, r.g_model, r.orig_model AS original, d.orig_model AS corrected, r.orig_mfg AS manufacturer, 'spacing' AS kind,
   CAST(NULL AS INTEGER) AS distance,
   printf('Standardized model spelling ''%s'' to match dominant variant ''%s'' for manufacturer ''%s''', r.orig_model, d.orig_model, r.orig_mfg) AS reason,
   1 AS phase, [CAST(r.mfg_ord AS BIGINT), 1, r.npos, r.rn] AS lp
   FROM m1r r JOIN m1r d ON r.g_mfg = d.g_mfg AND r.norm_key = d.norm_key AND d.rn = 1 WHERE r.nvar > 1 AND r.rn > 1),
keys AS (SELECT g_mfg, norm_key, sum(n_rows) AS cnt, min(first_ord) AS pos, arg_min(orig_model, first_ord) AS first_variant FROM gk GROUP BY g_mfg, norm_key),
pairs AS (SELECT s.g_mfg, s.norm_key AS s_key, b.first_variant AS target, CAST(levenshtein(s.norm_key, b.norm_key) AS INTEGER) AS dist,
   least(s.pos, b.pos) AS pi, greatest(s.pos, b.pos) AS pj
   FROM keys s JOIN keys b ON s.g_mfg = b.g_mfg WHERE s.cnt <= 2 AND b.cnt >= 5 AND levenshtein(s.norm_key, b.norm_key) BETWEEN 1 AND 2),
best AS (SELECT *, min(pi) OVER (PARTITION BY g_mfg, s_key) AS first_i FROM pairs QUALIFY row_number() OVER (PARTITION BY g_mfg, s_key ORDER BY pi DESC, pj DESC) = 1),
m2 AS (SELECT k.g_mfg, k.g_model, k.orig_model AS original, b.target AS corrected, k.orig_mfg AS manufacturer, 'typo' AS kind, b.dist AS distance,
   printf('Corrected spelling typo ''%s'' to dominant model ''%s'' for manufacturer ''%s'' (Levenshtein distance: %d)', k.orig_model, b.target, k.orig_mfg, b.dist) AS reason,
   2 AS phase, [CAST(k.mfg_ord AS BIGINT), 2, b.first_i, k.first_ord] AS lp
   FROM best b JOIN gk k ON k.g_mfg = b.g_mfg AND k.norm_key = b.s_key),
mc AS (SELECT * EXCLUDE (phase) REPLACE (min(lp) OVER (PARTITION BY g_mfg, g_model) AS lp) FROM (SELECT * FROM m1 UNION ALL SELECT * FROM m2) u
   QUALIFY row_number() OVER (PARTITION BY g_mfg, g_model ORDER BY phase DESC) = 1),
r2 AS (SELECT *, upper(regexp_extract(clean, '^([A-Za-z]+)', 1)) AS prefix, regexp_matches(sn, '^\\(\\d+\\)') AS paren, length(clean) AS len
   FROM (SELECT g_mfg, g_model, _ord AS o, w_sn AS sn, regexp_replace(w_sn, '^\\(\\d+\\)\\s*', '') AS clean FROM g WHERE w_sn <> '') t),
gs AS (SELECT g_mfg, g_model, count(*) AS n, sum(CAST(paren AS INTEGER)) AS pc FROM r2 GROUP BY g_mfg, g_model),
ps AS (SELECT g_mfg, g_model, prefix AS dom_prefix, c AS dom_cnt FROM
   (SELECT g_mfg, g_model, prefix, count(*) AS c, min(o) AS mo FROM r2 WHERE prefix <> '' GROUP BY g_mfg, g_model, prefix) t
   QUALIFY row_number() OVER (PARTITION BY g_mfg, g_model ORDER BY c DESC, mo) = 1),
ls AS (SELECT g_mfg, g_model, len AS dom_len, c AS dom_len_cnt FROM
   (SELECT g_mfg, g_model, len, count(*) AS c, min(o) AS mo FROM r2 GROUP BY g_mfg, g_model, len) t
   QUALIFY row_number() OVER (PARTITION BY g_mfg, g_model ORDER BY c DESC, mo) = 1),
st AS (SELECT gs.*, ps.dom_prefix, ps.dom_cnt, ls.dom_len, ls.dom_len_cnt, grp.orig_mfg, grp.orig_model, grp.mfg_ord, grp.first_ord
   FROM gs LEFT JOIN ps USING (g_mfg, g_model) LEFT JOIN ls USING (g_mfg, g_model) JOIN grp USING (g_mfg, g_model) WHERE gs.n >= 3),
ents AS (
   SELECT r2.sn, r2.o, 1 AS rnk, 'prefix' AS kind, regexp_extract(r2.sn, '^(\\(\\d+\\)\\s*)', 1) || st.dom_prefix || r2.clean AS corrected,
     printf('Prepended missing dominant prefix ''%s'' to serial ''%s'' to match dominant format under ''%s'' (model: ''%s'')', st.dom_prefix, r2.sn, st.orig_mfg, st.orig_model) AS reason,
     st.orig_mfg, st.orig_model, st.mfg_ord, st.first_ord
   FROM r2 JOIN st USING (g_mfg, g_model)
   WHERE st.dom_prefix IS NOT NULL AND CAST(st.dom_cnt AS DOUBLE) / st.n >= 0.6 AND NOT starts_with(upper(r2.clean), st.dom_prefix)
   UNION ALL
   SELECT r2.sn, r2.o, 2, 'paren', r2.clean,
     printf('Stripped unexpected prefix ''%s'' from serial ''%s'' for manufacturer ''%s''', regexp_extract(r2.sn, '^(\\(\\d+\\))', 1), r2.sn, st.orig_mfg),
     st.orig_mfg, st.orig_model, st.mfg_ord, st.first_ord
   FROM r2 JOIN st USING (g_mfg, g_model) WHERE st.pc > 0 AND st.pc <= 2 AND st.n - st.pc >= 3 AND r2.paren
   UNION ALL
   SELECT r2.sn, r2.o, 3, 'length', r2.sn,
     printf('Serial length mismatch (%d chars vs dominant length of %d chars) for ''%s'' (model: ''%s'')', r2.len, st.dom_len, st.orig_mfg, st.orig_model),
     st.orig_mfg, st.orig_model, st.mfg_ord, st.first_ord
   FROM r2 JOIN st USING (g_mfg, g_model) WHERE CAST(st.dom_len_cnt AS DOUBLE) / st.n >= 0.7 AND r2.len <> st.dom_len),
sc AS (SELECT sn, corrected, orig_mfg AS manufacturer, orig_model AS model, kind, reason,
   min([CAST(mfg_ord AS BIGINT), first_ord, rnk, o]) OVER (PARTITION BY sn) AS lp FROM ents
   QUALIFY row_number() OVER (PARTITION BY sn ORDER BY (rnk < 3) DESC,
     CASE WHEN rnk < 3 THEN mfg_ord ELSE -mfg_ord END DESC, CASE WHEN rnk < 3 THEN first_ord ELSE -first_ord END DESC, rnk DESC) = 1),
fx1 AS (SELECT g.*, mc.corrected AS _mc FROM g LEFT JOIN mc USING (g_mfg, g_model)),
fixed AS (SELECT f._ord, f.manufacturer, coalesce(f._mc, f.model) AS model, coalesce(sc.corrected, f.serial_number) AS serial_number, f.site,
   f.w_mfg, coalesce(f._mc, f.w_model) AS w_model, coalesce(sc.corrected, f.w_sn) AS w_sn, f.w_sn_orig, f.mfg_source,
   lower(f.w_mfg) || '|' || lower(coalesce(f._mc, f.w_model)) AS type_key,
   lower(f.w_mfg) || '|' || lower(coalesce(f._mc, f.w_model)) || '|' || lower(coalesce(sc.corrected, f.w_sn)) AS date_key
   FROM fx1 f LEFT JOIN sc ON f.w_sn_orig = sc.sn AND f.w_sn_orig <> ''),
{decode_ctes('dd', 'dedup')},
{decode_ctes('fd', 'fixed')},
fd1 AS (SELECT fd.* REPLACE (coalesce(c.first_dec, fd.decoded_date) AS decoded_date) FROM fd LEFT JOIN
   (SELECT date_key, arg_min(decoded_date, CASE WHEN decoded_date IS NOT NULL THEN _ord END) AS first_dec FROM fd GROUP BY date_key HAVING count(*) > 1) c
   USING (date_key)),
rd AS (SELECT fd1.*, dc.date AS _c_date, dc.confidence AS _c_conf FROM fd1 LEFT JOIN
   (SELECT date_key, {normalize_sql('date')} AS date, coalesce(confidence, 1.0) AS confidence FROM date_cache) dc USING (date_key))
"""

INFER_RULES = f"""inf0r AS (SELECT d.*, {GUESS} AS _rule FROM dedup d),
inferred AS (SELECT _ord, CASE WHEN w_mfg = '' AND _rule IS NOT NULL THEN _rule ELSE manufacturer END AS manufacturer,
   model, serial_number, site,
   CASE WHEN w_mfg = '' THEN coalesce(_rule, w_mfg) ELSE w_mfg END AS w_mfg, w_model, w_sn, w_sn AS w_sn_orig,
   CASE WHEN w_mfg <> '' THEN 'given' WHEN _rule IS NOT NULL THEN 'rules' END AS mfg_source
 FROM inf0r),
"""

INFER_FULL = f"""inf0 AS (SELECT d.*, c.manufacturer AS _cached, c.manufacturer IS NOT NULL AS _has_c, {GUESS} AS _rule
   FROM dedup d LEFT JOIN mfr_cache c ON d.w_mfg = '' AND c.mfr_key = lower(d.w_model) || '|' || lower(d.w_sn)),
mx AS (SELECT mfr_key, coalesce(CASE WHEN coalesce(bool_or(resolver = 'primary'), false) THEN max(CASE WHEN resolver = 'primary' THEN manufacturer END)
   ELSE max(CASE WHEN resolver = 'secondary' THEN manufacturer END) END, 'Unknown Manufacturer') AS ext FROM mfr_answers GROUP BY mfr_key),
inf1 AS (SELECT i.*, CASE WHEN CASE WHEN _has_c THEN _cached ELSE _rule END <> '' THEN CASE WHEN _has_c THEN _cached ELSE _rule END END AS _g2 FROM inf0 i),
inf2 AS (SELECT i.*, m.ext FROM inf1 i LEFT JOIN mx m ON i.w_mfg = '' AND m.mfr_key = lower(i.w_model) || '|' || lower(i.w_sn)
   AND m.ext <> 'Unknown Manufacturer' AND m.ext <> ''),
inferred AS (SELECT _ord,
   CASE WHEN w_mfg = '' AND coalesce(_g2, ext) IS NOT NULL THEN coalesce(_g2, ext) ELSE manufacturer END AS manufacturer,
   model, serial_number, site,
   CASE WHEN w_mfg = '' THEN coalesce(_g2, ext, w_mfg) ELSE w_mfg END AS w_mfg, w_model, w_sn, w_sn AS w_sn_orig,
   CASE WHEN w_mfg <> '' THEN 'given' WHEN _g2 IS NULL AND ext IS NOT NULL THEN 'external'
        WHEN _has_c AND _cached <> '' THEN 'cache' WHEN NOT _has_c AND _rule IS NOT NULL THEN 'rules' END AS mfg_source
 FROM inf2),
"""

BASE = BASE_T.replace("{INFER}", INFER_RULES)
FULL = BASE_T.replace("{INFER}", INFER_FULL)

YEAR_IN_SN = "regexp_extract(w_sn, '\\b((?:18|19|20)\\d{2})\\b', 1)"


def _sql(body: str) -> str:
    return td.inventory_cte() + BASE + body


ORACLE_SQL: dict[str, str] = {
    "dedup_first": _sql("SELECT _ord, manufacturer, model, serial_number FROM dedup"),
    "infer_manufacturer": _sql(f"SELECT _ord, model, serial_number, {GUESS} AS guessed FROM dedup WHERE w_mfg = ''"),
    "model_corrections": _sql("SELECT g_mfg, g_model, original, corrected, manufacturer, kind, distance, reason FROM mc"),
    "serial_corrections": _sql("SELECT sn, corrected, manufacturer, model, kind, reason FROM sc"),
    "apply_corrections": _sql(
        "SELECT _ord, manufacturer, model, serial_number, w_mfg AS mfg, w_model AS model_fixed, w_sn AS sn_fixed FROM fixed"
    ),
    "decode_serials": _sql("SELECT _ord, rule_id, dec_year, dec_month, dec_day, decoded_date FROM dd"),
    "decode_by_year": _sql(
        f"""SELECT substr(coalesce(d.first_dec, CASE WHEN {YEAR_IN_SN} <> '' THEN {YEAR_IN_SN} || '-01-01' END, '1900-01-01'), 1, 4) AS year,
        count(*) AS devices FROM (SELECT x.*, coalesce(c.first_dec, x.decoded_date) AS first_dec FROM
        (SELECT *, lower(w_mfg) || '|' || lower(w_model) || '|' || lower(w_sn) AS date_key FROM dd) x LEFT JOIN
        (SELECT lower(w_mfg) || '|' || lower(w_model) || '|' || lower(w_sn) AS date_key,
                arg_min(decoded_date, CASE WHEN decoded_date IS NOT NULL THEN _ord END) AS first_dec
         FROM dd GROUP BY 1 HAVING count(*) > 1) c USING (date_key)) d GROUP BY 1"""
    ),
    "validate_years": _sql(
        f"""SELECT _ord, dec_year, meta_mfg_key, meta_founded_year, meta_start_year,
        {valid_sql('dec_year', 'meta_founded_year', 'meta_start_year')} AS is_valid,
        {reason_sql('dec_year', 'meta_founded_year', 'meta_start_year')} AS reason FROM dd WHERE dec_year IS NOT NULL"""
    ),
    "normalize_dates": _sql(f"SELECT _ord, raw, {normalize_sql('raw')} AS normalized FROM ({td.NOISY_DATES_SQL}) nd"),
    "resolve_types": _sql(
        """SELECT f._ord, f.type_key, coalesce(t.device_type, 'Medical Device') AS device_type, coalesce(t.probable_typo, false) AS probable_typo,
        CASE WHEN t.type_key IS NOT NULL THEN coalesce(t.confidence, 1.0) ELSE 0.1 END AS type_confidence,
        CASE WHEN t.type_key IS NOT NULL THEN 'cache' ELSE 'default' END AS type_source
        FROM fixed f LEFT JOIN type_cache t USING (type_key)"""
    ),
    "unresolved_types": _sql(
        """SELECT type_key, arg_max(w_mfg, _ord) AS manufacturer, arg_max(w_model, _ord) AS model FROM fixed
        WHERE type_key NOT IN (SELECT type_key FROM type_cache) GROUP BY type_key"""
    ),
    "resolve_dates": _sql(
        f"""SELECT _ord, date_key,
        coalesce(CASE WHEN _c_conf IS NOT NULL THEN _c_date WHEN decoded_date IS NOT NULL THEN decoded_date END,
                 CASE WHEN {YEAR_IN_SN} <> '' THEN {YEAR_IN_SN} || '-01-01' END, '1900-01-01') AS manufactured_date,
        coalesce(CASE WHEN _c_conf IS NOT NULL THEN 'cache' WHEN decoded_date IS NOT NULL THEN 'decode' END,
                 CASE WHEN {YEAR_IN_SN} <> '' THEN 'serial_year' END, 'unknown') AS date_source,
        CASE WHEN _c_conf IS NOT NULL THEN _c_conf WHEN decoded_date IS NOT NULL THEN 1.0 END AS date_confidence
        FROM rd"""
    ),
    "apply_overrides": _sql(
        f"""SELECT coalesce(t.type_key, o.type_key) AS type_key, coalesce(o.device_type, t.device_type) AS device_type,
        coalesce(t.probable_typo, false) AS probable_typo, t.confidence
        FROM type_cache t FULL OUTER JOIN
        (SELECT lower({trimx('key')}) AS type_key, arg_max(device_type, seq) AS device_type FROM type_overrides GROUP BY 1) o USING (type_key)"""
    ),
    "rules_table": _sql(
        """SELECT type_key, split_part(type_key, '|', 1) AS manufacturer,
        CASE WHEN strpos(type_key, '|') > 0 THEN substr(type_key, strpos(type_key, '|') + 1) ELSE '' END AS model,
        device_type, probable_typo, confidence FROM type_cache"""
    ),
    "profile_groups": _sql(
        """SELECT manufacturer, model, count(*) AS total,
        string_agg(CASE WHEN rf <= 10 THEN serial_number END, ',' ORDER BY _ord) AS first_serials,
        string_agg(CASE WHEN rl <= 10 THEN serial_number END, ',' ORDER BY _ord) AS last_serials
        FROM (SELECT *, row_number() OVER (PARTITION BY manufacturer, model ORDER BY _ord) AS rf,
                        row_number() OVER (PARTITION BY manufacturer, model ORDER BY _ord DESC) AS rl FROM inventory) t
        GROUP BY manufacturer, model"""
    ),
}

ORACLE_SQL["consensus_types"] = td.inventory_cte() + BASE + """,
ut AS (SELECT DISTINCT type_key FROM fixed WHERE type_key NOT IN (SELECT type_key FROM type_cache)),
ta AS (SELECT type_key, bool_or(resolver = 'primary') AS has_p, bool_or(resolver = 'secondary') AS has_s,
   max(CASE WHEN resolver = 'primary' THEN device_type END) AS p_type, bool_or(CASE WHEN resolver = 'primary' THEN probable_typo END) AS p_typo,
   max(CASE WHEN resolver = 'secondary' THEN device_type END) AS s_type, bool_or(CASE WHEN resolver = 'secondary' THEN probable_typo END) AS s_typo
   FROM type_answers GROUP BY type_key),
j AS (SELECT ut.type_key, coalesce(has_p, false) AS hp, coalesce(has_s, false) AS hs, p_type, p_typo, s_type, s_typo FROM ut LEFT JOIN ta USING (type_key))
SELECT type_key,
  coalesce(CASE WHEN hp THEN p_type WHEN hs THEN s_type END, 'Medical Device') AS device_type,
  coalesce(CASE WHEN hp THEN p_typo WHEN hs THEN s_typo END, false) AS probable_typo,
  CAST(CASE WHEN NOT hp AND NOT hs THEN 0.1 WHEN NOT hp OR NOT hs THEN 0.5
       WHEN p_type IS NOT DISTINCT FROM s_type AND p_typo IS NOT DISTINCT FROM s_typo THEN 0.95 ELSE 0.6 END AS DOUBLE) AS confidence
FROM j"""

ORACLE_SQL["consensus_mfr"] = td.inventory_cte() + BASE + f""",
blank AS (SELECT d.*, c.manufacturer AS cached FROM dedup d LEFT JOIN mfr_cache c ON c.mfr_key = lower(d.w_model) || '|' || lower(d.w_sn)
   WHERE d.w_mfg = ''),
still AS (SELECT DISTINCT lower(w_model) || '|' || lower(w_sn) AS mfr_key FROM blank
   WHERE coalesce(CASE WHEN cached IS NOT NULL THEN cached ELSE {GUESS} END, '') = ''),
ma AS (SELECT mfr_key, bool_or(resolver = 'primary') AS has_p,
   max(CASE WHEN resolver = 'primary' THEN manufacturer END) AS p, max(CASE WHEN resolver = 'secondary' THEN manufacturer END) AS s
   FROM mfr_answers GROUP BY mfr_key)
SELECT still.mfr_key, coalesce(CASE WHEN coalesce(has_p, false) THEN p ELSE s END, 'Unknown Manufacturer') AS manufacturer
FROM still LEFT JOIN ma USING (mfr_key)"""


def decay(c: str, k: str) -> str:
    f = lambda x: f"greatest(CAST(0.3 AS DOUBLE), {x} - CAST(0.2 AS DOUBLE))"
    return f"CASE WHEN {k} = 1 THEN {f(c)} WHEN {k} = 2 THEN {f(f(c))} WHEN {k} = 3 THEN {f(f(f(c)))} ELSE {f(f(f(f(c))))} END"


# Date-answer chain shared by the batch / consensus / check queries and enrich:
# rows of `fd1` (decoded, first decodable row per key) not cached and not decodable.
DATE_EXT = f""",
ud AS (SELECT * FROM fd1 WHERE decoded_date IS NULL AND date_key NOT IN (SELECT date_key FROM date_cache)),
who AS (SELECT type_key, arg_min(w_mfg, _ord) AS manufacturer, arg_min(w_model, _ord) AS model FROM ud GROUP BY type_key),
{lookup_ctes('who_m', 'who', 'manufacturer', 'model')},
bs AS (SELECT type_key, sn, CAST(floor((row_number() OVER (PARTITION BY type_key ORDER BY sn) - 1) / 30) AS INTEGER) AS batch_no
   FROM (SELECT DISTINCT type_key, w_sn AS sn FROM ud WHERE w_sn <> '') t),
batches AS (SELECT bs.type_key, w.manufacturer, w.model, bs.batch_no, bs.sn, w.meta_founded_year AS founded_year,
   w.meta_start_year AS product_start_year, w.meta_sources[1] AS source_1, w.meta_sources[2] AS source_2 FROM bs JOIN who_m w USING (type_key)),
da AS (SELECT type_key, sn, bool_or(resolver = 'primary') AS p_ans, bool_or(resolver = 'secondary') AS s_ans,
   max(CASE WHEN resolver = 'primary' THEN date END) AS p_date, max(CASE WHEN resolver = 'secondary' THEN date END) AS s_date
   FROM date_answers GROUP BY type_key, sn),
cj AS (SELECT b.type_key, b.manufacturer, b.model, b.batch_no, b.sn, a.p_ans, a.s_ans, a.p_date, a.s_date FROM batches b LEFT JOIN da a USING (type_key, sn)),
cw AS (SELECT *, coalesce(bool_or(p_ans) OVER w, false) AS hp, coalesce(bool_or(s_ans) OVER w, false) AS hs,
   bool_and(p_date IS NOT DISTINCT FROM s_date) OVER w AS agree FROM cj WINDOW w AS (PARTITION BY type_key, batch_no)),
cd AS (SELECT * FROM (SELECT type_key, manufacturer, model, batch_no, sn,
   CASE WHEN NOT hp AND NOT hs THEN '1900-01-01' WHEN hp THEN p_date ELSE s_date END AS date,
   CAST(CASE WHEN NOT hp AND NOT hs THEN 0.1 WHEN NOT hp OR NOT hs THEN 0.5 WHEN agree THEN 0.9 ELSE 0.5 END AS DOUBLE) AS confidence
   FROM cw) t WHERE date IS NOT NULL),
ce0 AS (SELECT *, {normalize_sql('date')} AS nd FROM cd),
{lookup_ctes('ce_m', 'ce0', 'manufacturer', 'model')},
ce2 AS (SELECT *, {valid_sql('CAST(substr(nd, 1, 4) AS INTEGER)', 'meta_founded_year', 'meta_start_year')} AS is_valid FROM ce_m),
ce3 AS (SELECT *, sum(CASE WHEN is_valid THEN 0 ELSE 1 END) OVER (PARTITION BY type_key, batch_no ORDER BY sn
   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM ce2),
ce AS (SELECT type_key, lower(manufacturer) || '|' || lower(model) || '|' || lower(sn) AS date_key, sn,
   CASE WHEN is_valid THEN nd ELSE CAST(coalesce(meta_start_year, 1900) AS VARCHAR) || '-01-01' END AS date,
   CASE WHEN k = 0 THEN confidence ELSE {decay('confidence', 'k')} END AS confidence, is_valid FROM ce3)"""

# Whole enrich job on the FULL chain (cache + external manufacturers).
ENRICH = f""",
ut AS (SELECT DISTINCT type_key FROM fixed WHERE type_key NOT IN (SELECT type_key FROM type_cache)),
ta AS (SELECT type_key, bool_or(resolver = 'primary') AS has_p, bool_or(resolver = 'secondary') AS has_s,
   max(CASE WHEN resolver = 'primary' THEN device_type END) AS p_type, bool_or(CASE WHEN resolver = 'primary' THEN probable_typo END) AS p_typo,
   max(CASE WHEN resolver = 'secondary' THEN device_type END) AS s_type, bool_or(CASE WHEN resolver = 'secondary' THEN probable_typo END) AS s_typo
   FROM type_answers GROUP BY type_key),
tj AS (SELECT ut.type_key, coalesce(has_p, false) AS hp, coalesce(has_s, false) AS hs, p_type, p_typo, s_type, s_typo FROM ut LEFT JOIN ta USING (type_key)),
ct AS (SELECT type_key,
  coalesce(CASE WHEN hp THEN p_type WHEN hs THEN s_type END, 'Medical Device') AS device_type,
  coalesce(CASE WHEN hp THEN p_typo WHEN hs THEN s_typo END, false) AS probable_typo,
  CAST(CASE WHEN NOT hp AND NOT hs THEN 0.1 WHEN NOT hp OR NOT hs THEN 0.5
       WHEN p_type IS NOT DISTINCT FROM s_type AND p_typo IS NOT DISTINCT FROM s_typo THEN 0.95 ELSE 0.6 END AS DOUBLE) AS confidence
  FROM tj),
types_after AS (SELECT type_key, device_type, probable_typo, confidence FROM ct
   UNION ALL SELECT type_key, device_type, probable_typo, confidence FROM type_cache WHERE type_key NOT IN (SELECT type_key FROM ct))
{DATE_EXT},
ext AS (SELECT date_key, arg_max(date, sn) AS date, arg_max(confidence, sn) AS confidence FROM ce GROUP BY date_key),
fin0 AS (SELECT f.*, t.device_type AS t_type, t.probable_typo AS t_typo, coalesce(t.confidence, 1.0) AS t_conf, t.type_key IS NOT NULL AS t_hit,
   x.device_type AS x_type, x.probable_typo AS x_typo, x.confidence AS x_conf,
   dc.date AS c_date, dc.confidence AS c_conf, e.date AS e_date, e.confidence AS e_conf
   FROM fd1 f LEFT JOIN type_cache t USING (type_key) LEFT JOIN ct x USING (type_key)
   LEFT JOIN (SELECT date_key, {normalize_sql('date')} AS date, coalesce(confidence, 1.0) AS confidence FROM date_cache) dc USING (date_key)
   LEFT JOIN ext e USING (date_key)),
fin1 AS (SELECT *,
   coalesce(CASE WHEN t_hit THEN t_type WHEN x_conf IS NOT NULL THEN x_type END, 'Medical Device') AS device_type,
   CASE WHEN c_conf IS NOT NULL THEN c_date WHEN decoded_date IS NOT NULL THEN decoded_date WHEN e_conf IS NOT NULL THEN {normalize_sql('e_date')} END AS d0,
   CASE WHEN c_conf IS NOT NULL THEN c_conf WHEN decoded_date IS NOT NULL THEN 1.0 WHEN e_conf IS NOT NULL THEN e_conf END AS date_confidence,
   CASE WHEN c_conf IS NOT NULL THEN 'cache' WHEN decoded_date IS NOT NULL THEN 'decode' WHEN e_conf IS NOT NULL THEN 'external' END AS s0
   FROM fin0),
fin AS (SELECT *, coalesce(d0, CASE WHEN {YEAR_IN_SN} <> '' THEN {YEAR_IN_SN} || '-01-01' END, '1900-01-01') AS manufactured_date FROM fin1),
enriched AS (SELECT _ord, manufacturer, model, serial_number, site, manufactured_date, device_type FROM fin),
new_dates AS (SELECT date_key, arg_min(manufactured_date, _ord) AS date, arg_min(date_confidence, _ord) AS confidence FROM fin
   WHERE s0 IN ('decode', 'external') GROUP BY date_key),
dates_after AS (SELECT * FROM new_dates UNION ALL SELECT date_key, date, confidence FROM date_cache WHERE date_key NOT IN (SELECT date_key FROM new_dates))"""


def _full(body: str) -> str:
    return td.inventory_cte() + FULL + ENRICH + "\n" + body


def _ext(body: str) -> str:
    return td.inventory_cte() + BASE + DATE_EXT + "\n" + body


ORACLE_SQL.update(
    {
        "resolve_manufacturer": td.inventory_cte() + FULL + "\nSELECT _ord, manufacturer, w_mfg AS resolved, mfg_source FROM inferred",
        "enrich": _full("SELECT * FROM enriched"),
        "type_metrics": _full(
            """SELECT device_type, count, round_even(count / sum(count) OVER () * 100, 2) AS percentage
            FROM (SELECT device_type, count(*) AS count FROM enriched GROUP BY device_type) t"""
        ),
        "avg_confidence": _full(
            """SELECT count(*) AS total_records, coalesce(round_even(avg((coalesce(t.confidence, 1.0) + coalesce(d.confidence, 1.0)) / 2.0) * 100, 2), 100.0) AS average_confidence
            FROM enriched e LEFT JOIN types_after t ON t.type_key = lower(e.manufacturer) || '|' || lower(e.model)
            LEFT JOIN dates_after d ON d.date_key = lower(e.manufacturer) || '|' || lower(e.model) || '|' || lower(e.serial_number)"""
        ),
        "typo_list": _full(
            """SELECT type_key AS key, upper(split_part(type_key, '|', 1)) AS manufacturer,
            upper(CASE WHEN strpos(type_key, '|') > 0 THEN substr(type_key, strpos(type_key, '|') + 1) ELSE '' END) AS model,
            coalesce(device_type, 'Medical Device') AS device_type, round_even(coalesce(confidence, 1.0) * 100, 1) AS confidence
            FROM types_after WHERE probable_typo"""
        ),
        "search_rows": _full(
            """SELECT * FROM enriched WHERE contains(lower(manufacturer), 'monitor') OR contains(lower(model), 'monitor')
            OR contains(lower(manufactured_date), 'monitor') OR contains(lower(device_type), 'monitor')"""
        ),
        "sort_page": _full("SELECT * FROM enriched ORDER BY lower(coalesce(model, '')) DESC, _ord LIMIT 15 OFFSET 30"),
        "last_page": _full(
            """SELECT * FROM (SELECT *, CAST(ceil(count(*) OVER () / 15.0) AS BIGINT) AS pages FROM enriched)
            QUALIFY row_number() OVER (ORDER BY lower(coalesce(model, '')) DESC, _ord) > (pages - 1) * 15"""
        ),
        "typo_report": _full(
            f"""SELECT row_number() OVER (ORDER BY s, lp, t) AS line_no, line FROM (
            SELECT 1 AS s, [CAST(0 AS BIGINT)] AS lp, type_key AS t,
              printf('Manufacturer: %s | Model: %s (Flagged as probable typo)', upper(split_part(type_key, '|', 1)),
              upper(CASE WHEN strpos(type_key, '|') > 0 THEN substr(type_key, strpos(type_key, '|') + 1) ELSE '' END)) AS line
              FROM types_after WHERE probable_typo
            UNION ALL SELECT 2, lp, '', 'Model Inconsistency: ' || reason FROM mc
            UNION ALL SELECT -1, [0], '', '' WHERE (SELECT count(*) FROM types_after WHERE probable_typo) + (SELECT count(*) FROM mc) > 0
            UNION ALL SELECT -2, [0], '', CASE WHEN (SELECT count(*) FROM types_after WHERE probable_typo) + (SELECT count(*) FROM mc) > 0
              THEN {q(R.TYPO_HEADER)} ELSE {q(R.TYPO_NONE)} END) b"""
        ),
        "corrections_report": _full(
            f"""SELECT row_number() OVER (ORDER BY s, lp) AS line_no, line FROM (
            SELECT -2 AS s, [CAST(0 AS BIGINT)] AS lp, CASE WHEN (SELECT count(*) FROM mc) + (SELECT count(*) FROM sc) > 0
              THEN {q(R.CORR_HEADER)} ELSE {q(R.CORR_NONE)} END AS line
            UNION ALL SELECT -1, [0], '' WHERE (SELECT count(*) FROM mc) + (SELECT count(*) FROM sc) > 0
            UNION ALL SELECT 0, [0], {q(R.MODEL_SECTION)} WHERE (SELECT count(*) FROM mc) > 0
            UNION ALL SELECT 1, lp, '- ' || reason FROM mc
            UNION ALL SELECT 2, [0], '' WHERE (SELECT count(*) FROM mc) > 0
            UNION ALL SELECT 3, [0], {q(R.SERIAL_SECTION)} WHERE (SELECT count(*) FROM sc) > 0
            UNION ALL SELECT 4, lp, CASE WHEN corrected <> sn
              THEN printf('- Corrected serial ''%s'' to ''%s'' for manufacturer ''%s'' (model ''%s''): %s', sn, corrected, manufacturer, model, reason)
              ELSE printf('- Serial formatting mismatch noted for ''%s'' under ''%s'' (model ''%s''): %s', sn, manufacturer, model, reason) END
            FROM sc) b"""
        ),
        "mfr_cache_upsert": _full(
            """, nm AS (SELECT lower(w_model) || '|' || lower(w_sn) AS mfr_key, arg_min(w_mfg, _ord) AS manufacturer FROM inferred
              WHERE mfg_source IN ('cache', 'rules', 'external') AND w_mfg <> 'Unknown Manufacturer' GROUP BY 1)
            SELECT * FROM nm UNION ALL SELECT mfr_key, manufacturer FROM mfr_cache WHERE mfr_key NOT IN (SELECT mfr_key FROM nm)"""
        ),
        "profile_summary": _sql(
            """SELECT count(*) AS pairs, CAST(sum(n) AS BIGINT) AS rows FROM
            (SELECT manufacturer, model, count(*) AS n FROM inventory GROUP BY manufacturer, model) t"""
        ),
        "resolver_batches": _ext("SELECT * FROM batches"),
        "consensus_dates": _ext("SELECT * FROM cd"),
        "check_external": _ext("SELECT * FROM ce"),
        "cache_upsert": td.inventory_cte() + BASE + """,
new_d AS (SELECT date_key, arg_min(decoded_date, _ord) AS date, CAST(1.0 AS DOUBLE) AS confidence FROM rd
   WHERE _c_conf IS NULL AND decoded_date IS NOT NULL GROUP BY date_key)
SELECT * FROM new_d UNION ALL SELECT * FROM date_cache WHERE date_key NOT IN (SELECT date_key FROM new_d)""",
    }
)


PART_BASE = BASE.replace("FROM inventory),", "FROM part_inv),", 1)
assert PART_BASE != BASE


def _part(body: str) -> str:
    return td.inventory_cte() + f", part_inv AS ({td.PART_AS_INVENTORY_SQL})" + PART_BASE + "\n" + body


ORACLE_SQL.update(
    {
        "dashboard_stats": _full(
            """SELECT count_if(m) AS rows, count(DISTINCT device_type) AS device_types,
            min(CASE WHEN m THEN manufactured_date END) AS first_date, max(CASE WHEN m THEN manufactured_date END) AS last_date
            FROM (SELECT *, coalesce(contains(lower(manufacturer), 'monitor'), false) OR coalesce(contains(lower(model), 'monitor'), false)
              OR coalesce(contains(lower(manufactured_date), 'monitor'), false) OR coalesce(contains(lower(device_type), 'monitor'), false) AS m
              FROM enriched) t"""
        ),
        "run_summary": _full(
            """SELECT 'input_rows' AS metric, CAST(count(*) AS BIGINT) AS value FROM inventory
            UNION ALL SELECT 'rows_written', CAST(count(*) AS BIGINT) FROM fin
            UNION ALL SELECT 'duplicates_removed', CAST((SELECT count(*) FROM inventory) - (SELECT count(*) FROM fin) AS BIGINT)
            UNION ALL SELECT 'typo_items_flagged', CAST((SELECT count(*) FROM types_after WHERE probable_typo) + (SELECT count(*) FROM mc) AS BIGINT)
            UNION ALL SELECT 'manufacturers_resolved', CAST(count_if(mfg_source IN ('cache', 'rules', 'external')) AS BIGINT) FROM fin"""
        ),
        "lookup_products": f"""WITH inv AS ({td.CUSTOMER_AS_INVENTORY_SQL}), p AS ({td.CUSTOMER_PRODUCTS_SQL}),
            makers AS (SELECT DISTINCT mfg_ord, mfg_key FROM p),
            names AS (SELECT DISTINCT manufacturer, model, lower({trimx('manufacturer')}) AS k, regexp_replace(lower({trimx('model')}), '\\s+', ' ', 'g') AS n FROM inv),
            canon AS (SELECT manufacturer, coalesce(min({rules_sql('k')}), arg_min(mfg_key, mfg_ord)) AS canon
                      FROM (SELECT DISTINCT manufacturer, k FROM names) d LEFT JOIN makers ON contains(k, mfg_key) GROUP BY manufacturer),
            best AS (SELECT names.manufacturer, names.model, p.* FROM names JOIN canon USING (manufacturer)
                     JOIN p ON canon = mfg_key AND (n = model_key OR contains(n, model_key) OR contains(model_key, n))
                     QUALIFY row_number() OVER (PARTITION BY names.manufacturer, names.model ORDER BY n = model_key DESC, mfg_ord, model_ord) = 1)
            SELECT _ord, inv.manufacturer, inv.model, mfg_key AS meta_mfg_key, founded_year AS meta_founded_year, product_start_year AS meta_start_year
            FROM inv LEFT JOIN best USING (manufacturer, model)""",
        "part_dedup": _part("SELECT _ord, manufacturer, model, serial_number FROM dedup"),
        "part_model_corrections": _part("SELECT g_mfg, g_model, original, corrected, manufacturer, kind, distance, reason FROM mc"),
        "part_serial_corrections": _part("SELECT sn, corrected, manufacturer, model, kind, reason FROM sc"),
    }
)
