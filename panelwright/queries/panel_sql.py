"""SQL for the panel queries. It states every fixed value by itself, so that a wrong one in the library shows."""

from __future__ import annotations

# Fixed values, as the queries are meant to have them.
ORPHAN_NAMES = ["provincial total", "regional total", "national total", "total", "subtotal", "grand total", "", "`", "-", "n/a", "na", "none", "null"]
ELECTIONS = [1992, 1995, 1998, 2001, 2004, 2007, 2010, 2013, 2016, 2019, 2022, 2025]
FOLDS = [("F1", 1992, 2005, 2006, 2008), ("F2", 1992, 2008, 2009, 2011), ("F3", 1992, 2011, 2012, 2014), ("F4", 1992, 2014, 2015, 2017), ("F5", 1992, 2017, 2018, 2019), ("H", 1992, 2019, 2020, 2024)]
CENSUS = [1995, 2000, 2007, 2010, 2015, 2020]
BUCKETS = [("1992-2000", 1992, 2000), ("2001-2008", 2001, 2008), ("2009-2024", 2009, 2024), ("2010s", 2010, 2019), ("all", 1992, 2024)]
ACCENTS = [("áàâäãå", "a"), ("éèêë", "e"), ("íìîï", "i"), ("óòôöõ", "o"), ("úùûü", "u"), ("ñ", "n"), ("ç", "c"), ("ýÿ", "y"), ("ÁÀÂÄÃÅ", "A"), ("ÉÈÊË", "E"), ("ÍÌÎÏ", "I"), ("ÓÒÔÖÕ", "O"), ("ÚÙÛÜ", "U"), ("Ñ", "N"), ("Ç", "C"), ("Ý", "Y")]
PREFIXES = "city of|municipality of|province of|bayan ng|lungsod ng|dakbayan sa|munisipalidad ng|mun of|cty of|c of|pgo"
SUFFIXES = "city|municipality|province|capital"
SHORT = [("gen", "general"), ("gov", "governor"), ("mt", "mount"), ("nva", "nueva"), ("pres", "president"), ("pto", "puerto"), ("sta", "santa"), ("sto", "santo")]
LOGGED = ["nta_ira", "total_current_operating_income", "total_local_sources", "total_external_sources", "fund_cash_balance_end", "total_capital_investment_exp", "population", "land_area_sqkm"]
LAGGED = ["ur_a", "ur_b", "nta_ira", "fund_cash_balance_end", "total_current_operating_income"]
ACCENTED, UNACCENTED = "".join(a for a, _ in ACCENTS), "".join(b * len(a) for a, b in ACCENTS)

INC = "total_current_operating_income"


def n(c: str) -> str:
    return f"(CASE WHEN isnan({c}) THEN NULL ELSE {c} END)"


def z(c: str) -> str:
    return f"coalesce({n(c)}, 0)"


def strs(xs) -> str:  # noqa: ANN001
    return ", ".join(f"'{x}'" for x in xs)


def nums(xs) -> str:  # noqa: ANN001
    return ", ".join(map(str, xs))


def code10(c: str) -> str:
    return f"lpad(CAST(try_cast(regexp_replace(regexp_replace({c}, '[\\s\\x{{00A0}}''\"`]', '', 'g'), '\\.0+$', '') AS BIGINT) AS VARCHAR), 10, '0')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\s\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{3000}}]+', ' ', 'g'))"


def clean(c: str) -> str:
    return squeeze(f"regexp_replace({squeeze(f'coalesce({c}, {chr(39) * 2})')}, '[*†‡]+\\s*$', '')")


def plain_key(x: str) -> str:
    return squeeze(f"regexp_replace(lower(translate({clean(x)}, '{ACCENTED}', '{UNACCENTED}')), '[^a-z0-9]+', ' ', 'g')")


def match_key(x: str) -> str:
    no_brackets = squeeze(f"regexp_replace({clean(x)}, '\\([^)]*\\)', ' ', 'g')")
    s = f"regexp_replace({plain_key(no_brackets)}, '^({PREFIXES}) +(.)', '\\2')"
    s = f"regexp_replace({s}, '(.) +({SUFFIXES})$', '\\1')"
    for k, v in SHORT:
        s = f"regexp_replace({s}, '\\b{k}\\b', '{v}', 'g')"
    return s


LATEST = "(SELECT * FROM panel_ml QUALIFY row_number() OVER (PARTITION BY psgc10, fiscal_year ORDER BY loaded_at DESC, row_id DESC) = 1)"
CODED = f"""(SELECT * FROM (SELECT * REPLACE ({code10('psgc10')} AS psgc10) FROM sre_panel_with_psgc) WHERE psgc10 IS NOT NULL AND fiscal_year IS NOT NULL
 AND lower(trim(coalesce(matched_name, ''))) NOT IN ({strs(ORPHAN_NAMES)})
 QUALIFY row_number() OVER (PARTITION BY psgc10, fiscal_year ORDER BY tier ASC NULLS LAST, xwalk_id) = 1)"""
POP = f"""(SELECT * FROM (SELECT * REPLACE ({code10('psgc10')} AS psgc10) FROM population_lgu_annual) WHERE psgc10 IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY psgc10, fiscal_year ORDER BY loaded_at DESC, pop_id DESC) = 1)"""
DETAIL = f"({z('total_current_operating_exp')} + {z('total_capital_investment_exp')})"
TOP = z("total_expenditures")
SPENT = f"(CASE WHEN {DETAIL} > 0 THEN {DETAIL} ELSE {TOP} END)"


def unused(avail: str) -> str:
    return f"(CASE WHEN {n(avail)} > 0 THEN least(1, greatest(0, 1 - {SPENT} / {n(avail)})) END)"


TARGETS = f"(SELECT *, {SPENT} AS spent_used, CASE WHEN {DETAIL} > 0 THEN 'detailed' ELSE 'total' END AS source_made, {unused('fund_cash_available')} AS a_made, {unused(INC)} AS b_made FROM {{src}})"


def div(a: str, b: str) -> str:
    return f"({n(a)} / nullif({n(b)}, 0))"


def log1p(c: str) -> str:
    return f"ln(1 + CASE WHEN {n(c)} < 0 THEN 0 ELSE {n(c)} END)"


PARTS_SUM = f"nullif({z('rpt')} + {z('business_tax')}, 0)"
HHI = f"coalesce(pow({z('rpt')} / {PARTS_SUM}, 2) + pow({z('business_tax')} / {PARTS_SUM}, 2), 0)"
RATIOS = {"nta_dependency": ("nta_ira", INC), "local_share": ("total_local_sources", INC), "external_share": ("total_external_sources", INC), "fund_balance_share": ("fund_cash_balance_end", INC), "capex_share_avail": ("total_capital_investment_exp", "fund_cash_available"), "pop_density": ("population", "land_area_sqkm")}
METADATA = r"""(t = '' OR lower(t) IN ('nan', 'none', 'notes:') OR regexp_matches(lower(t), '^(table 1\.|note:|source:|sources:)') OR contains(lower(t), 'republic act') OR contains(lower(t), 'in accordance')
 OR regexp_matches(t, '^[a-z][0-9]?\s+\S') OR ends_with(t, '.') OR length(t) > 90)"""

_ROMAN = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"]
ROMAN = " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(_ROMAN + ["X" + r for r in _ROMAN], 1))
REGION = f"(CASE WHEN regexp_full_match(r, '[0-9]+') THEN try_cast(r AS INTEGER) ELSE CASE r {ROMAN} END END)"

NUMBER = r"""
WITH c AS (SELECT file_id, row_idx, generate_subscripts(cells, 1) - 1 AS pos, unnest(cells) AS cell FROM sheet_rows),
t AS (SELECT *, regexp_replace(regexp_replace(cell, '[\s\x{00A0}_'']', '', 'g'), '^(\(?)(php|₱|p|\$|usd)', '\1', 'i') AS t FROM c),
s AS (SELECT *, (regexp_full_match(t, '\(.*\)') OR regexp_matches(t, '-$')) AS neg, regexp_replace(t, '[()]|-$', '', 'g') AS s FROM t),
v AS (SELECT *, CASE WHEN regexp_full_match(s, '-?[0-9.]*[0-9],[0-9]{1,2}') THEN replace(replace(s, '.', ''), ',', '.') ELSE replace(s, ',', '') END AS v FROM s)
SELECT file_id, row_idx, CAST(pos AS INTEGER) AS pos, CASE WHEN regexp_full_match(v, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,3})?') THEN try_cast(v AS DOUBLE) * CASE WHEN neg THEN -1 ELSE 1 END END AS x FROM v
"""

def walk(table: str, name: str) -> str:
    """The exact tiers over the typed tuples of a table."""
    province = "coalesce(province, '')"
    return f"""
WITH tup AS (SELECT DISTINCT {name} AS nm0, province, lgu_type FROM {table}),
k0 AS (SELECT *, row_number() OVER () AS rid, coalesce(nm0, '') AS nm,
  CASE lower(trim(lgu_type))[1] WHEN 'c' THEN 'city' WHEN 'm' THEN 'municipality' WHEN 'p' THEN 'province' END AS want FROM tup),
k1 AS (SELECT *, [{match_key("regexp_replace(nm, '[()]', ' ', 'g')")}, {match_key("nm")}, {match_key("regexp_extract(nm, '\\(([^)]*)\\)', 1)")}] AS ks,
  [{plain_key(squeeze(f"regexp_replace({province}, '\\([^)]*\\)', ' ', 'g')"))}, {plain_key("regexp_extract(nm, '\\(([^)]*)\\)', 1)")}, {plain_key(f"regexp_extract({province}, '\\(([^)]*)\\)', 1)")}] AS ps FROM k0),
k AS (SELECT rid, want, i AS ord, ks[i] AS key FROM k1, (SELECT unnest([1, 2, 3]) AS i) WHERE ks[i] <> '' AND NOT list_contains(ks[:i - 1], ks[i])),
p AS (SELECT rid, i AS pord, ps[i] AS prov FROM k1, (SELECT unnest([1, 2, 3]) AS i) WHERE (ps[i] <> '' OR i = 1) AND NOT list_contains(ps[:i - 1], ps[i])),
cat AS (SELECT psgc10, {match_key('name')} AS key, {plain_key("CASE WHEN level = 'province' AND coalesce(trim(province_name), '') = '' THEN name ELSE province_name END")} AS prov, level FROM psgc_lgu_master),
h AS (SELECT rid, 1 AS tier, CASE WHEN level = want THEN 0 ELSE 1 END AS step, pord, ord, 0 AS sub, psgc10 FROM k JOIN p USING (rid) JOIN cat USING (key, prov)
   WHERE level = want OR (want = 'city' AND level = 'municipality') OR (want = 'municipality' AND level = 'city')
  UNION ALL SELECT rid, 2, 2, 0, ord, 0, c FROM k JOIN (SELECT key, level AS want, min(psgc10) AS c FROM cat GROUP BY ALL HAVING count(DISTINCT psgc10) = 1) USING (key, want)
  UNION ALL SELECT rid, 2, 3, 0, ord, 0, c FROM k JOIN (SELECT key, min(psgc10) AS c FROM cat GROUP BY ALL HAVING count(DISTINCT psgc10) = 1) USING (key)
  UNION ALL SELECT rid, 2, 3, 0, ord, 1, c FROM k JOIN (SELECT key, min(psgc10) AS c FROM cat WHERE level <> 'province' GROUP BY ALL HAVING count(DISTINCT psgc10) = 1) USING (key) WHERE coalesce(want, '') <> 'province'),
t AS (SELECT rid, psgc10, tier FROM h QUALIFY row_number() OVER (PARTITION BY rid ORDER BY tier, step, pord, ord, sub, psgc10) = 1)
"""


WALK = walk("sre_panel", "lgu_name")
BARE = "(SELECT *, regexp_replace(lgu_name, '[-–,]?\\s*\\(?\\bdist(rict)?\\.?\\s*[ivx0-9]+\\)?\\s*$', '', 'i') AS unit FROM psa_panel)"
_YEARS, _FIELDS = (2018, 2021, 2023), ("pi", "cv", "se", "ci_lo", "ci_hi")
POVERTY = f""", coded AS (SELECT b.*, t.psgc10 FROM {BARE} b JOIN k0 ON b.unit IS NOT DISTINCT FROM k0.nm0 AND b.province IS NOT DISTINCT FROM k0.province AND b.lgu_type IS NOT DISTINCT FROM k0.lgu_type JOIN t USING (rid)),
parted AS (SELECT *, unit <> lgu_name AND count(*) FILTER (unit <> lgu_name) OVER (PARTITION BY psgc10) > 1 AS part FROM coded),
pooled AS (SELECT psgc10, psa_id, {', '.join(f"{n(f'{f}_{y}')} AS {f}_{y}" for f in _FIELDS for y in _YEARS)} FROM parted WHERE NOT part
  UNION ALL SELECT psgc10, NULL, {', '.join((f"avg({n(f'{f}_{y}')})" if f == 'pi' else 'NULL') for f in _FIELDS for y in _YEARS)} FROM parted WHERE part GROUP BY psgc10),
wide AS (SELECT * FROM pooled QUALIFY row_number() OVER (PARTITION BY psgc10 ORDER BY psa_id NULLS LAST) = 1)
"""

_SPANS = ", ".join(f"('{f}', {a}, {b}, {c}, {e})" for f, a, b, c, e in FOLDS)
FOLDED = f"""
WITH base AS (SELECT row_id, psgc10, fiscal_year, b_made AS ur_b, lead(b_made) OVER (PARTITION BY psgc10 ORDER BY fiscal_year) AS target FROM {TARGETS.format(src=LATEST)}),
folds(fold, a, b, c, e) AS (VALUES {_SPANS}),
x AS (SELECT base.*, fold, CASE WHEN fiscal_year BETWEEN a AND b THEN 'train' ELSE 'test' END AS part FROM base JOIN folds ON fiscal_year BETWEEN a AND b OR fiscal_year BETWEEN c AND e WHERE target IS NOT NULL),
m AS (SELECT fold, avg(target) FILTER (part = 'train') AS tm FROM x GROUP BY fold),
p AS (SELECT fold, 'naive' AS model, target AS y, coalesce(ur_b, tm) AS q FROM x JOIN m USING (fold) WHERE part = 'test'
  UNION ALL SELECT fold, 'fold_mean', target, tm FROM x JOIN m USING (fold) WHERE part = 'test'
  UNION ALL SELECT fold, 'zero', target, 0 FROM x WHERE part = 'test'),
s AS (SELECT fold, model, count(*) AS n_test, sqrt(avg((y - least(1, greatest(0, q))) ^ 2)) AS rmse, avg(abs(y - least(1, greatest(0, q)))) AS mae, 1 - avg((y - least(1, greatest(0, q))) ^ 2) / nullif(var_pop(y), 0) AS r2 FROM p GROUP BY ALL),
g AS (SELECT *, rmse / nullif(max(rmse) FILTER (model = 'naive') OVER (PARTITION BY fold), 0) AS ratio FROM s)
"""

SQL = {
    "panel_star_join": walk(BARE, "unit") + POVERTY + f"SELECT f.psgc10, f.fiscal_year, xwalk_id, tier, m.name AS lgu_name, level AS lgu_type, CASE WHEN level = 'province' AND province_name = '' THEN name ELSE province_name END AS province, region_name AS region, income_class, pop_2024, round({n('f.total_expenditures')}, 4) AS total_expenditures, round({n('p.population')}, 4) AS population, pop_source, " + ", ".join(f"round(CASE fiscal_year " + " ".join(f"WHEN {y} THEN {c}_{y}" for y in _YEARS) + f" END, 6) AS poverty_{c}" for c in _FIELDS) + ", " + ", ".join(f"round({c}_{y}, 6) AS {c}_{y}" for c in _FIELDS for y in _YEARS) + f", 1 AS in_sre, CAST(coalesce(pi_2018, pi_2021, pi_2023) IS NOT NULL AS INTEGER) AS in_psa FROM {CODED} f LEFT JOIN psgc_lgu_master m ON f.psgc10 = m.psgc10 LEFT JOIN (SELECT psgc10 AS pc, fiscal_year AS fy, population, pop_source FROM {POP}) p ON f.psgc10 = pc AND f.fiscal_year = fy LEFT JOIN wide w ON f.psgc10 = w.psgc10",
    "tier_dedup": f"SELECT psgc10, fiscal_year, xwalk_id, tier FROM {CODED}",
    "keep_last_dedup": f"SELECT psgc10, fiscal_year, row_id FROM {LATEST}",
    "keep_best_by_aggregate": "SELECT psgc10, row_id, load_id FROM panel_ml QUALIFY row_number() OVER (PARTITION BY psgc10 ORDER BY loaded_at, row_id) = 1",
    "distinct_labels": "SELECT DISTINCT region, province, lgu_name, lgu_type FROM sre_panel",
    "duplicate_groups": "SELECT psgc10, fiscal_year, count(*) AS n_rows, count(DISTINCT load_id) AS n_load_id FROM panel_ml GROUP BY ALL HAVING count(*) > 1",
    "repeated_rows_marked": "SELECT psa_id, CAST(count(*) OVER (PARTITION BY lgu_name, province) > 1 AS INTEGER) AS is_repeated FROM psa_panel",
    "null_safe_lookup": "SELECT first_row, count(*) AS n_rows FROM (SELECT min(row_id) OVER (PARTITION BY region, province, lgu_name, lgu_type) AS first_row FROM sre_panel) GROUP BY first_row",
    "semi_membership": "SELECT row_id FROM panel_ml WHERE psgc10 IN (SELECT psgc10 FROM psgc_lgu_master)",
    "anti_backfill": f"SELECT psgc10, pop_2024, CAST(y AS INTEGER) AS fiscal_year FROM psgc_lgu_master, range(1992, 2025) r(y) WHERE NOT EXISTS (SELECT 1 FROM population_lgu_annual a WHERE {code10('a.psgc10')} = psgc_lgu_master.psgc10 AND a.fiscal_year = y AND {n('a.population')} IS NOT NULL)",
    "coverage_sides": "SELECT count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) AS both, count(*) FILTER (r IS NULL) AS only_left, count(*) FILTER (l IS NULL) AS only_right FROM (SELECT DISTINCT psgc10 AS l FROM psgc_lgu_master WHERE psgc10 IS NOT NULL) a FULL JOIN (SELECT DISTINCT psgc10 AS r FROM panel_ml WHERE psgc10 IS NOT NULL) b ON l = r",
    "coverage_flags": f"SELECT psa_id, CAST(coalesce({n('pi_2018')}, {n('pi_2021')}, {n('pi_2023')}) IS NOT NULL AS INTEGER) AS has_poverty FROM psa_panel",
    "member_expansion": "SELECT m.psgc10, m.province_code, p.name AS province_label FROM psgc_lgu_master m JOIN psgc_lgu_master p ON p.level = 'province' AND m.province_code = p.psgc10 WHERE m.level <> 'province'",
    "variant_lookup": f"WITH m AS (SELECT {match_key('name')} AS key, min(psgc10) AS psgc10 FROM psgc_lgu_master GROUP BY 1 HAVING count(*) = 1), p AS (SELECT psa_id, 0 AS rank, {plain_key('lgu_name')} AS key FROM psa_panel UNION ALL SELECT psa_id, 1, {match_key('lgu_name')} FROM psa_panel) SELECT psa_id, psgc10 FROM p JOIN m USING (key) QUALIFY row_number() OVER (PARTITION BY psa_id ORDER BY rank) = 1",
    "ur_target": f"SELECT row_id, round(spent_used, 4) AS spent_used, source_made AS spent_source, round(a_made, 6) AS ur_a, round(b_made, 6) AS ur_b FROM {TARGETS.format(src='panel_ml')}",
    "lag_lead_panel": "SELECT row_id, " + ", ".join(f"{n(f'lag({c}, {k}) OVER w')} AS {c}_lag{k}" for c in LAGGED for k in (1, 2)) + f", {n('lead(ur_a) OVER w')} AS ur_a_lead1, {n('lead(ur_b) OVER w')} AS ur_b_lead1 FROM {LATEST} WINDOW w AS (PARTITION BY psgc10 ORDER BY fiscal_year)",
    "calendar_lags": f"WITH l AS {LATEST} SELECT a.row_id, {n('b.nta_dependency')} AS x_year1 FROM l a LEFT JOIN l b ON a.psgc10 = b.psgc10 AND b.fiscal_year = a.fiscal_year - 1",
    "log_features": "SELECT row_id, " + ", ".join(f"round({log1p(c)}, 6) AS log_{c}" for c in LOGGED) + " FROM panel_ml",
    "safe_ratios": "SELECT row_id, " + ", ".join(f"round({div(a, b)}, 6) + 0.0 AS {c}" for c, (a, b) in RATIOS.items()) + " FROM panel_ml",
    "revenue_hhi": f"SELECT row_id, round({HHI}, 6) AS revenue_hhi FROM sre_panel",
    "structure_features": f"SELECT row_id, try_cast(nullif(regexp_extract(income_class, '^\\s*([1-6])', 1), '') AS INTEGER) AS income_class_num, CAST(coalesce(fiscal_year IN ({nums(ELECTIONS)}), false) AS INTEGER) AS is_election FROM panel_ml",
    "unit_rescale": f"WITH m AS (SELECT file_id, median({n(INC)}) AS med FROM panel_ml GROUP BY 1) SELECT row_id, round({n(INC)} / CASE WHEN med > 1e6 THEN 1e6 ELSE 1 END, 6) AS income, round({n('nta_ira')} / CASE WHEN med > 1e6 THEN 1e6 ELSE 1 END, 6) AS nta_ira FROM panel_ml LEFT JOIN m USING (file_id)",
    "feature_matrix": "SELECT row_id, psgc10, fiscal_year, source_made AS spent_source, try_cast(nullif(regexp_extract(income_class, '^\\s*([1-6])', 1), '') AS INTEGER) AS income_class_num, " + f"CAST(coalesce(fiscal_year IN ({nums(ELECTIONS)}), false) AS INTEGER) AS election_year, round(spent_used, 4) AS spent_used, round(a_made, 4) AS ur_a, round(b_made, 4) AS ur_b, round(lead(a_made) OVER w, 4) AS target_ur_a, round(lead(b_made) OVER w, 4) AS target_ur_b, round(a_made, 4) AS ur_a_current, round(b_made, 4) AS ur_b_current, " + ", ".join(f"round({n(f'lag({dict(ur_a='a_made', ur_b='b_made').get(c, c)}, {k}) OVER w')}, 4) AS {c}_lag{k}" for c in LAGGED for k in (1, 2)) + ", " + ", ".join(f"round({log1p(c)}, 4) AS log_{c}" for c in LOGGED) + ", " + ", ".join(f"round({div(a, b)}, 4) + 0.0 AS {c}" for c, (a, b) in RATIOS.items()) + f" FROM {TARGETS.format(src=LATEST)} WINDOW w AS (PARTITION BY psgc10 ORDER BY fiscal_year)",
    "ffill_bfill_grid": f"WITH o AS (SELECT region, fiscal_year, avg({n('fund_cash_available')}) AS cash FROM panel_ml GROUP BY ALL), g AS (SELECT s.region, CAST(y AS INTEGER) AS fiscal_year, o.cash FROM (SELECT DISTINCT region FROM o) s CROSS JOIN range(1992, 2025) r(y) LEFT JOIN o ON o.region = s.region AND o.fiscal_year = y) SELECT region, fiscal_year, round(coalesce(last_value(cash IGNORE NULLS) OVER (PARTITION BY region ORDER BY fiscal_year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(cash IGNORE NULLS) OVER (PARTITION BY region ORDER BY fiscal_year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 4) AS cash FROM g",
    "rebase_index": f"WITH a AS (SELECT region, fiscal_year, avg({n('nta_dependency')}) AS x FROM panel_ml GROUP BY ALL) SELECT region, fiscal_year, round(x / nullif(max(x) FILTER (fiscal_year = 2018) OVER (PARTITION BY region), 0), 6) AS deflator FROM a",
    "loglinear_interpolate": f"WITH o AS (SELECT psgc10, fiscal_year AS t, {n('population')} AS v FROM {POP} WHERE fiscal_year IN ({nums(CENSUS)}) AND {n('population')} IS NOT NULL), g AS (SELECT psgc10, CAST(y AS INTEGER) AS y FROM (SELECT DISTINCT psgc10 FROM o), range(1992, 2025) r(y)), b AS (SELECT g.psgc10, y, max(t) FILTER (t <= y) AS t0, min(t) FILTER (t > y) AS t1, min(t) AS tf FROM g JOIN o USING (psgc10) GROUP BY ALL), c AS (SELECT b.*, o0.v AS v0, o1.v AS v1, of.v AS vf FROM b LEFT JOIN o o0 ON o0.psgc10 = b.psgc10 AND o0.t = t0 LEFT JOIN o o1 ON o1.psgc10 = b.psgc10 AND o1.t = t1 LEFT JOIN o of ON of.psgc10 = b.psgc10 AND of.t = tf) SELECT psgc10, y AS fiscal_year, round(CASE WHEN t0 IS NULL THEN vf WHEN t1 IS NULL OR y = t0 THEN v0 WHEN v0 > 0 AND v1 > 0 THEN exp(ln(v0) * (1 - (y - t0) / (t1 - t0)) + ln(v1) * ((y - t0) / (t1 - t0))) ELSE v0 * (1 - (y - t0) / (t1 - t0)) + v1 * ((y - t0) / (t1 - t0)) END, 3) AS population FROM c",
    "proportional_allocation": "WITH m AS (SELECT psgc10, province_code, CAST(pop_2024 AS DOUBLE) AS w FROM psgc_lgu_master WHERE level <> 'province'), s AS (SELECT *, sum(coalesce(w, 0)) OVER (PARTITION BY province_code) AS t, count(*) OVER (PARTITION BY province_code) AS c FROM m), q AS (SELECT *, CASE WHEN t > 0 THEN coalesce(w, 0) / t ELSE 1 / c END AS share FROM s) SELECT q.psgc10, round(share, 8) AS share, round(share * CAST(p.pop_2024 AS DOUBLE), 3) AS allocated FROM q LEFT JOIN psgc_lgu_master p ON p.level = 'province' AND p.psgc10 = q.province_code",
    "section_header_fill": "SELECT psa_id, last_value(CASE WHEN NOT coalesce(regexp_matches(lower(province), 'continued|\\(cont'), true) THEN province END IGNORE NULLS) OVER (PARTITION BY region ORDER BY psa_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM psa_panel",
    "unpivot_snapshots": " UNION ALL ".join(f"SELECT psa_id, {y} AS fiscal_year, " + ", ".join(f"{n(f'{c}_{y}')} AS {c}" for c in _FIELDS) + " FROM psa_panel" for y in _YEARS),
    "unpivot_measures": " UNION ALL ".join(f"SELECT psa_id, {y} AS year, pi_{y} AS value FROM psa_panel WHERE {n(f'pi_{y}')} IS NOT NULL" for y in (2018, 2021, 2023)),
    "pivot_contingency": "SELECT lgu_type, " + ", ".join(f"count(*) FILTER (spent_source = '{v}') AS {v}" for v in ("detailed", "total", "none")) + " FROM panel_ml GROUP BY 1",
    "collapse_mean_union": f"WITH p AS (SELECT psa_id, province, lgu_name AS name, {n('pi_2018')} AS pi_2018, {n('pi_2021')} AS pi_2021, coalesce(regexp_matches(lower(lgu_name), '\\bdist'), false) AS part FROM psa_panel) SELECT psa_id, province, name, round(pi_2018, 6) AS pi_2018, round(pi_2021, 6) AS pi_2021 FROM p WHERE NOT part UNION ALL SELECT NULL, province, 'districts', round(avg(pi_2018), 6), round(avg(pi_2021), 6) FROM p WHERE part GROUP BY province",
    "union_by_name": "SELECT fiscal_year, count(*) AS n, count(tier) AS n_tier, count(pop_source) AS n_source FROM (SELECT psgc10, fiscal_year, tier FROM sre_panel_with_psgc UNION ALL BY NAME SELECT psgc10, fiscal_year, pop_source FROM population_lgu_annual) GROUP BY 1",
    "hierarchy_codes": "SELECT m.psgc10, rpad(m.psgc10[:5], 10, '0') AS parent_code, coalesce(p.name, '') AS parent_name FROM psgc_lgu_master m LEFT JOIN psgc_lgu_master p ON p.psgc10 = rpad(m.psgc10[:5], 10, '0')",
    "code_clean": "WITH x AS (SELECT xwalk_id, regexp_replace(regexp_replace(trim(psgc10), '\\.0+(\\D*)$', '\\1'), '\\D', '', 'g') AS dg FROM sre_panel_with_psgc) SELECT xwalk_id, CASE WHEN length(dg) = 0 THEN '' WHEN length(dg) >= 10 THEN dg ELSE lpad(dg, 10, '0') END AS code FROM x",
    "text_keys": f"SELECT psgc10, {plain_key('name')} AS plain_key, {match_key('name')} AS match_key, CASE lower(trim(level))[1] WHEN 'c' THEN 'city' WHEN 'm' THEN 'municipality' WHEN 'p' THEN 'province' END AS level_key FROM psgc_lgu_master",
    "region_canon": f"SELECT DISTINCT region, {REGION} AS number FROM (SELECT region, upper(regexp_extract(region, '^\\s*(?:region|reg\\.?|r)\\s*0*([ivx]+|[0-9]+)\\b', 1, 'i')) AS r FROM sre_panel)",
    "year_from_name": "SELECT file_id, CAST(list_last(regexp_extract_all(file_name, '((?:19|20)[0-9]{2})', 1)) AS INTEGER) AS year FROM harmonization_report",
    "metadata_rows": f"WITH x AS (SELECT trim(coalesce(lgu_name, '')) AS t FROM sre_panel) SELECT CAST({METADATA} AS INTEGER) AS is_metadata, count(*) AS n FROM x GROUP BY 1",
    "number_parse": NUMBER,
    "era_rules": "SELECT file_id, CASE WHEN contains(lower(file_name), 'sie') THEN 'SIE' WHEN contains(lower(file_name), 'sre') THEN 'SRE' WHEN fiscal_year BETWEEN 1992 AND 2000 THEN 'BOS' WHEN fiscal_year BETWEEN 2001 AND 2008 THEN 'SIE' WHEN fiscal_year BETWEEN 2009 AND 2024 THEN 'SRE' END AS era FROM harmonization_report",
    "ordered_pattern_map": f"WITH l AS (SELECT DISTINCT {squeeze('lower(x)')} AS label FROM (SELECT unnest(header_labels) AS x FROM header_block)), r AS (SELECT lower(known_label) AS pattern, column_name AS target, -length(known_label) AS rank FROM canonical_columns) SELECT label, target FROM l JOIN r ON contains(label, pattern) QUALIFY row_number() OVER (PARTITION BY label ORDER BY CAST(label <> pattern AS INTEGER), rank, target) = 1",
    "alias_closure": "WITH e AS (SELECT DISTINCT * FROM (SELECT match_key_short AS key, lower(old_names) AS alias FROM psgc_lgu_master WHERE old_names IS NOT NULL UNION ALL SELECT lower(province_name), match_key_short FROM psgc_lgu_master) WHERE key IS NOT NULL AND alias IS NOT NULL), d0 AS (SELECT key, key AS alias, 0 AS depth FROM (SELECT key FROM e UNION SELECT alias FROM e)), d1 AS (SELECT DISTINCT key, alias, 1 AS depth FROM e), d2 AS (SELECT DISTINCT d1.key, e.alias, 2 AS depth FROM d1 JOIN e ON d1.alias = e.key), d3 AS (SELECT DISTINCT d2.key, e.alias, 3 AS depth FROM d2 JOIN e ON d2.alias = e.key) SELECT key, alias, min(depth) AS depth FROM (FROM d0 UNION ALL FROM d1 UNION ALL FROM d2 UNION ALL FROM d3) GROUP BY ALL",
    "exact_tier_match": WALK + "SELECT nm0 AS lgu_name, province, lgu_type, psgc10, tier FROM k0 JOIN t USING (rid)",
    "tier_histogram": WALK + ", c AS (SELECT lgu_name, province, lgu_type, count(*) AS n FROM sre_panel GROUP BY ALL) SELECT coalesce(tier, 0) AS tier, count(*) AS n_tuples, CAST(sum(n) AS BIGINT) AS n_rows FROM c JOIN k0 ON c.lgu_name IS NOT DISTINCT FROM nm0 AND c.province IS NOT DISTINCT FROM k0.province AND c.lgu_type IS NOT DISTINCT FROM k0.lgu_type LEFT JOIN t USING (rid) GROUP BY 1",
    "unmatched_ranking": WALK + "SELECT s.lgu_name, s.province, s.lgu_type, count(*) AS n_rows FROM sre_panel s JOIN k0 ON s.lgu_name IS NOT DISTINCT FROM k0.nm0 AND s.province IS NOT DISTINCT FROM k0.province AND s.lgu_type IS NOT DISTINCT FROM k0.lgu_type WHERE rid NOT IN (SELECT rid FROM t) GROUP BY ALL ORDER BY n_rows DESC, s.lgu_name NULLS FIRST, s.province NULLS FIRST, s.lgu_type NULLS FIRST LIMIT 30",
    "qa_by_year": f"SELECT fiscal_year, count({n('nta_dependency')}) AS n, round(avg({n('nta_dependency')}), 3) AS mean, round(median({n('nta_dependency')}), 3) AS median FROM panel_ml GROUP BY 1",
    "qa_by_bucket": " UNION ALL ".join(f"SELECT '{b}' AS bucket, count(*) AS n_rows, count({n('nta_dependency')}) AS n_values, round(avg({n('nta_dependency')}), 4) AS mean FROM panel_ml WHERE fiscal_year BETWEEN {lo} AND {hi}" for b, lo, hi in BUCKETS),
    "distinct_counts": "SELECT fiscal_year, count(DISTINCT psgc10) AS n_units, count(DISTINCT file_id) AS n_files FROM panel_ml GROUP BY 1",
    "entity_summary": f"SELECT psgc10, arg_min(lgu_name, (fiscal_year, row_id)) AS first_name, round(median({n('nta_dependency')}), 6) AS median_nta, round(avg({n('population')}), 3) AS mean_population FROM panel_ml GROUP BY 1",
    "topk_per_group": "SELECT province_name, psgc10, CAST(row_number() OVER (PARTITION BY province_name ORDER BY pop_2024 DESC, psgc10) AS INTEGER) AS rank FROM psgc_lgu_master WHERE level <> 'province' AND pop_2024 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY province_name ORDER BY pop_2024 DESC, psgc10) <= 5",
    "mode_per_group": "SELECT province, income_class AS mode, n FROM (SELECT province, income_class, count(*) AS n FROM panel_ml WHERE income_class IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY province ORDER BY n DESC, income_class) = 1",
    "share_rank": "WITH f AS (SELECT file_id, median(log10(total_current_operating_income)) AS med FROM sre_panel WHERE total_current_operating_income > 0 AND NOT isnan(total_current_operating_income) GROUP BY 1), g AS (SELECT file_id, pow(1000, greatest(round((med - (SELECT median(med) FROM f)) / 3), 0)) AS k FROM f), l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS item, {n(c)} / coalesce(k, 1) AS v FROM sre_panel LEFT JOIN g USING (file_id)" for c in ("rpt", "business_tax", "nta_ira", "gps", "economic_services")) + "), a AS (SELECT item, avg(abs(v)) AS m FROM l WHERE v IS NOT NULL GROUP BY 1) SELECT item, round(m, 3) AS mean_abs, round(m / sum(m) OVER (), 3) AS share, CAST(row_number() OVER (ORDER BY m DESC, item) AS INTEGER) AS rank FROM a",
    "overlapping_groups": " UNION ALL ".join(f"SELECT '{lab}' AS label, count(*) AS n, round(avg({n('nta_dependency')}), 4) AS mean FROM panel_ml WHERE {c}" for lab, c in (("cities", "lgu_type = 'city'"), ("municipalities", "lgu_type = 'municipality'"), ("before_2009", "fiscal_year < 2009"), ("elections", f"fiscal_year IN ({nums(ELECTIONS)})"), ("metro", "province = 'Metro Kalayan'"))),
    "joined_names": "SELECT stream_id, array_to_string(list_sort(list_distinct(list(template_era))), '|') AS eras FROM harmonization_report GROUP BY 1",
    "validation_rules": f"WITH x AS (SELECT psgc10, {n(INC)} AS inc, {n('total_local_sources')} + {n('total_external_sources')} AS parts, {n('total_current_operating_exp')} AS ex, {n('population')} AS pop FROM panel_ml) SELECT 'missing_code' AS rule, 'error' AS severity, count(*) FILTER (psgc10 IS NULL) AS n_violations, count(*) AS n_rows FROM x UNION ALL SELECT 'negative_spending', 'error', count(*) FILTER (ex < 0), count(*) FROM x UNION ALL SELECT 'zero_income', 'warning', count(*) FILTER (inc = 0), count(*) FROM x UNION ALL SELECT 'income_identity', 'warning', count(*) FILTER (inc > 0 AND abs(inc - parts) / inc > 0.01), count(*) FROM x UNION ALL SELECT 'no_population', 'warning', count(*) FILTER (pop IS NULL OR pop <= 0), count(*) FROM x",
    "validation_by_year": f"SELECT fiscal_year, 'negative_spending' AS rule, count(*) FILTER ({n('total_current_operating_exp')} < 0) AS n_violations FROM panel_ml GROUP BY 1 UNION ALL SELECT fiscal_year, 'zero_income', count(*) FILTER ({n(INC)} = 0) FROM panel_ml GROUP BY 1",
    "master_validation": " UNION ALL ".join(f"SELECT '{r}' AS rule, '{s}' AS severity, count(*) FILTER ({c}) AS n_violations, count(*) AS n_rows FROM psgc_lgu_master" for r, s, c in (("bad_code", "error", "length(psgc10) <> 10"), ("no_name", "error", "coalesce(trim(name), '') = ''"), ("city_without_province", "info", "level = 'city' AND province_code = ''"), ("removed", "info", "removed_at IS NOT NULL"))),
    "fold_sizes": FOLDED + "SELECT fold, part, count(*) AS n FROM x GROUP BY ALL",
    "fold_metrics_naive": FOLDED + "SELECT fold, model, n_test, round(rmse, 5) AS rmse, round(mae, 5) AS mae, round(r2, 5) AS r2, round(ratio, 5) AS rmse_ratio_vs_naive FROM g",
    "verdict": FOLDED + "SELECT model, round(avg(rmse), 5) AS rmse, round(avg(ratio), 4) AS ratio, CASE WHEN avg(ratio) < 0.95 THEN 'better' WHEN avg(ratio) <= 1 THEN 'similar' ELSE 'worse' END AS verdict FROM g WHERE fold <> 'H' GROUP BY model",
    "stratified_holdout": "WITH e AS (SELECT psgc10, region_code, row_number() OVER (PARTITION BY region_code ORDER BY md5(psgc10 || ':42'), psgc10) AS r, count(*) OVER (PARTITION BY region_code) AS c FROM psgc_lgu_master) SELECT psgc10, CAST(r <= greatest(1, CAST(round_even(c * 0.2, 0) AS INTEGER)) AS INTEGER) AS held_out FROM e",
    "sample_names": "SELECT level, psgc10 FROM psgc_lgu_master QUALIFY row_number() OVER (PARTITION BY level ORDER BY md5(psgc10 || ':1'), psgc10) <= 5",
    "events_json_daily": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k, round(sum(value), 3) AS sum_value FROM events GROUP BY ALL",
    "running_share": "WITH e AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, day, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM e",
}


def non_null_sql(columns: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg(CAST({n(c) if t == 'double' else c} IS NOT NULL AS DOUBLE)), 4) AS rate FROM panel_ml" for c, t in columns)


_PANEL = "row_id:l psgc10:s fiscal_year:l lgu_name:s province:s region:s lgu_type:s income_class:s city_class:s pop_2024:l template_era:s file_id:l load_series:s load_id:l total_current_operating_income total_local_sources total_external_sources nta_ira total_current_operating_exp total_capital_investment_exp total_expenditures fund_cash_available fund_cash_balance_end population land_area_sqkm ur_a ur_b nta_dependency spent_source:s election_year:l"
SQL["nonnull_rates"] = non_null_sql([(x.split(":")[0], "x" if ":" in x else "double") for x in _PANEL.split()])


def _no_brackets(x: str) -> str:
    return squeeze(f"regexp_replace({x}, '\\([^)]*\\)', ' ', 'g')")


_TYPED_REGION = plain_key("regexp_replace(" + _no_brackets("region") + ", '^\\.+', '')")
SQL["region_names"] = f"""
WITH n AS (SELECT DISTINCT {_no_brackets('region_name')} AS name FROM psgc_lgu_master WHERE region_name IS NOT NULL), k AS (SELECT name, {plain_key('name')} AS key FROM n WHERE name <> ''),
t AS (SELECT DISTINCT region, {_TYPED_REGION} AS t, upper(regexp_extract(region, '^\\s*(?:region|reg\\.?|r)\\s*0*([ivx]+|[0-9]+)\\b', 1, 'i')) AS r FROM sre_panel),
h AS (SELECT region, name, CASE WHEN t = key THEN 0 WHEN starts_with(t, key || ' ') THEN 1 ELSE 2 END AS test, key FROM t JOIN k ON t = key OR starts_with(t, key || ' ') OR ends_with(t, ' ' || key)),
b AS (SELECT region, name FROM h QUALIFY row_number() OVER (PARTITION BY region ORDER BY test, length(key) DESC, key) = 1)
SELECT t.region, coalesce(b.name, 'Region ' || CAST({REGION} AS VARCHAR)) AS canonical FROM t LEFT JOIN b ON t.region IS NOT DISTINCT FROM b.region
"""
