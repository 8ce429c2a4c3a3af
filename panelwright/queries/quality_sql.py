"""SQL for the quality queries that SQL can express over whole tables."""

_CODE = "try_cast(regexp_replace(regexp_replace(psgc10, '[\\s ''\"`]', '', 'g'), '\\.0+$', '') AS BIGINT)"

_ORPHANS = f"""
WITH refs AS (
  SELECT 'sre_panel_with_psgc' AS table_name, xwalk_id AS rec_id, psgc10, fiscal_year, loaded_at FROM sre_panel_with_psgc
  UNION ALL
  SELECT 'population_lgu_annual', pop_id, psgc10, fiscal_year, loaded_at FROM population_lgu_annual
), r AS (SELECT *, {_CODE} AS k FROM refs WHERE psgc10 IS NOT NULL),
m AS (SELECT {_CODE} AS k, added_at, removed_at FROM psgc_lgu_master),
o AS (
  SELECT table_name, rec_id, fiscal_year,
    CASE WHEN NOT EXISTS (SELECT 1 FROM m WHERE m.k = r.k) THEN 'missing'
         WHEN NOT EXISTS (SELECT 1 FROM m WHERE m.k = r.k AND m.added_at <= r.loaded_at) THEN 'not_yet'
         ELSE 'removed' END AS reason
  FROM r
  WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.k = r.k AND m.added_at <= r.loaded_at AND (m.removed_at IS NULL OR m.removed_at > r.loaded_at))
)
"""

_MISSING = {
    "total_current_operating_exp": "(x IS NULL OR isnan(x) OR x <= 0 OR regexp_full_match(printf('%.2f', coalesce(x, 0)), '9{6,}\\.(00|99)'))",
    "total_capital_investment_exp": "(x IS NULL OR isnan(x) OR x < 0 OR regexp_full_match(printf('%.2f', coalesce(x, 0)), '9{6,}\\.(00|99)'))",
    "population": "(x IS NULL OR isnan(x) OR x <= 0 OR regexp_full_match(printf('%.2f', coalesce(x, 0)), '9{6,}\\.(00|99)'))",
}

_LOADS = """
WITH v AS (
  SELECT load_series, load_id, 'ur_b' AS column_name, CASE WHEN isnan(ur_b) THEN NULL ELSE ur_b END AS x, NULL AS s FROM panel_ml
  UNION ALL SELECT load_series, load_id, 'fund_cash_available', CASE WHEN isnan(fund_cash_available) THEN NULL ELSE fund_cash_available END, NULL FROM panel_ml
  UNION ALL SELECT load_series, load_id, 'income_class', NULL, income_class FROM panel_ml
), p AS (
  SELECT load_series, load_id, column_name, count(*) AS n, count(*) FILTER (x IS NULL AND s IS NULL) AS miss, abs(median(x)) AS med,
    count(*) FILTER (s IS NOT NULL AND NOT regexp_full_match(s, '1st|2nd|3rd|4th|5th|6th|Special')) AS bad
  FROM v GROUP BY ALL
), q AS (
  SELECT *, lag(load_id) OVER w AS prev, lag(n) OVER w AS pn, lag(miss) OVER w AS pmiss, lag(med) OVER w AS pmed, lag(bad) OVER w AS pbad
  FROM p WINDOW w AS (PARTITION BY load_series, column_name ORDER BY load_id)
)
"""

SQL = {
    "p4_found": _ORPHANS + "SELECT table_name, rec_id FROM o",
    "p4_report": _ORPHANS + "SELECT table_name, fiscal_year, reason, count(*) AS n_orphans FROM o GROUP BY ALL",
    "p5_found": " UNION ALL ".join(f"SELECT row_id, '{f}' AS field_name FROM (SELECT row_id, {f} AS x FROM panel_ml) WHERE {c}" for f, c in _MISSING.items()),
    "p6_found": _LOADS
    + """SELECT column_name, load_id, 'null_rate' AS issue FROM q WHERE prev IS NOT NULL AND abs(miss / n - pmiss / pn) >= 0.2 - 1e-9
UNION ALL SELECT column_name, load_id, 'centre' FROM q WHERE prev IS NOT NULL AND column_name <> 'income_class' AND greatest(med, pmed) > 0 AND med IS NOT NULL AND pmed IS NOT NULL AND greatest(med, pmed) >= 4 * least(med, pmed)
UNION ALL SELECT column_name, load_id, 'form' FROM q WHERE prev IS NOT NULL AND column_name = 'income_class' AND n > miss AND pn > pmiss AND abs(bad / (n - miss) - pbad / (pn - pmiss)) >= 0.15 - 1e-9""",
}


def _filled() -> str:
    """Medians of four levels, the finest with five real values taken; every column of the table beside flags and levels."""
    levels = (["psgc10", "period"], ["province", "lgu_type", "fiscal_year"], ["lgu_type", "fiscal_year"], [])
    base = ", ".join(f"(SELECT {c} FROM (SELECT {f} AS x)) AS m_{f}" for f, c in _MISSING.items())
    ctes = [f"p AS (SELECT *, CAST(floor(fiscal_year / 5) AS INTEGER) AS period, {base} FROM panel_ml)"]
    joins, picks = "", []
    for f in _MISSING:
        for i, level in enumerate(levels, 1):
            keys = ", ".join(level)
            group = f" GROUP BY {keys} HAVING count(*) >= 5" if level else ""
            ctes.append(f"{f}_{i} AS (SELECT {keys + ', ' if level else ''}median({f}) AS v FROM p WHERE NOT m_{f}{group})")
            on = " AND ".join(f"p.{k} IS NOT DISTINCT FROM {f}_{i}.{k}" for k in level) or "true"
            joins += f" LEFT JOIN {f}_{i} ON {on}"
        fill = "coalesce(" + ", ".join(f"{f}_{i}.v" for i in range(1, 5)) + ")"
        at = "CASE " + " ".join(f"WHEN {f}_{i}.v IS NOT NULL THEN {i}" for i in range(1, 5)) + " END"
        picks.append((f, fill, at))
    replaced = ", ".join(f"CASE WHEN m_{f} THEN {fill} ELSE p.{f} END AS {f}" for f, fill, _ in picks)
    flags = ", ".join(f"m_{f} AS {f}_filled, CASE WHEN m_{f} THEN {at} ELSE 0 END AS {f}_level" for f, _, at in picks)
    return "WITH " + ", ".join(ctes) + f" SELECT p.* EXCLUDE (period, {', '.join('m_' + f for f in _MISSING)}) REPLACE ({replaced}, make_timestamp(epoch_us(p.loaded_at)) AS loaded_at), {flags} FROM p{joins}"


SQL["p5_filled"] = _filled()


def _stability() -> str:
    """Index and chi-square of every column over bins of an eighth of a power of two, or over the texts themselves."""
    numbers = "row_id fiscal_year pop_2024 file_id total_current_operating_income total_local_sources total_external_sources nta_ira total_current_operating_exp total_capital_investment_exp total_expenditures fund_cash_available fund_cash_balance_end population land_area_sqkm ur_a ur_b nta_dependency election_year".split()
    texts = "psgc10 lgu_name province region lgu_type income_class city_class is_independent_city template_era loaded_at spent_source".split()
    a = "abs(x)"
    power = f"CASE WHEN {a} > 0 THEN floor(log2({a})) ELSE -1080 END"
    code = f"(({power}) + 1080) * 16 + CASE WHEN {a} > 0 THEN floor(({a} / pow(2, {power}) - 1) * 8) ELSE 0 END"
    rows = [f"SELECT load_series, load_id, '{c}' AS column_name, CAST(CASE WHEN isnan(CAST({c} AS DOUBLE)) THEN NULL ELSE {c} END AS DOUBLE) AS x, NULL AS s FROM panel_ml" for c in numbers]
    rows += [f"SELECT load_series, load_id, '{c}', NULL, CAST({'make_timestamp(epoch_us(loaded_at))' if c == 'loaded_at' else c} AS VARCHAR) FROM panel_ml" for c in texts]
    return f"""
WITH v AS ({" UNION ALL ".join(rows)}),
b AS (SELECT load_series, load_id, column_name, CASE WHEN x IS NOT NULL THEN CAST(CAST(CASE WHEN x < 0 THEN -({code}) - 1 ELSE {code} END AS BIGINT) AS VARCHAR) ELSE coalesce(s, '∅') END AS bin FROM v),
c AS (SELECT load_series, load_id, column_name, bin, count(*) AS n FROM b GROUP BY ALL),
l AS (SELECT load_series AS ls, load_id AS cur, lag(load_id) OVER (PARTITION BY load_series ORDER BY load_id) AS prev FROM (SELECT DISTINCT load_series, load_id FROM panel_ml)),
u AS (SELECT ls, cur, column_name, bin, sum(n) FILTER (load_id = cur) AS a, sum(n) FILTER (load_id = prev) AS b FROM c JOIN l ON load_series = ls AND (load_id = cur OR load_id = prev) WHERE prev IS NOT NULL GROUP BY ALL),
t AS (SELECT ls, cur, column_name, coalesce(a, 0) AS a, coalesce(b, 0) AS b, sum(a) OVER w AS ta, sum(b) OVER w AS tb FROM u WINDOW w AS (PARTITION BY ls, cur, column_name)),
p AS (SELECT *, greatest(a / ta, 1e-4) AS pa, greatest(b / tb, 1e-4) AS pb, (a + b) / (ta + tb) AS e FROM t WHERE ta > 0 AND tb > 0)
SELECT ls AS load_series, cur AS load_id, column_name, round(sum((pa - pb) * ln(pa / pb)), 6) AS psi, round(sum(pow(a - e * ta, 2) / (e * ta) + pow(b - e * tb, 2) / (e * tb)), 4) AS chi_square, count(*) - 1 AS degrees FROM p GROUP BY ALL
"""


SQL["p6_stability"] = _stability()
