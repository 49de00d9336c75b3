"""DuckDB SQL for the registered queries.

Written step by step with plain joins and self-joins, independently of how the
Spark plans reach the same tables.
"""

from __future__ import annotations

import re


def once(expr: str, digits: int) -> str:
    """Round half to even; adding zero turns -0 into 0."""
    return f"(round_even({expr}, {digits}) + 0.0::DOUBLE)"


def r(expr: str, digits: int) -> str:
    """Round in two steps: the first removes the noise of summation order, so
    that exact halves are seen as such by the second."""
    return once(f"round_even({expr}, {digits + 4})", digits)


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


COSTS = ("cost_cc1", "cost_cc2", "cost_who1", "cost_who2", "cost_who3", "cost_who4")
CHART_COSTS = COSTS[:4]
METRICS = ("number", "rate_per_100k", "percent") + COSTS
ESTIMATES = ("GBD 2019", "2016 reallocation approach", "Composite method")
BOUNDS = ("val", "lower", "upper")
NUMBER_UNIT = "100.0::DOUBLE"
COST_UNIT = "1000000.0::DOUBLE"

D = {
    "number": 2, "rate_per_100k": 4, "percent": 6, "measure_total": 2, "pop100k": 6, "gdp": 2, "gdp_ppp": 2,
    **{c: 0 for c in COSTS},
}

CTES: dict[str, str] = {}

CTES["iso"] = """
SELECT n_nationkey AS nk, n_nationkey + 2 AS location_id, n_name AS location_name,
       CASE WHEN n_nationkey = 5 THEN 'SSD' ELSE 'N' || lpad(n_nationkey::VARCHAR, 2, '0') END AS iso_code
FROM nation"""
CTES["crosswalk"] = """
SELECT location_id, iso_code, location_name FROM iso UNION ALL SELECT 1, NULL, 'Global'"""
CTES["income"] = """
SELECT iso_code, CASE WHEN nk < 20 THEN ['H', 'UM', 'LM', 'L'][(nk // 5 + 1)::INTEGER] END AS income_level FROM iso
UNION ALL SELECT NULL, NULL UNION ALL SELECT NULL, NULL"""
CTES["region_dim"] = """
SELECT iso_code, CASE WHEN nk <> 24 THEN r_name END AS who_region,
       CASE WHEN nk <> 24 THEN r_name || '-' || (nk // 5 % 2)::INTEGER::VARCHAR END AS ihme_region
FROM iso JOIN nation ON n_nationkey = nk JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 'ZZZ', 'EUROPE', 'EUROPE-0'"""
CTES["boundary"] = """
SELECT CASE WHEN nk = 5 THEN 'X05' ELSE iso_code END AS gu_a3,
       CASE WHEN nk = 5 THEN 'SDS' ELSE iso_code END AS adm0_a3 FROM iso
UNION ALL SELECT 'QQQ', 'QQQ'"""
CTES["polygons"] = """
SELECT gu_a3, adm0_a3, CASE WHEN adm0_a3 = 'SDS' THEN 'SSD' ELSE gu_a3 END AS iso_code FROM boundary"""
CTES["gdp_nation"] = """
SELECT iso_code, nk, sum(CAST(abs(s_acctbal) AS DECIMAL(18, 4))) AS amount
FROM supplier JOIN iso ON nk = s_nationkey GROUP BY ALL"""
CTES["gdp"] = """
SELECT iso_code, CASE WHEN nk % 7 <> 3 THEN amount::DOUBLE * 1000 END AS gdp FROM gdp_nation
UNION ALL SELECT 'WLD', sum(amount)::DOUBLE * 1000 FROM gdp_nation"""
CTES["ppp_nation"] = """
SELECT iso_code, sum(CAST(o_totalprice AS DECIMAL(18, 4))) AS amount
FROM orders JOIN customer ON c_custkey = o_custkey JOIN iso ON nk = c_nationkey GROUP BY iso_code"""
CTES["gdp_ppp"] = """
SELECT iso_code, amount::DOUBLE AS gdp_ppp FROM ppp_nation
UNION ALL SELECT 'WLD', sum(amount)::DOUBLE FROM ppp_nation"""
CTES["people"] = """
SELECT c_nationkey + 2 AS location_id, (1 + c_custkey % 2)::INTEGER AS sex_id, count(*) * 10000.0::DOUBLE AS people
FROM customer GROUP BY ALL
UNION ALL SELECT 1, (1 + c_custkey % 2)::INTEGER, count(*) * 10000.0::DOUBLE FROM customer GROUP BY ALL"""

CTES["base"] = """
SELECT c_nationkey AS nk, (1 + c_custkey % 2)::INTEGER AS sex_id, year(l_shipdate)::INTEGER AS year, p_type, p_size, l_linestatus AS status, l_quantity AS q, l_extendedprice AS p,
       l_tax AS t, l_discount AS d, CASE WHEN l_linenumber = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS n
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN part ON p_partkey = l_partkey"""
CTES["cause_map"] = """
SELECT * FROM (VALUES ('STANDARD', 558, 9999), ('SMALL', 543, 9999), ('LARGE', 630, 9999), ('PROMO', 639, 9999),
  ('STANDARD', 409, 9999), ('SMALL', 409, 9999), ('LARGE', 409, 9999), ('PROMO', 409, 9999), ('ECONOMY', 409, 9999),
  ('MEDIUM', 687, 9999), ('MEDIUM', 718, 10),
  ('STANDARD', 294, 9999), ('SMALL', 294, 9999), ('LARGE', 294, 9999), ('PROMO', 294, 9999), ('ECONOMY', 294, 9999),
  ('MEDIUM', 294, 9999)) AS m(m_type, cause_id, max_size)"""
CTES["measured"] = """
SELECT nk, sex_id, year, p_type, p_size, 1 AS measure_id, 25.0::DOUBLE AS scale, q AS x, t, d FROM base WHERE status = 'F'
UNION ALL SELECT nk, sex_id, year, p_type, p_size, 2, 1000.0::DOUBLE, p, t, d FROM base
UNION ALL SELECT nk, sex_id, year, p_type, p_size, 3, 1000.0::DOUBLE, p, t, d FROM base WHERE status = 'O'
UNION ALL SELECT nk, sex_id, year, p_type, p_size, 4, 1000.0::DOUBLE, p, t, d FROM base WHERE status = 'F'
UNION ALL SELECT nk, sex_id, year, p_type, p_size, 5, 1.0::DOUBLE, n, t, d FROM base"""
CTES["nation_sums"] = """
SELECT nk, sex_id, year, measure_id, cause_id, scale, sum(CAST(x AS DECIMAL(18, 4))) AS val,
       sum(CAST(x * (1 + t) AS DECIMAL(18, 4))) AS upper, sum(CAST(x * (1 - d) AS DECIMAL(18, 4))) AS lower
FROM measured JOIN cause_map ON m_type = p_type AND p_size <= max_size GROUP BY ALL"""
CTES["numbers"] = """
SELECT nk + 2 AS location_id, sex_id, year, measure_id, cause_id, val::DOUBLE / scale AS val, upper::DOUBLE / scale AS upper,
       lower::DOUBLE / scale AS lower FROM nation_sums
UNION ALL SELECT 1, sex_id, year, measure_id, cause_id, sum(val)::DOUBLE / scale, sum(upper)::DOUBLE / scale,
       sum(lower)::DOUBLE / scale FROM nation_sums GROUP BY sex_id, year, measure_id, cause_id, scale"""
CTES["metrics"] = f"""
SELECT 1 AS metric_id, location_id, sex_id, year, measure_id, cause_id, val, upper, lower FROM numbers
UNION ALL SELECT 3, location_id, sex_id, year, measure_id, cause_id, val / people * 1e5::DOUBLE, upper / people * 1e5::DOUBLE,
       lower / people * 1e5::DOUBLE FROM numbers JOIN people USING (location_id, sex_id)
UNION ALL SELECT 2, n.location_id, n.sex_id, n.year, n.measure_id, n.cause_id, {div('n.val', 'a.val')}, {div('n.upper', 'a.upper')},
       {div('n.lower', 'a.lower')}
FROM numbers n JOIN numbers a ON a.location_id = n.location_id AND a.sex_id = n.sex_id AND a.year = n.year AND a.measure_id = n.measure_id AND a.cause_id = 294"""
CTES["gbd"] = """
SELECT * FROM metrics UNION ALL SELECT * FROM metrics WHERE location_id = 2"""
CTES["measure_names"] = """
SELECT * FROM (VALUES (1, 'Deaths'), (2, 'DALYs (Disability-Adjusted Life Years)'),
  (3, 'YLDs (Years Lived with Disability)'), (4, 'YLLs (Years of Life Lost)')) AS m(measure_id, measure_name)"""
CTES["prev_share"] = """
SELECT location_id, sex_id, year, coalesce(sum(CAST(q AS DECIMAL(18, 4))) FILTER (p_type = 'STANDARD'), 0)::DOUBLE
       / sum(CAST(q AS DECIMAL(18, 4)))::DOUBLE AS f
FROM (SELECT nk + 2 AS location_id, sex_id, year, p_type, q FROM base UNION ALL SELECT 1, sex_id, year, p_type, q FROM base) GROUP BY ALL"""
CTES["prev"] = """
SELECT location_id, sex_id, year, 'val' AS numeric_name, f AS prevalence FROM prev_share
UNION ALL SELECT location_id, sex_id, year, 'upper', f * 1.1::DOUBLE FROM prev_share
UNION ALL SELECT location_id, sex_id, year, 'lower', f * 0.9::DOUBLE FROM prev_share"""
CTES["long"] = """
SELECT metric_id, location_id, sex_id, year, measure_id, cause_id, 'val' AS numeric_name, val AS est FROM gbd
UNION ALL SELECT metric_id, location_id, sex_id, year, measure_id, cause_id, 'upper', upper FROM gbd
UNION ALL SELECT metric_id, location_id, sex_id, year, measure_id, cause_id, 'lower', lower FROM gbd"""
CTES["pairs"] = """
SELECT DISTINCT n.location_id, n.sex_id, n.year, n.measure_id, n.cause_id, n.numeric_name, n.est AS number, t.est AS rate
FROM long n LEFT JOIN (SELECT * FROM long WHERE metric_id = 3) t USING (location_id, sex_id, year, measure_id, cause_id, numeric_name)
WHERE n.metric_id = 1"""
CTES["pop"] = f"""
SELECT location_id, sex_id, year, measure_id, cause_id, numeric_name, number, {div('number', 'rate')} AS population_100k,
       {div('number', 'rate')} * 100000 AS population FROM pairs WHERE measure_id <> 5"""
CTES["weights"] = """
SELECT cause_id, numeric_name, CASE WHEN cause_id IN (630, 631) THEN share
       WHEN cause_id = 639 THEN half ELSE 1.0::DOUBLE END AS weight
FROM (VALUES (558), (543), (544), (545), (547), (548), (718), (560), (561), (630), (631), (639)) AS c(cause_id)
CROSS JOIN (VALUES ('val', 2.0::DOUBLE / 6, 1.0::DOUBLE / 2 * 2 / 6), ('lower', 1.0::DOUBLE / 6, 1.0::DOUBLE / 2 * 1 / 6),
  ('upper', 3.0::DOUBLE / 6, 1.0::DOUBLE / 2 * 3 / 6)) AS b(numeric_name, share, half)"""
CTES["risks"] = """
SELECT * FROM (VALUES (409, 'val', 1.8::DOUBLE), (409, 'lower', 1.71::DOUBLE), (409, 'upper', 1.88::DOUBLE),
  (687, 'val', 7.22::DOUBLE), (687, 'lower', 6.43::DOUBLE), (687, 'upper', 8.12::DOUBLE)) AS r(cause_id, numeric_name, relative_risk)"""
CTES["allocated"] = """
SELECT p.*, number * CASE WHEN cause_id = 558 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS original_value,
       number * coalesce(weight, 0.0::DOUBLE) AS realloc_value
FROM pop p LEFT JOIN weights USING (cause_id, numeric_name)"""
CTES["fractions"] = """
SELECT a.*, relative_risk, prevalence, coalesce(prevalence * (relative_risk - 1)
         / nullif(prevalence * (relative_risk - 1) + 1, 0), 0.0::DOUBLE) AS paf2,
       coalesce(prevalence * ((relative_risk - 1) / nullif(relative_risk, 0)), 0.0::DOUBLE) AS paf4
FROM allocated a LEFT JOIN risks USING (cause_id, numeric_name) LEFT JOIN prev USING (location_id, sex_id, year, numeric_name)"""
CTES["attributed"] = """
SELECT location_id, sex_id, year, measure_id, cause_id, numeric_name, number, population_100k, population, prevalence, relative_risk,
       original_value, realloc_value, 'paf2' AS paf_formula, paf2 AS paf, number * paf2 AS paf_value FROM fractions
UNION ALL SELECT location_id, sex_id, year, measure_id, cause_id, numeric_name, number, population_100k, population, prevalence,
       relative_risk, original_value, realloc_value, 'paf4', paf4, number * paf4 FROM fractions"""


def na_sum(x: str) -> str:
    return f"CASE WHEN count(*) = count({x}) THEN sum({x}) END"


CTES["sums"] = f"""
SELECT location_id, sex_id, year, measure_id, numeric_name, paf_formula, {na_sum('original_value')} AS original_agg,
       {na_sum('realloc_value')} AS realloc_agg, {na_sum('paf_value')} AS paf_agg
FROM attributed GROUP BY ALL"""
CTES["totals"] = """
SELECT s.*, a.number AS measure_total, a.population_100k, a.population, a.prevalence
FROM sums s JOIN attributed a USING (location_id, sex_id, year, measure_id, numeric_name, paf_formula) WHERE a.cause_id = 294"""
CTES["combined"] = """
SELECT t.*, d.dalys AS composite_dalys,
       CASE t.measure_id WHEN 2 THEN d.dalys WHEN 3 THEN realloc_agg ELSE paf_agg END AS composite
FROM totals t JOIN (
  SELECT location_id, sex_id, year, numeric_name, paf_formula,
         sum(CASE WHEN measure_id = 3 THEN realloc_agg ELSE 0 END)
         + sum(CASE WHEN measure_id = 4 THEN paf_agg ELSE 0 END) AS dalys
  FROM totals GROUP BY ALL) d USING (location_id, sex_id, year, numeric_name, paf_formula)"""
CTES["est_both"] = f"""
SELECT *, {div('number', 'population_100k')} AS rate_per_100k, {div('number', 'measure_total')} * 100 AS percent FROM (
  SELECT location_id, sex_id, year, measure_id, numeric_name, paf_formula, measure_total, population_100k, population,
         1 AS estimate_id, 'GBD 2019' AS estimate, original_agg AS number FROM combined
  UNION ALL SELECT location_id, sex_id, year, measure_id, numeric_name, paf_formula, measure_total, population_100k, population,
         2, '2016 reallocation approach', realloc_agg FROM combined
  UNION ALL SELECT location_id, sex_id, year, measure_id, numeric_name, paf_formula, measure_total, population_100k, population,
         3, 'PAF method', paf_agg FROM combined
  UNION ALL SELECT location_id, sex_id, year, measure_id, numeric_name, paf_formula, measure_total, population_100k, population,
         4, 'Composite method', composite FROM combined)"""
CTES["money"] = f"""
SELECT e.*, c.iso_code, c.location_name, i.income_level, coalesce(w.gdp, g.gdp) AS gdp,
       coalesce(wp.gdp_ppp, p.gdp_ppp) AS gdp_ppp,
       {div('coalesce(w.gdp, g.gdp)', 'population')} AS gdp_per_capita,
       {div('coalesce(wp.gdp_ppp, p.gdp_ppp)', 'population')} AS gdp_ppp_per_capita
FROM est_both e LEFT JOIN crosswalk c USING (location_id)
LEFT JOIN (SELECT DISTINCT iso_code, income_level FROM income) i ON i.iso_code IS NOT DISTINCT FROM c.iso_code
LEFT JOIN gdp g ON g.iso_code = c.iso_code LEFT JOIN gdp_ppp p ON p.iso_code = c.iso_code
LEFT JOIN gdp w ON e.location_id = 1 AND w.iso_code = 'WLD'
LEFT JOIN gdp_ppp wp ON e.location_id = 1 AND wp.iso_code = 'WLD'"""


def costs(number: str, per_capita: str, ppp_per_capita: str) -> str:
    def when(x: str) -> str:
        return f"CASE WHEN measure_id IS NULL THEN NULL WHEN measure_id = 2 THEN {x} ELSE 0.0::DOUBLE END"

    cc1 = when(f"{number} * 1000")
    who1 = when(f"{number} * {per_capita}")
    who3 = when(f"{number} * {ppp_per_capita}")
    parts = [cc1, f"({cc1}) * 5", who1, f"({who1}) * 3", who3, f"({who3}) * 3"]
    return ", ".join(f"{p} AS {c}" for p, c in zip(parts, COSTS))


CTES["valued_both"] = f"""
SELECT *, {costs('number', 'gdp_per_capita', 'gdp_ppp_per_capita')} FROM money"""
CTES["valued"] = """
SELECT v.*, measure_name FROM valued_both v JOIN measure_names USING (measure_id) WHERE paf_formula = 'paf2'"""
CTES["national"] = f"""
SELECT v.*, {', '.join(f'v.{m} - b.{m} AS {m}_diff' for m in METRICS)}
FROM valued v JOIN valued b USING (location_id, sex_id, year, measure_id, numeric_name) WHERE b.estimate_id = 1"""
CTES["regional"] = """
SELECT v.* EXCLUDE (iso_code), coalesce(v.iso_code, g.iso_code) AS iso_code, who_region, ihme_region
FROM valued v FULL JOIN region_dim g ON v.iso_code IS NOT DISTINCT FROM g.iso_code"""
for scheme in ("who_region", "ihme_region"):
    CTES[f"{scheme}_sums"] = f"""
SELECT {scheme} AS region, sex_id, year, measure_id, measure_name, numeric_name, estimate_id, estimate,
       {na_sum('population_100k')} AS pop100k, {na_sum('number')} AS number, {na_sum('measure_total')} AS measure_total,
       coalesce(sum(gdp), 0) AS gdp, coalesce(sum(gdp_ppp), 0) AS gdp_ppp
FROM regional GROUP BY ALL"""
    CTES[f"{scheme}_rates"] = f"""
SELECT *, {div('number', 'pop100k')} AS rate_per_100k, {div('number', 'measure_total')} * 100 AS percent,
       {div('gdp', 'pop100k * 100000')} AS gdp_per_capita, {div('gdp_ppp', 'pop100k * 100000')} AS gdp_ppp_per_capita
FROM {scheme}_sums"""
    CTES[f"{scheme}_roll"] = f"""
SELECT *, {costs('number', 'gdp_per_capita', 'gdp_ppp_per_capita')} FROM {scheme}_rates"""
    CTES[f"{scheme}_comp"] = f"""
SELECT v.*, {', '.join(f'v.{m} - b.{m} AS {m}_diff' for m in METRICS)}
FROM {scheme}_roll v LEFT JOIN (SELECT * FROM {scheme}_roll WHERE estimate_id = 1) b
  ON b.region IS NOT DISTINCT FROM v.region AND b.sex_id = v.sex_id AND b.year = v.year AND b.measure_id = v.measure_id AND b.numeric_name = v.numeric_name"""
CTES["income_names"] = """
SELECT * FROM (VALUES ('H', 1, 'High income'), ('UM', 2, 'Upper-middle income'), ('LM', 3, 'Lower-middle income'),
  ('L', 4, 'Low income')) AS i(income_level, income_rank, income_name)"""
CTES["income_sums"] = f"""
SELECT income_level, sex_id, year, measure_id, measure_name, numeric_name, estimate_id, estimate, {na_sum('number')} AS number,
       {na_sum('measure_total')} AS measure_total
FROM valued WHERE estimate_id <> 3 AND income_level IS NOT NULL GROUP BY ALL"""
CTES["income_cost_sums"] = f"""
SELECT income_level, sex_id, year, numeric_name, estimate, {', '.join(f'coalesce(sum({c}), 0) AS {c}' for c in COSTS)}
FROM valued WHERE measure_id = 2 AND estimate_id <> 3 AND income_level IS NOT NULL GROUP BY ALL"""
CTES["t1"] = f"""
SELECT sex_id, year, measure_name, location_name, 1 AS section, 1 AS place_rank, numeric_name, estimate,
       {once(f'number / {NUMBER_UNIT}', 1)} AS number, {once('percent', 1)} AS percent
FROM valued WHERE location_id = 1 AND estimate_id <> 3
UNION ALL SELECT sex_id, year, measure_name, income_name, 2, income_rank, numeric_name, estimate,
       {once(f'number / {NUMBER_UNIT}', 1)}, {once(div('number', 'measure_total') + ' * 100', 1)}
FROM income_sums JOIN income_names USING (income_level)
UNION ALL SELECT sex_id, year, measure_name, region, 3, 1, numeric_name, estimate,
       {once(f'number / {NUMBER_UNIT}', 1)}, {once(div('number', 'measure_total') + ' * 100', 1)}
FROM ihme_region_sums WHERE region IS NOT NULL AND estimate_id <> 3"""
CTES["t2_wide"] = f"""
SELECT sex_id, year, 'Global' AS location_name, 1 AS section, 1 AS place_rank, numeric_name, estimate, {', '.join(COSTS)}
FROM valued WHERE location_id = 1 AND measure_id = 2 AND estimate_id <> 3
UNION ALL SELECT sex_id, year, income_name, 2, income_rank, numeric_name, estimate, {', '.join(COSTS)}
FROM income_cost_sums JOIN income_names USING (income_level)
UNION ALL SELECT sex_id, year, region, 3, 1, numeric_name, estimate, {', '.join(COSTS)}
FROM ihme_region_roll WHERE region IS NOT NULL AND measure_id = 2 AND estimate_id <> 3"""
CTES["t2"] = " UNION ALL ".join(
    f"SELECT sex_id, year, location_name, section, place_rank, numeric_name, estimate, '{c}' AS name, "
    f"{once(f'{c} / {COST_UNIT}', 2)} AS value FROM t2_wide"
    for c in COSTS
)
CTES["t1_pivot"] = "SELECT sex_id, year, measure_name, location_name, section, place_rank, " + ", ".join(
    f"max({m}) FILTER (numeric_name = '{b}' AND estimate = '{e}') AS \"{b}_{m}_{e}\""
    for e in ESTIMATES for m in ("number", "percent") for b in BOUNDS
) + " FROM t1 GROUP BY ALL"
CTES["t2_pivot"] = "SELECT sex_id, year, name, location_name, section, place_rank, " + ", ".join(
    f"max(value) FILTER (numeric_name = '{b}' AND estimate = '{e}') AS \"{b}_{e}\"" for e in ESTIMATES for b in BOUNDS
) + " FROM t2 GROUP BY ALL"
LABEL = (
    "CASE estimate_id WHEN 1 THEN 'Original approach' WHEN 2 THEN 'Reallocation approach' "
    "WHEN 3 THEN 'PAF method' WHEN 4 THEN 'Composite approach' END AS estimate_label"
)
CTES["mapped"] = """
SELECT n.*, p.gu_a3, p.adm0_a3, p.iso_code IS NOT NULL AS on_map
FROM polygons p RIGHT JOIN national n ON n.iso_code IS NOT DISTINCT FROM p.iso_code WHERE n.numeric_name = 'val'"""
CTES["mapped_regional"] = """
SELECT n.*, p.gu_a3, p.iso_code IS NOT NULL AS on_map
FROM polygons p RIGHT JOIN regional n ON n.iso_code IS NOT DISTINCT FROM p.iso_code WHERE n.numeric_name = 'val'"""
CTES["evidence"] = """
SELECT ihme_region, 'inputs_mental' AS input, count(*) FILTER (p_type = 'STANDARD') AS count
FROM base JOIN iso USING (nk) JOIN region_dim USING (iso_code) WHERE ihme_region IS NOT NULL GROUP BY ihme_region
UNION ALL SELECT ihme_region, 'inputs_maternal', count(*) FILTER (p_type = 'PROMO')
FROM base JOIN iso USING (nk) JOIN region_dim USING (iso_code) WHERE ihme_region IS NOT NULL GROUP BY ihme_region"""

# Uniform draws: four 32-bit slices of one hash per order.
CTES["hashed"] = "SELECT o_orderkey AS draw_id, o_custkey, year(o_orderdate)::INTEGER AS year, md5(o_orderkey::VARCHAR || ':82420212') AS h FROM orders"
CTES["uniforms"] = "SELECT draw_id, o_custkey, year, " + ", ".join(
    f"(('0x' || substr(h, {8 * k + 1}, 8))::UBIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u{k + 1}" for k in range(4)
) + " FROM hashed"
TWO_PI = "6.283185307179586::DOUBLE"
CTES["normals"] = f"""
SELECT *, sqrt(-2 * ln(u1)) * cos(u2 * {TWO_PI}) AS z1, sqrt(-2 * ln(u1)) * sin(u2 * {TWO_PI}) AS z2,
       sqrt(-2 * ln(u3)) * cos(u4 * {TWO_PI}) AS z3 FROM uniforms"""
SD = "3.92::DOUBLE"
RISK = f"2.22::DOUBLE + {{z}} * ((2.33::DOUBLE - 2.12::DOUBLE) / {SD})"
CTES["order_params"] = """
SELECT d.*, c_nationkey + 2 AS location_id, (1 + c_custkey % 2)::INTEGER AS sex_id, f, n.val, n.upper, n.lower
FROM normals d JOIN customer ON c_custkey = o_custkey
LEFT JOIN prev_share ps ON ps.location_id = c_nationkey + 2 AND ps.sex_id = 1 + c_custkey % 2 AND ps.year = d.year
LEFT JOIN numbers n ON n.location_id = c_nationkey + 2 AND n.sex_id = 1 + c_custkey % 2 AND n.year = d.year
  AND n.measure_id = 1 AND n.cause_id = 294"""
PLACE = "draw_id, location_id, sex_id, year"
DEATHS = f"val + {{z}} * ((upper - lower) / {SD})"
CTES["scenario1"] = f"""
SELECT {PLACE}, f + z1 * ((f * 1.1::DOUBLE - f * 0.9::DOUBLE) / {SD}) AS prevalence,
       {RISK.format(z='z2')} AS relative_risk, {DEATHS.format(z='z3')} AS deaths FROM order_params"""
CTES["place_params"] = """
SELECT coalesce(ps.location_id, n.location_id) AS location_id, coalesce(ps.sex_id, n.sex_id) AS sex_id, coalesce(ps.year, n.year) AS year, f, n.val, n.upper, n.lower
FROM prev_share ps FULL JOIN (SELECT * FROM numbers WHERE measure_id = 1 AND cause_id = 294) n
  ON n.location_id = ps.location_id AND n.sex_id = ps.sex_id AND n.year = ps.year"""
CTES["place_ids"] = """
SELECT *, location_id || '-' || sex_id || '-' || year || '-' || no AS draw_id FROM (SELECT *, unnest(range(1000)) AS no FROM place_params)"""
CTES["place_uniforms"] = "SELECT *, " + ", ".join(
    f"(('0x' || substr(md5(draw_id || ':82420212'), {8 * k + 1}, 8))::UBIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u{k + 1}" for k in range(4)
) + " FROM place_ids"
CTES["place_normals"] = CTES["normals"].replace("FROM uniforms", "FROM place_uniforms")
CTES["place_scenario"] = CTES["scenario1"].replace("FROM order_params", "FROM place_normals")
CTES["scenario2"] = f"""
SELECT {PLACE}, 0.01::DOUBLE + u1 * (0.2::DOUBLE - 0.01::DOUBLE) AS prevalence,
       (CAST([0.5, 1.0, 1.5, 2.0, 2.5, 3.0] AS DOUBLE[]))[(floor(u2 * 6) + 1)::INTEGER] AS relative_risk,
       {DEATHS.format(z='z3')} AS deaths FROM order_params"""
CTES["scenario3"] = f"""
SELECT {PLACE}, 0.261::DOUBLE + z1 * 0.05::DOUBLE AS prevalence,
       (2.22::DOUBLE - 0.5::DOUBLE) + u3 * (2.72::DOUBLE - (2.22::DOUBLE - 0.5::DOUBLE)) AS relative_risk,
       {DEATHS.format(z='z2')} AS deaths FROM order_params"""


def paf_rows(scenario: str, extra: str = "") -> str:
    population = div("prevalence * (relative_risk - 1)", "prevalence * (relative_risk - 1) + 1")
    cases = f"prevalence * {div('relative_risk - 1', 'relative_risk')}"
    return " UNION ALL ".join(
        f"SELECT draw_id, {extra} prevalence, relative_risk, deaths, '{n}' AS formula, {p} AS paf, deaths * {p} AS deaths_mh FROM {scenario}"
        for n, p in (("TotalPop", population), ("Cases", cases))
    )


def summary(keys: str, value: str, source: str, digits: int, more: str = "") -> str:
    quantiles = ", ".join(
        f"{r(f'quantile_cont({value}, {p})', digits)} AS {n}" for n, p in (("p025", 0.025), ("p500", 0.5), ("p975", 0.975))
    )
    return (
        f"SELECT {keys}, count({value}) AS draws, {r(f'avg({value})', digits)} AS mean, "
        f"{r(f'stddev_samp({value})', digits)} AS sd, {quantiles}{more} FROM ({source}) GROUP BY ALL"
    )


def diffs(prefix: str = "") -> str:
    return ", ".join(f"{r(f'{m}_diff', D[m])} AS {prefix}{m}_diff" for m in METRICS)


def rolled(scheme: str) -> str:
    cols = ["number", "measure_total", "gdp", "gdp_ppp", "pop100k", "rate_per_100k", "percent", *COSTS]
    picked = ", ".join(f"{r(c, D[c])} AS {scheme}_{c}" for c in cols)
    return f"SELECT region AS {scheme}, sex_id, year, measure_id, numeric_name, estimate_id, {picked} FROM {scheme}_roll"


def chart(source: str, ids: str, metrics, extra: str, scale: str | None = None, where: str = "true") -> str:
    parts = []
    for m in metrics:
        for comparison, suffix, chosen in (("abs", "", "1, 2, 4"), ("diff", "_diff", "2, 4")):
            value = f"{m}{suffix}" if scale is None else f"{div(f'{m}{suffix}', scale)} * 100"
            parts.append(
                f"SELECT {ids}, sex_id, year, measure_id, estimate_id, '{m}' AS metric, '{comparison}' AS comparison, {value} AS raw, {LABEL} "
                f"FROM {source} WHERE numeric_name = 'val' AND estimate_id IN ({chosen}) AND {where}"
            )
    return f"SELECT * EXCLUDE (raw), {extra} FROM ({' UNION ALL '.join(parts)})"


def both(make) -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({make(s)})" for s in ("who_region", "ihme_region"))


VALUE = f"{r('raw', 5)} AS value"
CLAMPED = f"{VALUE}, {r('CASE WHEN raw IS NOT NULL THEN least(greatest(raw, 0), 20) END', 5)} AS clamped"


def polygon_fill(scheme: str) -> str:
    return (
        f"(SELECT '{scheme}' AS scheme, c.*, m.iso_code, m.gu_a3, m.on_map, m.location_id FROM mapped_regional m "
        f"JOIN {scheme}_comp c ON c.region IS NOT DISTINCT FROM m.{scheme} AND c.sex_id = m.sex_id AND c.year = m.year "
        f"AND c.measure_id = m.measure_id AND c.estimate_id = m.estimate_id AND c.numeric_name = 'val')"
    )


def bars(scheme: str, metrics, scale=None, where="true") -> str:
    order = ["AFRICA", "AMERICA", "ASIA", "EUROPE"]
    if scheme == "ihme_region":
        order = [f"{o}-{i}" for o in order for i in (1, 0)]
    rank = "CASE region " + " ".join(f"WHEN '{o}' THEN {i}" for i, o in enumerate(order, 1)) + " END AS region_rank"
    source = f"(SELECT '{scheme}' AS scheme, * FROM {scheme}_comp WHERE region IS NOT NULL)"
    return chart(source, "scheme, region", metrics, f"{VALUE}, {rank}, {once('raw', 1)} AS label", scale, where)


BREAKS = {
    "deaths": (1, 1, (0, 1, 20, 40, 60, 80, 100, 120, 130, 140)),
    "dalys": (2, 1000, (1, 1.5, 2, 2.5, 3, 4, 5, 6, 7, 7.5)),
    "ylds": (3, 1000, (1, 1.25, 1.5, 2, 2.5, 3, 3.5, 4, 4.5, 5, 5.5)),
    "ylls": (4, 1000, (0, 0.25, 0.5, 0.75, 1, 1.5, 2, 2.5, 3, 3.5)),
}


def bins(name: str) -> str:
    """Bins as an explicit table of edges, matched by range."""
    measure, scale, fixed = BREAKS[name]
    taken = ", ".join(f"'{b:g}'" for b in fixed)

    def text(d: int) -> str:
        places = f"pow(10.0::DOUBLE, {d - 1} - floor(log10(top)))"
        return f"regexp_replace((round_even(top * {places}, 0) / {places})::VARCHAR::DECIMAL(38, 16)::VARCHAR, '\\.?0+$', '')"

    top = "coalesce(" + ", ".join(f"CASE WHEN {text(d)} NOT IN ({taken}) THEN {text(d)} END" for d in range(3, 13)) + f", {text(12)})"
    edges = " UNION ALL ".join(f"SELECT {float(b)}::DOUBLE AS edge, '{b:g}' AS label" for b in fixed)
    return f"""
WITH x AS (SELECT region, sex_id, year, measure_id, estimate_id, rate_per_100k / {float(scale)}::DOUBLE AS rate, {LABEL}
           FROM ihme_region_roll WHERE numeric_name = 'val' AND measure_id = {measure} AND region IS NOT NULL
             AND estimate_id IN (1, 2, 4)),
tops AS (SELECT sex_id, year, max(rate) AS top FROM x GROUP BY ALL),
e AS (SELECT sex_id, year, edge, label FROM tops CROSS JOIN ({edges}) UNION ALL SELECT sex_id, year, top, {top} FROM tops),
b AS (SELECT sex_id, year, row_number() OVER w::INTEGER AS bin, edge AS lo, lead(edge) OVER w AS hi,
        '(' || label || ',' || lead(label) OVER w || ']' AS bin_label FROM e WINDOW w AS (PARTITION BY sex_id, year ORDER BY edge))
SELECT region, x.sex_id, x.year, measure_id, estimate_id, {r('rate', 6)} AS rate, bin, {r('lo', 6)} AS bin_low, {r('hi', 6)} AS bin_high,
       bin_label, estimate_label FROM x LEFT JOIN b ON b.sex_id = x.sex_id AND b.year = x.year AND rate > lo AND rate <= hi"""


def floor_to(x: str) -> str:
    return f"(floor(({x}) * 10) / 10)"


NAMES = (
    "dalys_composite_rounded", "percent_composite_floor", "dalys_gbd_rounded", "cost_composite_floor",
    "highest_share_regions", "highest_share", "lowest_share_regions", "lowest_share",
    "dalys_gbd_floor", "percent_gbd_rounded", "percent_realloc_floor", "dalys_realloc_floor",
    "dalys_high_income", "dalys_low_income", "cost_composite", "cost_realloc", "cost_gbd",
)


def headline() -> str:
    dalys = "measure_name = 'DALYs (Disability-Adjusted Life Years)'"

    def of(table: str, column: str, where: str) -> str:
        return f'(SELECT max("{column}") FROM {table} t WHERE t.sex_id = k.sex_id AND t.year = k.year AND {where})'

    t1 = lambda c, place="Global": of("t1_pivot", c, f"{dalys} AND location_name = '{place}'")
    t2 = lambda c: of("t2_pivot", c, "name = 'cost_who1' AND location_name = 'Global'")
    values = [
        once(t1("val_number_Composite method"), 0), f"floor({t1('val_percent_Composite method')})",
        once(t1("val_number_GBD 2019"), 0), floor_to(t2("val_Composite method")),
    ]
    for end in ("max", "min"):
        ends = f"FROM shares s WHERE s.sex_id = k.sex_id AND s.year = k.year AND pct = {end}_pct"
        values += [f"(SELECT string_agg(region, '; ' ORDER BY region) {ends})", f"(SELECT {once('max(pct)', 1)} {ends})"]
    values += [
        f"floor({t1('val_number_GBD 2019')})", once(t1("val_percent_GBD 2019"), 0),
        f"floor({t1('val_percent_2016 reallocation approach')})", f"floor({t1('val_number_2016 reallocation approach')})",
        once(t1("val_number_Composite method", "High income"), 0), once(t1("val_number_Composite method", "Low income"), 0),
        t2("val_Composite method"), t2("val_2016 reallocation approach"), t2("val_GBD 2019"),
    ]
    inner = ", ".join(f"{v} AS {n}" for v, n in zip(values, NAMES))
    top, low = "dalys_composite_rounded", "dalys_gbd_floor"
    gradient = div("dalys_high_income", "dalys_low_income")
    return f"""
WITH shares AS (SELECT *, max(pct) OVER (PARTITION BY sex_id, year) AS max_pct, min(pct) OVER (PARTITION BY sex_id, year) AS min_pct
  FROM (SELECT region, sex_id, year, {div('cost_who1', 'gdp')} * 100 AS pct FROM ihme_region_roll WHERE measure_id = 2
  AND estimate_id = 4 AND numeric_name = 'val' AND region IS NOT NULL AND gdp <> 0 AND cost_who1 IS NOT NULL)),
k AS (SELECT DISTINCT sex_id, year FROM t1),
h AS (SELECT k.sex_id, k.year, {inner}, {t2("lower_Composite method")} AS d1, {t2("upper_Composite method")} AS d2 FROM k)
SELECT sex_id, year, {', '.join(NAMES)}, {div(top, 'dalys_gbd_rounded')} > 3 AS more_than_threefold,
  CASE WHEN {gradient} > 2.4 THEN 'over twice' WHEN {gradient} > 2 THEN 'roughly twice'
       WHEN {gradient} IS NOT NULL THEN 'approximately twice' END AS income_gradient,
  {top} - dalys_realloc_floor AS added_by_composite, {floor_to('cost_composite - cost_realloc')} AS cost_over_realloc,
  {floor_to('cost_composite - cost_gbd')} AS cost_over_gbd, {top} - {low} AS underestimate,
  {once(div(f'{top} - {low}', top) + ' * 100', 0)} AS underestimate_percent,
  {floor_to('cost_composite_floor - 2.9::DOUBLE')} AS over_earlier_projection, {floor_to('d1')} AS cost_range_low,
  {floor_to('d2')} AS cost_range_high FROM h"""


def appendix() -> str:
    cells = [(e, b) for e in sorted(ESTIMATES) for b in BOUNDS]

    def row(field: str, value: str) -> str:
        cols = ", ".join(
            f"max({value}) FILTER (estimate = '{e}' AND numeric_name = '{b}') AS \"{i}\"" for i, (e, b) in enumerate(cells, 1)
        )
        return f"SELECT sex_id, year, '{field}' AS field, {cols} FROM valued WHERE location_id = 1 AND measure_id = 2 AND estimate_id <> 3 GROUP BY ALL"

    rows = [row("estimate", "estimate"), row("numeric_name", "numeric_name")]
    for c in ("cost_cc1", "cost_cc2", "cost_who3", "cost_who4"):
        text = f"regexp_replace(round_even({c} / {COST_UNIT}, 2)::DECIMAL(30, 2)::VARCHAR, '\\.?0+$', '')"
        rows.append(row(c, text))
    return " UNION ALL ".join(rows)


T1_COLS = ", ".join(f'"{b}_{m}_{e}"' for e in ESTIMATES for m in ("number", "percent") for b in BOUNDS)
T2_COLS = ", ".join(f'"{b}_{e}"' for e in ESTIMATES for b in BOUNDS)
KEYS4 = "location_id, sex_id, year, measure_id, numeric_name"
STACK_ORDER = "CASE ihme_region " + " ".join(
    f"WHEN '{o}-{i}' THEN {2 * k + (1 if i == 1 else 2)}"
    for k, o in enumerate(("AFRICA", "AMERICA", "ASIA", "EUROPE")) for i in (1, 0)
) + " END"

FINAL: dict[str, str] = {
    "unpivot_bounds": f"SELECT measure_id, location_id, sex_id, year, cause_id, metric_id, numeric_name, {r('est', 6)} AS est FROM long",
    "enrich_dims": f"""SELECT DISTINCT g.measure_id, g.location_id, sex_id, year, location_name, cause_id, metric_id, c.iso_code, income_level,
        {r('val', 6)} AS val, {r('upper', 6)} AS upper, {r('lower', 6)} AS lower
        FROM gbd g LEFT JOIN crosswalk c USING (location_id) LEFT JOIN income i ON i.iso_code IS NOT DISTINCT FROM c.iso_code""",
    "nullsafe_join": """SELECT location_id, c.iso_code, income_level, count(*) AS rows FROM gbd LEFT JOIN crosswalk c USING (location_id)
        LEFT JOIN income i ON i.iso_code IS NOT DISTINCT FROM c.iso_code GROUP BY ALL""",
    "workbook_dims": """SELECT location_id, location_name, c.iso_code, sex_id, income_level, who_region, ihme_region, people
        FROM crosswalk c JOIN people USING (location_id)
        LEFT JOIN (SELECT DISTINCT * FROM income) i ON i.iso_code IS NOT DISTINCT FROM c.iso_code
        LEFT JOIN region_dim d ON d.iso_code IS NOT DISTINCT FROM c.iso_code""",
    "iso_repair": """SELECT gu_a3, adm0_a3, p.iso_code, sex_id, people FROM polygons p
        LEFT JOIN (SELECT iso_code, sex_id, people FROM people JOIN crosswalk USING (location_id)) c ON c.iso_code IS NOT DISTINCT FROM p.iso_code""",
    "scan_gdp": f"SELECT iso_code, {r('gdp', 2)} AS gdp FROM gdp",
    "world_gdp_override": f"""SELECT location_id, sex_id, c.iso_code,
        {r("CASE WHEN location_id = 1 THEN (SELECT gdp FROM gdp WHERE iso_code = 'WLD') ELSE gdp END", 2)} AS gdp,
        {r("CASE WHEN location_id = 1 THEN (SELECT gdp_ppp FROM gdp_ppp WHERE iso_code = 'WLD') ELSE gdp_ppp END", 2)} AS gdp_ppp
        FROM people JOIN crosswalk c USING (location_id) LEFT JOIN gdp g ON g.iso_code = c.iso_code
        LEFT JOIN gdp_ppp p ON p.iso_code = c.iso_code""",
    "number_rate_join": f"SELECT measure_id, location_id, sex_id, year, cause_id, numeric_name, {r('number', 2)} AS number, {r('rate', 6)} AS rate FROM pairs",
    "population": f"""SELECT measure_id, location_id, sex_id, year, cause_id, numeric_name, {r('number', 2)} AS number,
        {r('population_100k', 8)} AS population_100k, {r('population', 3)} AS population FROM pop""",
    "original_values": f"""SELECT measure_id, location_id, sex_id, year, cause_id, numeric_name, {r('number', 2)} AS number,
        {r('original_value', 4)} AS original_value FROM allocated""",
    "realloc_values": f"""SELECT measure_id, location_id, sex_id, year, cause_id, numeric_name, {r('number', 2)} AS number,
        {r('realloc_value', 4)} AS realloc_value FROM allocated""",
    "paf": f"""SELECT measure_id, location_id, sex_id, year, cause_id, numeric_name, {r('prevalence', 10)} AS prevalence, relative_risk,
        {r('paf2', 10)} AS paf2, {r('paf4', 10)} AS paf4 FROM fractions""",
    "paf_values": f"""SELECT measure_id, location_id, sex_id, year, cause_id, numeric_name, paf_formula, {r('paf', 10)} AS paf,
        {r('paf_value', 4)} AS paf_value FROM attributed""",
    "window_totals": f"""SELECT measure_id, location_id, sex_id, year, cause_id, numeric_name, {r('realloc_value', 4)} AS realloc_value,
        {r('original_value', 4)} AS original_value,
        {r('sum(realloc_value) OVER w', 2)} AS realloc_agg, {r('sum(original_value) OVER w', 2)} AS original_agg
        FROM allocated WINDOW w AS (PARTITION BY location_id, sex_id, year, measure_id, numeric_name)""",
    "cause_totals": f"""SELECT a.location_id, a.sex_id, a.year, a.measure_id, a.numeric_name, {r('a.original_agg', 2)} AS original_agg,
        {r('a.realloc_agg', 2)} AS realloc_agg, {r('a.paf_agg', 2)} AS paf2_agg, {r('b.paf_agg', 2)} AS paf4_agg,
        {r('a.measure_total', 2)} AS measure_total, {r('a.population_100k', 8)} AS population_100k,
        {r('a.population', 3)} AS population, {r('a.prevalence', 10)} AS prevalence
        FROM totals a JOIN totals b USING (location_id, sex_id, year, measure_id, numeric_name)
        WHERE a.paf_formula = 'paf2' AND b.paf_formula = 'paf4'""",
    "composite_dalys": f"""SELECT location_id, sex_id, year, numeric_name, paf_formula, {r('composite_dalys', 2)} AS composite_dalys
        FROM combined WHERE measure_id = 2""",
    "composite_estimates": f"""SELECT {KEYS4}, paf_formula, {r('original_agg', 2)} AS original_agg, {r('realloc_agg', 2)} AS realloc_agg,
        {r('paf_agg', 2)} AS paf_agg, {r('composite', 2)} AS composite, 'Mental disorders' AS cause_name FROM combined""",
    "estimate_ids": f"""SELECT {KEYS4}, paf_formula, estimate, estimate_id, {r('number', 2)} AS number FROM est_both
        WHERE paf_formula = 'paf2'""",
    "burden_rates": f"""SELECT {KEYS4}, estimate_id, {r('number', 2)} AS number, {r('rate_per_100k', 4)} AS rate_per_100k,
        {r('percent', 6)} AS percent FROM est_both WHERE paf_formula = 'paf2'""",
    "gdp_per_capita": f"""SELECT {KEYS4}, {r('gdp', 2)} AS gdp, {r('gdp_per_capita', 6)} AS gdp_per_capita, {r('gdp_ppp', 2)} AS gdp_ppp,
        {r('gdp_ppp_per_capita', 6)} AS gdp_ppp_per_capita FROM money WHERE paf_formula = 'paf2' AND estimate_id = 1""",
    **{
        name: f"SELECT {KEYS4}, paf_formula, estimate_id, {', '.join(f'{r(c, 0)} AS {c}' for c in COSTS)} "
        f"FROM valued_both WHERE paf_formula = '{formula}'"
        for name, formula in (("valuation", "paf2"), ("valuation_paf4", "paf4"))
    },
    "diff_national": f"SELECT {KEYS4}, estimate_id, {diffs()} FROM national",
    "region_full_join": f"""SELECT iso_code, location_id, sex_id, year, measure_id, numeric_name, estimate_id, who_region, ihme_region,
        {r('number', 2)} AS number FROM regional""",
    "region_members": """SELECT scheme, region, string_agg(DISTINCT iso_code, ',' ORDER BY iso_code) AS members FROM (
        SELECT 'who_region' AS scheme, who_region AS region, iso_code FROM region_dim WHERE who_region IS NOT NULL
        UNION ALL SELECT 'ihme_region', ihme_region, iso_code FROM region_dim WHERE ihme_region IS NOT NULL) GROUP BY scheme, region""",
    "na_sum": f"SELECT who_region, sex_id, year, measure_id, numeric_name, estimate_id, {r(na_sum('gdp'), 2)} AS gdp FROM regional GROUP BY ALL",
    "na_rm_sum": f"""SELECT who_region, sex_id, year, measure_id, numeric_name, estimate_id, {r('coalesce(sum(gdp), 0)', 2)} AS gdp,
        {r('coalesce(sum(gdp_ppp), 0)', 2)} AS gdp_ppp FROM regional GROUP BY ALL""",
    "region_rollup": f"""SELECT region AS ihme_region, sex_id, year, measure_name, numeric_name, estimate, {once(f'number / {NUMBER_UNIT}', 1)} AS number,
        {once(div('number', 'measure_total') + ' * 100', 1)} AS percent FROM ihme_region_sums WHERE region IS NOT NULL AND estimate_id <> 3""",
    "region_rates": f"""SELECT region AS who_region, sex_id, year, measure_id, numeric_name, estimate_id, {r('rate_per_100k', 4)} AS rate_per_100k,
        {r('percent', 6)} AS percent, {r('gdp_per_capita', 6)} AS gdp_per_capita, {r('gdp_ppp_per_capita', 6)} AS gdp_ppp_per_capita
        FROM who_region_rates""",
    "who_region_rollup": rolled("who_region"),
    "ihme_region_rollup": rolled("ihme_region"),
    **{
        f"{s}_diff": f"SELECT region AS {s}, sex_id, year, measure_id, numeric_name, estimate_id, {diffs(s + '_')} FROM {s}_comp"
        for s in ("who_region", "ihme_region")
    },
    "income_burden": f"""SELECT income_level, sex_id, year, measure_name, numeric_name, estimate, {r('number', 2)} AS number,
        {r('measure_total', 2)} AS measure_total, {r(div('number', 'measure_total') + ' * 100', 6)} AS percent FROM income_sums""",
    "income_ranked": f"""SELECT row_number() OVER (PARTITION BY sex_id, year ORDER BY income_rank, measure_name, numeric_name, estimate)::INTEGER
        AS row_index, sex_id, year, income_rank, income_name, measure_name, numeric_name, estimate, {r('number', 2)} AS number,
        {r(div('number', 'measure_total') + ' * 100', 6)} AS percent FROM income_sums JOIN income_names USING (income_level)""",
    "income_costs": f"""SELECT income_level, sex_id, year, income_name, numeric_name, estimate, {', '.join(f'{r(c, 0)} AS {c}' for c in COSTS)}
        FROM income_cost_sums JOIN income_names USING (income_level)""",
    "cost_long": " UNION ALL ".join(
        f"SELECT location_id, sex_id, year, numeric_name, estimate, '{c}' AS name, {r(c, 0)} AS value FROM valued WHERE measure_id = 2 AND estimate_id <> 3"
        for c in COSTS
    ),
    "map_join": f"""SELECT iso_code, gu_a3, adm0_a3, on_map, location_id, sex_id, year, measure_id, estimate_id, {r('number', 2)} AS number FROM mapped""",
    "national_choropleth": chart("mapped", "iso_code, location_id, on_map", ("rate_per_100k", "percent"), VALUE),
    "pct_gdp_clamped": chart("mapped", "iso_code, location_id, on_map", CHART_COSTS, CLAMPED, "gdp", "measure_id = 2"),
    "region_choropleth": both(
        lambda s: chart(polygon_fill(s), "scheme, region, iso_code, gu_a3, on_map, location_id", ("rate_per_100k", "percent"), VALUE)
    ),
    "region_pct_gdp": both(
        lambda s: chart(polygon_fill(s), "scheme, region, iso_code, gu_a3, on_map, location_id", CHART_COSTS, CLAMPED, "gdp", "measure_id = 2")
    ),
    "region_bars": both(lambda s: bars(s, ("percent",))),
    "region_bars_gdp": both(lambda s: bars(s, CHART_COSTS, "gdp", "measure_id = 2")),
    **{f"bins_{name}": bins(name) for name in BREAKS},
    "extreme_regions": f"""WITH shares AS (SELECT region, sex_id, year, cost_who1 / gdp * 100 AS pct FROM ihme_region_roll WHERE measure_id = 2
        AND estimate_id = 4 AND numeric_name = 'val' AND region IS NOT NULL AND gdp <> 0 AND cost_who1 IS NOT NULL),
        ends AS (SELECT sex_id, year, max(pct) AS high, min(pct) AS low FROM shares GROUP BY ALL)
        SELECT region, sex_id, year, {r('pct', 6)} AS regional_percent, 'max' AS extreme FROM shares JOIN ends USING (sex_id, year) WHERE pct = high
        UNION ALL SELECT region, sex_id, year, {r('pct', 6)}, 'min' FROM shares JOIN ends USING (sex_id, year) WHERE pct = low""",
    "inputs_share": f"SELECT ihme_region, input, count, {r('count / sum(count) OVER (PARTITION BY input)', 10)} AS share FROM evidence",
    "inputs_stack": f"""SELECT ihme_region, input, count, {STACK_ORDER} AS region_rank,
        (sum(count) OVER w - count)::BIGINT AS stack_start, (sum(count) OVER w)::BIGINT AS stack_end,
        (sum(count) OVER (PARTITION BY input))::BIGINT AS input_total FROM evidence
        WINDOW w AS (PARTITION BY input ORDER BY {STACK_ORDER} NULLS LAST, ihme_region)""",
    "table1_long": """SELECT sex_id, year, measure_name, location_name, numeric_name, estimate, 'number' AS metric, number AS point FROM t1
        UNION ALL SELECT sex_id, year, measure_name, location_name, numeric_name, estimate, 'percent', percent FROM t1""",
    "table1": f"SELECT sex_id, year, measure_name, location_name, {T1_COLS} FROM t1_pivot",
    "table1_indexed": f"""SELECT row_number() OVER (PARTITION BY sex_id, year ORDER BY measure_name, section, place_rank, location_name)::INTEGER
        AS row_index, sex_id, year, measure_name, location_name, {T1_COLS} FROM t1_pivot""",
    "table2_long": """SELECT sex_id, year, location_name, numeric_name, estimate,
        CASE numeric_name WHEN 'val' THEN 1 WHEN 'lower' THEN 2 ELSE 3 END AS bound_rank,
        CASE estimate WHEN 'GBD 2019' THEN 1 WHEN '2016 reallocation approach' THEN 2 ELSE 3 END AS estimate_rank, name, value FROM t2""",
    "table2": f"""SELECT row_number() OVER (PARTITION BY sex_id, year ORDER BY name, section, place_rank, location_name)::INTEGER
        AS row_index, sex_id, year, name,
        location_name, {T2_COLS} FROM t2_pivot""",
    "table_appendix": appendix(),
    "headline_metrics": headline(),
    "mc_ci": summary("location_id, sex_id, year, formula", "deaths_mh", paf_rows("scenario1", "location_id, sex_id, year,"), 6),
    **{
        name: f"""SELECT draw_id, formula, {r('prevalence', 10)} AS prevalence, {r('relative_risk', 10)} AS relative_risk,
        {r('deaths', 6)} AS deaths, {r('paf', 10)} AS paf, {r('deaths_mh', 6)} AS deaths_mh FROM ({paf_rows(scenario)})"""
        for name, scenario in (("mc_paf_long", "scenario1"), ("mc_grid_long", "scenario2"), ("mc_wide_long", "scenario3"))
    },
    "mc_uniform": summary(
        "location_id, variable", "x",
        "SELECT location_id, 'prevalence' AS variable, prevalence AS x FROM scenario2 "
        "UNION ALL SELECT location_id, 'relative_risk', relative_risk FROM scenario3", 8,
    ),
    "mc_rr_grid": summary("relative_risk, formula", "deaths_mh", paf_rows("scenario2"), 6),
    "mc_walker": "SELECT * EXCLUDE (biggest), " + r("max(biggest) OVER () / 1000000.0::DOUBLE", 8) + " AS axis_limit FROM (" + summary(
        "in_band, formula", "deaths_mh", paf_rows("scenario3", "relative_risk BETWEEN 2.12 AND 2.33 AS in_band,"), 6,
        f", {r('max(deaths_mh)', 6)} AS largest, max(deaths_mh) AS biggest",
    ) + ")",
}
FINAL["mc_place_range"] = (
    "SELECT location_id, sex_id, year, formula, count(deaths_mh) AS draws, "
    + ", ".join(f"{r(f'{f}(deaths_mh)', 6)} AS {n}" for f, n in (("avg", "mean"), ("stddev_samp", "sd"), ("min", "smallest"), ("max", "largest")))
    + f" FROM ({paf_rows('place_scenario', 'location_id, sex_id, year,')}) GROUP BY ALL"
)
FINAL["mc_sketch_runs"] = summary("location_id, formula", "deaths_mh", paf_rows("scenario1", "location_id,"), 6, ", CASE WHEN count(deaths_mh) > 0 THEN true END AS within").replace(
    f"{r('avg(deaths_mh)', 6)} AS mean, {r('stddev_samp(deaths_mh)', 6)} AS sd, ", ""
)
CTES["place_years"] = """
SELECT location_id, sex_id, year, val AS number, val * gdp / 1e9::DOUBLE AS priced
FROM numbers JOIN crosswalk USING (location_id) LEFT JOIN gdp USING (iso_code) WHERE cause_id = 294 AND measure_id = 2 AND location_id > 1"""
FINAL["burden_cube"] = f"""SELECT location_id, sex_id, year, grouping(location_id, sex_id, year)::INTEGER AS level, {r(na_sum('number'), 2)} AS number,
    {r(na_sum('priced'), 2)} AS priced, {r('coalesce(sum(priced), 0)', 2)} AS priced_known FROM place_years GROUP BY CUBE (location_id, sex_id, year)"""
FINAL["yearly_change"] = f"""WITH known AS (SELECT location_id, sex_id, year, number FROM place_years WHERE (location_id + year) % 5 <> 0)
    SELECT k.location_id, k.sex_id, k.year, {r('k.number', 2)} AS number, {r('k.number - b.number', 2)} AS number_change,
    (SELECT {r('avg(m.number)', 2)} FROM known m WHERE m.location_id = k.location_id AND m.sex_id = k.sex_id AND m.year BETWEEN k.year - 2 AND k.year) AS number_mean,
    (SELECT count(m.number) FROM known m WHERE m.location_id = k.location_id AND m.sex_id = k.sex_id AND m.year BETWEEN k.year - 2 AND k.year) AS number_years
    FROM known k LEFT JOIN known b ON b.location_id = k.location_id AND b.sex_id = k.sex_id AND b.year = k.year - 1"""
FINAL["largest_places"] = """SELECT sex_id, year, location_id, thousands, (1 + above)::INTEGER AS place_rank FROM (
    SELECT p.sex_id, p.year, p.location_id, floor(p.number / 1000)::INTEGER AS thousands,
      (SELECT count(*) FROM place_years o WHERE o.sex_id = p.sex_id AND o.year = p.year AND floor(o.number / 1000) > floor(p.number / 1000)) AS above
    FROM place_years p) WHERE above < 3"""
FINAL["distinct_customers"] = """SELECT c_nationkey + 2 AS location_id, year(o_orderdate)::INTEGER AS year, count(DISTINCT o_custkey) AS customers, true AS within
    FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL"""
FINAL["asof_indicator"] = f"""WITH placed AS (SELECT o_orderkey, c_nationkey + 2 AS location_id, o_orderdate::DATE AS day, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey),
    known AS (SELECT location_id, (date_trunc('month', day) + INTERVAL 1 MONTH)::DATE AS known_on, sum(CAST(o_totalprice AS DECIMAL(18, 4)))::DOUBLE AS turnover
        FROM placed WHERE (month(day) + location_id) % 3 = 0 GROUP BY ALL)
    SELECT o_orderkey, p.location_id, day::VARCHAR AS day, known_on::VARCHAR AS known_on, {r('turnover', 2)} AS turnover
    FROM placed p ASOF LEFT JOIN known k ON p.location_id = k.location_id AND p.day >= k.known_on"""
FINAL["interval_overlap"] = f"""WITH rates AS (SELECT DISTINCT measure_id, sex_id, year, location_id, val, lower, upper FROM gbd WHERE cause_id = 294 AND metric_id = 3)
    SELECT p.measure_id, p.sex_id, p.year, p.location_id, {r('p.val', 6)} AS rate, count(*) AS holders, min(i.location_id) AS first_holder, max(i.location_id) AS last_holder
    FROM rates p JOIN rates i ON i.measure_id = p.measure_id AND i.sex_id = p.sex_id AND i.year = p.year AND p.val BETWEEN i.lower AND i.upper
    GROUP BY p.measure_id, p.sex_id, p.year, p.location_id, p.val"""
FINAL["report_table1"] = FINAL["table1_indexed"]
FINAL["report_appendix"] = FINAL["table_appendix"]


def _closure(text: str) -> list[str]:
    """Names of the shared tables a statement needs, in definition order."""
    needed: set[str] = set()
    pending = [text]
    while pending:
        words = set(re.findall(r"\w+", re.sub(r"'[^']*'", "", pending.pop())))
        for name in words & CTES.keys() - needed:
            needed.add(name)
            pending.append(CTES[name])
    return [n for n in CTES if n in needed]


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, final in FINAL.items():
        shared = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in _closure(final))
        out[name] = (f"WITH {shared}\n" if shared else "") + f"SELECT * FROM (\n{final.strip()}\n)"
    return out
