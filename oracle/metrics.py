"""Diagnostics, tests, what-if, impact and exploration in SQL."""

import oracle.quality  # noqa: F401  (registers the raw tables used below)
from oracle.base import avg, cte, div, query, r, share

HARD = "service_type IN ('1-URGENT', '2-HIGH')"
FOCUS = "year = 2000"


def md(x: str, p: float = 0.5) -> str:
    return f"quantile_cont(({x})::DOUBLE, {p})"


CARD = f"""count(*) AS jobs, sum(revenue)::DOUBLE AS revenue, sum(total_cost)::DOUBLE AS total_cost, sum(profit)::DOUBLE AS profit, {r(share('on_time_flag'))} AS on_time,
  {r(avg('turnaround_hours'))} AS tat_mean_h, {r(md('turnaround_hours'))} AS tat_median_h, {r(avg('wait_hours'))} AS wait_h, {r(avg('late_hours'))} AS late_h, {r(share('parts_delay_flag'))} AS parts_delay,
  {r(share('qc_passed_first_time'))} AS qc_first_pass, {r(share('caused_repeat_visit'))} AS comeback, {r(share('cost_overrun_flag'))} AS overrun, {r(avg('duration_variance_hours'))} AS duration_var_h,
  {r(avg('rating'))} AS csat, {r(div('sum(profit)', 'sum(revenue)'))} AS margin, {r(div('sum(total_cost)', 'count(*)'))} AS avg_service_cost, {r(share('rating >= 4'))} AS csat_pct"""
CANC = f"count(*) AS appointments, {r(share('is_cancelled'))} AS cancellation_rate, {r(share('is_no_show'))} AS no_show_rate, {r(avg('lead_days'))} AS mean_lead_days"
UTIL = r(div("sum(service_hours)", "sum(available_hours)"))
cte("fs", "SELECT *, dayname(service_date) AS weekday, month(service_date) AS month_num FROM fact_service")
cte("fa", "SELECT * EXCLUDE (weekday), dayname(scheduled_date) AS weekday, month(scheduled_date) AS month_num, year(scheduled_date) AS year FROM fact_appointments")
cte("heads", "SELECT center_id, count(*) AS technicians, count(*) FILTER (WHERE skill_level IN ('Senior', 'Master')) AS seniors FROM technicians GROUP BY 1")
_L = ["(0, 0.6]", "(0.6, 0.7]", "(0.7, 0.8]", "(0.8, 0.9]", "(0.9, 1]", "(1, 1.1]", "(1.1, 1.2]", "(1.2, 1.4]", "(1.4, 1.6]", "(1.6, inf]"]


def lband(x: str) -> str:
    cuts = [0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.4, 1.6]
    return f"CASE WHEN {x} IS NULL OR {x} <= 0 THEN NULL " + " ".join(f"WHEN {x} <= {c} THEN '{n}'" for c, n in zip(cuts, _L)) + f" ELSE '{_L[-1]}' END"


cte("daily", f"""SELECT d.*, technicians * 7.0 AS capacity_hours, {div('booked_hours', 'technicians * 7.0')} AS load_ratio, coalesce({div('booked_hours', 'technicians * 7.0')} > 1, FALSE) AS overloaded
FROM (SELECT center_id, center_name, service_date, weekday, year, month, count(*) AS jobs, sum(estimated_hours) AS booked_hours, {avg('wait_hours')} AS wait_h, {share('on_time_flag')} AS on_time,
    count(*) FILTER (WHERE on_time_flag) AS otj, coalesce(sum(estimated_hours) FILTER (WHERE booking_channel <> 'Walk-in'), 0) AS ahead FROM fs GROUP BY ALL) d LEFT JOIN heads USING (center_id)""")
cte("fs_load", f"SELECT fs.*, load_ratio, {lband('load_ratio')} AS load_band FROM fs LEFT JOIN daily d ON d.center_id = fs.center_id AND d.service_date = fs.service_date")
cte("lines", "SELECT u.*, p.part_name, p.part_category, p.unit_cost, p.supplier_lead_days, quantity * unit_cost AS line_cost, f.center_id, f.center_name, f.year, f.parts_delay_flag FROM part_usage u JOIN parts p USING (part_id) JOIN fs f USING (work_order_id)")
cte("curve", f"SELECT load_band AS band, {share('on_time_flag')} AS rate FROM fs_load WHERE load_band IS NOT NULL GROUP BY 1")
M: dict[str, str] = {}
M["service_scorecard"] = f"SELECT service_type, {CARD} FROM fs GROUP BY 1"
M["model_scorecard"] = f"SELECT model, {CARD} FROM fs GROUP BY 1"
M["cancellation_diag"] = f"SELECT booking_channel, {CANC} FROM fa GROUP BY 1"
M["cancellation_type_diag"] = f"SELECT requested_service_type, {CANC} FROM fa GROUP BY 1"
M["cancellation_lead_diag"] = f"SELECT lead_time_band, {CANC} FROM fa GROUP BY 1"
M["utilisation_diag"] = f"SELECT center_id, month, {UTIL} AS utilisation FROM fact_technician_month GROUP BY 1, 2"
M["centre_diag"] = f"""SELECT j.* EXCLUDE (fj), c.appointments, c.cancellation_rate, c.no_show_rate, c.mean_lead_days, u.utilisation, v.utilisation_focus, h.technicians, coalesce(h.seniors, 0) AS senior_or_master_techs,
  CASE WHEN fj > 0 THEN round(fj::DOUBLE / (SELECT count(DISTINCT month) FROM fs WHERE {FOCUS})::DOUBLE / h.technicians::DOUBLE, 6) END AS jobs_per_tech_month_focus
FROM (SELECT center_id, center_name, {CARD}, {r(share("coalesce(skill_level = 'Junior', FALSE)"))} AS junior_job_share, {r(share(HARD))} AS complex_job_share, {r(share("service_type = '5-LOW'"))} AS periodic_share,
    {r(share("customer_type = 'MACHINERY'"))} AS fleet_job_share, {r(share(f'CASE WHEN {HARD} THEN on_time_flag END'))} AS complex_on_time, count(*) FILTER (WHERE {FOCUS}) AS fj FROM fs GROUP BY 1, 2) j
LEFT JOIN (SELECT center_id, {CANC} FROM fa GROUP BY 1) c USING (center_id) LEFT JOIN (SELECT center_id, {UTIL} AS utilisation FROM fact_technician_month GROUP BY 1) u USING (center_id)
LEFT JOIN (SELECT center_id, {UTIL} AS utilisation_focus FROM fact_technician_month WHERE month LIKE '2000%' GROUP BY 1) v USING (center_id) LEFT JOIN heads h USING (center_id)"""
M["monthly_diag"] = f"""SELECT * FROM (SELECT month, {CARD} FROM fs GROUP BY 1) LEFT JOIN (SELECT month, count(*) AS appointments, {r(share('is_cancelled'))} AS cancellation_rate FROM fa GROUP BY 1) USING (month)
  LEFT JOIN (SELECT month, {UTIL} AS utilisation FROM fact_technician_month GROUP BY 1) USING (month)"""
_RAW = {
    "jobs": "count(*)::DOUBLE", "revenue": "sum(revenue)::DOUBLE", "total_cost": "sum(total_cost)::DOUBLE", "profit": "sum(profit)::DOUBLE", "on_time": share("on_time_flag"), "tat_mean_h": avg("turnaround_hours"),
    "tat_median_h": md("turnaround_hours"), "wait_h": avg("wait_hours"), "late_h": avg("late_hours"), "parts_delay": share("parts_delay_flag"), "qc_first_pass": share("qc_passed_first_time"), "comeback": share("caused_repeat_visit"),
    "overrun": share("cost_overrun_flag"), "duration_var_h": avg("duration_variance_hours"), "csat": avg("rating"), "margin": div("sum(profit)", "sum(revenue)"), "avg_service_cost": div("sum(total_cost)", "count(*)"), "csat_pct": share("rating >= 4"),
}


def _yoy(name: str, expr: str, src: str) -> str:
    return f"""SELECT '{name}' AS metric, (SELECT {expr} FROM {src} WHERE month_num <= 9 AND year = 1999) AS a, (SELECT {expr} FROM {src} WHERE month_num <= 9 AND year = 2000) AS b"""


_TM = "(SELECT *, substr(month, 1, 4)::INT AS year, substr(month, 6, 2)::INT AS month_num FROM fact_technician_month)"
_rows = [_yoy(k, v, "fs") for k, v in _RAW.items()] + [_yoy("appointments", "count(*)::DOUBLE", "fa"), _yoy("cancellation_rate", share("is_cancelled"), "fa"), _yoy("utilisation", div("sum(service_hours)", "sum(available_hours)"), _TM)]
M["yoy"] = "WITH l AS (" + " UNION ALL ".join(_rows) + f") SELECT metric, round(a, 6) AS y1999, round(b, 6) AS y2000, round(b - a, 6) AS change, {r(div('b - a', 'a'))} AS pct_change FROM l"
M["daily_load"] = """SELECT center_id, center_name, strftime(service_date, '%Y-%m-%d') AS service_date, weekday, jobs, booked_hours::DOUBLE AS booked_hours, round(wait_h, 6) AS wait_h, round(on_time, 6) AS on_time,
  capacity_hours::DOUBLE AS capacity_hours, round(load_ratio, 6) AS load_ratio, overloaded FROM daily"""
M["load_attach"] = "SELECT work_order_id, round(load_ratio, 6) AS load_ratio, load_band FROM fs_load"
M["load_band_profile"] = f"""SELECT load_band, count(*) AS jobs, {r(share('on_time_flag'))} AS on_time, {r(avg('wait_hours'))} AS wait_h, {r(share('qc_passed_first_time'))} AS qc_first_pass, {r(share('caused_repeat_visit'))} AS comeback,
  {r(avg('rating'))} AS csat FROM fs_load WHERE load_band IS NOT NULL GROUP BY 1"""
M["overloaded_share"] = f"SELECT center_id, {r(share('overloaded'))} AS overloaded_day_share, {r(share(f'CASE WHEN {FOCUS} THEN overloaded END'))} AS overloaded_day_share_focus FROM daily GROUP BY 1"
M["weekday_profile"] = f"""SELECT * FROM (SELECT weekday, count(*) AS jobs, {r(share('on_time_flag'))} AS on_time, {r(avg('wait_hours'))} AS wait_h, {r(avg('rating'))} AS csat, {r(div('count(*)', 'sum(count(*)) OVER ()'))} AS job_share FROM fs GROUP BY 1)
  LEFT JOIN (SELECT weekday, count(*) AS appointments, {r(share('is_cancelled'))} AS cancellation_rate FROM fa GROUP BY 1) USING (weekday) WHERE weekday <> 'Sunday'"""
_CO = f"{r(share('o'))} AS carry_over_share, {r(share('CASE WHEN o THEN on_time_flag END'))} AS on_time_if_carried_over, {r(share('CASE WHEN NOT o THEN on_time_flag END'))} AS on_time_if_same_day"
M["carry_over"] = f"""WITH n AS (SELECT *, end_time::DATE > check_in_time::DATE AS o FROM fs WHERE NOT parts_delay_flag)
SELECT 'network' AS scope, 'all' AS name, {_CO} FROM n UNION ALL SELECT 'centre', center_id::VARCHAR, {_CO} FROM n GROUP BY center_id UNION ALL SELECT 'weekday', weekday, {_CO} FROM n GROUP BY weekday"""
_ARR = "(SELECT (epoch_us(check_in_time) - epoch_us(strptime(strftime(scheduled_date, '%Y-%m-%d') || ' ' || scheduled_slot, '%Y-%m-%d %H:%M'))) / 60000000.0 AS mins FROM fs JOIN appointments a USING (appointment_id) WHERE a.booking_channel <> 'Walk-in' AND scheduled_slot IS NOT NULL)"
_BK = "CASE WHEN booking_channel <> 'Walk-in' THEN lead_days END"
_DL, _LT = "CASE WHEN parts_delay_flag THEN parts_wait_hours END", "CASE WHEN NOT on_time_flag THEN late_hours END"
_ST = [
    ("booking_lead_days_mean_booked", avg(_BK), "fa"), ("booking_lead_days_median_booked", md(_BK), "fa"), ("walk_in_share", share("booking_channel = 'Walk-in'"), "fa"), ("cancellation_rate", share("is_cancelled"), "fa"), ("no_show_rate", share("is_no_show"), "fa"),
    ("arrival_vs_slot_median_min", md("mins"), _ARR), ("arrival_vs_slot_p90_min", md("mins", 0.9), _ARR), ("feedback_lag_days_mean", avg("(feedback_date - end_time::DATE)"), "(SELECT f.feedback_date, w.end_time FROM feedback f JOIN fs w USING (work_order_id))"),
    ("wait_mean_h", avg("wait_hours"), "fs"), ("wait_median_h", md("wait_hours"), "fs"), ("wait_p90_h", md("wait_hours", 0.9), "fs"), ("wait_over_1_5h_share", share("coalesce(wait_hours > 1.5, FALSE)"), "fs"), ("additional_work_found_rate", share("additional_work_found"), "fs"),
    ("estimated_hours_mean", avg("estimated_hours"), "fs"), ("actual_hours_mean", avg("actual_hours"), "fs"), ("actual_hours_median", md("actual_hours"), "fs"), ("duration_variance_mean_h", avg("duration_variance_hours"), "fs"),
    ("labour_over_estimate_share", share("duration_variance_hours > 0"), "fs"), ("parts_delay_rate", share("parts_delay_flag"), "fs"), ("parts_wait_mean_h_delayed", avg(_DL), "fs"), ("parts_wait_median_h_delayed", md(_DL), "fs"),
    ("qc_first_pass", share("qc_passed_first_time"), "fs"), ("on_time_rate", share("on_time_flag"), "fs"), ("late_hours_median_when_late", md(_LT), "fs"), ("late_hours_mean_when_late", avg(_LT), "fs"), ("turnaround_median_h", md("turnaround_hours"), "fs"),
    ("turnaround_mean_h", avg("turnaround_hours"), "fs"), ("feedback_response_rate", share("rating IS NOT NULL"), "fs"), ("csat", avg("rating"), "fs"), ("comeback_rate", share("caused_repeat_visit"), "fs"),
    ("rework_billing_share", share("coalesce(billing_type = 'Rework (No Charge)', FALSE)"), "fs"),
]
M["process_stages"] = " UNION ALL ".join(f"SELECT '{n}' AS metric, round({e}, 6) AS value FROM {s}" for n, e, s in _ST)
M["parts_lines"] = "SELECT center_id, part_category, count(*) AS lines, sum(line_cost)::DOUBLE AS line_cost FROM lines GROUP BY 1, 2"
cte("wc", "SELECT work_order_id, part_category, max(center_name) AS center_name, bool_or(parts_delay_flag) AS flag, arg_min(supplier_lead_days, (usage_id, part_id)) AS lead FROM lines GROUP BY 1, 2")
M["parts_delay_cat"] = f"SELECT part_category, count(*) AS jobs, {r(share('flag'))} AS delay_rate, {r(avg('lead'))} AS supplier_lead_days FROM wc GROUP BY 1"
M["parts_delay_cat_centre"] = "SELECT part_category, " + ", ".join(
    f"""round((sum(flag::INT) FILTER (WHERE center_name = 'NATION_{i}'))::DOUBLE / nullif(count(*) FILTER (WHERE center_name = 'NATION_{i}'), 0), 6) AS "NATION_{i}\"""" for i in range(25)
) + " FROM wc GROUP BY 1"
M["parts_delay_impact"] = f"""SELECT parts_delay_flag, count(*) AS jobs, {r(share('on_time_flag'))} AS on_time, {r(avg('turnaround_hours'))} AS tat_mean_h, {r(md('turnaround_hours'))} AS tat_median_h, {r(avg('parts_wait_hours'))} AS parts_wait_mean_h,
  {r(avg('rating'))} AS csat, {r(share('rating >= 4'))} AS csat_pct FROM fs GROUP BY 1"""
cte("abc0", f"SELECT part_id, part_name, part_category, unit_cost, supplier_lead_days, sum(quantity)::BIGINT AS units, sum(line_cost) AS value, count(DISTINCT work_order_id) AS jobs, {share('parts_delay_flag')} AS delay_rate FROM lines GROUP BY 1, 2, 3, 4, 5")
cte("abc1", f"""SELECT *, {div('value', 'sum(value) OVER ()')} AS value_share, {div('sum(value) OVER (ORDER BY value DESC)', 'sum(value) OVER ()')} AS cum_share,
  {div('coalesce(sum(value) OVER (ORDER BY value DESC RANGE UNBOUNDED PRECEDING), 0) - sum(value) OVER (PARTITION BY value)', 'sum(value) OVER ()')} AS above FROM abc0""")
cte("abc2", "SELECT *, CASE WHEN above < 0.80 THEN 'A' WHEN above < 0.95 THEN 'B' ELSE 'C' END AS abc_class FROM abc1")
M["abc"] = """SELECT part_id, part_name, part_category, unit_cost::DOUBLE AS unit_cost, supplier_lead_days, units, value::DOUBLE AS value, jobs, round(delay_rate, 6) AS delay_rate, round(value_share, 6) AS value_share, round(cum_share, 6) AS cum_share, abc_class FROM abc2"""
M["abc_summary"] = "SELECT abc_class, count(*) AS parts, round(sum(value_share), 6) AS value_share, round(avg(delay_rate), 6) AS mean_delay_rate FROM abc2 GROUP BY 1"
M["abc_a_class"] = "SELECT part_id, part_name, part_category, round(value_share, 6) AS value_share, round(delay_rate, 6) AS delay_rate, supplier_lead_days FROM abc2 WHERE abc_class = 'A'"
M["abc_a_delayed"] = "SELECT part_id, round(delay_rate, 6) AS delay_rate FROM abc2 WHERE abc_class = 'A' AND delay_rate >= 0.2"


def stock(rate: str) -> str:
    return f"""(SELECT part_id, part_name, part_category, unit_cost, supplier_lead_days, u AS units, dr AS delay_rate, j AS jobs, u::DOUBLE / 9 AS monthly_units, greatest(1, ceil(u::DOUBLE / 9 * supplier_lead_days / 30))::INT AS cover_units
  FROM (SELECT part_id, part_name, part_category, unit_cost, supplier_lead_days, sum(quantity)::BIGINT AS u, {share('parts_delay_flag')} AS dr, count(DISTINCT work_order_id) AS j FROM lines WHERE center_id = 8 AND {FOCUS} GROUP BY 1, 2, 3, 4, 5) WHERE dr >= {rate})"""


M["safety_stock"] = f"SELECT * REPLACE (unit_cost::DOUBLE AS unit_cost, round(delay_rate, 6) AS delay_rate, round(monthly_units, 6) AS monthly_units), (cover_units * unit_cost)::DOUBLE AS stock_value FROM {stock('0.10')}"
_SK = "(VALUES ('Junior'), ('Mid'), ('Senior'), ('Master')) l(skill_level)"
M["skill_profile"] = f"SELECT * FROM {_SK} LEFT JOIN (SELECT skill_level, {CARD}, {r(share(HARD))} AS complex_share FROM fs GROUP BY 1) USING (skill_level)"
M["skill_profile_complex"] = f"SELECT * FROM {_SK} LEFT JOIN (SELECT skill_level, {CARD} FROM fs WHERE {HARD} GROUP BY 1) USING (skill_level)"
M["technician_diag"] = f"""SELECT * FROM (SELECT technician_id, center_name, skill_level, {CARD} FROM fs WHERE technician_id IS NOT NULL AND skill_level IS NOT NULL GROUP BY 1, 2, 3)
  LEFT JOIN (SELECT technician_id, {UTIL} AS utilisation FROM fact_technician_month GROUP BY 1) USING (technician_id) LEFT JOIN (SELECT technician_id, {UTIL} AS utilisation_focus FROM fact_technician_month WHERE month LIKE '2000%' GROUP BY 1) USING (technician_id)"""
M["overloaded_technicians"] = f"SELECT count(*) FILTER (WHERE u > 1) AS technicians_over_100_pct FROM (SELECT {div('sum(service_hours)', 'sum(available_hours)')} AS u FROM fact_technician_month WHERE month LIKE '2000%' GROUP BY technician_id)"
_RW = "coalesce(billing_type = 'Rework (No Charge)', FALSE)"
M["rework_cost"] = f"""SELECT count(*) FILTER (WHERE {_RW}) AS rework_jobs, coalesce(sum(total_cost) FILTER (WHERE {_RW}), 0)::DOUBLE AS rework_cost, {r(avg(f'CASE WHEN {_RW} THEN total_cost END'))} AS rework_avg_cost,
  coalesce(sum(actual_hours) FILTER (WHERE {_RW}), 0)::DOUBLE AS rework_labour_hours, {r(share(_RW))} AS rework_share_of_jobs FROM fs"""
_OD = f"""additional_work_found, count(*) AS jobs, {share('cost_overrun_flag')} AS overrun, {md('cost_variance_pct')} AS cost_var_pct_median, sum(revenue)::DOUBLE AS revenue, {avg('rating')} AS csat, {div('sum(profit)', 'sum(revenue)')} AS margin, {div('count(*)', 'sum(count(*)) OVER ()')} AS share_of_jobs"""
M["overrun_drivers"] = f"SELECT * REPLACE (round(overrun, 6) AS overrun, round(cost_var_pct_median, 6) AS cost_var_pct_median, round(csat, 6) AS csat, round(margin, 6) AS margin, round(share_of_jobs, 6) AS share_of_jobs) FROM (SELECT {_OD} FROM fs GROUP BY 1)"


def pay(s: str) -> str:
    return f"((SELECT arg_min(hourly_cost * shift_hours_per_day, technician_id) FROM technicians WHERE skill_level = '{s}')::DOUBLE * (SELECT {avg('working_days')} FROM period_months))"


M["technician_monthly_cost"] = f"SELECT 'Mid' AS skill_level, round({pay('Mid')}, 6) AS monthly_cost UNION ALL SELECT 'Senior', round({pay('Senior')}, 6)"
M["crosstab_norm"] = f"SELECT center_id, lead_time_band, count(*) AS n, {r(div('count(*)', 'sum(count(*)) OVER (PARTITION BY center_id)'))} AS share FROM fa WHERE lead_time_band <> 'nan' GROUP BY 1, 2"
M["reasons_by_centre"] = f"SELECT center_id, cancellation_reason, count(*) AS n, {r(div('count(*)', 'sum(count(*)) OVER (PARTITION BY center_id)'))} AS share FROM fa WHERE is_cancelled AND cancellation_reason IS NOT NULL GROUP BY 1, 2"

# ---- tests --------------------------------------------------------------------------


def mid(x: str, part: str = "") -> str:
    p = f"PARTITION BY {part}" if part else ""
    q = f"PARTITION BY {part + ', ' if part else ''}{x}"
    return f"(rank() OVER ({p} ORDER BY {x}) + (count(*) OVER ({q}) - 1) / 2.0)::DOUBLE"


def _integral(density: str, end: str) -> str:
    """Integral of ``density`` (in t) from ``end`` to infinity, by the double exponential rule."""
    return f"""(SELECT sum(w * {density}) FROM (SELECT {end} + exp(s - exp(-s)) AS t, 0.02 * exp(s - exp(-s)) * (1 + exp(-s)) AS w
    FROM (SELECT (k * 0.02)::DOUBLE AS s FROM range(-250, 331) q(k))))"""


def chi2_p(x: str, dof: str) -> str:
    a = f"(({dof}) / 2.0::DOUBLE)"
    return f"CASE WHEN {dof} < 1 THEN NULL WHEN {x} <= 0 THEN 1 ELSE {_integral(f'exp(({a} - 1) * ln(t) - t - lgamma({a}))', f'(({x}) / 2.0::DOUBLE)')} END::DOUBLE"


def normal_p(z: str) -> str:
    return f"CASE WHEN {z} <= 0 THEN 1 ELSE 2 * {_integral('exp(-t * t / 2) / sqrt(2 * pi())', f'({z})')} END::DOUBLE"


def rho_p(rho: str, n: str) -> str:
    v = f"(({n}) - 2)::DOUBLE"
    density = f"exp(lgamma(({v} + 1) / 2) - lgamma({v} / 2) - ({v} + 1) / 2 * ln(1 + t * t / {v})) / sqrt({v} * pi())"
    return f"CASE WHEN {n} < 3 THEN NULL WHEN abs({rho}) >= 1 THEN 0 ELSE 2 * {_integral(density, f'(abs({rho}) * sqrt({v} / (1 - {rho} * {rho})))')} END::DOUBLE"


def kruskal(v: str) -> str:
    return f"""WITH x AS (SELECT center_id AS g, {v} AS v, {mid(v)} AS rk FROM fs WHERE {v} IS NOT NULL), s AS (SELECT g, count(*) AS n, sum(rk) AS R FROM x GROUP BY 1),
  t AS (SELECT sum(c * c * c - c) AS T FROM (SELECT count(*)::DOUBLE AS c FROM x GROUP BY v)), a AS (SELECT sum(n)::DOUBLE AS N, count(*) AS k, sum(R * R / n) AS S FROM s),
  h AS (SELECT (12.0::DOUBLE / (N * (N + 1)) * S - 3 * (N + 1)) / (1 - T / (N * N * N - N)) AS h, k, N FROM a, t)
SELECT round(h, 6) AS h, (k - 1)::BIGINT AS dof, round({chi2_p('h', '(k - 1)')}, 6) AS p, round(h / (N - 1), 6) AS epsilon_sq, N::BIGINT AS n FROM h"""


M["kruskal_turnaround"], M["kruskal_wait"] = kruskal("turnaround_hours"), kruskal("wait_hours")
M["mannwhitney"] = f"""WITH x AS (SELECT center_id = 6 AS g, wait_hours AS v, {mid('wait_hours')} AS rk FROM fs WHERE wait_hours IS NOT NULL), t AS (SELECT sum(c * c * c - c) AS T FROM (SELECT count(*)::DOUBLE AS c FROM x GROUP BY v)),
  a AS (SELECT count(*) FILTER (WHERE g)::DOUBLE AS n1, count(*) FILTER (WHERE NOT g)::DOUBLE AS n2, sum(rk) FILTER (WHERE g) AS R1, quantile_cont(v::DOUBLE, 0.5) FILTER (WHERE g) AS m1, quantile_cont(v::DOUBLE, 0.5) FILTER (WHERE NOT g) AS m2 FROM x),
  u AS (SELECT *, R1 - n1 * (n1 + 1) / 2 AS u, n1 + n2 AS n FROM a, t)
SELECT u, round(z, 6) AS z, round({normal_p('z')}, 6) AS p, round(2 * u / (n1 * n2) - 1, 6) AS rank_biserial, round(m1, 6) AS median_focus, round(m2, 6) AS median_rest, n::BIGINT AS n FROM (SELECT *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n + 1) - T / (n * (n - 1)))) AS z FROM u)"""


def chi2(src: str, a: str, b: str) -> str:
    return f"""WITH d AS (SELECT {a} AS a, {b} AS b FROM {src} WHERE ({a}) IS NOT NULL AND ({b}) IS NOT NULL), n AS (SELECT count(*)::DOUBLE AS N FROM d), ra AS (SELECT a, count(*)::DOUBLE AS r FROM d GROUP BY 1), cb AS (SELECT b, count(*)::DOUBLE AS c FROM d GROUP BY 1),
  o AS (SELECT a, b, count(*)::DOUBLE AS o FROM d GROUP BY 1, 2), e AS (SELECT coalesce(o.o, 0) AS o, r * c / N AS e FROM ra CROSS JOIN cb CROSS JOIN n LEFT JOIN o ON o.a = ra.a AND o.b = cb.b),
  k AS (SELECT (SELECT count(*) FROM ra) AS nr, (SELECT count(*) FROM cb) AS nc),
  s AS (SELECT sum(CASE WHEN (nr - 1) * (nc - 1) = 1 THEN (abs(o - e) - least(0.5, abs(o - e))) * (abs(o - e) - least(0.5, abs(o - e))) / e ELSE (o - e) * (o - e) / e END) AS x FROM e, k)
SELECT round(x, 6) AS chi2, ((nr - 1) * (nc - 1))::BIGINT AS dof, round({chi2_p('x', '((nr - 1) * (nc - 1))')}, 6) AS p, round(sqrt(x / (N * (least(nr, nc) - 1))), 6) AS cramers_v, N::BIGINT AS n FROM s, k, n"""


M["chi2_on_time_centre"] = chi2("fs", "center_id", "on_time_flag")
M["chi2_on_time_parts"] = chi2("fs", "parts_delay_flag", "on_time_flag")
M["chi2_qc_skill"] = chi2("fs", "skill_level", "qc_passed_first_time")
M["chi2_overrun_skill"] = chi2("fs", "skill_level", "cost_overrun_flag")
M["chi2_cancel_lead"] = chi2("fa", "lead_time_band", "is_cancelled")
M["chi2_on_time_saturday"] = chi2("fs", "weekday = 'Saturday'", "on_time_flag")
M["chi2_parts_one_centre"] = chi2("fs", "center_id = 8", "parts_delay_flag")
M["prop_gap"] = f"""WITH a AS (SELECT {share('CASE WHEN center_id = 6 THEN on_time_flag END')} AS p1, {share('CASE WHEN center_id = 5 THEN on_time_flag END')} AS p2, count(*) FILTER (WHERE center_id = 6)::DOUBLE AS n1, count(*) FILTER (WHERE center_id = 5)::DOUBLE AS n2 FROM fs),
  b AS (SELECT *, sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2) AS se FROM a)
SELECT round(p1, 6) AS focus_rate, round(p2, 6) AS benchmark_rate, round(p1 - p2, 6) AS gap, round(p1 - p2 - 1.96 * se, 6) AS ci95_low, round(p1 - p2 + 1.96 * se, 6) AS ci95_high, round(2 * asin(sqrt(p1)) - 2 * asin(sqrt(p2)), 6) AS cohens_h FROM b"""


def rho(src: str, x: str, y: str, keys: str = "") -> str:
    names = "".join(f"{k.split(' AS ')[1].strip()}, " for k in keys.split(",") if k.strip())
    return f"""SELECT {names} round(rho, 6) AS rho, n, round({rho_p('rho', 'n')}, 6) AS p FROM (SELECT {keys} corr(rx, ry) AS rho, count(*) AS n FROM (
  SELECT {mid('x')} AS rx, {mid('y')} AS ry FROM (SELECT {x} AS x, {y} AS y FROM {src} WHERE ({x}) IS NOT NULL AND ({y}) IS NOT NULL)))"""


M["spearman_rating_late"] = rho("fs", "late_hours", "rating")
M["spearman_rating_wait"] = rho("(SELECT coalesce(wait_hours, 0) AS w, rating FROM fs WHERE rating IS NOT NULL AND late_hours IS NOT NULL)", "w", "rating")
M["spearman_load_wait"] = rho("daily", "round(load_ratio, 9)", "round(wait_h, 9)")
M["spearman_load_on_time"] = rho("daily", "round(load_ratio, 9)", "round(on_time, 9)")
M["spearman_lead_cancel"] = rho("(SELECT lead_days, is_cancelled::INT AS c FROM fa WHERE booking_channel <> 'Walk-in')", "lead_days", "c")
_C = ["load_ratio", "wait_hours", "late_hours", "parts_wait_hours", "duration_variance_hours", "cost_variance_pct", "qc_passed_first_time", "caused_repeat_visit", "rating"]
M["spearman_matrix"] = " UNION ALL ".join(rho("fs_load", f"round({a}::DOUBLE, 9)", f"round({b}::DOUBLE, 9)", f"'{a}' AS a, '{b}' AS b,") for i, a in enumerate(_C) for b in _C[i + 1 :])



def line(test: str, stat: str, effect: str, sql: str, n: str = "n", p: str = "p") -> str:
    return f"SELECT '{test}' AS test, {stat}::DOUBLE AS statistic, {p}::DOUBLE AS p, {effect}::DOUBLE AS effect, {n}::BIGINT AS n FROM ({sql})"


_DAYS = "(SELECT count(*) FROM daily)"
M["statistical_tests"] = " UNION ALL ".join([
    line("kruskal_turnaround_by_centre", "h", "epsilon_sq", M["kruskal_turnaround"]), line("kruskal_wait_by_centre", "h", "epsilon_sq", M["kruskal_wait"]),
    line("mannwhitney_wait_focus_vs_rest", "u", "rank_biserial", M["mannwhitney"]), line("chi2_on_time_by_centre", "chi2", "cramers_v", M["chi2_on_time_centre"]),
    line("chi2_on_time_vs_parts_delay", "chi2", "cramers_v", M["chi2_on_time_parts"]), line("on_time_gap_focus_vs_benchmark", "gap", "cohens_h", M["prop_gap"], "NULL", "NULL"),
    line("spearman_rating_vs_late_hours", "rho", "rho", M["spearman_rating_late"]), line("spearman_rating_vs_wait_hours", "rho", "rho", M["spearman_rating_wait"]),
    line("spearman_daily_load_vs_wait", "rho", "rho", M["spearman_load_wait"], _DAYS), line("spearman_daily_load_vs_on_time", "rho", "rho", M["spearman_load_on_time"], _DAYS),
    line("chi2_cancellation_vs_lead_band", "chi2", "cramers_v", M["chi2_cancel_lead"]), line("spearman_lead_days_vs_cancel_booked", "rho", "rho", M["spearman_lead_cancel"]),
    line("chi2_qc_vs_skill", "chi2", "cramers_v", M["chi2_qc_skill"]), line("chi2_overrun_vs_skill", "chi2", "cramers_v", M["chi2_overrun_skill"]),
    line("chi2_on_time_saturday_vs_weekday", "chi2", "cramers_v", M["chi2_on_time_saturday"]),
])

# ---- what-if ------------------------------------------------------------------------
M["response_curve"] = "SELECT band, round(rate, 6) AS rate FROM curve"


def moved(src: str, new: str) -> str:
    return f"""SELECT f.*, c1.rate - c0.rate AS delta FROM (SELECT *, {new} AS new_load FROM {src}) f LEFT JOIN curve c0 ON c0.band = {lband('f.load_ratio')} LEFT JOIN curve c1 ON c1.band = {lband('f.new_load')}"""


_MON = "(SELECT count(DISTINCT month) FROM fs WHERE year = 2000)"


def cap(c: int) -> str:
    n = f"(SELECT count(*) FROM technicians WHERE center_id = {c})"
    sc = f"({n}::DOUBLE / ({n} + 1))"
    src = f"(SELECT * FROM fs_load WHERE center_id = {c} AND year = 2000)"
    return f"""SELECT {c} AS center_id, {n} AS technicians_now, {n} + 1 AS technicians_new, round(j, 6) AS jobs_per_month, round(u, 6) AS utilisation_now, round(u * {sc}, 6) AS utilisation_projected, round(o0, 6) AS overloaded_day_share_now,
  round(o1, 6) AS overloaded_day_share_projected, round(t, 6) AS on_time_now, round(least(1.0::DOUBLE, t + dl), 6) AS on_time_projected, round(dl, 6) AS on_time_delta_pts, round(dl * j, 6) AS extra_on_time_jobs_per_month
FROM (SELECT {div('count(*)', 'count(DISTINCT month)')} AS j, {share('on_time_flag')} AS t, avg(delta) AS dl FROM ({moved(src, f'load_ratio * {sc}')})),
  (SELECT {share('coalesce(load_ratio > 1, FALSE)')} AS o0, {share(f'coalesce(load_ratio * {sc} > 1, FALSE)')} AS o1 FROM daily WHERE center_id = {c} AND year = 2000),
  (SELECT {div('sum(service_hours)', 'sum(available_hours)')} AS u FROM fact_technician_month WHERE center_id = {c} AND month LIKE '2000%')"""


M["whatif_capacity"] = " UNION ALL ".join(cap(c) for c in (6, 3, 7))
M["whatif_shift"] = f"""WITH y AS (SELECT *, {div('booked_hours', 'load_ratio')} AS cap FROM daily WHERE year = 2000),
  rc AS (SELECT center_id, service_date + k AS service_date, sum(ahead::DOUBLE * 0.15 / 3) AS add_h FROM y CROSS JOIN (VALUES (3), (4), (5)) v(k) WHERE weekday = 'Saturday' GROUP BY 1, 2),
  nd AS (SELECT y.center_id, y.service_date, CASE WHEN weekday = 'Saturday' THEN (booked_hours::DOUBLE - ahead::DOUBLE * 0.15) / cap ELSE load_ratio END + coalesce(add_h, 0) / cap AS nl FROM y LEFT JOIN rc ON rc.center_id = y.center_id AND rc.service_date = y.service_date),
  f AS ({moved('(SELECT l.*, nd.nl FROM fs_load l JOIN nd ON nd.center_id = l.center_id AND nd.service_date = l.service_date WHERE year = 2000)', 'nl')}),
  g AS (SELECT *, weekday = 'Saturday' AS sat, weekday IN ('Tuesday', 'Wednesday', 'Thursday') AS midw, on_time_flag::INT AS ot FROM f)
SELECT 0.15::DOUBLE AS shift_share_of_booked_saturday_hours, round(avg(ot) FILTER (WHERE sat), 6) AS saturday_on_time_now, round(avg(ot) FILTER (WHERE sat) + avg(delta) FILTER (WHERE sat), 6) AS saturday_on_time_projected,
  round(avg(ot) FILTER (WHERE midw), 6) AS tue_thu_on_time_now, round(avg(ot + delta) FILTER (WHERE midw), 6) AS tue_thu_on_time_projected, round(avg(ot), 6) AS network_on_time_now, round(avg(ot) + avg(delta), 6) AS network_on_time_projected,
  round(sum(delta) / count(DISTINCT month), 6) AS extra_on_time_jobs_per_month, (SELECT {r(div("sum(ahead) FILTER (WHERE weekday = 'Saturday')", "sum(booked_hours) FILTER (WHERE weekday = 'Saturday')"))} FROM y) AS booked_share_of_saturday_hours FROM g"""
_SATS = "(SELECT * FROM fs_load WHERE year = 2000 AND weekday = 'Saturday' AND center_id IN (1, 3, 6, 7))"
M["whatif_saturday"] = f"""WITH f AS ({moved(_SATS, 'load_ratio * (7.0::DOUBLE / 9.0::DOUBLE)')}), a AS (SELECT count(*) AS n, {share('on_time_flag')} AS t, avg(delta) AS dl, sum(delta) AS ex, {avg('wait_hours')} AS w, count(DISTINCT service_date)::DOUBLE / {_MON} AS sp FROM f)
SELECT '1,3,6,7' AS centres, 2.0::DOUBLE AS extra_hours_per_tech, round(n::DOUBLE / {_MON}, 6) AS saturday_jobs_per_month, round(t, 6) AS saturday_on_time_now, round(t + dl, 6) AS saturday_on_time_projected, round(ex / {_MON}, 6) AS extra_on_time_jobs_per_month,
  round(w, 6) AS saturday_wait_now_h, round(sp, 6) AS saturdays_per_month, round((SELECT sum(hourly_cost) FROM technicians WHERE center_id IN (1, 3, 6, 7))::DOUBLE * 2 * 2 * sp, 6) AS overtime_cost_per_month_at_2x FROM a"""


def peers(src: str, flag: str, c: int) -> str:
    return f"SELECT max(v) FILTER (WHERE center_id = {c}) AS mine, quantile_cont(v, 0.5) FILTER (WHERE center_id <> {c}) AS others FROM (SELECT center_id, {share(flag)} AS v FROM {src} WHERE {FOCUS} GROUP BY 1)"


M["impact_recovery"] = f"""WITH p AS ({peers('fa', 'is_cancelled', 6)}), a AS (SELECT count(*)::DOUBLE / {_MON} AS ap, {share('is_completed')} AS cr FROM fa WHERE {FOCUS} AND center_id = 6), j AS (SELECT {avg('revenue')} AS rv, {avg('profit')} AS pf FROM fs WHERE {FOCUS} AND center_id = 6),
  x AS (SELECT *, (mine - others) * ap * cr AS won FROM p, a, j)
SELECT round(mine, 6) AS cancel_rate, round(others, 6) AS other_centres_median, round(ap, 6) AS appointments_per_month, round(cr, 6) AS completion_rate, round(won, 6) AS recovered_jobs_per_month, round(rv, 6) AS revenue_per_job, round(pf, 6) AS profit_per_job,
  round(won * rv, 6) AS recovered_revenue_per_month, round(won * pf, 6) AS recovered_profit_per_month FROM x"""
M["impact_context"] = f"""WITH a AS (SELECT sum(profit)::DOUBLE / {_MON} AS pf, sum(revenue)::DOUBLE / {_MON} AS rv, count(*) AS n2 FROM fs WHERE {FOCUS} AND center_id = 6), b AS (SELECT count(*) AS n1 FROM fs WHERE year = 1999 AND month_num <= 9 AND center_id = 6)
SELECT round(pf, 6) AS profit_per_month, round(rv, 6) AS revenue_per_month, n1 AS jobs_base_year, n2 AS jobs_focus_year, {r(div('n2', 'n1') + ' - 1')} AS jobs_yoy_growth, round({pay('Senior')} / pf, 6) AS hire_cost_share_of_profit FROM a, b"""
_D = "parts_delay_flag"
M["impact_parts"] = f"""WITH p AS ({peers('fs', _D, 8)}), k AS (SELECT count(*)::DOUBLE / {_MON} AS n, {share(f'CASE WHEN NOT {_D} THEN on_time_flag END')} AS ok, {avg(f'CASE WHEN {_D} THEN turnaround_hours END')} - {avg(f'CASE WHEN NOT {_D} THEN turnaround_hours END')} AS gap FROM fs WHERE {FOCUS} AND center_id = 8),
  w AS (SELECT {share(f'CASE WHEN {HARD} THEN {_D} END')} AS c1, {share(f'CASE WHEN NOT {HARD} THEN {_D} END')} AS c2 FROM fs WHERE center_id = 8), s AS (SELECT count(*) AS sn, coalesce(sum(cover_units * unit_cost), 0)::DOUBLE AS sv FROM {stock('0.10')}), x AS (SELECT *, (mine - others) * n AS av FROM p, k, w, s)
SELECT round(mine, 6) AS parts_delay_rate, round(others, 6) AS other_centres_median, round(n, 6) AS jobs_per_month, round(av, 6) AS avoided_delayed_jobs_per_month, round(av * ok, 6) AS extra_on_time_jobs_per_month, round(av * gap, 6) AS turnaround_hours_saved_per_month,
  round(gap, 6) AS tat_gap_delayed_vs_not_h, round(c1, 6) AS parts_delay_complex_jobs_all_period, round(c2, 6) AS parts_delay_other_jobs_all_period, sn AS safety_stock_parts, sv AS safety_stock_value, round(sv * 0.20, 6) AS safety_stock_carrying_cost_pa_at_20pct FROM x"""


def sk(s: str, c: str, f=share) -> str:
    return f(f"CASE WHEN skill_level = '{s}' THEN {c} END")


M["impact_skill"] = f"""WITH a AS (SELECT count(*) FILTER (WHERE skill_level = 'Junior')::DOUBLE / {_MON} AS n, {sk('Junior', 'caused_repeat_visit')} AS jc, {sk('Mid', 'caused_repeat_visit')} AS mc, {sk('Junior', 'qc_passed_first_time')} AS jq, {sk('Mid', 'qc_passed_first_time')} AS mq,
    {sk('Junior', 'duration_variance_hours', avg)} AS jd, {sk('Mid', 'duration_variance_hours', avg)} AS md, {avg(f'CASE WHEN {_RW} THEN total_cost END')} AS rc FROM fs WHERE {FOCUS})
SELECT round(n, 6) AS junior_jobs_per_month, round(jc, 6) AS junior_comeback, round(mc, 6) AS mid_comeback, round(jq, 6) AS junior_qc, round(mq, 6) AS mid_qc, round(jd, 6) AS junior_duration_var_h, round(md, 6) AS mid_duration_var_h, round(rc, 6) AS rework_avg_cost,
  round((jc - mc) * n, 6) AS avoided_comebacks_per_month, round((mq - jq) * n, 6) AS avoided_qc_failures_per_month, round((jc - mc) * n * rc, 6) AS rework_cost_avoided_per_month, round((jd - md) * n, 6) AS labour_hours_saved_per_month FROM a"""
_LG = "lead_time_band IN ('8-14 days', '15+ days')"
M["impact_booking"] = f"""WITH a AS (SELECT count(*) FILTER (WHERE {_LG})::DOUBLE / {_MON} AS n, {share(f'CASE WHEN {_LG} THEN is_cancelled END')} AS lr, {share("CASE WHEN lead_time_band = '4-7 days' THEN is_cancelled END")} AS tr, {share('is_completed')} AS cp,
    {share(f'CASE WHEN center_id = 6 THEN {_LG} END')} AS fl, {share(_LG)} AS nl FROM fa WHERE {FOCUS}), j AS (SELECT {avg('revenue')} AS rv, {avg('profit')} AS pf FROM fs WHERE {FOCUS}), x AS (SELECT *, (lr - tr) * n * cp AS won FROM a, j)
SELECT round(n, 6) AS long_lead_appointments_per_month, round(lr, 6) AS long_lead_cancel_rate, round(tr, 6) AS target_rate_4_7_days, round(won, 6) AS recovered_jobs_per_month, round(won * rv, 6) AS recovered_revenue_per_month, round(won * pf, 6) AS recovered_profit_per_month,
  round(fl, 6) AS focus_long_lead_share, round(nl, 6) AS network_long_lead_share FROM x"""
M["impact_estimate"] = f"""WITH d AS (SELECT {_OD} FROM fs WHERE {FOCUS} GROUP BY 1) SELECT round(max(share_of_jobs) FILTER (WHERE additional_work_found), 6) AS additional_work_share, round(max(overrun) FILTER (WHERE additional_work_found), 6) AS overrun_rate_with_additional_work,
  round(max(overrun) FILTER (WHERE NOT additional_work_found), 6) AS overrun_rate_without, round(max(csat) FILTER (WHERE additional_work_found), 6) AS csat_with_additional_work, round(max(csat) FILTER (WHERE NOT additional_work_found), 6) AS csat_without FROM d"""

# ---- exploration ----------------------------------------------------------------------
_N = ["estimated_hours", "actual_hours", "duration_variance_hours", "wait_hours", "turnaround_hours", "late_hours", "parts_wait_hours", "revenue", "total_cost", "profit", "cost_variance_pct", "rating"]
M["describe"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, round({avg(c)}, 4) AS mean, round(stddev_samp({c}::DOUBLE), 4) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(skewness({c}::DOUBLE), 4) AS skew,
  {r(md(c, 0.25), 4)} AS p25, {r(md(c, 0.5), 4)} AS p50, {r(md(c, 0.75), 4)} AS p75, {r(md(c, 0.95), 4)} AS p95 FROM fs""" for c in _N
)
M["category_mix"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {c} AS value, {r(div('count(*)', 'sum(count(*)) OVER ()'))} AS share_of_jobs FROM fs WHERE {c} IS NOT NULL GROUP BY 2""" for c in ("service_type", "billing_type", "model", "customer_type")
)
M["iqr_outliers"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c}::DOUBLE > q3 + 1.5 * (q3 - q1)) AS high_outliers, round(max(p95), 6) AS p95, round(max({c})::DOUBLE, 6) AS max, {r(div(f'count(*) FILTER (WHERE {c}::DOUBLE > q3 + 1.5 * (q3 - q1))', 'count(*)'))} AS share_of_jobs
  FROM fs, (SELECT {md(c, 0.25)} AS q1, {md(c, 0.75)} AS q3, {md(c, 0.95)} AS p95 FROM fs)""" for c in ("turnaround_hours", "wait_hours", "late_hours", "cost_variance_pct", "revenue", "duration_variance_hours")
)
M["rating_by_late_band"] = f"""SELECT CASE WHEN late_hours <= 0 THEN 'On time' WHEN late_hours <= 2 THEN '<=2 h' WHEN late_hours <= 8 THEN '2-8 h' WHEN late_hours <= 24 THEN '8-24 h' WHEN late_hours <= 72 THEN '1-3 days' ELSE '>3 days' END AS late_band,
  count(*) AS responses, {r(avg('rating'))} AS csat, {r(share('rating >= 4'))} AS csat_pct FROM fs WHERE rating IS NOT NULL GROUP BY 1"""
M["delay_model_year"] = "SELECT model, " + ", ".join(f"""round((sum(parts_delay_flag::INT) FILTER (WHERE year = {y}))::DOUBLE / nullif(count(*) FILTER (WHERE year = {y}), 0), 6) AS "{y}\"""" for y in range(1995, 2002)) + " FROM fs GROUP BY 1"
M["overrun_centre"] = f"SELECT center_name, {r(share('CASE WHEN NOT additional_work_found THEN cost_overrun_flag END'))} AS no_extra_work, {r(share('CASE WHEN additional_work_found THEN cost_overrun_flag END'))} AS extra_work_found FROM fs GROUP BY 1"
M["part_category_profile"] = f"SELECT part_category, count(*) AS skus, {r(avg('supplier_lead_days'))} AS mean_lead_days, {r(md('unit_cost'))} AS median_unit_cost FROM parts GROUP BY 1"
_COLUMNS = {
    "service_centers": "center_id center_name city state region service_bays daily_job_capacity opened_date",
    "customers": "customer_id customer_type city region registration_date",
    "vehicles": "vehicle_id customer_id model variant vehicle_category battery_kwh model_year purchase_date mileage_km",
    "technicians": "technician_id center_id skill_level years_experience certification hourly_cost shift_hours_per_day",
    "appointments": "appointment_id vehicle_id center_id booking_date scheduled_date scheduled_slot booking_channel requested_service_type status cancellation_reason",
    "work_orders": "work_order_id appointment_id technician_id service_type check_in_time start_time end_time promised_ready_time estimated_hours actual_hours parts_wait_hours odometer_km additional_work_found qc_passed_first_time",
    "parts": "part_id part_name part_category unit_cost compatible_models supplier_lead_days",
    "part_usage": "usage_id work_order_id part_id quantity",
    "financials": "work_order_id billing_type estimated_cost labor_cost parts_cost revenue",
    "feedback": "feedback_id work_order_id rating feedback_category feedback_date",
}
M["column_profile"] = " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(DISTINCT {c}) AS "distinct" FROM {t}"""
    for t, names in _COLUMNS.items() for c in names.split()
)
_V = "vehicle_id, customer_id, model, model_year"
M["table_diff"] = f"""WITH a AS (SELECT {_V} FROM s_vehicles), b AS (SELECT {_V} FROM c_vehicles), l AS (SELECT count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)), r AS (SELECT count(*) AS n FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))
SELECT l.n AS only_left, r.n AS only_right, l.n + r.n = 0 AS identical FROM l, r"""
_LISTS = "vehicle_id, count(*) AS n, list(customer_id ORDER BY customer_id) AS c1, list(model ORDER BY model) AS c2, list(model_year ORDER BY model_year) AS c3"
M["table_changes"] = f"""WITH a AS (SELECT {_LISTS} FROM s_vehicles GROUP BY vehicle_id), b AS (SELECT {_LISTS} FROM c_vehicles GROUP BY vehicle_id),
  j AS (SELECT coalesce(a.vehicle_id, b.vehicle_id) AS vehicle_id, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'lost' ELSE 'changed' END AS status,
    concat_ws(' ', CASE WHEN a.c1 IS DISTINCT FROM b.c1 THEN 'customer_id' END, CASE WHEN a.c2 IS DISTINCT FROM b.c2 THEN 'model' END, CASE WHEN a.c3 IS DISTINCT FROM b.c3 THEN 'model_year' END) AS names
    FROM a FULL JOIN b ON a.vehicle_id = b.vehicle_id)
SELECT vehicle_id, status, CASE WHEN status = 'changed' THEN names ELSE '' END AS columns FROM j WHERE names <> ''"""
_JOB = """service_scorecard cancellation_diag cancellation_lead_diag centre_diag monthly_diag yoy load_band_profile overloaded_share weekday_profile carry_over
  process_stages parts_delay_cat parts_delay_cat_centre parts_delay_impact abc_summary safety_stock skill_profile technician_diag rework_cost overrun_drivers
  reasons_by_centre technician_monthly_cost"""
M["metrics_job"] = " UNION ALL ".join(f"SELECT '{n}' AS name, (SELECT count(*) FROM ({M[n]})) AS rows" for n in _JOB.split())
SQL = {k: query(v) for k, v in M.items()}
