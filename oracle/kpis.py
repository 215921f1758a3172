"""KPI library and slicers in SQL."""

from oracle.base import avg, cte, div, query, r, share

COST = "(labor_cost + parts_cost)"
Z = "coalesce(sum({0}), 0)".format


def measures() -> str:
    rev, cost = Z("revenue"), Z(COST)
    return f"""count(*) AS work_orders, {rev}::DOUBLE AS revenue, {Z('labor_cost')}::DOUBLE AS labor_cost, {Z('parts_cost')}::DOUBLE AS parts_cost,
  {cost}::DOUBLE AS total_cost, ({rev} - {cost})::DOUBLE AS profit, {r(div(f'{rev} - {cost}', rev))} AS margin_pct, {r(div(Z('parts_cost'), cost))} AS parts_share,
  {r(div(cost, 'count(*)'))} AS avg_service_cost, {Z('cost_variance')}::DOUBLE AS cost_variance, {r(share('cost_overrun_flag'))} AS cost_overrun_rate,
  {r(share('on_time_flag'))} AS on_time_pct, {r(avg('turnaround_hours'))} AS avg_turnaround, {r('quantile_cont(turnaround_hours::DOUBLE, 0.5)')} AS median_turnaround,
  {r(avg('wait_hours'))} AS avg_wait, {r(avg('duration_variance_hours'))} AS avg_duration_variance, {r(avg('rating'))} AS avg_rating, {r(share('rating >= 4'))} AS csat_pct,
  count(rating) AS rated_orders, {r(share('caused_repeat_visit'))} AS comeback_rate, {r(share('parts_delay_flag'))} AS parts_delay_rate, {r(share('qc_passed_first_time'))} AS qc_first_pass_rate"""


EXTRA = f"{r(avg('cost_variance_pct'))} AS avg_cost_variance_pct, {r(avg('estimated_hours'))} AS avg_est_hours, {r(avg('actual_hours'))} AS avg_actual_hours"


def grouped(keys: str, src: str = "fact_service") -> str:
    ks = [k.strip() for k in keys.split(",")]
    ok = " AND ".join(f"{k} IS NOT NULL" for k in ks)
    return f"""SELECT * FROM (SELECT {keys}, {measures()}, {EXTRA} FROM {src} WHERE {ok} GROUP BY {keys}) LEFT JOIN
  (SELECT {keys}, {r(share('n >= 2'))} AS repeat_visit_rate FROM (SELECT {keys}, customer_id, count(*) AS n FROM {src} WHERE {ok} GROUP BY {keys}, customer_id) GROUP BY {keys}) USING ({keys})"""


TOTAL = f"SELECT * FROM (SELECT {measures()} FROM fact_service) CROSS JOIN (SELECT {r(share('n >= 2'))} AS repeat_visit_rate FROM (SELECT count(*) AS n FROM fact_service GROUP BY customer_id))"
APPT = f"count(*) AS appointments, {r(share('is_cancelled'))} AS cancellation_rate, {r(share('is_no_show'))} AS no_show_rate"
APPT2 = f"count(*) AS appointments, count(*) FILTER (WHERE is_cancelled) AS cancelled, count(*) FILTER (WHERE is_no_show) AS no_shows, {r(share('is_cancelled'))} AS cancellation_rate, {r(share('is_no_show'))} AS no_show_rate"
UTIL = r(div("sum(service_hours)", "sum(available_hours)"))
K: dict[str, str] = {}
K["fact_kpis"] = TOTAL
K["appointment_kpis"] = f"SELECT {APPT} FROM fact_appointments"
K["utilisation_total"] = f"SELECT {UTIL} AS utilisation FROM fact_technician_month"
K["headline"] = f"SELECT * FROM ({TOTAL}) CROSS JOIN (SELECT {APPT} FROM fact_appointments) CROSS JOIN (SELECT {UTIL} AS utilisation FROM fact_technician_month)"
K["group_kpis"] = grouped("center_name")
K["group_kpis_two_keys"] = grouped("region, model")
K["monthly_trend"] = f"""WITH g AS ({grouped('month')}) SELECT *, {r(div('revenue', 'lag(revenue) OVER (ORDER BY month)') + ' - 1')} AS revenue_mom_pct,
  {r(div('profit - lag(profit) OVER (ORDER BY month)', 'lag(profit) OVER (ORDER BY month)'))} AS profit_mom_pct FROM g"""
K["service_type_kpis"] = grouped("service_type")
K["billing_type_kpis"] = grouped("billing_type")
K["skill_comeback"] = f"SELECT skill_level, count(*) AS work_orders, {r(share('caused_repeat_visit'))} AS comeback_rate, {r(share('qc_passed_first_time'))} AS qc_first_pass_rate FROM fact_service WHERE skill_level IS NOT NULL GROUP BY 1"
K["appt_rates"] = f"SELECT center_name, month, {APPT2} FROM fact_appointments GROUP BY 1, 2"
K["cancellation_by_lead"] = f"SELECT lead_time_band, {APPT2} FROM fact_appointments GROUP BY 1"
K["reason_share"] = f"SELECT cancellation_reason, count(*) AS cancellations, {r(div('count(*)', 'sum(count(*)) OVER ()'))} AS share FROM fact_appointments WHERE is_cancelled AND cancellation_reason IS NOT NULL GROUP BY 1"


def ranked(c: str, desc: str = "") -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (ORDER BY {c} {desc} NULLS LAST) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)::DOUBLE / (count({c}) OVER ())::DOUBLE END"


_CARD = f"""SELECT g.*, g2.on_time AS x1, g2.rt AS x2, g2.mg AS x3, g2.tat AS x4, a.cr AS x5, a.appointments, a.cancellation_rate, a.no_show_rate, u.utilisation
FROM ({grouped('center_name, region')}) g JOIN (SELECT center_name, {share('on_time_flag')} AS on_time, {avg('rating')} AS rt, {div(Z('revenue') + ' - ' + Z(COST), Z('revenue'))} AS mg, {avg('turnaround_hours')} AS tat
  FROM fact_service GROUP BY 1) g2 USING (center_name)
LEFT JOIN (SELECT center_name, count(*) AS appointments, {share('is_cancelled')} AS cr, {r(share('is_cancelled'))} AS cancellation_rate, {r(share('is_no_show'))} AS no_show_rate FROM fact_appointments GROUP BY 1) a USING (center_name)
LEFT JOIN (SELECT center_name, {UTIL} AS utilisation FROM technician_month WHERE center_name IS NOT NULL GROUP BY 1) u USING (center_name)"""
cte("score_parts", f"""SELECT *, list_filter([{ranked('x1')}, {ranked('x2')}, {ranked('x3')}, {ranked('x4', 'DESC')}, {ranked('x5', 'DESC')}], lambda x: x IS NOT NULL) AS rs FROM ({_CARD})""")
cte("scorecard", """SELECT * EXCLUDE (x1, x2, x3, x4, x5, rs, s), s AS performance_score, rank() OVER (ORDER BY s DESC NULLS LAST)::INT AS rank
FROM (SELECT *, round(list_sum(rs) / len(rs)::DOUBLE, 12) AS s FROM score_parts)""")
K["centre_scorecard"] = "SELECT * REPLACE (round(performance_score, 6) AS performance_score) FROM scorecard"
K["index_vs_average"] = """SELECT center_name, round(performance_score * 100, 6) AS performance_index, round(avg(performance_score * 100) OVER (), 6) AS average_index,
  performance_score * 100 >= avg(performance_score * 100) OVER () - 1e-9 AS at_or_above FROM scorecard"""
_U = f"sum(jobs)::BIGINT AS jobs, sum(service_hours)::DOUBLE AS service_hours, sum(available_hours)::DOUBLE AS available_hours, {UTIL} AS utilisation"
K["utilisation_by"] = f"SELECT center_name, {_U} FROM technician_month WHERE center_name IS NOT NULL GROUP BY 1"
K["technician_scorecard"] = f"""SELECT * FROM (SELECT technician_id, {_U}, max(skill_level) AS skill_level, max(center_name) AS center_name, sum(comebacks_caused)::BIGINT AS comebacks_caused FROM technician_month GROUP BY 1)
LEFT JOIN (SELECT technician_id, count(*) AS work_orders, {r(share('on_time_flag'))} AS on_time_pct, {r(avg('rating'))} AS avg_rating, {r(share('qc_passed_first_time'))} AS qc_first_pass_rate,
  {r(share('caused_repeat_visit'))} AS comeback_rate, {r(avg('duration_variance_hours'))} AS avg_duration_variance FROM fact_service WHERE technician_id IS NOT NULL GROUP BY 1) USING (technician_id)"""
_MONTHS = [f"{y}-{m:02d}" for y in range(1995, 2002) for m in range(1, 13) if (y, m) <= (2001, 8)]
K["util_matrix"] = "SELECT technician_id, " + ", ".join(
    f"""{r(div(f"sum(service_hours) FILTER (WHERE month = '{m}')", f"sum(available_hours) FILTER (WHERE month = '{m}')"))} AS "{m}\"""" for m in _MONTHS
) + " FROM fact_technician_month GROUP BY 1"


def bands(col: str, rows: list[tuple[str, str]], src: str = "fact_service") -> str:
    cases = " ".join(f"WHEN {cond} THEN '{label}'" for label, cond in rows)
    labels = ", ".join(f"('{label}')" for label, _ in rows)
    return f"""SELECT band, coalesce(n, 0) AS work_orders, {r(div('coalesce(n, 0)', 'sum(n) OVER ()'))} AS share FROM (VALUES {labels}) l(band)
  LEFT JOIN (SELECT CASE {cases} END AS band, count(*) AS n FROM {src} WHERE {col} IS NOT NULL GROUP BY 1) USING (band)"""


def steps(col: str, edges: list[int], first: str) -> list[tuple[str, str]]:
    out = [(first, f"{col} <= {edges[0]}")]
    out += [(f"{a}-{b}h", f"{col} <= {b}") for a, b in zip(edges, edges[1:])]
    return [*out, (f"> {edges[-1]}h", f"{col} > {edges[-1]}")]


K["delay_distribution"] = bands("late_hours", steps("late_hours", [0, 1, 2, 4, 8, 24], "On time"))
K["turnaround_distribution"] = bands("turnaround_hours", steps("turnaround_hours", [2, 4, 8, 24, 72], "<= 2h"))
K["wait_by_weekday"] = f"SELECT dayname(service_date) AS weekday, {r(avg('wait_hours'))} AS avg_wait, count(work_order_id) AS work_orders FROM fact_service GROUP BY 1"
K["rating_matrix"] = "SELECT service_type, " + ", ".join(
    f"""{r(f"(sum(rating) FILTER (WHERE center_name = '{g}'))::DOUBLE / nullif(count(rating) FILTER (WHERE center_name = '{g}'), 0)")} AS "{g}\""""
    for g in [f"NATION_{i}" for i in range(25)]
) + " FROM fact_service WHERE rating IS NOT NULL GROUP BY 1"
K["feedback_distribution"] = f"SELECT feedback_category, count(*) AS responses, {r(div('count(*)', 'sum(count(*)) OVER ()'))} AS share FROM fact_service WHERE feedback_category IS NOT NULL GROUP BY 1"
K["parts_by_category"] = f"""SELECT part_category, sum(quantity)::BIGINT AS quantity, sum(quantity * unit_cost)::DOUBLE AS parts_cost, {r(div('sum(quantity * unit_cost)', 'sum(sum(quantity * unit_cost)) OVER ()'))} AS share
  FROM part_usage JOIN parts USING (part_id) WHERE work_order_id IN (SELECT work_order_id FROM fact_service) GROUP BY 1"""
K["tercile_flag"] = f"""WITH g AS (SELECT center_name, {share('on_time_flag')} AS v FROM fact_service GROUP BY 1),
  p AS (SELECT count(DISTINCT v) AS d, quantile_cont(v, 1.0/3) AS lo, quantile_cont(v, 2.0/3) AS hi FROM g)
SELECT center_name, round(v, 6) AS on_time_pct, CASE WHEN d >= 3 AND v >= hi THEN 'good' WHEN d >= 3 AND v <= lo THEN 'bad' ELSE '' END AS flag FROM g, p"""
K["better_than"] = f"""WITH n AS (SELECT {share('is_cancelled')} AS ref FROM fact_appointments), g AS (SELECT center_name, {share('is_cancelled')} AS v FROM fact_appointments GROUP BY 1)
SELECT center_name, round(v, 6) AS cancellation_rate, round(ref, 6) AS reference, CASE WHEN v <= ref THEN 'accent' ELSE 'warn' END AS verdict FROM g, n"""


def ends(src: str, label: str, value: str) -> str:
    """Lowest and highest label, ties to the smaller label."""
    return f"""SELECT (SELECT {label} FROM {src} WHERE {value} IS NOT NULL ORDER BY {value}, {label} LIMIT 1) AS lowest, (SELECT min({value}) FROM {src}) AS lowest_value,
  (SELECT {label} FROM {src} WHERE {value} IS NOT NULL ORDER BY {value} DESC, {label} LIMIT 1) AS highest, (SELECT max({value}) FROM {src}) AS highest_value"""


K["extremes"] = f"WITH g AS (SELECT center_name, {share('is_cancelled')} AS v FROM fact_appointments GROUP BY 1), e AS ({ends('g', 'center_name', 'v')}) SELECT lowest, round(lowest_value, 6) AS lowest_value, highest, round(highest_value, 6) AS highest_value FROM e"
K["insight_executive"] = f"""WITH g AS (SELECT center_name, {share('on_time_flag')} AS v FROM fact_service GROUP BY 1), e AS ({ends('g', 'center_name', 'v')})
SELECT lowest AS worst_centre, round(lowest_value, 6) AS worst_on_time, highest AS best_centre, round(highest_value, 6) AS best_on_time, round((highest_value - lowest_value) * 100, 6) AS gap_points,
  (SELECT center_name FROM scorecard ORDER BY rank, center_name LIMIT 1) AS top_centre FROM e"""
K["insight_operations"] = f"""WITH g AS (SELECT center_name, {avg('turnaround_hours')} AS v, quantile_cont(turnaround_hours::DOUBLE, 0.5) AS md FROM fact_service GROUP BY 1), e AS ({ends('g', 'center_name', 'v')}),
  w AS (SELECT dayname(service_date) AS weekday, {avg('wait_hours')} AS v FROM fact_service GROUP BY 1), x AS ({ends('w', 'weekday', 'v')})
SELECT e.highest AS slowest_centre, round(e.highest_value, 6) AS slowest_turnaround, x.highest AS longest_wait_day, round(x.highest_value, 6) AS longest_wait, round(g.md, 6) AS median_turnaround FROM e, x, g WHERE g.center_name = e.highest"""
_MG = div(f"{Z('revenue')} - {Z(COST)}", Z("revenue"))
K["insight_financial"] = f"""WITH g AS (SELECT service_type, {_MG} AS v FROM fact_service GROUP BY 1), e AS ({ends('g', 'service_type', 'v')}), t AS (SELECT month, {Z('revenue')} - {Z(COST)} AS p FROM fact_service GROUP BY 1)
SELECT highest AS best_type, round(highest_value, 6) AS best_margin, lowest AS worst_type, round(lowest_value, 6) AS worst_margin, (SELECT month FROM t ORDER BY p DESC, month LIMIT 1) AS peak_month, (SELECT max(p) FROM t)::DOUBLE AS peak_profit FROM e"""
K["insight_customer"] = f"""WITH g AS (SELECT center_name, {avg('rating')} AS v FROM fact_service GROUP BY 1), e AS ({ends('g', 'center_name', 'v')}), l AS (SELECT lead_time_band, {share('is_cancelled')} AS v FROM fact_appointments GROUP BY 1), x AS ({ends('l', 'lead_time_band', 'v')})
SELECT e.lowest AS lowest_rated_centre, round(e.lowest_value, 6) AS lowest_rating, x.highest AS worst_lead_band, round(x.highest_value, 6) AS worst_cancellation_rate FROM e, x"""

PICK = "region IN ('ASIA', 'EUROPE')"
TYPE = "IN ('1-URGENT', '5-LOW') AND model IN ('Model A', 'Model C')"
IN_DATES = "BETWEEN DATE '1997-03-15' AND DATE '1999-02-10'"
K["slicer_filter"] = f"SELECT work_order_id, center_name, service_type, model FROM fact_service WHERE service_date {IN_DATES} AND {PICK} AND service_type {TYPE}"
K["month_overlap_filter"] = f"SELECT center_name, count(*) AS technician_months, sum(service_hours)::DOUBLE AS service_hours FROM technician_month WHERE month BETWEEN '1997-03' AND '1999-02' AND {PICK} GROUP BY 1"
K["slicer_selection"] = f"""SELECT 'selection' AS what, (SELECT count(*) FROM fact_service WHERE service_date {IN_DATES} AND {PICK} AND service_type {TYPE}) AS jobs,
  (SELECT sum(revenue)::DOUBLE FROM fact_service WHERE service_date {IN_DATES} AND {PICK} AND service_type {TYPE}) AS revenue,
  (SELECT count(*) FROM fact_appointments WHERE scheduled_date {IN_DATES} AND {PICK} AND requested_service_type {TYPE}) AS appointments,
  (SELECT sum(available_hours)::DOUBLE FROM technician_month WHERE month BETWEEN '1997-03' AND '1999-02' AND {PICK}) AS available_hours"""
K["slicer_options"] = """SELECT DISTINCT 'region' AS slicer, region AS choice FROM fact_service UNION SELECT 'centre', center_name FROM fact_service UNION SELECT 'service_type', service_type FROM fact_service
  UNION SELECT 'model', model FROM fact_service UNION SELECT 'min_date', strftime(min(service_date), '%Y-%m-%d') FROM fact_service UNION SELECT 'max_date', strftime(max(service_date), '%Y-%m-%d') FROM fact_service"""
# A cube gives what the facts give, whole and sliced.
K["cube_headline"], K["cube_monthly_trend"], K["cube_centre_scorecard"] = K["headline"], K["monthly_trend"], K["centre_scorecard"]
JOBS_IN = f"(SELECT * FROM fact_service WHERE service_date {IN_DATES} AND {PICK} AND service_type {TYPE})"
K["cube_slicer_headline"] = f"""SELECT * FROM ({TOTAL.replace('fact_service', JOBS_IN)})
  CROSS JOIN (SELECT {APPT} FROM fact_appointments WHERE scheduled_date {IN_DATES} AND {PICK} AND requested_service_type {TYPE})
  CROSS JOIN (SELECT {UTIL} AS utilisation FROM technician_month WHERE month BETWEEN '1997-03' AND '1999-02' AND {PICK})"""
K["cube_slicer_months"] = K["monthly_trend"].replace("fact_service", JOBS_IN)
SQL = {k: query(v) for k, v in K.items()}
