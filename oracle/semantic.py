"""Semantic measures, visuals, time intelligence, import steps, business hours, raw tables."""

import oracle.metrics as om
from oracle.base import avg, cte, div, query, r, share
from oracle.kpis import IN_DATES, PICK, TYPE, ends
from oracle.quality import MK, TS

cte("b_fact", "SELECT * REPLACE (coalesce(technician_id::VARCHAR, 'UNASSIGNED') AS technician_id, coalesce(skill_level, 'Unassigned') AS skill_level) FROM fact_service")
cte("b_tech", "SELECT * REPLACE (technician_id::VARCHAR AS technician_id) FROM technician_month")
cte("b_usage", "SELECT f.*, p.part_category, u.quantity * p.unit_cost AS line_cost FROM part_usage u LEFT JOIN parts p USING (part_id) JOIN b_fact f USING (work_order_id)")


def rate(flag: str) -> str:
    return div(f"count(*) FILTER (WHERE {flag})", "count(*)")


COST = "(sum(labor_cost) + sum(parts_cost))"
MEAS = {
    "total_revenue": ("fact", "sum(revenue)::DOUBLE"), "labour_cost": ("fact", "sum(labor_cost)::DOUBLE"), "parts_cost": ("fact", "sum(parts_cost)::DOUBLE"), "total_cost": ("fact", f"{COST}::DOUBLE"),
    "profit": ("fact", f"(sum(revenue) - {COST})::DOUBLE"), "profit_margin_pct": ("fact", div(f"sum(revenue) - {COST}", "sum(revenue)")), "avg_service_cost": ("fact", div(COST, "count(*)")),
    "parts_share_of_cost_pct": ("fact", div("sum(parts_cost)", COST)), "total_estimated_cost": ("fact", "sum(estimated_cost)::DOUBLE"), "cost_variance": ("fact", "sum(cost_variance)::DOUBLE"),
    "cost_variance_pct": ("fact", div("sum(cost_variance)", "sum(estimated_cost)")), "cost_overrun_rate": ("fact", rate("cost_overrun_flag")), "parts_cost_catalogue": ("usage", "sum(line_cost)::DOUBLE"),
    "completed_services": ("fact", "count(*)"), "on_time_pct": ("fact", rate("on_time_flag")), "avg_turnaround_hours": ("fact", avg("turnaround_hours")), "median_turnaround_hours": ("fact", "quantile_cont(turnaround_hours::DOUBLE, 0.5)"),
    "avg_wait_hours": ("fact", avg("wait_hours")), "avg_estimated_hours": ("fact", avg("estimated_hours")), "avg_actual_hours": ("fact", avg("actual_hours")), "avg_duration_variance_hours": ("fact", avg("duration_variance_hours")),
    "parts_delay_rate": ("fact", rate("parts_delay_flag")), "qc_first_pass_pct": ("fact", rate("qc_passed_first_time")), "comeback_rate": ("fact", rate("caused_repeat_visit")),
    "service_hours": ("tech", "sum(service_hours)::DOUBLE"), "available_hours": ("tech", "sum(available_hours)::DOUBLE"), "technician_utilisation_pct": ("tech", div("sum(service_hours)", "sum(available_hours)")),
    "avg_rating": ("fact", avg("rating")), "rated_services": ("fact", "count(rating)"), "csat_pct": ("fact", share("rating >= 4")), "appointments": ("appts", "count(*)"), "cancelled_appointments": ("appts", "count(*) FILTER (WHERE is_cancelled)"),
    "no_show_appointments": ("appts", "count(*) FILTER (WHERE is_no_show)"), "cancellation_rate": ("appts", rate("is_cancelled")), "no_show_rate": ("appts", rate("is_no_show")), "customers": ("customers", "count(*)"),
    "repeat_customers": ("customers", "count(*) FILTER (WHERE orders >= 2)"), "repeat_visit_rate": ("customers", share("orders >= 2")),
}
COUNTS = {"completed_services", "rated_services", "appointments", "cancelled_appointments", "no_show_appointments", "customers", "repeat_customers"}
_LB = "CASE WHEN late_hours <= 0 THEN 'On time' WHEN late_hours <= 1 THEN '0-1h' WHEN late_hours <= 2 THEN '1-2h' WHEN late_hours <= 4 THEN '2-4h' WHEN late_hours <= 8 THEN '4-8h' WHEN late_hours <= 24 THEN '8-24h' ELSE '> 24h' END"
_TB = "CASE WHEN turnaround_hours <= 2 THEN '<= 2h' WHEN turnaround_hours <= 4 THEN '2-4h' WHEN turnaround_hours <= 8 THEN '4-8h' WHEN turnaround_hours <= 24 THEN '8-24h' WHEN turnaround_hours <= 72 THEN '24-72h' ELSE '> 72h' END"


def blank(c: str) -> str:
    return f"coalesce({c}, '(Blank)')"


DIM = {
    "month_start": {"fact": f"strftime(date_trunc('month', service_date), '{MK}')", "appts": f"strftime(date_trunc('month', scheduled_date), '{MK}')", "tech": "month || '-01'"},
    "center_name": {t: blank("center_name") for t in ("fact", "appts", "tech")}, "region": {t: blank("region") for t in ("fact", "appts", "tech")},
    "service_type": {"fact": blank("service_type"), "appts": blank("requested_service_type")}, "technician_id": {"fact": "technician_id", "tech": "technician_id"}, "skill_level": {"fact": "skill_level", "tech": "skill_level"},
    "weekday_name": {"fact": "dayname(service_date)", "appts": "dayname(scheduled_date)"}, "delay_band": {"fact": _LB}, "turnaround_band": {"fact": _TB}, "billing_type": {"fact": blank("billing_type")},
    "feedback_category": {"fact": blank("feedback_category")}, "lead_time_band": {"appts": "lead_time_band"}, "cancellation_reason": {"appts": blank("cancellation_reason")}, "part_category": {"usage": blank("part_category")},
}
SRC = {"fact": "b_fact", "appts": "fact_appointments", "tech": "b_tech", "usage": "b_usage"}
_F = {"fact": f"service_date {IN_DATES} AND {PICK} AND service_type {TYPE}", "appts": f"scheduled_date {IN_DATES} AND {PICK} AND requested_service_type {TYPE}", "tech": f"month BETWEEN '1997-03' AND '1999-02' AND {PICK}"}
_F["usage"] = _F["fact"]


def visual(dims: str, names: str, filtered: bool = False) -> str:
    d, n = dims.split(), names.split()
    tables: dict[str, list[str]] = {}
    for x in n:
        tables.setdefault(MEAS[x][0], []).append(x)
    full, part = [], []
    for t, ms in tables.items():
        base = "fact" if t == "customers" else t
        used = [x for x in d if base in DIM[x] or (t == "usage" and "fact" in DIM[x])]
        keys = ", ".join(f"{DIM[x].get(base) or DIM[x]['fact']} AS {x}" for x in used)
        src = f"(SELECT * FROM {SRC[base]}" + (f" WHERE {_F[base]})" if filtered else ")")
        if t == "customers":
            src = f"(SELECT {keys + ', ' if keys else ''}customer_id, count(*) AS orders FROM {src} GROUP BY ALL)"
            keys = ", ".join(used)
        cols = ", ".join(f"{MEAS[x][1]} AS {x}" for x in ms)
        sql = f"(SELECT {keys + ', ' if keys else ''}{cols} FROM {src}{' GROUP BY ' + ', '.join(str(i + 1) for i in range(len(used))) if used else ''})"
        (full if len(used) == len(d) else part).append((sql, used))
    out = full[0][0]
    for sql, _ in full[1:]:
        out += f" FULL JOIN {sql} USING ({', '.join(d)})" if d else f" CROSS JOIN {sql}"
    for sql, used in part:
        out += f" LEFT JOIN {sql} USING ({', '.join(used)})" if used else f" CROSS JOIN {sql}"
    sel = ", ".join([*d, *[x if x in COUNTS else f"round({x}, 6) AS {x}" for x in n]])
    return f"SELECT {sel} FROM {out}"


ALL = " ".join(MEAS)
S: dict[str, str] = {
    "measures_total": visual("", ALL),
    "measures_by_centre": visual("center_name", ALL.replace("parts_cost_catalogue ", "")),
    "measures_filtered": visual("", ALL, True),
    "visual_exec_month": visual("month_start", "total_revenue profit profit_margin_pct on_time_pct"),
    "visual_ops_centre": visual("center_name", "avg_turnaround_hours median_turnaround_hours"),
    "visual_ops_technician": visual("technician_id", "technician_utilisation_pct"),
    "visual_ops_service_type": visual("service_type", "completed_services avg_turnaround_hours on_time_pct avg_estimated_hours avg_actual_hours avg_duration_variance_hours parts_delay_rate avg_rating total_revenue"),
    "visual_ops_delay": visual("delay_band", "completed_services"),
    "visual_ops_turnaround": visual("turnaround_band", "completed_services"),
    "visual_ops_weekday": visual("weekday_name", "avg_wait_hours"),
    "visual_fin_month": visual("month_start", "total_revenue total_cost profit profit_margin_pct cost_overrun_rate cost_variance"),
    "visual_fin_centre": visual("center_name", "profit parts_cost labour_cost"),
    "visual_fin_service_type": visual("service_type", "profit cost_variance"),
    "visual_fin_skill": visual("skill_level", "cost_variance"),
    "visual_fin_billing": visual("billing_type", "total_revenue"),
    "visual_fin_category": visual("part_category", "parts_cost_catalogue"),
    "visual_cust_month": visual("month_start", "avg_rating csat_pct"),
    "visual_cust_centre": visual("center_name", "cancellation_rate repeat_visit_rate comeback_rate"),
    "visual_cust_lead": visual("lead_time_band", "cancellation_rate"),
    "visual_cust_reason": visual("cancellation_reason", "cancelled_appointments"),
    "visual_cust_skill": visual("skill_level", "comeback_rate"),
    "visual_cust_feedback": visual("feedback_category", "rated_services"),
    "visual_query": visual("region service_type", "completed_services on_time_pct appointments technician_utilisation_pct"),
}
S["visual_cust_matrix"] = "SELECT service_type, " + ", ".join(
    f"""round((sum(rating) FILTER (WHERE center_name = '{g}'))::DOUBLE / nullif(count(rating) FILTER (WHERE center_name = '{g}'), 0), 6) AS "{g}\"""" for g in [f"NATION_{i}" for i in range(25)]
) + " FROM b_fact GROUP BY 1"
_M12 = [f"{y}-{m:02d}" for y in range(1995, 2002) for m in range(1, 13) if f"{y}-{m:02d}" <= "2001-08"]
S["visual_ops_matrix"] = "SELECT technician_id, " + ", ".join(
    f"""{r(div(f"sum(service_hours) FILTER (WHERE month = '{m}')", f"sum(available_hours) FILTER (WHERE month = '{m}')"))} AS "{m}-01\"""" for m in _M12
) + " FROM b_tech GROUP BY 1"
cte("by_month", f"SELECT date_trunc('month', service_date)::DATE AS ms, sum(revenue) AS rv, sum(revenue) - {COST} AS pf FROM b_fact GROUP BY 1")


def shift(n: int, suffix: str, pct: str) -> str:
    cols = ", ".join(
        f"b.{c}::DOUBLE AS {name}_{suffix}, {r(div(f'a.{c} - b.{c}', f'b.{c}'))} AS {name}_{pct}" for c, name in (("rv", "total_revenue"), ("pf", "profit"))
    )
    return f"SELECT strftime(a.ms, '{MK}') AS month_start, a.rv::DOUBLE AS total_revenue, a.pf::DOUBLE AS profit, {cols} FROM by_month a LEFT JOIN by_month b ON b.ms + INTERVAL {n} MONTH = a.ms"


S["prev_month"], S["prior_year"] = shift(1, "pm", "mom_pct"), shift(12, "py", "yoy_pct")
S["ytd"] = f"SELECT strftime(ms, '{MK}') AS month_start, rv::DOUBLE AS total_revenue, pf::DOUBLE AS profit, (sum(rv) OVER (PARTITION BY year(ms) ORDER BY ms))::DOUBLE AS total_revenue_ytd FROM by_month"
_IDX = f"""WITH f AS (SELECT center_name, {rate('on_time_flag')} AS a, {avg('rating')} AS b, {div(f'sum(revenue) - {COST}', 'sum(revenue)')} AS c, {avg('turnaround_hours')} AS d FROM b_fact GROUP BY 1),
  x AS (SELECT f.*, e FROM f FULL JOIN (SELECT center_name, {rate('is_cancelled')} AS e FROM fact_appointments GROUP BY 1) USING (center_name)),
  k AS (SELECT center_name, round((rank() OVER (ORDER BY a NULLS FIRST) + rank() OVER (ORDER BY b NULLS FIRST) + rank() OVER (ORDER BY c NULLS FIRST) + rank() OVER (ORDER BY d DESC NULLS LAST) + rank() OVER (ORDER BY e DESC NULLS LAST))::DOUBLE * 100 / (count(*) OVER () * 5), 9) AS i FROM x)"""
S["perf_index"] = f"{_IDX} SELECT center_name, round(i, 6) AS performance_index, rank() OVER (ORDER BY i DESC)::INT AS centre_rank FROM k"
S["centre_colours"] = f"""WITH n AS (SELECT {rate('on_time_flag')} AS n FROM b_fact) SELECT center_name, CASE WHEN {rate('on_time_flag')} >= max(n) THEN '#00A67E' ELSE '#EB6834' END AS on_time_colour,
  CASE WHEN coalesce(sum(revenue) - {COST}, 0) >= 0 THEN '#00A67E' ELSE '#EB6834' END AS profit_colour FROM b_fact, n GROUP BY 1"""
S["skill_colours"] = """SELECT skill_level, CASE skill_level WHEN 'Junior' THEN '#EB6834' WHEN 'Mid' THEN '#2A78D6' WHEN 'Senior' THEN '#00A67E' WHEN 'Master' THEN '#4A3AA7' ELSE '#A9B4B0' END AS colour, count(*) AS technicians
  FROM (SELECT skill_level FROM technicians UNION ALL SELECT 'Unassigned') GROUP BY 1"""
_P1 = "printf('%.1f%%', {0} * 100)".format
S["key_insights"] = f"""WITH n AS (SELECT {rate('on_time_flag')} AS n FROM b_fact), g AS (SELECT center_name, {rate('on_time_flag')} AS a, {avg('turnaround_hours')} AS t, {avg('rating')} AS q FROM b_fact GROUP BY 1),
  s AS (SELECT service_type, {div(f'sum(revenue) - {COST}', 'sum(revenue)')} AS m FROM b_fact GROUP BY 1), e1 AS ({ends('g', 'center_name', 'a')}), e2 AS ({ends('g', 'center_name', 't')}), e3 AS ({ends('s', 'service_type', 'm')}), e4 AS ({ends('g', 'center_name', 'q')})
SELECT 'executive' AS page, lowest || ' has the lowest on-time rate at ' || {_P1('lowest_value')} || ' (network ' || {_P1('n')} || ').' AS insight FROM e1, n
UNION ALL SELECT 'operations', highest || ' is slowest, averaging ' || printf('%.1f', highest_value) || ' h turnaround.' FROM e2
UNION ALL SELECT 'financial', highest || ' earns the best margin (' || {_P1('highest_value')} || ') while ' || lowest || ' earns the lowest (' || {_P1('lowest_value')} || ').' FROM e3
UNION ALL SELECT 'customer', lowest || ' has the lowest average rating (' || printf('%.2f', lowest_value) || ' / 5).' FROM e4"""


def short(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' WHEN abs({x}) >= 10000000 THEN '₹' || printf('%.1f', {x} / 10000000.0::DOUBLE) || ' Cr' WHEN abs({x}) >= 100000 THEN '₹' || printf('%.1f', {x} / 100000.0::DOUBLE) || ' L' ELSE '₹' || format('{{:,}}', round({x})::BIGINT) END"


_LAB = "All centres | Selected regions | 15 Mar 1997 - 10 Feb 1999"
S["report_header"] = f"""WITH t AS (SELECT sum(revenue)::DOUBLE AS a, {COST}::DOUBLE AS b, (sum(revenue) - {COST})::DOUBLE AS c FROM b_fact WHERE {_F['fact']})
SELECT {short('a')} AS revenue_short, {short('b')} AS cost_short, {short('c')} AS profit_short, '{_LAB}' AS selection_label, 'Monthly revenue and profit - {_LAB}' AS title_trend, 'Turnaround time by centre (hours) - {_LAB}' AS title_turnaround,
  'Profit by service centre - {_LAB}' AS title_profit, 'Rating trend - {_LAB}' AS title_rating, 'Synthetic data for demonstration. Amounts in INR.' AS footer FROM t"""
S["dim_fill_null"] = "SELECT technician_id, skill_level, count(*) AS jobs FROM b_fact GROUP BY 1, 2"
S["dim_unknown_member"] = """SELECT technician_id::VARCHAR AS technician_id, skill_level, certification, hourly_cost::DOUBLE AS hourly_cost, CASE skill_level WHEN 'Junior' THEN 1 WHEN 'Mid' THEN 2 WHEN 'Senior' THEN 3 ELSE 4 END AS skill_sort FROM technicians
  UNION ALL SELECT 'UNASSIGNED', 'Unassigned', 'Not recorded', NULL, 5"""
S["dim_distinct"] = "SELECT DISTINCT 'service_type' AS dimension, requested_service_type AS member FROM appointments UNION ALL SELECT DISTINCT 'model', model FROM vehicles"
S["dim_date_labels"] = f"SELECT strftime(service_date, '{MK}') AS date, strftime(date_trunc('month', service_date), '{MK}') AS month_start, strftime(service_date, '%b %y') AS month_label, isodow(service_date)::INT AS weekday_sort, count(*) AS jobs FROM fact_service GROUP BY service_date"
S["sort_key"] = "SELECT lead_time_band, CASE lead_time_band WHEN 'Same day' THEN 1 WHEN '1-3 days' THEN 2 WHEN '4-7 days' THEN 3 WHEN '8-14 days' THEN 4 WHEN '15+ days' THEN 5 ELSE 0 END AS lead_band_sort, count(*) AS appointments FROM fact_appointments GROUP BY 1"
# Three daily extracts with bad lines: what is wrong with a line, and the first good one of each customer.
EXTRACT = " UNION ALL ".join(
    f"""SELECT {d} AS day, c_custkey AS k, c_name AS name, c_mktsegment AS segment, c_custkey * 10 + {d} AS balance,
    '2024-01-0{d + 1} 10:00:' || lpad((c_custkey % 60)::VARCHAR, 2, '0') AS stamp, c_custkey % 19 = {d} AS text_balance, c_custkey % 29 = {d} AS text_stamp,
    c_custkey % 17 = {d} AS short, c_custkey % 23 = {d} AS long FROM customer WHERE c_custkey % {every} = 0"""
    for d, every in enumerate((1, 2, 3))
)
S["csv_first_rows"] = f"""SELECT k AS customer_id, name, segment, balance::DOUBLE AS balance, stamp AS registered FROM ({EXTRACT})
  WHERE NOT (short OR long OR text_balance OR text_stamp) QUALIFY row_number() OVER (PARTITION BY k ORDER BY day) = 1"""
S["csv_rejects"] = f"""SELECT 'day' || (day + 1) AS day, k || ',' || name || ',' || segment || CASE WHEN short THEN '' ELSE ',' || CASE WHEN text_balance THEN 'n/a' ELSE balance::VARCHAR END
  || ',' || CASE WHEN text_stamp THEN 'yesterday' ELSE stamp END || CASE WHEN long THEN ',more' ELSE '' END END AS line
FROM ({EXTRACT}) WHERE short OR long OR text_balance OR text_stamp"""
S["load_verify"] = " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", count(*) AS expected, count(*) AS actual, TRUE AS ok FROM {t}" for t in ("customers", "service_centers", "technicians", "vehicles", "appointments", "work_orders", "parts", "part_usage", "financials", "feedback")
)

# Business clock by open minutes since Monday 1995-01-02: 600 a day, six days a week.


def opened(ts: str) -> str:
    day = f"(({ts})::DATE - DATE '1995-01-02')"
    mins = f"least(greatest((epoch({ts}) - epoch(({ts})::DATE)) / 60.0::DOUBLE - 540, 0), 600)"
    return f"(floor({day} / 7.0::DOUBLE) * 3600 + least({day} - floor({day} / 7.0::DOUBLE) * 7, 6) * 600 + CASE WHEN {day} - floor({day} / 7.0::DOUBLE) * 7 >= 6 THEN 0 ELSE {mins} END)"


def instant(m: str, day: str, rest: str) -> str:
    cal = f"(floor({day} / 6.0::DOUBLE) * 7 + {day} - floor({day} / 6.0::DOUBLE) * 6)"
    return f"strftime(TIMESTAMP '1995-01-02' + to_minutes(({cal} * 1440 + 540 + {rest})::BIGINT), '{TS}')"


def aligned(ts: str) -> str:
    m = opened(ts)
    return instant(m, f"floor({m} / 600.0::DOUBLE)", f"({m} - floor({m} / 600.0::DOUBLE) * 600)")


def worked(ts: str, minutes: str) -> str:
    m = f"({opened(ts)} + {minutes})"
    day = f"(ceil({m} / 600.0::DOUBLE) - 1)"  # a result on the border belongs to the day that closes
    return instant(m, day, f"({m} - {day} * 600)")


S["business_hours"] = f"""SELECT work_order_id, {aligned('end_time')} AS next_open, {worked('check_in_time', '(estimated_hours::DOUBLE + 1.5) * 60')} AS promise,
  {worked('end_time', 'actual_hours::DOUBLE * 300')} AS long_job FROM work_orders"""
S["round_quarter"] = "SELECT work_order_id, greatest(0.25::DOUBLE, round_even(turnaround_hours::DOUBLE * 4, 0) / 4) AS billed_hours FROM fact_service"

# ---- single rules --------------------------------------------------------------------
S["dedup_first"] = "SELECT usage_id, part_id, quantity FROM c_part_usage"
S["canonicalise"] = "SELECT customer_id, region FROM c_customers"
S["parse_mixed_dates"] = f"SELECT appointment_id, strftime(booking_date, '{MK}') AS booking_date, strftime(scheduled_date, '{MK}') AS scheduled_date FROM c_appointments"
S["orphan_fk"] = "SELECT appointment_id, vehicle_id FROM c_appointments"
S["impute_via_lookup"] = "SELECT appointment_id, center_id FROM c_appointments"
S["swap_times"] = f"SELECT work_order_id, strftime(start_time, '{TS}') AS start_time, strftime(end_time, '{TS}') AS end_time FROM c_work_orders"
S["null_invalid_fk"] = "SELECT work_order_id, technician_id FROM c_work_orders"
S["fix_sign"] = "SELECT work_order_id, labor_cost::DOUBLE AS labor_cost FROM c_financials"
S["impute_from_agg"] = "SELECT work_order_id, parts_cost::DOUBLE AS parts_cost FROM c_financials"
S["fix_decimal_shift"] = "SELECT work_order_id, revenue::DOUBLE AS revenue FROM c_financials"
S["cascade_delete"] = "SELECT feedback_id, work_order_id, rating::INT AS rating FROM c_feedback"
S["reconcile"] = "SELECT work_order_id, (parts_cost - coalesce(used, 0))::DOUBLE AS difference FROM c_financials LEFT JOIN c_usage_cost USING (work_order_id) WHERE abs(parts_cost - coalesce(used, 0)) > 1"

# ---- raw tables ------------------------------------------------------------------------
S["lineitem_spearman"] = om.rho("lineitem", "l_quantity", "l_extendedprice")
S["lineitem_chi2"] = om.chi2("lineitem", "l_returnflag", "l_linestatus")
S["lineitem_abc"] = f"""WITH p AS (SELECT l_partkey, sum(l_extendedprice::DECIMAL(14,2)) AS value FROM lineitem GROUP BY 1),
  q AS (SELECT *, {div('value', 'sum(value) OVER ()')} AS vs, {div('sum(value) OVER (ORDER BY value DESC)', 'sum(value) OVER ()')} AS cs, {div('sum(value) OVER (ORDER BY value DESC) - sum(value) OVER (PARTITION BY value)', 'sum(value) OVER ()')} AS ab FROM p)
SELECT l_partkey, value::DOUBLE AS value, round(vs, 6) AS value_share, round(cs, 6) AS cum_share, CASE WHEN ab < 0.80 THEN 'A' WHEN ab < 0.95 THEN 'B' ELSE 'C' END AS abc_class FROM q"""
S["lineitem_kruskal"] = om.kruskal("price").replace("SELECT center_id AS g,", "SELECT l_returnflag AS g,").replace("FROM fs WHERE", "FROM (SELECT l_returnflag, l_extendedprice::DECIMAL(14,2) AS price FROM lineitem) WHERE").replace("round(h, 6)", "round(h, 4)").replace("round(h / (N - 1), 6)", "round(h / (N - 1), 4)").replace(", 6) AS p,", ", 4) AS p,")
_O = "o_totalprice"
S["orders_describe"] = f"""SELECT '{_O}' AS "column", count({_O}) AS count, round(sum({_O}::DECIMAL(18,2))::DOUBLE / count({_O}), 3) AS mean, round(stddev_samp({_O}), 3) AS std, round(min({_O}), 3) AS min, round(max({_O}), 3) AS max, round(skewness({_O}), 3) AS skew,
  {r(om.md(_O, 0.25), 3)} AS p25, {r(om.md(_O, 0.5), 3)} AS p50, {r(om.md(_O, 0.75), 3)} AS p75, {r(om.md(_O, 0.95), 3)} AS p95 FROM orders"""
S["orders_iqr"] = f"""SELECT '{_O}' AS "column", count(*) FILTER (WHERE {_O} > q3 + 1.5 * (q3 - q1)) AS high_outliers, round(max(p95), 4) AS p95, max({_O}) AS max, {r(div(f'count(*) FILTER (WHERE {_O} > q3 + 1.5 * (q3 - q1))', 'count(*)'), 4)} AS share_of_jobs
  FROM orders, (SELECT {om.md(_O, 0.25)} AS q1, {om.md(_O, 0.75)} AS q3, {om.md(_O, 0.95)} AS p95 FROM orders)"""
S["orders_crosstab"] = f"SELECT o_orderpriority, o_orderstatus, count(*) AS n, {r(div('count(*)', 'sum(count(*)) OVER (PARTITION BY o_orderpriority)'))} AS share FROM orders GROUP BY 1, 2"
S["customer_segments"] = f"""SELECT 'c_mktsegment' AS "column", c_mktsegment AS value, count(*) AS rows, {r(div('count(*)', 'sum(count(*)) OVER ()'))} AS share FROM customer GROUP BY 2"""
S["events_daily"] = """WITH d AS (SELECT ts::DATE AS day, count(*) AS n, sum(value::DECIMAL(14,2)) AS v FROM events GROUP BY 1)
SELECT strftime(d.day, '%Y-%m-%d') AS day, d.n AS events, round(d.v::DOUBLE, 6) AS value, b.n AS events_before, round(b.v::DOUBLE, 6) AS value_before FROM d LEFT JOIN d b ON b.day = d.day - 1"""
S["events_monthly"] = f"""WITH m AS (SELECT date_trunc('month', ts)::DATE AS ms, count(*) AS n, sum(value::DECIMAL(14,2)) AS v FROM events GROUP BY 1)
SELECT strftime(a.ms, '{MK}') AS month_start, a.n AS events, a.v::DOUBLE AS value, b.v::DOUBLE AS value_pm, {r(div('a.v - b.v', 'b.v'))} AS value_mom_pct FROM m a LEFT JOIN m b ON b.ms + INTERVAL 1 MONTH = a.ms"""
S["events_bands"] = "SELECT event_type, CASE WHEN value <= 1 THEN '<=1' WHEN value <= 5 THEN '1-5' WHEN value <= 10 THEN '5-10' WHEN value <= 50 THEN '10-50' ELSE '>50' END AS value_band, count(*) AS events FROM events GROUP BY 1, 2"
S["centre_ranking"] = f"""SELECT p.centre_rank, v.* FROM ({S['perf_index']}) p JOIN ({visual('center_name', 'completed_services total_revenue profit_margin_pct on_time_pct avg_turnaround_hours avg_rating cancellation_rate')}) v USING (center_name)"""
SQL = {k: query(v) for k, v in S.items()}
