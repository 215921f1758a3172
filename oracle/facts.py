"""Analytical tables, views and reports in SQL."""

from oracle.base import avg, cte, div, query, r, share

DAYS = "(SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-08-31', INTERVAL 1 DAY))::DATE AS d)"
HOURS = "(epoch_us({b}) - epoch_us({a})) / 3600000000.0"


def hours(a: str, b: str) -> str:
    return f"CAST(round((epoch_us({b}) - epoch_us({a}))::DOUBLE / 3600000000.0::DOUBLE, 2) AS DECIMAL(18,2))"


def days(a: str, b: str) -> str:
    return f"floor((epoch_us({b}) - epoch_us({a}))::DOUBLE / 86400000000.0::DOUBLE)::INT"


cte("calendar_day", f"SELECT d FROM {DAYS}")
cte("period_months", """SELECT strftime(d, '%Y-%m') AS month, date_trunc('month', d)::DATE AS month_start,
  count(*) FILTER (WHERE isodow(d) <= 6) AS working_days FROM calendar_day GROUP BY ALL""")
cte("fact_service", f"""
SELECT *,
  coalesce(cost_variance_pct > 0.10, FALSE) AS cost_overrun_flag,
  coalesce(days_since_same_service <= 30, FALSE) AS is_repeat_visit,
  coalesce(days_until_next <= 30, FALSE) AS caused_repeat_visit
FROM (
  SELECT w.*, f.billing_type, f.estimated_cost, f.labor_cost, f.parts_cost, f.revenue,
    fb.rating, fb.feedback_category, a.vehicle_id, a.center_id, a.booking_channel, v.customer_id, v.model, v.variant,
    v.vehicle_category, v.model_year, v.purchase_date, c.customer_type, c.region AS customer_region,
    sc.center_name, sc.city, sc.region, t.skill_level, t.years_experience,
    check_in_time::DATE AS service_date, year(check_in_time) AS year, strftime(check_in_time, '%Y-%m') AS month,
    {hours('check_in_time', 'start_time')} AS wait_hours,
    {hours('check_in_time', 'end_time')} AS turnaround_hours,
    greatest({hours('promised_ready_time', 'end_time')}, 0) AS late_hours,
    end_time <= promised_ready_time AS on_time_flag,
    actual_hours - estimated_hours AS duration_variance_hours,
    parts_wait_hours > 0 AS parts_delay_flag,
    labor_cost + parts_cost AS total_cost,
    revenue - (labor_cost + parts_cost) AS profit,
    labor_cost + parts_cost - estimated_cost AS cost_variance,
    CAST(round({div('labor_cost + parts_cost - estimated_cost', 'estimated_cost')}, 4) AS DECIMAL(18,4)) AS cost_variance_pct,
    CAST(round((check_in_time::DATE - purchase_date)::DOUBLE / 365.25::DOUBLE, 2) AS DECIMAL(18,2)) AS vehicle_age_years,
    lag(end_time) OVER h AS previous_end, lead(check_in_time) OVER h AS next_check_in,
    {days('lag(end_time) OVER h', 'check_in_time')} AS days_since_same_service,
    {days('end_time', 'lead(check_in_time) OVER h')} AS days_until_next,
    row_number() OVER (PARTITION BY v.customer_id ORDER BY check_in_time, w.work_order_id)::INT AS customer_visit_number
  FROM work_orders w JOIN appointments a USING (appointment_id) JOIN vehicles v USING (vehicle_id)
  JOIN customers c USING (customer_id) JOIN service_centers sc ON sc.center_id = a.center_id
  LEFT JOIN technicians t ON t.technician_id = w.technician_id
  LEFT JOIN financials f ON f.work_order_id = w.work_order_id
  LEFT JOIN feedback fb ON fb.work_order_id = w.work_order_id
  WINDOW h AS (PARTITION BY a.vehicle_id, w.service_type ORDER BY check_in_time, w.work_order_id))""")
cte("fact_appointments", """
SELECT *, CASE WHEN lead_days BETWEEN 0 AND 0 THEN 'Same day' WHEN lead_days BETWEEN 1 AND 3 THEN '1-3 days'
  WHEN lead_days BETWEEN 4 AND 7 THEN '4-7 days' WHEN lead_days BETWEEN 8 AND 14 THEN '8-14 days'
  WHEN lead_days BETWEEN 15 AND 999 THEN '15+ days' ELSE 'nan' END AS lead_time_band,
  dayname(scheduled_date) AS weekday, strftime(scheduled_date, '%Y-%m') AS month,
  status = 'Cancelled' AS is_cancelled, status = 'No-Show' AS is_no_show, status = 'Completed' AS is_completed
FROM (SELECT a.*, v.customer_id, v.model, v.vehicle_category, c.customer_type, sc.center_name, sc.city, sc.region,
        (scheduled_date - booking_date)::INT AS lead_days
      FROM appointments a JOIN vehicles v USING (vehicle_id) JOIN customers c USING (customer_id)
      JOIN service_centers sc ON sc.center_id = a.center_id)""")
cte("fact_technician_month", f"""
SELECT t.technician_id, t.center_id, t.skill_level, m.month, m.working_days, coalesce(u.jobs, 0) AS jobs,
  coalesce(u.service_hours, 0)::DECIMAL(14,2) AS service_hours, u.qc_first_pass,
  coalesce(u.comebacks_caused, 0) AS comebacks_caused,
  (m.working_days * 7.0)::DECIMAL(10,1) AS available_hours,
  CAST(round({div('coalesce(u.service_hours, 0)', 'm.working_days * 7.0')}, 4) AS DECIMAL(18,4)) AS utilisation
FROM technicians t CROSS JOIN period_months m
LEFT JOIN (SELECT technician_id, month, count(*) AS jobs, sum(actual_hours) AS service_hours,
    {share('qc_passed_first_time')} AS qc_first_pass, count(*) FILTER (WHERE caused_repeat_visit) AS comebacks_caused
  FROM fact_service WHERE technician_id IS NOT NULL GROUP BY ALL) u
ON u.technician_id = t.technician_id AND u.month = m.month""")
cte("technician_month", """SELECT f.*, s.center_name, s.region FROM fact_technician_month f
  LEFT JOIN service_centers s USING (center_id)""")

FACTS: dict[str, str] = {}
FACTS["dim_date"] = f"""SELECT strftime(d, '%Y-%m-%d') AS date, year(d)::INT AS year, 'Q' || quarter(d) AS quarter,
  month(d)::INT AS month_number, strftime(d, '%b') AS month_name, strftime(d, '%Y-%m') AS year_month,
  isodow(d)::INT AS weekday_number, dayname(d) AS weekday_name, isodow(d) <= 6 AS is_working_day FROM calendar_day"""
FACTS["working_days"] = "SELECT count(*) FILTER (WHERE isodow(d) <= 6) AS working_days FROM calendar_day"
JOB_COLS = """work_order_id, technician_id, vehicle_id, customer_id, center_id, service_type, model, customer_type,
  center_name, region, skill_level, billing_type, booking_channel, strftime(service_date, '%Y-%m-%d') AS service_date,
  year::INT AS year, month, wait_hours::DOUBLE AS wait_hours, turnaround_hours::DOUBLE AS turnaround_hours,
  late_hours::DOUBLE AS late_hours, on_time_flag, duration_variance_hours::DOUBLE AS duration_variance_hours,
  parts_delay_flag, total_cost::DOUBLE AS total_cost, profit::DOUBLE AS profit, cost_variance::DOUBLE AS cost_variance,
  cost_variance_pct::DOUBLE AS cost_variance_pct, cost_overrun_flag, vehicle_age_years::DOUBLE AS vehicle_age_years,
  days_since_same_service, is_repeat_visit, caused_repeat_visit, customer_visit_number, rating"""
FACTS["fact_service"] = f"SELECT {JOB_COLS} FROM fact_service"
FACTS["comeback"] = """SELECT work_order_id, days_since_same_service, is_repeat_visit, caused_repeat_visit
  FROM fact_service"""
FACTS["visit_number"] = "SELECT customer_visit_number, count(*) AS jobs FROM fact_service GROUP BY 1"
FACTS["fact_appointments"] = """SELECT appointment_id, customer_id, model, customer_type, center_name, region,
  lead_days, lead_time_band, weekday, month, is_cancelled, is_no_show, is_completed FROM fact_appointments"""
FACTS["dense_grid"] = """SELECT technician_id, center_id, skill_level, month, working_days::INT AS working_days, jobs,
  service_hours::DOUBLE AS service_hours, round(qc_first_pass, 6) AS qc_first_pass, comebacks_caused,
  available_hours::DOUBLE AS available_hours, utilisation::DOUBLE AS utilisation FROM fact_technician_month"""

# ---- views ----------------------------------------------------------------------
TECH_VIEW = f"""
SELECT t.technician_id, t.center_id, sc.center_name, t.skill_level, t.years_experience, count(w.work_order_id) AS jobs,
  coalesce(sum(w.actual_hours), 0) AS service_hours, (SELECT sum(working_days) FROM period_months) AS working_days,
  (SELECT sum(working_days) FROM period_months) * 7.0 AS available_hours,
  {r(share('w.on_time_flag'), 4)} AS on_time_rate, {r(share('w.qc_passed_first_time'), 4)} AS qc_first_pass_rate,
  count(*) FILTER (WHERE w.caused_repeat_visit) AS comebacks_caused, {r(share('w.caused_repeat_visit'), 4)} AS comeback_rate,
  {r(avg('w.duration_variance_hours'), 3)} AS avg_duration_variance_hours, {r(avg('w.rating'), 3)} AS avg_rating
FROM technicians t JOIN service_centers sc USING (center_id) LEFT JOIN fact_service w ON w.technician_id = t.technician_id
GROUP BY ALL"""
cte("v_tech", TECH_VIEW)
cte("v_repeat", f"""SELECT customer_id, customer_type, customer_region, count(*) AS completed_visits,
  count(DISTINCT vehicle_id) AS vehicles_serviced, min(service_date) AS first_visit_date, max(service_date) AS last_visit_date,
  (max(service_date) - min(service_date))::INT AS tenure_days, sum(revenue) AS total_revenue, {r(avg('rating'), 3)} AS avg_rating,
  count(*) FILTER (WHERE is_repeat_visit) AS comeback_visits, count(*) >= 2 AS is_repeat_customer
FROM fact_service GROUP BY customer_id, customer_type, customer_region""")
cte("v_center", f"""
SELECT sc.center_id, sc.center_name, sc.city, sc.region, sc.service_bays, sc.daily_job_capacity, cap.technicians, j.work_orders,
  a.appointments, j.revenue::DOUBLE AS revenue, j.total_cost::DOUBLE AS total_cost, j.profit::DOUBLE AS profit,
  {r(div('j.profit', 'j.revenue'), 4)} AS profit_margin, {r(div('j.total_cost', 'j.work_orders'), 2)} AS avg_service_cost,
  avg_turnaround_hours, median_turnaround_hours, on_time_rate, avg_wait_hours, avg_duration_variance_hours, cost_overrun_rate,
  parts_delay_rate, qc_first_pass_rate, comeback_rate, avg_rating, csat_rate, cancellation_rate, no_show_rate, utilisation
FROM service_centers sc
LEFT JOIN (SELECT center_id, count(*) AS work_orders, sum(revenue) AS revenue, sum(total_cost) AS total_cost, sum(profit) AS profit,
    {r(avg('turnaround_hours'), 2)} AS avg_turnaround_hours, round(quantile_cont(turnaround_hours::DOUBLE, 0.5), 2) AS median_turnaround_hours,
    {r(share('on_time_flag'), 4)} AS on_time_rate, {r(avg('wait_hours'), 2)} AS avg_wait_hours,
    {r(avg('duration_variance_hours'), 3)} AS avg_duration_variance_hours, {r(share('cost_overrun_flag'), 4)} AS cost_overrun_rate,
    {r(share('parts_delay_flag'), 4)} AS parts_delay_rate, {r(share('qc_passed_first_time'), 4)} AS qc_first_pass_rate,
    {r(share('caused_repeat_visit'), 4)} AS comeback_rate, {r(avg('rating'), 3)} AS avg_rating, {r(share('rating >= 4'), 4)} AS csat_rate
  FROM fact_service GROUP BY center_id) j ON j.center_id = sc.center_id
LEFT JOIN (SELECT center_id, count(*) AS appointments, {r(share('is_cancelled'), 4)} AS cancellation_rate,
    {r(share('is_no_show'), 4)} AS no_show_rate FROM fact_appointments GROUP BY center_id) a ON a.center_id = sc.center_id
LEFT JOIN (SELECT center_id, count(*) AS technicians, {r(div('sum(service_hours)', 'sum(available_hours)'), 4)} AS utilisation
  FROM v_tech GROUP BY center_id) cap ON cap.center_id = sc.center_id""")
cte("v_type", f"""SELECT service_type, count(*) AS work_orders, sum(revenue) AS revenue, sum(total_cost) AS total_cost,
  sum(profit) AS profit, {r(div('sum(profit)', 'sum(revenue)'), 4)} AS profit_margin, {r(div('sum(total_cost)', 'count(*)'), 2)} AS avg_service_cost,
  {r(avg('turnaround_hours'), 2)} AS avg_turnaround_hours, {r(share('on_time_flag'), 4)} AS on_time_rate,
  {r(avg('duration_variance_hours'), 3)} AS avg_duration_variance_hours, {r(avg('cost_variance'), 2)} AS avg_cost_variance,
  {r(share('cost_overrun_flag'), 4)} AS cost_overrun_rate, {r(share('parts_delay_flag'), 4)} AS parts_delay_rate,
  {r(share('qc_passed_first_time'), 4)} AS qc_first_pass_rate, {r(share('caused_repeat_visit'), 4)} AS comeback_rate,
  {r(avg('rating'), 3)} AS avg_rating FROM fact_service GROUP BY service_type""")
cte("v_kpi", f"""
SELECT * FROM (SELECT count(*) AS work_orders, sum(revenue)::DOUBLE AS total_revenue, sum(total_cost)::DOUBLE AS total_cost,
  sum(profit)::DOUBLE AS profit, {r(div('sum(profit)', 'sum(revenue)'), 4)} AS profit_margin,
  {r(div('sum(total_cost)', 'count(*)'), 2)} AS avg_service_cost, {r(share('on_time_flag'), 4)} AS on_time_rate,
  {r(avg('turnaround_hours'), 3)} AS avg_turnaround_hours, round(quantile_cont(turnaround_hours::DOUBLE, 0.5), 3) AS median_turnaround_hours,
  {r(avg('wait_hours'), 3)} AS avg_wait_hours, sum(cost_variance)::DOUBLE AS total_cost_variance, {r(avg('cost_variance'), 2)} AS avg_cost_variance,
  {r(share('cost_overrun_flag'), 4)} AS cost_overrun_rate, {r(avg('duration_variance_hours'), 3)} AS avg_duration_variance_hours,
  {r(share('parts_delay_flag'), 4)} AS parts_delay_rate, {r(share('qc_passed_first_time'), 4)} AS qc_first_pass_rate,
  {r(share('caused_repeat_visit'), 4)} AS comeback_rate, {r(avg('rating'), 3)} AS avg_rating, {r(share('rating >= 4'), 4)} AS csat_rate,
  count(rating) AS rated_work_orders FROM fact_service)
CROSS JOIN (SELECT count(*) AS appointments, count(*) FILTER (WHERE is_cancelled) AS cancelled_appointments,
  count(*) FILTER (WHERE is_no_show) AS no_show_appointments, {r(share('is_cancelled'), 4)} AS cancellation_rate,
  {r(share('is_no_show'), 4)} AS no_show_rate FROM fact_appointments)
CROSS JOIN (SELECT count(*) AS customers_served, count(*) FILTER (WHERE is_repeat_customer) AS repeat_customers,
  {r(share('is_repeat_customer'), 4)} AS repeat_visit_rate FROM v_repeat)
CROSS JOIN (SELECT {r(div('sum(service_hours)', 'sum(available_hours)'), 4)} AS technician_utilisation FROM v_tech)""")

VIEWS: dict[str, str] = {}
VIEWS["vw_period_calendar"] = """SELECT '1995-01-01' AS period_start, '2001-08-31' AS period_end,
  sum(working_days)::INT AS working_days, 7.0::DOUBLE AS productive_hours_per_day FROM period_months"""
VIEWS["vw_work_order_enriched"] = """SELECT work_order_id, vehicle_id, customer_id, center_id, technician_id, service_type,
  variant, model_year::INT AS model_year, customer_region, years_experience::INT AS years_experience,
  strftime(date_trunc('month', check_in_time), '%Y-%m-%d') AS month_start, month AS year_month, year::INT AS service_year,
  month(check_in_time)::INT AS service_month, isodow(check_in_time)::INT AS iso_weekday, dayname(check_in_time) AS weekday_name,
  wait_hours::DOUBLE AS wait_hours, turnaround_hours::DOUBLE AS turnaround_hours, late_hours::DOUBLE AS late_hours, on_time_flag,
  profit::DOUBLE AS profit, cost_variance_pct::DOUBLE AS cost_variance_pct, cost_overrun_flag,
  strftime(previous_end, '%Y-%m-%d %H:%M:%S') AS prev_same_service_end, strftime(next_check_in, '%Y-%m-%d %H:%M:%S') AS next_same_service_check_in,
  days_since_same_service, is_repeat_visit AS is_comeback, caused_repeat_visit AS caused_comeback, customer_visit_number FROM fact_service"""
VIEWS["vw_appointment_enriched"] = """SELECT appointment_id, customer_id, center_name, city, lead_days,
  CASE WHEN lead_days = 0 THEN 'Same day' WHEN lead_days <= 3 THEN '1-3 days' WHEN lead_days <= 7 THEN '4-7 days'
    WHEN lead_days <= 14 THEN '8-14 days' ELSE '15+ days' END AS lead_time_band, month AS year_month,
  strftime(date_trunc('month', scheduled_date), '%Y-%m-%d') AS month_start, isodow(scheduled_date)::INT AS iso_weekday,
  weekday AS weekday_name, is_cancelled, is_no_show, is_completed FROM fact_appointments"""
VIEWS["vw_monthly_financials"] = f"""WITH m AS (SELECT date_trunc('month', check_in_time)::DATE AS month_start, month AS year_month,
  year AS service_year, month(check_in_time) AS service_month, count(*) AS work_orders, sum(revenue) AS revenue, sum(total_cost) AS total_cost,
  sum(profit) AS profit, {share('on_time_flag')} AS on_time_rate, {avg('turnaround_hours')} AS avg_turnaround_hours, {avg('rating')} AS avg_rating
  FROM fact_service GROUP BY 1, 2, 3, 4)
SELECT strftime(month_start, '%Y-%m-%d') AS month_start, year_month, service_year::INT AS service_year, service_month::INT AS service_month, work_orders,
  revenue::DOUBLE AS revenue, total_cost::DOUBLE AS total_cost, profit::DOUBLE AS profit, round(on_time_rate, 6) AS on_time_rate,
  round(avg_turnaround_hours, 6) AS avg_turnaround_hours, round(avg_rating, 6) AS avg_rating,
  {r(div('profit', 'revenue'), 4)} AS profit_margin, {r(div('total_cost', 'work_orders'), 2)} AS avg_service_cost,
  {r(div('revenue', 'lag(revenue) OVER (ORDER BY month_start)') + ' - 1', 4)} AS revenue_mom_growth,
  {r(div('profit', 'lag(profit) OVER (ORDER BY month_start)') + ' - 1', 4)} AS profit_mom_growth FROM m"""
VIEWS["vw_technician_utilisation"] = f"""SELECT technician_id, center_id, center_name, skill_level, years_experience::INT AS years_experience, jobs,
  service_hours::DOUBLE AS service_hours, working_days::INT AS working_days, available_hours::DOUBLE AS available_hours,
  {r(div('service_hours', 'available_hours'), 4)} AS utilisation, on_time_rate, qc_first_pass_rate, comebacks_caused, comeback_rate,
  avg_duration_variance_hours, avg_rating FROM v_tech"""
VIEWS["vw_center_performance"] = """SELECT * REPLACE (service_bays::INT AS service_bays, daily_job_capacity::INT AS daily_job_capacity) FROM v_center"""
VIEWS["vw_service_type_performance"] = """SELECT * REPLACE (revenue::DOUBLE AS revenue, total_cost::DOUBLE AS total_cost, profit::DOUBLE AS profit) FROM v_type"""
VIEWS["vw_appointment_funnel"] = f"""SELECT strftime(date_trunc('month', scheduled_date), '%Y-%m-%d') AS month_start, month AS year_month,
  center_id, center_name, count(*) AS appointments, count(*) FILTER (WHERE is_completed) AS completed,
  count(*) FILTER (WHERE is_cancelled) AS cancelled, count(*) FILTER (WHERE is_no_show) AS no_shows, {r(share('is_completed'), 4)} AS completion_rate,
  {r(share('is_cancelled'), 4)} AS cancellation_rate, {r(share('is_no_show'), 4)} AS no_show_rate, {r(avg('lead_days'), 2)} AS avg_lead_days
  FROM fact_appointments GROUP BY 1, 2, 3, 4"""
VIEWS["vw_customer_repeat"] = """SELECT * REPLACE (strftime(first_visit_date, '%Y-%m-%d') AS first_visit_date,
  strftime(last_visit_date, '%Y-%m-%d') AS last_visit_date, total_revenue::DOUBLE AS total_revenue) FROM v_repeat"""
VIEWS["vw_kpi_summary"] = "SELECT * FROM v_kpi"

# ---- reports --------------------------------------------------------------------
Q: dict[str, str] = {}
_KPI_LINES = [
    (1, "Total revenue", "total_revenue", "INR"), (2, "Total cost (labour + parts)", "total_cost", "INR"),
    (3, "Profit", "profit", "INR"), (3, "Profit margin", "profit_margin * 100", "%"),
    (4, "Average service cost", "avg_service_cost", "INR / job"), (5, "On-time completion", "on_time_rate * 100", "%"),
    (6, "Average turnaround", "avg_turnaround_hours", "hours"), (6, "Median turnaround", "median_turnaround_hours", "hours"),
    (7, "Total cost variance (actual - est.)", "total_cost_variance", "INR"), (7, "Average cost variance", "avg_cost_variance", "INR / job"),
    (7, "Cost overrun rate (> 10% over est.)", "cost_overrun_rate * 100", "%"), (8, "Cancellation rate", "cancellation_rate * 100", "%"),
    (8, "No-show rate", "no_show_rate * 100", "%"), (9, "Technician utilisation", "technician_utilisation * 100", "%"),
    (10, "Average customer rating", "avg_rating", "1-5"), (10, "CSAT (rating >= 4)", "csat_rate * 100", "%"),
    (11, "Repeat visit rate (customers)", "repeat_visit_rate * 100", "%"), (12, "Comeback (rework) rate", "comeback_rate * 100", "%"),
    (13, "Duration variance (actual - est.)", "avg_duration_variance_hours", "hours / job"), (14, "Parts delay rate", "parts_delay_rate * 100", "%"),
    (15, "First-time QC pass rate", "qc_first_pass_rate * 100", "%"), (16, "Average wait before work starts", "avg_wait_hours", "hours"),
]
Q["q01"] = "\nUNION ALL ".join(
    f"SELECT {n} AS kpi_no, '{k}' AS kpi, ({c})::DOUBLE AS value, '{u}' AS unit FROM v_kpi" for n, k, c, u in _KPI_LINES
)
Q["q02"] = f"""WITH m AS (SELECT date_trunc('month', check_in_time)::DATE AS ms, count(*) AS work_orders, sum(revenue) AS revenue,
    sum(total_cost) AS total_cost, sum(profit) AS profit FROM fact_service GROUP BY 1)
SELECT strftime(ms, '%Y-%m') AS year_month, work_orders, revenue::DOUBLE AS revenue, total_cost::DOUBLE AS total_cost, profit::DOUBLE AS profit,
  {r(div('profit', 'revenue') + ' * 100', 2)} AS profit_margin_pct,
  {r('(' + div('revenue', 'lag(revenue) OVER (ORDER BY ms)') + ' - 1) * 100', 2)} AS revenue_mom_growth_pct,
  {r('(' + div('total_cost', 'lag(total_cost) OVER (ORDER BY ms)') + ' - 1) * 100', 2)} AS cost_mom_growth_pct,
  {r('(' + div('profit', 'lag(profit) OVER (ORDER BY ms)') + ' - 1) * 100', 2)} AS profit_mom_growth_pct,
  (sum(revenue) OVER (ORDER BY ms))::DOUBLE AS cumulative_revenue FROM m"""
Q["q03"] = f"""WITH g AS (SELECT sc.center_name, epoch_us(end_time) - epoch_us(check_in_time) AS gap, end_time::DATE = check_in_time::DATE AS same
    FROM work_orders JOIN appointments a USING (appointment_id) JOIN service_centers sc ON sc.center_id = a.center_id),
  s AS (SELECT center_name, count(*) AS n, {avg('gap')} AS av, quantile_cont(gap::DOUBLE, 0.5) AS p50, quantile_cont(gap::DOUBLE, 0.9) AS p90,
    {share('same')} AS same FROM g GROUP BY 1)
SELECT center_name, n AS work_orders, round(av / 3600000000.0::DOUBLE, 2) AS avg_turnaround_hours, round(p50 / 3600000000.0::DOUBLE, 2) AS median_turnaround_hours,
  round(p90 / 3600000000.0::DOUBLE, 2) AS p90_turnaround_hours, round(same * 100, 1) AS same_day_return_pct, rank() OVER (ORDER BY av)::INT AS speed_rank FROM s"""
Q["q04"] = f"""SELECT coalesce(center_name, 'ALL CENTRES') AS center_name, count(*) AS work_orders, count(*) FILTER (WHERE on_time_flag) AS on_time_jobs,
  {r(share('on_time_flag') + ' * 100', 2)} AS on_time_pct, {r(avg('CASE WHEN NOT on_time_flag THEN late_hours END'), 2)} AS avg_hours_late_when_late,
  {r(share('CASE WHEN NOT on_time_flag THEN parts_delay_flag END') + ' * 100', 2)} AS pct_of_late_jobs_with_parts_delay
  FROM fact_service GROUP BY ROLLUP (center_name)"""
Q["q05"] = f"""WITH w AS (SELECT sc.center_name, t.technician_id, t.skill_level, count(wo.work_order_id) AS jobs, coalesce(sum(wo.actual_hours), 0) AS h
    FROM technicians t JOIN service_centers sc USING (center_id) LEFT JOIN work_orders wo ON wo.technician_id = t.technician_id GROUP BY 1, 2, 3)
SELECT center_name, technician_id, skill_level, jobs, round(h, 1)::DOUBLE AS service_hours,
  {r(div('h', '(SELECT sum(working_days) FROM period_months) * 7.0') + ' * 100', 1)} AS utilisation_pct,
  rank() OVER (PARTITION BY center_name ORDER BY h DESC) AS hours_rank_in_centre,
  dense_rank() OVER (PARTITION BY center_name ORDER BY jobs DESC) AS jobs_dense_rank_in_centre,
  {r(div('h', 'sum(h) OVER (PARTITION BY center_name)') + ' * 100', 1)} AS pct_of_centre_hours FROM w"""
Q["q06"] = f"""SELECT service_type, work_orders, revenue::DOUBLE AS revenue, profit::DOUBLE AS profit, round(profit_margin * 100, 2) AS profit_margin_pct, avg_service_cost,
  rank() OVER (ORDER BY revenue DESC)::INT AS revenue_rank, rank() OVER (ORDER BY profit DESC)::INT AS profit_rank,
  {r(div('revenue', 'sum(revenue) OVER ()') + ' * 100', 2)} AS revenue_share_pct,
  {r(div('sum(revenue) OVER (ORDER BY revenue DESC)', 'sum(revenue) OVER ()') + ' * 100', 2)} AS cumulative_revenue_share_pct FROM v_type"""
Q["q07"] = f"""WITH s AS (SELECT sc.center_name, count(*) AS n, count(*) FILTER (WHERE a.status = 'Completed') AS completed, count(*) FILTER (WHERE a.status = 'Cancelled') AS cancelled,
    count(*) FILTER (WHERE a.status = 'No-Show') AS no_shows, count(*) FILTER (WHERE a.status = 'Completed' AND wo.work_order_id IS NULL) AS lost
  FROM appointments a JOIN service_centers sc ON sc.center_id = a.center_id LEFT JOIN work_orders wo ON wo.appointment_id = a.appointment_id GROUP BY 1)
SELECT center_name, n AS appointments, completed, cancelled, no_shows, {r(div('cancelled', 'n') + ' * 100', 2)} AS cancellation_rate_pct,
  {r(div('no_shows', 'n') + ' * 100', 2)} AS no_show_rate_pct, lost AS completed_without_work_order,
  rank() OVER (ORDER BY {div('cancelled', 'n')} DESC)::INT AS cancellation_rank FROM s"""
Q["q08"] = f"""WITH b AS (SELECT CASE WHEN scheduled_date - booking_date = 0 THEN '1. Same day' WHEN scheduled_date - booking_date <= 3 THEN '2. 1-3 days'
    WHEN scheduled_date - booking_date <= 7 THEN '3. 4-7 days' WHEN scheduled_date - booking_date <= 14 THEN '4. 8-14 days' ELSE '5. 15+ days' END AS lead_time_band, status FROM appointments)
SELECT lead_time_band, count(*) AS appointments, count(*) FILTER (WHERE status = 'Cancelled') AS cancelled,
  {r(share("status = 'Cancelled'") + ' * 100', 2)} AS cancellation_rate_pct, {r(share("status = 'No-Show'") + ' * 100', 2)} AS no_show_rate_pct,
  {r(div('count(*)', 'sum(count(*)) OVER ()') + ' * 100', 2)} AS share_of_bookings_pct FROM b GROUP BY 1"""
Q["q09"] = f"""WITH s AS (SELECT service_type, count(*) AS n, count(rating) AS rated, {avg('rating')} AS av, {share('rating >= 4')} AS csat, {share('rating <= 2')} AS low
  FROM work_orders LEFT JOIN feedback USING (work_order_id) GROUP BY 1 HAVING count(rating) > 0)
SELECT service_type, n AS work_orders, rated AS rated_jobs, {r(div('rated', 'n') + ' * 100', 1)} AS rating_coverage_pct, round(av, 3) AS avg_rating, round(csat * 100, 1) AS csat_pct,
  round(low * 100, 1) AS low_rating_pct, rank() OVER (ORDER BY av DESC)::INT AS rating_rank FROM s"""
Q["q10"] = f"""WITH s AS (SELECT part_category, count(DISTINCT pu.work_order_id) AS w, sum(quantity)::BIGINT AS u, sum(quantity * unit_cost) AS spend
  FROM part_usage pu JOIN parts p USING (part_id) JOIN work_orders wo ON wo.work_order_id = pu.work_order_id GROUP BY 1)
SELECT part_category, w AS work_orders_using, u AS units_used, spend::DOUBLE AS parts_spend, {r(div('spend', 'w'), 2)} AS spend_per_work_order,
  {r(div('spend', 'sum(spend) OVER ()') + ' * 100', 2)} AS share_of_spend_pct,
  {r(div('sum(spend) OVER (ORDER BY spend DESC)', 'sum(spend) OVER ()') + ' * 100', 2)} AS cumulative_share_pct, rank() OVER (ORDER BY spend DESC)::INT AS spend_rank FROM s"""
Q["q11"] = f"""WITH s AS (SELECT service_type, count(*) AS n, {avg('estimated_hours')} AS e, {avg('actual_hours')} AS a, {avg('duration_variance_hours')} AS v,
    {avg('CAST(round(' + div('duration_variance_hours', 'estimated_hours') + ', 6) AS DECIMAL(18,6))')} AS rel,
    count(*) FILTER (WHERE duration_variance_hours::DOUBLE > 0.25 * estimated_hours::DOUBLE) AS o FROM fact_service GROUP BY 1)
SELECT service_type, n AS work_orders, round(e, 2) AS avg_estimated_hours, round(a, 2) AS avg_actual_hours, round(v, 3) AS avg_variance_hours,
  round(rel * 100, 1) AS avg_variance_pct_of_estimate, {r(div('o', 'n') + ' * 100', 1)} AS jobs_over_estimate_by_25pct_pct,
  CASE WHEN v >= 0.5 THEN 'Under-estimated' WHEN v >= 0.2 THEN 'Slightly under-estimated' WHEN v > -0.2 THEN 'Accurate' ELSE 'Over-estimated' END AS estimate_quality FROM s"""
Q["q12"] = f"""SELECT coalesce(customer_type, 'ALL CUSTOMERS') AS customer_type, count(*) AS customers_served, count(*) FILTER (WHERE is_repeat_customer) AS repeat_customers,
  {r(share('is_repeat_customer') + ' * 100', 2)} AS repeat_visit_rate_pct, {r(avg('completed_visits'), 2)} AS avg_visits_per_customer,
  {r(avg('total_revenue'), 2)} AS avg_revenue_per_customer, {r(div('sum(comeback_visits)', 'sum(completed_visits)') + ' * 100', 2)} AS comeback_visits_pct_of_visits
  FROM v_repeat GROUP BY ROLLUP (customer_type)"""
_Q13 = [("Appointments", "n_a"), ("Completed work orders", "n_w"), ("Revenue (INR)", "rev"), ("Profit (INR)", "pro"), ("Profit margin (%)", "mar"),
        ("Revenue per job (INR)", "rpj"), ("On-time (%)", "ot"), ("Avg turnaround (hours)", "tat"), ("Avg rating (1-5)", "rat"),
        ("Parts delay rate (%)", "pd"), ("Cancellation rate (%)", "can")]
Q["q13"] = f"""WITH w AS (SELECT year, count(*)::DOUBLE AS n_w, sum(revenue)::DOUBLE AS rev, sum(profit)::DOUBLE AS pro, {div('sum(profit)', 'sum(revenue)')} * 100 AS mar,
    {avg('revenue')} AS rpj, {share('on_time_flag')} * 100 AS ot, {avg('turnaround_hours')} AS tat, {avg('rating')} AS rat, {share('parts_delay_flag')} * 100 AS pd
    FROM fact_service WHERE month(check_in_time) <= 9 GROUP BY 1),
  a AS (SELECT year(scheduled_date) AS year, count(*)::DOUBLE AS n_a, {share("status = 'Cancelled'")} * 100 AS can FROM appointments WHERE month(scheduled_date) <= 9 GROUP BY 1),
  b AS (SELECT * FROM w JOIN a USING (year)),
  l AS ({' UNION ALL '.join(f"SELECT '{m}' AS metric, max({c}) FILTER (WHERE year = 1999) AS x, max({c}) FILTER (WHERE year = 2000) AS y FROM b" for m, c in _Q13)})
SELECT metric, round(x, 2) AS jan_sep_1999, round(y, 2) AS jan_sep_2000, round(y - x, 2) AS abs_change, {r('(' + div('y', 'x') + ' - 1) * 100', 2)} AS pct_change FROM l"""
Q["q14"] = """WITH p AS (SELECT *, percent_rank() OVER (ORDER BY on_time_rate NULLS LAST) + percent_rank() OVER (ORDER BY avg_rating NULLS LAST)
    + percent_rank() OVER (ORDER BY profit_margin NULLS LAST) + percent_rank() OVER (ORDER BY comeback_rate DESC NULLS FIRST)
    + percent_rank() OVER (ORDER BY avg_turnaround_hours DESC NULLS FIRST) AS s FROM v_center),
  k AS (SELECT *, s / 5.0::DOUBLE AS score, round(s / 5.0::DOUBLE, 12) AS sk FROM p)
SELECT rank() OVER (ORDER BY sk DESC)::INT AS overall_rank, center_name, round(score, 3) AS composite_score, (ntile(4) OVER (ORDER BY sk DESC, center_name))::INT AS quartile,
  CASE WHEN sk >= 0.70 THEN 'Leader' WHEN sk >= 0.45 THEN 'Solid' WHEN sk >= 0.25 THEN 'Watch' ELSE 'Needs attention' END AS performance_category,
  round(on_time_rate * 100, 2) AS on_time_pct, avg_rating, round(profit_margin * 100, 2) AS profit_margin_pct, round(comeback_rate * 100, 2) AS comeback_rate_pct,
  avg_turnaround_hours, round(utilisation * 100, 1) AS utilisation_pct FROM k"""
Q["q15"] = f"""WITH b AS (SELECT CASE WHEN parts_wait_hours = 0 THEN '1. No parts wait' WHEN parts_wait_hours <= 72 THEN '2. Up to 3 days'
    WHEN parts_wait_hours <= 168 THEN '3. 3 to 7 days' ELSE '4. Over 7 days' END AS band, * FROM fact_service),
  s AS (SELECT band, count(*) AS n, {share('on_time_flag')} * 100 AS ot, {avg('turnaround_hours')} AS tat, {avg('rating')} AS rt, count(rating) AS rn, {avg('cost_variance')} AS cv FROM b GROUP BY 1)
SELECT band AS parts_wait_band, n AS work_orders, round(ot, 2) AS on_time_pct, round(ot - first_value(ot) OVER (ORDER BY band), 2) AS on_time_pts_vs_no_wait,
  round(tat, 2) AS avg_turnaround_hours, round(rt, 3) AS avg_rating, round(rt - first_value(rt) OVER (ORDER BY band), 3) AS rating_vs_no_wait, rn AS rated_jobs, round(cv, 2) AS avg_cost_variance FROM s"""
Q["q16"] = f"""SELECT skill_level, count(DISTINCT technician_id) AS technicians, count(*) AS jobs, {r(share('caused_repeat_visit') + ' * 100', 2)} AS comeback_rate_pct,
  {r(share('qc_passed_first_time') + ' * 100', 2)} AS qc_first_pass_pct, {r(avg('duration_variance_hours'), 3)} AS avg_duration_variance_hours, {r(share('on_time_flag') + ' * 100', 2)} AS on_time_pct,
  {r(avg('rating'), 3)} AS avg_rating, {r(avg('profit'), 2)} AS avg_profit_per_job FROM fact_service WHERE skill_level IS NOT NULL GROUP BY 1"""
Q["q17"] = f"""WITH d AS (SELECT isodow(check_in_time) AS wd, service_date, count(*) AS jobs, {avg('wait_hours')} AS w FROM fact_service GROUP BY 1, 2),
  k AS (SELECT wd, count(*) AS od, sum(jobs)::BIGINT AS n, {avg('jobs')} AS l, {avg('CAST(round(w, 9) AS DECIMAL(20,9))')} AS w FROM d GROUP BY 1)
SELECT dayname(DATE '2024-12-29' + wd::INT) AS weekday, od AS open_days, n AS work_orders, round(l, 1) AS avg_jobs_per_day, round(w, 2) AS avg_wait_hours,
  rank() OVER (ORDER BY l DESC)::INT AS load_rank, rank() OVER (ORDER BY w DESC)::INT AS wait_rank, round(corr(l, w) OVER (), 3) AS corr_load_vs_wait_across_weekdays FROM k"""
Q["q18"] = f"""WITH s AS (SELECT grouping(service_type) AS g, service_type, billing_type, count(*) AS n, sum(cost_variance) AS cv, {avg('cost_variance')} AS av, {share('cost_overrun_flag')} AS o,
    sum(estimated_cost) AS e FROM fact_service GROUP BY GROUPING SETS ((service_type), (billing_type)))
SELECT CASE WHEN g = 0 THEN 'Service type' ELSE 'Billing type' END AS cut, coalesce(service_type, billing_type) AS segment, n AS work_orders, cv::DOUBLE AS total_cost_variance,
  round(av, 2) AS avg_cost_variance, round(o * 100, 2) AS overrun_rate_pct, {r(div('cv', 'e') + ' * 100', 2)} AS variance_pct_of_estimate,
  rank() OVER (PARTITION BY g ORDER BY cv DESC NULLS FIRST)::INT AS rank_in_cut FROM s"""
Q["q19"] = f"""WITH va AS (SELECT v.vehicle_id, v.model, count(w.work_order_id) AS n, coalesce(sum(w.revenue), 0) AS rev, coalesce(sum(w.profit), 0) AS pro
    FROM vehicles v LEFT JOIN fact_service w ON w.vehicle_id = v.vehicle_id GROUP BY 1, 2),
  b AS (SELECT model, count(*) AS base, count(*) FILTER (WHERE n = 0) AS never, sum(n)::BIGINT AS visits, sum(rev) AS rev, sum(pro) AS pro FROM va GROUP BY 1),
  q AS (SELECT model, {avg('rating')} AS rt, {share('caused_repeat_visit')} AS cb, {share('(service_date - purchase_date) / 365.25 >= 2')} AS old FROM fact_service GROUP BY 1)
SELECT b.model, base AS vehicles_in_base, never AS never_serviced, {r(div('never', 'base') + ' * 100', 1)} AS never_serviced_pct, visits, {r(div('visits', 'base'), 2)} AS visits_per_vehicle,
  {r(div('rev', 'base'), 2)} AS revenue_per_vehicle, {r(div('pro', 'rev') + ' * 100', 2)} AS profit_margin_pct, round(rt, 3) AS avg_rating, round(cb * 100, 2) AS comeback_rate_pct,
  round(old * 100, 1) AS jobs_on_2plus_year_old_vehicles_pct FROM b JOIN q USING (model)"""
Q["q20"] = f"""WITH h AS (SELECT t.center_id, date_trunc('month', check_in_time)::DATE AS ms, sum(actual_hours) AS h FROM work_orders JOIN technicians t USING (technician_id) GROUP BY 1, 2),
  g AS (SELECT sc.center_name, m.month_start AS ms, coalesce(h.h, 0) AS sh, ct.n * m.working_days * 7.0 AS ah FROM service_centers sc
    JOIN (SELECT center_id, count(*) AS n FROM technicians GROUP BY 1) ct USING (center_id) CROSS JOIN period_months m
    LEFT JOIN h ON h.center_id = sc.center_id AND h.ms = m.month_start),
  u AS (SELECT *, {div('sh', 'ah')} AS u FROM g)
SELECT center_name, strftime(ms, '%Y-%m') AS year_month, round(sh, 1)::DOUBLE AS service_hours, ah::DOUBLE AS available_hours, round(u * 100, 1) AS utilisation_pct,
  round(avg(u) OVER (PARTITION BY center_name ORDER BY ms ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) * 100, 1) AS utilisation_3m_avg_pct FROM u"""
Q["q21"] = f"""WITH n AS (SELECT *, ntile(10) OVER (ORDER BY coalesce(total_revenue, 0) DESC, customer_id) AS t FROM v_repeat),
  d AS (SELECT t, count(*) AS c, sum(coalesce(total_revenue, 0)) AS rev, {avg('completed_visits')} AS av FROM n GROUP BY 1)
SELECT t::INT AS revenue_decile, c AS customers, rev::DOUBLE AS revenue, round(av, 2) AS avg_visits, {r(div('rev', 'sum(rev) OVER ()') + ' * 100', 2)} AS revenue_share_pct,
  {r(div('sum(rev) OVER (ORDER BY t)', 'sum(rev) OVER ()') + ' * 100', 2)} AS cumulative_share_pct FROM d"""

Q["preview"] = f"SELECT * FROM ({Q['q05']}) ORDER BY technician_id LIMIT 5"
SQL = {k: query(v) for k, v in {**FACTS, **VIEWS, **Q}.items()}
