"""Common table expressions of the bound model, and small SQL text helpers."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def _needs(sql: str) -> list[str]:
    words = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", sql))
    return [n for n in CTES if n in words]


def query(sql: str) -> str:
    """Prefix ``sql`` with the CTEs it uses, directly or through other CTEs."""
    wanted: set[str] = set()
    stack = _needs(sql)
    while stack:
        name = stack.pop()
        if name not in wanted:
            wanted.add(name)
            stack += [n for n in _needs(CTES[name]) if n != name]
    ordered = [n for n in CTES if n in wanted]
    if not ordered:
        return sql.strip()
    body = ",\n".join(f"{n} AS (\n{CTES[n]}\n)" for n in ordered)
    sql = sql.strip()
    if sql[:5].upper() == "WITH ":
        return f"WITH {body},\n{sql[5:]}"
    return f"WITH {body}\n{sql}"


def avg(x: str) -> str:
    """Exact-sum average as double."""
    return f"(sum({x})::DOUBLE / nullif(count({x}), 0))"


def share(x: str) -> str:
    return avg(f"({x})::INT")


def div(a: str, b: str) -> str:
    return f"(({a})::DOUBLE / nullif(({b})::DOUBLE, 0))"


def r(x: str, n: int = 6) -> str:
    return f"round({x}, {n})"


def mon(cents: str) -> str:
    return f"CAST(CAST({cents} AS DECIMAL(16,0)) * 0.01 AS DECIMAL(12,2))"


cte("service_centers", """
SELECT n_nationkey AS center_id, n_name AS center_name, n_name AS city,
  'State ' || (n_nationkey % 7) AS state, r_name AS region,
  4 + n_nationkey % 5 AS service_bays, 20 + n_nationkey % 11 AS daily_job_capacity,
  (DATE '1995-01-01' - 100 * (n_nationkey % 6)) AS opened_date
FROM nation JOIN region ON n_regionkey = r_regionkey""")

cte("customers", """
SELECT c_custkey AS customer_id, c_mktsegment AS customer_type, n_name AS city, r_name AS region,
  DATE '1995-01-01' - (c_custkey % 700)::INT AS registration_date
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")

cte("vehicles", """
SELECT v AS vehicle_id, c AS customer_id, 'Model ' || substr('ABC', (v % 3)::INT + 1, 1) AS model,
  CASE WHEN v % 4 < 2 THEN 'Std' ELSE 'Plus' END AS variant,
  CASE WHEN v % 3 = 2 THEN 'Family' ELSE 'Sport' END AS vehicle_category,
  CAST((29 + v % 4 * 4) * 0.1 AS DECIMAL(4,1)) AS battery_kwh,
  year(DATE '1994-12-31' - (v % 900)::INT)::INT AS model_year,
  DATE '1994-12-31' - (v % 900)::INT AS purchase_date,
  CASE WHEN v % 41 = 0 THEN NULL ELSE CAST((v * 37) % 20000 AS DECIMAL(10,1)) END AS mileage_km
FROM (SELECT c_custkey * 2 + i AS v, c_custkey AS c FROM customer CROSS JOIN (VALUES (0), (1)) t(i))""")

cte("technicians", """
SELECT s_suppkey AS technician_id, s_nationkey AS center_id,
  CASE WHEN s_acctbal < 2000 THEN 'Junior' WHEN s_acctbal < 4500 THEN 'Mid'
       WHEN s_acctbal < 7500 THEN 'Senior' ELSE 'Master' END AS skill_level,
  1 + s_suppkey % 20 AS years_experience,
  CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'Level ' || (s_suppkey % 3) END AS certification,
  CAST(200 + s_suppkey % 250 AS DECIMAL(10,2)) AS hourly_cost,
  8 + s_suppkey % 2 AS shift_hours_per_day
FROM supplier""")

cte("appointments", """
SELECT o_orderkey AS appointment_id, o_custkey * 2 + o_orderkey % 2 AS vehicle_id,
  (o_custkey % 25)::INT AS center_id,
  o_orderdate::DATE - CASE WHEN o_orderkey % 4 = 3 THEN 0 ELSE ((o_orderkey * 7) % 23)::INT END AS booking_date,
  o_orderdate::DATE AS scheduled_date,
  CASE WHEN o_orderkey % 71 = 0 THEN NULL
       ELSE lpad((9 + o_orderkey % 10)::VARCHAR, 2, '0') || CASE WHEN o_orderkey % 2 = 0 THEN ':00' ELSE ':30' END END AS scheduled_slot,
  CASE o_orderkey % 4 WHEN 0 THEN 'App' WHEN 1 THEN 'Phone' WHEN 2 THEN 'Web' ELSE 'Walk-in' END AS booking_channel,
  o_orderpriority AS requested_service_type,
  CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Cancelled' ELSE 'No-Show' END AS status,
  CASE WHEN o_orderstatus = 'O' AND o_orderkey % 7 <> 0 THEN
    CASE o_orderkey % 5 WHEN 0 THEN 'Price Concern' WHEN 1 THEN 'Personal Reasons' WHEN 2 THEN 'Long Wait for Slot'
         WHEN 3 THEN 'Found Alternative' ELSE 'Issue Resolved' END END AS cancellation_reason
FROM orders""")

cte("work_orders", """
SELECT k AS work_order_id, k AS appointment_id,
  CASE WHEN k % 97 = 0 THEN NULL ELSE (k * 31) % (SELECT count(*) FROM supplier) END AS technician_id,
  p AS service_type,
  d + to_minutes(540 + (k * 11) % 480) AS check_in_time,
  CASE WHEN k % 53 = 0 THEN NULL ELSE d + to_minutes(540 + (k * 11) % 480 + (k * 13) % 180) END AS start_time,
  d + to_minutes(540 + (k * 11) % 480 + (k * 13) % 180 + 30 + (k * 17) % 420 + wq * 15) AS end_time,
  d + to_minutes(540 + (k * 11) % 480 + 120 + (k * 19) % 480) AS promised_ready_time,
  CAST((2 + (k * 5) % 18) * 0.25 AS DECIMAL(6,2)) AS estimated_hours,
  CAST((1 + (k * 7) % 24) * 0.25 AS DECIMAL(6,2)) AS actual_hours,
  CAST(wq * 0.25 AS DECIMAL(6,2)) AS parts_wait_hours,
  CASE WHEN k % 61 = 0 THEN NULL ELSE ((k * 29) % 90000)::INT END AS odometer_km,
  (k * 3) % 10 < 3 AS additional_work_found,
  (k * 7) % 11 <> 0 AS qc_passed_first_time
FROM (SELECT o_orderkey AS k, o_orderpriority AS p, o_orderdate::DATE::TIMESTAMP AS d,
        CASE WHEN o_orderkey % 13 = 0 THEN 4 + (o_orderkey * 3) % 900 ELSE 0 END AS wq
      FROM orders WHERE o_orderstatus = 'F')""")

cte("parts", f"""
SELECT p_partkey AS part_id, p_name AS part_name, p_type AS part_category,
  {mon('round(p_retailprice * 100)')} AS unit_cost, 'All' AS compatible_models, p_size AS supplier_lead_days
FROM part""")

cte("part_usage", """
SELECT l_orderkey * 100000000 + l_partkey AS usage_id, l_orderkey AS work_order_id, l_partkey AS part_id,
  sum(l_quantity::INT)::INT AS quantity
FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey, l_partkey""")

cte("financials", f"""
SELECT k AS work_order_id,
  CASE WHEN k % 20 = 10 THEN 'Rework (No Charge)' WHEN k % 20 < 4 THEN 'Warranty'
       WHEN k % 20 < 8 THEN 'Service Plan' ELSE 'Customer Paid' END AS billing_type,
  {mon('((labor + pc) * (70 + (k * 13) % 70)) // 100')} AS estimated_cost,
  {mon('labor')} AS labor_cost, {mon('pc')} AS parts_cost,
  {mon('CASE WHEN k % 20 = 10 THEN 0 ELSE net END')} AS revenue
FROM (SELECT o_orderkey AS k, (1 + (o_orderkey * 7) % 24) * 25 * (450 + o_orderkey % 300) AS labor
      FROM orders WHERE o_orderstatus = 'F') j
JOIN (SELECT l_orderkey, sum(u)::BIGINT + CASE WHEN l_orderkey % 41 = 0 THEN 25000 ELSE 0 END AS pc, sum((g * (100 - f)) // 100)::BIGINT AS net
      FROM (SELECT l_orderkey, l_quantity::BIGINT * round(p_retailprice * 100)::BIGINT AS u, round(l_extendedprice * 100)::BIGINT AS g,
              round(l_discount * 100)::BIGINT AS f FROM lineitem JOIN part ON l_partkey = p_partkey)
      GROUP BY l_orderkey) b ON b.l_orderkey = j.k""")

cte("feedback", """
SELECT work_order_id * 3 + 1 AS feedback_id, work_order_id,
  (1 + (h * 7 + h // 3) % 5)::INT AS rating,
  CASE h % 6 WHEN 0 THEN 'Service Quality' WHEN 1 THEN 'Turnaround Time' WHEN 2 THEN 'Pricing'
       WHEN 3 THEN 'Parts Availability' WHEN 4 THEN 'Staff Behaviour' ELSE 'Communication' END AS feedback_category,
  end_time::DATE + (h % 10)::INT AS feedback_date
FROM (SELECT work_order_id, work_order_id // 2 AS h, end_time FROM work_orders WHERE work_order_id % 2 = 0)""")
