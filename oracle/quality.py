"""Raw twins with defects, quality checks and cleaning in SQL."""

from oracle.base import cte, query

S = 4  # defect scale


def draw(k: str, tag: int) -> str:
    return f"((({k} * 48271 + {tag * 7919}) % 2147483647) % 10000)"


def hit(k: str, tag: int, lo: int, hi: int) -> str:
    return f"({draw(k, tag)} >= {lo * S} AND {draw(k, tag)} < {hi * S})"


def pick(k: str, *values: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {k} % {len(values)} {whens} END"


def other(v: str, o: str) -> str:
    return f"CASE WHEN {v} <> {o} THEN {v} ELSE {o} || ' ' END"


def twice(name: str, body: str, dup: str | None) -> None:
    """Raw twin = changed rows plus full copies of the drawn ones."""
    if dup is None:
        cte(name, body)
        return
    cte(f"{name}_once", body)
    cte(name, f"SELECT * FROM {name}_once UNION ALL SELECT * FROM {name}_once WHERE {dup}")


MK = "%Y-%m-%d"
TS = "%Y-%m-%d %H:%M:%S"
twice("raw_customers", f"""SELECT customer_id, customer_type, city,
  CASE WHEN {hit('customer_id', 1, 0, 100)} THEN {pick('customer_id', other('upper(region)', 'region'), 'lower(region)', "' ' || region || ' '")} ELSE region END AS region,
  strftime(registration_date, '{MK}') AS registration_date FROM customers""", hit("customer_id", 2, 0, 40))
twice("raw_vehicles", f"""SELECT vehicle_id, customer_id,
  CASE WHEN {hit('vehicle_id', 4, 0, 50)} THEN {pick('vehicle_id', 'lower(model)', "upper(model) || ' '", "' ' || lower(model)")} ELSE model END AS model,
  variant, vehicle_category, battery_kwh,
  CASE WHEN {hit('vehicle_id', 3, 0, 40)} THEN (CASE model WHEN 'Model A' THEN 1990 ELSE 1992 END - 1 - vehicle_id % 3)::INT ELSE model_year END AS model_year,
  strftime(purchase_date, '{MK}') AS purchase_date,
  CASE WHEN {hit('vehicle_id', 3, 40, 70)} THEN ({pick('vehicle_id', '-(100 + vehicle_id % 4900)', '2500000 + vehicle_id % 500000')})::DECIMAL(10,1) ELSE mileage_km END AS mileage_km
FROM vehicles""", None)
twice("raw_appointments", f"""SELECT appointment_id,
  CASE WHEN {hit('appointment_id', 8, 0, 10)} AND NOT gone THEN vehicle_id + 1000000000000 ELSE vehicle_id END AS vehicle_id,
  CASE WHEN gone THEN NULL ELSE center_id END AS center_id, strftime(booking_date, '{MK}') AS booking_date,
  CASE WHEN {hit('appointment_id', 6, 0, 80)} THEN strftime(scheduled_date, '%d/%m/%Y') ELSE strftime(scheduled_date, '{MK}') END AS scheduled_date,
  scheduled_slot, booking_channel, requested_service_type,
  CASE WHEN {hit('appointment_id', 5, 0, 40)} THEN {pick('appointment_id', 'lower(status)', 'upper(status)',
    "CASE status WHEN 'Cancelled' THEN 'Canceled' WHEN 'No-Show' THEN 'No Show' ELSE ' ' || status END")} ELSE status END AS status, cancellation_reason
FROM (SELECT *, status = 'Completed' AND {hit('appointment_id', 7, 0, 15)} AS gone FROM appointments)""", hit("appointment_id", 9, 0, 60))
_W = "work_order_id"
twice("raw_work_orders", f"""SELECT work_order_id, appointment_id,
  CASE WHEN ok AND {hit(_W, 11, 0, 20)} THEN NULL WHEN ok AND {hit(_W, 11, 20, 30)} THEN technician_id + 1000000000000 ELSE technician_id END AS technician_id,
  CASE WHEN {hit(_W, 12, 0, 50)} THEN {pick(_W, 'lower(service_type)', "' ' || service_type", other("replace(service_type, ' ', '  ')", 'service_type'), "service_type || ' '")} ELSE service_type END AS service_type,
  strftime(check_in_time, '{TS}') AS check_in_time,
  strftime(CASE WHEN swapped THEN end_time WHEN ok AND {hit(_W, 11, 30, 40)} THEN NULL ELSE start_time END, '{TS}') AS start_time,
  strftime(CASE WHEN swapped THEN start_time ELSE end_time END, '{TS}') AS end_time, strftime(promised_ready_time, '{TS}') AS promised_ready_time,
  estimated_hours, actual_hours, parts_wait_hours, odometer_km, additional_work_found, qc_passed_first_time
FROM (SELECT *, NOT swapped AND technician_id IS NOT NULL AND start_time IS NOT NULL AS ok FROM
  (SELECT *, start_time IS NOT NULL AND {hit(_W, 10, 0, 25)} AS swapped FROM work_orders))""", hit(_W, 13, 0, 40))
twice("raw_financials", f"""SELECT work_order_id, billing_type, estimated_cost,
  CASE WHEN ok AND {hit(_W, 14, 0, 20)} AND {_W} % 2 = 1 THEN -labor_cost ELSE labor_cost END AS labor_cost,
  CASE WHEN ok AND {hit(_W, 14, 20, 35)} THEN NULL ELSE parts_cost END AS parts_cost,
  CASE WHEN ok AND {hit(_W, 14, 0, 20)} AND {_W} % 2 = 0 THEN -revenue WHEN ok AND {hit(_W, 14, 35, 45)} THEN (revenue * 100)::DECIMAL(12,2) ELSE revenue END AS revenue
FROM (SELECT *, revenue > 0 AS ok FROM financials)""", hit(_W, 15, 0, 30))
cte("raw_feedback_once", f"""SELECT feedback_id, work_order_id,
  CASE WHEN {hit('feedback_id', 16, 0, 40)} THEN {pick('feedback_id', '0', '6', '10')} WHEN {hit('feedback_id', 16, 40, 60)} THEN NULL ELSE rating END AS rating,
  feedback_category, strftime(feedback_date, '{MK}') AS feedback_date FROM feedback""")
cte("raw_feedback", f"SELECT * FROM raw_feedback_once UNION ALL SELECT * FROM raw_feedback_once WHERE {hit('feedback_id', 17, 0, 30)}")
cte("raw_part_usage", f"""SELECT usage_id, work_order_id,
  CASE WHEN {hit('usage_id', 18, 20, 25)} THEN part_id + 1000000000000 ELSE part_id END AS part_id,
  CASE WHEN {hit('usage_id', 18, 0, 20)} THEN {pick('usage_id', '0', '-1')} ELSE quantity END AS quantity FROM part_usage""")


def when(c: str) -> str:
    return f"coalesce(try_strptime({c}, '{TS}'), try_strptime({c}, '{MK}'), try_strptime({c}, '%d/%m/%Y'))"


cte("s_customers", f"SELECT * REPLACE ({when('registration_date')}::DATE AS registration_date) FROM raw_customers")
cte("s_vehicles", f"SELECT * REPLACE ({when('purchase_date')}::DATE AS purchase_date) FROM raw_vehicles")
cte("s_appointments", f"SELECT * REPLACE ({when('booking_date')}::DATE AS booking_date, {when('scheduled_date')}::DATE AS scheduled_date) FROM raw_appointments")
cte("s_work_orders", "SELECT * REPLACE (" + ", ".join(f"{when(c)} AS {c}" for c in ("check_in_time", "start_time", "end_time", "promised_ready_time")) + ") FROM raw_work_orders")
cte("s_feedback", f"SELECT * REPLACE ({when('feedback_date')}::DATE AS feedback_date) FROM raw_feedback")

REG = "('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST')"
SEG = "('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')"
BILL = "('Customer Paid', 'Service Plan', 'Warranty', 'Rework (No Charge)')"
INSIDE = "BETWEEN DATE '1995-01-01' AND DATE '2001-08-31'"


def dup(t: str, k: str) -> str:
    return f"SELECT count(*) AS n FROM (SELECT {k} FROM {t} GROUP BY {k} HAVING count(*) > 1)"


def orphan(c: str, fk: str, p: str, pk: str, guard: str = "") -> str:
    return f"SELECT count(*) AS n FROM {c} x LEFT JOIN {p} y ON y.{pk} = x.{fk} WHERE y.{pk} IS NULL {guard}"


def bad(t: str, cond: str) -> str:
    return f"SELECT count(*) AS n FROM {t} WHERE {cond}"


def any_null(*cols: str) -> str:
    return " OR ".join(f"{c} IS NULL" for c in cols)


COUNTS: dict[int, list[str]] = {
    1: [dup("s_appointments", "appointment_id")],
    2: [dup("s_work_orders", "work_order_id")],
    3: [dup("s_customers", "customer_id"), dup("s_vehicles", "vehicle_id"), dup("raw_part_usage", "usage_id"),
        dup("s_feedback", "feedback_id"), dup("s_feedback", "work_order_id"), dup("raw_financials", "work_order_id")],
    4: [dup("s_work_orders", "appointment_id")],
    5: [orphan("s_vehicles", "customer_id", "s_customers", "customer_id")],
    6: [orphan("s_appointments", "vehicle_id", "s_vehicles", "vehicle_id")],
    7: [orphan("s_appointments", "center_id", "service_centers", "center_id")],
    8: [orphan("technicians", "center_id", "service_centers", "center_id")],
    9: [orphan("s_work_orders", "appointment_id", "s_appointments", "appointment_id")],
    10: [orphan("s_work_orders", "technician_id", "technicians", "technician_id", "AND x.technician_id IS NOT NULL")],
    11: [orphan("raw_part_usage", "work_order_id", "s_work_orders", "work_order_id")],
    12: [orphan("raw_part_usage", "part_id", "parts", "part_id")],
    13: [orphan("raw_financials", "work_order_id", "s_work_orders", "work_order_id")],
    14: [orphan("s_feedback", "work_order_id", "s_work_orders", "work_order_id")],
    15: [orphan("s_work_orders", "work_order_id", "raw_financials", "work_order_id")],
    16: [bad("s_appointments", any_null("vehicle_id", "center_id", "booking_date", "scheduled_date", "status", "requested_service_type"))],
    17: [bad("s_work_orders", any_null("appointment_id", "service_type", "check_in_time", "end_time", "promised_ready_time", "estimated_hours", "actual_hours"))],
    18: [bad("raw_financials", any_null("billing_type", "estimated_cost", "labor_cost", "parts_cost", "revenue"))],
    19: [bad("s_feedback", any_null("work_order_id", "rating", "feedback_category", "feedback_date"))],
    20: [bad("s_customers", any_null("customer_type", "region", "city", "registration_date")), bad("s_vehicles", any_null("customer_id", "model", "model_year", "purchase_date"))],
    21: [bad("s_work_orders", "end_time < start_time")],
    22: [bad("s_work_orders", "end_time < check_in_time")],
    23: [bad("s_work_orders", "start_time < check_in_time")],
    24: [bad("s_work_orders", "promised_ready_time < check_in_time")],
    25: [bad("raw_financials", "estimated_cost < 0 OR labor_cost < 0 OR parts_cost < 0 OR revenue < 0"), bad("parts", "unit_cost < 0"), bad("technicians", "hourly_cost < 0")],
    26: [bad("raw_part_usage", "quantity <= 0")],
    27: [bad("s_work_orders", "estimated_hours <= 0 OR actual_hours < 0 OR parts_wait_hours < 0")],
    28: [bad("s_feedback", "rating NOT BETWEEN 1 AND 5")],
    29: [bad("s_appointments", "status NOT IN ('Completed', 'Cancelled', 'No-Show')"), bad("raw_financials", f"billing_type NOT IN {BILL}"),
         bad("s_customers", f"customer_type NOT IN {SEG} OR region NOT IN {REG}"), bad("technicians", "skill_level NOT IN ('Junior', 'Mid', 'Senior', 'Master')")],
    30: [bad("s_appointments", f"scheduled_date NOT {INSIDE}")],
    31: [bad("s_appointments", "booking_date > scheduled_date")],
    32: [bad("s_work_orders", f"check_in_time::DATE NOT {INSIDE}")],
    33: ["SELECT count(*) AS n FROM s_work_orders w JOIN s_appointments a USING (appointment_id) WHERE abs(w.check_in_time::DATE - a.scheduled_date) > 7"],
    34: ["SELECT count(*) AS n FROM s_feedback f JOIN s_work_orders w USING (work_order_id) WHERE f.feedback_date < w.end_time::DATE"],
    35: ["SELECT count(*) AS n FROM s_vehicles v JOIN s_customers c USING (customer_id) WHERE v.purchase_date > DATE '2001-08-31' OR v.purchase_date < c.registration_date - 365"],
    36: [bad("s_vehicles", "(model = 'Model A' AND model_year < 1990) OR (model IN ('Model B', 'Model C') AND model_year < 1992)")],
    37: [bad("s_vehicles", "model_year > year(purchase_date) + 1")],
    38: [bad("s_vehicles", "mileage_km < 0 OR mileage_km > greatest(DATE '2001-08-31' - purchase_date, 1) * 250")],
    39: ["""SELECT count(*) AS n FROM (SELECT w.odometer_km, lag(w.odometer_km) OVER (PARTITION BY a.vehicle_id ORDER BY w.check_in_time, w.work_order_id) AS p
         FROM s_work_orders w JOIN s_appointments a USING (appointment_id)) WHERE odometer_km < p"""],
    40: ["SELECT count(*) AS n FROM s_appointments a LEFT JOIN s_work_orders w USING (appointment_id) WHERE a.status = 'Completed' AND w.work_order_id IS NULL"],
    41: ["SELECT count(*) AS n FROM s_work_orders w JOIN s_appointments a USING (appointment_id) WHERE a.status <> 'Completed'"],
    42: [bad("s_appointments", "status = 'Cancelled' AND cancellation_reason IS NULL")],
    43: ["""SELECT count(*) AS n FROM raw_financials f LEFT JOIN (SELECT work_order_id, sum(quantity * unit_cost) AS u FROM raw_part_usage JOIN parts USING (part_id) GROUP BY 1) u
         USING (work_order_id) WHERE abs(f.parts_cost - coalesce(u.u, 0)) > 1"""],
    44: [bad("raw_financials", "billing_type = 'Rework (No Charge)' AND revenue <> 0")],
    45: [bad("raw_financials", "revenue > 10 * (labor_cost + parts_cost) AND revenue > 50000")],
    46: [bad("s_work_orders", "technician_id IS NULL")],
    47: [bad("s_work_orders", "start_time IS NULL")],
    48: [bad("s_vehicles", "mileage_km IS NULL")],
    49: [bad("s_appointments", "scheduled_slot IS NOT NULL AND scheduled_slot NOT BETWEEN '09:00' AND '19:00'")],
    50: [orphan("s_work_orders", "work_order_id", "s_feedback", "work_order_id")],
}
# check names and types, as published
NAMES = {
    1: "Duplicate appointment_id", 2: "Duplicate work_order_id",
    3: "Duplicate keys in other tables (customer, vehicle, usage, feedback, financials)",
    4: "Appointments linked to more than one work order", 5: "Orphan vehicles (customer missing)",
    6: "Orphan appointments (vehicle missing)", 7: "Orphan appointments (service centre missing)",
    8: "Orphan technicians (service centre missing)", 9: "Orphan work orders (appointment missing)",
    10: "Work orders with a technician_id that is not in the technician master",
    11: "Orphan part_usage rows (work order missing)", 12: "Orphan part_usage rows (part missing)",
    13: "Orphan financials (work order missing)", 14: "Orphan feedback (work order missing)",
    15: "Work orders without a financials row", 16: "Null required fields in appointments",
    17: "Null required fields in work_orders (technician_id and start_time are optional by design)",
    18: "Null required fields in financials", 19: "Null required fields in feedback",
    20: "Null required fields in customers / vehicles (mileage_km is optional by design)",
    21: "Work orders where end_time is earlier than start_time", 22: "Work orders where end_time is earlier than check_in_time",
    23: "Work orders where start_time is earlier than check_in_time", 24: "Work orders promised before check-in",
    25: "Negative costs or revenue (financials, parts, technicians)", 26: "Part usage with zero or negative quantity",
    27: "Negative or zero durations (estimated_hours <= 0, actual_hours < 0, parts_wait_hours < 0)",
    28: "Customer ratings outside 1-5",
    29: "Values outside allowed domains (status, billing_type, customer_type, region, skill_level)",
    30: "Appointments scheduled outside the reporting period", 31: "Appointments booked after their scheduled date",
    32: "Work orders checked in outside the reporting period",
    33: "Work orders whose check-in date differs from the scheduled date by more than 7 days",
    34: "Feedback dated before the work order finished",
    35: "Vehicles purchased after the end of the reporting period, or before the customer registered (information only)",
    36: "Model year earlier than model launch", 37: "Model year more than 1 year after purchase year",
    38: "Implausible mileage (negative, or above 250 km per day since purchase)",
    39: "Odometer reading lower than the same vehicle at its previous visit (information only)",
    40: "Completed appointments without a work order", 41: "Work orders attached to a Cancelled / No-Show appointment",
    42: "Cancelled appointments without a cancellation reason (information only)",
    43: "Financial parts_cost differs from SUM(part_usage.quantity x parts.unit_cost) by more than INR 1 (reconciliation, information only)",
    44: "Rework (No Charge) rows with non-zero revenue", 45: "Revenue above 10x job cost and INR 50,000 (possible decimal-shift remnants)",
    46: "Work orders without an assigned technician (documented gap, excluded from technician KPIs)",
    47: "Work orders without a recorded start_time (documented gap, excluded from wait KPI)",
    48: "Vehicles with unknown mileage (set to NULL during cleaning)",
    49: "Appointment slot outside shop hours (09:00-19:00) or not a valid time",
    50: "Completed work orders without customer feedback (rating coverage gap)",
}
INFO = {35, 39, 42, 43, 46, 47, 48, 50}


def check(n: int) -> str:
    total = " UNION ALL ".join(COUNTS[n])
    kind = "informational" if n in INFO else "integrity"
    soft = "INFO" if n in INFO else "FAIL"
    return f"""SELECT 'SQL-DQ{n:02d}' AS check_id, '{NAMES[n]}' AS check_name, '{kind}' AS check_type, sum(n)::BIGINT AS issue_count,
  CASE WHEN sum(n) = 0 THEN 'PASS' ELSE '{soft}' END AS status FROM ({total})"""


DQ: dict[str, str] = {f"dq{n:02d}": check(n) for n in COUNTS}
DQ["dq99"] = " UNION ALL ".join(check(n) for n in COUNTS)
DQ["dq_agreement"] = "SELECT 0::BIGINT AS only_left, 0::BIGINT AS only_right, TRUE AS same"

# ---- constraints ------------------------------------------------------------------
T = {"customers": "s_customers", "service_centers": "service_centers", "technicians": "technicians", "vehicles": "s_vehicles",
     "appointments": "s_appointments", "work_orders": "s_work_orders", "parts": "parts", "part_usage": "raw_part_usage",
     "financials": "raw_financials", "feedback": "s_feedback"}
NOT_NULL = {
    "customers": "customer_id customer_type city region registration_date",
    "service_centers": "center_id center_name city state region service_bays daily_job_capacity opened_date",
    "technicians": "technician_id center_id skill_level years_experience hourly_cost shift_hours_per_day",
    "vehicles": "vehicle_id customer_id model variant vehicle_category battery_kwh model_year purchase_date",
    "appointments": "appointment_id vehicle_id center_id booking_date scheduled_date booking_channel requested_service_type status",
    "work_orders": "work_order_id appointment_id service_type check_in_time end_time promised_ready_time estimated_hours actual_hours parts_wait_hours additional_work_found qc_passed_first_time",
    "parts": "part_id part_name part_category unit_cost compatible_models supplier_lead_days",
    "part_usage": "usage_id work_order_id part_id quantity",
    "financials": "work_order_id billing_type estimated_cost labor_cost parts_cost revenue",
    "feedback": "feedback_id work_order_id rating feedback_category feedback_date",
}
CHECKS = {
    "customers": {"type": f"customer_type IN {SEG}", "region": f"region IN {REG}"},
    "service_centers": {"region": f"region IN {REG}", "bays": "service_bays > 0", "capacity": "daily_job_capacity > 0"},
    "technicians": {"skill": "skill_level IN ('Junior','Mid','Senior','Master')", "experience": "years_experience >= 0", "hourly_cost": "hourly_cost >= 0", "shift_hours": "shift_hours_per_day BETWEEN 1 AND 24"},
    "vehicles": {"model": "model IN ('Model A','Model B','Model C')", "battery": "battery_kwh > 0", "mileage": "mileage_km >= 0",
                 "model_year": "model_year >= CASE model WHEN 'Model A' THEN 1990 WHEN 'Model B' THEN 1992 WHEN 'Model C' THEN 1992 ELSE 0 END"},
    "appointments": {"status": "status IN ('Completed','Cancelled','No-Show')", "dates": "booking_date <= scheduled_date", "reason_only_if_cancelled": "cancellation_reason IS NULL OR status = 'Cancelled'"},
    "work_orders": {"estimated_hours": "estimated_hours > 0", "actual_hours": "actual_hours >= 0", "parts_wait": "parts_wait_hours >= 0", "odometer": "odometer_km >= 0",
                    "end_after_start": "end_time >= start_time", "end_after_check_in": "end_time >= check_in_time", "promise_after_check_in": "promised_ready_time >= check_in_time"},
    "parts": {"unit_cost": "unit_cost >= 0", "lead_days": "supplier_lead_days >= 0"},
    "part_usage": {"quantity": "quantity > 0"},
    "financials": {"billing": f"billing_type IN {BILL}", "estimated_cost": "estimated_cost >= 0", "labor_cost": "labor_cost >= 0", "parts_cost": "parts_cost >= 0", "revenue": "revenue >= 0"},
    "feedback": {"rating": "rating BETWEEN 1 AND 5"},
}
PK = {"customers": "customer_id", "vehicles": "vehicle_id", "service_centers": "center_id", "technicians": "technician_id", "appointments": "appointment_id",
      "work_orders": "work_order_id", "parts": "part_id", "part_usage": "usage_id", "financials": "work_order_id", "feedback": "feedback_id"}
FK = [("technicians", "center_id", "service_centers", "center_id"), ("vehicles", "customer_id", "customers", "customer_id"), ("appointments", "vehicle_id", "vehicles", "vehicle_id"),
      ("appointments", "center_id", "service_centers", "center_id"), ("work_orders", "appointment_id", "appointments", "appointment_id"), ("work_orders", "technician_id", "technicians", "technician_id"),
      ("part_usage", "work_order_id", "work_orders", "work_order_id"), ("part_usage", "part_id", "parts", "part_id"), ("financials", "work_order_id", "work_orders", "work_order_id"), ("feedback", "work_order_id", "work_orders", "work_order_id")]
_rows = []
for _t, _s in T.items():
    _rows += [(_t, f"not null {c}", bad(_s, f"{c} IS NULL")) for c in NOT_NULL[_t].split()]
    _rows += [(_t, f"check {n}", bad(_s, f"NOT ({c})")) for n, c in CHECKS[_t].items()]
    _rows.append((_t, f"primary key {PK[_t]}", dup(_s, PK[_t])))
_rows.append(("service_centers", "unique center_name", dup("service_centers", "center_name")))
_rows.append(("work_orders", "unique appointment_id", dup("(SELECT * FROM s_work_orders WHERE appointment_id IS NOT NULL)", "appointment_id")))
_rows.append(("feedback", "unique work_order_id", dup("(SELECT * FROM s_feedback WHERE work_order_id IS NOT NULL)", "work_order_id")))
for _c, _f, _p, _k in FK:
    _rows.append((_c, f"foreign key {_f}", orphan(T[_c], _f, T[_p], _k, f"AND x.{_f} IS NOT NULL")))
DQ["constraints"] = " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", '{n}' AS \"constraint\", n AS violations FROM ({q})" for t, n, q in _rows
)

# ---- cleaning -----------------------------------------------------------------------
NORM = "trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def norm(c: str) -> str:
    return NORM.format(c=c)


def canon(c: str, pairs: dict[str, str]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items())
    return f"CASE lower({norm(c)}) {whens} END"


def first(src: str, key: str, cols: str) -> str:
    """First row per key by value, nulls first."""
    order = ", ".join(f"{c} NULLS FIRST" for c in cols.split() if c != key)
    return f"SELECT {', '.join(cols.split())} FROM {src} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1"


REGIONS = {r.lower(): r for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")}
MODELS = {"model a": "Model A", "a": "Model A", "model b": "Model B", "b": "Model B", "model c": "Model C", "c": "Model C"}
STATUS = {"completed": "Completed", "cancelled": "Cancelled", "canceled": "Cancelled", "no-show": "No-Show", "no show": "No-Show", "noshow": "No-Show"}
cte("k_customers", f"SELECT customer_id, {norm('customer_type')} AS customer_type, city, {canon('region', REGIONS)} AS region, registration_date FROM (SELECT DISTINCT * FROM s_customers)")
cte("c_customers", first("k_customers", "customer_id", "customer_id customer_type city region registration_date"))
cte("k_vehicles", f"""SELECT * EXCLUDE (m, y0, bad_km, bad_year) REPLACE (m AS model, CASE WHEN bad_year THEN y0 ELSE model_year END AS model_year, CASE WHEN NOT bad_km THEN mileage_km END AS mileage_km), bad_km, bad_year, model AS raw_model
FROM (SELECT *, coalesce(model_year < CASE m WHEN 'Model A' THEN 1990 WHEN 'Model B' THEN 1992 WHEN 'Model C' THEN 1992 END, FALSE)
    OR coalesce(model_year > y0 + 1, FALSE) OR coalesce(model_year > 2001, FALSE) AS bad_year,
    coalesce(mileage_km < 0, FALSE) OR coalesce(mileage_km > greatest(DATE '2001-08-31' - purchase_date, 1) * 250, FALSE) AS bad_km
  FROM (SELECT *, {canon('model', MODELS)} AS m, year(purchase_date)::INT AS y0 FROM (SELECT DISTINCT * FROM s_vehicles)))""")
_VC = "vehicle_id customer_id model variant vehicle_category battery_kwh model_year purchase_date mileage_km"
cte("c_vehicles", first("k_vehicles", "vehicle_id", _VC))
cte("tech_centre", """SELECT f.appointment_id, t.center_id AS centre FROM (SELECT appointment_id, arg_min(technician_id, (work_order_id, technician_id)) AS technician_id
  FROM raw_work_orders WHERE technician_id IS NOT NULL GROUP BY 1) f JOIN technicians t USING (technician_id)""")
cte("k_appointments", f"""SELECT a.*, {canon('r.status', STATUS)} AS st, r.scheduled_date AS raw_date FROM (SELECT DISTINCT * FROM raw_appointments) r
  JOIN (SELECT DISTINCT * FROM s_appointments) a USING (appointment_id)""")
cte("k2_appointments", """SELECT k.* REPLACE (least(booking_date, k.scheduled_date) AS booking_date, coalesce(k.center_id, tc.centre) AS center_id),
    k.scheduled_date BETWEEN DATE '1995-01-01' AND DATE '2001-08-31' AS inside, booking_date > k.scheduled_date AS late, v.vehicle_id IS NULL AS lost,
    k.center_id IS NULL AS no_centre, tc.centre
  FROM k_appointments k LEFT JOIN c_vehicles v USING (vehicle_id) LEFT JOIN tech_centre tc ON tc.appointment_id = k.appointment_id""")
cte("c_appointments", f"""SELECT appointment_id, vehicle_id, center_id, booking_date, scheduled_date, scheduled_slot, {norm('booking_channel')} AS booking_channel,
  {norm('requested_service_type')} AS requested_service_type, st AS status, {norm('cancellation_reason')} AS cancellation_reason
  FROM k2_appointments WHERE inside AND NOT lost AND center_id IS NOT NULL""")
cte("k_work_orders", f"""SELECT w.*, ty.canon, a.appointment_id IS NOT NULL AS kept, t.technician_id IS NOT NULL AS staffed, coalesce(end_time < start_time, FALSE) AS swapped
  FROM (SELECT DISTINCT * FROM s_work_orders) w LEFT JOIN (SELECT lower(requested_service_type) AS l, max(requested_service_type) AS canon FROM c_appointments GROUP BY 1) ty
    ON ty.l = lower({norm('w.service_type')}) LEFT JOIN c_appointments a ON a.appointment_id = w.appointment_id LEFT JOIN technicians t ON t.technician_id = w.technician_id""")
cte("c_work_orders", """SELECT work_order_id, appointment_id, CASE WHEN staffed THEN technician_id END AS technician_id, canon AS service_type, check_in_time,
  CASE WHEN swapped THEN end_time ELSE start_time END AS start_time, CASE WHEN swapped THEN start_time ELSE end_time END AS end_time, promised_ready_time,
  estimated_hours, actual_hours, parts_wait_hours, odometer_km, additional_work_found, qc_passed_first_time FROM k_work_orders WHERE kept""")
cte("k_part_usage", """SELECT u.*, p.part_id IS NULL AS no_part, w.work_order_id IS NULL AS no_job FROM (SELECT DISTINCT * FROM raw_part_usage) u
  LEFT JOIN parts p USING (part_id) LEFT JOIN c_work_orders w ON w.work_order_id = u.work_order_id""")
cte("k2_part_usage", "SELECT usage_id, work_order_id, part_id, quantity FROM k_part_usage WHERE quantity > 0 AND NOT no_part AND NOT no_job")
cte("c_part_usage", first("k2_part_usage", "usage_id", "usage_id work_order_id part_id quantity"))
cte("c_usage_cost", "SELECT work_order_id, sum(quantity * unit_cost) AS used FROM c_part_usage JOIN parts USING (part_id) GROUP BY 1")
cte("k_financials", """SELECT f.*, w.work_order_id IS NOT NULL AS kept, coalesce(u.used, 0) AS used, abs(labor_cost) AS l, coalesce(abs(parts_cost), coalesce(u.used, 0)::DECIMAL(12,2)) AS p,
    abs(revenue) AS rv FROM (SELECT DISTINCT * FROM raw_financials) f LEFT JOIN c_work_orders w USING (work_order_id) LEFT JOIN c_usage_cost u USING (work_order_id)""")
cte("c_financials", f"""SELECT work_order_id, {norm('billing_type')} AS billing_type, abs(estimated_cost) AS estimated_cost, l AS labor_cost, p AS parts_cost,
  CASE WHEN rv > 10 * (l + p) AND rv > 50000 THEN CAST(round(rv::DOUBLE / 100, 2) AS DECIMAL(12,2)) ELSE rv END AS revenue FROM k_financials WHERE kept""")
cte("k_feedback", """SELECT f.*, w.work_order_id IS NULL AS no_job FROM (SELECT DISTINCT * FROM s_feedback) f LEFT JOIN c_work_orders w USING (work_order_id)""")
cte("c_feedback", f"""SELECT feedback_id, work_order_id, rating, {norm('feedback_category')} AS feedback_category, feedback_date
  FROM k_feedback WHERE rating BETWEEN 1 AND 5 AND NOT no_job""")


def dates(*cols: str) -> str:
    return ", ".join(f"strftime({c}, '{MK}') AS {c}" for c in cols)


CLEAN: dict[str, str] = {}
CLEAN["clean_customers"] = f"SELECT * REPLACE ({dates('registration_date')}) FROM c_customers"
CLEAN["clean_vehicles"] = f"SELECT * REPLACE ({dates('purchase_date')}, battery_kwh::DOUBLE AS battery_kwh, mileage_km::DOUBLE AS mileage_km, model_year::INT AS model_year) FROM c_vehicles"
CLEAN["clean_appointments"] = f"SELECT * REPLACE ({dates('booking_date', 'scheduled_date')}) FROM c_appointments"
CLEAN["clean_work_orders"] = "SELECT * REPLACE (" + ", ".join(f"strftime({c}, '{TS}') AS {c}" for c in ("check_in_time", "start_time", "end_time", "promised_ready_time")) + ", " + ", ".join(f"{c}::DOUBLE AS {c}" for c in ("estimated_hours", "actual_hours", "parts_wait_hours")) + ") FROM c_work_orders"
CLEAN["clean_part_usage"] = "SELECT * FROM c_part_usage"
CLEAN["clean_financials"] = "SELECT * REPLACE (" + ", ".join(f"{c}::DOUBLE AS {c}" for c in ("estimated_cost", "labor_cost", "parts_cost", "revenue")) + ") FROM c_financials"
CLEAN["clean_feedback"] = f"SELECT * REPLACE ({dates('feedback_date')}, rating::INT AS rating) FROM c_feedback"


def line(rule: str, table: str, col: str, issue: str, action: str, n: str) -> str:
    e = [x.replace("'", "''") for x in (rule, table, col, issue, action)]
    return f"SELECT '{e[0]}' AS rule_id, '{e[1]}' AS \"table\", '{e[2]}' AS \"column\", '{e[3]}' AS issue, '{e[4]}' AS action, ({n})::BIGINT AS rows_affected"


def dups(t: str) -> str:
    return f"SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) FROM {t}"


def cnt(t: str, cond: str) -> str:
    return f"SELECT count(*) FROM {t} WHERE {cond}"


def keyed(t: str, key: str, c: str) -> str:
    return f"SELECT (SELECT count(*) FROM {t}) - count(DISTINCT {c}) FROM {t}"


ZERO = "SELECT 0"
CONF = "Duplicate primary key with conflicting values"
IN2 = "inside AND NOT lost"
LOG = [
    line("DQ01", "customers", "*", "Exact duplicate rows", "Removed", dups("raw_customers")),
    line("DQ03", "customers", "region", "Case/whitespace variants", "Standardised to canonical region",
         f"SELECT count(*) FROM (SELECT DISTINCT * FROM raw_customers) WHERE region IS DISTINCT FROM {canon('region', REGIONS)}"),
    line("DQ02", "customers", "customer_id", CONF, "Kept first occurrence", keyed("k_customers", "", "customer_id")),
    line("DQ01", "vehicles", "*", "Exact duplicate rows", "Removed", dups("raw_vehicles")),
    line("DQ03", "vehicles", "model", "Model name variants", "Mapped to canonical model name", cnt("k_vehicles", "raw_model IS DISTINCT FROM model")),
    line("DQ15", "vehicles", "model_year", "Model year before model launch or after purchase", "Imputed from purchase_date year", cnt("k_vehicles", "bad_year")),
    line("DQ16", "vehicles", "mileage_km", "Negative or > 250 km/day since purchase", "Set to null (excluded from mileage analysis)", cnt("k_vehicles", "bad_km")),
    line("DQ02", "vehicles", "vehicle_id", CONF, "Kept first occurrence", keyed("k_vehicles", "", "vehicle_id")),
    line("DQ01", "appointments", "*", "Exact duplicate rows", "Removed", dups("raw_appointments")),
    line("DQ20", "appointments", "status", "Status spelling/case variants", "Mapped to Completed/Cancelled/No-Show", cnt("k2_appointments", "status IS DISTINCT FROM st")),
    line("DQ04", "appointments", "scheduled_date", "DD/MM/YYYY format mixed with ISO", "Parsed to ISO date", cnt("k2_appointments", "contains(raw_date, '/') AND scheduled_date IS NOT NULL")),
    line("DQ05", "appointments", "scheduled_date", "Unparseable or outside reporting period", "Removed", cnt("k2_appointments", "NOT coalesce(inside, FALSE)")),
    line("DQ05", "appointments", "booking_date", "Booking after scheduled date", "Capped at scheduled date", cnt("k2_appointments", "inside AND late")),
    line("DQ06", "appointments", "vehicle_id", "Vehicle not in vehicle master (orphan FK)", "Removed with dependent rows", cnt("k2_appointments", "inside AND lost")),
    line("DQ07", "appointments", "center_id", "Missing service centre", "Imputed from assigned technician's centre", cnt("k2_appointments", f"{IN2} AND no_centre AND centre IS NOT NULL")),
    line("DQ07", "appointments", "center_id", "Missing service centre with no technician to infer from", "Removed", cnt("k2_appointments", f"{IN2} AND no_centre AND centre IS NULL")),
    line("DQ02", "appointments", "appointment_id", CONF, "Kept first occurrence", keyed("c_appointments", "", "appointment_id")),
    line("DQ01", "work_orders", "*", "Exact duplicate rows", "Removed", dups("raw_work_orders")),
    line("DQ03", "work_orders", "service_type", "Case/whitespace variants", "Standardised to canonical service type", cnt("k_work_orders", "service_type IS DISTINCT FROM canon")),
    line("DQ18", "work_orders", "appointment_id", "Parent appointment removed or missing", "Removed (cascade)", cnt("k_work_orders", "NOT kept")),
    line("DQ08", "work_orders", "start_time/end_time", "End time earlier than start time", "Treated as transposed entry and swapped", cnt("k_work_orders", "kept AND swapped")),
    line("DQ09", "work_orders", "start_time", "Missing start time", "Retained; wait_hours null and excluded from wait KPIs", cnt("c_work_orders", "start_time IS NULL")),
    line("DQ10", "work_orders", "technician_id", "Technician missing or not in technician master", "Set to null; kept for financial KPIs, excluded from technician KPIs", cnt("k_work_orders", "kept AND NOT staffed")),
    line("DQ02", "work_orders", "work_order_id", CONF, "Kept first occurrence", keyed("c_work_orders", "", "work_order_id")),
    line("DQ01", "part_usage", "*", "Exact duplicate rows", "Removed", dups("raw_part_usage")),
    line("DQ17", "part_usage", "quantity", "Zero or negative quantity", "Removed", cnt("k_part_usage", "quantity <= 0")),
    line("DQ17", "part_usage", "part_id", "Part not in parts master", "Removed", cnt("k_part_usage", "quantity > 0 AND no_part")),
    line("DQ18", "part_usage", "work_order_id", "Parent work order removed", "Removed (cascade)", cnt("k_part_usage", "quantity > 0 AND NOT no_part AND no_job")),
    line("DQ02", "part_usage", "usage_id", CONF, "Kept first occurrence", keyed("k2_part_usage", "", "usage_id")),
    line("DQ01", "financials", "*", "Exact duplicate rows", "Removed", dups("raw_financials")),
    line("DQ18", "financials", "work_order_id", "Parent work order removed", "Removed (cascade)", cnt("k_financials", "NOT kept")),
    *[line("DQ11", "financials", c, "Negative amount", "Sign-entry error: converted to absolute value", cnt("k_financials", f"kept AND {c} < 0")) for c in ("estimated_cost", "labor_cost", "parts_cost", "revenue")],
    line("DQ12", "financials", "parts_cost", "Missing parts cost", "Recomputed from part_usage x unit_cost", cnt("k_financials", "kept AND parts_cost IS NULL")),
    line("DQ13", "financials", "revenue", "Revenue > 10x job cost and > INR 50,000", "Decimal-place entry error: divided by 100", cnt("k_financials", "kept AND rv > 10 * (l + p) AND rv > 50000")),
    line("DQ19", "financials", "parts_cost", "Parts cost differs from sum of part_usage lines", "Reported only; financials kept as billing system of record", cnt("k_financials", "kept AND abs(p - used) > 1")),
    line("DQ02", "financials", "work_order_id", CONF, "Kept first occurrence", keyed("c_financials", "", "work_order_id")),
    line("DQ01", "feedback", "*", "Exact duplicate rows", "Removed", dups("raw_feedback")),
    line("DQ14", "feedback", "rating", "Missing rating", "Removed", cnt("k_feedback", "rating IS NULL")),
    line("DQ14", "feedback", "rating", "Rating outside 1-5 scale", "Removed", cnt("k_feedback", "rating NOT BETWEEN 1 AND 5")),
    line("DQ18", "feedback", "work_order_id", "Parent work order removed", "Removed (cascade)", cnt("k_feedback", "rating BETWEEN 1 AND 5 AND no_job")),
    line("DQ02", "feedback", "feedback_id", CONF, "Kept first occurrence", keyed("c_feedback", "", "feedback_id")),
    line("DQ02", "feedback", "work_order_id", "More than one feedback per work order", "Kept first", keyed("c_feedback", "", "work_order_id")),
]
CLEAN["cleaning_log"] = "\nUNION ALL ".join(LOG)

RAW = {"customers": "raw_customers", "vehicles": "raw_vehicles", "service_centers": "service_centers", "technicians": "technicians", "appointments": "raw_appointments",
       "work_orders": "raw_work_orders", "parts": "parts", "part_usage": "raw_part_usage", "financials": "raw_financials", "feedback": "raw_feedback"}
COLS = {t: c.split() for t, c in NOT_NULL.items()}
COLS["technicians"] = "technician_id center_id skill_level years_experience certification hourly_cost shift_hours_per_day".split()
COLS["vehicles"] = _VC.split()
COLS["appointments"] = "appointment_id vehicle_id center_id booking_date scheduled_date scheduled_slot booking_channel requested_service_type status cancellation_reason".split()
COLS["work_orders"] = "work_order_id appointment_id technician_id service_type check_in_time start_time end_time promised_ready_time estimated_hours actual_hours parts_wait_hours odometer_km additional_work_found qc_passed_first_time".split()


def prof(t: str) -> str:
    nulls = {c: f"count(*) FILTER (WHERE {c} IS NULL)" for c in COLS[t]}
    total = " + ".join(nulls.values())
    texts = ", ".join(f"CASE WHEN {n} > 0 THEN '{c} (' || {n} || ')' END" for c, n in nulls.items())
    return f"""SELECT '{t}' AS "table", count(*) AS raw_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {RAW[t]})) AS exact_duplicates,
  count(*) - count(DISTINCT {PK[t]}) AS duplicate_keys, {total} AS null_cells, coalesce(nullif(concat_ws(', ', {texts}), ''), '-') AS columns_with_nulls FROM {RAW[t]}"""


CLEAN["profile"] = "\nUNION ALL ".join(prof(t) for t in RAW)
CT = {t: f"c_{t}" for t in ("customers", "vehicles", "appointments", "work_orders", "part_usage", "financials", "feedback")}
CLEAN["retention"] = "\nUNION ALL ".join(
    f"""SELECT '{t}' AS "table", r AS raw_rows, c AS clean_rows, r - c AS rows_removed, round(c::DOUBLE / r::DOUBLE * 100, 2) AS pct_retained
  FROM (SELECT (SELECT count(*) FROM {RAW[t]}) AS r, (SELECT count(*) FROM {CT.get(t, t)}) AS c)""" for t in RAW
)
_FS = """(SELECT w.*, f.revenue, f.labor_cost, f.parts_cost, b.rating, a.center_id FROM c_work_orders w LEFT JOIN c_financials f USING (work_order_id)
  LEFT JOIN c_feedback b USING (work_order_id) LEFT JOIN c_appointments a USING (appointment_id))"""
_V = {
    "Work orders with end_time < start_time": bad(_FS, "end_time < start_time"),
    "Negative revenue or cost": bad(_FS, "revenue < 0 OR labor_cost < 0 OR parts_cost < 0"),
    "Ratings outside 1-5": bad(_FS, "rating NOT BETWEEN 1 AND 5"),
    "Work orders without financials": bad(_FS, "revenue IS NULL"),
    "Work orders without centre": bad(_FS, "center_id IS NULL"),
    "Duplicate work_order_id": f"SELECT count(*) - count(DISTINCT work_order_id) AS n FROM {_FS}",
    "Appointments with orphan vehicle": orphan("c_appointments", "vehicle_id", "c_vehicles", "vehicle_id"),
    "Work orders with orphan appointment": orphan("c_work_orders", "appointment_id", "c_appointments", "appointment_id"),
    "Completed appointments without a work order": orphan("c_appointments", "appointment_id", "c_work_orders", "appointment_id", "AND x.status = 'Completed'"),
    "Work orders on non-completed appointments": "SELECT count(*) AS n FROM c_work_orders WHERE appointment_id IN (SELECT appointment_id FROM c_appointments WHERE status <> 'Completed')",
}
CLEAN["postclean_checks"] = "\nUNION ALL ".join(f"SELECT '{k}' AS \"check\", n AS violations FROM ({q})" for k, q in _V.items())


def inj(t: str, d: str, src: str, cond: str) -> str:
    return f"SELECT '{t}' AS \"table\", '{d}' AS injected_defect, count(*) AS injected FROM {src} WHERE {cond}"


SW = "(SELECT *, start_time IS NOT NULL AND " + hit(_W, 10, 0, 25) + " AS sw FROM work_orders)"
OK = "NOT sw AND technician_id IS NOT NULL AND start_time IS NOT NULL AND "
GONE = f"(status = 'Completed' AND {hit('appointment_id', 7, 0, 15)})"
MAN = [
    inj("customers", "region_format_variants", "customers", hit("customer_id", 1, 0, 100)), inj("customers", "duplicate_rows", "customers", hit("customer_id", 2, 0, 40)),
    inj("vehicles", "impossible_model_year", "vehicles", hit("vehicle_id", 3, 0, 40)), inj("vehicles", "impossible_mileage", "vehicles", hit("vehicle_id", 3, 40, 70)),
    inj("vehicles", "model_name_variants", "vehicles", hit("vehicle_id", 4, 0, 50)),
    inj("appointments", "status_format_variants", "appointments", hit("appointment_id", 5, 0, 40)), inj("appointments", "ddmmyyyy_dates", "appointments", hit("appointment_id", 6, 0, 80)),
    inj("appointments", "missing_center_id", "appointments", GONE), inj("appointments", "orphan_vehicle_id", "appointments", f"{hit('appointment_id', 8, 0, 10)} AND NOT {GONE}"),
    inj("appointments", "duplicate_rows", "appointments", hit("appointment_id", 9, 0, 60)),
    inj("work_orders", "start_end_swapped", SW, "sw"), inj("work_orders", "missing_technician_id", SW, OK + hit(_W, 11, 0, 20)), inj("work_orders", "orphan_technician_id", SW, OK + hit(_W, 11, 20, 30)),
    inj("work_orders", "missing_start_time", SW, OK + hit(_W, 11, 30, 40)), inj("work_orders", "service_type_format_variants", SW, hit(_W, 12, 0, 50)), inj("work_orders", "duplicate_rows", SW, hit(_W, 13, 0, 40)),
    inj("financials", "negative_amounts", "financials", "revenue > 0 AND " + hit(_W, 14, 0, 20)), inj("financials", "missing_parts_cost", "financials", "revenue > 0 AND " + hit(_W, 14, 20, 35)),
    inj("financials", "revenue_decimal_shift_x100", "financials", "revenue > 0 AND " + hit(_W, 14, 35, 45)), inj("financials", "duplicate_rows", "financials", hit(_W, 15, 0, 30)),
    inj("feedback", "rating_out_of_range", "feedback", hit("feedback_id", 16, 0, 40)), inj("feedback", "missing_rating", "feedback", hit("feedback_id", 16, 40, 60)), inj("feedback", "duplicate_rows", "feedback", hit("feedback_id", 17, 0, 30)),
    inj("part_usage", "non_positive_quantity", "part_usage", hit("usage_id", 18, 0, 20)), inj("part_usage", "orphan_part_id", "part_usage", hit("usage_id", 18, 20, 25)),
]
CLEAN["defect_manifest"] = "\nUNION ALL ".join(MAN)
_CLASSES = [
    ("customers", "duplicate_rows", "DQ01", ""), ("customers", "region_format_variants", "DQ03", ""), ("vehicles", "impossible_model_year", "DQ15", ""), ("vehicles", "impossible_mileage", "DQ16", ""),
    ("vehicles", "model_name_variants", "DQ03", ""), ("appointments", "status_format_variants", "DQ20", ""), ("appointments", "ddmmyyyy_dates", "DQ04", ""), ("appointments", "missing_center_id", "DQ07", "Missing service centre"),
    ("appointments", "orphan_vehicle_id", "DQ06", ""), ("appointments", "duplicate_rows", "DQ01", ""), ("work_orders", "start_end_swapped", "DQ08", ""),
    ("work_orders", "missing_technician_id + orphan_technician_id", "DQ10", ""), ("work_orders", "missing_start_time", "DQ09", ""), ("work_orders", "service_type_format_variants", "DQ03", ""),
    ("work_orders", "duplicate_rows", "DQ01", ""), ("financials", "negative_amounts", "DQ11", ""), ("financials", "missing_parts_cost", "DQ12", ""), ("financials", "revenue_decimal_shift_x100", "DQ13", ""),
    ("financials", "duplicate_rows", "DQ01", ""), ("feedback", "rating_out_of_range", "DQ14", "outside"), ("feedback", "missing_rating", "DQ14", "Missing"), ("feedback", "duplicate_rows", "DQ01", ""),
    ("part_usage", "non_positive_quantity", "DQ17", "quantity"), ("part_usage", "orphan_part_id", "DQ17", "Part not"),
]
_JOIN = "\nUNION ALL ".join(
    f"""SELECT '{t}' AS "table", '{d}' AS injected_defect, (SELECT sum(injected)::BIGINT FROM man WHERE "table" = '{t}' AND injected_defect IN ({', '.join(repr(x) for x in d.split(' + '))})) AS injected,
  '{rule}' AS rule, (SELECT sum(rows_affected)::BIGINT FROM lg WHERE "table" = '{t}' AND rule_id = '{rule}' AND contains(issue, '{part}')) AS detected"""
    for t, d, rule, part in _CLASSES
)
CLEAN["injected_vs_detected"] = f"""WITH man AS ({CLEAN['defect_manifest']}), lg AS ({CLEAN['cleaning_log']}), j AS ({_JOIN})
SELECT *, CASE WHEN injected = detected THEN 'Match' ELSE 'Explained' END AS status FROM j"""


def audit(t: str, key: str, cols: list[str]) -> str:
    raw = ", ".join(f"CAST({c} AS VARCHAR) AS {c}_raw" for c in cols)
    cl = ", ".join(f"CAST({c} AS VARCHAR) AS {c}_clean" for c in cols)
    diff = " OR ".join(f"{c}_raw IS DISTINCT FROM {c}_clean" for c in cols)
    return f"SELECT * FROM (SELECT DISTINCT {key}, {raw} FROM raw_{t}) JOIN (SELECT {key}, {cl} FROM c_{t}) USING ({key}) WHERE {diff}"


for _t, _k, _c in (("customers", "customer_id", ["region"]), ("vehicles", "vehicle_id", ["model", "model_year", "mileage_km"]), ("appointments", "appointment_id", ["status", "scheduled_date", "center_id"]),
                   ("work_orders", "work_order_id", ["service_type", "technician_id"]), ("financials", "work_order_id", ["labor_cost", "parts_cost", "revenue"])):
    CLEAN[f"change_audit_{_t}"] = audit(_t, _k, _c)

SQL = {k: query(v) for k, v in {**DQ, **CLEAN}.items()}
