"""The 50 data-quality checks and their summary.

A check is a sum of parts. All row-level parts of one table share one aggregation; a
missing-parent part is one anti-join. Asking for a single check builds only its parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bayworks.config import Config
from bayworks.functions.scalars import any_of, flag
from bayworks.operators.history import neighbours
from bayworks.operators.validate import KeyCheck, Use, compiled_checks, counters, lost_key, met_key, one_count, repeated_key, union_all
from bayworks.sources import schemas

Tables = Mapping[str, DataFrame]
INTEGRITY, INFO = "integrity", "informational"

# ---- fixed values: check number -> (name, type) ----------------------------------
CATALOGUE: dict[int, tuple[str, str]] = {
    1: ("Duplicate appointment_id", INTEGRITY),
    2: ("Duplicate work_order_id", INTEGRITY),
    3: ("Duplicate keys in other tables (customer, vehicle, usage, feedback, financials)", INTEGRITY),
    4: ("Appointments linked to more than one work order", INTEGRITY),
    5: ("Orphan vehicles (customer missing)", INTEGRITY),
    6: ("Orphan appointments (vehicle missing)", INTEGRITY),
    7: ("Orphan appointments (service centre missing)", INTEGRITY),
    8: ("Orphan technicians (service centre missing)", INTEGRITY),
    9: ("Orphan work orders (appointment missing)", INTEGRITY),
    10: ("Work orders with a technician_id that is not in the technician master", INTEGRITY),
    11: ("Orphan part_usage rows (work order missing)", INTEGRITY),
    12: ("Orphan part_usage rows (part missing)", INTEGRITY),
    13: ("Orphan financials (work order missing)", INTEGRITY),
    14: ("Orphan feedback (work order missing)", INTEGRITY),
    15: ("Work orders without a financials row", INTEGRITY),
    16: ("Null required fields in appointments", INTEGRITY),
    17: ("Null required fields in work_orders (technician_id and start_time are optional by design)", INTEGRITY),
    18: ("Null required fields in financials", INTEGRITY),
    19: ("Null required fields in feedback", INTEGRITY),
    20: ("Null required fields in customers / vehicles (mileage_km is optional by design)", INTEGRITY),
    21: ("Work orders where end_time is earlier than start_time", INTEGRITY),
    22: ("Work orders where end_time is earlier than check_in_time", INTEGRITY),
    23: ("Work orders where start_time is earlier than check_in_time", INTEGRITY),
    24: ("Work orders promised before check-in", INTEGRITY),
    25: ("Negative costs or revenue (financials, parts, technicians)", INTEGRITY),
    26: ("Part usage with zero or negative quantity", INTEGRITY),
    27: ("Negative or zero durations (estimated_hours <= 0, actual_hours < 0, parts_wait_hours < 0)", INTEGRITY),
    28: ("Customer ratings outside 1-5", INTEGRITY),
    29: ("Values outside allowed domains (status, billing_type, customer_type, region, skill_level)", INTEGRITY),
    30: ("Appointments scheduled outside the reporting period", INTEGRITY),
    31: ("Appointments booked after their scheduled date", INTEGRITY),
    32: ("Work orders checked in outside the reporting period", INTEGRITY),
    33: ("Work orders whose check-in date differs from the scheduled date by more than 7 days", INTEGRITY),
    34: ("Feedback dated before the work order finished", INTEGRITY),
    35: (
        "Vehicles purchased after the end of the reporting period, or before the customer registered "
        "(information only)",
        INFO,
    ),
    36: ("Model year earlier than model launch", INTEGRITY),
    37: ("Model year more than 1 year after purchase year", INTEGRITY),
    38: ("Implausible mileage (negative, or above 250 km per day since purchase)", INTEGRITY),
    39: ("Odometer reading lower than the same vehicle at its previous visit (information only)", INFO),
    40: ("Completed appointments without a work order", INTEGRITY),
    41: ("Work orders attached to a Cancelled / No-Show appointment", INTEGRITY),
    42: ("Cancelled appointments without a cancellation reason (information only)", INFO),
    43: (
        "Financial parts_cost differs from SUM(part_usage.quantity x parts.unit_cost) by more than INR 1 "
        "(reconciliation, information only)",
        INFO,
    ),
    44: ("Rework (No Charge) rows with non-zero revenue", INTEGRITY),
    45: ("Revenue above 10x job cost and INR 50,000 (possible decimal-shift remnants)", INTEGRITY),
    46: ("Work orders without an assigned technician (documented gap, excluded from technician KPIs)", INFO),
    47: ("Work orders without a recorded start_time (documented gap, excluded from wait KPI)", INFO),
    48: ("Vehicles with unknown mileage (set to NULL during cleaning)", INFO),
    49: ("Appointment slot outside shop hours (09:00-19:00) or not a valid time", INTEGRITY),
    50: ("Completed work orders without customer feedback (rating coverage gap)", INFO),
}
# ------------------------------------------------------------------------------------


def check_id(number: int) -> str:
    return f"SQL-DQ{number:02d}"


def _missing(*columns: str) -> Column:
    return any_of(*[F.col(c).isNull() for c in columns])


def row_conditions(cfg: Config) -> dict[str, dict[int, Column]]:
    """Row-level parts: table -> check number -> condition that marks a bad row."""
    c = F.col
    start, end = F.lit(cfg.period_start), F.lit(cfg.period_end)
    outside = schemas.violates_domain(cfg)
    launch = F.lit(False)
    for model, year in cfg.model_first_year.items():
        launch = launch | ((c("model") == model) & (c("model_year") < year))
    km_limit = F.greatest(F.datediff(end, c("purchase_date")), F.lit(1)) * cfg.max_km_per_day
    cost = c("labor_cost") + c("parts_cost")
    lo, hi = f"{cfg.open_hour:02d}:00", f"{cfg.close_hour:02d}:00"
    return {
        "appointments": {
            16: _missing(
                "vehicle_id", "center_id", "booking_date", "scheduled_date", "status", "requested_service_type"
            ),
            29: outside["appointments"],
            30: ~c("scheduled_date").between(start, end),
            31: c("booking_date") > c("scheduled_date"),
            42: (c("status") == "Cancelled") & c("cancellation_reason").isNull(),
            49: c("scheduled_slot").isNotNull() & ~c("scheduled_slot").between(lo, hi),
        },
        "work_orders": {
            17: _missing(
                "appointment_id", "service_type", "check_in_time", "end_time", "promised_ready_time",
                "estimated_hours", "actual_hours",
            ),
            21: c("end_time") < c("start_time"),
            22: c("end_time") < c("check_in_time"),
            23: c("start_time") < c("check_in_time"),
            24: c("promised_ready_time") < c("check_in_time"),
            27: any_of(c("estimated_hours") <= 0, c("actual_hours") < 0, c("parts_wait_hours") < 0),
            32: ~F.to_date("check_in_time").between(start, end),
            46: c("technician_id").isNull(),
            47: c("start_time").isNull(),
        },
        "financials": {
            18: _missing("billing_type", "estimated_cost", "labor_cost", "parts_cost", "revenue"),
            25: any_of(*[c(x) < 0 for x in ("estimated_cost", "labor_cost", "parts_cost", "revenue")]),
            29: outside["financials"],
            44: schemas.rework_with_revenue(),
            45: (c("revenue") > cfg.revenue_shift_ratio * cost) & (c("revenue") > cfg.revenue_shift_floor),
        },
        "feedback": {
            19: _missing("work_order_id", "rating", "feedback_category", "feedback_date"),
            28: ~c("rating").between(1, 5),
        },
        "customers": {
            20: _missing("customer_type", "region", "city", "registration_date"),
            29: outside["customers"],
        },
        "vehicles": {
            20: _missing("customer_id", "model", "model_year", "purchase_date"),
            36: launch,
            37: c("model_year") > F.year("purchase_date") + 1,
            38: (c("mileage_km") < 0) | (c("mileage_km") > km_limit),
            48: c("mileage_km").isNull(),
        },
        "technicians": {25: c("hourly_cost") < 0, 29: outside["technicians"]},
        "parts": {25: c("unit_cost") < 0},
        "part_usage": {26: c("quantity") <= 0},
    }


def _use(name: str, rows: str | None = None) -> Use:
    return Use(*name.split("."), rows)


_DONE, _OPEN = "status = 'Completed'", "status <> 'Completed'"
#: check number -> what it asks of the keys of a space.
KEY_CHECKS: dict[int, list[KeyCheck]] = {
    1: [repeated_key("appointment", _use("appointments.appointment_id"))],
    2: [repeated_key("job", _use("work_orders.work_order_id"))],
    3: [
        repeated_key("customer", _use("customers.customer_id")), repeated_key("vehicle", _use("vehicles.vehicle_id")),
        repeated_key("usage", _use("part_usage.usage_id")), repeated_key("feedback", _use("feedback.feedback_id")),
        repeated_key("job", _use("feedback.work_order_id")), repeated_key("job", _use("financials.work_order_id")),
    ],
    4: [repeated_key("appointment", _use("work_orders.appointment_id"))],
    5: [lost_key("customer", _use("vehicles.customer_id"), _use("customers.customer_id"))],
    6: [lost_key("vehicle", _use("appointments.vehicle_id"), _use("vehicles.vehicle_id"))],
    7: [lost_key("centre", _use("appointments.center_id"), _use("service_centers.center_id"))],
    8: [lost_key("centre", _use("technicians.center_id"), _use("service_centers.center_id"))],
    9: [lost_key("appointment", _use("work_orders.appointment_id"), _use("appointments.appointment_id"))],
    10: [lost_key("technician", _use("work_orders.technician_id"), _use("technicians.technician_id"), nulls=False)],
    11: [lost_key("job", _use("part_usage.work_order_id"), _use("work_orders.work_order_id"))],
    12: [lost_key("part", _use("part_usage.part_id"), _use("parts.part_id"))],
    13: [lost_key("job", _use("financials.work_order_id"), _use("work_orders.work_order_id"))],
    14: [lost_key("job", _use("feedback.work_order_id"), _use("work_orders.work_order_id"))],
    15: [lost_key("job", _use("work_orders.work_order_id"), _use("financials.work_order_id"))],
    40: [lost_key("appointment", _use("appointments.appointment_id", _DONE), _use("work_orders.appointment_id"))],
    41: [met_key("appointment", _use("work_orders.appointment_id"), _use("appointments.appointment_id", _OPEN))],
    50: [lost_key("job", _use("work_orders.work_order_id"), _use("feedback.work_order_id"))],
}


def usage_cost(t: Tables) -> DataFrame:
    """Catalogue value of the parts used, per job."""
    return (
        t["part_usage"]
        .join(t["parts"].select("part_id", "unit_cost"), "part_id")
        .groupBy("work_order_id")
        .agg(F.sum(F.col("quantity") * F.col("unit_cost")).cast("decimal(24,2)").alias("usage_cost"))
    )


def _bookings(t: Tables, *columns: str) -> DataFrame:
    return t["appointments"].select("appointment_id", *columns)


def _early_feedback(t: Tables, cfg: Config) -> DataFrame:
    fb = t["feedback"].select("work_order_id", "feedback_date")
    return fb.join(t["work_orders"].select("work_order_id", "end_time"), "work_order_id").where(
        F.col("feedback_date") < F.to_date("end_time")
    )


def _odd_purchase(t: Tables, cfg: Config) -> DataFrame:
    v = t["vehicles"].select("customer_id", "purchase_date")
    early = F.col("purchase_date") < F.date_sub("registration_date", 365)
    return v.join(t["customers"].select("customer_id", "registration_date"), "customer_id").where(
        (F.col("purchase_date") > F.lit(cfg.period_end)) | early
    )


def visit_checks(t: Tables, cfg: Config, numbers: set[int]) -> DataFrame:
    """(check_id, n) of checks 33 and 39, whichever are asked for, from one table of visits."""
    visits = (
        t["work_orders"]
        .select("work_order_id", "appointment_id", "check_in_time", "odometer_km")
        .join(_bookings(t, "vehicle_id", "scheduled_date"), "appointment_id")
    )
    conditions = {33: F.abs(F.datediff(F.to_date("check_in_time"), "scheduled_date")) > 7}
    if 39 in numbers:
        visits = neighbours(visits, ["vehicle_id"], "check_in_time", "work_order_id", {"prev_km": "odometer_km"}, {})
        conditions[39] = F.col("odometer_km") < F.col("prev_km")
    return counters(visits, {check_id(n): c for n, c in conditions.items() if n in numbers}, "check_id")


def _unreconciled(t: Tables, cfg: Config) -> DataFrame:
    billed = t["financials"].select("work_order_id", "parts_cost").join(
        usage_cost(t), "work_order_id", "left"
    )
    return billed.where(F.abs(F.col("parts_cost") - F.coalesce("usage_cost", F.lit(0))) > 1)


SPECIAL: dict[int, Callable[[Tables, Config], DataFrame]] = {
    34: _early_feedback,
    35: _odd_purchase,
    43: _unreconciled,
}


def run_checks(t: Tables, cfg: Config, numbers: Iterable[int] = CATALOGUE) -> DataFrame:
    """(check_id, check_name, check_type, issue_count, status) for the chosen checks.

    Row and key checks are compiled into one pass over each table and one grouping; five
    checks that compare columns of several tables are joins of their own.
    """
    wanted = set(numbers)
    by_row = {
        table: {check_id(n): cond for n, cond in conditions.items() if n in wanted}
        for table, conditions in row_conditions(cfg).items()
    }
    by_row = {table: conditions for table, conditions in by_row.items() if conditions}
    by_key = {check_id(n): checks for n, checks in KEY_CHECKS.items() if n in wanted}
    parts = [compiled_checks(t, by_row, by_key)] if by_row or by_key else []
    if wanted & {33, 39}:
        parts.append(visit_checks(t, cfg, wanted & {33, 39}))
    for n, found in SPECIAL.items():
        if n in wanted:
            parts.append(one_count(found(t, cfg), "check_id", check_id(n)))
    names = F.create_map(
        *[F.lit(x) for n in sorted(wanted) for x in (check_id(n), CATALOGUE[n][0])]
    )
    info = [check_id(n) for n in sorted(wanted) if CATALOGUE[n][1] == INFO]
    kind = F.when(F.col("check_id").isin(info), INFO) if info else F.lit(None).cast("string")
    total = union_all(parts).groupBy("check_id").agg(F.sum("n").alias("issue_count"))
    return (
        total.withColumn("check_name", F.element_at(names, F.col("check_id")))
        .withColumn("check_type", F.coalesce(kind, F.lit(INTEGRITY)))
        .withColumn(
            "status",
            F.when(F.col("issue_count") == 0, "PASS")
            .when(F.col("check_type") == INFO, "INFO")
            .otherwise("FAIL"),
        )
        .select("check_id", "check_name", "check_type", "issue_count", "status")
    )


def summary(t: Tables, cfg: Config) -> DataFrame:
    return run_checks(t, cfg).orderBy("check_id")


def agreement(t: Tables, cfg: Config) -> DataFrame:
    """Compare the checks run one by one with the summary; both differences must be empty."""
    singles = union_all([run_checks(t, cfg, [n]) for n in CATALOGUE]).select("check_id", "issue_count")
    both = run_checks(t, cfg).select("check_id", "issue_count")
    return disagreement(singles, both)


def disagreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row counts of the two one-sided differences and a verdict."""
    counts = one_count(left.exceptAll(right), "side", "only_left").unionByName(
        one_count(right.exceptAll(left), "side", "only_right")
    )
    return counts.groupBy().agg(
        F.sum(F.when(flag(F.col("side") == "only_left"), F.col("n"))).alias("only_left"),
        F.sum(F.when(flag(F.col("side") == "only_right"), F.col("n"))).alias("only_right"),
    ).withColumn("same", (F.col("only_left") + F.col("only_right")) == 0)
