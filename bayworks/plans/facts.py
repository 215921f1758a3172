"""Builders of the analytical tables: jobs, appointments, technician-months, calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bayworks.config import LEAD_BANDS, LEAD_EDGES, Config
from bayworks.functions.scalars import (
    age_years,
    band,
    elapsed_days,
    elapsed_hours,
    fixed,
    flag,
    ratio,
    weekday_name,
    year_month,
)
from bayworks.operators.history import neighbours, running_number
from bayworks.session import settle_table

Tables = dict[str, DataFrame]


# ---- calendar -----------------------------------------------------------------
def calendar_days(spark: SparkSession, cfg: Config) -> DataFrame:
    days = F.sequence(
        F.lit(cfg.period_start).cast("date"), F.lit(cfg.period_end).cast("date"), F.expr("interval 1 day")
    )
    return spark.range(1).select(F.explode(days).alias("date"))


def dim_date(spark: SparkSession, cfg: Config) -> DataFrame:
    """One row per calendar day of the reporting period."""
    return calendar_days(spark, cfg).select(
        "date",
        F.year("date").alias("year"),
        F.concat(F.lit("Q"), F.quarter("date")).alias("quarter"),
        F.month("date").alias("month_number"),
        F.date_format("date", "MMM").alias("month_name"),
        year_month("date").alias("year_month"),
        (F.weekday("date") + 1).alias("weekday_number"),
        weekday_name("date").alias("weekday_name"),
        (F.weekday("date") < cfg.open_weekdays).alias("is_working_day"),
    )


def month_calendar(spark: SparkSession, cfg: Config) -> DataFrame:
    """Working days per month; bounded by the length of the reporting period."""
    return (
        calendar_days(spark, cfg)
        .groupBy(year_month("date").alias("month"))
        .agg(
            F.count_if(F.weekday("date") < cfg.open_weekdays).cast("int").alias("working_days"),
            F.trunc(F.min("date"), "MM").alias("month_start"),
        )
    )


def month_array(cfg: Config) -> Column:
    """The period's months as a constant array of (month, month_start, working_days)."""
    rows = [
        F.struct(
            F.lit(m).alias("month"),
            F.to_date(F.lit(f"{m}-01")).alias("month_start"),
            F.lit(n).alias("working_days"),
        )
        for m, n in cfg.month_days.items()
    ]
    return F.array(*rows)


def working_days(spark: SparkSession, cfg: Config) -> DataFrame:
    return calendar_days(spark, cfg).agg(
        F.count_if(F.weekday("date") < cfg.open_weekdays).alias("working_days")
    )


# ---- jobs ---------------------------------------------------------------------
VISIT = {"customer_visit_number"}


def job_history(t: Tables, how: str = "left", want: set[str] | None = None) -> DataFrame:
    """Narrow history columns per job: previous finish, next check-in, visit number.

    ``want`` leaves out the visit number, or the two neighbours, where nothing else is asked for.
    Only keys and two time stamps travel through the history windows; the result joins
    back on the job key together with the other job-keyed tables. The narrow rows are stored
    once for both orders.
    """
    bookings, vehicles = t["appointments"], t["vehicles"]
    if how == "inner":  # the SQL views also require a known centre and a known customer
        bookings = bookings.join(t["service_centers"].select("center_id"), "center_id", "left_semi")
        vehicles = vehicles.join(t["customers"].select("customer_id"), "customer_id", "left_semi")
    owner = bookings.select("appointment_id", "vehicle_id").join(
        vehicles.select("vehicle_id", "customer_id"), "vehicle_id", how
    )
    rows = (
        t["work_orders"]
        .select("work_order_id", "appointment_id", "service_type", "check_in_time", "end_time")
        .join(owner, "appointment_id", how)
        .drop("appointment_id")
    )
    numbered, chained = want is None or bool(want & VISIT), want is None or bool(want - VISIT)
    if numbered and chained:
        rows = settle_table(rows)  # sorted twice
    if numbered:
        rows = running_number(rows, ["customer_id"], "check_in_time", "work_order_id", "customer_visit_number")
    if chained:
        rows = neighbours(
            rows,
            ["vehicle_id", "service_type"],
            "check_in_time",
            "work_order_id",
            previous={"previous_end": "end_time"},
            following={"next_check_in": "check_in_time"},
        )
    found = ["previous_end", "next_check_in"] * chained + ["customer_visit_number"] * numbered
    return rows.select("work_order_id", *found)


# What each optional join contributes; a consumer that names its columns skips the others.
HISTORY = {"days_since_same_service", "is_repeat_visit", "caused_repeat_visit", "customer_visit_number"}
BILLED = {
    "billing_type", "estimated_cost", "labor_cost", "parts_cost", "revenue", "total_cost", "profit",
    "cost_variance", "cost_variance_pct", "cost_overrun_flag",
}
RATED = {"rating", "feedback_category"}
CENTRE = {"center_name", "city", "region"}
STAFF = {"skill_level"}
OWNER = {"customer_id", "customer_type", "model", "variant", "vehicle_category", "vehicle_age_years"}
BOOKING = {"vehicle_id", "center_id", "booking_channel"} | CENTRE | OWNER


def job_columns(have: set[str], cfg: Config) -> dict[str, Column]:
    """Derived measures available from the joined columns. Hours keep two places and money
    stays decimal, so sums are exact."""
    money = "decimal(14,2)"
    late = F.when(
        F.col("end_time").isNotNull() & F.col("promised_ready_time").isNotNull(),
        F.greatest(elapsed_hours("promised_ready_time", "end_time"), F.lit(0.0)),
    )
    out = {
        "service_date": F.to_date("check_in_time"),
        "year": F.year("check_in_time"),
        "month": year_month("check_in_time"),
        "wait_hours": fixed(elapsed_hours("check_in_time", "start_time"), 2),
        "turnaround_hours": fixed(elapsed_hours("check_in_time", "end_time"), 2),
        "late_hours": fixed(late, 2),
        "on_time_flag": flag(F.col("end_time") <= F.col("promised_ready_time")),
        "duration_variance_hours": (F.col("actual_hours") - F.col("estimated_hours")).cast("decimal(8,2)"),
        "parts_delay_flag": flag(F.col("parts_wait_hours") > 0),
    }
    if "labor_cost" in have:
        total = F.col("labor_cost") + F.col("parts_cost")
        variance = total - F.col("estimated_cost")
        pct = fixed(F.when(F.col("estimated_cost") > 0, ratio(variance, "estimated_cost")), 4)
        out |= {
            "total_cost": total.cast(money),
            "profit": (F.col("revenue") - total).cast(money),
            "cost_variance": variance.cast(money),
            "cost_variance_pct": pct,
            "cost_overrun_flag": flag(pct > cfg.overrun_threshold),
        }
    if "previous_end" in have:
        since = elapsed_days("previous_end", "check_in_time")
        until = elapsed_days("end_time", "next_check_in")
        out |= {
            "days_since_same_service": since,
            "is_repeat_visit": flag(since <= cfg.repeat_window_days),
            "caused_repeat_visit": flag(until <= cfg.repeat_window_days),
        }
    if "purchase_date" in have:
        age = age_years("purchase_date", F.to_date("check_in_time"))
        out["vehicle_age_years"] = fixed(age, 2)
    return out


def fact_service(t: Tables, cfg: Config, want: set[str] | None = None) -> DataFrame:
    """One row per job, dimensions attached and measures derived (left joins).

    ``want`` limits the result to some columns. Joins on unique keys that feed none of them,
    and the history windows, are then left out; the optimizer cannot prove that itself.
    """

    def needs(group: set[str]) -> bool:
        return want is None or bool(want & group)

    out = t["work_orders"]
    if needs(BILLED):
        out = out.join(t["financials"], "work_order_id", "left")
    if needs(RATED):
        rated = t["feedback"].select("work_order_id", "rating", "feedback_category")
        out = out.join(rated, "work_order_id", "left")
    if needs(HISTORY):
        out = out.join(job_history(t, want=want and want & HISTORY), "work_order_id", "left")
    if needs(BOOKING):
        booked = t["appointments"].select("appointment_id", "vehicle_id", "center_id", "booking_channel")
        out = out.join(booked, "appointment_id", "left")
    if needs(OWNER):
        vehicle = t["vehicles"].select(
            "vehicle_id", "customer_id", "model", "variant", "vehicle_category", "purchase_date"
        )
        if needs({"customer_type"}):
            vehicle = vehicle.join(t["customers"].select("customer_id", "customer_type"), "customer_id", "left")
        out = out.join(vehicle, "vehicle_id", "left")
    if needs(CENTRE):
        centre = t["service_centers"].select("center_id", "center_name", "city", "region")
        out = out.join(centre, "center_id", "left")
    if needs(STAFF):
        out = out.join(t["technicians"].select("technician_id", "skill_level"), "technician_id", "left")
    hidden = {"purchase_date", "previous_end", "next_check_in"}
    have = set(out.columns)
    columns = {c: F.col(c) for c in out.columns if c not in hidden} | job_columns(have, cfg)
    return out.select(*[c.alias(n) for n, c in columns.items() if want is None or n in want])


# ---- appointments -------------------------------------------------------------
def lead_band(lead: str):
    """Lead-time band; negative or absurd (> 999 days) leads have none."""
    labels = F.when(F.col(lead).between(0, 999), band(lead, LEAD_EDGES, LEAD_BANDS))
    return F.coalesce(labels, F.lit("nan"))


def fact_appointments(t: Tables) -> DataFrame:
    """One row per appointment with owner, centre, lead time and outcome flags."""
    owner = (
        t["vehicles"]
        .select("vehicle_id", "customer_id", "model", "vehicle_category")
        .join(t["customers"].select("customer_id", "customer_type"), "customer_id", "left")
    )
    return (
        t["appointments"]
        .join(owner, "vehicle_id", "left")
        .join(t["service_centers"].select("center_id", "center_name", "region"), "center_id", "left")
        .withColumn("lead_days", F.datediff("scheduled_date", "booking_date"))
        .select(
            "*",
            lead_band("lead_days").alias("lead_time_band"),
            weekday_name("scheduled_date").alias("weekday"),
            year_month("scheduled_date").alias("month"),
            flag(F.col("status") == "Cancelled").alias("is_cancelled"),
            flag(F.col("status") == "No-Show").alias("is_no_show"),
            flag(F.col("status") == "Completed").alias("is_completed"),
        )
    )


# ---- technician-months --------------------------------------------------------
def fact_technician_month(t: Tables, fact: DataFrame, cfg: Config) -> DataFrame:
    """Dense technician x month grid; idle months stay with zero jobs.

    The months are a constant of the reporting period, exploded inside each technician row,
    so no join builds the grid.
    """
    grid = t["technicians"].select(
        "technician_id", "center_id", "skill_level", F.explode(month_array(cfg)).alias("m")
    ).select("technician_id", "center_id", "skill_level", "m.month", "m.working_days")
    used = (
        fact.where(F.col("technician_id").isNotNull())
        .groupBy("technician_id", "month")
        .agg(
            F.count(F.lit(1)).alias("jobs"),
            F.sum("actual_hours").alias("service_hours"),
            ratio(F.sum(F.col("qc_passed_first_time").cast("int")), F.count("qc_passed_first_time")).alias(
                "qc_first_pass"
            ),
            F.count_if("caused_repeat_visit").alias("comebacks_caused"),
        )
    )
    hours = F.coalesce(F.col("service_hours"), F.lit(0)).cast("decimal(14,2)")
    available = (F.col("working_days") * F.lit(cfg.productive_hours)).cast("decimal(10,1)")
    return grid.join(used, ["technician_id", "month"], "left").select(
        "technician_id",
        "center_id",
        "skill_level",
        "month",
        "working_days",
        F.coalesce("jobs", F.lit(0)).alias("jobs"),
        hours.alias("service_hours"),
        "qc_first_pass",
        F.coalesce("comebacks_caused", F.lit(0)).alias("comebacks_caused"),
        available.alias("available_hours"),
        fixed(ratio(hours, available), 4).alias("utilisation"),
    )


def with_centre(tech_month: DataFrame, centers: DataFrame) -> DataFrame:
    """Attach centre name and region to technician-months."""
    return tech_month.join(centers.select("center_id", "center_name", "region"), "center_id", "left")


def build_facts(t: Tables, cfg: Config) -> Tables:
    fact = fact_service(t, cfg)
    return {
        **t,
        "fact_service": fact,
        "fact_appointments": fact_appointments(t),
        "fact_technician_month": fact_technician_month(t, fact, cfg),
        "dim_date": dim_date(fact.sparkSession, cfg),
    }
