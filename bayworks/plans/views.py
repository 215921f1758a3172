"""The ten reusable views: two enriched row-level views and eight aggregates."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bayworks.config import Config
from bayworks.functions.scalars import (
    elapsed_days,
    elapsed_hours,
    fixed,
    flag,
    iso_weekday,
    mean,
    ratio,
    rounded_to,
    share,
    weekday_name,
    year_month,
)
from bayworks.plans.facts import VISIT, job_history, working_days

Tables = dict[str, DataFrame]
R = rounded_to


def period_calendar(spark: SparkSession, cfg: Config) -> DataFrame:
    return working_days(spark, cfg).select(
        F.lit(cfg.period_start).cast("date").alias("period_start"),
        F.lit(cfg.period_end).cast("date").alias("period_end"),
        F.col("working_days").cast("int").alias("working_days"),
        F.lit(cfg.productive_hours).alias("productive_hours_per_day"),
    )


# What each optional join contributes; a consumer that names its columns skips the others.
HISTORY = {
    "prev_same_service_end", "next_same_service_check_in", "days_since_same_service", "is_comeback",
    "caused_comeback", "customer_visit_number",
}
MONEY = {
    "billing_type", "estimated_cost", "labor_cost", "parts_cost", "revenue", "total_cost", "profit",
    "cost_variance", "cost_variance_pct", "cost_overrun_flag",
}
RATING = {"rating", "feedback_category"}
STAFF = {"skill_level", "years_experience"}


def work_order_enriched(t: Tables, cfg: Config, want: set[str] | None = None) -> DataFrame:
    """One row per job; booking, vehicle, owner and centre are required (inner joins).

    ``want`` limits the result to some columns. Left joins on unique keys that feed none of
    them, and the history windows, are then left out; the optimizer cannot prove that itself.
    """

    def needs(group: set[str]) -> bool:
        return want is None or bool(want & group)

    owner = (
        t["vehicles"]
        .select(
            "vehicle_id", "customer_id", "model", "variant", "vehicle_category", "model_year", "purchase_date"
        )
        .join(
            t["customers"].select("customer_id", "customer_type", F.col("region").alias("customer_region")),
            "customer_id",
        )
    )
    booking = t["appointments"].select(
        "appointment_id", "vehicle_id", "center_id", "booking_channel", "scheduled_date"
    )
    joined = t["work_orders"]
    if needs(MONEY):
        joined = joined.join(t["financials"], "work_order_id", "left")
    if needs(RATING):
        rated = t["feedback"].select("work_order_id", "rating", "feedback_category")
        joined = joined.join(rated, "work_order_id", "left")
    if needs(HISTORY):
        joined = joined.join(job_history(t, "inner", want and want & HISTORY), "work_order_id")
    joined = (
        joined.join(booking, "appointment_id")
        .join(owner, "vehicle_id")
        .join(t["service_centers"].select("center_id", "center_name", "city", "region"), "center_id")
    )
    if needs(STAFF):
        staff = t["technicians"].select("technician_id", "skill_level", "years_experience")
        joined = joined.join(staff, "technician_id", "left")
    cost = F.col("labor_cost") + F.col("parts_cost")
    pct = R(ratio(cost - F.col("estimated_cost"), "estimated_cost"), 4)
    late = F.when(
        F.col("end_time").isNotNull() & F.col("promised_ready_time").isNotNull(),
        F.greatest(elapsed_hours("promised_ready_time", "end_time"), F.lit(0.0)),
    )
    since = elapsed_days("previous_end", "check_in_time")
    until = elapsed_days("end_time", "next_check_in")
    money = "decimal(14,2)"
    columns = {c: F.col(c) for c in joined.columns if c != "scheduled_date"}
    columns |= {
        "service_date": F.to_date("check_in_time"),
        "month_start": F.trunc("check_in_time", "MM"),
        "year_month": year_month("check_in_time"),
        "service_year": F.year("check_in_time"),
        "service_month": F.month("check_in_time"),
        "iso_weekday": iso_weekday("check_in_time"),
        "weekday_name": weekday_name("check_in_time"),
        "wait_hours": fixed(elapsed_hours("check_in_time", "start_time"), 2),
        "turnaround_hours": fixed(elapsed_hours("check_in_time", "end_time"), 2),
        "late_hours": fixed(late, 2),
        "on_time_flag": F.col("end_time") <= F.col("promised_ready_time"),
        "duration_variance_hours": (F.col("actual_hours") - F.col("estimated_hours")).cast("decimal(8,2)"),
        "parts_delay_flag": F.col("parts_wait_hours") > 0,
    }
    if needs(MONEY):
        columns |= {
            "total_cost": cost.cast(money),
            "profit": (F.col("revenue") - cost).cast(money),
            "cost_variance": (cost - F.col("estimated_cost")).cast(money),
            "cost_variance_pct": pct.cast("decimal(18,4)"),
            "cost_overrun_flag": flag(pct > cfg.overrun_threshold),
        }
    if needs(HISTORY - VISIT):
        del columns["previous_end"], columns["next_check_in"]
        columns |= {
            "prev_same_service_end": F.col("previous_end"),
            "next_same_service_check_in": F.col("next_check_in"),
            "days_since_same_service": since,
            "is_comeback": flag(since <= cfg.repeat_window_days),
            "caused_comeback": flag(until <= cfg.repeat_window_days),
        }
    return joined.select(*[c.alias(name) for name, c in columns.items() if want is None or name in want])


def sql_lead_band(lead: str, numbered: bool = False):
    """Lead bands of the SQL views: negative leads fall in the second band."""
    d, n = F.col(lead), (lambda i: f"{i}. " if numbered else "")
    return (
        F.when(d == 0, n(1) + "Same day")
        .when(d <= 3, n(2) + "1-3 days")
        .when(d <= 7, n(3) + "4-7 days")
        .when(d <= 14, n(4) + "8-14 days")
        .otherwise(n(5) + "15+ days")
    )


def appointment_enriched(t: Tables) -> DataFrame:
    owner = (
        t["vehicles"]
        .select("vehicle_id", "customer_id", "model")
        .join(t["customers"].select("customer_id", "customer_type"), "customer_id")
    )
    return (
        t["appointments"]
        .join(t["service_centers"].select("center_id", "center_name", "city", "region"), "center_id")
        .join(owner, "vehicle_id")
        .withColumn("lead_days", F.datediff("scheduled_date", "booking_date"))
        .select(
            "appointment_id", "vehicle_id", "center_id", "center_name", "city", "region", "customer_id",
            "model", "customer_type", "booking_date", "scheduled_date", "scheduled_slot",
            "booking_channel", "requested_service_type", "status", "cancellation_reason", "lead_days",
            sql_lead_band("lead_days").alias("lead_time_band"),
            year_month("scheduled_date").alias("year_month"),
            F.trunc("scheduled_date", "MM").alias("month_start"),
            iso_weekday("scheduled_date").alias("iso_weekday"),
            weekday_name("scheduled_date").alias("weekday_name"),
            (F.col("status") == "Cancelled").alias("is_cancelled"),
            (F.col("status") == "No-Show").alias("is_no_show"),
            (F.col("status") == "Completed").alias("is_completed"),
        )
    )


def growth(c: str, over) -> F.Column:
    return ratio(c, F.lag(c).over(over)) - 1


MONTHLY_INPUT = {
    "month_start", "year_month", "service_year", "service_month", "revenue", "total_cost", "profit",
    "on_time_flag", "turnaround_hours", "rating",
}


def monthly_financials(enriched: DataFrame) -> DataFrame:
    """Month trend; the growth window sees one row per month."""
    m = enriched.groupBy("month_start", "year_month", "service_year", "service_month").agg(
        F.count(F.lit(1)).alias("work_orders"),
        F.sum("revenue").alias("revenue"),
        F.sum("total_cost").alias("total_cost"),
        F.sum("profit").alias("profit"),
        share("on_time_flag").alias("on_time_rate"),
        mean("turnaround_hours").alias("avg_turnaround_hours"),
        mean("rating").alias("avg_rating"),
    )
    w = Window.orderBy(F.col("month_start").asc_nulls_last())
    return m.select(
        "*",
        R(ratio("profit", "revenue"), 4).alias("profit_margin"),
        R(ratio("total_cost", "work_orders"), 2).alias("avg_service_cost"),
        R(growth("revenue", w), 4).alias("revenue_mom_growth"),
        R(growth("profit", w), 4).alias("profit_mom_growth"),
    )


# Columns that the summaries below read from the enriched jobs.
JOB_INPUT = set(
    "revenue total_cost profit on_time_flag turnaround_hours wait_hours cost_variance cost_overrun_flag "
    "duration_variance_hours parts_delay_flag qc_passed_first_time caused_comeback rating".split()
)
CENTRE_INPUT = JOB_INPUT | {"center_id"}
SERVICE_INPUT = JOB_INPUT | {"service_type"}
VISIT_INPUT = {"customer_id", "customer_type", "customer_region"}
CUSTOMER_INPUT = VISIT_INPUT | {"vehicle_id", "service_date", "revenue", "rating", "is_comeback"}
HOURS_INPUT = {"technician_id", "actual_hours"}
TECHNICIAN_INPUT = HOURS_INPUT | {
    "on_time_flag", "qc_passed_first_time", "caused_comeback", "duration_variance_hours", "rating",
}
Jobs = Callable[[set[str]], DataFrame]


def technician_utilisation(t: Tables, enriched: DataFrame, cfg: Config) -> DataFrame:
    """Whole-period load per technician; idle technicians stay with zero jobs.

    Jobs are aggregated per technician before the join, so a hot technician never
    reaches the join as raw rows.
    """
    used = (
        enriched.where(F.col("technician_id").isNotNull())
        .groupBy("technician_id")
        .agg(
            F.count(F.lit(1)).alias("jobs"),
            F.sum("actual_hours").alias("hours"),
            R(share("on_time_flag"), 4).alias("on_time_rate"),
            R(share("qc_passed_first_time"), 4).alias("qc_first_pass_rate"),
            F.count_if("caused_comeback").alias("comebacks_caused"),
            R(share("caused_comeback"), 4).alias("comeback_rate"),
            R(mean("duration_variance_hours"), 3).alias("avg_duration_variance_hours"),
            R(mean("rating"), 3).alias("avg_rating"),
        )
    )
    hours = F.coalesce("hours", F.lit(0)).cast("decimal(18,2)")
    available = F.lit(cfg.working_days * cfg.productive_hours).cast("decimal(18,1)")
    return (
        t["technicians"]
        .join(t["service_centers"].select("center_id", "center_name"), "center_id")
        .join(used, "technician_id", "left")
        .select(
            "technician_id", "center_id", "center_name", "skill_level", "years_experience",
            F.coalesce("jobs", F.lit(0)).alias("jobs"),
            hours.alias("service_hours"),
            F.lit(cfg.working_days).alias("working_days"),
            available.alias("available_hours"),
            R(ratio(hours, available), 4).alias("utilisation"),
            "on_time_rate", "qc_first_pass_rate",
            F.coalesce("comebacks_caused", F.lit(0)).alias("comebacks_caused"),
            "comeback_rate", "avg_duration_variance_hours", "avg_rating",
        )
    )


def center_performance(t: Tables, jobs_with: Jobs, appts: DataFrame, cfg: Config) -> DataFrame:
    """Centre scorecard from three pre-aggregated inputs, each with the columns it needs."""
    jobs = jobs_with(CENTRE_INPUT).groupBy("center_id").agg(
        F.count(F.lit(1)).alias("work_orders"),
        F.sum("revenue").alias("_rev"),
        F.sum("total_cost").alias("_cost"),
        F.sum("profit").alias("_profit"),
        R(mean("turnaround_hours"), 2).alias("avg_turnaround_hours"),
        R(F.median("turnaround_hours"), 2).alias("median_turnaround_hours"),
        R(share("on_time_flag"), 4).alias("on_time_rate"),
        R(mean("wait_hours"), 2).alias("avg_wait_hours"),
        R(mean("duration_variance_hours"), 3).alias("avg_duration_variance_hours"),
        R(share("cost_overrun_flag"), 4).alias("cost_overrun_rate"),
        R(share("parts_delay_flag"), 4).alias("parts_delay_rate"),
        R(share("qc_passed_first_time"), 4).alias("qc_first_pass_rate"),
        R(share("caused_comeback"), 4).alias("comeback_rate"),
        R(mean("rating"), 3).alias("avg_rating"),
        R(share(F.col("rating") >= cfg.csat_threshold), 4).alias("csat_rate"),
    )
    demand = appts.groupBy("center_id").agg(
        F.count(F.lit(1)).alias("appointments"),
        R(share("is_cancelled"), 4).alias("cancellation_rate"),
        R(share("is_no_show"), 4).alias("no_show_rate"),
    )
    used = jobs_with(HOURS_INPUT).where("technician_id is not null").groupBy("technician_id").agg(F.sum("actual_hours").alias("_h"))
    heads = F.count(F.lit(1))
    capacity = t["technicians"].select("technician_id", "center_id").join(used, "technician_id", "left").groupBy("center_id").agg(
        heads.alias("technicians"),
        R(ratio(F.coalesce(F.sum("_h"), F.lit(0)), heads * (cfg.working_days * cfg.productive_hours)), 4).alias("utilisation"),
    )
    return (
        t["service_centers"]
        .join(jobs, "center_id", "left")
        .join(demand, "center_id", "left")
        .join(capacity, "center_id", "left")
        .select(
            "center_id", "center_name", "city", "region", "service_bays", "daily_job_capacity",
            "technicians", "work_orders", "appointments",
            F.col("_rev").alias("revenue"),
            F.col("_cost").alias("total_cost"),
            F.col("_profit").alias("profit"),
            R(ratio("_profit", "_rev"), 4).alias("profit_margin"),
            R(ratio("_cost", "work_orders"), 2).alias("avg_service_cost"),
            "avg_turnaround_hours", "median_turnaround_hours", "on_time_rate", "avg_wait_hours",
            "avg_duration_variance_hours", "cost_overrun_rate", "parts_delay_rate", "qc_first_pass_rate",
            "comeback_rate", "avg_rating", "csat_rate", "cancellation_rate", "no_show_rate", "utilisation",
        )
    )


def service_type_performance(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("service_type").agg(
        F.count(F.lit(1)).alias("work_orders"),
        F.sum("revenue").alias("revenue"),
        F.sum("total_cost").alias("total_cost"),
        F.sum("profit").alias("profit"),
        R(ratio(F.sum("profit"), F.sum("revenue")), 4).alias("profit_margin"),
        R(ratio(F.sum("total_cost"), F.count(F.lit(1))), 2).alias("avg_service_cost"),
        R(mean("turnaround_hours"), 2).alias("avg_turnaround_hours"),
        R(share("on_time_flag"), 4).alias("on_time_rate"),
        R(mean("duration_variance_hours"), 3).alias("avg_duration_variance_hours"),
        R(mean("cost_variance"), 2).alias("avg_cost_variance"),
        R(share("cost_overrun_flag"), 4).alias("cost_overrun_rate"),
        R(share("parts_delay_flag"), 4).alias("parts_delay_rate"),
        R(share("qc_passed_first_time"), 4).alias("qc_first_pass_rate"),
        R(share("caused_comeback"), 4).alias("comeback_rate"),
        R(mean("rating"), 3).alias("avg_rating"),
    )


def appointment_funnel(appts: DataFrame) -> DataFrame:
    return appts.groupBy("month_start", "year_month", "center_id", "center_name").agg(
        F.count(F.lit(1)).alias("appointments"),
        F.count_if("is_completed").alias("completed"),
        F.count_if("is_cancelled").alias("cancelled"),
        F.count_if("is_no_show").alias("no_shows"),
        R(share("is_completed"), 4).alias("completion_rate"),
        R(share("is_cancelled"), 4).alias("cancellation_rate"),
        R(share("is_no_show"), 4).alias("no_show_rate"),
        R(mean("lead_days"), 2).alias("avg_lead_days"),
    )


def customer_repeat(enriched: DataFrame, cfg: Config) -> DataFrame:
    """One row per customer with at least one completed job."""
    return enriched.groupBy("customer_id", "customer_type", "customer_region").agg(
        F.count(F.lit(1)).alias("completed_visits"),
        F.countDistinct("vehicle_id").alias("vehicles_serviced"),
        F.min("service_date").alias("first_visit_date"),
        F.max("service_date").alias("last_visit_date"),
        F.datediff(F.max("service_date"), F.min("service_date")).alias("tenure_days"),
        F.sum("revenue").alias("total_revenue"),
        R(mean("rating"), 3).alias("avg_rating"),
        F.count_if("is_comeback").alias("comeback_visits"),
        (F.count(F.lit(1)) >= cfg.repeat_min_orders).alias("is_repeat_customer"),
    )


def kpi_summary(t: Tables, jobs_with: Jobs, appts: DataFrame, cfg: Config) -> DataFrame:
    """Single-row headline: four one-row aggregates side by side, each from lean jobs."""
    jobs = jobs_with(JOB_INPUT).agg(
        F.count(F.lit(1)).alias("work_orders"),
        F.sum("revenue").alias("total_revenue"),
        F.sum("total_cost").alias("total_cost"),
        F.sum("profit").alias("profit"),
        R(ratio(F.sum("profit"), F.sum("revenue")), 4).alias("profit_margin"),
        R(ratio(F.sum("total_cost"), F.count(F.lit(1))), 2).alias("avg_service_cost"),
        R(share("on_time_flag"), 4).alias("on_time_rate"),
        R(mean("turnaround_hours"), 3).alias("avg_turnaround_hours"),
        R(F.median("turnaround_hours"), 3).alias("median_turnaround_hours"),
        R(mean("wait_hours"), 3).alias("avg_wait_hours"),
        F.sum("cost_variance").alias("total_cost_variance"),
        R(mean("cost_variance"), 2).alias("avg_cost_variance"),
        R(share("cost_overrun_flag"), 4).alias("cost_overrun_rate"),
        R(mean("duration_variance_hours"), 3).alias("avg_duration_variance_hours"),
        R(share("parts_delay_flag"), 4).alias("parts_delay_rate"),
        R(share("qc_passed_first_time"), 4).alias("qc_first_pass_rate"),
        R(share("caused_comeback"), 4).alias("comeback_rate"),
        R(mean("rating"), 3).alias("avg_rating"),
        R(share(F.col("rating") >= cfg.csat_threshold), 4).alias("csat_rate"),
        F.count("rating").alias("rated_work_orders"),
    )
    demand = appts.agg(
        F.count(F.lit(1)).alias("appointments"),
        F.count_if("is_cancelled").alias("cancelled_appointments"),
        F.count_if("is_no_show").alias("no_show_appointments"),
        R(ratio(F.count_if("is_cancelled"), F.count(F.lit(1))), 4).alias("cancellation_rate"),
        R(ratio(F.count_if("is_no_show"), F.count(F.lit(1))), 4).alias("no_show_rate"),
    )
    # Only the visit count is needed per customer, not the whole customer view.
    visits = jobs_with(VISIT_INPUT).groupBy("customer_id", "customer_type", "customer_region").agg(
        F.count(F.lit(1)).alias("n")
    )
    repeat = F.count_if(F.col("n") >= cfg.repeat_min_orders)
    repeats = visits.agg(
        F.count(F.lit(1)).alias("customers_served"),
        repeat.alias("repeat_customers"),
        R(ratio(repeat, F.count(F.lit(1))), 4).alias("repeat_visit_rate"),
    )
    # Technician hours need only each job's technician and centre of that technician.
    staff = t["technicians"].join(t["service_centers"].select("center_id"), "center_id", "left_semi")
    headcount = staff.agg(F.count(F.lit(1)).alias("_heads"))
    hours = (
        jobs_with(HOURS_INPUT).where(F.col("technician_id").isNotNull())
        .groupBy("technician_id")
        .agg(F.sum("actual_hours").alias("h"))
        .join(staff.select("technician_id"), "technician_id", "left_semi")
        .agg(F.sum("h").alias("_hours"))
    )
    one_row = jobs
    for side in (demand, repeats, headcount, hours):
        one_row = one_row.crossJoin(F.broadcast(side))
    per_head = F.lit(cfg.working_days * cfg.productive_hours)
    usage = R(ratio("_hours", F.col("_heads") * per_head), 4)
    return one_row.withColumn("technician_utilisation", usage).drop("_heads", "_hours")


VIEWS = {
    "vw_period_calendar": lambda spark, t, cfg: period_calendar(spark, cfg),
    "vw_work_order_enriched": lambda spark, t, cfg: work_order_enriched(t, cfg),
    "vw_appointment_enriched": lambda spark, t, cfg: appointment_enriched(t),
    "vw_monthly_financials": lambda spark, t, cfg: monthly_financials(
        work_order_enriched(t, cfg, MONTHLY_INPUT)
    ),
    "vw_technician_utilisation": lambda spark, t, cfg: technician_utilisation(
        t, work_order_enriched(t, cfg, TECHNICIAN_INPUT), cfg
    ),
    "vw_center_performance": lambda spark, t, cfg: center_performance(
        t, partial(work_order_enriched, t, cfg), appointment_enriched(t), cfg
    ),
    "vw_service_type_performance": lambda spark, t, cfg: service_type_performance(work_order_enriched(t, cfg, SERVICE_INPUT)),
    "vw_appointment_funnel": lambda spark, t, cfg: appointment_funnel(appointment_enriched(t)),
    "vw_customer_repeat": lambda spark, t, cfg: customer_repeat(work_order_enriched(t, cfg, CUSTOMER_INPUT), cfg),
    "vw_kpi_summary": lambda spark, t, cfg: kpi_summary(
        t, partial(work_order_enriched, t, cfg), appointment_enriched(t), cfg
    ),
}


def view(spark: SparkSession, t: Tables, cfg: Config, name: str) -> DataFrame:
    """One view by name, as a lazy DataFrame."""
    return VIEWS[name](spark, t, cfg)


def register_views(spark: SparkSession, t: Tables, cfg: Config) -> list[str]:
    """Create a temporary view per table and per view, for use from SQL."""
    named = {**t, **{name: view(spark, t, cfg, name) for name in VIEWS}}
    for name, df in named.items():
        df.createOrReplaceTempView(name)
    return sorted(named)
