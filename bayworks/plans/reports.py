"""The 21 business reports. Each takes the tables and returns one ordered DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bayworks.config import Config
from bayworks.functions.scalars import (
    MICROS_PER_HOUR,
    flag,
    mean,
    percentage,
    position_in,
    ratio,
    rounded_to,
    share,
    weekday_name_of_number,
)
from bayworks.operators.ranks import exact_percentiles, ntile, row_positions, with_rank
from bayworks.plans import views as V
from bayworks.plans.facts import month_array

Tables = dict[str, DataFrame]
R = rounded_to


def total(c) -> Column:
    """Sum over all rows of an already aggregated, bounded result."""
    return F.sum(c).over(Window.partitionBy())


def jobs(t: Tables, cfg: Config, columns: str) -> DataFrame:
    """Enriched jobs reduced to the named columns and the joins those need."""
    return V.work_order_enriched(t, cfg, set(columns.split()))


def rank_by(c, descending: bool = True):
    order = F.col(c) if isinstance(c, str) else c
    return F.rank().over(
        Window.orderBy(order.desc_nulls_last() if descending else order.asc_nulls_last())
    )


def running(c: str, *order) -> F.Column:
    """Running sum in which peers share the value (the SQL default frame)."""
    return F.sum(c).over(Window.orderBy(*order).rangeBetween(Window.unboundedPreceding, 0))


def q01(t: Tables, cfg: Config) -> DataFrame:
    """Headline scorecard in long form."""
    s = V.kpi_summary(t, partial(V.work_order_enriched, t, cfg), V.appointment_enriched(t), cfg)
    hundred = {
        "profit_margin", "on_time_rate", "cost_overrun_rate", "cancellation_rate", "no_show_rate",
        "technician_utilisation", "csat_rate", "repeat_visit_rate", "comeback_rate",
        "parts_delay_rate", "qc_first_pass_rate",
    }
    # fixed values: KPI number, label, source column, unit
    lines = [
        (1, "Total revenue", "total_revenue", "INR"),
        (2, "Total cost (labour + parts)", "total_cost", "INR"),
        (3, "Profit", "profit", "INR"),
        (3, "Profit margin", "profit_margin", "%"),
        (4, "Average service cost", "avg_service_cost", "INR / job"),
        (5, "On-time completion", "on_time_rate", "%"),
        (6, "Average turnaround", "avg_turnaround_hours", "hours"),
        (6, "Median turnaround", "median_turnaround_hours", "hours"),
        (7, "Total cost variance (actual - est.)", "total_cost_variance", "INR"),
        (7, "Average cost variance", "avg_cost_variance", "INR / job"),
        (7, "Cost overrun rate (> 10% over est.)", "cost_overrun_rate", "%"),
        (8, "Cancellation rate", "cancellation_rate", "%"),
        (8, "No-show rate", "no_show_rate", "%"),
        (9, "Technician utilisation", "technician_utilisation", "%"),
        (10, "Average customer rating", "avg_rating", "1-5"),
        (10, "CSAT (rating >= 4)", "csat_rate", "%"),
        (11, "Repeat visit rate (customers)", "repeat_visit_rate", "%"),
        (12, "Comeback (rework) rate", "comeback_rate", "%"),
        (13, "Duration variance (actual - est.)", "avg_duration_variance_hours", "hours / job"),
        (14, "Parts delay rate", "parts_delay_rate", "%"),
        (15, "First-time QC pass rate", "qc_first_pass_rate", "%"),
        (16, "Average wait before work starts", "avg_wait_hours", "hours"),
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(no).alias("kpi_no"),
                F.lit(label).alias("kpi"),
                (F.col(c).cast("double") * (100.0 if c in hundred else 1.0)).alias("value"),
                F.lit(unit).alias("unit"),
            )
            for no, label, c, unit in lines
        ]
    )
    return s.select(F.inline(rows)).orderBy("kpi_no", "kpi")


def q02(t: Tables, cfg: Config) -> DataFrame:
    """Monthly money with growth and running revenue."""
    m = jobs(t, cfg, "month_start revenue total_cost profit").groupBy("month_start").agg(
        F.count(F.lit(1)).alias("work_orders"),
        F.sum("revenue").alias("revenue"),
        F.sum("total_cost").alias("total_cost"),
        F.sum("profit").alias("profit"),
    )
    w = Window.orderBy("month_start")
    return m.select(
        F.date_format("month_start", "yyyy-MM").alias("year_month"),
        "work_orders", "revenue", "total_cost", "profit",
        percentage(ratio("profit", "revenue")).alias("profit_margin_pct"),
        percentage(V.growth("revenue", w)).alias("revenue_mom_growth_pct"),
        percentage(V.growth("total_cost", w)).alias("cost_mom_growth_pct"),
        percentage(V.growth("profit", w)).alias("profit_mom_growth_pct"),
        running("revenue", "month_start").alias("cumulative_revenue"),
    ).orderBy("year_month")


def q03(t: Tables, cfg: Config) -> DataFrame:
    """Turnaround by centre. Elapsed time is a whole number of microseconds until the end."""
    gap = F.unix_micros("end_time") - F.unix_micros("check_in_time")
    jobs = t["work_orders"].select(
        "appointment_id",
        gap.alias("gap"),
        flag(F.to_date("end_time") == F.to_date("check_in_time")).alias("same_day"),
    )
    hour = F.lit(float(MICROS_PER_HOUR))
    named = jobs.join(
        t["appointments"].select("appointment_id", "center_id"), "appointment_id"
    ).join(t["service_centers"].select("center_id", "center_name"), "center_id")
    by_centre = named.groupBy("center_name").agg(
        F.count(F.lit(1)).alias("work_orders"), mean("gap").alias("_avg"), share("same_day").alias("_same")
    )
    # microsecond gaps have no bounded domain, so the percentiles come from the ranked histogram
    points = exact_percentiles(named, ["center_name"], "gap", {"_p50": 0.5, "_p90": 0.9})
    return by_centre.join(points, "center_name", "left").select(
        "center_name", "work_orders",
        R(F.col("_avg") / hour, 2).alias("avg_turnaround_hours"),
        R(F.col("_p50") / hour, 2).alias("median_turnaround_hours"),
        R(F.col("_p90") / hour, 2).alias("p90_turnaround_hours"),
        percentage(F.col("_same"), 1).alias("same_day_return_pct"),
        rank_by("_avg", descending=False).alias("speed_rank"),
    ).orderBy("speed_rank", "center_name")


def q04(t: Tables, cfg: Config) -> DataFrame:
    """On-time rate per centre plus a network row."""
    late = ~F.col("on_time_flag")
    cut = (
        jobs(t, cfg, "center_name on_time_flag late_hours parts_delay_flag")
        .rollup("center_name")
        .agg(
            F.grouping("center_name").alias("_total"),
            F.count(F.lit(1)).alias("work_orders"),
            F.count_if("on_time_flag").alias("on_time_jobs"),
            percentage(share("on_time_flag")).alias("on_time_pct"),
            R(mean(F.when(late, F.col("late_hours"))), 2).alias("avg_hours_late_when_late"),
            percentage(share(F.when(late, F.col("parts_delay_flag")))).alias(
                "pct_of_late_jobs_with_parts_delay"
            ),
        )
    )
    return (
        cut.withColumn("center_name", F.coalesce("center_name", F.lit("ALL CENTRES")))
        .orderBy("_total", F.desc("on_time_pct"), "center_name")
        .drop("_total")
    )


def q05(t: Tables, cfg: Config) -> DataFrame:
    """Technician load with ranks inside the centre. Technician counts grow with the
    network, so the ranks come from the bucketed rank operator, not from a window."""
    used = (
        t["work_orders"]
        .where(F.col("technician_id").isNotNull())
        .groupBy("technician_id")
        .agg(F.count(F.lit(1)).alias("jobs"), F.sum("actual_hours").alias("h"))
    )
    load = (
        t["technicians"]
        .select("technician_id", "center_id", "skill_level")
        .join(t["service_centers"].select("center_id", "center_name"), "center_id")
        .join(used, "technician_id", "left")
        .select(
            "center_name", "technician_id", "skill_level",
            F.coalesce("jobs", F.lit(0)).alias("jobs"),
            F.coalesce("h", F.lit(0)).cast("decimal(18,2)").alias("service_hours"),
        )
    )
    load = with_rank(load, ["center_name"], "service_hours", rank="hours_rank_in_centre", descending=True)
    load = with_rank(load, ["center_name"], "jobs", dense="jobs_dense_rank_in_centre", descending=True)
    centre = load.groupBy("center_name").agg(F.sum("service_hours").alias("_centre"))
    capacity = F.lit(cfg.working_days * cfg.productive_hours)
    return (
        load.join(centre, "center_name")
        .select(
            "center_name", "technician_id", "skill_level", "jobs",
            R("service_hours", 1).alias("service_hours"),
            percentage(ratio("service_hours", capacity), 1).alias("utilisation_pct"),
            "hours_rank_in_centre", "jobs_dense_rank_in_centre",
            percentage(ratio("service_hours", "_centre"), 1).alias("pct_of_centre_hours"),
        )
        .orderBy("center_name", "hours_rank_in_centre", "technician_id")
    )


def q06(t: Tables, cfg: Config) -> DataFrame:
    """Service types by revenue, with shares."""
    s = V.service_type_performance(V.work_order_enriched(t, cfg, V.SERVICE_INPUT))
    return s.select(
        "service_type", "work_orders", "revenue", "profit",
        percentage(F.col("profit_margin")).alias("profit_margin_pct"),
        "avg_service_cost",
        rank_by("revenue").alias("revenue_rank"),
        rank_by("profit").alias("profit_rank"),
        percentage(ratio("revenue", total("revenue"))).alias("revenue_share_pct"),
        percentage(ratio(running("revenue", F.desc("revenue")), total("revenue"))).alias(
            "cumulative_revenue_share_pct"
        ),
    ).orderBy("revenue_rank")


def q07(t: Tables, cfg: Config) -> DataFrame:
    """Cancellations per centre, and completed bookings that never became a job."""
    served = t["work_orders"].groupBy("appointment_id").agg(F.count(F.lit(1)).alias("_jobs"))
    a = (
        t["appointments"]
        .select("appointment_id", "center_id", "status")
        .join(served, "appointment_id", "left")
        .join(t["service_centers"].select("center_id", "center_name"), "center_id")
        # a booking with several jobs counts once per job, as in a plain left join
        .withColumn("_w", F.coalesce("_jobs", F.lit(1)))
    )

    def weighted(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("_w"))), F.lit(0))

    n = F.sum("_w")
    cut = a.groupBy("center_name").agg(
        n.alias("appointments"),
        weighted(F.col("status") == "Completed").alias("completed"),
        weighted(F.col("status") == "Cancelled").alias("cancelled"),
        weighted(F.col("status") == "No-Show").alias("no_shows"),
        weighted((F.col("status") == "Completed") & F.col("_jobs").isNull()).alias(
            "completed_without_work_order"
        ),
    )
    rate = ratio("cancelled", "appointments")
    return cut.select(
        "center_name", "appointments", "completed", "cancelled", "no_shows",
        percentage(rate).alias("cancellation_rate_pct"),
        percentage(ratio("no_shows", "appointments")).alias("no_show_rate_pct"),
        "completed_without_work_order",
        rank_by(rate).alias("cancellation_rank"),
    ).orderBy("cancellation_rank", "center_name")


def q08(t: Tables, cfg: Config) -> DataFrame:
    """Outcome by booking lead time."""
    banded = t["appointments"].select(
        F.datediff("scheduled_date", "booking_date").alias("lead"), "status"
    )
    cut = (
        banded.groupBy(V.sql_lead_band("lead", numbered=True).alias("lead_time_band"))
        .agg(
            F.count(F.lit(1)).alias("appointments"),
            F.count_if(F.col("status") == "Cancelled").alias("cancelled"),
            F.count_if(F.col("status") == "No-Show").alias("_ns"),
        )
    )
    return cut.select(
        "lead_time_band", "appointments", "cancelled",
        percentage(ratio("cancelled", "appointments")).alias("cancellation_rate_pct"),
        percentage(ratio("_ns", "appointments")).alias("no_show_rate_pct"),
        percentage(ratio("appointments", total("appointments"))).alias("share_of_bookings_pct"),
    ).orderBy("lead_time_band")


def q09(t: Tables, cfg: Config) -> DataFrame:
    """Rating by service type, only types with at least one rating."""
    rated = t["work_orders"].select("work_order_id", "service_type").join(
        t["feedback"].select("work_order_id", "rating"), "work_order_id", "left"
    )
    cut = (
        rated.groupBy("service_type")
        .agg(
            F.count(F.lit(1)).alias("work_orders"),
            F.count("rating").alias("rated_jobs"),
            mean("rating").alias("_avg"),
            share(F.col("rating") >= cfg.csat_threshold).alias("_csat"),
            share(F.col("rating") <= 2).alias("_low"),
        )
        .where(F.col("rated_jobs") > 0)
    )
    return cut.select(
        "service_type", "work_orders", "rated_jobs",
        percentage(ratio("rated_jobs", "work_orders"), 1).alias("rating_coverage_pct"),
        R("_avg", 3).alias("avg_rating"),
        percentage(F.col("_csat"), 1).alias("csat_pct"),
        percentage(F.col("_low"), 1).alias("low_rating_pct"),
        rank_by("_avg").alias("rating_rank"),
    ).orderBy("rating_rank", "service_type")


def q10(t: Tables, cfg: Config) -> DataFrame:
    """Pareto of part categories by catalogue spend."""
    lines = (
        t["part_usage"]
        .select("work_order_id", "part_id", "quantity")
        .join(t["work_orders"].select("work_order_id"), "work_order_id")
        .join(t["parts"].select("part_id", "part_category", "unit_cost"), "part_id")
    )
    cut = lines.groupBy("part_category").agg(
        F.countDistinct("work_order_id").alias("work_orders_using"),
        F.sum("quantity").alias("units_used"),
        F.sum(F.col("quantity") * F.col("unit_cost")).cast("decimal(24,2)").alias("parts_spend"),
    )
    whole = total("parts_spend")
    return cut.select(
        "part_category", "work_orders_using", "units_used", "parts_spend",
        R(ratio("parts_spend", "work_orders_using"), 2).alias("spend_per_work_order"),
        percentage(ratio("parts_spend", whole)).alias("share_of_spend_pct"),
        percentage(ratio(running("parts_spend", F.desc("parts_spend")), whole)).alias("cumulative_share_pct"),
        rank_by("parts_spend").alias("spend_rank"),
    ).orderBy("spend_rank")


def q11(t: Tables, cfg: Config) -> DataFrame:
    """How good the duration estimates are, per service type."""
    over = F.col("duration_variance_hours") > F.col("estimated_hours") * F.lit(0.25)
    rel = R(ratio("duration_variance_hours", "estimated_hours"), 6).cast("decimal(18,6)")
    e = jobs(t, cfg, "service_type estimated_hours actual_hours duration_variance_hours")
    cut = e.groupBy("service_type").agg(
        F.count(F.lit(1)).alias("work_orders"),
        mean("estimated_hours").alias("_est"),
        mean("actual_hours").alias("_act"),
        mean("duration_variance_hours").alias("_var"),
        mean(rel).alias("_rel"),
        F.count_if(over).alias("_over"),
    )
    v = F.col("_var")
    return cut.select(
        "service_type", "work_orders",
        R("_est", 2).alias("avg_estimated_hours"),
        R("_act", 2).alias("avg_actual_hours"),
        R("_var", 3).alias("avg_variance_hours"),
        percentage(F.col("_rel"), 1).alias("avg_variance_pct_of_estimate"),
        percentage(ratio("_over", "work_orders"), 1).alias("jobs_over_estimate_by_25pct_pct"),
        F.when(v >= 0.5, "Under-estimated")
        .when(v >= 0.2, "Slightly under-estimated")
        .when(v > -0.2, "Accurate")
        .otherwise("Over-estimated")
        .alias("estimate_quality"),
    ).orderBy(F.desc("avg_variance_hours"), "service_type")


def q12(t: Tables, cfg: Config) -> DataFrame:
    """Repeat customers per customer type plus a total row."""
    c = V.customer_repeat(
        jobs(
            t, cfg,
            "customer_id customer_type customer_region vehicle_id service_date revenue rating is_comeback",
        ),
        cfg,
    )
    cut = c.rollup("customer_type").agg(
        F.grouping("customer_type").alias("_total"),
        F.count(F.lit(1)).alias("customers_served"),
        F.count_if("is_repeat_customer").alias("repeat_customers"),
        percentage(ratio(F.count_if("is_repeat_customer"), F.count(F.lit(1)))).alias("repeat_visit_rate_pct"),
        R(mean("completed_visits"), 2).alias("avg_visits_per_customer"),
        R(mean("total_revenue"), 2).alias("avg_revenue_per_customer"),
        percentage(ratio(F.sum("comeback_visits"), F.sum("completed_visits"))).alias(
            "comeback_visits_pct_of_visits"
        ),
    )
    return (
        cut.withColumn("customer_type", F.coalesce("customer_type", F.lit("ALL CUSTOMERS")))
        .orderBy("_total", F.desc("repeat_visit_rate_pct"), "customer_type")
        .drop("_total")
    )


def q13(t: Tables, cfg: Config) -> DataFrame:
    """Same months of two consecutive years, in long form."""
    early = cfg.compare_months
    # fixed values: the metric labels here and in ``order`` below, as published
    served = (
        jobs(
            t, cfg,
            "service_month service_year revenue profit on_time_flag turnaround_hours rating parts_delay_flag",
        )
        .where(F.col("service_month") <= early)
        .groupBy("service_year")
        .agg(
            F.count(F.lit(1)).cast("double").alias("Completed work orders"),
            F.sum("revenue").cast("double").alias("Revenue (INR)"),
            F.sum("profit").cast("double").alias("Profit (INR)"),
            (ratio(F.sum("profit"), F.sum("revenue")) * 100.0).alias("Profit margin (%)"),
            mean("revenue").alias("Revenue per job (INR)"),
            (share("on_time_flag") * 100.0).alias("On-time (%)"),
            mean("turnaround_hours").alias("Avg turnaround (hours)"),
            mean("rating").alias("Avg rating (1-5)"),
            (share("parts_delay_flag") * 100.0).alias("Parts delay rate (%)"),
        )
    )
    booked = (
        t["appointments"]
        .where(F.month("scheduled_date") <= early)
        .groupBy(F.year("scheduled_date").alias("service_year"))
        .agg(
            F.count(F.lit(1)).cast("double").alias("Appointments"),
            (share(F.col("status") == "Cancelled") * 100.0).alias("Cancellation rate (%)"),
        )
    )
    order = [
        "Appointments", "Completed work orders", "Revenue (INR)", "Profit (INR)", "Profit margin (%)",
        "Revenue per job (INR)", "On-time (%)", "Avg turnaround (hours)", "Avg rating (1-5)",
        "Parts delay rate (%)", "Cancellation rate (%)",
    ]
    long = (
        served.join(booked, "service_year")
        .unpivot("service_year", order, "metric", "value")
        .groupBy("metric")
        .agg(
            *[
                F.max(F.when(F.col("service_year") == y, F.col("value"))).alias(n)
                for n, y in (("_a", cfg.base_year), ("_b", cfg.focus_year))
            ]
        )
    )
    m = f"jan_{['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'][early - 1]}"
    return (
        long.orderBy(position_in("metric", order))
        .select(
            "metric",
            R("_a", 2).alias(f"{m}_{cfg.base_year}"),
            R("_b", 2).alias(f"{m}_{cfg.focus_year}"),
            R(F.col("_b") - F.col("_a"), 2).alias("abs_change"),
            percentage(ratio("_b", "_a") - 1).alias("pct_change"),
        )
    )


def q14(t: Tables, cfg: Config) -> DataFrame:
    """Balanced centre ranking. All windows run over one row per centre."""
    c = V.center_performance(t, partial(V.work_order_enriched, t, cfg), V.appointment_enriched(t), cfg)

    def pct(name: str, better_high: bool):
        col = F.col(name)
        order = col.asc_nulls_last() if better_high else col.desc_nulls_first()
        return F.percent_rank().over(Window.orderBy(order))

    scored = c.withColumn(
        "composite_score",
        (
            pct("on_time_rate", True)
            + pct("avg_rating", True)
            + pct("profit_margin", True)
            + pct("comeback_rate", False)
            + pct("avg_turnaround_hours", False)
        )
        / 5.0,
    )
    s = F.col("composite_score")
    # equal sums can differ in the last bit, so ranks use the score rounded to 12 places
    key = R(s, 12)
    return scored.select(
        F.rank().over(Window.orderBy(key.desc())).alias("overall_rank"),
        "center_name",
        R(s, 3).alias("composite_score"),
        F.ntile(4).over(Window.orderBy(key.desc(), "center_name")).alias("quartile"),
        F.when(key >= 0.70, "Leader")
        .when(key >= 0.45, "Solid")
        .when(key >= 0.25, "Watch")
        .otherwise("Needs attention")
        .alias("performance_category"),
        percentage(F.col("on_time_rate")).alias("on_time_pct"),
        "avg_rating",
        percentage(F.col("profit_margin")).alias("profit_margin_pct"),
        percentage(F.col("comeback_rate")).alias("comeback_rate_pct"),
        "avg_turnaround_hours",
        percentage(F.col("utilisation"), 1).alias("utilisation_pct"),
    ).orderBy("overall_rank", "center_name")


def parts_wait_band(c: str):
    w = F.col(c)
    return (
        F.when(w == 0, "1. No parts wait")
        .when(w <= 72, "2. Up to 3 days")
        .when(w <= 168, "3. 3 to 7 days")
        .otherwise("4. Over 7 days")
    )


def q15(t: Tables, cfg: Config) -> DataFrame:
    """Parts-wait bands against the no-wait baseline."""
    cut = (
        jobs(t, cfg, "parts_wait_hours on_time_flag turnaround_hours rating cost_variance")
        .groupBy(parts_wait_band("parts_wait_hours").alias("parts_wait_band"))
        .agg(
            F.count(F.lit(1)).alias("work_orders"),
            (share("on_time_flag") * 100.0).alias("_ot"),
            mean("turnaround_hours").alias("_tat"),
            mean("rating").alias("_rating"),
            F.count("rating").alias("rated_jobs"),
            mean("cost_variance").alias("_cv"),
        )
    )
    base = Window.orderBy("parts_wait_band")
    return cut.select(
        "parts_wait_band", "work_orders",
        R("_ot", 2).alias("on_time_pct"),
        R(F.col("_ot") - F.first("_ot").over(base), 2).alias("on_time_pts_vs_no_wait"),
        R("_tat", 2).alias("avg_turnaround_hours"),
        R("_rating", 3).alias("avg_rating"),
        R(F.col("_rating") - F.first("_rating").over(base), 3).alias("rating_vs_no_wait"),
        "rated_jobs",
        R("_cv", 2).alias("avg_cost_variance"),
    ).orderBy("parts_wait_band")


def q16(t: Tables, cfg: Config) -> DataFrame:
    """Quality by skill level, jobs without a technician left out."""
    cut = (
        jobs(t, cfg, "skill_level technician_id caused_comeback qc_passed_first_time duration_variance_hours on_time_flag rating profit")
        .where(F.col("skill_level").isNotNull())
        .groupBy("skill_level")
        .agg(
            F.countDistinct("technician_id").alias("technicians"),
            F.count(F.lit(1)).alias("jobs"),
            percentage(share("caused_comeback")).alias("comeback_rate_pct"),
            percentage(share("qc_passed_first_time")).alias("qc_first_pass_pct"),
            R(mean("duration_variance_hours"), 3).alias("avg_duration_variance_hours"),
            percentage(share("on_time_flag")).alias("on_time_pct"),
            R(mean("rating"), 3).alias("avg_rating"),
            R(mean("profit"), 2).alias("avg_profit_per_job"),
        )
    )
    return cut.orderBy(position_in("skill_level", cfg.skills))


def q17(t: Tables, cfg: Config) -> DataFrame:
    """Weekday load against wait, with their correlation across weekdays."""
    daily = (
        jobs(t, cfg, "iso_weekday service_date wait_hours")
        .groupBy("iso_weekday", "service_date")
        .agg(F.count(F.lit(1)).alias("jobs"), mean("wait_hours").alias("w"))
    )
    # daily averages are kept at nine places as exact decimals, so their mean is stable
    weekday = daily.groupBy("iso_weekday").agg(
        F.count(F.lit(1)).alias("open_days"),
        F.sum("jobs").alias("work_orders"),
        mean("jobs").alias("_load"),
        mean(R("w", 9).cast("decimal(20,9)")).alias("_wait"),
    )
    return weekday.orderBy("iso_weekday").select(
        weekday_name_of_number("iso_weekday").alias("weekday"),
        "open_days", "work_orders",
        R("_load", 1).alias("avg_jobs_per_day"),
        R("_wait", 2).alias("avg_wait_hours"),
        rank_by("_load").alias("load_rank"),
        rank_by("_wait").alias("wait_rank"),
        R(F.corr("_load", "_wait").over(Window.partitionBy()), 3).alias("corr_load_vs_wait_across_weekdays"),
    )


def q18(t: Tables, cfg: Config) -> DataFrame:
    """Cost variance by service type and by billing type in one pass."""
    e = jobs(t, cfg, "service_type billing_type cost_variance cost_overrun_flag estimated_cost")
    cuts = e.groupingSets([["service_type"], ["billing_type"]], "service_type", "billing_type").agg(
        F.grouping("service_type").alias("_g"),
        F.count(F.lit(1)).alias("work_orders"),
        F.sum("cost_variance").alias("total_cost_variance"),
        mean("cost_variance").alias("_avg"),
        share("cost_overrun_flag").alias("_over"),
        F.sum("estimated_cost").alias("_est"),
    )
    w = Window.partitionBy("_g").orderBy(F.col("total_cost_variance").desc_nulls_first())
    return cuts.select(
        F.when(F.col("_g") == 0, "Service type").otherwise("Billing type").alias("cut"),
        F.coalesce("service_type", "billing_type").alias("segment"),
        "work_orders", "total_cost_variance",
        R("_avg", 2).alias("avg_cost_variance"),
        percentage(F.col("_over")).alias("overrun_rate_pct"),
        percentage(ratio("total_cost_variance", "_est")).alias("variance_pct_of_estimate"),
        F.rank().over(w).alias("rank_in_cut"),
    ).orderBy(F.desc("cut"), "rank_in_cut")


def q19(t: Tables, cfg: Config) -> DataFrame:
    """Model profile including vehicles that never came in."""
    e = jobs(
        t, cfg, "vehicle_id model revenue profit rating caused_comeback service_date purchase_date"
    )
    activity = e.groupBy("vehicle_id").agg(
        F.count(F.lit(1)).alias("visits"), F.sum("revenue").alias("revenue"), F.sum("profit").alias("profit")
    )
    zero = F.lit(0)
    base = (
        t["vehicles"]
        .select("vehicle_id", "model")
        .join(activity, "vehicle_id", "left")
        .groupBy("model")
        .agg(
            F.count(F.lit(1)).alias("vehicles_in_base"),
            F.count_if(F.col("visits").isNull()).alias("never_serviced"),
            F.coalesce(F.sum("visits"), zero).alias("visits"),
            F.coalesce(F.sum("revenue"), zero).alias("_rev"),
            F.coalesce(F.sum("profit"), zero).alias("_profit"),
        )
    )
    old = F.when(F.datediff("service_date", "purchase_date") / 365.25 >= 2, 1).otherwise(0)
    quality = e.groupBy("model").agg(
        mean("rating").alias("_rating"), share("caused_comeback").alias("_cb"), mean(old).alias("_old")
    )
    return (
        base.join(quality, "model")
        .orderBy(F.desc("_rev"), "model")
        .select(
            "model", "vehicles_in_base", "never_serviced",
            percentage(ratio("never_serviced", "vehicles_in_base"), 1).alias("never_serviced_pct"),
            "visits",
            R(ratio("visits", "vehicles_in_base"), 2).alias("visits_per_vehicle"),
            R(ratio("_rev", "vehicles_in_base"), 2).alias("revenue_per_vehicle"),
            percentage(ratio("_profit", "_rev")).alias("profit_margin_pct"),
            R("_rating", 3).alias("avg_rating"),
            percentage(F.col("_cb")).alias("comeback_rate_pct"),
            percentage(F.col("_old"), 1).alias("jobs_on_2plus_year_old_vehicles_pct"),
        )
    )


def q20(t: Tables, cfg: Config) -> DataFrame:
    """Centre utilisation per month with a three-month average over the dense grid."""
    heads = t["technicians"].groupBy("center_id").agg(F.count(F.lit(1)).alias("technicians"))
    per_tech = (
        t["work_orders"]
        .where(F.col("technician_id").isNotNull())
        .groupBy("technician_id", F.trunc("check_in_time", "MM").alias("month_start"))
        .agg(F.sum("actual_hours").alias("h"))
    )
    hours = (
        per_tech.join(t["technicians"].select("technician_id", "center_id"), "technician_id")
        .groupBy("center_id", "month_start")
        .agg(F.sum("h").alias("h"))
    )
    available = (F.col("technicians") * F.col("working_days") * F.lit(cfg.productive_hours)).cast("decimal(18,1)")
    grid = (
        t["service_centers"]
        .select("center_id", "center_name")
        .join(heads, "center_id")
        .select("*", F.explode(month_array(cfg)).alias("_m"))  # months of the reporting period
        .select("center_id", "center_name", "technicians", "_m.month_start", "_m.working_days")
        .join(hours, ["center_id", "month_start"], "left")
        .select(
            "center_name", "month_start",
            F.coalesce("h", F.lit(0)).cast("decimal(18,2)").alias("service_hours"),
            available.alias("available_hours"),
        )
        .withColumn("_u", ratio("service_hours", "available_hours"))
    )
    w = Window.partitionBy("center_name").orderBy("month_start").rowsBetween(-2, 0)
    return grid.select(
        "center_name",
        F.date_format("month_start", "yyyy-MM").alias("year_month"),
        R("service_hours", 1).alias("service_hours"),
        "available_hours",
        percentage(F.col("_u"), 1).alias("utilisation_pct"),
        percentage(F.avg("_u").over(w), 1).alias("utilisation_3m_avg_pct"),
    ).orderBy("center_name", "year_month")


def q21(t: Tables, cfg: Config) -> DataFrame:
    """Revenue concentration by customer decile. Customers are ranked with the bucketed
    position operator (customer id breaks ties), never with a global window."""
    per_customer = (
        jobs(t, cfg, "customer_id customer_type customer_region revenue")
        .groupBy("customer_id", "customer_type", "customer_region")
        .agg(
            F.coalesce(F.sum("revenue"), F.lit(0)).alias("total_revenue"),
            F.count(F.lit(1)).alias("completed_visits"),
        )
    )
    placed = row_positions(per_customer, "total_revenue", "customer_id", "_pos", descending=True)
    n = placed.agg(F.count(F.lit(1)).alias("_n"))
    deciles = (
        placed.crossJoin(F.broadcast(n))
        .groupBy(ntile(F.col("_pos"), F.col("_n"), 10).alias("revenue_decile"))
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.sum("total_revenue").alias("revenue"),
            R(mean("completed_visits"), 2).alias("avg_visits"),
        )
    )
    whole = total("revenue")
    return deciles.select(
        "revenue_decile", "customers", "revenue", "avg_visits",
        percentage(ratio("revenue", whole)).alias("revenue_share_pct"),
        percentage(ratio(running("revenue", "revenue_decile"), whole)).alias("cumulative_share_pct"),
    ).orderBy("revenue_decile")


REPORTS: dict[str, Callable[[Tables, Config], DataFrame]] = {
    f"q{i:02d}": globals()[f"q{i:02d}"] for i in range(1, 22)
}
