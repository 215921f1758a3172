"""Diagnostic metrics: scorecards, load, parts, skills. Inputs are the fact tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bayworks.config import LEAD_BANDS, LOAD_EDGES, REWORK, WEEKDAYS, Config
from bayworks.functions.scalars import (
    count_true,
    flag,
    load_band,
    load_band_labels,
    mean,
    ratio,
    share,
    weekday_name,
)
from bayworks.operators.ranks import exact_percentiles, ranked_values
from bayworks.operators.shape import crosstab, mean_matrix, reindex_labels, row_shares
from bayworks.plans.kpis import known
from bayworks.session import settle_table


def with_calendar(fact: DataFrame, day: str = "service_date") -> DataFrame:
    """Weekday, month number and year of a fact's date."""
    return fact.withColumns(
        {"weekday": weekday_name(day), "month_num": F.month(day), "year": F.year(day)}
    )


# ---- scorecards ---------------------------------------------------------------------
def scorecard_measures(cfg: Config) -> list:
    return [
        F.count(F.lit(1)).alias("jobs"),
        F.sum("revenue").alias("revenue"),
        F.sum("total_cost").alias("total_cost"),
        F.sum("profit").alias("profit"),
        share("on_time_flag").alias("on_time"),
        mean("turnaround_hours").alias("tat_mean_h"),
        F.median("turnaround_hours").alias("tat_median_h"),
        mean("wait_hours").alias("wait_h"),
        mean("late_hours").alias("late_h"),
        share("parts_delay_flag").alias("parts_delay"),
        share("qc_passed_first_time").alias("qc_first_pass"),
        share("caused_repeat_visit").alias("comeback"),
        share("cost_overrun_flag").alias("overrun"),
        mean("duration_variance_hours").alias("duration_var_h"),
        mean("rating").alias("csat"),
        ratio(F.sum("profit"), F.sum("revenue")).alias("margin"),
        ratio(F.sum("total_cost"), F.count(F.lit(1))).alias("avg_service_cost"),
        share(F.col("rating") >= cfg.csat_threshold).alias("csat_pct"),
    ]


def service_scorecard(fs: DataFrame, by: Sequence[str], cfg: Config, *extra) -> DataFrame:
    """Operational, financial and experience KPIs for any grouping of jobs."""
    return known(fs, by).groupBy(*by).agg(*scorecard_measures(cfg), *extra)


def utilisation(ftm: DataFrame, by: Sequence[str], name: str = "utilisation") -> DataFrame:
    return known(ftm, by).groupBy(*by).agg(ratio(F.sum("service_hours"), F.sum("available_hours")).alias(name))


def cancellation_by(fa: DataFrame, by: Sequence[str]) -> DataFrame:
    return known(fa, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("appointments"),
        share("is_cancelled").alias("cancellation_rate"),
        share("is_no_show").alias("no_show_rate"),
        mean("lead_days").alias("mean_lead_days"),
    )


def focus(df: DataFrame, cfg: Config, column: str = "year") -> DataFrame:
    return df.where(F.col(column) == cfg.focus_year)


def focus_months(ftm: DataFrame, cfg: Config) -> DataFrame:
    return ftm.where(F.col("month").startswith(str(cfg.focus_year)))


def month_count(fs: DataFrame) -> DataFrame:
    """Number of months with jobs, as one row."""
    return fs.agg(F.countDistinct("month").alias("_months"))


def centre_scorecard(fs: DataFrame, fa: DataFrame, ftm: DataFrame, staff: DataFrame, cfg: Config) -> DataFrame:
    """Service, booking, capacity and staffing KPIs per centre; all job cuts in one pass."""
    is_complex = F.col("service_type").isin(*cfg.complex_types)
    year = cfg.focus_year
    jobs = service_scorecard(
        fs, ["center_id", "center_name"], cfg,
        share(flag(F.col("skill_level") == "Junior")).alias("junior_job_share"),
        share(is_complex).alias("complex_job_share"),
        share(F.col("service_type") == cfg.periodic_type).alias("periodic_share"),
        share(flag(F.col("customer_type") == cfg.fleet_type)).alias("fleet_job_share"),
        share(F.when(is_complex, F.col("on_time_flag"))).alias("complex_on_time"),
        F.count_if(F.col("year") == year).alias("_focus_jobs"),
    )
    heads = staff.groupBy("center_id").agg(
        F.count(F.lit(1)).alias("technicians"),
        F.count_if(F.col("skill_level").isin("Senior", "Master")).alias("senior_or_master_techs"),
    )
    joined = jobs
    for side in (
        cancellation_by(fa, ["center_id"]),
        utilisation(ftm, ["center_id"]),
        utilisation(focus_months(ftm, cfg), ["center_id"], "utilisation_focus"),
        heads,
    ):
        joined = joined.join(side, "center_id", "left")
    per_month = ratio(ratio("_focus_jobs", "_months"), "technicians")
    return (
        joined.crossJoin(F.broadcast(month_count(focus(fs, cfg))))
        .withColumn("senior_or_master_techs", F.coalesce("senior_or_master_techs", F.lit(0)))
        .withColumn("jobs_per_tech_month_focus", F.when(F.col("_focus_jobs") > 0, per_month))
        .drop("_focus_jobs", "_months")
    )


def monthly_trend(fs: DataFrame, fa: DataFrame, ftm: DataFrame, cfg: Config) -> DataFrame:
    booked = cancellation_by(fa, ["month"]).select("month", "appointments", "cancellation_rate")
    return (
        service_scorecard(fs, ["month"], cfg)
        .join(booked, "month", "left")
        .join(utilisation(ftm, ["month"]), "month", "left")
    )


def year_over_year(fs: DataFrame, fa: DataFrame, ftm: DataFrame, cfg: Config) -> DataFrame:
    """Same months of the base and the focus year, one row per metric."""
    limit = cfg.compare_months
    t = ftm.select(
        "service_hours", "available_hours",
        F.substring("month", 1, 4).cast("int").alias("year"),
        F.substring("month", 6, 2).cast("int").alias("month_num"),
    )
    early = F.col("month_num") <= limit
    by_year = (
        service_scorecard(fs.where(early), ["year"], cfg)
        .join(
            cancellation_by(fa.where(early), ["year"]).select("year", "appointments", "cancellation_rate"), "year", "left"
        )
        .join(utilisation(t.where(early), ["year"]), "year", "left")
    )
    names = [c for c in by_year.columns if c != "year"]
    long = by_year.select("year", *[F.col(c).cast("double").alias(c) for c in names]).unpivot(
        "year", names, "metric", "value"
    )
    a, b = cfg.base_year, cfg.focus_year
    wide = long.groupBy("metric").agg(
        *[F.max(F.when(F.col("year") == y, F.col("value"))).alias(f"y{y}") for y in (a, b)]
    )
    change = F.col(f"y{b}") - F.col(f"y{a}")
    return wide.select("*", change.alias("change"), ratio(change, f"y{a}").alias("pct_change"))


# ---- load and capacity ------------------------------------------------------------------
def daily_load(fs: DataFrame, staff: DataFrame, cfg: Config) -> DataFrame:
    """Booked hours against rostered capacity per centre and day.

    The result (centres x days) also carries job counts and sums, so that every later use of
    the load (profiles, what-if models) works on it instead of on jobs again.
    """
    heads = staff.groupBy("center_id").agg(F.count(F.lit(1)).alias("_heads"))
    booked = F.when(flag(F.col("booking_channel") != cfg.walk_in), F.col("estimated_hours"))
    days = known(fs, ["center_id", "center_name"]).groupBy(
        "center_id", "center_name", "service_date", "weekday", "year", "month"
    ).agg(
        F.count(F.lit(1)).alias("jobs"),
        F.sum("estimated_hours").alias("booked_hours"),
        mean("wait_hours").alias("wait_h"),
        share("on_time_flag").alias("on_time"),
        count_true("on_time_flag").alias("on_time_jobs"),
        F.coalesce(F.sum(booked), F.lit(0)).alias("booked_ahead_hours"),
        F.sum("wait_hours").alias("wait_sum"),
        F.count("wait_hours").alias("wait_n"),
    )
    capacity = (F.col("_heads") * F.lit(cfg.productive_hours)).cast("decimal(18,1)")
    return (
        days.join(heads, "center_id", "left")
        .withColumn("capacity_hours", capacity)
        .withColumn("load_ratio", ratio("booked_hours", "capacity_hours"))
        .withColumn("overloaded", flag(F.col("load_ratio") > 1.0))
        .drop("_heads")
    )


def attach_load(fs: DataFrame, daily: DataFrame) -> DataFrame:
    """Load ratio and band of the job's centre and day."""
    side = daily.select("center_id", "service_date", "load_ratio")
    return fs.join(side, ["center_id", "service_date"], "left").withColumn(
        "load_band", load_band("load_ratio", LOAD_EDGES)
    )


def load_band_profile(fs_load: DataFrame) -> DataFrame:
    out = known(fs_load, ["load_band"]).groupBy("load_band").agg(
        F.count(F.lit(1)).alias("jobs"),
        share("on_time_flag").alias("on_time"),
        mean("wait_hours").alias("wait_h"),
        share("qc_passed_first_time").alias("qc_first_pass"),
        share("caused_repeat_visit").alias("comeback"),
        mean("rating").alias("csat"),
    )
    labels = F.array(*map(F.lit, load_band_labels(LOAD_EDGES)))
    return out.orderBy(F.array_position(labels, F.col("load_band")))


def overloaded_share(daily: DataFrame, cfg: Config) -> DataFrame:
    return daily.groupBy("center_id").agg(
        share("overloaded").alias("overloaded_day_share"),
        share(F.when(F.col("year") == cfg.focus_year, F.col("overloaded"))).alias("overloaded_day_share_focus"),
    )


def weekday_profile(fs: DataFrame, fa: DataFrame) -> DataFrame:
    """Monday to Saturday; job shares are shares of all days, Sunday included."""
    work = fs.groupBy("weekday").agg(
        F.count(F.lit(1)).alias("jobs"),
        share("on_time_flag").alias("on_time"),
        mean("wait_hours").alias("wait_h"),
        mean("rating").alias("csat"),
    )
    total = work.agg(F.sum("jobs").alias("_all"))
    booked = cancellation_by(fa, ["weekday"]).select("weekday", "appointments", "cancellation_rate")
    out = (
        work.join(booked, "weekday", "left")
        .crossJoin(F.broadcast(total))
        .withColumn("job_share", ratio("jobs", "_all"))
        .drop("_all")
    )
    return reindex_labels(out, "weekday", WEEKDAYS[:6])


def carry_over(fs: DataFrame) -> DataFrame:
    """Jobs without a parts delay that end on a later day: network, per centre, per weekday."""
    over = flag(F.to_date("end_time") > F.to_date("check_in_time"))
    base = fs.where(~F.col("parts_delay_flag")).select("center_id", "weekday", "on_time_flag", over.alias("over"))
    measures = [
        share("over").alias("carry_over_share"),
        share(F.when(F.col("over"), F.col("on_time_flag"))).alias("on_time_if_carried_over"),
        share(F.when(~F.col("over"), F.col("on_time_flag"))).alias("on_time_if_same_day"),
    ]
    cuts = base.groupingSets([[], ["center_id"], ["weekday"]], "center_id", "weekday").agg(
        F.grouping_id().alias("_g"), *measures
    )
    scope = F.when(F.col("_g") == 3, "network").when(F.col("_g") == 1, "centre").otherwise("weekday")
    name = F.coalesce(F.col("center_id").cast("string"), F.col("weekday"), F.lit("all"))
    return cuts.select(
        scope.alias("scope"), name.alias("name"), "carry_over_share", "on_time_if_carried_over", "on_time_if_same_day"
    )


def process_stages(fs: DataFrame, fa: DataFrame, feedback: DataFrame, cfg: Config) -> DataFrame:
    """Durations and rates along the workflow, one row per metric."""
    ahead = flag(F.col("booking_channel") != cfg.walk_in)
    lead = F.when(ahead, F.col("lead_days"))
    bookings = fa.agg(
        mean(lead).alias("booking_lead_days_mean_booked"),
        F.median(lead).alias("booking_lead_days_median_booked"),
        share(flag(F.col("booking_channel") == cfg.walk_in)).alias("walk_in_share"),
        share("is_cancelled").alias("cancellation_rate"),
        share("is_no_show").alias("no_show_rate"),
    )
    slot = F.to_timestamp(F.concat_ws(" ", F.date_format("scheduled_date", "yyyy-MM-dd"), "scheduled_slot"))
    slots = fa.where(ahead & F.col("scheduled_slot").isNotNull()).select("appointment_id", slot.alias("slot"))
    minutes = (F.unix_micros("check_in_time") - F.unix_micros("slot")) / 60e6
    # time differences have no bounded domain: percentiles from the ranked histogram
    gaps = fs.select("appointment_id", "check_in_time").join(slots, "appointment_id").select(minutes.alias("_min"))
    arrivals = exact_percentiles(
        gaps, [], "_min", {"arrival_vs_slot_median_min": 0.5, "arrival_vs_slot_p90_min": 0.9}
    )
    lag = F.datediff("feedback_date", F.to_date("end_time"))
    answers = (
        feedback.select("work_order_id", "feedback_date")
        .join(fs.select("work_order_id", "end_time"), "work_order_id")
        .agg(mean(lag).alias("feedback_lag_days_mean"))
    )
    delayed = F.when(F.col("parts_delay_flag"), F.col("parts_wait_hours"))
    late = F.when(~F.col("on_time_flag"), F.col("late_hours"))
    jobs = fs.agg(
        mean("wait_hours").alias("wait_mean_h"),
        F.median("wait_hours").alias("wait_median_h"),
        F.percentile("wait_hours", F.lit(0.9)).alias("wait_p90_h"),
        share(flag(F.col("wait_hours") > cfg.promise_buffer_hours)).alias("wait_over_1_5h_share"),
        share("additional_work_found").alias("additional_work_found_rate"),
        mean("estimated_hours").alias("estimated_hours_mean"),
        mean("actual_hours").alias("actual_hours_mean"),
        F.median("actual_hours").alias("actual_hours_median"),
        mean("duration_variance_hours").alias("duration_variance_mean_h"),
        share(flag(F.col("duration_variance_hours") > 0)).alias("labour_over_estimate_share"),
        share("parts_delay_flag").alias("parts_delay_rate"),
        mean(delayed).alias("parts_wait_mean_h_delayed"),
        F.median(delayed).alias("parts_wait_median_h_delayed"),
        share("qc_passed_first_time").alias("qc_first_pass"),
        share("on_time_flag").alias("on_time_rate"),
        F.median(late).alias("late_hours_median_when_late"),
        mean(late).alias("late_hours_mean_when_late"),
        F.median("turnaround_hours").alias("turnaround_median_h"),
        mean("turnaround_hours").alias("turnaround_mean_h"),
        share(F.col("rating").isNotNull()).alias("feedback_response_rate"),
        mean("rating").alias("csat"),
        share("caused_repeat_visit").alias("comeback_rate"),
        share(flag(F.col("billing_type") == REWORK)).alias("rework_billing_share"),
    )
    one = bookings
    for side in (arrivals, answers, jobs):
        one = one.crossJoin(F.broadcast(side))
    names = one.columns
    return one.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], names, "metric", "value")


# ---- parts ------------------------------------------------------------------------------
def parts_lines(fs: DataFrame, usage: DataFrame, parts: DataFrame) -> DataFrame:
    """Part lines with catalogue data and the delay facts of their job."""
    jobs = fs.select(
        "work_order_id", "center_id", "center_name", "service_date", "year", "parts_delay_flag", "parts_wait_hours"
    )
    value = (F.col("quantity") * F.col("unit_cost")).cast("decimal(18,2)")
    return usage.join(parts, "part_id").join(jobs, "work_order_id").withColumn("line_cost", value)


def _job_categories(lines: DataFrame, *extra) -> DataFrame:
    """One row per job and category (the flag is constant within a job)."""
    return lines.groupBy("work_order_id", "part_category").agg(
        F.max("parts_delay_flag").alias("parts_delay_flag"), *extra
    )


def parts_delay_by_category(lines: DataFrame) -> DataFrame:
    """Delay rate of jobs containing each category; lead days of the first line per job."""
    first = F.min_by("supplier_lead_days", F.struct("usage_id", "part_id")).alias("lead")
    out = _job_categories(lines, first).groupBy("part_category").agg(
        F.count(F.lit(1)).alias("jobs"),
        share("parts_delay_flag").alias("delay_rate"),
        mean("lead").alias("supplier_lead_days"),
    )
    return out.orderBy(F.desc("delay_rate"), "part_category")


def parts_delay_category_centre(lines: DataFrame, centres: Sequence[str] | None = None) -> DataFrame:
    rows = _job_categories(lines, F.max("center_name").alias("center_name"))
    return mean_matrix(rows, "part_category", "center_name", F.col("parts_delay_flag").cast("int"), centres)


def parts_delay_impact(fs: DataFrame, cfg: Config) -> DataFrame:
    return fs.groupBy("parts_delay_flag").agg(
        F.count(F.lit(1)).alias("jobs"),
        share("on_time_flag").alias("on_time"),
        mean("turnaround_hours").alias("tat_mean_h"),
        F.median("turnaround_hours").alias("tat_median_h"),
        mean("parts_wait_hours").alias("parts_wait_mean_h"),
        mean("rating").alias("csat"),
        share(F.col("rating") >= cfg.csat_threshold).alias("csat_pct"),
    )


PART_KEYS = ("part_id", "part_name", "part_category", "unit_cost", "supplier_lead_days")


def abc_parts(lines: DataFrame) -> DataFrame:
    """Consumption-value classes: A first 80 %, B next 15 %, C the rest.

    A part's class depends on the share of parts with a strictly higher value, from the
    bucketed running sum; parts of equal value share a class.
    """
    parts = lines.groupBy(*PART_KEYS).agg(
        F.sum("quantity").alias("units"),
        F.sum("line_cost").cast("decimal(24,2)").alias("value"),
        F.countDistinct("work_order_id").alias("jobs"),
        share("parts_delay_flag").alias("delay_rate"),
    )
    return classify_abc(settle_table(parts), "value")


def classify_abc(items: DataFrame, value: str) -> DataFrame:
    """Add value_share, cum_share and abc_class to one row per item."""
    ranked = ranked_values(
        items.withColumn("_v", F.col(value)), [], value, descending=True, sums=["_v"]
    ).select(F.col(value).alias("_key"), F.col("_v_before").alias("_above"), F.col("_v").alias("_peers"))
    whole = items.agg(F.sum(value).alias("_all"))
    joined = items.join(ranked, F.col(value) == F.col("_key")).crossJoin(F.broadcast(whole))
    above = ratio("_above", "_all")
    return (
        joined.withColumn("value_share", ratio(value, "_all"))
        .withColumn("cum_share", ratio(F.col("_above") + F.col("_peers"), "_all"))
        .withColumn("abc_class", F.when(above < 0.80, "A").when(above < 0.95, "B").otherwise("C"))
        .drop("_key", "_above", "_peers", "_all")
    )


def abc_summary(abc: DataFrame) -> DataFrame:
    return abc.groupBy("abc_class").agg(
        F.count(F.lit(1)).alias("parts"),
        F.sum("value_share").alias("value_share"),
        F.avg("delay_rate").alias("mean_delay_rate"),
    )


def safety_stock(
    lines: DataFrame, center_id, cfg: Config, min_delay_rate: float = 0.10, months: int = 9
) -> DataFrame:
    """One supplier lead time of demand for parts often delayed at a centre."""
    chosen = lines.where((F.col("center_id") == center_id) & (F.col("year") == cfg.focus_year))
    p = chosen.groupBy(*PART_KEYS).agg(
        F.sum("quantity").alias("units"),
        share("parts_delay_flag").alias("delay_rate"),
        F.countDistinct("work_order_id").alias("jobs"),
    )
    monthly = F.col("units").cast("double") / months
    need = F.ceil(F.col("monthly_units") * F.col("supplier_lead_days") / 30)
    return (
        p.where(F.col("delay_rate") >= min_delay_rate)
        .withColumn("monthly_units", monthly)
        .withColumn("cover_units", F.greatest(F.lit(1), need).cast("int"))
        .withColumn("stock_value", (F.col("cover_units") * F.col("unit_cost")).cast("decimal(18,2)"))
        .orderBy(F.desc("stock_value"), "part_id")
    )


# ---- people -------------------------------------------------------------------------------
def skill_profile(fs: DataFrame, cfg: Config, only_complex: bool = False) -> DataFrame:
    """Scorecard per skill level in skill order, for all or only for complex jobs."""
    is_complex = F.col("service_type").isin(*cfg.complex_types)
    if only_complex:
        return reindex_labels(service_scorecard(fs.where(is_complex), ["skill_level"], cfg), "skill_level", cfg.skills)
    extra = share(is_complex).alias("complex_share")
    return reindex_labels(service_scorecard(fs, ["skill_level"], cfg, extra), "skill_level", cfg.skills)


def technician_scorecard(fs: DataFrame, ftm: DataFrame, cfg: Config) -> DataFrame:
    out = service_scorecard(fs, ["technician_id", "center_name", "skill_level"], cfg)
    return out.join(utilisation(ftm, ["technician_id"]), "technician_id", "left").join(
        utilisation(focus_months(ftm, cfg), ["technician_id"], "utilisation_focus"), "technician_id", "left"
    )


def overloaded_technicians(ftm: DataFrame, cfg: Config) -> DataFrame:
    """How many technicians logged more than their available hours in the focus year."""
    load = utilisation(focus_months(ftm, cfg), ["technician_id"])
    return load.agg(F.count_if(F.col("utilisation") > 1).alias("technicians_over_100_pct"))


def rework_cost(fs: DataFrame) -> DataFrame:
    hit = flag(F.col("billing_type") == REWORK)
    return fs.agg(
        F.count_if(hit).alias("rework_jobs"),
        F.coalesce(F.sum(F.when(hit, F.col("total_cost"))), F.lit(0)).alias("rework_cost"),
        mean(F.when(hit, F.col("total_cost"))).alias("rework_avg_cost"),
        F.coalesce(F.sum(F.when(hit, F.col("actual_hours"))), F.lit(0)).alias("rework_labour_hours"),
        share(hit).alias("rework_share_of_jobs"),
    )


def overrun_drivers(fs: DataFrame) -> DataFrame:
    """Jobs with and without additional work found. The two-row total is a tiny window."""
    out = known(fs, ["additional_work_found"]).groupBy("additional_work_found").agg(
        F.count(F.lit(1)).alias("jobs"),
        share("cost_overrun_flag").alias("overrun"),
        F.sum("revenue").alias("revenue"),
        mean("rating").alias("csat"),
        ratio(F.sum("profit"), F.sum("revenue")).alias("margin"),
    )
    rows = known(fs, ["additional_work_found", "cost_variance_pct"])
    halves = exact_percentiles(rows, ["additional_work_found"], "cost_variance_pct", {"cost_var_pct_median": 0.5})
    total = out.agg(F.sum("jobs").alias("_all"))
    out = out.join(halves, "additional_work_found", "left").crossJoin(F.broadcast(total))
    return out.withColumn("share_of_jobs", ratio("jobs", "_all")).drop("_all")


def technician_monthly_cost(staff: DataFrame, ftm: DataFrame, skill: str) -> DataFrame:
    """Payroll of the first technician of a skill: hourly cost x shift x mean working days."""
    first = staff.where(F.col("skill_level") == skill).agg(
        F.min_by(F.col("hourly_cost") * F.col("shift_hours_per_day"), "technician_id").alias("_day")
    )
    days = ftm.groupBy("month").agg(F.max("working_days").alias("d")).agg(mean("d").alias("_days"))
    return first.crossJoin(F.broadcast(days)).select(
        F.lit(skill).alias("skill_level"), (F.col("_day").cast("double") * F.col("_days")).alias("monthly_cost")
    )


def lead_band_mix(fa: DataFrame) -> DataFrame:
    """Share of each lead band within a centre."""
    cells = crosstab(fa.where(F.col("lead_time_band").isin(*LEAD_BANDS)), "center_id", "lead_time_band")
    return row_shares(cells, "center_id")


def reasons_by_centre(fa: DataFrame) -> DataFrame:
    """Cancellation reasons per centre with the share of the centre's reasons."""
    return row_shares(crosstab(fa.where("is_cancelled"), "center_id", "cancellation_reason"), "center_id")
