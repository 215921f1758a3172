"""Capacity projections and impact estimates.

All models read the centre-day table of ``daily_load``; job rows are not touched again. Rates
of a response curve are looked up by load band (at most eleven bands, broadcast).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bayworks.config import LOAD_EDGES, Config
from bayworks.functions.scalars import flag, load_band, mean, ratio, share
from bayworks.plans import metrics as M


@dataclass(frozen=True)
class Plan:
    """Which centres the estimates are about."""

    focus: object
    benchmark: object
    capacity: tuple = ()
    hot: tuple = ()
    parts: object = None


def one_row(*sides: DataFrame) -> DataFrame:
    """One-row results side by side."""
    out = sides[0]
    for side in sides[1:]:
        out = out.crossJoin(F.broadcast(side))
    return out


def response_curve(daily: DataFrame) -> DataFrame:
    """Network on-time rate by load band, job-weighted."""
    banded = daily.withColumn("band", load_band("load_ratio", LOAD_EDGES)).where(F.col("band").isNotNull())
    return banded.groupBy("band").agg(ratio(F.sum("on_time_jobs"), F.sum("jobs")).alias("rate"))


def with_delta(days: DataFrame, curve: DataFrame, new_load: Column) -> DataFrame:
    """Change of the curve rate when a day's load moves to ``new_load``; null off the curve."""
    now = F.broadcast(curve.select(F.col("band").alias("_b0"), F.col("rate").alias("_r0")))
    then = F.broadcast(curve.select(F.col("band").alias("_b1"), F.col("rate").alias("_r1")))
    return (
        days.withColumn("new_load", new_load)
        .join(now, load_band("load_ratio", LOAD_EDGES) == F.col("_b0"), "left")
        .join(then, load_band("new_load", LOAD_EDGES) == F.col("_b1"), "left")
        .withColumn("delta", F.col("_r1") - F.col("_r0"))
        .drop("_b0", "_r0", "_b1", "_r1")
    )


def weighted_delta(when: Column | None = None) -> Column:
    """Mean delta per job, over the days that have one."""
    use = F.col("delta").isNotNull() if when is None else F.col("delta").isNotNull() & when
    return ratio(F.sum(F.when(use, F.col("delta") * F.col("jobs"))), F.sum(F.when(use, F.col("jobs"))))


def on_time(when: Column | None = None) -> Column:
    if when is None:
        return ratio(F.sum("on_time_jobs"), F.sum("jobs"))
    return ratio(F.sum(F.when(when, F.col("on_time_jobs"))), F.sum(F.when(when, F.col("jobs"))))


def add_technicians(
    daily: DataFrame, ftm: DataFrame, staff: DataFrame, center_id, cfg: Config, extra: int = 1
) -> DataFrame:
    """Utilisation and on-time at a centre with ``extra`` more technicians."""
    heads = staff.agg(F.count_if(F.col("center_id") == center_id).alias("technicians_now"))
    days = daily.where((F.col("center_id") == center_id) & (F.col("year") == cfg.focus_year))
    scale = F.col("technicians_now") / (F.col("technicians_now") + extra)
    days = days.crossJoin(F.broadcast(heads))
    moved = with_delta(days, response_curve(daily), F.col("load_ratio") * scale)
    jobs = moved.agg(
        ratio(F.sum("jobs"), F.countDistinct("month")).alias("jobs_per_month"),
        share(flag(F.col("load_ratio") > 1)).alias("overloaded_day_share_now"),
        share(flag(F.col("new_load") > 1)).alias("overloaded_day_share_projected"),
        on_time().alias("on_time_now"),
        weighted_delta().alias("on_time_delta_pts"),
    )
    load = M.focus_months(ftm, cfg).where(F.col("center_id") == center_id).agg(
        ratio(F.sum("service_hours"), F.sum("available_hours")).alias("utilisation_now")
    )
    return one_row(jobs, load, heads).select(
        F.lit(center_id).alias("center_id"),
        "technicians_now",
        (F.col("technicians_now") + extra).alias("technicians_new"),
        "jobs_per_month",
        "utilisation_now",
        (F.col("utilisation_now") * scale).alias("utilisation_projected"),
        "overloaded_day_share_now",
        "overloaded_day_share_projected",
        "on_time_now",
        F.least(F.lit(1.0), F.col("on_time_now") + F.col("on_time_delta_pts")).alias("on_time_projected"),
        "on_time_delta_pts",
        (F.col("on_time_delta_pts") * F.col("jobs_per_month")).alias("extra_on_time_jobs_per_month"),
    )


def shift_saturday(daily: DataFrame, cfg: Config, shift: float = 0.15) -> DataFrame:
    """Move part of the hours booked ahead for Saturday to the next Tuesday-Thursday.

    Hours that would go to a day without jobs are dropped, as published.
    """
    days = daily.where(F.col("year") == cfg.focus_year)
    saturday = F.col("weekday") == "Saturday"
    moved = F.col("booked_ahead_hours").cast("double") * shift
    received = (
        days.where(saturday)
        .select("center_id", "service_date", moved.alias("_m"), F.explode(F.array(*map(F.lit, (3, 4, 5)))).alias("_k"))
        .groupBy("center_id", F.expr("date_add(service_date, _k)").alias("service_date"))
        .agg(F.sum(F.col("_m") / 3).alias("_add"))
    )
    cap = ratio("booked_hours", "load_ratio")
    kept = F.when(saturday, (F.col("booked_hours").cast("double") - moved) / cap).otherwise(F.col("load_ratio"))
    joined = days.join(received, ["center_id", "service_date"], "left")
    new_load = kept + F.coalesce("_add", F.lit(0.0)) / cap
    f = with_delta(joined, response_curve(daily), new_load)
    midweek = F.col("weekday").isin("Tuesday", "Wednesday", "Thursday")
    rated = midweek & F.col("delta").isNotNull()
    return f.agg(
        on_time(saturday).alias("saturday_on_time_now"),
        (on_time(saturday) + weighted_delta(saturday)).alias("saturday_on_time_projected"),
        on_time(midweek).alias("tue_thu_on_time_now"),
        (on_time(rated) + weighted_delta(midweek)).alias("tue_thu_on_time_projected"),
        on_time().alias("network_on_time_now"),
        (on_time() + weighted_delta()).alias("network_on_time_projected"),
        ratio(F.sum(F.col("delta") * F.col("jobs")), F.countDistinct("month")).alias("extra_on_time_jobs_per_month"),
        ratio(
            F.sum(F.when(saturday, F.col("booked_ahead_hours"))), F.sum(F.when(saturday, F.col("booked_hours")))
        ).alias("booked_share_of_saturday_hours"),
    ).select(F.lit(shift).alias("shift_share_of_booked_saturday_hours"), "*")


def saturday_capacity(
    daily: DataFrame, staff: DataFrame, centres: Sequence, cfg: Config, extra_hours: float = 2.0
) -> DataFrame:
    """Longer Saturdays at some centres, with the overtime paid at twice the hourly cost."""
    year = daily.where(F.col("year") == cfg.focus_year)
    months = year.agg(F.countDistinct("month").alias("_months"))
    days = year.where((F.col("weekday") == "Saturday") & F.col("center_id").isin(*centres))
    scale = cfg.productive_hours / (cfg.productive_hours + extra_hours)
    f = with_delta(days, response_curve(daily), F.col("load_ratio") * scale)
    out = f.agg(
        F.sum("jobs").alias("_jobs"),
        on_time().alias("saturday_on_time_now"),
        (on_time() + weighted_delta()).alias("saturday_on_time_projected"),
        F.sum(F.col("delta") * F.col("jobs")).alias("_extra"),
        ratio(F.sum("wait_sum"), F.sum("wait_n")).alias("saturday_wait_now_h"),
        F.countDistinct("service_date").alias("_saturdays"),
    )
    pay = staff.where(F.col("center_id").isin(*centres)).agg(F.sum("hourly_cost").alias("_pay"))
    per_month = ratio("_saturdays", "_months")
    return one_row(out, months, pay).select(
        F.lit(",".join(map(str, centres))).alias("centres"),
        F.lit(extra_hours).alias("extra_hours_per_tech"),
        ratio("_jobs", "_months").alias("saturday_jobs_per_month"),
        "saturday_on_time_now",
        "saturday_on_time_projected",
        ratio("_extra", "_months").alias("extra_on_time_jobs_per_month"),
        "saturday_wait_now_h",
        per_month.alias("saturdays_per_month"),
        (F.col("_pay").cast("double") * extra_hours * 2 * per_month).alias("overtime_cost_per_month_at_2x"),
    )


# ---- impact estimates -------------------------------------------------------------------
def peers_median(rates: DataFrame, center_id, rate: str, mine: str, others: str) -> DataFrame:
    """A centre's rate and the median of the other centres, as one row."""
    own = F.col("center_id") == center_id
    return rates.agg(
        F.max(F.when(own, F.col(rate))).alias(mine), F.median(F.when(~own, F.col(rate))).alias(others)
    )


def cancellation_recovery(fs: DataFrame, fa: DataFrame, plan: Plan, cfg: Config) -> DataFrame:
    """Bookings won back if the focus centre cancelled like the median of the others."""
    jobs, appts = M.focus(fs, cfg), M.focus(fa, cfg)
    own = F.col("center_id") == plan.focus
    rates = M.known(appts, ["center_id"]).groupBy("center_id").agg(share("is_cancelled").alias("r"))
    demand = appts.agg(
        F.count_if(own).alias("_n"), share(F.when(own, F.col("is_completed"))).alias("completion_rate")
    )
    money = jobs.agg(
        F.countDistinct("month").alias("_months"),
        mean(F.when(own, F.col("revenue"))).alias("revenue_per_job"),
        mean(F.when(own, F.col("profit"))).alias("profit_per_job"),
    )
    row = one_row(peers_median(rates, plan.focus, "r", "cancel_rate", "other_centres_median"), demand, money)
    per_month = ratio("_n", "_months")
    won = (F.col("cancel_rate") - F.col("other_centres_median")) * per_month * F.col("completion_rate")
    return row.select(
        "cancel_rate", "other_centres_median",
        per_month.alias("appointments_per_month"),
        "completion_rate",
        won.alias("recovered_jobs_per_month"),
        "revenue_per_job", "profit_per_job",
        (won * F.col("revenue_per_job")).alias("recovered_revenue_per_month"),
        (won * F.col("profit_per_job")).alias("recovered_profit_per_month"),
    )


def focus_context(fs: DataFrame, staff: DataFrame, ftm: DataFrame, plan: Plan, cfg: Config) -> DataFrame:
    """Size and growth of the focus centre, and a senior hire against its profit."""
    own = F.col("center_id") == plan.focus
    now = own & (F.col("year") == cfg.focus_year)
    before = own & (F.col("year") == cfg.base_year) & (F.col("month_num") <= cfg.compare_months)
    row = fs.agg(
        F.countDistinct(F.when(F.col("year") == cfg.focus_year, F.col("month"))).alias("_months"),
        F.sum(F.when(now, F.col("profit"))).alias("_profit"),
        F.sum(F.when(now, F.col("revenue"))).alias("_revenue"),
        F.count_if(before).alias("jobs_base_year"),
        F.count_if(now).alias("jobs_focus_year"),
    )
    hire = M.technician_monthly_cost(staff, ftm, "Senior").select("monthly_cost")
    profit = ratio("_profit", "_months")
    return one_row(row, hire).select(
        profit.alias("profit_per_month"),
        ratio("_revenue", "_months").alias("revenue_per_month"),
        "jobs_base_year", "jobs_focus_year",
        (ratio("jobs_focus_year", "jobs_base_year") - 1).alias("jobs_yoy_growth"),
        ratio("monthly_cost", profit).alias("hire_cost_share_of_profit"),
    )


def parts_recovery(fs: DataFrame, lines: DataFrame, plan: Plan, cfg: Config) -> DataFrame:
    """Parts delays at one centre brought to the median of the others, and the stock for it."""
    year = M.focus(fs, cfg)
    own = F.col("center_id") == plan.parts
    delayed, hard = F.col("parts_delay_flag"), F.col("service_type").isin(*cfg.complex_types)
    rates = M.known(year, ["center_id"]).groupBy("center_id").agg(share("parts_delay_flag").alias("r"))
    jobs = year.agg(
        F.countDistinct("month").alias("_months"),
        F.count_if(own).alias("_n"),
        share(F.when(own & ~delayed, F.col("on_time_flag"))).alias("_ok"),
        (
            mean(F.when(own & delayed, F.col("turnaround_hours")))
            - mean(F.when(own & ~delayed, F.col("turnaround_hours")))
        ).alias("tat_gap_delayed_vs_not_h"),
    )
    always = fs.agg(
        share(F.when(own & hard, delayed)).alias("parts_delay_complex_jobs_all_period"),
        share(F.when(own & ~hard, delayed)).alias("parts_delay_other_jobs_all_period"),
    )
    stock = M.safety_stock(lines, plan.parts, cfg).agg(
        F.count(F.lit(1)).alias("safety_stock_parts"),
        F.coalesce(F.sum("stock_value"), F.lit(0)).cast("double").alias("safety_stock_value"),
    )
    row = one_row(
        peers_median(rates, plan.parts, "r", "parts_delay_rate", "other_centres_median"), jobs, always, stock
    )
    per_month = ratio("_n", "_months")
    avoided = (F.col("parts_delay_rate") - F.col("other_centres_median")) * per_month
    return row.select(
        "parts_delay_rate", "other_centres_median",
        per_month.alias("jobs_per_month"),
        avoided.alias("avoided_delayed_jobs_per_month"),
        (avoided * F.col("_ok")).alias("extra_on_time_jobs_per_month"),
        (avoided * F.col("tat_gap_delayed_vs_not_h")).alias("turnaround_hours_saved_per_month"),
        "tat_gap_delayed_vs_not_h", "parts_delay_complex_jobs_all_period", "parts_delay_other_jobs_all_period",
        "safety_stock_parts", "safety_stock_value",
        (F.col("safety_stock_value") * 0.20).alias("safety_stock_carrying_cost_pa_at_20pct"),
    )


def skill_uplift(fs: DataFrame, cfg: Config) -> DataFrame:
    """Juniors brought to the level of the next skill."""
    year = M.focus(fs, cfg)

    def at(level: str, expr: str) -> Column:
        return F.when(F.col("skill_level") == level, F.col(expr))

    row = year.agg(
        ratio(F.count_if(F.col("skill_level") == "Junior"), F.countDistinct("month")).alias("junior_jobs_per_month"),
        share(at("Junior", "caused_repeat_visit")).alias("junior_comeback"),
        share(at("Mid", "caused_repeat_visit")).alias("mid_comeback"),
        share(at("Junior", "qc_passed_first_time")).alias("junior_qc"),
        share(at("Mid", "qc_passed_first_time")).alias("mid_qc"),
        mean(at("Junior", "duration_variance_hours")).alias("junior_duration_var_h"),
        mean(at("Mid", "duration_variance_hours")).alias("mid_duration_var_h"),
    )
    row = one_row(row, M.rework_cost(year).select("rework_avg_cost"))
    n = F.col("junior_jobs_per_month")
    back = (F.col("junior_comeback") - F.col("mid_comeback")) * n
    return row.select(
        "*",
        back.alias("avoided_comebacks_per_month"),
        ((F.col("mid_qc") - F.col("junior_qc")) * n).alias("avoided_qc_failures_per_month"),
        (back * F.col("rework_avg_cost")).alias("rework_cost_avoided_per_month"),
        ((F.col("junior_duration_var_h") - F.col("mid_duration_var_h")) * n).alias("labour_hours_saved_per_month"),
    )


def booking_window(fs: DataFrame, fa: DataFrame, plan: Plan, cfg: Config) -> DataFrame:
    """Bookings more than a week ahead cancelled only as often as those of 4-7 days."""
    year = M.focus(fa, cfg)
    long = F.col("lead_time_band").isin("8-14 days", "15+ days")
    own = F.col("center_id") == plan.focus
    demand = year.agg(
        F.count_if(long).alias("_long"),
        share(F.when(long, F.col("is_cancelled"))).alias("long_lead_cancel_rate"),
        share(F.when(F.col("lead_time_band") == "4-7 days", F.col("is_cancelled"))).alias("target_rate_4_7_days"),
        share("is_completed").alias("_done"),
        share(F.when(own, long)).alias("focus_long_lead_share"),
        share(long).alias("network_long_lead_share"),
    )
    money = M.focus(fs, cfg).agg(
        F.countDistinct("month").alias("_months"), mean("revenue").alias("_rev"), mean("profit").alias("_pro")
    )
    per_month = ratio("_long", "_months")
    won = (F.col("long_lead_cancel_rate") - F.col("target_rate_4_7_days")) * per_month * F.col("_done")
    return one_row(demand, money).select(
        per_month.alias("long_lead_appointments_per_month"),
        "long_lead_cancel_rate", "target_rate_4_7_days",
        won.alias("recovered_jobs_per_month"),
        (won * F.col("_rev")).alias("recovered_revenue_per_month"),
        (won * F.col("_pro")).alias("recovered_profit_per_month"),
        "focus_long_lead_share", "network_long_lead_share",
    )


def estimate_discipline(fs: DataFrame, cfg: Config) -> DataFrame:
    """Overrun and satisfaction with and without additional work, in the focus year."""
    d = M.overrun_drivers(M.focus(fs, cfg))

    def at(found: bool, c: str) -> Column:
        return F.max(F.when(F.col("additional_work_found") == found, F.col(c)))

    return d.agg(
        at(True, "share_of_jobs").alias("additional_work_share"),
        at(True, "overrun").alias("overrun_rate_with_additional_work"),
        at(False, "overrun").alias("overrun_rate_without"),
        at(True, "csat").alias("csat_with_additional_work"),
        at(False, "csat").alias("csat_without"),
    )
