"""KPI library. Every function takes already filtered fact tables and returns a DataFrame.

Ratios are fractions; an undefined ratio or mean is null. Rows with a null group key are left
out of grouped results.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bayworks.config import LATE_EDGES, WEEKDAYS, Config
from bayworks.functions.scalars import (
    all_of,
    band,
    band_labels,
    mean,
    position_in,
    ratio,
    rounded_to,
    share,
    weekday_name,
)
from bayworks.operators.shape import label_frame, mean_matrix, present_in_order, value_shares


def cost() -> Column:
    return F.col("labor_cost") + F.col("parts_cost")


def zero_sum(c: Column | str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def known(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.where(all_of(*[F.col(k).isNotNull() for k in keys]))


# ---- measure sets -------------------------------------------------------------------
@dataclass(frozen=True)
class Over:
    """What a measure is aggregated from: job rows, or stored cells of them.

    ``total`` and ``present`` take the name of an input: its sum, and how often it is not null.
    """

    n: Column
    total: Callable[[str], Column]
    present: Callable[[str], Column]

    def zero(self, name: str) -> Column:
        return F.coalesce(self.total(name), F.lit(0))

    def mean(self, name: str) -> Column:
        return ratio(self.total(name), self.present(name))


def derived_inputs(cfg: Config) -> dict[str, Column]:
    """Inputs of measures that are not columns of the facts."""
    return {"cost": cost(), "csat": F.col("rating") >= cfg.csat_threshold}


#: Inputs that are true or false; their mean is a share.
FLAGS = {"cost_overrun_flag", "on_time_flag", "csat", "caused_repeat_visit", "parts_delay_flag", "qc_passed_first_time"}


def input_value(name: str, cfg: Config) -> Column:
    c = derived_inputs(cfg).get(name, F.col(name))
    return c.cast("int") if name in FLAGS else c


def rows(cfg: Config) -> Over:
    """Measures straight from job rows."""
    return Over(
        F.count(F.lit(1)), lambda name: F.sum(input_value(name, cfg)), lambda name: F.count(input_value(name, cfg))
    )


def additive_measures(over: Over) -> dict[str, Column]:
    """Work-order measures made of sums and counts, by name."""
    total, revenue = over.zero("cost"), over.zero("revenue")
    return {
        "work_orders": over.n,
        "revenue": revenue,
        "labor_cost": over.zero("labor_cost"),
        "parts_cost": over.zero("parts_cost"),
        "total_cost": total,
        "profit": revenue - total,
        "margin_pct": ratio(revenue - total, revenue),
        "parts_share": ratio(over.zero("parts_cost"), total),
        "avg_service_cost": ratio(total, over.n),
        "cost_variance": over.zero("cost_variance"),
        "cost_overrun_rate": over.mean("cost_overrun_flag"),
        "on_time_pct": over.mean("on_time_flag"),
        "avg_turnaround": over.mean("turnaround_hours"),
        "avg_wait": over.mean("wait_hours"),
        "avg_duration_variance": over.mean("duration_variance_hours"),
        "avg_rating": over.mean("rating"),
        "csat_pct": over.mean("csat"),
        "rated_orders": over.present("rating"),
        "comeback_rate": over.mean("caused_repeat_visit"),
        "parts_delay_rate": over.mean("parts_delay_flag"),
        "qc_first_pass_rate": over.mean("qc_passed_first_time"),
    }


def job_measures(cfg: Config) -> dict[str, Column]:
    """All work-order measures of job rows as aggregate expressions, by name."""
    return {**additive_measures(rows(cfg)), "median_turnaround": F.median("turnaround_hours")}


def grouped_extra(over: Over) -> dict[str, Column]:
    return {
        "avg_cost_variance_pct": over.mean("cost_variance_pct"),
        "avg_est_hours": over.mean("estimated_hours"),
        "avg_actual_hours": over.mean("actual_hours"),
    }


def appointment_measures() -> dict[str, Column]:
    n = F.count(F.lit(1))
    return {
        "appointments": n,
        "cancelled": F.count_if("is_cancelled"),
        "no_shows": F.count_if("is_no_show"),
        "cancellation_rate": ratio(F.count_if("is_cancelled"), n),
        "no_show_rate": ratio(F.count_if("is_no_show"), n),
    }


def aliased(measures: dict[str, Column]) -> list[Column]:
    return [m.alias(name) for name, m in measures.items()]


def repeat_rate_by(fact: DataFrame, keys: Sequence[str], cfg: Config) -> DataFrame:
    """Customers with enough jobs over customers with any, per group."""
    per_customer = known(fact, ["customer_id"]).groupBy(*keys, "customer_id").agg(F.count(F.lit(1)).alias("_n"))
    flagged = share(F.col("_n") >= cfg.repeat_min_orders).alias("repeat_visit_rate")
    return per_customer.groupBy(*keys).agg(flagged) if keys else per_customer.agg(flagged)


def fact_kpis(fact: DataFrame, cfg: Config) -> DataFrame:
    """One row with all work-order KPIs."""
    one = fact.agg(*aliased(job_measures(cfg)))
    return one.crossJoin(F.broadcast(repeat_rate_by(fact, [], cfg)))


def appointment_kpis(appts: DataFrame) -> DataFrame:
    m = appointment_measures()
    return appts.agg(*aliased({k: m[k] for k in ("appointments", "cancellation_rate", "no_show_rate")}))


def utilisation(tech: DataFrame) -> DataFrame:
    return tech.agg(ratio(F.sum("service_hours"), F.sum("available_hours")).alias("utilisation"))


def headline(fact: DataFrame, appts: DataFrame, tech: DataFrame, cfg: Config) -> DataFrame:
    """The canonical KPIs: three one-row results side by side."""
    return (
        fact_kpis(fact, cfg)
        .crossJoin(F.broadcast(appointment_kpis(appts)))
        .crossJoin(F.broadcast(utilisation(tech)))
    )


def group_kpis(fact: DataFrame, keys: Sequence[str], cfg: Config) -> DataFrame:
    """All work-order KPIs per group."""
    jobs = known(fact, keys)
    out = jobs.groupBy(*keys).agg(*aliased({**job_measures(cfg), **grouped_extra(rows(cfg))}))
    return out.join(repeat_rate_by(jobs, keys, cfg), list(keys), "left")


def monthly_trend(fact: DataFrame, cfg: Config) -> DataFrame:
    """KPIs per month with month-over-month change."""
    return with_growth(group_kpis(fact, ["month"], cfg))


def with_growth(trend: DataFrame) -> DataFrame:
    """Month-over-month change of revenue and profit; the window sees one row per month."""
    w = Window.orderBy("month")
    return trend.select(
        "*",
        (ratio("revenue", F.lag("revenue").over(w)) - 1).alias("revenue_mom_pct"),
        (ratio(F.col("profit") - F.lag("profit").over(w), F.lag("profit").over(w))).alias("profit_mom_pct"),
    ).orderBy("month")


def service_type_performance(fact: DataFrame, cfg: Config) -> DataFrame:
    return group_kpis(fact, ["service_type"], cfg).orderBy(F.desc("revenue"), "service_type")


def appointment_rates(appts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return known(appts, keys).groupBy(*keys).agg(*aliased(appointment_measures()))


def cancellation_by(appts: DataFrame, key: str, order: Sequence[str] | None = None) -> DataFrame:
    """Cancellation and no-show rates, in a fixed label order when one is given."""
    out = appointment_rates(appts, [key])
    return out.orderBy(position_in(key, order)) if order else out


def cancellation_reasons(appts: DataFrame) -> DataFrame:
    out = value_shares(appts.where("is_cancelled"), "cancellation_reason", "cancellations")
    return out.orderBy(F.desc("cancellations"), "cancellation_reason")


def average_rank(value: str, descending: bool = False) -> Column:
    """Percentile rank with ties averaged, nulls excluded; for one row per group member."""
    c = F.col(value)
    ordered = Window.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last())
    ties = F.count(F.lit(1)).over(Window.partitionBy(c))
    size = F.count(c).over(Window.partitionBy())
    return F.when(c.isNotNull(), ratio(F.rank().over(ordered) + (ties - 1) / 2.0, size))


def centre_scorecard(fact: DataFrame, appts: DataFrame, tech: DataFrame, cfg: Config) -> DataFrame:
    """One row per centre with a composite score (mean percentile rank) and its rank."""
    base = group_kpis(fact, ["center_name", "region"], cfg)
    demand = appointment_rates(appts, ["center_name"]).drop("cancelled", "no_shows")
    load = utilisation_by(tech, ["center_name"]).select("center_name", "utilisation")
    return with_score(base.join(demand, "center_name", "left").join(load, "center_name", "left"))


def with_score(card: DataFrame) -> DataFrame:
    """Score and rank of each centre; the windows run over one row per centre."""
    ranks = F.array(
        average_rank("on_time_pct"),
        average_rank("avg_rating"),
        average_rank("margin_pct"),
        average_rank("avg_turnaround", descending=True),
        average_rank("cancellation_rate", descending=True),
    )
    scored = card.withColumn("_r", F.filter(ranks, lambda x: x.isNotNull())).withColumn(
        "performance_score",
        rounded_to(
            ratio(F.aggregate("_r", F.lit(0.0), lambda a, x: a + x), F.size("_r")), 12
        ),
    )
    place = F.rank().over(Window.orderBy(F.col("performance_score").desc_nulls_last()))
    return scored.drop("_r").withColumn("rank", place).orderBy("rank", "center_name")


def index_against_average(scorecard: DataFrame) -> DataFrame:
    """Performance index (0-100), the average index, and whether each centre reaches it."""
    index = F.col("performance_score") * 100
    out = scorecard.select("center_name", index.alias("performance_index"))
    average = F.avg("performance_index").over(Window.partitionBy())
    return out.withColumn("average_index", average).withColumn(
        "at_or_above", F.col("performance_index") >= F.col("average_index") - 1e-9
    )


def utilisation_by(tech: DataFrame, keys: Sequence[str]) -> DataFrame:
    return known(tech, keys).groupBy(*keys).agg(
        F.sum("jobs").alias("jobs"),
        F.sum("service_hours").alias("service_hours"),
        F.sum("available_hours").alias("available_hours"),
        ratio(F.sum("service_hours"), F.sum("available_hours")).alias("utilisation"),
    )


def technician_scorecard(fact: DataFrame, tech: DataFrame, cfg: Config) -> DataFrame:
    """Load and quality per technician; attributes are constant within a technician."""
    load = known(tech, ["technician_id"]).groupBy("technician_id").agg(
        F.sum("jobs").alias("jobs"),
        F.sum("service_hours").alias("service_hours"),
        F.sum("available_hours").alias("available_hours"),
        ratio(F.sum("service_hours"), F.sum("available_hours")).alias("utilisation"),
        F.max("skill_level").alias("skill_level"),
        F.max("center_name").alias("center_name"),
        F.sum("comebacks_caused").alias("comebacks_caused"),
    )
    names = (
        "work_orders", "on_time_pct", "avg_rating", "qc_first_pass_rate", "comeback_rate", "avg_duration_variance",
    )
    measures = job_measures(cfg)
    quality = known(fact, ["technician_id"]).groupBy("technician_id").agg(
        *aliased({n: measures[n] for n in names})
    )
    return load.join(quality, "technician_id", "left").orderBy(
        F.desc("utilisation"), "technician_id"
    )


def utilisation_matrix(tech: DataFrame, months: Sequence[str]) -> DataFrame:
    """Technician rows, one utilisation column per month of the period."""
    cells = known(tech, ["technician_id", "month"]).groupBy("technician_id", "month").agg(
        ratio(F.sum("service_hours"), F.sum("available_hours")).alias("u")
    )
    return cells.groupBy("technician_id").pivot("month", list(months)).agg(F.max("u"))


# ---- distributions --------------------------------------------------------------------
def delay_distribution(
    fact: DataFrame,
    column: str = "late_hours",
    edges: Sequence[float] = LATE_EDGES,
    first: str | None = "On time",
) -> DataFrame:
    """Jobs per right-closed band, every band present, with shares."""
    labels = band_labels(edges, first)
    counts = (
        fact.where(F.col(column).isNotNull())
        .groupBy(band(column, edges, labels).alias("band"))
        .agg(F.count(F.lit(1)).alias("work_orders"))
    )
    full = label_frame(fact, "band", labels).join(counts, "band", "left")
    full = full.withColumn("work_orders", F.coalesce("work_orders", F.lit(0)))
    whole = F.sum("work_orders").over(Window.partitionBy())
    return full.withColumn("share", ratio("work_orders", whole)).orderBy("_order").drop("_order")


def wait_by_weekday(fact: DataFrame) -> DataFrame:
    cut = fact.groupBy(weekday_name("service_date").alias("weekday")).agg(
        mean("wait_hours").alias("avg_wait"), F.count("work_order_id").alias("work_orders")
    )
    return present_in_order(cut, "weekday", WEEKDAYS)


def rating_matrix(fact: DataFrame, index: str, columns: str, labels: Sequence[str] | None = None) -> DataFrame:
    """Mean rating; rows without any rating are left out."""
    return mean_matrix(fact.where(F.col("rating").isNotNull()), index, columns, "rating", labels)


def feedback_distribution(fact: DataFrame) -> DataFrame:
    out = value_shares(fact, "feedback_category", "responses")
    return out.orderBy(F.desc("responses"), "feedback_category")


def parts_by_category(part_usage: DataFrame, parts: DataFrame, fact: DataFrame) -> DataFrame:
    """Catalogue parts cost per category for the filtered jobs."""
    lines = (
        part_usage.join(fact.select("work_order_id"), "work_order_id", "left_semi")
        .join(parts.select("part_id", "part_category", "unit_cost"), "part_id", "left")
        .where(F.col("part_category").isNotNull())
    )
    out = lines.groupBy("part_category").agg(
        F.sum("quantity").alias("quantity"),
        F.sum(F.col("quantity") * F.col("unit_cost")).cast("decimal(24,2)").alias("parts_cost"),
    )
    whole = F.sum("parts_cost").over(Window.partitionBy())
    return out.withColumn("share", ratio("parts_cost", whole)).orderBy(F.desc("parts_cost"), "part_category")


def skill_table(fact: DataFrame, cfg: Config) -> DataFrame:
    """KPIs by skill level in skill order, only levels that occur."""
    return present_in_order(group_kpis(fact, ["skill_level"], cfg), "skill_level", cfg.skills)


# ---- table decorations ----------------------------------------------------------------
def tercile_flag(df: DataFrame, column: str, better: str, name: str) -> DataFrame:
    """'good' / 'bad' for the best and worst third of a result table; needs 3 distinct values."""
    limits = df.agg(
        F.countDistinct(column).alias("_d"),
        F.percentile(column, F.array(F.lit(1.0 / 3), F.lit(2.0 / 3))).alias("_p"),
    )
    low, high, v = F.col("_p")[0], F.col("_p")[1], F.col(column)
    good, bad = (v >= high, v <= low) if better == "high" else (v <= low, v >= high)
    verdict = F.when(F.col("_d") >= 3, F.when(good, "good").when(bad, "bad").otherwise("")).otherwise("")
    return df.crossJoin(F.broadcast(limits)).withColumn(name, verdict).drop("_d", "_p")


def better_than(value: Column, reference: Column, higher: bool = True) -> Column:
    """'accent' when a value reaches the reference, 'warn' when it trails, else 'neutral'."""
    good = value >= reference if higher else value <= reference
    return F.when(value.isNull() | reference.isNull(), "neutral").when(good, "accent").otherwise("warn")
