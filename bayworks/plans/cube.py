"""Slicer cube: facts folded to cells that any selection can be put together from.

A cell is one day (or month), centre, region, service type and model. Sums and counts add
up; medians come from value histograms and repeat customers from visits per customer, both
kept by cell, so a selection gives exactly what the facts would. A page is one pass over the
cells for all its levels at once: the total, every month, every centre.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bayworks.config import Config
from bayworks.functions.scalars import ratio
from bayworks.operators.filters import Selection, apply_selection
from bayworks.plans import kpis

JOB_KEYS = ("service_date", "month", "center_name", "region", "service_type", "model")
BOOKING_KEYS = ("scheduled_date", "month", "center_name", "region", "requested_service_type", "model")
LOAD_KEYS = ("month", "center_name", "region")
INPUTS = (
    "revenue", "labor_cost", "parts_cost", "cost", "cost_variance", "cost_variance_pct", "turnaround_hours", "wait_hours",
    "duration_variance_hours", "estimated_hours", "actual_hours", "rating", *sorted(kpis.FLAGS),
)
#: Cube table -> the fact whose slicers apply to it.
SLICED_AS = {"jobs": "fact", "hours": "fact", "visits": "fact", "bookings": "appts", "load": "tech"}
#: Page levels and the keys each is grouped by.
LEVELS = {"total": (), "month": ("month",), "centre": ("center_name", "region")}
_KEYS = ("month", "center_name", "region")
_COUNTS = ("work_orders", "revenue", "labor_cost", "parts_cost", "total_cost", "profit", "cost_variance", "rated_orders", "appointments")


def build(fact: DataFrame, appts: DataFrame, tech: DataFrame, cfg: Config) -> dict[str, DataFrame]:
    """The cube's tables; each is one grouping of one fact, pre-aggregated before its shuffle."""
    states = [F.count(F.lit(1)).alias("n")]
    for name in INPUTS:
        value = kpis.input_value(name, cfg)
        states += [F.sum(value).alias(f"{name}__sum"), F.count(value).alias(f"{name}__n")]
    timed = fact.where("turnaround_hours is not null")
    return {
        "jobs": fact.groupBy(*JOB_KEYS).agg(*states),
        "hours": timed.groupBy(*JOB_KEYS, "turnaround_hours").agg(F.count(F.lit(1)).alias("n")),
        "visits": fact.where("customer_id is not null").groupBy(*JOB_KEYS, "customer_id").agg(F.count(F.lit(1)).alias("n")),
        "bookings": appts.groupBy(*BOOKING_KEYS).agg(
            F.count(F.lit(1)).alias("n"), F.count_if("is_cancelled").alias("cancelled"), F.count_if("is_no_show").alias("no_shows")
        ),
        "load": tech.groupBy(*LOAD_KEYS).agg(
            F.sum("jobs").alias("jobs"), F.sum("service_hours").alias("service_hours"), F.sum("available_hours").alias("available_hours")
        ),
    }


def sliced(cube: Mapping[str, DataFrame], chosen: Selection) -> dict[str, DataFrame]:
    """The cells that satisfy a selection."""
    return {name: apply_selection(df, chosen, SLICED_AS[name]) for name, df in cube.items()}


def over_cells() -> kpis.Over:
    return kpis.Over(F.sum("n"), lambda name: F.sum(f"{name}__sum"), lambda name: F.coalesce(F.sum(f"{name}__n"), F.lit(0)))


def _level() -> Column:
    by_month, by_centre = F.grouping("month") == 0, F.grouping("center_name") == 0
    return F.when(by_month, "month").when(by_centre, "centre").otherwise("total").alias("level")


def _grouped(cells: DataFrame, measures: Sequence[Column], within: Sequence[str] = ()) -> DataFrame:
    """``measures`` for every level in one grouping; ``within`` are further keys of each level.

    Groups whose own key is missing are left out, as in the single results.
    """
    sets = [[*keys, *within] for keys in LEVELS.values()]
    out = cells.groupingSets(sets, *_KEYS, *within).agg(*measures, _level())
    lacks = ((F.col("level") == "month") & F.col("month").isNull()) | (
        (F.col("level") == "centre") & (F.col("center_name").isNull() | F.col("region").isNull())
    )
    return out.where(~lacks)


def page(cube: Mapping[str, DataFrame], cfg: Config) -> DataFrame:
    """One row for the total, each month and each centre, with all KPIs of jobs, bookings and load.

    Everything that adds up, and the histograms, go through one grouping for all levels; only
    visits are folded by customer first. What is joined has a row for each month and centre
    at most. The total is there even if the selection is empty.
    """
    jobs = cube["jobs"].drop("service_date", "service_type", "model")
    hours = cube["hours"].select(*_KEYS, "turnaround_hours", F.col("n").alias("timed"))
    bookings = cube["bookings"].select(*_KEYS, F.col("n").alias("booked"), "cancelled", "no_shows")
    cells = jobs
    for part in (hours, bookings, cube["load"].drop("jobs")):
        cells = cells.unionByName(part, allowMissingColumns=True)
    booked = F.sum("booked")
    found = _grouped(cells, [
        *kpis.aliased({**kpis.additive_measures(over_cells()), **kpis.grouped_extra(over_cells())}),
        F.expr("percentile(turnaround_hours, 0.5D, coalesce(timed, 0))").alias("median_turnaround"),
        booked.alias("appointments"), ratio(F.sum("cancelled"), booked).alias("cancellation_rate"),
        ratio(F.sum("no_shows"), booked).alias("no_show_rate"),
        ratio(F.sum("service_hours"), F.sum("available_hours")).alias("utilisation"),
    ])
    each = _grouped(cube["visits"], [F.sum("n").alias("n")], ["customer_id"])
    repeat = each.groupBy("level", *_KEYS).agg(kpis.share(F.col("n") >= cfg.repeat_min_orders).alias("repeat_visit_rate"))
    # A union and a fold instead of a join on keys that may be null: each cell comes from one input.
    names = [c for c in (*found.columns, *repeat.columns) if c not in ("level", *_KEYS)]
    whole = found.sparkSession.range(1).select(F.lit("total").alias("level"), *(F.lit(None).cast("string").alias(k) for k in _KEYS))
    for p in (found, repeat):
        whole = whole.unionByName(p, allowMissingColumns=True)
    folded = whole.groupBy("level", *_KEYS).agg(*[F.max(c).alias(c) for c in names])
    zero = {c: F.when(F.col("level") == "total", F.coalesce(c, F.lit(0))).otherwise(F.col(c)) for c in _COUNTS}
    return folded.withColumns(zero)


def held(made: DataFrame) -> DataFrame:
    """A page as a local relation, for several visuals: it has a row for each month and centre."""
    return made.sparkSession.createDataFrame(made.toArrow(), made.schema)


def headline(made: DataFrame) -> DataFrame:
    """The KPIs of ``kpis.headline`` from a page."""
    return made.where("level = 'total'").drop("level", *_KEYS, "avg_cost_variance_pct", "avg_est_hours", "avg_actual_hours")


def monthly_trend(made: DataFrame) -> DataFrame:
    """The months of ``kpis.monthly_trend`` from a page; months without jobs have none."""
    rows = made.where("level = 'month' and work_orders is not null")
    return kpis.with_growth(rows.drop("level", "center_name", "region", "appointments", "cancellation_rate", "no_show_rate", "utilisation"))


def centre_scorecard(made: DataFrame) -> DataFrame:
    """The centres of ``kpis.centre_scorecard`` from a page; centres without jobs have no row."""
    return kpis.with_score(made.where("level = 'centre' and work_orders is not null").drop("level", "month"))
