"""Catalogue of named measures, evaluated for any dimensions and slicer selection.

``evaluate`` groups each fact table once, however many measures are asked for, and joins the
small grouped results. A measure whose table has no relation to a dimension is not sliced by
it (utilisation ignores service type and model, for instance).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bayworks.config import LATE_EDGES, LEAD_BANDS, TURNAROUND_EDGES, WEEKDAYS, Config
from bayworks.functions.scalars import (
    band,
    band_labels,
    mean,
    position_in,
    ratio,
    rounded_to,
    share,
    weekday_name,
)
from bayworks.operators.filters import Selection, apply_slicers
from bayworks.operators.shape import extremes
from bayworks.plans.insights import pct1

Facts = Mapping[str, DataFrame]
BLANK = "(Blank)"
UNASSIGNED = "UNASSIGNED"


# ---- import steps of the semantic model -----------------------------------------------
def fill_unassigned(fact: DataFrame) -> DataFrame:
    """Missing technician and skill become named members (ids as text)."""
    out = fact
    if "technician_id" in fact.columns:
        tech = F.coalesce(F.col("technician_id").cast("string"), F.lit(UNASSIGNED))
        out = out.withColumn("technician_id", tech)
    if "skill_level" in fact.columns:
        out = out.withColumn("skill_level", F.coalesce("skill_level", F.lit("Unassigned")))
    return out


def technician_dimension(staff: DataFrame, cfg: Config) -> DataFrame:
    """Technicians plus the unknown member, with the skill sort key."""
    known = staff.withColumn("technician_id", F.col("technician_id").cast("string"))
    values = {"technician_id": UNASSIGNED, "skill_level": "Unassigned", "certification": "Not recorded"}
    unknown = staff.sparkSession.range(1).select(
        *[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in known.schema.fields]
    )
    order = (*cfg.skills, "Unassigned")
    return known.unionByName(unknown).withColumn("skill_sort", position_in("skill_level", order))


def service_type_dimension(appts: DataFrame) -> DataFrame:
    return appts.select(F.col("requested_service_type").alias("service_type")).distinct()


def model_dimension(vehicles: DataFrame) -> DataFrame:
    """One row per model; the smallest category when a model has several."""
    return vehicles.groupBy("model").agg(F.min("vehicle_category").alias("vehicle_category"))


def date_dimension(calendar: DataFrame) -> DataFrame:
    """Calendar with month start, month label and its sort key."""
    return calendar.select(
        "*",
        F.trunc("date", "MM").alias("month_start"),
        F.date_format("date", "MMM yy").alias("month_label"),
        position_in("weekday_name", WEEKDAYS).alias("weekday_sort"),
    )


def sort_keys(df: DataFrame, column: str, labels: Sequence[str], name: str) -> DataFrame:
    return df.withColumn(name, position_in(column, labels))


# ---- dimensions -------------------------------------------------------------------------
LATE_LABELS = band_labels(LATE_EDGES, "On time")
TURN_LABELS = band_labels(TURNAROUND_EDGES)


def _text(c: str) -> Callable[[], Column]:
    return lambda: F.coalesce(F.col(c).cast("string"), F.lit(BLANK))


DIMENSIONS: dict[str, dict[str, Callable[[], Column]]] = {
    "month_start": {
        "fact": lambda: F.trunc("service_date", "MM"),
        "appts": lambda: F.trunc("scheduled_date", "MM"),
        "tech": lambda: F.to_date(F.concat("month", F.lit("-01"))),
    },
    "center_name": {t: _text("center_name") for t in ("fact", "appts", "tech")},
    "region": {t: _text("region") for t in ("fact", "appts", "tech")},
    "service_type": {"fact": _text("service_type"), "appts": _text("requested_service_type")},
    "model": {"fact": _text("model"), "appts": _text("model")},
    "technician_id": {"fact": _text("technician_id"), "tech": _text("technician_id")},
    "skill_level": {"fact": _text("skill_level"), "tech": _text("skill_level")},
    "weekday_name": {"fact": lambda: weekday_name("service_date"), "appts": lambda: weekday_name("scheduled_date")},
    "delay_band": {"fact": lambda: band("late_hours", LATE_EDGES, LATE_LABELS)},
    "turnaround_band": {"fact": lambda: band("turnaround_hours", TURNAROUND_EDGES, TURN_LABELS)},
    "billing_type": {"fact": _text("billing_type")},
    "feedback_category": {"fact": _text("feedback_category")},
    "lead_time_band": {"appts": _text("lead_time_band")},
    "cancellation_reason": {"appts": _text("cancellation_reason")},
    "part_category": {"usage": _text("part_category")},
}
SORTS = {
    "weekday_name": WEEKDAYS,
    "delay_band": LATE_LABELS,
    "turnaround_band": TURN_LABELS,
    "lead_time_band": LEAD_BANDS,
}


def dimension(name: str, table: str) -> Column | None:
    """A dimension column for a table; part lines see the dimensions of their job."""
    made = DIMENSIONS[name].get(table)
    if made is None and table == "usage":
        made = DIMENSIONS[name].get("fact")
    if made is None and table == "customers":
        made = DIMENSIONS[name].get("fact")
    return made() if made else None


# ---- measures ----------------------------------------------------------------------------
@dataclass(frozen=True)
class Measure:
    label: str
    table: str
    build: Callable[[Config], Column]


def _sum(c: str) -> Callable[[Config], Column]:
    return lambda cfg: F.sum(c)


def _rate(c: str) -> Callable[[Config], Column]:
    return lambda cfg: ratio(F.count_if(c), F.count(F.lit(1)))


def _mean(c: str) -> Callable[[Config], Column]:
    return lambda cfg: mean(c)


def cost() -> Column:
    return F.sum("labor_cost") + F.sum("parts_cost")


MEASURES: dict[str, Measure] = {
    "total_revenue": Measure("Total Revenue", "fact", _sum("revenue")),
    "labour_cost": Measure("Labour Cost", "fact", _sum("labor_cost")),
    "parts_cost": Measure("Parts Cost", "fact", _sum("parts_cost")),
    "total_cost": Measure("Total Cost", "fact", lambda cfg: cost()),
    "profit": Measure("Profit", "fact", lambda cfg: F.sum("revenue") - cost()),
    "profit_margin_pct": Measure(
        "Profit Margin %", "fact", lambda cfg: ratio(F.sum("revenue") - cost(), F.sum("revenue"))
    ),
    "avg_service_cost": Measure("Avg Service Cost", "fact", lambda cfg: ratio(cost(), F.count(F.lit(1)))),
    "parts_share_of_cost_pct": Measure(
        "Parts Share of Cost %", "fact", lambda cfg: ratio(F.sum("parts_cost"), cost())
    ),
    "total_estimated_cost": Measure("Total Estimated Cost", "fact", _sum("estimated_cost")),
    "cost_variance": Measure("Cost Variance", "fact", _sum("cost_variance")),
    "cost_variance_pct": Measure(
        "Cost Variance %", "fact", lambda cfg: ratio(F.sum("cost_variance"), F.sum("estimated_cost"))
    ),
    "cost_overrun_rate": Measure("Cost Overrun Rate", "fact", _rate("cost_overrun_flag")),
    "parts_cost_catalogue": Measure("Parts Cost (Catalogue)", "usage", _sum("line_cost")),
    "completed_services": Measure("Completed Services", "fact", lambda cfg: F.count(F.lit(1))),
    "on_time_pct": Measure("On-Time %", "fact", _rate("on_time_flag")),
    "avg_turnaround_hours": Measure("Avg Turnaround Hours", "fact", _mean("turnaround_hours")),
    "median_turnaround_hours": Measure(
        "Median Turnaround Hours", "fact", lambda cfg: F.median("turnaround_hours")
    ),
    "avg_wait_hours": Measure("Avg Wait Hours", "fact", _mean("wait_hours")),
    "avg_estimated_hours": Measure("Avg Estimated Hours", "fact", _mean("estimated_hours")),
    "avg_actual_hours": Measure("Avg Actual Hours", "fact", _mean("actual_hours")),
    "avg_duration_variance_hours": Measure(
        "Avg Duration Variance Hours", "fact", _mean("duration_variance_hours")
    ),
    "parts_delay_rate": Measure("Parts Delay Rate", "fact", _rate("parts_delay_flag")),
    "qc_first_pass_pct": Measure("QC First-Pass %", "fact", _rate("qc_passed_first_time")),
    "comeback_rate": Measure("Comeback Rate", "fact", _rate("caused_repeat_visit")),
    "service_hours": Measure("Service Hours", "tech", _sum("service_hours")),
    "available_hours": Measure("Available Hours", "tech", _sum("available_hours")),
    "technician_utilisation_pct": Measure(
        "Technician Utilisation %", "tech", lambda cfg: ratio(F.sum("service_hours"), F.sum("available_hours"))
    ),
    "avg_rating": Measure("Avg Rating", "fact", _mean("rating")),
    "rated_services": Measure("Rated Services", "fact", lambda cfg: F.count("rating")),
    "csat_pct": Measure("CSAT %", "fact", lambda cfg: share(F.col("rating") >= cfg.csat_threshold)),
    "appointments": Measure("Appointments", "appts", lambda cfg: F.count(F.lit(1))),
    "cancelled_appointments": Measure("Cancelled Appointments", "appts", lambda cfg: F.count_if("is_cancelled")),
    "no_show_appointments": Measure("No-Show Appointments", "appts", lambda cfg: F.count_if("is_no_show")),
    "cancellation_rate": Measure("Cancellation Rate", "appts", _rate("is_cancelled")),
    "no_show_rate": Measure("No-Show Rate", "appts", _rate("is_no_show")),
    "customers": Measure("Customers", "customers", lambda cfg: F.count(F.lit(1))),
    "repeat_customers": Measure(
        "Repeat Customers", "customers", lambda cfg: F.count_if(F.col("_orders") >= cfg.repeat_min_orders)
    ),
    "repeat_visit_rate": Measure(
        "Repeat Visit Rate", "customers", lambda cfg: share(F.col("_orders") >= cfg.repeat_min_orders)
    ),
}


# Columns of the job facts behind measures and dimensions, so a caller can build a lean fact.
_COST = "labor_cost parts_cost"
MEASURE_COLUMNS = {
    "total_revenue": "revenue",
    "labour_cost": "labor_cost",
    "parts_cost": "parts_cost",
    "total_cost": _COST,
    "profit": f"revenue {_COST}",
    "profit_margin_pct": f"revenue {_COST}",
    "avg_service_cost": _COST,
    "parts_share_of_cost_pct": _COST,
    "total_estimated_cost": "estimated_cost",
    "cost_variance": "cost_variance",
    "cost_variance_pct": "cost_variance estimated_cost",
    "cost_overrun_rate": "cost_overrun_flag",
    "parts_cost_catalogue": "work_order_id",
    "on_time_pct": "on_time_flag",
    "avg_turnaround_hours": "turnaround_hours",
    "median_turnaround_hours": "turnaround_hours",
    "avg_wait_hours": "wait_hours",
    "avg_estimated_hours": "estimated_hours",
    "avg_actual_hours": "actual_hours",
    "avg_duration_variance_hours": "duration_variance_hours",
    "parts_delay_rate": "parts_delay_flag",
    "qc_first_pass_pct": "qc_passed_first_time",
    "comeback_rate": "caused_repeat_visit",
    "avg_rating": "rating",
    "rated_services": "rating",
    "csat_pct": "rating",
    "customers": "customer_id",
    "repeat_customers": "customer_id",
    "repeat_visit_rate": "customer_id",
}
DIMENSION_COLUMNS = {
    "month_start": "service_date",
    "weekday_name": "service_date",
    "delay_band": "late_hours",
    "turnaround_band": "turnaround_hours",
}


def fact_columns(names: Sequence[str], dims: Sequence[str], filtered: bool = False) -> str:
    """Job columns needed to evaluate measures by dimensions (and to apply slicers)."""
    wanted = ["work_order_id", "service_date"]
    wanted += [MEASURE_COLUMNS[n] for n in names if n in MEASURE_COLUMNS]
    wanted += [DIMENSION_COLUMNS.get(d, d) for d in dims]
    wanted += ["region center_name service_type model"] if filtered else []
    return " ".join(wanted)


def usage_lines(usage: DataFrame, parts: DataFrame, fact: DataFrame) -> DataFrame:
    """Part lines with catalogue value and the attributes of their (filtered) job."""
    value = (F.col("quantity") * F.col("unit_cost")).cast("decimal(18,2)")
    priced = usage.select("work_order_id", "part_id", "quantity").join(
        parts.select("part_id", "part_category", "unit_cost"), "part_id", "left"
    )
    return priced.join(fact, "work_order_id").withColumn("line_cost", value)


def _full(left: DataFrame, right: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Full join in which a null member of one table meets the null member of the other."""
    other = right.withColumnsRenamed({d: f"_r_{d}" for d in dims})
    same = F.lit(True)
    for d in dims:
        same = same & F.col(d).eqNullSafe(F.col(f"_r_{d}"))
    keys = [F.coalesce(d, f"_r_{d}").alias(d) for d in dims]
    rest = [c for c in (*left.columns, *right.columns) if c not in dims]
    return left.join(other, same, "full").select(*keys, *rest)


def evaluate(facts: Facts, names: Sequence[str], dims: Sequence[str], cfg: Config, filters: Selection | None = None) -> DataFrame:
    """One row per dimension member with the named measures."""
    sliced = apply_slicers(facts, filters) if filters else dict(facts)
    by_table: dict[str, list[str]] = {}
    for n in names:
        by_table.setdefault(MEASURES[n].table, []).append(n)
    out, loose = None, []
    for table, chosen in by_table.items():
        rows = sliced["fact" if table == "customers" else table]
        if table == "usage":
            rows = usage_lines(sliced["usage"], sliced["parts"], sliced["fact"])
        found = {d: dimension(d, table) for d in dims}
        keys = [c.alias(d) for d, c in found.items() if c is not None]
        used = [d for d, c in found.items() if c is not None]
        if table == "customers":
            rows = rows.groupBy(*keys, F.col("customer_id").alias("_c")).agg(F.count(F.lit(1)).alias("_orders"))
            keys = [F.col(d) for d in used]
        measures = [MEASURES[n].build(cfg).alias(n) for n in chosen]
        cut = rows.groupBy(*keys).agg(*measures) if keys else rows.agg(*measures)
        if len(used) < len(dims):
            loose.append((cut, used))
        else:
            out = cut if out is None else (_full(out, cut, dims) if dims else out.crossJoin(F.broadcast(cut)))
    for cut, used in loose:  # tables that do not know every dimension repeat their value
        out = cut if out is None else (out.join(cut, used, "left") if used else out.crossJoin(F.broadcast(cut)))
    return out.select(*dims, *names)


def visual_query(facts: Facts, names, dims, cfg: Config, sort: str | None = None, descending: bool = False, filters=None) -> DataFrame:
    """A chart or table: measures by dimension in its display order."""
    out = evaluate(facts, names, dims, cfg, filters)
    if sort is None and dims:
        sort = dims[0]
    if sort in SORTS:
        return out.orderBy(position_in(sort, SORTS[sort]))
    if sort:
        return out.orderBy(F.col(sort).desc() if descending else F.col(sort).asc())
    return out


def matrix(facts: Facts, name: str, rows: str, columns: str, labels: Sequence, cfg: Config) -> DataFrame:
    """A measure with one dimension as rows and one as columns."""
    cells = evaluate(facts, [name], [rows, columns], cfg)
    return cells.groupBy(rows).pivot(columns, list(labels)).agg(F.max(name))


# ---- time intelligence --------------------------------------------------------------------
def shifted(monthly: DataFrame, measure: str, months: int, name: str, dims: Sequence[str] = ()) -> DataFrame:
    """The measure of the month that lies ``months`` earlier, aligned to the later month."""
    earlier = monthly.select(
        F.add_months("month_start", months).alias("month_start"), *dims, F.col(measure).alias(name)
    )
    return monthly.join(earlier, ["month_start", *dims], "left")


def previous_month(monthly: DataFrame, measure: str, dims: Sequence[str] = ()) -> DataFrame:
    out = shifted(monthly, measure, 1, f"{measure}_pm", dims)
    return out.withColumn(f"{measure}_mom_pct", ratio(F.col(measure) - F.col(f"{measure}_pm"), f"{measure}_pm"))


def prior_year(monthly: DataFrame, measure: str, dims: Sequence[str] = ()) -> DataFrame:
    out = shifted(monthly, measure, 12, f"{measure}_py", dims)
    return out.withColumn(f"{measure}_yoy_pct", ratio(F.col(measure) - F.col(f"{measure}_py"), f"{measure}_py"))


def year_to_date(monthly: DataFrame, measure: str, dims: Sequence[str] = ()) -> DataFrame:
    """Running sum inside the calendar year: at most twelve rows per window."""
    w = Window.partitionBy(*dims, F.year("month_start")).orderBy("month_start")
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    return monthly.withColumn(f"{measure}_ytd", F.sum(measure).over(running))


# ---- ranking, text and colour ---------------------------------------------------------------
INDEX_INPUTS = ("on_time_pct", "avg_rating", "profit_margin_pct", "avg_turnaround_hours", "cancellation_rate")


def performance_index(facts: Facts, cfg: Config, filters: Selection | None = None) -> DataFrame:
    """Mean of five ascending ranks over the number of centres, x 100, and its rank."""
    c = evaluate(facts, INDEX_INPUTS, ["center_name"], cfg, filters)

    def place(name: str, high_is_good: bool) -> Column:
        col = F.col(name)
        return F.rank().over(Window.orderBy(col.asc_nulls_first() if high_is_good else col.desc_nulls_last()))

    total = (
        place("on_time_pct", True)
        + place("avg_rating", True)
        + place("profit_margin_pct", True)
        + place("avg_turnaround_hours", False)
        + place("cancellation_rate", False)
    )
    size = F.count(F.lit(1)).over(Window.partitionBy())
    out = c.select("center_name", rounded_to(ratio(total * 100, size * 5), 9).alias("performance_index"))
    return out.withColumn("centre_rank", F.rank().over(Window.orderBy(F.desc("performance_index"))))


RANKING = (
    "completed_services", "total_revenue", "profit_margin_pct", "on_time_pct", "avg_turnaround_hours", "avg_rating",
    "cancellation_rate",
)


def centre_ranking(facts: Facts, cfg: Config, filters: Selection | None = None) -> DataFrame:
    """The ranking table: each centre's place with the measures shown beside it."""
    place = performance_index(facts, cfg, filters).select("centre_rank", "center_name")
    values = evaluate(facts, RANKING, ["center_name"], cfg, filters)
    return place.join(values, "center_name").select("centre_rank", "center_name", *RANKING).orderBy("centre_rank", "center_name")


def inr_short(v: Column) -> Column:
    """Rupees in crore / lakh text, '-' when blank."""
    x, size = v.cast("double"), F.abs(v.cast("double"))
    return (
        F.when(v.isNull(), "-")
        .when(size >= 1e7, F.concat(F.lit("₹"), F.format_string("%.1f", x / 1e7), F.lit(" Cr")))
        .when(size >= 1e5, F.concat(F.lit("₹"), F.format_string("%.1f", x / 1e5), F.lit(" L")))
        .otherwise(F.concat(F.lit("₹"), F.format_number(x, 0)))
    )


# fixed values: conditional colours
GOOD, WARN, GREY = "#00A67E", "#EB6834", "#A9B4B0"
SKILL_COLOURS = {"Junior": "#EB6834", "Mid": "#2A78D6", "Senior": "#00A67E", "Master": "#4A3AA7"}


def colour_against(value: Column, network: Column) -> Column:
    return F.when(value >= network, GOOD).otherwise(WARN)


def colour_sign(value: Column) -> Column:
    return F.when(value >= 0, GOOD).otherwise(WARN)


def colour_skill(skill: Column) -> Column:
    pairs = [F.lit(x) for kv in SKILL_COLOURS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), skill), F.lit(GREY))


def centre_colours(facts: Facts, cfg: Config) -> DataFrame:
    """On-time against the network and the profit sign, per centre, as flag colours."""
    names = ["on_time_pct", "profit"]
    network = evaluate(facts, ["on_time_pct"], [], cfg).select(F.col("on_time_pct").alias("_n"))
    c = evaluate(facts, names, ["center_name"], cfg).crossJoin(F.broadcast(network))
    return c.select(
        "center_name",
        colour_against(F.col("on_time_pct"), F.col("_n")).alias("on_time_colour"),
        colour_sign(F.coalesce("profit", F.lit(0))).alias("profit_colour"),
    )


def key_insights(facts: Facts, cfg: Config) -> DataFrame:
    """The four page sentences; a sentence is blank with fewer than two members."""
    by_centre = evaluate(facts, ["on_time_pct", "avg_turnaround_hours", "avg_rating"], ["center_name"], cfg)
    by_type = evaluate(facts, ["profit_margin_pct"], ["service_type"], cfg)
    network = evaluate(facts, ["on_time_pct"], [], cfg).select(F.col("on_time_pct").alias("_n"))
    time = extremes(by_centre, "center_name", "on_time_pct").crossJoin(F.broadcast(network))
    speed = extremes(by_centre, "center_name", "avg_turnaround_hours")
    margin = extremes(by_type, "service_type", "profit_margin_pct")
    rating = extremes(by_centre, "center_name", "avg_rating")
    low, high, lv, hv = F.col("lowest"), F.col("highest"), F.col("lowest_value"), F.col("highest_value")

    def page(df: DataFrame, name: str, *parts: Column) -> DataFrame:
        return df.select(F.lit(name).alias("page"), F.concat(*parts).alias("insight"))

    # fixed values: the sentences, as published
    return (
        page(time, "executive", low, F.lit(" has the lowest on-time rate at "), pct1(lv), F.lit(" (network "),
             pct1(F.col("_n")), F.lit(")."))
        .unionByName(page(speed, "operations", high, F.lit(" is slowest, averaging "), F.format_number(hv, 1),
                          F.lit(" h turnaround.")))
        .unionByName(page(margin, "financial", high, F.lit(" earns the best margin ("), pct1(hv), F.lit(") while "),
                          low, F.lit(" earns the lowest ("), pct1(lv), F.lit(").")))
        .unionByName(page(rating, "customer", low, F.lit(" has the lowest average rating ("), F.format_number(lv, 2),
                          F.lit(" / 5).")))
    )


def selection_label(cfg: Config, chosen: Selection) -> str:
    """Centres, regions and dates of a selection as one line of text."""

    # fixed values: the words of the label, as published
    def part(values: tuple[str, ...], one: str, many: str) -> str:
        if not values:
            return f"All {many}"
        return values[0] if len(values) == 1 else f"Selected {many}"

    first: date = max(chosen.span.first or cfg.period_start, cfg.period_start)
    last: date = min(chosen.span.last or cfg.period_end, cfg.period_end)
    span = f"{first:%d %b %Y} - {last:%d %b %Y}"
    return " | ".join([part(chosen.values("centre"), "centre", "centres"), part(chosen.values("region"), "region", "regions"), span])


def report_header(facts: Facts, cfg: Config, chosen: Selection) -> DataFrame:
    """Money cards in short form, the selection label and the titles built from it."""
    money = evaluate(facts, ["total_revenue", "total_cost", "profit"], [], cfg, chosen)
    label = selection_label(cfg, chosen)
    # fixed values: titles and footer, as published
    titles = {
        "title_trend": "Monthly revenue and profit - ",
        "title_turnaround": "Turnaround time by centre (hours) - ",
        "title_profit": "Profit by service centre - ",
        "title_rating": "Rating trend - ",
    }
    return money.select(
        inr_short(F.col("total_revenue")).alias("revenue_short"),
        inr_short(F.col("total_cost")).alias("cost_short"),
        inr_short(F.col("profit")).alias("profit_short"),
        F.lit(label).alias("selection_label"),
        *[F.lit(text + label).alias(name) for name, text in titles.items()],
        F.lit("Synthetic data for demonstration. Amounts in INR.").alias("footer"),
    )
