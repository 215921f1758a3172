"""Registered queries, bound to the given parquet tables."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bayworks.functions import shopclock
from bayworks.functions.scalars import band, parse_datetime, rounded_to
from bayworks.config import LEAD_BANDS, TURNAROUND_EDGES
from bayworks.operators import clean, diff, filters, shape, validate
from bayworks.plans import cube, explore, facts, insights, kpis, measures, metrics, quality, reports, stats, views, whatif
from bayworks.session import configure, scratch_folder, settle_table, size_shuffles
from bayworks.sources import binding, defects, files, schemas, versions

CFG = binding.BOUND_CONFIG
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: The same results for a model at hand, which may share what it has stored.
RESULTS: dict[str, Callable[[Model], DataFrame]] = {}
TECH_INPUT = "technician_id month actual_hours qc_passed_first_time caused_repeat_visit"


class Model:
    """Lazy tables, facts and views over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder
        self.cfg = CFG
        size_shuffles(spark, sum(versions.stored_bytes(spark, p) for p in self.paths))

    @property
    def paths(self) -> list[str]:
        return [f"{self.folder}/{name}.parquet" for name in binding.SCHEMAS]

    def read(self, name: str) -> DataFrame:
        return binding.read(self.spark, self.folder, name)

    @cached_property
    def tables(self) -> dict[str, DataFrame]:
        return binding.model_tables(self.spark, self.folder)

    @cached_property
    def fact(self) -> DataFrame:
        return facts.fact_service(self.tables, CFG)

    @cached_property
    def dataset(self) -> versions.Version:
        """The facts as a published version, made once from the same input files and settings.

        It lies in the session's shared folder and serves all queries that read facts more
        than once, as a dashboard's data set does.
        """
        made_from = versions.fingerprint(self.spark, self.paths, CFG)
        base = f"{scratch_folder(self.spark)}/datasets/{hashlib.sha256(self.folder.encode()).hexdigest()[:16]}"
        return versions.cached(self.spark, f"{base}/facts", made_from, lambda: {
            "fact_service": self.fact, "fact_appointments": self.appts, "technician_hours": self.load})

    @cached_property
    def published(self) -> dict[str, DataFrame]:
        return self.dataset.read(self.spark)

    @property
    def stored(self) -> DataFrame:
        """The job facts of the published version."""
        return self.published["fact_service"]

    @cached_property
    def cube(self) -> dict[str, DataFrame]:
        """The slicer cube of the published facts, a version of its own."""
        made = self.dataset
        base = f"{made.folder.rsplit('/versions/', 1)[0]}-cube"
        facts_ = [self.published[n] for n in ("fact_service", "fact_appointments", "technician_hours")]
        return versions.cached(self.spark, base, made.folder, lambda: cube.build(*facts_, CFG)).read(self.spark)

    def jobs(self, columns: str) -> DataFrame:
        """Job facts reduced to the named columns and the joins those need."""
        return facts.fact_service(self.tables, CFG, set(columns.split()))

    @cached_property
    def appts(self) -> DataFrame:
        return facts.fact_appointments(self.tables)

    @cached_property
    def tech(self) -> DataFrame:
        return facts.with_centre(
            facts.fact_technician_month(self.tables, self.jobs(TECH_INPUT), CFG),
            self.tables["service_centers"],
        )

    @cached_property
    def load(self) -> DataFrame:
        """Technician-months with hours only (no comeback history)."""
        jobs = self.jobs(TECH_INPUT.replace("caused_repeat_visit", "")).withColumn(
            "caused_repeat_visit", F.lit(False)
        )
        months = facts.fact_technician_month(self.tables, jobs, CFG).drop("comebacks_caused")
        return facts.with_centre(months, self.tables["service_centers"])

    def fs(self, columns: str | None = None) -> DataFrame:
        """Job facts with weekday, month number and year."""
        base = self.fact if columns is None else self.jobs(columns + " service_date month")
        return metrics.with_calendar(base)

    @cached_property
    def fa(self) -> DataFrame:
        return metrics.with_calendar(self.appts, "scheduled_date")

    @property
    def staff(self) -> DataFrame:
        return self.tables["technicians"]

    @cached_property
    def daily(self) -> DataFrame:
        jobs = self.fs("center_id center_name estimated_hours booking_channel wait_hours on_time_flag")
        return metrics.daily_load(jobs, self.staff, CFG)

    @cached_property
    def lines(self) -> DataFrame:
        jobs = self.fs("work_order_id center_id center_name parts_delay_flag parts_wait_hours")
        return metrics.parts_lines(jobs, self.tables["part_usage"], self.tables["parts"])

    @cached_property
    def centres(self) -> list[str]:
        """Names of all centres, for matrices with a column each; a dimension of bounded size."""
        rows = self.tables["service_centers"].select("center_name").distinct().collect()
        return sorted(r[0] for r in rows if r[0] is not None)

    def view(self, name: str) -> DataFrame:
        return views.view(self.spark, self.tables, CFG, name)


def present(df: DataFrame, *columns: str) -> DataFrame:
    """Plain result types: decimals as double, dates and time stamps as text."""
    out = []
    for f in (df.select(*columns) if columns else df).schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, (T.ShortType, T.ByteType)):
            c = c.cast("int")
        out.append(c.alias(f.name))
    return df.select(*out)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """``present`` plus rounding of doubles (last bits are not part of a result)."""
    flat = present(df)
    return flat.select(
        *[
            rounded_to(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else f"`{f.name}`"
            for f in flat.schema.fields
        ]
    )


def add(name: str, build: Callable[[Model], DataFrame], *columns: str, digits: int | None = None) -> None:
    """Register a query; ``columns`` narrows the result, ``digits`` rounds its doubles."""

    def finish(m: Model) -> DataFrame:
        df = build(m)
        df = df.select(*columns) if columns else df
        return present(df) if digits is None else rounded(df, digits)

    assert name not in QUERIES, name
    RESULTS[name] = finish
    QUERIES[name] = lambda spark, folder: finish(Model(spark, folder))


# ---- facts and views ------------------------------------------------------------
JOB_COLUMNS = (
    "work_order_id", "technician_id", "vehicle_id", "customer_id", "center_id", "service_type", "model",
    "customer_type", "center_name", "region", "skill_level", "billing_type", "booking_channel",
    "service_date", "year", "month", "wait_hours", "turnaround_hours", "late_hours", "on_time_flag",
    "duration_variance_hours", "parts_delay_flag", "total_cost", "profit", "cost_variance",
    "cost_variance_pct", "cost_overrun_flag", "vehicle_age_years", "days_since_same_service",
    "is_repeat_visit", "caused_repeat_visit", "customer_visit_number", "rating",
)
add("fact_service", lambda m: m.fact, *JOB_COLUMNS)
add("comeback", lambda m: m.jobs("work_order_id days_since_same_service is_repeat_visit caused_repeat_visit"))
add(
    "visit_number",
    lambda m: facts.job_history(m.tables).groupBy("customer_visit_number").agg(F.count(F.lit(1)).alias("jobs")),
)
add(
    "fact_appointments", lambda m: m.appts,
    "appointment_id", "customer_id", "model", "customer_type", "center_name", "region", "lead_days",
    "lead_time_band", "weekday", "month", "is_cancelled", "is_no_show", "is_completed",
)
add("dense_grid", lambda m: m.tech.drop("center_name", "region"), digits=6)

add(
    "vw_work_order_enriched", lambda m: m.view("vw_work_order_enriched"),
    "work_order_id", "vehicle_id", "customer_id", "center_id", "technician_id", "service_type", "variant",
    "model_year", "customer_region", "years_experience", "month_start", "year_month", "service_year",
    "service_month", "iso_weekday", "weekday_name", "wait_hours", "turnaround_hours", "late_hours",
    "on_time_flag", "profit", "cost_variance_pct", "cost_overrun_flag", "prev_same_service_end",
    "next_same_service_check_in", "days_since_same_service", "is_comeback", "caused_comeback",
    "customer_visit_number",
)
add(
    "vw_appointment_enriched", lambda m: m.view("vw_appointment_enriched"),
    "appointment_id", "customer_id", "center_name", "city", "lead_days", "lead_time_band", "year_month",
    "month_start", "iso_weekday", "weekday_name", "is_cancelled", "is_no_show", "is_completed",
)
add("vw_monthly_financials", lambda m: m.view("vw_monthly_financials"), digits=6)
for _name in (
    "vw_technician_utilisation", "vw_center_performance", "vw_service_type_performance",
    "vw_appointment_funnel", "vw_customer_repeat", "vw_kpi_summary",
):
    add(_name, lambda m, _n=_name: m.view(_n))

# ---- reports --------------------------------------------------------------------
for _name, _report in reports.REPORTS.items():
    add(_name, lambda m, _f=_report: _f(m.tables, CFG))


# ---- raw twins, quality checks, cleaning ------------------------------------------
DEFECT_SCALE = 4  # four times the documented defect rates, so small inputs show every class


def raw_tables(m: Model) -> defects.RawTables:
    return defects.inject(m.tables, CFG, DEFECT_SCALE)


class Staged(dict):
    """Raw twins with types applied but no rule: what the quality checks are pointed at."""

    def __init__(self, raw):
        super().__init__()
        self._raw = raw

    def __missing__(self, name: str) -> DataFrame:
        df = self._raw[name]
        when = {c: parse_datetime(c) for c in schemas.DATE_COLUMNS.get(name, ())}
        if when:
            df = df.withColumns({c: w if name == "work_orders" else F.to_date(w) for c, w in when.items()})
        self[name] = df
        return df


def staged(m: Model) -> Staged:
    return Staged(raw_tables(m))


def held_stage(m: Model, names: Iterable[str] = schemas.TABLES) -> dict[str, DataFrame]:
    """The staged tables, the named ones stored once: those that are more than columns of a source table."""
    tables = staged(m)
    return {name: settle_table(tables[name]) if name in names else tables[name] for name in schemas.TABLES}


def cleaned(m: Model, store=settle_table) -> clean.Pipeline:
    return clean.Pipeline(raw_tables(m), CFG, store)


for _n in quality.CATALOGUE:
    add(f"dq{_n:02d}", lambda m, _n=_n: quality.run_checks(staged(m), CFG, [_n]))
add("dq99", lambda m: quality.summary(held_stage(m, ("financials", "part_usage")), CFG))
add("dq_agreement", lambda m: quality.agreement(held_stage(m), CFG))
add("constraints", lambda m: validate.validate(staged(m), schemas.table_rules(CFG)))
add("profile", lambda m: clean.profile(raw_tables(m)))
for _name in clean.ORDER:
    add(f"clean_{_name}", lambda m, _n=_name: cleaned(m)[_n].rows)
add("cleaning_log", lambda m: clean.cleaning_log(cleaned(m)))
add("retention", lambda m: clean.retention(clean.profile(raw_tables(m)), cleaned(m)))


def _validation(m: Model) -> DataFrame:
    rows = cleaned(m).rows()
    return clean.validation(rows, settle_table(facts.fact_service(rows, CFG)))


add("postclean_checks", _validation)
add(
    "injected_vs_detected",
    lambda m: clean.reconcile_defects(
        defects.manifest(m.tables, CFG, DEFECT_SCALE), clean.cleaning_log(cleaned(m))
    ),
)
for _name, _key, _cols in (
    ("customers", "customer_id", ["region"]),
    ("vehicles", "vehicle_id", ["model", "model_year", "mileage_km"]),
    ("appointments", "appointment_id", ["status", "scheduled_date", "center_id"]),
    ("work_orders", "work_order_id", ["service_type", "technician_id"]),
    ("financials", "work_order_id", ["labor_cost", "parts_cost", "revenue"]),
):
    add(
        f"change_audit_{_name}",
        lambda m, _n=_name, _k=_key, _c=_cols: clean.change_audit(raw_tables(m)[_n], cleaned(m)[_n].rows, _k, _c),
    )


# ---- KPI library ------------------------------------------------------------------
add("fact_kpis", lambda m: kpis.fact_kpis(m.stored, CFG), digits=6)
add("appointment_kpis", lambda m: kpis.appointment_kpis(m.appts), digits=6)
add("utilisation_total", lambda m: kpis.utilisation(m.load), digits=6)
add("headline", lambda m: kpis.headline(*m.published.values(), CFG), digits=6)
add("group_kpis", lambda m: kpis.group_kpis(m.stored, ["center_name"], CFG), digits=6)
add("group_kpis_two_keys", lambda m: kpis.group_kpis(m.stored, ["region", "model"], CFG), digits=6)
add("monthly_trend", lambda m: kpis.monthly_trend(m.stored, CFG), digits=6)
add("service_type_kpis", lambda m: kpis.service_type_performance(m.stored, CFG), digits=6)
add("billing_type_kpis", lambda m: kpis.group_kpis(m.stored, ["billing_type"], CFG), digits=6)
add("skill_comeback", lambda m: kpis.skill_table(m.fact, CFG).select("skill_level", "work_orders", "comeback_rate", "qc_first_pass_rate"), digits=6)
add("appt_rates", lambda m: kpis.appointment_rates(m.appts, ["center_name", "month"]), digits=6)
add("cancellation_by_lead", lambda m: kpis.cancellation_by(m.appts, "lead_time_band", LEAD_BANDS), digits=6)
add("reason_share", lambda m: kpis.cancellation_reasons(m.appts), digits=6)
add("centre_scorecard", lambda m: kpis.centre_scorecard(*m.published.values(), CFG), digits=6)
add("index_vs_average", lambda m: kpis.index_against_average(kpis.centre_scorecard(*m.published.values(), CFG)), digits=6)
add("utilisation_by", lambda m: kpis.utilisation_by(m.load, ["center_name"]), digits=6)
add("technician_scorecard", lambda m: kpis.technician_scorecard(m.fact, m.tech, CFG), digits=6)
add("util_matrix", lambda m: kpis.utilisation_matrix(m.load, CFG.months), digits=6)
add("delay_distribution", lambda m: kpis.delay_distribution(m.jobs("late_hours")), digits=6)
add("turnaround_distribution", lambda m: kpis.delay_distribution(m.jobs("turnaround_hours"), "turnaround_hours", TURNAROUND_EDGES, None), digits=6)
add("wait_by_weekday", lambda m: kpis.wait_by_weekday(m.jobs("service_date wait_hours work_order_id")), digits=6)
add("rating_matrix", lambda m: kpis.rating_matrix(
    m.jobs("service_type center_name rating"), "service_type", "center_name", m.centres), digits=6)
add("feedback_distribution", lambda m: kpis.feedback_distribution(m.jobs("feedback_category")), digits=6)
add("parts_by_category", lambda m: kpis.parts_by_category(
    m.tables["part_usage"], m.tables["parts"], m.jobs("work_order_id")), digits=6)
add("tercile_flag", lambda m: kpis.tercile_flag(
    kpis.known(m.jobs("center_name on_time_flag"), ["center_name"]).groupBy("center_name").agg(kpis.share("on_time_flag").alias("on_time_pct")),
    "on_time_pct", "high", "flag"), digits=6)
add("better_than", lambda m: kpis.cancellation_by(m.appts, "center_name").crossJoin(
    F.broadcast(kpis.appointment_kpis(m.appts).select(F.col("cancellation_rate").alias("reference")))).select(
    "center_name", "cancellation_rate", "reference",
    kpis.better_than(F.col("cancellation_rate"), F.col("reference"), higher=False).alias("verdict")), digits=6)
add("extremes", lambda m: shape.extremes(kpis.appointment_rates(m.appts, ["center_name"]), "center_name", "cancellation_rate"), digits=6)


def _scorecard(m: Model) -> DataFrame:
    return kpis.centre_scorecard(*m.published.values(), CFG)


add("insight_executive", lambda m: insights.executive(_scorecard(m)), digits=6)
add("insight_operations", lambda m: insights.operations(
    kpis.group_kpis(m.stored, ["center_name"], CFG), kpis.wait_by_weekday(m.stored)), digits=6)
add("insight_financial", lambda m: insights.financial(
    kpis.group_kpis(m.stored, ["service_type"], CFG), kpis.group_kpis(m.stored, ["month"], CFG)), digits=6)
add("insight_customer", lambda m: insights.customer(
    kpis.group_kpis(m.stored, ["center_name"], CFG), kpis.cancellation_by(m.appts, "lead_time_band")), digits=6)

# ---- slicers ------------------------------------------------------------------------
CHOSEN = filters.select(
    date(1997, 3, 15), date(1999, 2, 10), region=("ASIA", "EUROPE"),
    service_type=("1-URGENT", "5-LOW"), model=("Model A", "Model C"),
)
SLICED_JOBS = "work_order_id service_date center_name region service_type model revenue on_time_flag"


def _sliced(m: Model) -> dict[str, DataFrame]:
    return filters.apply_slicers({"fact": m.jobs(SLICED_JOBS), "appts": m.appts, "tech": m.load}, CHOSEN)


add("slicer_filter", lambda m: _sliced(m)["fact"].select("work_order_id", "center_name", "service_type", "model"))
add("month_overlap_filter", lambda m: _sliced(m)["tech"].groupBy("center_name").agg(
    F.count(F.lit(1)).alias("technician_months"), F.sum("service_hours").alias("service_hours")))
add("slicer_selection", lambda m: shape.label_frame(m.load, "one", ["x"]).select(F.lit("selection").alias("what"))
    .crossJoin(F.broadcast(_sliced(m)["fact"].agg(F.count(F.lit(1)).alias("jobs"), F.sum("revenue").alias("revenue"))))
    .crossJoin(F.broadcast(_sliced(m)["appts"].agg(F.count(F.lit(1)).alias("appointments"))))
    .crossJoin(F.broadcast(_sliced(m)["tech"].agg(F.sum("available_hours").alias("available_hours")))))
add("cube_headline", lambda m: cube.headline(cube.page(m.cube, CFG)), digits=6)
add("cube_monthly_trend", lambda m: cube.monthly_trend(cube.page(m.cube, CFG)), digits=6)
add("cube_centre_scorecard", lambda m: cube.centre_scorecard(cube.page(m.cube, CFG)), digits=6)
add("cube_slicer_headline", lambda m: cube.headline(cube.page(cube.sliced(m.cube, CHOSEN), CFG)), digits=6)
add("cube_slicer_months", lambda m: cube.monthly_trend(cube.page(cube.sliced(m.cube, CHOSEN), CFG)), digits=6)
add("slicer_options", lambda m: filters.slicer_options(m.jobs(SLICED_JOBS)))


# ---- diagnostics ----------------------------------------------------------------------
PLAN = whatif.Plan(focus=6, benchmark=5, capacity=(6, 3, 7), hot=(1, 3, 6, 7), parts=8)
add("service_scorecard", lambda m: metrics.service_scorecard(m.fs(), ["service_type"], CFG), digits=6)
add("model_scorecard", lambda m: metrics.service_scorecard(m.fs(), ["model"], CFG), digits=6)
add("cancellation_diag", lambda m: metrics.cancellation_by(m.fa, ["booking_channel"]), digits=6)
add("cancellation_type_diag", lambda m: metrics.cancellation_by(m.fa, ["requested_service_type"]), digits=6)
add("cancellation_lead_diag", lambda m: shape.reindex_labels(
    metrics.cancellation_by(m.fa, ["lead_time_band"]), "lead_time_band", LEAD_BANDS), digits=6)
add("utilisation_diag", lambda m: metrics.utilisation(m.load, ["center_id", "month"]), digits=6)
add("centre_diag", lambda m: metrics.centre_scorecard(m.fs(), m.fa, m.load, m.staff, CFG), digits=6)
add("monthly_diag", lambda m: metrics.monthly_trend(m.fs(), m.fa, m.load, CFG), digits=6)
add("yoy", lambda m: metrics.year_over_year(m.fs(), m.fa, m.load, CFG), digits=6)
add("daily_load", lambda m: m.daily, "center_id", "center_name", "service_date", "weekday", "jobs", "booked_hours",
    "wait_h", "on_time", "capacity_hours", "load_ratio", "overloaded", digits=6)
add("load_attach", lambda m: metrics.attach_load(m.fs("work_order_id center_id"), m.daily),
    "work_order_id", "load_ratio", "load_band", digits=6)
add("load_band_profile", lambda m: metrics.load_band_profile(metrics.attach_load(
    m.fs("work_order_id center_id on_time_flag wait_hours qc_passed_first_time caused_repeat_visit rating"), m.daily)), digits=6)
add("overloaded_share", lambda m: metrics.overloaded_share(m.daily, CFG), digits=6)
add("weekday_profile", lambda m: metrics.weekday_profile(m.fs("on_time_flag wait_hours rating"), m.fa), digits=6)
add("carry_over", lambda m: metrics.carry_over(m.fs("center_id parts_delay_flag on_time_flag check_in_time end_time")), digits=6)
add("process_stages", lambda m: metrics.process_stages(metrics.with_calendar(m.stored), m.fa, m.tables["feedback"], CFG), digits=6)
add("parts_lines", lambda m: m.lines.groupBy("center_id", "part_category").agg(
    F.count(F.lit(1)).alias("lines"), F.sum("line_cost").alias("line_cost")))
add("parts_delay_cat", lambda m: metrics.parts_delay_by_category(m.lines), digits=6)
add("parts_delay_cat_centre", lambda m: metrics.parts_delay_category_centre(
    m.lines, m.centres), digits=6)
add("parts_delay_impact", lambda m: metrics.parts_delay_impact(
    m.fs("parts_delay_flag on_time_flag turnaround_hours parts_wait_hours rating"), CFG), digits=6)
add("abc", lambda m: metrics.abc_parts(m.lines), digits=6)
add("abc_summary", lambda m: metrics.abc_summary(metrics.abc_parts(m.lines)), digits=6)
add("abc_a_class", lambda m: metrics.abc_parts(m.lines).where("abc_class = 'A'").select(
    "part_id", "part_name", "part_category", "value_share", "delay_rate", "supplier_lead_days"), digits=6)
add("abc_a_delayed", lambda m: metrics.abc_parts(m.lines).where("abc_class = 'A' and delay_rate >= 0.2").select(
    "part_id", "delay_rate"), digits=6)
add("safety_stock", lambda m: metrics.safety_stock(m.lines, PLAN.parts, CFG), digits=6)
add("skill_profile", lambda m: metrics.skill_profile(m.fs(), CFG), digits=6)
add("skill_profile_complex", lambda m: metrics.skill_profile(m.fs(), CFG, only_complex=True), digits=6)
add("technician_diag", lambda m: metrics.technician_scorecard(m.fs(), m.load, CFG), digits=6)
add("overloaded_technicians", lambda m: metrics.overloaded_technicians(m.load, CFG))
add("rework_cost", lambda m: metrics.rework_cost(m.fs("billing_type total_cost actual_hours")), digits=6)
add("overrun_drivers", lambda m: metrics.overrun_drivers(
    m.fs("additional_work_found cost_overrun_flag cost_variance_pct revenue profit rating")), digits=6)
add("technician_monthly_cost", lambda m: validate.union_all(
    [metrics.technician_monthly_cost(m.staff, m.load, s) for s in ("Mid", "Senior")]), digits=6)
add("crosstab_norm", lambda m: metrics.lead_band_mix(m.fa), digits=6)
add("reasons_by_centre", lambda m: metrics.reasons_by_centre(m.fa), digits=6)

# ---- tests ----------------------------------------------------------------------------
add("kruskal_turnaround", lambda m: stats.kruskal(m.fs("center_id turnaround_hours"), "center_id", "turnaround_hours"), digits=6)
add("kruskal_wait", lambda m: stats.kruskal(m.fs("center_id wait_hours"), "center_id", "wait_hours"), digits=6)
add("mannwhitney", lambda m: stats.mann_whitney(
    m.fs("center_id wait_hours"), F.col("center_id") == PLAN.focus, "wait_hours"), digits=6)
CHI2 = {
    "chi2_on_time_centre": ("center_id on_time_flag", "center_id", "on_time_flag"),
    "chi2_on_time_parts": ("parts_delay_flag on_time_flag", "parts_delay_flag", "on_time_flag"),
    "chi2_qc_skill": ("skill_level qc_passed_first_time", "skill_level", "qc_passed_first_time"),
    "chi2_overrun_skill": ("skill_level cost_overrun_flag", "skill_level", "cost_overrun_flag"),
}
for _name, (_c, _a, _b) in CHI2.items():
    add(_name, lambda m, _c=_c, _a=_a, _b=_b: stats.chi2(m.fs(_c), _a, _b), digits=6)
add("chi2_cancel_lead", lambda m: stats.chi2(m.fa, "lead_time_band", "is_cancelled"), digits=6)
add("chi2_on_time_saturday", lambda m: stats.chi2(
    m.fs("on_time_flag").withColumn("saturday", F.col("weekday") == "Saturday"), "saturday", "on_time_flag"), digits=6)
add("chi2_parts_one_centre", lambda m: stats.chi2(
    m.fs("center_id parts_delay_flag").withColumn("own", F.col("center_id") == PLAN.parts), "own", "parts_delay_flag"), digits=6)
add("prop_gap", lambda m: stats.proportion_gap(
    m.fs("center_id on_time_flag"), "center_id", PLAN.focus, PLAN.benchmark, "on_time_flag"), digits=6)
add("spearman_rating_late", lambda m: stats.spearman(m.fs("rating late_hours"), "late_hours", "rating"), digits=6)
add("spearman_rating_wait", lambda m: stats.spearman(
    m.fs("rating late_hours wait_hours").where("rating is not null and late_hours is not null").fillna(0, ["wait_hours"]),
    "wait_hours", "rating"), digits=6)
add("spearman_load_wait", lambda m: stats.spearman(
    m.daily.select(F.round("load_ratio", 9).alias("load_ratio"), F.round("wait_h", 9).alias("wait_h")), "load_ratio", "wait_h"), digits=6)
add("spearman_load_on_time", lambda m: stats.spearman(
    m.daily.select(F.round("load_ratio", 9).alias("load_ratio"), F.round("on_time", 9).alias("on_time")), "load_ratio", "on_time"), digits=6)
add("spearman_lead_cancel", lambda m: stats.spearman(
    m.fa.where(F.col("booking_channel") != CFG.walk_in).select("lead_days", F.col("is_cancelled").cast("int").alias("c")),
    "lead_days", "c"), digits=6)
CORRELATED = (
    "load_ratio", "wait_hours", "late_hours", "parts_wait_hours", "duration_variance_hours", "cost_variance_pct",
    "qc_passed_first_time", "caused_repeat_visit", "rating",
)


def _correlated(m: Model) -> DataFrame:
    jobs = m.fs("center_id " + " ".join(c for c in CORRELATED if c != "load_ratio"))
    loaded = metrics.attach_load(jobs, m.daily)
    return loaded.select(*[F.round(F.col(c).cast("double"), 9).alias(c) for c in CORRELATED])


add("spearman_matrix", lambda m: stats.spearman_matrix(_correlated(m), CORRELATED), digits=6)


def _statistical_tests(m: Model) -> DataFrame:
    """All tests, one line each: statistic, effect size and number of observations."""
    fs = settle_table(m.fs(
        "center_id turnaround_hours wait_hours on_time_flag parts_delay_flag rating late_hours skill_level "
        "qc_passed_first_time cost_overrun_flag"))
    daily = settle_table(m.daily.select(*[F.round(c, 9).alias(c) for c in ("load_ratio", "wait_h", "on_time")]))
    days = F.lit(daily.count())  # the daily correlations report all days
    rated = fs.where("rating is not null and late_hours is not null").fillna(0, ["wait_hours"])
    booked = m.fa.where(F.col("booking_channel") != CFG.walk_in).select(
        "lead_days", F.col("is_cancelled").cast("int").alias("c"))
    gap = stats.proportion_gap(fs, "center_id", PLAN.focus, PLAN.benchmark, "on_time_flag").withColumn(
        "n", F.lit(None).cast("bigint"))
    line, chi2 = stats.summary_line, stats.chi2
    by_centre = {"kruskal_turnaround_by_centre": "turnaround_hours", "kruskal_wait_by_centre": "wait_hours"}
    pairs = {
        "spearman_rating_vs_late_hours": (fs, "late_hours", "rating"),
        "spearman_rating_vs_wait_hours": (rated, "wait_hours", "rating"),
        "spearman_daily_load_vs_wait": (daily, "load_ratio", "wait_h"),
        "spearman_daily_load_vs_on_time": (daily, "load_ratio", "on_time"),
        "spearman_lead_days_vs_cancel_booked": (booked, "lead_days", "c"),
    }
    rho = stats.summary_lines(stats.spearman_many(pairs), list(pairs), "rho", "rho")
    return validate.union_all([
        stats.summary_lines(stats.kruskal_many(fs, "center_id", by_centre), list(by_centre), "h", "epsilon_sq"),
        rho.withColumn("n", F.when(F.col("test").startswith("spearman_daily"), days).otherwise(F.col("n"))),
        line(stats.mann_whitney(fs, F.col("center_id") == PLAN.focus, "wait_hours"),
             "mannwhitney_wait_focus_vs_rest", "u", "rank_biserial"),
        line(chi2(fs, "center_id", "on_time_flag"), "chi2_on_time_by_centre", "chi2", "cramers_v"),
        line(chi2(fs, "parts_delay_flag", "on_time_flag"), "chi2_on_time_vs_parts_delay", "chi2", "cramers_v"),
        line(gap, "on_time_gap_focus_vs_benchmark", "gap", "cohens_h"),
        line(chi2(m.fa, "lead_time_band", "is_cancelled"), "chi2_cancellation_vs_lead_band", "chi2", "cramers_v"),
        line(chi2(fs, "skill_level", "qc_passed_first_time"), "chi2_qc_vs_skill", "chi2", "cramers_v"),
        line(chi2(fs, "skill_level", "cost_overrun_flag"), "chi2_overrun_vs_skill", "chi2", "cramers_v"),
        line(chi2(fs.withColumn("saturday", F.col("weekday") == "Saturday"), "saturday", "on_time_flag"),
             "chi2_on_time_saturday_vs_weekday", "chi2", "cramers_v"),
    ])


add("statistical_tests", _statistical_tests, digits=6)

# ---- what-if and impact ------------------------------------------------------------------
add("response_curve", lambda m: whatif.response_curve(m.daily), digits=6)
add("whatif_capacity", lambda m: validate.union_all(
    [whatif.add_technicians(m.daily, m.load, m.staff, c, CFG) for c in PLAN.capacity]), digits=6)
add("whatif_shift", lambda m: whatif.shift_saturday(m.daily, CFG), digits=6)
add("whatif_saturday", lambda m: whatif.saturday_capacity(m.daily, m.staff, PLAN.hot, CFG), digits=6)
add("impact_recovery", lambda m: whatif.cancellation_recovery(m.fs("center_id revenue profit"), m.fa, PLAN, CFG), digits=6)
add("impact_context", lambda m: whatif.focus_context(m.fs("center_id revenue profit"), m.staff, m.load, PLAN, CFG), digits=6)
add("impact_parts", lambda m: whatif.parts_recovery(
    m.fs("center_id parts_delay_flag on_time_flag turnaround_hours service_type"), m.lines, PLAN, CFG), digits=6)
add("impact_skill", lambda m: whatif.skill_uplift(m.fs(
    "skill_level caused_repeat_visit qc_passed_first_time duration_variance_hours billing_type total_cost actual_hours"), CFG), digits=6)
add("impact_booking", lambda m: whatif.booking_window(m.fs("revenue profit"), m.fa, PLAN, CFG), digits=6)
add("impact_estimate", lambda m: whatif.estimate_discipline(m.fs(
    "additional_work_found cost_overrun_flag cost_variance_pct revenue profit rating"), CFG), digits=6)

# ---- exploration ----------------------------------------------------------------------------
NUMBERS = [
    "estimated_hours", "actual_hours", "duration_variance_hours", "wait_hours", "turnaround_hours", "late_hours",
    "parts_wait_hours", "revenue", "total_cost", "profit", "cost_variance_pct", "rating",
]
add("describe", lambda m: explore.describe(m.fs(" ".join(NUMBERS)), NUMBERS), digits=4)
add("category_mix", lambda m: explore.category_mix(
    m.fs("service_type billing_type model customer_type"), ["service_type", "billing_type", "model", "customer_type"]), digits=6)
OUTLIERS = ["turnaround_hours", "wait_hours", "late_hours", "cost_variance_pct", "revenue", "duration_variance_hours"]
add("iqr_outliers", lambda m: explore.iqr_outliers(m.fs(" ".join(OUTLIERS)), OUTLIERS), digits=6)
add("rating_by_late_band", lambda m: explore.rating_by_late_band(m.fs("rating late_hours")), digits=6)
add("delay_model_year", lambda m: explore.delay_by_model_year(m.fs("model parts_delay_flag"), range(CFG.period_start.year, CFG.period_end.year + 1)), digits=6)
add("overrun_centre", lambda m: explore.overrun_by_centre(m.fs("center_name additional_work_found cost_overrun_flag")), digits=6)
add("part_category_profile", lambda m: explore.part_category_profile(m.tables["parts"]), digits=6)
add("column_profile", lambda m: validate.union_all([
    explore.column_profile(m.tables[t]).select(F.lit(t).alias("table"), "column", "nulls", "distinct") for t in schemas.TABLES]))
add("preview", lambda m: shape.preview(reports.REPORTS["q05"](m.tables, CFG), ["technician_id"], 5))
VEHICLE_KEYS = ["vehicle_id", "customer_id", "model", "model_year"]
add("table_diff", lambda m: explore.table_diff(
    staged(m)["vehicles"].select(VEHICLE_KEYS), cleaned(m)["vehicles"].rows.select(VEHICLE_KEYS)))


def _vehicle_changes(m: Model) -> DataFrame:
    """What cleaning did to the vehicles, key by key, from two stored versions."""
    base = f"{scratch_folder(m.spark)}/diff-{uuid.uuid4().hex}"
    for name, rows in (("raw", staged(m)["vehicles"]), ("clean", cleaned(m)["vehicles"].rows)):
        diff.store(rows.select(VEHICLE_KEYS), ["vehicle_id"], f"{base}/{name}")
    return diff.changes(m.spark, f"{base}/raw", f"{base}/clean", ["vehicle_id"])


add("table_changes", _vehicle_changes)


# ---- semantic measures and visuals ----------------------------------------------------------
def bi(m: Model, names, dims=(), filtered: bool = False) -> dict[str, DataFrame]:
    """Fact tables of the semantic model, with only the job columns that are needed, stored once."""
    jobs = m.jobs(measures.fact_columns(names, dims, filtered))
    return {
        "fact": measures.fill_unassigned(settle_table(jobs)),
        "appts": m.appts,
        "tech": measures.fill_unassigned(m.load),
        "usage": m.tables["part_usage"],
        "parts": m.tables["parts"],
    }


def visual(name: str, dims: str, names: str, sort: str | None = None, descending: bool = False, chosen=None) -> None:
    d, n = dims.split(), names.split()
    add(name, lambda m: measures.visual_query(
        bi(m, n, d, chosen is not None), n, d, CFG, sort, descending, chosen), digits=6)


ALL_MEASURES = " ".join(measures.MEASURES)
visual("measures_total", "", ALL_MEASURES)
visual("measures_by_centre", "center_name", ALL_MEASURES.replace("parts_cost_catalogue ", ""))
visual("measures_filtered", "", ALL_MEASURES, chosen=CHOSEN)
visual("visual_exec_month", "month_start", "total_revenue profit profit_margin_pct on_time_pct")
visual("visual_ops_centre", "center_name", "avg_turnaround_hours median_turnaround_hours", "avg_turnaround_hours", True)
visual("visual_ops_technician", "technician_id", "technician_utilisation_pct", "technician_utilisation_pct", True)
visual("visual_ops_service_type", "service_type",
       "completed_services avg_turnaround_hours on_time_pct avg_estimated_hours avg_actual_hours "
       "avg_duration_variance_hours parts_delay_rate avg_rating total_revenue", "completed_services", True)
visual("visual_ops_delay", "delay_band", "completed_services")
visual("visual_ops_turnaround", "turnaround_band", "completed_services")
visual("visual_ops_weekday", "weekday_name", "avg_wait_hours")
visual("visual_fin_month", "month_start", "total_revenue total_cost profit profit_margin_pct cost_overrun_rate cost_variance")
visual("visual_fin_centre", "center_name", "profit parts_cost labour_cost", "profit", True)
visual("visual_fin_service_type", "service_type", "profit cost_variance", "profit", True)
visual("visual_fin_skill", "skill_level", "cost_variance")
visual("visual_fin_billing", "billing_type", "total_revenue", "total_revenue", True)
visual("visual_fin_category", "part_category", "parts_cost_catalogue", "parts_cost_catalogue", True)
visual("visual_cust_month", "month_start", "avg_rating csat_pct")
visual("visual_cust_centre", "center_name", "cancellation_rate repeat_visit_rate comeback_rate", "cancellation_rate", True)
visual("visual_cust_lead", "lead_time_band", "cancellation_rate")
visual("visual_cust_reason", "cancellation_reason", "cancelled_appointments", "cancelled_appointments", True)
visual("visual_cust_skill", "skill_level", "comeback_rate")
visual("visual_cust_feedback", "feedback_category", "rated_services", "rated_services", True)
visual("visual_query", "region service_type", "completed_services on_time_pct appointments technician_utilisation_pct")
add("visual_cust_matrix", lambda m: measures.matrix(
    bi(m, ["avg_rating"], ["service_type", "center_name"]), "avg_rating", "service_type", "center_name", m.centres, CFG), digits=6)
add("visual_ops_matrix", lambda m: measures.matrix(
    bi(m, [], []), "technician_utilisation_pct", "technician_id", "month_start",
    [date(int(x[:4]), int(x[5:]), 1) for x in CFG.months], CFG), digits=6)


def _monthly(m: Model) -> DataFrame:
    n, d = ["total_revenue", "profit"], ["month_start"]
    return measures.evaluate(bi(m, n, d), n, d, CFG)


add("prev_month", lambda m: measures.previous_month(measures.previous_month(_monthly(m), "total_revenue"), "profit"), digits=6)
add("prior_year", lambda m: measures.prior_year(measures.prior_year(_monthly(m), "total_revenue"), "profit"), digits=6)
add("ytd", lambda m: measures.year_to_date(_monthly(m), "total_revenue"), digits=6)
add("perf_index", lambda m: measures.performance_index(bi(m, measures.INDEX_INPUTS, ["center_name"]), CFG), digits=6)
add("centre_ranking", lambda m: measures.centre_ranking(
    bi(m, {*measures.INDEX_INPUTS, *measures.RANKING}, ["center_name"]), CFG), digits=6)
add("centre_colours", lambda m: measures.centre_colours(bi(m, ["on_time_pct", "profit"], ["center_name"]), CFG))
add("skill_colours", lambda m: measures.technician_dimension(m.staff, CFG).groupBy(
    "skill_level", measures.colour_skill(F.col("skill_level")).alias("colour")).agg(F.count(F.lit(1)).alias("technicians")))
add("key_insights", lambda m: measures.key_insights(
    bi(m, ["on_time_pct", "avg_turnaround_hours", "avg_rating", "profit_margin_pct"], ["center_name", "service_type"]), CFG))
add("report_header", lambda m: measures.report_header(
    bi(m, ["total_revenue", "total_cost", "profit"], [], True), CFG, CHOSEN))

# ---- import steps of the semantic model -----------------------------------------------------
add("dim_fill_null", lambda m: measures.fill_unassigned(m.jobs("work_order_id technician_id skill_level")).groupBy(
    "technician_id", "skill_level").agg(F.count(F.lit(1)).alias("jobs")))
add("dim_unknown_member", lambda m: measures.technician_dimension(m.staff, CFG).select(
    "technician_id", "skill_level", "certification", "hourly_cost", "skill_sort"))
add("dim_distinct", lambda m: measures.service_type_dimension(m.tables["appointments"]).select(
    F.lit("service_type").alias("dimension"), F.col("service_type").alias("member")).unionByName(
    measures.model_dimension(m.tables["vehicles"]).select(F.lit("model").alias("dimension"), F.col("model").alias("member"))))
add("dim_date_labels", lambda m: measures.date_dimension(facts.dim_date(m.spark, CFG)).join(
    m.jobs("service_date work_order_id").groupBy(F.col("service_date").alias("date")).agg(F.count(F.lit(1)).alias("jobs")), "date")
    .select("date", "month_start", "month_label", "weekday_sort", "jobs"))
add("sort_key", lambda m: measures.sort_keys(
    kpis.appointment_rates(m.appts, ["lead_time_band"]), "lead_time_band", LEAD_BANDS, "lead_band_sort").select(
    "lead_time_band", "lead_band_sort", "appointments"))

# ---- load verification, business hours ------------------------------------------------------
def _load_verify(m: Model) -> DataFrame:
    """Ordered load as a new version of a data set; what its pointer names is read back and counted."""
    tables = {n: m.tables[n] for n in schemas.LOAD_ORDER}
    target = f"{scratch_folder(m.spark)}/load-{uuid.uuid4().hex}"
    files.load_all(m.spark, tables, target)
    return files.verify_counts(tables, versions.current(m.spark, target).read(m.spark))


add("load_verify", _load_verify)
EXTRACT = T.StructType([
    T.StructField("customer_id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("segment", T.StringType()),
    T.StructField("balance", T.DoubleType()), T.StructField("registered", T.TimestampType()),
])


def _extract(m: Model) -> tuple[DataFrame, DataFrame]:
    """Customers as CSV extracts of three days, read back: (rows, rejected lines).

    The later extracts repeat every second and third customer with another balance. Of all
    lines some lack a field, have one too many, or hold text where a number belongs.
    """
    c = m.read("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    base = f"{scratch_folder(m.spark)}/extract-{uuid.uuid4().hex}"
    k = F.col("k")
    for day, every in enumerate((1, 2, 3)):
        balance = F.when(k % 19 == day, F.lit("n/a")).otherwise((k * 10 + day).cast("string"))
        stamp = F.when(k % 29 == day, F.lit("yesterday")).otherwise(F.concat(F.lit(f"2024-01-0{day + 1} 10:00:"), F.lpad((k % 60).cast("string"), 2, "0")))
        fields = [k.cast("string"), "name", "segment", balance, stamp]
        line = F.when(k % 17 == day, F.concat_ws(",", *fields[:3])).when(k % 23 == day, F.concat_ws(",", *fields, F.lit("more"))).otherwise(F.concat_ws(",", *fields))
        rows = c.where(k % every == 0).select(line.alias("customer_id,name,segment,balance,registered"))
        # Each part file starts with a header, as the extracts of a source system do.
        rows.write.option("header", True).option("sep", "\u0001").csv(f"{base}/day{day + 1}")  # whole lines
    return files.scan_csv(m.spark, base, EXTRACT)


add("csv_first_rows", lambda m: files.keep_first(_extract(m)[0], ["customer_id"]), digits=6)
add("csv_rejects", lambda m: _extract(m)[1].select(F.substring_index("file", "/", 1).alias("day"), "line"))
METRICS = (
    "service_scorecard", "cancellation_diag", "cancellation_lead_diag", "centre_diag", "monthly_diag", "yoy", "load_band_profile",
    "overloaded_share", "weekday_profile", "carry_over", "process_stages", "parts_delay_cat", "parts_delay_cat_centre",
    "parts_delay_impact", "abc_summary", "safety_stock", "skill_profile", "technician_diag", "rework_cost", "overrun_drivers",
    "reasons_by_centre", "technician_monthly_cost",
)


class SharedModel(Model):
    """A model whose job facts, daily load and part lines are built once and stored."""

    @cached_property
    def dataset(self) -> versions.Version:
        """Published by a plain model: here ``jobs`` already reads what that publishes."""
        return Model(self.spark, self.folder).dataset

    def jobs(self, columns: str) -> DataFrame:
        return self.stored

    def fs(self, columns: str | None = None) -> DataFrame:
        return metrics.with_calendar(self.stored)

    @cached_property
    def daily(self) -> DataFrame:
        return settle_table(metrics.daily_load(self.fs(), self.staff, CFG))

    @cached_property
    def lines(self) -> DataFrame:
        return settle_table(metrics.parts_lines(self.fs(), self.tables["part_usage"], self.tables["parts"]))


def compute_all(m: Model, target: str, names=METRICS) -> DataFrame:
    """Write every result to ``target`` from shared inputs; (name, rows) of what was written."""
    shared = SharedModel(m.spark, m.folder)
    written = files.save_parquet({n: RESULTS[n](shared) for n in names}, target)
    return validate.union_all([files.row_count(df, n, "rows").withColumnRenamed("table", "name") for n, df in written.items()])


add("metrics_job", lambda m: compute_all(m, f"{scratch_folder(m.spark)}/metrics-{uuid.uuid4().hex}"))
add("business_hours", lambda m: m.tables["work_orders"].select(
    "work_order_id",
    shopclock.align_to_open("end_time", CFG).alias("next_open"),
    shopclock.add_work_hours("check_in_time", F.col("estimated_hours").cast("double") + CFG.promise_buffer_hours, CFG).alias("promise"),
    shopclock.add_work_hours("end_time", F.col("actual_hours").cast("double") * 5, CFG).alias("long_job")))
add("round_quarter", lambda m: m.jobs("work_order_id turnaround_hours").select(
    "work_order_id", shopclock.round_quarter("turnaround_hours").alias("billed_hours")))

# ---- single cleaning rules -------------------------------------------------------------------
RULES = {
    "dedup_first": ("part_usage", "usage_id part_id quantity"),
    "canonicalise": ("customers", "customer_id region"),
    "parse_mixed_dates": ("appointments", "appointment_id booking_date scheduled_date"),
    "orphan_fk": ("appointments", "appointment_id vehicle_id"),
    "impute_via_lookup": ("appointments", "appointment_id center_id"),
    "swap_times": ("work_orders", "work_order_id start_time end_time"),
    "null_invalid_fk": ("work_orders", "work_order_id technician_id"),
    "fix_sign": ("financials", "work_order_id labor_cost"),
    "impute_from_agg": ("financials", "work_order_id parts_cost"),
    "fix_decimal_shift": ("financials", "work_order_id revenue"),
    "cascade_delete": ("feedback", "feedback_id work_order_id rating"),
}
for _name, (_t, _c) in RULES.items():
    add(_name, lambda m, _t=_t: cleaned(m)[_t].rows, *_c.split())


def _reconcile(m: Model) -> DataFrame:
    """Billed parts against the usage ledger of the cleaned tables, beyond one rupee."""
    p = cleaned(m)
    used = clean.usage_cost(p["part_usage"].rows, m.tables["parts"])
    billed = p["financials"].rows.join(used, F.col("work_order_id") == F.col("_job"), "left")
    gap = F.col("parts_cost") - F.coalesce("_usage", F.lit(0))
    return billed.select("work_order_id", gap.cast("decimal(18,2)").alias("difference")).where(F.abs("difference") > 1)


add("reconcile", _reconcile)

# ---- generic operators on the raw tables -------------------------------------------------------
add("lineitem_spearman", lambda m: stats.spearman(
    m.read("lineitem").select("l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice"), digits=6)
add("lineitem_chi2", lambda m: stats.chi2(m.read("lineitem"), "l_returnflag", "l_linestatus"), digits=6)
add("lineitem_abc", lambda m: metrics.classify_abc(
    m.read("lineitem").groupBy("l_partkey").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(14,2)")).cast("decimal(24,2)").alias("value")), "value"), digits=6)
add("lineitem_kruskal", lambda m: stats.kruskal(
    m.read("lineitem").select("l_returnflag", F.col("l_extendedprice").cast("decimal(14,2)").alias("price")), "l_returnflag", "price"), digits=4)
add("orders_describe", lambda m: explore.describe(m.read("orders"), ["o_totalprice"]), digits=3)
add("orders_iqr", lambda m: explore.iqr_outliers(m.read("orders"), ["o_totalprice"]), digits=4)
add("orders_crosstab", lambda m: shape.row_shares(shape.crosstab(m.read("orders"), "o_orderpriority", "o_orderstatus"), "o_orderpriority"), digits=6)
add("customer_segments", lambda m: explore.top_shares(m.read("customer"), ["c_mktsegment"]), digits=6)
add("events_monthly", lambda m: measures.previous_month(
    m.read("events").groupBy(F.trunc("ts", "MM").alias("month_start")).agg(
        F.count(F.lit(1)).alias("events"), F.sum(F.col("value").cast("decimal(14,2)")).alias("value")), "value"), digits=6)
def _events_daily(m: Model) -> DataFrame:
    """Events by day with the day before; days without events have no row."""
    days = m.read("events").groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("events"), F.sum(F.col("value").cast("decimal(14,2)")).alias("value"))
    before = days.select(F.date_add("day", 1).alias("day"), F.col("events").alias("events_before"), F.col("value").alias("value_before"))
    return days.join(before, "day", "left")


add("events_daily", _events_daily, digits=6)
add("events_bands", lambda m: m.read("events").groupBy("event_type", band("value", (1, 5, 10, 50), ("<=1", "1-5", "5-10", "10-50", ">50")).alias("value_band"))
    .agg(F.count(F.lit(1)).alias("events")))
