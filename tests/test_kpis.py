"""KPI library on hand-built frames with known answers."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from bayworks.config import Config
from bayworks.operators.filters import Selection, apply_selection, select, slicer_options
from bayworks.operators.shape import extremes
from bayworks.plans import kpis

CFG = Config()
JOB = {
    "work_order_id": "W0", "customer_id": "CU1", "center_name": "Alpha", "region": "South",
    "service_type": "Periodic Service", "model": "M1", "technician_id": "T1", "skill_level": "Senior",
    "revenue": 0.0, "labor_cost": 0.0, "parts_cost": 0.0, "cost_variance": 0.0, "cost_variance_pct": 0.0,
    "cost_overrun_flag": False, "on_time_flag": True, "late_hours": 0.0, "turnaround_hours": 1.0,
    "wait_hours": 0.5, "estimated_hours": 1.0, "actual_hours": 1.0, "duration_variance_hours": 0.0,
    "rating": None, "caused_repeat_visit": False, "parts_delay_flag": False, "qc_passed_first_time": True,
    "feedback_category": "Service Quality", "month": "2025-01", "service_date": date(2025, 1, 6),
}
SCHEMA = (
    "work_order_id string, customer_id string, center_name string, region string, service_type string, "
    "model string, technician_id string, skill_level string, revenue double, labor_cost double, "
    "parts_cost double, cost_variance double, cost_variance_pct double, cost_overrun_flag boolean, "
    "on_time_flag boolean, late_hours double, turnaround_hours double, wait_hours double, "
    "estimated_hours double, actual_hours double, duration_variance_hours double, rating int, "
    "caused_repeat_visit boolean, parts_delay_flag boolean, qc_passed_first_time boolean, "
    "feedback_category string, month string, service_date date"
)
ROWS = [
    dict(revenue=1000.0, labor_cost=200.0, parts_cost=400.0, rating=5, turnaround_hours=2.0, wait_hours=0.5,
         cost_variance=50.0, cost_overrun_flag=True, estimated_hours=2.0, actual_hours=2.5,
         duration_variance_hours=0.5),
    dict(revenue=600.0, labor_cost=100.0, parts_cost=300.0, rating=3, turnaround_hours=6.0, wait_hours=1.5,
         on_time_flag=False, late_hours=1.5, caused_repeat_visit=True, parts_delay_flag=True, month="2025-02",
         service_date=date(2025, 2, 4), feedback_category="Turnaround Time", qc_passed_first_time=False),
    dict(center_name="Beta", region="North", service_type="Brake Service", model="M2", revenue=400.0,
         labor_cost=100.0, parts_cost=100.0, feedback_category=None, customer_id="CU2", technician_id="T2",
         skill_level="Junior", turnaround_hours=4.0, wait_hours=1.0, service_date=date(2025, 2, 20),
         month="2025-02"),
    dict(center_name="Beta", region="North", service_type="Brake Service", model="M2", revenue=200.0,
         labor_cost=50.0, parts_cost=50.0, rating=4, customer_id="CU3", technician_id="T2", skill_level="Junior",
         turnaround_hours=12.0, wait_hours=2.0, on_time_flag=False, late_hours=9.0,
         service_date=date(2025, 3, 5), month="2025-03", feedback_category="Parts Availability"),
]


def jobs(spark, rows):
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    data = [{**JOB, "work_order_id": f"W{i}", **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(d[n] for n in names) for d in data], SCHEMA)


@pytest.fixture(scope="module")
def fact(spark):
    return jobs(spark, ROWS).cache()


@pytest.fixture(scope="module")
def appts(spark):
    rows = [
        ("A1", "Alpha", "South", "1-3 days", False, False, None, date(2025, 1, 5)),
        ("A2", "Alpha", "South", "4-7 days", True, False, "Price Concern", date(2025, 1, 6)),
        ("A3", "Alpha", "South", "Same day", False, True, None, date(2025, 1, 7)),
        ("A4", "Beta", "North", "1-3 days", True, False, "Personal Reasons", date(2025, 2, 10)),
    ]
    return spark.createDataFrame(
        rows,
        "appointment_id string, center_name string, region string, lead_time_band string, is_cancelled boolean, "
        "is_no_show boolean, cancellation_reason string, scheduled_date date",
    )


@pytest.fixture(scope="module")
def tech(spark):
    rows = [
        ("T1", "Alpha", "South", "Senior", "2025-01", 10, 80.0, 160.0, 0),
        ("T1", "Alpha", "South", "Senior", "2025-02", 10, 120.0, 160.0, 0),
        ("T2", "Beta", "North", "Junior", "2025-01", 5, 40.0, 160.0, 2),
    ]
    return spark.createDataFrame(
        rows,
        "technician_id string, center_name string, region string, skill_level string, month string, jobs int, "
        "service_hours double, available_hours double, comebacks_caused int",
    )


def test_headline_known_values(fact, appts, tech):
    k = kpis.headline(fact, appts, tech, CFG).first().asDict()
    expected = {
        "work_orders": 4, "revenue": 2200, "total_cost": 1300, "profit": 900, "margin_pct": 900 / 2200,
        "parts_share": 850 / 1300, "avg_service_cost": 325, "on_time_pct": 0.5, "avg_turnaround": 6.0,
        "median_turnaround": 5.0, "cost_variance": 50, "cost_overrun_rate": 0.25, "avg_rating": 4.0,
        "csat_pct": 2 / 3, "rated_orders": 3, "comeback_rate": 0.25, "parts_delay_rate": 0.25,
        "qc_first_pass_rate": 0.75, "avg_wait": 1.25, "avg_duration_variance": 0.125,
        "repeat_visit_rate": 1 / 3, "appointments": 4, "cancellation_rate": 0.5, "no_show_rate": 0.25,
        "utilisation": 240 / 480,
    }
    assert {n: k[n] for n in expected} == pytest.approx(expected)


def test_empty_inputs_give_zero_sums_and_null_ratios(fact, appts, tech):
    none = F.lit(False)
    k = kpis.headline(fact.where(none), appts.where(none), tech.where(none), CFG).first()
    assert (k["work_orders"], k["revenue"], k["profit"], k["appointments"]) == (0, 0, 0, 0)
    assert k["margin_pct"] is None and k["on_time_pct"] is None and k["utilisation"] is None


def test_groups_drop_null_keys_and_keep_rates(fact, spark):
    extra = fact.unionByName(fact.limit(1).withColumn("center_name", F.lit(None).cast("string")))
    rows = {r["center_name"]: r for r in kpis.group_kpis(extra, ["center_name"], CFG).collect()}
    assert set(rows) == {"Alpha", "Beta"}
    assert rows["Alpha"]["repeat_visit_rate"] == 1.0 and rows["Beta"]["repeat_visit_rate"] == 0.0
    assert rows["Beta"]["csat_pct"] == 1.0 and rows["Beta"]["revenue"] == 600


def test_monthly_change(fact):
    rows = kpis.monthly_trend(fact, CFG).collect()
    assert [r["month"] for r in rows] == ["2025-01", "2025-02", "2025-03"]
    assert rows[0]["revenue_mom_pct"] is None
    assert rows[2]["revenue_mom_pct"] == pytest.approx(200 / 1000 - 1)


def test_late_bands_are_right_closed_and_zero_filled(spark):
    fact = jobs(spark, [dict(late_hours=h) for h in (0.0, 0.0, 0.5, 1.0, 3.0, 30.0)])
    got = {r["band"]: (r["work_orders"], r["share"]) for r in kpis.delay_distribution(fact).collect()}
    assert got["On time"] == (2, pytest.approx(2 / 6)) and got["0-1h"][0] == 2
    assert got["2-4h"][0] == 1 and got["> 24h"][0] == 1 and got["4-8h"] == (0, 0.0)


def test_scorecard_rank_and_average_method(spark, fact, appts, tech):
    rows = kpis.centre_scorecard(fact, appts, tech, CFG).collect()
    assert {r["rank"] for r in rows} <= {1, 2} and len(rows) == 2
    tied = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", None)], "k string, v double")
    got = {r["k"]: r["p"] for r in tied.select("k", kpis.average_rank("v").alias("p")).collect()}
    assert got == {"a": pytest.approx(1 / 3), "b": pytest.approx(2.5 / 3), "c": pytest.approx(2.5 / 3), "d": None}


def test_parts_by_category_uses_filtered_jobs_only(spark, fact):
    parts = spark.createDataFrame(
        [("P1", "Brakes", 100.0), ("P2", "Tyres", 250.0)], "part_id string, part_category string, unit_cost double"
    )
    usage = spark.createDataFrame(
        [("W0", "P1", 1), ("W1", "P1", 2), ("W1", "P2", 2), ("W9", "P2", 5)],
        "work_order_id string, part_id string, quantity int",
    )
    got = {r["part_category"]: r["parts_cost"] for r in kpis.parts_by_category(usage, parts, fact).collect()}
    assert {k: float(v) for k, v in got.items()} == {"Brakes": 300.0, "Tyres": 500.0}


@pytest.mark.parametrize(
    ("chosen", "expected"),
    [
        (Selection(), 4),
        (select(last=date(2025, 2, 20)), 3),
        (select(date(2025, 2, 4), date(2025, 2, 4)), 1),
        (select(region=("North",), service_type=("Brake Service",)), 2),
        (select(region=("North",), model=("M1",)), 0),
    ],
)
def test_slicers(fact, chosen, expected):
    assert apply_selection(fact, chosen, "fact").count() == expected


def test_end_day_includes_its_last_second(spark):
    df = spark.sql("select timestamp'2025-02-04 23:59:59' as service_date")
    assert apply_selection(df, select(last=date(2025, 2, 4)), "fact").count() == 1


def test_month_overlap(tech):
    chosen = select(date(2025, 1, 31), date(2025, 1, 31))
    assert apply_selection(tech, chosen, "tech").count() == 2
    assert apply_selection(tech, select(model=("M1",)), "tech").count() == 3


def test_slicer_options(fact):
    rows = {(r["slicer"], r["choice"]) for r in slicer_options(fact).collect()}
    assert ("min_date", "2025-01-06") in rows and ("max_date", "2025-03-05") in rows
    assert ("centre", "Beta") in rows and len(rows) == 10


def test_extremes_need_two_rows(spark):
    one = spark.createDataFrame([("a", 1.0), ("b", None)], "k string, v double")
    assert extremes(one, "k", "v").count() == 0


def test_tercile_flag(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "k string, v double")
    got = {r["k"]: r["f"] for r in kpis.tercile_flag(df, "v", "low", "f").collect()}
    assert got == {"a": "good", "b": "", "c": "bad"}
    flat = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    assert {r["f"] for r in kpis.tercile_flag(flat, "v", "low", "f").collect()} == {""}


def test_an_insight_that_cannot_be_told_leaves_the_other(spark):
    from bayworks.plans import insights

    two = spark.createDataFrame([("a", 2.0, 1.5), ("b", 4.0, 3.0)], "center_name string, avg_turnaround double, median_turnaround double")
    one_day = spark.createDataFrame([("Monday", 1.0)], "weekday string, avg_wait double")
    row = insights.operations(two, one_day).first()
    assert row["slowest_centre"] == "b" and row["longest_wait_day"] is None
    row = insights.operations(two.limit(1), one_day.union(spark.createDataFrame([("Friday", 2.0)], "d string, w double"))).first()
    assert row["slowest_centre"] is None and row["longest_wait_day"] == "Friday"
