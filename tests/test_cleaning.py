"""Cleaning rules, fact semantics, round trips through files."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from bayworks.config import Config
from bayworks.operators import clean
from bayworks.operators.validate import validate
from bayworks.plans import facts, quality
from bayworks.plans.bound import CFG as BOUND
from bayworks.plans.bound import Model
from bayworks.session import settle
from bayworks.sources import defects, files, schemas, versions

CFG = Config(
    model_aliases={"model a": "Model A", "a": "Model A", "model b": "Model B"},
    model_first_year={"Model A": 2020, "Model B": 2024},
)
SMALL = "/root/testdata/sf0.001"


def raw(spark, table, *rows):
    """Raw rows from dictionaries; missing columns are null."""
    schema = schemas.raw_schema(table)
    data = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
    return spark.createDataFrame(data, schema)


def log_of(cleaned, rule, column=None):
    lines = [r for f in cleaned.log for r in f.collect()]
    return [r["rows_affected"] for r in lines if r["rule_id"] == rule and column in (None, r["column"])]


def test_vehicle_rules(spark):
    ok = {"customer_id": "C", "variant": "s", "vehicle_category": "x", "battery_kwh": Decimal("3.0")}
    df = raw(
        spark, "vehicles",
        {"vehicle_id": "1", "model": " MODEL  a", "model_year": 2019, "purchase_date": "2023-05-01", "mileage_km": Decimal("10.0"), **ok},
        {"vehicle_id": "2", "model": "Model B", "model_year": 2024, "purchase_date": "01/06/2024", "mileage_km": Decimal("-5.0"), **ok},
        {"vehicle_id": "3", "model": "Other", "model_year": 2024, "purchase_date": "2024-01-01", "mileage_km": Decimal("900000.0"), **ok},
        {"vehicle_id": "4", "model": "Model A", "model_year": 2027, "purchase_date": "2026-10-10", "mileage_km": Decimal("250.0"), **ok},
        {"vehicle_id": "4", "model": "Model A", "model_year": 2027, "purchase_date": "2026-10-10", "mileage_km": Decimal("250.0"), **ok},
    )
    out = clean.clean_vehicles(df, CFG)
    rows = {r["vehicle_id"]: r for r in out.rows.collect()}
    assert rows["1"]["model"] == "Model A" and rows["1"]["model_year"] == 2023
    assert rows["2"]["purchase_date"] == date(2024, 6, 1) and rows["2"]["mileage_km"] is None
    assert rows["3"]["model"] is None and rows["3"]["mileage_km"] is None
    assert rows["4"]["model_year"] == 2026 and rows["4"]["mileage_km"] == Decimal("250.0")  # one day at least
    assert log_of(out, "DQ01") == [1] and log_of(out, "DQ15") == [2] and log_of(out, "DQ16") == [2]
    assert log_of(out, "DQ03") == [2] and log_of(out, "DQ02") == [0]


def test_appointment_rules(spark):
    base = {"booking_channel": "App", "requested_service_type": " Brake  Service", "status": "Completed"}
    df = raw(
        spark, "appointments",
        {"appointment_id": "1", "vehicle_id": "V", "center_id": "C1", "booking_date": "2025-02-09", "scheduled_date": "05/02/2025", **base},
        {"appointment_id": "2", "vehicle_id": "V", "center_id": "C1", "booking_date": "2024-12-01", "scheduled_date": "2024-12-31", **base},
        {"appointment_id": "3", "vehicle_id": "gone", "center_id": "C1", "booking_date": "2025-02-01", "scheduled_date": "2025-02-05", **base},
        {"appointment_id": "4", "vehicle_id": "V", "booking_date": "2025-02-01", "scheduled_date": "2025-02-05", **{**base, "status": "canceled "}},
        {"appointment_id": "5", "vehicle_id": "V", "booking_date": "2025-02-01", "scheduled_date": "2025-02-05", **base},
    )
    vehicles = spark.createDataFrame([("V",)], "vehicle_id string")
    staff = spark.createDataFrame([("T1", "C7")], "technician_id string, center_id string")
    jobs = raw(
        spark, "work_orders",
        {"work_order_id": "1", "appointment_id": "4", "technician_id": "T1"},
        {"work_order_id": "2", "appointment_id": "5", "technician_id": "nobody"},
    )
    out = clean.clean_appointments(df, vehicles, jobs, staff, CFG)
    rows = {r["appointment_id"]: r for r in out.rows.collect()}
    assert set(rows) == {"1", "4"}
    assert rows["1"]["booking_date"] == rows["1"]["scheduled_date"] == date(2025, 2, 5)
    assert rows["1"]["requested_service_type"] == "Brake Service"
    assert rows["4"]["center_id"] == "C7" and rows["4"]["status"] == "Cancelled"
    assert log_of(out, "DQ05") == [1, 1] and log_of(out, "DQ06") == [1] and log_of(out, "DQ07") == [1, 1]
    assert log_of(out, "DQ04") == [1] and log_of(out, "DQ20") == [1]


def test_work_order_rules(spark):
    appts = spark.createDataFrame([("A1", "Brake Service")], "appointment_id string, requested_service_type string")
    staff = spark.createDataFrame([("T1",)], "technician_id string")
    t = {"check_in_time": "2025-01-06 09:00:00", "promised_ready_time": "2025-01-06 12:00:00"}
    df = raw(
        spark, "work_orders",
        {"work_order_id": "1", "appointment_id": "A1", "technician_id": "T1", "service_type": "BRAKE  service",
         "start_time": "2025-01-06 11:00:00", "end_time": "2025-01-06 10:00:00", "qc_passed_first_time": "True", **t},
        {"work_order_id": "2", "appointment_id": "A1", "technician_id": "T9", "service_type": "Unknown",
         "end_time": "2025-01-06 10:00:00", **t},
        {"work_order_id": "3", "appointment_id": "lost", "service_type": "Brake Service", "end_time": "2025-01-06 10:00:00", **t},
    )
    out = clean.clean_work_orders(df, appts, staff, CFG)
    rows = {r["work_order_id"]: r for r in out.rows.collect()}
    assert set(rows) == {"1", "2"}
    assert rows["1"]["start_time"] == datetime(2025, 1, 6, 10) and rows["1"]["end_time"] == datetime(2025, 1, 6, 11)
    assert rows["1"]["service_type"] == "Brake Service" and rows["1"]["qc_passed_first_time"] is True
    assert rows["2"]["technician_id"] is None and rows["2"]["service_type"] is None
    assert log_of(out, "DQ08") == [1] and log_of(out, "DQ09") == [1] and log_of(out, "DQ10") == [1]
    assert log_of(out, "DQ18") == [1]


def test_money_rules(spark):
    jobs = spark.createDataFrame([(str(i),) for i in range(1, 5)], "work_order_id string")
    parts = spark.createDataFrame([("P", Decimal("50.00"))], "part_id string, unit_cost decimal(12,2)")
    usage = spark.createDataFrame([("2", "P", 3)], "work_order_id string, part_id string, quantity int")
    d = Decimal
    df = raw(
        spark, "financials",
        {"work_order_id": "1", "billing_type": "Warranty", "estimated_cost": d(10), "labor_cost": d(-20), "parts_cost": d(0), "revenue": d(30)},
        {"work_order_id": "2", "billing_type": "Warranty", "estimated_cost": d(10), "labor_cost": d(20), "revenue": d(30)},
        {"work_order_id": "3", "billing_type": "Warranty", "estimated_cost": d(10), "labor_cost": d(500), "parts_cost": d(0), "revenue": d("60000.50")},
        {"work_order_id": "4", "billing_type": "Warranty", "estimated_cost": d(10), "labor_cost": d(500), "parts_cost": d(0), "revenue": d("50000")},
    )
    out = clean.clean_financials(df, jobs, usage, parts, CFG)
    rows = {r["work_order_id"]: r for r in out.rows.collect()}
    assert rows["1"]["labor_cost"] == 20 and rows["2"]["parts_cost"] == 150
    assert rows["3"]["revenue"] == d("600.01") and rows["4"]["revenue"] == 50000  # floor is exclusive
    assert log_of(out, "DQ11") == [0, 1, 0, 0] and log_of(out, "DQ12") == [1] and log_of(out, "DQ13") == [1]


def test_feedback_rules_and_keep_first(spark):
    jobs = spark.createDataFrame([("W1",), ("W2",)], "work_order_id string")
    df = raw(
        spark, "feedback",
        {"feedback_id": "1", "work_order_id": "W1", "rating": 4, "feedback_category": "x", "feedback_date": "2025-01-01"},
        {"feedback_id": "2", "work_order_id": "W1", "rating": 5, "feedback_category": "x", "feedback_date": "2025-01-02"},
        {"feedback_id": "3", "work_order_id": "W2", "rating": 6, "feedback_category": "x", "feedback_date": "2025-01-01"},
        {"feedback_id": "4", "work_order_id": "W2", "feedback_category": "x", "feedback_date": "2025-01-01"},
        {"feedback_id": "5", "work_order_id": "gone", "rating": 1, "feedback_category": "x", "feedback_date": "2025-01-01"},
    )
    out = clean.clean_feedback(clean.with_ordinal(df.coalesce(1)), jobs)
    assert [(r["feedback_id"], r["rating"]) for r in out.rows.collect()] == [("1", 4)]
    assert log_of(out, "DQ14") == [1, 1] and log_of(out, "DQ18") == [1] and log_of(out, "DQ02") == [0, 1]


def test_keep_first_follows_input_order(spark):
    df = raw(
        spark, "part_usage",
        {"usage_id": "U", "work_order_id": "W", "part_id": "P", "quantity": 9},
        {"usage_id": "U", "work_order_id": "W", "part_id": "P", "quantity": 1},
        {"usage_id": "U", "work_order_id": "W", "part_id": "P", "quantity": 0},
    )
    jobs = spark.createDataFrame([("W",)], "work_order_id string")
    parts = spark.createDataFrame([("P",)], "part_id string")
    out = clean.clean_part_usage(clean.with_ordinal(df.coalesce(1)), jobs, parts)
    assert [r["quantity"] for r in out.rows.collect()] == [9]
    assert log_of(out, "DQ17") == [1, 0] and log_of(out, "DQ02") == [1]


# ---- facts ----------------------------------------------------------------------------------
def tables(spark, jobs):
    """A minimal model around the given jobs: (id, vehicle, check-in, start, end, promise)."""
    wo = raw(spark, "work_orders", *[
        {"work_order_id": i, "appointment_id": i, "technician_id": "T", "service_type": "S",
         "estimated_hours": Decimal(2), "actual_hours": Decimal("2.5"), "parts_wait_hours": Decimal(0)} for i, *_ in jobs
    ])
    times = spark.createDataFrame(
        [(i, a, b, c, d) for i, _, a, b, c, d in jobs],
        "work_order_id string, check_in_time timestamp, start_time timestamp, end_time timestamp, promised_ready_time timestamp",
    )
    wo = wo.drop("check_in_time", "start_time", "end_time", "promised_ready_time").join(times, "work_order_id")
    owners = sorted({v for _, v, *_ in jobs})
    return {
        "work_orders": wo.withColumn("qc_passed_first_time", F.lit(True)),
        "appointments": spark.createDataFrame(
            [(i, v, "C", "App") for i, v, *_ in jobs],
            "appointment_id string, vehicle_id string, center_id string, booking_channel string",
        ),
        "vehicles": spark.createDataFrame(
            [(v, "CU", "M", "x", "y", date(2024, 1, 1)) for v in owners],
            "vehicle_id string, customer_id string, model string, variant string, vehicle_category string, purchase_date date",
        ),
        "customers": spark.createDataFrame([("CU", "Fleet")], "customer_id string, customer_type string"),
        "service_centers": spark.createDataFrame(
            [("C", "Centre", "City", "South")], "center_id string, center_name string, city string, region string"
        ),
        "technicians": spark.createDataFrame(
            [("T", "C", "Mid")], "technician_id string, center_id string, skill_level string"
        ),
        "financials": spark.createDataFrame(
            [(i, "Warranty", Decimal(e), Decimal(60), Decimal(50), Decimal(200)) for (i, *_), e in zip(jobs, [100, 0, 110, 50, 50])],
            "work_order_id string, billing_type string, estimated_cost decimal(12,2), labor_cost decimal(12,2), parts_cost decimal(12,2), revenue decimal(12,2)",
        ),
        "feedback": spark.createDataFrame([], "work_order_id string, rating smallint, feedback_category string"),
    }


def test_fact_measures_and_repeat_window(spark):
    at = datetime
    jobs = [
        ("1", "V1", at(2025, 1, 1, 9), None, at(2025, 1, 1, 11), at(2025, 1, 1, 11)),  # exactly on time
        ("2", "V1", at(2025, 2, 1, 10), at(2025, 2, 1, 10, 30), at(2025, 2, 1, 12), at(2025, 2, 1, 11)),  # 30 d 23 h
        ("3", "V1", at(2025, 3, 4, 12), at(2025, 3, 4, 12), at(2025, 3, 4, 13), at(2025, 3, 4, 14)),  # 31 days
        ("4", "V2", at(2025, 1, 15, 9), at(2025, 1, 15, 9), at(2025, 1, 15, 10), at(2025, 1, 15, 10)),
    ]
    rows = {r["work_order_id"]: r for r in facts.fact_service(tables(spark, jobs), CFG).collect()}
    assert rows["1"]["wait_hours"] is None and rows["1"]["on_time_flag"] and rows["1"]["late_hours"] == 0
    assert rows["2"]["late_hours"] == 1 and not rows["2"]["on_time_flag"] and rows["2"]["wait_hours"] == Decimal("0.50")
    assert rows["1"]["cost_variance_pct"] == Decimal("0.1000") and not rows["1"]["cost_overrun_flag"]  # exactly 10 %
    assert rows["2"]["cost_variance_pct"] is None and not rows["2"]["cost_overrun_flag"]
    assert rows["2"]["days_since_same_service"] == 30 and rows["2"]["is_repeat_visit"] and rows["1"]["caused_repeat_visit"]
    assert rows["3"]["days_since_same_service"] == 31 and not rows["3"]["is_repeat_visit"]
    assert not rows["2"]["caused_repeat_visit"] and not rows["4"]["is_repeat_visit"]
    assert {i: r["customer_visit_number"] for i, r in rows.items()} == {"1": 1, "4": 2, "2": 3, "3": 4}
    assert rows["1"]["vehicle_age_years"] == Decimal("1.00") and rows["1"]["profit"] == 90


def test_column_driven_fact_equals_the_full_one(spark):
    m = Model(spark, SMALL)
    names = ["work_order_id", "revenue", "on_time_flag", "center_name"]
    lean, full = m.jobs(" ".join(names)).select(names), m.fact.select(names)
    assert lean.exceptAll(full).count() == 0 and full.exceptAll(lean).count() == 0


def test_calendar(spark):
    days = facts.dim_date(spark, CFG)
    assert days.count() == 638 and facts.working_days(spark, CFG).first()[0] == 547
    assert len(CFG.months) == 21 and facts.month_calendar(spark, CFG).count() == 21


# ---- round trips ------------------------------------------------------------------------------
def test_defects_are_found_and_repaired(spark):
    """Inject, clean, compare with the truth."""
    m = Model(spark, SMALL)
    truth = m.tables.all()
    raw_tables = defects.inject(truth, BOUND, 40)
    pipeline = clean.Pipeline(raw_tables, BOUND, settle)
    rows = pipeline.rows()
    found = clean.reconcile_defects(defects.manifest(truth, BOUND, 40), clean.cleaning_log(pipeline)).collect()
    assert len(found) == 24
    exact = {(r["table"], r["injected_defect"]) for r in found if r["status"] == "Match"}
    assert {("vehicles", "impossible_model_year"), ("appointments", "status_format_variants"),
            ("appointments", "ddmmyyyy_dates"), ("customers", "region_format_variants")} <= exact
    kept = truth["appointments"].join(rows["appointments"].select("appointment_id"), "appointment_id", "left_semi")
    columns = ["appointment_id", "vehicle_id", "status", "scheduled_date", "booking_date"]
    assert rows["appointments"].select(columns).exceptAll(kept.select(columns)).count() == 0
    spelled = rows["work_orders"].join(truth["work_orders"].alias("t"), "work_order_id")
    assert spelled.where(F.col("t.service_type") != rows["work_orders"]["service_type"]).count() == 0


def test_defects_are_drawn_for_keys_of_any_size(spark):
    keys = [0, 7, 9 * 10**14 + 41, 2**62 + 5]
    df = spark.createDataFrame([(k, k % 5, 1, 3) for k in keys], "usage_id long, work_order_id long, part_id long, quantity int")
    drawn = [r[0] for r in df.select(defects.draw(F.col("usage_id"), 18)).collect()]
    assert sorted(drawn) == sorted((k * 48_271 + 18 * 7_919) % 2_147_483_647 % 10_000 for k in keys)
    assert defects.inject({"part_usage": df}, CFG)["part_usage"].count() == len(keys)


def test_checks_on_the_undamaged_model(spark):
    t = {k: settle(v) for k, v in Model(spark, SMALL).tables.all().items()}
    got = {r["check_id"]: r["issue_count"] for r in quality.summary(t, BOUND).collect()}
    assert len(got) == 50
    assert all(got[quality.check_id(n)] == 0 for n in (1, 2, 5, 6, 7, 9, 10, 11, 12, 13, 14, 21, 22, 25, 26, 29, 36))
    broken = validate(t, schemas.table_rules(BOUND)).where("violations > 0").collect()
    assert {(r["table"], r["constraint"]) for r in broken} == set()


def test_csv_round_trip_and_verified_load(spark, tmp_path):
    t = {k: settle(v) for k, v in Model(spark, SMALL).tables.all().items()}
    base = str(tmp_path / "csv")
    files.write_csv({k: t[k] for k in ("work_orders", "vehicles")}, base)
    back = files.load_cleaned_csv(spark, base, ["work_orders", "vehicles"])
    assert back["work_orders"].count() == t["work_orders"].count()
    row = back["work_orders"].where("start_time is not null").orderBy("work_order_id").first()
    same = t["work_orders"].where(f"work_order_id = {row['work_order_id']}").first()
    assert row["end_time"] == same["end_time"] and row["actual_hours"] == same["actual_hours"]
    target = str(tmp_path / "warehouse")
    for _ in range(2):  # the second load replaces the first
        report = files.load_all(spark, t, target)
        assert report.count() == 10 and report.where("not ok").count() == 0
    loaded = versions.current(spark, target)
    assert loaded.number == 2 and files.missing_tables(spark, loaded.folder, schemas.TABLES) == []
    assert files.missing_tables(spark, target, ["nothing"]) == ["nothing"]


def test_raw_csv_reader_keeps_text_and_order(spark, tmp_path):
    for name in schemas.TABLES:
        (tmp_path / f"{name}.csv").write_text(",".join(f.name for f in schemas.raw_schema(name).fields) + "\n")
    (tmp_path / "feedback.csv").write_text(
        "feedback_id,work_order_id,rating,feedback_category,feedback_date\nF1,W1,5,Pricing,05/03/2026\nF2,W2,,Pricing,2026-03-06\n"
    )
    df = files.load_raw(spark, str(tmp_path))["feedback"].orderBy("_ord")
    assert [(r["feedback_id"], r["rating"], r["feedback_date"]) for r in df.collect()] == [
        ("F1", 5, "05/03/2026"), ("F2", None, "2026-03-06"),
    ]


def test_failing_report_does_not_stop_the_others(spark, tmp_path):
    good = spark.range(3)
    bad = spark.range(1).select(F.raise_error(F.lit("boom")).alias("x"))
    log = files.save_results({"bad": bad, "good": good}, str(tmp_path))
    assert [x["status"] for x in log] == ["failed", "ok"]


def test_failed_verification_is_reported(spark):
    two, three = spark.range(2), spark.range(3)
    row = files.verify_counts({"t": two}, {"t": three}).first()
    assert (row["expected"], row["actual"], row["ok"]) == (2, 3, False)


def test_views_are_usable_from_sql(spark):
    from bayworks.plans.views import register_views

    names = register_views(spark, Model(spark, SMALL).tables.all(), BOUND)
    assert "vw_kpi_summary" in names and len(names) == 20
    assert spark.sql("select sum(work_orders) from vw_service_type_performance").first()[0] > 0


@pytest.mark.parametrize("value", [0, 1])
def test_schema_defaults(spark, value):
    df = raw(spark, "work_orders", {"work_order_id": "1", "parts_wait_hours": None if value == 0 else Decimal(1)})
    assert schemas.with_defaults(df, "work_orders").first()["parts_wait_hours"] == value


def test_ordinal_follows_the_files_whatever_their_sizes(spark, tmp_path):
    for name, first, n in (("a", 0, 3), ("b", 100, 4000), ("c", 9000, 40)):
        (tmp_path / f"{name}.csv").write_text("k\n" + "".join(f"{first + i}\n" for i in range(n)))
    df = spark.read.option("header", True).schema("k int").csv(str(tmp_path))
    got = [r["k"] for r in clean.with_ordinal(df, files=True).orderBy("_ord").collect()]
    assert got == sorted(got) and len(got) == 4043
