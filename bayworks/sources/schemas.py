"""Declared tables: types, keys, references and checks, plus the untyped raw twins."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bayworks.config import REWORK, Config
from bayworks.functions.scalars import any_of

# ---- fixed values: column names and types of the normalised tables ---------------
DDL = {
    "customers": "customer_id string, customer_type string, city string, region string, registration_date date",
    "service_centers": """center_id string, center_name string, city string, state string, region string,
        service_bays smallint, daily_job_capacity smallint, opened_date date""",
    "technicians": """technician_id string, center_id string, skill_level string, years_experience smallint,
        certification string, hourly_cost decimal(10,2), shift_hours_per_day smallint""",
    "vehicles": """vehicle_id string, customer_id string, model string, variant string, vehicle_category string,
        battery_kwh decimal(4,1), model_year smallint, purchase_date date, mileage_km decimal(10,1)""",
    "appointments": """appointment_id string, vehicle_id string, center_id string, booking_date date,
        scheduled_date date, scheduled_slot string, booking_channel string, requested_service_type string,
        status string, cancellation_reason string""",
    "work_orders": """work_order_id string, appointment_id string, technician_id string, service_type string,
        check_in_time timestamp, start_time timestamp, end_time timestamp, promised_ready_time timestamp,
        estimated_hours decimal(6,2), actual_hours decimal(6,2), parts_wait_hours decimal(6,2),
        odometer_km int, additional_work_found boolean, qc_passed_first_time boolean""",
    "parts": """part_id string, part_name string, part_category string, unit_cost decimal(12,2),
        compatible_models string, supplier_lead_days smallint""",
    "part_usage": "usage_id string, work_order_id string, part_id string, quantity int",
    "financials": """work_order_id string, billing_type string, estimated_cost decimal(12,2),
        labor_cost decimal(12,2), parts_cost decimal(12,2), revenue decimal(12,2)""",
    "feedback": """feedback_id string, work_order_id string, rating smallint, feedback_category string,
        feedback_date date""",
}
PRIMARY_KEYS = {
    "customers": "customer_id",
    "vehicles": "vehicle_id",
    "service_centers": "center_id",
    "technicians": "technician_id",
    "appointments": "appointment_id",
    "work_orders": "work_order_id",
    "parts": "part_id",
    "part_usage": "usage_id",
    "financials": "work_order_id",
    "feedback": "feedback_id",
}
TABLES = tuple(PRIMARY_KEYS)
LOAD_ORDER = (
    "customers", "service_centers", "technicians", "vehicles", "appointments", "work_orders", "parts",
    "part_usage", "financials", "feedback",
)
NULLABLE = {
    "technicians": {"certification"},
    "vehicles": {"mileage_km"},
    "appointments": {"scheduled_slot", "cancellation_reason"},
    "work_orders": {"technician_id", "start_time", "odometer_km"},
}
DATE_COLUMNS = {
    "appointments": ("booking_date", "scheduled_date"),
    "work_orders": ("check_in_time", "start_time", "end_time", "promised_ready_time"),
    "feedback": ("feedback_date",),
    "vehicles": ("purchase_date",),
    "customers": ("registration_date",),
}
FLAG_COLUMNS = {"work_orders": ("additional_work_found", "qc_passed_first_time")}
DEFAULTS = {"work_orders": {"parts_wait_hours": 0}}
UNIQUE = {
    "service_centers": ("center_name",),
    "work_orders": ("appointment_id",),
    "feedback": ("work_order_id",),
}
FOREIGN_KEYS = (
    ("technicians", "center_id", "service_centers", "center_id"),
    ("vehicles", "customer_id", "customers", "customer_id"),
    ("appointments", "vehicle_id", "vehicles", "vehicle_id"),
    ("appointments", "center_id", "service_centers", "center_id"),
    ("work_orders", "appointment_id", "appointments", "appointment_id"),
    ("work_orders", "technician_id", "technicians", "technician_id"),
    ("part_usage", "work_order_id", "work_orders", "work_order_id"),
    ("part_usage", "part_id", "parts", "part_id"),
    ("financials", "work_order_id", "work_orders", "work_order_id"),
    ("feedback", "work_order_id", "work_orders", "work_order_id"),
)
# ------------------------------------------------------------------------------------


def typed_schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[table])


def raw_schema(table: str) -> T.StructType:
    """Text for every date, time and flag (cleaning applies the types), numbers as double."""
    text = {*DATE_COLUMNS.get(table, ()), *FLAG_COLUMNS.get(table, ())}
    fields = []
    for f in typed_schema(table).fields:
        kind = T.StringType() if f.name in text else f.dataType
        fields.append(T.StructField(f.name, kind, True))
    return T.StructType(fields)


def with_defaults(df, table: str):
    """Column defaults applied on write."""
    for name, value in DEFAULTS.get(table, {}).items():
        df = df.withColumn(name, F.coalesce(name, F.lit(value).cast(df.schema[name].dataType)))
    return df


@dataclass(frozen=True)
class TableRules:
    """What one table must satisfy."""

    table: str
    not_null: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    checks: dict[str, Column] = field(default_factory=dict)  # name -> condition that must not be false
    foreign: tuple[tuple[str, str, str], ...] = ()  # (column, parent, parent key)


def _checks(cfg: Config) -> dict[str, dict[str, Column]]:
    c = F.col
    launch = F.lit(False)
    for model, year in cfg.model_first_year.items():
        launch = launch | ((c("model") == model) & (c("model_year") < year))
    return {
        "customers": {
            "type": c("customer_type").isin(*cfg.customer_types),
            "region": c("region").isin(*cfg.regions),
        },
        "service_centers": {
            "region": c("region").isin(*cfg.regions),
            "bays": c("service_bays") > 0,
            "capacity": c("daily_job_capacity") > 0,
        },
        "technicians": {
            "skill": c("skill_level").isin(*cfg.skills),
            "experience": c("years_experience") >= 0,
            "hourly_cost": c("hourly_cost") >= 0,
            "shift_hours": c("shift_hours_per_day").between(1, 24),
        },
        "vehicles": {
            "model": c("model").isin(*cfg.model_first_year),
            "battery": c("battery_kwh") > 0,
            "mileage": c("mileage_km") >= 0,
            "model_year": ~launch,
        },
        "appointments": {
            "status": c("status").isin(*cfg.statuses),
            "dates": c("booking_date") <= c("scheduled_date"),
            "reason_only_if_cancelled": c("cancellation_reason").isNull() | (c("status") == "Cancelled"),
        },
        "work_orders": {
            "estimated_hours": c("estimated_hours") > 0,
            "actual_hours": c("actual_hours") >= 0,
            "parts_wait": c("parts_wait_hours") >= 0,
            "odometer": c("odometer_km") >= 0,
            "end_after_start": c("end_time") >= c("start_time"),
            "end_after_check_in": c("end_time") >= c("check_in_time"),
            "promise_after_check_in": c("promised_ready_time") >= c("check_in_time"),
        },
        "parts": {"unit_cost": c("unit_cost") >= 0, "lead_days": c("supplier_lead_days") >= 0},
        "part_usage": {"quantity": c("quantity") > 0},
        "financials": {
            "billing": c("billing_type").isin(*cfg.billing_types),
            "estimated_cost": c("estimated_cost") >= 0,
            "labor_cost": c("labor_cost") >= 0,
            "parts_cost": c("parts_cost") >= 0,
            "revenue": c("revenue") >= 0,
        },
        "feedback": {"rating": c("rating").between(1, 5)},
    }


def table_rules(cfg: Config) -> list[TableRules]:
    checks = _checks(cfg)
    out = []
    for table in LOAD_ORDER:
        names = [f.name for f in typed_schema(table).fields]
        out.append(
            TableRules(
                table,
                not_null=tuple(n for n in names if n not in NULLABLE.get(table, set())),
                unique=UNIQUE.get(table, ()),
                checks=checks[table],
                foreign=tuple((col, p, pk) for t, col, p, pk in FOREIGN_KEYS if t == table),
            )
        )
    return out


def violates_domain(cfg: Config) -> dict[str, Column]:
    """Rows outside the enumerated domains, by table (null is not outside)."""
    c = F.col
    return {
        "appointments": ~c("status").isin(*cfg.statuses),
        "financials": ~c("billing_type").isin(*cfg.billing_types),
        "customers": any_of(~c("customer_type").isin(*cfg.customer_types), ~c("region").isin(*cfg.regions)),
        "technicians": ~c("skill_level").isin(*cfg.skills),
    }


def rework_with_revenue() -> Column:
    return (F.col("billing_type") == REWORK) & (F.col("revenue") != 0)
