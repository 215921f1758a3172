"""Binds the star-schema parquet tables to the service-network model.

Every rule is integer arithmetic on keys, so results do not depend on row order and the
same rules can be written in any SQL engine. Only column expressions, one aggregation of
``lineitem`` per order and one-row counts are used; filters and columns reach the scans.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bayworks.config import Config

Tables = dict[str, DataFrame]

BOUND_CONFIG = Config(
    period_start=date(1995, 1, 1),
    period_end=date(2001, 8, 31),
    focus_year=2000,
    periodic_type="5-LOW",
    fleet_type="MACHINERY",
    complex_types=("1-URGENT", "2-HIGH"),
    regions=("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"),
    customer_types=("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"),
    model_aliases={
        "model a": "Model A",
        "a": "Model A",
        "model b": "Model B",
        "b": "Model B",
        "model c": "Model C",
        "c": "Model C",
    },
    model_first_year={"Model A": 1990, "Model B": 1992, "Model C": 1992},
)


# Declared schemas: no footer scan to infer them, however many files a table has.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
        o_orderdate timestamp_ntz, o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,
        l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,
        l_shipdate timestamp_ntz""",
    "events": """event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double,
        props string""",
}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def money(cents: str) -> str:
    return f"cast(cast({cents} as decimal(16,0)) * 0.01BD as decimal(12,2))"


# minutes from check-in to the end without parts wait, and quarter hours of parts wait
WORK_MINUTES = "(k * 13) % 180 + 30 + (k * 17) % 420"
WAIT_QUARTERS = "if(k % 13 = 0, 4 + (k * 3) % 900, 0)"


def service_centers(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = read(spark, folder, "nation"), read(spark, folder, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).selectExpr(
        "n_nationkey as center_id",
        "n_name as center_name",
        "n_name as city",
        "concat('State ', n_nationkey % 7) as state",
        "r_name as region",
        "cast(4 + n_nationkey % 5 as smallint) as service_bays",
        "cast(20 + n_nationkey % 11 as smallint) as daily_job_capacity",
        "date_sub(date'1995-01-01', 100 * (n_nationkey % 6)) as opened_date",
    )


def customers(spark: SparkSession, folder: str) -> DataFrame:
    place = read(spark, folder, "nation").join(
        read(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        read(spark, folder, "customer")
        .join(place, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .selectExpr(
            "c_custkey as customer_id",
            "c_mktsegment as customer_type",
            "n_name as city",
            "r_name as region",
            "date_sub(date'1995-01-01', cast(c_custkey % 700 as int)) as registration_date",
        )
    )


def vehicles(spark: SparkSession, folder: str) -> DataFrame:
    return (
        read(spark, folder, "customer")
        .select("c_custkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("i"))
        .selectExpr("c_custkey * 2 + i as v", "c_custkey")
        .selectExpr(
            "v as vehicle_id",
            "c_custkey as customer_id",
            "concat('Model ', substr('ABC', cast(v % 3 as int) + 1, 1)) as model",
            "if(v % 4 < 2, 'Std', 'Plus') as variant",
            "if(v % 3 = 2, 'Family', 'Sport') as vehicle_category",
            "cast((29 + v % 4 * 4) * 0.1BD as decimal(4,1)) as battery_kwh",
            "cast(year(date_sub(date'1994-12-31', cast(v % 900 as int))) as smallint) as model_year",
            "date_sub(date'1994-12-31', cast(v % 900 as int)) as purchase_date",
            "if(v % 41 = 0, null, cast((v * 37) % 20000 as decimal(10,1))) as mileage_km",
        )
    )


def technicians(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "supplier").selectExpr(
        "s_suppkey as technician_id",
        "s_nationkey as center_id",
        """case when s_acctbal < 2000 then 'Junior' when s_acctbal < 4500 then 'Mid'
                when s_acctbal < 7500 then 'Senior' else 'Master' end as skill_level""",
        "cast(1 + s_suppkey % 20 as smallint) as years_experience",
        "if(s_suppkey % 3 = 0, null, concat('Level ', s_suppkey % 3)) as certification",
        "cast(200 + s_suppkey % 250 as decimal(10,2)) as hourly_cost",
        "cast(8 + s_suppkey % 2 as smallint) as shift_hours_per_day",
    )


def appointments(spark: SparkSession, folder: str) -> DataFrame:
    return (
        read(spark, folder, "orders")
        .selectExpr(
            "o_orderkey as k",
            "o_custkey as c",
            "cast(o_orderdate as date) as d",
            "o_orderstatus as s",
            "o_orderpriority as p",
        )
        .selectExpr(
            "k as appointment_id",
            "c * 2 + k % 2 as vehicle_id",
            "cast(c % 25 as int) as center_id",
            "date_sub(d, if(k % 4 = 3, 0, cast((k * 7) % 23 as int))) as booking_date",
            "d as scheduled_date",
            """if(k % 71 = 0, null, concat(lpad(cast(9 + k % 10 as string), 2, '0'),
                  if(k % 2 = 0, ':00', ':30'))) as scheduled_slot""",
            """case k % 4 when 0 then 'App' when 1 then 'Phone' when 2 then 'Web'
                   else 'Walk-in' end as booking_channel""",
            "p as requested_service_type",
            "case s when 'F' then 'Completed' when 'O' then 'Cancelled' else 'No-Show' end as status",
            """case when s = 'O' and k % 7 <> 0 then
                 case k % 5 when 0 then 'Price Concern' when 1 then 'Personal Reasons'
                   when 2 then 'Long Wait for Slot' when 3 then 'Found Alternative'
                   else 'Issue Resolved' end end as cancellation_reason""",
        )
    )


def work_orders(spark: SparkSession, folder: str) -> DataFrame:
    staff = read(spark, folder, "supplier").count()  # row counts of the file footers
    return (
        read(spark, folder, "orders")
        .where("o_orderstatus = 'F'")
        .selectExpr(
            "o_orderkey as k",
            "o_orderpriority as p",
            "unix_micros(cast(cast(o_orderdate as date) as timestamp)) div 60000000 as m0",
        )
        .selectExpr(
            "*",
            "m0 + 540 + (k * 11) % 480 as m_in",
            f"{WAIT_QUARTERS} as wait_q",
        )
        .selectExpr(
            "k as work_order_id",
            "k as appointment_id",
            f"if(k % 97 = 0, null, (k * 31) % {staff}) as technician_id",
            "p as service_type",
            "timestamp_seconds(m_in * 60) as check_in_time",
            "if(k % 53 = 0, null, timestamp_seconds((m_in + (k * 13) % 180) * 60)) as start_time",
            f"timestamp_seconds((m_in + {WORK_MINUTES} + wait_q * 15) * 60) as end_time",
            "timestamp_seconds((m_in + 120 + (k * 19) % 480) * 60) as promised_ready_time",
            "cast((2 + (k * 5) % 18) * 0.25BD as decimal(6,2)) as estimated_hours",
            "cast((1 + (k * 7) % 24) * 0.25BD as decimal(6,2)) as actual_hours",
            "cast(wait_q * 0.25BD as decimal(6,2)) as parts_wait_hours",
            "if(k % 61 = 0, null, cast((k * 29) % 90000 as int)) as odometer_km",
            "(k * 3) % 10 < 3 as additional_work_found",
            "(k * 7) % 11 <> 0 as qc_passed_first_time",
        )
    )


def parts(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "part").selectExpr(
        "p_partkey as part_id",
        "p_name as part_name",
        "p_type as part_category",
        f"{money('round(p_retailprice * 100)')} as unit_cost",
        "'All' as compatible_models",
        "cast(p_size as smallint) as supplier_lead_days",
    )


#: More than any part key; makes one number of an order and a part.
PART_KEYS = 100_000_000
#: The catalogue price of a part by its key, as the part table has it. Billing follows the
#: ledger at that price; every 41st job is billed 250 more, for the reconciliation to find.
CATALOGUE_CENTS = "(90000 + l_partkey % 1000 * 10)"


def part_usage(spark: SparkSession, folder: str) -> DataFrame:
    jobs = read(spark, folder, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    return (
        read(spark, folder, "lineitem")
        .join(jobs, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
        # A line number can repeat within an order; an order and a part make one line.
        .groupBy("l_orderkey", "l_partkey")
        .agg(F.expr("cast(sum(cast(l_quantity as int)) as int)").alias("quantity"))
        .selectExpr(
            f"l_orderkey * {PART_KEYS} + l_partkey as usage_id",
            "l_orderkey as work_order_id",
            "l_partkey as part_id",
            "quantity",
        )
    )


def financials(spark: SparkSession, folder: str) -> DataFrame:
    jobs = (
        read(spark, folder, "orders")
        .where("o_orderstatus = 'F'")
        .selectExpr(
            "o_orderkey as k",
            "(1 + (o_orderkey * 7) % 24) * 25 * (450 + o_orderkey % 300) as labor",
        )
    )
    billed = (
        read(spark, folder, "lineitem")
        .selectExpr(
            "l_orderkey",
            f"cast(l_quantity as bigint) * {CATALOGUE_CENTS} as used",
            "cast(round(l_extendedprice * 100) as bigint) as gross",
            "cast(round(l_discount * 100) as bigint) as off",
        )
        .groupBy("l_orderkey")
        .agg(
            F.expr("sum(used) + if(l_orderkey % 41 = 0, 25000, 0)").alias("parts"),
            F.expr("sum(gross * (100 - off) div 100)").alias("net"),
        )
    )
    return jobs.join(billed, F.col("k") == F.col("l_orderkey")).selectExpr(
        "k as work_order_id",
        """case when k % 20 = 10 then 'Rework (No Charge)' when k % 20 < 4 then 'Warranty'
                when k % 20 < 8 then 'Service Plan' else 'Customer Paid' end as billing_type""",
        f"{money('(labor + parts) * (70 + (k * 13) % 70) div 100')} as estimated_cost",
        f"{money('labor')} as labor_cost",
        f"{money('parts')} as parts_cost",
        f"{money('if(k % 20 = 10, 0, net)')} as revenue",
    )


def feedback(spark: SparkSession, folder: str) -> DataFrame:
    return (
        read(spark, folder, "orders")
        .where("o_orderstatus = 'F' and o_orderkey % 2 = 0")
        .selectExpr("o_orderkey as k", "o_orderkey div 2 as h", "cast(o_orderdate as date) as d")
        .selectExpr(
            "k",
            "h",
            "d",
            f"540 + (k * 11) % 480 + {WORK_MINUTES} + {WAIT_QUARTERS} * 15 as minutes_to_end",
        )
        .selectExpr(
            "k * 3 + 1 as feedback_id",
            "k as work_order_id",
            "cast(1 + (h * 7 + h div 3) % 5 as smallint) as rating",
            """case h % 6 when 0 then 'Service Quality' when 1 then 'Turnaround Time'
                 when 2 then 'Pricing' when 3 then 'Parts Availability'
                 when 4 then 'Staff Behaviour' else 'Communication' end as feedback_category""",
            "date_add(d, cast(minutes_to_end div 1440 + h % 10 as int)) as feedback_date",
        )
    )


BUILDERS = {
    "customers": customers,
    "vehicles": vehicles,
    "service_centers": service_centers,
    "technicians": technicians,
    "appointments": appointments,
    "work_orders": work_orders,
    "parts": parts,
    "part_usage": part_usage,
    "financials": financials,
    "feedback": feedback,
}


class LazyTables(dict):
    """Builds a table's plan on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__()
        self._source = (spark, folder)

    def __missing__(self, name: str) -> DataFrame:
        self[name] = BUILDERS[name](*self._source)
        return self[name]

    def all(self) -> Tables:
        return {name: self[name] for name in BUILDERS}


def model_tables(spark: SparkSession, folder: str) -> LazyTables:
    """The ten normalised tables as lazy plans over the parquet files in ``folder``."""
    return LazyTables(spark, folder)
