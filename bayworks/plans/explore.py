"""Exploratory summaries: describe, mixes, outliers, profiles, table differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bayworks.functions.scalars import band, mean, ratio, share
from bayworks.operators.ranks import exact_percentiles
from bayworks.operators.shape import mean_matrix, value_shares
from bayworks.operators.validate import union_all


def long_form(df: DataFrame, columns: Sequence[str], kind: str = "decimal(24,6)") -> DataFrame:
    return df.select(*[F.col(c).cast(kind).alias(c) for c in columns]).unpivot([], list(columns), "column", "value")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, range, quartiles, P95 and sample-adjusted skewness per column.

    All columns are stacked and summarised together; the percentiles are exact and come from
    the ranked histogram, because money columns have unboundedly many values.
    """
    long = long_form(df, columns).where(F.col("value").isNotNull())
    v, n = F.col("value").cast("double"), F.count(F.lit(1)).cast("double")
    moments = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("count"),
        mean("value").alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.when(n > 2, F.skewness(v) * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
    )
    points = exact_percentiles(long, ["column"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95})
    return moments.join(points, "column")


def category_mix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of each value of several category columns, stacked."""
    long = df.select(*columns).unpivot([], list(columns), "column", "value").where("value is not null")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("column").agg(F.sum("n").alias("_all"))
    return counts.join(total, "column").select("column", "value", ratio("n", "_all").alias("share_of_jobs"))


def iqr_outliers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """High outliers (above Q3 + 1.5 IQR), P95, maximum, and outliers as a share of all rows."""
    long = long_form(df, columns)
    points = exact_percentiles(
        long.where("value is not null"), ["column"], "value", {"q1": 0.25, "q3": 0.75, "p95": 0.95}
    )
    limit = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    joined = long.join(F.broadcast(points), "column")  # one row per listed column
    return joined.groupBy("column").agg(
        F.count_if(F.col("value").cast("double") > limit).alias("high_outliers"),
        F.max("p95").alias("p95"),
        F.max(F.col("value").cast("double")).alias("max"),
        ratio(F.count_if(F.col("value").cast("double") > limit), F.count(F.lit(1))).alias("share_of_jobs"),
    )


FINE_EDGES = (0, 2, 8, 24, 72)
FINE_LABELS = ("On time", "<=2 h", "2-8 h", "8-24 h", "1-3 days", ">3 days")


def rating_by_late_band(fact: DataFrame, csat: int = 4) -> DataFrame:
    rated = fact.where(F.col("rating").isNotNull() & F.col("late_hours").isNotNull())
    return rated.groupBy(band("late_hours", FINE_EDGES, FINE_LABELS).alias("late_band")).agg(
        F.count(F.lit(1)).alias("responses"),
        mean("rating").alias("csat"),
        share(F.col("rating") >= csat).alias("csat_pct"),
    )


def delay_by_model_year(fact: DataFrame, years: Sequence[int]) -> DataFrame:
    return mean_matrix(fact, "model", "year", F.col("parts_delay_flag").cast("int"), years)


def overrun_by_centre(fact: DataFrame) -> DataFrame:
    wide = mean_matrix(
        fact, "center_name", "additional_work_found", F.col("cost_overrun_flag").cast("int"), [False, True]
    )
    return wide.select("center_name", F.col("false").alias("no_extra_work"), F.col("true").alias("extra_work_found"))


def part_category_profile(parts: DataFrame) -> DataFrame:
    cost = exact_percentiles(parts, ["part_category"], "unit_cost", {"median_unit_cost": 0.5})
    return (
        parts.groupBy("part_category")
        .agg(F.count(F.lit(1)).alias("skus"), mean("supplier_lead_days").alias("mean_lead_days"))
        .join(cost, "part_category")
    )


def column_profile(df: DataFrame) -> DataFrame:
    """Type, null count and distinct count per column.

    Columns are stacked as text and counted by value first, so a frequent value is folded
    before it moves and no row is repeated for the sake of a distinct count.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    long = df.select(*[F.col(c).cast("string").alias(c) for c in kinds]).unpivot([], list(kinds), "column", "value")
    values = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    one = values.groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count("value").alias("distinct")
    )
    names = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return one.select("column", names[F.col("column")].alias("dtype"), "nulls", "distinct")


def table_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows only on one side, duplicates counted; both zero means the tables are equal.

    One full-row aggregation of the tagged union instead of two set differences.
    """
    names = left.columns
    tagged = left.select(*names, F.lit(1).alias("_s")).unionByName(right.select(*names, F.lit(-1).alias("_s")))
    net = tagged.groupBy(*names).agg(F.sum("_s").alias("d"))
    zero = F.lit(0)
    return net.agg(
        F.coalesce(F.sum(F.greatest("d", zero)), zero).alias("only_left"),
        F.coalesce(F.sum(F.greatest(-F.col("d"), zero)), zero).alias("only_right"),
    ).withColumn("identical", (F.col("only_left") + F.col("only_right")) == 0)


def top_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return union_all(
        [value_shares(df, c).select(F.lit(c).alias("column"), F.col(c).alias("value"), "rows", "share") for c in columns]
    )
