"""Facts behind the one-sentence insights of each page, and the sentences themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bayworks.operators.shape import extremes


def pct1(c: Column) -> Column:
    return F.concat(F.format_number(c * 100, 1), F.lit("%"))


def fixed1(c: Column) -> Column:
    return F.format_number(c, 1)


def _beside(*facts: DataFrame) -> DataFrame:
    """Independent one-row facts in one row; a fact that cannot be told leaves nulls."""
    one = facts[0].sparkSession.range(1).select(F.lit(1).alias("_one"))
    for df in facts:
        one = one.join(F.broadcast(df.withColumn("_one", F.lit(1))), "_one", "left")
    return one.drop("_one")


def executive(scorecard: DataFrame) -> DataFrame:
    """Worst and best centre on time, the gap in points, and the top-ranked centre."""
    ends = extremes(scorecard, "center_name", "on_time_pct")
    top = scorecard.agg(F.min_by("center_name", F.struct("rank", "center_name")).alias("top_centre"))
    return _beside(ends, top).select(
        F.col("lowest").alias("worst_centre"),
        F.col("lowest_value").alias("worst_on_time"),
        F.col("highest").alias("best_centre"),
        F.col("highest_value").alias("best_on_time"),
        ((F.col("highest_value") - F.col("lowest_value")) * 100).alias("gap_points"),
        "top_centre",
    )


def operations(scorecard: DataFrame, weekday_wait: DataFrame) -> DataFrame:
    """Slowest centre and the weekday with the longest wait."""
    slow = extremes(scorecard, "center_name", "avg_turnaround").select(
        F.col("highest").alias("slowest_centre"), F.col("highest_value").alias("slowest_turnaround")
    )
    wait = extremes(weekday_wait, "weekday", "avg_wait").select(
        F.col("highest").alias("longest_wait_day"), F.col("highest_value").alias("longest_wait")
    )
    median = scorecard.select(F.col("center_name").alias("slowest_centre"), "median_turnaround")
    return _beside(slow.join(median, "slowest_centre"), wait)


def financial(by_service: DataFrame, trend: DataFrame) -> DataFrame:
    """Best and worst margin by service type and the month with the highest profit."""
    ends = extremes(by_service, "service_type", "margin_pct").select(
        F.col("highest").alias("best_type"), F.col("highest_value").alias("best_margin"),
        F.col("lowest").alias("worst_type"), F.col("lowest_value").alias("worst_margin"),
    )
    peak = trend.agg(
        F.min_by("month", F.struct(-F.col("profit"), F.col("month"))).alias("peak_month"),
        F.max("profit").alias("peak_profit"),
    )
    return _beside(ends, peak)


def customer(by_centre: DataFrame, by_lead: DataFrame) -> DataFrame:
    """Lowest-rated centre and the lead band that loses most appointments."""
    low = extremes(by_centre, "center_name", "avg_rating").select(
        F.col("lowest").alias("lowest_rated_centre"), F.col("lowest_value").alias("lowest_rating")
    )
    lead = extremes(by_lead, "lead_time_band", "cancellation_rate").select(
        F.col("highest").alias("worst_lead_band"), F.col("highest_value").alias("worst_cancellation_rate")
    )
    return _beside(low, lead)


def sentence(template: str, *parts: Column) -> Column:
    return F.format_string(template, *parts)
