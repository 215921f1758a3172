"""Reshaping operators: label reindex, extremes, matrices, shares, crosstabs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bayworks.functions.scalars import mean, ratio


def label_frame(like: DataFrame, name: str, labels: Sequence[str]) -> DataFrame:
    """A fixed list of labels with its order, as a tiny relation."""
    pairs = F.array(*[F.struct(F.lit(v).alias(name), F.lit(i).alias("_order")) for i, v in enumerate(labels, 1)])
    return like.sparkSession.range(1).select(F.inline(pairs))


def reindex_labels(
    df: DataFrame, column: str, labels: Sequence[str], fill: dict[str, object] | None = None
) -> DataFrame:
    """One row per label in the given order; labels without data get ``fill`` or null."""
    out = label_frame(df, column, labels).join(df, column, "left").orderBy("_order").drop("_order")
    return out.fillna(fill) if fill else out


def present_in_order(df: DataFrame, column: str, labels: Sequence[str]) -> DataFrame:
    """Rows whose label is listed, in list order."""
    return df.join(F.broadcast(label_frame(df, column, labels)), column).orderBy("_order").drop("_order")


def preview(df: DataFrame, order: Sequence[str], rows: int = 5) -> DataFrame:
    """The first ``rows`` of a result in a given order."""
    return df.orderBy(*order).limit(rows)


def extremes(df: DataFrame, label: str, value: str) -> DataFrame:
    """Labels with the lowest and highest value; empty when fewer than two rows have one.

    Ties go to the smaller label.
    """
    v, lab = F.col(value), F.col(label)
    one = df.where(v.isNotNull()).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by(lab, F.struct(v, lab)).alias("lowest"),
        F.min(v).alias("lowest_value"),
        F.min_by(lab, F.struct(-v, lab)).alias("highest"),
        F.max(v).alias("highest_value"),
    )
    return one.where("_n >= 2").drop("_n")


def value_shares(df: DataFrame, column: str, count: str = "rows") -> DataFrame:
    """Frequency of each non-null value and its share."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(count))
    return counts.withColumn("share", ratio(count, F.sum(count).over(Window.partitionBy())))


def mean_matrix(df: DataFrame, index: str, columns: str, value: Column | str, labels: Sequence | None = None) -> DataFrame:
    """Mean of a value per (index, column label), labels as columns. Null keys are dropped.

    Cells are aggregated first; only they are pivoted.
    """
    cells = (
        df.where(F.col(index).isNotNull() & F.col(columns).isNotNull())
        .groupBy(index, columns)
        .agg(mean(value).alias("_v"))
    )
    return cells.groupBy(index).pivot(columns, list(labels) if labels else None).agg(F.max("_v"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Joint counts in long form, null keys dropped."""
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return known.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def row_shares(cells: DataFrame, row: str, count: str = "n", name: str = "share") -> DataFrame:
    """Share of each cell within its row."""
    return cells.withColumn(name, ratio(count, F.sum(count).over(Window.partitionBy(row))))
