"""Ranks, running totals, tiles and exact percentiles without a global window.

Values are first reduced to a histogram (value, count, sums), which is cut into ranges of
groups and values; positions of rows cut them into buckets at approximate quantiles. Windows
run inside one range or bucket; the totals before it are added as an offset. Split points
only balance the work: any choice of points gives the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bayworks.session import settle, settle_table

LEAST_BUCKETS, MOST_BUCKETS = 64, 2048


def bucket_count(df: DataFrame) -> int:
    """Twice as many buckets as the session has shuffle partitions, so that they grow with the cluster.

    The upper bound keeps the comparison tree small; it bounds tasks, not rows or results.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(2 * partitions, LEAST_BUCKETS), MOST_BUCKETS)


def split_points(df: DataFrame, value: str, buckets: int | None = None) -> list:
    """Approximate quantiles of ``value``: one number for each bucket reaches the driver."""
    buckets = buckets or bucket_count(df)
    probs = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(value, probs, 10_000).alias("p")).first()
    return [p for p in (row["p"] or []) if p is not None]


def bucket_of(value: Column, points: Sequence, base: int = 0) -> Column:
    """Number of split points below ``value``, as a balanced comparison tree."""
    if not points:
        return F.lit(base)
    mid = len(points) // 2
    return F.when(
        value <= F.lit(points[mid]), bucket_of(value, points[:mid], base)
    ).otherwise(bucket_of(value, points[mid + 1 :], base + mid + 1))


def value_histogram(df: DataFrame, by: Sequence[str], value: str, sums: Sequence[str] = ()) -> DataFrame:
    """One row per (group, distinct value) with its count and the sums of other columns.

    A ``_weight`` column, when present, says how many observations a row stands for.
    """
    n = F.sum("_weight") if "_weight" in df.columns else F.count(F.lit(1))
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(n.alias("n"), *[F.sum(s).alias(s) for s in sums])
    )


def ranked_values(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    descending: bool = False,
    sums: Sequence[str] = (),
) -> DataFrame:
    """Histogram with everything that precedes each value inside its group.

    All groups are ranked in one pass, so several columns are ranked together by stacking them
    as groups. The histogram is range-partitioned once by group and value and stored: a group
    of many values spans partitions, small ones share them. Windows run inside a partition;
    one row for each group and partition carries what lies before it.

    Adds ``before`` (rows strictly before), ``distinct_before`` and ``<sum>_before``.
    rank = before + 1, dense rank = distinct_before + 1, mid-rank = before + (n + 1) / 2.
    """
    by = list(by)
    measures = {"before": "n", "distinct_before": "_one", **{f"{s}_before": s for s in sums}}
    keys = [*[F.col(k).asc() for k in by], F.col(value).desc() if descending else F.col(value).asc()]
    cells = value_histogram(df, by, value, sums).repartitionByRange(*keys).sortWithinPartitions(*keys)
    hist = settle_table(cells.withColumn("_at", F.monotonically_increasing_id()))
    # the upper bits of the position number the partition
    hist = hist.withColumn("_part", F.shiftright("_at", 33)).withColumn("_one", F.lit(1))
    inside = Window.partitionBy("_part", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    totals = hist.groupBy("_part", *by).agg(*[F.sum(m).alias(f"_t_{o}") for o, m in measures.items()])
    across = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in [*by, "_part"]],
        *[F.coalesce(F.sum(f"_t_{o}").over(across), F.lit(0)).alias(f"_o_{o}") for o in measures],
    )
    same = F.col("_part") == F.col("_k__part")
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    running = hist.select(
        "*",
        *[F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(f"_w_{o}") for o, m in measures.items()],
    )
    return running.join(offsets, same).select(
        *by,
        value,
        "n",
        *sums,
        *[(F.col(f"_w_{o}") + F.col(f"_o_{o}")).alias(o) for o in measures],
    )


def with_rank(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    rank: str | None = None,
    dense: str | None = None,
    descending: bool = False,
) -> DataFrame:
    """Attach rank and/or dense rank of ``value`` inside each group to every row."""
    by = list(by)
    table = ranked_values(df, by, value, descending).select(
        *[F.col(k).alias(f"_k_{k}") for k in by],
        F.col(value).alias("_v"),
        *([(F.col("before") + 1).alias(rank)] if rank else []),
        *([(F.col("distinct_before") + 1).alias(dense)] if dense else []),
    )
    same = F.col(value) == F.col("_v")
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(table, same, "left").drop("_v", *[f"_k_{k}" for k in by])


def row_positions(
    df: DataFrame, value: str, tie: str, name: str, descending: bool = False
) -> DataFrame:
    """Global 1-based position by (value, tie), one shuffle of the rows.

    A value that fills several quantiles is isolated in buckets of its own, and those
    are split again by ``tie``, so a hot value never lands in one task.
    """
    rows = settle(df)
    points = split_points(rows, value)
    distinct = sorted(set(points))
    hot = {p for p in distinct if points.count(p) > 1}
    b1 = bucket_of(F.col(value), distinct) * 2
    if hot:
        is_hot = F.col(value).isin(*hot)
        ties = sorted(set(split_points(rows.where(is_hot), tie)))
        # rows equal to a hot split point come after the smaller values of that bucket
        b1 = b1 + F.when(is_hot, 1).otherwise(0)
        b2 = F.when(is_hot, bucket_of(F.col(tie), ties)).otherwise(0)
    else:
        b2 = F.lit(0)
    rows = rows.withColumn("_b1", b1).withColumn("_b2", b2)

    def order(c: str) -> Column:
        return F.col(c).desc() if descending else F.col(c).asc()

    inside = Window.partitionBy("_b1", "_b2").orderBy(order(value), F.col(tie).asc())
    across = Window.orderBy(order("_b1"), F.col("_b2").asc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        rows.groupBy("_b1", "_b2")
        .agg(F.count(F.lit(1)).alias("_t"))
        .select("_b1", "_b2", F.coalesce(F.sum("_t").over(across), F.lit(0)).alias("_o"))
    )  # at most 2 * BUCKETS * BUCKETS rows, whatever the input size
    return (
        rows.withColumn("_p", F.row_number().over(inside))
        .join(F.broadcast(offsets), ["_b1", "_b2"])
        .withColumn(name, F.col("_p") + F.col("_o"))
        .drop("_b1", "_b2", "_p", "_o")
    )


def ntile(position: Column, total: Column, tiles: int) -> Column:
    """Tile number of a 1-based position under the SQL NTILE remainder rule."""
    size = F.floor(total / tiles)
    extra = total - size * tiles
    big = extra * (size + 1)
    in_big = F.floor((position - 1) / (size + 1)) + 1
    in_small = extra + F.floor(F.try_divide(position - 1 - big, size)) + 1
    return F.when(position <= big, in_big).otherwise(in_small).cast("int")


def exact_percentiles(
    df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Interpolated percentiles per group from the ranked histogram, exact at any size."""
    by = list(by)
    ranked = ranked_values(df, by, value)
    totals = ranked.groupBy(*by).agg(F.sum("n").alias("_N"))
    if by:
        ranked = ranked.join(totals, by)
    else:
        ranked = ranked.crossJoin(F.broadcast(totals))
    aggregates = []
    for name, p in probs.items():
        at = F.lit(p) * (F.col("_N") - 1)
        for tag, idx in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            inside = (F.col("before") <= idx) & (idx < F.col("before") + F.col("n"))
            aggregates.append(F.max(F.when(inside, F.col(value).cast("double"))).alias(f"_{name}_{tag}"))
        aggregates.append(F.max(at - F.floor(at)).alias(f"_{name}_f"))
    picked = ranked.groupBy(*by).agg(*aggregates) if by else ranked.agg(*aggregates)
    return picked.select(
        *by,
        *[
            (
                F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_f")
            ).alias(n)
            for n in probs
        ],
    )
