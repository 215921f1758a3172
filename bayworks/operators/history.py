"""Previous/next row and running row number per entity, safe for hot entities.

One entity may own a third of all rows, all of them at one time or without a time. Histories
are therefore a scan in two phases: rows are range-partitioned once by entity, time and
tie-breaker and stored, so an entity may span partitions; windows run inside a partition,
whose size the ranges bound. What crosses a border travels in one row per partition.
Rows whose entity is unknown take no part.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from bayworks.session import settle_table


def _inside() -> WindowSpec:
    return Window.partitionBy("_part").orderBy("_at")


def _borders() -> WindowSpec:
    """Over the summary rows, of which there is one for each partition."""
    return Window.partitionBy(F.lit(0)).orderBy("_part")


def _known(keys: Sequence[str]) -> Column:
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return known


def _sorted(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df``, stored in the order of its histories: ``_part`` and ``_at``, a position that grows with it."""
    by = [*keys, *order]
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    return settle_table(rows).withColumn("_part", F.shiftright("_at", 33))  # the upper bits number the partition


def _same(other: str, keys: list[str]) -> Column:
    """Whether the row in column ``other`` is one of the same, known entity."""
    same = F.col(other).isNotNull()
    for k in keys:
        same = same & (F.col(f"{other}.{k}") == F.col(k))
    return F.coalesce(same, F.lit(False))


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: str,
    previous: Mapping[str, str],
    following: Mapping[str, str],
) -> DataFrame:
    """Add columns from the previous / next row of the same entity.

    ``previous`` and ``following`` map new column names to source columns; rows are
    ordered by ``ts``, nulls first, and then ``tie``. Rows with a null key get nulls.
    """
    keys = list(keys)
    rows = _sorted(df, keys, [ts, tie])
    out = F.struct(*keys, *[F.col(src).alias(f"_{name}") for name, src in previous.items()])
    into = F.struct(*keys, *[F.col(src).alias(f"_{name}") for name, src in following.items()])
    ends = rows.groupBy("_part").agg(F.max_by(out, "_at").alias("_last"), F.min_by(into, "_at").alias("_first"))
    ends = ends.select("_part", F.lag("_last").over(_borders()).alias("_far_prev"), F.lead("_first").over(_borders()).alias("_far_next"))
    near = rows.select("*", F.lag(out).over(_inside()).alias("_prev"), F.lead(into).over(_inside()).alias("_next"))
    found = near.join(ends, "_part").withColumns({"_prev": F.coalesce("_prev", "_far_prev"), "_next": F.coalesce("_next", "_far_next")})
    before, after = _same("_prev", keys), _same("_next", keys)
    return found.select(
        *df.columns,
        *[F.when(before, F.col(f"_prev._{name}")).alias(name) for name in previous],
        *[F.when(after, F.col(f"_next._{name}")).alias(name) for name in following],
    )


def running_number(df: DataFrame, keys: Sequence[str], ts: str, tie: str, name: str) -> DataFrame:
    """Add the 1-based position of each row in its entity's history; null for a null key.

    An entity starts where the row before is of another one. A partition without a start
    goes on with the entity before it, so its rows are added to what it passes on.
    """
    keys = list(keys)
    rows = _sorted(df, keys, [ts, tie])
    entity = F.struct(*keys)
    starts = rows.select("*", F.lag(entity).over(_inside()).alias("_prev"))
    starts = starts.withColumn("_start", F.when(F.col("_prev").isNotNull() & ~entity.eqNullSafe(F.col("_prev")), F.col("_at")))
    ends = starts.groupBy("_part").agg(
        F.min("_at").alias("_from"), F.max("_at").alias("_to"), F.max("_start").alias("_inner"),
        F.min_by(entity, "_at").alias("_first"), F.max_by(entity, "_at").alias("_last"),
    )
    fresh = ~F.col("_first").eqNullSafe(F.lag("_last").over(_borders()))
    ends = ends.withColumn("_fresh", fresh)
    begins = F.col("_fresh") | F.col("_inner").isNotNull()
    tail = F.col("_to") + 1 - F.coalesce("_inner", "_from")
    ends = ends.withColumns({"_tail": tail, "_chain": F.sum(begins.cast("long")).over(_borders())})
    chain = Window.partitionBy("_chain").orderBy("_part")
    ends = ends.withColumn("_passed", F.sum("_tail").over(chain))
    ends = ends.select("_part", "_from", F.when(F.col("_fresh"), 0).otherwise(F.lag("_passed").over(_borders())).alias("_before"))
    latest = starts.withColumn("_latest", F.max("_start").over(_inside()))
    found = latest.join(ends, "_part")
    number = F.col("_at") + 1 - F.coalesce("_latest", F.col("_from") - F.col("_before"))
    return found.select(*df.columns, F.when(_known(keys), number).cast("int").alias(name))
