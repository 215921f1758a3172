"""Differences of two stored versions of a table, found by a tree of checksums.

    path/rows/bucket=<n>/   the rows, by a hash of their key
    path/tree/              for each node: rows and order-free sums of their hashes
    path/shape/             no rows: the columns, which a table without rows has too

A node sums up sixteen nodes of the level below; the lowest level are the buckets. A diff
walks down from the root through nodes that differ and reads only the buckets it ends in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAN_BITS = 4
LEVELS = 2


def _sum_of(value: Column, salt: str) -> Column:
    """Sum of hashes: the same in any order, and equal rows do not cancel out."""
    return F.sum(F.xxhash64(F.lit(salt), value).cast("decimal(20,0)")).cast("decimal(38,0)")


def bucket_of(keys: Sequence[str], levels: int = LEVELS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << FAN_BITS * levels)).cast("int")


def tree(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(level, node, n, s1, s2) of rows with a ``bucket``; level 0 is the root."""
    whole = F.struct(*[c for c in rows.columns if c != "bucket"])
    low = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), _sum_of(whole, "one").alias("s1"), _sum_of(whole, "two").alias("s2"))
    up = F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", F.col("bucket"), FAN_BITS * (levels - k)).alias("node")))
    each = low.select(F.inline(up), "n", "s1", "s2")
    return each.groupBy("level", "node").agg(F.sum("n").alias("n"), *[F.sum(s).cast("decimal(38,0)").alias(s) for s in ("s1", "s2")])


def store(df: DataFrame, keys: Sequence[str], path: str, levels: int = LEVELS) -> None:
    """Write a version of ``df``: its rows by bucket, and its tree. A bucket with a hot key may fill several files."""
    rows = df.withColumn("bucket", bucket_of(keys, levels))
    rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/rows")
    spark = df.sparkSession
    spark.createDataFrame([], rows.schema).write.parquet(f"{path}/shape")
    stored = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    tree(stored, levels).coalesce(1).write.parquet(f"{path}/tree")


def differing_buckets(spark: SparkSession, left: str, right: str, levels: int = LEVELS) -> list[int]:
    """Buckets whose contents differ; there are at most 16 to the power of ``levels``."""
    a, b = (spark.read.parquet(f"{p}/tree") for p in (left, right))
    both = a.select("level", "node", F.struct("n", "s1", "s2").alias("a")).join(
        b.select("level", "node", F.struct("n", "s1", "s2").alias("b")), ["level", "node"], "full"
    )
    odd = both.where(~F.col("a").eqNullSafe(F.col("b"))).select("level", "node")
    found = [0]
    for level in range(levels + 1):
        below = F.shiftright("node", FAN_BITS) if level else F.col("node")
        found = sorted(r["node"] for r in odd.where((F.col("level") == level) & below.isin(found)).collect())
        if not found:
            break
    return found


def changes(spark: SparkSession, left: str, right: str, keys: Sequence[str], levels: int = LEVELS) -> DataFrame:
    """(keys, status, columns) of keys that are added, lost or changed between two stored versions.

    ``columns`` names, for changed keys, the columns whose values differ. Several rows of one
    key are compared as a multiset, by sums of hashes, so no key is gathered; a null key is a
    key like any other. Only the buckets that differ are read.
    """
    buckets = differing_buckets(spark, left, right, levels)
    sides, values = [], None
    for path in (left, right):
        shape = spark.read.parquet(f"{path}/shape").schema
        rows = spark.read.schema(shape).parquet(f"{path}/rows").where(F.col("bucket").isin(buckets))
        values = [c for c in rows.columns if c not in (*keys, "bucket")]
        sums = [F.struct(_sum_of(F.struct(c), "one").alias("one"), _sum_of(F.struct(c), "two").alias("two")).alias(f"s{i}") for i, c in enumerate(values)]
        sides.append(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums))
    old, new = sides[0].alias("old"), sides[1].alias("new")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}"))
    met = old.join(new, same, "full")
    differ = [F.when(~F.col(f"old.s{i}").eqNullSafe(F.col(f"new.s{i}")), F.lit(c)) for i, c in enumerate(values)]
    status = F.when(F.col("old.n").isNull(), "added").when(F.col("new.n").isNull(), "lost").otherwise("changed")
    names = F.array_join(F.array_compact(F.array(*differ)), " ") if differ else F.lit("")
    out = met.where((F.coalesce("old.n", F.lit(0)) != F.coalesce("new.n", F.lit(0))) | (names != ""))
    key = [F.when(F.col("old.n").isNull(), F.col(f"new.{k}")).otherwise(F.col(f"old.{k}")).alias(k) for k in keys]
    return out.select(*key, status.alias("status"), F.when(status == "changed", names).otherwise("").alias("columns"))
