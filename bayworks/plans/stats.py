"""Rank and contingency tests with effect sizes, computed on value histograms.

Observations are reduced to (group, value, count); mid-ranks come from the bucketed rank
operator.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bayworks.functions import tails
from bayworks.functions.scalars import flag, ratio, share
from bayworks.operators.ranks import exact_percentiles, ranked_values
from bayworks.operators.shape import crosstab
from bayworks.operators.validate import union_all
from bayworks.session import settle_table


def mid_rank() -> Column:
    return F.col("before") + (F.col("n") + 1) / 2.0


def _tie_sum(n: str = "n") -> Column:
    c = F.col(n).cast("double")
    return F.sum(c * c * c - c)


def _kruskal(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """H, degrees of freedom, p, epsilon squared and n for each of ``keys``; all keys are ranked in one pass."""
    keys = list(keys)
    df = df.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    cells = settle_table(df.groupBy(*keys, group, value).agg(F.count(F.lit(1)).alias("_c")))
    ranked = ranked_values(cells.select(*keys, value, F.col("_c").alias("_weight")), keys, value)
    ranked = ranked.select(*keys, value, mid_rank().alias("_r"), "n")
    sums = cells.join(ranked, [*keys, value]).groupBy(*keys, group).agg(
        F.sum("_c").alias("_n"), F.sum(F.col("_c") * F.col("_r")).alias("_R")
    )
    total = sums.groupBy(*keys).agg(
        F.sum("_n").cast("double").alias("N"),
        F.count(F.lit(1)).alias("k"),
        F.sum(F.col("_R") * F.col("_R") / F.col("_n")).alias("S"),
    )
    ties = ranked.groupBy(*keys).agg(_tie_sum().alias("T"))
    n = F.col("N")
    raw = F.lit(12.0) / (n * (n + 1)) * F.col("S") - 3 * (n + 1)
    h = F.try_divide(raw, 1 - F.try_divide(F.col("T"), n * n * n - n))
    return (total.join(ties, keys) if keys else total.crossJoin(F.broadcast(ties))).select(
        *keys,
        h.alias("h"),
        (F.col("k") - 1).alias("dof"),
        tails.chi2_tail(h, F.col("k") - 1).alias("p"),
        F.try_divide(h, n - 1).alias("epsilon_sq"),
        n.cast("bigint").alias("n"),
    )


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """Kruskal-Wallis H with tie correction, p-value and epsilon squared."""
    return _kruskal(df, [], group, value)


def kruskal_many(df: DataFrame, group: str, tests: Mapping[str, str]) -> DataFrame:
    """``kruskal`` of several columns at once: one row for each ``tests`` (name -> column) with values."""
    stack = [F.struct(F.lit(name).alias("test"), F.col(c).cast("double").alias("_v")) for name, c in tests.items()]
    return _kruskal(df.select(group, F.inline(F.array(*stack))), ["test"], group, "_v")


def mann_whitney(df: DataFrame, chosen: Column, value: str) -> DataFrame:
    """U of the chosen group against the rest, rank-biserial effect, normal approximation z and its p-value."""
    df = df.where(F.col(value).isNotNull()).select(flag(chosen).alias("_g"), F.col(value).alias("_x"))
    ranked = ranked_values(df, [], "_x").select(F.col("_x").alias("_v"), mid_rank().alias("_r"), "n")
    cells = df.groupBy("_x").agg(F.count_if("_g").alias("_a"), F.count(F.lit(1)).alias("_c"))
    one = cells.join(ranked, F.col("_x") == F.col("_v")).agg(
        F.sum("_a").cast("double").alias("n1"),
        F.sum(F.col("_c") - F.col("_a")).cast("double").alias("n2"),
        F.sum(F.col("_a") * F.col("_r")).alias("R1"),
        _tie_sum("_c").alias("T"),
    )
    halves = exact_percentiles(df, ["_g"], "_x", {"_m": 0.5})
    medians = halves.agg(
        F.max(F.when(F.col("_g"), F.col("_m"))).alias("median_focus"),
        F.max(F.when(~F.col("_g"), F.col("_m"))).alias("median_rest"),
    )
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    u = F.col("R1") - n1 * (n1 + 1) / 2
    largest = F.greatest(u, n1 * n2 - u)
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("T"), n * (n - 1))))
    z = F.try_divide(largest - n1 * n2 / 2 - 0.5, spread)
    return one.crossJoin(F.broadcast(medians)).select(
        u.alias("u"),
        z.alias("z"),
        tails.normal_upper_doubled(z).alias("p"),
        (F.try_divide(2 * u, n1 * n2) - 1).alias("rank_biserial"),
        "median_focus", "median_rest",
        n.cast("bigint").alias("n"),
    )


def chi2(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square of independence with Cramer's V; 2 x 2 tables get the Yates correction.

    chi2 = N * (sum o^2 / (row * column) - 1) needs only the cells that occur.
    """
    cells = crosstab(df, a, b)
    rows = cells.groupBy(a).agg(F.sum("n").alias("_r"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("_c"))
    o = F.col("n").cast("double")
    one = cells.join(rows, a).join(cols, b).agg(
        F.sum(o * o / (F.col("_r") * F.col("_c"))).alias("Q"), F.sum("n").cast("double").alias("N")
    )
    r = rows.agg(F.count(F.lit(1)).alias("R"), F.sum(1.0 / F.col("_r")).alias("ir"))
    c = cols.agg(F.count(F.lit(1)).alias("C"), F.sum(1.0 / F.col("_c")).alias("ic"))
    n = F.col("N")
    plain = n * F.greatest(F.col("Q") - 1, F.lit(0.0))
    inverse = n * F.col("ir") * F.col("ic")  # sum of 1 / expected in a 2 x 2 table
    gap = F.sqrt(plain / inverse)
    yates = F.pow(gap - F.least(F.lit(0.5), gap), F.lit(2.0)) * inverse
    dof = (F.col("R") - 1) * (F.col("C") - 1)
    stat = F.when(dof == 1, yates).otherwise(plain)
    width = F.least("R", "C") - 1
    return one.crossJoin(F.broadcast(r)).crossJoin(F.broadcast(c)).select(
        stat.alias("chi2"), dof.alias("dof"), tails.chi2_tail(stat, dof).alias("p"), F.sqrt(F.try_divide(stat, n * width)).alias("cramers_v"),
        n.cast("bigint").alias("n"),
    )


def proportion_gap(df: DataFrame, group: str, focus, benchmark, hit: str) -> DataFrame:
    """Difference of two rates with a 95 % interval and Cohen's h."""
    g = F.col(group)
    one = df.agg(
        share(F.when(g == focus, F.col(hit))).alias("focus_rate"),
        share(F.when(g == benchmark, F.col(hit))).alias("benchmark_rate"),
        F.count_if(g == focus).alias("_n1"),
        F.count_if(g == benchmark).alias("_n2"),
    )
    p1, p2 = F.col("focus_rate"), F.col("benchmark_rate")
    se = F.sqrt(ratio(p1 * (1 - p1), "_n1") + ratio(p2 * (1 - p2), "_n2"))
    return one.select(
        "focus_rate", "benchmark_rate",
        (p1 - p2).alias("gap"),
        (p1 - p2 - 1.96 * se).alias("ci95_low"),
        (p1 - p2 + 1.96 * se).alias("ci95_high"),
        (2 * F.asin(F.sqrt(p1)) - 2 * F.asin(F.sqrt(p2))).alias("cohens_h"),
    )


def _rank_correlation(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rho, n and p for each of ``keys`` from cells (keys, _x, _y, m): m rows have the values _x and _y.

    Both sides of all keys are stacked and ranked in one pass.
    """
    keys = list(keys)
    cells = settle_table(cells)  # ranked, then joined with the ranks
    sides = [F.struct(F.lit(c).alias("side"), F.col(c).alias("v")) for c in ("_x", "_y")]
    stacked = cells.select(*keys, F.col("m").alias("_weight"), F.inline(F.array(*sides)))
    ranked = ranked_values(stacked, [*keys, "side"], "v").select(*keys, "side", "v", "n", mid_rank().alias("r"))
    joined = cells
    for c in ("_x", "_y"):
        one = ranked.where(F.col("side") == c).select(*keys, F.col("v").alias(c), F.col("r").alias(f"{c}r"))
        joined = joined.join(one, [*keys, c])
    cross = joined.groupBy(*keys).agg(F.sum(F.col("m") * F.col("_xr") * F.col("_yr")).alias("P"))
    square = F.col("n") * F.col("r") * F.col("r")
    spread = ranked.groupBy(*keys).agg(
        F.sum(F.when(F.col("side") == "_x", F.col("n"))).cast("double").alias("N"),
        *[F.sum(F.when(F.col("side") == c, square)).alias(f"S{c}") for c in ("_x", "_y")],
    )
    both = cross.join(spread, keys) if keys else cross.crossJoin(F.broadcast(spread))
    n = F.col("N")
    centre = n * (n + 1) * (n + 1) / 4
    rho = F.try_divide(F.col("P") - centre, F.sqrt((F.col("S_x") - centre) * (F.col("S_y") - centre)))
    return both.select(*keys, rho.alias("rho"), n.cast("bigint").alias("n")).withColumn(
        "p", tails.correlation_two_sided(F.col("rho"), F.col("n"))
    )


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation over the rows where both values are present."""
    pairs = df.select(F.col(x).alias("_x"), F.col(y).alias("_y")).where("_x is not null and _y is not null")
    return _rank_correlation(pairs.groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("m")), [])


def spearman_many(tests: Mapping[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """``spearman`` of columns of several tables at once: one row for each test (name -> table, x, y) with pairs.

    Every table is folded to its distinct pairs before they are stacked and ranked together.
    """
    cells = [
        df.select(F.lit(name).alias("test"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
        .where("_x is not null and _y is not null")
        .groupBy("test", "_x", "_y")
        .agg(F.count(F.lit(1)).alias("m"))
        for name, (df, x, y) in tests.items()
    ]
    return _rank_correlation(union_all(cells), ["test"])


def spearman_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise rank correlations, each over the rows complete for its pair.

    All pairs are stacked and pre-aggregated to their distinct values, so one pass ranks all.
    """
    two = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("_x"), F.col(b).alias("_y"))
        for i, a in enumerate(columns) for b in columns[i + 1 :]
    ]
    cells = df.select(F.inline(F.array(*two))).where("_x is not null and _y is not null")
    return _rank_correlation(cells.groupBy("a", "b", "_x", "_y").agg(F.count(F.lit(1)).alias("m")), ["a", "b"])


def summary_lines(df: DataFrame, names: Sequence[str], stat: str, effect: str) -> DataFrame:
    """``summary_line`` of many tests: one line for each of ``names``, nulls for one without observations."""
    listed = df.sparkSession.createDataFrame([(n,) for n in names], "test string")
    return listed.join(df, "test", "left").select(
        "test", F.col(stat).cast("double").alias("statistic"), F.col("p").cast("double").alias("p"),
        F.col(effect).cast("double").alias("effect"), F.col("n").cast("bigint").alias("n"),
    )


def summary_line(df: DataFrame, name: str, stat: str, effect: str) -> DataFrame:
    """(test, statistic, p, effect, n) of a one-row test result; p is null where it has none."""
    p = F.col("p").cast("double") if "p" in df.columns else F.lit(None).cast("double")
    return df.select(
        F.lit(name).alias("test"), F.col(stat).cast("double").alias("statistic"), p.alias("p"),
        F.col(effect).cast("double").alias("effect"), F.col("n").cast("bigint").alias("n"),
    )
