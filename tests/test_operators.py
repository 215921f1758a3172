"""Operators against brute force, with hot keys and ties."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import pvalues
import pytest
from pyspark.sql import functions as F

from bayworks.config import Config
from bayworks.functions import scalars, shopclock, tails
from bayworks.operators import ranks
from bayworks.operators.history import neighbours, running_number
from bayworks.plans import explore, stats

CFG = Config()


# ---- history ---------------------------------------------------------------------------
@pytest.fixture(scope="module")
def visits(spark):
    rng = random.Random(3)
    base = datetime(2025, 1, 1)
    rows = []
    for i in range(600):
        who = "hot" if i % 3 == 0 else f"v{rng.randrange(20)}"
        at = base + timedelta(minutes=rng.randrange(0, 6000))
        rows.append((i, who, rng.choice("ab"), at, at + timedelta(hours=rng.randrange(1, 9))))
    rows += [(1000, None, "a", base, base), (1001, None, "a", base, base), (1002, None, "a", None, base)]
    rows += [(1100 + i, "v1", "a", None, base + timedelta(hours=i)) for i in range(3)]  # no time stamp
    rows += [(1200 + i, "busy", "b", base + timedelta(seconds=i // 3), base) for i in range(120)]  # two minutes
    return spark.createDataFrame(rows, "id int, who string, kind string, at timestamp, done timestamp").cache()


@pytest.mark.parametrize("partitions", [1, 8, 90])
def test_history_matches_brute_force(spark, visits, partitions):
    """Also with so many partitions that entities, and equal or missing times, span several."""
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check_history(visits)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def check_history(visits):
    out = neighbours(visits, ["who", "kind"], "at", "id", {"p": "done"}, {"n": "at"})
    out = running_number(out, ["who"], "at", "id", "k")
    got = {r["id"]: (r["p"], r["n"], r["k"]) for r in out.collect()}
    rows = visits.collect()
    expected = {}
    for r in rows:
        if r["who"] is None:
            expected[r["id"]] = (None, None, None)
            continue
        mine = sorted((x for x in rows if x["who"] == r["who"]), key=lambda x: (x["at"] is not None, x["at"] or datetime.min, x["id"]))
        same = [x for x in mine if x["kind"] == r["kind"]]
        i = [x["id"] for x in same].index(r["id"])
        expected[r["id"]] = (
            same[i - 1]["done"] if i else None,
            same[i + 1]["at"] if i + 1 < len(same) else None,
            [x["id"] for x in mine].index(r["id"]) + 1,
        )
    assert got == expected


# ---- ranks -----------------------------------------------------------------------------
@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("xyz"), 50 if i % 3 == 0 else rng.randrange(400)) for i in range(900)]
    return spark.createDataFrame(rows, "id int, g string, v int").cache()


@pytest.mark.parametrize("descending", [True, False])
def test_ranks_match_brute_force(values, descending):
    got = ranks.with_rank(values, ["g"], "v", rank="r", dense="d", descending=descending).collect()
    for row in got:
        group = [x["v"] for x in got if x["g"] == row["g"]]
        ahead = [v for v in group if (v > row["v"] if descending else v < row["v"])]
        assert row["r"] == len(ahead) + 1 and row["d"] == len(set(ahead)) + 1


@pytest.mark.parametrize("partitions", [1, 8, 90])
def test_stacked_ranks_across_borders(spark, partitions):
    """One group spans partitions, small groups and a null group share them; sums travel along."""
    rows = [("big", i % 700, 1) for i in range(2000)] + [(f"s{i % 40}", i, 2) for i in range(200)] + [(None, i % 3, 3) for i in range(9)]
    df = spark.createDataFrame(rows, "g string, v int, w int")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["g"], r["v"]): (r["n"], r["before"], r["distinct_before"], r["w_before"]) for r in ranks.ranked_values(df, ["g"], "v", sums=["w"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {}
    for g, v, _ in rows:
        less = [x for x in rows if x[0] == g and x[1] < v]
        want[g, v] = (sum(x[:2] == (g, v) for x in rows), len(less), len({x[1] for x in less}), sum(x[2] for x in less))
    assert got == want


def test_ranks_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, v int")
    assert ranks.ranked_values(empty, ["g"], "v").count() == 0 and ranks.ranked_values(empty, [], "v").count() == 0
    assert ranks.exact_percentiles(empty, [], "v", {"p": 0.5}).first()["p"] is None


@pytest.mark.parametrize("descending", [True, False])
def test_positions_with_a_hot_value(values, descending):
    got = ranks.row_positions(values, "v", "id", "p", descending).orderBy("p").collect()
    sign = -1 if descending else 1
    want = sorted(((r["v"], r["id"]) for r in got), key=lambda t: (sign * t[0], t[1]))
    assert [(r["v"], r["id"]) for r in got] == want and [r["p"] for r in got] == list(range(1, 901))


@pytest.mark.parametrize("total", [3, 10, 23, 100])
def test_ntile_remainder_rule(spark, total):
    df = spark.range(1, total + 1).withColumn("n", F.lit(total))
    got = [r[0] for r in df.orderBy("id").select(ranks.ntile(F.col("id"), F.col("n"), 10)).collect()]
    size, extra = divmod(total, 10)
    want = [t + 1 for t in range(10) for _ in range(size + (t < extra))]
    assert got == want


def test_exact_percentiles_match_builtin(values):
    probs = {"a": 0.25, "b": 0.5, "c": 0.95}
    got = {r["g"]: tuple(r[x] for x in probs) for r in ranks.exact_percentiles(values, ["g"], "v", probs).collect()}
    want = values.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, probs.values()))).alias("p")).collect()
    for r in want:
        assert got[r["g"]] == pytest.approx(tuple(r["p"]))


# ---- statistics --------------------------------------------------------------------------
def test_p_values_at_known_quantiles():
    assert pvalues.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert pvalues.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-10)
    assert pvalues.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-10)
    # t = 2.2281388519649385 is the two-sided 5 % point for 10 degrees of freedom
    t, dof = 2.2281388519649385, 10
    rho = t / (t * t + dof) ** 0.5
    assert pvalues.correlation_two_sided(rho, dof + 2) == pytest.approx(0.05, abs=1e-9)


def test_tail_columns_equal_plain_numerics(spark):
    rows = [(x, float(d)) for d in (1, 2, 3, 7, 30, 400, 20_000) for x in (0.0, 1e-9, 0.3, 1.0, d * 0.5, d * 0.97, d + 0.0, d * 1.1, d * 2.0, d * 5.0)]
    got = spark.createDataFrame(rows, "x double, d double").withColumn("p", tails.chi2_tail(F.col("x"), F.col("d"))).collect()
    for r in got:
        assert r["p"] == pytest.approx(pvalues.chi2_tail(r["x"], r["d"]), rel=1e-8, abs=1e-12), r
    rows = [(rho, n) for n in (3, 4, 5, 12, 100, 5_000, 1_000_000, 10**10) for rho in (0.0, 1e-7, 1e-3, -0.02, 0.3, -0.9, 0.999999, 1.0)]
    got = spark.createDataFrame(rows, "rho double, n long").withColumn("p", tails.correlation_two_sided(F.col("rho"), F.col("n"))).collect()
    for r in got:
        want = pvalues.correlation_two_sided(r["rho"], r["n"])
        if r["n"] == 10**10 and r["rho"] != 1:  # plain numerics lose their digits here; Student's t is the normal distribution
            want = pvalues.normal_two_sided(abs(r["rho"]) * (r["n"] / (1 - r["rho"] ** 2)) ** 0.5)
        assert r["p"] == pytest.approx(want, rel=1e-6, abs=1e-7), r
    zs = spark.createDataFrame([(z / 7,) for z in range(-10, 80)], "z double").withColumn("p", tails.normal_upper_doubled(F.col("z"))).collect()
    assert all(r["p"] == pytest.approx(pvalues.normal_upper_doubled(r["z"]), rel=1e-9) for r in zs)
    odd = spark.createDataFrame([(None, None), (1.0, 0.0), (None, 3.0), (float("nan"), 2.0)], "x double, d double")
    for r in odd.select("d", tails.chi2_tail(F.col("x"), F.col("d")).alias("p"), tails.correlation_two_sided(F.col("x"), F.col("d")).alias("q"), tails.normal_upper_doubled(F.lit(None).cast("double")).alias("z")).collect():
        assert (r["p"] is None or r["d"] == 2.0) and r["z"] is None and (r["q"] is None or r["d"] == 3.0)


def test_log_gamma(spark):
    xs = [0.5, 1.0, 1.5, 2.0, 3.7, 10.0, 123.5, 1e4, 1e9]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", tails.log_gamma(F.col("x")).alias("y")).collect()
    assert all(r["y"] == pytest.approx(math.lgamma(r["x"]), rel=1e-13, abs=1e-13) for r in got)


def test_rank_tests_on_small_samples(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0), ("b", 5.0), ("b", 6.0)], "g string, v double"
    )
    k = stats.kruskal(df, "g", "v").first()
    assert k["h"] == pytest.approx(27 / 7) and k["dof"] == 1 and k["p"] == pytest.approx(pvalues.chi2_tail(27 / 7, 1))
    u = stats.mann_whitney(df, F.col("g") == "a", "v").first()
    assert u["u"] == 0 and u["rank_biserial"] == -1
    pair = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 5), (5, 4)], "x int, y int")
    assert stats.spearman(pair, "x", "y").first()["rho"] == pytest.approx(0.9)


def test_tests_ranked_together_equal_single_ones(spark):
    rng = random.Random(9)
    rows = [(rng.choice("abc"), rng.randrange(30), rng.choice([None, 1.5, 2.25, 7.0]), rng.randrange(4)) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, x int, y double, z int")
    many = {r["test"]: r for r in stats.kruskal_many(df, "g", {"one": "x", "two": "y"}).collect()}
    for name, c in (("one", "x"), ("two", "y")):
        single = stats.kruskal(df, "g", c).first()
        assert [many[name][k] for k in ("h", "dof", "p", "epsilon_sq", "n")] == pytest.approx([single[k] for k in ("h", "dof", "p", "epsilon_sq", "n")])
    pairs = {"xy": (df, "x", "y"), "xz": (df, "x", "z"), "none": (df.where("g = 'q'"), "x", "y")}
    found = stats.spearman_many(pairs)
    rho = {r["test"]: r for r in found.collect()}
    for name in ("xy", "xz"):
        single = stats.spearman(df, *name).first()
        assert [rho[name][k] for k in ("rho", "p", "n")] == pytest.approx([single[k] for k in ("rho", "p", "n")])
    lines = {r["test"]: r for r in stats.summary_lines(found, list(pairs), "rho", "rho").collect()}
    assert set(lines) == set(pairs) and lines["none"]["statistic"] is None and lines["none"]["n"] is None


def test_chi2_with_and_without_correction(spark):
    rows = [("x", True)] * 10 + [("x", False)] * 20 + [("y", True)] * 20 + [("y", False)] * 10
    got = stats.chi2(spark.createDataFrame(rows, "a string, b boolean"), "a", "b").first()
    assert got["chi2"] == pytest.approx(60 * (300 - 30) ** 2 / 30**4) and got["dof"] == 1
    rows += [("z", True)] * 15 + [("z", False)] * 15
    wide = stats.chi2(spark.createDataFrame(rows, "a string, b boolean"), "a", "b").first()
    assert wide["chi2"] == pytest.approx(20 / 3) and wide["dof"] == 2


def test_describe_uses_sample_skewness(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (7.0,)], "v double")
    row = explore.describe(df, ["v"]).first()
    mean = 10 / 3
    m2, m3 = (sum((v - mean) ** k for v in (1, 2, 7)) / 3 for k in (2, 3))
    assert row["skew"] == pytest.approx(m3 / m2**1.5 * 6**0.5) and row["p50"] == 2.0


def test_table_diff_counts_duplicates(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "v int")
    b = spark.createDataFrame([(1,), (2,), (None,), (3,)], "v int")
    assert explore.table_diff(a, b).first()[:] == (1, 1, False)
    assert explore.table_diff(a, a).first()[:] == (0, 0, True)


# ---- scalar expressions --------------------------------------------------------------------
def one(spark, expr, **values):
    cols = [F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("_")]
    return spark.range(1).select(*cols).select(expr).first()[0]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2026-03-05", "2026-03-05 00:00:00"),
        ("05/03/2026", "2026-03-05 00:00:00"),
        ("2026-03-05 10:20:30", "2026-03-05 10:20:30"),
        ("32/13/2026", None),
        ("soon", None),
        (None, None),
    ],
)
def test_mixed_dates(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(scalars.parse_datetime("t").cast("string")).first()[0] == expected


def test_text_and_labels(spark):
    assert one(spark, scalars.normalise_text("t"), t="  a \t b  ") == "a b"
    assert one(spark, scalars.alias_lookup("t", CFG.status_aliases), t=" No  Show ") == "No-Show"
    assert one(spark, scalars.alias_lookup("t", CFG.status_aliases), t="later") is None
    assert one(spark, scalars.parse_bool("t"), t=" TRUE ") is True
    assert one(spark, scalars.parse_bool("t"), t="yes") is None


def test_rounding_and_floors(spark):
    assert one(spark, scalars.rounded_to("v", 2), v=2.675) == 2.68
    assert one(spark, scalars.rounded_to("v", 2), v=-2.675) == -2.68
    assert one(spark, scalars.ratio("a", "b"), a=1, b=0) is None
    a, b = datetime(2025, 1, 31, 12), datetime(2025, 1, 31, 11)
    assert one(spark, scalars.elapsed_days("a", "b"), a=a, b=b) == -1
    assert one(spark, scalars.load_band("v", (0.0, 0.6, 0.7)), v=0.6) == "(0, 0.6]"
    assert one(spark, scalars.load_band("v", (0.0, 0.6, 0.7)), v=0.0) is None


# ---- workshop clock --------------------------------------------------------------------------
MON, SAT = datetime(2025, 1, 6), datetime(2025, 1, 11)


@pytest.mark.parametrize(
    ("start", "hours", "expected"),
    [
        (datetime(2025, 1, 5, 15), 0, MON.replace(hour=9)),  # Sunday opens on Monday
        (MON.replace(hour=17), 3, datetime(2025, 1, 7, 10)),
        (SAT.replace(hour=17), 3, datetime(2025, 1, 13, 10)),
        (MON.replace(hour=9), 10, MON.replace(hour=19)),  # ends exactly at closing
        (MON.replace(hour=19), 0, datetime(2025, 1, 7, 9)),
        (MON.replace(hour=7), 1.5, MON.replace(hour=10, minute=30)),
        (MON.replace(hour=9), 60, SAT.replace(hour=19)),
        (MON.replace(hour=9), 60.5, datetime(2025, 1, 13, 9, 30)),
        (datetime(1965, 3, 6, 18), 2, datetime(1965, 3, 8, 10)),  # before the epoch
    ],
)
def test_add_work_hours(spark, start, hours, expected):
    df = spark.createDataFrame([(start, float(hours))], "t timestamp, h double")
    assert df.select(shopclock.add_work_hours("t", "h", CFG)).first()[0] == expected


def _walk(ts: datetime, minutes: int) -> datetime:
    """Minute-by-minute reference."""
    while not (ts.weekday() < 6 and 9 <= ts.hour < 19):
        ts += timedelta(minutes=1)
    while minutes:
        if ts.weekday() < 6 and 9 <= ts.hour < 19:
            minutes -= 1
            ts += timedelta(minutes=1)
            if not minutes:
                return ts
        else:
            ts += timedelta(minutes=1)
    return ts


def test_clock_against_a_walk(spark):
    rng = random.Random(9)
    rows = [(MON + timedelta(minutes=rng.randrange(20_000)), rng.randrange(0, 3000)) for _ in range(60)]
    df = spark.createDataFrame([(t, m / 60.0) for t, m in rows], "t timestamp, h double")
    got = [r[0] for r in df.select(shopclock.add_work_hours("t", "h", CFG)).collect()]
    assert got == [_walk(t, m) for t, m in rows]


def test_clock_is_additive_and_aligned_is_idempotent(spark):
    df = spark.createDataFrame([(MON.replace(hour=h), a, b) for h in (8, 11, 20) for a, b in ((2.0, 13.0), (9.0, 4.5))],
                               "t timestamp, a double, b double")
    step = shopclock.add_work_hours(shopclock.add_work_hours("t", "a", CFG), "b", CFG)
    whole = shopclock.add_work_hours("t", F.col("a") + F.col("b"), CFG)
    aligned = shopclock.align_to_open("t", CFG)
    again = shopclock.align_to_open(aligned, CFG)
    assert df.where((step != whole) | (aligned != again)).count() == 0


def test_round_quarter(spark):
    got = [one(spark, shopclock.round_quarter("v"), v=v) for v in (0.01, 0.125, 0.375, 0.63, 2.9)]
    assert got == [0.25, 0.25, 0.5, 0.75, 3.0]
