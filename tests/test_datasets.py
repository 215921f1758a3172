"""Versioned data sets under failures, and the slicer cube against the facts."""

from __future__ import annotations

import os
from datetime import date, datetime

import pytest

from bayworks.operators.filters import Selection, apply_slicers, select
from bayworks.plans import cube, kpis
from bayworks.plans.bound import CFG, Model, SharedModel, compute_all
from bayworks.session import size_shuffles
from bayworks.sources import binding, versions

SMALL = "/root/testdata/sf0.001"


# ---- versions ---------------------------------------------------------------------
def frames(spark, n):
    return {"a": spark.range(n).withColumnRenamed("id", "k"), "b": spark.range(2 * n).selectExpr("id AS k", f"{n} AS made")}


def whole(spark, base):
    """(rows of a, rows of b, what b says it was made for) of the current version."""
    tables = versions.current(spark, base).read(spark)
    return tables["a"].count(), tables["b"].count(), {r["made"] for r in tables["b"].select("made").distinct().collect()}


def test_versions_are_published_and_read_whole(spark, tmp_path):
    base = str(tmp_path / "set")
    assert versions.current(spark, base) is None
    one, lines = versions.publish(spark, base, frames(spark, 5), "first")
    assert one.number == 1 and [(x["table"], x["expected"], x["ok"]) for x in lines] == [("a", 5, True), ("b", 10, True)]
    before = one.read(spark)
    two, _ = versions.publish(spark, base, frames(spark, 7), "second")
    assert two.number == 2 and whole(spark, base) == (7, 14, {7})
    assert before["b"].count() == 10  # a reader of the old version goes on
    assert versions.retire(spark, base, keep=1) == 1 and whole(spark, base) == (7, 14, {7})
    assert versions.publish(spark, base, frames(spark, 0))[0].number == 3
    assert versions.current(spark, base).read(spark, ["a"])["a"].columns == ["k"]


@pytest.mark.parametrize("step", ["_stage", "_verify", "_write_text", "_publish"])
@pytest.mark.parametrize("call", [0, 1])
@pytest.mark.parametrize("after", [False, True])
def test_a_failure_at_any_step_leaves_a_whole_version(spark, tmp_path, monkeypatch, step, call, after):
    base = str(tmp_path / "set")
    versions.publish(spark, base, frames(spark, 3), "first")
    plain, seen = getattr(versions, step), []

    def failing(*args):
        seen.append(step)
        if len(seen) - 1 == call:
            if after:
                plain(*args)
            raise OSError("lost")
        return plain(*args)

    monkeypatch.setattr(versions, step, failing)
    try:
        versions.publish(spark, base, frames(spark, 4), "second")
        failed = False
    except OSError:
        failed = True
    monkeypatch.undo()
    done = not failed or (step == "_publish" and after)  # what comes after the rename comes too late to undo it
    assert whole(spark, base) == ((4, 8, {4}) if done else (3, 6, {3}))
    versions.publish(spark, base, frames(spark, 6), "third")
    assert whole(spark, base) == (6, 12, {6})
    versions.retire(spark, base, keep=1)
    assert whole(spark, base) == (6, 12, {6}) and len(os.listdir(f"{base}/versions")) == 1


def test_rows_that_are_not_there_are_not_published(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "set")
    versions.publish(spark, base, frames(spark, 3))
    monkeypatch.setattr(versions, "_stage", lambda df, path: df.write.parquet(path) or df.count() + 1)
    with pytest.raises(versions.Conflict):
        versions.publish(spark, base, frames(spark, 4))
    assert whole(spark, base) == (3, 6, {3})


def test_two_writers_of_one_number(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "set")
    versions.publish(spark, base, frames(spark, 3))
    stage = versions._stage

    def overtaken(df, path):
        monkeypatch.setattr(versions, "_stage", stage)
        versions.publish(spark, base, frames(spark, 9))
        return stage(df, path)

    monkeypatch.setattr(versions, "_stage", overtaken)
    with pytest.raises(versions.Conflict):
        versions.publish(spark, base, frames(spark, 4))
    assert whole(spark, base) == (9, 18, {9})


def test_same_inputs_are_used_again(spark, tmp_path):
    source, base, built = str(tmp_path / "in"), str(tmp_path / "set"), []

    def build():
        built.append(1)
        return {"a": spark.read.parquet(source)}

    spark.range(4).write.parquet(source)
    for _ in range(2):
        made_from = versions.fingerprint(spark, [source], CFG)
        assert versions.cached(spark, base, made_from, build).read(spark)["a"].count() == 4
    assert len(built) == 1
    assert versions.fingerprint(spark, [source], "other settings") != made_from
    spark.range(3).write.mode("append").parquet(source)
    made_from = versions.fingerprint(spark, [source], CFG)
    assert versions.cached(spark, base, made_from, build).read(spark)["a"].count() == 7 and len(built) == 2


def given_tables(spark, base, jobs=6):
    """A few rows of each given table below ``base``."""
    day = datetime(2000, 3, 1)
    rows = {
        "region": [(0, "ASIA")],
        "nation": [(0, "JAPAN", 0)],
        "customer": [(0, "c0", 0, 1.0, "BUILDING"), (1, "c1", 0, 2.0, "MACHINERY")],
        "supplier": [(0, "s0", 0, 1000.0), (1, "s1", 0, 5000.0)],
        "part": [(0, "p0", "b", "TIN", 3, 900.0), (1, "p1", "b", "BRASS", 5, 900.1)],
        "orders": [(k, k % 2, "F", 10.0, day, "2-HIGH") for k in range(jobs)],
        "lineitem": [(k, k % 2, 0, 1, 2.0, 1800.0, 0.1, 0.0, "N", "O", day) for k in range(jobs)],
        "events": [(0, day, 0, "view", 1.0, "{}")],
    }
    for name, data in rows.items():
        spark.createDataFrame(data, binding.SCHEMAS[name]).write.parquet(f"{base}/{name}.parquet")
    return str(base)


def test_shared_model_publishes_what_no_query_has_published(spark, tmp_path):
    made = compute_all(SharedModel(spark, given_tables(spark, tmp_path)), str(tmp_path / "out"), ("parts_delay_cat", "abc_summary"))
    assert {r["name"]: r["rows"] for r in made.collect()} == {"parts_delay_cat": 2, "abc_summary": 1}


def test_shuffles_start_with_partitions_by_input(spark):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    for size, partitions in ((0, 8), (10**9, 119), (6 * 10**9, 715), (1, 8)):
        size_shuffles(spark, size)
        assert spark.conf.get(name) == str(partitions)


# ---- cube -------------------------------------------------------------------------
@pytest.fixture(scope="module")
def model(spark):
    return Model(spark, SMALL)


def same(got, want, key=()):
    index = lambda rows: {tuple(r[k] for k in key): r.asDict() for r in rows}
    a, b = index(got.collect()), index(want.collect())
    assert a.keys() == b.keys()
    for k in a:
        assert a[k].keys() == b[k].keys()
        for c in b[k]:
            assert a[k][c] == pytest.approx(b[k][c]), (k, c)


SELECTIONS = [
    Selection(),
    select(date(1997, 3, 15), date(1997, 3, 15)),
    select(None, date(1996, 2, 29), model=("Model B",)),
    select(date(1999, 12, 31), None, region=("ASIA", "AFRICA"), service_type=("5-LOW",)),
    select(date(1998, 1, 1), date(1999, 1, 31), centre=("CANADA", "CHINA", "nowhere")),
    select(date(2030, 1, 1), None),
]


@pytest.mark.parametrize("chosen", SELECTIONS)
def test_a_page_of_cells_equals_the_facts(model, chosen):
    made = cube.held(cube.page(cube.sliced(model.cube, chosen), CFG))
    t = apply_slicers(dict(zip(("fact", "appts", "tech"), model.published.values())), chosen)
    same(cube.headline(made), kpis.headline(t["fact"], t["appts"], t["tech"], CFG))
    same(cube.monthly_trend(made), kpis.monthly_trend(t["fact"], CFG), ("month",))
    same(cube.centre_scorecard(made), kpis.centre_scorecard(t["fact"], t["appts"], t["tech"], CFG), ("center_name",))


def test_cells_of_any_two_parts_add_up(spark, model):
    """A cube of all jobs is the sum of the cubes of two parts of them."""
    fact, appts, tech = model.published.values()
    parts = [cube.build(fact.where(f"work_order_id % 2 = {i}"), appts.where(f"appointment_id % 2 = {i}"), tech.where(f"technician_id % 2 = {i}"), CFG) for i in (0, 1)]
    both = {n: parts[0][n].unionByName(parts[1][n]) for n in parts[0]}
    same(cube.page(both, CFG), cube.page(model.cube, CFG), ("level", "month", "center_name"))


# ---- compiled checks ----------------------------------------------------------------
def test_compiled_checks_equal_single_ones(spark):
    """Hot keys, null keys, keys on one side only, rows that break several rules, an empty table."""
    from pyspark.sql import functions as F

    from bayworks.operators.validate import Use, compiled_checks, lost_key, met_key, orphans, repeated_key

    child = spark.createDataFrame([(1, 5)] * 40 + [(2, None), (3, 9), (9, 1), (None, 2), (None, None)], "k int, v int")
    parent = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (None, "b"), (None, "a"), (7, None)], "k int, s string")
    tables = {"child": child, "parent": parent, "empty": child.where("false")}
    c, p, e, b = Use("child", "k"), Use("parent", "k"), Use("empty", "k"), Use("parent", "k", "s = 'b'")
    got = compiled_checks(
        tables,
        {"child": {"r1": F.col("v") > 4, "both": F.col("v").isNull()}, "parent": {"both": F.col("s") == "b"}, "empty": {"r2": F.lit(True)}},
        {
            "repeated": [repeated_key("k", c), repeated_key("k", p)], "lost": [lost_key("k", c, p)],
            "lost known": [lost_key("k", c, p, nulls=False)], "back": [lost_key("k", p, c)], "met": [met_key("k", c, b)],
            "all lost": [lost_key("k", c, e)], "none": [lost_key("k", e, p), repeated_key("k", e)],
        },
    )
    want = {
        "r1": 41, "both": 4, "r2": 0, "repeated": 4, "lost": orphans(child, "k", parent, "k").count(),
        "lost known": orphans(child, "k", parent, "k", nulls=False).count(), "back": orphans(parent, "k", child, "k").count(),
        "met": child.join(parent.where("s = 'b'"), "k").count(), "all lost": child.count(), "none": 0,
    }
    assert {r["check_id"]: r["n"] for r in got.collect()} == want


# ---- CSV scans ----------------------------------------------------------------------
def test_csv_scan_keeps_order_and_rejects(spark, tmp_path):
    from pyspark.sql import types as T

    from bayworks.sources import files

    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("s", T.StringType()), T.StructField("v", T.DoubleType())])
    texts = {
        "a/1.csv": ["1,one,1.5", "2,two,", "x,bad key,1", "3,three"],
        "a/2.csv": [],
        "b/1.csv": ["1,later,9", "4,four,4,extra", "5,,5", "2,later,2", "1,last,0", ""],
        "b/2.csv": [f"{k},big,{k}" for k in range(100, 3000)],
    }
    for name, lines in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("\n".join(["k,s,v", *lines]) + "\n")
    rows, rejects = files.scan_csv(spark, str(tmp_path), schema)
    assert sorted((r["file"], r["line"]) for r in rejects.collect()) == [
        ("a/1.csv", "3,three"), ("a/1.csv", "x,bad key,1"), ("b/1.csv", "4,four,4,extra"),
    ]
    assert [r["k"] for r in rows.orderBy("_ord").collect()] == [1, 2, 1, 5, 2, 1, *range(100, 3000)]
    first = {r["k"]: (r["s"], r["v"]) for r in files.keep_first(rows, ["k"]).collect()}
    assert len(first) == 2903 and first[1] == ("one", 1.5) and first[2] == ("two", None) and first[5] == (None, 5.0)
    none, lost = files.scan_csv(spark, str(tmp_path / "a" / "2.csv"), schema)
    assert none.count() == 0 and lost.count() == 0


# ---- version diff ---------------------------------------------------------------------
def slow_changes(old, new, columns):
    """(key, status, changed columns) by comparing the sorted values of each key."""
    out = set()
    for k in {r[0] for r in old} | {r[0] for r in new}:
        a, b = [r for r in old if r[0] == k], [r for r in new if r[0] == k]
        values = lambda rows, i: sorted((str(r[i]) for r in rows))
        names = " ".join(c for i, c in enumerate(columns, 1) if values(a, i) != values(b, i))
        if not a or not b:
            out.add((k, "lost" if a else "added", ""))
        elif names or len(a) != len(b):
            out.add((k, "changed", names))
    return out


def test_diff_names_keys_and_reads_only_what_differs(spark, tmp_path):
    import random

    from bayworks.operators import diff

    rng = random.Random(9)
    old = [(k, rng.choice("abc"), rng.choice([None, 1, 2])) for k in range(400)]
    old += [(7, "x", 1)] * 30 + [(None, "n", 1), (None, "n", 2), (8, "x", 1), (8, "y", 2)]
    new = list(old)
    new[3] = (3, "zzz", new[3][2])
    new[50] = (50, "zzz", 99)
    new.remove((7, "x", 1))  # one copy less
    new.remove((8, "x", 1))
    new.append((8, "x", 3))
    new = [r for r in new if r[0] != 200] + [(1000, "q", None), (None, "m", 2)]
    rng.shuffle(new)
    schema, paths = "k int, s string, v int", {}
    for name, rows in (("old", old), ("new", new), ("same", old[::-1]), ("none", [])):
        paths[name] = str(tmp_path / name)
        diff.store(spark.createDataFrame(rows, schema).repartition(3), ["k"], paths[name])
    got = [tuple(r) for r in diff.changes(spark, paths["old"], paths["new"], ["k"]).collect()]
    assert len(got) == len(set(got)) and set(got) == slow_changes(old, new, ["s", "v"])
    buckets = diff.differing_buckets(spark, paths["old"], paths["new"])
    assert 0 < len(buckets) <= len(got)
    plan = diff.changes(spark, paths["old"], paths["new"], ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert diff.differing_buckets(spark, paths["old"], paths["same"]) == []
    assert diff.changes(spark, paths["old"], paths["same"], ["k"]).count() == 0
    lost = diff.changes(spark, paths["old"], paths["none"], ["k"])
    assert {r["status"] for r in lost.collect()} == {"lost"} and lost.count() == 401
    assert diff.changes(spark, paths["none"], paths["none"], ["k"]).count() == 0
