"""Headline timings: python bench.py  (reads BENCH_SF_DIR and BENCH_CPUS, prints one JSON line).

Three groups: the cleaning pipeline from raw twins to stored facts, dashboard pages on the
slicer cube of the stored facts, and report / diagnostic queries. Queries that share the
published facts (``Model.dataset``) use the version that the first of them made; the first one's
time includes making it.
"""

from __future__ import annotations

import json
import os
import sys
import time
from datetime import date

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from bayworks import configure  # noqa: E402
from bayworks.operators import clean  # noqa: E402
from bayworks.operators.filters import Selection, select  # noqa: E402
from bayworks.plans import cube, facts  # noqa: E402
from bayworks.plans.bound import CFG, QUERIES, Model, raw_tables  # noqa: E402
from bayworks.session import scratch_folder, settle_table  # noqa: E402
from bayworks.sources import files  # noqa: E402

HEADLINE = (
    "q01", "q02", "q03", "q04", "q05", "q06", "q07", "q08", "q09", "q10", "q11", "q12", "q13", "q14", "q15",
    "q16", "q17", "q18", "q19", "q20", "q21", "fact_service", "group_kpis", "dq99", "process_stages", "abc",
    "kruskal_turnaround", "spearman_rating_late", "whatif_shift", "measures_by_centre",
)


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bayworks-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def clean_and_build(model: Model, out: str) -> None:
    """Raw twins -> cleaning with log -> fact tables on disk."""
    cleaned = clean.Pipeline(raw_tables(model), CFG, settle_table)
    rows = cleaned.rows()
    clean.cleaning_log(cleaned).collect()
    fact = facts.fact_service(rows, CFG)
    files.write_tables({"fact_service": fact, "fact_appointments": facts.fact_appointments(rows)}, out)
    stored = model.spark.read.parquet(f"{out}/fact_service")
    months = facts.fact_technician_month(rows, stored, CFG)
    files.write_tables({"fact_technician_month": facts.with_centre(months, rows["service_centers"])}, out)


def page(cells, chosen: Selection) -> None:
    """Executive page: headline, monthly trend and centre ranking for one selection, from the slicer cube."""
    made = cube.held(cube.page(cube.sliced(cells, chosen), CFG))
    cube.headline(made).collect()
    cube.monthly_trend(made).collect()
    cube.centre_scorecard(made).collect()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    times: dict[str, float] = {}

    def clock(name: str, work) -> None:
        start = time.perf_counter()
        work()
        times[name] = round(time.perf_counter() - start, 3)

    model = Model(spark, folder)
    drain(QUERIES["q08"](spark, folder))  # JVM start-up is not part of any query
    out = f"{scratch_folder(spark)}/bench"
    clock("clean_and_build_facts", lambda: clean_and_build(model, out))
    stored = {
        name: spark.read.parquet(f"{out}/{table}").cache()
        for name, table in (
            ("fact", "fact_service"), ("appts", "fact_appointments"), ("tech", "fact_technician_month"),
        )
    }
    cells = {}
    clock("build_cube", lambda: cells.update(
        files.save_parquet(cube.build(stored["fact"], stored["appts"], stored["tech"], CFG), f"{out}/cube")))
    for df in cells.values():
        df.cache().count()  # the pages read cells that are in memory already, as a dashboard's do
    page(cells, Selection())  # nor is the compilation of a page part of showing one
    clock("page_render", lambda: page(cells, Selection()))
    one = select(date(1998, 6, 1), date(1998, 12, 31), region=("ASIA",))
    clock("page_slicer_refresh", lambda: page(cells, one))
    for df in (*stored.values(), *cells.values()):
        df.unpersist()
    for name in HEADLINE:
        clock(name, lambda n=name: drain(QUERIES[n](spark, folder)))
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": float(sf)}))
    spark.stop()


if __name__ == "__main__":
    main()
