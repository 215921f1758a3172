from __future__ import annotations

import os
import shutil
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from bayworks import configure

    shared = tempfile.mkdtemp(prefix="bayworks-tests-")
    session = (
        SparkSession.builder.master("local[8]")
        .appName("bayworks-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.checkpoint.dir", shared)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()
    shutil.rmtree(shared, ignore_errors=True)
