"""Reading and writing the tables: raw extract, cleaned tables, results, verification."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bayworks.operators.clean import _ORD as ORDINAL
from bayworks.operators.clean import with_ordinal
from bayworks.session import settle_table
from bayworks.sources import schemas, versions

FACT_FILES = ("fact_service", "fact_appointments", "fact_technician_month", "dim_date")
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _exists(spark: SparkSession, path: str) -> bool:
    """Path check through the file system of the path (local, HDFS or object store)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def missing_tables(spark: SparkSession, base: str, names: Sequence[str], suffix: str = "") -> list[str]:
    """Names whose file or folder is not there."""
    return [n for n in names if not _exists(spark, f"{base}/{n}{suffix}")]


def load_raw(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The untyped extract: one CSV per table, read with a declared schema.

    The input order is kept in an ordinal column for keep-first rules.
    """
    out = {}
    for name in schemas.TABLES:
        df = spark.read.option("header", True).schema(schemas.raw_schema(name)).csv(f"{base}/{name}.csv")
        out[name] = with_ordinal(df, files=True)
    return out


def scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of CSV files with a header: what fits ``schema``, and the lines that do not.

    A line with too few or too many fields, or a value that is not of its column's type, is a
    reject: (file, line), the file's path below ``path``. Rows keep the order of the files, by
    path and place, in the ordinal that keep-first rules use. The scan is stored once: it must
    read all columns to judge a line, and both results come from the same reading.
    """
    bad = "_bad_line"
    wide = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad)
    rows = reader.option("timestampFormat", TIMESTAMP_FORMAT).option("recursiveFileLookup", True).schema(wide).csv(path)
    root = F.regexp_replace("_metadata.file_path", "^file:/+", "/")
    below = F.substring_index(root, path.rstrip("/").split("://")[-1].lstrip("/") + "/", -1)
    stored = settle_table(with_ordinal(rows.withColumn("file", below), files=True))
    kept = [c for c in stored.columns if c not in (bad, "file")]
    return stored.where(F.col(bad).isNull()).select(kept), stored.where(F.col(bad).isNotNull()).select("file", F.col(bad).alias("line"))


def keep_first(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of rows with equal keys the first by their ordinal; folded by aggregation, so a hot key is summed where it lies."""
    rest = [c for c in df.columns if c not in keys and c != ORDINAL]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ORDINAL).alias("_first"))
    return first.select(*keys, "_first.*")


def load_cleaned(spark: SparkSession, base: str, names: Sequence[str] = FACT_FILES) -> dict[str, DataFrame]:
    """Stored tables by name."""
    return {n: spark.read.parquet(f"{base}/{n}") for n in names}


def load_cleaned_csv(spark: SparkSession, base: str, names: Sequence[str] = schemas.TABLES) -> dict[str, DataFrame]:
    """Cleaned CSV tables, typed by their declared schema."""
    return {
        n: spark.read.option("header", True)
        .option("timestampFormat", TIMESTAMP_FORMAT)
        .schema(schemas.typed_schema(n))
        .csv(f"{base}/{n}")
        for n in names
    }


def write_tables(tables: Mapping[str, DataFrame], base: str, order: Sequence[str] | None = None) -> None:
    """Parquet sink, parents before children; facts are partitioned by month."""
    for name in order or tables:
        df = schemas.with_defaults(tables[name], name)
        writer = df.write.mode("overwrite")
        if name in ("fact_service", "fact_appointments"):
            writer = writer.partitionBy("month")
        writer.parquet(f"{base}/{name}")


def write_csv(tables: Mapping[str, DataFrame], base: str) -> None:
    """CSV sink with one fixed time-stamp format."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).option("timestampFormat", TIMESTAMP_FORMAT).csv(
            f"{base}/{name}"
        )


def save_parquet(results: Mapping[str, DataFrame], base: str) -> dict[str, DataFrame]:
    """Write one folder per result and return what was written, read back."""
    for name, df in results.items():
        df.write.mode("overwrite").parquet(f"{base}/{name}")
    return {name: df.sparkSession.read.parquet(f"{base}/{name}") for name, df in results.items()}


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def row_count(df: DataFrame, name: str, value: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(value)).select(F.lit(name).alias("table"), value)


def verify_counts(source: Mapping[str, DataFrame], loaded: Mapping[str, DataFrame]) -> DataFrame:
    """(table, expected, actual, ok) for every loaded table."""
    out = None
    for name in source:
        line = row_count(source[name], name, "expected").crossJoin(
            F.broadcast(row_count(loaded[name], name, "actual").select("actual"))
        )
        out = line if out is None else out.unionByName(line)
    return out.withColumn("ok", F.col("expected") == F.col("actual"))


def load_all(spark: SparkSession, tables: Mapping[str, DataFrame], target: str) -> DataFrame:
    """All-or-nothing load, parents before children: (table, expected, actual, ok) per table.

    The tables become a new version of the data set at ``target`` (``versions``), verified
    before it is published. A failed load raises and the version before it stays current.
    """
    order = [n for n in schemas.LOAD_ORDER if n in tables]
    _, lines = versions.publish(spark, target, {n: schemas.with_defaults(tables[n], n) for n in order})
    return spark.createDataFrame(lines, "table string, expected long, actual long, ok boolean")


def save_results(results: Mapping[str, DataFrame], base: str) -> list[dict]:
    """Write one folder per report; a failing report is recorded and the others go on."""
    log = []
    for name, df in results.items():
        try:
            df.write.mode("overwrite").option("header", True).csv(f"{base}/{name}")
            log.append({"name": name, "status": "ok"})
        except Exception as error:  # isolation of reports is the feature
            log.append({"name": name, "status": "failed", "error": str(error)[:500]})
    return log


def metrics_json(one_row: DataFrame) -> str:
    """A one-row result as JSON text."""
    return json.dumps(one_row.first().asDict(), default=str)
