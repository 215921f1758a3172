"""Versioned data sets: whole versions of a set of tables, published by one rename.

    base/versions/<id>/<table>/     parquet, written once and never changed
    base/pointers/<number>.json     what a version holds; the highest number is current

A version becomes current when its pointer file, written beside and complete, is renamed to
the next number. Nothing that can be read is moved or overwritten, so a reader finds a whole
version at any moment, and a writer that dies leaves only files that no pointer names. Of
two writers that publish the same number one fails and may try again.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Somebody else published first, or what was written is not what was read back."""


@dataclass(frozen=True)
class Version:
    number: int
    folder: str
    fingerprint: str
    tables: dict[str, dict]  # name -> {"schema": JSON schema, "rows": count}

    def read(self, spark: SparkSession, names: Sequence[str] | None = None) -> dict[str, DataFrame]:
        """The tables with their stored schemas; no footer is read for that."""
        return {
            n: spark.read.schema(T.StructType.fromJson(self.tables[n]["schema"])).parquet(f"{self.folder}/{n}")
            for n in names or self.tables
        }


# ---- files, by the file system of the path ------------------------------------------
def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _listed(spark: SparkSession, folder: str) -> list[tuple[str, int, int]]:
    """(path, length, time of change) of all files below ``folder``, or of itself; hidden ones excepted."""
    fs, p = _files(spark, folder)
    out = []
    if fs.exists(p):
        found = fs.listFiles(p, True)
        while found.hasNext():
            f = found.next()
            if not f.getPath().getName().startswith(("_", ".")):
                out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Length of all files below a folder, or of a file; 0 if there is none."""
    return sum(length for _, length, _ in _listed(spark, path))


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _files(spark, path)
    stream = fs.create(p, False)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def _read_text(spark: SparkSession, path: str) -> str:
    fs, p = _files(spark, path)
    jvm = spark.sparkContext._jvm
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def fingerprint(spark: SparkSession, paths: Sequence[str], *settings) -> str:
    """What a version was made from: its input files' names, sizes and times, and the settings used."""
    seen = [_listed(spark, p) for p in paths]
    return hashlib.sha256(json.dumps([seen, [repr(s) for s in settings]]).encode()).hexdigest()


# ---- reading ------------------------------------------------------------------------
def _pointers(spark: SparkSession, base: str) -> list[tuple[int, str]]:
    out = []
    for path, _, _ in _listed(spark, f"{base}/pointers"):
        stem = path.rsplit("/", 1)[-1].removesuffix(".json")
        if stem.isdigit():
            out.append((int(stem), path))
    return sorted(out)


def current(spark: SparkSession, base: str) -> Version | None:
    """The version that was published last, or None."""
    found = _pointers(spark, base)
    if not found:
        return None
    number, path = found[-1]
    text = json.loads(_read_text(spark, path))
    return Version(number, text["folder"], text["fingerprint"], text["tables"])


# ---- writing ------------------------------------------------------------------------
def _stage(df: DataFrame, path: str) -> int:
    """Write one table; the rows are counted as they pass, not in a second scan."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return int(seen.get["rows"])


def _verify(spark: SparkSession, folder: str, name: str, schema: T.StructType, expected: int) -> dict:
    """What was stored is counted from its footers."""
    actual = spark.read.schema(schema).parquet(f"{folder}/{name}").count()
    return {"table": name, "expected": expected, "actual": actual, "ok": expected == actual}


def _publish(spark: SparkSession, base: str, number: int, text: str) -> None:
    beside, final = f"{base}/pointers/_{uuid.uuid4().hex}", f"{base}/pointers/{number:012d}.json"
    _write_text(spark, beside, text)
    fs, p = _files(spark, beside)
    goal = _files(spark, final)[1]
    if fs.exists(goal) or not fs.rename(p, goal):
        fs.delete(p, False)
        raise Conflict(f"version {number} of {base} was published by somebody else")


def publish(spark: SparkSession, base: str, tables: Mapping[str, DataFrame], made_from: str = "") -> tuple[Version, list[dict]]:
    """Store ``tables`` in the given order as a new version and make it current.

    Returns the version and one line per table: rows that were written and rows that are
    there. If they differ, or anything fails before the rename, the old version stays.
    """
    old = current(spark, base)
    number = old.number + 1 if old else 1
    folder = f"{base}/versions/{uuid.uuid4().hex}"
    kept, lines = {}, []
    for name, df in tables.items():
        expected = _stage(df, f"{folder}/{name}")
        lines.append(_verify(spark, folder, name, df.schema, expected))
        kept[name] = {"schema": df.schema.jsonValue(), "rows": expected}
    if not all(x["ok"] for x in lines):
        raise Conflict(f"row counts differ: {[x['table'] for x in lines if not x['ok']]}")
    text = json.dumps({"folder": folder, "fingerprint": made_from, "tables": kept})
    _publish(spark, base, number, text)
    return Version(number, folder, made_from, kept), lines


def cached(spark: SparkSession, base: str, made_from: str, build: Callable[[], Mapping[str, DataFrame]]) -> Version:
    """The current version if it was made from the same inputs, else a new one from ``build``."""
    now = current(spark, base)
    if now and now.fingerprint == made_from:
        return now
    return publish(spark, base, build(), made_from)[0]


def retire(spark: SparkSession, base: str, keep: int = 2) -> int:
    """Delete all but the last ``keep`` versions, pointers first, and what failed writers left.

    Readers of an older version lose their files, and so does a writer that has not yet
    published: call it when neither can be at work. Returns the number of deleted versions.
    """
    found = _pointers(spark, base)
    gone, stay = found[:-keep] if keep else found, found[-keep:] if keep else []
    folders = {json.loads(_read_text(spark, path))["folder"].rsplit("/", 1)[-1] for _, path in stay}
    for _, path in gone:
        fs, p = _files(spark, path)
        fs.delete(p, False)
    fs, p = _files(spark, f"{base}/versions")
    deleted = 0
    for status in fs.listStatus(p) if fs.exists(p) else []:
        if status.getPath().getName() not in folders:
            deleted += bool(fs.delete(status.getPath(), True))
    return deleted
