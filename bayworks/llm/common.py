"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bayworks.session import settle_table


#: Rows that travel to a Python worker at a time; texts can be long.
BATCH_ROWS = 2000


def short_batches(spark: SparkSession) -> None:
    """Keep Python workers small: no more than ``BATCH_ROWS`` rows in a batch, fewer if the session says so."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever columns its owner added."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True for rows that no model may learn from; a row without an id is one of them."""
    return F.coalesce(fold_of(doc_id, folds) == fold, F.lit(True))


def balanced_sample(rows: DataFrame, key: str, label: str, classes: list, per_class: int) -> DataFrame:
    """At most ``per_class`` rows of each class, those with the smallest hash of ``key``.

    ``rows`` are narrow (key and label). The bound is per class, so the result has at most
    ``len(classes) * per_class`` rows however large the input is.
    """
    order = F.xxhash64(F.col(key), F.lit("sample"))
    parts = [rows.where(F.col(label) == c).orderBy(order, F.col(key)).limit(per_class) for c in classes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, per_class: int) -> DataFrame:
    """(text, n_chars, label) of a bounded, balanced sample of the rows that may be learnt from.

    ``allowed`` is a predicate on ``doc_id``. The sampled ids number at most twice
    ``per_class``, a fixed parameter, so sending them to every task is bounded. A document
    with several labels counts once for each, repeated rows of one id count once, by their texts' hash.
    """
    known = labels.where(allowed & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    known = known.distinct()
    picked = settle_table(balanced_sample(known, "doc_id", "label", [0, 1], per_class))
    size = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    texts = docs.select("doc_id", "text", size.alias("n_chars"))
    order = F.when(F.col("text").isNotNull(), F.xxhash64("text")).otherwise(2**63 - 1)
    found = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min_by(F.struct("text", "n_chars"), order).alias("one"))
    return found.select("one.text", "one.n_chars", "label")
