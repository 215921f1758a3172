"""Session settings and reliable materialisation."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A task may sort and hash what it reads several times over, each copy many times as large as its shuffle files.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
}
#: Bytes of input files for each partition that a shuffle starts with.
INPUT_A_PARTITION = 8 * 2**20


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on; cluster sizing stays with the caller.

    Time stamps are wall-clock, so the session zone is UTC. Adaptive execution splits
    hot join keys and chooses broadcast sides from measured sizes.
    """
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def size_shuffles(spark: SparkSession, input_bytes: int) -> None:
    """Let the partitions that shuffles start with grow with the input, so that one task's share does not.

    Adaptive execution puts small ones together again.
    """
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(least, input_bytes // INPUT_A_PARTITION)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(wanted))


def scratch_folder(spark: SparkSession) -> str:
    """A folder of this application under the shared one named by ``spark.checkpoint.dir``.

    A local session without one (tests, a laptop) gets a folder that goes when Python ends.
    A cluster must name a path that every executor can reach; without it this is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="bayworks-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        shared = _OWN[0]
    return f"{shared.rstrip('/')}/{spark.sparkContext.applicationId}"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and continue from there.

    For narrow results that are read back whole (histograms, folds); the stored rows survive
    lost executors.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def settle_table(df: DataFrame) -> DataFrame:
    """Like ``settle``, but as a columnar table.

    For wide results of which later steps read few columns: they get column pruning, filter
    pushdown and real sizes for their join choices.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
