"""Quality rules by host: failures of a document's own rules, gathered by host, shrunk, and
joined back as host verdicts."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bayworks.llm.common import fresh
from bayworks.session import settle_table

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
#: A host goes when its shrunk failure rate is above this share.
MAX_HOST_RATE = 0.5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNT_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more, first occurrences included."""
    windows = list(zip(*(words[i:] for i in range(window))))
    if len(set(windows)) == len(windows):
        return 0
    times, total, reach = Counter(windows), 0, 0
    for at, w in enumerate(windows):
        if times[w] > 1:
            total += at + window - max(at, reach)
            reach = at + window
    return total


def count_text(text: str | None) -> tuple[int, int, int, int, int]:
    """The five counts of a whole text; a null text has none of anything."""
    if not text:
        return (0, 0, 0, 0, 0)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly the six blanks
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return (
        len(words),
        len(text) - sum(map(raw.count, (bytes([b]) for b in BLANKS))),
        sum(map(raw.count, (bytes([b]) for b in SYMBOLS))),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


@F.arrow_udf(COUNT_TYPE)
def _counts(texts: pa.Array) -> pa.Array:
    rows = [count_text(t.as_py()) for t in texts]
    columns = zip(*rows) if rows else [()] * len(COUNTS)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(COUNTS))


# A filter on the counts must not pull the Python call into itself and run it twice.
_counts = _counts.asNondeterministic()


def host_rates(judged: DataFrame) -> DataFrame:
    """(host, docs, failed, rate) of rows with ``host`` and ``failed``; rows without a host are left out.

    The rate is the posterior mean under a beta prior whose mean is the overall failure rate
    and whose weight comes from the variance between hosts (method of moments, each host
    weighted by its documents). The prior is one row; equal hosts give a weight of 1e6.
    """
    hosts = judged.where("host is not null").groupBy("host").agg(
        F.count("*").alias("docs"), F.sum(F.col("failed").cast("long")).alias("failed")
    )
    hosts = settle_table(hosts)
    p = F.col("failed") / F.col("docs")
    prior = hosts.agg(
        (F.sum("failed") / F.sum("docs")).alias("mean"), F.sum("docs").alias("docs"), F.count("*").alias("hosts"),
        F.sum(F.col("docs") * p * p).alias("square"),
    ).first()
    mean = prior["mean"] or 0.0
    between = prior["square"] / prior["docs"] - mean * mean if prior["docs"] else 0.0
    # Of the observed variance, as much as binomial draws alone would show is not between hosts.
    between -= mean * (1 - mean) * (prior["hosts"] - 1) / prior["docs"] if prior["docs"] else 0.0
    weight = min(max(mean * (1 - mean) / between - 1, 1.0), 1e6) if between > 0 else 1e6
    rate = (F.col("failed") + F.lit(weight * mean)) / (F.col("docs") + F.lit(weight))
    return hosts.withColumn("rate", rate)


def judge(docs: DataFrame, text: str = "text", host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``docs`` with one more column, ``verdict``: the counts, base_failed, host_rate and kept.

    A null or blank text has no words and fails. A document without a host has no host
    verdict and a null host_rate. A verdict column of the input is kept, ours then ends in
    an underscore. Only the rejected hosts meet the documents again.
    """
    name = fresh(docs, "verdict")
    c = {k: F.col(f"{name}.{k}") for k in COUNTS}
    failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
    held = docs.withColumn(name, _counts(text))
    held = held.withColumn(name, F.struct(*(c[k].alias(k) for k in COUNTS), failed.alias("base_failed")))
    held = settle_table(held)
    rates = settle_table(host_rates(held.select(F.col(host).alias("host"), F.col(f"{name}.base_failed").alias("failed"))))
    key, rate = fresh(held, "host_key"), fresh(held, "host_rate")
    back = rates.select(F.col("host").alias(key), F.col("rate").alias(rate))
    out = held.join(back, held[host] == F.col(key), "left")
    good_host = F.coalesce(F.col(rate) <= max_host_rate, F.lit(True))
    whole = F.struct(f"{name}.*", F.col(rate).alias("host_rate"), (~F.col(f"{name}.base_failed") & good_host).alias("kept"))
    return out.withColumn(name, whole).drop(key, rate)


def keep(docs: DataFrame, text: str = "text", host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of ``docs`` whose document and host both pass; all columns stay."""
    name = fresh(docs, "verdict")
    return judge(docs, text, host, max_host_rate).where(F.col(f"{name}.kept")).drop(name)
