"""Quality classifier: a factorisation machine over hashed words, structure and metadata."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import FMClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bayworks.llm.common import fresh, labelled_texts
from bayworks.session import settle_table

#: Labelled documents of each class that the machine is fitted on.
PER_CLASS = 2500
BUCKETS = 1024
RANK = 4
STATISTICS = (
    "log_words", "log_lines", "word_length", "upper", "digit", "symbol", "punctuation", "other", "blank", "distinct",
    "top_word", "repeated_lines", "short_lines", "pipes", "exclamations", "log_n_chars",
)
WIDTH = BUCKETS + len(STATISTICS)

_UPPER = bytes(range(65, 91))
_OTHER = bytes(range(128, 256))
_DIGIT = b"0123456789"
_SYMBOL = b"#*$%&<>@^~=+_\\{}[]"
_PUNCTUATION = b".,;:'\"()-?"


def _share(raw: bytes, those: bytes) -> float:
    return (len(raw) - len(raw.translate(None, those))) / max(len(raw), 1)


def features(text: str | None, n_chars: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(columns, values) of a whole text; an empty one has only its size statistics.

    Words are lower-cased, hashed, and weigh by the root of their count, scaled to length
    one. ``n_chars`` is metadata of the table; where it is null the text's length stands in.
    """
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    counts = Counter(words)
    hashed: dict[int, float] = {}
    for w, k in counts.items():
        at = xxhash.xxh32_intdigest(w.lower()) % BUCKETS
        hashed[at] = hashed.get(at, 0.0) + math.sqrt(k)
    size = math.sqrt(sum(v * v for v in hashed.values())) or 1.0
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    letters = max(len(raw), 1)
    stats = (
        math.log1p(n) / 10, math.log1p(len(lines)) / 10, min(letters / max(n, 1), 40) / 20, _share(raw, _UPPER), _share(raw, _DIGIT),
        _share(raw, _SYMBOL), _share(raw, _PUNCTUATION), _share(raw, _OTHER), (letters - sum(map(len, words))) / letters,
        len(counts) / max(n, 1), max(counts.values(), default=0) / max(n, 1), 1 - len(set(lines)) / max(len(lines), 1),
        sum(len(x) < 20 for x in lines) / max(len(lines), 1), min(raw.count(b"|") * 5 / letters, 1), min(raw.count(b"!") * 5 / letters, 1),
        math.log1p(len(text) if n_chars is None or n_chars != n_chars or n_chars < 0 else n_chars) / 15,
    )
    at = np.fromiter(hashed, np.int64, len(hashed))
    value = np.fromiter(hashed.values(), np.float64, len(hashed)) / size
    return np.concatenate([at, np.arange(BUCKETS, WIDTH)]), np.concatenate([value, np.array(stats)])


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def raw_score(model: Model, at: np.ndarray, value: np.ndarray) -> float:
    """Bias, linear part and all pairs: the half of (squared sums less sums of squares)."""
    v = model.factors[at] * value[:, None]
    pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
    return model.bias + float(model.linear[at] @ value) + pairs


def likelihood(model: Model, text: str | None, n_chars: float | None = None) -> float:
    x = raw_score(model, *features(text, n_chars))
    return 1.0 / (1.0 + math.exp(-max(min(x, 35.0), -35.0)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS) -> Model:
    """Fit on at most ``per_class`` documents of each class of ``labels`` (doc_id, quality) where ``learn`` holds.

    With only one class known the machine always answers it, with none it answers one half.
    """
    rows = labelled_texts(docs, labels, "quality", learn, per_class)

    def make(texts: pa.Array, sizes: pa.Array) -> pa.Array:
        out = []
        for t, n in zip(texts, sizes):
            row = np.zeros(WIDTH)
            at, value = features(t.as_py(), n.as_py())
            row[at] = value
            out.append(row)
        return pa.array(out, pa.list_(pa.float64()))

    made = F.arrow_udf(make, "array<double>")("text", "n_chars")
    rows = settle_table(rows.select(F.col("label").cast("double").alias("label"), made.alias("x")))
    found = {r[0] for r in rows.select("label").distinct().collect()}
    if len(found) < 2:
        bias = 35.0 * (sum(found) * 2 - 1) if found else 0.0
        return Model(bias, np.zeros(WIDTH), np.zeros((WIDTH, RANK)))

    rows = rows.coalesce(6).select("label", array_to_vector("x").alias("features")).cache()
    machine = FMClassifier(factorSize=RANK, maxIter=60, stepSize=0.1, regParam=1e-4, initStd=0.02, seed=7, tol=1e-5)
    fitted = machine.fit(rows)
    rows.unpersist()
    return Model(float(fitted.intercept), fitted.linear.toArray(), fitted.factors.toArray().reshape(WIDTH, RANK))


def score(docs: DataFrame, model: Model, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with one more column ``quality``, the likelihood of label 1 for the whole text.

    A ``quality`` column of the input stays, ours then ends in an underscore.
    """

    def answer(texts: pa.Array, sizes: pa.Array) -> pa.Array:
        return pa.array([likelihood(model, t.as_py(), n.as_py()) for t, n in zip(texts, sizes)], pa.float64())

    size = F.col(n_chars).cast("double") if n_chars and n_chars in docs.columns else F.lit(None).cast("double")
    return docs.withColumn(fresh(docs, "quality"), F.arrow_udf(answer, "double").asNondeterministic()(F.col(text), size))
