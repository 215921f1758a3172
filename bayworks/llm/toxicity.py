"""Toxicity: a weighted lexicon of word beginnings, matched by Aho-Corasick on folded text.

Folding undoes homoglyphs and digit substitutions. The lexicon's entries and weights are
learnt from labelled documents; exception phrases cancel the entries inside them. The sum
of weights is normalised by the length of the text and turned into a likelihood.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bayworks.llm.common import fresh, labelled_texts
from bayworks.session import settle_table

#: Labelled documents of each class that the lexicon is learnt from.
PER_CLASS = 6000
#: Lengths of the word beginnings that can become entries; whole shorter words count too.
SHORTEST, LONGEST = 4, 10
#: An entry occurs in this many toxic documents at least and has this log-odds at least.
MIN_DOCS, MIN_WEIGHT = 5, 2.5

# ---- fixed values: folding ------------------------------------------------------
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ӏ": "l", "ℓ": "l",
    "⁰": "o", "¹": "i", "³": "e",
}
DIGITS = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "trash collection", "pond scum", "clown fish", "clown car")
# ---------------------------------------------------------------------------------
_GLYPHS = {ord(k): v for k, v in HOMOGLYPHS.items()} | {n: chr(n - 0xFEE0) for n in range(0xFF10, 0xFF5B)}
_GLYPHS |= {n: None for n in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
# Combining accents go, accented Latin letters become plain ones.
_GLYPHS |= {n: None for n in range(0x300, 0x370)}
_GLYPHS |= {
    n: d[0]
    for n in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))
    if (d := unicodedata.normalize("NFKD", chr(n)))[0].isascii() and d[0].isalpha() and all(map(unicodedata.combining, d[1:]))
}
#: On UTF-8 bytes: letters and bytes of other characters stay, look-alike digits become letters.
_TABLE = bytes(
    b if b > 127 or 97 <= b <= 122 else ord(DIGITS[chr(b)]) if chr(b) in DIGITS else 32 for b in range(256)
)


#: An exclamation mark stands for a letter only inside a word; at its end it is punctuation.
_INNER_MARK = re.compile(r"(?<=[^\W_])!(?=[^\W_])")


def fold(text: str) -> str:
    """Lower case, homoglyphs, accented letters and look-alike signs as plain letters, all else single blanks.

    The result is the UTF-8 bytes as characters 0-255, with a blank before every word.
    """
    text = text.lower()
    if not text.isascii():
        text = text.translate(_GLYPHS).lower()
    if "!" in text:
        text = _INNER_MARK.sub("i", text)
    words = text.encode("utf-8", "surrogatepass").translate(_TABLE).split()
    return (b" " + b" ".join(words) + b" ").decode("latin-1") if words else ""


def beginnings(folded: str) -> set[str]:
    """The distinct word beginnings of a folded text, each with its leading blank."""
    out = set()
    for w in set(folded.split()):
        out.update(" " + w[:n] for n in range(SHORTEST, min(len(w), LONGEST) + 1))
        if len(w) == SHORTEST - 1:
            out.add(f" {w} ")
    return out


def sketch(folded: str) -> int:
    """The smallest hash of the five-word windows: near copies of a text mostly share it."""
    w = folded.split()
    if not w:
        return 0
    return min(xxhash.xxh64_intdigest(" ".join(w[i : i + 5])) for i in range(max(len(w) - 4, 1))) >> 1


@dataclass
class Model:
    """``weights``: entry -> log-odds. The automaton is built once in each task."""

    weights: dict[str, float]
    coefficients: list[float]
    bias: float
    exceptions: tuple[str, ...] = EXCEPTIONS
    _machine: object = field(default=None, repr=False, compare=False)

    def machine(self):
        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self._machine.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                folded = fold(phrase)
                self._machine.add_word(folded, (len(folded), None))
            self._machine.make_automaton()
        return self._machine

    def __getstate__(self):
        return {**self.__dict__, "_machine": None}


def signals(model: Model, text: str | None) -> list[float]:
    """[weight found, the same by length, the heaviest entry] of a whole text.

    Of entries that begin at the same word the heaviest counts. Entries inside an exception
    phrase do not count.
    """
    folded = fold(text) if text else ""
    if not folded or not len(model.machine()):
        return [0.0, 0.0, 0.0]
    at: dict[int, float] = {}
    spared = []
    for end, (size, weight) in model.machine().iter(folded):
        start = end - size + 1
        if weight is None:
            spared.append((start, end))
        elif weight > at.get(start, 0.0):
            at[start] = weight
    spared.sort()
    reach, phrase = -1, 0
    for k in sorted(at) if spared else ():
        while phrase < len(spared) and spared[phrase][0] <= k:
            reach = max(reach, spared[phrase][1])
            phrase += 1
        if k < reach:
            del at[k]
    total = sum(at.values())
    words = folded.count(" ") - 1
    return [math.log1p(total), math.log1p(100.0 * total / max(words, 20)), max(at.values(), default=0.0)]


def likelihood(model: Model, text: str | None) -> float:
    x = float(np.dot(model.coefficients, signals(model, text)) + model.bias)
    return 1.0 / (1.0 + math.exp(-max(min(x, 35.0), -35.0)))


def _sketched(rows: DataFrame) -> DataFrame:
    """(label, folded) with one document of each sketch and label."""

    def run(batches):
        for batch in batches:
            folded = [fold(t.as_py() or "") for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([sketch(f) for f in folded], pa.int64()), pa.array([f.encode("latin-1") for f in folded], pa.binary())],
                ["label", "sketch", "folded"],
            )

    made = settle_table(rows.select("text", "label").mapInArrow(run, "label int, sketch long, folded binary"))
    pick = F.min_by("folded", F.xxhash64("folded"))
    return settle_table(made.groupBy("label", "sketch").agg(pick.alias("folded")))


def _count(rows: DataFrame) -> DataFrame:
    """(entry, toxic, clean): how many documents of either label hold each word beginning."""

    def run(batches):
        seen = {0: Counter(), 1: Counter()}
        for batch in batches:
            for label, folded in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen[label].update(beginnings(folded.as_py().decode("latin-1")))
            if len(seen[0]) + len(seen[1]) > 500_000:
                yield from flush(seen)
        yield from flush(seen)

    def flush(seen):
        for label, counts in seen.items():
            keys = [k.encode("latin-1") for k in counts]
            n = list(counts.values())
            zero = [0] * len(n)
            both = (zero, n) if label else (n, zero)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *(pa.array(x, pa.int64()) for x in both)], ["entry", "clean", "toxic"])
            counts.clear()

    parts = rows.select("label", "folded").mapInArrow(run, "entry binary, clean long, toxic long")
    return parts.groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _prune(found: list[tuple[str, float, int]]) -> dict[str, float]:
    """Entry -> weight without the entries that a shorter one makes needless.

    A longer beginning stays only if it is clearly stronger than the shorter one.
    """
    weights: dict[str, float] = {}
    for entry, weight, _ in sorted(found, key=lambda x: len(x[0])):
        shorter = max((weights[entry[:n]] for n in range(SHORTEST + 1, len(entry)) if entry[:n] in weights), default=-1e9)
        if weight > shorter + 0.5:
            weights[entry] = weight
    return weights


def fit(docs: DataFrame, labels: DataFrame, learn: Column, exceptions: tuple[str, ...] = EXCEPTIONS, per_class: int = PER_CLASS) -> Model:
    """Learn the lexicon and the likelihood from ``labels`` (doc_id, toxic) where ``learn`` holds.

    At most ``per_class`` documents of each class are used, near copies once. Two
    thirds give the entries, the rest the likelihood, so entries that only describe single
    documents get no trust. With only one class known, the model answers by its share: 1 or 0.
    """
    rows = _sketched(labelled_texts(docs, labels, "toxic", learn, per_class))
    part = F.pmod(F.col("sketch"), 3)
    sizes = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return Model({}, [0.0, 0.0, 0.0], 35.0 if 1 in sizes else -35.0, exceptions)
    here = {r[0]: r[1] for r in rows.where(part < 2).groupBy("label").count().collect()}
    clean, toxic = here.get(0, 0), here.get(1, 0)
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    least = max(2, min(MIN_DOCS, toxic // 10))
    kept = _count(rows.where(part < 2)).withColumn("weight", odds).where((F.col("toxic") >= least) & (F.col("weight") >= MIN_WEIGHT))
    found = [(bytes(r["entry"]).decode("latin-1"), r["weight"], r["toxic"]) for r in kept.collect()]
    model = Model(_prune(found), [0.0, 0.0, 0.0], 0.0, exceptions)

    def measure(folded: pa.Array) -> pa.Array:
        return pa.array([signals(model, f.as_py().decode("utf-8", "replace")) for f in folded], pa.list_(pa.float64()))

    # The folded text folds to itself, so the signals are those of the text.
    other = rows.where(part == 2).select(F.col("label").cast("double"), F.arrow_udf(measure, "array<double>")("folded").alias("x"))
    other = settle_table(other).select("label", array_to_vector("x").alias("features"))
    if other.select("label").distinct().count() < 2:
        return Model(model.weights, [1.0, 0.0, 0.0], -2.0, exceptions)
    fitted = LogisticRegression(maxIter=50, regParam=1e-3).fit(other)
    return Model(model.weights, fitted.coefficients.toArray().tolist(), float(fitted.intercept), exceptions)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with one more column ``toxicity``, the likelihood of label 1 for the whole text.

    Null and empty texts get the likelihood of a text without entries. A ``toxicity`` column
    of the input stays, ours then ends in an underscore.
    """

    def answer(texts: pa.Array) -> pa.Array:
        return pa.array([likelihood(model, t.as_py()) for t in texts], pa.float64())

    return docs.withColumn(fresh(docs, "toxicity"), F.arrow_udf(answer, "double").asNondeterministic()(text))
