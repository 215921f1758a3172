"""Language identification in two steps: the language family, then one-versus-one linear
support vector machines between the languages of that family."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bayworks.llm.common import balanced_sample, fresh
from bayworks.session import settle_table

BUCKETS = 4096
#: Documents of each language that the machines are fitted on.
PER_LANGUAGE = 600
UNKNOWN = "und"
#: Margin at which a pairwise decision counts as 0.88 likely.
STEEP = 2.0
#: Below this likelihood a language is not told; two even pairwise decisions give 0.25.
MIN_SCORE = 0.3

# ---- fixed values: language families ------------------------------------------
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "semitic": ("am", "ar", "he", "mt"),
    "austronesian": ("id", "ms", "tl"),
    "sinitic": ("zh",),
}
# -------------------------------------------------------------------------------
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
#: Lower-case letters stay, all other ASCII characters become blanks, bytes of other characters stay.
FOLD = bytes(b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def profile(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Hashed counts of byte pairs and triples of a whole text, square-rooted, of length one."""
    raw = b" " + text.lower().encode("utf-8", "surrogatepass").translate(FOLD) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    two = (b[:-1] << 8) | b[1:]
    three = (two[:-1] << 8) | b[2:]
    shift = np.uint32(32 - buckets.bit_length() + 1)
    total = np.zeros(buckets)
    for codes, salt in ((two, 0x85EBCA6B), (three, 0x9E3779B1)):
        total += np.bincount((codes + np.uint32(1)) * np.uint32(salt) >> shift, minlength=buckets)
    root = np.sqrt(total)
    return root / max(np.linalg.norm(root), 1e-12)


@dataclass
class Machine:
    """Decides between two names: the second one for a positive margin."""

    names: tuple[str, str]
    weights: np.ndarray
    bias: float


@dataclass
class Model:
    """``between``: machines over families; ``within``: machines over the languages of each."""

    languages: dict[str, list[str]]
    between: list[Machine]
    within: dict[str, list[Machine]]


@F.arrow_udf(T.StructType().add("at", T.ArrayType(T.IntegerType())).add("value", T.ArrayType(T.DoubleType())))
def _sparse_profiles(texts: pa.Array) -> pa.Array:
    out = []
    for t in texts:
        p = profile(t.as_py() or "")
        at = np.nonzero(p)[0]
        out.append({"at": at.tolist(), "value": p[at].tolist()})
    return pa.array(out, pa.struct([("at", pa.list_(pa.int32())), ("value", pa.list_(pa.float64()))]))


def _fit_pair(rows: DataFrame, column: str, names: tuple[str, str]) -> Machine:
    two = rows.where(F.col(column).isin(*names)).withColumn("label", (F.col(column) == names[1]).cast("double"))
    fitted = LinearSVC(maxIter=25, regParam=1e-4, standardization=False).fit(two.select("label", "features"))
    return Machine(names, fitted.coefficients.toArray(), float(fitted.intercept))


def _pairs(rows: DataFrame, column: str, names: list[str]) -> list[Machine]:
    return [_fit_pair(rows, column, pair) for pair in combinations(sorted(names), 2)]


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on at most ``per_language`` documents of each language among the rows where ``learn`` holds.

    Null languages, null texts and rows without an id are never learnt from, and of repeated
    rows of one id in one language one is. Languages
    without a known family form one of their own. The number of languages, not of
    documents, bounds what the sample holds. With no language the model is empty, with one
    it always answers that one.
    """
    usable = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull())
    ids = settle_table(usable.select(F.col(doc_id).alias("id"), F.col(lang).alias("name")).distinct())
    names = sorted(r[0] for r in ids.select("name").distinct().collect())
    if not names:
        return Model({}, [], {})
    picked = settle_table(balanced_sample(ids, "id", "name", names, per_language))
    texts = usable.select(F.col(doc_id).alias("id"), F.col(lang).alias("name"), F.col(text).alias("text"))
    family = F.create_map(*(F.lit(x) for n in names for x in (n, FAMILY_OF.get(n, n))))[F.col("name")]
    texts = texts.join(F.broadcast(picked), ["id", "name"]).groupBy("id", "name").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = settle_table(texts.select("name", family.alias("family"), _sparse_profiles("text").alias("p")))
    vector = F.udf(lambda at, value: Vectors.sparse(BUCKETS, at, value), VectorUDT())
    rows = rows.coalesce(6).select("name", "family", vector("p.at", "p.value").alias("features")).cache()
    by_family: dict[str, list[str]] = {}
    for n in names:
        by_family.setdefault(FAMILY_OF.get(n, n), []).append(n)
    model = Model(by_family, _pairs(rows, "family", list(by_family)), {f: _pairs(rows, "name", of) for f, of in by_family.items()})
    rows.unpersist()
    return model


def _vote(p: np.ndarray, names: list[str], machines: list[Machine]) -> tuple[str, float]:
    """The name with the highest mean pairwise likelihood, and that mean; ties go to the first name."""
    if len(names) == 1:
        return names[0], 1.0
    won = dict.fromkeys(names, 0.0)
    for m in machines:
        second = 1.0 / (1.0 + np.exp(-STEEP * (p @ m.weights + m.bias)))
        won[m.names[1]] += second
        won[m.names[0]] += 1.0 - second
    best = max(sorted(names), key=lambda n: won[n])
    return best, float(won[best] / (len(names) - 1))


def predict(model: Model, text: str | None) -> tuple[str, float]:
    """(language, score) of a whole text; ``und`` and 0 without a letter or without a model."""
    if not model.languages or not has_letter(text):
        return UNKNOWN, 0.0
    p = profile(text)
    family, sure = _vote(p, sorted(model.languages), model.between)
    lang, more = _vote(p, model.languages[family], model.within[family])
    return lang, sure * more


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with one more column ``language``: a struct of lang_pred and score.

    A ``language`` column of the input stays, ours then ends in an underscore. The model's
    weights, three for four languages, travel with the tasks: their size does not depend on
    the rows.
    """
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    def answer(texts: pa.Array) -> pa.Array:
        out = [predict(model, t.as_py()) for t in texts]
        return pa.array([{"lang_pred": a, "score": b} for a, b in out], kind)

    call = F.arrow_udf(answer, "struct<lang_pred:string,score:double>").asNondeterministic()
    return docs.withColumn(fresh(docs, "language"), call(text))


def keep_identified(docs: DataFrame, model: Model, text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is told with ``min_score`` at least; all columns stay.

    Texts without a letter go. With an empty model nothing can be told, and every row stays.
    """
    if not model.languages:
        return docs
    name = fresh(docs, "language")
    found = identify(docs, model, text)
    return found.where((F.col(f"{name}.lang_pred") != UNKNOWN) & (F.col(f"{name}.score") >= min_score)).drop(name)
