"""Line deduplication: long lines that many documents share stay in one document only.

DataFrame functions only: lines are exploded and hashed, the documents that hold a hash are
counted, and the positions that stay put each text together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bayworks.llm.common import fresh
from bayworks.session import settle_table

MIN_CHARS = 40
MIN_DOCS = 5
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(BLANKS))
    # A text of one byte a character has no other letters, and the built-in lower is faster.
    return F.when(F.char_length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _hashes(value: Column) -> list[Column]:
    """128 bits, so that different lines of any corpus stay apart."""
    return [F.xxhash64(value).alias("h1"), F.xxhash64(F.lit("line"), value).alias("h2")]


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("text"), text).alias("t2")]


def _long_lines(texts: DataFrame, min_chars: int) -> DataFrame:
    """(id, t1, t2, pos, h1, h2): a row for each line that is long enough to be judged."""
    keyed = texts.select("id", *_text_key(F.col("text")), "text")  # once a text, not once a line
    bare = keyed.select("id", "t1", "t2", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    bare = bare.where(F.char_length(F.btrim("line", F.lit(BLANKS))) >= min_chars)
    return bare.select("id", "t1", "t2", "pos", *_hashes(line_key(F.col("line"))))


def shared_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h1, h2, docs, keeper): the lines found in at least ``min_docs`` documents.

    Documents are told apart by id; all rows without an id are one document. The keeper is
    the largest id. Lines are folded by line and id first and by line then, both with sums
    on the sending side, so a line that a third of all documents hold is spread over the ids.
    """
    texts = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    held = _long_lines(texts, min_chars).select("h1", "h2", "id").distinct()
    counted = held.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("id").alias("keeper"))
    return counted.where(F.col("docs") >= min_docs)


def drop_shared_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with one more column ``lines``: n_lines, n_dropped and the text that is kept.

    Texts are split at line feeds; a null or empty text is one empty line. A line whose key
    (``line_key``) has ``min_chars`` characters or more and is found in ``min_docs``
    documents or more goes from all of them but the one with the largest id; there, all its
    repeats stay. Rows of one id are one document, so repeated rows stay or go together;
    rows without an id are one document that comes before all ids. A ``lines`` column of
    the input is kept, ours then ends in an underscore. An empty table gives no rows.

    The counted lines are stored, so the planner knows their size before it chooses how to
    join them; a line held by very many documents is one small row there. Only positions
    travel: those that go are taken off the sequence of all positions.
    """
    common = settle_table(shared_lines(docs, text, doc_id, min_chars, min_docs))
    texts = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    lost = _long_lines(texts, min_chars).join(common, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
    lost = lost.groupBy("id", "t1", "t2").agg(F.collect_set("pos").alias("gone"))
    names = {n: fresh(docs, n) for n in ("id", "t1", "t2", "gone", "body", "lines")}
    back = lost.select(*(F.col(n).alias(names[n]) for n in ("id", "t1", "t2", "gone")))
    body = F.coalesce(F.col(text), F.lit(""))
    t1, t2 = _text_key(body)
    same = F.col(doc_id).eqNullSafe(F.col(names["id"])) & (t1 == F.col(names["t1"])) & (t2 == F.col(names["t2"]))
    gone = F.col(names["gone"])

    def rest(split: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), gone)
        kept = F.when(gone.isNull(), body).otherwise(F.array_join(F.transform(stay, lambda i: F.get(split, i)), "\n"))
        return F.struct(F.size(split).cast("long").alias("n_lines"), F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_dropped"), kept.alias("text"))

    # As the argument of a function a text is split once, not again for each of its lines.
    lines = F.transform(F.array(F.split(body, "\n")), rest)[0]
    joined = docs.join(back, same, "left")
    return joined.withColumn(names["lines"], lines).select(*docs.columns, names["lines"])


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of ``drop_shared_lines``."""
    found = drop_shared_lines(docs.select("doc_id", "text"))
    return found.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.col("lines.text").cast("binary"), 256).alias("kept_sha256"))
