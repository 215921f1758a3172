"""Phrase mining on a weighted de Bruijn graph.

Nodes are pairs of neighbouring words, edges are triples: the triple x y z leads from x y to
y z and weighs as much as it occurs. Only edges are counted in the texts, one for each word
that starts one; where a piece ends, the edge leads to the end (two words) or is the last
word alone. Shorter counts are flows: a pair occurs as often as edges leave its node, ends
of pieces included, and a word as often as its pairs and its own ends. Words are summed up
so where the edges are, in each task, and travel with them.

A node with one edge in, one edge out and no piece that starts or ends there passes its
weight on; such nodes are compacted into paths, inside of which every count is the weight.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bayworks.session import settle_table

MIN_COUNT = 10
COVER_PERCENT = 50
SCALE = 1_000_000
TOP = 2000
UNKNOWN = "und"
#: Words, and different words, that a task counts before it hands its sums on; they bound its memory.
HELD_WORDS, WORD_BITS = 4_000_000, 21
#: Rows handed to Spark at a time.
OUT_ROWS = 100_000
#: A pair that holds more edges than a shuffle partition does on average (of so many at least
#: and at most) is spread over this many salts. The shares come from one text in so many; they
#: only balance the work, counts do not depend on them.
LEAST_PARTS, MOST_PARTS, SALTS, SAMPLED = 256, 8192, 64, 64
#: First rows of a language come from this many independent lists, so no task sees all phrases.
RANK_LISTS = 16

_FOLD = bytearray(range(256))
_FOLD[65:91] = _FOLD[97:123]
for _c in b".,;:!?\n\x0b\x0c\r":
    _FOLD[_c] = 10
_FOLD = bytes(_FOLD)


class _Words(dict):
    """word -> number from 1, given out at first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 1
        return number


def _edges_of(words: _Words, texts: dict[bytes, array]):
    """Record batches (node, next, c) of the word numbers held for each language; 0 ends a piece.

    ``node`` is the first two words with a blank, then a tab and the language; ``next`` is the
    third word or empty where the piece ends. Rows with one word in ``node`` are the flow of
    that word: its pairs and its ends. Words hold neither blank nor tab.
    """
    spelt = np.array([b"", *words], dtype=object)
    order = np.argsort(spelt)  # in order of words, neighbours share their beginnings and pack better
    names = pa.array(spelt[order], pa.binary())
    gaps = pa.array(np.where(np.arange(len(spelt)) > 0, b" ", b"").tolist(), pa.binary())
    number = np.empty(len(spelt), np.int64)
    number[order] = np.arange(len(spelt))
    low = (1 << WORD_BITS) - 1
    for lang, ids in texts.items():
        ids.append(0)
        a = number[np.frombuffer(ids, np.int32)]
        code = a[:-2] << WORD_BITS | a[1:-1]
        code <<= WORD_BITS
        code |= np.where(a[1:-1] > 0, a[2:], 0)
        code = code[a[:-2] > 0]
        code.sort()
        first = np.flatnonzero(np.r_[len(code) > 0, code[1:] != code[:-1]][: len(code)])
        count = np.diff(np.r_[first, len(code)])
        code = code[first]
        # A word's flow takes the place of its own ends.
        flow = np.bincount(code >> 2 * WORD_BITS, count).astype(np.int64)
        paired = (code >> WORD_BITS & low) > 0
        seen = np.flatnonzero(flow)
        code, count = np.r_[code[paired], seen << 2 * WORD_BITS], np.r_[count[paired], flow[seen]]
        for at in range(0, len(code), OUT_ROWS):
            part = code[at : at + OUT_ROWS]
            one, two, three = (pa.array(part >> k * WORD_BITS & low) for k in (2, 1, 0))
            node = pc.binary_join_element_wise(names.take(one), gaps.take(two), names.take(two), pa.scalar(b"\t" + lang, pa.binary()), b"")
            columns = [node.view(pa.string()), names.take(three).view(pa.string()), pa.array(count[at : at + OUT_ROWS])]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "next", "c"])


def count_edges(batches):
    """For mapInArrow over (lang, text) as bytes: the edges of all texts of a task, summed."""
    words, held, texts = _Words(), 0, {}
    number = words.__getitem__
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if not text:
                continue
            for piece in text.translate(_FOLD).split(b"\n"):
                found = piece.split()  # of the blanks only space and tab are left
                if not found:
                    continue
                if held + len(found) > HELD_WORDS or len(words) + len(found) >= 1 << WORD_BITS:
                    yield from _edges_of(words, texts)
                    words, held, texts = _Words(), 0, {}
                    number = words.__getitem__
                ids = texts.get(lang)
                if ids is None:
                    ids = texts[lang] = array("i")
                ids.extend(map(number, found))
                ids.append(0)
                held += len(found) + 1
    yield from _edges_of(words, texts)


_EDGE = "node string, next string, c long"


def _pieces(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).cast("binary").alias("lang"), F.col(text).cast("binary").alias("text"))


def _words_of(node: Column) -> Column:
    return F.substring_index(node, "\t", 1)


def _lang_of(node: Column) -> Column:
    return F.substr(node, F.char_length(_words_of(node)) + 2)


def hot_nodes(docs: DataFrame, text: str, lang: str) -> list[str]:
    """Nodes that hold more than a partition's share of the edges of a fixed sample of texts: at
    most ``MOST_PARTS`` of them, so they fit into every task."""
    parts = min(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), LEAST_PARTS), MOST_PARTS)
    some = _pieces(docs.where(F.pmod(F.xxhash64(text), F.lit(SAMPLED)) == 0), text, lang)
    sizes = some.mapInArrow(count_edges, _EDGE).groupBy("node").agg(F.count("*").alias("n"))
    sizes = settle_table(sizes)
    total = sizes.agg(F.sum("n")).first()[0] or 0
    rows = sizes.where(F.col("n") * parts > total).collect()
    return [r["node"] for r in rows]


def graph(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = MIN_COUNT) -> DataFrame:
    """Stored rows (kind, lang, first, next, c) with c of at least ``least``, counted over all texts.

    kind ``edge``: first is x y, next is z; ``pair`` and ``word``: first alone, c its flow;
    ``total``: all words of the language, whatever their number.

    One shuffle carries the edges, by node. Where a pair is hot its edges are salted, and its
    flow is the sum over the salts.
    """
    found = _pieces(docs, text, lang).mapInArrow(count_edges, _EDGE)
    hot = hot_nodes(docs, text, lang)
    keys = ["node", "salt"] if hot else ["node"]
    if hot:
        found = found.withColumn("salt", F.when(F.col("node").isin(hot), F.pmod(F.hash("next"), F.lit(SALTS))).otherwise(0))
    dealt = found.repartition(*keys)
    # The three sums read one exchange. So all of them use all its columns, and what they ask of a
    # node or a next word they ask of sums: else Spark would narrow or filter each one's input
    # below the exchange and count the texts anew for each.
    times = F.sum(F.when(F.col("next").isNotNull(), F.col("c"))).alias("c")
    edges = dealt.groupBy(*keys, "next").agg(F.sum("c").alias("c"), F.max(F.col("next") != "").alias("inner"))
    edges = edges.where(F.col("inner") & (F.col("c") >= least))
    pair = F.max(F.contains("node", F.lit(" "))).alias("pair")
    flow = dealt.groupBy(*keys).agg(times, pair, F.max(F.col("node").isin(hot) if hot else F.lit(False)).alias("hot"))
    if hot:
        whole = flow.where("hot").groupBy("node").agg(F.sum("c").alias("c"), F.max("pair").alias("pair"))
        flow = flow.where("not hot").select("node", "c", "pair").unionByName(whole)
    total = dealt.groupBy(_lang_of(F.col("node")).alias("lang")).agg(F.sum(F.when(~F.contains("node", F.lit(" ")) & (F.col("next") == ""), F.col("c"))).alias("c"))
    none = F.lit("")
    named = (_lang_of(F.col("node")).alias("lang"), _words_of(F.col("node")).alias("first"))
    flow = flow.where(F.col("c") >= least)
    return settle_table(
        edges.select(F.lit("edge").alias("kind"), *named, "next", "c")
        .unionByName(flow.select(F.when(F.col("pair"), "pair").otherwise("word").alias("kind"), *named, none.alias("next"), "c"))
        .unionByName(total.select(F.lit("total").alias("kind"), "lang", none.alias("first"), none.alias("next"), "c"))
    )


def paths(made: DataFrame) -> DataFrame:
    """Stored edges of ``graph`` with their compacted path: (lang, source, next, target, c,
    source_c, target_c, head, place, last).

    An edge goes on to the next if both weigh what the node between them does: then nothing
    else enters or leaves it. ``head`` is the first edge of the path, ``place`` the number of
    edges before this one in it, ``last`` whether none follows. Every occurrence starts
    somewhere, so no path is a circle. Heads are found by doubling: rounds grow with the
    logarithm of the longest path, which is no longer than a piece, and only edges whose
    count reaches ``least`` take part.
    """
    edge = made.where("kind = 'edge'").select("lang", F.col("first").alias("source"), "next", "c")
    edge = edge.withColumn("target", F.concat_ws(" ", F.substring_index("source", " ", -1), "next"))
    pair = made.where("kind = 'pair'").select("lang", F.col("first").alias("node"), F.col("c").alias("flow"))
    for end in ("source", "target"):
        edge = edge.join(pair.withColumnsRenamed({"node": end, "flow": f"{end}_c"}), ["lang", end])
    edge = settle_table(edge.withColumn("edge", F.monotonically_increasing_id()))
    out = edge.where("c = source_c").select("lang", F.col("source").alias("node"), F.col("c").alias("flow"), F.col("edge").alias("later"))
    into = edge.where("c = target_c").select("lang", F.col("target").alias("node"), F.col("c").alias("flow"), F.col("edge").alias("earlier"))
    link = settle_table(into.join(out, ["lang", "node", "flow"]).select("earlier", "later"))
    # Pointers of the linked edges only: up to an edge, and how many edges lie between.
    now = link.select(F.col("later").alias("edge"), F.col("earlier").alias("up"), F.lit(1).cast("long").alias("place"))
    now = settle_table(now)
    while True:
        above = now.select(F.col("edge").alias("up"), F.col("up").alias("upper"), F.col("place").alias("more"))
        step = now.join(above, "up", "left")
        moved = settle_table(step.select("edge", F.coalesce("upper", "up").alias("up"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), F.col("upper").isNotNull().alias("moving")))
        now = moved.drop("moving")
        if moved.where("moving").isEmpty():
            break
    inner = link.select(F.col("earlier").alias("edge"), F.lit(False).alias("last"))
    whole = edge.join(now, "edge", "left").join(inner, "edge", "left")
    return settle_table(whole.select("lang", "source", "next", "target", "c", "source_c", "target_c", F.coalesce("up", "edge").alias("head"),
                                     F.coalesce("place", F.lit(0)).cast("long").alias("place"), F.coalesce("last", F.lit(True)).alias("last")))


def passages(compacted: DataFrame) -> DataFrame:
    """(lang, words, n_words, c): the word sequence of each compacted path; a path is no longer than a piece."""
    parts = F.array_sort(F.collect_list(F.struct("place", "source", "next")))
    rows = compacted.groupBy("lang", "head", "c").agg(parts.alias("parts"))
    words = F.concat(F.split(F.col("parts")[0]["source"], " "), F.col("parts.next"))
    return rows.select("lang", F.array_join(words, " ").alias("words"), F.size(words).cast("long").alias("n_words"), "c")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a * a / (left * right)), exact for counts of up to 15 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    top = (wide(a) * wide(a)).cast("decimal(31,0)") * F.lit(SCALE).cast("decimal(7,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))


def phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = MIN_COUNT, cover: int = COVER_PERCENT, top: int | None = TOP
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of phrases of two and three words.

    A-Z are lower-cased; ``.,;:!?`` and line breaks cut a text into pieces and blanks those
    into words. A null text is empty, a null language ``und``; repeated rows count each time.
    ``a`` is the phrase's count, of at least ``least``; of its cuts the one with the lowest
    score counts, the earlier one if equal, and gives ``l`` and ``r``. A pair is left out if
    a triple around it has ``cover`` percent of its count or more. ``top`` rows of each
    language by score, count and phrase, or all of them for None. No rows for an empty table.
    """
    made = graph(docs, text, lang, least)
    compacted = paths(made)
    word = made.where("kind = 'word'").select("lang", F.col("first").alias("word"), F.col("c").alias("times"))
    pair = made.where("kind = 'pair'").select("lang", F.col("first").alias("phrase"), F.col("c").alias("a"))
    total = made.where("kind = 'total'").select("lang", F.col("c").alias("n"))

    # Inside a path both pairs of a triple have its count; at the ends they have their nodes' flow.
    triple = compacted.select(
        "lang", F.concat_ws(" ", "source", "next").alias("phrase"), F.col("c").alias("a"),
        F.when(F.col("place") == 0, F.col("source_c")).otherwise(F.col("c")).alias("front"),
        F.when(F.col("last"), F.col("target_c")).otherwise(F.col("c")).alias("back"),
        F.substring_index("source", " ", 1).alias("w1"), F.col("next").alias("w3"),
    )
    one = word.withColumnsRenamed({"word": "w1", "times": "f1"})
    last = word.withColumnsRenamed({"word": "w3", "times": "f3"})
    triple = triple.join(one, ["lang", "w1"]).join(last, ["lang", "w3"])
    s1, s2 = _score(F.col("a"), F.col("f1"), F.col("back")), _score(F.col("a"), F.col("front"), F.col("f3"))
    triple = triple.withColumns({"s1": s1, "s2": s2})
    early = F.col("s1") <= F.col("s2")
    triple = triple.select(
        "lang", "phrase", "a", F.when(early, F.col("f1")).otherwise(F.col("front")).alias("l"),
        F.when(early, F.col("back")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"),
    )
    # A pair inside a path goes with its path; one at an end goes if an edge there covers it.
    covered = lambda flow: 100 * F.col("c") >= cover * F.col(flow)
    gone = compacted.where((F.col("place") > 0) | covered("source_c")).select("lang", F.col("source").alias("phrase"))
    gone = gone.unionByName(compacted.where(~F.col("last") | covered("target_c")).select("lang", F.col("target").alias("phrase")))
    bigram = pair.join(gone, ["lang", "phrase"], "left_anti")
    bigram = bigram.withColumns({"w1": F.substring_index("phrase", " ", 1), "w3": F.substring_index("phrase", " ", -1)})
    bigram = bigram.join(one, ["lang", "w1"]).join(last, ["lang", "w3"])
    bigram = bigram.select("lang", "phrase", "a", F.col("f1").alias("l"), F.col("f3").alias("r"), _score(F.col("a"), F.col("f1"), F.col("f3")).alias("score"))

    found = triple.unionByName(bigram)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        # The first rows of a language are among the first of each list: a fixed number reaches one task.
        found = found.withColumn("list", F.pmod(F.hash("phrase"), F.lit(RANK_LISTS)))
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "list").orderBy(*order))).where(F.col("rank") <= top)
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
        found = found.join(total, "lang")
        return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return found.join(total, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")
