"""SimHash near-duplicates: a positional byte index with count filtering.

Two fingerprints of 64 bits that differ in at most three bits differ in at most three of
their eight bytes, so at least five bytes agree by position. Posting lists on single bytes
would each hold a 1/256 of all rows. Lists are therefore kept for the fourteen sets of four
positions whose numbers have exclusive-or zero: of these exactly one lies inside any five
positions, so a pair with the guaranteed five shared bytes meets in at least one list and
a pair with fewer in none or few. Pairs are tallied, kept from five shared bytes on, and verified on all bits.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bayworks.llm.common import fresh
from bayworks.llm.components import components
from bayworks.session import settle_table

SEED = 42
SHINGLE = 3
MAX_BITS = 3
LISTS = [s for s in combinations(range(8), 4) if s[0] ^ s[1] ^ s[2] ^ s[3] == 0]
#: Lists up to this length are compared pair by pair, longer ones by looking up every
#: pattern within the distance; both find the same links.
PAIRWISE = 1024


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the lower-cased (A-Z) word shingles of a whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, SEED) for g in grams], dtype="<u8")
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


@F.arrow_udf(T.LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint(t.as_py()) for t in texts], pa.int64())


def _byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(255)


def _packed(fp: Column, positions: tuple[int, ...], number: int) -> Column:
    key = F.lit(number).cast("long")
    for i in positions:
        key = key * 256 + _byte(fp, i)
    return key


def _postings(prints: DataFrame) -> DataFrame:
    keys = F.array(*(_packed(F.col("fp"), s, n) for n, s in enumerate(LISTS)))
    return prints.select(F.explode(keys).alias("key"), "fp")


def _shared_bytes(a: Column, b: Column) -> Column:
    return sum(((_byte(a, i) == _byte(b, i)).cast("int") for i in range(8)), F.lit(0))


def _masks(free: list[int]) -> np.ndarray:
    bits = [8 * i + k for i in free for k in range(8)]
    out = [sum(1 << b for b in c) for n in range(1, MAX_BITS + 1) for c in combinations(bits, n)]
    return np.array(out, dtype=np.uint64)


def _settle_labels(label: np.ndarray) -> np.ndarray:
    while not np.array_equal(label, up := label[label]):
        label = up
    return label


def _roots_by_pair(v: np.ndarray) -> np.ndarray:
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= MAX_BITS
    a, b = np.nonzero(near)
    label = np.arange(len(v))
    while True:
        before = label.copy()
        np.minimum.at(label, a, before[b])
        label = _settle_labels(label)
        if np.array_equal(before, label):
            return label


def _roots_by_pattern(v: np.ndarray) -> np.ndarray:
    """``v`` is sorted and differs in at most three bytes, so it has at most 2**24 values."""
    spread = int(np.bitwise_or.reduce(v) ^ np.bitwise_and.reduce(v))
    masks = _masks([i for i in range(8) if spread >> (8 * i) & 255])
    label = np.arange(len(v))
    while True:
        before = label.copy()
        for m in masks:
            at = np.searchsorted(v, v ^ m)
            at[at == len(v)] = 0
            hit = np.nonzero(v[at] == v ^ m)[0]
            np.minimum.at(label, hit, label[at[hit]])
        label = _settle_labels(label)
        if np.array_equal(before, label):
            return label


def local_links(values: list[int]) -> list[tuple[int, int]]:
    """Links (value, root) that join what is linked within one posting list, at most one a value."""
    v = np.unique(np.array(values, dtype=np.int64).view(np.uint64))
    root = _roots_by_pair(v) if len(v) <= PAIRWISE else _roots_by_pattern(v)
    moved = np.nonzero(root != np.arange(len(v)))[0]
    return list(zip(v[moved].view(np.int64).tolist(), v[root[moved]].view(np.int64).tolist()))


@F.arrow_udf(T.ArrayType(T.StructType().add("a", T.LongType()).add("b", T.LongType())))
def _list_links(lists: pa.Array) -> pa.Array:
    out = [[{"a": a, "b": b} for a, b in local_links(x.as_py())] for x in lists]
    return pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links that join all fingerprints of ``prints`` (distinct, column ``fp``) that
    differ in at most three bits, directly or by way of others. Redundant links are left out.

    A list of two is one candidate pair. A list of three or more is cut by each of the four
    remaining positions: five agreeing bytes include its four and one more. What remains has
    three free bytes, so a list holds at most 2**24 fingerprints whatever the input.
    """
    posted = _postings(prints)
    sizes = posted.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    sizes = settle_table(sizes.where("n > 1"))
    a, b = F.col("a"), F.col("b")
    pairs = sizes.where("n = 2").where(_shared_bytes(a, b) >= 8 - MAX_BITS)
    pairs = pairs.where(F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS).select("a", "b")
    crowded = sizes.where("n > 2").select("key")
    number = F.shiftright("key", 32)
    cut = F.array(*(number * 8 + i for i in range(8)))
    free = F.lit(None)
    for n, s in enumerate(LISTS):
        rest = F.array(*(F.lit(i) for i in range(8) if i not in s))
        free = F.when(number == n, rest) if n == 0 else free.when(number == n, rest)
    fifth = F.transform(free, lambda i: F.struct(i.alias("at"), F.lit(0).alias("_")))
    members = posted.join(crowded, "key").select("key", "fp", F.explode(fifth).alias("i"))
    value = F.expr("shiftrightunsigned(fp, 8 * i.at) & 255")
    members = members.select("key", F.col("i.at").alias("at"), value.alias("value"), "fp")
    grouped = members.groupBy("key", "at", "value").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    found = grouped.select(F.explode(_list_links("fps")).alias("l")).select("l.a", "l.b")
    return pairs.unionByName(found)


def classes(prints: DataFrame) -> DataFrame:
    """(fp, root) for the fingerprints that link with another one."""
    found = components(links(prints))
    return found.select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of ``docs``.

    Texts without words (null, empty, blank) have fingerprint zero and link with each other.
    Equal fingerprints are one node, so copies cost one posting. component_id is the smallest
    id of the component; ids that are null do not count, and a component of nothing else has
    a null id. Repeated rows stay repeated.
    """
    rows = settle_table(docs.select(F.col(doc_id).alias("doc_id"), _fingerprints(text).alias("fp")))
    prints = settle_table(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = settle_table(classes(prints.select("fp")))
    member = prints.join(found, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    member = settle_table(member.join(least, "root").select("fp", "component_id"))
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(member, "fp").select("doc_id", shown, "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` with one row of each near-duplicate component, all columns kept.

    The row with the smallest id stays; rows without an id come last, equal ids are settled
    by position. Rows are numbered when they are stored, so the choice survives a rerun.
    """
    fp, row = fresh(docs, "fp"), fresh(docs, "row_number")
    held = settle_table(docs.withColumns({fp: _fingerprints(text), row: F.monotonically_increasing_id()}))
    narrow = held.select(F.col(fp).alias("fp"), F.col(row).alias("row"), F.col(doc_id).alias("id"))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    prints = settle_table(narrow.groupBy("fp").agg(F.min(rank).alias("first")))
    found = classes(prints.select("fp"))
    member = prints.join(found, "fp", "left").select(F.coalesce("root", "fp").alias("root"), "first")
    stay = settle_table(member.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row)))
    # One row for each component: as large as the input allows, so never a side to broadcast.
    return held.join(stay.hint("merge"), row, "left_semi").drop(fp, row)
