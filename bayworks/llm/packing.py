"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Whatever the corpus, there are at most ``capacity`` different piece lengths. How many pieces
of each length there are is the whole packing problem, so the plan is made on that histogram:
sets of up to three lengths that dominate every other way of filling a sequence are fixed
for as many sequences as the counts allow, and the shrunken rest is packed best-fit. Pieces
then look up their places by their rank among the pieces of their length.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from bisect import bisect_right
from dataclasses import dataclass
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bayworks.session import settle_table

CAPACITY = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
#: Words whose ids a worker remembers.
REMEMBERED = 200_000
#: A text with a longer run of white space goes to the file's own tokenizer: tiktoken's pattern engine ends on very long ones.
LONG_RUN = 100_000
#: A plain blank after any character that the pattern takes for white space.
BLANK_PAIRS = [
    chr(c) + " " for c in (32, *range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# ---- ids ----------------------------------------------------------------------


class Segments(dict):
    """Ids of a blank and the word after it, as packed unsigned 32-bit integers.

    The vocabulary is that of the tokenizers file. Where its merges come in the order of
    their ids, which is checked, the same ids come from ranks; otherwise from the file's
    own tokenizer. Words are remembered up to a bound. With ``added_tokens`` the file's added
    tokens are found in a text, as its tokenizer does by default; without, they are plain text.
    """

    def __init__(self, path: str, added_tokens: bool = False):
        super().__init__()
        self._path, self._tokenizer, self._added = path, None, None
        if added_tokens:
            with open(path, encoding="utf-8") as f:
                found = [t["content"] for t in json.load(f).get("added_tokens", [])]
            self._added = re.compile("|".join(map(re.escape, found))) if found else None
        self._by_default = added_tokens
        ranks = _ranks(path)
        if ranks is None:
            self._ids = self._own_ids
        else:
            import public_tokenizers
            import tiktoken

            quick = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self._ids = quick.encode_ordinary

    def _own_ids(self, text: str) -> list[int]:
        """Ids by the file's own tokenizer, which is loaded when first needed."""
        if self._tokenizer is None:
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self._path)
            self._tokenizer.encode_special_tokens = not self._by_default
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def packed(self, text: str) -> bytes:
        return np.array(self._ids(text), "<u4").tobytes()

    def whole(self, text: str) -> bytes | None:
        """Ids of a text that only the file's own tokenizer takes as it should, else None."""
        if (self._added and self._added.search(text)) or has_long_run(text):
            return np.array(self._own_ids(text), "<u4").tobytes()
        return None

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        packed = self.packed(" " + word)
        if len(word) <= 32:
            self[word] = packed
        return packed


def has_long_run(text: str) -> bool:
    """Whether more than ``LONG_RUN`` characters of white space follow each other."""
    return len(text) > LONG_RUN and any(m.end() - m.start() > LONG_RUN for m in re.finditer(r"\s+", text))


def known_segments(path: str) -> Segments:
    """The words this Python process knows already; a worker keeps them from task to task."""
    held = sys.modules.setdefault("bayworks_known_segments", ModuleType("bayworks_known_segments"))
    if path not in held.__dict__:
        held.__dict__[path] = Segments(path, added_tokens=True)
    return held.__dict__[path]


def _ranks(path: str) -> dict[bytes, int] | None:
    """token bytes -> id when the file is byte-level BPE whose n-th merge makes the n-th id."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"].get("vocab"), spec["model"].get("merges")
    kind = spec.get("pre_tokenizer") or {}
    if spec["model"].get("type", "BPE") != "BPE" or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or spec.get("normalizer"):
        return None
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
    base = len(vocab) - len(pairs) - len([t for t in spec.get("added_tokens", []) if t["content"] in vocab])
    if any(vocab.get(a + b) != base + n for n, (a, b) in enumerate(pairs)):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(other)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    return {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in special}


def encode(text: str | None, known: Segments) -> bytes:
    """Ids of a whole text (null: empty) with the end id, packed as unsigned 32-bit integers.

    No pre-token crosses from a visible character to a plain blank, so such a text falls
    into words. A text with a blank after another one, of whatever kind, is encoded whole, as a run of
    blanks is cut only by what follows it. A text with an added token or a very long run of
    white space goes to the file's own tokenizer.
    """
    if not text:
        body = b""
    elif (own := known.whole(text)) is not None:
        body = own
    elif any(pair in text for pair in BLANK_PAIRS):
        body = known.packed(text)
    else:
        first, *words = text.split(" ")
        body = known.packed(first) + b"".join(map(known.__getitem__, words))
    return body + END_ID.to_bytes(4, "little")


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: full ones, the first takes the rest."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, chunk and rank.

    ``chunk`` is the task that made the row and ``rank`` its number among that task's pieces
    of the same length. Store the result before using them: a rerun keeps one task's rows
    together. ``with_ids`` adds the ids themselves.
    """
    path = path or vocabulary_path()
    id_type = docs.schema[doc_id].dataType
    schema = f"doc_id {id_type.simpleString()}, piece int, start long, length long, ids_crc32 long, chunk int, rank long"
    schema += ", ids array<int>" if with_ids else ""

    def make(batches):
        known, counts = known_segments(path), [0] * (capacity + 1)
        chunk = TaskContext.get().partitionId()
        for batch in batches:
            owner, rows = [], []
            for at, t in enumerate(batch.column(1)):
                ids = encode(t.as_py(), known)
                for number, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    owner.append(at)
                    row = (number, start, length, zlib.crc32(part), chunk, counts[length])
                    rows.append((*row, np.frombuffer(part, "<i4")) if with_ids else row)
                    counts[length] += 1
            if not rows:
                continue
            columns = list(zip(*rows))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "rank", "ids"]
            arrays = [batch.column(0).take(pa.array(owner)), *(pa.array(c, k) for c, k in zip(columns, kinds))]
            yield pa.RecordBatch.from_arrays(arrays, names[: len(arrays)])

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(make, schema)


# ---- the plan -----------------------------------------------------------------


@dataclass(frozen=True)
class Bin:
    """``times`` sequences filled alike: ``parts`` lists (length, how many of it) in order."""

    parts: tuple[tuple[int, int], ...]
    times: int


def _largest(present: list[int], most: int) -> int:
    """The largest present length up to ``most``, or 0; ``present`` is ascending."""
    at = bisect_right(present, most)
    return present[at - 1] if at else 0


def _dominating(j: int, counts: dict[int, int], present: list[int], capacity: int) -> tuple[int, ...] | None:
    """Companions of ``j``, the largest length, in a set that dominates all sets holding ``j``.

    A set dominates another if the other's members can be dealt out among its members
    without exceeding any of them. ``present`` holds the lengths that go with ``j``.
    """
    room = capacity - j
    best = _largest(present, room)
    if not best:
        return ()  # nothing fits beside it
    two = 2 * present[0] if counts[present[0]] > 1 else sum(present[:2]) if len(present) > 1 else room + 1
    if best == room or two > room:
        return (best,)  # fills the rest, or is the most that fits and no two others fit
    top = 0  # the most that two companions fill
    for x in reversed(present):
        if x > room:
            continue
        y = _largest(present, min(x, room - x))
        if y == x and counts[x] < 2:
            y = _largest(present, x - 1)
        top = max(top, x + y if y else x)
    three = 3 * present[0]
    if three <= room:
        return None
    if top <= best:
        return (best,)
    second = _largest(present, min(best, room - best))
    if second == best and counts[best] < 2:
        second = _largest(present, best - 1)
    if not second:
        return None
    for x in present:
        if x > best:
            break
        y = _largest(present, min(x, room - x))
        if y > second and x + y > best:
            return None
    return (best, second)


def reduce(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Bin], dict[int, int]]:
    """Sequences fixed for good by dominance, and the lengths that remain.

    Each step takes the largest length. With the same lengths at hand the argument holds for
    the next sequence too, so one step fixes as many as the counts allow; a step uses up a
    length, and steps are no more than lengths.
    """
    left, fixed = {k: v for k, v in counts.items() if v}, []
    rest: dict[int, int] = {}
    while left:
        j = max(left)
        beside = dict(left)
        beside[j] -= 1
        beside = {k: v for k, v in beside.items() if v and k <= capacity - j}
        found = _dominating(j, beside, sorted(beside), capacity)
        if found is None:
            rest[j] = left.pop(j)
            continue
        if any(j + k <= capacity for k in rest):
            # A larger length that was left over fits beside it: sets with that one were not weighed.
            rest[j] = left.pop(j)
            continue
        need: dict[int, int] = {}
        for k in (j, *found):
            need[k] = need.get(k, 0) + 1
        times = min(left[k] // n for k, n in need.items())
        fixed.append(Bin(tuple(sorted(need.items(), reverse=True)), times))
        for k, n in need.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return fixed, rest


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[Bin]:
    """Best-fit decreasing on lengths with counts: each piece goes where least room remains.

    Sequences filled alike are handled together; a step empties a length or a kind of
    sequence, so the work is bounded by the number of lengths, not of pieces.
    """
    open_bins: dict[int, list[list]] = {}  # room -> [[parts, times]]
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = min((r for r in open_bins if r >= size), default=None)
            if room is None:
                parts, times, room = (), left, capacity
            else:
                parts, times = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
            each = room // size
            full = min(times, left // each)
            if full:
                open_bins.setdefault(room - each * size, []).append([(*parts, (size, each)), full])
            left -= full * each
            times -= full
            if left and times:  # fewer than one sequence takes
                open_bins.setdefault(room - left * size, []).append([(*parts, (size, left)), 1])
                left, times = 0, times - 1
            if times and parts:
                open_bins.setdefault(room, []).append([parts, times])
    return [Bin(parts, times) for kinds in open_bins.values() for parts, times in kinds]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Bin]:
    fixed, rest = reduce(counts, capacity)
    return fixed + best_fit(rest, capacity)


def lookup(bins: list[Bin]) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> (first rank, pieces a sequence, first sequence, offset), by ascending rank."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for b in bins:
        offset = 0
        for length, each in b.parts:
            rank = used.get(length, 0)
            rows.setdefault(length, []).append((rank, each, sequence, offset))
            used[length] = rank + each * b.times
            offset += length * each
        sequence += b.times
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in rows.items()}


# ---- packing ------------------------------------------------------------------


def place(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to stored ``pieces``.

    The histogram and the plan have at most a few rows for each length, at most ``capacity``
    of them, whatever the input. A piece's rank in its length is its rank in its chunk plus
    the counts of the chunks before: one row for each chunk and length is summed, no length
    is gathered in one task.
    """
    sizes = settle_table(made.groupBy("chunk", "length").agg(F.count("*").alias("n")))
    counts = {int(r["length"]): int(r["n"]) for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = lookup(plan(counts, capacity))
    earlier = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("chunk", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = made.join(settle_table(before), ["chunk", "length"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before")).drop("before", "chunk")

    def answer(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        length, rank = (np.asarray(x, dtype=np.int64) for x in (lengths, ranks))
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for size in np.unique(length):
            rows = np.nonzero(length == size)[0]
            first, each, base, start = table[int(size)]
            at = np.searchsorted(first, rank[rows], "right") - 1
            passed = rank[rows] - first[at]
            sequence[rows] = base[at] + passed // each[at]
            offset[rows] = start[at] + passed % each[at] * size
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    call = F.arrow_udf(answer, "struct<sequence_id:long,offset:long>").asNondeterministic()
    return ranked.withColumn("place", call("length", "rank")).select("*", "place.*").drop("place", "rank")


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place: sequence_id and a gapless offset.

    A null or empty text is the end id alone, a document of one id. Repeated rows are packed
    each by itself, null ids stay null. An empty table gives no rows.
    """
    return place(settle_table(pieces(docs, text, doc_id, path, capacity, with_ids)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids, documents): the training sequences of ``pack(..., with_ids=True)``.

    A sequence holds at most ``capacity`` ids, so its group is bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    ids = F.flatten(F.col("parts.ids"))
    return rows.select("sequence_id", F.size(ids).alias("length"), ids.alias("ids"), F.col("parts.doc_id").alias("documents"))
