"""SentencePiece encoding and decoding by a streaming Viterbi search.

The best segmentation is the one with the highest sum of piece scores. The search keeps a
window no longer than the longest piece; whenever the backpointers of all ends still in
reach run through one boundary, everything before it is final and is given out.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bayworks.llm.common import fresh

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: A character without a piece costs this much more than the worst piece.
UNKNOWN_COST = 10.0
#: Words whose ids a worker remembers, and the longest such word; two windows at most.
REMEMBERED, LONGEST_WORD = 300_000, 32


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Words(dict):
    """Packed ids of words, worked out when first asked for; short words are remembered up to a bound."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self._pieces = pieces

    def __missing__(self, word: str) -> bytes:
        if len(word) > LONGEST_WORD:
            return np.fromiter(self._pieces.stream(word), "<u4").tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = packed = array("I", self._pieces.short(word)).tobytes()
        return packed


class Pieces:
    """Pieces and scores of a model file, and the search over them.

    Ties between segmentations go to the one whose last piece is longer.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes: list[int] = [model.unk_id()] * 256
        self.text: list[bytes] = [b""] * self.size
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece], self.score[piece] = i, model.get_score(i)
                self.text[i] = piece.replace(SPACE, " ").encode()
        self.longest = max(map(len, self.ids), default=1)
        self.unknown = min(self.score.values(), default=0.0) - UNKNOWN_COST
        self.prefixes = {p[:n] for p in self.ids for n in range(1, len(p) + 1)}
        self.tree: dict = {}  # of the pieces' characters; "" holds (score, id)
        for p, i in self.ids.items():
            node = self.tree
            for c in p:
                node = node.setdefault(c, {})
            node[""] = (self.score[p], i)
        self.words = self._cuts()
        self.known = Words(self)

    def _cuts(self):
        """A pattern of words that ends at boundaries which no piece crosses, so all paths meet there.

        Those are before a blank after another character, around a character that is in no
        longer piece, and, where the vocabulary has it so, between a letter and a sign.
        """
        longer = [p for p in self.ids if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in longer):
            return None
        stop = "".join(sorted({"\n", "\t"} - {c for p in longer for c in p}))
        tail = f"|{SPACE}+" + (f"|[{stop}]" if stop else "")
        if any(a.isalpha() and not b.isalpha() for p in longer for a, b in zip(p, p[1:])):
            return re.compile(f"{SPACE}*[^{SPACE}{stop}]+" + tail)
        sign = f"(?:[^\\w{SPACE}{stop}]|[\\d_])"
        return re.compile(f"{SPACE}*{sign}*[^\\W\\d_]+|{SPACE}*{sign}+" + tail)

    def stream(self, text: str):
        """Ids of ``text`` in order, given out as soon as they are final.

        Every boundary hands its score on to the ends of the pieces that begin there; a
        beginning that no piece has ends the attempt.
        """
        score, prefixes, n = self.score, self.prefixes, len(text)
        none = -np.inf
        best, back, base = [0.0], [0], 0  # of the boundaries from ``base`` on
        for start in range(n):
            here, at = best[start - base], start - base
            for end in range(start + 1, min(start + self.longest, n) + 1):
                piece = text[start:end]
                s = score.get(piece)
                if end - start == 1:
                    s = self.unknown if s is None else s
                    if len(best) == at + 1:
                        best.append(none)
                        back.append(start)
                elif piece not in prefixes:
                    break
                elif end - base >= len(best):
                    best.append(none)
                    back.append(start)
                if s is not None and here + s > best[end - base]:
                    best[end - base] = here + s
                    back[end - base] = start
                if end - start == 1 and piece not in prefixes:
                    break
            done = start + 1
            if done - base >= 2 * self.longest or done == n:
                meet = n if done == n else self._meeting(back, base, done, base + len(back) - 1)
                if meet > base:
                    yield from self._ids(text, back, base, meet)
                    cut = meet - base
                    best, back, base = [b - best[cut] for b in best[cut:]], back[cut:], meet

    def short(self, word: str) -> list[int]:
        """Ids of a word that fits the window, so that its end is the boundary where paths meet.

        The same search as ``stream``, walking the tree of pieces instead of cutting strings.
        """
        n = len(word)
        best, back, which = [0.0] + [-np.inf] * n, [0] * (n + 1), [-1] * (n + 1)
        for start in range(n):
            here, node, end = best[start], self.tree, start
            if word[start] not in self.score and here + self.unknown > best[start + 1]:
                best[start + 1], back[start + 1], which[start + 1] = here + self.unknown, start, -1
            for c in word[start : start + self.longest]:
                node = node.get(c)
                if node is None:
                    break
                end += 1
                found = node.get("")
                if found is not None and here + found[0] > best[end]:
                    best[end], back[end], which[end] = here + found[0], start, found[1]
        out: list[int] = []
        end = n
        while end:
            start = back[end]
            if which[end] >= 0:
                out.append(which[end])
            else:
                out += [self.bytes[b] for b in reversed(word[start:end].encode("utf-8", "surrogatepass"))]
            end = start
        return out[::-1]

    def _meeting(self, back: list[int], base: int, done: int, last: int) -> int:
        """The last boundary that every path to an end in reach of the search runs through.

        ``done`` is final; the ends after it, up to ``last``, may still change their
        backpointers, but only to boundaries from ``done`` on.
        """
        live = {done} | {back[e - base] for e in range(done + 1, last + 1)}
        while len(live) > 1:
            top = max(live)
            live.remove(top)
            live.add(back[top - base])
        return live.pop()

    def _ids(self, text: str, back: list[int], base: int, end: int) -> list[int]:
        out: list[int] = []
        while end > base:
            start = back[end - base]
            piece = text[start:end]
            found = self.ids.get(piece)
            out += [found] if found is not None else [self.bytes[b] for b in reversed(piece.encode("utf-8", "surrogatepass"))]
            end = start
        return out[::-1]

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as packed unsigned 32-bit integers; null and empty texts have none."""
        if not text:
            return b""
        marked = SPACE + text.replace(" ", SPACE)
        if self.words is None:
            return np.fromiter(self.stream(marked), "<u4").tobytes()
        out = bytearray()
        for word in self.words.finditer(marked):
            out += self.known[word[0]]
        return bytes(out)

    def decode(self, packed: bytes) -> str:
        """The text of packed ids, without the blank that encoding put in front."""
        raw = b"".join(map(self.text.__getitem__, np.frombuffer(packed, "<u4").tolist()))
        return raw.decode("utf-8", "replace").removeprefix(" ")


def known_pieces(path: str) -> Pieces:
    """The pieces this Python process has loaded already; a worker keeps them from task to task."""
    held = sys.modules.setdefault("bayworks_known_pieces", ModuleType("bayworks_known_pieces"))
    if path not in held.__dict__:
        held.__dict__[path] = Pieces(path)
    return held.__dict__[path]


def encode(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with one more column ``piece_ids``; null and empty texts have an empty list."""
    path = path or model_path()

    def answer(texts: pa.Array) -> pa.Array:
        pieces = known_pieces(path)
        return pa.array([np.frombuffer(pieces.encode(t.as_py()), "<i4") for t in texts], pa.list_(pa.int32()))

    return docs.withColumn(fresh(docs, "piece_ids"), F.arrow_udf(answer, "array<int>").asNondeterministic()(text))


def decode(rows: DataFrame, ids: str = "piece_ids", path: str | None = None) -> DataFrame:
    """``rows`` with one more column ``decoded``: the text of the ids.

    Null for null ids, and for a list that holds a null or a number that is no id of the model.
    """
    path = path or model_path()

    def answer(lists: pa.Array) -> pa.Array:
        pieces = known_pieces(path)
        size, out = len(pieces.text), []
        for ids in (x.as_py() for x in lists):
            known = ids is not None and all(i is not None and 0 <= i < size for i in ids)
            out.append(pieces.decode(np.array(ids, "<u4").tobytes()) if known else None)
        return pa.array(out, pa.string())

    return rows.withColumn(fresh(rows, "decoded"), F.arrow_udf(answer, "string").asNondeterministic()(ids))


def digest(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ``pieces``: how many ids, their crc32, and whether they decode to the text.

    The long lists stay in the task. A SPACE sign in a text decodes to a plain blank, so such
    a text does not come back as it was; a null text has no ids and comes back as empty.
    """
    path = path or model_path()
    kind = pa.struct([("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())])

    def answer(texts: pa.Array) -> pa.Array:
        pieces, out = known_pieces(path), []
        for t in texts:
            packed = pieces.encode(text := t.as_py())
            out.append({"n_ids": len(packed) // 4, "ids_crc32": zlib.crc32(packed), "round_trip": pieces.decode(packed) == (text or "")})
        return pa.array(out, kind)

    call = F.arrow_udf(answer, "struct<n_ids:long,ids_crc32:long,round_trip:boolean>").asNondeterministic()
    return docs.withColumn(fresh(docs, "pieces"), call(text))
