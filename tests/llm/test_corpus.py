"""Phrases, Merkle proofs and line deduplication against brute force, with odd rows."""

from __future__ import annotations

import random
import re
import time
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from bayworks.llm import collocations, line_dedup, merkle, queries

FOLDER = "/root/testdata/sf0.001"
LINE = "A line that more than enough documents have in common"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, f"{LINE}\nown words, of one text! and more of one text", "en", "a.org", 9),
    (1, f"{LINE}\nown words, of one text! and more of one text", "en", "a.org", 9),
    (2, f"  {LINE.upper()}\r\n\n\nÄußerst LANGE Zeile mit Umlauten und sonst noch allerlei Wörtern", "en", None, None),
    (3, None, None, None, None),
    (None, f"{LINE}\t\n{LINE}\nno id", "fr", "", 0),
    (None, f"{LINE}\nno id", None, "b.org", 7),
    (4, "", "", "b.org", 0),
    (5, "\n \n", "de", "b.org", 3),
    (7, f"{LINE}\n{LINE}\nlargest id keeps its lines", "de", "b.org", 1),
    (6, f"äußerst LANGE Zeile mit Umlauten und sonst noch allerlei Wörtern\n{LINE}", "de\t", "b.org", 2),
    (None, None, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    clash = ("id", "gone", "lines", "t1", "at", "part", "index", "row", "tree", "node", "h1", "keeper", "first", "n")
    return df.withColumns({c: F.lit(f"own {c}") for c in clash})


# ---- phrases --------------------------------------------------------------------
def slow_phrases(rows, least=10, cover=50, top=2000):
    count, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total["und" if lang is None else lang] += len(w)
            for k in (1, 2, 3):
                count["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            cuts = [(1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            longer = [b for q, b in f.items() if len(q) == len(p) + 1 == 3 and b >= least and p in (q[:-1], q[1:])]
            if not any(100 * b >= cover * a for b in longer):
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["New", "york", "city", "of", "the", "a", "é", "Éa", "x1", "\x1c", "kilo", "watt", "hour"]
    fixed = ["New York City Hall of fame", "the quick brown fox jumps over it", "of the", "no"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else " ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(rng.randint(0, 6))]
        rows.append((rng.choice([".", "\n", "\x0b", "; ", " \t", "!?"]).join(parts), rng.choice(["en", "en", "d\te", None, "und"])))
    return rows


@pytest.mark.parametrize("held", [4_000_000, 40])
def test_phrases_equal_brute_force(spark, monkeypatch, held):
    """Also with salted hot pairs and with sums handed on often."""
    rows = texts(5, 400) + [(None, "en"), ("", None), ("of the of the of the " * 300, "en"), ("one " * 50, "de")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    if held < 100:
        monkeypatch.setattr(collocations, "LEAST_PARTS", 400)
        monkeypatch.setattr(collocations, "MOST_PARTS", 400)
        monkeypatch.setattr(collocations, "SAMPLED", 1)
        assert collocations.hot_nodes(df, "text", "lang")
        # Tasks import nothing: the limit travels with the function.
        monkeypatch.setattr(collocations, "HELD_WORDS", held)
    got = sorted(tuple(r) for r in collocations.phrases(df).collect())
    assert got == slow_phrases(rows) and len(got) > 30
    few = sorted(tuple(r) for r in collocations.phrases(df, top=3).collect())
    assert few == slow_phrases(rows, top=3)


def test_phrases_of_odd_rows(odd):
    rows = [(r[1], r[2]) for r in ODD]
    got = sorted(tuple(r) for r in collocations.phrases(odd, least=2).collect())
    assert got == slow_phrases(rows, least=2) and got
    assert collocations.phrases(odd.where("false")).count() == 0


def test_paths_are_compacted(spark):
    rows = [("a b c d e f g h", "en")] * 12 + [("x c d e y", "en")] * 11 + [("h a b", "en")] * 10
    made = collocations.graph(spark.createDataFrame(rows, "text string, lang string"))
    compacted = collocations.paths(made)
    found = {(r["words"], r["c"]) for r in collocations.passages(compacted).collect()}
    # c d and d e carry more than what enters, b c is left by one edge but pieces end at a b.
    assert found == {("a b c d", 12), ("c d e", 23), ("d e f g h", 12), ("x c d", 11), ("d e y", 11), ("h a b", 10)}


def test_phrases_of_a_long_text(spark):
    rng = random.Random(3)
    one = " ".join(f"w{rng.randint(0, 30000)}" for _ in range(1_500_000))
    df = spark.createDataFrame([(one, "en")], "text string, lang string")
    start = time.time()
    made = collocations.graph(df)
    assert made.where("kind = 'total'").first()["c"] == 1_500_000
    assert time.time() - start < 60


# ---- proofs -----------------------------------------------------------------------
def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def slow_levels(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def slow_path(levels, i):
    out = []
    for level in levels[:-1]:
        pair = level[i // 2 * 2 : i // 2 * 2 + 2]
        out.append((pair, i % 2))
        i //= 2
    return out


def slow_manifest(rows):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""

    def leaf(r, n_chars):
        values = [r[0], r[3], r[2], n_chars, r[1]]
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    trees = defaultdict(list)
    for r in rows:
        bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
        trees[r[2]].append((r[0] is not None, r[0], leaf(r, r[4]), leaf(r, r[4] + 1 if bad else r[4])))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {k: slow_levels([x[2] for x in sorted(trees[k], key=lambda x: (x[0], x[1] or 0, x[2]))]) for k in langs}
    top = slow_levels([built[k][-1][0] for k in langs])
    out = []
    for t, k in enumerate(langs):
        for i, (_, doc, own, came) in enumerate(sorted(trees[k], key=lambda x: (x[0], x[1] or 0, x[2]))):
            proof, now = [], came
            for pair, at in slow_path(built[k], i) + slow_path(top, t):
                proof += [x for j, x in enumerate(pair) if j != at]
                now = h(*(now if j == at else x for j, x in enumerate(pair)))
            out.append((doc, own, built[k][-1][0], top[-1][0], h(*proof), now, now == top[-1][0]))
    return sorted(out, key=str)


def test_multiproofs_on_any_set_of_leaves():
    rng = random.Random(4)
    for n in [1, 2, 3, 5, 8, 13, 64, 100]:
        levels = slow_levels([h(str(i)) for i in range(n)])
        for _ in range(20):
            own = rng.sample(range(n), rng.randint(1, n))
            asked = merkle.missing(own, n)
            fetched = {(lv, i): levels[lv][i] for lv, i in asked}
            known = merkle.derive({i: levels[0][i] for i in own}, fetched, n)
            assert known[merkle.height(n), 0] == levels[-1][0]
            assert all(levels[lv][i] == x for (lv, i), x in known.items())
            for i in own:
                assert merkle.fold(levels[0][i], merkle.siblings(i, known, n)) == levels[-1][0]
            for node in asked:  # none is spare: without it the root cannot be derived
                with pytest.raises(KeyError):
                    merkle.derive({i: levels[0][i] for i in own}, {k: v for k, v in fetched.items() if k != node}, n)


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_manifest_equals_brute_force(spark, monkeypatch, bits):
    rng = random.Random(6)
    rows = [(i, f"text {i}", rng.choice(["en"] * 6 + ["de", "fr", "Ä", "z"]), "s", i) for i in range(150)] + ODD
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    monkeypatch.setattr(merkle.manifest, "__defaults__", (None, bits))
    monkeypatch.setattr(queries, "table", lambda *_: df)
    got = sorted((tuple(r) for r in queries.op12_merkle_manifest(spark, "").collect()), key=str)
    assert got == slow_manifest(rows)
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_odd_rows(spark, odd, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *_: odd)
    got = sorted((tuple(r) for r in queries.op12_merkle_manifest(spark, "").collect()), key=str)
    assert got == slow_manifest(ODD)
    one = merkle.manifest(odd.where("doc_id = 2"), ["doc_id"], "lang", "doc_id").first()
    assert one["leaf"] == one["subroot"] == one["root"] == h("1:2") and one["proof"] == [] and one["verified"]
    assert merkle.manifest(odd.where("false"), ["doc_id"], "lang", "doc_id").count() == 0


def test_numbers_of_a_hot_group(spark):
    rows = spark.range(5000).select((F.col("id") % 3 == 0).cast("int").alias("g"), F.lit(7).alias("k"), "id")
    got = merkle.numbered(rows, ["g"], ["k", "id"]).orderBy("g", "id").collect()
    want = [(g, 7, i, n) for g in (0, 1) for n, i in enumerate(i for i in range(5000) if (i % 3 == 0) == bool(g))]
    assert [(r["g"], r["k"], r["id"], r["index"]) for r in got] == want


# ---- lines ------------------------------------------------------------------------
def slow_lines(rows, min_chars=40, min_docs=5):
    """(doc_id, n_lines, n_dropped, kept_sha256); rows without an id are one document before all others."""
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            holders[key(line)].add((r[0] is not None, r[0] or 0))
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        stay = [x for x in lines if len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or max(holders[key(x)]) == (r[0] is not None, r[0] or 0)]
        out.append((r[0], len(lines), len(lines) - len(stay), h("\n".join(stay))))
    return sorted(out, key=str)


def test_lines_of_odd_rows(odd):
    got = sorted((tuple(r) for r in line_dedup.digest(odd).collect()), key=str)
    assert got == slow_lines(ODD) and sum(r[2] for r in got) >= 6
    whole = line_dedup.drop_shared_lines(odd)
    assert whole.columns == [*odd.columns, "lines_"] and whole.count() == len(ODD)
    assert line_dedup.digest(odd.where("false")).count() == 0


def test_lines_of_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10**6 + i, f"{LINE} and {i % 20}\nanother line\n{LINE} and {i % 20}", None) for i in range(300)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    assert sorted((tuple(r) for r in line_dedup.digest(df).collect()), key=str) == slow_lines(rows)


def test_lines_use_no_python(spark):
    plan = line_dedup.digest(spark.read.parquet(f"{FOLDER}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_lines_of_long_texts(spark):
    """Time grows with the number of lines, not with its square."""
    body = "\n".join(f"this is a line that is certainly long enough, number {i}" for i in range(100_000))
    df = spark.createDataFrame([(i, f"{body}\nown {i}") for i in range(5)], "doc_id long, text string")
    start = time.time()
    assert sorted(r["n_dropped"] for r in line_dedup.digest(df).collect()) == [0] + [100_000] * 4
    assert time.time() - start < 60
