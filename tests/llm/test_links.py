"""Vectors, URLs and tool calls against brute force, with odd rows."""

from __future__ import annotations

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from bayworks.llm import tool_calls, urls, vectors


# ---- vectors ------------------------------------------------------------------
def slow_links(rows, threshold=0.95):
    """(vec_id, n_links, component_id) by all pairs."""
    usable = []
    for _, v in rows:
        good = v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)
        usable.append(np.array(v, float) / np.linalg.norm(v) if good else None)
    n, root, links = len(rows), list(range(len(rows))), [0] * len(rows)
    for i in range(n):
        for j in range(i):
            a, b = usable[i], usable[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b >= threshold:
                links[i] += 1
                links[j] += 1
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    least = {}
    for r, (k, _) in zip(root, rows):
        if k is not None:
            least[r] = min(least.get(r, k), k)
    return [(k, m, least.get(r)) for (k, _), m, r in zip(rows, links, root)]


def test_vectors_equal_all_pairs(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 24))
    rows = []
    for i in range(260):
        v = centres[i % 6] + rng.normal(size=24) * rng.choice([0.05, 0.2, 0.6])
        rows.append((i, [float(np.float32(x)) for x in v]))
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # copies
    rows += [(3, rows[3][1]), (None, rows[4][1]), (None, None)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [float("nan")] + [1.0] * 23), (2004, [None] + [1.0] * 23)]
    rows += [(2005, [1.0]), (2006, [2.0]), (2007, [-1.0]), (2008, [float("inf")] * 24), (2009, [1.0, 0.0]), (2010, [1.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("key", F.lit("own")).withColumn("cell", F.lit(1))
    got = sorted(map(tuple, vectors.near_duplicates(df, block=32).collect()), key=str)
    want = sorted(((k, m, c, k == c) for k, m, c in slow_links(rows)), key=str)
    assert got == want
    assert vectors.near_duplicates(df.where("false")).count() == 0


def test_bounds_drop_no_pair():
    rng = np.random.default_rng(9)
    a = rng.normal(size=(200, 40))
    b = np.concatenate([a[:50] + rng.normal(size=(50, 40)) * 0.05, rng.normal(size=(100, 40))])
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    i, j = vectors.linked_pairs(a, b)
    assert set(zip(i, j)) == set(zip(*np.nonzero(a @ b.T >= 0.95 - vectors.SLACK)))


# ---- urls ---------------------------------------------------------------------
def slow_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    best = None
    for text, says in urls.LISTED:
        domain, _, start = text.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start):
            if best is None or len(text) > len(best[0]):
                best = (text, says)
    return host, path, *(best or (None, None))


URLS = [
    None, "", "no scheme", "http://", "https://A.Example.ORG/es/1?x=1#y", "http://example.org/en/12", "http://example.org/EN/1",
    "http://notexample.org/es/", "http://x.com/fr/", "http://x.com/de", "http://x.com/de/9", "HTTP://ÄB.com/fr/é?q", "a://b://c/d",
    "http://org/", "http://x.net?u=http://y.org/", "http://x.org\n/es/", "https://m.casino-win.example.net/en/1",
]


def test_hosts_paths_and_listed_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS)) + [(99, "http://x.com/fr/")] * 2, "page_id long, url string")
    df = df.withColumns({c: F.lit("own") for c in ("host", "items", "says", "url_filter", "confidence")})
    rows = urls.classify(df).collect()
    assert len(rows) == len(URLS) + 2 and all(r.url_filter == "own" for r in rows)
    for r in rows:
        host, path, rule, says = slow_rule(r.url)
        v = r["url_filter_"]
        assert (v.host, v.path, v.rule) == (host, path, rule) and v.verdict in ("allow", "block")
        assert says is None or v.verdict == says
    assert urls.classify(df.where("false")).count() == 0


def test_mined_rules_block_what_the_labels_block(spark):
    rows = [(i, f"https://www.site{i % 40}.net/{'bad' if i % 8 == 0 else 'ok'}/page{i}.html") for i in range(800)]
    labelled = spark.createDataFrame([(u, "block" if "/bad/" in u else "allow") for _, u in rows], "url string, label string")
    new = spark.createDataFrame([(1, "http://unseen.net/bad/9"), (2, "http://unseen.net/ok/9"), (3, None)], "page_id long, url string")
    got = {r.page_id: r.url_filter.verdict for r in urls.classify(new, labelled=labelled).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow"}


def test_given_pages_are_blocked_by_their_seed_words(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    for r in urls.classify(pages.select("page_id", "url")).collect():
        host, path, rule, says = slow_rule(r.url)
        v = r.url_filter
        assert (v.host, v.path, v.rule) == (host, path, rule)
        seed = any(w in urls.SEED_WORDS for w in re.split(r"[.-]", host))
        assert v.verdict == (says or ("block" if seed else "allow")), r.url


@pytest.mark.parametrize("blocked", [3, 6, 9, 10])
def test_rules_are_mined_whatever_share_is_blocked(spark, blocked):
    rows = [(i, f"https://www.site{i % 40}.net/{'bad' if i // 40 % 10 < blocked else 'ok'}/page{i}.html") for i in range(800)]
    labelled = spark.createDataFrame([(u, "block" if "/bad/" in u else "allow") for _, u in rows], "url string, label string")
    new = spark.createDataFrame([(1, "http://unseen.org/bad/9"), (2, "http://unseen.org/ok/9"), (3, "http://unseen.org/9"), (4, None)], "page_id long, url string")
    got = {r.page_id: r.url_filter.verdict for r in urls.classify(new, labelled=labelled, listed=()).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow", 4: "allow"}
    hosts = [(i, f"http://{'casino' if i // 40 % 10 < blocked else 'news'}.site{i % 40}.net/page{i}") for i in range(800)]
    pages = urls.classify(spark.createDataFrame(hosts, "page_id long, url string"), listed=()).collect()
    assert all(r.url_filter.verdict == ("block" if "casino" in r.url else "allow") for r in pages)


def test_common_label_does_not_hide_the_rare_one(spark):
    rows = [(f"http://a.net/{'bad' if i < 60 else 'ok'}/p{i}", "block" if i < 57 else "allow") for i in range(800)]
    rows += [(f"http://b.net/fine/q{i}", "block" if i < 20 else "allow") for i in range(1000)]
    new = spark.createDataFrame([(1, "http://b.net/bad/9"), (2, "http://b.net/ok/9")], "page_id long, url string")
    labelled = spark.createDataFrame(rows, "url string, label string")
    got = {r.page_id: r.url_filter.verdict for r in urls.classify(new, labelled=labelled, listed=()).collect()}
    assert got == {1: "block", 2: "allow"}


def test_rare_seed_words_get_a_rule_on_a_large_table(spark):
    rows = spark.range(9000).select("id", F.concat(F.lit("http://news"), F.col("id") % 50, F.lit(".net/page"), "id").alias("url"))
    rare = [(10_000 + i, f"http://{w}.net/page{i}{k}") for i, w in enumerate(urls.SEED_WORDS) for k in range(3)]
    pages = rows.union(spark.createDataFrame(rare, "page_id long, url string"))
    got = urls.classify(pages.withColumnRenamed("id", "page_id"), listed=()).groupBy("url_filter.verdict").count().collect()
    assert dict(got) == {"allow": 9000, "block": 3 * len(urls.SEED_WORDS)}


# ---- tool calls ---------------------------------------------------------------
SCHEMAS = {
    "sum": {
        "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "number"}, "mode": {"type": "string", "enum": ["x", "y"]}},
        "required": ["a"], "additionalProperties": False,
    },
    "any": {},
}
CALL = "conv_id long, call_id string, turn long, tool string, arguments string, after array<string>"


@pytest.fixture(scope="module")
def linked(spark):
    calls = [
        (1, "a", 5, "sum", '{"b": 1.5, "a": 2}', ["b"]),  # needs a later call
        (1, "b", 7, "sum", '{"a": -1, "z": 1, "mode": "q"}', ["c", "unknown"]),
        (1, "c", 2, "any", '{"z": {"k": [1, "ü"], "b": null}, "a": "q\\"uote"}', None),
        (1, "d", 9, "sum", "not json", []),
        (1, "d", 9, "sum", "not json", []),  # repeated row
        (1, None, 9, "sum", "{}", []),
        (1, "e", 10, "none", '{"a": 1}', None),
        (2, "p", 1, "any", "{}", ["q"]),
        (2, "q", 2, "any", "{}", ["p"]),  # a cycle
        (2, "r", 3, "any", None, ["q"]),  # behind it
        (3, "a", 1, "sum", '{"a": "1", "b": true}', None),
    ]
    results = [(1, "a", 6, "ok"), (1, "a", 8, "late"), (1, "c", 3, None), (9, "a", 1, "lost"), (None, "a", 1, "?"), (3, "a", 2, "three")]
    c = spark.createDataFrame(calls, CALL)
    r = spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string")
    return tool_calls.link(c, r, SCHEMAS), c, r


def test_links_statuses_and_orders(linked):
    rows = linked[0].collect()
    got = sorted((str(r.conv_id), str(r.call_id), r.status) for r in rows)
    assert got == sorted([
        ("1", "a", "linked"), ("1", "a", "extra"), ("1", "b", "unanswered"), ("1", "c", "linked"), ("1", "d", "unanswered"),
        ("1", "d", "duplicate"), ("1", "None", "unidentified"), ("1", "e", "unanswered"), ("2", "p", "cycle"), ("2", "q", "cycle"),
        ("2", "r", "cycle"), ("9", "a", "orphan"), ("None", "a", "unidentified"), ("3", "a", "linked"),
    ])
    step = {(r.conv_id, r.call_id): r.step for r in rows if r.step is not None}
    assert step == {(1, "c"): 2, (1, "b"): 7, (1, "a"): 8, (1, "d"): 9, (1, "e"): 10, (3, "a"): 1}


def test_arguments_are_checked_and_canonical(linked):
    rows = {(r.conv_id, r.call_id): r for r in linked[0].where("valid is not null").collect() if r.status != "duplicate"}
    assert rows[1, "a"].valid and rows[1, "c"].valid
    assert rows[1, "b"].errors == "a breaks minimum; mode breaks enum; unexpected z"
    assert rows[1, "d"].errors == "arguments are no object" and rows[1, "e"].errors == "unknown tool"
    assert rows[3, "a"].errors == "a is not integer; b is not number" and not rows[2, "r"].valid
    line = rows[1, "c"].line
    assert line == json.dumps(json.loads(line), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(line)["arguments"]["a"] == 'q"uote' and "result" not in json.loads(line)


def slow_steps(calls):
    """(conv, call) -> step, or None for calls that depend on a cycle."""
    turn = {(c, k): t for c, k, t, _ in calls}
    needs = {(c, k): [(c, a) for a in after or [] if (c, a) in turn] for c, k, _, after in calls}
    done = {}
    while True:
        ready = [k for k in turn if k not in done and all(a in done for a in needs[k])]
        if not ready:
            return {k: done.get(k) for k in turn}
        for k in ready:
            done[k] = max([turn[k], *(done[a] + 1 for a in needs[k])])


def test_steps_equal_brute_force(spark):
    rng = random.Random(11)
    calls = []
    for conv in range(60):
        n = rng.randint(1, 14)
        for k in range(n):
            some = rng.choices([0, 1, 2, 3], [4, 5, 2, 1])[0]
            # Mostly earlier calls, now and then later ones, itself or none that is known.
            after = [str(rng.randint(0, k) if rng.random() < 0.8 else rng.randint(0, n)) for _ in range(some)]
            calls.append((conv, str(k), rng.choice([k, 2 * k, 5, 1_000_000 * k]), after))
    df = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, after array<string>")
    got = {(r.conv_id, r.call_id): None if r.looped else r.step for r in tool_calls.ordered(df).collect()}
    assert got == slow_steps(calls) and None in got.values()


def test_long_chains_and_late_cycles_end_soon(spark, monkeypatch):
    """Rounds grow with the logarithm of a chain, and not at all with the turns."""
    stored = []
    monkeypatch.setattr(tool_calls, "settle_table", lambda df, plain=tool_calls.settle_table: stored.append(1) or plain(df))
    chain = [(1, str(k), 5000 - k, [str(k - 1)] if k else []) for k in range(5000)]  # each needs the turn after it
    ring = [(2, str(k), 1_000_000 + k, [str((k + 1) % 7)]) for k in range(7)] + [(2, "behind", 2_000_000, ["3"])]
    pair = [(3, "a", 1, ["b"]), (3, "b", 1_000_000, ["a"]), (3, "free", 3, [])]
    df = spark.createDataFrame(chain + ring + pair, "conv_id long, call_id string, turn long, after array<string>")
    got = {(r.conv_id, r.call_id): None if r.looped else r.step for r in tool_calls.ordered(df).collect()}
    assert got == slow_steps(chain + ring + pair)
    assert len(stored) <= 3 + 3 * 16


def test_nothing_to_link(linked):
    _, c, r = linked
    assert tool_calls.link(c.where("false"), r.where("false"), SCHEMAS).count() == 0


def test_turns_with_odd_rows(spark):
    turns = [(1, 0, "user", "hi \"you\"\n"), (1, 1, "assistant", "yes"), (1, 1, "assistant", "yes"), (1, 2, None, None), (1, 3, "user", ""),
             (2, 0, "assistant", "first"), (None, 0, "user", "x"), (3, None, "assistant", "y")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("row", F.lit("own")).withColumn("step", F.lit(1))
    got = sorted((str(r.conv_id), str(r.turn), r.status) for r in tool_calls.format_conversations(df).collect())
    assert got == sorted([("1", "0", "linked"), ("1", "1", "extra"), ("1", "2", "unanswered"), ("1", "3", "unanswered"), ("2", "0", "orphan"),
                          ("None", "0", "unidentified"), ("3", "None", "unidentified")])
    assert tool_calls.format_conversations(df.where("false")).count() == 0


def test_tool_calls_run_no_python(spark):
    from bayworks.llm import queries

    plan = queries.QUERIES["op5_tool_calls"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
