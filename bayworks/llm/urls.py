"""URL filters: association rules over URL tokens, mined from labels with FP-growth.

A rule says that URLs with certain tokens together carry a label. Rules are pruned by
support, confidence and redundancy, and found again in a URL by an inverted index on each
rule's rarest token. Listed rules for hosts and paths come first.
"""

from __future__ import annotations

from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bayworks.llm.common import fresh
from bayworks.session import settle_table

ALLOW, BLOCK = "allow", "block"
#: (rule, verdict): a host with all its subdomains, and the beginning of a path.
LISTED = (("org/", ALLOW), ("example.org/es/", BLOCK), ("example.org/en/1", BLOCK), ("com/fr/", ALLOW), ("com/de/", BLOCK))

# ---- fixed values: words in hosts that mark unwanted sites ----------------------
SEED_WORDS = (
    "ads", "adult", "bets", "betting", "casino", "cheap", "clickbait", "escort", "gambling", "jackpot", "lottery",
    "malware", "phishing", "pills", "poker", "porn", "replica", "slots", "spam", "torrent", "viagra", "warez", "xxx",
)
# ---------------------------------------------------------------------------------
MIN_SUPPORT, MIN_CONFIDENCE = 0.0005, 0.9
#: A single token needs this many distinct URLs at most for a rule, however many there are.
MIN_URLS = 2
#: URLs that rules of several tokens are mined from, about, and tokens that a rule can name.
SAMPLE, MAX_ITEMS = 200_000, 4
_LABEL = "label="


def _head(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark or hash, A-Z in lower case."""
    return F.coalesce(lower_ascii(_head(url)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to a question mark or hash; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_rule(host: Column, path: Column, listed=LISTED) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule that fits, or nulls; of equal ones the first."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(listed, key=lambda r: len(r[0])):
        domain, _, start = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL: words of the host, its last label, path words without bare numbers, query names.

    Tokens say where they stand, so a word in a host is not the same as one in a path.
    """
    words = F.split(F.regexp_replace(host, r"\.[^.]*$", ""), r"[.\-]")
    words = F.transform(words, lambda w: F.concat(F.lit("h:"), w))
    last = F.array(F.concat(F.lit("t:"), F.element_at(F.split(host, r"\."), -1)))
    steps = F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.rlike("^[0-9]+$"))
    query = F.regexp_extract_all(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1))
    parts = (words, last, F.transform(steps, lambda w: F.concat(F.lit("p:"), w)), F.transform(query, lambda w: F.concat(F.lit("q:"), w)))
    found = F.array_distinct(F.concat(*(F.coalesce(p, F.array().cast("array<string>")) for p in parts)))
    return F.array_sort(F.filter(found, lambda w: ~w.isin("h:", "t:", "h:www")))


def seed_label(host: Column, words=SEED_WORDS) -> Column:
    """A weak label of a host: block if one of its words is a seed word, else allow."""
    return F.when(F.arrays_overlap(F.split(host, r"[.\-]"), F.array(*map(F.lit, words))), BLOCK).otherwise(ALLOW)


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, sample: int = SAMPLE) -> DataFrame:
    """(rule_id, items, size, says, confidence, lift): rules of ``labelled`` (url, items, label).

    Rules of one token are counted over all rows, with a support of ``MIN_URLS`` rows or less.
    For those of several tokens FP-growth runs on about ``sample`` rows, chosen by a hash, which
    bounds what the model is fitted on; the rules judge every URL. A rule is dropped if part of its items says the same with no less confidence. An empty table, or
    one without a frequent set, gives no rules.
    """
    usable = labelled.where(F.size("items") > 0)
    total = usable.count()
    share = sample / max(total, 1)
    picked = usable if share >= 1 else usable.where(F.pmod(F.xxhash64("url", "label"), F.lit(1_000_000)) < int(1_000_000 * share))
    both = F.array_append("items", F.concat(F.lit(_LABEL), "label")).alias("items")
    rows = settle_table(picked.select(both))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(rows)
    found = model.associationRules.where(F.col("consequent")[0].startswith(_LABEL) & (F.size("antecedent") <= MAX_ITEMS))
    found = found.select(
        F.array_sort("antecedent").alias("items"), F.size("antecedent").alias("size"), "confidence", "lift",
        F.substring(F.col("consequent")[0], len(_LABEL) + 1, 100).alias("says"),
    )
    found = found.where((F.col("size") > 1) & ~F.exists("items", lambda i: i.startswith(_LABEL)))
    found = settle_table(found.unionByName(_single(usable, total, min(MIN_URLS, ceil(min_support * total)), min_confidence)))
    part = F.expr("filter(items, (x, i) -> (mask & shiftleft(1, i)) <> 0)")
    parts = found.withColumn("mask", F.explode(F.expr("sequence(1, shiftleft(1, size) - 1)"))).select("items", "says", "confidence", "mask", part.alias("part"))
    parts = parts.where(F.size("part") < F.size("items"))
    short = found.select(F.col("items").alias("part"), "says", F.col("confidence").alias("c"))
    needless = parts.join(short, ["part", "says"]).where("c >= confidence")
    kept = found.join(needless.select("items", "says").distinct(), ["items", "says"], "left_anti")
    return settle_table(kept.withColumn("rule_id", F.xxhash64("items", "says")))


def _single(usable: DataFrame, total: int, least: int, min_confidence: float) -> DataFrame:
    """Rules of one token that ``least`` rows with the label hold, counted over all rows."""
    counted = usable.select(F.explode("items").alias("item"), "label").groupBy("item", "label").agg(F.count("*").alias("n"))
    share = usable.groupBy("label").agg((F.count("*") / F.lit(total)).alias("share"))
    confidence = F.col("n") / F.sum("n").over(Window.partitionBy("item"))
    rules = counted.withColumn("confidence", confidence).where((F.col("n") >= least) & (F.col("confidence") >= min_confidence))
    return rules.join(share, "label").select(
        F.array("item").alias("items"), F.lit(1).alias("size"), "confidence", (F.col("confidence") / F.col("share")).alias("lift"), F.col("label").alias("says")
    )


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(items, says, confidence, lift, size): the strongest rule for each distinct ``items`` of ``urls``.

    Each rule stands in the index under its rarest token only, so tokens that most URLs have
    carry few rules. The rule that raises the odds of its label most wins, so of one label
    more confidence does, and a rule for the common label that is hardly better than its share
    does not hide one for the rare label; then lift, then more tokens, then the smaller id.
    """
    share = F.col("confidence") / F.col("lift")
    odds = F.when(F.col("confidence") >= 1, float("inf")).otherwise(F.col("confidence") * (1 - share) / ((1 - F.col("confidence")) * share))
    postings = urls.select("items").distinct().select("items", F.explode("items").alias("token"))
    often = postings.join(rules.select(F.explode("items").alias("token")).distinct(), "token").groupBy("token").agg(F.count("*").alias("n"))
    placed = rules.select("*", F.explode("items").alias("token")).join(often, "token", "left")
    rarest = F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token"))
    index = settle_table(placed.groupBy("rule_id").agg(rarest.alias("token"), F.first("items").alias("rule"), F.first("says").alias("says"),
        F.first("confidence").alias("confidence"), F.first("lift").alias("lift"), F.first("size").alias("size")))
    hits = postings.join(index, "token").where(F.size(F.array_except("rule", "items")) == 0)
    strength = F.struct(odds.alias("odds"), "lift", "size", (-F.col("rule_id")).alias("id"))
    return hits.groupBy("items").agg(F.max_by(F.struct("says", "rule", "confidence"), strength).alias("hit")).select("items", "hit.*")


def classify(pages: DataFrame, url: str = "url", labelled: DataFrame | None = None, listed=LISTED) -> DataFrame:
    """``pages`` with one more column ``url_filter``: host, path, rule, verdict and mined.

    ``labelled`` (url, label) teaches the mined rules; without it, the distinct URLs of
    ``pages`` are labelled by the seed words in their hosts. The verdict is that of the
    longest listed rule, else that of the strongest mined rule, else allow. Null URLs and
    those without ``://`` have an empty host and path, fit no rule, and are allowed. A
    ``url_filter`` column of the input stays, ours then ends in an underscore.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    items = tokens(F.col(url), host, path)
    name, key = fresh(pages, "url_filter"), fresh(pages, "items")
    known = pages.select(F.col(url).alias("url")).distinct() if labelled is None else labelled.select("url", "label").distinct()
    h = host_of(F.col("url"))
    label = seed_label(h) if labelled is None else F.col("label")
    teach = known.where("url is not null and label is not null") if labelled is not None else known.where("url is not null")
    rules = mine(teach.select("url", tokens(F.col("url"), h, path_of(F.col("url"))).alias("items"), label.alias("label")))
    kinds = settle_table(pages.select(items.alias("items")).where(F.size("items") > 0).distinct())
    hits = settle_table(match(kinds, rules).withColumnRenamed("items", key))
    rule, verdict = listed_rule(host, path, listed)
    held = pages.withColumn(key, items)
    extra = fresh(held, "says"), fresh(held, "rule_items"), fresh(held, "confidence")
    hits = hits.select(key, F.col("says").alias(extra[0]), F.col("rule").alias(extra[1]), F.col("confidence").alias(extra[2]))
    out = held.join(hits, key, "left")
    whole = F.struct(
        host.alias("host"), path.alias("path"), rule.alias("rule"), F.coalesce(verdict, F.col(extra[0]), F.lit(ALLOW)).alias("verdict"),
        F.concat_ws(" ", extra[1]).alias("mined"),
    )
    return out.withColumn(name, whole).drop(key, *extra)
