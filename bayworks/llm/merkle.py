"""Merkle manifest of a data set with octopus multiproofs.

Every row is a leaf; the leaves of a group form a binary tree, and the groups' roots form
one more. Leaves are handled in blocks of neighbours. A block works out which nodes its
proofs need that its own leaves do not give (the least union over all of them), gets these
in one join, derives the inner nodes its proofs share, and writes each proof on the spot.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bayworks.llm.common import fresh
from bayworks.session import settle_table

#: Leaves of a block: two to this power. Bounds every group, whatever the size of the tree.
BLOCK_BITS = 10
#: The number of the tree that the groups' roots form.
TOP = -1
NODE = "tree long, level int, index long, hash string"


# ---- trees, on any set of leaves --------------------------------------------------
def digest(*children: str) -> str:
    return sha256("".join(children).encode("ascii")).hexdigest()


def height(n: int) -> int:
    """Levels above the leaves until one node is left."""
    return (n - 1).bit_length() if n > 0 else 0


def width(n: int, level: int) -> int:
    """Nodes at ``level`` of a tree with ``n`` leaves; a last node may be an only child."""
    return (n + (1 << level) - 1) >> level


def missing(leaves: Iterable[int], n: int) -> list[tuple[int, int]]:
    """The fewest (level, index) that prove all ``leaves`` of a tree with ``n``: siblings that
    they do not give themselves."""
    out, own = [], sorted(set(leaves))
    for level in range(height(n)):
        have, most = set(own), width(n, level)
        out += [(level, i ^ 1) for i in own if i ^ 1 < most and i ^ 1 not in have]
        own = sorted({i >> 1 for i in own})
    return out


def derive(leaves: dict[int, str], fetched: dict[tuple[int, int], str], n: int) -> dict[tuple[int, int], str]:
    """Hashes of ``fetched`` and of every node above ``leaves``, each computed once."""
    known, own = dict(fetched), leaves
    known.update({(0, i): h for i, h in leaves.items()})
    for level in range(height(n)):
        most, up = width(n, level), {}
        for i in {i >> 1 for i in own}:
            pair = [known[level, k] for k in (2 * i, 2 * i + 1) if k < most]
            up[i] = known[level + 1, i] = digest(*pair)
        own = up
    return known


def siblings(leaf: int, known: dict[tuple[int, int], str], n: int) -> list[tuple[bool, str | None]]:
    """(the other stands left, its hash or None for an only child), from the leaf up."""
    path = []
    for level in range(height(n)):
        other = (leaf >> level) ^ 1
        path.append((other < leaf >> level, known[level, other] if other < width(n, level) else None))
    return path


def fold(leaf: str, path: Iterable[tuple[bool, str | None]]) -> str:
    """The root that ``leaf`` and its siblings give."""
    for left, other in path:
        leaf = digest(leaf) if other is None else digest(other, leaf) if left else digest(leaf, other)
    return leaf


# ---- in Spark -----------------------------------------------------------------------
def encoded(values: Sequence[Column]) -> Column:
    """Each value as its number of bytes, a colon and itself, or ``-`` for null; one after the other."""
    parts = []
    for v in values:
        s = v.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def numbered(rows: DataFrame, group: list[str], order: list[str], index: str = "index") -> DataFrame:
    """Stored ``rows`` with their position, from 0, among the rows of their group in ``order``.

    Rows are range-partitioned and sorted once; a position is that within the partition and
    the counts of the partitions before, of which there is one row for each partition and
    group in it. No group is gathered, and a hot one spans partitions. ``order`` must tell
    all rows of a group apart.
    """
    by = [*group, *order]
    at, part = fresh(rows, "at"), fresh(rows, "part")
    shuffles = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = rows.repartitionByRange(shuffles, *by).sortWithinPartitions(*by).withColumn(at, F.monotonically_increasing_id())
    held = settle_table(held).withColumn(part, F.shiftright(at, 33))  # the upper bits are the partition's number
    runs = held.groupBy(*group, part).agg(F.min(at).alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    runs = settle_table(runs.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    keys = {g: fresh(held, f"{g}_of") for g in (*group, part)}
    runs = runs.select(*(F.col(g).alias(k) for g, k in keys.items()), F.col("first").alias("_first"), F.col("before").alias("_before"))
    same = F.lit(True)
    for g, k in keys.items():
        same = same & F.col(g).eqNullSafe(F.col(k))
    out = held.join(runs, same).withColumn(index, F.col(at) - F.col("_first") + F.col("_before"))
    return out.drop(at, part, "_first", "_before", *keys.values())


def _subtrees(bits: int, inner: bool):
    """For applyInArrow: nodes over one block of neighbours at ``level``, all or the topmost."""

    def work(block: pa.Table) -> pa.Table:
        rows = sorted(zip(block["index"].to_pylist(), block["hash"].to_pylist()))
        tree, level, n = (block[c][0].as_py() for c in ("tree", "level", "n"))
        made, top = [], min(level + bits, height(n))
        while level < top:
            up: dict[int, list[str]] = {}
            for i, h in rows:
                up.setdefault(i >> 1, []).append(h)
            rows, level = [(i, digest(*pair)) for i, pair in up.items()], level + 1
            if inner or level == top:
                made += [(level, i, h) for i, h in rows]
        return pa.table({
            "tree": pa.array([tree] * len(made), pa.int64()), "level": pa.array([m[0] for m in made], pa.int32()),
            "index": pa.array([m[1] for m in made], pa.int64()), "hash": pa.array([m[2] for m in made], pa.string()),
        })

    return work


def _grow(nodes: DataFrame, start: int, tallest: int, bits: int) -> list[DataFrame]:
    """Stored tables of all nodes above ``nodes`` (tree, level, index, hash, n), which stand at ``start``."""
    out, level = [], start
    while level < tallest:
        blocks = nodes.withColumn("block", F.shiftright("index", bits)).groupBy("tree", "block")
        made = settle_table(blocks.applyInArrow(_subtrees(bits, inner=True), NODE))
        out.append(made)
        level += bits
        sizes = nodes.select("tree", "n").distinct()
        nodes = made.where(F.col("level") == level).join(sizes, "tree")
    return out


def _wanted(bits: int, groups: int):
    """For mapInArrow: what the proofs of each block need from elsewhere."""

    def work(batches):
        for b in batches:
            rows = []
            for tree, block, n in zip(*(b.column(c).to_pylist() for c in ("tree", "block", "n"))):
                own = range(block << bits, min((block + 1) << bits, n))
                rows += [(tree, block, tree, level, i) for level, i in missing(own, n)]
                rows += [(tree, block, TOP, level, i) for level, i in missing([tree], groups)]
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["tree", "block", "of", "level", "index"])

    return work


def _proofs(groups: int, shape: pa.Schema):
    """For the co-group of a block's leaves and the nodes it asked for: one proof for each leaf."""

    def work(block: pa.Table, nodes: pa.Table) -> pa.Table:
        if not block.num_rows:
            return shape.empty_table()
        tree, n = block["tree"][0].as_py(), block["n"][0].as_py()
        got: dict[int, dict[tuple[int, int], str]] = {tree: {}, TOP: {}}
        for of, level, i, h in zip(*(nodes[c].to_pylist() for c in ("of", "level", "index", "hash"))):
            got[of][level, i] = h
        index, leaf, received = (block[c].to_pylist() for c in ("index", "leaf", "received"))
        known = derive(dict(zip(index, leaf)), got[tree], n)
        subroot = known[height(n), 0]
        root = derive({tree: subroot}, got[TOP], groups)[height(groups), 0]
        above = siblings(tree, got[TOP], groups)
        proofs, folded = [], []
        for i, h in zip(index, received):
            path = siblings(i, known, n) + above
            proofs.append([other for _, other in path if other is not None])
            folded.append(fold(h, path))
        added = {
            "subroot": pa.array([subroot] * len(index), pa.string()), "root": pa.array([root] * len(index), pa.string()),
            "proof": pa.array(proofs, pa.list_(pa.string())), "folded_root": pa.array(folded, pa.string()),
        }
        return pa.table({f.name: added.get(f.name, block[f.name] if f.name in block.column_names else None) for f in shape})

    return work


def manifest(
    docs: DataFrame, fields: Sequence[str], group: str, order: str, received: dict[str, Column] | None = None, bits: int = BLOCK_BITS
) -> DataFrame:
    """One row for each row of ``docs``: (order, group, index, leaf, subroot, root, proof, folded_root, verified).

    ``leaf`` is the hash of ``fields``; ``index`` the place among the leaves of its group, in
    ascending ``order``; ``subroot`` the root of the group's tree and ``root`` that of the
    tree of subroots in ascending order of groups. Nulls come first in both. Two neighbours
    make a node, an odd last one alone too, until one is left. ``proof`` lists the siblings
    from the leaf up to the root. ``received`` replaces columns by what was delivered: the
    folded root is that of the delivered row with the original siblings, and ``verified``
    says whether it equals the root. Rows with equal ``order`` stand by their leaf, equal
    rows by position. An empty table gives no rows.
    """
    spark = docs.sparkSession
    sent = [F.col(f) for f in fields]
    came = [(received or {}).get(f, F.col(f)) for f in fields]
    rows = docs.select(
        F.col(group).alias("group_key"), F.col(order).alias("order_key"), encoded(sent).alias("leaf"),
        (encoded(came) if received else encoded(sent)).alias("received"), F.monotonically_increasing_id().alias("row"),
    )
    placed = numbered(settle_table(rows), ["group_key"], ["order_key", "leaf", "row"])
    placed = settle_table(placed.select("group_key", "order_key", "leaf", "received", "index"))
    sizes = settle_table(placed.groupBy("group_key").agg(F.count("*").alias("n")))
    groups = sizes.count()
    trees = settle_table(numbered(sizes, [], ["group_key"], "tree"))
    trees = trees.select(F.col("group_key").alias("key_of"), "n", "tree")
    leaves = placed.join(trees, F.col("group_key").eqNullSafe(F.col("key_of"))).drop("key_of").withColumn("block", F.shiftright("index", bits))
    tallest = height(trees.agg(F.max("n")).first()[0] or 0)

    low = leaves.select("tree", "block", F.lit(0).alias("level"), "index", F.col("leaf").alias("hash"), "n")
    base = settle_table(low.groupBy("tree", "block").applyInArrow(_subtrees(bits, inner=False), NODE))
    single = leaves.where("n = 1").select("tree", F.lit(0).alias("level"), "index", F.col("leaf").alias("hash"))
    upper = [base, *_grow(base.where(F.col("level") == bits).join(trees.select("tree", "n"), "tree"), bits, tallest, bits)]
    nodes = single
    for made in upper:
        nodes = nodes.unionByName(made)
    is_root = F.col("index") == 0
    ends = nodes.where(is_root).groupBy("tree").agg(F.max_by("hash", "level").alias("hash"))
    subroots = settle_table(ends.select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("index"), "hash", F.lit(groups).cast("long").alias("n")))
    for made in [subroots.drop("n"), *_grow(subroots, 0, height(groups), bits)]:
        nodes = nodes.unionByName(made)

    blocks = leaves.select("tree", "block", "n").distinct()
    wanted = blocks.mapInArrow(_wanted(bits, groups), "tree long, block long, of long, level int, index long")
    held = nodes.select(F.col("tree").alias("of"), "level", "index", "hash")
    fetched = settle_table(wanted.join(held, ["of", "level", "index"]))
    keys = docs.select(F.col(order).alias("order_key"), F.col(group).alias("group_key"))
    kinds = {f.name: f.dataType.simpleString() for f in keys.schema}
    shape = f"order_key {kinds['order_key']}, group_key {kinds['group_key']}, index long, leaf string, subroot string, root string, proof array<string>, folded_root string"
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark.createDataFrame([], shape).schema)
    both = leaves.groupBy("tree", "block").cogroup(fetched.groupBy("tree", "block"))
    out = both.applyInArrow(_proofs(groups, arrow), shape)
    out = out.withColumnsRenamed({"order_key": order, "group_key": group})
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
