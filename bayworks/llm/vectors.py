"""Embedding near-duplicates: tiles of vectors compared in principal-axis order.

Turning all vectors to the principal axes keeps every product. The leading axes come first,
so after some of them the rest of a product is at most the product of the two suffix norms;
a pair whose sum plus that bound stays below the threshold is dropped there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bayworks.llm.components import components
from bayworks.session import settle_table

THRESHOLD = 0.95
#: Vectors in a block (the unit that is moved) and in a tile (the unit that is compared).
BLOCK, TILE = 4096, 1024
#: Axes after which pairs are dropped.
STEPS = (8, 16, 32)
#: Leading axes that cut space into cells as wide as two linked vectors can be apart.
CELL_AXES = 2
SLACK = 1e-9


def _unit(values: list | None) -> tuple[bytes, np.ndarray] | None:
    """(key, unit vector in doubles), or None for what links with nothing."""
    if not values or None in values:
        return None
    raw = np.array(values, np.float64)
    if not np.isfinite(raw).all():
        return None
    top = np.abs(raw).max()
    if top == 0:
        return None
    scaled = raw / top  # so that squares of very small or large numbers stay exact
    return raw.tobytes(), scaled / np.sqrt(scaled @ scaled)


@F.arrow_udf(T.StructType().add("key", T.BinaryType()).add("unit", T.ArrayType(T.DoubleType())))
def _units(vectors: pa.Array) -> pa.Array:
    rows = [_unit(v.as_py()) for v in vectors]
    kind = pa.struct([("key", pa.binary()), ("unit", pa.list_(pa.float64()))])
    return pa.array([r and {"key": r[0], "unit": r[1]} for r in rows], kind)


_units = _units.asNondeterministic()


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """dimension -> orthonormal axes (columns), the ones with most energy first.

    Each task sums its outer products and sends one matrix for each dimension; matrices
    meet in a fixed number of groups, and those few sums come to the driver.
    """

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for v in batch.column(0):
                x = np.array(v.as_py())
                if len(x) not in total:
                    total[len(x)] = np.zeros((len(x), len(x)))
                total[len(x)] += np.outer(x, x)
        part = TaskContext.get().partitionId() % 32
        rows = [{"dim": d, "part": part, "m": m.ravel()} for d, m in total.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("m", pa.list_(pa.float64()))]))

    def add(group):
        return group.head(1).assign(m=[np.sum(np.stack(group["m"].to_list()), axis=0)])

    kind = "dim int, part int, m array<double>"
    parts = vectors.select("unit").mapInArrow(sums, kind).groupBy("dim", "part").applyInPandas(add, kind)
    total: dict[int, np.ndarray] = {}
    for r in parts.collect():
        total[r["dim"]] = total.get(r["dim"], 0) + np.array(r["m"])
    return {d: np.linalg.eigh(m.reshape(d, d))[1][:, ::-1].copy() for d, m in total.items()}


def _suffix_norms(v: np.ndarray) -> dict[int, np.ndarray]:
    return {k: np.sqrt((v[:, k:] ** 2).sum(axis=1)) for k in STEPS if k < v.shape[1]}


def linked_pairs(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of two tiles in axis order whose product reaches the threshold.

    All products of the first axes are one matrix product; from the first bound on only the
    pairs that can still reach the threshold are carried further.
    """
    need = threshold - SLACK
    ends = [k for k in STEPS if k < a.shape[1]] + [a.shape[1]]
    rest_a, rest_b = _suffix_norms(a), _suffix_norms(b)
    first = ends[0]
    s = a[:, :first] @ b[:, :first].T
    if first < a.shape[1]:
        i, j = np.nonzero(s + np.outer(rest_a[first], rest_b[first]) >= need)
    else:
        i, j = np.nonzero(s >= need)
    s = s[i, j]
    for start, end in zip(ends, ends[1:]):
        if not len(i):
            break
        s = s + np.einsum("ij,ij->i", a[i, start:end], b[j, start:end])
        bound = rest_a[end][i] * rest_b[end][j] if end < a.shape[1] else 0.0
        on = s + bound >= need
        i, j, s = i[on], j[on], s[on]
    return i, j


def _exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    on = np.einsum("ij,ij->i", a[i], b[j]) >= threshold
    return i[on], j[on]


def compare_blocks(a: np.ndarray, b: np.ndarray, weight_a, weight_b, axes: np.ndarray, same: bool, threshold: float):
    """(links of each row of a, of b, root of each row): rows of a are 0.., of b follow them.

    Links count the partner's weight. Roots join what is linked within the two blocks, so a
    block pair gives a row for each vector at most, however dense its links are.
    """
    ra, rb = a @ axes, b @ axes
    links_a, links_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    shift = 0 if same else len(a)
    root = np.arange(len(a) if same else len(a) + len(b))
    for x in range(0, len(a), TILE):
        for y in range(x if same else 0, len(b), TILE):
            i, j = linked_pairs(ra[x : x + TILE], rb[y : y + TILE], threshold)
            i, j = _exact(a[x : x + TILE], b[y : y + TILE], i, j, threshold)
            i, j = i + x, j + y
            if same:
                up = i < j
                i, j = i[up], j[up]
            np.add.at(links_a, i, weight_b[j])
            np.add.at(links_a if same else links_b, j, weight_a[i])
            root = _join(root, i, j + shift)
    return links_a, links_b, root


def _join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots after the links (i, j): minima travel along links and up the roots until they rest."""
    while len(i):
        a, b = root[i], root[j]
        on = a != b
        i, j, a, b = i[on], j[on], a[on], b[on]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, up := root[root]):
            root = up
    return root


def _blocks(nodes: DataFrame, axes: dict[int, np.ndarray], threshold: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(blocks, which pairs of blocks can hold a link).

    A vector's cell is its place on the leading axes in steps of the largest distance that
    linked unit vectors have, so links join equal or neighbouring cells. A cell is cut into
    blocks of bounded size by a hash. Cells are as many as space has, not as rows.
    """
    width = np.sqrt(2 - 2 * threshold) + SLACK

    def cells(units: pa.Array) -> pa.Array:
        out = []
        for v in units:
            x = np.array(v.as_py())
            lead = (x @ axes[len(x)][:, :CELL_AXES]) / width
            out.append([len(x), *np.floor(lead).astype(int).tolist()])
        return pa.array(out, pa.list_(pa.int32()))

    placed = settle_table(nodes.withColumn("cell", F.arrow_udf(cells, "array<int>").asNondeterministic()("unit")))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("cuts"))
    cut = F.pmod(F.xxhash64("key"), F.col("cuts")).cast("int").alias("cut")
    placed = placed.join(F.broadcast(sizes), "cell").select("cell", cut, "key", "unit", "weight")

    def gather(group):
        unit = np.stack(group["unit"].to_list())
        return group.head(1)[["cell", "cut"]].assign(
            dim=unit.shape[1], keys=[group["key"].to_list()], weights=[group["weight"].to_list()], units=[unit.tobytes()]
        )

    kind = "cell array<int>, cut int, dim int, keys array<binary>, weights array<long>, units binary"
    blocks = settle_table(placed.groupBy("cell", "cut").applyInPandas(gather, kind))
    near = sizes.select(F.col("cell").alias("a"), "cell")
    for axis in range(1, CELL_AXES + 1):
        step = f"if(k = {axis}, v + step, v)"
        near = near.withColumn("step", F.explode(F.array(*(F.lit(k) for k in (-1, 0, 1)))))
        near = near.withColumn("cell", F.expr(f"transform(cell, (v, k) -> {step})")).drop("step")
    near = near.distinct()
    mine = blocks.select(F.col("cell").alias("a"), F.col("cut").alias("cut_a"))
    theirs = blocks.select("cell", F.col("cut").alias("cut_b"))
    pairs = near.join(mine, "a").join(theirs, "cell")
    ordered = (F.col("a") < F.col("cell")) | ((F.col("a") == F.col("cell")) & (F.col("cut_a") <= F.col("cut_b")))
    return blocks, pairs.where(ordered).select("a", "cut_a", F.col("cell").alias("b"), "cut_b")


def _compare(pairs: DataFrame, axes: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """(key, links, root_key) of every vector that has a link within its pair of blocks."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                a, b = (np.frombuffer(r[k]).reshape(-1, r["dim"]) for k in ("units_a", "units_b"))
                wa, wb = np.array(r["weights_a"]), np.array(r["weights_b"])
                same = r["same"]
                links_a, links_b, root = compare_blocks(a, b, wa, wb, axes[r["dim"]], same, threshold)
                keys = r["keys_a"] if same else r["keys_a"] + r["keys_b"]
                count = links_a if same else np.concatenate([links_a, links_b])
                on = np.nonzero(count)[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[k] for k in on], pa.binary()), pa.array(count[on]), pa.array([keys[k] for k in root[on]], pa.binary())],
                    ["key", "links", "root_key"],
                )

    return pairs.mapInArrow(run, "key binary, links long, root_key binary")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of ``vectors``.

    Equal vectors are one node with a weight, so copies are never paired with each other.
    Null, empty and zero vectors, and those with null or non-finite components, link with
    nothing; vectors of different length neither. component_id is the smallest id of what is
    linked; null ids do not count, a row with a null id is not kept unless it is alone, and
    then its component_id is null too.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), _units(embedding).alias("u"))
    rows = settle_table(rows.select("vec_id", F.sha2("u.key", 256).alias("key"), "u.unit"))
    nodes = rows.where("key is not null").groupBy("key").agg(
        F.first("unit").alias("unit"), F.count("*").alias("weight"), F.min("vec_id").alias("first_id")
    )
    nodes = settle_table(nodes.withColumn("key", F.unhex("key")))
    axes = principal_axes(nodes)
    blocks, near = _blocks(nodes.select("key", "unit", "weight"), axes, threshold, block)
    sides = [blocks.select(F.col("cell").alias(s), F.col("cut").alias(f"cut_{s}"), *(["dim"] if s == "a" else []),
                           *(F.col(c).alias(f"{c}_{s}") for c in ("keys", "weights", "units"))) for s in "ab"]
    pairs = near.join(sides[0], ["a", "cut_a"]).join(sides[1], ["b", "cut_b"])
    pairs = pairs.withColumn("same", (F.col("a") == F.col("b")) & (F.col("cut_a") == F.col("cut_b")))
    found = settle_table(_compare(pairs.drop("a", "b", "cut_a", "cut_b"), axes, threshold))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("key").alias("a"), F.col("root_key").alias("b")))
    member = nodes.select("key", "weight", "first_id").join(links, "key", "left")
    member = member.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    member = member.join(least, "root").select(
        F.lower(F.hex("key")).alias("key"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"
    )
    out = rows.select("vec_id", "key").join(settle_table(member), "key", "left")
    single = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), single.alias("component_id"),
        F.col("vec_id").eqNullSafe(single).alias("kept"),
    )
