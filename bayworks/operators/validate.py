"""Counting operators: constraint violations and rule hits, one pass per table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bayworks.functions.scalars import flag
from bayworks.sources.schemas import PRIMARY_KEYS, TableRules

Tables = Mapping[str, DataFrame]


def counters(df: DataFrame, conditions: Mapping[str, Column], label: str = "rule", value: str = "n") -> DataFrame:
    """Rows satisfying each condition, from a single aggregation, in long form."""
    names = list(conditions)
    one = df.agg(*[F.count_if(flag(conditions[n])).alias(f"c{i}") for i, n in enumerate(names)])
    pairs = [F.struct(F.lit(n).alias(label), F.col(f"c{i}").alias(value)) for i, n in enumerate(names)]
    return one.select(F.inline(F.array(*pairs)))


def duplicated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str, nulls: bool = True) -> DataFrame:
    """Child rows without a parent row; null references count unless ``nulls`` is off."""
    if not nulls:
        child = child.where(F.col(column).isNotNull())
    lookup = parent.select(F.col(key).alias("_pk"))
    return child.join(lookup, F.col(column) == F.col("_pk"), "left_anti")


def one_count(df: DataFrame, label: str, name: str, value: str = "n") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(value)).select(F.lit(name).alias(label), value)


@dataclass(frozen=True)
class Use:
    """A column of keys: where it stands, and for which rows."""

    table: str
    column: str
    rows: str | None = None


@dataclass(frozen=True)
class KeyCheck:
    """Counts, for one key of ``space``, how it breaks a rule: ``broken`` gets the number of rows of each use.

    ``broken(rows, lost)`` returns a count; ``lost`` is true for the null key, which equals none.
    """

    space: str
    uses: tuple[Use, ...]
    broken: Callable[[Callable[[Use], Column], Column], Column]


def repeated_key(space: str, use: Use) -> KeyCheck:
    """Keys that stand in more than one row."""
    return KeyCheck(space, (use,), lambda rows, lost: (rows(use) > 1).cast("long"))


def lost_key(space: str, child: Use, parent: Use, nulls: bool = True) -> KeyCheck:
    """Rows of ``child`` whose key ``parent`` lacks; null keys count unless ``nulls`` is off."""
    return KeyCheck(space, (child, parent), lambda rows, lost: F.when(lost, rows(child) if nulls else F.lit(0)).when(rows(parent) == 0, rows(child)))


def met_key(space: str, one: Use, other: Use) -> KeyCheck:
    """Pairs of rows of two uses with the same key."""
    return KeyCheck(space, (one, other), lambda rows, lost: F.when(~lost, rows(one) * rows(other)))


def compiled_checks(tables: Tables, by_row: Mapping[str, Mapping[str, Column]], by_key: Mapping[str, Sequence[KeyCheck]], label: str = "check_id") -> DataFrame:
    """(label, n) of every check, zeros included, from one pass over each table and one grouping.

    A row gives one tag for each key it holds and for each row check that it breaks. Tags are
    summed by key on the sending side, so a key that many rows share costs one row a task;
    each key is then judged by itself, and only what it breaks goes on. A check may be listed
    in several tables or key checks; its counts add up.
    """
    uses: dict[str, list[Use]] = {}
    for check in (c for checks in by_key.values() for c in checks):
        known = uses.setdefault(check.space, [])
        known += [u for u in check.uses if u not in known]
    tags: dict[str, list[Column]] = {}

    def tag(table: str, space: str, key: Column, role: int, when: Column | None = None) -> None:
        made = F.struct(F.lit(space).alias("space"), key.cast("string").alias("key"), F.lit(role).alias("role"))
        tags.setdefault(table, []).append(made if when is None else F.when(flag(when), made))

    for table, conditions in by_row.items():
        for name, condition in conditions.items():
            tag(table, "", F.lit(name), 0, condition)
    for space, known in uses.items():
        for role, use in enumerate(known):
            tag(use.table, space, F.col(use.column), role, F.expr(use.rows) if use.rows else None)
    found = union_all([tables[t].select(F.inline(F.array_compact(F.array(*made)))) for t, made in tags.items()])
    most = max((len(known) for known in uses.values()), default=1)
    summed = found.groupBy("space", "key").agg(*[F.count_if(F.col("role") == i).alias(f"r{i}") for i in range(most)])
    broken = F.when(F.col("space") == "", F.array(F.struct(F.col("key").alias(label), F.col("r0").alias("n"))))
    for space, known in uses.items():
        rows = lambda use, known=known: F.col(f"r{known.index(use)}")
        one = [
            F.struct(F.lit(name).alias(label), F.coalesce(c.broken(rows, F.col("key").isNull()), F.lit(0)).cast("long").alias("n"))
            for name, checks in by_key.items() for c in checks if c.space == space
        ]
        broken = broken.when(F.col("space") == space, F.filter(F.array(*one), lambda x: x["n"] > 0))
    names = list(dict.fromkeys([*(n for conditions in by_row.values() for n in conditions), *by_key]))
    none = F.array(*[F.struct(F.lit(n).alias(label), F.lit(0).cast("long").alias("n")) for n in names])
    zero = found.sparkSession.range(1).select(F.inline(none))
    return summed.select(F.inline(broken)).unionByName(zero).groupBy(label).agg(F.sum("n").alias("n"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def validate(tables: Tables, rules: Sequence[TableRules]) -> DataFrame:
    """(table, constraint, violations) for every declared constraint."""
    out = []
    for rule in rules:
        df, key = tables[rule.table], PRIMARY_KEYS[rule.table]
        conditions = {f"not null {c}": F.col(c).isNull() for c in rule.not_null}
        conditions |= {f"check {n}": ~cond for n, cond in rule.checks.items()}
        found = [counters(df, conditions, "constraint", "violations")]
        found.append(one_count(duplicated(df, [key]), "constraint", f"primary key {key}", "violations"))
        for c in rule.unique:
            repeated = duplicated(df.where(F.col(c).isNotNull()), [c])
            found.append(one_count(repeated, "constraint", f"unique {c}", "violations"))
        for c, parent, pk in rule.foreign:
            lost = orphans(df, c, tables[parent], pk, nulls=False)
            found.append(one_count(lost, "constraint", f"foreign key {c}", "violations"))
        out.append(union_all(found).select(F.lit(rule.table).alias("table"), "constraint", "violations"))
    return union_all(out)
