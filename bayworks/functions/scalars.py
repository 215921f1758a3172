"""Column library: text, dates, ratios, bands. Everything stays inside JVM expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3_600_000_000
MICROS_PER_DAY = 24 * MICROS_PER_HOUR


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- text ---------------------------------------------------------------------
def normalise_text(c: Column | str) -> Column:
    """Trimmed, inner whitespace collapsed; null stays null."""
    return F.trim(F.regexp_replace(col(c).cast("string"), r"\s+", " "))


def alias_lookup(c: Column | str, aliases: Mapping[str, str]) -> Column:
    """Canonical label for a spelling variant, null when the variant is unknown."""
    if not aliases:
        return F.lit(None).cast("string")
    pairs = [F.lit(x) for kv in aliases.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(normalise_text(c)))


def canonical_label(c: Column | str, labels: Sequence[str]) -> Column:
    """Match a label regardless of case and spacing, null when it is not one of ``labels``."""
    return alias_lookup(c, {label.lower(): label for label in labels})


def parse_bool(c: Column | str) -> Column:
    """Only the words true and false count; anything else is null."""
    word = F.lower(F.trim(col(c).cast("string")))
    return F.when(word == "true", True).when(word == "false", False)


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


# ---- dates and times ----------------------------------------------------------
def iso_timestamp(c: Column | str) -> Column:
    return F.try_to_timestamp(col(c).cast("string"))


def parse_datetime(c: Column | str) -> Column:
    """ISO text first, then day/month/year text, else null."""
    text = col(c).cast("string")
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("dd/MM/yyyy")))


def elapsed_hours(start: Column | str, end: Column | str) -> Column:
    """Decimal hours between two time stamps, negative when reversed."""
    return (F.unix_micros(col(end)) - F.unix_micros(col(start))) / F.lit(float(MICROS_PER_HOUR))


def elapsed_days(start: Column | str, end: Column | str) -> Column:
    """Whole days, floored (so an earlier end gives a negative number)."""
    gap = F.unix_micros(col(end)) - F.unix_micros(col(start))
    return F.floor(gap / F.lit(float(MICROS_PER_DAY))).cast("int")


def year_month(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM")


def weekday_name(c: Column | str) -> Column:
    return F.date_format(col(c), "EEEE")


def iso_weekday(c: Column | str) -> Column:
    return (F.weekday(col(c)) + 1).cast("int")


def weekday_name_of_number(iso: Column | str) -> Column:
    """Name of ISO weekday 1..7 (2024-12-29 was a Sunday)."""
    return F.date_format(F.date_add(F.lit("2024-12-29").cast("date"), col(iso)), "EEEE")


def age_years(start: Column | str, end: Column | str) -> Column:
    return F.datediff(col(end), col(start)) / F.lit(365.25)


# ---- ratios and exact averages ------------------------------------------------
def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Double quotient; null when the denominator is zero or missing."""
    return F.try_divide(col(numerator).cast("double"), col(denominator).cast("double"))


def mean(c: Column | str) -> Column:
    """Average from an exact (decimal or integer) sum, so it does not depend on row order."""
    return ratio(F.sum(col(c)), F.count(col(c)))


def share(flag: Column | str) -> Column:
    """Share of true among the non-null values of a boolean."""
    return mean(col(flag).cast("int"))


def count_true(flag: Column | str) -> Column:
    return F.count_if(col(flag))


def flag(condition: Column) -> Column:
    """Comparison in which an unknown result counts as false."""
    return F.coalesce(condition, F.lit(False))


def rounded_to(c: Column | str, digits: int) -> Column:
    """Round half away from zero at a decimal place.

    Scaling first makes 2.675 behave as written; ``round`` alone sees the binary value just
    below it. Doubles whose scaled product is itself below the half (1.005) still round down.
    """
    scale = float(10**digits)
    return F.round(col(c).cast("double") * scale) / scale


def percentage(c: Column, digits: int = 2) -> Column:
    return rounded_to(c * 100.0, digits)


def fixed(c: Column, digits: int, precision: int = 18) -> Column:
    """Round a double and keep it as an exact decimal."""
    return rounded_to(c, digits).cast(f"decimal({precision},{digits})")


# ---- bands --------------------------------------------------------------------
def band_labels(edges: Sequence[float], first: str | None = None) -> list[str]:
    """Labels of the right-closed hour bands cut at ``edges``."""
    inner = [f"{lo:g}-{hi:g}h" for lo, hi in zip(edges, edges[1:])]
    return [first or f"<= {edges[0]:g}h", *inner, f"> {edges[-1]:g}h"]


def band(c: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed banding: one label per edge, plus one for values above the last edge."""
    value = col(c)
    chain = F.when(value.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(edges, labels):
        chain = chain.when(value <= edge, label)
    return chain.otherwise(labels[-1]) if len(labels) > len(edges) else chain


def load_band_labels(edges: Sequence[float]) -> list[str]:
    text = [f"{e:g}" if e else "0" for e in edges]
    pairs = [f"({lo}, {hi}]" for lo, hi in zip(text, text[1:])]
    return [*pairs, f"({text[-1]}, inf]"]


def load_band(c: Column | str, edges: Sequence[float]) -> Column:
    """Load-ratio interval; zero and negative loads have no band."""
    value = col(c)
    return F.when(value > edges[0], band(value, edges[1:], load_band_labels(edges)))


def position_in(c: Column | str, labels: Sequence[str]) -> Column:
    """1-based place of a label in a fixed order, 0 when it is not listed."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, labels)), col(c)), F.lit(0)).cast("int")


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
