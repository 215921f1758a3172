"""Workshop-hours arithmetic as closed-form column expressions.

An instant is mapped to the number of open seconds since a fixed Monday; adding work
is then a plain addition, and the result is mapped back. No loop, no Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bayworks.config import Config
from bayworks.functions.scalars import col

_MONDAY_EPOCH = 4 * 86_400  # 1970-01-05 was a Monday
_DAY = 86_400


def _open_seconds(ts: Column, cfg: Config) -> Column:
    per_day = (cfg.close_hour - cfg.open_hour) * 3600
    per_week = per_day * cfg.open_weekdays
    seconds = F.unix_micros(ts) / F.lit(1e6) - F.lit(float(_MONDAY_EPOCH))
    day = F.floor(seconds / _DAY)
    week = F.floor(day / 7)
    weekday = day - week * 7
    in_day = F.least(
        F.greatest(seconds - day * _DAY - cfg.open_hour * 3600, F.lit(0.0)), F.lit(float(per_day))
    )
    worked = F.when(weekday >= cfg.open_weekdays, F.lit(0.0)).otherwise(in_day)
    return week * per_week + F.least(weekday, F.lit(cfg.open_weekdays)) * per_day + worked


def _instant(open_seconds: Column, cfg: Config, at_close: Column) -> Column:
    """Inverse of the mapping; ``at_close`` keeps a day boundary at closing time."""
    per_day = (cfg.close_hour - cfg.open_hour) * 3600
    whole = F.floor(open_seconds / per_day)
    rest = open_seconds - whole * per_day
    boundary = at_close & (F.abs(rest) < 1e-6)
    day_no = F.when(boundary, whole - 1).otherwise(whole)
    rest = F.when(boundary, F.lit(float(per_day))).otherwise(rest)
    week = F.floor(day_no / cfg.open_weekdays)
    calendar_day = week * 7 + (day_no - week * cfg.open_weekdays)
    seconds = calendar_day * _DAY + cfg.open_hour * 3600 + rest + _MONDAY_EPOCH
    return F.timestamp_micros(F.round(seconds * 1e6).cast("bigint"))


def align_to_open(ts: Column | str, cfg: Config) -> Column:
    """Earliest moment at or after ``ts`` when the workshop is open."""
    return _instant(_open_seconds(col(ts), cfg), cfg, F.lit(False))


def add_work_hours(ts: Column | str, hours: Column | str, cfg: Config) -> Column:
    """Advance ``ts`` by ``hours`` of open time; work ending at closing stays on that day."""
    work = F.greatest(col(hours).cast("double"), F.lit(0.0))
    start = _open_seconds(col(ts), cfg)
    moved = _instant(start + work * 3600, cfg, F.lit(True))
    return F.when(work > 1e-9, moved).when(col(hours).isNotNull(), align_to_open(ts, cfg))


def round_quarter(c: Column | str) -> Column:
    """Nearest quarter hour (half to even), never below a quarter."""
    return F.greatest(F.lit(0.25), F.bround(col(c).cast("double") * 4) / 4)
