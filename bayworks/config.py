"""Business constants, kept in one frozen object that every operator receives."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

# ---- fixed values -------------------------------------------------------------
# Labels and thresholds that must equal the published KPI definitions.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
LEAD_BANDS = ("Same day", "1-3 days", "4-7 days", "8-14 days", "15+ days")
LEAD_EDGES = (0, 3, 7, 14)
LATE_EDGES = (0, 1, 2, 4, 8, 24)
TURNAROUND_EDGES = (2, 4, 8, 24, 72)
LOAD_EDGES = (0.0, 0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.4, 1.6)
SKILLS = ("Junior", "Mid", "Senior", "Master")
STATUSES = ("Completed", "Cancelled", "No-Show")
STATUS_ALIASES = {
    "completed": "Completed",
    "cancelled": "Cancelled",
    "canceled": "Cancelled",
    "no-show": "No-Show",
    "no show": "No-Show",
    "noshow": "No-Show",
}
REGIONS = ("North", "South", "East", "West")
CUSTOMER_TYPES = ("Individual", "Corporate", "Fleet")
REWORK = "Rework (No Charge)"
BILLING_TYPES = ("Customer Paid", "Service Plan", "Warranty", REWORK)
COMPLEX_TYPES = (
    "Motor & Controller Repair",
    "Charging System Repair",
    "Electrical Diagnostics",
    "Accident & Body Repair",
)
# -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Config:
    """Thresholds, calendars and label domains.

    The defaults are the published ones. Model names differ per network, so the alias
    map (lower-case spelling -> canonical name) and launch years are always given.
    """

    period_start: date = date(2025, 1, 1)
    period_end: date = date(2026, 9, 30)
    open_hour: int = 9
    close_hour: int = 19
    open_weekdays: int = 6  # Monday..Saturday
    productive_hours: float = 7.0
    repeat_window_days: int = 30
    promise_buffer_hours: float = 1.5
    max_km_per_day: int = 250
    overrun_threshold: float = 0.10
    csat_threshold: int = 4
    repeat_min_orders: int = 2
    revenue_shift_ratio: int = 10
    revenue_shift_floor: int = 50_000
    focus_year: int = 2026
    compare_months: int = 9
    walk_in: str = "Walk-in"
    periodic_type: str = "Periodic Service"
    fleet_type: str = "Fleet"
    complex_types: tuple[str, ...] = COMPLEX_TYPES
    skills: tuple[str, ...] = SKILLS
    statuses: tuple[str, ...] = STATUSES
    status_aliases: dict[str, str] = field(default_factory=lambda: dict(STATUS_ALIASES))
    regions: tuple[str, ...] = REGIONS
    customer_types: tuple[str, ...] = CUSTOMER_TYPES
    billing_types: tuple[str, ...] = BILLING_TYPES
    model_aliases: dict[str, str] = field(default_factory=dict)
    model_first_year: dict[str, int] = field(default_factory=dict)

    @property
    def base_year(self) -> int:
        return self.focus_year - 1

    @property
    def months(self) -> tuple[str, ...]:
        """Every ``yyyy-MM`` of the reporting period."""
        first = self.period_start.year * 12 + self.period_start.month - 1
        last = self.period_end.year * 12 + self.period_end.month - 1
        return tuple(f"{m // 12:04d}-{m % 12 + 1:02d}" for m in range(first, last + 1))

    @property
    def month_days(self) -> dict[str, int]:
        """Working days of each month that lie inside the reporting period."""
        out = dict.fromkeys(self.months, 0)
        for n in range(self.period_start.toordinal(), self.period_end.toordinal() + 1):
            day = date.fromordinal(n)
            out[f"{day:%Y-%m}"] += day.weekday() < self.open_weekdays
        return out

    @property
    def working_days(self) -> int:
        return sum(self.month_days.values())
