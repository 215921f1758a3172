"""Documented data-entry defects, injected for testing the cleaning rules.

Rows are chosen by arithmetic on their key, so the choice is the same on every run and on
every partitioning; nothing is sampled through the driver. Rates are per ten thousand rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bayworks.config import Config
from bayworks.operators.validate import union_all
from bayworks.sources.schemas import DATE_COLUMNS, FLAG_COLUMNS, PRIMARY_KEYS

Tables = Mapping[str, DataFrame]

# ---- fixed values: defect rate per 10,000 rows -----------------------------------
RATES = {
    "customers": {"region_format_variants": 100, "duplicate_rows": 40},
    "vehicles": {"impossible_model_year": 40, "impossible_mileage": 30, "model_name_variants": 50},
    "appointments": {
        "status_format_variants": 40, "ddmmyyyy_dates": 80, "missing_center_id": 15,
        "orphan_vehicle_id": 10, "duplicate_rows": 60,
    },
    "work_orders": {
        "start_end_swapped": 25, "missing_technician_id": 20, "orphan_technician_id": 10,
        "missing_start_time": 10, "service_type_format_variants": 50, "duplicate_rows": 40,
    },
    "financials": {
        "negative_amounts": 20, "missing_parts_cost": 15, "revenue_decimal_shift_x100": 10,
        "duplicate_rows": 30,
    },
    "feedback": {"rating_out_of_range": 40, "missing_rating": 20, "duplicate_rows": 30},
    "part_usage": {"non_positive_quantity": 20, "orphan_part_id": 5},
}
# ------------------------------------------------------------------------------------
ORPHAN_OFFSET = 10**12
PRIME, STEP, TAG_STEP = 2_147_483_647, 48_271, 7_919


def key_number(df: DataFrame, key: str) -> Column:
    """A non-negative integer per key: the key itself, or its hash when it is text."""
    if isinstance(df.schema[key].dataType, T.StringType):
        return F.pmod(F.xxhash64(key), F.lit(PRIME))
    return F.col(key)


def draw(number: Column, tag: int) -> Column:
    """0..9999, evenly spread over the keys, different for every tag.

    The key is reduced before it is multiplied: the same remainder, and no key is too large.
    """
    return F.pmod(F.pmod(number, F.lit(PRIME)) * STEP + tag * TAG_STEP, F.lit(PRIME)) % 10_000


def _orphan(df: DataFrame, column: str) -> Column:
    if isinstance(df.schema[column].dataType, T.StringType):
        return F.concat(F.lit("X9"), F.col(column))
    return F.col(column) + ORPHAN_OFFSET


def to_text(df: DataFrame, table: str) -> DataFrame:
    """Dates, times and flags as they appear in an untyped extract."""
    types = {f.name: f.dataType for f in df.schema.fields}
    text = {
        c: F.date_format(c, "yyyy-MM-dd HH:mm:ss" if isinstance(types[c], T.TimestampType) else "yyyy-MM-dd")
        for c in DATE_COLUMNS.get(table, ())
    }
    text |= {c: F.initcap(F.col(c).cast("string")) for c in FLAG_COLUMNS.get(table, ())}
    return df.withColumns(text) if text else df


class Injector:
    """Marks and changes of one table, applied in few projections; every mark is counted."""

    def __init__(self, df: DataFrame, table: str, scale: int):
        self.table, self.scale = table, scale
        self.rates = RATES[table]
        self.names = df.columns
        self.source = df
        self.marks: list[list[tuple[str, Column]]] = [[]]
        self.changes: dict[str, list[tuple[str, Column]]] = {}

    def mark(self, tag: int, *defects: str, only: Column | None = None) -> Injector:
        """Mark rows for mutually exclusive defects drawn with one number.

        ``only`` may refer to earlier marks; such marks go into a projection of their own.
        """
        if only is not None and self.marks[-1]:
            self.marks.append([])
        value, low = draw(F.col("_k"), tag), 0
        allowed = F.lit(True) if only is None else F.coalesce(only, F.lit(False))
        for defect in defects:
            high = low + self.rates[defect] * self.scale
            self.marks[-1].append((f"_is_{defect}", allowed & (value >= low) & (value < high)))
            low = high
        return self

    def change(self, defect: str, **columns: Column) -> Injector:
        """Replace columns of the marked rows; all changes read the original values."""
        for name, value in columns.items():
            self.changes.setdefault(name, []).append((f"_is_{defect}", value))
        return self

    def marked(self) -> DataFrame:
        number = key_number(self.source, PRIMARY_KEYS[self.table])
        df = to_text(self.source, self.table).withColumn("_k", number)
        for group in self.marks:
            df = df.select("*", *[mark.alias(name) for name, mark in group])
        return df

    def counts(self) -> DataFrame:
        names = [name for group in self.marks for name, _ in group]
        one = self.marked().agg(*[F.count_if(F.col(m)).alias(m) for m in names])
        pairs = [
            F.struct(
                F.lit(self.table).alias("table"),
                F.lit(m[4:]).alias("injected_defect"),
                F.col(m).alias("injected"),
            )
            for m in names
        ]
        return one.select(F.inline(F.array(*pairs)))

    def rows(self) -> DataFrame:
        df = self.marked()
        out = []
        for name in self.names:
            value = F.col(name)
            for defect, new in self.changes.get(name, []):
                value = F.when(F.col(defect), new).otherwise(value)
            out.append(value.alias(name))
        if "duplicate_rows" not in self.rates:
            return df.select(*out)
        # a full copy of a drawn row: the row is emitted twice
        once, twice = F.array(F.lit(1)), F.array(F.lit(1), F.lit(2))
        copies = F.when(F.col("_is_duplicate_rows"), twice).otherwise(once)
        return df.select(*out, F.explode(copies).alias("_copy")).drop("_copy")


def _other(value: Column, original: str) -> Column:
    """A spelling that differs from the original, else the original with a trailing blank."""
    return F.when(value != F.col(original), value).otherwise(F.concat(original, F.lit(" ")))


def _cases(*values: Column) -> Column:
    """Spelling variant number key mod n."""
    turn = F.col("_k") % len(values)
    chain = F.when(turn == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        chain = chain.when(turn == i, v)
    return chain


def _customers(df: DataFrame, cfg: Config, scale: int) -> Injector:
    blank = F.lit(" ")
    region = _cases(
        _other(F.upper("region"), "region"), F.lower("region"), F.concat(blank, "region", blank)
    )
    return (
        Injector(df, "customers", scale)
        .mark(1, "region_format_variants")
        .mark(2, "duplicate_rows")
        .change("region_format_variants", region=region)
    )


def _vehicles(df: DataFrame, cfg: Config, scale: int) -> Injector:
    k, blank = F.col("_k"), F.lit(" ")
    launch = F.create_map(*[F.lit(x) for kv in cfg.model_first_year.items() for x in kv])
    year = F.element_at(launch, F.col("model")) - 1 - k % 3
    mileage = _cases(-(100 + k % 4900), cfg.max_km_per_day * 10_000 + k % 500_000)
    model = _cases(
        F.lower("model"), F.concat(F.upper("model"), blank), F.concat(blank, F.lower("model"))
    )
    return (
        Injector(df, "vehicles", scale)
        .mark(3, "impossible_model_year", "impossible_mileage")
        .mark(4, "model_name_variants")
        .change("impossible_model_year", model_year=year.cast("smallint"))
        .change("impossible_mileage", mileage_km=mileage.cast("decimal(10,1)"))
        .change("model_name_variants", model=model)
    )


def _appointments(df: DataFrame, cfg: Config, scale: int) -> Injector:
    c = F.col
    short = (
        F.when(c("status") == "Cancelled", "Canceled")
        .when(c("status") == "No-Show", "No Show")
        .otherwise(F.concat(F.lit(" "), "status"))
    )
    day, month, year = [F.substring("scheduled_date", a, n) for a, n in ((9, 2), (6, 2), (1, 4))]
    return (
        Injector(df, "appointments", scale)
        .mark(5, "status_format_variants")
        .mark(6, "ddmmyyyy_dates")
        .mark(9, "duplicate_rows")
        .mark(7, "missing_center_id", only=c("status") == "Completed")
        .mark(8, "orphan_vehicle_id", only=~c("_is_missing_center_id"))
        .change("status_format_variants", status=_cases(F.lower("status"), F.upper("status"), short))
        .change("ddmmyyyy_dates", scheduled_date=F.concat_ws("/", day, month, year))
        .change("missing_center_id", center_id=F.lit(None))
        .change("orphan_vehicle_id", vehicle_id=_orphan(df, "vehicle_id"))
    )


def _work_orders(df: DataFrame, cfg: Config, scale: int) -> Injector:
    c, blank = F.col, F.lit(" ")
    intact = ~c("_is_start_end_swapped") & c("technician_id").isNotNull() & c("start_time").isNotNull()
    spelled = _cases(
        F.lower("service_type"),
        F.concat(blank, "service_type"),
        _other(F.replace("service_type", blank, F.lit("  ")), "service_type"),
        F.concat("service_type", blank),
    )
    return (
        Injector(df, "work_orders", scale)
        .mark(12, "service_type_format_variants")
        .mark(13, "duplicate_rows")
        .mark(10, "start_end_swapped", only=c("start_time").isNotNull())
        .mark(11, "missing_technician_id", "orphan_technician_id", "missing_start_time", only=intact)
        .change("start_end_swapped", start_time=c("end_time"), end_time=c("start_time"))
        .change("missing_technician_id", technician_id=F.lit(None))
        .change("orphan_technician_id", technician_id=_orphan(df, "technician_id"))
        .change("missing_start_time", start_time=F.lit(None))
        .change("service_type_format_variants", service_type=spelled)
    )


def _financials(df: DataFrame, cfg: Config, scale: int) -> Injector:
    c = F.col
    even = c("_k") % 2 == 0
    defects = ("negative_amounts", "missing_parts_cost", "revenue_decimal_shift_x100")
    return (
        Injector(df, "financials", scale)
        .mark(15, "duplicate_rows")
        .mark(14, *defects, only=c("revenue") > 0)
        .change(
            "negative_amounts",
            revenue=F.when(even, -c("revenue")).otherwise(c("revenue")),
            labor_cost=F.when(~even, -c("labor_cost")).otherwise(c("labor_cost")),
        )
        .change("missing_parts_cost", parts_cost=F.lit(None))
        .change("revenue_decimal_shift_x100", revenue=(c("revenue") * 100).cast("decimal(12,2)"))
    )


def _feedback(df: DataFrame, cfg: Config, scale: int) -> Injector:
    wrong = _cases(*map(F.lit, (0, 6, 10))).cast("smallint")
    return (
        Injector(df, "feedback", scale)
        .mark(16, "rating_out_of_range", "missing_rating")
        .mark(17, "duplicate_rows")
        .change("rating_out_of_range", rating=wrong)
        .change("missing_rating", rating=F.lit(None))
    )


def _part_usage(df: DataFrame, cfg: Config, scale: int) -> Injector:
    return (
        Injector(df, "part_usage", scale)
        .mark(18, "non_positive_quantity", "orphan_part_id")
        .change("non_positive_quantity", quantity=_cases(F.lit(0), F.lit(-1)))
        .change("orphan_part_id", part_id=_orphan(df, "part_id"))
    )


INJECTORS = {
    "customers": _customers,
    "vehicles": _vehicles,
    "appointments": _appointments,
    "work_orders": _work_orders,
    "financials": _financials,
    "feedback": _feedback,
    "part_usage": _part_usage,
}


class RawTables(Mapping[str, DataFrame]):
    """Raw twins of the ten tables, built on first use: text dates and documented defects."""

    def __init__(self, t: Tables, cfg: Config, scale: int = 1):
        self._t, self._cfg, self._scale = t, cfg, scale
        self._done: dict[str, DataFrame] = {}

    def __iter__(self):
        return iter(PRIMARY_KEYS)

    def __len__(self) -> int:
        return len(PRIMARY_KEYS)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._done:
            clean = self._t[name]
            if name in INJECTORS:
                self._done[name] = INJECTORS[name](clean, self._cfg, self._scale).rows()
            else:
                self._done[name] = to_text(clean, name)
        return self._done[name]


def inject(t: Tables, cfg: Config, scale: int = 1) -> RawTables:
    return RawTables(t, cfg, scale)


def manifest(t: Tables, cfg: Config, scale: int = 1) -> DataFrame:
    """(table, injected_defect, injected): how often each defect was made."""
    return union_all([make(t[name], cfg, scale).counts() for name, make in INJECTORS.items()])
