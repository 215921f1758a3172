"""Rule-based cleaning (DQ01-DQ20) with an audit log.

Each cleaner computes its rule hits as columns, in rule order, on rows that are still kept;
log entries and clean rows come from one fold by primary key. Duplicates are folded by aggregation, so a key with very many copies is
pre-aggregated before the shuffle. "First" means the smallest ``_ord`` when the input has
one (see ``with_ordinal``), else the smallest row by value.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bayworks.config import Config
from bayworks.functions.scalars import (
    alias_lookup,
    canonical_label,
    flag,
    iso_timestamp,
    normalise_text,
    parse_bool,
    parse_datetime,
    rounded_to,
)
from bayworks.operators.validate import counters, one_count, orphans, union_all
from bayworks.sources.schemas import DATE_COLUMNS, FLAG_COLUMNS, PRIMARY_KEYS

Tables = Mapping[str, DataFrame]
Store = Callable[[DataFrame], DataFrame]
LOG_COLUMNS = ("rule_id", "table", "column", "issue", "action", "rows_affected")
_COPIES = "_copies"
_ORD = "_ord"


@dataclass
class Entry:
    rule: str
    column: str
    issue: str
    action: str


# ---- fixed values: issue and action texts of the log, as published -------------
LOG_TEXTS = {
    "DQ01 *": ("Exact duplicate rows", "Removed"),
    "DQ02 key": ("Duplicate primary key with conflicting values", "Kept first occurrence"),
    "DQ03 region": ("Case/whitespace variants", "Standardised to canonical region"),
    "DQ03 model": ("Model name variants", "Mapped to canonical model name"),
    "DQ15 model_year": ("Model year before model launch or after purchase", "Imputed from purchase_date year"),
    "DQ16 mileage_km": ("Negative or > {max_km_per_day} km/day since purchase", "Set to null (excluded from mileage analysis)"),
    "DQ20 status": ("Status spelling/case variants", "Mapped to Completed/Cancelled/No-Show"),
    "DQ04 scheduled_date": ("DD/MM/YYYY format mixed with ISO", "Parsed to ISO date"),
    "DQ05 scheduled_date": ("Unparseable or outside reporting period", "Removed"),
    "DQ05 booking_date": ("Booking after scheduled date", "Capped at scheduled date"),
    "DQ06 vehicle_id": ("Vehicle not in vehicle master (orphan FK)", "Removed with dependent rows"),
    "DQ07 center_id": ("Missing service centre", "Imputed from assigned technician's centre"),
    "DQ07 center_id again": ("Missing service centre with no technician to infer from", "Removed"),
    "DQ03 service_type": ("Case/whitespace variants", "Standardised to canonical service type"),
    "DQ08 start_time/end_time": ("End time earlier than start time", "Treated as transposed entry and swapped"),
    "DQ09 start_time": ("Missing start time", "Retained; wait_hours null and excluded from wait KPIs"),
    "DQ10 technician_id": ("Technician missing or not in technician master", "Set to null; kept for financial KPIs, excluded from technician KPIs"),
    "DQ17 quantity": ("Zero or negative quantity", "Removed"),
    "DQ17 part_id": ("Part not in parts master", "Removed"),
    "DQ11 amount": ("Negative amount", "Sign-entry error: converted to absolute value"),
    "DQ12 parts_cost": ("Missing parts cost", "Recomputed from part_usage x unit_cost"),
    "DQ13 revenue": ("Revenue > {revenue_shift_ratio}x job cost and > INR {revenue_shift_floor:,}", "Decimal-place entry error: divided by 100"),
    "DQ19 parts_cost": ("Parts cost differs from sum of part_usage lines", "Reported only; financials kept as billing system of record"),
    "DQ14 rating": ("Missing rating", "Removed"),
    "DQ14 rating again": ("Rating outside 1-5 scale", "Removed"),
    "DQ02 work_order_id": ("More than one feedback per work order", "Kept first"),
}
CASCADE = "Removed (cascade)"
# --------------------------------------------------------------------------------


def log_entry(key: str, column: str, cfg: Config | None = None) -> Entry:
    """The log entry of a rule; the key names rule and column, numbers come from ``cfg``."""
    issue, action = LOG_TEXTS[key]
    return Entry(key.split()[0], column, issue.format(**vars(cfg)) if cfg else issue, action)


@dataclass
class Cleaned:
    """Clean rows and the pending log of one table."""

    table: str
    rows: DataFrame
    log: list[DataFrame] = field(default_factory=list)


def with_ordinal(df: DataFrame, files: bool = False) -> DataFrame:
    """Remember the input order for keep-first rules.

    Of a frame read from ``files`` it is path, start of the block in the file, then position:
    splits are handed to tasks by size, so row numbers alone would not follow the files.
    """
    row = F.monotonically_increasing_id()
    if files:
        at = F.col("_metadata")
        row = F.struct(at["file_path"].alias("path"), at["file_block_start"].alias("start"), row.alias("row"))
    return df.withColumn(_ORD, row)


def as_is(df: DataFrame) -> DataFrame:
    return df


class Stage:
    """Rows of one table on their way through the rules.

    Removal only clears ``_alive``, so every rule is a 0/1 column of one plan. The final fold
    by primary key sums those columns and picks the first surviving row: log and clean rows
    both come from that one result.
    """

    def __init__(self, df: DataFrame, table: str, store: Store):
        self.table, self.key, self.store = table, PRIMARY_KEYS[table], store
        self.names = [c for c in df.columns if c != _ORD]
        self.notes: list[tuple[Entry, str]] = []
        self.log: list[DataFrame] = []
        order = [F.min(_ORD).alias(_ORD)] if _ORD in df.columns else []
        self.ordered = bool(order)
        self.df = (
            df.groupBy(*self.names)
            .agg((F.count(F.lit(1)) - 1).alias("_h0"), *order)
            .withColumn("_alive", F.lit(True))
        )
        self.notes.append((log_entry("DQ01 *", "*"), "_h0"))

    def note(self, entry: Entry, condition: Column) -> Column:
        """Record a rule hit on the rows still kept and return it as a condition."""
        name = f"_h{len(self.notes)}"
        self.df = self.df.withColumn(name, (F.col("_alive") & flag(condition)).cast("int"))
        self.notes.append((entry, name))
        return F.col(name) == 1

    def remove(self, entry: Entry, condition: Column) -> Stage:
        hit = self.note(entry, condition)
        return self.set(_alive=F.col("_alive") & ~hit)

    def set(self, **columns: Column) -> Stage:
        self.df = self.df.withColumns(columns)
        return self

    def lookup(self, column: str, parent: DataFrame, key: str, mark: str) -> Stage:
        """Left-join a unique key and mark whether it was found."""
        known = parent.select(F.col(key).alias("_pk"), F.lit(True).alias(mark))
        self.df = self.df.join(known, F.col(column) == F.col("_pk"), "left").drop("_pk")
        return self

    def cascade(self, column: str, parent: DataFrame, key: str, issue: str) -> Stage:
        self.lookup(column, parent, key, "_found")
        return self.remove(Entry("DQ18", column, issue, CASCADE), F.col("_found").isNull())

    def keep_first(self, key: str | None = None, entry: Entry | None = None) -> Stage:
        """Fold by key: first surviving row per key, hit counts, number of extra rows."""
        key = key or self.key
        entry = entry or log_entry("DQ02 key", key)
        rest = F.struct(*([_ORD] if self.ordered else []), *[c for c in self.names if c != key])
        alive = F.col("_alive") if "_alive" in self.df.columns else F.lit(True)
        folded = self.store(
            self.df.groupBy(key).agg(
                *[F.sum(name).alias(name) for _, name in self.notes],
                F.min(F.when(alive, rest)).alias("_r"),
                F.count_if(alive).alias("_n"),
            )
        )
        extra = F.greatest(F.col("_n") - 1, F.lit(0))
        lines = [(e, F.sum(n)) for e, n in self.notes] + [(entry, F.sum(extra))]
        one = folded.agg(*[F.coalesce(n, F.lit(0)).cast("bigint").alias(f"c{i}") for i, (_, n) in enumerate(lines)])
        base = 100 * len(self.log)
        entries = [
            F.struct(
                F.lit(base + i).alias("_seq"),
                *[
                    F.lit(x).alias(c)
                    for c, x in zip(LOG_COLUMNS, (e.rule, self.table, e.column, e.issue, e.action))
                ],
                F.col(f"c{i}").alias("rows_affected"),
            )
            for i, (e, _) in enumerate(lines)
        ]
        self.log.append(one.select(F.inline(F.array(*entries))))
        self.notes = []
        order = [F.col(f"_r.{_ORD}").alias(_ORD)] if self.ordered else []
        self.df = folded.where("_n > 0").select(
            *[F.col(c) if c == key else F.col(f"_r.{c}").alias(c) for c in self.names], *order
        )
        return self

    def done(self) -> Cleaned:
        return Cleaned(self.table, self.df.select(*self.names), self.log)


def changed(before: Column, after: Column) -> Column:
    """A value that was present and is now another one, or could not be mapped."""
    return before.isNotNull() & ~before.eqNullSafe(after)


# ---- tables -------------------------------------------------------------------------
def clean_customers(raw: DataFrame, cfg: Config, store: Store = as_is) -> Cleaned:
    s = Stage(raw, "customers", store)
    s.set(_region=canonical_label("region", cfg.regions))
    s.note(
        log_entry("DQ03 region", "region"),
        changed(F.col("region"), F.col("_region")),
    )
    s.set(
        region=F.col("_region"),
        customer_type=normalise_text("customer_type"),
        registration_date=F.to_date(parse_datetime("registration_date")),
    )
    return s.keep_first().done()


def clean_vehicles(raw: DataFrame, cfg: Config, store: Store = as_is) -> Cleaned:
    s = Stage(raw, "vehicles", store)
    c = F.col
    s.set(_model=alias_lookup("model", cfg.model_aliases))
    s.note(
        log_entry("DQ03 model", "model"),
        changed(c("model"), c("_model")),
    )
    s.set(model=c("_model"), purchase_date=F.to_date(parse_datetime("purchase_date")))
    first = F.try_element_at(
        F.create_map(*[F.lit(x) for kv in cfg.model_first_year.items() for x in kv]), c("model")
    )
    bought = F.year("purchase_date")
    bad_year = (
        flag(c("model_year") < first)
        | flag(c("model_year") > bought + 1)
        | flag(c("model_year") > cfg.period_end.year)
    )
    hit = s.note(
        log_entry("DQ15 model_year", "model_year"),
        bad_year,
    )
    s.set(model_year=F.when(hit, bought).otherwise(c("model_year")).cast("smallint"))
    limit = F.greatest(F.datediff(F.lit(cfg.period_end), c("purchase_date")), F.lit(1)) * cfg.max_km_per_day
    bad_km = flag(c("mileage_km") < 0) | (c("purchase_date").isNotNull() & flag(c("mileage_km") > limit))
    hit = s.note(
        log_entry("DQ16 mileage_km", "mileage_km", cfg),
        bad_km,
    )
    s.set(mileage_km=F.when(~hit, c("mileage_km")))
    return s.keep_first().done()


def technician_centre(raw_jobs: DataFrame, technicians: DataFrame) -> DataFrame:
    """Centre of the technician on an appointment's first raw job that names one."""
    order = F.struct(_ORD) if _ORD in raw_jobs.columns else F.struct("work_order_id", "technician_id")
    first = (
        raw_jobs.where(F.col("technician_id").isNotNull())
        .groupBy(F.col("appointment_id").alias("_appt"))
        .agg(F.min_by("technician_id", order).alias("_tech"))
    )
    staff = technicians.select(F.col("technician_id").alias("_tech"), F.col("center_id").alias("_centre"))
    return first.join(staff, "_tech").select("_appt", "_centre")


def clean_appointments(
    raw: DataFrame,
    vehicles: DataFrame,
    raw_jobs: DataFrame,
    technicians: DataFrame,
    cfg: Config,
    store: Store = as_is,
) -> Cleaned:
    s = Stage(raw, "appointments", store)
    c = F.col
    s.set(_status=alias_lookup("status", cfg.status_aliases))
    s.note(
        log_entry("DQ20 status", "status"),
        changed(c("status"), c("_status")),
    )
    s.set(status=c("_status"), _iso=iso_timestamp("scheduled_date"), _when=parse_datetime("scheduled_date"))
    s.note(
        log_entry("DQ04 scheduled_date", "scheduled_date"),
        c("_iso").isNull() & c("_when").isNotNull(),
    )
    s.set(scheduled_date=F.to_date("_when"), booking_date=F.to_date(parse_datetime("booking_date")))
    inside = flag(c("scheduled_date").between(F.lit(cfg.period_start), F.lit(cfg.period_end)))
    s.remove(
        log_entry("DQ05 scheduled_date", "scheduled_date"), ~inside
    )
    s.note(
        log_entry("DQ05 booking_date", "booking_date"),
        c("booking_date") > c("scheduled_date"),
    )
    capped = F.when(c("booking_date").isNotNull(), F.least("booking_date", "scheduled_date"))
    s.set(booking_date=capped)
    s.lookup("vehicle_id", vehicles, "vehicle_id", "_vehicle")
    s.remove(
        log_entry("DQ06 vehicle_id", "vehicle_id"),
        c("_vehicle").isNull(),
    )
    s.df = s.df.join(technician_centre(raw_jobs, technicians), c("appointment_id") == c("_appt"), "left")
    s.note(
        log_entry("DQ07 center_id", "center_id"),
        c("center_id").isNull() & c("_centre").isNotNull(),
    )
    s.set(center_id=F.coalesce("center_id", "_centre"))
    s.remove(
        log_entry("DQ07 center_id again", "center_id"),
        c("center_id").isNull(),
    )
    for name in ("booking_channel", "requested_service_type", "cancellation_reason"):
        s.set(**{name: normalise_text(name)})
    return s.keep_first().done()


def canonical_service_types(appointments: DataFrame) -> DataFrame:
    """Valid service types by lower-case spelling, taken from the cleaned bookings."""
    name = normalise_text("requested_service_type")
    return (
        appointments.select(name.alias("_canon"))
        .where(F.col("_canon").isNotNull())
        .groupBy(F.lower("_canon").alias("_lower"))
        .agg(F.max("_canon").alias("_canon"))
    )


def clean_work_orders(
    raw: DataFrame, appointments: DataFrame, technicians: DataFrame, cfg: Config, store: Store = as_is
) -> Cleaned:
    s = Stage(raw, "work_orders", store)
    c = F.col
    spelled = F.lower(normalise_text("service_type"))
    s.df = s.df.join(canonical_service_types(appointments), spelled == c("_lower"), "left")
    s.note(
        log_entry("DQ03 service_type", "service_type"),
        changed(c("service_type"), c("_canon")),
    )
    s.set(service_type=c("_canon"))
    for name in DATE_COLUMNS["work_orders"]:
        s.set(**{name: parse_datetime(name)})
    s.cascade(
        "appointment_id", appointments, "appointment_id", "Parent appointment removed or missing"
    )
    hit = s.note(
        log_entry("DQ08 start_time/end_time", "start_time/end_time"),
        c("end_time") < c("start_time"),
    )
    s.set(_start=c("start_time"))
    s.set(
        start_time=F.when(hit, c("end_time")).otherwise(c("start_time")),
        end_time=F.when(hit, c("_start")).otherwise(c("end_time")),
    )
    s.note(
        log_entry("DQ09 start_time", "start_time"),
        c("start_time").isNull(),
    )
    s.lookup("technician_id", technicians, "technician_id", "_staff")
    s.note(
        log_entry("DQ10 technician_id", "technician_id"),
        c("_staff").isNull(),
    )
    s.set(technician_id=F.when(c("_staff"), c("technician_id")))
    for name in FLAG_COLUMNS["work_orders"]:
        s.set(**{name: parse_bool(name)})
    return s.keep_first().done()


def clean_part_usage(
    raw: DataFrame, work_orders: DataFrame, parts: DataFrame, store: Store = as_is
) -> Cleaned:
    s = Stage(raw, "part_usage", store)
    s.remove(log_entry("DQ17 quantity", "quantity"), F.col("quantity") <= 0)
    s.lookup("part_id", parts, "part_id", "_part")
    s.remove(log_entry("DQ17 part_id", "part_id"), F.col("_part").isNull())
    s.cascade("work_order_id", work_orders, "work_order_id", "Parent work order removed")
    return s.keep_first().done()


def usage_cost(part_usage: DataFrame, parts: DataFrame) -> DataFrame:
    return (
        part_usage.join(parts.select("part_id", "unit_cost"), "part_id")
        .groupBy(F.col("work_order_id").alias("_job"))
        .agg(F.sum(F.col("quantity") * F.col("unit_cost")).cast("decimal(18,2)").alias("_usage"))
    )


def clean_financials(
    raw: DataFrame,
    work_orders: DataFrame,
    part_usage: DataFrame,
    parts: DataFrame,
    cfg: Config,
    store: Store = as_is,
) -> Cleaned:
    s = Stage(raw, "financials", store)
    c = F.col
    s.cascade("work_order_id", work_orders, "work_order_id", "Parent work order removed")
    for name in ("estimated_cost", "labor_cost", "parts_cost", "revenue"):
        s.note(
            log_entry("DQ11 amount", name), c(name) < 0
        )
        s.set(**{name: F.abs(name)})
    s.df = s.df.join(usage_cost(part_usage, parts), c("work_order_id") == c("_job"), "left")
    used = F.coalesce("_usage", F.lit(0)).cast("decimal(18,2)")
    s.note(
        log_entry("DQ12 parts_cost", "parts_cost"),
        c("parts_cost").isNull(),
    )
    s.set(parts_cost=F.coalesce("parts_cost", used).cast("decimal(12,2)"))
    cost = c("labor_cost") + c("parts_cost")
    hit = s.note(
        log_entry("DQ13 revenue", "revenue", cfg),
        (c("revenue") > cost * cfg.revenue_shift_ratio) & (c("revenue") > cfg.revenue_shift_floor),
    )
    s.set(
        revenue=F.when(hit, rounded_to(c("revenue") / 100, 2)).otherwise(c("revenue")).cast("decimal(12,2)")
    )
    s.note(
        log_entry("DQ19 parts_cost", "parts_cost"),
        F.abs(c("parts_cost") - used) > 1,
    )
    s.set(billing_type=normalise_text("billing_type"))
    return s.keep_first().done()


def clean_feedback(raw: DataFrame, work_orders: DataFrame, store: Store = as_is) -> Cleaned:
    s = Stage(raw, "feedback", store)
    s.remove(log_entry("DQ14 rating", "rating"), F.col("rating").isNull())
    s.remove(
        log_entry("DQ14 rating again", "rating"), ~F.col("rating").between(1, 5)
    )
    s.set(rating=F.col("rating").cast("smallint"))
    s.cascade("work_order_id", work_orders, "work_order_id", "Parent work order removed")
    s.set(
        feedback_date=F.to_date(parse_datetime("feedback_date")),
        feedback_category=normalise_text("feedback_category"),
    )
    s.keep_first()
    s.keep_first(
        "work_order_id", log_entry("DQ02 work_order_id", "work_order_id")
    )
    return s.done()


# ---- the whole pipeline ---------------------------------------------------------------
MASTERS = ("service_centers", "technicians", "parts")
ORDER = ("customers", "vehicles", "appointments", "work_orders", "part_usage", "financials", "feedback")


class Pipeline(Mapping[str, Cleaned]):
    """Cleans tables on first use, parents first.

    ``store`` is applied to each table's fold. The identity keeps everything lazy; a job
    that needs several outputs passes ``settle``, so that every table is computed once and
    children, log and facts read the stored result.
    """

    def __init__(self, raw: Tables, cfg: Config, store: Store = as_is):
        self.raw, self.cfg, self.store = raw, cfg, store
        self._done: dict[str, Cleaned] = {}

    def __iter__(self):
        return iter((*MASTERS, *ORDER))

    def __len__(self) -> int:
        return len(MASTERS) + len(ORDER)

    def __getitem__(self, name: str) -> Cleaned:
        if name not in self._done:
            self._done[name] = self._build(name)
        return self._done[name]

    def _build(self, name: str) -> Cleaned:
        raw, cfg, store = self.raw[name], self.cfg, self.store
        if name in MASTERS:
            return Cleaned(name, raw)
        if name == "customers":
            return clean_customers(raw, cfg, store)
        if name == "vehicles":
            return clean_vehicles(raw, cfg, store)
        staff = self.raw["technicians"]
        if name == "appointments":
            return clean_appointments(
                raw, self["vehicles"].rows, self.raw["work_orders"], staff, cfg, store
            )
        if name == "work_orders":
            return clean_work_orders(raw, self["appointments"].rows, staff, cfg, store)
        jobs = self["work_orders"].rows
        if name == "part_usage":
            return clean_part_usage(raw, jobs, self.raw["parts"], store)
        if name == "financials":
            return clean_financials(raw, jobs, self["part_usage"].rows, self.raw["parts"], cfg, store)
        return clean_feedback(raw, jobs, store)

    def rows(self) -> dict[str, DataFrame]:
        return {name: c.rows for name, c in self.items()}


def cleaning_log(cleaned: Mapping[str, Cleaned], tables: Sequence[str] = ORDER) -> DataFrame:
    """The audit log, one row per rule application, in processing order."""
    frames = [
        f.select(F.lit(i * 10_000).alias("_t"), "*") for i, n in enumerate(tables) for f in cleaned[n].log
    ]
    return union_all(frames).orderBy(F.col("_t") + F.col("_seq")).select(*LOG_COLUMNS)


def profile(tables: Tables) -> DataFrame:
    """Rows, exact duplicates, duplicate keys and null cells per raw table."""
    out = []
    for name, df in tables.items():
        names = [c for c in df.columns if c != _ORD]
        nulls = [F.coalesce(F.sum(F.when(F.col(c).isNull(), F.col(_COPIES))), F.lit(0)).alias(f"_{c}") for c in names]
        folded = df.groupBy(*names).agg(F.count(F.lit(1)).alias(_COPIES))
        keys = df.groupBy(PRIMARY_KEYS[name]).agg(F.count(F.lit(1)).alias("k"))
        rows = folded.agg(
            F.coalesce(F.sum(_COPIES), F.lit(0)).alias("raw_rows"),
            F.coalesce(F.sum(F.col(_COPIES) - 1), F.lit(0)).alias("exact_duplicates"),
            *nulls,
        )
        repeated = keys.agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("duplicate_keys"))
        texts = [
            F.when(F.col(f"_{c}") > 0, F.concat(F.lit(c), F.lit(" ("), F.col(f"_{c}").cast("string"), F.lit(")")))
            for c in names
        ]
        total = F.lit(0)
        for c in names:
            total = total + F.col(f"_{c}")
        listed = F.concat_ws(", ", *texts)
        out.append(
            rows.crossJoin(F.broadcast(repeated)).select(
                F.lit(name).alias("table"), "raw_rows", "exact_duplicates", "duplicate_keys",
                total.alias("null_cells"),
                F.when(listed == "", "-").otherwise(listed).alias("columns_with_nulls"),
            )
        )
    return union_all(out)


def retention(profiled: DataFrame, cleaned: Mapping[str, Cleaned]) -> DataFrame:
    """Rows kept and lost per table."""
    counts = union_all([one_count(c.rows, "table", n, "clean_rows") for n, c in cleaned.items()])
    return profiled.join(F.broadcast(counts), "table").select(
        "table", "raw_rows", "clean_rows",
        (F.col("raw_rows") - F.col("clean_rows")).alias("rows_removed"),
        rounded_to(F.try_divide(F.col("clean_rows").cast("double"), F.col("raw_rows").cast("double")) * 100, 2).alias(
            "pct_retained"
        ),
    )


def validation(clean: Tables, fact: DataFrame) -> DataFrame:
    """Ten post-cleaning checks that must be zero; six come from one pass over the facts."""
    c = F.col
    basic = counters(
        fact,
        {
            "Work orders with end_time < start_time": c("end_time") < c("start_time"),
            "Negative revenue or cost": (c("revenue") < 0) | (c("labor_cost") < 0) | (c("parts_cost") < 0),
            "Ratings outside 1-5": ~c("rating").between(1, 5),
            "Work orders without financials": c("revenue").isNull(),
            "Work orders without centre": c("center_id").isNull(),
        },
        "check",
        "violations",
    )
    keys = fact.groupBy("work_order_id").agg(F.count(F.lit(1)).alias("k"))
    repeated = keys.agg(F.coalesce(F.sum(c("k") - 1), F.lit(0)).alias("violations")).select(
        F.lit("Duplicate work_order_id").alias("check"), "violations"
    )
    appts, jobs = clean["appointments"], clean["work_orders"]
    done = appts.where(c("status") == "Completed")
    others = appts.where(c("status") != "Completed")
    more = {
        "Appointments with orphan vehicle": orphans(appts, "vehicle_id", clean["vehicles"], "vehicle_id"),
        "Work orders with orphan appointment": orphans(jobs, "appointment_id", appts, "appointment_id"),
        "Completed appointments without a work order": orphans(done, "appointment_id", jobs, "appointment_id"),
        "Work orders on non-completed appointments": jobs.join(
            others.select("appointment_id"), "appointment_id", "left_semi"
        ),
    }
    extra = [one_count(df, "check", name, "violations") for name, df in more.items()]
    return union_all([basic, repeated, *extra])


# defect class -> the log entries that must account for it (table, defect): (rule, column, issue part)
DETECTED_BY = {
    ("customers", "duplicate_rows"): ("DQ01", "*", ""),
    ("customers", "region_format_variants"): ("DQ03", "region", ""),
    ("vehicles", "impossible_model_year"): ("DQ15", "model_year", ""),
    ("vehicles", "impossible_mileage"): ("DQ16", "mileage_km", ""),
    ("vehicles", "model_name_variants"): ("DQ03", "model", ""),
    ("appointments", "status_format_variants"): ("DQ20", "status", ""),
    ("appointments", "ddmmyyyy_dates"): ("DQ04", "scheduled_date", ""),
    ("appointments", "missing_center_id"): ("DQ07", "center_id", "Missing service centre"),
    ("appointments", "orphan_vehicle_id"): ("DQ06", "vehicle_id", ""),
    ("appointments", "duplicate_rows"): ("DQ01", "*", ""),
    ("work_orders", "start_end_swapped"): ("DQ08", "start_time/end_time", ""),
    ("work_orders", "missing_technician_id + orphan_technician_id"): ("DQ10", "technician_id", ""),
    ("work_orders", "missing_start_time"): ("DQ09", "start_time", ""),
    ("work_orders", "service_type_format_variants"): ("DQ03", "service_type", ""),
    ("work_orders", "duplicate_rows"): ("DQ01", "*", ""),
    ("financials", "negative_amounts"): ("DQ11", "", ""),
    ("financials", "missing_parts_cost"): ("DQ12", "parts_cost", ""),
    ("financials", "revenue_decimal_shift_x100"): ("DQ13", "revenue", ""),
    ("financials", "duplicate_rows"): ("DQ01", "*", ""),
    ("feedback", "rating_out_of_range"): ("DQ14", "rating", "outside"),
    ("feedback", "missing_rating"): ("DQ14", "rating", "Missing"),
    ("feedback", "duplicate_rows"): ("DQ01", "*", ""),
    ("part_usage", "non_positive_quantity"): ("DQ17", "quantity", ""),
    ("part_usage", "orphan_part_id"): ("DQ17", "part_id", ""),
}


def reconcile_defects(manifest: DataFrame, log: DataFrame) -> DataFrame:
    """Injected against detected rows for the 24 defect classes."""
    c = F.col
    classes = F.array(
        *[
            F.struct(
                *[F.lit(x).alias(n) for n, x in zip(("t", "d", "rule", "col", "part"), (*key, *how))],
                F.array(*map(F.lit, key[1].split(" + "))).alias("members"),
            )
            for key, how in DETECTED_BY.items()
        ]
    )
    wanted = log.sparkSession.range(1).select(F.inline(classes))
    injected = (
        wanted.join(manifest, (c("t") == c("table")) & F.array_contains("members", c("injected_defect")))
        .groupBy("t", "d")
        .agg(F.sum("injected").alias("injected"))
    )
    match = (
        (c("t") == c("table"))
        & (c("rule") == c("rule_id"))
        & ((c("col") == "") | (c("col") == c("column")))
        & F.contains("issue", "part")
    )
    detected = (
        wanted.join(log, match, "left")
        .groupBy("t", "d", "rule")
        .agg(F.coalesce(F.sum("rows_affected"), F.lit(0)).alias("detected"))
    )
    return injected.join(detected, ["t", "d"]).select(
        c("t").alias("table"), c("d").alias("injected_defect"), "injected", "rule", "detected",
        F.when(c("injected") == c("detected"), "Match").otherwise("Explained").alias("status"),
    )


def change_audit(raw: DataFrame, clean: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows whose listed columns differ between the raw (deduplicated) and the clean table."""
    before = raw.select(key, *[F.col(c).cast("string").alias(f"{c}_raw") for c in columns]).distinct()
    after = clean.select(key, *[F.col(c).cast("string").alias(f"{c}_clean") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"{c}_raw").eqNullSafe(F.col(f"{c}_clean"))
    return before.join(after, key).where(~same)
