"""The microlensing event table: validation, derived columns, summary and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lensing
from ..functions.coords import Region, hammer_xy
from ..functions.photometry import distance_columns, positive, spectral_letter
from ..workspace import written
from .ordering import percentiles, with_row_number

# Columns that may hold a lens mass, in order, and those of the CSV export.
MASS_COLUMNS = ("paczynski0_mass", "paczynski_mass", "lens_mass", "mass")
EXPORT = {"name": "name", "sourceId": "source_id", "l": "l", "b": "b", "tmax": "tmax", "te": "te", "u0": "u0", "aMax": "a_max", "parallax": "parallax", "parallaxError": "parallax_error", "distancePc": "distance_pc", "lensMass": "lens_mass", "massStatus": "mass_status"}


def with_reject_reason(events: DataFrame) -> DataFrame:
    """`events` with the first rule that a row breaks (null: accepted).

    Expects l, b, paczynski0_tmax, _te, _u0, source_id and input_seq, the input order. Only the first accepted row of
    an id is kept: duplicates are found among rows without another fault.
    """
    known = F.col("l").isNotNull() & F.col("b").isNotNull() & F.col("paczynski0_tmax").isNotNull() & F.col("paczynski0_te").isNotNull() & F.col("paczynski0_u0").isNotNull()
    reason = (
        F.when(~known, "missing parameter")
        .when(~(F.col("l").between(0.0, 360.0) & F.col("b").between(-90.0, 90.0)), "coordinates out of range")
        .when(F.col("paczynski0_te") <= 0, "timescale not positive")
        .when(F.col("source_id").isNull(), "bad id")
    )
    marked = events.withColumn("reason", reason)
    # a row with a fault is a group of its own: they aren't compared, and null ids gather in no task
    order = Window.partitionBy("source_id", F.when(F.col("reason").isNotNull(), F.col("input_seq"))).orderBy("input_seq")
    marked = marked.withColumn("nth", F.row_number().over(order))
    return marked.withColumn("reject_reason", F.when(F.col("reason").isNull() & (F.col("nth") > 1), "duplicate id").otherwise(F.col("reason"))).drop("reason", "nth")


def sane(events: DataFrame) -> DataFrame:
    """Magnitudes, colours, parallaxes and errors outside their ranges as missing."""
    between = lambda c, low, high: F.when(F.col(c).between(low, high), F.col(c))
    return events.withColumns({"phot_g_mean_mag": between("phot_g_mean_mag", -5.0, 40.0), "bp_rp": between("bp_rp", -5.0, 15.0), "parallax": positive(F.col("parallax")), "parallax_error": positive(F.col("parallax_error"))})


def accepted(events: DataFrame) -> DataFrame:
    """The valid events with every derived column."""
    rows = sane(with_reject_reason(events).filter("reject_reason is null").drop("reject_reason"))
    x, y = hammer_xy(F.col("l"), F.col("b"))
    rows = rows.withColumns({"te": F.col("paczynski0_te"), "tmax": F.col("paczynski0_tmax"), "u0": F.abs("paczynski0_u0"), "x": x, "y": y, **distance_columns(F.col("parallax"), F.col("parallax_error"))})
    given, origin = catalogue_mass(rows)
    mass = lensing.lens_mass(F.col("te"), F.col("distance_pc"))
    low, high = lensing.mass_scenarios(F.col("te"), F.col("distance_pc"))
    rows = rows.withColumns({"a_max": lensing.peak_amplification(F.col("u0")), "catalog_mass": given, "mass_origin": origin})
    rows = rows.withColumns({c: F.when(F.col("catalog_mass").isNull(), v) for c, v in (("model_mass", mass), ("mass_low", low), ("mass_high", high))})
    seconds = lensing.unix_seconds(F.col("tmax"))
    return rows.withColumns({
        "lens_mass": F.coalesce("catalog_mass", "model_mass"),
        "mass_status": F.when(F.col("catalog_mass").isNotNull(), "catalog").when(F.col("model_mass").isNotNull(), "model").otherwise("missing"),
        "lens_category": lensing.mass_category(F.coalesce("catalog_mass", "model_mass")), "spectral": spectral_letter(F.col("teff_gspphot")),
        "peak_time": F.timestamp_seconds(seconds), "peak_date": F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd"),
    })


def catalogue_mass(events: DataFrame) -> tuple[Column, Column]:
    """(mass, the column that gives it): the first known one of the mass columns, if it is positive."""
    have = [c for c in MASS_COLUMNS if c in events.columns]
    first = F.coalesce(*(F.col(c).cast("double") for c in have)) if have else F.lit(None).cast("double")
    origin = F.coalesce(*(F.when(F.col(c).isNotNull(), c) for c in have)) if have else F.lit(None).cast("string")
    return F.when(first > 0, first), F.when(first > 0, origin)


def display_mass(events: DataFrame, default: float = 1.0) -> Column:
    """The lens mass that an event is drawn with: the first mass column that the table has; missing ones count as `default`."""
    name = next((c for c in MASS_COLUMNS if c in events.columns), None)
    return F.lit(default) if name is None else F.coalesce(F.col(name).cast("double"), F.lit(default))


def temperature_origin(teff: Column, bp_rp: Column) -> Column:
    """Where an event's temperature comes from: its own measurement, an estimate from its colour, or nowhere."""
    return F.when(teff.isNotNull(), "Gaia teff_gspphot").when(bp_rp.isNotNull(), "estimate from BP-RP")


def with_index(events: DataFrame) -> DataFrame:
    """Numbers and names by peak time.

    The numbering is by ranges: rows are counted per range, so the order over all events is no single task.
    """
    numbered = with_row_number(events, "catalogue_index", ["tmax", "input_seq"])
    return numbered.withColumn("name", F.concat(F.lit("ML-"), F.lpad(F.col("catalogue_index").cast("string"), F.greatest(F.lit(3), F.length(F.col("catalogue_index").cast("string"))), F.lit("0"))))


def reject_histogram(events: DataFrame) -> DataFrame:
    return with_reject_reason(events).groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def summary(events: DataFrame) -> DataFrame:
    """One row about accepted events."""
    median = percentiles(events, "te", [0.5])[0]
    return events.agg(
        F.count("*").alias("n"), F.min("peak_date").alias("first_date"), F.max("peak_date").alias("last_date"),
        F.lit(median).cast("double").alias("median_te"), F.count_if(F.col("a_max") >= 2).alias("strong"),
        F.count_if(F.col("mass_status") == "catalog").alias("mass_catalog"),
        F.count_if(F.col("mass_status") == "model").alias("mass_model"), F.count_if(F.col("mass_status") == "missing").alias("mass_missing"),
        F.count("parallax_error").alias("with_parallax_error"),
    )


def set_summary(events: DataFrame) -> DataFrame:
    """One row about a whole input: summary of what is accepted, and n_input, n_rejected and reasons (a map of counts)."""
    counts = reject_histogram(events)
    sums = counts.agg(F.sum("n").alias("n_input"), F.coalesce(F.sum(F.when(F.col("reason") != "accepted", F.col("n"))), F.lit(0)).alias("n_rejected"), F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("reason") != "accepted", F.struct("reason", "n"))))).alias("reasons"))
    return summary(accepted(events)).crossJoin(F.broadcast(sums))


def quick_filter(events: DataFrame, kind: str, text: str = "") -> DataFrame:
    """all, strong, short, long, catalogue_mass or model_mass events whose id or name holds `text` (dashes alike)."""
    rules = {"all": F.lit(True), "strong": F.col("a_max") >= 2, "short": F.col("te") <= 30, "long": F.col("te") >= 100, "catalogue_mass": F.col("mass_status") == "catalog", "model_mass": F.col("mass_status") == "model"}
    plain = lambda c: F.lower(F.translate(c, "–—−", "---"))
    kept = events.filter(rules[kind])
    wanted = plain(F.lit(text.strip()))
    return kept.filter(F.contains(plain(F.col("source_id").cast("string")), wanted) | F.contains(plain(F.col("name")), wanted)) if text.strip() else kept


def choose_level(events: DataFrame, region: Region | None = None) -> DataFrame:
    """The blended fit where it is valid, else the simple one: tmax, te, u0, share, level. region: events inside it alone;
    its test stands before the fits are looked at, so it reaches a scan.
    """
    events = events if region is None else events.filter(region.inside(F.col("l"), F.col("b")))
    ok = lensing.level_one_valid(F.col("paczynski1_tmax"), F.col("paczynski1_te"), F.col("paczynski1_u0"), F.col("paczynski1_fs_g"))
    pick = lambda name: F.when(ok, F.col(f"paczynski1_{name}")).otherwise(F.col(f"paczynski0_{name}"))
    rows = events.withColumns({"level": F.when(ok, 1).otherwise(0), "tmax": pick("tmax"), "te": pick("te"), "u0": F.abs(pick("u0")), "share": F.when(ok, F.least(F.col("paczynski1_fs_g"), F.lit(1.0))).otherwise(1.0)})
    return rows.filter("tmax is not null and te > 0 and u0 is not null and l is not null and b is not null")


def activity_window(events: DataFrame, least: float = 0.05, cap_share: float = 0.95) -> DataFrame:
    """One row (cap, start, stop): the time in which events with a visible peak are active; all events if none is."""
    marked = events.select("te", "tmax", (lensing.peak_excess(F.col("u0"), F.col("share")) >= least).alias("visible"))
    # three answers are read from these three columns, which cost a join to make
    marked = written(marked, "window")
    some = marked.agg(F.max("visible")).first()[0]
    kept = marked.filter("visible") if some else marked
    limit = F.lit(percentiles(kept, "te", [cap_share])[0]).cast("double")
    margin = F.least(F.col("te"), limit)
    return kept.agg(F.max(limit).alias("cap"), F.min(F.col("tmax") - margin).alias("start"), F.max(F.col("tmax") + margin).alias("stop"))


def payload(events: DataFrame) -> DataFrame:
    """One JSON text per event, for export."""
    body: Column = F.struct("source_id", "l", "b", "tmax", "te", "u0", "a_max", F.struct(F.col("peak_date").alias("date")).alias("date"), F.struct("distance_pc", "distance_low_pc", "distance_high_pc").alias("distance"), F.struct("lens_mass", "mass_status", "mass_low", "mass_high", "lens_category").alias("lens"))
    return events.select("source_id", F.to_json(body).alias("json"))


def export_rows(events: DataFrame) -> DataFrame:
    """The thirteen columns of the CSV export, under their names there. events: with_index of accepted events."""
    return events.select(*(F.col(c).alias(name) for name, c in EXPORT.items()))
