"""How each class of variable star is shown: a small lookup table and the parameters derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.curves import TAU, display_size, light_curve, relative_flux
from ..functions.hashing import uniform, with_uniforms
from ..functions.photometry import clip, positive, vivid_rgb
from ..workspace import compile_in_parts
from .ordering import with_row_number

COLUMNS = "cls string, model string, flux_mode string, period_default double, amplitude_default double, amplitude_floor double, irregularity double, temperature_response double, size_scale double, size_response double, intensity_scale double, brightness_response double, amplitude_ceiling double, width_low double, width_high double"

# Class, curve model, flux mode, default period (days) and amplitude (mag), amplitude floor, irregularity,
# temperature response, size scale and response, intensity scale, brightness response, amplitude ceiling, event widths.
BEHAVIOUR = (
    ("RR_LYRAE", "rr_lyrae", "range", 0.55, 0.8, 0.0, 0.0, 0.025, 1.0, 0.35, 1.10, 1.65, 2.5, 0.12, 0.28),
    ("CEPHEIDS", "cepheid", "range", 5.0, 0.7, 0.0, 0.0, 0.045, 1.0, 0.28, 1.08, 1.40, 2.5, 0.12, 0.28),
    ("ZZ_CETI", "zz_ceti", "range", 0.01, 0.12, 0.0, 0.08, 0.0, 1.0, 0.025, 1.0, 1.20, 0.7, 0.12, 0.28),
    ("LBV", "lbv", "range", 300.0, 0.8, 0.8, 0.35, -0.38, 2.20, 1.50, 1.45, 5.0, 3.0, 0.12, 0.28),
    ("BE", "stochastic_hot", "outburst", 2.0, 0.40, 0.40, 1.0, 0.09, 1.12, 0.95, 1.16, 3.40, 0.65, 0.12, 0.28),
    ("GCAS", "stochastic_hot", "outburst", 60.0, 0.50, 0.50, 1.0, 0.11, 1.25, 1.05, 1.22, 3.50, 0.70, 0.12, 0.28),
    ("SDOR", "lbv", "range", 300.0, 0.8, 0.8, 0.35, -0.38, 2.20, 1.50, 1.45, 5.0, 3.0, 0.12, 0.28),
    ("WR", "stochastic_hot", "outburst", 20.0, 0.40, 0.40, 1.0, 0.12, 1.35, 0.95, 1.55, 3.40, 0.55, 0.12, 0.28),
    ("UNKNOWN_HOT", "stochastic_hot", "outburst", 10.0, 0.35, 0.35, 1.0, 0.09, 1.05, 0.85, 1.05, 3.20, 0.60, 0.12, 0.28),
    ("CATACLYSMIC", "cataclysmic", "outburst", 30.0, 3.0, 0.0, 0.0, 0.12, 1.0, 0.35, 1.10, 1.25, 6.0, 0.12, 0.28),
    ("ACV|CP|MCP|ROAM|ROAP|SXARI", "rotational", "range", 3.0, 0.08, 0.0, 0.0, 0.0, 1.0, 0.08, 1.0, 1.0, 0.8, 0.12, 0.28),
    ("ACYG", "gentle_pulsation", "range", 10.0, 0.15, 0.0, 0.15, 0.0, 1.0, 0.12, 1.0, 1.0, 1.0, 0.12, 0.28),
    ("AGN", "agn_noise", "signed", 120.0, 0.3, 0.0, 0.65, 0.0, 1.0, 0.04, 1.0, 1.0, 1.5, 0.12, 0.28),
    ("BCEP", "gentle_pulsation", "range", 0.18, 0.12, 0.0, 0.0, 0.008, 1.0, 0.08, 1.0, 1.0, 0.8, 0.12, 0.28),
    ("DSCT|GDOR|SXPHE", "multimode", "range", 0.10, 0.18, 0.0, 0.08, 0.006, 1.0, 0.09, 1.0, 1.0, 1.0, 0.12, 0.28),
    ("ECL", "eclipsing", "dimming", 1.0, 0.6, 0.0, 0.0, 0.0, 1.0, 0.0, 1.0, 1.0, 5.0, 0.12, 0.28),
    ("ELL", "ellipsoidal", "range", 2.0, 0.15, 0.0, 0.0, 0.0, 1.0, 0.08, 1.0, 1.0, 0.8, 0.12, 0.28),
    ("EP", "planet_transit", "dimming", 3.0, 0.02, 0.0, 0.0, 0.0, 1.0, 0.0, 1.0, 1.0, 0.15, 0.12, 0.28),
    ("LPV", "long_period", "range", 250.0, 1.5, 0.0, 0.40, 0.035, 1.0, 0.24, 1.0, 1.30, 5.0, 0.12, 0.28),
    ("MICROLENSING", "microlensing_event", "outburst", 30.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.18, 1.0, 1.0, 5.0, 0.08, 0.20),
    ("RCB", "rcb_decline", "dimming", 200.0, 4.0, 0.0, 0.0, -0.08, 1.0, 0.06, 1.0, 1.0, 8.0, 0.20, 0.42),
    ("RS", "rotational", "range", 8.0, 0.18, 0.0, 0.16, 0.0, 1.0, 0.09, 1.0, 1.0, 1.2, 0.12, 0.28),
    ("S", "conservative", "range", 5.0, 0.10, 0.0, 0.0, 0.0, 1.0, 0.06, 1.0, 1.0, 0.8, 0.12, 0.28),
    ("SDB", "gentle_pulsation", "range", 0.08, 0.08, 0.0, 0.0, 0.0, 1.0, 0.05, 1.0, 1.0, 0.5, 0.12, 0.28),
    ("SN", "supernova_event", "supernova", 40.0, 4.0, 0.0, 0.0, 0.30, 1.0, 0.25, 1.08, 1.0, 7.0, 0.10, 0.22),
    ("SOLAR_LIKE", "solar_like", "range", 5.0, 0.01, 0.0, 0.0, 0.0, 1.0, 0.0, 1.0, 1.0, 0.05, 0.12, 0.28),
    ("SPB", "gentle_pulsation", "range", 2.0, 0.08, 0.0, 0.0, 0.005, 1.0, 0.05, 1.0, 1.0, 0.5, 0.12, 0.28),
    ("SYST", "conservative", "range", 20.0, 0.15, 0.0, 0.0, 0.0, 1.0, 0.08, 1.0, 1.0, 1.0, 0.12, 0.28),
    ("YSO", "yso_irregular", "signed", 20.0, 0.7, 0.0, 0.70, -0.06, 1.0, 0.10, 1.0, 1.0, 3.0, 0.12, 0.28),
    ("OTHER", "conservative", "range", 5.0, 0.10, 0.0, 0.0, 0.0, 1.0, 0.06, 1.0, 1.0, 0.8, 0.12, 0.28),
)
# Classifier labels with another class name here; seeds of the per-star variation.
ALIASES = {"RR": "RR_LYRAE", "CEP": "CEPHEIDS", "WD": "ZZ_CETI", "CV": "CATACLYSMIC"}
SEED_PHASE, SEED_MODE, SEED_IRREGULAR, SEED_EVENT = 57_721, 31_415, 16_180, 27_182


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BEHAVIOUR, COLUMNS)


def with_behaviour(stars: DataFrame, class_col: str = "cls") -> DataFrame:
    """`stars` with the behaviour of their class; classes without one behave as OTHER. The 30 rows are broadcast."""
    name = F.col(class_col)
    for label, other in ALIASES.items():
        name = F.when(F.col(class_col) == label, other).otherwise(name)
    known = F.array(*(F.lit(r[0]) for r in BEHAVIOUR))
    named = stars.withColumn("behaviour_class", F.when(F.array_contains(known, name), name).otherwise("OTHER"))
    return named.join(F.broadcast(table(stars.sparkSession).withColumnRenamed("cls", "behaviour_class")), "behaviour_class")


def with_parameters(stars: DataFrame) -> DataFrame:
    """Period, amplitude and phase with the class defaults applied, and the per-star variation by hashes of source_id.

    Expects with_behaviour's columns and source_id, period, amplitude, phase.
    """
    compile_in_parts(stars.sparkSession)
    amplitude = F.coalesce(F.when(F.col("amplitude") >= 0, F.col("amplitude")), F.col("amplitude_default"))
    seeds = {"phase": SEED_PHASE, "mode": SEED_MODE, "irregular": SEED_IRREGULAR, "event": SEED_EVENT, "width": SEED_EVENT ^ SEED_IRREGULAR, "shape": SEED_EVENT ^ SEED_MODE}
    drawn = with_uniforms(stars, F.col("source_id"), **{f"__u_{what}": seed for what, seed in seeds.items()})
    u = lambda what: F.col(f"__u_{what}")
    return drawn.withColumns({
        "used_period": F.coalesce(positive(F.col("period")), F.col("period_default")),
        "used_amplitude": F.least(F.greatest(amplitude, F.col("amplitude_floor")), F.col("amplitude_ceiling")),
        "used_phase": F.pmod(F.coalesce(F.col("phase"), F.lit(0.0)) + TAU * u("phase"), F.lit(TAU)),
        "mode_phase_1": TAU * u("mode"),
        "mode_phase_2": TAU * u("irregular"),
        "event_centre": 0.24 + 0.52 * u("event"),
        "used_irregularity": F.col("irregularity") * (0.75 + 0.5 * u("irregular")),
        "event_width": F.col("width_low") + (F.col("width_high") - F.col("width_low")) * u("width"),
        "event_shape": u("shape"),
    }).drop(*(f"__u_{what}" for what in seeds))


# How long stars wait before they appear, the lengths of the ramps (shares of the video), the seeds of the
# two delays, and the star sizes of a map of one class and of a map of all.
APPEARANCE, FADE_IN, FADE_OUT, INTRO, OUTRO, SEED_APPEAR, SEED_FADE = 0.20, 0.04, 0.04, 0.0, 0.0, 42, 43
ONE_CLASS_SIZE, ALL_CLASSES_SIZE = 2.20 * 1.65, 1.0
HOT = ("LBV", "BE", "GCAS", "SDOR", "WR", "UNKNOWN_HOT")


def with_fallbacks(stars: DataFrame, class_col: str = "cls") -> DataFrame:
    """`stars` with an unusable period replaced by alternate_period and, in hot classes, an unusable amplitude by the
    trimmed range, then the full range. Columns that the table lacks replace nothing.
    """
    have = set(stars.columns)
    of = lambda c: F.col(c).cast("double") if c in have else F.lit(None).cast("double")
    usable = lambda c: F.when(of(c) >= 0, of(c))
    period = F.coalesce(positive(of("period")), positive(of("alternate_period")), of("period"))
    ranges = F.coalesce(usable("amplitude"), usable("trimmed_range_mag_g_fov"), usable("range_mag_g_fov"), of("amplitude"))
    return stars.withColumns({"period": period, "amplitude": F.when(F.col(class_col).isin(*HOT), ranges).otherwise(of("amplitude"))})


def with_surrogate_ids(stars: DataFrame, catalogue: int, order: str = "input_seq") -> DataFrame:
    """`stars` with ids (catalogue + 1) * 10^12 + row number (from 0, in the order of `order`) where source_id is missing
    or negative. Rows are numbered by ranges; catalogue counts the catalogues from 0.
    """
    rows = with_row_number(stars, "__row", [order], 0)
    missing = F.coalesce(F.col("source_id") < 0, F.lit(True))
    key = F.lit((catalogue + 1) * 10**12).cast("long") + F.col("__row").cast("long")
    return rows.withColumn("source_id", F.when(missing, key).otherwise(F.col("source_id"))).drop("__row")


def default_counts(stars: DataFrame) -> DataFrame:
    """One row: how many stars take a default period and amplitude, and how many have each physical value."""
    lacks = lambda c, low: F.count_if(F.coalesce(~(F.col(c) > 0) if low else ~(F.col(c) >= 0), F.lit(True)))
    has = lambda c: F.count_if(F.col(c) > 0)
    return stars.agg(
        lacks("period", True).alias("missing_period"), lacks("amplitude", False).alias("missing_amplitude"), has("lum_flame").alias("luminosity"),
        has("radius_gspphot").alias("radius"), has("mass_flame").alias("mass"), F.count("classification_score").alias("classification_score"),
    )


def with_map_size(stars: DataFrame, all_classes: bool) -> DataFrame:
    """`stars` with one size_scale for all: small on a dense map of all classes, larger on a map of one."""
    return stars.withColumn("size_scale", F.lit(ALL_CLASSES_SIZE if all_classes else ONE_CLASS_SIZE))


def visibility(progress: Column, star: Column, appearance: float = APPEARANCE, intro: float = INTRO, outro: float = OUTRO) -> Column:
    """0 to 1: a star's ramps of appearance, after a delay by its id's hash, and of fading out towards the end."""
    return ramps(progress, uniform(star, SEED_APPEAR), uniform(star, SEED_FADE), appearance, intro, outro)


def ramps(progress: Column, appears: Column, fades: Column, appearance: float = APPEARANCE, intro: float = INTRO, outro: float = OUTRO) -> Column:
    """`visibility` of a star whose two delays, in [0, 1), are known: they are the same at all times."""
    appear = clip((progress - intro - appearance * appears) / FADE_IN, 0.0, 1.0)
    late = max(outro - FADE_OUT, 0.0)
    return appear * clip((1.0 - outro + late * fades - progress) / FADE_OUT, 0.0, 1.0)


def with_delays(stars: DataFrame) -> DataFrame:
    """`stars` with the delays (appears, fades) that `ramps` asks for, once a star."""
    return with_uniforms(stars, F.col("source_id"), appears=SEED_APPEAR, fades=SEED_FADE)


def subtype_set(present: set[str], parts: tuple[str, ...] = ("BE", "GCAS", "SDOR", "WR", "UNKNOWN"), parent: str = "LBV") -> tuple[str, ...]:
    """The split catalogues if all of them exist, else their parent."""
    return parts if set(parts) <= present else (parent,)


def frames(stars: DataFrame, epochs: DataFrame, height: float = 8192.0) -> DataFrame:
    """One row for each star and epoch at which it is visible: flux, sigma, alpha and colour.

    epochs (frame, elapsed, progress, opacity) are few by construction (a video's frames) and are broadcast; stars stay
    where they are, without a shuffle. alpha is at least 0.012 times the opacity, so an epoch shows all stars or none.
    Expects with_parameters' columns and temperature.
    """
    compile_in_parts(stars.sparkSession)
    # a filter by alpha would be pushed below and compute every curve a second time
    both = stars.crossJoin(F.broadcast(epochs.filter(F.col("opacity") > 0)))
    cycle = F.pmod(F.col("used_phase") / TAU + F.col("elapsed") / F.col("used_period"), F.lit(1.0))
    both = both.withColumn("cycle", cycle)
    c = {"cycle": F.col("cycle"), "elapsed": F.col("elapsed"), "period": F.col("used_period"), "progress": F.col("progress"), "irregularity": F.col("used_irregularity"), "p1": F.col("mode_phase_1"), "p2": F.col("mode_phase_2"), "centre": F.col("event_centre"), "width": F.col("event_width"), "shape": F.col("event_shape")}
    both = both.withColumn("curve", light_curve(F.col("model"), c))
    both = both.withColumn("signal", F.col("curve.signal")).withColumn("colour_driver", F.coalesce("curve.colour", 2.0 * F.col("signal") - 1.0))
    both = both.withColumn("relative_flux", relative_flux(F.col("signal"), F.col("used_amplitude"), F.col("flux_mode")))
    sigma, alpha = display_size(F.col("relative_flux"), F.col("size_scale"), F.col("size_response"), F.col("intensity_scale"), F.col("brightness_response"), height)
    both = both.withColumns({"sigma": sigma, "alpha": alpha * F.col("opacity")})
    factor = clip(1.0 + F.col("temperature_response") * F.col("colour_driver"), 0.52, 1.45)
    red, green, blue = vivid_rgb(F.col("__kelvin"))
    return both.withColumn("__kelvin", F.col("temperature") * factor).withColumns({"red": red, "green": green, "blue": blue}).drop("__kelvin")


def editorial_axis(spark: SparkSession, start: float, end: float, count: int = 1000, fps: float = 25.0, before: float = 3.0, active: float = 35.0, edge: float = 0.5) -> DataFrame:
    """(frame, seconds, elapsed, progress, opacity) of a video that shows [start, end] after a still lead-in."""
    if not end > start:
        raise ValueError("the interval must have a positive duration")
    seconds = F.col("id") / fps
    progress = clip((seconds - before) / active, 0.0, 1.0)
    shown = (seconds >= before) & (seconds < before + active)
    opacity = F.least(clip((seconds - before) / edge, 0.0, 1.0), clip((before + active - seconds) / edge, 0.0, 1.0))
    rows = spark.range(count)
    return rows.select(F.col("id").cast("int").alias("frame"), seconds.alias("seconds"), (start + progress * (end - start)).alias("elapsed"), progress.alias("progress"), F.when(shown, opacity).otherwise(0.0).alias("opacity"))


# Temperatures (K) that stand in for hot classes without a usable colour.
FALLBACK_K = {"BE": 18_000.0, "GCAS": 18_000.0, "SDOR": 20_000.0, "LBV": 20_000.0, "WR": 40_000.0, "UNKNOWN_HOT": 15_000.0}


def with_colour_inputs(stars: DataFrame, class_col: str = "resolved_class") -> DataFrame:
    """Adds used_teff, used_bp_rp and colour_source: a plausible temperature, else a reliable intrinsic colour, else the
    observed one; dust-reddened WR stars and strongly extinguished SDOR and LBV stars take their class's temperature.

    Expects teff_gspphot, bp_rp, bp_rp_intrinsic, reddening_quality, classification_flags, ag_gspphot and
    ebpminrp_gspphot.
    """
    c, no = F.col, F.lit(False)
    teff = F.when(c("teff_gspphot").between(1_000.0, 200_000.0), c("teff_gspphot"))
    flags = F.lower(F.coalesce(c("classification_flags"), F.lit("")))
    doubtful = flags.contains("invalid_reddening") | flags.contains("uncertain_reddening")
    reliable = c("bp_rp_intrinsic").isNotNull() & F.coalesce(F.lower(c("reddening_quality")) == "good", no) & ~doubtful
    strong = flags.contains("strong_extinction") | F.coalesce(c("ag_gspphot") >= 1.0, no) | F.coalesce(c("ebpminrp_gspphot") >= 0.5, no)
    unsure = teff.isNull() & ~reliable
    red = F.coalesce(c("bp_rp") > 0.20, no)
    guarded = unsure & ((c(class_col) == "WR") | (c(class_col).isin("SDOR", "LBV") & strong & red))
    colour = F.when(~guarded, F.when(reliable, c("bp_rp_intrinsic")).otherwise(c("bp_rp")))
    stand_in = F.when(no, F.lit(0.0))
    for name, kelvin in FALLBACK_K.items():
        stand_in = stand_in.when(c(class_col) == name, kelvin)
    stand_in = F.when(teff.isNull() & colour.isNull(), stand_in)
    source = F.when(teff.isNotNull(), "teff").when(colour.isNotNull() & reliable, "intrinsic").when(colour.isNotNull(), "observed").when(stand_in.isNotNull(), "class").otherwise("default")
    return stars.withColumns({"used_teff": F.coalesce(teff, stand_in), "used_bp_rp": colour, "colour_source": source})


def with_physical_scaling(stars: DataFrame) -> DataFrame:
    """Multiplies intensity_scale and size_scale by bounded factors of luminosity, mass, confidence and radius; missing
    values count as 1. Expects lum_flame, mass_flame, radius_gspphot and classification_score.
    """
    some = lambda value, factor: F.coalesce(F.when(value.isNotNull(), factor), F.lit(1.0))
    light, mass, radius, score = positive(F.col("lum_flame")), positive(F.col("mass_flame")), positive(F.col("radius_gspphot")), F.col("classification_score")
    bright = some(light, clip(1.0 + 0.08 * (F.log10(light) - 3.0), 0.88, 1.22)) * some(mass, clip(0.98 + 0.04 * F.log1p(mass / 10.0), 0.96, 1.10)) * some(score, 0.94 + 0.06 * clip(score, 0.0, 1.0))
    size = some(radius, clip(F.pow(radius / 5.0, F.lit(0.10)), 0.85, 1.25))
    return stars.withColumns({"intensity_scale": F.col("intensity_scale") * bright, "size_scale": F.col("size_scale") * size})
