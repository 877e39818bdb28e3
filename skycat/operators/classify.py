"""Rule-based classification of hot variable stars into WR, SDOR, GCAS and BE, with confidence and flags.

Rows are scored by plain column expressions, one feature group at a time; nothing is shuffled. Literature columns are
read from the input only: run it on catalogues, not on its own output.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import let
from ..workspace import compile_in_parts, written
from .ordering import group_percentiles

CLASSES = ("BE", "GCAS", "SDOR", "WR")
# Names in the literature for each class, words that mean no label, and columns that may hold one.
LABELS = {
    "WR": ("WR", "WOLFRAYET"),
    "SDOR": ("LBV", "SDOR", "SDORADUS", "LUMINOUSBLUEVARIABLE"),
    "GCAS": ("GCAS", "GAMMACAS", "GAMMACASSIOPEIAE"),
    "BE": ("BE", "BEMISSION", "BEMISSIONLINE", "BTYPEEMISSIONLINE", "EMISSIONLINEB"),
}
NO_TEXT = ("", "--", "NAN", "NONE", "NULL")
LITERATURE = ("subclass", "resolved_class", "literature_class", "spectral_class", "object_type")


@dataclass(frozen=True)
class Thresholds:
    """The limits that users may change; the points of each rule are fixed."""

    reddening_width: float = 0.15
    reddening_share: float = 0.75
    extinction_width: float = 0.30
    extinction_share: float = 0.75
    strong_reddening: float = 0.50
    strong_extinction: float = 1.00
    good_fraction: float = 0.25
    poor_fraction: float = 1.00
    good_logg: float = 0.30
    poor_logg: float = 1.00
    least_weight: float = 0.35
    low_parent_score: float = 0.35
    least_features: int = 3
    least_variability: float = 2.0
    least_groups: int = 2
    least_score: float = 4.0
    least_margin: float = 1.0
    least_confidence: float = 0.48
    hot_low: float = 8_000.0
    hot_high: float = 35_000.0
    # where the rules' ranges begin and end
    be_teff_low: float = 10000.0
    be_teff_high: float = 30000.0
    wr_teff: float = 35000.0
    wr_teff_strong: float = 50000.0
    logg_high: float = 3.2
    logg_low: float = 3.0
    logg_very_low: float = 2.0
    lum_low: float = 20.0
    lum_high: float = 10000.0
    lum_very_high: float = 100000.0
    mag_bright: float = -4.0
    mag_faint: float = 2.0
    mag_very_bright: float = -7.0
    radius_low: float = 1.0
    radius_high: float = 20.0
    radius_large: float = 25.0
    radius_very_large: float = 50.0
    mass_low: float = 3.0
    mass_high: float = 20.0
    mass_wr: float = 10.0
    mass_sdor: float = 20.0
    mass_very_high: float = 40.0
    blue_intrinsic: float = 0.2
    blue_observed: float = -0.1
    broad: float = 50.0
    very_broad: float = 100.0
    rv_high: float = 50.0
    range_small: float = 0.15
    range_middle: float = 0.5
    range_large: float = 1.0
    deviation_small: float = 0.05
    deviation_large: float = 0.15
    skew_high: float = 1.0
    skew_very_high: float = 2.0
    kurtosis_high: float = 3.0
    kurtosis_very_high: float = 6.0
    sharp_parallax: float = 5.0


def known_text(text: Column) -> Column:
    """Trimmed text; null for words that stand for a missing value."""
    return F.when(~F.upper(F.trim(text)).isin(*NO_TEXT), F.trim(text))


def normal_label(text: Column) -> Column:
    """Capitals and digits alone; null without a label."""
    bare = lambda up: F.when(~up.isin(*NO_TEXT, "UNKNOWN"), F.regexp_replace(up, "[^A-Z0-9]+", ""))
    return let(let(F.upper(F.trim(text)), bare), lambda label: F.when(label != "", label))


def label_class(text: Column) -> Column:
    """The class that a label names, alone or as a Wolf-Rayet subtype."""

    def named(label: Column) -> Column:
        out = F.when(label.isin(*LABELS["WR"]) | label.rlike("^W[CNOR][A-Z]*[0-9]*[A-Z]*$"), "WR")
        for name in ("SDOR", "GCAS", "BE"):
            out = out.when(label.isin(*LABELS[name]), name)
        return out

    return let(normal_label(text), named)


# Patterns of free spectral texts and the classes they name, in order. γ is a letter at a word's edge only
# under Unicode rules, which Java's patterns have to be asked for: (?U).
SPECTRAL = (
    ("SDOR", r"\b(lbv|s\s*dor(?:adus)?)\b"),
    ("GCAS", r"\b(?:gamma|γ)\s*cas(?:siopeiae)?\b"),
    ("BE", r"\bb\s*\[\s*e\s*\]"),
    ("BE", r"\bbe(?:\d|\b)"),
)


def spectral_class(text: Column) -> Column:
    """The class that a free spectral text names."""

    def free(low: Column) -> Column:
        out = F.when(low.isNull(), None)
        for name, pattern in SPECTRAL:
            out = out.when(low.rlike("(?U)" + pattern), name)
        return out

    return F.coalesce(label_class(text), let(F.when(normal_label(text).isNotNull(), F.lower(text)), free))


def _col(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("double") if name in df.columns else F.lit(None).cast("double")


def _width(df: DataFrame, name: str) -> Column:
    """Half the width of a value's interval; null without an ordered one."""
    low, high = _col(df, f"{name}_lower"), _col(df, f"{name}_upper")
    return F.when(high >= low, (high - low) / 2.0)


def reddening(df: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Adds reddening_quality (good, uncertain, missing, invalid), bp_rp_intrinsic and the first flags."""
    e, a, colour = _col(df, "ebpminrp_gspphot"), _col(df, "ag_gspphot"), _col(df, "bp_rp")
    e_width, a_width = _width(df, "ebpminrp_gspphot"), _width(df, "ag_gspphot")
    known, negative = e.isNotNull(), F.coalesce(e < 0, F.lit(False))
    usable = known & ~negative
    wide_e = usable & F.coalesce(e_width > F.greatest(F.lit(t.reddening_width), t.reddening_share * e), F.lit(False))
    open_e = usable & e_width.isNull()
    bad_a = F.coalesce(a < 0, F.lit(False))
    good_a = F.coalesce(a >= 0, F.lit(False))
    wide_a = usable & good_a & F.coalesce(a_width > F.greatest(F.lit(t.extinction_width), t.extinction_share * a), F.lit(False))
    quality = F.when(~known, "missing").when(negative, "invalid").when(wide_e | open_e | (usable & bad_a) | wide_a, "uncertain").otherwise("good")
    intrinsic = F.when(usable & ~wide_e & ~wide_a, colour - e)
    flag = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), name)
    flags = F.array_distinct(F.array_compact(F.array(
        flag(~known, "missing_reddening"), flag(negative, "invalid_reddening"),
        flag(open_e | wide_e, "uncertain_reddening"), flag(open_e, "missing_reddening_interval"),
        flag(bad_a, "invalid_extinction"), flag(usable & (bad_a | wide_a), "uncertain_reddening"),
        flag(wide_a, "uncertain_extinction"), flag(good_a & a_width.isNull(), "missing_extinction_interval"),
        flag((usable & (e >= t.strong_reddening)) | (good_a & (a >= t.strong_extinction)), "strong_extinction"),
        flag(colour.isNull(), "missing_bp_rp"),
    )))
    reliable = good_a & F.coalesce(a_width <= F.greatest(F.lit(t.extinction_width), t.extinction_share * a), F.lit(False))
    return df.withColumns({"reddening_quality": quality, "bp_rp_intrinsic": intrinsic, "extinction_flags": flags, "__ag": F.when(reliable, a)})


def _spread(df: DataFrame, name: str, t: Thresholds) -> Column:
    """A value's uncertainty from its bounds or else its error: absolute for log g, relative for the others."""
    error = _col(df, f"{name}_error")
    width = F.coalesce(_width(df, name), F.when(error >= 0, error))
    return width if name == "logg_gspphot" else width / F.greatest(F.abs(_col(df, name)), F.lit(1e-12))


def _limits(name: str, t: Thresholds) -> tuple[float, float]:
    return (t.good_logg, t.poor_logg) if name == "logg_gspphot" else (t.good_fraction, t.poor_fraction)


def _weight(df: DataFrame, name: str, t: Thresholds) -> Column:
    """1 for a well-known value down to the least weight for a poor one; 1 if its uncertainty isn't known."""
    good, poor = _limits(name, t)
    spread = _spread(df, name, t)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (spread - good) / max(poor - good, 1e-12)))
    return F.when(spread.isNull(), 1.0).otherwise(1.0 - share * (1.0 - t.least_weight))


def _poor(df: DataFrame, name: str, t: Thresholds) -> Column:
    return F.coalesce(_spread(df, name, t) >= _limits(name, t)[1], F.lit(False)) & _col(df, name).isNotNull()


WEIGHED = ("teff_gspphot", "logg_gspphot", "lum_flame", "radius_gspphot", "mass_flame", "vbroad")


def _inputs(df: DataFrame, t: Thresholds) -> dict[str, Column]:
    """What several rules read: weights, the spectral label, the absolute magnitude, and whether a temperature is known."""
    text = F.col("spectraltype_esphs") if "spectraltype_esphs" in df.columns else F.lit(None).cast("string")
    p, e, g = (_col(df, n) for n in ("parallax", "parallax_error", "phot_g_mean_mag"))
    sharp = (p > 0) & (e > 0) & (p / e >= t.sharp_parallax)
    m = F.when(sharp, g + 5.0 * F.log10(p / 1000.0) + 5.0 - F.coalesce(F.col("__ag"), F.lit(0.0)))
    known = _col(df, "teff_gspphot").isNotNull() & ~_poor(df, "teff_gspphot", t)
    return {n: _weight(df, n, t) for n in WEIGHED} | {"spectral": normal_label(text), "said": known_text(text).isNotNull(), "absolute": m, "known": known}


def _steps(df: DataFrame, t: Thresholds) -> list[tuple[Column, Column, dict, dict]]:
    """(counts as a feature, applies, points by class, group marks) of every rule, in order."""
    c = lambda n: _col(df, n)
    made = lambda n: F.col(f"__in_{n}")
    no = F.lit(False)
    teff, logg, lum, radius, mass, vb = (c(n) for n in WEIGHED)
    wt, wg, wl, wr, wm, wv = (made(n) for n in WEIGHED)
    spectral, said, m, known = made("spectral"), made("said"), made("absolute"), made("known")
    rv = c("rv_amplitude_robust")
    span, deviation = c("trimmed_range_mag_g_fov"), c("std_dev_mag_g_fov")
    skew, kurt = F.abs(c("skewness_mag_g_fov")), c("kurtosis_mag_g_fov")
    intrinsic = F.when(F.col("reddening_quality") == "good", F.col("bp_rp_intrinsic"))
    colour = c("bp_rp")
    # The points of each rule and the order of the rules. The last entry names the classes for which a rule
    # is a group of evidence by itself, and what it adds to the variability.
    rules: list = []
    add = lambda counts, when, points, groups=(): rules.append((counts, when, points, groups))
    add(said, spectral == "B", {"BE": 1.5, "GCAS": 1.2, "SDOR": 0.4})
    add(no, spectral == "O", {"WR": 1.2, "SDOR": 0.4}, ("WR",))
    add(known, known & teff.between(t.be_teff_low, t.be_teff_high), {"BE": 2 * wt, "GCAS": 1.7 * wt})
    add(no, known & teff.between(t.hot_low, t.hot_high), {"SDOR": 0.7 * wt})
    add(no, known & (teff >= t.wr_teff), {"WR": 2 * wt, "BE": -0.8 * wt, "GCAS": -0.5 * wt}, ("WR",))
    add(no, known & (teff >= t.wr_teff_strong), {"WR": 1 * wt})
    add(logg.isNotNull(), logg >= t.logg_high, {"BE": 0.8 * wg, "GCAS": 0.6 * wg})
    add(no, logg <= t.logg_low, {"SDOR": 2 * wg}, ("SDOR",))
    add(no, logg <= t.logg_very_low, {"SDOR": 1 * wg})
    add(lum.isNotNull(), (lum >= t.lum_low) & (lum < t.lum_high), {"BE": 1 * wl, "GCAS": 0.8 * wl})
    add(no, lum >= t.lum_high, {"SDOR": 1.3 * wl, "WR": 1 * wl}, ("SDOR", "WR"))
    add(no, lum >= t.lum_very_high, {"SDOR": 2 * wl, "WR": 1 * wl})
    add(no, lum < t.lum_low, {"SDOR": -1 * wl, "WR": -0.8 * wl})
    add(m.isNotNull(), m <= t.mag_bright, {"SDOR": 1.0, "WR": 0.7}, ("SDOR", "WR"))
    add(no, (m > t.mag_bright) & (m <= t.mag_faint), {"BE": 0.5, "GCAS": 0.4})
    add(no, m <= t.mag_very_bright, {"SDOR": 1.0, "WR": 0.5})
    add(radius.isNotNull(), radius.between(t.radius_low, t.radius_high), {"BE": 0.7 * wr, "GCAS": 0.6 * wr, "WR": 1 * wr}, ("WR",))
    add(no, radius >= t.radius_large, {"SDOR": 2.5 * wr, "WR": -1 * wr}, ("SDOR",))
    add(no, radius >= t.radius_very_large, {"SDOR": 1 * wr})
    add(mass.isNotNull(), (mass >= t.mass_low) & (mass < t.mass_high), {"BE": 0.7 * wm, "GCAS": 0.5 * wm})
    add(no, mass >= t.mass_wr, {"WR": 1 * wm}, ("WR",))
    add(no, mass >= t.mass_sdor, {"SDOR": 2 * wm}, ("SDOR",))
    add(no, mass >= t.mass_very_high, {"SDOR": 1 * wm})
    add(intrinsic.isNotNull(), intrinsic <= t.blue_intrinsic, {"BE": 0.8, "GCAS": 0.7, "SDOR": 0.3, "WR": 0.5})
    add(no, intrinsic.isNull() & (colour <= t.blue_observed), {"BE": 0.2, "GCAS": 0.2, "SDOR": 0.1, "WR": 0.1})
    add(vb.isNotNull(), vb >= t.broad, {"BE": 1.5 * wv, "GCAS": 0.7 * wv})
    add(no, vb >= t.very_broad, {"BE": 1.2 * wv, "GCAS": 0.5 * wv, "WR": 0.8 * wv}, ("WR",))
    add(rv.isNotNull(), rv >= t.rv_high, {"GCAS": 0.5, "WR": 0.3})
    add(span.isNotNull(), span <= t.range_small, {"BE": 1.5, "WR": 0.7})
    add(no, (span > t.range_small) & (span < t.range_middle), {"GCAS": 1.5, "SDOR": 0.5}, ("VAR1.5",))
    add(no, span >= t.range_middle, {"GCAS": 1.5, "SDOR": 1.5}, ("VAR1.5",))
    add(no, span >= t.range_large, {"GCAS": 0.5, "SDOR": 1.5}, ("VAR0.5",))
    add(deviation.isNotNull(), deviation <= t.deviation_small, {"BE": 1.0, "WR": 0.5})
    add(no, (deviation > t.deviation_small) & (deviation < t.deviation_large), {"GCAS": 1.0}, ("VAR1",))
    add(no, deviation >= t.deviation_large, {"GCAS": 1.0, "SDOR": 1.0}, ("VAR1",))
    add(skew.isNotNull(), skew >= t.skew_high, {"GCAS": 1.2}, ("VAR1.2",))
    add(no, skew >= t.skew_very_high, {"GCAS": 0.7}, ("VAR0.7",))
    add(kurt.isNotNull(), kurt >= t.kurtosis_high, {"GCAS": 1.2}, ("VAR1.2",))
    add(no, kurt >= t.kurtosis_very_high, {"GCAS": 0.7}, ("VAR0.7",))
    return rules


def scores(df: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Adds score_be, score_gcas, score_sdor, score_wr (clamped at 0 after every rule), n_features, groups_wr,
    groups_sdor and variability. Expects reddening's columns.
    """
    compile_in_parts(df.sparkSession)
    # inputs and conditions are columns: as parts of each score that mentions them they would be computed again and again
    rules = _steps(df, t)
    out = df.withColumns({f"__in_{n}": v for n, v in _inputs(df, t).items()})
    out = out.withColumns({f"__on_{i}": F.coalesce(when, F.lit(False)) for i, (_, when, _, _) in enumerate(rules)})
    ok = [F.col(f"__on_{i}") for i in range(len(rules))]
    extra = {}
    for name in CLASSES:
        total = F.lit(0.0)
        for on, (_, _, p, _) in zip(ok, rules):
            if name in p:
                total = F.greatest(F.lit(0.0), total + F.when(on, F.lit(p[name]) if not isinstance(p[name], Column) else p[name]).otherwise(0.0).cast("double"))
        extra[f"score_{name.lower()}"] = total
    extra["n_features"] = sum((F.coalesce(counts, F.lit(False)).cast("int") for counts, _, _, _ in rules), F.lit(0))
    for name in ("WR", "SDOR"):
        extra[f"groups_{name.lower()}"] = sum((on.cast("int") for on, (_, _, _, groups) in zip(ok, rules) if name in groups), F.lit(0))
    extra["variability"] = sum((F.when(on, float(g[3:])).otherwise(0.0) for on, (_, _, _, groups) in zip(ok, rules) for g in groups if g.startswith("VAR")), F.lit(0.0))
    return out.withColumns(extra).drop(*(c for c in out.columns if c.startswith(("__in_", "__on_"))))


def classify(df: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Adds resolved_class, classification_score, classification_margin, classification_method and
    classification_flags, and what reddening and scores add.

    A literature label decides; else a spectral text; else the best score if it passes the limits. No row is lost.
    """
    rows = scores(reddening(df, t), t)
    literature = F.coalesce(*(label_class(F.col(c)) for c in LITERATURE if c in df.columns), F.lit(None).cast("string"))
    spectral = spectral_class(F.col("spectraltype_esphs")) if "spectraltype_esphs" in df.columns else F.lit(None).cast("string")
    spectral = F.when((spectral == "BE") & (F.col("variability") >= t.least_variability), "GCAS").otherwise(spectral)
    rows = rows.withColumns({"__literature": literature, "__spectral": spectral})
    for name in CLASSES:
        bonus = F.when(F.col("__literature") == name, 12.0).when(F.col("__literature").isNull() & (F.col("__spectral") == name), 8.0).otherwise(0.0)
        rows = rows.withColumn(f"score_{name.lower()}", F.col(f"score_{name.lower()}") + bonus)
    order = F.sort_array(F.array(*(F.struct((-F.col(f"score_{n.lower()}")).alias("s"), F.lit(n).alias("n")) for n in CLASSES)))
    rows = rows.withColumn("__order", order)
    top, second = -F.col("__order")[0]["s"], -F.col("__order")[1]["s"]
    rows = rows.withColumns({"__winner": F.col("__order")[0]["n"], "__top": top, "classification_margin": top - second})
    parent = _col(df, "best_class_score")
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    trust = F.coalesce(0.85 + 0.15 * F.when(parent.isNotNull(), unit(parent)), F.lit(1.0))
    confidence = unit((0.65 * unit(F.col("__top") / 9.0) + 0.35 * unit(F.col("classification_margin") / F.greatest("__top", F.lit(1e-12)))) * trust)
    rows = rows.withColumn("__confidence", confidence)
    teff = _col(df, "teff_gspphot")
    text = F.col("spectraltype_esphs") if "spectraltype_esphs" in df.columns else F.lit(None).cast("string")
    hot = F.when(teff.isNotNull(), teff.between(t.hot_low, t.hot_high) & ~_poor(df, "teff_gspphot", t)).otherwise(F.coalesce(normal_label(text).isin("B", "O"), F.lit(False)))
    winner = F.col("__winner")
    why = (
        F.when(F.col("n_features") < t.least_features, "insufficient_data")
        .when((winner == "GCAS") & (F.col("variability") < t.least_variability), "ambiguous_be_gcas")
        .when((winner == "SDOR") & (F.col("groups_sdor") < t.least_groups), "sdor_without_multiple_physical_indicators")
        .when((winner == "SDOR") & ~hot, "sdor_without_hot_star_profile")
        .when((winner == "WR") & (F.col("groups_wr") < t.least_groups), "wr_without_multiple_physical_indicators")
        .when((F.col("__top") < t.least_score) | (F.col("classification_margin") < t.least_margin) | (F.col("__confidence") < t.least_confidence), "ambiguous")
    )
    s = lambda n: F.col(f"score_{n}")
    close = lambda a, b: (F.abs(s(a) - s(b)) < t.least_margin) & (F.greatest(s(a), s(b)) >= t.least_score)
    pair = F.when(close("sdor", "wr"), "ambiguous_sdor_wr").when(close("be", "gcas"), "ambiguous_be_gcas")
    scored = F.col("__literature").isNull() & F.col("__spectral").isNull()
    rows = rows.withColumns({"__why": F.when(scored, why), "__pair": pair})
    chosen = F.coalesce("__literature", "__spectral", F.when(F.col("__why").isNull(), winner), F.lit("UNKNOWN"))
    score = F.when(F.col("__literature").isNotNull(), 1.0).when(F.col("__spectral") == "BE", 0.90).when(F.col("__spectral").isNotNull(), 0.95).otherwise(F.col("__confidence"))
    method = F.when(F.col("__literature").isNotNull(), "literature_label").when(F.col("__spectral").isNotNull(), "spectral_type").when(F.col("__why") == "insufficient_data", "insufficient_data").when(F.col("__why").isNotNull(), "ambiguous").otherwise("multi_feature_score")
    flag = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), name)
    poor = F.lit(False)
    for name in WEIGHED:
        poor = poor | _poor(df, name, t)
    lost = F.col("__why").isNotNull()
    more = F.array(
        flag(known_text(text).isNull(), "missing_spectral_type"), flag(teff.isNull(), "missing_teff"), flag(_col(df, "logg_gspphot").isNull(), "missing_logg"),
        flag(_col(df, "lum_flame").isNull(), "missing_luminosity"), flag(_col(df, "radius_gspphot").isNull(), "missing_radius"),
        flag(poor, "large_parameter_uncertainty"), flag(parent < t.low_parent_score, "low_parent_class_score"),
        F.when(F.col("__why") != "ambiguous", F.col("__why")), F.when(lost, F.col("__pair")), flag(lost, "low_confidence"),
    )
    flags = F.concat_ws(";", F.array_distinct(F.concat(F.col("extinction_flags"), F.array_compact(more))))
    rows = rows.withColumns({"resolved_class": chosen, "classification_score": score, "classification_method": method, "classification_flags": flags})
    return rows.drop("__ag", "__literature", "__spectral", "__order", "__winner", "__top", "__confidence", "__why", "__pair")


# The columns whose medians the report gives.
REPORTED = ("teff_gspphot", "logg_gspphot", "lum_flame", "radius_gspphot", "mass_flame", "vbroad", "trimmed_range_mag_g_fov", "std_dev_mag_g_fov")


def report(rows: DataFrame) -> DataFrame:
    """(class, n, a median for each of REPORTED): rows and medians of each class."""
    have = [c for c in REPORTED if c in rows.columns]
    # counts and medians read the classes, which are costly: they are made once
    rows = written(rows.select("resolved_class", *have), "classified")
    long = rows.select("resolved_class", F.explode(F.array(*(F.struct(F.lit(c).alias("of"), F.col(c).cast("double").alias("v")) for c in have))).alias("x")).select("resolved_class", "x.of", "x.v")
    medians = group_percentiles(long, ["resolved_class", "of"], "v", [0.5])
    wide = medians.groupBy("resolved_class").agg(*(F.max(F.when(F.col("of") == c, F.col("p")[0])).alias(f"median_{c}") for c in have))
    return rows.groupBy("resolved_class").agg(F.count("*").alias("n")).join(wide, "resolved_class", "left")


def report_counts(rows: DataFrame) -> DataFrame:
    """(what, value, n): rows of each class, method and reddening quality, in one pass."""
    pairs = F.array(*(F.struct(F.lit(what).alias("what"), F.col(c).alias("value")) for what, c in (("class", "resolved_class"), ("method", "classification_method"), ("reddening", "reddening_quality"))))
    return rows.select(F.explode(pairs).alias("x")).groupBy("x.what", "x.value").agg(F.count("*").alias("n"))


def invariants(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: whether no row was lost, ids are unique and every class is known."""
    a = before.agg(F.count("*").alias("n_in"))
    b = after.agg(F.count("*").alias("n_out"), F.countDistinct("source_id").alias("n_ids"), F.count_if(~F.col("resolved_class").isin(*CLASSES, "UNKNOWN")).alias("n_wrong"))
    return a.crossJoin(b).select("n_in", "n_out", "n_ids", "n_wrong", ((F.col("n_in") == F.col("n_out")) & (F.col("n_out") == F.col("n_ids")) & (F.col("n_wrong") == 0)).alias("ok"))


def write_by_class(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per class; the whole folder is the catalogue of all classes."""
    rows.write.mode(mode).partitionBy("resolved_class").parquet(path)
