"""Colours, temperatures, fluxes and distances as column expressions; null in, null out unless stated."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Solar and fallback temperatures (K), colour limits, and the display palette by temperature.
SOLAR_K, VARIABLE_FALLBACK_K = 5772.0, 5800.0
COLOUR_LOW, COLOUR_HIGH, COLOUR_HIGH_VARIABLE = -0.5, 4.0, 5.0
VIVID = (
    (2500.0, 1.0, 0.25, 0.08),
    (3500.0, 1.0, 0.55, 0.18),
    (5000.0, 1.0, 0.85, 0.45),
    (5800.0, 1.0, 0.95, 0.85),
    (7000.0, 0.85, 0.90, 1.0),
    (9000.0, 0.65, 0.80, 1.0),
    (10000.0, 0.45, 0.65, 1.0),
)
SPECTRAL = ((30000, "O"), (10000, "B"), (7500, "A"), (6000, "F"), (5200, "G"), (3700, "K"))
PARSECS = {"pc": 1.0, "kpc": 1e3, "mpc": 1e6, "ly": 0.30660139378555057, "au": math.pi / 648000.0}


def clip(c: Column, low: float | Column | None, high: float | Column | None) -> Column:
    """Between the limits; unlike greatest and least alone, null stays null."""
    out = c
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(float(low)))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(float(high)))
    return F.when(c.isNotNull(), out)


def colour_temperature(bp_rp: Column, high: float = COLOUR_HIGH) -> Column:
    """Effective temperature (K) from the BP-RP colour."""
    x = 0.92 * clip(bp_rp, COLOUR_LOW, high)
    return 4600.0 * (1.0 / (x + 1.7) + 1.0 / (x + 0.62))


def temperature(teff: Column, bp_rp: Column, fallback: float = SOLAR_K) -> Column:
    """Measured temperature, else from the colour, else the fallback."""
    return F.coalesce(teff, colour_temperature(bp_rp), F.lit(fallback))


def black_body_rgb(kelvin: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue in [0, 1] of a black body."""
    t = clip(kelvin, 1000.0, 40000.0) / 100.0
    hot = F.greatest(t - 60.0, F.lit(1e-9))
    red = F.when(t <= 66.0, 1.0).otherwise(1.292936186062745 * F.pow(hot, F.lit(-0.1332047592)))
    green = F.when(t <= 66.0, 0.3900815787690196 * F.ln(t) - 0.6318414437886275).otherwise(1.129890860895294 * F.pow(hot, F.lit(-0.0755148492)))
    cool = 0.5432067891101961 * F.ln(F.greatest(t - 10.0, F.lit(1e-9))) - 1.19625408914
    blue = F.when(t >= 66.0, 1.0).when(t <= 19.0, 0.0).otherwise(cool)
    return tuple(F.when(t.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))) for c in (red, green, blue))


def vivid_rgb(kelvin: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue of the display palette, linear between its anchors."""
    t = clip(kelvin, VIVID[0][0], VIVID[-1][0])
    out = []
    for channel in (1, 2, 3):
        value = F.when(t <= VIVID[0][0], VIVID[0][channel])
        for a, b in zip(VIVID, VIVID[1:]):
            value = value.when(t <= b[0], a[channel] + (t - a[0]) * ((b[channel] - a[channel]) / (b[0] - a[0])))
        out.append(value)
    return tuple(out)


def flux(magnitude: Column, ceiling: Column | float | None = None) -> Column:
    """Relative flux of a magnitude, at most `ceiling`."""
    value = F.pow(F.lit(10.0), -0.4 * magnitude)
    return value if ceiling is None else clip(value, None, ceiling)


def magnitude(value: Column) -> Column:
    return F.when(value > 0, -2.5 * F.log10(value))


def positive(c: Column) -> Column:
    return F.when(c > 0, c)


def first_positive(*columns: Column, default: float | None = None) -> Column:
    """The first value above zero, else the default."""
    return F.coalesce(*(positive(c) for c in columns), F.lit(default))


def distance_columns(parallax: Column, error: Column) -> dict[str, Column]:
    """Distance (pc), its low and high value and the relative error; parallaxes and errors of 0 or less are missing."""
    p, e = positive(parallax), positive(error)
    return {
        "distance_pc": 1000.0 / p,
        "distance_low_pc": 1000.0 / (p + e),
        "distance_high_pc": F.when(p > e, F.try_divide(F.lit(1000.0), p - e)),
        "parallax_relative_error": e / p,
    }


def absolute_magnitude(g: Column, parallax: Column, error: Column, extinction: Column | None = None, least_ratio: float = 5.0) -> Column:
    """Absolute magnitude, less the extinction where it is known; needs parallax / error of at least `least_ratio`."""
    p, e = positive(parallax), positive(error)
    plain = F.when(p / e >= least_ratio, g + 5.0 * F.log10(p / 1000.0) + 5.0)
    return plain if extinction is None else plain - F.coalesce(extinction, F.lit(0.0))


def spectral_letter(kelvin: Column) -> Column:
    out = F.when(kelvin.isNull(), None)
    for bound, letter in SPECTRAL:
        out = out.when(kelvin >= bound, letter)
    return out.otherwise("M")


def hex_colour(red: Column, green: Column, blue: Column) -> Column:
    """#rrggbb of channels in [0, 1]; halves are rounded to even."""
    part = lambda c: F.lpad(F.lower(F.hex(F.bround(clip(c, 0, 1) * 255.0, 0).cast("long"))), 2, "0")
    return F.concat(F.lit("#"), part(red), part(green), part(blue))


def css_colour(red: Column, green: Column, blue: Column) -> Column:
    """rgb(r, g, b) of channels in [0, 1]; halves are rounded to even."""
    part = lambda c: F.bround(clip(c, 0, 1) * 255.0, 0).cast("int").cast("string")
    return F.concat(F.lit("rgb("), part(red), F.lit(", "), part(green), F.lit(", "), part(blue), F.lit(")"))


def to_parsecs(value: Column, unit: Column) -> Column:
    """A distance in parsecs; null for an unknown unit."""
    out = F.when(F.lower(unit) == "pc", value)
    for name, factor in PARSECS.items():
        out = out.when(F.lower(unit) == name, value * factor)
    return out


def stretch(value: Column, kind: str, strength: float = 8.0, gamma: float = 1.0) -> Column:
    """A value in [0, 1] through a display curve: linear, asinh, log, sqrt, power."""
    strength, gamma = max(strength, 1e-6), max(gamma, 1e-6)
    if kind == "linear":
        return value
    if kind == "asinh":
        return F.asinh(strength * value) / math.asinh(strength)
    if kind == "log":
        return F.log1p(strength * value) / math.log1p(strength)
    if kind == "sqrt":
        return F.sqrt(value)
    if kind in ("power", "gamma"):
        return F.pow(value, F.lit(gamma))
    raise ValueError(f"unknown stretch: {kind}")
