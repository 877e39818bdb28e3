"""Microlensing quantities as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .photometry import clip

# SI constants, the assumed lens, its alternatives, and mass ranges (solar masses) of lens kinds.
LIGHT, GRAVITY, SUN_KG, PARSEC_M = 299_792_458.0, 6.67430e-11, 1.98847e30, 3.085677581491367e16
SPEED_KMS, DISTANCE_SHARE = 100.0, 0.5
SPEEDS_KMS, DISTANCE_SHARES = (50.0, 200.0), (0.25, 0.5, 0.75)
MASS_RANGES = (("free-floating-planet", 1e-6, 0.013), ("neutron-star", 1.0, 2.5), ("black-hole", 2.5, 120.0))
TIME_ZERO_JD = 2_455_197.5
TINY = 2.2250738585072014e-308
# Unix times from which TAI - UTC is 35, 36 and 37 seconds; before the first it is 34.
LEAP_SECONDS = ((1341100800, 35), (1435708800, 36), (1483228800, 37))


def amplification(t: Column, peak: Column, timescale: Column, impact: Column) -> Column:
    """Point-source point-lens amplification at a time."""
    u2 = F.greatest(impact * impact + ((t - peak) / timescale) * ((t - peak) / timescale), F.lit(TINY))
    return (u2 + 2.0) / F.sqrt(u2 * (u2 + 4.0))


def peak_amplification(impact: Column) -> Column:
    u2 = F.when(impact.isNotNull(), F.greatest(impact * impact, F.lit(TINY)))
    return (u2 + 2.0) / F.sqrt(u2 * (u2 + 4.0))


def image_pair(u: Column) -> dict[str, Column]:
    """Positions (in Einstein radii) and magnifications of the two images of a point lens."""
    root = F.sqrt(u * u + 4.0)
    ratio = (u * u + 2.0) / (u * root)
    return {"theta_plus": (u + root) / 2, "theta_minus": (u - root) / 2, "mu_plus": (ratio + 1) / 2, "mu_minus": (ratio - 1) / 2, "mu_total": ratio}


def lens_mass(timescale: Column, distance_pc: Column, speed: float = SPEED_KMS, share: float = DISTANCE_SHARE) -> Column:
    """Lens mass in solar masses for an assumed speed and lens distance (as a share of the source's)."""
    source = distance_pc * PARSEC_M
    radius = speed * 1000.0 * timescale * 86_400.0
    value = LIGHT**2 * radius * radius * (source / ((source * share) * (source - source * share))) / (4.0 * GRAVITY) / SUN_KG
    return F.when((timescale > 0) & (distance_pc > 0), value)


def rescale_mass(mass: Column, speed: Column, share: Column) -> Column:
    """A mass under the standard assumptions, for another speed and share."""
    return mass * F.pow(speed / SPEED_KMS, F.lit(2.0)) * (0.25 / (share * (1.0 - share)))


def mass_scenarios(timescale: Column, distance_pc: Column) -> tuple[Column, Column]:
    """The least and greatest mass over the alternative speeds and shares."""
    values = [lens_mass(timescale, distance_pc, v, f) for v in SPEEDS_KMS for f in DISTANCE_SHARES]
    return F.least(*values), F.greatest(*values)


def mass_category(mass: Column) -> Column:
    """The first mass range that holds the mass."""
    out = F.when(mass.isNull() | (mass <= 0), None)
    for name, low, high in MASS_RANGES:
        out = out.when((mass >= low) & (mass <= high), name)
    return out


def level_one_valid(tmax: Column, te: Column, u0: Column, share: Column) -> Column:
    """Whether the blended fit can be used."""
    known = tmax.isNotNull() & te.isNotNull() & u0.isNotNull() & share.isNotNull()
    return known & F.coalesce((te > 0) & (share > 0), F.lit(False))


def peak_excess(impact: Column, share: Column) -> Column:
    """The blended excess at the peak."""
    return share * F.greatest(peak_amplification(impact) - 1.0, F.lit(0.0))


# The numbers by which an event's size, width and opacity follow from its magnification.
def display(t: Column, peak: Column, timescale: Column, impact: Column, mass: Column, share: Column, height: float, base_sigma: float = 2.0, base_alpha: float = 0.2) -> dict[str, Column]:
    """Display width and opacity of an event at a time."""
    share = clip(share, 0.0, 1.0)
    strength = share * F.greatest(amplification(t, peak, timescale, impact) - 1.0, F.lit(0.0))
    most = F.greatest(share * (peak_amplification(impact) - 1.0), F.lit(0.0))
    progress = F.when(most > 0, clip(F.try_divide(F.log1p(strength), F.log1p(most)), 0.0, 1.0)).otherwise(0.0)
    size = F.sqrt((10.0 + 10000.0 * F.log1p(most)) / math.pi) * (200.0 / 72.0) / 3.0 * clip(mass, 0.3, 5.0) * (height / 4320.0)
    size = clip(size, 2.0, height * 0.08)
    base = base_sigma * height / 8192.0
    top = clip(0.5 + 0.5 * F.log1p(most) / math.log(10.0), 0.5, 1.0)
    return {"strength": strength, "progress": progress, "sigma": base + (size - base) * progress, "alpha": base_alpha + (top - base_alpha) * progress}


def unix_seconds(day: Column) -> Column:
    """UTC seconds since 1970 of a day counted from BJD(TCB) 2455197.5; good to about 2 ms."""
    jd = day + TIME_ZERO_JD
    tdb = jd - 1.550519768e-8 * (jd - 2443144.5003725) - 6.55e-5 / 86400.0
    tai = (tdb - 2440587.5) * 86400.0 - 32.184
    shift = F.lit(34)
    for start, seconds in LEAP_SECONDS:
        shift = F.when(tai - seconds >= start, seconds).otherwise(shift)
    return tai - shift


def source_temperature(teff: Column, bp_rp: Column, ebpminrp: Column, a_bp: Column, a_rp: Column, bp0: Column, rp0: Column, fs_bp: Column, fs_rp: Column, valid: Column) -> tuple[Column, Column]:
    """(temperature, where it comes from): blend-separated and dereddened colours first, the Sun's last."""
    from .photometry import SOLAR_K, colour_temperature

    usable = valid & (fs_bp > 0) & (fs_rp > 0)
    source = F.when(usable, bp0 - rp0 - 2.5 * F.log10(F.when(usable, fs_bp / fs_rp)))
    reddening = F.coalesce(F.when(a_bp - a_rp >= 0, a_bp - a_rp), F.when(ebpminrp >= 0, ebpminrp))
    chain = [
        ("source_intrinsic", colour_temperature(source - reddening)),
        ("teff", teff),
        ("catalog_intrinsic", colour_temperature(bp_rp - reddening)),
        ("source_observed", colour_temperature(source)),
        ("catalog_observed", colour_temperature(bp_rp)),
    ]
    origin = F.when(chain[0][1].isNotNull(), chain[0][0])
    for name, value in chain[1:]:
        origin = origin.when(value.isNotNull(), name)
    return F.coalesce(*(v for _, v in chain), F.lit(SOLAR_K)), origin.otherwise("solar")
