"""Light-curve models: each gives a signal and a colour driver as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import _signed, let, mix, wrapping_add
from .lensing import amplification

TAU = 2.0 * math.pi


def bound(c: Column, low: float | None, high: float | None) -> Column:
    """Between the limits. For values that are never null: it doesn't repeat its argument to keep a null."""
    c = c if low is None else F.greatest(c, F.lit(float(low)))
    return c if high is None else F.least(c, F.lit(float(high)))


def smoothstep(c: Column) -> Column:
    return let(bound(c, 0.0, 1.0), lambda v: v * v * (3.0 - 2.0 * v))


def wrapped(cycle: Column, centre: Column | float) -> Column:
    """Signed distance on the cycle, in [-0.5, 0.5)."""
    return F.pmod(cycle - centre + 0.5, F.lit(1.0)) - 0.5


def bell(distance: Column, width: float) -> Column:
    return F.exp(-0.5 * F.pow(distance / width, F.lit(2.0)))


def rise_and_fall(cycle: Column, rise: float, power: float) -> Column:
    """A quick smooth rise, then a slower decline."""
    x = F.pmod(cycle, F.lit(1.0))
    return F.when(x < rise, smoothstep(x / rise)).otherwise(F.pow(bound(1.0 - (x - rise) / (1.0 - rise), 0.0, 1.0), F.lit(power)))


def wave(*terms: tuple) -> Column:
    """A sum of weight * sin(2 pi * frequency * cycle + phase)."""
    total = None
    for weight, frequency, cycle, phase in terms:
        term = weight * F.sin(TAU * frequency * cycle + phase)
        total = term if total is None else total + term
    return total


def lattice(cell: Column, seed: Column) -> Column:
    """A number in [0, 1) for each time cell and seed."""
    return mix(cell.cast("long").bitwiseXOR(wrapping_add(seed, 0x9E3779B97F4A7C15)))


def smooth_noise(position: Column, seed: Column) -> Column:
    def at(p: Column) -> Column:
        left, right = lattice(F.floor(p), seed), lattice(F.floor(p) + 1, seed)
        return let(left, lambda v: v + (right - v) * smoothstep(p - F.floor(p)))

    return let(position, at)


# The amplitudes, frequencies, widths and times of the models below and of the flux modes.
def models(c: dict[str, Column]) -> dict[str, tuple[Column, Column]]:
    """(signal, colour driver) of every model; without a colour driver it is 2 * signal - 1.

    The inputs are not null. c: cycle, elapsed, period, progress, irregularity, p1, p2 (mode phases), centre, width, shape (of an event).
    """
    x, p1, p2, irregular, zero = c["cycle"], c["p1"], c["p2"], c["irregularity"], F.lit(0.0)
    half = lambda w: bound(0.5 + 0.5 * w, 0.0, 1.0)
    both = lambda s: (s, None)
    relative = (c["progress"] - c["centre"]) / c["width"]

    slow = 0.5 + 0.5 * F.sin(TAU * x - 0.5 * math.pi)
    envelope = 1.0 + irregular * 0.25 * F.sin(TAU * 0.37 * x + p2)
    lbv = bound(0.5 + (slow - 0.5) * envelope + wave((0.10, 7.3, x, p1), (0.06, 11.7, x, p2)), 0.0, 1.0)

    y = F.pmod(x, F.lit(1.0))
    outburst = F.when(y < 0.045, smoothstep(y / 0.045)).when(y < 0.13, 1.0).when(y < 0.43, F.pow(1.0 - (y - 0.13) / 0.30, F.lit(1.35))).otherwise(0.0)

    dips = bound(bell(wrapped(x, 0.0), 0.045) + 0.48 * bell(wrapped(x, 0.5), 0.065), 0.0, 1.0)
    long_wave = F.sin(TAU * x) + 0.22 * F.sin(2.0 * TAU * x + p1) + irregular * 0.18 * F.sin(TAU * 0.47 * x + p2)
    fade = F.when(relative < 0, 0.0).otherwise(smoothstep(bound(relative / 0.10, 0.0, 1.0)) * F.exp(-bound(relative - 0.10, 0.0, None) / 0.80))

    impact = 0.12 + 0.58 * c["shape"]
    one = F.lit(1.0)
    now, peak = amplification(relative, zero, one, impact), amplification(zero, zero, one, impact)
    lens = bound(F.when(peak > 1.0, F.try_divide(now - 1.0, peak - 1.0)).otherwise(0.0), 0.0, 1.0)

    burst = F.when(relative < 0, F.exp(bound(relative / 0.12, -30.0, 0.0))).otherwise(F.exp(-bound(relative, 0.0, None) / 1.35))
    burst_colour = F.when(relative < 0, burst).otherwise(bound(1.0 - 0.75 * relative, -0.55, 1.0))

    dip = bell(wrapped(x, F.pmod(p2 / TAU, F.lit(1.0))), 0.075)
    flare = 0.75 * bell(wrapped(x, F.pmod(p1 / TAU, F.lit(1.0))), 0.035)
    young = bound(wave((0.28, 1.0, x, p1), (0.16, 0.43, x, p2)) + flare - 0.85 * dip, -1.0, 1.0)

    scale = c["elapsed"] / F.greatest(c["period"], F.lit(1e-4))
    nucleus = bound(wave((0.62, 0.173, scale, p1), (0.27, 0.071, scale, p2), (0.11, 0.019, scale, p1 + p2)), -1.0, 1.0)

    seed = F.floor(p1 / TAU * float(1 << 24)).cast("long")
    offset, changes = p2 / TAU * 4096.0, 12.0 + 20.0 * c["shape"]
    level = 0.72 * smooth_noise(offset + c["progress"] * changes, seed) + 0.28 * smooth_noise(offset * 1.731 + c["progress"] * changes * 2.37, seed.bitwiseXOR(F.lit(_signed(0xD1B54A32D192ED03))))

    plain = 0.5 + 0.5 * F.sin(TAU * x)
    return {
        "rr_lyrae": both(rise_and_fall(x, 0.16, 0.72)),
        "cepheid": both(smoothstep(rise_and_fall(x, 0.32, 0.90))),
        "zz_ceti": (half(wave((1.0, 1.0, x, zero), (0.32, 1.071, x, p1), (0.18, 0.927, x, p2)) / 1.5), zero),
        "lbv": both(lbv),
        "cataclysmic": (outburst, outburst),
        "eclipsing": (dips, zero),
        "ellipsoidal": (0.5 + 0.5 * F.cos(2.0 * TAU * x), zero),
        "multimode": both(half(wave((1.0, 1.0, x, zero), (0.28, 1.043, x, p1), (0.16, 0.968, x, p2)) / 1.44)),
        "long_period": both(bound(0.5 + 0.5 * long_wave / 1.4, 0.0, 1.0)),
        "rcb_decline": (fade, fade),
        "microlensing_event": (lens, zero),
        "supernova_event": (burst, burst_colour),
        "yso_irregular": (young, dip),
        "rotational": (half(wave((1.0, 1.0, x, zero), (0.24, 2.0, x, p1)) / 1.24), zero),
        "gentle_pulsation": both(half(wave((1.0, 1.0, x, zero), (0.12, 2.0, x, p1)) / 1.12)),
        "solar_like": (plain, zero),
        "agn_noise": (nucleus, zero),
        "planet_transit": (bell(wrapped(x, 0.0), 0.025), zero),
        "conservative": (plain, zero),
        "stochastic_hot": both(smoothstep(level)),
    }


def light_curve(model: Column, c: dict[str, Column]) -> Column:
    """A struct of the signal and colour of the row's model (null: the colour is 2 * signal - 1); an unknown model is an error when the row is evaluated."""
    value = None
    for name, (signal, colour) in models(c).items():
        if colour is None:  # the colour follows the signal
            colour = F.lit(None)
        pair = F.struct(signal.cast("double").alias("signal"), colour.cast("double").alias("colour"))
        value = F.when(model == name, pair) if value is None else value.when(model == name, pair)
    wrong = F.concat(F.lit("unknown light-curve model: "), F.coalesce(model, F.lit("none")))
    return value.otherwise(F.struct(F.raise_error(wrong).cast("double").alias("signal"), F.lit(0.0).alias("colour")))


def relative_flux(signal: Column, amplitude: Column, mode: Column) -> Column:
    """Flux relative to the mean for a magnitude amplitude (0 to 8), by mode."""
    ratio = F.pow(F.lit(10.0), 0.4 * bound(amplitude, 0.0, 8.0))
    share = bound(signal, 0.0, 1.0)
    return (
        F.when(mode == "range", F.exp((signal - 0.5) * F.ln(ratio)))
        .when(mode == "outburst", 1.0 + (ratio - 1.0) * share)
        .when(mode == "dimming", 1.0 - (1.0 - 1.0 / ratio) * share)
        .when(mode == "signed", F.exp(0.5 * signal * F.ln(ratio)))
        .when(mode == "supernova", 0.035 + (ratio - 0.035) * share)
        .otherwise(F.raise_error(F.concat(F.lit("unknown flux mode: "), F.coalesce(mode, F.lit("none")))).cast("double"))
    )


def display_size(flux: Column, size_scale: Column, size_response: Column, intensity: Column, brightness: Column, height: float, base: float = 3.20, least: float = 2.20, most: float = 12.50) -> tuple[Column, Column]:
    """(sigma in pixels, alpha) of a star with a relative flux."""
    scale = height / 8192.0
    log_flux = F.ln(bound(flux, 0.01, 100.0))
    sigma = base * size_scale * F.exp(bound(size_response * log_flux, -0.65, 0.75)) * scale
    alpha = 0.52 * intensity * F.exp(0.5 * bound(brightness, 0.25, 6.0) * log_flux)
    return bound(sigma, least * scale, most * scale), bound(alpha, 0.012, 0.95)
