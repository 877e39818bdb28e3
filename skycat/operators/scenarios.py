"""Scenario parameters as columns: overrides by dotted names, draws within limits, and repairs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import uniform


def _normal(key: Column, seed: int) -> Column:
    """A standard normal number by two hashes of the key."""
    radius = F.sqrt(-2.0 * F.ln(F.greatest(uniform(key, seed), F.lit(2.0**-25))))
    return radius * F.cos(2.0 * 3.141592653589793 * uniform(key, seed + 1))


def override(rows: DataFrame, uncertainty: Mapping[str, Mapping], key: Column, seed: int = 1000) -> DataFrame:
    """`rows` with a parameter drawn anew for each name of `uncertainty`, a column with dots in its name.

    A specification has a distribution (normal: mean, sigma; uniform: min, max; lognormal: log_mean, log_sigma), and
    may have limits min and max. Draws are hashes of `key`, a whole number for each sample, so they don't depend on
    partitioning. An unknown name or distribution is an error.
    """
    columns = {}
    for i, (name, spec) in enumerate(uncertainty.items()):
        if name not in rows.columns:
            raise KeyError(name)
        kind, s = spec.get("distribution", "normal"), seed + 2 * i
        if kind == "normal":
            value = spec["mean"] + spec["sigma"] * _normal(key, s)
        elif kind == "uniform":
            value = spec["min"] + (spec["max"] - spec["min"]) * uniform(key, s)
        elif kind == "lognormal":
            value = F.exp(spec["log_mean"] + spec["log_sigma"] * _normal(key, s))
        else:
            raise ValueError(f"unknown distribution: {kind}")
        value = F.greatest(value, F.lit(float(spec["min"]))) if "min" in spec else value
        columns[name] = F.least(value, F.lit(float(spec["max"]))) if "max" in spec else value
    return rows.withColumns(columns)


def repair(rows: DataFrame, first: str = "progenitor.initial_mass_solar", final: str = "progenitor.final_mass_solar") -> DataFrame:
    """A final mass above the initial one becomes 0.97 of it."""
    a, b = F.col(f"`{first}`"), F.col(f"`{final}`")
    return rows.withColumn(final, F.when(b > a, 0.97 * a).otherwise(b))
