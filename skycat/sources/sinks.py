"""Writing results: whole or not at all, by class, as JSON or CSV, and batches of maps."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import versions


def save(rows: DataFrame, path: str, mode: str = "errorifexists", kind: str = "parquet") -> None:
    """Modes: errorifexists, ignore (keep what is there) and overwrite. Files appear when the job is committed; what is
    overwritten stays until then, and if the job fails.
    """
    if mode == "overwrite":
        versions.replace(rows, path, kind)
    else:
        rows.write.mode(mode).format(kind).save(path)


def save_csv(rows: DataFrame, path: str, columns: Sequence[str], mode: str = "errorifexists") -> None:
    rows.select(*columns).write.mode(mode).option("header", True).csv(path)


# The columns of the comparison table.
COMPARISON = ("scenario", "observer_time_days", "filter", "apparent_magnitude", "absolute_magnitude", "observed_flux_w_m2", "temperature_k", "photospheric_radius_m")


def save_comparison(rows: DataFrame, path: str, scenario: str, time: str, band: str, magnitude: str, flux: str, distance_pc: float, mode: str = "errorifexists") -> None:
    """The long comparison table of light curves as CSV; rows also hold temperature_k and photospheric_radius_m."""
    absolute = F.col(magnitude) - 5.0 * F.log10(F.lit(float(distance_pc))) + 5.0
    out = rows.select(F.col(scenario).alias("scenario"), F.col(time).alias("observer_time_days"), F.col(band).alias("filter"), F.col(magnitude).alias("apparent_magnitude"), absolute.alias("absolute_magnitude"), F.col(flux).alias("observed_flux_w_m2"), "temperature_k", "photospheric_radius_m")
    save_csv(out, path, COMPARISON, mode)


def slug(text: str) -> str:
    """Lower-case letters and digits joined by single dashes."""
    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-")


def choose(specs: Sequence[dict], selection: str = "all") -> list[dict]:
    """The enabled map specs with unique ids that a selection names: all, an id, a number, or a range like 2-4, by commas."""
    ready = [dict(s, id=slug(str(s.get("id") or s.get("name") or f"map {i}"))) for i, s in enumerate(specs, 1) if s.get("enabled", True)]
    ids = [s["id"] for s in ready]
    if len(set(ids)) != len(ids):
        raise ValueError("map ids are not unique")
    if selection.strip().lower() == "all":
        return ready
    out: list[dict] = []
    for part in (p.strip() for p in selection.split(",")):
        if m := re.fullmatch(r"(\d+)\s*-\s*(\d+)", part):
            found = ready[int(m[1]) - 1 : int(m[2])]
        elif part.isdigit():
            found = ready[int(part) - 1 : int(part)]
        else:
            found = [s for s in ready if s["id"] == slug(part)]
        if not found:
            raise ValueError(f"no such map: {part}")
        out += [s for s in found if s not in out]
    return out


def run_maps(spark: SparkSession, specs: Sequence[dict], build: Callable[[dict], DataFrame], folder: str, selection: str = "all") -> DataFrame:
    """Builds and writes each map; one that fails doesn't stop the others. Returns (id, rows, error), a row for each."""
    done = []
    for spec in choose(specs, selection):
        try:
            save(build(spec), path := f"{folder}/{spec['id']}", "overwrite")
            done.append((spec["id"], spark.read.parquet(path).count(), None))
        except Exception as e:  # a map's own fault is its result
            done.append((spec["id"], None, str(e).splitlines()[0][:300] if str(e) else type(e).__name__))
    return spark.createDataFrame(done, "id string, rows long, error string")
