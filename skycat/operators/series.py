"""Time series: percentile envelopes, peaks, bright phases, interpolation and polylines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import dealt, written
from .ordering import Step, chunked, group_percentiles, scan


def envelope(samples: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float] = (0.05, 0.5, 0.95)) -> DataFrame:
    """Percentiles of the samples of each key."""
    rows = group_percentiles(samples, keys, value, shares)
    return rows.select(*keys, *(F.col("p")[i].alias(f"p{round(s * 100):02d}") for i, s in enumerate(shares)))


def peak_percentiles(samples: DataFrame, keys: Sequence[str], sample: str, time: str, value: str, shares: Sequence[float] = (0.05, 0.5, 0.95)) -> DataFrame:
    """Percentiles, over the samples of each key, of the time and the value of a sample's peak."""
    rows = peaks(samples, [*keys, sample], time, value)
    both = rows.select(*keys, F.explode(F.array(F.struct(F.lit("time").alias("of"), F.col("peak_time").alias("v")), F.struct(F.lit("value").alias("of"), F.col("peak_value").alias("v")))).alias("x")).select(*keys, "x.of", "x.v")
    found = group_percentiles(both, [*keys, "of"], "v", shares)
    return found.select(*keys, "of", *(F.col("p")[i].alias(f"p{round(s * 100):02d}") for i, s in enumerate(shares)))


def peaks(samples: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """Time and value of the least magnitude of each key, the first of equals."""
    best = F.min(F.struct(F.col(value).alias("v"), F.col(time).alias("t"))).alias("p")
    return samples.filter(F.col(value).isNotNull()).groupBy(*keys).agg(best).select(*keys, F.col("p.t").alias("peak_time"), F.col("p.v").alias("peak_value"))


def bright_phase(samples: DataFrame, keys: Sequence[str], time: str, value: str, window: float) -> DataFrame:
    """Start and end of the unbroken run around the peak that stays within `window` magnitudes of it.

    Series are read in sorted chunks, so one of any length is no single task; the same holds for the operators below.
    """
    known = samples.filter(F.col(value).isNotNull()).select(*keys, F.col(time).alias("t"), F.col(value).alias("v"))
    rows = scan(chunked(known, keys, ["t"]), keys, peak=Step("least", F.struct("v", "t")))
    rows = scan(rows.withColumn("bright", F.col("v") <= F.col("peak.v") + window), keys, run=Step("changes", F.col("bright"), lambda a, b: a != b))
    runs = rows.filter("bright").groupBy(*keys, "run").agg(F.min("t").alias("start"), F.max("t").alias("stop"), F.max((F.col("t") == F.col("peak.t")).cast("int")).alias("holds_peak"))
    return runs.filter("holds_peak = 1").select(*keys, "start", "stop")


def interpolate(samples: DataFrame, at: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """(keys, at, value) for each series and each time of `at` (key columns and at): linear between samples, constant
    beyond the ends.

    One scan of the union of samples and wanted times finds the neighbours, so there is no range join.
    """
    rows = samples.filter(F.col(value).isNotNull()).select(*keys, F.col(time).alias("t"), F.col(value).alias("v"), F.lit(0).alias("asked"))
    wanted = at.select(*keys, F.col("at").alias("t"), F.lit(None).cast("double").alias("v"), F.lit(1).alias("asked"))
    known = F.when(F.col("asked") == 0, F.struct("t", "v"))
    both = scan(chunked(rows.unionByName(wanted), keys, ["t", "asked"]), keys, lo=Step("last", known), hi=Step("next", known))
    span = F.col("hi.t") - F.col("lo.t")
    between = F.col("lo.v") + (F.col("hi.v") - F.col("lo.v")) * F.try_divide(F.col("t") - F.col("lo.t"), span)
    result = F.when(F.col("lo").isNull(), F.col("hi.v")).when(F.col("hi").isNull() | (span == 0), F.col("lo.v")).otherwise(between)
    return both.filter("asked = 1").select(*keys, F.col("t").alias("at"), result.alias("value"))


def _pieces(points: DataFrame, line: str, seq: str, step: Step, kept: Column) -> DataFrame:
    """The kept points of the pieces, numbered from 0, into which a step cuts lines; pieces of one point go."""
    rows = scan(chunked(points, [line], [seq]), [line], piece=step).filter(kept)
    rows = scan(rows, [line, "piece"], __size=Step("total", F.lit(1)))
    return rows.filter("__size >= 2").select(*points.columns, "piece")


def split_seams(points: DataFrame, width: float, line: str = "line_id", seq: str = "seq", x: str = "x") -> DataFrame:
    """Polylines cut where neighbours are over a quarter of the image apart; pieces of one point go. Adds piece."""
    return _pieces(points, line, seq, Step("changes", F.col(x), lambda a, b: F.abs(b - a) > width / 4), F.lit(True))


def visible_runs(points: DataFrame, inside: str, line: str = "line_id", seq: str = "seq") -> DataFrame:
    """The runs of at least two points of a polyline for which `inside` holds. Adds piece."""
    return _pieces(points, line, seq, Step("changes", F.col(inside), lambda a, b: a != b), F.col(inside))


def line_vertices(lines: DataFrame, stars: DataFrame) -> DataFrame:
    """(line_id, seq, ra, dec): the stars of each line (an array of ids, hips); an error lists missing ids.

    One join, whose result is written, finds positions and missing ids. Both its sides are dealt by id, a bounded number
    of rows to a task (see dealt). `stars` is counted first: write it if it is costly to make.
    """
    rows = written(lines.select("line_id", F.posexplode("hips").alias("seq", "hip")), "vertices")
    known, count = stars.select("hip", "ra", "dec", F.lit(True).alias("known")), max(rows.count(), stars.count())
    placed = written(dealt(rows, count, "hip").join(dealt(known, count, "hip"), "hip", "left"), "placed")
    missing = [r.hip for r in placed.filter("known is null").select("hip").distinct().orderBy("hip").limit(10).collect()]
    if missing:
        raise KeyError(f"stars without a position: {missing}")
    return placed.select("line_id", "seq", "ra", "dec")


def great_circle(segments: DataFrame, step: float = 1.0) -> DataFrame:
    """(segment_id, seq, ra, dec): points along great circles (ra1, dec1, ra2, dec2), at most `step` degrees apart."""
    r = lambda c: F.radians(F.col(c))
    cosine = F.sin(r("dec1")) * F.sin(r("dec2")) + F.cos(r("dec1")) * F.cos(r("dec2")) * F.cos(r("ra1") - r("ra2"))
    rows = segments.withColumn("angle", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    rows = rows.withColumn("steps", F.greatest(F.lit(1), F.ceil(F.degrees("angle") / step)).cast("int"))
    rows = rows.withColumn("seq", F.explode(F.sequence(F.lit(0), F.col("steps")))).withColumn("f", F.col("seq") / F.col("steps"))
    curved = F.col("angle") >= 1e-9
    w1 = F.when(curved, F.try_divide(F.sin((1 - F.col("f")) * F.col("angle")), F.sin("angle"))).otherwise(1 - F.col("f"))
    w2 = F.when(curved, F.try_divide(F.sin(F.col("f") * F.col("angle")), F.sin("angle"))).otherwise(F.col("f"))
    axis = lambda f: w1 * f("1") + w2 * f("2")
    x = axis(lambda i: F.cos(r("dec" + i)) * F.cos(r("ra" + i)))
    y = axis(lambda i: F.cos(r("dec" + i)) * F.sin(r("ra" + i)))
    z = axis(lambda i: F.sin(r("dec" + i)))
    rows = rows.withColumns({"x": x, "y": y, "z": z})
    length = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return rows.select("segment_id", "seq", F.pmod(F.degrees(F.atan2("y", "x")), F.lit(360.0)).alias("ra"), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("z") / length)))).alias("dec"))
