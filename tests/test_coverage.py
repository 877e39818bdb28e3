"""Covers of cones and boxes, and scans of sorted tables, against tests of every point."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skycat.functions import coords
from skycat.operators import coverage
from skycat.workspace import written


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(4)
    return rng.uniform(0, 360, 40_000), np.degrees(np.arcsin(rng.uniform(-1, 1, 40_000)))


@pytest.fixture(scope="module")
def sky(spark, points):
    return spark.createDataFrame([(i, float(l), float(b)) for i, (l, b) in enumerate(zip(*points))] + [(-1, None, 0.0), (-2, 5.0, 91.0)], "source_id long, l double, b double").cache()


@pytest.fixture(scope="module")
def pixels(sky):
    return written(coverage.with_pixel(sky, order=9, name="p"), "pixels")


SHAPES = {
    "cone": [coverage.Cone(280.4652, -32.8884, 12.0)],
    "pole": [coverage.Cone(10.0, 89.0, 3.0)],
    "seam": [coverage.Cone(0.2, 1.0, 2.5)],
    "half": [coverage.Cone(100.0, 10.0, 95.0)],
    "tiny": [coverage.Cone(47.0, -47.0, 0.01)],
    "box": [coverage.Box(coords.Region())],
    "band": [coverage.Box(coords.Region(180.0, 0.0, 360.0, 20.0))],
    "cap": [coverage.Box(coords.Region(20.0, 85.0, 60.0, 10.0))],
    "two": [coverage.Cone(280.4652, -32.8884, 12.0), coverage.Cone(302.8084, -44.3277, 8.0)],
}


def inside(shapes):
    exact = F.lit(False)
    for s in shapes:
        exact = exact | s.inside(F.col("l"), F.col("b"))
    return exact & coords.valid_position(F.col("l"), F.col("b"))


@pytest.mark.parametrize("order", [0, 1, 3, 6])
def test_centres_lie_in_their_pixels(spark, order):
    pixels = np.unique(np.linspace(0, 12 * 4**order - 1, 600).astype(np.int64))
    l, b = coverage.centres(order, pixels)
    rows = spark.createDataFrame([(int(p), float(x), float(y)) for p, x, y in zip(pixels, l, b)], "p long, l double, b double")
    assert rows.filter(coords.healpix_nested(1 << order, F.col("l"), F.col("b")) != F.col("p")).count() == 0


def test_no_point_is_farther_from_its_centre_than_the_radius(spark, sky):
    for order in (0, 2, 5):
        pixel = coords.healpix_nested(1 << order, F.col("l"), F.col("b"))
        rows = sky.filter("source_id >= 0").select("l", "b", pixel.alias("p")).toPandas()
        l, b = coverage.centres(order, rows.p.to_numpy())
        a, d, e, f = map(np.radians, (rows.l.to_numpy(), rows.b.to_numpy(), l, b))
        far = np.degrees(np.arccos(np.clip(np.sin(d) * np.sin(f) + np.cos(d) * np.cos(f) * np.cos(a - e), -1, 1)))
        assert 0.7 * coverage.radius(order) < far.max() <= coverage.radius(order) + 1e-6


@pytest.mark.parametrize("name", SHAPES)
@pytest.mark.parametrize("most", [8, 64, 400])
def test_cover_holds_every_point(pixels, name, most):
    shapes = SHAPES[name]
    ranges = coverage.cover(shapes, 9, most)
    assert len(ranges) <= max(most, 12) and all(x[1] + 1 < y[0] for x, y in zip(ranges, ranges[1:]))
    exact = inside(shapes)
    rows = pixels.withColumn("covered", F.coalesce(coverage.within(F.col("p"), ranges), F.lit(False)))
    assert rows.filter(exact & ~F.col("covered")).count() == 0
    if most == 400 and name in ("cone", "two", "box"):
        # the cover isn't much larger than what it covers
        assert rows.filter("covered").count() < 1.3 * rows.filter(exact).count()


def rows_scanned(spark, df) -> int:
    """Rows that the scan of the last query handed on, after row groups and pages were skipped."""
    df.write.format("noop").mode("overwrite").save()
    store = spark._jsparkSession.sharedState().statusStore()
    last = max((store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())))
    values, nodes = store.executionMetrics(last), store.planGraph(last).allNodes()
    for i in range(nodes.size()):
        if nodes.apply(i).name().startswith("Scan parquet"):
            metrics = nodes.apply(i).metrics()
            for j in range(metrics.size()):
                if metrics.apply(j).name() == "number of output rows":
                    return int(values.get(metrics.apply(j).accumulatorId()).get().replace(",", ""))
    raise LookupError("no scan")


@pytest.mark.parametrize("name", ["cone", "box", "pole", "two"])
def test_scan_reads_less_and_finds_the_same(spark, sky, tmp_path, name):
    path = str(tmp_path / "sky")
    coverage.save_sorted(sky, path, files=16, group_bytes=1 << 16)
    shapes = SHAPES[name]
    got = coverage.read_inside(spark, path, shapes)
    exact = inside(shapes)
    wanted = sky.filter(exact)
    assert sorted(r.source_id for r in got.collect()) == sorted(r.source_id for r in wanted.collect())
    whole = rows_scanned(spark, spark.read.parquet(path).filter(exact))
    assert whole == sky.count()
    assert rows_scanned(spark, got) < {"cone": 0.2, "box": 0.6, "pole": 0.25, "two": 0.3}[name] * whole


def test_lookup(spark, sky):
    values = spark.range(0, 768, 2).select(F.col("id").alias("pix"), (F.col("id") * 3).alias("v"))
    rows = coverage.lookup(sky.filter("source_id >= 0"), values, 8, nested=True)
    assert rows.filter("(pix % 2 = 0 and v <> pix * 3) or (pix % 2 = 1 and v is not null)").count() == 0 and rows.count() == 40_000
    some = coverage.points_inside(values, SHAPES["cone"], 3)
    assert 0 < some.count() < 60 and math.isclose(coverage.radius(3), 6.0, rel_tol=0.3)


def test_pixels_are_found_with_few_sines(sky):
    """Conditions that repeat the place of a pixel for each of its bits cost most of a sorted table's time."""
    plan = coverage.with_pixel(sky)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SIN(") <= 3
