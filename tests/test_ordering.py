"""Exact order statistics against NumPy."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from skycat.operators import ordering
from skycat.operators.ordering import percentiles, with_row_number


def test_percentiles(spark):
    values = np.round(np.random.default_rng(1).normal(0, 3, 3000), 1)
    rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    shares = [0.0, 0.001, 0.37, 0.5, 0.95, 1.0]
    assert percentiles(rows, "x", shares) == pytest.approx(np.quantile(values, shares).tolist())
    assert percentiles(rows.limit(0), "x", [0.5]) == [None]


def test_row_numbers(spark):
    rows = spark.range(1000).selectExpr("id", "cast(id * 7919 % 101 as double) as x")
    got = [r.id for r in with_row_number(rows, "i", ["x", "id"]).orderBy("i").collect()]
    assert got == [r.id for r in rows.orderBy("x", "id").collect()]
    assert with_row_number(rows.limit(0), "i", ["x"]).count() == 0


def test_group_percentiles(spark):
    """Exact for tiny, tied, hot and null groups, as numpy's linear interpolation."""
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(0, 1, 30_000).tolist(), "b": [1.0], "c": [2.0, 2.0, 2.0, 7.0], None: rng.integers(0, 5, 501).tolist(), "d": rng.normal(0, 1e6, 22).tolist(), "e": [None, None], "f": [None, 3.0, 4.0]}
    rows = [(k, None if v is None else float(v)) for k, values in groups.items() for v in values]
    shares = [0.0, 0.05, 0.5, 0.9985, 0.95, 1.0]
    got = {r.k: r.p for r in ordering.group_percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", shares).collect()}
    known = {k: [float(x) for x in v if x is not None] for k, v in groups.items()}
    assert set(got) == {k for k, v in known.items() if v}
    for k, p in got.items():
        assert np.allclose(p, np.quantile(known[k], shares), rtol=0, atol=1e-9 * max(1.0, max(map(abs, known[k])))), k


def test_range_groups_equal_bisect(spark):
    from bisect import bisect_right

    points = [1.5, 2.0, 2.5, 7.0, 9.0, 9.5, 20.0]
    rows = spark.range(-2, 25).select(F.col("id").cast("double").alias("x"))
    got = rows.select("x", ordering.range_group(F.col("x"), points).alias("g")).collect()
    assert all(r.g == bisect_right(points, r.x) for r in got)


def test_ties_are_dealt_to_many_chunks(spark):
    """A column of one value, and of nulls: chunks of about equal size, places without gaps in the order of the rest."""
    rows = spark.range(0, 4000, 1, 4).selectExpr("case when id % 3 > 0 then null when id % 2 = 0 then 7 end as x", "id % 1000 as y")
    sizes = [r["count"] for r in ordering.chunked(rows, [], ["x", "y"]).groupBy("__chunk").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)
    same = [r["count"] for r in ordering.chunked(rows.selectExpr("1 as x"), ["x"], []).groupBy("__chunk").count().collect()]
    assert len(same) == 4 and max(same) < 2 * min(same)
    got = with_row_number(rows, "i", ["x", "y"], 0).orderBy("i").collect()
    assert [r.i for r in got] == list(range(4000))
    assert [(r.x is not None, r.x or 0, r.y) for r in got] == sorted((r.x is not None, r.x or 0, r.y) for r in rows.collect())


def test_row_numbers_in_groups(spark):
    rows = spark.range(3000).selectExpr("case when id % 4 = 0 then null when id % 4 = 1 then 'b' else 'a' end as g", "id * 7919 % 101 as x", "id")
    got = {(r.g, r.id): r.i for r in with_row_number(rows, "i", ["x", "id"], 0, ["g"]).collect()}
    groups = {}
    for r in sorted(rows.collect(), key=lambda r: (r.x, r.id)):
        groups.setdefault(r.g, []).append(r.id)
    assert got == {(g, i): n for g, ids in groups.items() for n, i in enumerate(ids)}


def test_scan_equals_windows(spark):
    """Every kind of step against one window a group, on a long series, short ones and null keys."""
    from pyspark.sql import Window

    rows = spark.range(5000).selectExpr("case when id % 10 < 7 then 'long' when id % 50 = 7 then null else concat('s', id % 20) end as g", "id * 7919 % 5003 as t", "case when id % 4 = 0 then null else id % 13 end as v", "id % 7 < 3 as f").cache()
    w = Window.partitionBy("g").orderBy("t")
    differs = lambda a, b: a != b
    wanted = rows.select("g", "t", F.sum("v").over(w).alias("sum"), F.sum("v").over(Window.partitionBy("g")).alias("total"), F.lag("v").over(w).alias("lag"), F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("last"), F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("next"), F.coalesce((F.col("f") != F.lag("f").over(w)).cast("int"), F.lit(0)).alias("c")).withColumn("changes", F.sum("c").over(w)).drop("c")
    steps = {k: ordering.Step(k, F.col("v")) for k in ("sum", "total", "lag", "last", "next")} | {"changes": ordering.Step("changes", F.col("f"), differs)}
    chunks = ordering.chunked(rows, ["g"], ["t"])
    assert chunks.filter("g = 'long'").select("__chunk").distinct().count() >= 3
    got = ordering.scan(chunks, ["g"], **steps).select(wanted.columns)
    assert got.exceptAll(wanted).isEmpty() and wanted.exceptAll(got).isEmpty()


@pytest.mark.parametrize("n", [0, 1, 250, 999, 1000, 5000])
def test_first_rows(spark, n):
    """Ties, nulls, and one interval that holds nearly all rows."""
    rows = spark.range(1000).selectExpr("case when id % 9 = 0 then null when id % 7 = 0 then 1e9 when id % 2 = 0 then 0e0 else id / 1e3 end as x", "id", "id % 3 as g")
    got = sorted(r.id for r in ordering.first_rows(rows, n, ["x", "id"]).collect())
    assert got == sorted(r.id for r in rows.orderBy("x", "id").limit(n).collect())
    groups = {}
    for r in rows.orderBy("x", "id").collect():
        groups.setdefault(r.g, []).append(r.id)
    got = sorted(r.id for r in ordering.first_rows(rows, n, ["x", "id"], ["g"]).collect())
    assert got == sorted(i for ids in groups.values() for i in ids[:n])
