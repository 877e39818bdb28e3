"""Vertices of lines: positions by id, missing ids, and tasks that are as many as the rows ask for."""

import os

import pytest

from skycat import workspace
from skycat.operators import series
from skycat.plans import stars

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_tasks_grow_with_the_rows(spark, monkeypatch):
    wanted = sorted(map(tuple, stars.line_vertices(spark, SF).collect()), key=str)
    files, plain = {}, workspace.written

    def spied(df, label):
        files[label] = len((out := plain(df, label)).inputFiles())
        return out

    monkeypatch.setattr(workspace, "ROWS_A_TASK", 500)
    for module in (stars, series):
        monkeypatch.setattr(module, "written", spied)
    got = sorted(map(tuple, stars.line_vertices(spark, SF).collect()), key=str)
    assert got == wanted
    assert files.keys() == {"stars", "vertices", "placed"}
    assert min(files.values()) >= len(got) / 500 > int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("rows", [1_250_000, 1])
def test_missing_ids_are_listed_and_known_nulls_are_not(spark, monkeypatch, rows):
    monkeypatch.setattr(workspace, "ROWS_A_TASK", rows)
    known = spark.createDataFrame([(i, i / 2 if i % 2 else None, -1.0) for i in range(9)], "hip long, ra double, dec double")
    lines = spark.createDataFrame([(1, [3, 3, 4]), (2, []), (3, None), (None, [8])], "line_id long, hips array<long>")
    got = sorted(map(tuple, series.line_vertices(lines, known).collect()), key=str)
    assert got == sorted([(1, 0, 1.5, -1.0), (1, 1, 1.5, -1.0), (1, 2, None, -1.0), (None, 0, None, -1.0)], key=str)
    more = spark.createDataFrame([(7, [99, 2, 98, 99])], "line_id long, hips array<long>")
    with pytest.raises(KeyError, match=r"\[98, 99\]"):
        series.line_vertices(lines.unionByName(more), known)
