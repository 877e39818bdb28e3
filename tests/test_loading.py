"""The loading queries deal their work to as many tasks and files as the session and the input ask for."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from skycat.plans import loading

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture
def paths(monkeypatch):
    """The folders that a query makes, by label."""
    made, fresh = {}, loading.fresh_dir
    monkeypatch.setattr(loading, "fresh_dir", lambda spark, label: made.setdefault(label, fresh(spark, label)))
    return lambda label, files: glob.glob("/" + made[label].removeprefix("file:").lstrip("/") + files)


@pytest.mark.parametrize("query", ["stream_chunks", "stream_histogram"])
def test_chunks_are_as_many_as_the_sessions_tasks(spark, paths, query):
    getattr(loading, query)(spark, SF).collect()
    assert len(paths("chunks", "/*.parquet")) == 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_union_is_dealt_to_the_sessions_tasks(spark, monkeypatch):
    seen, plain = [], loading.tables.fingerprint
    monkeypatch.setattr(loading.tables, "fingerprint", lambda rows: seen.append(rows) or plain(rows))
    assert loading.src_chunks(spark, SF).first().same
    assert seen[1].rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_files_are_as_many_as_stretches_of_ids(spark, paths, monkeypatch):
    monkeypatch.setattr(loading, "STRETCH_BITS", 10)
    back = loading.src_ecsv(spark, SF)
    last = back.agg(F.max("source_id")).first()[0]
    assert 4 < len(paths("ecsv", "/part=*")) <= (last >> 10) + 1


def test_the_archive_takes_a_tasks_share(spark, tmp_path):
    spark.range(3).withColumnRenamed("id", "random_index").write.parquet(path := str(tmp_path / "stars"))
    archive = loading.flaky_archive(path)
    assert archive.db.execute("select current_setting('threads'), current_setting('memory_limit')").fetchone() == (1, "488.2 MiB")
    archive.close()


def test_densities_are_counted_once(spark):
    rows = loading.src_healpix(spark, SF)
    assert "l_orderkey" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.count() == 768
