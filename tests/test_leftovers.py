"""What jobs of many rounds leave on disk."""
import glob
import os

import pytest
from pyspark.sql import functions as F

from sheenwake import session
from sheenwake.operators import ais, regions
from sheenwake.plans import jobs


@pytest.fixture
def folder(tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_shared_folder", lambda spark: str(tmp_path))
    return tmp_path


def tables(folder) -> int:
    return len(glob.glob(f"{folder}/cut-*"))


def shuffles(spark) -> int:
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(len(glob.glob(os.path.join(d.toString(), "*", "shuffle_*"))) for d in local)


def fixes(spark):
    return spark.createDataFrame([(k, 7, 60.0 * k, 18.0 + (3.0 if k == 4 else 0.0) + k / 1000, 71.0) for k in range(9)],
                                 "ord long, mmsi long, t double, lat double, lon double")


def test_written_table_leaves_no_shuffle(spark, folder):
    before = shuffles(spark)
    out = session.cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert shuffles(spark) == before
    assert sorted(r["k"] for r in out.collect()) == list(range(7))


def test_setting_is_put_back(spark, folder):
    before = spark.conf.get(session.CLEANUP, None)
    session.cut_lineage(spark.range(1))
    assert spark.conf.get(session.CLEANUP, None) == before


def test_cleaning_leaves_its_result_alone(spark, folder):
    summary = spark.createDataFrame([(1, 0.0, 600.0, 17.0, 22.0, 70.0, 72.0)],
                                    "origin_id long, t0 double, t1 double, lat_min double, lat_max double, lon_min double, lon_max double")
    clean = jobs.near_and_clean(fixes(spark), summary, "ord")
    assert tables(folder) == 1
    assert sorted(r["ord"] for r in clean.collect()) == [0, 1, 2, 3, 5, 6, 7, 8]


def test_teleports_and_regions_leave_their_result_alone(spark, folder):
    assert [r["t"] for r in ais.teleports(fixes(spark), ["mmsi"]).collect()] == [240.0]
    assert tables(folder) == 1
    mask = spark.range(100).selectExpr("1L scene_id", "id div 10 row", "id % 10 col", "cast(id % 10 < 8 as int) cls")
    assert regions.find_regions(mask).count() == 100  # the gap is a small hole
    assert tables(folder) == 2


def test_kept_tables_outlive_the_call_around_them(spark, folder):
    own = []

    def make():
        with session.kept():
            own.append(session.cut_lineage(spark.range(3)))
        return session.cut_lineage(spark.range(5)).join(own[0], "id")

    assert session.written(make).count() == 3 and own[0].count() == 3
    assert tables(folder) == 2


def test_failed_step_deletes_its_tables(spark, folder):
    def make():
        session.cut_lineage(spark.range(3))
        raise ValueError

    with pytest.raises(ValueError):
        session.written(make)
    assert tables(folder) == 0 and session._scopes() == []
