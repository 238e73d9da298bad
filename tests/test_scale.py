"""Tables whose files are far smaller than their rows: made by many tasks and never broadcast."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sheenwake.operators import ais, asof, components, drift, features, metrics, origins, raster, regions
from sheenwake.plans import catalog
from sheenwake.session import by_shuffle, cut_lineage
from sheenwake.sources import demo


def pixels(spark, **columns):
    """A written scene of 40 x 40 pixels: a file of a few kilobytes, which Spark would broadcast."""
    x = spark.range(1600).select(F.lit(1).cast("long").alias("scene_id"), F.floor(F.col("id") / 40).alias("row"),
                                 (F.col("id") % 40).alias("col"))
    return cut_lineage(x.select("*", *[F.expr(e).alias(n) for n, e in columns.items()]))


def plan(df, capsys):
    df.explain()
    return capsys.readouterr().out


@pytest.mark.parametrize("name", ["mask", "pixel", "prob", "current_grid"])
def test_rows_of_a_small_file_are_made_by_many_tasks(spark, tmp_path, name):
    n = 40
    pd.DataFrame({"s_suppkey": np.arange(n)}).to_parquet(tmp_path / "supplier.parquet")
    x = demo.table(spark, str(tmp_path), name)
    assert x.rdd.getNumPartitions() == 8
    key = "slick_id" if name == "current_grid" else "scene_id"
    assert x.select(key).distinct().count() == n


def test_pixels_are_not_broadcast(spark, capsys):
    mask, pred = pixels(spark, cls="cast(row % 2 as int)"), pixels(spark, cls="cast(col % 2 as int)")
    value, prob = pixels(spark, value="row / 40"), pixels(spark, cls="1", p="col / 40")
    label = pixels(spark, label="cast(row % 3 as long)")
    cm = metrics.confusion_matrix(mask, pred)
    assert "Broadcast" not in plan(cm, capsys)
    assert {tuple(r) for r in cm.collect()} == {(a, b, 400) for a in (0, 1) for b in (0, 1)}
    # what is counted per region may be broadcast, pixels may not
    assert plan(metrics.pixel_overlap(label, label), capsys).count("BroadcastHashJoin") == 2
    assert "Broadcast" not in plan(regions.region_confidence(label, prob), capsys)
    assert "Broadcast" not in plan(regions.region_contrast(label, value, mask), capsys).split("SortMergeJoin")[-1]


def test_grid_cells_are_not_broadcast(spark, capsys):
    g = cut_lineage(spark.range(8).selectExpr("1L slick_id", "0L ti", "0D t", "id div 4 yi", "id % 4 xi", "id div 4 + 0D lat",
                                              "id % 4 + 0D lon", "id + 0D u", "1D v"))
    p = spark.createDataFrame([(1, 0.0, 0.0, 1.5)], "slick_id long, t double, lat double, lon double")
    x = drift.grid_current_lookup(p, g)
    assert "Broadcast" not in plan(x, capsys)
    assert [(r.u, r.v) for r in x.collect()] == [(1.5, 1.0)]


def test_tiles_and_shapes_keep_their_tasks(spark, capsys):
    mask = pixels(spark, cls="1")
    shapes = regions.region_shapes(components.label_regions(mask, 20), spark.createDataFrame(
        [(1, 40, 40)], "scene_id long, height int, width int"))
    assert "REPARTITION_BY_NUM" in plan(shapes, capsys)
    assert [r.hull_px for r in shapes.collect()] == [1600]


def near(spark):
    """Twenty reports of a vessel around one origin, and the origin's summary."""
    f = spark.range(20).selectExpr("id ord", "7L mmsi", "1000D + 60 * id t", "18D + id / 1000 lat", "71D + id / 1000 lon",
                                   "5D sog", "90D cog")
    s = spark.createDataFrame([(1, 18.0, 71.0, 900.0, 2400.0, 1.0, 17.0, 19.0, 70.0, 72.0)],
                              "origin_id long, lat_c double, lon_c double, t0 double, t1 double, spread_km double, "
                              "lat_min double, lat_max double, lon_min double, lon_max double")
    return cut_lineage(f), cut_lineage(s)


def test_boxes_are_not_broadcast_and_fixes_are_spread(spark, capsys):
    fixes, summary = near(spark)
    x = origins.ais_near_origin(fixes, summary)
    text = plan(x, capsys)
    assert text.count("BroadcastHashJoin") == 2 and "REPARTITION_BY_NUM" in text  # busy cells on either side
    assert x.count() == 20


def test_positions_are_rounded_before_they_are_repeated(spark, capsys):
    fixes, summary = near(spark)
    x = catalog._near(fixes, summary)
    assert "round(" not in plan(x, capsys).split("SortMergeJoin")[0]
    assert {(r.lat, r.lon) for r in x.collect()} == {(round(18 + i / 1000, 6), round(71 + i / 1000, 6)) for i in range(20)}


def test_neighbours_are_shuffled_without_a_struct(spark, capsys):
    fixes, _ = near(spark)
    x = asof.with_neighbours(fixes.select("mmsi", "t", "lat"), ["mmsi"], ["t", "lat"], 300.0)
    assert "lag(lat" in plan(x, capsys)
    got = {r.t: r.prev for r in x.collect()}
    assert got[1000.0] is None and all(got[t].t == t - 60 for t in got if t > 1000)


def test_tracks_without_a_break_are_not_shuffled_to_meet_the_broken(spark, monkeypatch):
    fixes, _ = near(spark)
    written = []
    monkeypatch.setattr(ais, "cut_lineage", lambda df: written.append(df.columns) or cut_lineage(df))
    jump = fixes.withColumn("lat", F.expr("if(ord = 9, lat + 3, lat)"))
    assert [r.t for r in ais.teleports(jump, ["mmsi"]).collect()] == [1540.0]
    assert ["mmsi"] in written


def test_nearest_sample_without_a_filter_on_the_product(spark, capsys):
    fixes, summary = near(spark)
    fixes = cut_lineage(fixes.withColumn("origin_id", F.lit(1).cast("long")))
    cand = cut_lineage(fixes.select("origin_id", "mmsi").distinct())
    samples = cut_lineage(spark.createDataFrame([(1, 5, 18.0, 71.0, 1000.0), (1, 6, 18.5, 71.0, 1030.0), (1, 7, 18.0, 71.0, 2300.0)],
                                                "origin_id long, sample_id long, lat double, lon double, t double"))
    x = features.closest_approach(fixes, cand, samples, summary)
    text = plan(x, capsys)
    assert not any("Filter" in row and "ASIN" in row for row in text.splitlines())
    assert [(r.sample_id, r.dist_km) for r in x.collect()] == [(5, 0.0)]
    # no sample within the track: the vessel is left out
    assert features.closest_approach(fixes, cand, samples.where("sample_id = 7"), summary).count() == 0


def test_particles_are_made_by_many_tasks_and_not_broadcast(spark, capsys):
    slicks = cut_lineage(spark.range(3).selectExpr("id slick_id", "18D lat0", "71D lon0", "1000D t_detect", "3D age_h",
                                                   "cast(null as double) lo_h", "cast(null as double) hi_h"))
    outline = cut_lineage(spark.range(12).selectExpr("id % 3 slick_id", "id vertex", "18D + id / 100 lat", "71D + id / 100 lon"))
    x = drift.seed_particles(drift.expand_ages(slicks, 50), outline)
    text = plan(x, capsys)
    assert "Broadcast" not in text and "REPARTITION_BY_NUM" in text
    assert x.count() == 150 and x.select("slick_id", "particle_id").distinct().count() == 150


def test_resizing_joins_pixels_with_scenes_only(spark, tmp_path, capsys):
    value, cls = pixels(spark, value="(row * 7 + col * 3) % 11 / 10"), pixels(spark, cls="cast((row + col) % 5 as int)")
    scene = spark.createDataFrame([(1, 40, 40)], "scene_id long, height int, width int")
    for size in (16, 40, 100):
        small, labels = raster.resize_scene(value, scene, size), raster.resize_scene(cls, scene, size, labels=True)
        # cells are made of pixels, and never on the side that is sent to all
        for x in (small, labels):
            text = plan(x, capsys)
            assert "Generate" in text and "Generate" not in text.split("BroadcastExchange")[-1]
        at = np.clip((np.arange(size) + 0.5) * 40 / size - 0.5, 0, 39)
        i, f = np.floor(at).astype(int), at - np.floor(at)
        j, near = np.minimum(i + 1, 39), np.minimum(np.arange(size) * 40 // size, 39)
        g = np.fromfunction(lambda r, c: (r * 7 + c * 3) % 11 / 10, (40, 40))
        rows = g[i] * (1 - f)[:, None] + g[j] * f[:, None]
        want = rows[:, i] * (1 - f) + rows[:, j] * f
        got = small.toPandas()
        assert len(got) == size * size
        assert np.allclose(got["value"], want[got["row"], got["col"]], atol=1e-12)
        got = labels.toPandas()
        assert len(got) == size * size
        assert (got["cls"] == (near[got["row"]] + near[got["col"]]) % 5).all()
    pd.DataFrame({"s_suppkey": np.arange(4)}).to_parquet(tmp_path / "supplier.parquet")
    assert "SortMergeJoin" in plan(catalog.queries()["sc27_resize_scene"](spark, str(tmp_path)), capsys)


def test_particles_are_not_sent_to_meet_their_field(spark, capsys):
    slicks = cut_lineage(spark.range(40).selectExpr("id slick_id", "0D t_detect", "2D age_h", "1D lo_h", "3D hi_h"))
    foot = slicks.selectExpr("slick_id", "0L vertex", "18D lat", "71D lon")
    # a field of unknown size, as a join leaves it, and one slick without any
    field = slicks.where("slick_id > 0").selectExpr("slick_id", *[f"0.1D {c}" for c in drift.FIELD]).join(by_shuffle(slicks.select("slick_id")), "slick_id")
    seeds = drift.seed_particles(drift.expand_ages(slicks, 50), foot)
    for x, rows in ((drift.backtrack(seeds, field), 39 * 50), (drift.forecast_frames(seeds, field, n_frames=1), 39 * 100)):
        text = plan(x, capsys)
        assert "BuildLeft" not in text and "LeftOuter" in text
        assert x.count() == rows and x.where("slick_id = 0").count() == 0


def test_points_become_clouds_in_many_tasks(spark):
    points = cut_lineage(spark.range(40).selectExpr("id origin_id", "18D lat", "71D lon", "0D t").coalesce(1))
    cloud = origins.from_point_cloud(points, 5)
    assert cloud.rdd.getNumPartitions() == 8
    assert cloud.groupBy("origin_id").count().where("count = 5").count() == 40
