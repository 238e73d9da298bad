"""Properties of the drift run."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from sheenwake.operators import drift


def slick(spark, ids=(1,), lo=2.0, hi=18.0, age=6.0):
    return spark.createDataFrame([(i, 1.7e9, age, lo, hi, 55.0) for i in ids],
                                 "slick_id long, t_detect double, age_h double, lo_h double, hi_h double, bearing double")


def line(spark, ids=(1,), spread=1.0):
    rows = [(i, k, 18.60 + .03 * spread * k / 59, 71.60 + .05 * spread * k / 59) for i in ids for k in range(60)]
    return spark.createDataFrame(rows, "slick_id long, vertex int, lat double, lon double")


def field(spark, ids=(1,), bg=0.4, eddy=0.0, wind=0.0, tide=0.0):
    return spark.createDataFrame([(i, bg, bg / 2, eddy, 45.0, 18.0, 1.0, tide, wind, .5, 1e-6) for i in ids],
                                 "slick_id long, " + ", ".join(f"{c} double" for c in drift.FIELD))


def cloud(spark, f, lo, hi, n=200, diffusion=0.0, spread=0.0):
    seeds = drift.seed_particles(drift.expand_ages(slick(spark, lo=lo, hi=hi), n), line(spark, spread=spread))
    return seeds, drift.backtrack(seeds, f, diffusion=diffusion).toPandas()


def test_back_then_forward_returns(spark):
    f = field(spark, bg=.5)
    _, back = cloud(spark, f, 5.9999, 6.0)
    again = spark.createDataFrame(back).withColumns({"t_detect": F.col("t"), "lat0": F.lit(18.6), "lon0": F.lit(71.6)})
    end = drift.forecast_frames(again, f, 6.0, 1, diffusion=0.0).where("frame = 1").toPandas()
    assert abs(end.lat.mean() - 18.6) < .05 and abs(end.lon.mean() - 71.6) < .05


def test_older_is_farther_and_diffusion_spreads(spark):
    f = field(spark)
    _, p = cloud(spark, f, 1.0, 12.0)
    d, age = np.hypot(p.lat - 18.6, p.lon - 71.6), 1.7e9 - p.t
    assert d[age > 10 * 3600].mean() > 2 * d[age < 3 * 3600].mean()
    _, tight = cloud(spark, f, 5.9999, 6.0)
    _, loose = cloud(spark, f, 5.9999, 6.0, diffusion=20.0)
    assert loose.lat.std() > tight.lat.std()


def test_wider_age_range_gives_a_wider_cloud(spark):
    f = field(spark, eddy=.15, wind=6.0, tide=.08)
    run = lambda lo, hi: drift.hindcast(slick(spark, lo=lo, hi=hi), line(spark), f, n_particles=400)["spread"].first().spread_km
    assert run(1.0, 24.0) > run(5.0, 7.0)


def test_hindcast_parts(spark):
    ids = (1, 2)
    h = drift.hindcast(slick(spark, ids), line(spark, ids), field(spark, ids, eddy=.15, wind=6.0), n_particles=300)
    assert h["spread"].agg(F.min("spread_km")).first()[0] > .5
    track = h["track"].orderBy("slick_id", "node").toPandas()
    for _, t in track.groupby("slick_id"):
        assert len(t) >= 3 and t.t.is_monotonic_increasing
    heat = h["heat"].join(h["bounds"], "slick_id").toPandas()
    assert heat.groupby("slick_id").v.max().to_numpy() == pytest.approx([1.0, 1.0])
    p, b = h["particles"].toPandas(), h["bounds"].toPandas().set_index("slick_id")
    for s, g in p.groupby("slick_id"):
        assert b.lat_min[s] <= g.lat.min() and g.lat.max() <= b.lat_max[s]
    w = h["window"].first()
    assert w.earliest < w.most_likely < w.latest <= 1.7e9
    r = drift.origin_report(h, slick(spark, ids)).collect()
    assert len(r) == 2 and r[0].slick_bearing_deg == 55.0 and len(r[0].heat_cells) > 10


def test_partitioning_cannot_change_a_particle(spark):
    f = field(spark, eddy=.15, wind=6.0)
    seeds, a = cloud(spark, f, 2.0, 12.0, diffusion=1.0)
    b = drift.backtrack(seeds.repartition(7, "particle_id"), f).toPandas()
    key = lambda d: d.sort_values("particle_id").reset_index(drop=True)
    assert np.allclose(key(a).lat, key(b).lat, atol=1e-12)


def test_linear_grid_is_interpolated_exactly(spark):
    rows = [(1, ti, 1.7e9 + 21600.0 * (ti - 2), y, x, 18.0 + y * .2, 71.0 + x * .2, .01 * y + .02 * x, .03 * y - .01 * x)
            for ti in range(4) for y in range(8) for x in range(8)]
    grid = spark.createDataFrame(rows, "slick_id long, ti int, t double, yi int, xi int, lat double, lon double, u double, v double")
    pts = spark.createDataFrame([(1, k, 1.7e9, 18.0 + .013 * k, 71.0 + .017 * k) for k in range(100)],
                                "slick_id long, id long, t double, lat double, lon double")
    got = drift.grid_current_lookup(pts, grid).toPandas()
    y, x = np.clip((got.lat - 18) / .2, 0, 7), np.clip((got.lon - 71) / .2, 0, 7)
    assert len(got) == 100 and np.allclose(got.u, .01 * y + .02 * x) and np.allclose(got.v, .03 * y - .01 * x)
    # A uniform grid moves particles as the same uniform field does.
    even = grid.withColumns({"u": F.lit(.4), "v": F.lit(.2)})
    seeds, want = cloud(spark, field(spark), 2.0, 12.0)
    got = drift.backtrack_grid(seeds, even, diffusion=0.0, chunk=64).toPandas().sort_values("particle_id")
    assert np.allclose(got.lat, want.sort_values("particle_id").lat, atol=1e-9)


def test_forcing_choice(spark):
    s = slick(spark, (1, 2, 3)).withColumns({"lat0": F.lit(18.6), "lon0": F.lit(71.6)})
    cov = spark.createDataFrame([(1, 17., 20., 70., 73., 1.6e9, 1.8e9), (2, 17., 20., 70., 73., 1.6e9, 1.65e9)],
                                "slick_id long, lat_min double, lat_max double, lon_min double, lon_max double, t_min double, t_max double")
    got = {r.slick_id: (r.forcing_source, r.realistic) for r in drift.choose_forcing(s, cov).collect()}
    assert got == {1: ("gridded", True), 2: ("analytic", False), 3: ("analytic", False)}
    # several grids for a slick: one row, and the best of them decides
    more = drift.choose_forcing(s, cov.union(cov).union(cov.withColumn("lat_min", F.lit(80.0)).withColumn("lat_max", F.lit(81.0))))
    assert sorted(tuple(r) for r in more.select("slick_id", "realistic", "fallback_reason").collect()) == sorted(
        tuple(r) for r in drift.choose_forcing(s, cov).select("slick_id", "realistic", "fallback_reason").collect())
    assert {r.forcing_source for r in drift.choose_forcing(s, cov, "analytic").collect()} == {"analytic"}
    with pytest.raises(Exception, match="no gridded currents"):
        drift.choose_forcing(s, cov, "gridded").collect()


def test_hindcast_carries_the_choice(spark):
    s, ids = slick(spark, (1, 2)), (1, 2)
    cov = spark.createDataFrame([(1, 17., 20., 70., 73., 1.6e9, 1.8e9), (2, 17., 20., 70., 73., 1.6e9, 1.65e9)],
                                "slick_id long, lat_min double, lat_max double, lon_min double, lon_max double, t_min double, t_max double")
    h = drift.hindcast(s, line(spark, ids), field(spark, ids), n_particles=20, coverage=cov)
    rep = drift.origin_report(h, s).collect()
    assert {(r.slick_id, r.forcing_source, r.realistic, r.fallback_reason) for r in rep} == {
        (i, "analytic", False, "no gridded currents for this slick") for i in ids}
