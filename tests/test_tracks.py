"""Clean-up, as-of lookup, features and ranking against plain loops."""
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sheenwake.functions.evidence import FEATURES
from sheenwake.operators import ais, asof, features, near, origins, quantile, suspects
from sheenwake.plans import jobs
from sheenwake.sources import readers, writers

R = 6371.0088
SCHEMA = ("ord long, mmsi long, t double, lat double, lon double, sog double, cog double, "
          "heading double, name string, vtype double, length double, width double, draft double")


def km(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * R * math.asin(math.sqrt(min(1, h)))


def fixes(spark, rows):
    """rows of (mmsi, t, lat, lon[, sog, cog, vtype, length])."""
    full = []
    for i, r in enumerate(rows):
        m, t, la, lo, *rest = r
        sog, cog, vt, ln = (list(rest) + [6.0, 45.0, 80.0, 200.0][len(rest):])
        full.append((i, m, float(t), float(la), float(lo), sog, cog, None, f"V{m}", vt, ln, 30.0, 8.0))
    return spark.createDataFrame(full, SCHEMA)


def cloud(spark, lat=18.6, lon=71.6, t=1.7e9, n=50, sigma=1.0, bearing=45.0):
    pts = spark.createDataFrame([(1, lat, lon, t)], "origin_id long, lat double, lon double, t double")
    return (origins.from_point_cloud(pts, n, sigma, 30.0),
            spark.createDataFrame([(1, bearing)], "origin_id long, bearing double"))


def loop_teleports(track, limit=60.0):
    keep, a = [], None
    for f in track:
        if a is None or km(a[1], a[2], f[1], f[2]) / 1.852 / ((f[0] - a[0]) / 3600) <= limit:
            keep.append(f[0])
            a = f
    return keep


@pytest.mark.parametrize("bucket_s", [600.0, 3600.0])
def test_teleport_filter_is_the_sequential_rule(spark, bucket_s):
    rng = np.random.default_rng(1)
    rows, want = [], set()
    for m in range(12):
        t, la, lo, track = 1.7e9, 18.0, 71.0, []
        bad_from = rng.integers(0, 80)
        for i in range(120):
            t += float(rng.integers(30, 400))
            la, lo = la + rng.normal(0, .002), lo + rng.normal(0, .002)
            jump = 2.0 if rng.random() < .15 or (m % 3 == 0 and bad_from <= i < bad_from + 15) else 0.0
            track.append((t, la + jump, lo))
        rows += [(m, *f) for f in track]
        want |= {(m, t) for t in loop_teleports(track)}
    got = ais.drop_teleports(fixes(spark, rows), ["mmsi"], bucket_s=bucket_s)
    assert {(r.mmsi, r.t) for r in got.select("mmsi", "t").collect()} == want


def test_a_run_of_bad_fixes_across_buckets_keeps_the_old_anchor(spark):
    good = [(1.7e9 + 300 * i, 18.0 + .001 * i, 71.0) for i in range(40)]
    track = [(t, la + 3.0 if 5 <= i < 30 else la, lo) for i, (t, la, lo) in enumerate(good)]
    got = ais.drop_teleports(fixes(spark, [(1, *f) for f in track]), ["mmsi"], bucket_s=900.0)
    assert sorted(r.t for r in got.collect()) == loop_teleports(track)


def test_teleports_when_every_other_fix_is_another_ship(spark):
    """Long chains of short runs, a first fix far off, and anchors that admit nothing for hours."""
    rng = np.random.default_rng(7)
    rows, want = [], set()
    for m, kind in enumerate(["two ships", "far start", "scattered", "one fix", "calm", "hops"]):
        n = 1 if kind == "one fix" else 90
        t, track = 1.7e9 + np.cumsum(rng.integers(20, 900, n)).astype(float), []
        for i in range(n):
            la, lo = 18 + .001 * i, 71.0
            if kind == "two ships" and i % 2 or kind == "far start" and i < 2:
                la += 4.0
            if kind == "scattered":
                la, lo = rng.uniform(-60, 60), rng.uniform(-180, 180)
            if kind == "hops":
                la += 1.5 * (i // 12 % 3)
            track.append((t[i], la, lo))
        rows += [(m, *f) for f in track]
        want |= {(m, x) for x in loop_teleports(track)}
    got = ais.drop_teleports(fixes(spark, rows), ["mmsi"], bucket_s=7200.0)
    assert {(r.mmsi, r.t) for r in got.select("mmsi", "t").collect()} == want
    assert ais.drop_teleports(fixes(spark, rows).limit(0), ["mmsi"]).count() == 0


def test_links_are_followed_in_log_rounds(spark, monkeypatch):
    """A chain of 200 runs is walked in 9 rounds of two small writes, whatever lies in between."""
    links = spark.createDataFrame([(1, float(i), float(i + 1), i + 1.5) for i in range(200)], "mmsi long, run double, to_run double, to_t double")
    start = spark.createDataFrame([(1, 0.0, 0.0)], "mmsi long, run double, entry double")
    writes = []
    cut = ais.cut_lineage
    monkeypatch.setattr(ais, "cut_lineage", lambda df: writes.append(1) or cut(df))
    got = ais._reached(start, links, ["mmsi"]).collect()
    assert sorted(r.run for r in got) == [float(i) for i in range(201)] and len(writes) <= 18
    assert all(r.entry == r.run + .5 for r in got if r.run)


def test_dedupe_hashes_and_sorts_only_what_repeats(spark):
    df = fixes(spark, [(1, 10, 1., 1.), (1, 10, 2., 2.), (1, 20, 3., 3.)])
    plan = ais.dedupe_fixes(df, ["mmsi"], "ord")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_dedupe_keeps_the_first_of_equal_times(spark):
    df = fixes(spark, [(1, 10, 1., 1.), (1, 10, 2., 2.), (1, 20, 3., 3.)])
    got = ais.dedupe_fixes(df, ["mmsi"], "ord").orderBy("t").collect()
    assert [(r.t, r.lat) for r in got] == [(10, 1.), (20, 3.)]


def test_asof_matches_interpolation(spark):
    rng = np.random.default_rng(2)
    t = np.unique(np.cumsum(rng.integers(20, 2500, 60))).astype(float) + 1e6
    lat = np.cumsum(rng.normal(0, .01, len(t))) + 18
    ts = rng.uniform(t[0] - 5000, t[-1] + 5000, 300)
    ts[:5], ts[5] = t[10:15], (t[20] + t[21]) / 2
    fx = fixes(spark, [(1, a, b, 71.0, float(i), float(i)) for i, (a, b) in enumerate(zip(t, lat))]
               + [(2, t[0], 10., 20.)])
    sm = spark.createDataFrame([(m, int(i), float(x)) for m in (1, 2) for i, x in enumerate(ts)],
                               "mmsi long, sample_id long, t double")
    got = asof.positions_at(fx, sm, ["mmsi"], bucket_s=1800.0).toPandas().sort_values("sample_id")
    a = got[got.mmsi == 1]
    assert np.allclose(a.at_lat, np.interp(ts, t, lat))
    assert (a.covered.to_numpy() == ((ts >= t[0]) & (ts <= t[-1]))).all()
    i = np.clip(np.searchsorted(t, ts), 0, len(t) - 1)
    p = np.clip(i - 1, 0, len(t) - 1)
    near = np.where(np.abs(ts - t[p]) < np.abs(t[i] - ts), p, i)
    assert (a.at_sog.to_numpy() == near).all()
    assert np.allclose(a.nearest_s, np.abs(ts[:, None] - t).min(1))
    gaps = [(x, y) for x, y in zip(t, t[1:]) if y - x > 900]
    assert (a.in_gap.to_numpy() == [any(x < s < y for x, y in gaps) for s in ts]).all()
    b = got[got.mmsi == 2]
    assert (b.covered.to_numpy() == (np.abs(ts - t[0]) < 3600)).all() and (b.at_lat == 10.).all()


def test_percentiles_by_digits_are_exact(spark):
    rng = np.random.default_rng(3)
    parts = {0: rng.normal(size=30001), 1: np.repeat(5.0, 500), 2: rng.integers(0, 9, 4000).astype(float),
             3: np.array([1.0, 2.0]), 4: np.r_[rng.random(9000), 1e12], 5: np.array([-3.0]),
             # sizes far apart, neighbours as close as doubles are, and a crowd within a crowd
             6: np.r_[-np.geomspace(1e-300, 1e300, 999), 0.0, -0.0, np.geomspace(5e-324, 1e308, 999)],
             7: 1.0 + np.arange(40) * 2.0**-52, 8: np.r_[1.7e9 + 1e-3 * rng.random(3000), 1.7e9 + rng.random(3000), 1.75e9]}
    pdf = pd.concat([pd.DataFrame({"k": k, "v": v}) for k, v in parts.items()])
    probs = {"a": .02, "m": .5, "z": .98}
    got = quantile.exact_percentiles(spark.createDataFrame(pdf), ["k"], "v", probs).toPandas()
    for k, v in parts.items():
        row = got[got.k == k].iloc[0]
        assert np.allclose([row.a, row.m, row.z], np.percentile(v, [2, 50, 98]), rtol=1e-15, atol=1e-12), k


def test_percentiles_of_groups_without_values(spark):
    rows = [(1, None), (1, float("nan")), (2, 4.0), (2, None), (2, float("inf")), (2, float("-inf"))]
    got = quantile.exact_percentiles(spark.createDataFrame(rows, "k long, v double"), ["k"], "v", {"lo": 0.0, "m": .5, "hi": 1.0})
    assert [tuple(r) for r in got.collect()] == [(2, float("-inf"), 4.0, float("inf"))]
    none = spark.createDataFrame([], "k long, v double")
    assert quantile.exact_percentiles(none, ["k"], "v", {"m": .5}).count() == 0


def test_distant_traffic_is_no_candidate(spark):
    samples, _ = cloud(spark)
    s = origins.origin_summary(samples)
    far = fixes(spark, [(m, 1.7e9 + 60 * i, 0.0 + .001 * i, 0.0) for m in range(8) for i in range(20)])
    near = origins.ais_near_origin(far, s)
    assert origins.candidate_vessels(near, s).count() == 0


def path_rows(mmsi, n=8, dlat=0.0, dlon=0.0):
    return [(mmsi, 1.7e9 + 3600 * i / (n - 1), 18.6 + .01 * i + dlat, 71.6 + .01 * i + dlon) for i in range(n)]


def test_track_match_rewards_following_the_path(spark):
    samples, _ = cloud(spark)
    summary = origins.origin_summary(samples).withColumn("spread_km", F.lit(10 / .6))
    track = spark.createDataFrame([(1, i, a, o, t) for i, (_, t, a, o) in enumerate(path_rows(1))],
                                  "origin_id long, node int, lat double, lon double, t double")
    fx = fixes(spark, path_rows(1) + path_rows(2, dlat=1.3, dlon=1.3)).withColumn("origin_id", F.lit(1).cast("long"))
    cand = fx.groupBy("origin_id", "mmsi").agg(F.count("*").alias("n_fixes"))
    m = {r.mmsi: r.track_match for r in features.track_match(fx, cand, track, summary).collect()}
    assert m[1] > .8 and m[2] < .05
    none = features.track_match(fx, cand, track.limit(0), summary).collect()
    assert [r.track_match for r in none] == [0.0, 0.0]


@pytest.fixture(scope="module")
def ranked(spark):
    rng = np.random.default_rng(5)
    rows = []
    for m in range(1, 31):
        la, lo = 18.6 + rng.normal(0, .25), 71.6 + rng.normal(0, .25)
        vt = [80.0, 70.0, 30.0, None][m % 4]
        for i in range(60):
            if m == 3 and 20 <= i <= 35:
                continue
            sog = None if m == 4 and i == 30 else float(abs(rng.normal(8, 3)))
            rows.append((m, 1.7e9 - 7200 + 240 * i, la + .004 * (i - 30), lo + .003 * (i - 30), sog,
                         float(rng.uniform(0, 360)), vt, None if m % 5 == 0 else 50.0 + m))
    samples, origin = cloud(spark, n=80, sigma=3.0)
    return jobs.attribute(fixes(spark, rows), samples, origin, order="ord", canonical=True), rows, samples


def test_ranking_properties(ranked):
    out, _, _ = ranked
    s = out["suspects"].orderBy("rank").toPandas()
    assert len(s) > 5 and s[FEATURES].notna().all().all()
    assert s.attribution_pct.sum() == pytest.approx(100.0) and s.score.is_monotonic_decreasing
    assert list(s["rank"]) == list(range(1, len(s) + 1))
    assert all(len(e) > 0 for e in s.evidence) and s.learned_rank.isna().all()
    assert (s.track_match == 0).all()


def test_features_against_a_loop(ranked):
    out, rows, samples = ranked
    got = out["features"].toPandas().set_index("mmsi")
    sm = samples.toPandas()
    cla, clo, t0, t1 = sm.lat.mean(), sm.lon.mean(), sm.t.min(), sm.t.max()
    for m in got.index:
        f = pd.DataFrame([r[1:6] for r in rows if r[0] == m], columns=["t", "lat", "lon", "sog", "cog"]).sort_values("t")
        f = f[f.t.between(t0 - 43200, t1 + 7200)]
        la, lo = np.interp(sm.t, f.t, f.lat), np.interp(sm.t, f.t, f.lon)
        cov = sm.t.between(f.t.min(), f.t.max()).to_numpy()
        d = np.array([km(a, b, c, e) for a, b, c, e in zip(la, lo, sm.lat, sm.lon)])
        g = got.loc[m]
        assert g.min_dist_km == pytest.approx(d[cov].min())
        assert g.mean_dist_km == pytest.approx(np.minimum(d[cov], 200).mean())
        assert g.prox_score == pytest.approx(np.where(cov, np.exp(-d / 5), 0).mean())
        w = f[f.t.between(t0 - 10800, t1 + 10800)]
        assert g.dwell_frac == pytest.approx(np.mean([km(a, b, cla, clo) <= 25 for a, b in zip(w.lat, w.lon)]))
        gaps = [(a, b) for a, b in zip(f.t, f.t[1:]) if b - a > 900]
        assert g.dark_frac == pytest.approx(min(1, sum(max(0, min(b, t1) - max(a, t0)) for a, b in gaps) / (t1 - t0)))
        slow = w[w.sog < 5]
        x = np.radians(slow.cog)
        var = 1 - math.hypot(np.cos(x).mean(), np.sin(x).mean()) if len(x) else 0
        want = 0 if w.sog.isna().any() else var * (w.sog < 5).mean()
        assert g.loiter_score == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("every_s", [10.0, 45.0, 1200.0])
def test_samples_meet_each_vessel_once(spark, every_s):
    """However often vessels report: as many pairs as samples times candidates, each with a few steps."""
    n = int(14400 / every_s)
    rows = [(m, 1.7e9 - 7200 + every_s * i, 18.6 + 1e-5 * i, 71.6 + .01 * m) for m in range(5) for i in range(n)]
    fx = fixes(spark, rows).withColumn("origin_id", F.lit(1).cast("long"))
    t = np.random.default_rng(3).uniform(1.7e9 - 1800, 1.7e9 + 1800, 300)
    samples = spark.createDataFrame([(1, i, 18.6, 71.6, float(x)) for i, x in enumerate(t)],
                                    "origin_id long, sample_id long, lat double, lon double, t double")
    steps = features.segments(fx, origins.origin_summary(samples).select(*features.SPAN))
    pairs = features.sample_steps(steps, samples, crowd=7)
    assert pairs.count() == 300 * 5
    assert pairs.agg(F.max(F.size("steps"))).first()[0] <= 6
    got = features.sample_positions(steps, samples)
    assert got.count() == 300 * 5 and got.where("d is null").count() == 0


def test_a_busy_cell_is_split_and_a_quiet_one_is_not(spark):
    rows = [(m, 1.7e9 + i, 18.55 + 1e-6 * i, 71.55) for m in range(4) for i in range(500)] + [(9, 1.7e9 + i, 19.2, 71.5) for i in range(50)]
    samples, _ = cloud(spark)
    s = origins.origin_summary(samples)
    plain = origins.ais_near_origin(fixes(spark, rows), s)
    split = origins.ais_near_origin(fixes(spark, rows), s, crowd=100)
    key = lambda df: sorted((r.mmsi, r.t) for r in df.select("mmsi", "t").collect())
    assert key(plain) == key(split) and len(key(split)) == 2050


def test_perpendicular_scores_below_aligned(spark):
    row = {n: 0.0 for n in FEATURES} | dict(min_dist_km=1.0, mean_dist_km=1.0, prox_score=.8, time_gap_min=1.0)
    both = [(1, m, "x", 80.0, 200.0, 100, *[dict(row, course_align=c)[n] for n in FEATURES]) for m, c in ((1, 1.0), (2, 0.0))]
    f = spark.createDataFrame(both, "origin_id long, mmsi long, name string, vtype double, length double, n_fixes long, "
                              + ", ".join(f"{n} double" for n in FEATURES))
    s = {r.mmsi: r.score for r in suspects.score_baseline(f).collect()}
    assert s[1] > s[2]
    with pytest.raises(ValueError):
        suspects.get_scorer("learned")


def test_one_hot_vessel_and_origin(spark):
    """A third of all reports from one vessel and most samples in one origin."""
    rows = [(1, 1.7e9 + 2 * i, 18.6 + 1e-5 * i, 71.6) for i in range(3000)]
    rows += [(m, 1.7e9 + 60 * i, 18.6, 71.6 + .01 * m) for m in range(2, 62) for i in range(100)]
    samples, origin = cloud(spark, n=3000, sigma=1.0)
    out = jobs.attribute(fixes(spark, rows), samples, origin, order="ord", canonical=True)
    n = {r.mmsi: r.n_fixes for r in out["features"].collect()}
    assert n[1] == 3000 and n[2] == 100


def test_readers_and_archive(spark, tmp_path):
    csv = tmp_path / "ais.csv"
    csv.write_text("MMSI,BaseDateTime,LAT,LON,SOG,COG,Heading,VesselName,VesselType,Length,Width,Draft\n"
                   "1,2021-05-14T12:00:00,18.6,71.6,102.3,361,511,A,80,200,30,8\n"
                   "1,bad,18.6,71.6,5,10,10,A,80,200,30,8\n"
                   "2,2021-05-15T12:00:00,95,71.6,5,10,10,B,80,,30,8\n"
                   "3,2021-05-15 12:00:00,18.7,71.7,5,10,10,C,70,x,30,8\n")
    df = readers.read_ais(str(csv), spark=spark)
    got = df.orderBy("mmsi").collect()
    assert [r.mmsi for r in got] == [1, 3] and got[0].t == 1620993600.0
    assert (got[0].sog, got[0].cog, got[0].heading, got[1].length) == (None, None, None, None)
    path = str(tmp_path / "archive")
    writers.write_ais_archive(df, path)
    back = readers.read_ais(path, (18.0, 19.0, 71.0, 72.0), (1620993600.0, 1620993600.0 + 3600), spark)
    assert [r.mmsi for r in back.collect()] == [1]
    plan = back._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "GreaterThanOrEqual(lat" in plan
    with pytest.raises(ValueError):
        ais.normalise_ais(df.drop("lat"))


def test_archive_opens_only_what_boxes_touch(spark, tmp_path):
    """Files of other days and tiles are broken after the archive is written, and never opened."""
    import glob

    from sheenwake.sources.writers import curve_place, tile_of

    t = 1620993600.0
    places = [(18.6, 71.6), (-90.0, -180.0), (90.0, 180.0), (19.99, 79.99), (20.0, 71.6), (5.0, -120.0)]
    rows = [(m, t + 86400.0 * d + m, la, lo) for d in range(-2, 3) for m, (la, lo) in enumerate(places)]
    path = str(tmp_path / "archive")
    writers.write_ais_archive(fixes(spark, rows), path)
    s = origins.origin_summary(cloud(spark, t=t)[0])
    back = readers.read_archive_near(path, origins.loading_boxes(s), spark)
    files = glob.glob(f"{path}/day=*/tile=*/*.parquet")
    home = spark.range(1).select(tile_of(F.lit(18.6), F.lit(71.6))).first()[0]
    far = [f for f in files if not (f"tile={home}/" in f and ("day=2021-05-14" in f or "day=2021-05-13" in f))]
    assert 0 < len(far) < len(files)
    for f in far:
        with open(f, "wb") as out:
            out.write(b"broken")
    got = {(r.mmsi, r.t) for r in back.collect()}
    assert got == {(m, t + 86400.0 * d + m) for d in (-1, 0) for m in (0, 3)}
    corners = spark.createDataFrame(places, "lat double, lon double").select(tile_of(F.col("lat"), F.col("lon")), curve_place(F.col("lat"), F.col("lon"))).collect()
    assert corners[1][0] == 0 and corners[2][0] == 18 * 36 - 1 and len({r[1] for r in corners}) == len(places)


def test_numbers_as_text(spark):
    from sheenwake.operators.ais import parse_time

    df = spark.createDataFrame([("1704067200",), ("1704067200000",), ("2024-01-01T00:00:00Z",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(parse_time(df, "t")).collect()] == [1704067200.0] * 3 + [None] * 2


def test_archive_keeps_other_days(spark, tmp_path):
    from sheenwake.sources import writers

    path = str(tmp_path / "ais")
    for day in (0, 1, 1):
        df = spark.createDataFrame([(1, 86400.0 * day + 5, 1.0, 2.0)], "mmsi long, t double, lat double, lon double")
        writers.write_ais_archive(df, path)
    assert spark.read.parquet(path).count() == 2


def test_counts_of_an_origin_without_reports(spark):
    from sheenwake.operators.metrics import run_counts

    fixes = spark.createDataFrame([(1, 5)], "origin_id long, mmsi long")
    got = run_counts(fixes, fixes, spark.createDataFrame([(1,), (2,)], "origin_id long")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1), (2, 0, 0)]


def test_grid_with_an_absent_point(spark):
    from sheenwake.operators.drift import grid_current_lookup

    full = [(1, 0.0, 0, y, x, float(y), float(x), 0.1 * (y + 5), 0.01 * x) for y in range(5, 8) for x in range(3)]
    rows = [(s, t, ti, y, x, la, lo, u, v) for s, t, ti, y, x, la, lo, u, v in full if (y, x) != (6, 1)]
    cols = "slick_id long, t double, ti int, yi int, xi int, lat double, lon double, u double, v double"
    points = spark.createDataFrame([(1, 0.0, 5.5, 0.5), (1, 0.0, 7.0, 2.0)], "slick_id long, t double, lat double, lon double")
    got = [r["u"] for r in grid_current_lookup(points, spark.createDataFrame(rows, cols)).orderBy("lat").collect()]
    assert abs(got[0] - (1.0 + 1.0 + 1.1 + 0.0) / 4) < 1e-9 and abs(got[1] - 1.2) < 1e-9


def _product(spark, every_s=45.0):
    rows = [(m, 1.7e9 - 7200 + every_s * i + 11 * m, 18.6 + 1e-4 * i, 71.6 + .01 * m) for m in range(5) for i in range(int(14400 / every_s))]
    rows += [(7, 1.7e9 - 900.0, 18.61, 71.62), (7, 1.7e9 + 900.5, 18.62, 71.61), (8, 1.7e9, 18.6, 71.6)]
    fx = fixes(spark, rows).withColumns({"origin_id": F.lit(1).cast("long"), "sog": F.expr("if(ord % 5 = 0, null, cast(ord % 7 as double))"),
                                         "cog": F.expr("if(ord % 3 = 0, null, cast(ord % 360 as double))")})
    t = np.random.default_rng(5).uniform(1.7e9 - 1800, 1.7e9 + 1800, 200).tolist() + [1.7e9] * 100
    samples = [(1, None if i % 50 == 9 else i // 2, None if i % 40 == 3 else 18.6 + .001 * (i % 9), 71.6, float(x)) for i, x in enumerate(t)]
    samples = spark.createDataFrame(samples + [(1, 999, 18.6, 71.6, None)], "origin_id long, sample_id long, lat double, lon double, t double")
    return features.segments(fx, origins.origin_summary(samples).select(*features.SPAN)), samples


def test_blocks_add_up_to_the_product_row_by_row(spark, capsys):
    steps, samples = _product(spark)
    at = features.sample_positions(steps, samples)
    over = F.when(asof.inside_gap(900.0) & (F.col("d") <= 2.0), 1).otherwise(0)
    near = features.nearness()
    want = at.groupBy("mmsi").agg(
        F.count("*").alias("n"), F.sum(F.coalesce(F.exp(-F.col("d") / 5), F.lit(0.0))).alias("prox"), F.min("d").alias("d_min"),
        F.count("d").alias("n_d"), F.sum(F.expr("if(d is null, 0, least(d, 200D))")).alias("d_sum"), F.min(asof.nearest_dt()).alias("dt_min"),
        F.sum(over).alias("n_over"), F.min_by("sample_id", near).alias("sample_id"),
        F.min_by(asof.nearest_value("cog"), near).alias("cog"), F.min_by(asof.nearest_value("sog"), near).alias("sog")).toPandas().set_index("mmsi")
    assert len(want) == 7 and (want.n == 300).all() and want.n_over.sum() > 0
    for crowd, crowd_steps in ((4096, 1 << 16), (7, 20)):
        sums = features.sample_sums(steps, samples, 2.0, crowd, crowd_steps)
        sums.explain()
        text = capsys.readouterr().out
        assert "MapInArrow" in text and "ASIN" not in text  # the product is no rows of the plan
        got = sums.groupBy("mmsi").agg(
            *[F.sum(c).alias(c) for c in ("n", "prox", "n_d", "d_sum", "n_over")], F.min("d_min").alias("d_min"), F.min("dt_min").alias("dt_min"),
            *[F.min_by(c, near).alias(c) for c in ("sample_id", "cog", "sog")]).toPandas().set_index("mmsi").loc[want.index]
        for c in want.columns:
            assert np.allclose(got[c].astype(float), want[c].astype(float), rtol=1e-12, equal_nan=True), c


def test_no_block_grows_with_the_input(spark):
    steps, samples = _product(spark, 10.0)
    whole = features.sample_blocks(steps, samples)
    assert whole.select(*features.BLOCK).distinct().count() == 1
    split = features.sample_blocks(steps, samples, 20, 50).groupBy(*features.BLOCK).agg(
        F.count("t").alias("samples"), F.count("mmsi").alias("steps")).toPandas()
    # a hundred samples of one moment are split as well
    assert split.samples.max() < 60 and split.steps.max() < 150
    met = features.sample_sums(steps, samples, crowd=20, crowd_steps=50).groupBy("mmsi").agg(F.sum("n").alias("n")).collect()
    assert {r.mmsi: r.n for r in met} == {m: 300 for m in (0, 1, 2, 3, 4, 7, 8)}


def _crowded_sea(spark):
    """Origins next to each other, vessels that jump, report twice at a time and cross the boxes, and one without a number."""
    rng, rows = np.random.default_rng(11), []
    for m in range(6):
        t = 1.7e9 - 40000 + np.sort(rng.integers(0, 800, 250)) * 90.0
        lat, lon = 18.2 + .1 * m + 1e-5 * (t - t[0]) + .3 * (rng.random(250) < .08), 71.2 + 1e-5 * (t - t[0]) - .6 * (rng.random(250) < .04)
        rows += [(m, float(a), float(b), float(c)) for a, b, c in zip(t, lat, lon)]
    rows += [(7, 1.7e9 - 3000 + 60.0 * (i // 2), 18.5 + .5 * (i % 2), 71.5) for i in range(40)]
    rows += [(8, 1.7e9, 25.0, 71.5), (8, 1.7e9 + 60, 18.5, 71.5), (8, 1.7e9 + 90, 18.501, 71.5)]
    # the first report jumps, so all others are dropped until it could have come so far
    rows += [(9, 1.7e9 - 9000.0, 19.3, 71.5)] + [(9, 1.7e9 - 8990 + 60.0 * i, 18.4, 71.5) for i in range(90)]
    fx = fixes(spark, rows).withColumn("mmsi", F.expr("if(mmsi = 7 and ord % 4 = 1, null, mmsi)"))
    fx = fx.withColumn("ord", F.expr("if(mmsi = 1 and ord % 2 = 0, ord - 1, if(mmsi = 2 and ord % 5 = 0, null, ord))"))
    where = [(o, 18.3 + .05 * o, 71.3 + .04 * o, 1.7e9 + 1800.0 * (o % 3)) for o in range(30)]
    cloud_ = spark.createDataFrame([(o, i, la + .01 * i, lo, t + 60.0 * i) for o, la, lo, t in where for i in range(5)],
                                   "origin_id long, sample_id long, lat double, lon double, t double")
    return fx, origins.origin_summary(cloud_, pad_km=30.0)


def test_groups_of_origins_clean_as_buckets_of_time_do(spark, monkeypatch):
    fx, summary = _crowded_sea(spark)
    sent = []
    monkeypatch.setattr(near, "ais_near_origin", lambda *a, **k: sent.append(origins.ais_near_origin(*a, **k).count()) or origins.ais_near_origin(*a, **k))
    rows = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    by_group = rows(jobs.near_and_clean(fx, summary, "ord"))
    # a report is sent to a handful of groups, not to each origin it is near
    raw = origins.ais_near_origin(fx, summary).count()
    assert sent[0] < raw / 4 and len(by_group) < raw
    by_bucket = rows(jobs.near_and_clean(fx, summary, "ord", long_track=0))
    assert len(sent) == 2 and len(by_bucket) > 2000
    assert by_group == by_bucket
    some = rows(jobs.near_and_clean(fx, summary, "ord", long_track=80))
    assert some == by_group
    monkeypatch.setattr(near, "GROUP_ORIGINS", 3)
    monkeypatch.setattr(near, "FIXES_OUT", 5)
    marked = fx.where("mmsi = 0").dropDuplicates(["t"]).withColumn("rank_", F.lit(1))
    split, whole = near.clean_near(marked, summary, 12.0, block_fixes=50), near.clean_near(marked, summary, 12.0)
    assert rows(split) == rows(whole)


def test_statics_are_hashed_and_not_sorted(spark, capsys):
    rows = [(m, 1.7e9 + 60 * i, 0.0, 0.0) for m in range(3) for i in range(8)]
    fx = fixes(spark, rows).withColumns({"name": F.expr("case when mmsi = 2 then 'nan' when ord % 8 < 2 then '' when ord % 8 < 4 then 'A' else 'B' end"),
                                         "length": F.expr("if(ord % 8 < 5, null, ord + 0D)")})
    x = ais.vessel_statics(fx, ["mmsi"])
    x.explain()
    first = capsys.readouterr().out.split("Scan")[0].split("HashAggregate")[-1]
    assert "SortAggregate" not in first  # sorted, if at all, is a row a name
    assert {r.mmsi: (r.name, r.length) for r in x.collect()} == {m: ("" if m == 2 else "A", 8.0 * m + 5) for m in range(3)}
