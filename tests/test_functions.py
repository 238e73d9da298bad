"""Column functions on literal cases."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheenwake.functions import draws, geo, slicks, titles, vessels
from sheenwake.operators import raster


def one(spark, **cols):
    return spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).first()


L = F.lit


def test_local_km_round_trip(spark):
    e, n = geo.local_km(18.8, 71.9, 18.6, 71.6)
    la, lo = geo.from_local_km(e, n, 18.6, 71.6)
    r = one(spark, la=la, lo=lo)
    assert r.la == pytest.approx(18.8, abs=1e-9) and r.lo == pytest.approx(71.9, abs=1e-9)


def test_haversine_bearing_and_destination_agree(spark):
    la, lo = geo.destination(18.6, 71.6, 70.0, 25.0)
    r = one(spark, km=geo.haversine_km(18.6, 71.6, la, lo), b=geo.bearing_deg(18.6, 71.6, la, lo))
    assert r.km == pytest.approx(25.0, abs=1e-6) and r.b == pytest.approx(70.0, abs=1e-6)


def test_axis_alignment_is_undirected(spark):
    r = one(spark, a=geo.axis_alignment(70.0, 250.0), b=geo.axis_alignment(70.0, 160.0))
    assert r.a == pytest.approx(1.0) and r.b == pytest.approx(0.0, abs=1e-12)


@pytest.mark.parametrize("rad,az", [(0, 0), (math.pi / 2, 90), (-math.pi / 4, 45), (math.pi / 4, 135)])
def test_orientation_to_azimuth(spark, rad, az):
    assert one(spark, a=slicks.orientation_to_azimuth(float(rad))).a == pytest.approx(az)


def test_pixel_to_lonlat(spark):
    t = [L(v) for v in (73.0, .001, 0.0, 19.0, 0.0, -.001)]
    lon, lat = slicks.pixel_to_lonlat(10.0, 20.0, t)
    r = one(spark, lon=lon, lat=lat)
    assert r.lon == pytest.approx(73.02) and r.lat == pytest.approx(18.99)


def test_age_saturates_and_grows(spark):
    ages = {k: slicks.estimate_age(L(a * 1e6), L(3.0)) for k, a in
            dict(tiny=.05, small=.8, big=2.5, large=20., huge=50., none=0.).items()}
    r = one(spark, **ages)
    assert r.tiny.saturated == "lower" and r.large.saturated == "upper" and r.huge.hours == 48
    assert r.small.saturated is None and r.big.saturated is None and r.big.hours > r.small.hours
    assert r.small.lo < r.small.hours < r.small.hi and "order-of-magnitude" in r.small.basis
    assert "report as" in r.huge.basis and r.none.hours is None and r.none.basis == "no area"


def test_oil_likelihood(spark):
    a = slicks.oil_likelihood(L(6.0), L(.92), L(-5.0), L(.9))
    b = slicks.oil_likelihood(L(1.2), L(.6), L(-1.0), L(.4))
    r = one(spark, a=a, b=b)
    assert r.a.verdict == "likely_oil" and r.b.verdict == "uncertain" and len(r.a.notes) == 3


def test_to_db_floor(spark):
    r = one(spark, lo=raster.to_db(1e-9), hi=raster.to_db(1.0))
    assert r.lo == -50.0 and r.hi == 0.0


def test_vessel_priors(spark):
    r = one(spark, t=vessels.vtype_prior(84.0), n=vessels.vtype_prior(L(None).cast("double")),
            h=vessels.vtype_label(45.0), s=vessels.size_score(400.0), u=vessels.size_score(0.0))
    assert (r.t, r.n, r.h, r.s, r.u) == (1.0, .4, "Vessel type 45", pytest.approx(1.0), .35)


@pytest.mark.parametrize("title,name", [
    ("T/V EXXON VALDEZ, Prince William Sound", "EXXON VALDEZ"),
    ("DBL 152; Gulf of Mexico", "DBL 152"),
    ("ATHOS I spill, Delaware River", "ATHOS I"),
    ("Mystery sheen in the bay", None),
    ("OIL SPILL - harbor", None),
    ("152 DBL barge", "DBL"),
    ("", None),
])
def test_vessel_name(spark, title, name):
    df = spark.createDataFrame([(title,)], "title string")
    assert df.select(titles.vessel_name("title")).first()[0] == name


def test_draws_agree_between_engines(spark):
    df = spark.range(2000).select(F.lit(7).cast("long").alias("s"), "id")
    g1, g2 = draws.normal_pair(F.col("s"), F.col("id"), 3, 1)
    p = df.select("id", g1.alias("g1"), g2.alias("g2")).toPandas().sort_values("id")
    n1, n2 = draws.np_normal_pair(np.full(2000, 7), np.arange(2000), 3, 1)
    assert np.allclose(p.g1, n1) and np.allclose(p.g2, n2)
    assert abs(n1.mean()) < .1 and .9 < n1.std() < 1.1 and abs(np.corrcoef(n1, n2)[0, 1]) < .1
