"""Origin clouds: summaries, and the search for reports and vessels near them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.draws import normal_pair
from ..functions.geo import KM_PER_DEG, from_local_km, haversine_km, km_per_deg_lon
from ..session import by_shuffle, cut_lineage, spread
from .quantile import exact_percentiles

# Search radius (km), box padding beyond it (km), hours looked back and
# forward while loading, hours around the cloud in which a vessel may be a candidate.
RADIUS_KM, BOX_EXTRA_KM = 25.0, 40.0
LOOKBACK_H, FORWARD_H, CANDIDATE_H = 12.0, 2.0, 6.0
MIN_FIXES = 2

CELL_DEG, CELL_S = 1.0, 6 * 3600.0
#: Fixes of a cell that meet the boxes around it in one task.
CROWD = 100_000


def origin_summary(samples: DataFrame, pad_km: float | None = None,
                   radius_km: float = RADIUS_KM) -> DataFrame:
    """One row per origin: centroid, time centre and span, RMS spread, padded box.

    The default padding is ``radius_km + spread + 40 km``.
    """
    base = samples.groupBy("origin_id").agg(
        F.count("*").alias("n_samples"), F.avg("lat").alias("lat_c"), F.avg("lon").alias("lon_c"),
        F.min("t").alias("t0"), F.max("t").alias("t1"),
        F.min("lat").alias("lat_lo"), F.max("lat").alias("lat_hi"),
        F.min("lon").alias("lon_lo"), F.max("lon").alias("lon_hi"))
    d = haversine_km("lat", "lon", "lat_c", "lon_c")
    spread = (samples.select("origin_id", "lat", "lon")
              .join(base.select("origin_id", "lat_c", "lon_c"), "origin_id")
              .groupBy("origin_id").agg(F.sqrt(F.avg(d * d)).alias("spread_km")))
    middle = exact_percentiles(samples, ["origin_id"], "t", {"t_center": 0.5})
    pad = F.lit(pad_km) if pad_km is not None else radius_km + F.col("spread_km") + BOX_EXTRA_KM
    dlat, dlon = pad / KM_PER_DEG, pad / F.greatest(km_per_deg_lon("lat_c"), F.lit(1e-6))
    return (base.join(spread, "origin_id").join(middle, "origin_id")
            .select("origin_id", "n_samples", "lat_c", "lon_c", "t_center", "t0", "t1", "spread_km",
                    (F.col("lat_lo") - dlat).alias("lat_min"), (F.col("lat_hi") + dlat).alias("lat_max"),
                    (F.col("lon_lo") - dlon).alias("lon_min"), (F.col("lon_hi") + dlon).alias("lon_max")))


def _cells(lo: Column, hi: Column, size: float) -> Column:
    return F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size)))


def loading_boxes(summary: DataFrame, lookback_h: float = LOOKBACK_H, forward_h: float = FORWARD_H) -> DataFrame:
    """``summary`` with the time range (load0, load1) in which reports are loaded."""
    return summary.withColumns({"load0": F.col("t0") - lookback_h * 3600.0, "load1": F.col("t1") + forward_h * 3600.0})


def ais_near_origin(fixes: DataFrame, summary: DataFrame, lookback_h: float = LOOKBACK_H,
                    forward_h: float = FORWARD_H, crowd: int = CROWD) -> DataFrame:
    """Fixes inside each origin's padded box and loading range; one row per (fix, origin).

    A range join by cells: each origin lists the (lat, lon, time) cells its box touches
    and a fix falls into exactly one, so the join is an equality and the exact test runs
    on few pairs. Fixes are counted by cell first: a busy port, a cell of more than ``crowd`` of them, is
    split into parts, to each of which the boxes that touch it are copied; a quiet one is not. ``summary``
    columns stay on the result.
    """
    cell = ["cy", "cx", "ct"]
    boxes = loading_boxes(summary, lookback_h, forward_h)
    keyed = (boxes
             .withColumn("cy", _cells(F.greatest("lat_min", F.lit(-90.0)),
                                      F.least("lat_max", F.lit(90.0)), CELL_DEG))
             .withColumn("cx", _cells(F.greatest("lon_min", F.lit(-180.0)),
                                      F.least("lon_max", F.lit(180.0)), CELL_DEG))
             .withColumn("ct", _cells(F.col("load0"), F.col("load1"), CELL_S)))
    probe = fixes.withColumns({
        "cy": F.floor(F.col("lat") / CELL_DEG), "cx": F.floor(F.col("lon") / CELL_DEG),
        "ct": F.floor(F.col("t") / CELL_S)})
    busy = cut_lineage(probe.groupBy(*cell).agg(F.count("*").alias("n_")).where(F.col("n_") > crowd)
                       .select(*cell, F.ceil(F.col("n_") / crowd).alias("parts")))
    one = F.lit(1).cast("bigint")
    # at most one cell in ``crowd`` fixes is busy
    probe = (probe.join(F.broadcast(busy), cell, "left")
             .withColumn("part", F.pmod(F.xxhash64("mmsi", "t"), F.coalesce("parts", one))).drop("parts"))
    keyed = (keyed.join(F.broadcast(busy), cell, "left")
             .withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("parts", one) - 1))).drop("parts"))
    # Many rows become of a fix, and many cells of a box: neither side is as small as its file, or few tasks' work.
    return (spread(probe, *cell, "part").join(by_shuffle(keyed), [*cell, "part"])
            .where(F.col("lat").between(F.col("lat_min"), F.col("lat_max"))
                   & F.col("lon").between(F.col("lon_min"), F.col("lon_max"))
                   & F.col("t").between(F.col("load0"), F.col("load1")))
            .drop(*cell, "part", "load0", "load1",
                  "lat_min", "lat_max", "lon_min", "lon_max"))


def candidate_vessels(near: DataFrame, summary: DataFrame, radius_km: float = RADIUS_KM,
                      min_fixes: int = MIN_FIXES) -> DataFrame:
    """(origin, vessel) pairs with a real fix close to the cloud in space and time.

    ``near`` are the cleaned reports near each origin (origin_id, mmsi, t, lat, lon).
    """
    near = near.select("origin_id", "mmsi", "t", "lat", "lon").join(
        summary.select("origin_id", "lat_c", "lon_c", "t0", "t1", "spread_km"), "origin_id")
    d = haversine_km("lat", "lon", "lat_c", "lon_c")
    pad = CANDIDATE_H * 3600.0
    in_win = F.col("t").between(F.col("t0") - pad, F.col("t1") + pad)
    return (near.groupBy("origin_id", "mmsi")
            .agg(F.count("*").alias("n_fixes"), F.min(F.when(in_win, d)).alias("near_km"),
                 F.max(radius_km + F.col("spread_km")).alias("reach_km"))
            .where((F.col("n_fixes") >= min_fixes) & (F.col("near_km") <= F.col("reach_km"))))


def from_point_cloud(points: DataFrame, n: int = 200, sigma_km: float = 5.0,
                     sigma_min: float = 60.0) -> DataFrame:
    """Gaussian samples around point origins (origin_id, lat, lon, t).

    A point may bring its own spread in columns sigma_km and sigma_min; where these are null or absent, the
    arguments hold. Draws are keyed by the origin's number (a hash of it, for an id that is no number).
    """
    # Hundreds of draws become of a point, and a small file of points is one task's.
    s = spread(points, "origin_id").withColumn("sample_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    whole = isinstance(points.schema["origin_id"].dataType, IntegralType)
    key = F.pmod(F.col("origin_id").cast("long") if whole else F.xxhash64("origin_id"), F.lit(1_000_003))
    own = lambda c, x: F.coalesce(F.col(c), F.lit(float(x))) if c in points.columns else F.lit(float(x))
    km, minutes = own("sigma_km", sigma_km), own("sigma_min", sigma_min)
    east, north = normal_pair(key, F.col("sample_id"), 0, 1)
    dt, _ = normal_pair(key, F.col("sample_id"), 0, 3)
    lat, lon = from_local_km(east * km, north * km, "lat", "lon")
    return s.select("origin_id", "sample_id", lat.alias("lat"), lon.alias("lon"),
                    (F.col("t") + dt * (minutes * 60.0)).alias("t"))


def origin_from_drift(particles: DataFrame, slicks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drift particles become the cloud unchanged; the slick's axis is carried over."""
    cloud = particles.select(F.col("slick_id").alias("origin_id"),
                             F.col("particle_id").alias("sample_id"), "lat", "lon", "t")
    return cloud, slicks.select(F.col("slick_id").alias("origin_id"), "bearing")


def origin_error_km(summary: DataFrame, truth: DataFrame) -> DataFrame:
    """Distance of each centroid to the true point."""
    return (summary.join(truth, "origin_id")
            .select("origin_id",
                    haversine_km("lat_c", "lon_c", "true_lat", "true_lon").alias("error_km")))
