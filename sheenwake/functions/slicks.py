"""Slick-level formulas: azimuth, age, oil likelihood, georeferencing."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import clamp, col, wrap

# Spreading constant and the bounds of the age model in hours.
SPREAD_K = 55.0
AGE_MIN_H, AGE_MAX_H = 0.5, 48.0
METRES_PER_DEG = 111_320.0


def orientation_to_azimuth(orientation_rad) -> Column:
    """Angle to the row axis (counter-clockwise, radians) -> compass axis in [0, 180)."""
    return wrap(-F.degrees(col(orientation_rad)), 180)


def estimate_age(area_m2, elongation, wind=None) -> Column:
    """Struct(hours, lo, hi, saturated, confidence, basis); hours null without area."""
    area, elong = col(area_m2), col(elongation)
    wind = F.lit(None).cast("double") if wind is None else col(wind)
    radius = F.sqrt(area / F.lit(3.141592653589793))
    raw = F.pow(radius / SPREAD_K, F.lit(4.0)) / 3600.0
    raw = raw * F.when(elong > 4, 1.4).when(elong < 2, 0.7).otherwise(1.0)
    raw = raw * F.when(wind > 8, 0.6).otherwise(1.0)
    ok = area > 0
    hours = clamp(raw, AGE_MIN_H, AGE_MAX_H)
    side = F.when(raw > AGE_MAX_H, "upper").when(raw < AGE_MIN_H, "lower")
    basis = F.concat(
        F.lit(f"Fay gravity-viscous spreading (r ~ t^1/4, K={SPREAD_K}), adjusted for elongation"),
        F.when(wind.isNull(), "").otherwise(" and wind"),
        F.lit(". Since t ~ r^4, this is order-of-magnitude only."),
        F.when(side == "upper", " Slick is larger than the model resolves -- report as "
                                "'> 48 h', not as 48 h.")
        .when(side == "lower", " Slick is very small -- report as '< 0.5 h'.").otherwise(""))
    return F.struct(
        F.when(ok, F.round(hours, 1)).alias("hours"),
        F.when(ok, F.round(hours / 4, 1)).alias("lo"),
        F.when(ok, F.round(hours * 4, 1)).alias("hi"),
        F.when(ok, side).alias("saturated"),
        F.lit("low").alias("confidence"),
        F.when(ok, basis).otherwise("no area").alias("basis"))


def oil_likelihood(elongation, solidity, contrast_db, confidence) -> Column:
    """Struct(score, verdict, notes) of the additive second opinion."""
    e, s, d, p = col(elongation), col(solidity), col(contrast_db), col(confidence)
    score = (F.when(e >= 3.0, 0.30).when(e < 1.8, -0.20).otherwise(0.0)
             + F.when(s >= 0.85, 0.15).otherwise(-0.10)
             + F.when(d <= -3.0, 0.25).when(d > -1.5, -0.15).otherwise(0.0)
             + 0.3 * (p - 0.5) * 2)
    notes = F.array(
        F.when(e >= 3.0, F.format_string(
            "Elongated (aspect %.1f:1), consistent with wind/current stretching", e))
        .when(e < 1.8, F.format_string(
            "Compact (aspect %.1f:1) -- look-alikes such as low-wind zones are typically round", e)),
        F.when(s >= 0.85, F.format_string("Well-defined boundary (solidity %.2f)", s))
        .otherwise(F.format_string("Ragged/diffuse boundary (solidity %.2f)", s)),
        F.when(d <= -3.0, F.format_string("Strong dampening (%.1f dB below surrounding sea)", d))
        .when(d > -1.5, F.format_string("Weak contrast (%.1f dB) -- may be a wind shadow", d)))
    # The sums of two-digit parts are compared after removing binary dust.
    verdict = (F.when(F.round(score, 9) >= 0.45, "likely_oil")
               .when(F.round(score, 9) >= 0.15, "possible_oil").otherwise("uncertain"))
    return F.struct(score.alias("score"), verdict.alias("verdict"),
                    F.filter(notes, lambda n: n.isNotNull()).alias("notes"))


def age_label(hours, lo, hi, saturated) -> Column:
    h, side = col(hours), col(saturated)
    one = lambda x: F.format_string("%.1f", col(x))
    return (F.when(h.isNull(), "n/a")
            .when(side == "upper", F.concat(F.lit("> "), one(h), F.lit(" h")))
            .when(side == "lower", F.concat(F.lit("< "), one(h), F.lit(" h")))
            .otherwise(F.concat(F.lit("~"), one(h), F.lit(" h ("), one(lo), F.lit("–"),
                                one(hi), F.lit(")"))))


def window_caps(lo_h, age_h, hi_h, max_h: float = 24.0) -> tuple[Column, Column, Column]:
    """(lo, age, hi) hours limited to what a backward run may cover."""
    hi = F.least(col(hi_h), F.lit(float(max_h)))
    return F.least(col(lo_h), hi * 0.5), F.least(col(age_h), hi), hi


#: The six columns of an affine transform, in GDAL order.
TRANSFORM = ["gt0", "gt1", "gt2", "gt3", "gt4", "gt5"]


def pixel_to_lonlat(row, column, transform: list | None = None) -> tuple[Column, Column]:
    a, b, c, d, e, f = [col(x) for x in (transform or TRANSFORM)]
    r, q = col(row), col(column)
    return a + q * b + r * c, d + q * e + r * f


def place_scene(lat, lon, pixel_size_m) -> list[Column]:
    """Transform of a scene whose north-west corner is (lat, lon)."""
    px = col(pixel_size_m)
    squeeze = F.greatest(F.cos(F.radians(col(lat))), F.lit(0.02))
    values = [col(lon), px / (METRES_PER_DEG * squeeze), F.lit(0.0),
              col(lat), F.lit(0.0), -px / METRES_PER_DEG]
    return [v.alias(n) for v, n in zip(values, TRANSFORM)]


def scene_bounds(height, width, transform: list | None = None) -> list[Column]:
    lon0, lat0 = pixel_to_lonlat(F.lit(0.0), F.lit(0.0), transform)
    lon1, lat1 = pixel_to_lonlat(height, width, transform)
    return [F.least(lat0, lat1).alias("south"), F.least(lon0, lon1).alias("west"),
            F.greatest(lat0, lat1).alias("north"), F.greatest(lon0, lon1).alias("east")]


# Ids of the two public ocean current products and the age that parts them.
REANALYSIS = "cmems_mod_glo_phy_my_0.083deg_P1D-m"
FORECAST = "cmems_mod_glo_phy-cur_anfc_0.083deg_PT6H-i"
REANALYSIS_AFTER_DAYS = 120


def pick_dataset(t, now) -> Column:
    days = (col(now) - col(t)) / 86400.0
    return F.when(days > REANALYSIS_AFTER_DAYS, REANALYSIS).otherwise(FORECAST)
