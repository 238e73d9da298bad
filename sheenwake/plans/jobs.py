"""The jobs a user calls: many scenes, slicks and origins in one run each."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.slicks import TRANSFORM, place_scene, window_caps
from ..operators import drift, features, incidents, metrics, near, origins, raster, regions, suspects
from ..operators.ais import teleports
from ..session import cut_lineage, writes_once, written
from ..sources.readers import read_ais

KEYS = ["origin_id", "mmsi"]
#: Bucket of tracks cut to an origin's hours: few of them, and a few thousand fixes each at a report every few seconds.
NEAR_BUCKET_S = 6 * 3600.0
#: Reports of a vessel in the hours of an origin that one task may hold.
LONG_TRACK = 500_000


@writes_once
def near_and_clean(fixes: DataFrame, summary: DataFrame, order: str | None = None,
                   lookback_h: float = origins.LOOKBACK_H, long_track: int = LONG_TRACK) -> DataFrame:
    """Reports near each origin, cleaned per (origin, vessel): origin_id and the columns of ``fixes``.

    The crop comes first, so the first anchor of a track depends on the origin's box. Near rows are many times
    the reports, so reports are sent to groups of origins and cleaned there. A vessel with about ``long_track`` reports or
    more in the hours of an origin would make a block too large and goes through buckets of time instead. Whether
    a time occurs twice is counted on the reports.
    """
    if order is None:  # any fixed order of whole rows will do, as long as equal rows count once
        fixes, order = fixes.distinct().withColumn("order_", F.xxhash64(*fixes.columns)), "order_"
    several = cut_lineage(fixes.groupBy("mmsi", "t").agg(F.count("*").alias("n_")).where("n_ > 1")
                          .select("mmsi", "t", F.lit(True).alias("several_")))
    marked = cut_lineage(fixes.join(several, ["mmsi", "t"], "left").withColumn(
        "several_", F.coalesce("several_", F.lit(False))))
    hours = origins.loading_boxes(summary, lookback_h).agg(F.max(F.col("load1") - F.col("load0")).alias("s_"))
    long = cut_lineage(marked.crossJoin(F.broadcast(hours)).groupBy("mmsi", F.floor(F.col("t") / F.col("s_")))
                       .agg(F.count("*").alias("n_")).where(F.col("n_") > long_track / 2).select("mmsi").distinct())
    if long.isEmpty():
        return _by_group(marked, summary, order, lookback_h)
    return _by_group(marked.join(long, "mmsi", "left_anti"), summary, order, lookback_h).unionByName(
        _by_bucket(marked.join(long, "mmsi", "left_semi"), summary, order, lookback_h))


def _by_group(marked: DataFrame, summary: DataFrame, order: str, lookback_h: float) -> DataFrame:
    by_order = F.dense_rank().over(Window.partitionBy("mmsi", "t").orderBy(order))
    ranked = marked.where("several_").withColumn("rank_", F.when(F.col(order).isNull(), 0).otherwise(by_order))
    ranked = marked.where("not several_").withColumn("rank_", F.lit(1)).unionByName(ranked)
    return near.clean_near(ranked.drop("several_"), summary, lookback_h).drop("order_")


def _by_bucket(marked: DataFrame, summary: DataFrame, order: str, lookback_h: float) -> DataFrame:
    """Only place and time of near rows are written for the cleaning; the search runs once more for the rows that stay."""
    def search(*cols: str) -> DataFrame:
        return origins.ais_near_origin(marked.select("mmsi", "t", "lat", "lon", "several_", *cols), summary.select(
            "origin_id", "t0", "t1", "lat_min", "lat_max", "lon_min", "lon_max"), lookback_h).drop("t0", "t1")

    narrow = cut_lineage(search(order))
    ranked = F.row_number().over(Window.partitionBy(*KEYS, "t").orderBy(order))
    first = cut_lineage(narrow.where("several_").withColumn("rank_", ranked).where("rank_ = 1").drop("rank_"))
    lost = teleports(narrow.where("not several_").unionByName(first), KEYS, bucket_s=NEAR_BUCKET_S)
    wide = search(*[c for c in marked.columns if c not in ("mmsi", "t", "lat", "lon", "several_")])
    kept = wide.where("not several_").unionByName(
        wide.where("several_").join(first.select(*KEYS, "t", order), [*KEYS, "t", order], "left_semi"))
    return kept.join(lost, [*KEYS, "t"], "left_anti").drop("several_", "order_")


def attribute(ais: DataFrame, samples: DataFrame, origin: DataFrame, track: DataFrame | None = None,
              *, radius_km: float = origins.RADIUS_KM, lookback_h: float = origins.LOOKBACK_H,
              weights: dict[str, float] | None = None, learned: dict[str, float] | None = None,
              order: str | None = None, canonical: bool = False) -> dict[str, DataFrame]:
    """Rank the vessels that could have caused each slick.

    ``samples`` is the cloud (origin_id, sample_id, lat, lon, t), ``origin`` has
    (origin_id, bearing) and ``track`` the optional nodes (origin_id, node, lat, lon, t).
    Returns suspects with counts, candidates and cleaned fixes. The transparent score
    always leads; a learned order is only shown next to it.
    """
    fixes = ais if canonical else read_ais(ais, keep=[order] if order else None)
    summary = written(lambda: origins.origin_summary(samples, radius_km=radius_km))
    clean = near_and_clean(fixes, summary, order, lookback_h)
    cand = cut_lineage(origins.candidate_vessels(clean, summary, radius_km))
    table = written(lambda: features.build_feature_table(clean, cand, samples, origin, summary, radius_km))
    ranked = suspects.score_baseline(table, weights)
    if track is not None:
        match = features.track_match(clean, cand, track, summary)
        ranked = ranked.join(match, KEYS, "left")
    else:
        ranked = ranked.withColumn("track_match", F.lit(0.0))
    order_by_model = suspects.score_learned(table, learned) if learned else None
    ranked = suspects.join_learned_rank(ranked, order_by_model)
    return {"suspects": ranked, "features": table, "candidates": cand, "fixes": clean,
            "summary": summary, "counts": metrics.run_counts(clean, cand, summary)}


def attribute_points(ais: DataFrame, points: DataFrame, n: int = 200, sigma_km: float = 5.0,
                     sigma_min: float = 60.0, **options) -> dict[str, DataFrame]:
    """:func:`attribute` for point origins (origin_id, lat, lon, t[, bearing])."""
    # Drawn once: the cloud is read by the summary, several times, and by the features.
    cloud = cut_lineage(origins.from_point_cloud(points, n, sigma_km, sigma_min))
    bearing = F.col("bearing") if "bearing" in points.columns else F.lit(None).cast("double")
    return attribute(ais, cloud, points.select("origin_id", bearing.alias("bearing")), **options)


def detect(pixels: DataFrame, scenes: DataFrame, load_model: Callable[[], Callable],
           tile: int = raster.TILE, overlap: int = raster.OVERLAP, despeckle: bool = True,
           already_preprocessed: bool = False) -> dict[str, DataFrame]:
    """Scene -> probabilities -> mask -> slicks, with a user's model."""
    px = pixels if already_preprocessed else raster.preprocess(pixels, despeckle=despeckle)
    px = cut_lineage(px)
    prob = cut_lineage(raster.score_tiles(px, scenes, load_model, tile, overlap))
    mask = cut_lineage(raster.argmax_class(prob))
    return {"pixels": px, "prob": prob, "mask": mask,
            "slicks": regions.characterize(mask, scenes, px, prob)}


def outline_to_footprint(slicks: DataFrame) -> DataFrame:
    """Vertices of the slick outlines, the start of the particles."""
    return slicks.select("slick_id", F.posexplode("polygon").alias("vertex", "p")).select(
        "slick_id", "vertex", F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))


def hindcast_request(polygons: DataFrame, field: DataFrame, **options) -> dict[str, DataFrame]:
    """Backward run from given outlines (slick_id, t_detect, age_h, lo_h, hi_h, bearing, polygon)."""
    enough = F.when(F.size("polygon") >= 3, F.col("polygon")).otherwise(
        F.raise_error(F.lit("a polygon of at least 3 points is required")).cast(
            polygons.schema["polygon"].dataType))
    ok = polygons.withColumn("polygon", enough)
    return drift.hindcast(ok.drop("polygon"), outline_to_footprint(ok), field, **options)


def investigate(scenes: DataFrame, pixels: DataFrame, ais: DataFrame, field: DataFrame,
                load_model: Callable[[], Callable] | None = None, mask: DataFrame | None = None,
                prob: DataFrame | None = None, load_screener: Callable[[], Callable] | None = None,
                *, gate: bool = False, threshold: float = 0.10, slick_no: int | None = None,
                n_particles: int = drift.N_PARTICLES, forecast_h: float = 24.0,
                max_hindcast_h: float = 24.0, radius_km: float = origins.RADIUS_KM, top_n: int = 10,
                order: str | None = None, canonical: bool = False,
                tile: int = raster.TILE, overlap: int = raster.OVERLAP,
                grid: DataFrame | None = None, coverage: DataFrame | None = None) -> dict[str, DataFrame]:
    """Screen, detect, run back and forward, and attribute for every scene at once.

    ``scenes`` has (scene_id, height, width, pixel_size_m, lat, lon, t_detect[, wind]) and ``field``
    a row per scene, whose id stands in its slick_id. All slicks of a scene are followed; with
    ``slick_no`` only that one, else the largest. slick_id and origin_id are hashes of
    (scene_id, slick_no), which stand next to them in drift, forecast, attribution and report.
    A slick with an outline of under 3 points starts from its centre. The screen is reported and
    stops a scene only with ``gate``. ``notes`` says for every scene what was found. ``grid`` and ``coverage``
    are current grids and where they hold, with the scene's id in slick_id as in ``field``; drift then says under
    ``forcing`` what each slick ran on, and why if not on its grid.
    """
    if not all(c in scenes.columns for c in TRANSFORM):
        scenes = scenes.select("*", *place_scene("lat", "lon", "pixel_size_m"))
    screen = None
    if load_screener is not None:
        screen = (cut_lineage(raster.screen_scenes(pixels, load_screener))
                  .withColumns({"threshold": F.lit(float(threshold)),
                                "oil_likely": F.col("score") >= float(threshold)}))
        if gate:
            passed = raster.screen_gate(screen, threshold)
            scenes = scenes.join(passed, "scene_id", "left_semi")
            pixels = pixels.join(passed, "scene_id", "left_semi")
            mask = mask.join(passed, "scene_id", "left_semi") if mask is not None else None
            prob = prob.join(passed, "scene_id", "left_semi") if prob is not None else None
    if mask is None:
        found = detect(pixels, scenes, load_model, tile, overlap)["slicks"]
    else:
        found = regions.characterize(mask, scenes, pixels, prob)
    found = cut_lineage(found)
    picked = found if slick_no is None else regions.pick_slick(found, slick_no)

    lo, age, hi = window_caps(F.coalesce("age_lo_h", F.col("age_h") / 4), F.coalesce("age_h", F.lit(6.0)),
                              F.coalesce("age_hi_h", F.col("age_h") * 4), max_hindcast_h)
    centre = F.array_repeat(F.struct("lon", "lat"), 3)
    slicks = (picked.join(scenes.select("scene_id", "t_detect"), "scene_id")
              .select("scene_id", "slick_no", F.xxhash64("scene_id", "slick_no").alias("slick_id"),
                      "t_detect", age.alias("age_h"), lo.alias("lo_h"), hi.alias("hi_h"),
                      F.col("orientation_deg").alias("bearing"),
                      F.when(F.size("polygon") >= 3, F.col("polygon")).otherwise(centre).alias("polygon")))
    slicks = cut_lineage(slicks)
    keys = slicks.select("scene_id", "slick_no", "slick_id")
    slicks = slicks.drop("scene_id", "slick_no")
    # Written, so that its size is known: a row a slick, next to hundreds of particles each.
    field = cut_lineage(field.withColumnRenamed("slick_id", "scene_id").join(keys, "scene_id")
                        .drop("scene_id", "slick_no"))

    def named(df: DataFrame, key: str) -> DataFrame:
        """``df`` with the scene and the number of each slick."""
        return df.join(keys.withColumnRenamed("slick_id", key), key)

    per_slick = lambda df: (None if df is None else df.withColumnRenamed("slick_id", "scene_id")
                            .join(keys, "scene_id").drop("scene_id", "slick_no"))
    back = hindcast_request(slicks, field, n_particles=n_particles, grid=per_slick(grid), coverage=per_slick(coverage))
    seeds = drift.seed_particles(drift.expand_ages(slicks.drop("polygon"), n_particles),
                                 outline_to_footprint(slicks))
    ahead = drift.forecast_frames(seeds, field, forecast_h)

    cloud, origin = origins.origin_from_drift(back["particles"], slicks)
    track = cut_lineage(back["track"].withColumnRenamed("slick_id", "origin_id"))
    result = attribute(ais, cloud, origin, track, radius_km=radius_km, order=order, canonical=canonical)
    report = suspects.suspects_report(result["suspects"], result["fixes"], top_n, result["counts"])
    notes = (scenes.select("scene_id").join(found.groupBy("scene_id").agg(
        F.count("*").alias("n_slicks")), "scene_id", "left")
        .select("scene_id", F.coalesce("n_slicks", F.lit(0)).alias("n_slicks"),
                F.when(F.col("n_slicks").isNull(), "No oil slick detected, so drift and attribution "
                                                   "did not run.").alias("note")))
    out = {"notes": notes, "slicks": found, "drift": {k: named(x, "slick_id") for k, x in back.items()},
           "forecast": named(ahead, "slick_id"),
           "attribution": {k: named(x, "origin_id") for k, x in result.items()},
           "report": named(report, "origin_id")}
    if screen is not None:
        out["screen"] = screen
    return out


def run_cases(ais: DataFrame, cases: DataFrame, n: int = 400, sigma_km: float = 6.0,
              sigma_min: float = 180.0, radius_km: float = 30.0, order: str | None = None,
              canonical: bool = False) -> tuple[DataFrame, DataFrame]:
    """Known-vessel cases (origin_id, lat, lon, t, truth_mmsi[, sigma_km, sigma_min]) -> ranks and their summary.

    How well place and time are known differs by case: its own spread goes before the arguments.
    """
    r = attribute_points(ais, cases, n, sigma_km, sigma_min, radius_km=radius_km, order=order,
                         canonical=canonical)
    ranks = cut_lineage(metrics.case_truth_rank(r["suspects"], cases))
    return ranks, metrics.rank_metrics(ranks)


def curate_incidents(df: DataFrame, ais_era_only: bool = False) -> DataFrame:
    return incidents.by_priority(incidents.curate(df, ais_era_only))
