"""Every operator as a named query over the demo tables."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import evidence, geo, slicks as slick_fn, titles, vessels
from ..functions.slicks import TRANSFORM, place_scene, scene_bounds
from ..operators import (ais, drift, features, incidents, metrics, origins, raster, regions,
                         requests, suspects, tiles)
from ..session import _shared_folder as shared_folder
from ..session import by_shuffle
from ..sources import readers, writers
from . import jobs
from .context import DEMO_MODEL, Context, context

QUERIES: dict[str, Callable[[Context], DataFrame]] = {}
KEYS = ["origin_id", "mmsi"]
THRESHOLDS = [0.5, 0.25, 0.1, 0.05]
BOX = (17.0, 60.0, 60.0, 175.0)
RANGE = (1704070800.0, 1704092400.0)
NOW = 1714000000.0


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r(name: str, digits: int = 6, alias: str | None = None):
    return F.round(F.col(name), digits).alias(alias or name.split(".")[-1])


def text(name: str, sep: str = " | "):
    return F.array_join(name, sep).alias(name)


def _near(fixes, summary):
    """Reports near the origins, rounded before they are repeated for each of them."""
    x = origins.ais_near_origin(fixes.withColumns({"lat_": F.round("lat", 6), "lon_": F.round("lon", 6)}), summary)
    return x.select(*KEYS, "ord", "t", F.col("lat_").alias("lat"), F.col("lon_").alias("lon"))


# ------------------------------------------------------------------ sources and sinks

@query
def src1_read_ais(c):
    x = readers.read_ais(c.t("ais_raw"), BOX, RANGE)
    return x.select("mmsi", "t", r("lat"), r("lon"), r("sog"), "cog", "heading", "length", "width",
                    "draft", "name", "vtype")


@query
def src2_resolve_columns(c):
    raw = c.t("ais_raw").select(
        F.col("MMSI").alias("mmsi"), F.col("Time").alias("Base_Date_Time"), F.col("LAT").alias("Latitude"),
        F.col("LON").alias("LONG"), F.col("SOG").alias("Speed Over Ground"), F.col("COG").alias("Course"),
        F.col("VesselName").alias("SHIP_NAME"), F.col("Length").alias("LOA"))
    x = ais.normalise_ais(raw)
    return x.select("mmsi", "t", r("lat"), r("lon"), r("sog"), "cog", "name", "length", "draft")


@query
def src3_crop_ais_bbox(c):
    x = writers.with_day(ais.cast_fields(writers.crop_ais(c.t("ais_raw"), BOX), ["ord"]))
    return x.select("ord", F.col("mmsi").cast("long").alias("mmsi"), r("lat"), r("lon"),
                    F.date_format("day", "yyyy-MM-dd").alias("day"))


@query
def src4_read_incidents(c):
    x = incidents.read_fields(c.t("incident_raw"))
    return x.select("name", "lat", "lon", F.date_format("date", "yyyy-MM-dd").alias("date"), "commodity")


@query
def src5_read_features_geojson(c):
    x = readers.flatten_features(c.t("feature_page"))
    return x.select(F.col("id").cast("long").alias("id"), "source_type",
                    F.col("properties")["mmsi"].cast("long").alias("mmsi"), "geometry_type", "lon", "lat")


@query
def src6_read_scene_tiles(c):
    d = c.t("documents").select("doc_id", "lang")
    path = lambda folder, end: F.concat(F.lit("file:/data/"), "lang", F.lit(f"/{folder}/d"), "doc_id", F.lit(end))
    files = (d.select(path("images", ".png").alias("path"))
             .union(d.where("doc_id % 7 <> 0").select(path("labels", ".png")))
             .union(d.where("doc_id % 3 = 0").select(path("labels", ".jpg"))))
    return readers.pair_scene_files(files)


@query
def src7_read_current_grid(c):
    return readers.read_current_grid(c.t("current_grid")).select(
        "slick_id", "ti", "yi", "xi", r("u"), r("v"))


@query
def src8_archive_near_origin(c):
    """An archive is written and read again, only where the origins are."""
    path = f"{shared_folder(c.spark)}/archive-{uuid.uuid4().hex}"
    writers.write_ais_archive(c.t("ais"), path)
    found = readers.read_archive_near(path, origins.loading_boxes(c.once("summary")), c.spark)
    return _near(found, c.once("summary"))


@query
def snk1_slicks_to_geojson(c):
    f = regions.slicks_to_geojson(c.once("slicks"))
    g = lambda p: F.get_json_object("feature", p)
    return f.select("scene_id", "slick_no", g("$.geometry.type").alias("geometry"),
                    F.round(g("$.geometry.coordinates[0]").cast("double"), 5).alias("x"),
                    F.round(g("$.geometry.coordinates[1]").cast("double"), 5).alias("y"),
                    g("$.properties.area_px").cast("long").alias("area_px"),
                    g("$.properties.coordinate_space").alias("space"))


@query
def snk2_suspects_report(c):
    s = c.once("suspects").join(c.once("match"), KEYS, "left")
    rep = suspects.suspects_report(s, c.once("clean"), 10, c.once("counts"))
    total = lambda f, n: F.round(F.aggregate(F.col(f"track.{f}"), F.lit(0.0), lambda a, x: a + x), n).alias(f"track_{f}")
    return rep.select("origin_id", "rank", "mmsi", "name", r("attribution_pct", 2), "vessel_type",
                      "length_m", "min_dist_km", "time_gap_min", "track_match", text("evidence"),
                      "scorer", "n_vessels_screened", "n_candidates",
                      F.size("track").cast("long").alias("n_track"), total("t", 1), total("lat", 3), total("lon", 3))


@query
def snk3_origin_report(c):
    cloud = c.once("cloud")
    h = {"spread": drift.particle_spread(cloud), "bounds": drift.heat_bounds(cloud), "heat": c.once("heat"),
         "track": drift.origin_track(cloud), "window": drift.time_window(c.t("slick_drift"))}
    x = drift.origin_report(h, c.t("slick_drift"))
    return x.select("slick_id", r("lat_c", 4), r("lon_c", 4), "n_particles", r("spread_km", 2),
                    r("lat_min", 5), r("lat_max", 5), r("lon_min", 5), r("lon_max", 5),
                    F.size("heat_cells").cast("long").alias("n_cells"), F.size("track").cast("long").alias("n_nodes"),
                    r("earliest", 2), r("most_likely", 2), r("latest", 2), "slick_bearing_deg", "bins")


@query
def snk4_curated_csv(c):
    x = incidents.by_priority(c.once("curated"))
    return x.select("name", "lat", "lon", "year", "vessel_guess", "is_oil", "is_vessel", "ais_era", "priority")


@query
def snk5_explain_text(c):
    return suspects.explain_text(c.once("suspects"), c.once("counts"))


# ------------------------------------------------------------------ projections and filters

@query
def prj1_normalise_ais(c):
    raw = c.t("ais_raw").select(
        "ord", "MMSI", "Time", F.when(F.col("ord") % 19 == 0, "bad").otherwise(F.col("LAT").cast("string")).alias("LAT"),
        F.col("LON").cast("string").alias("LON"), F.when(F.col("ord") % 23 == 0, "").otherwise(
            F.col("SOG").cast("string")).alias("SOG"))
    x = ais.cast_fields(raw, ["ord"])
    return x.select("ord", F.col("mmsi").cast("long").alias("mmsi"), "t", r("lat"), r("lon"), r("sog"), "cog", "name")


@query
def prj2_parse_time(c):
    e = c.t("events").select(
        "event_id", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("ms"),
        F.when(F.col("event_id") % 10 == 0, "not a time").otherwise(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("iso"))
    return e.select("event_id", F.round(ais.parse_time(e, "ts"), 3).alias("t_ts"),
                    F.round(ais.parse_time(e, "ms"), 3).alias("t_ms"),
                    F.round(ais.parse_time(e, "iso"), 3).alias("t_text"))


@query
def prj3_null_sentinels(c):
    x = c.t("ais_raw").select("ord", F.col("SOG").alias("sog"), F.col("COG").alias("cog"), F.col("Heading").alias("heading"))
    return ais.null_sentinels(x).select("ord", r("sog"), "cog", "heading")


@query
def prj4_pixel_to_lonlat(c):
    x = c.t("mask").join(c.scenes().select("scene_id", *TRANSFORM), "scene_id")
    lon, lat = slick_fn.pixel_to_lonlat("row", "col")
    return x.select("scene_id", "row", "col", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query
def prj5_place_scene(c):
    return c.scenes().select("scene_id", r("gt0"), r("gt1", 10), r("gt2"), r("gt3"), r("gt4"), r("gt5", 10))


@query
def prj6_scene_bounds(c):
    x = c.scenes().select("scene_id", *scene_bounds("height", "width"))
    return x.select("scene_id", r("south"), r("west"), r("north"), r("east"))


@query
def flt1_drop_invalid(c):
    x = c.t("ais").select("ord", F.when(F.col("ord") % 11 != 0, F.col("mmsi")).alias("mmsi"), "t",
                          (F.col("lat") * 3.2 + 30).alias("lat"), (F.col("lon") * 2.5).alias("lon"))
    return ais.drop_invalid(x).select("ord", "mmsi", "t", r("lat"), r("lon"))


@query
def flt2_bbox_time_filter(c):
    return ais.within(c.t("ais"), BOX, RANGE).select("ord", "mmsi", "t", r("lat"), r("lon"))


@query
def flt3_candidate_vessels(c):
    return c.once("cand").select(*KEYS, "n_fixes", r("near_km", 4), r("reach_km", 4))


@query
def flt4_incident_filter(c):
    x = incidents.text_hints(incidents.read_fields(c.t("incident_raw"))).withColumn(
        "ais_era", F.year("date") >= incidents.AIS_ERA_YEAR)
    return incidents.incident_filter(x).select("name", "lat", "lon", "commodity")


@query
def flt5_drop_small_regions(c):
    return c.once("regions").select("scene_id", "row", "col")


@query
def flt6_screen_gate(c):
    return raster.screen_gate(c.t("score")).select("scene_id", "truth", r("score"))


@query
def flt7_heat_cells_visible(c):
    x = drift.heat_cells_visible(c.once("heat"), drift.heat_bounds(c.once("cloud")))
    return x.select("slick_id", "i", "j", r("v", 4), r("lat", 4), r("lon", 4))


@query
def flt8_thin_rows(c):
    return suspects.thin_tracks(c.once("tracks"), ["mmsi"], 20).select("mmsi", "t", r("lat"), r("lon"))


@query
def flt9_choose_position(c):
    n = len(requests.REGIONS)
    names = F.array(*[F.lit(x[0]) for x in requests.REGIONS], F.lit("atlantis"))
    k = F.col("c_custkey")
    x = c.t("customer").select(
        k.alias("request_id"),
        F.when(k % 4 != 3, F.get(names, (k % (n + 1)).cast("int"))).alias("region"),
        F.when(k % 5 == 0, (k * 7 % 200 - 100).cast("double")).alias("lat"),
        F.when(k % 5 < 2, (k * 13 % 360 - 180).cast("double")).alias("lon"))
    return requests.choose_position(x)


# ------------------------------------------------------------------ joins

@query
def jn1_ais_near_origin(c):
    return _near(c.t("ais"), c.once("summary"))


@query
def jn2_position_at(c):
    return c.once("positions").select("mmsi", "sample_id", "covered", r("at_lat"), r("at_lon"))


@query
def jn3_value_at(c):
    return c.once("positions").select("mmsi", "sample_id", r("at_sog"), "at_cog")


@query
def jn4_nearest_fix_dt(c):
    return c.once("positions").select("mmsi", "sample_id", r("nearest_s", 3))


@query
def jn5_in_gap(c):
    return c.once("positions").select("mmsi", "sample_id", "in_gap")


@query
def jn6_closest_approach(c):
    x = features.closest_approach(c.once("clean"), c.once("cand"), c.t("origin_sample"), c.once("summary"))
    return x.select(*KEYS, r("dist_km", 4), "cog", r("sog", 4))


@query
def jn7_track_match(c):
    return c.once("match").select(*KEYS, r("track_match", 5))


@query
def jn8_join_learned_rank(c):
    x = suspects.join_learned_rank(c.once("suspects"), c.once("learned"))
    return x.select(*KEYS, "rank", "learned_rank")


@query
def jn9_decode_mask(c):
    return raster.decode_mask(c.t("rgb"))


@query
def jn10_grid_current_lookup(c):
    p = c.t("origin_sample").select(F.col("origin_id").alias("slick_id"), "sample_id", "t", "lat", "lon")
    x = drift.grid_current_lookup(p, readers.read_current_grid(c.t("current_grid")))
    return x.select("slick_id", "sample_id", r("u", 8), r("v", 8))


@query
def jn11_match_instances(c):
    return c.once("matches").select("scene_id", "g", "p", r("iou"))


@query
def jn12_case_truth_rank(c):
    x = metrics.case_truth_rank(c.once("suspects"), c.t("truth"))
    return x.select("origin_id", "truth_mmsi", "rank", r("attribution_pct", 3), "n_candidates")


@query
def jn13_origin_error_km(c):
    return origins.origin_error_km(c.once("summary"), c.t("truth")).select("origin_id", r("error_km", 5))


# ------------------------------------------------------------------ aggregates

@query
def agg1_origin_summary(c):
    x = c.once("summary")
    return x.select("origin_id", "n_samples", r("lat_c"), r("lon_c"), r("t_center", 2), r("t0", 2), r("t1", 2),
                    r("spread_km", 4), r("lat_min", 5), r("lat_max", 5), r("lon_min", 5), r("lon_max", 5))


@query
def agg2_vessel_statics(c):
    return ais.vessel_statics(c.once("tracks"), ["mmsi"])


def _feature(*names):
    return lambda c: c.once("features").select(*KEYS, *[r(n, 4) for n in names])


QUERIES["agg3_dwell_frac"] = _feature("dwell_frac")
QUERIES["agg4_prox_score"] = _feature("prox_score", "min_dist_km", "mean_dist_km")
QUERIES["agg5_time_gap_min"] = _feature("time_gap_min")
QUERIES["agg6_slow_steaming"] = _feature("slow_steaming")
QUERIES["agg7_loiter_score"] = _feature("loiter_score")
QUERIES["agg8_ais_gap_max_min"] = _feature("ais_gap_max_min")
QUERIES["agg9_gap_over_origin"] = _feature("gap_over_origin")
QUERIES["agg10_dark_frac"] = _feature("dark_frac")


@query
def agg11_heatmap(c):
    return c.once("heat").select("slick_id", "i", "j", r("v", 4))


@query
def agg12_origin_track(c):
    return c.once("track").select("origin_id", "node", r("lat"), r("lon"), r("t", 2))


@query
def agg13_particle_spread(c):
    x = drift.particle_spread(c.t("origin_sample"), "origin_id")
    return x.select("origin_id", r("lat_c"), r("lon_c"), "n_particles", r("spread_km", 5))


@query
def agg14_time_window(c):
    x = drift.time_window(c.t("slick_drift"))
    return x.select("slick_id", r("earliest", 3), r("most_likely", 3), r("latest", 3))


@query
def agg15_confusion_matrix(c):
    return metrics.confusion_matrix(c.t("mask"), c.t("pred"), ["scene_id"])


@query
def agg16_iou_report(c):
    x = metrics.iou_report(metrics.confusion_matrix(c.t("mask"), c.t("pred"), ["scene_id"]), ["scene_id"])
    return x.select("scene_id", *[r(f"iou_{n}") for n in raster.CLASSES], r("miou"), r("pixel_accuracy"))


@query
def agg17_oil_lookalike_confusion(c):
    x = metrics.oil_lookalike_confusion(c.once("cm"))
    return x.select("oil_pixels_called_lookalike", "lookalike_pixels_called_oil", r("oil_miss_rate"), r("false_oil_rate"))


@query
def agg18_class_pixel_counts(c):
    return metrics.class_pixel_counts(c.t("mask"), c.t("scene"))


@query
def agg19_region_measures(c):
    x = regions.region_measures(c.once("regions"), c.t("scene"))
    return x.select("scene_id", "label", "area_px", r("area_m2", 1), r("row_c", 4), r("col_c", 4), r("major_m", 3),
                    r("minor_m", 3), r("azimuth", 3), r("eccentricity", 5), r("elongation", 4))


@query
def agg20_region_contrast(c):
    x = regions.region_contrast(c.once("regions"), c.t("pixel"), c.t("mask"))
    return x.select("scene_id", "label", r("mean_backscatter"), r("contrast_db", 4))


@query
def agg21_region_confidence(c):
    return regions.region_confidence(c.once("regions"), c.t("prob")).select("scene_id", "label", r("confidence"))


@query
def agg22_region_perimeter(c):
    return regions.region_perimeter(c.once("regions")).select("scene_id", "label", r("perimeter_px", 4))


@query
def agg23_region_solidity(c):
    n = c.once("regions").groupBy("scene_id", "label").agg(F.count("*").alias("n"))
    x = regions.region_shapes(c.once("regions"), c.t("scene")).join(n, ["scene_id", "label"])
    return x.select("scene_id", "label", "hull_px", F.round(F.col("n") / F.col("hull_px"), 4).alias("solidity"))


@query
def agg24_object_metrics(c):
    x = metrics.object_metrics(c.once("true_objects"), c.once("pred_objects"), c.once("matches"))
    return x.select("tp", "fp", "fn", "n_true", "n_pred", r("precision"), r("recall"), r("f1"))


@query
def agg25_screen_threshold_table(c):
    x = metrics.screen_threshold_table(c.t("score"), THRESHOLDS)
    return x.select("threshold", r("recall"), r("precision"), r("screened_out"))


@query
def agg26_rank_metrics(c):
    x = metrics.rank_metrics(metrics.case_truth_rank(c.once("suspects"), c.t("truth")))
    return x.select(r("top1"), r("recall3"), r("mrr"), "recalled", "total", r("chance_rank"), r("median_rank"))


@query
def agg27_incident_summary(c):
    return incidents.incident_summary(c.once("curated"))


@query
def agg28_source_type_counts(c):
    return incidents.source_type_counts(readers.flatten_features(c.t("feature_page")))


@query
def agg29_agreement_rate(c):
    x = metrics.agreement_rate(c.once("suspects"), c.t("other_first"))
    return x.select("compared", r("agreement"))


@query
def agg30_run_counts(c):
    return c.once("counts")


# ------------------------------------------------------------------ ordered operators

@query
def win1_dedupe_fixes(c):
    return c.once("tracks").select("ord", "mmsi", "t", r("lat"), r("lon"))


@query
def win2_drop_teleports(c):
    return c.once("clean").select(*KEYS, "t", r("lat"), r("lon"))


@query
def win3_gaps(c):
    return ais.gaps(c.once("tracks"), ["mmsi"])


@query
def win4_rank_suspects(c):
    return c.once("suspects").select(*KEYS, "rank")


@query
def win5_attribution_pct(c):
    return c.once("suspects").select(*KEYS, r("attribution_pct", 4))


@query
def win6_track_span(c):
    return ais.track_span(c.once("tracks"), ["mmsi"])


def _tile_probs(c):
    """Overlapping tiles that do not agree: each adds a number of its own to the probabilities."""
    blocks = tiles.to_blocks(c.t("prob"), value="p", channel="cls", channels=len(raster.CLASSES))
    own = (F.col("ty") * 3 + F.col("tx")) % 7 / 100.0
    return tiles.cut_tiles(blocks, c.t("scene"), 20, 8).withColumn("v", F.transform("v", lambda p: p + own))


@query
def win7_blend_tiles(c):
    return raster.blend_tiles(_tile_probs(c)).select("scene_id", "row", "col", "cls", r("p", 5))


@query
def win8_argmax_class(c):
    return raster.argmax_class(c.t("prob"))


@query
def win9_lee_filter(c):
    return raster.lee_filter(c.t("pixel")).select("scene_id", "row", "col", r("value"))


@query
def win10_label_regions(c):
    return c.once("regions").select("scene_id", "row", "col", "label")


@query
def win11_trace_outline(c):
    x = regions.region_shapes(c.once("regions"), c.t("scene"))
    return x.select("scene_id", "label", F.posexplode("outline").alias("vertex", "p")).select(
        "scene_id", "label", "vertex", F.col("p.row").alias("row"), F.col("p.col").alias("col"))


# ------------------------------------------------------------------ top-k and sets

@query
def top1_top_suspects(c):
    return suspects.top_suspects(c.once("suspects"), 5).select(*KEYS, "rank", r("score", 4))


@query
def top2_top_evidence(c):
    return c.once("suspects").select(*KEYS, text("evidence"))


@query
def top3_slicks_by_area(c):
    return regions.slicks_by_area(c.once("slicks")).select("scene_id", "slick_no", "size_rank", "area_px")


@query
def top4_incidents_by_priority(c):
    x = incidents.by_priority(c.once("curated").where("priority")).limit(20)
    return x.select("name", "year", "lat", "lon", "vessel_guess")


@query
def top5_pick_slick(c):
    return regions.pick_slick(c.once("slicks"), 2).select("scene_id", "slick_no", "size_rank", "area_px")


@query
def set1_union_parts(c):
    a = c.t("ais")
    x = ais.union_parts(a.where("sog is null").drop("draft", "name"), a.where("sog is not null"))
    return x.select("ord", "mmsi", "t", r("sog"), "draft", "name")


@query
def set2_pixel_overlap(c):
    return c.once("overlap")


@query
def set3_missing_truth(c):
    return metrics.unmatched(c.once("true_objects"), c.once("pred_objects"), c.once("matches"))


# ------------------------------------------------------------------ scalar functions

def _legs(c):
    """Each origin sample with the true point of its origin."""
    return c.t("origin_sample").join(c.t("truth"), "origin_id")


@query
def sc1_haversine_km(c):
    d = geo.haversine_km("lat", "lon", "true_lat", "true_lon")
    return _legs(c).select("origin_id", "sample_id", F.round(d, 5).alias("km"))


@query
def sc2_local_km(c):
    e, n = geo.local_km("lat", "lon", "true_lat", "true_lon")
    x = _legs(c).withColumns({"e": e, "n": n})
    la, lo = geo.from_local_km("e", "n", "true_lat", "true_lon")
    return x.select("origin_id", "sample_id", r("e", 5), r("n", 5), F.round(la, 6).alias("lat"), F.round(lo, 6).alias("lon"))


@query
def sc3_bearing_deg(c):
    return _legs(c).select("origin_id", "sample_id", F.round(
        geo.bearing_deg("true_lat", "true_lon", "lat", "lon"), 4).alias("bearing"))


@query
def sc4_destination(c):
    x = c.t("ais").where("cog is not null and sog is not null")
    la, lo = geo.destination("lat", "lon", "cog", F.col("sog") * 100.0)
    return x.select("ord", F.round(la, 5).alias("lat2"), F.round(lo, 5).alias("lon2"))


@query
def sc5_axis_alignment(c):
    x = c.t("ais").where("cog is not null and heading is not null")
    return x.select("ord", F.round(geo.angdiff_deg("cog", "heading"), 4).alias("diff"),
                    F.round(geo.axis_alignment("cog", "heading"), 6).alias("align"))


@query
def sc6_vtype_prior(c):
    return c.t("ais").select("ord", vessels.vtype_prior(F.col("vtype") + F.col("ord") % 10).alias("prior"))


@query
def sc7_vtype_label(c):
    return c.t("ais").select("ord", vessels.vtype_label(F.col("vtype") + F.col("ord") % 10).alias("label"))


@query
def sc8_size_score(c):
    return c.t("ais").select("ord", F.round(vessels.size_score(F.col("length") - 25), 6).alias("size"))


QUERIES["sc9_course_align"] = _feature("course_align", "cpa_sog_kn")


@query
def sc10_evidence_terms(c):
    return c.once("features").select(*KEYS, *[F.round(v, 4).alias(k) for k, v in evidence.evidence_terms().items()])


@query
def sc11_baseline_score(c):
    return c.once("suspects").select(*KEYS, r("score", 4), r("prob", 5))


@query
def sc12_evidence_text(c):
    s = evidence.evidence_sentences()
    return c.once("features").select(*KEYS, *[v.alias(k) for k, v in s.items()])


@query
def sc13_orientation_to_azimuth(c):
    return c.t("ais").where("cog is not null").select("ord", F.round(
        slick_fn.orientation_to_azimuth(F.radians(F.col("cog") / 2 - 90)), 4).alias("azimuth"))


def _shapes(c):
    """Areas, elongations and winds spread over the part table."""
    return c.t("part").select(
        "p_partkey", (F.col("p_retailprice") * F.col("p_partkey") * 13.7 + 1000 * F.col("p_size")).alias("area"),
        (1 + F.col("p_size") / 7.0).alias("elong"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_size") / 4.0).alias("wind"))


@query
def sc14_estimate_age(c):
    x = _shapes(c).withColumn("a", slick_fn.estimate_age("area", "elong", "wind"))
    return x.select("p_partkey", r("a.hours", 1), r("a.lo", 1), r("a.hi", 1), "a.saturated", "a.basis")


@query
def sc15_oil_likelihood(c):
    x = c.t("part").select("p_partkey", (F.col("p_size") / 10.0).alias("e"), (0.5 + F.col("p_partkey") % 50 / 100.0).alias("s"),
                           (-F.col("p_size") / 8.0).alias("d"), (F.col("p_partkey") % 97 / 97.0).alias("p"))
    v = slick_fn.oil_likelihood("e", "s", "d", "p")
    return x.select("p_partkey", F.round(v["score"], 6).alias("score"), v["verdict"].alias("verdict"),
                    F.size(v["notes"]).cast("long").alias("n_notes"))


@query
def sc16_to_db(c):
    return c.t("pixel").select("scene_id", "row", "col", F.round(
        raster.to_db(F.pow(F.col("value"), F.lit(12.0)) - 1e-9), 5).alias("db"))


@query
def sc17_percentile_stretch(c):
    return raster.percentile_stretch(c.t("pixel")).select("scene_id", "row", "col", r("value"))


@query
def sc18_grey_from_rgb(c):
    return c.t("rgb").select("scene_id", "row", "col", F.round(raster.grey_from_rgb(), 5).alias("grey"))


@query
def sc19_text_hints(c):
    x = incidents.text_hints(incidents.read_fields(c.t("incident_raw")))
    return x.select("name", "commodity", "is_oil", "is_vessel")


@query
def sc20_vessel_name(c):
    return c.t("incident_raw").select(F.col("ID").alias("id"), titles.vessel_name("Name").alias("guess"))


@query
def sc21_first_point(c):
    x = readers.flatten_features(c.t("feature_page"))
    return x.select(F.col("id").cast("long").alias("id"), "lon", "lat")


@query
def sc22_age_label(c):
    x = _shapes(c).withColumn("a", slick_fn.estimate_age("area", "elong", "wind"))
    return x.select("p_partkey", slick_fn.age_label("a.hours", "a.lo", "a.hi", "a.saturated").alias("label"))


@query
def sc23_pick_dataset(c):
    t = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6 + 700000000.0
    return c.t("orders").select("o_orderkey", slick_fn.pick_dataset(t, F.lit(NOW)).alias("dataset"))


@query
def sc24_window_caps(c):
    lo, age, hi = slick_fn.window_caps(F.col("p_size") / 3.0, F.col("p_size").cast("double"), F.col("p_size") * 1.5)
    return c.t("part").select("p_partkey", F.round(lo, 5).alias("lo"), age.alias("age"), hi.alias("hi"))


@query
def sc25_class_palette_hex(c):
    n = c.t("mask").groupBy("cls").agg(F.count("*").alias("n"))
    return raster.class_palette(n).select("cls", "name", "color", "n")


@query
def sc26_augment_flip_rot(c):
    return raster.augment_flip_rot(c.t("pixel"), c.t("scene")).select("scene_id", "row", "col", r("value"))


@query
def sc27_resize_scene(c):
    x = raster.resize_scene(c.t("pixel"), c.t("scene"), 32)
    y = raster.resize_scene(c.t("mask"), c.t("scene"), 32, labels=True)
    return x.join(by_shuffle(y), ["scene_id", "row", "col"]).select("scene_id", "row", "col", r("value", 11), "cls")


# ------------------------------------------------------------------ trajectories

@query
def tr1_expand_ages(c):
    return drift.expand_ages(c.t("slick_drift")).select("slick_id", "particle_id", r("age_s", 2))


@query
def tr2_seed_particles(c):
    return c.once("seeds").select("slick_id", "particle_id", r("lat"), r("lon"), r("lat0"), r("lon0"))


@query
def tr3_backtrack(c):
    return c.once("cloud").select("slick_id", "particle_id", r("lat", 5), r("lon", 5), r("t", 2))


@query
def tr4_forecast_frames(c):
    x = drift.forecast_frames(c.once("seeds"), c.t("field"))
    return x.select("slick_id", "frame", "particle_id", r("t", 2), "hours", r("lat", 5), r("lon", 5))


@query
def tr5_field_velocity(c):
    x = c.t("origin_sample").join(c.t("field"), F.col("origin_id") == F.col("slick_id")).join(
        c.t("truth").select("origin_id", "true_lat", "true_lon"), "origin_id")
    e, n = geo.local_km("lat", "lon", "true_lat", "true_lon")
    x = x.withColumns({"e": e, "n": n})
    u, v = drift.field_velocity({k: F.col(k) for k in drift.FIELD}, F.col("e"), F.col("n"), F.col("t"))
    return x.select("origin_id", "sample_id", F.round(u, 5).alias("u"), F.round(v, 5).alias("v"))


@query
def tr6_grid_velocity(c):
    x = drift.backtrack_grid(c.once("seeds"), readers.read_current_grid(c.t("current_grid")), wind_u=2.0)
    return x.select("slick_id", "particle_id", r("lat", 5), r("lon", 5), r("t", 2))


@query
def tr7_from_point_cloud(c):
    p = c.t("site").select(F.col("site_id").alias("origin_id"), F.col("lat0").alias("lat"), F.col("lon0").alias("lon"),
                           F.col("tc").alias("t"))
    x = origins.from_point_cloud(p)
    return x.select("origin_id", "sample_id", r("lat"), r("lon"), r("t", 2))


@query
def tr8_drop_nonfinite(c):
    g = c.t("current_grid").select("slick_id", "ti", "yi", "xi", F.col("u").alias("lat"), F.col("v").alias("lon"))
    return drift.drop_nonfinite(g).select("slick_id", "ti", "yi", "xi", r("lat"), r("lon"))


@query
def tr9_origin_from_drift(c):
    cloud, o = origins.origin_from_drift(c.once("cloud"), c.t("slick_drift"))
    return cloud.join(o, "origin_id").select("origin_id", "sample_id", r("lat", 5), r("lon", 5), r("t", 2), "bearing")


@query
def tr10_choose_forcing(c):
    x = drift.choose_forcing(c.t("slick_drift"), c.t("coverage"))
    return x.select("slick_id", "forcing_source", "realistic", "fallback_reason")


# ------------------------------------------------------------------ jobs

@query
def job1_attribute(c):
    a = jobs.attribute(c.t("ais"), c.t("origin_sample"), c.t("origin"), c.once("track"), learned=DEMO_MODEL,
                       order="ord", canonical=True)
    return a["suspects"].select(*KEYS, "rank", r("score", 4), r("attribution_pct", 3), r("track_match", 5), "learned_rank")


@query
def job2_build_feature_table(c):
    return c.once("features").select(*KEYS, "name", "vtype", "length", "n_fixes", *[r(n, 4) for n in evidence.FEATURES])


@query
def job3_hindcast_origin(c):
    h = drift.hindcast(c.t("slick_drift"), c.t("footprint"), c.t("field"))
    x = h["spread"].join(h["window"], "slick_id")
    return x.select("slick_id", r("lat_c", 4), r("lon_c", 4), "n_particles", r("spread_km", 3), r("earliest", 2), r("latest", 2))


@query
def job4_characterize(c):
    x = c.once("slicks")
    return x.select("scene_id", "slick_no", "area_px", r("area_m2", 1), r("area_km2", 4), r("perimeter_m", 1), r("row_c", 2),
                    r("col_c", 2), r("lon", 5), r("lat", 5), r("orientation_deg", 1), r("major_axis_m", 1),
                    r("minor_axis_m", 1), r("elongation", 2), r("eccentricity", 3), r("compactness", 3),
                    r("mean_backscatter", 4), r("contrast_db", 2), r("confidence", 3), r("age_h", 1), "age_saturated",
                    "solidity", "oil_likelihood", text("notes"), F.size("polygon").alias("n_vertices"))


@query
def job5_preprocess_scene(c):
    return raster.preprocess(c.t("pixel")).select("scene_id", "row", "col", r("value"))


def linear_model():
    """A stand-in network: logits linear in the pixel value."""
    import numpy as np

    def model(x):
        return np.stack([4 - 12 * abs(x - 0.5), 4 - 12 * x, 3 - 12 * abs(x - 0.3), 12 * x - 8, 4 - 12 * abs(x - 0.8)], 1)

    return model


@query
def job6_score_tiles(c):
    p = raster.score_tiles(c.t("pixel"), c.t("scene"), linear_model, 32, 8)
    return p.select("scene_id", "row", "col", "cls", r("p", 4))


@query
def job7_investigate(c):
    scenes = c.t("scene").join(c.t("slick_drift").select(F.col("slick_id").alias("scene_id"), "t_detect"), "scene_id")
    x = jobs.investigate(scenes, c.t("pixel"), c.t("ais"), c.t("field"), mask=c.t("mask"), prob=c.t("prob"),
                         order="ord", canonical=True)
    return x["report"].select("scene_id", "slick_no", "origin_id", "rank", "mmsi", r("attribution_pct", 2), r("track_match", 3), text("evidence"))


@query
def job8_curate_incidents(c):
    x = jobs.curate_incidents(c.t("incident_raw"), ais_era_only=True)
    return x.select("name", "lat", "lon", "year", "vessel_guess", "priority")


@query
def job9_run_cases(c):
    p = c.t("truth").join(c.t("origin"), "origin_id").select(
        "origin_id", F.col("true_lat").alias("lat"), F.col("true_lon").alias("lon"), F.col("tc").alias("t"), "truth_mmsi")
    ranks, _ = jobs.run_cases(c.t("ais"), p, order="ord", canonical=True)
    return ranks.select("origin_id", "truth_mmsi", "rank", r("attribution_pct", 2), "n_candidates")


@query
def job10_hindcast_request(c):
    v = F.array_sort(F.collect_list(F.struct("vertex", "lat", "lon")))
    poly = c.t("footprint").groupBy("slick_id").agg(F.transform(v, lambda p: F.struct(
        p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("polygon"))
    s = c.t("slick_drift").drop("lat0", "lon0").join(poly, "slick_id")
    h = jobs.hindcast_request(s, c.t("field"))
    return h["particles"].select("slick_id", "particle_id", r("lat", 5), r("lon", 5), r("t", 2))


# ------------------------------------------------------------------ user functions

@query
def udf1_tile_scorer(c):
    return raster.argmax_class(raster.score_tiles(c.t("pixel"), c.t("scene"), linear_model, 32, 8))


def dark_share():
    """A stand-in screen: share of dark pixels."""
    return lambda img: float((img < 0.3).mean())


@query
def udf2_scene_screener(c):
    s = raster.screen_scenes(c.t("pixel"), dark_share)
    return raster.screen_gate(s, 0.10).select("scene_id", r("score"))


def steady_current(row, e, n, t):
    """A user's forcing: the background flow alone."""
    return row["bg_u"], row["bg_v"]


@query
def udf3_forcing(c):
    x = drift.backtrack(c.once("seeds"), c.t("field"), diffusion=0.0, velocity=steady_current)
    return x.select("slick_id", "particle_id", r("lat", 5), r("lon", 5), r("t", 2))


@query
def udf4_scorer(c):
    x = suspects.score_baseline(c.once("features"), {"prox": 5.0, "axis": -2.0, "timing": 1.0}, -1.0)
    return x.select(*KEYS, "rank", r("score", 4))


@query
def udf5_learned_rerank(c):
    f = c.once("features")
    best = f.groupBy("origin_id").agg(F.min_by("mmsi", F.struct("mean_dist_km", "mmsi")).alias("truth_mmsi"))
    x = suspects.get_scorer("learned", suspects.train_ranker(f, best))(f)
    return x.select(*KEYS, F.col("rank").alias("learned_rank"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: (lambda spark, sf_dir, fn=fn: fn(context(spark, sf_dir))) for n, fn in QUERIES.items()}
