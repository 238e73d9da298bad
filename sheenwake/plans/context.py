"""Tables several queries share, computed once per session and data folder."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.slicks import place_scene
from ..operators import ais, components, drift, features, metrics, origins, regions, suspects
from ..session import cut_lineage, kept, spread, written
from ..sources import demo

KEYS = ["origin_id", "mmsi"]
RASTERS = {"mask", "pixel", "pred", "prob", "rgb"}
#: Intermediate tables whose maker writes them itself.
WRITTEN = {"clean"}

#: Weights standing in for a trained ranker where a fixed model is wanted.
DEMO_MODEL = {"prox_score": 2.0, "min_dist_km": -0.05, "dwell_frac": 1.5, "vtype_prior": 0.5,
              "slow_steaming": 0.7, "course_align": 0.4}


class Context:
    """Demo tables by name and the intermediate tables built from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._memo = spark, sf_dir, {}

    def t(self, name: str) -> DataFrame:
        """A demo table; rasters, which a real archive would hold as files, are written once."""
        if name in RASTERS:
            if name not in self._memo:
                with kept():
                    self._memo[name] = cut_lineage(demo.table(self.spark, self.sf_dir, name))
            return self._memo[name]
        return demo.table(self.spark, self.sf_dir, name)

    def once(self, name: str) -> DataFrame:
        """The intermediate table ``name``, written once and then read."""
        if name not in self._memo:
            make = getattr(self, f"_{name}")
            with kept():
                self._memo[name] = make() if name in WRITTEN else written(make)
        return self._memo[name]

    def _tracks(self):
        return ais.dedupe_fixes(self.t("ais"), ["mmsi"], "ord")

    def _summary(self):
        return origins.origin_summary(self.t("origin_sample"))

    def _clean(self):
        from .jobs import near_and_clean
        return near_and_clean(self.t("ais"), self.once("summary"), "ord")

    def _cand(self):
        return origins.candidate_vessels(self.once("clean"), self.once("summary"))

    def _features(self):
        return features.build_feature_table(self.once("clean"), self.once("cand"),
                                            self.t("origin_sample"), self.t("origin"), self.once("summary"))

    def _suspects(self):
        return suspects.score_baseline(self.once("features"))

    def _learned(self):
        return suspects.score_learned(self.once("features"), DEMO_MODEL)

    def _counts(self):
        return metrics.run_counts(self.once("clean"), self.once("cand"), self.once("summary"))

    def _track(self):
        cloud = self.t("origin_sample").withColumnRenamed("sample_id", "particle_id")
        return drift.origin_track(cloud, "origin_id")

    def _match(self):
        return features.track_match(self.once("clean"), self.once("cand"), self.once("track"),
                                    self.once("summary"))

    def _pairs(self):
        """Every origin sample asks for the position of one vessel."""
        s = self.t("origin_sample")
        block = F.floor(F.col("origin_id") / 100)
        return s.select((200000000 + block * 150 + F.col("sample_id") % 150).alias("mmsi"),
                        "sample_id", "t")

    def _positions(self):
        return ais_positions(self.once("tracks"), self._pairs())  # read by nothing else, so not written

    def _seeds(self):
        return spread(drift.seed_particles(drift.expand_ages(self.t("slick_drift")), self.t("footprint")),
                      "slick_id", "particle_id")

    def _cloud(self):
        return drift.backtrack(self.once("seeds"), self.t("field"))

    def _heat(self):
        return drift.heatmap(self.once("cloud"))

    def scenes(self) -> DataFrame:
        return self.t("scene").select("*", *place_scene("lat", "lon", "pixel_size_m"))

    def _regions(self):
        return regions.find_regions(self.t("mask"))

    def _slicks(self):
        return regions.characterize(self.t("mask"), self.scenes(), self.t("pixel"), self.t("prob"),
                                    labelled=self.once("regions"))

    def _true_objects(self):
        return metrics.objects(self.t("mask"), 3)

    def _pred_objects(self):
        return metrics.objects(self.t("pred"), 3)

    def _overlap(self):
        return metrics.pixel_overlap(self.once("true_objects"), self.once("pred_objects"))

    def _matches(self):
        return metrics.match_instances(self.once("overlap"))

    def _cm(self):
        return metrics.confusion_matrix(self.t("mask"), self.t("pred"))

    def _curated(self):
        from ..operators import incidents
        return incidents.curate(self.t("incident_raw"))


def ais_positions(tracks: DataFrame, pairs: DataFrame) -> DataFrame:
    from ..operators.asof import positions_at
    return positions_at(tracks, pairs, ["mmsi"])


_contexts: dict[tuple, Context] = {}


def context(spark: SparkSession, sf_dir: str) -> Context:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _contexts:
        _contexts[key] = Context(spark, sf_dir)
    return _contexts[key]
