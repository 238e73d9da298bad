"""Quality of masks, detections, screens and rankings."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import by_shuffle, cut_lineage
from .components import TILE, label_regions
from .quantile import exact_percentiles
from .raster import CLASSES, LOOK_ALIKE, OIL

# Smallest object (px) and least overlap of a match.
MIN_OBJECT_PX, MATCH_IOU = 4, 0.10


def confusion_matrix(truth: DataFrame, pred: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts by (keys, truth, pred); truth outside the classes is ignored."""
    spot, keys = ["scene_id", "row", "col"], keys or []
    t = truth.where(F.col("cls").between(0, len(CLASSES) - 1)).withColumnRenamed("cls", "truth")
    return (t.join(by_shuffle(pred.withColumnRenamed("cls", "pred")), spot)
            .groupBy(*keys, "truth", "pred").agg(F.count("*").alias("n")))


def class_iou(cm: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, cls, iou) for all classes; null when a class is in neither mask.

    The matrix has at most 25 rows per key, so one aggregate explodes each cell to the
    classes it counts for.
    """
    keys = keys or []
    every = F.explode(F.sequence(F.lit(0), F.lit(len(CLASSES) - 1)))
    x = cm.select(*keys, "truth", "pred", "n", every.alias("cls"))
    hit = (F.col("truth") == F.col("cls")) & (F.col("pred") == F.col("cls"))
    touch = (F.col("truth") == F.col("cls")) | (F.col("pred") == F.col("cls"))
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    g = x.groupBy(*keys, "cls").agg(total(hit).alias("tp"), total(touch).alias("seen"))
    return g.select(*keys, "cls", F.when(F.col("seen") > 0, F.col("tp") / F.col("seen")).alias("iou"))


def iou_report(cm: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per-class IoU, their mean without nulls, and pixel accuracy; one row per key."""
    keys = keys or []
    part = class_iou(cm, keys)
    ious = part.groupBy(*keys).agg(
        *[F.max(F.when(F.col("cls") == i, F.col("iou"))).alias(f"iou_{n}") for i, n in enumerate(CLASSES)],
        F.avg("iou").alias("miou"))
    acc = cm.groupBy(*keys).agg(
        (F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n"))
        .alias("pixel_accuracy"))
    return ious.join(acc, keys) if keys else ious.crossJoin(acc)  # one row each


def oil_lookalike_confusion(cm: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """How often oil and look-alike swap, as counts and rates."""
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    t, p = F.col("truth"), F.col("pred")
    g = cm.groupBy(*(keys or [])).agg(
        total((t == OIL) & (p == LOOK_ALIKE)).alias("oil_pixels_called_lookalike"),
        total((t == LOOK_ALIKE) & (p == OIL)).alias("lookalike_pixels_called_oil"),
        total(t == OIL).alias("oil"), total(t == LOOK_ALIKE).alias("look"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return g.select(*(keys or []), "oil_pixels_called_lookalike", "lookalike_pixels_called_oil",
                    rate("oil_pixels_called_lookalike", "oil").alias("oil_miss_rate"),
                    rate("lookalike_pixels_called_oil", "look").alias("false_oil_rate"))


def class_pixel_counts(mask: DataFrame, scenes: DataFrame, max_items: int | None = None) -> DataFrame:
    """Pixels per class over all scenes, or the first ``max_items`` of them where that is asked for."""
    first = scenes.select("scene_id")
    if max_items is not None:
        first = first.orderBy("scene_id").limit(max_items)
    return (mask.join(first, "scene_id", "left_semi").groupBy("cls")
            .agg(F.count("*").alias("n")))


# ---------------------------------------------------------------- objects

def objects(mask: DataFrame, cls: int, min_px: int = MIN_OBJECT_PX, tile: int = TILE) -> DataFrame:
    """(scene_id, row, col, label) of the class's regions of at least ``min_px``."""
    lab = label_regions(mask.where(F.col("cls") == cls), tile)
    big = (lab.groupBy("scene_id", "label").agg(F.count("*").alias("n")).where(F.col("n") >= min_px))
    return lab.join(big.select("scene_id", "label"), ["scene_id", "label"], "left_semi")


def pixel_overlap(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """(scene_id, g, p, inter, union_px) for every pair of regions that share a pixel."""
    size = lambda d, k: d.groupBy("scene_id", F.col("label").alias(k)).agg(F.count("*").alias(f"n_{k}"))
    spot = ["scene_id", "row", "col"]
    pairs = (truth.withColumnRenamed("label", "g").join(by_shuffle(pred.withColumnRenamed("label", "p")), spot)
             .groupBy("scene_id", "g", "p").agg(F.count("*").alias("inter")))
    return (pairs.join(size(truth, "g"), ["scene_id", "g"]).join(size(pred, "p"), ["scene_id", "p"])
            .select("scene_id", "g", "p", "inter",
                    (F.col("n_g") + F.col("n_p") - F.col("inter")).alias("union_px")))


def match_instances(overlap: DataFrame, min_iou: float = MATCH_IOU) -> DataFrame:
    """(scene_id, g, p, iou): truths take, in order, the best prediction still free.

    By rounds of proposals, for all scenes at once: every truth proposes to the best prediction that has not turned
    it down, and a prediction keeps the lowest truth and turns the others down for good. When none is
    turned down, each truth holds what it would have got in order. Pairs below the limit never match and are dropped
    first; regions of a mask are disjoint, so at most ten truths are left per prediction.
    """
    left = cut_lineage(overlap.withColumn("iou", F.col("inter") / F.col("union_px"))
                       .where(F.col("iou") >= min_iou).select("scene_id", "g", "p", "iou"))
    while True:
        top = left.groupBy("scene_id", "g").agg(F.max("iou").alias("iou"))
        asked = (left.join(top, ["scene_id", "g", "iou"]).groupBy("scene_id", "g", "iou").agg(F.min("p").alias("p")))
        asked = cut_lineage(asked.select("scene_id", "g", "p", "iou"))
        held = asked.groupBy("scene_id", "p").agg(F.min("g").alias("keeps"))
        refused = cut_lineage(asked.join(held, ["scene_id", "p"]).where("g > keeps").select("scene_id", "g", "p"))
        if refused.isEmpty():
            return asked
        left = cut_lineage(left.join(refused, ["scene_id", "g", "p"], "left_anti"))


def unmatched(truth: DataFrame, pred: DataFrame, matches: DataFrame) -> DataFrame:
    """(scene_id, label, kind): missed truths ('fn') and spurious predictions ('fp')."""
    miss = lambda d, k, kind: (
        d.select("scene_id", "label").distinct()
        .join(matches.select("scene_id", F.col(k).alias("label")), ["scene_id", "label"], "left_anti")
        .withColumn("kind", F.lit(kind)))
    return miss(truth, "g", "fn").union(miss(pred, "p", "fp"))


def object_metrics(truth: DataFrame, pred: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, n_true, n_pred, precision, recall, f1."""
    count = lambda d, n: d.select("scene_id", "label").distinct().agg(F.count("*").alias(n))
    x = (matches.agg(F.count("*").alias("tp")).crossJoin(count(truth, "n_true"))
         .crossJoin(count(pred, "n_pred")))  # one row each
    x = x.withColumns({"fn": F.col("n_true") - F.col("tp"), "fp": F.col("n_pred") - F.col("tp")})
    ratio = lambda a, b: F.when(b > 0, a / b)
    x = x.withColumns({"precision": ratio(F.col("tp"), F.col("n_pred")),
                       "recall": ratio(F.col("tp"), F.col("n_true"))})
    pr = F.col("precision") + F.col("recall")
    return x.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), pr))


# ---------------------------------------------------------------- screen and ranks

def score_histogram(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """(bin, pos, neg): rows with truth 1 and others, by how many thresholds their score reaches.

    One pass for any number of thresholds. Histograms of several runs over the same thresholds merge by adding
    them up.
    """
    marks = F.array(*[F.lit(float(t)) for t in sorted(set(thresholds))])
    reached = F.coalesce(F.size(F.filter(marks, lambda t: F.col("score") >= t)), F.lit(0))
    pos = F.coalesce(F.col("truth") == 1, F.lit(False))
    return scored.groupBy(reached.alias("bin")).agg(F.count_if(pos).alias("pos"), F.count_if(~pos).alias("neg"))


def thresholds_from(histogram: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, recall, precision, screened_out) from one histogram, or several in one table."""
    marks = sorted(set(thresholds))
    # at most one row a threshold and one more, so each row may add to all thresholds that it reaches
    at = F.explode(F.array(*[F.struct(F.lit(k + 1).alias("k"), F.lit(float(t)).alias("threshold")) for k, t in enumerate(marks)]))
    x = histogram.groupBy("bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).withColumn("m", at)
    hit = F.col("bin") >= F.col("m.k")
    of = lambda c: F.sum(F.when(hit, F.col(c)).otherwise(0))
    ratio = lambda a, b: F.when(b > 0, a / b)
    all_ = F.sum(F.col("pos") + F.col("neg"))
    return x.groupBy(F.col("m.threshold").alias("threshold")).agg(
        ratio(of("pos"), F.sum("pos")).alias("recall"), ratio(of("pos"), of("pos") + of("neg")).alias("precision"),
        ((all_ - of("pos") - of("neg")) / all_).alias("screened_out"))


def screen_threshold_table(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, recall, precision, screened_out) of scores against truth 0/1; a null score reaches none."""
    return thresholds_from(score_histogram(scored, thresholds), thresholds)


def case_truth_rank(suspects: DataFrame, truth: DataFrame) -> DataFrame:
    """Rank and share of the known vessel per case; a null rank is a miss."""
    pool = suspects.groupBy("origin_id").agg(F.count("*").alias("n_candidates"))
    hit = suspects.select("origin_id", F.col("mmsi").alias("truth_mmsi"), "rank", "attribution_pct")
    return (truth.select("origin_id", "truth_mmsi")
            .join(hit, ["origin_id", "truth_mmsi"], "left").join(pool, "origin_id", "left")
            .select("origin_id", "truth_mmsi", "rank",
                    F.coalesce("attribution_pct", F.lit(0.0)).alias("attribution_pct"),
                    F.coalesce("n_candidates", F.lit(0)).alias("n_candidates")))


def rank_metrics(cases: DataFrame) -> DataFrame:
    """One row: top1, recall3, mrr, median rank, recalled, total, mean chance rank.

    Shares are over all cases; a miss counts as zero.
    """
    one = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    base = cases.agg(
        one(F.col("rank") == 1).alias("top1"), one(F.col("rank") <= 3).alias("recall3"),
        F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"),
        F.count("rank").alias("recalled"), F.count("*").alias("total"),
        F.avg(F.when(F.col("rank").isNotNull(), (F.col("n_candidates") + 1) / 2)).alias("chance_rank"))
    mid = exact_percentiles(cases.withColumn("all_", F.lit(1)), ["all_"], "rank", {"median_rank": 0.5})
    return base.join(mid.drop("all_"), how="left")  # at most one row on either side


def agreement_rate(suspects: DataFrame, other: DataFrame) -> DataFrame:
    """Share of origins where both sources name the same first vessel.

    Both sources may rest on the same reports, so this is agreement and not accuracy.
    """
    mine = suspects.where(F.col("rank") == 1).select("origin_id", F.col("mmsi").alias("ours"))
    same = F.when(F.col("ours") == F.col("mmsi"), 1.0).otherwise(0.0)
    return (other.join(mine, "origin_id")
            .agg(F.count("*").alias("compared"), F.avg(same).alias("agreement")))


def run_counts(fixes: DataFrame, candidates: DataFrame, origins: DataFrame) -> DataFrame:
    """(origin_id, n_screened, n_candidates) of every origin: vessels looked at and vessels kept."""
    seen = (fixes.select("origin_id", "mmsi").distinct().groupBy("origin_id")
            .agg(F.count("*").alias("n_screened")))
    kept = candidates.groupBy("origin_id").agg(F.count("*").alias("n_candidates"))
    return (origins.select("origin_id").distinct().join(seen, "origin_id", "left").join(kept, "origin_id", "left")
            .select("origin_id", F.coalesce("n_screened", F.lit(0)).alias("n_screened"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates")))
