"""Measuring slicks: shape, contrast, outline and the slick table."""
from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.slicks import (TRANSFORM, estimate_age, oil_likelihood, orientation_to_azimuth,
                                pixel_to_lonlat)
from ..session import by_shuffle, spread, writes_once
from .components import TILE, drop_small_regions, label_regions
from .quantile import exact_percentiles
from .raster import OIL, SEA
from .tiles import groups

# Smallest region (px), sea pixels a reference needs, outline tolerance (px).
MIN_REGION_PX, MIN_SEA_PX, OUTLINE_PX = 60, 50, 1.5

# Length of a border pixel by its neighbour code.
PERIMETER_CODES = {5: 1.0, 7: 1.0, 15: 1.0, 17: 1.0, 25: 1.0, 27: 1.0,
                   21: math.sqrt(2), 33: math.sqrt(2),
                   13: (1 + math.sqrt(2)) / 2, 23: (1 + math.sqrt(2)) / 2}

KEYS = ["scene_id", "label"]
#: Shapes that are sent on at once.
REGIONS_OUT = 1000


def region_measures(labelled: DataFrame, scenes: DataFrame) -> DataFrame:
    """Area, centroid, axes, orientation and elongation from second moments."""
    m = labelled.groupBy(*KEYS).agg(
        F.count("*").alias("area_px"), F.avg("row").alias("row_c"), F.avg("col").alias("col_c"),
        F.var_pop(F.col("row").cast("double")).alias("vr"), F.var_pop(F.col("col").cast("double")).alias("vc"),
        F.covar_pop(F.col("row").cast("double"), F.col("col").cast("double")).alias("cv"))
    # The axis of a symmetric region must not hang on the last bit of its covariance.
    m = m.withColumn("cv", F.when(F.abs("cv") < 1e-9, 0.0).otherwise(F.col("cv")))
    half = (F.col("vr") - F.col("vc")) / 2
    mean, gap = (F.col("vr") + F.col("vc")) / 2, F.sqrt(half * half + F.col("cv") * F.col("cv"))
    m = m.withColumns({"l1": mean + gap, "l2": F.greatest(mean - gap, F.lit(0.0))})
    # A region without a longest axis is given the fixed diagonal one.
    round_one = (F.abs(half) < 1e-9) & (F.col("cv") == 0)
    angle = F.when(round_one, -math.pi / 4).otherwise(0.5 * F.atan2(2 * F.col("cv"), 2 * half))
    px = F.col("pixel_size_m")
    major, minor = 4 * F.sqrt("l1") * px, 4 * F.sqrt("l2") * px
    return (m.join(scenes.select("scene_id", "pixel_size_m"), "scene_id")
            .select(*KEYS, "area_px", (F.col("area_px") * px * px).alias("area_m2"), "row_c", "col_c",
                    major.alias("major_m"), minor.alias("minor_m"),
                    orientation_to_azimuth(angle).alias("azimuth"),
                    F.when(F.col("l1") > 0, F.sqrt(1 - F.col("l2") / F.col("l1"))).otherwise(0.0)
                    .alias("eccentricity"),
                    F.when(minor > 1e-6, major / minor).alias("elongation")))


def border_pixels(labelled: DataFrame) -> DataFrame:
    """Pixels with one of their four neighbours outside the region."""
    across = Window.partitionBy(*KEYS, "row").orderBy("col")
    down = Window.partitionBy(*KEYS, "col").orderBy("row")
    whole = ((F.lag("col").over(across) == F.col("col") - 1) & (F.lead("col").over(across) == F.col("col") + 1)
             & (F.lag("row").over(down) == F.col("row") - 1) & (F.lead("row").over(down) == F.col("row") + 1))
    return (labelled.select(*KEYS, "row", "col").withColumn("whole", F.coalesce(whole, F.lit(False)))
            .where("not whole").drop("whole"))


def region_perimeter(labelled: DataFrame) -> DataFrame:
    """(keys, perimeter_px): weighted length of the border pixels."""
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"),
                               F.lit(1 if r == c == 0 else 2 if r == 0 or c == 0 else 10).alias("w"))
                      for r in (-1, 0, 1) for c in (-1, 0, 1)])
    codes = (border_pixels(labelled).withColumn("s", F.explode(steps))
             .groupBy(*KEYS, (F.col("row") + F.col("s.r")).alias("row"),
                      (F.col("col") + F.col("s.c")).alias("col"))
             .agg(F.sum("s.w").alias("code")))
    length = F.lit(0.0)
    for code, w in PERIMETER_CODES.items():
        length = F.when(F.col("code") == code, w).otherwise(length)
    # Sums over border pixels only: an odd code contains the pixel itself.
    return (codes.where(F.col("code") % 2 == 1).groupBy(*KEYS)
            .agg(F.sum(length).alias("perimeter_px")))


def region_contrast(labelled: DataFrame, pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Mean backscatter per region and dB against the median sea of its scene."""
    spot = ["scene_id", "row", "col"]
    sea = pixels.join(by_shuffle(mask.where(F.col("cls") == SEA)), spot, "left_semi")
    ref = (exact_percentiles(sea, ["scene_id"], "value", {"sea": 0.5})
           .join(sea.groupBy("scene_id").agg(F.count("*").alias("n_sea")), "scene_id")
           .where(F.col("n_sea") > MIN_SEA_PX))
    mean = (labelled.join(by_shuffle(pixels), spot).groupBy(*KEYS)
            .agg(F.avg("value").alias("mean_backscatter")))
    ok = (F.col("sea") > 1e-6) & (F.col("mean_backscatter") > 1e-6)
    return (mean.join(ref, "scene_id", "left")
            .select(*KEYS, "mean_backscatter",
                    F.when(ok, 10 * F.log10(F.col("mean_backscatter") / F.col("sea"))).alias("contrast_db")))


def region_confidence(labelled: DataFrame, prob: DataFrame, target: int = OIL) -> DataFrame:
    return (labelled.join(by_shuffle(prob.where(F.col("cls") == target)), ["scene_id", "row", "col"])
            .groupBy(*KEYS).agg(F.avg("p").alias("confidence")))


# ---------------------------------------------------------------- hull and outline

def region_runs(labelled: DataFrame) -> DataFrame:
    """(keys, row, c0, c1): maximal runs of pixels; a region shrinks to its border's size."""
    w = Window.partitionBy(*KEYS, "row").orderBy("col")
    return (labelled.select(*KEYS, "row", "col")
            .withColumn("island", F.col("col") - F.row_number().over(w))
            .groupBy(*KEYS, "row", "island")
            .agg(F.min("col").alias("c0"), F.max("col").alias("c1")).drop("island"))


def _hull(points: np.ndarray) -> np.ndarray:
    p = points[np.lexsort((points[:, 1], points[:, 0]))]

    def chain(seq):
        out = []
        for q in seq:
            while len(out) > 1 and ((out[-1][0] - out[-2][0]) * (q[1] - out[-2][1])
                                    - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0])) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def hull_pixels(row, c0, c1) -> int:
    """Pixel centres inside the convex hull of the pixels' edge midpoints."""
    row, c0, c1 = (np.asarray(x, float) for x in (row, c0, c1))
    ends = [(row, c0 - 0.5), (row, c1 + 0.5)]
    ends += [(row + d, c) for d in (-0.5, 0.5) for c in (c0, c1)]
    h = _hull(np.concatenate([np.stack(e, 1) for e in ends]))
    a, b = h, np.roll(h, -1, axis=0)
    total = 0
    for r in range(int(row.min()), int(row.max()) + 1):
        hit = (np.minimum(a[:, 0], b[:, 0]) <= r) & (np.maximum(a[:, 0], b[:, 0]) >= r) & (a[:, 0] != b[:, 0])
        f = (r - a[hit, 0]) / (b[hit, 0] - a[hit, 0])
        x = a[hit, 1] + f * (b[hit, 1] - a[hit, 1])
        total += int(math.floor(x.max() + 1e-9) - math.ceil(x.min() - 1e-9)) + 1
    return total


def contour(row, c0, c1, height: int, width: int) -> list[tuple[float, float]]:
    """Longest line between region and rest, through the midpoints of the pixel sides.

    Sides on the scene's edge have nothing beyond them, so a line may end there. Pixels
    that touch at a corner only are kept apart.
    """
    runs: dict[int, list[tuple[int, int]]] = {}
    for r, a, b in sorted(zip(map(int, row), map(int, c0), map(int, c1))):
        runs.setdefault(r, []).append((a, b))

    def inside(r, c):
        line = runs.get(r)
        k = bisect_right(line, (c, math.inf)) - 1 if line else -1
        return k >= 0 and line[k][1] >= c

    def free(r, a, b):
        """Columns of [a, b] not covered by row r."""
        for x, y in runs.get(r, []):
            if y < a or x > b:
                continue
            yield from range(a, min(x, b + 1))
            a = y + 1
        yield from range(a, b + 1)

    on_map = lambda r, c: 0 <= r < height and 0 <= c < width
    sides = set()
    for r, line in runs.items():
        for a, b in line:
            sides.add((r, a, 0, -1))
            sides.add((r, b, 0, 1))
            for d in (-1, 1):
                sides.update((r, c, d, 0) for c in free(r + d, a, b))
    sides = {s for s in sides if on_map(s[0] + s[2], s[1] + s[3])}

    def ahead(s):
        """The side that follows with the region on the same hand; None at the edge."""
        r, c, dr, dc = s
        ar, ac = dc, -dr
        if not (on_map(r + ar, c + ac) and on_map(r + dr + ar, c + dc + ac)):
            return None
        if not inside(r + ar, c + ac):
            return (r, c, ar, ac)
        if inside(r + dr + ar, c + dc + ac):
            return (r + dr + ar, c + dc + ac, -ar, -ac)
        return (r + ar, c + ac, dr, dc)

    follow = {s: ahead(s) for s in sides}
    led = set(follow.values())
    best: list = []
    starts = sorted(s for s in sides if s not in led) + sorted(sides)
    done: set = set()
    for s in starts:
        if s in done:
            continue
        line, x = [], s
        while x is not None and x not in done:
            done.add(x)
            line.append(x)
            x = follow[x]
        if x == s:
            line.append(s)
        if len(line) > len(best):
            best = line
    return [(r + dr / 2, c + dc / 2) for r, c, dr, dc in best]


def simplify(line: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Douglas-Peucker: keep the points that leave a chord by more than the tolerance."""
    if len(line) <= 4 or tolerance <= 0:
        return line
    p = np.array(line)
    keep = np.zeros(len(p), bool)
    keep[[0, -1]] = True
    stack = [(0, len(p) - 1)]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        q, d = p[i + 1:j] - p[i], p[j] - p[i]
        n = float(d @ d)
        s = np.clip(q @ d / n, 0, 1) if n > 0 else np.zeros(len(q))
        far = np.hypot(*(q - s[:, None] * d).T)
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[i + 1 + k] = True
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return [tuple(x) for x in p[keep]]


def region_shapes(labelled: DataFrame, scenes: DataFrame, tolerance: float = OUTLINE_PX) -> DataFrame:
    """(keys, hull_px, outline): convex-hull size and simplified outline of each region."""
    schema = ("scene_id long, label long, hull_px long, "
              "outline array<struct<row:double,col:double>>")
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("row", pa.float64()), ("col", pa.float64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        out = lambda: pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*held), kinds)],
                                                 ["scene_id", "label", "hull_px", "outline"])
        for key, parts in groups(batches, 2):
            row, c0, c1 = (np.concatenate([p.column(k).to_numpy() for p in parts]) for k in (2, 3, 4))
            line = contour(row, c0, c1, *(parts[0].column(k)[0].as_py() for k in (5, 6)))
            pts = [{"row": round(r, 2), "col": round(c, 2)} for r, c in simplify(line, tolerance)]
            held.append((*(None if k is None else int(k) for k in key), hull_pixels(row, c0, c1), pts))
            if len(held) >= REGIONS_OUT:
                yield out()
                held.clear()
        if held:
            yield out()

    runs = region_runs(labelled).join(scenes.select("scene_id", "height", "width"), "scene_id")
    return (spread(runs.select(*KEYS, "row", "c0", "c1", F.col("height").cast("int"), F.col("width").cast("int")), *KEYS)
            .sortWithinPartitions(*KEYS).mapInArrow(run, schema))


# ---------------------------------------------------------------- slicks

@writes_once
def find_regions(mask: DataFrame, target: int = OIL, min_px: int = MIN_REGION_PX,
                 tile: int = TILE) -> DataFrame:
    """Labelled pixels of the cleaned target class, written once for the measures."""
    return label_regions(drop_small_regions(mask, target, min_px, tile), tile)


def characterize(mask: DataFrame, scenes: DataFrame, pixels: DataFrame | None = None,
                 prob: DataFrame | None = None, target: int = OIL, min_px: int = MIN_REGION_PX,
                 labelled: DataFrame | None = None) -> DataFrame:
    """One row per slick with everything measured about it, largest first within a scene.

    ``scenes`` has (scene_id, height, width, pixel_size_m), optionally ``wind`` and the six
    transform columns. ``labelled`` skips the search when it was done before.
    """
    lab = labelled if labelled is not None else find_regions(mask, target, min_px)
    out = (region_measures(lab, scenes).join(region_perimeter(lab), KEYS)
           .join(region_shapes(lab, scenes), KEYS))
    none = F.lit(None).cast("double")
    if pixels is not None:
        out = out.join(region_contrast(lab, pixels, mask), KEYS, "left")
    else:
        out = out.withColumns({"mean_backscatter": none, "contrast_db": none})
    out = (out.join(region_confidence(lab, prob, target), KEYS, "left") if prob is not None
           else out.withColumn("confidence", none))
    geo = all(c in scenes.columns for c in TRANSFORM)
    extra = [c for c in ("wind", *TRANSFORM) if c in scenes.columns]
    out = out.join(scenes.select("scene_id", "pixel_size_m", *extra), "scene_id")
    wind = F.col("wind") if "wind" in extra else none

    elong = F.coalesce("elongation", F.lit(1.0))
    solidity = F.col("area_px") / F.col("hull_px")
    perim = F.col("perimeter_px") * F.col("pixel_size_m")
    out = out.withColumns({
        "age": estimate_age("area_m2", elong, wind),
        "second": oil_likelihood(elong, solidity, F.coalesce("contrast_db", F.lit(-2.0)),
                                 F.coalesce("confidence", F.lit(0.5))),
        "solidity": solidity, "perimeter_m": perim,
        "compactness": F.when(perim > 0, 4 * math.pi * F.col("area_m2") / (perim * perim)).otherwise(0.0)})
    # Regions of one scene only: few rows per window.
    by_place = Window.partitionBy("scene_id").orderBy("label")
    by_area = Window.partitionBy("scene_id").orderBy(F.desc("area_px"), "label")
    lonlat = (pixel_to_lonlat("row_c", "col_c") if geo else (none, none))
    poly = F.transform("outline", lambda p: F.struct(
        *[v.alias(n) for v, n in zip(pixel_to_lonlat(p["row"], p["col"]), ("lon", "lat"))])) if geo else \
        F.lit(None).cast("array<struct<lon:double,lat:double>>")
    r = F.round
    return out.select(
        "scene_id", F.row_number().over(by_place).alias("slick_no"),
        F.row_number().over(by_area).alias("size_rank"), "area_px", r("area_m2", 1).alias("area_m2"),
        r(F.col("area_m2") / 1e6, 4).alias("area_km2"), r("perimeter_m", 1).alias("perimeter_m"),
        r("row_c", 2).alias("row_c"), r("col_c", 2).alias("col_c"),
        lonlat[0].alias("lon"), lonlat[1].alias("lat"), F.col("outline").alias("polygon_px"),
        poly.alias("polygon"), r("azimuth", 1).alias("orientation_deg"),
        r("major_m", 1).alias("major_axis_m"), r("minor_m", 1).alias("minor_axis_m"),
        F.coalesce(r("elongation", 2), F.lit(-1.0)).alias("elongation"),
        r("eccentricity", 3).alias("eccentricity"), r("solidity", 3).alias("solidity"),
        r("compactness", 3).alias("compactness"),
        F.coalesce(r("mean_backscatter", 4), F.lit(-1.0)).alias("mean_backscatter"),
        r("contrast_db", 2).alias("contrast_db"),
        F.coalesce(r("confidence", 3), F.lit(-1.0)).alias("confidence"),
        F.col("age.hours").alias("age_h"), F.col("age.lo").alias("age_lo_h"),
        F.col("age.hi").alias("age_hi_h"), F.col("age.confidence").alias("age_confidence"),
        F.col("age.saturated").alias("age_saturated"), F.col("age.basis").alias("age_basis"),
        F.col("second.verdict").alias("oil_likelihood"), F.col("second.notes").alias("notes"))


def slicks_by_area(slicks: DataFrame) -> DataFrame:
    return slicks.orderBy("scene_id", "size_rank")


def pick_slick(slicks: DataFrame, wanted: int = 1) -> DataFrame:
    """The slick with the wanted number, else the largest, per scene."""
    w = Window.partitionBy("scene_id").orderBy(F.desc(F.col("slick_no") == wanted), "size_rank")
    return slicks.withColumn("pick_", F.row_number().over(w)).where("pick_ = 1").drop("pick_")


def slicks_to_geojson(slicks: DataFrame) -> DataFrame:
    """(scene_id, slick_no, feature): one GeoJSON point feature per slick.

    Without a transform the coordinates are pixels, and the feature says so.
    """
    geo = F.col("lon").isNotNull()
    point = F.array(F.when(geo, F.col("lon")).otherwise(F.col("col_c")),
                    F.when(geo, F.col("lat")).otherwise(F.col("row_c")))
    props = F.struct(*[F.col(c) for c in slicks.columns if c != "scene_id"],
                     F.when(geo, "geographic").otherwise("pixel").alias("coordinate_space"))
    return slicks.select("scene_id", "slick_no", F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), point.alias("coordinates")).alias("geometry"),
        props.alias("properties"))).alias("feature"))


def feature_collections(features: DataFrame) -> DataFrame:
    """One FeatureCollection text per scene; a scene holds few slicks."""
    return features.groupBy("scene_id").agg(F.concat(
        F.lit('{"type":"FeatureCollection","features":['),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slick_no", "feature"))),
                                 lambda x: x["feature"]), ","), F.lit("]}")).alias("geojson"))
