"""Radar scenes as pixel tables (scene_id, row, col, ...): filters, tiles, decoding."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.draws import uniform
from ..functions.geo import clamp, col
from ..session import cut_lineage
from .quantile import exact_percentiles
from .tiles import BLOCK, blend, block_map, box_moments, cut_tiles, lists, to_blocks, to_pixels

# Classes in index order, their colours, and the colour tolerance.
CLASSES = ["sea", "oil_spill", "look_alike", "ship", "land"]
PALETTE = [(0, 0, 0), (0, 255, 255), (255, 0, 0), (153, 76, 0), (0, 153, 0)]
SEA, OIL, LOOK_ALIKE, SHIP, LAND = range(5)
COLOUR_TOLERANCE = 60

# Smallest amplitude, dB floor, filter size, speckle coefficient, stretch
# percentiles, tile, overlap, weight floor.
EPS, FLOOR_DB = 1e-8, -50.0
LEE_SIZE, LEE_CU = 5, 0.523
STRETCH = (0.02, 0.98)
TILE, OVERLAP, WEIGHT_FLOOR = 256, 64, 1e-3

#: Tiles a model gets in one call.
MODEL_BATCH = 8


def to_db(amplitude, floor_db: float = FLOOR_DB) -> Column:
    return F.greatest(10.0 * F.log10(F.greatest(col(amplitude), F.lit(EPS))), F.lit(float(floor_db)))


def grey_from_rgb(r="r", g="g", b="b") -> Column:
    return (col(r) + col(g) + col(b)) / 3.0


def decode_mask(rgb: DataFrame) -> DataFrame:
    """Nearest palette colour; colours far from all of them are sea."""
    d = lambda p: sum(((F.col(c) - v) * (F.col(c) - v) for c, v in zip("rgb", p)), F.lit(0))
    best = F.array_min(F.array(*[F.struct(d(p).alias("d"), F.lit(i).alias("cls"))
                                 for i, p in enumerate(PALETTE)]))
    far = best["d"] > 3 * COLOUR_TOLERANCE ** 2
    return rgb.select("scene_id", "row", "col", F.when(far, SEA).otherwise(best["cls"]).alias("cls"))


def _lee_work(size: int, cu: float) -> Callable:
    def work(r0, c0, grid, core):
        found = box_moments(r0, c0, grid, core, size)
        if found is None:
            return None
        row, column, value, m, q = found
        ci2 = np.maximum(q - m * m, 0.0) / np.maximum(m * m, EPS)
        weight = np.clip((ci2 - cu * cu) / np.maximum(ci2, EPS), 0.0, 1.0)
        return row, column, (m + weight * (value - m))[None]
    return work


def lee_blocks(px: DataFrame, size: int = LEE_SIZE, cu: float = LEE_CU, block: int = BLOCK) -> DataFrame:
    """The filtered scenes as blocks: one shuffle, in which pixels near a border go to both sides."""
    return block_map(px, _lee_work(size, cu), block, halo=size // 2)


def lee_filter(px: DataFrame, size: int = LEE_SIZE, cu: float = LEE_CU, block: int = BLOCK) -> DataFrame:
    """Speckle filter on (scene_id, row, col, value): smooth where the scene is even."""
    return to_pixels(lee_blocks(px, size, cu, block))


def percentile_stretch(px: DataFrame, low: float = STRETCH[0], high: float = STRETCH[1]) -> DataFrame:
    """Clip to percentiles of each scene and scale to [0, 1]; a flat scene is 0."""
    p = exact_percentiles(px, ["scene_id"], "value", {"lo_": low, "hi_": high})
    return px.join(p, "scene_id").withColumn("value", _stretched(F.col("value"))).drop("lo_", "hi_")


def _stretched(value: Column) -> Column:
    span = F.col("hi_") - F.col("lo_")
    return F.when(span < EPS, 0.0).otherwise(clamp((value - F.col("lo_")) / span, 0, 1))


def preprocess(px: DataFrame, already_db: bool = True, despeckle: bool = True,
               size: int = LEE_SIZE, block: int = BLOCK) -> DataFrame:
    """(dB) -> despeckle -> stretch. The filtered blocks are written once, for the percentiles and the stretch."""
    if not already_db:
        px = px.withColumn("value", to_db("value"))
    if not despeckle:
        return percentile_stretch(px)
    blocks = cut_lineage(lee_blocks(px, size, block=block))
    p = exact_percentiles(to_pixels(blocks), ["scene_id"], "value", {"lo_": STRETCH[0], "hi_": STRETCH[1]})
    stretch = lambda x: F.when(F.isnan(x), x).otherwise(_stretched(x))
    return to_pixels(blocks.join(p, "scene_id").withColumn("v", F.transform("v", stretch)).drop("lo_", "hi_"))


# ---------------------------------------------------------------- tiles

def blend_tiles(tiles: DataFrame, block: int = BLOCK) -> DataFrame:
    """Weighted mean of overlapping tiles: (scene_id, row, col, cls, p).

    ``tiles`` has (scene_id, ty, tx, tile, v), v by class, row and column as from ``cut_tiles``.
    """
    return to_pixels(blend(tiles, WEIGHT_FLOOR, block), "p", "cls")


def argmax_class(prob: DataFrame) -> DataFrame:
    """Class of the largest probability; the lower class on a tie."""
    each = [f"p{k}" for k in range(len(CLASSES))]
    x = prob.groupBy("scene_id", "row", "col").agg(*[
        F.max(F.when(F.col("cls") == k, F.col("p"))).alias(n) for k, n in enumerate(each)])
    p = F.array(*[F.col(n) for n in each])
    return x.select("scene_id", "row", "col", (F.array_position(p, F.array_max(p)) - 1).cast("int").alias("cls"))


def score_tiles(px: DataFrame, scenes: DataFrame, load_model: Callable[[], Callable],
                tile: int = TILE, overlap: int = OVERLAP, batch: int = MODEL_BATCH, block: int = BLOCK) -> DataFrame:
    """Probabilities (scene_id, row, col, cls, p) from a user's model on overlapping tiles.

    ``load_model()`` runs once per task and returns a function from a batch of tiles (n, t, t) to logits
    (n, 5, t, t); it gets up to ``batch`` tiles of one size in a call. A tile is one row, so no task holds a scene.
    A pixel that is not there is 0 to the model and has no probability.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model()

        def scored(tiles: list[np.ndarray], t: int) -> list[np.ndarray]:
            x = np.stack(tiles).reshape(-1, t, t)
            gone = np.isnan(x)
            z = np.asarray(model(np.where(gone, 0.0, x).astype(np.float32)), float)
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            return list(np.where(gone[:, None], np.nan, z).reshape(len(x), -1))

        for b in batches:
            sides, tiles = b.column(3).to_pylist(), lists(b.column(4))
            out: list = [None] * len(tiles)
            for t in sorted(set(sides)):
                these = [k for k, s in enumerate(sides) if s == t]
                for j in range(0, len(these), batch):
                    part = these[j:j + batch]
                    for k, p in zip(part, scored([tiles[k] for k in part], t)):
                        out[k] = p
            if out:
                ends = np.cumsum([0, *map(len, out)])
                v = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out)))
                yield pa.RecordBatch.from_arrays([*b.columns[:4], v], b.schema.names)

    tiles = cut_tiles(to_blocks(px, block), scenes, tile, overlap)
    return blend_tiles(tiles.mapInArrow(run, tiles.schema), block)


def screen_scenes(px: DataFrame, load_model: Callable[[], Callable], side: int = 224) -> DataFrame:
    """(scene_id, score) from a user's yes/no model on a thumbnail of each scene.

    The scene is averaged down to at most ``side`` x ``side`` before it reaches the model.
    """
    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        model = load_model()
        for b in batches:
            yield pd.Series([float(model(np.asarray(v, float).reshape(int(h), int(w))))
                             for v, h, w in zip(b["v"], b["h"], b["w"])])

    size = px.groupBy("scene_id").agg((F.max("row") + 1).alias("hh"), (F.max("col") + 1).alias("ww"))
    h, w = (F.least(F.lit(side), F.col(c)).cast("int") for c in ("hh", "ww"))
    small = (px.join(size, "scene_id").withColumns({"h": h, "w": w})
             .groupBy("scene_id", "h", "w", F.floor(F.col("row") * F.col("h") / F.col("hh")).alias("r"),
                      F.floor(F.col("col") * F.col("w") / F.col("ww")).alias("c"))
             .agg(F.avg("value").alias("value")))
    packed = small.groupBy("scene_id", "h", "w").agg(
        F.array_sort(F.collect_list(F.struct("r", "c", "value"))).alias("t"))
    return packed.select("scene_id", run(F.struct(F.col("t.value").alias("v"), "h", "w")).alias("score"))


def screen_gate(scored: DataFrame, threshold: float = 0.10) -> DataFrame:
    return scored.where(F.col("score") >= threshold)


# ---------------------------------------------------------------- training views

def augment_flip_rot(px: DataFrame, scenes: DataFrame, seed: int = 0) -> DataFrame:
    """Flip and turn each scene as a draw on its id says; values are untouched."""
    sid, zero = F.col("scene_id").cast("long"), F.lit(seed).cast("long")
    s = scenes.select("scene_id", "height", "width",
                      (uniform(sid, zero, 0, 11) < 0.5).alias("fx"),
                      (uniform(sid, zero, 0, 12) < 0.5).alias("fy"),
                      F.floor(uniform(sid, zero, 0, 13) * 4).alias("k"))
    r0, c0, h, w = F.col("row"), F.col("col"), F.col("height"), F.col("width")
    c = F.when(F.col("fx"), w - 1 - c0).otherwise(c0)
    r = F.when(F.col("fy"), h - 1 - r0).otherwise(r0)
    k = F.col("k")
    row = F.when(k == 0, r).when(k == 1, w - 1 - c).when(k == 2, h - 1 - r).otherwise(c)
    column = F.when(k == 0, c).when(k == 1, r).when(k == 2, w - 1 - c).otherwise(h - 1 - r)
    rest = [x for x in px.columns if x not in ("scene_id", "row", "col")]
    return px.join(s, "scene_id").select("scene_id", row.alias("row"), column.alias("col"), *rest)


def resize_scene(px: DataFrame, scenes: DataFrame, size: int, labels: bool = False) -> DataFrame:
    """Scenes resampled to ``size`` x ``size``: bilinear, or nearest for ``labels``.

    A pixel finds the new cells it counts in from its own place, one axis after the other, so pixels are not joined
    with cells: they meet the row of their scene only, and their shares of a cell are added up.
    """
    value = "cls" if labels else "value"

    def cells(x: DataFrame, axis: str, extent: str, cell: str) -> DataFrame:
        """``x`` for each cell of an axis that may hold its pixel."""
        scale = size / F.col(extent)
        ends = ((F.floor(F.col(axis) * scale), F.ceil((F.col(axis) + 1) * scale)) if labels else
                (F.floor((F.col(axis) - 0.5) * scale - 0.5), F.ceil((F.col(axis) + 1.5) * scale - 0.5)))
        return x.withColumn(cell, F.explode(F.sequence(F.greatest(ends[0], F.lit(0)).cast("int"),
                                                       F.least(ends[1], F.lit(size - 1)).cast("int"))))

    x = (px.join(scenes.select("scene_id", "height", "width"), "scene_id")
         .where(F.col("row").between(0, F.col("height") - 1) & F.col("col").between(0, F.col("width") - 1)))
    if labels:
        near = lambda i, n: F.least(F.floor(F.col(i) * F.col(n) / size), F.col(n) - 1)
        for axis, n, i in (("row", "height", "r"), ("col", "width", "c")):
            x = cells(x, axis, n, i).where(near(i, n) == F.col(axis))
        return x.select("scene_id", F.col("r").alias("row"), F.col("c").alias("col"), value)
    for axis, n, i, w in (("row", "height", "r", "wr_"), ("col", "width", "c", "wc_")):
        p = clamp((F.col(i) + 0.5) * F.col(n) / size - 0.5, 0.0, F.col(n) - 1.0)
        share = F.when(F.floor(p) == F.col(axis), 1 - (p - F.floor(p))).when(F.floor(p) + 1 == F.col(axis), p - F.floor(p))
        x = cells(x, axis, n, i).withColumn(w, share).where(F.col(w) > 0)
    return (x.groupBy("scene_id", "r", "c").agg(F.sum(F.col("wr_") * F.col("wc_") * F.col(value)).alias(value))
            .select("scene_id", F.col("r").alias("row"), F.col("c").alias("col"), value))


def class_palette(counts: DataFrame) -> DataFrame:
    """Class rows with name and #rrggbb next to a table keyed by ``cls``."""
    rows = F.array(*[F.struct(F.lit(i).alias("cls"), F.lit(n).alias("name"),
                              F.format_string("#%02x%02x%02x", *[F.lit(v) for v in p]).alias("color"))
                     for i, (n, p) in enumerate(zip(CLASSES, PALETTE))])
    c = F.get(rows, F.col("cls"))
    return counts.withColumns({"name": c["name"], "color": c["color"]})
