"""Connected pixels: tiles are labelled side by side and joined along their borders."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import by_shuffle, cut_lineage, spread
from .tiles import groups

#: A pixel's number is row * WIDE + col, so numbers follow raster order.
WIDE = 1 << 24
TILE = 256
#: Labelled pixels that are sent on at once.
PIXELS_OUT = 1 << 17


def _label_tile(row: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pixels of one tile in order, and the number of the first pixel of the 8-connected piece of each."""
    order = np.lexsort((column, row))
    row, column = row[order], column[order]
    r, c = row - row.min() + 1, column - column.min() + 1
    spot = np.full((r.max() + 2, c.max() + 2), -1, np.int64)
    spot[r, c] = np.arange(len(r))
    pairs = []
    for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1)):
        other = spot[r + dr, c + dc]
        mine = np.flatnonzero(other >= 0)
        pairs.append(np.stack([mine, other[mine]]))
    a, b = np.concatenate(pairs, axis=1)
    root = np.arange(len(r))
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            break
        # Hook the later root of every touching pair to the earlier, then flatten.
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    first = row * WIDE + column
    return row, column, first[root]


def _label_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_label_tile`` for each tile of rows (scene_id, tr, tc, row, col) that stand together."""
    def batch(held):
        ids = pa.array([scene for scene, *_ in held], pa.int64()).take(pa.array(np.repeat(np.arange(len(held)), [len(x[1]) for x in held])))
        return pa.RecordBatch.from_arrays([ids, *(pa.array(np.concatenate(x)) for x in list(zip(*held))[1:])], ["scene_id", "row", "col", "label"])

    held, size = [], 0
    for (scene, *_), parts in groups(batches, 3):
        row, column = (np.concatenate([p.column(k).to_numpy() for p in parts]) for k in (3, 4))
        held.append((None if scene is None else int(scene), *_label_tile(row, column)))
        size += len(row)
        if size >= PIXELS_OUT:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


def merge_labels(pairs: DataFrame) -> DataFrame:
    """(scene_id, label, root) for labels that touch: root is the smallest of the set.

    Every label hooks to its smallest neighbour and the links are flattened; the pairs
    are then rewritten and the round repeats until no pair is left.
    """
    key = ["scene_id"]
    edges = cut_lineage(pairs.select(*key, "a", "b").where("a <> b").distinct())
    roots = cut_lineage(edges.select(*key, F.col("a").alias("label"))
                        .union(edges.select(*key, F.col("b").alias("label"))).distinct()
                        .withColumn("root", F.col("label")))
    while not edges.isEmpty():
        both = edges.union(edges.select(*key, F.col("b").alias("a"), F.col("a").alias("b")))
        up = cut_lineage(both.groupBy(*key, "a").agg(F.min("b").alias("p")).where("p < a"))
        while True:
            above = up.select(*key, F.col("a").alias("p"), F.col("p").alias("pp"))
            longer = up.join(above, [*key, "p"])
            if longer.isEmpty():
                break
            up = cut_lineage(up.join(above, [*key, "p"], "left")
                             .select(*key, "a", F.coalesce("pp", "p").alias("p")))
        link = lambda c: up.select(*key, F.col("a").alias(c), F.col("p").alias(f"{c}_up"))
        roots = cut_lineage(roots.join(link("root"), [*key, "root"], "left")
                            .select(*key, "label", F.coalesce("root_up", "root").alias("root")))
        edges = cut_lineage(
            edges.join(link("a"), [*key, "a"], "left").join(link("b"), [*key, "b"], "left")
            .select(*key, F.coalesce("a_up", "a").alias("a"), F.coalesce("b_up", "b").alias("b"))
            .where("a <> b").distinct())
    return roots


def label_regions(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """(scene_id, row, col, label): 8-connected regions, named by their first pixel.

    Pixels are shuffled once, by tile; a large scene is many tiles, so no task holds a
    scene or a region. Only labels that meet at a tile border go through rounds.
    """
    keyed = pixels.select("scene_id", F.col("row").cast("long").alias("row"),
                          F.col("col").cast("long").alias("col"))
    keyed = keyed.withColumns({"tr": F.floor(F.col("row") / tile), "tc": F.floor(F.col("col") / tile)})
    schema = "scene_id long, row long, col long, label long"
    # Pixels take few bytes for the work they make: their size must not gather them in a few tasks.
    local = cut_lineage(
        spread(keyed.select(F.col("scene_id").cast("long"), "tr", "tc", "row", "col"), "scene_id", "tr", "tc")
        .sortWithinPartitions("scene_id", "tr", "tc").mapInArrow(_label_tiles, schema))

    rim = local.where((F.col("row") % tile).isin(0, tile - 1) | (F.col("col") % tile).isin(0, tile - 1))
    steps = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"))
                      for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1))])
    ahead = (rim.withColumn("s", F.explode(steps))
             .select("scene_id", F.col("label").alias("a"), (F.col("row") + F.col("s.dr")).alias("row"),
                     (F.col("col") + F.col("s.dc")).alias("col")))
    pairs = (ahead.join(by_shuffle(rim), ["scene_id", "row", "col"])
             .select("scene_id", "a", F.col("label").alias("b")).where("a <> b"))
    roots = merge_labels(pairs)
    return (local.join(roots, ["scene_id", "label"], "left")
            .select("scene_id", "row", "col", F.coalesce("root", "label").alias("label")))


def _sized(labelled: DataFrame, min_px: int, small: bool) -> DataFrame:
    n = labelled.groupBy("scene_id", "label").agg(F.count("*").alias("n"))
    n = n.where(F.col("n") < min_px) if small else n.where(F.col("n") >= min_px)
    return labelled.join(n.select("scene_id", "label"), ["scene_id", "label"], "left_semi")


def drop_small_regions(mask: DataFrame, target: int = 1, min_px: int = 60,
                       tile: int = TILE) -> DataFrame:
    """Pixels of the target class after losing small regions and gaining small holes."""
    spot = ["scene_id", "row", "col"]
    hit = mask.where(F.col("cls") == target)
    kept = cut_lineage(_sized(label_regions(hit, tile), min_px, small=False).select(*spot))
    every = mask.select(F.col("scene_id").cast("long").alias("scene_id"),
                        F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))
    # Scenes without anything left have no holes to fill.
    live = kept.select("scene_id").distinct()
    back = every.join(live, "scene_id", "left_semi").join(by_shuffle(kept), spot, "left_anti")
    holes = _sized(label_regions(back, tile), min_px, small=True).select(*spot)
    return kept.union(holes)
