"""Scenes as blocks: rows of (scene_id, r0, c0, h, w, v) with a rectangle of pixels in one array.

``v`` holds channel after channel, each row by row; NaN is a pixel that is not there. Pixels are put together
in one shuffle by block, and what an operator needs from beyond its block (a halo, an overlapping tile) travels as
pieces of blocks, not as pixels. A block is bounded by its side, so no task holds a scene. Work on a
block is NumPy over Arrow buffers.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

BLOCK = 256
#: Values that are sent to Spark at once.
BATCH_VALUES = 1 << 20
#: Pixels that are put together by block before they are shuffled.
PACKED = 1 << 17
RECT = ["r0", "c0", "h", "w"]
RECT_SQL = "r0 int, c0 int, h int, w int, v array<double>"


def _scene_sql(df: DataFrame) -> str:
    return f"scene_id {dict(df.dtypes)['scene_id']}"


def _scene_arrow(df: DataFrame) -> pa.DataType:
    return to_arrow_type(df.schema["scene_id"].dataType)


def groups(batches: Iterator[pa.RecordBatch], n_keys: int):
    """(keys, slices of batches) of each stretch of rows that agree in the first columns, nulls too, over batch borders."""
    at, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [np.array(c.to_pylist(), object) if c.null_count else c.to_numpy(zero_copy_only=False) for c in batch.columns[:n_keys]]
        new = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            new |= k[1:] != k[:-1]
        cuts = np.r_[0, np.flatnonzero(new) + 1, batch.num_rows].tolist()
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(k[a] for k in keys)
            if key != at:
                if parts:
                    yield at, parts
                at, parts = key, []
            parts.append(batch.slice(a, b - a))
    if parts:
        yield at, parts


def lists(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column as views; an empty list for null."""
    at, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _rows_out(rows: Iterator[tuple], kinds: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size from (fields ..., array)."""
    held, size = [], 0

    def batch():
        *fields, arrays = zip(*held)
        ends = np.cumsum([0, *map(len, arrays)])
        packed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays)))
        return pa.RecordBatch.from_arrays([*(pa.array(f, k) for f, k in zip(fields, kinds)), packed], names)

    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= BATCH_VALUES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _by_block(px: DataFrame, block: int, halo: int, cols: list[str]) -> DataFrame:
    """Pixels in lists, next to each other by block, each in all blocks whose rectangle and halo hold it."""
    def near(axis: str) -> Column:
        first, last = (F.floor((F.col(axis) + d) / block).cast("int") for d in (-halo, halo))
        return F.explode(F.sequence(F.greatest(first, F.lit(0)), last)) if halo else last

    x = px.withColumn("br_", near("row")).withColumn("bc_", near("col"))
    x = x.select("scene_id", "br_", "bc_", F.col("row").cast("int"), F.col("col").cast("int"), *cols)
    made = ", ".join(f"{f.name} {f.dataType.simpleString()}" if k < 3 else f"{f.name} array<{f.dataType.simpleString()}>"
                     for k, f in enumerate(x.schema.fields))
    return x.mapInArrow(_packed, made).repartition("scene_id", "br_", "bc_").sortWithinPartitions("scene_id", "br_", "bc_")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pixels with those of the same block among the next in one row: what is next to each other is not shuffled apart."""
    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        x = pa.Table.from_batches(held).combine_chunks()
        keys = [x.column(0).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(), *(x.column(k).to_numpy() for k in (1, 2))]
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(order) - 1, bool)
        for k in keys:
            new |= k[order][1:] != k[order][:-1]
        starts = np.r_[0, np.flatnonzero(new) + 1]
        ends, first = pa.array(np.r_[starts, len(order)], pa.int32()), pa.array(order[starts])
        chunk = lambda k, at: x.column(k).take(at).combine_chunks()
        return pa.RecordBatch.from_arrays([*(chunk(k, first) for k in range(3)), *(
            pa.ListArray.from_arrays(ends, chunk(k, pa.array(order))) for k in range(3, x.num_columns))], x.column_names)

    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size >= PACKED:
            yield pack(held)
            held, size = [], 0
    if held:
        yield pack(held)


def _grid(parts: list[pa.RecordBatch], channels: int) -> tuple[int, int, np.ndarray]:
    """First row and column of the pixels of a block, and their values by channel, row and column."""
    take = lambda k: np.concatenate([p.column(k).flatten().to_numpy(zero_copy_only=False) for p in parts])
    row, col, value = take(3), take(4), take(5)
    r0, c0 = int(row.min()), int(col.min())
    out = np.full((channels, int(row.max()) - r0 + 1, int(col.max()) - c0 + 1), np.nan)
    out[take(6) if channels > 1 else 0, row - r0, col - c0] = value
    return r0, c0, out


def block_map(px: DataFrame, work: Callable, block: int = BLOCK, halo: int = 0, value: str = "value",
              channel: str | None = None, channels: int = 1) -> DataFrame:
    """Blocks made from pixels and passed through ``work(r0, c0, grid, core)``.

    ``grid`` (channels, rows, columns) begins at (r0, c0) and has the halo around it as far as there are pixels;
    ``core`` is the rectangle (row, column, row end, column end) of the block itself. Returns the same three:
    first row, first column, grid, or None for no row. Pixels without a value count as absent.
    """
    cols = [F.col(value).cast("double").alias("value")] + ([F.col(channel).cast("int").alias("ch")] if channel else [])
    kinds = [_scene_arrow(px), *[pa.int32()] * 4]

    def run(batches):
        def rows():
            for (scene, br, bc), parts in groups(batches, 3):
                core = int(br) * block, int(bc) * block, (int(br) + 1) * block, (int(bc) + 1) * block
                made = work(*_grid(parts, channels), core)
                if made is not None:
                    yield parts[0].column(0)[0].as_py(), made[0], made[1], *made[2].shape[1:], made[2].ravel()

        yield from _rows_out(rows(), kinds, ["scene_id", *RECT, "v"])

    return _by_block(px, block, halo, cols).mapInArrow(run, f"{_scene_sql(px)}, {RECT_SQL}")


def to_blocks(px: DataFrame, block: int = BLOCK, **how) -> DataFrame:
    """Pixels (scene_id, row, col, value) as blocks."""
    return block_map(px, lambda r0, c0, grid, core: (r0, c0, grid), block, **how)


def to_pixels(blocks: DataFrame, value: str = "value", channel: str | None = None) -> DataFrame:
    """One row a pixel that is there, and a channel if that is named."""
    n, at = F.col("h") * F.col("w"), F.col("at")
    place = at % n if channel else at
    cols = [F.floor(at / n).cast("int").alias(channel)] if channel else []
    return (blocks.select("scene_id", *RECT, F.posexplode("v").alias("at", value)).where(~F.isnan(value))
            .select("scene_id", (F.col("r0") + F.floor(place / F.col("w"))).cast("bigint").alias("row"),
                    (F.col("c0") + place % F.col("w")).cast("bigint").alias("col"), *cols, value))


# ---------------------------------------------------------------- smoothing

def _mirrored(first: int, last: int, halo: int, low: int, high: int) -> np.ndarray:
    """Places low .. high, and ``halo`` more at both ends, where those outside first .. last are mirrored at the edge."""
    n = last - first + 1
    at = (np.arange(low - halo, high + halo + 1) - first) % (2 * n)
    return np.minimum(at, 2 * n - 1 - at)


def _box_sum(x: np.ndarray, size: int) -> np.ndarray:
    """Sums over size x size neighbours, without the borders that lack some."""
    rows = sum(x[k:x.shape[0] - size + 1 + k] for k in range(size))
    return sum(rows[:, k:rows.shape[1] - size + 1 + k] for k in range(size))


def box_moments(r0: int, c0: int, grid: np.ndarray, core: tuple, size: int):
    """Of the pixels of the core: their first row and column, values, and means of value and square around each.

    A line is mirrored at the edge of the scene, the edge pixel first; pixels that are not there are left out of
    the means. None for a core without pixels.
    """
    h = size // 2
    rows, cols = grid.shape[1:]
    low = max(core[0], r0), max(core[1], c0)
    high = min(core[2], r0 + rows) - 1, min(core[3], c0 + cols) - 1
    if low[0] > high[0] or low[1] > high[1]:
        return None
    i = _mirrored(r0, r0 + rows - 1, h, low[0], high[0])
    j = _mirrored(c0, c0 + cols - 1, h, low[1], high[1])
    x = grid[0][np.ix_(i, j)]
    there = ~np.isnan(x)
    x = np.where(there, x, 0.0)
    n = np.maximum(_box_sum(there.astype(float), size), 1.0) if not there.all() else float(size * size)
    value = grid[0, low[0] - r0:high[0] - r0 + 1, low[1] - c0:high[1] - c0 + 1]
    return low[0], low[1], value, _box_sum(x, size) / n, _box_sum(x * x, size) / n


# ---------------------------------------------------------------- overlapping tiles

def starts(extent: int, tile: int, overlap: int) -> list[int]:
    """Tile origins along an axis; the last one is moved back to end at the edge."""
    last = extent - tile
    return sorted({*range(0, last + 1, max(tile - overlap, 1)), last})


def _together(pieces: DataFrame, keys: list[str]) -> DataFrame:
    return pieces.repartition("scene_id", *keys).sortWithinPartitions("scene_id", *keys, *RECT[:2])


def cut_tiles(blocks: DataFrame, scenes: DataFrame, tile: int, overlap: int) -> DataFrame:
    """(scene_id, ty, tx, tile, v): overlapping square tiles of each scene, channel by channel.

    ``scenes`` has scene_id, height, width; a tile is no larger than its scene. Blocks send each tile the piece they
    share with it. Tiles without a pixel are left out.
    """
    size = scenes.select("scene_id", F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"))
    scene = _scene_arrow(blocks)

    def cut(batches):
        def rows():
            for b in batches:
                ids = b.column(0)
                shape = zip(*(b.column(k).to_pylist() for k in (1, 2, 3, 4, 6, 7)))
                for n, ((r0, c0, h, w, height, width), v) in enumerate(zip(shape, lists(b.column(5)))):
                    t = min(tile, height, width)
                    grid = v.reshape(-1, h, w)
                    for ty in starts(height, t, overlap):
                        if ty >= r0 + h or ty + t <= r0:
                            continue
                        for tx in starts(width, t, overlap):
                            if tx >= c0 + w or tx + t <= c0:
                                continue
                            a, e = max(ty, r0), max(tx, c0)
                            part = grid[:, a - r0:min(ty + t, r0 + h) - r0, e - c0:min(tx + t, c0 + w) - c0]
                            yield ids[n].as_py(), ty, tx, t, a, e, *part.shape[1:], part.ravel()

        yield from _rows_out(rows(), [scene, *[pa.int32()] * 7], ["scene_id", "ty", "tx", "tile", *RECT, "v"])

    def join(batches):
        def rows():
            for (_, ty, tx), parts in groups(batches, 3):
                t = parts[0].column(3)[0].as_py()
                out = None
                for p in parts:
                    for r0, c0, h, w, v in zip(*(p.column(k).to_pylist() for k in (4, 5, 6, 7)), lists(p.column(8))):
                        piece = v.reshape(-1, h, w)
                        if out is None:
                            out = np.full((len(piece), t, t), np.nan)
                        out[:, r0 - ty:r0 - ty + h, c0 - tx:c0 - tx + w] = piece
                yield parts[0].column(0)[0].as_py(), int(ty), int(tx), t, out.ravel()

        yield from _rows_out(rows(), [scene, *[pa.int32()] * 3], ["scene_id", "ty", "tx", "tile", "v"])

    pieces = blocks.join(size, "scene_id").select("scene_id", *RECT, "v", "height", "width").mapInArrow(
        cut, f"{_scene_sql(blocks)}, ty int, tx int, tile int, {RECT_SQL}")
    return _together(pieces, ["ty", "tx"]).mapInArrow(join, f"{_scene_sql(blocks)}, ty int, tx int, tile int, v array<double>")


def blend(tiles: DataFrame, floor: float, block: int = BLOCK) -> DataFrame:
    """Blocks with the weighted mean of overlapping tiles (scene_id, ty, tx, tile, v); the edges of a tile weigh least.

    A value that is not there has no weight. Tiles send each block the piece they share with it, and a block adds
    its pieces up in the order of the tiles.
    """
    scene = _scene_arrow(tiles)

    def weight(t: int) -> np.ndarray:
        ramp = np.hanning(t) if t > 2 else np.ones(t)
        return np.outer(ramp, ramp) + floor

    def cut(batches):
        def rows():
            for b in batches:
                ids = b.column(0)
                for n, (ty, tx, t, v) in enumerate(zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), lists(b.column(4)))):
                    grid = v.reshape(-1, t, t)
                    for br in range(ty // block, (ty + t - 1) // block + 1):
                        for bc in range(tx // block, (tx + t - 1) // block + 1):
                            a, e = max(ty, br * block), max(tx, bc * block)
                            part = grid[:, a - ty:min(ty + t, (br + 1) * block) - ty, e - tx:min(tx + t, (bc + 1) * block) - tx]
                            yield ids[n].as_py(), br, bc, ty, tx, t, a, e, *part.shape[1:], part.ravel()

        yield from _rows_out(rows(), [scene, *[pa.int32()] * 9], ["scene_id", "br", "bc", "ty", "tx", "tile", *RECT, "v"])

    def add(batches):
        def rows():
            weights: dict[int, np.ndarray] = {}
            for (_, br, bc), parts in groups(batches, 3):
                total = mass = None
                high = [0, 0]
                low = [1 << 30, 1 << 30]
                top, left = int(br) * block, int(bc) * block
                for p in parts:
                    for ty, tx, t, r0, c0, h, w, v in zip(*(p.column(k).to_pylist() for k in range(3, 10)), lists(p.column(10))):
                        piece = v.reshape(-1, h, w)
                        if total is None:
                            total, mass = np.zeros((len(piece), block, block)), np.zeros((len(piece), block, block))
                        if t not in weights:
                            weights[t] = weight(t)
                        g = weights[t][r0 - ty:r0 - ty + h, c0 - tx:c0 - tx + w]
                        there = ~np.isnan(piece)
                        at = np.s_[:, r0 - top:r0 - top + h, c0 - left:c0 - left + w]
                        total[at] += np.where(there, piece, 0.0) * g
                        mass[at] += there * g
                        low = [min(low[0], r0 - top), min(low[1], c0 - left)]
                        high = [max(high[0], r0 - top + h), max(high[1], c0 - left + w)]
                cut_ = np.s_[:, low[0]:high[0], low[1]:high[1]]
                mean = np.where(mass[cut_] > 0, total[cut_] / np.maximum(mass[cut_], 1e-6), np.nan)
                yield parts[0].column(0)[0].as_py(), top + low[0], left + low[1], *mean.shape[1:], mean.ravel()

        yield from _rows_out(rows(), [scene, *[pa.int32()] * 4], ["scene_id", *RECT, "v"])

    pieces = tiles.select("scene_id", "ty", "tx", "tile", "v").mapInArrow(
        cut, f"{_scene_sql(tiles)}, br int, bc int, ty int, tx int, tile int, {RECT_SQL}")
    together = pieces.repartition("scene_id", "br", "bc").sortWithinPartitions("scene_id", "br", "bc", "ty", "tx")
    return together.mapInArrow(add, f"{_scene_sql(tiles)}, {RECT_SQL}")
