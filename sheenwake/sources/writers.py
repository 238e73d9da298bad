"""Writing archives and reports."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Side of a tile of the archive, and of the squares that order the rows of a tile, in degrees.
TILE_DEG, SQUARE_DEG = 10.0, 0.125
TILES_ROUND = int(360 / TILE_DEG)


def with_day(fixes: DataFrame) -> DataFrame:
    return fixes.withColumn("day", F.to_date(F.timestamp_seconds("t")))


def tile_of(lat, lon) -> Column:
    """Number of the tile that holds a position; by rows from the south, the date line and the poles at the rims."""
    step = lambda x, low, n: F.least(F.floor((x - low) / TILE_DEG), F.lit(n - 1)).cast("int")
    return step(lat, -90.0, TILES_ROUND // 2) * TILES_ROUND + step(lon, -180.0, TILES_ROUND)


def curve_place(lat, lon) -> Column:
    """Place on the curve that runs through the squares by halves of the globe, so that near squares stay near."""
    y, x = (F.floor((c + low) / SQUARE_DEG).cast("bigint") for c, low in ((lat, 90.0), (lon, 180.0)))
    bit = lambda v, b, to: F.shiftleft(F.shiftright(v, b).bitwiseAND(F.lit(1).cast("bigint")), to)
    return sum((bit(y, b, 2 * b + 1) + bit(x, b, 2 * b) for b in range(1, 12)), bit(y, 0, 1) + bit(x, 0, 0))


def write_ais_archive(fixes: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """Canonical reports as Parquet, one folder per UTC day and tile, along a space-filling curve within.

    Days and tiles that are written again are replaced; others stay. Rows go to the writers by ranges of
    (day, tile, curve, time), so a busy tile is several files, each of a part of it, and the footers of files and row
    groups tell them apart; a quiet one is one file.
    """
    order = ["day", "tile", "curve_", "t"]
    lat, lon = F.col("lat"), F.col("lon")
    n = int(fixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (with_day(fixes).withColumns({"tile": tile_of(lat, lon), "curve_": curve_place(lat, lon)})
     .repartitionByRange(n, *order).sortWithinPartitions(*order).drop("curve_")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("maxRecordsPerFile", rows_per_file)
     .partitionBy("day", "tile").parquet(path))


def crop_ais(raw: DataFrame, bbox, lat: str = "LAT", lon: str = "LON") -> DataFrame:
    """Raw rows inside a box, all columns as they are."""
    return raw.where(F.col(lat).try_cast("double").between(bbox[0], bbox[1])
                     & F.col(lon).try_cast("double").between(bbox[2], bbox[3]))


def write_curated(curated: DataFrame, path: str) -> None:
    curated.write.mode("overwrite").csv(path, header=True)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def write_geojson(collections: DataFrame, path: str) -> None:
    """One line of GeoJSON per scene."""
    collections.select("geojson").write.mode("overwrite").text(path)
