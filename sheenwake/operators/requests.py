"""Placing requests: named sea regions and explicit positions."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The named regions (id, name, lat, lon).
REGIONS = [
    ("arabian_sea", "Arabian Sea (off Mumbai)", 18.60, 71.60),
    ("gulf_of_kutch", "Gulf of Kutch", 22.55, 69.00),
    ("bay_of_bengal", "Bay of Bengal (Chennai)", 13.00, 80.60),
    ("malacca", "Strait of Malacca", 2.30, 101.60),
    ("persian_gulf", "Persian Gulf (Hormuz)", 26.30, 56.20),
    ("suez", "Gulf of Suez", 28.20, 33.30),
    ("gulf_mexico", "Gulf of Mexico", 28.20, -89.50),
    ("north_sea", "North Sea", 54.50, 3.50),
    ("mediterranean", "Eastern Mediterranean", 34.20, 25.00),
    ("gulf_guinea", "Gulf of Guinea", 3.50, 6.00),
    ("singapore", "Singapore Strait", 1.20, 103.80),
    ("black_sea", "Black Sea", 43.50, 31.00),
]
DEFAULT_POSITION = (18.60, 71.60)


def region_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGIONS, "region string, region_name string, r_lat double, r_lon double")


def choose_position(requests: DataFrame, default: tuple[float, float] = DEFAULT_POSITION) -> DataFrame:
    """Requests (.., region, lat, lon) with the position to use and an error or null.

    An explicit position wins over the region; without either the default is taken. The
    region list is a dozen rows by definition and is broadcast.
    """
    r = F.broadcast(region_table(requests.sparkSession))
    given = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    pick = lambda own, reg, other: F.when(given, F.col(own)).otherwise(F.coalesce(reg, F.lit(other)))
    keep = [c for c in requests.columns if c not in ("lat", "lon")]
    x = requests.join(r, "region", "left").select(
        *keep, pick("lat", "r_lat", default[0]).alias("lat"), pick("lon", "r_lon", default[1]).alias("lon"),
        (F.col("region").isNotNull() & F.col("region_name").isNull()).alias("unknown_"))
    bad = ~(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))
    return x.withColumn("error", F.when(F.col("unknown_"), "unknown region").when(
        bad, "lat must be -90..90 and lon -180..180")).drop("unknown_")
