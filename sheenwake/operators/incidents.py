"""Curating incident lists: loose columns, hints, names, priorities."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.titles import OIL_HINTS, VESSEL_HINTS, mentions, vessel_name

AIS_ERA_YEAR = 2009

# Names under which the columns of an incident list are looked for.
WANTED = {
    "name": ["name", "title", "incident"],
    "date": ["date", "open_date", "incident_date"],
    "lat": ["lat", "latitude"],
    "lon": ["lon", "long", "longitude"],
    "commodity": ["commodity", "material", "product", "threat"],
}


def find_columns(columns: list[str]) -> dict[str, str]:
    """Field -> column: an exact match of any name first, then a name within a column."""
    seen = {c.lower().strip().replace(" ", "_"): c for c in columns}
    found = {}
    for field, names in WANTED.items():
        hit = next((n for n in names if n in seen), None)
        if hit is None:
            hit = next((k for n in names for k in seen if n in k), None)
        if hit is not None:
            found[field] = seen[hit]
    missing = [f for f in ("name", "lat", "lon") if f not in found]
    if missing:
        raise ValueError(f"incident list lacks {missing}; saw {columns[:20]}")
    return found


def read_fields(df: DataFrame) -> DataFrame:
    """(name, lat, lon, date, commodity) from a loosely named list."""
    at = {k: F.col(f"`{c}`") for k, c in find_columns(df.columns).items()}
    text = F.lit(None).cast("string")
    return df.select(
        F.coalesce(at["name"].cast("string"), F.lit("nan")).alias("name"),
        at["lat"].try_cast("double").alias("lat"), at["lon"].try_cast("double").alias("lon"),
        (at["date"].try_cast("timestamp") if "date" in at else text.cast("timestamp")).alias("date"),
        (F.coalesce(at["commodity"].cast("string"), F.lit("nan")) if "commodity" in at
         else F.lit("")).alias("commodity"))


def text_hints(df: DataFrame) -> DataFrame:
    hay = F.concat(F.col("name"), F.lit(" "), F.col("commodity"))
    return df.withColumns({"is_oil": mentions(hay, OIL_HINTS), "is_vessel": mentions(hay, VESSEL_HINTS)})


def incident_filter(df: DataFrame, ais_era_only: bool = False) -> DataFrame:
    """Oil from a vessel at a known place, in the years with position reports on request."""
    keep = F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("is_oil") & F.col("is_vessel")
    return df.where(keep & F.col("ais_era") if ais_era_only else keep)


def curate(df: DataFrame, ais_era_only: bool = False) -> DataFrame:
    """Incident list -> oil + vessel + coordinates with a name guess and a priority."""
    x = text_hints(read_fields(df))
    x = x.withColumn("year", F.year("date"))
    x = x.withColumns({"vessel_guess": vessel_name("name"),
                       "ais_era": F.coalesce(F.col("year") >= AIS_ERA_YEAR, F.lit(False))})
    x = incident_filter(x, ais_era_only)
    return x.select("name", "lat", "lon", "date", "year", "is_oil", "is_vessel", "vessel_guess",
                    "ais_era", (F.col("vessel_guess").isNotNull() & F.col("ais_era")).alias("priority"))


def by_priority(curated: DataFrame) -> DataFrame:
    return curated.orderBy(F.desc("priority"), F.desc_nulls_last("year"), F.desc_nulls_last("date"),
                           "name", "lat", "lon")


def incident_summary(curated: DataFrame) -> DataFrame:
    return curated.agg(F.count("*").alias("incidents"), F.count("vessel_guess").alias("named"),
                       F.count_if("ais_era").alias("in_ais_era"), F.count_if("priority").alias("priority"))


def source_type_counts(features: DataFrame) -> DataFrame:
    return (features.where(F.col("source_type").isNotNull()).groupBy("source_type")
            .agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_type"))
