"""As-of lookup on tracks, cut into time buckets.

A window over a whole track would put a busy vessel into one task. Here a track is cut
into buckets of time; the window runs inside a bucket, and a small table with one row
per bucket carries the last fix before and the first fix after it across the cuts.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import col

ONE_FIX_S = 3600.0


def bucket_of(t, bucket_s: float) -> Column:
    return F.floor(col(t) / float(bucket_s))


def extreme_fix(by, fields: list[str]) -> Column:
    """Aggregate: struct of ``fields`` of the first (F.min_by) or last (F.max_by) fix.

    Field by field, so that the buffer is plain numbers and the aggregate can hash; an
    aggregate over structs would sort all fixes first. Times of a track are unique.
    """
    t = F.col("t")
    got = F.struct(*[by(F.col(c), t).alias(c) for c in fields])
    return F.when(F.count(t) > 0, got)


def _bucket_carry(marked: DataFrame, keys: list[str], fields: list[str], asked: DataFrame | None = None) -> DataFrame:
    """Per (keys, bucket): last fix of earlier buckets and first fix of later ones.

    Buckets without a fix have a row where ``asked`` (keys, bucket) lists them.
    """
    on = [*keys, "bucket"]
    ends = marked.groupBy(*on).agg(extreme_fix(F.min_by, fields).alias("head"), extreme_fix(F.max_by, fields).alias("tail"))
    if asked is not None:
        ends = ends.join(asked, on, "full")
    up = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    down = (Window.partitionBy(*keys).orderBy(F.desc("bucket"))
            .rowsBetween(Window.unboundedPreceding, -1))
    return ends.select(*on, F.last("tail", True).over(up).alias("before"),
                       F.last("head", True).over(down).alias("after"))


def with_neighbours(df: DataFrame, keys: list[str], fields: list[str],
                    bucket_s: float) -> DataFrame:
    """Every fix with ``prev``: the struct of ``fields`` (time first) of the fix before it."""
    marked = df.withColumn("bucket", bucket_of("t", bucket_s))
    carry = _bucket_carry(marked, keys, fields).drop("after")
    w = Window.partitionBy(*keys, "bucket").orderBy("t")
    # Field by field: a struct would be shuffled next to the fields it is made of.
    prev = F.when(F.lag(F.lit(True)).over(w), F.struct(*[F.lag(c).over(w).alias(c) for c in fields]))
    return (marked.withColumn("prev", prev)
            .join(carry, [*keys, "bucket"], "left")
            .withColumn("prev", F.coalesce("prev", "before")).drop("before", "bucket"))


def numbered(df: DataFrame, keys: list[str], bucket_s: float, name: str = "rn_") -> DataFrame:
    """Rows of a track numbered from 1 in time order, counted bucket by bucket."""
    x = df.withColumn("bucket", bucket_of("t", bucket_s))
    n = x.groupBy(*keys, "bucket").agg(F.count("*").alias("c_"))
    w = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = n.select(*keys, "bucket", F.coalesce(F.sum("c_").over(w), F.lit(0)).alias("start_"))
    inner = Window.partitionBy(*keys, "bucket").orderBy("t")
    return (x.join(start, [*keys, "bucket"])
            .withColumn(name, F.col("start_") + F.row_number().over(inner)).drop("start_", "bucket"))


def asof_rows(fixes: DataFrame, samples: DataFrame, keys: list[str], fields: list[str],
              bucket_s: float = 3600.0) -> DataFrame:
    """Fixes and samples in one table, each with ``prev`` and ``next`` fix.

    ``prev`` is the last fix at or before the row and ``next`` the first at or after it
    for samples; for a fix they are the fix itself and its true successor. ``fields``
    (time first) are the members of the structs. Rows carry ``is_sample``; columns of
    the other side are null. Samples may be many times the fixes: beside the rows themselves only their buckets travel.
    """
    fix = F.when(~F.col("is_sample"), F.struct(*fields))
    both = (fixes.withColumn("is_sample", F.lit(False))
            .unionByName(samples.withColumn("is_sample", F.lit(True)), allowMissingColumns=True)
            .withColumn("bucket", bucket_of("t", bucket_s)).withColumn("fix", fix))
    bucketed = lambda d: d.withColumn("bucket", bucket_of("t", bucket_s))
    carry = _bucket_carry(bucketed(fixes), keys, fields, bucketed(samples).select(*keys, "bucket").distinct())
    part = Window.partitionBy(*keys, "bucket")
    up = (part.orderBy("t", "is_sample").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # Downwards a sample meets an equal-time fix first; a fix looks strictly past itself.
    down = part.orderBy(F.desc("t"), "is_sample")
    upto = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    past = down.rowsBetween(Window.unboundedPreceding, -1)
    return (both
            .withColumn("prev", F.last("fix", True).over(up))
            .withColumn("next", F.when(F.col("is_sample"), F.last("fix", True).over(upto))
                        .otherwise(F.last("fix", True).over(past)))
            .join(carry, [*keys, "bucket"], "left")
            .withColumn("prev", F.coalesce("prev", "before"))
            .withColumn("next", F.coalesce("next", "after"))
            .drop("bucket", "fix", "before", "after"))


def covered(single: Column | None = None) -> Column:
    """Inside the track's span; a one-fix track speaks for an hour either way."""
    inside = F.col("prev").isNotNull() & F.col("next").isNotNull()
    if single is None:
        return inside
    near = F.abs(F.col("t") - F.coalesce("prev.t", "next.t")) < ONE_FIX_S
    return F.when(single, near).otherwise(inside)


def interpolated(field: str) -> Column:
    """Linear between the neighbours; clamped to the end fixes outside the span."""
    a, b = F.col(f"prev.{field}"), F.col(f"next.{field}")
    dt = F.col("next.t") - F.col("prev.t")
    share = (F.col("t") - F.col("prev.t")) / F.when(dt > 0, dt)
    return F.coalesce(a + (b - a) * share, a, b)


def nearest_dt() -> Column:
    """Seconds to the nearest fix; null when the track has none."""
    return F.least(F.col("t") - F.col("prev.t"), F.col("next.t") - F.col("t"))


def nearest_value(field: str) -> Column:
    """Value at the nearest fix; an exact tie takes the later one."""
    take_prev = F.col("next").isNull() | (
        (F.col("t") - F.col("prev.t")) < (F.col("next.t") - F.col("t")))
    return F.when(F.col("prev").isNotNull() & take_prev, F.col(f"prev.{field}")).otherwise(
        F.col(f"next.{field}"))


def inside_gap(min_gap_s: float) -> Column:
    """Strictly between two fixes that lie further apart than ``min_gap_s``."""
    hit = ((F.col("prev.t") < F.col("t")) & (F.col("t") < F.col("next.t"))
           & (F.col("next.t") - F.col("prev.t") > min_gap_s))
    return F.coalesce(hit, F.lit(False))


def positions_at(fixes: DataFrame, samples: DataFrame, keys: list[str],
                 bucket_s: float = 3600.0, min_gap_s: float = 900.0) -> DataFrame:
    """Samples (keys, sample_id, t) with position, coverage, nearest values and gap flag."""
    one = (fixes.groupBy(*keys).agg(F.count("*").alias("n")).where("n = 1")
           .select(*keys, F.lit(True).alias("single")))
    rows = asof_rows(fixes.select(*keys, "t", "lat", "lon", "sog", "cog"), samples, keys,
                     ["t", "lat", "lon", "sog", "cog"], bucket_s)
    single = F.coalesce(F.col("single"), F.lit(False))
    return (rows.where("is_sample").join(one, keys, "left")
            .select(*keys, "sample_id", "t", interpolated("lat").alias("at_lat"),
                    interpolated("lon").alias("at_lon"),
                    F.coalesce(covered(single), F.lit(False)).alias("covered"),
                    nearest_value("sog").alias("at_sog"), nearest_value("cog").alias("at_cog"),
                    nearest_dt().alias("nearest_s"), inside_gap(min_gap_s).alias("in_gap")))
