"""Exact percentiles per group without holding a group.

The wanted ranks of all groups are found together, digit by digit. A digit is a histogram of at most 2 ** 16 bins
whose order is that of the values: the first by the logarithm of their size, the others by place between the
smallest and the largest value of the bin chosen before. Tasks send counts, not values. A bin
with one distinct value, or a rank at its end, is settled; the values of the other bins go on to the next digit, so
each looks at a small part of the last. As a bin of the first digit spans a fiftieth of its
value, four more digits tell any two doubles apart.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage

#: Bins of a digit, and bins of the first for each e-fold of size.
BINS = 1 << 16
BINS_A_FOLD = 46
#: Above the bins of the smallest doubles, so that positive ones come behind zero.
SHIFT = 40_000


def _size_bin(v: Column) -> Column:
    """A bin that never falls as ``v`` grows."""
    size = F.floor(F.greatest(F.least(F.ln(F.abs(v)), F.lit(800.0)), F.lit(-800.0)) * BINS_A_FOLD) + SHIFT
    return F.when(v == 0, F.lit(0).cast("bigint")).when(v > 0, size).otherwise(-size)


def _place_bin() -> Column:
    share = (F.col("v_") - F.col("lo_")) / (F.col("hi_") - F.col("lo_"))
    return F.least(F.floor(F.coalesce(share, F.lit(0.0)) * BINS), F.lit(BINS - 1))


def _histogram(rows: DataFrame, by: list[str]) -> DataFrame:
    """Bins of the digit d with count c, smallest and largest value, and upto, the count of this and the bins before."""
    w = Window.partitionBy(*by).orderBy("d_").rowsBetween(Window.unboundedPreceding, 0)
    return (rows.groupBy(*by, "d_").agg(F.count("*").alias("c_"), F.min("v_").alias("lo_"), F.max("v_").alias("hi_"))
            .withColumn("upto_", F.sum("c_").over(w)))


SETTLED = "lo_ = hi_ or k_ = 0 or k_ = c_ - 1"


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """(keys, one column per name in ``probs``), interpolated linearly between ranks.

    Null and NaN values are left out; groups without values are absent. ``df`` is read twice, so a costly one
    should be written first.
    """
    v = (df.select(*keys, F.col(value).cast("double").alias("v_"))
         .where(F.col("v_").isNotNull() & ~F.isnan("v_")))
    rows = v.withColumn("d_", _size_bin(F.col("v_")))
    first = _histogram(rows, keys)
    all_ = Window.partitionBy(*keys)
    rank = lambda q: F.lit(float(q)) * (F.col("n_") - 1)
    # both ranks that a percentile lies between, each in the bin that holds it
    wanted = [F.struct(F.lit(2 * i + side).alias("i"), at(rank(q)).cast("bigint").alias("k"))
              for i, q in enumerate(probs.values()) for side, at in enumerate((F.floor, F.ceil))]
    here = F.filter(F.array(*wanted), lambda x: (x["k"] < F.col("upto_")) & (x["k"] >= F.col("upto_") - F.col("c_")))
    chosen = cut_lineage(
        first.withColumn("n_", F.max("upto_").over(all_)).withColumn("x_", F.explode(here))
        .select(*keys, "n_", "d_", "lo_", "hi_", "c_", F.col("x_.i").alias("i_"), (F.col("x_.k") - F.col("upto_") + F.col("c_")).alias("k_")))
    settled = [chosen.where(SETTLED)]
    open_ = chosen.where(f"not ({SETTLED})")
    by = [*keys, "at_"]  # a bin is named by its smallest value
    rows = rows.join(open_.select(*keys, "d_", "lo_", "hi_").distinct(), [*keys, "d_"])
    while not open_.isEmpty():
        rows = cut_lineage(rows.select(*keys, "v_", F.col("lo_").alias("at_"), _place_bin().alias("d_")))
        bins = _histogram(rows, by)
        left = open_.select(*keys, "n_", "i_", F.col("lo_").alias("at_"), F.col("k_").alias("before_"))
        found = cut_lineage(
            bins.join(left, by).where("before_ < upto_ and before_ >= upto_ - c_")
            .select(*by, "n_", "d_", "lo_", "hi_", "c_", "i_", (F.col("before_") - F.col("upto_") + F.col("c_")).alias("k_")))
        settled.append(found.where(SETTLED).drop("at_"))
        open_ = found.where(f"not ({SETTLED})")
        rows = rows.join(open_.select(*by, "d_", "lo_", "hi_").distinct(), [*by, "d_"])
    done = settled[0]
    for more in settled[1:]:
        done = done.unionByName(more)
    done = done.withColumn("x_", F.when(F.col("k_") == F.col("c_") - 1, F.col("hi_")).otherwise(F.col("lo_")))
    at = lambda i: F.max(F.when(F.col("i_") == i, F.col("x_")))
    share = lambda q: F.max(rank(q) - F.floor(rank(q)))
    between = lambda a, b, s: F.when(a == b, a).otherwise(a + (b - a) * s)  # equal ones may be infinite
    return done.groupBy(*keys).agg(*[
        between(at(2 * i), at(2 * i + 1), share(q)).alias(name) for i, (name, q) in enumerate(probs.items())])
