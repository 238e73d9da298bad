"""The fourteen vessel features against an origin cloud."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.evidence import FEATURES
from ..functions.geo import axis_alignment, clamp, circular_variance, haversine_km, np_haversine_km
from ..functions.vessels import size_score, vtype_prior
from ..session import cut_lineage, spread
from .ais import GAP_S, vessel_statics
from .asof import extreme_fix, interpolated, with_neighbours
from .origins import RADIUS_KM
from .tiles import groups

# Proximity length (km), feature window (h), stand-in and cap of distances
# (km), cap of times (min), speed when none is known at closest approach (kn).
PROX_KM, WINDOW_H = 5.0, 3.0
NO_DISTANCE_KM, MEAN_CAP_KM, MINUTES_CAP, NO_SOG_KN = 500.0, 200.0, 1440.0, 6.0

KEYS = ["origin_id", "mmsi"]
BUCKET_S = 3600.0
#: Shortest slot in which steps and samples meet, and samples that one slot gives to a task at once.
SHORTEST_S = 10.0
CROWD = 4096
SPAN = ["origin_id", "lat_c", "lon_c", "t0", "t1"]
#: Steps that a block holds next to its samples, and pairs of a block that are worked out at once.
CROWD_STEPS, PAIRS = 1 << 16, 1 << 18
BLOCK = ["origin_id", "slot", "part"]


def segments(fixes: DataFrame, span: DataFrame, bucket_s: float = BUCKET_S) -> DataFrame:
    """Tracks as steps (keys, prev, next and the columns of ``span``): from each fix to its successor.

    The first step of a track has no ``prev`` and the last no ``next``. ``span`` has a row per origin.
    """
    fields = ["t", "lat", "lon", "sog", "cog"]
    fixes = fixes.select(*KEYS, *fields)
    steps = with_neighbours(fixes, KEYS, fields, bucket_s).select(*KEYS, "prev", F.struct(*fields).alias("next"))
    tail = fixes.groupBy(*KEYS).agg(extreme_fix(F.max_by, fields).alias("prev"))
    none = F.lit(None).cast(steps.schema["next"].dataType)
    return steps.unionByName(tail.withColumn("next", none)).join(span, "origin_id")


def _level(seconds: Column) -> Column:
    """The first of ever longer slots, each four times the last, that is no shorter than a step."""
    return F.ceil(F.log(4.0, F.greatest(seconds / SHORTEST_S, F.lit(1.0)))).cast("int")


def _slot(t: Column) -> Column:
    return F.floor(t / (SHORTEST_S * F.pow(F.lit(4.0), F.col("level"))))


def sample_steps(steps: DataFrame, samples: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Samples next to the steps of each vessel that their slot of time holds: (keys, sample, step list).

    A step is listed in slots of its own length, so in three at most, and a slot holds a handful of steps of a
    vessel, however often it reports: they are one list. Samples look into the slots of all lengths
    that their origin's steps have, in an equality join. The product of samples and vessels is never shuffled.
    Only slots with samples are kept, and one with more than ``crowd`` of them has its lists copied and
    its samples split.
    """
    lo = F.greatest(F.coalesce("prev.t", "t0"), F.col("t0"))
    hi = F.least(F.coalesce("next.t", "t1"), F.col("t1"))
    listed = (steps.where(lo <= hi).withColumn("level", _level(F.coalesce(F.col("next.t") - F.col("prev.t"), hi - lo)))
              .withColumn("slot", F.explode(F.sequence(_slot(lo), _slot(hi))))
              .select(*KEYS, "level", "slot", F.struct("prev", "next").alias("step")))
    at = ["origin_id", "level", "slot"]
    levels = listed.select("origin_id", "level").distinct()
    s = (samples.select("origin_id", "sample_id", "t", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
         .join(levels, "origin_id").withColumn("slot", _slot(F.col("t"))))
    parts = cut_lineage(s.groupBy(*at).agg(F.ceil(F.count("*") / crowd).alias("parts")))
    s = s.join(parts.where("parts > 1"), at, "left").withColumn(
        "part", F.pmod(F.xxhash64("sample_id"), F.coalesce("parts", F.lit(1).cast("bigint")))).drop("parts")
    copies = listed.join(parts, at).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts")
    # Few small rows with a product behind each: keep them on all tasks. Steps become lists where they meet the samples.
    lists = (spread(copies, *at, "part").groupBy(*KEYS, "level", "slot", "part")
             .agg(F.collect_list("step").alias("steps")))
    return spread(s, *at, "part").join(lists, [*at, "part"])


def sample_positions(steps: DataFrame, samples: DataFrame) -> DataFrame:
    """Every sample of an origin against every vessel near it, on the step it falls in, with the distance ``d``."""
    t = F.col("t")
    falls = lambda x: ((t >= F.coalesce(x["prev"]["t"], F.lit(float("-inf"))))
                       & (t < F.coalesce(x["next"]["t"], F.lit(float("inf")))))
    x = (sample_steps(steps, samples)
         .select(*KEYS, "sample_id", "t", "s_lat", "s_lon", F.explode(F.filter("steps", falls)).alias("step"))
         .select(*KEYS, "sample_id", "t", "s_lat", "s_lon", "step.prev", "step.next"))
    # On the very last fix there is no next one, yet the track still speaks.
    inside = F.col("prev").isNotNull() & (F.col("next").isNotNull() | (F.col("t") == F.col("prev.t")))
    d = haversine_km(interpolated("lat"), interpolated("lon"), "s_lat", "s_lon")
    return x.withColumn("d", F.when(inside, d))


def sample_blocks(steps: DataFrame, samples: DataFrame, crowd: int = CROWD, crowd_steps: int = CROWD_STEPS) -> DataFrame:
    """Rows of samples and of steps, next to each other by block: each sample in all blocks of its vessels' steps.

    An origin is one block; one with more than ``crowd`` samples, or steps of a vessel, is cut into equal slots of
    time, in each of which a step that touches it is listed. Samples of a slot that is still crowded are split, and its
    steps copied; vessels of an origin with very many steps are split, and its samples copied. So no block grows with
    the input, and the product of samples and vessels is never shuffled.
    """
    lo = F.greatest(F.coalesce("prev.t", "t0"), F.col("t0"))
    hi = F.least(F.coalesce("next.t", "t1"), F.col("t1"))
    scale = F.col("scale") if "scale" in steps.columns else F.lit(PROX_KM)
    steps = steps.where(lo <= hi).select(*KEYS, "prev", "next", "t0", "t1", lo.alias("lo"), hi.alias("hi"), scale.alias("scale"))
    points = (samples.where("t is not null")
              .select("origin_id", F.col("sample_id").cast("long"), "t", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon")))
    of_vessel = steps.groupBy(*KEYS).agg(F.count("*").alias("n"), F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    by_origin = (of_vessel.groupBy("origin_id").agg(F.max("n").alias("most"), F.sum("n").alias("n_steps"),
                                                    F.min("t0").alias("from"), F.max("t1").alias("to"))
                 .join(points.groupBy("origin_id").agg(F.count("*").alias("n_samples")), "origin_id"))
    # most origins are one block: only the others are listed
    busy = cut_lineage(by_origin.withColumn("slots", F.ceil(F.greatest("n_samples", "most") / crowd))
                       .withColumn("fleets", F.ceil(F.col("n_steps") / F.col("slots") / crowd_steps))
                       .where("slots > 1 or fleets > 1").select("origin_id", "from", "to", "slots", "fleets"))
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")

    def slot(t: str) -> Column:
        share = (F.col(t) - F.col("from")) / F.when(F.col("to") > F.col("from"), F.col("to") - F.col("from"))
        return F.coalesce(F.greatest(zero, F.least(F.floor(share * F.col("slots")), F.col("slots") - 1)), zero)

    points = points.join(busy, "origin_id", "left").withColumn("slot", slot("t"))
    listed = (steps.join(busy, "origin_id", "left").withColumn("slot", F.explode(F.sequence(slot("lo"), slot("hi"))))
              .withColumn("fleet", F.pmod(F.xxhash64("mmsi"), F.coalesce("fleets", one))))
    crowded = cut_lineage(points.where("slots > 1").groupBy("origin_id", "slot").agg(F.ceil(F.count("*") / crowd).alias("crowds"))
                          .where("crowds > 1"))
    at = ["origin_id", "slot"]
    each = lambda n: F.explode(F.sequence(zero, F.coalesce(n, one) - 1))
    points = (points.join(crowded, at, "left")
              .withColumn("crowd", F.pmod(F.xxhash64("sample_id", "t"), F.coalesce("crowds", one))).withColumn("fleet", each("fleets")))
    listed = listed.join(crowded, at, "left").withColumn("crowd", each("crowds"))
    part = (F.col("crowd") * F.coalesce("fleets", one) + F.col("fleet")).alias("part")
    fix = lambda x: [F.col(f"{x}.{c}").cast("double").alias(f"{x}_{c}") for c in ("t", "lat", "lon", "sog", "cog")]
    fixes = listed.select(*at, part, "mmsi", F.col("scale").cast("double"), *fix("prev"), *fix("next"))
    double = lambda c: F.col(c).cast("double").alias(c)
    both = fixes.unionByName(points.select(*at, part, "sample_id", double("t"), double("s_lat"), double("s_lon")), allowMissingColumns=True)
    return spread(both, *BLOCK).sortWithinPartitions(*BLOCK).select(
        *BLOCK, "mmsi", "sample_id", "t", "s_lat", "s_lon", "scale",
        *[f"{x}_{c}" for x in ("prev", "next") for c in ("t", "lat", "lon", "sog", "cog")])


def _fall(t: np.ndarray, since: np.ndarray, until: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(step, sample) of samples in order of time that fall in steps, some of the steps at a time."""
    first = np.searchsorted(t, np.where(np.isnan(since), -np.inf, since))
    count = np.maximum(np.searchsorted(t, np.where(np.isnan(until), np.inf, until)) - first, 0)
    ends = np.cumsum(count)
    a = 0
    while a < len(count):
        b = max(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")), a + 1)
        n = count[a:b]
        step = np.repeat(np.arange(a, b), n)
        yield step, np.arange(len(step)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[a:b], n)
        a = b


def _sums(vessel, sample_id, t, lat, lon, scale, prev, after, radius_km: float) -> Iterator[list[np.ndarray]]:
    """Columns of SUMS for the vessels of a block, after the number of the vessel; NaN is a value that is not there.

    ``vessel``, ``scale``, ``prev`` and ``after`` (t, lat, lon, sog, cog) are those of steps, in order of vessels, the
    others those of samples in order of time.
    """
    between = after[0] - prev[0]
    rise, run = after[1] - prev[1], after[2] - prev[2]
    for k, i in _fall(t, prev[0], after[0]):
        if not len(k):
            continue
        of = vessel[k]
        starts = np.r_[0, np.flatnonzero(of[1:] != of[:-1]) + 1]
        since, until = t[i] - prev[0][k], after[0][k] - t[i]
        # On the very last fix there is no next one, yet the track still speaks.
        inside = ~np.isnan(since) & (~np.isnan(until) | (since == 0))
        share = since / between[k]
        place = []
        for x, dx, y in ((prev[1], rise, after[1]), (prev[2], run, after[2])):
            p = x[k] + dx[k] * share
            for end in (x, y):
                p = np.where(np.isnan(p), end[k], p) if np.isnan(p).any() else p
            place.append(p)
        d = np.where(inside, np_haversine_km(*place, lat[i], lon[i]), np.nan)
        known = ~np.isnan(d)
        far = np.where(known, d, np.inf)
        over = (since > 0) & (until > 0) & (between[k] > GAP_S) & (far <= radius_km)
        total = lambda x: np.add.reduceat(x, starts)
        least = lambda x: np.minimum.reduceat(x, starts)
        # the nearest by distance, to a tenth of a nanometre, and then by id
        row = np.flatnonzero(known & ~sample_id.mask[i])
        km, group = np.floor(d[row] * 1e13 + 0.5), np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(of)]))
        best = np.full(len(starts), np.inf)
        np.minimum.at(best, group[row], km)
        row = row[km == best[group[row]]]
        row = row[np.lexsort((sample_id.data[i[row]], group[row]))]
        row = row[np.r_[True, group[row][1:] != group[row][:-1]]] if len(row) else row
        pick = np.full(len(starts), -1)
        pick[group[row]] = row
        some = pick >= 0
        kk, ii = k[pick], i[pick]
        earlier = ~np.isnan(since[pick]) & ~(until[pick] <= since[pick])
        value = lambda c: np.where(some, np.where(earlier, prev[c][kk], after[c][kk]), np.nan)
        dt, nothing = np.fmin(since, until), np.full(len(starts), np.nan)
        d_min = least(far)
        yield [of[starts], np.diff(np.r_[starts, len(of)]), total(np.where(known, np.exp(-far / scale[k]), 0.0)),
               np.where(np.isinf(d_min), nothing, d_min), total(known.astype(np.int64)),
               total(np.where(known, np.minimum(far, MEAN_CAP_KM), 0.0)), least(dt), total(over.astype(np.int64)),
               np.where(some, d[pick], nothing), np.ma.array(sample_id.data[ii], mask=~some), value(4), value(3)]


#: What the samples of a block say of a vessel; ``d``, ``sample_id``, ``cog`` and ``sog`` are those of the nearest.
SUMS = ("n long, prox double, d_min double, n_d long, d_sum double, dt_min double, n_over long, "
        "d double, sample_id long, cog double, sog double")


def sample_sums(steps: DataFrame, samples: DataFrame, radius_km: float = RADIUS_KM, crowd: int = CROWD,
                crowd_steps: int = CROWD_STEPS) -> DataFrame:
    """(keys and SUMS): every sample of an origin against every vessel near it, added up by block.

    What ``sample_positions`` would give row by row: samples in order of time find the step they fall in by bisection, and
    distances are worked out for whole blocks. ``scale`` of a step is the length of the proximity.
    """
    blocks = sample_blocks(steps, samples, crowd, crowd_steps)
    kinds = dict(blocks.dtypes)
    names = [*KEYS, *[x.split()[0] for x in SUMS.split(", ")]]
    origin = to_arrow_type(blocks.schema["origin_id"].dataType)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in groups(batches, len(BLOCK)):
            x = pa.Table.from_batches(parts).combine_chunks()
            is_sample = np.asarray(x["t"].is_valid())
            s, f = x.filter(pa.array(is_sample)), x.filter(pa.array(~is_sample))
            if not len(s) or not len(f):
                continue
            numbers = lambda y, c: np.asarray(y[c].fill_null(np.nan).to_numpy())
            who = f["mmsi"].combine_chunks().dictionary_encode()
            vessel = np.asarray(who.indices)
            order, late = np.argsort(vessel, kind="stable"), np.argsort(numbers(s, "t"), kind="stable")
            ids = np.ma.array(np.asarray(s["sample_id"].fill_null(0))[late], mask=np.asarray(s["sample_id"].is_null())[late])
            ends = ([numbers(f, f"{e}_{c}")[order] for c in ("t", "lat", "lon", "sog", "cog")] for e in ("prev", "next"))
            for number, *sums in _sums(vessel[order], ids, *(numbers(s, c)[late] for c in ("t", "s_lat", "s_lon")),
                                       numbers(f, "scale")[order], *ends, radius_km):
                cols = [pa.array([x["origin_id"][0].as_py()] * len(number), origin), who.dictionary.take(pa.array(number))]
                for v in sums:
                    gone = v.mask if isinstance(v, np.ma.MaskedArray) else np.isnan(v)
                    cols.append(pa.array(np.asarray(v), mask=np.broadcast_to(gone, v.shape)))
                yield pa.RecordBatch.from_arrays(cols, names)

    return blocks.mapInArrow(add, f"origin_id {kinds['origin_id']}, mmsi {kinds['mmsi']}, {SUMS}")


def nearness() -> Column:
    """Order of samples by distance, then by id, as one plain number.

    Distances are taken to a tenth of a nanometre. A struct would order the same, but an
    aggregate over structs sorts every row instead of hashing it.
    """
    km = (F.col("d") * 1e13).cast("decimal(18,0)")
    return km * F.lit("1" + "0" * 19).cast("decimal(20,0)") + F.col("sample_id").cast("decimal(19,0)")


def sample_features(steps: DataFrame, samples: DataFrame, radius_km: float = RADIUS_KM) -> DataFrame:
    """What the samples say of each vessel: distances, timing, gaps, closest approach."""
    near, n = nearness(), F.sum("n")
    cpa = F.struct(F.min_by("cog", near).alias("cog"), F.min_by("sog", near).alias("sog"))
    return sample_sums(steps, samples, radius_km).groupBy(*KEYS).agg(
        (F.sum("prox") / n).alias("prox_score"),
        F.least(F.coalesce(F.min("d_min"), F.lit(NO_DISTANCE_KM)), F.lit(NO_DISTANCE_KM)).alias("min_dist_km"),
        F.coalesce(F.when(F.sum("n_d") > 0, F.sum("d_sum") / F.sum("n_d")), F.lit(NO_DISTANCE_KM)).alias("mean_dist_km"),
        F.least(F.min("dt_min") / 60.0, F.lit(MINUTES_CAP)).alias("time_gap_min"),
        (F.sum("n_over") / n).alias("gap_over_origin"), cpa.alias("cpa"))


def track_features(steps: DataFrame, radius_km: float = RADIUS_KM) -> DataFrame:
    """What the fixes say of each vessel: dwelling, slow steaming, loitering, silences."""
    pad = WINDOW_H * 3600.0
    t, g0, g1 = F.col("next.t"), F.col("prev.t"), F.col("next.t")
    sog = F.col("next.sog")
    win = t.between(F.col("t0") - pad, F.col("t1") + pad)
    d_fix = haversine_km("next.lat", "next.lon", "lat_c", "lon_c")
    share = lambda cond, of: F.coalesce(
        F.avg(F.when(of, F.when(cond, 1.0).otherwise(0.0))), F.lit(0.0))
    gap = g1 - g0 > GAP_S
    in_win = gap & (g1 > F.col("t0") - pad) & (g0 < F.col("t1") + pad)
    dark_s = F.greatest(F.lit(0.0), F.least(g1, F.col("t1")) - F.greatest(g0, F.col("t0")))
    agg = steps.groupBy(*KEYS).agg(
        F.count("next").alias("n_fixes"),
        share(d_fix <= radius_km, win).alias("dwell_frac"),
        share(sog.between(2.0, 9.0), win & sog.isNotNull()).alias("slow_steaming"),
        circular_variance("next.cog", win & (sog < 5.0)).alias("cog_var"),
        share(sog < 5.0, win & sog.isNotNull()).alias("slow_share"),
        F.max(F.when(win, sog.isNull())).alias("sog_missing"),
        F.least(F.coalesce(F.max(F.when(in_win, g1 - g0)) / 60.0, F.lit(0.0)), F.lit(MINUTES_CAP))
        .alias("ais_gap_max_min"),
        (F.coalesce(F.sum(F.when(gap, dark_s)), F.lit(0.0))
         / F.greatest(F.max(F.col("t1") - F.col("t0")), F.lit(1.0))).alias("dark"))
    loiter = F.when(~F.coalesce("sog_missing", F.lit(False)), F.col("cog_var") * F.col("slow_share"))
    return agg.withColumns({"loiter_score": F.coalesce(loiter, F.lit(0.0)), "dark_frac": clamp("dark", 0, 1)}).drop(
        "cog_var", "slow_share", "sog_missing", "dark")


def build_feature_table(fixes: DataFrame, candidates: DataFrame, samples: DataFrame,
                        origins: DataFrame, summary: DataFrame, radius_km: float = RADIUS_KM,
                        bucket_s: float = BUCKET_S) -> DataFrame:
    """(origin_id, mmsi, name, vtype, length, n_fixes) and the fourteen features.

    ``fixes`` are the cleaned rows near the origins.
    """
    live = fixes.join(candidates.select(*KEYS), KEYS, "left_semi")
    steps = cut_lineage(segments(live, summary.select(*SPAN), bucket_s))
    align = F.coalesce(axis_alignment("cpa.cog", "bearing"), F.lit(0.5))
    out = (sample_features(steps, samples, radius_km)
           .join(track_features(steps, radius_km), KEYS).join(vessel_statics(live, KEYS), KEYS)
           .join(origins.select("origin_id", "bearing"), "origin_id", "left")
           .withColumns({"vtype_prior": vtype_prior(), "size_score": size_score(), "course_align": align,
                         "cpa_sog_kn": F.coalesce("cpa.sog", F.lit(NO_SOG_KN))}))
    return out.select(*KEYS, "name", "vtype", "length", "n_fixes", *FEATURES)


def track_match(fixes: DataFrame, candidates: DataFrame, track: DataFrame, summary: DataFrame,
                bucket_s: float = BUCKET_S) -> DataFrame:
    """(origin, vessel, track_match): how closely a vessel follows the origin track.

    ``track`` has (origin_id, node, lat, lon, t). Vessels of origins without a track, or
    with fewer than two fixes, get 0.
    """
    nodes = track.withColumnRenamed("node", "sample_id")
    live = fixes.join(candidates.select(*KEYS), KEYS, "left_semi")
    # Nodes may lie outside the cloud's span, and each of them counts in the mean.
    span = nodes.groupBy("origin_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    scale = F.greatest(F.greatest(F.col("spread_km") * 0.6, F.lit(5.0)), F.lit(2.0))
    span = span.join(summary.select("origin_id", scale.alias("scale")), "origin_id")
    scored = (sample_sums(cut_lineage(segments(live, span, bucket_s)), nodes).groupBy(*KEYS)
              .agg((F.sum("prox") / F.sum("n")).alias("m")))
    ok = F.when(F.col("n_fixes") >= 2, F.col("m"))
    return (candidates.select(*KEYS, "n_fixes").join(scored, KEYS, "left")
            .select(*KEYS, F.coalesce(ok, F.lit(0.0)).alias("track_match")))


def closest_approach(fixes: DataFrame, candidates: DataFrame, samples: DataFrame, summary: DataFrame,
                     bucket_s: float = BUCKET_S) -> DataFrame:
    """(origin, vessel, sample_id, dist_km, cog, sog) of the nearest sample; first on a tie."""
    live = fixes.join(candidates.select(*KEYS), KEYS, "left_semi")
    steps = cut_lineage(segments(live, summary.select(*SPAN), bucket_s))
    near = nearness()
    return sample_sums(steps, samples).groupBy(*KEYS).agg(
        F.min_by("sample_id", near).alias("sample_id"), F.min("d_min").alias("dist_km"),
        F.min_by("cog", near).alias("cog"), F.min_by("sog", near).alias("sog")
    ).where("dist_km is not null")
