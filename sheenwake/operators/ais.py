"""Vessel position reports: column lookup, normalisation, clean-up, statics."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.geo import EARTH_RADIUS_KM, KM_PER_DEG, KM_PER_NM, haversine_km, np_haversine_km
from ..session import cut_lineage, writes_once
from .asof import bucket_of, with_neighbours

# Names each field goes by, in order of preference.
ALIASES = {
    "mmsi": ["mmsi"],
    "t": ["t", "basedatetime", "timestamp", "time", "datetime", "datetimeutc"],
    "lat": ["lat", "latitude", "y"],
    "lon": ["lon", "long", "longitude", "x"],
    "sog": ["sog", "speed", "speedoverground"],
    "cog": ["cog", "course", "courseoverground"],
    "heading": ["heading", "trueheading"],
    "name": ["vesselname", "name", "shipname"],
    "vtype": ["vtype", "vesseltype", "shiptype", "type"],
    "length": ["length", "loa"],
    "width": ["width", "beam"],
    "draft": ["draft", "draught"],
}
REQUIRED = ["mmsi", "t", "lat", "lon"]
NUMBERS = ["lat", "lon", "sog", "cog", "heading", "length", "width", "draft", "vtype"]
CANONICAL = ["mmsi", "t", "lat", "lon", "sog", "cog", "heading", "length", "width", "draft",
             "name", "vtype"]

# Implied speed of a position error (knots) and length of a silence (s).
TELEPORT_KN = 60.0
GAP_S = 900.0

#: Name of the first run of a track, and how many fixes ahead the end of a run looks at once.
FIRST_RUN = float("-inf")
LOOK_AHEAD = 8
#: Share by which bounds of a distance are widened against rounding.
MARGIN = 1e-6

TIME_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]",
                "MM/dd/yyyy HH:mm:ss", "yyyy-MM-dd"]


def resolve_columns(columns: list[str]) -> dict[str, str]:
    """Canonical field -> column, matching without case, blanks and underscores."""
    seen = {c.lower().replace("_", "").replace(" ", ""): c for c in columns}
    found = {}
    for field, names in ALIASES.items():
        hit = next((n for n in names if n in seen), None)
        if hit is not None:
            found[field] = seen[hit]
    return found


def parse_time(df: DataFrame, column: str) -> Column:
    """UTC seconds from a timestamp, a number (ms above 1e11; also as text) or text; bad text is null."""
    kind, c = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(c.cast("timestamp")) / 1e6
    number = F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))
    seconds = F.when(number > 1e11, number / 1000.0).otherwise(number)
    if isinstance(kind, T.NumericType):
        return seconds
    tries = [F.try_to_timestamp(c)] + [F.try_to_timestamp(c, F.lit(f)) for f in TIME_FORMATS]
    return F.coalesce(seconds, F.unix_micros(F.coalesce(*tries)) / 1e6)


def null_sentinels(df: DataFrame) -> DataFrame:
    """Values that stand for "not available" become null."""
    return df.withColumns({
        "heading": F.when(~(F.col("heading") >= 511), F.col("heading")),
        "sog": F.when(~(F.col("sog") > 102), F.col("sog")),
        "cog": F.when(~(F.col("cog") > 360), F.col("cog"))})


def drop_invalid(df: DataFrame) -> DataFrame:
    """Rows with a vessel, a time and a position on the globe; mmsi as long."""
    return (df.where(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
                     & F.col("mmsi").isNotNull() & F.col("t").isNotNull())
            .withColumn("mmsi", F.col("mmsi").cast("long")))


def cast_fields(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Canonical columns by alias, numbers cast with errors to null."""
    found = resolve_columns(df.columns)
    missing = [f for f in REQUIRED if f not in found]
    if missing:
        raise ValueError(f"missing required column(s) {missing}; saw {df.columns[:20]}")
    src = lambda f: F.col(f"`{found[f]}`")
    number = lambda f: (F.nanvl(src(f).try_cast("double"), F.lit(None).cast("double"))
                        if f in found else F.lit(None).cast("double"))
    out = {"mmsi": number("mmsi"), "t": parse_time(df, found["t"])}
    out |= {f: number(f) for f in NUMBERS}
    out["name"] = (F.coalesce(src("name").cast("string"), F.lit("nan"))
                   if "name" in found else F.lit(""))
    return df.select(*(keep or []), *[out[f].alias(f) for f in CANONICAL])


def normalise_ais(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Any position table -> canonical table; ``keep`` lists extra columns to carry."""
    return null_sentinels(drop_invalid(cast_fields(df, keep)))


def within(df: DataFrame, bbox=None, t_range=None) -> DataFrame:
    """Rows inside (lat_min, lat_max, lon_min, lon_max) and (t_min, t_max), ends included."""
    if bbox is not None:
        df = df.where(F.col("lat").between(bbox[0], bbox[1]) & F.col("lon").between(bbox[2], bbox[3]))
    if t_range is not None:
        df = df.where(F.col("t").between(*t_range))
    return df


def dedupe_fixes(df: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One fix per (keys, t): the first by ``order``, or by all other columns. ``df`` is read twice.

    Counting needs the keys alone and hashes; only rows whose time occurs twice are sorted, and of a report
    repeated millions of times each task sends on one.
    """
    return _first_of(df, _several(df, [*keys, "t"]), [*keys, "t"], order)


def _several(df: DataFrame, own: list[str]) -> DataFrame:
    return df.groupBy(*own).agg(F.count("*").alias("n_")).where("n_ > 1").select(*own)


def _first_of(df: DataFrame, several: DataFrame, own: list[str], order: str | None) -> DataFrame:
    """``df`` with one row for each of the keys in ``several``."""
    by = [F.col(order)] if order else [F.col(c) for c in df.columns if c not in own]
    first = (df.join(several, own, "left_semi")
             .withColumn("rank_", F.row_number().over(Window.partitionBy(*own).orderBy(*by))).where("rank_ = 1"))
    return df.join(several, own, "left_anti").unionByName(first.drop("rank_")).select(*df.columns)


def implied_kn(lat1, lon1, t1, lat2, lon2, t2) -> Column:
    return haversine_km(lat1, lon1, lat2, lon2) / KM_PER_NM / ((t2 - t1) / 3600.0)


def _admissible(a: str, b: str, max_kn: float) -> Column:
    """Whether the way from fix ``a`` to the later fix ``b`` (structs of t, lat, lon) keeps the limit."""
    at = lambda s: [F.col(f"{s}.{c}") for c in ("lat", "lon", "t")]
    return ~F.coalesce(implied_kn(*at(a), *at(b)) > max_kn, F.lit(False))


def _runs(fixes: DataFrame, keys: list[str], max_kn: float, bucket_s: float) -> DataFrame:
    """Fixes of tracks with a break: t, lat, lon, bucket, run and, at the end of a run, near.

    A run is a stretch in which every fix admits the next; it is named by the time of its first fix, the first
    run of a track by minus infinity. ``near`` is the first of the next few fixes that the end admits (t, run).
    """
    seen = with_neighbours(fixes.select(*keys, "t", "lat", "lon"), keys, ["t", "lat", "lon"], bucket_s)
    here = F.struct("t", "lat", "lon")
    seen = cut_lineage(seen.withColumn("here", here).select(
        *keys, "t", "lat", "lon", bucket_of("t", bucket_s).alias("bucket"),
        (F.col("prev").isNotNull() & ~_admissible("prev", "here", max_kn)).alias("broken")))
    # Written, so that a short list of broken tracks is known to be short and the others are not shuffled to meet it.
    seen = seen.join(cut_lineage(seen.where("broken").select(*keys).distinct()), keys, "left_semi")
    last = F.max(F.when(F.col("broken"), F.col("t")))
    earlier = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = seen.groupBy(*keys, "bucket").agg(last.alias("last")).select(
        *keys, "bucket", F.last("last", True).over(earlier).alias("before"))
    w = Window.partitionBy(*keys, "bucket").orderBy("t")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = (seen.join(carry, [*keys, "bucket"])
            .withColumn("run", F.coalesce(F.last(F.when(F.col("broken"), F.col("t")), True).over(so_far), "before", F.lit(FIRST_RUN)))
            .withColumn("here", here))
    ahead = {f"n{k}": F.lead(F.struct("t", "lat", "lon", "run"), k).over(w) for k in range(2, LOOK_AHEAD + 1)}
    rows = rows.withColumns(ahead | {"ends": F.coalesce(F.lead("broken").over(w), F.lit(False))})
    hit = F.coalesce(*[F.when(F.col(n).isNotNull() & _admissible("here", n, max_kn), F.struct(f"{n}.t", f"{n}.run"))
                       for n in ahead])
    return cut_lineage(rows.select(*keys, "t", "lat", "lon", "bucket", "run", F.when(F.col("ends"), hit).alias("near")))


def _first_admitted(ends: DataFrame, rows: DataFrame, keys: list[str], max_kn: float, bucket_s: float) -> DataFrame:
    """(keys, run, to_run, to_t): the first fix of ``rows`` that each of ``ends`` (keys, run, end) admits.

    Buckets after the end are tried by their boxes: those too far to be reached in time are left out, and so are
    all behind the first in which every fix is near enough. An end looks no further than the time
    it takes to get anywhere in its track, and only the fixes of the buckets left are compared with it.
    """
    km_h = max_kn * KM_PER_NM
    box = rows.groupBy(*keys, "bucket").agg(*[f(c).alias(f"{n}_{c}") for c in ("lat", "lon", "t")
                                              for n, f in (("lo", F.min), ("hi", F.max))])
    tracks = box.groupBy(*keys).agg(F.max("bucket").alias("last_bucket"), *[
        f(f"{n}_{c}").alias(f"all_{n}_{c}") for c in ("lat", "lon") for n, f in (("lo", F.min), ("hi", F.max))])
    reach = lambda c, lo, hi: F.greatest(F.abs(F.col(f"end.{c}") - F.col(lo)), F.abs(F.col(f"end.{c}") - F.col(hi)))
    # along a meridian and then along a parallel is never shorter than the great circle
    most = lambda p: KM_PER_DEG * (reach("lat", f"{p}lo_lat", f"{p}hi_lat") + reach("lon", f"{p}lo_lon", f"{p}hi_lon"))
    hours = F.least(most("all_"), F.lit(180 * KM_PER_DEG)) / km_h
    steps = F.least(F.col("last_bucket") - F.col("bucket"), F.floor(hours * 3600.0 / bucket_s) + 2)
    tried = (ends.join(tracks, keys).withColumn("bucket", bucket_of("end.t", bucket_s))
             .select(*keys, "run", "end", F.explode(F.transform(
                 F.sequence(F.lit(0).cast("bigint"), steps), lambda k: F.col("bucket") + k)).alias("bucket"))
             .join(box, [*keys, "bucket"]))
    gap = lambda c: F.greatest(F.col(f"lo_{c}") - F.col(f"end.{c}"), F.col(f"end.{c}") - F.col(f"hi_{c}"), F.lit(0.0))
    half_sine = lambda x: F.pow(F.sin(F.radians(x) / 2), 2)
    narrow = F.least(F.cos(F.radians("lo_lat")), F.cos(F.radians("hi_lat"))) * F.cos(F.radians("end.lat"))
    least_a = F.greatest(half_sine(gap("lat")), narrow * F.least(half_sine(gap("lon")), half_sine(reach("lon", "lo_lon", "hi_lon"))))
    least = 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(least_a, F.lit(1.0)))) * (1 - MARGIN)
    in_time = lambda t: km_h * (F.col(t) - F.col("end.t")) / 3600.0
    sure = (F.col("lo_t") > F.col("end.t")) & (most("") * (1 + MARGIN) <= in_time("lo_t"))
    listed = (tried.withColumns({"sure": sure, "may": (F.col("hi_t") > F.col("end.t")) & (least <= in_time("hi_t"))}).where("may")
              .groupBy(*keys, "run", "end").agg(F.min(F.when(F.col("sure"), F.col("bucket"))).alias("stop"),
                                                F.collect_list("bucket").alias("buckets")))
    chosen = listed.select(*keys, "run", "end", F.explode(F.filter(
        "buckets", lambda b: F.coalesce(b <= F.col("stop"), F.lit(True)))).alias("bucket"))
    met = chosen.join(rows.select(*keys, "bucket", F.struct("t", "lat", "lon").alias("fix"), F.col("run").alias("to_run")),
                      [*keys, "bucket"]).where((F.col("fix.t") > F.col("end.t")) & _admissible("end", "fix", max_kn))
    return met.groupBy(*keys, "run").agg(F.min_by("to_run", "fix.t").alias("to_run"), F.min("fix.t").alias("to_t"))


def _reached(starts: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, run, entry) of ``starts`` and of all runs that ``links`` (keys, run, to_run, to_t) lead to from there.

    Links are joined with themselves, so each round goes twice as far as the last: after round k the runs found are
    those less than 2 ** k links away, and a row of links spans 2 ** k of them.
    """
    found, hops = starts, links
    while True:
        on = [*keys, "run"]
        new = cut_lineage(found.join(hops, on).select(*keys, F.col("to_run").alias("run"), F.col("to_t").alias("entry")))
        if new.isEmpty():
            return found
        found = found.unionByName(new)
        then = hops.select(*keys, F.col("run").alias("to_run"), F.col("to_run").alias("run2"), F.col("to_t").alias("t2"))
        hops = cut_lineage(hops.join(then, [*keys, "to_run"])
                           .select(*on, F.col("run2").alias("to_run"), F.col("t2").alias("to_t")))


@writes_once
def teleports(fixes: DataFrame, keys: list[str], max_kn: float = TELEPORT_KN,
              bucket_s: float = 3600.0) -> DataFrame:
    """(keys, t) of fixes that imply more than ``max_kn`` from the last accepted fix of the track.

    The rule is sequential: a dropped fix keeps the old anchor. Tracks without a break are whole already. The others
    are cut into runs in which every fix admits the next: whoever enters a run accepts the rest of it, so only its end
    has to look for the first fix it admits, nearly always one of the next few. Runs and these links make a
    graph, and what the first run reaches is found by pointer doubling, in as many rounds as the
    number of runs has binary digits. Ends that admit no fix near by are searched for when they are
    reached, and with each such round twice as much of the track behind them.

    Expects unique (keys, t). Only t, lat and lon travel.
    """
    rows = _runs(fixes, keys, max_kn, bucket_s)
    at_end = lambda c: F.max_by(F.col(c), "t")
    ends = rows.groupBy(*keys, "run").agg(
        F.max("t").alias("t"), at_end("lat").alias("lat"), at_end("lon").alias("lon"),
        at_end("near.run").alias("to_run"), at_end("near.t").alias("to_t"))
    ends = cut_lineage(ends.select(*keys, "run", F.struct("t", "lat", "lon").alias("end"), "to_run", "to_t"))
    final = ends.groupBy(*keys).agg(F.max("run").alias("run")).withColumn("final", F.lit(True))
    links = ends.where("to_run is not null").select(*keys, "run", "to_run", "to_t")
    open_ends = cut_lineage(ends.where("to_run is null").join(final, [*keys, "run"], "left_anti").select(*keys, "run", "end"))

    starts = cut_lineage(final.select(*keys, F.lit(FIRST_RUN).alias("run"), F.lit(FIRST_RUN).alias("entry")))
    found, ahead_s = None, bucket_s
    while True:
        new = _reached(starts, links, keys)
        found = new if found is None else found.unionByName(new)
        stuck = cut_lineage(open_ends.join(new.select(*keys, "run"), [*keys, "run"]))
        if stuck.isEmpty():
            break
        # what is near behind a stuck end may be reached next and is searched along with it
        due = cut_lineage(open_ends.join(stuck.select(*keys, F.col("end.t").alias("from")), keys)
                          .where((F.col("end.t") >= F.col("from")) & (F.col("end.t") <= F.col("from") + ahead_s)).drop("from"))
        hits = cut_lineage(_first_admitted(due, rows, keys, max_kn, bucket_s))
        open_ends = cut_lineage(open_ends.join(due.select(*keys, "run"), [*keys, "run"], "left_anti"))
        starts = cut_lineage(stuck.join(hits, [*keys, "run"]).select(*keys, F.col("to_run").alias("run"), F.col("to_t").alias("entry")))
        links = links.unionByName(hits.select(*links.columns))
        ahead_s *= 2
    # by bucket, so that a long run is looked up in pieces
    parts = rows.select(*keys, "bucket", "run").distinct().join(found, [*keys, "run"], "left")
    return (rows.select(*keys, "t", "bucket", "run").join(parts, [*keys, "bucket", "run"])
            .where("entry is null or t < entry").select(*keys, "t"))


def accepted(track: np.ndarray, t: np.ndarray, lat: np.ndarray, lon: np.ndarray, max_kn: float = TELEPORT_KN) -> np.ndarray:
    """Whether each fix of whole tracks, in order of ``track`` and time, is none of ``teleports``.

    All fixes are compared with the one before at once. Only behind one that does not admit the next is the first that
    it admits looked for, in ever longer stretches, and what follows that one is taken up to the next break.
    """
    def admits(a, b):
        with np.errstate(divide="ignore", invalid="ignore"):
            return ~(np_haversine_km(lat[a], lon[a], lat[b], lon[b]) / KM_PER_NM / ((t[b] - t[a]) / 3600.0) > max_kn)

    ok = np.ones(len(t), bool)
    if len(t) < 2:
        return ok
    before = np.arange(len(t) - 1)
    breaks = np.flatnonzero((track[1:] == track[:-1]) & ~admits(before, before + 1))
    ends = np.searchsorted(track, track[breaks], "right")
    reached = -1
    for anchor, end in zip(breaks.tolist(), ends.tolist()):
        if anchor < reached:  # dropped itself: whoever dropped it has looked further
            continue
        a, n, hit = anchor + 1, LOOK_AHEAD, end
        while a < end:
            b = np.arange(a, min(a + n, end))
            found = np.flatnonzero(admits(np.full(len(b), anchor), b))
            if len(found):
                hit = a + int(found[0])
                break
            a, n = a + n, n * 4
        ok[anchor + 1:hit] = False
        reached = hit
    return ok


def drop_teleports(fixes: DataFrame, keys: list[str], max_kn: float = TELEPORT_KN,
                   bucket_s: float = 3600.0) -> DataFrame:
    """``fixes`` without ``teleports``; all but the position meets the list of dropped fixes once."""
    return fixes.join(teleports(fixes, keys, max_kn, bucket_s), [*keys, "t"], "left_anti")


def clean_tracks(df: DataFrame, keys: list[str], order: str | None = None,
                 max_kn: float = TELEPORT_KN, bucket_s: float = 3600.0) -> DataFrame:
    """Unique times and no teleports. The input is written once; the steps read the columns they need of it."""
    rows = cut_lineage(df)
    own = [*keys, "t"]
    several = cut_lineage(_several(rows, own))
    return drop_teleports(_first_of(rows, several, own, order), keys, max_kn, bucket_s)


def vessel_statics(df: DataFrame, keys: list[str]) -> DataFrame:
    """First valid type, length, width, draft and real name of every track, in time order.

    A name is no plain number, and an aggregate that holds one would sort every row: first the time of each
    name is found, and then the first of the few names.
    """
    named = (~F.lower("name").isin("", "nan", "none")) & F.col("name").isNotNull()
    first = lambda c, ok: F.min_by(F.when(ok, F.col(c)), F.when(ok, F.col("t")))
    numbers = ("vtype", "length", "width", "draft")
    by_name = df.groupBy(*keys, F.when(named, F.col("name")).alias("name")).agg(
        F.min("t").alias("t"), *[x for c in numbers for x in (
            first(c, F.col(c).isNotNull()).alias(c), F.min(F.when(F.col(c).isNotNull(), F.col("t"))).alias(f"t_{c}"))])
    return by_name.groupBy(*keys).agg(
        F.coalesce(first("name", F.col("name").isNotNull()), F.lit("")).alias("name"),
        *[F.min_by(c, f"t_{c}").alias(c) for c in numbers])


def track_span(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("t").alias("t_first"), F.max("t").alias("t_last"),
                                 F.count("*").alias("n_fixes"))


def gaps(df: DataFrame, keys: list[str], min_gap_s: float = GAP_S,
         bucket_s: float = 3600.0) -> DataFrame:
    """Silences (g0, g1) longer than ``min_gap_s`` between neighbouring fixes."""
    near = with_neighbours(df.select(*keys, "t"), keys, ["t"], bucket_s)
    return (near.where(F.col("t") - F.col("prev.t") > min_gap_s)
            .select(*keys, F.col("prev.t").alias("g0"), F.col("t").alias("g1")))


def union_parts(*parts: DataFrame) -> DataFrame:
    """All rows of several sources; a column one of them lacks is null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
