"""Particle trajectories and what is read off them: origin cloud, heat map, track."""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions.draws import mix, np_normal_pair
from ..functions.geo import KM_PER_DEG, km_per_deg_lon, local_km
from ..session import by_shuffle, cut_lineage, spread
from .quantile import exact_percentiles
from .tiles import groups

# Share of the wind taken by surface oil, step (s), diffusivity (m2/s),
# ensemble size, heat bins, smoothing width, track nodes, forecast frames, tide hours.
WIND_SHARE, STEP_S, DIFFUSION = 0.03, 900.0, 1.0
N_PARTICLES, HEAT_BINS, SIGMA, TRACK_NODES, N_FRAMES = 600, 64, 1.2, 12, 12
TIDE_H = 12.42
GOLDEN = 0.6180339887

#: Columns of the field table: background, eddies, tide and wind of a slick.
FIELD = ["bg_u", "bg_v", "eddy", "l1", "l2", "phase", "tide", "wind_speed", "wind_dir", "veer"]

_SEED, _BACK, _FORWARD = 9, 1, 5


def field_velocity(f, e, n, t, m=F):
    """Surface drift (u, v) in m/s of a coefficients row at local km and unix time.

    ``f`` maps the names in FIELD to Columns or arrays and ``m`` is the matching module.
    """
    half = 0.5 * f["eddy"]
    a1, b1 = e / f["l1"], n / f["l1"]
    a2, b2 = e / f["l2"] + f["phase"], n / f["l2"]
    tide = f["tide"] * m.sin(2 * math.pi * t / (TIDE_H * 3600.0) + f["phase"])
    d = f["wind_dir"] + f["veer"] * t
    u = f["bg_u"] - f["eddy"] * m.cos(a1) * m.cos(b1) - half * m.cos(a2) * m.cos(b2) + tide
    v = f["bg_v"] - f["eddy"] * m.sin(a1) * m.sin(b1) - half * m.sin(a2) * m.sin(b2)
    wind = WIND_SHARE * f["wind_speed"]
    return u + wind * m.cos(d), v + wind * m.sin(d)


def expand_ages(slicks: DataFrame, n: int = N_PARTICLES) -> DataFrame:
    """One row per particle with its age, log-uniform over the slick's age range."""
    lo = F.greatest(F.coalesce("lo_h", F.col("age_h") / 3.0), F.lit(0.1))
    hi = F.greatest(F.coalesce("hi_h", F.col("age_h") * 3.0), F.col("lo_h") + 0.1)
    i = (F.col("particle_id") + 0.5) * GOLDEN
    u = i - F.floor(i)
    # Many particles become of a slick's row, and a small file of slicks is one task's.
    return (spread(slicks, "slick_id").withColumn("lo_h", lo).withColumn("hi_h", hi)
            .withColumn("particle_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
            .withColumn("age_s", F.exp(F.log("lo_h") + u * (F.log("hi_h") - F.log("lo_h"))) * 3600.0))


def footprint_arrays(footprint: DataFrame) -> DataFrame:
    """(slick_id, lat0, lon0, vertices): a slick outline is short, so it fits one row."""
    return footprint.groupBy("slick_id").agg(
        F.avg("lat").alias("lat0"), F.avg("lon").alias("lon0"),
        F.array_sort(F.collect_list(F.struct("vertex", "lat", "lon"))).alias("vertices"))


def seed_particles(particles: DataFrame, footprint: DataFrame) -> DataFrame:
    """Each particle starts at a drawn vertex of its slick's outline."""
    f = footprint_arrays(footprint)
    keep = [c for c in particles.columns if c not in ("lat0", "lon0")]
    draw = mix(F.col("slick_id").cast("long"), F.col("particle_id"), F.lit(0).cast("long"),
               F.lit(_SEED).cast("long"))
    v = F.get("vertices", (draw % F.size("vertices")).cast("int"))
    # Particles made of few slicks look like a small table.
    return (particles.select(*keep).join(by_shuffle(f), "slick_id")
            .withColumns({"lat": v["lat"], "lon": v["lon"]}).drop("vertices"))


def integrate(e, n, t, seconds, velocity: Callable, sign: float, dt: float, diffusion: float,
              slick, particle, stream: int, first_step: int = 0):
    """Midpoint steps of at most ``dt`` until each particle's seconds are used up.

    ``velocity(e, n, t, active)`` gives (u, v) for the active subset. A particle's last
    step is its own remainder, and the random walk is scaled by the step taken.
    """
    e, n, t, left = e.copy(), n.copy(), t.copy(), seconds.astype(float).copy()
    steps = int(np.ceil(left.max() / dt)) if len(left) else 0
    for k in range(steps):
        a = np.flatnonzero(left > 0)
        h = np.minimum(left[a], dt)
        km = sign * h / 1000.0
        u, v = velocity(e[a], n[a], t[a], a)
        u, v = velocity(e[a] + 0.5 * km * u, n[a] + 0.5 * km * v, t[a] + 0.5 * sign * h, a)
        e[a], n[a] = e[a] + u * km, n[a] + v * km
        if diffusion > 0:
            sd = np.sqrt(2.0 * diffusion * h) / 1000.0
            g1, g2 = np_normal_pair(slick[a], particle[a], first_step + k, stream)
            e[a], n[a] = e[a] + sd * g1, n[a] + sd * g2
        t[a] = t[a] + sign * h
        left[a] = left[a] - h
    return e, n, t


def _to_km(p: pd.DataFrame):
    scale = KM_PER_DEG * np.cos(np.radians(p["lat0"].to_numpy()))
    return ((p["lon"] - p["lon0"]).to_numpy() * scale,
            (p["lat"] - p["lat0"]).to_numpy() * KM_PER_DEG, scale)


def _row_velocity(p: pd.DataFrame, custom: Callable | None):
    f = {c: p[c].to_numpy() for c in p.columns if p[c].dtype.kind in "fi"}

    def velocity(e, n, t, a):
        g = {k: v[a] for k, v in f.items()}
        return custom(g, e, n, t) if custom else field_velocity(g, e, n, t, np)

    return velocity


def _with_field(particles: DataFrame, field: DataFrame) -> DataFrame:
    """Particles next to the field row of their slick; ``found_`` is 1 where there is one.

    Particles made of few slicks look like a small table, and an inner join would broadcast them where the field is
    not known to be smaller. An outer one may send the field only; what found none is left out by ``_found``.
    """
    return particles.join(field.withColumn("found_", F.lit(1.0)), "slick_id", "left")


def _found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of ``_with_field`` without particles that have no field. A filter would make the join an inner one."""
    for p in batches:
        p = p[p["found_"] == 1.0].drop(columns="found_").reset_index(drop=True)
        if len(p):
            yield p


_PARTICLE = "slick_id long, particle_id long, lat double, lon double, t double"


def backtrack(particles: DataFrame, field: DataFrame, dt: float = STEP_S,
              diffusion: float = DIFFUSION, velocity: Callable | None = None) -> DataFrame:
    """Particles (slick_id, particle_id, lat, lon, lat0, lon0, t_detect, age_s) run back.

    Rows are independent, so a batch of particles of any slicks is advanced together. ``velocity(row, e, n, t)`` replaces
    the field; it gets the row's columns, the field's among them, as arrays.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in _found(batches):
            e, n, scale = _to_km(p)
            t0 = p["t_detect"].to_numpy(float)
            e, n, _ = integrate(e, n, t0, p["age_s"].to_numpy(), _row_velocity(p, velocity), -1.0,
                                dt, diffusion, p["slick_id"].to_numpy(),
                                p["particle_id"].to_numpy(), _BACK)
            yield pd.DataFrame({"slick_id": p["slick_id"], "particle_id": p["particle_id"],
                                "lat": p["lat0"] + n / KM_PER_DEG, "lon": p["lon0"] + e / scale,
                                "t": t0 - p["age_s"]})

    return drop_nonfinite(_with_field(particles, field).mapInPandas(run, _PARTICLE))


def drop_nonfinite(df: DataFrame) -> DataFrame:
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return df.where(ok("lat") & ok("lon"))


def forecast_frames(particles: DataFrame, field: DataFrame, hours: float = 24.0,
                    n_frames: int = N_FRAMES, diffusion: float = DIFFUSION,
                    velocity: Callable | None = None) -> DataFrame:
    """Positions of every particle in frames 0..n_frames; four steps between frames."""
    dt = hours * 3600.0 / (n_frames * 4)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in _found(batches):
            e, n, scale = _to_km(p)
            t0 = p["t_detect"].to_numpy(float)
            t, speed = t0.copy(), _row_velocity(p, velocity)
            ids = p["slick_id"].to_numpy(), p["particle_id"].to_numpy()
            for f in range(n_frames + 1):
                if f:
                    e, n, t = integrate(e, n, t, np.full(len(p), 4 * dt), speed, 1.0, dt, diffusion,
                                        *ids, _FORWARD, 4 * (f - 1))
                yield pd.DataFrame({
                    "slick_id": ids[0], "frame": f, "particle_id": ids[1], "t": t,
                    "hours": np.round((t - t0) / 3600.0, 2),
                    "lat": p["lat0"] + n / KM_PER_DEG, "lon": p["lon0"] + e / scale})

    return _with_field(particles, field).mapInPandas(
        run, "slick_id long, frame int, particle_id long, t double, hours double, lat double, lon double")


# ---------------------------------------------------------------- gridded currents

def still_water(grid: DataFrame) -> DataFrame:
    """Missing currents (land) become still water."""
    zero = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c)
    return grid.select(*[zero(c) if c in ("u", "v") else F.col(c) for c in grid.columns])


def grid_axes(grid: DataFrame) -> DataFrame:
    """Per slick: corner and spacing of its (regular) grid and its list of time slots."""
    g = grid.groupBy("slick_id").agg(
        F.min("lat").alias("g_lat"), F.min("lon").alias("g_lon"), F.min("yi").alias("y0"), F.min("xi").alias("x0"),
        (F.max("yi") - F.min("yi")).alias("my"), (F.max("xi") - F.min("xi")).alias("mx"), F.max("lat").alias("h_lat"), F.max("lon").alias("h_lon"),
        F.array_sort(F.collect_set(F.struct("t", "ti"))).alias("slots"))
    return g.select("slick_id", "g_lat", "g_lon", "y0", "x0", "my", "mx", "slots",
                    ((F.col("h_lat") - F.col("g_lat")) / F.col("my")).alias("d_lat"),
                    ((F.col("h_lon") - F.col("g_lon")) / F.col("mx")).alias("d_lon"))


def grid_cells(grid: DataFrame) -> DataFrame:
    """Each cell with the currents of its four corners: (slick_id, ti, yi, xi, u00..v11).

    A grid point is a corner of the four cells that touch it; a corner without a point is still water.
    """
    roles = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    c = grid.select("slick_id", "ti", "yi", "xi", "u", "v", roles.alias("r")).select(
        "slick_id", "ti", (F.col("yi") - F.col("r.i")).alias("yi"), (F.col("xi") - F.col("r.j")).alias("xi"), "u", "v", "r")
    corner = lambda k, i, j: F.coalesce(
        F.max(F.when((F.col("r.i") == i) & (F.col("r.j") == j), F.col(k))), F.lit(0.0)).alias(f"{k}{i}{j}")
    return c.groupBy("slick_id", "ti", "yi", "xi").agg(*[corner(k, i, j) for k in "uv" for i in (0, 1) for j in (0, 1)])


def grid_current_lookup(points: DataFrame, grid: DataFrame) -> DataFrame:
    """Points (slick_id, t, lat, lon, ...) with u, v: nearest slot, bilinear, clamped."""
    at = points.join(by_shuffle(grid_axes(grid)), "slick_id")
    slot = F.array_min(F.transform("slots", lambda s: F.struct(
        F.abs(s["t"] - F.col("t")).alias("d"), s["t"].alias("t"), s["ti"].alias("ti"))))
    frac = lambda x, lo, d, m: F.greatest(F.lit(0.0), F.least(
        (F.col(x) - F.col(lo)) / F.col(d), F.col(m).cast("double")))
    low = lambda f, m: F.least(F.floor(F.col(f)), F.col(m) - 1)
    at = (at.withColumns({"ti": slot["ti"], "fy": frac("lat", "g_lat", "d_lat", "my"),
                          "fx": frac("lon", "g_lon", "d_lon", "mx")})
          .withColumns({"yi": low("fy", "my"), "xi": low("fx", "mx")})
          .withColumns({"fy": F.col("fy") - F.col("yi"), "fx": F.col("fx") - F.col("xi"),
                        "yi": F.col("yi") + F.col("y0"), "xi": F.col("xi") + F.col("x0")}))

    def bilinear(k: str) -> Column:
        row = lambda i: (1 - F.col("fx")) * F.col(f"{k}{i}0") + F.col("fx") * F.col(f"{k}{i}1")
        return F.coalesce((1 - F.col("fy")) * row(0) + F.col("fy") * row(1), F.lit(0.0))

    return (at.join(by_shuffle(grid_cells(grid)), ["slick_id", "ti", "yi", "xi"], "left")
            .select(*points.columns, bilinear("u").alias("u"), bilinear("v").alias("v")))


def backtrack_grid(particles: DataFrame, grid: DataFrame, dt: float = STEP_S,
                   diffusion: float = DIFFUSION, wind_u: float = 0.0, wind_v: float = 0.0,
                   chunk: int = 4096) -> DataFrame:
    """Backward run on gridded currents, constant wind.

    A grid covers a few degrees and days around one slick, so it fits one row. Particles
    travel in chunks of a slick next to it: a slick with very many particles is many
    rows, not one group.
    """
    axes = grid_axes(grid)
    packed = (grid.groupBy("slick_id")
              .agg(F.array_sort(F.collect_list(F.struct("ti", "yi", "xi", "u", "v"))).alias("g"))
              .select("slick_id", F.col("g.u").alias("gu"), F.col("g.v").alias("gv"))
              .join(axes, "slick_id").withColumn("times", F.col("slots.t")).drop("slots"))
    cols = ["particle_id", "lat", "lon", "age_s"]
    chunks = (particles.withColumn("chunk", F.floor(F.col("particle_id") / chunk))
              .groupBy("slick_id", "chunk", "lat0", "lon0", "t_detect")
              .agg(F.collect_list(F.struct(*cols)).alias("p"))
              .select("slick_id", "lat0", "lon0", "t_detect",
                      *[F.col(f"p.{c}").alias(c) for c in cols]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                ny, nx = int(r.my) + 1, int(r.mx) + 1
                gu, gv = np.reshape(r.gu, (-1, ny, nx)), np.reshape(r.gv, (-1, ny, nx))
                times = np.asarray(r.times, float)
                scale = KM_PER_DEG * math.cos(math.radians(r.lat0))

                def velocity(e, n, t, a):
                    ti = np.abs(times[None, :] - t[:, None]).argmin(1)
                    fy = np.clip((r.lat0 + n / KM_PER_DEG - r.g_lat) / r.d_lat, 0, ny - 1)
                    fx = np.clip((r.lon0 + e / scale - r.g_lon) / r.d_lon, 0, nx - 1)
                    y, x = np.minimum(fy.astype(int), ny - 2), np.minimum(fx.astype(int), nx - 2)
                    fy, fx = fy - y, fx - x
                    at = lambda g: ((1 - fy) * ((1 - fx) * g[ti, y, x] + fx * g[ti, y, x + 1])
                                    + fy * ((1 - fx) * g[ti, y + 1, x] + fx * g[ti, y + 1, x + 1]))
                    return at(gu) + WIND_SHARE * wind_u, at(gv) + WIND_SHARE * wind_v

                ids, age = np.asarray(r.particle_id, np.int64), np.asarray(r.age_s, float)
                e0 = (np.asarray(r.lon, float) - r.lon0) * scale
                n0 = (np.asarray(r.lat, float) - r.lat0) * KM_PER_DEG
                e, n, _ = integrate(e0, n0, np.full(len(ids), r.t_detect), age, velocity, -1.0, dt,
                                    diffusion, np.full(len(ids), r.slick_id), ids, _BACK)
                yield pd.DataFrame({"slick_id": r.slick_id, "particle_id": ids,
                                    "lat": r.lat0 + n / KM_PER_DEG, "lon": r.lon0 + e / scale,
                                    "t": r.t_detect - age})

    return drop_nonfinite(spread(chunks.join(packed, "slick_id"), "slick_id", "particle_id")
                          .mapInPandas(run, _PARTICLE))


def choose_forcing(slicks: DataFrame, coverage: DataFrame, prefer: str = "auto") -> DataFrame:
    """One row per slick with the currents it gets, whether they are real, and why if they are not.

    ``coverage`` may list any number of grids for a slick: one that holds its place and time is enough, and
    the reason is that of the grid that comes nearest to it, place before time.
    """
    if prefer not in ("auto", "analytic", "gridded"):
        raise ValueError(f"unknown forcing {prefer!r}")
    c = coverage.select("slick_id", *[F.col(x).alias(f"c_{x}") for x in coverage.columns if x != "slick_id"])
    here = (F.col("lat0").between(F.col("c_lat_min"), F.col("c_lat_max"))
            & F.col("lon0").between(F.col("c_lon_min"), F.col("c_lon_max")))
    now = F.col("t_detect").between(F.col("c_t_min"), F.col("c_t_max"))
    reach = F.when(F.coalesce(here & now, F.lit(False)), 2).when(F.coalesce(here, F.lit(False)), 1).otherwise(0)
    # all grids of a slick are folded before its row is met again
    best = (slicks.select("slick_id", "lat0", "lon0", "t_detect").join(c, "slick_id")
            .groupBy("slick_id").agg(F.max(reach).alias("reach_")))
    reach = F.coalesce("reach_", F.lit(-1))
    use = (reach == 2) & F.lit(prefer != "analytic")
    why = (F.when(F.lit(prefer == "analytic") | use, F.lit(None).cast("string"))
           .when(reach == -1, "no gridded currents for this slick")
           .when(reach == 0, "place outside the grid").otherwise("time outside the grid"))
    out = slicks.join(best, "slick_id", "left").select(
        *slicks.columns, F.when(use, "gridded").otherwise("analytic").alias("forcing_source"),
        use.alias("realistic"), why.alias("fallback_reason"))
    if prefer == "gridded":
        # Asked for real currents: a slick without them is an error, raised where it is met.
        checked = F.when(F.col("fallback_reason").isNull(), F.col("forcing_source")).otherwise(
            F.raise_error(F.concat(F.lit("no gridded currents: "), F.col("fallback_reason"))))
        out = out.withColumn("forcing_source", checked.cast("string"))
    return out


# ---------------------------------------------------------------- read off the cloud

def particle_spread(particles: DataFrame, key: str = "slick_id") -> DataFrame:
    """Centroid and RMS distance in local km."""
    c = particles.groupBy(key).agg(F.avg("lat").alias("lat_c"), F.avg("lon").alias("lon_c"),
                                   F.count("*").alias("n_particles"))
    e, n = local_km("lat", "lon", "lat_c", "lon_c")
    r = (particles.select(key, "lat", "lon").join(c, key)
         .groupBy(key).agg(F.sqrt(F.avg(e * e + n * n)).alias("spread_km")))
    return c.join(r, key)


def heat_bounds(particles: DataFrame, key: str = "slick_id", pad: float = 0.15) -> DataFrame:
    b = particles.groupBy(key).agg(*[f("%s" % c).alias(f"{c}_{n}") for c in ("lat", "lon")
                                     for n, f in (("lo", F.min), ("hi", F.max))])
    grow = lambda c: F.greatest((F.col(f"{c}_hi") - F.col(f"{c}_lo")) * pad, F.lit(0.01))
    return b.select(key, *[x for c in ("lat", "lon") for x in (
        (F.col(f"{c}_lo") - grow(c)).alias(f"{c}_min"), (F.col(f"{c}_hi") + grow(c)).alias(f"{c}_max"))])


def gaussian_kernel(sigma: float = SIGMA) -> list[float]:
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def smoothing_matrix(bins: int, sigma: float) -> np.ndarray:
    """Gaussian smoothing of a line of ``bins`` values as a matrix; the edge is mirrored and repeated."""
    taps = gaussian_kernel(sigma)
    r = len(taps) // 2
    out, source = np.zeros((bins, bins)), np.arange(bins)
    for image in (source, -source - 1, 2 * bins - 1 - source):
        for k, w in zip(range(-r, r + 1), taps):
            to = image + k
            ok = (to >= 0) & (to < bins)
            np.add.at(out, (to[ok], source[ok]), w)
    return out


def heatmap(particles: DataFrame, key: str = "slick_id", bins: int = HEAT_BINS,
            sigma: float = SIGMA) -> DataFrame:
    """Cells (key, i, j, v) that the smoothed density reaches, peak 1; absent cells are 0.

    Particles are counted by cell before they are shuffled. A map has at most bins x bins cells, so one
    is an array, and both passes of the separable smoothing are products of it with one matrix.
    """
    idx = lambda c: F.least(F.floor((F.col(c) - F.col(f"{c}_min")) /
                                    (F.col(f"{c}_max") - F.col(f"{c}_min")) * bins),
                            F.lit(bins - 1)).cast("int")
    cells = (particles.join(heat_bounds(particles, key), key)
             .groupBy(key, idx("lat").alias("i"), idx("lon").alias("j"))
             .agg(F.count("*").cast("double").alias("v")))
    kind = to_arrow_type(cells.schema[key].dataType)

    def smooth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = smoothing_matrix(bins, sigma)
        for _, parts in groups(batches, 1):
            i, j, v = (np.concatenate([p.column(k).to_numpy() for p in parts]) for k in (1, 2, 3))
            m = np.zeros((bins, bins))
            m[i, j] = v
            m = line @ m @ line.T
            i, j = np.nonzero(m)
            name = pa.array([parts[0].column(0)[0].as_py()] * len(i), kind)
            yield pa.RecordBatch.from_arrays(
                [name, pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(m[i, j] / m.max())], [key, "i", "j", "v"])

    return (cells.repartition(key).sortWithinPartitions(key)
            .mapInArrow(smooth, f"{key} {dict(cells.dtypes)[key]}, i int, j int, v double"))


def heat_cells_visible(cells: DataFrame, bounds: DataFrame, key: str = "slick_id",
                       floor: float = 0.18, bins: int = HEAT_BINS) -> DataFrame:
    mid = lambda c, k: F.col(f"{c}_min") + (F.col(k) + 0.5) * (
        F.col(f"{c}_max") - F.col(f"{c}_min")) / bins
    return (cells.where(F.col("v") >= floor).join(bounds, key)
            .select(key, "i", "j", "v", mid("lat", "i").alias("lat"), mid("lon", "j").alias("lon")))


def origin_track(particles: DataFrame, key: str = "slick_id", nodes: int = TRACK_NODES) -> DataFrame:
    """(key, node, lat, lon, t): median position per release-time bin, closed at both ends.

    Bins with fewer than three particles are left out. Clouds smaller than ``nodes`` are
    returned particle by particle in time order.
    """
    span = particles.groupBy(key).agg(F.min("t").alias("t0"), F.max("t").alias("t1"),
                                      F.count("*").alias("n"))
    p = particles.select(key, "particle_id", "lat", "lon", "t").join(span, key)
    few = p.where(F.col("n") < nodes)
    w = Window.partitionBy(key).orderBy("t", "particle_id")
    small = few.select(key, (F.row_number().over(w) - 1).alias("node"), "lat", "lon", "t")

    step = (F.col("t1") - F.col("t0")) / nodes
    edge = lambda k: F.when(k == nodes, F.col("t1")).otherwise(F.col("t0") + k * step)
    home = F.floor((F.col("t") - F.col("t0")) / F.when(step > 0, step))
    near = F.when(home.isNull(), F.sequence(F.lit(0), F.lit(nodes - 1)).cast("array<bigint>")).otherwise(
        F.array(home - 1, home, home + 1))
    binned = (p.where(F.col("n") >= nodes).withColumn("node", F.explode(near))
              .where(F.col("node").between(0, nodes - 1)
                     & F.col("t").between(edge(F.col("node")), edge(F.col("node") + 1))))
    binned = cut_lineage(binned)
    bins = (binned.groupBy(key, "node")
            .agg(F.count("*").alias("c"), F.first((edge(F.col("node")) + edge(F.col("node") + 1)) * 0.5)
                 .alias("t")).where("c >= 3"))
    mid = lambda c: exact_percentiles(binned, [key, "node"], c, {c: 0.5})
    big = bins.join(mid("lat"), [key, "node"]).join(mid("lon"), [key, "node"])
    return big.select(key, F.col("node").cast("int"), "lat", "lon", "t").unionByName(small)


def time_window(slicks: DataFrame) -> DataFrame:
    """Earliest, most likely and latest release from the age range."""
    lo = F.greatest(F.coalesce("lo_h", F.col("age_h") / 3.0), F.lit(0.1))
    hi = F.greatest(F.coalesce("hi_h", F.col("age_h") * 3.0), lo + 0.1)
    at = lambda h: F.col("t_detect") - h * 3600.0
    return slicks.select("slick_id", at(hi).alias("earliest"), at(F.col("age_h")).alias("most_likely"),
                         at(lo).alias("latest"))


def hindcast(slicks: DataFrame, footprint: DataFrame, field: DataFrame | None = None,
             grid: DataFrame | None = None, n_particles: int = N_PARTICLES,
             diffusion: float = DIFFUSION, velocity: Callable | None = None,
             coverage: DataFrame | None = None, prefer: str = "auto") -> dict[str, DataFrame]:
    """Backward ensemble of many slicks: particles, spread, heat map, track, window.

    Slicks with a grid run on it, the others on their field row. With ``coverage`` (see ``choose_forcing``) only
    slicks that their grid reaches run on it, and ``forcing`` says for each what it ran on and why.
    """
    chosen = None
    if coverage is not None:
        at = slicks if "lat0" in slicks.columns else slicks.join(
            footprint.groupBy("slick_id").agg(F.avg("lat").alias("lat0"), F.avg("lon").alias("lon0")), "slick_id")
        # a grid that is not given reaches nobody
        given = (coverage.where(F.lit(False)) if grid is None
                 else coverage.join(grid.select("slick_id").distinct(), "slick_id", "left_semi"))
        chosen = choose_forcing(at, given, prefer).select("slick_id", "forcing_source", "realistic", "fallback_reason")
        if grid is not None:
            grid = grid.join(chosen.where("realistic").select("slick_id"), "slick_id", "left_semi")
    seeds = spread(seed_particles(expand_ages(slicks, n_particles), footprint),
                   "slick_id", "particle_id")
    parts = []
    if grid is not None:
        water = still_water(grid)
        parts.append(backtrack_grid(seeds.join(water.select("slick_id").distinct(), "slick_id",
                                               "left_semi"), water, diffusion=diffusion))
        seeds = seeds.join(water.select("slick_id").distinct(), "slick_id", "left_anti")
    if field is not None:
        parts.append(backtrack(seeds, field, diffusion=diffusion, velocity=velocity))
    cloud = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # The cloud is read by four aggregates: written once rather than integrated four times.
    cloud = cut_lineage(cloud)
    out = {"particles": cloud, "spread": particle_spread(cloud), "bounds": heat_bounds(cloud),
           "heat": heatmap(cloud), "track": origin_track(cloud), "window": time_window(slicks)}
    if chosen is not None:
        out["forcing"] = chosen
    return out


def origin_report(h: dict[str, DataFrame], slicks: DataFrame, bins: int = HEAT_BINS) -> DataFrame:
    """One row per slick with everything a map layer needs, rounded for output.

    Particles go out in chunks elsewhere (``particles``); the row holds the heat map as a
    sparse list of cells and the track.
    """
    key = "slick_id"
    cells = h["heat"].groupBy(key).agg(F.array_sort(F.collect_list(F.struct(
        "i", "j", F.round("v", 6).alias("v")))).alias("heat_cells"))
    track = h["track"].groupBy(key).agg(F.array_sort(F.collect_list(F.struct(
        "node", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), "t"))).alias("track"))
    b = h["bounds"].select(key, *[F.round(c, 5).alias(c) for c in
                                  ("lat_min", "lat_max", "lon_min", "lon_max")])
    out = h["spread"].join(h["forcing"], key, "left") if "forcing" in h else h["spread"]
    return (out.withColumn("spread_km", F.round("spread_km", 2))
            .join(b, key).join(cells, key).join(track, key, "left").join(h["window"], key)
            .join(slicks.select(key, F.col("bearing").alias("slick_bearing_deg")), key)
            .withColumn("bins", F.lit(bins)))
