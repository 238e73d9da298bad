"""The catalogue's queries in plain SQL, written apart from the Spark jobs."""
from __future__ import annotations

from ..functions.evidence import WEIGHTS
from ..functions.titles import NAME_TOKEN, OIL_HINTS, PREFIXED, SEPARATOR, STOP_WORDS, VESSEL_HINTS
from ..operators.drift import gaussian_kernel
from ..operators.raster import CLASSES, PALETTE
from ..operators.regions import PERIMETER_CODES
from ..operators.requests import REGIONS
from ..plans.catalog import BOX, NOW, RANGE, THRESHOLDS
from ..plans.context import DEMO_MODEL
from ..sources import demo

P = 2147483647
PI = "3.141592653589793e0"


def num(x: float) -> str:
    return f"({float(x)!r}::double)"


def hav(a: str, b: str, c: str, d: str) -> str:
    return (f"(2*6371.0088e0*asin(sqrt(least(1e0,greatest(0e0,pow(sin((radians({c})-radians({a}))/2e0),2)"
            f"+cos(radians({a}))*cos(radians({c}))*pow(sin(radians(({d})-({b}))/2e0),2))))))")


def mod(x: str, n: str) -> str:
    return f"(({x}) - ({n})*floor(({x})/({n})))"


def mix(s: str, p: str, step: str, stream: int) -> str:
    h = f"((({s})%1000003*7919+({p})%1000003*104729+({step})*1299709+{stream}*15485863)%{P})"
    h = f"(((({h}*{h}+12345)%{P})*48271+{h})%{P})"
    return f"(({h}*{h}+6789)%{P})"


def uni(s: str, p: str, step: str, stream: int) -> str:
    return f"(({mix(s, p, step, stream)}+5e-1)/{P}e0)"


def normals(s: str, p: str, step: str, stream: int) -> tuple[str, str]:
    u1, u2 = uni(s, p, step, stream), uni(s, p, step, stream + 1)
    rad, ang = f"sqrt(-2e0*ln({u1}))", f"(2e0*pi()*{u2})"
    return f"({rad}*cos({ang}))", f"({rad}*sin({ang}))"


def within_range(col: str, lo: float, hi: float) -> str:
    return f"{col} between {num(lo)} and {num(hi)}"


V: dict[str, tuple[list[str], str]] = dict(demo.VIEWS)

# ------------------------------------------------------------------ tracks and origins

V["tracks"] = (["ais"], """select * exclude (k) from (
    select *, row_number() over (partition by mmsi, t order by ord) as k from ais) where k = 1""")

V["osum"] = (["origin_sample"], f"""
    select b.*, s.spread_km, lat_lo-(65e0+spread_km)/111.32e0 as lat_min, lat_hi+(65e0+spread_km)/111.32e0 as lat_max,
      lon_lo-(65e0+spread_km)/greatest(111.32e0*cos(radians(lat_c)),1e-6) as lon_min,
      lon_hi+(65e0+spread_km)/greatest(111.32e0*cos(radians(lat_c)),1e-6) as lon_max
    from (select origin_id, count(*) as n_samples, avg(lat) as lat_c, avg(lon) as lon_c, quantile_cont(t, 0.5) as t_center,
            min(t) as t0, max(t) as t1, min(lat) as lat_lo, max(lat) as lat_hi, min(lon) as lon_lo, max(lon) as lon_hi
          from origin_sample group by origin_id) b
    join (select origin_id, sqrt(avg(pow({hav('lat', 'lon', 'mlat', 'mlon')}, 2))) as spread_km
          from (select *, avg(lat) over (partition by origin_id) as mlat, avg(lon) over (partition by origin_id) as mlon
                from origin_sample) group by origin_id) s using (origin_id)""")

V["near"] = (["ais", "osum"], """
    select o.origin_id, o.lat_c, o.lon_c, o.t0, o.t1, o.spread_km, a.* from osum o join ais a
      on a.t between o.t0 - 43200e0 and o.t1 + 7200e0 and a.lat between lat_min and lat_max
      and a.lon between lon_min and lon_max""")

V["seq"] = (["near"], """
    select *, row_number() over (partition by origin_id, mmsi order by t) as rn from (
      select *, row_number() over (partition by origin_id, mmsi, t order by ord) as k from near) where k = 1""")

_kn = f"{hav('w.alat', 'w.alon', 's.lat', 's.lon')}/1.852e0/((s.t-w.at)/3600e0)"
V["walk"] = (["seq"], f"""
    select origin_id, mmsi, rn, t as at, lat as alat, lon as alon, true as ok from seq where rn = 1
    union all
    select s.origin_id, s.mmsi, s.rn, case when {_kn} > 60 then w.at else s.t end,
      case when {_kn} > 60 then w.alat else s.lat end, case when {_kn} > 60 then w.alon else s.lon end, not ({_kn} > 60)
    from walk w join seq s on s.origin_id = w.origin_id and s.mmsi = w.mmsi and s.rn = w.rn + 1""")
V["clean"] = (["walk", "seq"], """
    select seq.* exclude (rn, k) from seq join walk using (origin_id, mmsi, rn) where ok""")

V["cand"] = (["clean"], f"""
    select origin_id, mmsi, count(*) as n_fixes,
      min(case when t between t0-21600e0 and t1+21600e0 then {hav('lat', 'lon', 'lat_c', 'lon_c')} end) as near_km,
      25e0 + max(spread_km) as reach_km
    from clean group by origin_id, mmsi having count(*) >= 2
      and min(case when t between t0-21600e0 and t1+21600e0 then {hav('lat', 'lon', 'lat_c', 'lon_c')} end) <= 25e0 + max(spread_km)""")

V["cfix"] = (["clean", "cand"], "select clean.* from clean semi join cand using (origin_id, mmsi)")


def asof(src: str, fixes: str, keys: list[str]) -> str:
    on = lambda f: " and ".join(f"s.{k} = {f}.{k}" for k in keys)
    return f"""
      select s.*, p.t as pt, p.lat as plat, p.lon as plon, p.sog as psog, p.cog as pcog,
        n.t as nt, n.lat as nlat, n.lon as nlon, n.sog as nsog, n.cog as ncog
      from {src} s asof left join {fixes} p on {on('p')} and s.t >= p.t
        asof left join {fixes} n on {on('n')} and s.t <= n.t"""


def between_fixes(c: str) -> str:
    return (f"case when pt is null then n{c} when nt is null then p{c} when nt > pt "
            f"then p{c} + (n{c}-p{c})*((t-pt)/(nt-pt)) else p{c} end")


def closer(c: str) -> str:
    return f"case when pt is not null and (nt is null or t-pt < nt-t) then p{c} else n{c} end"


NEAREST = "least(t-pt, nt-t)"
IN_GAP = "coalesce(pt < t and t < nt and nt-pt > 900, false)"

V["pairs"] = (["origin_sample"], """
    select 200000000 + cast(floor(origin_id/100e0) as bigint)*150 + sample_id%150 as mmsi, sample_id, t from origin_sample""")
V["positions"] = (["pairs", "tracks"], f"""
    select a.*, {between_fixes('lat')} as at_lat, {between_fixes('lon')} as at_lon,
      case when c.n = 1 then abs(t - coalesce(pt, nt)) < 3600 else pt is not null and nt is not null end as covered,
      {closer('sog')} as at_sog, {closer('cog')} as at_cog, {NEAREST} as nearest_s, {IN_GAP} as in_gap
    from ({asof('pairs', 'tracks', ['mmsi'])}) a
    left join (select mmsi, count(*) as n from tracks group by mmsi) c using (mmsi)""")

V["vs"] = (["cand", "origin_sample"], """
    select c.origin_id, c.mmsi, s.sample_id, s.t, s.lat as s_lat, s.lon as s_lon
    from cand c join origin_sample s using (origin_id)""")
V["vd"] = (["vs", "cfix"], f"""
    select *, case when pt is not null and nt is not null then
      {hav(between_fixes('lat'), between_fixes('lon'), 's_lat', 's_lon')} end as d
    from ({asof('vs', 'cfix', ['origin_id', 'mmsi'])})""")

V["feat"] = (["vd", "cfix", "cand", "origin"], f"""
    select f.origin_id, f.mmsi, st.name, st.vtype, st.length, f.n_fixes,
      prox_score, min_dist_km, mean_dist_km, dwell_frac, time_gap_min, slow_steaming,
      case when sog_missing or slow_n = 0 then 0e0 else coalesce(1-sqrt(cx*cx+cy*cy), 0)*slow_share end as loiter_score,
      least(coalesce(gap_max, 0e0)/60, 1440e0) as ais_gap_max_min, gap_over_origin,
      least(1e0, greatest(0e0, coalesce(dark, 0e0)/greatest(f.t1-f.t0, 1e0))) as dark_frac,
      coalesce(pow(cos(radians({mod('ccog - bearing + 180e0', '360e0')} - 180e0)), 2), 5e-1) as course_align,
      coalesce(csog, 6e0) as cpa_sog_kn,
      case when st.vtype is null then 4e-1 when v between 80 and 89 then 1e0 when v between 70 and 79 then 85e-2
        when v = 30 then 35e-2 when v between 31 and 32 then 6e-1 when v between 50 and 59 then 45e-2
        when v between 60 and 69 then 4e-1 when v between 40 and 49 then 25e-2 when v between 36 and 37 then 12e-2
        else 4e-1 end as vtype_prior,
      case when st.length > 0 then least(1e0, greatest(0e0, log10(st.length/10e0)/log10(40e0))) else 35e-2 end as size_score
    from (select origin_id, mmsi, avg(exp(-coalesce(d, 1e6)/5e0)) as prox_score, least(coalesce(min(d), 500e0), 500e0) as min_dist_km,
            coalesce(avg(case when d > 200 then 200e0 else d end), 500e0) as mean_dist_km, least(min({NEAREST})/60e0, 1440e0) as time_gap_min,
            avg(case when {IN_GAP} and d <= 25 then 1e0 else 0e0 end) as gap_over_origin
          from vd group by origin_id, mmsi) s
    join (select origin_id, mmsi, count(*) as n_fixes, any_value(t0) as t0, any_value(t1) as t1,
            coalesce(avg(case when win then case when {hav('lat', 'lon', 'lat_c', 'lon_c')} <= 25 then 1e0 else 0e0 end end), 0e0) as dwell_frac,
            coalesce(avg(case when win and sog is not null then case when sog between 2 and 9 then 1e0 else 0e0 end end), 0e0) as slow_steaming,
            coalesce(avg(case when win and sog is not null then case when sog < 5 then 1e0 else 0e0 end end), 0e0) as slow_share,
            count(*) filter (win and sog < 5) as slow_n, coalesce(bool_or(win and sog is null), false) as sog_missing,
            avg(cos(radians(cog))) filter (win and sog < 5) as cx, avg(sin(radians(cog))) filter (win and sog < 5) as cy,
            max(case when g1-t > 900 and g1 > t0-10800 and t < t1+10800 then g1-t end) as gap_max,
            sum(case when g1-t > 900 then greatest(0e0, least(g1, t1)-greatest(t, t0)) end) as dark
          from (select *, t between t0-10800 and t1+10800 as win,
                  lead(t) over (partition by origin_id, mmsi order by t) as g1 from cfix) group by origin_id, mmsi) f using (origin_id, mmsi)
    join (select origin_id, mmsi, coalesce(arg_min(name, t) filter (lower(name) not in ('', 'nan', 'none')), '') as name,
            arg_min(vtype, t) as vtype, arg_min(length, t) as length, cast(arg_min(vtype, t) as int) as v
          from cfix group by origin_id, mmsi) st using (origin_id, mmsi)
    join (select origin_id, mmsi, cpa.c as ccog, cpa.s as csog from (
          select origin_id, mmsi, arg_min(struct_pack(c := {closer('cog')}, s := {closer('sog')}), (d, sample_id)) filter (d is not null) as cpa
          from vd group by origin_id, mmsi)) c using (origin_id, mmsi)
    join origin using (origin_id)""")

TERMS = {
    "prox": "prox_score", "near": "exp(-min_dist_km/8e0)", "dwell": "dwell_frac", "timing": "exp(-time_gap_min/45e0)",
    "slow": "slow_steaming", "loiter": "loiter_score", "dark_gap": "gap_over_origin", "dark_frac": "dark_frac",
    "axis": "2e0*(course_align-5e-1)", "vtype": "vtype_prior", "size": "size_score"}
LABEL = """case when vtype is null then 'Vessel type unknown' when cast(vtype as int) between 80 and 89 then 'Tanker'
    when cast(vtype as int) between 70 and 79 then 'Cargo vessel' when cast(vtype as int) = 30 then 'Fishing vessel'
    when cast(vtype as int) between 31 and 32 then 'Towing vessel' when cast(vtype as int) between 50 and 59 then 'Special craft'
    when cast(vtype as int) between 60 and 69 then 'Passenger vessel' when cast(vtype as int) in (36, 37) then 'Sailing / pleasure craft'
    else concat('Vessel type ', cast(vtype as int)) end"""
f0 = lambda x: f"format('{{:.0f}}', ({x})::double)"
f1 = lambda x: f"format('{{:.1f}}', ({x})::double)"
SENTENCES = {
    "prox": "'Position overlaps the estimated discharge point'",
    "near": f"concat('Passed within ', {f1('min_dist_km')}, ' km of the origin')",
    "dwell": f"concat('Spent ', {f0('dwell_frac*100')}, '% of the window inside the search radius')",
    "timing": f"concat('AIS fix within ', {f0('time_gap_min')}, ' min of the discharge time')",
    "slow": f"concat('Slow-steaming (', {f0('slow_steaming*100')}, '% of fixes at 2-9 kn)')",
    "loiter": "'Low-speed manoeuvring with unstable heading'",
    "dark_gap": f"case when gap_over_origin > 0 then concat('AIS went dark over the origin (', {f0('ais_gap_max_min')}, ' min)') end",
    "dark_frac": f"concat('Reporting gaps cover ', {f0('dark_frac*100')}, '% of the discharge window')",
    "axis": "'Course aligns with the slick''s long axis'",
    "vtype": f"concat({LABEL}, ' -- elevated prior for oil discharge')",
    "size": f"case when length is not null then concat('Large vessel (', {f0('length')}, ' m)') end"}


def score_sql(weights: dict[str, float], bias: float) -> str:
    return " + ".join([num(bias)] + [f"{num(w)}*({TERMS[k]})" for k, w in weights.items()])


V["evid"] = (["feat"], " union all ".join(
    f"select origin_id, mmsi, {i} as pos, {num(w)}*({TERMS[k]}) as c, {SENTENCES[k]} as s from feat"
    for i, (k, w) in enumerate(WEIGHTS.items())))
V["susp"] = (["feat", "evid"], f"""
    select * exclude (z), 100e0*z/sum(z) over (partition by origin_id) as attribution_pct from (
    select *, row_number() over (partition by origin_id order by score desc, mmsi)::int as rank,
      exp(score - max(score) over (partition by origin_id)) as z
    from (select feat.*, {score_sql(WEIGHTS, -3.2)} as score, 1/(1+exp(-({score_sql(WEIGHTS, -3.2)}))) as prob,
            coalesce(e.evidence, 'Present in the area, but no distinguishing evidence') as evidence
          from feat left join (
            select origin_id, mmsi, string_agg(s, ' | ' order by k) as evidence from (
              select *, row_number() over (partition by origin_id, mmsi order by c desc, pos) as k from evid
              where c >= 25e-2 and s is not null) where k <= 4 group by origin_id, mmsi) e using (origin_id, mmsi)))""")
V["learned"] = (["feat"], f"""
    select origin_id, mmsi, row_number() over (partition by origin_id order by
      {' + '.join(f'{num(w)}*{k}' for k, w in DEMO_MODEL.items())} desc, mmsi)::int as learned_rank from feat""")
V["counts"] = (["clean", "cand", "origin_sample"], """
    select o.origin_id, coalesce(n, 0) as n_screened, coalesce(k, 0) as n_candidates
    from (select distinct origin_id from origin_sample) o
    left join (select origin_id, count(distinct mmsi) as n from clean group by origin_id) c using (origin_id)
    left join (select origin_id, count(*) as k from cand group by origin_id) d using (origin_id)""")


def track_sql(src: str, key: str) -> str:
    return f"""
    select {key}, node::int as node, median(lat) as lat, median(lon) as lon, any_value((e0+e1)*5e-1) as t from (
      select p.*, k as node, t0+k*(t1-t0)/12 as e0, case when k = 11 then t1 else t0+(k+1)*(t1-t0)/12 end as e1
      from (select *, min(t) over (partition by {key}) as t0, max(t) over (partition by {key}) as t1,
              count(*) over (partition by {key}) as n from {src}) p, range(12) g(k))
    where n >= 12 and t between e0 and e1 group by {key}, node having count(*) >= 3
    union all
    select {key}, (row_number() over (partition by {key} order by t, {'sample_id' if key == 'origin_id' else 'particle_id'}) - 1)::int, lat, lon, t
    from (select *, count(*) over (partition by {key}) as n from {src}) where n < 12"""


V["otrack"] = (["origin_sample"], track_sql("origin_sample", "origin_id"))
V["ptrack"] = (["cloud"], track_sql("cloud", "slick_id"))
V["tn"] = (["cand", "otrack"], """
    select c.origin_id, c.mmsi, o.node, o.t, o.lat as s_lat, o.lon as s_lon from cand c join otrack o using (origin_id)""")
V["match"] = (["tn", "cfix", "osum", "cand"], f"""
    select origin_id, mmsi, coalesce(m, 0e0) as track_match from cand left join (
      select origin_id, mmsi, avg(case when pt is not null and nt is not null then
        exp(-{hav(between_fixes('lat'), between_fixes('lon'), 's_lat', 's_lon')}/greatest(spread_km*6e-1, 5e0)) else 0e0 end) as m
      from ({asof('tn', 'cfix', ['origin_id', 'mmsi'])}) join (select origin_id, spread_km from osum) using (origin_id) group by origin_id, mmsi)
    using (origin_id, mmsi)""")
V["truthrank"] = (["truth", "susp"], """
    select t.origin_id, t.truth_mmsi, s.rank, coalesce(s.attribution_pct, 0e0) as attribution_pct, coalesce(n, 0) as n_candidates
    from truth t left join susp s on s.origin_id = t.origin_id and s.mmsi = t.truth_mmsi
    left join (select origin_id, count(*) as n from susp group by origin_id) c on c.origin_id = t.origin_id""")

# ------------------------------------------------------------------ drift

V["ages"] = (["slick_drift"], """
    select slick_id, particle_id, t_detect, exp(ln(lo) + ((particle_id+5e-1)*0.6180339887e0 - floor((particle_id+5e-1)*0.6180339887e0))*(ln(hi)-ln(lo)))*3600e0 as age_s
    from (select *, greatest(coalesce(hi_h, age_h*3e0), lo+1e-1) as hi, unnest(range(600)) as particle_id
          from (select *, greatest(coalesce(lo_h, age_h/3e0), 1e-1) as lo from slick_drift))""")
V["seeds"] = (["ages", "footprint"], f"""
    select a.*, f.lat, f.lon, lat0, lon0 from (
      select a.*, c.n, c.lat0, c.lon0, {mix('a.slick_id', 'particle_id', '0', 9)} % c.n as pick
      from ages a join (select slick_id, count(*) as n, avg(lat) as lat0, avg(lon) as lon0 from footprint group by slick_id) c using (slick_id)) a
    join (select *, row_number() over (partition by slick_id order by vertex)-1 as idx from footprint) f
      on f.slick_id = a.slick_id and f.idx = a.pick""")


def vel(e: str, n: str, t: str) -> tuple[str, str]:
    tide = f"tide*sin(2e0*pi()*({t})/44712e0 + phase)"
    u = (f"bg_u - eddy*cos(({e})/l1)*cos(({n})/l1) - 5e-1*eddy*cos(({e})/l2+phase)*cos(({n})/l2) + {tide}"
         f" + 3e-2*wind_speed*cos(wind_dir+veer*({t}))")
    v = (f"bg_v - eddy*sin(({e})/l1)*sin(({n})/l1) - 5e-1*eddy*sin(({e})/l2+phase)*sin(({n})/l2)"
         f" + 3e-2*wind_speed*sin(wind_dir+veer*({t}))")
    return u, v


def march(name: str, seconds: str, sign: int, dt: str, stream: int, noise: bool = True, flow=vel) -> str:
    """Recursive midpoint walk over ``seeds``; one row per particle and step."""
    cols = "bg_u, bg_v, eddy, l1, l2, phase, tide, wind_speed, wind_dir, veer"
    u1, v1 = flow("e", "n", "t")
    u2, v2 = flow("em", "nm", f"t + ({sign})*5e-1*h")
    g1, g2 = normals("slick_id", "particle_id", "k", stream)
    wob = lambda g: f" + sqrt(2e0*h)/1000e0*{g}" if noise else ""
    return f"""
    select s.slick_id, particle_id, 0 as k, (lon-lon0)*111.32e0*cos(radians(lat0)) as e, (lat-lat0)*111.32e0 as n,
      t_detect as t, {seconds} as rest, lat0, lon0, t_detect from seeds s
    union all
    select slick_id, particle_id, k+1, e + ({u2})*km{wob(g1)}, n + ({v2})*km{wob(g2)},
      t + ({sign})*h, rest-h, lat0, lon0, t_detect
    from (select *, e + 5e-1*km*u1 as em, n + 5e-1*km*v1 as nm from (
      select *, {u1} as u1, {v1} as v1, ({sign})*h/1000e0 as km from (
        select w.*, least(rest, {dt}) as h, {cols} from {name} w join field using (slick_id) where rest > 1e-9)))"""


_end = "lat0 + n/111.32e0 as lat, lon0 + e/(111.32e0*cos(radians(lat0))) as lon"
V["back"] = (["seeds", "field"], march("back", "age_s", -1, "900e0", 1))
V["cloud"] = (["back"], f"select slick_id, particle_id, {_end}, t_detect - age as t from (select *, max(rest) over (partition by slick_id, particle_id) as age from back) where rest <= 1e-9")
V["plain"] = (["seeds", "field"], march("plain", "age_s", -1, "900e0", 1, False, lambda e, n, t: ("bg_u", "bg_v")))
V["plaincloud"] = (["plain"], V["cloud"][1].replace("from back", "from plain"))
V["ahead"] = (["seeds", "field"], march("ahead", "86400e0", 1, "1800e0", 5))
V["psum"] = (["cloud"], """
    select slick_id, lat_c, lon_c, count(*) as n_particles, sqrt(avg(pow((lon-lon_c)*111.32e0*cos(radians(lat_c)), 2) + pow((lat-lat_c)*111.32e0, 2))) as spread_km
    from (select *, avg(lat) over (partition by slick_id) as lat_c, avg(lon) over (partition by slick_id) as lon_c from cloud)
    group by slick_id, lat_c, lon_c""")
V["hb"] = (["cloud"], """
    select slick_id, a-greatest((b-a)*15e-2, 1e-2) as lat_min, b+greatest((b-a)*15e-2, 1e-2) as lat_max,
      c-greatest((d-c)*15e-2, 1e-2) as lon_min, d+greatest((d-c)*15e-2, 1e-2) as lon_max
    from (select slick_id, min(lat) as a, max(lat) as b, min(lon) as c, max(lon) as d from cloud group by slick_id)""")
_taps = ", ".join(f"({k}, {num(w)})" for k, w in zip(range(-5, 6), gaussian_kernel()))
# Gather form: each target looks up its eleven sources, mirrored at the edge.
_mirror = lambda x: f"(case when {x} < 0 then -({x})-1 when {x} > 63 then 127-({x}) else {x} end)"
V["hcell"] = (["cloud", "hb"], """
    select slick_id, least(floor((lat-lat_min)/(lat_max-lat_min)*64e0), 63)::int as i,
      least(floor((lon-lon_min)/(lon_max-lon_min)*64e0), 63)::int as j, count(*)::double as v
    from cloud join hb using (slick_id) group by all""")
V["hrow"] = (["hcell"], f"""
    select c.slick_id, g.i, c.j, sum(c.v*w) as v from range(64) g(i), (values {_taps}) tap(k, w), hcell c
    where c.i = {_mirror('(g.i+k)')} group by all""")
V["hraw"] = (["hrow"], f"""
    select c.slick_id, c.i, g.j, sum(c.v*w) as v from range(64) g(j), (values {_taps}) tap(k, w), hrow c
    where c.j = {_mirror('(g.j+k)')} group by all""")
V["heat"] = (["hraw"], "select slick_id, i::int as i, j::int as j, v/max(v) over (partition by slick_id) as v from hraw")
V["win"] = (["slick_drift"], """
    select slick_id, t_detect - greatest(coalesce(hi_h, age_h*3e0), lo+1e-1)*3600e0 as earliest, t_detect - age_h*3600e0 as most_likely,
      t_detect - lo*3600e0 as latest, bearing from (select *, greatest(coalesce(lo_h, age_h/3e0), 1e-1) as lo from slick_drift)""")
V["grid"] = (["current_grid"], """
    select * replace (case when isnan(u) then 0e0 else u end as u, case when isnan(v) then 0e0 else v end as v) from current_grid""")

# ------------------------------------------------------------------ regions


def closure(px: str, name: str) -> dict[str, tuple[list[str], str]]:
    """Views that label the 8-connected regions of the pixels in ``px`` through runs."""
    return {
        f"{name}_run": ([px], f"""
            select scene_id, row, min(col) as c0, max(col) as c1, row*16777216+min(col) as id from (
              select scene_id, row, col, col - row_number() over (partition by scene_id, row order by col) as g from {px})
            group by scene_id, row, g"""),
        f"{name}_edge": ([f"{name}_run"], f"""
            select a.scene_id, a.id as x, b.id as y from {name}_run a join {name}_run b
              on a.scene_id = b.scene_id and abs(a.row-b.row) = 1 and a.c0 <= b.c1+1 and b.c0 <= a.c1+1"""),
        f"{name}_reach": ([f"{name}_run", f"{name}_edge"], f"""
            select scene_id, id as x, id as root from {name}_run
            union
            select e.scene_id, e.y, r.root from {name}_reach r join {name}_edge e on e.scene_id = r.scene_id and e.x = r.x and r.root < e.y"""),
        f"{name}": ([px, f"{name}_run", f"{name}_reach"], f"""
            select p.scene_id, p.row, p.col, m.label from {px} p join {name}_run r
              on r.scene_id = p.scene_id and r.row = p.row and p.col between r.c0 and r.c1
            join (select scene_id, x, min(root) as label from {name}_reach group by scene_id, x) m on m.scene_id = r.scene_id and m.x = r.id"""),
    }


V["oil"] = (["mask"], "select scene_id, row, col from mask where cls = 1")
V |= closure("oil", "oil_lab")
_size = "(select scene_id, label, count(*) as n from {0} group by scene_id, label)"
V["kept"] = (["oil_lab"], f"select scene_id, row, col from oil_lab join {_size.format('oil_lab')} using (scene_id, label) where n >= 60")
V["rest"] = (["mask", "kept"], "select scene_id, row, col from mask anti join kept using (scene_id, row, col) where scene_id in (select scene_id from kept)")
V |= closure("rest", "rest_lab")
V["final"] = (["kept", "rest_lab"], f"""
    select * from kept union all
    select scene_id, row, col from rest_lab join {_size.format('rest_lab')} using (scene_id, label) where n < 60""")
V |= closure("final", "lab")
V["meas"] = (["lab", "scene"], f"""
    select *, 4e0*sqrt(l1)*px as major_m, 4e0*sqrt(l2)*px as minor_m, case when l1 > 0 then sqrt(1-l2/l1) else 0e0 end as eccentricity,
      {mod("-degrees(case when abs(vr-vc) < 2e-9 and cv = 0 then -pi()/4 else 5e-1*atan2(2e0*cv, vr-vc) end)", "180e0")} as azimuth,
      case when 4e0*sqrt(l2)*px > 1e-6 then sqrt(l1)/sqrt(l2) end as elongation
    from (select *, (vr+vc)/2 + sqrt(pow((vr-vc)/2, 2)+cv*cv) as l1, greatest((vr+vc)/2 - sqrt(pow((vr-vc)/2, 2)+cv*cv), 0e0) as l2
      from (select scene_id, label, count(*) as area_px, count(*)*any_value(pixel_size_m)*any_value(pixel_size_m) as area_m2, any_value(pixel_size_m) as px,
              avg(row) as row_c, avg(col) as col_c, var_pop(row::double) as vr, var_pop(col::double) as vc, case when abs(covar_pop(row::double, col::double)) < 1e-9 then 0e0 else covar_pop(row::double, col::double) end as cv
            from lab join scene using (scene_id) group by scene_id, label))""")
V["bord"] = (["lab"], """
    select * from lab where (scene_id, row, col) not in (
      select (a.scene_id, a.row, a.col) from (
        select scene_id, label, row + dr as row, col + dc as col from lab, (values (0, 1), (0, -1), (1, 0), (-1, 0)) s(dr, dc)) a
      join lab b on a.scene_id = b.scene_id and a.row = b.row and a.col = b.col and a.label = b.label
      group by a.scene_id, a.row, a.col having count(*) = 4)""")
_w = " ".join(f"when {c} then {num(w)}" for c, w in PERIMETER_CODES.items())
V["peri"] = (["bord"], f"""
    select scene_id, label, sum(case code {_w} else 0e0 end) as perimeter_px from (
      select a.scene_id, a.label, a.row, a.col, 1 + coalesce(sum(w), 0)::bigint as code from bord a left join (
        select scene_id, label, row + dr as row, col + dc as col, case when dr = 0 or dc = 0 then 2 else 10 end as w
        from bord, (values (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) s(dr, dc)) b
        on a.scene_id = b.scene_id and a.label = b.label and a.row = b.row and a.col = b.col
      group by a.scene_id, a.label, a.row, a.col) group by scene_id, label""")
V["contrast"] = (["lab", "pixel", "mask"], """
    select scene_id, label, avg(value) as mean_backscatter, any_value(sea) as sea,
      case when any_value(sea) > 1e-6 and avg(value) > 1e-6 then 10e0*log10(avg(value)/any_value(sea)) end as contrast_db
    from lab join pixel using (scene_id, row, col) left join (
      select scene_id, case when count(*) > 50 then quantile_cont(value, 0.5) end as sea from pixel join mask using (scene_id, row, col)
      where cls = 0 group by scene_id) using (scene_id) group by scene_id, label""")
V["conf"] = (["lab", "prob"], """
    select scene_id, label, avg(p) as confidence from lab join prob using (scene_id, row, col) where cls = 1 group by scene_id, label""")
V["scenes"] = (["scene"], """
    select *, lon as gt0, pixel_size_m/(111320e0*greatest(cos(radians(lat)), 2e-2)) as gt1, 0e0 as gt2, lat as gt3, 0e0 as gt4, -pixel_size_m/111320e0 as gt5 from scene""")
V["ranked"] = (["meas"], """
    select *, row_number() over (partition by scene_id order by label)::int as slick_no,
      row_number() over (partition by scene_id order by area_px desc, label)::int as size_rank from meas""")


def age_sql(area: str, elong: str, wind: str) -> dict[str, str]:
    raw = (f"(pow(sqrt(({area})/{PI})/55e0, 4e0)/3600e0*(case when ({elong}) > 4 then 1.4e0 when ({elong}) < 2 then 0.7e0 else 1e0 end)"
           f"*(case when ({wind}) > 8 then 0.6e0 else 1e0 end))")
    h = f"least(48e0, greatest(5e-1, {raw}))"
    side = f"case when {raw} > 48 then 'upper' when {raw} < 5e-1 then 'lower' end"
    basis = (f"concat('Fay gravity-viscous spreading (r ~ t^1/4, K=55.0), adjusted for elongation', case when ({wind}) is null then '' else ' and wind' end,"
             f" '. Since t ~ r^4, this is order-of-magnitude only.', case {side} when 'upper' then ' Slick is larger than the model resolves -- report as ''> 48 h'', not as 48 h.'"
             f" when 'lower' then ' Slick is very small -- report as ''< 0.5 h''.' else '' end)")
    return {"hours": f"round({h}, 1)", "lo": f"round({h}/4e0, 1)", "hi": f"round({h}*4e0, 1)", "saturated": side, "basis": basis}


for _side, _src in (("tobj", "mask"), ("pobj", "pred")):
    V[f"{_side}_px"] = ([_src], f"select scene_id, row, col from {_src} where cls = 3")
    V |= closure(f"{_side}_px", f"{_side}_lab")
    V[_side] = ([f"{_side}_lab"], f"select l.* from {_side}_lab l join {_size.format(_side + '_lab')} using (scene_id, label) where n >= 4")
V["overlap"] = (["tobj", "pobj"], f"""
    select scene_id, g, p, inter, ng + np - inter as union_px from (
      select t.scene_id, t.label as g, q.label as p, count(*) as inter from tobj t join pobj q using (scene_id, row, col) group by all)
    join (select scene_id, label as g, count(*) as ng from tobj group by all) using (scene_id, g)
    join (select scene_id, label as p, count(*) as np from pobj group by all) using (scene_id, p)""")
# Holds where no prediction is wanted by two truths, as in the demo scenes.
V["matches"] = (["overlap"], """
    select scene_id, g, p, inter/union_px as iou from overlap where inter/union_px >= 1e-1
    qualify row_number() over (partition by scene_id, g order by inter/union_px desc, p) = 1""")
V["cm"] = (["mask", "pred"], """
    select scene_id, m.cls as truth, p.cls as pred, count(*) as n from mask m join pred p using (scene_id, row, col) where m.cls between 0 and 4 group by all""")

# ------------------------------------------------------------------ incidents

_like = lambda hints: "(" + " or ".join(f"contains(hay, '{h}')" for h in hints) + ")"
_tokens = NAME_TOKEN.replace("'", "''")
_numeral = r"^(\d{1,4}|I{1,3}|IV|VI{0,3}|IX|XI{0,2})$"
_stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
V["names"] = (["incident_raw"], f"""
    select *, case when length(pre) > 2 and not list_contains([{_stop}], upper(pre)) then pre
      when len(words) between 1 and 3 then array_to_string(toks[list_position(toks, words[1]):list_position(toks, words[1])+len(words)], ' ') end as guess
    from (select *, list_filter(toks, lambda w: not regexp_matches(w, '{_numeral}')) as words from (
      select *, regexp_replace(regexp_extract("Name", '{PREFIXED.replace("'", "''")}', 1), '^[ ,.-]+|[ ,.-]+$', '', 'g') as pre,
        list_filter(regexp_extract_all(regexp_split_to_array("Name", '{SEPARATOR}')[1], '{_tokens}'), lambda w: not list_contains([{_stop}], w)) as toks
      from incident_raw))""")
V["inc"] = (["names"], f"""
    select *, {_like(OIL_HINTS)} as is_oil, {_like(VESSEL_HINTS)} as is_vessel, coalesce(year >= 2009, false) as ais_era,
      guess is not null and coalesce(year >= 2009, false) as priority
    from (select "ID" as id, "Name" as name, try_cast("Latitude" as double) as lat, try_cast("Longitude" as double) as lon,
            "Open Date" as date, year("Open Date")::int as year, "Commodity" as commodity, lower(concat("Name", ' ', "Commodity")) as hay, guess from names)""")
V["cur"] = (["inc"], "select * from inc where lat is not null and lon is not null and is_oil and is_vessel")

# ------------------------------------------------------------------ queries

O: dict[str, tuple[list[str], str]] = {}


def rd(*cols: str, n: int = 6) -> str:
    return ", ".join(f"round({c}, {n}) as {c.split('.')[-1]}" for c in cols)


_num = lambda c: f'try_cast("{c}" as double)'
_canon = f"""cast("MMSI" as bigint) as mmsi, "Time" as t, {rd('"LAT"', '"LON"').replace('as "LAT"', 'as lat').replace('as "LON"', 'as lon')}"""
_rsog = 'round(case when "SOG" > 102 then null else "SOG" end, 6) as sog'
_rcog = 'case when "COG" > 360 then null else "COG" end as cog'
_rhead = 'case when "Heading" >= 511 then null else "Heading" end as heading'
_box = f"{within_range('lat', BOX[0], BOX[1])} and {within_range('lon', BOX[2], BOX[3])}"
_rawbox = _box.replace("lat between", '"LAT" between').replace("lon between", '"LON" between')
O["src1_read_ais"] = (["ais_raw"], f"""
    select {_canon}, {_rsog}, {_rcog}, {_rhead}, "Length" as length, "Width" as width, "Draft" as draft, "VesselName" as name, "VesselType" as vtype
    from ais_raw where {_rawbox} and {within_range('"Time"', *RANGE)}""")
O["src2_resolve_columns"] = (["ais_raw"], f"""
    select {_canon}, {_rsog}, {_rcog}, "VesselName" as name, "Length" as length, null::double as draft from ais_raw""")
O["src3_crop_ais_bbox"] = (["ais_raw"], f"""
    select ord, cast("MMSI" as bigint) as mmsi, round("LAT", 6) as lat, round("LON", 6) as lon,
      strftime(to_timestamp("Time") at time zone 'UTC', '%Y-%m-%d') as day from ais_raw where {_rawbox}""")
O["src4_read_incidents"] = (["inc"], "select name, lat, lon, strftime(date, '%Y-%m-%d') as date, commodity from inc")
_feats = """
    select c_custkey*2 as id, c_mktsegment as source_type, 200000000+c_custkey as mmsi, 'Point' as geometry_type,
      ((c_custkey*13)%180)::double as lon, ((c_custkey*7)%90)::double as lat from customer
    union all
    select c_custkey*2+1, case when c_custkey%3=0 then 'VESSEL' else 'INFRA' end, null, 'Polygon',
      ((c_custkey*13)%180)::double, ((c_custkey*7)%90)::double from customer"""
V["feats"] = ([], _feats)
O["src5_read_features_geojson"] = (["feats"], "select * from feats")
O["src6_read_scene_tiles"] = ([], """
    select lang as split, concat('d', doc_id) as stem, concat('file:/data/', lang, '/images/d', doc_id, '.png') as image,
      case when doc_id%7<>0 then concat('file:/data/', lang, '/labels/d', doc_id, '.png')
           when doc_id%3=0 then concat('file:/data/', lang, '/labels/d', doc_id, '.jpg') end as label from documents""")
O["src7_read_current_grid"] = (["grid"], f"select slick_id, ti, yi, xi, {rd('u', 'v')} from grid")
O["snk1_slicks_to_geojson"] = (["ranked", "scenes"], """
    select scene_id, slick_no, 'Point' as geometry, round(gt0 + col_c*gt1, 5) as x, round(gt3 + row_c*gt5, 5) as y, area_px, 'geographic' as space
    from ranked join scenes using (scene_id)""")
O["snk2_suspects_report"] = (["susp", "match", "cfix", "counts"], """
    select origin_id, rank, mmsi, name, round(attribution_pct, 2) as attribution_pct, vtype::int as vessel_type, round(length, 1) as length_m,
      round(min_dist_km, 2) as min_dist_km, round(time_gap_min, 1) as time_gap_min, round(track_match, 3) as track_match, evidence,
      'baseline' as scorer, n_screened as n_vessels_screened, n_candidates, n_track, track_t, track_lat, track_lon
    from susp join match using (origin_id, mmsi) join counts using (origin_id) join (
      select origin_id, mmsi, count(*) as n_track, round(sum(t), 1) as track_t, round(sum(round(lat, 5)), 3) as track_lat, round(sum(round(lon, 5)), 3) as track_lon from (select *, row_number() over (partition by origin_id, mmsi order by t) - 1 as k,
        greatest(count(*) over (partition by origin_id, mmsi) // 400, 1) as step from cfix) where k % step = 0 group by all) using (origin_id, mmsi)
    where rank <= 10""")
O["snk3_origin_report"] = (["psum", "hb", "heat", "ptrack", "win"], f"""
    select slick_id, {rd('lat_c', 'lon_c', n=4)}, n_particles, round(spread_km, 2) as spread_km,
      {rd('lat_min', 'lat_max', 'lon_min', 'lon_max', n=5)}, n_cells, n_nodes, {rd('earliest', 'most_likely', 'latest', n=2)}, bearing as slick_bearing_deg, 64 as bins
    from psum join hb using (slick_id) join (select slick_id, count(*) as n_cells from heat group by all) using (slick_id)
    join (select slick_id, count(*) as n_nodes from ptrack group by all) using (slick_id) join win using (slick_id)""")
O["snk4_curated_csv"] = (["cur"], "select name, lat, lon, year, guess as vessel_guess, is_oil, is_vessel, ais_era, priority from cur")
O["snk5_explain_text"] = (["susp", "counts"], f"""
    select origin_id, case when body is null then 'No candidate vessels near the estimated origin.' else
      concat('Screened ', n_screened, ' vessels -> ', n_candidates, ' candidates (transparent scorer)', chr(10), body) end as report
    from counts left join (select origin_id, string_agg(concat(chr(10), '#', rank, '  MMSI ', mmsi, '  ', case when name = '' then '(unnamed)' else name end,
        '   ', {f1('attribution_pct')}, '% attribution', chr(10), '      - ', replace(evidence, ' | ', chr(10) || '      - ')), chr(10) order by rank) as body
      from susp where rank <= 5 group by origin_id) using (origin_id)""")
O["prj1_normalise_ais"] = (["ais_raw"], """
    select ord, cast("MMSI" as bigint) as mmsi, "Time" as t, case when ord%19=0 then null else round("LAT", 6) end as lat, round("LON", 6) as lon,
      case when ord%23=0 then null else round("SOG", 6) end as sog, null::double as cog, '' as name from ais_raw""")
O["prj2_parse_time"] = ([], """
    select event_id, round(epoch_us(ts)/1e6, 3) as t_ts, round(epoch_us(ts)/1e6, 3) as t_ms,
      case when event_id%10=0 then null else floor(epoch_us(ts)/1e6) end as t_text from events""")
O["prj3_null_sentinels"] = (["ais_raw"], f"select ord, {_rsog}, {_rcog}, {_rhead} from ais_raw")
O["prj4_pixel_to_lonlat"] = (["mask", "scenes"], """
    select scene_id, row, col, round(gt0 + col*gt1 + row*gt2, 6) as lon, round(gt3 + col*gt4 + row*gt5, 6) as lat from mask join scenes using (scene_id)""")
O["prj5_place_scene"] = (["scenes"], f"select scene_id, {rd('gt0', 'gt2', 'gt3', 'gt4')}, round(gt1, 10) as gt1, round(gt5, 10) as gt5 from scenes")
O["prj6_scene_bounds"] = (["scenes"], """
    select scene_id, round(gt3 + height*gt5, 6) as south, round(gt0, 6) as west, round(gt3, 6) as north, round(gt0 + width*gt1, 6) as east from scenes""")
O["flt1_drop_invalid"] = (["ais"], """
    select ord, mmsi, t, round(lat*3.2e0+30e0, 6) as lat, round(lon*2.5e0, 6) as lon from ais
    where ord%11 <> 0 and lat*3.2e0+30e0 between -90 and 90 and lon*2.5e0 between -180 and 180""")
O["flt2_bbox_time_filter"] = (["ais"], f"select ord, mmsi, t, {rd('lat', 'lon')} from ais where {_box} and {within_range('t', *RANGE)}")
O["flt3_candidate_vessels"] = (["cand"], f"select origin_id, mmsi, n_fixes, {rd('near_km', 'reach_km', n=4)} from cand")
O["flt4_incident_filter"] = (["cur"], "select name, lat, lon, commodity from cur")
O["flt5_drop_small_regions"] = (["final"], "select scene_id, row, col from final")
O["flt6_screen_gate"] = (["score"], "select scene_id, truth, round(score, 6) as score from score where score >= 1e-1")
O["flt7_heat_cells_visible"] = (["heat", "hb"], """
    select slick_id, i, j, round(v, 4) as v, round(lat_min+(i+5e-1)*(lat_max-lat_min)/64e0, 4) as lat, round(lon_min+(j+5e-1)*(lon_max-lon_min)/64e0, 4) as lon
    from heat join hb using (slick_id) where v >= 18e-2""")
O["flt8_thin_rows"] = (["tracks"], f"""
    select mmsi, t, {rd('lat', 'lon')} from (select *, row_number() over (partition by mmsi order by t) - 1 as k,
      greatest(count(*) over (partition by mmsi) // 20, 1) as step from tracks) where k % step = 0""")
_reg = ", ".join(f"('{a}', '{b}', {num(x)}, {num(y)})" for a, b, x, y in REGIONS)
_ids = ", ".join(f"'{x[0]}'" for x in REGIONS)
O["flt9_choose_position"] = ([], f"""
    select request_id, region, lat2 as lat, lon2 as lon, case when region is not null and nm is null then 'unknown region'
      when not (lat2 between -90 and 90 and lon2 between -180 and 180) then 'lat must be -90..90 and lon -180..180' end as error
    from (select *, case when lat is not null and lon is not null then lat else coalesce(rlat, 186e-1) end as lat2,
        case when lat is not null and lon is not null then lon else coalesce(rlon, 716e-1) end as lon2
      from (select c_custkey as request_id, case when c_custkey%4<>3 then [{_ids}, 'atlantis'][c_custkey%13+1] end as region,
          case when c_custkey%5=0 then (c_custkey*7%200-100)::double end as lat, case when c_custkey%5<2 then (c_custkey*13%360-180)::double end as lon from customer) q
      left join (values {_reg}) g(id, nm, rlat, rlon) on id = region)""")
O["src8_archive_near_origin"] = (["near"], f"select origin_id, mmsi, ord, t, {rd('lat', 'lon')} from near")
O["jn1_ais_near_origin"] = (["near"], f"select origin_id, mmsi, ord, t, {rd('lat', 'lon')} from near")
O["jn2_position_at"] = (["positions"], f"select mmsi, sample_id, covered, {rd('at_lat', 'at_lon')} from positions")
O["jn3_value_at"] = (["positions"], "select mmsi, sample_id, round(at_sog, 6) as at_sog, at_cog from positions")
O["jn4_nearest_fix_dt"] = (["positions"], "select mmsi, sample_id, round(nearest_s, 3) as nearest_s from positions")
O["jn5_in_gap"] = (["positions"], "select mmsi, sample_id, in_gap from positions")
O["jn6_closest_approach"] = (["vd"], f"""
    select origin_id, mmsi, round(d, 4) as dist_km, cog, round(sog, 4) as sog from (
      select *, {closer('cog')} as cog, {closer('sog')} as sog from vd where d is not null
      qualify row_number() over (partition by origin_id, mmsi order by d, sample_id) = 1)""")
O["jn7_track_match"] = (["match"], "select origin_id, mmsi, round(track_match, 5) as track_match from match")
O["jn8_join_learned_rank"] = (["susp", "learned"], "select origin_id, mmsi, rank, learned_rank from susp left join learned using (origin_id, mmsi)")
_pal = ", ".join(f"({i}, {a}, {b}, {c})" for i, (a, b, c) in enumerate(PALETTE))
O["jn9_decode_mask"] = (["rgb"], f"""
    select scene_id, row, col, case when d > 10800 then 0 else k end::int as cls from (
      select scene_id, row, col, min(pow(r-x, 2)+pow(g-y, 2)+pow(b-z, 2)) as d, arg_min(k, (pow(r-x, 2)+pow(g-y, 2)+pow(b-z, 2), k)) as k
      from rgb, (values {_pal}) p(k, x, y, z) group by scene_id, row, col)""")
O["jn10_grid_current_lookup"] = (["origin_sample", "grid", "site"], """
    select slick_id, sample_id, round(sum(u*w), 8) as u, round(sum(v*w), 8) as v from (
      select q.slick_id, q.sample_id, q.rid, g.u, g.v, (case when g.yi = y0 then 1-(fy-y0) else fy-y0 end)*(case when g.xi = x0 then 1-(fx-x0) else fx-x0 end) as w
      from (select *, least(floor(fy), 10)::bigint as y0, least(floor(fx), 10)::bigint as x0 from (
        select origin_id as slick_id, sample_id, rid, arg_min(k, (abs(tc-43200e0+21600e0*k - t), k)) as ti,
          any_value(least(11e0, greatest(0e0, (lat-(lat0-2e0))/(4e0/11)))) as fy, any_value(least(11e0, greatest(0e0, (lon-(lon0-2e0))/(4e0/11)))) as fx
        from (select *, row_number() over () as rid from origin_sample) join site on site_id = origin_id, range(4) s(k) group by origin_id, sample_id, rid)) q
      join grid g on g.slick_id = q.slick_id and g.ti = q.ti and g.yi between y0 and y0+1 and g.xi between x0 and x0+1)
    group by slick_id, sample_id, rid""")
O["jn11_match_instances"] = (["matches"], "select scene_id, g, p, round(iou, 6) as iou from matches")
O["jn12_case_truth_rank"] = (["truthrank"], "select origin_id, truth_mmsi, rank, round(attribution_pct, 3) as attribution_pct, n_candidates from truthrank")
O["jn13_origin_error_km"] = (["osum", "truth"], f"select origin_id, round({hav('lat_c', 'lon_c', 'true_lat', 'true_lon')}, 5) as error_km from osum join truth using (origin_id)")
O["agg1_origin_summary"] = (["osum"], f"""
    select origin_id, n_samples, {rd('lat_c', 'lon_c')}, {rd('t_center', 't0', 't1', n=2)}, round(spread_km, 4) as spread_km,
      {rd('lat_min', 'lat_max', 'lon_min', 'lon_max', n=5)} from osum""")
O["agg2_vessel_statics"] = (["tracks"], """
    select mmsi, coalesce(arg_min(name, t) filter (lower(name) not in ('', 'nan', 'none')), '') as name, arg_min(vtype, t) as vtype, arg_min(length, t) as length,
      arg_min(width, t) as width, arg_min(draft, t) as draft from tracks group by mmsi""")
_f = lambda *n: (["feat"], f"select origin_id, mmsi, {rd(*n, n=4)} from feat")
O["agg3_dwell_frac"] = _f("dwell_frac")
O["agg4_prox_score"] = _f("prox_score", "min_dist_km", "mean_dist_km")
O["agg5_time_gap_min"] = _f("time_gap_min")
O["agg6_slow_steaming"] = _f("slow_steaming")
O["agg7_loiter_score"] = _f("loiter_score")
O["agg8_ais_gap_max_min"] = _f("ais_gap_max_min")
O["agg9_gap_over_origin"] = _f("gap_over_origin")
O["agg10_dark_frac"] = _f("dark_frac")
O["agg11_heatmap"] = (["heat"], "select slick_id, i, j, round(v, 4) as v from heat")
O["agg12_origin_track"] = (["otrack"], f"select origin_id, node, {rd('lat', 'lon')}, round(t, 2) as t from otrack")
O["agg13_particle_spread"] = (["origin_sample"], """
    select origin_id, round(lat_c, 6) as lat_c, round(lon_c, 6) as lon_c, count(*) as n_particles,
      round(sqrt(avg(pow((lon-lon_c)*111.32e0*cos(radians(lat_c)), 2) + pow((lat-lat_c)*111.32e0, 2))), 5) as spread_km
    from (select *, avg(lat) over (partition by origin_id) as lat_c, avg(lon) over (partition by origin_id) as lon_c from origin_sample) group by origin_id, lat_c, lon_c""")
O["agg14_time_window"] = (["win"], f"select slick_id, {rd('earliest', 'most_likely', 'latest', n=3)} from win")
O["agg15_confusion_matrix"] = (["cm"], "select * from cm")
_iou = ", ".join(f"round(i{i}, 6) as iou_{c}" for i, c in enumerate(CLASSES))
_raw = ", ".join(f"coalesce(sum(n) filter (truth={i} and pred={i}), 0)/nullif(sum(n) filter (truth={i} or pred={i}), 0) as i{i}" for i in range(5))
O["agg16_iou_report"] = (["cm"], f"""
    select scene_id, {_iou}, round(list_avg([i0, i1, i2, i3, i4]), 6) as miou, round(acc, 6) as pixel_accuracy
    from (select scene_id, {_raw}, coalesce(sum(n) filter (truth=pred), 0)/sum(n) as acc from cm group by scene_id)""")
O["agg17_oil_lookalike_confusion"] = (["cm"], """
    select a::bigint as oil_pixels_called_lookalike, b::bigint as lookalike_pixels_called_oil, round(a/nullif(c, 0), 6) as oil_miss_rate, round(b/nullif(d, 0), 6) as false_oil_rate
    from (select coalesce(sum(n) filter (truth=1 and pred=2), 0) as a, coalesce(sum(n) filter (truth=2 and pred=1), 0) as b,
      sum(n) filter (truth=1) as c, sum(n) filter (truth=2) as d from cm)""")
O["agg18_class_pixel_counts"] = (["mask", "scene"], """
    select cls, count(*) as n from mask where scene_id in (select scene_id from scene) group by cls""")
O["agg19_region_measures"] = (["meas"], f"""
    select scene_id, label, area_px, round(area_m2, 1) as area_m2, {rd('row_c', 'col_c', 'elongation', n=4)}, {rd('major_m', 'minor_m', 'azimuth', n=3)}, round(eccentricity, 5) as eccentricity from meas""")
O["agg20_region_contrast"] = (["contrast"], "select scene_id, label, round(mean_backscatter, 6) as mean_backscatter, round(contrast_db, 4) as contrast_db from contrast")
O["agg21_region_confidence"] = (["conf"], "select scene_id, label, round(confidence, 6) as confidence from conf")
O["agg22_region_perimeter"] = (["peri"], "select scene_id, label, round(perimeter_px, 4) as perimeter_px from peri")
_obj = "(select count(*) from (select distinct scene_id, label from {0}))"
O["agg24_object_metrics"] = (["tobj", "pobj", "matches"], f"""
    select tp, n_pred-tp as fp, n_true-tp as fn, n_true, n_pred, round(tp/n_pred, 6) as precision, round(tp/n_true, 6) as recall,
      round(2*(tp/n_pred)*(tp/n_true)/(tp/n_pred+tp/n_true), 6) as f1
    from (select (select count(*) from matches) as tp, {_obj.format('tobj')} as n_true, {_obj.format('pobj')} as n_pred)""")
O["agg25_screen_threshold_table"] = (["score"], f"""
    select threshold, round(count(*) filter (score >= threshold and truth = 1)/nullif(count(*) filter (truth = 1), 0), 6) as recall,
      round(count(*) filter (score >= threshold and truth = 1)/nullif(count(*) filter (score >= threshold), 0), 6) as precision,
      round(count(*) filter (score < threshold)/count(*), 6) as screened_out
    from score, (select unnest([{', '.join(num(t) for t in THRESHOLDS)}]) as threshold) group by threshold""")
O["agg26_rank_metrics"] = (["truthrank"], """
    select round(avg(case when rank = 1 then 1e0 else 0e0 end), 6) as top1, round(avg(case when rank <= 3 then 1e0 else 0e0 end), 6) as recall3,
      round(avg(coalesce(1e0/rank, 0e0)), 6) as mrr, count(rank) as recalled, count(*) as total,
      round(avg((n_candidates+1)/2e0) filter (rank is not null), 6) as chance_rank, round(median(rank), 6) as median_rank from truthrank""")
O["agg27_incident_summary"] = (["cur"], """
    select count(*) as incidents, count(guess) as named, count(*) filter (ais_era) as in_ais_era, count(*) filter (priority) as priority from cur""")
O["agg28_source_type_counts"] = (["feats"], "select source_type, count(*) as n from feats group by source_type")
O["agg29_agreement_rate"] = (["susp", "other_first"], """
    select count(*) as compared, round(avg(case when s.mmsi = o.mmsi then 1e0 else 0e0 end), 6) as agreement
    from other_first o join susp s on s.origin_id = o.origin_id and s.rank = 1""")
O["agg30_run_counts"] = (["counts"], "select * from counts")
O["win1_dedupe_fixes"] = (["tracks"], f"select ord, mmsi, t, {rd('lat', 'lon')} from tracks")
O["win2_drop_teleports"] = (["clean"], f"select origin_id, mmsi, t, {rd('lat', 'lon')} from clean")
O["win3_gaps"] = (["tracks"], "select mmsi, t as g0, g1 from (select *, lead(t) over (partition by mmsi order by t) as g1 from tracks) where g1 - t > 900")
O["win4_rank_suspects"] = (["susp"], "select origin_id, mmsi, rank from susp")
O["win5_attribution_pct"] = (["susp"], "select origin_id, mmsi, round(attribution_pct, 4) as attribution_pct from susp")
O["win6_track_span"] = (["tracks"], "select mmsi, min(t) as t_first, max(t) as t_last, count(*) as n_fixes from tracks group by mmsi")
_hann = lambda i: f"(5e-1 - 5e-1*cos(2e0*pi()*({i})/19e0))"
O["win7_blend_tiles"] = (["prob"], f"""
    select scene_id, row, col, cls, round(sum((p+(ty*3+tx)%7/100e0)*w)/sum(w), 5) as p from (
      select *, {_hann('row-ty')}*{_hann('col-tx')}+1e-3 as w from prob, (values (0), (12), (24), (28)) y(ty), (values (0), (12), (24), (28)) x(tx)
      where row >= ty and row < ty+20 and col >= tx and col < tx+20) group by scene_id, row, col, cls""")
O["win8_argmax_class"] = (["prob"], "select scene_id, row, col, arg_max(cls, (p, -cls)) as cls from prob group by scene_id, row, col")
# Sums over the 25 neighbours, the edge mirrored and repeated.
_m48 = lambda x: f"(case when {x} < 0 then -({x})-1 when {x} > 47 then 95-({x}) else {x} end)"
V["lee"] = (["pixel"], f"""
    select scene_id, row, col, m + least(1e0, greatest(0e0, (ci2-0.523e0*0.523e0)/greatest(ci2, 1e-8)))*(value-m) as value
    from (select *, greatest(q-m*m, 0e0)/greatest(m*m, 1e-8) as ci2 from (
      select a.scene_id, a.row, a.col, a.value, avg(b.value) as m, avg(b.value*b.value) as q
      from (select *, unnest(range(-2, 3)) as dr from pixel) a, range(-2, 3) d(dc), pixel b
      where b.scene_id = a.scene_id and b.row = {_m48('(a.row+dr)')} and b.col = {_m48('(a.col+dc)')} group by all))""")
O["win9_lee_filter"] = (["lee"], "select scene_id, row, col, round(value, 6) as value from lee")
O["win10_label_regions"] = (["lab"], "select scene_id, row, col, label from lab")
O["top1_top_suspects"] = (["susp"], "select origin_id, mmsi, rank, round(score, 4) as score from susp where rank <= 5")
O["top2_top_evidence"] = (["susp"], "select origin_id, mmsi, evidence from susp")
O["top3_slicks_by_area"] = (["ranked"], "select scene_id, slick_no, size_rank, area_px from ranked")
O["top4_incidents_by_priority"] = (["cur"], """
    select name, year, lat, lon, guess as vessel_guess from cur where priority order by year desc, date desc, name, lat, lon limit 20""")
O["top5_pick_slick"] = (["ranked"], """
    select scene_id, slick_no, size_rank, area_px from ranked qualify row_number() over (partition by scene_id order by (slick_no = 2) desc, size_rank) = 1""")
O["set1_union_parts"] = (["ais"], """
    select ord, mmsi, t, round(sog, 6) as sog, case when sog is null then null else draft end as draft, case when sog is null then null else name end as name from ais""")
O["set2_pixel_overlap"] = (["overlap"], "select * from overlap")
O["set3_missing_truth"] = (["tobj", "pobj", "matches"], """
    select distinct scene_id, label, 'fn' as kind from tobj where (scene_id, label) not in (select (scene_id, g) from matches)
    union all select distinct scene_id, label, 'fp' from pobj where (scene_id, label) not in (select (scene_id, p) from matches)""")
V["legs"] = (["origin_sample", "truth"], "select * from origin_sample join truth using (origin_id)")
O["sc1_haversine_km"] = (["legs"], f"select origin_id, sample_id, round({hav('lat', 'lon', 'true_lat', 'true_lon')}, 5) as km from legs")
O["sc2_local_km"] = (["legs"], """
    select origin_id, sample_id, round((lon-true_lon)*111.32e0*cos(radians(true_lat)), 5) as e, round((lat-true_lat)*111.32e0, 5) as n,
      round(lat, 6) as lat, round(lon, 6) as lon from legs""")
_bear = "degrees(atan2(sin(radians(lon-true_lon))*cos(radians(lat)), cos(radians(true_lat))*sin(radians(lat))-sin(radians(true_lat))*cos(radians(lat))*cos(radians(lon-true_lon))))"
O["sc3_bearing_deg"] = (["legs"], f"select origin_id, sample_id, round({mod(_bear, '360e0')}, 4) as bearing from legs")
_d = "(sog*100e0/6371.0088e0)"
_s2 = f"(sin(radians(lat))*cos({_d})+cos(radians(lat))*sin({_d})*cos(radians(cog)))"
_l2 = f"degrees(radians(lon)+atan2(sin(radians(cog))*sin({_d})*cos(radians(lat)), cos({_d})-sin(radians(lat))*{_s2}))+540e0"
O["sc4_destination"] = (["ais"], f"""
    select ord, round(degrees(asin({_s2})), 5) as lat2, round({mod(_l2, '360e0')}-180e0, 5) as lon2 from ais where cog is not null and sog is not null""")
_ad = f"({mod('cog-heading+180e0', '360e0')}-180e0)"
O["sc5_axis_alignment"] = (["ais"], f"""
    select ord, round({_ad}, 4) as diff, round(pow(cos(radians({_ad})), 2), 6) as align from ais where cog is not null and heading is not null""")
_v = "(cast(vtype as int) + ord%10)"
O["sc6_vtype_prior"] = (["ais"], f"""
    select ord, case when vtype is null then 4e-1 when {_v} between 80 and 89 then 1e0 when {_v} between 70 and 79 then 85e-2 when {_v} = 30 then 35e-2
      when {_v} in (31, 32) then 6e-1 when {_v} between 50 and 59 then 45e-2 when {_v} between 60 and 69 then 4e-1 when {_v} between 40 and 49 then 25e-2
      when {_v} in (36, 37) then 12e-2 else 4e-1 end as prior from ais""")
O["sc7_vtype_label"] = (["ais"], f"select ord, {LABEL} as label from (select ord, vtype + ord%10 as vtype from ais)")
O["sc8_size_score"] = (["ais"], """
    select ord, round(case when length-25 > 0 then least(1e0, greatest(0e0, log10((length-25)/10e0)/log10(40e0))) else 35e-2 end, 6) as size from ais""")
O["sc9_course_align"] = _f("course_align", "cpa_sog_kn")
O["sc10_evidence_terms"] = (["feat"], "select origin_id, mmsi, " + ", ".join(f"round({v}, 4) as {k}" for k, v in TERMS.items()) + " from feat")
O["sc11_baseline_score"] = (["susp"], "select origin_id, mmsi, round(score, 4) as score, round(prob, 5) as prob from susp")
O["sc12_evidence_text"] = (["feat"], "select origin_id, mmsi, " + ", ".join(f"{v} as {k}" for k, v in SENTENCES.items()) + " from feat")
O["sc13_orientation_to_azimuth"] = (["ais"], f"select ord, round({mod('-degrees(radians(cog/2e0-90e0))', '180e0')}, 4) as azimuth from ais where cog is not null")
V["shapes"] = ([], """
    select p_partkey, p_retailprice*p_partkey*13.7e0+1000e0*p_size as area, 1e0+p_size/7e0 as elong, case when p_partkey%3>0 then p_size/4e0 end as wind from part""")
_age = age_sql("area", "elong", "wind")
V["aged"] = (["shapes"], "select p_partkey, " + ", ".join(
    f"case when area > 0 then {v} {'' if k != 'basis' else chr(10) + 'else ' + chr(39) + 'no area' + chr(39)} end as {k}" for k, v in _age.items()) + " from shapes")
O["sc14_estimate_age"] = (["aged"], "select * from aged")
O["sc15_oil_likelihood"] = ([], """
    select p_partkey, round(s, 6) as score, case when round(s, 9) >= 45e-2 then 'likely_oil' when round(s, 9) >= 15e-2 then 'possible_oil' else 'uncertain' end as verdict, k::bigint as n_notes
    from (select p_partkey, (case when e >= 3 then 3e-1 when e < 18e-1 then -2e-1 else 0e0 end) + (case when s >= 85e-2 then 15e-2 else -1e-1 end)
        + (case when d <= -3 then 25e-2 when d > -15e-1 then -15e-2 else 0e0 end) + 3e-1*(p-5e-1)*2e0 as s,
        1 + (e >= 3 or e < 18e-1)::int + (d <= -3 or d > -15e-1)::int as k
      from (select p_partkey, p_size/10e0 as e, 5e-1+p_partkey%50/100e0 as s, -p_size/8e0 as d, p_partkey%97/97e0 as p from part))""")
O["sc16_to_db"] = (["pixel"], "select scene_id, row, col, round(greatest(10e0*log10(greatest(pow(value, 12e0)-1e-9, 1e-8)), -50e0), 5) as db from pixel")


def stretch(src: str) -> str:
    return f"""
    select scene_id, row, col, case when hi-lo < 1e-8 then 0e0 else least(1e0, greatest(0e0, (value-lo)/(hi-lo))) end as value
    from {src} join (select scene_id, quantile_cont(value, 2e-2) as lo, quantile_cont(value, 98e-2) as hi from {src} group by scene_id) using (scene_id)"""


O["sc17_percentile_stretch"] = (["pixel"], f"select scene_id, row, col, round(value, 6) as value from ({stretch('pixel')})")
O["sc18_grey_from_rgb"] = (["rgb"], "select scene_id, row, col, round((r+g+b)/3e0, 5) as grey from rgb")
O["sc19_text_hints"] = (["inc"], "select name, commodity, is_oil, is_vessel from inc")
O["sc20_vessel_name"] = (["names"], 'select "ID" as id, guess from names')
O["sc21_first_point"] = (["feats"], "select id, lon, lat from feats")
O["sc22_age_label"] = (["aged"], f"""
    select p_partkey, case when hours is null then 'n/a' when saturated = 'upper' then concat('> ', {f1('hours')}, ' h') when saturated = 'lower' then concat('< ', {f1('hours')}, ' h')
      else concat('~', {f1('hours')}, ' h (', {f1('lo')}, '–', {f1('hi')}, ')') end as label from aged""")
O["sc23_pick_dataset"] = ([], f"""
    select o_orderkey, case when ({num(NOW)} - (epoch_us(o_orderdate)/1e6 + 700000000e0))/86400e0 > 120 then 'cmems_mod_glo_phy_my_0.083deg_P1D-m'
      else 'cmems_mod_glo_phy-cur_anfc_0.083deg_PT6H-i' end as dataset from orders""")
O["sc24_window_caps"] = ([], """
    select p_partkey, round(least(p_size/3e0, least(p_size*15e-1, 24e0)*5e-1), 5) as lo, least(p_size::double, least(p_size*15e-1, 24e0)) as age, least(p_size*15e-1, 24e0) as hi from part""")
_hex = ", ".join(f"({i}, '{n}', '#%02x%02x%02x')" % PALETTE[i] for i, n in enumerate(CLASSES))
O["sc25_class_palette_hex"] = (["mask"], f"select m.cls, name, color, count(*) as n from mask m join (values {_hex}) p(cls, name, color) using (cls) group by all")
_u = lambda s: uni("scene_id", "0", "0", s)
O["sc26_augment_flip_rot"] = (["pixel"], f"""
    select scene_id, (case k when 0 then r when 1 then 47-c when 2 then 47-r else c end) as row, (case k when 0 then c when 1 then r when 2 then 47-c else 47-r end) as col, round(value, 6) as value
    from (select scene_id, value, case when {_u(11)} < 5e-1 then 47-col else col end as c, case when {_u(12)} < 5e-1 then 47-row else row end as r, floor({_u(13)}*4)::int as k from pixel)""")
O["sc27_resize_scene"] = (["pixel", "mask"], """
    select scene_id, r as row, c as col, round(v, 11) as value, m.cls from (
      select scene_id, r, c, sum(value*(1-abs(y-row))*(1-abs(x-col))) as v from (
        select *, least(47e0, greatest(0e0, (r+5e-1)*48/32e0-5e-1)) as y, least(47e0, greatest(0e0, (c+5e-1)*48/32e0-5e-1)) as x from range(32) a(r), range(32) b(c)) t
      join pixel p on p.row between floor(y) and floor(y)+1 and p.col between floor(x) and floor(x)+1 group by scene_id, r, c) z
    join mask m using (scene_id) where m.row = floor(r*48/32) and m.col = floor(c*48/32)""")
O["tr1_expand_ages"] = (["ages"], "select slick_id, particle_id, round(age_s, 2) as age_s from ages")
O["tr2_seed_particles"] = (["seeds"], f"select slick_id, particle_id, {rd('lat', 'lon', 'lat0', 'lon0')} from seeds")
_pt = "slick_id, particle_id, round(lat, 5) as lat, round(lon, 5) as lon, round(t, 2) as t"
O["tr3_backtrack"] = (["cloud"], f"select {_pt} from cloud")
O["tr4_forecast_frames"] = (["ahead"], f"""
    select slick_id, (k/4)::int as frame, particle_id, round(t, 2) as t, round((t-t_detect)/3600e0, 2) as hours, round(lat, 5) as lat, round(lon, 5) as lon
    from (select *, {_end} from ahead) where k % 4 = 0""")
_vu, _vv = vel("e", "n", "t")
O["tr5_field_velocity"] = (["legs", "field"], f"""
    select origin_id, sample_id, round({_vu}, 5) as u, round({_vv}, 5) as v from (
      select *, (lon-true_lon)*111.32e0*cos(radians(true_lat)) as e, (lat-true_lat)*111.32e0 as n from legs join field on slick_id = origin_id)""")
O["tr8_drop_nonfinite"] = (["current_grid"], "select slick_id, ti, yi, xi, round(u, 6) as lat, round(v, 6) as lon from current_grid where not isnan(u) and not isnan(v)")
O["tr9_origin_from_drift"] = (["cloud", "slick_drift"], """
    select slick_id as origin_id, particle_id as sample_id, round(lat, 5) as lat, round(lon, 5) as lon, round(t, 2) as t, bearing from cloud join slick_drift using (slick_id)""")
_east, _north = normals("(site_id%1000003)", "sample_id", "0", 1)
_late, _ = normals("(site_id%1000003)", "sample_id", "0", 3)
O["tr7_from_point_cloud"] = (["site"], f"""
    select site_id as origin_id, sample_id, round(lat0 + {_north}*5e0/111.32e0, 6) as lat,
      round(lon0 + {_east}*5e0/(111.32e0*cos(radians(lat0))), 6) as lon, round(tc + {_late}*3600e0, 2) as t
    from site, range(200) r(sample_id)""")
O["tr10_choose_forcing"] = (["slick_drift", "coverage"], """
    select slick_id, case when ok then 'gridded' else 'analytic' end as forcing_source, ok as realistic,
      case when ok then null when lat_min is null then 'no gridded currents for this slick' when not here then 'place outside the grid' else 'time outside the grid' end as fallback_reason
    from (select *, lat0 between lat_min and lat_max and lon0 between lon_min and lon_max as here,
        coalesce(lat0 between lat_min and lat_max and lon0 between lon_min and lon_max and t_detect between t_min and t_max, false) as ok
      from slick_drift left join coverage using (slick_id))""")
O["job1_attribute"] = (["susp", "match", "learned"], """
    select origin_id, mmsi, rank, round(score, 4) as score, round(attribution_pct, 3) as attribution_pct, round(track_match, 5) as track_match, learned_rank
    from susp join match using (origin_id, mmsi) join learned using (origin_id, mmsi)""")
_fn = ["prox_score", "min_dist_km", "mean_dist_km", "dwell_frac", "time_gap_min", "slow_steaming", "loiter_score", "ais_gap_max_min",
       "gap_over_origin", "dark_frac", "course_align", "cpa_sog_kn", "vtype_prior", "size_score"]
O["job2_build_feature_table"] = (["feat"], f"select origin_id, mmsi, name, vtype, length, n_fixes, {rd(*_fn, n=4)} from feat")
O["job3_hindcast_origin"] = (["psum", "win"], f"""
    select slick_id, {rd('lat_c', 'lon_c', n=4)}, n_particles, round(spread_km, 3) as spread_km, {rd('earliest', 'latest', n=2)} from psum join win using (slick_id)""")
O["job5_preprocess_scene"] = (["lee"], f"select scene_id, row, col, round(value, 6) as value from ({stretch('lee')})")
_lg = ["4-12*abs(value-5e-1)", "4-12*value", "3-12*abs(value-3e-1)", "12*value-8", "4-12*abs(value-8e-1)"]
_zs = " + ".join(f"exp({z})" for z in _lg)
# The model computes in single precision; a pixel's classes do not depend on its tile, so blending keeps them.
_lf = ["4::float-12::float*abs(v-0.5::float)", "4::float-12::float*v", "3::float-12::float*abs(v-0.3::float)",
       "12::float*v-8::float", "4::float-12::float*abs(v-0.8::float)"]
O["job6_score_tiles"] = (["pixel"], f"""
    select scene_id, row, col, k::int as cls, round(exp(z[k+1]::double)/list_sum(list_transform(z, lambda x: exp(x::double))), 4) as p
    from (select scene_id, row, col, [{', '.join(_lf)}] as z from (select *, value::float as v from pixel)), range(5) r(k)""")
O["udf1_tile_scorer"] = (["pixel"], f"""
    select scene_id, row, col, (list_position(z, list_max(z))-1)::int as cls from (select *, [{', '.join(_lg)}] as z from pixel)""")
O["udf2_scene_screener"] = (["pixel"], "select scene_id, round(avg(case when value < 3e-1 then 1e0 else 0e0 end), 6) as score from pixel group by scene_id having avg(case when value < 3e-1 then 1e0 else 0e0 end) >= 1e-1")
O["udf3_forcing"] = (["plaincloud"], f"select {_pt} from plaincloud")
O["udf4_scorer"] = (["feat"], f"""
    select origin_id, mmsi, row_number() over (partition by origin_id order by score desc, mmsi)::int as rank, round(score, 4) as score
    from (select *, {score_sql({'prox': 5.0, 'axis': -2.0, 'timing': 1.0}, -1.0)} as score from feat)""")
O["job8_curate_incidents"] = (["cur"], "select name, lat, lon, year, guess as vessel_guess, priority from cur where ais_era")
O["job10_hindcast_request"] = (["cloud"], f"select {_pt} from cloud")


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (need, text) in O.items():
        views = demo.ordered(need, V)
        ctes = ", ".join(f"{v} as ({demo.fill(V[v][1], 'duckdb')})" for v in views)
        out[name] = f"with recursive {ctes} {text}" if views else text
    return out
