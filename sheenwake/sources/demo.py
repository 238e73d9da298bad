"""Marine tables laid over the generic demo tables.

The demo data has no vessel positions, scenes or incidents, so these views read them
out of ``events``, ``supplier``, ``lineitem``, ``orders``, ``part``, ``customer`` and
``labels``. The views are written in the SQL that Spark and DuckDB share; ``dialect``
fills in the three expressions that differ. Regions of sea are added as the tables
grow, so the density of vessels per origin stays the same at every scale.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

SCENE_SIZE = 48
#: Views that make very many rows of each of a small file's, and its rows that one task may get.
EXPLODED = {"footprint", "current_grid", "scene_pixel"}
ROWS_A_TASK = 500

# Every view: (views it reads, text). {us} microseconds of events.ts, {seq12} and {seq48}
# the rows 0..11 and 0..47, {arr} the opening and {arrend} the end of an array literal.
VIEWS: dict[str, tuple[list[str], str]] = {
    # One raw position report per event; every seventh error event jumps 3 degrees north.
    "ais_raw": (["events"], """
        select event_id as ord, cast(200000000 + u as varchar(20)) as "MMSI",
          t as "Time",
          cast(186e-1 + 3e0*(b%13) + ((u*7919)%1000-500)/500e0
            + (((u*31)%21)-10)/100e0*(t-1704081600e0)/3600e0
            + case when event_type='error' and event_id%7=0 then 3e0 else 0e0 end as double) as "LAT",
          cast(716e-1 + 3e0*((b-b%13)/13%30) + ((u*104729)%1000-500)/500e0
            + (((u*17)%21)-10)/100e0*(t-1704081600e0)/3600e0 as double) as "LON",
          case when event_id%50=3 then 1023e-1 else value/15e0 end as "SOG",
          case when event_id%41=5 then 4095e-1 else cast((u*37+event_id%15)%360 as double) end as "COG",
          case when event_type='view' then 511e0 else cast((u*37)%360 as double) end as "Heading",
          case when event_id%9=0 then '' when event_id%9=1 then 'nan'
               else concat('MV ', cast(u as varchar(20))) end as "VesselName",
          case when u%11=0 then null else cast(30+(u%6)*10 as double) end as "VesselType",
          case when u%13=0 then null else cast(20+(u*13)%300 as double) end as "Length",
          cast(5+(u*7)%40 as double) as "Width",
          case when event_id%3=0 then null else cast(2+(u*3)%12 as double) end as "Draft"
        from (select event_id, user_id as u, value, event_type,
                cast(floor(user_id/150e0) as bigint) as b,
                1704067200e0 + 60e0*floor(({us}/1000000e0-1704067200e0)/90e0/60e0) as t
              from events)"""),
    # The same reports in canonical form.
    "ais": (["ais_raw"], """
        select ord, cast("MMSI" as bigint) as mmsi, cast("Time" as double) as t,
          "LAT" as lat, "LON" as lon,
          case when "SOG" > 102 then null else "SOG" end as sog,
          case when "COG" > 360 then null else "COG" end as cog,
          case when "Heading" >= 511 then null else "Heading" end as heading,
          "VesselName" as name, "VesselType" as vtype, "Length" as length, "Width" as width,
          "Draft" as draft
        from ais_raw"""),
    # One slick, and so one origin, per supplier.
    "site": (["supplier"], """
        select s as site_id, b, 186e-1 + 3e0*(b%13) + ((s*5237)%1000-500)/600e0 as lat0,
          716e-1 + 3e0*((b-b%13)/13%30) + ((s*3571)%1000-500)/600e0 as lon0,
          cast(1704067200 + 3600*(2+s%5) as double) as tc,
          case when s%4=0 then null else cast((s*37)%180 as double) end as bearing
        from (select s_suppkey as s, cast(floor(s_suppkey/100e0) as bigint) as b from supplier)"""),
    # The Monte-Carlo cloud of an origin: one sample per line item of the supplier.
    "origin_sample": (["lineitem", "site"], """
        select l_suppkey as origin_id, l_orderkey*100000000 + l_partkey*8 + l_linenumber as sample_id,
          lat0 + (((l_orderkey*7919+l_partkey*31)%1000)/1000e0
                  + ((l_orderkey*31+l_linenumber*617)%1000)/1000e0 - 1e0)*8e-2 as lat,
          lon0 + (((l_orderkey*104729+l_partkey*17)%1000)/1000e0
                  + ((l_partkey*7919+l_linenumber*271)%1000)/1000e0 - 1e0)*8e-2 as lon,
          tc + (((l_orderkey*613+l_partkey*97+l_linenumber*11)%1000)/1000e0-5e-1)*7200e0 as t
        from lineitem join site on l_suppkey = site_id"""),
    "origin": (["site"], "select site_id as origin_id, bearing, tc from site"),
    "truth": (["site"], """
        select site_id as origin_id, 200000000 + b*150 + (site_id*13)%150 as truth_mmsi,
          lat0 as true_lat, lon0 as true_lon from site"""),
    # Inputs of the drift run.
    "slick_drift": (["site"], """
        select site_id as slick_id, lat0, lon0, tc + 21600e0 as t_detect,
          2e0 + site_id%5 as age_h,
          case when site_id%3=0 then null else 1e0 + site_id%4 end as lo_h,
          case when site_id%3=0 then null else 6e0 + site_id%30 end as hi_h, bearing
        from site"""),
    "footprint": (["site"], """
        select site_id as slick_id, vertex, lat0 + 3e-3*vertex as lat, lon0 + 5e-3*vertex as lon
        from (select site_id, lat0, lon0, {seq12} as vertex from site)"""),
    "field": (["site"], """
        select site_id as slick_id, 25e-2*((site_id*7)%11-5)/5e0 as bg_u,
          25e-2*((site_id*5)%13-6)/6e0 as bg_v, 15e-2 as eddy, 45e0 as l1, 18e0 as l2,
          (site_id%63)/10e0 as phase, 8e-2 as tide, 6e0 as wind_speed,
          ((site_id*3)%63)/10e0 as wind_dir, ((site_id%21)-10)/1000000e0 as veer
        from site"""),
    "coverage": (["site"], """
        select site_id as slick_id, lat0-2e0 as lat_min, lat0+2e0 as lat_max, lon0-2e0 as lon_min,
          lon0+2e0 as lon_max, tc-86400e0 as t_min,
          case when site_id%5=0 then tc-80000e0 else tc+86400e0 end as t_max
        from site where site_id%3 < 2"""),
    # A current grid around every slick: 12 x 12 cells, four times; some cells are land (NaN).
    "current_grid": (["site"], """
        select site_id as slick_id, yi%4 as ti, tc - 43200e0 + 21600e0*(yi%4) as t,
          cast((yi-yi%4)/4 as bigint) as yi, xi,
          lat0 - 2e0 + (yi-yi%4)/4*4e0/11 as lat, lon0 - 2e0 + xi*4e0/11 as lon,
          case when (yi*7+xi*3+site_id)%29=0 then cast('NaN' as double)
               else 1e-2*((yi-yi%4)/4) + 2e-2*xi - 15e-2 + 1e-2*(site_id%5) end as u,
          case when (yi*7+xi*3+site_id)%29=0 then cast('NaN' as double)
               else 2e-2*((yi-yi%4)/4) - 1e-2*xi - 3e-2*(yi%4) end as v
        from (select site_id, lat0, lon0, tc, yi, {seq12} as xi
              from (select site_id, lat0, lon0, tc, {seq48} as yi from site))"""),
    # One radar scene per supplier.
    "scene": (["site"], """
        select site_id as scene_id, 48 as height, 48 as width, 10e0 + site_id%3 as pixel_size_m,
          lat0 as lat, lon0 as lon,
          case when site_id%4=0 then null else 2e0 + site_id%10 end as wind
        from site"""),
    "scene_pixel": (["site"], """
        select site_id as scene_id, row, {seq48} as col,
          14 + site_id%9 as r1, 16 + (site_id*7)%12 as c1, 9e0 + site_id%8 as ea, 3e0 + site_id%4 as eb,
          case site_id%6 when 0 then 1e0 when 1 then 8e-1 when 2 then 6e-1 when 3 then 0e0
               when 4 then -6e-1 else -8e-1 end as ux,
          case site_id%6 when 0 then 0e0 when 1 then 6e-1 when 2 then 8e-1 when 3 then 1e0
               when 4 then 8e-1 else 6e-1 end as uy
        from (select site_id, {seq48} as row from site)"""),
    "mask": (["scene_pixel"], """
        select scene_id, row, col, cast(case
            when row=r1 and col=c1 then 0
            when ((col-c1)*ux+(row-r1)*uy)/ea*((col-c1)*ux+(row-r1)*uy)/ea
               + ((row-r1)*ux-(col-c1)*uy)/eb*((row-r1)*ux-(col-c1)*uy)/eb <= 1e0 then 1
            when row between 43 and 45 and col between 2 and 4 then 1
            when scene_id%2=0 and row between 30 and 41 and col between 33+scene_id%5 and 42
                 and (row+col)%9 > 0 then 1
            when (row-37)*(row-37) + (col-12)*(col-12) <= 20+scene_id%15 then 2
            when row between 2 and 3 and col between 30+scene_id%6 and 35+scene_id%6 then 3
            when row between 6 and 7 and col between 40 and 43 then 3
            when scene_id%3=0 and col >= 45 then 4
            else 0 end as int) as cls
        from scene_pixel"""),
    "pixel": (["mask"], """
        select scene_id, row, col,
          case cls when 0 then 5e-1 when 1 then 15e-2 when 2 then 25e-2 when 3 then 95e-2 else 8e-1 end
            + ((row*13+col*29+scene_id*7)%17-8)/200e0 as value
        from mask"""),
    "pred": (["mask"], """
        select scene_id, row, col,
          cast(case when (row*31+col*17+scene_id*11)%23=0 then (cls+1)%5 else cls end as int) as cls
        from mask"""),
    "prob": (["pred"], """
        select scene_id, row, col, k as cls,
          case when k=cls then 8e-1 else 5e-2 end + ((row*5+col*3+k)%7-3)/1000e0 as p
        from (select scene_id, row, col, cls, cast(m as int) as k
              from (select scene_id, row, col, cls, {seq5} as m from pred))"""),
    "rgb": (["mask"], """
        select scene_id, row, col,
          case cls when 2 then 255 when 3 then 153 else 0 end + (row*7+col)%9
            + case when (row*3+col*5+scene_id)%97=0 then 120 else 0 end as r,
          case cls when 1 then 255 when 3 then 76 when 4 then 153 else 0 end + (row+col*3)%11
            - case when cls=1 then 11 else 0 end as g,
          case cls when 1 then 250 else 0 end
            + case when (row*3+col*5+scene_id)%97=0 then 130 else 0 end as b
        from mask"""),
    "score": (["labels"], """
        select doc_id as scene_id, quality as truth,
          ((doc_id*7919)%1000)/1000e0 * case when quality=1 then 1e0 else 6e-1 end as score
        from labels"""),
    # One incident per order.
    "incident_raw": (["orders", "part"], """
        select o_orderkey as "ID", o_orderdate + interval 12 year as "Open Date",
          case o_orderkey%7
            when 0 then concat('M/V ', upper(w1), ' ', upper(w2), '; diesel spill, mile ', k)
            when 1 then concat('Tug ', upper(w1), ' ', k, ' aground - oil sheen')
            when 2 then concat('Mystery sheen near ', w2, ' harbor')
            when 3 then concat('F/V ', upper(w1), ' sinking with fuel on board')
            when 4 then concat('Pipeline release of crude at ', w1, ' terminal')
            when 5 then concat('BARGE ', upper(w2), ' II collision')
            else concat('Tanker ', w1, ' ', w2, ' boiler room fire') end as "Name",
          case when o_orderkey%17=0 then 'n/a' else cast(lat as varchar(20)) end as "Latitude",
          cast(lon as varchar(20)) as "Longitude",
          case o_orderkey%3 when 0 then 'Diesel' when 1 then 'Chemical' else '' end as "Commodity"
        from (select o_orderkey, o_orderdate, split_part(p_name, ' ', 1) as w1,
                split_part(p_name, ' ', 2) as w2, cast(o_orderkey%500 as varchar(20)) as k,
                (o_orderkey*37)%120-60 as lat, (o_orderkey*91)%360-180 as lon
              from orders join part on p_partkey = o_custkey)"""),
    # Text of feature collections, one per customer.
    "feature_page": (["customer"], """
        select c_custkey as page_id, concat(
          '{"type":"FeatureCollection","features":[',
          '{"type":"Feature","id":', cast(c_custkey*2 as varchar(20)),
          ',"properties":{"source_type":"', c_mktsegment, '","mmsi":', cast(200000000+c_custkey as varchar(20)),
          '},"geometry":{"type":"Point","coordinates":[', lon, ',', lat, ']}},',
          '{"type":"Feature","id":', cast(c_custkey*2+1 as varchar(20)),
          ',"properties":{"source_type":"', case when c_custkey%3=0 then 'VESSEL' else 'INFRA' end, '","mmsi":null},',
          '"geometry":{"type":"Polygon","coordinates":[[[', lon, ',', lat, '],[', lon, '.5,', lat,
          '],[', lon, ',', lat, ']]]}}]}') as text
        from (select c_custkey, c_mktsegment, cast((c_custkey*7)%90 as varchar(20)) as lat,
                cast((c_custkey*13)%180 as varchar(20)) as lon from customer)"""),
    # Which vessel another source names first for an origin.
    "other_first": (["site"], """
        select site_id as origin_id, 200000000 + b*150 + (site_id*29)%150 as mmsi from site"""),
}


def dialect(engine: str) -> dict[str, str]:
    if engine == "spark":
        return {"us": "unix_micros(cast(ts as timestamp))",
                **{f"seq{n}": f"explode(sequence(0L, {n - 1}L))" for n in (5, 12, 48)}}
    return {"us": "epoch_us(ts)", **{f"seq{n}": f"unnest(range({n}))" for n in (5, 12, 48)}}


def fill(text: str, engine: str) -> str:
    for k, v in dialect(engine).items():
        text = text.replace("{" + k + "}", v)
    return text.replace('"', "`") if engine == "spark" and '{"type"' not in text else text


def ordered(names: list[str], views: dict[str, tuple[list[str], str]]) -> list[str]:
    """Names and all they read, each after what it reads; base tables left out."""
    out: list[str] = []

    def visit(n: str) -> None:
        if n in views and n not in out:
            for d in views[n][0]:
                visit(d)
            out.append(n)

    for n in names:
        visit(n)
    return out


def _tasks(spark: SparkSession, sf_dir: str, base: str) -> int:
    """Tasks for the rows of a file that is a single split, however many rows become of each."""
    n = spark.read.parquet(f"{sf_dir}/{base}.parquet").count()
    return max(1, min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-n // ROWS_A_TASK))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a marine view over the Parquet files in ``sf_dir``."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    need = ordered([name], VIEWS)
    base = sorted({d for n in need for d in VIEWS[n][0] if d in BASE})
    spread = f"/*+ REPARTITION({_tasks(spark, sf_dir, 'supplier')}) */ " if EXPLODED & set(need) else ""
    parts = [f"{b} as (select {spread if b == 'supplier' else ''}* from parquet.`{sf_dir}/{b}.parquet`)" for b in base]
    parts += [f"{n} as ({fill(VIEWS[n][1], 'spark')})" for n in need]
    return spark.sql(f"with {', '.join(parts)} select * from {name}")
