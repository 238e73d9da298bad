"""Reports near origins, cleaned per (origin, vessel), by groups of origins next to the vessels around them.

A report is near dozens of origins. Here it is sent once to a group of origins, and box, repeated times and
teleports of each origin are worked out in NumPy where reports and origins meet, so near rows are not shuffled.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import cut_lineage, spread
from .ais import TELEPORT_KN, accepted
from .origins import ais_near_origin, loading_boxes
from .tiles import groups

#: Side (degrees, s) and number of the origins of a group, reports that meet it in one task, reports sent on at once.
GROUP_DEG, GROUP_S, GROUP_ORIGINS = 4.0, 12 * 3600.0, 256
BLOCK_FIXES, FIXES_OUT = 100_000, 4096
BLOCK = ["group_", "fleet_"]
BOX = ["lat_min", "lat_max", "lon_min", "lon_max", "load0", "load1"]


def origin_groups(summary: DataFrame, lookback_h: float) -> DataFrame:
    """(group_, origin_id and BOX, t0, t1): origins whose boxes are near each other, a bounded number of them."""
    boxes = loading_boxes(summary, lookback_h)
    mid = lambda c: F.floor((F.col(f"{c}_min") + F.col(f"{c}_max")) / 2 / GROUP_DEG)
    place = boxes.withColumns({"gy": mid("lat"), "gx": mid("lon"), "gt": F.floor(F.col("load0") / GROUP_S)})
    n = place.groupBy("gy", "gx", "gt").agg(F.ceil(F.count("*") / GROUP_ORIGINS).alias("parts"))
    part = F.pmod(F.xxhash64("origin_id"), F.col("parts"))
    return place.join(n, ["gy", "gx", "gt"]).select(
        F.concat_ws("/", "gy", "gx", "gt", part).alias("group_"), "origin_id", "t0", "t1", *BOX)


def _cleaned(x: pa.Table, boxes: dict[str, np.ndarray], max_kn: float) -> np.ndarray:
    """Which rows of ``x`` (columns) stay for which origin of a block (rows); ``x`` is in order of vessel, time and rank_."""
    t, lat, lon = (np.asarray(x[c].to_numpy(), float) for c in ("t", "lat", "lon"))
    track, rank = x["track_"].to_numpy(), x["rank_"].to_numpy()
    kept = np.zeros((len(boxes["load0"]), len(t)), bool)
    for o, stay in enumerate(kept):
        own = {c: v[o] for c, v in boxes.items()}
        row = np.flatnonzero((lat >= own["lat_min"]) & (lat <= own["lat_max"]) & (lon >= own["lon_min"]) & (lon <= own["lon_max"])
                             & (t >= own["load0"]) & (t <= own["load1"]))
        if not len(row):
            continue
        who, when = track[row], t[row]
        # reports without a vessel are no track: each stands for itself
        first = np.r_[True, (who[1:] != who[:-1]) | (when[1:] != when[:-1]) | (who[1:] < 0)]
        at = row[first]
        stays = accepted(track[at], t[at], lat[at], lon[at], max_kn) | (track[at] < 0)
        moment = np.cumsum(first) - 1
        # of a time that occurs twice all that are first in order stay; without an order there is no first
        stay[row] = stays[moment] & (rank[row] == rank[at][moment]) & (rank[row] > 0)
    return kept


def clean_near(marked: DataFrame, summary: DataFrame, lookback_h: float, max_kn: float = TELEPORT_KN,
               block_fixes: int = BLOCK_FIXES) -> DataFrame:
    """``marked`` reports near each origin, one for each (origin, vessel, time), without teleports, and origin_id.

    ``rank_`` tells the reports of a vessel and time apart: 1 is the first, 0 one without an order. The vessels
    around a group with very many reports are split, and its origins copied, so a block holds about
    ``block_fixes`` reports, or all of one vessel in the hours of its group.
    """
    members = cut_lineage(origin_groups(summary, lookback_h))
    whole = members.groupBy("group_").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), *[
        f(c).alias(c) for c, f in (("lat_min", F.min), ("lat_max", F.max), ("lon_min", F.min), ("lon_max", F.max))])
    fixes = cut_lineage(ais_near_origin(marked, whole, lookback_h).drop("t0", "t1"))
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    busy = cut_lineage(fixes.groupBy("group_").agg(F.ceil(F.count("*") / block_fixes).alias("fleets_")).where("fleets_ > 1"))
    cols = [c for c in marked.columns if c != "rank_"]
    fixes = (fixes.join(busy, "group_", "left").withColumn("fleet_", F.pmod(F.xxhash64("mmsi"), F.coalesce("fleets_", one)))
             .select(*BLOCK, *cols, "rank_", F.lit(False).alias("is_origin_")))
    boxes = (members.join(busy, "group_", "left")
             .withColumn("fleet_", F.explode(F.sequence(zero, F.coalesce("fleets_", one) - 1)))
             .select(*BLOCK, "origin_id", *BOX, F.lit(True).alias("is_origin_")))
    both = fixes.unionByName(boxes, allowMissingColumns=True)
    origin, fields = summary.schema["origin_id"].dataType, marked.select(*cols).schema.fields
    ids = to_arrow_type(origin)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in groups(batches, len(BLOCK)):
            both = pa.Table.from_batches(parts).combine_chunks()
            there, x = both.filter(both["is_origin_"]), both.filter(pc.invert(both["is_origin_"]))
            if not len(there) or not len(x):
                continue
            x = x.append_column("track_", x["mmsi"].combine_chunks().dictionary_encode().indices.fill_null(-1)).sort_by(
                [("track_", "ascending"), ("t", "ascending"), ("rank_", "ascending")]).combine_chunks()
            kept = _cleaned(x, {c: there[c].to_numpy() for c in BOX}, max_kn)
            names = there["origin_id"].combine_chunks().cast(ids)
            for a in range(0, len(x), FIXES_OUT):
                row, o = np.nonzero(kept[:, a:a + FIXES_OUT].T)
                if len(row):
                    n = np.bincount(row)
                    ends = pa.array(np.r_[0, np.cumsum(n[n > 0])], pa.int32())
                    got = x.select(cols).take(pa.array(a + np.flatnonzero(n)))
                    yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in got.columns),
                                                      pa.ListArray.from_arrays(ends, names.take(pa.array(o)))], [*cols, "origins_"])

    made = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    cleaned = spread(both, *BLOCK).sortWithinPartitions(*BLOCK).mapInArrow(clean, f"{made}, origins_ array<{origin.simpleString()}>")
    # a report goes to its origins last of all, so a table holds it next to itself
    return cleaned.select(F.explode("origins_").alias("origin_id"), *cols)
