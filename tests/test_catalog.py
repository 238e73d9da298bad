"""Every query of the catalogue next to its plain SQL on the smallest tables."""
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sheenwake.operators import incidents
from sheenwake.plans import catalog
from sheenwake.sources import demo, readers, writers

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

# Queries of the optional text operators have their tests in tests/llm.
QUERIES = {k: q for k, q in entry.queries().items() if k in catalog.queries()}
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for b in demo.BASE:
        con.execute(f"create view {b} as select * from '{SF}/{b}.parquet'")
    return con


def rows(frame, cols):
    def plain(x):
        if x is None or str(x) in ("nan", "<NA>", "NaT"):
            return None
        return x.item() if hasattr(x, "item") else x

    out = [tuple(plain(x) for x in r) for r in frame[cols].astype(object).itertuples(index=False)]
    return sorted(out, key=lambda r: [(x is None, isinstance(x, str), x if x is not None else 0) for x in r])


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = rows(df.toPandas(), cols)
    if name not in SQL:
        assert got
        return
    want = duck.execute(SQL[name]).df()
    assert sorted(want.columns) == cols
    want = rows(want, cols)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, (int, float)) and math.isclose(x, y, rel_tol=0, abs_tol=1e-9)), (a, b)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_slick_is_followed(spark):
    from pyspark.sql import functions as F
    from sheenwake.plans import jobs
    from sheenwake.plans.context import context
    c = context(spark, SF)
    scenes = c.t("scene").join(c.t("slick_drift").select(F.col("slick_id").alias("scene_id"), "t_detect"), "scene_id")
    x = jobs.investigate(scenes, c.t("pixel"), c.t("ais"), c.t("field"), mask=c.t("mask"), prob=c.t("prob"),
                         order="ord", canonical=True, n_particles=10)
    key = ["scene_id", "slick_no"]
    ids = lambda df: {tuple(r) for r in df.select(*key).distinct().collect()}
    found = ids(x["slicks"])
    assert len(found) > len({s for s, _ in found})
    assert ids(x["drift"]["particles"]) == ids(x["drift"]["spread"]) == ids(x["forecast"]) == ids(x["attribution"]["summary"]) == found
    assert {r["n"] for r in x["drift"]["particles"].groupBy(*key).agg(F.count("*").alias("n")).collect()} == {10}
    assert ids(x["report"]) <= found and len(ids(x["report"])) > len({s for s, _ in ids(x["report"])})


def test_sinks(spark, tmp_path):
    from sheenwake.plans.context import context
    c = context(spark, SF)
    cur = incidents.by_priority(c.once("curated"))
    writers.write_curated(cur, str(tmp_path / "cur"))
    back = spark.read.csv(str(tmp_path / "cur"), header=True)
    assert back.count() == cur.count() and "vessel_guess" in back.columns
    again = incidents.read_fields(readers.read_incidents(spark, str(tmp_path / "cur")))
    assert again.where("lat is null").count() == 0
    writers.write_report(QUERIES["snk2_suspects_report"](spark, SF), str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep")).count() == QUERIES["snk2_suspects_report"](spark, SF).count()
    page = tmp_path / "page.json"
    page.write_text('{"type":"FeatureCollection","features":[{"id":7,"properties":{"source_type":"VESSEL"},'
                    '"geometry":{"type":"MultiPolygon","coordinates":[[[[70.5,-3.25],[71,2]]]]}},'
                    '{"id":8,"properties":{},"geometry":null}]}')
    f = {r.id: (r.lon, r.lat, r.source_type) for r in readers.read_features(spark, str(tmp_path / "page.json")).collect()}
    assert f == {"7": (70.5, -3.25, "VESSEL"), "8": (None, None, None)}
