"""What the as-of lookup carries along when samples are many times the fixes."""
from sheenwake.operators import asof


def _frames(spark):
    fixes = [(1, 10.0, 0.0), (1, 50.0, 4.0), (1, 95.0, 8.5), (2, 33.0, 1.0), (None, 5.0, 1.0), (4, None, 1.0)]
    samples = [(m, 100 * m + k, 7.0 * k) for m in (1, 2, 3) for k in range(16)] + [(None, 1, 5.0), (1, 2, None), (4, 3, 5.0)]
    return (spark.createDataFrame(fixes, "mmsi long, t double, lat double"),
            spark.createDataFrame(samples, "mmsi long, sample_id long, t double"))


def test_samples_are_not_aggregated_with_the_ends_of_buckets(spark):
    plan = asof.asof_rows(*_frames(spark), ["mmsi"], ["t", "lat"], 10.0)._jdf.queryExecution().optimizedPlan().toString()
    ends = [line for line in plan.splitlines() if "min_by(" in line]
    assert ends and not [line for line in ends if "is_sample" in line]


def test_buckets_of_samples_alone_find_the_fixes_around(spark):
    fixes, samples = _frames(spark)
    rows = asof.asof_rows(fixes, samples, ["mmsi"], ["t", "lat"], 10.0).where("is_sample").collect()
    assert len(rows) == samples.count()
    tracks = {1: [10.0, 50.0, 95.0], 2: [33.0]}
    for r in rows:
        known = tracks.get(r["mmsi"], []) if r["t"] is not None else []
        got = tuple(x and x["t"] for x in (r["prev"], r["next"]))
        if r["mmsi"] in (1, 2, 3) and r["t"] is not None:
            assert got == (max([t for t in known if t <= r["t"]], default=None), min([t for t in known if t >= r["t"]], default=None))
