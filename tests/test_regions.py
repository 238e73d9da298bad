"""Masks, regions and slicks against brute force and literal cases."""
import itertools
import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheenwake.operators import components, metrics, raster, regions, tiles
from sheenwake.functions.slicks import TRANSFORM
from sheenwake.sources import readers


def table(spark, arrays, name="cls", kind="int"):
    pdf = pd.concat([pd.DataFrame({"scene_id": s, "row": np.repeat(np.arange(a.shape[0]), a.shape[1]),
                                   "col": np.tile(np.arange(a.shape[1]), a.shape[0]), name: a.ravel()})
                     for s, a in arrays.items()])
    return spark.createDataFrame(pdf).withColumn(name, F.col(name).cast(kind))


def scenes(spark, arrays, px=10.0):
    return spark.createDataFrame([(s, a.shape[0], a.shape[1], px) for s, a in arrays.items()],
                                 "scene_id long, height int, width int, pixel_size_m double")


def flood(mask):
    """Label image of 8-connected regions by breadth-first search."""
    lab, k = np.zeros(mask.shape, int), 0
    for r, c in zip(*np.nonzero(mask)):
        if lab[r, c]:
            continue
        k, todo = k + 1, [(r, c)]
        lab[r, c] = k
        while todo:
            y, x = todo.pop()
            for dy, dx in itertools.product((-1, 0, 1), repeat=2):
                q = (y + dy, x + dx)
                if 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q] and not lab[q]:
                    lab[q] = k
                    todo.append(q)
    return lab


def groups(lab):
    return {frozenset(map(tuple, np.argwhere(lab == k))) for k in range(1, lab.max() + 1)}


def spiral(n):
    a = np.zeros((n, n), int)
    r0, c0, r1, c1 = 0, 0, n - 1, n - 1
    while r0 <= r1 and c0 <= c1:
        a[r0, c0:c1 + 1] = 1
        a[r0:r1 + 1, c1] = 1
        a[r1, c0 + 2:c1 + 1] = 1
        a[r0 + 2:r1 + 1, c0 + 2] = 1
        r0, c0, r1, c1 = r0 + 2, c0 + 2, r1 - 2, c1 - 2
    return a


@pytest.mark.parametrize("tile", [5, 16, 256])
def test_labels_match_flood_fill(spark, tile):
    rng = np.random.default_rng(0)
    arrays = {1: (rng.random((40, 33)) < .35).astype(int), 2: (rng.random((20, 50)) < .5).astype(int), 3: spiral(31)}
    got = components.label_regions(table(spark, arrays).where("cls = 1"), tile).toPandas()
    for s, a in arrays.items():
        mine = {frozenset(zip(g.row, g.col)) for _, g in got[got.scene_id == s].groupby("label")}
        assert mine == groups(flood(a))
    first = got.groupby(["scene_id", "label"])[["row", "col"]].apply(lambda g: (g.row * components.WIDE + g.col).min())
    assert (first.to_numpy() == first.index.get_level_values("label")).all()


def test_small_regions_and_holes(spark):
    a = np.zeros((60, 60), int)
    a[5:20, 5:25] = 1
    a[10:12, 10:12] = 0
    a[30:33, 30:33] = 1
    got = components.drop_small_regions(table(spark, {1: a}), 1, 60, 16).toPandas()
    want = np.zeros_like(a)
    want[5:20, 5:25] = 1
    assert set(zip(got.row, got.col)) == set(map(tuple, np.argwhere(want)))


def test_literal_slicks(spark):
    bar, square, speck, two, none = (np.zeros((128, 128), int) for _ in range(5))
    bar[60:68, 20:110] = 1
    square[20:40, 20:40] = 1
    speck[0:3, 0:3] = 1
    two[10:20, 10:40] = 1
    two[60:80, 60:100] = 1
    arrays = {1: bar, 2: square, 3: speck, 4: two, 5: none}
    m = table(spark, arrays)
    s10 = regions.characterize(m, scenes(spark, arrays)).toPandas()
    b = s10[s10.scene_id == 1].iloc[0]
    assert b.orientation_deg == pytest.approx(90, abs=5) and b.elongation > 5 and b.solidity == 1.0
    sq = s10[s10.scene_id == 2].iloc[0]
    assert sq.area_px == 400 and sq.perimeter_m == 760.0
    assert set(s10.scene_id) == {1, 2, 4}
    t = s10[s10.scene_id == 4].sort_values("size_rank")
    assert list(t.area_px) == [800, 300] and list(t.slick_no) == [2, 1]
    s20 = regions.characterize(m, scenes(spark, arrays, 20.0)).toPandas()
    assert s20[s20.scene_id == 2].area_m2.iloc[0] == 4 * sq.area_m2
    assert (s10.age_confidence == "low").all() and (s10.mean_backscatter == -1).all()


def test_geojson_says_which_coordinates(spark):
    a = np.zeros((40, 40), int)
    a[5:20, 5:25] = 1
    m, sc = table(spark, {1: a}), scenes(spark, {1: a})
    flat = regions.slicks_to_geojson(regions.characterize(m, sc)).first().feature
    assert json.loads(flat)["properties"]["coordinate_space"] == "pixel"
    geo = sc.select("*", *[F.lit(v).alias(n) for n, v in zip(TRANSFORM, (73.0, .001, 0.0, 19.0, 0.0, -.001))])
    text = regions.feature_collections(regions.slicks_to_geojson(regions.characterize(m, geo))).first().geojson
    f = json.loads(text)["features"][0]
    assert f["properties"]["coordinate_space"] == "geographic"
    assert f["geometry"]["coordinates"] == pytest.approx([73.0145, 18.988])


def test_hull_counts_pixels():
    assert regions.hull_pixels([0, 1, 2], [0, 0, 0], [2, 2, 2]) == 9
    # An L fills the triangle between its arms.
    assert regions.hull_pixels([0, 1, 2], [0, 0, 0], [0, 0, 2]) == 6


def test_contour_goes_round_and_keeps_corners_apart():
    ring = regions.contour([1, 2, 2, 3], [1, 1, 3, 1], [3, 1, 3, 3], 6, 6)
    assert ring[0] == ring[-1] and len(ring) == 13
    apart = regions.contour([1, 2], [1, 2], [1, 2], 6, 6)
    assert len(apart) == 5
    edge = regions.contour([0, 1], [0, 0], [1, 1], 6, 6)
    assert edge[0] != edge[-1] and len(edge) == 4
    assert len(regions.simplify([(0., float(i)) for i in range(50)], 1.5)) == 2


def loop_lee(a):
    p = np.pad(a, 2, mode="symmetric")
    w = np.lib.stride_tricks.sliding_window_view(p, (5, 5))
    m, q = w.mean((2, 3)), (w ** 2).mean((2, 3))
    ci2 = np.maximum(q - m * m, 0) / m ** 2
    return m + np.clip((ci2 - .523 ** 2) / np.maximum(ci2, 1e-8), 0, 1) * (a - m)


def image(df, value="value", **where):
    x = df.toPandas()
    for k, v in where.items():
        x = x[x[k] == v]
    return x.pivot(index="row", columns="col", values=value).to_numpy()


@pytest.mark.parametrize("block", [3, 16, 256])
def test_lee_filter_matches_a_loop(spark, block):
    rng = np.random.default_rng(4)
    arrays = {1: rng.random((14, 17)) + .1, 2: rng.random((1, 5)) + .1, 3: rng.random((33, 16)) + .1}
    got = raster.lee_filter(table(spark, arrays, "value", "double"), block=block)
    for k, a in arrays.items():
        assert np.allclose(image(got, scene_id=k), loop_lee(a))


def test_large_scene_over_several_blocks(spark):
    rng = np.random.default_rng(8)
    a = rng.random((300, 270)) + .1
    px = table(spark, {1: a}, "value", "double")
    lee = loop_lee(a)
    assert np.allclose(image(raster.lee_filter(px)), lee)
    lo, hi = np.percentile(lee, [2, 98])
    assert np.allclose(image(raster.preprocess(px)), np.clip((lee - lo) / (hi - lo), 0, 1))


def test_absent_pixels_stay_absent(spark):
    a = np.full((9, 9), 2.0)
    px = table(spark, {1: a}, "value", "double").where("not (row = 4 and col = 4)")
    got = raster.lee_filter(px, block=4).toPandas()
    assert len(got) == 80 and np.allclose(got.value, 2.0)
    p = raster.score_tiles(px, scenes(spark, {1: a}), lambda: lambda x: np.repeat(x[:, None], 5, 1), 4, 2, block=4)
    assert p.select("row", "col").distinct().count() == 80 and p.count() == 400
    assert raster.lee_filter(px.limit(0)).count() == 0
    assert raster.score_tiles(px.limit(0), scenes(spark, {1: a}), lambda: None, 4, 2).count() == 0


def loop_blend(a, tile, overlap, net):
    h, w = a.shape
    tile = min(tile, h, w)
    at = lambda n: sorted({*range(0, n - tile + 1, max(tile - overlap, 1)), n - tile})
    ramp = np.hanning(tile) if tile > 2 else np.ones(tile)
    blend = np.outer(ramp, ramp) + 1e-3
    acc, mass = np.zeros((5, h, w)), np.zeros((h, w))
    for y in at(h):
        for x in at(w):
            z = np.exp(net(a[None, y:y + tile, x:x + tile].astype(np.float32)).astype(float))[0]
            acc[:, y:y + tile, x:x + tile] += z / z.sum(0) * blend
            mass[y:y + tile, x:x + tile] += blend
    return acc / mass


@pytest.mark.parametrize("tile,overlap,block", [(16, 4, 16), (16, 5, 7), (256, 64, 256), (20, 0, 64)])
def test_scored_tiles_match_a_loop(spark, tile, overlap, block):
    def see_tile(x):
        """Logits that depend on the whole tile, so that tiles do not agree where they overlap."""
        m = x.mean((1, 2), keepdims=True)
        return np.stack([x, x * m, m - x, x * x, 0 * x], 1)

    rng = np.random.default_rng(9)
    arrays = {1: rng.random((40, 35)), 2: rng.random((6, 50)), 3: rng.random((280, 20) if tile == 256 else (17, 16))}
    got = raster.score_tiles(table(spark, arrays, "value", "double"), scenes(spark, arrays), lambda: see_tile, tile, overlap, block=block)
    x = got.toPandas()
    for k, a in arrays.items():
        want = loop_blend(a, tile, overlap, see_tile)
        for c in range(5):
            part = x[(x.scene_id == k) & (x.cls == c)].pivot(index="row", columns="col", values="p").to_numpy()
            assert np.allclose(part, want[c], atol=1e-6)


def test_a_model_gets_several_tiles_in_a_call(spark):
    arrays = {1: np.ones((40, 40)), 2: np.ones((24, 40))}
    net = lambda x: np.full((len(x), 5, *x.shape[1:]), 0.0) + np.array([len(x), 0, 0, 0, 0]).reshape(1, 5, 1, 1)
    px = table(spark, arrays, "value", "double").coalesce(1)
    p = raster.score_tiles(px, scenes(spark, arrays), lambda: net, 8, 0).where("cls = 0").agg({"p": "max"}).first()[0]
    assert p > np.exp(2) / (np.exp(2) + 4)


def test_flat_scene_stretches_to_zero(spark):
    got = raster.percentile_stretch(table(spark, {1: np.full((8, 8), .3)}, "value", "double"))
    assert {r.value for r in got.collect()} == {0.0}


def test_palette_survives_drift_and_resize_invents_nothing(spark):
    rng = np.random.default_rng(6)
    a = rng.integers(0, 5, (24, 24))
    rgb = np.array(raster.PALETTE)[a] + rng.integers(-9, 10, (24, 24, 3))
    df = table(spark, {1: a})
    pal = table(spark, {1: rgb[..., 0]}, "r")
    for i, c in ((1, "g"), (2, "b")):
        pal = pal.join(table(spark, {1: rgb[..., i]}, c), ["scene_id", "row", "col"])
    assert raster.decode_mask(pal).exceptAll(df.select("scene_id", "row", "col", "cls")).count() == 0
    small = raster.resize_scene(df, scenes(spark, {1: a}), 10, labels=True).toPandas()
    assert len(small) == 100 and set(small.cls) <= set(a.ravel())


def test_proposals_match_in_order(spark):
    rng = np.random.default_rng(12)
    rows = [(s, g, p, int(rng.integers(1, 10)), 10) for s in range(6) for g in range(9) for p in range(9) if rng.random() < .5]
    want = set()
    for s in range(6):
        used = set()
        for g in range(9):
            free = sorted(((-i / u, p) for a, b, p, i, u in rows if (a, b) == (s, g) and p not in used and i / u >= .1))
            if free:
                used.add(free[0][1])
                want.add((s, g, free[0][1]))
    df = spark.createDataFrame(rows, "scene_id long, g long, p long, inter long, union_px long")
    assert {(r.scene_id, r.g, r.p) for r in metrics.match_instances(df).collect()} == want
    assert metrics.match_instances(df.limit(0)).count() == 0


def test_histograms_of_runs_merge(spark):
    rows = [(float(k) / 97, int(k % 3 == 0)) for k in range(97)] + [(None, 1), (.5, 0)]
    df = spark.createDataFrame(rows, "score double, truth int")
    marks = [.5, .25, .9, 0.0]
    got = {r.threshold: r for r in metrics.screen_threshold_table(df, marks).collect()}
    for t in marks:
        hit = [y for s, y in rows if s is not None and s >= t]
        assert got[t].recall == sum(hit) / sum(y for _, y in rows) and got[t].precision == sum(hit) / len(hit)
        assert got[t].screened_out == pytest.approx(1 - len(hit) / len(rows))
    parts = metrics.score_histogram(df.where("score < 0.4"), marks).union(metrics.score_histogram(df.where("score is null or score >= 0.4"), marks))
    assert {r.threshold: r for r in metrics.thresholds_from(parts, marks).collect()} == got


def test_all_look_alike_called_oil(spark):
    t, p = {1: np.full((8, 8), 2)}, {1: np.full((8, 8), 1)}
    cm = metrics.confusion_matrix(table(spark, t), table(spark, p))
    assert metrics.oil_lookalike_confusion(cm).first().false_oil_rate == 1.0
    r = metrics.iou_report(cm).first()
    assert r.iou_ship is None and r.iou_oil_spill == 0.0 and r.miou == 0.0 and r.pixel_accuracy == 0.0


def test_matching_is_the_greedy_rule(spark):
    rng = np.random.default_rng(8)
    rows, want = [], set()
    for s in range(20):
        n = {(g, p): (int(rng.integers(1, 30)), int(rng.integers(40, 90))) for g in range(6) for p in range(6) if rng.random() < .5}
        rows += [(s, g, p, i, u) for (g, p), (i, u) in n.items()]
        used = set()
        for g in range(6):
            best = max(((i / u, -p) for (h, p), (i, u) in n.items() if h == g and p not in used), default=None)
            if best and best[0] >= .1:
                used.add(-best[1])
                want.add((s, g, -best[1]))
    df = spark.createDataFrame(rows, "scene_id long, g long, p long, inter long, union_px long")
    assert {(r.scene_id, r.g, r.p) for r in metrics.match_instances(df).collect()} == want


def test_scene_files_are_paired(spark, tmp_path):
    for p in ("train/images/a.jpg", "train/images/b.png", "train/labels/a.png", "train/labels/a.bmp", "train/labels/b.tif"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x")
    got = {r.stem: r.label.split("/")[-1] for r in readers.read_scene_files(spark, str(tmp_path)).collect()}
    assert got == {"a": "a.png", "b": "b.tif"}
    (tmp_path / "train/images/c.png").write_bytes(b"x")
    with pytest.raises(Exception, match="no label for"):
        readers.read_scene_files(spark, str(tmp_path)).collect()


def test_tiles_and_shapes_are_no_frames_of_their_own(spark, capsys):
    """Thousands of small tiles and regions: rows that stand together are worked on as arrays, not a pandas frame each."""
    a = np.zeros((9, 9), int)
    a[1:4, 1:4] = a[6, 5:9] = 1
    df = table(spark, {1: a, 2: a.T})
    labelled = components.label_regions(df.where("cls = 1"), 4)
    shapes = regions.region_shapes(labelled, scenes(spark, {1: a, 2: a.T}))
    shapes.explain()
    text = capsys.readouterr().out
    assert "MapInArrow" in text and "Pandas" not in text
    assert {(r.scene_id, r.label): r.hull_px for r in shapes.collect()} == {
        (s, x): n for s, spots in ((1, ((1, 1), (6, 5))), (2, ((1, 1), (5, 6)))) for x, n in zip([r * components.WIDE + c for r, c in spots], (9, 4))}


def test_groups_keep_nulls_together():
    b = lambda k, v: pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(v)], ["k", "v"])
    got = [(k, sum(len(p) for p in parts)) for k, parts in tiles.groups(iter([b([None, None, 1], [1, 2, 3]), b([1, 2], [4, 5])]), 1)]
    assert got == [((None,), 2), ((1,), 2), ((2,), 1)]


def test_pixels_of_a_block_are_shuffled_together(spark, monkeypatch):
    a = np.arange(700.0).reshape(20, 35)
    px = table(spark, {3: a, 4: -a}, "value", "double").coalesce(2)
    moved = tiles._by_block(px, 8, 1, [F.col("value")])
    # a row is pixels of a block, some 12 blocks of up to 100 pixels in each scene, not a pixel
    assert moved.count() <= 2 * 2 * 15
    want = raster.lee_filter(px, block=64).orderBy("scene_id", "row", "col").toPandas()
    got = raster.lee_filter(px, block=8).orderBy("scene_id", "row", "col").toPandas()
    assert len(got) == 1400 and np.allclose(got["value"], want["value"], rtol=1e-12)
    back = tiles.to_pixels(tiles.to_blocks(px, 8)).orderBy("scene_id", "row", "col").toPandas()
    assert np.array_equal(back["value"], np.r_[a.ravel(), -a.ravel()])
