"""Rasters, vectors and classification on small files."""

import json
import os
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave import queries
from orbweave.functions import crs as C
from orbweave.functions import geo
from orbweave.operators import raster as R
from orbweave.operators import samples as A
from orbweave.operators import smoothing as M
from orbweave.plans import classify, mosaic
from orbweave.sources import raster as files
from orbweave.sources import vector


def table(spark, a):
    rows = [(r, c, [float(v) for v in np.atleast_1d(a[r, c])]) for r in range(a.shape[0]) for c in range(a.shape[1])]
    return spark.createDataFrame(rows, "r int, c int, bands array<double>")


@pytest.mark.parametrize("dtype", ["uint8", "int16", "float32", "float64"])
def test_tiff_round_trip(spark, tmp_path, dtype):
    rng = np.random.default_rng(1)
    a = (rng.random((37, 23, 3)) * 100).astype(dtype)
    grid = R.Grid(23, 37, (3.0, 0.0, 100.0, 0.0, -3.0, 200.0), "EPSG:32633", (7.0,))
    files.write_array(str(tmp_path / "a.tif"), a, grid)
    back, h = files.read_array(str(tmp_path / "a.tif"))
    assert np.array_equal(a, back) and h.grid.transform == grid.transform and h.grid.crs == grid.crs and h.grid.nodata == (7.0,) * 3
    pixels, _ = files.read(spark, str(tmp_path / "a.tif"))
    found = {(r["r"], r["c"]): r["bands"] for r in pixels.collect()}
    assert len(found) == 37 * 23 and found[5, 7] == a[5, 7].astype(float).tolist()


def test_alignment_to_a_coarser_grid(spark):
    fine = table(spark, np.arange(16).reshape(4, 4))
    out = R.align(fine, R.Grid(4, 4, (0.5, 0, 0, 0, -0.5, 2), "EPSG:3857"), R.Grid(2, 2, (1, 0, 0, 0, -1, 2), "EPSG:3857"))
    assert {(r["r"], r["c"]): r["bands"][0] for r in out.collect()} == {(0, 0): 5, (0, 1): 7, (1, 0): 13, (1, 1): 15}
    with pytest.raises(ValueError):
        R.align(fine, R.Grid(4, 4, (0.5, 0, 0, 0, -0.5, 2)), R.Grid(2, 2, (1, 0, 0, 0, -1, 2), "EPSG:3857"))


def test_distance(spark):
    grid = R.Grid(5, 5, (10, 0, 0, 0, -10, 50), "EPSG:32633")
    square = json.dumps(geo.box(20, 20, 30, 30).to_json())
    cells = R.rasterized(spark.createDataFrame([(0, 1, square)], "fid int, label int, geometry string"), grid)
    d = {(r["r"], r["c"]): r["distance"] for r in R.distance(cells, grid).collect()}
    assert (d[2, 2], d[2, 3]) == (0, 10) and d[1, 1] == pytest.approx(np.sqrt(200), abs=1e-4)
    with pytest.raises(ValueError):
        R.distance(cells.limit(0), grid)


def test_envelope_is_the_minimum():
    rng = np.random.default_rng(3)
    for _ in range(50):
        h = np.where(rng.random(30) < 0.5, np.inf, rng.integers(0, 50, 30).astype(float))
        h[rng.integers(30)] = 1.0
        brute = (h[None] + 4 * (np.arange(30)[:, None] - np.arange(30)) ** 2).min(axis=1)
        assert np.allclose(R.envelope(h, 2.0), brute)


def test_blocks_don_t_show_in_smoothing(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet(np.ones(3), (20, 17))
    valid = rng.random((20, 17)) > 0.1
    rows = [(r, c, p[r, c].tolist(), bool(valid[r, c])) for r in range(20) for c in range(17)]
    pixels = spark.createDataFrame(rows, "r int, c int, p array<double>, valid boolean")
    whole = M.icm(np.log(p + 1e-9), valid, 1.0, 8, 3)
    got = M.icm_smooth(pixels, 17, 20, neighborhood=8, shape=(6, 5))
    assert all(whole[r["r"], r["c"]] == r["label"] for r in got.collect()) and got.count() == 340
    whole = M.bayes(p, valid, 5, 0.5, [20.0] * 3)
    for r in M.bayes_smooth(pixels, 17, 20, 3, 5, shape=(6, 5)).collect():
        assert np.allclose(r["p"], whole[r["r"], r["c"]], equal_nan=True)
    for bad in (dict(window=4), dict(fraction=0.0), dict(smoothness=[1.0])):
        with pytest.raises(ValueError):
            M.bayes_smooth(pixels, 17, 20, 3, **bad)


def test_bands_and_nodata():
    assert R.nodata_list(5, 3) == [5, 5, 5] and R.nodata_list([1, 2], 3) == [1, 2, None] and R.nodata_list(None, 2) == [None, None]
    assert R.band_list([3, 1], 4) == [3, 1]
    for bad in ([], [1, 1], [0], [5]):
        with pytest.raises(ValueError):
            R.band_list(bad, 4)


def test_ndvi_edges(spark):
    rows = spark.createDataFrame([(0.0, 5.0), (2.0, 6.0), (-3.0, 3.0), (3.0, -3.0)], "red double, nir double").select(R.ndvi(F.col("red"), F.col("nir")).alias("v"))
    most = float(np.finfo("float32").max)
    assert [r["v"] for r in rows.collect()] == [0.0, 0.5, most, -most]


def test_split_quotas():
    assert A.quotas({1: 10, 2: 20}, 0.3) == {1: 3, 2: 6}
    assert A.quotas({1: 1, 2: 20}, 0.3) is None
    assert sum(A.quotas({1: 7, 2: 8, 3: 9}, 0.25).values()) == 6


def test_coordinate_systems():
    x, y = C.forward(6933, 180, 90)
    assert (x, y) == (pytest.approx(17367530.445161, abs=1e-5), pytest.approx(7342230.136499, abs=1e-5))
    rng = np.random.default_rng(7)
    lon, lat = rng.uniform(12, 18, 200), rng.uniform(-79, 79, 200)
    for n in (3857, 6933, 32633, 32733):
        a, b = C.inverse(n, *C.forward(n, lon, lat))
        assert np.allclose(a, lon, atol=1e-9) and np.allclose(b, lat, atol=1e-9)
    with pytest.raises(ValueError):
        C.code("EPSG:2056")


def test_boxes_touch():
    triangle = geo.Geometry.read({"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [0, 4]]]})
    a = lambda *v: np.array(v, float)
    assert triangle.touches(a(1, 3, 4, 2, -1), a(1, 3, 0, 2, -1), a(1.5, 4, 5, 3, 9), a(1.5, 4, 1, 3, 9)).tolist() == [True, False, True, True, True]


def test_geopackage_round_trip(tmp_path):
    path = str(tmp_path / "p.gpkg")
    vector.write_geopackage(path, [(1.0, 2.0, {"truth": 1, "pred": 2, "name": "a"}), (3.0, 4.0, {"truth": 2, "pred": 2, "name": "b"})], 32633)
    found, crs = vector.features(path)
    assert crs == "EPSG:32633" and [g.bounds()[:2] for g, _ in found] == [(1.0, 2.0), (3.0, 4.0)] and found[1][1]["name"] == "b"
    assert sqlite3.connect(path).execute("SELECT count(*) FROM points").fetchall() == [(2,)]


def test_area_of_many_features(spark, tmp_path):
    path = tmp_path / "a.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"k": k}, "geometry": geo.box(k, 0, k + 1, 1).to_json()} for k in range(3)]}))
    area, crs = vector.load_area(str(path))
    assert area.bounds() == (0, 0, 3, 1) and crs == "EPSG:4326"
    assert vector.read(spark, str(path)).count() == 3
    path.write_text(json.dumps({"type": "FeatureCollection", "features": []}))
    with pytest.raises(ValueError):
        vector.load_area(str(path))


@pytest.fixture
def scene(tmp_path):
    """Two classes that bands tell apart, and polygons over both."""
    rng = np.random.default_rng(2)
    truth = np.where(np.arange(30) < 15, 1, 2)[None, :].repeat(20, 0)
    a = np.stack([truth * 10 + rng.normal(0, 1, truth.shape), rng.normal(0, 1, truth.shape)], axis=2).astype("float32")
    grid = R.Grid(30, 20, (3.0, 0.0, 0.0, 0.0, -3.0, 60.0), "EPSG:32633", (-9999.0,))
    files.write_array(str(tmp_path / "img.tif"), a, grid)
    features = [{"type": "Feature", "id": f"f{v}", "properties": {"cls": n}, "geometry": geo.box(x0, 6, x1, 54).to_json()} for v, n, x0, x1 in ((1, "forest", 3, 42), (2, "water", 48, 87))]
    (tmp_path / "labels.geojson").write_text(json.dumps({"type": "FeatureCollection", "crs": {"properties": {"name": "EPSG:32633"}}, "features": features}))
    return tmp_path, truth


def test_train_predict_smooth(spark, scene):
    tmp, truth = scene
    classify.train_rf(str(tmp / "img.tif"), str(tmp / "labels.geojson"), "cls", str(tmp / "model"), n_estimators=10, max_depth=4, spark=spark)
    out = classify.predict_rf(str(tmp / "img.tif"), str(tmp / "model"), str(tmp / "out.vrt"), str(tmp / "probs.tif"), str(tmp / "bin"), smooth="mrf", spark=spark)
    assert out.endswith("out.tif")
    got, h = files.read_array(out)
    assert h.dtype == "i2" and h.grid.nodata == (-1.0,) and (got[..., 0] == truth).mean() > 0.98
    layers = classify.export_points(spark, str(tmp / "model"), "EPSG:32633")
    assert [len(vector.features(p)[0]) > 20 for p in layers] == [True, True]
    one, _ = files.read_array(str(tmp / "bin/class_1.tif"))
    assert np.array_equal(one[..., 0], (got[..., 0] == 1).astype("uint8"))
    text = (tmp / "out_metrics.txt").read_text()
    assert "Raw accuracy: " in text and "forest" in text and "Smoothed accuracy: " in text and "band 1: " in text
    again = classify.smooth_probs(str(tmp / "probs.tif"), str(tmp / "smooth.tif"), class_values=[1, 2], smooth="bayes", spark=spark)
    assert (files.read_array(again)[0][..., 0] == truth).mean() > 0.98
    with pytest.raises(ValueError):
        classify.smooth_probs(str(tmp / "probs.tif"), str(tmp / "x.tif"), class_values=[1, 2, 3], spark=spark)
    with pytest.raises(ValueError):
        classify.train_rf(str(tmp / "img.tif"), str(tmp / "labels.geojson"), "nothing", str(tmp / "m"), spark=spark)


def test_mosaic_of_two_strips(spark, tmp_path):
    for k, value in enumerate((10, 20)):
        grid = R.Grid(8, 6, (3.0, 0.0, 12.0 * k, 0.0, -3.0, 18.0), "EPSG:32633", (0.0,))
        files.write_array(str(tmp_path / f"s/{k}.tif"), np.full((6, 8, 4), value, "float32"), grid)
        udm = np.ones((6, 8, 1), "uint8")
        udm[0] = 0
        files.write_array(str(tmp_path / f"u/{k}.tif"), udm, R.Grid(8, 6, grid.transform, None))
    out = mosaic.run_mosaic(mosaic.MosaicJob([str(tmp_path / "s")], str(tmp_path / "m.tif"), [str(tmp_path / "u")], ndvi=True), spark)
    a, h = files.read_array(out)
    assert a.shape == (6, 12, 5) and h.grid.crs == "EPSG:32633"
    assert (a[0] == 0).all() and a[3, 0, 0] == 10 and a[3, 11, 0] == 20 and 10 < a[3, 5, 0] < 20
    with pytest.raises(ValueError):
        mosaic.run_mosaic(mosaic.MosaicJob([str(tmp_path / "s")], "x", [str(tmp_path / "u/0.tif")]), spark)


def test_common_coordinate_system(spark):
    info = lambda crs, x: mosaic.ProjectionInfo("p", crs, crs, (x, 0.0))
    assert mosaic.target_crs(spark, [info("EPSG:32631", 3.0), info("EPSG:32632", 9.0), info("EPSG:32632", 9.0)]) == "EPSG:32632"
    assert mosaic.target_crs(spark, [info("EPSG:32631", 5.0), info("EPSG:32632", 9.0), info("EPSG:32631", 0.0), info("EPSG:32632", 12.0)]) == "EPSG:32631"
    assert mosaic.target_crs(spark, [info("EPSG:32631", 5.0)], "epsg:3857") == "EPSG:3857"
    with pytest.raises(ValueError):
        mosaic.target_crs(spark, [info("EPSG:32631", 5.0)], "nonsense")
    assert os.path.basename(mosaic.projection("x/y.tif", R.Grid(2, 2, (1, 0, 0, 0, -1, 0), "EPSG:4326")).path) == "y.tif"


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_nn_align_takes_in_every_row_of_the_raster(spark, size):
    sf = f"/root/testdata/{size}"
    label = {(int(v) // 25, int(v) % 25): int(k) + 1 for v, k in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label").collect()}
    height = max(r for r, _ in label) + 1
    want = {(r, c): label.get((int((r + 0.5) * 2.5), int((c + 0.5) * 2.5))) for r in range(-(-height * 2 // 5)) for c in range(10)}
    rows = queries.QUERIES["nn_align"](spark, sf).collect()
    assert len(rows) == len(want) == height * 4 and {(x["r"], x["c"]): x["label"] for x in rows} == want


def test_rf_predict_classifies_every_pixel_with_the_default_forest(spark, monkeypatch):
    asked, fit = [], classify.fit

    def small(samples, trees=500, depth=None, seed=42):
        asked.append((trees, depth))
        return fit(samples, 5, 4, seed)

    monkeypatch.setattr(classify, "fit", small)
    sf = "/root/testdata/sf0.001"
    pixels = {divmod(x["vec_id"], 25) for x in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}
    rows = queries.QUERIES["rf_predict"](spark, sf).collect()
    assert len(rows) == len(pixels) and {(x["r"], x["c"]) for x in rows} == pixels and asked == [(500, None)]


def test_a_whole_forest_tells_its_samples_classes_in_few_jobs(spark, tmp_path):
    import random

    from orbweave.operators import forest as T

    rng = random.Random(3)
    rows = [(20 if x[0] + x[1] > 1 else 100 if x[2] > 0.5 else 3, x) for x in ([rng.random() for _ in range(9)] for _ in range(400))]
    samples = spark.createDataFrame(rows, "label int, features array<double>")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    model = classify.fit(samples, 500)
    jobs = len(set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - set(before))
    assert jobs < 40 and classify.classes_of(model) == [100.0, 20.0, 3.0]  # in the order of their texts
    pixels = spark.createDataFrame([(k, 0, x) for k, (_, x) in enumerate(rows)], "r int, c int, bands array<double>")
    said = {r["r"]: r["class"] for r in classify.predicted(pixels, model).collect()}
    assert all(said[k] == label for k, (label, _) in enumerate(rows))
    p = {r["r"]: r["p"] for r in classify.probabilities(pixels, model).collect()}
    assert all(abs(sum(v) - 1) < 1e-9 for v in p.values())
    new = [[rng.random() for _ in range(9)] for _ in range(400)]
    right = sum(v == (20 if x[0] + x[1] > 1 else 100 if x[2] > 0.5 else 3) for x, v in zip(new, model.predict(np.array(new)), strict=True))
    assert right > 340 and max(range(9), key=model.feature_importances_.__getitem__) < 3 and sum(model.feature_importances_) == pytest.approx(1)
    assert T.fit(samples.repartition(7), 3, None, 5).predict(np.array(new)).tolist() == T.fit(samples, 3, None, 5).predict(np.array(new)).tolist()
    model.save(str(tmp_path / "m"))
    assert (T.Forest.load(str(tmp_path / "m")).predict(np.array(new)) == model.predict(np.array(new))).all()


def test_a_tree_is_cut_where_a_plain_search_cuts_it():
    from orbweave.operators import forest as T

    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 6, (60, 3)).astype(np.uint8), rng.integers(0, 3, 60)

    class Same:  # every row once
        def integers(self, a, b, n):
            return np.arange(n)

        def random(self, shape):
            return np.zeros(shape)

    (feature, cut, left, shares), _ = T.grow(x, y, 3, 3, None, Same())

    def gini(part):
        return (np.bincount(part, minlength=3) ** 2).sum() / len(part)

    def follow(k, rows):
        own = y[rows]
        if len(set(own.tolist())) == 1:
            assert feature[k] == -1 and left[k] == own[0]
            return
        tried = {(f, c): gini(own[x[rows, f] <= c]) + gini(own[x[rows, f] > c]) for f in range(3) for c in range(6) if 0 < (x[rows, f] <= c).sum() < len(rows)}
        if not tried:
            assert feature[k] == -2 and np.allclose(shares[left[k]], np.bincount(own, minlength=3) / len(own))
            return
        assert tried[feature[k], cut[k]] == pytest.approx(max(tried.values()))
        low = x[rows, feature[k]] <= cut[k]
        follow(left[k], rows[low])
        follow(left[k] + 1, rows[~low])

    follow(0, np.arange(60))
    (feature, *_), _ = T.grow(x, y, 3, 1, 2, rng)
    assert len(feature) <= 7


def packed_lzw(data):
    """A plain encoder: codes of growing length, the table cleared when it is full."""
    out, bits, n, size = bytearray(), 0, 0, 9
    table, word = {bytes([k]): k for k in range(256)}, b""

    def put(code):
        nonlocal bits, n
        bits, n = bits << size | code, n + size
        while n >= 8:
            out.append(bits >> (n - 8) & 255)
            n -= 8
            bits &= (1 << n) - 1

    put(256)
    for k in range(len(data)):
        longer = word + data[k : k + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = len(table) + 2
        word = data[k : k + 1]
        size = 9 if len(table) + 2 < 512 else 10 if len(table) + 2 < 1024 else 11 if len(table) + 2 < 2048 else 12
        if len(table) + 2 >= 4094:
            put(256)
            table, size = {bytes([k]): k for k in range(256)}, 9
    if word:
        put(table[word])
    put(257)
    if n:
        out.append(bits << (8 - n) & 255)
    return bytes(out)


def rewritten(path, grid, strip, compression, predictor):
    """A file of write_array with its one strip kept otherwise: the strip goes to the end, and its entries are changed."""
    import struct

    raw = bytearray(path.read_bytes())
    at = struct.unpack("<I", raw[4:8])[0]
    n = struct.unpack("<H", raw[at : at + 2])[0]
    entries = [bytes(raw[at + 2 + 12 * k : at + 14 + 12 * k]) for k in range(n)]
    new = {259: (3, compression), 273: (4, len(raw)), 279: (4, len(strip)), 317: (3, predictor)}
    entries = [e for e in entries if struct.unpack("<H", e[:2])[0] not in new]
    entries += [struct.pack("<HHI", tag, kind, 1) + struct.pack("<I", value) for tag, (kind, value) in new.items()]
    entries.sort(key=lambda e: struct.unpack("<H", e[:2])[0])
    start = len(raw) + len(strip) + len(strip) % 2
    raw[4:8] = struct.pack("<I", start)
    path.write_bytes(bytes(raw) + strip + b"\0" * (len(strip) % 2) + struct.pack("<H", len(entries)) + b"".join(entries) + b"\0\0\0\0")


@pytest.mark.parametrize("compression", ["lzw", "zstd", "none"])
@pytest.mark.parametrize("predictor", [1, 2, 3])
def test_other_compressions_and_predictors(tmp_path, compression, predictor):
    rng = np.random.default_rng(3)
    dtype = "float32" if predictor == 3 else "int16"
    a = np.cumsum(rng.normal(0, 3, (60, 50, 2)), axis=1).astype(dtype)
    path, grid = tmp_path / "a.tif", R.Grid(50, 60, (1.0, 0.0, 0.0, 0.0, -1.0, 60.0), "EPSG:32633")
    files.write_array(str(path), a, grid)
    if predictor == 1:
        raw = a.tobytes()
    elif predictor == 2:
        raw = np.diff(a, axis=1, prepend=np.zeros((60, 1, 2), dtype)).astype(dtype).tobytes()
    else:
        planes = a.astype(">f4").reshape(60, 100).view(np.uint8).reshape(60, 100, 4).transpose(0, 2, 1).reshape(60, 200, 2)
        raw = np.diff(planes, axis=1, prepend=np.zeros((60, 1, 2), np.uint8)).astype(np.uint8).tobytes()
    if compression == "zstd":
        raw = pytest.importorskip("zstandard").ZstdCompressor().compress(raw)
    rewritten(path, grid, packed_lzw(raw) if compression == "lzw" else raw, {"lzw": 5, "zstd": 50000, "none": 1}[compression], predictor)
    back, h = files.read_array(str(path))
    assert np.array_equal(back, a) and h.grid.crs == "EPSG:32633" and not h.geographic


def test_big_tiff(tmp_path):
    a = np.arange(600, dtype="float32").reshape(20, 10, 3)
    files.write_array(str(tmp_path / "b.tif"), a, R.Grid(10, 20, (1.0, 0.0, 5.0, 0.0, -1.0, 9.0), "EPSG:4326", (-1.0,)), big=True)
    back, h = files.read_array(str(tmp_path / "b.tif"))
    assert (tmp_path / "b.tif").read_bytes()[2] == 43 and np.array_equal(a, back) and h.geographic and h.grid.transform[2] == 5.0 and h.grid.nodata == (-1.0,) * 3


def test_cubic_weights():
    w = R.cubic(np.array([0.0, 0.25, 0.5]))
    assert np.allclose(w.sum(axis=1), 1) and np.allclose(w[0], [0, 1, 0, 0]) and np.allclose(w[2], [-0.0625, 0.5625, 0.5625, -0.0625])


def test_bicubic_keeps_planes_and_holes(spark):
    a = np.add.outer(np.arange(12) * 2.0, np.arange(14)) + 1
    rows = table(spark, a).filter("NOT (r = 5 AND c = 6)")
    fine = R.Grid(28, 24, (0.5, 0, 0, 0, -0.5, 12), "EPSG:3857")
    got = {(r["r"], r["c"]): r["bands"][0] for r in R.resampled(rows, R.Grid(14, 12, (1, 0, 0, 0, -1, 12), "EPSG:3857"), fine, shape=(5, 4)).collect()}
    assert len(got) == 28 * 24 - 4 and all((r // 2, c // 2) != (5, 6) for r, c in got)
    assert all(got[r, c] == pytest.approx((r + 0.5) - 1 + (c + 0.5) / 2 - 0.5 + 1) for r in range(16, 20) for c in range(18, 24))  # away from the hole


def test_edge_distance_is_that_to_the_nearest_cell_without_data(spark):
    rng = np.random.default_rng(4)
    some = rng.random((2, 13, 17)) < 0.85
    rows = [(k, int(r), int(c)) for k in range(2) for r, c in np.argwhere(some[k])]
    for k, r, c, d in R.edge_distance(spark.createDataFrame(rows, "strip int, r int, c int"), "strip").collect():
        empty = np.argwhere(~np.pad(some[k], 1)) - 1
        assert d == pytest.approx(np.sqrt(((empty - [r, c]) ** 2).sum(axis=1).min()))


class Thresholds:
    """A model that is no forest: classes by the first band."""

    classes_ = np.array([10, 20])

    def predict(self, rows):
        return np.where(rows[:, 0] > 2, 20, 10)


def test_any_model_with_predict_and_classes(spark, tmp_path):
    import pickle

    from pyspark import cloudpickle

    a = np.array([[1, 2], [3, 4]], "uint8")[..., None]
    grid = R.Grid(2, 2, (1.0, 0.0, 0.0, 0.0, -1.0, 2.0), "EPSG:32633")
    files.write_array(str(tmp_path / "i.tif"), a, grid)
    cloudpickle.register_pickle_by_value(__import__(Thresholds.__module__))
    (tmp_path / "m.pkl").write_bytes(cloudpickle.dumps(Thresholds()))
    out = classify.predict_rf(str(tmp_path / "i.tif"), str(tmp_path / "m.pkl"), str(tmp_path / "o.tif"), binary_out=str(tmp_path / "bin"), spark=spark)
    assert files.read_array(out)[0][..., 0].tolist() == [[10, 10], [20, 20]]
    assert files.read_array(str(tmp_path / "bin/class_20.tif"))[0][..., 0].tolist() == [[0, 0], [1, 1]]
    assert pickle.loads((tmp_path / "m.pkl").read_bytes()).classes_.tolist() == [10, 20] and classify.importances_of(Thresholds()) is None


def test_distance_refuses_degrees_and_rotation(spark, tmp_path):
    (tmp_path / "v.geojson").write_text(json.dumps(geo.box(1, 1, 2, 2).to_json()))
    for transform, crs in (((1.0, 0.0, 0.0, 0.0, -1.0, 9.0), "EPSG:4326"), ((1.0, 0.5, 0.0, 0.0, -1.0, 9.0), "EPSG:32633"), ((1.0, 0.0, 0.0, 0.0, -1.0, 9.0), None)):
        files.write_array(str(tmp_path / "t.tif"), np.zeros((4, 4, 1), "uint8"), R.Grid(4, 4, transform, crs))
        with pytest.raises(ValueError):
            classify.distance_to_vector(str(tmp_path / "v.geojson"), str(tmp_path / "t.tif"), str(tmp_path / "d.tif"), spark=spark)


def test_a_strip_s_centre_is_that_of_its_bounds():
    grid = R.Grid(2000, 2000, (300.0, 0.0, 200_000.0, 0.0, -300.0, 8_000_000.0), "EPSG:32633")
    lon, lat = C.transform("EPSG:32633", "EPSG:4326", *np.meshgrid(np.linspace(200_000, 800_000, 60), np.linspace(7_400_000, 8_000_000, 60)))
    centre = mosaic.projection("x.tif", grid).center_lonlat
    assert centre == pytest.approx(((lon.min() + lon.max()) / 2, (lat.min() + lat.max()) / 2), abs=0.01)


def test_training_writes_point_layers_and_empty_classes(spark, scene):
    tmp, _ = scene
    classify.train_rf(str(tmp / "img.tif"), str(tmp / "labels.geojson"), "cls", str(tmp / "m2"), n_estimators=3, max_depth=3, test_fraction=0, spark=spark)
    assert os.path.exists(tmp / "m2_train_points.gpkg") and not os.path.exists(tmp / "m2_val_points.gpkg")
    rows = A.class_band_stats(spark.createDataFrame([(1, [2.0, 4.0])], "label int, features array<double>"), [1, 2]).collect()
    found = {(r["label"], r["band"]): (r["n"], r["mean"]) for r in rows}
    assert found[1, 2] == (1, 4.0) and found[2, 1][0] == 0 and np.isnan(found[2, 1][1]) and len(found) == 4
    assert A.label_preview({k: f"n{k}" for k in range(11)}).endswith("9:n9 ...") and A.label_preview({1: "a"}) == "1:a"
