"""Domains, fields, samplers, windows, geometries, boundaries, tiles."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.domains import GridDomain, PointDomain, RasterDomain, extent, from_geo_tags
from fieldweave.functions import windows as win
from fieldweave.operators import aggregations as agg
from fieldweave.operators import geometry as geo
from fieldweave.operators import samplers as smp
from fieldweave.plans.patcher import SpatialPatcher
from fieldweave.sources import fields as fld
from fieldweave.sources import tiles


def ones(spark, n):
    return fld.raster(spark.range(n * n).select(F.floor(F.col("id") / n).alias("r"), (F.col("id") % n).alias("c"), F.lit(1.0).alias("value")), n, n)


def test_domains():
    d = RasterDomain(100, 50, transform=(1, 0, 0, 0, -1, 100))
    assert extent(d) == (100, 50) and d.bounds == (0, 0, 50, 100) and d.shape == (100, 50)
    g = GridDomain({"lat": (-1.0, 0.0, 1.0), "lon": (5.0, 6.0)})
    assert extent(g) == {"lat": 3, "lon": 2} and g.bounds["lat"] == (-1, 1) and extent(PointDomain(7)) == 7


def test_windows_equal_their_formulas():
    np.testing.assert_allclose(win.Hann().taper(8), np.hanning(8))
    np.testing.assert_allclose(win.Tukey(0.5).taper(8), [0, 0.5, 1, 1, 1, 1, 1, 0.5], atol=1e-15)
    np.testing.assert_allclose(win.Tukey(1.0).taper(8), np.hanning(9)[:8], atol=1e-12)
    assert (win.Tukey(0).taper(5) == 1).all() and win.Hann().taper(1) == [1]
    g = win.Gaussian(0.5).taper(9)
    assert g.argmax() == 4 and np.allclose(g, g[::-1])


def test_weights_of_patches(spark):
    at = spark.range(20).select(F.floor(F.col("id") / 5).alias("i"), (F.col("id") % 5).alias("j"))
    own = win.Custom(lambda shape: np.arange(np.prod(shape)).reshape(shape))
    assert [r.w for r in at.select(own.weight([F.col("i"), F.col("j")], [4, 5]).alias("w")).collect()] == list(map(float, range(20)))
    with pytest.raises(ValueError, match="shape"):
        win.Custom(lambda shape: np.ones(3)).weight([F.col("i")], [4])
    w = [r.w for r in at.select(win.Hann().weight([F.col("i"), F.col("j")], [4, 5]).alias("w")).collect()]
    np.testing.assert_allclose(w, np.outer(np.hanning(4), np.hanning(5)).ravel(), atol=1e-15)


def test_fields(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, float("nan")), (1, 0, 3.0), (1, 1, 4.0)], "r long, c long, value double")
    f = fld.raster(df, 2, 2)
    assert f.df.where("value is null").count() == 1
    assert sorted(map(tuple, f.select((slice(0, 1), slice(0, 5))).collect()), key=str) == [(0, 0, 1.0), (0, 1, None)]
    wide = f.select((slice(-1, 1), slice(0, 2)), boundless=True)
    assert wide.count() == 4 and wide.where("value is not null").count() == 1
    p = fld.points(spark.createDataFrame([(i, float(i), 0.0) for i in range(5)], "pid long, x double, y double"), "pid")
    assert sorted(r.pid for r in p.select([1, 3, 3]).collect()) == [1, 3] and p.domain.count == 5
    assert p.with_data(p.df.withColumn("_value", F.lit(1)), ["_value"]).values == ("_value",)


@pytest.mark.parametrize(("h", "w", "p", "s"), [(2, 64, 5, 2), (10, 10, 3, 3), (5, 7, 12, 2), (20, 33, 4, 8)])
def test_count_of_anchors(spark, h, w, p, s):
    d, g = RasterDomain(h, w), geo.Rectangular(p)
    want = math.prod(max((n - p) // s + 1, 1) for n in (h, w))
    sampler = smp.RegularStride(s)
    rows = sampler.table(spark, d, g).orderBy("seq").collect()
    assert sampler.count(d, g) == want == len(rows)
    assert [(r.ar, r.ac) for r in rows] == sorted((r.ar, r.ac) for r in rows)


@pytest.mark.parametrize("sampler", [smp.JitteredStride(4, 0.5, 3), smp.RandomAnchors(30, 3), smp.PoissonDisk(3.0, seed=3)])
def test_seeded_samplers(sampler):
    d, g = RasterDomain(30, 40), geo.Rectangular(5)
    got = sampler.anchors(d, g)
    assert got == sampler.anchors(d, g) and all(0 <= a <= 25 and 0 <= b <= 35 for a, b in got)
    other = type(sampler)(**{**sampler.__dict__, "seed": 4}).anchors(d, g)
    assert other != got
    if isinstance(sampler, smp.PoissonDisk):
        assert all(math.dist(a, b) >= 3 - math.sqrt(2) for i, a in enumerate(got) for b in got[:i])
    none = type(sampler)(**{**sampler.__dict__, "seed": None})
    assert none.anchors(d, g) != none.anchors(d, g)


def test_samplers_of_points_and_grids():
    xy = tuple((float(i % 10), float(i // 10)) for i in range(100))
    kept = [xy[i] for (i,) in smp.PoissonDisk(2.5, seed=1, xy=xy).anchors(PointDomain(100), None)]
    assert all(math.dist(a, b) >= 2.5 for i, a in enumerate(kept) for b in kept[:i])
    assert all(any(math.dist(p, q) < 2.5 for q in kept) for p in xy)
    assert len(smp.RandomAnchors(8, 1).anchors(PointDomain(3), None)) == 8
    grid = GridDomain({"a": tuple(range(10)), "b": tuple(range(6)), "c": tuple(range(4))})
    g = geo.Rectangular({"a": 3, "b": 2, "c": 4})
    assert all(a <= 7 and b <= 4 and c <= 0 for a, b, c in smp.RandomAnchors(50, 1).anchors(grid, g) + smp.JitteredStride(2, 0.9, 2).anchors(grid, g))
    assert smp.Explicit(iter([(1, 2)])).anchors(None, None) == [(1, 2)]


@pytest.mark.parametrize(("boundary", "n", "corner"), [("drop", 16, 256), ("pad", 25, 256), ("shrink", 25, 36)])
def test_boundaries(spark, boundary, n, corner):
    source = ones(spark, 70)
    plan = SpatialPatcher(geo.Rectangular(16, boundary), smp.RegularStride(16))
    sizes = {r.seq: r["count"] for r in plan.split(source).groupBy("seq").count().collect()}
    assert len(sizes) == plan.n_anchors(source) == n and sizes[n - 1] == corner
    merged = plan.merge(plan.split(source), source)
    assert merged.count() == 4900 and merged.agg(F.sum("value")).first()[0] == (64 * 64 if boundary == "drop" else 4900)


def test_boundary_raise_and_unknown(spark):
    plan = SpatialPatcher(geo.Rectangular(16, "raise"), smp.RegularStride(16))
    with pytest.raises(Exception, match="reaches over the domain"):
        plan.split(ones(spark, 70)).count()
    assert plan.split(ones(spark, 64)).count() == 64 * 64
    with pytest.raises(ValueError, match="boundary"):
        geo.Rectangular(3, "wrap")


def test_shrink_crops_the_taper(spark):
    plan = SpatialPatcher(geo.Rectangular(4, "shrink"), smp.RegularStride(4), win.Hann())
    w = {(r.o_r, r.o_c): r.w for r in plan.split(ones(spark, 6)).where("seq = 3").collect()}
    assert set(w) == {(0, 0), (0, 1), (1, 0), (1, 1)} and abs(w[1, 1] - np.hanning(4)[1] ** 2) < 1e-12


def test_lattice_and_any_anchors_agree(spark):
    source = ones(spark, 21)
    g, lattice = geo.Rectangular(6), smp.RegularStride(4)
    a = SpatialPatcher(g, lattice, win.Hann()).split(source)
    b = SpatialPatcher(g, smp.Explicit([(r.ar, r.ac) for r in lattice.table(spark, source.domain, g).orderBy("seq").collect()]), win.Hann()).split(source)
    cols = ["seq", "r", "c", "o_r", "o_c", "w"]
    assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))
    one = SpatialPatcher(g, lattice, win.Hann()).patch_at(source, {"r": 4, "c": 8})
    assert one.count() == 36 and one.agg(F.min("r"), F.min("c")).first() == (4, 8)


def points(spark, xy):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "pid long, x double, y double")


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    xy = np.concatenate([rng.normal(0, 1, (120, 2)), np.repeat([[0.5, 0.5]], 8, 0)])
    own = points(spark, xy)
    anchors = own.where("pid % 9 = 0").select(F.col("pid").alias("seq"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    got = {(r.seq, r.pid) for r in geo.RadiusGraph(0.4).neighbours(anchors, own).collect()}
    assert got == {(i, j) for i in range(0, 128, 9) for j in range(128) if d[i, j] <= 0.4}
    for k in (1, 5, 200):
        got = {(r.seq, r.pid) for r in geo.KNNGraph(k).neighbours(anchors, own).collect()}
        assert got == {(i, int(j)) for i in range(0, 128, 9) for j in np.lexsort((np.arange(128), d[i]))[:k]}
    with pytest.raises(ValueError, match="metric"):
        geo.KNNGraph(2, "manhattan").neighbours(anchors, own)


def test_features_within_a_radius(spark):
    square = lambda x, y, n: [(x, y), (x + n, y), (x + n, y + n), (x, y + n)]
    features = ring(spark, square(0, 0, 2), square(5, 0, 1), square(0, 3.5, 1), square(20, 20, 50)).withColumnRenamed("seq", "fid")
    at = spark.createDataFrame([(0, 1.0, 1.0), (1, 3.5, 0.5), (2, -0.6, -0.8)], "seq long, ax double, ay double")
    got = {(r.seq, r.fid): round(r.distance, 6) for r in geo.RadiusGraph(1.5).features_near(at, features).collect()}
    assert got == {(0, 0): 0, (1, 0): 1.5, (1, 1): 1.5, (2, 0): 1.0}
    with pytest.raises(NotImplementedError):
        geo.RadiusGraph(1.0, "haversine").features_near(at, features)


def test_sphere(spark):
    own = points(spark, [(10, 5), (10.5, 5), (10, 45), (-179.9, 0), (179.9, 0)])
    at = lambda lon, lat: spark.createDataFrame([(0, float(lon), float(lat))], "seq long, ax double, ay double")
    assert {r.pid for r in geo.SphericalCap(200).neighbours(at(10, 5), own).collect()} == {0, 1}
    assert {r.pid for r in geo.SphericalCap(50).neighbours(at(180, 0), own).collect()} == {3, 4}  # over the date line
    assert {r.pid for r in geo.SphericalCap(21_000).neighbours(at(0, 0), own).collect()} == {0, 1, 2, 3, 4}
    assert [r.pid for r in geo.KNNGraph(2, "haversine").neighbours(at(-179, 0), own).orderBy("rank").collect()] == [3, 4]
    grid = GridDomain({"lat": tuple(np.linspace(-1, 1, 21)), "lon": tuple(np.linspace(-1, 1, 21))})
    anchor = spark.createDataFrame([(0, 0.0, 0.0)], "seq long, a_lat double, a_lon double")
    cells = geo.SphericalCap(120).on_grid(anchor, spark, grid).collect()
    r = np.radians
    def far(a, b):
        return 2 * 6371 * math.asin(math.sqrt(math.sin(r(a) / 2) ** 2 + math.cos(r(a)) * math.sin(r(b) / 2) ** 2))
    assert {(c.lat, c.lon) for c in cells} == {(i, j) for i, a in enumerate(grid.coords["lat"]) for j, b in enumerate(grid.coords["lon"]) if far(a, b) <= 120}


def ring(spark, *rings):
    return spark.createDataFrame([(i, [tuple(map(float, p)) for p in x]) for i, x in enumerate(rings)], "seq long, ring array<struct<x:double,y:double>>")


def test_polygons(spark):
    arrow = [(0, 0), (10, 0), (5, 4), (5, 12)]
    def holds(x, y):
        hit = False
        for (a, b), (c, d) in zip(arrow, arrow[1:] + arrow[:1], strict=True):
            if (b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a:
                hit = not hit
        return hit
    got = {(r.r, r.c) for r in geo.PolygonIntersection(5).mask(ring(spark, arrow), ones(spark, 15).df).collect()}
    assert got == {(i, j) for i in range(15) for j in range(15) if holds(j + 0.5, i + 0.5)} and got
    square = lambda x, y, n: [(x, y), (x + n, y), (x + n, y + n), (x, y + n)]
    features = ring(spark, square(1, 1, 1), square(20, 20, 1), square(-5, -5, 50), square(4.9, 10, 1), square(10, -3, 3)).withColumnRenamed("seq", "fid")
    met = geo.PolygonIntersection(4).features_in(ring(spark, arrow), features)
    assert {r.fid for r in met.collect()} == {0, 2, 3, 4}
    centre = features.select("fid", geo.centroid(F.col("ring")).alias("p")).where("fid = 0").first().p
    assert (round(centre.x, 9), round(centre.y, 9)) == (1.5, 1.5)


def test_tiles(spark, tmp_path):
    n = 50
    df = spark.range(n * n).select(F.floor(F.col("id") / n).alias("r"), (F.col("id") % n).alias("c"), F.col("id").cast("double").alias("value"))
    image = tiles.TiledRaster(RasterDomain(n, n), 16, 16)
    path = tiles.write_tiles(df, str(tmp_path / "tiles"), image)
    table = spark.read.parquet(path)
    assert table.count() == 16
    asked = spark.createDataFrame([(0, 10, 12, 9, 8), (1, -3, 46, 6, 9), (2, 90, 90, 8, 8)], "seq long, r0 long, c0 long, h long, w long")
    data = np.arange(n * n, dtype=float).reshape(n, n)
    got = {(r.seq, r.i, r.j): r.value for r in image.select_many(table, asked).collect()}
    for s, r0, c0, h, w in map(tuple, asked.collect()):
        for i in range(h):
            for j in range(w):
                a, b = r0 + i, c0 + j
                assert got[s, i, j] == (data[a, b] if 0 <= a < n and 0 <= b < n else 0)
    tiles.write_chunks(df, str(tmp_path / "chunks"), 20)
    back = spark.read.parquet(str(tmp_path / "chunks"))
    assert back.count() == n * n and back.select("chunk_r", "chunk_c").distinct().count() == 9 and dict(back.dtypes)["value"] == "float"
    two = df.withColumn("band", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("value", F.col("value") * (1 + F.col("band")))
    image = tiles.TiledRaster(RasterDomain(n, n, 2), 16, 16)
    path = tiles.write_tiles(two, str(tmp_path / "bands"), image)
    got = {(r.band, r.i, r.j): r.value for r in image.select_many(spark.read.parquet(path), asked.where("seq = 0")).collect()}
    assert got == {(b, i, j): (1 + b) * data[10 + i, 12 + j] for b in range(2) for i in range(9) for j in range(8)}
    few = image.tiles(two, windows=asked.where("seq = 0"))
    assert {(r.band, r.ty, r.tx) for r in few.collect()} == {(b, y, x) for b in range(2) for y in (0, 1) for x in (0, 1)}


def test_jitter_of_the_executors(spark):
    d, g = RasterDomain(300, 400), geo.Rectangular(5)
    plan = smp.JitteredStride(8, 0.5, 3)
    rows = plan.table(spark, d, g).orderBy("seq").collect()
    assert len(rows) == plan.count(d, g) and rows == plan.table(spark, d, g).repartition(7).orderBy("seq").collect()
    shifts = np.array([(r.ar - a, r.ac - b) for r, (a, b) in zip(rows, ((a, b) for a in range(0, 296, 8) for b in range(0, 396, 8)), strict=True)])
    assert abs(shifts).max() <= 4 and abs(shifts.mean()) < 0.2 and len(set(map(tuple, shifts.tolist()))) > 40
    assert all(0 <= r.ar <= 295 and 0 <= r.ac <= 395 for r in rows)
    assert rows != smp.JitteredStride(8, 0.5, 4).table(spark, d, g).orderBy("seq").collect()
    none = smp.JitteredStride(8)
    assert none.table(spark, d, g).orderBy("seq").collect() != none.table(spark, d, g).orderBy("seq").collect()
    assert [(r.ar, r.ac) for r in smp.JitteredStride(8, 0.5, 3, drawn=True).table(spark, d, g).orderBy("seq").collect()] == plan.anchors(d, g)


@pytest.mark.parametrize("metric", ["euclidean", "haversine"])
def test_nearest_of_uneven_points(spark, metric):
    """A dense town, scattered farms, places far off, ties and repeated places."""
    rng = np.random.default_rng(5)
    xy = np.concatenate([rng.normal(10, 1e-4, (400, 2)), rng.uniform(-60, 60, (60, 2)), np.tile([[30.0, 30.0]], (6, 1)), [[0.0, 0.0], [2.0, 0.0]]])
    at = np.array([(10.0, 10.0), (10.0001, 10.0), (170.0, -80.0), (1.0, 0.0), (30.0, 30.0), (-59.0, 59.0)])
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "pid long, x double, y double")
    anchors = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "seq long, ax double, ay double")

    def distance(a, b):
        if metric == "euclidean":
            return float(np.hypot(*(a - b)))
        (x1, y1), (x2, y2) = np.radians(a), np.radians(b)
        h = np.sin((y2 - y1) / 2) ** 2 + np.cos(y1) * np.cos(y2) * np.sin((x2 - x1) / 2) ** 2
        return 2 * geo.EARTH_KM * float(np.arcsin(min(1.0, np.sqrt(h))))

    for k in (1, 4, 1000):
        got = {}
        for r in geo.KNNGraph(k, metric).neighbours(anchors, points).orderBy("seq", "rank").collect():
            got.setdefault(r.seq, []).append(r.distance)
        for i, a in enumerate(at):
            assert np.allclose(got[i], sorted(distance(a, b) for b in xy)[:k], atol=1e-9)


def test_every_shape_has_patches(spark):
    cells = spark.range(400).select(F.floor(F.col("id") / 20).alias("r"), (F.col("id") % 20).alias("c"), F.col("id").cast("double").alias("value"))
    source = fld.raster(cells, 20, 20, transform=(1.0, 0.0, 0.0, 0.0, -1.0, 20.0))
    square = spark.createDataFrame([(0, [(2.0, 14.0), (6.0, 14.0), (6.0, 18.0), (2.0, 18.0)])], "seq long, ring array<struct<x:double,y:double>>")
    plan = SpatialPatcher(geo.PolygonIntersection(4))
    assert {(r.r, r.c) for r in plan.split(source, square).where("w = 1").collect()} == {(r, c) for r in range(2, 6) for c in range(2, 6)}
    triangle = spark.createDataFrame([(0, [(2.0, 14.0), (6.0, 14.0), (2.0, 18.0)])], "seq long, ring array<struct<x:double,y:double>>")
    window = plan.split(source, triangle)
    assert window.count() == 16 and 0 < window.where("w = 1").count() < 16
    xy = spark.range(100).select(F.col("id").alias("pid"), (F.col("id") % 10).cast("double").alias("x"), F.floor(F.col("id") / 10).cast("double").alias("y"), F.lit(1.0).alias("value"))
    points = fld.points(xy, "pid", ("value",))
    drawn = SpatialPatcher(geo.RadiusGraph(1.0), smp.RandomAnchors(8, 1), aggregation=agg.Sum())
    split = drawn.split(points)
    assert split.select("seq").distinct().count() == drawn.n_anchors(points) == 8
    assert {r.value for r in drawn.merge_anchors(split).collect()} <= {3.0, 4.0, 5.0}
    packed = drawn.packed(points).collect()
    assert all(len(r["at"]) == r["shape"][0] == len(r.data) == len(r.weights) for r in packed)
    grid = fld.grid(cells.withColumnsRenamed({"r": "lat", "c": "lon"}), {"lat": [float(i) for i in range(20)], "lon": [float(i) for i in range(20)]})
    near = SpatialPatcher(geo.SphericalCap(120.0)).split(grid, spark.createDataFrame([(0, 10.0, 10.0)], "seq long, a_lat double, a_lon double"))
    assert {(r.lat, r.lon) for r in near.collect()} == {(10, 10), (9, 10), (11, 10), (10, 9), (10, 11)} and "value" in near.columns
    square = lambda x, y: [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)]
    shapes = spark.createDataFrame([(i, [(float(a), float(b)) for a, b in square(i * 3, 0)], 1.0) for i in range(5)], "fid long, ring array<struct<x:double,y:double>>, value double")
    features = fld.features(shapes, "fid", ("value",))
    nearest = SpatialPatcher(geo.KNNGraph(2)).split(features, spark.createDataFrame([(0, 0.4, 0.5)], "seq long, ax double, ay double"))
    assert {r.fid for r in nearest.collect()} == {0, 1}
    with pytest.raises(NotImplementedError):
        SpatialPatcher(geo.KNNGraph(2)).split(source, square)


def test_sums_of_an_overlap_add_can_grow(spark, tmp_path):
    source = fld.raster(spark.range(400).select(F.floor(F.col("id") / 20).alias("r"), (F.col("id") % 20).alias("c"), F.col("id").cast("double").alias("value")), 20, 20)
    plan = SpatialPatcher(geo.Rectangular(4), smp.RegularStride(2), win.Gaussian())
    plan.stream_merge(source, str(tmp_path / "sums"), 5, weights=True, shard=10)
    sums = spark.read.parquet(str(tmp_path / "sums"))
    assert sums.select("shard_r", "shard_c").distinct().count() == 4
    want = {(r.r, r.c): r.value for r in plan.merge_cells(source).collect()}
    got = {(r.r, r.c): r.value / r.weight for r in sums.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-3 for k in got)
    with pytest.raises(ValueError, match="whole chunks"):
        plan.stream_merge(source, str(tmp_path / "odd"), 5, shard=12)


def test_spread_disks_are_maximal(spark):
    d, g = RasterDomain(60, 80), geo.Rectangular(1)
    plan = smp.PoissonDisk(7.0, 12, seed=3, spread=True)
    got = sorted((r.ar, r.ac) for r in plan.table(spark, d, g).collect())
    assert got == sorted((r.ar, r.ac) for r in plan.table(spark, d, g).collect())
    assert all(math.dist(a, b) >= 7 - math.sqrt(2) for i, a in enumerate(got) for b in got[:i])
    # nearly every cell has an anchor within the distance, as candidates lie nearly everywhere
    covered = np.mean([min(math.dist((r, c), a) for a in got) < 7 + 3 for r in range(60) for c in range(80)])
    assert covered == 1.0 and 60 * 80 / (math.pi * 49) < len(got) < 60 * 80 / (math.pi * 3.0**2)
    with pytest.raises(ValueError, match="counted"):
        plan.count(d, g)


def test_domain_from_tags():
    tags = {"width": 300, "height": 200, "samples": 3, "tile_width": 64, "tile_height": 64, "tiepoint": [0, 0, 0, 500.0, 900.0, 0], "pixel_scale": [10.0, 5.0, 0.0], "projected": 32630, "bits": 16, "sample_format": 1}
    domain, kind = from_geo_tags(tags)
    assert domain.shape == (3, 200, 300) and domain.bounds == (500.0, -100.0, 3500.0, 900.0) and (domain.crs, kind) == ("EPSG:32630", "uint16")
    bare = {k: v for k, v in tags.items() if k not in ("projected", "bits", "sample_format")}
    assert (from_geo_tags(bare)[0].crs, from_geo_tags(bare)[1]) == (None, "float32")
    assert from_geo_tags({**bare, "geographic": 4326})[0].crs == "EPSG:4326"
    for gap, text in (("tile_width", "strips"), ("tiepoint", "no place"), ("pixel_scale", "no place")):
        with pytest.raises(ValueError, match=text):
            from_geo_tags({**tags, gap: None})


def _rings(spark, n: int, corners: int = 4):
    """Squares of sides 1, 2 and 3; with five corners the first comes twice, so they aren't told to be boxes."""
    at = lambda i, x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)][:corners]
    return spark.createDataFrame([(i, at(i, i % 7 * 1.25, i // 7 * 1.5, 1.0 + i % 3)) for i in range(n)], "fid long, ring array<struct<x:double,y:double>>")


def test_boxes_give_what_rings_give_without_reading_them(spark):
    at = spark.createDataFrame([(i, i * 0.75, i * 0.5) for i in range(12)], "seq long, ax double, ay double")
    boxes, rings = _rings(spark, 40), _rings(spark, 40, 5)
    for radius in (0.0, 1.5):
        near = [geo.RadiusGraph(radius).features_near(at, f) for f in (boxes, rings)]
        assert "zip_with" not in near[0]._jdf.queryExecution().optimizedPlan().toString()
        got, want = ({(r[0], r[1]): round(r[2], 9) for r in df.collect()} for df in near)
        assert got == want and got
    mine = lambda df: df.limit(9).withColumnRenamed("fid", "seq")
    meet = [geo.PolygonIntersection().features_in(mine(a), b) for a in (boxes, rings) for b in (boxes, rings)]
    assert "zip_with" not in meet[0]._jdf.queryExecution().optimizedPlan().toString()
    got, *others = (sorted(map(tuple, df.collect())) for df in meet)
    assert got and all(x == got for x in others)


def test_a_crowded_bucket_is_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(geo, "BLOCK", 8)
    here = spark.range(100).selectExpr("id AS seq", "if(id < 90, 0, id) AS b")
    there = spark.range(200).selectExpr("id AS pid", "if(id < 150, 0, id - 100) AS b")
    met = geo._dealt(here, there, ["b"], ["seq"], ["pid"])
    assert met.columns == ["b", "seq", "pid"]
    assert sorted(map(tuple, met.collect())) == sorted(map(tuple, here.join(there, "b").collect()))
    blocks = {k: v for k, v in geo._blocked(here, there, ["b"], ["seq"], ["pid"])[0].groupBy("b", "_i", "_j").count().select(F.concat_ws(":", "b", "_i", "_j"), "count").collect()}
    assert max(blocks.values()) < 30 and len([k for k in blocks if k.startswith("0:")]) > 100


def test_darts_are_thrown_without_an_array_each(monkeypatch):
    made = []
    monkeypatch.setattr(smp.np, "array", lambda *a, f=np.array, **k: made.append(1) or f(*a, **k))
    got = np.asarray(smp.PoissonDisk(6.0, seed=7).anchors(RasterDomain(40, 50), geo.Rectangular(4)), float)
    assert len(made) < 5 < len(got)
    # whole cells are up to a diagonal nearer than the places
    apart = np.hypot(*(got[:, None] - got[None]).transpose(2, 0, 1))[np.triu_indices(len(got), 1)]
    assert apart.min() >= 6 - 2**0.5
