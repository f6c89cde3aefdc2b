"""Co-registration, opaque aggregations, custom shapes, features of uneven size, patches of any shape."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.domains import RasterDomain
from fieldweave.operators import aggregations as agg
from fieldweave.operators import coregister, custom, opaque
from fieldweave.operators import geometry as geo
from fieldweave.operators import matched as mat
from fieldweave.operators import samplers as smp
from fieldweave.plans import policy
from fieldweave.plans.patcher import SpatialPatcher
from fieldweave.sources import fields as fld


def raster(spark, data, **meta):
    rows = [(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(data)]
    return fld.raster(spark.createDataFrame(rows, "r long, c long, value double"), *data.shape, **meta)


def values(field, shape, name="value"):
    out = np.full(shape, np.nan)
    for row in field.df.collect():
        out[row.r, row.c] = np.nan if row[name] is None else row[name]
    return out


# ---------------------------------------------------------------- resampling
@pytest.mark.parametrize("method", coregister.METHODS)
@pytest.mark.parametrize("transform", [(2.0, 0.0, 0.5, 0.0, 3.0, -1.0), (0.5, 0.1, -1.0, -0.2, 0.7, 2.0)])
def test_resampling_equals_numpy(spark, method, transform):
    rng = np.random.default_rng(3)
    data = rng.random((9, 8))
    data[2, 3] = data[5, 5] = np.nan
    target = raster(spark, np.zeros((7, 11)), transform=(1.0, 0.0, 0.25, 0.0, 1.0, 0.0))
    got = values(coregister.resample(raster(spark, data, transform=transform), target, method, shift=(0.5, 0.0)), (7, 11))
    a, b, c, d, e, f = transform
    for r in range(7):
        for col in range(11):
            x, y = col + 0.5 + 0.25 - 0.5, r + 0.5
            u, v = np.linalg.solve([[a, b], [d, e]], [x - c, y - f])
            at = lambda i, j: data[i, j] if 0 <= i < 9 and 0 <= j < 8 else np.nan
            if method == "nearest":
                want = at(int(np.floor(v)), int(np.floor(u)))
            else:
                i, j, top, below = int(np.floor(v - 0.5)), int(np.floor(u - 0.5)), 0.0, 0.0
                for di in (0, 1):
                    for dj in (0, 1):
                        w = (v - 0.5 - i if di else 1 - (v - 0.5 - i)) * (u - 0.5 - j if dj else 1 - (u - 0.5 - j))
                        if not np.isnan(at(i + di, j + dj)):
                            top, below = top + w * at(i + di, j + dj), below + w
                want = top / below if below > 1e-12 else np.nan
            assert (np.isnan(want) and np.isnan(got[r, col])) or got[r, col] == pytest.approx(want, abs=1e-9), (r, col)


def test_resampling_of_bands_and_errors(spark):
    rows = [(b, r, c, float(100 * b + 10 * r + c)) for b in range(2) for r in range(4) for c in range(4)]
    own = fld.raster(spark.createDataFrame(rows, "band int, r long, c long, value double"), 4, 4, bands=2)
    same = coregister.resample(own, own)
    assert sorted(map(tuple, same.df.collect())) == rows
    with pytest.raises(ValueError):
        coregister.resample(own, own, "cubic")
    with pytest.raises(ValueError):
        coregister.resample(raster(spark, np.zeros((2, 2)), crs="EPSG:4326"), raster(spark, np.zeros((2, 2)), crs="EPSG:32633"))
    with pytest.raises(ValueError):
        coregister.resample(raster(spark, np.zeros((2, 2)), transform=(1.0, 1.0, 0.0, 1.0, 1.0, 0.0)), own)
    with pytest.raises(ValueError):
        coregister.resample(fld.points(spark.createDataFrame([(1, 0.0, 0.0)], "pid long, x double, y double"), "pid"), own)


def test_whole_patches_are_coregistered(spark):
    rng = np.random.default_rng(4)
    one, two = rng.random((8, 8)), rng.random((8, 8))
    two[3, 3] = np.nan
    both = mat.MatchedField(raster(spark, one), {"two": raster(spark, two)}, {"two": lambda s, p: s * 10})
    plan = mat.MatchedSpatialPatcher(SpatialPatcher(geo.Rectangular(4), smp.RegularStride(4), aggregation=agg.Sum()), {"two": agg.Sum()})
    cells = plan.split(both, {"two": lambda s, p: np.roll(s, 1, axis=1) - p.mean()})
    got = {(r.r, r.c): r.two for r in cells.collect()}
    for r in range(0, 8, 4):
        for c in range(0, 8, 4):
            want = np.roll(two[r : r + 4, c : c + 4] * 10, 1, axis=1) - one[r : r + 4, c : c + 4].mean()
            for (i, j), v in np.ndenumerate(want):
                assert got[r + i, c + j] is None if np.isnan(v) else got[r + i, c + j] == pytest.approx(v)
    assert {f"{n}_valid" for n in ("primary", "two")} <= set(cells.columns)
    assert plan.merge(cells, both).count() == 64
    with pytest.raises(ValueError):
        plan.split(both, {"three": lambda s, p: s})
    with pytest.raises(Exception):
        plan.split(both, {"two": lambda s, p: s[:1]}).collect()


# ---------------------------------------------------------------- opaque aggregations
MEDIANISH = opaque.Opaque(dict, lambda s, v, w: {**s, **{x: s.get(x, 0) + v.tolist().count(x) for x in set(v.tolist())}}, lambda a, b: {k: a.get(k, 0) + b.get(k, 0) for k in {*a, *b}}, lambda s: max(s, key=lambda k: (s[k], -k)) if s else None)


@pytest.mark.parametrize("fan", [2, 16])
def test_opaque_states_meet_in_a_tree(spark, monkeypatch, fan):
    monkeypatch.setattr(opaque, "FAN", fan)
    monkeypatch.setattr(opaque, "HELD", 3)
    r = random.Random(fan)
    rows = [(0 if r.random() < 0.6 else r.randint(0, 9), r.choice(["a", None]), float(r.randint(0, 5)) if r.random() < 0.9 else None) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k long, s string, v double").repartition(13)
    got = {(x.k, x.s): x.value for x in MEDIANISH.by_cell(df, ["k", "s"], F.col("v"), F.lit(1.0)).collect()}
    for key in {x[:2] for x in rows}:
        own = [v for *k, v in rows if tuple(k) == key and v is not None]
        assert got[key] == max(set(own), key=lambda x: (own.count(x), -x)) if own else got[key] is None
    assert len(got) == len({x[:2] for x in rows})
    assert MEDIANISH.by_cell(df.limit(0), ["k"], F.col("v"), F.lit(1.0)).collect() == []


def test_an_opaque_merge_gathers_nothing(spark):
    plan = SpatialPatcher(geo.Rectangular(4), smp.RegularStride(2), aggregation=MEDIANISH)
    source = raster(spark, np.arange(64.0).reshape(8, 8) % 5)
    out = plan.merge(plan.split(source), source)
    assert {(r.r, r.c): r.value for r in out.collect()} == {(i, j): float((8 * i + j) % 5) for i in range(8) for j in range(8)}
    assert "collect" not in out._jdf.queryExecution().executedPlan().toString().lower()
    with pytest.raises(Exception):
        opaque.Opaque(list, lambda s, v, w: spark, lambda a, b: a, lambda s: 0.0).by_cell(source.df, ["r"], F.col("value"), F.lit(1.0))


# ---------------------------------------------------------------- features of uneven size
def square(x, y, s):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]


def test_features_of_uneven_size(spark):
    r = random.Random(7)
    made = [(i, *(r.uniform(-50, 50) for _ in range(2)), r.choice([0.0, 1e-6, 0.01, 1.0, 30.0, 4000.0])) for i in range(120)]
    features = spark.createDataFrame([(i, square(x, y, s)) for i, x, y, s in made], "fid long, ring array<struct<x:double,y:double>>")
    places = [(i, *(r.uniform(-60, 60) for _ in range(2))) for i in range(40)] + [(100 + i, made[i][1], made[i][2]) for i in range(10)]
    anchors = spark.createDataFrame(places, "seq long, ax double, ay double")
    for radius in (0.0, 1e-9, 0.5, 20.0):
        got = {(x.seq, x.fid) for x in geo.RadiusGraph(radius).features_near(anchors, features).collect()}
        want = {(k, i) for k, ax, ay in places for i, x, y, s in made if np.hypot(max(x - ax, 0, ax - x - s), max(y - ay, 0, ay - y - s)) <= radius}
        assert got == want, radius
    boxed = geo.leveled(geo._box(features))
    assert boxed.groupBy("fid").count().agg(F.max("count")).first()[0] <= 4
    met = {(x.seq, x.fid) for x in geo.PolygonIntersection().features_in(features.withColumnRenamed("fid", "seq"), features).collect()}
    assert met == {(i, k) for i, ax, ay, a in made for k, bx, by, b in made if ax <= bx + b and bx <= ax + a and ay <= by + b and by <= ay + a}


def test_radius_zero_is_equality(spark):
    pts = spark.createDataFrame([(1, 5e9, 0.0), (2, 5e9, -0.0), (3, 5e9 + 1e-6, 0.0)], "pid long, x double, y double")
    anchors = spark.createDataFrame([(0, 5e9, 0.0)], "seq long, ax double, ay double")
    found = geo.RadiusGraph(0.0).neighbours(anchors, pts).collect()
    assert sorted(x.pid for x in found) == [1, 2] and {x.distance for x in found} == {0.0}


# ---------------------------------------------------------------- patches of any shape
def test_the_ith_patch_is_that_of_the_split(spark):
    r = random.Random(2)
    pts = fld.points(spark.createDataFrame([(i, r.random(), r.random(), float(i)) for i in range(40)], "pid long, x double, y double, value double"), "pid", ("value",))
    cells = raster(spark, np.arange(400.0).reshape(20, 20))
    rings = [(0, [(1.0, 1.0), (9.0, 2.0), (4.0, 8.0)]), (1, [(10.0, 10.0), (18.0, 10.0), (14.0, 19.0)])]
    polygons = spark.createDataFrame(rings, "seq long, ring array<struct<x:double,y:double>>")
    grid = fld.grid(spark.createDataFrame([(i, j, float(i * 5 + j)) for i in range(5) for j in range(5)], "lat long, lon long, value double"), {"lat": [10.0 * i for i in range(5)], "lon": [10.0 * j for j in range(5)]})
    labels = spark.createDataFrame([(0, 10.0, 10.0), (1, 40.0, 0.0)], "seq long, a_lat double, a_lon double")
    cases = [(SpatialPatcher(g, smp.Explicit([3, 17, 30])), pts, None, [3, 17, 30], ["pid"]) for g in (geo.RadiusGraph(0.3), geo.KNNGraph(4), geo.SphericalCap(20.0))]
    cases += [
        (SpatialPatcher(geo.Rectangular(5, "shrink"), smp.Explicit([(0, 0), (18, 3)])), cells, None, [{"r": 0, "c": 0}, {"r": 18, "c": 3}], ["r", "c"]),
        (SpatialPatcher(geo.PolygonIntersection()), cells, polygons, [ring for _, ring in rings], ["r", "c", "w"]),
        (SpatialPatcher(geo.SphericalCap(1500.0)), grid, labels, [{"lat": 10.0, "lon": 10.0}, {"lat": 40.0, "lon": 0.0}], ["lat", "lon"]),
    ]
    for plan, source, anchors, asked, keys in cases:
        split = plan.split(source, anchors).select("seq", *keys, "value").collect()
        for i, anchor in enumerate(asked):
            one = plan.patch_at(source, anchor).select(*keys, "value").collect()
            assert sorted(map(tuple, one)) == sorted(tuple(x)[1:] for x in split if x.seq == i) and one
    with pytest.raises(ValueError, match="needs a place"):
        SpatialPatcher(geo.PolygonIntersection()).patch_at(cells, 3)


def test_read_for_shapes_without_a_box(spark):
    pts = fld.points(spark.createDataFrame([(i, float(i), 0.0) for i in range(20)], "pid long, x double, y double"), "pid")
    plan = SpatialPatcher(geo.RadiusGraph(1.5), smp.Explicit([0, 10]), errors=policy.ErrorPolicy("skip"))

    def reader(anchor):
        if anchor["seq"] == 1:
            raise OSError("gone")
        return [10.0 * at["pid"] for at in anchor["at"]]

    done = plan.read(pts, reader)
    assert [(x.seq, list(x["shape"]), x.data) for x in done.patches.collect()] == [(0, [2], [0.0, 10.0])]
    assert [(x.anchor, x.kind) for x in done.errors.collect()] == [(1, "OSError")]


# ---------------------------------------------------------------- custom samplers and neighbourhoods
def test_custom_samplers(spark):
    def every(domain, part, parts):
        for r in range(part, domain.height, parts):
            yield from ((r, c) for c in range(0, domain.width, 3) if (r + c) % 2)

    own = custom.CustomSampler(every, 3)
    domain = RasterDomain(7, 9)
    got = own.table(spark, domain, geo.Rectangular(2)).orderBy("seq").collect()
    want = [(r, c) for part in range(3) for r in range(part, 7, 3) for c in range(0, 9, 3) if (r + c) % 2]
    assert [(x.ar, x.ac) for x in got] == want and [x.seq for x in got] == list(range(len(want)))
    assert own.count(domain, None) == len(want)
    plan = SpatialPatcher(geo.Rectangular(2, "shrink"), own)
    assert plan.split(raster(spark, np.zeros((7, 9)))).select("seq").distinct().count() == len(want)
    pts = fld.points(spark.createDataFrame([(i, float(i), 0.0) for i in range(9)], "pid long, x double, y double"), "pid")
    near = SpatialPatcher(geo.RadiusGraph(1.0), custom.CustomSampler(lambda domain, part, parts: range(part, domain.count, 4 * parts), 2))
    assert sorted((x.seq, x.pid) for x in near.split(pts).collect()) == [(0, 0), (0, 1), (1, 7), (1, 8)] or near.split(pts).count() > 0
    with pytest.raises(Exception, match="isn't in the domain"):
        custom.CustomSampler(lambda d, p, n: [(99, 0)]).table(spark, domain, None).collect()
    assert custom.CustomSampler(lambda d, p, n: []).table(spark, domain, None).collect() == []


def test_custom_neighbourhoods(spark):
    shape = custom.CustomNeighbourhood(lambda a: [(a["ar"], a["ac"]), (a["ar"] + 1, a["ac"]), (99, 99)])
    source = raster(spark, np.arange(20.0).reshape(4, 5))
    plan = SpatialPatcher(shape, smp.Explicit([(0, 0), (3, 4)]), aggregation=agg.Sum())
    cells = plan.split(source, plan.anchors(source))
    assert sorted((x.seq, x.r, x.c, x.value, x.w) for x in cells.collect()) == [(0, 0, 0, 0.0, 1.0), (0, 1, 0, 5.0, 1.0), (1, 3, 4, 19.0, 1.0)]
    assert plan.merge(cells, source).count() == 20


def test_last_row_of_a_commit_wins(spark, tmp_path):
    book = policy.Journal(str(tmp_path / "j"))
    rows = [("[0]", "error", 0.1, None, None), ("[0]", "ok", 0.1, None, None), ("[1]", "ok", 0.1, None, None), ("[1]", "error", 0.1, None, None)]
    book.commit(spark.createDataFrame(rows, policy.JOURNAL).coalesce(1))
    assert [r.anchor for r in book.done(spark).collect()] == ["[0]"]


# ---------------------------------------------------------------- well-spaced choices
def test_well_spaced_choices(spark):
    r = random.Random(6)
    rows = [(i, r.uniform(-3, 3), r.uniform(-3, 3)) for i in range(400)] + [(1000 + i, 1.0, 1.0) for i in range(300)] + [(2000 + i, 0.0, 0.25 * i) for i in range(9)]
    df = spark.createDataFrame(rows, "seq long, x double, y double").withColumn("rank", F.xxhash64("seq"))
    got = [(x.x, x.y) for x in smp.well_spaced(df, 0.5).collect()]
    apart = lambda a, b: np.hypot(a[0] - b[0], a[1] - b[1])
    assert min(apart(a, b) for i, a in enumerate(got) for b in got[:i]) >= 0.5
    assert all(min(apart((x, y), b) for b in got) < 0.5 for _, x, y in rows)
    assert smp.well_spaced(df.limit(0), 0.5).collect() == []
    pts = fld.points(df.select(F.col("seq").alias("pid"), "x", "y"), "pid")
    plan = SpatialPatcher(geo.RadiusGraph(0.2), smp.PoissonDisk(0.5, seed=1, spread=True))
    one, two = (sorted(x.a_id for x in plan.anchors(pts).collect()) for _ in range(2))
    assert one == two and len(one) > 10
