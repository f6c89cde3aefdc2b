"""Merges against a plain NumPy fold over patches."""

import itertools

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldweave.functions import windows as win
from fieldweave.operators import aggregations as agg
from fieldweave.operators import geometry as geo
from fieldweave.operators import samplers as smp
from fieldweave.plans.patcher import SpatialPatcher, grid_sampler, apply_to_chips, pack, stitch, unpack
from fieldweave.sources import fields as fld

H, W, P, S = 20, 23, 6, 4


def made(seed=0):
    rng = np.random.default_rng(seed)
    data = rng.normal(10, 2, (H, W))
    data[rng.random((H, W)) < 0.15] = np.nan
    return data


def field(spark, data):
    rows = [(i, j, float(v)) for (i, j), v in np.ndenumerate(data)]
    return fld.raster(spark.createDataFrame(rows, "r long, c long, value double"), *data.shape)


def dense(df, shape, name="value"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.r, r.c] = r[name]
    return out


def patches(data, p=P, s=S):
    """(anchor, values shifted by the anchor) of every patch in row-major order."""
    for a, b in itertools.product(range(0, max(H - p + 1, 1), s), range(0, max(W - p + 1, 1), s)):
        yield (a, b), data[a : a + p, b : b + p] + (a + 2 * b) % 5


def shift(x):
    return F.col("value") + (x["ar"] + 2 * x["ac"]) % 5


def stacks(data, weights):
    """Values and weights that cover each cell."""
    out = {(i, j): [] for i in range(H) for j in range(W)}
    for (a, b), v in patches(data):
        for (i, j), x in np.ndenumerate(v):
            out[a + i, b + j].append((x, weights[i, j]))
    return out


def cell(kind, xs):
    v = np.array([x for x, _ in xs if not np.isnan(x)])
    w = np.array([y for x, y in xs if not np.isnan(x)])
    if kind == "Sum":
        return v.sum()
    if kind == "Max":
        return v.max(initial=-np.inf)
    if kind == "Min":
        return v.min(initial=np.inf)
    if kind == "WeightedSum":
        return (v * w).sum()
    if kind == "Mean":
        return v.mean() if len(v) else 0
    if kind == "Variance":
        return v.var(ddof=1) if len(v) > 1 else 0
    if kind == "Median":
        return np.median(v) if len(v) else np.nan
    if kind == "OverlapAdd":
        return (v * w).sum() / w.sum() if w.sum() > 0 else 0
    raise ValueError(kind)


class Arrays(agg.Aggregation):
    """The same aggregation by its array form."""

    def __init__(self, of):
        self.of, self.outputs, self.local = of, of.outputs, of.local


WINDOWS = {"boxcar": win.Boxcar(), "hann": win.Hann(), "gaussian": win.Gaussian()}
KINDS = ["Sum", "Max", "Min", "WeightedSum", "Mean", "Variance", "Median", "OverlapAdd"]


@pytest.mark.parametrize("kind", KINDS)
def test_both_forms_equal_the_fold(spark, kind):
    data, aggregation = made(), getattr(agg, kind)()
    for name in ("boxcar", "hann") if kind in ("WeightedSum", "OverlapAdd") else ("boxcar",):
        window = WINDOWS[name]
        weights = np.outer(window.taper(P), window.taper(P))
        want = np.array([cell(kind, xs) for xs in stacks(data, weights).values()]).reshape(H, W)
        source = field(spark, data)
        plan = SpatialPatcher(geo.Rectangular(P), smp.RegularStride(S), window, aggregation)
        local = dense(plan.merge_cells(source, shift), (H, W))
        np.testing.assert_allclose(local, want, rtol=1e-10, atol=1e-12)
        dense_covers = dense(SpatialPatcher(geo.Rectangular(P), smp.RegularStride(S), window, Arrays(aggregation)).merge_cells(source, shift), (H, W))
        np.testing.assert_allclose(dense_covers, want, rtol=1e-10, atol=1e-12)
        cells = plan.split(source)
        grouped = dense(plan.merge(cells, source, F.col("value") + (F.col("ar") + 2 * F.col("ac")) % 5), (H, W))
        np.testing.assert_allclose(grouped, want, rtol=1e-10, atol=1e-12)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_partitions_do_not_matter(spark, parts):
    data = made(3)
    source = field(spark, data)
    moved = source.with_data(source.df.repartition(parts))
    plan = SpatialPatcher(geo.Rectangular(P), smp.RegularStride(S), win.Hann())
    for aggregation in (agg.OverlapAdd(), agg.Variance(), agg.Max()):
        one = dense(plan.merge(plan.split(moved), moved, aggregation=aggregation), (H, W))
        np.testing.assert_allclose(one, dense(plan.merge_cells(source, aggregation=aggregation), (H, W)), rtol=1e-10, atol=1e-12)


def test_many_covers(spark):
    """Over 64 covers of a cell go through arrays."""
    data = made(5)
    source = field(spark, data)
    plan = SpatialPatcher(geo.Rectangular(10), smp.RegularStride(1), win.Hann())
    assert plan.geometry.terms(source.domain, plan.sampler) is None
    np.testing.assert_allclose(dense(plan.merge_cells(source), (H, W)), dense(plan.merge(plan.split(source), source), (H, W)), rtol=1e-10, atol=1e-12)


def test_votes_and_fusion(spark):
    rng = np.random.default_rng(1)
    source = field(spark, rng.integers(0, 4, (H, W)).astype(float))
    plan = SpatialPatcher(geo.Rectangular(P), smp.RegularStride(S), win.Hann())
    k = lambda x: (F.col("value").cast("long") + F.floor(x["ar"] / S)) % 5
    column = (F.col("value").cast("long") + F.floor(F.col("ar") / S)) % 5
    probabilities = lambda c: F.array(*[(c == i).cast("double") * (i + 1) for i in range(5)])
    estimate = lambda v: F.struct(v.cast("double").alias("mu"), (v + 1.0).alias("var"))
    for aggregation, local, grouped in [
        (agg.HardVote(4), k, column), (agg.Mode(), k, column), (agg.SoftVote(5), lambda x: probabilities(k(x)), probabilities(column)),
        (agg.InvVarWeightedMean(), lambda x: estimate(k(x)), estimate(column)),
    ]:
        a, b = plan.merge_cells(source, local, aggregation), plan.merge(plan.split(source), source, grouped, aggregation=aggregation)
        for name in aggregation.outputs:
            np.testing.assert_allclose(dense(a, (H, W), name), dense(b, (H, W), name), rtol=1e-10)
    two = spark.createDataFrame([(0, 0, 3.0, 4.0, 1.0), (0, 0, 3.0, 1.0, 1.0)], "r long, c long, mu double, var double, w double")
    fused = agg.InvVarWeightedMean()
    row = fused.finish(two.groupBy("r").agg(*[c.alias(n) for n, c in fused.grouped(F.struct("mu", "var"), F.col("w")).items()])).first()
    assert abs(row.mu - 3) < 1e-12 and abs(row["var"] - 0.8) < 1e-12


def test_untouched_cells_and_bands(spark):
    source = field(spark, np.ones((7, 7)))
    for aggregation, empty in ((agg.Sum(), 0), (agg.Max(), -np.inf), (agg.Min(), np.inf), (agg.Median(), np.nan), (agg.OverlapAdd(), 0), (agg.Mode(), 0)):
        plan = SpatialPatcher(geo.Rectangular(4), smp.RegularStride(4), aggregation=aggregation)
        for out in (plan.merge(plan.split(source), source), plan.merge_cells(source)):
            got = dense(out, (7, 7))
            assert (got[:4, :4] == 1).all() and np.array_equal(got[4:], np.full((3, 7), float(empty)), equal_nan=True)
    rows = [(b, i, j, float(b)) for b in range(3) for i in range(4) for j in range(4)]
    banded = fld.raster(spark.createDataFrame(rows, "band int, r long, c long, value double"), 4, 4, bands=3)
    plan = SpatialPatcher(geo.Rectangular(2), smp.RegularStride(2), aggregation=agg.Sum())
    assert {(r.band, r.value) for r in plan.merge(plan.split(banded), banded).collect()} == {(0, 0.0), (1, 1.0), (2, 2.0)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(4, 7), st.integers(2, 3))
def test_disjoint_tiles_give_the_field_back(spark, p, n):
    data = np.arange((p * n) ** 2, dtype=float).reshape(p * n, p * n)
    source = field(spark, data)
    for aggregation in (agg.Sum(), agg.Mean(), agg.OverlapAdd()):
        plan = SpatialPatcher(geo.Rectangular(p), smp.RegularStride(p), aggregation=aggregation)
        np.testing.assert_allclose(dense(plan.merge(plan.split(source), source), data.shape), data)


def test_variance_of_large_numbers_is_accurate(spark):
    values = np.random.default_rng(7).normal(1e8, 1e-3, 100)
    df = spark.createDataFrame([(0, float(v)) for v in values], "k long, v double")
    got = df.groupBy("k").agg(*[c.alias(n) for n, c in agg.Variance().grouped(F.col("v"), F.lit(1.0)).items()]).first().value
    assert abs(got - values.var(ddof=1)) < abs(np.float32(values).var(ddof=1) - values.var(ddof=1)) + 1e-9


def test_statistics_of_all_patches(spark):
    data = np.arange(256, dtype=float).reshape(16, 16)
    source = field(spark, data)
    plan = SpatialPatcher(geo.Rectangular(4), smp.RegularStride(4), aggregation=agg.Mean())
    row = plan.reduce(source, agg.MeanStd()).first()
    assert abs(row["mean"] - data.mean()) < 1e-12 and abs(row["std"] - data.std(ddof=1)) < 1e-10
    z = dense(plan.two_pass(source, agg.MeanStd(), lambda v, s: (v - s("mean")) / s("std")), (16, 16))
    assert abs(z.mean()) < 1e-12 and abs(z.std(ddof=1) - 1) < 1e-12
    assert tuple(plan.reduce(source, agg.MinMax()).first()) == (0.0, 255.0)
    data[0, 0] = np.nan
    holed = field(spark, data)
    assert np.isnan(plan.reduce(holed, agg.MeanStd()).first()["mean"])
    assert tuple(plan.reduce(holed, agg.MinMax()).first()) == (4.0, 255.0)
    for reducer in (agg.MeanStd(), agg.MinMax()):
        with pytest.raises(Exception, match="no patches"):
            reducer.reduce(plan.split(source).limit(0)).collect()


def test_packed_form_and_chain(spark):
    source = field(spark, np.arange(144, dtype=float).reshape(12, 12))
    plan = SpatialPatcher(geo.Rectangular(4), smp.RegularStride(4), win.Hann(), agg.Sum())
    cells = plan.split(source)
    back = unpack(pack(cells, source.domain), source.domain)
    columns = ["seq", "r", "c", "o_r", "o_c", "value", "w"]
    assert sorted(map(tuple, cells.select(columns).collect())) == sorted(map(tuple, back.select(columns).collect()))
    doubled = grid_sampler(plan)(source).transform(apply_to_chips(lambda x: x * 2)).transform(stitch(plan, source))
    np.testing.assert_allclose(dense(doubled, (12, 12)), 2 * np.arange(144.0).reshape(12, 12))
    assert plan.get_config()["window"] == {"kind": "Hann"} and plan.get_config()["geometry"]["size"] == 4


def test_plans_shuffle_no_more_than_they_need(spark):
    source = field(spark, made())
    plan = SpatialPatcher(geo.Rectangular(P), smp.RegularStride(S), win.Hann())
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text(plan.merge_cells(source))
    grouped = text(plan.merge(plan.split(source), source, dense=False))
    assert grouped.count("Exchange") == 1 and "NestedLoop" not in grouped and "Cartesian" not in grouped


def test_sketches(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 2, 3, 4, 5, 100])], "seq long, value double")
    assert agg.ApproxQuantile(0.5).reduce(df).first().value == 3.0
    assert abs(agg.ApproxCardinality(8).reduce(df).first().estimate - 6) <= 1.2
    assert agg.ApproxMode(4).reduce(df).first().item == 2.0
    assert sum(r.n for r in agg.StreamingHistogram(3).reduce(df).collect()) == 7
    assert agg.Reservoir(4).reduce(df).count() == 4
    c = agg.ApproxCardinality(8)
    halves = [c.sketch(spark.range(a, a + 50).withColumnRenamed("id", "value")) for a in (0, 50)]
    assert abs(c.merge(halves[0].union(halves[1])).first().estimate - 100) <= 20
    assert c.reduce(df.limit(0)).first().estimate == 0
    with pytest.raises(ValueError, match="4..16"):
        agg.ApproxCardinality(3)
