"""Temporal and matched operators, policies, runtime, streaming."""

import json
import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.domains import RasterDomain
from fieldweave.functions import windows as win
from fieldweave.operators import aggregations as agg
from fieldweave.operators import geometry as geo
from fieldweave.operators import matched as mat
from fieldweave.operators import samplers as smp
from fieldweave.operators import spacetime as sti
from fieldweave.operators import temporal as tmp
from fieldweave.plans import policy
from fieldweave.plans.patcher import SpatialPatcher, parallel_map, unpack
from fieldweave.sources import fields as fld
from fieldweave.streaming import live


def series(spark, n=100, known=True):
    return fld.series(spark.range(n).select(F.col("id").alias("t"), F.col("id").cast("double").alias("value")), length=n if known else None)


def raster(spark, n, value=None):
    cell = F.col("id").cast("double") if value is None else value
    return fld.raster(spark.range(n * n).select(F.floor(F.col("id") / n).alias("r"), (F.col("id") % n).alias("c"), cell.alias("value")), n, n)


# ---------------------------------------------------------------- time
@pytest.mark.parametrize("known", [True, False])
@pytest.mark.parametrize("geometry", [tmp.FixedLookback(5), tmp.LookbackHorizon(3, 2), tmp.MultiScale((5, 20, 50)), tmp.PhaseWindow(7, 3)])
def test_temporal_patches(spark, geometry, known):
    source = series(spark, 100, known)
    for sampler in (smp.TemporalStride(10), smp.TemporalStride(7, 4), smp.TemporalExplicit((99, 0, 3, 200))):
        rows = tmp.TemporalPatcher(geometry, sampler).packed(source).collect()
        want = sorted((t, s, list(map(float, range(max(0, t - a), min(100, t + b + 1))))) for t in sampler.times(100) for s, (a, b) in enumerate(geometry.reaches()))
        assert sorted((r.t_anchor, r.scale, r.data) for r in rows) == want
        assert all((r.start, r.stop) == (r.data[0], r.data[-1] + 1) for r in rows)


def test_temporal_weights_and_events(spark):
    source = series(spark, 20)
    decay = tmp.TemporalPatcher(tmp.FixedLookback(4), smp.TemporalExplicit((1, 10)), win.ExponentialDecay(2.0)).packed(source).orderBy("seq").collect()
    np.testing.assert_allclose(decay[1].weights, np.exp(-(3 - np.arange(4)) / 2))
    assert len(decay[0].weights) == 2 and decay[0].weights[-1] == 1
    tukey = tmp.TemporalPatcher(tmp.FixedLookback(8), smp.TemporalExplicit((10, 4)), win.TaperedTukey(0.5)).packed(source).orderBy("seq").collect()
    for r in tukey:
        np.testing.assert_allclose(r.weights, win.Tukey(0.5).taper(len(r.data)), atol=1e-12)
    events = tmp.TemporalPatcher(tmp.FixedLookback(2), smp.EventTriggered((5, -1, 19, 40)))
    assert [r.t_anchor for r in events.packed(source).orderBy("seq").collect()] == [5, 19]
    assert smp.TemporalRandom(9, 1).times(20) == smp.TemporalRandom(9, 1).times(20)
    assert [r.data for r in events.patches_at(source, 7).collect()] == [[6.0, 7.0]]


def test_temporal_aggregations(spark):
    source = series(spark, 20)
    packed = tmp.TemporalPatcher(tmp.LookbackHorizon(3, 2), smp.TemporalStride(5)).packed(source)
    ahead = {r.t_anchor: r.data for r in tmp.forecast(packed, [], 2).collect()}
    assert ahead == {0: [1.0, 2.0], 5: [6.0, 7.0], 10: [11.0, 12.0], 15: [16.0, 17.0]}
    for n, h in ((1, 1), (2, 5), (3, 4), (3, 9)):
        one = spark.createDataFrame([(0, 0, 0, list(map(float, range(n))))], "seq long, scale int, t_anchor long, data array<double>")
        assert tmp.forecast(one, [], h).first().data == list(map(float, range(n)))[n - h :]
    pair = tmp.TemporalPatcher(tmp.MultiScale((2, 4)), smp.TemporalExplicit((5,))).packed(source)
    assert {r.key: r.data for r in tmp.hierarchical(pair, []).collect()} == {"[4,6)": [4, 5], "[2,6)": [2, 3, 4, 5]}
    even = tmp.TemporalPatcher(tmp.FixedLookback(3), smp.TemporalStride(5, 2)).packed(source)
    assert [r.value for r in tmp.mean(even, []).orderBy("pos").collect()] == [7.5, 8.5, 9.5]
    with pytest.raises(Exception, match="differ in length"):
        tmp.mean(tmp.TemporalPatcher(tmp.FixedLookback(3), smp.TemporalStride(5)).packed(source), []).collect()
    folded = tmp.fold(even.withColumn("k", F.lit(1)), ["k"], F.lit(0.0), lambda a, d: a * 2 + F.element_at(d, -1)).first().state
    opaque = tmp.fold_opaque(even.withColumn("k", F.lit(1)), ["k"], lambda a, d: a * 2 + d[-1], 0.0, "k int, state double").first().state
    acc = 0.0
    for t in range(2, 20, 5):
        acc = acc * 2 + t
    assert folded == opaque == acc


def cube(spark):
    df = spark.range(8 * 256).select(F.floor(F.col("id") / 256).alias("t"), F.floor(F.col("id") % 256 / 16).cast("long").alias("r"), (F.col("id") % 16).alias("c"), F.col("id").cast("double").alias("value"))
    return fld.Field(df, RasterDomain(16, 16), ("t", "r", "c"))


def test_spacetime(spark):
    spatial, temporal = SpatialPatcher(geo.Rectangular(8), smp.RegularStride(8)), tmp.TemporalPatcher(tmp.FixedLookback(4), smp.TemporalStride(4))
    plan, source = sti.SpatioTemporalPatcher(spatial, temporal), cube(spark)
    cells = plan.split(source, 8)
    assert plan.n_anchors(source, 8) == cells.select("seq", "t_seq").distinct().count() == 8
    assert cells.count() == 4 * 64 * (1 + 4)
    pairs = sti.SpatioTemporalPatcher(spatial, temporal, "coupled", (((0, 0), 0), ((0, 8), 4)))
    got = {(r.ar, r.ac, r.t_anchor): r["count"] for r in pairs.split(source, 8).groupBy("ar", "ac", "t_anchor").count().collect()}
    assert got == {(0, 0, 0): 64, (0, 8, 4): 256}
    merged = plan.merge_mean(cells, source)
    assert merged.where("ar = 8 and ac = 0 and o_r = 1 and o_c = 2 and o_t = 0").first().value == np.mean([9 * 16 + 2, 256 + 9 * 16 + 2])
    weighted = sti.SpatioTemporalPatcher(spatial, tmp.TemporalPatcher(tmp.FixedLookback(4), smp.TemporalStride(4), win.ExponentialDecay(1.0)), time_weights=True).split(source, 8)
    assert abs(weighted.where("t_anchor = 4 and t = 1").first().w - math.exp(-3)) < 1e-12
    with pytest.raises(ValueError, match="coupling"):
        sti.SpatioTemporalPatcher(spatial, temporal, "zip")


# ---------------------------------------------------------------- matched
def test_matched(spark):
    holes = F.when((F.col("id") % 8 < 2) & (F.col("id") < 16), F.lit(float("nan"))).otherwise(F.lit(1.0))
    primary, other = raster(spark, 8, holes), raster(spark, 8, F.when((F.col("id") % 8 >= 6) & (F.col("id") >= 48), F.lit(None)).otherwise(F.lit(2.0)))
    both = mat.MatchedField(primary, {"b": other}, {"b": lambda b, p: b + F.coalesce(p, F.lit(0.0))})
    plan = mat.MatchedSpatialPatcher(SpatialPatcher(geo.Rectangular(4), smp.RegularStride(4), aggregation=agg.Mean()), {"b": agg.Sum()})
    cells = plan.split(both)
    counts = {r.seq: (r.p, r.b) for r in cells.groupBy("seq").agg(F.count_if("primary_valid").alias("p"), F.count_if("b_valid").alias("b")).collect()}
    assert counts == {0: (12, 16), 1: (16, 16), 2: (16, 16), 3: (16, 12)}
    merged = {(r.r, r.c): (r.primary, r.b) for r in plan.merge(cells, both).collect()}
    assert merged[0, 0] == (0, 2) and merged[5, 5] == (1, 3) and merged[7, 7] == (1, 0)
    with pytest.raises(ValueError, match="no such source"):
        mat.MatchedSpatialPatcher(plan.spatial, {"typo": agg.Sum()}).split(both)
    with pytest.raises(ValueError, match="taken"):
        mat.MatchedField(primary, {"primary": other}, {"primary": lambda b, p: b})
    with pytest.raises(ValueError, match="differ"):
        mat.MatchedField(primary, {"b": other}, {})


def test_matched_time(spark):
    own = series(spark)
    twice = own.with_data(own.df.withColumn("value", F.col("value") * 2))
    both = mat.MatchedField(own, {"twice": twice}, {"twice": lambda x, p: x})
    cells = mat.MatchedTemporalPatcher(tmp.TemporalPatcher(tmp.FixedLookback(5), smp.TemporalStride(10))).split(both)
    assert cells.where("twice <> 2 * primary").count() == 0 and cells.select("seq").distinct().count() == 10 and cells.where("not twice_valid").count() == 0


# ---------------------------------------------------------------- policies and runtime
class Odd(ValueError):
    pass


def flaky(values):
    if values[0, 0] in (4.0, 8.0):
        raise Odd("no good")
    return values + 1


def test_error_policies(spark):
    source = raster(spark, 16)
    plan = SpatialPatcher(geo.Rectangular(4), smp.RegularStride(4), aggregation=agg.Sum())
    n = lambda on_error, **more: SpatialPatcher(plan.geometry, plan.sampler, errors=policy.ErrorPolicy(on_error, **more)).map(source, flaky)
    with pytest.raises(Exception, match="no good"):
        n("raise").patches.count()
    for how, retries in (("skip", 0), ("retry", 2)):
        out = n(how, max_retries=2, retry_on=("ValueError",), capture_traceback=True)
        errors = out.errors.collect()
        assert out.patches.count() == 14 and {e.anchor for e in errors} == {1, 2}
        assert sorted((e.anchor, e.kind, e.message, e.retry_count) for e in errors) == [(a, "Odd", "no good", k) for a in (1, 2) for k in range(retries + 1)] and "flaky" in errors[0].traceback
    masked = n("mask").patches.where("seq in (1, 2)").collect()
    assert len(masked) == 2 and all(v is None for r in masked for v in r.data)
    with pytest.raises(Exception, match="no good"):
        n("retry", retry_on=("KeyError",)).patches.count()
    with pytest.raises(ValueError, match="on_error"):
        policy.ErrorPolicy("ignore")
    with pytest.raises(ValueError, match="negative"):
        policy.ErrorPolicy("retry", max_retries=-1)


def test_a_random_operator_agrees_with_its_errors(spark):
    def chance(values):
        import random

        if random.random() < 0.5:
            raise Odd("unlucky")
        return values

    plan = SpatialPatcher(geo.Rectangular(2), smp.RegularStride(2), errors=policy.ErrorPolicy("skip"))
    out = plan.map(raster(spark, 16), chance)
    good, bad = {r.seq for r in out.patches.collect()}, {r.anchor for r in out.errors.collect()}
    assert good | bad == set(range(64)) and not good & bad and good and bad


def test_reads_follow_the_policy(spark):
    source = raster(spark, 8)

    def read(anchor):
        if anchor["ar"] == 4 and anchor["ac"] == 0:
            raise OSError("gone")
        n, m = anchor["shape"]
        return [[(anchor["ar"] + i) * 8 + anchor["ac"] + j for j in range(m)] for i in range(n)]

    plan = lambda how: SpatialPatcher(geo.Rectangular(4), smp.RegularStride(4), aggregation=agg.Sum(), errors=policy.ErrorPolicy(how))
    with pytest.raises(Exception, match="gone"):
        plan("raise").read(source, read).patches.count()
    skipped = plan("skip").read(source, read)
    assert {r.seq for r in skipped.patches.collect()} == {0, 1, 3} and [(r.anchor, r.kind) for r in skipped.errors.collect()] == [(2, "OSError")]
    masked = plan("mask").read(source, read)
    merged = plan("mask").merge(unpack(masked.patches, source.domain), source)
    assert {(r.r, r.c): r.value for r in merged.collect()} == {(r, c): 0.0 if r >= 4 and c < 4 else float(r * 8 + c) for r in range(8) for c in range(8)}


def test_folds_in_chunks_and_order(spark):
    packed = spark.createDataFrame([(k, s, 0, [float(s)]) for k in (1, 2) for s in range(50)], "k int, seq long, scale int, data array<double>").repartition(5)
    add = lambda a, d: a + F.element_at(d, 1)
    whole = tmp.fold(packed, ["k"], F.lit(0.0), add).collect()
    parts = tmp.fold(packed, ["k"], F.lit(0.0), add, lambda a, b: a + b, 7).collect()
    assert sorted(whole) == sorted(parts) == [(1, 1225.0), (2, 1225.0)]
    last = tmp.fold_opaque(packed, ["k"], lambda a, d: a * 0.5 + d[0], 0.0, "k int, state double").collect()
    acc = 0.0
    for s in range(50):
        acc = acc * 0.5 + s
    assert sorted(last) == [(1, acc), (2, acc)]


def test_first_seen_numbers(spark):
    df = spark.createDataFrame([(i, (i * 7) % 30) for i in range(100)], "seq long, k long").repartition(6)
    met = list(dict.fromkeys((i * 7) % 30 for i in range(100)))
    assert [r.k for r in policy.first_seen(df, ["k"]).orderBy("place").collect()] == met
    assert [r.place for r in policy.first_seen(df, ["k"]).orderBy("place").collect()] == list(range(30))


def test_hierarchical_keys(spark):
    source = series(spark, 20)
    cut = tmp.TemporalPatcher(tmp.MultiScale((2, 6)), smp.TemporalExplicit((0, 1, 9))).packed(source)
    got = {(r.t_anchor, r.key): r.data for r in tmp.Hierarchical((2, 6)).merge(cut, []).collect()}
    # at 0 both patches are [0, 1); at 1 the longer one is cut to the length of the shorter
    assert got == {(0, "[0,1)"): [0.0], (1, "2"): [0.0, 1.0], (9, "2"): [8.0, 9.0], (9, "6"): [4.0, 5.0, 6.0, 7.0, 8.0, 9.0]}


def test_parallel_map_and_budget(spark):
    source = raster(spark, 32)
    plan = SpatialPatcher(geo.Rectangular(8), smp.RegularStride(8))
    rows = parallel_map(plan, source, lambda v: v * 2).collect()
    assert [r.seq for r in rows] == list(range(16)) and rows[5].data[0] == 2 * (8 * 32 + 8)
    with pytest.raises(Exception, match="budget"):
        parallel_map(SpatialPatcher(plan.geometry, plan.sampler, max_patch_bytes=100), source, lambda v: v).count()
    import threading

    lock = threading.Lock()
    with pytest.raises(ValueError, match="executors"):
        parallel_map(plan, source, lambda v: lock)
    with pytest.raises(NotImplementedError):
        parallel_map(SpatialPatcher(plan.geometry, plan.sampler, journal=policy.Journal("x")), source, lambda v: v)


def test_journal(spark, tmp_path):
    path = str(tmp_path / "journal")
    book, source = policy.Journal(path), raster(spark, 4)
    plan = SpatialPatcher(geo.Rectangular(2), smp.RegularStride(2), journal=book)
    assert plan.anchors(source).count() == 4
    row = lambda anchor, status: spark.createDataFrame([(anchor, status, 0.1, None, None)], policy.JOURNAL)
    book.commit(row("[0,0]", "ok"))
    book.commit(row("[0,2]", "error"))
    assert sorted((r.ar, r.ac) for r in plan.anchors(source).collect()) == [(0, 2), (2, 0), (2, 2)]
    book.commit(row("[0,0]", "error"))
    book.commit(row("[2,2]", "ok"))
    with open(f"{path}/bad.json", "w") as f:
        f.write("{not json\n" + json.dumps({"anchor": "[2,0]", "status": "ok", "written": 1}) + "\n")
    with pytest.warns(RuntimeWarning, match="malformed"):
        assert sorted((r.ar, r.ac) for r in plan.anchors(source).collect()) == [(0, 0), (0, 2)]
    assert plan.split(source).select("seq").distinct().count() == 2


def test_stacks_and_batches(spark):
    packed = SpatialPatcher(geo.Rectangular(8), smp.RegularStride(8)).packed(raster(spark, 16))
    stack = policy.stack_patches(packed).first()
    assert stack.n == 4 and list(stack["shape"]) == [8, 8] and [d[0] for d in stack.stacked] == [0, 8, 128, 136]
    batches = policy.batch_split(packed, 3)
    assert [(r.batch, r.slot, r.valid) for r in batches.orderBy("batch", "slot").collect()] == [(0, 0, True), (0, 1, True), (0, 2, True), (1, 0, True), (1, 1, False), (1, 2, False)]
    assert set(batches.where("not valid").first().data) == {0.0} and policy.unbatch(batches).count() == 4
    ragged = SpatialPatcher(geo.Rectangular(10, "shrink"), smp.RegularStride(8)).packed(raster(spark, 16))
    for frame, text in ((packed.limit(0), "no patches"), (ragged, "differ in shape"), (packed.withColumn("data", F.when(F.col("seq") > 0, F.col("data"))), "no data")):
        with pytest.raises(Exception, match=text):
            policy.stack_patches(frame).collect()


def test_hooks_and_strictness(spark, tmp_path):
    calls = []
    told = lambda name: lambda *args: calls.append((name, *args))
    hooks = policy.Hooks(on_split_start=told("split"), on_split_end=told("split end"), on_merge_start=told("merge"), on_merge_end=lambda n: 1 / (n - 16), on_patch=lambda seq, s, n: calls.append(("patch", seq, n)), on_error=lambda seq, e: calls.append(("error", seq, str(e))))
    plan, source = SpatialPatcher(geo.Rectangular(2), smp.RegularStride(2), hooks=hooks, errors=policy.ErrorPolicy("skip")), raster(spark, 4)
    with pytest.warns(RuntimeWarning, match="on_merge_end"):
        plan.merge(plan.split(source), source)
    assert calls == [("split", 4), ("split end",), ("merge", -1)]
    calls.clear()
    with pytest.warns(RuntimeWarning, match="on_merge_end"):
        plan.merge_cells(source)
    plan.map(source, lambda v: 1 / 0 if v[0, 0] == 2 else v)
    assert calls == [("merge", -1), ("split", 4), ("split end",), *[("patch", s, 32) for s in (0, 2, 3)], ("error", 1, "ZeroDivisionError: division by zero")]
    median = SpatialPatcher(geo.Rectangular(2), smp.RegularStride(2), aggregation=agg.Median())
    with pytest.warns(RuntimeWarning, match="bounded memory"):
        median.stream_merge(source, str(tmp_path / "a"), 2)
    policy.set_strict(True)
    try:
        with pytest.raises(RuntimeError):
            median.stream_merge(source, str(tmp_path / "b"), 2)
    finally:
        policy.set_strict(None)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        SpatialPatcher(geo.Rectangular(2), smp.RegularStride(2), win.Hann()).stream_merge(source, str(tmp_path / "c"), 3)
    assert spark.read.parquet(str(tmp_path / "c")).count() == 16


# ---------------------------------------------------------------- streams
def test_stream_merge_equals_batch(spark, tmp_path):
    source = raster(spark, 12)
    source.df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    plan = SpatialPatcher(geo.Rectangular(4), smp.RegularStride(2), win.Hann())
    q = live.merge(stream, source, plan).writeStream.outputMode("complete").format("memory").queryName("merged").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.r, r.c): r.value for r in spark.table("merged").collect()}
    want = {(r.r, r.c): r.value for r in plan.merge_cells(source).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_stream_fold_goes_on(spark, tmp_path):
    rows = spark.range(30).select((F.col("id") % 2).cast("string").alias("k"), F.col("id").alias("t"), F.col("id").cast("double").alias("v"))
    for part in range(3):
        rows.where((F.col("t") >= part * 10) & (F.col("t") < part * 10 + 10)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.fold(stream, "k", "t", "v", lambda a, v: a + v, 0.0).writeStream.outputMode("update").format("memory").queryName("folded").start()
    q.processAllAvailable()
    q.stop()
    assert {r.k: r.s for r in spark.table("folded").groupBy("k").agg(F.max("state").alias("s")).collect()} == {"0": sum(range(0, 30, 2)), "1": sum(range(1, 30, 2))}


def test_event_time_windows(spark, tmp_path):
    rows = spark.range(100).select((F.lit(1_700_000_000) + F.col("id")).cast("timestamp").alias("ts"), F.lit(0).alias("r"), F.col("id").cast("double").alias("value"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = live.windowed(stream, "ts", "20 seconds", "10 seconds", ["r"], agg.Mean()).writeStream.outputMode("complete").format("memory").queryName("timed").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("timed").count() in (5, 6)


def test_stack_of_a_whole_raster(spark):
    """Every event is in a stack, and a stack is one row of patches."""
    from fieldweave import catalogue as cat

    sf = "/root/testdata/sf0.001"
    rows = cat.stack_patches_whole(spark, sf).collect()
    last, total = spark.read.parquet(f"{sf}/events.parquet").selectExpr("max(event_id)", "sum(value)").first()
    height = last // cat.WIDTH + 1
    assert height > 8 and {r.ar for r in rows} == set(range(0, height - 3, 4)) and len(rows) == height // 4 * 25
    if height % 4 == 0:
        assert abs(sum(r.total for r in rows) - total) < 1e-3
    packed = cat.patcher(size=4, step=4).packed(cat.raster(spark, sf))
    assert {(r.n, len(r.seqs), len(r.stacked)) for r in policy.stack_patches(packed, by=("ar",)).collect()} == {(25, 25, 25)}
