"""Neighbourhoods of dense points: nothing that grows with their pairs is shuffled."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from fieldweave import catalogue
from fieldweave.operators import coregister
from fieldweave.operators import geometry as geo
from fieldweave.operators import pairs
from fieldweave.operators import samplers as smp
from fieldweave.plans import policy
from fieldweave.plans.patcher import SpatialPatcher
from fieldweave.sources import fields as fld


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def dense(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(x), float(y), None if i % 11 == 0 else float(i % 7)) for i, (x, y) in enumerate(rng.normal(0, 0.3, (300, 2)))]
    source = fld.points(spark.createDataFrame(rows, "pid long, x double, y double, value double"), "pid", ("value",))
    anchors = source.df.where("pid % 3 = 0").selectExpr("pid as seq", "x as ax", "y as ay").unionByName(spark.createDataFrame([(999, 50.0, 50.0)], "seq long, ax double, ay double"))
    return source, anchors


@pytest.mark.parametrize("on_error", ["raise", "skip", "mask"])
def test_maps_cut_neighbourhoods_out_of_blocks(dense, monkeypatch, on_error):
    """Blocks of few anchors and batches of few cells give what packed neighbourhoods give, without gathering pairs by a shuffle."""
    source, anchors = dense
    monkeypatch.setattr(geo, "ANCHORS", 5)
    monkeypatch.setattr(policy, "CELLS", 40)

    def centred(values):
        if on_error != "raise" and len(values) % 4 == 0:
            raise ValueError("four")
        return values - np.nanmean(values)

    policy_ = policy.ErrorPolicy(on_error)
    near = SpatialPatcher(geo.RadiusGraph(0.2), errors=policy_).map(source, centred, anchors=anchors)
    packed = SpatialPatcher(geo.RadiusGraph(0.2), errors=policy_, max_task_bytes=1 << 20).map(source, centred, anchors=anchors)
    told = lambda m: sorted(tuple(r) for r in m.patches.drop("runtime_s").collect())
    assert [str(r) for r in told(near)] == [str(r) for r in told(packed)] and near.patches.columns == packed.patches.columns
    assert sorted(map(str, near.errors.collect())) == sorted(map(str, packed.errors.collect()))
    if on_error == "raise":
        assert "collect_list" not in plan_of(near.patches)


def test_a_batch_of_whole_patches_is_worked_on_in_parts(monkeypatch):
    monkeypatch.setattr(coregister, "PATCHES", 3)
    data = [[[1.0 * i, 2.0], [3.0, 4.0 * i]] for i in range(10)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array([[1, 2]] * 10, pa.list_(pa.int32())), pa.array(data)], ["seq", "shape", "data"])
    parts = list(coregister._mapped([lambda second, first: second - first])(iter([batch])))
    assert [p.num_rows for p in parts] == [3, 3, 3, 1]
    assert [x for p in parts for x in p.column("data").to_pylist()] == [[[3.0 - i, 4.0 * i - 2]] for i in range(10)]
    assert [x for p in parts for x in p.column("seq").to_pylist()] == list(range(10))


def test_rounds_of_a_well_spaced_choice_broadcast_no_copies(spark, monkeypatch):
    """A taken candidate is copied to the squares around; the copies would be a broadcast of many times the table's size."""
    plans, write = [], smp.written
    monkeypatch.setattr(smp, "written", lambda df: plans.append(plan_of(df)) or write(df))
    rows = spark.range(200).selectExpr("id as seq", "rand(1) * 5 as x", "rand(2) * 5 as y", "xxhash64(id) as rank")
    taken = [(r.x, r.y) for r in smp.well_spaced(rows, 1.0).collect()]
    assert min(np.hypot(a - c, b - d) for i, (a, b) in enumerate(taken) for c, d in taken[:i]) >= 1.0
    assert sum("Join" in p for p in plans) >= 2 and not any("BroadcastHashJoin" in p for p in plans)


@pytest.mark.parametrize("shape, metric", [(geo.RadiusGraph(0.2), "euclidean"), (geo.SphericalCap(30.0), "haversine")])
def test_cells_of_a_cube_are_met_where_their_places_are(dense, shape, metric):
    """No pair is shuffled to find its times, and pairs are made in as many tasks as there are."""
    source, anchors = dense
    cells = source.df.selectExpr("pid", "x", "y", "explode(sequence(0, 2)) as t").selectExpr("*", "pid * 10.0D + t as value")
    near = SpatialPatcher(shape).split(fld.point_cube(cells, "pid"), anchors)
    own = [tuple(r) for r in source.df.select("pid", "x", "y").collect()]
    told = geo.SphericalCap(30.0).neighbours(anchors, source.df) if metric == "haversine" else None
    pairs = {(r.seq, r.pid) for r in told.collect()} if told is not None else {(a[0], b[0]) for a in own if a[0] % 3 == 0 for b in own if np.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) <= 0.2}
    assert sorted((r.seq, r.pid, r.t, r.value) for r in near.collect()) == sorted((s, p, t, p * 10.0 + t) for s, p in pairs for t in range(3))
    assert "Join [pid" not in plan_of(near) and "SortMergeJoin [b0" in plan_of(near)


@pytest.mark.parametrize("metric, radius", [("euclidean", 0.2), ("euclidean", 0.0), ("haversine", 30.0), ("haversine", 30000.0)])
def test_pairs_both_ways_are_all_points_neighbours(dense, monkeypatch, metric, radius):
    """Crowded blocks, short runs, points in one place, ids that come twice, coordinates that are not known: the same rows, to the last bit."""
    own = dense[0].df.select("pid", "x", "y")
    odd = own.sparkSession.createDataFrame([(7, 0.1, 0.1), (7, 0.1, 0.1), (8, 0.1, 0.1), (9, -0.0, 0.0), (9, 0.0, -0.0), (400, 180.0, 89.9), (401, -180.0, 89.9), (402, 0.0, None), (403, 0.0, 90.0)], "pid long, x double, y double")
    own = own.unionByName(odd)
    shape, at = geo.RadiusGraph(radius, metric), own.selectExpr("pid as seq", "x as ax", "y as ay")
    wanted = sorted(map(tuple, shape.neighbours(at, own).select("seq", "pid", "distance").collect()))
    monkeypatch.setattr(geo, "BLOCK", 20)
    monkeypatch.setattr(geo, "RUN", 3)
    assert sorted(map(tuple, shape.pairs(own).collect())) == wanted and len(wanted) > 300


@pytest.mark.parametrize("name, most", [("radius_euclid", 5), ("radius_haversine", 7)])
def test_pairs_take_few_bytes_in_a_file(spark, tmp_path, name, most):
    """All pairs within a radius are very many rows; a pair and its turn are kept as one distance."""
    closer = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id", "transform(embedding, v -> v / 3) as embedding")
    closer.write.parquet(str(tmp_path / "embeddings.parquet"))
    catalogue.QUERIES[name](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).count()
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < most * rows


def test_distances_back_are_kept_as_copies(spark, tmp_path):
    """Packed numbers are the same bytes only in runs of whole eights: near half of the distances' bytes are left, with few of the ids'."""
    at = np.random.default_rng(5).normal(0, 0.04, (1500, 2))
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "pid long, x double, y double")
    geo.RadiusGraph(0.1).pairs(points).selectExpr("seq", "pid", "round(distance, 3) as distance").write.parquet(str(tmp_path / "out"))
    groups = [pq.ParquetFile(f).metadata.row_group(0) for f in (tmp_path / "out").glob("*.parquet")]
    kept, packed = ([sum(getattr(g.column(c), f"total_{k}_size") for g in groups) for c in range(3)] for k in ("compressed", "uncompressed"))
    assert sum(g.num_rows for g in groups) == sum((np.sqrt(((at - p) ** 2).sum(1)) <= 0.1).sum() for p in at)
    assert kept[2] < 0.65 * packed[2] and max(kept[:2]) < 0.5 * packed[0]


@pytest.mark.parametrize("own", [False, True])
def test_runs_of_pairs_are_whole_eights(own):
    xy = np.random.default_rng(7).uniform(0, 0.2, (700, 2))
    xy[10], xy[420] = xy[430], xy[430]
    n, told, odd = 300, [], 0
    for i, j, sizes, back in pairs.of_blocks(xy, xy, n, 0.1, own, 32):
        assert sizes.sum() == len(i) == len(j) and (max(sizes, default=0) <= 32 or not back)
        odd += back * int((sizes % pairs.EIGHT > 0).sum())
        told += zip(i.tolist(), j.tolist(), [back] * len(i))
    near = {(i, j) for i in range(n) for j in range(n, 700) if ((xy[i] - xy[j]) ** 2).sum() <= 0.1**2}
    wanted = {(i, j, not own or tuple(xy[i]) < tuple(xy[j])) for i, j in near if not own or tuple(xy[i]) <= tuple(xy[j])}
    assert sorted(told) == sorted(wanted) and len(told) > 10000 and odd == 1
