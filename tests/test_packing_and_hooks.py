"""Tasks of even bytes, hooks by observation, folds in a tree."""

import threading
import time

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from fieldweave.operators import geometry as geo
from fieldweave.operators import samplers as smp
from fieldweave.operators import temporal as tmp
from fieldweave.plans import policy
from fieldweave.plans.patcher import SpatialPatcher
from fieldweave.sources import fields as fld


def packed(spark, sizes):
    rows = [(i, [n], [float(i)] * n, [1.0] * n) for i, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "seq long, shape array<int>, data array<double>, weights array<double>").repartition(7)


def held(df):
    """Bytes of each task."""
    def run(batches):
        for b in batches:
            yield b.assign(task=TaskContext.get().partitionId(), bytes=[16 * len(d) for d in b["data"]])[["task", "bytes", "seq"]]

    out = {}
    for r in df.mapInPandas(run, "task int, bytes long, seq long").collect():
        out.setdefault(r.task, []).append((r.seq, r.bytes))
    return out


def test_tasks_of_even_bytes(spark):
    sizes = [1000] * 5 + [10] * 500 + [300] * 20  # the first patches are large
    most = 16 * 2000
    tasks = held(policy.deal_by_bytes(packed(spark, sizes), most))
    loads = [sum(n for _, n in rows) for rows in tasks.values()]
    assert sum(loads) == 16 * sum(sizes) and max(loads) <= 2 * sum(loads) / len(loads)
    assert max(loads) < most + 16 * 1000
    spans = sorted((min(s for s, _ in rows), max(s for s, _ in rows)) for rows in tasks.values())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))  # tasks keep the order
    assert len(held(policy.deal_by_bytes(packed(spark, [1, 2]), 10**9))) == 1
    assert policy.deal_by_bytes(packed(spark, [1]).limit(0), 10).count() == 0
    with pytest.raises(ValueError):
        policy.deal_by_bytes(packed(spark, [1]), 0)


def test_maps_in_packed_tasks_give_the_same(spark):
    source = fld.raster(spark.range(256).selectExpr("id div 16 AS r", "id % 16 AS c", "CAST(id AS double) AS value"), 16, 16)
    plain = SpatialPatcher(geo.Rectangular(4, "shrink"), smp.RegularStride(3))
    dealt = SpatialPatcher(geo.Rectangular(4, "shrink"), smp.RegularStride(3), max_task_bytes=600)
    rows = lambda plan: sorted((r.seq, tuple(r.data)) for r in plan.map(source, lambda v: v * 2).patches.collect())
    assert rows(plain) == rows(dealt) and dealt.get_config()["max_task_bytes"] == 600


def test_hooks_by_observation(spark):
    calls, done = [], threading.Event()
    hooks = policy.Hooks(on_split_end=lambda: calls.append("split end"), on_merge_end=lambda n: (calls.append(("merge end", n)), done.set()), observe=True)
    source = fld.raster(spark.range(64).selectExpr("id div 8 AS r", "id % 8 AS c", "CAST(id AS double) AS value"), 8, 8)
    plan = SpatialPatcher(geo.Rectangular(4), smp.RegularStride(2), hooks=hooks)
    before = [j for j in spark.sparkContext.statusTracker().getJobIdsForGroup(None)]
    out = plan.merge(plan.split(source), source)
    assert calls == [] and [j for j in spark.sparkContext.statusTracker().getJobIdsForGroup(None)] == before  # nothing has run
    rows = len(out.collect())
    assert done.wait(30)
    deadline = time.time() + 30
    while len(calls) < 2 and time.time() < deadline:
        time.sleep(0.1)
    assert ("merge end", rows) in calls and "split end" in calls
    written = []
    both = SpatialPatcher(geo.Rectangular(4), smp.RegularStride(2), hooks=policy.Hooks(on_merge_end=written.append))
    both.merge(both.split(source), source)
    assert written == [rows]


def test_chunked_folds_meet_in_a_tree(spark):
    rows = [(k, i, 0, i, i, i + 1, [float(i % 7)], [1.0]) for k in ("a", "b") for i in range(3000 if k == "a" else 2)]
    df = spark.createDataFrame(rows, "k string, seq long, scale int, t_anchor long, start long, stop long, data array<double>, weights array<double>")
    out = tmp.fold(df, ["k"], F.lit(0.0), lambda a, d: a + F.element_at(d, 1), lambda a, b: a + b, chunk=10)
    assert {r.k: r.state for r in out.collect()} == {"a": float(sum(i % 7 for i in range(3000))), "b": 1.0}
