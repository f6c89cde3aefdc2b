"""Ordered folds over streams: out-of-order rows, restarts, late rows, keys at rest."""

import random

import pytest
from pyspark.sql import functions as F

from fieldweave.operators import aggregations as agg
from fieldweave.streaming import live

BASE = 1_700_000_000


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    yield
    spark.conf.set(name, before) if before else spark.conf.unset(name)


def put(spark, path, rows):
    df = spark.createDataFrame(rows, "k string, s long, o long, v double").withColumn("ts", (F.lit(BASE) + F.col("s")).cast("timestamp"))
    df.coalesce(1).write.mode("append").parquet(path)
    return df.schema


def run(spark, tmp_path, schema, **more):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    folded = live.fold_in_order(stream, "k", "ts", "o", "v", lambda a, v: a * 0.5 + v, 0.0, "20 seconds", **more)
    q = folded.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "check")).start(str(tmp_path / "out"))
    q.processAllAvailable()
    q.stop()
    return {(r.k, r.s, r.order): r.state for r in spark.read.parquet(str(tmp_path / "out")).selectExpr("k", f"unix_timestamp(time) - {BASE} AS s", "order", "state").collect()}


def states(rows):
    out, acc = {}, {}
    for k, s, o, v in sorted(rows, key=lambda r: r[1:3]):
        acc[k] = acc.get(k, 0.0) * 0.5 + v
        out[k, s, o] = acc[k]
    return out


def test_order_restart_and_late_rows(spark, tmp_path, store):
    r = random.Random(1)
    rows = [(r.choice("ab"), s, s, float(r.randint(0, 9))) for s in range(60)]
    blocks = [rows[i : i + 12] for i in range(0, 60, 12)]
    for b in blocks:
        r.shuffle(b)  # out of order within what may be late
    schema = None
    for b in blocks[:3]:
        schema = put(spark, str(tmp_path / "in"), b)
    first = run(spark, tmp_path, schema)
    want = states(rows)
    assert first and all(first[k] == pytest.approx(want[k]) for k in first)
    # the query goes on from its checkpoint; a row far behind is late and dropped; one far ahead lets all others out
    for b in [*blocks[3:], [("a", 0, 999, 100.0)], [("z", 10_000, 0, 1.0)], [("z", 20_000, 1, 1.0)]]:
        put(spark, str(tmp_path / "in"), b)
    second = run(spark, tmp_path, schema)
    assert ("a", 0, 999) not in second
    assert {k for k in second if k[0] != "z"} == want.keys()
    assert all(second[k] == pytest.approx(want[k]) for k in want)


def test_a_key_at_rest_begins_anew(spark, tmp_path, store):
    for b in [[("a", 0, 0, 8.0), ("a", 1, 1, 4.0)], [("b", 200, 0, 1.0)], [("b", 300, 1, 1.0)], [("a", 310, 2, 2.0)], [("b", 900, 3, 1.0)], [("b", 1000, 4, 1.0)]]:
        schema = put(spark, str(tmp_path / "in"), b)
    got = run(spark, tmp_path, schema, idle_seconds=60)
    assert (got["a", 0, 0], got["a", 1, 1]) == (8.0, 8.0)
    assert got["a", 310, 2] == 2.0


@pytest.mark.parametrize("sketch", [agg.ApproxCardinality(12), agg.ApproxQuantile((0.25, 0.5), 400)])
def test_sketches_of_windows_merge_to_that_of_all(spark, tmp_path, sketch):
    rows = spark.range(400).select((F.lit(BASE) + F.col("id")).cast("timestamp").alias("ts"), (F.col("id") % 2).alias("k"), (F.col("id") % 97).cast("double").alias("value"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = live.sketches(stream, "ts", "50 seconds", "10 seconds", ["k"], sketch).writeStream.outputMode("complete").format("memory").queryName("sketched").start()
    q.processAllAvailable()
    q.stop()
    states = spark.table("sketched")
    assert states.count() >= 16
    assert sketch.merge(states).collect() == sketch.merge(sketch.sketch(rows)).collect()
    with pytest.raises(ValueError):
        live.sketches(stream, "ts", "50 seconds", "10 seconds", [], agg.Reservoir())
