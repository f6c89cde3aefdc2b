import random

import pytest
from pyspark.sql import functions as F

from fieldweave.operators import scan
from fieldweave.operators import temporal as tmp


def test_prefix_sums(spark):
    r = random.Random(1)
    rows = [(i % 7, i, r.choice([None, 0, 3, 1 << 40])) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b long, n long").repartition(7)
    got = {(x.a, x.b): x.before for x in scan.prefix_sums(df, ["a", "b"], "n").collect()}
    total = 0
    for a, b, n in sorted(rows, key=lambda x: x[:2]):
        assert got[a, b] == total
        total += n or 0
    assert scan.prefix_sums(df.limit(0), ["a", "b"], "n").collect() == []


@pytest.mark.parametrize("chunk", [2, 3, 128])
def test_running_states(spark, monkeypatch, chunk):
    monkeypatch.setattr(scan, "CHUNK", chunk)
    r = random.Random(chunk)
    rows = [(k, i, s, [r.random() for _ in range(2)]) for k in (None, "x", "y") for i in range(0, 60 if k != "y" else 1) if i % 5 != 3 for s in range(1 + i % 2)]
    df = spark.createDataFrame(rows, "k string, seq long, scale int, data array<double>").repartition(5)
    total = lambda d: F.aggregate(d, F.lit(0.0), lambda a, x: a + x)
    own = scan.affine(0.5, total)
    got = {(x.k, x.seq, x.scale): x.state for x in scan.running(df, ["k"], own, F.lit(1.0), tie="scale").collect()}
    last = {x.k: x.state for x in scan.whole(df, ["k"], own, F.lit(1.0), tie="scale").collect()}
    assert len(got) == len(rows)
    for k in (None, "x", "y"):
        state = 1.0
        for _, i, s, data in sorted((x for x in rows if x[0] == k), key=lambda x: x[1:3]):
            state = state * 0.5 + sum(data)
            assert got[k, i, s] == pytest.approx(state, abs=1e-9)
        assert last[k] == pytest.approx(state, abs=1e-9)


def test_any_associative_operation(spark, monkeypatch):
    """First and last letters met, and a joined text: not commutative."""
    monkeypatch.setattr(scan, "CHUNK", 3)
    df = spark.createDataFrame([(i, chr(97 + i)) for i in range(20)], "seq long, data string")
    joined = scan.Monoid(lambda d: d, lambda x, y: F.concat(x, y), lambda s, x: F.concat(s, x))
    got = [r.state for r in scan.running(df, [], joined, F.lit("-")).orderBy("seq").collect()]
    assert got == ["-" + "".join(chr(97 + j) for j in range(i + 1)) for i in range(20)]
    assert [r.state for r in scan.whole(df, [], joined, F.lit("-")).collect()] == [got[-1]]
    assert scan.running(df.limit(0), [], joined, F.lit("-")).collect() == []


def test_fold_by_a_monoid_holds_no_series(spark):
    df = spark.createDataFrame([("a", i, 0, i, i, i + 1, [float(i)], [1.0]) for i in range(1000)], "k string, seq long, scale int, t_anchor long, start long, stop long, data array<double>, weights array<double>")
    first = tmp.FoldBy(scan.affine(0.5, lambda d: F.element_at(d, 1))).merge(df, ["k"]).collect()
    state = 0.0
    for i in range(1000):
        state = state * 0.5 + i
    assert [(r.k, pytest.approx(r.state)) for r in first] == [("a", state)]
