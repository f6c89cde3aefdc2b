import threading

import numpy as np
import pytest

from fieldweave.llm import shared


def exists(spark, path):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def test_threads_keep_their_own_tables(spark):
    """The first call to end must not delete what the other one still reads."""
    first_made, second_made, out = threading.Event(), threading.Event(), {}

    def first():
        def make():
            df = shared.materialize(spark.range(5).selectExpr("id AS x"))
            first_made.set()
            second_made.wait(60)
            return df

        out["first"] = shared.finished(make).count()
        out["ended"] = True

    def second():
        first_made.wait(60)

        def make():
            df = shared.materialize(spark.range(7).selectExpr("id AS x"))
            second_made.set()
            one.join(60)
            assert out["ended"]
            return df

        out["second"] = shared.finished(make).count()

    one, two = threading.Thread(target=first), threading.Thread(target=second)
    one.start(), two.start(), one.join(90), two.join(90)
    assert (out["first"], out["second"]) == (5, 7)


def test_tables_of_a_failed_call_are_deleted(spark):
    made = []

    def make():
        made.append(shared.materialize(spark.range(3).toDF("x"))._scratch_path)
        made.append(shared.finished(lambda: shared.materialize(spark.range(3).toDF("x")))._scratch_path)
        raise RuntimeError("no result")

    with pytest.raises(RuntimeError):
        shared.finished(make)
    assert made and not any(exists(spark, p) for p in made)


@pytest.mark.parametrize("constant", [False, True])
def test_classes_are_those_of_the_bytes(monkeypatch, constant):
    if constant:
        monkeypatch.setattr(shared, "names", lambda buf, s, e: np.zeros(len(s), np.uint64))
    rng = np.random.default_rng(3)
    buf = rng.integers(97, 99, 3000).astype(np.uint8)
    s = rng.integers(0, 2990, 800)
    e = s + rng.integers(0, 10, 800)
    got = shared.classes(buf, s, e)
    want = [buf[a:b].tobytes() for a, b in zip(s, e, strict=True)]
    assert len(set(zip(want, got.tolist(), strict=True))) == len(set(want)) == len(set(got.tolist()))


def test_names_of_long_strings():
    word, other = "ab"
    while len(word) < 4096:
        word, other = word + other, other + word
        buf = np.frombuffer((word + other).encode(), np.uint8)
        n = len(word)
        a, b = shared.names(buf, np.array([0, n]), np.array([n, 2 * n]))
        assert a != b
        if n >= 8:
            a, b = shared.slices(shared.prefix_of_fours(buf), np.array([0, n]), np.array([n - 3, 2 * n - 3]))
            assert a != b
