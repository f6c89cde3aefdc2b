import gzip
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.domains import RasterDomain
from fieldweave.sources import chunks
from fieldweave.sources import fields as fld


def raster(spark, data, **meta):
    rows = [(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(data)]
    return fld.raster(spark.createDataFrame(rows, "r long, c long, value double").repartition(3), *data.shape, **meta)


def dense(df, shape):
    out = np.full(shape, np.nan)
    for *at, v in df.collect():
        out[tuple(at)] = v
    return out


def made(h=23, w=31):
    data = np.random.default_rng(h).random((h, w)).astype(np.float32).astype(float)
    data[:8, 8:16] = np.nan
    data[h - 3, 3] = np.nan
    return data


@pytest.mark.parametrize("shard", [None, (16, 16), (8, 24)])
def test_round_trip_and_windows(spark, tmp_path, shard):
    data, path = made(), str(tmp_path / "a")
    chunks.write_field(raster(spark, data, transform=(2.0, 0.0, 5.0, 0.0, -2.0, 9.0), crs="EPSG:32630"), path, (8, 8), shard)
    store = chunks.opened(path)
    assert (store.shape, store.chunk, store.shard, store.dims) == (data.shape, (8, 8), shard, ("r", "c"))
    field = store.field(spark)
    assert field.domain == RasterDomain(23, 31, None, (2.0, 0.0, 5.0, 0.0, -2.0, 9.0), "EPSG:32630")
    np.testing.assert_array_equal(dense(field.df, data.shape), data)
    for rows, cols in ((slice(3, 11), slice(5, 30)), (slice(22, 99), slice(None, 1)), (slice(7, 7), slice(0, 5)), (slice(-4, 2), slice(30, 31))):
        want = np.full_like(data, np.nan)
        own = (slice(max(rows.start, 0), rows.stop), cols)
        want[own] = data[own]
        np.testing.assert_array_equal(dense(store.cells(spark, {"r": rows, "c": cols}), data.shape), want)


def test_files_follow_the_layout(spark, tmp_path):
    """Files by hand: the format's own rules, without this module's reader."""
    data, path = made(10, 10), str(tmp_path / "a")
    chunks.write_field(raster(spark, data), path, (4, 4), dtype="float64")
    meta = json.load(open(f"{path}/zarr.json"))
    assert (meta["zarr_format"], meta["shape"], meta["data_type"], meta["fill_value"]) == (3, [10, 10], "float64", "NaN")
    assert sorted(os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs) == sorted(["zarr.json", *(f"c/{i}/{j}" for i in range(3) for j in range(3))])
    own = np.frombuffer(gzip.decompress(open(f"{path}/c/2/1", "rb").read()), "<f8").reshape(4, 4)
    np.testing.assert_array_equal(own[:2], data[8:10, 4:8])
    assert np.isnan(own[2:]).all()
    chunks.write_field(raster(spark, data), str(tmp_path / "b"), (4, 4), (8, 8))
    raw = open(str(tmp_path / "b" / "c" / "0" / "0"), "rb").read()
    index = np.frombuffer(raw[-64:], "<u8").reshape(4, 2)
    at, n = (int(x) for x in index[2])
    np.testing.assert_array_equal(np.frombuffer(gzip.decompress(raw[at : at + n]), "<f4").reshape(4, 4), data[4:8, :4].astype(np.float32))
    assert [int(x) for x in index[2 * 0 + 1]] != [chunks.NOTHING] * 2 or np.isnan(data[:4, 4:8]).all()


def test_a_killed_write_is_resumed(spark, tmp_path):
    data, path = made(), str(tmp_path / "a")
    source = raster(spark, data)
    bad = source.with_data(source.df.withColumn("value", F.when((F.col("r") == 20) & (F.col("c") == 20), F.raise_error(F.lit("lost"))).otherwise(F.col("value"))))
    with pytest.raises(Exception):
        chunks.write_field(bad, path, (8, 8))
    assert not os.path.exists(f"{path}/zarr.json")
    store = chunks.ChunkStore(path, ("r", "c"), data.shape, (8, 8))
    store.write(source.df.where("r < 8")).collect()
    before = {n: os.stat(store.file_of(n)).st_mtime_ns for n in range(4)}
    assert sorted(r.file for r in store.missing(spark).collect()) == list(range(4, 12))
    # what is there isn't computed or written again
    again = source.with_data(source.df.withColumn("value", F.when(F.col("r") < 8, F.lit(-1.0)).otherwise(F.col("value"))))
    chunks.write_field(again, path, (8, 8), resume=True)
    assert {n: os.stat(store.file_of(n)).st_mtime_ns for n in range(4)} == before
    np.testing.assert_array_equal(dense(chunks.opened(path).cells(spark), data.shape), data)
    assert not [f for _, _, fs in os.walk(path) for f in fs if f.endswith(".tmp")]


@pytest.mark.parametrize("shard", [None, (16, 16)])
def test_partial_rewrites(spark, tmp_path, shard):
    data, path = made(), str(tmp_path / "a")
    store = chunks.write_field(raster(spark, data), path, (8, 8), shard)
    new = spark.createDataFrame([(0, 0, 5.0), (9, 9, None), (2, 10, 7.0), (99, 0, 1.0)], "r long, c long, value double")
    touched = store.write(new, update=True).collect()
    assert len(touched) == (1 if shard else 3) and sum(r.cells for r in touched) == 3
    data[0, 0], data[9, 9], data[2, 10] = 5.0, np.nan, 7.0
    np.testing.assert_array_equal(dense(store.cells(spark), data.shape), data)


def test_bands_whole_numbers_and_grids(spark, tmp_path):
    rows = [(b, r, c, 100 * b + 10 * r + c) for b in range(2) for r in range(5) for c in range(6)]
    own = fld.raster(spark.createDataFrame(rows, "band int, r long, c long, value long"), 5, 6, bands=2)
    chunks.write_field(own, str(tmp_path / "a"), (1, 4, 4), (2, 4, 4), dtype="int16")
    store = chunks.opened(str(tmp_path / "a"))
    assert sorted((x.band, x.r, x.c, int(x.value)) for x in store.cells(spark).collect()) == rows and store.field(spark).domain.bands == 2
    grid = fld.grid(spark.createDataFrame([(i, j, k, float(i + j + k)) for i in range(3) for j in range(2) for k in range(4)], "t long, lat long, lon long, value double"), {"t": [0, 1, 2], "lat": [5.0, 6.0], "lon": [1, 2, 3, 4]})
    chunks.write_field(grid, f"file://{tmp_path}/g", (2, 2, 3))
    assert chunks.opened(f"file://{tmp_path}/g").cells(spark).count() == 24


def test_what_is_refused(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        chunks.opened(str(tmp_path / "none"))
    with pytest.raises(ValueError):
        chunks.ChunkStore("x", ("r",), (4,), (3,), (4,))
    with pytest.raises(ValueError):
        chunks.ChunkStore("x", ("r",), (4,), (3,), dtype="complex64")
    store = chunks.write_field(raster(spark, np.ones((3, 3))), str(tmp_path / "a"), (2, 2))
    for key, value in (("zarr_format", 2), ("codecs", [{"name": "bytes"}, {"name": "zstd"}]), ("chunk_key_encoding", {"name": "v2"})):
        with open(f"{store.path}/zarr.json", "w") as f:
            json.dump(store.metadata() | {key: value}, f)
        with pytest.raises(ValueError):
            chunks.opened(store.path)
    empty = chunks.ChunkStore(str(tmp_path / "e"), ("r", "c"), (4, 4), (2, 2))
    assert empty.write(spark.createDataFrame([], "r long, c long, value double")).collect() == []
    empty.commit()
    assert chunks.opened(empty.path).cells(spark).collect() == []
